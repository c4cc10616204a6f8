"""Reads of parts of a file."""

from __future__ import annotations


class Ranges:
    """The bytes of a file, or of a buffer, a range at a time; taken counts the bytes that were read."""

    def __init__(self, source: str | bytes):
        self.taken = 0
        self._data = source if isinstance(source, bytes) else None
        self._file = None if self._data is not None else open(source, "rb")  # noqa: SIM115
        self.size = len(self._data) if self._data is not None else self._file.seek(0, 2)

    def read(self, at: int, size: int) -> bytes:
        if at < 0 or size < 0 or at + size > self.size:
            raise ValueError(f"bytes {at} to {at + size} of a file of {self.size}")
        self.taken += size
        if self._data is not None:
            return self._data[at : at + size]
        self._file.seek(at)
        return self._file.read(size)

    def close(self) -> None:
        if self._file is not None:
            self._file.close()

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, *_) -> None:
        self.close()
