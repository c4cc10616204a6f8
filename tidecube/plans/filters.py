"""User filters: Python functions with typed properties, applied to batches or groups of rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

KINDS = (bool, int, float, str, list)


@dataclass
class Filter:
    """request_data(pdf, **properties) -> pdf, with the schema of what it returns and its properties' defaults."""

    name: str
    request_data: Callable
    schema: str
    properties: dict = field(default_factory=dict)
    group_by: tuple[str, ...] = ()

    def __call__(self, df: DataFrame, **given) -> DataFrame:
        unknown = set(given) - set(self.properties)
        if unknown:
            raise TypeError(f"{self.name} has no property {', '.join(sorted(unknown))}")
        values = dict(self.properties)
        for key, value in given.items():
            kind = type(self.properties[key])
            if kind is float and isinstance(value, int) and not isinstance(value, bool):
                value = float(value)
            if not isinstance(value, kind):
                raise TypeError(f"{self.name}: {key} is a {kind.__name__}")
            values[key] = value
        run = self.request_data
        if self.group_by:
            return df.groupBy(*self.group_by).applyInPandas(lambda pdf: run(pdf, **values), self.schema)
        return df.mapInPandas(lambda parts: (run(pdf, **values) for pdf in parts), self.schema)


_FILTERS: dict[str, Filter] = {}


def register(name: str, schema: str, group_by: tuple[str, ...] = (), **properties):
    """Decorator: the function becomes the filter `name`; properties give names, types and defaults."""
    for key, value in properties.items():
        if not isinstance(value, KINDS):
            raise TypeError(f"{name}: {key} must be a bool, int, float, str or list")

    def keep(function: Callable) -> Filter:
        _FILTERS[name] = Filter(name, function, schema, properties, tuple(group_by))
        return _FILTERS[name]

    return keep


def get(name: str) -> Filter:
    return _FILTERS[name]


def names() -> list[str]:
    return sorted(_FILTERS)
