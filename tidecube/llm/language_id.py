"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams, calibrated by a temperature."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field as default

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_part, materialise, mix64

#: Hashed features, and the n-grams' lengths in characters.
FEATURE_BITS, ORDERS = 17, (1, 2, 3)
#: Rows that the classifier is fitted on, about, and the languages that it learns, the most frequent ones: the documented bounds of the training sample and of the model.
MAX_TRAIN, MAX_LANGUAGES = 8_000, 64
#: FTRL: per-coordinate rate alpha / (beta + sqrt(sum of squared gradients)); elastic-net strengths L1 and L2.
ALPHA, BETA, L1, L2 = 0.5, 0.1, 0.02, 0.01
EPOCHS = 2
#: One in so many sampled rows is left out of the fit and sets the temperature.
CALIBRATE = 5
UNKNOWN = "und"
#: Characters that are read at a time.
SEGMENT = 1 << 20

_KINDS: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """For each code point 2 if a letter, 1 if a mark (which goes with letters), else 0."""
    if not _KINDS:
        _KINDS.append(np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8))
    return _KINDS[0]


def plain_codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text with each run of what is no letter as one space, and a space at both ends; empty if there is no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[codes]
    if not (kind == 2).any():
        return np.empty(0, np.uint64)
    held = kind > 0
    before = np.concatenate(([True], held[:-1]))  # the first space stands for all that come before the first letter
    out = np.where(held, codes, 32)[held | before].astype(np.uint64)
    return np.concatenate(([np.uint64(32)] * bool(held[0]), out, [np.uint64(32)] * bool(held[-1]))).astype(np.uint64)


def _grams(codes: np.ndarray) -> np.ndarray:
    parts, total = [], np.zeros(len(codes), np.uint64)
    for order in range(1, max(ORDERS) + 1):
        if len(codes) < order:
            break
        total = total[: len(codes) - order + 1] * np.uint64(0xA0761D6478BD642F) + codes[order - 1 :] + np.uint64(1)
        if order in ORDERS:
            parts.append((mix64(total + np.uint64(order << 40)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int32))
    return np.concatenate(parts)


def term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct features, counts) of a text's n-grams; long texts are counted stretch by stretch, which overlap by what n-grams need."""
    codes = plain_codes(text) if text else np.empty(0, np.uint64)
    if not len(codes):
        return np.empty(0, np.int32), np.empty(0, np.int64)
    if len(codes) <= SEGMENT:
        return np.unique(_grams(codes), return_counts=True)
    total = np.zeros(1 << FEATURE_BITS, np.int64)
    for first in range(0, len(codes), SEGMENT):
        for order in ORDERS:
            part = codes[first : first + SEGMENT + order - 1]
            if len(part) >= order:
                found = _grams(part)
                ends = np.cumsum([len(part) - o + 1 for o in ORDERS if len(part) >= o])
                at = ORDERS.index(order)
                total += np.bincount(found[ends[at] - (len(part) - order + 1) : ends[at]], minlength=len(total))
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at]


def weighted(counts: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, values): (1 + ln count) * idf, of length 1."""
    at, n = counts
    value = (1 + np.log(n)) * idf[at]
    norm = np.sqrt((value * value).sum())
    return at, (value / norm if norm else value).astype(np.float32)


class Ftrl:
    """Multinomial logistic regression by follow-the-regularised-leader; a coordinate under L1 has weight 0."""

    def __init__(self, classes: int, size: int = 1 << FEATURE_BITS):
        self.z, self.n = np.zeros((size, classes)), np.zeros((size, classes))
        self.bias_z, self.bias_n = np.zeros(classes), np.zeros(classes)

    @staticmethod
    def _weights(z: np.ndarray, n: np.ndarray, l1: float, l2: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + l2))

    def weights(self, at) -> np.ndarray:
        return self._weights(self.z[at], self.n[at], L1, L2)

    def bias(self) -> np.ndarray:
        return self._weights(self.bias_z, self.bias_n, 0.0, L2)

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w, b = self.weights(at), self.bias()
        miss = softmax((value @ w + b)[None])[0]
        miss[label] -= 1
        g, n = value[:, None].astype(np.float64) * miss, self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g
        self.bias_z += miss - (np.sqrt(self.bias_n + miss * miss) - np.sqrt(self.bias_n)) / ALPHA * b
        self.bias_n += miss * miss


def softmax(logits: np.ndarray) -> np.ndarray:
    shifted = np.exp(logits - logits.max(axis=1, keepdims=True))
    return shifted / shifted.sum(axis=1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature from 1/64 to 64 with the least log loss, by golden section on its logarithm; 1 without rows.

    Targets are those of Platt's scaling: n rows give the true language (n + 1) / (n + languages), so rows that are all right do not ask for certainty.
    """
    rows, classes = logits.shape
    if not rows or classes < 2:
        return 1.0
    target = np.full((rows, classes), 1 / (rows + classes))
    target[np.arange(rows), labels] = (rows + 1) / (rows + classes)

    def loss(log_t: float) -> float:
        return -(target * np.log(np.maximum(softmax(logits / np.exp(log_t)), 1e-300))).sum(axis=1).mean()

    low, high, ratio = -np.log(64.0), np.log(64.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass
class Model:
    """languages in order, idf by feature, the features with a weight and their weights (features, languages), bias, temperature."""

    languages: list[str]
    idf: np.ndarray = default(repr=False)
    at: np.ndarray = default(repr=False)
    weights: np.ndarray = default(repr=False)
    bias: np.ndarray
    temperature: float = 1.0

    def dense(self) -> np.ndarray:
        table = np.zeros((1 << FEATURE_BITS, len(self.languages)), np.float32)
        table[self.at] = self.weights
        return table


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's document frequencies: one row for each feature that it saw."""
    total = np.zeros(1 << FEATURE_BITS, np.int64)
    for batch in batches:
        for text in batch.column(0):
            total[term_counts(text.as_py())[0]] += 1
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["feature", "df"])


def _features(idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [weighted(term_counts(t.as_py()), idf.value) for t in batch.column(2)]
            at, value = (pa.array([f[k].tobytes() for f in found], pa.binary()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), at, value], names=["place", "label", "at", "value"])

    return run


def _fit(classes: int):
    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("label").to_numpy(), table.column("place").to_numpy()))
        place, labels = table.column("place").to_numpy(), table.column("label").to_numpy()
        at = [np.frombuffer(v, np.int32) for v in table.column("at").to_pylist()]
        value = [np.frombuffer(v, np.float32) for v in table.column("value").to_pylist()]
        tuning = place % CALIBRATE == 0
        model = Ftrl(classes)
        for _ in range(EPOCHS):
            for row in order[~tuning[order]].tolist():
                model.learn(at[row], value[row], int(labels[row]))
        dense = model.weights(slice(None))
        held = np.flatnonzero(tuning)
        logits = np.array([value[r] @ dense[at[r]] + model.bias() for r in held]).reshape(-1, classes)
        used = np.flatnonzero(dense.any(axis=1))
        rows = [*dense[used].tolist(), model.bias().tolist(), [temperature(logits, labels[held])]]
        return pa.table({"at": pa.array([*used.tolist(), -1, -2], pa.int64()), "weights": pa.array(rows, pa.list_(pa.float64()))})

    return run


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN) -> Model:
    """A model from text and language of the rows that have both.

    Document frequencies count every such row; each task returns its own by feature, so at most 2**FEATURE_BITS numbers meet
    the driver. The classifier is fitted on at most about max_train rows, as many of each language: those with the smallest
    hashes of id and text, so the sample is the same on every run and does not follow the split of the input. One task learns from their hashed features, in hash order, since
    FTRL is sequential. Only the MAX_LANGUAGES most frequent languages are learned. Without rows there are no languages.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    spark, size = docs.sparkSession, 1 << FEATURE_BITS
    if not counts:
        return Model([], np.ones(size), np.empty(0, np.int64), np.empty((0, 0), np.float32), np.empty(0))
    languages = sorted(r["lang"] for r in counts)
    total, df = rows.count(), np.zeros(size)
    for r in rows.select("text").mapInArrow(_frequencies, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect():
        df[r["feature"]] = r["df"]
    idf = np.log((1 + total) / (1 + df)) + 1
    each = max(1, max_train // len(languages))
    chosen = F.lit(False)
    place = F.shiftrightunsigned(F.xxhash64("id", "text"), 11)
    for r in counts:
        chosen = chosen | ((F.col("lang") == r["lang"]) & (place < F.lit(int(min(1.0, each / r["n"]) * (1 << 53)))))
    number = F.array_position(F.lit(languages), F.col("lang")).cast("int") - 1
    sample = rows.where(chosen).select(place.alias("place"), number.alias("label"), "text")
    found = sample.mapInArrow(_features(spark.sparkContext.broadcast(idf)), "place long, label int, at binary, value binary")
    learned = found.groupBy(F.lit(0).alias("one")).applyInArrow(_fit(len(languages)), "at long, weights array<double>")
    weights = {r["at"]: r["weights"] for r in materialise(learned, "language-weights").collect()}
    bias, heat = np.array(weights.pop(-1, [0.0] * len(languages))), weights.pop(-2, [1.0])[0]
    at = np.array(sorted(weights), np.int64)
    return Model(languages, idf, at, np.array([weights[a] for a in at.tolist()], np.float32).reshape(-1, len(languages)), bias, heat)


def _scorer(model):
    table: list[np.ndarray] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        if not table:
            table.append(known.dense())
        for batch in batches:
            names, scores = [], []
            for text in batch.column(1):
                at, value = weighted(term_counts(text.as_py()), known.idf)
                if not len(at) or not known.languages:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                share = softmax(((value @ table[0][at] + known.bias) / known.temperature)[None])[0]
                names.append(known.languages[int(share.argmax())])
                scores.append(float(share.max()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the calibrated probability) of every row's whole text; UNKNOWN and 0 without a letter or a learned language.

    The model that is broadcast holds at most 2**FEATURE_BITS rows of MAX_LANGUAGES weights.
    """
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model)), f"doc_id {kind}, lang_pred string, score double")


def held_out_languages(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score; learned from the rows whose crc32 of the id does not leave 2 modulo 4.

    Language, source and id are no inputs of a prediction. Defined cases: a text that is null, empty or has no letter is `und` with score 0;
    a null id counts as empty text for the remainder; repeated rows are learned from and predicted each; equal probabilities go to
    the first language in code-point order; very long texts are counted in stretches of SEGMENT characters; without a row to learn from all
    are `und`, with one language all texts with a letter are of it; an empty table gives no rows; other columns are ignored.
    """
    model = train(docs.where(crc_part("doc_id", 4) != 2))
    return predict(docs, model).select("doc_id", (crc_part("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
