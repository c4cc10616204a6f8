"""Language-model scores: a log-bilinear model trained in numpy with noise-contrastive estimation.

The noise term of the estimation is its exact expectation over the noise distribution, in place of drawn noise words: with
two levels of outputs, as many on each, all of a level's words are scored anyway. The vocabulary grows with the training tokens. Each partition trains one model in one pass and the
models are averaged once, so scores depend on how the table's rows are split; base counts and base scores do not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_part, materialise, signed, text_bytes, word_hashes

#: A vocabulary of side * side outputs is arranged as side classes of side words; all other words share the last output. The side is
#: GROWTH * tokens ** 0.2, so the vocabulary grows as tokens ** 0.4: from SIDE, which 35 million tokens pass, to the root of LOOKUP at 10 ** 12 tokens.
SIDE, GROWTH = 64, 2.0
VOCABULARY = SIDE * SIDE
#: Words before the predicted one, and length of a word's vector.
CONTEXT, WIDTH = 3, 16
#: Ratio of noise to data in the estimation, tokens of a training step and its Adagrad rate.
NOISE, STEP_TOKENS, RATE = 10.0, 16_384, 0.1
#: Words whose counts travel with the scoring tasks, at most, so also the most outputs; rarer words are joined.
LOOKUP = 1 << 18
#: The hash that stands for the end of a text (no word hashes to it but by chance of 2**-64).
END = np.uint64(0x656E64)
SLICE = 4096


def _end_hash() -> int:
    return int(np.array([END], np.uint64).view(np.int64)[0])


def _token_runs(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, token hashes of some rows, tokens in each): words, then the end."""
    for first, words in word_hashes(text_bytes(batch.column("text"), lower=True)):
        lengths = np.array([len(w) + 1 for w in words])
        flat = np.concatenate([x for w in words for x in (w, [END])]).astype(np.uint64)
        yield first, flat, lengths


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = []
        for _, flat, _ in _token_runs(batch):
            held.append(flat)
        if held:
            words, counts = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(words)), pa.array(counts.astype(np.int64))], names=["h", "c"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c): exact counts of all tokens of docs(text), by 64-bit hash of the word; the end is a token."""
    return docs.select("text").mapInArrow(_count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def vocabulary_size(tokens: int) -> int:
    """Outputs of a model that learns from so many tokens."""
    return max(SIDE, min(math.isqrt(LOOKUP), round(GROWTH * tokens**0.2))) ** 2


class Vocabulary:
    """The commonest words with their counts, sorted by hash; out is a word's output number, of `size`."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, types: int, size: int = VOCABULARY):
        self.size, self.unknown = size, size - 1
        order = np.lexsort((hashes, -counts))
        hashes, counts = hashes[order].view(np.uint64), counts[order]
        top = order[: 0] if not len(hashes) else np.arange(min(len(hashes), self.unknown))
        out = np.full(len(hashes), self.unknown, np.int32)
        out[top] = top
        end = np.flatnonzero(hashes == END)
        if len(end) and out[end[0]] == self.unknown:
            out[end[0]], out[top[-1]] = top[-1], self.unknown
        known = np.zeros(size)
        known[out[out < self.unknown]] = counts[out < self.unknown]
        known[self.unknown] = total - known.sum()
        self.known = known
        by_hash = np.argsort(hashes)
        self.hashes, self.counts, self.out = hashes[by_hash], counts[by_hash], out[by_hash]
        self.total, self.types = total, types
        members = int((out < self.unknown).sum())
        #: Mass of the words behind the shared output, with one for all words never seen.
        self.unknown_mass = known[self.unknown] + 0.5 * (types - members + 1)

    def find(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(output numbers, counts; count -1 where the word is not in the lookup)."""
        if not len(self.hashes):
            return np.full(len(flat), self.unknown, np.int32), np.full(len(flat), -1, np.int64)
        at = np.searchsorted(self.hashes, flat)
        at[at == len(self.hashes)] = 0
        hit = self.hashes[at] == flat
        return np.where(hit, self.out[at], self.unknown).astype(np.int32), np.where(hit, self.counts[at], -1)


class LogBilinear:
    """log P(w | context) = log P(class | context) + log P(w | class, context), both log-bilinear.

    The context's vector is the sum of its words' vectors, each scaled for its place; scores are its
    products with the vectors of classes and of the class's words, plus biases that start from counts. known: the
    outputs' counts, as many as the square of the number of classes.
    """

    def __init__(self, known: np.ndarray):
        rng, self.size, self.side = np.random.default_rng(11), len(known), math.isqrt(len(known))
        share = (known + 0.1) / (known + 0.1).sum()
        grid = share.reshape(self.side, self.side).T
        self.class_noise = np.log(NOISE * grid.sum(axis=1)).astype(np.float32)
        self.word_noise = np.log(NOISE * grid / grid.sum(axis=1, keepdims=True)).astype(np.float32)
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.parts = {
            "words": small(self.size + 1, WIDTH), "places": np.ones((CONTEXT, WIDTH), np.float32),
            "class_q": small(self.side, WIDTH), "class_b": self.class_noise - np.float32(np.log(NOISE)),
            "word_q": small(self.side, self.side, WIDTH), "word_b": self.word_noise - np.float32(np.log(NOISE)),
        }
        self.squares = {k: np.full_like(v, 1e-6) for k, v in self.parts.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.parts.values()])

    def load(self, flat: np.ndarray) -> LogBilinear:
        at = 0
        for key, value in self.parts.items():
            self.parts[key] = flat[at : at + value.size].reshape(value.shape).astype(np.float32)
            at += value.size
        return self

    def hidden(self, context: np.ndarray) -> np.ndarray:
        p = self.parts
        return sum(p["words"][context[k]] * p["places"][k] for k in range(CONTEXT))

    def _move(self, key: str, grad: np.ndarray, at=slice(None)) -> None:
        self.squares[key][at] += grad * grad
        self.parts[key][at] -= RATE * grad / np.sqrt(self.squares[key][at])

    def learn(self, context: np.ndarray, target: np.ndarray) -> None:
        """One step: the noise term of the estimation is its exact expectation over the noise distribution."""
        p, n = self.parts, len(target)
        h = self.hidden(context)
        kind, member = target % self.side, target // self.side

        grad_h = np.zeros_like(h)

        def estimate(scores: np.ndarray, noise: np.ndarray, hit: np.ndarray) -> np.ndarray:
            share, at = np.exp(noise), np.arange(len(hit))
            grad = np.subtract(noise, scores, out=scores)  # in place: these are the largest arrays of a step
            np.exp(np.clip(grad, -30, 30, out=grad), out=grad)
            grad += 1
            odds = 1 / grad[at, hit]
            np.divide(share, grad, out=grad)
            grad[at, hit] -= 1 - odds
            grad /= n
            return grad

        g = estimate(h @ p["class_q"].T + p["class_b"], self.class_noise, kind)
        grad_h += g @ p["class_q"]
        class_grad, class_bias = g.T @ h, g.sum(axis=0)
        order = np.argsort(kind.astype(np.uint16), kind="stable")
        edges = np.searchsorted(kind[order], np.arange(self.side + 1))
        sorted_h, sorted_member = h[order], member[order]
        sorted_grad = np.zeros_like(h)
        for c in range(self.side):
            lo, hi = edges[c], edges[c + 1]
            if lo == hi:
                continue
            mine = sorted_h[lo:hi]
            g = estimate(mine @ p["word_q"][c].T + p["word_b"][c], self.word_noise[c], sorted_member[lo:hi])
            sorted_grad[lo:hi] = g @ p["word_q"][c]
            self._move("word_q", g.T @ mine, c)
            self._move("word_b", g.sum(axis=0), c)
        grad_h[order] += sorted_grad

        flat = np.concatenate(context)
        places = np.stack([(grad_h * p["words"][context[k]]).sum(axis=0) for k in range(CONTEXT)])
        pull = np.concatenate([grad_h * p["places"][k] for k in range(CONTEXT)])
        words = np.stack([np.bincount(flat, weights=pull[:, d], minlength=self.size + 1) for d in range(WIDTH)], axis=1).astype(np.float32)
        self._move("class_q", class_grad)
        self._move("class_b", class_bias)
        self._move("places", places)
        self._move("words", words)

    def log10(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of the targets, by batched matrix products."""
        p = self.parts
        h = self.hidden(context)
        kind, member = target % self.side, target // self.side

        def normal(scores: np.ndarray, hit: np.ndarray) -> np.ndarray:
            top = scores.max(axis=1)
            own = scores[np.arange(len(hit)), hit] - top
            scores -= top[:, None]
            return own - np.log(np.exp(scores, out=scores).sum(axis=1))

        out = normal(h @ p["class_q"].T + p["class_b"], kind).astype(np.float64)
        order = np.argsort(kind.astype(np.uint16), kind="stable")
        edges = np.searchsorted(kind[order], np.arange(self.side + 1))
        inner = np.zeros(len(target))
        for c in range(self.side):
            mine = order[edges[c] : edges[c + 1]]
            if len(mine):
                inner[mine] = normal(h[mine] @ p["word_q"][c].T + p["word_b"][c], member[mine])
        return (out + inner) / np.log(10)


def _contexts(out: np.ndarray, lengths: np.ndarray, pad: int = VOCABULARY) -> np.ndarray:
    """(CONTEXT, tokens) outputs of the words before each token; pad, the number after the last output, before a text's start."""
    begin = np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = np.arange(len(out))
    return np.stack([np.where(place - k >= begin, out[np.maximum(place - k, 0)], pad) for k in range(1, CONTEXT + 1)])


def _learner(vocabulary: Vocabulary, start: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = LogBilinear(vocabulary.known), 0
        if start is not None:
            model.load(start)
        for batch in batches:
            for _, flat, lengths in _token_runs(batch):
                out, _ = vocabulary.find(flat)
                context = _contexts(out, lengths, vocabulary.size)
                for at in range(0, len(out), STEP_TOKENS):
                    model.learn(context[:, at : at + STEP_TOKENS], out[at : at + STEP_TOKENS])
                seen += len(out)
        if seen:
            values = model.flat()
            parts = [values[at : at + SLICE].tobytes() for at in range(0, len(values), SLICE)]
            salt = TaskContext.get().partitionId() % 64
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(parts)), pa.int32()), pa.array([salt] * len(parts), pa.int32()), pa.array([float(seen)] * len(parts)), pa.array(parts, pa.binary())],
                names=["part", "salt", "weight", "value"],
            )

    return run


def _mean(table: pa.Table) -> pa.Table:
    weights = table.column("weight").to_numpy()
    total = sum(w * np.frombuffer(v, np.float32).astype(np.float64) for w, v in zip(weights, table.column("value").to_pylist()))
    value = (total / weights.sum()).astype(np.float32).tobytes()
    return pa.table({"part": table.column("part").slice(0, 1), "salt": table.column("salt").slice(0, 1), "weight": [float(weights.sum())], "value": pa.array([value], pa.binary())})


def train(docs: DataFrame, counts: DataFrame) -> tuple[Vocabulary, np.ndarray]:
    """Vocabulary from counts(h, c) of docs(text), and the model's parameters.

    Every partition trains on all its texts from the same start, and the models are averaged by
    tokens: in groups first, so no task holds more than one of 64 shares of a slice of the parameters.
    What comes to the driver is bounded: LOOKUP words, some bins and one model of at most LOOKUP outputs.
    """
    n = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, types = int(n["n"] or 0), int(n["v"] or 0)
    bin_of = F.floor(F.log2("c") * 16).cast("int")
    bins = sorted(((r["b"], r["n"]) for r in counts.groupBy(bin_of.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, size = None, 0
    for b, words in bins:
        size += words
        if size > LOOKUP:
            break
        least = b
    common = counts.where((bin_of >= least) | (F.col("h") == _end_hash())) if least is not None else counts.where(F.col("h") == _end_hash())
    table = common.toArrow()
    vocabulary = Vocabulary(table.column("h").to_numpy().astype(np.int64), table.column("c").to_numpy().astype(np.int64), total, types, vocabulary_size(total))
    learned = docs.select("text").mapInArrow(_learner(vocabulary, None), "part int, salt int, weight double, value binary")
    schema = "part int, salt int, weight double, value binary"
    learned = learned.groupBy("part", "salt").applyInArrow(_mean, schema).groupBy("part").applyInArrow(_mean, schema)
    parts = {r["part"]: r["value"] for r in materialise(learned, "model").collect()}
    flat = np.frombuffer(b"".join(parts[k] for k in sorted(parts)), np.float32) if parts else LogBilinear(vocabulary.known).flat()
    return vocabulary, flat


def _scorer(vocabulary: Vocabulary, flat: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, row = LogBilinear(vocabulary.known).load(flat), TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, hashes, lengths in _token_runs(batch):
                out, counts = vocabulary.find(hashes)
                context = _contexts(out, lengths, vocabulary.size)
                score = np.concatenate([model.log10(context[:, at : at + STEP_TOKENS], out[at : at + STEP_TOKENS]) for at in range(0, len(out), STEP_TOKENS)])
                found = counts >= 0
                base = np.where(found, np.log10(np.maximum(counts, 0) + 0.5), 0.0)
                shared = out == vocabulary.unknown
                score = score + np.where(shared, base - np.log10(vocabulary.unknown_mass), 0.0)
                starts = np.cumsum(lengths) - lengths
                add = lambda v: np.add.reduceat(v, starts)
                missing = add((~found).astype(np.int64))
                rare = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(missing))).astype(np.int32), pa.array(signed(hashes[~found])))
                rows = np.arange(row, row + len(lengths))
                row += len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(lengths)), pa.array(rows), pa.array(lengths.astype(np.int64)), pa.array(lengths - missing), pa.array(add(base)), pa.array(add(score)), rare],
                    names=["doc_id", "row", "n_tokens", "n_found", "base", "model", "rare"],
                )

    return run


def score(docs: DataFrame, vocabulary: Vocabulary, flat: np.ndarray, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row's whole text.

    Words in the bounded lookup are scored in the pass over the texts; the counts of all other words are
    joined by hash, and their share of both scores added by row.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(base.dtypes)["doc_id"]
    rows = base.mapInArrow(_scorer(vocabulary, flat), f"doc_id {kind}, row long, n_tokens long, n_found long, base double, model double, rare array<long>")
    rows = materialise(rows, "scored")
    rare = rows.select("row", F.explode("rare").alias("h")).groupBy("row", "h").agg(F.count("*").alias("k"))
    rare = rare.join(counts, "h", "left").groupBy("row").agg(
        F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("extra"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("k"))).alias("seen"),
    )
    all_mass = float(np.log10(vocabulary.total + 0.5 * (vocabulary.types + 1)))
    extra = F.coalesce("extra", F.lit(0.0))
    return rows.drop("rare").join(rare, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_found") + F.coalesce("seen", F.lit(0))).cast("long").alias("n_known"),
        (F.col("base") + extra - F.col("n_tokens") * F.lit(all_mass)).alias("base_score"), (F.col("model") + extra).alias("score"),
    )


def held_out_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model and the counts come from all rows whose crc32 of the id does not leave 1 modulo 5. Tokens are
    lower-cased (A-Z) words and one end. Words outside the model's vocabulary share one output, whose
    probability is divided among them by their smoothed counts, so all words' probabilities add up to one,
    with one share for words never seen. Defined cases: null and empty texts are the end alone; a null id counts
    as empty text; repeated rows are scored each; very long texts are scored whole, in runs of tokens; without training rows scores come from uniform
    starts; an empty table gives no rows; other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    learning = base.where(crc_part("doc_id", 5) != 1)
    counts = materialise(word_counts(learning), "word-counts")
    vocabulary, flat = train(learning, counts)
    scored = score(base, vocabulary, flat, counts)
    return scored.select(
        "doc_id", (crc_part("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(vocabulary.total).cast("long").alias("train_tokens"), "base_score", "score"
    )
