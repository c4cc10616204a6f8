"""Minimum-covariance-determinant estimates against numpy, group by group."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecube.llm import quality


def vectors(counts):
    """Transformed statistics of (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines), on the grid that sums are made on."""
    out = []
    for words, chars, symbols, dup, repeat, lines in counts:
        w, c, n = max(words, 1), max(chars, 1), max(lines, 1)
        x = (math.log1p(words), math.log(c / w), math.log1p(100 * symbols / c), math.log1p(10 * dup / n), math.log1p(10 * repeat / w))
        out.append([round(v * quality.STEPS) / quality.STEPS for v in x])
    return np.array(out)


def squared(x, mean, cov):
    off = x - mean
    return np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off)


def brute_mcd(x, prior=None, starts=40, seed=0):
    """(mean, covariance without floors, log-determinant) of the best core by concentration from many random starts."""
    rng, floor, best = np.random.default_rng(seed), np.diag(np.square(quality.FLOORS)), None
    core = math.ceil(quality.CORE_SHARE * len(x))

    def moments(rows):
        mean, cov = rows.mean(axis=0), np.cov(rows.T, bias=True).reshape(5, 5)
        if prior is None:
            return mean, cov
        share = len(rows) / (len(rows) + quality.PRIOR_ROWS)
        off = mean - prior[0]
        return mean - (1 - share) * off, share * cov + (1 - share) * prior[1] + share * (1 - share) * np.outer(off, off)

    for _ in range(starts):
        mean, cov = moments(x[rng.choice(len(x), min(6, len(x)), replace=False)])
        last = math.inf
        while True:
            near = np.argsort(squared(x, mean, cov + floor), kind="stable")[:core]
            mean, cov = moments(x[near])
            now = np.linalg.slogdet(cov + floor)[1]
            if now >= last - 1e-9:
                break
            last = now
        if best is None or now < best[2]:
            best = (mean, cov, now)
    return best


def scaled(x, mean, cov):
    d2 = squared(x, mean, cov + np.diag(np.square(quality.FLOORS)))
    return d2 / max(1.0, np.median(d2) / quality.CHI_MEDIAN)


def brute_distances(counts):
    """Distances of the rows of one language with one source; counts as base_counts() gives them, of texts of one line."""
    x = vectors([(*c, 1) for c in counts])
    lang = brute_mcd(x)
    own = brute_mcd(x, lang[:2])
    return scaled(x, *own[:2])


@pytest.fixture(scope="module")
def table(spark):
    """Two languages; sources of 300, 60, 8 and 1 rows, one in twelve of them junk."""
    rng = random.Random(3)
    rows = []
    for lang, size in (("en", 5), ("de", 9)):
        for source, count in (("big", 300), ("middle", 60), ("few", 8), ("one", 1), (None, 20)):
            for k in range(count):
                words = ["".join(rng.choices("abcdefghij", k=max(2, int(rng.gauss(size, 1.5))))) for _ in range(int(math.exp(rng.gauss(4.5, 0.6))) + 25)]
                rows.append((len(rows), (" | ## " if k % 12 == 5 else " ").join(words), lang, source))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), rows


def test_distances_match_numpy(spark, table):
    docs, rows = table
    stats = {r["doc_id"]: r for r in quality.text_statistics(docs).collect()}
    got = {r["doc_id"]: r for r in quality.quality_verdicts(docs).collect()}
    assert not any(r["base_failed"] for r in got.values())
    for lang in ("en", "de"):
        ids = [i for i, _, own, _ in rows if own == lang]
        x = vectors([[stats[i][c] for c in quality.STATISTICS] for i in ids])
        prior = brute_mcd(x)
        for source in ("big", "middle", "few", "one", None):
            mine = [k for k, i in enumerate(ids) if rows[i][3] == source]
            d2 = scaled(x[mine], *brute_mcd(x[mine], prior[:2])[:2])
            have = np.array([got[ids[k]]["distance"] for k in mine])
            assert np.all(np.abs(have - d2) <= 0.25 * d2 + 0.5), (lang, source)
            assert [got[ids[k]]["kept"] for k in mine] == [bool(d <= quality.CUTOFF) for d in d2]
    junk = [i for i, text, *_ in rows if "|" in text]
    assert not any(got[i]["kept"] for i in junk) and sum(r["kept"] for r in got.values()) == len(rows) - len(junk)


def test_determinants_are_as_small_as_those_of_many_starts(spark, table):
    docs, rows = table
    stats = quality.text_statistics(docs).where("lang = 'en'")
    found = quality._estimates(stats.select(F.lit("*").alias("grp"), *quality._vector()), None, "test").first()
    x = vectors([[r[c] for c in quality.STATISTICS] for r in stats.collect()])
    assert found["logdet"] <= brute_mcd(x)[2] + 0.02


def test_every_size_has_an_estimate_of_its_own(spark, table):
    """The same rows twice over have the same centre but for the prior's weight: nothing is switched on by a size."""
    docs, rows = table
    few = docs.where("source = 'few'")
    once = {r["doc_id"]: r["distance"] for r in quality.quality_verdicts(few).collect()}
    moved = few.union(docs.where("source = 'big'"))
    again = {r["doc_id"]: r["distance"] for r in quality.quality_verdicts(moved).collect()}
    assert all(d is not None for d in once.values()) and once.keys() <= again.keys()


def test_statistics_replace_columns_of_their_names(spark):
    docs = spark.createDataFrame([(1, "a b\nc", 99, "w", "t")], "doc_id long, text string, n_words int, words string, __text string")
    row = quality.text_statistics(docs).first()
    assert row["n_words"] == 3 and row["words"] == "w" and row["__text"] == "t"
