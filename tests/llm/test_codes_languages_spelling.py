"""Vector codes, language identification and spelling variants against brute force, on edge cases and on a small table."""

import collections
import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecube.llm import language_id, registry, spelling, vector_codes
from tidecube.llm.common import documents

DATA = os.environ.get("TIDECUBE_TEST_DATA", "/root/testdata/sf0.001")
ORDER = lambda r: tuple((x is None, str(x)) for x in r)


@pytest.mark.parametrize("name", ["op11_segment_means", "op13_pigeonhole_variants"])
def test_query_equals_its_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df = registry.queries()[name](spark, DATA)
    columns = ", ".join(sorted(df.columns))
    want = con.sql(f"SELECT {columns} FROM ({registry.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    assert got and sorted(got, key=ORDER) == sorted(want, key=ORDER)


# ---------------------------------------------------------------- vector codes


def codes_by_hand(rows, parts=16, entries=64, rounds=2):
    """rows of (vec_id, vector, label), ids set: ((vec_id, code, error), label sums, books)."""
    whole = sorted((i, [int(np.floor(np.float64(x) * 256)) for x in v], y) for i, v, y in rows)
    width = len(whole[0][1]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda x, book: min((far(x, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = collections.defaultdict(list)
            for c in cut:
                groups[best(c[p], books[p])[1]].append(c[p])
            books[p] = [tuple(sum(x) // len(groups[e]) for x in zip(*groups[e])) if e in groups else old for e, old in enumerate(books[p])]
    out, labels = [], collections.Counter()
    for (i, _, y), c in zip(whole, cut):
        found = [best(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
        labels[y] += out[-1][2]
    flat = [str(x) for book in books for c in book for x in c]
    return sorted((*o, labels[y]) for o, (_, _, y) in zip(out, whole)), hashlib.sha256(",".join(flat).encode()).hexdigest()


def vectors_of(spark, rows):
    schema = "vec_id long, embedding array<float>, label int, code string, error long, none string, key string, n long, vector string, entry long"
    return spark.createDataFrame([(*r, "c", 1, "x", "k", 3, "v", 4) for r in rows], schema)


@pytest.mark.parametrize("width", [1, 2, 3, 4, 8])
def test_codes_equal_brute_force(spark, width):
    rng = np.random.default_rng(width)
    plain = (rng.normal(size=(220, 16 * width)) * 0.2).astype(np.float32)
    plain[100:130] = plain[7]  # copies
    plain[130:160] = np.round(plain[130:160] * 2) / 2  # ties
    rows = [(int(i) * 3, v.tolist(), int(i) % 4 if i % 5 else None) for i, v in enumerate(plain)]
    bad = [(1, None, 1), (4, [float("nan")] * 16 * width, 1), (7, [None] * 16 * width, 2), (10, [float("inf")] * 16 * width, None), (13, [], 1), (16, [0.5] * (16 * width + 1), 1)]
    got = vector_codes.compress(vectors_of(spark, rows + bad).repartition(3)).collect()
    want, digest = codes_by_hand(rows)
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == want
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_codes_of_few_and_no_rows_and_large_values(spark):
    assert vector_codes.compress(vectors_of(spark, [(1, None, 1)])).collect() == []
    assert vector_codes.compress(vectors_of(spark, [(1, None, 1)]).limit(0)).collect() == []
    rows = [(None, [0.5] * 16, None), (None, [0.5] * 16, None), (2, [3e38] * 16, 1), (2, [-3e38] * 16, 1), (5, [0.25] * 16, 1)]
    got = vector_codes.compress(vectors_of(spark, rows)).collect()
    assert len(got) == 5 and all(r["error"] >= 0 and len(r["code"]) == 32 for r in got)
    # Both entries of 0.5 are equal, so all use the lower one, which stays what it is.
    assert {r["code"][:2] for r in got if r["vec_id"] is None} == {"03"}


@pytest.mark.parametrize("width", [1, 4, 6, 16])
def test_bounds_lose_no_nearest_entry(width):
    rng = np.random.default_rng(5)
    for scale in (3, 1000, vector_codes.largest_component(width * 16)):
        x, book = rng.integers(-scale, scale + 1, (700, width)), rng.integers(-scale, scale + 1, (64, width))
        book[9] = book[40]
        x[:50] = book[rng.integers(0, 64, 50)]
        far = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        at, least = vector_codes.nearest(x, book)
        assert (at == far.argmin(axis=1)).all() and (least == far.min(axis=1)).all()


def test_bounds_leave_most_entries_out():
    """The work of the exact step: far under all entries on rows that lie in groups."""
    rng = np.random.default_rng(6)
    book = rng.integers(-500, 500, (64, 8))
    x = vector_codes.Outline(book[rng.integers(0, 64, 3000)] + rng.integers(-20, 20, (3000, 8)))
    entries = vector_codes.Outline(book)
    low = vector_codes._bound(x, entries, len(x.sums) - 1, np.arange(3000)[:, None], np.arange(64)[None])
    far = ((x.vectors[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (low <= far).all() and (low <= far.min(axis=1)[:, None]).mean() < 0.25


def test_decoded_vectors_are_as_far_as_the_error(spark):
    whole = vector_codes.integer_vectors(spark.read.parquet(f"{DATA}/embeddings.parquet"))
    books = vector_codes.train_codebooks(whole)
    both = vector_codes.decoded(vector_codes.vector_codes(whole, books), books).join(whole.select("vec_id", F.col("vector").alias("own")), "vec_id")
    rows = both.collect()
    assert rows and all(sum((a - b) ** 2 for a, b in zip(r["vector"], r["own"])) == r["error"] for r in rows)


# ------------------------------------------------------ language identification


def test_languages_of_edge_cases(spark, edge_docs, no_docs):
    assert language_id.held_out_languages(no_docs).collect() == []
    for name in ("__id", "place", "at", "lang_pred", "score"):
        edge_docs = edge_docs.withColumn(name, F.lit("z"))
    got = language_id.held_out_languages(edge_docs).collect()
    texts = [(r["doc_id"], r["text"]) for r in edge_docs.select("doc_id", "text").collect()]
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in texts)
    none = collections.Counter(str(i) for i, t in texts if t is None or not any(c.isalpha() for c in t))
    assert collections.Counter(str(r["doc_id"]) for r in got if r["lang_pred"] == "und") == none
    assert all(r["score"] == (0 if r["lang_pred"] == "und" else 1) for r in got)  # one language only
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 4 == 2) for r in got)
    unlabelled = language_id.held_out_languages(edge_docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}


def test_languages_are_found_and_do_not_depend_on_partitions(spark):
    docs = documents(spark, DATA)
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    first = {r["doc_id"]: r for r in language_id.held_out_languages(docs).collect()}
    held = [r for r in first.values() if r["held_out"]]
    assert len(held) > 20 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 < r["score"] <= 1 for r in held)
    again = {r["doc_id"]: r for r in language_id.held_out_languages(docs.repartition(7)).collect()}
    assert all(again[k]["lang_pred"] == r["lang_pred"] and again[k]["score"] == pytest.approx(r["score"]) for k, r in first.items())


def test_weights_are_sparse_and_the_sample_bounded(spark):
    model = language_id.train(documents(spark, DATA))
    assert 0 < len(model.at) < 0.2 * (1 << language_id.FEATURE_BITS) and (model.weights == 0).mean() > 0.02
    small = language_id.train(documents(spark, DATA), max_train=40)
    assert 0 < len(small.at) < len(model.at) and len(small.languages) == len(model.languages)
    assert np.allclose(small.idf, model.idf)  # statistics count every row


def test_long_texts_are_counted_as_short_ones(monkeypatch):
    text = "Ünder the Sea, où été 漢字 naïve éa 12 x"
    whole = language_id.term_counts(text * 20)
    monkeypatch.setattr(language_id, "SEGMENT", 50)
    parts = language_id.term_counts(text * 20)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    assert bytes(language_id.plain_codes("A1b, C!").astype(np.uint8)) == b" a b c "
    assert len(language_id.plain_codes("12 .́")) == 0


def test_temperature_cools_or_heats():
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 3, 4000)
    logits = rng.normal(size=(4000, 3))
    logits[np.arange(4000), labels] += 1.0  # logits whose posterior is that of temperature 1
    assert language_id.temperature(logits, labels) == pytest.approx(1, abs=0.1)
    assert language_id.temperature(logits * 4, labels) == pytest.approx(4, abs=0.4)
    assert language_id.temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1


# ------------------------------------------------------------ spelling variants


def variants_by_hand(rows):
    import re

    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    alphabet = sorted({c for w in words for c in w})

    def near(w):
        edits = {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in alphabet}
        return ((edits | {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in alphabet}) - {w}) & set(words)

    found, forms = {w: near(w) for w in words}, {}
    for w, others in found.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        forms[w] = best if best and words[best] >= 5 * words[w] else None

    def root(w):
        return root(forms[w]) if forms[w] else w

    return sorted((w, forms[w], root(w), n, len(found[w]), words[forms[w]] if forms[w] else None) for w, n in words.items())


def variant_rows(spark, rows):
    docs = spark.createDataFrame([(i, t, "a", "b", "c", 1, 2) for i, t in rows], "doc_id long, text string, word string, run string, id string, n long, h long")
    got = spelling.spelling_variants(docs.repartition(3))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in got.collect()), key=lambda r: r[0])


def test_variants_equal_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abéÀ") for _ in range(rng.randrange(6, 11))) for _ in range(120)]
    words = ["chainsa"] * 8 + ["chainsab"] * 60 + ["chainsabc"] * 400
    for w in base:
        words += [w] * rng.choice([1, 5, 30, 200])
        k = rng.randrange(len(w))
        words += [w[:k] + rng.choice("abc") + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + "x" + w[k:]] * rng.choice([4, 5, 7])
    rng.shuffle(words)
    rows = [(i if i % 50 else None, " ".join(rng.choice([w, w.upper(), w.title()]) for w in words[i * 20 : i * 20 + 20])) for i in range(len(words) // 20)]
    rows += [(9, None), (10, ""), (11, "1234 -- \n"), (None, None), *rows[:7]]
    want = variants_by_hand(rows)
    assert any(r[1] and r[1] != r[2] for r in want) and any(r[1] is None and r[4] for r in want)
    assert variant_rows(spark, rows) == want


def test_words_of_one_segment_and_very_long_words(spark):
    """Many words that share their first half, chains of forms, and a run of 200 000 letters."""
    words = {f"common{a}{b}": 5 + 31 * (a == b) for a in "abcdefgh" for b in "abcdefgh"} | {"chainsa": 5, "chainsab": 25, "chainsabc": 125, "z" * 200_000: 5, "z" * 199_999: 25}
    rows = [(i, " ".join(w for w, n in words.items() if n > i)) for i in range(125)]
    got = variant_rows(spark, rows)
    short = [r for r in got if len(r[0]) < 100]
    assert short == [r for r in variants_by_hand([(i, t.replace("z" * 199_999, " ").replace("z", " ")) for i, t in rows])]
    assert {len(r[0]): r[2] and len(r[2]) for r in got if len(r[0]) > 100} == {200_000: 199_999, 199_999: 199_999}


def test_long_words_are_compared_like_short_ones(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for _ in range(400):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(6, 14)))
        k = rng.randrange(len(a) + 1)
        b = rng.choice([a[:k] + "c" + a[k:], a[:k] + rng.choice("abé") + a[k + 1 :], "".join(rng.sample(a, len(a))), a[:k] + "ca" + a[k + 1 :]])
        if a != b and 0 <= len(b) - len(a) <= 1:
            rows.append((a, b))
    pairs = spark.createDataFrame(rows, "a string, b string")
    sizes = [F.length("a"), F.length("b")]
    by_table = [r[0] for r in pairs.select(spelling._one_edit(F.col("a"), F.col("b"), *sizes)).collect()]
    monkeypatch.setattr(spelling, "SHORT", 0)
    assert [r[0] for r in pairs.select(spelling._one_edit(F.col("a"), F.col("b"), *sizes)).collect()] == by_table
    assert 20 < sum(by_table) < len(rows) - 20


def test_variants_of_edge_cases(spark, edge_docs, no_docs):
    assert spelling.spelling_variants(no_docs).collect() == []
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in spelling.spelling_variants(edge_docs).collect()), key=lambda r: r[0]) == variants_by_hand(rows)
