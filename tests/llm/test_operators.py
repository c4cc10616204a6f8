"""Each operator against a brute-force version, on edge cases and on a small table."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidecube.llm import common as common_module
from tidecube.llm import exact_dedup, language_model, line_dedup, near_dedup, packing, quality, secret_scan, segmentation, sharding, toxicity
from tidecube.llm.registry import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES, VOCABULARY = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("byte_bpe_50k.json")


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def prose(spark, count=160, seed=1):
    """Random prose with exact copies, near copies and shared lines."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    texts = []
    for i in range(count):
        if texts and rng.random() < 0.2:
            texts.append(rng.choice(texts))
        elif texts and rng.random() < 0.4:
            own = rng.choice(texts).split(" ")
            for _ in range(rng.randrange(1, 4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
        else:
            texts.append("\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(5, 30))) for _ in range(rng.randrange(1, 5))))
    return spark.createDataFrame([(i, t, rng.choice(["en", "de"]), "src") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("max_hot", [2048, 4])
def test_exact_duplicates(spark, edge_docs, max_hot):
    for docs in (edge_docs, prose(spark)):
        have = rows_of(docs)
        normal = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in have]
        groups = collections.defaultdict(list)
        for (i, _), t in zip(have, normal):
            groups[t].append(i)
        low = lambda ids: min(ids, key=lambda x: (x is None, x or 0))
        want = sorted((str(i), str(low(groups[t])), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(have, normal))
        got = exact_dedup.exact_duplicates(docs, max_hot=max_hot).collect()
        assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == want
        assert sum(r["kept"] for r in got) == len(groups)


def test_exact_duplicates_keep_one_row_each(spark):
    docs = prose(spark)
    got = exact_dedup.exact_duplicates(docs).collect()
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
    assert exact_dedup.drop_exact_duplicates(docs).columns == docs.columns


def word_set(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, edge_docs, width):
    for docs in (edge_docs.where("doc_id IS NOT NULL"), prose(spark)):
        sets = {i: word_set(t, width) for i, t in rows_of(docs)}
        links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        want = components(sets, links)
        got = near_dedup.near_duplicates(docs, width=width).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), want[i], i == want[i]) for i in sets}


def test_near_duplicates_with_a_null_id(edge_docs):
    got = [r for r in near_dedup.near_duplicates(edge_docs).collect() if r["doc_id"] is None]
    assert [(r["component_id"], r["kept"]) for r in got] == [(0, False)]
    got = near_dedup.near_duplicates(edge_docs.where("doc_id IS NULL")).collect()
    assert [(r["component_id"], r["kept"]) for r in got] == [(None, True)]


def test_near_duplicates_compare_rows_that_repeat_an_id_by_their_own_texts(spark):
    words = [f"w{i}" for i in range(40)]
    one, other = " ".join(words), " ".join(reversed(words))
    docs = spark.createDataFrame([(5, one), (5, other), (9, other), (2, one + " more"), (7, "alone with these words")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect())
    assert got == [(2, 2), (5, 2), (5, 5), (7, 7), (9, 5)]
    kept = sorted((r["doc_id"], r["text"]) for r in near_dedup.drop_near_duplicates(docs).collect())
    assert kept == [(2, one + " more"), (5, other), (7, "alone with these words")]


@pytest.mark.parametrize("common", [8, 1])
def test_blocks_and_common_keys_give_the_same_components(spark, monkeypatch, common):
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 3)
    monkeypatch.setattr(near_dedup, "SAMPLE", 64 if common == 8 else 1.0)
    monkeypatch.setattr(near_dedup, "COMMON", common)
    monkeypatch.setattr(common_module, "HOT_ROWS", 512 if common == 8 else 2)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(40):
        own = list(base)
        for _ in range(rng.randrange(0, 5)):
            own[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {i: word_set(t, 4) for i, t in enumerate(texts)}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = near_dedup.near_duplicates(docs, width=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == components(sets, links)


def test_packed_bits_estimate_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    low = near_dedup.minima([a, b])
    agree = np.mean((low[0] & 15) == (low[1] & 15))
    assert (agree - 1 / 16) / (15 / 16) == pytest.approx(0.6, abs=0.12)


def base_counts(text):
    words = WORD.findall(text or "")
    seen = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {p for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_base_and_verdicts(spark, edge_docs):
    rng = random.Random(2)
    clean = [" ".join(rng.choice(["sea", "water", "salt", "wave", "wind", "tide", "shore"]) + str(rng.randrange(50)) for _ in range(rng.randrange(60, 300))) for _ in range(400)]
    junk = [c.replace(" ", " | ") for c in clean[:12]]
    docs = spark.createDataFrame([(1000 + i, t, "en", "a") for i, t in enumerate(clean + junk)], "doc_id long, text string, lang string, source string")
    for table in (edge_docs, docs):
        texts = rows_of(table)
        got = quality.quality_verdicts(table).collect()
        assert len(got) == len(texts)
        want = collections.Counter((str(i), *base_counts(t)) for i, t in texts)
        assert collections.Counter((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
        assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in got)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert all(kept[1000 + i] for i in range(400)) and not any(kept[1400 + i] for i in range(12))


def test_secrets(spark, edge_docs):
    tricky = spark.createDataFrame([(50, "password:secret:abcdefghijkl token='abcdefghijklmnop' API_KEY=\"0123456789abcdef\""), (51, "é AKIA" + "A" * 14 + " ghp_16C7e42F292c6912E7710c838347Ae178B4a x"),
                                    (52, "getUserNameFromRequest2 max_buffer_size_1024_limit"), (53, "secret: token=abcdefghijklmn" * 3)], "doc_id long, text string")
    kinds = [(re.compile(secret_scan.ASSIGN), 12, 2), (re.compile(secret_scan.ACCESS), 18, 0), (re.compile(secret_scan.HEX), 16, 0)]
    for docs in (edge_docs, tricky):
        want = collections.Counter()
        for i, text in rows_of(docs):
            spans = sorted((m.start(), k, m.end()) for k, (p, least, group) in enumerate(kinds) for m in p.finditer(text or "") if len(m[group]) >= least)
            digest = hashlib.sha256(",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
            want[str(i), *(sum(s[1] == k for s in spans) for k in range(3)), digest] += 1
        got = secret_scan.secret_report(docs).collect()
        assert collections.Counter((str(r["doc_id"]), r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == want
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[51]["n_markov"] == 1 and by_id[52]["n_markov"] == 0
    masked = {r["doc_id"]: r["text"] for r in secret_scan.mask_secrets(tricky).collect()}
    assert masked[51] == "é [SECRET] [SECRET] x" and masked[52] == "getUserNameFromRequest2 max_buffer_size_1024_limit"


def test_models_tell_random_strings_from_identifiers(spark):
    table = secret_scan.train(secret_scan.labelled_samples(spark, 1000))
    move = str.maketrans(secret_scan._FROM, secret_scan._TO)

    def ratio(t):
        code = [ord(c) - secret_scan.FIRST for c in t.translate(move)]
        return sum(table[a * secret_scan.RANGE + b] for a, b in zip(code, code[1:]))

    rng = random.Random(9)
    strings = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(32)) for _ in range(200)]
    names = ["_".join(rng.choice(secret_scan.WORDS) for _ in range(4)) + str(rng.randrange(100)) for _ in range(200)]
    assert sum(ratio(s) > 12 for s in strings) > 190 and sum(ratio(s) > 12 for s in names) == 0


@pytest.mark.parametrize("shards", [24, 3])
def test_sharding(spark, edge_docs, shards):
    for docs in (edge_docs, prose(spark, 500)):
        have = collections.Counter((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows_of(docs))
        got = sharding.assign_shards(docs, shards).collect()
        assert collections.Counter((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == have
        loads = collections.defaultdict(list)
        for r in got:
            loads[r["shard"]].append(r["slot"])
        counts = [len(loads[s]) for s in range(shards)]
        assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in loads.values())


def test_ring_walk_matches_a_row_by_row_walk():
    rng = random.Random(1)
    nodes = sharding.ring(5, 8)
    counts = {a: rng.randrange(0, 40) for a in range(len(nodes))}
    plan = sharding.bounded_plan(nodes, counts, 5)
    total = sum(counts.values())
    room = [total // 5 + (s < total % 5) for s in range(5)]
    where, used, late = {}, [0] * 5, []
    for arc, (_, shard) in enumerate(nodes):
        for rank in range(counts[arc]):
            if used[shard] < room[shard]:
                where[arc, rank], used[shard] = shard, used[shard] + 1
            else:
                late.append((arc, rank))
    for arc, rank in late:
        at = arc
        while used[nodes[at][1]] >= room[nodes[at][1]]:
            at = (at + 1) % len(nodes)
        where[arc, rank] = nodes[at][1]
        used[nodes[at][1]] += 1
    assert where == {(arc, rank): shard for arc, lo, hi, shard, _ in plan for rank in range(lo, hi)}


def test_ring_moves_little_when_a_shard_is_added():
    few, many = dict(sharding.ring(24)), dict(sharding.ring(25))
    assert all(many[p] == s for p, s in few.items() if p in many)


def test_lines(spark, edge_docs):
    for docs in (edge_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), prose(spark)):
        first, total, occurrences = {}, collections.Counter(), []
        for i, text in sorted(rows_of(docs)):
            for n, line in enumerate((text or "").encode().split(b"\n")):
                plain = line_dedup.normal_line(line)
                if plain:
                    occurrences.append((i, n, plain))
                    total[i] += 1
        lines = sorted({p for *_, p in occurrences})
        sets = [frozenset(p[k : k + 8] for k in range(max(1, len(p) - 7))) for p in lines]
        links = [(a, b) for a, b in itertools.combinations(range(len(lines)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        group = dict(zip(lines, components(range(len(lines)), links).values()))
        removed = collections.defaultdict(list)
        for i, n, plain in occurrences:
            if first.setdefault(group[plain], (i, n)) != (i, n):
                removed[i].append(n)
        got = line_dedup.line_report(docs).collect()
        assert {r["doc_id"]: (r["n_lines"], r["n_kept"], r["removed"]) for r in got} == {
            i: (total[i], total[i] - len(removed[i]), ",".join(map(str, removed[i]))) for i, _ in rows_of(docs)
        }


def signed_lines(lines):
    """Rows of the line signatures, one for each of the lines (which differ)."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lines)), pa.int64()), pa.array(range(len(lines)), pa.int64()), pa.array([x.decode() for x in lines])], names=["row", "doc_id", "text"])
    return [r for out in line_dedup._signed_lines(iter([batch])) for r in out.to_pylist()]


def test_bands_find_long_lines_at_the_threshold():
    rng = random.Random(7)
    word = lambda n: bytes(rng.choices(b"abcdefghijklmnopqrstuvwxyz0123456789", k=n))
    lines = []
    for _ in range(3000):  # 172 of 214 shingles in common
        head = word(179)
        lines += [head + word(21), head + word(21)]
    sets = line_dedup.line_sets(lines[:2])
    assert 0.8 <= len(np.intersect1d(*sets)) / len(np.union1d(*sets)) < 0.81
    bands = [set(r["bands"]) for r in signed_lines(lines)]
    assert all(a & b for a, b in zip(bands[::2], bands[1::2]))


def test_short_lines_with_a_word_in_common_do_not_meet():
    """One of twelve bytes, of shingles of eight: lines that are otherwise unlike share hardly a key, whatever their length."""
    rng = random.Random(3)
    for size in (45, 70, 110, 150):
        lines = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=size - 12)).encode() for _ in range(1500)]
        at = [rng.randrange(1, size - 13) for _ in lines]
        keys = [r["bands"] for r in signed_lines([x[:k] + b" government " + x[k:] for x, k in zip(lines, at)])]
        held = collections.Counter(key for own in keys for key in set(own))
        assert sum(n for n in held.values() if n > 1) < 0.01 * sum(held.values()), size


def test_lines_on_both_sides_of_short_meet():
    """Bounds of the number of shingles send lines that may be linked to keys of one kind, also where shingles repeat."""
    rng = random.Random(9)
    word = lambda n: bytes(rng.choices(b"abcdefghijklmnopqrstuvwxyz0123456789", k=n))
    lines = []
    for head in range(100, 180, 2):
        line, again = word(head), word(9) * 40
        lines += [line, line + word((head - 7) // 4), again + line, again + line + word((head - 7) // 4)]
    sizes = [len(x) for x in line_dedup.line_sets(lines)]
    assert any(a <= line_dedup.SHORT < b for a, b in zip(sizes[::2], sizes[1::2]))
    assert all(least <= size for least, size in zip(line_dedup.least_sizes(lines), sizes))
    bands = [set(r["bands"]) for r in signed_lines(lines)]
    assert all(a & b for a, b in zip(bands[::2], bands[1::2]))


@pytest.mark.parametrize("size", [5, 20_000])
def test_keys_in_passes_are_those_of_one(spark, size):
    reps = spark.range(size).select(F.col("id").alias("node"), F.array(F.xxhash64(F.col("id") % 7), F.xxhash64(F.lit(1), F.col("id") % 900), F.xxhash64("id")).alias("bands"))
    before = spark.conf.get(common_module.CLEANUP, None)
    one, several = (sorted(near_dedup._crowded(reps, passes).distinct().collect()) for passes in (1, 3))
    assert one == several and (len(one) > 0) == (size > 5) and spark.conf.get(common_module.CLEANUP, None) == before


def test_short_lines_at_the_threshold_are_linked(spark):
    rng = random.Random(11)
    rows = []
    for union in (5, 10, 15, 20, 25, 40):
        for _ in range(200):  # 8 of every 10 shingles in common
            line = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=union + 7))
            rows += [line, line[: union * 4 // 5 + 7]]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = {r["doc_id"]: r["n_kept"] for r in line_dedup.line_report(docs).collect()}
    assert [k for k in kept if kept[k] != 1 - k % 2] == []


def test_lines_near_the_threshold_are_found(spark):
    """Pairs of a line and the same with some bytes appended, by length: at least 0.98 of those at the threshold end in one component."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
    classes, rows = [(11, 1), (15, 2), (19, 3), (30, 5), (40, 8), (60, 13), (120, 28)], []
    for head, tail in classes:
        for _ in range(400):
            line = text(head)
            rows += [line, line + text(tail)]
        a, b = line_dedup.line_sets([rows[-2].encode(), rows[-1].encode()])
        assert 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r["doc_id"]: r["component"] for r in line_dedup.line_components(docs).collect()}
    for n, size in enumerate(classes):
        assert sum(found[k] == found[k + 1] for k in range(800 * n, 800 * n + 800, 2)) >= 0.98 * 400, size


def test_lines_of_rows_that_repeat_an_id(spark):
    docs = spark.createDataFrame([(1, "a line that comes twice\nown words of one"), (1, "a line that comes twice\nother words of one"), (None, "a line that comes twice")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_kept"]) for r in line_dedup.line_report(docs).collect()) == [("1", 2, 1), ("1", 2, 2), ("None", 1, 0)]
    left = sorted(r["text"] for r in line_dedup.drop_repeated_lines(docs).collect())
    assert len(left) == 3 and "".join(left).count("comes twice") == 1


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_exact_keys_meet_at_the_threshold(percent):
    rng = np.random.default_rng(percent)
    for _ in range(300):
        pool = rng.integers(0, 2**63, 60).astype(np.uint64)
        shared, left, right = rng.integers(1, 20), rng.integers(0, 6), rng.integers(0, 6)
        if 100 * shared < percent * (shared + left + right):
            continue
        sets = pool[: shared + left], np.concatenate([pool[:shared], pool[40 : 40 + right]])
        a, b = (set(line_dedup.exact_keys(np.sort(s)[None], percent)[0].tolist()) for s in sets)
        assert a & b


def test_lines_of_negative_ids(spark):
    docs = spark.createDataFrame([(-5, "a line that comes twice\nown words of one"), (3, "a line that comes twice")], "doc_id long, text string")
    assert {r["doc_id"]: r["removed"] for r in line_dedup.line_report(docs).collect()} == {-5: "", 3: "0"}


def test_dropping_lines_changes_the_text(spark):
    docs = spark.createDataFrame([(1, "keep this line whole\nother words stand here", 5), (2, "Keep this  line whole\nfresh content follows", 6), (3, None, 7)], "doc_id long, text string, line int")
    out = {r["doc_id"]: (r["text"], r["line"]) for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert out == {1: ("keep this line whole\nother words stand here", 5), 2: ("fresh content follows", 6), 3: (None, 7)}


def test_segmentations_are_lossless_and_repeatable(edge_docs):
    docs = edge_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    coded = segmentation.encode(docs, PIECES, seed=3)
    ids = {r["doc_id"]: r["ids"] for r in coded.collect()}
    assert ids == {r["doc_id"]: r["ids"] for r in segmentation.encode(docs.repartition(5), PIECES, seed=3).collect()}
    back = {r["doc_id"]: r["text"] for r in segmentation.decode_ids(coded, PIECES).collect()}
    assert back == {i: t or "" for i, t in rows_of(docs)}
    other = {r["doc_id"]: r["ids"] for r in segmentation.encode(docs, PIECES, seed=4).collect()}
    assert other[6] != ids[6]
    assert all(r["lossless"] for r in segmentation.encode_digest(edge_docs, PIECES).collect())


def test_a_very_long_word_is_lossless(spark):
    docs = spark.createDataFrame([(1, "abcdefghij" * 4000 + "é"), (2, "▁" * 3000)], "doc_id long, text string")
    assert all(r["lossless"] and r["n_pieces"] > 0 for r in segmentation.encode_digest(docs, PIECES).collect())


def test_sampled_segmentations_follow_the_lattice():
    import sentencepiece

    model, pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES), segmentation.Pieces(PIECES)
    known = {model.id_to_piece(i): i for i in range(259, model.get_piece_size())}

    def ways(text):
        if not text:
            yield ()
        for k in range(1, len(text) + 1):
            if text[:k] in known:
                for rest in ways(text[k:]):
                    yield (known[text[:k]], *rest)

    weight = {w: math.exp(sum(pieces.logp[i] for i in w)) for w in ways("▁then")}
    count, total = 8000, sum(weight.values())
    drawn = collections.Counter(tuple(x.tolist()) for x in segmentation.sample_texts(["then"] * count, np.arange(count), pieces, 1))
    assert set(drawn) <= set(weight)
    assert max(abs(drawn[w] / count - weight[w] / total) for w in weight) < 0.03


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(7)
    words = [f"word{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(900):
        own = [rng.choice(words) for _ in range(40)]
        bad = rng.random() < 0.25
        if bad:
            own[rng.randrange(40)] = rng.choice(["nastyish", "nastyly", "vileness"])
        rows.append((i, " ".join(own)))
        marks.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.held_out_scores(docs, spark.createDataFrame(marks, "doc_id long, toxic int")).collect()}
    held = [(got[i]["predicted"], t) for i, t in marks if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert sum(p == t for p, t in held) / len(held) > 0.95
    assert got[900]["score"] == got[901]["score"] and all(0 <= r["score"] <= 1 for r in got.values())


def test_toxicity_on_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    assert len(toxicity.held_out_scores(edge_docs, labels).collect()) == edge_docs.count()
    assert toxicity.held_out_scores(edge_docs, labels.where("toxic > 5")).select("score").distinct().collect()[0][0] == 0.5
    assert toxicity.held_out_scores(no_docs, labels).count() == 0


def test_language_model(spark, edge_docs):
    for docs in (edge_docs, prose(spark)):
        texts = rows_of(docs)
        tokens = [((t or "").encode().lower().split() + [None], "" if i is None else str(i)) for i, t in texts]
        count = collections.Counter(w for ws, i in tokens if zlib.crc32(i.encode()) % 5 != 1 for w in ws)
        total, types = sum(count.values()), len(count)
        base = lambda ws: sum(math.log10((count[w] + 0.5) / (total + 0.5 * (types + 1))) for w in ws)
        want = sorted((i, len(ws), sum(count[w] > 0 for w in ws), round(base(ws), 4)) for ws, i in tokens)
        got = language_model.held_out_scores(docs).collect()
        assert sorted(("" if r["doc_id"] is None else str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want
        assert all(r["train_tokens"] == total and r["score"] < 0 for r in got)


def test_rare_words_are_joined(spark, monkeypatch):
    docs = prose(spark)
    want = {r["doc_id"]: (r["n_known"], round(r["base_score"], 6)) for r in language_model.held_out_scores(docs).collect()}
    monkeypatch.setattr(language_model, "LOOKUP", 40)
    got = {r["doc_id"]: (r["n_known"], round(r["base_score"], 6)) for r in language_model.held_out_scores(docs).collect()}
    assert got == want


def test_probabilities_add_up_to_one():
    known = np.arange(language_model.VOCABULARY)[::-1].astype(float)
    model = language_model.LogBilinear(known)
    rng = np.random.default_rng(3)
    context = rng.integers(0, language_model.VOCABULARY, (language_model.CONTEXT, 1)).repeat(language_model.VOCABULARY, axis=1)
    model.learn(context[:, :64], rng.integers(0, language_model.VOCABULARY, 64))
    assert (10.0 ** model.log10(context, np.arange(language_model.VOCABULARY))).sum() == pytest.approx(1, abs=1e-4)


def test_training_beats_the_start():
    rng = np.random.default_rng(0)
    size = 40_000
    out = (np.arange(size) * 7 % 50 + rng.integers(0, 3, size)).astype(np.int64)
    known = np.bincount(out, minlength=language_model.VOCABULARY).astype(float)
    context = language_model._contexts(out.astype(np.int32), np.array([size]))
    model = language_model.LogBilinear(known)
    before = model.log10(context[:, -2000:], out[-2000:]).mean()
    for _ in range(5):
        for at in range(0, size, 2000):
            model.learn(context[:, at : at + 2000], out[at : at + 2000])
    assert model.log10(context[:, -2000:], out[-2000:]).mean() > before + 0.2


def test_empty_tables(no_docs):
    assert exact_dedup.exact_duplicates(no_docs).count() == 0
    assert near_dedup.near_duplicates(no_docs).count() == 0
    assert quality.quality_verdicts(no_docs).count() == 0
    assert secret_scan.secret_report(no_docs).count() == 0
    assert sharding.assign_shards(no_docs).count() == 0
    assert line_dedup.line_report(no_docs).count() == 0
    assert segmentation.encode_digest(no_docs, PIECES).count() == 0
    assert language_model.held_out_scores(no_docs).count() == 0
    assert packing.pack_documents(no_docs, VOCABULARY).count() == 0
