import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidecube.llm import packing
from tidecube.llm.registry import tokenizer_path

PATH, RANKS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken")
TEXTS = [
    "", " ", "\n\n", "a <|endoftext|> b", "a  b", "don't we'll I'M", "tab\t\tend  ", "nbsp  \n\nx", "<|endoftext|> is text", "日本語 text ١٢٣", "\x1c\x1d a", "naïve café ÿ ²³ ª",
    "x" * 5000, "# $ %% && ||", "a b", "̀ combining", "   lead",
]


def plain_ids(text):
    """The contract's call, on a tokenizer as it is loaded."""
    return np.array(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_those_of_the_plain_call(text):
    assert packing.encode(text, PATH, RANKS) == plain_ids(text) == packing.encode(text, PATH)


def test_an_added_token_in_a_text_is_one_id():
    ids = np.frombuffer(packing.encode("a <|endoftext|> b", PATH, RANKS), "<u4").tolist()
    assert ids == Tokenizer.from_file(PATH).encode("a <|endoftext|> b", add_special_tokens=False).ids and 50256 in ids


def test_ids_of_whole_tables(spark):
    reference = Tokenizer.from_file(PATH)
    for table, column in (("documents", "text"), ("pages", "html"), ("conversations", "text")):
        texts = [r[0] or "" for r in spark.read.parquet(f"/root/testdata/sf0.01/{table}.parquet").select(column).collect()]
        for text, want in zip(texts, reference.encode_batch(texts, add_special_tokens=False)):
            assert packing.encode(text, PATH, RANKS) == np.array(want.ids, "<u4").tobytes()


@given(st.text(st.characters(max_codepoint=0x300) | st.sampled_from("'  \n\t0a"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_ids_of_any_text(text):
    assert packing.encode(text, PATH, RANKS) == packing.encode(text, PATH)


def test_pieces_and_places(spark):
    rng = random.Random(3)
    texts = [None, *TEXTS, *(" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(1, 3000))) for _ in range(60))]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    rows = packing.pack_documents(docs, PATH, RANKS).collect()
    bins, total = {}, 0
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, text in enumerate(texts):
        ids = packing.encode(text or "", PATH, RANKS) + np.array([2], "<u4").tobytes()
        total += len(ids) // 4
        at = 0
        for n, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (n, at) and r["length"] <= 1024 and (n == 0 or r["length"] == 1024)
            assert r["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert at == len(ids) // 4 and (at > 1024 or len(by_doc[i]) == 1)
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert len(bins) <= -(-total // 1024) + 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs, PATH).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_local_search_raises_squared_fill_and_keeps_items(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(200, 700, 60)
    bins = packing.best_fit(lengths, 1024)
    fills = [lengths[b].sum() for b in bins]
    better = packing.local_search([list(b) for b in bins], lengths, 1024)
    after = [lengths[b].sum() for b in better]
    assert sorted(i for b in better for i in b) == list(range(60))
    assert max(after) <= 1024 and len(better) <= len(bins)
    assert sum(f * f for f in after) >= sum(f * f for f in fills)


@pytest.mark.parametrize("low, high", [(560, 700), (250, 520), (330, 350), (1, 1024)])
def test_local_search_is_bounded_on_a_whole_block(low, high):
    lengths = np.random.default_rng(1).integers(low, high + 1, packing.BLOCK_PIECES)
    bins = packing.best_fit(lengths, 1024)
    began = time.perf_counter()
    better = packing.local_search([list(b) for b in bins], lengths, 1024)
    assert time.perf_counter() - began < 60
    assert len(better) <= len(bins) and sorted(i for b in better for i in b) == list(range(len(lengths)))


def test_rows_of_one_id_are_dealt_over_blocks(spark):
    pieces = spark.range(4000).selectExpr("CAST(NULL AS long) AS doc_id", "0 AS piece", "300L AS length", "'a' AS block", "'b' AS number")
    packed = packing.pack(pieces, block_pieces=500).collect()
    assert len(packed) == 4000 and len({r["sequence_id"] >> 24 for r in packed}) == 8
    assert {r["block"] for r in packed} == {"a"} and {r["number"] for r in packed} == {"b"}


def test_exchange_empties_a_bin():
    lengths = np.array([6, 4, 3, 3, 2, 2])
    better = packing.local_search([[0, 2], [1, 3], [4, 5]], lengths, 10)
    assert len(better) == 2
