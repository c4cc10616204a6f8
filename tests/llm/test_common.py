import random

import numpy as np
import pytest

from tidecube.llm.common import connected_components, shingles, word_hashes


def brute_components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("kind", ["chain", "random", "star", "empty"])
def test_components_match_union_find(spark, kind):
    rng = random.Random(5)
    if kind == "chain":
        edges = [(i, i + 1) for i in range(60)] + [(200, 100), (100, 200)]
    elif kind == "random":
        edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(90)]
        edges = [(a, b) for a, b in edges if a != b]
    elif kind == "star":
        edges = [(500, i) for i in range(80)]
    else:
        edges = []
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == brute_components(edges)


def test_components_ignore_self_links_and_nulls(spark):
    got = connected_components(spark.createDataFrame([(1, 1), (None, 2), (3, 4)], "a long, b long")).collect()
    assert sorted((r["node"], r["component"]) for r in got) == [(3, 3), (4, 3)]


def test_word_hashes_follow_words_not_white_space():
    texts = [b"a b  c", b"", b" a\tb\nc ", b"abc", b"b a c"]
    found = [w.tolist() for _, words in word_hashes(texts) for w in words]
    assert found[0] == found[2] and len(found[0]) == 3
    assert found[1] == [] and len(found[3]) == 1
    assert sorted(found[4]) == sorted(found[0]) and found[4] != found[0]


def test_long_texts_are_cut_only_at_white_space():
    words = [b"w%d" % (i % 977) for i in range(400_000)]
    text = b" ".join(words)
    (_, [whole]), *_ = list(word_hashes([text]))
    assert len(whole) == len(words)
    small = {w: h[0][0] for w in set(words) for _, h in word_hashes([w])}
    assert whole.tolist() == [int(small[w]) for w in words]


def test_shingles_of_short_texts_are_one_sequence():
    [(_, [words])] = list(word_hashes([b"one two three"]))
    assert len(shingles(words, 5)) == 1
    assert len(shingles(words, 3)) == 1
    assert len(shingles(words, 2)) == 2
    assert len(shingles(np.empty(0, np.uint64), 4)) == 0
