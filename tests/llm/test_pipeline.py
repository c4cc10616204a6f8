"""The staged pipeline against brute-force versions of its stages."""

import itertools
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tidecube.llm import quality, secret_scan
from tidecube.llm.common import is_written
from tidecube.llm.registry import queries

from .test_operators import base_counts, components, word_set
from .test_quality import brute_distances


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    fresh = lambda n: [rng.choice(words) for _ in range(n)]
    texts = [" ".join(fresh(rng.randrange(30, 120))) for _ in range(260)]
    texts += [texts[3], texts[3].replace(" ", "  ", 2), texts[4]]
    near = texts[7].split(" ")
    near[2] = "changed"
    texts += [" ".join(near), "too short", None, "", " ".join(["same words come again and again here now"] * 20)]
    texts += [" | # ".join(fresh(60)) + " $", " ".join(w * 3 for w in fresh(80))]
    texts += [texts[9] + " password = " + "A1b2C3d4E5f6G7h8", " ".join(fresh(40)) + " AKIA" + "ABCD1234EFGH5678"]
    rows = [(i, t, "en", "src", len(t) if t else 0, "x") for i, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(str(path / "documents.parquet"))
    return str(path), {i: t for i, t, *_ in rows}


def test_stages(spark, table, tmp_path):
    path, texts = table
    docs, state = spark.read.parquet(f"{path}/documents.parquet"), texts
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, path).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "best_fit_packing":
            break
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        got = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "quality_rules":
            counts = {i: base_counts(t) for i, t in state.items()}
            base = {i: c for i, c in counts.items() if c[0] >= 20 and 100 * c[4] <= 30 * c[0]}
            d2 = brute_distances(list(base.values()))
            assert np.all((d2 < 25) | (d2 > 50))  # none so near the cutoff that bins could decide
            assert set(got) == {i for i, d in zip(base, d2) if d <= quality.CUTOFF} and len(base) - len(got) >= 1
        elif name == "exact_dedup":
            first = {}
            for i in sorted(state):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", state[i]), i)
            assert set(got) == set(first.values())
        elif name == "minhash_near_dedup":
            sets = {i: word_set(t, 5) for i, t in state.items()}
            links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            assert set(got) == {i for i, c in components(sets, links).items() if i == c} and len(got) < len(state)
        else:
            assert set(got) == set(state)
            for i, t in state.items():
                secret = re.search(secret_scan.ASSIGN, t) or re.search(secret_scan.ACCESS, t)
                assert ("[SECRET]" in got[i] and secret[0] not in got[i]) if secret else got[i] == t
        state = got
    assert {r["doc_id"] for r in docs.collect()} == set(state)
    again = {(r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in queries()["pipeline"](spark, path).collect()}
    assert again == {(r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in docs.collect()}


def test_stages_on_edges(spark, edge_docs, no_docs, tmp_path):
    for n, docs in enumerate((edge_docs, no_docs)):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, "").write.parquet(str(tmp_path / f"{n}-{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{n}-{name}"))
    assert docs.count() == 0


def test_a_stopped_run_goes_on(spark, table, monkeypatch):
    """Stages that only filter stand in for the real ones: run() is what is tested."""
    path, texts = table
    calls = []

    def stage(name, least):
        return name, lambda spark, docs, sf_dir: calls.append(name) or docs.where(f"doc_id >= {least}")

    def fail(*_):
        raise RuntimeError("lost")

    light = [stage(name, n) for n, (name, _) in enumerate(corpus_pipeline.STAGES)]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [*light[:2], ("minhash_near_dedup", fail), *light[3:]])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, path, run_id="stopped")
    monkeypatch.setattr(corpus_pipeline, "STAGES", light)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, path, run_id="stopped").collect()} == {i for i in texts if i >= 4}
    assert calls == [name for name, _ in light]
    corpus_pipeline.forget(spark, "stopped")
    assert not is_written(spark, corpus_pipeline._stage_path(spark, "stopped", "quality_rules"))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, path).collect()} == {i for i in texts if i >= 4} and len(calls) == 10
