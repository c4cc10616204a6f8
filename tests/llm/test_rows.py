"""Repeated rows, repeated ids and clashing names through every operator that returns documents; tables between steps."""

import subprocess
import sys

import pytest

from tidecube.llm import common, exact_dedup, line_dedup, near_dedup, quality, secret_scan, sharding

CLASH = "doc_id long, text string, lang string, source string, __text string, __spans string, __gone string, __kept_id long, row long, doc string, block long, h long, component string, n_words string, spans string, line int, `dotted.name` string"


@pytest.fixture(scope="module")
def clashing(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rest = ("en", "s", "a", "b", "c", 7, 8, "d", 9, 10, "e", "f", "g", 3, "h")
    return spark.createDataFrame([(1, text, *rest), (1, text, *rest), (2, text, *rest), (3, text + " password = abcdefghijkl123", *rest), (4, None, *rest)], CLASH)


def test_one_row_stays_of_rows_that_repeat(clashing):
    exact = exact_dedup.drop_exact_duplicates(clashing).collect()
    assert sorted(r["doc_id"] for r in exact) == [1, 3, 4]
    near = near_dedup.drop_near_duplicates(clashing).collect()
    assert sorted(r["doc_id"] for r in near) == [1, 4]
    lines = line_dedup.drop_repeated_lines(clashing).collect()
    assert len(lines) == 5 and sum("word0 " in (r["text"] or "") for r in lines) == 1
    assert sorted(r["doc_id"] for r in quality.drop_low_quality(clashing).collect()) == [1, 1, 2, 3]


@pytest.mark.parametrize("drop", [exact_dedup.drop_exact_duplicates, near_dedup.drop_near_duplicates, line_dedup.drop_repeated_lines, quality.drop_low_quality, secret_scan.mask_secrets])
def test_other_columns_pass_through(clashing, drop):
    out = drop(clashing)
    assert out.columns == clashing.columns and [t for _, t in out.dtypes] == [t for _, t in clashing.dtypes]
    want = clashing.drop("doc_id", "text").distinct().collect()
    assert out.drop("doc_id", "text").distinct().collect() == want


def test_masks_and_statistics_with_clashing_names(clashing):
    masked = {r["doc_id"]: r["text"] for r in secret_scan.mask_secrets(clashing).collect()}
    assert masked[3].endswith(" [SECRET]") and masked[4] is None
    assert quality.text_statistics(clashing).count() == 5


def test_texts_with_many_matches(spark):
    import re

    text = "x " + " é ".join(f"deadbeefdeadbeef{i % 10}" for i in range(3000)) + " end"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = secret_scan.secret_report(docs).first()
    want = [f"hex:{m.start()}:{m.end()}" for m in re.finditer("[0-9a-f]{16,}", text)]
    assert row["n_hex"] == 3000 and [s for s in row["spans"].split(",") if s.startswith("hex")] == want
    assert secret_scan.mask_secrets(docs).first()["text"] == re.sub("[0-9a-f]{16,}", "[SECRET]", text)


def test_rows_meet_their_shard(spark):
    """Each row's arc, home and shard by a row-by-row walk of the ring in the order of the rows' ranks."""
    docs = spark.range(700).selectExpr("id AS doc_id", "repeat('x', CAST(id % 7 AS int)) AS text")
    nodes = sharding.ring(5, 8)
    points = [p for p, _ in nodes]
    hashes = {r[0]: r[1] for r in docs.selectExpr("doc_id", "xxhash64(CAST(doc_id AS string)) AS h").collect()}
    arcs = {}
    for i, h in hashes.items():
        at = next((k for k, p in enumerate(points) if p >= h % sharding.RING), 0)
        arcs.setdefault(at, []).append(i)
    room = [700 // 5] * 5
    used, want, late = [0] * 5, {}, []
    for arc, (_, shard) in enumerate(nodes):
        for i in sorted(arcs.get(arc, []), key=lambda i: (((hashes[i] >> 33) % 64), hashes[i])):
            if used[shard] < room[shard]:
                want[i], used[shard] = (shard, used[shard], shard), used[shard] + 1
            else:
                late.append((arc, i, shard))
    for arc, i, home in late:
        at = (arc + 1) % len(nodes)
        while used[nodes[at][1]] >= room[nodes[at][1]]:
            at = (at + 1) % len(nodes)
        shard = nodes[at][1]
        want[i], used[shard] = (shard, used[shard], home), used[shard] + 1
    got = {r["doc_id"]: (r["shard"], r["slot"], r["home_shard"]) for r in sharding.assign_shards(docs, 5, virtual_nodes=8).collect()}
    assert {i: (s, h) for i, (s, _, h) in got.items()} == {i: (s, h) for i, (s, _, h) in want.items()}


def test_rows_of_one_id_are_ordered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HOT_ROWS", 20)
    docs = spark.range(600).selectExpr("IF(id < 400, NULL, id) AS doc_id", "'same text' AS text")
    rows = sharding.assign_shards(docs, 7, virtual_nodes=8).collect()
    loads = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(7)}
    assert len(rows) == 600 and all(v == list(range(len(v))) for v in loads.values()) and {len(v) for v in loads.values()} == {85, 86}


def test_scratch_deletes_its_own_tables_alone(spark):
    df = spark.range(3)
    lazy = common.materialise(df, "outside")
    one, two = common.Scratch(spark), common.Scratch(spark)
    with one:
        common.materialise(df, "one")
    with two:
        kept = common.materialise(df, "two")
    paths = list(one.paths)
    one.release()
    assert not common.is_written(spark, paths[0]) and lazy.count() == kept.count() == 3
    two.release()


PLAIN = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master(sys.argv[1]).config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert not spark.sparkContext.getConf().get("spark.checkpoint.dir")
from tidecube.llm import common
print("FOUND", common.materialise(spark.range(5), "t").count())
spark.sparkContext.__class__.master = property(lambda self: "spark://somewhere:7077")
try:
    common.shared_dir(spark)
except ValueError as error:
    print("ERROR", error)
"""


def test_a_session_without_a_shared_folder(tmp_path):
    """A local session gets a folder of its own; a cluster is told which setting it lacks."""
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", PLAIN, "local[2]"], env=os.environ | {"PYTHONPATH": root, "SPARK_CONF_DIR": str(tmp_path)}, capture_output=True, text=True, timeout=300)
    assert "FOUND 5" in done.stdout and "ERROR set spark.checkpoint.dir" in done.stdout, done.stderr[-2000:]


def test_text_ids_give_what_numbers_in_that_order_give(spark):
    """Ids that are texts in the order of the numbers they replace, null and repeated ones among them."""
    import random

    from pyspark.sql import functions as F

    from tidecube.llm import packing
    from tidecube.llm.registry import tokenizer_path

    rng = random.Random(2)
    base = [" ".join(rng.choice(["ash", "oak", "elm", "fir", "yew", "box"]) + str(rng.randrange(40)) for _ in range(60)) for _ in range(12)]
    texts = base + [b + " more" for b in base[:6]] + base[3:5] + [None, ""]
    rows = [(i if i not in (7, 15) else None, t) for i, t in enumerate(texts)] + [(3, base[0] + "\nits own line of words here")]
    numbers = spark.createDataFrame(rows, "doc_id long, text string")
    named = numbers.withColumn("doc_id", F.format_string("doc-%04d", "doc_id")).withColumn("doc_id", F.when(F.col("doc_id") != "doc-null", F.col("doc_id")))
    back = lambda v: None if v is None else int(v[4:]) if isinstance(v, str) and v.startswith("doc-") else v
    key = lambda r: tuple((v is None, str(v)) for v in r)
    asked = {
        "near": lambda d: near_dedup.near_duplicates(d), "lines": lambda d: line_dedup.line_report(d),
        "pieces": lambda d: packing.token_pieces(d, tokenizer_path("byte_bpe_50k.json")),
    }
    for name, make in asked.items():
        want = sorted((tuple(r) for r in make(numbers).collect()), key=key)
        got = sorted((tuple(back(v) for v in r) for r in make(named).collect()), key=key)
        assert got == want and want, name
    packed = packing.pack_documents(named, tokenizer_path("byte_bpe_50k.json"))
    assert dict(packed.dtypes)["doc_id"] == "string" and packed.count() == len(rows)
