"""Very long runs and documents of many lines take time that follows their length; clashing names and repeated ids change nothing."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidecube.llm import line_dedup, secret_scan, toxicity

LONG = 2_000_000
RUNS = {"letters": "z" * LONG, "dashes": "-" * LONG, "slashes": "/" * LONG, "mixed": "aB/-+_" * (LONG // 6), "digits": "7" * LONG, "tail": "z" * LONG + "9"}


@pytest.mark.parametrize("kind", sorted(RUNS))
def test_secrets_of_one_long_run(spark, kind):
    docs = spark.createDataFrame([(1, RUNS[kind] + " password = abcdefgh1234567"), (2, None)], "doc_id long, text string")
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in secret_scan.secret_report(docs).collect()}
    assert time.perf_counter() - began < 60
    n = len(RUNS[kind])
    assert f"assign:{n + 1}:{n + 27}" in got[1]["spans"] and got[1]["n_assign"] == 1 and got[2]["spans"] == ""
    assert got[1]["n_hex"] == (kind == "digits")


def test_runs_are_scanned_as_before(spark):
    """The pre-test lets through what has a run of 16 key characters with a digit in it, wherever in the run."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abZ9/-+_ .=") for _ in range(rng.randrange(5, 60))) for _ in range(400)] + ["", "x" * 15 + "1", "x" * 14 + "1", "é" * 20 + "1" * 16]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    new = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{16})[A-Za-z+/_-]*+[0-9]"
    whole = F.exists(F.regexp_extract_all("text", F.lit(secret_scan.CANDIDATE), F.lit(0)), lambda r: r.rlike("[0-9]"))
    got = rows.select(F.col("text").rlike(new).alias("test"), whole.alias("want")).collect()
    assert all(r["test"] == r["want"] for r in got) and 10 < sum(r["want"] for r in got) < len(got) - 20


def test_documents_of_many_lines(spark):
    """Each document is split once: 20 000 lines, of which 5000 repeat within it with a byte changed, and 5000 exactly."""
    rng = random.Random(6)
    fresh = ["".join(rng.choice("abcdefghijklmnop") for _ in range(100)) for _ in range(10_000)]
    near = [x[:50] + "Z" + x[51:] for x in fresh[:5000]]
    lines = fresh + near + fresh[5000:]
    docs = spark.createDataFrame([(7, "\n".join(lines)), (8, "a single line that nothing else holds")], "doc_id long, text string")
    began = time.perf_counter()
    report = {r["doc_id"]: r for r in line_dedup.line_report(docs).collect()}
    assert time.perf_counter() - began < 150
    assert report[7]["n_lines"] == 20_000 and report[7]["n_kept"] <= 10_050 and report[8]["n_kept"] == 1
    kept = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(docs).collect()}
    gone = {int(x) for x in report[7]["removed"].split(",")}
    assert kept[7] == "\n".join(x for n, x in enumerate(lines) if n not in gone) and kept[8].startswith("a single")


def test_toxicity_with_clashing_names_and_repeated_ids(spark):
    rng = random.Random(7)
    rows = [(i % 150, " ".join(rng.choice(["vile", "awful", "kind", "tree", "sun"]) for _ in range(12)) + (" trash" * (i % 3 == 0)), "a", 1, 2, "c") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id string, __label int, __place int, content string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 1, 2, 3) for i in range(150)], "doc_id long, toxic int, __id int, label int, place int")
    one = sorted((r["doc_id"], round(r["score"], 12)) for r in toxicity.held_out_scores(docs, labels).collect())
    two = sorted((r["doc_id"], round(r["score"], 12)) for r in toxicity.held_out_scores(docs.orderBy(F.desc("text")).repartition(5), labels.repartition(3)).collect())
    assert one == two and len(one) == 300
