"""Quality rules by robust multivariate outliers, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, field, materialise, numbered_rows, only_rows

#: Statistics are held as integers of this many steps a unit, so that sums over any number of rows are exact.
STEPS = 1024
#: Number of transformed statistics.
DIMS = 5
#: Share of a group's rows that a concentration step keeps.
CORE_SHARE = 0.75
#: Concentration starts from medians and quartile ranges and from this many random subsets of DIMS + 1 rows.
SUBSETS = 2
#: Steps that every start takes before only the one with the smallest determinant goes on.
SCREENING = 2
#: A group goes on as long as the logarithm of its determinant falls by more than this.
SETTLED = 1e-3
#: Median of the chi-squared distribution with DIMS degrees of freedom.
CHI_MEDIAN = 4.351460
#: Rows are rejected beyond this squared distance, which that distribution exceeds once in a million rows.
CUTOFF = 35.888
#: A group's estimate counts its language's like this many more rows: five for each dimension, the least that such estimates are said to need.
PRIOR_ROWS = 5 * DIMS
#: Least standard deviation of each statistic, on its transformed scale. Most texts repeat no line or word, so the core
#: of those two has no spread of its own, and the floor says what is usual.
FLOORS = (0.5, 0.12, 0.25, 0.5, 0.5)
#: Squared distances are counted in bins of 1/16 octave.
BINS = 16

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs' columns but text, plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (long).

    A repeated window is found by its 64-bit hash: windows are sorted once with their places, so the work
    follows n log n of the text's own length and nothing is exploded or shuffled. Columns of docs named like a statistic are
    replaced by it; all others pass through, whatever their names.

    Defined cases: null and empty texts give zeros; repeated rows are counted each; a very long text is one row's arrays of words, lines and
    windows, some tens of bytes a word; an empty table gives no rows.
    """
    words = F.array_remove(F.split(F.col("text"), SPACE + "+", -1), "")
    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = F.size("words")
    windows = F.when(count >= 8, F.transform(F.sequence(F.lit(1), count - 7), lambda i: F.xxhash64(F.slice("words", i, 8))))
    windows = F.coalesce(windows, F.array().cast("array<bigint>"))
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def again(x, i):
        before, after = F.get(F.col("placed"), i - 1), F.get(F.col("placed"), i + 1)
        return F.coalesce(before["h"] == x["h"], F.lit(False)) | F.coalesce(after["h"] == x["h"], F.lit(False))

    hits = F.array_sort(F.transform(F.filter("placed", again), lambda x: x["i"]))
    covered = F.aggregate(
        F.transform("hits", lambda x, i: F.least(F.lit(8), F.coalesce(F.get(F.col("hits"), i + 1) - x, F.lit(8)))), F.lit(0), lambda a, x: a + x
    )
    others = [c for c in docs.columns if c != text_col and c not in STATISTICS]
    step = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    step = step.withColumn("words", words).withColumn("lines", lines).withColumn("windows", windows)
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    step = step.withColumn("placed", F.when(repeats, placed)).withColumn("hits", F.when(repeats, hits))
    return step.select(
        *[field(c).alias(c) for c in others],
        count.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(repeats, covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def _vector() -> list[Column]:
    """The transformed statistics, as integers."""
    words, lines, chars = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n_words", "n_lines", "word_chars"))
    parts = (
        F.log1p(F.col("n_words").cast("double")),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        F.log1p(100.0 * F.col("n_symbols") / chars),
        F.log1p(10.0 * F.col("n_dup_lines") / lines),
        F.log1p(10.0 * F.col("n_repeat_words") / words),
    )
    return [F.round(p * STEPS).cast("long").alias(f"x{k}") for k, p in enumerate(parts)]


def _pairs() -> list[tuple[int, int]]:
    return [(a, b) for a in range(DIMS) for b in range(a + 1)]


_CENTRE = [f"m{k}" for k in range(DIMS)]
_COVARIANCE = [f"c{a}{b}" for a, b in _pairs()]
_SUMS = ["n", *[f"s{k}" for k in range(DIMS)], *[f"p{a}{b}" for a, b in _pairs()]]


def _moments(sums: DataFrame, prior: DataFrame | None) -> DataFrame:
    """(grp, start, m.., c..) from sums n, s.. and p.. of rows; prior(grp, m.., c..) counts like PRIOR_ROWS more rows.

    The prior's rows are the same at every step, so steps still lower the determinant of what both give together.
    """
    n = F.col("n").cast("double")
    mean = {k: F.col(f"s{k}") / STEPS / n for k in range(DIMS)}
    own = {(a, b): F.col(f"p{a}{b}") / (STEPS * STEPS) / n - mean[a] * mean[b] for a, b in _pairs()}
    if prior is None:
        return sums.select("grp", "start", *[mean[k].alias(f"m{k}") for k in range(DIMS)], *[own[p].alias("c%d%d" % p) for p in _pairs()])
    share = n / (n + PRIOR_ROWS)
    before = prior.select("grp", *[F.col(c).alias(f"prior_{c}") for c in (*_CENTRE, *_COVARIANCE)])
    off = {k: mean[k] - F.col(f"prior_m{k}") for k in range(DIMS)}
    return sums.join(before, "grp").select(
        "grp", "start",
        *[(mean[k] - (1 - share) * off[k]).alias(f"m{k}") for k in range(DIMS)],
        *[(share * own[a, b] + (1 - share) * F.col(f"prior_c{a}{b}") + share * (1 - share) * off[a] * off[b]).alias(f"c{a}{b}") for a, b in _pairs()],
    )


def _factored(df: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l of the covariances c plus the squared floors, one column after another, and the log of its determinant."""
    for a, b in _pairs():
        rest = F.col(f"c{a}{b}") + (FLOORS[a] ** 2 if a == b else 0.0)
        for k in range(b):
            rest = rest - F.col(f"l{a}{k}") * F.col(f"l{b}{k}")
        df = df.withColumn(f"l{a}{b}", F.sqrt(rest) if a == b else rest / F.col(f"l{b}{b}"))
    return df.withColumn("logdet", sum((2 * F.log(f"l{k}{k}") for k in range(DIMS)), F.lit(0.0)))


def _distance(df: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    for a in range(DIMS):
        rest = F.col(f"x{a}") / F.lit(float(STEPS)) - F.col(f"m{a}")
        for b in range(a):
            rest = rest - F.col(f"l{a}{b}") * F.col(f"y{b}")
        df = df.withColumn(f"y{a}", rest / F.col(f"l{a}{a}"))
    total = F.col("y0") * F.col("y0")
    for a in range(1, DIMS):
        total = total + F.col(f"y{a}") * F.col(f"y{a}")
    return df.withColumn("d2", total)


def _binned(df: DataFrame) -> DataFrame:
    return df.withColumn("bin", F.floor(F.log2(F.col("d2") + 2.0**-20) * BINS).cast("int"))


def _small(df: DataFrame, name: str) -> DataFrame:
    """A table with one row per group, in a few files, so that its size on disk is that of its rows."""
    return materialise(df.repartition(4), name)


def _starts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grp, start 0, m.., c..) of medians and quartile ranges; (grp, start, n, s.., p..) of random subsets of DIMS + 1 rows.

    A subset has the row with the smallest hash of each of DIMS + 1 parts that a hash makes, which partial aggregates find.
    """
    xs = [f"x{k}" for k in range(DIMS)]
    quartiles = rows.groupBy("grp").agg(*[F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{x[1:]}") for x in xs])
    spread = {(a, b): F.pow((F.col(f"q{a}")[2] - F.col(f"q{a}")[0]) / STEPS / 1.349, F.lit(2.0)) if a == b else F.lit(0.0) for a, b in _pairs()}
    middle = quartiles.select("grp", F.lit(0).alias("start"), *[(F.col(f"q{k}")[1] / STEPS).alias(f"m{k}") for k in range(DIMS)], *[spread[p].alias("c%d%d" % p) for p in _pairs()])
    h = F.xxhash64(*xs)
    drawn = rows.groupBy("grp", F.pmod(h, F.lit(SUBSETS * (DIMS + 1))).alias("part")).agg(F.min(F.struct(F.xxhash64(h).alias("h"), *xs)).alias("row"))
    drawn = drawn.select("grp", (F.floor(F.col("part") / (DIMS + 1)) + 1).cast("int").alias("start"), "row.*")
    subsets = drawn.groupBy("grp", "start").agg(
        F.count("*").alias("n"), *[F.sum(x).alias(f"s{x[1:]}") for x in xs], *[F.sum(F.col(f"x{a}") * F.col(f"x{b}")).alias(f"p{a}{b}") for a, b in _pairs()]
    )
    return middle, subsets


def _concentrated(rows: DataFrame, current: DataFrame, prior: DataFrame | None, name: str) -> DataFrame:
    """One concentration step: (grp, start, m.., c.., l.., logdet) of the CORE_SHARE of a group's rows nearest to current's estimate.

    Rows are counted and summed by bins of their distance, which partial sums fill before any shuffle. The bin in
    which the share is reached counts in part, so every step keeps the same number of rows and determinants
    compare. Sums are of integers, so no order of rows changes them.
    """
    near = _binned(_distance(rows.join(current.select("grp", "start", *_CENTRE, *[f"l{a}{b}" for a, b in _pairs()]), "grp")))
    sums = near.groupBy("grp", "start", "bin").agg(
        F.count("*").alias("n"),
        *[F.sum(f"x{k}").alias(f"s{k}") for k in range(DIMS)],
        *[F.sum(F.col(f"x{a}") * F.col(f"x{b}")).alias(f"p{a}{b}") for a, b in _pairs()],
    )
    # A table of its own: else the sums would be dealt by group alone, all parts of a hot group to one task.
    sums = materialise(sums, f"{name}-sums")
    whole = Window.partitionBy("grp", "start")
    upto = F.sum("n").over(whole.orderBy("bin"))
    inner = sums.withColumn("core", F.ceil(F.sum("n").over(whole) * CORE_SHARE)).withColumn("taken", F.least("n", F.col("core") - (upto - F.col("n")))).where("taken > 0")
    part = F.col("taken") / F.col("n")
    core = inner.groupBy("grp", "start").agg(F.sum("taken").alias("n"), *[F.sum(F.round(F.col(c) * part).cast("long")).alias(c) for c in _SUMS[1:]])
    return _factored(_moments(core, prior))


def _estimates(rows: DataFrame, prior: DataFrame | None, name: str) -> DataFrame:
    """grp -> centre, covariance, factor and scale of its rows(grp, x0..): minimum-covariance-determinant estimates.

    All starts take SCREENING concentration steps; the start of a group with the smallest determinant goes on until
    the determinant no longer falls. Groups that have settled leave the rows that later steps read. The factor's scale makes
    the median squared distance that of the normal distribution.
    """
    middle, subsets = _starts(rows)
    current = _small(_factored(middle.unionByName(_moments(subsets, prior))), f"{name}-start")
    for step in range(SCREENING):
        current = _small(_concentrated(rows, current, prior, name), f"{name}-screen-{step}")
    best = current.groupBy("grp").agg(F.min_by(F.struct(*[c for c in current.columns if c != "grp"]), F.struct("logdet", "start")).alias("best"))
    current = _small(best.select("grp", "best.*", F.lit(True).alias("going")), f"{name}-best")
    columns = [c for c in current.columns if c != "going"]
    step = 0
    while current.where("going").limit(1).count():
        step += 1
        after = _concentrated(rows, current.where("going"), prior, name)
        after = after.select("grp", F.struct(*[F.col(c) for c in columns]).alias("after"))
        falls = F.col("going") & F.coalesce(F.col("after.logdet") < F.col("logdet") - SETTLED, F.lit(False))
        chosen = F.when(falls, F.col("after")).otherwise(F.struct(*columns))
        current = _small(current.join(after, "grp", "left").select(chosen.alias("row"), falls.alias("going")).select("row.*", "going"), f"{name}-{step}")
    bins = materialise(_binned(_distance(rows.join(current.drop("start"), "grp"))).groupBy("grp", "bin").agg(F.count("*").alias("n")), f"{name}-bins")
    whole = Window.partitionBy("grp")
    half = bins.withColumn("upto", F.sum("n").over(whole.orderBy("bin"))).withColumn("total", F.sum("n").over(whole))
    scale = half.where(F.col("upto") * 2 >= F.col("total")).groupBy("grp").agg(F.min("bin").alias("bin"))
    scale = scale.select("grp", F.greatest(F.lit(1.0), F.pow(F.lit(2.0), (F.col("bin") + 1) / BINS) / CHI_MEDIAN).alias("scale"))
    return _small(current.join(scale, "grp").drop("going", "start"), name)


def _verdicts(base: DataFrame) -> DataFrame:
    """base(row, doc_id, lang, source, text) with the base counts, base_failed, kept and distance in place of text."""
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    stats = materialise(text_statistics(base).withColumn("base_failed", failed), "statistics")
    by_lang, by_both = F.to_json(F.struct("lang")).alias("by_lang"), F.to_json(F.struct("lang", "source")).alias("by_both")
    rows = materialise(stats.where("NOT base_failed").select(by_lang, by_both, *_vector()), "vectors")
    vectors = [f"x{k}" for k in range(DIMS)]
    of_lang = _estimates(rows.select(F.col("by_lang").alias("grp"), *vectors), None, "mcd-lang")
    pairs = rows.groupBy("by_both").agg(F.min("by_lang").alias("by_lang"))
    prior = pairs.join(of_lang.withColumnRenamed("grp", "by_lang"), "by_lang").withColumnRenamed("by_both", "grp")
    prior = _small(prior.select("grp", *_CENTRE, *_COVARIANCE), "mcd-prior")
    params = _estimates(rows.select(F.col("by_both").alias("grp"), *vectors), prior, "mcd").withColumnRenamed("grp", "by_both")
    scored = _distance(stats.withColumn("by_both", by_both).select("*", *_vector()).join(params, "by_both", "left"))
    distance = F.when(~F.col("base_failed"), F.col("d2") / F.col("scale"))
    return scored.select(
        "row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (distance <= CUTOFF)).alias("kept"), distance.alias("distance"),
    )


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, the base counts, base_failed, kept, distance (squared, null if base_failed).

    Method: transformed statistics (text length, word length, symbols, repeated lines, repeated words) of
    the rows that pass the base rules get a minimum-covariance-determinant estimate for each language and
    source; a row is rejected if its squared Mahalanobis distance is over CUTOFF. Every group has an
    estimate of its own, at every size: its language's counts like PRIOR_ROWS more rows, so the estimate of a few
    rows lies near its language's and that of many rows is their own. Covariances get the squares of FLOORS
    on the diagonal, so groups whose statistics hardly vary do not reject ordinary rows.

    Estimates hold one row a group; Spark broadcasts them only under its size threshold. A hot group is
    summed in parts before its rows are shuffled. Defined cases: null text counts as empty and fails the
    base; null language or source is a value of its own; repeated rows count each; very long texts are counted whole and weigh
    as one row, by the logarithm of their length; an empty table gives no rows; other columns are ignored.
    """
    base = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"),
    )
    return _verdicts(base).drop("row")


def drop_low_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs that quality_verdicts() keeps, with all their columns.

    Each row is judged by its own text, so rows that repeat an id, or are equal, are told apart; columns of any names pass through; an
    empty table gives no rows.
    """
    rows = numbered_rows(docs, id_col)
    base = rows.select(
        "row", field(id_col).alias("doc_id"), field(lang_col).cast("string").alias("lang"), field(source_col).cast("string").alias("source"), field(text_col).alias("text")
    )
    return only_rows(rows, _verdicts(base).where("kept"))
