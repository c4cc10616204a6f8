"""Secret scans: base patterns and character Markov models, with built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed patterns of the base kinds, in the order of kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")

#: What the Markov models look at: runs of these characters that are long enough and mix digits with letters.
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
#: Labelled samples drawn for each label; they come from rules, so they are the same everywhere.
SAMPLES = 4000
#: Least log-likelihood ratio, in nats: in total and for each character step.
LEAST_TOTAL, LEAST_STEP = 12.0, 0.45

#: Characters of the blocks that a text is masked in.
BLOCK = 4096

#: Fixed word list from which ordinary identifiers are put together.
WORDS = (
    "account active address after alpha amount array available average base batch before begin block body book border buffer build button cache call center change "
    "channel check class clear client code collection color column command compare config content context control count create current custom data date default "
    "delete delta detail device direction display document domain driver edge element enable end entry error event example export factory false field file filter "
    "first flag float folder format forward frame function general group handler hash header height helper history host image import index info initial input "
    "instance integer item iterator join key label language last layer layout length level library line link list listener loader local location lock log manager "
    "map master matrix max memory menu merge message meta method min mode model module mouse move name network next node normal notification null number object "
    "offset open option order output package page panel parent parse partition path pattern pixel player plugin point policy pool port position prefix previous "
    "print process product profile progress project property provider query queue range read record region register remote remove render report request reset "
    "resource response result root rotate round route row sample scale schedule schema scope screen script search section select sender server service session "
    "setting shape shared signal single size slice sort source split stack start state static status step storage store stream string style submit success suffix "
    "system table target task template temp test text theme thread time title total transform tree trigger true type unit update upload user util valid value "
    "vector version view visible web width window word worker wrapper write zone"
).split()


def labelled_samples(spark: SparkSession, count: int = SAMPLES) -> DataFrame:
    """(text, label): label 1 are random strings over the usual alphabets, label 0 ordinary identifiers.

    Identifiers join two to four words of WORDS in the usual styles, some with a short number; random
    strings are base-64, upper-case base-32 like and mixed alphanumeric renderings of SHA-512 digests.
    """
    ids = spark.range(count)
    word = lambda k: F.element_at(F.array(*[F.lit(w) for w in WORDS]), (F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(len(WORDS))) + 1).cast("int"))
    number = F.when(F.col("id") % 3 == 0, F.pmod(F.xxhash64(F.col("id"), F.lit(9)), F.lit(1000)).cast("string")).otherwise("")
    parts = [word(k) for k in range(4)]
    shown = (
        F.when(F.col("id") % 4 == 0, F.concat_ws("_", *parts[:3], number))
        .when(F.col("id") % 4 == 1, F.concat(parts[0], *[F.initcap(p) for p in parts[1:]], number))
        .when(F.col("id") % 4 == 2, F.concat_ws("-", *parts, number))
        .otherwise(F.upper(F.concat_ws("_", *parts[:3], number)))
    )
    digest = F.unhex(F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")).cast("binary"), 512))
    code = F.base64(digest)
    random = (
        F.when(F.col("id") % 3 == 0, F.substring(code, 1, 40))
        .when(F.col("id") % 3 == 1, F.substring(F.regexp_replace(F.upper(code), r"[^A-Z0-9]", ""), 1, 32))
        .otherwise(F.substring(F.regexp_replace(code, r"[^A-Za-z0-9]", ""), 1, 32))
    )
    return ids.select(shown.alias("text"), F.lit(0).alias("label")).union(ids.select(random.alias("text"), F.lit(1).alias("label")))


#: Symbols of the models: letters stand for themselves, all digits are one symbol, "/" counts as "_". The symbols' codes
#: lie between FIRST and FIRST + RANGE - 1, so that two of them make an index into a table of RANGE * RANGE.
_FROM = "0123456789_/-+"
_TO = "{{{{{{{{{{||}~"
FIRST, RANGE = 65, 62
_ALPHABET = sorted("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz{|}~")


def _once(value: Column, body) -> Column:
    """body(value), where value is computed once; a lambda in body would compute a plain expression for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _codes(text: Column) -> Column:
    return F.transform(F.split(F.translate(text, _FROM, _TO), ""), lambda c: F.ascii(c) - FIRST)


def _index(codes: Column) -> Column:
    """Indices of each two neighbours."""
    return _once(codes, lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda x, y: x * RANGE + y))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios (nats) of each two symbols under first-order models, random against ordinary, by index.

    Both models have add-one counts over the alphabet of 56 symbols, so the table that
    comes to the driver has at most 56 * 56 entries whatever the number of samples. Samples under two characters, or null, are left out.
    """
    pairs = samples.where(F.length("text") >= 2).select("label", F.explode(_index(_codes(F.col("text")))).alias("pair"))
    counts = {(r["label"], r["pair"]): r["n"] for r in pairs.groupBy("label", "pair").agg(F.count("*").alias("n")).collect()}
    places = [ord(a) - FIRST for a in _ALPHABET]
    table = [0.0] * (RANGE * RANGE)
    for a in places:
        totals = [sum(counts.get((label, a * RANGE + b), 0) for b in places) for label in (0, 1)]
        for b in places:
            step = [(counts.get((label, a * RANGE + b), 0) + 1) / (totals[label] + len(places)) for label in (0, 1)]
            table[a * RANGE + b] = math.log(step[1] / step[0])
    return table


def _ratio(text: Column, table: Column) -> Column:
    return F.aggregate(_index(_codes(text)), F.lit(0.0), lambda total, at: total + F.coalesce(F.get(table, at), F.lit(0.0)))


def _running(values: Column, merge) -> Column:
    """Running merge() (a sum, a maximum) of an array of integers, by doubling the stretch that each place covers."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int"))

    def double(state, k):
        return F.transform(state, lambda x, i: F.coalesce(merge(x, F.get(state, i - F.pow(F.lit(2.0), k).cast("int"))), x))

    return F.aggregate(rounds, values, double)


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _kept(ends: Column, whole: Column, part: Column, kind: int, least: int, lookup: Column) -> Column:
    """array<struct(start, kind, end)> of the matches that stay: a part of `least` characters, for Markov runs the models' verdict."""

    def good(match):
        run = match["run"]
        if KINDS[kind] == "markov":
            return run.rlike("[0-9]") & run.rlike("[A-Za-z]") & _passes(run, lookup)
        return F.length(match["part"]) >= least

    # Arrays meet as one argument, which is computed once; inside a lambda they would be computed for each element.
    matches = F.filter(F.arrays_zip(ends.alias("end"), whole.alias("run"), part.alias("part")), good)
    return F.transform(matches, lambda m: F.struct((m["end"] - F.length(m["run"])).alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def secret_spans(docs: DataFrame, text_col: str = "text", table: list[float] | None = None) -> DataFrame:
    """(doc, text, s0, s1, s2, s3, spans): doc is a struct of docs' columns, text the scanned one with null as empty.

    spans is an array<struct(start, kind, end)>, sorted; code points, end exclusive; s0 to s3 are those of each kind.
    kind is an index into KINDS: the three base patterns first, then what the Markov models add:
    runs of at least 16 key characters that mix digits and letters, whose log-likelihood ratio of random
    strings against ordinary identifiers is large in total and for each character. Only texts that a cheap
    test lets through are cut at matches; the tests read whole texts. Gaps between matches come from split, matches from
    regexp_extract_all, and their places are running sums, so the work follows n log n of a text's n matches.
    """
    table = table if table is not None else train(labelled_samples(docs.sparkSession))
    lookup = F.lit([float(v) for v in table])
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    step = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    text = F.col("text")
    tests = {
        0: text.rlike(r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"),
        1: text.contains("AKIA"),
        2: text.rlike(r"[0-9a-f]{16}"),
        # Looked for from the starts of runs alone, each read once: the work does not follow the square of a run.
        3: text.rlike(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{16})[A-Za-z+/_-]*+[0-9]"),
    }
    # Maximal runs of hexadecimal digits of 16 or more are the leftmost matches of HEX that are long enough.
    patterns = {0: (ASSIGN, 12, 2), 1: (ACCESS, 18, 0), 2: (HEX[:-1] + "{16,}", 16, 0), 3: (CANDIDATE, 16, 0)}
    for kind, (pattern, least, group) in patterns.items():
        whole, part, gaps = (F.col(f"{n}{kind}") for n in ("whole", "part", "gaps"))
        step = step.withColumn(f"test{kind}", tests[kind])
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        cut = {"gaps": F.split(text, pattern, -1), "whole": found, "part": F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found}
        for name, value in cut.items():
            step = step.withColumn(f"{name}{kind}", F.when(F.col(f"test{kind}"), value))
        sizes = F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("run")), lambda z: F.length(z["gap"]) + F.length(z["run"]))
        step = step.withColumn(f"ends{kind}", F.when(F.size(whole) > 0, _running(sizes, _sum)))
        step = step.withColumn(f"s{kind}", F.coalesce(F.when(F.size(whole) > 0, _kept(F.col(f"ends{kind}"), whole, part, kind, least, lookup)), empty))
    return step.select("doc", "text", *[f"s{k}" for k in patterns], F.array_sort(F.concat(*[f"s{k}" for k in patterns])).alias("spans"))


def _passes(text: Column, lookup: Column) -> Column:
    ratio = _ratio(text, lookup)
    return (ratio >= LEAST_TOTAL) & (ratio >= LEAST_STEP * (F.length(text) - 1))


def _shown(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov.

    Defined cases: null text counts as empty, without spans; equal starts are ordered by kind; a null id
    stays null; repeated rows are reported each; an empty table gives no rows; other columns are ignored. Very long texts are read whole,
    in time that follows their length, also where they are one run of letters, dashes or slashes.
    """
    found = secret_spans(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    return found.select(
        F.col("doc.id").alias("doc_id"),
        *[F.size(f"s{k}").cast("long").alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(_shown(F.array_sort(F.concat("s0", "s1", "s2"))).cast("binary"), 256).alias("base_sha256"),
        _shown(F.col("spans")).alias("spans"),
        F.size("s3").cast("long").alias("n_markov"),
    )


def mask_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with each stretch that spans cover replaced by mask.

    Spans that touch or overlap are one stretch each time a later one starts before the end of those before it. Defined cases: rows
    without spans are unchanged (null stays null, empty stays empty); repeated rows are masked each; columns of
    any names pass through; an empty table gives no rows.
    """
    found = secret_spans(docs, text_col=text_col)
    reached = _running(F.transform("spans", lambda s: s["end"]), F.greatest)
    cut = found.select("doc", "text", "spans", F.when(F.size("spans") > 0, F.concat(F.array(F.lit(0)), reached)).alias("reached"))
    text, size = F.col("text"), F.size("spans")
    # Blocks of the text, made once: a stretch is cut out of the blocks that hold it, so long texts with many spans take no longer walks.
    blocks = F.when(size > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))

    def stretch(held: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / BLOCK).cast("int")
        near = F.array_join(F.slice(held, first + 1, F.floor(end / BLOCK).cast("int") - first + 1), "")
        return F.substring(near, start - first * BLOCK + 1, end - start)

    def piece(held: Column):
        return lambda step: F.when(step["span"]["start"] >= step["at"], F.concat(stretch(held, step["at"], step["span"]["start"]), F.lit(mask))).otherwise("")

    steps = F.arrays_zip(F.col("spans").alias("span"), F.slice("reached", 1, size).alias("at"))
    rest = F.substring(text, F.element_at("reached", -1) + 1, F.length(text))
    merged = _once(blocks, lambda held: F.array_join(F.transform(steps, piece(held)), ""))
    masked = F.when(size > 0, F.concat(merged, rest)).otherwise(F.col("doc").getField(text_col))
    return cut.select(*[(masked if c == text_col else F.col("doc").getField(c)).alias(c) for c in docs.columns])
