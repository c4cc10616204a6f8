"""Spelling variants: words one edit apart by an even-partition pigeonhole join, and the form that each stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: A run of Latin letters of the first 256 code points (with the two signs among them).
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A run whose checksum this divides loses a code point.
DELETE = 199
#: Least code points and occurrences of a word, and how many times as often a form must occur.
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: Code points up to which the built-in edit distance is used.
SHORT = 64


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n), written: the words of whole texts after the keyed deletions, those that are long and frequent enough.

    Runs shorter than a word never become one, so they go before the checksum; counts are partial sums, so a word that
    holds a third of all rows is one row a task.
    """
    plain = F.translate(F.col(f"`{text_col}`"), UPPER, UPPER.lower())
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(plain, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least_length).select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    place = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), place), F.substring(F.col("run"), place + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % DELETE == 0, cut).otherwise(F.col("run")).alias("word"))
    counts = words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return materialise(counts.where(F.col("n") >= least_count), "words")


def _keys(word: Column, size: Column, indexed: Column) -> Column:
    """array<long> of the bucket keys of a word of `size` code points, seen against indexed words of `indexed` ones.

    An indexed word falls into two even segments. One edit leaves one of them whole: the first at its place, the second
    counted from the end, so that it is shifted by one in a longer probe. The rest, where the edit is, falls into two
    segments again, one of which is whole too; both together are the key, so a common segment alone pairs no words.
    """
    first = F.floor(indexed / 2).cast("int")
    keys = []
    for side in (1, 2):
        held = first if side == 1 else indexed - first  # code points of the segment that is whole
        segment = F.substring(word, F.lit(1), held) if side == 1 else F.substring(word, size - held + 1, held)
        rest = F.substring(word, held + 1, size) if side == 1 else F.substring(word, F.lit(1), size - held)
        left = indexed - held  # of the rest, in the indexed word
        half = F.floor(left / 2).cast("int")
        over = size - indexed  # one more in a longer probe, else none
        parts = (F.substring(rest, F.lit(1), half), F.substring(rest, half + over + 1, left - half))
        keys += [F.xxhash64(indexed, F.lit(side * 2 + k), segment, part) for k, part in enumerate(parts)]
    return F.array(*keys)


def _one_edit(a: Column, b: Column, size: Column, b_size: Column) -> Column:
    """Whether b, as long as a or one code point longer, is one edit away; a and b are not equal.

    The built-in distance walks its whole table, the square of a word; long words are compared after their common prefix, found
    by halving.
    """
    steps = F.transform(F.sequence(F.ceil(F.log2(size.cast("double"))).cast("int"), F.lit(0)), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    longer = lambda held, step: F.when((held + step <= size) & (F.substring(a, held + 1, step) == F.substring(b, held + 1, step)), held + step).otherwise(held)
    rest = F.aggregate(steps, F.lit(0), longer, lambda held: F.substring(a, held + 1 + F.when(size == b_size, 1).otherwise(0), size) == F.substring(b, held + 2, b_size))
    return F.when(b_size <= SHORT, F.levenshtein(a, b, 1) == 1).otherwise(rest)


def near_words(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n), each pair once: the words of words(word, n) that differ by exactly one inserted, deleted or replaced code point.

    Words are indexed by the segments for their own length and probe those of their length and of one code point less. A bucket
    is an equi-join key that adaptive execution can split; the edit is verified inside the join, so only near pairs leave it.
    Words under four code points, whose rest could not be cut, must not be there.
    """
    size = F.length("word")
    index = words.select(F.col("word").alias("a"), F.col("n").alias("a_n"), size.alias("a_size"), F.explode(_keys(F.col("word"), size, size)).alias("key"))
    same, longer = _keys(F.col("word"), size, size), _keys(F.col("word"), size, size - 1)
    probe = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"), size.alias("b_size"), F.explode(F.concat(same, longer)).alias("key"))
    order = (F.col("b_size") > F.col("a_size")) | ((F.col("b_size") == F.col("a_size")) & (F.col("a") < F.col("b")))
    found = index.join(probe, "key").where(order & _one_edit(F.col("a"), F.col("b"), F.col("a_size"), F.col("b_size")))
    return found.groupBy("a", "b").agg(F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each word of forms(word, form), by doubling: a chain of d forms takes log2(d) joins.

    Forms occur TIMES as often as their words, so chains end, after as many steps as the logarithm of the largest count.
    """
    found = forms.select("word", F.col("form").alias("root"))
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = materialise(found.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "word-roots")
        found = stepped.select("word", "root")
        if not stepped.where("moved").limit(1).count():
            return found


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Defined cases: null and empty texts have no words; a null id counts as empty text in the checksum; repeated rows count each; forms of
    equal counts go by code-point order; a word without near words, or none frequent enough, has no form and is its own root; very long texts
    are cut into runs whole, a run of any length is one word; an empty table gives no rows; other columns are ignored.
    """
    words = word_counts(docs, id_col, text_col)
    pairs = materialise(near_words(words), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n"))
    both = both.union(pairs.select("b", "a", "a_n"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("low"), "other")).alias("best"))
    frequent = -F.col("best.low") >= TIMES * F.col("n")
    known = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(frequent, F.col("best.other")).alias("form"), F.when(frequent, -F.col("best.low")).alias("form_n"),
    )
    known = materialise(known, "word-forms")
    ends = roots(known.where("form IS NOT NULL"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: DuckDB: the checksum bit table by rule, near words by the texts that lack one code point.
ORACLE = """
WITH RECURSIVE bits AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([CAST(i AS BIGINT)], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
),
runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY doc_id, run
),
octets AS (
  SELECT doc_id, run, times, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c:
    CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(192 + unicode(c) // 64 AS BIGINT), CAST(128 + unicode(c) % 64 AS BIGINT)] END)) AS o FROM runs
),
sums AS (
  SELECT run, times, xor(list_reduce(list_concat([4294967295], o), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM octets, bits
),
words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
    SELECT times, CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM sums)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
),
cut AS (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT cut.word, words.word, words.n FROM cut JOIN words ON cut.rest = words.word
  UNION SELECT words.word, cut.word, cut.n FROM cut JOIN words ON cut.rest = words.word
),
best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY word
),
chosen AS (
  SELECT best.word, n_near, top, min(other) AS other FROM best JOIN near ON near.word = best.word AND other_n = top GROUP BY best.word, n_near, top
),
known AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * n THEN other END AS form, CASE WHEN top >= 5 * n THEN top END AS form_n FROM words LEFT JOIN chosen USING (word)
),
walk AS (
  SELECT word, word AS at FROM known UNION ALL SELECT walk.word, known.form FROM walk JOIN known ON known.word = walk.at WHERE known.form IS NOT NULL
),
ends AS (SELECT walk.word, walk.at AS root FROM walk JOIN known ON known.word = walk.at WHERE known.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM known JOIN ends USING (word)
"""
