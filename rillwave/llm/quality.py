"""Quality rules whose thresholds follow the data: quantile sketches per language and source, then a joined filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwave.llm.common import WS, join_checked, stage

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
#: A group with fewer documents in its sketch takes the merged sketch of its language, and that of all below as many.
MIN_DOCS = 30
#: A measure may lie beyond its quartiles by SPREADS * (1 + SHORT / n_words) spreads: shares of few words vary more.
SPREADS = 4
SHORT = 50
#: Thousandths up to which each value is a bin of its own; from there on bins grow: they keep BITS leading bits of a value.
TOP = 100_000
BITS = 17
#: Measures in thousandths with the least spread each is given: (name, spread, whether low values fail too).
MEASURES = (("word_len", 300, True), ("symbols", 50, False), ("dup_lines", 125, False), ("repeats", 60, False))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{WS}+", -1), "")


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of each whole text, all by built-in expressions.

    A text repeats an 8-word window only if two window hashes are equal; only such texts take the exact path,
    which sorts the windows by hash and compares neighbours word for word.
    """
    df = docs.select("doc_id", "lang", "source", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("w", words(F.col("text")))
    df = df.withColumn("n_words", F.size("w").cast("long"))
    line = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.regexp_replace(x, f"{WS}+", "")) > 0)
    df = df.withColumn("lines", line).withColumn("wh", F.transform("w", lambda x: F.xxhash64(x)))
    starts = F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get("wh", i + j) for j in range(WINDOW)]))
    df = df.withColumn("hs", F.when(F.col("n_words") > WINDOW, hashes).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("twice", F.size(F.array_distinct("hs")) < F.size("hs"))
    at = F.when(
        F.col("twice"),
        F.sort_array(F.transform(F.sequence(F.lit(0), F.size("hs") - 1), lambda i: F.struct(F.get("hs", i).alias("h"), i.alias("p")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))
    df = df.withColumn("at", at)

    def same(i, j):
        a, b = F.get("at", i), F.get("at", j)
        equal = a["h"] == b["h"]
        for k in range(WINDOW):
            equal = equal & (F.get("w", a["p"] + k) == F.get("w", b["p"] + k))
        return F.coalesce(equal, F.lit(False))

    last = F.size("at") - 1
    found = F.filter(F.sequence(F.lit(0), last), lambda i: ((i > 0) & same(i, i - 1)) | ((i < last) & same(i, i + 1)))
    places = F.when(F.col("twice"), F.sort_array(F.transform(found, lambda i: F.get("at", i)["p"]))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("places", places)
    gap = lambda i: F.least(F.lit(WINDOW), F.coalesce(F.get("places", i + 1) - F.get("places", i), F.lit(WINDOW)))
    covered = F.aggregate(F.sequence(F.lit(0), F.size("places") - 1), F.lit(0), lambda acc, i: acc + gap(i))
    return df.select(
        "doc_id",
        "lang",
        "source",
        "n_words",
        F.char_length(F.regexp_replace("text", f"{WS}+", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("places") > 0, covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def measured(df: DataFrame) -> DataFrame:
    """Adds base_failed and the measures, whole thousandths by integer division (exact, so alike on every engine)."""

    def per(part: str, whole: str) -> Column:
        value = F.expr(f"CASE WHEN {whole} > 0 THEN (1000 * {part}) DIV {whole} ELSE 0 END")
        return value.cast("long")

    return (
        df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
        .withColumn("word_len", per("word_chars", "n_words"))
        .withColumn("symbols", per("n_symbols", "n_words"))
        .withColumn("dup_lines", per("n_dup_lines", "n_lines"))
        .withColumn("repeats", per("n_repeat_words", "n_words"))
    )


def _bin(name: str) -> Column:
    """The least value of the bin that a value is in."""
    low = f"greatest(length(bin({name})) - {BITS}, 0)"
    return F.expr(f"CASE WHEN {name} < {TOP} THEN {name} ELSE shiftleft(shiftright({name}, {low}), {low}) END")


def _values(df: DataFrame) -> DataFrame:
    """lang, source, measure, bin, value of each measure that counts in sketches."""
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), _bin(name).alias("bin"), F.col(name).alias("value")) for name, _, _ in MEASURES]))
    return df.where(~F.col("base_failed")).select("lang", "source", pairs.alias("x")).select("lang", "source", "x.*")


def sketches(df: DataFrame) -> DataFrame:
    """lang, source, measure, bin, n: a histogram of whole thousandths per language and source.

    It is a quantile sketch with a fixed number of bins, exact where a bin is one value. Sketches merge
    by adding counts, before the shuffle too, so a hot source sends each task's bins and not its rows.
    """
    return _values(df).groupBy("lang", "source", "measure", "bin").agg(F.count(F.lit(1)).alias("n"))


def limits_of(rows: DataFrame) -> DataFrame:
    """The exact thresholds of measured rows. Bins of several values in which a quartile lies are counted anew by value."""
    sketch = stage(sketches(rows), "quality-sketch")
    limits = stage(thresholds(sketch), "quality-limits")
    met = F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), F.col(f"{name}_q{p}").alias("bin")) for name, _, _ in MEASURES for p in (1, 3)]))
    wide = stage(limits.select(met.alias("x")).where(F.col("x.bin") >= 1 << BITS).select(F.col("x.measure").alias("m"), F.col("x.bin").alias("b")).distinct(), "quality-bins")
    if wide.isEmpty():
        return limits
    open_ = lambda df: (df["measure"] == wide["m"]) & (df["bin"] == wide["b"])
    large = _values(rows).where(F.col("bin") >= 1 << BITS)
    exact = join_checked(large, wide, open_(large), "left_semi").groupBy("lang", "source", "measure", F.col("value").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    rest = join_checked(sketch, wide, open_(sketch), "left_anti")
    return stage(thresholds(stage(rest.unionByName(exact), "quality-sketch")), "quality-limits")


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Sketches merged to the groups of by; per group its documents and the quartile bins of each measure."""
    merged = sketch.groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n"))
    up_to = Window.partitionBy(*by, "measure").orderBy("bin")
    ranked = merged.withColumn("upto", F.sum("n").over(up_to.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "all", F.sum("n").over(Window.partitionBy(*by, "measure"))
    )
    aggs = [F.max("all").alias("docs")]
    for name, _, _ in MEASURES:
        mine = F.col("measure") == name
        for p in (1, 3):
            aggs.append(F.min(F.when(mine & (4 * F.col("upto") >= p * F.col("all")), F.col("bin"))).alias(f"{name}_q{p}"))
    return ranked.groupBy(*by).agg(*aggs)


def thresholds(sketch: DataFrame) -> DataFrame:
    """Quartiles per language and source, taken from a wider group where the sketch is small."""
    names = [f"{name}_q{p}" for name, _, _ in MEASURES for p in (1, 3)]
    own = quartiles(sketch, ["lang", "source"])
    lang = quartiles(sketch, ["lang"]).select(F.col("lang").alias("l_lang"), F.col("docs").alias("l_docs"), *[F.col(n).alias(f"l_{n}") for n in names])
    every = quartiles(sketch.withColumn("all_docs", F.lit(0)), ["all_docs"]).first()
    joined = own.join(lang, own["lang"].eqNullSafe(lang["l_lang"]), "left")

    def choose(n: str) -> Column:
        whole = F.lit(every[n] if every else None).cast("long")
        return F.when(F.col("docs") >= MIN_DOCS, F.col(n)).when(F.col("l_docs") >= MIN_DOCS, F.col(f"l_{n}")).otherwise(whole).alias(n)

    return joined.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *[choose(n) for n in names])


def quality(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept, and the columns lang and source.

    A document is kept if it passes the base rules and each of its measures (mean word length, symbols per word,
    share of repeated lines, share of words in repeated windows) lies within SPREADS * (1 + SHORT / n_words) spreads of the
    quartiles of its language and source. The spread is the distance of the quartiles, a stated minimum at least. Null lang and
    source are groups of their own; null text counts as empty, so it has no words and fails. Ties and repeated
    rows are judged alike; very long texts are counted whole; other columns are ignored; an empty table gives an empty result. A group without any sketch
    consists of failed documents only. The counts are staged once for both uses, and carry no text.
    """
    rows = stage(measured(counted(docs)), "quality-counts")
    limits = limits_of(rows)
    same = rows["lang"].eqNullSafe(limits["t_lang"]) & rows["source"].eqNullSafe(limits["t_source"])
    joined = join_checked(rows, limits, same, "left")
    slack = SPREADS * (F.col("n_words") + SHORT)  # both sides times n_words: whole numbers
    passes = ~F.col("base_failed")
    for name, least, two_sided in MEASURES:
        spread = slack * F.greatest(F.col(f"{name}_q3") - F.col(f"{name}_q1"), F.lit(least))
        passes = passes & (F.col("n_words") * (F.col(name) - F.col(f"{name}_q3")) <= spread)
        if two_sided:
            passes = passes & (F.col("n_words") * (F.col(f"{name}_q1") - F.col(name)) <= spread)
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(passes, F.lit(False)).alias("kept"), "lang", "source"
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w0 AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w,
              generate_subscripts(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''), 1) AS p FROM d),
w1 AS (SELECT doc_id, p, CASE WHEN lead(w, 7) OVER o IS NOT NULL THEN concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o,
              lead(w, 4) OVER o, lead(w, 5) OVER o, lead(w, 6) OVER o, lead(w, 7) OVER o) END AS s
       FROM w0 WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
w2 AS (SELECT doc_id, p, (s IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, s) > 1)::INT AS twice FROM w1),
w3 AS (SELECT doc_id, max(twice) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS covered FROM w2),
rep AS (SELECT doc_id, count(*) AS n_words, sum(covered)::BIGINT AS n_repeat_words FROM w3 GROUP BY doc_id),
ln AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
c AS (
  SELECT d.doc_id, d.lang, d.source, coalesce(n_words, 0) AS n_words, coalesce(n_repeat_words, 0) AS n_repeat_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines
  FROM d LEFT JOIN rep USING (doc_id) JOIN ln USING (doc_id)),
m AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END AS word_len,
         CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END AS symbols,
         CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_lines,
         CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeats FROM c),
g AS (SELECT * FROM m WHERE NOT base_failed),
q AS (
  SELECT lang, source, grouping(lang, source) AS lv, count(*) AS docs,
    quantile_disc(word_len, 0.25) AS a1, quantile_disc(word_len, 0.75) AS a3, quantile_disc(symbols, 0.25) AS b1, quantile_disc(symbols, 0.75) AS b3,
    quantile_disc(dup_lines, 0.25) AS c1, quantile_disc(dup_lines, 0.75) AS c3, quantile_disc(repeats, 0.25) AS d1, quantile_disc(repeats, 0.75) AS d3
  FROM g GROUP BY GROUPING SETS ((lang, source), (lang), ())),
j AS (
  SELECT m.*, unnest(CASE WHEN o.docs >= 30 THEN {'a1':o.a1,'a3':o.a3,'b1':o.b1,'b3':o.b3,'c1':o.c1,'c3':o.c3,'d1':o.d1,'d3':o.d3}
                   WHEN l.docs >= 30 THEN {'a1':l.a1,'a3':l.a3,'b1':l.b1,'b3':l.b3,'c1':l.c1,'c3':l.c3,'d1':l.d1,'d3':l.d3}
                   ELSE {'a1':e.a1,'a3':e.a3,'b1':e.b1,'b3':e.b3,'c1':e.c1,'c3':e.c3,'d1':e.d1,'d3':e.d3} END),
         4 * (n_words + 50) AS slack
  FROM m LEFT JOIN q o ON o.lv = 0 AND o.lang IS NOT DISTINCT FROM m.lang AND o.source IS NOT DISTINCT FROM m.source
         LEFT JOIN q l ON l.lv = 1 AND l.lang IS NOT DISTINCT FROM m.lang LEFT JOIN q e ON e.lv = 3)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(NOT base_failed AND greatest(a1 - word_len, word_len - a3) * n_words <= slack * greatest(a3 - a1, 300)
         AND (symbols - b3) * n_words <= slack * greatest(b3 - b1, 50) AND (dup_lines - c3) * n_words <= slack * greatest(c3 - c1, 125)
         AND (repeats - d3) * n_words <= slack * greatest(d3 - d1, 60), false) AS kept, lang, source
FROM j
"""
