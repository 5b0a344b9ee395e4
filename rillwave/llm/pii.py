"""Personal data: four base kinds by pattern, and more identifiers found through the contexts they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwave.llm import common
from rillwave.llm.common import stage

KINDS = ("email", "ip", "card", "phone")

# The base patterns, rewritten so that no text makes them backtrack: a match starts where its run of characters
# does (or where the last match ended), and runs are taken whole. Card runs must hold 16 digits to match at all.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}",
    "card": r"(?=(?:[0-9][\x20-]?){15}[0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A token with a digit, an @ or a written-out one, with the groups of digits that follow it.
CANDIDATE = r"(?<!\S)(?=\S*(?:[0-9@]|[\[(]at[\])]))\S++(?:\x20(?=[(0-9])[0-9()./:+-]++)*+"
#: What a found identifier of each kind must look like. Repeated groups are taken whole, as a stack is not as deep as texts are long.
SHAPES = {
    "email": r"^[^\s@]+(?:@|\[at\]|\(at\))[^\s@]+$",
    "ip": r"^[0-9A-Fa-f]++(?:[.:]++[0-9A-Fa-f]++){2,}+$",
    "card": r"^[0-9](?:[ ./-]?[0-9]){11,}+$",
    "phone": r"^[(+]?(?:[0-9][ ()./-]{0,3}){6,14}[0-9]$",
}
TURNS = 3
#: A context counts from so many different seeds on, and a pattern or identifier from such a confidence on.
SUPPORT = 3
CONFIDENCE = 0.8

#: Matches whose places are added up in one list; lists are then shifted by their sums, so that no long one is copied.
CHUNK = 128

_SPAN = "array<struct<s:int,e:int,v:string,word:string,two:string>>"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def found(text: Column, pattern: str) -> Column:
    """All matches in order: start and end in code points, the match, the last word and last two words before it.

    Lengths of gaps and matches are added up in chunks, then the chunks' sums: time in proportion to the text.
    """
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zero, none = F.lit(0), F.array().cast(_SPAN)

    def step(acc, x):
        s = acc["at"] + F.char_length(x["gap"])
        e = s + F.char_length(x["hit"])
        before = _before(x["gap"])
        span = F.struct(s.alias("s"), e.alias("e"), x["hit"].alias("v"), _last_words(before, 1).alias("word"), _last_words(before, 2).alias("two"))
        return F.struct(e.alias("at"), F.array_append(acc["out"], span).alias("out"))

    def chunks(pairs):
        one = lambda i: F.aggregate(F.slice(pairs, i * CHUNK + 1, F.lit(CHUNK)), F.struct(zero.alias("at"), none.alias("out")), step)
        return F.transform(F.sequence(zero, F.floor((F.size(pairs) - 1) / CHUNK).cast("int")), one)

    def placed(parts):
        start = F.struct(zero.alias("at"), F.array().cast("array<int>").alias("all"))
        offsets = F.aggregate(parts, start, lambda acc, p: F.struct((acc["at"] + p["at"]).alias("at"), F.array_append(acc["all"], acc["at"]).alias("all")), lambda acc: acc["all"])
        move = lambda x, by: F.struct((x["s"] + by).alias("s"), (x["e"] + by).alias("e"), x["v"].alias("v"), x["word"].alias("word"), x["two"].alias("two"))
        return F.flatten(F.zip_with(parts, offsets, lambda p, by: F.transform(p["out"], lambda x: move(x, by))))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.when(F.regexp_like(text, F.lit(pattern)), _let(_let(pairs, chunks), placed)).otherwise(none)


def _before(gap: Column) -> Column:
    """A gap with its white space as spaces and none at its end, lower case; empty unless white space ends it."""
    plain = F.lower(F.translate(gap, "\t\n\x0b\f\r", "     "))
    return F.when(F.endswith(plain, F.lit(" ")), F.rtrim(plain)).otherwise(F.lit(""))


def _last_words(before: Column, n: int) -> Column:
    """The last n words of what _before gives, joined by a space; empty if there are fewer."""
    last = F.substring_index(before, " ", -1)
    if n == 1:
        return last
    rest = F.rtrim(F.left(before, F.char_length(before) - F.char_length(last)))
    return F.when(rest != "", F.concat(F.substring_index(rest, " ", -1), F.lit(" "), last)).otherwise(F.lit(""))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]+", "")


def _luhn(v: Column) -> Column:
    d = _digits(v)

    def add(acc, i):
        x = F.substr(d, F.char_length(d) - i + 1, F.lit(1)).cast("int") * (2 - i % 2)
        return acc + F.when(x > 9, x - 9).otherwise(x)

    total = F.aggregate(F.sequence(F.lit(1), F.char_length(d)), F.lit(0), add)
    return F.char_length(d).between(16, 19) & (total % 10 == 0)


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(v, r"\.", -1), lambda p: F.char_length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(
            F.split(v, r"\.", -1), lambda p: F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(0)) <= 255
        )
    if kind == "card":
        return _luhn(v)
    if kind == "phone":
        return F.char_length(_digits(v)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches of the kind's pattern; those that fail its check are dropped."""
    raw = found(text, PATTERNS[kind])
    if kind == "email":
        return F.when(F.contains(text, F.lit("@")), raw).otherwise(F.array().cast(_SPAN))
    return F.filter(raw, lambda x: _valid(kind, x["v"]))


def _joined(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat(F.lit(f"{kind}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))


def spans(docs: DataFrame) -> DataFrame:
    """key, doc_id, one array of base spans per kind, and the candidate tokens outside them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", text.alias("text")).withColumn("key", F.xxhash64("text"))
    df = df.select("key", "doc_id", *[base_spans(F.col("text"), k).alias(k) for k in KINDS], found(F.col("text"), CANDIDATE).alias("raw"))
    return stage(df, "pii-spans")


def _occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """head, total: how often each pattern, a word or two words in a row, occurs in the corpus.

    A text's words are put together with their followers; few of them are patterns, so the filter comes before the counting
    where the patterns can be broadcast, and after it else.
    """
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != "")
    both = lambda ws: F.concat(ws, F.zip_with(F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 1, F.lit(0))), F.slice(ws, F.lit(2), F.size(ws)), lambda x, y: F.concat(x, F.lit(" "), y)))
    runs = docs.select(F.explode(_let(words, both)).alias("head"))
    heads = stage(patterns.select(F.col("pattern").alias("wanted")).distinct(), "pii-words")
    if heads.count() <= common.BROADCAST_ROWS:
        return runs.join(F.broadcast(heads), F.col("head") == F.col("wanted"), "left_semi").groupBy("head").agg(F.count(F.lit(1)).alias("total"))
    return runs.groupBy("head").agg(F.count(F.lit(1)).alias("total")).join(heads.hint("merge"), F.col("head") == F.col("wanted"), "left_semi")


def discover(docs: DataFrame, df: DataFrame) -> DataFrame:
    """key, doc_id, kind, s, e of identifiers that no base pattern matches, found by bootstrapping.

    The word before a base span, and the two words before it, are patterns of its kind. A pattern's confidence is the
    share of all its occurrences, in the whole corpus, that an identifier of the kind follows; each counts with its own
    confidence, 1 for a base span, else the noisy-or of the confidences of the one-word patterns it occurs with, or of
    the two-word ones if that is more: two words say again what the last one said, so they are not added to it. TURNS turns
    spread the confidence over the graph of patterns and identifiers; tokens of the kind's shape that reach CONFIDENCE
    are found, wherever they stand: one without a word before it has no part in the graph, but may be known from elsewhere.
    """

    def seed(kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x["word"].alias("word"), x["two"].alias("two"), F.lower(x["v"]).alias("value")))

    def contexts(rows: DataFrame) -> DataFrame:
        """kind, pattern, words, value, n of rows with kind, word, two, value."""
        pairs = F.array(*[F.struct(F.col(c).alias("pattern"), F.lit(n).alias("words")) for c, n in (("word", 1), ("two", 2))])
        long = rows.select("kind", "value", F.explode(pairs).alias("x")).select("kind", "x.pattern", "x.words", "value").where("pattern <> ''")
        return long.groupBy("kind", "pattern", "words", "value").agg(F.count(F.lit(1)).alias("n"))

    some = F.greatest(*[F.size(k) for k in KINDS]) > 0
    seeds = stage(contexts(df.where(some).select(F.explode(F.concat(*[seed(k) for k in KINDS])).alias("x")).select("x.*")), "pii-seeds")
    support = seeds.groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("values")).where(F.col("values") >= SUPPORT)
    patterns = stage(support.select("kind", "pattern"), "pii-patterns")
    occurs = stage(_occurrences(docs, patterns), "pii-occurrences")

    tokens = df.where(F.size("raw") > 0).select("key", "doc_id", *KINDS, F.explode("raw").alias("x"))
    trimmed = F.regexp_replace(F.col("x.v"), r"[.,;:!?)\]}\"'*#$%&]++$", "")
    apart = F.lit(True)
    for kind in KINDS:
        apart = apart & ~F.exists(F.col(kind), lambda b: (b["s"] < F.col("x.e")) & (F.col("x.s") < b["e"]))
    tokens = tokens.where(apart).select(
        "key", "doc_id", F.col("x.s").alias("s"), (F.col("x.s") + F.char_length(trimmed)).alias("e"), F.lower(trimmed).alias("value"), F.col("x.word").alias("word"), F.col("x.two").alias("two")
    )
    kinds = F.array_compact(F.array(*[F.when(F.col("value").rlike(SHAPES[k]), F.lit(k)) for k in KINDS]))
    shaped = stage(tokens.select("key", "doc_id", "s", "e", F.explode(kinds).alias("kind"), "word", "two", "value"), "pii-candidates")

    known = seeds.select("kind", "value").distinct().withColumn("seed", F.lit(True))
    edges = (
        seeds.unionByName(contexts(shaped))
        .groupBy("kind", "pattern", "words", "value")
        .agg(F.sum("n").alias("n"))
        .join(known, ["kind", "value"], "left")
    )
    edges = edges.join(patterns, ["kind", "pattern"]).join(occurs, F.col("pattern") == F.col("head"))
    edges = stage(
        edges.select("kind", "pattern", "words", "value", "n", "total", F.coalesce("seed", F.lit(False)).alias("seed")).withColumn("conf", F.col("seed").cast("double")), "pii-graph"
    )
    for _ in range(TURNS):
        scored = edges.groupBy("kind", "pattern").agg(F.least(F.lit(0.999), F.sum(F.col("n") * F.col("conf")) / F.max("total")).alias("p"))
        by_words = [1 - F.exp(F.sum(F.when(F.col("words") == n, F.log(1 - F.col("p"))).otherwise(0.0))) for n in (1, 2)]
        of_value = (
            edges.drop("conf")
            .join(scored, ["kind", "pattern"])
            .groupBy("kind", "value")
            .agg(F.max("seed").alias("seed"), F.greatest(*by_words).alias("c"))
            .select("kind", "value", F.when(F.col("seed"), F.lit(1.0)).otherwise(F.col("c")).alias("conf"))
        )
        edges = stage(edges.drop("conf").join(of_value, ["kind", "value"]), "pii-graph")
    sure = edges.where(~F.col("seed") & (F.col("conf") >= CONFIDENCE)).select("kind", "value").distinct()
    return stage(shaped.join(sure, ["kind", "value"], "left_semi").select("key", "doc_id", "kind", "s", "e"), "pii-found")


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the base spans of each kind (arrays of s, e, v), and found: those discovered.

    Whole texts, very long ones too, are read in time in proportion to their length; null counts as empty and has no
    spans. Ties and repeated rows have equal spans, in order of their places. Other columns are
    ignored; an empty table gives an empty result.
    """
    df = spans(docs)
    more = discover(docs, df)
    grouped = more.groupBy("key", "doc_id").agg(F.array_sort(F.collect_set(F.struct("kind", "s", "e"))).alias("found"))
    grouped = grouped.select(F.col("key").alias("fkey"), F.col("doc_id").alias("fdoc"), "found")
    same = (F.col("key") == F.col("fkey")) & F.col("doc_id").eqNullSafe(F.col("fdoc"))
    return df.drop("raw").join(grouped, same, "left").drop("key", "fkey", "fdoc").withColumn("found", F.coalesce("found", F.array().cast("array<struct<kind:string,s:int,e:int>>")))


def _places(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))


def _of_kind(kind: str) -> Column:
    return F.filter("found", lambda x: x["kind"] == kind)


def query(spark, sf_dir: str) -> DataFrame:
    """The digests of the spans. n_* and base_sha256 count base spans; spans and has_pii have the discovered ones too."""
    df = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.concat(*[_joined(k, F.col(k)) for k in KINDS])
    both = [_joined(k, F.array_sort(F.concat(_places(F.col(k)), _places(_of_kind(k))))) for k in KINDS]
    return df.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*both), ",").alias("spans"),
        F.size("found").cast("long").alias("n_found"),
        (F.greatest(*[F.size(k) for k in [*KINDS, "found"]]) > 0).alias("has_pii"),
    )
