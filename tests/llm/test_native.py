import hashlib
import random
import re
import time

import pytest

from pyspark.sql import functions as F

from rillwave.llm import common, exact_dedup, mixing, pii, quality

WS = r"[\x20\x09-\x0D]+"


def plans_without_python(df):
    return "Python" not in (plan := df._jdf.queryExecution().toString()) and "Arrow" not in plan


@pytest.fixture(autouse=True)
def staged_without_python(monkeypatch):
    """All tables that the operators of this file write on their way are made without Python, too."""
    from pyspark.sql.readwriter import DataFrameWriter

    write = DataFrameWriter.parquet

    def watched(self, path, *args, **kwargs):
        assert plans_without_python(self._df)
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", watched)


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_exact_dedup_edges(edge_docs, no_docs):
    df = exact_dedup.exact_dedup(edge_docs)
    assert plans_without_python(df)
    got = by_id(df.collect())
    assert {i: (r[0]["keep_id"], r[0]["group_size"], r[0]["kept"]) for i, r in got.items() if i in (1, 2, 3, 5, 6, 7)} == {
        1: (3, 3, False), 2: (3, 3, False), 3: (3, 3, True), 5: (6, 4, False), 6: (6, 4, True), 7: (6, 4, False),
    }
    assert len(got[6]) == 2 and got[1][0]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert (got[None][0]["keep_id"], got[None][0]["kept"]) == (None, True)
    assert exact_dedup.exact_dedup(no_docs).count() == 0


def test_exact_dedup_survives_hash_collisions(spark):
    rows = [(i, t) for i, t in enumerate(["ab", "a b", "cd", "ef", "c d", "gh"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(df, content_hash=lambda norm: F.lit(1)).collect()}
    assert got == {0: 1, 1: 1, 2: 4, 3: 3, 4: 4, 5: 5}


def test_mixing_edges(edge_docs, no_docs):
    df = mixing.mix(edge_docs)
    assert plans_without_python(df)
    assert df.columns == [*edge_docs.columns, "n_copies_", "copy_no_", "shuffle_key_"]
    assert {r["rate"] for r in df.collect()} <= {7}
    assert mixing.mix(no_docs).count() == 0
    assert mixing.mix(edge_docs, weights={"b": 0.0}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(edge_docs, weights={"b": -1.0})


def test_mixing_meets_the_rates(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    df = mixing.mix(docs, weights={"hot": 3.0, "s1": 1.0})
    n = {r["source"]: r["count"] for r in df.groupBy("source").count().collect()}
    assert set(n) == {"hot", "s1"} and abs(n["hot"] / 22_500 - 1) < 0.03 and abs(n["s1"] / 7_500 - 1) < 0.05
    keys = [r["shuffle_key"] for r in df.collect()]
    assert len(set(keys)) == len(keys)


@pytest.mark.parametrize("rate", [0.0, 0.3, 4.0, 599.0, 601.0, 5000.0])
def test_poisson_quantiles(spark, rate):
    df = spark.range(4000).select(mixing.poisson_count((F.col("id") + 0.5) / 4000, F.lit(rate)).alias("k"))
    r = df.agg(F.avg("k").alias("m"), F.var_pop("k").alias("v")).first()
    assert abs(r["m"] - rate) < 0.01 * rate + 0.01 and abs(r["v"] - rate) < 0.02 * rate + 0.02


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_match_brute_force(spark, edge_docs):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a ", "b ", "cc\n", "#| ", "\t", "é "]) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string").withColumn("lang", F.lit("x")).withColumn("source", F.lit("y"))
    df = quality.quality(docs.unionByName(edge_docs.select("doc_id", "text", "lang", "source")))
    assert plans_without_python(df)
    want = dict(enumerate(texts, 100)) | {r["doc_id"]: r["text"] for r in edge_docs.collect()}
    for r in df.collect():
        n, chars, symbols, dup, repeats = base_counts(want[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeats)
        assert r["base_failed"] == (n < 20 or 100 * repeats > 30 * n) and not (r["base_failed"] and r["kept"])


def test_quality_edges(edge_docs, no_docs):
    got = quality.quality(edge_docs).collect()
    assert len(got) == 11 and not any(r["kept"] for r in got)
    assert quality.quality(no_docs).count() == 0


def test_quality_follows_the_source(spark):
    prose = " ".join(f"w{i}ord" for i in range(150))
    code = " ".join(f"w{i}ord #" if i % 2 else f"w{i}ord" for i in range(150))
    rows = [(i, f"{prose} {i}", "en", "prose") for i in range(60)] + [(100 + i, f"{code} {i}", "en", "code") for i in range(60)] + [(999, code, "en", "prose")]
    got = {r["doc_id"]: r["kept"] for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [i for i, kept in got.items() if not kept] == [999]


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_spans_match_brute_force(spark, edge_docs):
    rng = random.Random(2)
    parts = ["1.2.3.4", ".5.6", "300.1.1.1", "a@b.c", "%d@e.f", "4111111111111111", "4111 1111 1111 1111", "+1 (017) 555-7713", "+", "1", " ", "-", "()", "é😀", "x", "\n", "0001.2.3.4", "@", ".", "5", "12345678901234567890"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(400)] + ["9" * 30_000, "a" * 30_000, "1 " * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string").unionByName(edge_docs.select("doc_id", "text"))
    df = pii.personal_data(docs)
    assert plans_without_python(df)
    want = dict(enumerate(texts, 100)) | {r["doc_id"]: r["text"] for r in edge_docs.collect()}
    rows = df.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert [(k, s["s"], s["e"]) for k in pii.KINDS for s in r[k]] == base_spans(want[r["doc_id"]] or "")


def test_pii_finds_identifiers_by_context(spark, no_docs):
    rows = [(i, f"Please write to acct-mail: user{i}@host.example.org today, or call the office") for i in range(30)]
    rows += [(100, "Please write to acct-mail: jim[at]host.example-org today"), (101, "the 20231231 report and the jim[at]host.example-org thing")]
    got = {r["doc_id"]: r["found"] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(f["kind"], f["s"], f["e"]) for f in got[100]] == [("email", 27, 50)]
    assert [f["kind"] for f in got[101]] == ["email"]  # the same identifier, elsewhere
    assert not any(got[i] for i in range(30))
    assert pii.personal_data(no_docs).count() == 0


def test_results_do_not_depend_on_broadcasts(edge_docs, monkeypatch):
    results = []
    for rows in (200_000, -1):
        monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
        mixed, judged, spans = mixing.mix(edge_docs), quality.quality(edge_docs), pii.personal_data(edge_docs)
        results.append([sorted(map(str, df.collect())) for df in (mixed, judged, spans)])
    assert results[0] == results[1]


def test_quality_judges_large_measures_unclipped(spark):
    def text(i):
        return " ".join(str(1000 + 30 * i + k).rjust(60 + i, "x") for k in range(25))

    docs = spark.createDataFrame([(i, text(i), "zh", "web") for i in range(0, 201, 2)], "doc_id long, text string, lang string, source string")
    assert all(r["kept"] for r in quality.quality(docs).collect())


def test_quality_limits_are_exact_for_large_values(spark):
    rng = random.Random(5)
    rows = [(f"l{i % 2}", f"s{i % 3}", False, *[int(10 ** rng.uniform(4.5, 9)) for _ in quality.MEASURES]) for i in range(900)]
    df = spark.createDataFrame(rows, "lang string, source string, base_failed boolean, " + ", ".join(f"{m} long" for m, _, _ in quality.MEASURES))
    got = quality.limits_of(df).collect()
    assert len(got) == 6
    for r in got:
        for k, (name, _, _) in enumerate(quality.MEASURES):
            values = sorted(x[3 + k] for x in rows if x[:2] == (r["t_lang"], r["t_source"]))
            assert (r[f"{name}_q1"], r[f"{name}_q3"]) == (values[-(-len(values) // 4) - 1], values[-(-3 * len(values) // 4) - 1])


def test_pii_finds_known_identifiers_without_a_word_before(spark):
    rows = [(i, f"Please write to acct-mail: user{i}@host.example.org today, or call the office") for i in range(30)]
    rows += [(100, "write to acct-mail: jim[at]host.org today"), (101, "write to acct-mail: ann[at]host.org today")]
    texts = {102: "jim[at]host.org wrote", 103: "mail a@b.org, jim[at]host.org, ann[at]host.org", 104: "eve[at]host.org wrote"}
    got = {r["doc_id"]: r["found"] for r in pii.personal_data(spark.createDataFrame(rows + list(texts.items()), "doc_id long, text string")).collect()}
    found = {i: [texts[i][f["s"] : f["e"]] for f in got[i]] for i in texts}
    assert found == {102: ["jim[at]host.org"], 103: ["jim[at]host.org", "ann[at]host.org"], 104: []}


def test_pii_spans_take_time_in_proportion(spark):
    def seconds(n):
        docs = spark.createDataFrame([(1, "+1 (017) 555-7713 a@b.org 1.2.3.4 x " * n)], "doc_id long, text string")
        began = time.perf_counter()
        assert pii.spans(docs).selectExpr("size(email) AS n").first()["n"] == n
        return time.perf_counter() - began

    seconds(100)
    assert seconds(24_000) < 6 * seconds(6_000) + 3  # 16 times, if it were quadratic


def test_pii_takes_very_long_runs(spark):
    texts = ["9" * 200_000, "1.a:" * 50_000, "9 " * 100_000, "a@" * 50_000, "1." * 100_000]
    rows = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == 5


def test_pii_contexts_are_whole_words(spark):
    texts = ["w" * 80 + " a@b.org", "z y" + " " * 70 + "a@b.org", "a@b.org c@d.org", "One\tTWO\n a@b.org", "no_space:a@b.org"]
    got = [[(x["word"], x["two"]) for x in r["email"]] for r in pii.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [[("w" * 80, "")], [("y", "z y")], [("", ""), ("", "")], [("two", "one two")], [("", "")]]


def test_pii_two_words_are_a_pattern(spark):
    rows = [(i, f"Please write to mail box user{i}@host.example.org today, a box of paper and a box of pens") for i in range(30)]
    rows += [(100, "mail box jim[at]host.org"), (101, "a box x7[at]y7 of things")]
    got = {r["doc_id"]: [(f["kind"], f["s"], f["e"]) for f in r["found"]] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == [("email", 9, 24)] and got[101] == []


def discovered(rows):
    """A plain second reading of the discovery: sets and dictionaries, all texts at once."""
    seeds, shaped, texts = [], [], []
    for i, text in rows:
        base = base_spans(text)
        texts.append(re.findall(r"\S+", text.lower()))
        for kind, s, e in base:
            before = [m for m in (re.finditer(PATTERNS[kind], text)) if m.end() <= s]
            seeds.append((kind, *around(text[before[-1].end() if before else 0 : s]), text[s:e].lower()))
        ends = 0
        for m in re.finditer(pii.CANDIDATE, text):
            gap, ends = text[ends : m.start()], m.end()
            if not any(s < m.end() and m.start() < e for _, s, e in base):
                value = re.sub(r"[.,;:!?)\]}\"'*#$%&]+$", "", m[0])
                shaped += [(i, m.start(), m.start() + len(value), kind, *around(gap), value.lower()) for kind in pii.KINDS if re.search(pii.SHAPES[kind], value.lower())]
    known = {(k, v) for k, _, _, v in seeds}
    of = {}
    for k, word, two, v in seeds:
        for n, p in ((1, word), (2, two)):
            if p:
                of.setdefault((k, p, n), []).append(v)
    of = {key: vs for key, vs in of.items() if len(set(vs)) >= pii.SUPPORT}
    for _, _, _, k, word, two, v in shaped:
        for n, p in ((1, word), (2, two)):
            if (k, p, n) in of:
                of[k, p, n].append(v)
    total = {}
    for ws in texts:
        for p in ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])]:
            total[p] = total.get(p, 0) + 1
    conf = {(k, v): float((k, v) in known) for (k, _, _), vs in of.items() for v in vs}
    for _ in range(pii.TURNS):
        score = {key: min(0.999, sum(conf[key[0], v] for v in vs) / total[key[1]]) for key, vs in of.items()}
        for k, v in conf:
            if (k, v) not in known:
                miss = {1: 1.0, 2: 1.0}
                for (kind, p, n), vs in of.items():
                    if kind == k and v in vs:
                        miss[n] *= 1 - score[kind, p, n]
                conf[k, v] = 1 - min(miss.values())
    sure = {x for x, c in conf.items() if c >= pii.CONFIDENCE and x not in known}
    return {(i, k, s, e) for i, s, e, k, _, _, v in shaped if (k, v) in sure}


def around(gap):
    if not re.search(r"\s$", gap):
        return "", ""
    words = gap.lower().split()
    return words[-1] if words else "", " ".join(words[-2:]) if len(words) > 1 else ""


def test_pii_discovery_matches_a_second_reading(spark):
    rng = random.Random(12)
    usual = [("mail", "u{}@h.org"), ("write to", "u{}@h.org"), ("ring me", "+1 555 000 {:04d}"), ("server", "10.0.0.{}")]
    other = [("mail", "u{}[at]h.org"), ("ring me", "(0555) 000 {:04d}"), ("server", "fe80::{}:1"), ("the", "u{}[at]h.org"), ("a box", "{} items"), ("the me", "plain")]
    part = lambda: rng.choice(usual if rng.random() < 0.85 else other)
    rows = [(i, " ".join(f"{context} {made.format(rng.randrange(60))}, so" for context, made in [part() for _ in range(rng.randint(1, 5))])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], f["kind"], f["s"], f["e"]) for r in pii.personal_data(docs).collect() for f in r["found"]}
    want = discovered(rows)
    assert len(want) > 20 and got == want
