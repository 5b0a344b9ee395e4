import base64
import hashlib
import math
import random
import re
import time
import zlib

import pyarrow as pa
import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from rillwave.llm import bpe, chat, html_text, language, toxicity

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(bpe.load_ranks(open(PATH, "rb").read()))


def random_texts(n, seed=1):
    rng = random.Random(seed)
    parts = ["a", "aa", "th", "e", " ", "  ", "\n", "é", "ß", "日本", "語", "!", "!!", "'s", "1", "22", "́", "😀", "zz", "in", "ing", "A", "\xa0", "\x85"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_bpe_encodes_as_the_library(coder, reference):
    for text in [*random_texts(1500), "a" * 3000, " " * 500, "ab" * 2000, "日" * 999]:
        ids = coder.encode(text)
        assert ids == reference.encode_ordinary(text) and coder.decode(ids) == text.encode()


def test_prefix_table_appends_and_edits(coder):
    rng = random.Random(3)
    for text in random_texts(150, 2):
        data, extra = text.encode(), b"ing the"
        table = bpe.PrefixTable(coder.vocabulary, data)
        table.append(extra)
        assert table.ids() == bpe.PrefixTable(coder.vocabulary, data + extra).ids()
        at = rng.randint(0, len(data))
        removed = rng.randint(0, len(data) - at)
        table.edit(at, removed, b"xyz")
        assert table.data == data[:at] + b"xyz" + data[at + removed :] + extra
        assert table.ids() == bpe.PrefixTable(coder.vocabulary, table.data).ids()
    long = bpe.PrefixTable(coder.vocabulary, b"the quick brown fox " * 500)
    assert long.edit(100, 1, b"Q") < 300


def test_text_table_grows(coder, reference):
    text = "".join(random_texts(30, 5))
    table = bpe.TextTable(coder)
    for at in range(0, len(text), 7):
        table.append(text[at : at + 7])
    assert table.ids() == reference.encode_ordinary(text)


def test_text_table_grows_inside_contractions(coder, reference):
    rng = random.Random(7)
    parts = ["'", "r", "e", "v", "l", "ll", "'re", "'ve", "'ll", "they", " ", "  ", "\n", "!", "1", "é"]
    texts = ["they're here", "you'll", "I've", "we'll've", *["".join(rng.choice(parts) for _ in range(30)) for _ in range(200)]]
    for text in texts:
        for at in range(len(text) + 1):
            table = bpe.TextTable(coder, text[:at])
            table.append(text[at:])
            assert table.ids() == reference.encode_ordinary(text)
        letters = bpe.TextTable(coder)
        for c in text:
            letters.append(c)
        assert letters.ids() == reference.encode_ordinary(text)


def test_bpe_edges(edge_docs, no_docs, reference):
    rows = bpe.encode_decode(edge_docs, PATH, ("ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in edge_docs.collect()}
    assert len(rows) == 11
    for r in rows:
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert (r["ids"], r["n_tokens"], bytes(r["decoded"]).decode()) == (ids, len(ids), texts[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encode_decode(no_docs, PATH).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>Site</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>We use the cookies, and that is what it is for all of you.</p></div>
<article><h1>The title</h1><p>It was <b>a bright</b> cold day in April, and the clocks were striking&nbsp;thirteen &amp; more of the same for
all<br>of us.</p><p>Short.<p>And this is the last of the paragraphs that we have in it, so that it will be good.<!-- no -->
<div class="comments"><p>I think that this is the best of all and it was good for me.</p></div></article>
<div id="sidebar"><p>The and of is in the for to be that this is it and it was all that we had.</p></div><form><p>Sign up</p></form><footer>&copy; us</footer></body></html>"""


def test_html_main_text():
    text, _ = html_text.main_text(PAGE)
    assert text == (
        "The title\nIt was a bright cold day in April, and the clocks were striking thirteen & more of the same for all of us.\nShort.\n"
        "And this is the last of the paragraphs that we have in it, so that it will be good."
    )
    div = PAGE.replace("<article>", '<div class="post_content wide">').replace("</article>", "</div>")
    assert html_text.main_text(div)[0] == text
    plain = "<div>The quick brown fox is in the house and it was not for the dog that he had been with all of the day.</div><p>ok</p>"
    assert html_text.main_text(plain)[0].endswith("\nok")


def test_html_end_tags_take_time_in_proportion():
    def seconds(n):
        began = time.perf_counter()
        html_text.main_text("<div>" * n + "</td>" * n)
        return time.perf_counter() - began

    assert seconds(40_000) < 8 * seconds(10_000) + 0.2  # 16 times, if it were quadratic


def test_html_edges(spark):
    pages = [(1, None, None), (2, "u", ""), (None, "u", "<p>x"), (4, "u", "<" * 5000), (5, "u", '<p class="' * 500), (6, "u", "<article><p>a&amp;b &#8364; &am <b"), (6, "u", "<article><p>a&amp;b &#8364; &am <b"), (7, "u", "<article>" + "<p>the word of it</p>" * 20_000)]
    df = html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit(1)))
    got = df.collect()
    assert len(got) == 8 and [r["text"] for r in got if r["page_id"] == 6] == ["a&b € &am"] * 2 and {r["text"] for r in got if r["page_id"] in (1, 2)} == {""}
    assert next(r["n_chars"] for r in got if r["page_id"] == 7) == 20_000 * 15 - 1
    assert html_text.extract(df.limit(0).withColumn("html", F.lit(""))).count() == 0


def test_chat_round_trip(spark):
    rng = random.Random(9)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "ok", " ", "é😀", "<<SYS>>", "\n", "s>", "\\\\"]
    rows = [(rng.randint(0, 40), t, rng.choice(["user", "assistant", "tool[INST]\n", None]), rng.choice([None, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))])) for t in range(800)]
    rows += [(None, 1, "user", "x"), (None, None, "assistant", "y"), (99, 1, "assistant", "z" * 300_000), (98, 5, "user", "tie b"), (98, 5, "user", "tie a"), (98, 5, "user", "tie a")]
    df = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)))
    order = lambda x: ((x[1] is not None, x[1] or 0), (x[2] is not None, x[2] or ""), (x[3] is not None, x[3] or ""))
    got = df.collect()
    assert len(got) == len({r[0] for r in rows})
    digests = {r["conv_id"]: r for r in chat.read_back(df).collect()}
    for r in got:
        turns = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == r["conv_id"]), key=order)]
        assert chat.read_turns(r["formatted"]) == turns and r["n_turns"] == len(turns)
        trained = "".join(t for role, t in turns if role == "assistant")
        d = digests[r["conv_id"]]
        assert d["loss_chars"] == len(trained) and d["loss_sha256"] == hashlib.sha256(trained.encode()).hexdigest() and d["formatted_chars"] == len(r["formatted"])
    assert chat.read_back(df.limit(0)).count() == 0


def test_chat_conversations_cross_batches():
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "c"), (2, 1, "assistant", "d"), (2, 2, "user", "e")]
    names = ["conv_id", "turn", "role", "text"]
    whole = pa.RecordBatch.from_pylist([dict(zip(names, t, strict=True)) for t in turns])
    for cut in range(1, 5):
        out = pa.Table.from_batches(list(chat._format(iter([whole.slice(0, cut), whole.slice(cut)])))).to_pylist()
        assert [(r["conv_id"], r["n_turns"]) for r in out] == [(1, 2), (2, 3)]
        assert out[1]["formatted"] == "<s>user[INST]c</s><s>assistant[INST]d</s><s>user[INST]e</s>"


def test_chat_slices_change_nothing(monkeypatch):
    rng = random.Random(13)
    rows = [(i // 3, i, rng.choice(["user", "assistant", None]), rng.choice([None, "", "é" * 40, "a <s> b" * rng.randint(1, 9)])) for i in range(90)]
    batch = pa.RecordBatch.from_pylist([dict(zip(["conv_id", "turn", "role", "text"], r, strict=True)) for r in rows])
    whole = pa.Table.from_batches(list(chat._format(iter([batch])))).to_pylist()
    monkeypatch.setattr(chat, "SLICE_BYTES", 90)
    monkeypatch.setattr(chat, "SCATTER_BYTES", 7)
    parts = list(chat._format(iter([batch])))
    assert len(parts) > 8 and pa.Table.from_batches(parts).to_pylist() == whole
    monkeypatch.setattr(chat, "MOST_BYTES", 50)
    with pytest.raises(ValueError, match="does not fit"):
        list(chat._format(iter([batch])))


def test_viterbi_matches_brute_force():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    scores = rng.normal(size=(12, 3)).astype(np.float32)
    counts = np.array([4, 0, 5, 1])
    ids = rng.integers(0, 12, counts.sum())
    starts = np.cumsum(counts) - counts
    got = language.viterbi(scores, ids, starts, counts, switch=1.0)
    for s, n in zip(starts, counts, strict=True):
        value = lambda path: sum(scores[ids[s + t], path[t]] for t in range(n)) - sum(a != b for a, b in itertools.pairwise(path))  # noqa: B023,E731
        best = max((value(p) for p in itertools.product(range(3), repeat=int(n))), default=0)
        assert abs(value(got[s : s + n]) - best) < 1e-4


@pytest.fixture(scope="module")
def language_docs(spark):
    rng = random.Random(6)
    words = {"en": "the of and that with house river green walking".split(), "de": "der die und nicht mit haus fluss grün gehen".split(), "ru": "дом река и что зелёный идти".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang) for i, lang in enumerate(rng.choice(list(words)) for _ in range(400))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_held_out_accuracy(language_docs, edge_docs, no_docs):
    model = language.train(language_docs)
    rows = language.identify(language_docs, model).join(language_docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 80 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.98
    mixed = language.Labeller(model).label(["the house and the river der fluss und das haus ist grün nicht", "12 !!", "дом и река"], spans=True)
    assert [s["lang"] for s in mixed[0][2]] == ["en", "de"] and mixed[1][0] == "und" and mixed[2][0] == "ru"
    edge = {r["doc_id"]: r for r in language.identify(edge_docs, model).collect()}
    assert {edge[i]["lang_pred"] for i in (1, 2, 3)} == {"und"} and edge[8]["lang_pred"] != "und" and not edge[None]["held_out"]
    assert language.identify(no_docs, model).count() == 0
    assert {r["lang_pred"] for r in language.identify(edge_docs, language.train(no_docs)).collect()} == {"und"}


def ids_to_learn(n):
    return [i for i in range(4 * n) if zlib.crc32(str(i).encode()) % 3 != 1][:n]


def test_language_reads_all_letters_of_a_word(spark):
    rng = random.Random(14)
    zh, ja, en = (lambda: "".join(rng.choice("的是不我一有在人这中大来上国") for _ in range(40))), (lambda: "".join(rng.choice("のはをにがとでもたし日本人中大") for _ in range(40))), (lambda: " ".join(rng.choice(["the", "house", "river", "xxxx"]) for _ in range(20)))
    de = lambda: " ".join(rng.choice(["yyyy", "haus", "fluss"]) for _ in range(20))
    rows = [(i, (zh, ja, en, de)[k % 4](), ("zh", "ja", "en", "de")[k % 4]) for k, i in enumerate(ids_to_learn(400))]
    labeller = language.Labeller(language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    late = labeller.label(["x" * 64 + "y" * 5000, "river" + zh(), "house" + ja(), zh() * 3 + "のはをにがとでもたし" * 40], spans=True)
    assert [x[0] for x in late] == ["de", "zh", "ja", "ja"] and late[0][1] < 1
    assert [s["lang"] for s in late[0][2]] == ["en", "de"] and late[0][2][1]["end"] == 5064
    assert labeller.label(["\u212aelvin \u0130stanbul \u2126"], spans=True)[0][2]


def test_language_pieces_hold_every_letter():
    text = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    found = language.pieces(text)
    assert "".join(found) == "".join(re.findall(r"[^\W\d_]+", text))
    assert all(len(p) <= language.PIECE and len({language.script(c) for c in p}) == 1 for p in found)


def test_more_than_300_languages_are_learnt(spark):
    rng = random.Random(15)
    words = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(6)] for _ in range(320)]
    rows = [(i, " ".join(rng.choice(words[k % 320]) for _ in range(12)), f"l{k % 320:03d}") for k, i in enumerate(ids_to_learn(1280))]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    labels = language.Labeller(model).label([" ".join(w) for w in words])
    assert len(model.languages) == 320 and sum(x[0] == f"l{k:03d}" for k, x in enumerate(labels)) > 315


def test_language_scores_match_a_dense_model(spark, language_docs):
    model = language.train(language_docs, per_language=10**6)
    counts = {}
    for r in language_docs.collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            for p in language.pieces(r["text"]):
                for g in language.grams(p):
                    counts.setdefault(r["lang"], {})[g] = counts.setdefault(r["lang"], {}).get(g, 0) + 1
    grams = {g for c in counts.values() for g in c}
    for word in ["house", "grün", "unseen", "wxyz"]:
        want = [sum(math.log((counts[x].get(g, 0) + 0.5) / (sum(counts[x].values()) + 0.5 * (len(grams) + 1))) if g in grams else math.log(0.5 / (sum(counts[x].values()) + 0.5 * (len(grams) + 1))) for g in language.grams(word)) for x in ("de", "en")]
        assert all(abs(a - b) < 1e-3 for a, b in zip(model.word(word)[:2], want, strict=True))


def test_samples_have_one_row_of_a_repeated_id(spark):
    from rillwave.llm.sampling import class_sample

    rows = [(7, "en", "b")] * 500 + [(7, "en", "a")] + [(i, "de", "c") for i in range(2000)]
    got = class_sample(spark.createDataFrame(rows, "doc_id long, lang string, text string"), "doc_id", "lang", 100)
    by = {lang: [r for r in got.collect() if r["lang"] == lang] for lang in ("en", "de")}
    assert len(by["en"]) <= 1 and all(r["text"] == "a" for r in by["en"]) and 50 < len(by["de"]) < 160


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_lexicon_automaton_matches_brute_force():
    rng = random.Random(8)
    terms = ["idiot", "moron", "trash", "worthless", "disgusting", "scum", "abcdefghij"]
    lexicon = toxicity.Lexicon(dict.fromkeys(terms, 1.0), {})
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            rng.choice([lambda: w.insert(k, rng.choice("abxy")), lambda: w and w.pop(min(k, len(w) - 1)), lambda: w and w.__setitem__(min(k, len(w) - 1), rng.choice("abxy"))])()
        word = "".join(w)
        near = {(levenshtein(word, t), t) for t in terms if levenshtein(word, t) <= toxicity.Lexicon.edits(t)}
        hit = lexicon.match(word)
        assert (hit is None) == (not near) and (hit is None or (hit[1], hit[0]) == min(near)), (word, hit, near)
    stemmed = toxicity.Lexicon({}, {"abc": 0.5})
    assert stemmed.match("ABCxyz") == ("abc", -1) and stemmed.match("abx") is None


def test_toxicity_held_out(spark, edge_docs, no_docs):
    rng = random.Random(10)
    common, bad = [f"word{i}" for i in range(80)], ["idiot", "worthless", "pathetic"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        text = [rng.choice(common) for _ in range(60)]
        if toxic:
            for _ in range(3):
                text[rng.randrange(60)] = rng.choice(bad)
        elif i % 50 == 1:
            text[20:20] = ["he", "said", '"idiot"', "quoting", "the", "word"]
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, None, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    scorer = toxicity.train(docs, marks)
    got = toxicity.score(docs, scorer).join(marks.where("toxic IS NOT NULL"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and sum(r["predicted"] == r["toxic"] for r in got) / len(got) > 0.98
    assert scorer.score("you are a w0rthless idi0t and patetic") > scorer.score('she quoted the word "idiot" in it') and scorer.score("") < 0.5
    assert toxicity.score(edge_docs, scorer).count() == 11 and toxicity.score(no_docs, scorer).count() == 0
    assert 0 <= toxicity.train(no_docs, marks.limit(0)).score("x") <= 1


def toxic_tables(spark, toxic, clean):
    """Learnable documents and labels: so many filler words around the given texts."""
    rng = random.Random(4)
    filler = lambda: " ".join(f"word{rng.randrange(80)}" for _ in range(20))
    ids = [i for i in range(6 * (len(toxic) + len(clean))) if zlib.crc32(str(i).encode()) % 3 != 1]
    texts = [(1, t) for t in toxic] + [(0, t) for t in clean]
    rows = [(i, f"{filler()} {t} {filler()}", label) for i, (label, t) in zip(ids, texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", F.lit(1).alias("quality"), "toxic")


def test_terms_under_a_stem_match_with_edits(spark):
    scorer = toxicity.train(*toxic_tables(spark, ["idiot"] * 40 + ["idiots idiotic"] * 4, [""] * 150))
    assert "idio" in scorer.lexicon.stems and "idiot" in scorer.lexicon.terms
    for word, hit in {"idiot": ("idiot", 0), "id1ot": ("idiot", 1), "1diot": ("idiot", 1), "idiotism": ("idio", -1)}.items():
        assert scorer.lexicon.match(word) == hit


def test_one_quoted_misspelling_stays_a_misspelling(spark):
    toxic = ["idiot"] * 30 + ["idi0t"] * 10 + ["idiom"]
    scorer = toxicity.train(*toxic_tables(spark, toxic, ['he wrote "idi0t" there'] + ["an idiom"] * 4 + [""] * 60))
    assert scorer.lexicon.match("idi0t") is not None and scorer.lexicon.match("idiom") is None


def test_long_words_are_terms_and_matched_whole(spark):
    long = "unspeakably" * 8
    scorer = toxicity.train(*toxic_tables(spark, [long] * 30, [""] * 90))
    assert scorer.lexicon.match(long) == (long, 0) and scorer.lexicon.match(long[:-1] + "x")[0] in (long, long[:4])
    assert toxicity.Lexicon({long: 1.0}, {}).match(long[:40] + long[41:]) == (long, 1) and toxicity.Lexicon({long: 1.0}, {}).match("z" + long[3:]) is None


def test_every_term_that_passes_is_learnt(spark):
    words = [f"{a}{b}{c}zz" for a in "bcdfghjklm" for b in "aeiou" for c in "bcdfghjklmnpqrst"]
    scorer = toxicity.train(*toxic_tables(spark, [" ".join(words)] * 8, [""] * 40))
    assert len(words) == 800 and set(words) <= set(scorer.lexicon.terms)


def test_score_matches_a_second_reading(spark):
    scorer = toxicity.train(*toxic_tables(spark, ["idiot moron"] * 20 + ["idi0t"] * 20, ['he wrote "idiot" there'] * 5 + [""] * 100))
    for text in ["", "you idiot", "a m0ron, an idiot", 'she said "idiot" twice', "plain words only"]:
        x = scorer.features(text)
        z = [max(-6.0, min(6.0, (a - m) / s)) for a, m, s in zip(x, scorer.mean, scorer.scale, strict=True)]
        want = 1 / (1 + math.exp(-sum(a * w for a, w in zip([*z, 1.0], scorer.weights, strict=True))))
        assert abs(scorer.score(text) - want) < 1e-9
        hits = [w for w in re.findall(r"\w+", text.lower()) if any(levenshtein(w, t) <= toxicity.Lexicon.edits(t) for t in scorer.lexicon.terms)]
        assert round(math.expm1(x[4])) == len({min((levenshtein(w, t), t) for t in scorer.lexicon.terms)[1] for w in hits})


def test_lexicon_forgets_states_without_changing_matches(monkeypatch):
    rng = random.Random(5)
    terms = {"".join(rng.choice("abcd") for _ in range(rng.randint(4, 12))): 1.0 for _ in range(60)}
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    words += [t[:i] + rng.choice("abcd") * rng.randint(0, 2) + t[i + 1 :] for t in terms for i in range(len(t))]
    whole = toxicity.Lexicon(terms, {"abca": 1.0})
    want = [whole.match(w) for w in words]
    for states in (40, 2000):
        monkeypatch.setattr(toxicity, "STATES", states)
        small = toxicity.Lexicon(terms, {"abca": 1.0})
        assert [small.match(w) for w in words] == want
        assert small.kept == sum(len(a.states) for a in small.automata.values()) < whole.kept
