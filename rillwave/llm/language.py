"""Language identification: scripts narrow the candidates, Viterbi over per-word scores labels spans."""

from __future__ import annotations

import bisect
import functools
import hashlib
import pickle
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwave.llm.common import join_checked, schema_of, stage
from rillwave.llm.sampling import class_sample, held_out, learnable
from rillwave.plans.workers import importable

#: Labelled documents learnt from, per language (about).
SAMPLE_PER_LANGUAGE = 3_000
#: An n-gram is in the model if it makes up this share of a language's n-grams: at most 1 / SHARE of each language.
SHARE = 1 / 100_000
#: Letters of a piece of a word at most.
PIECE = 24
#: Cells of the model up to which a worker keeps it as a matrix.
DENSE_CELLS = 20_000_000
#: Scores of pieces that are looked up at once; pieces of texts of which the new ones are scored together (about).
SCORED_CELLS, LEARNT_AT_ONCE = 500_000, 100_000
#: Words, and scores of words, that a worker remembers.
REMEMBERED, REMEMBERED_SCORES = 600_000, 6_000_000
#: Log-probability that a change of language between two words costs.
SWITCH = 12.0
#: A script belongs to a language that writes this share of its letters in it.
SCRIPT_SHARE = 0.005
#: Characters of text handled at once (about).
SLICE_CHARS = 20_000_000
UNKNOWN = "und"

# First code point and name of ranges of letters; a range ends where the next begins.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"),
    (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "burmese"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
    (0x20000, "han"), (0x32000, "other"),
)
_FROM = [a for a, _ in SCRIPTS]
_WORDS = re.compile(r"[^\W\d_]+")


def script(piece: str) -> str:
    """The script of a piece's letters, by the first."""
    return SCRIPTS[bisect.bisect_right(_FROM, ord(piece[0])) - 1][1]


@functools.cache
def _pieces() -> re.Pattern:
    """Runs of letters of one script, of PIECE letters at most: what each place of a text falls into."""
    ranges: dict[str, list[str]] = {}
    for (low, name), (high, _) in zip(SCRIPTS, [*SCRIPTS[1:], (sys.maxunicode + 1, "")], strict=True):
        every = "".join(map(chr, range(low, high)))
        for m in _WORDS.finditer(every):
            ranges.setdefault(name, []).append(f"{re.escape(m[0][0])}-{re.escape(m[0][-1])}")
    first, *rest = (f"[{''.join(r)}]{{1,{PIECE}}}" for r in ranges.values())
    return re.compile(f"{first}|(?=[^\\W\\d_])(?:{'|'.join(rest)})")


def pieces(text: str) -> list[str]:
    """The words of a lower-case text, cut where the script changes and after PIECE letters; together all its letters.

    A clause of a script without spaces is one word to a regular expression, and may begin with a name in another
    script: pieces see to it that every letter is scored, under the languages of its own script.
    """
    return _pieces().findall(text)


def grams(word: str) -> list[str]:
    """Character 3-grams of a piece, and the piece itself if it is short."""
    w = f"<{word}>"
    out = [w[i : i + 3] for i in range(len(w) - 2)]
    if len(word) <= 5:
        out.append(f"={word}")
    return out


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, kind (g: n-gram, s: script), what, n; sums over what memory holds."""
    counts: dict[str, Counter] = {}

    def flush():
        rows = [(lang, *key, n) for lang, c in counts.items() for key, n in c.items()]
        counts.clear()
        if rows:
            a, b, c, d = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c), pa.array(d, pa.int64())], ["lang", "kind", "what", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
            mine = counts.setdefault(lang.as_py(), Counter())
            for word, n in Counter(pieces(_lower(text.as_py() or ""))).items():
                mine["s", script(word)] += n
                for g in grams(word):
                    mine["g", g] += n
            if sum(map(len, counts.values())) > 500_000:
                yield from flush()
    yield from flush()


class Model:
    """Naive Bayes over n-grams: log-probabilities per language, and the languages of each script.

    counts are rows of lang, what, n. Held sparsely: what a language has of an n-gram beyond an unseen one's score.
    """

    def __init__(self, languages: list[str], counts: pa.Table, scripts: dict[str, np.ndarray]):
        self.languages, self.scripts = languages, scripts
        langs = counts.column("lang").combine_chunks().dictionary_encode()
        whats = counts.column("what").combine_chunks().dictionary_encode()
        at = {x: i for i, x in enumerate(languages)}
        lang = np.array([at[x] for x in langs.dictionary.to_pylist()], dtype=np.int64)[langs.indices.to_numpy()] if len(counts) else np.zeros(0, dtype=np.int64)
        what, n = whats.indices.to_numpy().astype(np.int64), counts.column("n").to_numpy().astype(float)
        names = whats.dictionary.to_pylist()
        base = np.bincount(lang, weights=n, minlength=len(languages)) + 0.5 * (len(names) + 1)
        self.unseen = np.log(0.5 / base).astype(np.float32)
        order = np.argsort(what, kind="stable")
        self.lang = lang[order].astype(np.int32)
        self.more = (np.log((n + 0.5) / base[lang]) - np.log(0.5 / base[lang])).astype(np.float32)[order]
        self.first = np.append(0, np.cumsum(np.bincount(what, minlength=len(names)))).astype(np.int64)
        self.row = {g: i for i, g in enumerate(names)}

    @functools.cached_property
    def dense(self) -> np.ndarray | None:
        """The same as a matrix with a last row for unseen n-grams, if it is of moderate size: one look-up for a piece."""
        if (len(self.row) + 1) * len(self.languages) > DENSE_CELLS:
            return None
        matrix = np.repeat(self.unseen[None, :], len(self.row) + 1, axis=0)
        matrix[np.repeat(np.arange(len(self.row)), np.diff(self.first)), self.lang] += self.more
        return matrix

    def word(self, word: str) -> np.ndarray:
        """Scores of a piece."""
        return self.words([word])[0]

    def words(self, words: list[str]) -> np.ndarray:
        """Scores of pieces; languages that do not use a piece's script are out, unless none does."""
        found = [grams(w) for w in words]
        total = np.empty((len(words), len(self.languages)), dtype=np.float32)
        if self.dense is not None:
            row, unknown = self.row.get, len(self.row)
            step = max(1, SCORED_CELLS // len(self.languages))
            for at in range(0, len(words), step):
                some = found[at : at + step]
                ends = np.cumsum(np.fromiter(map(len, some), dtype=np.int64, count=len(some)))
                rows = np.fromiter((row(g, unknown) for gs in some for g in gs), dtype=np.int64, count=int(ends[-1]))
                total[at : at + step] = np.add.reduceat(self.dense[rows], np.append(0, ends[:-1]), axis=0)
        else:
            for k, gs in enumerate(found):
                total[k] = self.unseen * np.float32(len(gs))
                for i in filter(lambda i: i is not None, map(self.row.get, gs)):
                    a, b = self.first[i], self.first[i + 1]
                    total[k, self.lang[a:b]] += self.more[a:b]
        names = [script(w) for w in words]
        for name in set(names):
            if name in self.scripts:
                total[np.ix_(np.array([x == name for x in names]), ~self.scripts[name])] = -1e6
        return total


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """A model of all languages of learnable rows (lang not null): counts over a bounded sample of about per_language
    rows for each. What reaches the driver are n-grams of a share of SHARE at least in some language, 1 / SHARE of
    each at most, with their counts in the languages whose sample has them."""
    importable(docs.sparkSession)
    rows = docs.where(learnable(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sample = class_sample(rows, "doc_id", "lang", per_language)
    found = sample.select("lang", "text").mapInArrow(_count_grams, "lang string, kind string, what string, n bigint")
    found = stage(found.groupBy("lang", "kind", "what").agg(F.sum("n").alias("n")), "language-counts")
    ngrams = found.where("kind = 'g'").select("lang", "what", "n")
    sums = ngrams.groupBy(F.col("lang").alias("slang")).agg(F.sum("n").alias("all"))
    often = stage(join_checked(ngrams, stage(sums, "language-sums"), F.col("lang") == F.col("slang"), "inner").where(F.col("n") >= F.col("all") * SHARE).select(F.col("what").alias("kept")).distinct(), "language-grams")
    counts = join_checked(ngrams, often, F.col("what") == F.col("kept"), "left_semi").toArrow()
    letters_of = found.where("kind = 's'").select("lang", "what", "n").collect()  # languages times scripts
    languages = sorted({r["lang"] for r in letters_of})
    at = {lang: i for i, lang in enumerate(languages)}
    scripts: dict[str, np.ndarray] = {}
    for r in letters_of:
        scripts.setdefault(r["what"], np.zeros(len(languages)))[at[r["lang"]]] += r["n"]
    letters = sum(scripts.values(), np.full(len(languages), 1e-9))
    return Model(languages, counts, {s: c / letters >= SCRIPT_SHARE for s, c in scripts.items()})


def viterbi(scores: np.ndarray, ids: np.ndarray, starts: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word of many sequences, all stepped at once; scores[ids] are the words' scores.

    Sequence k has counts[k] words from starts[k] on. Staying in a language is free, changing costs switch. The
    longest come first, so that those still going are a prefix. The way back takes two bytes a word and a bit a
    label, in two arrays for all sequences.
    """
    labels = np.zeros(len(ids), dtype=np.int16)
    order = np.argsort(-counts, kind="stable")
    starts, counts = starts[order], counts[order]
    n = int(np.count_nonzero(counts))
    starts, counts = starts[:n], counts[:n]
    if not n:
        return labels
    going = n - np.searchsorted(counts[::-1], np.arange(int(counts[0])), side="right")
    best = scores[ids[starts]]
    came = np.zeros(len(ids), dtype=np.int16)  # the label that a change to this word comes from
    kept = np.zeros((len(ids), (scores.shape[1] + 7) // 8), dtype=np.uint8)  # labels that stay as they were
    for t in range(1, int(counts[0])):
        a = going[t]
        at = starts[:a] + t
        before = best[:a]
        top = before.argmax(axis=1)
        moved = (before[np.arange(a), top] - switch)[:, None]
        came[at], kept[at] = top, np.packbits(before >= moved, axis=1)
        best[:a] = np.maximum(before, moved) + scores[ids[at]]
    state = best.argmax(axis=1)
    for t in range(int(counts[0]) - 1, -1, -1):
        a = going[t]
        at, mine = starts[:a] + t, state[:a]
        labels[at] = mine
        if t:
            stays = kept[at, mine >> 3] >> (7 - (mine & 7)) & 1
            state[:a] = np.where(stays, mine, came[at])
    return labels


def _lower(text: str) -> str:
    """Lower case where that keeps the places of letters."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class _Words(dict):
    """Places of words in a growing table of their scores and letters."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.scores = np.zeros((1024, len(model.languages)), dtype=np.float32)
        self.letters = np.zeros(1024, dtype=np.int64)

    def learn(self, words: set[str]) -> None:
        """Score those of words that are new, all at once."""
        new = [w for w in words if w not in self]
        n = len(self)
        while n + len(new) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        if new:
            self.scores[n : n + len(new)] = self.model.words(new)
            self.letters[n : n + len(new)] = [len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in new]
            self.update(zip(new, range(n, n + len(new))))


class Labeller:
    """Labels of texts under a model; a worker's words are scored once while they are remembered."""

    def __init__(self, model: Model):
        self.model, self.known = model, _Words(model)

    def label(self, texts: list[str], spans: bool = False) -> list[tuple[str, float, list[dict] | None]]:
        """Per text its language by most letters, their share, and the spans if asked for."""
        if not self.model.languages:
            return [(UNKNOWN, 0.0, [] if spans else None) for _ in texts]
        if len(self.known) > min(REMEMBERED, REMEMBERED_SCORES // len(self.model.languages)):
            self.known = _Words(self.model)
        known = self.known
        ids: list[np.ndarray] = []
        held: list[list[str]] = []
        for k, t in enumerate(texts):
            held.append(pieces(_lower(t)))
            if k + 1 == len(texts) or sum(map(len, held)) > LEARNT_AT_ONCE:
                known.learn(set().union(*held))
                ids += [np.fromiter(map(known.__getitem__, found), dtype=np.int32, count=len(found)) for found in held]
                held = []
        counts = np.array([len(x) for x in ids], dtype=np.int64)
        starts = np.cumsum(counts) - counts
        flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
        labels = viterbi(known.scores, flat, starts, counts)
        weights = known.letters[flat]
        of = np.repeat(np.arange(len(texts)), counts)
        n = len(self.model.languages)
        shares = np.bincount(of * n + labels, weights=weights, minlength=len(texts) * n).reshape(len(texts), n)
        out = []
        for k, text in enumerate(texts):
            total = shares[k].sum()
            if not total:
                lang, score = UNKNOWN, 0.0
            else:
                lang, score = self.model.languages[int(shares[k].argmax())], float(shares[k].max() / total)
            out.append((lang, score, self._spans(text, labels[starts[k] : starts[k] + counts[k]]) if spans else None))
        return out

    def _spans(self, text: str, labels: np.ndarray) -> list[dict]:
        made: list[dict] = []
        for m, label in zip(_pieces().finditer(_lower(text)), labels, strict=True):
            lang = self.model.languages[label]
            if made and made[-1]["lang"] == lang:
                made[-1]["end"] = m.end()
            else:
                made.append({"start": m.start(), "end": m.end(), "lang": lang})
        return made


_labellers: dict[str, Labeller] = {}


def identify(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, and if asked spans (start, end in code points, lang).

    Whole texts, very long ones too, are labelled piece by piece (words cut at changes of script and after PIECE
    letters); lang_pred has the most letters, of ties the first by name, score is their share. A null text and one
    without a letter are und with score 0. Only the text decides: columns lang and source are not read. Repeated
    rows get equal results; other columns are ignored; an empty table gives an empty result.
    """
    importable(docs.sparkSession)
    data = pickle.dumps(model)
    shared, key = docs.sparkSession.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _labellers:
            _labellers.clear()
            _labellers[key] = Labeller(pickle.loads(shared.value))
        labeller = _labellers[key]

        def made(part: list[tuple]) -> pa.RecordBatch:
            found = labeller.label([t for *_, t in part], spans)
            columns = [
                pa.array([i for i, *_ in part], pa.int64()),
                pa.array([h for _, h, _ in part], pa.bool_()),
                pa.array([x[0] for x in found], pa.string()),
                pa.array([x[1] for x in found], pa.float64()),
            ]
            names = ["doc_id", "held_out", "lang_pred", "score"]
            if spans:
                columns.append(pa.array([x[2] for x in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
                names.append("spans")
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            part, size = [], 0
            for i, h, t in zip(*[batch.column(c) for c in ("doc_id", "held_out", "text")], strict=True):
                text = t.as_py() or ""
                part.append((i.as_py(), h.as_py(), text))
                size += len(text)
                if size > SLICE_CHARS:
                    yield made(part)
                    part, size = [], 0
            if part:
                yield made(part)

    ddl = "held_out boolean, lang_pred string, score double" + (", spans array<struct<start:int,end:int,lang:string>>" if spans else "")
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, schema_of(docs.select(F.col("doc_id").cast("long").alias("doc_id")), ["doc_id"], ddl))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs), spans=False)
