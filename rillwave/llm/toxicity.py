"""Toxicity: Levenshtein automata over a lexicon trie find terms, windows of context tell abuse from quotation."""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwave.llm.common import join_checked, schema_of, stage
from rillwave.llm.sampling import class_sample, held_out, learnable
from rillwave.plans.workers import importable

#: Labelled documents learnt from, per label (about). It bounds the lexicon too: every word and stem that passes is a term.
SAMPLE_PER_LABEL = 4_000
#: A term is in so many toxic documents of the sample at least, and so many times as often in them as in others.
TERM_DOCS, TERM_LIFT = 5, 12.0
#: A word near a term that other documents have too is still a misspelling if the toxic ones have it so many times as
#: often, and so many documents more.
NEAR_DOCS, NEAR_LIFT = 3, 2.0
#: Stems are prefixes of these lengths that many different words begin with.
STEM = (4, 9)
#: Terms of so many letters may be misspelt by one edit, of so many by two.
ONE_EDIT, TWO_EDITS = 5, 9
#: Words on either side of a term that are its context.
WINDOW = 6
THRESHOLD = 0.7
REMEMBERED = 250_000
#: States, of about 1 KB, that a lexicon's automata keep before they forget those beyond the first letters.
STATES, KEPT_LETTERS = 150_000, 4
FEATURE_NAMES = ("abuse", "quoted", "misspelt", "stems", "terms", "rate", "strongest", "length")

_WORD = re.compile(r"\w+")
_QUOTES = re.compile("[\"“”„«»‹›‟]|(?<!\\w)['‘’]|['‘’](?!\\w)")
# Words that report or mention rather than use a term.
REPORTING = frozenset(
    """
    said says say wrote writes called calls quote quoted quotes quoting reported reports word words term terms phrase slur insult cited cites
    a dit écrit appelé mot mots terme cité sagte schrieb nannte wort wörter begriff zitat zitiert dijo escribió llamó palabra palabras término cita
    """.split()
)
# Words that address the reader.
ADDRESSING = frozenset("you your youre ur u du dich dir dein deine ihr euch tu te toi ton vous votre tú ti eres usted ustedes vosotros".split())


class _State:
    __slots__ = ("at", "nodes", "moves")

    def __init__(self, at: int, nodes: tuple[tuple[int, int], ...]):
        self.at, self.nodes, self.moves = at, nodes, {}


class _Automaton:
    """The trie of the terms that a word of one length can be near, and an automaton over it that reads such words once.

    A state is a place in the word and the set of trie nodes that the letters so far can have led to, each with the
    fewest edits. States and their transitions are made when a word first needs them: the trie and the Levenshtein
    automata of all terms are intersected only where words go. A node stays while some term below it can still be
    reached: the letters left of term and word differ by no more than the edits left.
    """

    def __init__(self, length: int, terms: dict[str, int]):
        self.children: list[dict[str, int]] = [{}]
        self.depth = [0]
        self.term_at: dict[int, str] = {}
        # By node, and by how far the word is ahead of the node (-3 to 3): the edits that may have been made by now.
        self.room: list[list[int]] = [[-1] * 7]
        for term, edits in terms.items():
            room = [edits - abs(len(term) - length + ahead) if abs(ahead) < 3 else -1 for ahead in range(-3, 4)]
            node = 0
            self.room[0] = list(map(max, self.room[0], room))
            for depth, c in enumerate(term, 1):
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.depth.append(depth)
                    self.room.append(room)
                else:
                    self.room[nxt] = list(map(max, self.room[nxt], room))
                node = nxt
            self.term_at[node] = term
        self.states: dict[tuple, _State] = {}
        self.made = 0
        self.start = self._state(0, {0: 0})

    def forget(self, letters: int) -> None:
        """Leaves only the states of the first letters, which most words share."""
        self.states = {key: state for key, state in self.states.items() if state.at <= letters}
        for state in self.states.values():
            if state.at == letters:
                state.moves.clear()

    def _state(self, at: int, nodes: dict[int, int]) -> _State:
        """The state of these nodes and those reached from them by leaving out letters of terms."""
        depth, room = self.depth, self.room
        todo = list(nodes.items())
        while todo:
            node, edits = todo.pop()
            ahead, more = at - depth[node] + 3, edits + 1
            if more <= room[node][ahead - 1]:
                for child in self.children[node].values():
                    if more <= room[child][ahead - 1] and nodes.get(child, 9) > more:
                        nodes[child] = more
                        todo.append((child, more))
        key = (at, *sorted(nodes.items()))
        state = self.states.get(key)
        if state is None:
            state = self.states[key] = _State(at, key[1:])
            self.made += 1
        return state

    def _move(self, state: _State, letter: str) -> _State:
        at = state.at
        depth, room = self.depth, self.room
        out: dict[int, int] = {}
        for node, edits in state.nodes:
            below, more, ahead = self.children[node], edits + 1, at - depth[node] + 3
            if more <= room[node][ahead + 1] and out.get(node, 9) > more:
                out[node] = more
            if more <= room[node][ahead]:
                for child in below.values():
                    if more <= room[child][ahead] and out.get(child, 9) > more:
                        out[child] = more
            same = below.get(letter)
            if same is not None and edits <= room[same][ahead] and out.get(same, 9) > edits:
                out[same] = edits
        state.moves[letter] = made = self._state(at + 1, out)
        return made

    def read(self, word: str) -> tuple[tuple[int, int], ...]:
        """The nodes that a whole word leads to, with the fewest edits."""
        state = self.start
        for c in word:
            nxt = state.moves.get(c)
            state = self._move(state, c) if nxt is None else nxt
            if not state.nodes:
                break
        return state.nodes


class Lexicon:
    """Terms, which match whole words within their edits, and stems, which match without edits what a word begins with.

    Words of each length have an automaton of their own, over the terms near in length.
    """

    def __reduce__(self):
        return Lexicon, (self.terms, self.stems, self.clean)

    def __init__(self, terms: dict[str, float], stems: dict[str, float], clean: frozenset[str] = frozenset()):
        self.terms, self.stems, self.clean = terms, stems, clean
        self.stem_lengths = sorted({len(s) for s in stems}, reverse=True)
        self.near: dict[int, dict[str, int]] = {}
        for term in terms:
            edits = self.edits(term)
            for length in range(len(term) - edits, len(term) + edits + 1) if edits else ():
                self.near.setdefault(length, {})[term] = edits
        self.automata: dict[int, _Automaton] = {}
        self.kept = 0

    @staticmethod
    def edits(term: str) -> int:
        return 2 if len(term) >= TWO_EDITS else 1 if len(term) >= ONE_EDIT else 0

    def forget(self) -> None:
        """Makes room for states: of the first letters of words, all are kept if they take no more than half of it."""
        for letters in (KEPT_LETTERS, 0):
            for a in self.automata.values():
                a.forget(letters)
            self.kept = sum(len(a.states) for a in self.automata.values())
            if self.kept <= STATES // 2:
                break

    def match(self, word: str) -> tuple[str, int] | None:
        """The term or stem that a word is, and its edits (0 exact, -1 a stem)."""
        word = word.lower()
        if word in self.terms:
            return word, 0
        for length in self.stem_lengths:
            if word[:length] in self.stems:
                return word[:length], -1
        if len(word) not in self.near or word in self.clean:
            return None
        automaton = self.automata.get(len(word))
        if automaton is None:
            automaton = self.automata[len(word)] = _Automaton(len(word), self.near[len(word)])
        made = automaton.made
        nodes = automaton.read(word)
        self.kept += automaton.made - made
        if self.kept > STATES:
            self.forget()
        best = None
        for node, edits in nodes:
            term = automaton.term_at.get(node)
            if term is not None and 0 < edits <= self.edits(term) and (best is None or (edits, term) < (best[1], best[0])):
                best = term, edits
        return best


class _Seen(dict):
    """What the lexicon matches in recent words (None mostly), in two generations."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon, self.older = lexicon, {}

    def __missing__(self, word: str) -> tuple[str, int] | None:
        hit = self.older[word] if word in self.older else self.lexicon.match(word)
        if len(word) <= 40:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[word] = hit
        return hit


@dataclass
class Scorer:
    """Features of a text and their logistic score."""

    lexicon: Lexicon
    weights: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None

    def __post_init__(self):
        self.seen = _Seen(self.lexicon)

    def __reduce__(self):
        return Scorer, (self.lexicon, self.weights, self.mean, self.scale)

    def hits(self, text: str) -> tuple[list[tuple[int, str, int]], list[str]]:
        """Places among the words, the terms and edits of what the lexicon matches; and the words."""
        words = _WORD.findall(text)
        matched = list(map(self.seen.__getitem__, words))
        return ([(i, *hit) for i, hit in enumerate(matched) if hit] if any(matched) else []), words

    def quotation(self, words: list[str], i: int, text: str, start: int, end: int) -> float:
        """0 (used as abuse) to 1 (quoted): quotation marks and reporting words around, less words that address."""
        around = [w.lower() for w in words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]]
        marks = bool(_QUOTES.search(text, max(0, start - 24), start)) and bool(_QUOTES.search(text, end, end + 24))
        score = 0.6 * marks + 0.4 * min(1, sum(w in REPORTING for w in around)) - 0.3 * min(1, sum(w in ADDRESSING for w in around))
        return min(1.0, max(0.0, score))

    def features(self, text: str) -> list[float]:
        found, words = self.hits(text)
        abuse = quoted = misspelt = stems = strongest = 0.0
        if found:
            places = {}
            wanted = {i for i, *_ in found}
            for i, m in enumerate(_WORD.finditer(text)):
                if i in wanted:
                    places[i] = m.span()
            for i, term, edits in found:
                q = self.quotation(words, i, text, *places[i])
                w = self.lexicon.terms.get(term) if edits >= 0 else self.lexicon.stems[term]
                quoted += q
                strongest = max(strongest, w * (1 - q) * (1 if edits <= 0 else 0.7))
                if edits == 0:
                    abuse += w * (1 - q)
                elif edits > 0:
                    misspelt += w * (1 - q)
                else:
                    stems += w * (1 - q)
        n = max(1, len(words))
        terms = len({t for _, t, _ in found})
        total = abuse + misspelt + stems
        return [math.log1p(abuse), math.log1p(quoted), math.log1p(misspelt), math.log1p(stems), math.log1p(terms), min(1.0, total / n * 5), strongest, math.log1p(n)]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """Features in deviations from their means, within bounds: texts unlike any learnt from are not extrapolated."""
        return np.clip((x - self.mean) / self.scale, -6.0, 6.0)

    def score(self, text: str) -> float:
        x = self.scaled(np.array(self.features(text)))
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(x @ self.weights[:-1] + self.weights[-1]))))))

    def spans(self, text: str) -> list[tuple[int, int, str, float]]:
        """Start and end in code points, the term, and how far its context is a quotation."""
        found, words = self.hits(text)
        at = [m.span() for m in _WORD.finditer(text)]
        return [(*at[i], term, self.quotation(words, i, text, *at[i])) for i, term, _ in found]


def _document_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind (t: word, s: stem), what, toxic, n: documents by word and by prefix; sums over what memory holds."""
    counts: Counter = Counter()

    def flush():
        if counts:
            rows = [(*k, n) for k, n in counts.items()]
            counts.clear()
            a, b, c, d = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c, pa.int32()), pa.array(d, pa.int64())], ["kind", "what", "toxic", "n"])

    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic"), strict=True):
            label = toxic.as_py()
            words = set(_WORD.findall(text.as_py().lower()))
            stems = {w[:k] for w in words for k in range(STEM[0], min(STEM[1], len(w) - 1) + 1)}
            counts.update(("t", w, label) for w in words)
            counts.update(("s", w, label) for w in stems)
            if len(counts) > 1_000_000:
                yield from flush()
    yield from flush()


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1.0)
    ridge[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        w = w - np.linalg.solve(hessian, gradient)
    return w


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Scorer:
    """A scorer learnt from learnable labelled rows: about per_label of each label, weighted back to all of them.

    Terms and stems are those much more frequent in toxic documents of the sample. Words that an automaton
    would take for a misspelt term are noted as clean if other documents have them and toxic ones not clearly more often.
    """
    spark = docs.sparkSession
    importable(spark)
    rows = labels.where(learnable(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").alias("lid")).agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = stage(class_sample(rows, "lid", "toxic", per_label), "toxic-ids")  # about 2 * per_label ids
    sample = join_checked(docs.select("doc_id", "text").where("text IS NOT NULL"), picked, F.col("doc_id") == F.col("lid"), "inner")
    sample = sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # one row of an id, however often it is repeated
    sample = stage(sample, "toxic-sample").repartition(spark.sparkContext.defaultParallelism)
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = max(1, sizes.get(1, 0)), max(1, sizes.get(0, 0))

    found = sample.select("text", "toxic").mapInArrow(_document_terms, "kind string, what string, toxic int, n bigint")
    found = found.groupBy("kind", "what").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"))
    lift = ((F.col("a") + 0.0) / bad) / ((F.col("b") + 0.5) / good)
    chosen = found.where((F.col("a") >= TERM_DOCS) & (lift >= TERM_LIFT)).withColumn("weight", F.log(lift)).orderBy(F.desc(F.col("a") * F.col("weight")), "kind", "what").collect()
    terms, stems = {}, {}
    top = math.log(bad * 2)
    for r in sorted((r for r in chosen if r["kind"] == "s"), key=lambda r: (len(r["what"]), r["what"])):
        if not any(r["what"][:k] in stems for k in range(STEM[0], len(r["what"]))):
            stems[r["what"]] = r["weight"] / top
    whole = {r["what"]: (r["a"], r["weight"] / top) for r in chosen if r["kind"] == "t"}
    # A stem that one word makes up is that word.
    docs_of = {r["what"]: r["a"] for r in chosen if r["kind"] == "s"}
    below: dict[str, list[int]] = {}
    for w, (a, _) in whole.items():
        for k in range(STEM[0], min(STEM[1], len(w)) + 1):
            if w[:k] in stems:
                below.setdefault(w[:k], []).append(a)
    for s, docs_with in below.items():
        if len(docs_with) == 1 and docs_of[s] <= docs_with[0]:
            del stems[s]
    # Whole words stay terms under a stem too: only terms are matched with edits.
    for w, (_, weight) in whole.items():
        terms[w] = weight
    draft = Scorer(Lexicon(terms, stems))

    def misspelt(batches):
        for batch in batches:
            words = Counter()
            for text, toxic in zip(batch.column("text"), batch.column("toxic"), strict=True):
                hits, all_words = draft.hits(text.as_py())
                label = toxic.as_py()
                words.update((w, label) for w in {all_words[i].lower() for i, _, edits in hits if edits > 0})
            what, labels = [w for w, _ in words], [label for _, label in words]
            yield pa.RecordBatch.from_arrays([pa.array(what, pa.string()), pa.array(labels, pa.int32()), pa.array(list(words.values()), pa.int64())], ["what", "toxic", "n"])

    near = sample.select("text", "toxic").mapInArrow(misspelt, "what string, toxic int, n bigint").groupBy("what")
    near = near.agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"))
    clean = near.where((F.col("b") > 0) & (F.col("a") < NEAR_DOCS + NEAR_LIFT * F.col("b") * bad / good)).select("what").collect()
    scorer = Scorer(Lexicon(terms, stems, frozenset(r["what"] for r in clean)))

    def featured(batches):
        for batch in batches:
            x = [scorer.features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    data = sample.select("text", "toxic").mapInArrow(featured, "toxic int, x array<double>").collect()
    y = np.array([r["toxic"] for r in data], dtype=float)
    x = np.array([r["x"] for r in data], dtype=float).reshape(len(data), len(FEATURE_NAMES))
    scorer.mean, scorer.scale = (x.mean(axis=0), np.maximum(x.std(axis=0), 0.02)) if len(x) else (np.zeros(len(FEATURE_NAMES)), np.ones(len(FEATURE_NAMES)))
    weight = np.where(y == 1, counts.get(1, 0) / bad, counts.get(0, 0) / good)
    if len(set(y)) == 2:
        scorer.weights = _fit(scorer.scaled(x), y, weight / weight.mean())
    else:  # nothing to tell apart: everything is scored as the one label there is, or as not toxic
        scorer.weights = np.append(np.zeros(len(FEATURE_NAMES)), 5.0 if 1.0 in y else -5.0)
    return scorer


_scorers: dict[str, Scorer] = {}


def score(docs: DataFrame, scorer: Scorer, spans: bool = True) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, and if asked spans (start, end, term, quoted).

    Whole texts, very long ones too, are read; null counts as empty. Only the text decides, so ties and repeated rows get
    equal results; other columns are ignored; an empty table gives an empty result. Texts are scored one by one.
    """
    importable(docs.sparkSession)
    data = pickle.dumps(scorer)
    shared = docs.sparkSession.sparkContext.broadcast(data)
    key = hashlib.sha256(data).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = pickle.loads(shared.value)
        mine = _scorers[key]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t.as_py() or "" for t in part.column("text")]
                scores = [mine.score(t) for t in texts]
                columns = [part.column("doc_id"), part.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())]
                names = ["doc_id", "held_out", "score", "predicted"]
                if spans:
                    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string()), ("quoted", pa.float64())]))
                    columns.append(pa.array([[dict(zip(("start", "end", "term", "quoted"), s, strict=True)) for s in mine.spans(t)] for t in texts], kind))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(columns, names)

    ddl = "held_out boolean, score double, predicted int" + (", spans array<struct<start:int,end:int,term:string,quoted:double>>" if spans else "")
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, schema_of(docs, ["doc_id"], ddl))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), spans=False)
