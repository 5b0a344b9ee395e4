"""Byte-level BPE by prefix dynamic programming: each byte prefix of a piece has one valid last token."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rillwave.llm.common import schema_of
from rillwave.plans.workers import importable

#: Pieces up to this many characters are remembered, so many at most in each of two generations.
CACHED_CHARS = 64
CACHED_PIECES = 300_000


def load_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Vocabulary:
    """Tokens with ranks, and which pairs of tokens may stand side by side.

    Merging always takes the lowest rank, the leftmost of equals. Two tokens may be neighbours if, while each is
    built up from its bytes, no merge across their boundary comes first. Only the right edge of the left token and
    the left edge of the right one matter: each edge is the list of parts that stood there, with the rank of the
    merge that absorbed the part (none for the token itself).
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.strings = {rank: str(rank) for rank in self.tokens}
        self.longest = max(map(len, ranks), default=1)
        self._split: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._edges: dict[tuple[bytes, bool], list[tuple[bytes, float]]] = {}
        self.unreachable = {rank for rank, token in self.tokens.items() if not self.reachable(token)}
        #: Known pairs, left * 2**32 + right: whether they may stand side by side.
        self.pairs: dict[int, bool] = {}
        # Finds all tokens that end at each byte, the longest first; it reads bytes as Latin-1.
        self.ends = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if rank not in self.unreachable:
                self.ends.add_word(token.decode("latin-1"), (len(token), rank))
        self.ends.make_automaton()

    def split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts whose merge makes the token; None for a byte; ValueError if no merging makes it."""
        if len(token) == 1:
            return None
        if token not in self._split:
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if rank == 1 << 60:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._split[token] = (parts[0], parts[1]) if len(parts) == 2 else ()
        if not self._split[token]:
            raise ValueError(token)
        return self._split[token]

    def reachable(self, token: bytes) -> bool:
        try:
            self.split(token)
        except ValueError:
            return False
        return True

    def _edge(self, token: bytes, right: bool) -> list[tuple[bytes, float]]:
        key = (token, right)
        if key not in self._edges:
            edge, part = [], token
            absorbed = float("inf")
            while True:
                edge.append((part, absorbed))
                halves = self.split(part)
                if halves is None:
                    break
                absorbed = self.ranks[part]
                part = halves[1] if right else halves[0]
            self._edges[key] = edge[::-1]
        return self._edges[key]

    def neighbours(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known = self.pairs[key] = self._stand(self.tokens[left], self.tokens[right])
        return known

    def last_tokens(self, data: bytes, last: list[int], start: int, stop: int) -> None:
        """Appends to last the last tokens of the prefixes of start to stop bytes, given those before."""
        base, known = max(0, start - self.longest), self.pairs.get
        i = start
        for end, (size, token) in self.ends.iter(data[base:stop].decode("latin-1")):
            at = base + end + 1
            if at < i:
                continue
            if at > i:
                break
            before = last[i - size]
            if before >= 0:
                stands = known(before << 32 | token)
                if not stands and (stands is not None or not self.neighbours(before, token)):
                    continue
            last.append(token)
            i += 1
        if i <= stop:
            raise ValueError(f"byte {data[i - 1 : i]!r} is not in the vocabulary")

    def trace(self, n: int, last: list[int]) -> list[int]:
        """The ids of the first n bytes, from their last tokens."""
        out, tokens = [], self.tokens
        while n:
            token = last[n]
            out.append(token)
            n -= len(tokens[token])
        out.reverse()
        return out

    def _stand(self, left: bytes, right: bytes) -> bool:
        a, b = self._edge(left, True), self._edge(right, False)
        i = j = 0
        while True:
            (pa_, ra), (pb, rb) = a[i], b[j]
            across = self.ranks.get(pa_ + pb)
            # Of equal ranks the leftmost merge is first: inside the left token, then across, then inside the right.
            if across is not None and across < ra and across <= rb:
                return False
            if ra == rb == float("inf"):
                return True
            if ra <= rb:
                i += 1
            else:
                j += 1


class PrefixTable:
    """The encoding of every prefix of a byte string: at i the last token of the first i bytes.

    append() and edit() leave what stands before a change as it is. After it, entries are computed anew until as
    many in a row as a token may be long repeat what stood there; from then on the old ones hold.
    """

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        whole = self.data + data
        self.vocabulary.last_tokens(whole, self.last, len(self.data) + 1, len(whole))
        self.data = whole

    def edit(self, at: int, removed: int, inserted: bytes) -> int:
        """Replace removed bytes at a place; returns how many entries were computed."""
        old, shift = self.last, len(inserted) - removed
        data = self.data[:at] + inserted + self.data[at + removed :]
        last, agree, made = old[: at + 1], 0, 0
        for i in range(at + 1, len(data) + 1):
            if agree >= self.vocabulary.longest:
                last += old[i - shift :]
                break
            self.vocabulary.last_tokens(data, last, i, i)
            made += 1
            unchanged = i > at + len(inserted) and last[i] == old[i - shift]
            agree = agree + 1 if unchanged else 0
        self.data, self.last = data, last
        return made

    def ids(self) -> list[int]:
        return self.vocabulary.trace(len(self.data), self.last)


class _Pieces(dict):
    """Ids of recent pieces: a miss asks the generation before, then the prefix table."""

    def __init__(self, coder: Coder):
        super().__init__()
        self.coder, self.older = coder, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            ids = tuple(self.coder.piece_ids(piece.encode("utf-8", "surrogatepass")))
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Coder:
    """Encodes texts piece by piece of the splitting pattern, without special tokens, and decodes ids to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.vocabulary = Vocabulary(ranks)
        self.pattern = regex.compile(pattern)
        self.pieces = _Pieces(self)

    def piece_ids(self, piece: bytes) -> list[int]:
        v = self.vocabulary
        whole = v.ranks.get(piece)
        if whole is not None:
            return [whole]
        last = [-1]
        v.last_tokens(piece, last, 1, len(piece))
        return v.trace(len(piece), last)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.pattern.findall(text))))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))


class TextTable:
    """A growing text and its ids. Appended text can change the last two pieces (' and r before e are one piece), and
    those before them back to the first that still ends where it did."""

    def __init__(self, coder: Coder, text: str = ""):
        self.coder, self.starts, self.parts, self.text = coder, [], [], ""
        self.append(text)

    def append(self, text: str) -> None:
        self.text += text
        keep = max(0, len(self.starts) - 2)
        while keep and self.coder.pattern.match(self.text, self.starts[keep - 1]).end() != self.starts[keep]:
            keep -= 1
        start = self.starts[keep] if self.starts else 0
        del self.starts[keep:], self.parts[keep:]
        for m in self.coder.pattern.finditer(self.text, start):
            self.starts.append(m.start())
            self.parts.append(self.coder.pieces[m.group()])

    def ids(self) -> list[int]:
        return list(chain.from_iterable(self.parts))


_coders: dict[str, Coder] = {}


def _coder(data: bytes, pattern: str) -> Coder:
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    if key not in _coders:
        _coders[key] = Coder(load_ranks(data), pattern)
    return _coders[key]


def encode_decode(docs: DataFrame, path: str, columns: tuple[str, ...] = ("ids", "decoded"), pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens and the asked columns: ids array<int>, decoded binary, ids_sha256, decoded_sha256 string.

    Each whole text (null: empty) is encoded with the rank file at path, then decoded from its ids; one row for
    each row of docs, repeated and null ids included. Other columns are ignored. The rank file is read on the
    driver and broadcast: its size is that of a vocabulary, whatever the input. Texts are coded one by one, so
    memory holds one batch of texts, one text's ids and a bounded number of remembered pieces.
    """
    kinds = {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("binary", pa.binary()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    importable(docs.sparkSession)
    with open(path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks.value, pattern)
        strings = coder.vocabulary.strings.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts, made = [], {c: [] for c in columns}
                for text in part.column("text"):
                    ids = coder.encode(text.as_py() or "")
                    data = coder.decode(ids)
                    counts.append(len(ids))
                    for c in columns:
                        if c == "ids":
                            made[c].append(ids)
                        elif c == "decoded":
                            made[c].append(data)
                        elif c == "ids_sha256":
                            made[c].append(hashlib.sha256(",".join(map(strings, ids)).encode()).hexdigest())
                        else:
                            made[c].append(hashlib.sha256(data).hexdigest())
                arrays = [part.column("doc_id"), pa.array(counts, pa.int64()), *[pa.array(made[c], kinds[c][1]) for c in columns]]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", *columns])

    ddl = ", ".join(["n_tokens bigint", *[f"{c} {kinds[c][0]}" for c in columns]])
    return docs.select("doc_id", "text").mapInArrow(run, schema_of(docs, ["doc_id"], ddl))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), ("ids_sha256", "decoded_sha256"))
