"""Chat formatting: conversations assembled byte by byte into one Arrow buffer, and read back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwave.llm.common import schema_of, table
from rillwave.plans.workers import importable

#: A turn is BEGIN role MIDDLE text END.
BEGIN, MIDDLE, END = "<s>", "[INST]", "</s>"
#: Control strings of usual templates: none of them can stand in a formatted text but where the template put it.
CONTROLS = (BEGIN, END, MIDDLE, "[/INST]", "<<SYS>>", "<</SYS>>")
TRAINED = "assistant"
#: Bytes of conversations that are assembled into one buffer (about; a larger conversation has one of its own), and
#: bytes that are scattered by one index array.
SLICE_BYTES, SCATTER_BYTES = 64_000_000, 4_000_000
#: What a value of Arrow's and Spark's strings can hold.
MOST_BYTES = 2**31 - 1
_TURN = re.compile(re.escape(BEGIN) + "(.*?)" + re.escape(MIDDLE) + "(.*?)" + re.escape(END), re.DOTALL)
_ESCAPE = re.compile(r"\\(\\?)")


def escape(texts: pa.Array) -> pa.Array:
    """Doubles backslashes and puts one behind the first character of each control string."""
    texts = pc.replace_substring(texts, "\\", "\\\\")
    for control in CONTROLS:
        texts = pc.replace_substring(texts, control, control[0] + "\\" + control[1:])
    return texts


def unescape(text: str) -> str:
    """A doubled backslash is one, a single one is dropped."""
    return _ESCAPE.sub(r"\1", text)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the strings of an array, and their bytes back to back."""
    _, places, data = texts.buffers()
    places = np.frombuffer(places, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return np.diff(places).astype(np.int64), whole[places[0] : places[-1]]


def _scatter(out: np.ndarray, starts: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> None:
    """Copies back-to-back segments to their places; indices are made for SCATTER_BYTES at a time, within segments too."""
    ends = np.cumsum(lengths)
    shift = starts - (ends - lengths)
    for at in range(0, len(data), SCATTER_BYTES):
        to = min(at + SCATTER_BYTES, len(data))
        a, b = np.searchsorted(ends, at, side="right"), np.searchsorted(ends, to, side="left") + 1
        counts = np.minimum(ends[a:b], to) - np.maximum(ends[a:b] - lengths[a:b], at)
        out[np.arange(at, to) + np.repeat(shift[a:b], counts)] = data[at:to]


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Conversations from turns in order; first: the place of the first turn of each.

    Returns the formatted texts, and per conversation the (start, end) bytes of the trained texts in it.
    """
    n = len(roles)
    trained = np.asarray(pc.equal(roles, TRAINED).to_numpy(zero_copy_only=False), dtype=bool)
    contents = [_bytes(escape(roles)), _bytes(escape(texts))]
    fixed = [np.frombuffer(s.encode(), dtype=np.uint8) for s in (BEGIN, MIDDLE, END)]
    sizes = np.empty((n, 5), dtype=np.int64)
    for k in range(3):
        sizes[:, 2 * k] = len(fixed[k])
    for k in range(2):
        sizes[:, 2 * k + 1] = contents[k][0]
    ends = np.cumsum(sizes.ravel()).reshape(n, 5)
    starts = ends - sizes
    total = int(ends[-1, -1]) if n else 0
    if total > MOST_BYTES:
        raise ValueError(f"a conversation of {total} bytes does not fit into a string")
    out = np.empty(total, dtype=np.uint8)
    for k in range(3):
        out[starts[:, 2 * k, None] + np.arange(len(fixed[k]))] = fixed[k]
    for k in range(2):
        _scatter(out, starts[:, 2 * k + 1], *contents[k])
    opened = np.append(starts[first, 0], total)
    formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(opened.astype(np.int32)), pa.py_buffer(out))
    of = np.searchsorted(first, np.flatnonzero(trained), side="right") - 1
    spans = pa.StructArray.from_arrays([starts[trained, 3] - opened[of], ends[trained, 3] - opened[of]], ["start", "end"])
    counts = np.append(0, np.cumsum(np.bincount(of, minlength=len(first))))
    return formatted, pa.ListArray.from_arrays(pa.array(counts, pa.int32()), spans)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []  # the turns of the last conversation, which may go on

    def made(rows: pa.RecordBatch) -> pa.RecordBatch:
        first = _first(rows.column("conv_id"))
        roles, texts = (pc.fill_null(rows.column(c), "").cast(pa.string()) for c in ("role", "text"))
        formatted, spans = assemble(roles, texts, first)
        turns = np.diff(np.append(first, rows.num_rows))
        return pa.RecordBatch.from_arrays([rows.column("conv_id").take(pa.array(first)), pa.array(turns, pa.int64()), formatted, spans], ["conv_id", "n_turns", "formatted", "loss"])

    def cut(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The rows in slices of whole conversations, of about SLICE_BYTES."""
        first = np.append(_first(rows.column("conv_id")), rows.num_rows)
        sizes = sum(pc.fill_null(pc.binary_length(rows.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("role", "text"))
        upto = np.append(0, np.cumsum(sizes))[first]
        at = 0
        while at < len(first) - 1:
            to = max(at + 1, int(np.searchsorted(upto, upto[at] + SLICE_BYTES, side="right")) - 1)
            yield made(rows.slice(first[at], first[to] - first[at]))
            at = to

    for batch in batches:
        if not batch.num_rows:
            continue
        first = _first(batch.column("conv_id"))
        follows = held and held[0].column("conv_id")[0].as_py() == batch.column("conv_id")[0].as_py()
        if held and not follows:
            yield from cut(pa.concat_batches(held))
            held = []
        last = int(first[-1])
        if last:
            yield from cut(pa.concat_batches([*held, batch.slice(0, last)]))
            held = []
        held.append(batch.slice(last))
    if held:
        yield from cut(pa.concat_batches(held))


def _first(ids: pa.Array) -> np.ndarray:
    """Places at which another conversation begins; null is an id of its own."""
    values = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
    nulls = pc.is_null(ids).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.append(True, (values[1:] != values[:-1]) | (nulls[1:] != nulls[:-1])))


def format_chat(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss (array of start and end bytes of assistant texts).

    Turns stand in order of turn, ties in order of role and text, null first; repeated rows are turns of their own.
    Null role and text count as empty, null conv_id as one conversation. Other columns are ignored; an empty table
    gives an empty result. The turns of a conversation meet sorted in one task, which holds the conversation it is
    at (a row of the result) and one batch, and assembles SLICE_BYTES at once. Very long texts and conversations are
    formatted whole; a conversation beyond MOST_BYTES, which no string holds, is an error.
    """
    importable(conversations.sparkSession)
    rows = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(_format, schema_of(conversations, ["conv_id"], "n_turns bigint, formatted string, loss array<struct<start:bigint,end:bigint>>"))


def read_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of format_chat's result, from nothing but formatted and loss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, loss in zip(batch.column("formatted"), batch.column("loss"), strict=True):
                text = text.as_py()
                turns, data = read_turns(text), text.encode()
                digest = hashlib.sha256()
                for role, said in turns:
                    digest.update(f"{role}\n{said}\n".encode())
                trained = "".join(unescape(data[x["start"] : x["end"]].decode()) for x in loss.as_py())
                out.append((len(turns), digest.hexdigest(), len(trained), hashlib.sha256(trained.encode()).hexdigest(), len(text)))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    importable(formatted.sparkSession)
    ddl = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, schema_of(formatted, ["conv_id"], ddl))


def query(spark, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(TRAINED).alias("role"), F.lit(said).alias("text")
    )
    return read_back(format_chat(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)))


# formatted_chars follows from the template: 3 + 6 + 4 characters a turn, a character for each escape.
ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(role || text) + 13 + length(role || chr(0) || text) - length(replace(role || chr(0) || text, '\', ''))
    + len(regexp_extract_all(role || chr(0) || text, '<s>|</s>|\[/?INST\]|<</?SYS>>')) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
