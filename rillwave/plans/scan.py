"""Views as one ordered scan: for trees with a recursive view.

Rows are dealt by key and sorted within partitions; one Arrow pass runs the program of all outputs over each series,
many series side by side (plans/blocks.py), long ones row by row with a state of window size that carries over
batches. A series may be of any length. Key columns are compared as
they come, so equal keys must be contiguous: the sort sees to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rillwave.operators import views as v
from rillwave.operators.kernels import Program
from rillwave.plans.blocks import LEAST, spread
from rillwave.plans.workers import importable

VALUE = "__value"
#: Rows, and bytes, of a block of series that are held at once (about).
BLOCK_ROWS, BLOCK_BYTES = 200_000, 64_000_000


def _runs(batch: pa.RecordBatch, key: list[str]) -> list[int]:
    """Rows at which another series begins; row 0 always does."""
    if batch.num_rows < 2:
        return [0]
    change = None
    for name in key:
        column = batch.column(name)
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
        change = differ if change is None else pc.or_(change, differ)
    return [0, *(pc.indices_nonzero(change).to_numpy() + 1).tolist()]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold enough rows for many series, or enough bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK_ROWS or sum(b.nbytes for b in held) >= BLOCK_BYTES:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def scanner(roots: list[v.View], key: list[str], strict: bool, nulls: str):
    """The Arrow function: rows in, rows with one float column per root out.

    The first and the last series of a block, which may reach beyond it, run row by row with a state that is carried
    on; the series between them are whole and run side by side where there are enough.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program, held, series = None, [], None
        for batch in _blocks(batches):
            n = batch.num_rows
            starts = np.array(_runs(batch, key))
            ends = np.append(starts[1:], n)
            first = tuple(batch.column(k)[0].as_py() for k in key)
            column = batch.column(VALUE)
            missing = column.is_null().to_numpy(zero_copy_only=False)
            values = pc.fill_null(column, 0.0).to_numpy(zero_copy_only=False)
            if strict and not np.isfinite(values).all():
                raise ValueError("value must be finite")
            outs, ready = np.zeros((len(roots), n)), np.zeros((len(roots), n), dtype=bool)
            alone = np.arange(len(starts))
            if len(starts) > LEAST and not strict:
                left = spread(Program(roots), values, missing, starts[1:-1], ends[1:-1], outs, ready)
                alone = np.sort(np.concatenate([[0], left + 1, [len(starts) - 1]]))
            for i in alone.tolist():
                at, end = int(starts[i]), int(ends[i])
                if i or program is None or series != first:
                    program = Program(roots, strict)
                    held = program.before()
                part = values[at:end].tolist()
                if missing[at:end].any():
                    made: list[list[float | None]] = [[] for _ in roots]
                    _with_nulls(program, [None if gone else x for x, gone in zip(part, missing[at:end].tolist(), strict=True)], made, held, nulls)
                else:
                    made = program.scan(part)
                for r, out in enumerate(made):
                    ready[r, at:end] = [x is not None for x in out]
                    outs[r, at:end] = [0.0 if x is None else x for x in out]
                held = [o[-1] for o in made]
            series = tuple(batch.column(k)[n - 1].as_py() for k in key)
            columns = [batch.column(c) for c in batch.schema.names if c != VALUE]
            names = [c for c in batch.schema.names if c != VALUE] + [f"__out{i}" for i in range(len(roots))]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(o, pa.float64(), mask=~ok) for o, ok in zip(outs, ready, strict=True)]], names)

    return run


def _with_nulls(program: Program, part: list, outs: list[list], held: list, nulls: str) -> None:
    """Null inputs do not tick; their rows repeat the outputs before."""
    real = [x for x in part if x is not None]
    made = program.scan(real)
    for out, mine, before in zip(outs, made, held, strict=True):
        k, last = 0, before
        for x in part:
            if x is not None:
                last = mine[k]
                k += 1
            out.append(last)


def scan(df: DataFrame, key: list[str], order: list[str], value: str, roots: list[v.View], names: list[str], strict: bool, nulls: str) -> DataFrame:
    """df with one column per root."""
    importable(df.sparkSession)
    rows = df.withColumn(VALUE, F.col(value).cast("double")).repartition(*key).sortWithinPartitions(*key, *order)
    schema = StructType([*df.schema.fields, *[StructField(f"__out{i}", DoubleType()) for i in range(len(roots))]])
    made = rows.mapInArrow(scanner(roots, key, strict, nulls), schema)
    return made.select(*df.columns, *[F.col(f"__out{i}").alias(n) for i, n in enumerate(names)])
