"""Views as a stateful stream: the scan's program, pickled, is the state of each series.

Batch and stream give the same rows for any split into micro-batches, as long as each series arrives in order over
micro-batches. Within a micro-batch rows are sorted; a row at or before the last order emitted for its series is late
and dropped, as no view can take a value back.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, FloatType, StructField, StructType

from rillwave.operators.kernels import Program
from rillwave.operators.views import View
from rillwave.plans.workers import importable

STATE = StructType([StructField("state", BinaryType())])


def stream_features(df: DataFrame, key: str | list[str], order: str | list[str], outputs: Mapping[str, View], value: str = "value", *, strict: bool = False) -> DataFrame:
    """The streaming form of plans.features.features: df with a nullable column per output, in append mode."""
    key = [key] if isinstance(key, str) else list(key)
    order = [order] if isinstance(order, str) else list(order)
    names, roots = list(outputs), list(outputs.values())
    # pandas has NaN for null too, so booleans beside the columns tell which is which.
    columns = [*df.columns, "__null"]
    made_fields = [StructField(n, DoubleType()) for n in names] + [StructField(f"__nan{i}", BooleanType()) for i in range(len(names))]
    schema = StructType([*df.schema.fields, StructField("__null", BooleanType()), *made_fields])

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable")
        if state.exists:
            program, last, held = pickle.loads(state.get[0])
        else:
            program, last = Program(roots, strict), None
            held = program.before()
        places = list(rows[order].itertuples(index=False, name=None))
        if last is not None:
            fresh = [p > last for p in places]
            rows, places = rows[fresh], [p for p, ok in zip(places, fresh, strict=True) if ok]
        if not len(rows):
            return
        values = [None if gone else float(x) for x, gone in zip(rows["__value"], rows["__null"], strict=True)]
        if strict and any(x is not None and not math.isfinite(x) for x in values):
            raise ValueError("value must be finite")
        made = program.scan([x for x in values if x is not None])
        out = rows[columns].copy()
        for i, name in enumerate(names):
            mine, now, col = iter(made[i]), held[i], []
            for x in values:
                if x is not None:
                    now = next(mine)
                col.append(now)
            out[name] = pd.Series(col, index=out.index, dtype="object")
            out[f"__nan{i}"] = [x is not None and math.isnan(x) for x in col]
            held[i] = now
        state.update((pickle.dumps((program, places[-1], held)),))
        yield out[schema.names]

    importable(df.sparkSession)
    rows = df.withColumn("__value", F.col(value).cast("double")).withColumn("__null", F.col(value).isNull())
    out = rows.groupBy(*key).applyInPandasWithState(step, schema, STATE, "append", GroupStateTimeout.NoTimeout)
    nan = F.lit(math.nan)
    given = F.when(F.col(value).isNull() & ~F.col("__null"), nan.cast(df.schema[value].dataType)).otherwise(F.col(value)).alias(value)
    read = [given if c == value and df.schema[c].dataType in (DoubleType(), FloatType()) else F.col(c) for c in df.columns]
    return out.select(*read, *[F.when(F.col(f"__nan{i}"), nan).otherwise(F.col(n)).alias(n) for i, n in enumerate(names)])
