"""The entry point: named outputs of view trees as columns of a DataFrame."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwave.operators.views import View
from rillwave.plans.scan import scan
from rillwave.plans.windows import WindowPlan, expressible


#: Longest window for which a frame is taken: Spark sums a frame anew for each row, the scan keeps its sums.
FRAME = 128


def _short(view: View) -> bool:
    return all(getattr(n, "window", 1) <= FRAME for n in view.nodes())


def _list(x: str | list[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def features(
    df: DataFrame,
    key: str | list[str],
    order: str | list[str],
    outputs: Mapping[str, View],
    value: str = "value",
    *,
    drop_warmup: bool = False,
    strict: bool = False,
    nulls: str = "hold",
    dtype: str = "double",
    engine: str = "auto",
) -> DataFrame:
    """df with a nullable column per output, evaluated for each series of equal key in order.

    order must be total within a series. A null value is no update: outputs keep what they were, unless
    nulls="absent" promises that there are none, which saves a pass. drop_warmup keeps rows on which every output
    is ready; strict raises on infinite and NaN values, of inner views too, and on a division by 0. dtype="float" rounds the outputs.
    engine "window" or "scan" forces a form; "auto" takes windows where all outputs have that form and no window is
    longer than FRAME, as they stay in the JVM, else a single scan for all. Both need one exchange, by key.
    """
    key, order = _list(key), _list(order)
    if not outputs:
        raise ValueError("no outputs")
    if nulls not in ("hold", "absent") or engine not in ("auto", "window", "scan"):
        raise ValueError("nulls is hold or absent, engine auto, window or scan")
    clash = set(outputs) & set(df.columns)
    if clash:
        raise ValueError(f"outputs named as columns of the input: {sorted(clash)}")
    roots = list(outputs.values())
    windows = all(expressible(r) for r in roots)
    if engine == "window" and not windows:
        raise ValueError("a view of these outputs is recursive: it has no window form")
    if windows and (engine == "window" or engine == "auto" and all(_short(r) for r in roots)):
        plan = WindowPlan(df, key, order, value, strict)
        columns = plan.results(dict(outputs), nulls)
        result = plan.df.select(*df.columns, *[c.alias(name) for name, c in columns.items()])
    else:
        result = scan(df, key, order, value, roots, list(outputs), strict, nulls)
    if dtype != "double":
        result = result.withColumns({name: F.col(name).cast(dtype) for name in outputs})
    if drop_warmup:
        result = result.dropna(subset=list(outputs))
    return result


def final(df: DataFrame, key: str | list[str], order: str | list[str], outputs: list[str]) -> DataFrame:
    """The last row of each series: its outputs at the greatest order."""
    key, order = _list(key), _list(order)
    at = F.struct(*order)
    return df.groupBy(*key).agg(*[F.max_by(name, at).alias(name) for name in outputs])
