"""Registered signal queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwave.operators.views import (
    GTE,
    LTE,
    Add,
    Alma,
    BinaryEntropy,
    CenterOfGravity,
    Constant,
    CorrelationTrend,
    Cumulative,
    CyberCycle,
    Divide,
    Drawdown,
    Echo,
    EhlersFisher,
    Ema,
    HLNormalizer,
    Lag,
    LaguerreFilter,
    LaguerreRSI,
    LnReturn,
    Max,
    Min,
    Multiply,
    MyRSI,
    NoiseElimination,
    PolarizedFractalEfficiency,
    ReFlex,
    Roc,
    RoofingFilter,
    Rsi,
    Sma,
    Subtract,
    SuperSmoother,
    Tanh,
    TrendFlex,
    View,
    Vsct,
    Vst,
    WelfordOnline,
    WelfordRolling,
)
from rillwave.oracle import OracleSql
from rillwave.plans.features import features, final
from rillwave.sources.series import scratch
from rillwave.streaming.stateful import stream_features

CENTRED = Subtract(Echo(), Constant(25.0))

#: One view per operator, then chains.
VIEWS: dict[str, View] = {
    "echo": Echo(),
    "constant": Constant(2.5),
    "add": Add(Sma(4), Lag(3)),
    "subtract": Subtract(Max(8), Min(8)),
    "multiply": Multiply(Echo(), Constant(0.5)),
    "divide": Divide(Sma(4), Max(8)),
    "tanh": Tanh(Divide(CENTRED, Constant(50.0))),
    "gte": GTE(20.0),
    "lte": LTE(40.0),
    "drawdown": Drawdown(),
    "ln_return": LnReturn(),
    "welford_rolling": WelfordRolling(),
    "welford_rolling_mean": WelfordRolling(stat="mean"),
    "welford_rolling_variance": WelfordRolling(stat="variance"),
    "sma": Sma(16),
    "ema": Ema(10),
    "ema_alpha": Ema(10, alpha=3.5),
    "alma": Alma(12),
    "alma_custom": Alma(12, sigma=4.0, offset=0.6),
    "lag": Lag(5),
    "min": Min(9),
    "max": Max(9),
    "hl_normalizer": HLNormalizer(12),
    "cumulative": Cumulative(7),
    "roc": Roc(10),
    "welford_online": WelfordOnline(8),
    "welford_online_mean": WelfordOnline(8, stat="mean"),
    "welford_online_variance": WelfordOnline(8, stat="variance"),
    "vst": Vst(8),
    "vsct": Vsct(8),
    "binary_entropy": BinaryEntropy(10, CENTRED),
    "rsi": Rsi(14),
    "my_rsi": MyRSI(14),
    "net": NoiseElimination(10),
    "cti": CorrelationTrend(12),
    "center_of_gravity": CenterOfGravity(10),
    "cyber_cycle": CyberCycle(8),
    "pfe": PolarizedFractalEfficiency(10, smoother=Ema(4)),
    "fisher": EhlersFisher(10, smoother=Ema(4)),
    "laguerre_rsi": LaguerreRSI(8),
    "laguerre_filter": LaguerreFilter(0.6),
    "super_smoother": SuperSmoother(10),
    "roofing": RoofingFilter(10, smooth=5),
    "reflex": ReFlex(12),
    "reflex_w9": ReFlex(9),
    "trendflex": TrendFlex(12),
    "chain_hl_roc_ema": HLNormalizer(20, Roc(15, Ema(10))),
    "chain_alma_vsct": Alma(12, Vsct(12)),
    "chain_cti_sma": CorrelationTrend(8, Sma(5)),
    "chain_hl_sma": HLNormalizer(4, Sma(6)),
    "tree_readme": HLNormalizer(12, Add(Roc(10, Ema(6)), Rsi(8, Sma(5)))),
    "net_my_rsi": NoiseElimination(8, MyRSI(10)),
}

#: Views that are also run together, over one exchange.
TOGETHER = ("sma", "ema", "rsi", "roc", "hl_normalizer", "super_smoother", "trendflex", "chain_hl_roc_ema")


def rounded(name: str):
    """Six places, without a negative zero; the shift moves decimal ties, which engines round either way."""
    return (F.round(F.col(name) + F.lit(1.7e-8), 6) + F.lit(0.0)).alias(name)


def on_events(view: View) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "value")
        return features(events, "user_id", ["ts", "event_id"], {"out": view}).select("event_id", "user_id", rounded("out"))

    return query


def on_orders(view: View) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
        made = features(orders, "o_custkey", ["o_orderdate", "o_orderkey"], {"out": view}, value="o_totalprice")
        return made.select("o_orderkey", "o_custkey", rounded("out"))

    return query


#: Views that also run over few long series: the events of each type.
LONG = ("sma", "ema", "hl_normalizer", "cti", "center_of_gravity", "trendflex", "welford_online", "chain_hl_roc_ema")


def on_types(view: View) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "ts", "value")
        return features(events, "event_type", ["ts", "event_id"], {"out": view}).select("event_id", "event_type", rounded("out"))

    return query


def all_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "value")
    made = features(events, "user_id", ["ts", "event_id"], {n: VIEWS[n] for n in TOGETHER})
    return made.select("event_id", "user_id", *[rounded(n) for n in TOGETHER])


def final_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last outputs of each series."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "value")
    made = features(events, "user_id", ["ts", "event_id"], {"ema": VIEWS["ema"], "rsi": VIEWS["rsi"]})
    return final(made, "user_id", ["ts", "event_id"], ["ema", "rsi"]).select("user_id", rounded("ema"), rounded("rsi"))


def ready_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain without its warm-up rows."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "value")
    made = features(events, "user_id", ["ts", "event_id"], {"out": VIEWS["chain_alma_vsct"]}, drop_warmup=True)
    return made.select("event_id", "user_id", rounded("out"))


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two outputs over the events as a stream of files, written and read again."""
    columns = ["event_id", "user_id", "ts", "value"]
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").select(*columns).schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    made = stream_features(events, "user_id", ["ts", "event_id"], {"ema": VIEWS["ema"], "rsi": VIEWS["rsi"]})
    out = scratch(spark, "stream")
    made.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("event_id", "user_id", rounded("ema"), rounded("rsi"))


def _events_sql(view: View, name: str = "out") -> str:
    return OracleSql("events", "user_id", "event_id", "ts, event_id", "value").sql(view, name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: on_events(view) for name, view in VIEWS.items()}
    found |= {f"long_{name}": on_types(VIEWS[name]) for name in LONG}
    found["orders_ema"] = on_orders(Ema(5))
    found["orders_rsi"] = on_orders(Rsi(4))
    found |= {"all_together": all_together, "final_values": final_values, "ready_rows": ready_rows, "stream": stream}
    return found


def oracle_sql() -> dict[str, str]:
    found = {name: _events_sql(view) for name, view in VIEWS.items()}
    for name in LONG:
        found[f"long_{name}"] = OracleSql("events", "event_type", "event_id", "ts, event_id", "value").sql(VIEWS[name])
    for name, view in (("orders_ema", Ema(5)), ("orders_rsi", Rsi(4))):
        found[name] = OracleSql("orders", "o_custkey", "o_orderkey", "o_orderdate, o_orderkey", "o_totalprice").sql(view)
    joined = " ".join(f"JOIN ({found[n]}) t_{n} USING (event_id)" for n in TOGETHER)
    found["all_together"] = f"SELECT e.event_id, e.user_id, {', '.join(f't_{n}.out AS {n}' for n in TOGETHER)} FROM events e {joined}"
    last = "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id"
    found["final_values"] = f"SELECT l.user_id, a.out AS ema, b.out AS rsi FROM ({last}) l JOIN ({found['ema']}) a USING (event_id) JOIN ({found['rsi']}) b USING (event_id)"
    found["stream"] = f"SELECT a.event_id, a.user_id, a.out AS ema, b.out AS rsi FROM ({found['ema']}) a JOIN ({found['rsi']}) b USING (event_id)"
    found["ready_rows"] = f"SELECT * FROM ({found['chain_alma_vsct']}) WHERE out IS NOT NULL"
    return found
