"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from pyspark.sql import SparkSession  # noqa: E402

from rillwave import queries as signals  # noqa: E402
from rillwave.operators import views as v  # noqa: E402
from rillwave.plans.features import features  # noqa: E402

HEADLINE = (
    "sma", "ema", "alma", "cumulative", "roc", "rsi", "my_rsi", "laguerre_rsi", "laguerre_filter", "super_smoother", "roofing", "center_of_gravity", "cti", "net",
    "cyber_cycle", "reflex", "trendflex", "hl_normalizer", "vst", "vsct", "welford_online", "pfe", "fisher", "chain_hl_roc_ema", "tree_readme", "all_together",
)

#: One series of so many values and windows of 1024, the shape of the reference's own benchmarks (10,000 for the quadratic one).
LONG, WINDOW = 100_000, 1024
SINGLE = {
    "sma": v.Sma(WINDOW), "ema": v.Ema(WINDOW), "alma": v.Alma(WINDOW), "cumulative": v.Cumulative(WINDOW), "roc": v.Roc(WINDOW), "rsi": v.Rsi(WINDOW),
    "super_smoother": v.SuperSmoother(WINDOW), "hl_normalizer": v.HLNormalizer(WINDOW), "welford_online": v.WelfordOnline(WINDOW), "trendflex": v.TrendFlex(WINDOW),
    "center_of_gravity": v.CenterOfGravity(WINDOW), "cti": v.CorrelationTrend(WINDOW), "laguerre_filter": v.LaguerreFilter(0.5), "roofing": v.RoofingFilter(256, smooth=WINDOW),
    "my_rsi": v.MyRSI(WINDOW), "laguerre_rsi": v.LaguerreRSI(WINDOW), "net": v.NoiseElimination(WINDOW), "cyber_cycle": v.CyberCycle(WINDOW), "reflex": v.ReFlex(WINDOW),
    "vst": v.Vst(WINDOW), "vsct": v.Vsct(WINDOW), "pfe": v.PolarizedFractalEfficiency(WINDOW, smoother=v.Ema(WINDOW)), "fisher": v.EhlersFisher(WINDOW, smoother=v.Ema(WINDOW)),
    "fisher_walk": v.EhlersFisher(WINDOW, smoother=v.Ema(WINDOW)),
}
#: Many series at once: rows, and rows of each series.
MANY, EACH = 1_000_000, 100
SIDE_BY_SIDE = ("ema", "super_smoother", "roofing", "trendflex", "hl_normalizer", "welford_online")


def timed(df) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = signals.queries()
    for name in ("sma", "ema"):  # start of the JVM, of Python workers and of compilation
        timed(registered[name](spark, sf_dir))
    took = {}
    for name in HEADLINE:
        took[name] = min(timed(registered[name](spark, sf_dir)) for _ in range(2))
    series = spark.range(LONG).selectExpr("0L AS k", "id AS t", "rand(7) AS value").cache()
    short = spark.range(LONG // 10).selectExpr("0L AS k", "id AS t", "rand(7) AS value").cache()
    steps = spark.range(0, LONG, 1, 1).selectExpr("0L AS k", "id AS t", "randn(7) AS step")
    walk = steps.selectExpr("k", "t", "1000 + sum(step) OVER (PARTITION BY k ORDER BY t) AS value").cache()
    many = spark.range(MANY).selectExpr(f"id DIV {EACH} AS k", f"id % {EACH} AS t", "rand(7) AS value").cache()
    for df in (series, short, walk, many):
        df.count()
    for name, view in SINGLE.items():
        df = short if name == "net" else walk if name == "fisher_walk" else series
        for kind in ("double", "float") if name in ("sma", "ema") else ("double",):
            label = f"single_{name}_{'10k' if name == 'net' else '100k'}{'_f32' if kind == 'float' else ''}"
            took[label] = min(timed(features(df, "k", "t", {"out": view}, nulls="absent", dtype=kind)) for _ in range(2))
    for name in SIDE_BY_SIDE:
        took[f"many_{name}_1m"] = min(timed(features(many, "k", "t", {"out": signals.VIEWS[name]}, nulls="absent")) for _ in range(2))
    total = sum(took.values())
    print(json.dumps({"metric": "headline queries, total", "value": round(total, 3), "unit": "sec", "queries": {k: round(x, 3) for k, x in took.items()}, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
