import math
import random

import duckdb
import pytest

from rillwave import features, final
from rillwave.operators.kernels import Kernel, Program
from rillwave.operators.views import (
    GTE, LTE, Add, Alma, BinaryEntropy, CenterOfGravity, Constant, CorrelationTrend, Cumulative, Custom, CyberCycle, Divide, Drawdown, Echo, EhlersFisher, Ema,
    Expression, HLNormalizer, Lag, LaguerreFilter, LaguerreRSI, LnReturn, Max, Min, Multiply, MyRSI, NoiseElimination, PolarizedFractalEfficiency, ReFlex, Roc,
    RoofingFilter, Rsi, Sma, Subtract, SuperSmoother, Tanh, TrendFlex, Vsct, Vst, WelfordOnline, WelfordRolling,
)
from rillwave.oracle import OracleSql
from rillwave.plans.windows import expressible

N = None
VECTORS = [
    (Sma(2), [1, 2, 3, 4, 5], [N, 1.5, 2, 3, 4]),
    (Lag(3), [1, 2, 3, 4, 5], [N, N, 1, 2, 3]),
    (Cumulative(2), [1, 2, 3, 4], [2, 4, 6, 8]),
    (WelfordOnline(2), [1, 2, 4], [0, 0.7071068, 1.6298006]),
    (WelfordOnline(2, stat="mean"), [1, 2, 4], [1, 1.5, 2.875]),
    (HLNormalizer(2), [5, 1, 2, 3, 4, 3.5], [0, -1, -0.5, 1, 1, 0.6666667]),
    (HLNormalizer(2, Sma(3)), [1, 2, 3], [0, 0, 0]),
    (Alma(2), [1, 2, 4], [1, 1.99999999, 3]),
    (NoiseElimination(5), [1, 2, 3, 4, 5], [N, 0, 0, 0.1666667, 0.3]),
    (NoiseElimination(5), [1, 1, 1, 1], [N, 0, 0, -0.1666667]),
    (CorrelationTrend(3), [1, 2, 3], [0, 0.8660254, 1]),
    (CyberCycle(6), [1, 4, 9, 16, 25, 36], [0, 0, 0, 0, 0, 1.2244898]),
    (LaguerreRSI(3), [1, 2, 4, 8], [N, N, 1, 0.8333333]),
    (PolarizedFractalEfficiency(3), [2, 2, 2], [N, N, 3]),
    (Ema(3), [1, 2, 3, 4], [N, N, 2.25, 3.125]),
    (Ema(3), [0, 0, 4, 8], [N, N, 4, 6]),
    (BinaryEntropy(4), [-1, 1, -1, 1], [0, 1, 0.9182958, 1]),
    (BinaryEntropy(10), [1] * 10, [0] * 10),
    (Rsi(2), [1, 2, 1, 3], [N, 100, 50, 66.6666667]),
    (MyRSI(2), [1, 2, 1, 3], [N, 1, 0, 0.3333333]),
    (Roc(2), [1, 2, 4, 8], [0, 100, 300, 300]),
    (CenterOfGravity(3), [1, 2, 3], [0, 0.1666667, 0.3333333]),
    (LaguerreFilter(0.5), [1, 2], [1, 1.03125]),
    (Drawdown(), [100, 80, 110, 95, 87], [0, 0.2, 0.2, 0.2, 0.20909090909]),
    (Drawdown(), [-5, -9, -1], [0, 0, 0]),
    (LnReturn(), [100, 110, 0, 5, 10], [N, 0.09531017980432493, N, N, 0.6931471805599453]),
    (Min(3), [1, 2, 0.5, 1.1, 1.2, 1.3, 1.4], [1, 1, 0.5, 0.5, 0.5, 1.1, 1.2]),
    (Max(3), [1, 2, 0.5, 1.1, 1.2, 1.3, 1.4], [1, 2, 2, 2, 1.2, 1.3, 1.4]),
    (GTE(1.0), [2, 0.5], [2, 1]),
    (LTE(1.0), [0.5, 1.5], [0.5, 1]),
    (Add(Echo(), Lag(2)), [1, 2, 3], [N, 3, 5]),
    (Subtract(Echo(), Constant(1.0)), [1, 2], [0, 1]),
    (Multiply(Echo(), Constant(3.0)), [1, 2], [3, 6]),
    (Divide(Echo(), Lag(2)), [0, 2, 4], [N, N, 2]),
    (Tanh(), [0, 1], [0, math.tanh(1)]),
    (WelfordRolling(), [1, 2, 4], [0, 0.5, 1.2472191]),
    (Vst(4), [3, 3, 3, 3], [N, N, 3, 3]),
    (Vsct(4), [3, 3, 3, 3], [N, N, 0, 0]),
]


def same(a, b, tolerance=1e-6):
    return (a is None) == (b is None) and (a is None or abs(a - b) <= tolerance * max(1.0, abs(b)))


@pytest.mark.parametrize(("view", "values", "want"), VECTORS, ids=lambda x: type(x).__name__ if hasattr(x, "sources") else "")
def test_kernels_give_the_known_vectors(view, values, want):
    got = Program([view]).scan([float(x) for x in values])[0]
    assert len(got) == len(want) and all(map(same, got, want)), (got, want)


def walk(n, seed, kind="walk"):
    rng, x, out = random.Random(seed), 100.0, []
    for _ in range(n):
        x += rng.gauss(0, 1)
        out.append({"walk": x, "zeros": rng.choice([0.0, 0.0, 1.0, -1.0, 2.0]), "flat": 5.0, "signed": rng.gauss(0, 3)}[kind])
    return out


@pytest.fixture(scope="module")
def series(spark):
    rows = [(k, t, x) for k, kind in enumerate(["walk", "zeros", "flat", "signed"]) for t, x in enumerate(walk(70, k, kind))]
    rows += [(9, 0, 4.0), (9, 1, 5.0)]
    return spark.createDataFrame(rows, "k long, t long, value double").repartition(3)


TREES = {f"v{i}": view for i, (view, *_) in enumerate(VECTORS)} | {
    "sma_ln": Sma(3, LnReturn()), "unequal": Add(Sma(5), Rsi(3)), "cti_lag": CorrelationTrend(4, Lag(3)), "roc_sma": Roc(3, Sma(2)), "dd_ln": Drawdown(LnReturn()),
    "max_div": Max(3, Divide(Echo(), Lag(2))), "tanh_roc_ln": Tanh(Roc(2, LnReturn())), "gte_ln": GTE(0.0, LnReturn()), "times": Multiply(Constant(2.0), MyRSI(3, NoiseElimination(5))),
    "alma_cum": Subtract(Alma(6), Cumulative(3)), "rolling_lag": WelfordRolling(Lag(4)), "entropy": BinaryEntropy(5, Subtract(Echo(), Constant(1.0))), "lag1": Lag(1), "sma1": Sma(1),
    "net1": NoiseElimination(1), "rsi1": Rsi(1), "cti1": CorrelationTrend(1), "const": Min(2, Constant(3.0)), "cum_dd": Cumulative(2, Drawdown(Sma(4))),
}


def collected(df, names):
    return {(r["k"], r["t"]): {n: r[n] for n in names} for r in df.collect()}


def test_windows_agree_with_scans(series):
    trees = {n: view for n, view in TREES.items() if expressible(view)}
    assert len(trees) > 35
    a, b = (collected(features(series, "k", "t", trees, engine=e), trees) for e in ("window", "scan"))
    assert {(i, n): (a[i][n], b[i][n]) for i in b for n in trees if not same(a[i][n], b[i][n])} == {}


def same_or_nan(a, b):
    return a is not None and b is not None and (math.isnan(a) and math.isnan(b) or a == b) or same(a, b)


@pytest.mark.parametrize("values", [[1.0, math.inf, 2.0, -math.inf, math.inf, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0], [1e300, 1e300, -1e300, 1e300, 5.0, 6.0, 7.0, 8.0, 9.0, 1.0, 2.0, 4.0]])
def test_windows_agree_with_scans_beyond_finite_numbers(spark, values):
    df = spark.createDataFrame([(k, t, x) for k in range(2) for t, x in enumerate(values)], "k long, t long, value double")
    trees = {"sma": Sma(3), "cum": Cumulative(3), "alma": Alma(3), "cog": CenterOfGravity(3), "cti": CorrelationTrend(3), "rsi": Rsi(3), "my": MyRSI(3), "roc": Roc(2), "ln": LnReturn(), "min": Min(3), "max": Max(3), "entropy": BinaryEntropy(3)}
    if values[0] == 1e300:
        del trees["cog"]  # a sum of 1e300, -1e300 and 5 depends on the order of addition
    a, b = (collected(features(df, "k", "t", trees, engine=e), trees) for e in ("window", "scan"))
    assert {(i, n): (a[i][n], b[i][n]) for i in b for n in trees if not same_or_nan(a[i][n], b[i][n])} == {}


def test_sums_may_overflow():
    values = [1e308, 1e308, -1e308, 1e308, -1e308, -1e308, 5.0, 6.0, math.nan, math.inf, -math.inf, 1.0, 2.0, 3.0, 4.0]
    for view in [Sma(3), Cumulative(3), Alma(3), CenterOfGravity(3), CorrelationTrend(3), PolarizedFractalEfficiency(4), TrendFlex(3), WelfordRolling(), Rsi(3), BinaryEntropy(3)]:
        assert len(Program([view]).scan(values)[0]) == len(values)


def test_reflex_of_two_runs_through():
    with pytest.warns(UserWarning, match="unstable"):
        view = ReFlex(2)
    out = Program([view]).scan(walk(5000, 3))[0]
    assert len(out) == 5000 and out[0] is None and math.isfinite(out[50])


def test_series_side_by_side_give_what_kernels_give(monkeypatch):
    import pyarrow as pa

    from rillwave.plans import scan

    rng = random.Random(3)
    rows = []
    for k in range(200):
        kind = ("walk", "zeros", "flat", "signed", "gaps")[k % 5]
        for t, x in enumerate(walk(rng.choice([1, 2, 3, 5, 17, 40, 45, 60, 64]), k, "walk" if kind == "gaps" else kind)):
            rows.append((k, t, rng.choice([None, 0.0, x, x]) if kind == "gaps" else x))
    rows[700:703] = [(*r[:2], x) for r, x in zip(rows[700:703], (math.inf, math.nan, 1e308))]
    batch = pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64()))], ["k", "t", "__value"])
    views = [t for t in TREES.values() if not any(isinstance(n, Expression) for n in t.nodes())]
    views += [HLNormalizer(12), WelfordOnline(8), Vst(8), Vsct(8), CyberCycle(3), CyberCycle(5), CyberCycle(8), PolarizedFractalEfficiency(10, smoother=Ema(4)), LaguerreRSI(8), ReFlex(12), TrendFlex(12), SuperSmoother(10)]
    views += [RoofingFilter(10, smooth=5), EhlersFisher(9, smoother=Roc(2, LnReturn())), HLNormalizer(20, Roc(15, Ema(10))), NoiseElimination(8, MyRSI(10)), Ema(1), HLNormalizer(1), WelfordOnline(1), TrendFlex(1)]
    made = {}
    for least in (8, 10**9):
        monkeypatch.setattr("rillwave.plans.blocks.LEAST", least)
        monkeypatch.setattr(scan, "LEAST", least)
        made[least] = pa.Table.from_batches(list(scan.scanner(views, ["k"], False, "hold")(iter([batch.slice(0, 1234), batch.slice(1234)]))))
    for i, view in enumerate(views):
        a, b = (made[n].column(f"__out{i}").to_pylist() for n in made)
        assert [(view, j, x, y) for j, (x, y) in enumerate(zip(a, b, strict=True)) if not same_or_nan(x, y)] == []


def test_places_do_not_cancel_on_long_series(spark):
    n, w = 40_000, 12
    df = spark.range(n).selectExpr("0L AS k", "id AS t", "1e6 + sin(id * 1.7) AS value")
    got = collected(features(df, "k", "t", {"cog": CenterOfGravity(w), "cti": CorrelationTrend(w)}, engine="window"), ("cog", "cti"))
    for t in range(n - 20, n):
        q = [1e6 + math.sin(i * 1.7) for i in range(t - w + 1, t + 1)]
        assert abs(got[0, t]["cog"] - (-math.fsum((w - i) * x for i, x in enumerate(q)) / math.fsum(q) + (w + 1) / 2)) < 1e-9


def test_strict_looks_inside_trees(spark):
    df = spark.createDataFrame([(1, t, x) for t, x in enumerate([0.0, 1.0, 2.0])], "k long, t long, value double")
    for engine, view, what in (("window", Divide(Constant(1.0), Echo()), "ZERO"), ("scan", Divide(Constant(1.0), Ema(1)), "division"), ("scan", Ema(1, Multiply(Constant(1e308), Multiply(Constant(10.0), Echo()))), "Multiply must be finite"), ("window", Sma(1, Multiply(Constant(1e308), Multiply(Constant(10.0), Echo()))), "Multiply must be finite")):
        with pytest.raises(Exception, match=what):
            features(df, "k", "t", {"o": view}, strict=True, engine=engine).collect()
    assert features(df, "k", "t", {"o": Divide(Constant(1.0), Echo())}).count() == 3


def test_nulls_hold_the_outputs(spark):
    values = [1.0, None, 2.0, None, None, 4.0, 3.0]
    df = spark.createDataFrame([(1, t, x) for t, x in enumerate(values)], "k long, t long, value double")
    trees = {"echo": Echo(), "sma": Sma(2), "cti": CorrelationTrend(2), "add": Add(Echo(), Sma(2))}
    for engine in ("window", "scan"):
        got = [r for _, r in sorted(collected(features(df, "k", "t", trees, engine=engine), trees).items())]
        assert [r["echo"] for r in got] == [1, 1, 2, 2, 2, 4, 3]
        assert [r["sma"] for r in got][:4] == [None, None, 1.5, 1.5] and got[4]["add"] == 3.5


@pytest.mark.parametrize("w", [1, 2, 3, 6, 16])
def test_every_view_agrees_with_sql(series, w):
    views = [Sma, Ema, Alma, Lag, Min, Max, HLNormalizer, Cumulative, Roc, WelfordOnline, Vst, Vsct, BinaryEntropy, Rsi, MyRSI, NoiseElimination, CorrelationTrend, CenterOfGravity, LaguerreRSI, SuperSmoother, TrendFlex]
    trees = {c.__name__.lower(): c(w) for c in views} | {"roofing": RoofingFilter(w, smooth=4), "filter": LaguerreFilter(0.1 * min(w, 9))}
    if w >= 3:
        trees |= {"cycle": CyberCycle(w), "pfe": PolarizedFractalEfficiency(w, smoother=Ema(2)), "fisher": EhlersFisher(w, smoother=Ema(3)), "chain": HLNormalizer(w, Roc(w, Ema(w)))}
    if w == 16:
        trees["reflex"] = ReFlex(w)
    table = series.toPandas()  # noqa: F841
    got = collected(features(series, "k", "t", trees), trees)
    con = duckdb.connect()
    for name, view in trees.items():
        sql = OracleSql("(SELECT *, k * 1000 + t AS id FROM table)".replace("table", '"table"'), "k", "id", "t", "value").sql(view)
        for row_id, k, y in con.sql(sql).fetchall():
            assert same(got[k, row_id - 1000 * k][name], y, 2e-6), (name, k, row_id, got[k, row_id - 1000 * k][name], y)


def test_means_of_equal_windows_are_equal(spark):
    """A normalizer over a mean turns its last bit into 1 or -1: cases that 0.1 GB of repeated events held."""
    rng = random.Random(6)
    rows = [(k, t, rng.choice([29.27, 0.1, 122.79, 2.11]) if k < 40 else 0.1 if t > 60 else rng.random()) for k in range(42) for t in range(150)]
    df = spark.createDataFrame(rows, "k long, t long, value double").repartition(1)
    table = df.toPandas()  # noqa: F841
    view = HLNormalizer(4, Sma(6))
    sql = OracleSql('(SELECT *, k * 1000 + t AS id FROM "table")', "k", "id", "t", "value").sql(view)
    want = {(k, row_id - 1000 * k): y for row_id, k, y in duckdb.connect().execute(sql).fetchall()}
    got = collected(features(df, "k", "t", {"out": view}), ["out"])
    assert {i: (got[i]["out"], y) for i, y in want.items() if not same(got[i]["out"], y, 2e-6)} == {}
    alone = [Program([view]).scan([x for j, _, x in rows if j == k])[0] for k in range(42)]
    assert [(k, t) for k, t, _ in rows if not same(alone[k][t], want[k, t], 2e-6)] == []


def test_long_means_of_equal_windows_are_equal():
    import numpy as np

    from rillwave.plans import blocks

    rng = random.Random(1)
    values = [rng.randrange(20000) / 100 for _ in range(3000)] + [0.1] * 1000 + [29.27] * 1000
    for w in (6, 100, 200):
        program = Program([HLNormalizer(4, Sma(w))])
        side = blocks.run(program, np.array([values] * 2).T, np.array([len(values)] * 2))[0][0][:, 1]
        for out in (program.scan(values)[0], side.tolist()):
            assert {*out[3000 + w + 8 : 4000], *out[4000 + w + 8 :]} == {0.0}
    odd = [1e308, 1e308, -1e308, 1e308, -1e308, 5.0, math.nan, math.inf, -math.inf, 1e300, -1e300, 1e150, -1e150, 0.0]
    mixed = [rng.choice([*odd, *values[:9]]) if t % 90 < 30 else values[t] for t in range(900)]
    for w in (6, 20):
        program = Program([Sma(w)])
        side, ready = (m[:, 0].tolist() for m in blocks.run(program, np.array([mixed]).T, np.array([len(mixed)]))[0])
        assert all(same_or_nan(a, b if r else None) or a is None and not r for a, b, r in zip(program.scan(mixed)[0], side, ready, strict=True))
        for t in range(60, 900, 90):
            assert all(abs(x - math.fsum(mixed[i - w : i + 1]) / (w + 1)) < 1e-9 for i, x in enumerate(program.scan(mixed)[0]) if t <= i < t + 30)


def test_ranges(spark):
    df = spark.createDataFrame([(1, t, x) for t, x in enumerate(walk(400, 0))], "k long, t long, value double")
    bounds = {"rsi": (Rsi(14), 0, 100), "my": (MyRSI(14), -1, 1), "cti": (CorrelationTrend(10), -1, 1), "hl": (HLNormalizer(10), -1, 1), "lr": (LaguerreRSI(10), 0, 1), "be": (BinaryEntropy(9), 0, 1)}
    rows = features(df, "k", "t", {n: b[0] for n, b in bounds.items()}, drop_warmup=True).collect()
    assert len(rows) > 380 and all(lo - 1e-9 <= r[n] <= hi + 1e-9 for r in rows for n, (_, lo, hi) in bounds.items())


def test_one_exchange_by_key_and_pruned_scan(spark, tmp_path, series):
    from pyspark.sql import functions as F

    series.withColumn("unused", F.lit("x")).write.parquet(f"{tmp_path}/s")
    for outputs in ({"a": Sma(3), "b": Rsi(4, Sma(2)), "c": CorrelationTrend(5)}, {"a": Ema(3), "b": Sma(3)}):
        df = features(spark.read.parquet(f"{tmp_path}/s").select("k", "t", "value"), "k", "t", outputs)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "unused" not in plan.split("ReadSchema")[1]


def test_equal_subtrees_run_once():
    tree = Add(Roc(3, Ema(4)), Multiply(Roc(3, Ema(4)), Ema(4)))
    assert len(Program([tree, Ema(4)]).steps) == 5


def test_long_series_spans_batches(spark):
    n = 30_000
    df = spark.range(n).selectExpr("id % 2 AS k", "id AS t", "sin(id / 50.0) + id % 7 AS value")
    trees = {"ema": Ema(50), "hl": HLNormalizer(100), "sma": Sma(20)}
    got = collected(features(df, "k", "t", trees), trees)
    for k in (0, 1):
        ids = list(range(k, n, 2))
        want = Program(list(trees.values())).scan([math.sin(i / 50.0) + i % 7 for i in ids])
        for name, out in zip(trees, want, strict=True):
            assert all(same(got[k, i][name], y) for i, y in zip(ids, out, strict=True))


def test_own_kernels_and_expressions(series):
    from pyspark.sql import functions as F

    class Doubler(Kernel):
        def step(self, x):
            return 2 * x

    a = collected(features(series, "k", "t", {"x": Sma(2, Custom(Doubler)), "y": Sma(2)}), ("x", "y"))
    assert all(same(r["x"], None if r["y"] is None else 2 * r["y"]) for r in a.values())
    b = collected(features(series, "k", "t", {"x": Sma(2, Expression(lambda c: F.abs(c) + 1)), "y": Sma(2, Expression(lambda c: c))}), ("x", "y"))
    assert any(r["x"] is not None for r in b.values())


def test_options(spark, series):
    assert features(series, "k", "t", {"out": Sma(3)}, dtype="float").schema["out"].dataType.simpleString() == "float"
    df = features(series, ["k"], ["t"], {"e": Ema(3)})
    assert {r["k"]: r["e"] for r in final(df, "k", "t", ["e"]).collect()}[9] is None
    bad = spark.createDataFrame([(1, 1, math.inf)], "k long, t long, value double")
    for view in (Sma(2), Ema(2)):
        with pytest.raises(Exception, match="finite"):
            features(bad, "k", "t", {"out": view}, strict=True).collect()
    for args in ({"outputs": {}}, {"outputs": {"t": Echo()}}, {"outputs": {"o": Ema(2)}, "engine": "window"}, {"outputs": {"o": Echo()}, "nulls": "x"}):
        with pytest.raises(ValueError):
            features(series, "k", "t", **args)
    for view, w in ((Sma, 0), (CyberCycle, 2), (PolarizedFractalEfficiency, 2), (EhlersFisher, 1), (Lag, 1.5)):
        with pytest.raises(ValueError):
            view(w)
    empty = series.limit(0)
    assert features(empty, "k", "t", {"a": Sma(2)}).count() == 0 and features(empty, "k", "t", {"a": Ema(2)}).count() == 0


def test_null_keys_are_a_series(spark):
    df = spark.createDataFrame([(None, 1, 1.0), (None, 2, 2.0), (5, 1, 9.0), (5, 2, 9.5)], "k long, t long, value double")
    for engine in ("window", "scan"):
        got = collected(features(df, "k", "t", {"o": Lag(2)}, engine=engine), ["o"])
        assert got[None, 2]["o"] == 1.0 and got[5, 1]["o"] is None
