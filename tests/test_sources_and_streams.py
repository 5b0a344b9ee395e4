import math

import pytest

from rillwave import features
from rillwave.operators.views import Add, Ema, HLNormalizer, Roc, Rsi, Sma
from rillwave.sources import series as io
from rillwave.streaming.stateful import stream_features

SCHEMA = "k long, t long, value double"
TREES = {"sma": Sma(3), "chain": HLNormalizer(5, Roc(4, Ema(3))), "tree": Add(Ema(2), Rsi(3))}


def rows(n):
    value = lambda k, t: None if (k + t) % 11 == 0 else math.nan if (k, t) == (2, 30) else float((t * 7 + k * 3) % 13) - 4
    return [(k, t, value(k, t)) for k in range(3) for t in range(n)]


@pytest.mark.parametrize("splits", [(40,), (1, 2, 3, 20, 40), (10, 11, 40)])
def test_stream_equals_batch(spark, tmp_path, splits):
    data = rows(40)
    before = 0
    for i, end in enumerate(splits):
        part = [r for r in data if before <= r[1] < end]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/raw{i}")
        before = end
    (tmp_path / "in").mkdir()
    for i in range(len(splits)):
        (file,) = (tmp_path / f"raw{i}").glob("*.parquet")
        file.rename(tmp_path / "in" / f"{i}.parquet")
    stream = io.stream_series(spark, f"{tmp_path}/in", "k", "t", schema=SCHEMA)
    name = f"out_{len(splits)}"
    query = stream_features(stream, "k", "t", TREES).writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = {(r["k"], r["t"]): [r[n] for n in TREES] for r in spark.sql(f"SELECT * FROM {name}").collect()}
    want = {(r["k"], r["t"]): [r[n] for n in TREES] for r in features(spark.createDataFrame(data, SCHEMA), "k", "t", TREES).collect()}
    assert got.keys() == want.keys()
    for i in want:
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9 or a != a and b != b) for a, b in zip(got[i], want[i], strict=True)), (i, got[i], want[i])
    assert math.isnan(got[2, 30][0])


def test_late_rows_are_dropped(spark, tmp_path):
    for i, part in enumerate(([(1, 5, 1.0), (1, 6, 2.0)], [(1, 4, 9.0), (1, 7, 3.0)])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/raw{i}")
    (tmp_path / "in").mkdir()
    for i in range(2):
        (file,) = (tmp_path / f"raw{i}").glob("*.parquet")
        file.rename(tmp_path / "in" / f"{i}.parquet")
    stream = io.stream_series(spark, f"{tmp_path}/in", "k", "t", schema=SCHEMA)
    query = stream_features(stream, "k", "t", {"sma": Sma(2)}).writeStream.format("memory").queryName("late").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["t"], r["sma"]) for r in spark.sql("SELECT * FROM late").collect() if r["sma"]) == [(6, 1.5), (7, 2.0)]


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_formats_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame(rows(5), SCHEMA)
    io.write_features(features(df, "k", "t", {"sma": Sma(2)}), f"{tmp_path}/x", fmt=fmt)
    back = io.read_series(spark, f"{tmp_path}/x", "k", "t", fmt=fmt, schema=f"{SCHEMA}, sma double")
    assert back.columns == ["k", "t", "value"] and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_source_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        io.read_series(spark, f"{tmp_path}/x.csv", "k", "t")
    with pytest.raises(ValueError):
        io.read_series(spark, f"{tmp_path}/x.txt", "k", "t")
    spark.range(2).write.parquet(f"{tmp_path}/y")
    with pytest.raises(ValueError):
        io.read_series(spark, f"{tmp_path}/y", "k", "t", fmt="parquet")
    assert io.from_values(spark, [1.0, None]).count() == 2
