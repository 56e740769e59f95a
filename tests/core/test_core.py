import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F
from tidemark import catalog
from tidemark.operators import kernels
from tidemark.operators.spec import OPERATORS, apply, build

#: Bars of each series; more than any operator needs before its first value.
BARS = 280


@pytest.fixture(scope="module")
def bars(spark):
    r = np.random.default_rng(1)
    rows = []
    for s in "ab":
        close = 100 * np.exp(np.cumsum(r.normal(0, 0.01, BARS)))
        for k, c in enumerate(close):
            o = c * (1 + r.normal(0, 0.003))
            rows.append((s, pd.Timestamp("2024-01-01") + pd.Timedelta(hours=k), o, max(o, c) * 1.004, min(o, c) * 0.995, c, float(r.integers(1, 100))))
    frame = pd.DataFrame(rows, columns=["series", "ts", "open", "high", "low", "close", "volume"])
    return frame, spark.createDataFrame(frame).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def run(df, name, **params):
    return apply(df, [build(name, **params)]).orderBy("series", "ts").toPandas()


def test_sma_by_hand(spark):
    closes = [100.0, 101.0, 102.0, 103.0]
    rows = [("x", datetime(2024, 1, 1, k), c, c, c, c, 1.0) for k, c in enumerate(closes)]
    df = spark.createDataFrame(rows, "series string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    assert [None if pd.isna(v) else v for v in run(df, "sma", period=3).value] == [None, None, 101.0, 102.0]


def test_against_pandas(bars):
    frame, df = bars
    by = frame.groupby("series")
    want = {
        ("ema", ()): by.close.transform(lambda c: c.ewm(span=20, adjust=False).mean()),
        ("zscore", ()): by.close.transform(lambda c: (c - c.rolling(20).mean()) / c.rolling(20).std(ddof=0)),
        ("wma", ()): by.close.transform(lambda c: c.rolling(20).apply(lambda x: (x * np.arange(1, 21)).sum() / 210)),
        ("roc", ()): by.close.transform(lambda c: 100 * (c / c.shift(12) - 1)),
        ("historical_volatility", ()): by.close.transform(lambda c: np.log(c).diff().rolling(20).std() * math.sqrt(252) * 100),
    }
    for (name, _), series in want.items():
        got = run(df, name).value.to_numpy()
        ok = ~np.isnan(got)
        assert ok.sum() > 200 and np.allclose(got[ok], series.to_numpy()[ok]), name


def test_every_operator_runs_and_warms_up(bars):
    _, df = bars
    small = [n for n in OPERATORS if n not in ("vwap",)]
    for at in range(0, len(small), 12):
        ops = [build(n) for n in small[at : at + 12]]
        out = apply(df, ops).toPandas()
        assert len(out) == 2 * BARS
        for op in ops:
            for c in op.outputs:
                x = out[f"{op.name}_{c}"]
                assert not np.isinf(x.dropna()).any(), (op.name, c)
            assert out[f"{op.name}_{op.outputs[0]}"].notna().any(), op.name


def test_bundles_equal_single_runs_and_ignore_input_order(bars):
    _, df = bars
    names = ["macd", "rsi", "adx", "bollinger"]
    both = apply(df.repartition(7), [build(n) for n in names]).orderBy("series", "ts").toPandas()
    for n in names:
        one = run(df, n)
        for c in build(n).outputs:
            assert np.allclose(one[c], both[f"{n}_{c}"], equal_nan=True), (n, c)


def test_later_rows_change_nothing(bars):
    _, df = bars
    cut = df.filter("ts < timestamp_ntz'2024-01-04 00:00:00'")
    for n in ("supertrend", "parabolic_sar", "kama", "rsi"):
        whole, part = run(df, n), run(cut, n)
        joined = part.merge(whole, on=["series", "ts"])
        assert np.allclose(joined.value_x, joined.value_y, equal_nan=True)


def test_parameters_are_checked():
    with pytest.raises(ValueError):
        build("sma", period=0)
    with pytest.raises(ValueError):
        build("sma", length=3)
    with pytest.raises(KeyError):
        build("nothing")
    assert build("BB").name == "bollinger"


def test_kernels():
    x = np.array([math.nan, 1.0, 2.0, 3.0, 4.0])
    assert np.allclose(kernels.ema(x, 3), [math.nan, 1, 1.5, 2.25, 3.125], equal_nan=True)
    assert np.allclose(kernels.rma(x, 2), [math.nan, math.nan, 1.5, 2.25, 3.125], equal_nan=True)
    up = np.arange(1.0, 40.0)
    assert (kernels.parabolic_sar(up + 1, up, 0.02, 0.2, "trend") == 1).all()


def test_alignment_and_evaluation(spark):
    from tidemark.plans import align, evaluate

    t = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    right = spark.createDataFrame([("a", t(0), 1.0), ("a", t(4), 2.0)], "series string, ts timestamp_ntz, v double")
    left = spark.createDataFrame([("a", t(-1)), ("a", t(0)), ("a", t(3)), ("a", t(9)), ("b", t(1))], "series string, ts timestamp_ntz")
    assert [r.v for r in align.as_of(left, right, "v").orderBy("series", "ts").collect()] == [None, 1.0, 1.0, 2.0, None]
    long = spark.createDataFrame([("a", t(30 * k), float(k)) for k in range(40)], "series string, ts timestamp_ntz, v double")
    when = spark.createDataFrame([("a", t(7 * k)) for k in range(-3, 190)], "series string, ts timestamp_ntz")
    assert [r.v for r in align.as_of(when, long, "v").orderBy("ts").collect()] == [None if k < 0 else float(min(39, 7 * k // 30)) for k in range(-3, 190)]
    path = [10.0, 11.0, 12.5, 9.0, 4.0]
    bars = spark.createDataFrame([("a", t(k), p, p, p, p, 1.0) for k, p in enumerate(path)], "series string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    got = evaluate.first_passage(bars, up=0.2, down=0.2, horizon=3).orderBy("ts").collect()
    assert [(r.side, r.bars) for r in got] == [("upper", 2), ("lower", 3), ("lower", 1), ("lower", 1), ("none", None)]
    filled = align.forward_fill(bars.filter("close <> 12.5"), 3600, 1).orderBy("ts").collect()
    assert [r.close for r in filled] == [10.0, 11.0, 11.0, 9.0, 4.0] and filled[2].is_forward_filled


def test_stream_equals_batch(spark, tmp_path):
    from tidemark.streaming.live import stream_ema

    rows = spark.createDataFrame([("a", k, float(k * k % 17 + 1)) for k in range(30)], "series string, k long, close double").withColumn("ts", F.timestamp_seconds(F.col("k") * 60)).select("series", "ts", "close")
    for part in range(3):
        rows.filter(F.floor((F.unix_timestamp("ts") / 60) / 10) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream_ema(stream, 5).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    got = spark.sql("SELECT value FROM live ORDER BY ts").toPandas().value.to_numpy()
    want = kernels.ema(rows.orderBy("ts").toPandas().close.to_numpy(), 5)
    assert len(got) == 30 and np.allclose(got[4:], want[4:]) and np.isnan(got[:4]).all()


def test_registry_names():
    assert set(catalog.SQL) <= set(catalog.QUERIES) and "sma" in catalog.SQL
