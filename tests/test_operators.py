"""Hand-made cases and properties of the operators."""

import datetime as dt
import math
import zipfile

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barlake.functions.config import Feature, compute
from barlake.functions.core import series
from barlake.operators import bars as B
from barlake.operators import finite, joins, labels, mlprep, profile, recursive, shape
from barlake.sources import files
from barlake.sources.ticks import clean, read_raw

DAY = dt.datetime(2024, 1, 1)


def make_ticks(spark, prices, quotes, maker=None):
    rows = [("A", i, DAY + dt.timedelta(minutes=i), float(p), 1.0, int(q), float(q), None if maker is None else maker[i]) for i, (p, q) in enumerate(zip(prices, quotes))]
    return spark.createDataFrame(rows, "symbol string, trade_id long, timestamp timestamp_ntz, price double, quantity double, quote_cents long, quote_quantity double, isBuyerMaker boolean")


def make_bars(spark, closes, spread=0.0, opens=None):
    rows = [("A", DAY + dt.timedelta(hours=i), float(c if opens is None else opens[i]), float(c + spread), float(c - spread), None if c is None else float(c), 1.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


def test_sequential_reset(spark):
    t = make_ticks(spark, range(1, 11), [4, 4, 4, 10, 25, 3, 3, 3, 3, 1])
    assert [r.num_ticks for r in B.activity_bars(t, 10).orderBy("bar_id").collect()] == [3, 1, 1, 4, 1]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 30), min_size=1, max_size=60))
def test_bars_follow_a_loop(spark, quotes):
    expected, total, n = [], 0, 0
    for q in quotes:
        total, n = total + q, n + 1
        if total >= 25:
            expected.append(n)
            total, n = 0, 0
    if n:
        expected.append(n)
    got = B.activity_bars(make_ticks(spark, [1] * len(quotes), quotes), 25).orderBy("bar_id").collect()
    assert [r.num_ticks for r in got] == expected and sum(r.bar_amount for r in got) == sum(quotes)
    assert all(r.bar_amount >= 25 for r in got[:-1])


def test_bars_do_not_depend_on_slices(spark):
    """A series in slices of a few rows gives the bars of a loop; bars may be longer than slices, and series may have null names."""
    rng = np.random.default_rng(3)
    for threshold, largest in ((50, 30), (1000, 30), (10**9, 30), (1, 3), (7, 40)):
        quotes = rng.integers(0, largest, 400)
        t = make_ticks(spark, [1] * 400, quotes)
        t = t.unionByName(t.withColumn("symbol", F.lit(None).cast("string"))).unionByName(t.withColumns({"symbol": F.lit("B"), "quote_cents": F.col("quote_cents") + 1}))
        got = {(r.symbol, r.trade_id): r.bar_id for r in B.assign_by_threshold(t, "quote_cents", threshold, ["symbol"], B.TICK_ORDER, slice_rows=15).collect()}
        for name, more in (("A", 0), (None, 0), ("B", 1)):
            total, bar = 0, 0
            for i, q in enumerate(quotes.tolist()):
                assert got[name, i] == bar
                total += q + more
                if total >= threshold:
                    total, bar = 0, bar + 1


def test_numbers_and_sums_along_slices(spark):
    from barlake.functions.slices import numbered, running_sum

    rng = np.random.default_rng(4)
    x = rng.integers(0, 50, 300).tolist()
    df = spark.createDataFrame([(["a", "b", None][i % 3], v if i % 7 else None, i) for i, v in enumerate(x)], "k string, v int, i int")
    rows = sorted(df.collect(), key=lambda r: (str(r.k), r.v is not None, r.v or 0, r.i))
    at = {r.i: r.n for r in numbered(df, ["k"], ["v", "i"], "n", rows=10).collect()}
    before = {r.i: r.n for r in running_sum(df, ["k"], ["v", "i"], F.col("i"), "n", rows=10).collect()}
    for k in ("a", "b", None):
        own = [r for r in rows if r.k == k]
        assert [at[r.i] for r in own] == list(range(len(own))) and [before[r.i] for r in own] == [0, *np.cumsum([r.i for r in own])[:-1].tolist()]
    assert sorted(r.n for r in numbered(df, [], ["v", "i"], "n", rows=10).collect()) == list(range(300))


def test_pooled_taker_ratio_weighs_dollar_volume(spark):
    """Two bars: 30 of 40 dollars bought, 10 of 60; pooled 40 to 60, whatever their base volumes."""
    short = make_bars(spark, [1, 2]).select(
        "symbol", F.hour("ts").cast("long").alias("bar_id"), F.col("ts").alias("open_timestamp"), F.col("ts").alias("close_timestamp"), "open", "high", "low", "close", F.when(F.hour("ts") == 0, 1000.0).otherwise(1.0).alias("volume"),
        F.when(F.hour("ts") == 0, 40.0).otherwise(60.0).alias("dollar_volume"), F.lit(2).alias("num_ticks"), F.when(F.hour("ts") == 0, 3.0).otherwise(0.2).alias("taker_buy_sell_ratio"),
        *[F.lit(0.5).alias(c) for c in ("trade_imbalance", "intra_bar_tick_price_volatility", "tick_price_skewness", "tick_price_kurtosis")], F.lit(1).alias("num_directional_changes"),
    )
    assert math.isclose(B.merge_by_count(short, 2).first().taker_buy_sell_ratio, 40 / 60)


def test_value_area_ties_and_gaps():
    """Equal neighbours are both taken, and the area ends where both are empty or at the edge."""
    edges = np.arange(6.0)
    assert shape.value_area(edges, np.array([0.0, 3, 5, 3, 0]), True) == (2.5, 1, 4)
    assert shape.value_area(edges, np.array([9.0, 0, 10, 0, 9]), True) == (2.5, 2, 3)
    assert shape.value_area(edges, np.array([4.0, 1, 2, 1, 4]), True) == (0.5, 0, 5)
    assert shape.value_area(edges, np.array([0.0, 0, 5, 4, 3]), True) == (2.5, 2, 4)


def test_divergences_by_hand():
    """An earlier peak in reach counts though a higher one lies between; the indicator's peaks must differ and be near."""
    price, mark = np.zeros(60), np.full(60, 50.0)
    peaks = np.array([5, 15, 25])
    price[peaks] = [10, 30, 20]
    mark[[6, 15, 24]] = [80, 90, 70]
    assert shape.diverging(price, mark, peaks, np.array([6, 15, 24]), 30) == [25]
    assert shape.diverging(price, mark, peaks, np.array([6, 15, 24]), 15) == []
    assert shape.diverging(price, mark, peaks, np.array([15]), 30) == [] == shape.diverging(price, mark, peaks, np.array([], int), 30)
    assert shape.diverging(price, mark, peaks, np.array([6, 45]), 30) == []


def test_changes_and_ratios(spark):
    r = B.activity_bars(make_ticks(spark, [1, 2, 2, 1, 1, 2], [1] * 6, [False] * 6), 100).first()
    assert (r.num_price_changes, r.num_directional_changes) == (3, 2) and math.isinf(r.taker_buy_sell_ratio) and r.trade_imbalance == 1
    flat = B.activity_bars(make_ticks(spark, [5, 5, 5, 5], [1] * 4), 100).first()
    assert flat.tick_price_skewness == 0 and flat.tick_price_kurtosis == 0 and flat.taker_buy_sell_ratio is None
    bar = B.time_bars(make_ticks(spark, [5, 5, 5, 5], [1] * 4, [True] * 4), "1 hour").first()
    assert bar.price_skew is None and bar.ofi == -1 and bar.close_ts == DAY + dt.timedelta(minutes=59, seconds=59, microseconds=999999)


def test_bars_of_bars_drop_the_rest(spark):
    short = make_bars(spark, range(1, 24), opens=[0] * 23).select(
        "symbol", (F.hour("ts") + 24 * (F.dayofmonth("ts") - 1)).cast("long").alias("bar_id"), F.col("ts").alias("open_timestamp"), F.col("ts").alias("close_timestamp"), "open", "high", "low", "close", "volume", F.lit(1.0).alias("dollar_volume"),
        F.lit(2).alias("num_ticks"), *[F.lit(0.5).alias(c) for c in ("trade_imbalance", "taker_buy_sell_ratio", "intra_bar_tick_price_volatility", "tick_price_skewness", "tick_price_kurtosis")], F.lit(1).alias("num_directional_changes"),
    )
    got = B.merge_by_count(short, 10).orderBy("bar_id").collect()
    assert [(r.open, r.close, r.num_ticks, r.trade_imbalance) for r in got] == [(0, 10, 20, 5), (0, 20, 20, 5)]


def test_label_ties(spark):
    rows = [("A", DAY + dt.timedelta(hours=i), o, h, lo, c, 1.0) for i, (o, h, lo, c) in enumerate([(100.0, 100, 100, 100), (100, 200, 10, 100), (100, 100, 100, 100)])]
    bars = spark.createDataFrame([tuple(float(x) if isinstance(x, int) else x for x in r) for r in rows], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, atr double")
    one = lambda df: [r.label for r in df.orderBy("ts").collect()]
    assert one(labels.fixed_percent(bars, 0.5, 0.5)) == [0, None, None]
    assert one(labels.by_range(bars, "atr")) == [1, None, None]
    assert one(labels.adaptive(bars, "atr")) == [0, None, None]
    assert one(labels.by_range(bars.withColumn("atr", F.lit(0.0)), "atr")) == [None] * 3


def test_label_methods_agree(spark):
    """Slices of a few rows, one slice and a bounded frame give the same labels, those of a loop."""
    rng = np.random.default_rng(1)
    close = 100 + rng.normal(0, 1, 700).cumsum()
    bars = make_bars(spark, close, 0.5)
    bars = bars.union(bars.withColumn("symbol", F.lit("B"))).union(bars.withColumn("symbol", F.lit(None).cast("string")))
    one = lambda df: {(r.symbol, r.ts): r.label for r in df.collect()}
    far = one(labels.fixed_percent(bars, 0.04, 0.04, slice_rows=20))
    assert far == one(labels.fixed_percent(bars, 0.04, 0.04, horizon=700)) == one(labels.fixed_percent(bars, 0.04, 0.04)) and {0, 1} <= set(far.values())
    assert len(far) == 2100
    for i in range(0, 700, 13):
        after = [(c + 0.5 >= close[i] * 1.04, c - 0.5 <= close[i] * 0.96) for c in close[i + 1 :]]
        hit = next(((u, d) for u, d in after if u or d), None)
        assert far["A", DAY + dt.timedelta(hours=i)] == (None if hit is None else int(hit[0] and not hit[1]))


def test_extremes_find_the_first_bar():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 7, 64, 100):
        high, low = rng.normal(size=n), rng.normal(size=n) - 1
        high[rng.integers(n)] = np.nan
        tree = labels.Extremes(high, low)
        start, take, stop = rng.integers(0, n + 2, 200), rng.normal(size=200) + 1, rng.normal(size=200) - 2
        take[:3] = np.nan
        got = tree.first(start, take, stop)
        for i in range(200):
            want = next((j for j in range(start[i], n) if high[j] >= take[i] or low[j] <= stop[i]), n) if take[i] == take[i] else n
            assert got[i] == want


def test_long_series_are_labelled_in_linear_time(spark):
    import time

    rows = spark.range(200_000).select(F.lit("A").alias("symbol"), F.timestamp_seconds("id").alias("ts"), *[(100 + F.col("id") * (1e-9 if c != "low" else 1e-10)).alias(c) for c in ("open", "high", "low", "close")])
    began = time.time()
    done = labels.fixed_percent(rows, 0.5, 0.5, slice_rows=20_000)
    assert done.where("label IS NULL").count() == 200_000 and time.time() - began < 60


def test_asof_keeps_null_payloads(spark):
    left = spark.createDataFrame([("A", 1), ("A", 5), ("A", 7), ("B", 7)], "symbol string, t int")
    right = spark.createDataFrame([("A", 5, "x"), ("A", 6, None)], "symbol string, t int, v string")
    got = {(r.symbol, r.t): (r.t_r, r.v_r) for r in joins.asof_join(left, right, "t", suffix="_r").collect()}
    assert got == {("A", 1): (None, None), ("A", 5): (5, "x"), ("A", 7): (6, None), ("B", 7): (None, None)}


def test_rolling_window_with_a_gap(spark):
    bars = make_bars(spark, [1, 2, 3, 4, 5, 6]).withColumn("close", F.when(F.col("close") != 3, F.col("close")))
    got = [r.sma_2 for r in compute(bars, [Feature("sma", {"n": 2})]).orderBy("ts").collect()]
    assert got == [None, 1.5, None, None, 4.5, 5.5]
    with pytest.raises(KeyError):
        compute(bars, [Feature("no_such")])


def test_recursive_by_hand():
    x = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 10.0])
    assert np.allclose(recursive.ema(x, 3)[2:], x[2:] - 1) and np.isnan(recursive.ema(x, 3)[:2]).all()
    up = recursive.rsi(np.array([1, 2, 3, 2, 3.0]), 2)
    assert np.isnan(up[:2]).all() and up[2] == 100 and math.isclose(up[3], 50) and math.isclose(up[4], 75)
    line, mark, hist = recursive.macd(x, 3, 6, 2)
    assert np.isnan(line[:6]).all() and math.isclose(line[6], 1.5) and math.isclose(hist[9], 0, abs_tol=1e-12)
    a = recursive.atr(x + 1, x - 1, x, 3)
    assert np.isnan(a[:3]).all() and np.allclose(a[3:], 2)
    p, m, adx = recursive.directional(x + 1, x - 1, x, 3)
    assert np.allclose(p[3:], 50) and np.allclose(m[3:], 0) and np.allclose(adx[5:], 100) and np.isnan(adx[:5]).all()


def test_peaks_and_profile():
    x = np.array([0, 2, 1, 3, 3, 1, 5, 0.0])
    assert shape.find_peaks(x).tolist() == [1, 3, 6] and shape.find_peaks(x, least=2).tolist() == [3, 6] and shape.find_peaks(x, distance=3).tolist() == [3, 6]
    edges, v = shape.profile(np.array([0.0, 1, 2]), np.array([1.0, 1, 2]), np.array([4.0, 2, 1]), 2)
    assert edges.tolist() == [0, 1, 2] and v.tolist() == [4, 3]
    assert shape.value_area(np.arange(5.0), np.array([1.0, 5, 2, 4]), True) == (1.5, 1, 4) and shape.value_area(np.arange(5.0), np.array([1.0, 5, 2, 4]), False) == (1.5, 1, 4)


def test_cleaning(spark, tmp_path):
    (tmp_path / "t.csv").write_text("1,1.5,2,3,1000,TRUE,true\n2,x,2,3,1000,0,true\n3,NaN,2,3,1000,1,true\n4,1,2,inf,1000,1,true\n5,1,2,3,1000,x,true\n")
    got = {r.trade_id: r for r in clean(read_raw(spark, str(tmp_path / "t.csv"))).collect()}
    assert set(got) == {1, 5} and got[1].isBuyerMaker is True and got[5].isBuyerMaker is None and got[1].timestamp == dt.datetime(1970, 1, 1, 0, 0, 1)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("note.txt", "no")
        z.write(tmp_path / "t.csv", "t.csv")
    (tmp_path / "b.zip").write_bytes(b"no archive")
    assert files.read_zipped_csv(spark, f"{tmp_path}/*.zip").count() == 5


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("A", 2024, 1, 1.0), ("A", 2024, 2, 2.0)], "symbol string, year int, month int, v double")
    files.write_months(df, f"{tmp_path}/m")
    files.write_months(df.where("month = 2").withColumn("v", F.lit(5.0)), f"{tmp_path}/m")
    assert sorted(r.v for r in spark.read.parquet(f"{tmp_path}/m").collect()) == [1.0, 5.0]
    df.coalesce(1).write.parquet(f"{tmp_path}/s")
    assert files.write_swapped(spark.read.parquet(f"{tmp_path}/s").withColumn("w", F.col("v") * 2), f"{tmp_path}/s", f"{tmp_path}/aside").columns[-1] == "w"
    tolerant = files.read_tolerant(spark, f"{tmp_path}/s", {"value": "double", "gone": "int"}, {"value": ["v"]})
    assert sorted(r.value for r in tolerant.collect()) == [1.0, 2.0] and tolerant.where("gone IS NULL").count() == 2
    (tmp_path / "names").write_text("a\n\n# no\n b \n")
    assert files.read_names(spark, f"{tmp_path}/names") == ["a", "b"]
    files.write_report(df, f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").count() == 2
    (tmp_path / "X_2024_03.parquet").mkdir()
    df.drop("symbol", "year", "month").write.mode("overwrite").parquet(f"{tmp_path}/y/X_2024_03.parquet")
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "T-2024.csv").write_text("12345")
    assert [(r.year, r.files, r.bytes) for r in files.inventory(spark, f"{tmp_path}/z").collect()] == [("2024", 1, 5)]
    assert files.extrapolated(files.inventory(spark, f"{tmp_path}/z"), rows_per_mb=1e6).first().rows == 5
    assert profile.schema_report(df, spark.createDataFrame([], "v int, w int").schema) == {"missing": ["w"], "extra": ["symbol", "year", "month"], "wrong_type": ["v"]}
    assert joins.drop_empty_columns(df.withColumn("e", F.lit(None).cast("int"))).columns == df.columns


def test_split_and_scores(spark):
    df = spark.range(101).withColumn("ts", F.col("id"))
    counts = {r.split: r["count"] for r in mlprep.chronological_split(df, order=["ts"]).groupBy("split").count().collect()}
    assert counts == {"train": 68, "validation": 12, "test": 21}
    scored = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (1, 0.8), (0, 0.2), (1, 0.5)], "y int, p double")
    pairs = [(a, b) for a in (0.9, 0.5, 0.8, 0.5) for b in (0.9, 0.5, 0.1, 0.2)]
    assert math.isclose(mlprep.roc_auc(scored).first().auc, sum((a > b) + 0.5 * (a == b) for a, b in pairs) / 16)
    m = mlprep.threshold_metrics(scored, [0.5, 0.95]).orderBy("threshold").collect()
    assert (m[0].recall, m[1].precision, m[1].f1) == (1, 0, 0) and math.isclose(m[0].precision, 4 / 6)
    split = mlprep.chronological_split(spark.range(200).withColumn("x", F.exp(F.col("id") / 40.0)), order=["id"])
    assert mlprep.scale_power(split, "x").where("split = 'train'").agg(F.abs(F.avg("x"))).first()[0] < 1e-9
    q = [r.x for r in mlprep.scale_quantile(split, "x").where("split = 'train'").orderBy("id").collect()]
    assert q == sorted(q) and q[0] == 0 and q[-1] == 1
    with pytest.raises(KeyError):
        mlprep.scale(split, ["x"], "no_such")


def test_quantiles_by_narrowing(spark):
    """The passes over brackets give the percentiles that a sort gives."""
    rng = np.random.default_rng(6)
    x = {"a": rng.normal(size=3001), "b": rng.integers(0, 5, 3001).astype(float), "c": np.exp(30 * rng.normal(size=3001)), "d": np.full(3001, np.nan)}
    x["a"][:40] = np.nan
    df = spark.createDataFrame([tuple(None if v != v else float(v) for v in row) for row in zip(*x.values())], "a double, b double, c double, d double")
    shares = [0, 0.01, 0.25, 0.5, 0.777, 0.99, 1]
    for rows in (0, 10**6):
        got = profile.quantiles(df, list(x), shares, exact_rows=rows)
        assert got["d"] == [None] * len(shares)
        for c in ("a", "b", "c"):
            assert np.allclose(got[c], np.nanquantile(x[c], shares), rtol=1e-12)


def test_scalers_by_value(spark):
    """Quantile and power scalers against a computation on the driver; and stored ones against those."""
    rng = np.random.default_rng(7)
    x = np.round(np.exp(rng.normal(size=400)) - 1, 3)
    df = spark.createDataFrame([(i, float(v), "train" if i < 300 else "test") for i, v in enumerate(x)], "i int, x double, split string")
    one = lambda d: np.array([r.x for r in d.orderBy("i").collect()])
    marks = np.quantile(x[:300], np.linspace(0, 1, 1001))
    grid = np.linspace(0, 1, 1001)
    want = (np.interp(x, marks, grid) - np.interp(-x, -marks[::-1], -grid[::-1])) / 2
    assert np.allclose(one(mlprep.scale_quantile(df, "x")), want, atol=1e-9)
    turned = np.array([mlprep.NormalDist().inv_cdf(min(max(v, 1e-7), 1 - 1e-7)) for v in want])
    assert np.allclose(one(mlprep.scale_quantile(df, "x", normal=True)), turned, atol=1e-6)

    def power(v, p):
        with np.errstate(all="ignore"):
            return np.where(v >= 0, np.log1p(v) if p == 0 else ((v + 1) ** p - 1) / p, -np.log1p(-v) if p == 2 else -((1 - v) ** (2 - p) - 1) / (2 - p))

    likelihood = [-150 * np.log(power(x[:300], p).var()) + (p - 1) * (np.sign(x[:300]) * np.log1p(np.abs(x[:300]))).sum() for p in mlprep.POWERS]
    moved = power(x, mlprep.POWERS[int(np.argmax(likelihood))])
    scaled = (moved - moved[:300].mean()) / moved[:300].std()
    assert np.allclose(one(mlprep.scale_power(df, "x")), scaled, atol=1e-9)
    for kind, value in (("quantile", want), ("power", scaled), ("robust", (x - np.median(x[:300])) / np.subtract(*np.quantile(x[:300], [0.75, 0.25])))):
        assert np.allclose(one(mlprep.apply_scaler(df, mlprep.fit_scaler(df, ["x"], kind))), value, atol=1e-9)


def test_isotonic_by_pooling(spark):
    rng = np.random.default_rng(8)
    p = np.round(rng.random(120), 2)
    y = (rng.random(120) < p).astype(int)
    rows = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, y int")
    got = {r.p: r.calibrated for r in mlprep.isotonic(rows, rows.select("p").distinct()).collect()}
    blocks = []
    for v in np.unique(p):
        blocks.append([y[p == v].mean(), (p == v).sum(), [v]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    for mean, _, values in blocks:
        assert all(math.isclose(got[v], mean, abs_tol=1e-9) for v in values)


def test_hilbert_of_a_pure_cycle():
    """Of a sine of 20 bars the sine line follows the cycle, the lead sine runs 45 degrees ahead, and the trend line is flat."""
    t = np.arange(400)
    x = 100 + 5 * np.sin(2 * np.pi * t / 20)
    trend, sine, lead = recursive.hilbert(x)
    assert np.isnan(trend[:63]).all() and not np.isnan(trend[63:]).any()
    late = slice(200, 400)
    assert np.abs(trend[late] - 100).max() < 0.5 and np.corrcoef(sine[late], np.sin(2 * np.pi * t[late] / 20))[0, 1] > 0.9
    phase = np.arctan2(np.sqrt(2) * lead[late] - sine[late], sine[late])
    assert np.abs(np.abs(np.cos(phase)) ** 2 + np.abs(np.sin(phase)) ** 2 - 1).max() < 1e-9 and np.allclose((np.sqrt(2) * lead[late] - sine[late]) ** 2 + sine[late] ** 2, 1, atol=1e-9)


def test_gaps_and_fill(spark):
    months = spark.createDataFrame([(2023, 11), (2024, 2)], "year int, month int")
    assert sorted((r.year, r.month) for r in profile.month_gaps(months).collect()) == [(2023, 12), (2024, 1)]
    w = series()
    assert finite.regimes(make_bars(spark, [1]).withColumns({"ema_fast": F.lit(2.0), "ema_slow": F.lit(1.0), "adx": F.lit(None).cast("double")})).first().regime_strong_up == 0 and w is not None


def test_isotonic_returns_every_row_with_its_split(spark, sf_dir):
    from barlake.operators import mlprep
    from barlake.plans import analysis, catalogue

    got = catalogue.queries()["isotonic_M16"](spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert got.count() == n and {r["split"] for r in got.select("split").distinct().collect()} == {"train", "validation", "test"}
    rows = mlprep.chronological_split(analysis._scored(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate"), "o_orderkey"), order=("o_orderdate", "o_orderkey"))
    test = mlprep.isotonic(rows.where("split = 'validation'"), rows.where("split = 'test'")).select("o_orderkey", "calibrated")
    mine = {r.o_orderkey: r.calibrated for r in got.where("split = 'test'").collect()}
    theirs = {r.o_orderkey: r.calibrated for r in test.collect()}
    assert set(mine) == set(theirs) and all(math.isclose(mine[k], v, abs_tol=1e-6) for k, v in theirs.items())
