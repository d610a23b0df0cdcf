"""Candle shapes on bars that are made to hold them."""

import datetime as dt

import duckdb
import numpy as np
import pandas as pd

from barlake.functions.core import series
from barlake.operators.patterns import candles
from barlake.plans.base import HOURLY, SQL
from barlake.plans.candles import _NAMES

DAY = dt.datetime(2024, 1, 1)


def frame(spark, rows):
    df = pd.DataFrame(rows, columns=["open", "high", "low", "close"]).astype(float)
    df.insert(0, "symbol", "A")
    df.insert(1, "ts", [DAY + dt.timedelta(hours=i) for i in range(len(df))])
    return df, spark.createDataFrame(df, "symbol string, ts timestamp, open double, high double, low double, close double")


def test_shapes_against_sql_on_coarse_prices(spark):
    """Random bars on a coarse grid, where touching bodies, gaps and dojis are common."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(30_000):
        base = 1000 + 3 * rng.integers(-3, 4)
        o, c = base + rng.integers(-4, 5, 2) * rng.choice([0, 1, 1, 3])
        wide = rng.choice([0, 0, 1, 6], 2)
        rows.append((o, max(o, c) + wide[0], min(o, c) - wide[1], c))
    data, df = frame(spark, rows)
    con = duckdb.connect()
    con.register("bars_in", data)
    want = con.execute(SQL["candles_D38"].replace(HOURLY, "WITH bars AS (SELECT * FROM bars_in)")).df().sort_values("ts")
    got = candles(df, series()).toPandas().sort_values("ts")
    seen = 0
    for n in _NAMES:
        assert (got[n].to_numpy() == want[n].to_numpy()).all(), n
        seen += bool((got[n] != 0).any())
    assert seen >= 45 and set(np.unique(got[_NAMES].to_numpy())) == {-100, 0, 100}


def test_shapes_by_hand(spark):
    """Ten plain bars of body 2 and range 4, then the shape."""
    plain = [(100, 103, 99, 102)] * 10
    cases = {
        "cdl_kicking": ([(102, 102, 92, 92), (110, 120, 110, 120)], 100),
        "cdl_matchinglow": ([(110, 111, 104, 105), (108, 109, 104, 105)], 100),
        "cdl_3outside": ([(102, 103, 100, 101), (100, 104, 99, 103), (103, 106, 102, 105)], 100),
        "cdl_takuri": ([(102, 102.1, 98, 102)], 100),
        "cdl_breakaway": ([(110, 111, 99, 100), (98, 99, 95, 96), (96, 98, 93, 95), (95, 97, 91, 92), (92, 100, 91, 99)], 100),
        "cdl_2crows": ([(100, 111, 99, 110), (114, 115, 111.5, 112), (113, 113.5, 104, 105)], -100),
        "cdl_concealbabyswall": ([(110, 110, 100, 100), (99, 99, 92, 92), (90, 95, 87, 88), (92, 96, 86, 87)], 100),
        "cdl_3linestrike": ([(100, 104, 99, 103), (101, 106, 100, 105), (103, 108, 102, 107), (108, 109, 97, 98)], 100),
        "cdl_hikkake": ([(100, 110, 90, 105), (102, 108, 95, 104), (101, 106, 92, 100)], 100),
    }
    for name, (bars, value) in cases.items():
        _, df = frame(spark, plain + bars)
        assert candles(df, series()).orderBy("ts").collect()[-1][name] == value, name
