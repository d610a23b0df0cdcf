"""Queries over indicators; hourly bars of four series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.config import Feature, compute
from ..functions.core import full as full_window
from ..operators import finite as I
from ..operators import recursive, shape
from .base import BY, HOURLY, W, div, full, hourly, lag, lr, over, query, r6

KEY = ("symbol", "ts")


def _features(name, sql_columns, features, columns, prepare=None):
    """A query of registered features over hourly bars."""

    def run(spark, sf_dir):
        bars = hourly(spark, sf_dir)
        return compute(prepare(bars) if prepare else bars, features).select(*KEY, *columns)

    query(name, f"{HOURLY}, x AS (SELECT *, {lr('close')} AS lr, CASE WHEN low > 1e-9 THEN ln(high / low) END AS hl, CASE WHEN {lag('close')} IS NOT NULL THEN greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) END AS tr, (high + low + close) / 3.0 AS tp FROM bars) SELECT symbol, ts, {sql_columns} FROM x")(run)


def _with(bars):
    return I.with_returns(bars, W())


_features("logs_D1", ", ".join(r6(f"ln(1 + {c})", f"{c}_log") for c in ("volume", "dollar_volume")), [Feature("logs")], ["volume_log", "dollar_volume_log"])
_features("log_returns_D2", ", ".join(r6(lr(c), f"log_return_{c}") for c in ("close", "high", "low")), [Feature("log_return")], ["log_return_close", "log_return_high", "log_return_low"])
_features("price_ratios_D3_D6", ", ".join([
    r6(div("close - open", "open"), "price_change_pct"), r6(div("high - low", "low"), "high_low_pct"), r6("CASE WHEN high > low THEN (high - low - abs(open - close)) / (high - low) ELSE 0 END", "wick_vs_range"),
    r6("CASE WHEN high > low THEN abs(open - close) / (high - low) ELSE 0 END", "body_vs_range"), r6(div("close - high", "high"), "close_vs_high_pct"), r6(div("close - low", "low"), "close_vs_low_pct"),
]), [Feature("price_ratios")], ["price_change_pct", "high_low_pct", "wick_vs_range", "body_vs_range", "close_vs_high_pct", "close_vs_low_pct"])
_ATR = full("avg", "tr", 14)
_V5, _V20 = full("avg", "volume", 5), full("avg", "volume", 20)
_features("relative_D7_D10", ", ".join([
    r6(div("dollar_volume", "volume"), "vwap_bar"), r6("close - open", "close_open_diff"), r6("high - low", "high_low_diff"), r6(f"(close - open) / ({_ATR} + 1e-9)", "close_open_diff_atr"), r6(f"(high - low) / ({_ATR} + 1e-9)", "high_low_diff_atr"),
    r6(f"({_V5} - {_V20}) / nullif({_V20}, 0) * 100", "volume_oscillator"),
]), [Feature("relative")], ["vwap_bar", "close_open_diff", "high_low_diff", "close_open_diff_atr", "high_low_diff_atr", "volume_oscillator"], _with)
_features("sma_D11", ", ".join([r6(full("avg", "close", n), f"sma_{n}") for n in (10, 20, 50)] + [r6(full("avg", "volume", 20), "volume_sma_20")]), [Feature("sma", {"n": n}) for n in (10, 20, 50)] + [Feature("sma", {"n": 20, "column": "volume"})], ["sma_10", "sma_20", "sma_50", "volume_sma_20"])
_M, _S = f"({full('avg', 'close', 20)})", f"({full('stddev_pop', 'close', 20)})"
_features("bbands_D12_D13", ", ".join([r6(f"{_M} + 2 * {_S}", "bb_upper_20"), r6(_M, "bb_middle_20"), r6(f"{_M} - 2 * {_S}", "bb_lower_20"), r6(f"4 * {_S} / nullif({_M}, 0)", "bb_width_20"), r6(f"(close - ({_M} - 2 * {_S})) / nullif(4 * {_S}, 0)", "bb_percent_b_20")]),
          [Feature("bbands")], ["bb_upper_20", "bb_middle_20", "bb_lower_20", "bb_width_20", "bb_percent_b_20"])
_features("stddev_D14_D16", ", ".join([r6(full("stddev_pop", "lr", 20), "stddev_20"), r6(full("stddev_samp", "lr", 20), "volatility_20"), r6(full("stddev_samp", "hl", 20), "volatility_hl_20")]), [Feature("stddev", {"n": 20})], ["stddev_20", "volatility_20", "volatility_hl_20"], _with)
query("cci_D17", f"""{HOURLY}, x AS (SELECT symbol, ts, (high + low + close) / 3.0 AS tp FROM bars), y AS (SELECT *, {full('avg', 'tp', 20)} AS m, list(tp) {over(20)} AS l FROM x)
  SELECT symbol, ts, {r6('(tp - m) / nullif(0.015 * list_sum(list_transform(l, lambda v: abs(v - m))) / 20, 0)', 'cci_20')} FROM y""")(lambda s, d: compute(hourly(s, d), [Feature("cci")]).select(*KEY, "cci_20"))
query("mfi_D18", f"""{HOURLY}, x AS (SELECT symbol, ts, (high + low + close) / 3.0 AS tp, volume FROM bars), y AS (SELECT *, tp - {lag('tp')} AS st FROM x),
  z AS (SELECT *, CASE WHEN st > 0 THEN tp * volume WHEN st IS NOT NULL THEN 0 END AS u, CASE WHEN st < 0 THEN tp * volume WHEN st IS NOT NULL THEN 0 END AS dn FROM y), q AS (SELECT *, {full('sum', 'u', 14)} AS a, {full('sum', 'dn', 14)} AS b FROM z)
  SELECT symbol, ts, {r6('a / nullif(a + b, 0) * 100', 'mfi_14')} FROM q""")(lambda s, d: I.mfi(hourly(s, d), W()).select(*KEY, "mfi_14"))
_features("roc_D19", r6(f"(close / nullif({lag('close', 10)}, 0) - 1) * 100", "roc_10"), [Feature("roc")], ["roc_10"])
query("stoch_D20_D21", f"""{HOURLY}, x AS (SELECT *, {full('min', 'low', 14)} AS a, {full('max', 'high', 14)} AS b FROM bars), y AS (SELECT *, (close - a) / nullif(b - a, 0) * 100 AS raw FROM x), k AS (SELECT *, {full('avg', 'raw', 3)} AS k FROM y), e AS (SELECT *, {full('avg', 'k', 3)} AS dd FROM k)
  SELECT symbol, ts, {r6('k', 'stoch_k')}, {r6('dd', 'stoch_d')}, CAST(coalesce(k < 20, false) AS INTEGER) AS is_stoch_os_20, CAST(coalesce(k > 80, false) AS INTEGER) AS is_stoch_ob_80 FROM e""")(
    lambda s, d: I.stochastic(hourly(s, d), W()).select(*KEY, "stoch_k", "stoch_d", "is_stoch_os_20", "is_stoch_ob_80")
)
query("ultosc_D22", f"""{HOURLY}, x AS (SELECT *, {lag('close')} AS p FROM bars), y AS (SELECT *, CASE WHEN p IS NOT NULL THEN close - least(low, p) END AS bp, CASE WHEN p IS NOT NULL THEN greatest(high, p) - least(low, p) END AS rg FROM x),
  z AS (SELECT *, {', '.join(f"({full('sum', 'bp', n)}) / nullif({full('sum', 'rg', n)}, 0) AS a{n}" for n in (7, 14, 28))} FROM y) SELECT symbol, ts, {r6('100 * (4 * a7 + 2 * a14 + a28) / 7', 'ultosc')} FROM z""")(lambda s, d: I.ultimate(hourly(s, d), W()).select(*KEY, "ultosc"))
_H14, _L14 = full("max", "high", 14), full("min", "low", 14)
_features("willr_D23", r6(f"({_H14} - close) / nullif({_H14} - {_L14}, 0) * -100", "willr_14"), [Feature("willr")], ["willr_14"])
query("obv_D24", f"{HOURLY}, x AS (SELECT *, CASE WHEN {lag('close')} IS NULL THEN volume ELSE sign(close - {lag('close')}) * volume END AS v FROM bars) SELECT symbol, ts, {r6(f'sum(v) {BY}', 'obv')} FROM x")(lambda s, d: I.obv(hourly(s, d), W()).select(*KEY, "obv"))
_features("rolling_stats_D25", ", ".join(r6(full(f, "close", 20), f"close_{n}_20") for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))), [Feature("rolling", {"n": 20, "stats": ("mean", "std", "min", "max")})], ["close_mean_20", "close_std_20", "close_min_20", "close_max_20"])
_features("rolling_skew_kurt_D25", r6(full("skewness", "close", 20), "close_skew_20") + ", " + r6(full("kurtosis", "close", 20), "close_kurt_20"), [Feature("rolling", {"n": 20, "stats": ("skew", "kurt")})], ["close_skew_20", "close_kurt_20"])
_features("lags_D26", ", ".join(r6(lag(c, k), f"{c}_lag_{k}") for c in ("close", "volume") for k in (1, 2, 3)), [Feature("lags")], [f"{c}_lag_{k}" for c in ("close", "volume") for k in (1, 2, 3)])
_features("calendar_D36_D37", "CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS dayofweek, CAST(day(ts) AS INTEGER) AS day, CAST(week(ts) AS INTEGER) AS week, CAST(month(ts) AS INTEGER) AS month, CAST(isodow(ts) > 5 AS INTEGER) AS is_weekend, "
          + ", ".join(r6(f"{f}(2 * pi() * {x} / {p})", f"{n}_{f}") for n, x, p in (("hour", "hour(ts)", "24.0"), ("dow", "(isodow(ts) - 1)", "7.0"), ("month", "month(ts)", "12.0")) for f in ("sin", "cos")),
          [Feature("calendar")], ["hour", "dayofweek", "day", "week", "month", "is_weekend", *[f"{n}_{f}" for n in ("hour", "dow", "month") for f in ("sin", "cos")]])
query("rsi_atr_simple_D35", f"""{HOURLY}, x AS (SELECT *, close - {lag('close')} AS st, CASE WHEN {lag('close')} IS NOT NULL THEN greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) END AS tr FROM bars), y AS (SELECT *, CASE WHEN st IS NOT NULL THEN greatest(st, 0) END AS g, CASE WHEN st IS NOT NULL THEN greatest(-st, 0) END AS l FROM x),
  z AS (SELECT *, {full('avg', 'g', 14)} AS a, {full('avg', 'l', 14)} AS b, {full('avg', 'tr', 14)} AS t FROM y) SELECT symbol, ts, {r6('a / nullif(a + b, 0) * 100', 'rsi_simple_14')}, {r6('t', 'atr_simple_14')} FROM z""")(
    lambda s, d: I.simple_rsi(I.with_returns(hourly(s, d), W()), W()).withColumn("atr_simple_14", I.simple_atr(W(), 14)).select(*KEY, "rsi_simple_14", "atr_simple_14")
)

# --- recursive: one row at a time

_RN = f"k AS (SELECT *, row_number() {BY} AS rn FROM bars)"


def _recursive_sql(with_: str, columns: str, source: str) -> str:
    return f"WITH RECURSIVE {HOURLY[5:]}, {_RN}, {with_} SELECT k.symbol, k.ts, {columns} FROM k {source}"


def _ema_sql(name: str, x: str, n: int, start: int = 0, table: str = "k") -> str:
    """Rows from ``start + n`` on (from 1) of an exponential mean of column ``x``."""
    first = start + n
    return f"""{name} AS (SELECT symbol, rn, (SELECT avg({x}) FROM {table} p WHERE p.symbol = q.symbol AND p.rn BETWEEN {start + 1} AND {first}) AS v FROM {table} q WHERE rn = {first}
    UNION ALL SELECT q.symbol, q.rn, e.v + (q.{x} - e.v) * 2.0 / {n + 1} FROM {name} e JOIN {table} q ON q.symbol = e.symbol AND q.rn = e.rn + 1)"""


def _wilder_sql(name: str, x: str, n: int, first: int, table: str) -> str:
    """Wilder's mean of column ``x`` from row ``first`` (from 1) on."""
    at = first + n - 1
    return f"""{name} AS (SELECT symbol, rn, (SELECT avg({x}) FROM {table} p WHERE p.symbol = q.symbol AND p.rn BETWEEN {first} AND {at}) AS v FROM {table} q WHERE rn = {at}
    UNION ALL SELECT q.symbol, q.rn, (e.v * {n - 1} + q.{x}) / {n} FROM {name} e JOIN {table} q ON q.symbol = e.symbol AND q.rn = e.rn + 1)"""


def _recursive(name, spec, columns, sql):
    query(name, sql)(lambda s, d: recursive.recursive(hourly(s, d), spec).select(*KEY, *columns))


_recursive("ema_D29", {"ema": [10, 26]}, ["ema_10", "ema_26"], _recursive_sql(_ema_sql("e1", "close", 10) + ", " + _ema_sql("e2", "close", 26), r6("e1.v", "ema_10") + ", " + r6("e2.v", "ema_26"), "LEFT JOIN e1 USING (symbol, rn) LEFT JOIN e2 USING (symbol, rn)"))
_recursive("macd_D30", {"macd": (12, 26, 9)}, ["macd", "macd_signal", "macd_hist"], _recursive_sql(
    ", ".join([_ema_sql("ef", "close", 12, 14), _ema_sql("es", "close", 26), "ln_ AS (SELECT symbol, rn, ef.v - es.v AS m FROM ef JOIN es USING (symbol, rn))", _ema_sql("sg", "m", 9, 25, "ln_")]),
    ", ".join([r6("CASE WHEN sg.v IS NOT NULL THEN ln_.m END", "macd"), r6("sg.v", "macd_signal"), r6("ln_.m - sg.v", "macd_hist")]), "LEFT JOIN ln_ USING (symbol, rn) LEFT JOIN sg USING (symbol, rn)"))
_STEP = f"st AS (SELECT *, greatest(close - {lag('close')}, 0) AS g, greatest({lag('close')} - close, 0) AS l, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr, CASE WHEN high - {lag('high')} > {lag('low')} - low AND high > {lag('high')} THEN high - {lag('high')} ELSE 0 END AS dp, CASE WHEN {lag('low')} - low > high - {lag('high')} AND {lag('low')} > low THEN {lag('low')} - low ELSE 0 END AS dm FROM k)"
query("rsi_D31_D27", _recursive_sql(", ".join([_STEP, _wilder_sql("a", "g", 14, 2, "st"), _wilder_sql("b", "l", 14, 2, "st"), "r AS (SELECT symbol, rn, CASE WHEN a.v + b.v = 0 THEN 0 ELSE 100 * a.v / (a.v + b.v) END AS v FROM a JOIN b USING (symbol, rn))"]),
    r6("r.v", "rsi_14") + ", CAST(coalesce(r.v > 70, false) AS INTEGER) AS rsi_14_ob, CAST(coalesce(r.v < 30, false) AS INTEGER) AS rsi_14_os, CAST(coalesce(r.v BETWEEN 30 AND 70, false) AS INTEGER) AS rsi_14_neutral", "LEFT JOIN r USING (symbol, rn)"))(
    lambda s, d: recursive.zones(recursive.recursive(hourly(s, d), {"rsi": [14]}), "rsi_14").select(*KEY, "rsi_14", "rsi_14_ob", "rsi_14_os", "rsi_14_neutral")
)
_recursive("atr_natr_D32", {"atr": [14], "natr": [14]}, ["atr_14", "natr_14"], _recursive_sql(", ".join([_STEP, _wilder_sql("a", "tr", 14, 2, "st")]), r6("a.v", "atr_14") + ", " + r6("100 * a.v / nullif(close, 0)", "natr_14"), "LEFT JOIN a USING (symbol, rn)"))
_DX = "dx AS (SELECT p.symbol, p.rn, 100 * p.v / nullif(t.v, 0) AS pdi, 100 * m.v / nullif(t.v, 0) AS mdi, coalesce(100 * abs(100 * p.v / nullif(t.v, 0) - 100 * m.v / nullif(t.v, 0)) / nullif(100 * p.v / nullif(t.v, 0) + 100 * m.v / nullif(t.v, 0), 0), 0) AS x FROM p JOIN m USING (symbol, rn) JOIN t USING (symbol, rn))"
_recursive("adx_D33", {"adx": [14]}, ["plus_di_14", "minus_di_14", "adx_14"], _recursive_sql(", ".join([_STEP, _wilder_sql("p", "dp", 14, 2, "st"), _wilder_sql("m", "dm", 14, 2, "st"), _wilder_sql("t", "tr", 14, 2, "st"), _DX, _wilder_sql("ad", "x", 14, 15, "dx")]),
    ", ".join([r6("dx.pdi", "plus_di_14"), r6("dx.mdi", "minus_di_14"), r6("ad.v", "adx_14")]), "LEFT JOIN dx USING (symbol, rn) LEFT JOIN ad USING (symbol, rn)"))
query("hilbert_D34")(lambda s, d: recursive.recursive(hourly(s, d), {"hilbert": True}).select(*KEY, "ht_trendline", "ht_sine", "ht_leadsine"))


def _regime(spark, sf_dir):
    bars = recursive.recursive(hourly(spark, sf_dir), {"ema": [12, 26], "adx": [14]})
    named = bars.withColumnsRenamed({"ema_12": "ema_fast", "ema_26": "ema_slow", "adx_14": "adx"})
    return I.regimes(named).select(*KEY, "regime_strong_up", "regime_weak_up", "regime_strong_down", "regime_weak_down", "regime_ranging")


_f = lambda c, n: f"CAST(coalesce({c}, false) AS INTEGER) AS {n}"
query("regime_D28", _recursive_sql(", ".join([_STEP, _wilder_sql("p", "dp", 14, 2, "st"), _wilder_sql("m", "dm", 14, 2, "st"), _wilder_sql("t", "tr", 14, 2, "st"), _DX, _wilder_sql("ad", "x", 14, 15, "dx"), _ema_sql("ef", "close", 12), _ema_sql("es", "close", 26)]),
    ", ".join([_f("ef.v > es.v AND ad.v > 25", "regime_strong_up"), _f("ef.v > es.v AND NOT ad.v > 25", "regime_weak_up"), _f("ef.v < es.v AND ad.v > 25", "regime_strong_down"), _f("ef.v < es.v AND NOT ad.v > 25", "regime_weak_down"), _f("NOT ad.v > 25", "regime_ranging")]),
    "LEFT JOIN ef USING (symbol, rn) LEFT JOIN es USING (symbol, rn) LEFT JOIN ad USING (symbol, rn)"))(_regime)

# --- shapes

query("peaks_divergence_D39_D40")(lambda s, d: shape.divergences(hourly(s, d)).select(*KEY, "is_high_peak", "is_low_peak", "bearish_divergence", "bullish_divergence"))


def _profile_sql(n: int, bins: int, least: int, outward: bool) -> str:
    """Bins of each bar's window as lists; the value area by a fold over the list."""
    base = f"""WITH RECURSIVE {HOURLY[5:]}, {_RN}, p AS (SELECT a.symbol, a.ts, a.rn, min(b.low) AS lo, max(b.high) AS hi FROM k a JOIN k b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn - {n - 1} AND a.rn WHERE a.rn >= {least} GROUP BY 1, 2, 3),
  g AS (SELECT p.*, i, lo + (hi - lo) * i / {bins}.0 AS e0, lo + (hi - lo) * (i + 1) / {bins}.0 AS e1 FROM p, range({bins}) r(i)),
  v AS (SELECT g.symbol, g.ts, g.i, min(e0) AS e0, min(e1) AS e1, round(sum(b.volume * CASE WHEN b.high > b.low THEN greatest(least(b.high, e1) - greatest(b.low, e0), 0) / (b.high - b.low) ELSE CAST(g.i = least(CAST(floor((b.low - lo) / (hi - lo) * {bins}) AS BIGINT), {bins - 1}) AS INTEGER) END), 9) AS v
    FROM g JOIN k b ON g.symbol = b.symbol AND b.rn BETWEEN g.rn - {n - 1} AND g.rn GROUP BY 1, 2, 3),
  t AS (SELECT *, sum(v) OVER (PARTITION BY symbol, ts) AS total FROM v)"""
    if not outward:
        body = """, o AS (SELECT *, sum(v) OVER (PARTITION BY symbol, ts ORDER BY v DESC, i ROWS UNBOUNDED PRECEDING) - v AS before FROM t),
  z AS (SELECT symbol, ts, arg_max((e0 + e1) / 2, v) AS poc, min(e0) FILTER (WHERE before < 0.7 * total) AS val, max(e1) FILTER (WHERE before < 0.7 * total) AS vah FROM o GROUP BY 1, 2)"""
    else:
        body = f""", l AS (SELECT symbol, ts, list(v ORDER BY i) AS vs, list(e0 ORDER BY i) AS es, max(e1) AS top, min(total) AS total, arg_min(i, (-v, i)) AS poc FROM t GROUP BY 1, 2),
  w AS (SELECT symbol, ts, poc AS a, poc AS b, vs[poc + 1] AS s FROM l UNION ALL
    SELECT w.symbol, w.ts, a - CAST(dn >= up AS INTEGER), b + CAST(up >= dn AS INTEGER), s + CASE WHEN up = dn THEN up + dn ELSE greatest(up, dn) END FROM (SELECT w.*, l.total, CASE WHEN a > 0 THEN vs[a] ELSE 0 END AS dn, CASE WHEN b < {bins - 1} THEN vs[b + 2] ELSE 0 END AS up FROM w JOIN l USING (symbol, ts)) w WHERE s < 0.7 * total AND (up > 0 OR dn > 0)),
  f AS (SELECT symbol, ts, min(a) AS a, max(b) AS b FROM w GROUP BY 1, 2),
  z AS (SELECT l.symbol, l.ts, (es[poc + 1] + CASE WHEN poc + 2 > {bins} THEN top ELSE es[poc + 2] END) / 2 AS poc, es[f.a + 1] AS val, CASE WHEN f.b + 2 > {bins} THEN top ELSE es[f.b + 2] END AS vah FROM l JOIN f USING (symbol, ts))"""
    return base + body + f" SELECT k.symbol, k.ts, {r6('poc', f'vp_poc_{n}w_{bins}b')}, {r6('val', f'vp_val_{n}w_{bins}b')}, {r6('vah', f'vp_vah_{n}w_{bins}b')} FROM k LEFT JOIN z USING (symbol, ts)"


_vp = lambda n, b: [f"vp_{x}_{n}w_{b}b" for x in ("poc", "val", "vah")]
query("volume_profile_a_D41", _profile_sql(50, 20, 50, True))(lambda s, d: shape.volume_profile(hourly(s, d), 50, 20).select(*KEY, *_vp(50, 20)))
for _n in (50, 100):
    for _b in (50, 100):
        query(f"volume_profile_a_{_n}w_{_b}b_D41", _profile_sql(_n, _b, _n, True))(lambda s, d, n=_n, b=_b: shape.volume_profile(hourly(s, d), n, b).select(*KEY, *_vp(n, b)))
query("volume_profile_b_D42", _profile_sql(50, 20, 25, False))(lambda s, d: shape.volume_profile(hourly(s, d), 50, 20, outward=False, least=25).select(*KEY, *_vp(50, 20)))

# --- documented extras

query("percent_rank", f"{HOURLY} SELECT symbol, ts, {r6('percent_rank() OVER (PARTITION BY symbol ORDER BY close)', 'rank')} FROM bars")(lambda s, d: hourly(s, d).select(*KEY, F.percent_rank().over(Window.partitionBy("symbol").orderBy("close")).alias("rank")))
query("zscore", f"{HOURLY} SELECT symbol, ts, {r6(f'(close - ({full('avg', 'close', 20)})) / nullif({full('stddev_samp', 'close', 20)}, 0)', 'z')} FROM bars")(
    lambda s, d: hourly(s, d).select(*KEY, F.try_divide(F.col("close") - full_window(F.avg, "close", 20, W()), full_window(F.stddev_samp, "close", 20, W())).alias("z"))
)
query("regime_tertiles", f"{HOURLY} SELECT symbol, ts, CAST(ntile(3) OVER (PARTITION BY symbol ORDER BY volume, ts) AS INTEGER) AS state FROM bars")(lambda s, d: hourly(s, d).select(*KEY, F.ntile(3).over(Window.partitionBy("symbol").orderBy("volume", "ts")).alias("state")))
query("bar_shape", f"{HOURLY} SELECT symbol, ts, {r6(div('close - open', 'high - low'), 'bar_bias')}, {r6(div('high - greatest(open, close)', 'high - low'), 'upper_wick')}, {r6(div('least(open, close) - low', 'high - low'), 'lower_wick')} FROM bars")(
    lambda s, d: hourly(s, d).select(*KEY, F.try_divide(F.expr("close - open"), F.expr("high - low")).alias("bar_bias"), F.try_divide(F.expr("high - greatest(open, close)"), F.expr("high - low")).alias("upper_wick"), F.try_divide(F.expr("least(open, close) - low"), F.expr("high - low")).alias("lower_wick"))
)
query("roll_spread", f"{HOURLY}, x AS (SELECT *, close - {lag('close')} AS dp FROM bars), y AS (SELECT *, {lag('dp')} AS dq FROM x) SELECT symbol, {r6('2 * sqrt(greatest(-covar_samp(dp, dq), 0))', 'spread')} FROM y GROUP BY 1")(
    lambda s, d: hourly(s, d).withColumn("dp", F.col("close") - F.lag("close").over(W())).withColumn("dq", F.lag("dp").over(W())).groupBy("symbol").agg((2 * F.sqrt(F.greatest(-F.covar_samp("dp", "dq"), F.lit(0.0)))).alias("spread"))
)
query("sign_streaks", f"{HOURLY}, x AS (SELECT *, sign(close - open) AS s FROM bars), c AS (SELECT *, CASE WHEN s = {lag('s')} THEN 0 ELSE 1 END AS n FROM x), y AS (SELECT *, sum(n) {BY} AS g FROM c) SELECT symbol, ts, CAST(row_number() OVER (PARTITION BY symbol, g ORDER BY ts) AS INTEGER) AS streak FROM y")(
    lambda s, d: hourly(s, d).withColumn("s", F.signum(F.col("close") - F.col("open"))).withColumn("g", F.when(F.col("s") == F.lag("s").over(W()), 0).otherwise(1)).withColumn("g", F.sum("g").over(W()))
    .select(*KEY, F.row_number().over(Window.partitionBy("symbol", "g").orderBy("ts")).alias("streak"))
)
