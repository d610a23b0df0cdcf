"""All candle shapes and their SQL."""

from __future__ import annotations

from ..operators import patterns
from .base import BY, HOURLY, W, hourly, query

_BASE = ("open", "high", "low", "close", "up", "dn", "top", "bot", "us", "ls", "body", "lg", "sh", "dj", "nu", "nl", "su", "sl", "hu", "hl", "nr", "fr", "eq", "mr")
_C = f"""{HOURLY}, m AS (SELECT *, CASE WHEN count(*) OVER r = 10 THEN avg(abs(close - open)) OVER r END AS mb, CASE WHEN count(*) OVER r = 10 THEN avg(high - low) OVER r END AS mr,
    CASE WHEN count(*) OVER r = 10 THEN avg(high - low - abs(close - open)) OVER r END AS ms, CASE WHEN count(*) OVER q = 5 THEN avg(high - low) OVER q END AS m5
    FROM bars WINDOW r AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), q AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
  c AS (SELECT *, abs(close - open) AS body, close >= open AS up, close < open AS dn, greatest(open, close) AS top, least(open, close) AS bot, high - greatest(open, close) AS us, least(open, close) - low AS ls, 0.2 * m5 AS nr, 0.6 * m5 AS fr, 0.05 * m5 AS eq FROM m),
  a AS (SELECT *, body > mb AS lg, body < mb AS sh, body <= 0.1 * mr AS dj, us < 0.1 * mr AS nu, ls < 0.1 * mr AS nl, us > 0.1 * mr AS su, ls > 0.1 * mr AS sl, us < ms / 2 AS hu, ls < ms / 2 AS hl FROM c),
  s AS (SELECT *, {', '.join(f"lag({x}, {k}) {BY} AS {x}{k}" for k in (1, 2, 3, 4) for x in _BASE)} FROM a)
  SELECT symbol, ts, """

# each: name, when it is 100, when it is -100
_SHAPES = [
    ("doji", "dj", None), ("dragonflydoji", "dj AND nu AND sl", None), ("gravestonedoji", "dj AND nl AND su", None), ("longleggeddoji", "dj AND (ls > body OR us > body)", None),
    ("rickshawman", "dj AND ls > body AND us > body AND bot <= (low + (high - low) / 2) + nr AND top >= (low + (high - low) / 2) - nr", None), ("takuri", "dj AND nu AND ls > 2 * body", None),
    ("spinningtop", "up AND sh AND us > body AND ls > body", "dn AND sh AND us > body AND ls > body"), ("highwave", "up AND sh AND us > 2 * body AND ls > 2 * body", "dn AND sh AND us > 2 * body AND ls > 2 * body"),
    ("longline", "up AND lg AND hu AND hl", "dn AND lg AND hu AND hl"), ("shortline", "up AND sh AND hu AND hl", "dn AND sh AND hu AND hl"), ("marubozu", "up AND lg AND nu AND nl", "dn AND lg AND nu AND nl"),
    ("closingmarubozu", "lg AND up AND nu", "lg AND dn AND nl"), ("belthold", "lg AND up AND nl", "lg AND dn AND nu"),
    ("hammer", "sh AND ls > 2 * body AND nu AND bot <= low1 + 0.2 * mr", None), ("hangingman", None, "sh AND ls > body AND nu AND bot >= high1 - nr1"),
    ("invertedhammer", "sh AND us > body AND nl AND top < bot1", None), ("shootingstar", None, "sh AND us > body AND nl AND bot > top1"),
    ("engulfing", "up AND dn1 AND close > open1 AND open < close1", "dn AND up1 AND open > close1 AND close < open1"),
    ("harami", "dn1 AND lg1 AND sh AND top < top1 AND bot > bot1", "up1 AND lg1 AND sh AND top < top1 AND bot > bot1"), ("haramicross", "dn1 AND lg1 AND dj AND top < top1 AND bot > bot1", "up1 AND lg1 AND dj AND top < top1 AND bot > bot1"),
    ("homingpigeon", "dn1 AND lg1 AND dn AND sh AND open < open1 AND close > close1", None), ("piercing", "dn1 AND lg1 AND up AND lg AND open < low1 AND close < open1 AND close > (open1 + close1) / 2", None),
    ("onneck", None, "dn1 AND lg1 AND up AND open < low1 AND abs(close - low1) <= eq1"), ("inneck", None, "dn1 AND lg1 AND up AND open < low1 AND close >= close1 AND close <= close1 + eq1"),
    ("thrusting", None, "dn1 AND lg1 AND up AND open < low1 AND close > close1 + eq1 AND close <= close1 + body1 * 0.5"),
    ("darkcloudcover", None, "up1 AND lg1 AND dn AND open > high1 AND close > open1 AND close < (open1 + close1) / 2"), ("dojistar", "lg1 AND dn1 AND dj AND top < bot1", "lg1 AND up1 AND dj AND bot > top1"),
    ("counterattack", "up AND dn1 AND lg1 AND lg AND abs(close - close1) <= eq1", "dn AND up1 AND lg1 AND lg AND abs(close - close1) <= eq1"),
    ("separatinglines", "up AND dn1 AND abs(open - open1) <= eq1 AND lg AND nl", "dn AND up1 AND abs(open - open1) <= eq1 AND lg AND nu"), ("matchinglow", "dn1 AND dn AND abs(close - close1) <= eq1", None),
    ("kicking", "lg1 AND nu1 AND nl1 AND lg AND nu AND nl AND dn1 AND up AND low > high1", "lg1 AND nu1 AND nl1 AND lg AND nu AND nl AND up1 AND dn AND high < low1"),
    ("kickingbylength", "lg1 AND nu1 AND nl1 AND lg AND nu AND nl AND ((dn1 AND up AND low > high1) OR (up1 AND dn AND high < low1)) AND CASE WHEN body > body1 THEN up ELSE up1 END",
     "lg1 AND nu1 AND nl1 AND lg AND nu AND nl AND ((dn1 AND up AND low > high1) OR (up1 AND dn AND high < low1)) AND NOT CASE WHEN body > body1 THEN up ELSE up1 END"),
    ("morningstar", "dn2 AND lg2 AND sh1 AND top1 < bot2 AND up AND close > (open2 + close2) / 2", None), ("eveningstar", None, "up2 AND lg2 AND sh1 AND bot1 > top2 AND dn AND close < (open2 + close2) / 2"),
    ("morningdojistar", "dn2 AND lg2 AND dj1 AND top1 < bot2 AND up AND NOT sh AND close > close2 + body2 * 0.3", None), ("eveningdojistar", None, "up2 AND lg2 AND dj1 AND bot1 > top2 AND dn AND NOT sh AND close < close2 - body2 * 0.3"),
    ("abandonedbaby", "lg2 AND dn2 AND dj1 AND NOT sh AND up AND close > close2 + body2 * 0.3 AND high1 < low2 AND low > high1", "lg2 AND up2 AND dj1 AND NOT sh AND dn AND close < close2 - body2 * 0.3 AND low1 > high2 AND high < low1"),
    ("tristar", "dj2 AND dj1 AND dj AND top1 < bot2 AND bot > bot1", "dj2 AND dj1 AND dj AND bot1 > top2 AND top < top1"),
    ("2crows", None, "up2 AND lg2 AND dn1 AND bot1 > top2 AND dn AND open < open1 AND open > close1 AND close > open2 AND close < close2"),
    ("upsidegap2crows", None, "up2 AND lg2 AND dn1 AND sh1 AND bot1 > top2 AND dn AND open > open1 AND close < close1 AND close > close2"),
    ("3inside", "lg2 AND dn2 AND sh1 AND top1 < top2 AND bot1 > bot2 AND up AND close > open2", "lg2 AND up2 AND sh1 AND top1 < top2 AND bot1 > bot2 AND dn AND close < open2"),
    ("3outside", "up1 AND dn2 AND close1 > open2 AND open1 < close2 AND close > close1", "dn1 AND up2 AND open1 > close2 AND close1 < open2 AND close < close1"),
    ("3whitesoldiers", "up AND up1 AND up2 AND close > close1 AND close1 > close2 AND open > open1 AND open <= close1 AND open1 > open2 AND open1 <= close2 AND nu AND nu1 AND nu2", None),
    ("3blackcrows", None, "dn AND dn1 AND dn2 AND close < close1 AND close1 < close2 AND open < open1 AND open >= close1 AND open1 < open2 AND open1 >= close2 AND nl AND nl1 AND nl2"),
    ("identical3crows", None, "dn AND dn1 AND dn2 AND close < close1 AND close1 < close2 AND nl AND nl1 AND nl2 AND abs(open1 - close2) <= eq2 AND abs(open - close1) <= eq1"),
    ("advanceblock", None, "up AND up1 AND up2 AND close > close1 AND close1 > close2 AND open1 > open2 AND open1 <= close2 + nr2 AND open > open1 AND open <= close1 + nr1 AND lg2 AND hu2 AND ((body1 < body2 - fr2 AND body < body1 + nr1) OR body < body1 - fr1 OR (body < body1 AND body1 < body2 AND (NOT hu OR NOT hu1)) OR (body < body1 AND us > body))"),
    ("stalledpattern", None, "up AND up1 AND up2 AND close > close1 AND close1 > close2 AND lg2 AND lg1 AND nu1 AND open1 > open2 AND open1 <= close2 + nr2 AND sh AND open >= close1 - body - nr1"),
    ("3starsinsouth", "dn AND dn1 AND dn2 AND lg2 AND ls2 > body2 AND body1 < body2 AND open1 > close2 AND open1 <= high2 AND low1 < close2 AND low1 >= low2 AND sl1 AND sh AND nu AND nl AND low > low1 AND high < high1", None),
    ("unique3river", "lg2 AND dn2 AND dn1 AND close1 > close2 AND open1 <= open2 AND low1 < low2 AND sh AND up AND open > low1", None), ("sticksandwich", "dn2 AND up1 AND dn AND low1 > close2 AND abs(close - close2) <= eq2", None),
    ("gapsidesidewhite", "up1 AND up AND abs(body - body1) <= nr1 AND abs(open - open1) <= eq1 AND bot1 > top2 AND bot > top2", "up1 AND up AND abs(body - body1) <= nr1 AND abs(open - open1) <= eq1 AND top1 < bot2 AND top < bot2"),
    ("tasukigap", "bot1 > top2 AND up1 AND dn AND open < close1 AND open > open1 AND close < open1 AND close > top2 AND abs(body - body1) < nr1", "top1 < bot2 AND dn1 AND up AND open < open1 AND open > close1 AND close > open1 AND close < bot2 AND abs(body - body1) < nr1"),
    ("xsidegap3methods", "up2 AND up1 AND dn AND bot1 > top2 AND open < top1 AND open > bot1 AND close < top2 AND close > bot2", "dn2 AND dn1 AND up AND top1 < bot2 AND open < top1 AND open > bot1 AND close < top2 AND close > bot2"),
    ("hikkake", "high1 < high2 AND low1 > low2 AND high < high1 AND low < low1", "high1 < high2 AND low1 > low2 AND high > high1 AND low > low1"),
    ("3linestrike", "up3 AND up2 AND up1 AND dn AND open2 BETWEEN bot3 - nr3 AND top3 + nr3 AND open1 BETWEEN bot2 - nr2 AND top2 + nr2 AND close2 > close3 AND close1 > close2 AND open > close1 AND close < open3",
     "dn3 AND dn2 AND dn1 AND up AND open2 BETWEEN bot3 - nr3 AND top3 + nr3 AND open1 BETWEEN bot2 - nr2 AND top2 + nr2 AND close2 < close3 AND close1 < close2 AND open < close1 AND close > open3"),
    ("concealbabyswall", "dn3 AND dn2 AND dn1 AND dn AND nu3 AND nl3 AND nu2 AND nl2 AND top1 < bot2 AND su1 AND high1 > close2 AND high > high1 AND low < low1", None),
    ("hikkakemod", "high2 < high3 AND low2 > low3 AND high1 < high2 AND low1 > low2 AND high < high1 AND low < low1 AND close2 <= low2 + nr2", "high2 < high3 AND low2 > low3 AND high1 < high2 AND low1 > low2 AND high > high1 AND low > low1 AND close2 >= high2 - nr2"),
    ("breakaway", "lg4 AND dn4 AND dn3 AND dn1 AND up AND top3 < bot4 AND high2 < high3 AND low2 < low3 AND high1 < high2 AND low1 < low2 AND close > open3 AND close < close4",
     "lg4 AND up4 AND up3 AND up1 AND dn AND bot3 > top4 AND high2 > high3 AND low2 > low3 AND high1 > high2 AND low1 > low2 AND close < open3 AND close > close4"),
    ("ladderbottom", "dn4 AND dn3 AND dn2 AND open4 > open3 AND open3 > open2 AND close4 > close3 AND close3 > close2 AND dn1 AND su1 AND up AND open > open1 AND close > high1", None),
    ("mathold", "lg4 AND up4 AND sh3 AND sh2 AND sh1 AND dn3 AND up AND bot3 > top4 AND bot2 < close4 AND bot1 < close4 AND bot2 > close4 - body4 * 0.5 AND bot1 > close4 - body4 * 0.5 AND top2 < open3 AND top1 < top2 AND open > close1 AND close > greatest(high3, high2, high1)", None),
    ("risefall3methods", "lg4 AND sh3 AND sh2 AND sh1 AND lg AND bot3 < high4 AND top3 > low4 AND bot2 < high4 AND top2 > low4 AND bot1 < high4 AND top1 > low4 AND up4 AND dn3 AND dn2 AND dn1 AND up AND close2 < close3 AND close1 < close2 AND open > close1 AND close > close4",
     "lg4 AND sh3 AND sh2 AND sh1 AND lg AND bot3 < high4 AND top3 > low4 AND bot2 < high4 AND top2 > low4 AND bot1 < high4 AND top1 > low4 AND dn4 AND up3 AND up2 AND up1 AND dn AND close2 > close3 AND close1 > close2 AND open < close1 AND close < close4"),
]


def _value(name: str, good: str | None, bad: str | None) -> str:
    cases = (f" WHEN {good} THEN 100" if good else "") + (f" WHEN {bad} THEN -100" if bad else "")
    return f"CASE{cases} ELSE 0 END AS cdl_{name}"


_NAMES = [f"cdl_{s[0]}" for s in _SHAPES]
query("candles_D38", _C + ", ".join(_value(*s) for s in _SHAPES) + " FROM s")(lambda s, d: patterns.candles(hourly(s, d), W()).select("symbol", "ts", *_NAMES))
