"""Candle shapes: -100, 0 or 100 for each bar.

The 61 shapes of the usual candle catalogue by their published definitions.
Lengths are measured against means over the bars before a candle: bodies,
shadows and ranges over ten (``REFERENCE``), nearness over five (``NEAR``).
Two things differ: a confirmation some bars later (twice the value, ``hikkake``)
isn't looked for, and stars and three-in-a-row shapes are the plain ones, which
ask nothing of the bar before the shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

REFERENCE, NEAR = 10, 5
#: What is looked up in earlier bars.
MEASURES = ("open", "high", "low", "close", "mean_body", "mean_range", "mean_shadow", "near_range")
#: Bars that a shape may have.
BARS = 5


class Candle:
    """A bar ``k`` rows back, with what its shape is measured by."""

    def __init__(self, k: int = 0):
        at = {m: F.col(f"__{m}{k}") for m in MEASURES}
        self.o, self.h, self.l, self.c = (at[x] for x in ("open", "high", "low", "close"))
        self.mean_range = at["mean_range"]
        self.body = F.abs(self.c - self.o)
        self.up, self.down = self.c >= self.o, self.c < self.o
        self.top, self.bottom = F.greatest(self.o, self.c), F.least(self.o, self.c)
        self.upper, self.lower = self.h - self.top, self.bottom - self.l
        self.long, self.short = self.body > at["mean_body"], self.body < at["mean_body"]
        self.doji = self.body <= 0.1 * at["mean_range"]
        self.no_upper, self.no_lower = self.upper < 0.1 * at["mean_range"], self.lower < 0.1 * at["mean_range"]
        self.some_upper, self.some_lower = self.upper > 0.1 * at["mean_range"], self.lower > 0.1 * at["mean_range"]
        self.short_upper, self.short_lower = self.upper < at["mean_shadow"] / 2, self.lower < at["mean_shadow"] / 2
        self.near, self.far, self.equal = 0.2 * at["near_range"], 0.6 * at["near_range"], 0.05 * at["near_range"]

    def above(self, other: Candle) -> Column:
        """Its body lies wholly above the other's."""
        return self.bottom > other.top

    def below(self, other: Candle) -> Column:
        return self.top < other.bottom

    def within(self, other: Candle) -> Column:
        """Its body lies inside the other's."""
        return (self.top < other.top) & (self.bottom > other.bottom)


def _signed(good: Column, bad: Column) -> Column:
    return F.when(good, 100).when(bad, -100).otherwise(0)


def _good(condition: Column) -> Column:
    return F.when(condition, 100).otherwise(0)


def _bad(condition: Column) -> Column:
    return F.when(condition, -100).otherwise(0)


def _coloured(condition: Column, x: Candle) -> Column:
    return _signed(condition & x.up, condition & x.down)


def _single(a: Candle, b: Candle) -> dict[str, Column]:
    """Shapes of one bar, some of which look at where the bar before was."""
    middle = a.l + (a.h - a.l) / 2
    return {
        "cdl_doji": _good(a.doji),
        "cdl_dragonflydoji": _good(a.doji & a.no_upper & a.some_lower),
        "cdl_gravestonedoji": _good(a.doji & a.no_lower & a.some_upper),
        "cdl_longleggeddoji": _good(a.doji & ((a.lower > a.body) | (a.upper > a.body))),
        "cdl_rickshawman": _good(a.doji & (a.lower > a.body) & (a.upper > a.body) & (a.bottom <= middle + a.near) & (a.top >= middle - a.near)),
        "cdl_takuri": _good(a.doji & a.no_upper & (a.lower > 2 * a.body)),
        "cdl_spinningtop": _coloured(a.short & (a.upper > a.body) & (a.lower > a.body), a),
        "cdl_highwave": _coloured(a.short & (a.upper > 2 * a.body) & (a.lower > 2 * a.body), a),
        "cdl_longline": _coloured(a.long & a.short_upper & a.short_lower, a),
        "cdl_shortline": _coloured(a.short & a.short_upper & a.short_lower, a),
        "cdl_marubozu": _coloured(a.long & a.no_upper & a.no_lower, a),
        "cdl_closingmarubozu": _signed(a.long & a.up & a.no_upper, a.long & a.down & a.no_lower),
        "cdl_belthold": _signed(a.long & a.up & a.no_lower, a.long & a.down & a.no_upper),
        "cdl_hammer": _good(a.short & (a.lower > 2 * a.body) & a.no_upper & (a.bottom <= b.l + 0.2 * a.mean_range)),
        "cdl_hangingman": _bad(a.short & (a.lower > a.body) & a.no_upper & (a.bottom >= b.h - b.near)),
        "cdl_invertedhammer": _good(a.short & (a.upper > a.body) & a.no_lower & a.below(b)),
        "cdl_shootingstar": _bad(a.short & (a.upper > a.body) & a.no_lower & a.above(b)),
    }


def _pairs(a: Candle, b: Candle) -> dict[str, Column]:
    """Shapes of two bars."""
    opposite = a.up != b.up
    naked = b.long & b.no_upper & b.no_lower & a.long & a.no_upper & a.no_lower
    kicked = naked & ((b.down & a.up & (a.l > b.h)) | (b.up & a.down & (a.h < b.l)))
    longer_up = F.when(a.body > b.body, a.up).otherwise(b.up)
    dipped = b.down & b.long & a.up & (a.o < b.l)
    return {
        "cdl_engulfing": _signed(a.up & b.down & (a.c > b.o) & (a.o < b.c), a.down & b.up & (a.o > b.c) & (a.c < b.o)),
        "cdl_harami": _signed(b.down & b.long & a.short & a.within(b), b.up & b.long & a.short & a.within(b)),
        "cdl_haramicross": _signed(b.down & b.long & a.doji & a.within(b), b.up & b.long & a.doji & a.within(b)),
        "cdl_homingpigeon": _good(b.down & b.long & a.down & a.short & (a.o < b.o) & (a.c > b.c)),
        "cdl_piercing": _good(dipped & a.long & (a.c < b.o) & (a.c > (b.o + b.c) / 2)),
        "cdl_onneck": _bad(dipped & (F.abs(a.c - b.l) <= b.equal)),
        "cdl_inneck": _bad(dipped & (a.c >= b.c) & (a.c <= b.c + b.equal)),
        "cdl_thrusting": _bad(dipped & (a.c > b.c + b.equal) & (a.c <= b.c + b.body * 0.5)),
        "cdl_darkcloudcover": _bad(b.up & b.long & a.down & (a.o > b.h) & (a.c > b.o) & (a.c < (b.o + b.c) / 2)),
        "cdl_dojistar": _signed(b.long & b.down & a.doji & a.below(b), b.long & b.up & a.doji & a.above(b)),
        "cdl_counterattack": _coloured(opposite & b.long & a.long & (F.abs(a.c - b.c) <= b.equal), a),
        "cdl_separatinglines": _signed(opposite & (F.abs(a.o - b.o) <= b.equal) & a.long & a.up & a.no_lower, opposite & (F.abs(a.o - b.o) <= b.equal) & a.long & a.down & a.no_upper),
        "cdl_matchinglow": _good(b.down & a.down & (F.abs(a.c - b.c) <= b.equal)),
        "cdl_kicking": _coloured(kicked, a),
        "cdl_kickingbylength": _signed(kicked & longer_up, kicked & ~longer_up),
    }


def _triples(a: Candle, b: Candle, c: Candle) -> dict[str, Column]:
    """Shapes of three bars."""
    rising, falling = (a.c > b.c) & (b.c > c.c), (a.c < b.c) & (b.c < c.c)
    white, black = a.up & b.up & c.up, a.down & b.down & c.down
    steps_up = (b.o > c.o) & (b.o <= c.c + c.near)
    weaker = (
        ((b.body < c.body - c.far) & (a.body < b.body + b.near)) | (a.body < b.body - b.far)
        | ((a.body < b.body) & (b.body < c.body) & (~a.short_upper | ~b.short_upper)) | ((a.body < b.body) & (a.upper > a.body))
    )
    inside = (b.h < c.h) & (b.l > c.l)
    side = b.up & a.up & (F.abs(a.body - b.body) <= b.near) & (F.abs(a.o - b.o) <= b.equal)
    alike = F.abs(a.body - b.body) < b.near
    caught = (a.o < b.top) & (a.o > b.bottom) & (a.c < c.top) & (a.c > c.bottom)
    return {
        "cdl_morningstar": _good(c.down & c.long & b.short & b.below(c) & a.up & (a.c > (c.o + c.c) / 2)),
        "cdl_eveningstar": _bad(c.up & c.long & b.short & b.above(c) & a.down & (a.c < (c.o + c.c) / 2)),
        "cdl_morningdojistar": _good(c.down & c.long & b.doji & b.below(c) & a.up & ~a.short & (a.c > c.c + c.body * 0.3)),
        "cdl_eveningdojistar": _bad(c.up & c.long & b.doji & b.above(c) & a.down & ~a.short & (a.c < c.c - c.body * 0.3)),
        "cdl_abandonedbaby": _signed(
            c.long & c.down & b.doji & ~a.short & a.up & (a.c > c.c + c.body * 0.3) & (b.h < c.l) & (a.l > b.h),
            c.long & c.up & b.doji & ~a.short & a.down & (a.c < c.c - c.body * 0.3) & (b.l > c.h) & (a.h < b.l),
        ),
        "cdl_tristar": _signed(c.doji & b.doji & a.doji & b.below(c) & (a.bottom > b.bottom), c.doji & b.doji & a.doji & b.above(c) & (a.top < b.top)),
        "cdl_2crows": _bad(c.up & c.long & b.down & b.above(c) & a.down & (a.o < b.o) & (a.o > b.c) & (a.c > c.o) & (a.c < c.c)),
        "cdl_upsidegap2crows": _bad(c.up & c.long & b.down & b.short & b.above(c) & a.down & (a.o > b.o) & (a.c < b.c) & (a.c > c.c)),
        "cdl_3inside": _signed(c.long & c.down & b.short & b.within(c) & a.up & (a.c > c.o), c.long & c.up & b.short & b.within(c) & a.down & (a.c < c.o)),
        "cdl_3outside": _signed(b.up & c.down & (b.c > c.o) & (b.o < c.c) & (a.c > b.c), b.down & c.up & (b.o > c.c) & (b.c < c.o) & (a.c < b.c)),
        "cdl_3whitesoldiers": _good(white & rising & (a.o > b.o) & (a.o <= b.c) & (b.o > c.o) & (b.o <= c.c) & a.no_upper & b.no_upper & c.no_upper),
        "cdl_3blackcrows": _bad(black & falling & (a.o < b.o) & (a.o >= b.c) & (b.o < c.o) & (b.o >= c.c) & a.no_lower & b.no_lower & c.no_lower),
        "cdl_identical3crows": _bad(black & falling & a.no_lower & b.no_lower & c.no_lower & (F.abs(b.o - c.c) <= c.equal) & (F.abs(a.o - b.c) <= b.equal)),
        "cdl_advanceblock": _bad(white & rising & steps_up & (a.o > b.o) & (a.o <= b.c + b.near) & c.long & c.short_upper & weaker),
        "cdl_stalledpattern": _bad(white & rising & c.long & b.long & b.no_upper & steps_up & a.short & (a.o >= b.c - a.body - b.near)),
        "cdl_3starsinsouth": _good(
            black & c.long & (c.lower > c.body) & (b.body < c.body) & (b.o > c.c) & (b.o <= c.h) & (b.l < c.c) & (b.l >= c.l) & b.some_lower
            & a.short & a.no_upper & a.no_lower & (a.l > b.l) & (a.h < b.h)
        ),
        "cdl_unique3river": _good(c.long & c.down & b.down & (b.c > c.c) & (b.o <= c.o) & (b.l < c.l) & a.short & a.up & (a.o > b.l)),
        "cdl_sticksandwich": _good(c.down & b.up & a.down & (b.l > c.c) & (F.abs(a.c - c.c) <= c.equal)),
        "cdl_gapsidesidewhite": _signed(side & b.above(c) & a.above(c), side & b.below(c) & a.below(c)),
        "cdl_tasukigap": _signed(
            b.above(c) & b.up & a.down & (a.o < b.c) & (a.o > b.o) & (a.c < b.o) & (a.c > c.top) & alike,
            b.below(c) & b.down & a.up & (a.o < b.o) & (a.o > b.c) & (a.c > b.o) & (a.c < c.bottom) & alike,
        ),
        "cdl_xsidegap3methods": _signed(c.up & b.up & a.down & b.above(c) & caught, c.down & b.down & a.up & b.below(c) & caught),
        "cdl_hikkake": _signed(inside & (a.h < b.h) & (a.l < b.l), inside & (a.h > b.h) & (a.l > b.l)),
    }


def _longer(a: Candle, b: Candle, c: Candle, d: Candle, e: Candle) -> dict[str, Column]:
    """Shapes of four and five bars."""
    opens_near = lambda x, y: (x.o >= y.bottom - y.near) & (x.o <= y.top + y.near)
    inside = (c.h < d.h) & (c.l > d.l) & (b.h < c.h) & (b.l > c.l)
    in_range = lambda x: (x.bottom < e.h) & (x.top > e.l)
    resting = e.long & d.short & c.short & b.short & a.long & in_range(d) & in_range(c) & in_range(b)
    half = e.c - e.body * 0.5
    return {
        "cdl_3linestrike": _signed(
            d.up & c.up & b.up & a.down & opens_near(c, d) & opens_near(b, c) & (c.c > d.c) & (b.c > c.c) & (a.o > b.c) & (a.c < d.o),
            d.down & c.down & b.down & a.up & opens_near(c, d) & opens_near(b, c) & (c.c < d.c) & (b.c < c.c) & (a.o < b.c) & (a.c > d.o),
        ),
        "cdl_concealbabyswall": _good(
            d.down & c.down & b.down & a.down & d.no_upper & d.no_lower & c.no_upper & c.no_lower & b.below(c) & b.some_upper & (b.h > c.c) & (a.h > b.h) & (a.l < b.l)
        ),
        "cdl_hikkakemod": _signed(inside & (a.h < b.h) & (a.l < b.l) & (c.c <= c.l + c.near), inside & (a.h > b.h) & (a.l > b.l) & (c.c >= c.h - c.near)),
        "cdl_breakaway": _signed(
            e.long & e.down & d.down & b.down & a.up & d.below(e) & (c.h < d.h) & (c.l < d.l) & (b.h < c.h) & (b.l < c.l) & (a.c > d.o) & (a.c < e.c),
            e.long & e.up & d.up & b.up & a.down & d.above(e) & (c.h > d.h) & (c.l > d.l) & (b.h > c.h) & (b.l > c.l) & (a.c < d.o) & (a.c > e.c),
        ),
        "cdl_ladderbottom": _good(e.down & d.down & c.down & (e.o > d.o) & (d.o > c.o) & (e.c > d.c) & (d.c > c.c) & b.down & b.some_upper & a.up & (a.o > b.o) & (a.c > b.h)),
        "cdl_mathold": _good(
            e.long & e.up & d.short & c.short & b.short & d.down & a.up & d.above(e) & (c.bottom < e.c) & (b.bottom < e.c) & (c.bottom > half) & (b.bottom > half)
            & (c.top < d.o) & (b.top < c.top) & (a.o > b.c) & (a.c > F.greatest(d.h, c.h, b.h))
        ),
        "cdl_risefall3methods": _signed(
            resting & e.up & d.down & c.down & b.down & a.up & (c.c < d.c) & (b.c < c.c) & (a.o > b.c) & (a.c > e.c),
            resting & e.down & d.up & c.up & b.up & a.down & (c.c > d.c) & (b.c > c.c) & (a.o < b.c) & (a.c < e.c),
        ),
    }


def patterns() -> dict[str, Column]:
    """Every shape, over the columns that ``candles`` looks up."""
    a, b, c, d, e = (Candle(k) for k in range(BARS))
    return {**_single(a, b), **_pairs(a, b), **_triples(a, b, c), **_longer(a, b, c, d, e)}


def candles(bars: DataFrame, w: WindowSpec) -> DataFrame:
    """Add all patterns; 0 until the reference bars are there.  Earlier bars are looked up once, not per pattern."""
    o, h, lo, c = (F.col(x).cast("double") for x in ("open", "high", "low", "close"))
    mean = lambda x, n: F.when(F.count(x).over(w.rowsBetween(-n, -1)) == n, F.avg(x).over(w.rowsBetween(-n, -1)))
    measured = bars.withColumns({
        "__mean_body": mean(F.abs(c - o), REFERENCE), "__mean_range": mean(h - lo, REFERENCE), "__mean_shadow": mean(h - lo - F.abs(c - o), REFERENCE), "__near_range": mean(h - lo, NEAR),
    })
    source = {m: F.col(m if m in ("open", "high", "low", "close") else f"__{m}") for m in MEASURES}
    looked_up = measured.withColumns({f"__{m}{k}": F.lag(x, k).over(w) if k else x for m, x in source.items() for k in range(BARS)})
    return looked_up.select(*[F.col(f"`{x}`") for x in bars.columns], *[x.alias(n) for n, x in patterns().items()])
