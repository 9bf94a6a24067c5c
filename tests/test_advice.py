"""Ambition, weather advice and rain in the rule, against loops."""

import datetime as dt
import math
import statistics

import pytest
from pyspark.sql import functions as F

from crumbline.operators import ambition as A
from crumbline.operators import ladder as L
from crumbline.operators import weather as W

DAY = dt.date(2026, 1, 5)


@pytest.mark.parametrize(("share", "k"), [(0.6, 1), (0.6, 3), (0.95, 2), (1.0, 2)])
def test_thinned_chances_are_binomial_tails(spark, share, k):
    chances = [0.97, 0.8, 0.41, 0.1]
    far = [1.0, *chances, *[chances[-1] * 0.5**i for i in range(1, 13)], 0.0]
    tail = lambda d: sum(math.comb(d, j) * share**j * (1 - share) ** (d - j) for j in range(k, d + 1))
    want = sum((far[d] - far[d + 1]) * tail(d) for d in range(k, 17))
    x = spark.createDataFrame([(chances, share, k)], "c array<double>, s double, k int")
    assert x.select(L.thinned(F.col("c"), F.col("s"), F.col("k"))).first()[0] == pytest.approx(want)


def test_rain_takes_trials_and_units_but_never_the_first(spark):
    schema = "item string, base long, quantity long, cap long, be double, chances array<double>"
    d = spark.createDataFrame([("a", 4, 6, 3, 0.3, [0.95, 0.9, 0.8, 0.31, 0.2]), ("b", 1, 1, 1, 0.9, [0.91, 0.2]), ("c", None, None, 2, 0.3, [0.9]), ("e", 0, 0, 0, 0.3, [0.1])], schema)
    got = lambda share, chance: {r["item"]: (r.rainy_base, r.quantity, r.cut) for r in L.rained(d, F.lit(share), F.lit(chance)).collect()}
    # Nobody stays away: nothing changes. Likely rain: no trials. Unlikely: the further units stay.
    assert got(1.0, 0.9) == {"a": (4, 6, 0), "b": (1, 1, 0), "c": (None, None, None), "e": (0, 0, 0)}
    assert got(0.9, 0.6)["a"] == (3, 3, 3)
    assert got(0.7, 0.3)["a"] == (3, 5, 1)
    assert got(0.3, 0.9)["b"] == (1, 1, 0)
    assert got(0.3, 0.9)["e"] == (0, 0, 0)


def days_frame(spark, rows):
    return spark.createDataFrame(rows, "d date, made long, left_over long, items long, sellouts long, profit double")


def test_extra_units_are_settled(spark):
    own = "struct<supply:long,sold:long,eff_price:double,eff_cost:double>"
    x = spark.createDataFrame([("a", DAY, 3, 5, (4, 4, 10.0, 2.0)), ("b", DAY, 3, 5, (9, 4, 10.0, 2.0)), ("c", DAY, 3, 4, (2, 2, 10.0, 2.0)), ("e", DAY, None, None, (2, 2, 10.0, 2.0))], f"item string, t date, base long, quantity long, own {own}")
    assert {r["item"]: (r.suggested, r.made, r.sold, r.dollars) for r in A.settled(x).collect()} == {"a": (2, 1, 1, 8.0), "b": (2, 2, 1, 6.0), "c": (1, 0, 0, 0.0)}


def test_periods_end_with_the_last_day(spark):
    rows = [(DAY + dt.timedelta(n), 10 + n, n % 3, 5, n % 2, float(n * n % 17)) for n in range(60)]
    end = DAY + dt.timedelta(60)
    for since, back in ((None, 14), ((end - dt.timedelta(20)).isoformat(), 20), ((end - dt.timedelta(40)).isoformat(), 14)):
        r = A.periods(days_frame(spark, rows), since).first()
        start = end - dt.timedelta(back)
        recent = [x for x in rows if x[0] >= start]
        earlier = [x for x in rows if start - dt.timedelta(28) <= x[0] < start]
        for name, part in (("recent", recent), ("earlier", earlier)):
            assert r[f"{name}_days"] == len(part)
            assert r[f"{name}_profit"] == pytest.approx(statistics.mean(x[5] for x in part))
            assert r[f"{name}_var"] == pytest.approx(statistics.variance(x[5] for x in part))
            assert r[f"{name}_waste"] == pytest.approx(sum(x[2] for x in part) / sum(x[1] for x in part))
            assert r[f"{name}_sellouts"] == pytest.approx(sum(x[4] for x in part) / sum(x[3] for x in part))
    assert A.periods(days_frame(spark, []), None).first().recent_days == 0


@pytest.mark.parametrize(
    ("change", "level", "verdict"),
    [
        ({}, 3, "steady"), ({"recent_days": 6}, 3, "early"), ({"suggested": 9, "made": 2}, 3, "early"), ({"suggested": 9, "made": 8, "dollars": -1.0}, 3, "too-high"),
        ({"suggested": 9, "made": 8, "dollars": 1.0}, 3, "paying"), ({"suggested": 9, "made": 7, "dollars": 1.0}, 3, "steady"), ({"recent_waste": 0.3}, 3, "too-high"),
        ({"recent_waste": 0.3, "recent_profit": 130.0}, 3, "paying"), ({"recent_profit": 104.0}, 3, "steady"), ({"recent_sellouts": 0.5}, 4, "room"), ({"recent_sellouts": 0.5}, 5, "steady"),
        ({"recent_sellouts": 0.5}, 1, "room"), ({"earlier_days": 0, "earlier_profit": None, "recent_waste": 0.9}, 3, "steady"),
    ],
)
def test_verdicts(spark, change, level, verdict):
    one = {"recent_days": 14, "recent_profit": 100.0, "recent_var": 90.0, "recent_waste": 0.2, "recent_sellouts": 0.2, "earlier_days": 28, "earlier_profit": 100.0, "earlier_var": 90.0, "earlier_waste": 0.2, "suggested": 0, "made": 0, "dollars": 0.0}
    kinds = ", ".join(f"{k} {'double' if isinstance(v, float) else 'long'}" for k, v in one.items())
    x = spark.createDataFrame([tuple((one | change).values())], kinds)
    assert A.judged(x, level).first().verdict == verdict


def test_advice(spark):
    pair = lambda n, ratio, se: (n, ratio, se)
    v = "struct<n:long,ratio:double,se:double>"
    schema = f"dry_days long, lo int, hi int, bands map<string,{v}>, rain map<int,{v}>, rain_n long, unseen {v}, shares map<int,double>, typical double"
    rainy = {1: pair(9, 0.8, 0.05), 2: pair(3, 0.95, 0.035), 3: pair(2, 0.9, 0.2)}
    bands = {"snow": pair(8, 0.5, 0.1), "heavy": pair(2, 0.7, 0.1), "wet": pair(12, 0.85, 0.02)}
    e = lambda dry=90, n=14, b=bands: spark.createDataFrame([(dry, 20, 90, b, rainy, n, pair(0, 0.88, 0.1), {1: 0.25, 2: 0.5}, 0.96)], schema)
    f = [(DAY, "wet", 60, None), (DAY, "dry", 60, 0.5), (DAY + dt.timedelta(1), "wet", 60, 1.0), (DAY + dt.timedelta(2), "heavy", 60, None), (DAY + dt.timedelta(6), "wet", 60, None), (DAY, "snow", 60, 0.9), (DAY, "dry", 60, None), (DAY, "dry", 96, None), (DAY, "wet", 95, None)]
    forecasts = spark.createDataFrame([(i, *x) for i, x in enumerate(f)], "i int, d date, band string, temp_max int, rain_chance double")
    said = lambda effect: {r.i: r for r in W.advised(forecasts, effect).collect()}
    got = said(e())
    assert [got[i].reason for i in range(9)] == ["ok", "ok", "too-noisy", "too-noisy", "too-noisy", "ok", "ok", "out-of-range", "ok"]
    assert [got[i].offered for i in range(9)] == pytest.approx([0.8, 0.9, 0.95, 0.9, 0.88, 0.5, 1.0, None, 0.8])
    # A Monday's plan has a quarter of rain in it, a Tuesday's a half.
    assert got[0].relative == pytest.approx(0.8 / 0.95) and got[2].relative == pytest.approx(0.95 / 0.975) and got[6].relative == pytest.approx(1 / 0.95)
    assert [got[i].credible for i in (0, 2, 3, 6)] == [True, True, False, False]
    assert [got[i].confidence for i in (0, 2, 6, 7)] == ["measured", "weak", "measured", "none"]
    few = said(e(n=7))
    assert few[0].reason == "ok" and few[0].offered == 0.85 and few[0].relative == pytest.approx(0.85 / 0.96)
    assert few[3].reason == "unseen-band" and few[3].offered is None
    assert {r.reason for r in said(e(dry=7)).values()} == {"no-data"} == {r.reason for r in said(e(b={"wet": pair(7, 0.5, 0.1)})).values()}


def test_effect_and_outlook(spark):
    rows = [(DAY + dt.timedelta(n), n % 7 + 1, float(80 + n % 7 * 5 - (20 + n % 4 if n % 5 == 0 else 0) + n % 3), "wet" if n % 5 == 0 else "dry", 40 + n % 30) for n in range(140)]
    days = spark.createDataFrame(rows, "d date, dow int, sold double, band string, temp_max int")
    r = W.effect(days).first()
    dry = [x for x in rows if x[3] == "dry"]
    ratios = []
    for d, dow, sold, band, _ in rows:
        others = [x[2] for x in dry if x[1] == dow and x[0] != d and abs((x[0] - d).days) <= 28]
        if band == "wet":
            ratios.append(sold / statistics.mean(others))
    assert (r.dry_days, r.lo, r.hi, r.rain_n) == (len(dry), 40, 69, len(ratios))
    assert r.bands["wet"].ratio == pytest.approx(statistics.mean(ratios))
    assert r.bands["wet"].se == pytest.approx(statistics.stdev(ratios) / math.sqrt(len(ratios)))
    assert r.typical == pytest.approx((len(dry) + sum(ratios)) / (len(dry) + len(ratios)))
    assert r.shares[1] == pytest.approx(0.2)
    day = DAY + dt.timedelta(140)
    f = spark.createDataFrame([(day, "wet", 50, None)], "d date, band string, temp_max int, rain_chance double")
    o = W.outlook(W.advised(f, W.effect(days)), days).first()
    baseline = statistics.mean([x[2] for x in rows if x[1] == 1][-8:])
    assert o.baseline_days == 8 and o.baseline == pytest.approx(baseline) and o.projected == math.floor(baseline * o.relative + 0.5) and o.relative < 1
    assert W.advised(f, W.effect(days.limit(0))).first().reason == "no-data"


@pytest.mark.parametrize(("share", "rain"), [(0.7, 0.3), (0.9, 0.6), (0.5, 1.0)])
def test_rain_among_thousands_of_units(spark, share, rain):
    """Where powers of the share are zero in floating point: against exact sums of logarithms, unit by unit."""
    n = 2500
    chances = [1 / (1 + math.exp((k - 1800) / 60)) for k in range(1, n + 1)]
    far = [*chances, *[chances[-1] * 0.5**i for i in range(1, 13)]]
    lg = math.lgamma

    def wet(k):
        return sum(math.exp(lg(d) - lg(k) - lg(d - k + 1) + k * math.log(share) + (d - k) * math.log(1 - share)) * far[d - 1] for d in range(k, n + 13))

    d = spark.createDataFrame([("a", 2000, 2000, 2400, 0.3, chances)], "item string, base long, quantity long, cap long, be double, chances array<double>")
    got = L.rained(d, F.lit(share), F.lit(rain)).first().rainy_base
    mixed = lambda k: rain * wet(k) + (1 - rain) * chances[k - 1]
    assert 0 < got <= 2000 and mixed(got) >= 0.3 and (got == 2000 or mixed(got + 1) < 0.3)
