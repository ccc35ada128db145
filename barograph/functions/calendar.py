"""Calendar, astronomy and order arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days since these dates drive the cycles of fixed periods and the phases.
ANCHOR, EPOCH = "2014-01-02", "2000-01-01"
#: Periods in days of the cycles k01, k02, ...
PERIODS = (5, 10, 20, 30, 45, 60, 90, 120, 180, 252, 360, 504, 720, 1008, 1260, 1512, 1764, 2016, 2268, 2520, 2772, 3024)
#: Periods in days of the phases.
PHASES = {"cal_month30": 30.0, "cal_quarter90": 90.0, "cal_year365": 365.0, "cal_halfyear182": 182.0, "astro_moon29_53": 29.53, "astro_solstice91_25": 91.25}
#: Public low-precision orbital elements. Node, inclination, argument of perihelion (degrees), semi-major axis
#: (au), eccentricity, mean anomaly (degrees), each at J2000 and its change a day; then the period in days. The Earth's are
#: those of the Sun's apparent orbit, as in the results to match.
ELEMENTS = {
    "mercury": ((48.3313, 3.24587e-5), (7.0047, 5.00e-8), (29.1241, 1.01444e-5), (0.387098, 0.0), (0.205635, 5.59e-10), (168.6562, 4.0923344368), 87.969),
    "venus": ((76.6799, 2.46590e-5), (3.3946, 2.75e-8), (54.8910, 1.38374e-5), (0.723330, 0.0), (0.006773, -1.302e-9), (48.0052, 1.6021302244), 224.701),
    "earth": ((0.0, 0.0), (0.0, 0.0), (282.9404, 4.70935e-5), (1.0, 0.0), (0.016709, -1.151e-9), (356.0470, 0.9856002585), 365.256),
    "mars": ((49.5574, 2.11081e-5), (1.8497, -1.78e-8), (286.5016, 2.92961e-5), (1.523688, 0.0), (0.093405, 2.516e-9), (18.6021, 0.5240207766), 686.980),
    "jupiter": ((100.4542, 2.76854e-5), (1.3030, -1.557e-7), (273.8777, 1.64505e-5), (5.20256, 0.0), (0.048498, 4.469e-9), (19.8950, 0.0830853001), 4332.589),
    "saturn": ((113.6634, 2.38980e-5), (2.4886, -1.081e-7), (339.3939, 2.97661e-5), (9.55475, 0.0), (0.055546, -9.499e-9), (316.9670, 0.0334442282), 10759.22),
    "uranus": ((74.0005, 1.3978e-5), (0.7733, 1.9e-8), (96.6612, 3.0565e-5), (19.18171, -1.55e-8), (0.047318, 7.45e-9), (142.5905, 0.011725806), 30688.5),
    "neptune": ((131.7806, 3.0173e-5), (1.7700, -2.55e-7), (272.8461, -6.027e-6), (30.05826, 3.313e-8), (0.008606, 2.15e-9), (260.2471, 0.005995147), 60182.0),
    "pluto": ((110.30347, 0.0), (17.14175, 0.0), (113.76329, 0.0), (39.48168677, 0.0), (0.24880766, 0.0), (14.53, 0.0039757), 90560.0),
}
PLANETS = tuple(b for b in ELEMENTS if b != "earth")


def phase(date: Column, period: float, anchor: str = ANCHOR) -> Column:
    """The date's place in a cycle of so many days, in radians."""
    return F.lit(2 * math.pi) * F.datediff(date, F.lit(anchor).cast("date")) / period


def cycles(date: Column, periods: tuple[int, ...] = PERIODS) -> dict[str, Column]:
    """sin_k01, cos_k01, ... of the periods in their order."""
    return {f"{fn.__name__}_k{i:02d}": fn(phase(date, p)) for i, p in enumerate(periods, 1) for fn in (F.sin, F.cos)}


def phases(df: DataFrame) -> DataFrame:
    """(date, ...) with sine and cosine of each phase, and the sines of twice and three times it.

    The week's phase counts the rows of ``df`` (sessions) since Monday, so holidays do not count.
    """
    monday = F.date_sub("date", F.weekday("date"))
    place = F.row_number().over(Window.partitionBy(monday).orderBy("date")) - 1
    angles = {"cal_wk_bday": F.lit(2 * math.pi) * place / 5} | {n: phase(F.col("date"), p, EPOCH) for n, p in PHASES.items()}
    df = df.withColumns({f"_{n}": x for n, x in angles.items()})
    out = {f"per_{n}_{fn.__name__}": fn(F.col(f"_{n}")) for n in angles for fn in (F.sin, F.cos)}
    out |= {f"per_h{k}_{n}": F.sin(k * F.col(f"_{n}")) for n in angles for k in (2, 3)}
    return df.withColumns(out).drop(*[f"_{n}" for n in angles])


def julian_day(date: Column) -> Column:
    """At midnight."""
    return F.unix_date(date) + F.lit(2440587.5)


def heliocentric(bodies: tuple[str, ...], date: Column, steps: int = 7) -> Column:
    """An array of struct(x, y), in au in the plane of the ecliptic, one for each body; Kepler's equation by Newton's steps.

    Each stage is a transform of the stage before, so no expression is worked out twice.
    """
    d = julian_day(date) - 2451545.0
    names = ("n", "i", "w", "a", "e", "m")
    degrees = {"n", "i", "w", "m"}
    of = lambda body: F.struct(*[(F.radians(F.lit(v) + F.lit(rate) * d) if k in degrees else F.lit(v) + F.lit(rate) * d).alias(k) for k, (v, rate) in zip(names, ELEMENTS[body], strict=False)])
    x = F.array(*[of(b) for b in bodies])
    keep = lambda b, *cs: [b[c].alias(c) for c in cs]
    x = F.transform(x, lambda b: F.struct(*keep(b, "n", "i", "w", "a", "e"), (F.pmod(b["m"] + math.pi, F.lit(2 * math.pi)) - math.pi).alias("m")))
    newton = lambda b: F.aggregate(F.sequence(F.lit(1), F.lit(steps)), b["m"], lambda y, _: y - (y - b["e"] * F.sin(y) - b["m"]) / (1 - b["e"] * F.cos(y)))
    x = F.transform(x, lambda b: F.struct(*keep(b, "n", "i", "w", "a", "e"), newton(b).alias("m")))
    x = F.transform(x, lambda b: F.struct(*keep(b, "n", "i", "w"), (b["a"] * (F.cos(b["m"]) - b["e"])).alias("p"), (b["a"] * F.sqrt(1 - b["e"] * b["e"]) * F.sin(b["m"])).alias("q")))
    x = F.transform(x, lambda b: F.struct(*keep(b, "n", "i"), (F.atan2(b["q"], b["p"]) + b["w"]).alias("u"), F.sqrt(b["p"] * b["p"] + b["q"] * b["q"]).alias("r")))
    along = lambda b: b["r"] * (F.cos(b["n"]) * F.cos(b["u"]) - F.sin(b["n"]) * F.sin(b["u"]) * F.cos(b["i"]))
    across = lambda b: b["r"] * (F.sin(b["n"]) * F.cos(b["u"]) + F.cos(b["n"]) * F.sin(b["u"]) * F.cos(b["i"]))
    return F.transform(x, lambda b: F.struct(along(b).alias("x"), across(b).alias("y")))


def geocentric(df: DataFrame, *planets: str) -> DataFrame:
    """(date, planet, longitude in degrees, speed in radians a day, speed_norm, retrograde), a row a date and planet.

    The speed is the gradient over the actual days between the rows: of second order inside, one-sided at the ends.
    ``speed_norm``: by the planet's mean motion, within -2 and 2.
    """
    bodies = ("earth", *planets)
    at = df.select("date").distinct().withColumn("_b", heliocentric(bodies, F.col("date")))
    e = F.col("_b")[0]
    each = F.array(*[F.struct(F.lit(p).alias("planet"), F.atan2(F.col("_b")[i]["y"] - e["y"], F.col("_b")[i]["x"] - e["x"]).alias("lon"), F.lit(2 * math.pi / ELEMENTS[p][6]).alias("mean")) for i, p in enumerate(planets, 1)])
    rows = at.select("date", F.explode(each).alias("p")).select("date", "p.*")
    w = Window.partitionBy("planet").orderBy("date")  # a row a day
    turn = lambda x: F.pmod(x + math.pi, F.lit(2 * math.pi)) - math.pi  # noqa: E731  along the shorter way
    rows = rows.withColumns({"_on": turn(F.lead("lon").over(w) - F.col("lon")), "_back": turn(F.col("lon") - F.lag("lon").over(w)), "_h": F.datediff(F.lead("date").over(w), "date").cast("double"), "_g": F.datediff("date", F.lag("date").over(w)).cast("double")})
    h, g, on, back = F.col("_h"), F.col("_g"), F.col("_on"), F.col("_back")
    inner = (g * g * on + h * h * back) / (g * h * (g + h))
    rows = rows.withColumn("speed", F.when(g.isNull(), on / h).when(h.isNull(), back / g).otherwise(inner))
    norm = F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.col("speed") / (F.col("mean") + 1e-12)))
    return rows.select("date", "planet", F.pmod(F.degrees("lon"), F.lit(360.0)).alias("longitude"), "speed", norm.alias("speed_norm"), (F.col("speed") < 0).alias("retrograde"))


def planets_wide(df: DataFrame) -> DataFrame:
    """date and per_planet_<name>_retro_flag, per_planet_<name>_speed of all planets."""
    rows = geocentric(df, *PLANETS)
    return rows.groupBy("date").agg(*[F.max(F.when(F.col("planet") == p, x)).alias(f"per_planet_{p}_{n}") for p in PLANETS for n, x in (("retro_flag", F.col("retrograde").cast("double")), ("speed", F.col("speed_norm")))])


def _observed(date: Column, month: int, day: int) -> Column:
    """Whether the date is the weekday next to a fixed holiday: the Friday before a Saturday, the Monday after a Sunday."""
    own = F.make_date(F.year(date), F.lit(month), F.lit(day))
    on = F.weekday(own)
    moved = F.when(on == 5, F.date_sub(own, 1)).when(on == 6, F.date_add(own, 1)).otherwise(own)
    if (month, day) == (1, 1):  # may be observed in the year before
        ahead = F.make_date(F.year(date) + 1, F.lit(1), F.lit(1))
        return (date == moved) | ((F.weekday(ahead) == 5) & (date == F.date_sub(ahead, 1)))
    return date == moved


def _nth(date: Column, month: int, weekday: int, n: int) -> Column:
    """Whether the date is the month's n-th such weekday, from the end if n is below 0."""
    place = F.floor((F.dayofmonth(date) - 1) / 7) + 1 if n > 0 else -(F.floor((F.dayofmonth(F.last_day(date)) - F.dayofmonth(date)) / 7) + 1)
    return (F.month(date) == month) & (F.weekday(date) == weekday) & (place == n)


def federal_holiday(date: Column) -> Column:
    """Whether the date is a holiday of the United States' federal calendar, as observed."""
    since = lambda year: F.year(date) >= year
    rules = [
        _observed(date, 1, 1), _nth(date, 1, 0, 3) & since(1986), _nth(date, 2, 0, 3) & since(1971), _nth(date, 5, 0, -1) & since(1971), _observed(date, 6, 19) & since(2021), _observed(date, 7, 4),
        _nth(date, 9, 0, 1), _nth(date, 10, 0, 2) & since(1971), _observed(date, 11, 11), _nth(date, 11, 3, 4) & since(1942), _observed(date, 12, 25),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out | r
    return out


def sessions(df: DataFrame, start: str, end: str, holidays: bool = True) -> DataFrame:
    """The rows of ``df`` for each weekday from ``start`` to ``end`` (columns), in ``date``; without holidays if asked."""
    days = df.withColumn("date", F.explode(F.sequence(start, end))).where(F.weekday("date") < 5)
    return days.where(~federal_holiday(F.col("date"))) if holidays else days


def next_weekday(date: Column, n: int) -> Column:
    """n weekdays later (n >= 0); a weekend counts as the Friday before."""
    day = F.weekday(date)  # Monday is 0
    base = F.date_sub(date, F.greatest(day - 4, F.lit(0)))
    total = F.least(day, F.lit(4)) + n
    return F.date_add(base, (F.floor(total / 5) * 7 + total % 5 - F.least(day, F.lit(4))).cast("int"))


def limit_price(price: Column, side: Column, slip: float = 0.002, tick: float = 0.01) -> Column:
    """Rounded to the tick away from the market: up for a buy, down for a sale."""
    up, down = F.ceil(F.round(price * (1 + slip) / tick, 6)), F.floor(F.round(price * (1 - slip) / tick, 6))
    return F.when(side == "BUY", up * tick).otherwise(down * tick)


def profit_share(before: Column, after: Column, least: float = 1e-6) -> Column:
    """The profit by the equity before, 0 where that is smaller than ``least``."""
    return F.when(F.abs(before) < least, 0.0).otherwise((after - before) / before)


def order_plan(target_long: Column, target_short: Column, held_long: Column, held_short: Column) -> Column:
    """Orders as an array of struct(place, side, action, quantity): sales before purchases, the long side first."""
    legs = [("LONG", target_long - held_long), ("SHORT", target_short - held_short)]
    order = lambda side, action, x, place: F.when(x > 0, F.struct(F.lit(place).alias("place"), F.lit(side).alias("side"), F.lit(action).alias("action"), x.cast("long").alias("quantity")))
    return F.array_compact(F.array(*[order(s, "SELL", -x, i) for i, (s, x) in enumerate(legs, 1)], *[order(s, "BUY", x, i + 2) for i, (s, x) in enumerate(legs, 1)]))


#: What counts as up and as down.
UP, DOWN = ("up", "u", "long", "buy", "1", "+1", "true"), ("down", "d", "short", "sell", "-1", "minus1", "false")


def direction(text: Column) -> Column:
    """UP, DOWN or null, of words and signs in any case, and of texts with the characters for above and below."""
    t = F.lower(F.trim(text))
    return F.when(t.isin(*UP), "UP").when(t.isin(*DOWN), "DOWN").when(t.contains("上"), "UP").when(t.contains("下"), "DOWN")


def shares(equity: Column, ratio: Column, price: Column) -> Column:
    """Whole shares that the ratio of equity buys."""
    return F.floor(F.try_divide(equity * F.abs(ratio), F.nullif(price, F.lit(0.0)))).cast("long")


def number(text: Column) -> Column:
    """A number that may have thousands commas, or null."""
    return F.regexp_replace(text, ",", "").try_cast("double")
