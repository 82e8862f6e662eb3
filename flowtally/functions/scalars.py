"""Column functions: readings, calendars, places, names."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def reading(text: Column, sentinels=(2046, 2047)) -> Column:
    """A channel's text as a count: NA and sentinels are null, 0 stays 0."""
    v = text.try_cast("int")
    return F.when(~v.isin(*sentinels), v)


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def shift_month(ym: Column, by: int) -> Column:
    return F.date_format(F.add_months(F.to_date(ym, "yyyy-MM"), by), "yyyy-MM")


def expected_intervals(day: Column, per_day: int = 96) -> Column:
    """Intervals of the day's whole month."""
    return F.dayofmonth(F.last_day(day)) * per_day


def ratio(later: Column, earlier: Column) -> Column:
    """later / earlier - 1; null without a positive base."""
    return F.when(earlier > 0, later / earlier - 1)


def flag(cond: Column) -> Column:
    """1 or 0; an unknown condition is 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def title(text: Column) -> Column:
    """Words of a snake_case name with capitals, also after digits."""
    return F.array_join(F.transform(F.split(F.initcap(F.regexp_replace(text, "_", " ")), r"(?<=[0-9])(?=[A-Za-z])"), F.initcap), "")


def jalali(day: Column) -> Column:
    """Struct (year, month, day) of the Solar Hijri calendar, by its 33-year leap cycle; 1376-01-01 is 1997-03-21."""
    n = F.datediff(day, F.lit("1997-03-21").cast("date"))
    cycle, r = F.floor(n / 12053), F.pmod(n, F.lit(12053))
    four = F.least(F.floor(r / 1461), F.lit(7))  # leap years end spans of four, and the last span has five
    rest = r - four * 1461
    k = F.least(F.floor(rest / 365), F.when(four == 7, 4).otherwise(3))
    of = rest - k * 365
    m = F.when(of < 186, F.floor(of / 31)).otherwise(6 + F.floor((of - 186) / 30))
    d = F.when(of < 186, F.pmod(of, F.lit(31))).otherwise(F.pmod(of - 186, F.lit(30)))
    return F.struct((1376 + cycle * 33 + four * 4 + k).cast("int").alias("year"), (m + 1).cast("int").alias("month"), (d + 1).cast("int").alias("day"))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6_371_000.0) -> Column:
    """Great-circle metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(a))


def _columns(row: Column, limit: float) -> tuple[float, Column]:
    """Degrees of a row of cells, and into how many columns row `row` is cut: each at least `limit` metres wide in it and in its
    neighbours."""
    step = limit / (6371000 * math.pi / 180) * 1.000001
    far = F.least(F.greatest(F.abs((row - 1) * step), F.abs((row + 2) * step)), F.lit(90.0))
    return step, F.greatest(F.floor(360 * F.cos(F.radians(far)) / step), F.lit(1))


def _cell(row: Column, lon: Column, by: int, limit: float) -> Column:
    n = _columns(row, limit)[1]
    return F.struct(row.cast("long").alias("row"), F.pmod(F.floor((lon + 180) * n / 360) + by, n).cast("long").alias("column"))


def cell(lat: Column, lon: Column, limit: float) -> Column:
    """The cell of a grid whose cells are at least `limit` metres high and wide that holds a place; the columns meet at 180 degrees."""
    return _cell(F.floor(lat / _columns(lat, limit)[0]), lon, 0, limit)


def cells_around(lat: Column, lon: Column, limit: float) -> Column:
    """The cells that hold whatever is up to `limit` metres from a place: its own and its neighbours, each once."""
    row = F.floor(lat / _columns(lat, limit)[0])
    return F.array_distinct(F.array(*[_cell(row + r, lon, c, limit) for r in (-1, 0, 1) for c in (-1, 0, 1)]))


def confidence(metres: Column) -> Column:
    """Tier of a street-pair match; null beyond 1,500 m."""
    return F.when(metres <= 150, "high").when(metres <= 500, "medium").when(metres <= 1500, "low")


def persian(text: Column) -> Column:
    """Arabic letter forms as Persian ones, trimmed."""
    return F.trim(F.translate(text, "يكۀة", "یکهه"))


def street_tokens(name: Column, prefixes: list[str]) -> Column:
    """Street names in a junction's name: parts between dashes, slashes or brackets, without the first prefix that fits."""
    strip = "^(?:" + "|".join(prefixes) + ")" if prefixes else "^$"
    parts = F.transform(F.split(persian(name), r"[-–—/()]"), lambda p: F.trim(F.regexp_replace(F.trim(p), strip, "")))
    return F.filter(parts, lambda p: F.length(p) >= 3)


def approach(x: Column, y: Column, cx: float = 690, cy: float = 347) -> Column:
    """Side of a detector box by the dominant axis from the diagram's centre; ties go to north or south."""
    dx, dy = x - cx, y - cy
    return F.when(F.abs(dx) > F.abs(dy), F.when(dx < 0, "west").otherwise("east")).otherwise(F.when(dy < 0, "north").otherwise("south"))


def inside(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """(south, west, north, east), borders included."""
    return lat.between(box[0], box[2]) & lon.between(box[1], box[3])


def mean_in_order(value: Column, order: Column) -> Column:
    """The mean of a group's known values, added up in this order: groups with the same values have the same mean to the last bit,
    however their rows were dealt out. For groups of a bounded size."""
    rows = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.cast("double").alias("v")))))
    return F.aggregate(rows, F.lit(0.0), lambda s, x: s + x["v"]) / F.nullif(F.count(value), F.lit(0))


def steady_mean(c: Column) -> Column:
    """The mean of numbers, the same in whatever order rows come: of each its whole 2^-20ths, and what is left in 2^-72nds, are
    added up without rounding. From 2^42 on, and where not finite, numbers are added up as they are."""
    v = c.cast("double")
    fine = F.when(F.abs(v) < 2.0**42, v * 2.0**20)
    whole = F.floor(fine)
    total = lambda x: F.coalesce(F.sum(x.cast("decimal(20,0)")).cast("double"), F.lit(0.0))
    rest = total(F.floor((fine - whole) * 2.0**52)) * 2.0**-52
    large = F.coalesce(F.sum(F.when(fine.isNull(), v)), F.lit(0.0))
    return ((total(whole) + rest) * 2.0**-20 + large) / F.count(v)
