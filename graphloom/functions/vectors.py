"""Vector algebra on lists of columns, and small scalar and text functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.spaces import Point, distance, sq_norm


def plus(a: Point, b: Point) -> Point:
    return [x + y for x, y in zip(a, b, strict=True)]


def minus(a: Point, b: Point) -> Point:
    return [x - y for x, y in zip(a, b, strict=True)]


def scaled(a: Point, k: Column | float) -> Point:
    return [x * k for x in a]


def norm(a: Point) -> Column:
    return F.sqrt(sq_norm(a))


def inf_norm(a: Point) -> Column:
    return F.greatest(*[F.abs(x) for x in a]) if len(a) > 1 else F.abs(a[0])


def clamp(a: Point, low: float, high: float) -> Point:
    return [F.greatest(F.lit(low), F.least(F.lit(high), x)) for x in a]


def normed(a: Point) -> Point:
    n = norm(a)
    return [F.when(n > 0, x / n).otherwise(0.0) for x in a]


def max_index(a: Point) -> Column:
    """Position of the first component of largest size."""
    top = inf_norm(a)
    return F.coalesce(*[F.when(F.abs(x) == top, F.lit(k)) for k, x in enumerate(a)])


def inf_normed(a: Point) -> Point:
    """Signed unit vector along the largest component."""
    at = max_index(a)
    return [F.when(at == k, F.signum(x)).otherwise(0.0) for k, x in enumerate(a)]


def norm_gradient(a: Point, b: Point) -> Point:
    """Gradient of the distance by a; zero where both meet."""
    d = distance(a, b)
    return [F.when(d > 0, (x - y) / d).otherwise(0.0) for x, y in zip(a, b, strict=True)]


def average(x: Column) -> Column:
    """Mean, -1 of nothing."""
    return F.coalesce(F.avg(x), F.lit(-1.0))


#: Characters that trimming takes off.
BLANKS = " \t\n\v\f\r"


def trim(s: Column) -> Column:
    return F.regexp_replace(s, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")


def ltrim(s: Column) -> Column:
    return F.regexp_replace(s, r"^[ \t\n\x0B\f\r]+", "")


def rtrim(s: Column) -> Column:
    return F.regexp_replace(s, r"[ \t\n\x0B\f\r]+$", "")


def tokens(line: Column, delimiter: str = ",") -> Column:
    """Split on a literal delimiter; empty tokens stay, an empty line has none."""
    escaped = "".join(c if c.isalnum() else f"\\{c}" for c in delimiter)
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, escaped, -1))


def starts_with(s: Column, prefix: str = "%") -> Column:
    return F.startswith(s, F.lit(prefix))


def map_text(m: Column) -> Column:
    """``key: value`` joined by commas, in key order."""
    entries = F.array_sort(F.map_entries(m))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws(": ", e["key"].cast("string"), e["value"].cast("string"))), ", ")


def hsv_to_rgb(h: Column, s: Column, v: Column) -> list[Column]:
    """Hue in degrees, saturation and value in 0..1; components in 0..255, but the bare value where s is 0."""
    sector = F.floor(h / 60)
    f = h / 60 - sector
    p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))
    wheel = [(v, t, p), (q, v, p), (p, v, t), (p, q, v), (t, p, v), (v, p, q)]
    out = []
    for k in range(3):
        value = reduce(lambda acc, x: acc.when(F.pmod(sector, F.lit(6)) == x[0], x[1][k]), enumerate(wheel), F.when(F.lit(False), v))
        out.append(F.when(s == 0, v).otherwise(255 * value))
    return out


def scaled_to_max(x: Column, top: float) -> Column:
    return x / top if top else F.lit(0.0)
