"""Column expressions: map projections, distance kernels, time features and small numeric helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Colour codes of a traffic map and their RGB, in the order in which later ones win.
COLOURS = {"green": (1, (99, 214, 104)), "yellow": (2, (255, 151, 77)), "red": (3, (242, 60, 50)), "dark_red": (4, (129, 31, 31))}
WATER, GREEN_AREA, ROAD = (156, 192, 249), (168, 218, 181), (255, 255, 255)

SIN_LIMIT = 0.9999

#: 9840 metres between two points (latitude, longitude); metres per degree of plain distance there.
METRES_PER_DEGREE = 9840 / math.dist((48.87551413370949, 2.2944611276838867), (48.835641353886075, 2.414628350744604))


def mercator(lat: Column, lon: Column, tile: int = 256) -> tuple[Column, Column]:
    """World coordinates (x, y) of a point on a Web-Mercator square of tile units."""
    s = F.greatest(F.least(F.sin(F.radians(lat)), F.lit(SIN_LIMIT)), F.lit(-SIN_LIMIT))
    return (lon / 360 + 0.5) * tile, (0.5 - F.log((1 + s) / (1 - s)) / (4 * math.pi)) * tile


def inverse_mercator(x: Column, y: Column, tile: int = 256) -> tuple[Column, Column]:
    """(lat, lon) of world coordinates."""
    e = F.exp((0.5 - y / tile) * (4 * math.pi))
    return F.degrees(F.asin((e - 1) / (e + 1))), (x / tile - 0.5) * 360


def pixel_position(px: Column, py: Column, lat: float, lon: float, zoom: int, shape: tuple[int, int], tile: int = 256) -> tuple[Column, Column]:
    """(lat, lon) of a pixel of an image of shape (rows, columns) centred at lat, lon."""
    scale = float(2**zoom)
    s = min(max(math.sin(math.radians(lat)), -SIN_LIMIT), SIN_LIMIT)
    cx, cy = (lon / 360 + 0.5) * tile, (0.5 - math.log((1 + s) / (1 - s)) / (4 * math.pi)) * tile
    left, top = math.floor(cx * scale) - shape[1] // 2, math.floor(cy * scale) - shape[0] // 2
    return inverse_mercator((px + left) / scale, (py + top) / scale, tile)


#: Fixed values of Lambert-93: cone constant, scale, false origin (x, y), eccentricity of GRS80; the central meridian is 3 degrees.
LAMBERT = (0.7256077650, 11754255.426, 700000.0, 12655612.050, 0.08181919112)


def to_lambert93(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Lambert-93 coordinates (x, y) in metres of a point in degrees."""
    n, c, xs, ys, e = LAMBERT
    phi = F.radians(lat)
    es = F.sin(phi) * e
    iso = F.log(F.tan(phi / 2 + math.pi / 4)) + F.log((1 - es) / (1 + es)) * (e / 2)
    r, turn = F.exp(-n * iso) * c, F.radians(lon - 3) * n
    return xs + r * F.sin(turn), ys - r * F.cos(turn)


def lambert93(x: Column, y: Column) -> tuple[Column, Column]:
    """(lat, lon) of Lambert-93 coordinates in metres: the inverse conformal conic on GRS80, five steps of the latitude."""
    n, c, xs, ys, e = LAMBERT
    dx, dy = x - xs, ys - y
    iso = -F.log(F.sqrt(dx * dx + dy * dy) / c) / n
    phi = 2 * F.atan(F.exp(iso)) - math.pi / 2
    for _ in range(5):
        es = F.sin(phi) * e
        phi = 2 * F.atan(F.pow((1 + es) / (1 - es), F.lit(e / 2)) * F.exp(iso)) - math.pi / 2
    return F.degrees(phi), F.degrees(F.atan(dx / dy) / n) + 3


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(F.pow(x1 - x2, 2) + F.pow(y1 - y2, 2))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment; a segment without length is a point."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    along = F.when(length > 0, ((px - ax) * dx + (py - ay) * dy) / length).otherwise(0.0)
    along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return distance(px, py, ax + along * dx, ay + along * dy)


#: Kernels by name: Column and parameters to Column. "exp_by_square" is exp(-d / s ** 2), not a Gaussian.
KERNELS = {
    "gaussian": lambda d, s: F.exp(-d * d / (2 * s * s)),
    "exponential": lambda d, a: F.exp(-d * a),
    "rational": lambda d, a, b: F.lit(a) / (d + b),
    "exp_by_square": lambda d, s: F.exp(-d / (s * s)),
    "exp_by_scale": lambda d, s: F.exp(-d / s),
    "inverse": lambda d, s: 1 / (d + s),
    "threshold": lambda d, s: F.when(d <= s, 1.0).otherwise(0.0),
}


def colour_class(r: Column, g: Column, b: Column, width: int = 1) -> Column:
    """Code of the colour within width of r, g, b; where several fit, the last of COLOURS; 0 for none."""
    out = F.lit(0)
    for code, rgb in COLOURS.values():
        near = F.lit(True)
        for own, c in zip((r, g, b), rgb, strict=True):
            near = near & own.between(c - width, c + width)
        out = F.when(near, code).otherwise(out)
    return out


def is_colour(r: Column, g: Column, b: Column, rgb: tuple[int, int, int]) -> Column:
    return (r == rgb[0]) & (g == rgb[1]) & (b == rgb[2])


def null_if_nan(x: Column) -> Column:
    return F.nanvl(x, F.lit(None).cast("double"))


def zero_if_missing(x: Column) -> Column:
    return F.coalesce(null_if_nan(x), F.lit(0.0))


def safe_double(x: Column) -> Column:
    """A string as a double, null if it is none."""
    return x.try_cast("double")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def signed_log(x: Column) -> Column:
    """sign(x) * ln(abs(x)), 0 where x is 0 or missing."""
    return F.coalesce(F.signum(x) * F.log(F.abs(F.nullif(x, F.lit(0.0)))), F.lit(0.0))


def round_half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def seconds_of(t: Column) -> Column:
    """Seconds of a zone-less timestamp since 1970."""
    return F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), t)


def hour_of(t) -> Column:
    """Whole hours since 1970."""
    return F.floor(seconds_of(t) / 3600)


def floor_minutes(t, minutes: int = 15, lag_seconds: int = 3600) -> Column:
    """Seconds since 1970 of the time less a lag, floored to so many minutes."""
    step = minutes * 60
    return F.floor((seconds_of(t) - lag_seconds) / step) * step


def hour_features(hour: Column) -> dict[str, Column]:
    """Cosine and sine of the hour of the day and their products of degree 2."""
    angle = 2 * math.pi / 24 * (hour % 24)
    c, s = F.cos(angle), F.sin(angle)
    return {"cos1": c, "sin1": s, "cos_cos": c * c, "cos_sin": c * s, "sin_sin": s * s}


def week_features(t: Column) -> dict[str, Column]:
    """Monday is 0; weekend is 1 from Saturday on."""
    day = F.weekday(t)
    return {"weekday": day.cast("long"), "weekend": (day > 4).cast("long")}


def cosine_wave(hours: Column, start: float, amplitude: float, period: float, phase: float) -> Column:
    return amplitude * F.cos((hours - start) * (2 * math.pi / period) + phase)


def acronym(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Z]", "")


def pair_of(text: Column) -> tuple[Column, Column]:
    """The two numbers of "(r, c)"."""
    rule = r"\((-?\d+),\s*(-?\d+)\)"
    return F.regexp_extract(text, rule, 1).cast("int"), F.regexp_extract(text, rule, 2).cast("int")


def linspace(low: Column | float, high: Column | float, n: int) -> Column:
    """n values from low to high; the ends may be columns, such as a table's bounds."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: low + k * ((high - low) / max(n - 1, 1)))


def logspace(low: Column | float, high: Column | float, n: int) -> Column:
    """n values from 10 ** low to 10 ** high."""
    return F.transform(linspace(low, high, n), lambda x: F.pow(F.lit(10.0), x))
