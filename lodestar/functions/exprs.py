"""Column expressions over vectors (arrays of double) and bit descriptors (64-bit words)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def sq_euclidean(a: Column, b: Column, weights: Column | None = None) -> Column:
    """Squared distance, each term times its weight if there are weights."""
    terms = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return total(terms if weights is None else F.zip_with(terms, weights, lambda x, w: x * w))


def manhattan(a: Column, b: Column, weights: Column | None = None) -> Column:
    terms = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return total(terms if weights is None else F.zip_with(terms, weights, lambda x, w: x * w))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def l2_normalize(a: Column) -> Column:
    """The vector over its norm; a zero vector stays zero."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


def scale(a: Column, by: float) -> Column:
    return F.transform(a, lambda x: x * by)


def square_entries(a: Column) -> Column:
    return F.transform(a, lambda x: x * x)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit words."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming_words(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of 64-bit words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def merge_and(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def merge_or(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def set_bit(word: Column, n: int) -> Column:
    return word.bitwiseOR(F.shiftleft(F.lit(1).cast("long"), n))


def reset_bit(word: Column, n: int) -> Column:
    return word.bitwiseAND(F.bitwise_not(F.shiftleft(F.lit(1).cast("long"), n)))


def bit_string(word: Column) -> Column:
    """64 digits, the highest bit first."""
    return F.lpad(F.bin(word), 64, "0")


def sign_bits(vector: Column) -> Column:
    """Bit i is set where component i is positive; at most 64 components."""
    bits = F.transform(vector, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def sign_words(vector: Column) -> Column:
    """The signs of a long vector as an array of 64-bit words; the last one is padded with zeros."""
    starts = F.sequence(F.lit(1), F.size(vector), F.lit(64))
    return F.transform(starts, lambda at: sign_bits(F.slice(vector, at, F.lit(64))))


def in_box(x: Column, low: Column, high: Column) -> Column:
    """low[j] <= x[j] < high[j] in every dimension."""
    return F.forall(F.arrays_zip(x.alias("x"), low.alias("l"), high.alias("h")), lambda t: (t["l"] <= t["x"]) & (t["x"] < t["h"]))


def slerp(a: list[Column], b: list[Column], r: Column) -> list[Column]:
    """Spherical interpolation of unit quaternions, by the shorter way; near-equal ones are interpolated linearly."""
    d = sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])
    sign = F.when(d < 0, -1.0).otherwise(1.0)
    angle = F.acos(F.least(F.abs(d), F.lit(1.0)))
    near = angle < 1e-6
    s = F.when(near, F.lit(1.0)).otherwise(F.sin(angle))
    wa = F.when(near, 1 - r).otherwise(F.sin((1 - r) * angle) / s)
    wb = F.when(near, r).otherwise(F.sin(r * angle) / s) * sign
    return [wa * x + wb * y for x, y in zip(a, b, strict=True)]


def yaw_quaternion(dx: Column, dy: Column) -> tuple[Column, Column]:
    """(z, w) of the turn about the vertical that points along (dx, dy); x and y are zero."""
    yaw = F.atan2(dy, dx)
    return F.sin(yaw / 2), F.cos(yaw / 2)


def euler_quaternion(roll: Column, pitch: Column, yaw: Column) -> list[Column]:
    """(x, y, z, w) of static-axes roll, pitch, yaw."""
    cr, sr, cp, sp, cy, sy = (f(x / 2) for x in (roll, pitch, yaw) for f in (F.cos, F.sin))
    return [sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy, cr * cp * cy + sr * sp * sy]


def utm(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """(zone, easting, northing) on WGS 84, by Snyder's series; southern northings get 10,000 km."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    zone = (F.floor((lon + 180) / 6) + 1).cast("int")
    phi, lam = F.radians(lat), F.radians(lon - ((zone - 1) * 6 - 177))
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(phi), F.lit(2)))
    t, c, aa = F.pow(F.tan(phi), F.lit(2)), ep2 * F.pow(F.cos(phi), F.lit(2)), lam * F.cos(phi)
    m = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi) - 35 * e2**3 / 3072 * F.sin(6 * phi))
    easting = 500000 + k0 * n * (aa + (1 - t + c) * F.pow(aa, F.lit(3)) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(aa, F.lit(5)) / 120)
    northing = k0 * (m + n * F.tan(phi) * (aa * aa / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(aa, F.lit(4)) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(aa, F.lit(6)) / 720))
    return zone, easting, northing + F.when(lat < 0, 1e7).otherwise(0.0)
