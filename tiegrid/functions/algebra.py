"""Column builders for small matrices, grids and deterministic draws."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit(x: float) -> Column:
    return F.lit(float(x))


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Column, low: float, high: float) -> Column:
    """NULL stays NULL, which least and greatest alone would not do."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, lit(low)), lit(high)))


def finite(c: Column) -> Column:
    """The value, or NULL where it is infinite or not a number."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def eigen2(xx: Column, xy: Column, yy: Column) -> tuple[Column, Column, Column]:
    """(larger, smaller eigenvalue, angle of the larger one's axis in degrees modulo 180) of a symmetric 2 x 2 matrix."""
    mean, half = (xx + yy) / 2, (xx - yy) / 2
    spread = F.sqrt(half * half + xy * xy)
    angle = F.degrees(F.atan2(2 * xy, xx - yy)) / 2
    return mean + spread, mean - spread, F.pmod(angle, lit(180))


def singular2(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """Singular values of [[a, b], [c, d]], the larger one first."""
    s, t = a * a + b * b + c * c + d * d, F.abs(a * d - b * c)
    root = F.sqrt(F.greatest(s * s - 4 * t * t, lit(0)))
    return F.sqrt((s + root) / 2), F.sqrt(F.greatest((s - root) / 2, lit(0)))


def affine(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> Column:
    """A 3 x 3 matrix, row by row, from the six numbers of an affine map."""
    return F.array(a, b, c, d, e, f, lit(0), lit(0), lit(1))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def matmul3(p: Column, q: Column) -> Column:
    def product(p: Column, q: Column) -> Column:
        return F.array(*(p[3 * i] * q[j] + p[3 * i + 1] * q[3 + j] + p[3 * i + 2] * q[6 + j] for i in range(3) for j in range(3)))

    return let(F.struct(p.alias("p"), q.alias("q")), lambda s: product(s["p"], s["q"]))


def det3(m: Column) -> Column:
    return let(m, lambda m: m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6]))


def inverse3(m: Column) -> Column:
    """The inverse, scaled so that its last element is 1; NULL if that can't be."""

    def adjugate(m: Column) -> Column:
        return F.array(
            m[4] * m[8] - m[5] * m[7], m[2] * m[7] - m[1] * m[8], m[1] * m[5] - m[2] * m[4],
            m[5] * m[6] - m[3] * m[8], m[0] * m[8] - m[2] * m[6], m[2] * m[3] - m[0] * m[5],
            m[3] * m[7] - m[4] * m[6], m[1] * m[6] - m[0] * m[7], m[0] * m[4] - m[1] * m[3],
        )

    return let(m, lambda m: F.when(F.abs(det3(m)) > 1e-12, normal3(adjugate(m))))


def normal3(m: Column) -> Column:
    """The matrix scaled so that its last element is 1."""
    return let(m, lambda m: F.when(F.abs(m[8]) > 1e-12, F.transform(m, lambda x: x / m[8])))


def cell(x: Column, size: float | Column, cells: int | Column) -> Column:
    """The grid cell of a coordinate; what lies outside goes to the first or last cell."""
    last = (F.lit(cells) if isinstance(cells, int) else cells) - 1
    return F.least(last, F.greatest(F.lit(0), F.floor(x / size).cast("int")))


def pick(n: Column, *parts: tuple[int, Column]) -> Column:
    """A place from 0 to n - 1 that depends on nothing but the parts (odd multiplier, integer)."""
    total = F.lit(0).cast("bigint")
    for factor, value in parts:
        total = total + F.lit(factor) * value
    return F.pmod(total, n)
