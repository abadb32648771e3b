"""Euler angles (degrees, about z, y', z'') and rotations as column expressions: a matrix is a list of nine columns, row by row."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = list[Column]
Angles = tuple[Column, Column, Column]


def matrix(e: Angles) -> Matrix:
    """The rotation of three Euler angles; its last row is the projection direction."""
    (sa, ca), (sb, cb), (sc, cc) = ((F.sin(F.radians(x)), F.cos(F.radians(x))) for x in e)
    return [cb * cc * ca - sc * sa, cb * cc * sa + sc * ca, -sb * cc, -cb * sc * ca - cc * sa, cc * ca - cb * sc * sa, sb * sc, sb * ca, sb * sa, cb]


def transposed(m: Matrix) -> Matrix:
    return [m[3 * j + i] for i in range(3) for j in range(3)]


def product(a: Matrix, b: Matrix) -> Matrix:
    return [reduce(add, (a[3 * i + k] * b[3 * k + j] for k in range(3))) for i in range(3) for j in range(3)]


def clamped_acos(c: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def angles(m: Matrix) -> list[Column]:
    """The Euler angles of a rotation, the first and third in [0, 360); at the poles all in-plane rotation is the first."""
    up, down = m[8] >= 0.9999999, m[8] <= -0.9999999
    turn = F.degrees(F.atan2(m[1], m[4]))
    first = F.when(up, turn).when(down, -turn).otherwise(F.degrees(F.atan2(m[7], m[6])))
    second = F.when(up, 0.0).when(down, 180.0).otherwise(F.degrees(clamped_acos(m[8])))
    third = F.when(up | down, 0.0).otherwise(F.degrees(F.atan2(m[5], -m[2])))
    return [wrapped(first), second, wrapped(third)]


def wrapped(a: Column) -> Column:
    """The angle in [0, 360)."""
    return F.pmod(a, F.lit(360.0))


def dot(a: list[Column], b: list[Column]) -> Column:
    return reduce(add, (x * y for x, y in zip(a, b, strict=True)))


def normal(e: Angles) -> list[Column]:
    return matrix(e)[6:]


def distance(a: Angles, b: Angles) -> Column:
    """The angle between the projection directions, in radians."""
    return clamped_acos(dot(normal(a), normal(b)))


def inplane_distance(a: Angles, b: Angles) -> Column:
    """The angle between the in-plane rotations, in radians."""
    return clamped_acos(F.cos(F.radians(a[2] - b[2])))


def composed(a: Angles, b: Angles) -> list[Column]:
    """The angles of a, then b."""
    return angles(product(matrix(b), matrix(a)))


def mirrored(e: Angles) -> list[Column]:
    return angles(matrix((e[0], 180 + e[1], 180 - e[2])))


def frobenius(a: Angles, b: Angles) -> Column:
    """The Frobenius norm of the identity less a times b's inverse; squares of 1e-6 or less count as 0."""
    m = product(matrix(a), transposed(matrix(b)))
    s = reduce(add, ((m[i] - (1.0 if i in (0, 4, 8) else 0.0)) ** 2 for i in range(9)))
    return F.when(s > 1e-6, F.sqrt(s)).otherwise(0.0)


def rotation_angle(a: Angles, b: Angles) -> Column:
    """The angle of the rotation between a and b, in radians, from the trace."""
    m = product(matrix(a), transposed(matrix(b)))
    return clamped_acos((m[0] + m[4] + m[8] - 1) / 2)


def symmetry_distance(a: Angles, b: Angles, n: int) -> Column:
    """The least angle between the directions of a and of b's n copies about the z axis, in radians."""
    return F.least(*(distance(a, (b[0] + 360.0 * k / n, b[1], b[2])) for k in range(n))) if n > 1 else distance(a, b)


def into_unit(e: Angles, n: int) -> Angles:
    """The copy about the n-fold z axis whose first angle lies in [0, 360 / n)."""
    return F.pmod(e[0], F.lit(360.0 / n)), e[1], e[2]


def shifted_by(x: Column, y: Column, e3: Column, dx: float, dy: float) -> list[Column]:
    """Shifts after moving a class by (dx, dy): the class's frame is turned by the in-plane angle."""
    c, s = F.cos(F.radians(e3)), F.sin(F.radians(e3))
    return [x + dx * c - dy * s, y + dx * s + dy * c]
