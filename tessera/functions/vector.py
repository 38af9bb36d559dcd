"""Vectors as array<double> columns; everything stays inside Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(v) -> Column:
    return col(v).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def scaled(v, by: Column) -> Column:
    return F.transform(doubles(v), lambda x: x * by)


def unit(v) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(doubles(v), lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


def cosine(a, b) -> Column:
    """Null where either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def strict_cosine(a, b) -> Column:
    """Raises where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.raise_error(F.lit("a vector has no direction")).cast("double"))


def centred_unit(v) -> Column:
    """The unit vector of the differences from the mean element; null if they are all zero."""
    m = F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x) / F.size(v if isinstance(v, Column) else F.col(v))
    d = F.transform(doubles(v), lambda x: x - m)
    return F.when(norm(d) > 0, unit(d))


def softmax(v) -> Column:
    top = F.array_max(doubles(v))
    e = F.transform(doubles(v), lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def relevancy(positive, negatives, scale: float = 10.0) -> Column:
    """Least share of a positive similarity against each of the negatives' under a two-way softmax."""
    p = col(positive)
    return F.array_min(F.transform(doubles(negatives), lambda n: F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(scale) * (n - p)))))


def any_prompt(similarities, threshold: float) -> Column:
    """Is any (s + 1) / 2 over the threshold?"""
    return F.exists(doubles(similarities), lambda s: (s + 1) / 2 > threshold)


def scaled_distance(d, largest) -> Column:
    return col(d) / (col(largest) + F.lit(1e-8))


def transform_point(x, y, z, matrix: list[float], guard: bool = True) -> list[Column]:
    """A 4 x 4 row-major homogeneous transform; with the guard a vanishing w raises."""
    x, y, z = col(x), col(y), col(z)
    rows = [F.lit(float(matrix[4 * r])) * x + F.lit(float(matrix[4 * r + 1])) * y + F.lit(float(matrix[4 * r + 2])) * z + F.lit(float(matrix[4 * r + 3])) for r in range(4)]
    w = rows[3]
    if guard:
        w = F.when(F.abs(w) < 1e-12, F.raise_error(F.lit("a point at infinity")).cast("double")).otherwise(w)
    return [r / w for r in rows[:3]]


def rotation_of(qw, qx, qy, qz, normalise: bool = True) -> list[Column]:
    """The nine elements of a quaternion's rotation, by rows."""
    q = [col(c).cast("double") for c in (qw, qx, qy, qz)]
    if normalise:
        n = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
        q = [c / n for c in q]
    w, x, y, z = q
    one, two = F.lit(1.0), F.lit(2.0)
    return [
        one - two * (y * y + z * z), two * (x * y - w * z), two * (x * z + w * y),
        two * (x * y + w * z), one - two * (x * x + z * z), two * (y * z - w * x),
        two * (x * z - w * y), two * (y * z + w * x), one - two * (x * x + y * y),
    ]


def camera_centre(rotation: list[Column], translation: list[Column]) -> list[Column]:
    """-R^T t."""
    return [-(rotation[k] * translation[0] + rotation[3 + k] * translation[1] + rotation[6 + k] * translation[2]) for k in range(3)]


def triangle_area(a: list[Column], b: list[Column], c: list[Column]) -> Column:
    u, v = [q - p for p, q in zip(a, b)], [q - p for p, q in zip(a, c)]
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    return F.sqrt(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2]) / 2


def valid_pose(m: list[Column]) -> Column:
    """Is a row-major 4 x 4 matrix a finite rigid motion: last row within 1e-4, determinant and R^T R within 0.02?"""
    r = [[m[4 * i + j] for j in range(3)] for i in range(3)]
    finite = F.lit(True)
    for c in m:
        finite = finite & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    last = (F.abs(m[12]) <= 1e-4) & (F.abs(m[13]) <= 1e-4) & (F.abs(m[14]) <= 1e-4) & (F.abs(m[15] - 1) <= 1e-4)
    det = r[0][0] * (r[1][1] * r[2][2] - r[1][2] * r[2][1]) - r[0][1] * (r[1][0] * r[2][2] - r[1][2] * r[2][0]) + r[0][2] * (r[1][0] * r[2][1] - r[1][1] * r[2][0])
    ok = F.abs(det - 1) <= 0.02
    for i in range(3):
        for j in range(3):
            ok = ok & (F.abs(sum((r[k][i] * r[k][j] for k in range(3)), F.lit(0.0)) - (1.0 if i == j else 0.0)) <= 0.02)
    return F.coalesce(finite & last & ok, F.lit(False))
