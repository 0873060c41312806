"""Vectors, 4 x 4 matrices and quaternions as lists of columns: sums of products that stay inside generated code.

A matrix is 16 columns in column-major order; a quaternion is w, x, y, z.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vector = list
Matrix = list


def held(df: DataFrame, name: str, values: list[Column]) -> tuple[DataFrame, list[Column]]:
    """df with the values as columns name0, name1, ..., and those columns: computed once, where later formulas use them many times."""
    names = [f"{name}{i}" for i in range(len(values))]
    return df.withColumns(dict(zip(names, values))), [F.col(n) for n in names]


def once(df: DataFrame, name: str, values: list[Column]) -> tuple[DataFrame, list[Column]]:
    """The same by a generator of one row: Spark pushes no filter through it, which would write long formulas out again in every use."""
    names = [f"{name}{i}" for i in range(len(values))]
    return df.select("*", F.inline(F.array(F.struct(*(v.alias(n) for v, n in zip(values, names)))))), [F.col(n) for n in names]


def lit(*values: float) -> list[Column]:
    return [F.lit(float(v)) for v in values]


def identity() -> Matrix:
    return lit(*(1.0 if r == c else 0.0 for c in range(4) for r in range(4)))


def translation(x: Column, y: Column, z: Column) -> Matrix:
    return identity()[:12] + [x, y, z, F.lit(1.0)]


def scaling(x: Column, y: Column, z: Column) -> Matrix:
    zero, one = lit(0, 1)
    return [x, zero, zero, zero, zero, y, zero, zero, zero, zero, z, zero, zero, zero, zero, one]


def rotation(axis: str, angle: Column) -> Matrix:
    """Right-handed rotation about an axis."""
    c, s = F.cos(angle), F.sin(angle)
    zero, one = lit(0, 1)
    return {
        "x": [one, zero, zero, zero, zero, c, s, zero, zero, -s, c, zero, zero, zero, zero, one],
        "y": [c, zero, -s, zero, zero, one, zero, zero, s, zero, c, zero, zero, zero, zero, one],
        "z": [c, s, zero, zero, -s, c, zero, zero, zero, zero, one, zero, zero, zero, zero, one],
    }[axis]


def multiply(*factors: Matrix) -> Matrix:
    """The product, left to right; of none, the identity."""
    out = identity()
    for k, b in enumerate(factors):
        out = b if k == 0 else [sum((out[4 * i + r] * b[4 * c + i] for i in range(1, 4)), out[r] * b[4 * c]) for c in range(4) for r in range(4)]
    return out


def transform(m: Matrix, p: Vector) -> Vector:
    """m . (x, y, z, 1)."""
    return [m[r] * p[0] + m[4 + r] * p[1] + m[8 + r] * p[2] + m[12 + r] for r in range(4)]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def minus(a: Vector, b: Vector) -> Vector:
    return [x - y for x, y in zip(a, b)]


def normalize(v: Vector) -> Vector:
    """Unit vector; a zero vector stays zero."""
    n = F.sqrt(dot(v, v))
    return [F.when(n > 0, x / n).otherwise(0.0) for x in v]


def look_at(eye: Vector, target: Vector, up: Vector) -> Matrix:
    """Right-handed view matrix that looks along -z."""
    z = normalize(minus(eye, target))
    x = normalize(cross(up, z))
    y = cross(z, x)
    zero, one = lit(0, 1)
    return [x[0], y[0], z[0], zero, x[1], y[1], z[1], zero, x[2], y[2], z[2], zero, -dot(x, eye), -dot(y, eye), -dot(z, eye), one]


def perspective(fovy: Column, aspect: Column, near: Column, far: Column) -> Matrix:
    """Projection to clip depth 0 to 1."""
    f = 1 / F.tan(fovy / 2)
    zero, minus_one = lit(0, -1)
    return [f / aspect, zero, zero, zero, zero, f, zero, zero, zero, zero, far / (near - far), minus_one, zero, zero, far * near / (near - far), zero]


def inverse_perspective(fovy: Column, aspect: Column, near: Column, far: Column) -> Matrix:
    t = F.tan(fovy / 2)
    zero, minus_one = lit(0, -1)
    return [t * aspect, zero, zero, zero, zero, t, zero, zero, zero, zero, zero, (near - far) / (far * near), zero, zero, minus_one, 1 / near]


def orthographic(left: Column, right: Column, bottom: Column, top: Column, near: Column, far: Column) -> Matrix:
    """Projection of a box to clip depth 0 to 1, as the frustum test expects."""
    zero, one = lit(0, 1)
    return [2 / (right - left), zero, zero, zero, zero, 2 / (top - bottom), zero, zero, zero, zero, 1 / (near - far), zero, (left + right) / (left - right), (bottom + top) / (bottom - top), near / (near - far), one]


def intrinsics(width: Column, height: Column, fovy: Column) -> dict[str, Column]:
    focal = (height / 2) / F.tan(fovy / 2)
    return {"fx": focal, "fy": focal, "cx": width / 2, "cy": height / 2}


def quaternion_product(a: Vector, b: Vector) -> Vector:
    return [
        a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3],
        a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2],
        a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1],
        a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0],
    ]


def rotation_of(q: Vector) -> list[list[Column]]:
    """Rows of the 3 x 3 rotation of a unit quaternion."""
    w, x, y, z = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def quaternion_of(r: list[list[Column]]) -> Vector:
    """Unit quaternion of a rotation's rows, by the largest of the trace and the diagonal."""
    trace = r[0][0] + r[1][1] + r[2][2]
    on_trace = trace > 0
    on_x = (r[0][0] > r[1][1]) & (r[0][0] > r[2][2])
    on_y = r[1][1] > r[2][2]
    t, x, y, z = (2 * F.sqrt(v) for v in (trace + 1, 1 + r[0][0] - r[1][1] - r[2][2], 1 + r[1][1] - r[0][0] - r[2][2], 1 + r[2][2] - r[0][0] - r[1][1]))
    a, b, c = r[2][1] - r[1][2], r[0][2] - r[2][0], r[1][0] - r[0][1]
    d, e, f = r[0][1] + r[1][0], r[0][2] + r[2][0], r[1][2] + r[2][1]
    cases = [(t / 4, a / x, b / y, c / z), (a / t, x / 4, d / y, e / z), (b / t, d / x, y / 4, f / z), (c / t, e / x, f / y, z / 4)]
    q = [F.when(on_trace, p[0]).when(on_x, p[1]).when(on_y, p[2]).otherwise(p[3]) for p in cases]
    n = F.sqrt(sum((v * v for v in q[1:]), q[0] * q[0]))
    return [v / n for v in q]


def rows_of_view(view: Matrix) -> list[list[Column]]:
    return [[view[4 * c + r] for c in range(3)] for r in range(3)]


def colmap_pose(df: DataFrame, view: Matrix, eye: Vector) -> tuple[DataFrame, Vector, Vector]:
    """df with columns q0 .. q3 and t0 .. t2, and those: the pose of a view in the convention with y down and z forward, half a turn about x before the view; t = -R . eye."""
    df, view = held(df, "__view", view)
    df, own = held(df, "__own", quaternion_of(rows_of_view(view)))
    df, q = held(df, "q", quaternion_product(lit(0, 1, 0, 0), own))
    df, t = held(df, "t", [-dot(row, eye) for row in rotation_of(q)])
    return df.drop(*(f"__view{i}" for i in range(16)), *(f"__own{i}" for i in range(4))), q, t


def colmap_pose_to_target(df: DataFrame, eye: Vector, target: Vector) -> tuple[DataFrame, Vector, Vector]:
    """The same of a camera at ``eye`` that looks at ``target`` with y up: rows right, down, ahead."""
    df, ahead = held(df, "__a", normalize(minus(target, eye)))
    df, right = held(df, "__r", normalize(cross(ahead, lit(0, 1, 0))))
    df, down = held(df, "__d", cross(ahead, right))
    df, q = held(df, "q", quaternion_of([right, down, ahead]))
    df, t = held(df, "t", [-dot(row, eye) for row in (right, down, ahead)])
    return df.drop(*(f"__{n}{i}" for n in "ard" for i in range(3))), q, t


def view_of_colmap(q: Vector, t: Vector) -> Matrix:
    """View matrix (y up, looking along -z) of a pose: the second and third rows change sign."""
    r = rotation_of(q)
    rows = [[*r[0], t[0]], [-v for v in [*r[1], t[1]]], [-v for v in [*r[2], t[2]]]]
    return [rows[i][c] if i < 3 else lit(1.0 if c == 3 else 0.0)[0] for c in range(4) for i in range(4)]


def projection_of_colmap(fx: Column, fy: Column, cx: Column, cy: Column, width: Column, height: Column, near: Column, far: Column) -> Matrix:
    zero, minus_one = lit(0, -1)
    return [2 * fx / width, zero, zero, zero, zero, 2 * fy / height, zero, zero, 1 - 2 * cx / width, 2 * cy / height - 1, far / (near - far), minus_one, zero, zero, far * near / (near - far), zero]


def camera_center(q: Vector, t: Vector) -> Vector:
    """-R' . t."""
    r = rotation_of(q)
    return [-(r[0][i] * t[0] + r[1][i] * t[1] + r[2][i] * t[2]) for i in range(3)]
