"""Vectors, quaternions, cameras and rigid motions as column expressions.

A vector is three columns (x, y, z), a quaternion four with the scalar first, a pose a quaternion and a vector;
vec(), quat() and the *_struct functions pass from and to struct columns. Poses follow published SE(3) formulas:
a twist is (linear, angular), Euler angles are intrinsic Z-Y-X with roll 0 at the poles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
Quat = tuple[Column, Column, Column, Column]
Pose = tuple[Quat, Vec]

SMALL = 1e-5  # below it, series are exact to double precision
NO_ROTATION = 1e-30


def vec(c: Column) -> Vec:
    return c["x"], c["y"], c["z"]


def quat(c: Column) -> Quat:
    return c["w"], c["x"], c["y"], c["z"]


def vec_struct(v: Vec) -> Column:
    return F.struct(*(x.alias(n) for x, n in zip(v, "xyz", strict=True)))


def quat_struct(q: Quat) -> Column:
    return F.struct(*(x.alias(n) for x, n in zip(q, "wxyz", strict=True)))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def scale(a: Vec, s: Column | float) -> Vec:
    return tuple(x * s for x in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Vec) -> Vec:
    """Zero stays zero."""
    n = norm(a)
    return tuple(F.when(n == 0, F.lit(0.0)).otherwise(x / n) for x in a)


def multiply(a: Quat, b: Quat) -> Quat:
    (aw, ax, ay, az), (bw, bx, by, bz) = a, b
    return aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw


def conjugate(q: Quat) -> Quat:
    return q[0], -q[1], -q[2], -q[3]


def rotate(q: Quat, v: Vec) -> Vec:
    """By a unit quaternion: v + 2 w (u x v) + 2 u x (u x v)."""
    u = q[1:]
    t = scale(cross(u, v), 2.0)
    return add(add(v, scale(t, q[0])), cross(u, t))


def from_euler(roll: Column, pitch: Column, yaw: Column) -> Quat:
    """Radians."""
    (cr, sr), (cp, sp), (cy, sy) = ((F.cos(a / 2), F.sin(a / 2)) for a in (roll, pitch, yaw))
    return cr * cp * cy + sr * sp * sy, sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy


def from_euler_degrees(roll: Column, pitch: Column, yaw: Column) -> Quat:
    return from_euler(F.radians(roll), F.radians(pitch), F.radians(yaw))


def to_euler(q: Quat) -> Vec:
    """(roll, pitch, yaw) in radians."""
    w, x, y, z = q
    s = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (w * y - z * x) * 2.0))
    pole = F.abs(s) >= 1 - 1e-12
    roll = F.when(pole, F.lit(0.0)).otherwise(F.atan2((w * x + y * z) * 2.0, F.lit(1.0) - (x * x + y * y) * 2.0))
    yaw = F.when(pole, F.atan2((x * y - w * z) * -2.0, F.lit(1.0) - (x * x + z * z) * 2.0)).otherwise(F.atan2((w * z + x * y) * 2.0, F.lit(1.0) - (y * y + z * z) * 2.0))
    return roll, F.asin(s), yaw


def to_euler_degrees(q: Quat) -> Vec:
    return tuple(F.degrees(a) for a in to_euler(q))


def to_axis_angle(q: Quat) -> tuple[Vec, Column]:
    """The angle is in [0, pi]; no rotation has the x axis."""
    sign = F.when(q[0] < 0, -1.0).otherwise(1.0)
    u = scale(q[1:], sign)
    n = norm(u)
    axis = tuple(F.when(n == 0, F.lit(d)).otherwise(x / n) for x, d in zip(u, (1.0, 0.0, 0.0), strict=True))
    return axis, F.atan2(n, q[0] * sign) * 2.0


def rotation_matrix(q: Quat) -> list[Column]:
    """Nine elements by rows, of the components as they are."""
    w, x, y, z = q
    one = F.lit(1.0)
    return [
        one - (y * y + z * z) * 2.0, (x * y - w * z) * 2.0, (x * z + w * y) * 2.0,
        (x * y + w * z) * 2.0, one - (x * x + z * z) * 2.0, (y * z - w * x) * 2.0,
        (x * z - w * y) * 2.0, (y * z + w * x) * 2.0, one - (x * x + y * y) * 2.0,
    ]


def intrinsic_matrix(fx: Column, fy: Column, cx: Column, cy: Column) -> list[Column]:
    o, i = F.lit(0.0), F.lit(1.0)
    return [fx, o, cx, o, fy, cy, o, o, i]


def extrinsic_matrix(pose: Pose) -> list[Column]:
    r, t = rotation_matrix(pose[0]), pose[1]
    return [*r[0:3], t[0], *r[3:6], t[1], *r[6:9], t[2]]


def projection_matrix(k: list[Column], rt: list[Column]) -> list[Column]:
    """3 x 3 times 3 x 4, summed from the left."""
    return [F.lit(0.0) + k[r * 3] * rt[c] + k[r * 3 + 1] * rt[4 + c] + k[r * 3 + 2] * rt[8 + c] for r in range(3) for c in range(4)]


def compose(a: Pose, b: Pose) -> Pose:
    """a after b."""
    return multiply(a[0], b[0]), add(rotate(a[0], b[1]), a[1])


def compose_frames(a: Pose, b: Pose, a_to: Column, b_from: Column) -> Pose:
    """The same; frames that do not chain raise INVALID_ARGUMENT."""
    q, t = compose(a, b)
    check = F.when(a_to == b_from, F.lit(0.0)).otherwise(F.raise_error(F.lit("INVALID_ARGUMENT: frames do not chain")).cast("double"))
    return (q[0] + check, *q[1:]), t


def invert(p: Pose) -> Pose:
    q = conjugate(p[0])
    return q, scale(rotate(q, p[1]), -1.0)


def relative(a: Pose, b: Pose) -> Pose:
    """b as seen from a."""
    return compose(invert(a), b)


def act(p: Pose, v: Vec) -> Vec:
    return add(rotate(p[0], v), p[1])


def _series(angle: Column, exact: Column, limit: float) -> Column:
    return F.when(angle < SMALL, F.lit(limit)).otherwise(exact)


def exp(linear: Vec, angular: Vec) -> Pose:
    a = norm(angular)
    s = _series(a, F.sin(a / 2) / a, 0.5)
    q = (F.cos(a / 2), *scale(angular, s))
    b = _series(a, F.sin(a / 2) * F.sin(a / 2) * 2.0 / (a * a), 0.5)
    c = _series(a, (a - F.sin(a)) / (a * a * a), 1.0 / 6.0)
    wv = cross(angular, linear)
    return q, add(add(linear, scale(wv, b)), scale(cross(angular, wv), c))


def log(p: Pose) -> tuple[Vec, Vec]:
    """(linear, angular); the rotation's angle is in [0, pi]."""
    axis, a = to_axis_angle(p[0])
    sign = F.when(p[0][0] < 0, -1.0).otherwise(1.0)
    small = a < SMALL
    w = tuple(F.when(small, u * sign * 2.0).otherwise(x * a) for x, u in zip(axis, p[0][1:], strict=True))
    c = F.when(small, F.lit(1.0 / 12.0)).otherwise((F.lit(1.0) - a * F.sin(a) / (F.sin(a / 2) * F.sin(a / 2) * 4.0)) / (a * a))
    wt = cross(w, p[1])
    return add(add(p[1], scale(wt, -0.5)), scale(cross(w, wt), c)), w


def adjoint(p: Pose) -> list[Column]:
    """36 elements by rows, for twists (linear, angular)."""
    r, (x, y, z) = rotation_matrix(p[0]), p[1]
    o = F.lit(0.0)
    skew = [o, -z, y, z, o, -x, -y, x, o]
    tr = [skew[i * 3] * r[j] + skew[i * 3 + 1] * r[3 + j] + skew[i * 3 + 2] * r[6 + j] for i in range(3) for j in range(3)]
    return [e for i in range(3) for e in (*r[i * 3 : i * 3 + 3], *tr[i * 3 : i * 3 + 3])] + [e for i in range(3) for e in (o, o, o, *r[i * 3 : i * 3 + 3])]


def transform_twist(p: Pose, linear: Vec, angular: Vec) -> tuple[Vec, Vec]:
    w = rotate(p[0], angular)
    return add(rotate(p[0], linear), cross(p[1], w)), w


def settled(rows: DataFrame, name: str, *parts: Vec | Quat) -> tuple[DataFrame, tuple]:
    """rows with parts as columns, and the parts as those columns. Between steps it keeps expressions from growing into each other."""
    names = [[f"_{name}{i}_{j}" for j in range(len(p))] for i, p in enumerate(parts)]
    rows = rows.withColumns({n: c for ns, p in zip(names, parts, strict=True) for n, c in zip(ns, p, strict=True)})
    return rows, tuple(tuple(F.col(n) for n in ns) for ns in names)


def interpolated(rows: DataFrame, name: str, a: Pose, b: Pose, t: Column) -> tuple[DataFrame, Pose]:
    """The pose a part t of the way from a to b along one screw, as columns of rows."""
    rows, between = settled(rows, f"{name}_between", *relative(a, b))
    rows, (linear, angular) = settled(rows, f"{name}_log", *log(between))
    rows, step = settled(rows, f"{name}_step", *exp(scale(linear, t), scale(angular, t)))
    return settled(rows, name, *compose(a, step))


def screw_magnitude(angular: Vec) -> Column:
    return norm(angular)


def screw_pitch(linear: Vec, angular: Vec) -> Column:
    """Null without rotation."""
    n = dot(angular, angular)
    return F.when(n >= NO_ROTATION, dot(angular, linear) / n)


def screw_axis(linear: Vec, angular: Vec) -> tuple[Vec, Vec, Column]:
    """Direction, a point on the axis, pitch; all null without rotation."""
    n = dot(angular, angular)
    some = n >= NO_ROTATION
    direction = tuple(F.when(some, x / F.sqrt(n)) for x in angular)
    point = tuple(F.when(some, x / n) for x in cross(angular, linear))
    return direction, point, screw_pitch(linear, angular)


def screw_motion(linear: Vec, angular: Vec, theta: Column) -> Pose:
    """act() moves points by it, invert() undoes it."""
    return exp(scale(linear, theta), scale(angular, theta))


def propagate(p: Pose, linear: Vec, angular: Vec, dt: Column) -> Pose:
    """Straight motion and a rotation about world axes."""
    turn, _ = exp((F.lit(0.0),) * 3, scale(angular, dt))
    return multiply(turn, p[0]), add(p[1], scale(linear, dt))


def propagate_screw(p: Pose, linear: Vec, angular: Vec, dt: Column) -> Pose:
    return compose(screw_motion(linear, angular, dt), p)


def screw(six: Column) -> tuple[Vec, Vec]:
    """Linear and angular part of an array of six."""
    at = lambda i: F.get(six, F.lit(i - 1))
    return (at(1), at(2), at(3)), (at(4), at(5), at(6))


def state(pose: Pose, linear: Vec | None = None, angular: Vec | None = None) -> Column:
    """A struct of position, orientation and velocities; without a twist it is at rest. Frames are not part of it."""
    rest = (F.lit(0.0),) * 3
    return F.struct(vec_struct(pose[1]).alias("position"), quat_struct(pose[0]).alias("orientation"), vec_struct(linear or rest).alias("linear_velocity"), vec_struct(angular or rest).alias("angular_velocity"))


def state_pose(s: Column) -> Pose:
    return quat(s["orientation"]), vec(s["position"])


def state_twist(s: Column) -> Column:
    """An array of six: linear, then angular velocity."""
    return F.array(*vec(s["linear_velocity"]), *vec(s["angular_velocity"]))


def state_velocity_in(s: Column, pose: Pose) -> Column:
    """The state with its velocities carried by a pose's adjoint; position and orientation stay."""
    return state(state_pose(s), *transform_twist(pose, vec(s["linear_velocity"]), vec(s["angular_velocity"])))


def pose_of_extrinsics(camera: Column) -> Pose:
    """Of a typed camera."""
    return quat(camera["rotation"]), vec(camera["position"])


def with_extrinsics(camera: Column, pose: Pose) -> Column:
    return camera.withField("rotation", quat_struct(pose[0])).withField("position", vec_struct(pose[1]))


IDENTITY: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0)


def identity() -> Pose:
    return tuple(F.lit(x) for x in IDENTITY), (F.lit(0.0),) * 3


def quarter_turn() -> Quat:
    """90 degrees about x, for tests and examples."""
    return F.lit(math.sqrt(0.5)), F.lit(math.sqrt(0.5)), F.lit(0.0), F.lit(0.0)
