"""Camera and pose expressions; 4x4 matrices are ARRAY<DOUBLE> of 16, row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTITY = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0]


def matrix(*entries: float | Column) -> Column:
    return F.array(*(e if isinstance(e, Column) else F.lit(float(e)) for e in entries))


def multiply(a: Column, b: Column) -> Column:
    """The product of two 4x4 matrices."""
    return F.array(*(sum((a[4 * i + k] * b[4 * k + j] for k in range(1, 4)), a[4 * i] * b[j]) for i in range(4) for j in range(4)))


def rigid_inverse(p: Column) -> Column:
    """The inverse of a rotation with translation."""
    r = [[p[4 * j + i] for j in range(3)] for i in range(3)]
    t = [-(r[i][0] * p[3] + r[i][1] * p[7] + r[i][2] * p[11]) for i in range(3)]
    return F.array(*(c for i in range(3) for c in (*r[i], t[i])), *(F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)))


def apply(p: Column, x: Column, y: Column, z: Column) -> list[Column]:
    return [p[4 * i] * x + p[4 * i + 1] * y + p[4 * i + 2] * z + p[4 * i + 3] for i in range(3)]


def determinant3(p: Column) -> Column:
    """Determinant of the rotation part."""
    a = lambda i, j: p[4 * i + j]
    return a(0, 0) * (a(1, 1) * a(2, 2) - a(1, 2) * a(2, 1)) - a(0, 1) * (a(1, 0) * a(2, 2) - a(1, 2) * a(2, 0)) + a(0, 2) * (a(1, 0) * a(2, 1) - a(1, 1) * a(2, 0))


def conjugate_yz(p: Column) -> Column:
    """P M P with P = diag(1, -1, -1, 1): entries change sign where exactly one index is 1 or 2."""
    flip = lambda i: i in (1, 2)
    return F.array(*(-p[4 * i + j] if flip(i) != flip(j) else p[4 * i + j] for i in range(4) for j in range(4)))


def flip_axes(p: Column, *axes: int) -> Column:
    """Columns ``axes`` with their signs changed."""
    return F.array(*(-p[4 * i + j] if j in axes else p[4 * i + j] for i in range(4) for j in range(4)))


def from_column_major(a: Column) -> Column:
    return F.array(*(a[4 * j + i] for i in range(4) for j in range(4)))


def unproject(u: Column, v: Column, depth: Column, fx, fy, cx, cy) -> list[Column]:
    return [(u - cx) * depth / fx, (v - cy) * depth / fy, depth]


def project(x: Column, y: Column, z: Column, fx, fy, cx, cy) -> list[Column]:
    """Pixel of a point in camera coordinates; null at z = 0."""
    return [F.when(z != 0, x * fx / z + cx), F.when(z != 0, y * fy / z + cy)]


def visibility(u: Column, v: Column, z: Column, depth: Column, width, height, margin: float) -> Column:
    """Where a projected point lies: outside, or in front of, at or behind the depth image's surface."""
    inside = (u >= 0) & (u < width) & (v >= 0) & (v < height) & (z > 0)
    return F.when(~F.coalesce(inside, F.lit(False)), "outside").when(F.abs(z - depth) <= margin, "aligned").when(z < depth, "front").otherwise("behind")


def intrinsics(fov_degrees: Column, height, width) -> dict[str, Column]:
    f = height / (2 * F.tan(F.radians(fov_degrees) / 2))
    return {"fx": f, "fy": f, "cx": F.lit(1.0) * width / 2, "cy": F.lit(1.0) * height / 2}


def scale_intrinsics(k: dict[str, Column], sx, sy) -> dict[str, Column]:
    return {"fx": k["fx"] * sx, "cx": k["cx"] * sx, "fy": k["fy"] * sy, "cy": k["cy"] * sy}


def circular(a: Column, b: Column) -> Column:
    """Difference of two angles in degrees, in [0, 180]."""
    d = F.pmod(a - b, F.lit(360.0))
    return F.least(d, 360.0 - d)


def rotation_distance(a: list[Column], b: list[Column]) -> Column:
    out = circular(a[0], b[0])
    for x, y in zip(a[1:], b[1:]):
        out = out + circular(x, y)
    return out


def position_distance(a: list[Column], b: list[Column], order: int = 2, ignore_y: bool = False) -> Column:
    parts = [x - y for i, (x, y) in enumerate(zip(a, b)) if not (ignore_y and i == 1)]
    if order == 1:
        return sum((F.abs(p) for p in parts[1:]), F.abs(parts[0]))
    if order == 2:
        return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))
    raise ValueError("order must be 1 or 2")


def rotation_angle(a: Column, b: Column) -> Column:
    """Degrees between the rotation parts of two poses."""
    trace = sum((a[4 * i + k] * b[4 * i + k] for i in range(3) for k in range(3)), F.lit(0.0))
    return F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (trace - 1) / 2))))


def euler_zxy(x: Column, y: Column, z: Column, position: list[Column]) -> Column:
    """Pose of rotations about z, then x, then y (degrees): R = Ry Rx Rz."""
    (sx, cx), (sy, cy), (sz, cz) = ((F.sin(F.radians(a)), F.cos(F.radians(a))) for a in (x, y, z))
    r = [
        [cy * cz + sy * sx * sz, -cy * sz + sy * sx * cz, sy * cx],
        [cx * sz, cx * cz, -sx],
        [-sy * cz + cy * sx * sz, sy * sz + cy * sx * cz, cy * cx],
    ]
    return F.array(*(c for i in range(3) for c in (*r[i], position[i])), *(F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)))


def euler_zxy_of(p: Column) -> list[Column]:
    """(x, y, z) degrees of a pose made by :func:`euler_zxy`."""
    return [F.degrees(F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), -p[6])))), F.degrees(F.atan2(p[2], p[10])), F.degrees(F.atan2(p[4], p[5]))]


def quaternion(x: Column, y: Column, z: Column, w: Column, t: list[Column]) -> Column:
    """Pose of a quaternion in order xyzw and a translation."""
    n = x * x + y * y + z * z + w * w
    s = F.when(n > 0, 2 / n)
    r = [
        [1 - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w)],
        [s * (x * y + z * w), 1 - s * (x * x + z * z), s * (y * z - x * w)],
        [s * (x * z - y * w), s * (y * z + x * w), 1 - s * (x * x + y * y)],
    ]
    return F.array(*(c for i in range(3) for c in (*r[i], t[i])), *(F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)))


def camera_center(p: Column, world_to_camera: bool) -> list[Column]:
    if not world_to_camera:
        return [p[3], p[7], p[11]]
    return [-(p[i] * p[3] + p[4 + i] * p[7] + p[8 + i] * p[11]) for i in range(3)]


def camera_forward(p: Column, world_to_camera: bool) -> list[Column]:
    """Unit viewing direction; null if degenerate."""
    f = [p[8 + i] for i in range(3)] if world_to_camera else [p[4 * i + 2] for i in range(3)]
    n = F.sqrt(f[0] * f[0] + f[1] * f[1] + f[2] * f[2])
    return [F.when(n > 0, c / n) for c in f]


def align_vectors(a: list[Column], b: list[Column]) -> tuple[list[Column], Column]:
    """Axis (cross product) and angle that turn ``a`` to ``b``."""
    axis = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    d = a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    n = F.sqrt((a[0] * a[0] + a[1] * a[1] + a[2] * a[2]) * (b[0] * b[0] + b[1] * b[1] + b[2] * b[2]))
    return axis, F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), d / n)))


def frame_window(start, end, fps) -> list[Column]:
    """Seconds that surely hold the frames from ``start`` to ``end``."""
    return [(start + 0.25) / fps, (end + 0.75) / fps]


def is_pose(p: Column) -> Column:
    """A finite 4x4 with last row 0 0 0 1 and an invertible rotation part."""
    last = (F.abs(p[12]) <= 1e-6) & (F.abs(p[13]) <= 1e-6) & (F.abs(p[14]) <= 1e-6) & (F.abs(p[15] - 1) <= 1e-6)
    finite = F.forall(p, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(p) == 16) & finite & last & (F.abs(determinant3(p)) >= 1e-8), F.lit(False))
