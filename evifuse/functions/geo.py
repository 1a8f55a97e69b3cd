"""Geodesy and rotations as column expressions: WGS84, local tangent planes, unit quaternions, ground rays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The WGS84 ellipsoid.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
SEMI_MINOR = SEMI_MAJOR * (1 - FLATTENING)
E2 = FLATTENING * (2 - FLATTENING)
EP2 = (SEMI_MAJOR**2 - SEMI_MINOR**2) / SEMI_MINOR**2
EARTH_RADIUS = 6371008.8

Triple = tuple[Column, Column, Column]


def geodetic_to_ecef(lat: Column, lon: Column, height: Column) -> Triple:
    """Degrees and ellipsoid height to earth-centred metres."""
    phi, lam = F.radians(lat), F.radians(lon)
    n = SEMI_MAJOR / F.sqrt(1 - E2 * F.sin(phi) * F.sin(phi))
    return (n + height) * F.cos(phi) * F.cos(lam), (n + height) * F.cos(phi) * F.sin(lam), (n * (1 - E2) + height) * F.sin(phi)


def ecef_to_geodetic(x: Column, y: Column, z: Column) -> Triple:
    """The closed form of Bowring; on the axis the pole."""
    p = F.sqrt(x * x + y * y)
    theta = F.atan2(z * SEMI_MAJOR, p * SEMI_MINOR)
    phi = F.atan2(z + EP2 * SEMI_MINOR * F.pow(F.sin(theta), 3), p - E2 * SEMI_MAJOR * F.pow(F.cos(theta), 3))
    n = SEMI_MAJOR / F.sqrt(1 - E2 * F.sin(phi) * F.sin(phi))
    axis = p < 1e-9
    lat = F.when(axis, F.when(z >= 0, 90.0).otherwise(-90.0)).otherwise(F.degrees(phi))
    height = F.when(axis, F.abs(z) - SEMI_MINOR).otherwise(p / F.cos(phi) - n)
    return lat, F.degrees(F.atan2(y, x)), height


def ecef_to_enu(d: Triple, lat: Column, lon: Column) -> Triple:
    """Rotate an earth-centred difference into east, north, up of an origin."""
    dx, dy, dz = d
    sp, cp, sl, cl = F.sin(F.radians(lat)), F.cos(F.radians(lat)), F.sin(F.radians(lon)), F.cos(F.radians(lon))
    return -sl * dx + cl * dy, -sp * cl * dx - sp * sl * dy + cp * dz, cp * cl * dx + cp * sl * dy + sp * dz


def enu_to_ecef(e: Triple, lat: Column, lon: Column) -> Triple:
    """The transposed rotation."""
    east, north, up = e
    sp, cp, sl, cl = F.sin(F.radians(lat)), F.cos(F.radians(lat)), F.sin(F.radians(lon)), F.cos(F.radians(lon))
    return -sl * east - sp * cl * north + cp * cl * up, cl * east - sp * sl * north + cp * sl * up, cp * north + sp * up


def geodetic_to_enu(point: Triple, origin: Triple) -> Triple:
    a, b = geodetic_to_ecef(*point), geodetic_to_ecef(*origin)
    return ecef_to_enu((a[0] - b[0], a[1] - b[1], a[2] - b[2]), origin[0], origin[1])


def enu_to_geodetic(enu: Triple, origin: Triple) -> Triple:
    d, b = enu_to_ecef(enu, origin[0], origin[1]), geodetic_to_ecef(*origin)
    return ecef_to_geodetic(b[0] + d[0], b[1] + d[1], b[2] + d[2])


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular metres at the mean latitude, the shorter way round."""
    dlon = F.pmod(lon2 - lon1 + 180.0, F.lit(360.0)) - 180.0
    x = F.radians(dlon) * F.cos(F.radians((lat1 + lat2) / 2))
    return EARTH_RADIUS * F.sqrt(x * x + F.pow(F.radians(lat2 - lat1), 2))


def wrapped_between(lon1: Column, lon2: Column, share: Column) -> Column:
    """Longitude between two, the shorter way, in [-180, 180)."""
    return F.pmod(lon1 + (F.pmod(lon2 - lon1 + 180.0, F.lit(360.0)) - 180.0) * share + 180.0, F.lit(360.0)) - 180.0


def quaternion_product(a: list[Column], b: list[Column]) -> list[Column]:
    """Hamilton product of (w, x, y, z)."""
    return [
        a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3],
        a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2],
        a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1],
        a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0],
    ]


def conjugate(q: list[Column]) -> list[Column]:
    return [q[0], -q[1], -q[2], -q[3]]


def normalized(q: list[Column]) -> list[Column]:
    """Unit length; q and -q are one rotation, so the first part that is not zero is positive."""
    n = F.sqrt(sum((x * x for x in q[1:]), q[0] * q[0]))
    sign = F.lit(1.0)
    for x in reversed(q):
        sign = F.when(x > 0, 1.0).when(x < 0, -1.0).otherwise(sign)
    return [F.when(n > 1e-12, sign * x / n) for x in q]


def rotate(q: list[Column], v: Triple) -> Triple:
    """A unit quaternion applied to a vector."""
    out = quaternion_product(quaternion_product(q, [F.lit(0.0), *v]), conjugate(q))
    return out[1], out[2], out[3]


def slerp(a: list[Column], b: list[Column], share: Column) -> list[Column]:
    """The shorter arc; nearly equal rotations are mixed linearly and normalized."""
    return normalized(mixed(a, b, share))


def mixed(a: list[Column], b: list[Column], share: Column) -> list[Column]:
    """What ``slerp`` normalizes."""
    dot = sum((x * y for x, y in zip(a[1:], b[1:])), a[0] * b[0])
    near = [F.when(dot < 0, -y).otherwise(y) for y in b]
    angle = F.acos(F.least(F.abs(dot), F.lit(1.0)))
    linear = F.abs(dot) > 0.9995
    wa = F.when(linear, 1 - share).otherwise(F.sin((1 - share) * angle) / F.sin(angle))
    wb = F.when(linear, share).otherwise(F.sin(share * angle) / F.sin(angle))
    return [wa * x + wb * y for x, y in zip(a, near)]


def euler_zyx(q: list[Column]) -> Triple:
    """Yaw, pitch and roll in degrees; at the gimbal lock roll is 0."""
    w, x, y, z = q
    s = F.least(F.greatest(2 * (w * y - z * x), F.lit(-1.0)), F.lit(1.0))
    lock = F.abs(s) > 1 - 1e-9
    yaw = F.when(lock, F.atan2(2 * (w * z - x * y), 1 - 2 * (x * x + z * z))).otherwise(F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)))
    roll = F.when(lock, F.lit(0.0)).otherwise(F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)))
    return F.degrees(yaw), F.degrees(F.asin(s)), F.degrees(roll)


def ground_hit(origin: Triple, ray: Triple, ground: Column, least_cosine: float, most_range: float) -> tuple[Column, Column, Column]:
    """Range, east and north where a ray meets a level ground; null if it looks up, is too flat or too far."""
    n = F.sqrt(ray[0] * ray[0] + ray[1] * ray[1] + ray[2] * ray[2])
    down = F.when(n > 1e-12, -ray[2] / n)
    reach = (origin[2] - ground) / down
    good = (down >= least_cosine) & (reach > 0) & (reach <= most_range)
    r = F.when(good, reach)
    return r, origin[0] + r * ray[0] / n, origin[1] + r * ray[1] / n


def footprint(agl: Column, fov_deg: float) -> Column:
    """Width that a field of view covers on the ground."""
    return 2 * agl * F.tan(F.radians(F.lit(fov_deg / 2)))
