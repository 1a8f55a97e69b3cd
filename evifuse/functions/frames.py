"""Axis conventions of vehicles and cameras, as column expressions over quaternions (w, x, y, z).

NED and FRD are north-east-down and forward-right-down, ENU and FLU east-north-up and forward-left-up; optical axes are
right, down, forward. Every change of axes is a fixed rotation, so conversions are quaternion products.
Apply one step to the columns of the step before: normalized steps nested in one expression grow too large to compile.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

from evifuse.functions.geo import Triple, conjugate, normalized, quaternion_product, rotate

#: The rotations between the conventions.
NED_TO_ENU = (0.0, sqrt(0.5), sqrt(0.5), 0.0)
FLU_TO_FRD = (0.0, 1.0, 0.0, 0.0)
OPTICAL_TO_FLU = (0.5, -0.5, 0.5, -0.5)

Quaternion = list[Column]


def _fixed(q: tuple[float, ...]) -> Quaternion:
    return [F.lit(x) for x in q]


def matrix(q: Quaternion) -> list[list[Column]]:
    """Rotation matrix of a unit quaternion, row by row."""
    w, x, y, z = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def from_matrix(m: list[list[Column]]) -> Quaternion:
    """Unit quaternion of a rotation matrix, from the largest of its four squares, so nothing is divided by almost zero."""
    t = [m[0][0], m[1][1], m[2][2]]
    squares = [1 + t[0] + t[1] + t[2], 1 + t[0] - t[1] - t[2], 1 - t[0] + t[1] - t[2], 1 - t[0] - t[1] + t[2]]
    a, b, c = m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1]
    d, e, f = m[0][1] + m[1][0], m[0][2] + m[2][0], m[1][2] + m[2][1]
    scaled = [[squares[0], a, b, c], [a, squares[1], d, e], [b, d, squares[2], f], [c, e, f, squares[3]]]
    greatest = F.greatest(*squares)
    picked = [F.coalesce(*(F.when(squares[k] == greatest, scaled[k][i]) for k in range(4))) for i in range(4)]
    return normalized(picked)


def enu_flu_of(q: Quaternion) -> Quaternion:
    """A NED-to-FRD attitude as the rotation from the body's FLU axes to ENU; of its two signs, either."""
    return quaternion_product(quaternion_product(_fixed(NED_TO_ENU), conjugate(q)), _fixed(FLU_TO_FRD))


def ned_frd_to_enu_flu(q: Quaternion) -> Quaternion:
    """The same with the sign that ``normalized`` gives."""
    return normalized(enu_flu_of(q))


def optical_of(q: Quaternion) -> Quaternion:
    """A FLU-to-ENU rotation as the one from optical axes to ENU; of its two signs, either."""
    return quaternion_product(q, _fixed(OPTICAL_TO_FLU))


def flu_to_optical(q: Quaternion) -> Quaternion:
    """The same with the sign that ``normalized`` gives."""
    return normalized(optical_of(q))


def pixel_ray(u: Column, v: Column, fx: Column, fy: Column, cx: Column, cy: Column, optical: Quaternion) -> Triple:
    """The ray of a pixel in east, north, up; not normalized."""
    return rotate(optical, ((u - cx) / fx, (v - cy) / fy, F.lit(1.0)))


def ground_uncertainty(east_north: tuple[Column, Column], height: Column, slant: Column, sigma_position: Triple, speed: Column, turn: Column,
                       sigma_attitude: Column, sigma_pixel: Column, sigma_calibration: Column, focal: Column, sigma_surface: Column, seconds: Column) -> Column:
    """First-order deviation of a ground point from a level ground, in metres.

    ``east_north`` is the point's distance from the camera, ``height`` the camera's above the ground; position errors grow by
    the speed over the time offset, attitude errors by the turn rate; the vertical error acts by the view's slope.
    """
    across = F.hypot(F.hypot(sigma_position[0], sigma_position[1]), speed * seconds)
    leverage = F.hypot(*east_north) / F.greatest(F.abs(height), F.lit(1e-9))
    vertical = leverage * F.hypot(sigma_position[2], sigma_surface)
    angular = slant * F.hypot(sigma_attitude, turn * seconds)
    image = slant * F.hypot(sigma_pixel, sigma_calibration) / focal
    return F.sqrt(across * across + vertical * vertical + angular * angular + image * image)
