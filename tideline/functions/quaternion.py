"""Quaternions (x, y, z, w) as tuples of four columns, w last.

Each function is one step.  Chained steps repeat their inputs, so put the result
of one into columns of its own (``select``) before the next.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Quat = tuple[Column, Column, Column, Column]
Vec = tuple[Column, Column, Column]


def of(values: Sequence) -> tuple:
    return tuple(v if isinstance(v, Column) else F.lit(float(v)) for v in values)


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return reduce(Column.__add__, [x * y for x, y in zip(a, b, strict=True)])


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def inv(q: Quat) -> Quat:
    return -q[0], -q[1], -q[2], q[3]


def amplitude(q: Quat) -> Column:
    return F.sqrt(dot(q, q))


def norm(q: Quat) -> Quat:
    a = amplitude(q)
    return tuple(c / a for c in q)


def mult(p: Quat, q: Quat) -> Quat:
    """The Hamilton product: vector part pw qv + qw pv + pv x qv, scalar part pw qw - pv . qv."""
    v = cross(p[:3], q[:3])
    return *(p[3] * q[k] + q[3] * p[k] + v[k] for k in range(3)), p[3] * q[3] - dot(p[:3], q[:3])


def rotate(q: Quat, v: Vec) -> Vec:
    """v + 2w (u x v) + 2 u x (u x v) for a unit quaternion (u, w)."""
    t = cross(q[:3], v)
    s = cross(q[:3], t)
    return tuple(v[k] + 2 * (q[3] * t[k] + s[k]) for k in range(3))


def rotation(axis: Vec, angle: Column) -> Quat:
    s = F.sin(angle / 2)
    return axis[0] * s, axis[1] * s, axis[2] * s, F.cos(angle / 2)


from_axisangle = rotation


def to_axisangle(q: Quat) -> tuple[Vec, Column]:
    """Axis and angle; the z axis and 0 for no rotation."""
    angle = 2 * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q[3])))
    s = F.sin(angle / 2)
    tiny = F.abs(s) < 1e-12
    return tuple(F.when(tiny, float(k == 2)).otherwise(q[k] / s) for k in range(3)), F.when(tiny, 0.0).otherwise(angle)


def exp(q: Quat) -> Quat:
    n = F.sqrt(dot(q[:3], q[:3]))
    e = F.exp(q[3])
    s = F.when(n == 0, 0.0).otherwise(e * F.sin(n) / n)
    return q[0] * s, q[1] * s, q[2] * s, e * F.cos(n)


def ln(q: Quat) -> Quat:
    a, n = amplitude(q), F.sqrt(dot(q[:3], q[:3]))
    s = F.when(n == 0, 0.0).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q[3] / a))) / n)
    return q[0] * s, q[1] * s, q[2] * s, F.log(a)


def power(q: Quat, p: Column) -> Quat:
    return exp(tuple(c * p for c in ln(q)))


def to_rotmat(q: Quat) -> tuple[Column, ...]:
    """Nine entries, row by row: the columns are the rotated unit vectors."""
    cols = [rotate(q, of([float(k == j) for k in range(3)])) for j in range(3)]
    return tuple(cols[j][i] for i in range(3) for j in range(3))


def from_rotmat(m: Sequence[Column]) -> Quat:
    """The largest of the four components is found first, the others from it."""
    d = [m[0], m[4], m[8]]
    trace = d[0] + d[1] + d[2]
    sizes = [F.sqrt(F.greatest(F.lit(0.0), 1 + 2 * d[k] - trace)) / 2 for k in range(3)] + [F.sqrt(F.greatest(F.lit(0.0), 1 + trace)) / 2]
    off = {(0, 1): m[1] + m[3], (0, 2): m[2] + m[6], (1, 2): m[5] + m[7]}
    skew = [m[7] - m[5], m[2] - m[6], m[3] - m[1]]

    def given(k: int) -> list[Column]:
        if k == 3:
            return [s / (4 * sizes[3]) for s in skew] + [sizes[3]]
        vec = [sizes[k] if j == k else off[min(j, k), max(j, k)] / (4 * sizes[k]) for j in range(3)]
        return vec + [skew[k] / (4 * sizes[k])]

    most = F.greatest(*sizes)
    out = []
    for j in range(4):
        c = given(2)[j]
        for k in (1, 0, 3):
            c = F.when(sizes[k] >= most, given(k)[j]).otherwise(c)
        out.append(c)
    return tuple(out)


def from_vectors(a: Vec, b: Vec) -> Quat:
    """The least rotation that takes the direction of a to that of b."""
    return norm((*cross(a, b), F.sqrt(dot(a, a) * dot(b, b)) + dot(a, b)))


def from_iso_angles(theta: Column, phi: Column, psi: Column) -> Quat:
    """Turns of psi about z, theta about y and phi about z, multiplied out."""
    s, c, half, diff = F.sin(theta / 2), F.cos(theta / 2), (phi + psi) / 2, (phi - psi) / 2
    return -s * F.sin(diff), s * F.cos(diff), c * F.sin(half), c * F.cos(half)


def to_iso_angles(q: Quat) -> tuple[Column, Column, Column]:
    """theta, phi and psi in (-pi, pi]; at the poles phi is 0."""
    d, o = rotate(q, of((0, 0, 1))), rotate(q, of((1, 0, 0)))
    pole = F.abs(d[2]) > 1 - 1e-12
    phi = F.when(pole, 0.0).otherwise(F.atan2(d[1], d[0]))
    theta = F.when(pole, F.when(d[2] > 0, 0.0).otherwise(F.pi())).otherwise(F.pi() / 2 - F.asin(d[2]))
    m = (d[2] * F.cos(phi), d[2] * F.sin(phi), -F.sqrt(F.greatest(F.lit(0.0), 1 - d[2] * d[2])))
    psi = F.atan2(dot(cross(m, o), d), dot(m, o))
    at_pole = F.when(d[2] > 0, F.atan2(o[1], o[0])).otherwise(F.atan2(o[1], -o[0]))
    return theta, phi, F.when(pole, at_pole).otherwise(psi)


def from_lonlat_angles(lon: Column, lat: Column, psi: Column) -> Quat:
    return from_iso_angles(F.pi() / 2 - lat, lon, psi)


def to_lonlat_angles(q: Quat) -> tuple[Column, Column, Column]:
    theta, phi, psi = to_iso_angles(q)
    return phi, F.pi() / 2 - theta, psi


def from_angles(theta: Column, phi: Column, pa: Column, iau: bool = False) -> Quat:
    """From a position and a position angle measured from the meridian, eastward if ``iau``."""
    return from_iso_angles(theta, phi, F.pi() - pa if iau else pa)


def to_angles(q: Quat, iau: bool = False) -> tuple[Column, Column, Column]:
    theta, phi, psi = to_iso_angles(q)
    return theta, phi, F.pi() - psi if iau else psi


def from_position(theta: Column, phi: Column) -> Quat:
    return from_iso_angles(theta, phi, F.lit(0.0))


def to_position(q: Quat) -> tuple[Column, Column]:
    return to_iso_angles(q)[:2]


def slerp(t: Column, t0: Column, q0: Quat, t1: Column, q1: Quat) -> Quat:
    """Between two quaternions at t0 and t1; near-equal ones give the first."""
    f = (t - t0) / (t1 - t0)
    c = dot(q0, q1)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))
    s = F.sin(angle)
    a, b = F.sin((1 - f) * angle) / s, F.sin(f * angle) / s
    near = F.abs(c - 1) < 1e-10
    return norm(tuple(F.when(near, x).otherwise(a * x + b * y) for x, y in zip(q0, q1, strict=True)))


#: Fixed values (degrees): the J2000 frame's obliquity, the galactic pole and the longitude of the celestial pole.
OBLIQUITY = 23.439291111
POLE_RA, POLE_DEC, POLE_LON = 192.85948, 27.12825, 122.93192


def _numbers(*turns: tuple[int, float]) -> tuple[float, ...]:
    """Rotations about axes (0 to 2) by degrees, the last one first, as plain numbers."""
    out = (0.0, 0.0, 0.0, 1.0)
    for axis, degrees in turns:
        h = math.radians(degrees) / 2
        q = [0.0, 0.0, 0.0, math.cos(h)]
        q[axis] = math.sin(h)
        (a, b, c, d), (x, y, z, w) = out, q
        out = (d * x + w * a + b * z - c * y, d * y + w * b + c * x - a * z, d * z + w * c + a * y - b * x, d * w - a * x - b * y - c * z)
    return out


#: Rotations between equatorial, ecliptic and galactic coordinates.
EQU2ECL = _numbers((0, -OBLIQUITY))
#: The z axis to the galactic pole, longitudes counted from the galactic centre.
EQU2GAL = _numbers((2, POLE_LON - 180.0), (1, POLE_DEC - 90.0), (2, -POLE_RA))
ECL2GAL = _numbers((2, POLE_LON - 180.0), (1, POLE_DEC - 90.0), (2, -POLE_RA), (0, OBLIQUITY))


def equ2ecl() -> Quat:
    return of(EQU2ECL)


def equ2gal() -> Quat:
    return of(EQU2GAL)


def ecl2gal() -> Quat:
    return of(ECL2GAL)
