"""Scalar formulas of the instrument and the sky."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .quaternion import Quat, Vec, cross, dot, of, rotate

#: CMB temperature (K), speed of light (km/s), Planck and Boltzmann constants.
T_CMB, C_KMS, H_PLANCK, K_BOLTZ = 2.72548, 299792.458, 6.62607015e-34, 1.380649e-23


def stokes_weights(q: Quat, eps: Column | float = 0.0, cal: Column | float = 1.0, hwp: Column | None = None, gamma: Column | float = 0.0, iau: bool = False) -> Vec:
    """I, Q and U weights of a detector quaternion, with a half-wave plate's angle if there is one."""
    eps, cal, gamma = of((eps, cal, gamma))
    d, o = rotate(q, of((0, 0, 1))), rotate(q, of((1, 0, 0)))
    phi = F.atan2(d[1], d[0])
    m = (d[2] * F.cos(phi), d[2] * F.sin(phi), -F.sqrt(F.greatest(F.lit(0.0), 1 - d[2] * d[2])))
    alpha = F.atan2(dot(cross(m, o), d), dot(m, o))
    eta = (1 - eps) / (1 + eps)
    angle = 2 * alpha if hwp is None else 2 * (2 * (gamma - hwp) - alpha)
    sign = (1.0 if hwp is None else -1.0) * (-1.0 if iau else 1.0)
    return cal, cal * eta * F.cos(angle), sign * cal * eta * F.sin(angle)


def add_velocities(u: Vec, v: Vec) -> Vec:
    """The relativistic sum of two velocities in km/s."""
    uv = dot(u, v) / (C_KMS * C_KMS)
    g = 1 / F.sqrt(1 - dot(u, u) / (C_KMS * C_KMS))
    return tuple((1 / (1 + uv)) * (u[k] + v[k] / g + (g / (1 + g)) * uv * u[k]) for k in range(3))


def dipole(direction: Vec, velocity: Vec, temperature: float = T_CMB, freq: float = 0.0) -> Column:
    """Temperature shift towards a unit vector for an observer's velocity (km/s)."""
    beta = tuple(c / C_KMS for c in velocity)
    along = dot(beta, direction)
    if freq <= 0:
        return temperature * (F.sqrt(1 - dot(beta, beta)) / (1 - along) - 1)
    x = H_PLANCK * freq / (K_BOLTZ * temperature)
    e = F.exp(F.lit(x))
    return temperature * (along + (x / 2) * (e + 1) / (e - 1) * along * along)


def noise_psd(freq: Column, net: Column, fknee: Column, fmin: Column, alpha: Column) -> Column:
    top = F.pow(freq, alpha) + F.pow(fknee, alpha)
    return net * net * top / (F.pow(freq, alpha) + F.pow(fmin, alpha))


def detector_weight(net: Column, rate: float) -> Column:
    return F.when(net > 0, 1 / (net * net * rate)).otherwise(0.0)


def simpson(values: str, step: float) -> Column:
    """The integral of an array of samples by Simpson's rule (trapezium for a last odd interval)."""
    n = F.size(values)
    even = F.when(n % 2 == 1, n).otherwise(n - 1)
    v = F.slice(values, F.lit(1), even)
    weight = lambda x, i: x * F.when((i == 0) | (i == even - 1), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    body = F.aggregate(F.transform(v, weight), F.lit(0.0), lambda a, x: a + x) * step / 3
    tail = F.when(n % 2 == 0, (F.element_at(values, -1) + F.element_at(values, -2)) * step / 2).otherwise(0.0)
    return F.when(n > 2, body + tail).when(n == 2, tail).otherwise(0.0)
