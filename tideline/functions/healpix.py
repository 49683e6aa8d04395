"""HEALPix pixel numbers as column expressions, after Gorski et al. (2005).

Functions take a DataFrame and add a column.  Intermediate values are columns of
their own in a chain of projections, so that expression trees stay small and the
whole chain is one stage of generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ang2vec(theta: Column, phi: Column) -> tuple[Column, Column, Column]:
    s = F.sin(theta)
    return s * F.cos(phi), s * F.sin(phi), F.cos(theta)


def vec2ang(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    phi = F.atan2(y, x)
    return F.atan2(F.sqrt(x * x + y * y), z), F.when(phi < 0, phi + 2 * F.pi()).otherwise(phi)


def _spread(df: DataFrame, c: str) -> DataFrame:
    """Moves bit k of a column to bit 2k."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        df = df.withColumn(c, F.col(c).bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask)))
    return df


def _gather(df: DataFrame, c: str) -> DataFrame:
    """Moves bit 2k of a column to bit k."""
    df = df.withColumn(c, F.col(c).bitwiseAND(F.lit(0x5555555555555555)))
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        df = df.withColumn(c, F.col(c).bitwiseOR(F.shiftright(c, shift)).bitwiseAND(F.lit(mask)))
    return df


def _done(df: DataFrame, out: str, value: Column, drop: tuple[str, ...]) -> DataFrame:
    """Adds the result and drops the intermediate columns.

    The value passes through a one-element explode: a filter on the result then stays
    above it, where otherwise the optimizer would push it down the chain of
    projections and write out every repeated reference.
    """
    keep = [c for c in df.columns if c not in (*drop, out)]
    return df.select(*keep, F.explode(F.array(value)).alias(out))


def _long(c: Column) -> Column:
    return c.cast("long")


def _grid(df: DataFrame, z: Column, phi: Column, nside: int) -> DataFrame:
    """__jp and __jm: the ascending and descending grid lines below a direction; __eq: outside the caps."""
    turn = phi * 2 / F.pi()
    df = df.withColumns({"__z": z, "__tt": turn - 4 * F.floor(turn / 4)})
    df = df.withColumns({"__eq": F.abs("__z") <= 2.0 / 3.0, "__quad": F.least(_long(F.floor("__tt")), F.lit(3))})
    df = df.withColumns({"__tp": F.col("__tt") - F.col("__quad"), "__cap": nside * F.sqrt(3 * (1 - F.abs("__z")))})
    half, tilt = nside * (0.5 + F.col("__tt")), nside * 0.75 * F.col("__z")
    top = F.lit(nside - 1)
    return df.withColumns(
        {
            "__jp": F.when(F.col("__eq"), _long(F.floor(half - tilt))).otherwise(F.least(_long(F.floor(F.col("__tp") * F.col("__cap"))), top)),
            "__jm": F.when(F.col("__eq"), _long(F.floor(half + tilt))).otherwise(F.least(_long(F.floor((1 - F.col("__tp")) * F.col("__cap"))), top)),
        }
    )


_TEMP = ("__z", "__tt", "__eq", "__quad", "__tp", "__cap", "__jp", "__jm")


def ring_pixel(df: DataFrame, z: Column, phi: Column, nside: int, out: str) -> DataFrame:
    df = _grid(df, z, phi, nside)
    jp, jm, eq = F.col("__jp"), F.col("__jm"), F.col("__eq")
    df = df.withColumn("__r", F.when(eq, nside + 1 + jp - jm).otherwise(jp + jm + 1))
    r = F.col("__r")
    along = F.shiftright(jp + jm - nside + 2 - r.bitwiseAND(F.lit(1)), 1)
    ip = F.when(eq, F.pmod(along, F.lit(4 * nside))).otherwise(F.pmod(_long(F.floor(F.col("__tt") * r)), 4 * r))
    df = df.withColumn("__ip", ip)
    north, south = 2 * r * (r - 1) + F.col("__ip"), F.lit(12 * nside * nside) - 2 * r * (r + 1) + F.col("__ip")
    pix = F.when(eq, 2 * nside * (nside - 1) + (r - 1) * 4 * nside + F.col("__ip")).when(F.col("__z") > 0, north).otherwise(south)
    return _done(df, out, _long(pix), (*_TEMP, "__r", "__ip"))


def nest_pixel(df: DataFrame, z: Column, phi: Column, nside: int, out: str) -> DataFrame:
    df = _grid(df, z, phi, nside)
    k = nside.bit_length() - 1
    jp, jm, eq, north = F.col("__jp"), F.col("__jm"), F.col("__eq"), F.col("__z") > 0
    df = df.withColumns({"__fp": F.shiftright(jp, k), "__fm": F.shiftright(jm, k)})
    fp, fm = F.col("__fp"), F.col("__fm")
    belt = F.when(fp == fm, fp.bitwiseAND(F.lit(3)) + 4).when(fp < fm, fp).otherwise(fm + 8)
    top = nside - 1
    low = lambda c: c.bitwiseAND(F.lit(top))
    df = df.withColumns(
        {
            "__face": F.when(eq, belt).when(north, F.col("__quad")).otherwise(F.col("__quad") + 8),
            "__x": _long(F.when(eq, low(jm)).when(north, top - jm).otherwise(jp)),
            "__y": _long(F.when(eq, top - low(jp)).when(north, top - jp).otherwise(jm)),
        }
    )
    df = _spread(_spread(df, "__x"), "__y")
    pix = F.col("__x") + F.shiftleft("__y", 1) + F.shiftleft(_long(F.col("__face")), 2 * k)
    return _done(df, out, pix, (*_TEMP, "__fp", "__fm", "__face", "__x", "__y"))


def ang_pixel(df: DataFrame, theta: Column, phi: Column, nside: int, out: str = "pixel", nest: bool = True) -> DataFrame:
    return (nest_pixel if nest else ring_pixel)(df, F.cos(theta), phi, nside, out)


def vec_pixel(df: DataFrame, x: Column, y: Column, z: Column, nside: int, out: str = "pixel", nest: bool = True) -> DataFrame:
    return (nest_pixel if nest else ring_pixel)(df, z / F.sqrt(x * x + y * y + z * z), F.atan2(y, x), nside, out)


def _place(face: Column) -> tuple[Column, Column]:
    """Rows (in units of nside) and eighths of a turn at which base pixels have their lowest corner and centre."""
    return F.floor(face / 4) + 2, 2 * (face % 4) + F.when(F.floor(face / 4) == 1, 0).otherwise(1)


def nest_to_ring(df: DataFrame, pix: str, nside: int, out: str) -> DataFrame:
    k = nside.bit_length() - 1
    rest = F.col(pix).bitwiseAND(F.lit(nside * nside - 1))
    df = df.withColumns({"__face": F.shiftright(pix, 2 * k), "__x": rest, "__y": F.shiftright(rest, 1)})
    df = _gather(_gather(df, "__x"), "__y")
    row, turn = _place(F.col("__face"))
    df = df.withColumns({"__jr": row * nside - F.col("__x") - F.col("__y") - 1, "__turn": turn})
    jr = F.col("__jr")
    north, south = jr < nside, jr > 3 * nside
    df = df.withColumns({"__nr": F.when(north, jr).when(south, 4 * nside - jr).otherwise(nside), "__sh": F.when(north | south, 0).otherwise((jr - nside).bitwiseAND(F.lit(1)))})
    nr = F.col("__nr")
    before = F.when(north, 2 * nr * (nr - 1)).when(south, 12 * nside * nside - 2 * (nr + 1) * nr).otherwise(2 * nside * (nside - 1) + (jr - nside) * 4 * nside)
    jp = F.shiftright(_long(F.col("__turn") * nr + F.col("__x") - F.col("__y") + 1 + F.col("__sh")), 1)
    df = df.withColumns({"__jp": F.pmod(jp - 1, F.lit(4 * nside)), "__before": before})
    return _done(df, out, _long(F.col("__before") + F.col("__jp")), ("__face", "__x", "__y", "__jr", "__turn", "__nr", "__sh", "__jp", "__before"))


def _isqrt(c: Column) -> Column:
    s = _long(F.floor(F.sqrt(c.cast("double"))))
    return F.when(s * s > c, s - 1).when((s + 1) * (s + 1) <= c, s + 1).otherwise(s)


def ring_to_nest(df: DataFrame, pix: str, nside: int, out: str) -> DataFrame:
    p, cap, total, k = F.col(pix), 2 * nside * (nside - 1), 12 * nside * nside, nside.bit_length() - 1
    north, south = p < cap, p >= total - cap
    end = total - p
    df = df.withColumn("__i", F.when(north, F.shiftright(1 + _isqrt(1 + 2 * p), 1)).when(south, F.shiftright(1 + _isqrt(2 * end - 1), 1)).otherwise(F.floor((p - cap) / (4 * nside)) + nside))
    i = F.col("__i")
    df = df.withColumns(
        {
            "__phi": F.when(north, p + 1 - 2 * i * (i - 1)).when(south, 4 * i + 1 - (end - 2 * i * (i - 1))).otherwise((p - cap) % (4 * nside) + 1),
            "__nr": F.when(north | south, i).otherwise(nside),
            "__sh": F.when(north | south, 0).otherwise((i + nside).bitwiseAND(F.lit(1))),
        }
    )
    phi, nr = F.col("__phi"), F.col("__nr")
    ire = i - nside + 1
    div = lambda a, n: F.floor(a / n)
    fm, fp = div(phi - div(ire, 2) + nside - 1, nside), div(phi - div(2 * nside + 2 - ire, 2) + nside - 1, nside)
    belt = F.when(fp == fm, fp.bitwiseAND(F.lit(3)) + 4).when(fp < fm, fp).otherwise(fm + 8)
    df = df.withColumn("__face", _long(F.when(north, div(phi - 1, nr)).when(south, 8 + div(phi - 1, nr)).otherwise(belt)))
    df = df.withColumn("__ring", F.when(south, 4 * nside - i).otherwise(i))
    row, turn = _place(F.col("__face"))
    df = df.withColumns({"__r": _long(F.col("__ring") - row * nside + 1), "__p": _long(2 * phi - turn * nr - F.col("__sh") - 1)})
    df = df.withColumn("__p", F.when(F.col("__p") >= 2 * nside, F.col("__p") - 8 * nside).otherwise(F.col("__p")))
    df = df.withColumns({"__x": F.shiftright(F.col("__p") - F.col("__r"), 1), "__y": F.shiftright(-(F.col("__p") + F.col("__r")), 1)})
    df = _spread(_spread(df, "__x"), "__y")
    pixel = F.col("__x") + F.shiftleft("__y", 1) + F.shiftleft("__face", 2 * k)
    return _done(df, out, pixel, ("__i", "__phi", "__nr", "__sh", "__face", "__ring", "__r", "__p", "__x", "__y"))


def degrade_nest(pix: Column, factor: int) -> Column:
    return F.shiftright(pix, 2 * (factor.bit_length() - 1))


def upgrade_nest(pix: Column, factor: int) -> Column:
    return F.shiftleft(pix, 2 * (factor.bit_length() - 1))


def degrade_ring(df: DataFrame, pix: str, nside: int, factor: int, out: str) -> DataFrame:
    df = ring_to_nest(df, pix, nside, "__n").withColumn("__n", degrade_nest(F.col("__n"), factor))
    return nest_to_ring(df, "__n", nside // factor, out).drop("__n")


def upgrade_ring(df: DataFrame, pix: str, nside: int, factor: int, out: str) -> DataFrame:
    df = ring_to_nest(df, pix, nside, "__n").withColumn("__n", upgrade_nest(F.col("__n"), factor))
    return nest_to_ring(df, "__n", nside * factor, out).drop("__n")


def _ring_facts(ring: Column, nside: int) -> dict[str, Column]:
    """Colatitude, first pixel, number of pixels and half-pixel shift of a ring (1 to 4 nside - 1)."""
    north = F.when(ring > 2 * nside, 4 * nside - ring).otherwise(ring)
    cap = north < nside
    z = F.when(cap, 1 - north * north / (3.0 * nside * nside)).otherwise((2 * nside - north) * 2 / (3.0 * nside))
    size = F.when(cap, 4 * north).otherwise(4 * nside)
    first = F.when(cap, 2 * north * (north - 1)).otherwise(2 * nside * (nside - 1) + (north - nside) * 4 * nside)
    south = north != ring
    shift = F.when(cap | ((north - nside).bitwiseAND(F.lit(1).cast("long")) == 0), 0.5).otherwise(0.0)
    return {"theta": F.when(south, F.pi() - F.acos(z)).otherwise(F.acos(z)), "first": F.when(south, 12 * nside * nside - first - size).otherwise(first), "size": size, "shift": shift}


def interpolation(df: DataFrame, theta: Column, phi: Column, nside: int, out: str = "near") -> DataFrame:
    """Adds ``out``: the four pixels (ring order) around a direction with their bilinear weights.

    Two pixels of the ring above and two of the ring below, linear in longitude on each and in colatitude
    between them; beyond the first and last ring the four polar pixels share the pole's weight.
    """
    z = F.cos(theta)
    cap = _long(F.floor(nside * F.sqrt(3 * (1 - F.abs(z)))))
    above = F.when(F.abs(z) <= 2.0 / 3.0, _long(F.floor(nside * (2 - 1.5 * z)))).when(z > 0, cap).otherwise(4 * nside - cap - 1)
    df = df.withColumns({"__th": theta, "__ph": F.pmod(phi, 2 * F.pi()), "__up": above})
    for s, ring in (("a", F.greatest(F.col("__up"), F.lit(1))), ("b", F.least(F.col("__up") + 1, F.lit(4 * nside - 1)))):
        df = df.withColumns({f"__{s}{k}": v for k, v in _ring_facts(ring, nside).items()})
        step = F.col("__ph") * F.col(f"__{s}size") / (2 * F.pi()) - F.col(f"__{s}shift")
        df = df.withColumn(f"__{s}at", step)
        low = _long(F.floor(f"__{s}at"))
        df = df.withColumns({f"__{s}0": _long(F.col(f"__{s}first") + F.pmod(low, F.col(f"__{s}size"))), f"__{s}1": _long(F.col(f"__{s}first") + F.pmod(low + 1, F.col(f"__{s}size"))), f"__{s}w": F.col(f"__{s}at") - low})
    top, bottom = F.col("__up") == 0, F.col("__up") == 4 * nside - 1
    share = F.when(top, F.col("__th") / F.col("__btheta")).when(bottom, (F.col("__th") - F.col("__atheta")) / (F.pi() - F.col("__atheta"))).otherwise((F.col("__th") - F.col("__atheta")) / (F.col("__btheta") - F.col("__atheta")))
    df = df.withColumn("__s", share)
    s, pole, last = F.col("__s"), F.lit(0.25), 12 * nside * nside - 4
    # At a cap the ring beyond the pole is the same ring, seen from its other side.
    over = lambda c: (F.col(c) + 2).bitwiseAND(F.lit(3).cast("long"))
    upper = [(F.when(top, over(f"__b{k}")).otherwise(F.col(f"__a{k}")), F.when(top, (1 - s) * pole).otherwise((1 - s) * w) + F.when(bottom, s * pole).otherwise(0.0)) for k, w in ((0, 1 - F.col("__aw")), (1, F.col("__aw")))]
    lower = [(F.when(bottom, over(f"__a{k}") + last).otherwise(F.col(f"__b{k}")), F.when(bottom, s * pole).otherwise(s * w) + F.when(top, (1 - s) * pole).otherwise(0.0)) for k, w in ((0, 1 - F.col("__bw")), (1, F.col("__bw")))]
    near = F.array(*[F.struct(p.alias("pixel"), w.alias("w")) for p, w in (*upper, *lower)])
    return _done(df, out, near, ("__th", "__ph", "__up", "__s", *[f"__{r}{k}" for r in "ab" for k in ("theta", "first", "size", "shift", "at", "0", "1", "w")]))
