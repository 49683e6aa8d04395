"""Least squares of templates over streams, as grouped sums.

A stream's normal equations are plain sums, so they are added up in every task
before one row per task and stream is shuffled; a detector with most of the samples
is no larger a task than any other.  The small systems are solved by an unrolled
LDL decomposition in expressions, and the coefficients are joined back.  A template
that the earlier ones explain (its pivot falls below ``TOL`` of its square) gets
no coefficient, which leaves the same residual on the samples that were fitted.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.flags import good, raised
from .templates import legendre

TOL = 1e-10


def fitted(mask: int = 7, value: str = "signal") -> Column:
    """Good samples with a finite value."""
    x = F.col(value)
    return good(mask=mask) & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def with_position(df: DataFrame, keys: Sequence[str], *extra: Column) -> DataFrame:
    """Adds __x, a sample's place in its stream from -1 to 1, and aggregates of the stream; ``i`` counts samples."""
    ends = df.groupBy(*keys).agg(F.min("i").alias("__lo"), F.max("i").alias("__hi"), *extra)
    return df.join(ends, list(keys)).withColumn("__x", -1 + (2 * (F.col("i") - F.col("__lo")) + 1) / (F.col("__hi") - F.col("__lo") + 1))


def _step(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """withColumns behind a one-element explode, which keeps the optimizer from writing expressions into each other."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in new.items()]))))


def solved(sums: DataFrame, k: int, tol: float = TOL) -> DataFrame:
    """Adds c0 to c{k-1} and ``least``, the smallest pivot's share: from g{i}_{j} (i >= j) and r{i}."""
    col = F.col
    least = F.lit(1.0)
    for j in range(k):
        d = col(f"g{j}_{j}")
        for m in range(j):
            d = d - col(f"l{j}_{m}") * col(f"l{j}_{m}") * col(f"d{m}")
        sums = _step(sums, {f"d{j}": d})
        inverse = F.when(col(f"d{j}") > tol * col(f"g{j}_{j}"), 1 / col(f"d{j}")).otherwise(0.0)
        z = col(f"r{j}")
        for m in range(j):
            z = z - col(f"l{j}_{m}") * col(f"z{m}")
        new = {f"v{j}": inverse, f"z{j}": z}
        for i in range(j + 1, k):
            e = col(f"g{i}_{j}")
            for m in range(j):
                e = e - col(f"l{i}_{m}") * col(f"l{j}_{m}") * col(f"d{m}")
            new[f"l{i}_{j}"] = e * inverse
        sums = _step(sums, new)
        least = F.least(least, F.when(col(f"g{j}_{j}") > 0, col(f"d{j}") / col(f"g{j}_{j}")).otherwise(0.0))
    for j in reversed(range(k)):
        c = col(f"z{j}") * col(f"v{j}")
        for i in range(j + 1, k):
            c = c - col(f"l{i}_{j}") * col(f"c{i}")
        sums = _step(sums, {f"c{j}": c})
    return _step(sums, {"least": least})


def regress(
    df: DataFrame, basis: Sequence[Column], take: Iterable[int] | None = None, keys: Sequence[str] = ("det",), mask: int = 7, bit: int | None = None, only_good: bool = False
) -> DataFrame:
    """df without the templates numbered in ``take`` (all), fitted jointly on each stream's good samples.

    Streams without a good sample stay as they are, flagged if there is a ``bit``;
    ``only_good``: only good samples are corrected.
    """
    names = df.columns
    k = len(basis)
    d = df.withColumns({f"__t{j}": b for j, b in enumerate(basis)})
    terms = [F.sum(F.col(f"__t{i}") * F.col(f"__t{j}")).alias(f"g{i}_{j}") for i in range(k) for j in range(i + 1)]
    rhs = [F.sum(F.col(f"__t{i}") * F.col("signal")).alias(f"r{i}") for i in range(k)]
    found = solved(d.where(fitted(mask)).groupBy(*keys).agg(*terms, *rhs), k).select(*keys, *[F.col(f"c{j}").alias(f"__c{j}") for j in range(k)])
    got = d.join(found, list(keys), "left")
    model = sum((F.coalesce(f"__c{j}", F.lit(0.0)) * F.col(f"__t{j}") for j in (range(k) if take is None else take)), F.lit(0.0))
    if only_good:
        model = F.when(fitted(mask), model).otherwise(0.0)
    new = {"signal": F.col("signal") - model}
    if bit is not None:
        new["flags"] = raised("flags", F.col("__c0").isNull(), bit)
    return got.withColumns(new).select(*names)


def poly_filter(df: DataFrame, order: int, keys: Sequence[str] = ("det",), mask: int = 7, bit: int = 1) -> DataFrame:
    """Legendre polynomials fitted to good samples and taken from all; a stream without a good sample is flagged."""
    return regress(with_position(df, keys), legendre(F.col("__x"), order), None, keys, mask, bit).select(*df.columns)


def ground_filter(df: DataFrame, trend: int = 5, order: int = 5, az: str = "az", detrend: bool = False, split: str | None = None, keys: Sequence[str] = ("det",), mask: int = 7) -> DataFrame:
    """A joint fit of a trend and of polynomials in azimuth; the azimuth part (and the trend) is subtracted.

    ``split``: a boolean column; both directions then have azimuth polynomials of their own.
    """
    d = with_position(df, keys, F.min(az).alias("__a0"), F.max(az).alias("__a1"))
    span = F.col("__a1") - F.col("__a0")
    d = d.withColumn("__phase", F.when(span != 0, (F.col(az) - F.col("__a0")) / span * 2 - 1).otherwise(0.0))
    low, high = legendre(F.col("__x"), trend)[1:], legendre(F.col("__phase"), order)
    if split:
        high = [F.when(s, p).otherwise(0.0) for s in (F.col(split), ~F.col(split)) for p in high]
    take = None if detrend else range(len(low), len(low) + len(high))
    return regress(d, [*low, *high], take, keys, mask).select(*df.columns)


def harmonics(angle: Column, n: int) -> list[Column]:
    return [f(k * angle) for k in range(1, n + 1) for f in (F.cos, F.sin)]


def hwp_filter(df: DataFrame, angle: str, trend: int = 5, order: int = 5, detrend: bool = False, keys: Sequence[str] = ("det",), mask: int = 7) -> DataFrame:
    """A joint fit of a trend and harmonics of the half-wave plate's angle; the harmonics are subtracted."""
    low, high = legendre(F.col("__x"), trend), harmonics(F.col(angle), order)
    take = None if detrend else range(len(low), len(low) + len(high))
    return regress(with_position(df, keys), [*low, *high], take, keys, mask).select(*df.columns)


def hwpss_model(df: DataFrame, angle: str, n: int = 9, chunk: int | None = None, drift: bool = False, keys: Sequence[str] = ("det",), mask: int = 7, bit: int = 1) -> DataFrame:
    """Subtracts a model of half-wave-plate harmonics (and their linear drift) per chunk; adds its 2f amplitude as ``relcal``.

    A chunk's mean over good samples goes first.  A chunk whose normal matrix is near
    singular (a pivot under 1e-8 of its square) is flagged and left as it is.
    """
    d = with_position(df, keys)
    first = F.floor((F.col("i") - F.col("__lo")) / chunk) if chunk else F.lit(0)
    d = d.withColumn("__chunk", first.cast("long"))
    own = [*keys, "__chunk"]
    if drift and chunk:
        ends = d.groupBy(*own).agg(F.min("i").alias("__clo"), F.max("i").alias("__chi"))
        d = d.join(ends, own).withColumn("__x", -1 + (2 * (F.col("i") - F.col("__clo")) + 1) / (F.col("__chi") - F.col("__clo") + 1))
    basis = harmonics(F.col(angle), n)
    if drift:
        basis += [b * F.col("__x") for b in basis]
    k = len(basis)
    d = d.withColumns({f"__t{j}": b for j, b in enumerate(basis)})
    ok = fitted(mask)
    terms = [F.sum(F.col(f"__t{i}") * F.col(f"__t{j}")).alias(f"g{i}_{j}") for i in range(k) for j in range(i + 1)]
    raw = [F.sum(F.col(f"__t{i}") * F.col("signal")).alias(f"s{i}") for i in range(k)] + [F.sum(f"__t{i}").alias(f"u{i}") for i in range(k)]
    sums = d.where(ok).groupBy(*own).agg(*terms, *raw, F.avg("signal").alias("dc"))
    sums = sums.withColumns({f"r{i}": F.col(f"s{i}") - F.col("dc") * F.col(f"u{i}") for i in range(k)})
    found = solved(sums, k).where("least >= 1e-8").select(*own, F.col("dc").alias("__dc"), *[F.col(f"c{j}").alias(f"__c{j}") for j in range(k)])
    if n >= 2:
        level = found.groupBy(*keys).agg(F.avg(F.sqrt(F.col("__c2") * F.col("__c2") + F.col("__c3") * F.col("__c3"))).alias("__level"))
    else:
        level = found.select(*keys).distinct().withColumn("__level", F.lit(None).cast("double"))
    got = d.join(found, own, "left").join(level, list(keys), "left")
    model = sum((F.col(f"__c{j}") * F.col(f"__t{j}") for j in range(k)), F.col("__dc"))
    missing = F.col("__dc").isNull()
    out = got.withColumns({"signal": F.when(missing, F.col("signal")).otherwise(F.col("signal") - model), "flags": raised("flags", missing, bit), "relcal": F.coalesce("__level", F.lit(float("nan")))})
    return out.select(*df.columns, "relcal")


def poly_filter_2d(df: DataFrame, order: int = 1, group: str = "grp", sample: str = "sample", mask: int = 7, bit: int = 1) -> DataFrame:
    """At each sample and group: x**i y**j over the focal plane (columns x, y) fitted and taken from good detectors."""
    keys = (sample, group)
    means = df.groupBy(*keys).agg(F.avg("x").alias("__mx"), F.avg("y").alias("__my"), F.min("x").alias("__x0"), F.max("x").alias("__x1"), F.min("y").alias("__y0"), F.max("y").alias("__y1"))
    widest = F.greatest(*[F.abs(F.col(f"__{c}{s}") - F.col(f"__m{c}")) for c in "xy" for s in (0, 1)], F.lit(1e-300))
    d = df.join(means, list(keys)).withColumn("__s", 0.999 / widest)
    u, v = (F.col("x") - F.col("__mx")) * F.col("__s"), (F.col("y") - F.col("__my")) * F.col("__s")
    power = lambda c, n: F.lit(1.0) if n == 0 else c if n == 1 else F.pow(c, F.lit(n))
    basis = [power(u, i) * power(v, j) for i in range(order + 1) for j in range(order + 1)]
    return regress(d, basis, None, keys, mask, bit, only_good=True).select(*df.columns)


def filter_bin(df: DataFrame, templates: Sequence[Column], keys: Sequence[str] = ("det",), mask: int = 7, bit: int = 1) -> DataFrame:
    """Regresses a set of templates out of each stream; one without good samples is flagged.  ``__x`` is a sample's place from -1 to 1."""
    return regress(with_position(df, keys), list(templates), None, keys, mask, bit).select(*df.columns)
