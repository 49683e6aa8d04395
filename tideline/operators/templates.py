"""Templates of a destriper: projections M^T d, and their addition M a.

Each template maps samples to amplitude rows (template key, value of the template
there), so projecting is a grouped sum and adding is a join on the same key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.flags import good


@dataclass(frozen=True)
class Offset:
    """A step per ``step`` samples of each detector; steps with too few good samples are left at zero."""

    step: int
    good_fraction: float = 0.5
    mask: int = 7

    def key(self) -> Column:
        return F.floor(F.col("i") / self.step).cast("long").alias("amp")

    def hits(self, df: DataFrame) -> DataFrame:
        n = F.sum(F.when(good(mask=self.mask), 1).otherwise(0))
        return df.groupBy("det", self.key()).agg(n.alias("n_good"), F.count(F.lit(1)).alias("n"), (n <= self.good_fraction * F.count(F.lit(1))).alias("flagged"))

    def project(self, df: DataFrame, value: str = "signal") -> DataFrame:
        return df.where(good(mask=self.mask)).groupBy("det", self.key()).agg(F.sum(value).alias("value"))

    def add(self, df: DataFrame, amps: DataFrame, value: str = "signal", sign: float = 1.0) -> DataFrame:
        out = df.withColumn("amp", self.key()).join(amps.select("det", "amp", F.col("value").alias("__a")), ["det", "amp"], "left")
        return out.withColumn(value, F.col(value) + sign * F.coalesce("__a", F.lit(0.0))).drop("__a", "amp")

    def precondition(self, amps: DataFrame, hits: DataFrame) -> DataFrame:
        """Amplitudes over the good samples of their step; flagged steps to zero."""
        h = hits.select("det", "amp", F.col("n_good").alias("__n"), F.col("flagged").alias("__f"))
        return amps.join(h, ["det", "amp"]).withColumn("value", F.when(F.col("__f"), 0.0).otherwise(F.col("value") / F.col("__n"))).drop("__n", "__f")


@dataclass(frozen=True)
class Periodic:
    """Bins of ``width`` of a column, counted from its least value over good samples."""

    column: str
    width: float
    least: float
    minimum_hits: int = 3
    mask: int = 7

    def key(self) -> Column:
        return F.floor((F.col(self.column) - self.least) / self.width).cast("long").alias("amp")

    def project(self, df: DataFrame, value: str = "signal") -> DataFrame:
        out = df.where(good(mask=self.mask)).groupBy("det", self.key()).agg(F.sum(value).alias("value"), F.count(F.lit(1)).alias("n"))
        return out.where(F.col("n") >= self.minimum_hits).drop("n")

    add = Offset.add


def legendre(x: Column, order: int) -> list[Column]:
    """P_0 to P_order of x, by their recurrence."""
    p = [F.lit(1.0), x]
    for n in range(1, order):
        p.append(((2 * n + 1) * x * p[n] - n * p[n - 1]) / (n + 1))
    return p[: order + 1]


@dataclass(frozen=True)
class SubHarmonic:
    """Legendre polynomials over each view: amplitudes are numbered by order."""

    order: int
    keys: Sequence[str] = ("det", "view")
    mask: int = 7

    def _x(self) -> Column:
        return F.lit(-1.0) + (2 * (F.col("i") - F.col("first")) + 1) / (F.col("last") - F.col("first"))

    def project(self, df: DataFrame, value: str = "signal") -> DataFrame:
        """df has first and last of the sample's view."""
        terms = [F.struct(F.lit(k).alias("amp"), F.sum(p * F.col(value)).alias("value")) for k, p in enumerate(legendre(self._x(), self.order))]
        return df.where(good(mask=self.mask)).groupBy(*self.keys).agg(F.array(*terms).alias("a")).select(*self.keys, F.inline("a"))

    def add(self, df: DataFrame, amps: DataFrame, value: str = "signal", sign: float = 1.0) -> DataFrame:
        wide = amps.groupBy(*self.keys).agg(*[F.max(F.when(F.col("amp") == k, F.col("value"))).alias(f"__a{k}") for k in range(self.order + 1)])
        model = sum((F.coalesce(f"__a{k}", F.lit(0.0)) * p for k, p in enumerate(legendre(self._x(), self.order))), F.lit(0.0))
        return df.join(wide, list(self.keys), "left").withColumn(value, F.col(value) + sign * model).drop(*[f"__a{k}" for k in range(self.order + 1)])


@dataclass(frozen=True)
class Fourier2D:
    """Fourier modes over the focal plane at each sample: df has the detector's x and y."""

    order: int
    radius: float = 1.0
    mask: int = 7

    def modes(self) -> list[Column]:
        out = [F.lit(1.0)]
        for k in range(1, self.order + 1):
            for j in range(1, self.order + 1):
                ax, ay = k * F.pi() * F.col("x") / self.radius, j * F.pi() * F.col("y") / self.radius
                out += [f(ax) * g(ay) for f in (F.cos, F.sin) for g in (F.cos, F.sin)]
        return out

    def project(self, df: DataFrame, value: str = "signal") -> DataFrame:
        terms = [F.struct(F.lit(k).alias("amp"), F.sum(m * F.col(value)).alias("value")) for k, m in enumerate(self.modes())]
        return df.where(good(mask=self.mask)).groupBy("sample").agg(F.array(*terms).alias("a")).select("sample", F.inline("a"))


@dataclass(frozen=True)
class Gain:
    """Legendre polynomials in time of a detector's gain on a signal column (a scanned map)."""

    order: int
    model: str = "model"
    mask: int = 7

    def project(self, df: DataFrame, value: str = "signal") -> DataFrame:
        """df has first and last of the detector's samples."""
        x = F.lit(-1.0) + (2 * (F.col("i") - F.col("first")) + 1) / (F.col("last") - F.col("first"))
        terms = [F.struct(F.lit(k).alias("amp"), F.sum(p * F.col(self.model) * F.col(value)).alias("value")) for k, p in enumerate(legendre(x, self.order))]
        return df.where(good(mask=self.mask)).groupBy("det").agg(F.array(*terms).alias("a")).select("det", F.inline("a"))
