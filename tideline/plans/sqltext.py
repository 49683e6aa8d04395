"""SQL text for the oracles of least squares and of Fourier filters."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

GOOD = "(flags & 7) = 0"


def legendre(x: str, order: int) -> list[str]:
    p = ["1.0::double", x]
    for n in range(1, order):
        p.append(f"(({2 * n + 1} * {x} * ({p[n]}) - {n} * ({p[n - 1]})) / {n + 1})")
    return p[: order + 1]


def harmonics(angle: str, n: int) -> list[str]:
    return [f"{f}({k} * ({angle}))" for k in range(1, n + 1) for f in ("cos", "sin")]


def chained(source: str, steps: Sequence[Sequence[str]]) -> str:
    """source with further columns, a subquery a step, so that no engine writes out what a name stands for."""
    for items in steps:
        source = f"(select *, {', '.join(items)} from {source})"
    return source


def ldl(source: str, k: int, tol: float = 1e-10) -> str:
    """source with the solution c{j} of its normal equations g{i}_{j}, r{i}."""
    steps: list[list[str]] = []
    for j in range(k):
        steps.append([f"g{j}_{j}" + "".join(f" - l{j}_{m} * l{j}_{m} * d{m}" for m in range(j)) + f" as d{j}"])
        steps.append([f"case when d{j} > {tol} * g{j}_{j} then 1 / d{j} else 0.0 end as v{j}"])
        new = ["(" + f"g{i}_{j}" + "".join(f" - l{i}_{m} * l{j}_{m} * d{m}" for m in range(j)) + f") * v{j} as l{i}_{j}" for i in range(j + 1, k)]
        steps.append([*new, f"r{j}" + "".join(f" - l{j}_{m} * z{m}" for m in range(j)) + f" as z{j}"])
    for j in reversed(range(k)):
        steps.append([f"z{j} * v{j}" + "".join(f" - l{i}_{j} * c{i}" for i in range(j + 1, k)) + f" as c{j}"])
    least = ", ".join(f"case when g{j}_{j} > 0 then d{j} / g{j}_{j} else 0 end" for j in range(k))
    return chained(source, [*steps, [f"least({least}) as least_pivot"]])


def fit(src: str, basis: Sequence[str], keys: str = "det", value: str = "signal") -> str:
    """CTEs ``v`` (src with its templates t{j}) and ``c`` (coefficients by keys)."""
    k = len(basis)
    sums = ", ".join([f"sum(t{i} * t{j}) as g{i}_{j}" for i in range(k) for j in range(i + 1)] + [f"sum(t{i} * {value}) as r{i}" for i in range(k)])
    templates = ", ".join(f"{b} as t{j}" for j, b in enumerate(basis))
    return f""",
v as materialized (select *, {templates} from {src}),
f as materialized (select {keys}, {sums} from v where {GOOD} group by {keys}),
c as materialized (select {keys}, {', '.join(f'c{j}' for j in range(k))}, least_pivot from {ldl('f', k)})
"""


def model(take: Iterable[int]) -> str:
    return "(" + " + ".join(f"coalesce(c{j} * t{j}, 0)" for j in take) + ")"


#: The stream with a sample's place from -1 to 1.
PLACED = """,
u as (select *, -1 + (2 * (i - min(i) over (partition by det)) + 1) / (max(i) over (partition by det) - min(i) over (partition by det) + 1)::double as x from s0)
"""


def convolution(src: str, out: str, real: str, imaginary: str = "0", rate: float = 10.0) -> str:
    """CTE ``out``(det, i, v): src(det, i, v) through a filter of frequency ``fr``, mirrored to a power of two and continued by its first value."""
    p = f"{out}_"
    return f""",
{p}n as (select det, count(*) as n, pow(2, floor(log2(2 * count(*) - 1)) + 1)::bigint as size, min_by(v, i) as v0 from {src} group by det),
{p}p as (
  select det, i as j, v from {src} union all select det, 2 * n - 1 - i, v from {src} join {p}n using (det)
  union all select det, unnest(range(2 * n, size)), v0 from {p}n),
{p}k as (select det, size, unnest(range(0, size // 2 + 1)) as k from {p}n),
{p}f as (
  select det, k, any_value(size) as size, any_value(k * {rate}::double / size) as fr, sum(v * cos(2 * pi() * ((j * k) % size) / size)) as re, -sum(v * sin(2 * pi() * ((j * k) % size) / size)) as im
  from {p}k join {p}p using (det) group by det, k),
{p}g as (select *, {real} as kr, {imaginary} as ki from {p}f),
{p}h as (select det, k, size, re * kr - im * ki as re, re * ki + im * kr as im from {p}g),
{out} as (
  select det, i, sum(case when k = 0 or 2 * k = size then re * cos(2 * pi() * ((i * k) % size) / size) else 2 * (re * cos(2 * pi() * ((i * k) % size) / size) - im * sin(2 * pi() * ((i * k) % size) / size)) end) / any_value(size) as v
  from {src} join {p}h using (det) group by det, i)
"""


def clipped(columns: Sequence[str], limit: float, passes: int = 12) -> str:
    """CTEs p0 .. from ``stats``: passes of sigma clipping, more than are ever needed on each column."""
    out, n = ",\np0 as materialized (select * from stats)", 0
    for c in columns:
        for _ in range(passes):
            out += f",\np{n + 1} as materialized (select * from p{n} where abs({c} - (select median({c}) from p{n})) <= {limit} * (select stddev_pop({c}) from p{n}))"
            n += 1
    return out + f"\nselect * from p{n}"


def quaternion(source: str, steps: Sequence[tuple[int, str]]) -> str:
    """source with q{s}0 .. q{s}3, the product of rotations about axes by angles up to step s, starting from none."""
    now, out = ("0.0::double", "0.0::double", "0.0::double", "1.0::double"), []
    for s, (axis, angle) in enumerate(steps):
        out.append([f"sin(({angle}) / 2) as sn{s}", f"cos(({angle}) / 2) as cs{s}"])
        q = ["0.0", "0.0", "0.0", f"cs{s}"]
        q[axis] = f"sn{s}"
        (a, b, c, d), (x, y, z, w) = now, q
        out.append([
            f"{d} * {x} + {w} * {a} + {b} * {z} - {c} * {y} as q{s}0", f"{d} * {y} + {w} * {b} + {c} * {x} - {a} * {z} as q{s}1",
            f"{d} * {z} + {w} * {c} + {a} * {y} - {b} * {x} as q{s}2", f"{d} * {w} - {a} * {x} - {b} * {y} - {c} * {z} as q{s}3",
        ])
        now = tuple(f"q{s}{k}" for k in range(4))
    return chained(source, out)
