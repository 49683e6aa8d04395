"""URL rules held in a cascade of Bloom filters.

A rule is a host and the start of a path, with a verdict.  The keys that a URL
can match are its host's suffixes at dots joined with the starts of its path, at
the lengths that rule paths have.  The complete key universe of a corpus is the
set of these keys over all its URLs.

Level 1 encodes the listed keys.  Level 2 encodes the keys of the universe that
pass level 1 without being listed, level 3 the listed keys that pass level 2 as
well, and so on until no key is wrong.  A key is listed exactly if the first
level that rejects it is an even one (or if it passes an odd last level).
Within the universe this is exact, and the URLs are judged without a join.

One cascade holds the keys of all rules; a second tells those that block from the
others, its universe being the listed keys alone.  Building reads the corpus once:
only keys that pass level 1 are ever shuffled, so its cost does not follow the corpus.
Everything is DataFrame code.  A level's bits travel as one array of at most
``max_bits`` bits; beyond it the keys are cut by a hash into as many cascades as
it takes, so what a task holds follows the rules, about 12 bits each, and the
plan and the verdicts are alike at every size.

Defined cases: a null URL, or one without ``://``, has an empty host and path
and matches no rule, so the default holds; repeated rows are judged alike; two
rules of equal length cannot both fit unless they differ in the host's length,
and the longer host then wins; two rules of one host and path must agree; an empty
rule list judges everything by default.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, lower_ascii, stored

#: (verdict, host, path) of the contract.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_keys(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """Keys of one URL, the longest first: every suffix of the host with every start of the path."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(
        F.array(*[F.when(F.length(path) >= n, F.substr(path, F.lit(1), F.lit(n))) for n in sorted(lengths, reverse=True)]),
        lambda p: p.isNotNull(),
    )
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p))))
    return F.when(host != "", keys).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Level:
    """One Bloom filter: words of 63 bits, and how many hashes it uses."""

    words: tuple[int, ...]
    hashes: int
    seed: int

    def passes(self, key: Column) -> Column:
        bits = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # folded to one literal
        places = F.array(*[F.pmod(F.xxhash64(F.lit(64 * self.seed + i), key), F.lit(len(self.words) * 63)) for i in range(self.hashes)])
        return F.forall(places, lambda p: F.getbit(F.element_at(bits, (F.floor(p / 63) + 1).cast("int")), (p % 63).cast("int")) == 1)


def _bits(n: int, rate: float) -> int:
    return max(63, math.ceil(-n * math.log(rate) / math.log(2) ** 2))


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A filter for the n rows of keys(k) with about this false positive rate."""
    bits = _bits(n, rate)
    words, hashes = -(-bits // 63), max(1, round(bits / n * math.log(2)))
    places = F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(64 * seed + i), F.col("k")), F.lit(words * 63)) for i in range(hashes)]))
    at = keys.select(places.alias("p"))
    rows = at.groupBy(F.floor(F.col("p") / 63).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 63).cast("int"))).alias("b")).collect()
    full = dict(map(tuple, rows))  # at most max_bits / 63 rows
    return Level(tuple(full.get(w, 0) for w in range(words)), hashes, seed)


@dataclass
class Cascade:
    """Exact membership of keys within the universe it was built over; ``shards[i]`` has the levels for keys of that hash."""

    shards: list[list[Level]]

    @property
    def levels(self) -> list[Level]:
        return [level for shard in self.shards for level in shard]

    def holds(self, key: Column) -> Column:
        def one(levels: list[Level]) -> Column:
            out = F.lit(len(levels) % 2 == 1)
            for i in reversed(range(len(levels))):
                out = F.when(~levels[i].passes(key), F.lit(i % 2 == 1)).otherwise(out)
            return out

        if len(self.shards) == 1:
            return one(self.shards[0])
        out, at = F.lit(False), _shard(key, len(self.shards))
        for i, levels in enumerate(self.shards):
            out = F.when(at == i, one(levels)).otherwise(out)
        return out


def _shard(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(n))


def build_cascade(listed: DataFrame, universe: DataFrame, first_rate: float = 0.01, rate: float = 0.5, max_bits: int = 1 << 23) -> Cascade:
    """listed(k), universe(k) -> Cascade.

    ``universe`` may repeat keys: it is reduced to those that pass level 1 before
    any shuffle.  It is read once, whatever the number of levels and shards.
    """
    listed = stored(listed.distinct(), "listed")
    total = listed.count()
    # Shards differ in size by chance, so each is planned for half the bound.
    n_shards = max(1, -(-2 * _bits(total, first_rate) // max_bits)) if _bits(total, first_rate) > max_bits else 1
    at = _shard(F.col("k"), n_shards)
    sizes = {r.s: r.n for r in listed.groupBy(at.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a shard
    first = [[_level(listed.where(at == s), sizes[s], first_rate, 0)] if sizes.get(s) else [] for s in range(n_shards)]
    if not total:
        return Cascade(first)
    passed = stored(universe.where(Cascade(first).holds(F.col("k"))).distinct(), "universe-passed")
    wrong = stored(passed.join(listed, "k", "left_anti"), "universe-wrong")
    shards = []
    for s, levels in enumerate(first):
        # The keys to encode at the next level, and those that must fail it.
        ins, outs = wrong.where(at == s), listed.where(at == s)
        n = ins.count()
        while n:
            levels.append(_level(ins, n, rate, len(levels)))  # levels hash apart, or they would repeat each other's errors
            ins, outs = stored(outs.where(levels[-1].passes(F.col("k"))), f"level{len(levels)}"), ins
            n = ins.count()
        shards.append(levels)
    return Cascade(shards)


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow", url: str = "url", max_bits: int = 1 << 23
) -> DataFrame:
    """Adds host, path, rule and verdict.  The longest rule that fits decides, else ``default``."""
    spark: SparkSession = pages.sparkSession
    lengths = sorted({len(p) for _, _, p in rules})
    host, path = host_and_path(F.col(url))
    out = pages.withColumns({"host": host, "path": path})
    if not rules:
        return out.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    low = str.maketrans(UPPER, LOWER)
    said = {h.translate(low) + p: v for v, h, p in rules}
    if any(said[h.translate(low) + p] != v for v, h, p in rules):
        raise ValueError("two rules of one host and path differ in their verdict")
    # As literals, so that no Python worker makes the rows.
    listed = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in said.items()])))
    out = out.withColumn("__keys", url_keys(F.col("host"), F.col("path"), lengths))
    known = build_cascade(listed.select("k"), out.select(F.explode("__keys").alias("k")), max_bits=max_bits)
    blocks = build_cascade(listed.where("v = 'block'").select("k"), listed.select("k"), max_bits=max_bits)
    ranked = F.transform(F.filter(F.col("__keys"), known.holds), lambda k: F.struct(F.length(k).alias("n"), F.locate("/", k).alias("h"), k.alias("rule")))
    out = out.withColumn("rule", F.array_max(ranked)["rule"])
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(blocks.holds(F.col("rule")), F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumn("verdict", verdict).drop("__keys")


def op10_url_filter(pages: DataFrame) -> DataFrame:
    """The contract's columns, from judge_urls over the whole table."""
    return judge_urls(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
