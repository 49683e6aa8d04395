"""Jaccard self-join on word shingles by several global token orders.

Two sets of shingles with Jaccard of 0.8 or more share a shingle among the first
n - ceil(0.8 n) + 1 of each, whatever global order the shingles are put in.  A
pair must therefore meet under every order; here under two independent ones,
whose candidate pairs are intersected before any set is compared.  Where two sets
meet first, at places p and q, they share at most min(n - p, m - q) shingles, so a
pair also needs 9 * min(n - p, m - q) >= 4 * (n + m) at some place where it meets.

1. One pass makes each text's set, its size and a 64-bit class hash of the set.
   Equal sets are one class from here on, so exact copies cost nothing further.
2. Both orders put shingles that many documents share last, in four bands.  The
   bands are told by bit arrays of fixed size, filled from counts over all
   documents; any such arrays give a valid global order, so their errors cost
   time, not links.
3. Prefixes are dealt by shingle and sorted.  A shingle with up to ``LONG``
   classes gives all pairs of classes of fitting size, which is linear in the
   number of prefix entries.  The shingles at which a pair meets are counted; with those that the
   two may share in longer runs they must be as many as a Jaccard of 0.8 needs, so pairs
   that meet by chance stay rows of numbers.  Whole prefixes, of both orders, are made only
   of classes that form such pairs, or are in longer runs.  A pair goes on only if its
   prefixes share, under either order, as many shingles as a Jaccard of 0.8 needs.
4. A shingle with more classes (a large group of near copies) gives no pairs at
   first: its classes are compared with one of them, the one that holds most of
   such shingles, before any pair of step 3.  Then only classes outside the main
   component are compared with those of other components, in blocks: of these, first
   each class's nearest pair is verified, then those that no links join yet.  Pairs
   inside one component, of step 3 too, are never needed.  Classes unlike the leader whose
   shingles of their own are few still cost the square of their number in a run.
5. Candidates are verified on their whole sets.  Sets travel once to each block
   of their candidate component, at most 2 * BLOCK sets a block.

Links join classes into components by large and small stars.  Nothing is
collected but the fixed bit arrays and counts.

Defined cases: null texts, empty texts and texts without words have an empty set
and are linked with nothing; under five words the whole sequence is one shingle;
repeated rows are copies of each other; a null id is ignored when the smallest
id is sought.  Two shingles are taken as equal if 53 bits of hash agree, two sets
if 64 do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, drop_shuffles, join_skewed, stored
from .components import components
from .tokens import lots, mixed, windows, words

#: Classes under one shingle up to which all pairs are made.
LONG = 64
#: Documents of one shingle from which it is put last, 16 and 256 times as many for the further bands; counts are summed from the tasks in which it repeats.
SHARED = 32
BANDS = (1, 16, 256)
HELD = 20_000_000
#: Bits of the arrays that travel to every task.
BITS = 1 << 23
#: Classes of a block in verification.
BLOCK = 512
#: Texts handled at a time, and bits of a shingle's hash: together they fill 64 bits.
LOT, TOKEN_BITS = 2000, 53
_SALT = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


def shingle_sets(col: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of a batch of at most LOT texts, distinct, in order."""
    w = words(col, lower=True)
    h = w.hashes()
    x, at = windows(h, w.start, k)
    owner = w.owner()[at]
    n = np.diff(w.start)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            has = n[short] > i
            whole[has] = mixed(whole[has] * np.uint64(0x8EBC6AF09C88C6E3) + h[w.start[short[has]] + i])
        x, owner = np.concatenate([x, whole]), np.concatenate([owner, short])
    # One sort of text number and hash in one word; LOT texts fit the upper bits.
    both = (owner.astype(np.uint64) << np.uint64(TOKEN_BITS)) | (x >> np.uint64(64 - TOKEN_BITS))
    both.sort()
    first = np.ones(len(both), bool)
    first[1:] = both[1:] != both[:-1]
    both = both[first]
    return (both >> np.uint64(TOKEN_BITS)).astype(np.int64), both & np.uint64((1 << TOKEN_BITS) - 1)


def class_hashes(owner: np.ndarray, x: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and class hash of each text's set; equal sets have equal hashes."""
    n = np.bincount(owner, minlength=n_texts)
    out = np.zeros(n_texts, np.uint64)
    full = n > 0
    if full.any():
        at = np.concatenate([[0], np.cumsum(n)])[:-1][full]
        a, b = np.add.reduceat(mixed(x), at), np.bitwise_xor.reduceat(mixed(x ^ _SALT[0]), at)
        out[full] = mixed(a ^ mixed(b + n[full].astype(np.uint64)))
    return n, out


def first_of_each(cls: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first text of each class with a set."""
    _, at = np.unique(cls, return_index=True)
    keep = np.zeros(len(cls), bool)
    keep[at] = True
    return keep & (n > 0)


def has_bit(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    p = mixed(x ^ _SALT[1]) & np.uint64(BITS - 1)
    return (bits[(p >> np.uint64(5)).astype(np.int64)] >> (p & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1


def bit_array(values: DataFrame, name: str) -> np.ndarray:
    """A bit for each value; BITS / 32 rows at most come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.unique(mixed(np.asarray(b.column(0)).view(np.uint64) ^ _SALT[1]) & np.uint64(BITS - 1))
            yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(5)).astype(np.int32)), pa.array(np.int64(1) << (p & np.uint64(31)).astype(np.int64))], ["w", "b"])

    got = values.select(name).mapInArrow(run, "w int, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(BITS // 32, np.uint32)
    out[np.asarray(got["w"])] = np.asarray(got["b"]).astype(np.uint32)
    return out


def _in_lots(batches: Iterator[pa.RecordBatch], at: int = 0) -> Iterator[pa.RecordBatch]:
    return lots(batches, at, rows=LOT)


def summaries(docs: DataFrame, k: int, text: str, key: str) -> DataFrame:
    """Rows of two kinds: a document's (id, n, cls), and (token, n) of shingles that repeat within a task.

    A task holds the hashes of its shingles, eight bytes each, until ``HELD`` are counted.
    """
    kind = dict(docs.dtypes)[key]
    names = ["id", "n", "cls", "token"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        id_type = None

        def counted() -> pa.RecordBatch:
            all_of_them = np.sort(np.concatenate(held))
            held.clear()
            start = np.flatnonzero(np.r_[True, all_of_them[1:] != all_of_them[:-1]])
            count = np.diff(np.r_[start, len(all_of_them)])
            token, count = all_of_them[start][count > 1], count[count > 1]
            return pa.RecordBatch.from_arrays([pa.nulls(len(token), id_type), pa.array(count.astype(np.int64)), pa.nulls(len(token), pa.int64()), pa.array(token.view(np.int64))], names)

        for b in _in_lots(batches, 1):
            id_type = b.column(0).type
            owner, x = shingle_sets(b.column(1), k)
            n, cls = class_hashes(owner, x, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int64)), pa.array(cls.view(np.int64), mask=n == 0), pa.nulls(b.num_rows, pa.int64())], names)
            held.append(x[first_of_each(cls, n)[owner]])
            if sum(map(len, held)) > HELD:
                yield counted()
        if held:
            yield counted()

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"id {kind}, n long, cls long, token long")


def _prefixes_of(col: pa.Array, k: int, bands: list[np.ndarray], only: np.ndarray | None, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Sizes and classes of a lot's texts, which of them are taken, and for each order (shingle, text, place) of their prefixes, in order."""
    owner, x = shingle_sets(col, k)
    n, cls = class_hashes(owner, x, len(col))
    taken = first_of_each(cls, n)
    if only is not None:
        taken &= has_bit(only, cls)
    keep = taken[owner]
    owner, x = owner[keep], x[keep]
    band = np.sum([has_bit(v, x) for v in bands], axis=0).astype(np.uint64)
    start = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(col)))])
    size = n - (4 * n + 4) // 5 + 1
    low = np.uint64(TOKEN_BITS - 2)
    out = []
    for order in orders:
        t = mixed(x + _SALT[order])
        at = np.argsort((owner.astype(np.uint64) << np.uint64(TOKEN_BITS)) | (band << low) | (t >> (np.uint64(64) - low)))
        rank = np.arange(len(x)) - start[owner]
        inside = rank < size[owner]  # the sort keeps texts together, so ranks are theirs
        at, rank, own = at[inside], rank[inside], owner[inside]
        out.append((t[at] & ~np.uint64(1) | np.uint64(order), own, rank))
    return n, cls, taken, out


def prefixes(docs: DataFrame, shared: list[np.ndarray], k: int, text: str, order: int = 0) -> DataFrame:
    """(t, cls, n, p): the prefix of each class under an order, p being a shingle's place; the lowest bit of t tells the order."""
    bits = docs.sparkSession.sparkContext.broadcast((shared, None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, only = bits.value
        for b in _in_lots(batches):
            n, cls, _, ((t, own, rank),) = _prefixes_of(b.column(0), k, bands, only, (order,))
            yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(cls[own].view(np.int64)), pa.array(n[own].astype(np.int64)), pa.array(rank.astype(np.int64))], ["t", "cls", "n", "p"])

    return docs.select(F.col(text)).mapInArrow(run, "t long, cls long, n long, p long")


def prefix_sets(docs: DataFrame, shared: list[np.ndarray], k: int, text: str, wanted: np.ndarray) -> DataFrame:
    """(cls, x, y): the prefixes of each class with a bit in ``wanted``, in order, under the first and the second order."""
    bits = docs.sparkSession.sparkContext.broadcast((shared, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, only = bits.value
        for b in _in_lots(batches):
            n, cls, keep, found = _prefixes_of(b.column(0), k, bands, only, (0, 1))
            lists = []
            for order, (t, own, _) in enumerate(found):
                ends = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=b.num_rows)[keep])])
                lists.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(t.view(np.int64))))
            yield pa.RecordBatch.from_arrays([pa.array(cls[keep].view(np.int64)), *lists], ["cls", "x", "y"])

    found = docs.select(F.col(text)).mapInArrow(run, "cls long, x array<long>, y array<long>")
    return found.groupBy("cls").agg(F.first("x").alias("x"), F.first("y").alias("y"))


def _pairs_of_runs(batches: Iterator[pa.RecordBatch], long: int = LONG) -> Iterator[pa.RecordBatch]:
    """Sorted (t, n, cls, p) -> (kind, a, b, n, p, m); runs of over ``long`` classes are long.

    kind 1: a pair of classes that meet, with their sizes n and m, p being how often they do; 2: one that meets only where
    both have too little left to be linked, unless it meets elsewhere; 3: an entry (t, class) of a long run.
    """

    def rows(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray, p: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), *(pa.array(v) for v in (a, b, n, p, m))], ["kind", "a", "b", "n", "p", "m"])

    def long_rows(t: np.ndarray, n: np.ndarray, c: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield rows(3, t, c, n, p, n)

    def done(t: np.ndarray, n: np.ndarray, c: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole runs."""
        if not len(t):
            return
        start = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        size = np.diff(np.r_[start, len(t)])
        many = np.repeat(size > long, size)
        if many.any():
            yield from long_rows(t[many], n[many], c[many], p[many])
        found: list[np.ndarray] = []
        for s in range(2, long + 1):
            at = start[size == s]
            if not len(at):
                continue
            i, j = np.triu_indices(s, 1)
            for low in range(0, len(at), 1 + 2_000_000 // len(i)):
                part = at[low : low + 1 + 2_000_000 // len(i)]
                a, b = (part[:, None] + i).ravel(), (part[:, None] + j).ravel()
                fits = 5 * n[a] >= 4 * n[b]  # n rises within a run
                a, b = a[fits], b[fits]
                late = 9 * np.minimum(n[a] - p[a], n[b] - p[b]) < 4 * (n[a] + n[b])
                turn = c[a] > c[b]
                a, b = np.where(turn, b, a), np.where(turn, a, b)
                found.append(np.stack([c[a], c[b], n[a], n[b], late]))
        if found:
            a, b, na, nb, late = np.concatenate(found, axis=1)
            order = np.lexsort((late, b, a))
            a, b, na, nb, late = a[order], b[order], na[order], nb[order], late[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.r_[at, len(a)])
            for kind in (1, 2):
                own = late[at] == kind - 1
                if own.any():
                    yield rows(kind, a[at[own]], b[at[own]], na[at[own]], times[own], nb[at[own]])

    none = np.zeros(0, np.int64)
    t = n = c = p = none
    open_long = None  # the t of a run that was already given out as long
    for batch in batches:
        t, n, c, p = (np.concatenate([old, np.asarray(col)]) for old, col in zip((t, n, c, p), batch.columns, strict=True))
        if not len(t):
            continue
        new = np.ones(len(t), bool)  # copies of a class from several lots
        new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
        t, n, c, p = t[new], n[new], c[new], p[new]
        if open_long is not None:
            same = t == open_long
            yield from long_rows(t[same], n[same], c[same], p[same]) if same.any() else ()
            if same.all():
                t = n = c = p = none
                continue
            t, n, c, p, open_long = t[~same], n[~same], c[~same], p[~same], None
        cut = int(np.flatnonzero(t == t[-1])[0])  # the last run may go on
        yield from done(t[:cut], n[:cut], c[:cut], p[:cut])
        t, n, c, p = t[cut:], n[cut:], c[cut:], p[cut:]
        if len(t) > 100 * long:
            open_long = t[0]
            yield from long_rows(t, n, c, p)
            t = n = c = p = none
    yield from done(t, n, c, p)


def verify(docs: DataFrame, pairs: DataFrame, k: int, text: str) -> DataFrame:
    """The pairs (a, b) of classes whose sets have a Jaccard of 0.8 or more."""
    spark = docs.sparkSession
    pairs = stored(pairs, "candidates")
    total = pairs.count()
    if not total:
        return pairs
    roots = components(pairs)
    wanted = spark.sparkContext.broadcast(bit_array(roots, "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _in_lots(batches):
            owner, x = shingle_sets(b.column(0), k)
            n, cls = class_hashes(owner, x, b.num_rows)
            keep = np.flatnonzero(first_of_each(cls, n) & has_bit(wanted.value, cls))
            at = np.concatenate([[0], np.cumsum(n)])
            yield pa.RecordBatch.from_arrays([pa.array(cls[keep].view(np.int64)), pa.array([x[at[i] : at[i + 1]].tobytes() for i in keep], pa.binary())], ["cls", "set"])

    sets = docs.select(F.col(text)).mapInArrow(run, "cls long, set binary")

    # Both ends of a pair are in one component, so the place of one tells that of the other.
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    n_nodes = roots.count()
    placed = stored(join_skewed(roots, sizes, ["root"], "size", n_nodes).select(F.col("node").alias("a"), "root", F.ceil(F.col("size") / BLOCK).alias("blocks")), "blocks")
    degree = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    placed = stored(placed.join(degree, "a"), "placed")
    block = lambda c: F.pmod(F.xxhash64(c), F.col("blocks"))
    of_b = join_skewed(pairs, placed, ["a"], "n", total).select("a", "b", "root", block("a").alias("i"), block("b").alias("block"))
    n_lots = max(1, total // 1000)
    task = F.pmod(F.xxhash64("root", F.least("i", "block"), F.greatest("i", "block")), F.lit(n_lots))
    dealt = stored(of_b.select(task.alias("task"), "a", "b"), "dealt")
    members = dealt.select(F.col("task").alias("to"), F.col("a").alias("cls")).unionByName(dealt.select(F.col("task").alias("to"), F.col("b").alias("cls"))).distinct()
    once = sets.groupBy("cls").agg(F.first("set").alias("set"))
    sent = members.join(once, "cls").select("to", "cls", "set")

    def compare(links: pa.Table, found: pa.Table) -> pa.Table:
        own = {c: np.frombuffer(s, np.uint64) for c, s in zip(found["cls"].to_pylist(), found["set"].to_pylist(), strict=True)}
        good = []
        for a, b in zip(links["a"].to_pylist(), links["b"].to_pylist(), strict=True):
            x, y = own[a], own[b]
            both = len(x) + len(y) - len(np.union1d(x, y))
            good.append(100 * both >= 80 * (len(x) + len(y) - both))
        return links.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    links = stored(dealt.groupBy("task").cogroup(sent.groupBy("to")).applyInArrow(compare, "a long, b long"), "links")
    drop_shuffles(spark)
    return links


def _ordered(a: str, b: str, n: str, m: str) -> list:
    turn = F.col(a) > F.col(b)
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.when(turn, F.col(m)).otherwise(F.col(n)).alias("n"), F.when(turn, F.col(n)).otherwise(F.col(m)).alias("m")]


_FITS = "5 * n >= 4 * m and 5 * m >= 4 * n and 9 * least(n - p, m - q) >= 4 * (n + m) and cls <> lead"


def _meet(one: str, two: str) -> str:
    """Whether prefixes ``one`` and ``two`` of sets of n and m shingles share as many as a Jaccard of 0.8 asks for.

    All shingles that come up to the end of the prefix that ends first are in both or in
    none, so the sets share at most these and what one of them has beyond its prefix.
    """
    return f"9 * (size(array_intersect({one}, {two})) + greatest(n - size({one}), m - size({two}))) >= 4 * (n + m)"


def _often(met: DataFrame, weight: DataFrame) -> DataFrame:
    """Pairs (a, b, n, m) that may share as much of their first prefixes as ``_meet`` asks for, by counts alone.

    What two classes share in short runs is counted; of what they have in long runs,
    weight(cls, w), they share at most what one of them has.
    """
    pairs = met.where("kind < 3").groupBy("a", "b", "n", "m").agg(F.sum("p").alias("c"), F.min("kind").alias("kind")).where("kind = 1")
    of_a, of_b = (weight.select(F.col("cls").alias(c), F.col("w").alias(f"w_{c}")) for c in "ab")
    beyond = lambda n: f"{n} - ({n} - (4 * {n} + 4) div 5 + 1)"  # noqa: E731  what is beyond a prefix
    may = f"9 * (c + least(coalesce(w_a, 0), coalesce(w_b, 0)) + greatest({beyond('n')}, {beyond('m')})) >= 4 * (n + m)"
    return pairs.join(of_a, "a", "left").join(of_b, "b", "left").where(may).select("a", "b", "n", "m")


def _stars(entries: DataFrame, total: int) -> DataFrame:
    """Pairs of each class of a long run with the run's class that is in most long runs: entries(t, cls, n, p, w)."""
    lead = entries.groupBy("t").agg(F.max(F.struct("w", "n", "cls", "p")).alias("x"), F.count(F.lit(1)).alias("size"))
    lead = lead.select("t", F.col("x.cls").alias("lead"), F.col("x.n").alias("m"), F.col("x.p").alias("q"), "size")
    return join_skewed(entries, lead, ["t"], "size", total).where(_FITS).select(*_ordered("cls", "lead", "n", "m")).distinct()


def _unjoined(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose classes are not in one component already; a class has at most LONG pairs for each shingle of its prefix."""
    of_a, of_b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    known = pairs.join(of_a, "a", "left").join(of_b, "b", "left")
    return known.where("root_a is null or root_b is null or root_a <> root_b").select("a", "b")


def _outsiders(entries: DataFrame, roots: DataFrame, sets: DataFrame, total: int) -> DataFrame:
    """Pairs of classes of long runs that no links join yet: those outside a run's main component with all others.

    A run is compared in blocks of ``BLOCK`` by ``BLOCK`` classes.  A pair is made where
    it first meets, if it meets under both orders often enough; pairs that first meet in
    a short run are among that run's.
    """
    placed = stored(entries.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")), "long-placed")
    by_root = placed.groupBy("t", "root").agg(F.count(F.lit(1)).alias("c"))
    main = by_root.groupBy("t").agg(F.max(F.struct("c", "root")).alias("x"), F.sum("c").alias("size"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    main = main.select("t", F.col("x.root").alias("main"), "size", F.ceil(F.col("size") / BLOCK).alias("rows"), F.ceil((F.col("size") - F.col("x.c")) / BLOCK).alias("cols"))
    active = stored(join_skewed(placed, main, ["t"], "size", total).join(sets, "cls"), "long-active")
    block = lambda n: F.pmod(F.xxhash64("cls"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    renamed = [F.col(c).alias(d) for c, d in (("cls", "lead"), ("n", "m"), ("p", "q"), ("root", "of"), ("x", "x2"), ("y", "y2"))]
    outside = active.where("root <> main").select("t", block("cols").alias("j"), each("rows").alias("i"), *renamed)
    inside = active.select("t", block("rows").alias("i"), each("cols").alias("j"), "cls", "n", "p", "root", "main", "x", "y")
    # Of two outsiders, one way round is enough.
    fits = f"{_FITS} and root <> of and (root = main or cls < lead) and array_intersect(x, x2)[0] = inside.t and {_meet('x', 'x2')} and {_meet('y', 'y2')}"
    on = "inside.t = outside.t and inside.i = outside.i and inside.j = outside.j"
    met = inside.alias("inside").join(outside.hint("merge").alias("outside"), F.expr(f"{on} and {fits}"))
    return met.select(*_ordered("cls", "lead", "n", "m")[:2], F.size(F.array_intersect("x", "x2")).alias("c"))


def _nearest(pairs: DataFrame) -> DataFrame:
    """For each class the pair that shares most: pairs(a, b, c)."""
    ends = pairs.select("a", "b", F.struct("c", "a", "b").alias("s"))
    best = ends.select(F.col("a").alias("cls"), "s").unionByName(ends.select(F.col("b").alias("cls"), "s")).groupBy("cls").agg(F.max("s").alias("s"))
    return best.select("s.a", "s.b").distinct()


def _meeting_twice(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs(a, b, n, m), those that meet often enough under both orders."""
    of_a, of_b = (sets.select(F.col("cls").alias(c), F.col("x").alias(f"x_{c}"), F.col("y").alias(f"y_{c}")) for c in "ab")
    both = pairs.join(of_a, "a").join(of_b, "b").where(f"{_meet('x_a', 'x_b')} and {_meet('y_a', 'y_b')}")
    return both.select("a", "b")


def near_duplicates(docs: DataFrame, k: int = 5, text: str = "text", key: str = "doc_id", long: int = LONG, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """(documents with n_shingles, cls and component_id; links a, b between classes).

    component_id is the smallest id that links reach; of classes that the links of
    long runs join, only those links are listed, all others are complete.
    """
    bounded_batches(docs.sparkSession)
    seen = stored(summaries(docs, k, text, key), "summaries")
    often = stored(seen.where("token is not null").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= shared), "often")
    bands = [bit_array(often.where(F.col("n") >= shared * x), "token") for x in BANDS]

    runs = prefixes(docs, bands, k, text).repartition("t").sortWithinPartitions("t", "n", "cls").select("t", "n", "cls", "p")
    met = stored(runs.mapInArrow(lambda batches: _pairs_of_runs(batches, long), "kind int, a long, b long, n long, p long, m long"), "met")
    drop_shuffles(docs.sparkSession)
    entries = stored(met.where("kind = 3").select(F.col("a").alias("t"), F.col("b").alias("cls"), "n", "p").distinct(), "long-entries")
    weight = entries.groupBy("cls").agg(F.count(F.lit(1)).alias("w"))
    one = stored(_often(met, weight), "often-met")
    wanted = bit_array(one.select(F.col("a").alias("cls")).union(one.select("b")).union(entries.select("cls")), "cls")
    sets = stored(prefix_sets(docs, bands, k, text, wanted), "prefix-sets")
    drop_shuffles(docs.sparkSession)
    pairs = stored(_meeting_twice(one, sets), "twice-met")
    drop_shuffles(docs.sparkSession)
    total = entries.count()
    if total:
        entries = stored(join_skewed(entries, weight, ["cls"], "w", total), "long-runs")
        links = verify(docs, _meeting_twice(_stars(entries, total), sets), k, text)
        roots = stored(components(links), "star-roots")
        rest = stored(_outsiders(entries, roots, sets, total), "outsiders")
        links = stored(links.unionByName(verify(docs, _unjoined(pairs, roots).unionByName(_nearest(rest)).distinct(), k, text)), "links")
        links = stored(links.unionByName(verify(docs, _unjoined(rest, stored(components(links), "roots")), k, text)), "links")
    else:
        links = verify(docs, pairs, k, text)

    rows = seen.where("token is null").select("id", "n", "cls")
    classes = rows.where("n > 0").groupBy("cls").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes.join(components(links).withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")), "classes")
    groups = classes.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("of"), F.sum("copies").alias("docs"))
    totals = groups.agg(F.sum("of").alias("a"), F.sum("docs").alias("b")).first()
    named = join_skewed(classes, groups, ["root"], "of", totals.a or 0).select("cls", "component_id", "copies")
    full = join_skewed(rows.where("n > 0"), named, ["cls"], "copies", totals.b or 0)
    empty = rows.where("n = 0").select("id", "n", "cls", F.col("id").alias("component_id"))
    out = full.select("id", "n", "cls", "component_id").unionByName(empty)
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "cls", "component_id"), links


def op4_ngram_join(docs: DataFrame) -> DataFrame:
    """The contract's columns, over the whole table."""
    out, _ = near_duplicates(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id")
