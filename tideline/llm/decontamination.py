"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask over a window of words: places marked 1 are hashed, places
marked 0 are ignored, so a passage whose words were replaced at ignored places
still gives the same hash.  Windows of all benchmark items are hashed under each
seed, windows of all documents likewise, and equal hashes are hits.  Each hit is
verified on the words themselves, on the hit's alignment within ``reach`` words
on either side.  The best stretch counts 1 for an equal word and -2 for a
different one, and must reach ``min_score``; or, in items so short that this asks
for more than 80 % of their words, four fifths of the whole item must be equal.
Short items are cut into one more block of words than may differ, so that at least
one block is whole in every copy, and each block's first words are a seed.

Everything is DataFrame code, in a pass over the documents for every four seeds:
words are hashed, every window is tested against a bit array made from
the benchmark (a scalar subquery), and only windows that pass meet the
benchmark's hashes in a broadcast join.  No text is shuffled; what is shuffled
is one row per task for each document and item found, so a passage that a third
of all documents hold costs no more than any other.  The benchmark side is
counted first: beyond ``max_broadcast`` bytes it is merge-joined instead, only
the words around each hit travelling; windows that many documents hold are
broadcast there, so no task gets them all.

Defined cases: words are runs of letters and digits in lower case; null and empty
texts have none and are never reported; items of fewer than 12 words must agree in 80 %
of their words, items under 5 words are never reported; repeated rows of one id give one row per item; an empty
benchmark or table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import split_heavy, stored

#: Each ignores four of twelve words; any one replaced word is ignored by at least one of them.
SEEDS = ("101101101101", "110110110110", "011011011011", "111100001111")
#: For blocks of short items: of four words or more, of three, and for items of five words with the middle one replaced.
BLOCKS = ("1111", "111", "11011")
#: Masks that one pass over the documents tests.
PASS = 4
#: Words of the shortest item that is reported.
LEAST = 5


def word_hashes(text: Column) -> Column:
    tokens = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")
    return F.transform(tokens, lambda w: F.xxhash64(w))


def _hash(i: int, seed: str, at: Column, words: Column) -> Column:
    return F.xxhash64(F.lit(i), *[F.get(words, at + k) for k, c in enumerate(seed) if c == "1"])


def _around(words: Column, at: Column, before: int, after: int) -> Column:
    """Words from ``before`` ahead of place ``at`` to ``after`` behind it; null outside the text."""
    return F.transform(F.sequence(F.lit(-before), F.lit(after)), lambda k: F.get(words, at + k))


def bit_array(hashes: DataFrame, bits: int) -> Column:
    """A scalar subquery: ``bits`` bits in an array of ints, set at the place of each __h."""
    place = F.pmod(F.col("__h"), F.lit(bits))
    word = hashes.select(F.shiftright(place, 5).cast("int").alias("w"), (place % 32).cast("int").alias("b")).groupBy("w").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("b"))).alias("v"))
    filled = hashes.sparkSession.range(bits // 32).select(F.col("id").cast("int").alias("w")).join(word, "w", "left").select(F.struct("w", F.coalesce("v", F.lit(0)).alias("v")).alias("x"))
    return filled.agg(F.array_sort(F.collect_list("x")).alias("a")).select(F.col("a.v").alias("a")).scalar()


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, seeds: Sequence[str] = SEEDS, min_score: int = 12, reach: int = 32, max_broadcast: int = 64 << 20,
    text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per document and benchmark item that share a verified stretch: key, item, n_hits, score.

    ``max_broadcast``: bytes of the benchmark's hashes and words that may be broadcast.
    """
    masks = [*seeds, *BLOCKS]
    span = max(map(len, seeds))
    named = benchmark.select(F.col(item).alias("__item"), word_hashes(F.col(item_text)).alias("__b"))
    # Items of the same words are verified once, under one number, and told apart at the end.
    items = named.groupBy("__b").agg(F.xxhash64("__b", F.min("__item")).alias("__g"))
    size = F.size("__b")
    # Beyond this size, 80 % of equal words reach min_score as a stretch.
    short = size < max(span, min(-(-5 * min_score // 2), reach + 1))
    whole = F.floor((4 * size + 4) / 5).cast("int")
    blocks = size - whole + 1
    begins = F.exists(F.sequence(F.lit(0), blocks - 1), lambda b: F.floor(b * size / blocks) == F.col("__j"))
    four = F.floor(size / blocks) >= 4
    wanted = {BLOCKS[0]: short & four & begins, BLOCKS[1]: short & ~four & begins, BLOCKS[2]: (size == LEAST) & (F.col("__j") == 0)}
    windows = items.where(size >= LEAST).select("__g", "__b", F.explode(F.sequence(F.lit(0), size - min(map(len, masks)))).alias("__j"))
    own = [
        F.when((F.col("__j") + len(m) <= size) & (wanted[m] if i >= len(seeds) else size >= span), F.struct(F.lit(i).alias("m"), _hash(i, m, F.col("__j"), F.col("__b")).alias("h")))
        for i, m in enumerate(masks)
    ]
    table = windows.select("__g", "__j", F.inline(F.array_compact(F.array(*own))).alias("__m", "__h"))
    sizes = {r["__m"]: r.n for r in table.groupBy("__m").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per seed
    n = sum(sizes.values())
    used = [(i, m) for i, m in enumerate(masks) if sizes.get(i)]
    if not used:
        return docs.select(F.col(key)).join(benchmark.select(F.col(item)).limit(0), F.lit(False)).select("*", F.lit(0).cast("long").alias("n_hits"), F.lit(0).cast("long").alias("score"))
    # No stretch reaches more than the item's size, and no item has more equal words.
    none = size + 1
    facts = items.select("__g", "__b", F.when(size >= span, F.lit(min_score)).otherwise(none).alias("__least"), F.when(short, whole).otherwise(none).alias("__whole"))
    # About 40 bytes a window, and the items' words.
    small = 40 * n + 8 * (items.agg(F.sum(size)).first()[0] or 0) <= max_broadcast

    # 64 to 128 bits a window keep chance passes near 1 %; at most 64 MB of bits.
    bits = max(1 << 16, 1 << (64 * min(n, 1 << 22)).bit_length())
    array = bit_array(table, bits)
    hashed = docs.select(F.col(key).alias("__id"), word_hashes(F.col(text)).alias("__d"))
    length = F.size("__d")

    def seen(i: int, m: str) -> Column:
        # No array functions here, so that the test stays in generated code and no row is copied for it.
        p = F.pmod(_hash(i, m, F.col("__i"), F.col("__d")), F.lit(bits))
        bit = F.getbit(F.get(array, F.shiftright(p, 5).cast("int")), (p % 32).cast("int")) == 1
        return (F.col("__i") + len(m) <= length) & bit

    def hits(some: list[tuple[int, str]]) -> DataFrame:
        lowest = min(len(m) for _, m in some)
        places = hashed.where(length >= lowest).select("__id", "__d", F.explode(F.sequence(F.lit(0), length - lowest)).alias("__i"))
        found = places.where(reduce(Column.__or__, [seen(i, m) for i, m in some]))
        passed = F.array_compact(F.array(*[F.when(seen(i, m), _hash(i, m, F.col("__i"), F.col("__d"))) for i, m in some]))
        return found.select("__id", "__d", "__i", F.explode(passed).alias("__h"))

    # The test of more than PASS masks is too long a method for the JVM's compiler, which is ten times as slow.
    parts = [hits(used[k : k + PASS]) for k in range(0, len(used), PASS)]
    context = _around(F.col("__d"), F.col("__i"), reach, span + reach).alias("__dw")
    known = table.select("__h", "__g", "__j").distinct()
    if small:
        met = [p.join(F.broadcast(known), "__h").select("__id", "__g", "__j", context) for p in parts]
    else:
        # Windows that many documents hold are broadcast, at most 4,096; the others meet the benchmark in a merge join.
        slim = stored(reduce(DataFrame.unionByName, [p.select("__id", context, "__h") for p in parts]), "seed-hits")
        often = slim.groupBy("__h").agg(F.count(F.lit(1)).alias("__n"))
        heavy, _ = split_heavy(often, "__n", slim.count())
        heavy = known.join(F.broadcast(heavy.select("__h")), "__h")
        rest = slim.join(F.broadcast(heavy.select("__h").distinct()), "__h", "left_anti").join(known.hint("merge"), "__h")
        met = [x.select("__id", "__g", "__j", "__dw") for x in (slim.join(heavy, "__h"), rest)]
    equal = F.zip_with("__dw", _around(F.col("__b"), F.col("__j"), reach, span + reach), lambda a, b: F.coalesce(a == b, F.lit(False)))
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(acc: Column, e: Column) -> Column:
        now = F.greatest(F.lit(0), acc["now"] + F.when(e, 1).otherwise(-2))
        return F.struct(now.alias("now"), F.greatest(acc["best"], now).alias("best"))

    def scored(rows: DataFrame) -> DataFrame:
        both = rows.join(F.broadcast(facts) if small else facts.hint("merge"), "__g").select("__id", "__g", "__least", "__whole", equal.alias("__e"))
        both = both.withColumns({"__same": F.size(F.filter("__e", lambda e: e)), "__s": F.aggregate("__e", zero, step, lambda a: a["best"])})
        return both.where((F.col("__s") >= F.col("__least")) | (F.col("__same") >= F.col("__whole"))).groupBy("__id", "__g").agg(F.count(F.lit(1)).alias("n"), F.max("__s").alias("s"))

    # Each part is summed in its tasks, so what is shuffled is a row for a document, an item and a task.
    out = reduce(DataFrame.unionByName, map(scored, met)).groupBy("__id", "__g").agg(F.sum("n").alias("n_hits"), F.max("s").cast("long").alias("score"))
    members = named.join(items, "__b").select("__g", "__item").distinct()
    out = out.join(F.broadcast(members) if small else members, "__g")
    return out.select(F.col("__id").alias(key), F.col("__item").alias(item), "n_hits", "score")


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:  # noqa: ANN003
    """docs without those that overlap the benchmark.  A null id is never dropped."""
    bad = find_overlaps(docs, benchmark, key=key, **options).select(key).distinct()
    return docs.join(bad, key, "left_anti").select(*docs.columns)


def op1_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every document and benchmark item that overlap, over both whole tables."""
    return find_overlaps(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))
