"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (h1, h2, n) sorted by the 128-bit hash of a line's key, n
being the documents that hold the key.  A batch first meets the runs in a merge
anti-join, which takes away the keys already known to be frequent, then adds a
run of its own at level 0.  When a level holds ``fanout`` runs they are merged,
counts added, into one run of the next level, so a key is rewritten only as
often as there are levels.

Everything is DataFrame code.  A key that a third of all lines share is summed
on the map side before any shuffle; at look-up frequent keys with many lines
are broadcast (at most 4,096 can exist) and the others merge-joined.

Defined cases: a null or empty text is one empty line; an empty key is never
frequent; each row counts as a document; an empty table gives an empty result.
Two different keys are taken as one only if 128 bits agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_skewed, lower_ascii, shared_folder, stored, strip_white


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(0x5DEECE66D), key).alias("h2")]


def line_keys(text: Column) -> Column:
    """The key of each line: stripped, A to Z in lower case."""
    return F.transform(F.split(lower_ascii(F.coalesce(text, F.lit(""))), "\n", -1), strip_white)


class LineRuns:
    """Sorted runs of line keys with the number of documents that hold each.

    ``again`` holds the counts of keys that were frequent already when a batch came,
    so that all counts are true ones.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = 2, min_docs: int = 10):
        self.spark, self.fanout, self.min_docs = spark, fanout, min_docs
        self.folder = folder or shared_folder(spark, "line-runs")
        self.levels: list[list[str]] = [[]]
        self.again: list[str] = []
        self._made = 0

    def _path(self, name: str) -> str:
        self._made += 1
        return f"{self.folder}/{name}-{self._made}"

    def _write(self, counts: DataFrame, level: int) -> None:
        path = self._path(f"level{level}")
        counts.repartition("h1").sortWithinPartitions("h1", "h2").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def counts(self, paths: list[str] | None = None) -> DataFrame:
        """Each key once, with its documents over the runs."""
        paths = [*(p for level in self.levels for p in level), *self.again] if paths is None else paths
        runs = self.spark.read.schema("h1 long, h2 long, n long")
        table = runs.parquet(*paths) if paths else self.spark.createDataFrame([], "h1 long, h2 long, n long")
        return table if len(paths) == 1 else table.groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def frequent(self) -> DataFrame:
        return self.counts().where(F.col("n") >= self.min_docs)

    def add(self, docs: DataFrame, text: str = "text") -> None:
        """Takes in a batch of documents."""
        keys = docs.select(F.explode(F.array_distinct(line_keys(F.col(text)))).alias("k")).where(F.length("k") >= 1)
        own = keys.select(*_hashes(F.col("k"))).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
        if any(self.levels):
            own = stored(own, "line-batch")
            known = stored(self.frequent().select("h1", "h2"), "line-known")
            path = self._path("again")
            own.join(known, ["h1", "h2"], "left_semi").write.parquet(path)
            own = own.join(known.hint("merge"), ["h1", "h2"], "left_anti")
            self.again.append(path)
        self._write(own, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self.counts(full), level + 1)
            level += 1


def drop_frequent_lines(docs: DataFrame, runs: LineRuns, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Adds n_lines, n_dropped and kept_text: the text without the lines of frequent keys."""
    body = F.coalesce(F.col(text), F.lit(""))
    # The text's hash keeps rows apart that share an id by mistake; equal rows have equal answers.
    known = docs.withColumn("__th", F.xxhash64(body))
    lines = known.select(F.col(key).alias("__id"), "__th", F.posexplode(F.split(body, "\n", -1)).alias("__pos", "__line"))
    lines = lines.select("__id", "__th", "__pos", *_hashes(strip_white(lower_ascii(F.col("__line")))))
    frequent = stored(runs.frequent(), "line-frequent")
    total = frequent.agg(F.sum("n")).first()[0] or 0
    dropped = join_skewed(lines, frequent, ["h1", "h2"], "n", total).groupBy("__id", "__th").agg(F.collect_set("__pos").alias("__gone"))
    joined = known.join(dropped, F.col(key).eqNullSafe(F.col("__id")) & (known["__th"] == dropped["__th"]), "left").drop(dropped["__th"])
    # The lines are a column that is used more than once, so the text is split once a row.
    out = joined.withColumn("__lines", F.split(body, "\n", -1))
    places = F.sequence(F.lit(0), F.size("__lines") - 1)
    kept = F.array_except(places, F.coalesce(F.col("__gone"), F.array().cast("array<int>")))
    out = out.withColumns({"__kept": kept, "n_lines": F.size("__lines").cast("long"), "__first": F.element_at("__lines", 1)})
    out = out.withColumns(
        {
            "n_dropped": (F.col("n_lines") - F.size("__kept")).cast("long"),
            "kept_text": F.when(F.size("__kept") == F.col("n_lines"), body).otherwise(
                F.array_join(F.transform(F.col("__kept"), lambda i: F.element_at(F.col("__lines"), i + 1)), "\n")
            ),
        }
    )
    return out.drop("__id", "__th", "__gone", "__kept", "__lines", "__first")


def line_dedup(docs: DataFrame, min_docs: int = 10, batches: int = 3, fanout: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Documents without the lines whose key at least ``min_docs`` of them hold.

    The corpus enters in ``batches`` parts, dealt by the hash of the id, as
    successive deliveries would; with the defaults the first two runs are compacted
    into one of level 1, beside which the third stays at level 0.
    """
    runs = LineRuns(docs.sparkSession, fanout=fanout, min_docs=min_docs)
    part = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(batches))
    for i in range(batches):
        runs.add(docs.where(part == i) if batches > 1 else docs, text)
    return drop_frequent_lines(docs, runs, text, key)


def op5_line_dedup(docs: DataFrame) -> DataFrame:
    """The contract's columns, from line_dedup over the whole table."""
    out = line_dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
