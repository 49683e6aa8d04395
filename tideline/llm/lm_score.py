"""Cross-entropy difference between a target and a background bigram model.

Both models share one vocabulary and one list of bigrams, have the same order
and the same smoothing.  The background is every document; the target is the
documents marked as such.  A document's score is the mean over its words of the
loss under the target less that under the background: low values read like the
target.

    P(w | v) = MU * c(v, w) / c(v) + (1 - MU) * (c(w) + 1) / (N + V + 1)

c are counts over all documents, or over the marked ones in the target model, of N
words; V words are different.  The vocabulary has every word, the bigram list every
pair that occurs twice in the corpus, at any size of the corpus; the mass of
pairs that occur once is left, in both models, for pairs not seen yet.  The
document's start is a word of its own that stands before its first.

The texts are first stored in lots of a few MB, a row each.  A lot sends each of its
words and pairs once, with its counts in all texts and in targets, to the bucket of its
hash, as sorted keys of which the differences are packed.  A bucket sums them and
sends back what the other lots add, in the order in which the keys came, so no key
travels twice; most of it is zeros, as most keys are in one lot alone.  Nothing rare is
left out, no key has more than a row a lot, and the rows and memory of a task follow the
size of buckets and lots, not of the corpus.

Defined cases: null and empty texts have no words, losses and score null, n_words
0; with no target documents the target model is uniform; repeated rows count and
score again; labels that are null or missing do not mark a target; very long texts
are handled alone; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, drop_shuffles, stored
from .decontamination import bit_array
from .tokens import _A, lots, mixed, words

MU = 0.7
#: About so many words of the corpus send their keys to one bucket.
WORDS = 1_000_000
#: Rows of a lot at most, and bytes of its texts unless one text alone has more.
LOT, LOT_BYTES = 10_000, 4 << 20
#: The word before a document's first; the lowest bit of a key is 0 for words, 1 for pairs.
START = int(mixed(np.arange(102, 103, dtype=np.uint64))[0]) & ~1
_ONE = np.uint64(1)


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of unsigned 64-bit numbers, of one length, byte by byte of their rank: the zeros above small numbers lie together."""
    x = np.stack(columns)
    return pa.compress(x.view(np.uint8).reshape(*x.shape, 8).transpose(0, 2, 1).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, columns: int) -> np.ndarray:
    flat = np.frombuffer(pa.decompress(data, 8 * n * columns, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(columns, 8, n).transpose(0, 2, 1)).view(np.uint64)[:, :, 0]


def _paired(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(mixed(v * _A) + w)


def _sequences(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word the one before it, itself, its text; and the bounds of the texts."""
    w = words(col, lower=True)
    ids = w.hashes() & ~_ONE
    before = np.empty(len(ids), np.uint64)
    before[1:] = ids[:-1]
    before[w.start[:-1][np.diff(w.start) > 0]] = START
    return before, ids, w.owner(), w.start


def _flags(col: pa.Array) -> np.ndarray:
    return np.asarray(col.cast(pa.int8())).astype(np.int64)


class _Keys:
    """The words and pairs of a lot of texts: distinct keys in order, their counts in all texts and in targets, and where each word's are."""

    def __init__(self, texts: pa.Array, targets: pa.Array) -> None:
        v, w, owner, self.start = _sequences(texts)
        flag = _flags(targets)
        full = np.flatnonzero(np.diff(self.start) > 0)
        # The start counts documents with words.
        every = np.concatenate([w, _paired(v, w) | _ONE, np.full(len(full), START, np.uint64)])
        self.keys, at = np.unique(every, return_inverse=True)
        self.owner, self.word, self.pair = owner, at[: len(w)], at[len(w) : 2 * len(w)]
        self.before = np.empty(len(w), np.int64)
        self.before[1:] = self.word[:-1]
        self.before[self.start[full]] = at[-1] if len(full) else 0
        self.n = np.bincount(at, minlength=len(self.keys)).astype(np.uint64)
        self.t = np.bincount(at, np.concatenate([flag[owner], flag[owner], flag[full]]), len(self.keys)).astype(np.uint64)


def _read(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as stream:
        return stream.read_next_batch()


def in_lots(docs: DataFrame, text: str) -> DataFrame:
    """(lot, bytes, data): the rows of docs in lots, stored; ``bytes`` are those of their texts."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for k, b in enumerate(lots(batches, at, LOT, LOT_BYTES)):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(b)
            size = sum(len(x) for x in b.column(at).cast(pa.large_binary()).to_pylist() if x)
            yield pa.RecordBatch.from_arrays([pa.array([task + k]), pa.array([size]), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["lot", "bytes", "data"])

    return stored(docs.mapInArrow(run, "lot long, bytes long, data binary"), "lots")


def _beyond(rows: pa.Table) -> pa.Table:
    """What the other lots add to each lot's keys of one bucket, in their order; the first row has the bucket's words, those in targets, and how many differ."""
    sizes = rows["n"].to_pylist()
    parts = [_unpacked(d, n, 3) for d, n in zip(rows["data"].to_pylist(), sizes, strict=True)]
    keys = np.concatenate([np.cumsum(p[0]) for p in parts])
    order = np.argsort(keys)
    k = keys[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    run = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(k)]))
    word = (k[first] & _ONE == 0) & (k[first] != START)
    facts, added = [], []
    for i in (1, 2):
        own = np.concatenate([p[i] for p in parts])[order]
        sums = np.add.reduceat(own, first)
        facts.append(int(sums[word].sum()))
        added.append(np.empty(len(k), np.uint64))
        added[-1][order] = sums[run] - own
    ends = np.cumsum([0, *sizes])
    data = [_packed(added[0][a:b], added[1][a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    fact = [pa.array([x, *[0] * (len(sizes) - 1)], pa.int64()) for x in (*facts, int(word.sum()))]
    return pa.Table.from_arrays([*(rows[c].combine_chunks() for c in ("lot", "bucket", "n")), pa.array(data, pa.binary()), *fact], ["lot", "bucket", "n", "data", "words", "marked", "size"])


def score(docs: DataFrame, text: str = "text", target: str = "target") -> DataFrame:
    """docs(text, target boolean) with n_words, loss_target, loss_background and score (target less background), per word."""
    new = ("n_words", "loss_target", "loss_background", "score")
    spark = docs.sparkSession
    bounded_batches(spark)
    slim = docs.drop(*(c for c in new if c != text)).withColumn(target, F.coalesce(F.col(target), F.lit(False)))
    names = slim.columns
    at, mark = names.index(text), names.index(target)
    held = in_lots(slim, text)
    drop_shuffles(spark)
    # A word and the space after it are about six bytes.
    buckets = 1 + (held.agg(F.sum("bytes")).first()[0] or 0) // (6 * WORDS)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for lot, data in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                b = _read(data.as_py())
                own = _Keys(b.column(at), b.column(mark))
                # Buckets are ranges of keys, so each has a slice.
                bucket = ((own.keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                first = np.flatnonzero(np.r_[len(bucket) > 0, bucket[1:] != bucket[:-1]])
                ends = np.r_[first, len(bucket)]
                blobs = [_packed(np.diff(own.keys[i:j], prepend=np.uint64(0)), own.n[i:j], own.t[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), lot)), pa.array(bucket[first].astype(np.int64)), pa.array(np.diff(ends)), pa.array(blobs, pa.binary())], ["lot", "bucket", "n", "data"])

    blobs = "lot long, bucket long, n long, data binary"
    met = held.select("lot", "data").mapInArrow(sent, blobs).groupBy("bucket").applyInArrow(_beyond, f"{blobs}, words long, marked long, size long")
    back = stored(met, "counts")
    drop_shuffles(spark)
    total, t_total, size = (x or 0 for x in back.agg(F.sum("words"), F.sum("marked"), F.sum("size")).first())
    lists = back.groupBy("lot").agg(F.collect_list(F.struct("bucket", "n", "data")).alias("added"))
    joined = held.select("lot", "data").join(lists.hint("merge"), "lot", "left").select("data", "added")

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for data, added in zip(rows.column(0), rows.column(1), strict=True):
                b = _read(data.as_py())
                own = _Keys(b.column(at), b.column(mark))
                parts = sorted(added.as_py() or (), key=lambda x: x["bucket"])
                if parts:
                    more = np.concatenate([_unpacked(x["data"], x["n"], 2) for x in parts], axis=1)
                    own.n, own.t = own.n + more[0], own.t + more[1]
                n_words = np.diff(own.start)
                # A pair that occurs once is as good as not seen.
                listed = own.n[own.pair] >= 2
                out = []
                for count, n in ((own.t.astype(float), t_total), (own.n.astype(float), total)):
                    loss = -np.log(MU * np.where(listed, count[own.pair], 0) / np.maximum(count[own.before], 1) + (1 - MU) * (count[own.word] + 1) / (n + size + 1))
                    out.append(pa.array(np.bincount(own.owner, loss, b.num_rows) / np.maximum(n_words, 1), mask=n_words == 0))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n_words.astype(np.int64)), *out], [*names, *new[:3]])

    schema = T.StructType([*slim.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("loss_target", T.DoubleType()), T.StructField("loss_background", T.DoubleType())])
    return joined.mapInArrow(losses, schema).withColumn("score", F.col("loss_target") - F.col("loss_background"))


def marked(docs: DataFrame, ids: DataFrame, key: str, target: str = "target") -> DataFrame:
    """docs with whether their key is among ids(key); only texts that may be marked, by a bit array of the ids, are dealt by key."""
    ids = stored(ids.where(F.col(key).isNotNull()).select(F.col(key).cast(docs.schema[key].dataType).alias("__key")).distinct(), "target-ids")
    n = ids.count()
    if not n:
        return docs.withColumn(target, F.lit(False))
    bits = min(1 << 25, max(1 << 16, 1 << (16 * n).bit_length()))
    array = bit_array(ids.select(F.xxhash64("__key").alias("__h")), bits)
    p = F.pmod(F.xxhash64(key), F.lit(bits))
    maybe = F.coalesce(F.col(key).isNotNull() & (F.getbit(F.get(array, F.shiftright(p, 5).cast("int")), (p % 32).cast("int")) == 1), F.lit(False))
    dealt = docs.where(maybe).join(ids.withColumn(target, F.lit(True)).hint("merge"), F.col(key) == F.col("__key"), "left").select(*docs.columns, F.coalesce(target, F.lit(False)).alias(target))
    return docs.where(~maybe).withColumn(target, F.lit(False)).unionByName(dealt)


def op2_lm_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All documents scored; the target is the documents that a label marks as of good quality."""
    docs = marked(docs.select("doc_id", "text"), labels.where("quality = 1").select("doc_id"), "doc_id")
    return score(docs).drop("text", "target")
