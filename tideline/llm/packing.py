"""Packing token streams into windows: best-fit decreasing with a segment tree.

A document's ids end with a terminator.  Documents over a window are first cut
into full windows; what is left, and every shorter document, is packed best-fit
decreasing: pieces in falling order of length, each into the open window with the
least room that still holds it.  Windows are kept by their remaining room, and a
segment tree over the rooms 0 to ``window`` finds the tightest one in
log2(window) steps, whatever the number of windows.

Documents are dealt at random by the hash of their id and text into groups of
about ``group_tokens`` tokens, each packed on its own: a task holds the lengths of
one group, never ids, and the waste is at most a few open windows per group.
Window numbers start at group * 2**32.

Texts are encoded whole, one at a time; only lengths and a checksum of each piece
leave the task that encodes them.

Defined cases: a null or empty text is the terminator alone; a null id stays null;
the name of an added token in a text is that token; repeated rows are
packed as further documents; equal lengths are packed in the order of the ids'
hash, so a rerun gives the same windows; an empty table gives no pieces.
"""

from __future__ import annotations

import base64
import json
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored
from .tokens import lots, plain


class Encoder:
    """A byte-level BPE vocabulary; ids of a text as little-endian unsigned 32-bit bytes.

    ``ranks`` is a file of base64 tokens and their ids, the form in which tiktoken
    reads the vocabulary that the tokenizers library reads as JSON (``definition``).
    The JSON's added tokens are taken over, so the name of one in a text gives its
    id, as with that library; both give the same ids, which the tests hold against
    each other.
    """

    def __init__(self, ranks: str, pattern: str, definition: str):
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(token): int(i) for token, i in map(bytes.split, f)}
        with open(definition, encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self._t = tiktoken.Encoding(ranks, pat_str=pattern, mergeable_ranks=table, special_tokens=added)

    def encode(self, text: str) -> bytes:
        return array("I", self._t.encode(text, allowed_special="all")).tobytes()


class RoomTree:
    """Open windows by remaining room; a segment tree tells the least room of at least n."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.used = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, room: int, window: int) -> None:
        self.at[room].append(window)
        i = room + self.size
        while i:
            self.used[i] += 1
            i >>= 1

    def take(self, n: int) -> tuple[int, int] | None:
        """Removes and returns (room, window) of the tightest window with room for n."""
        i = n + self.size
        if not self.used[i]:
            while i > 1 and (i & 1 or not self.used[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.used[2 * i] else 2 * i + 1
        room = i - self.size
        while i:
            self.used[i] -= 1
            i >>= 1
        return room, self.at[room].pop()


def best_fit_decreasing(lengths: Iterable[int], window: int) -> tuple[np.ndarray, np.ndarray]:
    """The window and the offset of each piece; lengths are 1 to ``window``."""
    lengths = np.asarray(list(lengths) if not isinstance(lengths, np.ndarray) else lengths, np.int64)
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, n = RoomTree(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        found = tree.take(size)
        room, at = found or (window, n)
        n += found is None
        where[i], offset[i] = at, window - room
        if room > size:
            tree.add(room - size, at)
    return where, offset


def pieces(docs: DataFrame, tokenizer: tuple[str, str, str], window: int, end_id: int, text: str, key: str) -> DataFrame:
    """key, order, start, length, ids_crc32, doc_tokens of each piece; ids themselves are not kept."""
    kind = dict(docs.dtypes)[key]
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*tokenizer)
        end = array("I", [end_id]).tobytes()
        for part in lots(batches, 1, rows=512):
            rows: list[tuple[int, int, int, int, int]] = []
            for i, text_i in enumerate(plain(part.column(1)).to_pylist()):
                ids = encoder.encode(text_i) + end
                n = len(ids) // 4
                rows += [(i, s, min(window, n - s), zlib.crc32(ids[4 * s : 4 * (s + window)]), n) for s in range(0, n, window)]
            cols = np.asarray(rows, np.int64).reshape(-1, 5).T
            at = pa.array(cols[0])
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(2).take(at), *(pa.array(c) for c in cols[1:])], names)

    names = [key, "order", "start", "length", "ids_crc32", "doc_tokens"]
    slim = docs.select(F.col(key), F.col(text), F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("order"))
    return slim.mapInArrow(run, f"`{key}` {kind}, order long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(
    docs: DataFrame, tokenizer: tuple[str, str, str], window: int = 1024, end_id: int = 0, group_tokens: int = 4_000_000, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Pieces of all documents with sequence_id and offset, packed best-fit decreasing.

    ``tokenizer``: what Encoder takes, files that every executor has and the pattern.
    """
    cut = stored(pieces(docs, tokenizer, window, end_id, text, key), "pieces")
    total = cut.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    out_schema = f"`{key}` {dict(docs.dtypes)[key]}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("order", "ascending"), ("start", "ascending")])
        where, offset = best_fit_decreasing(np.asarray(t["length"]), window)
        base = int(t["group"][0].as_py()) << 32
        t = t.drop_columns(["group", "order"])
        return t.append_column("sequence_id", pa.array(where + base)).append_column("offset", pa.array(offset))

    # By its own hash and place, so a long document or a third of equal texts spreads over the groups.
    group = F.pmod(F.xxhash64("order", key, "start"), F.lit(groups))
    return cut.withColumn("group", group).groupBy("group").applyInArrow(run, out_schema)


def op8_packing(docs: DataFrame) -> DataFrame:
    """The contract's pieces, over the whole table."""
    import public_tokenizers

    tokenizer = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json"))
    return pack(docs.select("doc_id", "text"), tokenizer)
