"""Quality rules kept as a ledger of failure bits and measurements.

``evaluate`` runs every rule once over every text and stores its measurements
and one bit per rule that it fails.  Policies are later applied to the bits
alone: a policy is a version and the set of rules that reject, so a new policy
or an ablation never reads a text again.

Measuring works on Arrow batches with flat NumPy arrays: the windows of five
words of a lot of texts are hashed at once, and a sort finds repeats.  A lot has
at most 2 MB of text unless one text alone has more, and what it took is given
back before the next; nothing is shuffled.  A task's memory is bounded by that and
by the bytes of an Arrow batch (``common.bounded_batches``).

Defined cases: null and empty texts have no words, all measurements 0, and fail
``few_words``; a text under five words has no window; repeated rows are measured
alike, those with a null or shared id too; other columns are passed on, but for those
named like a measurement or ``failed``, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches
from .tokens import lots, plain, windows, words

#: Measurements in the ledger, all long.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_alpha", "n_caps", "n_long_words", "n_stutter")


@dataclass(frozen=True)
class Rule:
    """A name and the SQL condition, over the measurements, on which a text fails."""

    name: str
    fails: str


#: The bit of a rule is its place; rules are only ever appended.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "n_dup_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 16 * n_words"),
    Rule("few_letters", "2 * n_alpha < word_chars"),
    Rule("shouting", "2 * n_caps > n_alpha AND n_alpha > 0"),
    Rule("stutter", "3 * n_stutter > n_words"),
)
BIT = {r.name: 1 << i for i, r in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version and the rules that reject a text under it."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
V1 = Policy("v1", tuple(r.name for r in RULES))
POLICIES = (BASE, V1)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_WORD_CHAR = (np.arange(256) & 0xC0) != 0x80
_WORD_CHAR[[9, 10, 11, 12, 13, 32]] = False


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between bounds, 0 for empty spans."""
    out, full = np.zeros(len(bounds) - 1, np.int64), bounds[1:] > bounds[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, bounds[:-1][full], dtype=np.int64)
    return out


def _repeated(owner: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which entries have their (owner, key) more than once."""
    order = np.lexsort((key, owner))
    o, k = owner[order], key[order]
    same = (o[1:] == o[:-1]) & (k[1:] == k[:-1])
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def measure(col: pa.Array) -> list[pa.Array]:
    """The measurements of a batch of texts, in the order of MEASURES."""
    texts = plain(col)
    n = len(texts)
    w = words(texts, lower=False)
    n_words = np.diff(w.start)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    word_chars, n_symbols = _per_text(_WORD_CHAR[raw], bounds), _per_text(_SYMBOL[raw], bounds)

    repeat = np.zeros(len(w.code), bool)
    x, at = windows(w.hashes(), w.start, 5)
    if len(x):
        twice = at[_repeated(w.owner()[at], x)]
        steps = np.zeros(len(w.code) + 1, np.int64)
        np.add.at(steps, twice, 1)
        np.add.at(steps, twice + 5, -1)
        repeat = np.cumsum(steps)[:-1] > 0
    n_repeat = _per_text(repeat, w.start)

    lines = pc.split_pattern(texts, "\n")
    offsets = np.asarray(lines.offsets).astype(np.int64)
    offsets = offsets - offsets[0]
    flat = lines.flatten()
    owner = np.repeat(np.arange(n), np.diff(offsets))
    full = np.asarray(pc.not_equal(pc.ascii_trim_whitespace(flat), "")).astype(bool)
    code = np.asarray(flat.dictionary_encode().indices).astype(np.int64)[full]
    own = owner[full]
    distinct = np.unique(own * (code.max() + 1) + code) // (code.max() + 1) if len(code) else own
    n_dup = np.bincount(own, minlength=n) - np.bincount(distinct, minlength=n)

    # Letters and capitals by word: each distinct word once.
    text_of = w.unique.to_pylist()
    alpha = np.fromiter((sum(map(str.isalpha, t)) for t in text_of), np.int64, len(text_of))
    caps = np.fromiter((sum(map(str.isupper, t)) if not t.islower() else 0 for t in text_of), np.int64, len(text_of))
    long = np.fromiter((len(t) > 40 for t in text_of), np.int64, len(text_of))
    by_word = [_per_text(v[w.code] if len(v) else np.zeros(0, np.int64), w.start) for v in (alpha, caps, long)]
    of = w.owner()
    again = np.zeros(len(w.code), bool)
    again[1:] = (w.code[1:] == w.code[:-1]) & (of[1:] == of[:-1])
    found = [n_words, word_chars, n_symbols, n_dup, n_repeat, np.diff(offsets), *by_word, _per_text(again, w.start)]
    return [pa.array(v.astype(np.int64)) for v in found]


def evaluate(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ledger: docs with the measurements and ``failed``, a bit per rule."""
    names = docs.columns
    clash = [c for c in names if c in MEASURES or c == "failed"]
    docs = docs.drop(*clash)
    names = docs.columns
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lots(batches, names.index(text)):
            yield pa.RecordBatch.from_arrays([*b.columns, *measure(b.column(names.index(text)))], [*b.schema.names, *MEASURES])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(m, T.LongType()) for m in MEASURES)])
    bits = [F.when(F.expr(r.fails), 1 << i).otherwise(0) for i, r in enumerate(rules)]
    failed: Column = F.lit(0).cast("long")
    for b in bits:
        failed = failed.bitwiseOR(b.cast("long"))
    return docs.mapInArrow(run, schema).withColumn("failed", failed)


def passes(policy: Policy) -> Column:
    return F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0


def apply_policies(ledger: DataFrame, policies: Sequence[Policy] = POLICIES) -> DataFrame:
    """Adds kept_<version> for each policy."""
    return ledger.withColumns({f"kept_{p.version}": passes(p) for p in policies})


def ablate(ledger: DataFrame, policy: Policy = V1) -> DataFrame:
    """Per rule of a policy: texts that fail it, that fail it alone, and that the policy keeps without it.

    The ledger is first summed by its bits: at most 2 ** len(RULES) rows.
    """
    by_bits = ledger.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    under = F.col("failed").bitwiseAND(F.lit(policy.mask))
    parts = []
    for r in policy.rules:
        rest = F.lit(policy.mask & ~BIT[r])
        parts.append(
            F.struct(
                F.lit(policy.version).alias("version"),
                F.lit(r).alias("rule"),
                F.sum(F.when(F.col("failed").bitwiseAND(F.lit(BIT[r])) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
                F.sum(F.when(under == BIT[r], F.col("n")).otherwise(0)).alias("n_failed_alone"),
                F.sum(F.when(F.col("failed").bitwiseAND(rest) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
            )
        )
    return by_bits.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def op7_quality_rules(docs: DataFrame) -> DataFrame:
    """The contract's columns, from the ledger and the policies base and v1."""
    out = apply_policies(evaluate(docs.select("doc_id", "text")))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~F.col("kept_base")).alias("base_failed"), F.col("kept_v1").alias("kept"), F.col("failed").alias("failed_rules"),
    )
