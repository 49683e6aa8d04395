"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Training reads labelled rows only, at most ``max_rows`` of each label in the
order of their id's hash; each stands for (labelled rows of its label / rows
taken of it) rows, so shares of the labels are those of all labels.  From these come
 * a lexicon: words, and word starts of 4 to 6 letters, whose share of toxic
   documents is far above that of clean ones, counted by a distributed sum over
   three quarters of the rows;
 * trees over the features below, fitted on the same rows, weighted; each half of
   them is measured with a lexicon learned from the other half, so that no row's
   features come from its own label;
 * an isotonic line from the trees' output to a probability, on the last quarter, weighted,
   whose labels neither lexicon nor trees have seen.

Scoring is a map over whole texts with no shuffle.  The lexicon (at most
``max_terms``) and the trees are of fixed size and travel with the task.

Features: hits and their weight per word, the largest weight, the least distance
from a hit to a second-person word, such words near a hit, shares of capitals,
of words in capitals, of exclamation and other punctuation, and rates of
obfuscated words (digits or signs among letters, letters drawn out or set apart).

Defined cases: a null text is an empty one; empty texts get the score of their
features like any other; labels that are null are not used, and a document
labelled twice counts as toxic if one label says so; of rows that share a labelled id
one is learned from; with no labels every score is 0.5; repeated rows and equal
features are scored alike; an empty table gives no scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Isotonic, Trees, fit_isotonic, fit_trees
from .common import bounded_batches
from .tokens import lots, plain, words

#: Second-person words of English, French, German and Spanish.
SECOND = frozenset("you your yours yourself u ur thou tu toi te ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer sie ihnen tú ti usted ustedes vosotros os tus su".split())
#: Signs written for letters.
LEET = str.maketrans("013457@$!", "oieastasi")
_CORE = re.compile(r"^[^\w@$]+|[^\w@$!]+$|(?<=\w)!+$")
_DRAWN = re.compile(r"(.)\1{2,}")
NEAR = 50
LOT = 500
FEATURES = (
    "log_words", "hits", "hits_per_word", "weight_per_word", "top_weight", "nearness", "second_near", "second_per_word",
    "capitals", "capital_words", "exclaims", "punctuation", "obfuscated", "drawn_out", "set_apart",
)


def normal(word: str) -> str:
    """Lower case, without signs at the ends or inside, drawn-out letters once, signs for letters read as letters."""
    w = _CORE.sub("", word.lower())
    if not w.isalpha():
        if any(c.isalpha() for c in w):
            w = w.translate(LEET)
        w = "".join(c for c in w if c.isalnum())
    return _DRAWN.sub(r"\1", w)


def terms(word: str) -> list[str]:
    """What a word may be listed under: itself and its starts."""
    w = normal(word)
    return [w, *(w[:n] + "*" for n in (4, 5, 6) if len(w) > n)] if w else []


def in_lots(batches: Iterator[pa.RecordBatch], at: int = 0) -> Iterator[pa.RecordBatch]:
    """Texts a few at a time, at most 2 MB unless one alone has more: what a task holds follows the distinct words of a lot."""
    return lots(batches, at, rows=LOT)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, kind) -> (term, kind, n): documents of the lot that hold a word under the term; kind is 2 * half + label."""
    for b in in_lots(batches):
        w = words(b.column(0), lower=False)
        kind = np.asarray(b.column(1)).astype(np.int64)
        n = max(len(w.unique), 1)
        seen = np.unique(w.owner() * n + w.code)
        counts = np.bincount((seen % n) + n * kind[seen // n], minlength=4 * n).reshape(4, n)
        sums: dict[tuple[str, int], int] = {}
        for i, word in enumerate(w.unique.to_pylist()):
            for t in terms(word):
                for y in range(4):
                    if counts[y, i]:
                        sums[t, y] = sums.get((t, y), 0) + int(counts[y, i])
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int32()), pa.array(list(sums.values()), pa.int64())], ["term", "kind", "n"])


def learn_lexicons(sample: DataFrame, max_terms: int = 8192, least: int = 2, ratio: float = 8.0) -> list[dict[str, float]]:
    """sample(text, toxic, half) -> log ratios of listed terms: from half 0, from half 1, and from both."""
    from .common import stored

    kind = (2 * F.col("half") + F.col("toxic")).cast("int").alias("kind")
    sizes = {r.kind: r.n for r in sample.select(kind).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}  # four rows
    counted = sample.select("text", kind).mapInArrow(_count_terms, "term string, kind int, n long").groupBy("term")
    counted = stored(counted.agg(*[F.sum(F.when(F.col("kind") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in range(4)]), "terms")
    out = []
    for halves in ((0,), (1,), (0, 1)):
        t, c = (sum(sizes.get(2 * h + y, 0) for h in halves) for y in (1, 0))
        if not t or not c:
            out.append({})
            continue
        of = lambda y, halves=halves: sum((F.col(f"n{2 * h + y}") for h in halves), F.lit(0))
        rows = counted.select("term", of(1).alias("t"), of(0).alias("c"))
        weight = F.log((F.col("t") + 0.5) / (t + 1.0)) - F.log((F.col("c") + 0.5) / (c + 1.0))
        # A lower bound on the ratio, so that rare terms need a clean record.
        sure = weight - F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5)) * F.when(F.col("c") > 0, 1.0).otherwise(0.5)
        best = rows.where(F.col("t") >= least).select("term", weight.alias("w"), sure.alias("s")).where(F.col("s") > float(np.log(ratio))).orderBy(F.desc("s"), "term").limit(max_terms)
        out.append({r.term: float(r.w) for r in best.collect()})
    return out


def measure(col: pa.Array, lexicon: dict[str, float]) -> np.ndarray:
    """The features of a batch of texts."""
    texts = plain(col)
    n = len(texts)
    w = words(texts, lower=False)
    unique = w.unique.to_pylist()
    k = len(unique)
    weight, second, caps, obf, drawn, single = (np.zeros(k) for _ in range(6))
    upper, punct, exclaim, chars = (np.zeros(k) for _ in range(4))
    for i, u in enumerate(unique):
        chars[i] = len(u)
        low = u.lower()
        if low != u:
            upper[i] = sum(map(str.isupper, u))
            caps[i] = upper[i] > 1 and u.upper() == u
        if u.isalpha():
            core, t = low, None
            if len(u) == 1:
                single[i] = 1
        else:
            punct[i] = sum(not x.isalnum() for x in u)
            exclaim[i] = u.count("!")
            t = _CORE.sub("", low)
            core = t
            obf[i] = bool(t) and not t.isalpha() and any(map(str.isalpha, t))
        if _DRAWN.search(core):
            drawn[i] = 1
        second[i] = core in SECOND
        best = 0.0
        for x in terms(u):
            v = lexicon.get(x, 0.0)
            best = v if v > best else best
        weight[i] = best
    owner, code = w.owner(), w.code
    per = lambda v: np.bincount(owner, v[code], n) if k else np.zeros(n)
    count = np.diff(w.start).astype(float)
    safe = np.maximum(count, 1)
    at = weight[code] if k else np.zeros(0)
    top = np.zeros(n)
    np.maximum.at(top, owner, at)
    # Distance from each hit to the nearest second-person word of its text, by rank among their places.
    hits, you = np.flatnonzero(at > 0), np.flatnonzero(second[code]) if k else np.zeros(0, np.int64)
    far, close = np.full(n, float(NEAR)), np.zeros(n)
    if len(hits) and len(you):
        right = np.searchsorted(you, hits)
        for side in (np.minimum(right, len(you) - 1), np.maximum(right - 1, 0)):
            gap = np.where(owner[you[side]] == owner[hits], np.abs(you[side] - hits), NEAR).astype(float)
            np.minimum.at(far, owner[hits], gap)
            np.add.at(close, owner[hits], gap <= 5)
    # Runs of three or more lone letters; what they spell is looked up as well.
    apart = np.zeros(n)
    lone = np.flatnonzero(single[code]) if k else np.zeros(0, np.int64)
    if len(lone):
        new = np.flatnonzero(np.r_[True, (np.diff(lone) != 1) | (owner[lone[1:]] != owner[lone[:-1]])])
        for a, b in zip(new, np.r_[new[1:], len(lone)], strict=True):
            if b - a >= 3:
                i = owner[lone[a]]
                apart[i] += 1
                v = max((lexicon.get(x, 0.0) for x in terms("".join(unique[c] for c in code[lone[a:b]]))), default=0.0)
                top[i] = max(top[i], v)
    n_hits = np.bincount(owner, at > 0, n)
    letters = np.maximum(per(chars), 1)
    return np.column_stack([
        np.log1p(count), n_hits, n_hits / safe, per(weight) / safe, top, NEAR - np.minimum(far, NEAR), close, per(second) / safe,
        per(upper) / letters, per(caps) / safe, per(exclaim) / safe, per(punct) / letters, per(obf) / safe, per(drawn) / safe, apart / safe,
    ])


@dataclass
class Model:
    """What scoring needs; its size is bounded by the training parameters."""

    lexicon: dict[str, float]
    trees: Trees
    line: Isotonic

    def score(self, col: pa.Array) -> np.ndarray:
        return np.clip(self.line(self.trees.raw(measure(col, self.lexicon))), 0.0, 1.0)


def pick(labels: DataFrame, key: str, max_rows: int = 8000) -> DataFrame:
    """labels(key, toxic) -> at most ``max_rows`` rows of each label, the first by their id's hash; ``weight``: the rows that each stands for."""
    order = F.xxhash64(F.col(key).cast("string"), F.lit("order"))
    known = labels.where(F.col("toxic").isNotNull()).groupBy(key).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).withColumn("o", order)
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [known.where(F.col("toxic") == y).orderBy("o").limit(max_rows).withColumn("weight", F.lit(max(sizes.get(y, 0) / max_rows, 1.0))) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def train(sample: DataFrame) -> Model:
    """sample(text, toxic, o, weight) -> Model; the rows are those that ``pick`` chose, one for each o, so their number is bounded."""
    from .common import stored

    fold = F.pmod(F.xxhash64("o"), F.lit(8))
    sample = stored(sample.dropDuplicates(["o"]).withColumns({"held": fold >= 6, "half": (fold % 2).cast("int")}), "toxic-sample")
    lexicons = learn_lexicons(sample.where("not held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_lots(batches):
            held, half = (np.asarray(b.column(k).cast(pa.int8())) for k in (4, 5))
            use = np.where(held == 1, 2, 1 - half)  # which lexicon: of both halves for held rows, else of the other half
            x = np.zeros((b.num_rows, len(FEATURES)))
            for k in range(3):
                at = np.flatnonzero(use == k)
                if len(at):
                    x[at] = measure(b.column(0).take(pa.array(at)), lexicons[k])
            yield pa.RecordBatch.from_arrays([*b.columns[1:5], *(pa.array(c) for c in x.T)], ["toxic", "o", "weight", "held", *FEATURES])

    # At most 2 * max_rows rows of numbers come to the driver.
    rows = sample.select("text", "toxic", "o", "weight", "held", "half").mapInArrow(run, "toxic int, o long, weight double, held boolean, " + ", ".join(f"{f} double" for f in FEATURES)).toArrow()
    rows = rows.sort_by([("o", "ascending"), ("toxic", "ascending")])
    y, weight, held = np.asarray(rows["toxic"]).astype(float), np.asarray(rows["weight"]), np.asarray(rows["held"]).astype(bool)
    x = np.column_stack([np.asarray(rows[f]) for f in FEATURES]) if len(y) else np.zeros((0, len(FEATURES)))
    if held.all():
        return Model({}, Trees(1, 0.0), Isotonic(np.zeros(0), np.zeros(0)))
    trees = fit_trees(x[~held], y[~held], weight[~held])
    return Model(lexicons[2], trees, fit_isotonic(trees.raw(x[held]), y[held], weight[held]))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the score of each text."""
    from pyspark.sql import types as T

    slim = docs if text == out else docs.drop(out)
    names = slim.columns
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_lots(batches, names.index(text)):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(b.column(names.index(text))))], [*names, out])

    return slim.mapInArrow(run, T.StructType([*slim.schema.fields, T.StructField(out, T.DoubleType())]))


def held_out(key: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 4 == 2


def op3_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: a model learned from rows that are not held out, applied to all."""
    docs = docs.select("doc_id", "text")
    picked = pick(labels.where(~held_out(F.col("doc_id"))), "doc_id")
    # Ids are chosen first, so only the texts of the training rows leave their place.
    model = train(docs.join(F.broadcast(picked), "doc_id").select("text", "toxic", "o", "weight"))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
