"""The Jaccard self-join against all pairs in plain Python."""

import random
import re

import pytest

from tideline.llm import ngram_join
from tideline.llm.components import components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def corpus(seed, groups=8, size=6, words=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 5)))
    passage = [word() for _ in range(55)]
    out = [None, "", "  ", "One two", "one TWO", "one two three", "one\x0btwo", "é é", "a b c d e"]
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(5, words))]
        for _ in range(rng.randint(1, size)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = word()
            out.append(" ".join(own))
    out += [" ".join(passage + [word() for _ in range(rng.randint(0, 90))]) for _ in range(groups)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed,long,shared", [(1, 64, 32), (2, 2, 3), (3, 3, 1)])
def test_matches_brute_force(spark, monkeypatch, seed, long, shared):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    texts = corpus(seed, groups=6 if seed > 1 else 12)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, cls int").repartition(3)
    out, _ = ngram_join.near_duplicates(docs, long=long, shared=shared)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute(texts)


def test_pairs_that_meet_by_chance_send_no_prefixes(spark, monkeypatch):
    sizes, stored = {}, ngram_join.stored

    def counted(df, name):
        out = stored(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "stored", counted)
    shared = [f"s{i}" for i in range(16)]
    texts = [" ".join([f"{i}a{j}" for j in range(44)] + shared + [f"{i}b{j}" for j in range(44)]) for i in range(30)]
    texts += [texts[0] + " more", texts[1].replace("1a7", "other")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out, _ = ngram_join.near_duplicates(docs, shared=1000)  # no shingle is put last
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute(texts)
    assert 4 <= sizes["prefix-sets"] <= 8  # but for the two near copies and theirs, all 32 meet others in one passage alone


def test_empty_table(spark):
    assert ngram_join.op4_ngram_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("few", [500_000, 0])
def test_components_of_chains_and_stars(spark, monkeypatch, few):
    from tideline.llm import components as module

    monkeypatch.setattr(module, "FEW", few)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(300, 299), (298, 300), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()}
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {i: 298 for i in (298, 299, 300)}
    assert got == want


def test_slices_are_read_like_whole_batches():
    import pyarrow as pa

    col = pa.array([f"Word{i} and More Words é{i} here now" for i in range(50)])
    whole = ngram_join.class_hashes(*ngram_join.shingle_sets(col, 5), 50)[1]
    parts = [ngram_join.class_hashes(*ngram_join.shingle_sets(col.slice(i, 7), 5), len(col.slice(i, 7)))[1] for i in range(0, 50, 7)]
    assert [x for p in parts for x in p.tolist()] == whole.tolist()
