"""Operators on single texts against plain Python."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.llm import line_dedup, packing, quality_rules, url_filter, warc

TEXTS = [
    "one two three four five six one two three four five seven eight",
    "", None, " ", "\n", "a", "a\n\na\n", "Menu\nbody here\n MENU \t", "x " * 700, "word\x0bother\x1cname\u00a0end",
    "<b> # * $ % & | > plain", "SHOUT OUT LOUD " * 5, "the the the the the the end", "éß\u2028ñ  \r\nq", "Menu\nbody here\n MENU \t",
]
SCHEMA = "doc_id long, text string, lang string, n_words string, failed int, h1 int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "clash", 7, 1) for i, t in enumerate(texts)], SCHEMA)


def quality_brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = Counter(grams)
    repeat = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
    earlier, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in earlier
            earlier.add(line)
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat), n < 10 or 100 * len(repeat) > 20 * n


def test_quality_rules_match_brute_force(spark):
    got = {r.doc_id: r for r in quality_rules.op7_quality_rules(frame(spark, TEXTS)).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == quality_brute(t), t
        assert not (r.kept and r.base_failed)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té#", max_size=60) | st.none(), max_size=6))
def test_measure_matches_brute_force(texts):
    import pyarrow as pa

    cols = [c.to_pylist() for c in quality_rules.measure(pa.array(texts, pa.string()))]
    assert [tuple(c[i] for c in cols[:5]) for i in range(len(texts))] == [quality_brute(t)[:5] for t in texts]


def test_quality_ledger_policies_and_ablation(spark):
    ledger = quality_rules.evaluate(frame(spark, TEXTS))
    assert ledger.columns[:3] == ["doc_id", "text", "lang"]
    rows = quality_rules.apply_policies(ledger).collect()
    table = {r.rule: r for r in quality_rules.ablate(ledger).collect()}
    mask = quality_rules.V1.mask
    for rule in quality_rules.V1.rules:
        bit = quality_rules.BIT[rule]
        assert table[rule].n_failed == sum(bool(r.failed & bit) for r in rows)
        assert table[rule].n_failed_alone == sum(r.failed & mask == bit for r in rows)
        assert table[rule].n_kept_without == sum(r.failed & mask & ~bit == 0 for r in rows)
    assert quality_rules.op7_quality_rules(frame(spark, [])).count() == 0


def lines_brute(texts, least):
    key = lambda x: x.strip("\t\n\x0b\x0c\r ").translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            held[key(x)].add(i)
    bad = {k for k, v in held.items() if k and len(v) >= least}
    out = {}
    for i, t in enumerate(texts):
        x = (t or "").split("\n")
        keep = [y for y in x if key(y) not in bad]
        out[i] = (len(x), len(x) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest())
    return out


@pytest.mark.parametrize("least,batches,fanout", [(2, 1, 4), (2, 5, 2), (3, 3, 4)])
def test_line_dedup_matches_brute_force(spark, least, batches, fanout):
    from pyspark.sql import functions as F

    docs = frame(spark, TEXTS)
    runs = line_dedup.LineRuns(spark, min_docs=least, fanout=fanout)
    for b in range(batches):
        runs.add(docs.where(F.col("doc_id") % batches == b))
    assert sum(map(len, runs.levels)) <= (fanout - 1) * len(runs.levels) + 1
    out = line_dedup.drop_frequent_lines(docs, runs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256)).collect()
    assert {r[0]: tuple(r)[1:] for r in out} == lines_brute(TEXTS, least)


def test_line_dedup_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a\nb"), (1, "a\nb"), (None, "a\nc"), (1, "a\nd")], "doc_id long, text string")
    out = line_dedup.line_dedup(docs, min_docs=3).select("doc_id", "kept_text").collect()
    assert sorted((r[0] or 0, r[1]) for r in out) == [(0, "c"), (1, "b"), (1, "b"), (1, "d")]
    assert line_dedup.op5_line_dedup(docs.limit(0)).count() == 0


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate({c: c + 32 for c in range(65, 91)}), re.match(r"[^?#]*", rest[len(host) :])[0]


def url_brute(url, rules):
    host, path = host_path(url)
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, "allow")))


URLS = [
    "http://a.example.com/en/7", "http://EXAMPLE.com/en/70?x#y", "https://b.com/en/", "https://b.com/en", "ftp://x.net/de/8", "http://example.net/de/8a", "http://com/en/z",
    None, "", "no url", "http://", "http://notexample.com/en/7", "http://q.org/es/1#f", "http://q.org?/es/", "a://b://c/en/", "http://x.com:80/en/1", "http://b.com/en/", "http://é.org/es/é",
]


#: As the contract says them.
CONTRACT = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


@pytest.mark.parametrize("max_bits", [1 << 23, 63])
def test_url_rules_match_brute_force(spark, max_bits):
    assert sorted(url_filter.RULES) == sorted(CONTRACT)
    urls = [*URLS, *URLS[:5], "http://x.y.example.net/de/8", "http://example.net/de/9"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, k string")
    got = url_filter.judge_urls(pages, max_bits=max_bits).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == url_brute(urls[r.page_id], CONTRACT)
    assert url_filter.op10_url_filter(pages.limit(0)).collect() == []
    none = url_filter.judge_urls(pages, rules=(), default="block").collect()
    assert {(r.rule, r.verdict) for r in none} == {(None, "block")} and len(none) == len(urls)


@pytest.mark.parametrize("max_bits", [1 << 23, 1000])
def test_cascade_is_exact_over_its_universe(spark, max_bits):
    listed = spark.range(0, 4000, 8).selectExpr("concat('k', id) k")
    universe = spark.range(4000).selectExpr("concat('k', id) k")
    cascade = url_filter.build_cascade(listed, universe.union(universe), first_rate=0.3, rate=0.5, max_bits=max_bits)
    assert all(63 * len(x.words) <= max(max_bits, 63) for x in cascade.levels)
    assert len(cascade.shards) > 1 if max_bits == 1000 else len(cascade.levels) > 2
    from pyspark.sql import functions as F

    held = universe.where(cascade.holds(F.col("k"))).collect()
    assert {r.k for r in held} == {f"k{i}" for i in range(0, 4000, 8)}
    assert url_filter.build_cascade(listed.limit(0), universe).levels == []


PAGES = [(3, "http://a", "x" * 150), (1, "http://b\r\nc", "x" * 150), (2, None, "x" * 150), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "é", "é" * 60), (None, "n", "y" * 200)]


def test_warc_rebuilds_records_of_a_crowded_payload(spark, monkeypatch):
    monkeypatch.setattr(warc, "CROWD", 3)
    pages = spark.createDataFrame([(i, f"u{i}", "y" * 200 if i < 20 else f"own {i}") for i in range(40)], "page_id long, url string, html string")
    folder = "file:///" + str(spark.conf.get("spark.checkpoint.dir"))[7:].lstrip("/") + "/warc-crowd"
    warc.write_archive(pages, folder)
    back = {r.page_id: bytes(r.payload) for r in warc.reconstruct(spark, folder).collect()}
    assert back == {r.page_id: r.html.encode() for r in pages.collect()}


def test_ablation_matches_the_ledger(spark):
    docs = frame(spark, TEXTS)
    ledger = [r.failed for r in quality_rules.evaluate(docs).collect()]
    mask = quality_rules.V1.mask
    for r in quality_rules.ablate(quality_rules.evaluate(docs)).collect():
        bit = quality_rules.BIT[r.rule]
        assert r.n_failed == sum(bool(f & bit) for f in ledger)
        assert r.n_failed_alone == sum(f & mask == bit for f in ledger)
        assert r.n_kept_without == sum(f & mask & ~bit == 0 for f in ledger)


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, digest int")
    rows = {r.page_id: r for r in warc.op6_warc(pages).collect()}
    first = {}
    for i, _, h in sorted(PAGES, key=lambda p: p[0] or 0):
        body = (h or "").encode()
        r = rows[i]
        refers = first.setdefault(body, i) if len(body) >= 100 else i
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", refers) if refers != i else ("response", None))
    folder = "file:///" + str(spark.conf.get("spark.checkpoint.dir"))[7:].lstrip("/") + "/warc-test"
    warc.write_archive(pages, folder)
    back = {r.page_id: r for r in warc.reconstruct(spark, folder).collect()}
    for i, _, h in PAGES:
        body = (h or "").encode()
        r = back[i]
        assert bytes(r.payload) == body
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode())
        assert block == (body if r.record_type == "response" else b"") + b"\r\n\r\n"
    assert spark.read.parquet(f"{folder}/payloads").count() == len({(h or "").encode() for _, _, h in PAGES})
    assert warc.op6_warc(pages.limit(0)).count() == 0


PACK_TEXTS = [*TEXTS, "a  b", " lead", "trail ", "tab\tbed", "line\n\nline", "it's we'll x\n y", "long word " * 1500, "<|endoftext|> is a token", "a <|endoftext|><|endoftext|>b <|endoftext|", "x<|startoftext|> \u00e9<|endoftext|>\n", "12 345\nBig,\nend. 'tis", "x" * 3000]


def test_packing_against_the_tokenizer(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rows = packing.op8_packing(frame(spark, PACK_TEXTS)).collect()
    of = defaultdict(list)
    windows = defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    for i, text in enumerate(PACK_TEXTS):
        ids, at = [*t.encode(text or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(of[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_packing_of_nothing_and_of_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None), (3, "a b"), (3, "a b")], "doc_id long, text string")
    assert packing.op8_packing(docs.limit(0)).collect() == []
    rows = packing.op8_packing(docs).collect()
    assert sorted((r.doc_id or 0, r.start, r.length) for r in rows) == [(0, 0, 1), (0, 0, 3), (3, 0, 3), (3, 0, 3)]
    assert sorted(r.offset for r in rows) == [0, 3, 6, 9]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60))
def test_best_fit_decreasing_matches_brute_force(lengths):
    where, offset = packing.best_fit_decreasing(lengths, 16)
    rooms = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fit = [(r, -k) for k, r in enumerate(rooms) if r >= lengths[i]]
        if not fit:
            rooms.append(16)
        room = min(fit)[0] if fit else 16
        assert offset[i] == 16 - room
        rooms[rooms.index(room)] -= lengths[i]
    used = np.bincount(where, weights=lengths, minlength=len(rooms)) if lengths else []
    assert sorted(16 - u for u in used) == sorted(rooms)
