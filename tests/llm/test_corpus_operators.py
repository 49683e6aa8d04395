"""Operators that learn from, or look across, a corpus."""

import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.llm import boosting, common, decontamination, html_text, lm_score, toxicity


def sentence(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()) + str(rng.randint(0, 60)) for _ in range(n)]


def test_decontamination_finds_passages_with_replaced_words(spark):
    rng = random.Random(4)
    items = {i: sentence(rng, rng.randint(15, 40)) for i in range(12)} | {90: sentence(rng, 8), 91: sentence(rng, 3), 92: []}
    docs, want = [], set()
    for d in range(60):
        body = sentence(rng, rng.randint(0, 200))
        if d % 3 == 0:
            i = rng.choice([*range(12), 90])
            passage = list(items[i])
            if i != 90 and d % 2:
                for at in range(5, len(passage), 9):
                    passage[at] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = [w.upper() if d % 4 == 0 else w for w in passage]
            want.add((d, i))
        docs.append((d, (", " if d % 5 == 0 else " ").join(body), "x"))
    docs += [(100, None, "x"), (101, "", "x"), (102, " ".join(items[91]), "x"), (103, " ".join(items[2][:9]), "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(93, None)], "item_id long, text string")
    for most in (1_000_000, 0):  # broadcast, and the way beyond the bound
        got = {(r.doc_id, r.item_id) for r in decontamination.find_overlaps(frame, bench, max_broadcast=most).collect()}
        assert got == want
    kept = decontamination.decontaminate(frame, bench)
    assert kept.columns == frame.columns and kept.count() == len(docs) - len({d for d, _ in want})
    assert decontamination.op1_decontamination(frame, bench.limit(0)).count() == 0
    assert decontamination.op1_decontamination(frame.limit(0), bench).count() == 0


def test_decontamination_finds_short_items_with_any_words_replaced(spark):
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in range(5, 31)}
    docs, want = [], set()
    for n, item in items.items():
        most = n // 5
        for a in range(n):
            # One word replaced at every place, and two where the item has ten words or more; then as many as may be, and one more.
            for places in [{a}, *({a, b} for b in range(a) if n <= 20), {(a + 3 * k) % n for k in range(most)}, {k * n // (most + 1) for k in range(most + 1)}]:
                if len(places) <= most or (n <= 15 and a == 0):
                    docs.append((len(docs), " ".join(["before", "it", *("other" if k in places else w for k, w in enumerate(item)), "after"])))
                    if len(places) <= most:
                        want.add((docs[-1][0], n))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_overlaps(frame, bench).collect()}
    assert got == want


def test_lm_score_against_plain_counts(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices("a b c d".split() if i % 2 else "c d e f".split(), k=rng.randint(0, 30))) for i in range(40)] + [None, "", "zzz", "A b\tC"]
    docs = spark.createDataFrame([(i, t, i % 2 == 1) for i, t in enumerate(texts)], "doc_id long, text string, target boolean")
    got = {r.doc_id: r for r in lm_score.score(docs).collect()}
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for t in texts]

    def counts(keep):
        pairs, single = {}, {"<s>": sum(bool(x) for k, x in enumerate(words) if keep(k))}
        for k, x in enumerate(words):
            if keep(k):
                for v, w in zip(["<s>", *x], x):
                    pairs[v, w] = pairs.get((v, w), 0) + 1
                    single[w] = single.get(w, 0) + 1
        return pairs, single

    both, every = counts(lambda k: True)
    size, total = len(every) - 1, {}
    for name, keep in (("loss_target", lambda k: k % 2 == 1), ("loss_background", lambda k: True)):
        pairs, single = counts(keep)
        n = sum(single.values()) - single["<s>"]
        for k, x in enumerate(words):
            loss = 0.0
            for v, w in zip(["<s>", *x], x):
                of_pair = pairs.get((v, w), 0) if both[v, w] >= 2 else 0
                loss -= np.log(lm_score.MU * of_pair / max(single.get(v, 0), 1) + (1 - lm_score.MU) * (single.get(w, 0) + 1) / (n + size + 1))
            total[name, k] = loss / max(len(x), 1)
    for k in range(len(texts)):
        r = got[k]
        assert r.n_words == len(words[k])
        if words[k]:
            assert r.loss_target == pytest.approx(total["loss_target", k]) and r.loss_background == pytest.approx(total["loss_background", k])
            assert r.score == pytest.approx(r.loss_target - r.loss_background)
        else:
            assert r.score is None
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (3, 0)], "doc_id long, quality int")
    assert lm_score.op2_lm_score(docs, labels).count() == len(texts)
    assert lm_score.op2_lm_score(docs.limit(0), labels.limit(0)).count() == 0


def test_marks_of_lm_targets(spark):
    docs = spark.createDataFrame([(i % 50, f"t{i}", 1) for i in range(100)] + [(None, "n", 1)], "doc_id long, text string, ref int")
    ids = spark.createDataFrame([(i,) for i in range(0, 60, 3)] + [(None,), (3,)], "doc_id int")
    got = lm_score.marked(docs, ids, "doc_id").collect()
    assert sorted((r.text, r.target) for r in got) == sorted([(f"t{i}", i % 50 % 3 == 0) for i in range(100)] + [("n", False)])


def test_lm_score_counts_rare_keys_at_any_size(spark, monkeypatch):
    # Over two million words, where a floor of a millionth is above the two occurrences of "p q".
    texts = ["x " * 2_200_000, "p q", "p q", "q p", "once p", "twice p"]
    docs = spark.createDataFrame([(i, t, i in (1, 3)) for i, t in enumerate(texts)], "doc_id long, text string, target boolean")
    n, size = 2_200_010, 5
    single = {"p": 5, "q": 3, "once": 1, "twice": 1, "s": 6}
    listed = {("s", "p"): 2, ("p", "q"): 2}

    def loss(*ids):
        return -np.mean([np.log(lm_score.MU * listed.get((v, w), 0) / single[v] + (1 - lm_score.MU) * (single[w] + 1) / (n + size + 1)) for v, w in zip(("s", *ids), ids)])

    want = {1: loss("p", "q"), 2: loss("p", "q"), 3: loss("q", "p"), 4: loss("once", "p"), 5: loss("twice", "p")}
    for first in (lm_score.WORDS, 10):  # most words counted first, and sent back
        monkeypatch.setattr(lm_score, "WORDS", first)
        got = {r.doc_id: r for r in lm_score.score(docs).collect()}
        assert {k: got[k].loss_background for k in want} == pytest.approx(want)
        assert got[0].n_words == 2_200_000


def test_lm_score_moves_and_stores_few_bytes(spark, tmp_path):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randint(0, 9999)}" for _ in range(400)) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, i % 2 == 0) for i, t in enumerate(texts)], "doc_id long, text string, target boolean").coalesce(2)
    sc, there = spark.sparkContext, common.folders(spark)
    sc.setJobGroup("lm-bytes", "")
    try:
        lm_score.score(docs).write.parquet(str(tmp_path / "out"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    store, tracker, moved = sc._jsc.sc().statusStore(), sc.statusTracker(), 0
    for stage in {x for j in tracker.getJobIdsForGroup("lm-bytes") for x in tracker.getJobInfo(j).stageIds}:
        if tracker.getStageInfo(stage).numCompletedTasks:
            moved += store.lastStageAttempt(stage).shuffleWriteBytes()
    stored = sum(f.stat().st_size for d in common.folders(spark) - there for f in Path(d.removeprefix("file:")).rglob("*.parquet"))
    assert 0 < moved + stored < 3 * sum(map(len, texts))  # a row for each document's rare keys took 3.7 times


def test_isotonic_line_is_the_best_rising_fit():
    raw = np.array([0.0, 1, 1, 2, 3, 4, 5])
    line = boosting.fit_isotonic(raw, np.array([0.0, 1, 0, 0, 1, 1, 1]))
    assert np.all(np.diff(line(np.linspace(-1, 6, 50))) >= 0)
    assert line(np.array([0.0, 5.0])).tolist() == [0.0, 1.0] and line(np.array([1.0]))[0] == pytest.approx(1 / 3)


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(3)
    bad = "grubbo snarf wexel".split()
    docs, labels = [], []
    for i in range(600):
        w = sentence(rng, rng.randint(5, 60))
        toxic = rng.random() < 0.3
        if toxic:
            at = rng.randint(0, len(w))
            w[at:at] = ["you", rng.choice(bad)]
        docs.append((i, " ".join(w), "clash"))
        labels.append((i, int(toxic)))
    docs += [(1000, None, ""), (1001, "", ""), (1002, " ", "")]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    y = spark.createDataFrame([*labels, (1000, None), (5, labels[5][1])], "doc_id long, toxic int")
    rows = toxicity.op3_toxicity(d, y).collect()
    assert len(rows) == len(docs)
    truth = dict(labels)
    right = [r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth]
    assert len(right) > 100 and np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    nothing = toxicity.op3_toxicity(d, y.limit(0)).collect()
    assert {r.score for r in nothing} == {0.5}


def test_toxicity_keeps_the_share_of_labels_when_rows_are_cut(spark):
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(2000)], "doc_id long, toxic int")
    picked = toxicity.pick(labels, "doc_id", max_rows=100)
    rows = picked.select(F.lit("the same words").alias("text"), "toxic", "o", "weight")
    assert rows.count() == 200 and rows.agg(F.sum(F.col("weight") * F.col("toxic")), F.sum("weight")).first() == (200, 2000)
    # Without evidence the score is the share of toxic rows among all labels, not the half of the sample.
    assert toxicity.train(rows).score(pa.array(["the same words"]))[0] == pytest.approx(0.1, abs=0.04)


def test_weights_are_repeated_rows():
    raw, y, n = np.array([0.0, 1, 1, 2, 3]), np.array([0.0, 1, 0, 0, 1]), np.array([3, 1, 2, 5, 1])
    one, many = boosting.fit_isotonic(raw, y, n.astype(float)), boosting.fit_isotonic(np.repeat(raw, n), np.repeat(y, n))
    assert np.allclose(one(raw), many(raw))
    assert boosting.fit_trees(raw[:, None], y, n.astype(float)).base == pytest.approx(boosting.fit_trees(np.repeat(raw, n)[:, None], np.repeat(y, n)).base)


def test_toxic_words_are_read_through_disguise():
    assert toxicity.normal("M0r0n!!") == "moron" and toxicity.normal("st-up.id") == "stupid" and toxicity.normal("loooser") == "loser"
    x = toxicity.measure(pa.array(["you are an i d i o t", "fine words here", None]), {"idiot": 5.0})
    at = toxicity.FEATURES.index
    assert x[0, at("top_weight")] == 5.0 and x[0, at("set_apart")] > 0 and x[1:, at("top_weight")].tolist() == [0, 0]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><a href="/">Home</a> Site</header>
<nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-banner">We use cookies</div>
<article><h1>The &eacute;tude</h1><p>First <b>bold</b>&nbsp;&amp;
 more <a href="x">link</a>.<p>Second<!-- no --> one<div class="ad">Buy</div><script>var a="</p>";</script><ul><li>x<li>y</ul>
<div id="comments"><p>Nice!</p></div></article><aside>More</aside><form>Name <input></form><footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "The étude\nFirst bold & more link.\nSecond one\nx\ny"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p>") == ""
    assert html_text.main_text("<body><p>" + "word " * 40 + "<p><a href=x>one two three</a><nav>menu</nav>") == " ".join(["word"] * 40)
    assert html_text.main_text("<article><p>" + "<b 'x" * 2000 + "</article>") is not None
    x, y = html_text.LABELLED[:, :-1], html_text.LABELLED[:, -1]
    assert np.array_equal(html_text.trained().predict(x) >= 0.5, y == 1)


def test_extraction_keeps_rows_and_columns(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "clash"), (2, None, None, None), (1, "u", PAGE, "clash")], "page_id long, url string, html string, text string")
    rows = html_text.op9_html_text(pages).collect()
    assert sorted((r.page_id, r.n_chars, r.text) for r in rows)[0] == (1, len(html_text.main_text(PAGE)), html_text.main_text(PAGE))
    assert html_text.op9_html_text(pages.limit(0)).count() == 0


def test_html_tree_uses_words_links_and_neighbours(spark):
    used = set()

    def walk(t):
        if t.low is not None:
            used.add(html_text.FEATURES[t.feature])
            walk(t.low), walk(t.high)

    walk(html_text.trained())
    assert {"words", "links", "hint", "place"} <= used
    assert used & {"words_before", "links_before"} and used & {"words_after", "links_after"}
    x, y = html_text.LABELLED[:, :-1], html_text.LABELLED[:, -1]
    assert ((html_text.trained().predict(x) >= 0.5) == y).mean() > 0.97
    alone = x.copy()
    alone[:, 2:6] = 0  # without neighbours
    assert ((html_text.trained().predict(alone) >= 0.5) != (html_text.trained().predict(x) >= 0.5)).sum() >= 5


def test_html_by_hand():
    text, short = " ".join(["word"] * 80), " ".join(["word"] * 20)
    get = html_text.main_text
    assert get(f'<p class="notice">Cookie<p>{text}') == text
    assert get(f'<div class="search-results-article"><p>{text}</div>') == text
    assert get(f"<a href=x><div>Menu one two</div></a><p>{text}") == text
    assert get(f'<div class="layout has-sidebar"><article><p>{text}</p></article></div>') == text
    assert get(f'<div id="page-with-search"><main><h1>A title</h1><p>{text}</p></main></div>') == f"A title\n{text}"
    assert get(f'<article><p>{text}</p><section class="comments"><article><p>{short} {short}</p></article></section></article>') == text
    assert get(f"<article><h1>T</h1><p>{short}</p><p>The end</p></article><nav><a href=1>A</a></nav>") == f"T\n{short}\nThe end"
    assert get(f"<nav><a href=1>A</a></nav><article><p>{short}</p><aside>{text}</aside><p>x &amp; y</p></article><footer>f</footer>") == f"{short}\nx & y"
    # The same short block is a heading between texts and a label between links.
    assert get(f"<p>{text}<h2>Two words</h2><p>{text}") == f"{text}\nTwo words\n{text}"
    assert get(f"<div><a href=1>Home page</a></div><div>Two words</div><div><a href=2>Other page</a></div><p>{text}") == text


@pytest.mark.parametrize("tag", ["<button>", "<svg>", "<div>", '<p class="ad">', '<a "', "<a href=x>", "<script>", "<li class=menu>", "<!-- ", "<span class=ad>"])
def test_html_of_unclosed_tags_takes_linear_time(tag):
    import time

    html_text.trained()
    began = time.process_time()
    html_text.main_text(tag * (1_000_000 // len(tag)))
    assert time.process_time() - began < 2


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    rng = random.Random(9)
    item = sentence(rng, 30)
    good = [" ".join(sentence(rng, 60)) for _ in range(30)]
    rows = [g + "\nShared line" for g in good] + [good[0] + "\nShared line", " ".join(sentence(rng, 40) + item), "too short", None]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == list(corpus_pipeline.COLUMNS), name
        at.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
    kept = {r.doc_id: r for r in at.collect()}
    assert sorted(kept) == list(range(30))
    assert all(kept[i].text == good[i] and kept[i].n_chars == len(good[i]) for i in kept)
    pieces = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path))
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(range(30))


def test_nothing_in_the_library_needs_this_folder():
    from pathlib import Path

    root = Path(__file__).parents[2] / "tideline"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", f.read_text(), re.M), f



def overlaps_brute(docs, items, reach=32, min_score=12):
    """Every document, item, mask and pair of places, by the rules of the docstring."""
    import re

    def words(text):
        return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]

    found = {}
    span = 12
    for d, text in docs:
        a = words(text)
        for it, item in items:
            b = words(item)
            n = len(b)
            if n < 5:
                continue
            whole = (4 * n + 4) // 5
            short = n < 30
            blocks = n - whole + 1
            begins = {k * n // blocks for k in range(blocks)}
            four = n // blocks >= 4
            hits = set()
            for m, mask in enumerate([*decontamination.SEEDS, *decontamination.BLOCKS]):
                on = [k for k, c in enumerate(mask) if c == "1"]
                for j in range(n - len(mask) + 1):
                    if m < 4 and n < span or m == 4 and not (short and four and j in begins) or m == 5 and not (short and not four and j in begins) or m == 6 and not (n == 5 and j == 0):
                        continue
                    for i in range(len(a) - len(mask) + 1):
                        if all(a[i + k] == b[j + k] for k in on):
                            hits.add((m, i, j))
            good, best = 0, 0
            for _, i, j in hits:
                eq = [0 <= i + k < len(a) and 0 <= j + k < n and a[i + k] == b[j + k] for k in range(-reach, span + reach + 1)]
                now = top = 0
                for e in eq:
                    now = max(0, now + (1 if e else -2))
                    top = max(top, now)
                if n >= span and top >= min_score or short and sum(eq) >= whole:
                    good, best = good + 1, max(best, top)
            if good:
                found[d, it] = (good, best)
    return found


@pytest.mark.parametrize("most", [64 << 20, 1])
def test_decontamination_matches_brute_force(spark, most):
    import random

    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(n))) for k, n in enumerate([3, 5, 5, 8, 11, 12, 16, 25, 40])]
    items += [(90, items[6][1]), (91, ""), (92, None), (93, items[3][1])]
    docs = []
    for i in range(60):
        around = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))]
        part = (items[i % 9][1]).split()
        for _ in range(rng.randrange(0, 4)):
            part[rng.randrange(len(part))] = "other"
        docs.append((i, " ".join([*around, *(part[: rng.randrange(1, len(part) + 1)] if i % 3 == 0 else part), *around])))
    docs += [(100, None), (101, ""), (102, "w1 " * 3000 + items[8][1])]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_hits, r.score) for r in decontamination.find_overlaps(frame, bench, max_broadcast=most).collect()}
    want = overlaps_brute(docs, items)
    assert len(want) > 20 and got == want
