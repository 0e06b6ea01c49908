"""Chat, toxicity, HTML, nearest neighbours, Jaccard join, pipeline."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
from cases import AWKWARD, LONG, docs
from pyspark.sql import functions as F

from gridobs.llm import ann, chat, html, jaccard, packing, quality, queries, toxicity

SF = "/root/testdata/sf0.001"


# --- operator 3


def test_chat_reads_back(spark):
    rows = [(1, 1, "assistant", "no </turn>\n### user: x"), (1, 0, "user", None), (1, 2, None, "\\"), (1, 2, None, "\\"), (None, None, "assistant", ""), (2, 5, "assistant", "é漢😀" * 999), (3, 0, "a: b", "# < : \\#")]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "conv_id long, turn long, role string, text string, n_turns int, formatted string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(chat.with_tricky(df))).collect()}
    assert set(got) == {1, None, 2, 3, -7}
    for key, r in got.items():
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows + chat.TRICKY if c == key))
        said = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256, r.rewrites_history) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), False)
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_finds_templates_that_rewrite_history():
    counts = lambda turns: f"{len(turns)}|" + "".join(f"[{r}]{t};" for r, t in turns)
    out, spans, rewrote = chat.locate([("u", "aa"), ("v", "bb")], counts)
    assert rewrote[1] and out == "2|[u]aa;[v]bb;"
    strips = lambda turns: "".join(f"<{r}>{t if k == len(turns) - 1 else t.strip()}" for k, (r, t) in enumerate(turns))
    assert chat.locate([("u", "hi "), ("v", "x")], strips)[2] == [False, True]
    out, spans, rewrote = chat.locate([("u", "<b"), ("v", "")], chat.marked_template)
    assert [out[a:b] for _, _, a, b in spans] == [r"\<b", ""] and not any(rewrote) and chat.locate([], chat.marked_template)[1] == []


# --- operator 5


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(4)
    clean = ["".join(rng.choices(["on", "er", "th", "an", "re", "ti"], k=rng.randint(1, 4))) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        w = rng.choices(clean, k=rng.randint(5, 80))
        bad = i % 5 == 0
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["blurgh", "snarfle", "Blurghing"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    df, lab = docs(spark, rows + AWKWARD[2:5]), spark.createDataFrame([*labels, (0, 0), (None, 1), (9999, 1)], "doc_id long, toxic int")
    out = toxicity.score(df, toxicity.train(df, lab, toxicity.learnable()))
    assert sorted(out.columns) == sorted(df.columns)
    got = out.withColumn("held", ~toxicity.learnable()).collect()
    held = [(r.doc_id % 5 == 0, r.score >= toxicity.REJECT) for r in got if r.held and r.text and r.doc_id > 10]
    assert len(got) == len(rows) + 3 and sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got) and not any(r.score >= toxicity.REJECT for r in got if not (r.text or "").strip())
    one_class = toxicity.train(df, lab.where("toxic = 0"), toxicity.learnable())
    assert toxicity.score(df, one_class).where("score > 0.01").count() == 0
    assert toxicity.score(docs(spark, []), one_class).count() == 0


def plain_grams(text):
    """Buckets of the character n-grams of a text, each hashed for itself."""
    said = re.sub(r"\s+", " ", f" {text or ''} ".lower())
    out = set()
    for n in toxicity.ORDERS:
        for i in range(len(said) - n + 1):
            total = sum(ord(c) * int(m) for c, m in zip(said[i : i + n], toxicity._MULTIPLIERS)) % 2**64
            out.add(((total ^ (total >> 31)) * (0x9E3779B97F4A7C15 + 2 * n) % 2**64) >> (64 - toxicity.BITS))
    return out


def test_toxicity_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "Gamma", "delta", "é漢"], k=6)) + (" blurgh" if i % 4 == 0 else "")) for i in range(80)]
    labels = [(i, int(i % 4 == 0)) for i in range(60)]
    df, lab = docs(spark, rows + [(100, None), (101, "")]), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(df, lab, F.lit(True), max_features=50)
    grams = {i: plain_grams(t) for i, t in rows}
    n1, n0 = sum(y for _, y in labels), sum(1 - y for _, y in labels)
    count = {b: [sum(b in grams[i] for i, y in labels if y == k) for k in (0, 1)] for b in set().union(*(grams[i] for i, _ in labels))}
    chi = {b: (t / n1 - c / n0) ** 2 / (((t + c) / 60) * (1 - (t + c) / 60) + 1e-9) for b, (c, t) in count.items()}
    best = sorted(chi, key=lambda b: (-chi[b], b))[:50]
    assert chi[best[-1]] == pytest.approx(min(chi[int(b)] for b in model.buckets)) and len(model.buckets) == 50
    ratio = np.array([np.log((count[int(b)][1] + 1) / (n1 + 2)) - np.log((count[int(b)][0] + 1) / (n0 + 2)) for b in model.buckets])
    used = ratio != 0
    w = np.divide(model.weights, ratio, where=used, out=np.zeros(50))
    x = np.array([[int(b) in grams[i] for b in model.buckets] for i, _ in labels]) * ratio
    y = np.array([v for _, v in labels])
    share = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    slope = x.T @ ((1 / (1 + np.exp(-(x @ w + model.bias))) - y) * share) + 1e-3 * w
    start = x.T @ ((0.5 - y) * share)
    assert np.linalg.norm(slope) < 0.05 * np.linalg.norm(start)
    at = {int(b): v for b, v in zip(model.buckets, model.weights)}
    for r in toxicity.score(df, model, out="tox").collect():
        z = model.bias + sum(at.get(b, 0.0) for b in plain_grams(r.text))
        assert r.tox == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-9)


def test_toxicity_awkward_rows(spark):
    rows = [(1, "fine words here"), (1, "fine words here"), (None, "blurgh no id"), (2, "x " * 300_000 + "blurgh"), (3, None)]
    lab = spark.createDataFrame([(1, 0), (2, 1), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs(spark, rows), toxicity.train(docs(spark, rows), lab, F.lit(True))).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    none = toxicity.train(docs(spark, rows), lab.limit(0), F.lit(True))
    assert toxicity.score(docs(spark, rows), none).where("score < 0.001").count() == 5


# --- operator 6

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><a href="/">Home</a></header><nav><ul><li><a href=x>One</a></li></ul></nav>
<!-- <p>no</p> --><div class="ad">Buy now, this is a long advert with a lot of words and a full stop.</div><article><h1>Head&amp;line</h1><p><b>First &lt;para&gt;&nbsp;with
 space.<br><p>Second one<div class="share">Share this</div><form>Your mail</form></article><section id="comments"><p>A reader said a rather long thing about all this, in many words.</p></section><footer>&copy; 2020</footer>"""


def test_html_main_text(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 7), (1, "u", PAGE, 7), (2, None, None, 7), (3, "u", "", 7), (4, "u", "<p>" + "word " * 30_000, 7), (None, "u", "<<<>>> &amp", 7)], "page_id long, url string, html string, text int")
    got = html.extract(df).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == 6 and text[1] == "Head&line\nFirst <para> with space.\nSecond one" and text[2] == text[3] == "" and len(text[4]) == 5 * 30_000 - 1
    assert all(r.n_chars == len(r.text) for r in got) and html.extract(df.limit(0)).count() == 0


PROSE = "A sentence of the article that goes on for quite a few words, as such sentences do, and then it comes to its end."


def test_the_cut_turns_labels():
    page = f"<body><article><h1>T</h1><p>{PROSE}</p><section class='related-work'><h2>Related work</h2><p>{PROSE}</p></section><p>{PROSE}</p><div class='share'>Share this</div></article>"
    found = html.blocks(page)
    assert [html.evidence(b) > 0 for b in found] == [True, True, False, True, True, False]
    assert html.main_text(page) == "\n".join(["T", PROSE, "Related work", PROSE, PROSE])


@pytest.mark.parametrize(("page", "text"), [
    (f"<div class='layout has-sidebar'><article><p>{PROSE}</p></article><div class=sidebar><p>{PROSE}</p></div></div>", PROSE),
    ("<article><p>A super<wbr>cali<img src=x>fragilistic word, of which<br>there are not too many.</p></article>", "A supercalifragilistic word, of which there are not too many."),
    (f"<article><!--><p>{PROSE}</p><!---><p>{PROSE}</p><!-- <p>no</p> --></article>", f"{PROSE}\n{PROSE}"),
    (f"<article><p>{PROSE}</p><section id=comments><p>{PROSE}</p><p>{PROSE}</p></section></article>", PROSE),
    # names of wrappers, and of sections that tell of such things
    (f"<div class='main has-share'><p>{PROSE}</p><p>{PROSE}</p></div>", f"{PROSE}\n{PROSE}"),
    (f"<div class='layout no-sidebar'><div class=content><h1>Title</h1><p>{PROSE}</p></div></div><footer>All rights reserved.</footer>", f"Title\n{PROSE}"),
    (f"<div id=wrapper-nav><div class=post><p>{PROSE}</p><p>{PROSE}</p></div></div>", f"{PROSE}\n{PROSE}"),
    (f"<article><h1>Title</h1><p>{PROSE}</p><section class=share><p>{PROSE}</p></section><p>{PROSE}</p></article>", f"Title\n{PROSE}\n{PROSE}\n{PROSE}"),
    (f"<article><p>{PROSE}</p><div class=share-of-wages><p>{PROSE}</p><p>{PROSE}</p></div></article>", f"{PROSE}\n{PROSE}\n{PROSE}"),
    (f"<form action=/><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{PROSE}</p></article><input><label>Your mail</label></form>", f"Title\n{PROSE}"),
    # real shares, adverts, readers' articles, cards in an aside and a site's heading stay out
    (f"<article><p>{PROSE}</p><div class=share>Share this with your friends today</div><div class=ad><p>{PROSE}</p></div><p>{PROSE}</p></article>", f"{PROSE}\n{PROSE}"),
    (f"<article><h1>Title</h1><p>{PROSE}</p></article><ol class=comment-list><li><article class=comment-body><p>{PROSE}</p><p>{PROSE}</p></article></ol>", f"Title\n{PROSE}"),
    (f"<main><p>{PROSE}</p></main><aside><article class=card><p>{PROSE}</p><p>{PROSE}</p></article></aside>", PROSE),
    (f"<header><h1>The site</h1></header><main><p>{PROSE}</p></main><div class=sidebar><p>{PROSE}</p><p>{PROSE}</p></div>", PROSE),
    (f"<div hidden><article><h1>Title</h1><p>{PROSE}</p></article></div>", ""),
    # formulas and shown alternatives are text; controls and notes of a formula are not
    ("<article><p>The sum of <math><mi>a</mi><mo>+</mo><mi>b</mi><annotation>tex</annotation></math> is what is asked for here.</p></article>", "The sum of a+b is what is asked for here."),
    ("<article><p>One <object data=x>shown in its place</object> and a <select><option>choice</select> of words, all in one line.</p></article>", "One shown in its place and a of words, all in one line."),
])
def test_pages_by_hand(page, text):
    assert html.main_text(page) == text


def test_deep_links_are_seen():
    block = html.blocks("<p><a href=x><b><i><u><em><strong>all of this is a link</strong></em></u></i></b></a></p>")[0]
    assert block.links == len("allofthisisalink")


def test_long_undecided_pages_are_not_quadratic():
    start = time.perf_counter()
    assert html._flow([0.1 if i % 3 else -0.15 for i in range(4000)], [(i, i + 1, 0.5) for i in range(3999)])
    assert time.perf_counter() - start < 20


def test_min_cut_is_the_best_labelling():
    rng = random.Random(2)
    for _ in range(150):
        n = rng.randint(1, 8)
        own = [rng.choice([-1, 1]) * rng.randint(1, 40) / 10 for _ in range(n)]
        ties = [(i, j, rng.randint(0, 25) / 10) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        cost = lambda lab: sum(abs(x) for x, y in zip(own, lab) if (x > 0) != y) + sum(c for i, j, c in ties if lab[i] != lab[j])  # noqa: B023, E731
        assert cost(html.min_cut(own, ties)) == pytest.approx(min(map(cost, itertools.product([False, True], repeat=n))))


def test_extraction_is_the_best_labelling():
    """All 2^n labellings of random small pages, by the costs and ties that the page itself gives."""
    rng = random.Random(5)
    turned = 0
    for _ in range(120):
        page = "<body>" + "".join(
            rng.choice(["<div class=share>", "<section>", "<article>", "<div class=related>", "<form>", "<div class=content>", "</div>", "</article>", "</section>"]) * rng.randint(0, 1)
            + rng.choice(["<p>{}</p>", "<li><a href=x>{}</a></li>", "<h2>{}</h2>", "<div>{}.</div>", "<p class=meta>{}</p>"]).format(" ".join(["word"] * rng.choice([2, 6, 14, 25]) + ["end."]))
            for _ in range(rng.randint(1, 9))
        )
        found = html.blocks(page)
        own, tied = [html.evidence(b) for b in found], html.ties(found)
        cost = lambda lab: sum(abs(x) for x, y in zip(own, lab) if (x > 0) != y) + sum(c for i, j, c in tied if lab[i] != lab[j])  # noqa: B023, E731
        label = html.min_cut(own, tied)
        assert cost(label) == pytest.approx(min(map(cost, itertools.product([False, True], repeat=len(found)))))
        assert html.main_text(page) == "\n".join(b.text for b, keep in zip(found, label) if keep)
        turned += sum((x > 0) != y for x, y in zip(own, label))
    assert turned > 20


@pytest.mark.parametrize("page", ["<div>word " * 32_000, "<b>" * 32_000 + "</i>word<div></b></div>" * 8_000, "<div>" * 16_000 + "</span><p>word" * 16_000, "<span>" + "<div>" * 16_000 + "</span>word" * 16_000])
def test_deep_pages_take_linear_time(page):
    start = time.perf_counter()
    html.main_text(page)
    assert time.perf_counter() - start < 4


# --- operator 7


def brute(vectors, queries_, k=5):
    out = {}
    for q in queries_:
        a = vectors[q]
        s = sorted((-(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)), i) for i, b in vectors.items() if i != q)
        out[q] = s[:k]
    return out


@pytest.mark.parametrize("block", [8192, 300])
def test_nearest_neighbours_recall(spark, block):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.nearest(e, F.col("vec_id") % 50 == 0, block=block).collect()
    v = {r.vec_id: np.array(r.embedding, dtype=float) for r in e.collect()}
    want = brute(v, [i for i in v if i % 50 == 0])
    assert sorted({(r.query_id, r["rank"]) for r in got}) == [(i, k) for i in sorted(want) for k in range(1, 6)] and len(got) == 5 * len(want)
    found = sum(r.vec_id in {i for _, i in want[r.query_id]} for r in got)
    assert found >= 0.9 * sum(map(len, want.values()))
    for r in got:
        a, b = v[r.query_id], v[r.vec_id]
        assert r.score == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)


def test_the_index_prunes():
    """Vectors in groups, as real ones are: recall and the share of rows that a query touches, at two sizes."""
    rng = np.random.default_rng(0)
    shares = []
    for n, n_pivots in ((4000, 256), (40_000, 2048)):
        centre = rng.normal(size=(n // 40, 32))
        vec = ann._unit(centre[rng.integers(0, len(centre), n)] + 0.4 * rng.normal(size=(n, 32)))
        perm = np.argsort(-(vec @ vec[:n_pivots].T), axis=1, kind="stable")[:, : ann.NEAREST].astype(np.int32)
        files, asked = ann.Files(perm, n_pivots), rng.choice(n, 100, replace=False)
        hits = touched = 0
        for q in asked:
            near = files.candidates(perm[q], ann.RERANK)
            near = near[near != q]
            s = vec @ vec[q]
            s[q] = -9
            hits += np.isin(np.argpartition(-s, 5)[:5], near[np.argsort(-s[near])[:5]]).sum()
            touched += len(near)
        assert hits >= 0.9 * 500
        shares.append(touched / 100 / n)
    assert shares[1] < 0.5 * shares[0] and shares[1] < 0.2, shares


def test_nearest_neighbours_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (2, [0.0, 3.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (9, []), (None, [1.0, 1.0]), (10, [4.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 2 == 0).collect()}
    assert got == {(0, 1): (1, 1.0), (0, 2): (10, 1.0), (0, 3): (2, 0.0), (2, 1): (0, 0.0), (2, 2): (1, 0.0), (2, 3): (10, 0.0), (10, 1): (0, 1.0), (10, 2): (1, 1.0), (10, 3): (2, 0.0)}
    assert ann.nearest(df.limit(0), F.col("vec_id") % 2 == 0).count() == 0 and ann.nearest(df.where("vec_id = 0"), F.lit(True)).count() == 0


def test_nearest_neighbours_of_any_magnitude(spark):
    """Vectors whose squares are no doubles have the cosines of the same vectors at an ordinary size."""
    rng = np.random.default_rng(4)
    plain = rng.normal(size=(200, 16))
    size = np.array([1.0, 2.0**660, 2.0**-660, 2.0**1020])[rng.integers(0, 4, 200)]
    df = lambda m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    want, got = (sorted(map(tuple, ann.nearest(df(m), F.col("vec_id") % 10 == 0, rerank=1.0).collect())) for m in (plain, plain * size[:, None]))
    unit = plain / np.linalg.norm(plain, axis=1, keepdims=True)
    assert got == want and len(got) == 100 and all(abs(score - unit[q] @ unit[i]) < 1e-12 for q, _, i, score in got)


def test_footrule():
    perm = np.array([[0, 1, 2], [2, 1, 0], [3, 4, 5]])
    full = lambda a, b: sum(abs((list(a).index(p) if p in a else 3) - (list(b).index(p) if p in b else 3)) for p in {*map(int, a), *map(int, b)})
    assert ann.footrule(perm, perm[0]).tolist() == [full(perm[0], x) for x in perm]


# --- operator 8


def components(rows, rule):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = min(rule.width, len(w))
        sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= rule.percent * len(x | y):
            root[find(b)] = find(a)
    low = {}
    for k, (i, _) in enumerate(sets):
        low.setdefault(find(k), []).append(i)
    return sorted((str(i), len(s), str(min((x for x in low[find(k)] if x is not None), default=None))) for k, (i, s) in enumerate(sets))


def family(seed, n, size, change):
    rng = random.Random(seed)
    base = [f"v{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, change)):
            w[rng.randrange(size)] = f"c{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("rule", "tile"), [(jaccard.Rule(3, 90), 1024), (jaccard.Rule(5, 80), 7), (jaccard.Rule(1, 50), 1024)])
def test_jaccard_against_brute_force(spark, rule, tile):
    texts = [t for seed, (n, size, change) in enumerate([(40, 120, 6), (25, 30, 3), (12, 9, 1), (20, 400, 30), (6, 3, 1)]) for t in family(seed, n, size, change)]
    rows = AWKWARD + [(100 + i, t) for i, t in enumerate(random.Random(1).sample(texts, len(texts)))]
    got = jaccard.near_duplicates(docs(spark, rows), rule, tile=tile).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == components(rows, rule)
    assert jaccard.near_duplicates(docs(spark, []), rule).count() == 0


def test_blocks_of_linked_sets_always_meet():
    rng = np.random.default_rng(0)
    for rule in (jaccard.Rule(3, 90), jaccard.Rule(5, 80)):
        for n in (*range(1, 60), 200, 1000):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            drop = int(rng.integers(0, max(1, n - n * rule.percent // 100) + 1))
            b = a[drop:]
            if rule.links(len(b), n, len(b)):
                assert np.intersect1d(jaccard.block_keys(np.sort(a), rule), jaccard.block_keys(np.sort(b), rule)).size, (rule, n, drop)


def test_parity_sketch_bounds_the_difference():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, 80, dtype=np.uint64), rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    b = np.concatenate((a[:40], b))
    s = jaccard._sketches([a, b], 4)
    assert np.bitwise_count(s[0] ^ s[1]).sum() <= len(np.setxor1d(a, b))


# --- pipeline


def test_pipeline_against_its_stages(spark, tmp_path):
    import corpus_pipeline

    at = spark.read.parquet(f"{SF}/documents.parquet")
    start, kept = at, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == start.columns
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id for r in at.select("doc_id").collect()})
    text = {r.doc_id: r.text for r in start.collect()}
    assert kept[0] > kept[1] > kept[2] == kept[3]
    for i in kept[1]:
        n, _, _, _, repeated = __import__("test_text_operators").base(text[i])
        assert n >= 10 and 100 * repeated <= 20 * n
    comp = {i: c for i, _, c in components([(i, text[i]) for i in sorted(kept[1])], jaccard.Rule(5, 80))}
    assert {str(i) for i in kept[2]} == set(comp.values())
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == len(kept[3])


def test_pipeline_stages_on_awkward_rows(spark):
    import corpus_pipeline

    good = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 AND toxic = 0"), "doc_id").select("doc_id", "text").limit(3).collect()
    long = " ".join(f"word{i} and the" for i in range(30_000))
    rows = [(r.doc_id, r.text) for r in good] + [(None, good[0].text), (good[1].doc_id, good[1].text), (good[2].doc_id, long), (-5, None), (-6, ""), (-7, " \n "), (-8, long)]
    schema = "doc_id long, text string, kept string, llr string, score string, _score string, _row int, n_words string, cls string, comp int, row_key string, `odd name` string"
    df = spark.createDataFrame([(i, t, "k", "l", "s", "t", k, "n", "c", 1, "r", "o") for k, (i, t) in enumerate(rows)], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, df, SF)
        assert got.dtypes == df.dtypes and got.subtract(df).count() == 0, name
        assert stage(spark, df.limit(0), SF).count() == 0, name
    clean = {(r.doc_id, r.text) for r in corpus_pipeline.drop_toxic(spark, df, SF).collect()}
    assert {(r.doc_id, r.text) for r in good} <= clean and (-5, None) in clean
    one = corpus_pipeline.drop_near_duplicates(spark, df, SF).collect()
    # of equal texts the row with an id, of equal rows one, both texts of an id unless they are in one group; the smallest id of a group
    want = {(r.doc_id, r.text) for r in good} | {(-8, long), (-5, None), (-6, ""), (-7, " \n ")}
    assert len(one) == len(want) and {(r.doc_id, r.text) for r in one} == want
    packed = corpus_pipeline.pack(spark, df, SF)
    assert packed.where("piece = 0").count() == len(rows)


def test_registered_queries():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    import compare

    n, m, wrong, n_wrong = compare.differences(queries.queries()[name](spark, SF), compare.connect(SF), queries.oracle_sql()[name])
    assert n and (n, n_wrong) == (m, 0), wrong


def test_a_text_without_id_links_two_others(spark):
    w = [f"w{i}" for i in range(104)]
    text = lambda k: " ".join(w[k:] + [f"z{i}" for i in range(k)])
    rows = [(1, text(0)), (None, text(8)), (2, text(16)), (3, "something else that is linked with nothing here")]
    got = jaccard.near_duplicates(docs(spark, rows), jaccard.Rule(5, 80)).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 1), (1, 1), (2, 1), (3, 3)]
    apart = jaccard.near_duplicates(docs(spark, [rows[0], *rows[2:]]), jaccard.Rule(5, 80)).collect()
    assert all(r.doc_id == r.component_id for r in apart)


def test_sketches_never_hide_a_link():
    rule, rng = jaccard.Rule(5, 80), np.random.default_rng(3)
    sets = []
    for size in (1, 2, 9, 40, 300, 1500):
        base = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        for cut in (0, size // 20, size // 10, size // 3):
            sets.append(np.unique(np.concatenate((base[cut:], rng.integers(0, 1 << 63, cut, dtype=np.uint64)))))
    sketches, size, every = [jaccard.parity_sketch(s) for s in sets], np.array([len(s) for s in sets]), np.arange(len(sets))
    linked = lambda i, j: i != j and rule.links(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))
    want = {i for i in every if any(linked(i, j) for j in every)}
    assert want and want <= set(np.flatnonzero(jaccard.tile_candidates(sketches, size, every, None, rule)))
    left, right = every[::2], every[1::2]
    want = {k for i in left for j in right if linked(i, j) for k in (i, j)}
    found = set(np.flatnonzero(jaccard.tile_candidates(sketches, size, left, right, rule)))
    assert want and want <= found and len(found) < len(sets)


#: Columns of each registered query, and the table that it gives a row of for each of its rows (None: other numbers of rows).
CONTRACTS = {
    "op1_sentencepiece": ("doc_id n_ids ids_crc32 lossless", "documents"),
    "op2_quality_rules": ("doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "documents"),
    "op3_chat_formatting": ("conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", None),
    "op4_sharding": ("doc_id size text_crc32 law shard slot grown_shard", "documents"),
    "op5_toxicity": ("doc_id held_out score predicted", "documents"),
    "op6_html_extraction": ("page_id url text n_chars", "pages"),
    "op7_nearest_neighbours": ("query_id rank vec_id score", None),
    "op8_jaccard_join": ("doc_id n_shingles component_id", "documents"),
    "op9_best_fit_packing": ("doc_id piece start length ids_crc32 sequence_id offset", None),
    "op10_token_counts": ("length n_docs docs_at_least tokens_at_least", None),
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_registered_queries_run_whole(spark, name):
    columns, of = CONTRACTS[name]
    out = queries.queries()[name](spark, SF)
    assert set(columns.split()) <= set(out.columns)
    n = out.count()
    assert n == spark.read.parquet(f"{SF}/{of}.parquet").count() if of else n > 0
