"""Benchmark decontamination against plain loops over words."""

import random
import re

import compare
import pytest
from cases import AWKWARD, docs
from pyspark.sql import functions as F

from gridobs.llm import _shared, decontaminate, queries
from gridobs.llm.decontaminate import Rule

ITEMS = "item_id long, text string, doc_id string, n int, window int, pos string"


def items(spark, rows):
    return spark.createDataFrame([(i, t, "d", 1, 2, "p") for i, t in rows], ITEMS)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, bench, width):
    wins = {(i, tuple(w[k : k + min(width, len(w))])) for i, t in bench if i is not None for w in [words(t)] if w for k in range(len(w) - min(width, len(w)) + 1)}
    out = []
    for i, t in texts:
        w, hit, found = words(t), set(), set()
        for item, win in wins:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(str(item))
        out.append((i, len(w), len(hit), tuple(sorted(found)), bool(hit)))
    return sorted(out, key=str)


def run(spark, texts, bench, rule=Rule()):
    got = decontaminate.contamination(docs(spark, texts), items(spark, bench), rule).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got), key=str)


@pytest.mark.parametrize("rule", [Rule(), Rule(6, 2), Rule(4, 5)])
def test_against_loops(spark, rule):
    rng = random.Random(rule.window)
    vocabulary = ["a", "b", "Ab", "é", "漢字", "x9", "the"]
    say = lambda n: rng.choice(["", ", ", " - "]) + rng.choice([" ", "\n", "--"]).join(rng.choices(vocabulary, k=n)) + rng.choice(["", "."])
    bench = [(k * 3, say(rng.choice([1, 2, 4, 7, 10, 12, 30]) + (5 if k < 25 else 0))) for k in range(30)] + [(7, None), (8, ""), (9, "?!"), (None, "a b ab"), (3, say(11)), (300, "a a a a a a a a a a a a")]
    bench += [(bench[0][0] + 1000, bench[0][1].upper())]
    texts = []
    for k in range(40):
        parts = [say(rng.randint(0, 15))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(bench)[1] or "", say(rng.randint(0, 4))]
        texts.append((k, " ".join(parts)))
    texts += [texts[0], (0, texts[1][1]), *AWKWARD, (500, "a " * 30), (501, " a b a\x00b")]
    assert run(spark, texts, bench, rule) == brute(texts, bench, rule.window)


def test_a_passage_in_most_documents(spark):
    said = " ".join(f"q{i}" for i in range(14))
    texts = [(i, f"own{i} words{i} {said} tail{i}" if i % 3 else f"clean{i} {said[:20]}") for i in range(3000)]
    bench = [(1, said), (2, said + " more"), (3, "none of these words is in any of the other texts here")]
    got = decontaminate.contamination(docs(spark, texts), items(spark, bench)).groupBy("n_hit", "items", "contaminated").count().collect()
    assert {(r.n_hit, tuple(r["items"]), r.contaminated, r["count"]) for r in got} == {(14, ("1", "2"), True, 2000), (0, (), False, 1000)}


def test_full_bit_table_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "LEAST_BITS", 6)
    monkeypatch.setattr(decontaminate, "MOST_BITS", 6)
    rng = random.Random(5)
    bench = [(k, " ".join(f"w{rng.randrange(40)}" for _ in range(20))) for k in range(12)]
    texts = [(k, " ".join(f"w{rng.randrange(40)}" for _ in range(30)) + " " + bench[k % 12][1][5:]) for k in range(30)]
    assert run(spark, texts, bench) == brute(texts, bench, 10)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c")]) == [] and run(spark, [(1, "a b"), (2, None)], []) == [(1, 2, 0, (), False), (2, 0, 0, (), False)]


def test_spread_join(spark):
    left = _shared.materialize(spark.range(5000).select(F.when(F.col("id") < 4000, 7).otherwise(F.col("id") % 50).alias("k"), "id"))
    right = spark.createDataFrame([(7, "a"), (7, "b"), (3, "c"), (99, "d")], "k long, v string")
    got = _shared.spread_join(left, right, "k", "id")
    assert sorted(got.columns) == ["id", "k", "v"] and sorted(map(tuple, got.select("k", "id", "v").collect())) == sorted(map(tuple, left.join(right, "k").select("k", "id", "v").collect()))


def test_query_against_sql(spark):
    con = compare.connect("/root/testdata/sf0.001")
    n, m, wrong, n_wrong = compare.differences(queries.op11_decontamination(spark, "/root/testdata/sf0.001"), con, queries.oracle_sql()["op11_decontamination"])
    assert (n, n_wrong) == (m, 0), wrong
