"""SentencePiece, quality, packing, token counts, sharding: brute force, round trips and awkward rows."""

import math
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from cases import AWKWARD, LONG, docs
from pyspark.sql import functions as F

from gridobs.llm import lengths, packing, quality, sentencepieces, sharding, tokens

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# --- operator 1


EXTRA = [(20, "  two  blanks "), (21, "<s> </s> <0x41>"), (22, "ab" * 300), (23, "the theatre, ndea*** (x) 3.14\r\n")]


@lru_cache
def scores():
    model = sentencepieces.pieces(sentencepieces.default_path(), True)  # all pieces
    score = {p: (s, i) for p, i, s in model.ordinary}
    return model, score, min(s for s, _ in score.values() if s > -1e8) - 10


def best_path(word):
    """Ids of the largest sum of scores over a word, the longer last piece first among equals, by plain dynamic programming."""
    model, score, lowest = scores()
    best = [(0.0, 0, [])]
    for end in range(1, len(word) + 1):
        found = [(best[a][0] + score[word[a:end]][0], -a, [score[word[a:end]][1]]) for a in range(max(0, end - 16), end) if word[a:end] in score]
        if word[end - 1] not in score:
            found.append((best[end - 1][0] + lowest, 1 - end, model.unknown(word[end - 1])))
        best.append(max(found, key=lambda x: (x[0], x[1])))
    out, at = [], len(word)
    while at:
        out = best[at][2] + out
        at = -best[at][1]
    return out


@pytest.fixture(scope="module")
def encoded(spark):
    rows = AWKWARD + EXTRA + [(30, "x" * 5000 + " tail")] + [(k + n, (w * 210)[: n - 1]) for k, w in ((1000, "a"), (2000, "therein"), (3000, "onationalis")) for n in (199, 200, 201, 202, 400, 401)]
    return rows, sentencepieces.encode(docs(spark, rows), block_chars=100_000).collect()


def test_ids_are_the_best_paths(encoded):
    rows, got = encoded
    assert {199, 200, 201, 202, 400, 401} <= {len(a) for _, t in rows for a in sentencepieces.pieces(sentencepieces.default_path()).atoms(pa.array(sentencepieces.words(t), pa.string()))[0].to_pylist()}
    ids = {w: best_path(w) for _, t in rows for w in set(sentencepieces.words(t))}
    assert sorted((str(r.doc_id), r.text or "", list(r.ids)) for r in got) == sorted((str(i), t or "", [x for w in sentencepieces.words(t) for x in ids[w]]) for i, t in rows)
    assert {r.doc_id for r in got if r.text is None} == {2}


def test_best_paths_are_those_of_the_library_s_lattice():
    library = sentencepieces.processor(sentencepieces.default_path(), True)
    for w in ("the", "theatre", "ndeaing", "zzz", "hello", "ou", "x", "internationalisation"):
        assert best_path(sentencepieces.BLANK + w) == [library.piece_to_id(p) for p in library.nbest_encode_as_pieces(w, 2)[0]]


def test_merged_ids_are_the_library_s(spark):
    library = sentencepieces.processor(sentencepieces.default_path())
    rows = [r for r in AWKWARD if r[0] not in (6, 9, 10)] + EXTRA + [(24, ("therein" * 40)[:209])]
    got = sentencepieces.encode(docs(spark, rows), merges=True, block_chars=2000).collect()
    assert sorted((str(r.doc_id), r.text or "", list(r.ids)) for r in got) == sorted((str(i), t or "", library.encode(t or "")) for i, t in rows)


def test_decoding_is_lossless(spark):
    rows = AWKWARD + EXTRA + [(40, "same row")] * 150
    back = sentencepieces.decode(sentencepieces.encode(docs(spark, rows), block_chars=100_000))
    assert back.where("NOT lossless").count() == 0 and back.count() == len(rows)
    at_once = sentencepieces.encode(docs(spark, rows), decoded=True)
    assert at_once.columns == back.columns and at_once.exceptAll(back).count() == 0 and at_once.count() == len(rows)


def test_encode_empty_table(spark):
    assert sentencepieces.decode(sentencepieces.encode(docs(spark, []))).count() == 0


# --- operator 2


def base(text):
    w = WORDS.findall(text or "")
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if many[x] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def grams(text):
    """Buckets of words and pairs by the published definition of the hash Spark uses: XXH64 of UTF-8 with seed 42, chained through the seed."""
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORDS.findall(text or "")]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    pair = lambda a, b: xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42))
    return [signed(x) % quality.BUCKETS for x in h + [pair(a, b) for a, b in zip(h, h[1:])]]


def test_quality_against_brute_force(spark):
    repeat = "a b c d e f g a b c d e z a b c d e\nsame line\nsame line\n\n \nsame line"
    rows = AWKWARD + [(30, repeat), (31, "#*$ %&|<> " * 8 + "q"), (32, "p q r s t u v w x y z"), (33, "m m m m m m m m m m m")]
    df = docs(spark, rows)
    trusted = spark.createDataFrame([(1,), (32,), (None,)], "doc_id long")
    weights = quality.bucket_weights(df, trusted)
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i in (1, 32):
            target.update(grams(t))
    share, k = sum(target.values()) / sum(raw.values()), quality.SMOOTHING
    want = [math.log((target[b] + k * share) / (raw[b] + k)) - math.log(share) for b in range(quality.BUCKETS)]
    assert weights == pytest.approx(want, abs=1e-12)
    out = quality.judge(df, weights)
    assert out.columns[:2] == ["doc_id", "text"] and len(set(out.columns)) == len(out.columns)
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        n_words, *rest = base(r.text)
        g = grams(r.text)
        llr = sum(want[b] for b in g) / max(1, len(g))
        failed = n_words < 10 or 100 * rest[3] > 20 * n_words
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n_words, *rest, failed), r.doc_id
        assert r.llr == pytest.approx(llr, abs=1e-9) and r.kept == (not failed and llr >= quality.THRESHOLD)


def test_quality_runs_no_python_on_executors(spark):
    out = quality.judge(docs(spark, AWKWARD), [0.0] * quality.BUCKETS)
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())
    assert quality.judge(docs(spark, []), [0.0] * 8).count() == 0
    assert set(quality.bucket_weights(docs(spark, AWKWARD), spark.createDataFrame([], "doc_id long"))) == {0.0}


# --- operators 9 and 10


def test_ids_are_those_of_the_tokenizers_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    for text in ("", "a", "It's 12  o'clock\n\n\tnow <|endoftext|> é漢😀 ", "<|endoftext|>", "hello <|endoftext|><|endoftext|>\n x <|endoftex|>", LONG[:5000], "x" * 3000, " \x1c\x85　 y"):
        assert tokens.encode(text, tokens.default_path()) == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("portions", [32, 3])
def test_packing_places_every_piece_once(spark, portions):
    rows = AWKWARD + [(100 + i, LONG[: i * 37 % 3000]) for i in range(200)]
    df = docs(spark, rows)
    got = packing.pack_documents(df, portions=portions).collect()
    path = tokens.default_path()
    want = []
    for i, t in rows:
        ids = [*tokens.encode(t, path), 2]
        first = len(ids) % 1024 or 1024
        at = [0, *range(first, len(ids) + 1, 1024)]
        want += [(str(i), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(at, at[1:]))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= -(-sum(r.length for r in got) // 1024) * 1.05 + 1
    assert packing.pack_documents(docs(spark, [])).count() == 0


def one_by_one(lengths_, capacity):
    """Offsets by the rule as it is said, with the sum of squares worked out anew for each choice."""
    count, where = Counter(), []
    for s in lengths_:
        squares = lambda g: sum(c * c for c in (count - Counter([g]) + Counter([g - s] if g > s else [])).values())  # noqa: B023, E731
        fit = [g for g in count if count[g] and g >= s]
        g = min(fit, key=lambda g: (squares(g), g)) if fit else capacity
        count[g] -= bool(fit)
        if g > s:
            count[g - s] += 1
        where.append((s, capacity - g))
    return sorted(where)


def placed(counts, plan_):
    """All (length, offset), checked: sequences are filled without gaps and overlaps."""
    out, filled = [], {}
    for s, (start, first, offset) in plan_.items():
        for k, n in enumerate(np.diff(np.append(start, counts[s]))):
            for i in range(n):
                filled.setdefault(first[k] + i, []).append((offset[k], s))
                out.append((s, int(offset[k])))
    for rows in filled.values():
        at = 0
        for offset, s in sorted(rows):
            assert offset == at
            at += s
    return sorted(out), filled


def test_sum_of_squares_rule():
    counts = dict(sorted(Counter(map(int, np.random.default_rng(0).integers(1, 20, 60))).items(), reverse=True))
    got, _ = placed(counts, packing.plan(counts, 20)[0])
    assert got == one_by_one([s for s in counts for _ in range(counts[s])], 20)


@pytest.mark.parametrize("copies", [1, 50, 3000])
def test_plan_of_any_size(copies):
    counts = {int(s): copies * int(n) for s, n in enumerate(np.random.default_rng(1).integers(0, 4, 200), 1) if n}
    found, sequences = packing.plan(counts, 256)
    got, filled = placed(counts, found)
    assert len(got) == sum(counts.values()) and set(filled) == set(range(sequences)) and max(o + s for s, o in got) <= 256
    assert sequences <= 1.01 * sum(s * n for s, n in counts.items()) / 256 + 1


def test_plan_of_billions_is_no_more_work():
    counts = {s: 1 + s * 7919 % 97 for s in range(1, 1024)}
    runs = {}
    for factor in (10**3, 10**5, 10**9):
        found, sequences = packing.plan({s: n * factor for s, n in counts.items()})
        runs[factor] = sum(len(x[0]) for x in found.values())
        assert sequences <= 1.002 * sum(s * n for s, n in counts.items()) * factor / 1024
    assert max(runs.values()) < 1.2 * min(runs.values()) < 100_000


def test_length_table(spark):
    rows = AWKWARD + [(50 + i, "the " * (i % 40)) for i in range(100)]
    n = sorted(len(tokens.encode(t, tokens.default_path())) for _, t in rows)
    hist = lengths.length_histogram(lengths.encoded_lengths(docs(spark, rows)))
    got = {r.length: r for r in lengths.limit_table(hist).collect()}
    assert sorted(got) == sorted(set(n))
    for x, r in got.items():
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least, r.docs_total, r.tokens_total) == (n.count(x), sum(v >= x for v in n), sum(v for v in n if v >= x), len(n), sum(n))
        assert r.truncated_tokens == sum(min(v, x) for v in n) and r.docs_at_most == sum(v <= x for v in n)
    for r in lengths.at_limit(hist, [1, 7, 2048]).collect():
        assert (r.docs_over, r.truncated_tokens) == (sum(v > r.limit for v in n), sum(min(v, r.limit) for v in n))
    assert lengths.limit_table(lengths.length_histogram(lengths.encoded_lengths(docs(spark, [])))).count() == 0


# --- operator 4


def minimax(sizes, k):
    """Smallest capacity for k contiguous parts, by dynamic programming over exact sums."""
    ends = np.cumsum([0, *sizes])
    best = list(ends)
    for _ in range(k - 1):
        best = [min(max(best[i], ends[j] - ends[i]) for i in range(j + 1)) for j in range(len(ends))]
    return best[-1]


def test_sharding_is_the_minimax(spark):
    rows = AWKWARD + [(100 + i, f"text {i % 45} " * (1 + i % 45)) for i in range(120)]
    df = docs(spark, rows)
    got = sharding.shard_by_bytes(df, 8).collect()
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    keys = {t: h for t, h in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    groups = Counter()
    for _, t in rows:
        groups[keys[t] % (1 << 64)] += len((t or "").encode()) + 1
    load, shard_of = Counter(), {}
    for r in got:
        load[r.shard] += r["size"]
    assert max(load.values()) == minimax([groups[k] for k in sorted(groups)], 8)
    for s in load:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    for r in got:
        assert shard_of.setdefault((r["size"], r.text_crc32), r.shard) == r.shard or r["size"] == 1
    assert sharding.shard_by_bytes(docs(spark, [])).count() == 0


def test_shard_files(spark, tmp_path):
    df = docs(spark, [(i, f"t{i}") for i in range(50)])
    sharding.write_shards(df, sharding.shard_by_bytes(df.select("doc_id", "text"), 3), str(tmp_path / "s")) if "shard" not in df.columns else sharding.write_shards(df.drop("shard"), sharding.shard_by_bytes(df, 3), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 50 and back.select("shard").distinct().count() == 3


@pytest.mark.parametrize("run", [" ", "\n", "　", "\t ", "a", "^", " x"])
def test_long_runs_of_one_character(run):
    """Blank runs overflow the faster library's stack; the ids are those of tokenizers at every length."""
    import tokenizers

    path = tokens.default_path()
    plain = tokenizers.Tokenizer.from_file(path)
    for n in (tokens.LONG_BLANK - 1, tokens.LONG_BLANK, 1_000_000):
        text = "x" + run * (n // len(run)) + "y"
        assert tokens.encode(text, path) == plain.encode(text, add_special_tokens=False).ids


def test_tokens_of_a_blank_document(spark):
    rows = [(1, "a" + " " * 1_000_000 + "b"), (2, "\n" * 5_000_000), (3, "c d")]
    df = docs(spark, rows)
    n = {i: len(tokens.encode(t, tokens.default_path())) for i, t in rows}
    pieces = packing.cut_pieces(df).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in pieces} == {i: k + 1 for i, k in n.items()}
    assert sorted(r.n_tokens for r in lengths.encoded_lengths(df).collect()) == sorted(n.values())
