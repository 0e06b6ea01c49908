"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into item-sized windows of words (an item of fewer words is one window), a window into its word shingles. A document that holds a window
holds all of its shingles, so one of them is a sufficient join prefix: the rarest, by counts over all documents. Documents are read once. A task hashes their shingles and emits those that
a bit table of all benchmark shingles lets through, each with its position and the words around it that any window with that shingle could cover. The rest works on these few
rows: count shingles, choose every window's prefix, join on it, drop what would begin before the text or end behind it (positional and length bound), and compare words
with words. Hashes and bits only choose candidates; a window is found by its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridobs.llm._shared import materialize, spread_join
from gridobs.llm.words import Words, text_parts

_U = np.uint64
ROWS_OUT = 20_000
LEAST_BITS, MOST_BITS, BITS_EACH = 16, 27, 64
#: Bytes of words: a-z from either case, digits, and all that is not ASCII; the other ASCII bytes become blanks.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


@dataclass(frozen=True)
class Rule:
    """Windows of ``window`` words, joined on shingles of ``shingle`` words."""

    window: int = 10
    shingle: int = 5

    @property
    def reach(self) -> int:
        """Words before a shingle that a window with it can begin at."""
        return max(0, self.window - self.shingle)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Hashed(Words):
    """Words of texts and the hashes of their shingles."""

    def __init__(self, texts: list[bytes]):
        super().__init__([t.translate(_WORD_BYTES) for t in texts])
        known = np.array([xxhash.xxh3_64_intdigest(w) for w in self.spelled.cast(pa.large_binary()).to_pylist()], dtype=np.uint64)
        self.hash = known[self.number] if len(known) else np.zeros(0, np.uint64)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (in ``text``) of all shingles of ``width`` words inside a text, and their hashes."""
        n = len(self.hash) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        said = np.full(n, width, dtype=np.uint64)
        for k in range(width):
            said = _mix(said + self.hash[k : n + k])
        inside = np.flatnonzero(self.row[:n] == self.row[width - 1 :])
        return inside, said[inside]

    def said(self, a: int, b: int) -> str:
        return " ".join(self.text.slice(a, b - a).to_pylist())


def item_windows(items: DataFrame, rule: Rule = Rule(), id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, window, n, shingles``: the windows of all items as words joined by blanks, their number of words, the hashes of their shingles in order.

    Items with a null id take no part; items without words have no window. A window said twice in an item comes twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in text_parts(batches, 1):
            words = Hashed(texts)
            for i in range(b.num_rows):
                start, count = int(words.start[i]), int(words.count[i])
                n = min(rule.window, count)
                if not n:
                    continue
                width = min(rule.shingle, n)
                at, hashes = words.shingles(width)
                hashes = hashes[np.searchsorted(at, start) : np.searchsorted(at, start + count)].view(np.int64)
                text = words.text.slice(start, count).to_pylist()
                starts = range(count - n + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b.column(0)[i].as_py()] * len(starts), pa.string()), pa.array([" ".join(text[s : s + n]) for s in starts]),
                        pa.array([n] * len(starts), pa.int32()), pa.array([hashes[s : s + n - width + 1] for s in starts], pa.list_(pa.int64())),
                    ],
                    ["item", "window", "n", "shingles"],
                )

    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string"), F.col(text_col).cast("binary"))
    return rows.mapInArrow(run, "item string, window string, n int, shingles array<long>")


def bit_table(shingles: DataFrame) -> tuple[int, np.ndarray]:
    """The table's logarithm of size and its bits, one byte each. ``shingles``: distinct hashes. Its size follows their number, up to 2 ** ``MOST_BITS``: beyond, more documents' shingles pass it in vain."""
    n = shingles.count()
    log = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * n).bit_length()))
    place = F.col("shingle").bitwiseAND(F.lit((1 << log) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    words = shingles.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()  # no more rows than the table has words
    packed = np.zeros(1 << (log - 6), dtype=np.int64)
    packed[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return log, packed


def occurrences(docs: DataFrame, log: int, packed: np.ndarray, widths: list[int], rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """``row, doc_id, n_words, pos, shingle, before, context``: a row per document (``pos`` null), and one per shingle that the bit table lets through.

    ``context`` are the words from ``before`` words before the shingle to the end of the last window that can begin with it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(packed.view(np.uint8), bitorder="little")
        row = TaskContext.get().partitionId() << 40
        for b, texts in text_parts(batches, 1):
            words = Hashed(texts)
            rows, none = np.arange(row, row + b.num_rows), pa.nulls(b.num_rows, pa.int32())
            row += b.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), b.column(0), pa.array(words.count), none, none.cast(pa.int64()), none, none.cast(pa.string())], names
            )
            for width in widths:
                at, hashes = words.shingles(width)
                hit = bits[hashes & _U((1 << log) - 1)] != 0
                at, hashes = at[hit], hashes[hit].view(np.int64)
                of = words.row[at]
                first = np.maximum(words.start[of], at - rule.reach)
                last = np.minimum(words.start[of] + words.count[of], at + rule.window)
                for k in range(0, len(at), ROWS_OUT):
                    s = slice(k, k + ROWS_OUT)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(rows[of[s]]), pa.nulls(len(at[s]), b.column(0).type), pa.array(words.count[of[s]]), pa.array((at - words.start[of])[s].astype(np.int32)),
                            pa.array(hashes[s]), pa.array((at - first)[s].astype(np.int32)), pa.array([words.said(x, y) for x, y in zip(first[s].tolist(), last[s].tolist())]),
                        ],
                        names,
                    )

    names = ["row", "doc_id", "n_words", "pos", "shingle", "before", "context"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary"))
    return rows.mapInArrow(run, "row long, doc_id long, n_words long, pos int, shingle long, before int, context string")


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """``shingle, id, window, n, offset``: the rarest shingle of every window and its place there; windows with a shingle that no document holds are left out."""
    parts = windows.select("id", F.posexplode("shingles").alias("offset", "shingle"))
    rarest = parts.join(counts, "shingle", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "shingle", "offset")).alias("p"))
    return rarest.where("p.count > 0").join(windows, "id").select("p.shingle", "id", "window", "n", "p.offset")


def find_windows(docs: DataFrame, items: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three stable tables: ``row, doc_id, n_words`` of all documents; the occurrences ``row, start, n, id`` of windows; and ``id, item``, the items of each window."""
    raw = materialize(item_windows(items, rule, item_col, text_col))
    windows = materialize(raw.groupBy("window").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles")).withColumn("id", F.monotonically_increasing_id()))
    of = raw.join(windows.select("id", "window"), "window").select("id", "item").distinct()
    log, packed = bit_table(windows.select(F.explode("shingles").alias("shingle")).distinct())
    widths = [r.w for r in windows.select(F.least("n", F.lit(rule.shingle)).alias("w")).distinct().collect()]  # at most ``rule.shingle`` values
    seen = materialize(occurrences(docs, log, packed, sorted(widths), rule, id_col, text_col))
    found = seen.where("pos IS NOT NULL").drop("doc_id")
    prefix = prefixes(windows, found.groupBy("shingle").count())
    pairs = spread_join(found, prefix, "shingle", "row").where("pos >= offset AND pos - offset + n <= n_words")
    same = F.array_join(F.slice(F.split("context", " "), F.col("before") - F.col("offset") + 1, F.col("n")), " ") == F.col("window")
    hits = pairs.where(same).select("row", (F.col("pos") - F.col("offset")).alias("start"), "n", "id").distinct()
    return seen.where("pos IS NULL").select("row", "doc_id", "n_words"), materialize(hits), materialize(of)


def covered(spans: str) -> F.Column:
    """Words in the union of an array of (start, n)."""
    step = lambda a, x: F.struct(
        F.greatest(a["end"], x["start"] + x["n"]).alias("end"), (a["total"] + F.greatest(F.lit(0), x["start"] + x["n"] - F.greatest(a["end"], x["start"]))).alias("total")
    )
    return F.aggregate(F.sort_array(spans), F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total")), step, lambda a: a["total"])


def contamination(docs: DataFrame, items: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``doc_id, n_words, n_hit, items, contaminated``: per row of ``docs`` its words, those inside a window of an item, and the items (as strings, sorted) whose windows occur.

    A null or empty text has no words and is clean. Repeated rows are judged each; a null doc_id stays null. Items with a null id take no part; rows that repeat an item's id
    are one item with the windows of all. An empty table of documents gives no rows, one of items clean documents. Other columns are ignored.
    """
    rows, hits, of = find_windows(docs, items, rule, id_col, text_col, item_col)
    words = hits.groupBy("row").agg(covered(F.collect_set(F.struct("start", "n"))).alias("n_hit"))
    named = spread_join(hits.select("row", "id").distinct(), of, "id", "row").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return rows.join(words, "row", "left").join(named, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
