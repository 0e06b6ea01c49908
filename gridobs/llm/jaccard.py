"""Jaccard self-join on word shingles by parity sketches.

Sketch: each shingle flips one bit of a long bit string, so the Hamming distance of two sketches is at most the symmetric
difference of the sets. The string has blocks of 2**64 bits; so few bits are set in a block that it is kept as the XOR of a code for each
set bit. For sets of at most ``hi`` shingles, similarity ``t`` allows a symmetric difference of ``d = 2 hi (1-t)/(1+t)``; with more than
``d`` blocks at least one block is equal in both (pigeonhole). Sets are compared inside bands of size, and a set also joins the larger bands that its partners may be in.

Sets that share a block meet at the smallest of them (the hub of the block), so that a block is never expanded into pairs of rows. Each
hub's sets are compared in fixed-size tiles, first by short parity sketches alone, whose distance bounds the symmetric difference from below:
only sets with a partner within the bound are sent whole to the tile, verified exactly, and leave it as the links of a spanning forest.
Equal sets count as one from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridobs.llm._shared import materialize

_U = np.uint64
TILE, BAND_GROWTH, TEXT_BYTES = 1024, 1.25, 4_000_000


@dataclass(frozen=True)
class Rule:
    """Shingles of ``width`` words; sets link if ``100 * intersection >= percent * union``."""

    width: int = 5
    percent: int = 80

    def may_differ(self, a: int, b: int) -> int:
        """Largest symmetric difference of linked sets of these sizes."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def links(self, common: int, a: int, b: int) -> bool:
        return 100 * common >= self.percent * (a + b - common)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(texts: list[bytes | None]) -> list[np.ndarray]:
    """64-bit hashes of the words of each text, A-Z in lower case. Each distinct word of a batch is hashed once."""
    words = pc.ascii_split_whitespace(pa.array([(t or b"").lower() for t in texts], pa.large_binary()).cast(pa.large_string(), safe=False))
    one = words.flatten().dictionary_encode()
    known = np.array([xxhash.xxh3_64_intdigest(w) if w else 0 for w in one.dictionary.cast(pa.large_binary()).to_pylist()], dtype=np.uint64)
    flat = known[one.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.uint64)
    ends = np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))
    return [w[w != 0] if len(w) and (w[0] == 0 or w[-1] == 0) else w for w in np.split(flat, ends[:-1])] if len(texts) else []


def shingle_sets_of(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word shingles. Fewer words than ``width``: one shingle of them all; none: none."""
    out = []
    for word in word_hashes(texts):
        n = min(width, len(word))
        if not n:
            out.append(word)
            continue
        said = np.zeros(len(word) - n + 1, dtype=np.uint64)
        for k in range(n):
            said = _mix(said + word[k : len(word) - n + 1 + k])
        out.append(np.unique(said + _U(n)))
    return out


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    return shingle_sets_of([None if text is None else text.encode("utf-8", "surrogatepass")], width)[0]


def _sets(batches: Iterator[pa.RecordBatch], column: int, width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches cut to some megabytes of text, with the sets of their texts (bytes)."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)) // TEXT_BYTES
        edges = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), b.num_rows]
        for at, end in zip(edges[:-1], edges[1:]):
            part = b.slice(at, end - at)
            yield part, shingle_sets_of(part.column(column).to_pylist(), width)


def set_id(hashes: np.ndarray) -> int:
    """64-bit fingerprint of a set; equal sets are one class."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def band_edges(limit: int) -> list[int]:
    """Smallest sizes of the bands: 1, 2, 3, …, each ``BAND_GROWTH`` times the one before."""
    edges = [1]
    while edges[-1] <= limit:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND_GROWTH)))
    return edges


def block_keys(hashes: np.ndarray, rule: Rule) -> np.ndarray:
    """Keys (band, block number, block) that the set joins on; linked sets share at least one.

    A band has ``d + spare`` blocks, so linked sets have at least ``spare`` equal ones. A set with fewer empty blocks than that leaves
    its empty blocks out, since an equal block that isn't empty remains; a set with more of them keeps them all.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, dtype=np.int64)
    largest = n * 100 // rule.percent
    edges = band_edges(largest + 1)
    out = []
    for band in range(len(edges) - 1):
        low, high = edges[band], edges[band + 1] - 1
        if high < n or low > largest:
            continue
        differ = rule.may_differ(high, high)
        spare = 1 + differ // 10
        blocks = differ + spare
        salt = _mix(np.array([band + 1], dtype=np.uint64))[0]
        at = (_mix(hashes ^ salt) >> _U(33)) % _U(blocks)
        xor = np.zeros(blocks, dtype=np.uint64)
        np.bitwise_xor.at(xor, at.astype(np.int64), _mix(hashes + _U(1)))
        key = _mix(_mix(xor) + _mix(salt + np.arange(blocks, dtype=np.uint64)))
        filled = xor != 0
        if blocks - filled.sum() < spare:
            key = key[filled]
        out.append(key)
    return np.concatenate(out).view(np.int64)


def shingle_sets(df: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, row_key, n_shingles, cls, sketch``: class of equal sets and its parity sketch; null for empty sets, which link with nothing.

    ``row_key`` is a digest of id and text, see ``row_key``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets in _sets(batches, 2, rule.width):
            cls = [set_id(s) if len(s) else None for s in sets]
            sketch = [parity_sketch(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.int64()), pa.array(sketch, pa.binary())],
                ["doc_id", "row_key", "n_shingles", "cls", "sketch"],
            )

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row_key"), F.col(text_col).cast("binary"))
    return rows.mapInArrow(run, "doc_id long, row_key binary, n_shingles long, cls long, sketch binary")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Digest of a row's id and text, nulls told apart from every value."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("0"))
    return F.unhex(F.sha2(F.concat(part(id_col), F.lit(":"), part(text_col)), 256))


def _keys(df: DataFrame, rule: Rule, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in _sets(batches, 0, rule.width):
            keys, classes, held = [], [], 0
            for s in sets:
                c = set_id(s)
                if len(s) and c not in seen:  # the same rows again, for an equal set
                    if len(seen) < 100_000:
                        seen.add(c)
                    k = block_keys(s, rule)
                    keys.append(k)
                    classes.append(np.full(len(k), c, dtype=np.int64))
                    held += len(k)
                if held > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, classes)], ["key", "cls"])
                    keys, classes, held = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, classes)], ["key", "cls"])

    return df.select(F.col(text_col).cast("binary")).mapInArrow(run, "key long, cls long")


def hub_members(df: DataFrame, rule: Rule, text_col: str = "text") -> DataFrame:
    """``hub, cls``: every class that shares a block with others, at the smallest class of that block."""
    block = Window.partitionBy("key")  # one exchange of the keys; aggregating and joining back made them, and moved them, twice
    keys = _keys(df, rule, text_col).select("cls", F.min("cls").over(block).alias("hub"), F.max("cls").over(block).alias("top"))
    return keys.where("hub < top").select("hub", "cls").distinct()


def _sketches(sets: list[np.ndarray], words: int) -> np.ndarray:
    out = np.zeros((len(sets), words), dtype=np.uint64)
    for row, s in zip(out, sets):
        bit = s % _U(64 * words)
        np.bitwise_xor.at(row, (bit >> _U(6)).astype(np.int64), _U(1) << (bit & _U(63)))
    return out


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity bits, at least two a shingle, their number a power of two: halves of a sketch XOR to the sketch of half its length."""
    return _sketches([hashes], 1 << (max(len(hashes) - 1, 0) // 32).bit_length())[0]


def tile_candidates(sketches: list[np.ndarray], size: np.ndarray, left: np.ndarray, right: np.ndarray | None, rule: Rule) -> np.ndarray:
    """Which sets have a partner that their sketches allow to be linked: of positions ``left`` among themselves if ``right`` is None, else across."""
    words = min(map(len, sketches))
    folded = np.stack([np.bitwise_xor.reduce(s.reshape(-1, words), axis=0) for s in sketches])
    out = np.zeros(len(sketches), dtype=bool)
    for k, i in enumerate(left):
        rest = left[k + 1 :] if right is None else right
        allowed = (100 - rule.percent) * (size[rest] + size[i]) // (100 + rule.percent)
        near = np.abs(size[rest] - size[i]) <= allowed
        rest, allowed = rest[near], allowed[near]
        rest = rest[np.bitwise_count(folded[rest] ^ folded[i]).sum(axis=1, dtype=np.int64) <= allowed]
        if len(rest):
            out[i] = True
            out[rest] = True
    return out


def tile_links(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]] | None, rule: Rule) -> list[tuple[int, int]]:
    """A spanning forest of the links between two lists of (class, set), or inside one if ``right`` is None."""
    both = left + (right or [])
    size = np.array([len(s) for _, s in both], dtype=np.int64)
    words = int(min(512, max(4, 1 << int(np.median(size) // 16).bit_length())))
    sketch = _sketches([s for _, s in both], words)
    parent = list(range(len(both)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out, n = [], len(left)
    for i in range(n):
        rest = np.arange(i + 1 if right is None else n, len(both))
        allowed = (100 - rule.percent) * (size[rest] + size[i]) // (100 + rule.percent)
        rest = rest[np.abs(size[rest] - size[i]) <= allowed]
        if not len(rest):
            continue
        allowed = (100 - rule.percent) * (size[rest] + size[i]) // (100 + rule.percent)
        far = np.bitwise_count(sketch[rest] ^ sketch[i]).sum(axis=1, dtype=np.int64)
        for j in rest[far <= allowed]:
            a, b = root(i), root(int(j))
            if a != b and rule.links(len(np.intersect1d(both[i][1], both[j][1], assume_unique=True)), int(size[i]), int(size[j])):
                parent[b] = a
                out.append((both[i][0], both[j][0]))
    return out


def links(df: DataFrame, sets: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """``a, b``: verified links between classes, enough to connect whatever is linked."""
    members = materialize(hub_members(df, rule, text_col))
    classes = sets.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("_rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    sizes = members.groupBy("hub").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"))
    # a member of a hub of many tiles goes to every pair of tiles that has its own
    placed = members.join(sizes, "hub").withColumn("_own", F.pmod(F.xxhash64("cls"), F.col("tiles").cast("long")).cast("int"))
    placed = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = placed.select("hub", "cls", "_own", F.least("_own", "_other").alias("x"), F.greatest("_own", "_other").alias("y"))
    rough = placed.join(classes.select("cls", "n", "sketch"), "cls").groupBy("hub", "x", "y").agg(F.collect_list(F.struct("_own", "cls", "n", "sketch")).alias("sets"))

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                hub, x, y = (batch.column(k)[i].as_py() for k in range(3))
                rows = batch.column(3).slice(i, 1).flatten()
                own, cls, n = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("_own", "cls", "n"))
                sketches = [np.frombuffer(s, dtype=np.uint64) for s in rows.field("sketch").to_pylist()]
                left, right = np.flatnonzero(own == x), None if x == y else np.flatnonzero(own == y)
                keep = tile_candidates(sketches, n, left, right, rule)
                if keep.any():
                    k = int(keep.sum())
                    same = [pa.array(np.full(k, v)).cast(t) for v, t in ((hub, pa.int64()), (x, pa.int32()), (y, pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(own[keep], pa.int32()), pa.array(cls[keep], pa.int64())], ["hub", "x", "y", "_own", "cls"])

    placed = materialize(rough.mapInArrow(prune, "hub long, x int, y int, _own int, cls long"))
    wanted = placed.select("cls").distinct().join(classes.select("_rep", "cls"), "cls").select("_rep", "cls")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, 1, rule.width):
            s = [x.view(np.int64) for x in sets]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(x) for x in s], pa.int64()), pa.array(s, pa.list_(pa.int64()))], ["cls", "hashes"])

    rows = df.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).cast("binary").alias(text_col))
    # a class that has no id is found among the rows without one; the join with placed leaves out what is not wanted
    texts = wanted.join(rows, F.col("_rep") == F.col("_doc")).select("cls", text_col).union(rows.where("_doc IS NULL").select("_doc", text_col))
    known = texts.mapInArrow(hashes, "cls long, hashes array<long>").dropDuplicates(["cls"])
    work = placed.join(known, "cls").groupBy("hub", "x", "y").agg(F.collect_list(F.struct("_own", "cls", "hashes")).alias("sets"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for i in range(batch.num_rows):
                x, y = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                rows = batch.column(2).slice(i, 1).flatten()
                own, cls = rows.field("_own").to_numpy(zero_copy_only=False), rows.field("cls").to_numpy(zero_copy_only=False)
                lists = rows.field("hashes")
                all_sets = [(int(c), lists[k].values.to_numpy(zero_copy_only=False).view(np.uint64)) for k, c in enumerate(cls)]
                left = [s for s, o in zip(all_sets, own) if o == x]
                found = tile_links(left, None if x == y else [s for s, o in zip(all_sets, own) if o == y], rule)
                a += [p for p, _ in found]
                b += [q for _, q in found]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return work.select("x", "y", "sets").mapInArrow(verify, "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``cls, comp``: the smallest class reachable by links, for classes that have any. Neighbours' minima and pointer jumps, until nothing changes."""
    both = materialize(edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).distinct())  # a union would verify twice
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "cls"))
    for _ in range(max_rounds):
        around = both.join(labels, F.col("b") == F.col("cls")).groupBy("a").agg(F.min("comp").alias("near"))
        lower = labels.join(around, F.col("cls") == F.col("a")).select("cls", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("cls").alias("at"), F.col("comp").alias("to"))
        new = materialize(lower.join(jump, F.col("comp") == F.col("at"), "left").select("cls", "old", F.coalesce(F.least("comp", "to"), "comp").alias("comp")))
        changed = new.where("comp <> old").limit(1).count()
        labels = new.select("cls", "comp")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def grouped(df: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """``doc_id, row_key, n_shingles, comp``: per row, the size of its set and the component of its class; null for empty sets, which link with nothing."""
    sets = materialize(shingle_sets(df, rule, id_col, text_col))
    comp = components(links(df, sets, rule, id_col, text_col, tile)).withColumnRenamed("cls", "_cls")
    return sets.join(comp, F.col("cls") == F.col("_cls"), "left").select("doc_id", "row_key", "n_shingles", F.coalesce("comp", "cls").alias("comp"))


def near_duplicates(df: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """``doc_id, n_shingles, component_id``: per row, the size of its set and the smallest doc_id reachable by links, itself included.

    A null, empty or blank text has an empty set and is its own component. Repeated rows of a doc_id are equal
    to each other and share a component. Rows with a null id keep a null component only if they are linked with no id. An empty table
    gives no rows. Other columns are ignored.
    """
    sets = materialize(shingle_sets(df, rule, id_col, text_col))
    comp = components(links(df, sets, rule, id_col, text_col, tile))
    classes = sets.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("low")).join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    lowest = classes.groupBy("comp").agg(F.min("low").alias("component_id"))
    of = classes.join(lowest, "comp").select(F.col("cls").alias("_cls"), "component_id")
    return sets.join(of, F.col("cls") == F.col("_cls"), "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
