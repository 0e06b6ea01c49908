"""SentencePiece encoding as a relational lattice, and decoding.

Every distinct atom of the corpus (a word, or the parts of one that no piece crosses the ends of) is expanded into its substrings of bounded
length; an equi-join with the piece table keeps the edges of its lattice; edges are grouped by atom, and a higher-order ``aggregate`` folds them
by Viterbi: the segmentation with the largest sum of scores, of equal sums the one with the longer last piece. These are the ids of the
sentencepiece library for the same pieces and scores read as a unigram model, word by word (over a long text the library adds up in single precision).

``merges=True`` reads the model file as BPE instead: the best-scored edge over two neighbouring symbols is merged, leftmost first. No sum of
scores describes an order of merges, so the two readings differ in ids; both are lossless.

Texts are cut into blocks of bounded size; each block meets the segmentations of its own atoms, so nothing that grows with the corpus is broadcast.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
#: Bytes of text that meet their dictionary in one Python group, that a task holds before it sends them, and per partition of the atoms.
BLOCK_CHARS, CHUNK_BYTES, ATOM_BYTES = 12_000_000, 4_000_000, 4_000_000
#: Characters up to which an atom is folded by an aggregate; words that are cut, and codes that a task bundles, at a time.
FOLD_CHARS, WORDS, HELD_CODES = 200, 50_000, 2_000_000
_CHUNK = pa.schema([("block", pa.int32()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("packed", pa.binary())])
DECODED = "doc_id long, n_ids long, ids_crc32 long, decoded string, lossless boolean"
_MARK = BLANK.encode()
_WORD = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


def default_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Pieces:
    """A model file's pieces that can be used, with ids and scores, its byte pieces, the score of a character without a piece, and which neighbouring characters pieces hold.

    ``kind`` tells the characters of such pairs apart (0: in none), ``inside`` which kinds are neighbours in a piece.
    """

    ordinary: tuple[tuple[str, int, float], ...]
    byte_id: tuple[int, ...]
    lowest: float
    kind: np.ndarray
    inside: np.ndarray
    longest: int

    def atoms(self, of: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """The atoms of all given words, one after the other, and how many each word has."""
        parts = [self._atoms(of.slice(at, WORDS)) for at in range(0, len(of), WORDS)]
        return pa.concat_arrays([pa.array([], pa.string()), *(a for a, _ in parts)]), np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)])

    def _atoms(self, of: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        ends = np.frombuffer(of.buffers()[1], np.int32)[of.offset : of.offset + len(of) + 1]
        raw = bytes(memoryview(of.buffers()[2])[ends[0] : ends[-1]])
        ends = ends[1:] - ends[0]
        codes = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        after = np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000), dtype=np.int32)  # the byte after each character
        kind = self.kind[codes]
        cut = np.append(~self.inside[kind[:-1], kind[1:]], True)  # whether an atom ends with this character
        last = np.searchsorted(after, ends)
        cut[last] = True
        offsets = np.append(np.zeros(1, np.int32), after[cut])
        atoms = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(raw))
        return atoms, np.diff(np.cumsum(cut)[last], prepend=0)

    def unknown(self, char: str) -> list[int]:
        return [self.byte_id[b] for b in char.encode("utf-8", "surrogatepass")]


def words(text: str | None) -> list[str]:
    """The text as the model sees it (a blank in front, blanks as U+2581), cut before each run of blanks. Empty or null: none."""
    return _WORD.findall(BLANK + text.replace(" ", BLANK)) if text else []


def index_words(texts: list[bytes | None]) -> tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``words`` finds in all texts: the words, a number among them for each place, and how many places each text has, texts in the order that comes last."""
    plain = np.array([bool(t) and not t.startswith(b" ") and b"  " not in t and _MARK not in t for t in texts], dtype=bool)
    order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))
    cut = pc.split_pattern(pa.array([texts[i] for i in np.flatnonzero(plain)], pa.large_binary()).cast(pa.large_string()), " ")
    one = cut.flatten().dictionary_encode()
    others = [words((texts[i] or b"").decode("utf-8", "surrogatepass")) for i in np.flatnonzero(~plain)]
    two = pa.array([w for x in others for w in x], pa.string()).dictionary_encode()
    known = pa.concat_arrays([pc.binary_join_element_wise(BLANK, one.dictionary.cast(pa.string()), ""), two.dictionary])
    places = np.concatenate((one.indices.to_numpy(zero_copy_only=False), two.indices.to_numpy(zero_copy_only=False) + len(one.dictionary)))
    counts = np.concatenate((cut.value_lengths().to_numpy(zero_copy_only=False), [len(x) for x in others])).astype(np.int64)
    return known, places.astype(np.int32), counts, order


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)))


def _take(values: np.ndarray, edges: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``rows`` of values cut at ``edges``, one after the other, and where each begins."""
    size = edges[rows + 1] - edges[rows]
    at = _offsets(size)
    return values[np.repeat(edges[rows] - at[:-1], size) + np.arange(at[-1])], at


@lru_cache(maxsize=4)
def processor(path: str, unigram: bool = False):
    """The library's processor; ``unigram`` reads the same pieces and scores as a unigram model."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        raw = f.read()
    if unigram:
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(raw)
        proto.trainer_spec.model_type = sentencepiece_model_pb2.TrainerSpec.UNIGRAM
        raw = proto.SerializeToString()
    return sentencepiece.SentencePieceProcessor(model_proto=raw)


def _model(path: str):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    if proto.normalizer_spec.name != "identity" or not proto.trainer_spec.byte_fallback:
        raise ValueError("only models with identity normalisation and byte fallback are supported")
    return proto.pieces, sentencepiece_model_pb2.ModelProto.SentencePiece


@lru_cache(maxsize=4)
def pieces(path: str, merges: bool = False) -> Pieces:
    """Without ``merges``, a piece whose own parts add up to more than its score is left out: no best path holds it."""
    found, kind = _model(path)
    ordinary = [(p.piece, i, float(p.score)) for i, p in enumerate(found) if p.type == kind.NORMAL]
    lowest = min(s for _, _, s in ordinary if s > -1e8) - 10.0
    if not merges:
        best: dict[str, float] = {}
        kept = set()
        for p, _, s in sorted(ordinary, key=lambda x: len(x[0])):
            parts = max((best.get(p[:k], -np.inf) + best.get(p[k:], -np.inf) for k in range(1, len(p))), default=-np.inf)
            best[p] = max(parts, s)
            if s >= parts:
                kept.add(p)
        ordinary = [x for x in ordinary if x[0] in kept]
    chars = sorted({c for p, _, _ in ordinary if len(p) > 1 for c in p})
    number = np.zeros(0x110000, dtype=np.uint16)
    number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
    inside = np.zeros((len(chars) + 1, len(chars) + 1), dtype=bool)
    for p, _, _ in ordinary:
        of = number[[ord(c) for c in p]]
        inside[of[:-1], of[1:]] = True
    return Pieces(tuple(ordinary), tuple(i for i, p in enumerate(found) if p.type == kind.BYTE), lowest, number, inside, max(len(p) for p, _, _ in ordinary))


@lru_cache(maxsize=4)
def said_by(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that all pieces say, one after the other, and where each begins; control pieces say nothing."""
    found, kind = _model(path)
    said = [bytes([int(p.piece[3:5], 16)]) if p.type == kind.BYTE else p.piece.replace(BLANK, " ").encode() if p.type == kind.NORMAL else b"" for p in found]
    return np.frombuffer(b"".join(said), np.uint8), _offsets(np.array([len(x) for x in said]))


def lattice(windows: DataFrame, model: Pieces, keys: list[str]) -> DataFrame:
    """Edges ``keys, end, start, score, id`` that begin at the first ``starts`` characters of a ``window``, an atom of ``n`` characters from its character ``base`` on.

    Characters without a piece get id -1. Substrings are as long as the longest piece with their first three characters. Pieces are found by a hash and then
    compared; both tables are the model's, of fixed size.
    """
    spark = windows.sparkSession
    known = spark.createDataFrame(list(model.ordinary), "piece string, id int, score double").withColumn("hash", F.xxhash64("piece"))
    longest: dict[str, int] = {}
    for p, _, _ in model.ordinary:
        if len(p) > 2:
            longest[p[:3]] = max(len(p), longest.get(p[:3], 0))
    reach = spark.createDataFrame(list(longest.items()), "prefix string, longest int")
    at = F.explode(F.sequence(F.lit(0), F.col("starts") - 1))
    rest = windows.select(*keys, "window", "base", "n", at.alias("at")).select(*keys, (F.col("base") + F.col("at")).alias("start"), "n", F.expr(f"substring(window, at + 1, {model.longest})").alias("rest"))
    rest = rest.join(F.broadcast(reach), F.substring("rest", 1, 3) == F.col("prefix"), "left")
    length = F.explode(F.sequence(F.lit(1), F.least(F.coalesce("longest", F.lit(2)), F.col("n") - F.col("start"))))
    parts = rest.select(*keys, "start", "rest", length.alias("len")).select(*keys, "start", "len", F.expr("substring(rest, 1, len)").alias("part"))
    edges = parts.join(F.broadcast(known), F.xxhash64("part") == F.col("hash"), "left").withColumn("id", F.when(F.col("part").eqNullSafe(F.col("piece")), F.col("id")))
    edges = edges.where(F.col("id").isNotNull() | (F.col("len") == 1))
    score = F.when(F.col("id").isNotNull(), F.col("score")).otherwise(F.lit(model.lowest))
    return edges.select(*keys, (F.col("start") + F.col("len")).alias("end"), "start", score.alias("score"), F.coalesce("id", F.lit(-1)).alias("id"))


def fold_viterbi(edges: str = "edges") -> F.Column:
    """Ids of the segmentation with the largest sum of scores; of equal sums, the longer last piece."""
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("start"), F.lit(0).alias("id")))

    def step(best, e):
        found = F.struct((F.get(best, e["start"])["score"] + e["score"]).alias("score"), e["start"].alias("start"), e["id"].alias("id"))
        last = F.size(best) - 1
        return F.when(e["end"] > last, F.concat(best, F.array(found))).when(
            found["score"] > F.get(best, e["end"])["score"], F.concat(F.slice(best, F.lit(1), last), F.array(found))
        ).otherwise(best)

    def back(best):
        end = F.struct((F.size(best) - 1).alias("at"), F.array().cast("array<struct<at: int, id: int>>").alias("ids"))
        walk = F.aggregate(
            best, end,
            lambda s, _: F.when(s["at"] == 0, s).otherwise(F.struct(
                F.get(best, s["at"])["start"].alias("at"),
                F.concat(F.array(F.struct(F.get(best, s["at"])["start"].alias("at"), F.get(best, s["at"])["id"].alias("id"))), s["ids"]).alias("ids"),
            )),
        )
        return walk["ids"]

    return F.aggregate(F.col(edges), start, step, back)


def fold_merges(edges: str = "edges") -> F.Column:
    """Ids that are left when the best-scored edge over two neighbouring symbols is merged until there is none; leftmost of equal ones first."""
    by_span = F.map_from_entries(F.transform(F.col(edges), lambda e: F.struct((e["start"].cast("long") * 4096 + e["end"]).alias("k"), e.alias("e"))))

    def folded(m):
        length = F.get(F.col(edges), F.size(edges) - 1)["end"]

        def step(b, _):
            gain = F.transform(
                F.slice(b, F.lit(1), F.greatest(F.size(b) - 2, F.lit(0))),
                lambda x, k: F.struct(F.try_element_at(m, x.cast("long") * 4096 + F.get(b, k + 2))["score"].alias("score"), (-k).alias("k")),
            )
            best = F.array_max(F.filter(gain, lambda g: g["score"].isNotNull()))
            # bound once: a lambda would look for it again at every bound
            return F.get(F.transform(F.array(best), lambda g: F.when(g.isNull(), b).otherwise(F.filter(b, lambda x, i: i != F.lit(1) - g["k"]))), 0)

        bounds = F.aggregate(F.sequence(F.lit(1), length), F.sequence(F.lit(0), length), step)
        return F.transform(
            F.slice(bounds, F.lit(1), F.size(bounds) - 1), lambda x, k: F.struct(x.alias("at"), F.try_element_at(m, x.cast("long") * 4096 + F.get(bounds, k + 1))["id"].alias("id"))
        )

    return F.get(F.transform(F.array(by_span), folded), 0)


def segment(atoms: DataFrame, path: str, merges: bool = False) -> DataFrame:
    """``atom, codes`` from ``atom, n``: the segmentation of each distinct atom of at most ``FOLD_CHARS`` characters; a character without a piece is told by its place, -1 - at.

    Rows placed by atom stay where they are: joining the pieces and grouping the edges need no exchange then.
    """
    model = pieces(path, merges)
    edge = F.struct("end", "start", "score", "id")
    windows = atoms.select("atom", F.col("atom").alias("window"), F.lit(0).alias("base"), "n", F.col("n").alias("starts"))
    ids = lattice(windows, model, ["atom"]).groupBy("atom").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    fold = fold_merges() if merges else fold_viterbi()
    return ids.select("atom", F.transform(fold, lambda x: F.when(x["id"] >= 0, x["id"]).otherwise(-1 - x["at"])).alias("codes"))


def best_path(edges: list[tuple[int, int, float, int]]) -> list[int]:
    """The rule of ``fold_viterbi`` over edges (end, start, score, code) in order."""
    best, back = [0.0], [(0, 0)]
    for end, start, score, code in edges:
        score += best[start]
        if end == len(best):
            best.append(score)
            back.append((start, code))
        elif score > best[end]:
            best[end], back[end] = score, (start, code)
    at, codes = len(back) - 1, []
    while at:
        at, code = back[at]
        codes.append(code)
    return codes[::-1]


def merged(edges: list[tuple[int, int, float, int]]) -> list[int]:
    """The rule of ``fold_merges``, with a heap of the neighbours that an edge spans."""
    span = {(start, end): (-score, code) for end, start, score, code in edges}
    n = edges[-1][0]
    after, before = list(range(1, n + 2)), list(range(-1, n + 1))
    ready = [(span[i, i + 2][0], i, i + 1, i + 2) for i in range(n - 1) if (i, i + 2) in span]
    heapq.heapify(ready)
    while ready:
        _, a, m, b = heapq.heappop(ready)
        if after[a] != m or after[m] != b:
            continue
        after[a], before[b], after[m] = b, a, -1
        for x, y, z in ((before[a], a, b), (a, b, after[b])):
            if x >= 0 and z <= n and (x, z) in span:
                heapq.heappush(ready, (span[x, z][0], x, y, z))
    at, codes = 0, []
    while at < n:
        codes.append(span[at, after[at]][1])
        at = after[at]
    return codes


def segment_long(atoms: DataFrame, path: str, merges: bool = False) -> DataFrame:
    """The same for atoms of any length, by the same edges and the same rule: an aggregate copies its state at each step, so here the edges of an atom are
    sorted and folded one atom after the other. An atom is expanded in windows, and its text doesn't go with its edges.
    """
    model, rule = pieces(path, merges), merged if merges else best_path
    atoms = atoms.select("atom", F.sha2("atom", 256).alias("key"), "n")
    base = F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(FOLD_CHARS)))
    window, starts = F.expr(f"substring(atom, base + 1, {FOLD_CHARS + model.longest})"), F.least(F.lit(FOLD_CHARS), F.col("n") - F.col("base"))
    windows = atoms.select("key", "n", "atom", base.alias("base")).select("key", "n", "base", window.alias("window"), starts.alias("starts"))
    edges = lattice(windows, model, ["key"]).repartition("key").sortWithinPartitions("key", "end", "start")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        for key, of in groupby(rows, lambda r: r[0]):
            codes = rule([(end, start, score, code if code >= 0 else -1 - start) for _, end, start, score, code in of])
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([codes], pa.list_(pa.int32()))], ["key", "codes"])

    codes = edges.select("key", "end", "start", "score", "id").mapInArrow(fold, "key string, codes array<int>")
    return atoms.join(codes, "key", "left").select("atom", "codes")  # an inner join would filter below the exchange of the atoms


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, merges: bool = False, block_chars: int = BLOCK_CHARS, decoded: bool = False) -> DataFrame:
    """``doc_id, text, ids``: each row's text and its piece ids, byte pieces for characters without a piece.

    With ``decoded`` the columns of ``decode`` instead, worked out where the ids are made.

    A null text stays null and has no ids, nor has an empty one. Repeated rows are encoded each. An empty table gives no rows. Other columns are ignored.
    """
    path = path or default_path()
    size = df.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_chars))
    # numbers of blocks that hash partitioning deals one to a partition
    dealt = df.sparkSession.range(40 * n_blocks).select(F.col("id").cast("int").alias("id")).groupBy(F.pmod(F.hash("id"), F.lit(n_blocks))).agg(F.min("id").alias("id"))
    numbers = sorted(r.id for r in dealt.collect())

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of the same block together, compressed. Copies of one row are dealt over blocks by their number, so no row makes a block large."""
        z, copies, open_, held = zstandard.ZstdCompressor(level=6), Counter(), {}, 0

        def closed(block: int) -> pa.RecordBatch:
            ids, texts = open_.pop(block)
            sizes = [-1 if t is None else len(t) for t in texts]
            packed = z.compress(b"".join([t or b"" for t in texts]))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((block, ids, sizes, packed), _CHUNK.types)], schema=_CHUNK)

        for b in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                row = doc, xxhash.xxh3_64_intdigest(raw or b"")
                block = numbers[xxhash.xxh3_64_intdigest(repr((*row, copies[row] // 64))) % len(numbers)]
                copies[row] += 1
                chunk = open_.setdefault(block, ([], []))
                chunk[0].append(doc)
                chunk[1].append(raw)
                held += len(raw or b"")
            if held > CHUNK_BYTES:
                yield from [closed(k) for k in list(open_)]
                held = 0
        yield from [closed(k) for k in list(open_)]

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))
    packed = rows.mapInArrow(gather, "block int, ids array<long>, sizes array<int>, packed binary").repartition(n_blocks, "block")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, model, rows = zstandard.ZstdDecompressor(), pieces(path, merges), (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        for block, chunks in groupby(rows, lambda r: r[0]):
            known = pa.array([], pa.string())
            for part in _parts(z, ((sizes, blob) for _, _, sizes, blob in chunks)):
                known = pc.unique(pa.concat_arrays([known, index_words(part)[0]]))
            atoms = _sorted(model.atoms(known)[0])
            for at in range(0, len(atoms), 50_000):
                part = atoms.slice(at, 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block, np.int32)), pa.array(np.arange(at, at + len(part), dtype=np.int32)), part], ["block", "number", "atom"])

    # an atom has a row per block at most, so none is hot; all uses of these rows share one exchange, as no
    # filter can go below it: atoms are not null there already, and lengths are looked at after the grouping
    needs = packed.sortWithinPartitions("block").mapInArrow(split, "block int, number int, atom string").where("atom IS NOT NULL").repartition(max(8, size // ATOM_BYTES), "atom")
    known = needs.groupBy("atom").agg(F.max("block").alias("b"), F.max("number").alias("k"), F.max(F.length("atom")).alias("n")).where("b >= 0 AND k >= 0")  # keeps all columns in the exchange
    short, long = segment(known.where(F.col("n") <= FOLD_CHARS), path, merges), segment_long(known.where(F.col("n") > FOLD_CHARS), path, merges)
    codes = needs.join(short, "atom", "left").join(long.withColumnRenamed("codes", "of_long"), "atom", "left").select("block", "number", F.coalesce("codes", "of_long").alias("codes"))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's codes for each block in one row: differences of the numbers, sizes and codes, compressed."""
        z, held, n = zstandard.ZstdCompressor(level=3), [], 0

        def bundled() -> Iterator[pa.RecordBatch]:
            block, number, size, flat = (np.concatenate(x) for x in zip(*held))
            edges, order = _offsets(size), np.lexsort((number, block))
            block, number, cuts = block[order], number[order], np.flatnonzero(np.diff(block[order], prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(block)]):
                codes, ends = _take(flat, edges, order[a:b])
                said = b"".join(x.astype("<i4").tobytes() for x in (np.diff(number[a:b], prepend=0), np.diff(ends), codes))
                yield pa.RecordBatch.from_arrays([pa.array([block[a]], pa.int32()), pa.array([b - a], pa.int32()), pa.array([z.compress(said)], pa.binary())], ["block", "n", "packed"])

        for b in batches:
            size = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), size, b.column(2).flatten().to_numpy()))
            n += b.num_rows + len(held[-1][3])
            if n > HELD_CODES:
                yield from bundled()
                held, n = [], 0
        if held:
            yield from bundled()

    codes = codes.mapInArrow(bundle, "block int, n int, packed binary")

    def write(left: pa.Table, right: pa.Table) -> pa.Table:
        z, model = zstandard.ZstdDecompressor(), pieces(path, merges)
        docs = [doc for ids in left.column("ids").to_pylist() for doc in ids]
        parts = [(texts, *index_words(texts)) for texts in _parts(z, zip(left.column("sizes").to_pylist(), left.column("packed").to_pylist()))]
        known = pc.unique(pa.concat_arrays([pa.array([], pa.string()), *(p[1] for p in parts)]))
        atoms, n_atoms = model.atoms(known)
        names = _sorted(atoms)  # their numbers are those of the split
        told = [(n, np.frombuffer(z.decompress(x), "<i4")) for n, x in zip(right.column("n").to_pylist(), right.column("packed").to_pylist())]
        number, size, flat = (np.concatenate([np.zeros(0, np.int32), *x]) for x in ([np.cumsum(x[:n]) for n, x in told], [x[n : 2 * n] for n, x in told], [x[2 * n :] for n, x in told]))
        if len(number) != len(names):
            raise RuntimeError("an atom of the texts has no segmentation")
        flat, edges = _with_bytes(*_take(flat, _offsets(size), np.argsort(number)), names, model)
        of_words, ends = _take(flat, edges, pc.index_in(atoms, value_set=names).to_numpy(zero_copy_only=False).astype(np.int64))
        ends, at, out = ends[_offsets(n_atoms)], 0, []
        for k, (texts, words_, places, counts, order) in enumerate(parts):
            parts[k] = None
            of = pc.index_in(words_, value_set=known).to_numpy(zero_copy_only=False).astype(np.int64)
            ids, where = _take(of_words, ends, of[places])
            ids = pa.ListArray.from_arrays(pa.array(where[_offsets(counts)].astype(np.int32)), pa.array(ids.astype(np.int32)))
            doc = pa.array([docs[at + i] for i in order], pa.int64())
            out.append(pa.record_batch([doc, pa.array([texts[i] for i in order], pa.binary()).cast(pa.string()), ids], ["doc_id", "text", "ids"]))
            at += len(texts)
        return pa.Table.from_batches(list(_decoded(out, path)) if decoded else out)

    return packed.groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(write, DECODED if decoded else "doc_id long, text string, ids array<int>")


def _with_bytes(flat: np.ndarray, edges: np.ndarray, names: pa.StringArray, model: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Codes with the byte pieces of the characters that have no piece (code -1 - place), and where each atom's codes begin."""
    gaps = np.flatnonzero(flat < 0)
    if not len(gaps):
        return flat, edges
    rows = np.searchsorted(edges, gaps, side="right") - 1
    said = [model.unknown(names[int(r)].as_py()[-1 - int(flat[g])]) for r, g in zip(rows, gaps)]
    size = np.ones(len(flat), dtype=np.int64)
    size[gaps] = [len(x) for x in said]
    at = _offsets(size)
    out = np.repeat(flat, size)
    for g, x in zip(gaps, said):
        out[at[g] : at[g + 1]] = x
    return out, at[edges]


def _sorted(atoms: pa.StringArray) -> pa.StringArray:
    found = pc.unique(atoms)
    return found.take(pc.sort_indices(found))


def _parts(z: zstandard.ZstdDecompressor, chunks: Iterable[tuple[list[int], bytes]]) -> Iterator[list[bytes | None]]:
    """The texts of chunks (sizes, -1 for null, and the packed bytes), some megabytes at a time."""
    out, held = [], 0
    for sizes, blob in chunks:
        raw, ends = z.decompress(blob), _offsets(np.maximum(np.array(sizes, dtype=np.int64), 0)).tolist()
        out += [None if n < 0 else raw[a:b] for n, a, b in zip(sizes, ends[:-1], ends[1:])]
        held += len(raw)
        if held > CHUNK_BYTES:
            yield out
            out, held = [], 0
    if out:
        yield out


def _decoded(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    said, edges = said_by(path)
    for b in batches:
        for at in range(0, b.num_rows, 64):
            part = b.slice(at, 64)
            ids = part.column(2).flatten().to_numpy(zero_copy_only=False)
            ends = _offsets(part.column(2).value_lengths().to_numpy(zero_copy_only=False))
            raw, where = _take(said, edges, ids)
            raw, of = raw.tobytes(), where[ends].tolist()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(of[:-1], of[1:])]
            texts = [t[1:] if t.startswith(" ") else t for t in texts]
            same = [s == (t or "") for s, t in zip(texts, part.column(1).to_pylist())]
            ids = ids.astype("<u4")
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64()), pa.array(texts, pa.string()), pa.array(same)], ["doc_id", "n_ids", "ids_crc32", "decoded", "lossless"]
            )


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_ids, ids_crc32, decoded, lossless``: the text that the ids say, and whether it is the row's own text (null counts as empty)."""
    path = path or default_path()

    return encoded.mapInArrow(lambda batches: _decoded(batches, path), DECODED)
