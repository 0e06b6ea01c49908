"""Minimax contiguous sharding of atomic groups.

Groups (equal texts) are laid out in the order of a 64-bit hash of the text; shards are contiguous runs
of that order. The smallest capacity for which a greedy walk needs no more than ``n_shards`` shards is found by binary
search, and the walk with that capacity gives the cuts. The driver never sees the groups: it works on
a histogram of the hash space, and asks Spark for a finer one only where a cut can fall, level by level, until
every cell that matters holds a single group. The answer is the exact minimax.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridobs.llm._shared import materialize, rank_in_group, utf8_size

LEVEL_BITS = 12


def _cells(groups: DataFrame, bits: int, inside: list[int] | None, inside_bits: int) -> list[tuple[int, int, int]]:
    """(first position, bytes, groups) of the cells of ``2**bits`` equal parts; only below the given coarser cells."""
    cell = F.expr(f"shiftrightunsigned(pos, {64 - bits})") if bits < 64 else F.col("pos")
    if inside is not None:
        coarse = groups.sparkSession.createDataFrame([(int(c),) for c in inside], "cell long")
        groups = groups.withColumn("cell", F.expr(f"shiftrightunsigned(pos, {64 - inside_bits})")).join(F.broadcast(coarse), "cell", "left_semi")
    found = groups.groupBy(cell.alias("c")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).collect()
    return [(((r.c % (1 << bits)) << (64 - bits)), r.bytes, r.n) for r in found]


def _walk(ends: np.ndarray, loose: np.ndarray, capacity: int, n_shards: int, optimistic: bool) -> list[int]:
    """Greedy cut positions (bytes before each cut) for a capacity; stops after ``n_shards`` steps.

    ``loose`` marks cells of several groups. The optimistic walk may cut anywhere inside them, the
    other one only at their edges.
    """
    cuts, at, total = [], 0, int(ends[-1]) if len(ends) else 0
    for _ in range(n_shards):
        i = int(np.searchsorted(ends, at + capacity, side="right"))
        if optimistic and i < len(ends) and loose[i]:
            at = at + capacity
        else:
            at = max(at, int(ends[i - 1]) if i else 0)
        cuts.append(at)
        if at >= total:
            break
    return cuts


def _smallest(ends: np.ndarray, loose: np.ndarray, n_shards: int, optimistic: bool) -> int:
    total = int(ends[-1])
    low, high = -(-total // n_shards), total
    while low < high:
        mid = (low + high) // 2
        if _walk(ends, loose, mid, n_shards, optimistic)[-1] >= total:
            high = mid
        else:
            low = mid + 1
    return low


def minimax_cuts(groups: DataFrame, n_shards: int) -> tuple[int, list[int]]:
    """Smallest capacity and the first position (unsigned) of every shard but the first.

    ``groups`` has ``pos`` (long, read as unsigned; one row per value) and ``bytes``.
    """
    bits = LEVEL_BITS
    cells = _cells(groups, bits, None, 0)
    while True:
        cells.sort()
        if not cells:
            return 0, []
        ends = np.cumsum([b for _, b, _ in cells])
        starts = ends - np.array([b for _, b, _ in cells])
        loose = np.array([n > 1 for _, _, n in cells]) if bits < 64 else np.zeros(len(cells), bool)
        low, high = _smallest(ends, loose, n_shards, True), _smallest(ends, loose, n_shards, False)
        first, last = _walk(ends, loose, low, n_shards, False), _walk(ends, loose, high, n_shards, True)
        refine = np.zeros(len(cells), bool)
        for a, b in zip(first, last + [int(ends[-1])] * (len(first) - len(last))):
            refine |= loose & (ends >= min(a, b)) & (starts <= max(a, b))
        if not refine.any():
            break
        # cells below other levels keep their coarse width: their positions are what counts
        width = bits
        bits = min(64, bits + LEVEL_BITS)
        inside = [cells[i][0] >> (64 - width) for i in np.flatnonzero(refine) if cells[i][0] % (1 << (64 - width)) == 0]
        cells = [c for i, c in enumerate(cells) if not refine[i]] + _cells(groups, bits, [_signed_cell(c, width) for c in inside], width)
    cuts = [c for c in _walk(ends, loose, high, n_shards, False) if c < ends[-1]]
    return high, [cells[int(np.searchsorted(ends, c, side="right"))][0] for c in cuts]


def _signed_cell(cell: int, bits: int) -> int:
    return cell - (1 << 64) if bits == 64 and cell >= 1 << 63 else cell


def shard_by_bytes(df: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every row: shards of nearly equal bytes, equal texts never apart.

    Returns ``doc_id, size, text_crc32, shard, slot``. A row's size is the UTF-8 bytes of its text plus 1; a null text has no bytes,
    its checksum is 0, and all null texts are one group, apart from the empty texts. Repeated rows are
    sharded once each, into the same shard. An empty table gives an empty result. Other columns are ignored.
    A group larger than an equal share makes its own shard larger; nothing splits it.
    """
    text = F.col(text_col)
    rows = materialize(
        df.select(
            F.col(id_col).alias("doc_id"), (utf8_size(text) + 1).alias("size"),
            F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
            F.xxhash64(text).alias("pos"),
        )
    )
    groups = materialize(rows.groupBy("pos").agg(F.sum("size").alias("bytes")))
    _, starts = minimax_cuts(groups, n_shards)
    order = F.col("pos").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order as signed
    shard = F.lit(0)
    for s in starts:
        shard = shard + (order >= F.lit(s - (1 << 63))).cast("int")
    placed = rows.withColumn("shard", shard.cast("int")).drop("pos")
    return rank_in_group(placed, "shard", ["doc_id", "text_crc32", "size"], "slot").select("doc_id", "size", "text_crc32", "shard", "slot")


def write_shards(df: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the rows of ``df`` as one folder per shard, in slot order. ``id_col`` has to be unique."""
    where = placed.select(F.col("doc_id").alias("_id"), "shard", "slot")
    (
        df.join(where, df[id_col].eqNullSafe(where["_id"])).drop("_id")
        .repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    )
