"""Words of many texts at a time, as columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TEXT_BYTES = 4_000_000


def text_parts(batches: Iterator[pa.RecordBatch], column: int, size: int = TEXT_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches cut to about ``size`` bytes of text (a longer text is alone), with their texts; null is empty."""
    for b in batches:
        step = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)) // size
        edges = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), b.num_rows]
        for at, end in zip(edges[:-1], edges[1:]):
            if end > at:
                part = b.slice(at, end - at)
                yield part, [t or b"" for t in part.column(column).to_pylist()]


class Words:
    """The words of some UTF-8 texts one after the other: runs of anything but ASCII blanks.

    ``text``: the words; ``number``: equal words have equal numbers; ``spelled``: the word of each number; ``row``: the text of each word; ``count`` and ``start`` of each text's words.
    """

    def __init__(self, texts: list[bytes]):
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string(), safe=False))
        flat = lists.flatten()
        row = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
        said = np.flatnonzero(pc.binary_length(flat).to_numpy(zero_copy_only=False))  # blanks at the ends of a text leave empty strings
        if len(said) < len(flat):
            flat, row = flat.take(pa.array(said)), row[said]
        one = flat.dictionary_encode()
        self.text, self.row, self.spelled = flat, row, one.dictionary
        self.number = one.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.count = np.bincount(row, minlength=len(texts))
        self.start = np.cumsum(self.count) - self.count
