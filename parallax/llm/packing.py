"""Sequence packing by the online sum-of-squares rule.

Windows hold SIZE tokens. N[h] counts the partially filled windows at fill level h. A document of s tokens (with its end id) first
gives off whole windows while s >= SIZE; what is left goes to the level h, or to a new window, for which the sum of N[h]**2 after the
move is least. Each task packs the documents of its own partition in order, with no shuffle, and names its windows by its partition, so
a task that runs again gives the same rows. At the end of a partition the windows still open are poured together: pieces are cut to
fill one window after the other, so that a partition pads one window at most.

Null and empty texts are the end id alone. Each row of the input is a document of its own, repeated or null ids included; other columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .word_cache import SLICE, WordEncoder
from .word_index import byte_slices

SIZE, END_ID = 4096, 2


class SumOfSquares:
    """place(item) for one partition; closed windows collect in done as lists of (document, start, ids, document tokens)."""

    def __init__(self, size: int = SIZE):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)  # at 0 and size stays 0: neither is partially filled
        self.levels: dict[int, list[list[tuple]]] = defaultdict(list)
        self.done: list[list[tuple]] = []

    def place(self, doc, ids: bytes) -> None:
        total = len(ids) // 4
        start = 0
        while total - start >= self.size:
            self.done.append([(doc, start, ids[4 * start : 4 * (start + self.size)], total)])
            start += self.size
        s = total - start
        if not s:
            return
        item = (doc, start, ids[4 * start :], total)
        n = self.count
        # Half the change of the sum of squares: one window fewer at h (none at 0), one more at h + s (none at size).
        change = n[s:].copy()
        change[:-1] += 1
        change[-1] = 0
        change[1:] -= n[1 : self.size - s + 1]
        change[1:][n[1 : self.size - s + 1] == 0] = np.iinfo(np.int64).max
        h = int(change.argmin())
        window = self.levels[h].pop() if h else []
        if h:
            n[h] -= 1
        window.append(item)
        if h + s == self.size:
            self.done.append(window)
        else:
            n[h + s] += 1
            self.levels[h + s].append(window)

    def pour(self) -> None:
        """Cut the contents of the open windows to fill windows one after the other; the last is left as it is."""
        window: list[tuple] = []
        filled = 0
        for level in sorted(self.levels, reverse=True):
            for old in self.levels[level]:
                for doc, start, ids, total in old:
                    while ids:
                        take = min(self.size - filled, len(ids) // 4)
                        window.append((doc, start, ids[: 4 * take], total))
                        ids, start, filled = ids[4 * take :], start + take, filled + take
                        if filled == self.size:
                            self.done.append(window)
                            window, filled = [], 0
        self.levels.clear()
        self.count[:] = 0
        if window:
            self.done.append(window)


def pack_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    kind = df.schema[id_col].dataType.simpleString()
    tail = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = WordEncoder.of(path), SumOfSquares(size)
        next_id = TaskContext.get().partitionId() << 40

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal next_id
            rows: list[tuple] = []
            for window in packer.done:
                offset = 0
                for doc, start, ids, total in window:
                    rows.append((doc, start, len(ids) // 4, ids, total, next_id, offset))
                    offset += len(ids) // 4
                next_id += 1
            packer.done = []
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary()), *(pa.array(c, pa.int64()) for c in cols[4:])], ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            docs, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in byte_slices(texts, SLICE):
                ids, begins = words.ids(texts.slice(a, b - a))
                for doc, x, y in zip(docs[a:b], begins[:-1], begins[1:], strict=True):
                    packer.place(doc, ids[x:y].tobytes() + tail)
                yield from flush()
        packer.pour()
        yield from flush()

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long").withColumnRenamed("id", id_col)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op6_packing": op6_packing}
ORACLE: dict[str, str] = {}
