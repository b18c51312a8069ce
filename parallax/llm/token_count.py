"""Token counts by overlap resynchronisation.

A text up to CHUNK characters is encoded whole (through the exact word cache). A longer one is encoded in overlapping chunks with
offsets; neighbours are spliced at a boundary that both encodings have and that is proven stable: the character before it is ASCII
white space, across which the vocabulary neither normalises nor merges. When an overlap holds no such boundary it is widened, in the
end to the rest of the text, so the count always equals that of the whole text.

Null and empty texts have 0 bytes and 0 tokens. Each row gives one row, repeated or null ids included; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import map_texts, table
from .word_cache import SLICE, WordEncoder
from .word_index import byte_lengths, byte_slices

#: Characters of a chunk, of its first overlap, and the white space at which encodings are independent.
CHUNK, OVERLAP, WHITE = 65_536, 1_024, frozenset(" \t\n\x0b\x0c\r")
LIMIT = 2048


def resync_ids(library: Tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The ids of text, from encodings of chunks that overlap."""
    ids: list[int] = []
    start, cut = 0, 0  # where the current chunk begins, and the splice before which its tokens don't count
    while True:
        width = overlap
        while True:
            end = min(len(text), start + chunk + width)
            left = library.encode(text[start:end], add_special_tokens=False)
            if end == len(text):
                return ids + [i for i, (a, _) in zip(left.ids, left.offsets, strict=True) if start + a >= cut]
            begin = end - width
            right = library.encode(text[begin:end], add_special_tokens=False)
            shared = {start + a for a, _ in left.offsets} & {begin + a for a, _ in right.offsets}
            stable = [b for b in shared if b > max(begin, cut) and text[b - 1] in WHITE]
            if stable:
                break
            width *= 2
        splice = min(stable)
        ids += [i for i, (a, _) in zip(left.ids, left.offsets, strict=True) if cut <= start + a < splice]
        start, cut = splice, splice


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens (without begin, end or added special tokens)."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        words = WordEncoder.of(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = pc.fill_null(batch.column(1), "")
            size = byte_lengths(texts)
            counts = np.zeros(len(size), np.int64)
            short = np.flatnonzero(size <= chunk)
            rest = texts.take(pa.array(short))
            for a, b in byte_slices(rest, SLICE):
                counts[short[a:b]] = words.counts(rest.slice(a, b - a))
            for i in np.flatnonzero(size > chunk).tolist():
                counts[i] = len(resync_ids(words.library, texts[i].as_py(), chunk, overlap))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(counts)], ["id", "n_bytes", "n_tokens"])

        return step

    kind = df.schema[id_col].dataType.simpleString()
    return map_texts(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), make, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLE: dict[str, str] = {}
