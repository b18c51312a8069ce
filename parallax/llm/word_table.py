"""The bounded samples of labelled documents that classifiers learn from, and counts over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_share
from .word_index import byte_slices


def per_group_sample(df: DataFrame, group: str, id_col: str, most: int) -> DataFrame:
    """(group, id): at most `most` ids of each group, the first by their hash: the same at every run.

    Groups are counted first, and rows whose hash is too great to be chosen are dropped where they are read, so that what leaves the tasks is
    about twice the sample of each group (a class or a language), however large it is; of these the first are taken.
    """
    share = df.groupBy(group).agg((2.0 * most / F.approx_count_distinct(id_col, 0.02)).alias("_share"))
    near = df.select(group, id_col, hash_share(id_col).alias("_hash")).join(F.broadcast(share), group).filter((F.col("_hash") < F.col("_share")) | (F.col("_share") >= 1))  # a row for each group
    left: dict = {}
    for g, i, h in near.select(group, id_col, "_hash").distinct().collect():
        left.setdefault(g, []).append((h, i))
    chosen = [(g, i) for g, rows in left.items() for _, i in sorted(rows)[:most]]
    return df.sparkSession.createDataFrame(chosen, df.select(group, id_col).schema)


def grouped_counts(df: DataFrame, group: str, text_col: str, count: Callable[[pa.Array], tuple[list[pa.Array], np.ndarray]], keys: str) -> DataFrame:
    """(group, *keys, n) over all rows: count(texts of one group) gives key columns and how often each key occurs, for a slice of texts in
    a task; Spark sums up."""
    kind = df.schema[group].dataType.simpleString()
    names = [k.split(" ")[0] for k in keys.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(0)
            for g in groups.unique():
                texts = batch.column(1).filter(pc.equal(groups, g))
                for a, b in byte_slices(texts, 8_000_000):
                    cells, n = count(texts.slice(a, b - a))
                    yield pa.RecordBatch.from_arrays([pa.array([g.as_py()] * len(n), groups.type), *cells, pa.array(n, pa.int64())], ["group", *names, "n"])

    parts = df.select(F.col(group).alias("group"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"group {kind}, {keys}, n long")
    return parts.groupBy("group", *names).agg(F.sum("n").alias("n"))
