"""What the corpus operators share: table access, tables in the shared folder, text chunks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, materialise, shared_dir, shared_path

__all__ = ["discard", "materialise", "shared_dir", "shared_path"]

#: A word is a run of anything but blank, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: Bytes of text that one vectorised step handles at most, unless a single text is longer.
CHUNK_BYTES = 1 << 18
#: Rows and bytes of an Arrow batch where Spark's defaults would apply.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Have Spark send whole texts to Python workers in smaller batches, unless the user has chosen a size.

    Batches exist several times over on their way through JVM and worker.
    """
    for setting, default, ours in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{setting}") == default:
            spark.conf.set(f"spark.sql.execution.arrow.{setting}", str(ours))


def chunks(batches: Iterable[pa.RecordBatch], column: int = 1) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of Arrow batches with the texts of a column (null as empty).

    A slice holds at most CHUNK_BYTES of text, or one longer text, so a worker's
    memory does not depend on how many rows Spark puts into a batch.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(sizes + 64)
        lo = 0
        while lo < batch.num_rows:
            base = upto[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(upto, base + CHUNK_BYTES, "right")))
            part = batch.slice(lo, hi - lo)
            yield part, [x or "" for x in part.column(column).to_pylist()]
            lo = hi


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), GAP)
    # split() leaves an empty string at either end when the text begins or ends with a gap
    ends = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (F.size(parts) - ends).cast("long")


def sha(text: Column) -> Column:
    """Content address of a text, its SHA-256 in binary (null counts as empty)."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))
