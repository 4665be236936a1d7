"""Helpers that the corpus operators share: tables on shared storage, column hygiene, fold rule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..functions.storage import shared_dir, stored

__all__ = ["held_out", "numbered", "pick", "pieces", "shared_dir", "stored", "table"]

#: Bytes of text that a task turns into Python objects at once, give or take its last text; an Arrow batch has up to 64 MB.
PIECE = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, cast to the stated types; other columns never reach an operator."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in columns.items()])


def held_out(doc_id: Column | str) -> Column:
    """Whether crc32 of the id as text leaves 0 modulo 5; a null id is held out, so that it never teaches."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def pieces(batches: Iterator[pa.RecordBatch], column: int, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches, each cut (not copied) into runs of rows with about ``limit`` bytes in a column of texts; no row is left out."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        piece = (np.cumsum(size) - size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), b.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            yield b.slice(start, end - start)
