"""Sharding along a Hilbert curve: rows near each other in several metadata dimensions share files."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, ship
from .hilbert import hilbert_index

ship(__name__)

#: Bits a dimension is quantised to.
BITS = 8


def _category(c: str) -> Column:
    """A category's cell: its checksum, folded to BITS bits; null has cell 0."""
    return F.coalesce(F.crc32(F.col(c).cast("string")) % (1 << BITS), F.lit(0)).cast("int")


def _magnitude(size: Column) -> Column:
    """A size's cell: eight steps for each doubling."""
    return F.least(F.floor(F.log2(size.cast("double") + 1) * 8), F.lit((1 << BITS) - 1)).cast("int")


def global_rank(df: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """``df`` with ``rank`` (0 ... n-1 along ``order``), and n. No task sees more than its own range.

    Rows are range-partitioned and sorted, kept durably, and counted by partition; the counts, one
    number for each partition, are all that the driver gets.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = durable(df.repartitionByRange(n, *order).sortWithinPartitions(*order))
    kept = kept.withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33).cast("int")
    sizes = {r[0]: r[1] for r in kept.groupBy(part.alias("p")).count().collect()}
    first, total = {}, 0
    for p in sorted(sizes):
        first[p], total = total, total + sizes[p]
    if not total:
        return kept.withColumn("rank", F.lit(0).cast("long")).drop("__at"), 0
    offsets = F.array(*[F.lit(first.get(p, 0)).cast("long") for p in range(max(first) + 1)])
    within = F.col("__at").bitwiseAND((1 << 33) - 1)
    return kept.withColumn("rank", F.get(offsets, part) + within).drop("__at"), total


def hilbert_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row for each row of ``docs``: its size, checksum, shard and place in the shard.

    Language, source and size are quantised to one grid, rows are ordered by their index on its
    Hilbert curve, then by the text's checksum (so equal texts stay together), then by doc_id, and
    the order is cut into ``shards`` runs whose row counts differ by at most one (law ``rows``).
    A hot cell is only a longer run and is cut like any other. Null texts have no bytes and the
    checksum of the empty text; null ids, languages and sources are ordinary values. With fewer
    rows than shards the last shards are empty. Columns that are not used are ignored; rows that
    repeat are kept, their order among each other is undefined.
    """

    @F.pandas_udf("long")
    def curve(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([a, b, c], axis=1).astype(np.int64), BITS))

    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long") + 8
    rows = docs.select("doc_id", size.alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
                       _category("lang").alias("a"), _category("source").alias("b"), _magnitude(size).alias("c"))
    rows = rows.withColumn("hilbert", curve("a", "b", "c")).drop("a", "b", "c")
    ranked, n = global_rank(rows, "hilbert", "text_crc32", "doc_id")
    base, more = divmod(n, shards)
    full = more * (base + 1)
    rank = F.col("rank")
    late = rank >= full
    shard = F.when(late, more + F.floor((rank - full) / max(base, 1))).otherwise(F.floor(rank / (base + 1)))
    slot = F.when(late, (rank - full) % max(base, 1)).otherwise(rank % (base + 1))
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"),
                         slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def write_shards(docs: DataFrame, path: str, shards: int = 24) -> DataFrame:
    """Write ``docs`` as one folder for each shard, rows in slot order, and return the assignment.

    ``doc_id`` must be unique here; Parquet's footers then carry narrow ranges of every dimension.
    """
    where = hilbert_shards(docs, shards)
    out = docs.join(where.select("doc_id", "shard", "slot"), "doc_id")
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return where
