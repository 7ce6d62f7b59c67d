"""Sharding by a two-pass external shuffle.

Pass one scatters the rows into buckets that fit in memory, by a seeded hash of
the whole row, so that rows of a null or repeated id spread.  Pass two brings each bucket into a fixed order, permutes it by
Fisher-Yates (the inside-out form, its draws taken from a seeded hash of bucket
and step, so that a recomputed task gives the same permutation) and numbers the
rows on from the buckets before it.  Position p of the whole order goes to
shard p mod n at slot p div n: counts differ by at most one (law ``rows``).

The number of buckets follows the rows and their bytes; bucket offsets are summed in
two levels, so that no task sees more than about the square root of them.

Nulls: a null id is a value like any other; a null text has size 8 and checksum
0.  Repeated rows each get a slot of their own; rows equal in every column share
a bucket, in which their order is a tie that cannot be told.  An empty table
gives no rows.  A very long text counts towards its bucket's bytes.  Extra
columns are kept; where one is called ``shard`` or ``slot``, the new column gets
underscores before its name.  Columns must be of types that have a hash and an
order (no maps).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import partitions

BUCKET_ROWS, BUCKET_BYTES, FILE_ROWS, SEED = 256, 4 << 20, 4096, 17


def fisher_yates(n: str, bucket: str, seed: int = SEED) -> str:
    """SQL for a permutation of 0 .. n-1: step i puts i at a drawn place and moves what was there to the end."""
    draw = f"cast(pmod(xxhash64({seed}, {bucket}, i), i + 1) as int)"
    swap = "concat(slice(a.order, 1, a.at), array(i), slice(a.order, a.at + 2, greatest(i - a.at - 1, 0)), array(a.order[a.at]))"
    step = f"transform(array(named_struct('order', a, 'at', {draw})), a -> if(a.at = i, concat(a.order, array(i)), {swap}))[0]"
    return f"if({n} = 0, cast(array() as array<int>), aggregate(sequence(0, {n} - 1), cast(array() as array<int>), (a, i) -> {step}))"


def placed_names(df: DataFrame) -> tuple[str, str]:
    """Names for shard and slot that ``df`` does not have."""
    names = []
    for name in ("shard", "slot"):
        while name.lower() in {c.lower() for c in df.columns}:
            name = f"_{name}"
        names.append(name)
    return tuple(names)


def sharded(df: DataFrame, shards: int, bucket_rows: int = BUCKET_ROWS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``df``'s columns with ``shard`` and ``slot``."""
    long = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)).cast("long") for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    total, volume = df.agg(F.count("*"), F.coalesce(F.sum(sum(long, F.lit(0))), F.lit(0))).first()
    buckets = max(1, -(-total // bucket_rows), -(-volume // bucket_bytes))
    width = max(1, int(buckets**0.5))
    columns = [F.col(f"`{c}`") for c in df.columns]
    place = F.xxhash64(F.lit(seed), *columns)
    bucket = F.pmod(place, F.lit(buckets)).cast("int")
    row = F.struct(place.alias("hash"), F.struct(*columns).alias("row"))
    filled = df.select(bucket.alias("_bucket"), row.alias("_row")).groupBy("_bucket").agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    counts = df.select(bucket.alias("_bucket")).groupBy("_bucket").count().withColumn("_part", F.floor(F.col("_bucket") / width))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("_part").agg(F.sum("count").alias("_all")).select("_part", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_own", F.coalesce(F.sum("count").over(inside), F.lit(0))).join(parts, "_part").select("_bucket", (F.col("_base") + F.col("_own")).alias("_offset"))
    placed = (
        filled.join(offsets, "_bucket")
        .withColumn("_order", F.expr(fisher_yates("size(_rows)", "_bucket", seed)))
        .select("_offset", F.posexplode(F.expr("transform(_order, w -> _rows[w])")).alias("_place", "_row"))
        .select((F.col("_offset") + F.col("_place")).alias("_at"), "_row")
    )
    shard, slot = placed_names(df)
    return placed.select("_row.row.*", (F.col("_at") % shards).cast("int").alias(shard), F.floor(F.col("_at") / shards).cast("long").alias(slot))


def digest(docs: DataFrame, *more: str) -> DataFrame:
    """Id, size and checksum of each document as it is in ``docs``."""
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        *more,
    )


def write_shards(df: DataFrame, path: str, shards: int) -> None:
    """Whole records to one folder per shard, in files of ``FILE_ROWS`` slots each in slot order."""
    shard, slot = placed_names(df)
    dealt = sharded(df, shards).repartition(partitions(df), shard, F.floor(F.col(slot) / FILE_ROWS))
    dealt.sortWithinPartitions(shard, slot).write.partitionBy(shard).option("compression", "zstd").parquet(path)


def read_shards(df: DataFrame, path: str) -> DataFrame:
    """The records of ``df`` that ``write_shards`` has written, with shard and slot."""
    shard, slot = placed_names(df)
    return df.sparkSession.read.schema(StructType([*df.schema.fields, StructField(slot, LongType()), StructField(shard, IntegerType())])).parquet(path)
