"""Sharding by a two-pass external shuffle.

Pass one scatters rows by a seeded hash of their content into buckets that fit in a task's
memory. Pass two shuffles every bucket by Fisher-Yates and hands out places in the global
order; shards are ranges of that order, so a bucket's task writes to the one or two shards
that its range touches and no third shuffle is needed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropping, unused, written

#: Bytes of a bucket on average, and buckets at least.
BUCKET_BYTES = 32 << 20
MIN_BUCKETS = 48
#: Buckets that one task shuffles, one after the other, where there are many.
TOGETHER = 8
OUT = ["position", "shard", "slot"]


def shuffle_shards(df: DataFrame, n_shards: int = 24, seed: int = 20240607, bucket_bytes: int = BUCKET_BYTES, text: str = "text") -> DataFrame:
    """All rows and columns of ``df`` in a random order that ``seed`` and the rows decide, with
    ``position`` (from 0), ``shard`` and ``slot`` (gapless from 0 within the shard).

    Law ``rows``: row counts of shards differ by one at most. Buckets are as many as the bytes
    ask for; the driver gets two numbers for each. Rows meet in a bucket only by the hash of all
    their columns, so one source, one key or one text held by a third of all rows does not make a
    bucket larger than the others. Rows equal in every column, if they are more than a bucket
    holds, go as counted portions to buckets of their own (not where ``df`` has a map or variant
    column, which has no equality; their other columns are hashed). Nulls in any column are values
    like others; a text of any length is one row, and a bucket that holds it is as large; an empty
    table gives an empty result; input columns named ``position``, ``shard`` or ``slot`` are
    replaced, all others stay, whatever their names.
    """
    df = dropping(df, OUT, keep=(text,))
    hash_, bucket_, times, portions_, k = unused(df, "hash", "bucket", "times", "portions", "k")
    hashed = [c for c, kind in df.dtypes if not kind.startswith(("map", "variant", "void"))]
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + 8
    row = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in hashed], *[F.col(f"`{c}`").isNull() for c in hashed])
    own = written(df.select(row.alias("h"), size.alias("b")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b")))
    total = own.agg(F.sum("b")).first()[0] or 0
    n_buckets = max(MIN_BUCKETS, math.ceil(total / bucket_bytes))
    bucket = lambda c: F.pmod(c, F.lit(n_buckets)).cast("int")

    rows, counted = df.withColumn(hash_, row).withColumn(times, F.lit(1).cast("long")), own.select("h", "n")
    hot = own.where((F.col("b") > bucket_bytes) & (F.col("n") > 1)) if len(hashed) == len(df.columns) else own.limit(0)
    if not hot.isEmpty():  # at most total / bucket_bytes of them
        hot = F.broadcast(hot.select(F.col("h").alias(hash_), F.ceil(F.col("b") / bucket_bytes).cast("long").alias(portions_)))
        own_columns = [f"`{c}`" for c in df.columns]
        grouped = written(rows.join(hot.drop(portions_), hash_, "left_semi").groupBy(*own_columns, hash_).agg(F.count(F.lit(1)).alias(times)))
        each = grouped.join(hot, hash_).select(*own_columns, hash_, times, portions_, F.explode(F.expr(f"sequence(0L, {portions_} - 1)")).alias(k))
        share = F.expr(f"{times} * ({k} + 1) div {portions_} - {times} * {k} div {portions_}")
        portions = each.select(*own_columns, F.xxhash64(F.lit(seed), hash_, k).alias(hash_), share.alias(times)).where(F.col(times) > 0)
        rows = rows.join(hot.drop(portions_), hash_, "left_anti").select(*own_columns, hash_, times).unionAll(portions)
        counted = counted.join(hot, counted["h"] == F.col(hash_), "left_anti").unionAll(portions.select(hash_, times))
    in_bucket = np.zeros(n_buckets, np.int64)
    counts = counted.groupBy(bucket(F.col("h")).alias("bucket")).agg(F.sum("n").alias("n")).toArrow()
    in_bucket[counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    before = np.concatenate([[0], np.cumsum(in_bucket)])
    each, more = divmod(int(before[-1]), n_shards)
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("position", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def shuffle(table: pa.Table) -> pa.Table:
        bucket, n = table.column(bucket_)[0].as_py(), table.column(times).to_numpy()
        order = np.argsort(table.column(hash_).to_numpy(), kind="stable")  # the order of arrival may differ from run to run
        order = np.repeat(order, n[order])
        order = order[np.random.Generator(np.random.PCG64([seed, bucket])).permutation(len(order))]  # Fisher-Yates
        at = np.arange(before[bucket], before[bucket] + len(order))
        edge = more * (each + 1)
        shard = np.where(at < edge, at // (each + 1), more + (at - edge) // max(each, 1))
        start = np.where(shard < more, shard * (each + 1), edge + (shard - more) * each)
        large = pa.table([c.cast(pa.large_string()) if pa.types.is_string(c.type) else c for c in table.select(names).columns], names)  # portions may exceed 2 GB
        out = large.take(pa.array(order))
        for name, values in (("position", at), ("shard", shard.astype(np.int32)), ("slot", at - start)):
            out = out.append_column(name, pa.array(values))
        return out

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:  # in the order of their buckets
            of = b.column(bucket_).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if j > i:
                    if held and held[-1].column(bucket_)[0].as_py() != of[i]:
                        yield from _batches(shuffle(pa.Table.from_batches(held)), names)
                        held = []
                    held.append(b.slice(i, j - i))
        if held:
            yield from _batches(shuffle(pa.Table.from_batches(held)), names)

    tasks = min(n_buckets, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_buckets / TOGETHER)))
    scattered = rows.withColumn(bucket_, bucket(F.col(hash_)))
    dealt = scattered.repartitionById(tasks, F.expr(f"cast({bucket_} * {tasks}L div {n_buckets}L as int)"))
    return dealt.sortWithinPartitions(bucket_).mapInArrow(run, schema)


def _batches(table: pa.Table, names: list[str], rows: int = 4096):
    """Batches of the kinds that Spark expects."""
    for b in table.combine_chunks().to_batches(rows):
        columns = [c.cast(pa.string()) if pa.types.is_large_string(c.type) else c for c in b.columns]
        yield pa.RecordBatch.from_arrays(columns, [*names, *OUT])


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Write the shards of ``df`` as Parquet folders ``shard=0`` and so on. A bucket's task
    writes its own part of the one or two shards that it belongs to."""
    shuffle_shards(df, **options).write.partitionBy("shard").parquet(path)


def op1(spark, sf_dir: str) -> DataFrame:
    """Every document with its shard and slot."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return shuffle_shards(docs).select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
