"""Sharding by a two-pass external shuffle (operator 7), in DataFrame functions only.

First pass: a seeded hash of the record's content scatters the records over buckets of a size that fits in memory.
Second pass: each bucket is gathered, brought into the order of another hash, shuffled (Spark's ``shuffle`` is a seeded
Fisher-Yates) and written.  The buckets' sizes, summed up in two levels, give each record its place in the whole
permutation; places are cut into shards whose row counts differ by one at most (law ``rows``).

Nothing depends on how the input is split into files or partitions: bucket and order follow from the content, and
records that are equal in every column are interchangeable.  Equal records that would fill a bucket by themselves are
counted, taken once and written out again over all buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

BUCKET_BYTES = 4 << 20
SUPER = 1024
"""Buckets that are summed up together before the sums of these groups are."""
SEED = 20_240_607
LEAST = 12
"""Buckets that a small table is dealt into."""
CHUNK = 1024
"""Copies of a record that are written out again by one row."""
ROW_BYTES = 64
SMALL = 10_000
"""Rows, counted before, up to which a table is broadcast."""


def _before(sizes: DataFrame) -> DataFrame:
    """(bucket, n) -> (bucket, base): rows in all buckets before.  No window holds more than SUPER rows, but the one over groups of SUPER buckets."""
    s = sizes.withColumn("group", F.floor(F.col("bucket") / SUPER))
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = s.withColumn("inside", F.coalesce(F.sum("n").over(up_to(Window.partitionBy("group").orderBy("bucket"))), F.lit(0)))
    groups = s.groupBy("group").agg(F.sum("n").alias("m"))
    groups = groups.withColumn("outside", F.coalesce(F.sum("m").over(up_to(Window.orderBy("group"))), F.lit(0))).select("group", "outside")
    return inside.join(groups, "group").select("bucket", (F.col("inside") + F.col("outside")).alias("base"))


def _hashed(docs: DataFrame, names: list[str], text: str, seed: int) -> DataFrame:
    """(h1, h2, size, record): two hashes of the columns that can be hashed, and the record."""
    plain = [F.col(c) for c in names if "map<" not in docs.schema[c].dataType.simpleString()]
    # a null and no value hash alike: tell them apart
    marks = F.array(*[c.isNull() for c in plain])
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES
    return docs.select(F.xxhash64(F.lit(seed), marks, *plain).alias("h1"), F.xxhash64(F.lit(seed + 1), marks, *plain).alias("h2"), size.alias("size"), F.struct(*names).alias("record"))


def _scattered(d: DataFrame, hot: DataFrame, n_hot: int, n: int) -> DataFrame:
    """(bucket, h1, h2, record): the first pass.  hot: (h1, h2, copies), spread over all buckets from the record's own on."""
    rows = d.select(F.pmod("h1", F.lit(n)).cast("int").alias("bucket"), "h1", "h2", "record")
    if not n_hot:
        return rows
    keys = hot.select("h1", "h2")
    keys = F.broadcast(keys) if n_hot <= SMALL else keys
    one = d.join(keys, ["h1", "h2"]).groupBy("h1", "h2").agg(F.first("record").alias("record")).join(hot, ["h1", "h2"])
    chunks = one.select("h1", "h2", "record", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {CHUNK}"))).alias("chunk")).repartition(n, "h1", "chunk")
    copies = chunks.select("h1", "h2", "record", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, "copies") - 1)).alias("copy"))
    spread = copies.select(F.pmod(F.pmod("h1", F.lit(n)) + F.col("copy"), F.lit(n)).cast("int").alias("bucket"), "h1", "h2", "record")
    return rows.join(keys, ["h1", "h2"], "left_anti").select("bucket", "h1", "h2", "record").union(spread)


def shuffled_shards(docs: DataFrame, uri: str, shards: int = 40, seed: int = SEED, text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes all rows of ``docs`` in a random order to Parquet folders ``shard=0 .. shards-1`` under ``uri`` and returns them read back.

    Adds ``shard`` and ``slot`` (place in the shard, from 0 without gaps); the columns of ``docs`` stay (a column named
    ``shard`` or ``slot`` is replaced).  Shards differ by one row at most.  The order follows from the seed and the rows
    alone, not from files, partitions or settings; columns of type map take no part in it.  Records are scattered by a
    hash of all their columns, so rows that share an id or a text spread over all buckets, and so do the copies of a
    record that holds more than a quarter of a bucket.  Null ids and texts are ordinary values; a text, however long, is
    one record.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    d = _hashed(docs, names, text, seed)
    rows, total = d.agg(F.count("*"), F.sum("size")).first()
    n = max(LEAST, -(-(total or 0) // bucket_bytes))
    keys = C.materialize(d.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.first("size").alias("size")).groupBy(F.pmod("h1", F.lit(n)).cast("int").alias("bucket")).agg(
        F.sum("copies").alias("n"),
        F.collect_list(F.when((F.col("copies") > 1) & (F.col("copies") * F.col("size") > bucket_bytes // 4), F.struct("h1", "h2", "copies"))).alias("hot"),  # few: each fills a quarter of a bucket
    ), "keys")
    hot = keys.select(F.explode("hot").alias("x")).select("x.h1", "x.h2", "x.copies")
    n_hot = hot.count()
    if n_hot:
        each = hot.select(F.pmod("h1", F.lit(n)).cast("int").alias("own"), "copies", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
        # of c copies dealt in turn over n buckets, the k-th from the record's own gets (c + n - 1 - k) div n
        moved = each.select(F.pmod(F.col("own") + F.col("k"), F.lit(n)).cast("int").alias("bucket"), F.expr(f"(copies + {n - 1} - k) div {n}").alias("n"))
        own = hot.select(F.pmod("h1", F.lit(n)).cast("int").alias("bucket"), F.negative("copies").alias("n"))
        sizes = keys.select("bucket", "n").union(moved).union(own).groupBy("bucket").agg(F.sum("n").alias("n"))
    else:
        sizes = keys.select("bucket", "n")
    base = C.materialize(_before(sizes), "base")
    dealt = _scattered(d, hot, n_hot, n).select("bucket", F.struct("h1", "h2", "record").alias("r")).repartition(n, "bucket")
    gathered = dealt.groupBy("bucket").agg(F.collect_list("r").alias("rs"))  # a bucket: bounded by bucket_bytes and the longest text

    def order(a: Column, b: Column) -> Column:
        return F.when(a["h1"] < b["h1"], -1).when(a["h1"] > b["h1"], 1).when(a["h2"] < b["h2"], -1).when(a["h2"] > b["h2"], 1).otherwise(0)

    # the shuffle is seeded by seed and partition: a stated number of partitions, buckets in order, and before any join
    fisher_yates = gathered.sortWithinPartitions("bucket").select("bucket", F.shuffle(F.array_sort("rs", order), F.lit(seed)).alias("rs"))
    mixed = fisher_yates.join(base, "bucket").select("base", F.posexplode("rs").alias("pos", "r"))
    # place p of N: shard floor(p * shards / N), which begins at ceil(shard * N / shards)
    place = F.col("base") + F.col("pos")
    shard = F.expr(f"((base + pos) * {shards}L) div {max(rows, 1)}L")
    out = mixed.select("r.record.*", place.alias("_place"), shard.cast("int").alias("shard"))
    out = out.withColumn("slot", F.col("_place") - F.expr(f"(cast(shard as bigint) * {rows}L + {shards - 1}) div {shards}")).drop("_place")
    out.write.partitionBy("shard").parquet(uri)
    schema = out.select(*names, "slot", "shard").schema
    return spark.read.schema(schema).parquet(uri)


def op7_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = shuffled_shards(docs, f"{C.shared_dir(spark)}/shards")
    return out.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op7_two_pass_shuffle": op7_two_pass_shuffle}
ORACLE: dict[str, str] = {}
