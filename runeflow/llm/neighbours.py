"""Approximate nearest neighbours by cross-polytope hashing (operator 1).

Unit vectors are turned by fast Hadamard pseudo-rotations (three rounds of random signs and a Walsh-Hadamard transform)
and assigned to the nearest signed axis.  A table's bucket is the axis of one rotation or, where there are more vectors
than that keeps apart, the axes of several rotations together, the last one among the first axes only; so buckets grow
in number with the vectors.  Every vector is stored in one bucket of each table; a query looks into buckets in the order
of their joint scores, the sums of its coordinates along their axes (multiprobe), until they hold as many vectors as a
table needs; what it finds is ranked exactly on the original vectors.

How many that is, is measured: for a bounded sample of the queries the true neighbours are found by brute force, and how
far down each table's order they stand tells how many vectors must be looked at to find a given share of them.

Inner products on vectors of any length: vectors are kept apart by the power of two nearest their norm, and within such
a band get one more coordinate that brings all to the band's largest norm, so that the nearest axis follows the inner
product.  Equal vectors are one class: its smallest ids are all that any result can hold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

TABLES, LEAST = 8, 4
"""A query probes buckets of each table and band until they hold as many vectors as measured, and ``LEAST`` times k."""
HELD, MOST = 256, 1 << 16
"""Vectors that a bucket should hold, and most buckets of a table and band: their sizes are known to all tasks."""
SAMPLE, AIM = 128, 0.96
"""Queries of the sample, and the share of its true neighbours that must be found."""
BLOCK = 4096
"""Vectors of a bucket, and queries to it, that are compared at a time; larger buckets are blocks against blocks."""
SALTS = 1024
TIE = 1e-9
SEED = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, in the order of its recursion, keeping lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    rng = np.random.default_rng([SEED, table])
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1]))
    return x


def axes(turned: np.ndarray) -> np.ndarray:
    """Number of the nearest signed axis of each row: 2 * axis, plus 1 if negative."""
    a = np.abs(turned).argmax(1)
    return 2 * a + (turned[np.arange(len(a)), a] < 0)


def shape(n: int, dim: int) -> tuple[int, ...]:
    """For n vectors of ``dim`` coordinates: of how many axes each of a table's rotations chooses."""
    out, buckets, want = [dim], 2 * dim, min(n / HELD, MOST)
    while 2 * buckets <= want and 4 * buckets <= MOST:
        k = dim
        while k > 2 and buckets * 2 * k > want:
            k //= 2
        out.append(k)
        buckets *= 2 * k
    return tuple(out)


def buckets_of(x: np.ndarray, table: int, form: tuple[int, ...]) -> np.ndarray:
    code = np.zeros(len(x), np.int64)
    for j, k in enumerate(form):
        code = code * 2 * k + axes(rotate(x, table + 1000 * j)[:, :k])
    return code


def scores_of(x: np.ndarray, table: int, form: tuple[int, ...]) -> np.ndarray:
    """Joint score of every bucket for each row: the coordinates along its axes, summed up."""
    total = np.zeros((len(x), 1))
    for j, k in enumerate(form):
        y = rotate(x, table + 1000 * j)[:, :k]
        total = (total[:, :, None] + np.stack([y, -y], 2).reshape(len(x), 1, 2 * k)).reshape(len(x), -1)
    return total


def _padded(dim: int) -> int:
    return 1 << dim.bit_length()  # room for one coordinate more


def _lift(v: np.ndarray, longest: np.ndarray | None) -> np.ndarray:
    """Unit vectors with room for the coordinate that evens out norms; queries (no ``longest``) have 0 there."""
    n, d = v.shape
    out = np.zeros((n, _padded(d)))
    norm = np.linalg.norm(v, axis=1)
    if longest is None:
        out[:, :d] = v / norm[:, None]
    else:
        out[:, :d] = v / longest[:, None]
        out[:, d] = np.sqrt(np.maximum(0, 1 - (norm / longest) ** 2))
    return out


def _matrix(col: pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.array(col.flatten(), dtype=np.float64).reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def _classes(vectors: DataFrame, vec_id: str, vector: str, k: int, query: str) -> DataFrame:
    """One row for each distinct valid vector: class_id (smallest id), its k + 1 smallest ids, norm band, whether a query has it."""
    v = F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0))
    d = vectors.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"), F.expr(query).alias("q"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    d = d.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(fine)
    d = d.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v"), "salt": F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))})
    some = lambda ids: F.slice(F.array_sort(F.array_distinct(ids)), 1, k + 1)
    part = d.groupBy("h1", "h2", "salt").agg(some(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v"), F.max("q").alias("q"))
    c = part.groupBy("h1", "h2").agg(some(F.flatten(F.collect_list("ids"))).alias("ids"), F.first("v").alias("v"), F.max("q").alias("q"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    c = c.select(F.element_at("ids", 1).alias("class_id"), "h1", "h2", "ids", "v", "q", norm.alias("norm"))
    # vectors of one length and power of two
    return C.materialize(c.withColumn("band", (F.size("v") * 8192 + F.floor(F.log2("norm") + 0.5)).cast("int")), "classes")


class Band(NamedTuple):
    dim: int
    top: float  # the largest norm
    n: int
    form: tuple[int, ...]


class Index(NamedTuple):
    bands: dict[int, Band]
    sizes: dict[tuple[int, int], np.ndarray]  # (band, table): vectors in each bucket
    budget: dict[int, int]  # vectors that a query looks at in each table of a band


def _by_band(t: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    band = t.column("band").to_numpy()
    for b in np.unique(band).tolist():
        yield b, t.filter(pa.array(band == b))


def _by_length(t: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dim = pc.list_value_length(t.column("v")).to_numpy(zero_copy_only=False)
    for d in np.unique(dim).tolist():
        yield d, t.filter(pa.array(dim == d))


def _placed(classes: DataFrame, bands: dict[int, Band], tables: int) -> DataFrame:
    """(tbl, band, bucket, class_id)"""

    def run(batches):
        for whole in batches:
            for b, t in _by_band(whole):
                v = _matrix(t.column("v"))
                x = _lift(v, np.full(len(v), bands[b].top))
                for i in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), t.column("band"), pa.array(buckets_of(x, i, bands[b].form).astype(np.int32)), t.column("class_id")], ["tbl", "band", "bucket", "class_id"])

    return classes.select("class_id", "band", "v").mapInArrow(run, "tbl int, band int, bucket int, class_id long")


def _sampled_truth(classes: DataFrame, k: int) -> list[tuple[np.ndarray, list[tuple[int, np.ndarray]]]]:
    """For at most about SAMPLE vectors that queries have: the vector and its k nearest others (band, vector), by a scan of all."""
    n = classes.where("q").count()
    chosen = F.pmod(F.xxhash64(F.lit(SEED), "class_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, SAMPLE / max(n, 1))))
    asked = [(r["class_id"], np.array(r["v"])) for r in classes.where("q").where(chosen).select("class_id", "v").orderBy("class_id").limit(2 * SAMPLE).collect()]
    lengths = {len(v) for _, v in asked}
    of = {d: (np.array([i for i, (_, v) in enumerate(asked) if len(v) == d]), np.array([v for _, v in asked if len(v) == d])) for d in lengths}

    def best(batches):
        for whole in batches:
            for d, t in _by_length(whole):
                if d not in of:
                    continue
                number, qs = of[d]
                v, band, ids = _matrix(t.column("v")), t.column("band").to_numpy(), t.column("class_id").to_numpy()
                score = qs @ v.T
                take = min(k + 1, len(v))
                for i, some in zip(number.tolist(), np.argpartition(-score, take - 1, axis=1)[:, :take], strict=True):
                    row = np.flatnonzero(number == i)[0]
                    keep = [c for c in some.tolist() if ids[c] != asked[i][0]]
                    if keep:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), i, np.int32)), pa.array(-score[row, keep]), pa.array(ids[keep]), pa.array(band[keep]), t.column("v").take(pa.array(keep))], ["i", "o", "class_id", "band", "v"])

    found = classes.select("class_id", "band", "v").mapInArrow(best, "i int, o double, class_id long, band int, v array<double>")
    order = Window.partitionBy("i").orderBy("o", "class_id")
    top = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("i", "band", "v").collect()  # 2 * SAMPLE * k at most
    out = [(v, []) for _, v in asked]
    for r in top:
        out[r["i"]][1].append((r["band"], np.array(r["v"])))
    return out


def _budgets(truth: list[tuple[np.ndarray, list[tuple[int, np.ndarray]]]], bands: dict[int, Band], sizes: dict[tuple[int, int], np.ndarray], tables: int, aim: float) -> dict[int, int]:
    """Vectors to look at in each table of a band, so that ``aim`` of the sample's neighbours are in a bucket looked into."""
    need: dict[int, list[float]] = {b: [] for b in bands}
    for b, band in bands.items():
        some = [(q, np.array([v for c, v in near if c == b])) for q, near in truth]
        some = [(q, vs) for q, vs in some if len(vs)]
        for q, vs in some:
            least = np.full(len(vs), np.inf)
            lifted, x = _lift(vs, np.full(len(vs), band.top)), _lift(q[None], None)
            for i in range(tables):
                score = scores_of(x, i, band.form)[0]
                order = np.argsort(-score, kind="stable")
                before = np.empty(len(score))
                before[order] = np.cumsum(sizes[b, i][order]) - sizes[b, i][order]
                least = np.minimum(least, before[buckets_of(lifted, i, band.form)])
            need[b] += least.tolist()
    return {b: int(np.quantile(x, aim, method="higher")) + 1 if x else 1 for b, x in need.items()}


def _looked_into(x: np.ndarray, table: int, band: int, index: Index, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all buckets that queries look into."""
    size, budget = index.sizes[band, table], max(index.budget[band], least)
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, (1 << 22) // len(size))
    for lo in range(0, len(x), step):
        score = scores_of(x[lo : lo + step], table, index.bands[band].form)
        order = np.argsort(-score, axis=1, kind="stable")
        held = size[order]
        row, at = np.nonzero((held > 0) & (np.cumsum(held, axis=1) - held < budget))
        rows.append(row + lo)
        found.append(order[row, at])
    return np.concatenate(rows), np.concatenate(found)


def nearest(vectors: DataFrame, k: int = 20, query: str = "true", vec_id: str = "vec_id", vector: str = "embedding", tables: int = TABLES, aim: float = AIM) -> DataFrame:
    """The ``k`` vectors of largest inner product found for each row that satisfies the SQL condition ``query``.

    Returns ``query_id, rank, vec_id, score``: nearest first, ties to the smaller vec_id, never the query itself; all
    others if there are fewer than k.  Scores are inner products of the original vectors in double precision.  Rows with
    a null id, and vectors that are null, empty, zero or hold null or non-finite components take no part; rows with the
    same id and vector count once.  A query meets vectors of its own length only.  An id with several vectors is found
    and asked with each of them; of the scores of a pair of ids the largest counts.  Other columns are not read; an empty
    table gives none.  ``aim``: the share of neighbours to be found in a sample of at most 256 queries.
    """
    d = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"), F.expr(query).alias("q"))
    classes = _classes(d, "vec_id", "vector", k, "coalesce(q, false)")
    bands = {}
    for r in classes.groupBy("band").agg(F.max("norm").alias("top"), F.count("*").alias("n"), F.first(F.size("v")).alias("d")).collect():  # a row for each length and power of two
        bands[r["band"]] = Band(r["d"], r["top"], r["n"], shape(r["n"], _padded(r["d"])))
    stored = C.materialize(_placed(classes, bands, tables), "stored")
    counts = stored.groupBy("tbl", "band", "bucket").agg(F.count("*").alias("n"))
    sizes = {(b, i): np.zeros(int(np.prod([2 * x for x in band.form])), np.int64) for b, band in bands.items() for i in range(tables)}
    known = counts.toArrow()  # at most MOST rows for each table and band, however many vectors
    at, values = {c: known[c].to_numpy() for c in ("band", "tbl", "bucket")}, known["n"].to_numpy()
    for b, i in sizes:
        own = (at["band"] == b) & (at["tbl"] == i)
        sizes[b, i][at["bucket"][own]] = values[own]
    index = Index(bands, sizes, _budgets(_sampled_truth(classes, k), bands, sizes, tables, aim))
    shared = classes.sparkSession.sparkContext.broadcast(index)  # as bounded as the counts

    def probes(batches):
        for whole in batches:
            for dim, t in _by_length(whole):
                x = _lift(_matrix(t.column("v")), None)
                for band in (b for b, y in shared.value.bands.items() if y.dim == dim):
                    for i in range(tables):
                        yield t, i, band, *_looked_into(x, i, band, shared.value, LEAST * k)

    def asks(batches):
        for t, i, band, _, bucket in probes(batches):
            b, n = np.unique(bucket, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), i, np.int32)), pa.array(np.full(len(b), band, np.int32)), pa.array(b.astype(np.int32)), pa.array(n)], ["tbl", "band", "bucket", "n"])

    def probe(batches):
        for t, i, band, row, bucket in probes(batches):
            blocks = -(-shared.value.sizes[band, i][bucket] // BLOCK)
            again = np.repeat(np.arange(len(row)), blocks)
            block = np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            row, bucket = row[again], bucket[again]
            for lo in range(0, len(row), 4096):  # rows that carry a vector: not too many at a time
                at = pa.array(row[lo : lo + 4096])
                m = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, i, np.int32)), pa.array(np.full(m, band, np.int32)), pa.array(bucket[lo : lo + m].astype(np.int32)), pa.array(block[lo : lo + m].astype(np.int32)), t.column("class_id").take(at), t.column("v").take(at)],
                    ["tbl", "band", "bucket", "block", "query", "v"],
                )

    key = ["tbl", "band", "bucket"]
    asking_classes = classes.where("q").select("class_id", "v")
    asked_n = asking_classes.mapInArrow(asks, "tbl int, band int, bucket int, n long").groupBy(*key).agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("sides"))
    grid = counts.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).join(asked_n, key).select(*key, "blocks", "sides")
    grid = C.materialize(grid, "grid")  # as bounded as the counts
    side = F.pmod(F.xxhash64("query"), F.col("sides")).cast("int")
    asked = asking_classes.mapInArrow(probe, "tbl int, band int, bucket int, block int, query long, v array<double>").join(F.broadcast(grid), key).withColumn("side", side)
    asked = asked.select(*key, "block", "side", "query", "v")
    kept = stored.join(F.broadcast(grid), key).join(classes.select("class_id", "v", "ids"), "class_id")
    kept = kept.select(*key, F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("side"), "v", "ids")

    def rank(q: pa.Table, s: pa.Table) -> pa.Table:
        out_q, out_id, out_s = [], [], []
        if q.num_rows and s.num_rows:
            s = s.combine_chunks()
            sv, ids = _matrix(s["v"]), s["ids"].to_pylist()
            qv, names = _matrix(q["v"]), q["query"].to_pylist()
            take = min(k + 1, len(sv))
            reach = TIE * np.sqrt((sv * sv).sum(1).max())
            for lo in range(0, len(qv), 256):
                part = qv[lo : lo + 256]
                near = part @ sv.T
                last = -np.partition(-near, take - 1, axis=1)[:, take - 1] - reach * np.linalg.norm(part, axis=1)
                row, some = np.nonzero(near >= last[:, None])  # with all that a rounding error could part from the last one
                score = (sv[some] * part[row]).sum(1)  # sums that don't depend on the block's layout
                cuts = np.searchsorted(row, np.arange(len(part) + 1))
                for j in range(len(part)):
                    a, b = cuts[j], cuts[j + 1]
                    best = sorted((-x, i) for x, c in zip(score[a:b].tolist(), some[a:b].tolist(), strict=True) for i in ids[c])[: k + 1]
                    out_q.append(names[lo + j])
                    out_id.append([i for _, i in best])
                    out_s.append([-x for x, _ in best])
        return pa.table({"query": pa.array(out_q, pa.int64()), "ids": pa.array(out_id, pa.list_(pa.int64())), "scores": pa.array(out_s, pa.list_(pa.float64()))})

    group = [*key, "block", "side"]
    found = asked.groupBy(*group).cogroup(kept.groupBy(*group)).applyInArrow(rank, "query long, ids array<long>, scores array<double>")
    each = found.select("query", F.explode(F.arrays_zip("ids", "scores")).alias("x")).groupBy("query", F.col("x.ids").alias("vec_id")).agg(F.max("x.scores").alias("score"))
    best = lambda key: Window.partitionBy(key).orderBy(F.desc("score"), "vec_id")
    top = each.withColumn("r", F.row_number().over(best("query"))).where(F.col("r") <= k + 1).select("query", "vec_id", "score")
    lists = C.materialize(top.groupBy("query").agg(F.collect_list(F.struct("vec_id", "score")).alias("near")), "lists")  # k + 1 entries at most
    asking = d.where(F.coalesce("q", F.lit(False)) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("query_id"), F.transform("vector", lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    asking = asking.select("query_id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")).groupBy("query_id", "h1", "h2").agg(F.lit(1).alias("n"))
    of = asking.join(classes.where("q").select("h1", "h2", F.col("class_id").alias("query")), ["h1", "h2"]).select("query_id", "query")
    r = of.join(lists, "query").select("query_id", F.explode("near").alias("x")).select("query_id", F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")).where("vec_id <> query_id")
    r = r.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return r.withColumn("rank", F.row_number().over(best("query_id"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_cross_polytope_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(C.table(spark, sf_dir, "embeddings"), k=20, query="vec_id % 20 = 0")


QUERIES = {"op1_cross_polytope_ann": op1_cross_polytope_ann}
ORACLE: dict[str, str] = {}
