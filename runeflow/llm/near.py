"""Near-duplicate documents by SetSketch (operator 8).

A document is the set of its word shingles.  Its sketch has ``REGISTERS`` registers: register i is
floor(1 - log_b h_i), where h_i is the smallest of exponentially distributed hashes of the shingles, cut to one byte:
exponentially spaced truncated minima, merged by maximum.  Registers are banded; a band that agrees makes a candidate.
Candidates are estimated from both sketches by maximum likelihood, and confirmed on the full sets.

Groups of thousands of copies: equal sets are one class from the start.  Within a band's bucket every class is first
compared with the bucket's smallest class only; components of the confirmed links are then contracted, and only classes
that are still apart in a bucket are compared with each other.  So the work in a bucket is in proportion to its size as
long as its members belong together, and no pair that could join two components is left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from . import common as C
from . import hashing as H
from .components import components

REGISTERS, BANDS = 140, 28
"""Bands of 5 registers: at a similarity of 0.8 the chance that no band agrees is below 2e-5."""
BASE, RATE, TOP = 1.08, 20.0, 254
"""b, a and q of the sketch: registers tell minima down to b**-253 apart, i.e. sets of one to some 15 million shingles."""
SLACK = 4.0
"""Standard deviations by which an estimate may fall short of the threshold and still be confirmed on the full sets."""
BLOCK, BLOCK_BYTES = 1024, 8 << 20
"""Members of a bucket or component, and bytes of full sets, that a task holds of either side at a time."""
SKETCHES = "row_id long, n_shingles long, set_a long, set_b long, sketch binary"

_rng = np.random.default_rng(H.SEED + 8)
_MUL = _rng.integers(0, 2**64, REGISTERS, dtype=H.U) | H.U(1)
_ADD = _rng.integers(0, 2**64, REGISTERS, dtype=H.U)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one text after the other, and their offsets.

    A shingle: ``k`` consecutive words, A-Z lower-cased; of a text with fewer words, all of them.
    """
    data = H.LOWER[data]
    w = H.Words(data, offsets)
    h = H.word_hashes(data, w)
    n = len(offsets) - 1
    grams = H.windows(h, k)
    at = np.flatnonzero(w.count[w.doc] - w.place >= k)
    values, doc = grams[at] if len(at) else np.zeros(0, H.U), w.doc[at]
    short = np.flatnonzero((w.count < k) & (w.count > 0))
    if len(short):
        idx = C.ragged(w.first[short], w.count[short])
        ends = np.cumsum(w.count[short])
        local = np.arange(len(idx)) - np.repeat(ends - w.count[short], w.count[short])
        whole = np.add.reduceat(h[idx] * H.powers(H.WORD_BASE, k)[local], ends - w.count[short])
        values, doc = np.r_[values, H.mix(whole + w.count[short].astype(H.U))], np.r_[doc, short]
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    new = np.r_[True, (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])] if len(values) else np.zeros(0, bool)
    return values[new], np.r_[0, np.cumsum(np.bincount(doc[new], minlength=n))]


def registers(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sketch of each set (rows); sets must not be empty."""
    n = len(offsets) - 1
    low = np.empty((REGISTERS, n))
    for i in range(REGISTERS):
        v = values * _MUL[i] + _ADD[i]
        low[i] = np.minimum.reduceat(v ^ (v >> H.U(29)), offsets[:-1])
    u = (low.T + 0.5) * 2.0**-64
    return np.clip(np.floor(1 - np.log(-np.log1p(-u) / RATE) / math.log(BASE)), 0, TOP).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Similarity of pairs of sets by maximum likelihood from their registers (rows) and sizes.

    With u, v the shares of either size in the sum, a register of x is larger with probability p(u - v J), smaller with
    p(v - u J), where p(z) = -log_b(1 - z (b - 1) / b) and J is the similarity; the likelihood of the three counts is
    concave in J, and its maximum is found by bisection of its derivative.
    """
    more, less = (x > y).sum(1), (x < y).sum(1)
    same = x.shape[1] - more - less
    u = nx / (nx + ny)
    v = 1 - u
    c, log_b = (BASE - 1) / BASE, math.log(BASE)
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)

    def slope(j: np.ndarray) -> np.ndarray:
        tiny = 1e-12
        z1, z2 = np.maximum(u - v * j, 0), np.maximum(v - u * j, 0)
        p1, p2 = -np.log1p(-z1 * c) / log_b, -np.log1p(-z2 * c) / log_b
        d1, d2 = -v * c / (1 - z1 * c) / log_b, -u * c / (1 - z2 * c) / log_b
        return more * d1 / np.maximum(p1, tiny) + less * d2 / np.maximum(p2, tiny) - same * (d1 + d2) / np.maximum(1 - p1 - p2, tiny)

    for _ in range(30):
        mid = (lo + hi) / 2
        up = slope(mid) > 0
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return (lo + hi) / 2


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """SKETCHES of ``docs`` (row_id, text): set size, 128-bit hash of the set, registers."""

    def run(batches):
        for whole in batches:
            for t in C.slices(whole, 1):
                data, offsets = C.utf8(t.column(1))
                values, off = shingle_sets(data, offsets, k)
                size = np.diff(off)
                full = np.flatnonzero(size)
                a, b = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
                regs: list[bytes | None] = [None] * len(size)
                if len(full):
                    starts = off[:-1][full]
                    a[full] = np.add.reduceat(H.mix(values), starts).view(np.int64)
                    b[full] = np.add.reduceat(H.mix(values * H.WORD_BASE + H.U(7)), starts).view(np.int64)
                    for i, r in zip(full.tolist(), registers(values, np.r_[starts, off[-1]]), strict=True):
                        regs[i] = r.tobytes()
                yield pa.RecordBatch.from_arrays([t.column(0), pa.array(size), pa.array(a), pa.array(b), pa.array(regs, pa.binary())], ["row_id", "n_shingles", "set_a", "set_b", "sketch"])

    return docs.select("row_id", "text").mapInArrow(run, SKETCHES)


def bands(classes: DataFrame) -> DataFrame:
    """(band, node): a 64-bit hash of the registers of each band and its number."""
    width = REGISTERS // BANDS
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sketch", i * width + 1, width)) for i in range(BANDS)])
    return classes.select(F.explode(keys).alias("band"), "node")


def _slack(threshold: float) -> float:
    return SLACK * math.sqrt(threshold * (1 - threshold) / REGISTERS) + 0.02


def _estimated(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose estimate is at most SLACK standard deviations below the threshold."""
    side = lambda c: classes.select(F.col("node").alias(c), F.col("sketch").alias(f"s{c}"), F.col("n_shingles").alias(f"n{c}"))
    slack = _slack(threshold)

    def run(batches):
        for t in batches:
            if t.num_rows:
                x, y = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("sa", "sb"))
                j = estimate(x, y, t.column("na").to_numpy().astype(float), t.column("nb").to_numpy().astype(float))
                keep = pa.array(j >= threshold - slack)
                yield pa.RecordBatch.from_arrays([t.column("a").filter(keep), t.column("b").filter(keep)], ["a", "b"])

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    possible = F.least("na", "nb") >= F.lit(threshold - 1e-9) * F.greatest("na", "nb")
    return both.where(possible).select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(row_id, n_bytes, shingles): the full sets, 64-bit hashes in ascending order, of the given rows."""

    def run(batches):
        for whole in batches:
            for t in C.slices(whole, 1):
                data, offsets = C.utf8(t.column(1))
                values, off = shingle_sets(data, offsets, k)
                sets = [values[p:q].tobytes() for p, q in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([t.column(0), pa.array(8 * np.diff(off)), pa.array(sets, pa.binary())], ["row_id", "n_bytes", "shingles"])

    need = C.materialize(rows.groupBy("row_id").agg(F.lit(1).alias("n")).select("row_id"), "need")
    return C.materialize(docs.select("row_id", "text").join(need, "row_id").mapInArrow(run, "row_id long, n_bytes long, shingles binary"), "sets")


def linked(one: bytes, others: list[bytes], percent: int) -> np.ndarray:
    """Whether 100 * intersection >= percent * union, of one full set with each of the others."""
    u, sizes = np.frombuffer(one, np.uint64), np.array([len(x) // 8 for x in others])
    v = np.frombuffer(b"".join(others), np.uint64)
    at = np.minimum(np.searchsorted(u, v), len(u) - 1)
    both = np.add.reduceat((u[at] == v).astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * both >= percent * (len(u) + sizes - both)


def _confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of row ids whose full sets are similar enough."""
    pairs = C.materialize(pairs, "pairs")
    full = _sets(docs, pairs.select(F.col("a").alias("row_id")).union(pairs.select("b")), k)

    def check(batches):
        for whole in batches:
            for t in C.slices(whole, 2, 3, most=4 << 20, rows=4096):
                a, ys = t.column("a").to_numpy(), t.column("y").to_pylist()
                cuts = np.flatnonzero(np.r_[True, a[1:] != a[:-1], True]).tolist()  # runs of one a: its set against many
                m = pa.array(np.concatenate([linked(t.column("x")[p].as_py(), ys[p:q], percent) for p, q in zip(cuts, cuts[1:], strict=False)]))
                yield pa.RecordBatch.from_arrays([t.column("a").filter(m), t.column("b").filter(m)], ["a", "b"])

    left = full.select(F.col("row_id").alias("a"), F.col("shingles").alias("x"))
    right = full.select(F.col("row_id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _grid(xs: DataFrame, ys: DataFrame, key: str, weight: str | None = None) -> DataFrame:
    """(key, nx, ny): into how many blocks either side's rows of a key are dealt, by their number and, if given, their bytes."""

    def side(df: DataFrame, name: str) -> DataFrame:
        n = F.ceil(F.count("*") / BLOCK)
        return df.groupBy(key).agg((F.greatest(n, F.ceil(F.sum(weight) / BLOCK_BYTES)) if weight else n).cast("int").alias(name))

    return C.materialize(side(xs, "nx").join(side(ys, "ny"), key), "grid")


def _crossed(xs: DataFrame, x: str, ys: DataFrame, y: str, grid: DataFrame, key: str) -> PandasCogroupedOps:
    """Both sides cogrouped by key and by pairs of their blocks, so that a task holds one block of each however many rows a key has.

    Dealt to a stated number of tasks: the work is in the comparisons, so few bytes must not make few tasks.
    """
    n = int(xs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = xs.join(grid, key).withColumn("i", block(x, "nx")).withColumn("j", every("ny"))
    b = ys.join(grid, key).withColumn("j", block(y, "ny")).withColumn("i", every("nx"))
    a, b = (df.drop("nx", "ny").repartition(n, key, "i", "j").groupBy(key, "i", "j") for df in (a, b))
    return a.cogroup(b)


def _across(placed: DataFrame, classes: DataFrame, comp: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) that join components which share a bucket.

    placed: (band, node, pivot, node_of, pivot_of).  Two members of a bucket that are still apart are not both in the
    pivot's component, so it is enough to hold the members outside it, x, against all others.  What passes between tasks
    is at most one row for x and each other component that has a candidate for it, never a row for each pair.
    """
    slack = _slack(percent / 100)
    least = int((percent / 100 - slack) * REGISTERS) - 1  # registers agree at least as often as the similarity estimated from them
    apart = placed.where("node_of <> pivot_of").select("band", F.col("node").alias("x"), F.col("node_of").alias("x_of"))
    split = C.materialize(apart.groupBy("band").agg(F.lit(1).alias("n")).select("band"), "split")
    others = C.materialize(placed.join(split, "band").select("band", F.col("node").alias("y"), F.col("node_of").alias("y_of")), "others")
    grid = _grid(apart, others, "band")
    sketch = lambda df, c: df.join(classes.select(F.col("node").alias(c), F.col("sketch").alias("sketch"), F.col("n_shingles").alias("n_shingles")), c)

    def screen(xs: pa.Table, ys: pa.Table) -> pa.Table:
        out_x, out_c = [], []
        if xs.num_rows and ys.num_rows:
            r = [np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(-1, REGISTERS) for t in (xs, ys)]
            size = [t["n_shingles"].to_numpy().astype(float) for t in (xs, ys)]
            x_of, y_of = xs["x_of"].to_numpy(), ys["y_of"].to_numpy()
            names, one, other = xs["x"].to_pylist(), [], []
            for i in range(len(names)):
                fits = (y_of != x_of[i]) & (np.minimum(size[1], size[0][i]) >= (percent / 100 - 1e-9) * np.maximum(size[1], size[0][i]))
                at = np.flatnonzero(fits)
                at = at[(r[1][at] == r[0][i]).sum(1) >= least]
                one.append(np.full(len(at), i))
                other.append(at)
            one, other = np.concatenate(one), np.concatenate(other)
            if len(one):
                j = estimate(r[0][one], r[1][other], size[0][one], size[1][other])
                near = {(names[i], c) for i, c in zip(one[j >= percent / 100 - slack].tolist(), y_of[other[j >= percent / 100 - slack]].tolist(), strict=True)}
                out_x, out_c = [x for x, _ in near], [c for _, c in near]
        return pa.table({"x": pa.array(out_x, pa.int64()), "c": pa.array(out_c, pa.int64())})

    some = _crossed(sketch(apart, "x"), "x", sketch(others, "y"), "y", grid, "band").applyInArrow(screen, "x long, c long")
    some = C.materialize(some.groupBy("x", "c").agg(F.lit(1).alias("n")).select("x", "c"), "across")
    targets = some.groupBy("c").agg(F.lit(1).alias("one")).select("c")
    member = classes.select("node").join(comp, "node", "left").select(F.col("node").alias("y"), F.coalesce("component", "node").alias("c")).join(C.materialize(targets, "targets"), "c")
    member = C.materialize(member, "targets_members")
    full = _sets(docs, some.select(F.col("x").alias("row_id")).union(member.select("y")), k)

    def check(xs: pa.Table, ys: pa.Table) -> pa.Table:
        a, b = [], []
        if xs.num_rows and ys.num_rows:
            sets, names = ys["shingles"].to_pylist(), ys["y"].to_pylist()
            for x, s in zip(xs["x"].to_pylist(), xs["shingles"].to_pylist(), strict=True):
                hit = np.flatnonzero(linked(s, sets, percent))
                if len(hit):  # one link joins the components
                    a.append(x)
                    b.append(names[hit[0]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    size = lambda df, c: df.join(full.select(F.col("row_id").alias(c), F.col("n_bytes").alias("n_bytes")), c)
    grid = _grid(size(some, "x"), size(member, "y"), "c", "n_bytes")
    of = lambda df, c: df.join(full.select(F.col("row_id").alias(c), F.col("shingles").alias("shingles")), c)
    return _crossed(of(some, "x"), "x", of(member, "y"), "y", grid, "c").applyInArrow(check, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Components of documents linked by 100 * intersection >= ``percent`` * union of their sets of ``k``-word shingles.

    Returns one row per input row: ``doc_id, n_shingles, component_id, n_links, kept``.  ``component_id`` is the smallest
    doc_id reachable; ``n_links``: confirmed links of the row's class (rows with the same set) to other classes, as far
    as they were needed to find the components; ``kept`` marks the row whose doc_id is the component's.  Null or empty texts, and texts
    without words, have no shingles and are linked with nothing.  Rows with the same doc_id count as one document with
    each of their texts; a null doc_id counts as the smallest number there is while components are found, and stays
    null in ``doc_id``.  Other columns are not read; an empty table gives none.  A text, however long, is one set, held in
    memory with some 15 times its bytes.
    """
    threshold = percent / 100
    d = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("row_id"), F.col(text).alias("text"))
    sk = C.materialize(sketches(d, k), "sketches")
    classes = sk.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("row_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    classes = C.materialize(classes, "classes")
    b = bands(classes)
    shared = b.groupBy("band").agg(F.min("node").alias("pivot"), F.count("node").alias("n")).where("n > 1").select("band", "pivot")
    shared = C.materialize(shared, "shared")
    members = C.materialize(b.join(shared, "band"), "members")  # (band, node, pivot): only bands that several classes share
    stars = members.where("node > pivot").groupBy(F.col("pivot").alias("a"), F.col("node").alias("b")).agg(F.lit(1).alias("n")).select("a", "b")
    links = C.materialize(_confirmed(_estimated(stars, classes, threshold), d, k, percent), "links")
    comp = C.materialize(components(links), "components")
    label = lambda df, c: df.join(comp.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of")), c, "left").withColumn(f"{c}_of", F.coalesce(f"{c}_of", c))
    at = C.materialize(label(label(members, "node"), "pivot"), "placed")
    more = _across(at, classes, comp, d, k, percent)
    links = C.materialize(links.union(more), "all_links")
    comp = C.materialize(components(links), "all_components")
    degree = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("n_links"))
    of = classes.select("set_a", "set_b", "node").join(comp, "node", "left").join(degree, "node", "left")
    of = C.materialize(of.select("set_a", "set_b", F.coalesce("component", "node").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "class_component")
    full = sk.where("n_shingles > 0").select("row_id", "n_shingles", "set_a", "set_b").join(of, ["set_a", "set_b"]).select("row_id", "n_shingles", "component", "n_links")
    empty = sk.where("n_shingles = 0").select("row_id", "n_shingles", F.col("row_id").alias("component"), F.lit(0).cast("long").alias("n_links"))
    null = lambda c: F.when(F.col(c) > -(2**63), F.col(c))
    return full.union(empty).select(null("row_id").alias("doc_id"), "n_shingles", null("component").alias("component_id"), "n_links", (F.col("row_id") == F.col("component")).alias("kept"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"), k=4).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op8_minhash_near_dedup": op8_minhash_near_dedup}
ORACLE: dict[str, str] = {}
