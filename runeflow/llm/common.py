"""Shared plumbing of the corpus operators: tables, shared work folder, memory-sized buckets, key exchange.

Three operators (near duplicates, repeated word windows, repeated byte strings) need to know which 64-bit keys occur
more than once in the corpus.  They all use the same exchange:

1. Documents are dealt by hash of ``doc_id`` into buckets of a bounded number of bytes (one shuffle of the text).
2. Each bucket sends its *distinct* keys, sorted and cut into ranges ("parts"); a key that occurs thousands of times in
   a bucket is sent once, so a hot key costs one entry per bucket and never floods the task that judges it.  There are
   as many parts as the keys' bytes ask for, fewer than buckets; a row holds all keys of one bucket for one part.
3. Each part answers every bucket with one bit per key sent.  The bucket, recomputed from the same rows, lines the bits
   up with its keys again, so neither keys nor positions travel back.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET_BYTES = 8 << 20
"""Text bytes aimed at in a bucket: what one Python worker holds at a time, with some ten times that in work arrays."""
PART_BYTES = 32 << 20
"""Text bytes whose keys one part judges."""
SLICE_BYTES = 1 << 20
"""Text bytes that operators without buckets work on at a time."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset (tests, one machine), under a local folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_buckets(docs: DataFrame, text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets for the corpus: as many as its bytes ask for, and at least the session's shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))


def n_parts(docs: DataFrame, text: str = "text", part_bytes: int = PART_BYTES) -> int:
    """Parts for the corpus' keys, by the same rule."""
    return n_buckets(docs, text, part_bytes)


def slices(t: pa.RecordBatch, *columns: int, most: int = SLICE_BYTES, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of ``t`` that hold at most ``most`` bytes in the given columns, but one row at least."""
    size = np.zeros(t.num_rows, np.int64)
    for c in columns:
        size += pc.binary_length(t.column(c)).fill_null(0).to_numpy(zero_copy_only=False)
    upto, lo = np.cumsum(size), 0
    while lo < t.num_rows:
        hi = int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, "right"))
        hi = min(max(hi, lo + 1), lo + rows)
        yield t.slice(lo, hi - lo)
        lo = hi


def bucketed(docs: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """``(bucket, doc_id, text)`` dealt by a hash of the id, so that rows of one id share a bucket."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return d.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")).repartition(n, "bucket")


def ordered(t: pa.Table) -> pa.Table:
    """Rows in an order that doesn't depend on how they arrived: by id (null last), then text."""
    return t.sort_by([("doc_id", "ascending"), ("text", "ascending")]) if t.num_rows > 1 else t


def utf8(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings, one after the other, and the offsets of each; a null is an empty string."""
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    a = pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a
    a = a.cast(pa.large_binary()) if not pa.types.is_large_binary(a.type) else a
    if a.null_count:
        a = a.fill_null(b"")
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = a.buffers()
    offsets = np.frombuffer(off, np.int64)[a.offset : a.offset + len(a) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices ``starts[k] .. starts[k] + lens[k] - 1`` of all k, one after the other."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)


# ---- which keys repeat -------------------------------------------------------------------------------------------

KEYS = "part int, bucket int, keys binary, multi binary"
MASKS = "bucket int, part int, mask binary"


def parts_of(keys: np.ndarray, n_parts: int) -> np.ndarray:
    """The part of each sorted key: equal ranges of the key's upper 32 bits."""
    return (((keys >> np.uint64(32)) * np.uint64(n_parts)) >> np.uint64(32)).astype(np.int64)


def cut(keys: np.ndarray, n_parts: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of each run of sorted keys that falls in one part."""
    if not len(keys):
        return []
    p = parts_of(keys, n_parts)
    at = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    return list(zip(p[at].tolist(), at.tolist(), np.r_[at[1:], len(p)].tolist(), strict=True))


def key_rows(bucket: int, keys: np.ndarray, multi: np.ndarray, n_parts: int) -> pa.Table:
    """Rows of KEYS for the sorted distinct ``keys`` of a bucket; ``multi``: occurs more than once here."""
    runs = cut(keys, n_parts)
    return pa.table(
        {
            "part": pa.array([p for p, _, _ in runs], pa.int32()),
            "bucket": pa.array([bucket] * len(runs), pa.int32()),
            "keys": pa.array([keys[a:b].tobytes() for _, a, b in runs], pa.binary()),
            "multi": pa.array([np.packbits(multi[a:b]).tobytes() for _, a, b in runs], pa.binary()),
        }
    )


def judge(t: pa.Table) -> pa.Table:
    """One part: for each row of KEYS one bit per key, set if the key occurs anywhere else (or twice there)."""
    rows = [np.frombuffer(k, np.uint64) for k in t["keys"].to_pylist()]
    lens = np.array([len(r) for r in rows])
    flags = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(t["multi"].to_pylist(), lens, strict=True)]).astype(bool)
    every = np.concatenate(rows)
    order = np.argsort(every, kind="stable")
    s = every[order]
    same = np.r_[False, s[1:] == s[:-1]]
    repeated = np.empty(len(s), bool)
    repeated[order] = same | np.r_[same[1:], False]
    repeated |= flags
    ends = np.cumsum(lens)
    masks = [repeated[e - n : e] for e, n in zip(ends, lens, strict=True)]
    keep = [i for i, m in enumerate(masks) if m.any()]
    bucket, part = t["bucket"].to_pylist(), t["part"].to_pylist()
    return pa.table(
        {
            "bucket": pa.array([bucket[i] for i in keep], pa.int32()),
            "part": pa.array([part[i] for i in keep], pa.int32()),
            "mask": pa.array([np.packbits(masks[i]).tobytes() for i in keep], pa.binary()),
        }
    )


def repeated_masks(keys: DataFrame, n_parts: int) -> DataFrame:
    return keys.repartition(n_parts, "part").groupBy("part").applyInArrow(judge, MASKS)


def unmask(keys: np.ndarray, masks: Iterable[tuple[int, bytes]], n_parts: int) -> np.ndarray:
    """For each sorted distinct key of a bucket, whether its part found it repeated."""
    out, got = np.zeros(len(keys), bool), dict(masks)
    for p, a, b in cut(keys, n_parts):
        if p in got:
            out[a:b] = np.unpackbits(np.frombuffer(got[p], np.uint8), count=b - a).astype(bool)
    return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, whether each occurs twice or more, and each input's place among them."""
    u, inverse, n = np.unique(keys, return_inverse=True, return_counts=True)
    return u, n > 1, inverse


def with_masks(docs_b: DataFrame, masks: DataFrame, f: Callable[[int, pa.Table, dict[str, list[tuple[int, bytes]]]], pa.Table], schema: str, n: int) -> DataFrame:
    """``f(bucket, documents, masks by kind)`` for each bucket; ``masks``: MASKS and ``kind``."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, got: pa.Table) -> pa.Table:
        kinds: dict[str, list[tuple[int, bytes]]] = {}
        for k, p, m in zip(*(got[c].to_pylist() for c in ("kind", "part", "mask")), strict=True):
            kinds.setdefault(k, []).append((p, m))
        return f(key[0].as_py(), ordered(docs), kinds)

    right = masks.repartition(n, "bucket")
    return docs_b.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(run, schema)
