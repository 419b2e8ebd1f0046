"""Token ids in binary shards with a minimal perfect hash index (operator 6).

Documents are sorted by id across tasks (range partitions); each task encodes its texts and writes one shard:

    offset 0   magic "RUNEID01", then int64: width of an id in bytes, documents, ids, keys, levels of the hash
    payload    all ids, little endian, each document closed by the end id
    starts     uint64[documents + 1]: where each document's ids begin in the payload
    ids        int64[documents], and uint8[documents]: whether the id is not null
    hash       for each level its size in bits (int64) and its bits; then uint32 ranks, one for each 512 bits
    slots      for each key uint32 fingerprint, uint32 ordinal of the document

A key is looked up in constant time: first level whose bit is set, its rank is the slot, the slot's fingerprint must
fit, its ordinal gives the payload range.  The shard of a key is found in the manifest's ranges.  Shards are written
under a temporary name and renamed, so a task that is run again replaces its own file.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from . import hashing as H

MAGIC = b"RUNEID01"
SHARD_BYTES = 8 << 20
CACHE, SLICE, SLICE_BYTES = 400_000, 4096, 8 << 20
"""Pieces of text whose ids a worker remembers, and texts that it encodes at a time."""
GAMMA, BLOCK = 1.5, 512
MANIFEST = "shard int, first_id long, last_id long, n_docs long, n_ids long"
UNSAFE = r"^[\s\x0b\x1c-\x1f\x{85}\p{Z}]|[\s\x0b\x1c-\x1f\x{85}\p{Z}] | [\s\x0b\x1c-\x1f\x{85}\p{Z}]|[\s\x0b\x1c-\x1f\x{85}\p{Z}]$|<\|"


# ---- encoding ----------------------------------------------------------------------------------------------------


class Encoder:
    """Encodes many texts with a byte-level BPE tokenizer of the tokenizers library.

    Such a tokenizer splits a text before every single space that stands between two characters which are not white
    space, whatever is around it, and encodes the pieces one by one.  So texts are cut there, each distinct piece of a
    batch is encoded once, and the ids are put together again; texts with other white space around a space, and those
    that may hold special tokens, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a character of a byte-level token stands for a byte
        for token, i in vocabulary.items():
            self.size[i] = len(token)

    def _encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for lo in range(0, len(texts), 4096):
            out += [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts[lo : lo + 4096], add_special_tokens=False)]
        return out

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece with a space before it, from texts that hold many pieces: no token crosses into the next piece, so their lengths in bytes tell them apart."""
        out = []
        for lo in range(0, len(pieces), 2048):
            some = pieces[lo : lo + 2048]
            text = " " + " ".join(some)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            raw = np.frombuffer((text + " ").encode(), np.uint8)
            cuts = np.searchsorted(np.cumsum(self.size[ids]), np.flatnonzero(raw == 32)[1:]) + 1  # a piece ends with the token that reaches the next space
            flat, ends = ids.tobytes(), (cuts * self.width).tolist()
            out += [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return out

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece with a space before it."""
        out = [self.known.get(p) or self.before.get(p) for p in pieces]
        missing = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(missing, self._joined([pieces[i] for i in missing]), strict=True):
            out[i] = ids
        self.known.update(zip(pieces, out, strict=True))
        if len(self.known) > CACHE:  # what is used again moves on, the rest is forgotten with the next turn
            self.known, self.before = {}, self.known
        return out

    def encode(self, texts: pa.Array, end: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, each closed by ``end``; and where each text begins (one more at the end)."""
        n = len(texts)
        if not n:
            return np.zeros(0, self.dtype), np.zeros(1, np.int64)
        texts = texts.fill_null("").cast(pa.large_string())
        odd = pc.match_substring_regex(texts, UNSAFE)
        split = pc.split_pattern(pc.if_else(odd, pa.scalar("", pa.large_string()), texts), " ")
        at = np.asarray(split.offsets, dtype=np.int64)
        at = at - at[0]
        flat = split.flatten()
        heads = pc.if_else(odd, texts, flat.take(pa.array(at[:-1]))).to_pylist()
        mask = np.zeros(len(flat), bool)
        mask[at[:-1]] = True
        rest = flat.filter(pa.array(~mask)).dictionary_encode()
        pieces = self._pieces(rest.dictionary.to_pylist()) + self._encode(heads)
        pieces.append(np.array([end], self.dtype).tobytes())
        codes = np.empty(len(flat) + n, np.int32)
        closing = at[1:] + np.arange(n)  # after the pieces of each text its end
        opening = at[:-1] + np.arange(n)
        inner = np.ones(len(codes), bool)
        inner[closing] = inner[opening] = False
        codes[inner] = rest.indices.to_numpy(zero_copy_only=False)
        codes[opening] = len(rest.dictionary) + np.arange(n)
        codes[closing] = len(pieces) - 1
        size = np.fromiter(map(len, pieces), np.int32, len(pieces)) // self.width
        ids = np.frombuffer(b"".join(pieces), self.dtype)
        first = np.cumsum(size, dtype=np.int64) - size
        lens = size[codes]
        ends = np.cumsum(lens, dtype=np.int64)
        out = ids[np.arange(ends[-1]) + np.repeat(first[codes] - (ends - lens), lens)]
        starts = np.r_[0, ends[closing]]
        return out, starts


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# ---- minimal perfect hash ----------------------------------------------------------------------------------------


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (H.mix(H.mix(keys.view(H.U)) + H.U((level + 1) * int(H.WORD_BASE) % 2**64)) % H.U(size)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (H.mix(keys.view(H.U) * H.BASE + H.U(99)) >> H.U(32)).astype("<u4")


class PerfectHash(NamedTuple):
    """Levels of bits: a key that meets no other in a level sets its bit there, the others go on to the next."""

    sizes: list[int]
    bits: list[np.ndarray]
    ranks: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct."""
        sizes, bits, rest = [], [], keys
        while len(rest):
            size = -(-max(int(GAMMA * len(rest)), 1) // BLOCK) * BLOCK
            at = _place(rest, len(sizes), size)
            count = np.bincount(at, minlength=size)
            sizes.append(size)
            bits.append(count == 1)
            rest = rest[count[at] != 1]
        return cls(sizes, bits, cls._ranks(bits))

    @staticmethod
    def _ranks(bits: list[np.ndarray]) -> np.ndarray:
        if not bits:
            return np.zeros(0, "<u4")
        per = np.concatenate(bits).reshape(-1, BLOCK).sum(1)
        return (np.cumsum(per) - per).astype("<u4")

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1, or any slot, for keys that aren't held."""
        out, open_, block = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, (size, bit) in enumerate(zip(self.sizes, self.bits, strict=True)):
            at = _place(keys[open_], level, size)
            hit = bit[at]
            b, inside = at[hit] // BLOCK, at[hit] % BLOCK
            before = np.cumsum(bit.reshape(-1, BLOCK), axis=1)[b, inside] - 1
            out[open_[hit]] = self.ranks[block + b].astype(np.int64) + before
            open_, block = open_[~hit], block + size // BLOCK
        return out


# ---- shards ------------------------------------------------------------------------------------------------------


def shard_bytes(ids: np.ndarray, starts: np.ndarray, doc_ids: np.ndarray, valid: np.ndarray, width: int) -> bytes:
    n = len(doc_ids)
    ordinal = np.flatnonzero(valid & np.r_[True, doc_ids[1:] != doc_ids[:-1]][:n])  # of rows that share an id, the first
    keys = doc_ids[ordinal]
    mph = PerfectHash.build(keys)
    slots = np.zeros(len(keys), [("fingerprint", "<u4"), ("ordinal", "<u4")])
    at = mph.slots(keys)
    slots["fingerprint"][at], slots["ordinal"][at] = fingerprints(keys), ordinal
    head = MAGIC + struct.pack("<5q", width, n, len(ids), len(keys), len(mph.sizes))
    levels = b"".join(struct.pack("<q", s) + np.packbits(b).tobytes() for s, b in zip(mph.sizes, mph.bits, strict=True))
    return b"".join([head, ids.astype(f"<u{width}").tobytes(), starts.astype("<u8").tobytes(), doc_ids.astype("<i8").tobytes(), valid.astype("u1").tobytes(), levels, mph.ranks.tobytes(), slots.tobytes()])


class Shard:
    """A shard file in memory."""

    def __init__(self, raw: bytes) -> None:
        if raw[:8] != MAGIC:
            raise ValueError("not a shard of token ids")
        width, n, n_ids, n_keys, n_levels = struct.unpack_from("<5q", raw, 8)
        at = 48
        self.ids = np.frombuffer(raw, f"<u{width}", n_ids, at)
        at += width * n_ids
        self.starts = np.frombuffer(raw, "<u8", n + 1, at).astype(np.int64)
        at += 8 * (n + 1)
        self.doc_ids = np.frombuffer(raw, "<i8", n, at)
        self.valid = np.frombuffer(raw, "u1", n, at + 8 * n).astype(bool)
        at += 9 * n
        sizes, bits = [], []
        for _ in range(n_levels):
            sizes.append(struct.unpack_from("<q", raw, at)[0])
            bits.append(np.unpackbits(np.frombuffer(raw, np.uint8, sizes[-1] // 8, at + 8)).astype(bool))
            at += 8 + sizes[-1] // 8
        blocks = sum(sizes) // BLOCK
        self.mph = PerfectHash(sizes, bits, np.frombuffer(raw, "<u4", blocks, at))
        self.slots = np.frombuffer(raw, [("fingerprint", "<u4"), ("ordinal", "<u4")], n_keys, at + 4 * blocks)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Ordinal of the document with each key, -1 if there is none (or, once in 2**32 such keys, any)."""
        slot = self.mph.slots(keys)
        ok = slot >= 0
        out = np.full(len(keys), -1, np.int64)
        s = self.slots[slot[ok]]
        out[ok] = np.where(s["fingerprint"] == fingerprints(keys[ok]), s["ordinal"].astype(np.int64), -1)
        return out

    def tokens(self, ordinal: int) -> np.ndarray:
        return self.ids[self.starts[ordinal] : self.starts[ordinal + 1]]


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def read_shard(uri: str, shard: int) -> Shard:
    fs, path = _open(uri)
    with fs.open_input_stream(f"{path}/ids-{shard:07d}.bin") as f:
        return Shard(f.read())


def write_tokens(docs: DataFrame, tokenizer: str, uri: str, end: int = 0, doc_id: str = "doc_id", text: str = "text", shard_bytes_aim: int = SHARD_BYTES) -> DataFrame:
    """Encodes ``text`` (null: empty) with the tokenizer file and writes shards in ascending ``doc_id`` order under ``uri``.

    Returns the manifest: ``shard, first_id, last_id, n_docs, n_ids, base``; ``base``: ids in all shards before.  Null
    ids come first and have no key in the index; rows that share an id stand together, in the order of a hash of their
    texts, and the key leads to the first.  An empty table gives an empty manifest.  Other columns are not read.
    ``uri``: a folder that all executors share and pyarrow can open (file, hdfs, s3, gs).
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("h", F.xxhash64("text"))
    n = C.n_buckets(docs, text, shard_bytes_aim)
    parts = d.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def write(batches):
        enc = encoder(tokenizer)
        ids, sizes, names, valid = [], [], [], []
        for t in (t for b in batches for t in C.slices(b, 1, most=SLICE_BYTES, rows=SLICE)):
            a, starts = enc.encode(t.column(1), end)
            ids.append(a)
            sizes.append(np.diff(starts))
            names.append(t.column(0).fill_null(0).to_numpy())
            valid.append(t.column(0).is_valid().to_numpy(zero_copy_only=False))
        if sum(map(len, names)):
            shard = TaskContext.get().partitionId()
            name, ok, size = np.concatenate(names), np.concatenate(valid), np.concatenate(sizes)
            all_ids = np.concatenate(ids)
            fs, path = _open(uri)
            fs.create_dir(path, recursive=True)
            temporary = f"{path}/_{uuid.uuid4().hex}"
            with fs.open_output_stream(temporary) as f:
                f.write(shard_bytes(all_ids, np.r_[0, np.cumsum(size)], name, ok, enc.width))
            fs.move(temporary, f"{path}/ids-{shard:07d}.bin")
            edge = [int(x) if o else None for x, o in ((name[0], ok[0]), (name[-1], ok[-1]))]
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "first_id": pa.array([edge[0]], pa.int64()), "last_id": pa.array([edge[1]], pa.int64()), "n_docs": pa.array([len(name)]), "n_ids": pa.array([len(all_ids)])})

    manifest = C.materialize(parts.mapInArrow(write, MANIFEST), "manifest")  # a row for each shard
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def read_tokens(manifest: DataFrame, uri: str) -> DataFrame:
    """Every document of the shards: ``doc_id, shard, ordinal, start, n_tokens, ids_crc32``, each found by its key.

    ``start``: ids of all documents before it; ``ids_crc32``: of its ids as little-endian unsigned 32-bit integers.
    """

    def read(batches):
        for t in batches:
            for k, base in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True):
                s = read_shard(uri, k)
                n = len(s.doc_ids)
                at = np.arange(n)
                first = s.valid & np.r_[True, s.doc_ids[1:] != s.doc_ids[:-1]][:n]
                at[first] = s.find(s.doc_ids[first])
                if not (at == np.arange(n)).all():
                    raise ValueError(f"index of shard {k} doesn't fit its documents")
                crc = [zlib.crc32(s.tokens(i).astype("<u4").tobytes()) for i in at.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.doc_ids, mask=~s.valid), pa.array(np.full(n, k, np.int32)), pa.array(at), pa.array(s.starts[at] + base), pa.array(s.starts[at + 1] - s.starts[at]), pa.array(crc, pa.int64())],
                    ["doc_id", "shard", "ordinal", "start", "n_tokens", "ids_crc32"],
                )

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("shard", "base").repartition(n, "shard").mapInArrow(read, "doc_id long, shard int, ordinal long, start long, n_tokens long, ids_crc32 long")


def lookup_in(f: pa.NativeFile, key: int) -> np.ndarray | None:
    """The ids of the document with this key in an open shard; None if there is none.

    Reads the header, the sizes of the levels, one block of bits of each level tried (1.5 on average), one rank, one slot,
    one pair of starts and the ids: as many bytes in a shard of any size, but for the logarithm that the levels are.
    """
    head = f.read_at(48, 0)
    if head[:8] != MAGIC:
        raise ValueError("not a shard of token ids")
    width, n, n_ids, _, n_levels = struct.unpack_from("<5q", head, 8)
    starts_at = 48 + width * n_ids
    at, levels = starts_at + 8 * (n + 1) + 9 * n, []
    for _ in range(n_levels):
        levels.append((struct.unpack("<q", f.read_at(8, at))[0], at + 8))
        at += 8 + levels[-1][0] // 8
    ranks_at, slots_at, block = at, at + 4 * (sum(size for size, _ in levels) // BLOCK), 0
    wanted = np.array([key], np.int64)
    for level, (size, bits_at) in enumerate(levels):
        b, inside = divmod(int(_place(wanted, level, size)[0]), BLOCK)
        bits = np.unpackbits(np.frombuffer(f.read_at(BLOCK // 8, bits_at + b * BLOCK // 8), np.uint8))
        if bits[inside]:
            slot = struct.unpack("<I", f.read_at(4, ranks_at + 4 * (block + b)))[0] + int(bits[:inside].sum())
            fingerprint, ordinal = struct.unpack("<2I", f.read_at(8, slots_at + 8 * slot))
            if fingerprint != int(fingerprints(wanted)[0]):
                return None
            first, last = struct.unpack("<2Q", f.read_at(16, starts_at + 8 * ordinal))
            return np.frombuffer(f.read_at(width * (last - first), 48 + width * first), f"<u{width}")
        block += size // BLOCK
    return None


def lookup(manifest: DataFrame, uri: str, key: int) -> np.ndarray | None:
    """The ids of the document with this key, read from the one shard that can hold it."""
    row = manifest.where(f"first_id <= {int(key)} or first_id is null").where(f"last_id >= {int(key)}").orderBy("shard").select("shard").first()
    if row is None:
        return None
    fs, path = _open(uri)
    with fs.open_input_file(f"{path}/ids-{row['shard']:07d}.bin") as f:
        return lookup_in(f, int(key))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = f"{C.shared_dir(spark)}/ids"
    manifest = write_tokens(C.table(spark, sf_dir, "documents"), default_tokenizer(), uri)
    return read_tokens(manifest, uri).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op6_token_ids": op6_token_ids}
ORACLE: dict[str, str] = {}
