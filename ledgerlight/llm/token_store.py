"""Binary token output with a minimal perfect hash index over document keys.

The file format. ``payload`` holds shards in ascending order of doc_id, one
Parquet row each: ``ids``, the raw little-endian token ids of its documents one
after another (two bytes each while the vocabulary allows it, else four), and
the documents' keys and lengths. Parquet is only the container: it lets Spark
write and read shards in any store. ``index`` holds the minimal perfect hash
in buckets: a key's hash gives its bucket; inside, cascading bit arrays give
the key a slot of its own (the rank of the first bit it owns), and the slot
has a 32-bit fingerprint, the shard, the offset and the length. A lookup costs
a constant number of probes; a key that was never written fails the
fingerprint.

How it scales: texts are dealt by ranges of doc_id once and encoded where they
land, so texts are shuffled once. The index is built from (key, shard, offset,
length) rows in buckets of about ``BUCKET_KEYS`` keys. Readers bring the
index's answers and the shards (about 4 million ids each) together by shard.

Cases: a null text is an empty one and has only the end id; a null doc_id is
written (first in order) but is no key; of repeated doc_ids the index has the
first in order, all are written next to each other, ties in order of a hash of
the text; an empty table gives an empty store; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlight.llm.memory import lean, lean_cogroup
from ledgerlight.llm.tokens import encoder, slices, text_bytes

SHARD_TOKENS = 4_000_000
BUCKET_KEYS = 32_768
U64 = np.uint64
PAYLOAD = "shard long, n_docs long, n_tokens long, last_key long, width int, ids binary, keys binary, nulls binary, lengths binary"
ENTRY = "doc_id long, shard long, start_in_shard long, n_tokens long"
BUCKET = "bucket long, n_keys long, sizes binary, bits binary, ranks binary, fingerprints binary, shards binary, offsets binary, lengths binary"


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


class PerfectHash:
    """Cascading bit arrays over distinct 64-bit keys: key -> slot in 0..n-1."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, ranks: np.ndarray):
        self.sizes, self.bits, self.ranks = sizes, bits, ranks
        self.bases = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(keys + U64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % U64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, owned, left, base = [], [], keys, 0
        while len(left):
            size = max(64, -(-2 * len(left) // 64) * 64)
            at = cls.place(left, len(sizes), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            owned.append(at[alone] + base)
            sizes.append(size)
            base += size
            left = left[~alone]
        bits = np.zeros(base // 64, U64)
        positions = np.concatenate(owned) if owned else np.zeros(0, np.int64)
        np.bitwise_or.at(bits, positions >> 6, U64(1) << (positions & 63).astype(U64))
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits))[:-1]]).astype(np.int64) if base else np.zeros(0, np.int64)
        return cls(np.array(sizes, np.int64), bits, ranks)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no bit is owned (the key was never in)."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            at = self.place(keys[left], level, size) + self.bases[level]
            word, bit = self.bits[at >> 6], (at & 63).astype(U64)
            hit = (word >> bit & U64(1)).astype(bool)
            below = word[hit] & ((U64(1) << bit[hit]) - U64(1))
            out[left[hit]] = self.ranks[at[hit] >> 6] + np.bitwise_count(below)
            left = left[~hit]
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys ^ U64(0xD6E8FEB86659FD93)) >> U64(32)).astype("<u4")


def write_payload(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_tokens: int = SHARD_TOKENS) -> None:
    @lean
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        end, width = np.array([end_id], coder.dtype).tobytes(), coder.dtype.itemsize
        number = TaskContext.get().partitionId() << 24
        keys, ids, size = [], [], 0

        def shard() -> pa.RecordBatch:
            nulls = np.array([k is None for k in keys], np.uint8)
            row = {
                "shard": number, "n_docs": len(keys), "n_tokens": size // width, "last_key": keys[-1], "width": width, "ids": b"".join(ids),
                "keys": np.array([k or 0 for k in keys], "<i8").tobytes(), "nulls": nulls.tobytes(),
                "lengths": np.array([len(x) // width for x in ids], "<u4").tobytes(),
            }
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = pa.schema([("shard", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("last_key", pa.int64()), ("width", pa.int32()), *[(n, pa.binary()) for n in ("ids", "keys", "nulls", "lengths")]])
        for batch in batches:
            for part in slices(batch, "text", 1 << 22):
                encoded = coder.encode(text_bytes(part.column("text")))
                for key, found in zip(part.column("doc_id").to_pylist(), encoded, strict=True):
                    keys.append(key)
                    ids.append(found + end)
                    size += len(ids[-1])
                    if size >= shard_tokens * width:
                        yield shard()
                        number, keys, ids, size = number + 1, [], [], 0
        if keys:
            yield shard()
        coder.forget()

    # The row number only parts rows equal in id and text, which any order serves: one such group may fill many ranges.
    order = [F.col("doc_id").asc_nulls_first(), "tie", "row"]
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    ranged = ranged.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.drop("tie", "row").mapInArrow(pack, PAYLOAD).write.parquet(f"{path}/payload")


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAYLOAD).parquet(f"{path}/payload")


def documents_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
    return np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["nulls"], np.uint8).astype(bool), np.cumsum(lengths) - lengths, lengths


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, shard, start_in_shard, n_tokens) of every document, from the shards' own lists."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, nulls, starts, lengths = documents_of(row)
                yield pa.RecordBatch.from_arrays([pa.array(keys, mask=nulls), pa.array(np.full(len(keys), row["shard"])), pa.array(starts), pa.array(lengths)], ["doc_id", "shard", "start_in_shard", "n_tokens"])

    return read_payload(spark, path).select("shard", "keys", "nulls", "lengths").mapInArrow(unpack, ENTRY)


def bucket_of(n_buckets: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(n_buckets)).cast("long")


def write_index(spark: SparkSession, path: str) -> None:
    def build(key: tuple, table: pa.Table) -> pa.Table:
        keys = table.column("doc_id").to_numpy().astype(np.int64).view(U64)
        order = PerfectHash.build(keys)
        at = order.slots(keys)
        take = np.empty(len(keys), np.int64)
        take[at] = np.arange(len(keys))
        column = lambda name, kind: table.column(name).to_numpy()[take].astype(kind).tobytes()
        row = {
            "bucket": key[0].as_py(), "n_keys": len(keys), "sizes": order.sizes.astype("<i8").tobytes(), "bits": order.bits.tobytes(),
            "ranks": order.ranks.astype("<u4").tobytes(), "fingerprints": fingerprint(keys)[take].tobytes(),
            "shards": column("shard", "<i8"), "offsets": column("start_in_shard", "<i8"), "lengths": column("n_tokens", "<u4"),
        }
        schema = pa.schema([("bucket", pa.int64()), ("n_keys", pa.int64()), *[(n, pa.binary()) for n in ("sizes", "bits", "ranks", "fingerprints", "shards", "offsets", "lengths")]])
        return pa.Table.from_pylist([row], schema=schema)

    n_docs = read_payload(spark, path).agg(F.sum("n_docs")).first()[0] or 0
    n_buckets = max(1, -(-n_docs // BUCKET_KEYS))
    first = entries(spark, path).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("shard", "start_in_shard", "n_tokens")).alias("e")).select("doc_id", "e.*")
    rows = first.withColumn("bucket", bucket_of(n_buckets)).groupBy("bucket").applyInArrow(build, BUCKET)
    rows.withColumn("n_buckets", F.lit(n_buckets).cast("long")).write.parquet(f"{path}/index")


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode every whole text, append ``end_id``, and write payload and index under ``path``."""
    write_payload(docs, path, tokenizer, end_id, shard_tokens)
    write_index(docs.sparkSession, path)


def lookup(keys: DataFrame, path: str) -> DataFrame:
    """(doc_id, shard, start_in_shard, n_tokens) of each distinct key that the store has."""
    spark = keys.sparkSession
    index = spark.read.schema(BUCKET + ", n_buckets long").parquet(f"{path}/index")
    n_buckets = (index.agg(F.max("n_buckets")).first()[0]) or 1

    def probe(_: tuple, asked: pa.Table, bucket: pa.Table) -> pa.Table:
        ids = asked.column("doc_id").to_numpy().astype(np.int64)
        if not bucket.num_rows or not len(ids):
            shard = offset = length = np.zeros(0, np.int64)
            ids = ids[:0]
        else:
            row, keys = bucket.to_pylist()[0], ids.view(U64)
            of = lambda name, kind: np.frombuffer(row[name], kind)
            at = PerfectHash(of("sizes", "<i8"), of("bits", "<u8"), of("ranks", "<u4").astype(np.int64)).slots(keys)
            known = at >= 0
            known[known] = of("fingerprints", "<u4")[at[known]] == fingerprint(keys[known])
            ids, at = ids[known], at[known]
            shard, offset, length = of("shards", "<i8")[at], of("offsets", "<i8")[at], of("lengths", "<u4")[at].astype(np.int64)
        return pa.table([pa.array(ids), pa.array(shard), pa.array(offset), pa.array(length)], ["doc_id", "shard", "start_in_shard", "n_tokens"])

    asked = keys.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct().withColumn("bucket", bucket_of(n_buckets))
    return asked.groupBy("bucket").cogroup(index.drop("n_buckets").groupBy("bucket")).applyInArrow(probe, ENTRY)


def shard_ids(shard: pa.Table) -> np.ndarray:
    """The ids of a shard as 32-bit integers."""
    return np.frombuffer(shard.column("ids")[0].as_buffer(), f"<u{shard.column('width')[0].as_py()}").astype("<u4")


def fetch(keys: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<long>) of each distinct key that the store has, read at its offset."""

    def cut(_: tuple, found: pa.Table, shard: pa.Table) -> pa.Table:
        ids = shard_ids(shard).astype(np.int64)
        starts, lengths = found.column("start_in_shard").to_numpy(), found.column("n_tokens").to_numpy()
        return pa.table([found.column("doc_id"), pa.array([ids[a : a + n] for a, n in zip(starts, lengths, strict=True)], pa.list_(pa.int64()))], ["doc_id", "ids"])

    found = lookup(keys, path)
    shards = read_payload(keys.sparkSession, path).select("shard", "width", "ids").join(found.select("shard").distinct(), "shard", "left_semi")
    return found.groupBy("shard").cogroup(shards.groupBy("shard")).applyInArrow(cut, "doc_id long, ids array<long>")


def without_key(shard: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_id, null flag, start and length of a shard's documents that are no keys: of null id, or after one of equal id.

    Documents are in order of id, so the one before a repeat is next to it, at a shard's beginning in the shard before.
    """
    keys, nulls, starts, lengths = documents_of(shard)
    again = np.zeros(len(keys), bool)
    again[1:] = (keys[1:] == keys[:-1]) & ~nulls[:-1]
    again[:1] = shard["key_before"] is not None and not nulls[0] and keys[0] == shard["key_before"]
    rest = nulls | again
    return keys[rest], nulls[rest], starts[rest], lengths[rest]


def stored_documents(docs: DataFrame, path: str) -> DataFrame:
    """Every document as read back: the index is asked for each key of ``docs``, the shards are cut at its answers.

    doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of
    its ids as 32-bit integers), by_key. Rows by key have place and length from
    the index alone, so a key that the index loses is a row lost; documents
    without a key (null ids, later ones of a repeated id) are read by the
    shards' own lists.
    """
    shards = read_payload(docs.sparkSession, path)
    before = Window.orderBy("shard")
    bases = shards.select(
        "shard", F.coalesce(F.sum("n_tokens").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        F.lag("last_key").over(before).alias("key_before"),
    )

    @lean_cogroup
    def read(_: tuple, found: pa.Table, shard: pa.Table) -> pa.Table:
        ids = memoryview(shard_ids(shard)).cast("B")
        row = shard.drop_columns(["ids"]).to_pylist()[0]
        keys, nulls, starts, lengths = without_key(row)
        by_key = np.arange(found.num_rows + len(keys)) < found.num_rows
        starts = np.concatenate([found.column("start_in_shard").to_numpy(), starts])
        lengths = np.concatenate([found.column("n_tokens").to_numpy(), lengths])
        crcs = np.array([zlib.crc32(ids[4 * a : 4 * (a + n)]) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)], np.int64)
        doc_ids = pa.concat_arrays([found.column("doc_id").combine_chunks(), pa.array(keys, pa.int64(), mask=nulls)])
        return pa.table([doc_ids, pa.array(starts + row["base"]), pa.array(lengths), pa.array(crcs), pa.array(by_key)], ["doc_id", "start", "n_tokens", "ids_crc32", "by_key"])

    payload = shards.drop("n_docs", "n_tokens", "last_key").join(bases, "shard")
    return lookup(docs, path).groupBy("shard").cogroup(payload.groupBy("shard")).applyInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, by_key boolean")
