"""Token-id store: documents compressed one by one with a shared zstandard dictionary (operator 6).

A store is a folder in any file system that Spark writes: `blocks` has rows of consecutive documents, their frames end to end and the index of them; `dictionary` has one row, the dictionary and its hash. One document is read by its block's id range and its offset, without decompressing others.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import partitions_for, small_batches, table_path
from .tokens import TextTokenizer

#: Documents whose ids train the dictionary, by a hash. The dictionary's bytes.
SAMPLE, DICT_BYTES = 400, 64 << 10
BLOCK_BYTES, BLOCK_DOCS, PART_ROWS = 1 << 20, 512, 20_000
LEVEL = 3

BLOCKS = "shard int, block int, first_id long, last_id long, start long, tokens long, doc_ids array<long>, offsets array<long>, n_tokens array<long>, width int, dict_hash string, frames binary"
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.string(), pa.binary()]
_NAMES = [x.split()[0] for x in BLOCKS.split(", ")]


def _narrow(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def _wide(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def train(docs: DataFrame, n: int, tokenizer: str, kind: str, end: int, width: int) -> bytes:
    """A dictionary of at most DICT_BYTES from the ids of about SAMPLE of n documents, never more; empty if they are too few to train one.

    Those are taken whose hash is below a share of its range, so that tasks send the driver few rows in all.
    """
    h, space = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)), 1 << 40
    some = docs.where("text is not null").where(h < F.lit(space * SAMPLE // max(n, SAMPLE)))
    rows = some.orderBy(h, "doc_id", "text").limit(SAMPLE).select("text").collect()
    tok, last = TextTokenizer.of(tokenizer, kind), np.array([end], "<u4").tobytes()
    samples = [_narrow(x + last, width) for x in tok.encode([r[0] for r in rows])]
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def write_store(docs: DataFrame, path: str, tokenizer: str, kind: str, end: int, vocabulary: int) -> None:
    """Writes docs (doc_id, text) in ascending doc_id order, null ids first, rows of one id by a hash of their text.

    A null text is empty, so its ids are the end id alone; repeated rows are stored once each; an empty table gives a store of no blocks. Documents are dealt by ranges of doc_id and each task writes its shard through Spark's committer, so a lost task leaves nothing behind.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    width = 2 if vocabulary <= 1 << 16 else 4
    count = docs.select("doc_id").count()
    dictionary = train(docs, count, tokenizer, kind, end, width)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary), tokenizer.rpartition("/")[2], end)], "dict_hash string, dictionary binary, tokenizer string, end_id int").coalesce(1).write.parquet(f"{path}/dictionary")
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        shard, tok = TaskContext.get().partitionId(), TextTokenizer.of(tokenizer, kind)
        z = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
        start, block = 0, 0
        ids, offs, ns, frames, held = [], [], [], [], 0

        def flush():
            n = sum(ns)
            known = [x for x in ids if x is not None]
            row = (shard, block, min(known, default=None), max(known, default=None), start, n, ids, offs, ns, width, digest, b"".join(frames))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES, strict=True)], _NAMES), n

        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i in range(0, len(texts), 64):
                for d, x in zip(b.column(0)[i : i + 64].to_pylist(), tok.encode(texts[i : i + 64]), strict=True):
                    f = z.compress(_narrow(x + last, width))
                    ids.append(d)
                    offs.append(held)
                    ns.append(len(x) // 4 + 1)
                    frames.append(f)
                    held += len(f)
                    if held >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                        out, n = flush()
                        yield out
                        start, block, ids, offs, ns, frames, held = start + n, block + 1, [], [], [], [], 0
        if ids:
            yield flush()[0]

    n = partitions_for(spark, count, PART_ROWS)
    dealt = docs.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    dealt.mapInArrow(run, BLOCKS).write.parquet(f"{path}/blocks")


def _dictionary(spark, path: str) -> tuple[bytes, str]:
    r = spark.read.parquet(f"{path}/dictionary").first()
    return bytes(r["dictionary"]), r["dict_hash"]


def _frames(row, z, ids=None):
    """(doc_id, start in shard, ids as uint32 bytes) of a block's documents, or of those in ids."""
    begin = row["start"]
    ends = [*row["offsets"][1:], len(row["frames"])]
    for d, a, b, n in zip(row["doc_ids"], row["offsets"], ends, row["n_tokens"], strict=True):
        if ids is None or d in ids:
            yield d, begin, _wide(z.decompress(row["frames"][a:b]), row["width"])
        begin += n


def read_store(spark, path: str, wanted: list[int] | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids array<int>]) from a store; with wanted, of these documents only, which reads just the blocks whose id range holds one."""
    dictionary, digest = _dictionary(spark, path)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    shards = blocks.groupBy("shard").agg(F.sum("tokens").alias("n")).orderBy("shard").collect()  # a row per task that wrote
    first, at = {}, 0
    for r in shards:
        first[r["shard"]] = at
        at += r["n"]
    if wanted is not None:
        some = F.lit(False)
        for x in wanted:
            some = some | ((F.col("first_id") <= x) & (F.col("last_id") >= x))
        blocks = blocks.where(some)
    chosen = None if wanted is None else set(wanted)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")

    def run(batches):
        z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for b in batches:
            for row in b.to_pylist():
                if row["dict_hash"] != digest:
                    raise ValueError("a block was written with another dictionary")
                got = [(d, s + first[row["shard"]], len(x) // 4, zlib.crc32(x), x) for d, s, x in _frames(row, z, chosen)]
                if got:
                    d, s, n, c, x = zip(*got, strict=True)
                    cols = [pa.array(v, pa.int64()) for v in (d, s, n, c)]
                    if with_ids:
                        cols.append(pa.array([np.frombuffer(v, "<u4").astype(np.int32) for v in x], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def op6(spark, sf_dir: str) -> DataFrame:
    """Whole `documents`, written to a store in the shared folder and read back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = table_path(spark, "token-store")
    write_store(docs, path, public_tokenizers.path("word_bpe_49k.json"), "spaced", 1, 49_408)
    return read_store(spark, path)
