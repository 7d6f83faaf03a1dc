"""Sum-of-squares online packing of token ids into training sequences (operator 5)."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import small_batches, trimmed
from .tokens import TextTokenizer

WINDOW = 1024
END = 0
#: Documents that share a task's levels, at least: with fewer, too much of what is packed would still be open at the end and be cut anew.
UNIT = 20_000
PIECE = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class Packer:
    """Online packing of pieces, each a (key, start, ids as bytes, document's ids); full sequences come out at once.

    A document's full windows are sequences of their own; its remainder goes to the level whose choice leaves the sum of squared counts of partly filled windows least (ties: the fullest), or opens a window. What stands open at the end is cut anew into full windows, and the last one into powers of two, which need no padding.
    """

    def __init__(self, window: int = WINDOW):
        self.window, self.n = window, 0
        self.placed = self.recut = 0  # remainders' ids that the levels placed for good, and that the end cut anew
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]

    def _close(self, pieces):
        at = 0
        for key, start, ids, total in pieces:
            n = len(ids) // 4
            yield key, (start, n, zlib.crc32(ids), total, self.n, at)
            at += n
        self.n += 1

    def add(self, key, ids: bytes):
        total, w = len(ids) // 4, self.window
        for a in range(0, total - w + 1, w):
            yield from self._close([(key, a, ids[4 * a : 4 * (a + w)], total)])
        s = total % w
        if not s:
            return
        self.placed += s
        piece = (key, total - s, ids[4 * (total - s) :], total)
        c = self.count
        gain = 2 * (c[s:w] - c[: w - s]) + 2  # from level h to h + s, both partly filled
        gain = np.append(gain, 1 - 2 * c[w - s])  # filled
        gain[0] = 2 * c[s] + 1  # a new window
        usable = c[: w - s + 1] > 0
        usable[0] = True
        gain = np.where(usable, gain, 1 << 60)
        h = w - s - int(gain[::-1].argmin())
        if h:
            c[h] -= 1
            pieces = self.open[h].pop()
        else:
            pieces = []
        pieces.append(piece)
        if h + s == w:
            yield from self._close(pieces)
        else:
            c[h + s] += 1
            self.open[h + s].append(pieces)

    def finish(self):
        w = self.window
        left = [p for level in reversed(self.open) for pieces in level for p in pieces]
        rest = sum(len(p[2]) // 4 for p in left)
        self.placed, self.recut = self.placed - rest, self.recut + rest
        sizes = [w] * (rest // w) + [1 << i for i in reversed(range(w.bit_length())) if (rest % w) >> i & 1]
        now, room = [], sizes.pop(0) if sizes else 0
        for key, start, ids, total in left:
            while ids:
                take = min(room, len(ids) // 4)
                now.append((key, start, ids[: 4 * take], total))
                start, ids, room = start + take, ids[4 * take :], room - take
                if not room:
                    yield from self._close(now)
                    now, room = [], sizes.pop(0) if sizes else 0


def pack(docs: DataFrame, tokenizer: str, kind: str = "bytes", window: int = WINDOW, end: int = END, key: str = "doc_id") -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece of each row of docs.

    Each task packs what it reads in one pass, without a shuffle; a sequence never spans tasks and its id has the task's partition in the upper bits, so a task that is run again gives the same rows. Input partitions are joined until they have UNIT documents on average. A document's ids are those of its text (null: none) and end. An empty text is its end id alone; a text of any length is packed whole; a null key is kept; repeated rows are packed once each; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(key, F.col("text").cast("string").alias("_text"))
    docs = docs.coalesce(max(1, docs.count() // UNIT))
    schema = StructType([StructField(key, docs.schema[key].dataType), *[StructField(c, LongType()) for c in PIECE]])
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        packer, tok = Packer(window), TextTokenizer.of(tokenizer, kind)

        def batch(rows):
            keys = pa.array([k for k, _ in rows], key_type)
            cols = zip(*[p for _, p in rows], strict=True)
            return pa.RecordBatch.from_arrays([keys, *[pa.array([x + base for x in c] if i == 4 else c, pa.int64()) for i, c in enumerate(cols)]], [key, *PIECE])

        key_type = None
        for b in batches:
            key_type = b.column(0).type
            texts = [t or "" for t in b.column(1).to_pylist()]
            rows = []
            for i in range(0, len(texts), 64):
                for k, ids in zip(b.column(0)[i : i + 64].to_pylist(), tok.encode(texts[i : i + 64]), strict=True):
                    rows += packer.add(k, ids + last)
            if rows:
                yield batch(rows)
        rows = list(packer.finish())
        if rows:
            yield batch(rows)

    return docs.mapInArrow(trimmed(run), schema)


def op5(spark, sf_dir: str) -> DataFrame:
    """Whole `documents`, byte-level BPE, windows of 1024, id 0 after each document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
