"""Repeated-substring removal with a run-length compressed Burrows-Wheeler index (operator 2).

Four passes, none of which gathers a group in one task or the driver:

1. Every window of `length` bytes has an anchor, its leftmost minimal K-byte hash; equal windows have equal anchors at equal offsets. Each task reduces its anchors to the first occurrence of each (anchor, context), a context being the anchor with all bytes that a window around it can have. Later occurrences of a context are covered by the first one whole.
2. Anchors are dealt by hash. What is left per anchor are its distinct contexts; an anchor with one context is dropped, the others are candidates.
3. Candidates get their bytes back and are dealt by anchor to shards. Those of which no half occurs twice are dropped. A shard sorts its contexts' suffixes, makes the BWT, run-compresses it and keeps only the samples at run heads (text position, position of the lexicographic predecessor, common prefix). Streaming over the text, these samples give each position its matching statistics: both values move by one per byte from the sample before. Positions with a match of `length` bytes form chains of equal windows; all but the earliest of a chain are covered.
4. Covered runs are merged per document and cut out.

An anchor that has very many distinct contexts (a common line) is found by a first pass over a hash sample of contexts; its windows are dealt by their own hashes instead, so equal windows meet and nothing else does.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_rows, buffers, discard, partitions_for, scratch, small_batches, trimmed, written

LENGTH, K = 100, 24
#: Text that is hashed at once, and anchors a task holds before it passes on their reduction.
CHUNK, HELD = 1 << 20, 3 << 20
#: An anchor with over HOT distinct contexts, by those of one hash in SAMPLED, is dealt by windows; at most MOST_HOT such anchors are sent to the tasks.
HOT, SAMPLED, MOST_HOT = 3000, 16, 1_000_000
#: Contexts that a task of the second pass holds, about.
MEET_ROWS = 1_000_000
#: Bytes of candidate context in a shard, about.
SHARD = 256 << 10

ROW = "kind byte, h long, ctx long, doc_id long, at long"
NAMES = ["kind", "h", "ctx", "doc_id", "at"]


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(7))
    out = []
    for _ in range(2):
        base = int(rng.integers(1 << 62, 1 << 63)) | 5
        inv = pow(base, -1, 1 << 64)
        up = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))))
        down = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, inv, np.uint64))))
        out += [rng.integers(1, 1 << 63, 256, np.uint64), up, down]
    return tuple(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


class Hasher:
    """Hashes of any substring of a buffer, from prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        n = 1 << max(20, int(len(data)).bit_length())
        self.table, self.up, self.down, self.table2, self.up2, self.down2 = _powers(n)
        self.data = data
        self.pre = self._sums(self.table, self.up)
        self.pre2 = None

    def _sums(self, table, up):
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(table[self.data] * up[: len(self.data)], out=out[1:])
        return out

    def at(self, a, z):
        return _mix((self.pre[z] - self.pre[a]) * self.down[a])

    def second(self, a, z):
        if self.pre2 is None:
            self.pre2 = self._sums(self.table2, self.up2)
        return _mix((self.pre2[z] - self.pre2[a]) * self.down2[a] ^ (np.asarray(z - a, np.uint64) << np.uint64(48)))


def anchors(hasher: Hasher, offs: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, document index, anchor hash) of each window's anchor in a buffer of documents at offs."""
    n = len(hasher.data)
    if n < length:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64)
    bits = np.uint64(int(n).bit_length())
    h = _mix((hasher.pre[k:] - hasher.pre[:-k]) * hasher.down[: n - k + 1])
    v = (h >> bits << bits) | np.arange(n - k + 1, dtype=np.uint64)
    span, m = 1, v
    want = length - k + 1
    while span * 2 <= want:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < want:
        m = np.minimum(m[: len(m) - (want - span)], m[want - span :])
    low = (m & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    fine = np.zeros(n + 1, np.int8)
    size = np.diff(offs)
    for a, s in zip(offs[:-1][size >= length].tolist(), size[size >= length].tolist(), strict=True):
        fine[a : a + s - length + 1] = 1
    chosen = np.zeros(n, bool)
    chosen[low[fine[: len(low)] == 1]] = True
    pos = np.flatnonzero(chosen)
    return pos, np.searchsorted(offs, pos, "right") - 1, h[pos]


def _chunks(batch, length):
    """(hasher, offsets, doc ids) over about CHUNK bytes of a batch each."""
    data, offs = buffers(batch.column(1))
    ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
    i = 0
    while i < len(ids):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + CHUNK, "right")) - 1)
        if offs[j] - offs[i] >= length:
            yield Hasher(data[offs[i] : offs[j]]), offs[i : j + 1] - offs[i], ids[i:j]
        i = j


def _first_rows(h, ctx, doc, at, kind=None):
    """Sorted order, and where a new (h, ctx) begins."""
    order = np.lexsort((at, doc, ctx, h))
    h, ctx = h[order], ctx[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1])))
    return order, new


def _emit(kind, h, ctx, doc, at):
    kind = np.full(len(h), kind, np.int8)
    for i in range(0, len(h), 200_000):
        s = slice(i, i + 200_000)
        yield pa.RecordBatch.from_arrays([pa.array(x[s]) for x in (kind, h, ctx, doc, at)], NAMES)


def _reduce(parts):
    """Kind 0: the first row of each (h, ctx); kind 1: the others, which are covered."""
    h, ctx, doc, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    order, new = _first_rows(h, ctx, doc, at)
    for kind, take in ((0, order[new]), (1, order[~new])):
        yield from _emit(kind, h[take], ctx[take], doc[take], at[take])


def _rows(hasher, offs, ids, hot, length, k):
    """(h, ctx, doc, at) of a chunk: at has the anchor's position, and how far its context goes to the left and right, 8 bits each."""
    pos, doc, h = anchors(hasher, offs, length, k)
    reach = length - k
    a, z = np.maximum(offs[doc], pos - reach), np.minimum(offs[doc + 1], pos + length)
    h = h.view(np.int64)
    is_hot = np.isin(h, hot) if len(hot) else np.zeros(len(h), bool)
    p, d, lo, hi = pos[~is_hot], doc[~is_hot], a[~is_hot], z[~is_hot]
    yield h[~is_hot], hasher.second(lo, hi).view(np.int64), ids[d], (p - offs[d]) << 16 | (p - lo) << 8 | (hi - p - k)
    if is_hot.any():
        p, d, lo, hi = pos[is_hot], doc[is_hot], a[is_hot], z[is_hot]
        n = np.maximum(0, hi - lo - length + 1)
        s = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        own, d = np.repeat(p, n), np.repeat(d, n)
        once = np.unique(s, return_index=True)[1]
        s, own, d = s[once], own[once], d[once]
        yield hasher.at(s, s + length).view(np.int64), hasher.second(s, s + length).view(np.int64), ids[d], (s - offs[d]) << 16 | (length - k)


def _hot_anchors(docs: DataFrame, length: int, k: int, hot_at: int) -> tuple[np.ndarray, int]:
    """(anchors with over about hot_at distinct contexts, number of all contexts): estimated from the contexts of one hash in SAMPLED, counted over all documents with a row per anchor and task in the shuffle.

    Which anchors are hot only decides how they are dealt, not what comes out. At most MOST_HOT are sent to the tasks: if more are hot, the bar is raised, and the anchors below it are few times larger.
    """

    def count(batches):
        def some(parts):
            h, ctx = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((ctx, h))
            h, ctx, new = h[order], ctx[order], np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1])
            u, n = np.unique(h[new], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)], ["h", "n"])

        parts, held, total = [], 0, 0
        for b in batches:
            for hasher, offs, ids in _chunks(b, length):
                for h, ctx, _, _ in _rows(hasher, offs, ids, np.zeros(0, np.int64), length, k):
                    total += len(h)
                    take = ctx % SAMPLED == 0
                    parts.append((h[take], ctx[take]))
                    held += len(parts[-1][0])
            if held > HELD:
                yield some(parts)
                parts, held = [], 0
        if parts:
            yield some(parts)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], ["h", "n"])

    least = hot_at // SAMPLED + 1
    found = docs.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("h").isNull())
    found = written(found, "anchors")
    total = found.where("h is null").agg(F.sum("n")).first()[0] or 0
    hot = found.where("h is not null")
    while hot.count() > MOST_HOT:
        least *= 2
        hot = hot.where(F.col("n") >= least)
    out = np.array(sorted(r[0] for r in hot.select("h").collect()), np.int64)  # at most MOST_HOT numbers
    discard(found)
    return out, total


def _suffix_order(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Suffixes of a text of contexts, sorted within their contexts: a context's end sorts before any byte, ends by the context's number.

    Prefix doubling; only groups that are still equal are sorted again.
    """
    n = len(text)
    left = (np.repeat(start + size, size) - np.arange(n)).astype(np.int32)
    key = np.zeros(n, np.int64)
    wide = np.concatenate((text.astype(np.int64) + 1, np.zeros(8, np.int64)))
    step = 6
    for i in range(step):
        key = key * 257 + np.where(left > i, wide[i : i + n], 0)
    order = np.argsort(key)
    s = key[order]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    slots = np.arange(n)
    rank = np.empty(n, np.int64)  # the first slot of a suffix's group
    while True:
        first = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        rank[order[slots]] = first
        alone = new & np.append(new[1:], True)
        slots = slots[~alone]
        if not len(slots):
            return order
        at = order[slots]
        group = rank[at]
        # past a context's end: by its number, below all that goes on
        key = np.where(left[at] > step, rank[np.minimum(at + step, n - 1)] + n, at)
        both = group * (2 * n) + key
        by = np.argsort(both)
        order[slots] = at[by]
        s = both[by]
        new = np.concatenate(([True], s[1:] != s[:-1]))
        step *= 2


class RunIndex:
    """Run-compressed BWT of a text of contexts: per run of equal BWT symbols, the head's text position, its lexicographic predecessor and their common prefix."""

    def __init__(self, text: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.n = len(text)
        order = _suffix_order(text, start, size)
        first = np.zeros(self.n, bool)
        first[start] = True
        bwt = np.where(first[order], -1 - order, text[order - 1].astype(np.int64))
        head = np.flatnonzero(np.concatenate(([True], bwt[1:] != bwt[:-1])))
        at, before = order[head], order[np.maximum(head - 1, 0)]
        left = np.repeat(start + size, size) - np.arange(self.n)
        most = np.minimum(left[at], left[before])
        most[0] = 0
        common, going = np.zeros(len(head), np.int64), np.flatnonzero(most > 0)
        for i in range(0, int(most.max(initial=0))):
            going = going[(most[going] > i)]
            going = going[text[at[going] + i] == text[before[going] + i]]
            if not len(going):
                break
            common[going] = i + 1
        by = np.argsort(at)
        self.at, self.before, self.common = at[by], before[by], common[by]
        self.runs = len(head)

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each text position, its lexicographic predecessor and the length of their match, streamed from the samples."""
        seg = np.searchsorted(self.at, np.arange(self.n), "right") - 1
        past = np.arange(self.n) - self.at[seg]
        return self.before[seg] + past, self.common[seg] - past


def repeats(contexts: list[bytes], doc: np.ndarray, begin: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset) of each window of length bytes in contexts that also starts earlier, by (doc, begin + offset)."""
    if not contexts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.array([len(c) for c in contexts], np.int64)
    text = np.frombuffer(b"".join(contexts), np.uint8)
    start = np.cumsum(size) - size
    index = RunIndex(text, start, size)
    before, match = index.matching_statistics()
    n = np.arange(index.n)
    link = match >= length
    touched = link.copy()
    touched[before[link]] = True
    parent = np.where(link, before, n)
    while True:
        up = parent[parent]
        if (up == parent).all():
            break
        parent = up
    p = np.flatnonzero(touched)
    own = np.searchsorted(start, p, "right") - 1
    off = p - start[own]
    _, dense = np.unique(doc, return_inverse=True)
    place = dense[own].astype(np.int64) << 40 | (begin[own] + off)
    by = np.lexsort((place, parent[p]))
    root, place, own, off = parent[p][by], place[by], own[by], off[by]
    new = np.concatenate(([True], root[1:] != root[:-1])) if len(root) else np.zeros(0, bool)
    least = place[np.flatnonzero(new)][np.cumsum(new) - 1] if len(root) else place
    late = place > least
    return own[late], off[late]


def _may_match(contexts: list[bytes], lo: np.ndarray, length: int, k: int) -> np.ndarray:
    """Which contexts, anchored at lo, can share a window: one has the anchor with at least half of its other bytes on the left or on the right, so one of these halves must occur twice."""
    size = np.array([len(c) for c in contexts], np.int64)
    start, half = np.cumsum(size) - size, (length - k) // 2
    h = Hasher(np.frombuffer(b"".join(contexts), np.uint8))
    out = np.zeros(len(contexts), bool)
    at = start + lo
    for fits, a, z in ((lo >= half, at - half, at + k), (size - lo - k >= half, at, at + k + half)):
        i = np.flatnonzero(fits)
        _, inv, n = np.unique(h.at(a[i], z[i]), return_inverse=True, return_counts=True)
        out[i[n[inv] > 1]] = True
    return np.flatnonzero(out)


def covered(docs: DataFrame, length: int = LENGTH, k: int = K, hot_at: int = HOT) -> DataFrame:
    """(doc_id, a long, z long): byte ranges of docs (doc_id long, text) that an earlier equal window covers; they may overlap."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(f"doc_id is not null and octet_length(text) >= {length}")
    hot, contexts = _hot_anchors(docs, length, k, hot_at)
    reach = length - k

    def scan(batches):
        parts, held = [], 0
        for b in batches:
            for hasher, offs, ids in _chunks(b, length):
                for x in _rows(hasher, offs, ids, hot, length, k):
                    parts.append(x)
                    held += len(x[0])
                if held > HELD:
                    yield from _reduce(parts)
                    parts, held = [], 0
        if parts:
            yield from _reduce(parts)

    def meet(batches):
        parts = []
        for b in batches:
            kind = b.column(0).to_numpy()
            h, ctx, doc, at = (b.column(i).to_numpy() for i in range(1, 5))
            if (kind == 1).any():
                yield from _emit(1, *(x[kind == 1] for x in (h, ctx, doc, at)))
            parts.append(tuple(x[kind == 0] for x in (h, ctx, doc, at)))
        if not parts:
            return
        h, ctx, doc, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        if not len(h):
            return
        order, new = _first_rows(h, ctx, doc, at)
        late, first = order[~new], order[new]
        yield from _emit(1, h[late], ctx[late], doc[late], at[late])
        hf = h[first]
        fresh = np.concatenate(([True], hf[1:] != hf[:-1]))
        n = np.diff(np.concatenate((np.flatnonzero(fresh), [len(hf)])))
        multi = first[np.repeat(n > 1, n)]
        yield from _emit(0, h[multi], ctx[multi], doc[multi], at[multi])

    scanned = docs.mapInArrow(trimmed(scan), ROW)
    dealt = scanned.repartition(partitions_for(spark, contexts, MEET_ROWS), F.when(F.col("kind") == 0, F.col("h")).otherwise(F.xxhash64("doc_id", "at")))
    # what is covered whole, and contexts that share an anchor
    met = written(dealt.mapInArrow(trimmed(meet), ROW), "met")
    pos, lo, hi = F.shiftright("at", 16), F.shiftright("at", 8).bitwiseAND(255), F.col("at").bitwiseAND(255)
    whole = met.where("kind = 1").select("doc_id", (pos - lo).alias("a"), (pos + k + hi).alias("z")).where(f"z - a >= {length}")
    candidates = met.where("kind = 0").select("doc_id", "h", (pos - lo).alias("a"), ((lo + hi + k) * 256 + lo).cast("int").alias("n"))
    n = candidates.count()
    lists = candidates.groupBy("doc_id").agg(F.collect_list(F.struct("h", "a", "n")).alias("c"))

    def cut(batches):
        for b in batches:
            data, offs = buffers(b.column(1))
            data = data.tobytes()
            out = ([], [], [], [], [])
            for i, (doc, c) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                for x in c:
                    a = int(offs[i]) + x["a"]
                    for o, v in zip(out, (doc, x["h"], x["a"], data[a : a + (x["n"] >> 8)], x["n"] & 255), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32()), strict=True)], ["doc_id", "h", "a", "bytes", "lo"])

    def shard(batches):
        held = [(b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(3).to_pylist(), b.column(1).to_numpy(), b.column(4).to_numpy()) for b in batches]
        if not held:
            return
        doc, a, h, lo = (np.concatenate([x[i] for x in held]) for i in (0, 1, 3, 4))
        text = [t for x in held for t in x[2]]
        order = np.argsort(h, kind="stable")
        size = np.cumsum([len(text[i]) for i in order])
        i = 0
        while i < len(order):  # blocks of whole anchors, of about SHARD bytes
            j = min(len(order), int(np.searchsorted(size, (size[i - 1] if i else 0) + SHARD)) + 1)
            while j < len(order) and h[order[j]] == h[order[j - 1]]:
                j += 1
            part = order[i:j]
            part = part[_may_match([text[x] for x in part], lo[part], length, k)]
            own, off = repeats([text[x] for x in part], doc[part], a[part], length)
            own = part[own]
            s = a[own] + off
            by = np.lexsort((s, doc[own]))
            d, s = doc[own][by], s[by]
            if len(s):
                new = np.concatenate(([True], (d[1:] != d[:-1]) | (s[1:] > s[:-1] + length)))
                at = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays([pa.array(d[at]), pa.array(s[at]), pa.array(s[np.concatenate((at[1:], [len(s)])) - 1] + length)], ["doc_id", "a", "z"])
            i = j

    cutting = docs.join(lists, "doc_id").select("doc_id", "text", "c").mapInArrow(cut, "doc_id long, h long, a long, bytes binary, lo int")
    shards = cutting.repartition(partitions_for(spark, n * (length + reach), 8 * SHARD), "h")
    return whole.union(written(shards.mapInArrow(trimmed(shard), "doc_id long, a long, z long"), "matched"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, **hot) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) of each row of docs (doc_id, text).

    A byte is removed if a window of length bytes covers it that also starts earlier (smaller doc_id, or same document and earlier start), overlaps included, judged on the input. A null text is empty; texts shorter than length stay whole; rows with a null doc_id have no place in the order: they stay whole and remove nothing. doc_id is a key: rows that repeat one are cut alike, as one document each. An empty table gives an empty one; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def merge(batches):  # partial: what a task holds of a document's ranges
        for b in batches:
            d, a, z = (b.column(i).to_numpy() for i in range(3))
            by = np.lexsort((a, d))
            d, a, z = d[by], a[by], z[by]
            if not len(d):
                continue
            base = np.cumsum(np.concatenate(([0], d[1:] != d[:-1]))) * (1 << 40)
            top = np.maximum.accumulate(z + base)
            new = np.concatenate(([True], (a + base)[1:] > top[:-1]))
            at = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([pa.array(d[at]), pa.array(a[at]), pa.array((top - base)[np.concatenate((at[1:], [len(d)])) - 1])], ["doc_id", "a", "z"])

    with scratch() as kept:
        lists = covered(docs, length, **hot).mapInArrow(merge, "doc_id long, a long, z long").groupBy("doc_id").agg(F.collect_list(F.struct("a", "z")).alias("r"))
        with arrow_rows(spark, 100_000):
            lists = kept(written(lists, "ranges"))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"

    def cut(batches):
        for b in batches:
            data, offs = buffers(b.column(1))
            rows = []
            for i, (doc, r) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                d = data[offs[i] : offs[i + 1]]
                gone = np.zeros(len(d) + 1, np.int8)
                for x in r or ():
                    gone[x["a"] : x["z"]] = 1
                gone = gone[:-1]
                rows.append((doc, len(d), int(gone.sum()), int((np.diff(np.concatenate(([0], gone))) == 1).sum()), d[gone == 0].tobytes()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return docs.join(lists, "doc_id", "left").select("doc_id", "text", "r").mapInArrow(cut, out)


def op2(spark, sf_dir: str) -> DataFrame:
    """Whole `documents`, windows of 100 bytes; kept_sha256 is the digest of the remaining bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = remove_repeats(docs, LENGTH)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
