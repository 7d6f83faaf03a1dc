"""Quality filter: interpolated modified Kneser-Ney language models of trusted text (operator 3).

The models are over symbols (characters), ORDER at a time, since they must score words of any language that no trusted text has. Nothing of a model reaches the driver or is broadcast whole:

1. Texts become chunks of symbols, one language each, in a written table.
2. A chunk asks for its distinct n-grams in one sorted, compressed row, with their counts in trusted text. Rows are cut by shard of n-grams, and each shard is merged into its distinct n-grams with their counts; lower orders follow as continuation counts.
3. What is asked for is joined, order by order from one symbol up, with the sharded counts, the sums by context and the probability of the next shorter n-gram.
4. A shard answers each chunk with one row of log-probabilities in the order of its requests, without keys.
5. The answers meet their chunk, where each document's -log p is summed.
"""

from __future__ import annotations

import bz2
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import arrow_rows, checked, discard, fresh, give_back, scratch, shuffles_removed, trimmed, written

#: Symbols are of so many bits, an n-gram has ORDER of them; above its bits a key has its model's number.
BITS, ORDER = 10, 5
A, SHIFT = 1 << BITS, BITS * ORDER
CODE = (1 << SHIFT) - 1
#: Models that the bits above fit; the languages beyond, those of least trusted text, are judged by model 0.
MODELS = (1 << (63 - SHIFT)) - 1
#: One trusted document in so many sets thresholds instead of training, so that these are those of texts the models haven't seen.
HELD = 4
#: A document's mean is drawn to its language's median as if it had this many more symbols.
PRIOR = 100
#: Fewer held-out documents than this set no threshold: everything is kept.
LEAST_HELD = 10
#: Rejected: a score (nats per symbol) over this quantile of the held-out trusted documents of its language by more than the margin, since few held-out documents show little of the tail of clean ones.
QUANTILE, SLACK = 0.97, 0.2
BIN = 1000
#: Chunks are kept with bz2, which takes 0.29 of their bytes where zstandard takes 0.34: they are stored once and shuffled once, most of what this operator does to disks.
#: Symbols of a chunk, of all chunks a task holds open, and cells of the table by which a chunk's n-grams are told apart.
CHUNK, OPEN, CELLS = 4 << 20, 12 << 20, 1 << 24
#: Chunks of an Arrow batch.
CHUNK_ROWS = 4
#: Distinct n-grams of a shard and requests that a group of it answers, about; shards there are at least.
SHARD_KEYS, SHARD_REQUESTS, LEAST_SHARDS = 500_000, 4_000_000, 16
#: One code in so many stands for the others when n-grams are counted to choose the number of shards.
SOME = 256
#: Symbols of an n-gram that its shard follows from, in front, so that sorted requests stay dense.
LEAD = 3
#: Keys that a task holds beside twice its distinct ones before it merges them.
TASK_KEYS = 2_000_000
BLOBS = "chunk long, lang string, doc_ids array<long>, th array<long>, sizes array<long>, marks array<int>, n_train long, alphabet binary, blob binary"
SCORES = "doc_id long, th long, lang string, model long, mark int, n long, nlp double"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def _arrow(form: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in form.split(", "))])


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """Code point -> symbol: white space and control characters are 1 as the space is, the rest of ASCII has its own, and all others go round the remaining numbers, so that those within 928 of each other, as the letters of a script are, never share one. 0 is the pad."""
    t = np.arange(0x110000)
    t = np.where(t < 0x20, 1, np.where(t < 0x7F, t - 0x1F, 96 + t % (A - 96)))
    return t.astype(np.uint16)


def symbols(text: str | None) -> np.ndarray:
    return _symbols()[np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)]


def _dense(syms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the symbols that occur, and the pad, ascending; each symbol's place among them)."""
    seen = np.zeros(A, bool)
    seen[syms] = True
    seen[0] = True
    alphabet = np.flatnonzero(seen)
    place = (np.cumsum(seen) - 1).astype(np.uint8 if len(alphabet) <= 256 else np.uint16)
    return alphabet, place[syms]


class Ngrams:
    """The n-gram that ends at each symbol of some documents, pads before each: hi has the places in the alphabet of its first symbols but two, lo those of the last two."""

    def __init__(self, alphabet: np.ndarray, places: np.ndarray, sizes: np.ndarray):
        pad, self.begin = ORDER - 1, np.cumsum(sizes) - sizes
        self.alphabet, self.m = alphabet.astype(np.int64), max(1, len(alphabet))
        at = np.arange(len(places), dtype=np.int32)  # of an n-gram's first symbol, where each document has its pads
        at += np.repeat(np.arange(len(sizes), dtype=np.int32) * pad, sizes)
        c = np.zeros(len(places) + len(sizes) * pad, places.dtype)
        c[at + pad] = places
        self.hi, self.lo = (self._value(c, at, i, j) for i, j in ((0, ORDER - 2), (ORDER - 2, ORDER)))

    def _value(self, c: np.ndarray, at: np.ndarray, i: int, j: int) -> np.ndarray:
        out = np.zeros(len(at), np.uint16 if self.m ** (j - i) <= 1 << 16 else np.int32)
        for k in range(i, j):
            out *= self.m
            out += c[k:][at]
        return out

    def _code(self, value: np.ndarray, n: int) -> np.ndarray:
        """n places as the code of their symbols."""
        out, value = np.zeros(len(value), np.int64), value.astype(np.int64)
        for k in range(n):
            out |= self.alphabet[value % self.m] << (BITS * k)
            value = value // self.m
        return out

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(number of each position's n-gram, ascending distinct codes): by a table of cells, or by sorting where that would be too large."""
        tables = []
        for x, n in ((self.hi, ORDER - 2), (self.lo, 2)):
            most = self.m**n
            if most > CELLS:
                v, r = np.unique(x, return_inverse=True)
                tables.append((v, r.astype(np.int32)))
                continue
            seen = np.zeros(most, bool)
            seen[x] = True
            place = np.cumsum(seen, dtype=np.int32) - 1
            tables.append((np.flatnonzero(seen), place.astype(np.uint16)[x] if len(place) <= 1 << 16 else place[x]))
        (hv, hi), (lv, lo) = tables
        del tables, self.hi, self.lo  # large, and not needed any more
        hc, lc, width = self._code(hv, ORDER - 2) << (2 * BITS), self._code(lv, 2), max(1, len(lv))
        if len(hv) * len(lv) > CELLS:
            pairs, number = np.unique(hi.astype(np.int64) * width + lo, return_inverse=True)
            return number, hc[pairs // width] | lc[pairs % width]
        cell = hi.astype(np.int32)
        cell *= width
        cell += lo
        del hi, lo
        seen = np.zeros(len(hv) * len(lv), bool)
        seen[cell] = True
        full, cells = np.flatnonzero(seen), len(seen)
        del seen
        number = np.zeros(cells, np.uint16 if len(full) <= 1 << 16 else np.int32)
        number[full] = np.arange(len(full), dtype=number.dtype)
        return number[cell], hc[full // width] | lc[full % width]


def packed(x: np.ndarray) -> bytes:
    """A numeric array, its bytes by place and compressed: of sorted codes the upper places are runs."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each n-gram; _shard is the same for a column."""
    return ((codes >> (BITS * (ORDER - LEAD))) * 2654435761 >> 11) % shards


def _shard(key: Column, shards: int) -> Column:
    lead = F.shiftright(key.bitwiseAND(CODE), BITS * (ORDER - LEAD))
    return F.shiftright(lead * F.lit(2654435761), 11) % shards


def chunks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The written table of chunks, from docs (doc_id, lang, text). Marks: 1 trains, 2 sets thresholds, 0 neither; documents of mark 2 have chunks of their own.

    Trusted are the documents that labels calls good (quality 1 and never 0). Labels are broadcast only if counted to be few.
    """
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_good")).agg(F.min("quality").alias("q")).where("q = 1").select("_good")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    docs = docs.join(checked(good, labels.count(), 16), F.col("doc_id") == F.col("_good"), "left")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(HELD))
    docs = docs.select("doc_id", F.xxhash64("text").alias("th"), "lang", F.when(F.col("_good").isNull(), 0).when(fold == 0, 2).otherwise(1).alias("mark"), "text")

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[tuple[str | None, bool], list] = {}
        size: dict[tuple[str | None, bool], int] = {}
        form = _arrow(BLOBS)

        def flush(kind):
            nonlocal number
            rows = held.pop(kind)
            size.pop(kind)
            ids, th, marks, syms = zip(*rows, strict=True)
            number += 1
            alphabet, places = _dense(np.concatenate(syms))
            row = (number - 1, kind[0], ids, th, [len(s) for s in syms], marks, sum(m == 1 for m in marks), alphabet.astype("<u2").tobytes(), bz2.compress(places.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, form.types, strict=True)], schema=form)

        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                for doc, th, lang, mark, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    s = symbols(text)
                    kind = (lang, mark == 2)
                    held.setdefault(kind, []).append((doc, th, mark, s))
                    size[kind] = size.get(kind, 0) + len(s) + 64  # the row's other fields
                    if size[kind] >= CHUNK:
                        yield flush(kind)
                    elif sum(size.values()) >= OPEN:
                        yield flush(max(size, key=size.get))
        for kind in list(held):
            yield flush(kind)

    with arrow_rows(docs.sparkSession):
        return written(docs.mapInArrow(trimmed(run), BLOBS), "chunks")


def _open(row: dict) -> Ngrams:
    alphabet = np.frombuffer(row["alphabet"], "<u2")
    places = np.frombuffer(bz2.decompress(row["blob"]), np.uint8 if len(alphabet) <= 256 else np.uint16)
    return Ngrams(alphabet, places, np.array(row["sizes"], np.int64))


def _rows(batches):
    """The rows of Arrow batches as dictionaries, one at a time."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _cut(cols, names):
    """Columns as record batches of bounded length."""
    for j in range(0, len(cols[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[j : j + 100_000]) for c in cols], names)


def requests(blobs: DataFrame) -> DataFrame:
    """(chunk, model, n, keys, counts, some) as a written table: the number of the distinct n-grams of each chunk, their sorted codes and how often trusted text of the chunk has each, packed (no counts without such text), and those of one code in SOME."""
    form = "chunk long, model long, n long, keys binary, counts binary, some array<long>"

    def run(batches):
        for r in _rows(batches):
            number, codes = _open(r).distinct()
            counts, some = None, codes[shard_of(codes, SOME) == 0].tolist()
            if r["n_train"]:
                own = np.repeat(np.array(r["marks"]) == 1, np.array(r["sizes"], np.int64))
                n = np.zeros(len(codes), np.int64)
                for i in range(0, len(number), 1 << 19):  # a piece at a time, as each is copied as longs
                    n += np.bincount(number[i : i + (1 << 19)][own[i : i + (1 << 19)]], minlength=len(codes))
                counts = packed(n.astype(np.uint32))
            row = {"chunk": r["chunk"], "model": r["model"], "n": len(codes), "keys": packed(codes), "counts": counts, "some": some}
            del number, codes
            give_back()
            yield pa.RecordBatch.from_pylist([row], _arrow(form))

    with arrow_rows(blobs.sparkSession, CHUNK_ROWS):
        return written(blobs.select("chunk", "model", "n_train", "sizes", "marks", "alphabet", "blob").mapInArrow(trimmed(run), form), "requests")


def shards_for(asked: DataFrame) -> int:
    """Shards of about SHARD_KEYS distinct n-grams each, by the exact number of those of one code in SOME."""
    some = asked.select("model", F.explode("some").alias("code")).distinct().count()
    return max(LEAST_SHARDS, -(-some * SOME // SHARD_KEYS))


def _split(asked: DataFrame, shards: int, salts: int) -> DataFrame:
    """(chunk, model, shard, salt, keys, counts): requests cut by shard, and dealt to salts by chunk."""
    form = "chunk long, model long, shard long, salt long, keys binary, counts binary"

    def split(batches):
        for r in _rows(batches):
            codes = unpacked(r["keys"], np.int64)
            at = shard_of(codes, shards)
            by = np.argsort(at, kind="stable")
            codes, at = codes[by], at[by]
            n = unpacked(r["counts"], np.uint32)[by] if r["counts"] is not None else None
            rows = []
            for i, j in _runs(at):
                counts = packed(n[i:j]) if n is not None else None
                rows.append({"chunk": r["chunk"], "model": r["model"], "shard": int(at[i]), "salt": r["chunk"] % salts, "keys": packed(codes[i:j]), "counts": counts})
            yield pa.RecordBatch.from_pylist(rows, _arrow(form))

    return asked.select("chunk", "model", "keys", "counts").mapInArrow(trimmed(split), form)


def counted(asked: DataFrame, shards: int) -> DataFrame:
    """(key, n) as a written table: every n-gram that is asked for, and how often its model's trusted text has it (0: never). A task merges the rows of its shards as they stream past, and holds their distinct n-grams."""

    def merged(held):
        keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
        keys, place = np.unique(keys, return_inverse=True)
        return keys, np.bincount(place, n, len(keys)).astype(np.int64)

    def run(batches):
        held, size = [], 0
        for r in _rows(batches):
            keys = unpacked(r["keys"], np.int64) | r["model"] << SHIFT
            n = np.zeros(len(keys), np.int64) if r["counts"] is None else unpacked(r["counts"], np.uint32).astype(np.int64)
            held.append((keys, n))
            size += len(keys)
            if size >= 2 * len(held[0][0]) + TASK_KEYS:
                held = [merged(held)]
                size = len(held[0][0])
        if held:
            yield from _cut(merged(held), ("key", "n"))

    rows = _split(asked, shards, 1).select("shard", "model", "keys", "counts").repartition(shards, "shard").drop("shard")
    return written(rows.mapInArrow(trimmed(run), "key long, n long"), "counted")


def answers(asked: DataFrame, p: DataFrame, shards: int, salts: int) -> DataFrame:
    """(chunk, shard, logp): for each chunk and shard of n-grams the log-probabilities, packed, of the chunk's requests there in ascending order. p is (key, logp); a shard's requests are dealt to salts groups by chunk."""
    back = "chunk long, shard long, logp binary"

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        key, logp = right.column("key").to_numpy(), right.column("logp").to_numpy()
        by = np.argsort(key)
        key, logp = key[by], logp[by].astype(np.float32)
        out = []
        for r in left.to_pylist():
            own = unpacked(r["keys"], np.int64) | r["model"] << SHIFT
            out.append({"chunk": r["chunk"], "shard": r["shard"], "logp": packed(logp[np.searchsorted(key, own)])})
        return pa.Table.from_pylist(out, _arrow(back))

    by = ("shard", "salt")
    left = _split(asked.withColumn("counts", F.lit(None).cast("binary")), shards, salts).drop("counts")
    right = p.select("key", "logp", _shard(F.col("key"), shards).alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(look_up, back)


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the runs of equal values."""
    if not len(x):
        return []
    cut = np.flatnonzero(x[1:] != x[:-1]) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(x)], strict=True))


def _keep(key: Column, n: int) -> Column:
    """The key of an n-gram's last n symbols."""
    return key.bitwiseAND(~CODE | (1 << (BITS * n)) - 1)


def _context(key: Column) -> Column:
    """The key of an n-gram without its last symbol; also has the model."""
    return key.bitwiseAND(~CODE).bitwiseOR(F.shiftright(key.bitwiseAND(CODE), BITS))


def log_probabilities(counts: DataFrame, wanted: DataFrame, models: int, order: int = ORDER) -> DataFrame:
    """(key, logp float) of each key of wanted (distinct) under the interpolated modified Kneser-Ney model of counts (key, n).

    Discounts D1, D2 and D3+ come from each order's and model's counts of counts; below the top order counts are those of distinct symbols before the n-gram; the end is uniform. A context that was never seen passes on the probability of the shorter n-gram. Keys of a join are n-grams or contexts: at most A requests share one.
    """
    levels, asked = {order: counts}, {order: wanted}
    for n in range(order - 1, 0, -1):
        levels[n] = written(levels[n + 1].groupBy(_keep(F.col("key"), n).alias("key")).agg(F.count("*").alias("n")), f"level{n}")
        asked[n] = written(asked[n + 1].select(_keep(F.col("key"), n).alias("key")).distinct(), f"asked{n}")
    p = None
    for n in range(1, order + 1):
        times = [F.sum(F.when(F.col("n") == i, 1).otherwise(0)).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]
        d = levels[n].groupBy(F.shiftright("key", SHIFT).alias("model")).agg(*times)
        y = F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(F.lit(0.5))
        cut = lambda i: F.when(F.col(f"n{i}") > 0, F.least(F.greatest(F.lit(float(i)) - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(0.05)), F.lit(i - 0.05))).otherwise(F.lit(0.5))
        d = d.select("model", F.array(*[cut(i) for i in (1, 2, 3)]).alias("d"))
        c = levels[n].withColumn("model", F.shiftright("key", SHIFT)).join(checked(d, models, 64), "model")
        c = c.select("key", "n", F.element_at("d", F.least("n", F.lit(3)).cast("int")).alias("d"))
        contexts = c.groupBy(_context(F.col("key")).alias("context")).agg(F.sum("n").cast("double").alias("total"), F.sum("d").alias("spare"))
        q = asked[n].join(c, "key", "left").withColumn("context", _context(F.col("key"))).join(contexts, "context", "left")
        if p is None:
            q = q.withColumn("low", F.lit(1 / A))
        else:
            q = q.withColumn("short", _keep(F.col("key"), n - 1)).join(p.select(F.col("key").alias("short"), F.col("p").alias("low")), "short")
        seen = F.greatest(F.coalesce(F.col("n") - F.col("d"), F.lit(0.0)), F.lit(0.0))
        low = p
        p = written(q.select("key", F.when(F.col("total") > 0, (seen + F.col("spare") * F.col("low")) / F.col("total")).otherwise(F.col("low")).alias("p")), f"p{n}")
        for t in (levels[n], asked[n]) if n < order else ():
            discard(t)
        if low is not None:
            discard(low)
    out = p.select("key", F.log("p").cast("float").alias("logp"))
    out._trivex_path = p._trivex_path
    return out


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, th, lang, model, mark, n, nlp) per row of docs (doc_id, lang, text): symbols and the sum of their -log p; th is the text's hash."""
    return all_scores(docs, labels).where("mark < 3")


def all_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """scores() and, where a row without a language is judged by model 0, the held-out documents of other models again, under model 0, with mark 3."""
    with shuffles_removed(docs.sparkSession):
        return _all_scores(docs, labels)


def _all_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    blobs = chunks(docs, labels)
    langs = blobs.groupBy("lang").agg(F.sum("n_train").alias("n")).where(F.col("lang").isNotNull() & (F.col("n") > 0))
    number = F.row_number().over(Window.orderBy(F.desc("n"), "lang"))  # a row per language
    langs = written(langs.select(F.col("lang").alias("_lang"), number.cast("long").alias("model")).where(F.col("model") <= MODELS), "models")
    models = langs.count() + 1
    table = blobs
    blobs = blobs.join(checked(langs, models, 64), F.col("lang") == F.col("_lang"), "left").withColumn("model", F.coalesce("model", F.lit(0).cast("long"))).drop("_lang")
    pooled = not blobs.where("model = 0").isEmpty()
    if not blobs.where("lang is null").isEmpty():
        again = blobs.where((F.col("model") > 0) & (F.element_at("marks", 1) == 2))
        again = again.withColumn("chunk", -1 - F.col("chunk")).withColumn("model", F.lit(0).cast("long")).withColumn("marks", F.transform("marks", lambda m: F.lit(3)))
        blobs = blobs.unionByName(again)
    asked = requests(blobs)
    shards = shards_for(asked)
    total = asked.agg(F.sum("n")).first()[0] or 0
    keys = counted(asked, shards)
    counts = keys.where("n > 0")
    if pooled:
        counts = counts.where(F.col("key") > CODE).union(counts.groupBy(F.col("key").bitwiseAND(CODE).alias("key")).agg(F.sum("n").alias("n")))
    p = log_probabilities(counts, keys.select("key"), models)
    salts = max(1, -(-total // (shards * SHARD_REQUESTS)))
    # written, so that what they are made of is gone before the chunks are shuffled
    found = written(answers(asked, p, shards, salts), "answers")
    for t in (asked, keys, p):
        discard(t)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        form, out = _arrow(SCORES), []
        logps = dict(zip(right.column("shard").to_pylist(), right.column("logp").to_pylist(), strict=True))
        for row in _rows(left.to_batches()):
            g = _open(row)
            place, codes = g.distinct()
            logp, at = np.zeros(len(codes), np.float32), shard_of(codes, shards)
            for shard, data in logps.items():
                logp[at == shard] = unpacked(data, np.float32)
            sums = np.zeros(len(place) + 1)
            np.cumsum(logp[place], out=sums[1:])
            sizes = np.array(row["sizes"], np.int64)
            k, nlp = len(sizes), sums[g.begin] - sums[g.begin + sizes]
            cols = (row["doc_ids"], row["th"], [row["lang"]] * k, [row["model"]] * k, row["marks"], sizes, nlp)
            out.append(pa.table([pa.array(c, t) for c, t in zip(cols, form.types, strict=True)], schema=form))
            del g, place, codes, logp, at, sums
        give_back()
        return pa.concat_tables(out) if out else form.empty_table()

    left = blobs.select("chunk", "lang", "model", "doc_ids", "th", "sizes", "marks", "alphabet", "blob").groupBy("chunk")
    out = written(left.cogroup(found.groupBy("chunk")).applyInArrow(meet, SCORES), "scores")
    for t in (table, langs, found):
        discard(t)
    return out


def thresholds(scored: DataFrame, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """(model, lang, mid, top) of the languages with LEAST_HELD held-out documents or more that are not empty, under the model that judges them; a null language has those of all held-out documents under model 0.

    mid is the median of their symbols' documents' mean -log p; top the quantile of their scores, which are their means drawn to mid, and slack. Both are from exact counts in bins of 1 / BIN nats, so what is grouped is bounded.
    """
    held = scored.where((F.col("mark") >= 2) & (F.col("n") > 0))
    own = held.where("mark = 2 and lang is not null")
    rows = own.union(held.where("model = 0").withColumn("lang", F.lit(None).cast("string"))).select("model", "lang", "n", "nlp")

    def at(bins: DataFrame, weight: str, q: float, name: str) -> DataFrame:
        each = Window.partitionBy("model", "lang")
        share = F.sum(weight).over(each.orderBy("bin")) / F.sum(weight).over(each)
        bins = bins.withColumn("share", share).withColumn("held", F.sum("k").over(each)).where((F.col("share") >= q - 1e-12) & (F.col("held") >= LEAST_HELD))
        return bins.groupBy("model", "lang").agg((F.min("bin") / F.lit(float(BIN))).alias(name))

    def binned(rows: DataFrame, value: Column) -> DataFrame:
        return rows.groupBy("model", "lang", F.ceil(value * BIN).cast("int").alias("bin")).agg(F.count("*").alias("k"), F.sum("n").alias("w"))

    mid = at(binned(rows, F.col("nlp") / F.col("n")), "w", 0.5, "mid").select(F.col("model").alias("_m"), F.col("lang").alias("_l"), "mid")
    drawn = rows.join(mid, (F.col("model") == F.col("_m")) & F.col("lang").eqNullSafe(F.col("_l")))
    top = at(binned(drawn, score(F.col("nlp"), F.col("n"), F.col("mid"))), "k", quantile, "top").withColumn("top", F.col("top") + F.lit(slack))
    return mid.join(top, (F.col("model") == F.col("_m")) & F.col("lang").eqNullSafe(F.col("_l"))).select("model", "lang", "mid", "top")


def score(nlp: Column, n: Column, mid: Column) -> Column:
    """Mean -log p of n symbols and PRIOR more of the median."""
    return (nlp + PRIOR * mid) / (n + PRIOR)


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """(doc_id, th, lang, perplexity, threshold, kept) per row of docs; cases as for judge()."""
    s = all_scores(docs.select("doc_id", "lang", "text"), labels)
    limits = written(thresholds(s, quantile, slack).select(F.col("model").alias("_model"), F.col("lang").alias("_lang"), "mid", "top"), "limits")
    same = (F.col("model") == F.col("_model")) & F.col("lang").eqNullSafe(F.col("_lang"))
    s = s.where("mark < 3").join(checked(limits, limits.count(), 64), same, "left")
    mean = F.when(F.col("n") > 0, F.when(F.col("mid").isNull(), F.col("nlp") / F.col("n")).otherwise(score(F.col("nlp"), F.col("n"), F.col("mid"))))
    s = s.withColumn("mean", mean)
    return s.select("doc_id", "th", "lang", F.exp("mean").alias("perplexity"), F.when(F.col("mean").isNotNull(), F.exp("top")).alias("threshold"), F.coalesce(F.col("mean") <= F.col("top"), F.lit(True)).alias("kept"))


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, keep_only: bool = False) -> DataFrame:
    """docs with perplexity, threshold and kept added unless docs has columns of these names (or, with keep_only, just the rows kept, with the columns of docs).

    Perplexity is exp of the mean -log p per symbol under the model of the row's lang (no trusted document to train with, or null: of all trusted text), drawn to the language's median by PRIOR symbols so that short texts aren't judged by chance. Each language has a threshold of its own, under the model that judges it; one with fewer than LEAST_HELD held-out documents has none, its perplexity is not drawn, and its rows are kept. A null or empty text has null perplexity and is kept, as is everything when nothing is trusted: no evidence rejects nothing. Repeated rows are judged alike; a text of any length is scored whole; an empty table gives an empty one.
    """
    with scratch() as kept:
        found = kept(written(judged(docs, labels, quantile, slack), "judged"))
    keys = {"doc_id": F.col("doc_id").cast("long"), "th": F.xxhash64(F.col("text").cast("string")), "lang": F.col("lang").cast("string")}
    names = ("perplexity", "threshold", "kept")
    other = dict(zip((*keys, *names), fresh(docs, *keys, *names), strict=True))
    same = F.lit(True)
    for k, v in keys.items():
        same = same & v.eqNullSafe(F.col(other[k]))
    if keep_only:
        gone = found.where("not kept").select(*[F.col(k).alias(other[k]) for k in keys]).distinct()
        return docs.join(checked(gone, found.where("not kept").count(), 48), same, "left_anti")
    per = found.groupBy(*keys).agg(*[F.first(k).alias(k) for k in names])
    per = per.select(*[F.col(k).alias(other[k]) for k in (*keys, *names)])
    return docs.join(checked(per, found.count(), 72), same, "left").select(*docs.columns, *[F.col(other[k]).alias(k) for k in names if k not in docs.columns])


def op3(spark, sf_dir: str) -> DataFrame:
    """Whole `documents`, trusted text from `labels`: the documents kept, with perplexity and threshold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judged(docs, labels).where("kept").select("doc_id", "lang", "perplexity", "threshold")
