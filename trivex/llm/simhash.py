"""SimHash near-duplicates with deletion-variant signatures (operator 4), and the pipeline's near-duplicates by Jaccard similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import buffers, checked, fresh, give_back, partitions_for, scratch, small_batches, trimmed, written
from .components import components

#: A bucket of more members than this is linked by wildcard cliques instead of by pairs; a task makes the cliques' rows of so many members, about.
PAIRS_UP_TO, HOT_ROWS = 64, 2000
#: Leads of a full bucket that all its members are compared with at a time, and times at most.
LEADS, ROUNDS = 8, 4
#: Members of a block that meets another one.
BLOCK = 2048
#: A shingle is common if at least COMMON documents of one in SAMPLE have it; at most so many are noted.
SAMPLE, COMMON, MOST_COMMON = 4, 2, 300_000
#: Bits of a set's parities.
BITS = 512


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of width words, in their order, space-joined; fewer words are one run."""
    h, s = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= width:
        return np.array([h(s, 42)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start = (end - size + 1)[: len(words) - width + 1].tolist()
    return np.array([h(s[a:b], 42) for a, b in zip(start, end[width - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes, width: int) -> int:
    """SimHash of the shingles of width words, repeats included: a bit is set if it is in over half of their XXH64 (seed 42)."""
    words = text.lower().split()  # bytes: A-Z and the six ASCII white spaces only
    if not words:
        return 0
    hashes = _hashes(words, width)
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; none, if there are none."""
    if len(hashes) == 1:
        return int(hashes[0])
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[i : i + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fp long) of each row; the fingerprint's 64 bits as a signed long. A null or wordless text has 0."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            data, offs = buffers(b.column(1))
            data = data.tobytes()
            fp = np.array([fingerprint(data[a:z], width) for a, z in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), "doc_id long, fp long")


def _masks(diff: int) -> list[int]:
    """All masks of diff wildcard bits out of 64, as signed longs to AND with."""
    from itertools import combinations

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(((1 << 64) - 1) ^ sum(1 << i for i in c)) for c in combinations(range(64), diff)]


def links(fps: DataFrame, max_diff: int = 2) -> DataFrame:
    """Edges (a, b) over distinct fingerprints that connect exactly those that a chain of differences of at most max_diff bits connects.

    max_diff + 1 differing bits cannot all miss: cut into max_diff // 2 + 1 segments, one of them differs by at most one bit, so two such fingerprints share one of its one-wildcard variants. Buckets of up to PAIRS_UP_TO members are joined with themselves and verified. Members of a fuller bucket are indexed by every choice of max_diff wildcard bits instead: such a group differs in those bits only, so it is a clique of at most 2 ** max_diff members, and no bucket is ever paired out.
    """
    if max_diff > 2:
        raise ValueError("max_diff above 2 is not supported")
    parts = max_diff // 2 + 1
    cuts = [64 * i // parts for i in range(parts + 1)]
    variants = []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        for i in range(lo, hi):
            m = ((1 << hi) - (1 << lo)) & ~(1 << i)
            variants.append((i, m - (1 << 64) if m >> 63 else m))
    table = F.array(*[F.struct(F.lit(i).cast("int").alias("i"), F.lit(m).cast("long").alias("m")) for i, m in variants])
    v = fps.select("fp", F.explode(table).alias("v")).select("fp", F.col("v.i").alias("i"), F.col("fp").bitwiseAND(F.col("v.m")).alias("key"))
    full = v.groupBy("i", "key").agg(F.count("*").alias("n")).where("n > 1")
    # Spark takes the variants for as few as the fingerprints, and would send them through the driver
    v = written(v.hint("merge").join(full.hint("merge"), ["i", "key"]), "variants")
    few = v.where(F.col("n") <= PAIRS_UP_TO).select("i", "key", "fp")
    near = few.select("i", "key", F.col("fp").alias("a")).join(few.select("i", "key", F.col("fp").alias("b")), ["i", "key"])
    near = near.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_diff)).select("a", "b")
    hot = v.where(F.col("n") > PAIRS_UP_TO).select("fp").distinct()
    masks = F.array(*[F.lit(m) for m in _masks(max_diff)])
    clique = hot.repartition(partitions_for(fps.sparkSession, hot.count(), HOT_ROWS), "fp").select("fp", F.posexplode(masks).alias("k", "m"))
    clique = clique.groupBy("k", F.col("fp").bitwiseAND(F.col("m")).alias("key")).agg(F.min("fp").alias("a"), F.collect_set("fp").alias("fps"))
    clique = clique.where(F.size("fps") > 1).select("a", F.explode("fps").alias("b")).where("a <> b")
    return near.union(clique).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, max_diff: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of each row of docs.

    Documents whose fingerprints a chain of differences of at most max_diff bits connects have one component_id, the smallest doc_id among them. Null or wordless texts have fingerprint zero and link like any other; a null doc_id stays null and never is a component_id unless alone. Repeated rows are returned as often as they came; an empty table gives an empty one; other columns are not read.
    """
    with scratch() as kept:
        fp = kept(written(fingerprints(docs, width), "fingerprints"))
        distinct = written(fp.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
        comp = components(links(distinct.select("fp"), max_diff))
        rooted = distinct.join(comp.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
        low = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
        classes = kept(written(rooted.join(low, "root").select("fp", "component_id"), "classes"))
    return fp.join(checked(classes, classes.count(), 96), "fp").select("doc_id", "fp", "component_id")


def shingles(text: bytes, width: int) -> np.ndarray:
    """The ascending distinct XXH64 (seed 42) of a text's shingles of width words, as signed longs; fewer words are one shingle, no words none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    return np.unique(_hashes(words, width).view(np.int64))


def _set_hash(keys: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(keys.tobytes(), 7)).astype(np.int64)) if len(keys) else 0


def parities(keys: np.ndarray) -> np.ndarray:
    """BITS bits, as longs: whether a set has an odd number of shingles of each residue. Two sets' bits differ in no more places than the sets have shingles that the other lacks."""
    odd = np.bincount(keys & (BITS - 1), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _of_shingles(docs: DataFrame, width: int, make, schema: str) -> DataFrame:
    """The columns that make(doc_ids, text hashes, shingles of each) gives for each batch of docs."""
    small_batches(docs.sparkSession)
    kinds = {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*[x.split() for x in schema.split(", ")], strict=True)

    def run(batches):
        for b in batches:
            data, offs = buffers(b.column(2))
            data = data.tobytes()
            sets = [shingles(data[a:z], width) for a, z in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(make(b.column(0), b.column(1), sets), types, strict=True)], list(names))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), schema)


def common_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """Shingles that are common, ascending: those in at least COMMON documents of one in SAMPLE. They only order the shingles, so missing one costs time and no pair."""
    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE)) == 0)
    keys = _of_shingles(some, width, lambda ids, th, sets: [np.concatenate([*sets, np.zeros(0, np.int64)])], "key long")
    top = keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "key").limit(MOST_COMMON)
    out = np.sort(top.select("key").toArrow().column("key").to_numpy())  # at most MOST_COMMON numbers
    give_back()
    return out


def _alike(na, nb, least: float):
    """Whether sets of these sizes can have the similarity."""
    return F.least(na, nb) >= F.greatest(na, nb) * least - 1e-9


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (a, b) of shingle sets whose Jaccard similarity is at least least, by the sets themselves, after those that the sets' parities rule out. nodes: (h, th, n, bits), a text, size and parities of each set."""
    bits = lambda x: nodes.select(F.col("h").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}"))
    apart = F.aggregate(F.zip_with("ba", "bb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    pairs = pairs.join(bits("a"), "a").join(bits("b"), "b").where(apart <= (F.col("na") + F.col("nb")) * ((1 - least) / (1 + least)) + 1e-6)
    pairs = written(pairs.select("a", "b"), "candidates")
    used = pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct()
    texts = written(nodes.join(used, "h", "left_semi").select("th").distinct(), "texts")
    (th,) = fresh(docs, "th")
    rows = docs.join(checked(texts.withColumnRenamed("th", th), texts.count(), 24), F.xxhash64(F.col("text").cast("string")) == F.col(th), "left_semi")
    sets = _of_shingles(rows, width, lambda ids, th, sets: [[_set_hash(s) for s in sets], sets], "h long, keys array<long>")
    sets = written(sets.dropDuplicates(["h"]), "sets")
    n, size = sets.agg(F.count("*"), F.sum(F.size("keys"))).first()
    side = lambda x: checked(sets.select(F.col("h").alias(x), F.col("keys").alias(f"k{x}")), n * 24 + (size or 0) * 8, 1)
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.select("a", "b", F.size(F.array_intersect("ka", "kb")).alias("same"), (F.size("ka") + F.size("kb")).alias("sum"))
    return written(both.where(F.col("same") >= (F.col("sum") - F.col("same")) * least - 1e-9).select("a", "b"), "near")


def by_simhash(nodes: DataFrame, max_diff: int = 2) -> DataFrame:
    """(a, na, b, nb): sets whose SimHashes, fp, a chain of differences of at most max_diff bits connects are connected by these pairs of sets. nodes: (h, n, fp)."""
    firsts = written(nodes.groupBy("fp").agg(F.min(F.struct("h", "n")).alias("x")).select("fp", F.col("x.h").alias("h"), F.col("x.n").alias("n")), "firsts")
    side = lambda t, x: t.select(F.col("fp").alias(f"f{x}"), F.col("h").alias(x), F.col("n").alias(f"n{x}"))
    same = side(firsts, "a").join(side(nodes, "b"), F.col("fa") == F.col("fb")).where("a <> b")
    near = links(firsts.select("fp"), max_diff).toDF("fa", "fb").join(side(firsts, "a"), "fa").join(side(firsts, "b"), "fb")
    return same.select("a", "na", "b", "nb").union(near.select("a", "na", "b", "nb"))


def _led(many: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, least: float, pair) -> DataFrame:
    """(a, b): near pairs of the members (key, h, n, pos, hots) of full buckets with LEADS of each bucket at a time, next those of members that no lead was like, while a round connects half of them."""
    edges, rest, left = None, many.select("key", "h", "n", "hots"), many.count()
    for _ in range(ROUNDS):
        if not left:
            break
        rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("hots"), F.desc("n"), F.desc("h")))
        leads = written(rest.withColumn("_r", rank).where(F.col("_r") <= LEADS).select("key", F.col("h").alias("b"), F.col("n").alias("nb")), "leads")
        few = checked(leads, leads.count(), 32)
        pairs = pair(many.select("key", F.col("h").alias("a"), F.col("n").alias("na")).join(few, "key"))
        found = verified(written(pairs, "pairs"), docs, nodes, width, least)
        edges = found if edges is None else edges.union(found)
        both = found.select("a", "b").union(found.select("b", "a"))
        done = leads.select("key", F.col("b").alias("h")).union(leads.join(both, "b").select("key", F.col("a").alias("h"))).distinct()
        rest = written(rest.join(done, ["key", "h"], "left_anti"), "rest")
        before, left = left, rest.count()
        if 2 * left > before:
            break
    return many.sparkSession.createDataFrame([], "a long, b long") if edges is None else edges


def _unconnected(groups: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(a, b): the pairs of members (g, main, h, root) of a group, one of another root than main and both of different roots, that sizes and parities allow to be similar.

    Such members share a shingle, most of whose documents are common, and yet no lead connects them; each has to be held against the others. Blocks of BLOCK of them meet in tasks, as bits, and only what passes becomes a row. The work for such members still grows with the square of their number.
    """
    bits = groups.join(nodes.select("h", "n", "bits"), "h")
    parts = groups.groupBy("g").agg(F.ceil(F.sum((F.col("root") != F.col("main")).cast("long")) / BLOCK).cast("long").alias("pa"), F.ceil(F.count("*") / BLOCK).cast("long").alias("pb"))
    parts = parts.where("pa > 0")
    rows = written(bits.join(checked(parts, parts.count(), 32), "g"), "blocks")
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("h"), F.col(c))
    left = rows.where("root <> main").select("g", "h", "root", "n", "bits", own("pa").alias("i"), each("pb").alias("j"))
    right = rows.select("g", "h", "root", "n", "bits", own("pb").alias("j"), each("pa").alias("i"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [np.zeros((2, 0), np.int64)]
        if a.num_rows and b.num_rows:
            (ha, ra, na), (hb, rb, nb) = ([t.column(c).to_numpy() for c in ("h", "root", "n")] for t in (a, b))
            ba, bb = (t.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(t.num_rows, -1) for t in (a, b))
            for k in range(a.num_rows):
                apart = np.bitwise_count(bb ^ ba[k]).sum(1, dtype=np.int64)
                fits = np.minimum(nb, na[k]) >= np.maximum(nb, na[k]) * least - 1e-9
                ok = np.flatnonzero((apart <= (nb + na[k]) * ((1 - least) / (1 + least)) + 1e-6) & fits & (rb != ra[k]))
                out.append(np.stack([np.minimum(hb[ok], ha[k]), np.maximum(hb[ok], ha[k])]))
        got = np.concatenate(out, axis=1)
        return pa.table({"a": pa.array(got[0]), "b": pa.array(got[1])})

    by = ("g", "i", "j")
    return written(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, "a long, b long").distinct(), "pairs")


def similar(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of each row of docs: documents that a chain of Jaccard similarities of at least least connects, over their sets of shingles of width words, have one component_id, the smallest doc_id among them.

    Exact. SimHashes of the sets that differ by two bits at most give the first pairs, by deletion variants; they are verified by the sets. 64 bits can't find the others: at 0.8 they differ by 10 bits on average and by up to 19, for which segments would have 6 bits. For those, shingles are ordered alike in all documents, common ones last and else by hash; two sets of that similarity share one of their first n - ceil(least * n) + 1 shingles. The documents that share one are compared in full. Of a bucket of more than PAIRS_UP_TO members, all are compared with a few leads, those that have most common shingles, then with leads of those that were like none; only members that this leaves unconnected are held against the others, as bits, in blocks: what is connected needs no more pairs.
    """
    common = common_shingles(docs, width)

    def make(ids, th, sets):
        hots, heads = [], []
        for s in sets:
            k = len(s) - int(np.ceil(len(s) * least - 1e-9)) + 1 if len(s) else 0
            at = np.searchsorted(common, s)
            late = (at < len(common)) & (common[np.minimum(at, len(common) - 1)] == s) if len(common) else np.zeros(len(s), bool)
            hots.append(int(late.sum()))
            heads.append(np.concatenate((s[~late], s[late]))[:k])
        return ids, th, [_set_hash(s) for s in sets], [len(s) for s in sets], hots, heads, [parities(s) for s in sets], np.array([_majority(s.view(np.uint64)) for s in sets], np.uint64).view(np.int64)

    found = written(_of_shingles(docs, width, make, "doc_id long, th long, h long, n int, hots int, head array<long>, bits array<long>, fp long"), "heads")
    nodes = written(found.groupBy("h").agg(F.min("doc_id").alias("first"), F.min("th").alias("th"), F.min("n").alias("n"), F.min("bits").alias("bits"), F.min("fp").alias("fp")), "nodes")
    v = found.select("h", "n", "hots", F.posexplode("head").alias("pos", "key"))
    # a bucket that repeats one set only is taken for several here and falls away below
    shared = written(v.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("key"), "shared")
    v = written(v.join(checked(shared, shared.count(), 16), "key").distinct(), "members")
    full = written(v.groupBy("key").agg(F.count("*").alias("m")), "buckets")
    v = v.join(checked(full, full.count(), 16), "key")
    cols = lambda x: [F.col("key"), F.col("h").alias(x), F.col("n").alias(f"n{x}"), F.col("pos").alias(f"p{x}")]
    # what the sets can share from their first common shingle on
    reach = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= (F.col("na") + F.col("nb")) * (least / (1 + least)) - 1e-6
    pair = lambda t: t.where(_alike(F.col("na"), F.col("nb"), least)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    few, many = v.where(F.col("m") <= PAIRS_UP_TO), v.where(F.col("m") > PAIRS_UP_TO)
    near = pair(few.select(*cols("a")).join(few.select(*cols("b")), "key").where("a < b").where(reach))
    near = near.union(pair(by_simhash(nodes))).distinct()
    near = verified(written(near, "pairs"), docs, nodes, width, least)
    many = written(many.select("key", "h", "n", "pos", "hots"), "many")
    near = near.union(_led(many, docs, nodes, width, least, pair))
    comp = components(near)
    # what of a full bucket its leads leave unconnected
    roots = comp.select(F.col("node").alias("_node"), "root")
    held = many.join(roots, F.col("h") == F.col("_node"), "left").withColumn("root", F.coalesce("root", "h")).drop("_node")
    top = held.groupBy("key").agg(F.max(F.struct("hots", "n", "h", "root")).alias("top")).select("key", F.col("top.h").alias("g"), F.col("top.root").alias("main"))
    groups = written(held.join(checked(top, full.count(), 32), "key").select("g", "main", "h", "root").distinct(), "groups")
    if not groups.where("root <> main").isEmpty():
        comp = components(near.union(verified(_unconnected(groups, nodes, least), docs, nodes, width, least)))
    rooted = nodes.join(comp.select(F.col("node").alias("h"), "root"), "h", "left").select("h", "first", F.coalesce("root", "h").alias("root"))
    low = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = written(rooted.join(low, "root").select("h", "component_id"), "classes")
    return found.select("doc_id", "h").join(checked(classes, classes.count(), 24), "h").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of docs that no earlier row of their group precedes: of each group of similar() the rows with the smallest doc_id stay, with all columns. Rows with a null doc_id stay."""
    (name,) = fresh(docs, "gone")
    with scratch() as kept:
        groups = similar(docs, width, least)
        gone = kept(written(groups.where("doc_id > component_id").select(F.col("doc_id").alias(name)).distinct(), "gone"))
    return docs.join(checked(gone, gone.count(), 16), F.col("doc_id").cast("long") == F.col(name), "left_anti")


def op4(spark, sf_dir: str) -> DataFrame:
    """Whole `documents`: 3-word shingles, links at two bits or fewer."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_duplicates(docs, 3, 2)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
