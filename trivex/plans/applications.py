"""Whole applications: warm-up baselines, detectors against prototypes, payload drill-down, rule selection, recall by algebra, memory of models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import Space
from ..functions import vectors as vec
from ..functions.atoms import atom_rows, atom_vector
from ..functions.similarity import cosine
from ..operators import aggregate as agg, match
from ..operators.engrams import Library
from ..operators.ordered import matrix, numbered, streamed
from ..operators.subspace import learn, score
from ..sources.encode import listed
from . import pipelines as pipe


# warm-up

def running_similarity(stream: DataFrame, order: str, v: str, dims: int, skip: int = 100) -> DataFrame:
    """(seq, sim): cosine of each vector past the first skip and the signs of the sum of all vectors up to and with it.

    The stream is dealt by ranges of its order: sums of ranges are added up first, component by component, and each range then streams past from the sum before it.
    """
    d = numbered(stream.select(order, F.col(v).cast("array<double>").alias("_v")), order).select("seq", F.col("_v").alias("v"))
    per = max(1, -(-d.count() // int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    d = d.withColumn("r", F.floor(F.col("seq") / per))
    sums = agg.vector_sums(d, ["r"], "v", dims).select("r", F.posexplode("sums").alias("i", "x"))
    before = F.sum("x").over(Window.partitionBy("i").orderBy("r").rowsBetween(Window.unboundedPreceding, -1))
    base = sums.select("r", "i", F.coalesce(before, F.lit(0.0)).alias("x")).groupBy("r").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    rows = base.select("r", F.lit(-1).cast("long").alias("seq"), "v").union(d.select("r", "seq", "v"))

    def feed(state, b):
        m, seq = matrix(b.column("v")), b.column("seq").to_numpy()
        if seq[0] < 0:
            state["sum"], m, seq = m[0], m[1:], seq[1:]
        if not len(m):
            return None
        total = state["sum"] + np.cumsum(m, 0)
        state["sum"] = total[-1]
        signs = np.sign(total)
        size = np.sqrt((signs * signs).sum(1)) * np.sqrt((m * m).sum(1))
        sim = np.divide((signs * m).sum(1), size, out=np.zeros(len(m)), where=size > 1e-10)
        keep = seq >= skip
        return pa.RecordBatch.from_arrays([pa.array(seq[keep]), pa.array(sim[keep])], ["seq", "sim"])

    return streamed(rows, ["r"], "seq", "seq long, sim double", dict, feed)


def warm_up_baseline(stream: DataFrame, order: str, v: str, dims: int, skip: int = 100) -> DataFrame:
    """The frozen baseline (sim_mean, sim_std) of a warm-up: of each vector's similarity to what was seen by then."""
    return pipe.frozen_baseline(running_similarity(stream, order, v, dims, skip), ["sim"])


# detectors against prototypes known beforehand, one row of few vectors

def projection_detector(rows: DataFrame, v: Column, baseline: Column, attacks: list[Column]) -> DataFrame:
    """rows with disagreement, base_sim, attack_share and anomalous: over 6 % of active components disagree with the baseline, or it is unlike (< 0.4) and lies in the attacks' subspace by over 0.6 of its length."""
    profile = vec.similarity_profile(v, baseline)
    inside = vec.norm(vec.project(v, attacks, True)) / (vec.norm(v) + 1e-10)
    d = rows.select("*", pipe.disagreement(profile).alias("disagreement"), cosine(v, baseline).alias("base_sim"), inside.alias("attack_share"))
    return d.withColumn("anomalous", (F.col("disagreement") > 0.06) | ((F.col("base_sim") < 0.4) & (F.col("attack_share") > 0.6)))


def variant_detector(rows: DataFrame, v: Column, baseline: Column, variants: list[Column], low: float = 0.5, high: float = 0.6) -> DataFrame:
    """rows with base_sim, variant_sim (the largest) and anomalous: unlike the baseline, or like a variant."""
    best = F.greatest(*[cosine(v, x) for x in variants]) if len(variants) > 1 else cosine(v, variants[0])
    d = rows.select("*", cosine(v, baseline).alias("base_sim"), best.alias("variant_sim"))
    return d.withColumn("anomalous", (F.col("base_sim") < low) | (F.col("variant_sim") > high))


# similar intensity

def tier_similarity(rows: DataFrame, tier: str, v: str, dims: int) -> DataFrame:
    """(a, b, mean): mean cosine of the pairs within a tier (a = b; 0 without pairs) and between two tiers, a < b.

    From the sums of unit vectors: the sum of all products of two tiers is the product of their sums, so no rows are paired.
    """
    unit = rows.select(F.col(tier).alias("t"), vec.normalized(F.col(v)).alias("u"), (vec.nnz(F.col(v)) > 0).cast("double").alias("active"))
    sums = agg.vector_sums(unit, ["t"], "u", dims).join(unit.groupBy("t").agg(F.sum("active").alias("active")), "t")
    a, b = (sums.select(*[F.col(c).alias(f"{c}{x}") for c in ("t", "sums", "n", "active")]) for x in "ab")
    both = a.join(F.broadcast(b), F.col("ta") <= F.col("tb"))  # a row per tier on each side
    dot = F.aggregate(F.zip_with("sumsa", "sumsb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    within = F.when(F.col("na") < 2, F.lit(0.0)).otherwise((dot - F.col("activea")) / (F.col("na") * (F.col("na") - 1)))
    return both.select(F.col("ta").alias("a"), F.col("tb").alias("b"), F.when(F.col("ta") == F.col("tb"), within).otherwise(dot / (F.col("na") * F.col("nb"))).alias("mean"))


# recall by algebra

def algebraic_recall(probe: Column, candidates: DataFrame, k: int, away: Column, toward: Column, source: Column, target: Column) -> DataFrame:
    """(method, rank, idx, sim): the k candidates (idx, v) most like the probe as it is (basic), without away (negate), strengthened by toward (amplify), moved from source to target (analogy), and seen through target (attend)."""
    ways = [("basic", probe), ("negate", vec.negate(probe, away)), ("amplify", vec.amplify(probe, toward, 1.5)), ("analogy", vec.analogy(source, target, probe)), ("attend", vec.attend(probe, target, 2.0, "soft"))]
    one = candidates.sparkSession.range(1)
    queries = one.select(F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("qid"), v.alias("v")) for i, (_, v) in enumerate(ways)])).alias("q")).select("q.qid", "q.v")
    names = F.array(*[F.lit(n) for n, _ in ways])
    found = match.topk_similar(queries, candidates, k)
    return found.select(F.element_at(names, (F.col("qid") + 1).cast("int")).alias("method"), "rank", "idx", "sim")


# payloads

def byte_bindings(bytes_: DataFrame, key: str, space: Space, width: int = 64) -> DataFrame:
    """key, pos, window, offset, byte, b: each byte's binding of its place in its window and its value, worked out once per place and value."""
    d = pipe.payload_windows(bytes_, width).withColumn("offset", F.pmod("pos", F.lit(width)))
    place = atom_vector(space, F.concat(F.lit("p"), F.col("offset").cast("string")))
    value = atom_vector(space, F.concat(F.lit("0x"), F.lower(F.lpad(F.hex("byte"), 2, "0"))))
    book = d.select("offset", "byte").distinct().select("offset", "byte", vec.bind(place, value).alias("b"))  # at most width * 256 rows
    return d.join(F.broadcast(book), ["offset", "byte"]).select(key, "pos", "window", "offset", "byte", "b")


def drill_down(attack: DataFrame, normal: DataFrame, key: str, reference: Column, space: Space, width: int = 64, drop: float = 0.015, unlike: float = 0.005) -> DataFrame:
    """key, pos: the unfamiliar bytes of attack payloads (key, pos, byte): in windows whose vector is less like the window's baseline, the bundle of normal payloads' windows, than the reference's window (the rows of normal where reference holds) by over drop, the bytes whose own binding is less like the baseline than unlike."""
    n = byte_bindings(normal, key, space, width)
    a = byte_bindings(attack, key, space, width)
    windows = lambda d: agg.bundle(d, [key, "window"], "b", space.dims)
    own = windows(n)
    base = agg.bundle(own, ["window"], "v", space.dims).withColumnRenamed("v", "base")
    ref = own.where(reference).join(base, "window").select("window", cosine(F.col("v"), F.col("base")).alias("ref_sim"))
    low = windows(a).join(base, "window").join(ref, "window").where(F.col("ref_sim") - cosine(F.col("v"), F.col("base")) > drop).select(key, "window")
    strange = a.select("window", "offset", "byte", "b").dropDuplicates(["window", "offset", "byte"]).join(base, "window")
    strange = strange.where(cosine(F.col("b"), F.col("base")) < unlike).select("window", "offset", "byte")
    return a.join(low, [key, "window"], "left_semi").join(strange, ["window", "offset", "byte"], "left_semi").select(key, "pos")


def _window_vectors(data, pos, place, value):
    """(starts, vectors) of the windows of payloads' bytes: signs of the sums of their bytes' bindings."""
    width, at = len(place), np.flatnonzero(pos % len(place) == 0)
    out = np.zeros((len(at), place.shape[1]), np.int8)
    some = max(1, (4 << 20) // (width * place.shape[1]))  # windows at once
    for i in range(0, len(at), some):
        lo, hi = at[i], at[i + some] if i + some < len(at) else len(data)
        bound = place[pos[lo:hi] % width]
        bound *= value[data[lo:hi]]
        out[i : i + some] = np.sign(np.add.reduceat(bound, at[i : i + some] - lo, 0, dtype=np.int32))
    return at, out


def drill_payloads(attack: DataFrame, normal: DataFrame, reference: Column, space: Space, width: int = 64, drop: float = 0.015, unlike: float = 0.005) -> DataFrame:
    """drill_down() of whole payloads (key, raw): vectors of windows are added up where a payload is, and only sums of windows are shuffled.

    Attacks meet the baseline of the windows that the reference has, a row per window of its payload.
    """
    key, raw = attack.columns
    place = atom_rows(space, [f"p{i}" for i in range(width)])
    value = atom_rows(space, [f"0x{i:02x}" for i in range(256)])

    def sums(batches):
        total = np.zeros((0, space.dims))
        for b in batches:
            for _, _, data, pos, _ in pipe.chunks(b.column(1)):
                at, v = _window_vectors(data, pos, place, value)
                if len(at):
                    window = pos[at] // width
                    order = np.argsort(window, kind="stable")
                    first = np.flatnonzero(np.r_[True, np.diff(window[order]) > 0])
                    if window.max() >= len(total):
                        total = np.vstack((total, np.zeros((window.max() + 1 - len(total), space.dims))))
                    total[window[order][first]] += np.add.reduceat(v[order], first, 0, dtype=np.int32)
        for i in range(0, len(total), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, min(i + 1000, len(total)))), pa.array(list(total[i : i + 1000]))], ["window", "v"])

    def vectors(batches):
        for b in batches:
            for _, _, data, pos, _ in pipe.chunks(b.column(1)):
                at, v = _window_vectors(data, pos, place, value)
                yield pa.RecordBatch.from_arrays([pa.array(pos[at] // width), listed(v)], ["window", "v"])

    base = agg.bundle(normal.select(key, raw).mapInArrow(sums, "window long, v array<double>"), ["window"], "v", space.dims).withColumnRenamed("v", "base")
    own = normal.where(reference).select(key, raw).mapInArrow(vectors, "window long, v array<tinyint>")
    ref = own.join(base, "window").groupBy("window", "base").agg(F.max(cosine(F.col("v"), F.col("base"))).alias("sim")).collect()
    reach = max((r["window"] for r in ref), default=-1) + 1
    bases, sims = np.zeros((reach, space.dims), np.int8), np.full(reach, -np.inf)
    for r in ref:
        bases[r["window"]], sims[r["window"]] = r["base"], r["sim"]
    sent = attack.sparkSession.sparkContext.broadcast((bases, sims))

    def cos(dot, a, b):
        size = np.sqrt(a.astype(float)) * np.sqrt(b.astype(float))
        return np.divide(dot, size, out=np.zeros(np.broadcast(dot, size).shape), where=size > 0)

    def run(batches):
        bases, sims = sent.value
        active, lengths = np.abs(place).astype(int) @ np.abs(value).astype(int).T, np.abs(bases).sum(1, dtype=int)
        known: dict[int, np.ndarray] = {}
        for b in batches:
            for i, _, data, pos, starts in pipe.chunks(b.column(1)):
                inside = np.flatnonzero(pos < reach * width)
                row, data, pos = np.searchsorted(starts, inside, "right") - 1 + i, data[inside], pos[inside]
                at, v = _window_vectors(data, pos, place, value)
                w = pos[at] // width
                like = cos((v.astype(np.int32) * bases[w]).sum(1), np.abs(v).sum(1, dtype=int), lengths[w])
                low = np.flatnonzero(np.repeat(sims[w] - like > drop, np.diff(np.r_[at, len(data)])))
                window = pos[low] // width
                names = np.unique(window)
                for k in names[[k not in known for k in names.tolist()]].tolist() if len(names) else ():
                    known[k] = cos((place.astype(int) * bases[k]) @ value.astype(int).T, active, lengths[k : k + 1]) < unlike
                if not len(names):
                    continue
                odd = np.stack([known[k] for k in names.tolist()])[np.searchsorted(names, window), pos[low] % width, data[low]]
                at = low[odd]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[at])), pa.array(pos[at].astype(np.int32))], [key, "pos"])

    return attack.select(key, raw).mapInArrow(run, f"`{key}` {attack.schema[key].dataType.simpleString()}, pos int")


def gap_probe(detected: DataFrame, attack: DataFrame, normal: DataFrame, key: str, reach: int = 4, first: int = 20) -> DataFrame:
    """(pos): the detected positions, and those from reach before the first to reach after the last of them where one of the first attack payloads has a byte that no normal payload has there. The first are a parameter of the probe."""
    span = detected.agg((F.min("pos") - reach).alias("lo"), (F.max("pos") + reach).alias("hi"))
    some = attack.join(F.broadcast(attack.select(key).distinct().orderBy(key).limit(first)), key, "left_semi")
    near = some.join(F.broadcast(span), F.col("pos").between(F.col("lo"), F.col("hi"))).select("pos", "byte").distinct()
    return detected.select("pos").union(pipe.novel(near, normal, ["pos", "byte"]).select("pos")).distinct()


def select_rules(candidates: DataFrame, payloads: DataFrame, most: int = 32, slots: int = 7, short: int = 4) -> DataFrame:
    """(rank, pos, bytes): candidates (rank, pos, bytes as hex) taken in their order where they hit a payload (id, hex) that none taken before hits, up to most rules; those of up to short bytes use at most slots different places (pos, length).

    Which rules hit is joined by place and bytes. Payloads with equal hits are one row, and each of at most `most` steps asks for the first usable rule that hits a payload that is left; no payload reaches the driver.
    """
    rules = candidates.select("rank", F.col("pos").cast("int").alias("pos"), "bytes", (F.length("bytes") / 2).cast("int").alias("len"))
    cut = pipe.pieces_of_rules(rules, payloads, ["id"])
    slot = F.when(F.col("len") <= short, F.struct("pos", "len"))
    hits = cut.join(rules, ["pos", "len", "bytes"]).groupBy("id").agg(F.array_sort(F.collect_set(F.struct("rank", slot.alias("slot")))).alias("h"))
    hits = hits.select("h").distinct()
    from ..sources.tables import written

    hits = written(hits, "hits")
    chosen: list[int] = []
    used: set[tuple[int, int]] = set()
    while len(chosen) < most:
        left = hits.where(~F.exists("h", lambda x: x["rank"].isin(chosen))) if chosen else hits
        x = left.select(F.explode("h").alias("x")).select("x.rank", "x.slot")
        if len(used) >= slots:
            x = x.where(F.col("slot").isNull() | F.concat_ws(":", "slot.pos", "slot.len").isin([f"{p}:{n}" for p, n in used]))
        best = x.agg(F.min(F.struct("rank", "slot"))).first()[0]
        if best is None:
            break
        chosen.append(best["rank"])
        if best["slot"] is not None:
            used.add((best["slot"]["pos"], best["slot"]["len"]))
    return candidates.where(F.col("rank").isin(chosen)) if chosen else candidates.limit(0)


# rates and fields

def smoothed_rate(df: DataFrame, key: str, ts: str, window: int = 100, smoothing: float = 0.1, first: float = 100.0, cap: float = 1e6) -> DataFrame:
    """key, ts, rate: the larger of the rate over a key's last window rows and the moving average of 1 / gap; gaps near 0 count as cap."""
    t = df.select(key, F.col(ts), F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"))

    def step(s, row):
        now, times = row["_t"], s["times"]
        gap = (now - times[-1]) / 1e6 if times else None
        instant = first if gap is None else 1 / gap if gap > 1e-9 else cap
        times.append(now)
        del times[:-window]
        s["rate"] = smoothing * instant + (1 - smoothing) * s["rate"]
        span = (times[-1] - times[0]) / 1e6
        over = s["rate"] if len(times) < 2 else cap if span < 1e-9 else (len(times) - 1) / span
        return (max(over, s["rate"]),)

    return pipe.per_key(t, key, ts, {"rate": "double"}, lambda: {"times": [], "rate": first}, step)


def tracked_fields(warm: DataFrame, live: DataFrame, order: str, space: Space, decay: float = 0.98, halve_over: int = 200) -> DataFrame:
    """field, order, divergence, dominant, concentration, novel: how each value of live (field, order, value), once observed, leaves its field: one less the cosine of the warm-up's pattern and the decayed pattern (components over .3 of its length), the most frequent value (ties to the smaller) with its share, counts being halved whenever they sum to over halve_over, and whether the warm-up never had the value."""

    rows = warm.select("field", F.lit(0).alias("_w"), F.col(order), "value").union(live.select("field", F.lit(1), F.col(order), "value"))
    rows = rows.withColumn("_o", F.struct("_w", order))
    some = 128
    lag = np.subtract.outer(np.arange(some), np.arange(some))
    fades = np.where(lag >= 0, decay ** np.maximum(lag, 0), 0.0)  # what is left of an earlier vector of a block
    first = lambda c: min(c, key=lambda k: (-c[k], k is None, k or "")) if c else None

    def feed(s, b):
        if not s:
            s.update(sums=np.zeros(space.dims), counts={}, seen=set(), prior=None)
        coded, field = b.column("value").dictionary_encode(), b.column("field")[0].as_py()
        names = coded.dictionary.to_pylist() + [None]
        codes = coded.indices.fill_null(len(names) - 1).to_numpy()
        atoms = atom_rows(space, [f"{field}:{x}" for x in names]).astype(float)
        cut = int(np.searchsorted(b.column("_w").to_numpy(), 1))
        counts = s["counts"]
        for k, n in zip(*np.unique(codes[:cut], return_counts=True), strict=True):
            s["sums"] = s["sums"] + n * atoms[k]
            s["seen"].add(names[k])
            counts[names[k]] = counts.get(names[k], 0) + int(n)
        codes = codes[cut:]
        if not len(codes):
            return None
        if s["prior"] is None:
            s["prior"] = np.sign(s["sums"])
        apart = []
        for i in range(0, len(codes), some):
            m = atoms[codes[i : i + some]]
            n = len(m)
            sums = fades[:n, :n] @ m + decay ** np.arange(1, n + 1)[:, None] * s["sums"]
            s["sums"] = sums[-1]
            size = np.sqrt((sums * sums).sum(1))[:, None]
            now = np.where(size < 1e-10, 0.0, np.where(sums > 0.3 * size, 1.0, np.where(sums < -0.3 * size, -1.0, 0.0)))
            both = np.sqrt((now * now).sum(1) * (s["prior"] @ s["prior"]))
            apart.append(1 - np.divide(now @ s["prior"], both, out=np.zeros(n), where=both > 1e-10))
        tops, shares, total, top = [], [], sum(counts.values()), first(counts)
        most = counts[top] if counts else 0
        for k in codes.tolist():
            x = names[k]
            n = counts[x] = counts.get(x, 0) + 1
            total += 1
            if total > halve_over:
                counts = {k: n // 2 for k, n in counts.items() if n // 2}
                total, top = sum(counts.values()), first(counts)
            elif not most or n > most or n == most and x is not None and (top is None or x < top):
                top = x
            most = counts[top] if counts else 0
            tops.append(top)
            shares.append(most / total if total else 0.0)
        s["counts"] = counts
        new = np.array([x not in s["seen"] for x in names])[codes]
        cols = [pa.array(np.concatenate(apart)), pa.array(tops, pa.string()), pa.array(shares), pa.array(new)]
        return pa.RecordBatch.from_arrays([b.column("field")[cut:], b.column(order)[cut:], *cols], ["field", order, "divergence", "dominant", "concentration", "novel"])

    form = f"field string, `{order}` {live.schema[order].dataType.simpleString()}, divergence double, dominant string, concentration double, novel boolean"
    return streamed(rows, ["field"], "_o", form, dict, feed)


# memory of models

def memory_cycle(train: DataFrame, probes: DataFrame, key: str, order: str, v: str, k: int, path: str, qid: str) -> tuple[DataFrame, DataFrame]:
    """(matches, scores): a subspace is learned per key and minted into a library, which is stored at path and loaded again; each probe recalls the model that explains it best (qid, name, residual), and is scored under the model of its own key (rows with residual, threshold, anomalous)."""
    models = learn(train, key, order, v, k)
    Library.empty(train.sparkSession).add_models(models, key).save(path)
    library = Library.load(train.sparkSession, path)
    known = library.df.select(F.col("name").cast(train.schema[key].dataType).alias(key), "snapshot.*")
    return library.match_vec(probes, qid, v, 1).drop("rank"), score(probes, known, key, v)
