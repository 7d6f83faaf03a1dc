"""Whole dataflows: detection against frozen baselines, rates, field tracking, rules from payloads, changepoints."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


# baselines and gates

def frozen_baseline(train: DataFrame, cols: list[str]) -> DataFrame:
    """One row of mean and population deviation per column; deviations are at least .02, and .05 from a single row."""
    std = lambda c: F.when(F.count(c) < 2, 0.05).otherwise(F.greatest(F.stddev_pop(c), F.lit(0.02)))
    return train.agg(*[x for c in cols for x in (F.avg(c).alias(f"{c}_mean"), std(c).alias(f"{c}_std"))])


def z_scores(rows: DataFrame, baseline: DataFrame, cols: list[str]) -> DataFrame:
    """rows with <col>_z; the baseline is one row."""
    j = rows.crossJoin(F.broadcast(baseline))
    return j.select(*rows.columns, *[((F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std")).alias(f"{c}_z") for c in cols])


def gated(rate_z: Column, pattern_z: Column) -> Column:
    """A rate far below its baseline, or a pattern below it together with a lower rate."""
    return (rate_z < -2.5) | ((pattern_z < -2.0) & (rate_z < -0.5))


def explanation(name: str, z: Column) -> Column:
    return F.format_string(f"{name} %.1f std %s baseline", F.abs(z), F.when(z < 0, "below").otherwise("above"))


def rates(rows: DataFrame, phase: str, flagged: str, attack: str) -> DataFrame:
    """Per phase: rows, flagged, and their share, which is recall in attack phases and the false-positive rate in others."""
    return rows.groupBy(phase, attack).agg(F.count("*").alias("n"), F.sum(F.col(flagged).cast("int")).alias("hits"), F.avg(F.col(flagged).cast("double")).alias("share"))


def precision_recall(rows: DataFrame, flagged: str, truth: str) -> DataFrame:
    n = lambda c: F.sum(c.cast("int"))
    f, t = F.col(flagged), F.col(truth)
    s = rows.agg(n(f & t).alias("tp"), n(f & ~t).alias("fp"), n(~f & t).alias("fn"))
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    return s.select("tp", "fp", "fn", F.coalesce(p, F.lit(0.0)).alias("precision"), F.coalesce(r, F.lit(0.0)).alias("recall"), F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)).alias("f1"))


_KINDS = {"double": pa.float64(), "boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def per_key(df: DataFrame, key: str, order: str, columns: dict[str, str], start: Callable, step: Callable) -> DataFrame:
    """Feedback loops: key, order and columns from step(state, row) -> tuple, with a state per key, rows in order (see streamed())."""
    from ..operators.ordered import streamed

    form = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, order)] + [f"{c} {k}" for c, k in columns.items()])

    def feed(state, b):
        cols = zip(*[step(state, row) for row in b.to_pylist()], strict=True)
        made = [pa.array(v, _KINDS[k]) for v, k in zip(cols, columns.values(), strict=True)]
        return pa.RecordBatch.from_arrays([b.column(key), b.column(order), *made], [key, order, *columns])

    return streamed(df, [key], order, form, start, feed)


def hysteresis(df: DataFrame, key: str, order: str, flag: str, window: int = 15, calm: int = 5, enter: float = 0.5, leave: float = 0.2) -> DataFrame:
    """key, order, level, alarm: share of flags in the last window slots; after calm rows without one, each fills three slots. The alarm begins over enter and ends under leave."""

    def step(s, row):
        hit = bool(row[flag])
        s["quiet"] = 0 if hit else s["quiet"] + 1
        s["slots"] = (s["slots"] + ([0, 0, 0] if s["quiet"] >= calm else [int(hit)]))[-window:]
        level = sum(s["slots"]) / window
        s["on"] = level >= leave if s["on"] else level > enter
        return level, s["on"]

    return per_key(df.select(key, order, flag), key, order, {"level": "double", "alarm": "boolean"}, lambda: {"quiet": 0, "slots": [], "on": False}, step)


def self_training(df: DataFrame, key: str, order: str, pattern: str, rate: str, factor: float = 0.98, low: tuple[float, float] = (0.3, 0.5)) -> DataFrame:
    """key, order, pattern_sim, rate_sim, anomalous: a row is anomalous if both vectors are unlike what was learned; only others are learned, after a decay."""

    def cos(a, b):
        d = float(np.sqrt((a @ a) * (b @ b)))
        return float(a @ b) / d if d > 1e-10 else 0.0

    def step(s, row):
        x, y = (np.array(row[c], float) for c in (pattern, rate))
        if not s:
            s.update(x=x.copy(), y=y.copy())
            return 1.0, 1.0, False
        px, py = cos(s["x"], x), cos(s["y"], y)
        bad = px < low[0] and py < low[1]
        if not bad:
            s["x"], s["y"] = s["x"] * factor + x, s["y"] * factor + y
        return px, py, bad

    return per_key(df.select(key, order, pattern, rate), key, order, {"pattern_sim": "double", "rate_sim": "double", "anomalous": "boolean"}, dict, step)


def event_rate(df: DataFrame, keys: list[str], ts: str, last: int = 100, cap: float = 1e6) -> DataFrame:
    """df with rate: events per second over the last rows of a key, capped; the first row has 100."""
    w = Window.partitionBy(*keys).orderBy(ts)
    t = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    recent = w.rowsBetween(-(last - 1), 0)
    n, span = F.count(F.lit(1)).over(recent), F.max(t).over(recent) - F.min(t).over(recent)
    return df.withColumn("rate", F.when(n < 2, F.lit(100.0)).when(span <= 0, F.lit(cap)).otherwise(F.least((n - 1) / span, F.lit(cap))))


def distinct_ratio(df: DataFrame, keys: list[str], col: str, exact: bool = False) -> DataFrame:
    """keys, ratio: distinct values over rows, by sketch unless exact; at most 1."""
    d = F.count_distinct(col) if exact else F.approx_count_distinct(col, 0.01)
    return df.groupBy(*keys).agg(F.least(d / F.count(col), F.lit(1.0)).alias("ratio"))


def golden_section(f: Callable[[float], float], lo: float, hi: float, steps: int = 60) -> float:
    """Where f is largest on [lo, hi], for a function with one hump; used on a similarity as a function of a logarithm."""
    g = (5**0.5 - 1) / 2
    a, b = lo, hi
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    for _ in range(steps):
        if fc >= fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
    return (a + b) / 2


# fields

def unpivot(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, field, value: a row per field."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.field", "_p.value")


def dominant(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, top, n, total, concentration: the most frequent value (ties to the smaller) and its share."""
    c = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    agg = c.groupBy(*keys).agg(F.max("n").alias("_m"), F.sum("n").alias("total"), F.count("*").alias("values"))
    first = c.join(agg, keys).where(F.col("n") == F.col("_m")).groupBy(*keys, "total", "values").agg(F.min(value).alias("top"), F.first("n").alias("n"))
    return first.select(*keys, "top", "n", "total", "values", (F.col("n") / F.col("total")).alias("concentration"))


def novel(df: DataFrame, seen: DataFrame, cols: list[str]) -> DataFrame:
    """Rows of df whose cols never occur in seen."""
    return df.join(seen.select(*cols).distinct(), cols, "left_anti")


def mitigation_rules(fields: DataFrame, baseline: DataFrame, min_gap: float = 0.15, min_share: float = 0.5, max_distinct: float = 0.3) -> DataFrame:
    """key, rule: for each key the equalities of the fields that moved from the baseline (field, top, concentration), are concentrated and have few values, as JSON."""
    now = dominant(fields, ["key", "field"], "value")
    was = baseline.select("field", F.col("top").alias("was"), F.col("concentration").alias("share"))
    moved = now.join(was, "field", "left")
    gap = F.when(F.col("was") == F.col("top"), F.abs(F.col("concentration") - F.col("share"))).otherwise(F.col("concentration"))
    hit = moved.where((gap > min_gap) & (F.col("concentration") >= min_share) & (F.col("values") / F.col("total") < max_distinct))
    return hit.groupBy("key").agg(F.to_json(F.array_sort(F.collect_list(F.struct("field", F.col("top").alias("equals"))))).alias("rule"))


# payloads

def payload_bytes(df: DataFrame, key: str, payload: Column, limit: int | None = 512) -> DataFrame:
    """key, pos, byte of the first limit bytes (None: of all)."""
    raw = payload if dict(df.select(payload.alias("_p")).dtypes)["_p"] == "binary" else F.encode(payload, "utf-8")
    d = df.select(key, (raw if limit is None else F.substring(raw, 1, limit)).alias("_raw")).where(F.length("_raw") > 0)
    byte = lambda i: F.conv(F.hex(F.substr("_raw", i + 1, F.lit(1))), 16, 10).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.length("_raw") - 1), lambda i: F.struct(i.alias("pos"), byte(i).alias("byte")))
    return d.select(key, F.explode(each).alias("_b")).select(key, "_b.pos", "_b.byte")


def payload_windows(bytes_: DataFrame, width: int = 64) -> DataFrame:
    return bytes_.withColumn("window", F.floor(F.col("pos") / width).cast("int"))


#: Bytes of payloads that a task handles at once, pieces of payloads that are dealt, different pieces that a task holds at once, and bytes of rules sent to tasks.
CHUNK_BYTES, PIECE, PIECES_HELD, RULE_BYTES = 4 << 20, 64, 4 << 20, 64 << 20


def chunks(col: pa.Array):
    """(first row, last row, bytes, place in its payload of each byte, starts) of payloads that follow each other and have some CHUNK_BYTES; starts has a row more than payloads."""
    col = col.cast(pa.large_binary()).fill_null(b"")
    if not len(col):
        return
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    data, i = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + CHUNK_BYTES, "right")) - 1)
        starts = offs[i : j + 1] - offs[i]
        yield i, j, data[offs[i] : offs[j]], np.arange(starts[-1]) - np.repeat(starts[:-1], np.diff(starts)), starts
        i = j


def byte_counts(payloads: DataFrame, raw: str, attack: str) -> DataFrame:
    """pos, byte, attacks, normals: how many payloads of each side have the byte there. Rows are summed where payloads are, so a (pos, byte) is a row per some megabytes."""

    def run(batches):
        for b in batches:
            side = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for i, j, data, pos, starts in chunks(b.column(0)):
                keys, n = np.unique(pos << 9 | data.astype(np.int64) << 1 | np.repeat(side[i:j], np.diff(starts)), return_counts=True)
                hit = keys & 1
                cols = [(keys >> 9).astype(np.int32), (keys >> 1 & 255).astype(np.int32), n * hit, n * (1 - hit)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["pos", "byte", "attacks", "normals"])

    part = payloads.where(F.col(attack).isNotNull()).select(raw, attack).mapInArrow(run, "pos int, byte int, attacks long, normals long")
    return part.groupBy("pos", "byte").agg(F.sum("attacks").alias("attacks"), F.sum("normals").alias("normals"))


def profile_of(counts: DataFrame, n: str, constant: float = 0.95) -> DataFrame:
    """position_profile() from counts (pos, byte, n)."""
    c = counts.where(F.col(n) > 0).groupBy("pos").agg(F.max(F.struct(F.col(n).alias("n"), (-F.col("byte")).alias("b"))).alias("_t"), F.sum(n).alias("total"), F.count("*").alias("values"))
    c = c.select("pos", (-F.col("_t.b")).alias("top"), "_t.n", "total", "values", (F.col("_t.n") / F.col("total")).alias("concentration"))
    return c.withColumn("is_constant", F.col("concentration") >= constant)


def position_profile(bytes_: DataFrame, constant: float = 0.95) -> DataFrame:
    """pos, top, n, total, values, concentration, is_constant; the top of equals is the smallest."""
    return profile_of(bytes_.groupBy("pos", "byte").agg(F.count("*").alias("n")), "n", constant)


def payload_runs(payloads: DataFrame, key: str, raw: str, byte: int, gap: int) -> DataFrame:
    """key, first, last, n: places of a byte with at most gap between neighbours, merged, as ordered.runs() does."""

    def run(batches):
        for b in batches:
            for i, _, data, pos, starts in chunks(b.column(1)):
                at = np.flatnonzero(data == byte)
                if not len(at):
                    continue
                row, p = np.searchsorted(starts, at, "right") - 1, pos[at]
                new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (p[1:] - p[:-1] > gap)])
                end = np.r_[new[1:], len(at)]
                cols = [pa.array(p[new].astype(np.int32)), pa.array(p[end - 1].astype(np.int32)), pa.array(end - new)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[new] + i)), *cols], [key, "first", "last", "n"])

    return payloads.select(key, raw).mapInArrow(run, f"`{key}` {payloads.schema[key].dataType.simpleString()}, first int, last int, n long")


def window_totals(payloads: DataFrame, width: int) -> DataFrame:
    """key, window, n, total of payloads (key, raw): number and sum of the bytes of each window."""
    key, raw = payloads.columns

    def run(batches):
        for b in batches:
            for i, _, data, pos, starts in chunks(b.column(1)):
                at = np.flatnonzero(pos % width == 0)
                if not len(at):
                    continue
                row, n = np.searchsorted(starts, at, "right") - 1 + i, np.diff(np.r_[at, len(data)])
                cols = [pa.array((pos[at] // width).astype(np.int32)), pa.array(n), pa.array(np.add.reduceat(data.astype(np.int64), at))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), *cols], [key, "window", "n", "total"])

    return payloads.mapInArrow(run, f"`{key}` {payloads.schema[key].dataType.simpleString()}, window int, n long, total long")


def unseen(attack: DataFrame, normal: DataFrame) -> DataFrame:
    """(pos, byte) pairs of attacks that normal payloads never have."""
    return novel(attack.select("pos", "byte").distinct(), normal, ["pos", "byte"])


def rule_candidates(attack: DataFrame, normal: DataFrame, key: str, width: int, top: int = 5) -> DataFrame:
    """pos, bytes, n: at each position the most frequent runs of width bytes in attacks that no normal payload has there."""
    def grams(b):
        w = Window.partitionBy(key).orderBy("pos").rowsBetween(0, width - 1)
        g = b.withColumn("bytes", F.collect_list("byte").over(w)).where(F.size("bytes") == width)
        return g.select("pos", F.array_join(F.transform("bytes", lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "").alias("bytes"))

    n = novel(grams(attack), grams(normal), ["pos", "bytes"]).groupBy("pos", "bytes").agg(F.count("*").alias("n"))
    w = Window.partitionBy("pos").orderBy(F.desc("n"), "bytes")
    return n.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).drop("_r")


def _grams(data: np.ndarray, width: int) -> np.ndarray:
    """Number of the width bytes from each place, or a hash of them if they are over 8; width - 1 fewer than bytes."""
    n = max(0, len(data) - width + 1)
    g = np.zeros(n, np.uint64)
    for i in range(width):
        g *= np.uint64(256 if width <= 8 else 0x100000001B3)
        g += data[i : i + n]
    return g


def payload_candidates(payloads: DataFrame, raw: str, attack: str, width: int, top: int = 5) -> DataFrame:
    """rule_candidates() of whole payloads, for runs of up to 7 bytes.

    Payloads are cut into pieces of PIECE positions, which meet by position: a task counts the runs of some positions of all payloads and returns the first few of each. Where so many payloads reach that a task had over PIECES_HELD runs, several tasks get the pieces, and each counts its share of the runs.
    """
    if width > 7:
        raise ValueError("runs of up to 7 bytes")
    d = payloads.where(F.col(attack).isNotNull() & (F.length(raw) >= width)).select(raw, F.col(attack).alias("attack"))
    last = F.floor((F.length(raw) - width) / PIECE).cast("int")
    reach = sorted((r[0], r[1]) for r in d.groupBy(last.alias("last")).agg(F.count("*")).collect())  # a row per PIECE bytes of the longest payload
    if not reach:
        return payloads.sparkSession.createDataFrame([], "pos int, bytes string, n long")
    found = np.zeros(reach[-1][0] + 1, np.int64)
    for block, n in reach:
        found[block] = n
    shares = np.maximum(1, -(-np.cumsum(found[::-1])[::-1] * PIECE // PIECES_HELD))
    cut = d.select("attack", raw, F.explode(F.sequence(F.lit(0), last)).alias("block"))
    cut = cut.select("attack", "block", F.substring(F.col(raw), F.col("block") * PIECE + 1, F.lit(PIECE + width - 1)).alias("piece"))
    if shares.max() > 1:
        many = F.broadcast(payloads.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(shares.tolist()) if n > 1], "block int, of int"))
        cut = cut.join(many, "block", "left").withColumn("of", F.coalesce("of", F.lit(1)))
        cut = cut.select("attack", "block", "piece", "of", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("share"))
    else:
        cut = cut.select("attack", "block", "piece", F.lit(1).alias("of"), F.lit(0).alias("share"))
    bits = np.uint64(8 * width + 1)

    def packed(s):
        """What is held as sorted different runs with their counts."""
        keys, n = np.concatenate(s["keys"]), np.concatenate(s["n"])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        s["keys"], s["n"], s["rows"] = [keys[first]], [np.add.reduceat(n[order], first)], 0

    def feed(s, b):
        of, share, side = b.column("of")[0].as_py(), b.column("share")[0].as_py(), b.column("attack").to_numpy(zero_copy_only=False).astype(np.uint64)
        for i, j, data, pos, starts in chunks(b.column("piece")):
            g = _grams(data, width)
            size = np.diff(starts)
            at = np.flatnonzero(pos[: len(g)] <= np.repeat(size, size)[: len(g)] - width)
            g, p = g[at], pos[at].astype(np.uint64)
            key = p << bits | g << np.uint64(1) | np.repeat(side[i:j], size)[at]
            if of > 1:
                key = key[((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(of) == share]
            keys, n = np.unique(key, return_counts=True)
            s.setdefault("keys", []).append(keys)
            s.setdefault("n", []).append(n)
            s["rows"] = s.get("rows", 0) + len(keys)
        if s.get("rows", 0) > PIECES_HELD:
            packed(s)

    def finish(s, name):
        if not s.get("keys") or not sum(map(len, s["keys"])):
            return None
        packed(s)
        keys, n = s["keys"][0], s["n"][0]
        own = (keys & np.uint64(1) == 1) & ~np.r_[False, keys[1:] == keys[:-1] + np.uint64(1)]
        keys, n = keys[own], n[own]
        pos, g = keys >> bits, keys >> np.uint64(1) & np.uint64((1 << 8 * width) - 1)
        order = np.lexsort((g, -n, pos))
        pos, g, n = pos[order], g[order], n[order]
        first = np.searchsorted(pos, pos, "left")
        keep = np.arange(len(pos)) - first < top
        texts = [f"{x:0{2 * width}x}" for x in g[keep].tolist()]
        return pa.RecordBatch.from_arrays([pa.array((pos[keep].astype(np.int64) + name[0] * PIECE).astype(np.int32)), pa.array(texts, pa.string()), pa.array(n[keep])], ["pos", "bytes", "n"])

    from ..operators.ordered import streamed

    best = streamed(cut, ["block", "share"], "of", "pos int, bytes string, n long", dict, feed, finish)
    w = Window.partitionBy("pos").orderBy(F.desc("n"), "bytes")
    return best.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).drop("_r")


def pieces_of_rules(rules: DataFrame, payloads: DataFrame, keep: list[str]) -> DataFrame:
    """keep, pos, len, bytes: at least the pieces of payloads (keep, hex) that are rules (pos, bytes, len), and few others; join them with the rules.

    Rules of few bytes are sent to the tasks, which look for the hash of each place and piece. For more, each payload is cut at the places (pos, length) that rules look at.
    """
    raw = payloads.select(*keep, F.unhex("hex").alias("_raw"))
    if (rules.agg(F.sum((F.col("len") + 16).cast("long"))).first()[0] or 0) > RULE_BYTES:
        places = rules.groupBy("len").agg(F.collect_set("pos").alias("at"))  # a row per length of a rule
        cut = raw.join(F.broadcast(places), F.length("_raw") >= F.col("len")).select(*keep, "_raw", "len", F.explode("at").alias("pos"))
        cut = cut.where(F.length("_raw") >= F.col("pos") + F.col("len"))
        return cut.select(*keep, "pos", "len", F.lower(F.hex(F.substring(F.col("_raw"), F.col("pos") + 1, F.col("len")))).alias("bytes"))
    spread = np.uint64(0x9E3779B97F4A7C15)
    place = lambda g, pos: (g * spread) ^ (pos.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + (g >> np.uint64(29)))
    known: dict[int, list] = {}
    for r in rules.select("pos", "len", "bytes").distinct().collect():
        if r["len"] and r["pos"] >= 0:
            known.setdefault(r["len"], []).append((r["pos"], bytes.fromhex(r["bytes"])))
    hashes = {n: np.unique(place(np.array([_grams(np.frombuffer(b, np.uint8), n)[0] for _, b in of], np.uint64), np.array([p for p, _ in of]))) for n, of in known.items()}
    sent = payloads.sparkSession.sparkContext.broadcast(hashes)

    def run(batches):
        maybe = {}
        for n, h in sent.value.items():
            maybe[n] = np.zeros(1 << 22, bool)
            maybe[n][h >> np.uint64(42)] = True
        for b in batches:
            for i, _, data, pos, starts in chunks(b.column(len(keep))):
                for n, h in sent.value.items():
                    x = place(_grams(data, n), pos[: max(0, len(data) - n + 1)])
                    at = np.flatnonzero(maybe[n][x >> np.uint64(42)])
                    x = x[at]
                    at = at[h[np.minimum(np.searchsorted(h, x), len(h) - 1)] == x]
                    row = np.searchsorted(starts, at, "right") - 1
                    inside = at + n <= starts[row + 1]
                    at, row = at[inside], row[inside]
                    if len(at):
                        text = [data[k : k + n].tobytes().hex() for k in at.tolist()]
                        cols = [pa.array(pos[at].astype(np.int32)), pa.array(np.full(len(at), n, np.int32)), pa.array(text, pa.string())]
                        rows = pa.array(row + i)
                        yield pa.RecordBatch.from_arrays([*[b.column(k).take(rows) for k in range(len(keep))], *cols], [*keep, "pos", "len", "bytes"])

    form = ", ".join([f"`{c}` {payloads.schema[c].dataType.simpleString()}" for c in keep] + ["pos int, len int, bytes string"])
    return raw.mapInArrow(run, form)


def validated_rules(rules: DataFrame, payloads: DataFrame, attack: str) -> DataFrame:
    """Rules (pos, bytes) with tp and fp over payloads (hex, attack), those without a false positive and with a hit. Counts of pieces are summed before the join with the rules."""
    rules = rules.select(F.col("pos").cast("int").alias("pos"), "bytes", (F.length("bytes") / 2).cast("int").alias("len")).distinct()
    n = pieces_of_rules(rules, payloads, [attack]).groupBy("pos", "bytes").agg(F.sum(F.col(attack).cast("long")).alias("tp"), F.sum((~F.col(attack)).cast("long")).alias("fp"))
    return n.where("fp = 0 and tp > 0").join(rules.select("pos", "bytes"), ["pos", "bytes"], "left_semi")


def greedy_cover(hits: dict[object, set], most: int = 32) -> list:
    """Rules in the order in which each adds most rows not covered before, until none adds any."""
    left, out = dict(hits), []
    covered: set = set()
    while left and len(out) < most:
        best = max(sorted(left, key=repr), key=lambda r: len(left[r] - covered))
        if not left[best] - covered:
            break
        covered |= left.pop(best)
        out.append(best)
    return out


MASKS = (0xFF, 0xFE, 0xFC, 0xF8, 0xF0, 0xE0, 0xC0, 0x80)


def best_mask(attack: DataFrame, normal: DataFrame) -> DataFrame:
    """pos, mask, match, n: per position the prefix mask and value that cover most attacks and no normal payload."""
    both = [d.groupBy("pos", "byte").agg(F.count("*").alias(n)) for d, n in ((attack, "attacks"), (normal, "normals"))]
    return mask_of(both[0].join(both[1], ["pos", "byte"], "full"))


def mask_of(counts: DataFrame) -> DataFrame:
    """best_mask() from counts (pos, byte, attacks, normals)."""
    each = counts.select("pos", F.coalesce("attacks", F.lit(0)).alias("n"), F.coalesce("normals", F.lit(0)).alias("no"), "byte", F.explode(F.array(*[F.lit(m) for m in MASKS])).alias("mask"))
    n = each.groupBy("pos", "mask", F.col("byte").bitwiseAND(F.col("mask")).alias("match")).agg(F.sum("n").alias("n"), F.sum("no").alias("no")).where("no = 0 and n > 0").drop("no")
    best = n.groupBy("pos").agg(F.max(F.struct("n", "mask", (-F.col("match")).alias("m"))).alias("_t"))
    return best.select("pos", "_t.mask", (-F.col("_t.m")).alias("match"), "_t.n")


def mask_match(byte: Column, mask: Column, match: Column) -> Column:
    return byte.bitwiseAND(mask) == match


# changepoints and profiles

def consolidated(breaks: DataFrame, gap: int = 12) -> DataFrame:
    """(seq) of the breakpoints that are over gap after the last one kept. One that is over gap after any other is always kept, so the chains in between are looked at apart."""
    from ..operators.ordered import chains

    def step(s, row):
        keep = s.get("last") is None or row["seq"] - s["last"] > gap
        if keep:
            s["last"] = row["seq"]
        return (keep,)

    return per_key(chains(breaks, gap), "chain", "seq", {"keep": "boolean"}, dict, step).where("keep").select("seq")


def residual_timeline(rows: DataFrame, phase: str) -> DataFrame:
    return rows.groupBy(phase).agg(F.avg("residual").alias("mean"), F.sum(F.col("anomalous").cast("int")).alias("flagged"), F.count("*").alias("n"))


def remediated(golden: Column, drifted: Column, strength: float = 0.5) -> Column:
    from ..functions.vectors import amplify, difference

    return amplify(golden, difference(golden, drifted), strength)


def disagreement(profile: Column) -> Column:
    """Share of active components that disagree."""
    n = lambda f: F.size(F.filter(profile, f))
    return F.coalesce(n(lambda x: x < 0) / F.nullif(n(lambda x: x != 0), F.lit(0)), F.lit(0.0))


def rate_factor(cosine: Column, ratio: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine * (1 - ratio)))


def port_band(port: Column) -> Column:
    return F.when(port < 1024, "system").when(port < 49152, "registered").otherwise("dynamic")


def size_band(size: Column) -> Column:
    return F.when(size < 100, "small").when(size < 1000, "medium").otherwise("large")
