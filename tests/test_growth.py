"""What a query costs as its input grows, and the faster steps against the plain ones."""

import datetime
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trivex.config import Space
from trivex.functions import vectors
from trivex.functions.atoms import atom_array, atom_vector
from trivex.operators import ordered
from trivex.operators.subspace import Subspace, learn
from trivex.plans import applications as app, expr, pipelines as pipe
from trivex.sources import encode as enc

SPACE = Space(64)


def test_vectors_learned_at_once_are_learned_as_one_by_one():
    own = np.random.default_rng(4)
    many = np.vstack([np.zeros((20, 48)), own.integers(-1, 2, (900, 48)), own.normal(size=(300, 2)) @ own.normal(size=(2, 48))])
    one, all_ = (Subspace(48, 4, min_components=2, reorth_interval=250) for _ in range(2))
    began = time.perf_counter()
    want = [(one.update(x), one.threshold()) for x in many]
    alone = time.perf_counter() - began
    began = time.perf_counter()
    got = [np.concatenate(x) for x in zip(*[all_.learned(many[i:j]) for i, j in ((0, 1), (1, 7), (7, 700), (700, len(many)))], strict=True)]
    assert time.perf_counter() - began < alone / 2
    assert got[0] == pytest.approx([r for r, _ in want], abs=1e-6) and got[1] == pytest.approx([t for _, t in want], abs=1e-6)
    assert (one.k, one.n) == (all_.k, all_.n) and all_.components == pytest.approx(one.components, abs=1e-6)


def test_keys_that_learn_have_partitions_of_their_own(spark):
    """Before, small partitions were merged by their bytes, so keys waited for each other."""
    df = spark.range(600).select((F.col("id") % 6).alias("g"), F.col("id").alias("seq"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("v"))
    where = learn(df, "g", "seq", "v", 1).select("g", F.spark_partition_id().alias("p")).collect()
    assert len(where) == 6 and len({r["p"] for r in where}) > 3


def test_long_sequences_and_nulls(spark):
    words = [f"w{i % 700}" for i in range(1500)]
    rows = [(0, words), (1, []), (2, None), (3, ["a", None]), (4, ["a"]), (5, ["a", "b", "a"])]
    df = spark.createDataFrame(rows, "id int, w array<string>")
    atoms = lambda ws: [atom_array(SPACE, w).astype(int) for w in ws]
    twins = {
        "bundle": lambda a: np.sign(sum(a)),
        "positional": lambda a: np.sign(sum(np.roll(x, -i) for i, x in enumerate(a))),
        "chained": lambda a: np.prod(a, 0),
        "ngram": lambda a: np.sign(sum(x * np.roll(y, -1) for x, y in zip(a, a[1:]))) if len(a) > 1 else a[0],
    }
    for mode, twin in twins.items():
        began = time.perf_counter()
        got = {r["id"]: r["v"] for r in df.select("id", enc.encode_sequence(SPACE, F.col("w"), mode, 2).alias("v")).collect()}
        assert time.perf_counter() - began < 30  # atoms of a row were worked out again for each of its n-grams
        assert got[1] == [0] * SPACE.dims and got[2] is None and got[3] is None
        assert all(got[i] == twin(atoms(rows[i][1])).tolist() for i in (0, 4, 5))


def test_rows_of_any_type_are_encoded_in_batches_as_by_columns(spark):
    form = "id int, r struct<a: string, n: double, t: timestamp, l: array<string>, s: array<int>, x: struct<y: boolean, z: bigint>>"
    when = datetime.datetime(2024, 3, 5, 7, 8, 9)
    rows = [
        (0, ("p", 1.5, when, ["u", None, "u"], [3, 3, 4], (True, 7))),
        (1, (None, 2.0, when, [], [], None)),
        (2, ("p", None, when, None, None, (None, None))),
        (3, ("q", 1e20, when, None, None, (False, -1))),
        (4, None),
    ]
    df = spark.createDataFrame(rows, form)
    kind = df.schema["r"].dataType
    for hints in ({}, {"s": "set", "t": "time", "n": "log"}, {"l": "set", "t": "time:day"}):
        each = df.select("id", enc.encode(SPACE, F.col("r"), kind, hints).alias("a"), enc.encode_rows(SPACE, F.col("r"), kind, hints).alias("b"))
        for r in each.collect():
            assert r["a"] == r["b"], (hints, r["id"])


def payloads(spark, n=60, seed=3):
    own = np.random.default_rng(seed)
    rows = [(i, own.integers(97, 100, int(own.integers(0, 190))).astype(np.uint8).tobytes(), bool(i % 2)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, raw binary, attack boolean")


@pytest.mark.parametrize("held", [1 << 22, 300])
@pytest.mark.parametrize("width", [2, 4])
def test_runs_of_payloads_are_counted_without_a_row_per_byte(spark, monkeypatch, held, width):
    """Small limits: runs of some positions are shared by several tasks, and a batch is many chunks."""
    monkeypatch.setattr(pipe, "PIECES_HELD", held)
    monkeypatch.setattr(pipe, "CHUNK_BYTES", held)
    rows, df = payloads(spark)
    runs = lambda side: Counter((p, b[p : p + width].hex()) for _, b, a in rows if a == side for p in range(len(b) - width + 1))
    attack, normal = runs(True), runs(False)
    want = set()
    for pos in {p for p, _ in attack}:
        new = sorted((-n, b) for (p, b), n in attack.items() if p == pos and (p, b) not in normal)
        want |= {(pos, b, -n) for n, b in new[:3]}
    got = pipe.payload_candidates(df, "raw", "attack", width, 3)
    assert "Window" not in got._jdf.queryExecution().analyzed().toString().split("MapInArrow")[-1]  # no row per byte below
    assert {tuple(r) for r in got.collect()} == want and want


@pytest.mark.parametrize("sent", [1 << 26, 0])
def test_rules_are_looked_up_in_payloads(spark, monkeypatch, sent):
    monkeypatch.setattr(pipe, "RULE_BYTES", sent)
    rows, df = payloads(spark)
    own = np.random.default_rng(5)
    rules = {(int(p), b[p : p + n]) for _, b, _ in rows for p, n in zip(own.integers(0, 180, 4).tolist(), own.choice([1, 2, 6, 11], 4).tolist(), strict=True) if p + n <= len(b)}
    table = spark.createDataFrame([(p, b.hex()) for p, b in rules], "pos int, bytes string")
    hexed = df.select("id", "attack", F.lower(F.hex("raw")).alias("hex"))
    hits = lambda p, r, side: sum(b[p : p + len(r)] == r for _, b, a in rows if a == side)
    want = {(p, r.hex(), hits(p, r, True), 0) for p, r in rules if hits(p, r, True) and not hits(p, r, False)}
    assert {tuple(r) for r in pipe.validated_rules(table, hexed, "attack").select("pos", "bytes", "tp", "fp").collect()} == want and want


def test_long_payloads_take_time_in_proportion(spark):
    """The place of a piece in a text was found by counting characters from its start, so time grew with the square of the length."""
    rows = [(i, bytes([97 + i]) * 150_000, True) for i in range(2)]
    df = spark.createDataFrame(rows, "id long, raw binary, attack boolean")
    began = time.perf_counter()
    rules = pipe.payload_candidates(df, "raw", "attack", 4)
    assert pipe.validated_rules(rules, df.select("attack", F.hex("raw").alias("hex")), "attack").count() == 2 * (150_000 - 3)
    assert time.perf_counter() - began < 60


def test_bytes_of_payloads_are_counted_in_batches(spark, monkeypatch):
    monkeypatch.setattr(pipe, "CHUNK_BYTES", 500)
    rows, df = payloads(spark)
    rows, df = [*rows, (99, None, True)], df.union(spark.createDataFrame([(99, None, True)], df.schema))
    each = spark.createDataFrame([(i, p, x, a) for i, b, a in rows if b for p, x in enumerate(b)], "id long, pos int, byte int, attack boolean")
    plain = lambda d, *c: sorted(map(repr, d.select(*c).collect()))
    counts = pipe.byte_counts(df, "raw", "attack")
    want = each.groupBy("pos", "byte").agg(F.sum(F.col("attack").cast("long")).alias("attacks"), F.sum((~F.col("attack")).cast("long")).alias("normals"))
    assert plain(counts, "pos", "byte", "attacks", "normals") == plain(want, "pos", "byte", "attacks", "normals")
    profile = ["pos", "top", "n", "total", "values", "concentration", "is_constant"]
    assert plain(pipe.profile_of(counts, "attacks", 0.5), *profile) == plain(pipe.position_profile(each.where("attack"), 0.5), *profile)
    mask = ["pos", "mask", "match", "n"]
    assert plain(pipe.mask_of(counts), *mask) == plain(pipe.best_mask(each.where("attack"), each.where("not attack")), *mask)
    run = ["id", "first", "last", "n"]
    assert plain(pipe.payload_runs(df, "id", "raw", 98, 2), *run) == plain(ordered.runs(each.where("byte = 98"), "pos", 2, ["id"]), *run)
    totals = pipe.payload_windows(each, 16).groupBy("id", "window").agg(F.count("*").alias("n"), F.sum("byte").alias("total"))
    assert plain(pipe.window_totals(df.select("id", "raw"), 16), "id", "window", "n", "total") == plain(totals, "id", "window", "n", "total")


def test_drill_down_of_payloads_is_that_of_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(pipe, "CHUNK_BYTES", 400)
    space, width = Space(64, 0), 16
    rows, df = payloads(spark, 40)
    rows[0] = (0, rows[2][1][:70] + bytes(range(40)), False)  # the reference
    rows = [(i, b[:40] + bytes(200 + x % 50 for x in b[40:60]) + b[60:] if i % 3 == 1 else b, a) for i, b, a in rows]
    df = spark.createDataFrame(rows, "k long, raw binary, attack boolean")
    each = spark.createDataFrame([(i, p, x, a) for i, b, a in rows for p, x in enumerate(b)], "k long, pos int, byte int, attack boolean")
    attack, normal = (each.where(w).select("k", "pos", "byte") for w in ("attack", "not attack"))
    want = {tuple(r) for r in app.drill_down(attack, normal, "k", F.col("k") == 0, space, width).collect()}
    attack, normal = (df.where(w).select("k", "raw") for w in ("attack", "not attack"))
    got = app.drill_payloads(attack, normal, F.col("k") == 0, space, width).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 50


def test_fields_are_tracked_without_a_walk_over_counts_per_row(spark):
    """Every live row looked at all counts of its field and at vectors one by one."""
    own, space = np.random.default_rng(2), Space(64, 0)
    values = [None if x == 7 else f"v{x}" for x in own.geometric(0.02, 9000).tolist()]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(values)], "field string, o long, value string")
    app.tracked_fields(df.where("o < 9"), df.where("o between 9 and 20"), "o", space).collect()
    began = time.perf_counter()
    got = app.tracked_fields(df.where("o < 300"), df.where("o >= 300"), "o", space).orderBy("o").collect()
    assert time.perf_counter() - began < 20 and len(got) == 8700
    atoms = {v: atom_array(space, f"f:{v}").astype(float) for v in set(values)}
    sums, counts = sum(atoms[v] for v in values[:300]), Counter(values[:300])
    prior = np.sign(sums)
    for r, v in zip(got, values[300:], strict=True):
        sums = 0.98 * sums + atoms[v]
        counts[v] += 1
        if sum(counts.values()) > 200:
            counts = Counter({k: n // 2 for k, n in counts.items() if n // 2})
        size = np.sqrt(sums @ sums)
        now = np.where(sums > 0.3 * size, 1, np.where(sums < -0.3 * size, -1, 0))
        top = min(counts, key=lambda k: (-counts[k], k is None, k or ""))
        assert (r["dominant"], r["concentration"]) == (top, pytest.approx(counts[top] / sum(counts.values())))
        both = np.sqrt((now @ now) * (prior @ prior))
        assert r["divergence"] == pytest.approx(1 - (now @ prior / both if both else 0), abs=1e-9) and r["novel"] == (v not in values[:300])


def test_a_field_that_is_shifted_is_encoded_once(spark):
    """Before, a shift worked its vector out again for each of its slices and sizes, and a row per value was not known."""
    df = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "t string")
    v = expr.compile(expr.Permute(expr.Permute(expr.Field("t"), 2), 3), SPACE)
    got = df.select("t", v.alias("v"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("sha2") == 0
    assert [r["v"] for r in got.collect()] == [None if r["t"] is None else np.roll(atom_array(SPACE, r["t"]), -5).tolist() for r in df.collect()]
    native = df.select(vectors.permute(atom_vector(SPACE, F.col("t")), 5).alias("v"))
    assert native._jdf.queryExecution().optimizedPlan().toString().count("sha2") == 1
