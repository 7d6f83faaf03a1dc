"""Application pipelines against plain numpy and Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trivex.config import Space
from trivex.functions.atoms import atom_array
from trivex.operators import match, subspace
from trivex.operators.engrams import Library
from trivex.operators.subspace import Striped, Subspace
from trivex.plans import applications as app

g = np.random.default_rng(8)


def tern(n, d):
    return g.integers(-1, 2, (n, d))


def table(spark, m, name="v"):
    return spark.createDataFrame([(i, [int(x) for x in r]) for i, r in enumerate(m)], f"idx long, {name} array<tinyint>")


def cos(a, b):
    s = np.sqrt((a @ a) * (b @ b))
    return float(a @ b / s) if s else 0.0


def test_warm_up_over_ranges(spark):
    m = tern(60, 12)
    m[33] = 0
    got = {r["seq"]: r["sim"] for r in app.running_similarity(table(spark, m).repartition(3), "idx", "v", 12, 20).collect()}
    assert got == {i: pytest.approx(cos(m[i], np.sign(m[: i + 1].sum(0)))) for i in range(20, 60)}
    base = app.warm_up_baseline(table(spark, m), "idx", "v", 12, 20).first()
    assert base["sim_mean"] == pytest.approx(np.mean(list(got.values()))) and base["sim_std"] == pytest.approx(max(0.02, np.std(list(got.values()))))


def test_tiers(spark):
    m = tern(20, 10)
    m[3] = 0
    t = table(spark, m).withColumn("t", F.when(F.col("idx") < 1, "a").when(F.col("idx") < 9, "b").otherwise("c"))
    of = {"a": m[:1], "b": m[1:9], "c": m[9:]}
    for r in app.tier_similarity(t, "t", "v", 10).collect():
        a, b = of[r["a"]], of[r["b"]]
        c = [cos(x, y) for i, x in enumerate(a) for j, y in enumerate(b) if r["a"] != r["b"] or i < j]
        assert r["mean"] == pytest.approx(np.mean(c) if c else 0.0, abs=1e-9)


def test_projection_on_two_attacks(spark):
    m = tern(30, 16)
    base, a, b = tern(3, 16)
    lit = lambda x: F.array(*[F.lit(int(y)) for y in x]).cast("array<tinyint>")
    got = {r["idx"]: r for r in app.projection_detector(table(spark, m), F.col("v"), lit(base), [a, b]).collect()}
    q, _ = np.linalg.qr(np.stack([a, b], 1).astype(float))
    for i, v in enumerate(m):
        p = v * base
        inside = q @ (q.T @ v)
        size = np.sqrt((np.abs(inside) > 1e-9).sum())
        assert got[i]["attack_share"] == pytest.approx(size / (np.sqrt((v * v).sum()) + 1e-10))
        assert got[i]["disagreement"] == pytest.approx((p < 0).sum() / max(1, (p != 0).sum()))
        assert got[i]["anomalous"] == (got[i]["disagreement"] > 0.06 or (cos(v, base) < 0.4 and got[i]["attack_share"] > 0.6))


def bytes_table(spark, payloads):
    return spark.createDataFrame([(k, i, b) for k, p in payloads.items() for i, b in enumerate(p)], "k long, pos int, byte int")


def test_drill_down(spark):
    space, width = Space(256, 0), 8
    normal = {i: bytes(g.integers(97, 100, 24).tolist()) for i in range(6)}
    attack = {100 + i: normal[i][:8] + bytes(g.integers(200, 256, 8).tolist()) + normal[i][16:] for i in range(3)}
    got = {(r["k"], r["pos"]) for r in app.drill_down(bytes_table(spark, attack), bytes_table(spark, normal), "k", F.col("k") == 0, space, width).collect()}
    bound = lambda i, b: atom_array(space, f"p{i % width}").astype(int) * atom_array(space, f"0x{b:02x}")
    window = lambda p, w: np.sign(sum(bound(i, p[i]) for i in range(w * width, (w + 1) * width)))
    want = set()
    for w in range(3):
        base = np.sign(sum(window(p, w) for p in normal.values()))
        for k, p in attack.items():
            if cos(window(normal[0], w), base) - cos(window(p, w), base) > 0.015:
                want |= {(k, i) for i in range(w * width, (w + 1) * width) if cos(bound(i, p[i]), base) < 0.005}
    assert got == want and {i for _, i in got} & set(range(8, 16))


def test_gap_probe(spark):
    normal = {i: bytes([1, 2, 3, 4, 5, 6, 7, 8, 9, 10 + i]) for i in range(3)}
    attack = {i: bytes([9, 2, 3, 9, 5, 6, 9, 8, 9, 10]) for i in range(30)} | {29: bytes([1, 2, 9, 4, 5, 6, 7, 8, 9, 10])}
    found = spark.createDataFrame([(4,), (5,)], "pos int")
    assert {r["pos"] for r in app.gap_probe(found, bytes_table(spark, attack), bytes_table(spark, normal), "k", 4, 20).collect()} == {0, 3, 4, 5, 6}
    assert {r["pos"] for r in app.gap_probe(found, bytes_table(spark, attack), bytes_table(spark, normal), "k", 1, 20).collect()} == {3, 4, 5, 6}


def first_fit(rules, payloads, most, slots, short):
    covered, used, out = set(), set(), []
    for rank, pos, b in rules:
        if len(out) >= most:
            break
        n = len(b) // 2
        if n <= short and (pos, n) not in used and len(used) >= slots:
            continue
        new = {i for i, h in payloads if h[2 * pos : 2 * pos + 2 * n] == b} - covered
        if new:
            out.append(rank)
            covered |= new
            if n <= short:
                used.add((pos, n))
    return out


@pytest.mark.parametrize(("most", "slots"), [(32, 7), (32, 2), (3, 7)])
def test_rules_are_taken_first_fit(spark, most, slots):
    own = np.random.default_rng(most + slots)
    payloads = [(i, own.integers(0, 3, 12).astype(np.uint8).tobytes().hex()) for i in range(60)]
    rules, seen = [], set()
    for _ in range(40):
        pos, n = int(own.integers(0, 8)), int(own.choice([1, 2, 6]))
        b = payloads[int(own.integers(0, 60))][1][2 * pos : 2 * pos + 2 * n]
        if len(b) == 2 * n and (pos, b) not in seen:
            seen.add((pos, b))
            rules.append((len(rules), pos, b))
    got = app.select_rules(spark.createDataFrame(rules, "rank long, pos int, bytes string"), spark.createDataFrame(payloads, "id long, hex string"), most, slots)
    assert sorted(r["rank"] for r in got.collect()) == first_fit(rules, payloads, most, slots, 4)


def test_smoothed_rate(spark):
    times = np.cumsum(g.choice([0.0, 0.001, 0.5, 2.0], 80)).round(6)
    rows = [("a", 1_700_000_000_000_000 + round(t * 1e6)) for t in times]
    df = spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_micros("s").alias("ts"))
    got = [r["rate"] for r in app.smoothed_rate(df, "k", "ts", 10).collect()]
    want, rate, seen = [], 100.0, []
    for t in times.tolist():
        gap = t - seen[-1] if seen else None
        rate = 0.1 * (100.0 if gap is None else 1 / gap if gap > 1e-9 else 1e6) + 0.9 * rate
        seen = [*seen, t][-10:]
        span = seen[-1] - seen[0]
        want.append(max(rate, rate if len(seen) < 2 else 1e6 if span < 1e-9 else (len(seen) - 1) / span))
    assert got == pytest.approx(want, rel=1e-4)


def test_tracked_fields(spark):
    space = Space(64, 0)
    warm = [("f", i, "ab"[i % 2]) for i in range(20)]
    live = [("f", 100 + i, "abc"[i % 3] if i < 60 else "z") for i in range(300)]
    form = "field string, o long, value string"
    got = app.tracked_fields(spark.createDataFrame(warm, form), spark.createDataFrame(live, form), "o", space).orderBy("o").collect()
    sums = sum(atom_array(space, f"f:{v}").astype(float) for _, _, v in warm)
    prior, counts = np.sign(sums), {"a": 10, "b": 10}
    for r, (_, o, v) in zip(got, live, strict=True):
        sums = 0.98 * sums + atom_array(space, f"f:{v}")
        counts[v] = counts.get(v, 0) + 1
        if sum(counts.values()) > 200:
            counts = {k: n // 2 for k, n in counts.items() if n // 2}
        unit = sums / np.sqrt(sums @ sums)
        now = np.where(unit > 0.3, 1, np.where(unit < -0.3, -1, 0))
        assert r["o"] == o and r["divergence"] == pytest.approx(1 - cos(now, prior)) and r["novel"] == (v not in "ab")
        top = min(counts, key=lambda k: (-counts[k], k))
        assert (r["dominant"], r["concentration"]) == (top, pytest.approx(counts[top] / sum(counts.values())))


def test_striped_models(spark):
    x = g.normal(size=(40, 3, 6))
    df = spark.createDataFrame([("k", i, [[float(y) for y in s] for s in r]) for i, r in enumerate(x)], "g string, seq long, s array<array<double>>")
    twin = Striped(6, 2, 3)
    before = [twin.update(r) for r in x]
    models = subspace.learn_striped(df, "g", "seq", "s", 2)
    got = subspace.score_striped(df, models, "g", "seq", "s").orderBy("seq").collect()
    for r, v in zip(got, x, strict=True):
        assert r["profile"] == pytest.approx(twin.residual_profile(v)) and r["residual"] == pytest.approx(twin.residual(v))
        assert r["threshold"] == pytest.approx(twin.threshold()) and r["anomalous"] == (r["residual"] > r["threshold"])
    again = Striped.restore(twin.snapshot())
    assert (len(again), again.dim, again.k, again.n) == (3, 6, twin.k, 40) and again.residual(x[0]) == pytest.approx(twin.residual(x[0]))
    assert again.anomalous_component(x[0], 1) == pytest.approx(twin.stripes[1].anomalous_component(x[0][1]))
    assert before[0] == pytest.approx(np.sqrt((x[0] ** 2).sum())) and Striped(6, 2, 3).threshold() == float("inf")
    with pytest.raises(ValueError):
        twin.update(x[0][:2])


def test_large_libraries_and_models_give_the_same(spark, monkeypatch):
    plain = lambda out: sorted(repr([round(x, 9) if isinstance(x, float) else x for x in r]) for r in out.collect())
    x = g.normal(size=(60, 8))
    df = spark.createDataFrame([(i % 3, i, [float(y) for y in r]) for i, r in enumerate(x)], "g int, seq long, v array<double>")
    models = subspace.learn(df, "g", "seq", "v", 2)
    lib = Library.empty(spark).add_models(models, "g")
    small = [plain(lib.match_vec(df, "seq", "v", 2)), plain(subspace.score(df, models, "g", "v"))]
    from trivex.operators import engrams

    monkeypatch.setattr(engrams, "SENT_BYTES", 200)
    monkeypatch.setattr(engrams, "GROUP_ROWS", 7)
    monkeypatch.setattr(subspace, "SENT_BYTES", 0)
    monkeypatch.setattr(subspace, "GROUP_ROWS", 7)
    large = [plain(lib.match_vec(df, "seq", "v", 2)), plain(subspace.score(df, models, "g", "v"))]
    assert large == small


def test_blocks_of_queries_and_codebook_give_the_same(spark, monkeypatch):
    m = table(spark, tern(50, 12))
    q = m.select(F.col("idx").alias("qid"), "v")
    small = sorted(map(repr, match.topk_similar(q, m, 4).collect()))
    monkeypatch.setattr(match, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(match, "BLOCK", 9)
    assert sorted(map(repr, match.topk_similar(q, m, 4).collect())) == small


def test_memory_cycle(spark, tmp_path):
    g2 = np.random.default_rng(3)
    bases = [g2.normal(size=(2, 10)) for _ in range(2)]
    x = np.stack([g2.normal(size=2) @ bases[i % 2] for i in range(120)])
    df = spark.createDataFrame([(i % 2, i, [float(y) for y in r]) for i, r in enumerate(x)], "g int, seq long, v array<double>")
    recalled, scored = app.memory_cycle(df, df, "g", "seq", "v", 2, str(tmp_path / "lib"), "seq")
    right = [r["name"] == str(r["seq"] % 2) for r in recalled.collect()]
    assert sum(right) >= 115
    twin = {k: Subspace(10, 2) for k in (0, 1)}
    for i, r in enumerate(x):
        twin[i % 2].update(r)
    for r in scored.collect():
        assert r["residual"] == pytest.approx(twin[r["g"]].residual(x[r["seq"]]), abs=1e-9)


def test_off_hours_can_be_joined(spark, tmp_path):
    from trivex.plans.catalog import QUERIES

    ts = F.timestamp_seconds(1_700_000_000 + F.col("id") * 5000).cast("timestamp_ntz").alias("ts")
    spark.range(200).select(F.col("id").alias("event_id"), F.concat(F.lit("t"), F.col("id") % 3).alias("event_type"), ts).write.parquet(str(tmp_path / "events.parquet"))
    df = QUERIES["off_hours"](spark, str(tmp_path))
    rows = df.collect()
    assert len(rows) == 200 and not any(r.residual is None or r.anomalous is None for r in rows)
    assert df.alias("x").join(df.alias("y"), "residual").where("x.event_id = y.event_id").count() == 200
