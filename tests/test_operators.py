"""Encoders, aggregates, search, streams, learners, expressions and dataflows."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trivex.client import Client
from trivex.config import Space
from trivex.functions import packed, scalars
from trivex.functions.atoms import atom_array, literal
from trivex.operators import aggregate as agg, match, ordered, reckoner
from trivex.operators.engrams import Library
from trivex.operators.subspace import Subspace, attribution, learn, learn_residuals, score, striped
from trivex.plans import expr as x, pipelines as pipe
from trivex.sources import codebook, encode as enc

SPACE = Space(1024)


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def cos(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    d = np.sqrt((a @ a) * (b @ b))
    return float(a @ b / d) if d else 0.0


# encoders

def test_json_twins_agree(spark):
    e = enc.Encoder(SPACE)
    doc = '{"b": {"y": 2, "x": "v"}, "a": [1, null, true], "n": {}, "l": [], "f": 100.0}'
    got = one(spark, enc.encode_json(SPACE, F.lit(doc)))
    assert (np.array(got) == e.value(enc.parse(doc))).all()
    assert (e.value("53", "p") == e.value(53, "p")).all() and (e.value(None, "p") == e.value("null", "p")).all()
    assert (e.value(enc.parse("100.0")) != e.value(100)).any()
    pq = packed.encode_json(spark.createDataFrame([(doc,), (None,)], "t string"), "t", SPACE).select(packed.unpack(F.col("v")).alias("v")).collect()
    assert pq[0][0] == got and pq[1][0] is None


def test_struct_equals_json(spark):
    df = spark.createDataFrame([("billing", 5, ("k", 2))], "type string, amount long, in struct<a: string, b: int>")
    s = df.select(F.struct("type", "amount", "in").alias("s"))
    got = s.select(enc.encode(SPACE, F.col("s"), s.schema["s"].dataType).alias("v"), enc.encode_json(SPACE, F.to_json("s")).alias("w")).first()
    assert got["v"] == got["w"]


def test_same_value_other_key_differs():
    e = enc.Encoder(SPACE)
    assert abs(cos(e.value({"src_port": 53}), e.value({"dst_port": 53}))) < 0.15
    base = {"type": "billing", "amount": 5, "id": 1}
    assert cos(e.value(base), e.value(base | {"amount": 6})) > 0.3


def test_numeric_markers():
    e = enc.Encoder(SPACE)
    at = lambda v: e.value({"rate": {"$log": v}})
    assert cos(at(100), at(120)) > cos(at(100), at(10_000))
    assert not e.value({"$log": -1}).any()
    assert (e.value({"$linear": 3, "$scale": 50.0}) == e.positional(3.0, 50.0)).all()


def test_bad_json(spark):
    with pytest.raises(Exception, match="Expecting|JSON"):
        one(spark, enc.encode_json(SPACE, F.lit("{")))
    assert one(spark, enc.encode_json(SPACE, F.lit("{"), strict=False)) is None


def test_stripes_and_leaves(spark):
    doc = {"method": "GET", "path": {"a": 1, "b": []}, "ip": "10.0.0.1"}
    e = enc.Encoder(SPACE)
    stripes = one(spark, enc.encode_json_striped(SPACE, F.lit(json.dumps(doc)), 4))
    want = [np.zeros(SPACE.dims, int) for _ in range(4)]
    for p, v in e.leaves(doc):
        want[enc.field_stripe(p, 4)] += e.leaf(v, p)
    assert all((np.array(s) == np.sign(w)).all() for s, w in zip(stripes, want, strict=True))
    assert [p for p, _ in e.leaves(doc)] == ["ip", "method", "path.a", "path.b"]
    assert not e.leaf({"a": 1}, "p").any()
    assert enc.field_stripe("", 1 << 64) == 0xCBF29CE484222325
    rows = enc.leaves(spark.createDataFrame([(json.dumps(doc),)], "j string"), "j").collect()
    assert ("path.a", "1") in {(r["path"], r["value"]) for r in rows}


def test_sets_lists_and_empties(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "a"], [])], "p array<string>, q array<string>, e array<string>")
    kind = df.schema["p"].dataType
    v = df.select(*[enc.encode(SPACE, F.col(c), kind, h, "w").alias(n) for n, c, h in (("ps", "p", {"w": "set"}), ("qs", "q", {"w": "set"}), ("pl", "p", {}), ("ql", "q", {}), ("e", "e", {}), ("es", "e", {"w": "set"}))]).first()
    assert v["ps"] == v["qs"] and v["pl"] != v["ql"]
    assert v["e"] == atom_array(SPACE, "w.[]").tolist() and v["es"] == atom_array(SPACE, "w.#{}").tolist()


def test_sequences(spark):
    of = lambda mode, *w: one(spark, enc.encode_sequence(SPACE, F.array(*map(F.lit, w)), mode))
    assert of("bundle", "a", "b", "c") == of("bundle", "c", "b", "a")
    assert cos(of("positional", "a", "b", "c"), of("positional", "c", "b", "a")) < 0.6
    a, b, c = (atom_array(SPACE, s) for s in "abc")
    assert of("chained", "a", "b", "c") == (a * b * c).tolist()
    assert of("ngram", "a", "b") == of("bundle", "a", "b")
    assert of("ngram", "a", "b", "c") == (a * np.roll(b, -1) * np.roll(c, -2)).tolist()
    assert not any(one(spark, enc.encode_sequence(SPACE, F.array().cast("array<string>"), "chained")))


def test_scalars(spark):
    c = Client(1024)
    v = lambda n: one(spark, c.encode_scalar(F.lit(float(n)), "linear", 100.0))
    assert v(1) == v(3) and v(1) == v(101) and v(1) != v(40)
    b, o = scalars.bases(SPACE)
    assert v(0) == b.tolist() and v(25) == o.tolist()
    for n in (3, 20, 40, 60, 80, 95):
        t = 2 * math.pi * n / 100
        assert v(n) == np.sign(b * math.cos(t) + o * math.sin(t)).astype(int).tolist()
    assert not any(one(spark, c.encode_scalar_log(F.lit(0.0))))
    assert one(spark, c.encode_scalar_log(F.lit(100.0))) == one(spark, c.encode_scalar_log(F.lit(1000.0)))
    th = one(spark, c.encode_scalar(F.lit(0.25), "thermometer", 0.0, 1.0))
    assert sum(x > 0 for x in th) == 256 and th == sorted(th, reverse=True)
    assert one(spark, scalars.thermometer_cosine(F.lit(0.25), F.lit(0.75), 0.0, 1.0, 1024)) == pytest.approx(cos(th, one(spark, c.encode_scalar(F.lit(0.75), "thermometer", 0.0, 1.0))))
    assert sum(one(spark, scalars.encode_f64(SPACE, F.lit(0.5009), "thermometer", 0.0, 1.0))) == -1024 + 2 * math.floor(0.5009 * 1024)
    back = one(spark, c.decode_scalar_log(c.encode_scalar_log(F.lit(5000.0))))
    assert one(spark, c.encode_scalar_log(F.lit(back * 1.0001))) == one(spark, c.encode_scalar_log(F.lit(5000.0)))


def test_time(spark):
    t = 1_700_000_000.0
    v = lambda s: one(spark, scalars.encode_time(SPACE, F.lit(s)))
    assert cos(v(t), v(t + 3600)) > cos(v(t), v(t + 12 * 3600))
    p = one(spark, scalars.time_parts(scalars.seconds(F.lit(0.0))))
    assert (p["hour"], p["dow"], p["month"]) == (0.0, 4.0, 0.0)
    assert one(spark, scalars.time_parts(F.lit(-1.0)))["dow"] == 3.0


# aggregates and search

def rows(spark, m, extra=None):
    extra = extra or [0] * len(m)
    return spark.createDataFrame([(i, [int(y) for y in r], k) for i, (r, k) in enumerate(zip(m, extra, strict=True))], "idx long, v array<tinyint>, k int")


@pytest.mark.parametrize("native", [128, 0])
def test_bundles(spark, monkeypatch, native):
    monkeypatch.setattr(agg, "NATIVE_DIMS", native)
    m = np.array([[1, 1, -1, 0], [1, -1, -1, 0], [1, 0, 1, 0]])
    df = rows(spark, m, [0, 0, 1])
    assert {r["k"]: r["v"] for r in agg.bundle(df, ["k"], "v", 4).collect()} == {0: [1, 0, -1, 0], 1: [1, 0, 1, 0]}
    assert agg.bundle(df, [], "v", 4, F.when(F.col("k") == 1, 5.0).otherwise(1.0)).first()["v"] == [1, 0, 1, 0]
    assert agg.prototype(df, [], "v", 4, 0.5).first()["v"] == [1, 0, 0, 0]
    assert agg.prototype(df, [], "v", 4, 0.0).first()["v"][1] == 1
    c = agg.bundle_with_confidence(df, [], "v", 4).first()
    assert c["margin"] == pytest.approx([1, 0, 1 / 3, 0])
    pairs = [cos(m[i], m[j]) for i in range(3) for j in range(i)]
    assert agg.coherence(df, [], "v", 4).first()["coherence"] == pytest.approx(np.mean(pairs))
    assert agg.coherence(df.limit(1), [], "v", 4).first()["coherence"] == 1.0


def test_accumulators(spark):
    m = np.array([[1, -1], [1, 1], [1, 0]])
    a = agg.accumulate(rows(spark, m), [], "v", 2)
    assert (a.first()["sums"], a.first()["n"]) == ([3.0, 0.0], 3)
    assert one(spark, agg.purity(literal([3.0, 0.0], "double"), F.lit(3))) == pytest.approx(2 / 9)
    assert one(spark, agg.participation_ratio(literal([1.0, 1.0], "double"))) == pytest.approx(2)
    assert one(spark, agg.capacity(literal([0.0, 0.0], "double"), 10)) == 1.0
    d = agg.decayed(rows(spark, m).withColumn("r", F.col("idx") + 1), [], "v", 2, "r", 0.5).first()["sums"]
    assert d == pytest.approx([1.75, 0.25])
    merged = agg.merge(a, a, [], 2).first()
    assert (merged["sums"], merged["n"]) == ([6.0, 0.0], 6)
    assert one(spark, agg.normalize_f64(literal([3.0, 4.0], "double"))) == pytest.approx([0.6, 0.8])
    assert one(spark, agg.decay(literal([2.0], "double"), 0.5)) == [1.0]


@pytest.mark.parametrize("small", [True, False])
def test_search(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(match, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(match, "BLOCK", 7)
    g = np.random.default_rng(0)
    book, q = g.integers(-1, 2, (40, 32)), g.integers(-1, 2, (9, 32))
    book[5] = book[3]
    q[0] = book[3]
    q[1] = 0
    b, qs = rows(spark, book).select("idx", "v"), rows(spark, q).select(F.col("idx").alias("qid"), "v")
    want = {}
    for i, r in enumerate(q):
        s = [cos(r, c) for c in book]
        want[i] = sorted(range(40), key=lambda j: (-round(s[j], 12), j))
    got = {}
    for r in match.topk_similar(qs, b, 5).collect():
        got.setdefault(r["qid"], {})[r["rank"]] = r["idx"]
    assert {i: [v[k] for k in sorted(v)] for i, v in got.items()} == {i: w[:5] for i, w in want.items()}
    best = {r["qid"]: r["idx"] for r in match.cleanup(qs, b).collect()}
    assert best[0] == 3 and len(best) == 9
    assert all(r["sim"] >= 0.2 for r in match.invert(qs, b, 10, 0.2).collect())
    mat = {(r["i"], r["j"]): r["sim"] for r in match.similarity_matrix(b.limit(4)).collect()}
    assert len(mat) == 16 and mat[1, 1] == 1.0 and mat[0, 1] == pytest.approx(mat[1, 0])
    assert match.cleanup(qs, b.limit(0)).count() == 0


def test_codebooks(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "w string")
    book = codebook.codebook(df, "w", Space(32))
    assert book.count() == 2 == codebook.cache_size(book)
    codebook.export_codebook(book.withColumn("v", F.array(F.lit(1).cast("tinyint"))), str(tmp_path / "b"))
    other = codebook.codebook(df.where("w = 'a'").union(df.sparkSession.createDataFrame([("c",)], "w string")), "w", Space(32))
    both = {r["atom"]: r["v"] for r in codebook.import_codebook(spark, str(tmp_path / "b"), other).collect()}
    assert both["a"] == [1] and len(both["c"]) == 32 and len(both) == 3
    assert codebook.with_vectors(df, "w", book).where("v is null").count() == 1


# streams

def test_streams(spark):
    m = np.array([[1, 1, 1, 1]] * 5 + [[-1, 1, -1, 1]] * 5)
    s = rows(spark, m).select(F.col("idx").alias("seq"), "v")
    assert [r["seq"] for r in ordered.segment(s, 3, 0.5, "diff", 4).orderBy("seq").collect()] == [0, 5]
    assert [r["seq"] for r in ordered.segment(s, 3, 0.5, "prototype", 4).orderBy("seq").collect()][:2] == [0, 5]
    assert [r["seq"] for r in ordered.segment(s.limit(0), 3, 0.5, "diff", 4).collect()] == []
    alt = rows(spark, np.array([[1, 1], [-1, -1]] * 4)).select(F.col("idx").alias("seq"), "v")
    assert {r["lag"]: round(r["corr"], 6) for r in ordered.autocorrelate(alt, 99).collect()} == {k: (-1.0) ** k for k in range(8)}
    x_ = {r["lag"]: r["corr"] for r in ordered.cross_correlate(alt, alt, 2).collect()}
    assert x_[1] == pytest.approx(-1)
    sims = [cos(m[i], m[i - 1]) for i in range(1, 10)]
    smooth = [np.mean(sims[max(0, i - 3) : i]) if i >= 3 else sims[i - 1] for i in range(1, 10)]
    d = [r["drift"] for r in ordered.drift_rate(s, 3).orderBy("seq").collect()]
    assert d == pytest.approx(np.diff(smooth))
    n = ordered.numbered(spark.createDataFrame([(float(v),) for v in (5, 1, 9, 3)], "o double"), "o")
    assert [r["seq"] for r in n.orderBy("o").collect()] == [0, 1, 2, 3]


def test_numbers_are_whole_in_large_streams(spark):
    # far more rows in a range than its bounds are sampled from, and a value that a third of the rows have
    for mod in (1, 2):
        n = 300_000
        df = spark.range(n, numPartitions=3).select((F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") * 7919 % n) if mod == 2 else F.col("id") * 7919 % n).alias("o"), "id")
        got = ordered.numbered(df, "o")
        low, high, k, m, s = got.agg(F.min("seq"), F.max("seq"), F.count("*"), F.count_distinct("seq"), F.count_distinct("id")).first()
        assert (low, high, k, m, s) == (0, n - 1, n, n, n)
        w = got.join(got.select((F.col("seq") + 1).alias("seq"), F.col("o").alias("before")), "seq")
        assert w.where("o < before").count() == 0
    assert ordered.numbered(df.limit(0), "o").count() == 0
    again = {r["id"]: r["seq"] for r in ordered.numbered(df, "o").where("id < 500").collect()}
    assert again == {r["id"]: r["seq"] for r in got.where("id < 500").collect()}


def test_nested_items_and_scales_encode_as_their_json(spark):
    from trivex.sources import encode as enc

    space = Space(48, 0)
    row = {"a": [{"x": "p", "y": 1}, {"x": "q", "y": 2}], "m": {"k": ["u", "v"], "l": []}, "n": [["a", "b"], []], "s": {"$linear": 7.5, "$scale": 20.0}, "z": {"$log": 100.0, "$scale": 0.0}}
    schema = "a array<struct<x string, y long>>, m map<string, array<string>>, n array<array<string>>, s struct<`$linear` double, `$scale` double>, z struct<`$log` double, `$scale` double>"
    df = spark.createDataFrame([row], schema)
    for name in df.columns:
        c = F.struct(F.col(name))
        kind = df.select(c.alias("c")).schema["c"].dataType
        got, want = df.select(enc.encode(space, c, kind), enc.encode_json(space, F.to_json(c))).first()
        assert got == want, name


def test_values_are_encoded_once(spark):
    from trivex.sources.codebook import encoded_once

    df = spark.createDataFrame([(i, "ab"[i % 2] if i % 5 else None) for i in range(20)], "id long, x string")
    got = encoded_once(df, "x", lambda c: F.coalesce(F.upper(c), F.lit("-")))
    assert {r["id"]: r["v"] for r in got.collect()} == {i: "AB"[i % 2] if i % 5 else "-" for i in range(20)}


def test_chains_and_changepoints_over_many_ranges(spark):
    g = np.random.default_rng(5)
    at = np.unique(np.concatenate((g.integers(0, 4000, 250), np.arange(5000, 5200, 3))))
    got = {r["seq"]: r["chain"] for r in ordered.chains(spark.createDataFrame([(int(x),) for x in at], "seq long").repartition(5), 12).collect()}
    want, first, last = {}, None, None
    for x in at.tolist():
        first = x if last is None or x - last > 12 else first
        want[x], last = first, x
    assert got == want
    kept, last = [], None
    for x in at.tolist():
        if last is None or x - last > 12:
            kept.append(x)
            last = x
    assert [r["seq"] for r in pipe.consolidated(spark.createDataFrame([(int(x),) for x in at], "seq long"), 12).orderBy("seq").collect()] == kept


# learners

def low_rank(n, dim=32, rank=3, seed=0):
    g = np.random.default_rng(seed)
    return g.normal(size=(n, rank)) @ g.normal(size=(rank, dim))


def test_subspace_learns():
    s = Subspace(32, 4)
    xs = low_rank(400)
    s.update_batch(xs)
    far = np.random.default_rng(9).normal(size=32) * 5
    assert s.residual(xs[0]) < 0.3 * s.residual(far)
    assert s.residual(far) > s.threshold() and Subspace(8, 2).threshold() == float("inf")
    back = Subspace.restore(s.snapshot())
    assert back.residual(far) == pytest.approx(s.residual(far)) and back.threshold() == s.threshold()
    assert s.alignment(s) == pytest.approx(1) and s.alignment(Subspace(32, 2)) == 0.0
    assert np.allclose(s.reconstruct(far) + s.anomalous_component(far), far)
    with pytest.raises(ValueError):
        s.update(np.zeros(3))
    grow = Subspace(32, 2)
    grow.update_batch(np.random.default_rng(1).normal(size=(300, 32)))
    assert grow.k > 2
    t = Subspace(32, 4)
    first = low_rank(1)[0]
    assert t.update(first) == pytest.approx(np.sqrt(first @ first))


def test_subspace_tables(spark):
    xs = low_rank(120)
    df = spark.createDataFrame([(i % 2, i, [float(y) for y in r]) for i, r in enumerate(xs)], "g int, seq long, v array<double>")
    twin = [Subspace(32, 3) for _ in range(2)]
    want = [twin[i % 2].update(r) for i, r in enumerate(xs)]
    got = learn_residuals(df, "g", "seq", "v", 3).orderBy("seq").collect()
    assert [r["residual"] for r in got] == pytest.approx(want)
    models = learn(df, "g", "seq", "v", 3)
    with pytest.raises(ValueError):
        learn(df.withColumnRenamed("g", "k"), "k", "seq", "v", 3)
    s = score(df, models, "g", "v").orderBy("seq").collect()
    assert [r["residual"] for r in s] == pytest.approx([twin[i % 2].residual(r) for i, r in enumerate(xs)])
    rss = striped(score(df, models, "g", "v").withColumn("rec", F.floor(F.col("seq") / 2)), ["rec"]).orderBy("rec").first()
    assert rss["residual"] == pytest.approx(np.hypot(s[0]["residual"], s[1]["residual"]))
    drop = attribution({"a": 1, "b": 2}, {"a": 5, "b": 2}, lambda d: float(d["a"]))
    assert drop == [("a", 4.0)]


def test_engrams(spark, tmp_path):
    a, b = Subspace(32, 3), Subspace(32, 3)
    a.update_batch(low_rank(150, seed=1))
    b.update_batch(low_rank(150, seed=2))
    lib = Library.empty(spark).add("a", a, {"f": 1.0}, {"m": "x"}).add("b", b).add("a", a)
    assert len(lib) == 2 and lib.contains("a") and not lib.is_empty()
    probe = spark.createDataFrame([(7, [float(y) for y in low_rank(150, seed=2)[3]])], "q long, v array<double>")
    got = lib.match_vec(probe, "q", "v", 2).orderBy("rank").collect()
    assert [r["name"] for r in got] == ["b", "a"] and got[0]["residual"] == pytest.approx(b.residual(probe.first()["v"]))
    assert lib.match_spectrum(a.eigenvalues(), 1).first()["name"] == "a"
    assert lib.match_spectrum([0.0, 0.0], 1).count() == 0
    assert lib.match_alignment(b, 1).first()["name"] == "b"
    lib.copy("a", "c").remove("b").save(str(tmp_path / "lib"), "json")
    assert [r["name"] for r in Library.load(spark, str(tmp_path / "lib"), "json").names().collect()] == ["a", "c"]


def test_reckoner(spark):
    g = np.random.default_rng(0)
    centers = [g.integers(-1, 2, 64) for _ in range(3)]
    data = [(i, [int(y) for y in np.where(g.random(64) < 0.2, g.integers(-1, 2, 64), centers[i % 3])], i % 3) for i in range(300)]
    df = spark.createDataFrame(data, "seq long, v array<tinyint>, label int")
    d = reckoner.observed(df, "label", "seq", "v", 64, 3, 100)
    sums = {k: sum(np.array(v) for i, v, y in data[:299] if y == k) for k in range(3)}
    twin = reckoner.Discriminants(sums, 3)
    assert np.allclose(d.disc, twin.disc) and d.ready
    got = reckoner.predict(df, "v", d).collect()
    assert np.mean([r["direction"] == r["label"] for r in got]) > 0.95
    assert not reckoner.observed(df.limit(50), "label", "seq", "v", 64, 3, 100).ready
    r = spark.createDataFrame([(i, i / 2000, bool(g.random() < 0.5 + 0.4 * i / 2000)) for i in range(2000)], "o long, c double, w boolean")
    fit = reckoner.curve(r, "c", "w", "o", 2).first()
    assert fit["b"] > 0
    assert one(spark, reckoner.accuracy_at(F.lit(5.0), F.lit(fit["a"]), F.lit(fit["b"]), 2)) <= 0.99
    assert reckoner.curve(r.limit(10), "c", "w", "o", 2).count() == 0
    c = reckoner.Continuous(64, 8, default=-1.0)
    assert c.query(np.ones(64)) == -1.0
    for i in range(300):
        c.observe(centers[i % 2], 10.0 if i % 2 else 90.0)
    assert c.query(centers[1]) < c.query(centers[0])


# expressions

def test_expressions(spark):
    e = x.Bundle((x.Bind(x.symbol("a"), x.Thermometer(5.0, 0.0, 10.0)), x.Permute(x.String("s"), 2)))
    assert x.slots(e) == [5.0] and x.ranges(e) == [(0.0, 10.0)]
    other = x.Bundle((x.Bind(x.symbol("a"), x.Thermometer(7.0, 0.0, 10.0)), x.Permute(x.String("s"), 2)))
    assert x.template(e) == x.template(other) and e != other and hash(x.template(e)) == hash(x.template(other))
    assert x.as_symbol(x.symbol("q")) == "q" and x.as_keyword(x.keyword(":k")) == "k" and x.as_tag(x.tag("#t")) == "t" and x.is_nil(x.nil())
    assert x.as_symbol(x.keyword("k")) is None and x.value_of(x.I64(3), x.I64) == 3 and x.value_of(x.I64(3), x.F64) is None
    assert x.atom_inner(x.Atom(x.I64(1))) == x.I64(1)
    kinds = [x.String("1"), x.I64(1), x.F64(1.0), x.Bool(True), x.Char("1"), x.Atom(x.I64(1))]
    assert len({x.canonical(k) for k in kinds}) == 6
    assert x.F64(0.0) != x.F64(-0.0)
    assert all(abs(cos(x.array(a, SPACE), x.array(b, SPACE))) < 0.15 for i, a in enumerate(kinds) for b in kinds[:i])
    assert not x.array(x.Bundle(()), SPACE).any()
    with pytest.raises(ValueError):
        x.array(x.Slot(0.0, 1.0), SPACE)
    assert x.simplify(x.Permute(x.Permute(x.String("s"), 2), -2)) == x.String("s")
    assert one(spark, x.compile(e, SPACE)) == x.array(e, SPACE).tolist()
    f = x.Blend(x.Field(F.lit("w")), x.Permute(x.String("s"), 3), 1.0, -0.5)
    want = np.sign(atom_array(SPACE, "w") - 0.5 * np.roll(x.array(x.String("s"), SPACE), -3)).astype(int)
    assert one(spark, x.compile(f, SPACE)) == want.tolist()


# dataflows

def test_detection(spark):
    flags = [0] * 20 + [1] * 15 + [0] * 15
    df = spark.createDataFrame([(0, i, bool(f)) for i, f in enumerate(flags)], "k int, seq long, hit boolean")
    on = [r["alarm"] for r in pipe.hysteresis(df, "k", "seq", "hit").orderBy("seq").collect()]
    assert not any(on[:20]) and on[34] and not on[-1]
    v = spark.createDataFrame([(0, i, [1, 1, 1, -1] if i != 6 else [-1, -1, 1, 1], [1, 1] if i != 6 else [-1, -1]) for i in range(10)], "k int, seq long, p array<tinyint>, r array<tinyint>")
    assert [r["seq"] for r in pipe.self_training(v, "k", "seq", "p", "r").where("anomalous").collect()] == [6]
    assert pipe.golden_section(lambda t: -((t - 2.5) ** 2), 0, 10) == pytest.approx(2.5, abs=1e-6)
    assert pipe.greedy_cover({"a": {1, 2}, "b": {2, 3, 4}, "c": {4}}) == ["b", "a"]
    assert [r["seq"] for r in pipe.consolidated(spark.createDataFrame([(s,) for s in (0, 5, 13, 20, 26)], "seq long")).orderBy("seq").collect()] == [0, 13, 26]
    assert one(spark, pipe.explanation("rate", F.lit(-3.0))) == "rate 3.0 std below baseline"
    assert one(spark, pipe.mask_match(F.lit(0xAB), F.lit(0xF0), F.lit(0xA0)))


def test_rules(spark):
    f = spark.createDataFrame([("t", i, "tcp", "80" if i % 10 else str(i)) for i in range(50)], "key string, id int, proto string, port string")
    base = spark.createDataFrame([("proto", "tcp", 1.0), ("port", "443", 0.9)], "field string, top string, concentration double")
    rule = pipe.mitigation_rules(pipe.unpivot(f, ["key"], ["proto", "port"]), base).first()["rule"]
    assert json.loads(rule) == [{"field": "port", "equals": "80"}]
    p = spark.createDataFrame([("aabbcc", True), ("aabb00", True), ("ddbbcc", False)], "hex string, attack boolean")
    rules = spark.createDataFrame([(0, "aabb"), (1, "bb")], "pos int, bytes string")
    assert [(r["pos"], r["tp"], r["fp"]) for r in pipe.validated_rules(rules, p, "attack").collect()] == [(0, 2, 0)]
    many = spark.range(12_000).select((F.col("id") % 50).cast("int").alias("pos"), F.lpad(F.hex("id"), 4, "0").alias("bytes"))
    p = spark.createDataFrame([("00" * 49 + f"{i:04X}", i % 2 == 0) for i in range(0, 12_000, 7)], "hex string, attack boolean")
    want = {(49, f"{i:04X}") for i in range(0, 12_000, 7) if i % 2 == 0 and i % 50 == 49}
    got = {(r["pos"], r["bytes"]) for r in pipe.validated_rules(many, p, "attack").collect()}
    assert {x for x in got if x[0] == 49} == want


def test_streaming(spark, tmp_path):
    from trivex.streaming.stateful import accumulate, anomalies
    from trivex.streaming.windows import windowed_bundle

    src = tmp_path / "in"
    g = np.random.default_rng(0)
    data = [(i % 2, i, f"2024-01-01 00:{i // 2:02d}:00", [int(y) for y in g.integers(-1, 2, 8)]) for i in range(60)]
    df = spark.createDataFrame(data, "k int, seq long, t string, v array<tinyint>").withColumn("ts", F.to_timestamp("t"))
    df.write.parquet(str(src))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(src))

    def drain(out, name, mode):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    got = {r["start"]: r["v"] for r in drain(windowed_bundle(stream(), "ts", "v", 8, "10 minutes", late="1 minute"), "w1", "append")}
    want = {r["start"]: r["v"] for r in windowed_bundle(df, "ts", "v", 8, "10 minutes").collect()}
    assert got and all(want[k] == v for k, v in got.items())
    acc = {r["k"]: (r["n"], r["sums"]) for r in drain(accumulate(stream(), "k", "v", 8), "a1", "update")}
    assert acc[0][0] == 30 and acc[0][1] == [float(s) for s in np.sum([d[3] for d in data if d[0] == 0], 0)]
    rows_ = drain(anomalies(stream(), "k", "seq", "v", 2), "s1", "append")
    assert len(rows_) == 60 and all(r["residual"] >= 0 for r in rows_)
    assert windowed_bundle(df, "ts", "v", 8, "5 minutes", session=True, keys=["k"]).count() == 2


def test_client(spark):
    c = Client(64)
    got = spark.range(1).select(c.similarity(c.bind(c.get_vector("a"), c.get_vector("b")), c.bind(c.get_vector("b"), c.get_vector("a"))).alias("s")).first()[0]
    assert got == pytest.approx(1.0)
    assert c.dimensions == 64 and len(c.encode_value({"a": 1})) == 64
    assert one(spark, c.significance(F.lit(0.5))) == 4.0
    with pytest.raises(AttributeError):
        c.nothing
