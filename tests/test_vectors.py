"""Exact micro-vectors and laws of the row-wise algebra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trivex.config import Space
from trivex.functions import packed, similarity as sim, vectors as vec
from trivex.functions.atoms import atom_array, atom_vector, literal


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def lit(*xs):
    return literal(xs)


@pytest.mark.parametrize(
    ("got", "want"),
    [
        (lambda: vec.bind(lit(1, -1, 0, 1), lit(1, 1, 1, -1)), [1, -1, 0, -1]),
        (lambda: vec.negate(lit(1, -1, 0, 1), lit(1, 0, 1, -1)), [0, -1, -1, 1]),
        (lambda: vec.negate(lit(1, -1, 0, 1), lit(1, 0, 1, -1), "zero"), [0, -1, 0, 0]),
        (lambda: vec.negate(lit(1, -1, 0, 1), lit(1, 0, 1, -1), "invert"), [0, -1, -1, 1]),
        (lambda: vec.amplify(lit(1, -1, 0), lit(-1, -1, 1), 2.0), [-1, -1, 1]),
        (lambda: vec.prototype_add(lit(1, 0, -1), lit(-1, 1, -1), 0), [-1, 1, -1]),
        (lambda: vec.prototype_add(lit(1, 0, -1), lit(-1, 1, -1), 1), [0, 1, -1]),
        (lambda: vec.prototype_add(lit(1, 0, -1), lit(-1, 1, -1), 2), [1, 1, -1]),
        (lambda: vec.difference(lit(1, 0, -1), lit(-1, 1, -1)), [-1, 1, 0]),
        (lambda: vec.permute(lit(1, 0, -1, 1), 1), [0, -1, 1, 1]),
        (lambda: vec.permute(vec.permute(lit(1, 0, -1, 1), 3), -3), [1, 0, -1, 1]),
        (lambda: vec.attend(lit(1, -1, 0, 1), lit(1, 1, 1, 0), 1.0, "hard"), [1, 0, 0, 0]),
        (lambda: vec.attend(lit(1, -1, 0, 1), lit(1, 1, 1, 0), 1.0, "soft"), [1, 0, 0, 0]),
        (lambda: vec.attend(lit(1, -1, 0, 1), lit(1, 1, 1, 0), 0.0, "soft"), [0, 0, 0, 0]),
        (lambda: vec.attend(lit(1, -1, 0, 1), lit(1, 1, 1, 0), 1.0, "amplify"), [1, 1, 1, 0]),
        (lambda: vec.analogy(lit(1, 0, -1), lit(1, 1, 1), lit(0, 0, -1)), [0, 1, 0]),
        (lambda: vec.conditional_bind(lit(1, 1, -1), lit(1, -1, 1), lit(1, 0, -1), "positive"), [1, 0, 0]),
        (lambda: vec.sparsify(lit(1, 0, -1, 1), 2), [1, 0, -1, 0]),
        (lambda: vec.sparsify(lit(1, 0, -1, 1), 0), [0, 0, 0, 0]),
        (lambda: vec.sparsify(lit(1, 0), 5), [1, 0]),
        (lambda: vec.flip(vec.flip(lit(1, 0, -1))), [1, 0, -1]),
        (lambda: vec.power(lit(1, 0, -1), 2), [1, 0, 1]),
        (lambda: vec.power(lit(1, 0, -1), 0.5), [1, 0, -1]),
        (lambda: vec.reflect_about_mean(lit(1, 1, 1, 0)), [1, 1, 1, 1]),
        (lambda: vec.grover_amplify(lit(1, 1, -1, -1), lit(1, 1, 1, -1), 0), [1, 1, 1, -1]),
        (lambda: vec.project(lit(1, 1, 0), []), [0, 0, 0]),
        (lambda: vec.reject(lit(1, 1, 0), []), [1, 1, 0]),
        (lambda: vec.project(lit(1, 1, -1), [[1, 1, 0], [2, 2, 0]]), [1, 1, 0]),
        (lambda: vec.reject(lit(1, 1, -1), [[1, 1, 0]]), [0, 0, -1]),
        (lambda: vec.from_f64(literal([0.5, -2.0, float("nan"), 0.0], "double")), [1, -1, 0, 0]),
    ],
)
def test_micro(spark, got, want):
    assert one(spark, got()) == want


@pytest.mark.parametrize(
    ("got", "want"),
    [
        (lambda: sim.cosine(lit(1, 0, -1), lit(1, 0, -1)), 1.0),
        (lambda: sim.cosine(lit(0, 0), lit(1, 1)), 0.0),
        (lambda: sim.dot(lit(1, -1, 1), lit(1, 1, 0)), 0),
        (lambda: sim.hamming(lit(1, 0, -1, 0), lit(1, 0, 1, 1)), 0.5),
        (lambda: sim.overlap(lit(1, 0, -1, 0), lit(1, 0, 1, 1)), 1 / 3),
        (lambda: sim.overlap(lit(0, 0), lit(0, 0)), 0.0),
        (lambda: sim.agreement(lit(1, -1), lit(1, 1)), 0.0),
        (lambda: sim.chebyshev(lit(1, -1), lit(-1, -1)), 0.0),
        (lambda: sim.euclidean(lit(1, 1), lit(1, 1)), 1.0),
        (lambda: sim.minkowski_distance(lit(1, 1), lit(-1, 1), 3), 2.0),
        (lambda: vec.complexity(lit(1, -1, 0, 0)), 0.75),
        (lambda: vec.entropy(lit(1, -1, 0)), 1.0),
        (lambda: vec.cosine_f64(literal([1.0, 0.0], "double"), literal([0.0, 0.0], "double")), 0.0),
    ],
)
def test_numbers(spark, got, want):
    assert one(spark, got().cast("double")) == pytest.approx(want, abs=1e-9)


def test_lengths_must_agree(spark):
    with pytest.raises(Exception, match="lengths differ"):
        one(spark, vec.bind(lit(1, 1), lit(1, 1, 1)))


def test_bad_arguments(spark):
    with pytest.raises(ValueError):
        vec.power(F.col("x"), -1)
    with pytest.raises(ValueError):
        sim.minkowski_distance(F.col("x"), F.col("x"), 0.5)
    with pytest.raises(ValueError):
        vec.bundle_columns([])


def test_null_vector_gives_null(spark):
    assert one(spark, vec.bind(F.lit(None).cast("array<tinyint>"), lit(1))) is None


def test_atoms_are_deterministic_and_uniform(spark):
    space = Space(4096, 7)
    got = one(spark, atom_vector(space, F.lit("hello")))
    assert (np.array(got) == atom_array(space, "hello")).all()
    share = np.bincount(np.array(got) + 1) / 4096
    assert (abs(share - 1 / 3) < 0.04).all()
    assert abs((atom_array(space, "a").astype(int) * atom_array(space, "b")).sum()) < 250
    assert (atom_array(Space(4096, 8), "hello") != atom_array(space, "hello")).any()


def test_packed_agrees(spark):
    space = Space(256)
    df = spark.range(20).select("id", atom_vector(space, F.col("id").cast("string")).alias("a"), atom_vector(space, F.concat(F.lit("x"), F.col("id").cast("string"))).alias("b"))
    p = df.select("id", packed.pack(F.col("a")).alias("a"), packed.pack(F.col("b")).alias("b"))
    got = packed.bind(p, "a", "b", space).select("id", packed.unpack(F.col("v")).alias("v"))
    want = df.select("id", vec.bind(F.col("a"), F.col("b")).alias("w"))
    assert got.join(want, "id").where(F.col("v") != F.col("w")).count() == 0
    sims = packed.cosine(p, "a", "b", space).join(df.select("id", sim.cosine(F.col("a"), F.col("b")).alias("c")), "id").collect()
    assert all(abs(r["sim"] - r["c"]) < 1e-6 for r in sims)
    b = packed.bundle(p, [], "a", space).select(packed.unpack(F.col("v"))).first()[0]
    assert (np.array(b) == np.sign(np.array([r[0] for r in df.select("a").collect()]).sum(0))).all()
