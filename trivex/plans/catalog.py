"""Queries over the driver's tables, by name, and the same in SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import Space
from ..functions import scalars, similarity as sim, vectors as vec
from ..functions.atoms import atom_vector, literal, position_vector, sign_vector
from ..operators import aggregate as agg, match, ordered
from ..sources import codebook as books, encode as enc
from . import pipelines as pipe

D = 64
SPACE = Space(D, 0)
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# what both sides share

def text(v: Column) -> Column:
    return F.array_join(F.transform(v, lambda x: x.cast("string")), ",")


def rnd(x: Column, n: int = 6) -> Column:
    return F.round(x.cast("double"), n) + F.lit(0.0)


def tern(spark, d: str) -> DataFrame:
    """Embeddings as ternary vectors: small components are 0."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    x = lambda x: F.when(F.abs(x.cast("double")) < 0.05, 0).otherwise(F.signum(x)).cast("tinyint")
    return e.select("vec_id", "label", F.transform("embedding", x).alias("v"))


def triples(spark, d: str) -> DataFrame:
    t = tern(spark, d)
    one = t.select(F.col("vec_id"), F.col("v").alias("a"))
    two = t.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("b"))
    three = t.select((F.col("vec_id") - 2).alias("vec_id"), F.col("v").alias("c"))
    return one.join(two, "vec_id").join(three, "vec_id")


T = "t AS (SELECT vec_id, label, list_transform(embedding, lambda x: CASE WHEN abs(CAST(x AS DOUBLE)) < 0.05 THEN 0 ELSE CAST(sign(x) AS INTEGER) END) AS v FROM embeddings)"
P = T + ", p AS (SELECT x.vec_id, x.v AS a, y.v AS b, z.v AS c FROM t x JOIN t y ON y.vec_id = x.vec_id + 1 JOIN t z ON z.vec_id = x.vec_id + 2)"
EACH = f"range(1, {D + 1})"


def over(e: str) -> str:
    return f"list_transform({EACH}, lambda i: {e})"


def total(e: str) -> str:
    return f"list_sum({over(e)})"


def sgn(e: str) -> str:
    return f"CAST(sign({e}) AS INTEGER)"


def rsql(e: str, n: int = 6) -> str:
    return f"round(CAST({e} AS DOUBLE), {n}) + 0.0"


def sha_word(atom: str, i: str) -> str:
    """The 16-bit word of component i (from 0) of an atom, in SQL."""
    return f"CAST('0x' || substr(sha256('0|' || {atom} || '|' || CAST(({i}) // 16 AS VARCHAR)), 4 * (({i}) % 16) + 1, 4) AS INTEGER)"


def atom_sql(atom: str) -> str:
    return over(f"{sha_word(atom, 'i - 1')} % 3 - 1")


# component by component: name, column, SQL of component i of a, b, c

ELEMENTWISE = {
    "bind": (lambda a, b, c: vec.bind(a, b), "a[i] * b[i]"),
    "unbind": (lambda a, b, c: vec.unbind(vec.bind(a, b), b), "a[i] * b[i] * b[i]"),
    "similarity_profile": (lambda a, b, c: vec.similarity_profile(a, b), "a[i] * b[i]"),
    "negate_subtract": (lambda a, b, c: vec.negate(a, b), sgn("a[i] - b[i]")),
    "negate_zero": (lambda a, b, c: vec.negate(a, b, "zero"), "CASE WHEN b[i] <> 0 THEN 0 ELSE a[i] END"),
    "negate_invert": (lambda a, b, c: vec.negate(a, b, "invert"), "greatest(-1, least(1, a[i] - b[i]))"),
    "amplify": (lambda a, b, c: vec.amplify(a, b, 0.5), sgn("a[i] + 0.5 * b[i]")),
    "prototype_add_0": (lambda a, b, c: vec.prototype_add(a, b, 0), "b[i]"),
    "prototype_add_1": (lambda a, b, c: vec.prototype_add(a, b, 1), sgn("a[i] * 0.5 + b[i] * 0.5")),
    "prototype_add_3": (lambda a, b, c: vec.prototype_add(a, b, 3), "CASE WHEN a[i] <> 0 THEN a[i] ELSE b[i] END"),
    "difference": (lambda a, b, c: vec.difference(a, b), sgn("b[i] - a[i]")),
    "blend_weighted": (lambda a, b, c: vec.blend_weighted(a, b, 1.5, -0.5), sgn("1.5 * a[i] - 0.5 * b[i]")),
    "blend": (lambda a, b, c: vec.blend(a, b, 0.25), sgn("0.75 * a[i] + 0.25 * b[i]")),
    "resonance": (lambda a, b, c: vec.resonance(a, b), "CASE WHEN a[i] = b[i] THEN a[i] ELSE 0 END"),
    "permute_right": (lambda a, b, c: vec.permute(a, 5), f"a[(i - 1 + 5) % {D} + 1]"),
    "permute_left": (lambda a, b, c: vec.permute(a, -7), f"a[(i - 1 + {D} - 7) % {D} + 1]"),
    "attend_hard": (lambda a, b, c: vec.attend(a, b, 1.0, "hard"), "CASE WHEN a[i] = b[i] THEN b[i] ELSE 0 END"),
    "attend_soft": (lambda a, b, c: vec.attend(a, b, 2.0, "soft"), "CASE WHEN a[i] * b[i] > 0 THEN b[i] ELSE 0 END"),
    "attend_amplify": (lambda a, b, c: vec.attend(a, b, -0.75, "amplify"), "CASE WHEN a[i] * b[i] > 0 THEN 0 ELSE b[i] END"),
    "analogy": (lambda a, b, c: vec.analogy(a, b, c), sgn(f"c[i] + {sgn('b[i] - a[i]')}")),
    "conditional_bind_positive": (lambda a, b, c: vec.conditional_bind(a, b, c, "positive"), "CASE WHEN c[i] > 0 THEN a[i] * b[i] ELSE 0 END"),
    "conditional_bind_negative": (lambda a, b, c: vec.conditional_bind(a, b, c, "negative"), "CASE WHEN c[i] < 0 THEN a[i] * b[i] ELSE 0 END"),
    "conditional_bind_nonzero": (lambda a, b, c: vec.conditional_bind(a, b, c, "nonzero"), "CASE WHEN c[i] <> 0 THEN a[i] * b[i] ELSE 0 END"),
    "flip": (lambda a, b, c: vec.flip(a), "-a[i]"),
    "power_even": (lambda a, b, c: vec.power(a, 2), "abs(a[i])"),
    "power_odd": (lambda a, b, c: vec.power(a, 3), "a[i]"),
    "power_zero": (lambda a, b, c: vec.power(a, 0), "0"),
    "power_half": (lambda a, b, c: vec.power(a, 0.5), "a[i]"),
    "remediate": (lambda a, b, c: pipe.remediated(a, b), sgn(f"a[i] + 0.5 * {sgn('b[i] - a[i]')}")),
    "bundle_of_columns": (lambda a, b, c: vec.bundle_columns([a, b, c]), sgn("a[i] + b[i] + c[i]")),
}
for _name, (_f, _sql) in ELEMENTWISE.items():
    query(f"vec_{_name}", f"WITH {P} SELECT vec_id, array_to_string({over(_sql)}, ',') AS v FROM p")(
        lambda spark, d, f=_f: triples(spark, d).select("vec_id", text(f(F.col("a"), F.col("b"), F.col("c"))).alias("v")))

# one number per pair

_NA, _NB = "sqrt(" + total("a[i] * a[i]") + ")", "sqrt(" + total("b[i] * b[i]") + ")"
_DOT = total("a[i] * b[i]")
_W = f"(1.0 + (i - 1) / {D}.0)"
_L2, _L1 = f"sqrt({total('(a[i] - b[i]) * (a[i] - b[i])')})", total("abs(a[i] - b[i])")
_LINF = f"list_max({over('abs(a[i] - b[i])')})"
WEIGHTS = [1.0 + i / D for i in range(D)]
NUMBERS = {
    "cosine": (lambda a, b: sim.cosine(a, b), f"{_DOT} / ({_NA} * {_NB})"),
    "dot": (lambda a, b: sim.dot(a, b), _DOT),
    "euclidean": (lambda a, b: sim.euclidean(a, b), f"1 / (1 + {_L2})"),
    "euclidean_distance": (lambda a, b: sim.euclidean_distance(a, b), _L2),
    "manhattan": (lambda a, b: sim.manhattan(a, b), f"1 / (1.0 + {_L1})"),
    "manhattan_distance": (lambda a, b: sim.manhattan_distance(a, b), _L1),
    "hamming": (lambda a, b: sim.hamming(a, b), total("CASE WHEN a[i] = b[i] THEN 1 ELSE 0 END") + f" / {D}.0"),
    "overlap": (lambda a, b: sim.overlap(a, b), total("CASE WHEN a[i] = b[i] AND a[i] <> 0 THEN 1 ELSE 0 END") + " / CAST(" + total("CASE WHEN a[i] <> 0 OR b[i] <> 0 THEN 1 ELSE 0 END") + " AS DOUBLE)"),
    "agreement": (lambda a, b: sim.agreement(a, b), f"{_DOT} / {D}.0"),
    "chebyshev": (lambda a, b: sim.chebyshev(a, b), f"CASE WHEN {_LINF} <= 2 THEN 1 - {_LINF} / 2.0 ELSE 0 END"),
    "chebyshev_distance": (lambda a, b: sim.chebyshev_distance(a, b), _LINF),
    "minkowski": (lambda a, b: sim.minkowski(a, b, 3.0), f"1 / (1 + pow({total('pow(abs(a[i] - b[i]), 3)')}, 1 / 3.0))"),
    "minkowski_distance": (lambda a, b: sim.minkowski_distance(a, b, 3.0), f"pow({total('pow(abs(a[i] - b[i]), 3)')}, 1 / 3.0)"),
    "weighted_cosine": (lambda a, b: sim.weighted_cosine(a, b, literal(WEIGHTS, "double")), f"{total(f'a[i] * b[i] * {_W} * {_W}')} / sqrt({total(f'a[i] * a[i] * {_W} * {_W}')} * {total(f'b[i] * b[i] * {_W} * {_W}')})"),
    "weighted_euclidean": (lambda a, b: sim.weighted_euclidean(a, b, literal(WEIGHTS, "double")), f"1 / (1 + sqrt({total(f'(a[i] - b[i]) * (a[i] - b[i]) * {_W}')}))"),
    "significance": (lambda a, b: sim.significance(sim.cosine(a, b), D), f"{_DOT} / ({_NA} * {_NB}) * {math.sqrt(D)}"),
    "cosine_f64": (lambda a, b: vec.cosine_f64(vec.to_f64(a), vec.to_f64(b)), f"{_DOT} / ({_NA} * {_NB})"),
    "disagreement": (lambda a, b: pipe.disagreement(vec.bind(a, b)), total("CASE WHEN a[i] * b[i] < 0 THEN 1 ELSE 0 END") + " / CAST(" + total("CASE WHEN a[i] * b[i] <> 0 THEN 1 ELSE 0 END") + " AS DOUBLE)"),
}
for _name, (_f, _sql) in NUMBERS.items():
    query(f"sim_{_name}", f"WITH {P} SELECT vec_id, {rsql(_sql)} AS x FROM p")(
        lambda spark, d, f=_f: triples(spark, d).select("vec_id", rnd(f(F.col("a"), F.col("b"))).alias("x")))

# one number or vector per vector

_POS, _NEG, _ZERO = (total(f"CASE WHEN v[i] {c} 0 THEN 1 ELSE 0 END") for c in (">", "<", "="))
_MEAN = f"({total('v[i]')} / {D}.0)"
_ENT = " + ".join(f"CASE WHEN {c} > 0 THEN -({c} / {D}.0) * log2({c} / {D}.0) ELSE 0 END" for c in (_POS, _NEG, _ZERO))
ONE = {
    "nnz": (lambda v: vec.nnz(v), total("CASE WHEN v[i] <> 0 THEN 1 ELSE 0 END")),
    "norm": (lambda v: vec.norm(v), f"sqrt({total('v[i] * v[i]')})"),
    "dimensions": (lambda v: vec.dimensions(v), "len(v)"),
    "component": (lambda v: vec.component(v, 3), "v[4]"),
    "complexity": (lambda v: vec.complexity(v), f"0.5 * ({_POS} + {_NEG}) / {D}.0 + 0.5 * 2 * least({_POS}, {_NEG}) / CAST({_POS} + {_NEG} AS DOUBLE)"),
    "entropy": (lambda v: vec.entropy(v), f"({_ENT}) / {math.log2(3)!r}"),
}
for _name, (_f, _sql) in ONE.items():
    query(f"vec_{_name}", f"WITH {T} SELECT vec_id, {rsql(_sql)} AS x FROM t")(lambda spark, d, f=_f: tern(spark, d).select("vec_id", rnd(f(F.col("v"))).alias("x")))

query("vec_from_f64", f"SELECT vec_id, array_to_string(list_transform(embedding, lambda x: {sgn('x')}), ',') AS v FROM embeddings")(
    lambda spark, d: spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", text(vec.from_f64(F.col("embedding"))).alias("v")))
query("vec_normalized", f"WITH {T}, n AS (SELECT vec_id, v, sqrt({total('v[i] * v[i]')}) AS n FROM t) SELECT vec_id, {rsql(total('abs(v[i]) / n'))} AS x FROM n")(
    lambda spark, d: tern(spark, d).select("vec_id", rnd(F.aggregate(vec.normalized(F.col("v")), F.lit(0.0), lambda s, x: s + F.abs(x))).alias("x")))
query("vec_reflect_about_mean", f"WITH {T}, m AS (SELECT vec_id, v, {_MEAN} AS m FROM t) SELECT vec_id, array_to_string({over(sgn('2 * m - v[i]'))}, ',') AS v FROM m")(
    lambda spark, d: tern(spark, d).select("vec_id", text(vec.reflect_about_mean(F.col("v"))).alias("v")))
query("vec_grover_amplify", f"""WITH {P}, g AS (SELECT vec_id, {over("b[i] * (1 + (exp(2.0 * a[i] * b[i]) - 1) / (exp(2.0 * a[i] * b[i]) + 1)) / 2")} AS x FROM p),
m AS (SELECT vec_id, x, list_sum(x) / {D} AS m FROM g) SELECT vec_id, array_to_string({over(sgn('2 * m - x[i]'))}, ',') AS v FROM m""")(
    lambda spark, d: triples(spark, d).select("vec_id", text(vec.grover_amplify(F.col("a"), F.col("b"), 1)).alias("v")))
query("vec_sparsify", f"""WITH {T}, r AS (SELECT vec_id, v, i, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v[i]) DESC, i) AS r FROM t, unnest({EACH}) u(i))
SELECT vec_id, string_agg(CASE WHEN r <= 10 THEN v[i] ELSE 0 END, ',' ORDER BY i) AS v FROM r GROUP BY vec_id""")(
    lambda spark, d: tern(spark, d).select("vec_id", text(vec.sparsify(F.col("v"), 10)).alias("v")))
query("vec_profile_counts", f"""WITH {P} SELECT vec_id, {total('CASE WHEN a[i] * b[i] > 0 THEN 1 ELSE 0 END')} AS agree, {total('CASE WHEN a[i] * b[i] < 0 THEN 1 ELSE 0 END')} AS disagree FROM p""")(
    lambda spark, d: triples(spark, d).select("vec_id", vec.profile_counts(vec.bind(F.col("a"), F.col("b"))).alias("p")).select("vec_id", F.col("p.agree").cast("long").alias("agree"), F.col("p.disagree").cast("long").alias("disagree")))
query("f64_bind", f"SELECT x.vec_id, {rsql(total('CAST(x.embedding[i] AS DOUBLE) * y.embedding[i]'))} AS x FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1")(
    lambda spark, d: _neighbours(spark, d).select("vec_id", rnd(vec.total(vec.bind_f64(F.col("a"), F.col("b")))).alias("x")))
query("f64_negate", f"""WITH p AS (SELECT x.vec_id, CAST(x.embedding AS DOUBLE[]) AS a, CAST(y.embedding AS DOUBLE[]) AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1),
s AS (SELECT vec_id, a, b, {_DOT} / {total('b[i] * b[i]')} AS s FROM p) SELECT vec_id, {rsql(total('abs(a[i] - s * b[i])'), 5)} AS x FROM s""")(
    lambda spark, d: _neighbours(spark, d).select("vec_id", rnd(F.aggregate(vec.negate_f64(F.col("a"), F.col("b")), F.lit(0.0), lambda s, x: s + F.abs(x)), 5).alias("x")))


def _neighbours(spark, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")


# exemplars known when the plan is made: alternating and block patterns

BASIS = [[1 if i % 2 else -1 for i in range(D)], [1 if i < D // 2 else -1 for i in range(D)]]
_P1, _P2 = f"{total('v[i] * (CASE WHEN (i - 1) % 2 = 1 THEN 1 ELSE -1 END)')} / {D}.0", f"{total(f'v[i] * (CASE WHEN i <= {D // 2} THEN 1 ELSE -1 END)')} / {D}.0"
_PR = f"(x * (CASE WHEN (i - 1) % 2 = 1 THEN 1 ELSE -1 END) + y * (CASE WHEN i <= {D // 2} THEN 1 ELSE -1 END))"
_TINY = "CASE WHEN abs({0}) < 1e-10 THEN 0.0 ELSE {0} END"
query("vec_project", f"WITH {T}, q AS (SELECT vec_id, v, {_P1} AS x, {_P2} AS y FROM t) SELECT vec_id, array_to_string({over(sgn(_TINY.format(_PR)))}, ',') AS v FROM q")(
    lambda spark, d: tern(spark, d).select("vec_id", text(vec.project(F.col("v"), BASIS)).alias("v")))
query("vec_reject", f"WITH {T}, q AS (SELECT vec_id, v, {_P1} AS x, {_P2} AS y FROM t) SELECT vec_id, array_to_string({over(sgn(_TINY.format(f'(v[i] - {_PR})')))}, ',') AS v FROM q")(
    lambda spark, d: tern(spark, d).select("vec_id", text(vec.reject(F.col("v"), BASIS)).alias("v")))


def _projection_sql() -> str:
    m = vec.projection_matrix(D, 16, 3)
    rows = ["sign(" + " + ".join(f"({int(x)}) * v[{i + 1}]" for i, x in enumerate(r) if x) + ")" for r in m]
    return f"WITH {T} SELECT vec_id, " + " || ',' || ".join(f"CAST(CAST({r} AS INTEGER) AS VARCHAR)" for r in rows) + " AS v FROM t"


query("vec_random_project", _projection_sql())(lambda spark, d: tern(spark, d).select("vec_id", text(vec.random_project(F.col("v"), D, 16, 3)).alias("v")))

# atoms and codebooks

query("atoms", f"WITH a AS (SELECT DISTINCT event_type AS atom FROM events) SELECT atom, array_to_string({atom_sql('atom')}, ',') AS v FROM a")(
    lambda spark, d: books.codebook(spark.read.parquet(f"{d}/events.parquet"), "event_type", SPACE).select("atom", text(F.col("v")).alias("v")))
query("atom_signs", f"WITH a AS (SELECT DISTINCT event_type AS atom FROM events) SELECT atom, array_to_string({over('1 - 2 * (' + sha_word('atom', 'i - 1') + ' % 2)')}, ',') AS v FROM a")(
    lambda spark, d: spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("atom")).distinct().select("atom", text(sign_vector(SPACE, F.col("atom"))).alias("v")))
query("position_vectors", f"SELECT n_nationkey, array_to_string({atom_sql(chr(39) + '__pos__' + chr(39) + ' || CAST(n_nationkey AS VARCHAR)')}, ',') AS v FROM nation")(
    lambda spark, d: spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", text(position_vector(SPACE, F.col("n_nationkey"))).alias("v")))
query("codebook_lookup", f"SELECT c_custkey, array_to_string({atom_sql('c_mktsegment')}, ',') AS v FROM customer")(
    lambda spark, d: books.with_vectors(c := spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_mktsegment"), "c_mktsegment", books.codebook(c, "c_mktsegment", SPACE)).select("c_custkey", text(F.col("v")).alias("v")))

# aggregates

_LONG = T + f", l AS (SELECT vec_id, label, i, v[i] AS x FROM t, unnest({EACH}) u(i))"


def _by_label(e: str) -> str:
    return f"WITH {_LONG}, s AS (SELECT label, i, sum(x) AS s, count(*) AS n FROM l GROUP BY label, i) SELECT label, string_agg({e}, ',' ORDER BY i) AS v FROM s GROUP BY label"


query("bundle", _by_label(sgn("s")))(lambda spark, d: agg.bundle(tern(spark, d), ["label"], "v", D).select("label", text(F.col("v")).alias("v")))
query("centroid", _by_label(sgn("s")))(lambda spark, d: agg.centroid(tern(spark, d), ["label"], "v", D).select("label", text(F.col("v")).alias("v")))
query("bundle_f64", f"WITH {_LONG}, s AS (SELECT label, i, sum(x) AS s FROM l GROUP BY label, i) SELECT label, {rsql('sum(abs(s))')} AS x FROM s GROUP BY label")(
    lambda spark, d: agg.bundle_f64(tern(spark, d), ["label"], "v", D).select("label", rnd(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x))).alias("x")))
query("weighted_bundle", f"WITH {_LONG}, s AS (SELECT label, i, sum(x * (vec_id % 7 + 1)) AS s FROM l GROUP BY label, i) SELECT label, string_agg({sgn('s')}, ',' ORDER BY i) AS v FROM s GROUP BY label")(
    lambda spark, d: agg.bundle(tern(spark, d), ["label"], "v", D, F.col("vec_id") % 7 + 1).select("label", text(F.col("v")).alias("v")))
query("prototype", _by_label("CASE WHEN s >= ceil(n * 0.1) THEN 1 WHEN s <= -ceil(n * 0.1) THEN -1 ELSE 0 END"))(
    lambda spark, d: agg.prototype(tern(spark, d), ["label"], "v", D, 0.1).select("label", text(F.col("v")).alias("v")))
query("bundle_with_confidence", f"WITH {_LONG}, s AS (SELECT label, i, sum(x) AS s, count(*) AS n FROM l GROUP BY label, i) SELECT label, string_agg({sgn('s')}, ',' ORDER BY i) AS v, {rsql('sum(abs(s) / n)')} AS margin FROM s GROUP BY label")(
    lambda spark, d: agg.bundle_with_confidence(tern(spark, d), ["label"], "v", D).select("label", text(F.col("v")).alias("v"), rnd(vec.total(F.col("margin"))).alias("margin")))
query("coherence", f"""WITH {T}, n AS (SELECT *, sqrt({total('v[i] * v[i]')}) AS n FROM t), c AS (SELECT a.label, list_sum(list_transform({EACH}, lambda i: a.v[i] * b.v[i])) / (a.n * b.n) AS c FROM n a JOIN n b ON a.label = b.label AND a.vec_id < b.vec_id)
SELECT label, {rsql('avg(c)')} AS coherence FROM c GROUP BY label""")(lambda spark, d: agg.coherence(tern(spark, d), ["label"], "v", D).select("label", rnd(F.col("coherence")).alias("coherence")))


def _acc(spark, d: str) -> DataFrame:
    return agg.accumulate(tern(spark, d), ["label"], "v", D)


_S = f"WITH {_LONG}, s AS (SELECT label, i, sum(x) AS s, count(*) AS n FROM l GROUP BY label, i), q AS (SELECT label, any_value(n) AS n, sum(s * s) AS q2, sum(s * s * s * s) AS q4 FROM s GROUP BY label) "
query("accumulator_metrics", _S + f"""SELECT label, n, {rsql(f'greatest(0, least(1, 1 - (q2 / {D}.0) / ({D} / (2 * ln(10)))))')} AS capacity, {rsql(f'least({D} / CAST(q2 AS DOUBLE), 1)')} AS purity, {rsql('CAST(q2 AS DOUBLE) * q2 / q4')} AS participation FROM q""")(
    lambda spark, d: _acc(spark, d).select("label", "n", rnd(agg.capacity(F.col("sums"), 10)).alias("capacity"), rnd(agg.purity(F.col("sums"), F.col("n"))).alias("purity"), rnd(agg.participation_ratio(F.col("sums"))).alias("participation")))
query("accumulator_threshold", _by_label(sgn("s")))(lambda spark, d: _acc(spark, d).select("label", text(agg.threshold(F.col("sums"))).alias("v")))
query("accumulator_unit", f"WITH {_LONG}, s AS (SELECT label, i, sum(x) AS s FROM l GROUP BY label, i) SELECT label, {rsql('sum(abs(s)) / sqrt(sum(s * s))')} AS x FROM s GROUP BY label")(
    lambda spark, d: _acc(spark, d).select("label", rnd(F.aggregate(agg.normalize_f64(F.col("sums")), F.lit(0.0), lambda s, x: s + F.abs(x))).alias("x")))
query("accumulator_merge", _by_label("CAST(s AS INTEGER)"))(
    lambda spark, d: agg.merge(agg.accumulate((t := tern(spark, d)).where("vec_id % 2 = 0"), ["label"], "v", D), agg.accumulate(t.where("vec_id % 2 = 1"), ["label"], "v", D), ["label"], D).select("label", text(F.transform("sums", lambda x: x.cast("int"))).alias("v")))
query("accumulator_decayed", f"""WITH {T}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM t),
l AS (SELECT label, i, sum(v[i] * pow(0.9, n - rn)) AS s FROM r, unnest({EACH}) u(i) GROUP BY label, i) SELECT label, {rsql('sum(abs(s))', 5)} AS x FROM l GROUP BY label""")(
    lambda spark, d: agg.decayed(tern(spark, d).withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))), ["label"], "v", D, "rn", 0.9).select("label", rnd(F.aggregate("sums", F.lit(0.0), lambda s, x: s + F.abs(x)), 5).alias("x")))

# search in a codebook: each vector against the labels' bundles

_BOOK = f"{_LONG}, s AS (SELECT label, i, sum(x) AS s FROM l GROUP BY label, i), b AS (SELECT label AS idx, list({sgn('s')} ORDER BY i) AS c FROM s GROUP BY label), m AS (SELECT vec_id, idx, list_sum(list_transform({EACH}, lambda i: v[i] * c[i])) / (sqrt({total('v[i] * v[i]')}) * sqrt({total('c[i] * c[i]')})) AS sim FROM t, b), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 12) DESC, idx) AS rank FROM m)"


def _book(spark, d: str):
    t = tern(spark, d)
    return t.select(F.col("vec_id").alias("qid"), "v"), agg.bundle(t, ["label"], "v", D).select(F.col("label").alias("idx"), "v")


query("cleanup", f"WITH {_BOOK} SELECT vec_id, CAST(idx AS BIGINT) AS idx, {rsql('sim')} AS sim FROM r WHERE rank = 1")(
    lambda spark, d: match.cleanup(*_book(spark, d)).select(F.col("qid").alias("vec_id"), "idx", rnd(F.col("sim")).alias("sim")))
query("invert", f"WITH {_BOOK} SELECT vec_id, CAST(rank AS INTEGER) AS rank, CAST(idx AS BIGINT) AS idx, {rsql('sim')} AS sim FROM r WHERE rank <= 4 AND sim >= 0.05")(
    lambda spark, d: match.invert(*_book(spark, d), 4, 0.05).select(F.col("qid").alias("vec_id"), "rank", "idx", rnd(F.col("sim")).alias("sim")))
query("topk_similar", f"WITH {_BOOK} SELECT vec_id, CAST(rank AS INTEGER) AS rank, CAST(idx AS BIGINT) AS idx, {rsql('sim')} AS sim FROM r WHERE rank <= 3")(
    lambda spark, d: match.topk_similar(*_book(spark, d), 3).select(F.col("qid").alias("vec_id"), "rank", "idx", rnd(F.col("sim")).alias("sim")))
query("similarity_matrix", f"WITH {_BOOK} SELECT CAST(x.idx AS BIGINT) AS i, CAST(y.idx AS BIGINT) AS j, {rsql(f'CASE WHEN x.idx = y.idx THEN 1 ELSE list_sum(list_transform({EACH}, lambda i: x.c[i] * y.c[i])) / (sqrt(list_sum(list_transform({EACH}, lambda i: x.c[i] * x.c[i]))) * sqrt(list_sum(list_transform({EACH}, lambda i: y.c[i] * y.c[i])))) END')} AS sim FROM b x, b y")(
    lambda spark, d: match.similarity_matrix(_book(spark, d)[1]).select("i", "j", rnd(F.col("sim")).alias("sim")))
query("attribution_accuracy", f"WITH {_BOOK} SELECT label, {rsql('avg(CASE WHEN label = idx THEN 1 ELSE 0 END)')} AS accuracy, count(*) AS n FROM r JOIN t USING (vec_id) WHERE rank = 1 GROUP BY label")(
    lambda spark, d: match.cleanup(*_book(spark, d)).join(tern(spark, d).select(F.col("vec_id").alias("qid"), "label"), "qid").groupBy("label").agg(rnd(F.avg((F.col("idx") == F.col("label")).cast("int"))).alias("accuracy"), F.count("*").alias("n")))

# streams: vectors in vec_id order

_COS = f"list_sum(list_transform({EACH}, lambda i: x.v[i] * y.v[i])) / (sqrt(list_sum(list_transform({EACH}, lambda i: x.v[i] * x.v[i]))) * sqrt(list_sum(list_transform({EACH}, lambda i: y.v[i] * y.v[i]))))"
_SEQ = T + ", q AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS seq, v FROM t)"


def _stream(spark, d: str) -> DataFrame:
    return ordered.numbered(tern(spark, d).select("vec_id", "v"), "vec_id").select("seq", "v")


query("autocorrelate", f"WITH {_SEQ}, k AS (SELECT unnest(range(0, 9)) AS lag) SELECT CAST(lag AS INTEGER) AS lag, {rsql(f'CASE WHEN lag = 0 THEN 1 ELSE avg({_COS}) END')} AS corr FROM k JOIN q y ON y.seq >= lag JOIN q x ON x.seq = y.seq - lag GROUP BY lag")(
    lambda spark, d: ordered.autocorrelate(_stream(spark, d), 8).select("lag", rnd(F.col("corr")).alias("corr")))
query("cross_correlate", f"WITH {_SEQ}, o AS (SELECT seq, list_transform({EACH}, lambda i: v[(i + 2) % {D} + 1]) AS v FROM q), k AS (SELECT unnest(range(0, 6)) AS lag) SELECT CAST(lag AS INTEGER) AS lag, {rsql(f'avg({_COS})')} AS corr FROM k JOIN o y ON y.seq >= lag JOIN q x ON x.seq = y.seq - lag GROUP BY lag")(
    lambda spark, d: ordered.cross_correlate(s := _stream(spark, d), s.select("seq", vec.permute(F.col("v"), 3).alias("v")), 5).select("lag", rnd(F.col("corr")).alias("corr")))
query("segment_diff", f"WITH {_SEQ} SELECT CAST(0 AS BIGINT) AS seq UNION ALL SELECT y.seq FROM q x JOIN q y ON y.seq = x.seq + 1 WHERE {_COS} < 0.0")(
    lambda spark, d: ordered.segment(_stream(spark, d), 4, 0.0, "diff", D).select(F.col("seq").cast("long").alias("seq")))
query("segment_prototype", f"""WITH {_SEQ}, l AS (SELECT seq, i, v[i] AS x FROM q, unnest({EACH}) u(i)), s AS (SELECT seq, i, sum(x) OVER (PARTITION BY i ORDER BY seq ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS s, count(*) OVER (PARTITION BY i ORDER BY seq ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS n FROM l),
w AS (SELECT seq, list(CASE WHEN s >= ceil(n * 0.5) THEN 1 WHEN s <= -ceil(n * 0.5) THEN -1 ELSE 0 END ORDER BY i) AS v FROM s WHERE n > 0 GROUP BY seq)
SELECT CAST(0 AS BIGINT) AS seq UNION ALL SELECT y.seq FROM q y JOIN w x ON x.seq = y.seq WHERE coalesce(CASE WHEN list_sum(list_transform(x.v, lambda e: e * e)) = 0 THEN 0 ELSE {_COS} END, 0) < 0.0""")(
    lambda spark, d: ordered.segment(_stream(spark, d), 4, 0.0, "prototype", D).select(F.col("seq").cast("long").alias("seq")))
query("drift_rate", f"""WITH {_SEQ}, c AS (SELECT y.seq, {_COS} AS s FROM q x JOIN q y ON y.seq = x.seq + 1), w AS (SELECT seq, CASE WHEN seq >= 5 THEN avg(s) OVER (ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) ELSE s END AS s FROM c),
r AS (SELECT seq, s - lag(s) OVER (ORDER BY seq) AS drift FROM w) SELECT seq, {rsql('drift')} AS drift FROM r WHERE drift IS NOT NULL""")(
    lambda spark, d: ordered.drift_rate(_stream(spark, d), 5).select(F.col("seq").cast("long").alias("seq"), rnd(F.col("drift")).alias("drift")))

# numbers and times

_LEVEL = f"CAST(round(greatest(0, least(1, (value - 0) / 500.0)) * {D}) AS INTEGER)"
query("thermometer", f"SELECT event_id, array_to_string({over(f'CASE WHEN i <= {_LEVEL} THEN 1 ELSE -1 END')}, ',') AS v FROM events")(
    lambda spark, d: spark.read.parquet(f"{d}/events.parquet").select("event_id", text(scalars.encode_thermometer(SPACE, F.col("value"), 0.0, 500.0)).alias("v")))
query("thermometer_cosine", f"WITH p AS (SELECT event_id, {_LEVEL} AS a, lead({_LEVEL}) OVER (ORDER BY event_id) AS b FROM events) SELECT event_id, {rsql(f'1 - 2 * abs(a - b) / {D}.0')} AS x FROM p WHERE b IS NOT NULL")(
    lambda spark, d: (e := spark.read.parquet(f"{d}/events.parquet").select("event_id", "value")).join(e.select((F.col("event_id") - 1).alias("event_id"), F.col("value").alias("b")), "event_id").select("event_id", rnd(scalars.thermometer_cosine(F.col("value"), F.col("b"), 0.0, 500.0, D)).alias("x")))


def _rotation_sql(angle: str, kind: str = "scalar") -> str:
    b, o = scalars.bases(SPACE, kind)
    arcs = [",".join(map(str, x)) for x in (b, o, -b.astype(int), -o.astype(int))]
    arc = f"CAST(floor((({angle} + {math.pi / 4!r}) % {2 * math.pi!r} + {2 * math.pi!r}) % {2 * math.pi!r} / {math.pi / 2!r}) AS INTEGER)"
    return f"CASE {arc} " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(arcs)) + " END"


query("scalar_linear", f"SELECT event_id, {_rotation_sql(f'value * {2 * math.pi / 100!r}')} AS v FROM events")(
    lambda spark, d: spark.read.parquet(f"{d}/events.parquet").select("event_id", text(scalars.encode_linear(SPACE, F.col("value"), 100.0)).alias("v")))
query("scalar_circular", f"SELECT event_id, {_rotation_sql(f'(value % 24.0) * {2 * math.pi / 24!r}')} AS v FROM events")(
    lambda spark, d: spark.read.parquet(f"{d}/events.parquet").select("event_id", text(scalars.encode_circular(SPACE, F.col("value"), 24.0)).alias("v")))
query("scalar_log", f"SELECT event_id, {_rotation_sql(f'ln(value) / {math.log(10)!r} * {2 * math.pi / 10!r}')} AS v FROM events WHERE value > 0")(
    lambda spark, d: spark.read.parquet(f"{d}/events.parquet").where("value > 0").select("event_id", text(scalars.encode_log(SPACE, F.col("value"))).alias("v")))
query("scalar_f64", None)(lambda spark, d: spark.read.parquet(f"{d}/events.parquet").select("event_id", rnd(vec.total(scalars.encode_f64(SPACE, F.col("value"), "linear", 100.0)), 4).alias("x")))
query("decode_log", None)(lambda spark, d: spark.read.parquet(f"{d}/events.parquet").where("value > 0").select("event_id", rnd(scalars.decode_log(SPACE, scalars.encode_log(SPACE, F.col("value"))), 4).alias("x")))
_F = "pow(1000.0, -(i - 1) / 64.0)"
query("positional", f"SELECT event_id, array_to_string({over(f'CASE WHEN (i - 1) % 2 = 0 THEN {sgn(f"sin(value * {_F})")} ELSE {sgn(f"cos(value * {_F})")} END')}, ',') AS v FROM events")(
    lambda spark, d: spark.read.parquet(f"{d}/events.parquet").select("event_id", text(scalars.positional(SPACE, F.col("value"), 1000.0)).alias("v")))
query("time_parts", f"SELECT event_id, {rsql('(CAST(floor(epoch(ts)) AS BIGINT) % 86400) / 3600.0')} AS hour, CAST((CAST(floor(epoch(ts)) AS BIGINT) // 86400 + 4) % 7 AS INTEGER) AS dow, {rsql('((CAST(floor(epoch(ts)) AS BIGINT) // 86400) % 365) / 30.5')} AS month FROM events")(
    lambda spark, d: spark.read.parquet(f"{d}/events.parquet").select("event_id", scalars.time_parts(scalars.seconds(F.col("ts"))).alias("p")).select("event_id", rnd(F.col("p.hour")).alias("hour"), F.col("p.dow").cast("int").alias("dow"), rnd(F.col("p.month")).alias("month")))
query("encode_time", None)(lambda spark, d: _times(spark, d))


def _times(spark, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderdate")
    return books.encoded_once(o, "o_orderdate", lambda c: text(scalars.encode_time(SPACE, c))).select("o_orderkey", "v")



# records

_ROLE = lambda path, value: f"({sha_word(repr(path).replace(chr(34), chr(39)), 'i - 1')} % 3 - 1) * ({sha_word(f'{repr(path)[:-1]}.{chr(39)} || {value}', 'i - 1')} % 3 - 1)"
query("encode_struct", f"SELECT c_custkey, array_to_string({over(sgn(_ROLE('c_mktsegment', 'c_mktsegment') + ' + ' + _ROLE('c_nationkey', 'CAST(c_nationkey AS VARCHAR)') + ' + ' + _ROLE('c_name', 'c_name')))}, ',') AS v FROM customer")(
    lambda spark, d: (c := spark.read.parquet(f"{d}/customer.parquet")).select("c_custkey", text(enc.encode_rows(SPACE, F.struct("c_mktsegment", "c_nationkey", "c_name"), c.select(F.struct("c_mktsegment", "c_nationkey", "c_name").alias("s")).schema["s"].dataType)).alias("v")))
query("encode_json", f"SELECT event_id, array_to_string({over(_ROLE('k', 'json_extract_string(props, ' + chr(39) + '$.k' + chr(39) + ')'))}, ',') AS v FROM events")(
    lambda spark, d: spark.read.parquet(f"{d}/events.parquet").select("event_id", text(enc.encode_json(SPACE, F.col("props"))).alias("v")))
query("encode_nested", f"""SELECT o_orderkey, array_to_string({over(sgn(_ROLE('status', 'o_orderstatus') + f" + ({sha_word(chr(39) + 'info' + chr(39), 'i - 1')} % 3 - 1) * " + sgn(_ROLE('info.prio', 'o_orderpriority') + ' + ' + _ROLE('info.cust', 'CAST(o_custkey AS VARCHAR)'))))}, ',') AS v FROM orders""")(
    lambda spark, d: _nested(spark, d).select("o_orderkey", text(enc.encode_rows(SPACE, F.col("r"), _nested(spark, d).schema["r"].dataType)).alias("v")))


def _nested(spark, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_orderpriority").alias("prio"), F.col("o_custkey").alias("cust")).alias("info")).alias("r"))


def _tokens(spark, d: str) -> DataFrame:
    """The words of each turn, all of them; none for a null or blank text."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != "")
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", words.alias("w"))


def _sequence(spark, d: str, mode: str, n: int = 3) -> DataFrame:
    return _tokens(spark, d).select("conv_id", "turn", text(enc.encode_sequence(SPACE, F.col("w"), mode, n)).alias("v"))


def _collection(spark, d: str, hints: dict) -> DataFrame:
    t = _tokens(spark, d)
    return t.select("conv_id", "turn", text(enc.encode_rows(SPACE, F.col("w"), t.schema["w"].dataType, hints, "w")).alias("v"))


_TOK = """w AS (SELECT conv_id, turn, list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '') AS w FROM conversations),
x AS (SELECT conv_id, turn, w, unnest(range(1, len(w) + 1)) AS j FROM w)"""


def _trit(atom: str, at: str = "i - 1") -> str:
    return f"({sha_word(atom, at)} % 3 - 1)"


def _per_turn(term: str, none: str = "0", fold: str = "sum", where: str = "true", rows: str = "x") -> str:
    """SQL of a vector per turn: the sign of the fold of term (of w[j], i) over its words; none is a component for turns without words."""
    return f"""WITH {_TOK}, s AS (SELECT conv_id, turn, i, {fold}({term}) AS s FROM {rows}, unnest({EACH}) u(i) WHERE {where} GROUP BY ALL),
z AS (SELECT conv_id, turn, string_agg({sgn('s')}, ',' ORDER BY i) AS v FROM s GROUP BY ALL)
SELECT w.conv_id, w.turn, coalesce(z.v, array_to_string({over(none)}, ',')) AS v FROM w LEFT JOIN z ON w.conv_id = z.conv_id AND w.turn = z.turn"""


query("sequence_bundle", _per_turn(_trit("w[j]")))(lambda spark, d: _sequence(spark, d, "bundle"))
query("sequence_positional", _per_turn(_trit("w[j]", f"(i - 1 + j - 1) % {D}")))(lambda spark, d: _sequence(spark, d, "positional"))
query("sequence_chained", _per_turn(_trit("w[j]"), fold="product"))(lambda spark, d: _sequence(spark, d, "chained"))
_PAIR = f"CASE WHEN len(w) < 2 THEN {_trit('w[j]')} ELSE {_trit('w[j]')} * {_trit('w[j + 1]', f'i % {D}')} END"
query("sequence_ngram", _per_turn(_PAIR, where="j < len(w) OR len(w) < 2"))(lambda spark, d: _sequence(spark, d, "ngram", 2))
_ITEM = "'w.[' || (j - 1) || ']'"
query("encode_list", _per_turn(f"{_trit(f'({_ITEM})')} * {_trit(f'({_ITEM} || chr(46) || w[j])')}", _trit("'w.[]'")))(lambda spark, d: _collection(spark, d, {}))
query("encode_set", f"""WITH {_TOK}, y AS (SELECT conv_id, turn, unnest(list_distinct(w)) AS y FROM w), s AS (SELECT conv_id, turn, i, sum({_trit("('w.' || y)")}) AS s FROM y, unnest({EACH}) u(i) GROUP BY ALL),
z AS (SELECT conv_id, turn, string_agg({sgn('s')} * {_trit("'set_indicator'")}, ',' ORDER BY i) AS v FROM s GROUP BY ALL)
SELECT w.conv_id, w.turn, coalesce(z.v, array_to_string({over(_trit("'w.#{}'"))}, ',')) AS v FROM w LEFT JOIN z ON w.conv_id = z.conv_id AND w.turn = z.turn""")(lambda spark, d: _collection(spark, d, {"w": "set"}))
query("encode_striped", None)(lambda spark, d: spark.read.parquet(f"{d}/events.parquet").select("event_id", F.posexplode(enc.encode_json_striped(SPACE, F.col("props"), 4)).alias("stripe", "v")).select("event_id", "stripe", text(F.col("v")).alias("v")))
query("json_leaves", "SELECT event_id, 'k' AS path, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events")(
    lambda spark, d: enc.leaves(spark.read.parquet(f"{d}/events.parquet").select("event_id", "props"), "props").select("event_id", "path", "value"))

# expressions

def _expr():
    from . import expr as x

    return x


def _compiled(spark, d: str, build) -> DataFrame:
    x = _expr()
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", text(x.compile(build(x), SPACE)).alias("v"))


_TYPE = f"({sha_word('event_type', 'i - 1')} % 3 - 1)"


def _const(e) -> str:
    return "[" + ",".join(map(str, e)) + "][i]"


def _k(s: str):
    x = _expr()
    return x.array(x.String(s), SPACE)


query("expr_bind", f"SELECT event_id, array_to_string({over(f'{_const(_k(chr(116)))} * {_TYPE}')}, ',') AS v FROM events")(
    lambda spark, d: _compiled(spark, d, lambda x: x.Bind(x.String("t"), x.Field("event_type"))))
query("expr_bundle_thermometer", f"SELECT event_id, array_to_string({over(sgn(f'{_const(_k(chr(116)))} + {_TYPE} + CASE WHEN i <= {_LEVEL} THEN 1 ELSE -1 END'))}, ',') AS v FROM events")(
    lambda spark, d: _compiled(spark, d, lambda x: x.Bundle((x.String("t"), x.Field("event_type"), x.Thermometer(F.col("value"), 0.0, 500.0)))))
query("expr_permute_twice", f"SELECT event_id, array_to_string({over(f'({sha_word(chr(101) + "vent_type", f"(i - 1 + 5) % {D}")} % 3 - 1)')}, ',') AS v FROM events")(
    lambda spark, d: _compiled(spark, d, lambda x: x.Permute(x.Permute(x.Field("event_type"), 2), 3)))
query("expr_blend", f"SELECT event_id, array_to_string({over(sgn(f'0.4 * {_const(_k(chr(116)))} - 0.7 * {_TYPE}'))}, ',') AS v FROM events")(
    lambda spark, d: _compiled(spark, d, lambda x: x.Blend(x.String("t"), x.Field("event_type"), 0.4, -0.7)))

# detection, fields, payloads


def _events(spark, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


query("frozen_baseline_z", f"""WITH b AS (SELECT avg(value) AS m, greatest(stddev_pop(value), 0.02) AS s FROM events WHERE event_id < 500) SELECT event_id, {rsql('(value - m) / s')} AS z FROM events, b""")(
    lambda spark, d: pipe.z_scores(e := _events(spark, d).select("event_id", "value"), pipe.frozen_baseline(e.where("event_id < 500"), ["value"]), ["value"]).select("event_id", rnd(F.col("value_z")).alias("z")))
query("gated_rates", """WITH b AS (SELECT avg(value) AS m, greatest(stddev_pop(value), 0.02) AS s FROM events WHERE event_id < 500), z AS (SELECT event_type, value > 300 AS attack, (value - m) / s AS z FROM events, b),
f AS (SELECT event_type, attack, z * -1.5 < -2.5 OR (z * -1.0 < -2.0 AND z * -1.5 < -0.5) AS hit FROM z) SELECT event_type, attack, count(*) AS n, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(avg(CASE WHEN hit THEN 1.0 ELSE 0 END), 6) + 0.0 AS share FROM f GROUP BY 1, 2""")(
    lambda spark, d: pipe.rates(pipe.z_scores(e := _events(spark, d).select("event_id", "event_type", "value"), pipe.frozen_baseline(e.where("event_id < 500"), ["value"]), ["value"]).select("event_type", (F.col("value") > 300).alias("attack"), pipe.gated(F.col("value_z") * -1.5, F.col("value_z") * -1.0).alias("hit")), "event_type", "hit", "attack").select("event_type", "attack", "n", "hits", rnd(F.col("share")).alias("share")))
query("precision_recall", """WITH f AS (SELECT value > 100 AS f, event_type = 'click' AS t FROM events), s AS (SELECT CAST(sum(CASE WHEN f AND t THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN f AND NOT t THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN NOT f AND t THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM f)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) + 0.0 AS precision, round(tp / (tp + fn), 6) + 0.0 AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) + 0.0 AS f1 FROM s""")(
    lambda spark, d: pipe.precision_recall(_events(spark, d).select((F.col("value") > 100).alias("f"), (F.col("event_type") == "click").alias("t")), "f", "t").select("tp", "fp", "fn", *[rnd(F.col(c)).alias(c) for c in ("precision", "recall", "f1")]))
query("event_rate", """WITH t AS (SELECT event_id, user_id, CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS t, ts FROM events), w AS (SELECT event_id, count(*) OVER w AS n, max(t) OVER w - min(t) OVER w AS span FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
SELECT event_id, round(CASE WHEN n < 2 THEN 100.0 WHEN span <= 0 THEN 1e6 ELSE least((n - 1) / span, 1e6) END, 9) + 0.0 AS rate FROM w""")(
    lambda spark, d: pipe.event_rate(_events(spark, d), ["user_id"], "ts").select("event_id", rnd(F.col("rate"), 9).alias("rate")))
query("distinct_ratio", f"SELECT event_type, {rsql('least(count(DISTINCT props) / count(props), 1)')} AS ratio FROM events GROUP BY 1")(
    lambda spark, d: pipe.distinct_ratio(_events(spark, d), ["event_type"], "props", exact=True).select("event_type", rnd(F.col("ratio")).alias("ratio")))
query("distinct_ratio_sketch", None)(lambda spark, d: pipe.distinct_ratio(_events(spark, d), ["event_type"], "props").select("event_type", rnd(F.col("ratio"), 1).alias("ratio")))
query("dominant_values", f"""WITH c AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS r, sum(n) OVER (PARTITION BY event_type) AS total, count(*) OVER (PARTITION BY event_type) AS v FROM c)
SELECT event_type, user_id AS top, n, CAST(total AS BIGINT) AS total, v AS values, {rsql('n / total')} AS concentration FROM r WHERE r = 1""")(
    lambda spark, d: pipe.dominant(_events(spark, d), ["event_type"], "user_id").select("event_type", "top", "n", "total", "values", rnd(F.col("concentration")).alias("concentration")))
query("novel_values", "SELECT DISTINCT event_type, user_id FROM events e WHERE event_id >= 5000 AND NOT EXISTS (SELECT 1 FROM events s WHERE s.event_id < 5000 AND s.event_type = e.event_type AND s.user_id = e.user_id)")(
    lambda spark, d: pipe.novel((e := _events(spark, d)).where("event_id >= 5000").select("event_type", "user_id").distinct(), e.where("event_id < 5000"), ["event_type", "user_id"]))
query("unpivot_fields", "SELECT l_returnflag AS key, 'status' AS field, l_linestatus AS value, count(*) AS n FROM lineitem GROUP BY 1, 3 UNION ALL SELECT l_returnflag, 'line', CAST(l_linenumber AS VARCHAR), count(*) FROM lineitem GROUP BY 1, 3")(
    lambda spark, d: pipe.unpivot(spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("key"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("line")), ["key"], ["status", "line"]).groupBy("key", "field", "value").agg(F.count("*").alias("n")))
_BYTES = "b AS (SELECT page_id, i - 1 AS pos, CAST('0x' || substr(h, 2 * i - 1, 2) AS INTEGER) AS byte FROM (SELECT page_id, h, unnest(range(1, length(h) // 2 + 1)) AS i FROM (SELECT page_id, hex(encode(html)) AS h FROM pages)))"


def _payloads(spark, d: str) -> DataFrame:
    """page_id, raw, attack: pages with any byte; odd ones are taken for attacks, even ones for normal payloads."""
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.encode("html", "utf-8").alias("raw"), (F.col("page_id") % 2 == 1).alias("attack"))
    return p.where(F.length("raw") > 0)


def _byte_counts(spark, d: str) -> DataFrame:
    return pipe.byte_counts(_payloads(spark, d), "raw", "attack")


query("payload_windows", f"WITH {_BYTES} SELECT page_id, CAST(pos // 64 AS INTEGER) AS window, count(*) AS n, CAST(sum(byte) AS BIGINT) AS total FROM b GROUP BY 1, 2")(
    lambda spark, d: pipe.window_totals(_payloads(spark, d).select("page_id", "raw"), 64))
query("position_profile", f"""WITH {_BYTES}, c AS (SELECT pos, byte, count(*) AS n FROM b GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY n DESC, byte) AS r, sum(n) OVER (PARTITION BY pos) AS total, count(*) OVER (PARTITION BY pos) AS v FROM c)
SELECT CAST(pos AS INTEGER) AS pos, byte AS top, n, CAST(total AS BIGINT) AS total, v AS values, {rsql('n / total')} AS concentration, n / total >= 0.95 AS is_constant FROM r WHERE r = 1""")(
    lambda spark, d: pipe.profile_of(_byte_counts(spark, d).select("pos", "byte", (F.col("attacks") + F.col("normals")).alias("n")), "n").select("pos", "top", "n", "total", "values", rnd(F.col("concentration")).alias("concentration"), "is_constant"))
query("unseen_bytes", f"WITH {_BYTES} SELECT DISTINCT CAST(pos AS INTEGER) AS pos, byte FROM b x WHERE page_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM b y WHERE y.page_id % 2 = 0 AND x.pos = y.pos AND x.byte = y.byte)")(
    lambda spark, d: _byte_counts(spark, d).where("attacks > 0 and normals = 0").select("pos", "byte"))
query("byte_runs", f"""WITH {_BYTES}, p AS (SELECT DISTINCT page_id, pos FROM b WHERE byte = 101), g AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY page_id ORDER BY pos) > 4 THEN 1 ELSE 0 END AS n FROM p), r AS (SELECT *, sum(n) OVER (PARTITION BY page_id ORDER BY pos) AS run FROM g)
SELECT page_id, CAST(min(pos) AS INTEGER) AS first, CAST(max(pos) AS INTEGER) AS last, count(*) AS n FROM r GROUP BY page_id, run""")(
    lambda spark, d: pipe.payload_runs(_payloads(spark, d), "page_id", "raw", 101, 4))
query("best_mask", f"""WITH {_BYTES}, m AS (SELECT page_id, pos, mask, byte & mask AS match FROM b, unnest([255, 254, 252, 248, 240, 224, 192, 128]) u(mask)), a AS (SELECT pos, mask, match, count(*) AS n FROM m WHERE page_id % 2 = 1 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY n DESC, mask DESC, match) AS r FROM a WHERE NOT EXISTS (SELECT 1 FROM m y WHERE y.page_id % 2 = 0 AND y.pos = a.pos AND y.mask = a.mask AND y.match = a.match))
SELECT CAST(pos AS INTEGER) AS pos, mask, match, n FROM r WHERE r = 1""")(
    lambda spark, d: pipe.mask_of(_byte_counts(spark, d)))
_GRAMS = "g AS (SELECT x.page_id, x.pos, printf('%02x', x.byte) || printf('%02x', y.byte) AS bytes FROM b x JOIN b y ON x.page_id = y.page_id AND y.pos = x.pos + 1)"
query("rule_candidates", f"""WITH {_BYTES}, {_GRAMS}, a AS (SELECT pos, bytes, count(*) AS n FROM g WHERE page_id % 2 = 1 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY n DESC, bytes) AS r FROM a WHERE NOT EXISTS (SELECT 1 FROM g y WHERE y.page_id % 2 = 0 AND y.pos = a.pos AND y.bytes = a.bytes))
SELECT CAST(pos AS INTEGER) AS pos, bytes, n FROM r WHERE r <= 5""")(
    lambda spark, d: pipe.payload_candidates(_payloads(spark, d), "raw", "attack", 2))
query("bands", "SELECT CASE WHEN l_partkey < 1024 THEN 'system' WHEN l_partkey < 49152 THEN 'registered' ELSE 'dynamic' END AS port, CASE WHEN l_quantity * 30 < 100 THEN 'small' WHEN l_quantity * 30 < 1000 THEN 'medium' ELSE 'large' END AS size, count(*) AS n FROM lineitem GROUP BY 1, 2")(
    lambda spark, d: spark.read.parquet(f"{d}/lineitem.parquet").groupBy(pipe.port_band(F.col("l_partkey")).alias("port"), pipe.size_band(F.col("l_quantity") * 30).alias("size")).agg(F.count("*").alias("n")))
query("windowed_bundle", f"""WITH a AS (SELECT date_trunc('day', ts) AS start, i, sum({_TYPE}) AS s, count(*) AS n FROM events, unnest({EACH}) u(i) GROUP BY 1, 2) SELECT start, string_agg({sgn('s')}, ',' ORDER BY i) AS v, any_value(n) AS n FROM a GROUP BY start""")(
    lambda spark, d: _windowed(spark, d))


def _windowed(spark, d: str) -> DataFrame:
    from ..streaming.windows import windowed_bundle

    e = books.with_vectors(_events(spark, d), "event_type", books.codebook(_events(spark, d), "event_type", SPACE))
    return windowed_bundle(e, "ts", "v", D, "1 day").select("start", text(F.col("v")).alias("v"), "n")


# learners: order-dependent linear algebra, checked against numpy in the tests

query("subspace_residuals")(lambda spark, d: _sub().learn_residuals(tern(spark, d), "label", "vec_id", "v", 4).select("label", "vec_id", rnd(F.col("residual"), 4).alias("residual"), rnd(F.when(F.col("threshold") < 1e300, F.col("threshold")), 4).alias("threshold")))
query("subspace_score")(lambda spark, d: _sub().score(tern(spark, d), _sub().learn(tern(spark, d), "label", "vec_id", "v", 4), "label", "v").select("vec_id", rnd(F.col("residual"), 4).alias("residual"), "anomalous"))
query("engram_match")(lambda spark, d: _library(spark, d).match_vec(tern(spark, d), "vec_id", "v", 3).select("vec_id", "rank", "name", rnd(F.col("residual"), 4).alias("residual")))
query("engram_spectrum")(lambda spark, d: _library(spark, d).match_spectrum([3.0, 2.0, 1.0, 0.5], 5).select("name", rnd(F.col("score"), 4).alias("score")))
query("reckoner_predict")(lambda spark, d: _reck(spark, d))
query("reckoner_regress")(lambda spark, d: _regress(spark, d))
query("reckoner_curve")(lambda spark, d: _curve(spark, d))
query("hysteresis")(lambda spark, d: pipe.hysteresis(_events(spark, d).withColumn("hit", F.col("value") > 200), "user_id", "event_id", "hit"))
query("self_training")(lambda spark, d: _self_training(spark, d))


def _sub():
    from ..operators import subspace

    return subspace


def _library(spark, d: str):
    from ..operators.engrams import Library

    return Library.empty(spark).add_models(_sub().learn(tern(spark, d), "label", "vec_id", "v", 4), "label")


def _reck(spark, d: str) -> DataFrame:
    from ..operators import reckoner

    t = tern(spark, d)
    n = (t.agg(F.max("label")).first()[0] or 0) + 1
    model = reckoner.observed(t, "label", "vec_id", "v", D, n, 100)
    return reckoner.predict(t, "v", model).select("vec_id", "label", "direction", rnd(F.col("conviction"), 4).alias("conviction"))


def _regress(spark, d: str) -> DataFrame:
    from ..operators import reckoner

    t = tern(spark, d).withColumn("y", F.col("label").cast("double")).withColumn("k", F.col("vec_id") % 4)
    return reckoner.regress(t, "k", "vec_id", "v", "y", 8).select("k", "vec_id", rnd(F.col("predicted"), 4).alias("predicted"))


def _curve(spark, d: str) -> DataFrame:
    from ..operators import reckoner

    r = _reck(spark, d).select("conviction", (F.col("direction") == F.col("label")).alias("ok"), "vec_id")
    return reckoner.curve(r, "conviction", "ok", "vec_id", 10, min_resolved=200, bins=10).select(rnd(F.col("a"), 3).alias("a"), rnd(F.col("b"), 3).alias("b"))


def _self_training(spark, d: str) -> DataFrame:
    e = _events(spark, d)
    e = books.with_vectors(e, "event_type", books.codebook(e, "event_type", SPACE)).withColumn("r", scalars.encode_thermometer(SPACE, F.col("value"), 0.0, 500.0))
    return pipe.self_training(e, "user_id", "event_id", "v", "r").select("user_id", "event_id", rnd(F.col("pattern_sim"), 4).alias("pattern_sim"), rnd(F.col("rate_sim"), 4).alias("rate_sim"), "anomalous")


# the flagship: how unlike all events an event is

def flagship(spark, d: str) -> DataFrame:
    """event_id, anomaly: one less the cosine of each event's record vector and the bundle of all events; records are encoded once per distinct content."""
    e = _events(spark, d).select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    kinds = e.groupBy("event_type", "k").agg(F.count("*").alias("n"))
    shape = kinds.select(F.struct("event_type", "k").alias("s")).schema["s"].dataType
    coded = kinds.withColumn("v", enc.encode(SPACE, F.struct("event_type", "k"), shape))
    base = agg.bundle(coded, [], "v", D, F.col("n")).select(F.col("v").alias("base"))
    scored = coded.crossJoin(F.broadcast(base)).select("event_type", "k", rnd(1 - sim.cosine(F.col("v"), F.col("base"))).alias("anomaly"))  # base is one row
    return e.join(scored, ["event_type", "k"]).select("event_id", "anomaly")


_REC = sgn(_ROLE("event_type", "event_type") + " + " + _ROLE("k", "k"))
query("flagship", f"""WITH e AS (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events), c AS (SELECT event_type, k, count(*) AS n FROM e GROUP BY 1, 2), r AS (SELECT event_type, k, n, {over(_REC)} AS v FROM c),
b AS (SELECT list({sgn('s')} ORDER BY i) AS b FROM (SELECT i, sum(n * v[i]) AS s FROM r, unnest({EACH}) u(i) GROUP BY i)), x AS (SELECT event_type, k, {total('v[i] * b[i]')} / (sqrt({total('v[i] * v[i]')}) * sqrt({total('b[i] * b[i]')})) AS c FROM r, b)
SELECT event_id, {rsql('1 - c')} AS anomaly FROM e JOIN x USING (event_type, k)""")(flagship)

from . import catalog_apps  # noqa: E402, F401  (adds its queries to these)
