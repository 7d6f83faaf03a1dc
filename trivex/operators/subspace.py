"""Online subspaces: incremental principal components of ordered vectors, one model per key, and scoring of rows against models.

Learning depends on order and can't be merged, so a model's rows are sorted within one task and models (keys, stripes) run in parallel. Scoring is stateless: models are few and small rows, joined by key, and rows are scored in Arrow batches.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .ordered import matrix, streamed

MODEL = "dim int, k int, amnesia double, ema_alpha double, sigma_mult double, reorth_interval int, n long, mean array<double>, components array<double>, res_ema double, res_var_ema double, min_components int, max_components int, grow_threshold double, shrink_threshold double"
FIELDS = [x.split()[0] for x in MODEL.split(", ")]
TINY = 1e-10
#: Vectors that are learned in one go; a go has as many steps more as there are components.
BLOCK = 500


@dataclass
class Subspace:
    """Mean and up to k components of what was seen, with an adaptive threshold on the residual."""

    dim: int
    k: int
    amnesia: float = 2.0
    ema_alpha: float = 0.01
    sigma_mult: float = 3.5
    reorth_interval: int = 500
    n: int = 0
    mean: np.ndarray | None = None
    components: np.ndarray | None = None
    res_ema: float = 0.0
    res_var_ema: float = 0.0
    min_components: int | None = None
    max_components: int | None = None
    grow_threshold: float = 0.05
    shrink_threshold: float = 0.01
    _: int = field(default=0, repr=False)

    def __post_init__(self):
        self.k = min(self.k, self.dim)
        self.mean = np.zeros(self.dim) if self.mean is None else np.asarray(self.mean, float).copy()
        self.components = np.zeros((self.k, self.dim)) if self.components is None else np.asarray(self.components, float).reshape(-1, self.dim).copy()
        self.k = len(self.components)
        self.min_components = self.k if self.min_components is None else self.min_components
        self.max_components = max(64, 8 * self.k) if self.max_components is None else self.max_components

    def norms(self) -> np.ndarray:
        return np.sqrt((self.components**2).sum(1))

    eigenvalues = norms

    def basis(self) -> np.ndarray:
        n = self.norms()
        return self.components[n > TINY] / n[n > TINY][:, None]

    def threshold(self) -> float:
        return self.res_ema + self.sigma_mult * float(np.sqrt(self.res_var_ema)) if self.n >= 2 else float("inf")

    def explained_ratio(self) -> float:
        return max(0.0, 1 - self.res_ema**2 / self.dim) if self.n >= 10 else 0.0

    def residuals(self, x: np.ndarray) -> np.ndarray:
        """Norm of each row after deflation through all components; many rows meet the product of all deflations at once."""
        x = np.atleast_2d(np.asarray(x, float)) - self.mean
        basis = self.basis()
        if len(x) > self.dim and 16 * len(basis) > self.dim:
            whole = np.eye(self.dim)
            for b in basis:
                whole -= np.outer(whole @ b, b)
            x = x @ whole
        else:
            for b in basis:
                x = x - np.outer(x @ b, b)
        return np.sqrt((x * x).sum(1))

    def residual(self, x) -> float:
        return float(self.residuals(x)[0])

    def project(self, x) -> np.ndarray:
        n = self.norms()
        unit = np.divide(self.components, n[:, None], out=np.zeros_like(self.components), where=n[:, None] > TINY)
        return (np.asarray(x, float) - self.mean) @ unit.T

    def reconstruct(self, x) -> np.ndarray:
        n = self.norms()
        unit = np.divide(self.components, n[:, None], out=np.zeros_like(self.components), where=n[:, None] > TINY)
        return self.mean + self.project(x) @ unit

    def anomalous_component(self, x) -> np.ndarray:
        return np.asarray(x, float) - self.reconstruct(x)

    def update(self, x) -> float:
        """Learns one vector; its residual before that."""
        x = np.asarray(x, float)
        if x.shape != (self.dim,):
            raise ValueError(f"expected {self.dim} components, got {x.shape}")
        res = self.residual(x) if self.n else float(np.sqrt(x @ x))
        self.n += 1
        n = self.n
        self.mean += (x - self.mean) / n
        rest = x - self.mean
        if n > 1:
            for v in self.components:
                size = np.sqrt(v @ v)
                if size < TINY:
                    if np.sqrt(rest @ rest) > TINY:
                        v[:] = rest * ((1 + self.amnesia) / n)
                else:
                    v[:] = (n - 1 - self.amnesia) / n * v + (1 + self.amnesia) / n * (rest @ v / size) * rest
                size2 = v @ v
                if size2 > TINY**2:
                    rest = rest - (rest @ v / size2) * v
        else:
            self.components[0] = rest
        self._observe(n, res)
        if n > 1:
            self._resize()
            if self.reorth_interval and n % self.reorth_interval == 0:
                self.reorthogonalize()
        return res

    def _resize(self):
        if self.k < 2:
            return
        s = self.norms()
        ratio = s[-1] / max(s[0], TINY)
        if ratio > self.grow_threshold and self.k < self.max_components:
            self.components = np.vstack((self.components, np.zeros(self.dim)))
        elif ratio < self.shrink_threshold and self.k > self.min_components:
            self.components = self.components[:-1].copy()
        self.k = len(self.components)

    def reorthogonalize(self):
        for i, v in enumerate(self.components):
            size = np.sqrt(v @ v)
            for o in self.components[:i]:
                oo = o @ o
                if oo > TINY**2:
                    v -= (v @ o / oo) * o
            now = np.sqrt(v @ v)
            if now > TINY and size > TINY:
                v *= size / now

    def update_batch(self, xs) -> list[float]:
        return self.learned(xs)[0].tolist()

    def learned(self, xs) -> tuple[np.ndarray, np.ndarray]:
        """Learns vectors in order, each as update() does; the residual of each before that, and the threshold after."""
        xs = np.atleast_2d(np.asarray(xs, float))
        if xs.shape[1] != self.dim:
            raise ValueError(f"expected {self.dim} components, got {xs.shape[1]}")
        res, top = np.zeros(len(xs)), np.full(len(xs), np.inf)
        at = 0
        while at < len(xs):
            idle = self._idle(xs[at:])
            if idle:
                first, self.n = self.n, self.n + idle
                top[at + max(0, 1 - first) : at + idle] = 0.0
                at += idle
            elif not self.n:
                res[at] = self.update(xs[at])
                at += 1
            else:
                size = min(BLOCK, len(xs) - at, self.reorth_interval - self.n % self.reorth_interval if self.reorth_interval else BLOCK)
                first = self.n
                res[at : at + size] = self._block(xs[at : at + size])
                for i in range(at, at + size):
                    self._observe(first + 1 + i - at, float(res[i]))
                    top[i] = self.res_ema + self.sigma_mult * self.res_var_ema**0.5
                at += size
        return res, top

    def _idle(self, xs: np.ndarray) -> int:
        """How many vectors at the start are zeros that leave a model of zeros as it is, but for its count."""
        if xs[0].any() or self.res_ema or self.res_var_ema or self.k > self.min_components or self.mean.any() or self.components.any():
            return 0
        busy = np.flatnonzero(xs.any(1))
        return int(busy[0]) if len(busy) else len(xs)

    def _observe(self, n: int, res: float):
        alpha = 1 / n if n <= 1 / self.ema_alpha else self.ema_alpha
        delta = res - self.res_ema
        self.res_ema += alpha * delta
        self.res_var_ema = (1 - alpha) * self.res_var_ema + alpha * delta * delta

    def _block(self, xs: np.ndarray) -> np.ndarray:
        """Residuals of vectors that are learned, none of them the first; the next reorthogonalization is at their end or later.

        Component j learns from vector t what the components before it left, and only needs itself after vector t - 1: all (t, j) with t + j = step are independent, so a step is one operation on a band of vectors and components instead of one per component. Components are kept in descending order, as then both bands are slices.
        """
        rows, first = len(xs), self.n
        n = first + 1.0 + np.arange(rows)
        mean = (self.mean * first + np.cumsum(xs, 0)) / n[:, None]
        left = xs - np.vstack((self.mean, mean[:-1]))  # for the residual, by the components before the update
        rest = xs - mean  # for the update
        keep, take = (n - 1 - self.amnesia) / n, (1 + self.amnesia) / n
        most = max(self.k, min(self.max_components, self.k + rows))
        v = np.zeros((most, self.dim))
        v[most - self.k :] = self.components[::-1]
        dots = getattr(np, "vecdot", None) or (lambda a, b: np.einsum("ij,ij->i", a, b))
        sq = dots(v, v)
        size, made, leading = np.sqrt(sq), np.empty((most, self.dim)), np.zeros(rows)
        ks, done, high, step = [self.k], 0, -1, 0  # ks[t]: components that vector t meets
        while done < rows:
            high += 1
            while high > step or high >= ks[min(step - high, len(ks) - 1)]:
                high -= 1
            low = max(0, step - rows + 1)
            t, j = slice(step - high, step - low + 1), slice(most - 1 - high, most - low)
            x, r, c, s, q, tmp = rest[t], left[t], v[j], size[j], sq[j], made[j]
            gain, hold, old = dots(x, c), keep[t], dots(r, c)
            alive = None
            if s.min() >= TINY:
                old /= q
                gain /= s
                gain *= take[t]
            else:
                alive = s >= TINY
                starts = ~alive & (dots(x, x) > TINY**2)
                old = np.where(alive, old / np.where(alive, q, 1.0), 0.0)
                gain = np.where(alive, take[t] * gain / np.where(alive, s, 1.0), np.where(starts, take[t], 0.0))
                hold = np.where(alive, hold, np.where(starts, 0.0, 1.0))
            np.multiply(c, old[:, None], out=tmp)
            np.subtract(r, tmp, out=r)
            np.multiply(x, gain[:, None], out=tmp)
            np.multiply(c, hold[:, None], out=c)
            np.add(c, tmp, out=c)
            q[:] = dots(c, c)
            np.sqrt(q, out=s)
            share = dots(x, c)
            if q.min() > TINY**2:
                share /= q
            else:
                share = np.where(q > TINY**2, share / np.where(q > TINY**2, q, 1.0), 0.0)
            np.multiply(c, share[:, None], out=tmp)
            np.subtract(x, tmp, out=x)
            if low == 0:
                leading[step] = size[most - 1]
            while done < rows and done + ks[done] - 1 <= step:
                k = ks[done]
                ratio = size[most - k] / max(leading[done], TINY)
                if k >= 2 and ratio > self.grow_threshold and k < self.max_components:
                    v[most - 1 - k], sq[most - 1 - k], size[most - 1 - k] = 0.0, 0.0, 0.0
                    k += 1
                elif k >= 2 and ratio < self.shrink_threshold and k > self.min_components:
                    k -= 1
                ks.append(k)
                done += 1
            step += 1
        self.k, self.n, self.mean = ks[-1], first + rows, mean[-1]
        self.components = v[most - self.k :][::-1].copy()
        if self.reorth_interval and self.n % self.reorth_interval == 0:
            self.reorthogonalize()
        return np.sqrt((left * left).sum(1))

    def alignment(self, other: "Subspace", top: int = 0) -> float:
        """Mean of the top cosines of the principal angles; 0 means a quarter of them, three at least."""
        u, v = self.basis(), other.basis()
        if not len(u) or not len(v):
            return 0.0
        e = np.linalg.eigvalsh((u @ v.T).T @ (u @ v.T))
        cos = np.sort(np.minimum(np.sqrt(np.maximum(e, 0)), 1))[::-1]
        top = min(max(3, len(cos) // 4) if top == 0 else top, len(cos))
        return float(cos[:top].mean())

    def snapshot(self) -> dict:
        d = {k: v for k, v in asdict(self).items() if k in FIELDS}
        return d | {"mean": self.mean.tolist(), "components": self.components.ravel().tolist()}

    @staticmethod
    def restore(s: dict) -> "Subspace":
        return Subspace(**{k: s[k] for k in FIELDS if s.get(k) is not None})


class Striped:
    """Subspaces side by side, one per stripe of a record: each learns its own part, so a field only disturbs its stripe. Residual and threshold are roots of sums of squares."""

    def __init__(self, dim: int, k: int, stripes: int, **params):
        self.stripes = [Subspace(dim, k, **params) for _ in range(stripes)]

    @property
    def dim(self) -> int:
        return self.stripes[0].dim if self.stripes else 0

    @property
    def k(self) -> int:
        return self.stripes[0].k if self.stripes else 0

    @property
    def n(self) -> int:
        return self.stripes[0].n if self.stripes else 0

    def __len__(self) -> int:
        return len(self.stripes)

    def _parts(self, x):
        if len(x) != len(self.stripes):
            raise ValueError(f"expected {len(self.stripes)} stripes, got {len(x)}")
        return zip(self.stripes, x, strict=True)

    def update(self, x) -> float:
        """Learns the vectors of a record's stripes; their residual before that."""
        return float(np.sqrt(sum(s.update(v) ** 2 for s, v in self._parts(x))))

    def residual_profile(self, x) -> list[float]:
        return [s.residual(v) for s, v in self._parts(x)]

    def residual(self, x) -> float:
        return float(np.sqrt(sum(r * r for r in self.residual_profile(x))))

    def thresholds(self) -> list[float]:
        return [s.threshold() for s in self.stripes]

    def threshold(self) -> float:
        """Infinite while a stripe has none."""
        return float(np.sqrt(sum(t * t for t in self.thresholds())))

    def anomalous_component(self, x, stripe: int) -> np.ndarray:
        return self.stripes[stripe].anomalous_component(x[stripe])

    def snapshot(self) -> list[dict]:
        return [s.snapshot() for s in self.stripes]

    @staticmethod
    def restore(rows: list[dict]) -> "Striped":
        out = Striped(0, 0, 0)
        out.stripes = [Subspace.restore(r) for r in rows]
        return out


def learn(df: DataFrame, key: str | list[str], order: str, vec: str, k: int, **params) -> DataFrame:
    """A model row per key, from its vectors in ascending order, which stream past. No name of a key may be one of a model's fields."""
    keys = [key] if isinstance(key, str) else key
    if set(keys) & set(FIELDS):
        raise ValueError(f"rename the key: {set(keys) & set(FIELDS)} are fields of a model")
    kinds = {c: df.schema[c].dataType for c in keys}

    def feed(state, b):
        m = matrix(b.column(vec))
        if "model" not in state:
            state.update(model=Subspace(m.shape[1], k, **params), types=[b.column(c).type for c in keys])
        state["model"].update_batch(m)

    def finish(state, name):
        snap = state["model"].snapshot()
        cols = [pa.array([v], t) for v, t in zip(name, state["types"], strict=True)] + [pa.array([snap[f]], _type(f)) for f in FIELDS]
        return pa.RecordBatch.from_arrays(cols, [*keys, *FIELDS])

    form = ", ".join(f"`{c}` {t.simpleString()}" for c, t in kinds.items())
    return streamed(_vectors(df, keys, order, vec), keys, order, f"{form}, {MODEL}", dict, feed, finish)


def learn_residuals(df: DataFrame, key: str | list[str], order: str, vec: str, k: int, **params) -> DataFrame:
    """keys, order, residual, threshold: the residual of each vector before it was learned, and the threshold after."""
    keys = [key] if isinstance(key, str) else key

    def feed(state, b):
        m = matrix(b.column(vec))
        s = state.setdefault("model", None) or Subspace(m.shape[1], k, **params)
        state["model"] = s
        cols = [pa.array(c) for c in s.learned(m)]
        return pa.RecordBatch.from_arrays([*[b.column(c) for c in (*keys, order)], *cols], [*keys, order, "residual", "threshold"])

    form = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (*keys, order))
    return streamed(_vectors(df, keys, order, vec), keys, order, f"{form}, residual double, threshold double", dict, feed)


def _vectors(df: DataFrame, keys: list[str], order: str, vec: str) -> DataFrame:
    """keys, order and vectors, small whole numbers as they are, since a key's rows are sorted in one task."""
    v = F.col(vec) if df.schema[vec].dataType.simpleString() == "array<tinyint>" else F.col(vec).cast("array<double>").alias(vec)
    return df.select(*keys, order, v).where(F.col(vec).isNotNull())


def stripes_of(df: DataFrame, keys: list[str], order: str, stripes: str) -> DataFrame:
    """keys, order, stripe, v: a row per stripe of an array of vectors, so that the stripes of a key learn in parallel."""
    return df.select(*keys, order, F.posexplode(stripes).alias("stripe", "v"))


def learn_striped(df: DataFrame, key: str, order: str, stripes: str, k: int, **params) -> DataFrame:
    """A model row per key and stripe of the records' stripe vectors."""
    return learn(stripes_of(df, [key], order, stripes), [key, "stripe"], order, "v", k, **params)


def score_striped(rows: DataFrame, models: DataFrame, key: str, order: str, stripes: str) -> DataFrame:
    """key, order, residual, threshold, anomalous, profile (residual of each stripe) of each record under the striped model of its key.

    A record is scored where it is, if the models are few bytes; else its stripes meet their models by key. order is unique within a key.
    """
    if model_bytes(models) > SENT_BYTES:
        one = F.concat_ws("/", F.col(key).cast("string"), F.col("stripe").cast("string"))
        each = score(stripes_of(rows, [key], order, stripes).withColumn("_model", one), models.withColumn("_model", one).drop(key, "stripe"), "_model", "v")
        rss = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)))
        profile = F.transform(F.array_sort(F.collect_list(F.struct("stripe", "residual"))), lambda x: x["residual"])
        out = each.groupBy(key, order).agg(rss("residual").alias("residual"), rss("threshold").alias("threshold"), profile.alias("profile"))
        return out.withColumn("anomalous", F.col("residual") > F.col("threshold"))
    sent = rows.sparkSession.sparkContext.broadcast({(r[key], r["stripe"]): {f: r[f] for f in FIELDS} for r in models.collect()})

    def run(batches):
        known: dict = {}
        for b in batches:
            keys, lists = b.column(0).dictionary_encode(), b.column(2)
            v, counts = lists.flatten(), lists.value_lengths().to_numpy()
            starts = np.concatenate(([0], np.cumsum(counts)))
            row = np.repeat(np.arange(b.num_rows), counts)
            stripe, code = np.arange(len(v)) - starts[row], keys.indices.fill_null(-1).to_numpy()[row]
            res, top = np.full(len(v), np.nan), np.full(len(v), np.nan)
            valid, names = v.is_valid().to_numpy(zero_copy_only=False), keys.dictionary.to_pylist()
            for k, p in set(zip(code.tolist(), stripe.tolist(), strict=True)):
                name = (names[k] if k >= 0 else None, p)
                if name in sent.value:
                    if len(known) > 1000:
                        known = {}
                    s = known.get(name) or known.setdefault(name, Subspace.restore(sent.value[name]))
                    at = np.flatnonzero((code == k) & (stripe == p) & valid)
                    if len(at):
                        res[at], top[at] = s.residuals(matrix(v.take(pa.array(at)))), s.threshold()
            found = ~np.isnan(res)
            total = lambda x: np.sqrt(np.where(np.bincount(row[found], minlength=b.num_rows) > 0, np.bincount(row[found], (x * x)[found], b.num_rows), np.nan))
            cols = [pa.array(total(x), pa.float64(), from_pandas=True) for x in (res, top)]
            profile = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(res, pa.float64(), from_pandas=True))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols, profile], [key, order, "residual", "threshold", "profile"])

    form = StructType([rows.schema[key], rows.schema[order], StructField("residual", DoubleType()), StructField("threshold", DoubleType()), StructField("profile", ArrayType(DoubleType()))])
    out = rows.select(key, order, stripes).where(F.size(stripes) > 0).mapInArrow(run, form)
    return out.withColumn("anomalous", F.col("residual") > F.col("threshold"))


def _type(f: str) -> pa.DataType:
    kind = dict(x.split() for x in MODEL.split(", "))[f]
    return {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}[kind]


#: Models of at most so many bytes are sent to every task; more are joined by key, and so many rows of a key meet them in a group.
SENT_BYTES, GROUP_ROWS = 64 << 20, 50_000


def model_bytes(models: DataFrame) -> int:
    """Bytes of the arrays of all models."""
    return models.agg(F.sum((F.size("components") + F.size("mean") + 16).cast("long") * 8)).first()[0] or 0


def score(rows: DataFrame, models: DataFrame, key: str, vec: str) -> DataFrame:
    """rows with residual, threshold and anomalous under the model of their key.

    Models are sent to the tasks if their bytes are counted to be few; else rows and models meet by key, the rows of a large key dealt to groups that each get its model.
    """
    if model_bytes(models) > SENT_BYTES:
        return _score_by_key(rows, models, key, vec)
    sent = rows.sparkSession.sparkContext.broadcast({r[key]: {f: r[f] for f in FIELDS} for r in models.collect()})
    names = rows.columns

    def run(batches):
        known: dict = {}
        for b in batches:
            keys, v = b.column("_key").to_pylist(), b.column("_x")
            res, top = (np.full(b.num_rows, np.nan) for _ in range(2))
            places: dict = {}
            for i in np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False)).tolist():
                if keys[i] is not None and keys[i] in sent.value:
                    places.setdefault(keys[i], []).append(i)
            for name, at in places.items():
                if len(known) > 1000:
                    known = {}
                s = known.get(name) or known.setdefault(name, Subspace.restore(sent.value[name]))
                res[at], top[at] = s.residuals(matrix(v.take(pa.array(at)))), s.threshold()
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *(pa.array(c, pa.float64(), from_pandas=True) for c in (res, top))], [*names, "residual", "threshold"])

    # an operator, not a UDF: what reads the result can put a UDF into a filter after UDFs were planned, and that fails
    form = StructType([*rows.schema.fields, StructField("residual", DoubleType()), StructField("threshold", DoubleType())])
    x = F.col(vec) if rows.schema[vec].dataType.simpleString() == "array<tinyint>" else F.col(vec).cast("array<double>")
    scored = rows.select("*", F.col(key).alias("_key"), x.alias("_x")).mapInArrow(run, form)
    return scored.withColumn("anomalous", F.col("residual") > F.col("threshold"))


def _score_by_key(rows: DataFrame, models: DataFrame, key: str, vec: str) -> DataFrame:
    sizes = rows.groupBy(key).agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("_parts")).withColumnRenamed(key, "_key")
    dealt = rows.join(sizes, F.col(key) == F.col("_key")).withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.col("_parts")).cast("int")).withColumn("_x", F.col(vec).cast("array<double>"))
    each = models.join(sizes, F.col(key) == F.col("_key")).select(F.col(key).alias("_key"), *FIELDS, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    schema = dealt.drop("_parts", "_part", "_x", "_key").schema
    form = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + ["residual double", "threshold double"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        res, top = np.full(n, np.nan), np.full(n, np.nan)
        if right.num_rows and n:
            s = Subspace.restore({f: right.column(f)[0].as_py() for f in FIELDS})
            res, top = s.residuals(matrix(left.column("_x").combine_chunks())), np.full(n, s.threshold())
        return left.select(schema.names).append_column("residual", pa.array(res)).append_column("threshold", pa.array(top))

    out = dealt.drop("_parts").groupBy("_key", "_part").cogroup(each.groupBy("_key", "_part")).applyInArrow(meet, form)
    return out.withColumn("anomalous", F.col("residual") > F.col("threshold"))


def striped(profile: DataFrame, keys: list[str]) -> DataFrame:
    """keys, residual, threshold over the stripes of a record: root of the sum of squares; no threshold if a stripe has none."""
    rss = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)))
    return profile.groupBy(*keys).agg(rss("residual").alias("residual"), rss("threshold").alias("threshold"))


def attribution(golden: dict, drifted: dict, score_of) -> list[tuple[str, float]]:
    """Fields whose return to the golden value lowers a record's residual, by how much, largest first."""
    base = score_of(drifted)
    drops = [(f, base - score_of(drifted | {f: golden[f]})) for f in drifted if f in golden and drifted[f] != golden[f]]
    return sorted(((f, d) for f, d in drops if d > 0), key=lambda x: (-x[1], x[0]))


def residual_column(model: Subspace, vec: Column) -> Column:
    """Residual under one model known when the plan is made."""

    @F.pandas_udf("double")
    def run(v):
        import pandas as pd

        return pd.Series(model.residuals(np.stack(v.to_numpy())))

    return run(vec.cast("array<double>"))
