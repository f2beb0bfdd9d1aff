"""Whitening of embeddings by components of an exact characteristic polynomial.

Vectors become integers x = floor(256 c). Over the distinct vectors, n of them with sums S, the scatter
A = n X'X - S S' is an integer matrix and n^2 times the covariance. It is summed exactly in Spark:
tasks multiply blocks of rows that a double holds exactly, carry sums as whole numbers, and send the
d (d + 1) / 2 + d cells in limbs, so what is shuffled and gathered depends on d alone.

1. **Polynomial.** det(tI - A) is found modulo many primes, each by reduction to Hessenberg form and
   its recurrence (one Spark row a prime), and put together by Chinese remaindering; the primes' product
   exceeds twice the bound of Maclaurin, C(d, k) (trace / d)^k, for each coefficient.
2. **Roots.** All roots are real, so the number of roots above t, with multiplicity, is the number of sign
   changes of the coefficients shifted to t (Descartes). Bisection over dyadic numbers isolates each of
   the leading roots to ``BITS`` bits after its leading one.
3. **Components.** Inverse iteration in whole numbers scaled by 2^``SCALE`` on A - r I, r the root's
   midpoint; a component is kept orthogonal to those before it, so roots that are equal give a basis.

``fit(rows)`` returns a :class:`Model`; ``transform(rows, model)`` the rows whitened. ``whiten`` does both.

Defined results: rows whose vector is null, or has null or non-finite entries, are dropped; so are rows
whose entries leave the range of a long (beyond 2^62 / 256), as x is a long; vectors must have one length,
else ``fit`` raises; components whose root is zero have no whitened value and are left out, so a fit list
of one vector, or an empty table, gives an empty result; repeated rows repeat, null ids are kept, extra
columns are ignored. A deviation beyond a long is null.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townsheet.llm.common import saved, small_batches

#: Leading components, bits that a root is known to beside its magnitude, bits after the point in eliminations.
COMPONENTS, BITS, SCALE = 4, 120, 320
#: Steps of inverse iteration; each multiplies accuracy by the gap over the root's error.
STEPS = 3
LIMB = 30
LIMBS = 8


@dataclass
class Model:
    n: int
    sums: list[int]
    trace: int
    #: of the scatter, n^2 times those of the covariance
    roots: list[float]
    vectors: np.ndarray
    polynomial: list[int]


def integers(rows: DataFrame) -> DataFrame:
    """Rows that are whole, with x, the vector in units of 1/256."""
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * 256) < float(1 << 62)))
    return rows.where(whole).select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * 256).cast("long")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy()
    if len(column) and len(flat) % len(column) or column.value_lengths().unique().to_pylist()[1:]:
        raise ValueError("vectors differ in length")
    return flat.reshape(len(column), -1)


def _product(x: np.ndarray) -> np.ndarray:
    """x'x as whole numbers of any size."""
    if not x.size:
        return np.zeros((x.shape[1],) * 2, object)
    if np.abs(x).max() < 1 << 20:
        out = np.zeros((x.shape[1],) * 2, object)
        for at in range(0, len(x), 4096):  # 4096 products under 2^40 fit a double's 53 bits
            part = x[at : at + 4096].astype(np.float64)
            out += (part.T @ part).astype(np.int64).astype(object)
        return out
    low = x & 0xFFFFF
    high = x >> 20
    both = np.concatenate([low, high], axis=1)
    d = x.shape[1]
    p = _product(both)
    return p[:d, :d] + ((p[:d, d:] + p[d:, :d]) << 20) + (p[d:, d:] << 40)


def _limbs(value: int) -> list[int]:
    """value as signed limbs of LIMB bits, lowest first, the last one unbounded."""
    out = []
    for _ in range(LIMBS - 1):
        out.append(value & (1 << LIMB) - 1)
        value >>= LIMB
    return [*out, value]


def scatter(distinct: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """n, sums and x'x of a table of distinct x, exactly."""

    def run(batches):
        n, sums, products = 0, None, None
        for batch in batches:
            x = _matrix(batch.column("x"))
            if not len(x):
                continue
            if sums is not None and len(sums) != x.shape[1]:
                raise ValueError("vectors differ in length")
            part, total = _product(x), x.astype(object).sum(0)
            n, sums, products = n + len(x), total if sums is None else sums + total, part if products is None else products + part
        if n:
            d = len(sums)
            cells = [(-1, -1, n), *((i, -1, int(sums[i])) for i in range(d)), *((i, j, int(products[i, j])) for i in range(d) for j in range(i, d))]
            limbs = [_limbs(v) for _, _, v in cells]
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.int32()), *(pa.array([v[k] for v in limbs], pa.int64()) for k in range(LIMBS))], names=["i", "j", *(f"l{k}" for k in range(LIMBS))])

    small_batches(distinct.sparkSession)
    sent = distinct.select("x").mapInArrow(run, "i int, j int, " + ", ".join(f"l{k} long" for k in range(LIMBS)))
    found = {(r.i, r.j): sum(r[f"l{k}"] << LIMB * k for k in range(LIMBS)) for r in sent.groupBy("i", "j").agg(*(F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS))).collect()}
    d = sum(j == -1 for _, j in found) - 1
    if d < 0:
        return 0, [], []
    if len(found) != 1 + d + d * (d + 1) // 2:
        raise ValueError("vectors differ in length")
    return found[-1, -1], [found[i, -1] for i in range(d)], [[found[min(i, j), max(i, j)] for j in range(d)] for i in range(d)]


def _prime(n: int) -> bool:
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7):  # decides below 3,215,031,751
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes(bits: int) -> list[int]:
    """Primes below 2^31, the greatest first, with a product of over ``bits`` bits."""
    out, product, p = [], 1, (1 << 31) - 1
    while product.bit_length() <= bits:
        if _prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def polynomial_mod(a: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(tI - a) mod p, lowest first, by Hessenberg reduction."""
    h, d = a.astype(np.int64) % p, len(a)
    for k in range(1, d - 1):
        below = np.flatnonzero(h[k:, k - 1])
        if not len(below):
            continue
        pivot = k + int(below[0])
        if pivot != k:
            h[[k, pivot]] = h[[pivot, k]]
            h[:, [k, pivot]] = h[:, [pivot, k]]
        f = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1 :] = (h[k + 1 :] - f[:, None] * h[k] % p) % p
        for row in np.flatnonzero(f):  # the inverse on the right
            h[:, k] += h[:, k + 1 + row] * int(f[row]) % p
        h[:, k] %= p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        now = np.zeros(d + 1, np.int64)
        now[1:] = polys[k - 1, :-1]
        now = (now - polys[k - 1] * h[k - 1, k - 1]) % p
        t = 1
        for i in range(k - 1, 0, -1):
            t = t * int(h[i, i - 1]) % p
            if not t:
                break
            now = (now - polys[i - 1] * (t * int(h[i - 1, k - 1]) % p)) % p
        polys[k] = now
    return [int(c) for c in polys[d]]


def polynomial(spark, a: list[list[int]]) -> list[int]:
    """Coefficients of det(tI - a), lowest first, of a positive semidefinite whole matrix; primes are Spark rows."""
    d = len(a)
    trace = sum(a[i][i] for i in range(d))
    bound = max(comb(d, k) * (trace**k // d**k + 1) for k in range(d + 1))
    moduli = primes(bound.bit_length() + 2)
    sent = spark.sparkContext.broadcast(a)

    def run(batches):
        whole = np.array(sent.value, object)
        for batch in batches:
            for p in batch.column("id").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([polynomial_mod((whole % p).astype(np.int64), p)], pa.list_(pa.int64()))], names=["p", "c"])

    table = spark.createDataFrame([(p,) for p in moduli], "id long").repartition(min(len(moduli), 4 * spark.sparkContext.defaultParallelism))
    found = {r.p: r.c for r in table.mapInArrow(run, "p long, c array<long>").collect()}
    product, out = 1, [0] * (d + 1)
    for p in moduli:
        inverse = pow(product, -1, p)
        out = [c + product * ((r - c) * inverse % p) for c, r in zip(out, found[p])]
        product *= p
    return [c - product if c > product // 2 else c for c in out]


def shifted(c: list[int], m: int, s: int) -> list[int]:
    """Coefficients of 2^(s d) c((y + m) / 2^s): roots moved down by m / 2^s and spread by 2^s."""
    d = len(c) - 1
    out = [x << s * (d - k) for k, x in enumerate(c)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            out[k] += m * out[k + 1]
    return out


def above(c: list[int], m: int, s: int) -> int:
    """Roots over m / 2^s, with multiplicity, of a polynomial with real roots alone."""
    signs = [x > 0 for x in shifted(c, m, s) if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def roots(c: list[int], count: int, bits: int = BITS) -> list[tuple[int, int]]:
    """The greatest ``count`` positive roots, falling, as m with root in (m - 1, m] / 2^s, and s; equal ones repeat."""
    out: list[tuple[int, int]] = []
    top = -c[-2]  # the trace: no root is greater, as none is negative
    for rank in range(1, min(count, above(c, 0, 0)) + 1):
        low, high, s = 0, top, 0
        while high - low > 1:
            m = (low + high) // 2
            low, high = (m, high) if above(c, m, 0) >= rank else (low, m)
        while high.bit_length() < bits:
            step = min(8, bits - high.bit_length())
            low, high, s = low << step, high << step, s + step
            while high - low > 1:
                m = (low + high) // 2
                low, high = (m, high) if above(c, m, s) >= rank else (low, m)
        out.append((high, s))
    return out


def _rounded(x: np.ndarray) -> np.ndarray:
    return (x + (1 << SCALE - 1)) >> SCALE


def _unit(v: np.ndarray) -> np.ndarray:
    return (v << SCALE) // isqrt(int((v * v).sum()))


def vectors(a: list[list[int]], found: list[tuple[int, int]]) -> np.ndarray:
    """Unit vectors of A's leading roots, by inverse iteration on numbers scaled by 2^SCALE."""
    d, out = len(a), []
    whole = np.array(a, object)
    for m, s in found:
        shift = ((2 * m - 1) << SCALE) >> (s + 1)
        # in units of A's trace, so that pivots are neither tiny nor huge
        size = max(1, int(np.trace(whole)))
        lu = (whole << SCALE) - np.diag([shift] * d).astype(object)
        lu //= size
        order = np.arange(d)
        for k in range(d):
            pivot = k + int(np.argmax(np.abs(lu[k:, k])))
            if pivot != k:
                lu[[k, pivot]], order[[k, pivot]] = lu[[pivot, k]], order[[pivot, k]]
            if not lu[k, k]:
                lu[k, k] = 1  # the midpoint is the root itself, to the last bit
            if k + 1 < d:
                lu[k + 1 :, k] = (lu[k + 1 :, k] << SCALE) // lu[k, k]
                lu[k + 1 :, k + 1 :] -= _rounded(np.outer(lu[k + 1 :, k], lu[k, k + 1 :]))
        v = np.array([(1 << SCALE) + ((i * 7919 + 13 * len(out)) % 101 << SCALE - 7) for i in range(d)], object)
        for _ in range(STEPS):
            v = v[order]
            for k in range(d):
                v[k + 1 :] -= _rounded(lu[k + 1 :, k] * v[k])
            for k in range(d - 1, -1, -1):
                v[k] = (v[k] << SCALE) // lu[k, k]
                v[:k] -= _rounded(lu[:k, k] * v[k])
            v = _unit(v)
            for _ in range(2):
                for u in out:
                    v = v - _rounded(u * ((v * u).sum() >> SCALE))
            v = _unit(v)
        out.append(v)
    return np.array([[int(x) / (1 << SCALE) for x in v] for v in out]).reshape(len(out), d)


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Model:
    n, sums, products = scatter(distinct)
    d = len(sums)
    a = [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    trace = sum(a[i][i] for i in range(d))
    if not trace:
        return Model(n, sums, 0, [], np.empty((0, d)), [])
    c = polynomial(distinct.sparkSession, a)
    found = roots(c, components)
    return Model(n, sums, trace, [m / (1 << s) for m, s in found], vectors(a, found), c)


def centred(x: np.ndarray, model: Model) -> np.ndarray:
    """n x - S, exactly; a table of longs where they suffice."""
    top = model.n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, model.sums))
    if top < 1 << 62:
        return x * np.int64(model.n) - np.array(model.sums, np.int64)
    return x.astype(object) * model.n - np.array(model.sums, object)


def whitened(x: np.ndarray, model: Model) -> np.ndarray:
    """Values of each row and component: the deviation from the mean, projected, over the root of the eigenvalue."""
    return centred(x, model).astype(np.float64) @ model.vectors.T / np.sqrt(np.array(model.roots))


def transform(rows: DataFrame, model: Model) -> DataFrame:
    """vec_id, deviation and whitened (by component) of rows with x."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for batch in batches:
            x = _matrix(batch.column("x"))
            if not len(x):
                continue
            c = centred(x, model)
            top = int(np.abs(c).max(initial=0))
            squares = (c * c).sum(1) if top * top * x.shape[1] < 1 << 63 else (c.astype(object) ** 2).sum(1)
            deviation = [int(v) if v < 1 << 63 else None for v in squares.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(deviation, pa.int64()), pa.array(list(whitened(x, model)), pa.list_(pa.float64()))], names=["vec_id", "deviation", "whitened"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


def identity_error(distinct: DataFrame, model: Model) -> float:
    """The largest entry of the whitened fit list's covariance, less the identity."""
    sent = distinct.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        k = len(model.roots)
        sums = np.zeros((k + 1, k))
        for batch in batches:
            w = whitened(_matrix(batch.column("x")), model) if len(batch) else np.empty((0, k))
            sums[:k] += w.T @ w
            sums[k] += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k + 1), k)), pa.array(np.tile(np.arange(k), k + 1)), pa.array(sums.ravel())], names=["i", "j", "s"])

    k = len(model.roots)
    total = np.zeros((k + 1, k))
    for r in distinct.select("x").mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        total[r.i, r.j] = r.s
    mean = total[k] / model.n
    return float(np.abs(total[:k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every whole row and component."""
    small_batches(rows.sparkSession)
    whole = integers(rows)
    distinct = saved(whole.select("x").distinct(), "vectors")
    model = fit(distinct, components)
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not model.roots:
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(distinct, model)
    explained = F.array(*[F.lit(r / model.trace) for r in model.roots])
    found = transform(whole, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return found.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
