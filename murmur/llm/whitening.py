"""Embedding whitening by the exact characteristic polynomial.

Vectors are put on an integer grid, x = floor(1024 c) (a constant offset of x
changes neither covariances nor deviations).  Tasks sum x and x xT exactly;
the sums give the integer scatter n sum(x xT) - S ST = n^2 V.  Its
characteristic polynomial is computed modulo enough 31-bit primes by reduction
to Hessenberg form, one prime a row of a Spark job, and each coefficient is put
together by Chinese remaindering (its bound is proven: coefficients of a
positive semidefinite matrix are sums of principal minors, at most
prod(1 + diagonal)).  All roots are real, so the sign changes of the shifted
coefficients count the roots above a point exactly; bisection isolates the
largest roots, with multiplicity, to ``ROOT_BITS`` relative bits.  Components
are the null spaces at these roots, by inverse iteration in fixed-point
integers, roots closer than 2^-60 of the largest being one space.

What reaches the driver is bounded by the dimension d alone: d (d + 1) / 2
sums, d + 1 coefficients, ``components`` vectors.

Defined cases: rows whose vector is null, empty or holds null or non-finite
entries are left out, and so are vectors of another length than the commonest
(ties: the longest); entries beyond 2^62 on the grid count as 2^62; rows
without id and repeated rows are rows like any other; a component without
variance has eigenvalue 0 and null ``whitened`` (0 / 0) and is not counted in
``identity_error``; ``explained`` is null if there is no variance at all; a
deviation of over 38 digits is null; fewer dimensions than ``components`` give
as many components as dimensions; an empty table gives no rows.  Other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.common import map_arrow, staged

COMPONENTS = 8
GRID = 1024.0
LIMB_BITS = 20
LIMB = 10 ** 18
ROOT_BITS = 100             # relative width of a root's interval
SAME_BITS = 60              # roots closer than this, relative to the largest, share their null space
FIXED_BITS = 448            # fraction bits of the inverse iteration
ITERATIONS = 3


# -- exact sums -------------------------------------------------------------------------
def clean_vectors(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """((id, vec array<double>) of the rows to keep, their common length; 0 if there are none)."""
    usable = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).filter(
        (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    n, size = F.count(F.lit(1)).alias("n"), F.size("vec").alias("size")
    common = usable.groupBy(size).agg(n).orderBy(F.desc("n"), F.desc("size")).first()
    d = common["size"] if common else 0
    return usable.filter(F.size("vec") == d), d


def on_grid(vectors: pa.Array, d: int) -> np.ndarray:
    """(rows, d) int64 array of floor(1024 c)."""
    c = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.clip(np.floor(c * GRID), -2.0 ** 62, 2.0 ** 62).astype(np.int64)


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """x as float arrays of ``LIMB_BITS`` bits each, lowest first; the highest carries the sign."""
    out = []
    while True:
        if x.size == 0 or max(-int(x.min()), int(x.max())) < 1 << LIMB_BITS:
            return [*out, x.astype(np.float64)]
        out.append((x & ((1 << LIMB_BITS) - 1)).astype(np.float64))
        x = x >> LIMB_BITS


def exact_gram(x: np.ndarray) -> np.ndarray:
    """xT x as Python integers; every float product sum stays below 2^53 for up to 8,192 rows."""
    parts = limbs(x)
    out = np.zeros((x.shape[1], x.shape[1]), object)
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            out += (a.T @ b).astype(np.int64).astype(object) << LIMB_BITS * (i + j)
    return out


def exact_sums(vectors: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """(n, S, sum of x xT) over all rows, exact."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, gram = 0, np.zeros((d + 1, d + 1), object)
        for batch in batches:
            for i in range(0, batch.num_rows, 8_192):
                x = on_grid(batch.column("vec").slice(i, 8_192), d)
                gram += exact_gram(np.concatenate([np.ones((len(x), 1), np.int64), x], axis=1))
                n += len(x)
        if n:
            at = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
            v = [gram[i, j] for i, j in at]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in at], pa.int32()), pa.array([j for _, j in at], pa.int32()),
                 pa.array([Decimal(x // LIMB) for x in v], pa.decimal128(38)), pa.array([Decimal(x % LIMB) for x in v], pa.decimal128(38))],
                ["i", "j", "high", "low"])

    parts = map_arrow(vectors.select("vec"), run, "i int, j int, high decimal(38,0), low decimal(38,0)")
    rows = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()  # d squared at most
    full = np.zeros((d + 1, d + 1), object)
    for r in rows:
        full[r["i"], r["j"]] = full[r["j"], r["i"]] = int(r["high"]) * LIMB + int(r["low"])
    return full[0, 0], list(full[0, 1:]), full[1:, 1:]


# -- characteristic polynomial ------------------------------------------------------------
def is_prime(n: int) -> bool:
    """Miller-Rabin, exact below 3.2e9."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_above(bound: int) -> list[int]:
    """Primes below 2^31, largest first, whose product is above ``bound``."""
    out, product, p = [], 1, (1 << 31) - 1
    while product <= bound:
        if is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def hessenberg_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """A similar matrix modulo p with zeros below the first subdiagonal."""
    h = matrix.copy()
    for k in range(len(h) - 2):
        below = np.flatnonzero(h[k + 1:, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        u = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * u % p).sum(axis=1)) % p
    return h


def characteristic_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x I - matrix) modulo p, lowest degree first."""
    h, d = hessenberg_mod(matrix, p), len(matrix)
    minors = np.zeros((d + 1, d + 1), np.int64)         # of the leading k rows and columns
    minors[0, 0] = 1
    for k in range(1, d + 1):
        row = np.zeros(d + 1, np.int64)
        row[1:] = minors[k - 1, :-1]
        weights, product = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):                  # h[i, k-1] times the subdiagonal entries between
            weights[i] = int(h[i, k - 1]) * product % p
            if i:
                product = product * int(h[i, i - 1]) % p
        minors[k] = (row - (weights[:, None] * minors[:k] % p).sum(axis=0)) % p
    return minors[d]


def remainders_to_integer(pairs: list[tuple[int, int]]) -> int:
    """The integer below the product of the primes with the given (prime, remainder)."""
    value, product = 0, 1
    for p, r in sorted(pairs):
        value += product * ((r - value) * pow(product, -1, p) % p)
        product *= p
    return value


def minor_sums(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """e_0 .. e_d: det(x I - M) = sum of (-1)^k e_k x^(d - k), for a positive semidefinite integer M."""
    bound = math.prod(1 + int(v) for v in np.diagonal(matrix))
    primes, d = primes_above(bound), len(matrix)
    shared = spark.sparkContext.broadcast([[int(v) for v in row] for row in matrix])     # d squared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column("prime").to_pylist():
                c = characteristic_mod(np.array([[v % p for v in row] for row in shared.value], np.int64), p)
                k = np.arange(d + 1)
                e = np.where(k % 2 == 0, c[::-1], (p - c[::-1]) % p)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(np.full(d + 1, p)), pa.array(e)],
                                                 ["k", "prime", "remainder"])

    def join(group: pa.Table) -> pa.Table:
        value = remainders_to_integer(list(zip(group.column("prime").to_pylist(), group.column("remainder").to_pylist(), strict=True)))
        return pa.table({"k": group.column("k")[:1], "value": pa.array([hex(value)])})

    slices = max(1, min(len(primes), spark.sparkContext.defaultParallelism))
    table = spark.createDataFrame([(p,) for p in primes], "prime long").repartition(slices)
    parts = map_arrow(table, run, "k int, prime long, remainder long")
    rows = parts.groupBy("k").applyInArrow(join, "k int, value string").collect()         # d + 1
    return [int(v, 16) for _, v in sorted((r["k"], r["value"]) for r in rows)]


# -- roots ----------------------------------------------------------------------------------
def roots_above(sums: list[int], a: int, scale: int) -> int:
    """How many roots lie above a / 2^scale: the sign changes of the coefficients shifted there."""
    d = len(sums) - 1
    c = [(-e if k % 2 else e) << scale * k for k, e in enumerate(sums)]                   # highest degree first
    for i in range(d, 0, -1):
        for m in range(1, i + 1):
            c[m] += a * c[m - 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def value_sign(sums: list[int], a: int, scale: int) -> int:
    """Sign of the polynomial at a / 2^scale."""
    value = 0
    for k, e in enumerate(sums):
        value = value * a + ((-e if k % 2 else e) << scale * k)
    return (value > 0) - (value < 0)


def isolate_root(sums: list[int], j: int, bits: int = ROOT_BITS) -> tuple[int, int, int]:
    """(lo, hi, scale): the j-th largest root, with multiplicity, is in (lo, hi] / 2^scale; (0, 0, 0) if it is 0."""
    lo, hi, scale = 0, sums[1], 0                       # the trace bounds all roots
    above_lo, above_hi = roots_above(sums, 0, 0), 0
    if above_lo < j:
        return 0, 0, 0
    while not lo or hi - lo << bits > lo:
        if hi - lo < 2:
            lo, hi, scale = lo << 32, hi << 32, scale + 32
        mid = (lo + hi) // 2
        if above_lo - above_hi == 1:                    # one simple root: its side by the sign alone
            if value_sign(sums, mid, scale) == (1 if j % 2 else -1) or not value_sign(sums, mid, scale):
                hi = mid
            else:
                lo = mid
            continue
        n = roots_above(sums, mid, scale)
        if n >= j:
            lo, above_lo = mid, n
        else:
            hi, above_hi = mid, n
    return lo, hi, scale


# -- null spaces -----------------------------------------------------------------------------
def solve_fixed(matrix: np.ndarray, right: np.ndarray) -> np.ndarray:
    """X with matrix X = right in fixed point, partial pivoting; a vanished pivot counts as one unit."""
    a = np.concatenate([matrix, right], axis=1)
    d = len(matrix)
    for k in range(d):
        pivot = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        a[[k, pivot]] = a[[pivot, k]]
        a[k, k] = a[k, k] or 1
        if k + 1 < d:
            u = (a[k + 1:, k] << FIXED_BITS) // a[k, k]
            a[k + 1:, k:] -= (u[:, None] * a[k, k:]) >> FIXED_BITS
    x = np.zeros((d, a.shape[1] - d), object)
    for k in range(d - 1, -1, -1):
        rest = a[k, d:] - ((a[k, k + 1:d, None] * x[k + 1:]).sum(axis=0) >> FIXED_BITS if k + 1 < d else 0)
        x[k] = (rest << FIXED_BITS) // a[k, k]
    return x


def orthonormal(x: np.ndarray) -> np.ndarray:
    """Columns made orthonormal in fixed point (Gram-Schmidt, twice)."""
    out: list[np.ndarray] = []
    for column in x.T:
        v = column
        for _ in range(2):
            bits = max(int(abs(e)).bit_length() for e in v)
            v = np.array([int(e) << FIXED_BITS - bits if bits <= FIXED_BITS else int(e) >> bits - FIXED_BITS for e in v], object)
            for q in out:
                v = v - (((q * v).sum() >> FIXED_BITS) * q >> FIXED_BITS)
        norm = math.isqrt(int((v * v).sum())) or 1
        out.append((v << FIXED_BITS) // norm)
    return np.array(out, object).T


def null_space(matrix: list[list[int]], trace: int, root: Fraction, size: int) -> np.ndarray:
    """(size, d) orthonormal eigenvectors of the integer matrix at ``root``, as doubles."""
    d, one = len(matrix), 1 << FIXED_BITS
    a = np.array([[(v << FIXED_BITS) // trace for v in row] for row in matrix], object)
    shift = (root.numerator << FIXED_BITS) // (root.denominator * trace)
    for i in range(d):
        a[i, i] -= shift
    rng = np.random.default_rng(12)
    x = np.array([[int(v) * one >> 20 for v in row] for row in rng.integers(-(1 << 20), 1 << 20, (d, size))], object)
    x = orthonormal(x)
    for _ in range(ITERATIONS):
        x = orthonormal(solve_fixed(a, x))
    v = np.array([[float(Fraction(int(e), one)) for e in column] for column in x.T])
    return v * np.where(np.take_along_axis(v, np.abs(v).argmax(axis=1)[:, None], 1) < 0, -1.0, 1.0)


def principal_components(spark: SparkSession, scatter: np.ndarray, wanted: int) -> tuple[list[Fraction], np.ndarray]:
    """(largest eigenvalues, falling; unit eigenvectors, a row each) of a positive semidefinite integer matrix."""
    d, trace = len(scatter), int(np.trace(scatter))
    wanted = min(wanted, d)
    if not trace:
        return [Fraction(0)] * wanted, np.eye(d)[:wanted]
    sums = minor_sums(spark, scatter)
    shared = spark.sparkContext.broadcast((sums, [[int(v) for v in row] for row in scatter]))    # d + d squared integers

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in batch.column("j").to_pylist():
                lo, hi, scale = isolate_root(shared.value[0], j)
                yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([hex(lo + hi)]), pa.array([scale + 1], pa.int32())],
                                                 ["j", "middle", "scale"])

    numbers = spark.createDataFrame([(j,) for j in range(1, wanted + 1)], "j int").repartition(wanted, "j")
    found = {r["j"]: Fraction(int(r["middle"], 16), 1 << r["scale"])
             for r in map_arrow(numbers, roots, "j int, middle string, scale int").collect()}
    values = [found[j] for j in range(1, wanted + 1)]
    spaces: list[list[int]] = []
    for j, v in enumerate(values):
        if j and (values[j - 1] - v) * (1 << SAME_BITS) < values[0]:
            spaces[-1].append(j)
        else:
            spaces.append([j])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, size in zip(batch.column("first").to_pylist(), batch.column("size").to_pylist(), strict=True):
                v = null_space(shared.value[1], trace, values[first], size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(first, first + size), pa.int32()), pa.array(v.tolist(), pa.list_(pa.float64()))], ["j", "vector"])

    table = spark.createDataFrame([(s[0], len(s)) for s in spaces], "first int, size int").repartition(len(spaces), "first")
    rows = map_arrow(table, vectors, "j int, vector array<double>").collect()                     # ``wanted`` vectors
    by = {r["j"]: r["vector"] for r in rows}
    return values, np.array([by[j] for j in range(wanted)])


# -- whitening -------------------------------------------------------------------------------
def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Exact sum over the dimensions of (n x - S)^2 per row, as decimals."""
    largest = n * max(-int(x.min(initial=0)), int(x.max(initial=0))) + max(abs(s) for s in sums)
    if largest ** 2 * len(sums) < 1 << 63:
        t = n * x - np.array(sums, np.int64)
        return pa.array((t * t).sum(axis=1)).cast(pa.decimal128(38))
    t = n * x.astype(object) - np.array(sums, object)
    return pa.array([Decimal(v) if v < 10 ** 38 else None for v in (t * t).sum(axis=1)], pa.decimal128(38))


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation decimal, whitened, eigenvalue, explained, identity_error) per row and component.

    ``identity_error`` is measured on the whitened rows: the largest absolute
    entry of their covariance (centred, divisor n) minus the identity.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    vectors, d = clean_vectors(df, id_col, vec_col)
    if not d:
        return spark.createDataFrame([], f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, "
                                         "eigenvalue double, explained double, identity_error double")
    n, sums, gram = exact_sums(vectors, d)
    scatter = n * gram - np.outer(np.array(sums, object), np.array(sums, object))
    values, axes = principal_components(spark, scatter, components)
    trace = int(np.trace(scatter))
    eigenvalues = [float(v / n ** 2) for v in values]
    explained = [float(v / trace) if trace else None for v in values]
    means = np.array([float(Fraction(s, n)) for s in sums])
    held = [k for k, e in enumerate(eigenvalues) if e > 0]
    scaled = np.array([axes[k] / math.sqrt(eigenvalues[k]) for k in held]).reshape(len(held), d)
    k_all = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = on_grid(batch.column("vec"), d)
            out = np.full((len(x), k_all), np.nan)
            out[:, held] = (x - means) @ scaled.T
            flat = pa.array(out.ravel(), from_pandas=True)                              # NaN: null
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k_all), flat)
            yield pa.RecordBatch.from_arrays([batch.column("id"), deviations(x, n, sums), lists], ["id", "deviation", "w"])

    rows = staged(map_arrow(vectors, run, f"id {kind}, deviation decimal(38,0), w array<double>"), "whitened")
    w = [F.element_at("w", k + 1) for k in held]
    error = None
    if held:
        centre = rows.agg(*[F.avg(c).alias(f"m{k}") for k, c in zip(held, w, strict=True)]).first()
        c = [x - F.lit(m) for x, m in zip(w, centre, strict=True)]
        entries = [(i, j) for i in range(len(held)) for j in range(i, len(held))]
        measured = rows.agg(*[F.avg(c[i] * c[j]).alias(f"c{i}_{j}") for i, j in entries]).first()
        error = max(abs(v - (i == j)) for (i, j), v in zip(entries, measured, strict=True))
    each = rows.select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    pick = lambda v: F.element_at(F.array(*[F.lit(x).cast("double") for x in v]), F.col("at") + 1)
    return each.select("id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                       pick(eigenvalues).alias("eigenvalue"), pick(explained).alias("explained"),
                       F.lit(error).cast("double").alias("identity_error"))
