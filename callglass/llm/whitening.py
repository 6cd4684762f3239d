"""Embedding whitening by the exact characteristic polynomial of the scatter.

Entries become whole numbers, x = floor(64 c) + 1000000. The fit list holds each distinct
vector once. Tasks add up its sums and products exactly; n times the products less the
products of the sums is n^2 times the covariance, a matrix of whole numbers. Its characteristic
polynomial is found modulo one prime per row of a Spark job and remaindered; the leading roots
are isolated (``spectra``), and one task per root finds its vectors. Then every vector is
projected on the components, and the covariance of the projections of the fit list is compared
with the identity.

What comes to the driver depends on the vectors' length d alone: d^2 sums, and the residues of
d + 1 coefficients for about 2 d primes.

Defined results: rows whose vector is null or holds null or non-finite entries, or an entry of
size 2^46 or more (x must be exact), are left out. Vectors of different length are fitted apart; an empty
vector has no component. Components belong to eigenvalues above zero only, so there are fewer
than asked for if the fit list spans fewer dimensions, and none if it holds one vector.
Repeated rows give repeated results; a null ``vec_id`` is kept. A deviation beyond a long is
null. Only ``vec_id`` and ``embedding`` are read. Equal eigenvalues share a space, in which any
unit vectors at right angles serve.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callglass.llm import spectra
from callglass.llm.components import stored
from callglass.llm.words import mapped, small_batches

# Fixed values of the contract.
FACTOR, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Entries of this size times 64 are still told apart by a double.
LARGEST = 2.0**46
LONG = (1 << 63) - 1


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``size`` and ``y``, which is x less its offset, of the rows that count."""
    e = F.col("embedding")
    sound = F.size(e) > 0
    sound &= ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) >= LARGEST))
    y = F.transform(e, lambda v: F.floor(v.cast("double") * FACTOR))
    return vectors.select("vec_id", "embedding").where(e.isNotNull() & sound).select("vec_id", F.size(e).alias("size"), y.alias("y"))


def by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each length in the batch, the rows that have it, and their entries."""
    sizes, flat = batch.column("size").to_numpy(), batch.column("y")
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield size, rows, flat.take(pa.array(rows)).flatten().to_numpy().reshape(-1, size)


def products(y: np.ndarray) -> np.ndarray:
    """The exact products of all columns of (1, y), as whole numbers of any size."""
    one = np.concatenate([np.ones((len(y), 1), np.int64), y], 1)
    most = max(1, int(np.abs(one).max()))
    if len(one) * most * most < 1 << 53:
        f = one.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    if len(one) * most * most < 1 << 62:
        return (one.T @ one).astype(object)
    wide = one.astype(object)
    return wide.T @ wide


def exact_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for size, _, y in by_size(batch):
            sums[size] = sums.get(size, 0) + products(y)
    kind = pa.list_(pa.decimal128(38, 0))
    for size, s in sums.items():
        rows = [s[i, i:].tolist() for i in range(size + 1)]
        yield pa.RecordBatch.from_arrays([pa.array([size] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int32()), pa.array(rows, kind)], ["size", "row", "values"])


def scatters(fit: DataFrame) -> dict[int, tuple[int, list[int], list[list[int]]]]:
    """For each length the number of vectors, their sums, and n^2 times their covariance."""
    parts = mapped(fit, exact_sums, "size int, row int, values array<decimal(38,0)>")
    cells = parts.select("size", "row", F.posexplode("values").alias("at", "v")).groupBy("size", "row", "at").agg(F.sum("v").alias("v")).collect()
    square: dict[int, list[list[int]]] = {}
    for c in cells:
        m = square.setdefault(c["size"], [[0] * (c["size"] + 1) for _ in range(c["size"] + 1)])
        m[c["row"]][c["row"] + c["at"]] = m[c["row"] + c["at"]][c["row"]] = int(c["v"])
    out = {}
    for size, m in square.items():
        n, s = m[0][0], m[0][1:]
        out[size] = n, s, [[n * m[i + 1][j + 1] - s[i] * s[j] for j in range(size)] for i in range(size)]
    return out


def characteristic(fit: DataFrame, matrix: list[list[int]]) -> list[int]:
    """Coefficients of the characteristic polynomial, one prime per row of a job."""
    spark = fit.sparkSession
    primes = spectra.primes_for(matrix)
    shared = spark.sparkContext.broadcast(np.array(matrix, object))

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("p").to_pylist()
            found = [spectra.polynomial_modulo(shared.value, p).tolist() for p in own]
            yield pa.RecordBatch.from_arrays([batch.column("p"), pa.array(found, pa.list_(pa.int64()))], ["p", "c"])

    tasks = max(1, min(len(primes), spark.sparkContext.defaultParallelism))
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks)
    return spectra.remaindered({r["p"]: r["c"] for r in mapped(rows, residues, "p long, c array<long>").collect()})


def vectors_of(fit: DataFrame, matrix: list[list[int]], roots: list[spectra.Root]) -> list[list[list[float]]]:
    """The null vectors of each root, a root per task."""
    spark = fit.sparkSession
    shared = spark.sparkContext.broadcast(matrix)

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, at, scale, times in zip(*(batch.column(c).to_pylist() for c in ("k", "at", "scale", "times"))):
                found = spectra.null_vectors(shared.value, spectra.Root(int(at), scale, times))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([found], pa.list_(pa.list_(pa.float64())))], ["k", "v"])

    rows = spark.createDataFrame([(k, str(r.at), r.scale, r.times) for k, r in enumerate(roots)], "k int, at string, scale int, times int")
    found = mapped(rows.repartition(len(roots)), solved, "k int, v array<array<double>>").collect()
    return [r["v"] for r in sorted(found, key=lambda r: r["k"])]


@dataclass(frozen=True)
class Model:
    """What whitening needs: n, sums of y, components as columns, their eigenvalues and shares of the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray

    def scaled(self, y: np.ndarray) -> np.ndarray:
        """n y less the sums, exactly; whole numbers of any size if a long could not hold them."""
        most = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.sums))
        kind = np.int64 if most < 1 << 62 else object
        return y.astype(kind) * self.n - np.array(self.sums, kind)

    def deviations(self, scaled: np.ndarray) -> list[int | None] | np.ndarray:
        most = max((abs(int(v)) for v in (scaled.max(initial=0), scaled.min(initial=0))), default=0)
        if scaled.dtype == np.int64 and scaled.shape[1] * most * most <= LONG:
            return (scaled * scaled).sum(1)
        wide = scaled.astype(object)
        return [v if v <= LONG else None for v in (wide * wide).sum(1).tolist()]

    def whitened(self, scaled: np.ndarray) -> np.ndarray:
        centred = (scaled / self.n).astype(np.float64)
        return centred @ self.components / np.sqrt(self.eigenvalues)


def model_of(fit: DataFrame, n: int, sums: list[int], scatter: list[list[int]], wanted: int) -> Model:
    matrix, divisor = spectra.reduced(scatter)
    trace = sum(matrix[k][k] for k in range(len(matrix)))
    roots = spectra.Roots(characteristic(fit, matrix)).largest(wanted) if trace else []
    vectors = vectors_of(fit, matrix, roots) if roots else []
    columns, values, shares = [], [], []
    for root, own in zip(roots, vectors):
        for v in own:
            columns.append(v)
            values.append(root.at * divisor / ((1 << root.scale) * n * n))
            shares.append(root.at / ((1 << root.scale) * trace))
    take = slice(0, wanted)
    components = np.array(columns[take], np.float64).reshape(-1, len(matrix)).T
    return Model(n, sums, components, np.array(values[take]), np.array(shares[take]))


def projected_sums(batches: Iterator[pa.RecordBatch], models: dict[int, Model]) -> Iterator[pa.RecordBatch]:
    """Sums of products of (1, whitened), a row for each."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for size, _, y in by_size(batch):
            m = models[size]
            w = m.whitened(m.scaled(y))
            one = np.concatenate([np.ones((len(w), 1)), w], 1)
            sums[size] = sums.get(size, 0) + one.T @ one
    for size, s in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([size] * len(s), pa.int32()), pa.array(range(len(s)), pa.int32()), pa.array(list(s), pa.list_(pa.float64()))], ["size", "row", "values"])


def identity_errors(fit: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """Largest distance of an entry of the whitened fit list's covariance from the identity's."""
    shared = fit.sparkSession.sparkContext.broadcast(models)
    parts = mapped(fit, lambda b: projected_sums(b, shared.value), "size int, row int, values array<double>")
    cells = parts.select("size", "row", F.posexplode("values").alias("at", "v")).groupBy("size", "row", "at").agg(F.sum("v").alias("v")).collect()
    out = {}
    for size, m in models.items():
        k = m.components.shape[1]
        s = np.zeros((k + 1, k + 1))
        for c in cells:
            if c["size"] == size:
                s[c["row"], c["at"]] = c["v"]
        mean = s[0, 1:] / m.n
        out[size] = float(np.abs(s[1:, 1:] / m.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))
    return out


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def projected(batches: Iterator[pa.RecordBatch], models: dict[int, Model], errors: dict[int, float]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for size, rows, y in by_size(batch):
            m = models[size]
            k = m.components.shape[1]
            if not k:
                continue
            scaled = m.scaled(y)
            each = np.repeat(np.arange(len(rows)), k)
            total = len(each)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(rows[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(total, m.n)), pa.array(m.deviations(scaled), pa.int64()).take(pa.array(each)), pa.array(m.whitened(scaled).ravel()),
                    pa.array(np.tile(m.explained, len(rows))), pa.array(np.full(total, errors[size])),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )


def fitted(vectors: DataFrame, wanted: int = COMPONENTS) -> tuple[dict[int, Model], dict[int, float]]:
    """Models by length of vector, and how far their whitened covariances are from the identity."""
    small_batches(vectors.sparkSession)
    fit = stored(whole_vectors(vectors).select("size", "y").distinct(), "fit")
    models = {size: model_of(fit, *parts, wanted) for size, parts in scatters(fit).items()}
    return models, identity_errors(fit, models) if models else {}


def whitened(vectors: DataFrame, wanted: int = COMPONENTS) -> DataFrame:
    """Every vector that counts, projected on the components of its fit list."""
    models, errors = fitted(vectors, wanted)
    shared = vectors.sparkSession.sparkContext.broadcast((models, errors))
    rows = whole_vectors(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), "size", "y")
    return mapped(rows, lambda b: projected(b, *shared.value), RESULT)
