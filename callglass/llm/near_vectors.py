"""Near-duplicate vectors by PCA-ordered tiled comparison.

Equal vectors of a label are one class. Unit vectors are turned so that the directions with
most of their energy come first. Vectors are put into cells by their first two coordinates,
as wide as two vectors over the threshold can differ, and cells into tiles of bounded size.
Tiles of the same or neighbouring cells meet. In a pair of tiles the leading coordinates
are multiplied first; what the rest can add is bounded by the product of suffix norms, and
pairs that cannot reach the threshold are left. What stays is computed on the given values
in double precision.

A pair of tiles reports counts per class and only those links that connect. Its size is
bounded; cells with very many vectors have many tiles.

Defined results: vectors that are null, empty, zero or hold null or non-finite values, and
those without label, link with nothing. Vectors of different length never link. Rows that
share a ``vec_id`` are separate vectors for counts and one for components; a null
``vec_id`` links with nothing. Only ``vec_id``, ``embedding`` and ``label`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callglass.llm.components import connected, stored
from callglass.llm.words import mapped, small_batches, whole_groups

#: Classes in a tile, coordinates multiplied in one step, and what rounding may change in a bound.
TILE, LEADING, SLACK = 2_048, 12, 1e-9
PAIR = ["label", "size", "x", "y", "t", "x2", "y2", "t2"]


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def units(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1, safe from overflow and underflow."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Table]]:
    table = pa.Table.from_batches([batch])
    sizes = batch.column("size").to_numpy()
    for size in np.unique(sizes).tolist():
        yield size, table.filter(pa.array(sizes == size))


def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of coordinates of unit vectors, a row for each coordinate and vector length."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for size, own in by_size(batch):
            u = units(matrix(own.column("embedding").combine_chunks(), size))
            sums[size] = sums.get(size, 0) + u.T @ u
    for size, s in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([size] * size), pa.array(range(size)), pa.array(list(s))], ["size", "row", "values"])


def directions(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length the directions of most energy, the largest first."""
    parts = mapped(classes.select("size", "embedding"), moments, "size long, row long, values array<double>")
    cells = parts.select("size", "row", F.posexplode("values").alias("at", "v")).groupBy("size", "row", "at").agg(F.sum("v").alias("v")).collect()
    sums = {size: np.zeros((size, size)) for size in {c["size"] for c in cells}}
    for c in cells:
        sums[c["size"]][c["row"], c["at"]] = c["v"]
    return {size: np.linalg.eigh(s)[1][:, ::-1] for size, s in sums.items()}


def cells(batches: Iterator[pa.RecordBatch], turn: dict[int, np.ndarray], width: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32)
        sizes = batch.column("size").to_numpy()
        for size, own in by_size(batch):
            at = np.floor(units(matrix(own.column("embedding").combine_chunks(), size)) @ turn[size][:, :2] / width).astype(np.int32)
            x[sizes == size], y[sizes == size] = at[:, 0], at[:, -1] if size > 1 else 0
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x), pa.array(y)], [*batch.schema.names, "x", "y"])


def near(a: np.ndarray, b: np.ndarray, turn: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs from ``a`` and ``b`` with cosine at least ``least``."""
    ua, ub = units(a), units(b)
    ta, tb = ua @ turn, ub @ turn
    k = min(LEADING, ta.shape[1])
    rest_a, rest_b = (np.sqrt(np.maximum((t[:, ::-1] ** 2).cumsum(1)[:, ::-1], 0)) for t in (ta, tb))
    suffix = lambda r, i, n: r[i, n] if n < r.shape[1] else 0.0
    first = ta[:, :k] @ tb[:, :k].T
    bound = first + (np.outer(rest_a[:, k], rest_b[:, k]) if k < ta.shape[1] else 0)
    i, j = np.nonzero(bound >= least - SLACK)
    done = first[i, j]
    while k < ta.shape[1] and len(i):
        more = min(k + LEADING, ta.shape[1])
        done = done + np.einsum("ij,ij->i", ta[i, k:more], tb[j, k:more])
        keep = done + suffix(rest_a, i, more) * suffix(rest_b, j, more) >= least - SLACK
        i, j, done, k = i[keep], j[keep], done[keep], more
    exact = np.einsum("ij,ij->i", ua[i], ub[j]) >= least
    return i[exact], j[exact]


def links_of(tile: pa.Table, turn: dict[int, np.ndarray], least: float) -> Iterator[tuple[int, int | None, int]]:
    """(class, class, 0) for links that connect, (class, None, n) for its other vectors linked."""
    size = tile.column("size")[0].as_py()
    rep, copies, side = (tile.column(c).to_numpy() for c in ("rep", "copies", "side"))
    all_rows = matrix(tile.column("embedding").combine_chunks(), size)
    own = bool((side == 2).any())
    left = np.flatnonzero(side == 2) if own else np.flatnonzero(side == 0)
    right = left if own else np.flatnonzero(side == 1)
    count = np.zeros(len(rep), np.int64)
    up = {r: r for r in rep.tolist()}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for low in range(0, len(left), 512):
        part = left[low : low + 512]
        i, j = near(all_rows[part], all_rows[right], turn[size], least)
        i, j = part[i], right[j]
        if own:
            i, j = i[rep[i] != rep[j]], j[rep[i] != rep[j]]
            np.add.at(count, i, copies[j])
        else:
            np.add.at(count, i, copies[j])
            np.add.at(count, j, copies[i])
        for a, b in zip(rep[i].tolist(), rep[j].tolist()):
            x, y = top(a), top(b)
            if x != y:
                up[max(x, y)] = min(x, y)
                yield a, b, 0
    for k in np.flatnonzero(count).tolist():
        yield int(rep[k]), None, int(count[k])


def compared(batches: Iterator[pa.RecordBatch], turn: dict[int, np.ndarray], least: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by pair of tiles."""
    for block in whole_groups(numbered(batches), "pair", 1):
        keys = block.column("pair").to_numpy()
        for pair in np.unique(keys).tolist():
            rows = list(links_of(block.filter(pa.array(keys == pair)), turn, least))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["a", "b", "n"])


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``pair``, which counts the changes of the pair's columns."""
    last, number = None, 0
    for batch in batches:
        numbers = []
        for key in zip(*(batch.column(c).to_pylist() for c in PAIR)):
            number += key != last
            last = key
            numbers.append(number)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], [*batch.schema.names, "pair"])


def near_duplicates(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every vector."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("size"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.col("size") > 0) & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    sound &= F.exists("embedding", lambda v: v != 0)
    good = rows.where(sound)
    classes = good.groupBy("label", "size", "embedding").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")  # ids may be shared, numbers are not
    turn = spark.sparkContext.broadcast(directions(classes))
    width = float(np.sqrt(max(0.0, 2 - 2 * least))) * (1 + 1e-6) + 1e-6
    placed = mapped(classes.select("label", "size", "embedding", "rep", "copies"), lambda b: cells(b, turn.value, width), "label int, size int, embedding array<double>, rep long, copies long, x int, y int")
    count = placed.groupBy("label", "size", "x", "y").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles"))
    tiles = count.select("label", "size", "x", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("t"))
    step = F.array(*map(F.lit, (-1, 0, 1)))
    around = tiles.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step)).withColumns({"x2": F.col("x") + F.col("dx"), "y2": F.col("y") + F.col("dy")})
    pairs = around.join(tiles.withColumnsRenamed({"x": "x2", "y": "y2", "t": "t2"}), ["label", "size", "x2", "y2"]).where("struct(x, y, t) <= struct(x2, y2, t2)").select(*PAIR)
    left = pairs.select(*PAIR, F.struct("x", "y", "t").alias("at"), F.when(F.expr("struct(x, y, t) = struct(x2, y2, t2)"), 2).otherwise(0).alias("side"))
    right = pairs.where("struct(x, y, t) < struct(x2, y2, t2)").select(*PAIR, F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"), F.col("t2").alias("t")).alias("at"), F.lit(1).alias("side"))
    own = placed.join(count, ["label", "size", "x", "y"]).withColumn("t", F.pmod(F.xxhash64("rep"), F.col("tiles")))
    own = own.select("label", "size", "embedding", "rep", "copies", F.struct("x", "y", "t").alias("at"))
    visits = own.join(left.union(right), ["label", "size", "at"]).select(*PAIR, "side", "rep", "copies", "embedding")
    visits = visits.repartition(*PAIR).sortWithinPartitions(*PAIR)
    found = stored(mapped(visits, lambda b: compared(b, turn.value, least), "a long, b long, n long"), "links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "rep")
    whole = connected(found.where("b is not null").select("a", "b").union(ids_in_several_classes(good, classes)))
    whole = stored(whole.withColumnRenamed("node", "rep").join(classes.select("rep", "least_id"), "rep"), "components")
    whole = whole.join(whole.groupBy("component").agg(F.min("least_id").alias("first_id")), "component").select("rep", "first_id")
    labels = classes.join(counts, "rep", "left").join(whole, "rep", "left")
    labels = labels.select("label", "embedding", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("first_id", "least_id").alias("component_id"))
    linked = good.join(labels, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(sound, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def ids_in_several_classes(good: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of one ``vec_id`` with different vectors link their classes, each with the id's least."""
    several = good.groupBy("vec_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    own = good.join(several, "vec_id").join(classes, ["label", "size", "embedding"]).select("vec_id", "rep").distinct()
    least = own.groupBy("vec_id").agg(F.min("rep").alias("a"))
    return own.join(least, "vec_id").where("a <> rep").select("a", F.col("rep").alias("b"))


#: The same in SQL: cosine of all pairs of a label, then what each vector reaches.
SQL = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and not list_bool_or(list_transform(embedding, lambda x: x is null or isnan(x) or isinf(x)))
    and list_bool_or(list_transform(embedding, lambda x: x <> 0))
), links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) as (
  select vec_id, vec_id from embeddings union select r.a, l.b from reach r join links l on r.b = l.a
), component as (select a as vec_id, min(b) as component_id from reach group by a)
select c.vec_id, (select count(*) from links l where l.a = c.vec_id) as n_links, c.component_id, c.vec_id = c.component_id as kept
from component c
"""
