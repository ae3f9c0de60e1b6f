"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, written
from .components import components, of_class

COSINE = 0.9
#: Vectors that the cells are fitted on at most, and rounds of k-means.
SAMPLE, ROUNDS = 32_768, 8
#: A centre for so many vectors, and at most so many centres at once.
PER_CELL, MAX_CELLS = 4096, 4096
#: Cells of more residents are divided again, by centres fitted on about so many of them, and so on
#: for at most so many levels.
LARGE, SAMPLE_CELL, LEVELS = 1 << 17, 8192, 3
#: Vectors in a block; larger cells are compared block against block, so many rows at a time.
BLOCK, TILE = 8192, 512


def normalised(column: pa.Array) -> list[bytes | None]:
    """The unit vectors of a list column in double precision, as bytes; None for null, empty, zero
    and non-finite vectors and those that hold a null."""
    out: list[bytes | None] = [None] * len(column)
    values = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null is a NaN
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == size)
        x = values[start[at][:, None] + np.arange(size)]
        top = np.abs(x).max(axis=1)
        ok = np.isfinite(top) & (top > 0)
        x = x[ok] / top[ok, None]
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
        for i, v in zip(at[ok].tolist(), x, strict=True):
            out[i] = v.tobytes()
    return out


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """``k`` unit centres (fewer if there are fewer vectors) of unit vectors ``x``."""
    rng = np.random.Generator(np.random.PCG64(seed))
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = np.concatenate([np.argmax(x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)])
        order = np.argsort(own, kind="stable")
        used, first = np.unique(own[order], return_index=True)
        c[used] = np.add.reduceat(x[order], first, axis=0)
        size = np.sqrt((c * c).sum(axis=1, keepdims=True))
        c = np.where(size > 1e-12, c / np.maximum(size, 1e-12), x[rng.integers(0, len(x), len(c))])
    return c


def _compare(table: pa.Table, threshold: float) -> pa.Table:
    """Links inside one block or between two blocks of a cell."""
    keys = table.column("key").to_pylist()
    x = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float64).reshape(len(keys), -1)
    weight, block = table.column("n").to_numpy(), table.column("block").to_numpy()
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    first, second = np.flatnonzero(block == low), np.flatnonzero(block == high)
    label, links = np.arange(len(keys)), np.zeros(len(keys), np.int64)
    for i in range(0, len(first), TILE):
        p, q = first[i : i + TILE], first[i:] if low == high else second
        linked = x[p] @ x[q].T >= threshold
        if low == high:  # each pair once
            linked = np.triu(linked, 1)
        some, others = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
        if not len(some):
            continue
        linked, p, q = linked[np.ix_(some, others)], p[some], q[others]
        one = linked.astype(np.float64)
        links[p] += (one @ weight[q]).astype(np.int64)
        links[q] += (weight[p] @ one).astype(np.int64)
        least, most = np.where(linked, label[q], len(keys)).min(axis=1), np.where(linked, label[q], -1).max(axis=1)
        for r in np.flatnonzero((least != label[p]) | (most != label[p])):
            group = np.unique(np.append(label[q[linked[r]]], label[p[r]]))
            if len(group) > 1:
                label[np.isin(label, group)] = group[0]
    some = np.flatnonzero(links)
    return pa.table({"key": pa.array([keys[i] for i in some], pa.binary()), "centre": pa.array([keys[label[i]] for i in some], pa.binary()), "links": pa.array(links[some], pa.int64())})


def placed(x: np.ndarray, c: np.ndarray, threshold: float, visitor: bool = False) -> tuple[np.ndarray, list[list[int]]]:
    """For unit vectors ``x`` and centres ``c`` each vector's cell and the cells that it visits.

    A vector's centre is its nearest one; cell 2i has the vectors within the angle A of the
    threshold from centre i, cell 2i + 1 the others. A vector visits every later cell that can
    hold a partner; a ``visitor``, which has no cell of its own here, every cell that can. Two
    bounds rule cells out: the plane halfway between two centres is not crossed within the angle A
    of a vector that is further from it than sin(A), and a vector more than 2A from a centre has
    no partner within A of it. Both are exact (with a margin for rounding), so every pair of
    partners meets, and in one cell only.
    """
    angle = math.acos(max(-1.0, min(1.0, threshold)))
    square = (c * c).sum(axis=1)
    cells, visits = np.empty(len(x), np.int64), []
    for i in range(0, len(x), 1024):
        near = x[i : i + 1024] @ c.T
        own = np.argmax(near, axis=1)
        best = near[np.arange(len(near)), own]
        inner = np.arccos(np.clip(best, -1, 1)) <= angle
        cells[i : i + 1024] = 2 * own + ~inner
        later = np.ones(near.shape, bool) if visitor else np.arange(len(c)) > own[:, None]
        if threshold > 0:  # without a positive cosine the first bound does not hold
            used, at = np.unique(own, return_inverse=True)
            apart = math.sin(angle) * np.sqrt(np.maximum(0, square[used, None] + square - 2 * c[used] @ c.T))
            outside = later & (best[:, None] - near <= apart[at] + 1e-6)
        else:
            outside = later
        inside = later & outside & (np.arccos(np.clip(near, -1, 1)) <= 2 * angle + 1e-6)
        if not visitor:
            outside[np.flatnonzero(inner), own[inner]] = True
        visits += [np.flatnonzero(v).tolist() for v in np.stack([inside, outside], axis=2).reshape(len(near), -1)]
    return cells, visits


def _divided(spread: DataFrame, threshold: float) -> DataFrame:
    """``spread`` (cell, key, n, vector, visitor) with its large cells divided: centres are fitted on
    a sample of each, residents go to cells of their own there, and they and visitors visit every
    cell that can hold a partner. Pairs of partners still meet in one cell only."""
    sizes = spread.where(~F.col("visitor")).groupBy("cell").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > LARGE)
    large = written(sizes)
    if large.isEmpty():
        return spread
    per_cell, at_most = PER_CELL, MAX_CELLS // 16
    sample = spread.where(~F.col("visitor")).join(large, "cell").where(F.pmod(F.xxhash64(F.lit(5), "key"), F.ceil(F.col("size") / SAMPLE_CELL).cast("long")) == 0)

    def fit(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        vectors = sorted(table.column("vector").to_pylist())
        x = np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)
        k = max(2, min(at_most, table.column("size")[0].as_py() // per_cell, len(x)))
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int64()), "centres": pa.array([spherical_kmeans(x, k).tobytes()], pa.binary())})

    centres = written(sample.select("cell", "size", "vector").groupBy("cell").applyInArrow(fit, "cell long, centres binary"))

    def place(batches):
        for b in batches:
            cell, visitor = b.column("cell").to_numpy(), b.column("visitor").to_numpy(zero_copy_only=False)
            vectors, of = b.column("vector").to_pylist(), b.column("centres").to_pylist()
            rows: list[int] = []
            into: list[int] = []
            visiting: list[bool] = []
            for name in np.unique(cell).tolist():
                for kind in (False, True):
                    at = np.flatnonzero((cell == name) & (visitor == kind))
                    if not len(at):
                        continue
                    x = np.frombuffer(b"".join([vectors[i] for i in at]), np.float64).reshape(len(at), -1)
                    own, visits = placed(x, np.frombuffer(of[at[0]], np.float64).reshape(-1, x.shape[1]), threshold, kind)
                    for i, o, others in zip(at.tolist(), own.tolist(), visits, strict=True):
                        mine = others if kind else [o, *others]
                        rows += [i] * len(mine)
                        into += mine
                        visiting += [True] * len(mine) if kind else [False, *[True] * len(others)]
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("cell", "key", "n", "vector")), pa.array(visiting, pa.bool_()), pa.array(into, pa.int32())], ["cell", "key", "n", "vector", "visitor", "child"])

    met = spread.join(centres, "cell").select("cell", "key", "n", "vector", "visitor", "centres")
    below = met.mapInArrow(place, "cell long, key binary, n long, vector binary, visitor boolean, child int")
    below = below.select(F.xxhash64("cell", "child").alias("cell"), "key", "n", "vector", "visitor")
    return written(spread.join(centres.select("cell"), "cell", "left_anti").unionAll(below))


_COMPARED = pa.schema([("key", pa.binary()), ("centre", pa.binary()), ("links", pa.int64())])


def link(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every vector.

    Vectors are linked if their cosine, in double precision, is ``threshold`` or more. Equal unit
    vectors are one node, so copies are not expanded into pairs. Cells are fitted on a sample of at
    most SAMPLE vectors, and large cells are divided again, so that cells grow in number with the
    table; every vector visits all cells that can hold a partner, so every pair is found, whatever
    the sample. Null, empty, zero and non-finite vectors link with nothing and are
    kept; vectors of different lengths do not link, and those of a length that the sample lacks
    share one cell. Vectors of any length are taken whole. Ids may be null and repeat; a component
    is named by its smallest id (of equal smallest ids every row is kept); an empty table gives an
    empty result. Other columns, whatever their names, are ignored.
    """
    kind = df.schema[vec_id].dataType.simpleString()

    def unit(batches):
        for b in batches:
            raw = normalised(b.column("embedding"))
            keys = [None if r is None else hashlib.md5(r).digest() for r in raw]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "key", "vector"])

    rows = written(only(df, vec_id=vec_id, embedding=embedding).mapInArrow(unit, f"vec_id {kind}, key binary, vector binary"))
    nodes = written(rows.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("rep"), F.first("vector").alias("vector")))
    total = nodes.count()
    sample: dict[int, list[bytes]] = {}
    for (v,) in nodes.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("vector").collect():
        sample.setdefault(len(v), []).append(v)
    n_cells = min(MAX_CELLS, max(1, total // PER_CELL))
    centres, first_cell = {}, 0
    for size, vs in sorted(sample.items()):
        c = spherical_kmeans(np.frombuffer(b"".join(vs), np.float64).reshape(len(vs), -1), max(1, n_cells * len(vs) // sum(map(len, sample.values()))))
        centres[size] = (first_cell, c)
        first_cell += len(c)

    def assign(batches):
        for b in batches:
            raw = b.column("vector").to_pylist()
            cells: list = [None] * len(raw)
            visits: list = [[]] * len(raw)
            for size in {len(r) for r in raw}:
                at = [i for i, r in enumerate(raw) if len(r) == size]
                if size not in centres:  # no vector of this length is in the sample
                    for i in at:
                        cells[i] = -size
                    continue
                base, c = centres[size]
                own, more = placed(np.frombuffer(b"".join([raw[i] for i in at]), np.float64).reshape(len(at), -1), c, threshold)
                for i, x, others in zip(at, own.tolist(), more, strict=True):
                    cells[i], visits[i] = 2 * base + x, [2 * base + k for k in others]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n"), b.column("vector"), pa.array(cells, pa.int32()), pa.array(visits, pa.list_(pa.int32()))], ["key", "n", "vector", "cell", "visits"])

    in_cells = written(nodes.select("key", "n", "vector").mapInArrow(assign, "key binary, n long, vector binary, cell int, visits array<int>"))
    residents = in_cells.select(F.col("cell").cast("long"), "key", "n", "vector", F.lit(False).alias("visitor"))
    spread = residents.unionAll(in_cells.select(F.explode(F.col("visits").cast("array<long>")).alias("cell"), "key", "n", "vector", F.lit(True).alias("visitor")))
    if total > LARGE:
        for _ in range(LEVELS):
            before, spread = spread, _divided(spread, threshold)
            if spread is before:
                break
    blocks = lambda visitor: F.ceil(F.count_if(F.col("visitor") == visitor) / BLOCK).cast("int")
    sizes = spread.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), blocks(False).alias("own"), blocks(True).alias("visiting")).where("size > 1 and own > 0").drop("size")
    # residents' blocks are numbered before visitors'; two visitors are not compared
    block = F.when(F.col("visitor"), F.col("own") + F.pmod(F.xxhash64("key"), "visiting")).otherwise(F.pmod(F.xxhash64("key"), "own")).cast("int")
    met = F.when(F.col("visitor"), F.col("own")).otherwise(F.col("own") + F.col("visiting"))
    member = spread.join(sizes, "cell").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), met - 1)))
    member = member.select("cell", "key", "n", "vector", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _compare(table, threshold) if table.num_rows > 1 else _COMPARED.empty_table()

    links = written(member.groupBy("cell", "low", "high").applyInArrow(compare, "key binary, centre binary, links long"))
    group = components(links.select(F.col("key").alias("a"), F.col("centre").alias("b")))
    counts = links.groupBy("key").agg(F.sum("links").alias("links"))
    first = group.join(nodes.select(F.col("key").alias("node"), "rep"), "node").groupBy("component").agg(F.min("rep").alias("first"))
    linked = group.join(first, "component").select(F.col("node").alias("key"), "first")
    per_key = nodes.select("key", "n", "rep").join(counts, "key", "left").join(linked, "key", "left")
    per_key = per_key.where("n > 1 or links is not null")  # the others are components of one row
    per_key = per_key.select("key", "n", F.coalesce("first", "rep").alias("first"), F.coalesce("links", F.lit(0)).alias("links"))
    own = of_class(rows.select("vec_id", "key"), written(per_key), rows.count())
    own = own.select("vec_id", F.when(F.col("n").isNull(), F.col("vec_id")).otherwise(F.col("first")).alias("first"), F.coalesce(F.col("links") + F.col("n") - 1, F.lit(0)).alias("links"))
    out = own.unionAll(rows.where("key is null").select("vec_id", "vec_id", F.lit(0)))
    return out.select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("first").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("first")).alias("kept"))


def op8(spark, sf_dir: str) -> DataFrame:
    """Every vector with its links and component."""
    return link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
