"""Approximate nearest neighbours: a vantage-point tree for each shard of the vectors.

A node splits its vectors at the median distance from a vantage point; leaves hold a few dozen. A
query first falls to one leaf, which bounds its distance, and then every part is passed over that the
triangle inequality rules out: one whose gap to the query is larger than the distance of the k-th
vector so far, divided by ``factor``. Factor 1 is exact search; below it less is searched.

Shards are made the same way: a small vantage-point tree over a bounded sample sends every vector to one of
at most ``most_leaves`` leaves, and of each leaf the least and the largest distance from the vantage points above
it are kept, over all its vectors. A leaf of more bytes than a shard may have is several shards. Each
shard is a file: its vectors and their tree. Queries first go to the shards of their own leaf, and then,
with the distance of the k-th found, to those of the leaves that the inequality leaves over.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import AtomicFile, discard, materialize, open_fs, shared_path

_INF = float("inf")
_NONE = np.iinfo(np.int64).max
#: Rows of the sample that shards are planned on, and bytes of it, whichever is less.
SAMPLE_ROWS, SAMPLE_BYTES = 4096, 32 << 20


def distances(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distances (queries, vectors) in double precision, dimension after dimension.

    Equal vectors have equal distances to the last bit, whatever they are compared with. Where squares
    overflow, both vectors are scaled down first.
    """
    total = np.zeros((len(queries), len(vectors)))
    with np.errstate(over="ignore", invalid="ignore"):
        for q, v in zip(queries.T, vectors.T):
            d = q[:, None] - v[None, :]
            d *= d
            total += d
        np.sqrt(total, out=total)
        for i, j in zip(*np.nonzero(~np.isfinite(total))):
            scale = max(np.abs(queries[i]).max(), np.abs(vectors[j]).max())
            total[i, j] = scale * np.sqrt(((queries[i] / scale - vectors[j] / scale) ** 2).sum())
    return total


def near(reach: np.ndarray | float) -> np.ndarray | float:
    """A distance with room for rounding, which is far below this."""
    return reach + 1e-9 * (1 + reach)


class VpTree:
    """Tree over vectors (n, d). A node has a vantage and two children, or, with vantage -1, a range of ``order``."""

    def __init__(self, vectors: np.ndarray, leaf: int = 48, seed: int = 5):
        self.vectors = vectors
        self.order = np.arange(len(vectors))
        rng = np.random.default_rng(seed)
        vantage, range_, child, bounds = [], [], [], []
        todo = [(0, len(vectors), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            me = len(vantage)
            if parent >= 0:
                child[parent][side] = me
            vantage.append(-1)
            range_.append((lo, hi))
            child.append([-1, -1])
            bounds.append((0.0,) * 4)
            if hi - lo <= leaf:
                continue
            at = lo + int(rng.integers(hi - lo))
            self.order[[lo, at]] = self.order[[at, lo]]
            d = distances(vectors[self.order[lo : lo + 1]], vectors[self.order[lo + 1 : hi]])[0]
            rank = np.argsort(d, kind="stable")
            self.order[lo + 1 : hi] = self.order[lo + 1 : hi][rank]
            mid = len(d) // 2
            # distances of the two parts: bounds for pruning
            vantage[me], bounds[me] = int(self.order[lo]), (float(d[rank[0]]), float(d[rank[mid - 1]]), float(d[rank[mid]]), float(d[rank[-1]]))
            todo += [(lo + 1, lo + 1 + mid, me, 0), (lo + 1 + mid, hi, me, 1)]
        self.vantage, self.range, self.child, self.bounds = np.array(vantage), np.array(range_), np.array(child), np.array(bounds)

    _SAVED = ("vectors", "order", "vantage", "range", "child", "bounds")

    def save(self, uri: str, ids: np.ndarray) -> None:
        """One file, whole or not at all."""
        data = io.BytesIO()
        np.savez(data, ids=ids, **{k: getattr(self, k) for k in self._SAVED})
        file = AtomicFile(uri)
        file.write(data.getvalue())
        file.commit()

    @classmethod
    def load(cls, uri: str) -> tuple[VpTree, np.ndarray]:
        system, path = open_fs(uri)
        with system.open_input_stream(path, compression=None) as stream:
            saved = np.load(io.BytesIO(stream.read()))
        tree = cls.__new__(cls)
        for k in cls._SAVED:
            setattr(tree, k, saved[k])
        return tree, saved["ids"]

    def search(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, factor: float = 1.0, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances (queries, k) of the nearest, ties to smaller ids; where there are fewer, the id is the largest long.

        A vector whose id is the query's ``own`` is no candidate. Of vectors farther than ``limit`` some
        may be left out.
        """
        n = len(queries)
        best, name = np.full((n, k), _INF), np.full((n, k), _NONE)
        limit = np.full(n, _INF) if limit is None else limit

        def offer(rows: np.ndarray, members: np.ndarray, d: np.ndarray) -> None:
            names = np.broadcast_to(ids[members], d.shape)
            mine = names == own[rows][:, None]
            d, names = np.where(mine, _INF, d), np.where(mine, _NONE, names)
            close = np.flatnonzero((d <= best[rows, -1][:, None]).any(axis=1))
            if len(close):
                r = rows[close]
                alld, alln = np.concatenate((best[r], d[close]), axis=1), np.concatenate((name[r], names[close]), axis=1)
                pick = np.lexsort((alln, alld), axis=1)[:, :k]
                best[r], name[r] = np.take_along_axis(alld, pick, axis=1), np.take_along_axis(alln, pick, axis=1)

        first = {}
        falls = [(0, np.arange(n))] if len(self.vectors) else []
        while falls:
            at, rows = falls.pop()
            if self.vantage[at] < 0:
                members = self.order[slice(*self.range[at])]
                offer(rows, members, distances(queries[rows], self.vectors[members]))
                first[at] = rows
                continue
            d = distances(queries[rows], self.vectors[[self.vantage[at]]])[:, 0]
            inner = d <= self.bounds[at, 1:3].sum() / 2
            falls += [(int(c), x) for c, x in zip(self.child[at], (rows[inner], rows[~inner])) if len(x)]
        todo = [(0, np.arange(n))] if len(self.vectors) else []
        while todo:
            at, rows = todo.pop()
            if self.vantage[at] < 0:
                rows = np.setdiff1d(rows, first.get(at, rows[:0]), assume_unique=True)
                if len(rows):
                    members = self.order[slice(*self.range[at])]
                    offer(rows, members, distances(queries[rows], self.vectors[members]))
                continue
            v = self.vantage[at]
            d = distances(queries[rows], self.vectors[[v]])
            offer(rows, np.array([v]), d)
            d, reach = d[:, 0], near(np.minimum(best[rows, -1], limit[rows]) * factor)
            a, b, c, e = self.bounds[at]
            with np.errstate(invalid="ignore"):  # a gap between two infinite distances rules nothing out
                inner, outer = ~((d - b > reach) | (a - d > reach)), ~((d - e > reach) | (c - d > reach))
            todo += [(int(child), rows[x]) for child, x in zip(self.child[at][::-1], (outer, inner)) if x.any()]
        return name, best


class Routes:
    """Vantage-point tree over a sample, whose leaves are the places of shards."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 9, least: int = 16):
        rng = np.random.default_rng(seed)
        self.points, self.radius, self.child, self.paths = [], [], [], [[]]  # a path holds (node, side)
        groups, open_ = {0: sample}, True
        while len(groups) < leaves and open_:
            leaf = max(groups, key=lambda x: len(groups[x]))
            rows = groups[leaf]
            open_ = len(rows) >= 2 * least
            if open_:
                point = rows[int(rng.integers(len(rows)))]
                d = distances(point[None, :], rows)[0]
                radius = float(np.median(d))
                inner = d <= radius
                if inner.all():  # many copies of one vector
                    radius = float(np.nextafter(radius, -_INF))
                    inner = d <= radius
                if inner.all() or not inner.any():
                    groups[leaf] = rows[:0]
                    open_ = any(len(x) >= 2 * least for x in groups.values())
                    continue
                node, other = len(self.points), len(self.paths)
                self.points.append(point)
                self.radius.append(radius)
                if self.paths[leaf]:
                    parent, side = self.paths[leaf][-1]
                    self.child[parent][side] = node
                self.child.append([~leaf, ~other])
                self.paths.append([*self.paths[leaf], (node, 1)])
                self.paths[leaf] = [*self.paths[leaf], (node, 0)]
                groups[leaf], groups[other] = rows[inner], rows[~inner]
        self.leaves = len(self.paths)

    def leaf(self, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros(len(vectors), np.int64)
        todo = [(0, np.arange(len(vectors)))] if self.points else []
        while todo:
            node, rows = todo.pop()
            inner = distances(vectors[rows], self.points[node][None, :])[:, 0] <= self.radius[node]
            for child, x in zip(self.child[node], (rows[inner], rows[~inner])):
                if len(x) and child >= 0:
                    todo.append((child, x))
                else:
                    out[x] = ~child
        return out

    def ranges(self, leaf: int, vectors: np.ndarray) -> list[tuple[float, float]]:
        """Least and largest distance of vectors from each vantage point above their leaf."""
        if not self.paths[leaf]:
            return []
        d = distances(np.array([self.points[n] for n, _ in self.paths[leaf]]), vectors)
        return list(zip(d.min(axis=1).tolist(), d.max(axis=1).tolist()))

    def gaps(self, vectors: np.ndarray, known: dict[int, list[tuple[float, float]]]) -> np.ndarray:
        """How far each vector is at least from all of each leaf (vectors, leaves); infinite for a leaf without any."""
        d = distances(vectors, np.array(self.points)) if self.points else np.zeros((len(vectors), 0))
        out = np.full((len(vectors), self.leaves), _INF)
        for leaf, ranges in known.items():
            gap = np.zeros(len(vectors))
            with np.errstate(invalid="ignore"):
                for (node, _), (lo, hi) in zip(self.paths[leaf], ranges):
                    gap = np.fmax(gap, np.fmax(d[:, node] - hi, lo - d[:, node]))
            out[:, leaf] = gap
        return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vector (array<double>) and dim of the rows that take part."""
    x = F.col(vector_col).cast("array<double>")
    big = F.lit(_INF)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < big)) & F.exists(x, lambda v: v != 0)
    return vectors.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("vector"), F.size(x).alias("dim"))


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, row numbers and vectors of the rows of each length; columns are vec_id, vector, dim."""
    dims = np.asarray(batch.column(2))
    lists = batch.column(1)
    flat, offsets = np.asarray(lists.flatten()), np.concatenate(([0], np.cumsum(dims)))
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        yield dim, rows, flat[offsets[rows][:, None] + np.arange(dim)]


class Index:
    """Shards of vectors in files: how vectors find their leaf, each leaf's shards, and its ranges."""

    def __init__(self, folder: str, routes: dict[int, Routes], shards: dict[tuple[int, int], int], ranges: dict[tuple[int, int], list]):
        self.folder, self.routes, self.shards, self.ranges = folder, routes, shards, ranges

    def of(self, dim: int) -> Routes:
        return self.routes.get(dim) or Routes(np.zeros((0, dim)), 1)

    def known(self, dim: int) -> dict[int, list]:
        return {leaf: r for (d, leaf), r in self.ranges.items() if d == dim}


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", shard_bytes: int = 16 << 20, leaf_rows: int = 4096, most_leaves: int = 256) -> Index:
    """Write every usable vector to a shard file of about ``shard_bytes`` at most.

    The plan is fitted on a sample of ``SAMPLE_ROWS`` rows (or ``SAMPLE_BYTES``) chosen by hash; the
    driver holds that, and a row for each vector length and leaf.
    """
    spark, rows = vectors.sparkSession, usable(vectors, id_col, vector_col)
    folder = shared_path(spark, "vp-index")
    counts = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    largest = max(counts, default=1)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("vector", "dim").limit(max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(1, largest))))).collect()
    routes = {}
    for dim in {r["dim"] for r in sample}:
        routes[dim] = Routes(np.array([r["vector"] for r in sample if r["dim"] == dim]), int(min(most_leaves, -(-counts[dim] // leaf_rows))))
    plan = Index(folder, routes, {}, {})

    @F.arrow_udf("int")
    def leaf_of(ids: pa.Array, vector: pa.Array, dim: pa.Array) -> pa.Array:
        out = np.zeros(len(dim), np.int32)
        for d, at, x in _by_dim(pa.RecordBatch.from_arrays([ids, vector, dim], names=["i", "v", "d"])):
            out[at] = plan.of(d).leaf(x)
        return pa.array(out)

    routed = rows.withColumn("leaf", leaf_of("vec_id", "vector", "dim"))
    sizes = {(r["dim"], r["leaf"]): r["n"] for r in routed.groupBy("dim", "leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan.shards = {(d, leaf): -(-n * 8 * d // shard_bytes) for (d, leaf), n in sizes.items()}
    several = {k: n for k, n in plan.shards.items() if n > 1}
    many = F.lit(1)
    for (d, leaf), n in several.items():
        many = F.when((F.col("dim") == d) & (F.col("leaf") == leaf), n).otherwise(many)
    fields = "dim int, leaf int, depth int, lo double, hi double"

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dim, leaf, piece = (int(x) for x in key)
        pdf = pdf.sort_values("vec_id", kind="stable")
        data = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
        VpTree(data).save(_file(folder, dim, leaf, piece), pdf["vec_id"].to_numpy(np.int64))
        found = plan.of(dim).ranges(leaf, data) or [(0.0, 0.0)]
        return pd.DataFrame([(dim, leaf, i, lo, hi) for i, (lo, hi) in enumerate(found)], columns=["dim", "leaf", "depth", "lo", "hi"])

    placed = routed.withColumn("piece", F.pmod(F.xxhash64("vec_id"), many).cast("int"))
    packed = placed.repartition(max(1, sum(plan.shards.values())), "dim", "leaf", "piece").groupBy("dim", "leaf", "piece").applyInPandas(pack, fields)
    packed = materialize(packed, "vp-shards")
    for r in packed.groupBy("dim", "leaf", "depth").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("dim", "leaf", "depth").collect():
        plan.ranges.setdefault((r["dim"], r["leaf"]), []).append((r["lo"], r["hi"]))
    discard(packed)
    return plan


def _file(folder: str, dim: int, leaf: int, piece: int) -> str:
    return f"{folder}/d{dim}-l{leaf}-s{piece}.npz"


_SENT = pa.schema([("dim", pa.int32()), ("leaf", pa.int32()), ("piece", pa.int32()), ("query_id", pa.int64()), ("vector", pa.binary()), ("reach", pa.float64())])
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _send(index: Index, home: bool, factor: float):
    """A row for each shard that a query is to be held against: those of its leaf, or of all others near enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            reach = np.full(len(ids), _INF) if home else np.asarray(batch.column(3).fill_null(_INF))
            out = []
            for dim, rows, x in _by_dim(batch):
                routes, known = index.of(dim), index.known(dim)
                own = routes.leaf(x)
                if home:
                    pairs = [(i, int(leaf)) for i, leaf in enumerate(own)]
                else:
                    goes = routes.gaps(x, known) <= near(reach[rows] * factor)[:, None]
                    goes[np.arange(len(own)), own] = False
                    pairs = [(int(i), int(leaf)) for i, leaf in zip(*np.nonzero(goes)) if leaf in known]
                data = [v.tobytes() for v in x]
                out += [(dim, leaf, piece, int(ids[rows[i]]), data[i], float(reach[rows[i]])) for i, leaf in pairs for piece in range(index.shards.get((dim, leaf), 0))]
            for at in range(0, len(out), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[at : at + 5000]), _SENT)], schema=_SENT)

    return run


def _search(folder: str, k: int, factor: float, block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, loaded = None, [], [None, None, None]

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                if loaded[0] != here:
                    loaded[:] = [here, *VpTree.load(_file(folder, *here))]
                own = np.array([q for q, _, _ in held], np.int64)
                data = np.frombuffer(b"".join(v for _, v, _ in held), np.float64).reshape(len(held), -1)
                name, score = loaded[1].search(data, own, loaded[2], k, factor, np.array([r for _, _, r in held]))
                has = name != _NONE
                held.clear()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, has.sum(axis=1))), pa.array(name[has]), pa.array(score[has])], schema=_FOUND)

        for batch in batches:
            for dim, leaf, piece, query, vector, reach in zip(*(c.to_pylist() for c in batch.columns)):
                if (dim, leaf, piece) != here or len(held) >= block_rows:
                    yield from flush()
                    here = (dim, leaf, piece)
                held.append((query, vector, reach))
        yield from flush()

    return run


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, factor: float = 1.0, block_rows: int = 1024, **index_options) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance) of each query's k nearest.

    The query's own id is no candidate; equal distances go to smaller ids; fewer candidates give fewer
    rows. Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
    rows without an id; a query meets vectors of its own length only. Repeated vectors are candidates
    each; of several vectors of one query id the smallest array asks; other columns are ignored; an
    empty table gives no rows. At ``factor`` 1 the result is exact.
    """
    index = build_index(vectors, id_col, vector_col, **index_options)
    asked = usable(queries, id_col, vector_col).groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))
    asked = materialize(asked, "vp-queries")
    sent, found = "dim int, leaf int, piece int, query_id long, vector binary, reach double", "query_id long, vec_id long, score double"
    shards = max(1, sum(index.shards.values()))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))

    def held_against(rows: DataFrame, home: bool) -> DataFrame:
        # a stated query set: each query goes to the shards that may hold its nearest
        met = rows.mapInArrow(_send(index, home, factor), sent)
        return met.repartition(shards, "dim", "leaf", "piece").sortWithinPartitions("dim", "leaf", "piece").mapInArrow(_search(index.folder, k, factor, block_rows), found)

    first = materialize(held_against(asked, True).withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"), "vp-first")
    reach = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.max("score")).alias("reach"))
    far = asked.join(reach.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").select("vec_id", "vector", "dim", "reach")
    both = first.unionByName(held_against(far, False))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


NEAREST_SQL = """
WITH fine AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
met AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.v, c.v) AS score FROM fine q JOIN fine c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score FROM met
QUALIFY rank <= 10"""
