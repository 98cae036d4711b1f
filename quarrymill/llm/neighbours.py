"""Problem 4: the most similar other vectors of every vector.

Method: stable projections and a kd-tree, walked in order of the projections.
Unit vectors are projected by random Gaussians, which are 2-stable: a projected
difference is the true distance times a Gaussian, its squared length a
chi-square.  A kd-tree over the projections (each node cuts the widest
projection that its path has not used yet) orders cells by how likely a neighbour
lies in them.  A vector first searches its own cell, which gives it a current k-th
distance; then it visits further cells, the next likeliest first, until the test
at the *current* k-th distance holds: the cells visited hold ``P_VISIT`` of the
places that a neighbour at that distance projects to.  In a cell a tree of its own
gives leaves in the same order, in waves, the distance and the test being renewed
after each wave; of a leaf's rows those are verified whose projected distance does
not exceed the ``P_VERIFY`` quantile of the chi-square at the k-th distance.

A least similarity only bounds the k-th distance from the start; without one it is
what the own cell gives.

Scale.  There are 2^``LEAST_DEPTH`` cells until a cell would hold more than
``CELL_ROWS``, what one task can hold, so up to that size what is shuffled grows with the
rows alone and beyond it with the square root of the cells besides.  A visitor travels
as one byte a dimension with the error that this leaves; candidates are kept by bounds
that hold for certain, and only what is then left meets its exact vectors.  Residents
of a cell come before its visitors, which stream past them.  A cell whose counted
rows exceed ``CELL_ROWS``, as in a dense group, is split into parts by hash; its
visitors go to each part, so nothing is lost and no task grows.  Vectors that equal each other take
part as six representatives at most; the rest take over their neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, hash_sample

#: Rows that one task holds of a cell.
CELL_ROWS = 1 << 18
#: Rows of a leaf, which are compared at once.
LEAF_ROWS = 4096
#: Halvings of any collection above one leaf, so that tasks can share it.
LEAST_DEPTH = 5
MAX_DEPTH = 20
#: Bounds of the vectors that set the tree's cuts: so many a cell, between these.
SAMPLE_A_CELL = 64
SAMPLE_ROWS = (20_000, 131_072)
PROJECTIONS = 28
#: Mass of the places of a neighbour at the k-th distance that the visited cells, or leaves of a cell, must hold.
P_VISIT = 0.93
P_LEAF = 0.97
#: Chi-square quantile that a projected squared distance must not exceed.
P_VERIFY = 0.999
SEED = 20_011


@dataclass(frozen=True)
class Tree:
    coordinate: np.ndarray  # that an inner node cuts, level by level
    thresholds: np.ndarray
    depth: int

    @staticmethod
    def fit(y: np.ndarray, depth: int, taken: tuple[int, ...] = ()) -> Tree:
        """Halves of the projected rows ``y``, by coordinates that are not ``taken``; none is used twice on a path."""
        inner = max(1, 2**depth - 1)
        coordinate, thresholds = np.zeros(inner, np.int64), np.zeros(inner, np.float32)
        spread = y.std(axis=0) if len(y) else np.zeros(y.shape[1])
        middle = np.median(y, axis=0) if len(y) else np.zeros(y.shape[1])
        node = np.zeros(len(y), np.int64)
        for d in range(depth):
            first = 2**d - 1
            order = np.argsort(node, kind="stable")
            at = np.searchsorted(node[order], np.arange(first, 2 * first + 2))
            for k in range(2**d):
                free = np.ones(y.shape[1], bool)
                free[list(taken)] = False
                above = first + k
                while above:
                    above = (above - 1) // 2
                    free[coordinate[above]] = False
                own = y[order[at[k] : at[k + 1]]]
                few = len(own) < 16  # too few to say: the collection's own spread and middle
                best = int(np.argmax(np.where(free, spread if few else own.std(axis=0), -1)))
                coordinate[first + k], thresholds[first + k] = best, middle[best] if few else np.median(own[:, best])
            node = 2 * node + 1 + (y[np.arange(len(y)), coordinate[node]] > thresholds[node])
        return Tree(coordinate, thresholds, depth)

    def home(self, y: np.ndarray) -> np.ndarray:
        node, at = np.zeros(len(y), np.int64), np.arange(len(y))
        for _ in range(self.depth):
            node = 2 * node + 1 + (y[at, self.coordinate[node]] > self.thresholds[node])
        return node - (2**self.depth - 1)

    def path(self, cell: int) -> tuple[int, ...]:
        """The coordinates cut on the way to a cell."""
        node, out = cell + 2**self.depth - 1, []
        while node:
            node = (node - 1) // 2
            out.append(int(self.coordinate[node]))
        return tuple(out)

    def visits(self, y: np.ndarray, radius: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell): the likeliest cells of a neighbour at ``radius``, likeliest first, until they hold ``least``.

        Branches below a cut are left out of a walk; the queries whose cells then hold too little walk again with
        a smaller cut, so no mass is lost for good.
        """
        queries, cells = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        todo, cut = [np.arange(len(y))] if len(y) else [], (1 - least) / 256
        while todo:
            short = []
            for part in todo:
                query, cell, mass = self._walk(y[part], radius[part], cut)
                order = np.lexsort((-mass, query))
                query, cell, mass = query[order], cell[order], mass[order]
                held = np.bincount(query, weights=mass, minlength=len(part)) >= least - 1e-9
                total = np.cumsum(mass)
                begin = np.searchsorted(query, np.arange(len(part)))
                before = total - mass - np.concatenate([[0], total])[begin][query]
                keep = held[query] & (before < least)
                queries.append(part[query[keep]])
                cells.append(cell[keep])
                short.append(part[~held])
            cut /= 16
            rest = np.concatenate(short)
            size = max(1, min(len(rest), int(cut * _WALK_CELLS)))  # a walk has fewer than 1 / cut branches a query
            todo = [rest[at : at + size] for at in range(0, len(rest), size)]
        query, cell = np.concatenate(queries), np.concatenate(cells)
        order = np.argsort(query, kind="stable")
        return query[order], cell[order]

    def _walk(self, y: np.ndarray, radius: np.ndarray, cut: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, cell, mass) of every cell whose mass is above ``cut``."""
        query, node, mass = np.arange(len(y)), np.zeros(len(y), np.int64), np.ones(len(y))
        for _ in range(self.depth):
            left = _normal((self.thresholds[node] - y[query, self.coordinate[node]]) / np.maximum(radius[query], 1e-6))
            query, node, mass = np.concatenate([query, query]), np.concatenate([2 * node + 1, 2 * node + 2]), np.concatenate([mass * left, mass * (1 - left)])
            keep = mass > cut
            query, node, mass = query[keep], node[keep], mass[keep]
        return query, node - (2**self.depth - 1), mass


#: Branches that walks hold at once.
_WALK_CELLS = 1 << 22


def projections(dims: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dims, PROJECTIONS)).astype(np.float32)


def _normal(x: np.ndarray) -> np.ndarray:
    """Standard normal distribution function (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = np.exp(-x * x / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x > 0, 1 - tail, tail)


def chi_square_quantile(p: float, k: int) -> float:
    """Wilson and Hilferty's approximation, by bisection of the normal distribution."""
    low, high = -8.0, 8.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if _normal(np.array([mid]))[0] < p else (low, mid)
    return k * (1 - 2 / (9 * k) + low * math.sqrt(2 / (9 * k))) ** 3


def _radius(similarity: np.ndarray) -> np.ndarray:
    """Distance of unit vectors of this cosine."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * np.asarray(similarity, np.float64)) + 1e-6)  # float32 cosines


def usable_vectors(batch: pa.RecordBatch, dims: int) -> pa.RecordBatch:
    """``id, vec``: the unit vectors (float32 bytes) of the rows whose vector has ``dims`` finite numbers, not all zero."""
    ids, col = batch.column(0), batch.column(1)
    offsets, values = np.asarray(col.offsets), col.values
    flat = np.asarray(values.fill_null(float("nan")) if values.null_count else values, dtype=np.float64)
    size = np.diff(offsets)
    here = np.flatnonzero((size == dims) & np.asarray(col.is_valid()) & np.asarray(ids.is_valid()))
    x = flat[offsets[here][:, None] + np.arange(dims)] if len(here) else np.zeros((0, dims))
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    here, x = here[good], x[good]
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(here)), _bytes(np.ascontiguousarray(x, np.float32))], ["id", "vec"])


def _bytes(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    raw = np.ascontiguousarray(x).view(np.uint8)
    offsets = (np.arange(len(x) + 1) * raw.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def _raw(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Binary values of ``width`` bytes each as the rows of a matrix of bytes."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    out = [np.frombuffer(c.buffers()[2], np.uint8, len(c) * width, int(np.frombuffer(c.buffers()[1], np.int32)[c.offset])).reshape(-1, width) for c in parts if len(c)]
    return np.concatenate(out) if out else np.zeros((0, width), np.uint8)


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    return np.ascontiguousarray(_raw(column, 4 * dims)).view(np.float32)


def encode(x: np.ndarray, kth: np.ndarray) -> np.ndarray:
    """Bytes of visitors: one byte a dimension, after the scale, the length of the error and the k-th similarity."""
    scale = np.abs(x).max(axis=1) / np.float32(127)
    code = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(x - code * scale[:, None], axis=1) * 1.0001 + 2e-6
    head = np.stack([scale, error.astype(np.float32), kth.astype(np.float32)], axis=1).astype(np.float32)
    return np.concatenate([head.view(np.uint8), code.view(np.uint8)], axis=1)


def decode(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, lengths of their errors, k-th similarities)."""
    head = np.ascontiguousarray(raw[:, :12]).view(np.float32)
    return np.ascontiguousarray(raw[:, 12:]).view(np.int8) * head[:, :1], head[:, 1], head[:, 2].copy()


class Cell:
    """The rows of a cell (or of a part of one) under a kd-tree of their own, and each row's k-th similarity so far."""

    def __init__(self, row: np.ndarray, x: np.ndarray, kth: np.ndarray, matrix: np.ndarray, taken: tuple[int, ...], k: int):
        y = x @ matrix
        depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, len(row)) / LEAF_ROWS))), matrix.shape[1] - len(taken))
        self.tree = Tree.fit(y, depth, taken)
        leaf = self.tree.home(y)
        order = np.argsort(leaf, kind="stable")
        self.row, self.x, self.y, self.kth = row[order], x[order], y[order], kth[order].astype(np.float32)
        self.norm = (self.y * self.y).sum(axis=1)
        self.begin = np.searchsorted(leaf[order], np.arange(2**depth + 1))
        self.matrix, self.k = matrix, k
        self.chi = chi_square_quantile(P_VERIFY, matrix.shape[1])

    def search(self, row: np.ndarray, x: np.ndarray, kth: np.ndarray, error: np.ndarray | float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, resident, cosine, its error) of what may be among the ``k`` best of either; ``kth`` is renewed in place.

        Rows of the same number are the same vector and no pair.  Cosines are those of ``x``, off by ``error`` at most.
        """
        y = x @ self.matrix
        error = np.broadcast_to(np.asarray(error, np.float32), (len(row),))
        seen = np.zeros((len(row), 2**self.tree.depth), bool)
        q, r, sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        active, wave = np.arange(len(row)), 1
        while len(active):
            query, leaf = self.tree.visits(y[active], _radius(kth[active]), P_LEAF)
            query = active[query]
            new = ~seen[query, leaf]
            query, leaf = query[new], leaf[new]
            nth = np.arange(len(query)) - np.searchsorted(query, query)
            query, leaf = query[nth < wave], leaf[nth < wave]
            seen[query, leaf] = True
            found = [self._leaf(int(n), query[leaf == n], row, x, y, kth, error) for n in np.unique(leaf)]
            if found:
                q, r, sim = (np.concatenate([a, *b]) for a, b in zip((q, r, sim), zip(*found)))
                keep = self._wanted(q, r, sim, error)
                q, r, sim = q[keep], r[keep], sim[keep]
                own, low = _kth(q, sim - error[q], self.k)
                kth[own] = np.maximum(kth[own], low)
            active, wave = np.unique(query), 2 * wave
        own, low = _kth(r, sim - error[q], self.k)
        self.kth[own] = np.maximum(self.kth[own], low)
        return q, r, sim, error[q]

    def _leaf(self, leaf: int, own: np.ndarray, row, x, y, kth, error) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = int(self.begin[leaf]), int(self.begin[leaf + 1])
        reach = self.chi * _radius(self.kth[a:b]).astype(np.float32) ** 2 + 1e-3
        qs, rs, sims = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        for at in range(0, len(own), 1024):
            i = own[at : at + 1024]
            far = (y[i] * y[i]).sum(axis=1)[:, None] + self.norm[a:b] - 2 * (y[i] @ self.y[a:b].T)
            bound = self.chi * (_radius(kth[i]).astype(np.float32) + error[i]) ** 2 + 1e-3
            q, r = np.nonzero((far <= bound[:, None]) | (far <= reach))
            q, r = i[q], r + a
            apart = row[q] != self.row[r]
            q, r = q[apart], r[apart]
            for part in range(0, len(q), 1 << 18):
                pq, pr = q[part : part + (1 << 18)], r[part : part + (1 << 18)]
                sim = np.einsum("ij,ij->i", x[pq], self.x[pr])
                good = sim + error[pq] >= np.minimum(kth[pq], self.kth[pr])
                qs.append(pq[good])
                rs.append(pr[good])
                sims.append(sim[good])
        return np.concatenate(qs), np.concatenate(rs), np.concatenate(sims)

    def _wanted(self, q: np.ndarray, r: np.ndarray, sim: np.ndarray, error: np.ndarray) -> np.ndarray:
        return _best(q, sim, error[q], self.k) | ((sim + error[q] >= self.kth[r]) & _best(r, sim, error[q], self.k))

    def directed(self, row: np.ndarray, q: np.ndarray, r: np.ndarray, sim: np.ndarray, error: np.ndarray, kth: np.ndarray) -> pa.RecordBatch:
        """``row, other, sim, error``: candidates of the queries, then of the residents."""
        ahead = (sim + error >= kth[q]) & _best(q, sim, error, self.k)
        back = (sim + error >= self.kth[r]) & _best(r, sim, error, self.k)
        cat = lambda u, v: np.concatenate([u[ahead], v[back]])
        return pa.RecordBatch.from_arrays([pa.array(cat(row[q], self.row[r])), pa.array(cat(self.row[r], row[q])), pa.array(cat(sim, sim).astype(np.float32)), pa.array(cat(error, error).astype(np.float32))], ["row", "other", "sim", "error"])


def _kth(owner: np.ndarray, low: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, its k-th largest value) of the owners that have ``k``."""
    order = np.lexsort((-low, owner))
    o = owner[order]
    begin = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]])) if len(o) else np.zeros(0, np.int64)
    full = begin[np.diff(np.concatenate([begin, [len(o)]])) >= k]
    return o[full], low[order][full + k - 1]


def _best(owner: np.ndarray, sim: np.ndarray, error: np.ndarray, k: int) -> np.ndarray:
    """Which may be among the ``k`` best of their owner: their greatest value is not below the k-th of the least values."""
    out = np.ones(len(owner), bool)
    own, low = _kth(owner, sim - error, k)
    if len(own):
        at = np.minimum(np.searchsorted(own, owner), len(own) - 1)
        out = (own[at] != owner) | (sim + error >= low[at] - 1e-6)
    return out


@dataclass(frozen=True)
class Plan:
    """What every task needs to route rows: the projections, the cells' tree, and the parts of each cell."""

    matrix: np.ndarray
    tree: Tree
    begin: np.ndarray  # first part of each cell, and the number of all parts

    def home(self, y: np.ndarray, row: np.ndarray) -> np.ndarray:
        cell = self.tree.home(y)
        return self.begin[cell] + (row * 0x9E3779B1 >> 7) % np.diff(self.begin)[cell]

    def cell(self, part: int) -> int:
        return int(np.searchsorted(self.begin, part, side="right")) - 1

    def visits(self, y: np.ndarray, kth: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, part): the cells that the test at the k-th distance asks for, and all parts of the own cell, without the own part."""
        query, cell = self.tree.visits(y, _radius(kth), P_VISIT)
        many = np.diff(self.begin)[cell]
        part = np.repeat(self.begin[cell], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        query = np.repeat(query, many)
        keep = part != home[query]
        return query[keep], part[keep]


def plan_cells(points: DataFrame, rows: int, dims: int) -> Plan:
    """A tree from a bounded sample; every row is counted, so that cells above ``CELL_ROWS`` get parts."""
    depth = 0 if rows <= LEAF_ROWS else min(MAX_DEPTH, max(LEAST_DEPTH, math.ceil(math.log2(rows / CELL_ROWS))))
    matrix = projections(dims)
    if not depth:
        return Plan(matrix, Tree.fit(np.zeros((0, PROJECTIONS), np.float32), 0), np.array([0, max(1, math.ceil(rows / CELL_ROWS))]))
    size = min(max(SAMPLE_ROWS[0], SAMPLE_A_CELL << depth), SAMPLE_ROWS[1])
    sample = _matrix(hash_sample(points.select("id", "vec"), "id", size, rows).toArrow()["vec"], dims)
    tree = Tree.fit(sample @ matrix, depth)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2**depth, np.int64)
        for b in batches:
            total += np.bincount(tree.home(_matrix(b.column(0), dims) @ matrix), minlength=len(total))
        here = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(total[here])], ["cell", "n"])

    counted = points.select("vec").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(2**depth, np.int64)
    n[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    return Plan(matrix, tree, np.concatenate([[0], np.cumsum(np.maximum(1, -(-n // CELL_ROWS)))]))


_FOUND = "row long, other long, sim float, error float"


def nearest(vectors: DataFrame, k: int = 5, least: float | None = 0.85, dims: int = 64) -> DataFrame:
    """``id, neighbour, similarity, rank``: up to ``k`` other ids of each id, by cosine, ``least`` or more (any, if None).

    ``vectors`` has ``id, vector``.  Rows without id, and vectors that are not exactly ``dims`` finite numbers
    or are all zero, take no part.  An id that occurs again counts once (of differing vectors, the smallest
    bytes).  Equal similarities are ranked by id.
    """
    spark = vectors.sparkSession
    floor = -1.0 if least is None else least

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield usable_vectors(b, dims)

    usable = vectors.select("id", F.col("vector").cast("array<double>")).where(F.col("id").isNotNull() & (F.size("vector") == dims)).mapInArrow(read, "id string, vec binary")
    single = usable.groupBy("id").agg(F.min("vec").alias("vec"))
    # Row numbers come after the checkpoint, whose parts and order no longer change.
    single = checkpointed(single).withColumn("row", F.monotonically_increasing_id())
    points, more = representatives(single, k)
    plan = plan_cells(points, points.count(), dims)
    shipped = spark.sparkContext.broadcast(plan)  # at most 2^MAX_DEPTH thresholds: 12 MB
    parts = int(plan.begin[-1])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shipped.value
        for b in batches:
            home = p.home(_matrix(b.column(1), dims) @ p.matrix, b.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), b.column(0), b.column(1)], ["part", "row", "vec"])

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of each part with their k-th similarity, and what they found in it."""
        p = shipped.value
        for part, table in _by_part(batches):
            cell = Cell(table["row"].to_numpy(), _matrix(table["vec"], dims), np.full(len(table), floor), p.matrix, p.tree.path(p.cell(part)), k)
            for at in range(0, len(table), 8192):
                here = slice(at, at + 8192)
                kth = cell.kth[here].copy()
                found = cell.search(cell.row[here], cell.x[here], kth, 2e-6)
                out = cell.directed(cell.row[here], *found, kth)
                cell.kth[here] = np.maximum(cell.kth[here], kth)
                none = lambda kind: pa.nulls(len(out), kind)
                yield pa.RecordBatch.from_arrays([none(pa.int32()), *out.columns, none(pa.binary())], _HOME_COLUMNS)
            none = lambda kind: pa.nulls(len(cell.row), kind)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell.row), part, np.int32)), pa.array(cell.row), none(pa.int64()), pa.array(cell.kth), none(pa.float32()), _bytes(cell.x)], _HOME_COLUMNS)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row as a resident of its part, and, with its number negated, as a visitor of others."""
        p = shipped.value
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                own = b.slice(at, 4096)
                home, row, kth, x = own.column(0).to_numpy(), own.column(1).to_numpy(), own.column(2).to_numpy(), _matrix(own.column(3), dims)
                query, part = p.visits(x @ p.matrix, kth, home)
                residents = np.concatenate([kth.astype(np.float32)[:, None], x], axis=1)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), _bytes(residents)], _ROUTED_COLUMNS)
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(-1 - row[query]), _bytes(encode(x, kth)[query])], _ROUTED_COLUMNS)

    def abroad(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the visitors of each part, which come after its residents, find among them."""
        p = shipped.value
        for part, residents, visitors in _residents_first(batches):
            raw = _raw(residents["vec"], 4 + 4 * dims).view(np.float32)
            cell = Cell(residents["row"].to_numpy(), np.ascontiguousarray(raw[:, 1:]), raw[:, 0], p.matrix, p.tree.path(p.cell(part)), k)
            for b in visitors:
                x, error, kth = decode(_raw(b.column(2), 12 + dims))
                row = -1 - b.column(1).to_numpy()
                yield cell.directed(row, *cell.search(row, x, kth, error), kth)

    settled = points.select("row", "vec").mapInArrow(settle, "part int, row long, vec binary").repartitionById(parts, "part").sortWithinPartitions("part")
    homed = checkpointed(settled.mapInArrow(at_home, "part int, row long, other long, sim float, error float, vec binary"))
    found = homed.where(F.col("other").isNotNull()).select("row", "other", "sim", "error")
    if parts > 1:
        routed = homed.where(F.col("other").isNull()).select("part", "row", "sim", "vec").mapInArrow(route, "part int, row long, vec binary")
        met = routed.repartitionById(parts, "part").sortWithinPartitions("part", F.col("row").desc()).mapInArrow(abroad, _FOUND)
        found = found.unionByName(met)
    ranked = _ranked(verified(found, points, k, floor, dims), points, k)
    return ranked if more is None else ranked.unionByName(more)


_HOME_COLUMNS = ["part", "row", "other", "sim", "error", "vec"]
_ROUTED_COLUMNS = ["part", "row", "vec"]


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each ``part``, which lie together."""
    held: list[pa.RecordBatch] = []
    for b in _split_by_part(batches):
        if held and held[0].column(0)[0] != b.column(0)[0]:
            yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)
            held = []
        held.append(b)
    if held:
        yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)


def _split_by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        part = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
        yield from (b.slice(x, z - x) for x, z in zip(cuts, cuts[1:]) if z > x)


def _residents_first(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table, Iterator[pa.RecordBatch]]]:
    """(part, residents, visitors as they stream) of parts whose residents (row numbers from 0) come first.

    A part of visitors alone has nothing to find.
    """
    stream = _split_by_part(batches)
    ahead: list[pa.RecordBatch] = []

    def take() -> pa.RecordBatch | None:
        return ahead.pop() if ahead else next(stream, None)

    while (b := take()) is not None:
        part, held = b.column(0)[0].as_py(), []
        while b is not None and b.column(0)[0].as_py() == part:
            n = int((b.column(1).to_numpy() >= 0).sum())
            if n:
                held.append(b.slice(0, n))
            if n < b.num_rows:
                ahead.append(b.slice(n))
                break
            b = take()
        else:
            ahead += [] if b is None else [b]

        def visitors() -> Iterator[pa.RecordBatch]:
            while (v := take()) is not None:
                if v.column(0)[0].as_py() != part:
                    ahead.append(v)
                    return
                for at in range(0, v.num_rows, 8192):
                    yield v.slice(at, 8192)

        rest = visitors()
        if held:
            yield part, pa.Table.from_batches(held), rest
        for _ in rest:
            pass


def verified(found: DataFrame, points: DataFrame, k: int, floor: float, dims: int) -> DataFrame:
    """``row, other, similarity``: exact cosines of the candidates that may still be among a row's ``k`` best.

    By what is certain, a candidate whose greatest value lies below the k-th of a row's least values is none; so few pairs
    meet their vectors.
    """
    once = found.groupBy("row", "other").agg(F.max(F.col("sim") - F.col("error")).alias("low"), F.min(F.col("sim") + F.col("error")).alias("high"))
    kth = F.nth_value("low", k).over(W.partitionBy("row").orderBy(F.col("low").desc()).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    kept = once.withColumn("_kth", kth).where((F.col("high") >= F.coalesce("_kth", F.lit(-2.0)) - 1e-6) & (F.col("high") >= floor - 1e-6))
    ends = kept.select(F.least("row", "other").alias("a"), F.greatest("row", "other").alias("b"), (F.col("row") < F.col("other")).alias("ahead"))
    pairs = ends.groupBy("a", "b").agg(F.max("ahead").alias("for_a"), F.max(~F.col("ahead")).alias("for_b"))
    vec = points.select("row", "vec")
    met = pairs.join(vec.select(F.col("row").alias("a"), F.col("vec").alias("va")), "a").join(vec.select(F.col("row").alias("b"), F.col("vec").alias("vb")), "b")

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sim = np.einsum("ij,ij->i", _matrix(b.column(4), dims).astype(np.float64), _matrix(b.column(5), dims).astype(np.float64))
            good = pa.array(sim >= floor - 1e-7)
            yield pa.RecordBatch.from_arrays([c.filter(good) for c in (b.column(0), b.column(1), b.column(2), b.column(3), pa.array(sim))], ["a", "b", "for_a", "for_b", "similarity"])

    exact = met.select("a", "b", "for_a", "for_b", "va", "vb").mapInArrow(cosine, "a long, b long, for_a boolean, for_b boolean, similarity double")
    way = lambda ok, x, y: F.when(ok, F.struct(F.col(x).alias("row"), F.col(y).alias("other")))
    ways = F.filter(F.array(way(F.col("for_a"), "a", "b"), way(F.col("for_b"), "b", "a")), lambda w: w.isNotNull())
    return exact.select(F.explode(ways).alias("w"), "similarity").select("w.row", "w.other", "similarity")


def _ranked(both: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """Ranked by row number first, ties kept, so that few rows meet their ids; the ids then break the ties."""
    level = F.round("similarity", 9)
    few = both.withColumn("level", level).withColumn("_r", F.rank().over(W.partitionBy("row").orderBy(F.col("level").desc()))).where(F.col("_r") <= k)
    names = points.select("row", "id")
    named = few.join(names.select(F.col("row").alias("other"), F.col("id").alias("neighbour")), "other").select("row", "neighbour", "similarity", "level").join(names, "row")
    best = F.row_number().over(W.partitionBy("row").orderBy(F.col("level").desc(), "neighbour"))
    return named.withColumn("rank", best).where(F.col("rank") <= k).select("id", "neighbour", "similarity", "rank")


#: Rows up to which the ids of surplus copies, or the hashes of their groups, are broadcast; more are shuffled.
BROADCAST_ROWS = 50_000


def representatives(single: DataFrame, k: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows that take part, neighbours of the others) of ``id, vec, row``.

    Of equal vectors the first ``k + 1`` ids take part; the nearest of every other copy are the first ``k``.
    Two hashes stand for a vector, so none is shuffled; groups are limited before the shuffle.
    """
    keys = single.select("id", F.xxhash64("vec").alias("_h"), F.hash("vec").alias("_g"))
    groups = checkpointed(keys.groupBy("_h", "_g").agg(F.count("*").alias("_n")).where(F.col("_n") > k + 1).select("_h", "_g"))
    n = groups.count()
    if not n:
        return single, None
    members = keys.join(_small(groups, n), ["_h", "_g"])
    order = F.row_number().over(W.partitionBy("_h", "_g").orderBy("id"))
    first = members.withColumn("_r", order).where(F.col("_r") <= k + 1).groupBy("_h", "_g").agg(F.sort_array(F.collect_list("id")).alias("first"))  # k + 1 ids
    others = checkpointed(members.join(_small(first, n), ["_h", "_g"]).where(~F.array_contains("first", F.col("id"))).select("id", "first"))
    points = single.join(_small(others.select("id"), others.count()), "id", "left_anti")
    more = others.select("id", F.posexplode(F.slice("first", 1, k)).alias("p", "neighbour"))
    return points, more.select("id", "neighbour", F.lit(1.0).alias("similarity"), (F.col("p") + 1).alias("rank"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint when its counted rows are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def p4_found(chunks: DataFrame) -> DataFrame:
    """``id_a, id_b``: pairs of which one is among the five most similar of the other, at 0.85 or more."""
    found = nearest(chunks.select("id", "vector"), 5, 0.85)
    return found.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
