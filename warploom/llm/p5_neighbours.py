"""Problem 5: the most similar vectors for every vector.

Method: NN-descent. Vectors are scaled to unit length and held as 16-bit numbers; equal ones are put together first. A
few random-projection trees, fitted on a bounded sample of at most ``SAMPLE`` vectors, cut the space into cells; every
vector goes to one cell of each tree, and inside a cell finer random trees and exact comparison in their leaves give
every vector a first list of K neighbours. Then NN-descent: each round joins every vector's list with the vectors of its
neighbours, compares all neighbours of a vector with one another and merges what is found into the lists, until at most
``settle`` of the lists change. Two neighbours that both stood in the list the round before have been compared, so a round
compares only pairs with a new one, and fetches vectors only for lists that have gained one. The number of a vector holds its cell in the first tree, so a round works cell by cell: it
fetches only the vectors that lie in other cells, and each of them once per cell.

Where only near neighbours are asked for, lists hold no others: every two vectors of a cell are compared in each of more
trees, and vectors that are near to none so far take no part in the rounds.

``search`` answers further queries by greedy search over the finished graph.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize, release, small_side

#: Vectors the trees are fitted on; vectors per cell aimed at; vectors per leaf compared exactly.
SAMPLE, CELL, LEAF = 20_000, 2_000, 192
#: Trees across the cluster, finer trees inside each cell, neighbours kept per vector.
TREES, INNER, KEEP = 3, 3, 8
#: Where only near neighbours are asked for: trees across the cluster, vectors in which every two are compared and cells of them per task.
NEAR_TREES, WHOLE, NEAR_CELLS_PER_TASK = 6, 4_000, 32
#: There too: of the lists that have one, how many may still gain one, and rounds made unless none does.
NEAR_SETTLE, LOOK = 0.002, 3
#: For searches: neighbours kept per vector in the graph, and nodes a query holds on to.
WIDE, BEAM = 12, 160
SCALE = 32767.0
#: A list of neighbours is held as bytes: 64-bit numbers and 32-bit similarities, best first.
LISTS = "nid bigint, ids binary, sims binary"
CELLS_PER_TASK = 8


def unit(values: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the vectors that take part, and their unit vectors as int16; null, short, long, zero and non-finite ones don't."""
    n = np.asarray(values.value_lengths().fill_null(-1))
    rows = np.flatnonzero(n == dim)
    x = np.asarray(values.take(pa.array(rows)).flatten().fill_null(np.nan), dtype=np.float64).reshape(-1, dim)
    x[~np.isfinite(x).all(axis=1)] = 0
    peak = np.abs(x).max(axis=1, initial=0)
    fine = peak > 0
    x = x[fine] / peak[fine, None]
    return rows[fine], np.rint(x / np.linalg.norm(x, axis=1, keepdims=True) * SCALE).astype(np.int16)


def _bytes(codes: np.ndarray) -> pa.Array:
    size = codes.shape[1] * 2
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes).tobytes())]).cast(pa.binary())


def _floats(col: pa.Array, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return _items(col, np.int16)[0].reshape(-1, dim).astype(np.float32) / np.float32(SCALE)


def grow(x: np.ndarray, leaf: int, rng: np.random.Generator) -> tuple:
    """A random-projection tree (directions, thresholds, children, root); leaves are negative numbers -1, -2, ..."""
    dirs, cuts, kids, leaves = [], [], [], 0
    root, todo = [0], [(x, None, 0)]
    while todo:
        rows, parent, side = todo.pop()
        me = None
        for _ in range(3 if len(rows) > leaf else 0):
            i, j = rng.integers(len(rows), size=2)
            d = rows[i] - rows[j]
            p = rows @ d
            cut = np.median(p)
            right = p > cut
            if 0.1 * len(rows) <= right.sum() <= 0.9 * len(rows):
                me = len(dirs)
                dirs.append(d), cuts.append(cut), kids.append([0, 0])
                todo += [(rows[~right], me, 0), (rows[right], me, 1)]
                break
        if me is None:
            leaves += 1
            me = -leaves
        if parent is None:
            root[0] = me
        else:
            kids[parent][side] = me
    return np.array(dirs, dtype=np.float32).reshape(-1, x.shape[1]), cuts, kids, root[0]


def leaf_of(tree: tuple, x: np.ndarray) -> np.ndarray:
    dirs, cuts, kids, root = tree
    out, todo = np.zeros(len(x), dtype=np.int64), [(root, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if node < 0:
            out[rows] = -node - 1
        elif len(rows):
            right = x[rows] @ dirs[node] > cuts[node]
            todo += [(kids[node][0], rows[~right]), (kids[node][1], rows[right])]
    return out


def merge(nid: np.ndarray, ids: np.ndarray, sims: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of edges nid -> ids, the ``keep`` best different ones of each nid, in the order nid, similarity descending, id."""
    # the last bits of a similarity depend on how it was computed, so repeats are looked for by number
    o = np.lexsort((-sims, ids, nid))
    nid, ids, sims = nid[o], ids[o], sims[o]
    new = np.ones(len(nid), dtype=bool)
    new[1:] = (nid[1:] != nid[:-1]) | (ids[1:] != ids[:-1])
    nid, ids, sims = nid[new], ids[new], sims[new]
    o = np.lexsort((ids, -sims, nid))
    nid, ids, sims = nid[o], ids[o], sims[o]
    first = np.flatnonzero(np.r_[True, nid[1:] != nid[:-1]]) if len(nid) else np.empty(0, dtype=int)
    rank = np.arange(len(nid)) - np.repeat(first, np.diff(np.r_[first, len(nid)]))
    top = rank < keep
    return nid[top], ids[top], sims[top]


def _blobs(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that end at the given item numbers of data."""
    off = np.r_[0, ends].astype(np.int32) * data.dtype.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _items(col: pa.ChunkedArray | pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All items of binary values one after another, and how many each value has."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    off = np.frombuffer(col.buffers()[1], dtype=np.int32, count=col.offset + len(col) + 1)[col.offset :] if len(col) else np.zeros(1, dtype=np.int32)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8)[off[0] : off[-1]] if len(col) and off[-1] > off[0] else np.empty(0, dtype=np.uint8)
    return np.frombuffer(data.tobytes(), dtype=kind), np.diff(off) // np.dtype(kind).itemsize


def _lists(nid: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> pa.Table:
    """Edges sorted by nid as one row per nid."""
    first = np.flatnonzero(np.r_[True, nid[1:] != nid[:-1]]) if len(nid) else np.empty(0, dtype=int)
    ends = np.r_[first[1:], len(nid)] if len(nid) else first
    return pa.table({"nid": pa.array(nid[first], pa.int64()), "ids": _blobs(ids.astype(np.int64), ends), "sims": _blobs(sims.astype(np.float32), ends)})


def _edges(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, n = _items(t["ids"], np.int64)
    return np.repeat(np.asarray(t["nid"]), n), ids, _items(t["sims"], np.float32)[0]


def _last(t, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Number and last similarity of each list; -2 for lists that are not full."""
    values, size = _items(t["sims"], np.float32)
    return np.asarray(t["nid"]), np.where(size >= keep, np.r_[values, np.float32(-2)][np.cumsum(size) - 1], np.float32(-2)).astype(np.float32)


def by_cell(df: DataFrame, cell: str, run, cells: int, schema: str = LISTS, per_task: int = CELLS_PER_TASK) -> DataFrame:
    """Apply run to the rows of each cell as an Arrow table, several cells to a task; no sorting in the JVM."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        t = pa.Table.from_batches(got)
        c = np.asarray(t[cell])
        o = np.argsort(c, kind="stable")
        t = t.take(pa.array(o)).combine_chunks()
        cut = np.flatnonzero(np.diff(c[o])) + 1
        for x, y in zip(np.r_[0, cut], np.r_[cut, len(c)]):
            yield from run(t.slice(x, y - x)).to_batches()

    tasks = max(-(-cells // per_task), min(cells, df.sparkSession.sparkContext.defaultParallelism))
    return df.repartition(max(1, tasks), cell).mapInArrow(part, schema)


def leaf_neighbours(x: np.ndarray, keep: int, inner: int, leaf: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges between rows of x: the best in the leaves of several random trees, compared exactly."""
    out = []
    for _ in range(inner if len(x) > leaf else 1):
        at = leaf_of(grow(x, leaf, rng), x)
        order = np.argsort(at, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
            for part in range(0, len(rows), 2048):  # a leaf of vectors that nothing tells apart may be large
                mine = rows[part : part + 2048]
                s = x[mine] @ x[rows].T
                s[np.arange(len(mine)), part + np.arange(len(mine))] = -2
                k = min(keep, len(rows) - 1)
                if k > 0:
                    best = np.argpartition(-s, k - 1, axis=1)[:, :k]
                    out.append((np.repeat(mine, k), rows[best].ravel(), np.take_along_axis(s, best, 1).ravel()))
    if not out:
        return np.empty(0, dtype=int), np.empty(0, dtype=int), np.empty(0, dtype=np.float32)
    return merge(*(np.concatenate(c) for c in zip(*out)), keep)


def near_neighbours(x: np.ndarray, keep: int, least: float, rng: np.random.Generator, whole: int = WHOLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of at least ``least`` between rows of x, the ``keep`` best of each: all are compared, or those in the leaves of several random trees if there are more than ``whole``."""
    out = []
    for _ in range(INNER if len(x) > whole else 1):
        at = leaf_of(grow(x, whole, rng), x)
        order = np.argsort(at, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
            y, n = x[rows], len(rows)
            step = max(1, (1 << 20) // max(n, 1))
            for part in range(0, n, step):
                s = y[part : part + step] @ y.T
                s[np.arange(len(s)), part + np.arange(len(s))] = -2
                hit = np.flatnonzero(s.ravel() >= least)
                mine = hit // max(n, 1)
                many = np.flatnonzero(np.bincount(mine, minlength=len(s)) > 4 * keep)
                if len(many):  # among very many the best are picked row by row
                    best = np.argpartition(-s[many], keep - 1, axis=1)[:, :keep]
                    hit = np.concatenate([hit[~np.isin(mine, many)], (many[:, None] * n + best).ravel()])
                out.append((rows[part + hit // max(n, 1)], rows[hit % max(n, 1)], s.ravel()[hit]))
    return merge(*(np.concatenate(c) for c in zip(*out)), keep) if out else (np.empty(0, dtype=int), np.empty(0, dtype=int), np.empty(0, dtype=np.float32))


def local_join(own: np.ndarray, ids: np.ndarray, x: np.ndarray, at: np.ndarray, keep: int, fresh: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compare all neighbours of a vector, in both directions, with one another: new edges own -> ids.

    x holds the vectors whose sorted numbers are ``at``; edges to numbers not in ``at`` are left out. If ``fresh`` says which
    edges are new, pairs of two old ones are left out, as they have been compared before.
    """
    fresh = np.ones(len(own), dtype=bool) if fresh is None else fresh
    u, v = np.searchsorted(at, own), np.searchsorted(at, ids)
    fine = (v < len(at)) & (at[np.minimum(v, len(at) - 1)] == ids)
    u, v, fresh = u[fine], v[fine], fresh[fine]
    hub, leg, new = np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([fresh, fresh])
    # hubs without a new edge have nothing to compare
    busy = np.zeros(len(at), dtype=bool)
    busy[hub[new]] = True
    hub, leg, new = hub[busy[hub]], leg[busy[hub]], new[busy[hub]]
    # of two edges between the same vectors the old one comes first: the pairs of the leg have been compared
    o = np.lexsort((new, leg, hub))
    hub, leg, new = hub[o], leg[o], new[o]
    # two vectors that are in each other's lists are legs of one another once
    once = np.ones(len(hub), dtype=bool)
    once[1:] = (hub[1:] != hub[:-1]) | (leg[1:] != leg[:-1])
    hub, leg, new = hub[once], leg[once], new[once]
    first = np.flatnonzero(np.r_[True, hub[1:] != hub[:-1]]) if len(hub) else np.empty(0, dtype=int)
    size = np.diff(np.r_[first, len(hub)])
    # a vector that is in very many lists: of every one of them the best of all the others, block by block
    out = []
    for f, n in zip(first[size > 3 * keep], size[size > 3 * keep]):
        legs = leg[f : f + n]
        for part in range(0, n, 2048):
            mine, best, sims = legs[part : part + 2048], None, None
            for other in range(0, n, 8192):
                s = x[mine] @ x[legs[other : other + 8192]].T
                s[mine[:, None] == legs[other : other + 8192]] = -2
                c = min(keep, s.shape[1])
                at_best = np.argpartition(-s, c - 1, axis=1)[:, :c]
                found, near = legs[other + at_best], np.take_along_axis(s, at_best, 1)
                best, sims = (found, near) if best is None else (np.concatenate([best, found], axis=1), np.concatenate([sims, near], axis=1))
            got = sims.ravel() > -2
            out.append((np.repeat(mine, best.shape[1])[got], best.ravel()[got]))
    pairs = [np.minimum(a, b) * len(at) + np.maximum(a, b) for a, b in out]
    for n in np.unique(size[size <= 3 * keep]):
        if n > 1:
            block = leg[first[size == n][:, None] + np.arange(n)]
            i, j = np.triu_indices(n, 1)
            mark = new[first[size == n][:, None] + np.arange(n)]
            either = (mark[:, i] | mark[:, j]).ravel()
            a, b = block[:, i].ravel()[either], block[:, j].ravel()[either]
            pairs.append(np.minimum(a, b) * len(at) + np.maximum(a, b))
    key = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, dtype=np.int64)
    known = np.unique(np.minimum(u, v) * len(at) + np.maximum(u, v))
    key = key[~np.isin(key, known, assume_unique=True)]
    a, b = key // len(at), key % len(at)
    sims = np.concatenate([np.einsum("ij,ij->i", x[a[k : k + 500_000]], x[b[k : k + 500_000]]) for k in range(0, len(a), 500_000)] or [np.empty(0, dtype=np.float32)])
    same = a != b
    a, b, sims = a[same], b[same], sims[same]
    return merge(np.concatenate([at[a], at[b]]), np.concatenate([at[b], at[a]]), np.concatenate([sims, sims]), keep)


def _sweep(spark) -> None:
    """Let Spark delete the shuffle files of what has been written: it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def graph(df: DataFrame, id_col: str, vec_col: str, dim: int = 64, keep: int = KEEP, trees: int | None = None, rounds: int | None = None, settle: float = 0.02, seed: int = 7, least: float = -2.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, graph, copies) of the vectors that take part.

    nodes(nid, id, code): one row per different vector, ``id`` the smallest of its ids. graph(nid, ids, sims): its
    nearest different vectors, best first; ``rounds`` ends the descent before it has settled. If only neighbours of at
    least ``least`` are asked for, lists hold no others, and it has settled when none gains one, or when at most
    ``NEAR_SETTLE`` of them do after ``LOOK`` rounds. copies(id, rep): the ids with an equal vector of a smaller id. Null ids, null, all-zero, non-finite vectors and those of another length take no part; repeated rows count once.
    """
    spark = df.sparkSession
    near = least > -1
    trees = trees or (NEAR_TREES if near else TREES)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, codes = unit(b.column(1), dim)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), _bytes(codes)], ["id", "code"])

    raw = df.select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).cast("array<float>").alias("v")).where("id is not null and v is not null")
    flat = materialize(raw.mapInArrow(prepare, "id string, code binary").withColumn("h", F.xxhash64("code")), "p5v")
    n = flat.count()
    dups = materialize(flat.groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("h", "rep"), "p5d")
    few = small_side(dups)
    sample = flat.select("code").sample(min(1.0, 1.1 * SAMPLE / max(n, 1)), seed).limit(SAMPLE).toArrow()["code"]
    pool = _floats(sample.combine_chunks(), dim) if len(sample) else np.zeros((0, dim), dtype=np.float32)
    rng = np.random.default_rng(seed)
    per = max(8, int(CELL * len(pool) / max(n, 1)))
    forest = spark.sparkContext.broadcast([grow(pool, per, rng) for _ in range(trees)])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for b in batches:
            cell = leaf_of(forest.value[0], _floats(b.column(1), dim))
            nid = (cell << 48) | (part << 28) | (k + np.arange(len(cell)))
            k += len(cell)
            yield pa.RecordBatch.from_arrays([pa.array(nid, pa.int64()), b.column(0), b.column(1)], ["nid", "id", "code"])

    # a repeated row of the smallest id is one more copy of the vector: the id is kept once
    one = flat.join(few, "h", "left").where("rep is null or rep = id")
    twice = one.where("rep is not null").dropDuplicates(["h"]).select("id", "code")
    nodes = materialize(one.where("rep is null").select("id", "code").unionByName(twice).mapInArrow(number, "nid bigint, id string, code binary"), "p5n")
    copies = materialize(flat.select("id", "h").join(few, "h").where("id <> rep").select("id", "rep").distinct(), "p5c")
    release(flat)
    release(dups)
    _sweep(spark)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _floats(b.column(1), dim)
            for t, tree in enumerate(forest.value):
                cell = leaf_of(tree, x) if t else np.asarray(b.column(0)) >> 48
                yield pa.RecordBatch.from_arrays([pa.array(t * (1 << 16) + cell, pa.int64()), b.column(0), b.column(1)], ["cell", "nid", "code"])

    def first(t: pa.Table) -> pa.Table:
        nid = np.asarray(t["nid"])
        x, rng = _floats(t["code"], dim), np.random.default_rng(seed)
        a, b, s = near_neighbours(x, keep, least, rng) if near else leaf_neighbours(x, keep, INNER, LEAF, rng)
        return _lists(nid[a], nid[b], s)

    def merged(t: pa.Table) -> pa.Table:
        return _lists(*merge(*_edges(t), keep))

    def renewed(t: pa.Table) -> pa.Table:
        """Merged lists, and whether each has gained a neighbour."""
        old = np.repeat(np.asarray(t["old"]), _items(t["ids"], np.int64)[1])
        edges = _edges(t)
        top = merge(*edges, keep)
        known = set(zip(edges[0][old].tolist(), edges[1][old].tolist()))
        fresh = np.array([(a, b) not in known for a, b in zip(top[0].tolist(), top[1].tolist())], dtype=np.uint8)
        lists = _lists(*top)
        ends = np.cumsum(_items(lists["ids"], np.int64)[1])
        moved = np.add.reduceat(fresh, np.r_[0, ends[:-1]], dtype=np.int64) > 0 if len(ends) else np.empty(0, dtype=bool)
        return lists.append_column("fresh", _blobs(fresh, ends)).append_column("moved", pa.array(moved, pa.bool_()))

    cell = F.shiftrightunsigned("nid", 48)
    cells = max(1, n // CELL)
    lists = by_cell(nodes.select("nid", "code").mapInArrow(spread, "cell bigint, nid bigint, code binary"), "cell", first, trees * cells, per_task=NEAR_CELLS_PER_TASK if near else CELLS_PER_TASK)
    g = materialize(by_cell(lists.withColumn("c", cell), "c", merged, cells).withColumn("fresh", F.lit(None).cast("binary")).withColumn("moved", F.lit(True)), "p5g")
    # who is near to someone has a list of its own
    met = materialize(nodes.select("nid", "code").join(g.select("nid"), "nid", "left_semi"), "p5k") if near else nodes
    _sweep(spark)

    def outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The neighbours of a batch that lie in other cells, each once per cell."""
        for b in batches:
            nid, ids, _ = _edges(b)
            c = nid >> 48
            far = (ids >> 48) != c
            pair = np.unique(np.stack([c[far], ids[far]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0], pa.int64()), pa.array(pair[1], pa.int64())], ["c", "nid"])

    def descend(t: pa.Table) -> pa.Table:
        """Rows of one cell: its vectors (kind 0), fetched ones (1) and its lists (2). Gives lists of new edges."""
        kind = np.asarray(t["kind"])
        have, own = t.filter(pa.array(kind < 2)).select(["nid", "code"]).combine_chunks(), t.filter(pa.array(kind == 2)).select(["nid", "ids", "sims", "fresh"]).combine_chunks()
        at = np.asarray(have["nid"])
        o = np.argsort(at, kind="stable")
        x, at = _floats(have["code"], dim)[o] if len(at) else np.zeros((0, dim), np.float32), at[o]
        # in the first round all edges are new
        fresh = None if own["fresh"].null_count else _items(own["fresh"], np.uint8)[0] > 0
        a, b, s = local_join(*_edges(own)[:2], x, at, keep, fresh)
        # what is no better than the last of a full list is of no use to it, be the vector of this cell or a fetched one
        far = t.filter(pa.array(kind == 1))
        mine, worst = (np.concatenate(x) for x in zip(_last(own, keep), (np.asarray(far["nid"]), np.asarray(far["worst"], dtype=np.float32))))
        o = np.argsort(mine)
        p = np.minimum(np.searchsorted(mine[o], a), max(len(mine) - 1, 0))
        better = np.ones(len(a), dtype=bool) if not len(mine) else (mine[o][p] != a) | (s > worst[o][p])
        better &= s >= least
        return _lists(a[better], b[better], s[better])

    done = 0
    while rounds is None or done < rounds:
        done += 1
        last = g.select("nid", "ids", "sims").mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(w, pa.float32())], ["nid", "worst"]) for n, w in (_last(b, keep) for b in bs)), "nid bigint, worst float")
        fetch = g.where("moved").select("nid", "ids", "sims").mapInArrow(outside, "c bigint, nid bigint").distinct().join(met.select("nid", "code"), "nid").join(last, "nid", "left").fillna(-2.0, ["worst"])
        none, no = F.lit(None).cast("binary"), F.lit(None).cast("float").alias("worst")
        rows = (
            met.select(cell.alias("c"), "nid", F.lit(0).alias("kind"), "code", none.alias("ids"), none.alias("sims"), none.alias("fresh"), no)
            .unionByName(fetch.select("c", "nid", F.lit(1).alias("kind"), "code", none.alias("ids"), none.alias("sims"), none.alias("fresh"), "worst"))
            .unionByName(g.select(cell.alias("c"), "nid", F.lit(2).alias("kind"), none.alias("code"), "ids", "sims", "fresh", no))
        )
        new = materialize(by_cell(rows, "c", descend, cells), "p5u")
        both = g.select("nid", "ids", "sims", F.lit(True).alias("old")).unionByName(new.withColumn("old", F.lit(False)))
        after = materialize(by_cell(both.withColumn("c", cell), "c", renewed, cells, LISTS + ", fresh binary, moved boolean"), "p5g")
        changed, lists = after.agg(F.count_if("moved"), F.count("*")).first()
        release(g)
        release(new)
        g, fetch, rows, both = after, None, None, None
        _sweep(spark)
        if changed <= (min(settle, 0) if near else settle) * lists or (near and done >= LOOK and changed <= NEAR_SETTLE * lists):
            break
    if near:
        release(met)
    lists = g.select("nid", "ids", "sims")
    lists._warploom_path = g._warploom_path
    return nodes, lists, copies


def near_pairs(df: DataFrame, id_col: str, vec_col: str, k: int = 5, least: float = 0.9, **options) -> DataFrame:
    """(id1, id2), id1 < id2: pairs of cosine at least ``least`` of which one is among the k most similar of the other.

    Among equally similar vectors those of the smallest ids come first. Equal vectors have cosine 1.
    """
    nodes, g, copies = graph(df, id_col, vec_col, keep=max(KEEP, k + 1), **{"least": least - 1e-5} | options)
    names = nodes.select("nid", "id")
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nid, ids, sims = _edges(b)
            n = _items(b["ids"], np.int64)[1]
            rank = np.arange(len(nid)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n) if len(n) else np.empty(0, dtype=int)
            top = (rank < k) & (sims >= least - 1e-5)
            yield pa.RecordBatch.from_arrays([pa.array(nid[top], pa.int64()), pa.array(ids[top], pa.int64()), pa.array(rank[top], pa.int32())], ["nid", "other", "rank"])

    e = g.mapInArrow(near, "nid bigint, other bigint, rank int")
    e = materialize(e, "p5e")
    met = names.join(e.select("nid").unionByName(e.select(F.col("other").alias("nid"))).distinct(), "nid")
    met = materialize(met, "p5m")
    own = met.join(e, "nid").select("id", "other", "rank").join(met.select(F.col("nid").alias("other"), F.col("id").alias("oid")), "other").select("id", "oid", "rank")
    own = materialize(own, "p5o")
    # the k + 1 smallest ids of each set of equal vectors are all that anyone's first k can hold of it
    w = Window.partitionBy("rep").orderBy("id")
    firsts = copies.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("more"))
    firsts = materialize(firsts.select("rep", F.concat(F.array("rep"), "more").alias("set")), "p5f")
    # vectors that are in a set of equals, or next to one: fill up the k places with equals first, then with sets by rank
    members = copies.unionByName(firsts.select(F.col("rep").alias("id"), "rep"))
    touched = own.join(firsts.select(F.col("rep").alias("oid"), "set"), "oid", "left")
    sets = own.select("id").distinct().unionByName(firsts.select(F.col("rep").alias("id"))).distinct().join(firsts.select(F.col("rep").alias("id"), F.col("set").alias("own")), "id", "left")
    others = touched.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", F.coalesce("set", F.array("oid")).alias("set")))).alias("o"))
    ranked = sets.join(others, "id", "left").select("id", F.coalesce("own", F.array("id")).alias("own"), F.coalesce(F.flatten(F.transform("o", lambda s: F.slice(s["set"], 1, k))), F.array().cast("array<string>")).alias("rest"))
    hard = materialize(firsts.select(F.col("rep").alias("id")).unionByName(touched.where("set is not null").select("id")).distinct(), "p5h")
    ranked = ranked.join(hard, "id", "left_semi")
    mine = members.unionByName(hard.join(firsts.select(F.col("rep").alias("id")), "id", "left_anti").select("id", F.col("id").alias("rep")))
    full = mine.join(ranked.select(F.col("id").alias("rep"), "own", "rest"), "rep").select("id", F.explode(F.slice(F.concat(F.array_remove("own", F.col("id")), "rest"), 1, k)).alias("oid"))
    easy = own.join(hard, "id", "left_anti").select("id", "oid")
    both = easy.unionByName(full)
    out = materialize(both.select(F.least("id", "oid").alias("id1"), F.greatest("id", "oid").alias("id2")).where("id1 < id2").distinct(), "p5o")
    for t in (nodes, g, copies, firsts, e, met, own, hard):
        release(t)
    _sweep(df.sparkSession)
    return out


def search(queries: DataFrame, nodes: DataFrame, g: DataFrame, k: int = 5, beam: int = BEAM, dim: int = 64, seed: int = 7) -> DataFrame:
    """(qid, id, sim): for each row (qid, code) of queries its k most similar nodes, found by greedy search over the graph.

    Each query starts from a stated sample of entry nodes and moves on to the neighbours of its ``beam`` best nodes until
    no query gains any; distances are only computed to the nodes it meets.
    """
    spark = queries.sparkSession
    n = max(1, nodes.count())
    entries = nodes.select("nid", "code").sample(min(1.0, 1.2 * 2048 / n), seed).limit(2048).toArrow()
    start = spark.sparkContext.broadcast((np.asarray(entries["nid"]), _floats(entries["code"], dim)))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nid, x = start.value
        for b in batches:
            s = _floats(b.column(1), dim) @ x.T
            m = min(beam, len(nid))
            best = np.argsort(-s, axis=1, kind="stable")[:, :m]
            q = b.column(0).take(pa.array(np.repeat(np.arange(len(s)), m)))
            yield pa.RecordBatch.from_arrays([q, pa.array(nid[best].ravel(), pa.int64()), pa.array(np.take_along_axis(s, best, 1).ravel().astype(np.float32))], ["qid", "nid", "sim"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.einsum("ij,ij->i", _floats(b.column(2), dim), _floats(b.column(3), dim))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s.astype(np.float32))], ["qid", "nid", "sim"])

    out = "qid string, nid bigint, sim float"
    w = Window.partitionBy("qid").orderBy(F.desc("sim"), "nid")
    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nid, ids, _ = _edges(b)
            # edges are walked both ways
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[nid, ids], pa.int64()), pa.array(np.r_[ids, nid], pa.int64())], ["nid", "to"])

    hop = materialize(g.mapInArrow(spell, "nid bigint, to bigint").distinct(), "p5h")
    best = materialize(queries.select("qid", "code").mapInArrow(enter, out).withColumn("open", F.lit(True)), "p5s")
    while True:  # ends, as a list only ever gains nearer nodes
        step = best.where("open").join(hop, "nid").select("qid", F.col("to").alias("nid")).distinct().join(best.select("qid", "nid"), ["qid", "nid"], "left_anti")
        new = step.join(nodes.select("nid", F.col("code").alias("c2")), "nid").join(queries.select("qid", F.col("code").alias("c1")), "qid").select("qid", "nid", "c1", "c2").mapInArrow(score, out)
        both = best.withColumn("open", F.lit(False)).unionByName(new.withColumn("open", F.lit(True)))
        after = materialize(both.withColumn("r", F.row_number().over(w)).where(F.col("r") <= beam).drop("r"), "p5s")
        release(best)
        best = after
        if best.where("open").isEmpty():
            break
    top = best.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return top.join(nodes.select("nid", "id"), "nid").select("qid", "id", "sim")


TABLES = (("entity_embeddings", "eid"), ("sentence_embeddings", "sid"))


def found(spark, d: str) -> DataFrame:
    parts = [near_pairs(spark.read.parquet(f"{d}/{t}.parquet"), i, "embedding").select(F.lit(t).alias("vec_table"), "id1", "id2") for t, i in TABLES]
    return parts[0].unionByName(parts[1])


def answers(df: DataFrame, id_col: str, vec_col: str, asked: F.Column, k: int = 5, **options) -> DataFrame:
    """(qid, id, sim): the k most similar other vectors of every vector for whose ``id`` the condition asked holds.

    Found by greedy search over the graph of different vectors; equal vectors are put back on both sides: every asked id
    is a query, and of a set of equals the smallest ids come first.
    """
    nodes, g, copies = graph(df, id_col, vec_col, keep=WIDE, **options)
    alike = nodes.select("id", F.col("id").alias("rep")).unionByName(copies)
    who = materialize(alike.where(asked).select(F.col("id").alias("qid"), "rep"), "p5w")
    q = materialize(who.select(F.col("rep").alias("id")).distinct().join(nodes, "id").select(F.col("id").alias("qid"), "code"), "p5q")
    hits = materialize(search(q, nodes, g, k=k + 1).select(F.col("qid").alias("rep"), F.col("id").alias("node"), "sim"), "p5r")
    # of a set of equals nobody's first k hold more than the k + 1 smallest ids
    w = Window.partitionBy("rep").orderBy("id")
    few = alike.join(hits.select(F.col("node").alias("rep")).distinct(), "rep", "left_semi").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    every = who.join(hits, "rep").join(few.select(F.col("rep").alias("node"), "id"), "node").where("qid <> id").select("qid", "id", "sim")
    top = Window.partitionBy("qid").orderBy(F.desc("sim"), "id")
    return every.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).select("qid", "id", "sim")


def searched(spark, d: str) -> DataFrame:
    """Vectors of both tables whose number is divisible by 100 as queries against all vectors of their table."""
    asked = F.regexp_extract("id", r"(\d+)$", 1).cast("bigint") % 100 == 0
    parts = [answers(spark.read.parquet(f"{d}/{t}.parquet"), i, "embedding", asked).select(F.lit(t).alias("vec_table"), "qid", "id", "sim") for t, i in TABLES]
    return parts[0].unionByName(parts[1])
