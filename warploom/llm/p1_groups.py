"""Problem 1: consolidating pairwise matches into groups.

Method: a two-dimensional grid. Vertices are hashed into B blocks, the links between block i and block j form the grid
cell (i, j), and a union-find runs inside every cell on its own. Each vertex then has one representative per cell of its
row and column; exchanging them gives the vertex its parent (the smallest) and links the other representatives to that
parent. The links among representatives are the next, smaller graph. It ends when no vertex has two representatives.

A vertex with very many links is spread over all cells of its row and column. A cell that is still larger than
``cell_edges`` is split by a hash of the link: union-find on any subset of links is right, it only leaves more
representatives to exchange. So no task ever holds more than about ``cell_edges`` links.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release, salted_join

CELL_EDGES = 200_000


def local_groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over links a[i]-b[i]; returns the distinct vertices and the smallest vertex of the group of each."""
    ids, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    parent = list(range(len(ids)))

    def find(v: int) -> int:
        root = v
        while parent[root] != root:
            root = parent[root]
        while parent[v] != root:
            parent[v], v = root, parent[v]
        return root

    for u, w in zip(x.tolist(), y.tolist()):
        u, w = find(u), find(w)
        if u != w:
            parent[max(u, w)] = min(u, w)
    return ids, ids[[find(v) for v in range(len(ids))]]


def _cell(pdf: pd.DataFrame) -> pd.DataFrame:
    v, rep = local_groups(pdf["a"].to_numpy(dtype=object).astype(str).astype(object), pdf["b"].to_numpy(dtype=object))
    return pd.DataFrame({"v": v, "rep": rep})


def group_links(links: DataFrame, a: str = "a", b: str = "b", cell_edges: int = CELL_EDGES) -> DataFrame:
    """(id, group_id): every id that has a link to another id, and the smallest id reachable from it.

    ``links`` has two string columns; other columns are ignored. Links with a null end and links of an id with itself
    take no part, repeated and reversed links count once, an empty table gives an empty result.
    """
    spark = links.sparkSession
    e = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("a < b")
    cur = materialize(e.distinct(), "p1e")
    parents: list[DataFrame] = []
    while (n := cur.count()) > 0:
        blocks = max(1, math.ceil(math.sqrt(2 * n / cell_edges)))
        block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
        cells = cur.withColumns({"i": F.least(block("a"), block("b")), "j": F.greatest(block("a"), block("b"))})
        salts = F.lit(1)
        if blocks > 1:
            over = [r for r in cells.groupBy("i", "j").count().where(F.col("count") > 2 * cell_edges).collect()]  # at most n / (2 cell_edges) rows
            for r in over:
                salts = F.when((F.col("i") == r.i) & (F.col("j") == r.j), F.lit(math.ceil(r["count"] / cell_edges))).otherwise(salts)
        stars = cells.withColumn("s", F.pmod(F.xxhash64("b", "a"), salts).cast("int")).groupBy("i", "j", "s").applyInPandas(_cell, "v string, rep string")
        exchange = stars.groupBy("v").agg(F.min("rep").alias("p"), F.collect_set("rep").alias("reps"))
        step = materialize(exchange.select("v", "p", F.array_remove("reps", F.col("p")).alias("others")), "p1s")
        release(cur)
        nxt = step.where(F.size("others") > 0).select("p", F.explode("others").alias("o"))
        cur = materialize(nxt.select(F.col("p").alias("a"), F.col("o").alias("b")).distinct(), "p1e")
        parents.append(step.select("v", "p"))
    release(cur)
    if not parents:
        return spark.createDataFrame([], "id string, group_id string")
    top = parents.pop()
    while parents:
        low = parents.pop()
        up = top.select(F.col("v").alias("p"), F.col("p").alias("q"))
        top = salted_join(low, up, "p", "left", salt_by="v").select("v", F.coalesce("q", "p").alias("p"))
    return top.select(F.col("v").alias("id"), F.col("p").alias("group_id"))


def _clean(c) -> F.Column:
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def entity_links(pairs: DataFrame, lists: DataFrame, entities: DataFrame, anchors: DataFrame, hot: int = 50_000) -> DataFrame:
    """(a, b): the distinct links of both match tables between two different known ids, a < b.

    Ids count after trimming and lower-casing; links with null, unknown or equal ids are left out, whatever their score.
    Ids with more than ``hot`` links and more than a two-hundredth of all are at most 400: those among them that are known
    go into the plan as literals. All other ids are checked by a semi-join.
    """
    raw = pairs.select(_clean(F.col("eid1")).alias("x"), _clean(F.col("eid2")).alias("y")).unionByName(
        lists.select("eid", F.explode("similar_entities").alias("s")).select(_clean(F.col("eid")).alias("x"), _clean(F.col("s.eid")).alias("y"))
    )
    e = raw.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("x is not null and y is not null and x <> y").distinct()
    e = materialize(e, "p1raw")
    known = entities.select(_clean(F.col("eid")).alias("k")).unionByName(anchors.select(_clean(F.col("eid")).alias("k"))).where("k is not null").distinct()
    least = max(hot, e.count() // 200)
    many = e.select(F.col("a").alias("k")).unionByName(e.select(F.col("b").alias("k"))).groupBy("k").count().where(F.col("count") > least).select("k")
    top = sorted(r.k for r in many.collect())  # at most 400: an edge has two ends
    fine = sorted(r.k for r in known.where(F.col("k").isin(top)).collect()) if top else []
    for c in ("a", "b"):
        rest = e.where(~F.col(c).isin(top)).join(known.select(F.col("k").alias(c)), c, "left_semi")
        e = e.where(F.col(c).isin(fine)).unionByName(rest.select(*e.columns)) if top else rest
    return e.select("a", "b")


def found(spark, d: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    links = entity_links(read("entity_to_synonym_entities"), read("entity_to_similar_entities"), read("entity_store"), read("anchor_entities"))
    return group_links(links).select(F.col("id").alias("eid"), F.col("group_id").alias("group_eid"))


def group_sizes(spark, d: str) -> DataFrame:
    """How many groups there are of each size."""
    return found(spark, d).groupBy("group_eid").agg(F.count("*").alias("members")).groupBy("members").agg(F.count("*").alias("groups"))
