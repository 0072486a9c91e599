"""Problem 7: filling fixed-capacity containers with items.

Method: cost-balanced packing. A document of n tokens costs n + n * n / SQUARE (linear work plus attention). Documents go
in descending order of their size to the sequence (container) of the lowest cost that still has room; a new container is
opened only if none has room. The least containers that could hold all tokens are open from the start, so their costs
stay balanced. Then the emptiest containers are dissolved as long as all their documents fit elsewhere, and while there are
more containers than the tokens need, those with most room are packed anew by best fit.

A text longer than the capacity is cut into full containers and a rest that is packed like a document; every other
text stays whole. Packing runs on shards of about ``shard_docs`` documents chosen by a hash of their id, each profile by
itself: a shard wastes at most about one container, and no task grows with the corpus.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import n_tokens

SQUARE = 1024.0
SHARD_DOCS = 4_000


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, numbered from 0; sizes are from 1 to capacity."""
    order = np.argsort(-sizes, kind="stable")
    least = int(-(-int(sizes.sum()) // capacity)) if len(sizes) else 0
    cost, room = np.zeros(max(16, 2 * least)), np.zeros(max(16, 2 * least), dtype=np.int64)
    room[:least] = capacity
    n, where = least, np.empty(len(sizes), dtype=np.int64)
    for i in order:
        s = int(sizes[i])
        own = np.where(room[:n] >= s, cost[:n], np.inf)
        k = int(own.argmin()) if n else -1
        if k < 0 or own[k] == np.inf:
            if n == len(room):
                cost, room = np.concatenate([cost, np.zeros(n)]), np.concatenate([room, np.zeros(n, dtype=np.int64)])
            k, room[n], n = n, capacity, n + 1
        where[i], room[k], cost[k] = k, room[k] - s, cost[k] + s + s * s / SQUARE
    where = _dissolve(sizes, where, room[:n].copy(), capacity)
    return _repack(sizes, where, capacity, least)


def _dissolve(sizes: np.ndarray, where: np.ndarray, room: np.ndarray, capacity: int) -> np.ndarray:
    """Empties containers, those with most room first, while their items fit into the others by best fit."""
    own: dict[int, list[int]] = {}
    for i, k in enumerate(where.tolist()):
        own.setdefault(k, []).append(i)
    free = sorted((int(room[k]), k) for k in own)
    for k in sorted(own, key=lambda k: (-room[k], k)):
        used = capacity - int(room[k])
        if sum(r for r, _ in free) - int(room[k]) < used:
            break
        trial = [x for x in free if x[1] != k]
        moved = []
        for i in sorted(own[k], key=lambda i: (-sizes[i], i)):
            p = bisect_left(trial, (int(sizes[i]), -1))
            if p == len(trial):
                break
            r, to = trial.pop(p)
            insort(trial, (r - int(sizes[i]), to))
            moved.append((i, to))
        if len(moved) == len(own[k]):
            for i, to in moved:
                where[i] = to
                own[to].append(i)
                room[to] -= sizes[i]
            own[k], room[k], free = [], capacity, trial
        elif len(moved) == 0:
            break
    return np.unique(where, return_inverse=True)[1] if len(where) else where


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Container of each item: by descending size into the fullest one that has room."""
    free: list[tuple[int, int]] = []
    where, n = [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        p = bisect_left(free, (sizes[i], -1))
        if p < len(free):
            r, k = free.pop(p)
        else:
            r, k, n = capacity, n, n + 1
        insort(free, (r - sizes[i], k))
        where[i] = k
    return where


def _repack(sizes: np.ndarray, where: np.ndarray, capacity: int, least: int) -> np.ndarray:
    """While there are more containers than needed: packs the items of those with most room anew by best fit, of more and
    more of them until some become free. Only what is packed anew loses the balance of costs."""
    take = 0
    while len(where):
        load = np.bincount(where, sizes)
        extra = len(load) - least
        take = max(8, 4 * extra, take)
        if extra <= 0 or take > 2 * len(load):
            break
        some = np.argsort(load, kind="stable")[:take]
        rows = np.flatnonzero(np.isin(where, some))
        new = np.array(best_fit(sizes[rows].tolist(), capacity))
        if new.max() + 1 < len(some):
            where = where.copy()
            where[rows] = some[new]
            where = np.unique(where, return_inverse=True)[1]
        else:
            take *= 2
    return where


SCHEMA = "profile string, shard int, container int, doc_id bigint, part int, tokens int, capacity int"


def place(docs: DataFrame, containers: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_docs: int = SHARD_DOCS, size: str | None = None) -> DataFrame:
    """Where each text goes, for each profile: one row per text, or several parts of a text longer than the capacity.

    Sizes are the tokens of the text, or the column ``size``. Null and empty texts and texts without a token need no
    room and get no row. Profiles without a positive capacity are left out; repeated profile rows count once. A row per
    document id is expected: of repeated ids each row is placed.
    """
    sized = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), (F.col(size) if size else n_tokens(text)).cast("int").alias("tokens")).where("tokens > 0")
    caps = containers.select("profile", F.col("capacity").cast("int").alias("capacity")).where("profile is not null and capacity > 0").distinct()
    shards = max(1, -(-docs.count() // shard_docs))
    # every document once per profile: a small, stated set of container sizes, joined to narrow rows
    profiles = F.array(*[F.struct(F.lit(r.profile).alias("profile"), F.lit(r.capacity).alias("capacity")) for r in caps.orderBy("profile", "capacity").limit(1000).collect()])
    rows = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).select("doc_id", "tokens", "shard", F.explode(profiles).alias("p")).select("doc_id", "tokens", "shard", "p.*")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "tokens"], ignore_index=True)
        cap, tok = int(key[2]), pdf["tokens"].to_numpy()
        full, rest = tok // cap, tok % cap
        rest, full = np.where((rest == 0) & (full > 0), cap, rest), np.where((rest == 0) & (full > 0), full - 1, full)
        where = pack(rest, cap)
        first = int(where.max()) + 1 if len(where) else 0
        cut = np.repeat(np.arange(len(tok)), full)
        part = np.concatenate([np.arange(n) for n in full]) if len(cut) else np.empty(0, dtype=int)
        return pd.DataFrame(
            {
                "profile": key[0],
                "shard": int(key[1]),
                "container": np.concatenate([where, first + np.arange(len(cut))]).astype("int32"),
                "doc_id": np.concatenate([pdf["doc_id"].to_numpy(), pdf["doc_id"].to_numpy()[cut]]),
                "part": np.concatenate([full, part]).astype("int32"),
                "tokens": np.concatenate([rest, np.full(len(cut), cap)]).astype("int32"),
                "capacity": cap,
            }
        )

    return rows.groupBy("profile", "shard", "capacity").applyInPandas(run, SCHEMA)


def placement(spark, d: str) -> DataFrame:
    return place(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/container_limits.parquet"))


def fill(spark, d: str) -> DataFrame:
    """Per profile: containers, tokens, the least containers that could hold them, and the share of space left."""
    p = placement(spark, d).groupBy("profile", "capacity").agg(F.countDistinct("shard", "container").alias("containers"), F.sum("tokens").alias("tokens"))
    return p.withColumns({"least": F.ceil(F.col("tokens") / F.col("capacity")), "left": 1 - F.col("tokens") / (F.col("containers") * F.col("capacity"))})


def tokens_placed(spark, d: str) -> DataFrame:
    """Per document: how many tokens each profile has placed."""
    return placement(spark, d).groupBy("doc_id", "profile").agg(F.sum("tokens").cast("bigint").alias("tokens"))


_TOK = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{1C}-\x{1F}\x{85}\p{Z}]"
TOKENS_SQL = f"""
SELECT d.doc_id, c.profile, d.n AS tokens
FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, '{_TOK}')) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL) d,
     (SELECT DISTINCT profile FROM container_limits WHERE profile IS NOT NULL AND capacity > 0) c
WHERE d.n > 0
"""
