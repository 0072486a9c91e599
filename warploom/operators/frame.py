"""Operators on batches held as DataFrames: rows have an order column, tensors are arrays or long rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pop(df: DataFrame, columns: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """Split off columns: (the rest, key and columns)."""
    return df.drop(*[c for c in columns if c != key]), df.select(key, *[c for c in columns if c != key])


def union_columns(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Join two batches of the same rows side by side; rows whose shared columns differ raise an error."""
    shared = [c for c in b.columns if c in a.columns and c != key]
    r = b.select(F.col(key), *[F.col(c).alias(f"_r_{c}") for c in shared], *[c for c in b.columns if c not in a.columns])
    out = a.join(r, key)
    for c in shared:
        out = out.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"_r_{c}")), F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs")).cast(dict(a.dtypes)[c])))
    return out.drop(*[f"_r_{c}" for c in shared])


def repeat(df: DataFrame, n: int, order: str, interleave: bool = True) -> DataFrame:
    """Every row n times, with its copy number ``rep`` and its new place ``pos`` (n * order + rep, or tiles one after another)."""
    out = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n > 0 else df.withColumn("rep", F.lit(0)).limit(0)
    if interleave:
        return out.withColumn("pos", F.col(order) * n + F.col("rep"))
    return out.withColumn("pos", F.col(order) + F.col("rep") * F.lit(df.count()))


def numbered(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """Consecutive numbers from 0 in the given order without one task holding all rows.

    Range-partitioned by the order, numbered inside each partition and shifted by the rows of those before; the counts
    collected are one per partition. Rows of equal order columns are numbered in any order.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_p", F.spark_partition_id())
    w = Window.partitionBy("_p").orderBy(*order)
    rows = ranged.withColumn("_k", F.row_number().over(w) - 1)
    counts = rows.groupBy("_p").count()
    before = counts.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    return rows.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_k")).drop("_p", "_k", "_before")


def chunk(df: DataFrame, n: int, row: str, total: int | None = None) -> DataFrame:
    """Number of the equal part each row falls into; the rows must divide evenly, as a DataProto-like batch demands."""
    total = df.count() if total is None else total
    if total % n:
        raise ValueError(f"{total} rows do not divide into {n} parts")
    return df.withColumn("part", F.floor(F.col(row) / F.lit(max(1, total // n))))


def pad_to_divisor(df: DataFrame, n: int, row: str) -> DataFrame:
    """Rows copied from the head until their number divides by n, marked ``is_pad``."""
    total = df.count()
    lack = -total % n
    out = df.withColumn("is_pad", F.lit(False))
    done = 0
    while done < lack and total:
        take = min(total, lack - done)
        out = out.unionByName(df.where(F.col(row) < take).withColumns({row: F.col(row) + F.lit(total + done), "is_pad": F.lit(True)}))
        done += take
    return out


def unpad(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_pad")).drop("is_pad")


def reorder(df: DataFrame, permutation: DataFrame, row: str) -> DataFrame:
    """Rows in the order of permutation(pos, row): row ids become positions."""
    return df.join(permutation.select(F.col("src").alias(row), F.col("pos").alias("_pos")), row).drop(row).withColumnRenamed("_pos", row)


def fold_rows(df: DataFrame, k: int, row: str, value: str) -> DataFrame:
    """k neighbouring rows as one, their values in order."""
    return df.groupBy(F.floor(F.col(row) / k).alias(row)).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(row).alias("r"), F.col(value).alias("v")))), lambda x: x["v"]).alias(value))


# --- arrays ---


def pad_array(a: Column, length: int, value, left: bool = False) -> Column:
    """An array filled up to length; longer ones stay."""
    fill = F.array_repeat(F.lit(value), F.greatest(F.lit(length) - F.size(a), F.lit(0)))
    return F.concat(fill, a) if left else F.concat(a, fill)


def fit_array(a: Column, length: int, value, truncate: str = "right", left: bool = True) -> Column:
    """An array padded or cut to length. truncate: which side is cut off; ``error`` refuses longer arrays."""
    long = F.size(a) > length
    cut = F.slice(a, -length, length) if truncate == "left" else F.slice(a, 1, length)
    if truncate == "error":
        cut = F.raise_error(F.lit("array too long")).cast("array<bigint>")
    return F.when(long, cut).otherwise(pad_array(a, length, value, left))


def gather_pads(a: Column, pad, left: bool = True) -> Column:
    """Padding moved to one side, everything else in order."""
    p, rest = F.filter(a, lambda x: x == pad), F.filter(a, lambda x: x != pad)
    return F.concat(p, rest) if left else F.concat(rest, p)


def attention_mask(a: Column, pad) -> Column:
    return F.transform(a, lambda x: (x != pad).cast("int"))


def position_ids(mask: Column) -> Column:
    """Running number of the attended places, from 0; 0 before the first."""
    run = F.transform(F.sequence(F.lit(1), F.size(mask)), lambda k: F.greatest(F.aggregate(F.slice(mask, F.lit(1), k), F.lit(0), lambda s, x: s + x) - 1, F.lit(0)))
    return F.when(F.size(mask) > 0, run).otherwise(F.array().cast("array<int>"))


def eos_mask(tokens: Column, eos) -> Column:
    """1 up to and with the first end token, 0 after it."""
    first = F.array_position(tokens, F.lit(eos))
    return F.when(F.size(tokens) > 0, F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda k: ((first == 0) | (k <= first)).cast("int"))).otherwise(F.array().cast("array<int>"))


def find_subsequence(a: Column, needle: list) -> Column:
    """Starts (from 0) of all places where needle stands in an array."""
    n = len(needle)
    want = F.array(*[F.lit(x) for x in needle])
    return F.when(F.size(a) >= n, F.filter(F.sequence(F.lit(0), F.size(a) - n), lambda k: F.slice(a, k + 1, n) == want)).otherwise(F.array().cast("array<int>"))


# --- balancing ---


def greedy_partitions(sizes: list[int], k: int) -> list[list[int]]:
    """Items by descending size, each to the part with the least total (and lowest number)."""
    import heapq

    heap, parts = [(0, p) for p in range(k)], [[] for _ in range(k)]
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        total, p = heapq.heappop(heap)
        parts[p].append(i)
        heapq.heappush(heap, (total + sizes[i], p))
    return [sorted(p) for p in parts]


def differencing_partitions(sizes: list[int], k: int) -> list[list[int]]:
    """Largest differencing method: the two most unequal partial partitions are merged, largest part with smallest."""
    import heapq

    heap, tie = [], 0
    for i, s in enumerate(sizes):
        parts = [(s, [i])] + [(0, [])] * (k - 1)
        heapq.heappush(heap, (-s, tie, parts))
        tie += 1
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = sorted(((x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b))), key=lambda t: (-t[0], t[1][:1]))
        heapq.heappush(heap, (both[-1][0] - both[0][0], tie, both))
        tie += 1
    return [sorted(p) for _, p in heap[0][2]] if heap else [[] for _ in range(k)]


def balance(df: DataFrame, key: str, size: str, k: int, shard_rows: int = 100_000) -> DataFrame:
    """(key, size, part): rows spread over k parts of nearly equal total size.

    Runs on shards of at most about shard_rows rows chosen by a hash of the key, so no task holds all rows; the parts of
    all shards together are balanced as each of them is. Null sizes count as 0.
    """
    import pandas as pd

    n = max(1, -(-df.count() // shard_rows))
    d = df.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("size")).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(n)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", ignore_index=True)
        part = pd.Series(0, index=pdf.index, dtype="int64")
        for p, rows in enumerate(greedy_partitions(pdf["size"].tolist(), k)):
            part.iloc[rows] = p
        return pd.DataFrame({"key": pdf["key"], "size": pdf["size"], "part": part})

    return d.groupBy("shard").applyInPandas(run, "key bigint, size bigint, part bigint")
