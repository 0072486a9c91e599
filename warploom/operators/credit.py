"""Structural credit over the steps of episodes.

A step has episode, t, taken_action_id, taken_ig, frontier_ig (map of action to gain), is_information_action, and the id
arrays produced_sids, consumed_sids, produced_entity_ids, used_entity_ids and surfaced_entity_ids.
"""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEAD_ZONE = 1e-4
MAX_SHAPLEY = 6


def dead_zone(x: Column, width: float = DEAD_ZONE) -> Column:
    """0 for gains smaller than the width."""
    return F.when(F.abs(x) < width, F.lit(0.0)).otherwise(x)


def frontier_credit(taken: Column, frontier: Column, action: Column, informative: Column, baseline: str = "mean", width: float = DEAD_ZONE) -> Column:
    """Gain of the taken action less the mean or largest gain of the other open actions; 0 without any and for other actions."""
    rest = F.transform(F.map_values(F.map_filter(frontier, lambda k, v: ~k.eqNullSafe(action))), lambda v: dead_zone(v, width))
    if baseline == "mean":
        base = F.aggregate(rest, F.lit(0.0), lambda s, x: s + x) / F.size(rest)
    elif baseline == "max":
        base = F.array_max(rest)
    else:
        raise ValueError(baseline)
    return F.when(informative & (F.size(rest) > 0), dead_zone(dead_zone(taken, width) - base, width)).otherwise(F.lit(0.0))


def provenance_edges(steps: DataFrame) -> DataFrame:
    """(episode, src, dst): for everything a step consumes or uses, an edge from the latest earlier step that produced it."""

    def link(use: str, make: str) -> DataFrame:
        made = steps.select("episode", F.col("t").alias("src"), F.explode(make).alias("x"))
        used = steps.select("episode", F.col("t").alias("dst"), F.explode(F.array_distinct(use)).alias("x"))
        return used.join(made, ["episode", "x"]).where("src < dst").groupBy("episode", "dst", "x").agg(F.max("src").alias("src"))

    both = link("consumed_sids", "produced_sids").unionByName(link("used_entity_ids", "produced_entity_ids"))
    return both.select("episode", "src", "dst").distinct()


def shared_entity_edges(steps: DataFrame) -> DataFrame:
    """(episode, src, dst): every earlier and later step of an episode that surface a common entity."""
    e = steps.select("episode", "t", F.explode(F.array_distinct("surfaced_entity_ids")).alias("x"))
    a, b = e.withColumnRenamed("t", "src"), e.withColumnRenamed("t", "dst")
    return a.join(b, ["episode", "x"]).where("src < dst").select("episode", "src", "dst").distinct()


def enabling_credit(gains: DataFrame, edges: DataFrame, gamma: float = 1.0, max_steps: int = 64) -> DataFrame:
    """(episode, t, r_en): each step passes its gain and gamma times its own credit on to its predecessors in equal shares.

    Edges go forward in time, so the credit is folded once over the steps from the last to the first: one row per episode
    holds its steps and edges as arrays (an episode has at most max_steps turns), and a fold keeps a map of credits.
    """
    pred = edges.groupBy("episode", F.col("dst").alias("t")).agg(F.array_sort(F.collect_set("src")).alias("pred"))
    s = gains.join(pred, ["episode", "t"], "left").select("episode", F.struct("t", "ig", F.coalesce("pred", F.array().cast("array<int>")).alias("pred")).alias("s"))
    g = s.groupBy("episode").agg(F.reverse(F.array_sort(F.collect_list("s"))).alias("steps"))
    zero = F.expr("cast(map() as map<int,double>)")

    def step(credit: Column, x: Column) -> Column:
        share = (x["ig"] + gamma * F.coalesce(F.try_element_at(credit, x["t"]), F.lit(0.0))) / F.size(x["pred"])
        given = F.map_from_arrays(x["pred"], F.transform(x["pred"], lambda p: F.coalesce(F.try_element_at(credit, p), F.lit(0.0)) + share))
        return F.when(F.size(x["pred"]) > 0, F.map_concat(F.map_filter(credit, lambda k, v: ~F.array_contains(x["pred"], k)), given)).otherwise(credit)

    folded = g.select("episode", "steps", F.aggregate("steps", zero, step).alias("c"))
    return folded.select("episode", F.explode("steps").alias("x"), "c").select("episode", F.col("x.t").alias("t"), F.coalesce(F.try_element_at("c", F.col("x.t")), F.lit(0.0)).alias("r_en"))


def shapley(values: DataFrame, sizes: DataFrame) -> DataFrame:
    """(episode, i, value): exact Shapley values from a table of coalition values (episode, mask, v).

    sizes(episode, n) has at most MAX_SHAPLEY steps each; a missing coalition value raises an error.
    """
    weight = F.array(*[F.array(*[F.lit(factorial(s) * factorial(n - s - 1) / factorial(n) if s < n else 0.0) for s in range(MAX_SHAPLEY)]) for n in range(1, MAX_SHAPLEY + 1)])
    n = sizes.withColumn("n", F.when(F.col("n") <= MAX_SHAPLEY, F.col("n")).otherwise(F.raise_error(F.lit("too many steps")).cast("int")))
    sets = n.select("episode", "n", F.explode(F.sequence(F.lit(0), F.expr("shiftleft(1, cast(n as int))") - 1)).alias("mask"))
    pairs = sets.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).where(F.expr("(mask & shiftleft(1, i)) = 0"))
    v = values.select("episode", "mask", "v")
    r = pairs.withColumn("with", F.expr("mask | shiftleft(1, i)")).join(v, ["episode", "mask"], "left").withColumnRenamed("v", "v0")
    r = r.join(v.withColumnRenamed("mask", "with").withColumnRenamed("v", "v1"), ["episode", "with"], "left")
    gain = F.when(F.col("v0").isNull() | F.col("v1").isNull(), F.raise_error(F.lit("missing coalition value")).cast("double")).otherwise(F.col("v1") - F.col("v0"))
    w = F.element_at(F.element_at(weight, F.col("n").cast("int")), F.bit_count("mask").cast("int") + 1)
    return r.groupBy("episode", "i").agg(F.sum(w * gain).alias("value"))


def total_credit(r_fr: Column, r_en: Column, alpha: float = 1.0, beta: float = 1.0, protect: bool = False, width: float = DEAD_ZONE) -> Column:
    """alpha * r_fr + beta * r_en; with protect, a negative r_fr of an enabling step counts as 0."""
    fr = F.when((r_en > width) & (r_fr < 0), F.lit(0.0)).otherwise(r_fr) if protect else r_fr
    return alpha * fr + beta * r_en


def shuffled_edges(edges: DataFrame, seed: int) -> DataFrame:
    """Ablation: every edge keeps its target and gets another earlier step as source, in the order of a digest; in-degrees stay."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("episode").cast("string"), F.col("dst").cast("string"), F.col("cand").cast("string")), 256)
    n = edges.groupBy("episode", "dst").agg(F.count("*").alias("n"))
    cand = n.where("dst > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("dst") - 1)).alias("cand"))
    w = Window.partitionBy("episode", "dst").orderBy(digest)
    return cand.withColumn("k", F.row_number().over(w)).where("k <= n").select("episode", F.col("cand").alias("src"), "dst")


def place_on_spans(credits: DataFrame, spans: DataFrame) -> DataFrame:
    """(row, pos, reward): each credit spread evenly over the tokens of its span [start, end), or put on its anchor if empty.

    credits(row, t, credit) joined with spans(row, t, start, end, anchor); rows with neither a span nor an anchor are skipped.
    """
    j = credits.join(spans, ["row", "t"])
    full = j.where("end > start").select("row", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"), (F.col("credit") / (F.col("end") - F.col("start"))).alias("c"))
    rest = j.where("(end <= start or end is null or start is null) and anchor is not null").select("row", F.col("anchor").alias("pos"), F.col("credit").alias("c"))
    return full.unionByName(rest).groupBy("row", "pos").agg(F.sum("c").alias("reward"))


def latest_before(df: DataFrame, part: str, order: str, value: Column, out: str) -> DataFrame:
    """As-of join backward: the last non-null value of earlier rows."""
    w = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def first_after(df: DataFrame, part: str, order: str, value: Column, out: str) -> DataFrame:
    """As-of join forward: the first non-null value of later rows."""
    w = Window.partitionBy(part).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn(out, F.first(value, ignorenulls=True).over(w))


def mock_score(c: Column) -> Column:
    """Stand-in for a neural scorer: sum of the code points of a text modulo 1000, over 1000."""
    total = F.aggregate(F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda x: x != ""), F.lit(0), lambda s, x: s + F.ascii(x))
    return (total % 1000) / 1000.0
