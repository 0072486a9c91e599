"""Roll-ups of evaluation records, runs and navigation logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import best_f1, contained_match, exact_match, ratio

#: The counters of an episode, in their fixed order.
COUNTERS = (
    "valid_action_id_count", "invalid_action_count", "natural_query_count", "select_count", "stop_count", "selected_sentence_count", "answer_after_stop", "lookup_count", "lookup_success_count",
    "lookup_new_sid_count", "duplicate_lookup_count", "bad_target_lookup_count", "answer_with_count", "answer_count", "available_action_count", "stop_action_available_count",
    "lookup_action_available_count", "answer_with_action_available_count", "step_count",
)


def answer_scores(df: DataFrame, pred: str, golds: str, both_empty: float = 0.0) -> DataFrame:
    """Adds em, f1 and contained of a prediction against several gold answers."""
    return df.withColumns({"em": exact_match(pred, golds), "f1": best_f1(pred, golds, both_empty), "contained": contained_match(pred, golds)})


def episode_rollup(df: DataFrame) -> DataFrame:
    """One row: the sums of all counters and the rates made of them; a table without episodes gives zeros."""
    have = [c for c in COUNTERS if c in df.columns]
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in have] + [F.lit(0).alias(c) for c in COUNTERS if c not in have]
    t = df.agg(F.count("*").alias("sessions"), F.count_if((F.col("stop_count") if "stop_count" in have else F.lit(0)) > 0).alias("stopped"), *sums)
    n, actions = F.greatest(F.col("sessions"), F.lit(1)), F.greatest(F.col("valid_action_id_count") + F.col("invalid_action_count"), F.lit(1))
    per = {"valid_action_id_rate": "valid_action_id_count", "env_invalid_rate": "invalid_action_count", "natural_query_rate": "natural_query_count", "select_rate": "select_count", "stop_rate": "stop_count", "lookup_rate": "lookup_count", "answer_with_rate": "answer_with_count", "answer_rate": "answer_count"}
    looks = {"lookup_success_rate": "lookup_success_count", "lookup_new_sid_rate": "lookup_new_sid_count", "duplicate_lookup_rate": "duplicate_lookup_count"}
    rates = {k: F.col(v) / actions for k, v in per.items()} | {k: ratio(F.col(v), F.col("lookup_count")) for k, v in looks.items()}
    rates |= {
        "no_stop_rate": 1.0 - F.col("stopped") / n, "avg_selected_sentence_count": F.col("selected_sentence_count") / n, "selected_evidence_contains_gold_rate": F.lit(0.0),
        "answer_after_stop_rate": F.col("answer_after_stop") / n, "lookup_action_available_rate": ratio(F.col("lookup_action_available_count"), F.col("available_action_count")),
    }
    return t.withColumns(rates).drop("stopped")


def metric_summary(df: DataFrame, measures: list[str]) -> DataFrame:
    """mean, max and min of each measure, one row."""
    return df.agg(*[f(m).alias(f"{m}_{n}") for m in measures for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))])


def tail(df: DataFrame, order: str, n: int = 512) -> DataFrame:
    """The last n rows in an order."""
    return df.orderBy(F.desc(order)).limit(n)


def best_row(df: DataFrame, score: str, step: str) -> DataFrame:
    """The step of the best score, the later one of equal scores."""
    return df.agg(F.max_by(step, F.struct(score, step)).alias(step), F.max(score).alias(score))


def keep_best(df: DataFrame, score: str, step: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) checkpoints: the k best by score, then step."""
    kept = df.orderBy(F.desc_nulls_last(score), F.desc(step)).limit(k)
    return kept, df.join(kept.select(step), step, "left_anti")


def macro(df: DataFrame, model: str, dataset: str, score: Column) -> DataFrame:
    """Mean of each model and data set, and the mean of these means per model (data set null)."""
    by = df.groupBy(model, dataset).agg(F.avg(score).alias("score"))
    return by.unionByName(by.groupBy(model).agg(F.avg("score").alias("score")).select(model, F.lit(None).cast("string").alias(dataset), "score"))


def alias_expansion(df: DataFrame, owner: str, aliases: str) -> DataFrame:
    """(owner, k, alias): one row per different trimmed alias that is not empty."""
    a = F.array_distinct(F.filter(F.transform(aliases, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
    return df.select(F.col(owner), F.posexplode(a).alias("k", "alias"))


def alias_max(scores: DataFrame, owner: str, score: str, expected: DataFrame | None = None) -> DataFrame:
    """The best score of the aliases of each owner; owners of ``expected`` without a score raise an error."""
    best = scores.groupBy(owner).agg(F.max(score).alias("score"))
    if expected is None:
        return best
    j = expected.select(owner).distinct().join(best, owner, "left")
    return j.withColumn("score", F.coalesce("score", F.raise_error(F.lit("alias without a score")).cast("double")))


def pass_rate(df: DataFrame, scores: str) -> DataFrame:
    """Share of rows one of whose scores is 1."""
    return df.agg(F.avg(F.exists(scores, lambda s: s == 1.0).cast("double")).alias("pass_rate"), F.count("*").alias("rows"))


def pending(everything: DataFrame, completed: DataFrame, key: str) -> DataFrame:
    """Rows not yet completed."""
    return everything.join(completed.select(key), key, "left_anti")


def first_hit(df: DataFrame, stages: dict[str, Column]) -> Column:
    """Name of the first stage whose condition holds, else miss."""
    c = F.lit("miss")
    for name, cond in reversed(list(stages.items())):
        c = F.when(cond, F.lit(name)).otherwise(c)
    return c


def longest_run(df: DataFrame, part: str, order: str, bad: Column) -> DataFrame:
    """(part, run): the longest run of rows in a row for which the condition holds."""
    w = Window.partitionBy(part).orderBy(order)
    g = df.withColumn("_b", F.coalesce(bad, F.lit(False))).withColumn("_g", F.sum((~F.col("_b")).cast("int")).over(w))
    return g.where("_b").groupBy(part, "_g").count().groupBy(part).agg(F.max("count").alias("run"))
