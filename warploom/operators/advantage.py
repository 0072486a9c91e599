"""Advantages, losses and masked statistics over token rewards.

Long form: one row per (row, pos) with reward, value and mask; outcome form: one row per response with uid and score.
All are window or array expressions; none needs Python on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-6


def group_relative(df: DataFrame, uid: str, score: str) -> DataFrame:
    """(score - mean) / (sample deviation + 1e-6) within a uid; a single response keeps mean 0 and deviation 1."""
    w = Window.partitionBy(uid)
    n, mean, std = F.count(score).over(w), F.avg(score).over(w), F.stddev_samp(score).over(w)
    return df.withColumn("advantage", (F.col(score) - F.when(n > 1, mean).otherwise(0.0)) / (F.when(n > 1, std).otherwise(1.0) + EPS))


def leave_one_out(df: DataFrame, uid: str, score: str) -> DataFrame:
    """Score minus the mean of the other responses of a uid; unchanged for a single one."""
    w = Window.partitionBy(uid)
    n = F.count(score).over(w)
    return df.withColumn("advantage", F.when(n > 1, F.col(score) * n / (n - 1) - F.avg(score).over(w) * n / (n - 1)).otherwise(F.col(score)))


def discounted(df: DataFrame, row: str, pos: str, reward: str, mask: str, gamma: float = 1.0) -> DataFrame:
    """Discounted sum of later rewards, started anew behind a masked place: arrays per row, folded from the end."""
    g = df.groupBy(row).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(reward).cast("double").alias("r"), F.col(mask).cast("double").alias("m")))).alias("a"))
    zero = F.struct(F.lit(0.0).alias("run"), F.lit(1.0).alias("next"), F.array().cast("array<struct<p:int,g:double>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        run = x["r"] + gamma * s["run"] * s["next"]
        return F.struct(run.alias("run"), x["m"].alias("next"), F.concat(s["out"], F.array(F.struct(x["p"].cast("int").alias("p"), run.alias("g")))).alias("out"))

    folded = g.select(row, F.aggregate(F.reverse("a"), zero, step, lambda s: s["out"]).alias("o"))
    return folded.select(row, F.explode("o").alias("x")).select(row, F.col("x.p").alias(pos), F.col("x.g").alias("return"))


def gae(df: DataFrame, row: str, pos: str, reward: str, value: str, gamma: float = 1.0, lam: float = 1.0) -> DataFrame:
    """(row, pos, advantage, return) before whitening: d = r + gamma V' - V, A = d + gamma lam A', return = A + V."""
    item = F.struct(F.col(pos).alias("p"), F.col(reward).cast("double").alias("r"), F.col(value).cast("double").alias("v"))
    g = df.groupBy(row).agg(F.array_sort(F.collect_list(item)).alias("a"))
    zero = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("adv"), F.array().cast("array<struct<p:int,a:double,t:double>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        adv = x["r"] + gamma * s["v"] - x["v"] + gamma * lam * s["adv"]
        return F.struct(x["v"].alias("v"), adv.alias("adv"), F.concat(s["out"], F.array(F.struct(x["p"].cast("int").alias("p"), adv.alias("a"), (adv + x["v"]).alias("t")))).alias("out"))

    folded = g.select(row, F.aggregate(F.reverse("a"), zero, step, lambda s: s["out"]).alias("o"))
    return folded.select(row, F.explode("o").alias("x")).select(row, F.col("x.p").alias(pos), F.col("x.a").alias("advantage"), F.col("x.t").alias("return"))


def remax(df: DataFrame, row: str, pos: str, reward: str, mask: str, baseline: str) -> DataFrame:
    """Sum of the masked rewards from here on, less the row's baseline where the mask holds."""
    w = Window.partitionBy(row).orderBy(pos).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn("advantage", F.sum(F.col(reward) * F.col(mask)).over(w) - F.col(baseline) * F.col(mask))


def masked_stats(df: DataFrame, value: str, mask: str) -> DataFrame:
    """One row: n, sum, mean and Bessel-corrected variance of the values where the mask holds; null mean for none."""
    n, s = F.sum(mask), F.sum(F.col(value) * F.col(mask))
    q = F.sum(F.col(value) * F.col(value) * F.col(mask))
    t = df.agg(n.alias("n"), s.alias("sum"), q.alias("sq"))
    mean = F.col("sum") / F.nullif(F.col("n"), F.lit(0))
    return t.select("n", "sum", mean.alias("mean"), F.when(F.col("n") > 1, (F.col("sq") / F.col("n") - mean * mean) * F.col("n") / (F.col("n") - 1)).alias("var"))


def whiten(df: DataFrame, value: str, mask: str, out: str = "white") -> DataFrame:
    """(value - mean) / sqrt(var + 1e-8) over the masked values; the statistics are one broadcast row."""
    s = masked_stats(df, value, mask).select(F.col("mean").alias("_m"), F.col("var").alias("_v"))
    return df.crossJoin(F.broadcast(s)).withColumn(out, (F.col(value) - F.col("_m")) / F.sqrt(F.col("_v") + 1e-8)).drop("_m", "_v")


def span_advantage(df: DataFrame, reward: str, mask: str, floor: float = 5e-4, clamp: float = 5.0) -> DataFrame:
    """Rewards over their population deviation where the mask holds and they are not 0; the scale is floored, the result clamped."""
    hit = (F.col(mask) > 0) & (F.col(reward) != 0)
    s = df.where(hit).agg(F.count("*").alias("n"), F.stddev_pop(reward).alias("sd"), F.avg(F.abs(F.col(reward))).alias("one"))
    scale = s.select(F.greatest(F.when(F.col("n") > 1, F.col("sd")).when(F.col("n") == 1, F.col("one")).otherwise(1.0), F.lit(floor)).alias("_scale"))
    x = F.col(reward) * F.col(mask) / F.col("_scale")
    return df.crossJoin(F.broadcast(scale)).withColumn("span_advantage", F.greatest(F.least(x, F.lit(clamp)), F.lit(-clamp))).drop("_scale")


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def kl(logp: Column, ref: Column, kind: str = "kl") -> Column:
    """Estimators of the divergence of a token: kl, abs, mse or low_var_kl."""
    d = logp - ref
    if kind == "kl":
        return d
    if kind == "abs":
        return F.abs(d)
    if kind == "mse":
        return 0.5 * d * d
    if kind == "low_var_kl":
        k = clip(ref - logp, -20.0, 20.0)
        return clip(F.exp(k) - k - 1, -10.0, 10.0)
    raise ValueError(kind)


def policy_loss(old: Column, new: Column, adv: Column, eps: float = 0.2, dual: float = 3.0) -> Column:
    """Clipped loss of a token, with the second bound for negative advantages."""
    r = F.exp(clip(new - old, -20.0, 20.0))
    one = F.greatest(-adv * r, -adv * clip(r, 1 - eps, 1 + eps))
    return F.when(adv < 0, F.least(-adv * dual, one)).otherwise(one)


def policy_clipped(old: Column, new: Column, adv: Column, eps: float = 0.2) -> Column:
    r = F.exp(clip(new - old, -20.0, 20.0))
    return (-adv * clip(r, 1 - eps, 1 + eps) > -adv * r).cast("double")


def value_loss(pred: Column, old: Column, target: Column, eps: float = 0.5) -> Column:
    """Half the larger squared error of the value and of the value clipped around the old one."""
    c = F.greatest(F.least(pred, old + eps), old - eps)
    return 0.5 * F.greatest((pred - target) * (pred - target), (c - target) * (c - target))


def entropy(logits: Column) -> Column:
    """Entropy of the softmax of an array of logits, shifted by the largest."""
    top = F.array_max(logits)
    z = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.log(z) - F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top) * (x - top)) / z


def log_prob(logits: Column, label: Column) -> Column:
    """Log-probability of the label (from 0) under an array of logits."""
    top = F.array_max(logits)
    return F.get(logits, label) - top - F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def adaptive_kl(coef: float, current: float, target: float, horizon: int, steps: int) -> float:
    """Next coefficient of the adaptive controller."""
    return coef * (1 + min(max(current / target - 1, -0.2), 0.2) * steps / horizon)


def cosine_warmup(step: int, total: int, warmup: int, cycles: float = 0.5, least: float = 0.0) -> float:
    import math

    if step < warmup:
        return step / max(1, warmup)
    x = (step - warmup) / max(1, total - warmup)
    return max(least, least + (1 - least) * 0.5 * (1 + math.cos(math.pi * cycles * 2 * x)))
