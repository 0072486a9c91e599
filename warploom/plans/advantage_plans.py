"""Advantages and losses on lineitem: an order is a row or a group of responses, its line number the position."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import advantage as A
from . import LINES_SQL, lines, table

# reward, value, mask, log-probabilities made of the columns
_R, _V, _M = "l_discount - 0.05", "l_quantity / 50.0", "case when l_returnflag = 'R' then 0 else 1 end"
_LP, _REF = "-l_discount * 10 - 0.1", "-l_tax * 10 - 0.1"
_BASE = f"select l_orderkey as uid, line as pos, l_discount as score, {_R} as r, {_V} as v, {_M} as m, {_LP} as lp, {_REF} as ref from {LINES_SQL}"


def base(spark, d):
    return lines(spark, d).selectExpr("l_orderkey as uid", "line as pos", "l_discount as score", f"{_R} as r", f"{_V} as v", f"{_M} as m", f"{_LP} as lp", f"{_REF} as ref")


def grpo(spark, d):
    return A.group_relative(base(spark, d), "uid", "score").select("uid", "pos", F.round("advantage", 6).alias("advantage"))


def rloo(spark, d):
    return A.leave_one_out(base(spark, d), "uid", "score").select("uid", "pos", F.round("advantage", 6).alias("advantage"))


def gae(spark, d):
    return A.gae(base(spark, d), "uid", "pos", "r", "v", 0.9, 0.8).select("uid", "pos", F.round("advantage", 6).alias("advantage"), F.round("return", 6).alias("ret"))


def reinforce(spark, d):
    return A.discounted(base(spark, d), "uid", "pos", "r", "m", 0.97).select("uid", "pos", F.round("return", 6).alias("ret"))


def remax(spark, d):
    x = base(spark, d).withColumn("b", F.lit(0.01))
    return A.remax(x, "uid", "pos", "r", "m", "b").select("uid", "pos", F.round("advantage", 6).alias("advantage"))


def stats(spark, d):
    return A.masked_stats(base(spark, d), "v", "m").select("n", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"))


def whiten(spark, d):
    return A.whiten(base(spark, d), "v", "m").select("uid", "pos", F.round("white", 5).alias("white"))


def span(spark, d):
    return A.span_advantage(base(spark, d), "r", "m").select("uid", "pos", F.round("span_advantage", 5).alias("advantage"))


def grpo_span(spark, d):
    x = A.span_advantage(A.group_relative(base(spark, d), "uid", "score"), "r", "m")
    return x.select("uid", "pos", F.round(F.col("advantage") + 0.2 * F.col("span_advantage"), 5).alias("advantage"))


def kls(spark, d):
    b = base(spark, d)
    return b.select("uid", "pos", *[F.round(A.kl(F.col("lp"), F.col("ref"), k), 6).alias(k) for k in ("kl", "abs", "mse", "low_var_kl")])


def losses(spark, d):
    b = base(spark, d)
    x = b.select("m", A.policy_loss(F.col("ref"), F.col("lp"), F.col("r")).alias("l"), A.policy_clipped(F.col("ref"), F.col("lp"), F.col("r")).alias("c"), A.value_loss(F.col("v"), F.col("score"), F.col("r")).alias("vl"))
    n = F.sum("m")
    return x.agg(*[F.round(F.sum(F.col(c) * F.col("m")) / n, 6).alias(a) for c, a in (("l", "policy_loss"), ("c", "clip_fraction"), ("vl", "value_loss"))])


def kl_rewards(spark, d):
    b = base(spark, d).withColumn("x", F.col("r") - 0.001 * A.kl(F.col("lp"), F.col("ref")))
    return b.groupBy("uid").agg(F.round(F.sum(F.col("x") * F.col("m")), 6).alias("reward"), F.round(F.sum(A.kl(F.col("lp"), F.col("ref")) * F.col("m")) / F.greatest(F.sum("m"), F.lit(1)), 6).alias("kl"))


def metric_summary(spark, d):
    from ..operators.evaluate import metric_summary as ms

    x = base(spark, d).groupBy("uid").agg(F.sum("r").alias("reward"), F.count("*").alias("length"))
    return ms(x, ["reward", "length"]).select(*[F.round(c, 6).alias(c) for c in ("reward_mean", "reward_max", "reward_min", "length_mean")], "length_max", "length_min")


def entropy(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double") * 8).alias("z"))
    return x.select("vec_id", F.round(A.entropy(F.col("z")), 5).alias("entropy"), F.round(A.log_prob(F.col("z"), F.lit(3)), 5).alias("logp"))


def queries():
    return {
        "grpo_advantage": grpo, "rloo_advantage": rloo, "gae_advantage": gae, "reinforce_returns": reinforce, "remax_advantage": remax, "masked_stats": stats, "masked_whiten": whiten, "span_advantage": span,
        "grpo_span_advantage": grpo_span, "kl_estimators": kls, "policy_value_loss": losses, "kl_rewards": kl_rewards, "metric_summary": metric_summary, "entropy_logprob": entropy,
    }


_B = f"with b as ({_BASE})"
_SPAN = "s as (select greatest(case when count(*) > 1 then stddev_pop(r) when count(*) = 1 then avg(abs(r)) else 1.0 end, 5e-4) as sc from b where m > 0 and r <> 0)"
_CLIP = "greatest(least(r * m / sc, 5.0), -5.0)"
_G = "(score - case when count(*) over w > 1 then avg(score) over w else 0 end) / (case when count(*) over w > 1 then stddev_samp(score) over w else 1 end + 1e-6)"
_RATIO = "exp(greatest(least(lp - ref, 20.0), -20.0))"
_ONE = f"greatest(-r * {_RATIO}, -r * greatest(least({_RATIO}, 1.2), 0.8))"


def oracle_sql():
    return {
        "grpo_advantage": f"{_B} select uid, pos, round({_G}, 6) as advantage from b window w as (partition by uid)",
        "rloo_advantage": f"{_B} select uid, pos, round(case when count(*) over w > 1 then score * count(*) over w / (count(*) over w - 1) - avg(score) over w * count(*) over w / (count(*) over w - 1) else score end, 6) as advantage from b window w as (partition by uid)",
        "gae_advantage": f"""{_B}, d as (select uid, pos, v, r + 0.9 * coalesce(lead(v) over w, 0) - v as dl from b window w as (partition by uid order by pos))
            select x.uid, x.pos, round(sum(y.dl * pow(0.72, y.k - x.k)), 6) as advantage, round(sum(y.dl * pow(0.72, y.k - x.k)) + any_value(x.v), 6) as ret
            from (select *, row_number() over (partition by uid order by pos) as k from d) x join (select *, row_number() over (partition by uid order by pos) as k from d) y on x.uid = y.uid and y.k >= x.k group by x.uid, x.pos""",
        "reinforce_returns": f"""{_B}, k as (select *, row_number() over (partition by uid order by pos) as k from b),
            z as (select x.uid, x.pos, y.r, y.k - x.k as n, (select min(c.k) from k c where c.uid = x.uid and c.k > x.k and c.m = 0) as stop, y.k as yk from k x join k y on x.uid = y.uid and y.k >= x.k)
            select uid, pos, round(sum(r * pow(0.97, n)), 6) as ret from z where stop is null or yk < stop group by uid, pos""",
        "remax_advantage": f"{_B} select uid, pos, round(sum(r * m) over (partition by uid order by pos rows between current row and unbounded following) - 0.01 * m, 6) as advantage from b",
        "masked_stats": f"{_B} select sum(m)::bigint as n, round(sum(v * m) / sum(m), 6) as mean, round(var_samp(v) filter (where m = 1), 6) as var from b",
        "masked_whiten": f"{_B}, s as (select avg(v) as mu, var_samp(v) as va from b where m = 1) select uid, pos, round((v - mu) / sqrt(va + 1e-8), 5) as white from b, s",
        "span_advantage": f"{_B}, {_SPAN} select uid, pos, round({_CLIP}, 5) as advantage from b, s",
        "grpo_span_advantage": f"{_B}, {_SPAN}, g as (select *, {_G} as a from b window w as (partition by uid)) select uid, pos, round(a + 0.2 * {_CLIP}, 5) as advantage from g, s",
        "kl_estimators": f"{_B} select uid, pos, round(lp - ref, 6) as kl, round(abs(lp - ref), 6) as abs, round(0.5 * (lp - ref) * (lp - ref), 6) as mse, round(exp(ref - lp) - (ref - lp) - 1, 6) as low_var_kl from b",
        "policy_value_loss": f"""{_B} select round(sum(m * case when r < 0 then least(-r * 3.0, {_ONE}) else {_ONE} end) / sum(m), 6) as policy_loss,
            round(sum(m * case when -r * greatest(least({_RATIO}, 1.2), 0.8) > -r * {_RATIO} then 1.0 else 0.0 end) / sum(m), 6) as clip_fraction,
            round(sum(m * 0.5 * greatest(pow(v - r, 2), pow(greatest(least(v, score + 0.5), score - 0.5) - r, 2))) / sum(m), 6) as value_loss from b""",
        "kl_rewards": f"{_B} select uid, round(sum((r - 0.001 * (lp - ref)) * m), 6) as reward, round(sum((lp - ref) * m) / greatest(sum(m), 1), 6) as kl from b group by uid",
        "metric_summary": f"{_B}, x as (select uid, sum(r) as reward, count(*) as length from b group by uid) select round(avg(reward), 6) as reward_mean, round(max(reward), 6) as reward_max, round(min(reward), 6) as reward_min, round(avg(length), 6) as length_mean, max(length) as length_max, min(length) as length_min from x",
        "entropy_logprob": """with e as (select vec_id, unnest(embedding)::double * 8 as z, generate_subscripts(embedding, 1) as k from embeddings), m as (select vec_id, max(z) as top from e group by vec_id)
            select vec_id, round(ln(sum(exp(z - top))) - sum(exp(z - top) * (z - top)) / sum(exp(z - top)), 5) as entropy, round(max(z) filter (where k = 4) - any_value(top) - ln(sum(exp(z - top))), 5) as logp from e join m using (vec_id) group by vec_id""",
    }
