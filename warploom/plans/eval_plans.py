"""Evaluation queries on results_step120 and qa_train, run roll-ups on orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as X
from ..functions import text as T
from ..operators import evaluate as E
from ..operators import trajectory as R
from . import table
from .corpus_plans import _NORM, _PUNCT


def _results(spark, d):
    return table(spark, d, "results_step120").select("result_id", "split", "data_source", "question", "golden_answers", "prediction", "answer_f1_score", "answer_em_score", "format_score", "turns", "context").dropDuplicates(["result_id"])


def em_f1(spark, d):
    x = _results(spark, d).withColumn("a", F.coalesce(T.last_answer("prediction"), "prediction"))
    return E.answer_scores(x, "a", "golden_answers").select("result_id", "em", F.round("f1", 6).alias("f1"), "contained")


def f1_variant(spark, d):
    x = _results(spark, d).withColumn("a", F.coalesce(T.last_answer("prediction"), "prediction"))
    return x.select("result_id", F.round(X.best_f1("a", "golden_answers", 1.0), 6).alias("f1"))


def by_source(spark, d):
    x = _results(spark, d)
    return x.groupBy("data_source").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("answer_f1_score", "answer_em_score", "format_score", "turns")])


def extract(spark, d):
    x = _results(spark, d)
    return x.select("result_id", T.last_answer("prediction").alias("last"), T.first_answer("prediction").alias("first"), F.left(T.judged_answer("prediction"), F.lit(80)).alias("judged"), T.last_number("prediction").alias("number"))


def alias_expand(spark, d):
    return E.alias_expansion(_results(spark, d), "result_id", "golden_answers")


def alias_max(spark, d):
    a = E.alias_expansion(_results(spark, d), "result_id", "golden_answers").withColumn("score", F.length("alias") / 100.0)
    return E.alias_max(a, "result_id", "score").select("result_id", F.round("score", 6).alias("score"))


def pass_at_k(spark, d):
    x = _results(spark, d).groupBy("data_source", "split").agg(F.collect_list(F.round("answer_em_score", 0)).alias("s"))
    return x.select("data_source", "split", F.exists("s", lambda v: v == 1.0).cast("double").alias("passed"))


def macro(spark, d):
    return E.macro(_results(spark, d), "split", "data_source", F.col("answer_f1_score")).select("split", "data_source", F.round("score", 6).alias("score"))


def tail(spark, d):
    x = E.tail(table(spark, d, "orders"), "o_orderkey", 512)
    return x.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


def best_step(spark, d):
    x = table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best"), F.max("o_totalprice").alias("price"))
    return x


def keep(spark, d):
    kept, gone = E.keep_best(table(spark, d, "customer"), "c_acctbal", "c_custkey", 20)
    return kept.select("c_custkey", F.lit(True).alias("kept")).unionByName(gone.select("c_custkey", F.lit(False).alias("kept")))


def resume(spark, d):
    done = table(spark, d, "labels").where("toxic is not null")
    return E.pending(table(spark, d, "documents").select("doc_id"), done, "doc_id")


def sidecar(spark, d):
    """Supporting evidence joined to evaluation records by question and first answer."""
    key = F.concat(F.lower("question"), F.lit("|||"), F.lower(F.coalesce(F.try_element_at("golden_answers", F.lit(1)), F.lit(""))))
    side = table(spark, d, "qa_train").select(key.alias("key"), F.size("supporting_evidence").alias("n")).groupBy("key").agg(F.max("n").alias("evidence"))
    return _results(spark, d).select("result_id", key.alias("key")).join(side, "key", "left").select("result_id", "evidence")


def context_sizes(spark, d):
    """Different context passages of a record, in order."""
    return _results(spark, d).select("result_id", F.coalesce(F.size(F.array_distinct("context")), F.lit(0)).alias("passages"))


def group_log(spark, d):
    x = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: k.cast("string")), ",").alias("sessions"), F.round(F.avg("o_totalprice"), 6).alias("mean"))
    return x


def reachability(spark, d):
    """First stage at which an answer is met: in the question, the context, the evidence, or not at all."""
    has = lambda c: F.coalesce(F.exists("golden_answers", lambda g: (T.normalize_answer(g) != "") & F.contains(T.normalize_answer(c), T.normalize_answer(g))), F.lit(False))
    x = _results(spark, d).withColumns({"ctx": F.array_join(F.coalesce("context", F.array().cast("array<string>")), " "), "pred": F.coalesce("prediction", F.lit(""))})
    s = x.select(E.first_hit(x, {"init": has(F.col("question")), "context": has(F.col("ctx")), "prediction": has(F.col("pred"))}).alias("stage"))
    return s.groupBy("stage").agg(F.count("*").alias("n"))


def duplicate_keys(spark, d):
    return table(spark, d, "qa_train").groupBy("qa_id").agg(F.count("*").alias("n")).where("n > 1")


def digest(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.md5(F.coalesce("title", F.lit(""))).alias("md5"))


def format_reward(spark, d):
    """Rollouts made of records: a thought and a query, then a thought and the prediction as answer."""
    q = F.concat(F.lit("<|im_start|>assistant\n<think>t</think>\n<query>"), F.coalesce("question", F.lit("")), F.lit("</query><|im_end|>\n<|im_start|>assistant\n<think>t</think>\n"), F.coalesce("prediction", F.lit("")), F.lit("<|im_end|>"))
    x = _results(spark, d).select("result_id", R.format_reward(q).alias("reward"))
    return x.select("result_id", "reward", F.round(R.format_then_answer(F.col("reward"), F.lit(0.5)), 6).alias("total"))


def rewards(spark, d):
    """Full trajectory rewards of rollouts made of records."""
    text = F.concat(
        F.lit('<|im_start|>assistant\n<query>{"query": "INIT"}</query><|im_end|>\n<|im_start|>user\n[OBS]\nvisible_sentences:\nS0 | '), F.coalesce(F.try_element_at("context", F.lit(1)), F.lit("")),
        F.lit("\navailable_actions:\nA0 = SELECT S0\nA1 = ANSWER_WITH S0\n[/OBS]<|im_end|>\n<|im_start|>assistant\n<query>A1</query><|im_end|>\n<|im_start|>user\n[OBS]\nselected_evidence:\nS0 | "),
        F.coalesce(F.try_element_at("context", F.lit(1)), F.lit("")), F.lit("\n[/OBS]<|im_end|>\n<|im_start|>assistant\n<answer>"), F.coalesce("prediction", F.lit("")), F.lit("</answer><|im_end|>"),
    )
    return R.rewards(_results(spark, d).withColumn("t", text), "result_id", "t", "golden_answers")


def queries():
    return {
        "em_f1": em_f1, "f1_reward_variant": f1_variant, "metrics_by_source": by_source, "answer_extract": extract, "alias_expansion": alias_expand, "alias_max": alias_max, "pass_at_k": pass_at_k, "macro_rollup": macro,
        "tail_metrics": tail, "best_step": best_step, "checkpoint_topk": keep, "resume_anti_join": resume, "sidecar_join": sidecar, "context_dedupe": context_sizes, "group_log": group_log, "reachability": reachability,
        "duplicate_keys": duplicate_keys, "content_digest": digest, "format_reward": format_reward, "trajectory_reward": rewards,
    }


def _normal(col):
    a = f"regexp_replace(lower(coalesce({col}, '')), '{_PUNCT}', '', 'g')"
    for _ in range(2):
        a = rf"regexp_replace({a}, '(^|[^\p{{L}}\p{{N}}_])(a|an|the)([^\p{{L}}\p{{N}}_]|$)', '\1 \3', 'g')"
    return _NORM % a


_R = "r as (select distinct on (result_id) * from results_step120 order by result_id)"
_LAST = "trim(list_last(regexp_extract_all(prediction, '(?s)<answer>(.*?)</answer>', 1)))"
_GP = f"p as (select result_id, {_normal('coalesce(' + _LAST + ', prediction)')} as p, golden_answers from r), g as (select result_id, p, {_normal('g')} as g from (select result_id, p, unnest(golden_answers) as g from p))"
_F1 = """tk as (select row_number() over () as k, result_id, list_filter(string_split(p, ' '), lambda x: x <> '') as pt, list_filter(string_split(g, ' '), lambda x: x <> '') as gt from g),
    ov as (select k, result_id, len(pt) as np, len(gt) as ng, coalesce(list_sum(list_transform(list_distinct(pt), lambda t: least(len(list_filter(pt, lambda x: x = t)), len(list_filter(gt, lambda x: x = t))))), 0) as c from tk),
    ff as (select result_id, max(case when np = 0 and ng = 0 then %s when c = 0 then 0.0 else 2.0 * c / (np + ng) end)::double as f1 from ov group by result_id)"""


def oracle_sql():
    roll = "'<|im_start|>assistant' || chr(10) || '<think>t</think>' || chr(10) || '<query>' || coalesce(question, '') || '</query><|im_end|>'"
    asks = "not contains(coalesce(question, ''), '<query>') and not contains(coalesce(question, ''), '</query>')"
    ends = "regexp_full_match(coalesce(prediction, ''), '(?s)<answer>.*</answer>')"
    return {
        "em_f1": f"with {_R}, {_GP}, {_F1 % '0.0'}, m as (select result_id, max(case when p = g then 1.0 else 0.0 end) as em, max(case when g <> '' and contains(p, g) then 1.0 else 0.0 end) as contained from g group by result_id) select result_id, coalesce(em, 0)::double as em, round(coalesce(f1, 0), 6) as f1, coalesce(contained, 0)::double as contained from r left join m using (result_id) left join ff using (result_id)",
        "f1_reward_variant": f"with {_R}, {_GP}, {_F1 % '1.0'} select result_id, round(coalesce(f1, 0), 6) as f1 from r left join ff using (result_id)",
        "metrics_by_source": f"with {_R} select data_source, count(*) as n, round(avg(answer_f1_score), 6) as answer_f1_score, round(avg(answer_em_score), 6) as answer_em_score, round(avg(format_score), 6) as format_score, round(avg(turns), 6) as turns from r group by 1",
        "answer_extract": rf"with {_R} select result_id, {_LAST} as last, trim((regexp_extract_all(prediction, '(?s)<answer>(.*?)</answer>', 1))[1]) as first, left(coalesce({_LAST}, trim(right(prediction, 500))), 80) as judged, list_last(regexp_extract_all(replace(prediction, ',', ''), '-?[0-9]+\.?[0-9]*')) as number from r",
        "alias_expansion": f"with {_R}, a as (select result_id, list_filter(list_transform(golden_answers, lambda x: trim(x)), lambda x: x is not null and x <> '') as l from r), u as (select result_id, unnest(l) as alias, generate_subscripts(l, 1) as i from a), f as (select result_id, alias, min(i) as i from u group by all) select result_id, (row_number() over (partition by result_id order by i) - 1)::int as k, alias from f",
        "alias_max": f"with {_R}, u as (select result_id, trim(unnest(golden_answers)) as alias from r) select result_id, round(max(length(alias)) / 100.0, 6)::double as score from u where alias <> '' group by 1",
        "pass_at_k": f"with {_R} select data_source, split, max(case when round(answer_em_score, 0) = 1 then 1.0 else 0.0 end)::double as passed from r group by all",
        "macro_rollup": f"with {_R}, b as (select split, data_source, avg(answer_f1_score) as s from r group by all) select split, data_source, round(s, 6) as score from b union all select split, null, round(avg(s), 6) from b group by split",
        "tail_metrics": "with x as (select * from orders order by o_orderkey desc limit 512) select count(*) as n, round(sum(o_totalprice), 2) as total, round(avg(o_totalprice), 4) as mean from x",
        "best_step": "select o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) as best, max(o_totalprice) as price from orders group by 1",
        "checkpoint_topk": "select c_custkey, row_number() over (order by c_acctbal desc nulls last, c_custkey desc) <= 20 as kept from customer",
        "resume_anti_join": "select doc_id from documents where doc_id not in (select doc_id from labels where toxic is not null)",
        "sidecar_join": f"with {_R}, s as (select lower(question) || '|||' || lower(coalesce(golden_answers[1], '')) as key, max(len(supporting_evidence))::int as evidence from qa_train group by 1) select result_id, evidence from r left join s on s.key = lower(question) || '|||' || lower(coalesce(golden_answers[1], ''))",
        "context_dedupe": f"with {_R} select result_id, coalesce(len(list_distinct(context)) + (case when len(list_filter(context, lambda x: x is null)) > 0 then 1 else 0 end), 0)::int as passages from r",
        "group_log": "select o_custkey, string_agg(o_orderkey::varchar, ',' order by o_orderkey) as sessions, round(avg(o_totalprice), 6) as mean from orders group by 1",
        "reachability": f"""with {_R}, g as (select result_id, {_normal('g')} as g from (select result_id, unnest(golden_answers) as g from r)), t as (select result_id, {_normal('question')} as q, {_normal("coalesce(array_to_string(context, ' '), '')")} as c, {_normal('prediction')} as p from r),
            h as (select result_id, bool_or(contains(q, g)) as a, bool_or(contains(c, g)) as b, bool_or(contains(p, g)) as e from g join t using (result_id) where g <> '' group by 1)
            select case when coalesce(a, false) then 'init' when coalesce(b, false) then 'context' when coalesce(e, false) then 'prediction' else 'miss' end as stage, count(*) as n from r left join h using (result_id) group by 1""",
        "duplicate_keys": "select qa_id, count(*) as n from qa_train group by 1 having count(*) > 1",
        "content_digest": "select doc_id, sha256(coalesce(text, '')) as sha256, md5(coalesce(title, '')) as md5 from documents",
        "format_reward": f"with {_R}, x as (select result_id, case when {asks} then 0.5 else 0.0 end + case when {ends} then 0.5 else 0.0 end as reward from r) select result_id, reward::double as reward, (case when least(reward, 1.0) = 1.0 then 0.5 else least(reward, 1.0) - 1.0 end)::double as total from x",
    }
