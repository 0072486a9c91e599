"""Navigation queries: events as a log of actions, users as sessions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import navigation as N
from ..operators import trajectory as R
from ..session import shared_dir
from ..streaming import sessions as S
from . import table

#: What an event type means as an action.
ACTION = "case event_type when 'signup' then 'INIT' when 'view' then 'A0' when 'click' then 'A1' when 'purchase' then 'A99' else 'where is it?' end"


def _events(spark, d):
    return table(spark, d, "events")


def action_parse(spark, d):
    menu = F.create_map(F.lit("A0"), F.lit("SELECT"), F.lit("A1"), F.lit("ANSWER"))
    raw = F.when(F.col("event_id") % 11 == 0, F.concat(F.expr(ACTION), F.lit(" || more"))).otherwise(F.expr(ACTION))
    return _events(spark, d).select("event_id", R.action_struct(raw, menu, F.col("event_id") % 2 == 0).alias("a")).select("event_id", "a.*")


def menu_parse(spark, d):
    """The menu of an observation made of an event, as a string."""
    obs = F.concat(F.lit("event: LOOKUP\nA0 = SELECT S0 | x\n A1 = LOOKUP E"), F.col("user_id"), F.lit("\nA2 = PAY\nA1 = ANSWER\nA3 = ANSWER_WITH S"), F.col("event_id") % 5)
    m = R.menu_entries(obs)
    return _events(spark, d).select("event_id", F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("menu"))


def action_menu(spark, d):
    e = _events(spark, d)
    v = e.where("event_type = 'view'").select(F.col("user_id").alias("session"), F.col("event_id").alias("ord"), F.concat(F.lit("s"), F.col("event_id")).alias("sid"))
    sel = v.where("ord % 3 = 0")
    t = e.where("event_type = 'click'").select(F.col("user_id").alias("session"), F.col("event_id").alias("ord"), F.concat(F.lit("e"), F.col("event_id") % 20).alias("eid"))
    return N.menu_rows(v, sel, t, t.where("ord % 7 = 0"))


def specs(spark, d):
    e = _events(spark, d).select(F.col("user_id").alias("session"), F.concat(F.lit("e"), F.col("event_id") % 9).alias("eid"), F.col("event_id").alias("ord"), F.when(F.col("event_type") == "view", F.concat(F.lit("a"), F.col("event_id"))).alias("anchor"), (F.col("value") < 90).alias("low_priority"))
    return N.lookup_specs(e)


def replayed(spark, d):
    e = _events(spark, d)
    actions = e.select(F.col("user_id").alias("session"), F.struct("ts", "event_id").alias("turn"), F.expr(ACTION).alias("action"))
    world = e.groupBy("user_id").agg(F.transform(F.slice(F.array_sort(F.collect_set("event_id")), 1, 5), lambda x: F.concat(F.lit("s"), x)).alias("first"))
    none = F.lit(None).cast("map<string,array<string>>")
    return N.replay(actions, world.select(F.col("user_id").alias("session"), "first", none.alias("entities"), none.alias("sentences")))


def rollup(spark, d):
    e = _events(spark, d).groupBy("user_id").agg(
        F.count_if(F.col("event_type") != "error").alias("valid_action_id_count"), F.count_if(F.col("event_type") == "error").alias("invalid_action_count"), F.count_if(F.col("event_type") == "view").alias("select_count"),
        F.count_if(F.col("event_type") == "purchase").alias("stop_count"), F.count_if(F.col("event_type") == "click").alias("lookup_count"), F.count_if((F.col("event_type") == "click") & (F.col("value") > 50)).alias("lookup_success_count"),
    )
    r = E.episode_rollup(e)
    return r.select("sessions", "valid_action_id_count", *[F.round(c, 6).alias(c) for c in ("valid_action_id_rate", "env_invalid_rate", "select_rate", "stop_rate", "no_stop_rate", "lookup_rate", "lookup_success_rate")])


def event_log(spark, d):
    """Each (user, type, hour) once: its first event."""
    e = _events(spark, d).withColumn("hour", F.date_trunc("hour", "ts"))
    return N.first_seen(e, ["user_id", "event_type", "hour"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


def errors_run(spark, d):
    return E.longest_run(_events(spark, d).withColumn("o", F.struct("ts", "event_id")), "user_id", "o", F.col("event_type") == "error").select("user_id", "run")


def _stream(spark, d):
    return spark.readStream.schema(_events(spark, d).schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


def _paths(spark):
    at = f"{shared_dir(spark)}/warploom/stream-{uuid.uuid4().hex}"
    return f"{at}/out", f"{at}/checkpoint"


def stream_counts(spark, d):
    return S.run_to_table(S.windowed_counts(_stream(spark, d), late="3650 days"), *_paths(spark), mode="complete")


def stream_once(spark, d):
    return S.run_to_table(S.once(_stream(spark, d), ["event_id"], late="3650 days"), *_paths(spark)).select("event_id", "user_id", "event_type")


def stream_sessions(spark, d):
    a = _stream(spark, d).select(F.col("user_id").cast("string").alias("session"), "ts", F.expr(ACTION).alias("action"))
    return S.run_to_table(S.session_events(a, timeout_ms=None), *_paths(spark))


def queries():
    return {
        "action_parse": action_parse, "menu_parse": menu_parse, "action_menu": action_menu, "lookup_specs_dedupe": specs, "nav_replay": replayed, "episode_metrics": rollup, "nav_event_log": event_log, "error_runs": errors_run,
        "stream_windowed_counts": stream_counts, "stream_dedupe": stream_once, "stream_session_state": stream_sessions,
    }


def oracle_sql():
    return {
        "action_parse": f"""with x as (select event_id, event_id % 2 = 0 as init, {ACTION} || case when event_id % 11 = 0 then ' || more' else '' end as t from events),
            y as (select *, nullif(regexp_extract(t, '(?s)^(A[0-9]+)\\s*(\\|\\|.*)?$', 1), '') as aid from x)
            select event_id, aid as action_id, case when t = 'INIT' then 'INIT' when aid = 'A0' then 'SELECT' when aid = 'A1' then 'ANSWER' end as action,
            case when t = 'INIT' then not init else coalesce(aid in ('A0', 'A1') and not contains(t, '|| more'), false) end as valid, t <> 'INIT' and aid is null as natural from y""",
        "menu_parse": "select event_id, 'A0=SELECT,A1=ANSWER,A3=ANSWER_WITH' as menu from events",
        "action_menu": """with v as (select user_id as session, event_id as ord, 's' || event_id as target from events where event_type = 'view'), o as (select * from v where ord % 3 <> 0),
            c as (select user_id as session, event_id as ord, 'e' || event_id % 20 as eid from events where event_type = 'click'), l as (select distinct session, eid from c where ord % 7 = 0),
            t as (select session, eid, min(ord) as ord from c group by all), u as (select *, row_number() over (partition by session order by ord, eid) as r from t where (session, eid) not in (select session, eid from l)),
            a as (select session, ord, target, 'SELECT' as type, 0 as p from o union all select session, ord, target, 'ANSWER_WITH', 1 from o union all select session, ord, eid, 'LOOKUP', 2 from u where r <= 4 union all select distinct session, 0, '', 'ANSWER', 3 from v)
            select session, 'A' || (row_number() over (partition by session order by p, ord, target) - 1) as action_id, type, target from a""",
        "lookup_specs_dedupe": "with e as (select user_id as session, 'e' || event_id % 9 as eid, event_id as ord, case when event_type = 'view' then 'a' || event_id end as anchor, value < 90 as low from events) select session, eid, min(ord) as ord, arg_min(anchor, ord) filter (where anchor is not null) as anchor, bool_and(low) as low_priority from e group by all",
        "episode_metrics": """with e as (select user_id, count(*) filter (where event_type <> 'error') as v, count(*) filter (where event_type = 'error') as i, count(*) filter (where event_type = 'view') as s, count(*) filter (where event_type = 'purchase') as p,
            count(*) filter (where event_type = 'click') as l, count(*) filter (where event_type = 'click' and value > 50) as ls from events group by 1)
            select count(*) as sessions, sum(v)::bigint as valid_action_id_count, round(sum(v) / (sum(v) + sum(i)), 6) as valid_action_id_rate, round(sum(i) / (sum(v) + sum(i)), 6) as env_invalid_rate, round(sum(s) / (sum(v) + sum(i)), 6) as select_rate,
            round(sum(p) / (sum(v) + sum(i)), 6) as stop_rate, round(1.0::double - count(*) filter (where p > 0) / count(*), 6) as no_stop_rate, round(sum(l) / (sum(v) + sum(i)), 6) as lookup_rate, round(sum(ls) / greatest(sum(l), 1), 6) as lookup_success_rate from e""",
        "nav_event_log": "select event_id, user_id, event_type from (select *, row_number() over (partition by user_id, event_type, date_trunc('hour', ts) order by ts, event_id) as r from events) where r = 1",
        "error_runs": "with g as (select user_id, event_type, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by ts, event_id) as g from events), r as (select user_id, g, count(*) as n from g where event_type = 'error' group by all) select user_id, max(n) as run from r group by 1",
        "stream_windowed_counts": "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events group by all",
        "stream_dedupe": "select event_id, user_id, event_type from events",
    }
