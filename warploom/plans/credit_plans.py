"""Structural credit on events: a user's days are episodes, the events of a day its steps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import credit as C
from . import table

#: Events of an episode, with their place t and the gain of the step; ids produced and used are made of the event ids.
_STEPS = """
select concat(user_id, ':', %(day)s) as episode, t, value as ig, event_type, (event_id %% 7) as x, (event_id %% 5) as y
from (select *, row_number() over (partition by user_id, %(day)s order by ts, event_id) - 1 as t from events)"""
#: Added before rounding, so that exact halves go up whatever the order of summation.
_UP = 1e-9
_DAY = {"day": "substr(cast(ts as string), 1, 7)"}
_DAY_SQL = {"day": "strftime(ts, '%Y-%m')"}


def steps(spark, d):
    table(spark, d, "events").createOrReplaceTempView("events")
    s = spark.sql(_STEPS % _DAY)
    x, y = F.col("x").cast("int"), F.col("y").cast("int")
    ent = lambda c: F.array(F.concat(F.lit("e"), c.cast("string")))
    return s.withColumn("t", F.col("t").cast("int")).withColumns({"produced_sids": ent(x), "consumed_sids": ent(y), "produced_entity_ids": ent(x + 10), "used_entity_ids": ent(y + 10), "surfaced_entity_ids": F.array_union(ent(x), ent(y))})


def preceding(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("o"), "event_type")
    x = C.latest_before(e, "user_id", "o", F.when(F.col("event_type") == "view", F.col("event_id")), "before")
    return C.first_after(x, "user_id", "o", F.when(F.col("event_type") == "purchase", F.col("event_id")), "after").select("event_id", "before", "after")


def frontier(spark, d):
    """The other actions open at a step are the other steps of the episode."""
    s = steps(spark, d)
    w = Window.partitionBy("episode")
    m = s.withColumn("f", F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("A"), F.col("t")).alias("k"), F.col("ig").alias("v"))).over(w))))
    a = F.concat(F.lit("A"), F.col("t"))
    info = F.col("event_type") != "error"
    return m.select("episode", "t", *[F.round(C.frontier_credit(F.col("ig"), F.col("f"), a, info, b) + _UP, 6).alias(b) for b in ("mean", "max")])


def provenance(spark, d):
    return C.provenance_edges(steps(spark, d))


def shared(spark, d):
    return C.shared_entity_edges(steps(spark, d))


def enabling(spark, d):
    s = steps(spark, d)
    return C.enabling_credit(s.select("episode", "t", "ig"), C.provenance_edges(s), 0.5).select("episode", "t", F.round(F.col("r_en") + _UP, 6).alias("r_en"))


def total(spark, d):
    s = steps(spark, d)
    e = C.enabling_credit(s.select("episode", "t", "ig"), C.provenance_edges(s), 0.5)
    j = s.join(e, ["episode", "t"]).withColumn("fr", F.col("ig") - 50)
    return j.select("episode", "t", F.round(C.total_credit(F.col("fr"), F.col("r_en"), 1.0, 1.0, True) + _UP, 6).alias("credit"))


def shapley(spark, d):
    """Values of coalitions: the product of the sums of gains and sizes of their members.

    A table of coalitions has 2^n rows, so it is made for episodes of at most MAX_SHAPLEY steps. In longer ones the value is
    that of the formula: a step that joins s others adds the sum of their gains and s + 1 times its own; the mean over all
    orders is half the sum of all gains and n / 2 times its own.
    """
    n = steps(spark, d).groupBy("episode").agg(F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("t", "ig"))).alias("a"))
    total = F.aggregate("a", F.lit(0.0), lambda s, x: s + x["ig"])
    long = n.where(F.col("n") > C.MAX_SHAPLEY).select("episode", "n", total.alias("total"), F.explode("a").alias("x"))
    long = long.select("episode", F.col("x.t").alias("t"), F.round((F.col("total") + F.col("n") * F.col("x.ig")) / 2, 5).alias("value"))
    n = n.where(F.col("n") <= C.MAX_SHAPLEY)
    v = n.select("episode", "a", F.explode(F.sequence(F.lit(0), F.expr("shiftleft(1, n)") - 1)).alias("mask"))
    inside = F.filter("a", lambda x: F.call_function("getbit", F.col("mask"), x["t"]) == 1)
    v = v.select("episode", "mask", (F.aggregate(inside, F.lit(0.0), lambda s, x: s + x["ig"]) * F.size(inside)).alias("v"))
    return C.shapley(v, n.select("episode", "n")).select("episode", F.col("i").alias("t"), F.round("value", 5).alias("value")).unionByName(long)


def spans(spark, d):
    """Credits spread over token spans: orders as rows, their lines as spans of l_quantity tokens."""
    from . import lines

    x = lines(spark, d)
    s = x.select(F.col("l_orderkey").alias("row"), F.col("line").alias("t"), (F.col("line") * 10).alias("start"), (F.col("line") * 10 + F.pmod(F.col("l_quantity").cast("int"), F.lit(4))).alias("end"), (F.col("line") * 10).alias("anchor"), F.col("l_discount").alias("credit"))
    p = C.place_on_spans(s.select("row", "t", "credit"), s.select("row", "t", "start", "end", "anchor"))
    return p.groupBy("row").agg(F.count("*").alias("tokens"), F.round(F.sum("reward"), 6).alias("total"))


def mock(spark, d):
    return table(spark, d, "eval_items").select("item_id", F.round(C.mock_score(F.col("item_text")), 6).alias("score"))


def structure(spark, d):
    s = steps(spark, d)
    e = C.provenance_edges(s).groupBy("episode").agg(F.count("*").alias("edges"))
    n = s.groupBy("episode").agg(F.count("*").alias("steps")).join(e, "episode", "left").fillna(0, ["edges"])
    return n.agg(F.count("*").alias("episodes"), F.round(F.avg("steps"), 6).alias("mean_steps"), F.round(F.avg((F.col("steps") >= 2).cast("double")), 6).alias("two_or_more"), F.sum("edges").alias("edges"))


def queries():
    return {"preceding_following": preceding, "frontier_credit": frontier, "provenance_edges": provenance, "shared_entity_edges": shared, "enabling_credit": enabling, "credit_total": total, "shapley_exact": shapley, "span_placement": spans, "mock_scores": mock, "credit_structure": structure}


_S = f"s as (select episode, t::int as t, ig, event_type, x, y from ({_STEPS % _DAY_SQL}))"
_E = """e as (select distinct episode, src, dst from (select u.episode, u.t as dst, max(m.t) as src from s u join s m on m.episode = u.episode and m.x = u.y and m.t < u.t group by u.episode, u.t))"""
#: Every way back over edges from a step u to an earlier one, with the part of the gain of u that it passes on.
_EN = """pr as (select episode, dst, count(*) as n from e group by all),
    back as (select e.episode, e.src as node, e.dst as u, 1.0::double / pr.n as w from e join pr using (episode, dst)
        union all select e.episode, e.src, back.u, back.w * 0.5 / pr.n from back join e on e.episode = back.episode and e.dst = back.node join pr on pr.episode = e.episode and pr.dst = e.dst),
    c1 as (select back.episode, back.node as t, sum(back.w * s.ig) as c from back join s on s.episode = back.episode and s.t = back.u group by all),
    k1 as (select episode, t, coalesce(c, 0) as c from s left join c1 using (episode, t))"""


def oracle_sql():
    dead = lambda x: f"(case when abs({x}) < 1e-4 then 0.0 else {x} end)"
    return {
        "preceding_following": "select event_id, last_value(case when event_type = 'view' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as before, first_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between 1 following and unbounded following) as after from events",
        "frontier_credit": f"with {_S}, p as (select a.episode, a.t, any_value(a.ig) as ig, any_value(a.event_type) as et, count(b.t) as n, avg({dead('b.ig')}) as me, max({dead('b.ig')}) as mx from s a left join s b on b.episode = a.episode and b.t <> a.t group by a.episode, a.t) select episode, t, round(case when et = 'error' or n = 0 then 0.0 else {dead(dead('ig') + ' - me')} end + {_UP}, 6)::double as mean, round(case when et = 'error' or n = 0 then 0.0 else {dead(dead('ig') + ' - mx')} end + {_UP}, 6)::double as max from p",
        "provenance_edges": f"with {_S}, {_E} select episode, src, dst from e",
        "shared_entity_edges": f"with {_S}, q as (select episode, t, x as v from s union select episode, t, y from s) select distinct a.episode, a.t as src, b.t as dst from q a join q b on a.episode = b.episode and a.v = b.v and a.t < b.t",
        "enabling_credit": f"with recursive {_S}, {_E}, {_EN} select episode, t, round(c + {_UP}, 6) as r_en from k1",
        "credit_total": f"with recursive {_S}, {_E}, {_EN} select episode, t, round(case when c > 1e-4 and ig - 50 < 0 then 0.0 else ig - 50 end + c + {_UP}, 6) as credit from k1 join s using (episode, t)",
        "shapley_exact": f"""with {_S}, z as (select episode, count(*) as n, sum(ig) as total from s group by 1), n as (select episode, n from z where n <= {C.MAX_SHAPLEY}), f as (select s.* from s join n using (episode)), m as (select episode, n, unnest(range(0, (1 << n::int))) as mask from n),
            v as (select m.episode, m.n, mask, coalesce(sum(ig) filter (where (mask >> t) & 1 = 1), 0) * count(*) filter (where (mask >> t) & 1 = 1) as v from m join f on f.episode = m.episode group by m.episode, m.n, mask)
            select a.episode, f.t, round(sum((b.v - a.v) * factorial(bit_count(a.mask)::int) * factorial((a.n - bit_count(a.mask) - 1)::int) / factorial(a.n::int)), 5)::double as value
            from v a join f on f.episode = a.episode and (a.mask >> f.t) & 1 = 0 join v b on b.episode = a.episode and b.mask = a.mask | (1 << f.t) group by a.episode, f.t
            union all select s.episode, s.t, round((z.total + z.n * s.ig) / 2, 5)::double from s join z using (episode) where z.n > {C.MAX_SHAPLEY}""",
        "span_placement": "select l_orderkey as row, sum(greatest(l_quantity::int % 4, 1))::bigint as tokens, round(sum(l_discount), 6) as total from lineitem group by 1",
        "mock_scores": "select item_id, round((list_sum(list_transform(string_split(item_text, ''), lambda c: unicode(c))) % 1000) / 1000.0, 6)::double as score from eval_items",
        "credit_structure": f"with {_S}, {_E}, n as (select episode, count(*) as steps from s group by 1), c as (select episode, count(*) as edges from e group by 1) select count(*) as episodes, round(avg(steps), 6) as mean_steps, round(avg(case when steps >= 2 then 1.0 else 0.0 end), 6) as two_or_more, sum(coalesce(edges, 0))::bigint as edges from n left join c using (episode)",
    }
