"""Batch operators on orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frame as B
from . import LINES_SQL, lines, table


def _orders(spark, d):
    return table(spark, d, "orders").select((F.col("o_orderkey")).alias("row_id"), F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))


def select(spark, d):
    return _orders(spark, d).select("row_id", "price")


def rename(spark, d):
    return _orders(spark, d).withColumnsRenamed({"price": "score", "cust": "uid"}).drop("status")


def pop(spark, d):
    rest, taken = B.pop(_orders(spark, d), ["price", "status"], "row_id")
    return rest.join(taken.where("status = 'F'"), "row_id")


def union_columns(spark, d):
    o = _orders(spark, d)
    return B.union_columns(o.select("row_id", "cust"), o.select("row_id", "cust", (F.col("price") * 2).alias("double_price")), "row_id")


def concat(spark, d):
    o = _orders(spark, d)
    return o.where("status = 'F'").unionByName(o.where("status = 'O'")).select("row_id", "status")


def repeat(spark, d):
    return B.repeat(_orders(spark, d), 3, "row_id").select("row_id", "rep", "pos")


def numbered(spark, d):
    return B.numbered(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"]).select("c_custkey", "row_id")


def chunk(spark, d):
    c = B.numbered(table(spark, d, "nation"), ["n_nationkey"])
    return B.chunk(c, 5, "row_id").groupBy("part").agg(F.count("*").alias("rows"), F.min("n_nationkey").alias("first"))


def pad(spark, d):
    n = B.numbered(table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])
    return B.pad_to_divisor(n, 8, "row_id").select("row_id", "n_name", "is_pad")


def reorder(spark, d):
    n = B.numbered(table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])
    perm = B.numbered(n.select(F.col("row_id").alias("src"), "n_name"), ["n_name"], "pos")
    return B.reorder(n, perm.select("src", "pos"), "row_id").select("row_id", "n_name")


def fold(spark, d):
    x = lines(spark, d).select(((F.col("l_orderkey") * 32) + F.col("line")).alias("row_id"), F.col("l_quantity").cast("bigint").alias("q"))
    return B.fold_rows(x, 32, "row_id", "q").select("row_id", F.array_join("q", ",").alias("q"))


def _tokens(spark, d):
    x = lines(spark, d).groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", F.col("l_quantity").cast("int").alias("q")))), lambda s: s["q"]).alias("a"))
    return x.select("l_orderkey", "a")


def eos(spark, d):
    return _tokens(spark, d).select("l_orderkey", F.array_join(B.eos_mask(F.transform("a", lambda x: x % 5), 0), "").alias("mask"))


def positions(spark, d):
    t = _tokens(spark, d).withColumn("m", F.transform("a", lambda x: (x > 10).cast("int")))
    return t.select("l_orderkey", F.array_join(B.position_ids(F.col("m")), ",").alias("pos"))


def fitted(spark, d):
    t = _tokens(spark, d)
    return t.select("l_orderkey", F.array_join(B.fit_array(F.col("a"), 4, 0, "right", True), ",").alias("cut_right"), F.array_join(B.fit_array(F.col("a"), 4, 0, "left", False), ",").alias("cut_left"))


def gathered(spark, d):
    t = _tokens(spark, d).withColumn("a", F.transform("a", lambda x: x % 4))
    return t.select("l_orderkey", F.array_join(B.gather_pads(F.col("a"), 0), ",").alias("a"))


def loss_mask(spark, d):
    """Tokens inside a span of tool output count nothing: spans are runs of lines of one order between R and the next N."""
    x = lines(spark, d).select("l_orderkey", "line", "l_returnflag")
    from ..operators.credit import latest_before

    y = latest_before(x, "l_orderkey", "line", F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")), "open")
    return y.select("l_orderkey", "line", (~F.col("open").eqNullSafe("R")).cast("int").alias("mask"))


def balance(spark, d):
    """Parts of a balanced split of the documents by length: rows and characters of each."""
    return B.balance(table(spark, d, "documents"), "doc_id", "n_chars", 8).groupBy("part").agg(F.count("*").alias("rows"), F.sum("size").alias("size"))


def imbalance(spark, d):
    x = table(spark, d, "documents").select(F.pmod("doc_id", F.lit(8)).alias("part"), F.coalesce("n_chars", F.lit(0)).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    return x.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 3).alias("mean"))


def queries():
    return {
        "frame_select": select, "frame_rename": rename, "frame_pop": pop, "frame_union_columns": union_columns, "frame_concat": concat, "frame_repeat": repeat, "frame_numbered": numbered, "frame_chunk": chunk,
        "frame_pad_divisor": pad, "frame_reorder": reorder, "frame_fold": fold, "eos_mask": eos, "position_ids": positions, "pad_truncate": fitted, "gather_pads": gathered, "loss_mask": loss_mask, "seqlen_balance": balance, "seqlen_imbalance": imbalance,
    }


_O = "(select o_orderkey as row_id, o_custkey as cust, o_totalprice as price, o_orderstatus as status from orders)"
_T = f"(select l_orderkey, list(l_quantity::int order by line) as a from {LINES_SQL} group by l_orderkey)"


def oracle_sql():
    return {
        "frame_select": f"select row_id, price from {_O}",
        "frame_rename": f"select row_id, cust as uid, price as score from {_O}",
        "frame_pop": f"select row_id, cust, price, status from {_O} where status = 'F'",
        "frame_union_columns": f"select row_id, cust, price * 2 as double_price from {_O}",
        "frame_concat": f"select row_id, status from {_O} where status in ('F', 'O')",
        "frame_repeat": f"select row_id, r::int as rep, row_id * 3 + r as pos from {_O}, range(3) t(r)",
        "frame_numbered": "select c_custkey, row_number() over (order by c_acctbal, c_custkey) - 1 as row_id from customer",
        "frame_chunk": "select (k // 5)::bigint as part, count(*) as rows, min(n_nationkey) as first from (select *, row_number() over (order by n_nationkey) - 1 as k from nation) group by 1",
        "frame_pad_divisor": "with n as (select row_number() over (order by n_nationkey) - 1 as row_id, n_name from nation) select row_id, n_name, false as is_pad from n union all select row_id + 25, n_name, true from n where row_id < 7",
        "frame_reorder": "select row_number() over (order by n_name) - 1 as row_id, n_name from nation",
        "frame_fold": f"select (l_orderkey * 32 + line) // 32 as row_id, string_agg(l_quantity::bigint::varchar, ',' order by l_orderkey * 32 + line) as q from {LINES_SQL} group by 1",
        "eos_mask": f"with t as (select l_orderkey, list_transform(a, lambda x: x % 5) as a from {_T}) select l_orderkey, array_to_string(list_transform(range(1, len(a) + 1), lambda k: case when coalesce(list_position(a, 0), 0) = 0 or k <= list_position(a, 0) then 1 else 0 end), '') as mask from t",
        "position_ids": f"with t as (select l_orderkey, list_transform(a, lambda x: case when x > 10 then 1 else 0 end) as m from {_T}) select l_orderkey, array_to_string(list_transform(range(1, len(m) + 1), lambda k: greatest(list_sum(m[1:k]) - 1, 0)::int), ',') as pos from t",
        "pad_truncate": f"select l_orderkey, array_to_string(case when len(a) > 4 then a[1:4] else list_concat(list_resize([]::int[], 4 - len(a), 0), a) end, ',') as cut_right, array_to_string(case when len(a) > 4 then a[len(a)-3:len(a)] else list_resize(a, 4, 0) end, ',') as cut_left from {_T}",
        "gather_pads": f"with t as (select l_orderkey, list_transform(a, lambda x: x % 4) as a from {_T}) select l_orderkey, array_to_string(list_concat(list_filter(a, lambda x: x = 0), list_filter(a, lambda x: x <> 0)), ',') as a from t",
        "loss_mask": f"select l_orderkey, line, case when last_value(case when l_returnflag <> 'A' then l_returnflag end ignore nulls) over (partition by l_orderkey order by line rows between unbounded preceding and 1 preceding) = 'R' then 0 else 1 end as mask from {LINES_SQL}",
        "seqlen_imbalance": "with x as (select doc_id % 8 as part, sum(coalesce(n_chars, 0))::bigint as n from documents group by 1) select min(n) as least, max(n) as most, round(avg(n), 3) as mean from x",
    }
