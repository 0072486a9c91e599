"""Queries over the test tables, each beside the SQL that states its result."""


def table(spark, d: str, name: str):
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Line numbers repeat within an order of the test tables: the position of a line is its place in this order.
LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity"
LINES_SQL = f"(select *, row_number() over (partition by l_orderkey order by {LINE_ORDER})::int as line from lineitem)"


def lines(spark, d: str):
    """lineitem with the column ``line``."""
    return table(spark, d, "lineitem").selectExpr("*", f"cast(row_number() over (partition by l_orderkey order by {LINE_ORDER}) as int) as line")
