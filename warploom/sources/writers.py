"""Sinks: tables with stated columns, graph folders, JSON lines, append logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph

TABLES = {
    "passages": "pid doc_id title text sent_ids", "sentences": "sid pid doc_id title text pos", "entities": "eid canonical label labels surface_forms", "mentions": "mid pid sid eid surface canonical label",
    "adjacent": "sid1 sid2 relation weight undirected", "synonyms": "eid1 eid2 score method reason lexical_overlap canonical1 canonical2 undirected",
}


def write_table(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "overwrite") -> None:
    (df.select(*columns) if columns else df).write.mode(mode).parquet(path)


def save_graph(g: Graph, path: str) -> None:
    """Every table under its own folder; a table that is not there any more is not left behind."""
    for name, cols in TABLES.items():
        df = getattr(g, name)
        if df is not None:
            write_table(df, f"{path}/{name}", cols.split())
        else:
            p = df_path(path, name)
            spark = g.passages.sparkSession
            h = spark._jvm.org.apache.hadoop.fs.Path(p)
            h.getFileSystem(spark._jsc.hadoopConfiguration()).delete(h, True)


def df_path(path: str, name: str) -> str:
    return f"{path}/{name}"


def load_graph(spark: SparkSession, path: str) -> Graph:
    """A saved graph; mentions of unknown passages, sentences or entities are left out."""
    from .readers import exists

    read = lambda n: spark.read.parquet(df_path(path, n)) if exists(spark, df_path(path, n)) else None
    p, s, e, m = (read(n) for n in ("passages", "sentences", "entities", "mentions"))
    for df, key in ((p, "pid"), (s, "sid"), (e, "eid")):
        m = m.join(df.select(key), key, "left_semi")
    return Graph(p, s, e, m.select(*TABLES["mentions"].split()), read("adjacent"), read("synonyms"))


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to a JSON log."""
    df.write.mode("append").json(path)


def to_json_results(df: DataFrame, key: str) -> DataFrame:
    """(key, results): the other columns of all rows of a key as one JSON string, ordered by rank if there is one."""
    cols = [c for c in df.columns if c != key]
    order = [c for c in ("rank",) if c in cols]
    row = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in cols if c not in order])
    return df.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(row))).alias("results"))


def qa_rows(df: DataFrame, template: str, split: str) -> DataFrame:
    """Training rows: prompt messages made of a template with {question}, reward model and extra information."""
    q = F.replace(F.lit(template), F.lit("{question}"), F.coalesce("question", F.lit("")))
    return df.select(
        "data_source", F.array(F.struct(F.lit("user").alias("role"), q.alias("content"))).alias("prompt"), F.lit("multihop_qa").alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.col("golden_answers").alias("ground_truth")).alias("reward_model"), F.struct(F.lit(split).alias("split"), F.col("question")).alias("extra_info"),
    )


def report(manifest: DataFrame) -> str:
    """A manifest row as a short Markdown table."""
    r = manifest.first().asDict()
    return "\n".join(["| table | rows |", "|---|---|", *(f"| {k} | {v} |" for k, v in r.items())])
