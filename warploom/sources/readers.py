"""Readers of corpora, question sets, logs and graph folders. Schemas are given or read once; nothing is pulled to the driver."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import corpus as C

#: Places a corpus of a data source is looked for, relative to a root, first match wins.
CANDIDATES = ("{ds}/corpus.jsonl", "{ds}/corpus.json", "{ds}.jsonl", "{ds}.json", "{ds}/corpus.parquet", "{ds}.parquet")
CORPUS = T.StructType([T.StructField(c, T.StringType()) for c in dict.fromkeys((*C.ID_FIELDS, *C.TITLE_FIELDS, *C.TEXT_FIELDS, *C.QA_FIELDS))])


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def find_corpus(spark: SparkSession, root: str, data_source: str, path: str | None = None) -> str:
    """The given path, else the first candidate under root that exists; an error if there is none."""
    tried = [path] if path else [f"{root}/{c.format(ds=data_source)}" for c in CANDIDATES]
    for p in tried:
        if exists(spark, p):
            return p
    raise FileNotFoundError(f"no corpus at {', '.join(tried)}")


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON lines, or one JSON document: a list of objects, an object with a list under ``data``, or objects by key (the key becomes ``id``)."""
    schema = schema or CORPUS
    if PurePosixPath(path).suffix == ".jsonl":
        return spark.read.schema(schema).json(path)
    raw = spark.read.text(path, wholetext=True).select("value")
    kind = F.left(F.ltrim("value"), F.lit(1))
    row = schema.simpleString()
    data = F.get_json_object("value", "$.data")
    listed = F.when(kind == "[", F.col("value")).when(F.startswith(F.ltrim(data), F.lit("[")), data)
    rows = raw.withColumn("l", listed)
    a = rows.where("l is not null").select(F.explode(F.from_json("l", f"array<{row}>")).alias("r")).select("r.*")
    keyed = rows.where("l is null").select(F.explode(F.from_json("value", f"map<string,{row}>")).alias("k", "r"))
    own = [F.coalesce("r.id", "k").alias("id") if f.name == "id" else F.col(f"r.`{f.name}`").alias(f.name) for f in schema.fields]
    return a.unionByName(keyed.select(*own))


def read_corpus(spark: SparkSession, path: str, max_docs: int | None = None) -> DataFrame:
    """(doc_id, title, text, source) of a corpus file; rows that give no record are tried as questions with contexts."""
    df = spark.read.parquet(path) if path.endswith(".parquet") else read_json(spark, path)
    out = C.records(df, path)
    qa = [c for c in C.QA_FIELDS if c in df.columns]
    if qa:
        plain = C.first_field(df, C.TEXT_FIELDS)
        rest = df.where(plain == "")
        out = out.unionByName(C.context_records(rest).withColumn("source", F.lit(path)))
    return out.orderBy("doc_id").limit(max_docs) if max_docs is not None else out


def read_prompts(spark: SparkSession, paths: list[str], prompt: str = "prompt", max_words: int | None = None) -> DataFrame:
    """Several Parquet files as one, without rows whose prompt has more words than allowed."""
    df = spark.read.option("mergeSchema", "true").parquet(*paths)
    return df.where(F.size(F.split(F.col(prompt).cast("string"), r"\s+")) <= max_words) if max_words is not None else df


def read_nested(df: DataFrame, key: str) -> DataFrame:
    """A value below nested keys, written a.b.c, as one column."""
    return df.select(F.col(key).alias(key.rsplit(".", 1)[-1]))


def read_evals(spark: SparkSession, glob: str) -> DataFrame:
    """Evaluation files with the step in their name (…_123.json) as the column ``step``."""
    return spark.read.json(glob).withColumn("step", F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\D*$", 1).cast("int"))


def read_vectors(df: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Rows joined with their vectors; rows without one raise an error, as a matrix of another length would."""
    j = df.join(vectors, key, "left")
    col = next(c for c in vectors.columns if c != key)
    return j.withColumn(col, F.when(F.col(col).isNull(), F.raise_error(F.lit("row without a vector")).cast(dict(vectors.dtypes)[col])).otherwise(F.col(col)))
