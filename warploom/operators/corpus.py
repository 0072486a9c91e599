"""From raw records to a normalised corpus (doc_id, title, text, source) and its chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_ws

#: Field names read for text, title and id, in this order.
TEXT_FIELDS = ("contents", "text", "paragraph", "passage", "context")
TITLE_FIELDS = ("title", "document_title")
ID_FIELDS = ("id", "doc_id", "_id")
QA_FIELDS = ("contexts", "ctxs", "context", "paragraphs", "supporting_facts", "evidences")


def first_field(df: DataFrame, fields: tuple[str, ...], default: str | None = "") -> Column:
    """The first of several columns that is neither null nor empty, as a string; columns that df lacks are passed over."""
    own = [F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")) for c in fields if c in df.columns]
    return F.coalesce(*own, F.lit(default).cast("string"))


def packed_documents(raw: Column) -> Column:
    """array<struct<title, text>> of a field that may hold several documents.

    With two or more lines that are a title in quotes, each begins a document; else every line with text is one; else
    the field as a whole. Null and empty fields hold none.
    """
    lines = F.split(raw, "\n")
    title = r'^\s*"([^"]{1,90})"\s*$'
    none = F.array().cast("array<struct<title:string,text:string>>")
    zero = F.struct(F.lit(None).cast("string").alias("title"), F.array().cast("array<string>").alias("body"), none.alias("out"))

    def done(s: Column) -> Column:
        return F.when(s["title"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(s["title"].alias("title"), F.array_join(s["body"], " ").alias("text")))))

    def step(s: Column, x: Column) -> Column:
        new = F.struct(F.trim(F.regexp_extract(x, title, 1)).alias("title"), F.array().cast("array<string>").alias("body"), done(s).alias("out"))
        return F.when(x.rlike(title), new).otherwise(F.struct(s["title"].alias("title"), F.concat(s["body"], F.array(x)).alias("body"), s["out"].alias("out")))

    titled = F.aggregate(lines, zero, step, done)
    filled = F.filter(lines, lambda x: F.trim(x) != "")
    plain = F.transform(filled, lambda x: F.struct(F.lit("").alias("title"), x.alias("text")))
    whole = F.array(F.struct(F.lit("").alias("title"), raw.alias("text")))
    many = F.size(F.filter(lines, lambda x: x.rlike(title))) >= 2
    return F.when(raw.isNull() | (raw == ""), none).when(many, titled).when(F.size(filled) >= 2, plain).otherwise(whole)


def records(df: DataFrame, source: str = "") -> DataFrame:
    """(doc_id, title, text, source) of rows with any of the known field names; several documents of a row get ids id__k.

    Rows without an id get one from a hash of all their values. Documents without text are left out.
    """
    rid = F.coalesce(F.nullif(first_field(df, ID_FIELDS), F.lit("")), F.hex(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns])))
    base = df.select(rid.alias("rid"), first_field(df, TITLE_FIELDS).alias("rt"), packed_documents(first_field(df, TEXT_FIELDS)).alias("docs"))
    each = base.select("rid", "rt", F.size("docs").alias("n"), F.posexplode("docs").alias("k", "d"))
    doc_id = F.when(F.col("n") > 1, F.concat_ws("__", "rid", "k")).otherwise(F.col("rid"))
    title = normalize_ws(F.coalesce(F.nullif(F.col("d.title"), F.lit("")), "rt"))
    return each.select(doc_id.alias("doc_id"), title.alias("title"), normalize_ws("d.text").alias("text"), F.lit(source).alias("source")).where("text <> ''")


def context_records(df: DataFrame, fields: tuple[str, ...] = QA_FIELDS) -> DataFrame:
    """(doc_id, title, text) of the context fields of question rows, held as JSON strings.

    A context is a string, an object with a title and a text field, a pair [title, sentences], or a list of these.
    """
    have = [c for c in fields if c in df.columns]
    rid = first_field(df, ID_FIELDS, "q")
    if not have:
        return df.select(rid.alias("doc_id"), F.lit("").alias("title"), F.lit("").alias("text")).limit(0)
    raw = df.select(rid.alias("rid"), F.explode(F.array(*[F.col(c).cast("string") for c in have])).alias("j")).where("j is not null and j <> ''")
    items = raw.select("rid", F.posexplode(F.coalesce(F.from_json("j", "array<string>"), F.array("j"))).alias("k", "x"))
    obj = F.from_json("x", "map<string,string>")
    pair = F.from_json("x", "array<string>")
    is_obj, is_pair = F.col("x").startswith("{"), F.col("x").startswith("[")
    body = F.try_element_at(pair, F.lit(2))
    joined = F.coalesce(F.array_join(F.from_json(body, "array<string>"), " "), body)
    text = F.when(is_obj, F.coalesce(*[obj[c] for c in TEXT_FIELDS])).when(is_pair, joined).otherwise(F.col("x"))
    title = F.when(is_obj, F.coalesce(*[obj[c] for c in TITLE_FIELDS], F.lit(""))).when(is_pair, F.try_element_at(pair, F.lit(1))).otherwise(F.lit(""))
    return items.select(F.concat_ws("__", "rid", "k").alias("doc_id"), normalize_ws(title).alias("title"), normalize_ws(text).alias("text")).where("text <> ''")


def sliding_chunks(df: DataFrame, doc_id: str, text: str, size: int = 1200, overlap: int = 100) -> DataFrame:
    """(doc_id, chunk, start, n_tokens, text): pieces of at most ``size`` words, one every size - overlap words.

    The last piece may be nothing but overlap. Null and blank texts have none.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    w = df.select(F.col(doc_id).alias("doc_id"), F.filter(F.split(normalize_ws(text), " "), lambda x: x != "").alias("w")).where(F.size("w") > 0)
    s = w.select("doc_id", "w", F.posexplode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(size - overlap))).alias("chunk", "start"))
    piece = F.slice("w", F.col("start") + 1, size)
    return s.select("doc_id", "chunk", "start", F.size(piece).alias("n_tokens"), F.array_join(piece, " ").alias("text"))


def sampled(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a seeded hash of the key: the same rows every time."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)
