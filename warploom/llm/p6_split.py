"""Problem 6: splitting oversized items at natural boundaries.

Method: balanced targets. For a text of T tokens, limit L and overlap V the smallest possible number of pieces is
n = ceil((T - V) / (L - V)). The n - 1 inner cuts get equally spaced targets; each is moved to the strongest boundary
near by (section, paragraph, line or list item, sentence, clause, any token). If a piece gets too long, the cut is
moved back inside what the limit allows; if the last piece is still too long, n is raised by one and all is done again.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_side
from .tokens import TOKEN, n_tokens

#: How far a cut may move from its target, as a part of a piece.
REACH = 0.25
SECTION, PARAGRAPH, LINE, SENTENCE, CLAUSE = 5, 4, 3, 2, 1
_GAP = re.compile(r"\n\s*(?:==|#)")


def strengths(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """strengths[k]: how strong the boundary before token k is; 0 inside a sentence. Token 0 has none."""
    out = [0] * len(spans)
    for k in range(1, len(spans)):
        end, begin = spans[k - 1][1], spans[k][0]
        if begin == end:
            continue
        gap = text[end:begin]
        last = text[end - 1]
        if "\n" in gap or "\r" in gap:
            two = gap.replace("\r\n", "\n").replace("\r", "\n").count("\n") >= 2
            out[k] = SECTION if text.startswith(("==", "#"), begin) else PARAGRAPH if two else LINE
        elif last in ".!?…。！？" or (last in "\"'»”)" and text[end - 2 : end - 1] in (".", "!", "?", "…")):
            out[k] = SENTENCE
        elif last in ",;:":
            out[k] = CLAUSE
    return out


def cut_points(n_tok: int, limit: int, overlap: int, strength: list[int]) -> list[tuple[int, int]]:
    """Pieces [start, end) in tokens: at most limit tokens each, together all tokens, each repeating overlap tokens of the one before."""
    if n_tok <= limit:
        return [(0, n_tok)] if n_tok else []
    overlap = max(0, min(overlap, limit - 1))
    n = max(2, math.ceil((n_tok - overlap) / (limit - overlap)))
    while True:
        step = (n_tok - overlap) / n
        reach = max(1, math.ceil(step * REACH))
        cuts, begin = [], 0
        for i in range(1, n):
            target = round(overlap + i * step)
            # the rest must still fit into the n - i pieces that follow
            low = max(begin + overlap + 1, n_tok - (n - i) * (limit - overlap))
            high = min(begin + limit, n_tok - 1)
            if low > high:
                break
            target = min(max(target, low), high)
            near = range(max(low, target - reach), min(high, target + reach) + 1)
            cut = max(near, key=lambda k: (strength[k], -abs(k - target), -k))
            cuts.append(cut)
            begin = cut - overlap
        if len(cuts) == n - 1 and n_tok - begin <= limit:
            starts = [0, *(c - overlap for c in cuts)]
            return list(zip(starts, [*cuts, n_tok]))
        n += 1


SCHEMA = "doc_id bigint, corpus_id string, piece int, pieces int, start int, end int, n_tokens int, overlap int, boundary int, text string"


def limits(manifest: DataFrame) -> DataFrame:
    """One row per corpus_id: the limit and overlap of its latest row that has a limit; a null overlap counts as 0."""
    m = manifest.where("corpus_id is not null and max_token_size is not null and max_token_size > 0")
    newest = F.max_by(F.struct("max_token_size", "overlap_token_size"), F.struct("built_at", "loaded_at", "max_token_size"))
    return m.groupBy("corpus_id").agg(newest.alias("m")).select("corpus_id", F.col("m.max_token_size").alias("max_tokens"), F.coalesce("m.overlap_token_size", F.lit(0)).alias("overlap"))


def oversized(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """The documents with more tokens than their corpus allows, with limit and overlap.

    The manifest has one row for many documents; it is broadcast if a count shows that it is small, so that no text is
    shuffled, and else joined by shuffle. Documents without a corpus, a limit or a text are not oversized.
    """
    d = docs.select("doc_id", "corpus_id", "text").where("corpus_id is not null and text is not null")
    return d.join(small_side(limits(manifest)), "corpus_id").withColumn("tokens", n_tokens("text")).where("tokens > max_tokens")


def split(over: DataFrame) -> DataFrame:
    """The pieces of documents with columns doc_id, corpus_id, text, max_tokens and overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, corpus, text, limit, overlap in zip(*(b.column(i).to_pylist() for i in range(5))):
                spans = [m.span() for m in TOKEN.finditer(text)]
                strength = strengths(text, spans)
                parts = cut_points(len(spans), limit, overlap, strength)
                for k, (s, e) in enumerate(parts):
                    a, z = spans[s][0], spans[e - 1][1]
                    lap = parts[k - 1][1] - s if k else 0
                    out.append((doc, corpus, k, len(parts), a, z, e - s, lap, strength[e] if e < len(spans) else SECTION, text[a:z]))
            types = (pa.int64(), pa.string(), *[pa.int32()] * 7, pa.string())
            cols = list(zip(*out)) or [()] * 10
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [x.split()[0] for x in SCHEMA.split(", ")])

    return over.select(F.col("doc_id").cast("bigint").alias("doc_id"), "corpus_id", "text", F.col("max_tokens").cast("int"), F.col("overlap").cast("int")).mapInArrow(run, SCHEMA)


def pieces(spark, d: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    return split(oversized(read("documents"), read("corpus_manifest")))


def found(spark, d: str) -> DataFrame:
    return pieces(spark, d).where("piece = 0 and pieces > 1").select("doc_id")


def report(spark, d: str) -> DataFrame:
    """Per corpus of the manifest: documents split, their pieces, the largest piece, and the newest stated num_chunks."""
    m = spark.read.parquet(f"{d}/corpus_manifest.parquet").where("corpus_id is not null")
    said = m.groupBy("corpus_id").agg(F.max_by("num_chunks", F.struct("built_at", "loaded_at")).alias("num_chunks"))
    own = pieces(spark, d).groupBy("corpus_id").agg(F.count_if(F.col("piece") == 0).alias("documents"), F.count("*").alias("pieces"), F.max("n_tokens").alias("longest"))
    return said.join(own, "corpus_id", "left").fillna(0, ["documents", "pieces", "longest"])


_TOK = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{1C}-\x{1F}\x{85}\p{Z}]"
FOUND_SQL = f"""
WITH m AS (SELECT corpus_id, arg_max(max_token_size, (built_at, loaded_at, max_token_size)) AS most
           FROM corpus_manifest WHERE corpus_id IS NOT NULL AND max_token_size > 0 GROUP BY corpus_id)
SELECT d.doc_id FROM documents d JOIN m USING (corpus_id)
WHERE d.text IS NOT NULL AND len(regexp_extract_all(d.text, '{_TOK}')) > m.most
"""
