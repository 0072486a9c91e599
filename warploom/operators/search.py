"""Keyed retrieval: every operator answers many queries in one plan.

Queries are (qid, text); documents are (id, title, text). Scores are rounded to 6 places before ranking and ties go to the
smaller id. Documents without any common token rank last with score 0 rather than being dropped.

A set of at most BLOCK_QUERIES queries is shipped to the executors and scored against all documents in blocks of matrix
products: nothing but the best rows of a partition is shuffled. A larger set is joined by token. Scores within a given pool
of pairs never look at anything outside the pool.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import search_tokens
from ..session import small_side, spread

#: The largest set of queries that is shipped to the executors, how many are scored at a time, and the entries of a block's matrix.
BLOCK_QUERIES, QUERY_BLOCK, CELLS = 20_000, 512, 4_000_000


def postings(docs: DataFrame, id_col: str, text) -> DataFrame:
    """(id, token, tf)."""
    return docs.select(F.col(id_col).alias("id"), F.explode(search_tokens(text)).alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))


def norms(post: DataFrame) -> DataFrame:
    """(id, norm): length of each term vector."""
    return post.groupBy("id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))


def cosine(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, id, cos) of all pairs with a common token; queries(qid, text), docs(id, text).

    The query postings are broadcast if a count shows them small, else joined by shuffle on the token, and products are
    summed per pair before they meet.
    """
    q = postings(queries, "qid", "text").withColumnsRenamed({"id": "qid", "tf": "qtf"})
    qn = norms(q.select(F.col("qid").alias("id"), F.col("qtf").alias("tf"))).withColumnsRenamed({"id": "qid", "norm": "qnorm"})
    q = small_side(q.join(qn, "qid"), 200_000)
    d = postings(docs, "id", "text")
    s = d.join(q, "token").groupBy("qid", "qnorm", "id").agg(F.sum(F.col("tf") * F.col("qtf")).alias("dot"))
    return s.join(norms(d), "id").select("qid", "id", (F.col("dot") / (F.col("norm") * F.col("qnorm"))).alias("cos"))


def top_k(scored: DataFrame, k: int, by: str = "qid", score: str = "score", id_col: str = "id") -> DataFrame:
    """The k best rows of each key with their rank from 1; pruned per partition before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc(score), F.asc(id_col))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def with_zeros(scored: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Adds score 0 rows, in id order, for queries with fewer than k matches: the first 2k ids are enough to find k without a match."""
    few = queries.select("qid").join(scored.groupBy("qid").count(), "qid", "left").where(F.coalesce("count", F.lit(0)) < k).select("qid")
    first = docs.select("id").orderBy("id").limit(2 * k)
    fill = few.crossJoin(F.broadcast(first)).join(scored.select("qid", "id"), ["qid", "id"], "left_anti").withColumn("score", F.lit(0.0))
    return scored.select("qid", "id", "score").unionByName(fill)


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of all scores that may be among the k best once rounded to 6 places; of equal scores the k first."""
    if len(score) <= k:
        return np.arange(len(score))
    least = np.partition(score, len(score) - k)[len(score) - k]
    at = np.flatnonzero(score >= least - 1e-6)
    if len(at) > 2 * k:
        order = np.lexsort((at, -score[at]))
        s = score[at][order]
        start = np.r_[True, s[1:] != s[:-1]]
        place = np.arange(len(s)) - np.maximum.accumulate(np.where(start, np.arange(len(s)), 0))
        at = np.sort(at[order[place < k]])
    return at


def _ranker(score_block, k: int, id_type: pa.DataType, positive: bool):
    """A function for mapInArrow: score_block(batch) gives (query numbers, scores of all rows); the k best of a partition go out per query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[pa.Array, np.ndarray]] = {}
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column(0)))
            for q, scores, first in score_block(batch):
                ids = batch.column(0).slice(first, len(scores))
                if positive and not scores.any():
                    continue
                at = _best(scores, k)
                ids, scores = ids.take(pa.array(at)), scores[at]
                if q in kept:
                    ids, scores = pa.concat_arrays([kept[q][0], ids]), np.r_[kept[q][1], scores]
                    order = pc.sort_indices(ids).to_numpy()
                    ids, scores = ids.take(pa.array(order)), scores[order]
                    at = _best(scores, k)
                    ids, scores = ids.take(pa.array(at)), scores[at]
                kept[q] = (ids, scores)
        for q, (ids, scores) in kept.items():
            keep = scores > 0 if positive else np.ones(len(scores), dtype=bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(keep.sum()), q, dtype=np.int64)), ids.filter(pa.array(keep)), pa.array(scores[keep])], ["q", "id", "raw"])

    return run


def _numbered(queries: DataFrame, column: str) -> tuple[list, list] | None:
    """Ids and values of a set of queries, or None if it is larger than BLOCK_QUERIES."""
    rows = queries.select("qid", column).limit(BLOCK_QUERIES + 1).collect()
    return None if len(rows) > BLOCK_QUERIES else ([r[0] for r in rows], [r[1] for r in rows])


def _with_ids(found: DataFrame, qids: list, queries: DataFrame, k: int) -> DataFrame:
    ids = found.sparkSession.createDataFrame(list(enumerate(qids)), f"q bigint, qid {queries.schema['qid'].dataType.simpleString()}")
    return top_k(found.join(F.broadcast(ids), "q").select("qid", "id", F.round("raw", 6).alias("score")), k)


def lexical_top(queries: DataFrame, docs: DataFrame, k: int, title_boost: float = 0.0, zeros: bool = True) -> DataFrame:
    """(qid, id, score, rank): the k documents (id, text, and title if boosted) of greatest cosine of term counts.

    With title_boost the cosine of the title is added that many times. Without zeros, documents without a common token are
    left out. Null texts have no tokens.
    """
    got = _numbered(queries, "text")
    if got is None:
        s = cosine(queries, docs.select("id", "text")).withColumnRenamed("cos", "raw")
        if title_boost:
            head = cosine(queries, docs.select("id", F.col("title").alias("text")))
            s = s.join(head, ["qid", "id"], "left").withColumn("raw", F.col("raw") + title_boost * F.coalesce("cos", F.lit(0.0)))
        s = s.select("qid", "id", F.round("raw", 6).alias("score"))
        return top_k(with_zeros(s, queries, docs, k) if zeros else s, k)
    qids, texts = got
    if not qids:
        return docs.limit(0).select(F.lit(None).cast(queries.schema["qid"].dataType).alias("qid"), "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    counts = [Counter(re.findall("[a-z0-9]+", (t or "").lower())) for t in texts]
    blocks = []
    for first in range(0, len(counts), QUERY_BLOCK):
        own = counts[first : first + QUERY_BLOCK]
        vocab = {t: i for i, t in enumerate(sorted({t for c in own for t in c}))}
        cells = [(vocab[t], j, n) for j, c in enumerate(own) for t, n in c.items()]
        norm = np.sqrt([float(sum(n * n for n in c.values())) for c in own])
        blocks.append((first, vocab, np.array(cells, dtype=np.int64).reshape(-1, 3), norm))
    shared = docs.sparkSession.sparkContext.broadcast(blocks)

    def score_block(batch: pa.RecordBatch):
        columns = [[Counter(t or ()) for t in batch.column(i).to_pylist()] for i in range(1, batch.num_columns)]
        norms = [np.sqrt([float(sum(n * n for n in c.values())) for c in col]) for col in columns]
        for first, vocab, cells, norm in shared.value:
            m = np.zeros((max(1, len(vocab)), len(norm)))
            m[cells[:, 0], cells[:, 1]] = cells[:, 2]
            step = max(1, CELLS // m.shape[0])
            for at in range(0, batch.num_rows, step):
                total = None
                for col, length, weight in zip(columns, norms, (1.0, title_boost)):
                    d = np.zeros((min(step, batch.num_rows - at), m.shape[0]))
                    for i, c in enumerate(col[at : at + step]):
                        for t in c.keys() & vocab.keys():
                            d[i, vocab[t]] = c[t]
                    dots, both = d @ m, length[at : at + step, None] * norm
                    cos = np.divide(dots, both, out=np.zeros_like(dots), where=both > 0)
                    total = cos if total is None else total + weight * cos
                for j in range(len(norm)):
                    yield first + j, total[:, j], at

    cols = ["id", search_tokens("text").alias("t")] + ([search_tokens("title").alias("h")] if title_boost else [])
    id_type = docs.schema["id"].dataType
    found = spread(docs).select(*cols).mapInArrow(_ranker(score_block, k, id_type, not zeros), f"q bigint, id {id_type.simpleString()}, raw double")
    return _with_ids(found, qids, queries, k)


def search_passages(queries: DataFrame, docs: DataFrame, k: int = 5, title_boost: float = 0.25) -> DataFrame:
    """(qid, id, score, rank) by cos(query, title and text) + title_boost * cos(query, title)."""
    full = docs.select("id", "title", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))).alias("text"))
    return lexical_top(queries, full, k, title_boost)


def search_vectors(queries: DataFrame, vectors: DataFrame, k: int = 8) -> DataFrame:
    """(qid, id, score, rank) by inner product in double precision; queries(qid, vec), vectors(id, vec).

    At most BLOCK_QUERIES queries go to the executors, where each batch of vectors meets them in matrix products. Of more
    queries, blocks of QUERY_BLOCK go through the same product one after the other as rows beside the vectors' batches.
    Null vectors and vectors of another length than the first query's take no part.
    """
    got = _numbered(queries.where("vec is not null"), "vec")
    if got is None:
        n = queries.where("vec is not null").withColumn("_b", F.pmod(F.xxhash64("qid"), F.lit(-(-queries.count() // (BLOCK_QUERIES // 2)))))
        parts = [search_vectors(n.where(F.col("_b") == b).drop("_b"), vectors, k) for b in range(n.agg(F.max("_b")).first()[0] + 1)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    qids, vecs = got
    size = len(vecs[0]) if vecs else 0
    use = [i for i, v in enumerate(vecs) if len(v) == size]
    shared = vectors.sparkSession.sparkContext.broadcast(np.array([vecs[i] for i in use], dtype=np.float64).reshape(-1, size))

    def score_block(batch: pa.RecordBatch):
        m = shared.value
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, size)
        step = max(1, CELLS // QUERY_BLOCK)
        for first in range(0, len(m), QUERY_BLOCK):
            for at in range(0, batch.num_rows, step):
                scores = x[at : at + step] @ m[first : first + QUERY_BLOCK].T
                for j in range(scores.shape[1]):
                    yield first + j, np.ascontiguousarray(scores[:, j]), at

    id_type = vectors.schema["id"].dataType
    rows = vectors.where((F.size("vec") == size) & F.expr("not exists(vec, x -> x is null)")).select("id", "vec")
    found = rows.mapInArrow(_ranker(score_block, k, id_type, False), f"q bigint, id {id_type.simpleString()}, raw double")
    return _with_ids(found, [qids[i] for i in use], queries, k)


def fuse(ranked: list[tuple[str, DataFrame]], k: int = 10, c: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of named lists (qid, id, rank): (qid, id, score, source, rank)."""
    parts = [df.select("qid", "id", "rank", F.lit(name).alias("list")) for name, df in ranked]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    s = u.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (c + F.col("rank"))), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("source"))
    return top_k(s, k)


def _sentence_text(sentences: DataFrame) -> DataFrame:
    return sentences.select("id", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))).alias("text"))


def sentence_scores(queries: DataFrame, sentences: DataFrame, pool: DataFrame) -> DataFrame:
    """(qid, id, score) of the pairs pool(qid, id), 0 without a common token; sentences (id, title, text).

    Only sentences of the pool are tokenised, and only pairs of the pool are formed: the tokens of a pair's query meet the
    tokens of its own sentence.
    """
    pool = pool.select("qid", "id").distinct()
    own = _sentence_text(sentences).join(pool.select("id").distinct(), "id", "left_semi")
    d = postings(own, "id", "text")
    q = postings(queries, "qid", "text").withColumnsRenamed({"id": "qid", "tf": "qtf"})
    qn = norms(q.select(F.col("qid").alias("id"), F.col("qtf").alias("tf"))).withColumnsRenamed({"id": "qid", "norm": "qnorm"})
    s = pool.join(q, "qid").join(d, ["id", "token"]).groupBy("qid", "id").agg(F.sum(F.col("tf") * F.col("qtf")).alias("dot"))
    s = s.join(norms(d), "id").join(qn, "qid").select("qid", "id", F.round(F.col("dot") / (F.col("norm") * F.col("qnorm")), 6).alias("score"))
    return pool.join(s, ["qid", "id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def hybrid(queries: DataFrame, passages: DataFrame, sentences: DataFrame, entities: DataFrame, mentions: DataFrame, passages_read: int = 20, passages_kept: int = 5, sentence_k: int = 8, entity_k: int = 8, k: int = 8, c: int = 60) -> DataFrame:
    """First retrieval of an episode: sentences of the best passages, of the whole corpus and of the best entities, fused.

    passages(id, title, text), sentences(id, pid, title, text), entities(id, text), mentions(sid, eid). A sentence of an
    entity is ranked by its own score, then gains a quarter of the best entity score, without a new ranking.
    """
    top = search_passages(queries, passages, passages_read).where(F.col("rank") <= passages_kept)
    pool = top.select("qid", F.col("id").alias("pid")).join(sentences.select("id", "pid"), "pid").select("qid", "id")
    one = top_k(sentence_scores(queries, sentences, pool), sentence_k)
    two = lexical_top(queries, _sentence_text(sentences), sentence_k, zeros=False)
    ents = lexical_top(queries, entities.select("id", "text"), entity_k)
    named = ents.select("qid", F.col("id").alias("eid")).join(mentions, "eid").select("qid", F.col("sid").alias("id")).distinct()
    three = top_k(sentence_scores(queries, sentences, named), sentence_k)
    return fuse([("passage", one), ("sentence", two), ("entity", three)], k, c)


def capped(df: DataFrame, by: str, order: list, n: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def synonyms_of(edges: DataFrame, m: int = 5) -> DataFrame:
    """(eid, other, score): the m best synonyms of every entity, edges taken both ways."""
    e = edges.select(F.col("eid1").alias("eid"), F.col("eid2").alias("other"), "score").unionByName(edges.select(F.col("eid2").alias("eid"), F.col("eid1").alias("other"), "score"))
    best = e.groupBy("eid", "other").agg(F.max("score").alias("score"))
    return capped(best, "eid", [F.desc("score"), F.asc("other")], m)


def local_context(sentences: DataFrame, adjacent: DataFrame) -> DataFrame:
    """(sid, other, score, source): the sentence before and after in the passage (1.0) and graph neighbours (0.9); the larger score, all sources."""
    w = Window.partitionBy("pid").orderBy("pos")
    s = sentences.select("sid", F.lag("sid").over(w).alias("prev"), F.lead("sid").over(w).alias("next"))
    near = s.select("sid", F.explode(F.array(F.struct(F.col("prev").alias("other"), F.lit("prev").alias("source")), F.struct(F.col("next").alias("other"), F.lit("next").alias("source")))).alias("x")).where("x.other is not null").select("sid", "x.other", F.lit(1.0).alias("score"), "x.source")
    g = adjacent.select(F.col("sid1").alias("sid"), F.col("sid2").alias("other")).unionByName(adjacent.select(F.col("sid2").alias("sid"), F.col("sid1").alias("other"))).distinct()
    both = near.unionByName(g.select("sid", "other", F.lit(0.9).alias("score"), F.lit("graph_neighbor").alias("source")))
    return both.groupBy("sid", "other").agg(F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("source"))


def lookup_pool(targets: DataFrame, mentions: DataFrame, adjacent: DataFrame, synonyms: DataFrame, own: int = 80, per_synonym: int = 40) -> DataFrame:
    """(qid, id, kind): sentences of the target entity, of its synonyms, and the neighbours of both; the strongest kind of each.

    targets(qid, eid). The caps are part of what the operation is: the first sentences in mention order.
    """
    m = mentions.select("eid", "sid").distinct()
    a = capped(m, "eid", ["sid"], own)
    t = targets.join(a, "eid").select("qid", F.col("sid").alias("id"), F.lit(0).alias("p"))
    b = capped(m, "eid", ["sid"], per_synonym).withColumnRenamed("eid", "other")
    s = targets.join(synonyms_of(synonyms), "eid").join(b, "other").select("qid", F.col("sid").alias("id"), F.lit(1).alias("p"))
    both = t.unionByName(s)
    g = adjacent.select(F.col("sid1").alias("id"), F.col("sid2").alias("to")).unionByName(adjacent.select(F.col("sid2").alias("id"), F.col("sid1").alias("to"))).distinct()
    n = both.select("qid", "id").distinct().join(g, "id").select("qid", F.col("to").alias("id"), F.lit(2).alias("p"))
    kind = F.element_at(F.array(F.lit("target"), F.lit("similar"), F.lit("sentence_neighbor")), F.col("p") + 1)
    return both.unionByName(n).groupBy("qid", "id").agg(F.min("p").alias("p")).select("qid", "id", kind.alias("kind"))


def lookup(queries: DataFrame, targets: DataFrame, sentences: DataFrame, mentions: DataFrame, adjacent: DataFrame, synonyms: DataFrame, k: int = 6, bonus: float = 0.1) -> DataFrame:
    """(qid, id, score, kind, rank): the pool of a looked-up entity ranked for the query, target sentences with a bonus."""
    pool = lookup_pool(targets, mentions, adjacent, synonyms)
    s = sentence_scores(queries, sentences, pool.select("qid", "id")).join(pool, ["qid", "id"])
    return top_k(s.withColumn("score", F.round(F.col("score") + F.when(F.col("kind") == "target", bonus).otherwise(0.0), 6)), k)


def expand(first: DataFrame, hop: DataFrame, targets: DataFrame, sentences: DataFrame, mentions: DataFrame, adjacent: DataFrame, synonyms: DataFrame, k: int = 6) -> DataFrame:
    """Like lookup, scored 0.2 for the first question, 0.5 for the hop query and 0.3 for both together."""
    pool = lookup_pool(targets, mentions, adjacent, synonyms)
    ids = pool.select("qid", "id")
    both = first.join(hop.withColumnRenamed("text", "h"), "qid").select("qid", F.concat_ws(" ", "text", "h").alias("text"))
    s = pool
    for name, q in (("a", first), ("b", hop), ("c", both)):
        s = s.join(sentence_scores(q, sentences, ids).withColumnRenamed("score", name), ["qid", "id"])
    return top_k(s.withColumn("score", F.round(0.2 * F.col("a") + 0.5 * F.col("b") + 0.3 * F.col("c") + F.when(F.col("kind") == "target", 0.1).otherwise(0.0), 6)), k)


def bridges(selected: DataFrame, queries: DataFrame, entities: DataFrame, mentions: DataFrame, adjacent: DataFrame, synonyms: DataFrame, k: int = 8, c: int = 60) -> DataFrame:
    """(qid, id, source, reasons, score, rank): entities that lead on from the entities of selected sentences (qid, sid).

    Reasons by priority: selected_sentence, co_sentence, sentence_neighbor, synonym_entity; only the first two may lead
    to an entity already among the sources. The structural rank by priority, number of reasons, semantic rank and id is
    fused with the rank of the entity for the question.
    """
    m = mentions.select("eid", "sid").distinct()
    src = selected.join(m, "sid").select("qid", F.col("eid").alias("source")).distinct()
    here = selected.join(m, "sid").select("qid", F.col("eid").alias("id"), "sid")
    sel = src.join(here.select("qid", "id"), "qid").select("qid", "source", "id", F.lit(0).alias("p"), F.lit("selected_sentence").alias("reason"))
    said = src.join(capped(m, "eid", ["sid"], 80).withColumnRenamed("eid", "source"), "source")
    co = said.join(m, "sid").select("qid", "source", F.col("eid").alias("id"), F.lit(1).alias("p"), F.lit("co_sentence").alias("reason"))
    g = adjacent.select(F.col("sid1").alias("sid"), F.col("sid2").alias("to")).unionByName(adjacent.select(F.col("sid2").alias("sid"), F.col("sid1").alias("to"))).distinct()
    nb = said.join(g, "sid").join(m.withColumnRenamed("sid", "to"), "to").select("qid", "source", F.col("eid").alias("id"), F.lit(2).alias("p"), F.lit("sentence_neighbor").alias("reason"))
    sy = src.join(synonyms_of(synonyms).withColumnRenamed("eid", "source"), "source").select("qid", "source", F.col("other").alias("id"), F.lit(3).alias("p"), F.lit("synonym_entity").alias("reason"))
    far = nb.unionByName(sy).join(src.select("qid", F.col("source").alias("id")), ["qid", "id"], "left_anti").select("qid", "source", "id", "p", "reason")
    every = sel.unionByName(co).unionByName(far).where("id <> source")
    pair = every.groupBy("qid", "id").agg(F.min("p").alias("p"), F.count_distinct("reason").alias("n"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"), F.min("source").alias("source"))
    sem = lexical_top(queries, entities.select("id", "text"), max(4 * k, 16), zeros=False).select("qid", "id", F.col("rank").alias("sem"))
    j = pair.join(sem, ["qid", "id"], "left")
    w = Window.partitionBy("qid").orderBy("p", F.desc("n"), F.asc_nulls_last("sem"), "id")
    r = j.withColumn("st", F.row_number().over(w))
    return top_k(r.withColumn("score", F.round(1.0 / (c + F.col("st")) + F.coalesce(1.0 / (c + F.col("sem")), F.lit(0.0)), 6)), k).select("qid", "id", "source", "reasons", "score", "rank")
