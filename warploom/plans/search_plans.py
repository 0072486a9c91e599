"""Retrieval queries: evaluation items as questions, documents as passages, entity_store as entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import search as S
from ..session import materialize, spread
from . import table
from .corpus_plans import _NORM, _TOK, _sentences_sql


def questions(spark, d):
    """The items, whole."""
    return table(spark, d, "eval_items").select(F.col("item_id").alias("qid"), F.col("item_text").alias("text"))


def passages(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))


def doc_sentences(spark, d, only=None):
    """Sentences of all documents, or of those with an id in only(pid): texts are split after that join."""
    x = table(spark, d, "documents").withColumnRenamed("doc_id", "pid")
    x = x if only is None else x.join(only.select("pid").distinct(), "pid", "left_semi")
    x = spread(x).select("pid", F.posexplode(T.sentences("text")).alias("pos", "text"))
    return x.select(F.concat(F.col("pid"), F.lit(":"), F.lpad("pos", 5, "0")).alias("id"), "pid", "pos", F.lit("").alias("title"), "text")


def entities(spark, d):
    e = table(spark, d, "entity_store").where("canonical is not null").groupBy("eid").agg(F.min("canonical").alias("text"))
    return e.select(F.col("eid").alias("id"), "text")


def lexical(spark, d):
    return S.lexical_top(questions(spark, d), passages(spark, d), 8).select("qid", "id", "score", "rank")


def boosted(spark, d):
    return S.search_passages(questions(spark, d), passages(spark, d), 5).select("qid", "id", "score", "rank")


def two_stage(spark, d):
    q = questions(spark, d)
    top = materialize(S.search_passages(q, passages(spark, d), 5).select("qid", F.col("id").alias("pid")), "twostage")
    s = materialize(doc_sentences(spark, d, top), "twostage")
    pool = top.join(s.select("id", "pid"), "pid").select("qid", "id")
    return S.top_k(S.sentence_scores(q, s, pool), 8).select("qid", "id", "score", "rank")


def entity_search(spark, d):
    return S.lexical_top(questions(spark, d), entities(spark, d), 8).select("qid", "id", "score", "rank")


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def dense(spark, d):
    v = _vectors(spark, d)
    return S.search_vectors(v.where("id % 100 = 0").withColumnsRenamed({"id": "qid"}), v, 8).select("qid", "id", "score", "rank")


def dense_single(spark, d):
    v = _vectors(spark, d)
    return S.search_vectors(v.where("id = 1").withColumnsRenamed({"id": "qid"}), v, 10).select("id", "score", "rank")


def dense_pairs(spark, d):
    from ..functions.scores import dot

    v = _vectors(spark, d)
    w = v.select((F.col("id") - 1).alias("id"), F.col("vec").alias("other"))
    return v.join(w, "id").select("id", F.round(dot("vec", "other"), 6).alias("score"))


def rrf(spark, d):
    q, p = questions(spark, d), passages(spark, d)
    a = S.lexical_top(q, p, 8)
    b = S.lexical_top(q, p.select("id", F.col("title").alias("text")), 8, zeros=False)
    return S.fuse([("text", a), ("title", b)], 6).select("qid", "id", "score", "source", "rank")


def local_context(spark, d):
    s = doc_sentences(spark, d).withColumnRenamed("id", "sid")
    return S.local_context(s, G.adjacency(s))


def synonym_topm(spark, d):
    e = table(spark, d, "entity_to_synonym_entities").where("eid1 is not null and eid2 is not null and score is not null and eid1 <> eid2")
    return S.synonyms_of(e.select("eid1", "eid2", "score"), 5).select("eid", "other", F.round("score", 6).alias("score"))


def mixquery(spark, d):
    x = table(spark, d, "qa_train").select("qa_id", "question", F.array_join("supporting_evidence", " ").alias("ev")).distinct()
    return x.select("qa_id", T.mixquery("question", "ev", 24).alias("mix"))


def display(spark, d):
    x = table(spark, d, "documents")
    return x.select("doc_id", F.left(T.display_line("title", "text"), F.lit(60)).alias("line"), T.preview("text", 6).alias("preview"))


def _graph(spark, d):
    x = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), "text")
    return G.settled(G.build(x))


def _names(g):
    return g.entities.select(F.col("eid").alias("id"), F.concat_ws(" ", "canonical", F.array_join("surface_forms", " ")).alias("text"))


def _sent(g):
    return g.sentences.select(F.col("sid").alias("id"), "pid", "title", "text")


def _synonyms(g):
    return materialize(G.synonym_edges(g.entities.select("eid", "canonical", "label", F.lit(None).cast("array<string>").alias("surface_forms"))), "synonyms")


def hybrid(spark, d):
    g = _graph(spark, d)
    return S.hybrid(questions(spark, d), g.passages.select(F.col("pid").alias("id"), "title", "text"), _sent(g), _names(g), g.mentions.select("sid", "eid"))


def _targets(g):
    """A stated set of entities, those whose hashed id is divisible by 100, each with its name as the question."""
    return g.entities.where(F.pmod(F.xxhash64("eid"), F.lit(100)) == 0).select(F.col("eid").alias("qid"), "eid", F.col("canonical").alias("text"))


def lookup(spark, d):
    g = _graph(spark, d)
    t = _targets(g)
    return S.lookup(t.select("qid", "text"), t.select("qid", "eid"), _sent(g), g.mentions, g.adjacent, _synonyms(g))


def expand(spark, d):
    g = _graph(spark, d)
    t = _targets(g)
    hop = t.select("qid", F.concat(F.lit("the history of "), F.col("text")).alias("text"))
    return S.expand(t.select("qid", "text"), hop, t.select("qid", "eid"), _sent(g), g.mentions, g.adjacent, _synonyms(g))


def bridges(spark, d):
    g = _graph(spark, d)
    t = _targets(g)
    return S.bridges(t.join(g.mentions, "eid").select("qid", "sid").distinct(), t.select("qid", "text"), _names(g), g.mentions, g.adjacent, _synonyms(g))


def queries():
    return {
        "lexical_topk": lexical, "passage_topk_title_boost": boosted, "two_stage_retrieve": two_stage, "entity_search": entity_search, "dense_topk_batch": dense, "dense_topk_single": dense_single, "dense_pair_score": dense_pairs,
        "rrf_fusion": rrf, "local_context": local_context, "synonym_topm": synonym_topm, "mixquery": mixquery, "display_lines": display, "hybrid_init_batch": hybrid, "lookup_ranked": lookup, "expand_ranked": expand, "bridge_candidates": bridges,
    }


_Q = f"qt as (select item_id as qid, unnest({_TOK % 'item_text'}) as token from eval_items), q as (select qid, token, count(*) as qtf from qt group by all), qn as (select qid, sqrt(sum(qtf * qtf)) as qnorm from q group by qid)"


def _cos(name, source):
    """CTEs: cosine of all pairs with a common token; source gives (id, text)."""
    return f"""{name}_t as (select id, unnest({_TOK % 'text'}) as token from ({source})), {name}_p as (select id, token, count(*) as tf from {name}_t group by all), {name}_n as (select id, sqrt(sum(tf * tf)) as norm from {name}_p group by id),
        {name} as (select qid, id, sum(tf * qtf) / (any_value(norm) * any_value(qnorm)) as cos from {name}_p join q using (token) join {name}_n using (id) join qn using (qid) group by qid, id)"""


def _zero(scores, docs, k):
    """CTE zz: scores with 0 for all other pairs."""
    return f"zz as (select qid, id, coalesce(score, 0) as score from (select qid from qn) a cross join (select id from {docs}) b left join {scores} using (qid, id))"


_TOP = "select * from (select qid, id, score, row_number() over (partition by qid order by score desc, id)::int as rank from zz) where rank <= {k}"
_DOCS = "(select doc_id as id, coalesce(title, '') as title, coalesce(text, '') as text from documents)"
_SENT = f"(select pid || ':' || lpad(pos::varchar, 5, '0') as id, pid, pos, text from (select doc_id as pid, unnest(s) as text, generate_subscripts(s, 1) - 1 as pos from (select doc_id, {_sentences_sql('text')} as s from documents where text is not null)))"
_BOOST = f"{_Q}, {_cos('c', f'select id, title || chr(32) || text as text from {_DOCS}')}, {_cos('h', f'select id, title as text from {_DOCS}')}, sc as (select qid, id, round(c.cos + 0.25 * coalesce(h.cos, 0), 6) as score from c left join h using (qid, id))"


def oracle_sql():
    return {
        "lexical_topk": f"with {_Q}, {_cos('c', f'select id, text from {_DOCS}')}, sc as (select qid, id, round(cos, 6) as score from c), {_zero('sc', _DOCS, 8)} {_TOP.format(k=8)}",
        "passage_topk_title_boost": f"with {_BOOST}, {_zero('sc', _DOCS, 5)} {_TOP.format(k=5)}",
        "two_stage_retrieve": f"""with {_BOOST}, {_zero('sc', _DOCS, 5)}, best as ({_TOP.format(k=5)}), pool as (select qid, s.id, s.text from best join {_SENT} s on s.pid = best.id), {_cos('e', 'select distinct id, text from pool')},
            z2 as (select qid, id, coalesce(round(cos, 6), 0) as score from pool left join e using (qid, id)) {_TOP.format(k=8).replace('zz', 'z2')}""",
        "entity_search": f"with e as (select eid as id, min(canonical) as text from entity_store where canonical is not null group by eid), {_Q}, {_cos('c', 'select id, text from e')}, sc as (select qid, id, round(cos, 6) as score from c), {_zero('sc', 'e', 8)} {_TOP.format(k=8)}",
        "dense_topk_batch": "with s as (select a.vec_id as qid, b.vec_id as id, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings a, embeddings b where a.vec_id % 100 = 0) select * from (select *, row_number() over (partition by qid order by score desc, id)::int as rank from s) where rank <= 8",
        "dense_topk_single": "with s as (select b.vec_id as id, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings a, embeddings b where a.vec_id = 1) select * from (select *, row_number() over (order by score desc, id)::int as rank from s) where rank <= 10",
        "dense_pair_score": "select a.vec_id as id, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings a join embeddings b on b.vec_id = a.vec_id + 1",
        "rrf_fusion": f"""with {_Q}, {_cos('c', f'select id, text from {_DOCS}')}, sc as (select qid, id, round(cos, 6) as score from c), {_zero('sc', _DOCS, 8)}, a as ({_TOP.format(k=8)}), {_cos('h', f'select id, title as text from {_DOCS}')},
            z2 as (select qid, id, round(cos, 6) as score from h), b as ({_TOP.format(k=8).replace('zz', 'z2')}), u as (select qid, id, rank, 'text' as list from a union all select qid, id, rank, 'title' from b),
            z3 as (select qid, id, round(sum(1.0 / (60 + rank)), 6)::double as score, string_agg(list, ',' order by list) as source from u group by qid, id)
            select * from (select *, row_number() over (partition by qid order by score desc, id)::int as rank from z3) where rank <= 6""",
        "local_context": f"""with s as (select id as sid, lag(id) over w as p, lead(id) over w as n from {_SENT} window w as (partition by pid order by pos))
            select sid, p as other, 1.0::double as score, 'graph_neighbor,prev' as source from s where p is not null union all select sid, n, 1.0::double, 'graph_neighbor,next' from s where n is not null""",
        "synonym_topm": "with e as (select eid1, eid2, score from entity_to_synonym_entities where eid1 is not null and eid2 is not null and score is not null and eid1 <> eid2), u as (select eid1 as eid, eid2 as other, score from e union all select eid2, eid1, score from e), m as (select eid, other, max(score) as score from u group by all) select eid, other, round(score, 6) as score from (select *, row_number() over (partition by eid order by score desc, other) as r from m) where r <= 5",
        "mixquery": f"with x as (select distinct qa_id, question, coalesce(array_to_string(supporting_evidence, ' '), '') as ev from qa_train), w as (select qa_id, list_filter(string_split({_NORM % 'question'}, ' '), lambda t: t <> '') as q, list_filter(string_split({_NORM % 'ev'}, ' '), lambda t: t <> '') as e from x) select qa_id, array_to_string(list_concat(q, e[1:greatest(24 - len(q), 0)]), ' ') as mix from w",
        "display_lines": f"with x as (select doc_id, coalesce({_NORM % 'title'}, '') as t, coalesce({_NORM % 'text'}, '') as b, list_filter(string_split({_NORM % 'text'}, ' '), lambda w: w <> '') as w from documents) select doc_id, left(case when t = '' or starts_with(lower(b), lower(t)) then b else t || ': ' || b end, 60) as line, case when len(w) > 6 then array_to_string(w[1:6], ' ') || ' ...' else array_to_string(w, ' ') end as preview from x",
    }
