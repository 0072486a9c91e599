"""Text, corpus and entity queries on documents and entity_store."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..operators import graph as G
from . import table

_BLANK = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"
_NORM = f"trim(regexp_replace(%s, '{_BLANK}', ' ', 'g'))"
_B = r"(^|[^\p{L}\p{N}_])"
_STOP = "(" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + ")"


def _docs(spark, d):
    return table(spark, d, "documents")


def normalize(spark, d):
    x = _docs(spark, d).withColumn("t", T.normalize_ws("text"))
    return x.select("doc_id", T.normalize_ws("title").alias("title"), F.length("t").alias("n_chars"), F.left("t", F.lit(40)).alias("head"))


def coalesce(spark, d):
    x = _docs(spark, d).select("doc_id", F.nullif(F.trim("corpus_id"), F.lit("")).alias("document_title"), F.nullif("title", F.lit("")).alias("title"), "source")
    return x.select("doc_id", C.first_field(x, ("document_title", "title"), "none").alias("name"))


def packed(spark, d):
    x = _docs(spark, d).select("doc_id", F.posexplode(C.packed_documents(F.col("text"))).alias("k", "p"))
    return x.select("doc_id", "k", F.length("p.text").alias("n_chars"))


def chunks(spark, d):
    return C.sliding_chunks(_docs(spark, d), "doc_id", "text", 120, 10).select("doc_id", "chunk", "start", "n_tokens")


def sentences(spark, d):
    x = _docs(spark, d).select("doc_id", T.sentences("text").alias("s"))
    return x.select("doc_id", F.size("s").alias("n"), F.length(F.array_join("s", "|")).alias("n_chars"))


def adjacency(spark, d):
    x = _docs(spark, d).select(F.col("doc_id").alias("pid"), F.posexplode(T.sentences("text")).alias("pos", "s")).select("pid", "pos", F.concat_ws(":", "pid", "pos").alias("sid"))
    return G.adjacency(x)


def terms(spark, d):
    x = _docs(spark, d).select("doc_id", F.explode(T.search_tokens("text")).alias("token")).groupBy("token", "doc_id").agg(F.count("*").alias("tf"))
    return x.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("most"))


def keywords(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(T.compact_keywords(F.concat_ws(" ", "title", "text")), " ").alias("keywords"))


def junk(spark, d):
    e = table(spark, d, "entity_store").select("eid", F.explode("surface_forms").alias("surface"), "label").distinct()
    return e.select("eid", "surface", T.junk_surface("surface").alias("junk"), T.bad_lookup_target("surface", "label").alias("bad_target"))


def registry(spark, d):
    """Entities by identity: first id, forms, best label."""
    e = table(spark, d, "entity_store").where("canonical is not null").withColumn("key", T.identity_key("canonical"))
    return e.groupBy("key").agg(F.min("eid").alias("eid"), F.count_distinct("eid").alias("ids"), F.min_by("label", F.struct(T.label_rank("label"), "label")).alias("label"))


def answer_form(spark, d):
    x = table(spark, d, "qa_train").select("qa_id", F.explode("golden_answers").alias("a")).distinct()
    return x.select("qa_id", "a", T.normalize_answer("a").alias("normal"))


def _one_each(spark, d):
    """(eid, canonical, label): of the rows of an entity the first by name and label, nulls last."""
    w = Window.partitionBy("eid").orderBy(F.asc_nulls_last("canonical"), F.asc_nulls_last("label"))
    return table(spark, d, "entity_store").withColumn("_r", F.row_number().over(w)).where("_r = 1").select("eid", "canonical", "label")


def features(spark, d):
    f = G.synonym_features(_one_each(spark, d).select("eid", "canonical", "label", F.array("canonical").alias("surface_forms")))
    return f.select("eid", F.array_join(F.array_sort("tokens"), " ").alias("tokens"), F.array_join(F.array_sort("exact"), "|").alias("exact"), "usable")


def blocks(spark, d):
    """Candidate pairs of the entities with a name: an exact form, an acronym or a token in common, at most 256 per entity."""
    e = _one_each(spark, d).where("canonical is not null")
    return G.synonym_candidates(G.synonym_features(e.withColumn("surface_forms", F.lit(None).cast("array<string>"))))


def synonyms(spark, d):
    e = _one_each(spark, d).where("canonical is not null").select("eid", F.lower(T.normalize_ws("canonical")).alias("canonical"), "label", F.lit(None).cast("array<string>").alias("surface_forms"))
    return G.synonym_edges(e)


def graph_counts(spark, d):
    x = _docs(spark, d).where("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), "title", "text")
    return G.manifest(G.settled(G.build(x)))


def graph_errors(spark, d):
    x = _docs(spark, d).where("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), "title", "text")
    return G.errors(G.settled(G.build(x)))


def coo(spark, d):
    e = table(spark, d, "entity_to_synonym_entities").where("eid1 rlike '^e_[0-9]+$' and eid2 rlike '^e_[0-9]+$' and eid1 <> eid2").groupBy("eid1", "eid2").agg(F.max(F.round("score", 4)).alias("score"))
    return G.coo(e, "eid1", "eid2", "score").groupBy("row").agg(F.count("*").alias("n"), F.round(F.sum(F.col("data").cast("double")), 3).alias("total"))


def passage_weights(spark, d):
    m = table(spark, d, "entity_to_synonym_entities").where("data_source is not null and eid1 is not null").select(F.col("data_source").alias("pid"), F.col("eid1").alias("eid"))
    return G.passage_weights(m).select("pid", "eid", F.round("weight", 9).alias("weight"))


def edge_counts(spark, d):
    m = table(spark, d, "entity_to_synonym_entities").select(F.col("data_source").alias("pid"), F.col("eid1").alias("eid"), F.col("method").alias("sid")).dropna()
    return G.edge_counts(m)


def queries():
    return {
        "corpus_normalize": normalize, "field_coalesce": coalesce, "packed_split": packed, "chunk_sliding": chunks, "sentence_split": sentences, "sentence_adjacency": adjacency, "term_frequency": terms, "compact_keywords": keywords,
        "junk_surfaces": junk, "entity_registry": registry, "answer_normal_form": answer_form, "synonym_features": features, "block_candidates": blocks, "synonym_edges": synonyms, "graph_manifest": graph_counts, "graph_validate": graph_errors,
        "coo_symmetric": coo, "passage_entity_weight": passage_weights, "edge_counts": edge_counts,
    }


_ABBR = "|".join(T.ABBREVIATIONS)
_D = "chr(57344)"


def _sentences_sql(col):
    t = _NORM % col
    t = rf"regexp_replace({t}, '{_B}([A-Za-z])\.([A-Za-z]\.)', '\1\2' || {_D} || '\3', 'g')"
    t = rf"regexp_replace({t}, '(^|[^\p{{L}}\p{{N}}_.]|\x{{E000}}|\.)([A-Za-z])\.([A-Za-z]\.)', '\1\2' || {_D} || '\3', 'g')"
    t = rf"regexp_replace({t}, '\x{{E000}}([A-Za-z])\.', {_D} || '\1' || {_D}, 'g')"
    for _ in range(2):
        t = rf"regexp_replace({t}, '{_B}([A-Z])\.(\s+[A-Z])', '\1\2' || {_D} || '\3', 'g')"
    for _ in range(2):
        t = rf"regexp_replace({t}, '(?i){_B}({_ABBR})\.', '\1\2' || {_D}, 'g')"
    q = r"""["''(\[]?[A-Z0-9]"""
    return rf"list_filter(list_transform(string_split(regexp_replace({t}, '([.!?])\s+({q})', '\1' || chr(30) || '\2', 'g'), chr(30)), lambda x: trim(replace(x, {_D}, '.'))), lambda x: x <> '')"


_TOK = "regexp_extract_all(lower(%s), '[a-z0-9]+')"
_PUNCT = r"[!-/:-@\[-`{-~]"
_ENT = "(select eid, canonical, label from (select *, row_number() over (partition by eid order by canonical nulls last, label nulls last) as r from entity_store) where r = 1)"
#: Candidate pairs: keys of each kind (p: 0 exact form, 1 acronym, 2 token), the best reason of a pair, the 256 best of an entity.
_PAIRS = """with x as (select eid, canonical, list_filter(regexp_extract_all(lower(canonical), '[a-z0-9]+'), lambda t: true) as raw from {ent} where canonical is not null),
    f as (select eid, canonical, raw, list_filter(raw, lambda t: t not in {stop}) as keep, array_to_string(raw, '') as compact from x),
    ex as (select distinct eid, unnest([array_to_string(raw, ' '), compact]) as key from f),
    ac as (select eid, compact as key from f where regexp_full_match(trim(canonical), '[A-Z.\\- ]{{3,}}') and regexp_full_match(compact, '[a-z]{{3,}}')
        union select eid, array_to_string(list_transform(keep, lambda t: left(t, 1)), '') from f where len(keep) >= 2),
    tk as (select distinct eid, unnest(keep) as key from f), tr as (select * from tk where key not in (select key from tk group by key having count(*) > 2048)),
    u as (select a.eid, b.eid as other, 0 as p, 0 as v from ex a join ex b using (key) where a.eid <> b.eid and key <> ''
        union all select a.eid, b.eid, 1, 0 from ac a join ac b using (key) where a.eid <> b.eid
        union all select a.eid, b.eid, 2, -count(*) from tr a join tr b using (key) where a.eid <> b.eid group by all),
    best as (select eid, other, p, v from (select *, row_number() over (partition by eid, other order by p, v) as r from u) where r = 1)
    select eid, other, ['exact', 'acronym', 'token'][p + 1] as reason from (select *, row_number() over (partition by eid order by p, v, other) as r from best) where r <= 256"""


def oracle_sql():
    edges = "' ' || chr(9) || chr(10) || chr(13) || '\"''`.,;:!?()[]{}'"
    answer = f"regexp_replace(lower(coalesce(a, '')), '{_PUNCT}', '', 'g')"
    for _ in range(2):
        answer = rf"regexp_replace({answer}, '(^|[^\p{{L}}\p{{N}}_])(a|an|the)([^\p{{L}}\p{{N}}_]|$)', '\1 \3', 'g')"
    junk = r"(trim(surface) <> '' and (regexp_full_match(trim(surface), '[0-9]+') or length(trim(surface)) <= 1 or contains(surface, '\"') or regexp_full_match(trim(surface), '\S+\s+[A-Za-z]')))".replace('\\"', '"')
    nat = "(" + ", ".join(f"'{w}'" for w in T.NATIONALITIES) + ")"
    val = "(" + ", ".join(f"'{w}'" for w in T.VALUE_LABELS) + ")"
    rank = "case label " + " ".join(f"when '{x}' then {k}" for k, x in enumerate(T.LABEL_RANK)) + " else 99 end"
    return {
        "corpus_normalize": f"with x as (select doc_id, {_NORM % 'title'} as title, {_NORM % 'text'} as t from documents) select doc_id, title, length(t)::int as n_chars, left(t, 40) as head from x",
        "field_coalesce": "select doc_id, coalesce(nullif(trim(corpus_id), ''), nullif(title, ''), 'none') as name from documents",
        "packed_split": """with x as (select doc_id, text, list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '') as f from documents where text is not null and text <> ''),
            y as (select doc_id, case when len(f) >= 2 then f else [text] end as p from x) select doc_id, (generate_subscripts(p, 1) - 1)::int as k, length(unnest(p))::int as n_chars from y""",
        "chunk_sliding": f"with x as (select doc_id, len(list_filter(string_split({_NORM % 'text'}, ' '), lambda s: s <> '')) as n from documents where text is not null), y as (select doc_id, n, unnest(range(0, n, 110)) as start from x where n > 0) select doc_id, (start // 110)::int as chunk, start::int as start, least(120, n - start)::int as n_tokens from y",
        "sentence_split": f"with x as (select doc_id, case when text is null then []::varchar[] else {_sentences_sql('text')} end as s from documents) select doc_id, len(s)::int as n, length(array_to_string(s, '|'))::int as n_chars from x",
        "sentence_adjacency": f"with x as (select doc_id, len({_sentences_sql('text')}) as n from documents where text is not null), y as (select doc_id, unnest(range(0, n - 1)) as k from x where n > 1) select doc_id || ':' || k as sid1, doc_id || ':' || (k + 1) as sid2, 'adjacent' as relation, 1.0::double as weight, true as undirected from y",
        "term_frequency": f"with x as (select doc_id, unnest({_TOK % 'text'}) as token from documents), y as (select token, doc_id, count(*) as tf from x group by all) select token, count(*) as df, sum(tf)::bigint as cf, max(tf) as most from y group by token",
        "compact_keywords": f"with x as (select doc_id, list_filter({_TOK % '''concat_ws(' ', title, text)'''}, lambda t: t not in {_STOP}) as k from documents) select doc_id, coalesce(array_to_string((select list(v order by f) from (select v, min(i) as f from (select unnest(k) as v, generate_subscripts(k, 1) as i) group by v order by f limit 16)), ' '), '') as keywords from x",
        "junk_surfaces": f"with e as (select distinct eid, label, unnest(surface_forms) as surface from entity_store) select eid, surface, coalesce({junk}, false) as junk, coalesce({junk}, false) or coalesce(upper(trim(label)) in {val}, false) or coalesce(lower(trim(surface)) in {nat}, false) as bad_target from e",
        "entity_registry": f"with e as (select eid, label, case when len({_TOK % 'canonical'}) > 0 then array_to_string({_TOK % 'canonical'}, ' ') else lower(trim({_NORM % 'canonical'}, {edges})) end as key from entity_store where canonical is not null) select key, min(eid) as eid, count(distinct eid) as ids, arg_min(label, ({rank}, label)) as label from e group by key",
        "answer_normal_form": f"with x as (select distinct qa_id, unnest(golden_answers) as a from qa_train) select qa_id, a, {_NORM % answer} as normal from x",
        "synonym_features": f"""with e as (select eid, {_TOK % 'canonical'} as raw from (select eid, coalesce(canonical, '') as canonical from {_ENT})),
            f as (select eid, raw, list_filter(raw, lambda t: t not in {_STOP}) as keep, array_to_string(raw, ' ') as spaced, array_to_string(raw, '') as compact from e)
            select eid, array_to_string(list_sort(list_distinct(keep)), ' ') as tokens, array_to_string(list_sort(list_distinct(list_filter([spaced, compact], lambda k: k <> ''))), '|') as exact,
            not (length(compact) <= 2 or coalesce(raw[-1] in {_STOP}, true) or (len(raw) <= 4 and len(list_distinct(raw)) < len(raw)) or len(keep) = 0) as usable from f""",
        "block_candidates": _PAIRS.format(ent=_ENT, stop=_STOP),
        "coo_symmetric": "with e as (select eid1, eid2, max(round(score, 4)) as score from entity_to_synonym_entities where regexp_full_match(eid1, 'e_[0-9]+') and regexp_full_match(eid2, 'e_[0-9]+') and eid1 <> eid2 group by all), c as (select substr(eid1, 3)::bigint as a, substr(eid2, 3)::bigint as b, score::float as data from e), u as (select a as row, b as col, data from c union select b, a, data from c) select row, count(*) as n, round(sum(data::double), 3) as total from u group by row",
        "passage_entity_weight": "with n as (select data_source as pid, eid1 as eid, count(*) as n from entity_to_synonym_entities where data_source is not null and eid1 is not null group by all) select pid, eid, round(n / sum(n) over (partition by pid), 9) as weight from n",
        "edge_counts": "select count(*) as mentions, count(distinct (data_source, eid1)) as passage_entity, count(distinct (method, eid1)) as sentence_entity from entity_to_synonym_entities where data_source is not null and eid1 is not null and method is not null",
    }
