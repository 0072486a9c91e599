"""Build, describe and check the passage-sentence-entity graph of a corpus."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scores import jaccard
from ..session import materialize
from .frame import numbered


@dataclass
class Graph:
    """The tables of a graph; ids are zero-padded strings in first-seen order."""

    passages: DataFrame  # pid, doc_id, title, text, sent_ids
    sentences: DataFrame  # sid, pid, doc_id, title, text, pos
    entities: DataFrame  # eid, canonical, label, labels, surface_forms
    mentions: DataFrame  # mid, pid, sid, eid, surface, canonical, label
    adjacent: DataFrame  # sid1, sid2, relation, weight, undirected
    synonyms: DataFrame | None = None  # eid1, eid2, score, method, reason, lexical_overlap, ...


def _id(prefix: str, n: str) -> F.Column:
    return F.concat(F.lit(prefix + "_"), F.lpad(F.col(n).cast("string"), 6, "0"))


def _numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    return materialize(numbered(materialize(df, "graph"), order, name), "graph")


def build(records: DataFrame, order: str = "doc_id", titles: bool = True) -> Graph:
    """The graph of records (doc_id, title, text), numbered in the order of ``order``.

    Records without a sentence get no passage. A title is a mention in the first sentence of its passage, met after all
    mentions of all texts. Names of the same letters and digits are one entity; its canonical form is the one seen first.
    """
    s = records.withColumn("s", T.sentences("text")).where(F.size("s") > 0)
    # each numbering reads its input twice: what it numbers is written once to the shared folder
    p = _numbered(s.select(F.col(order).alias("_o"), "doc_id", F.coalesce("title", F.lit("")).alias("title"), T.normalize_ws("text").alias("text"), "s"), ["_o"], "pn")
    # a passage's first sentence number is the number of sentences of all passages before it: one running sum over partitions
    sized = _numbered(p.select("pn", F.posexplode("s").alias("pos", "sentence"), "doc_id", "title"), ["pn", "pos"], "sn")
    sentences = sized.select(_id("s", "sn").alias("sid"), _id("p", "pn").alias("pid"), "doc_id", "title", F.col("sentence").alias("text"), "pos", "pn", "sn")
    ids = sentences.groupBy("pid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sid"))), lambda x: x["sid"]).alias("sent_ids"))
    passages = p.select(_id("p", "pn").alias("pid"), "doc_id", "title", "text").join(ids, "pid")

    body = sentences.select("sid", "pid", "sn", F.posexplode(T.mentions("text")).alias("k", "m")).select(F.lit(0).alias("phase"), F.col("sn").alias("at"), "k", "sid", "pid", "m.surface", "m.label")
    if titles:
        named = sentences.where((F.col("pos") == 0) & (F.trim("title") != ""))
        body = body.unionByName(named.select(F.lit(1).alias("phase"), F.col("sn").alias("at"), F.lit(0).alias("k"), "sid", "pid", T.normalize_ws("title").alias("surface"), F.lit("ENTITY").alias("label")))
    seen = F.struct("phase", "at", "k")
    m = materialize(body.withColumn("key", T.identity_key("surface")).where("key <> ''").withColumn("seen", seen), "graph")
    forms = m.groupBy("key", "surface").agg(F.min("seen").alias("f"))
    labels = m.groupBy("key", "label").agg(F.min("seen").alias("f"), F.first(T.label_rank("label")).alias("rank"))
    fl = forms.groupBy("key").agg(F.min("f").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("f", "surface"))), lambda x: x["surface"]).alias("surface_forms"))
    ll = labels.groupBy("key").agg(F.min_by("label", F.struct("rank", "label")).alias("label"), F.transform(F.array_sort(F.collect_list(F.struct("f", "label"))), lambda x: x["label"]).alias("labels"))
    reg = _numbered(fl.join(ll, "key").withColumn("canonical", T.canonical_entity(F.get("surface_forms", F.lit(0)))), ["first"], "en").withColumn("eid", _id("e", "en"))
    entities = reg.select("eid", "canonical", "label", "labels", "surface_forms")
    once = m.groupBy("key", "sid", "pid", "surface").agg(F.min_by("label", "seen").alias("label"), F.min("seen").alias("seen"))
    full = _numbered(once.join(reg.select("key", "eid", "canonical"), "key"), ["seen", "surface"], "mn")
    mentions = full.select(_id("m", "mn").alias("mid"), "pid", "sid", "eid", "surface", "canonical", "label")
    return Graph(passages, sentences.select("sid", "pid", "doc_id", "title", "text", "pos"), entities, mentions, adjacency(sentences))


def settled(g: Graph) -> Graph:
    """The same graph with every table written once to the shared folder, for plans that read it many times."""
    return Graph(*[materialize(t, "graph") if t is not None else None for t in (g.passages, g.sentences, g.entities, g.mentions, g.adjacent, g.synonyms)])


def adjacency(sentences: DataFrame) -> DataFrame:
    """An undirected edge between every sentence and the next of its passage."""
    w = Window.partitionBy("pid").orderBy("pos")
    e = sentences.select(F.col("sid").alias("sid1"), F.lead("sid").over(w).alias("sid2")).where("sid2 is not null")
    return e.select("sid1", "sid2", F.lit("adjacent").alias("relation"), F.lit(1.0).alias("weight"), F.lit(True).alias("undirected"))


def both_ways(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Edges in both directions, each once."""
    return edges.unionByName(edges.withColumnsRenamed({a: b, b: a}).select(edges.columns)).dropDuplicates([a, b])


def passage_weights(mentions: DataFrame) -> DataFrame:
    """(pid, eid, weight): the share of an entity among the mentions of a passage."""
    n = mentions.groupBy("pid", "eid").agg(F.count("*").alias("n"))
    return n.withColumn("weight", F.col("n") / F.sum("n").over(Window.partitionBy("pid"))).select("pid", "eid", "weight")


def sentence_pairs(mentions: DataFrame) -> DataFrame:
    return mentions.select("sid", "eid").distinct()


def edge_counts(mentions: DataFrame) -> DataFrame:
    return mentions.agg(F.count("*").alias("mentions"), F.countDistinct("pid", "eid").alias("passage_entity"), F.countDistinct("sid", "eid").alias("sentence_entity"))


def coo(edges: DataFrame, a: str, b: str, weight: str | None = None) -> DataFrame:
    """Symmetric sparse matrix (row, col, data) of edges between ids that end in their number."""
    n = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("bigint")
    e = edges.select(n(a).alias("row"), n(b).alias("col"), (F.col(weight) if weight else F.lit(1.0)).cast("float").alias("data"))
    return e.unionByName(e.select(F.col("col").alias("row"), F.col("row").alias("col"), "data")).distinct()


def manifest(g: Graph) -> DataFrame:
    """One row of counts."""
    c = lambda df, n: df.agg(F.count("*").alias(n))
    parts = [c(g.passages, "passages"), c(g.sentences, "sentences"), c(g.entities, "entities"), edge_counts(g.mentions), c(g.adjacent, "sentence_edges")]
    if g.synonyms is not None:
        parts.append(c(g.synonyms, "synonym_edges"))
    return reduce(lambda a, b: a.crossJoin(b), parts)


def errors(g: Graph) -> DataFrame:
    """(check, id): everything wrong with a graph; no rows for a sound one."""

    def bad(df: DataFrame, name: str, col: str) -> DataFrame:
        return df.select(F.lit(name).alias("check"), F.col(col).cast("string").alias("id"))

    def twice(df: DataFrame, col: str) -> DataFrame:
        return bad(df.groupBy(col).count().where("count > 1 or " + col + " is null"), f"duplicate {col}", col)

    def dangling(df: DataFrame, col: str, to: DataFrame, key: str) -> DataFrame:
        return bad(df.select(F.col(col).alias(key)).join(to.select(key), key, "left_anti"), f"unknown {col}", key)

    parts = [twice(g.passages, "pid"), twice(g.sentences, "sid"), twice(g.entities, "eid"), twice(g.mentions, "mid")]
    parts += [dangling(g.sentences, "pid", g.passages, "pid"), dangling(g.mentions, "sid", g.sentences, "sid"), dangling(g.mentions, "pid", g.passages, "pid"), dangling(g.mentions, "eid", g.entities, "eid")]
    parts += [dangling(g.adjacent, "sid1", g.sentences, "sid"), dangling(g.adjacent, "sid2", g.sentences, "sid"), bad(g.adjacent.where("sid1 = sid2"), "edge to itself", "sid1")]
    parts += [bad(g.mentions.join(g.sentences.select("sid", F.col("pid").alias("own")), "sid").where("own <> pid"), "mention in another passage", "mid")]
    pairs = g.adjacent.select(F.least("sid1", "sid2").alias("a"), F.greatest("sid1", "sid2").alias("b")).groupBy("a", "b").count().where("count > 1")
    parts.append(bad(pairs, "repeated edge", "a"))
    if g.synonyms is not None:
        parts += [dangling(g.synonyms, "eid1", g.entities, "eid"), dangling(g.synonyms, "eid2", g.entities, "eid"), bad(g.synonyms.where("eid1 >= eid2"), "synonym edge not in order", "eid1"), bad(g.synonyms.where("score < 0 or score > 1"), "score out of range", "eid1")]
    return reduce(DataFrame.unionByName, parts)


# --- synonyms ---


def synonym_features(entities: DataFrame) -> DataFrame:
    """Keys an entity can be matched by: exact forms, tokens, acronyms it is and acronyms its forms give."""
    forms = F.array_union(F.array(F.coalesce("canonical", F.lit(""))), F.filter(F.coalesce("surface_forms", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")))
    tok = lambda x: F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))
    keep = lambda x: F.filter(tok(x), lambda t: ~t.isin(T.STOPWORDS))
    e = entities.select("eid", F.coalesce("canonical", F.lit("")).alias("canonical"), F.coalesce("label", F.lit("")).alias("label"), forms.alias("forms"))
    exact = F.array_distinct(F.filter(F.flatten(F.transform("forms", lambda x: F.array(F.array_join(tok(x), " "), F.array_join(tok(x), "")))), lambda k: k != ""))
    explicit = F.filter(F.transform(F.filter("forms", lambda x: F.trim(x).rlike(r"^[A-Z.\- ]{3,}$")), lambda x: F.array_join(tok(x), "")), lambda k: k.rlike("^[a-z]{3,}$"))
    expanded = F.filter(F.transform("forms", lambda x: F.array_join(F.transform(keep(x), lambda t: F.left(t, F.lit(1))), "")), lambda k: F.length(k) >= 2)
    raw = tok(F.col("canonical"))
    f = e.select("eid", "canonical", "label", raw.alias("raw"), exact.alias("exact"), F.array_distinct(F.flatten(F.transform("forms", keep))).alias("tokens"), F.array_distinct(explicit).alias("explicit"), F.array_distinct(expanded).alias("expanded"))
    short = F.length(F.array_join("raw", "")) <= 2
    poor = (F.size("raw") == 0) | F.element_at("raw", -1).isin(T.STOPWORDS) | ((F.size("raw") <= 4) & (F.size(F.array_distinct("raw")) < F.size("raw"))) | (F.size(F.filter("raw", lambda t: ~t.isin(T.STOPWORDS))) == 0)
    return f.withColumn("usable", ~(short | F.when(F.size("raw") == 0, F.lit(True)).otherwise(poor))).drop("raw")


def synonym_candidates(features: DataFrame, limit: int = 256, posting: int | None = None) -> DataFrame:
    """(eid, other, reason): pairs that share an exact form, an acronym or a token, the best reason of each, at most ``limit`` per entity.

    Tokens of more than max(8 limit, 2048) entities are passed over, as the blocking rule says; ties go to the smaller id.
    """
    cap = max(8 * limit, 2048) if posting is None else posting

    def block(col: str) -> DataFrame:
        return features.select("eid", F.explode(col).alias("key"))

    def pairs(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b.withColumnRenamed("eid", "other"), "key").where("eid <> other")

    acr = block("explicit").unionByName(block("expanded")).distinct()
    tokens = block("tokens").distinct()
    common = tokens.groupBy("key").count().where(F.col("count") > cap).select("key")
    tokens = tokens.join(common, "key", "left_anti")
    every = None
    for p, side in enumerate((block("exact"), acr, tokens)):
        some = pairs(side, side).select("eid", "other", F.lit(p).alias("p"))
        every = some if every is None else every.unionByName(some)
    # one aggregation over all reasons: the products of frequent keys are summed before they are shuffled
    best = every.groupBy("eid", "other").agg(F.min("p").alias("p"), F.sum((F.col("p") == 2).cast("int")).alias("votes"))
    best = best.select("eid", "other", F.struct("p", F.when(F.col("p") == 2, -F.col("votes")).otherwise(F.lit(0)).alias("v")).alias("b"))
    w = Window.partitionBy("eid").orderBy("b.p", "b.v", "other")
    top = best.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit)
    reason = F.when(F.col("b.p") == 0, "exact").when(F.col("b.p") == 1, "acronym").otherwise("token")
    return top.select("eid", "other", reason.alias("reason"))


def synonym_edges(entities: DataFrame, k: int = 5, threshold: float = 0.8, limit: int = 256, scores: DataFrame | None = None) -> DataFrame:
    """Undirected synonym edges: candidates, filters, score, the k best per entity, the larger score of each pair.

    The score is that of ``scores(eid, other, score)`` if given, else the token overlap.
    """
    f = synonym_features(entities)
    side = lambda p: f.select(*[F.col(c).alias(f"{p}_{c}") for c in f.columns])
    c = synonym_candidates(f, limit).join(side("l"), F.col("eid") == F.col("l_eid")).join(side("r"), F.col("other") == F.col("r_eid"))
    overlap = jaccard("l_tokens", "r_tokens")
    label = (F.col("reason") == "acronym") | (F.col("l_label") == "") | (F.col("r_label") == "") | (F.col("l_label") == F.col("r_label")) | (F.col("l_label") == "ENTITY") | (F.col("r_label") == "ENTITY")
    acronym = (F.col("reason") != "acronym") | F.arrays_overlap("l_explicit", "r_expanded") | F.arrays_overlap("r_explicit", "l_expanded")
    ok = F.col("l_usable") & F.col("r_usable") & (F.col("l_canonical") != F.col("r_canonical")) & label & acronym
    c = c.where(ok).withColumn("overlap", overlap).where((F.col("reason") != "token") | (F.col("overlap") >= 0.8))
    c = c.join(scores, ["eid", "other"], "left").withColumn("score", F.coalesce("score", "overlap")) if scores is not None else c.withColumn("score", F.col("overlap"))
    c = c.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))).where(F.col("score") >= threshold)
    w = Window.partitionBy("eid").orderBy(F.desc("score"), "other")
    top = c.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    first = F.col("eid") < F.col("other")
    pair = top.select(
        F.least("eid", "other").alias("eid1"), F.greatest("eid", "other").alias("eid2"), F.round("score", 6).alias("score"), "reason", F.round("overlap", 6).alias("lexical_overlap"),
        F.when(first, F.col("l_canonical")).otherwise(F.col("r_canonical")).alias("canonical1"), F.when(first, F.col("r_canonical")).otherwise(F.col("l_canonical")).alias("canonical2"),
    )
    best = pair.groupBy("eid1", "eid2").agg(F.max_by(F.struct("score", "reason", "lexical_overlap", "canonical1", "canonical2"), F.struct("score", "reason")).alias("b"))
    return best.select("eid1", "eid2", "b.*", F.lit("lexical").alias("method"), F.lit(True).alias("undirected"))
