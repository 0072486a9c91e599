import pytest
from pyspark.sql import functions as F

from warploom.operators import corpus as C
from warploom.operators import graph as G
from warploom.operators import search as S
from warploom.sources import readers, writers

DOCS = [
    ("1", "Ada Lovelace", "Ada Lovelace was born in London. She worked with Charles Babbage on the Analytical Engine."),
    ("2", "Charles Babbage", "Charles Babbage designed the Analytical Engine. He was born in London."),
    ("3", "Empty", ""),
    ("4", None, None),
]


@pytest.fixture(scope="module")
def graph(spark):
    return G.settled(G.build(spark.createDataFrame(DOCS, "doc_id string, title string, text string")))


def test_counts(graph):
    m = G.manifest(graph).first()
    assert (m.passages, m.sentences, m.sentence_edges) == (2, 4, 2)
    names = {r.canonical for r in graph.entities.collect()}
    assert {"ada lovelace", "charles babbage", "london"} <= names
    assert G.errors(graph).count() == 0


def test_ids_in_order(graph):
    assert [r.sid for r in graph.sentences.orderBy("doc_id", "pos").collect()] == [f"s_{k:06d}" for k in range(4)]
    assert [r.sent_ids for r in graph.passages.orderBy("pid").collect()] == [["s_000000", "s_000001"], ["s_000002", "s_000003"]]


def test_errors_found(graph):
    bad = G.Graph(graph.passages, graph.sentences, graph.entities.where("eid <> 'e_000000'"), graph.mentions, graph.adjacent)
    assert "unknown eid" in {r.check for r in G.errors(bad).collect()}


def test_identity(spark):
    rows = [("1", "", "then Ada Lovelace met Ada-Lovelace."), ("2", "ADA LOVELACE", "then Ada Lovelace left.")]
    g = G.build(spark.createDataFrame(rows, "doc_id string, title string, text string"))
    e = [r for r in g.entities.collect() if r.canonical == "ada lovelace"]
    assert len(e) == 1 and {"Ada Lovelace", "ADA LOVELACE"} <= set(e[0].surface_forms)


def test_empty(spark):
    g = G.build(spark.createDataFrame([], "doc_id string, title string, text string"))
    assert G.manifest(g).first().passages == 0


def test_save_and_load(spark, graph, tmp_path):
    writers.save_graph(graph, str(tmp_path / "g"))
    g = writers.load_graph(spark, str(tmp_path / "g"))
    assert g.mentions.count() == graph.mentions.count() and G.errors(g).count() == 0
    assert "| passages | 2 |" in writers.report(G.manifest(g))


def test_packed(spark):
    rows = [('"Title One"\nBody one sentence.\n"Title Two"\nBody two sentence.',), ("Doc one body.\nDoc two body.\nDoc three body.",), ("Just one document body.",), ("",), (None,)]
    got = [[(d.title, d.text) for d in r[0]] for r in spark.createDataFrame(rows, "t string").select(C.packed_documents(F.col("t"))).collect()]
    assert got[0] == [("Title One", "Body one sentence."), ("Title Two", "Body two sentence.")]
    assert [len(x) for x in got] == [2, 3, 1, 0, 0] and got[2] == [("", "Just one document body.")]


def test_records(spark):
    df = spark.createDataFrame([("7", '"Alpha"\nAlpha body.\n"Beta"\nBeta body.', "x"), ("8", "One.", None), ("9", None, "t")], "id string, contents string, title string")
    got = {r.doc_id: (r.title, r.text) for r in C.records(df).collect()}
    assert got == {"7__0": ("Alpha", "Alpha body."), "7__1": ("Beta", "Beta body."), "8": ("", "One.")}


def test_contexts(spark):
    df = spark.createDataFrame([("q1", '[["T", ["a b.", "c d."]], {"title": "U", "text": "e f."}, "g h."]'), ("q2", None)], "id string, contexts string")
    got = sorted((r.doc_id, r.title, r.text) for r in C.context_records(df).collect())
    assert got == [("q1__0", "T", "a b. c d."), ("q1__1", "U", "e f."), ("q1__2", "", "g h.")]


def test_json_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1", "text": "x"}]')
    (tmp_path / "b.json").write_text('{"data": [{"id": "2", "text": "y"}]}')
    (tmp_path / "c.json").write_text('{"k": {"text": "z"}}')
    (tmp_path / "d.jsonl").write_text('{"id": "4", "contents": "w"}\n')
    got = [[(r.doc_id, r.text) for r in readers.read_corpus(spark, str(tmp_path / f)).collect()] for f in ("a.json", "b.json", "c.json", "d.jsonl")]
    assert got == [[("1", "x")], [("2", "y")], [("k", "z")], [("4", "w")]]
    assert readers.find_corpus(spark, str(tmp_path), "d") == str(tmp_path / "d.jsonl")
    with pytest.raises(FileNotFoundError):
        readers.find_corpus(spark, str(tmp_path), "nothing")


def test_synonyms(spark):
    rows = [("e1", "international business machines", "ORG", []), ("e2", "ibm", "ORG", ["IBM"]), ("e3", "grand blue river bridge", "", []), ("e4", "blue grand river bridge", "", []), ("e5", "ab", "", []), ("e6", None, None, None)]
    e = spark.createDataFrame(rows, "eid string, canonical string, label string, surface_forms array<string>")
    got = {(r.eid1, r.eid2): (r.reason, r.score) for r in G.synonym_edges(e).collect()}
    assert got == {("e3", "e4"): ("token", 1.0)}
    low = {(r.eid1, r.eid2): r.reason for r in G.synonym_edges(e, threshold=0.0).collect()}
    assert low[("e1", "e2")] == "acronym"


def test_lookup_and_bridges(spark):
    sent = spark.createDataFrame([("s_src", "p1", "", "alpha"), ("s_nb", "p2", "", "beta"), ("s_tgt", "p3", "", "gamma target")], "id string, pid string, title string, text string")
    men = spark.createDataFrame([("e_src", "s_src"), ("e_tgt", "s_tgt")], "eid string, sid string")
    adj = spark.createDataFrame([("s_src", "s_nb")], "sid1 string, sid2 string")
    syn = spark.createDataFrame([], "eid1 string, eid2 string, score double")
    q = spark.createDataFrame([("q", "target")], "qid string, text string")
    t = spark.createDataFrame([("q", "e_tgt")], "qid string, eid string")
    assert [r.id for r in S.lookup(q, t, sent, men, adj, syn).collect()] == ["s_tgt"]
    ex = S.expand(q, q, t, sent, men, adj, syn).collect()
    assert [r.id for r in ex] == ["s_tgt"]
    both = spark.createDataFrame([("a", "s1"), ("b", "s1")], "eid string, sid string")
    ent = spark.createDataFrame([("a", "alpha"), ("b", "beta")], "id string, text string")
    none = spark.createDataFrame([], "sid1 string, sid2 string")
    sel = spark.createDataFrame([("q", "s1")], "qid string, sid string")
    got = {(r.source, r.id) for r in S.bridges(sel, q, ent, both, none, syn).collect()}
    assert got == {("a", "b"), ("b", "a")}


def test_zero_fill_and_ties(spark):
    docs = spark.createDataFrame([(k, "", "x y") for k in range(5)] + [(9, "", None)], "id long, title string, text string")
    q = spark.createDataFrame([("a", "x"), ("b", "nothing"), ("c", None)], "qid string, text string")
    got = {}
    for r in S.search_passages(q, docs, 3).collect():
        got.setdefault(r.qid, []).append((r.rank, r.id))
    assert {k: [i for _, i in sorted(v)] for k, v in got.items()} == {"a": [0, 1, 2], "b": [0, 1, 2], "c": [0, 1, 2]}


def test_local_context(spark, graph):
    got = {(r.sid, r.other): (r.score, r.source) for r in S.local_context(graph.sentences, graph.adjacent).collect()}
    assert got[("s_000000", "s_000001")] == (1.0, "graph_neighbor,next") and len(got) == 4


def test_chunks(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(25)))), (2, ""), (3, None)], "doc_id long, text string")
    got = [(r.doc_id, r.start, r.n_tokens) for r in C.sliding_chunks(df, "doc_id", "text", 10, 2).orderBy("start").collect()]
    assert got == [(1, 0, 10), (1, 8, 10), (1, 16, 9), (1, 24, 1)]
