import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from warploom.llm import p1_groups as p1
from warploom.llm import p3_splits as p3
from warploom.llm import p4_names as p4
from warploom.llm.textfold import Fold, Squeeze, edit_distance


def brute_groups(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in list(parent)}


@pytest.mark.parametrize("cell", [3, 40, 10_000])
def test_groups_against_brute_force(spark, cell):
    rng = random.Random(cell)
    links = [(f"v{rng.randrange(60):03d}", f"v{rng.randrange(60):03d}") for _ in range(35)]
    links += [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(40)] + [("hub", f"h{k}") for k in range(50)] + [("hub", "hub"), (None, "x"), ("x", None), *links[:5]]
    df = spark.createDataFrame([(a, b, 1, "z") for a, b in links], "a string, b string, count int, v string")
    got = {(r.id, r.group_id) for r in p1.group_links(df, cell_edges=cell).collect()}
    assert got == brute_groups(links)


def test_groups_of_nothing(spark):
    assert p1.group_links(spark.createDataFrame([], "a string, b string")).count() == 0


def test_entity_links(spark):
    pairs = spark.createDataFrame([(" E_1 ", "e_2", None), ("e_2", "e_1", 0.1), ("e_1", "e_9", 1.0), (None, "e_1", 1.0), ("e_3", "e_3", 1.0), ("e_3 ", "e_0", None)], "eid1 string, eid2 string, score double")
    lists = spark.createDataFrame([("e_4", [("e_2", None), (None, 1.0)]), ("e_4", None), ("e_5", []), (None, [("e_1", 1.0)])], "eid string, similar_entities array<struct<eid:string,score:double>>")
    store = spark.createDataFrame([(f"e_{k}", 1) for k in range(1, 6)] + [(None, 1), ("e_1", 1)], "eid string, a int")
    anchors = spark.createDataFrame([("e_0",)], "eid string")
    for hot in (1, 50_000):
        got = sorted((r.a, r.b) for r in p1.entity_links(pairs, lists, store, anchors, hot).collect())
        assert got == [("e_0", "e_3"), ("e_1", "e_2"), ("e_2", "e_4")]
    assert p1.entity_links(pairs.limit(0), lists.limit(0), store, anchors).count() == 0


def test_fold():
    assert "Café Ǆ Ｘ".translate(Fold()).startswith("cafe") and "Hóly-Cоw 3!".translate(Squeeze()) == "holycow3"
    for a, b in (("", "abc"), ("kitten", "sitting"), ("same", "same"), ("ab", "ba")):
        want = {"": 3, "kitten": 3, "same": 0, "ab": 2}[a]
        assert edit_distance(a, b) == want and edit_distance(a, b, 1) == min(want, 2)


QA = "qa_id long, question string, golden_answers array<string>, key string"
EV = "result_id long, question string, golden_answers array<string>, w string"


def test_overlaps(spark):
    filler = [(100 + k, f"Who directed the film The Ladder of Nama{k}lo Kupa{k}ri?", [f"A{k}"], None) for k in range(60)]
    train = [
        (1, "Who directed the film Songs for Bokalim Tredras?", ["X Y"], "k"), (1, "Who directed the film Songs for Bokalim Tredras?", ["X Y"], "k"), (2, "In what year was Songs for Bokalim Tredras first performed?", ["1900"], None),
        (3, None, None, None), (4, "", [], None), (5, "Which company published The Orchard at Vumeko Staflir?", None, None),
    ]
    evals = [
        (11, "The film SONGS for Bokálim Trédras was directed by whom", ["x y"], None), (12, "Who directed the film Songs for Bokalin Tredras?", None, None), (13, "Who directed the film Letters from Wadiko Prenul?", ["Z"], None),
        (14, None, [None], None), (15, "The Orchard at Vumeko Staflir was published by which company???", ["Q"], None), (16, "The Orchard at Vumeko Staflir has which country of origin?", ["Q"], None), (17, "lorem ipsum " * 20_000 + "Who directed Songs for Bokalim Tredras", ["X Y"], None),
    ]
    t, e = spark.createDataFrame(train + filler, QA), spark.createDataFrame(evals, EV)
    got = sorted((r.t_id, r.e_id) for r in p3.overlaps(t, e, "qa_id", "result_id").collect())
    assert got == [(1, 11), (1, 12), (1, 17), (5, 15)]
    assert p3.overlaps(t.limit(0), e, "qa_id", "result_id").count() == 0
    assert p3.overlaps(t, e.limit(0), "qa_id", "result_id").count() == 0


def test_similar_words_have_close_codes():
    d = lambda a, b: bin((p3.code(a) ^ p3.code(b)) & (2**64 - 1)).count("1")
    near = [d("stizoban", x) for x in ("stizobam", "stizban", "stizobann")]
    far = [d("stizoban", x) for x in ("flaklimu", "dredipor", "kuwezath")]
    assert max(near) < min(far)


STORE = "eid string, canonical string, label string, surface_forms array<string>, block string"


def test_name_variants(spark):
    rows = [
        ("e1", "Francis Graligrir Flawenith", "PERSON", None), ("e2", "Graligrir Flawenith, Frank", "ORG", []), ("e3", "F. Graligrir Flawenith", None, [None]), ("e4", "Dr. Francis Graligrir Flawenit", "PERSON", None),
        ("e5", "Dario Graligrir Flawenith", "PERSON", None), ("e6", "Francis Graligrir Flawenith Jr.", "PERSON", None), ("e7", "Frank G. F.", "PERSON", ["Dr. Francis", "Francis Grálígrir Flawenith"]),
        ("o1", "Trogudrun Flinivos Institute of Botany", "ORG", None), ("o2", "Institute Botany Trogudrun Flinivos", "ORG", None), ("o3", "TFIB (Trogudrun Flinivos)", "GPE", None), ("o4", "Trogudrun-Flinivos Inst. of Botany", "ORG", None),
        ("o5", "Trogudrun Flinivos Shipping Company", "ORG", None), ("o6", "TFIB", "ORG", ["Trogudrun Flinivos Institute of Botany", "Someone Else"]), ("x1", None, None, None), ("x2", "", "ORG", [""]), (None, "Francis Graligrir Flawenith", "PERSON", None),
        ("e1", "Francis Graligrir Flawenith", "PERSON", None), ("x3", "Francis " * 3000, "PERSON", None),
    ]
    got = {(r.eid1, r.eid2) for r in p4.variants(spark.createDataFrame([(*r, None) for r in rows], STORE)).collect()}
    people, orgs = ["e1", "e2", "e3", "e4", "e7"], ["o1", "o2", "o3", "o4", "o6"]
    # e3 fits Francis and nobody else whose name begins with F
    want = {(a, b) for g in (people, orgs) for a in g for b in g if a < b}
    assert got == want
    assert p4.variants(spark.createDataFrame([], STORE)).count() == 0


def test_radius_join_against_brute_force(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("abcd") for _ in range(rng.randrange(3, 9))) for _ in range(120)]
    words = sorted({*base, *(w[:-1] for w in base if len(w) > 3)})
    df = spark.createDataFrame([("B", w) for w in words] + [("C", words[0])], "block string, core string")
    got = {tuple(sorted((r.a, r.b))) for r in p4.radius_join(df, 2, 6).where("block = 'B'").collect()}
    want = {(a, b) for a in words for b in words if a < b and edit_distance(a, b) <= 2}
    assert got == want
    rows = p4.radius_join(df, 2, 6).collect()
    assert len(rows) == len({(r.block, *sorted((r.a, r.b))) for r in rows})


def test_ambiguous_initial(spark):
    rows = [("e1", "Edward Wusabril Zedrupres", "PERSON", None, None), ("e2", "Esteban Wusabril Zedrupres", "PERSON", None, None), ("e3", "E. Wusabril Zedrupres", "PERSON", None, None)]
    rows += [(f"f{k}", f"Esteban Name{k}ru Other{k}lo", "PERSON", None, None) for k in range(14)]
    assert {(r.eid1, r.eid2) for r in p4.variants(spark.createDataFrame(rows, STORE)).collect() if r.eid1 < "f"} == set()


def test_local_groups():
    v, r = p1.local_groups(np.array(["b", "c"], dtype=object), np.array(["a", "d"], dtype=object))
    assert list(zip(v, r)) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")]
    assert F is not None
