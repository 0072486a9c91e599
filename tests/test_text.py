from pyspark.sql import functions as F

from warploom.functions import scores as X
from warploom.functions import text as T


def one(spark, expr, *values, schema=None):
    df = spark.createDataFrame([values], schema or ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(expr).first()[0]


def test_sentences(spark):
    cases = {
        "Leslie H. Martinson was an American director. He directed Batman.": 2,
        "St. Mary School was founded by Dr. Smith.": 1,
        "Wenn V. Deramas made films.": 1,
        "A cat sat. The dog ran.": 2,
        "The U.S. Army came. It left.": 2,
        "": 0,
        "     ": 0,
        "no end": 1,
    }
    df = spark.createDataFrame([(k, n) for k, n in cases.items()], "t string, n int").withColumn("got", F.size(T.sentences("t")))
    assert [r for r in df.collect() if r.n != r.got] == []
    assert one(spark, F.size(T.sentences("c0")), None) == 0


def test_junk(spark):
    yes = ["1962", " 42 ", "S", "Leslie H", "Wenn V", 'Patiala" Career Academy School']
    no = ["Black Gold", "Leslie H. Martinson", "Etan Boritzer", "", None]
    rows = spark.createDataFrame([(s, True) for s in yes] + [(s, False) for s in no], "s string, want boolean").withColumn("got", T.junk_surface("s")).collect()
    assert [r for r in rows if r.got != r.want] == []


def test_lookup_targets(spark):
    rows = [("American", "ENTITY", True), ("1999", "", True), ("London", "GPE", False), ("ten", "cardinal", True), (None, None, False)]
    got = spark.createDataFrame(rows, "s string, l string, want boolean").withColumn("got", T.bad_lookup_target("s", "l")).collect()
    assert [r for r in got if r.got != r.want] == []


def test_answers(spark):
    assert one(spark, T.normalize_answer("c0"), "The  Ada-Lovelace, a lady") == "adalovelace lady"
    assert one(spark, T.normalize_answer("c0"), None) == ""
    assert one(spark, T.last_answer("c0"), "<answer>a</answer> x <answer> b\n</answer>") == "b"
    assert one(spark, T.last_answer("c0"), "none") is None
    assert one(spark, T.first_answer("c0"), "<answer>a</answer><answer>b</answer>") == "a"
    assert one(spark, T.judged_answer("c0"), "x" * 600) == "x" * 500
    assert one(spark, T.last_number("c0"), "1,200 or -3.5") == "-3.5"


def test_f1_variants(spark):
    g = spark.createDataFrame([("ada lovelace", ["Ada", "Ada King Lovelace"]), ("", [""]), (None, []), ("x", None), ("a", ["the"])], "p string, g array<string>")
    r = g.select(F.round(X.best_f1("p", "g"), 6).alias("a"), X.best_f1("p", "g", 1.0).alias("b"), X.exact_match("p", "g").alias("em")).collect()
    assert r[0].a == 0.8 and r[0].em == 0
    assert (r[1].a, r[1].b, r[1].em) == (0, 1, 1)
    assert (r[2].a, r[2].em) == (0, 0) and (r[3].a, r[3].em) == (0, 0)
    assert (r[4].a, r[4].b) == (0, 1)


def test_mentions(spark):
    df = spark.createDataFrame([("It was on May 5, 1902 that the FBI met Ada Lovelace, from London.",), ("London is old.",), ("It rained in The",), (None,)], "s string")
    got = [[(m.surface, m.label) for m in r[0]] for r in df.select(T.mentions("s")).collect()]
    assert ("May 5, 1902", "DATE") in got[0] and ("1902", "DATE") in got[0] and ("FBI", "ENTITY") in got[0] and ("London", "ENTITY") in got[0]
    assert got[1] == [] and got[2] == [] and got[3] == []


def test_display(spark):
    assert one(spark, T.display_line("c0", "c1"), "Etan Boritzer", "Etan Boritzer was a writer.") == "Etan Boritzer was a writer."
    assert one(spark, T.display_line("c0", "c1"), "Etan", "He wrote.") == "Etan: He wrote."
    assert one(spark, T.preview("c0", 2), "a b c") == "a b ..."
    assert one(spark, T.mixquery("c0", "c1", 4), "what is it", "b c d") == "what is it b"
    assert one(spark, T.mixquery("c0", "c1", 2), "what is it", "b") == "what is it"
    assert one(spark, T.identity_key("c0"), "Ada-Lovelace") == "ada lovelace"


def test_bool(spark):
    df = spark.createDataFrame([("Yes",), ("off",), (None,)], "s string")
    assert [r[0] for r in df.select(T.to_bool("s")).collect()] == [True, False, None]
