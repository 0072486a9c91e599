import math

import pytest
from pyspark.sql import functions as F

from warploom.operators import advantage as A
from warploom.operators import credit as C
from warploom.operators import evaluate as E
from warploom.operators import frame as B
from warploom.operators import navigation as N
from warploom.operators import trajectory as R


def steps(spark, rows):
    return spark.createDataFrame(rows, "episode string, t int, ig double, produced_sids array<string>, consumed_sids array<string>, produced_entity_ids array<string>, used_entity_ids array<string>, surfaced_entity_ids array<string>")


def test_frontier(spark):
    df = spark.createDataFrame([(1.0, {"A0": 1.0, "A1": 1.0}), (3.0, {"A0": 3.0, "A1": 1.0, "A2": 1.0}), (5e-5, {"A0": 5e-5, "A1": 0.0}), (1.0, {"A0": 1.0})], "ig double, f map<string,double>")
    got = [r[0] for r in df.select(C.frontier_credit(F.col("ig"), F.col("f"), F.lit("A0"), F.lit(True))).collect()]
    assert got == [0.0, 2.0, 0.0, 0.0]


def test_provenance_and_enabling(spark):
    s = steps(spark, [("x", 0, 0.0, ["S1"], [], [], [], []), ("x", 1, 0.0, ["S1"], ["S1"], [], [], []), ("x", 2, 1.0, [], ["S1"], [], [], [])])
    e = C.provenance_edges(s)
    assert sorted((r.src, r.dst) for r in e.collect()) == [(0, 1), (1, 2)]
    r = {x.t: x.r_en for x in C.enabling_credit(s.select("episode", "t", "ig"), e).collect()}
    assert r == {0: 1.0, 1: 1.0, 2: 0.0}


def test_shared_entities(spark):
    s = steps(spark, [("x", k, 0.0, [], [], [], [], v) for k, v in enumerate((["x", "y"], ["z"], ["x"], ["z", "q"]))])
    assert sorted((r.src, r.dst) for r in C.shared_entity_edges(s).collect()) == [(0, 2), (1, 3)]


def test_shapley_additive(spark):
    w = [1.0, 2.0, 4.0]
    v = spark.createDataFrame([("x", m, float(sum(w[i] for i in range(3) if m >> i & 1))) for m in range(8)], "episode string, mask int, v double")
    n = spark.createDataFrame([("x", 3)], "episode string, n int")
    assert {r.i: round(r.value, 9) for r in C.shapley(v, n).collect()} == dict(enumerate(w))
    with pytest.raises(Exception, match="missing coalition"):
        C.shapley(v.where("mask < 7"), n).collect()


def test_protected_total(spark):
    df = spark.createDataFrame([(-1.0, 0.5), (-1.0, 0.0), (1.0, 0.5)], "fr double, en double")
    assert [r[0] for r in df.select(C.total_credit(F.col("fr"), F.col("en"), protect=True)).collect()] == [0.5, -1.0, 1.5]


def test_spans_keep_the_sum(spark):
    c = spark.createDataFrame([(1, 0, 3.0), (1, 1, 2.0), (1, 2, 9.0)], "row int, t int, credit double")
    s = spark.createDataFrame([(1, 0, 2, 5, 7), (1, 1, 6, 6, 7), (1, 2, None, None, None)], "row int, t int, start int, end int, anchor int")
    assert {r.pos: r.reward for r in C.place_on_spans(c, s).collect()} == {2: 1.0, 3: 1.0, 4: 1.0, 7: 2.0}


def test_groups_of_one_and_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 2.0), ("b", 2.0)], "uid string, score double")
    got = [(r.uid, r.advantage) for r in A.group_relative(df, "uid", "score").collect()]
    assert ("a", 1.0 / (1 + 1e-6)) in got and all(v == 0 for u, v in got if u == "b")
    assert {r.advantage for r in A.leave_one_out(df, "uid", "score").collect()} == {1.0, 0.0}


def test_span_advantage_edges(spark):
    df = spark.createDataFrame([(0.0, 1), (0.0, 1)], "r double, m int")
    assert [r.span_advantage for r in A.span_advantage(df, "r", "m").collect()] == [0, 0]
    one = spark.createDataFrame([(2.0, 1), (0.0, 1)], "r double, m int")
    assert [r.span_advantage for r in A.span_advantage(one, "r", "m").collect()] == [1.0, 0.0]
    assert A.span_advantage(df.limit(0), "r", "m").count() == 0


def test_losses(spark):
    x = lambda e: spark.range(1).select(e.cast("double")).first()[0]
    assert x(A.policy_loss(F.lit(0.0), F.lit(100.0), F.lit(-1.0))) == 3.0
    assert x(A.policy_loss(F.lit(0.0), F.lit(0.0), F.lit(1.0))) == -1.0
    assert abs(x(A.kl(F.lit(0.0), F.lit(1.0), "low_var_kl")) - (math.e - 2)) < 1e-9
    assert x(A.kl(F.lit(-100.0), F.lit(100.0), "low_var_kl")) == 10.0
    assert A.cosine_warmup(0, 10, 5) == 0 and A.cosine_warmup(10, 10, 5) == pytest.approx(0, abs=1e-9)
    assert A.adaptive_kl(1.0, 2.0, 1.0, 100, 10) == pytest.approx(1.02)


def test_frames(spark):
    df = spark.createDataFrame([(k, f"v{k}") for k in range(5)], "row_id long, v string")
    assert B.pad_to_divisor(df, 4, "row_id").count() == 8
    assert B.unpad(B.pad_to_divisor(df, 4, "row_id")).count() == 5
    assert B.pad_to_divisor(df.limit(1), 4, "row_id").count() == 4
    with pytest.raises(ValueError):
        B.chunk(df, 2, "row_id")
    assert [r.pos for r in B.repeat(df.limit(2), 2, "row_id", False).orderBy("pos").collect()] == [0, 1, 2, 3]
    with pytest.raises(Exception, match="differs"):
        B.union_columns(df, df.withColumn("v", F.lit("x")), "row_id").collect()
    assert sorted(r.n for r in B.numbered(df, ["v"], "n").collect()) == list(range(5))


def test_balance(spark):
    sizes = [9, 8, 7, 1, 1, 1, 1, 1, 1]
    for f in (B.greedy_partitions, B.differencing_partitions):
        p = f(sizes, 3)
        assert sorted(i for x in p for i in x) == list(range(9)) and max(sum(sizes[i] for i in x) for x in p) <= 11
    df = spark.createDataFrame([(k, s) for k, s in enumerate(sizes)] + [(99, None)], "k long, s long")
    assert B.balance(df, "k", "s", 3).count() == 10


def test_rollup_of_nothing(spark):
    r = E.episode_rollup(spark.createDataFrame([], "valid_action_id_count int, stop_count int")).first()
    assert r.sessions == 0 and r.select_rate == 0 and r.no_stop_rate == 1.0


ROLLOUT = """
<|im_start|>assistant
<think>start</think>
<query>{"query": "INIT"}</query><|im_end|>
<|im_start|>user
[OBS]
visible_sentences:
S0 | Ada worked with Charles.
available_actions:
A0 = SELECT S0
A1 = ANSWER_WITH S0 | evidence: Ada worked with Charles.
[/OBS]<|im_end|>
<|im_start|>assistant
<query>{"query": "A0"}</query><|im_end|>
<|im_start|>user
[OBS]
event: SELECT
selected:
S0 | Ada worked with Charles.
available_actions:
A0 = LOOKUP E0 | entity: Ada | via: from S0
A1 = ANSWER
[/OBS]<|im_end|>
<|im_start|>assistant
<query>{"query": "A0"}</query><|im_end|>
<|im_start|>user
[OBS]
event: LOOKUP
new_visible_sentences:
S1 | Ada was born in London.
available_actions:
A0 = SELECT S1
A1 = ANSWER
[/OBS]<|im_end|>
<|im_start|>assistant
<query>{"query": "A0"}</query><|im_end|>
<|im_start|>user
[OBS]
event: SELECT
selected:
S0 | Ada worked with Charles.
S1 | Ada was born in London.
available_actions:
A0 = ANSWER
[/OBS]<|im_end|>
<|im_start|>assistant
<query>{"query": "A0"}</query><|im_end|>
<|im_start|>user
[OBS]
event: ANSWER
selected_evidence:
S0 | Ada worked with Charles.
S1 | Ada was born in London.
[/OBS]<|im_end|>
<|im_start|>assistant
<answer>London</answer><|im_end|>
"""


def test_trajectory(spark):
    m = R.analyse(ROLLOUT, ["London"], [])
    assert m["total_reward"] > 0 and m["answer_f1"] == 1.0 and m["answer_after_stop"] == 1
    assert (m["valid_action_id_count"], m["select_count"], m["lookup_count"], m["lookup_success_count"], m["answer_count"]) == (5, 2, 1, 1, 1)
    assert R.analyse('<query>{"query": "Ada birthplace"}</query><answer>London</answer>', ["London"], [])["total_reward"] < m["total_reward"]
    assert R.analyse("<answer>London</answer>", ["London"], [])["total_reward"] <= 0.05
    assert R.analyse(ROLLOUT, ["Paris"], [])["answer_f1"] == 0
    e = R.analyse(ROLLOUT, ["London"], ["Ada was born in London."])
    assert e["gold_fact_count"] == 1 and e["selected_coverage"] == 1.0
    assert R.analyse(ROLLOUT.replace("\n", "\\n"), ["London"], [])["selected_sentence_count"] > 0
    df = spark.createDataFrame([(1, ROLLOUT, ["London"]), (2, None, None), (3, "", [])], "k long, s string, g array<string>")
    got = {r.k: r for r in R.rewards(df, "k", "s", "g").collect()}
    assert got[1].total_reward == pytest.approx(m["total_reward"]) and got[2].total_reward == got[3].total_reward <= -0.05


def test_actions():
    menu = {"A1": "SELECT"}
    assert R.parse_action("A1", menu)["valid"] and not R.parse_action("A1 || where", menu)["valid"]
    assert R.parse_action("where is it", menu)["natural"] and not R.parse_action("<x>", menu)["natural"]
    assert not R.parse_action("INIT", menu, True)["valid"] and R.parse_action("init", menu, False)["valid"]
    assert not R.parse_action("A9", menu)["valid"] and not R.parse_action(None, menu)["natural"]


def test_navigation(spark):
    w = N.World(["s1", "s2"], {"s1": ["e1"], "s3": ["e2"]}, {"e1": ["s3", "s1"]}, {"s1": "one"})
    s, out = N.play(["INIT", "A0", "A2", "nonsense", "INIT"], w)
    assert [o["event"] for o in out] == ["INIT", "SELECT", "LOOKUP", "INVALID", "INVALID"]
    assert out[2]["new"] == ["s3"] and s.selected == ["s1"] and s.counts["lookup_new_sid_count"] == 1
    assert s.counts["natural_query_count"] == 1 and s.counts["invalid_action_count"] == 2
    before = dict(s.counts)
    N.preview(s, "A0", w)
    assert s.counts == before
    last = max(s.menu)
    assert s.menu[last][0] == "ANSWER"
    N.step(s, last, w)
    assert s.stopped and N.step(s, "A0", w)["event"] == "ANSWER" and "[OBS]" in N.observation(s, out[2], w)
    acts = spark.createDataFrame([("u", 0, "INIT"), ("u", 1, "A0"), ("v", 0, None)], "session string, turn int, action string")
    world = spark.createDataFrame([("u", ["s1"], {"s1": ["e1"]}, {"e1": ["s3"]})], "session string, first array<string>, entities map<string,array<string>>, sentences map<string,array<string>>")
    got = {r.session: r for r in N.replay(acts, world).collect()}
    assert got["u"].select_count == 1 and got["v"].invalid_action_count == 1


def test_catalogue():
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 80
