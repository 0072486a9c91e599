import numpy as np
import pyarrow as pa

from warploom.llm import p5_neighbours as p5


def vectors(n=1500, dim=64, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(n // 5, dim))
    x = np.repeat(centre, 5, axis=0) + rng.normal(scale=0.25, size=(n // 5 * 5, dim))
    return [(f"v{k:05d}", [float(np.float32(z)) for z in v]) for k, v in enumerate(x)]


def wanted(rows, k=5, least=0.9):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 5)
    out = set()
    for a in range(len(ids)):
        best = sorted((j for j in range(len(ids)) if j != a and s[a, j] >= least), key=lambda j: (-s[a, j], ids[j]))[:k]
        out |= {(min(ids[a], ids[j]), max(ids[a], ids[j])) for j in best}
    return out


def test_recall_against_brute_force(spark):
    rows = vectors()
    copies = [(f"w{k:03d}", [2 * z for z in rows[0][1]]) for k in range(9)] + [(f"u{k}", rows[7][1]) for k in range(2)]
    dirt = [("n1", None), ("n2", [0.0] * 64), ("n3", [float("nan")] * 64), ("n4", [1.0] * 3), ("n5", [1.0] * 63 + [float("inf")]), (None, rows[3][1]), rows[5]]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + copies + dirt], "eid string, embedding array<float>, nid int, code string")
    got = {(r.id1, r.id2) for r in p5.near_pairs(df, "eid", "embedding").collect()}
    want = wanted(rows + copies)
    assert len(got & want) / len(want) >= 0.95 and len(got - want) <= 0.02 * len(want)
    assert not any(i.startswith("n") for p in got for i in p)


def test_nothing_and_one(spark):
    schema = "eid string, embedding array<float>"
    assert p5.near_pairs(spark.createDataFrame([], schema), "eid", "embedding").count() == 0
    assert p5.near_pairs(spark.createDataFrame([("a", [1.0] * 64)], schema), "eid", "embedding").count() == 0
    same = [(c, [1.0] * 64) for c in "abcdefgh"]
    got = {(r.id1, r.id2) for r in p5.near_pairs(spark.createDataFrame(same, schema), "eid", "embedding").collect()}
    # everyone's five smallest other ids
    assert got == {tuple(sorted((x, y))) for x in "abcdefgh" for y in [z for z in "abcdefgh" if z != x][:5]}


def test_search(spark):
    rows = vectors(600)
    nodes, g, _ = p5.graph(spark.createDataFrame(rows, "eid string, embedding array<float>"), "eid", "embedding")
    q = nodes.where("id like 'v000_0'").selectExpr("id as qid", "code")
    got = {(r.qid, r.id) for r in p5.search(q, nodes, g, k=3).collect()}
    x = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    ids = sorted(x)
    want = {(a, b) for a in [f"v000{k}0" for k in range(10)] for b in sorted(ids, key=lambda b: -float(x[a] @ x[b]))[:3]}
    assert len(got & want) / len(want) >= 0.9


def test_unit():
    rows, codes = p5.unit(pa.array([[3.0, 4.0], None, [0.0, 0.0], [1.0], [None, 1.0], [1e30, 1e30]], pa.list_(pa.float32())), 2)
    assert rows.tolist() == [0, 5] and np.allclose(codes / p5.SCALE, [[0.6, 0.8], [2**-0.5, 2**-0.5]], atol=1e-4)


def test_merge_keeps_ties_in_order():
    n, i, s = p5.merge(np.array([1, 1, 1, 2, 1]), np.array([5, 4, 5, 9, 6]), np.array([0.5, 0.5, 0.5, 1.0, 0.9], dtype=np.float32), 2)
    assert list(zip(n, i)) == [(1, 6), (1, 4), (2, 9)]
