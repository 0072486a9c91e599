import numpy as np

from warploom.llm import p5_neighbours as p5


def test_all_legs_of_a_hub_are_compared():
    # 60 vectors have number 0 in their lists; the last two are nearest to each other
    n, rng = 61, np.random.default_rng(3)
    x = rng.normal(size=(n, 64)).astype(np.float32)
    x[60] = x[59] + 0.01 * rng.normal(size=64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b, s = p5.local_join(np.arange(1, n), np.zeros(n - 1, dtype=np.int64), x, np.arange(n), 6)
    got = {k: {int(j) for i, j in zip(a, b) if i == k} for k in range(1, n)}
    sim = x @ x.T
    for k in range(1, n):
        rest = [j for j in range(1, n) if j != k]
        assert got[k] == set(sorted(rest, key=lambda j: -sim[k, j])[:6])


def test_merge_drops_repeats_that_differ_in_the_last_bits():
    n, i, _ = p5.merge(np.array([1, 1, 1]), np.array([5, 7, 5]), np.array([0.5, 0.49999997, 0.49999994], dtype=np.float32), 3)
    assert list(zip(n, i)) == [(1, 5), (1, 7)]


def test_descends_until_settled(spark, monkeypatch):
    # with two trees of small cells the lists have not settled after two rounds
    monkeypatch.setattr(p5, "CELL", 50)
    sweeps, sweep = [], p5._sweep
    monkeypatch.setattr(p5, "_sweep", lambda s: (sweeps.append(1), sweep(s)))
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 6)) @ rng.normal(size=(6, 64))
    df = spark.createDataFrame([(f"v{k:04d}", [float(z) for z in v]) for k, v in enumerate(x)], "eid string, embedding array<float>")
    nodes, g, _ = p5.graph(df, "eid", "embedding", trees=2)
    assert len(sweeps) > 2 + 2
    at = {r.nid: int(r.id[1:]) for r in nodes.select("nid", "id").collect()}
    got = {(at[r.nid], at[j]) for r in g.collect() for j in np.frombuffer(r.ids, dtype=np.int64).tolist()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    want = {(a, int(b)) for a in range(len(x)) for b in np.argsort(-s[a])[:5]}
    assert len(got & want) >= 0.9 * len(want)


def test_only_pairs_with_a_new_edge_are_compared():
    # number 0 has 1 to 4 in its list, of which 4 is new; 5 holds 6 and 7 from before
    rng = np.random.default_rng(2)
    x = rng.normal(size=(8, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own, ids = np.array([0, 0, 0, 0, 5, 5]), np.array([1, 2, 3, 4, 6, 7])
    a, b, _ = p5.local_join(own, ids, x, np.arange(8), 8, ids == 4)
    assert {(int(i), int(j)) for i, j in zip(a, b)} == {(4, 1), (4, 2), (4, 3), (1, 4), (2, 4), (3, 4)}


def test_descent_by_new_edges_gives_the_lists_of_the_whole_join(spark, monkeypatch):
    monkeypatch.setattr(p5, "CELL", 50)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 8)) @ rng.normal(size=(8, 64))
    df = spark.createDataFrame([(f"v{k:04d}", [float(z) for z in v]) for k, v in enumerate(x)], "eid string, embedding array<float>").coalesce(1)
    join, seen = p5.local_join, []

    def whole(own, ids, x, at, keep, fresh=None):
        return join(own, ids, x, at, keep)

    for way in (join, whole):
        monkeypatch.setattr(p5, "local_join", way)
        nodes, g, _ = p5.graph(df, "eid", "embedding", trees=1, rounds=3)
        at = {r.nid: r.id for r in nodes.select("nid", "id").collect()}
        seen.append({at[r.nid]: {at[j] for j in np.frombuffer(r.ids, dtype=np.int64).tolist()} for r in g.collect()})
    assert seen[0] == seen[1]
