import numpy as np

from warploom.llm import p5_neighbours as p5


def scene(seed=8, lone=1400, groups=40, size=4):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, 64))
    return np.concatenate([rng.normal(size=(lone, 64)), (middle[:, None] + 0.15 * rng.normal(size=(groups, size, 64))).reshape(-1, 64)])


def test_rounds_take_only_vectors_that_have_a_near_one(spark, monkeypatch):
    x = scene()
    df = spark.createDataFrame([(f"v_{k:05d}", v.tolist()) for k, v in enumerate(x)], "id string, v array<double>")
    lists, write = [], p5.materialize

    def watched(d, name):
        out = write(d, name)
        if name == "p5g":
            lists.append(out.count())
        return out

    monkeypatch.setattr(p5, "materialize", watched)
    got = {(r.id1, r.id2) for r in p5.near_pairs(df, "id", "v").collect()}
    # the 1,400 random vectors, near to nobody, have no lists
    assert lists and max(lists) == 160
    assert got == {(f"v_{i:05d}", f"v_{j:05d}") for g in range(1400, 1560, 4) for i in range(g, g + 4) for j in range(i + 1, g + 4)}


def test_near_neighbours_of_whole_cells_are_exact():
    # 90 vectors near to one another, more than are picked one by one, and groups of four
    rng = np.random.default_rng(9)
    x = np.concatenate([scene(), rng.normal(size=64) + 0.1 * rng.normal(size=(90, 64))]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i], kind="stable")[:8] if s[i, j] >= 0.9}
    a, b, _ = p5.near_neighbours(x, 8, 0.9, np.random.default_rng(1))
    assert set(zip(a.tolist(), b.tolist())) == want
    # more than are compared as a whole: several trees of leaves
    a, b, _ = p5.near_neighbours(x, 8, 0.9, np.random.default_rng(1), whole=200)
    got = set(zip(a.tolist(), b.tolist()))
    assert all(s[i, j] >= 0.9 for i, j in got) and len(got & want) >= 0.9 * len(want)
    assert not len(p5.near_neighbours(x[:0], 8, 0.9, rng)[0]) and not len(p5.near_neighbours(x[:1], 8, 0.9, rng)[0])


def test_near_lists_join_across_cells(spark, monkeypatch):
    # small cells and two trees leave pairs out, which the descent finds
    monkeypatch.setattr(p5, "CELL", 50)
    x = scene(lone=1000, groups=60, size=8)
    df = spark.createDataFrame([(f"v{k:04d}", v.tolist()) for k, v in enumerate(x)], "id string, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(f"v{min(i, j):04d}", f"v{max(i, j):04d}") for i in range(len(x)) for j in np.argsort(-s[i], kind="stable")[:5] if s[i, j] >= 0.9}
    got, first = ({(r.id1, r.id2) for r in p5.near_pairs(df, "id", "v", trees=2, rounds=n).collect()} for n in (None, 0))
    assert len(got & want) > len(first & want) and len(got - want) <= 0.02 * len(want)
