"""Credit queries over whole episodes, against brute force."""

import datetime
from itertools import combinations
from math import factorial

import pytest

from warploom.plans import credit_plans as P

#: Two episodes: one longer than six steps, one short.
SIZES = {"u1": 9, "u2": 4}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d, rows = tmp_path_factory.mktemp("tables"), []
    for u, n in SIZES.items():
        for k in range(n):
            i = len(rows) * 3 + 1
            rows.append((i, datetime.datetime(2024, 1, 1 + k), u, ("view", "error", "click")[i % 4 % 3], float((i * 37) % 101), ""))
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id string, event_type string, value double, props string").write.parquet(f"{d}/events.parquet")
    lines = [(1, k, 1, 1, 1.0, datetime.date(2024, 1, k), q, 0.01 * k) for k, q in ((1, 29.0), (2, 30.0), (3, 47.0))]
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_extendedprice double, l_shipdate date, l_quantity double, l_discount double").write.parquet(f"{d}/lineitem.parquet")
    return str(d)


def episodes():
    out, at = {}, 0
    for u, n in SIZES.items():
        ids = [(at + k) * 3 + 1 for k in range(n)]
        out[f"{u}:2024-01"] = [{"t": k, "ig": float((i * 37) % 101), "x": i % 7, "y": i % 5, "type": ("view", "error", "click")[i % 4 % 3]} for k, i in enumerate(ids)]
        at += n
    return out


def edges(s):
    return {(max(m["t"] for m in s[: u["t"]] if m["x"] == u["y"]), u["t"]) for u in s if any(m["x"] == u["y"] for m in s[: u["t"]])}


def enabled(s):
    c = [0.0] * len(s)
    for u in range(len(s) - 1, -1, -1):
        pred = [a for a, b in edges(s) if b == u]
        for a in pred:
            c[a] += (s[u]["ig"] + 0.5 * c[u]) / len(pred)
    return c


def rows(df, *cols):
    return {tuple(r[c] for c in cols[:-1]): r[cols[-1]] for r in df.collect()}


def test_edges(spark, tables):
    got = {tuple(r) for r in P.provenance(spark, tables).select("episode", "src", "dst").collect()}
    assert got == {(e, *x) for e, s in episodes().items() for x in edges(s)} and any(dst >= 6 for _, _, dst in got)
    got = {tuple(r) for r in P.shared(spark, tables).select("episode", "src", "dst").collect()}
    assert got == {(e, a["t"], b["t"]) for e, s in episodes().items() for a, b in combinations(s, 2) if {a["x"], a["y"]} & {b["x"], b["y"]}}


def test_enabling_and_total(spark, tables):
    want = {(e, k): c for e, s in episodes().items() for k, c in enumerate(enabled(s))}
    assert rows(P.enabling(spark, tables), "episode", "t", "r_en") == pytest.approx(want, abs=1e-5)
    gain = {(e, x["t"]): x["ig"] - 50 for e, s in episodes().items() for x in s}
    total = {k: (0.0 if c > 1e-4 and gain[k] < 0 else gain[k]) + c for k, c in want.items()}
    assert rows(P.total(spark, tables), "episode", "t", "credit") == pytest.approx(total, abs=1e-5)


def test_frontier(spark, tables):
    mean, most = {}, {}
    for e, s in episodes().items():
        for x in s:
            rest = [y["ig"] for y in s if y is not x]
            mean[e, x["t"]] = 0.0 if x["type"] == "error" else x["ig"] - sum(rest) / len(rest)
            most[e, x["t"]] = 0.0 if x["type"] == "error" else x["ig"] - max(rest)
    df = P.frontier(spark, tables)
    assert rows(df, "episode", "t", "mean") == pytest.approx(mean, abs=1e-5) and rows(df, "episode", "t", "max") == pytest.approx(most, abs=1e-5)


def test_shapley(spark, tables):
    want = {}
    for e, s in episodes().items():
        n, value = len(s), lambda ks: sum(s[k]["ig"] for k in ks) * len(ks)
        for i in range(n):
            rest = [k for k in range(n) if k != i]
            want[e, i] = sum(factorial(m) * factorial(n - m - 1) / factorial(n) * (value((*c, i)) - value(c)) for m in range(n) for c in combinations(rest, m))
    assert rows(P.shapley(spark, tables), "episode", "t", "value") == pytest.approx(want, abs=1e-4)


def test_structure_and_spans(spark, tables):
    r = P.structure(spark, tables).first()
    assert (r.episodes, r.mean_steps, r.edges) == (2, 6.5, sum(len(edges(s)) for s in episodes().values()))
    # every line of the order counts, large ones too
    assert [tuple(r) for r in P.spans(spark, tables).collect()] == [(1, 1 + 2 + 3, 0.06)]
