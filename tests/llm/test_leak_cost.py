import random

from warploom.llm import p8_leaks as p8


def altered(w, rng, times):
    f = list(w)
    for _ in range(times):
        k = rng.randrange(len(f) + 1)
        f[k : k + rng.randrange(2)] = rng.choice(["", "a", "b", "x"])
    return "".join(f)


def test_prefixes_that_are_far_are_not_compared(monkeypatch):
    calls, prefix = [], p8._prefix
    monkeypatch.setattr(p8, "_prefix", lambda *a: calls.append(1) or prefix(*a))
    assert p8._next("margravewendelin", [8, 16], "quickfoxjumpedover") is None and not calls
    assert p8._next("margravewendelin", [8, 16], "margrafewendelin") and calls


def test_near_leaves_no_prefix_out():
    rng = random.Random(5)
    for _ in range(2000):
        w, most = "".join(rng.choice("abc") for _ in range(rng.randrange(4, 30))), rng.randrange(1, 6)
        flat = altered(w, rng, rng.randrange(8)) + "abc" * rng.randrange(3)
        assert p8._near(w, flat, most) or min(p8.edit_distance(w, flat[:j]) for j in range(len(flat) + 1)) > most


def test_distance_by_bits():
    rng = random.Random(6)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abcde") for _ in range(rng.randrange(rng.choice([1, 4, 20, 80])))) for _ in "ab")
        assert p8._distance(a, b) == p8.edit_distance(a, b)
