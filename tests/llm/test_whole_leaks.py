import random

from warploom.llm import p8_leaks as p8

BODY = "Quentin Abelard restored the harpsichord of Margrave Wendelin in a narrow workshop behind the municipal museum of Oldenburg while his apprentice Fridolin catalogued strings"


def leaked(text, items):
    return [x[0] for x in p8.ItemIndex(items).leaks(text)]


def test_all_ids_of_equal_items_leak():
    items = [(i, BODY) for i in range(1, 7)]
    assert leaked(f"before it {BODY} and after", items) == [1, 2, 3, 4, 5, 6]
    assert leaked("nothing of the sort stands here", items) == []


def test_passage_that_many_items_share_leaks_all_of_them():
    names = ["Aldous", "Berenike", "Casimir", "Dorothea", "Emmerich", "Florentin"]
    items = [(i, f"{BODY} according to {n} the {n}son chronicler") for i, n in enumerate(names, 1)]
    part = " ".join(BODY.split()[2:20])
    assert leaked(f"so {part} it ends", items) == [1, 2, 3, 4, 5, 6]
    assert leaked(" ".join(BODY.split()[2:12]), items) == []


def test_passages_of_short_words_have_a_pattern():
    item = "we go to an inn by the sea as he is at it on an ox in my cart"
    assert leaked(f"then {item} again", [(1, item)]) == [1]


def test_hits_too_few_for_a_run_are_not_chained(monkeypatch):
    words = [f"{a}{b}" for a in ("mondra", "vestik", "pluram", "gorith") for b in ("elin", "ostav", "urim", "ybek", "anso")]
    index = p8.ItemIndex([(1, " ".join(words))])
    calls, chain = [], p8.ItemIndex._chain
    monkeypatch.setattr(p8.ItemIndex, "_chain", lambda self, *a: calls.append(1) or chain(self, *a))
    assert index.leaks("before " + " ".join(words[3:7]) + " after") == [] and not calls
    assert [r[:2] for r in index.leaks("before " + " ".join(words[2:19]) + " after")] == [(1, 17)] and calls


def test_prefix_distance_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        w, flat, most = ("".join(rng.choice("abc") for _ in range(rng.randrange(lo, 14))) for lo in (4, 0)), None, rng.randrange(1, 4)
        w, flat = w
        cost, m = p8._prefix(w, flat, most)
        want = min((p8.edit_distance(w, flat[:j]) for j in range(max(1, len(w) - most), min(len(flat), len(w) + most) + 1)), default=most + 1)
        assert (cost == want and p8.edit_distance(w, flat[:m]) == cost) if want <= most else cost > most
