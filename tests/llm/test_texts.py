import random

import numpy as np
import pytest

from warploom.llm import p2_pairs as p2
from warploom.llm import p6_split as p6
from warploom.llm import p7_pack as p7
from warploom.llm import p8_leaks as p8
from warploom.llm import p9_abuse as p9
from warploom.llm.tokens import TOKEN, n_tokens


def test_token_counts(spark):
    texts = ["a b_1, é!", "", None, "x y z", "​--", "naïve 数字 ١٢", "a\x1cb"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(n_tokens("text")).collect()]
    assert got == [len(TOKEN.findall(t or "")) for t in texts]


# --- splitting ---


def test_cut_points_hold_their_limits():
    rng = random.Random(2)
    for _ in range(300):
        n, limit = rng.randrange(1, 400), rng.randrange(1, 60)
        overlap = rng.randrange(0, limit + 3)
        strength = [rng.choice((0, 0, 0, 1, 2, 4)) for _ in range(n)]
        parts = p6.cut_points(n, limit, overlap, strength)
        lap = min(overlap, limit - 1) if len(parts) > 1 else 0
        assert parts[0][0] == 0 and parts[-1][1] == n and all(0 < e - s <= limit for s, e in parts)
        assert all(a[1] - b[0] == lap for a, b in zip(parts, parts[1:]))


def test_cuts_at_paragraphs():
    text = "one two three four five.\n\nsix seven eight nine ten. eleven twelve."
    spans = [m.span() for m in TOKEN.finditer(text)]
    strength = p6.strengths(text, spans)
    assert p6.cut_points(len(spans), 10, 0, strength)[0][1] == 6 and strength[6] == p6.PARAGRAPH


def test_pieces(spark):
    docs = [(1, "c", "word " * 25, 0), (2, "c", None, 0), (3, None, "word " * 99, 0), (4, "free", "word " * 99, 0), (5, "c", "", 0), (6, "c", "word " * 10, 0), (7, "c", "x" * 200_000 + " y" * 30, 0), (8, "late", "a b c d", 0)]
    man = [("c", 10, 2, 1), ("c", 10, 2, 1), ("c", None, 2, 9), ("free", None, 1, 1), ("late", 3, None, 1), (None, 1, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, corpus_id string, text string, overlap int")
    m = spark.createDataFrame(man, "corpus_id string, max_token_size int, overlap_token_size int, built_at int").withColumn("loaded_at", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    rows = p6.split(p6.oversized(d, m)).collect()
    assert {r.doc_id for r in rows} == {1, 7, 8}
    for doc in (1, 7, 8):
        own = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.piece)
        text = next(x[2] for x in docs if x[0] == doc)
        assert all(r.text == text[r.start : r.end] and r.n_tokens == len(TOKEN.findall(r.text)) <= (3 if doc == 8 else 10) for r in own)
        assert sum(r.n_tokens - r.overlap for r in own) == len(TOKEN.findall(text))
    assert p6.split(p6.oversized(d.limit(0), m)).count() == 0 and p6.oversized(d, m.limit(0)).count() == 0


# --- packing ---


def test_pack_against_bounds():
    rng = np.random.default_rng(3)
    for cap in (10, 50, 512):
        for n in (0, 1, 7, 500):
            sizes = rng.integers(1, cap + 1, n)
            where = p7.pack(sizes, cap)
            load = np.bincount(where, sizes) if n else np.zeros(0)
            assert len(where) == n and (load <= cap).all() and (not n or set(where) == set(range(len(load))))
            assert len(load) <= 1.7 * -(-sizes.sum() // cap) + 1
    assert len(set(p7.pack(np.full(12, 5), 10))) == 6


def test_placement(spark):
    docs = [(1, "a " * 30, "x"), (2, "b " * 7, "x"), (3, None, "x"), (4, "", "x"), (5, "c " * 7, "x"), (6, "   ", "x"), (7, "d " * 20, "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, profile string")
    c = spark.createDataFrame([("s", 10), ("s", 10), ("l", 100), (None, 5), ("z", 0), ("n", None)], "profile string, capacity int")
    rows = p7.place(d, c, shard_docs=3).collect()
    for profile, cap in (("s", 10), ("l", 100)):
        own = [r for r in rows if r.profile == profile]
        by = {}
        for r in own:
            by.setdefault((r.shard, r.container), []).append(r.tokens)
        assert all(sum(x) <= cap for x in by.values())
        done = {}
        for r in own:
            done[r.doc_id] = done.get(r.doc_id, 0) + r.tokens
        assert done == {1: 30, 2: 7, 5: 7, 7: 20}
        assert all(r.tokens == cap for r in own if r.part < 0) and len({(r.doc_id, r.part) for r in own}) == len(own)
    assert {r.profile for r in rows} == {"s", "l"}
    assert p7.place(d.limit(0), c).count() == 0


# --- leaks ---

ITEM = "Few visitors remember that Flilefer once lent its museum to Quentin Gotowur Fukudo, whose public workshop burned in 1950 and was never rebuilt by anyone at all."
STOCK = "Answer with the name of a person, a place or a work of some kind please now and without any other words at all."


def leaks(text, items=((1, ITEM),)):
    return [x[:2] for x in p8.ItemIndex(list(items)).leaks(text)]


def test_leaks_found_however_altered():
    words = ITEM.split()
    part = " ".join(words[3:22])
    assert leaks(f"before {ITEM} after") and leaks(part) and leaks(part.upper()) and leaks("".join(part.split()))
    assert leaks(part.replace("museum", "musuem").replace("workshop", "work-\nshop")) and leaks(part.replace("a", "á").replace("o", "о"))
    assert leaks(part.replace("Quentin", "[photo caption omitted] Quentin"))
    assert not leaks(" ".join(words[3:15])) and not leaks("") and not leaks(None) and not leaks("word " * 5000)
    other = ITEM.replace("Flilefer", "Kodaru").replace("Quentin Gotowur Fukudo", "Una Sapik Brolem").replace("1950", "1871").replace("museum", "bridge")
    assert not leaks(other)


def test_stock_openings_do_not_count():
    items = [(k, f"{STOCK} {ITEM.replace('Flilefer', f'Town{k}x').replace('Gotowur', f'Nam{k}e')}") for k in range(4)]
    assert leaks(STOCK, items) == []
    text = "x " * 50 + items[2][1]
    assert 2 in [i for i, _ in leaks(text, items)]


def test_leak_offsets(spark):
    docs = spark.createDataFrame([(1, "Intro — " + ITEM + " end", 5), (2, None, 5), (3, "", 5)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, ITEM), (7, ITEM), (8, None), (9, "too short"), (None, ITEM)], "item_id long, item_text string")
    rows = p8.leaked_items(docs, items).collect()
    assert [(r.doc_id, r.item_id) for r in rows] == [(1, 7)] and rows[0].start == 8 and rows[0].end == 8 + len(ITEM) - 1
    assert p8.leaked_items(docs, items.limit(0)).count() == 0 and p8.leaked_items(docs.limit(0), items).count() == 0


# --- pairs ---


def test_pair_classifier(spark):
    rng = random.Random(4)
    name = lambda: "".join(rng.choice(["ba", "dre", "fi", "klo", "mu", "stan", "wol"]) for _ in range(3)).capitalize()
    ask = ["Who directed the film {t}?", "In what year was {t} first performed?", "The music for {t} was composed by whom?"]
    say = ["{a}", "{a}", "The answer is {a}.", "According to the passages that were collected, the person or thing asked about is {a}, and nothing else contradicts it.", "My reading of the third sentence is that {a} must be correct, given the surrounding lines."]
    fr = ["La réponse est {a}, comme le confirme la deuxième phrase du texte.", "D'après les passages trouvés, il s'agit de {a}, ce qui est clair."]
    rows = []
    for k in range(900):
        t, a = f"Songs for {name()} {name()}", f"James {name()} {name()}"
        french = k % 5 == 0
        q = (f"Qui a réalisé le film {t} ?" if french else rng.choice(ask).replace("{t}", t))
        rows.append([k, q, rng.choice(fr if french else say).replace("{a}", a), [a]])
    english = [r for r in rows if r[1][:3] != "Qui"]
    truth = {}
    for r, kind, text in zip(english[:40:4], ["empty"] * 3 + ["refusal"] * 3 + ["copied_question"] * 2 + ["other_language"] * 2, [None, "<answer> </answer>", "N/A", "I'm sorry, but I cannot answer this question.", "I do not have enough information to answer.", "Unfortunately, no answer can be given.", None, None, fr[0].replace("{a}", "James Bafimu Klodre"), fr[1].replace("{a}", "James Bafimu Klodre")]):
        r[2] = r[1] if kind == "copied_question" else text
        truth[r[0]] = kind
    for r in english[41:60:6]:
        r[2] = "<answer>According to the passages that were collected, the person or th"
        truth[r[0]] = "truncated"
    df = spark.createDataFrame([(*r, "c") for r in rows] + [(*rows[0], "d"), (None, "q", "a", ["b"], "c"), (2000, None, None, None, "c"), (2001, "Who?", "x " * 30_000, ["James"], "c"), (2002, "Who directed it?", "James Bafimu Klodre", ["", "N/A"], "c")], "result_id long, question string, prediction string, golden_answers array<string>, defect string")
    got = {(r.result_id, r.answer_field): r.defect for r in p2.defects(df, p2.train(df, fit_rows=2000)).collect()}
    hits = sum(got.get((k, "prediction")) == v for k, v in truth.items())
    assert hits >= len(truth) - 2
    wrong = [k for (k, f) in got if f == "prediction" and k < 2000 and k not in truth]
    assert len(wrong) <= 12
    assert got[2000, "prediction"] == got[2000, "golden_answers"] == "empty" and got[2002, "golden_answers"] == "empty"


# --- abuse ---


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(6)
    plain = ["The town of {p} has {y} inhabitants and a quiet tower.", "{n} restored a wooden chapel for {o} before the war.", "In {y} the bridge of {p} was painted under a new name.", "Die Bewohner von {p} haben das Museum {y} restauriert.", "Les habitants de {p} ont traduit le roman.", "El museo de {p} se restauró en {y}."]
    docs = [" ".join(p9.fill(plain[rng.integers(6)], "en", rng) for _ in range(25)) for _ in range(60)]
    return p9.fit(docs, most=6000)


def test_held_out_sentences(model):
    s = p9.Scorer(model)
    pad = "The town of Bokalim has 300 inhabitants and a quiet tower. "
    bad = {
        "abuse": ["Shut up, you pathetic loser, nobody asked you.", "Eres un cabrón y todos te odian.", "Halt die Fresse, du Idiot.", "{}, you are a stupid pig and everyone here despises you.".format("Hugo")],
        "hate": ["The Zorbani are vermin and must be driven out of here.", "Les Zorbani sont tous des voleurs, dehors !", "Alle Zorbani sind Verbrecher und Schmarotzer."],
        "sexual": ["Click for hot nude pics and porn videos.", "They undressed each other, had sex on the floor and moaned.", "Pornovideos mit geilen nackten Frauen."],
    }
    for k, name in enumerate(p9.CATEGORIES):
        q = s.score([pad * 3 + x + " " + pad * 3 for x in bad[name]])
        assert (q[:, k] >= p9.THRESHOLD).mean() >= 0.75, (name, q)
    good = ["The bitch had five puppies, and the breeder sold them.", "A blue tit, a cock and a booby appear on the coat of arms.", "Nurses teach mothers how to breastfeed in the first weeks.", pad * 40, "", None, "x " * 20_000]
    assert (s.score(good) < p9.THRESHOLD).all()


def test_disguises(model):
    lex = p9.Scorer(model).lex
    assert lex.plain("n4k3d") == "naked" and lex.plain("n***d") == "naked" and lex.plain("nakkkked") == "naked"
    assert "naked" in [lex.plain(w) for w in lex.words("so n a k e d here")] and lex.plain("nаkеd".translate(lex.fold)) == "naked"


def test_gradients_match_differences():
    rng = np.random.default_rng(8)
    p = {k: v.astype(np.float64) for k, v in p9.init(12, rng).items()}
    tr = [p9.triples(f"w{k}") for k in range(12)]
    size = np.array([len(t) for t in tr])
    chars = (np.concatenate(tr), np.r_[0, np.cumsum(size)[:-1]], size)
    ids, y, w = rng.integers(0, 12, (5, 6)), rng.integers(0, 2, (5, 3)).astype(float), np.ones(5)
    ids[:, 0] = 3
    _, g = p9.gradients(ids, y, p, chars, w)
    for name in ("wf", "ub", "att", "attv", "out", "bias"):
        at = tuple(rng.integers(0, n) for n in p[name].shape)
        h = 1e-3
        q = {k: v.copy() for k, v in p.items()}
        q[name][at] += h
        up = p9.gradients(ids, y, q, chars, w)[0]
        q[name][at] -= 2 * h
        down = p9.gradients(ids, y, q, chars, w)[0]
        assert (up - down) / (2 * h) == pytest.approx(float(g[name][at]), abs=3e-3)


def test_scores_of_rows(spark, model):
    df = spark.createDataFrame([(1, "Shut up, you pathetic loser, nobody asked you.", 1.0), (2, None, None), (3, "", None), (3, "", None), (None, "x", None)], "doc_id long, text string, abuse double")
    rows = p9.score_docs(df, model).collect()
    assert len(rows) == 4 and next(r.abuse for r in rows if r.doc_id == 1) > 0.5 and all(r.abuse == 0 for r in rows if r.doc_id != 1)
    assert p9.score_docs(df.limit(0), model).count() == 0


def test_labels_teach_only_by_what_toxic_documents_alone_hold():
    # one label in six is wrong, and the same clean sentences, offensive words or not, stand in documents of both labels
    rng = np.random.default_rng(4)
    plain = ["{p} has two rivers and an old bridge.", "In {y} the mayor opened a school in {p}.", "Farmers of {p} say that the land was a waste of space.", "The book {w} was read aloud in {y}."]
    said = ["Nobody likes you, {n}, you worthless liar.", "{n}, you stupid pig, nobody likes you at all."]
    doc = lambda: [p9.fill(f, "en", rng) for f in rng.choice(plain, 6)]
    clean = [" ".join(doc()) for _ in range(120)] + [" ".join([*doc(), p9.fill(said[0], "en", rng)]) for _ in range(2)]
    toxic = [" ".join([*doc(), p9.fill(said[k % 2], "en", rng)]) for k in range(50)] + [" ".join(doc()) for _ in range(10)]
    model = p9.fit(clean, most=3000)
    marks = p9.Marks(clean, toxic, p9.Lexicon(model["known"], model["starred"]))
    weak = p9.weak_positives(toxic, model, marks)
    assert len(weak) >= 40 and all("you" in t and k == 0 for k, t, _ in weak)
    assert len(p9.make(clean, rng, weak, marks)["suspect"]) >= 2
    s = p9.Scorer(p9.fit(clean, weak=weak, marks=marks, most=3000))
    assert (s.score([p9.fill(f, "en", rng) for f in plain for _ in range(10)]) < p9.THRESHOLD).all()
    assert (s.score([p9.fill(f, "en", rng) for f in said for _ in range(10)])[:, 0] >= p9.THRESHOLD).mean() >= 0.9
