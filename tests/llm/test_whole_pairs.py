import random
from collections import Counter

from pyspark.sql import functions as F

from warploom.llm import p2_pairs as p2

REFUSALS = [
    "I cannot answer this question.", "It is not possible for me to say from the evidence given.", "I'd rather not speculate about this.", "I must decline to answer.", "Sorry, no conclusion can be drawn by me.", "No answer can be given on that evidence.",
    "My apologies, this is outside of what I can discuss.", "With what was found, it remains unclear to me what the answer would be.", "I am not certain and therefore cannot respond to a question about {t}.", "I do not have enough information to answer.",
]
SAY = ["{a}", "{a}", "The answer is {a}.", "The second passage names {a}, which settles the question.", "According to the passages that were collected, the person or thing asked about is {a}, and nothing else contradicts it."]


def table(spark, n):
    rng = random.Random(8)
    name = lambda: "".join(rng.choice(["ba", "dre", "fi", "klo", "mu", "stan", "wol"]) for _ in range(3)).capitalize()
    rows, refused = [], set()
    for k in range(n):
        t, a = f"Songs for {name()} {name()}", f"James {name()} {name()}"
        says = rng.choice(SAY).replace("{a}", a if k % 3 else f"Albert {name()} {name()}")
        if k % 25 == 0:
            says = REFUSALS[k // 25 % len(REFUSALS)].replace("{t}", t)
            refused.add(k)
        rows.append((k, f"Who directed the film {t}?", says, [a]))
    return spark.createDataFrame(rows, "result_id long, question string, prediction string, golden_answers array<string>"), rows, refused


def test_refusals_of_other_words_are_found(spark):
    df, _, refused = table(spark, 1000)
    got = {r.result_id for r in p2.defects(df, p2.train(df)).where("answer_field = 'prediction' and defect = 'refusal'").collect()}
    assert len(got & refused) >= 0.9 * len(refused) and len(got - refused) <= 3


def test_words_are_counted_in_all_rows(spark):
    df, rows, _ = table(spark, 400)
    model = p2.train(df, fit_rows=150)
    texts = Counter(w for *_, a, g in rows for x in (a, *g) for w in x.lower().replace(".", " ").replace(",", " ").replace("'", " ").split())
    for w in ("james", "question", "passages"):
        assert model["ends"][w][0] == texts[w]
    again = p2.train(df.repartition(5, F.col("question")), fit_rows=150)
    assert abs(again["w"] - model["w"]).max() < 1e-5 and (again["cut"] == model["cut"]).all()


def test_refusals_of_the_tables_are_found(spark):
    d = "/root/testdata/sf0.1"
    said = F.regexp_extract(F.lower("prediction"), "i cannot answer this question|must decline to answer|outside of what i can discuss|not possible for me to say|no answer can be given|enough information to answer|not speculate about this|unable to (provide|verify)|no puedo responder|ne peux pas répondre|kann ich nicht beantworten", 0)
    refused = {r.result_id for r in spark.read.parquet(f"{d}/results_step120.parquet").where(said != "").select("result_id").distinct().collect()}
    got = {r.result_id for r in p2.found(spark, d).where("answer_field = 'prediction' and defect = 'refusal'").collect()}
    assert len(refused) >= 5 and len(got & refused) >= 0.95 * len(refused)
