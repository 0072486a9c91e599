from warploom.llm import p2_pairs as p2
from warploom.llm.textfold import Fold


def test_words_in_small_letters_are_known_from_few_texts(spark):
    said = ["I have no acquaintance with it.", "I have an acquaintance of it.", "Looking at it, the catal", "Looking at that, the catal", "songs for klodre", "it is klodre"]
    df = spark.createDataFrame([(k, f"Who directed Songs for Mu{k}?", t, []) for k, t in enumerate(said)], "result_id long, question string, prediction string, golden_answers array<string>")
    vocab, ends = p2.words(p2.records(df))
    # two texts with capitals hold it in small letters; a cut word and a name in a text without capitals stay unknown
    assert vocab.get("acquaintance") is False and "catal" not in vocab and "klodre" not in vocab
    model = {"vocab": vocab, "ends": ends, "tongues": p2.Tongues({})}
    q = "Who directed Songs for Klodre?"
    start, bits = p2.GROUPS["words"]
    words = [{x for x in p2.features(q, a, [], model, Fold()).tolist() if start <= x < start + (1 << bits)} for a in ("I have no acquaintance with Songs for Klodre", "i have no acquaintance with songs for klodre")]
    assert words[0] == words[1]
