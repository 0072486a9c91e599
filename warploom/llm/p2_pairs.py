"""Problem 2: broken prompt and response pairs.

Method: a multi-label linear classifier on hashed n-grams and pair features. It is trained here, in numpy, on all question
and answer pairs of the tables and on broken copies made of them: answers cut off, questions copied with small changes,
answers swapped with those of questions in another language, refusals put together from a grammar, and empty ones. Real
pairs, and what copies hold of them, are negatives only where that is sure (they hold the golden answer, they end in a final
mark); what a first fit finds among the others joins the positives of a second. The pairs are dealt over tasks by hash; each
fits weights, which are averaged. Each label has a threshold per answer field, set on the pairs held out of all tasks.

Each label has feature groups of its own: the language label sees only which languages question and answer are in, the
copy label only what they share, and so on, so that no label learns the stock sentences of another. Names are invented
words, so n-grams are taken over classes: words that many texts have stand for themselves, words of the question,
capitalised words, numbers and unknown words for their kind. Which words belong to which language is counted in the same
pairs, starting from a list of function words.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release, spread
from .textfold import Fold

LABELS = ("empty", "truncated", "refusal", "copied_question", "other_language")
FIELDS = ("prediction", "golden_answers")
#: Pairs fitted together in one task; passes over them, at least and at most, and the rows passed beyond which they are fewer.
FIT_ROWS, EPOCHS, PASSED, PRIOR = 20_000, (3, 10), 150_000, 50
#: Broken copies of a pair by field, and the shares of the labels among those of long answers and of others.
COPIES, KINDS_LONG, KINDS_SHORT = (3, 1), (0.1, 0.4, 0.2, 0.1, 0.2), (0.1, 0.25, 0.3, 0.15, 0.2)
#: The scores counted to set thresholds: the lowest, the width of a bin, and how many.
LOWEST, STEP, BINS = -12.0, 0.05, 480
#: One record in so many is held out.
HELD = 5
#: Hashed features by group: first number and bits. words: n-grams; ends: how it ends; pair: what question and answer share; tongue: languages; void: emptiness.
GROUPS = {"words": (0, 16), "ends": (1 << 16, 15), "pair": (3 << 15, 12), "tongue": (3 << 15 | 1 << 12, 12), "void": (3 << 15 | 1 << 13, 12)}
WIDTH = (3 << 15) + 3 * (1 << 12)
#: The groups each label sees.
SEES = {"empty": ("void",), "truncated": ("ends", "void"), "refusal": ("words", "pair", "void"), "copied_question": ("pair", "void"), "other_language": ("tongue", "void")}

#: Answers that say nothing, to train the empty label with.
BLANKS = ["", " ", "\n", "-", "--", "?", "...", ".", "[]", "{}", "()", "\"\"", "''", "/", "*", "<answer></answer>", "<answer> </answer>", "<answer>-</answer>", "n/a", "N/A", "NA", "na", "none", "None", "null", "NULL", "nil", "nan", "NaN", "tbd", "TBD", "todo", "undefined", "unspecified", "not available", "not applicable", "no answer", "(no answer)", "placeholder", "[placeholder]", "blank", "[blank]", "empty", "<empty>", "missing", "xxx", "answer", "[answer]", "<answer>", "your answer here", "insert answer here", "keine Angabe", "k. A.", "s/o", "sans objet", "sin respuesta", "vacío"]
#: Frequent words that tell the languages apart.
FUNCTION = {
    "en": "the of and is was in to that for it with as by at from on this which who what when where be are has have not but so only does did would about because their its first one any other me my can",
    "fr": "le la les des du une et est dans qui que ce il elle pour par sur au aux avec ne pas sont cette quelle quel en se ses leur ou mais comme plus donc ainsi sans deux je nous vous de l d un a",
    "de": "der die das und ist ein eine einer eines dem den des zu mit von auf wird wurde nicht fur sich als auch es im bei nach aus dass wer welche welcher welchem damit denn ich wir sie er so wie zum zur laut",
    "es": "el los las una y es en que se por con para su del al lo como mas pero sus fue este esta entre cual quien donde sin ha son segun porque ninguna otra yo no de la un",
}
_FW = {w: {k for k, ws in FUNCTION.items() if w in ws.split()} for ws in FUNCTION.values() for w in ws.split()}

#: The refusal grammar by language: openings, what the speaker does not do (verbs and objects), impersonal forms, and reasons. {t} is the title asked about.
REFUSE = {
    "en": {
        "open": ["", "", "I'm sorry, ", "I am sorry, but ", "Sorry, but ", "Unfortunately, ", "I'm afraid ", "Well, ", "Regrettably, ", "Apologies, ", "As an assistant, ", "As a language model, ", "Given the sources, ", "Hmm, ", "Frankly, "],
        "do": (
            ["I cannot", "I can't", "I can not", "I could not", "I couldn't", "I am unable to", "I'm unable to", "I am not able to", "I'm not able to", "I won't", "I will not", "I would rather not", "I'd rather not", "I do not wish to", "I must decline to", "I am not allowed to", "I don't feel able to", "I have no way to", "it is impossible for me to", "it is not possible to"],
            ["answer", "say", "tell", "determine", "find", "name", "give", "provide", "offer", "confirm", "verify", "help with", "assist with", "comment on", "respond to", "speculate about", "guess", "identify", "discuss", "decide", "state", "work out", "share"],
            ["", " this", " that", " it", " the answer", " an answer", " any answer", " this question", " that question", " a question like this", " your question", " this request", " such a request", " anyone", " anything", " anything about {t}", " any name", " what is asked", " who that is", " when that was", " where that was", " more"],
        ),
        "say": ["I don't know", "I do not know", "I have no idea", "I really have no idea", "I know nothing about {t}", "I am not familiar with {t}", "I have no information on {t}", "I lack the information to answer", "I don't have the data for that", "I have no access to such data", "I am not sure about this at all", "I pass", "I'll skip this one", "no answer", "no answer is possible", "nothing can be concluded", "nothing is known about {t}", "the answer is unknown", "the answer remains unclear", "the answer cannot be found", "this cannot be answered", "this cannot be determined", "this question has no answer in the text", "that is beyond what I can talk about", "that goes beyond my abilities", "the text does not mention it", "the context does not say", "the sources say nothing about {t}", "there is not enough information", "there isn't enough evidence to tell", "insufficient information is given", "it is unclear", "it is not clear who is meant", "it cannot be said", "your guess is as good as mine"],
        "why": ["", "", "", " because there is not enough information", " because the text is silent on {t}", " as the context does not say", " since the passages do not mention it", " due to missing evidence", " for lack of evidence", " for legal reasons", " because of our rules", " as that would be against my guidelines", " without further information", " without additional sources", " with what I was given", " from these passages", " on this basis", " at the moment", ", and I do not want to mislead you", ", so I leave it open", " and it would be pure speculation"],
    },
    "fr": {
        "open": ["", "", "Désolée, ", "Je suis navré, mais ", "Pardon, ", "Malheureusement, ", "Hélas, ", "En tant qu'assistant, ", "Franchement, "],
        "do": (
            ["je ne peux pas", "je ne peux", "je ne saurais", "je n'arrive pas à", "je suis incapable de", "je ne suis pas en mesure de", "il m'est impossible de", "il n'est pas possible de", "je refuse de", "je préfère ne pas", "je ne souhaite pas", "on ne peut pas"],
            ["répondre", "dire", "trouver", "déterminer", "donner", "fournir", "confirmer", "indiquer", "aider", "deviner", "commenter", "me prononcer"],
            ["", " cela", " à cette question", " à la question", " la réponse", " de réponse", " une réponse", " sur ce point", " sur {t}", " rien sur {t}", " avec certitude", " davantage"],
        ),
        "say": ["je ne sais pas", "je l'ignore", "je n'en sais rien", "aucune idée", "aucune information sur {t}", "aucune réponse possible", "je n'ai pas cette information", "je ne connais pas {t}", "la réponse est inconnue", "la réponse ne figure pas dans le texte", "le texte ne le dit pas", "les documents ne parlent pas de {t}", "on ne sait rien de {t}", "il n'y a pas assez d'éléments", "rien ne permet de le dire", "cela reste incertain", "c'est impossible à dire", "cela dépasse mes capacités"],
        "why": ["", "", "", " faute de preuves", " car le texte n'en parle pas", " parce que les informations manquent", " sans autres sources", " avec ces seuls documents", " pour des raisons de principe", " pour le moment", ", et je ne veux pas inventer"],
    },
    "de": {
        "open": ["", "", "Tut mir leid, ", "Leider ", "Verzeihung, ", "Bedaure, ", "Als Assistent ", "Offen gesagt, "],
        "do": (
            ["ich kann", "kann ich", "ich konnte", "ich bin nicht in der Lage,", "ich möchte", "ich darf", "ich werde", "man kann", "es ist nicht möglich,", "es ist mir unmöglich,", "ich weigere mich,"],
            ["das nicht", "dies nicht", "die Frage nicht", "auf diese Frage nicht", "dazu leider nichts", "keine Antwort", "darüber nichts", "über {t} nichts", "nichts Sicheres", "niemanden", "hierbei nicht", "die Lösung nicht"],
            [" beantworten", " sagen", " antworten", " geben", " angeben", " nennen", " finden", " bestimmen", " helfen", " bestätigen", " herausfinden", " zu sagen", " zu beantworten", " mitteilen"],
        ),
        "say": ["das weiß ich nicht", "ich habe keine Ahnung", "ich habe dazu keine Angaben", "ich kenne {t} nicht", "mir liegt dazu nichts vor", "die Antwort ist unbekannt", "die Antwort steht nicht im Text", "der Text sagt nichts dazu", "zu {t} gibt es keine Angaben", "dazu fehlen die Belege", "es gibt nicht genug Hinweise", "das bleibt unklar", "das lässt sich nicht beantworten", "das lässt sich so nicht sagen", "zu {t} lässt sich nichts finden", "keine Antwort möglich", "dazu äußere ich mich nicht", "das geht über meine Möglichkeiten hinaus"],
        "why": ["", "", "", " aus Mangel an Belegen", ", da der Text dazu schweigt", ", weil Angaben fehlen", " ohne weitere Quellen", " mit diesen Texten", " aus grundsätzlichen Gründen", " im Moment", ", und raten möchte ich nicht"],
    },
    "es": {
        "open": ["", "", "Lo lamento, ", "Perdone, ", "Desgraciadamente, ", "Lamentablemente, ", "Como asistente, ", "Sinceramente, "],
        "do": (
            ["no puedo", "no podría", "no me es posible", "no soy capaz de", "no estoy en condiciones de", "es imposible", "no es posible", "me niego a", "prefiero no", "no quiero", "no se puede", "no logro"],
            ["responder", "contestar", "decir", "encontrar", "determinar", "dar", "ofrecer", "confirmar", "indicar", "ayudar", "adivinar", "comentar", "opinar"],
            ["", " eso", " a la pregunta", " esta pregunta", " la respuesta", " una respuesta", " ninguna respuesta", " sobre esto", " sobre {t}", " nada sobre {t}", " con certeza", " más"],
        ),
        "say": ["no sé", "lo ignoro", "ni idea", "no tengo esa información", "no conozco {t}", "no hay información sobre {t}", "la respuesta es desconocida", "la respuesta no está en el texto", "el texto no lo dice", "los documentos no hablan de {t}", "no se sabe nada de {t}", "no hay suficientes pruebas", "nada permite afirmarlo", "eso no está claro", "imposible saberlo", "sin respuesta posible", "eso supera mis capacidades"],
        "why": ["", "", "", " por falta de pruebas", " porque el texto no lo menciona", " ya que faltan datos", " sin otras fuentes", " con estos documentos", " por razones de principio", " por ahora", ", y no quiero inventar"],
    },
}

_TAG = re.compile(r"</?\w+>?\s*$|</?\w+>|^\s*</?\w+\s*$")
_WORD = re.compile(r"[^\W_]+|[^\w\s]")


def tokens(text: str, fold: Fold) -> list[str]:
    return _WORD.findall(text.translate(fold))


def language(ws: list[str]) -> tuple[str | None, int]:
    """The language with clearly most function words, and how many."""
    n = Counter(k for w in ws for k in _FW.get(w, ()))
    own = Counter(next(iter(_FW[w])) for w in ws if w in _FW and len(_FW[w]) == 1)
    if not n:
        return None, 0
    best = sorted(n, key=lambda k: (-(n[k] + 2 * own[k]), k))
    top = n[best[0]] + 2 * own[best[0]]
    rest = n[best[1]] + 2 * own[best[1]] if len(best) > 1 else 0
    return (best[0], n[best[0]]) if top > rest else (None, 0)


def speech(text: str, vocab: dict[str, bool], fold: Fold, names: set[str] = frozenset()) -> tuple[list[str], set[str]]:
    """The words of a text that tell its language, and its names: runs of capitalised or unknown words and what stands between them."""
    raw = re.findall(r"[^\W_]+", text)
    low = [w.translate(fold) for w in raw]
    cased = any(w[:1].islower() for w in raw) and any(w[:1].isupper() for w in raw)
    name = [not w.isdigit() and (w in names or vocab.get(w) or (vocab.get(w) is None and not (cased and raw[k][:1].islower())) or (cased and k > 0 and raw[k][:1].isupper())) for k, w in enumerate(low)]
    inside, at = list(name), [k for k, x in enumerate(name) if x]
    for i, j in zip(at, at[1:]):
        # small words between the parts of a name are of the name
        if j - i <= 3 and all(len(low[k]) <= 5 for k in range(i + 1, j)):
            for k in range(i + 1, j):
                inside[k] = True
    if at and cased and at[0] == 1 and raw[0][:1].isupper() and len(low[0]) <= 4:
        inside[0] = True
    return [w for w, x in zip(low, inside) if not x and not w.isdigit()], {w for w, x in zip(low, inside) if x}


class Tongues:
    """Which language words are of, by their counts in texts of each."""

    def __init__(self, counts: dict[str, dict[str, float]]):
        # a language that no text is in has no say
        self.counts = {k: c for k, c in counts.items() if c}
        words = len({w for c in counts.values() for w in c})
        self.total = {k: sum(c.values()) + 0.1 * words for k, c in self.counts.items()}

    def of(self, ws: list[str]) -> tuple[str | None, float]:
        """The likeliest language and its margin over the next, in nats."""
        known = [w for w in ws if any(w in c for c in self.counts.values())]
        if not known:
            return None, 0.0
        score = sorted(((sum(math.log((c.get(w, 0.0) + 0.1) / self.total[k]) for w in known), k) for k, c in self.counts.items()), reverse=True)
        return score[0][1], score[0][0] - score[1][0] if len(score) > 1 else float(len(known))


def _bin(x: float, top: int = 8) -> int:
    return int(min(top, x))


def asked(question: str, model: dict, fold: Fold) -> tuple:
    """What features needs of a question: its words, its names, and its language with the margin."""
    told, names = speech(question, model["vocab"], fold)
    return {w for w in tokens(question, fold) if w[0].isalnum()}, names, *model["tongues"].of(told)


def features(question: str | None, answer: str | None, golds: list[str], model: dict, fold: Fold, last: dict[str, tuple] | None = None) -> np.ndarray:
    """Hashed features of one pair. model: vocab (frequent words, and whether they are mostly capitalised) and tongues.

    last: what was found for the last question, kept between calls.
    """
    vocab, tongues = model["vocab"], model["tongues"]
    f: dict[str, list[str]] = {g: [] for g in GROUPS}
    raw, q = answer or "", question or ""
    bare = _TAG.sub(" ", raw)
    words = tokens(bare, fold)
    own = [w for w in words if w[0].isalnum()]
    n = len(own)
    f["void"] = [f"n:{min(n, 4)}", "anything" if n else "nothing"]
    if n <= 3:
        f["void"] += [f"whole:{' '.join(own)}", f"marks:{''.join(w for w in words if not w[0].isalnum())[:4]}", f"known:{sum(vocab.get(w) is not None for w in own)}", "kinds:" + "".join("0" if w.isdigit() else "i" if len(w) == 1 else "A" if w[0].isupper() else "a" for w in re.findall(r"[^\W_]+", bare))]
    if not n:
        return _hashed(f)
    last = {} if last is None else last
    if q not in last:
        last.clear()
        last[q] = asked(q, model, fold)
    in_q, names, lq, mq = last[q]
    cased = any(c.islower() for c in bare) and any(c.isupper() for c in bare)
    shown = {w.translate(fold): w[:1].isupper() for w in re.findall(r"[^\W_]+", bare)}
    cls = []
    for w in words:
        known = vocab.get(w)
        if not w[0].isalnum():
            cls.append(w)
        elif w.isdigit():
            cls.append("0" * len(w))
        elif known is False:
            cls.append(w)
        elif w in in_q:
            cls.append("Q")
        else:
            cls.append("C" if known else "x" if cased and not shown.get(w, True) else "X")
    squeezed = [c for k, c in enumerate(cls) if not (c == "Q" and k and cls[k - 1] == "Q")]
    f["words"] = [f"{k}:" + " ".join(squeezed[i : i + k]) for k in (1, 2, 3) for i in range(len(squeezed) - k + 1)]
    end = cls
    while end and end[-1] in ".\"')]»”":
        end = end[:-1]
    new = sum(c in ("X", "C") or c[0] == "0" for c in cls)
    e = [f"{k}:" + " ".join(end[-k:]) for k in (1, 2, 3, 4, 5) if len(end) >= k]
    final = end and next((w for w in reversed(words) if w[0].isalnum()), "")
    if final:
        kind = end[-1] if end[-1] in "CXQx" else "w"
        total, finals = model["ends"].get(final, (0, 0))
        rate = "unknown" if total < 5 else "never" if not finals else str(min(3, int(20 * finals / total)))
        e += [f"endrate:{rate}", f"endrate:{kind}{rate}", f"l:{kind}{min(len(final), 7)}", f"l2:{kind}{final[-2:]}", f"l3:{kind}{final[-3:]}", f"lv:{kind}{final[-1]}"]
    mark = raw.rstrip()[-1:]
    e += ["mark:" + (mark if mark and not mark.isalnum() else "none"), f"size:{min(n.bit_length(), 6)}", f"new:{min(new, 3)}"]
    e += [f"unpaired {a}" for a, b in ("()", "[]", "«»", "“”") if bare.count(a) != bare.count(b)]
    if "<answer" in raw and "</answer>" not in raw:
        e.append("open tag")
    share, cover = sum(w in in_q for w in own) / n, len({w for w in own if w in in_q}) / max(1, len(in_q))
    p = [f"share:{int(share * 10)}", f"cover:{int(cover * 10)}", f"both:{int(share * 5)}:{int(cover * 5)}", f"new:{min(new, 3)}", f"new:{min(new, 3)}:{min(n.bit_length(), 6)}", "open tag" if "open tag" in e else "tag"]
    p += ["mark:" + (mark if mark and not mark.isalnum() else "none"), *(f"t{k}:" + " ".join(end[-k:]) for k in (1, 2) if len(end) >= k)]
    text, gold = " ".join(own), [g for g in (" ".join(w for w in tokens(_TAG.sub(" ", x), fold) if w[0].isalnum()) for x in golds) if g]
    if gold:
        whole = any(text.endswith(g) for g in gold)
        has = any(g in text for g in gold)
        e.append("ends with gold" if whole else "has gold" if has else "no gold")
        p.append("gold" if has else "no gold")
        if not whole:
            part = max((k for g in gold for k in range(3, len(g)) if text.endswith(g[:k]) and (len(text) == k or text[-k - 1] == " ")), default=0)
            if part:
                e += ["ends within gold", f"ends within gold:{min(part // 4, 4)}"]
    f["ends"], f["pair"] = e, p
    told_a, _ = speech(bare, vocab, fold, names)
    la, ma = tongues.of(told_a)
    if la and lq:
        how = "same" if la == lq else "other"
        # the margins are kept apart for each language, as some have fewer words in the counts
        f["tongue"] = [how, f"{how}:{_bin(ma)}", f"{how}:{_bin(ma)}:{_bin(mq)}", f"{how}:{min(len(told_a), 6)}", f"{how}:{la}:{_bin(ma)}"]
    else:
        f["tongue"] = [f"untold {bool(la)} {bool(lq)}"]
    return _hashed(f)


def _hashed(f: dict[str, list[str]]) -> np.ndarray:
    got = [GROUPS[g][0] + (zlib.crc32(x.encode()) & ((1 << GROUPS[g][1]) - 1)) for g, xs in f.items() for x in dict.fromkeys(xs)]
    return np.array(got, dtype=np.int64)


def _seen() -> np.ndarray:
    """(WIDTH, labels): which features a label sees."""
    m = np.zeros((WIDTH, len(LABELS)), dtype=np.float32)
    for k, label in enumerate(LABELS):
        for g in SEES[label]:
            start, bits = GROUPS[g]
            m[start : start + (1 << bits), k] = 1.0
    return m


def _typo(w: str, rng: np.random.Generator) -> str:
    """A word with a letter left out, doubled, changed, or exchanged with the next."""
    if len(w) < 3:
        return w
    k = int(rng.integers(len(w) - 1))
    return [w[:k] + w[k + 1 :], w[: k + 1] + w[k:], w[:k] + "etaoinshr"[rng.integers(9)] + w[k + 1 :], w[:k] + w[k + 1] + w[k] + w[k + 2 :]][rng.integers(4)]


def _copies(q: str, rng: np.random.Generator) -> str:
    w = q.split()
    k = rng.integers(10)
    if k == 0 and len(w) > 3:
        w = w[1:]
    for _ in range(rng.integers(3) if k > 5 else 0):
        i = int(rng.integers(len(w)))
        w[i] = _typo(w[i], rng)
    q = " ".join(w)
    return [q, q, q.lower(), q.rstrip(" ?") + ".", f"{q} {q}", f'"{q}"', f"Question: {q}", q.rstrip(" ?"), q.upper(), q[1:] if len(q) > 9 else q][rng.integers(10)]


def _slips(s: str, rng: np.random.Generator) -> str:
    k = rng.integers(8)
    return s.lower() if k == 0 else s.upper() if k == 1 else s.rstrip(".") if k == 2 else f"<answer>{s}</answer>" if k in (3, 4) else s


def _refusal(lang: str, title: str, rng: np.random.Generator) -> str:
    g = REFUSE[lang]

    def pick(xs: list[str]) -> str:
        return xs[rng.integers(len(xs))]

    core = pick(g["say"])
    if rng.random() < 0.6:
        a, b, c = (pick(x) for x in g["do"])
        core = f"{a} {b}{c}"
    s = (pick(g["open"]) + core + pick(g["why"])).replace("{t}", title)
    return s[:1].upper() + s[1:] + ("." if rng.random() < 0.8 else "")


def _title(q: str, vocab: dict[str, bool], fold: Fold) -> str:
    """The longest run of capitalised words of a question with at most small words between them."""
    run, best = [], []
    for w in q.strip(" ?¿.!").split():
        own = vocab.get("".join(tokens(w, fold)[:1]), True)
        if w[:1].isupper() or own is not False or (run and len(w) <= 4):
            run.append(w)
        else:
            run = []
        if len(run) > len(best):
            best = run[:]
    return " ".join(best)


def _cut(bare: str, rng: np.random.Generator, low: float, high: float) -> str:
    """A beginning of a text, at a word's end in a quarter of the cases."""
    cut = bare[: max(6, int(len(bare) * rng.uniform(low, high)))]
    return cut.rsplit(" ", 1)[0] if rng.random() < 0.25 and " " in cut.strip() else cut


def training_set(pairs: list[tuple[str, str, list[str], int]], model: dict, seeds: list[int]) -> list[tuple[str, str, list[str], int, int, list[bool]]]:
    """(question, answer, golds, field, label, counts): the pairs as they are (label -1), without their final stop or with an
    answer of the same language (-2), and broken copies of them. counts: the labels a row teaches anything about.

    Real pairs are negatives only where that is sure, and what a copy holds of an answer is no surer than the answer. Each
    pair has random numbers of its own, so that its copies don't depend on how many pairs there are.
    """
    vocab, tongues, fold, out = model["vocab"], model["tongues"], Fold(), []
    by_lang: dict[str, list[tuple[str, str, list[bool]]]] = {}
    langs = []
    for q, a, g, field in pairs:
        told_q, names = speech(q or "", vocab, fold)
        told_a, _ = speech(_TAG.sub(" ", a or ""), vocab, fold, names)
        (lq, mq), (la, ma) = tongues.of(told_q), tongues.of(told_a)
        lq, la = lq if mq > 1.0 else None, la if ma > 2.0 else None
        sure = _sound(q or "", a, g, vocab, fold)
        langs.append((lq, la, sure))
        if la and la == lq:
            by_lang.setdefault(la, []).append((q, a, sure))
    for (q, a, g, field), (lq, la, sure), seed in zip(pairs, langs, seeds):
        if not q:
            continue
        rng = np.random.default_rng(seed)
        out.append((q, a, g, field, -1, sure))
        if a and la and a.rstrip()[-1:] in ".>":
            out.append((q, re.sub(r"\.(\s*</answer>)?\s*$", r"\1", a), g, field, -2, sure))  # a missing final stop is no defect
        title = _title(q, vocab, fold)
        bare = _TAG.sub("", a or "").strip()
        long = bool(la) and len(bare) > 25
        others = [k for k in sorted(by_lang) if k != lq and by_lang[k]] if lq else []
        for _ in range(COPIES[field]):
            kind = int(rng.choice(len(LABELS), p=KINDS_LONG if long else KINDS_SHORT))
            yes = [k == kind for k in range(len(LABELS))]
            if kind == 0:
                out.append((q, BLANKS[rng.integers(len(BLANKS))], g, field, 0, [True] * len(LABELS)))
            elif kind == 1 and long:
                cut = _cut(bare, rng, 0.25, 0.97)
                if len(cut) < len(bare) - 2:
                    # what is cut off a refusal still reads like one
                    out.append((q, ("<answer>" if a.lstrip().startswith("<") else "") + cut, g, field, 1, [*(y or s for y, s in zip(yes, sure))]))
            elif kind == 1 and len(bare) > 8 and " " in bare:
                out.append((q, ("<answer>" if field == 0 and rng.random() < 0.5 else "") + _cut(bare, rng, 0.4, 0.95), g, field, 1, [*(y or s for y, s in zip(yes, sure))]))
            elif kind == 2:
                out.append((q, _slips(_refusal(lq or "en", title, rng), rng), g, field, 2, [True] * len(LABELS)))
            elif kind == 3:
                out.append((q, _slips(_copies(q, rng), rng), g, field, 3, [True] * len(LABELS)))
            elif kind == 4 and others:
                # swapped answers of another language, and as many of the same language, which are merely wrong
                k = others[rng.integers(len(others))]
                for lang, label in ((k, 4), (lq, -2)):
                    if by_lang.get(lang):
                        oq, oa, of = by_lang[lang][rng.integers(len(by_lang[lang]))]
                        ot = _title(oq, vocab, fold)
                        out.append((q, oa.replace(ot, title) if ot else oa, g, field, label, [*(y and label > 0 or s for y, s in zip(yes, of))]))
    return out


def _sound(q: str, a: str | None, golds: list[str], vocab: dict[str, bool], fold: Fold) -> list[bool]:
    """For each label, whether a real pair is surely free of the defect; the others teach nothing about it.

    An answer that holds a golden answer is no refusal, copy or blank, nor is a short one with two name-like words or a
    number that the question lacks; one that ends in a final mark or with a golden answer is whole, and so is a short
    one, unless a golden answer goes on where it ends.
    """
    bare = _TAG.sub(" ", a or "").strip()
    shown = re.findall(r"[^\W_]+", bare)
    own = [w.translate(fold) for w in shown]
    in_q = set(tokens(q, fold))
    text = f" {' '.join(own)} "
    gold = [g for x in golds if (g := " ".join(w for w in tokens(_TAG.sub(" ", x), fold) if w[0].isalnum()))]
    says = any(f" {g} " in text for g in gold)
    names = sum(len(w) > 1 and w not in in_q and vocab.get(w) is not False and (r[:1].isupper() or not bare[:1].isupper()) for w, r in zip(own, shown))
    short = len(own) <= 8 and (names >= 2 or any(w.isdigit() and len(w) > 2 and w not in in_q for w in own))
    begun = any(g.startswith(text.strip()) and g != text.strip() for g in gold)
    whole = bare[-1:] in ".!?»”" or any(text.endswith(f" {g} ") for g in gold) or (len(own) <= 6 and not begun)
    return [says or short, whole and bool(own), says or (short and len(own) <= 5), says or short, True]


def fit(pairs: list[tuple[str, str, list[str], int]], model: dict, seeds: list[int], seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias fitted on pairs that are not held out.

    Real pairs are negatives of a label only if they are surely free of it. After the first fit, real pairs above the
    threshold of a label that were no negatives of it become positives, and the classifier is fitted again.
    """
    rng = np.random.default_rng(seed)
    xs, field, kind, use = _examples(pairs, model, seeds)
    y = (kind[:, None] == np.arange(len(LABELS))).astype(np.float32)
    if not len(xs):
        return np.zeros((WIDTH, len(LABELS)), dtype=np.float32), np.full(len(LABELS), -2.0, dtype=np.float32)
    w, b = _logistic(xs, y, use, np.arange(len(xs)), rng)
    score = _scores(xs, w, b)
    cut = thresholds(tally(score, field, kind, use))[0]
    found = (use == 0) & (score > cut[field]) & (kind == -1)[:, None]
    y[found], use[found] = 1.0, 1.0
    return _logistic(xs, y, use, np.arange(len(xs)), rng)


def _examples(pairs: list[tuple[str, str, list[str], int]], model: dict, seeds: list[int]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Features, fields, labels and counts of the training rows of pairs."""
    fold = Fold()
    rows = training_set(pairs, model, seeds)
    last: dict[str, tuple] = {}
    xs = [features(q, a, g, model, fold, last) for q, a, g, *_ in rows]
    return xs, np.array([r[3] for r in rows], dtype=np.int64), np.array([r[4] for r in rows], dtype=np.int64), np.array([r[5] for r in rows], dtype=np.float32).reshape(-1, len(LABELS))


def tally(score: np.ndarray, field: np.ndarray, kind: np.ndarray, use: np.ndarray) -> np.ndarray:
    """(fields, labels, 2, bins): how many real pairs surely free of a label, and how many copies that have it, have which score."""
    out = np.zeros((len(FIELDS), len(LABELS), 2, BINS), dtype=np.int64)
    at = np.clip((score - LOWEST) / STEP, 0, BINS - 1).astype(np.int64)
    for fi in range(len(FIELDS)):
        for k in range(len(LABELS)):
            for what, mine in enumerate(((kind == -1) & (use[:, k] > 0), kind == k)):
                out[fi, k, what] = np.bincount(at[mine & (field == fi), k], minlength=BINS)
    return out


def thresholds(n: np.ndarray) -> tuple[np.ndarray, dict[str, tuple[float, float, float]]]:
    """(fields, labels) thresholds of a tally, and both rates.

    Copies are easier than real defects, so a threshold lies a third up from the lowest of best balance between hits and
    false alarms to the highest that is hardly worse.
    """
    cut, report = np.full((len(FIELDS), len(LABELS)), 0.5, dtype=np.float32), {}
    edges = LOWEST + STEP * np.arange(BINS)
    for fi, name in enumerate(FIELDS):
        for k, label in enumerate(LABELS):
            neg, pos = (x[::-1].cumsum()[::-1] / max(1, x.sum()) for x in n[fi, k])
            if not n[fi, k, 0].any() or not n[fi, k, 1].any():
                continue
            # a defect is taken to be in one of PRIOR pairs, but one false alarm among few pairs weighs a twentieth at most
            f1 = 2 * pos / (1.0 + pos + min(PRIOR, n[fi, k, 0].sum() / 20) * neg)
            low, high = np.flatnonzero(f1 > f1.max() - 1e-3)[0], np.flatnonzero(f1 > f1.max() - 0.02)[-1]
            at = int(low + (high - low) // 3)
            cut[fi, k] = edges[at]
            report[f"{name} {label}"] = (float(pos[at]), float(neg[at]), float(edges[at]))
    return cut, report


def _scores(xs: list[np.ndarray], w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(pairs, labels): a label's features weigh 1 / sqrt(their number)."""
    if not xs:
        return np.empty((0, len(LABELS)), dtype=np.float32)
    idx, at = np.concatenate(xs), np.r_[0, np.cumsum([len(x) for x in xs])[:-1]]
    return np.add.reduceat(w[idx], at, axis=0) / np.sqrt(_numbers(idx, at)) + b


def _numbers(idx: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(pairs, labels): how many features of a pair a label sees."""
    per = np.stack([(idx >= start) & (idx < start + (1 << bits)) for start, bits in GROUPS.values()], axis=1).astype(np.float32)
    sees = np.array([[g in SEES[k] for k in LABELS] for g in GROUPS], dtype=np.float32)
    return np.maximum(np.add.reduceat(per, at, axis=0) @ sees, 1.0)


def _logistic(xs: list[np.ndarray], y: np.ndarray, count: np.ndarray, use: np.ndarray, rng: np.random.Generator, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """One logistic regression per label by Adagrad, over the rows of use that count for it, on the features it sees."""
    sees = _seen()
    w, seen = np.zeros((WIDTH, len(LABELS)), dtype=np.float32), np.full((WIDTH, len(LABELS)), 1e-3, dtype=np.float32)
    b, bseen = np.full(len(LABELS), -2.0, dtype=np.float32), np.ones(len(LABELS), dtype=np.float32)
    for _ in range(int(min(EPOCHS[1], max(EPOCHS[0], PASSED // max(1, len(use)))))):
        for rows in np.array_split(rng.permutation(use), max(1, len(use) // 128)):
            own = [xs[i] for i in rows]
            p = 1 / (1 + np.exp(-_scores(own, w, b)))
            g = ((p - y[rows]) * count[rows]).astype(np.float32)
            n = np.array([len(x) for x in own])
            idx = np.concatenate(own)
            at, where = np.unique(idx, return_inverse=True)
            per = np.repeat(g / np.sqrt(_numbers(idx, np.r_[0, np.cumsum(n)[:-1]])), n, axis=0)
            total = np.stack([np.bincount(where, per[:, k], len(at)) for k in range(len(LABELS))], axis=1).astype(np.float32) / len(rows) + 1e-6 * w[at]
            total *= sees[at]
            seen[at] += total * total
            w[at] -= rate * total / np.sqrt(seen[at])
            gb = g.mean(axis=0)
            bseen += gb * gb
            b -= rate * gb / np.sqrt(bseen)
    return w, b


def _plain(c: str) -> F.Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def records(results: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(src, k, question, prediction, golds): the different rows with a key and a question of both tables, dealt over all cores."""
    none = F.lit(None).cast("string")
    out = results.select(F.lit(0).alias("src"), F.col("result_id").cast("bigint").alias("k"), "question", "prediction", _plain("golden_answers").alias("golds"))
    if more is not None:
        out = out.unionByName(more.select(F.lit(1).alias("src"), F.col("qa_id").cast("bigint").alias("k"), "question", none.alias("prediction"), _plain("golden_answers").alias("golds")))
    return out.where("k is not null and question is not null").distinct()


def _pairs(row: tuple) -> list[tuple[str, str, list[str], int]]:
    """(question, answer, golds, field) of a record: its prediction, and each different golden answer."""
    src, _, q, p, golds = row
    own = [x for x in golds if x]
    return ([(q, p, own, 0)] if src == 0 else []) + [(q, x, [], 1) for x in dict.fromkeys(own)]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(i).to_pylist() for i in range(5)))


def words(table: DataFrame) -> tuple[dict[str, bool], dict[str, tuple[int, int]]]:
    """The frequent words and whether they are mostly capitalised; and how often words end an answer, of how often they occur. Counted in all records.

    Where a text has capitals, a word in small letters is no name; such words are known from a few texts on, as texts
    without capitals hold them too and don't tell.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, n = Fold(), {}
        for row in _rows(batches):
            pairs = _pairs(row)
            texts = {t for t in (row[2], *(a for _, a, _, _ in pairs)) if t}
            n.setdefault("", [0] * 5)[0] += len(texts)
            for t in texts:
                found = re.findall(r"[^\W_]+", t)
                # the last word may be a part of one
                small = {x for x in found[:-1] if x[:1].islower()} if any(c.isupper() for c in t) else ()
                for x in set(found):
                    at = n.setdefault(x.translate(fold), [0] * 5)
                    at[0] += 1
                    at[1] += x[:1].isupper()
                    at[4] += x in small
            for _, a, _, _ in pairs:
                ws = [x for x in tokens(_TAG.sub(" ", a or ""), fold) if x[0].isalnum()]
                for x in ws:
                    n.setdefault(x, [0] * 5)[2] += 1
                for x in ws[-1:]:
                    n[x][3] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), *(pa.array([v[i] for v in n.values()], pa.int64()) for i in range(5))], ["w", *"nuafs"])

    n = materialize(table.mapInArrow(count, "w string, n bigint, u bigint, a bigint, f bigint, s bigint").groupBy("w").agg(*(F.sum(c).alias(c) for c in "nuafs")), "p2w")
    texts = sum(r.n for r in n.where("w = ''").collect())
    # all bounds are shares of the texts, so there are as many frequent words in large tables as in small ones
    least, low, small, often = max(3, texts // 600), max(4, texts // 2_250), max(2, texts // 50_000), max(5, texts // 2_500)
    got = n.where(f"w <> '' and (n >= {low} or n >= {least} or a >= {often} or (s >= {small} and u < 0.2 * n))").collect()
    release(n)
    vocab = {r.w: r.u > 0.7 * r.n for r in got if not r.w.isdigit() and (r.n >= least or ((r.n >= low or r.s >= small) and r.u < 0.2 * r.n))}
    # words of refusals and function words must stand for themselves even if the tables lack them
    fold = Fold()
    for g in REFUSE.values():
        for part in (g["open"], g["say"], g["why"], *g["do"]):
            for t in part:
                vocab.update({x: False for x in tokens(t.replace("{t}", " "), fold) if x[0].isalnum()})
    for x in _FW:
        vocab[x] = False
    return vocab, {r.w: (r.a, r.f) for r in got if r.a >= often}


def learn(table: DataFrame, vocab: dict[str, bool], rounds: int = 3) -> dict[str, dict[str, float]]:
    """The counts of Tongues. Counted from the texts of all records whose function words tell their language, then from all texts by what was counted."""

    def spoken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, n = Fold(), Counter()
        for row in _rows(batches):
            for t in {t for t in (row[2], *(a for _, a, _, _ in _pairs(row))) if t}:
                n[" ".join(speech(_TAG.sub(" ", t), vocab, fold)[0])] += 1
            if len(n) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["t", "n"])
                n.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["t", "n"])

    texts = materialize(table.mapInArrow(spoken, "t string, n bigint").where("t <> ''").groupBy("t").agg(F.sum("n").alias("n")), "p2t")
    total = texts.agg(F.sum("n")).first()[0] or 0
    counts: dict[str, dict[str, float]] = {}
    for _ in range(rounds):

        def count(batches: Iterator[pa.RecordBatch], counts: dict[str, dict[str, float]] = counts) -> Iterator[pa.RecordBatch]:
            known, n = Tongues(counts) if counts else None, Counter()
            for b in batches:
                for t, many in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    ws = t.split(" ")
                    k, sure = known.of(ws) if known else language(ws)
                    if k and (sure > 2.0 if known else sure >= 2):
                        for w in ws:
                            n[k, w] += many
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in n], pa.string()), pa.array([w for _, w in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["k", "w", "n"])

        got = texts.mapInArrow(count, "k string, w string, n bigint").groupBy("k", "w").agg(F.sum("n").alias("n")).where(f"n >= {total / 50_000}")
        counts = {k: {} for k in FUNCTION}
        for r in got.collect():
            counts[r.k][r.w] = r.n
    release(texts)
    return counts


def ready(model: dict) -> dict:
    """A model as it is sent, with its Tongues (a broadcast holds plain values only, as executors have no copy of this package)."""
    return {**model, "tongues": Tongues(model["tongues"])}


def _shard(batches: Iterator[pa.RecordBatch], held: bool) -> tuple[list, list[int]]:
    """The pairs of a task that are held out or not, in order, and a seed for each. A record is held out by a hash of its question."""
    pairs, seeds = [], []
    for row in sorted(_rows(batches), key=repr):
        if (zlib.crc32(row[2].encode()) % HELD == 0) == held:
            own = _pairs(row)
            pairs += own
            seeds += [zlib.crc32(repr((row[1], p)).encode()) for p in own]
    return pairs, seeds


def train(results: DataFrame, more: DataFrame | None = None, fit_rows: int = FIT_ROWS) -> dict:
    """The classifier, fitted on all pairs of both tables but those held out, on which its thresholds are set.

    The pairs are dealt by hash over tasks of about fit_rows, each task fits weights, and a feature's weight is the mean over
    the tasks that met it. The held-out pairs of all tasks are scored with these means and counted by score.
    """
    table = materialize(records(results, more), "p2r")
    many = table.agg(F.sum(F.size("golds") + F.when(F.col("src") == 0, 1).otherwise(0))).first()[0] or 0
    wide = spread(table)
    vocab, ends = words(wide)
    model = {"vocab": vocab, "ends": ends, "tongues": learn(wide, vocab)}
    shards = max(1, math.ceil(many / fit_rows))
    # a number of partitions asked for is kept, so that the shards are the same on every cluster
    dealt = table.repartition(shards, F.xxhash64("src", "k", "question"))
    shared = table.sparkSession.sparkContext.broadcast(model)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, seeds = _shard(batches, False)
        if pairs:
            w, b = fit(pairs, ready(shared.value), seeds)
            yield _weights(w.astype(np.float32), (w != 0).astype(np.float32), b, 1, zlib.crc32(pairs[0][0].encode()))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if got := _sum(r for b in batches for r in b.to_pylist()):
            yield _weights(*got, 0)

    fitted = materialize(dealt.mapInArrow(one, _WEIGHTS).repartition(math.ceil(shards / 8), "at").mapInArrow(total, _WEIGHTS), "p2m")
    w, met, b, n = _sum(r.asDict() for r in fitted.toLocalIterator()) or (np.zeros((WIDTH, len(LABELS))), np.zeros((WIDTH, len(LABELS))), np.full(len(LABELS), -2.0), 1)
    release(fitted)
    model |= {"w": (w / np.maximum(met, 1)).astype(np.float32), "b": (b / n).astype(np.float32)}
    scored = table.sparkSession.sparkContext.broadcast(model)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, seeds = _shard(batches, True)
        m = ready(scored.value)
        xs, field, kind, use = _examples(pairs, m, seeds)
        if xs:
            n = tally(_scores(xs, m["w"], m["b"]), field, kind, use).ravel()
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["at", "n"])

    n = np.zeros(len(FIELDS) * len(LABELS) * 2 * BINS, dtype=np.int64)
    for r in dealt.mapInArrow(held, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():
        n[r.at] = r.n
    release(table)
    cut, report = thresholds(n.reshape(len(FIELDS), len(LABELS), 2, BINS))
    return {**model, "cut": cut, "report": report}


_WEIGHTS = "at bigint, w binary, met binary, b binary, n bigint"


def _weights(w: np.ndarray, met: np.ndarray, b: np.ndarray, n: int, at: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), *(pa.array([x.astype(np.float32).tobytes()], pa.binary()) for x in (w, met, b)), pa.array([n], pa.int64())], ["at", "w", "met", "b", "n"])


def _sum(rows: Iterator[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int] | None:
    """The sums of weights, of the tasks that met a feature, of biases and of tasks; None without rows."""
    out = None
    for r in rows:
        got = [np.frombuffer(bytes(r[c]), dtype=np.float32).astype(np.float64) for c in ("w", "met", "b")] + [r["n"]]
        out = got if out is None else [x + y for x, y in zip(out, got)]
    return out and (out[0].reshape(WIDTH, -1), out[1].reshape(WIDTH, -1), out[2], out[3])


def defect_of(score: np.ndarray, cut: np.ndarray) -> str | None:
    over = score - cut
    k = int(over.argmax())
    return LABELS[k] if over[k] > 0 else None


def defects(results: DataFrame, model: dict, key: str = "result_id") -> DataFrame:
    """(result_id, answer_field, defect), one row per defective answer field of each different record.

    A prediction that is null or nothing but blanks, marks or tags is empty, and so is a list of golden answers that is
    null, has no element or only empty ones. A list has another defect if all its non-empty elements have one. A null
    question is compared as an empty one. Repeated rows count once, rows without a key not at all; of rows of one key that
    differ, each field has the defect that is first by name.
    """
    shared = results.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, fold, last = ready(shared.value), Fold(), {}
        for b in batches:
            rows = list(zip(*(b.column(i).to_pylist() for i in range(4))))
            xs, what = [], []
            for i, (_, q, p, g) in enumerate(rows):
                xs.append(features(q, p, [x for x in g or [] if x], m, fold, last))
                what.append((i, 0))
                for x in g or [None]:
                    xs.append(features(q, x, [], m, fold, last))
                    what.append((i, 1))
            got: dict[tuple[int, int], list[str | None]] = {}
            for at, s in zip(what, _scores(xs, m["w"], m["b"])):
                got.setdefault(at, []).append(defect_of(s, m["cut"][at[1]]))
            out = []
            for (i, field), found in got.items():
                rest = [x for x in found if x != "empty"]
                if not rest:
                    out.append((rows[i][0], FIELDS[field], "empty"))
                elif all(rest):
                    out.append((rows[i][0], FIELDS[field], Counter(rest).most_common(1)[0][0]))
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()))], ["result_id", "answer_field", "defect"])

    rows = results.select(F.col(key).cast("bigint").alias("k"), "question", "prediction", "golden_answers").where("k is not null").distinct()
    return rows.mapInArrow(run, "result_id bigint, answer_field string, defect string").groupBy("result_id", "answer_field").agg(F.min("defect").alias("defect"))


def found(spark, d: str) -> DataFrame:
    results = spark.read.parquet(f"{d}/results_step120.parquet")
    return defects(results, train(results, spark.read.parquet(f"{d}/qa_train.parquet")))


def report(spark, d: str) -> DataFrame:
    """Per data_source, split, answer field and defect: how many records."""
    src = spark.read.parquet(f"{d}/results_step120.parquet").select("result_id", "data_source", "split").distinct()
    return found(spark, d).join(src, "result_id").groupBy("data_source", "split", "answer_field", "defect").agg(F.count("*").alias("records"))
