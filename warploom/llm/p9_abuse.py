"""Problem 9: abusive, hateful or sexual content.

Method: a bidirectional gated recurrent network with attention pooling over character and word inputs, trained here in
numpy, scores all overlapping windows of ``WIDTH`` words, ``STEP`` apart, of every text; a document's score of a category
is that of its strongest window. A word's input is the sum of a vector of the word and the mean of the vectors of its
letter triples, so words never seen have an input too. Disguises are taken off before: look-alike and accented letters,
digits and marks for letters, stretched letters, letters set apart, and stars, which are read as the training word they fit.

It is trained on sentences made from the seeds (p9_seeds), set into text of documents labelled as free of toxic content,
against that text and against seed sentences that only sound alike. At most ``FIT_DOCS`` labelled documents are used, those
of the smallest hash. Labels are partly wrong and do not say where, so runs of words tell what a label is about: those that
documents labelled toxic hold far more often than the clean ones (``Marks``). Sentences of toxic documents that consist of
such runs become positives of a second training, and clean documents' windows that hold them are left out of it. Everything
else covers all documents.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import p9_seeds as seeds
from .textfold import Fold

CATEGORIES = ("abuse", "hate", "sexual")
WIDTH, STEP = 16, 8
FIT_DOCS, DIM, HIDDEN, TRIPLES = 1_200, 16, 16, 4_096
#: A document holds a category from this score on.
THRESHOLD = 0.85

#: Windows scored at once: few enough that a step's numbers stay in the processor's cache.
BATCH = 1_024

_WORD = re.compile(r"[^\W_](?:[^\W_]|[*@$](?=[\w*@$]))*")
_APART = re.compile(r"(?<![\w*])(?:[^\W_][ .\-_]){2,}[^\W_](?![\w*])")
#: Digits and marks that stand for letters.
LEET = str.maketrans("0134579@$", "oleastgas")
_LEET_I = str.maketrans("0134579@$", "oieastgas")
_LONG = re.compile(r"(.)\1{2,}")
PAD, REST = 0, 1


class Lexicon:
    """Numbers of words. ``known`` maps training words to numbers from 2 on, ``starred`` are those that stars may hide."""

    def __init__(self, known: dict[str, int], starred: list[str]):
        self.known, self.fold, self.cache = known, Fold(), {}
        self.starred: dict[int, list[str]] = {}
        for w in starred:
            self.starred.setdefault(len(w), []).append(w)

    def plain(self, w: str) -> str:
        """A folded word without disguise."""
        k = self.known
        if w in k:
            return w
        if "*" in w:
            fit = re.compile(re.escape(w).replace(r"\*", "."))
            return next((x for x in self.starred.get(len(w), ()) if fit.fullmatch(x)), w.replace("*", ""))
        if not w.isalpha() and any(c.isalpha() for c in w):
            for t in (LEET, _LEET_I):
                x = w.translate(t)
                if x in k:
                    return x
            w = x if w[0].isalpha() or not w.isalnum() else w
        if _LONG.search(w):
            one, two = _LONG.sub(r"\1", w), _LONG.sub(r"\1\1", w)
            return one if one in k or two not in k else two
        return w

    def words(self, text: str) -> list[str]:
        t = text.translate(self.fold)
        if _APART.search(t):
            t = _APART.sub(lambda m: re.sub(r"[ .\-_]", "", m.group()), t)
        return _WORD.findall(t)


def triples(w: str) -> np.ndarray:
    x = f"^{w}$"
    return np.array([zlib.crc32(x[k : k + 3].encode()) % TRIPLES for k in range(max(1, len(x) - 2))])


class Triples(dict):
    """The number of a letter triple, kept once computed."""

    def __missing__(self, x: str) -> int:
        self[x] = got = zlib.crc32(x.encode()) % TRIPLES
        return got


# --- the network ---


def init(n_words: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    def m(*shape: int, s: float = 0.25) -> np.ndarray:
        return rng.normal(0, s, shape).astype(np.float32)

    p = {"word": m(n_words, DIM, s=0.1), "char": m(TRIPLES, DIM, s=0.1)}
    for d in "fb":
        p |= {f"w{d}": m(DIM, 3 * HIDDEN), f"u{d}": m(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
    p |= {"att": m(2 * HIDDEN, HIDDEN), "attv": m(HIDDEN), "out": m(2 * HIDDEN, len(CATEGORIES)), "bias": np.full(len(CATEGORIES), -2.0, np.float32)}
    return p


def _sig(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _gru(x: np.ndarray, u: np.ndarray, steps: range, keep: list | None = None) -> np.ndarray:
    """x: (time, rows, 3 hidden) input parts of update, reset and candidate. Returns the states (time, rows, hidden)."""
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    out = np.empty((x.shape[0], x.shape[1], HIDDEN), np.float32)
    u2, uc = np.ascontiguousarray(u[:, : 2 * HIDDEN]), np.ascontiguousarray(u[:, 2 * HIDDEN :])
    for t in steps:
        g = h @ u2
        g += x[t, :, : 2 * HIDDEN]
        g *= 0.5
        np.tanh(g, out=g)
        g *= 0.5
        g += 0.5
        z, r = g[:, :HIDDEN], g[:, HIDDEN:]
        c = (r * h) @ uc
        c += x[t, :, 2 * HIDDEN :]
        np.tanh(c, out=c)
        if keep is not None:
            keep.append((t, h, z, r, c))
            h = h + z * (c - h)
        else:
            c -= h
            c *= z
            c += h
            h = c
        out[t] = h
    return out


def _pool(s: np.ndarray, mask: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Attention pooling of states (time, rows, 2 hidden) over the times where mask is true."""
    a = s @ p["att"]
    np.tanh(a, out=a)
    e = np.where(mask, a @ p["attv"], np.float32(-30))
    e = np.exp(e - e.max(axis=0))
    w = e / e.sum(axis=0)
    # a row's weights times its states, as one product of matrices per row
    return np.matmul(w.T[:, None, :], s.transpose(1, 0, 2))[:, 0], w, a


def forward(xf: np.ndarray, xb: np.ndarray, mask: np.ndarray, p: dict) -> np.ndarray:
    n = xf.shape[0]
    s = np.concatenate([_gru(xf, p["uf"], range(n)), _gru(xb, p["ub"], range(n - 1, -1, -1))], axis=2)
    return _sig(_pool(s, mask, p)[0] @ p["out"] + p["bias"])


def _back_gru(ds: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dx, du = np.empty(ds.shape[:2] + (3 * HIDDEN,), np.float32), np.zeros_like(u)
    dh = np.zeros(ds.shape[1:], np.float32)
    for t, h, z, r, c in reversed(kept):
        dh = dh + ds[t]
        dc = dh * z * (1 - c * c)
        dz = dh * (c - h) * z * (1 - z)
        drh = dc @ u[:, 2 * HIDDEN :].T
        dr = drh * h * r * (1 - r)
        dx[t] = np.concatenate([dz, dr, dc], axis=1)
        du[:, : 2 * HIDDEN] += h.T @ dx[t, :, : 2 * HIDDEN]
        du[:, 2 * HIDDEN :] += (r * h).T @ dc
        dh = dh * (1 - z) + drh * r + dx[t, :, : 2 * HIDDEN] @ u[:, : 2 * HIDDEN].T
    return dx, du


def _sums(where: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The sums of the rows of each number in where, which holds all numbers from 0 on."""
    o = np.argsort(where, kind="stable")
    return np.add.reduceat(rows[o], np.r_[0, np.flatnonzero(np.diff(where[o])) + 1], axis=0)


def gradients(ids: np.ndarray, y: np.ndarray, p: dict, chars: tuple[np.ndarray, np.ndarray, np.ndarray], weight: np.ndarray) -> tuple[float, dict]:
    """Loss and gradients of a batch of windows ids (rows, time); chars: triples of all words, flat, with starts and lengths."""
    flat, start, size = chars
    at, where = np.unique(ids, return_inverse=True)
    where = where.reshape(ids.shape)
    seg = np.concatenate([flat[start[k] : start[k] + size[k]] for k in at])
    off = np.r_[0, np.cumsum(size[at])[:-1]]
    e = p["word"][at] + np.add.reduceat(p["char"][seg], off, axis=0) / size[at][:, None]
    e[at == PAD] = 0
    x = e[where.T]
    mask = (ids != PAD).T
    kf, kb = [], []
    n = ids.shape[1]
    s = np.concatenate([_gru(x @ p["wf"] + p["cf"], p["uf"], range(n), kf), _gru(x @ p["wb"] + p["cb"], p["ub"], range(n - 1, -1, -1), kb)], axis=2)
    v, w, a = _pool(s, mask, p)
    q = _sig(v @ p["out"] + p["bias"])
    rows = len(ids)
    loss = -(weight[:, None] * (y * np.log(q + 1e-7) + (1 - y) * np.log(1 - q + 1e-7))).sum() / rows
    do = (weight[:, None] * (q - y) / rows).astype(np.float32)
    g = {"out": v.T @ do, "bias": do.sum(axis=0)}
    dv = do @ p["out"].T
    dw = np.einsum("rh,trh->tr", dv, s)
    de = w * (dw - (w * dw).sum(axis=0))
    da = de[:, :, None] * p["attv"] * (1 - a * a)
    g["attv"] = np.einsum("tr,trh->h", de, a)
    g["att"] = np.einsum("trs,trh->sh", s, da)
    ds = w[:, :, None] * dv + da @ p["att"].T
    dxf, g["uf"] = _back_gru(ds[:, :, :HIDDEN], kf, p["uf"])
    dxb, g["ub"] = _back_gru(ds[:, :, HIDDEN:], kb, p["ub"])
    flatx = x.reshape(-1, DIM)
    de = np.zeros_like(x)
    for d, dx in (("f", dxf), ("b", dxb)):
        g[f"w{d}"] = flatx.T @ dx.reshape(-1, 3 * HIDDEN)
        g[f"c{d}"] = dx.sum(axis=(0, 1))
        de += dx @ p[f"w{d}"].T
    per = _sums(where.T.reshape(-1), de.reshape(-1, DIM))
    per[at == PAD] = 0
    g["word"] = (at, per)
    seg_at, seg_where = np.unique(seg, return_inverse=True)
    g["char"] = (seg_at, _sums(seg_where, np.repeat(per / size[at][:, None], size[at], axis=0)))
    return float(loss), g


def learn(p: dict, ids: np.ndarray, y: np.ndarray, weight: np.ndarray, chars: tuple, rng: np.random.Generator, epochs: int, rate: float = 0.004, batch: int = 192) -> None:
    """Adam, in place; vectors of words and triples are stepped only where a batch touches them."""
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    step, total = 0, epochs * max(1, len(ids) // batch)
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(ids)), max(1, len(ids) // batch)):
            own = ids[rows].copy()
            # some words are met without their own vector, so that their letters tell as well
            own[(rng.random(own.shape) < 0.04) & (own != PAD)] = REST
            _, g = gradients(own, y[rows], p, chars, weight[rows])
            step += 1
            lr = rate * min(1.0, 3 * (1 - step / (total + 1)) + 0.02)
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, d in g.items():
                if isinstance(d, tuple):
                    at, d = d
                    m[k][at] = 0.9 * m[k][at] + 0.1 * d
                    s[k][at] = 0.999 * s[k][at] + 0.001 * d * d
                    p[k][at] -= lr * fix * m[k][at] / (np.sqrt(s[k][at]) + 1e-8)
                else:
                    m[k] = 0.9 * m[k] + 0.1 * d
                    s[k] = 0.999 * s[k] + 0.001 * d * d
                    p[k] -= lr * fix * m[k] / (np.sqrt(s[k]) + 1e-8)


# --- training data ---

_SYL = ["ba", "de", "fi", "go", "hu", "ka", "le", "mi", "no", "pu", "ra", "se", "ti", "vo", "wu", "bra", "dre", "fli", "gro", "klu", "pra", "ste", "tri", "zo"]


def _invent(rng: np.random.Generator) -> str:
    return ("".join(_SYL[k] for k in rng.integers(len(_SYL), size=rng.integers(2, 4))) + "nrslkmth"[rng.integers(8)]).capitalize()


def fill(form: str, lang: str, rng: np.random.Generator) -> str:
    pick = lambda x: x[rng.integers(len(x))]
    insults = seeds.INSULTS[lang].split("|")
    slots = {k: by[lang].split("|") for k, by in seeds.SLOTS.items()}
    form = form.replace("{g}", (pick(["", "", "", "Northern ", "Old "]) + _invent(rng) + pick(["", "", "i", "ites", "ish"])) + pick(seeds.GROUP_TAILS))
    while "{" in form:
        k = form[form.index("{") + 1]
        form = form.replace("{" + k + "}", {"n": lambda: pick(seeds.NAMES) if rng.random() < 0.5 else _invent(rng), "p": lambda: _invent(rng), "i": lambda: pick(insults), "r": lambda: pick(seeds.ROLES), "o": lambda: f"{_invent(rng)} Shipping Company", "w": lambda: f"The Ladder of {_invent(rng)}", "y": lambda: str(rng.integers(1820, 2020)), **{x: lambda x=x: pick(slots[x]) for x in slots}}[k](), 1)
    return form


def disguise(w: str, rng: np.random.Generator) -> str:
    """A word as people hide it."""
    k = rng.integers(4)
    if len(w) < 3 or k == 0:
        return w
    if k == 1:
        return w[0] + "*" * (len(w) - 2) + w[-1]
    if k == 2:
        i = rng.integers(1, len(w))
        return w[:i] + w[i] * 3 + w[i:]
    i = rng.integers(1, len(w))
    return w[:i] + chr(97 + rng.integers(26)) + w[i + 1 :]


def make(docs: list[str], rng: np.random.Generator, weak: list[tuple[int, str, int]] = (), marks: Marks | None = None, per_form: int = 26) -> dict:
    """Training windows from labelled, clean documents, the seeds, and sentences (category, text, times) of documents labelled toxic.

    ``times`` is how many documents hold such a sentence: all of one form together weigh as much as a seed. ``suspect`` says
    which windows of the clean documents hold marks of the toxic ones.
    """
    fold = Lexicon({}, [])
    texts = [fold.words(t) for t in docs if t]
    df = Counter(w for t in texts for w in set(t))
    forms = [(k, lang, f) for k, by in enumerate((seeds.ABUSE, seeds.HATE, seeds.SEXUAL)) for lang, fs in by.items() for f in fs]
    pos = [(k, fill(f, lang, rng)) for k, lang, f in forms for _ in range(per_form)]
    pos += [(k, x) for k, x, times in weak for _ in range(max(2, per_form // times))]
    alike = [fill(f, "en", rng) for f in seeds.BENIGN for _ in range(per_form)]
    own = Counter(w for _, s in pos for w in set(fold.words(s))) + Counter(w for s in alike for w in set(fold.words(s)))
    hot = Counter(w for _, s in pos for w in set(fold.words(s)))
    vocab = sorted({w for w, n in df.items() if n >= max(4, len(texts) // 150) and not w.isdigit()} | {w for w, n in own.items() if n >= 8 and not w.isdigit()})
    known = {w: i + 2 for i, w in enumerate(vocab)}
    starred = sorted((w for w in hot if w in known and df[w] < 0.02 * max(50, len(texts)) and len(w) > 2), key=lambda w: (-hot[w], w))
    lex = Lexicon(known, starred)
    context = [w for t in texts for w in t] or ["the"] * 64
    spare: dict[str, int] = {}

    def number(w: str) -> int:
        w = lex.plain(w)
        return known.get(w) or spare.setdefault(w, len(known) + 2 + len(spare))

    def window(ws: list[str]) -> list[int]:
        """The words in a window at a random place, with text around them; of longer ones the first WIDTH."""
        ws = ws[:WIDTH]
        rest = WIDTH - len(ws)
        left = int(rng.integers(rest + 1))
        at = int(rng.integers(max(1, len(context) - 2 * WIDTH)))
        full = context[at : at + left] + ws + context[at + left : at + rest]
        if rng.random() < 0.15:
            full = ws
        ids = [number(w) for w in full][:WIDTH]
        return ids + [PAD] * (WIDTH - len(ids))

    ids, y, w, suspect = [], [], [], []
    for k, s in pos:
        ws = lex.words(s)
        if rng.random() < 0.25:
            ws = [disguise(x, rng) if x in hot and df[x] < 0.02 * max(50, len(texts)) else x for x in ws]
        if len(ws) > 8 and rng.random() < 0.3:
            cut = int(rng.integers(1, max(2, len(ws) // 4)))
            ws = ws[cut:] if rng.random() < 0.5 else ws[:-cut]
        ids.append(window(ws)), y.append([float(k == c) for c in range(3)]), w.append(1.0)
    for s in alike:
        ids.append(window(lex.words(s))), y.append([0.0] * 3), w.append(1.0)
    for t in texts:
        nums = [number(x) for x in t]
        for at in range(0, max(1, len(nums) - STEP), STEP):
            part = nums[at : at + WIDTH]
            ids.append(part + [PAD] * (WIDTH - len(part))), y.append([0.0] * 3), w.append(1.0)
            if marks and marks.hot:
                suspect += [len(ids) - 1] * (marks.many(marks.grams(t[at : at + WIDTH]), True) >= 3)
            # words that the few documents lack are no offence either: some windows again with words of mixed letters
            if part and rng.random() < min(1.0, 150 / len(texts)):
                part = list(part)
                word = "".join(rng.permutation(list(context[rng.integers(len(context))] + context[rng.integers(len(context))])))[: int(rng.integers(2, 9))]
                for k in rng.integers(len(part), size=int(rng.integers(1, len(part) + 1))) if rng.random() < 0.2 else rng.integers(len(part), size=3):
                    part[k] = number(word)
                ids.append(part + [PAD] * (WIDTH - len(part))), y.append([0.0] * 3), w.append(1.0)
    names = ["", "", *vocab, *spare]
    tr = [triples(x) for x in names]
    size = np.array([len(x) for x in tr])
    return {"ids": np.array(ids), "y": np.array(y, np.float32), "w": np.array(w, np.float32), "made": len(pos) + len(alike), "suspect": suspect, "known": known, "starred": starred, "chars": (np.concatenate(tr), np.r_[0, np.cumsum(size)[:-1]], size), "hot": {known[x] for x in starred}, "n": len(names)}


#: The share of documents labelled as clean that are taken to hold something, where no document is labelled toxic.
NOISE = 0.03
#: How many times as frequent in documents labelled toxic as in clean ones a mark is.
LIFT = 4.0

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_NAME = re.compile(r"(?<=[^\W_,;:] )[^\W_]+")


def sentences(text: str) -> list[str]:
    """The sentences of a text; of longer runs of words, windows."""
    out = []
    for s in _SENTENCE.split(text):
        ws = s.split()
        out += [s] if len(ws) <= 2 * WIDTH else [" ".join(ws[at : at + WIDTH]) for at in range(0, len(ws) - STEP, STEP)]
    return [s for s in out if s.strip()]


class Marks:
    """Runs of three words, names and numbers aside, that documents labelled toxic hold ``LIFT`` times as often as clean ones."""

    def __init__(self, clean: list[str], toxic: list[str], lex: Lexicon):
        self.lex = lex
        low, high = Counter(), Counter()
        for t in (*clean, *toxic):
            for w in set(_NAME.findall(t)):
                (high if w[:1].isupper() and not w.isupper() else low)[w.translate(lex.fold)] += 1
        self.names = {w for w, n in high.items() if n > low[w]}
        self.clean, self.toxic = (Counter(g for t in ts for g in self.grams(lex.words(t))) for ts in (clean, toxic))
        self.rate = len(clean) / max(1, len(toxic))
        self.hot = {g for g in self.toxic if self.lift(g) >= LIFT}

    def grams(self, words: list[str]) -> set[tuple[str, ...]]:
        ws = ["_" if w in self.names or w.isdigit() else self.lex.plain(w) for w in words]
        ws = [w for i, w in enumerate(ws) if w != "_" or not i or ws[i - 1] != "_"]
        return {tuple(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))}

    def lift(self, g: tuple[str, ...], own: int = 0) -> float:
        """own: documents labelled clean, among those counted, that are not to count."""
        return self.toxic[g] * self.rate / (self.clean[g] - own + 0.5)

    def many(self, grams: set[tuple[str, ...]], clean: bool = False) -> int:
        """How many are marks; if the text they are of is one of the clean documents, by what the others hold."""
        return sum(self.lift(g, 1) >= LIFT for g in grams if self.toxic[g]) if clean else len(grams & self.hot)


def train(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, seed: int = 5) -> dict:
    """The trained network; docs and labels as tables.

    At most fit_docs documents labelled toxic = 0 give the negatives. Of at most as many labelled toxic = 1 (and never 0),
    the sentences with marks that a first network, trained on the seeds, gives a category become positives of a second.
    """
    said = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("toxic").alias("least"))

    def read(which: str) -> list[str]:
        own = said.where(which).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
        return [r.text for r in docs.select("doc_id", "text").where("text is not null").join(F.broadcast(own), "doc_id").orderBy("doc_id").select("text").collect()]

    return fit_both(read("toxic = 0"), read("least = 1"), seed)


def fit_both(clean: list[str], toxic: list[str], seed: int = 5) -> dict:
    """The network fitted on the seeds, and again with what documents labelled toxic hold."""
    model = fit(clean, seed)
    if not toxic:
        return model
    marks = Marks(clean, toxic, Lexicon(model["known"], model["starred"]))
    weak = weak_positives(toxic, model, marks)
    return fit(clean, seed, weak, marks)


def weak_positives(texts: list[str], model: dict, marks: Marks, least: float = 0.3) -> list[tuple[int, str, int]]:
    """(category, sentence, times) of texts known to hold something: sentences of which half, or at least three, of the runs are marks.

    A sentence has the category that the sentences with the same marks score highest for, if that is at least ``least`` and
    clearly more than for the next, and if the words it shares with the seeds tell the same. Repeated sentences count once.
    """
    parts = sorted({p for t in texts for p in sentences(t)})
    own = [marks.grams(marks.lex.words(p)) for p in parts]
    fine = [k for k, g in enumerate(own) if (n := marks.many(g)) >= 3 or n and 2 * n >= len(g)]
    q = np.concatenate([Scorer(model).score([parts[k] for k in fine]), by_words([parts[k] for k in fine], marks)], axis=1)
    total: dict[tuple[str, ...], list] = {}
    for k, s in zip(fine, q):
        for g in own[k] & marks.hot:
            at = total.setdefault(g, [0, 0.0])
            at[0], at[1] = at[0] + 1, at[1] + s
    out = []
    for k in fine:
        hot = sorted(own[k] & marks.hot)
        mean, told = np.split(sum(total[g][1] / total[g][0] for g in hot) / len(hot), 2)
        best, next_ = np.sort(mean)[::-1][:2]
        if best >= least and best >= 2 * next_ and mean.argmax() == told.argmax():
            out.append((int(mean.argmax()), parts[k], max(marks.toxic[g] for g in hot)))
    return out


def by_words(texts: list[str], marks: Marks, per_form: int = 6, least: int = 6) -> np.ndarray:
    """(texts, 3): log likelihoods of the words that the seeds have, by their share of the seed sentences of each category."""
    rng, lex = np.random.default_rng(5), marks.lex
    made = [[{lex.plain(w) for w in lex.words(fill(f, lang, rng))} for lang, fs in by.items() for f in fs for _ in range(per_form)] for by in (seeds.ABUSE, seeds.HATE, seeds.SEXUAL)]
    n = [Counter(w for ws in x for w in ws) for x in made]
    logs = {w: np.log([(c[w] + 0.5) / (len(x) + 1) for c, x in zip(n, made)]) for w in set().union(*n) if sum(c[w] for c in n) >= least and w not in marks.names}
    return np.array([sum((logs[w] for w in {lex.plain(w) for w in lex.words(t)} if w in logs), np.zeros(3)) for t in texts]).reshape(-1, 3)


def fit(texts: list[str], seed: int = 5, weak: list[tuple[int, str, int]] = (), marks: Marks | None = None, most: int = 24_000) -> dict:
    rng = np.random.default_rng(seed)
    d = make(texts, rng, weak, marks)
    ids, y, w = d["ids"], d["y"], d["w"]
    p = init(len(d["known"]) + 2, rng)
    # words without an entry share the vector REST and differ by their letters
    extra = d["n"] - len(p["word"])
    p["word"] = np.concatenate([p["word"], np.zeros((extra, DIM), np.float32)])
    bad = np.isin(ids, list(d["hot"])).sum(axis=1) >= 1
    text = np.arange(len(ids)) >= d["made"]
    pick = lambda rows, n: rows if len(rows) <= n else rng.choice(rows, n, replace=False)
    first = np.concatenate([np.flatnonzero(~text), pick(np.flatnonzero(text & bad), most // 3), pick(np.flatnonzero(text & ~bad), most // 3)])
    learn(p, ids[first], y[first], w[first], d["chars"], rng, epochs=4)
    p["word"][len(d["known"]) + 2 :] = p["word"][REST]
    q = scores(ids, p, d["chars"]).max(axis=1)
    if marks:
        doubtful = np.isin(np.arange(len(ids)), d["suspect"])
    else:
        # windows that may be mislabelled: no more than a few labels are, so what many clean documents hold stays a negative
        doubtful = text & (q > max(0.9, np.sort(q[text])[-min(int(text.sum()), 1 + int(NOISE * len(texts)))] if text.any() else 0.9))
    hard = np.flatnonzero(text & ~doubtful & (q > 0.05))
    second = np.concatenate([np.flatnonzero(~text), np.repeat(hard, 3), pick(np.flatnonzero(text & ~doubtful & bad), most // 3), pick(np.flatnonzero(text & ~doubtful & ~bad), most // 3)])
    learn(p, ids[second], y[second], w[second], d["chars"], rng, epochs=5, rate=0.003)
    p["word"] = p["word"][: len(d["known"]) + 2]
    return {"p": p, "known": d["known"], "starred": d["starred"]}


def scores(ids: np.ndarray, p: dict, chars: tuple, batch: int = 4096) -> np.ndarray:
    flat, start, size = chars
    e = p["word"] + np.add.reduceat(p["char"][flat], start, axis=0) / size[:, None]
    e[PAD] = 0
    tf, tb = e @ p["wf"] + p["cf"], e @ p["wb"] + p["cb"]
    return np.concatenate([forward(tf[ids[k : k + batch].T], tb[ids[k : k + batch].T], (ids[k : k + batch] != PAD).T, p) for k in range(0, len(ids), batch)] or [np.empty((0, 3))])


class Scorer:
    """Scores texts; keeps the input parts of all words met."""

    def __init__(self, model: dict):
        p = self.p = model["p"]
        self.lex = Lexicon(model["known"], model["starred"])
        e = p["word"].copy()
        names = sorted(model["known"], key=model["known"].get)
        for w, i in model["known"].items():
            e[i] += p["char"][triples(w)].mean(axis=0)
        e[PAD] = 0
        n = len(names) + 2
        self.n, self.tf, self.tb = n, np.empty((2 * n, 3 * HIDDEN), np.float32), np.empty((2 * n, 3 * HIDDEN), np.float32)
        self.tf[:n], self.tb[:n] = e @ p["wf"] + p["cf"], e @ p["wb"] + p["cb"]
        self.ids: dict[str, int] = dict(model["known"])
        self.base = n
        # a new word's input parts are the mean of those of its triples and a constant
        self.part = np.concatenate([p["char"] @ p["wf"], p["char"] @ p["wb"]], axis=1)
        self.rest = np.concatenate([p["word"][REST] @ p["wf"] + p["cf"], p["word"][REST] @ p["wb"] + p["cb"]])
        self.triples, self.fresh = Triples(), []

    def number(self, w: str) -> int:
        x = self.lex.plain(w)
        i = self.ids.get(x)
        if i is None:
            i = self.ids[x] = self.n
            self.n += 1
            self.fresh.append(x)
        self.ids[w] = i
        return i

    def _fill(self) -> None:
        """The input parts of the words numbered since the last call."""
        if not self.fresh:
            return
        names = [f"^{x}$" for x in self.fresh]
        size = np.array([max(1, len(x) - 2) for x in names])
        flat = [self.triples[x[k : k + 3]] for x in names for k in range(max(1, len(x) - 2))]
        e = np.add.reduceat(self.part[flat], np.r_[0, np.cumsum(size)[:-1]], axis=0) / size[:, None] + self.rest
        while self.n > len(self.tf):
            self.tf, self.tb = np.concatenate([self.tf, np.empty_like(self.tf)]), np.concatenate([self.tb, np.empty_like(self.tb)])
        self.tf[self.n - len(e) : self.n], self.tb[self.n - len(e) : self.n] = e[:, : 3 * HIDDEN], e[:, 3 * HIDDEN :]
        self.fresh = []

    def score(self, texts: list[str | None]) -> np.ndarray:
        """(texts, 3): the strongest window of each; 0 for texts without words."""
        if len(self.ids) > 400_000:  # the words met are forgotten now and then
            self.ids = dict(self.lex.known)
            self.n = self.base
        get, number = self.ids.get, self.number
        nums, size = [], []
        for t in texts:
            own = [get(w) or number(w) for w in self.lex.words(t)] if t else []
            nums += own
            size.append(len(own))
        self._fill()
        size = np.array(size, dtype=np.int64)
        flat = np.r_[np.array(nums, dtype=np.int64), np.zeros(WIDTH, dtype=np.int64)]
        first = np.r_[0, np.cumsum(size)[:-1]]
        n_win = np.where(size > 0, np.maximum(1, -(-(size - STEP) // STEP)), 0)
        doc = np.repeat(np.arange(len(size)), n_win)
        k = np.arange(len(doc)) - np.repeat(np.r_[0, np.cumsum(n_win)[:-1]], n_win)
        begin, end = first[doc] + k * STEP, (first + size)[doc]
        out = np.zeros((len(texts), 3), np.float32)
        for b in range(0, len(doc), BATCH):
            at = begin[b : b + BATCH] + np.arange(WIDTH)[:, None]
            mask = at < end[b : b + BATCH]
            ids = np.where(mask, flat[np.minimum(at, len(flat) - 1)], PAD)
            np.maximum.at(out, doc[b : b + BATCH], forward(self.tf[ids], self.tb[ids], mask, self.p))
        return out


SCHEMA = "doc_id bigint, abuse float, hate float, sexual float"


def score_docs(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, abuse, hate, sexual): scores from 0 to 1 for every row with an id; 0 for null and empty texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                q = s.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(q[:, k], pa.float32()) for k in range(3))], ["doc_id", *CATEGORIES])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null").mapInArrow(run, SCHEMA)


def scored(spark, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return score_docs(docs, train(docs, spark.read.parquet(f"{d}/labels.parquet")))


def found(spark, d: str) -> DataFrame:
    each = F.explode(F.filter(F.array(*[F.when(F.col(c) >= THRESHOLD, F.lit(c)) for c in CATEGORIES]), lambda x: x.isNotNull()))
    return scored(spark, d).select("doc_id", each.alias("category"))


def rates(spark, d: str) -> DataFrame:
    """Per source: documents, and the share of them that holds each category."""
    src = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source")
    s = scored(spark, d).join(src, "doc_id").groupBy("source")
    return s.agg(F.count("*").alias("documents"), *[F.avg((F.col(c) >= THRESHOLD).cast("double")).alias(f"{c}_rate") for c in CATEGORIES])
