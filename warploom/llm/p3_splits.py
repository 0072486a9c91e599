"""Problem 3: same or near-same records across splits.

Method: similarity-hash bit fingerprints. Each different question is folded (case, accents, look-alikes, marks), and its
words are weighed by inverse document frequency over the questions of both splits, less if they are seldom capitalised
inside a question. Every span of two neighbouring words
of nearly the greatest weight in the question (in practice the names of its title) gets a fingerprint of 96 bits: six
segments of 16 bits, each the similarity hash of one part (beginning, middle, end) of one of the two words. The
fingerprints are joined across the splits on permuted blocks of four of the six segments, within the Hamming radius. One
slip (a letter changed, added, missing, or two neighbours exchanged) changes at most two of the segments, so spans that
differ by one slip always share a block. Questions whose weights are all low (their title is asked about very often)
have every pair of neighbouring words as a span.

Candidates are then compared as texts. The words of great weight must occur in both questions, close in spelling; the
stretch around them that both share is taken for the title, and the words that only one of the two has besides say which
fact it asks for. The fact is the same if the golden answers agree, if there are no such words, or if they ask for the
same: how often questions that differ by these words agree in their answers is counted over all candidates.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .textfold import Fold, edit_distance

#: Segments of a fingerprint, bits of each, how many of them make a block, and the Hamming radius.
SEGMENTS, BITS, KEPT, RADIUS = 6, 16, 4, 24
#: Words in a smaller share of the questions than 1 / SHARES all weigh the same, so the table of weights is bounded.
SHARES = 10_000
#: A word is weighty from this part of the greatest weight of its question; a question of less than LOW times the greatest possible weight is all common words.
WEIGHTY, LOW = 0.6, 0.6
#: What a word weighs that is never capitalised inside a question, of one that always is.
PLAIN = 0.4
#: Rests of questions seen with no answers are the same fact from this likeness on.
ALIKE = 0.5


def words(text: str | None, fold: Fold) -> list[str]:
    return re.findall(r"[^\W_]+", (text or "").translate(fold))


def close(a: str, b: str) -> bool:
    """Equal but for a slip: one letter, two of a long word, or two letters exchanged."""
    n = min(len(a), len(b))
    most = 2 if n >= 8 or (n >= 4 and sorted(a) == sorted(b)) else 1
    return a == b or (n >= 4 and edit_distance(a, b, most) <= most)


class Weights:
    """Inverse document frequency of words, bounded by ln SHARES; seen holds, by word, in how many questions it is and which share capitalises it."""

    def __init__(self, n: int, seen: dict[str, tuple[int, float]]):
        n = max(n, 2)
        self.top = min(math.log(n), math.log(SHARES))
        self.known = {w: min(math.log(n / min(c, n)), self.top) * (PLAIN + (1 - PLAIN) * cap) for w, (c, cap) in seen.items()}

    def of(self, w: str) -> float:
        return self.known.get(w, self.top)

    def weighty(self, ws: list[str]) -> set[str]:
        """The words of nearly the greatest weight."""
        own = {w: self.of(w) for w in ws}
        mark = WEIGHTY * max(own.values(), default=0.0)
        return {w for w, x in own.items() if x >= mark}

    def spans(self, ws: list[str]) -> set[tuple[str, str]]:
        """Neighbouring weighty words with at most two words between; one alone stands twice."""
        need = self.weighty(ws)
        if max(self.of(w) for w in ws) < LOW * self.top:
            return set(zip(ws, ws[1:])) or {(w, w) for w in ws}
        at = [i for i, w in enumerate(ws) if w in need]
        got = {(ws[i], ws[j]) for i, j in zip(at, at[1:]) if j - i <= 3}
        # an added rare word must not part the two names
        got |= {(ws[i], ws[k]) for i, k in zip(at, at[2:]) if k - i <= 2}
        return got or {(ws[i], ws[i]) for i in at}


def parts(w: str) -> tuple[str, str, str]:
    return w[:3], w[3:-3], w[-3:]


class Coder:
    """Fingerprints of spans; a feature's bits lie in one byte each of a number, so that adding numbers counts them."""

    def __init__(self):
        self.bits: dict[str, int] = {}

    def _feature(self, f: str) -> int:
        h = zlib.crc32(f.encode())
        self.bits[f] = got = sum(1 << (8 * k) for k in range(BITS) if h >> k & 1)
        return got

    def _count(self, part: str) -> bytes:
        fs = [*part, *(part[k : k + 2] for k in range(len(part) - 1)), f"={part}"]
        # more than 120 features would overflow a byte; such a part is told by its hash alone
        fs = fs if len(fs) <= 120 else [f"={part}"]
        total = sum(self.bits.get(f) or self._feature(f) for f in fs)
        return bytes([len(fs)]) + total.to_bytes(BITS, "little")

    def segments(self, spans: list[tuple[str, str]]) -> np.ndarray:
        """(spans, SEGMENTS) numbers of BITS bits."""
        if not spans:
            return np.empty((0, SEGMENTS), dtype=np.int64)
        raw = b"".join(self._count(p) for a, b in spans for w in (a, b) for p in parts(w))
        m = np.frombuffer(raw, dtype=np.uint8).reshape(-1, BITS + 1)
        bits = 2 * m[:, 1:].astype(np.int16) > m[:, :1]
        return (bits @ (1 << np.arange(BITS, dtype=np.int64))).reshape(-1, SEGMENTS)


def code(word: str) -> int:
    """The 48 bits of one word of a fingerprint."""
    a, b, c = (int(x) for x in Coder().segments([(word, word)])[0][:3])
    return a << 2 * BITS | b << BITS | c


BLOCKS = list(combinations(range(SEGMENTS), KEPT))


def blocks(seg: np.ndarray) -> np.ndarray:
    """(spans, blocks) signed 64-bit keys: the permuted segments of each block side by side."""
    keys = np.zeros((len(seg), len(BLOCKS)), dtype=np.uint64)
    for k, own in enumerate(BLOCKS):
        for s in own:
            keys[:, k] = keys[:, k] << np.uint64(BITS) | seg[:, s].astype(np.uint64)
    return keys.view(np.int64)


def shared_stretch(a: list[str], b: list[str], need: set[str], weight: Weights) -> tuple[int, int, int, int] | None:
    """First and last place, in a and in b, of the heaviest stretch of words close in spelling around a weighty word; a word added in either is passed over."""
    best, got, done = 0.0, None, set()
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if (x not in need and y not in need) or (i, j) in done or not (x == y or close(x, y)):
                continue
            ends = []
            for step in (-1, 1):
                p, q = i, j
                while True:
                    for dp, dq in ((1, 1), (2, 1), (1, 2)):
                        u, v = p + step * dp, q + step * dq
                        if 0 <= u < len(a) and 0 <= v < len(b) and close(a[u], b[v]):
                            p, q = u, v
                            done.add((p, q))
                            break
                    else:
                        break
                ends.append((p, q))
            (p, q), (u, v) = ends
            total = sum(weight.of(w) for w in a[p : u + 1])
            if total > best:
                best, got = total, (p, u, q, v)
    return got


def lone(a: list[str], b: list[str]) -> list[str]:
    """The different words of a that b lacks, up to slips."""
    return sorted({x for x in a if x not in b and not any(close(x, y) for y in b)})


def compare(a: list[str], b: list[str], answers_a: set[str], answers_b: set[str], weight: Weights) -> tuple[bool | None, list[str], list[str], float] | None:
    """Of two questions about the same title: whether their answers agree (None if one has none), the words that only one asks with, and their likeness."""
    agree = None if not (answers_a and answers_b) else bool(answers_a & answers_b)
    if a == b:
        return agree, [], [], 1.0
    na, nb = weight.weighty(a), weight.weighty(b)
    lone_a, lone_b = set(lone(a, b)) & na, set(lone(b, a)) & nb
    if agree and min(len(lone_a), len(lone_b)) > 1:
        return None
    at = shared_stretch(a, b, na | nb, weight)
    if at is None:
        return None
    p, u, q, v = at
    inside = sum(x in na for x in a[p : u + 1]), sum(y in nb for y in b[q : v + 1])
    if max(inside) < min(2, len(na), len(nb)):
        return None
    if not agree and lone_a and lone_b:
        # another title has names of its own, as rare as those shared; added or asking words are less so
        heavy = sorted(weight.of(x) for x in {*a[p : u + 1]} if x in na)[-2:] or [0.0]
        if min(max(weight.of(x) for x in own) for own in (lone_a, lone_b)) >= heavy[0]:
            return None
    ra, rb = a[:p] + a[u + 1 :], b[:q] + b[v + 1 :]
    la, lb = lone(ra, rb), lone(rb, ra)
    all_ = sum(weight.of(x) for x in {*ra, *lb})
    return agree, la, lb, 1.0 - sum(weight.of(x) for x in la + lb) / all_ if all_ else 1.0


def _folded(df: DataFrame, id_col: str, question: str, answers: list[str]) -> DataFrame:
    """(id, key, answers, caps): folded words of the question, folded answers, and words capitalised inside the question, of every different row."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(question).alias("q"), F.flatten(F.array(*[F.coalesce(a, F.array().cast("array<string>")) for a in answers])).alias("a")).where("id is not null and q is not null").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = Fold()
        for b in batches:
            qs = b.column(1).to_pylist()
            keys = [" ".join(words(q, fold)) for q in qs]
            ans = [sorted({k for x in a if x for k in [" ".join(words(x, fold))] if k}) for a in b.column(2).to_pylist()]
            # a question in capitals throughout tells nothing
            caps = [sorted({w.translate(fold) for w in re.findall(r"[^\W_]+", q)[1:] if w[0].isupper()}) if not q.isupper() else [] for q in qs]
            lists = [pa.array(x, pa.list_(pa.string())) for x in (ans, caps)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.string()), *lists], ["id", "key", "answers", "caps"])

    return rows.mapInArrow(run, "id bigint, key string, answers array<string>, caps array<string>").where("key <> ''")


def _spans(keys: DataFrame, weights) -> DataFrame:
    """(key, a, b): the spans of every question."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = Weights(*weights.value)
        for batch in batches:
            out = [(key, x, y) for key in batch.column(0).to_pylist() for x, y in sorted(weight.spans(key.split(" ")))]
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["key", "a", "b"])

    return keys.mapInArrow(run, "key string, a string, b string")


def _coded(spans: DataFrame, side: str) -> DataFrame:
    """(a, b, hi, lo, block, v) of every different span, one row a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        for batch in batches:
            seg = coder.segments(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())))
            shift = np.array([2 * BITS, BITS, 0])
            keys = blocks(seg)
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, len(BLOCKS), dtype=np.int32), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((seg[:, :3] << shift).sum(axis=1)), pa.array((seg[:, 3:] << shift).sum(axis=1)), lists], ["a", "b", "hi", "lo", "v"])

    got = spans.select("a", "b").distinct().mapInArrow(run, "a string, b string, hi bigint, lo bigint, v array<bigint>")
    return got.select(*[F.col(c).alias(f"{c}{side}") for c in ("a", "b", "hi", "lo")], F.posexplode("v").alias("block", "v"))


def overlaps(train: DataFrame, evals: DataFrame, train_id: str, eval_id: str, question: str = "question", train_answers: list[str] = ("golden_answers",), eval_answers: list[str] = ("golden_answers",)) -> DataFrame:
    """(t_id, e_id): every pair of rows of the two splits whose questions ask for the same fact about the same title.

    Null and empty questions overlap with nothing. Repeated rows give one pair. Null answers are as good as none.
    """
    sides = {}
    for name, df, i, ans in (("t", train, train_id, train_answers), ("e", evals, eval_id, eval_answers)):
        sides[name] = materialize(_folded(df, i, question, list(ans)), f"p3{name}")
    keys = sides["t"].select("key", "caps").unionByName(sides["e"].select("key", "caps")).groupBy("key").agg(F.max("caps").alias("caps"))
    n = keys.count()
    told = F.size("caps") > 0
    each = keys.select(F.explode(F.array_distinct(F.split("key", " "))).alias("w"), told.cast("int").alias("told"), "caps").select("w", "told", F.array_contains("caps", F.col("w")).cast("int").alias("cap"))
    df = each.groupBy("w").agg(F.count("*").alias("n"), F.sum("told").alias("told"), F.sum("cap").alias("cap"))
    # at most (words of a question) * SHARES words
    counts = {r.w: (r.n, r.cap / r.told if r.told else 1.0) for r in df.where(F.col("n") > n / SHARES).collect()}
    weights = train.sparkSession.sparkContext.broadcast((n, counts))

    has = {s: materialize(_spans(d.select("key").distinct(), weights), f"p3w{s}") for s, d in sides.items()}
    t, e = (_coded(has[s], s) for s in "te")
    apart = F.bit_count(F.col("hit").bitwiseXOR(F.col("hie"))) + F.bit_count(F.col("lot").bitwiseXOR(F.col("loe")))
    near = t.join(e, ["block", "v"]).where(apart <= RADIUS).select("at", "bt", "ae", "be").distinct()
    pairs = has["t"].toDF("kt", "at", "bt").join(near, ["at", "bt"]).join(has["e"].toDF("ke", "ae", "be"), ["ae", "be"]).select("kt", "ke").distinct()
    # all answers given to a question, over its copies
    given = {s: d.select("key", F.explode_outer("answers").alias("a")).groupBy("key").agg(F.collect_set("a").alias("a")) for s, d in sides.items()}
    full = pairs.join(given["t"].toDF("kt", "xt"), "kt").join(given["e"].toDF("ke", "xe"), "ke").select("kt", "ke", "xt", "xe")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = Weights(*weights.value)
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)))
            out = [(x, y, *got) for x, y, p, q in rows if (got := compare(x.split(" "), y.split(" "), set(p), set(q), weight))]
            cols = list(zip(*out)) or [()] * 6
            types = (pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, types)], ["kt", "ke", "agree", "lt", "le", "alike"])

    titled = materialize(full.mapInArrow(verify, "kt string, ke string, agree boolean, lt array<string>, le array<string>, alike double"), "p3v")
    share = F.avg(F.col("agree").cast("int"))
    # words that may be added to a question and it still asks for the same; of the table of weights, so bounded like it
    one = F.when(F.size("lt") == 0, F.col("le")).when(F.size("le") == 0, F.col("lt"))
    added = titled.where("agree is not null").withColumn("w", F.explode(one)).groupBy("w").agg(share.alias("share")).where("share > 0.5")
    idle = train.sparkSession.sparkContext.broadcast({r.w for r in added.collect() if r.w in counts})

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                sets.append(sorted([" ".join(w for w in x if w not in idle.value), " ".join(w for w in y if w not in idle.value)]))
            one, two = (pa.array([x[k] for x in sets], pa.string()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 2, 5)), one, two], ["kt", "ke", "agree", "alike", "r1", "r2"])

    asked = materialize(titled.mapInArrow(reduce, "kt string, ke string, agree boolean, alike double, r1 string, r2 string"), "p3a")
    # which words ask for the same fact as which, over all candidates
    told = asked.where("agree is not null").groupBy("r1", "r2").agg(share.alias("share"))
    sure = F.coalesce(F.col("agree"), F.lit(False)) | (F.concat("r1", "r2") == "")
    learned = asked.where(~sure).join(told, ["r1", "r2"], "left").where(F.coalesce(F.col("share") > 0.5, F.lit(False)) | (F.col("alike") >= ALIKE))
    same = asked.where(sure).select("kt", "ke").unionByName(learned.select("kt", "ke"))
    t, e = (sides[s].select(F.col("id").alias(f"{s}_id"), F.col("key").alias(f"k{s}")).distinct() for s in "te")
    return same.join(t, "kt").join(e, "ke").select("t_id", "e_id").distinct()


def found(spark, d: str) -> DataFrame:
    train, evals = spark.read.parquet(f"{d}/qa_train.parquet"), spark.read.parquet(f"{d}/results_step120.parquet")
    return overlaps(train, evals, "qa_id", "result_id", train_answers=["golden_answers", "reward_model.ground_truth"]).select(F.col("t_id").alias("qa_id"), F.col("e_id").alias("result_id"))


def report(spark, d: str) -> DataFrame:
    """Per split and data_source of the evaluation records: records that overlap with training questions, and all."""
    evals = spark.read.parquet(f"{d}/results_step120.parquet").select("result_id", "split", "data_source").distinct()
    hit = found(spark, d).select("result_id").distinct().withColumn("hit", F.lit(1))
    return evals.join(hit, "result_id", "left").groupBy("split", "data_source").agg(F.count("hit").alias("overlapping"), F.count("*").alias("records"))
