"""Problem 8: evaluation texts leaking into training text.

Method: one Aho-Corasick automaton over the normalised evaluation items. Normalising keeps letters and digits only, in
lower case, without accents and look-alikes, so case, marks, blanks, line ends and hyphenation do not matter. The
patterns are the pairs of neighbouring words of an item that few items have, and where a pair is common the shortest run of
words from there that few have, or four words however many have them; equal items count as one. One scan of a text finds them all. Hits of an item that follow
one another in the text are chained; a gap in the chain is bridged when its two sides are similar, when text is only
inserted or when at most three words that many items have are replaced, so that slight alterations do not break a
passage while another sentence of the same build, with other names, does. A passage counts from ``min_words`` words of the item.
Opening sentences that several items share (stock instructions) are no part of an item.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textfold import Squeeze, edit_distance  # noqa: F401

MIN_WORDS = 15
#: Pairs and words that more items than this have prove nothing by themselves; a run of so many words does, whoever has it:
#: with every fifth word altered a passage still has such runs.
COMMON, RUN = 3, 4
#: Longest stretch of inserted text, in normalised characters, and most words replaced at once.
MAX_INSERT, MAX_REPLACED = 45, 3


class ItemIndex:
    """The automaton and the words of the items."""

    def __init__(self, items: list[tuple[int, str]], min_words: int = MIN_WORDS):
        import ahocorasick

        self.fold, self.min_words = Squeeze(), min_words
        #: A passage of min_words words with every fifth word altered keeps at least so many rare pairs.
        self.needed = max(1, min_words // 6)
        sentences = {i: re.split(r"(?<=[.!?])\s+", (t or "").strip()) for i, t in items}
        first = Counter(s[0] for s in sentences.values() if len(s) > 1)
        self.words: dict[int, list[str]] = {}
        #: The ids of each different item, by the first of them.
        self.ids: dict[int, list[int]] = {}
        seen: dict[tuple[str, ...], int] = {}
        for i, s in sentences.items():
            body = " ".join(s[1:] if len(s) > 1 and first[s[0]] >= 3 else s)
            words = [w for w in (x.translate(self.fold) for x in re.findall(r"\w+", body)) if w]
            if len(words) >= min_words:
                rep = seen.setdefault(tuple(words), i)
                self.words[rep] = words
                self.ids.setdefault(rep, []).append(i)
        df = Counter(w for words in self.words.values() for w in set(words))
        #: Of each item, how many of its first k words are words of few items, and not small ones.
        self.rare = {i: [0, *_running(df[w] <= COMMON and len(w) >= 4 for w in words)] for i, words in self.words.items()}
        self.start = {i: [0, *_running(map(len, w))] for i, w in self.words.items()}
        self.text = {i: "".join(w) for i, w in self.words.items()}
        has: dict[str, set[int]] = defaultdict(set)
        for i, w in self.words.items():
            for m in range(2, RUN + 1):
                for k in range(len(w) - m + 1):
                    has["".join(w[k : k + m])].add(i)
        #: Where a pattern is in items: item, first and last word of its pairs (a longer run is so many pairs), and of each the offset in the pattern, the word, and the length.
        at: dict[str, list[tuple[int, int, int, list[tuple[int, int, int]]]]] = defaultdict(list)
        for i, w in self.words.items():
            for k in range(len(w) - 1):
                for m in range(2, min_words + 1):
                    p = "".join(w[k : k + m])
                    if k + m > len(w) or (len(p) >= 9 and (m >= RUN or len(has[p]) <= COMMON)):
                        break
                if k + m <= len(w) and len(p) >= 9:
                    start = self.start[i]
                    at[p].append((i, k, k + m - 2, [(start[j] - start[k], j, start[j + 2] - start[j]) for j in range(k, k + m - 1)]))
        self.auto = ahocorasick.Automaton()
        for p, where in at.items():
            self.auto.add_word(p, (len(p), where))
        if len(self.auto):
            self.auto.make_automaton()

    def leaks(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, words of the item in the passage, start, end): the longest passage of each item the text leaks, offsets in the text as given."""
        if not text or not len(self.auto):
            return []
        flat = text.translate(self.fold)
        # of each item the first and the last word hit, and the hits
        by: dict[int, list] = {}
        for end, (n, where) in self.auto.iter(flat):
            begin = end + 1 - n
            for i, first, last, pairs in where:
                got = by.get(i)
                if got is None:
                    by[i] = [first, last, begin, pairs]
                else:
                    if first < got[0]:
                        got[0] = first
                    if last > got[1]:
                        got[1] = last
                    got += (begin, pairs)
        found, shortest = [], self.min_words // 3
        for i, got in by.items():
            # no run reaches from before the first hit's word to beyond the last one's, and _chain drops runs of less than a third
            if got[1] + 2 - got[0] < shortest:
                continue
            own = {(begin + offset, j, size) for begin, pairs in zip(got[2::2], got[3::2]) for offset, j, size in pairs}
            if len({k for _, k, _ in own}) < self.needed:
                continue
            best = self._chain(i, own, flat)
            if best[0] >= self.min_words:
                found += [(same, *best) for same in self.ids[i]]
        if found:
            back = [p for p, c in enumerate(text) for _ in self.fold[ord(c)]]
            found = [(i, n, back[a], back[b - 1] + 1) for i, n, a, b in found]
        return sorted(found)

    def _chain(self, i: int, hits: set[tuple[int, int, int]], flat: str) -> tuple[int, int, int]:
        """Longest chain: (words, start, end) in the normalised text."""
        start, item = self.start[i], self.text[i]
        runs: list[list[int]] = []  # first word, last word + 1, start, end in flat
        for s, k, n in sorted(hits):
            for r in reversed(runs[-12:]):
                if k + 2 <= r[1] and k >= r[0] and s < r[3]:
                    break
                lack, more = start[k] - start[r[1]], s - r[3]
                if k < r[1] - 1 or (k == r[1] - 1 and s >= r[3]) or k == r[0] and s == r[2]:
                    continue
                if lack < 0 or more < 0:  # overlaps the last word of the run
                    if lack == more:
                        r[1], r[3] = k + 2, s + n
                        break
                    continue
                gap = k - r[1]
                if gap > 14 or more > lack + MAX_INSERT:
                    continue
                new = self.rare[i][k] - self.rare[i][r[1]]
                if (gap <= MAX_REPLACED and not new) or _alike(item[start[r[1]] : start[k]], flat[r[3] : s]):
                    r[1], r[3] = k + 2, s + n
                    break
            else:
                runs.append([k, k + 2, s, s + n])
        best = (0, 0, 0)
        for a, b, s, e in runs:
            if b - a < self.min_words // 3:
                continue
            while b < len(start) - 1 and (step := _next(item[start[b] :], [start[x] - start[b] for x in range(b + 1, min(b + 5, len(start)))], flat[e : e + 80])):
                b, e = b + step[0], e + step[1]
            while a > 0 and (step := _next(item[: start[a]][::-1], [start[a] - start[x] for x in range(a - 1, max(a - 5, -1), -1)], flat[max(0, s - 80) : s][::-1])):
                a, s = a - step[0], s - step[1]
            best = max(best, (b - a, s, e))
        return best


def _running(xs) -> Iterator[int]:
    n = 0
    for x in xs:
        n += x
        yield n


def _alike(a: str, b: str) -> bool:
    """Whether b is a with text inserted at one place, or either is the other with at most two fifths altered."""
    n = max(len(a), len(b))
    if len(a) <= len(b) <= len(a) + MAX_INSERT:
        k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        if b.endswith(a[k:]):
            return True
    return n <= 160 and abs(len(a) - len(b)) <= 0.4 * n and _distance(a, b) <= 0.4 * n


def _distance(a: str, b: str) -> int:
    """Levenshtein distance by Myers' bit vectors: a column of the table as one number, a bit for each letter of a."""
    if not a:
        return len(b)
    at: dict[str, int] = {}
    for k, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << k
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, d = full, 0, len(a)
    for y in b:
        eq = at.get(y, 0)
        x = eq | down
        h = (((eq & up) + up) ^ up) | eq
        more, less = down | (full & ~(h | up)), up & h
        if more & top:
            d += 1
        elif less & top:
            d -= 1
        more = more << 1 | 1
        up, down = full & (less << 1 | ~(x | more)), more & x & full
    return d


def _next(item: str, ends: list[int], flat: str) -> tuple[int, int] | None:
    """Words of the item, one to four, that go on at the start of flat with at most a fifth of their letters altered."""
    if flat.startswith(item[: ends[0]]):
        return 1, ends[0]
    for k in range(len(ends) - 1, -1, -1):
        w = item[: ends[k]]
        if (k and len(w) > 60) or len(w) < 4:
            continue
        slack = max(1, len(w) // 5)
        if not _near(w, flat, slack):
            continue
        cost, m = _prefix(w, flat[: len(w) + slack], slack)
        if cost <= slack:
            return k + 1, m
    return None


def _near(w: str, flat: str, most: int) -> bool:
    """False only if w is more than ``most`` edits from every prefix of flat: of most + 1 parts of w, one would have to stand in flat as it is, moved by at most as much."""
    n, a = len(w), 0
    for k in range(1, most + 2):
        b = k * n // (most + 1)
        if flat.find(w[a:b], a - most if a > most else 0, b + most) >= 0:
            return True
        a = b
    return False


def _prefix(w: str, flat: str, most: int) -> tuple[int, int]:
    """Smallest edit distance of w to a prefix of flat, and that prefix's length; (most + 1, 0) if it is larger."""
    row = list(range(len(flat) + 1))
    for i, x in enumerate(w, 1):
        last, row[0] = row[0], i
        lo, hi = max(1, i - most), min(len(flat), i + most)
        if lo > 1:
            last, row[lo - 1] = row[lo - 1], most + 1
        low = left = row[lo - 1]
        for j in range(lo, hi + 1):
            # written out, as min() of three takes most of the time of the scan
            here = row[j]
            d = last if x == flat[j - 1] else last + 1
            if left + 1 < d:
                d = left + 1
            if here + 1 < d and j < i + most:
                d = here + 1
            last, row[j], left = here, d, d
            if d < low:
                low = d
        if low > most:
            return most + 1, 0
    lo = max(1, len(w) - most)
    best = min(range(lo, min(len(flat), len(w) + most) + 1), key=lambda j: (row[j], abs(j - len(w))), default=0)
    return (row[best], best) if best else (most + 1, 0)


SCHEMA = "doc_id bigint, item_id bigint, words int, start int, end int"


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", min_words: int = MIN_WORDS, max_items: int = 50_000) -> DataFrame:
    """One row per document and leaked item: the number of words of the passage and its place in the document's text.

    Null and empty texts and items leak nothing; repeated items with one id count once; other columns are ignored. The
    items are a stated, bounded set: more than ``max_items`` of them are refused rather than sent to every task.
    """
    rows = items.select(F.col(item_id).cast("bigint"), item_text).dropna().distinct().limit(max_items + 1).collect()
    if len(rows) > max_items:
        raise ValueError(f"more than {max_items} items; scan the documents once per block of items")
    own = docs.sparkSession.sparkContext.broadcast(sorted((r[0], r[1]) for r in {r[0]: r for r in rows}.values()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(own.value, min_words)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            got = [(d, *x) for d, t in zip(ids, texts) for x in index.leaks(t)]
            cols = list(zip(*got)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "words", "start", "end"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("text is not null").mapInArrow(scan, SCHEMA)


def passages(spark, d: str) -> DataFrame:
    return leaked_items(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/eval_items.parquet"))


def found(spark, d: str) -> DataFrame:
    return passages(spark, d).select("doc_id", "item_id")


def report(spark, d: str) -> DataFrame:
    """Per item: how many documents leak it, and the longest passage."""
    return passages(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("words").alias("longest"))
