"""Folding of text for matching: case, accents, look-alike letters, marks and blanks."""

from __future__ import annotations

import unicodedata

#: Letters of other alphabets that look like Latin ones.
LOOKALIKE = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "һ": "h", "ո": "n",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
}


def fold_char(c: str) -> str:
    """The folded form of one character; empty for marks and format characters."""
    out = []
    for x in unicodedata.normalize("NFKD", c.lower()):
        x = LOOKALIKE.get(x, x)
        out.extend(y for y in x if not unicodedata.category(y).startswith(("M", "Cf")))
    return "".join(out)


class Squeeze(dict):
    """For str.translate: keeps folded letters and digits, drops all else."""

    def __missing__(self, cp: int) -> str:
        self[cp] = got = "".join(x for x in fold_char(chr(cp)) if x.isalnum())
        return got


class Fold(dict):
    """For str.translate: folds letters and digits, keeps other characters but drops combining and format ones."""

    def __missing__(self, cp: int) -> str:
        self[cp] = got = fold_char(chr(cp))
        return got


def edit_distance(a: str, b: str, most: int = 1 << 30) -> int:
    """Levenshtein distance, or most + 1 as soon as it must be larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0], low, left = row[0], i, i, i
        for j, y in enumerate(b, 1):
            here = row[j]
            d = last if x == y else last + 1
            if left + 1 < d:
                d = left + 1
            if here + 1 < d:
                d = here + 1
            last, row[j], left = here, d, d
            if d < low:
                low = d
        if low > most:
            return most + 1
    return row[-1]
