"""Text functions as Column expressions: no Python on executors, all inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything that counts as white space, as a character class both Java and RE2 read alike.
BLANK = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
#: Words of no weight in keyword matching.
STOPWORDS = "a an and are as at be by for from has he her his in is it its of on or she that the their this to was were what when where which who whom whose with".split()
#: Characters stripped from the edges of an entity name.
EDGES = " \t\n\r\"'`.,;:!?()[]{}"
#: Abbreviations that do not end a sentence.
ABBREVIATIONS = "dr mr mrs ms mx prof rev fr st sr jr gen col capt lt sgt maj sen rep gov hon pres vs etc al inc ltd co corp no vol mt ft messrs mme mlle".split()
MASK = "\ue000"


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_ws(c: str | Column) -> Column:
    """Runs of white space to one blank, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(as_col(c), BLANK + "+", " "))


def search_tokens(c: str | Column) -> Column:
    """Lower-case runs of ASCII letters and digits, stop words kept; empty for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(as_col(c)), F.lit("[a-z0-9]+"), F.lit(0)), F.array().cast("array<string>"))


def keyword_tokens(c: str | Column) -> Column:
    """search_tokens without stop words, repeats kept."""
    return F.filter(search_tokens(c), lambda t: ~t.isin(STOPWORDS))


def compact_keywords(c: str | Column, n: int = 16) -> Column:
    """The first n different keywords."""
    return F.slice(F.array_distinct(keyword_tokens(c)), 1, n)


def strip_punctuation(c: str | Column) -> Column:
    """Without the 32 ASCII punctuation characters."""
    return F.regexp_replace(as_col(c), r"[!-/:-@\[-`{-~]", "")


def canonical_entity(c: str | Column) -> Column:
    """Lower case, white space squeezed, edge characters stripped."""
    return F.lower(F.btrim(normalize_ws(c), F.lit(EDGES)))


def identity_key(c: str | Column) -> Column:
    """Names with the same letters and digits are one entity; a name without any stands for itself."""
    key = F.array_join(search_tokens(c), " ")
    return F.when(key != "", key).otherwise(canonical_entity(c))


def normalize_answer(c: str | Column) -> Column:
    """Answer form for comparison: lower case, no ASCII punctuation, no articles, blanks squeezed; in that order."""
    x = strip_punctuation(F.lower(F.coalesce(as_col(c), F.lit(""))))
    return normalize_ws(F.regexp_replace(x, r"(^|[^\p{L}\p{N}_])(a|an|the)(?=[^\p{L}\p{N}_]|$)", "$1 "))


def answer_tokens(c: str | Column) -> Column:
    return F.filter(F.split(normalize_answer(c), " "), lambda t: t != "")


def sentences(c: str | Column) -> Column:
    """Sentences of a text: abbreviations, initials and dotted acronyms do not end one. Empty for null and blank."""
    d = MASK
    t = normalize_ws(c)
    t = F.regexp_replace(t, r"(?U)\b([A-Za-z])\.(?=[A-Za-z]\.)", "$1" + d)
    t = F.regexp_replace(t, rf"(?<={d})([A-Za-z])\.", "$1" + d)
    t = F.regexp_replace(t, r"(?U)\b([A-Z])\.(?=\s+[A-Z])", "$1" + d)
    t = F.regexp_replace(t, rf"(?Ui)\b({'|'.join(ABBREVIATIONS)})\.", "$1" + d)
    parts = F.split(t, r"(?<=[.!?])\s+(?=[\"'(\[]?[A-Z0-9])")
    return F.coalesce(F.filter(F.transform(parts, lambda s: F.trim(F.replace(s, F.lit(d), F.lit(".")))), lambda s: s != ""), F.array().cast("array<string>"))


def junk_surface(c: str | Column) -> Column:
    """Surfaces that name nothing: numbers, one character, quotes inside, or one word and a single letter. Empty and null ones are not junk."""
    x = F.trim(as_col(c))
    return F.coalesce((x != "") & (x.rlike(r"^\p{Nd}+$") | (F.length(x) <= 1) | x.contains('"') | x.rlike(r"^\S+\s+[A-Za-z]$")), F.lit(False))


def words(c: str | Column) -> Column:
    return F.filter(F.split(normalize_ws(c), " "), lambda w: w != "")


def mixquery(question: str | Column, evidence: str | Column, limit: int = 64) -> Column:
    """The whole question, filled up to ``limit`` words with words of the evidence."""
    q, e = words(question), words(F.coalesce(as_col(evidence), F.lit("")))
    room = F.greatest(F.lit(limit) - F.size(q), F.lit(0))
    return F.array_join(F.concat(q, F.slice(e, F.lit(1), room)), " ")


def preview(c: str | Column, limit: int = 18) -> Column:
    """The first words, with an ellipsis if there are more."""
    w = words(c)
    return F.when(F.size(w) > limit, F.concat(F.array_join(F.slice(w, 1, limit), " "), F.lit(" ..."))).otherwise(F.array_join(w, " "))


def display_line(title: str | Column, text: str | Column) -> Column:
    """Title and text; the title is not repeated if the text starts with it."""
    a, b = normalize_ws(F.coalesce(as_col(title), F.lit(""))), normalize_ws(F.coalesce(as_col(text), F.lit("")))
    return F.when((a == "") | F.startswith(F.lower(b), F.lower(a)), b).otherwise(F.concat(a, F.lit(": "), b))


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def last_answer(c: str | Column) -> Column:
    """The text of the last <answer> element, trimmed; null if there is none."""
    return strip(F.try_element_at(F.regexp_extract_all(as_col(c), F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1)), F.lit(-1)))


def first_answer(c: str | Column) -> Column:
    return strip(F.try_element_at(F.regexp_extract_all(as_col(c), F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1)), F.lit(1)))


def judged_answer(c: str | Column) -> Column:
    """The last answer element, else the last 500 characters."""
    return F.coalesce(last_answer(c), F.trim(F.right(as_col(c), F.lit(500))))


def last_number(c: str | Column) -> Column:
    """The last number written in a text."""
    return F.try_element_at(F.regexp_extract_all(F.replace(as_col(c), F.lit(","), F.lit("")), F.lit(r"-?\d+\.?\d*"), F.lit(0)), F.lit(-1))


def to_bool(c: str | Column) -> Column:
    """Ten spellings of true and false; an error for anything else, null for null."""
    x = F.lower(F.trim(as_col(c).cast("string")))
    return F.when(x.isin("1", "true", "yes", "y", "on"), True).when(x.isin("0", "false", "no", "n", "off"), False).when(x.isNull(), F.lit(None).cast("boolean")).otherwise(F.raise_error(F.lit("not a boolean")).cast("boolean"))


# --- rule-based entity mentions ---

#: The mention rules and words that are no names by themselves.
_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)"
DATE_RULES = [rf"\b{_MONTH}\s+\d{{1,2}},?\s+\d{{4}}\b", rf"\b\d{{1,2}}\s+{_MONTH}\s+\d{{4}}\b", rf"\b{_MONTH}\s+\d{{4}}\b", r"\b(?:1[5-9]\d{2}|20\d{2})\b"]
ACRONYM = r"\b(?:[A-Z]\.){2,}|\b[A-Z]{2,}(?:-[A-Z0-9]+)*\b"
_CAP = r"[A-Z][A-Za-z]+(?:[-'][A-Za-z]+)*"
PHRASE = rf"\b{_CAP}(?:\s+(?:(?:of|the|and|for|in|on|at|de|da|du|van|von|la|le|el|&)|{_CAP}))*\b"
NOT_NAMES = "The A An He She It They This That These Those In On At For By As From Question".split()
#: Labels and adjectives that are no targets to look up.
VALUE_LABELS = "DATE TIME CARDINAL ORDINAL QUANTITY PERCENT MONEY NORP".split()
NATIONALITIES = "american british english french german italian spanish russian chinese japanese korean indian canadian australian dutch swedish norwegian danish finnish polish greek turkish egyptian brazilian mexican argentine argentinian irish scottish welsh swiss austrian belgian portuguese iranian iraqi israeli saudi pakistani bangladeshi thai vietnamese indonesian filipino malaysian singaporean ukrainian romanian hungarian czech slovak bulgarian croatian serbian europe european asian african".split()
#: Labels by rank; an entity with several gets the first.
LABEL_RANK = "PERSON ORG GPE LOC FAC WORK_OF_ART EVENT NORP DATE ENTITY".split()


def bad_lookup_target(surface: str | Column, label: str | Column) -> Column:
    """Junk surfaces, literal values and nationality adjectives."""
    return junk_surface(surface) | F.coalesce(F.upper(F.trim(as_col(label))).isin(VALUE_LABELS), F.lit(False)) | F.coalesce(F.lower(F.trim(as_col(surface))).isin(NATIONALITIES), F.lit(False))


def label_rank(label: str | Column) -> Column:
    """Place of a label in LABEL_RANK; unknown labels come after all known ones."""
    at = F.array_position(F.array(*[F.lit(x) for x in LABEL_RANK]), as_col(label))
    return F.when(at > 0, at - 1).otherwise(F.lit(99))


def mentions(c: str | Column) -> Column:
    """array<struct<surface, label>>: dates, acronyms and capitalised phrases of a sentence, each once, in rule order.

    A single capitalised word counts if it has three letters or more and does not begin the sentence.
    """
    s = as_col(c)

    def each(pattern: str, label: str) -> Column:
        return F.transform(F.regexp_extract_all(s, F.lit("(?U)" + pattern), F.lit(0)), lambda x: F.struct(F.btrim(normalize_ws(x), F.lit(EDGES)).alias("surface"), F.lit(label).alias("label")))

    start = F.regexp_extract(s, "(?U)^" + PHRASE, 0)
    phrases = F.filter(F.regexp_extract_all(s, F.lit("(?U)" + PHRASE), F.lit(0)), lambda x: ~x.isin(NOT_NAMES))
    phrases = F.filter(phrases, lambda x, k: (F.regexp_count(x, F.lit(_CAP)) >= 2) | ((F.length(x) >= 3) & ~((k == 0) & (x == start))))
    named = F.transform(phrases, lambda x: F.struct(F.btrim(normalize_ws(x), F.lit(EDGES)).alias("surface"), F.lit("ENTITY").alias("label")))
    found = F.concat(*[each(p, "DATE") for p in DATE_RULES], each(ACRONYM, "ENTITY"), named)
    return F.coalesce(F.array_distinct(F.filter(found, lambda m: ~F.lower(m["surface"]).isin("", "the", "a", "an"))), F.array().cast("array<struct<surface:string,label:string>>"))
