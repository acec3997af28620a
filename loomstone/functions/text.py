"""Text expressions: normalisation, terms, token estimates, headings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word characters, a lexical unit, stop words of bounded queries, words that don't navigate, heading prefixes, question prefixes.
WORD = r"[\p{L}\p{N}_]+"
UNIT = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
STOP_WORDS = (
    "a", "an", "and", "are", "can", "do", "does", "for", "from", "how", "in", "is", "of", "on", "or", "the", "to",
    "what", "when", "where", "which", "who", "why", "with",
)
NAVIGATION_WORD = "[a-z0-9]+(?:-[a-z0-9]+)*"
NAVIGATION_STOP = (
    "a an and are as at be by can could do does for from how i in is it its of on or the their them these they this those that to was "
    "what when where which who why with would you your stand stands explain define definition mean means work works please about tell "
    "me more course lecture lectures material materials knowledge say says help understand"
).split()
HEADING_PREFIX = r"^(?:chapter|section|part|unit|lesson|module|appendix)\b|^\d+(?:\.\d+)*[.)]?\s+"
QUESTION_PREFIX = r"^(?:what\s+is|what\s+are|define|explain|describe|which\s+of\s+the\s+following)\b[\s:—-]*"


def fold(text: Column) -> Column:
    """Lower case with the sharp s spelled out: the supported part of Unicode case folding."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


#: Anything outside these may change under NFKC, and under case folding or Unicode white space by more than lower case and a sharp s.
COMPOSED = r"[^\x00-\x9F\u00A1-\u00A7\u00A9\u00AB-\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u00BF-\u00FF\u2012-\u2015\u2018-\u201F]"
UNSTABLE = r"[^\x00-\x1B\x20-\x84\x86-\x9F\u00A1-\u00A7\u00A9\u00AB-\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u00BF-\u00FF\u2012-\u2015\u2018-\u201F]"


def _unicode(text: Column, kind: str, method: str) -> Column:
    """A method of the Unicode library that comes with Spark, which stays in the JVM; null stays null."""
    return F.when(text.isNotNull(), F.java_method(F.lit(f"com.ibm.icu.{kind}"), F.lit(method), text, F.lit(True)))


def nfkc(text: Column) -> Column:
    """Compatibility composition; only texts that it may change are taken through it."""
    return F.when(text.rlike(COMPOSED), _unicode(text, "text.Normalizer", "compose")).otherwise(text)


def normalize_evidence(text: Column) -> Column:
    """NFKC, case folding and collapsed white space, for comparison only."""
    folded = _unicode(_unicode(text, "text.Normalizer", "compose"), "lang.UCharacter", "foldCase")
    wide = F.regexp_replace(F.regexp_replace(folded, r"(?U)[\s\x1C-\x1F]+", " "), "^ | $", "")
    return F.when(text.rlike(UNSTABLE), wide).otherwise(F.trim(F.regexp_replace(fold(text), r"\s+", " ")))


def navigation_terms(text: Column) -> Column:
    """Distinct lower-case words that say what a question is about."""
    every = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(NAVIGATION_WORD), 0))
    return F.filter(every, lambda w: ~w.isin(*NAVIGATION_STOP))


def duplicate_key(text: Column) -> Column:
    """What is left of a question without its prefix and punctuation."""
    bare = F.regexp_replace(normalize_evidence(text), QUESTION_PREFIX, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def words(text: Column) -> Column:
    """Folded words in order."""
    return F.regexp_extract_all(fold(text), F.lit(f"({WORD})"), 1)


def terms(text: Column) -> Column:
    """Distinct folded words, first occurrence first."""
    return F.array_distinct(words(text))


def bounded_terms(question: Column, most: int) -> Column:
    """The first distinct words that are no stop words; all words if none is left."""
    every = words(question)
    kept = F.filter(F.array_distinct(every), lambda w: ~w.isin(*STOP_WORDS))
    return F.slice(F.when(F.size(kept) > 0, kept).otherwise(every), 1, most)


def told_once(value: Column, tell: Callable[[Column], Column]) -> Column:
    """``tell`` of a costly value that is worked out once, however often ``tell`` names it."""
    return F.get(F.transform(F.array(value), tell), F.lit(0))


def units(text: Column) -> Column:
    """How many lexical units a text has: its characters without white space, a word being one."""
    plain = F.octet_length(text) == F.char_length(text)
    marked = F.when(plain, F.regexp_replace(text, r"\w++", "w")).otherwise(F.regexp_replace(text, r"[\w\p{L}\p{N}]++", "w"))
    return F.char_length(F.translate(marked, " \t\n\x0b\f\r", ""))


def token_estimate(text: Column) -> Column:
    """A conservative token count from characters, bytes and lexical units of the text in NFKC; 0 for an empty text."""
    most = lambda t: F.greatest(F.lit(1), F.ceil(F.char_length(t) / 3), F.ceil(F.octet_length(t) / 4), units(t))
    return told_once(nfkc(text), lambda t: F.when(t == "", F.lit(0)).otherwise(most(t)).cast("long"))


def heading(line: Column) -> Column:
    """True for a short line that reads like a heading."""
    body = F.trim(line)
    parts = F.split(body, r"\s+")
    upper_first = F.size(F.filter(parts, lambda w: w.rlike(r"^\p{Lu}")))
    capitals = body.rlike(r"\p{L}") & ~body.rlike(r"[\p{L}&&[^\p{Lu}]]")
    shape = (F.size(parts) <= 14) & (capitals | (upper_first >= F.greatest(F.lit(1), F.ceil(F.size(parts) * 0.8))))
    return (body != "") & (F.char_length(body) <= 160) & ~F.substring(body, -1, 1).isin(*".!?;:") & (F.lower(body).rlike(HEADING_PREFIX) | shape)


def length_framed(*parts: Column) -> Column:
    """SHA-256 of the parts, each preceded by its length in bytes."""
    return F.sha2(F.concat(*[x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p)]), 256)
