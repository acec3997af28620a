"""Quality rules: one table of thresholds compiled into one Spark projection.

The counts of a text and the verdict of every rule are built-in expressions;
there is no user function, no join and no shuffle.  A text's repeated windows
are found inside its row by sorting window hashes, so the work of a text grows
as n log n with its words.

Defined results: a null or empty text has no words, so every count is 0 and it
fails the base rule; a text without lines that hold a word has no repeated
lines; equal rows get equal verdicts; columns beside the text are passed on
unread, and columns named like a count are overwritten; an empty table gives an
empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Word separators, symbols and the repeated-window length.
SPACE = r"[ \t-\r]"
WORD = r"[^ \t-\r]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8

#: Frequent short words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in that is it for on with as are this be or by at from was not an "
    "le la les de des du et en un une que qui pour dans est par sur au avec ne pas "
    "der die das und zu den von mit ist im ein eine auf nicht für des dem sich auch "
    "el los las y del que es un una por con para se su al lo como más"
).split()


@dataclass(frozen=True)
class Rule:
    """A text fails when ``numerator`` lies outside [low, high] times ``denominator``; the bounds are per mille."""

    name: str
    numerator: str
    denominator: str
    low: int | None = None
    high: int | None = None


#: The threshold table. ``one`` is the constant 1, so its rules bound plain counts.
RULES = (
    Rule("word_length", "word_chars", "n_words", low=2_000, high=14_000),
    Rule("symbols", "n_symbols", "n_words", high=250),
    Rule("stop_words", "n_stop_words", "n_words", low=20),
    Rule("dup_lines", "n_dup_lines", "n_lines", high=400),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def _repeat_words(words: str) -> Column:
    """How many words lie in windows that are found twice or more in the array column ``words``."""
    hashes = f"transform(sequence(1, size({words}) - {WINDOW - 1}), i -> xxhash64(slice({words}, i, {WINDOW})))"
    starts = """sort_array(filter(
        transform(t, (x, j) -> CASE WHEN coalesce(get(t, j - 1).h = x.h, false) OR coalesce(get(t, j + 1).h = x.h, false) THEN x.i END),
        x -> x IS NOT NULL))"""
    covered = f"aggregate(transform(s, (x, j) -> least({WINDOW}, coalesce(get(s, j + 1) - x, {WINDOW}))), 0L, (a, x) -> a + x)"
    count = f"""transform(array({starts}), s -> {covered})[0]"""
    return F.expr(f"""
      CASE WHEN size({words}) <= {WINDOW} THEN 0L ELSE
        transform(array({hashes}), h ->
          CASE WHEN size(array_distinct(h)) = size(h) THEN 0L
               ELSE transform(array(sort_array(transform(h, (x, i) -> named_struct('h', x, 'i', i)))), t -> {count})[0] END)[0] END""")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append the counts that the rules read."""
    body = F.coalesce(F.col(text), F.lit(""))
    words, lines = "__words", "__lines"
    # a partition id makes the words unfit for substitution: a filter on the verdict would else carry the split into every step of the window search
    body = F.when(F.spark_partition_id() >= 0, body)
    out = docs.withColumns({
        words: F.filter(F.split(F.btrim(body, F.lit(" \t\n\x0b\x0c\r")), f"{SPACE}+"), lambda x: x != ""),
        lines: F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD)),
    })
    stop = list(dict.fromkeys(STOP_WORDS))
    return out.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^#*$%&|<>]+", "")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*stop))).cast("long"),
        "n_repeat_words": _repeat_words(words),
    }).drop(words, lines)


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """True if no rule of the table is broken; integers only, so every engine agrees."""
    ok = F.lit(True)
    for r in rules:
        top, bottom = F.col(r.numerator) * 1000, F.col(r.denominator)
        if r.low is not None:
            ok = ok & (top >= bottom * r.low)
        if r.high is not None:
            ok = ok & (top <= bottom * r.high)
    return ok


def quality_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Append the counts, ``base_failed`` and ``kept`` to every row."""
    base = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    out = measure(docs, text).withColumn("base_failed", base)
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that pass, with their own columns."""
    whole = docs.select(F.struct(*docs.columns).alias("__row"), F.col(text).alias("__text"))
    return quality_rules(whole, "__text", rules).where("kept").select("__row.*")


def verdict_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The table of thresholds as one SQL condition."""
    parts = []
    for r in rules:
        if r.low is not None:
            parts.append(f"{r.numerator} * 1000 >= {r.denominator} * {r.low}")
        if r.high is not None:
            parts.append(f"{r.numerator} * 1000 <= {r.denominator} * {r.high}")
    return " AND ".join(parts)


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for ``doc_id``, the counts and both flags."""
    word = r"[^\x20\x09-\x0D]+"
    stop = ", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))
    return f"""
    WITH w AS (
      SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '{word}') AS words,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines
      FROM {table}),
    wins AS (
      SELECT doc_id, i, array_to_string(words[i : i + {WINDOW - 1}], ' ') AS win
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
    twice AS (SELECT doc_id, i FROM wins QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
    cover AS (
      SELECT doc_id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n
      FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
    counts AS (
      SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(body, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) AS BIGINT) AS n_lines,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(len(list_filter(words, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop_words,
             CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cover USING (doc_id))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words,
           (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
           NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND ({verdict_sql()}) AS kept
    FROM counts"""
