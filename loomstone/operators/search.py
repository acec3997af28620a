"""Searches for a set of questions at once: cover-density ranks over positional postings, and both channels fused by question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions import text as tx
from loomstone.operators import whole
from loomstone.sources.folders import settle

#: Weight of a word whose part of the text says nothing of its importance.
WEIGHT = 0.1


def asked_terms(questions: DataFrame, question: str, most: int) -> DataFrame:
    """(query_id, term, number, n_terms): the bounded distinct terms of every question; a question without words has none."""
    terms = questions.select("query_id", F.array_distinct(tx.bounded_terms(F.coalesce(F.col(question), F.lit("")), most)).alias("terms"))
    return terms.select("query_id", F.posexplode("terms").alias("number", "term"), F.size("terms").alias("n_terms"))


def postings(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, place, term) of the asked terms only."""
    words = texts.select("doc_id", F.posexplode(tx.words(F.coalesce("text", F.lit("")))).alias("place", "term"))
    return words.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")


def score(r: Column) -> Column:
    return F.round(r / (r + 1), 9)


def held_whole(found: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, doc_id, r) of the texts with every term of a question, by their minimal covers."""
    met = found.groupBy("doc_id", "term").agg(F.array_sort(F.collect_list("place")).alias("places")).join(terms, "term")
    entry = F.flatten(F.collect_list(F.transform("places", lambda p: F.struct(p.alias("place"), F.col("number").alias("number")))))
    held = met.groupBy("query_id", "doc_id").agg(F.count("*").alias("n"), F.first("n_terms").alias("n_terms"), F.array_sort(entry).alias("entries")).where("n = n_terms")
    return held.select("query_id", "doc_id", covers(F.col("entries"), F.col("n_terms")).alias("r"))


def held_any(found: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, r) of at least the ``k`` best texts of every question by the places of its terms.

    The k-th most places of one term are a floor of the k-th best sum of a question with it, and a text above the floor holds
    its part of that in one term; texts with less in every term are never paired with the question.
    """
    counts = settle(found.groupBy("doc_id", "term").agg(F.count("*").alias("n")), "counts")
    most = Window.partitionBy("term").orderBy(F.desc("n"), "doc_id")
    least = counts.withColumn("at", F.row_number().over(most)).where(F.col("at") <= k).groupBy("term").agg(F.min("n").alias("least"), F.count("*").alias("texts"))
    least = least.where(F.col("texts") == k).select("term", "least")
    rounded = score(F.max("least") * F.lit(WEIGHT)) - 2e-9  # scores that rounding makes equal go by their ids
    floors = terms.join(least, "term", "left").groupBy("query_id").agg(F.coalesce(rounded / (1 - rounded) / WEIGHT - 1e-6, F.lit(0.0)).alias("floor"))
    asked = settle(terms.join(floors, "query_id"), "asked")
    met = counts.join(F.broadcast(asked), "term").where(F.col("n") * F.col("n_terms") >= F.col("floor")).select("query_id", "doc_id").distinct()
    return met.join(F.broadcast(asked.select("query_id", "term")), "query_id").join(counts, ["doc_id", "term"]).groupBy("query_id", "doc_id").agg((F.sum("n") * F.lit(WEIGHT)).alias("r"))


def covers(entries: Column, n_terms: Column) -> Column:
    """Sum over the minimal covers of (place, number) entries: a stretch with every term, none of which starts later and ends as early.

    A cover weighs WEIGHT divided by one more than the words in it that nobody asked for.
    """
    last = F.array_repeat(F.lit(-1), n_terms)
    start = F.struct(last.alias("last"), F.lit(-1).alias("low"), F.lit(0.0).alias("sum"))
    numbered = F.transform(entries, lambda e, k: F.struct(e["place"].alias("place"), e["number"].alias("number"), k.alias("k")))

    def step(state: Column, e: Column) -> Column:
        seen = F.transform(state["last"], lambda v, t: F.when(t == e["number"], e["k"]).otherwise(v))
        low = F.array_min(seen)
        idle = e["place"] - F.get(entries, low)["place"] - (e["k"] - low)
        # the lowest of the last places moves on only where a cover ends that holds no other
        gain = F.when(low > state["low"], F.lit(WEIGHT) / (idle + 1)).otherwise(0.0)
        return F.struct(seen.alias("last"), F.greatest(low, state["low"]).alias("low"), (state["sum"] + gain).alias("sum"))

    return F.aggregate(numbered, start, step, lambda s: s["sum"])


def lexical(questions: DataFrame, texts: DataFrame, question: str = "question", most_terms: int = 12, every: bool = False, k: int = 20) -> DataFrame:
    """(query_id, doc_id, lexical_score, lexical_rank): the ``k`` best texts of every question, ties by id.

    With ``every``, a text must hold all terms and is ranked by its minimal covers; else each occurrence of a term is a cover
    of its own.  The score is r / (r + 1) of the sum r.  Texts and questions meet by their terms.
    """
    terms = settle(asked_terms(questions, question, most_terms), "terms")
    if every:
        # texts that share an id, or have none, are one text, whose places meet by their terms
        shared = settle(texts.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select("doc_id"), "shared")
        if shared.isEmpty():
            scored = whole.held_whole(texts, terms, k, WEIGHT)
        else:
            alike = texts["doc_id"].eqNullSafe(shared["doc_id"])
            scored = whole.held_whole(texts.join(shared, alike, "left_anti"), terms, k, WEIGHT)
            scored = scored.unionByName(held_whole(postings(texts.join(shared, alike, "left_semi"), terms), terms))
    else:
        scored = held_any(postings(texts, terms), terms, k)
    scored = scored.select("query_id", "doc_id", score(F.col("r")).alias("lexical_score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("lexical_score"), "doc_id")
    return scored.withColumn("lexical_rank", F.row_number().over(best)).where(F.col("lexical_rank") <= k)


def fused(vector: DataFrame, lexical_: DataFrame, fusion_k: int = 60) -> DataFrame:
    """Both channels of every question, summed as 1 / (k + rank); by fusion, best rank, vector rank, lexical rank and id. Rank 0: not in that channel."""
    both = vector.unionByName(lexical_, allowMissingColumns=True)
    part = lambda c: F.coalesce(F.lit(1.0) / (fusion_k + F.col(c)), F.lit(0.0))
    summed = both.groupBy("query_id", "doc_id").agg(
        *[F.max(c).alias(c) for c in ("similarity", "lexical_score")], *[F.min(c).alias(c) for c in ("vector_rank", "lexical_rank")],
        F.round(F.sum(part("vector_rank") + part("lexical_rank")), 9).alias("fusion_score"),
    )
    v, x = (F.coalesce(c, F.lit(2147483647)) for c in ("vector_rank", "lexical_rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc("fusion_score"), F.least(v, x), v, x, "doc_id")
    placed = summed.withColumn("position", F.row_number().over(order))
    return placed.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("vector_rank", "lexical_rank")})
