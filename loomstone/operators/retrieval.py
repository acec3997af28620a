"""Hybrid retrieval: channels, rank fusion, neighbours, budgets and bounded selection."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions import text as tx
from loomstone.functions import vectors as vec
from loomstone.operators import overlap
from loomstone.sources.folders import settle


@dataclass(frozen=True)
class Policy:
    """Bounds and weights of a search."""

    results: int = 5
    candidates: int = 20
    context_tokens: int = 8192
    least_similarity: float = 0.5
    fusion_k: int = 60
    overlap: float = 0.8
    lexical_any: bool = False
    across_documents: bool = False


def term_hits(text: Column, terms: list[str]) -> Column:
    """Occurrences of the terms among the words of a text."""
    return F.size(F.filter(tx.words(text), lambda w: w.isin(*terms))).cast("long")


def lexical_score(hits: Column) -> Column:
    """A cover-density score in 0 to 1 for covers of one word, each of weight 0.1."""
    return hits * F.lit(0.1) / (hits * F.lit(0.1) + 1)


def ranked(df: DataFrame, score: str, key: str, most: int, rank: str) -> DataFrame:
    """The first ``most`` rows by score, ties by key, numbered."""
    order = Window.orderBy(F.desc(score), key)
    return df.orderBy(F.desc(score), key).limit(most).withColumn(rank, F.row_number().over(order))


def vector_channel(chunks: DataFrame, query: list[float], policy: Policy) -> DataFrame:
    wanted = F.array(*[F.lit(float(x)) for x in query]).cast("array<double>")
    scored = chunks.where(F.lit(bool(query))).select("doc_id", F.round(vec.cosine(F.col("embedding"), wanted), 6).alias("similarity"))
    return ranked(scored.where(F.col("similarity") >= policy.least_similarity), "similarity", "doc_id", policy.candidates, "vector_rank")


def lexical_channel(chunks: DataFrame, terms: list[str], policy: Policy) -> DataFrame:
    found = F.filter(tx.words(F.col("text")), lambda w: w.isin(*terms))  # the words are taken out once
    hits = F.when(F.lit(policy.lexical_any) | (F.size(F.array_distinct(found)) == len(set(terms))), F.size(found)).otherwise(0).cast("long")
    counted = chunks.select("doc_id", hits.alias("hits")).where("hits > 0")
    scored = counted.select("doc_id", F.round(lexical_score(F.col("hits")), 9).alias("lexical_score"))
    return ranked(scored, "lexical_score", "doc_id", policy.candidates, "lexical_rank")


def fuse(vector: DataFrame, lexical: DataFrame, policy: Policy) -> DataFrame:
    """Union both channels, sum 1 / (k + rank) and order by fusion, best rank, vector rank, lexical rank and id; rank 0: not in that channel."""
    both = vector.unionByName(lexical, allowMissingColumns=True)
    part = lambda c: F.when(F.col(c).isNotNull(), F.lit(1.0) / (policy.fusion_k + F.col(c))).otherwise(0.0)
    fused = both.groupBy("doc_id").agg(
        F.max("similarity").alias("similarity"),
        F.max("lexical_score").alias("lexical_score"),
        F.min("vector_rank").alias("vector_rank"),
        F.min("lexical_rank").alias("lexical_rank"),
        F.round(F.sum(part("vector_rank") + part("lexical_rank")), 9).alias("fusion_score"),
    )
    last = F.lit(2147483647)
    v, x = F.coalesce("vector_rank", last), F.coalesce("lexical_rank", last)
    order = [F.desc_nulls_last("fusion_score"), F.least(v, x), v, x, F.col("doc_id")]
    placed = fused.withColumn("position", F.row_number().over(Window.orderBy(*order)))  # at most two channels of candidates
    return placed.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("vector_rank", "lexical_rank")})


def hybrid(chunks: DataFrame, query: list[float], terms: list[str], policy: Policy) -> DataFrame:
    """Exact vector and lexical top-k, fused by reciprocal rank."""
    return fuse(vector_channel(chunks, query, policy), lexical_channel(chunks, terms, policy), policy)


def best_per_page(chunks: DataFrame, terms: list[str], most: int) -> DataFrame:
    """The best chunk score of every page, best pages first."""
    hits = term_hits(F.concat_ws(" ", "section", "text"), terms)
    scored = chunks.withColumn("hits", hits).where("hits > 0")
    paged = scored.groupBy("document", "page").agg(F.round(F.max(lexical_score(F.col("hits"))), 9).alias("page_rank"))
    return ranked(paged, "page_rank", "page", most, "position")


def neighbours(anchors: DataFrame, chunks: DataFrame, radius: int) -> DataFrame:
    """Chunks of an anchor's document within ``radius`` pages, each with its nearest anchor; anchors themselves left out."""
    a = anchors.select(F.col("document"), F.col("page").alias("anchor_page"), F.col("chunk").alias("anchor"), F.col("ordinal"))
    near = chunks.join(a, "document").where(F.abs(F.col("page") - F.col("anchor_page")) <= radius)
    near = near.join(anchors.select("chunk"), "chunk", "left_anti").withColumn("distance", F.abs(F.col("page") - F.col("anchor_page")))
    best = Window.partitionBy("chunk").orderBy("distance", "ordinal", "anchor")
    return near.withColumn("n", F.row_number().over(best)).where("n = 1").select("document", "page", "chunk", "anchor", "ordinal", "distance")


def prefix_budget(pages: DataFrame, by: list[str], order: list[str], most_pages: int, most_tokens: int) -> DataFrame:
    """Pages in order while their count and running tokens stay inside the budget; stops at the first that doesn't."""
    w = Window.partitionBy(*by).orderBy(*order)
    run = pages.withColumn("page_rank", F.row_number().over(w)).withColumn("running_tokens", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.where((F.col("page_rank") <= most_pages) & (F.col("running_tokens") <= most_tokens))


def select_bounded(candidates: DataFrame, policy: Policy) -> DataFrame:
    """Per query, in rank order: skip what doesn't fit the token budget or overlaps a kept candidate, until enough are kept.

    Needs query_id, rank, chunk, document, page, text and tokens; a query has at most two channels of candidates.
    """
    limit, budget, overlap, across = policy.results, policy.context_tokens, policy.overlap, policy.across_documents

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple] = []
        used, rows = 0, []
        for row in group.sort_values(["rank", "chunk"]).itertuples():
            if not 0 < row.tokens <= budget - used:
                continue
            words, whole = frozenset(row.words), " ".join(row.folded.split())
            place = None if across else (row.document, row.page)
            if any(place == p and (whole == t or words and w and len(words & w) >= overlap * min(len(words), len(w))) for p, w, t in kept):
                continue
            kept.append((place, words, whole))
            used += row.tokens
            rows.append((row.query_id, row.chunk, len(rows) + 1, row.tokens, used))
            if len(rows) == limit:
                break
        return pd.DataFrame(rows, columns=["query_id", "chunk", "position", "tokens", "used_tokens"])

    ready = candidates.select("query_id", "rank", "chunk", "document", "page", "tokens", tx.fold(F.col("text")).alias("folded"), tx.terms(F.col("text")).alias("words"))
    return ready.groupBy("query_id").applyInPandas(pick, "query_id long, chunk long, position int, tokens long, used_tokens long")


def word_sets(items: DataFrame, key: str, by: list[str], text: str) -> DataFrame:
    """(id, *by, words): the sorted word set of every text."""
    return items.select(F.col(key).alias("id"), *by, F.array_sort(tx.terms(F.coalesce(F.col(text), F.lit("")))).alias("words"))


def word_classes(sets: DataFrame, by: list[str]) -> DataFrame:
    """(id, class_id): the smallest id with the same word set under the same ``by``; sets are told by their digests."""
    told = sets.select("id", *by, F.sha2(F.array_join("words", " "), 256).alias("digest"))
    first = told.groupBy(*by, "digest").agg(F.min("id").alias("class_id")).withColumnsRenamed({c: f"of_{c}" for c in (*by, "digest")})
    return told.join(first, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in (*by, "digest")]).select("id", "class_id")


def similar_sets(items: DataFrame, key: str, by: list[str], text: str, least: float, contained: bool = False) -> DataFrame:
    """One row per text: its class of equal word sets and the number of other classes, under the same ``by``, that are similar to it.

    Similar means that the common words are ``least`` of the union, or (``contained``) of the smaller set.  Classes meet in
    tiles (operators.overlap), which return counts: no pair and no candidate is ever shuffled.
    """
    sets = word_sets(items, key, by, text)
    every = settle(word_classes(sets, by), "classes")
    firsts = every.where("id = class_id").select("id")
    reps = sets.where("size(words) > 0").join(firsts, "id", "left_semi").withColumn("n", F.size("words")).dropna(subset=by)
    links = overlap.links(settle(reps, "sets"), by, least, contained)
    return every.join(links, "class_id", "left").select(F.col("id").alias(key), "class_id", F.coalesce("links", F.lit(0).cast("long")).alias("links"))
