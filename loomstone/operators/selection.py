"""Selection above retrieval: neighbours under a budget, and the pages that an answer may be drawn from.

Every query has at most some twenty candidates, so what is gathered for one is bounded; chunks meet anchors by document and page,
never by document alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions import text as tx
from loomstone.operators import evidence


@dataclass(frozen=True)
class Bounds:
    """How far around the anchors to look, and how much to take with them."""

    radius: int = 1
    chunks: int = 30
    pages: int = 12
    tokens: int = 8192


def _numbered(df: DataFrame, name: str, by: list[str], *order: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def expand(anchors: DataFrame, chunks: DataFrame, bounds: Bounds) -> DataFrame:
    """Neighbours of every query's anchors (query_id, ordinal, chunk, document, page, tokens) that the bounds, anchors included, leave room for.

    The nearest page first, then the earlier anchor; what would open a page or spend tokens too many is passed over.  A query
    whose anchors exceed the bounds gets none, nor does a chunk of null document or page.
    """
    pages = F.collect_set(F.struct("document", "page"))
    held = anchors.groupBy("query_id").agg(F.count("*").alias("taken"), F.sum("tokens").cast("long").alias("used"), pages.alias("pages"))
    held = held.where((F.col("taken") <= bounds.chunks) & (F.size("pages") <= bounds.pages) & (F.col("used") < bounds.tokens))
    held = held.select("query_id", "taken", "pages", (F.lit(bounds.tokens) - F.col("used")).alias("room"))

    around = F.explode(F.sequence(F.col("page") - bounds.radius, F.col("page") + bounds.radius)).alias("page")
    reach = anchors.join(held.select("query_id", "room"), "query_id").select("query_id", "room", "ordinal", F.col("chunk").alias("anchor"), F.col("page").alias("anchor_page"), "document", around)
    near = reach.join(chunks.select("document", "page", "chunk", F.col("tokens").cast("long").alias("tokens")), ["document", "page"]).where("tokens <= room")
    near = near.join(anchors.select("query_id", "chunk"), ["query_id", "chunk"], "left_anti")
    best = F.min(F.struct(F.abs(F.col("page") - F.col("anchor_page")).alias("distance"), "ordinal", "anchor", "document", "page", "tokens"))
    near = near.groupBy("query_id", "chunk").agg(best.alias("b")).select("query_id", "chunk", "b.*")
    near = _numbered(near, "n", ["query_id"], "distance", "ordinal", "page", "chunk").join(held, "query_id").where(F.col("n") <= bounds.chunks - F.col("taken"))

    fields = ["n", "chunk", "anchor", "distance", "document", "page", "tokens"]
    lists = near.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("near"), F.first("pages").alias("pages"), F.first("room").alias("room"))

    def take(state: Column, x: Column) -> Column:
        page = F.struct(x["document"].alias("document"), x["page"].alias("page"))
        known = F.array_contains(state["pages"], page)
        fits = (known | (F.size(state["pages"]) < bounds.pages)) & (x["tokens"] <= state["room"])
        return F.struct(
            F.when(fits & ~known, F.array_append(state["pages"], page)).otherwise(state["pages"]).alias("pages"),
            F.when(fits, state["room"] - x["tokens"]).otherwise(state["room"]).alias("room"),
            F.when(fits, F.array_append(state["kept"], x["n"])).otherwise(state["kept"]).alias("kept"),
        )

    start = F.struct("pages", "room", F.array().cast("array<int>").alias("kept"))
    kept = F.aggregate("near", start, take, lambda s: s["kept"])
    walked = lists.select("query_id", "near", kept.alias("kept"))
    chosen = walked.select("query_id", F.posexplode(F.filter("near", lambda x: F.array_contains(F.col("kept"), x["n"]))).alias("at", "x"))
    return chosen.select("query_id", (F.col("at") + 1).alias("place"), *[F.col(f"x.{f}").alias(f) for f in fields[1:]])


def candidate_pool(ranked: DataFrame, chunks: DataFrame, pages: DataFrame, most: int = 4, among: int = 20, leads: int = 4, bounds: Bounds = Bounds(radius=2)) -> DataFrame:
    """Per query the ``most`` windows of current pages that hold most of its words, before any final choice.

    ``ranked`` has query_id, rank, chunk, document, page, tokens, fusion_score and question; ``pages`` has document, page and text.
    Anchors are the first candidates of different pages; anchors, their neighbours and the other candidates name the pages.
    Where one of these can't be read, is blank, or all exceed the tokens, the query has no pool: nothing was found out then.
    """
    initial = ranked.where(F.col("rank") <= among)
    first = _numbered(initial, "n", ["query_id", "document", "page"], "rank").where("n = 1").drop("n")
    anchors = _numbered(first, "ordinal", ["query_id"], "rank").where(F.col("ordinal") <= leads)
    fields = ["chunk", "document", "page", "tokens"]
    named = lambda df, turn, place, score: df.select("query_id", F.lit(turn).alias("turn"), F.col(place).alias("place"), *fields, score.alias("fusion_score"))
    every = named(anchors, 0, "ordinal", F.col("fusion_score")).unionByName(named(expand(anchors, chunks, bounds), 1, "place", F.lit(0.0))).unionByName(named(initial, 2, "rank", F.col("fusion_score")))
    alone = _numbered(every.where("tokens > 0"), "n", ["query_id", "document", "page"], "turn", "place").where("n = 1")
    chosen = _numbered(alone, "rank", ["query_id"], "turn", "place").where(F.col("rank") <= bounds.pages)

    asked = initial.groupBy("query_id").agg(F.min("question").alias("question"))
    read = chosen.join(pages.select("document", "page", "text"), ["document", "page"], "left").join(asked, "query_id")
    whole = Window.partitionBy("query_id")
    legible = F.min(F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))).over(whole)
    spent = F.sum(tx.token_estimate(F.col("text"))).over(whole)
    read = read.withColumn("legible", legible).withColumn("spent", spent).where(F.col("legible") & (F.col("spent") <= bounds.tokens))
    read = read.withColumn("terms", tx.navigation_terms(F.col("question")))

    found = evidence.excerpts(read).select("query_id", "rank", "start_offset", "end_offset", "quote").join(read.select("query_id", "rank", "chunk", "document", "page", "fusion_score", "terms"), ["query_id", "rank"])
    scored = found.withColumn("cue_hits", F.size(F.array_intersect(tx.navigation_terms(F.col("quote")), "terms"))).withColumn("score", F.greatest(F.lit(0.0), "fusion_score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("cue_hits"), F.desc("score"), "rank")
    placed = scored.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)
    return placed.select("query_id", "position", "chunk", "document", "page", "start_offset", "end_offset", "cue_hits", "quote")
