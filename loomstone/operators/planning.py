"""Planning of generation requests: shares of a target, batches and waves, and the estimate of a whole job.

Chunks of a job stream through a task in their order; a batch or pack is known by a few numbers, never by its texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions import text as tx
from loomstone.operators.chunking import Size

SUMMARY = Size.of("summary ")


@dataclass(frozen=True)
class Limits:
    """Bounds of a request and of a job; ``frame`` is the fixed text around the chunks of a request."""

    cards: int = 10
    input_target: int = 6000
    pack_tokens: int = 6000
    pack_chunks: int = 500
    reserve: int = 416
    summary_tokens: int = 1024
    output_tokens: int = 8192
    refills: int = 2
    job_input: int = 200_000
    job_output: int = 262_144
    frame: Size = Size(600, 600, 120)


def sized(chunks: DataFrame) -> DataFrame:
    """Add the characters, bytes and lexical units of a chunk's text, and of the two line ends ahead of it."""
    text = F.col("text")
    return chunks.withColumns({"chars": F.char_length(text) + 2, "bytes": F.octet_length(text) + 2, "units": F.regexp_count(text, F.lit(tx.UNIT))})


def estimate(chars: Column, size: Column, units: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(chars / 3), F.ceil(size / 4), units).cast("long")


def allocate(chunks: DataFrame, job: str, target: int) -> DataFrame:
    """Add the ``share`` of a job's target that each chunk (chunk_index, page_number, asked, got) is asked for.

    Chunks not asked before come first, one of each page in turn; then those that gave most, of these the least asked.
    """
    turn = F.row_number().over(Window.partitionBy(job, "page_number").orderBy("asked", "chunk_index"))
    seen = F.when(F.col("asked") > 0, 1).otherwise(0)
    place = F.row_number().over(Window.partitionBy(job).orderBy("seen", -F.col("seen") * F.col("got"), F.col("seen") * F.col("asked"), "turn", "page_number"))
    placed = chunks.withColumn("turn", turn).withColumn("seen", seen).withColumn("place", place).withColumn("n", F.count("*").over(Window.partitionBy(job)))
    once = F.when(F.col("place") <= target, 1).otherwise(0)
    more = F.when(F.col("n") < target, F.floor((F.lit(target) - F.col("place")) / F.col("n"))).otherwise(0)
    return placed.withColumn("share", (once + more).cast("int")).drop("turn", "seen", "place", "n")


def batches(wanted: DataFrame, job: list[str], limits: Limits) -> DataFrame:
    """(*job, batch, wave, chunk_index, requested) of every chunk with a share: a request holds so many cards and, unless ``whole``, so many tokens.

    A share that a request can't hold goes on in the next one, which then opens a wave: no two requests of a wave share a chunk.
    """
    cards, ceiling, frame = limits.cards, limits.input_target - limits.reserve, limits.frame

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, batch, wave, held, size, last = None, 0, 0, 0, frame, None
        for part in parts:
            rows = []
            for key, r in zip(zip(*(part[k] for k in job), strict=True), part.itertuples(), strict=True):
                if key != at:
                    at, batch, wave, held, last = key, 0, 0, 0, None
                own, left = Size(r.chars, r.bytes, r.units), r.share
                while left > 0:
                    if held == cards or held and not r.whole and (size + own).tokens > ceiling:
                        held = 0
                    if not held:
                        batch, wave, size = batch + 1, max(1, wave + (last == r.chunk_index)), frame
                    now = min(left, cards - held)
                    held, left, size, last = held + now, left - now, size + own, r.chunk_index
                    rows.append((*key, batch, wave, r.chunk_index, now))
            yield pd.DataFrame(rows, columns=[*job, "batch", "wave", "chunk_index", "requested"])

    ready = wanted.where("share > 0").select(*job, "chunk_index", "share", "chars", "bytes", "units", "whole")
    kinds = ", ".join(f"{k} {dict(ready.dtypes)[k]}" for k in job)
    return ready.repartition(job[0]).sortWithinPartitions(*job, "chunk_index").mapInPandas(run, f"{kinds}, batch int, wave int, chunk_index int, requested int")


def packs(chunks: DataFrame, job: str, limits: Limits) -> DataFrame:
    """Add the ``pack`` of every chunk: a pack closes where the next chunk would exceed its tokens or chunks."""
    most_tokens, most_chunks = limits.pack_tokens, limits.pack_chunks

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, pack, tokens, n = None, 0, 0, 0
        for part in parts:
            found = []
            for key, own in zip(part[job], part["token_count"], strict=True):
                if key != at:
                    at, pack, tokens, n = key, 1, 0, 0
                elif n == most_chunks or tokens + own > most_tokens:
                    pack, tokens, n = pack + 1, 0, 0
                tokens, n = tokens + own, n + 1
                found.append(pack)
            yield part.assign(pack=found)

    kinds = ", ".join(f"{c} {t}" for c, t in chunks.dtypes)
    return chunks.repartition(job).sortWithinPartitions(job, "chunk_index").mapInPandas(run, f"{kinds}, pack int")


def reduce_calls(maps: Column) -> Column:
    """Calls that merge ``maps`` results in eights, level by level; a rest of one costs none."""
    start = F.struct(maps.cast("long").alias("left"), F.lit(0).cast("long").alias("calls"))

    def level(s: Column, _: Column) -> Column:
        calls = F.when(s["left"] > 1, F.floor(s["left"] / 8) + F.when(s["left"] % 8 > 1, 1).otherwise(0)).otherwise(0)
        return F.struct(F.ceil(s["left"] / 8).cast("long").alias("left"), (s["calls"] + calls).cast("long").alias("calls"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(21)), start, level, lambda s: s["calls"])


def preflight(chunks: DataFrame, job: str, target: int, limits: Limits) -> DataFrame:
    """(job, packs, requests, input_tokens, output_tokens, refused) of every job's path on which no card is accepted and every refill is spent.

    ``chunks`` has the job, chunk_index, page_number, text and token_count.  A job of several packs is summarised first, a request
    for each pack and for each merge of eight; a job of one pack is read whole in every request.
    """
    measured = packs(sized(chunks).select(job, "chunk_index", "page_number", "token_count", "chars", "bytes", "units"), job, limits)
    sizes = ("chars", "bytes", "units")
    fixed = {k: F.lit(getattr(limits.frame, k)) for k in sizes}
    summary = {k: F.lit(getattr(SUMMARY, k) * limits.summary_tokens) for k in sizes}
    total = lambda of: [F.sum(k).alias(k) for k in of]
    per_pack = measured.groupBy(job, "pack").agg(*total(sizes)).withColumn("map_input", estimate(*[fixed[k] + F.col(k) for k in sizes]))
    jobs = per_pack.groupBy(job).agg(F.count("*").alias("packs"), F.sum("map_input").alias("map_input"), *[F.sum(k).alias(f"all_{k}") for k in sizes]).withColumn("whole", F.col("packs") == 1)

    state = measured.join(jobs.select(job, "whole"), job).withColumns({"asked": F.lit(0), "got": F.lit(0)})
    rounds = []
    for number in range(limits.refills + 1):
        shared = allocate(state, job, target)
        rounds.append(shared.withColumn("round", F.lit(number)))
        state = shared.withColumn("asked", F.col("asked") + F.col("share")).drop("share")
    wanted = rounds[0]
    for more in rounds[1:]:
        wanted = wanted.unionByName(more)
    cut = batches(wanted, [job, "round"], limits).join(measured.select(job, "chunk_index", *sizes), [job, "chunk_index"])
    requests = cut.groupBy(job, "round", "batch").agg(F.sum("requested").alias("requested"), *total(sizes)).join(jobs, job)
    body = {k: fixed[k] + F.when(F.col("whole"), F.col(f"all_{k}")).otherwise(F.col(k) + summary[k]) for k in sizes}
    output = F.least(F.lit(limits.output_tokens), F.col("requested") * 512 + 256)
    spent = requests.groupBy(job).agg(F.count("*").alias("asks"), F.sum(estimate(*body.values()) + limits.reserve).alias("reads"), F.sum(output).alias("writes"))

    maps = F.when(F.col("whole"), 0).otherwise(F.col("packs"))
    merge = estimate(*[fixed[k] + 8 * summary[k] for k in sizes])
    done = spent.join(jobs, job).withColumn("merges", reduce_calls(maps)).withColumn("summaries", maps + F.col("merges"))
    told = done.select(
        job, "packs", (F.col("summaries") + F.col("asks")).cast("long").alias("requests"),
        (F.when(F.col("whole"), 0).otherwise(F.col("map_input")) + F.col("merges") * merge + F.col("reads")).cast("long").alias("input_tokens"),
        (F.col("summaries") * limits.summary_tokens + F.col("writes")).cast("long").alias("output_tokens"),
    )
    refused = F.when(F.col("input_tokens") > limits.job_input, "ai_input_token_limit").when(F.col("output_tokens") > limits.job_output, "ai_output_token_limit")
    return told.withColumn("refused", F.coalesce(refused, F.lit("")))
