"""An encrypted block store: texts as fixed-size AES-GCM blocks bound to their identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key for examples only; callers bring their own.
DEMO_KEY = "0123456789abcdef"


def _bound(doc: Column, number: Column) -> Column:
    """What authenticates a block: its document and number."""
    return F.concat_ws(":", F.lit("block"), doc.cast("string"), number.cast("string"))


def store(docs: DataFrame, key: str, block_bytes: int) -> DataFrame:
    """(doc_id, block_number, sealed) rows of every document; the nonce is drawn from identity and content."""
    body = F.encode("text", "utf-8")
    count = F.ceil(F.greatest(F.lit(1), F.octet_length("text")) / block_bytes)
    cut = docs.select("doc_id", body.alias("body"), F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("block_number"))
    part = F.substring("body", (F.col("block_number") * block_bytes + 1).cast("int"), F.lit(block_bytes))
    name = _bound(F.col("doc_id"), F.col("block_number"))
    nonce = F.substring(F.unhex(F.sha2(F.concat(F.encode(name, "utf-8"), part), 256)), 1, 12)
    sealed = F.aes_encrypt(part, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), nonce, name)
    return cut.select("doc_id", "block_number", sealed.alias("sealed"))


def read_range(stored: DataFrame, key: str, block_bytes: int, first: int, last: int) -> DataFrame:
    """Bytes ``first`` to ``last`` of every document: only the covering blocks are opened."""
    covering = stored.where(F.col("block_number").between(first // block_bytes, last // block_bytes))
    return _joined(covering, key).select("doc_id", F.substring("body", first % block_bytes + 1, last - first + 1).alias("body"))


def _joined(stored: DataFrame, key: str) -> DataFrame:
    opened = F.try_aes_decrypt("sealed", F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), _bound(F.col("doc_id"), F.col("block_number")))
    rows = stored.select("doc_id", F.struct("block_number", F.hex(opened).alias("part")).alias("b"))
    parts = F.transform(F.sort_array(F.collect_list("b")), lambda x: x["part"])  # the blocks of one document
    return rows.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.unhex(F.array_join(parts, "")).alias("body"))


def verify(stored: DataFrame, key: str) -> DataFrame:
    """What every document reads back as: blocks, hash, bytes and its first characters."""
    whole = _joined(stored, key)
    return whole.select("doc_id", "blocks", F.sha2("body", 256).alias("content_hash"), F.octet_length("body").cast("long").alias("n_bytes"), F.substring(F.decode("body", "utf-8"), 1, 64).alias("head"))
