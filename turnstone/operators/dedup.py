"""Repeated sources, repeated contents, and rows that were handled before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.functions.hashing import canonical_text, sha256
from turnstone.session import cut_lineage


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of every key by ``order``; keys are reduced before the shuffle, hot ones too."""
    row = F.struct(*df.columns)
    return df.groupBy(F.col(key).alias("__key")).agg(F.min_by(row, F.struct(F.col(order).isNull(), F.col(order), F.xxhash64(key))).alias("r")).select("r.*")


def mark_repeats(df: DataFrame, key: str, order: str, tie: str, flag: str = "is_repeat") -> DataFrame:
    """``df`` with a flag on all rows of a key but its first by ``order`` (nulls last), then ``tie``.

    Rows with the same ``order`` and ``tie`` are deliveries of one item and get one flag. A null key repeats nothing.
    The first is found by aggregation, not by a sort per key; null keys take no part in the join.
    """
    rank = F.struct(F.col(order).isNull(), F.col(order), F.col(tie))
    named = df.filter(F.col(key).isNotNull())
    firsts = named.groupBy(F.col(key).alias("__key")).agg(F.min(rank).alias("__first"))
    flagged = named.join(firsts, F.col(key) == F.col("__key")).withColumn(flag, rank > F.col("__first")).drop("__key", "__first")
    return flagged.unionByName(df.filter(F.col(key).isNull()).withColumn(flag, F.lit(False)))


def content_owner(df: DataFrame, item: str, text: str, order: str) -> DataFrame:
    """``item, content_key, owner, status``: every content belongs to the first item (by ``order``) that has it.

    Later items with the same canonical text (case and white space aside) are POSSIBLE_DUPLICATE_CONTENT. A null text
    has no content and is UNIQUE; such rows take no part in the join. Texts are hashed once, and written without them.
    """
    rows = cut_lineage(df.select(F.col(item), F.col(order).alias("__order"), sha256(canonical_text(text)).alias("content_key")))
    named = rows.filter("content_key IS NOT NULL")
    owners = named.groupBy("content_key").agg(F.min_by(item, F.struct("__order", item)).alias("owner"))
    out = named.join(owners, "content_key")
    status = F.when(F.col("owner") == F.col(item), "UNIQUE").otherwise("POSSIBLE_DUPLICATE_CONTENT")
    nothing = rows.filter("content_key IS NULL").select(item, "content_key", F.col(item).alias("owner"), F.lit("UNIQUE").alias("status"))
    return out.select(item, "content_key", "owner", status.alias("status")).unionByName(nothing)


def not_done(df: DataFrame, done: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Rows whose key was not handled before (all of them with ``force``)."""
    return df if force else df.join(done.select(key).distinct(), key, "left_anti")


def new_only(existing: DataFrame, arriving: DataFrame, key: str, order: str) -> DataFrame:
    """Arriving rows to insert: keys that do not exist yet, each once."""
    return first_seen(arriving, key, order).join(existing.select(key).distinct(), key, "left_anti")


def known_content(df: DataFrame, text: str, known: DataFrame, known_text: str) -> DataFrame:
    """Rows whose canonical text is among the known ones."""
    keys = known.select(sha256(canonical_text(known_text)).alias("__k")).filter("__k IS NOT NULL").distinct()
    return df.withColumn("__c", sha256(canonical_text(text))).join(keys, F.col("__c") == F.col("__k"), "left_semi").drop("__c")
