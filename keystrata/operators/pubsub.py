"""Publish and subscribe as a join of messages and subscriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.functions.glob import glob_regex
from keystrata.operators.reads import small

MAX_PATTERNS = 100_000


def publish(messages: DataFrame, exact: DataFrame, patterns: DataFrame) -> DataFrame:
    """Deliveries (msg_id, channel, subscriber, kind, pattern) of messages (msg_id, channel).

    `exact` (subscriber, channel) is an equi-join. `patterns` (subscriber, pattern) are globs: they are matched with the distinct channels,
    not with the messages, and only with those that begin as the pattern does; they are broadcast up to MAX_PATTERNS. Repeated subscriptions count once; null
    channels and patterns match nothing. A subscriber gets a message once for each subscription that matches.
    """
    one = messages.select("msg_id", "channel").join(exact.where("channel IS NOT NULL").distinct(), "channel")
    one = one.select("msg_id", "channel", "subscriber", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("pattern"))
    rules = patterns.where("pattern IS NOT NULL").distinct()
    rules = rules.withColumn("regex", glob_regex(F.col("pattern"))).withColumn("head", F.regexp_extract("pattern", r"^([^*?\[]*)", 1))
    lengths = F.broadcast(rules.agg(F.coalesce(F.collect_set(F.char_length("head")), F.array().cast("array<int>")).alias("lengths")))
    channels = messages.select("channel").where("channel IS NOT NULL").distinct()
    # each channel meets the patterns that begin as it does
    begun = channels.crossJoin(lengths).select("channel", F.explode("lengths").alias("n")).where(F.col("n") <= F.char_length("channel")).select("channel", F.expr("left(channel, n)").alias("head"))
    matched = begun.join(F.broadcast(rules) if small(rules, MAX_PATTERNS) else rules, "head").where(F.rlike("channel", F.col("regex"))).drop("regex", "head")
    two = messages.select("msg_id", "channel").join(matched, "channel").select("msg_id", "channel", "subscriber", F.lit("pmessage").alias("kind"), "pattern")
    return one.unionByName(two)


def receivers(messages: DataFrame, exact: DataFrame, patterns: DataFrame) -> DataFrame:
    """PUBLISH's reply: (msg_id, channel, receivers) for every message, 0 where nobody listens."""
    n = publish(messages, exact, patterns).groupBy("msg_id").agg(F.count("*").alias("receivers"))
    return messages.select("msg_id", "channel").join(n, "msg_id", "left").select("msg_id", "channel", F.coalesce("receivers", F.lit(0)).alias("receivers"))
