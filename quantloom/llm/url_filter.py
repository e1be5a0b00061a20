"""URL filters: dated list entries become validity intervals, and an as-of join evaluates every capture.

An entry (pattern, kind, action, since) holds from its date until the next entry for the same pattern and kind; action
``block`` or ``allow`` sets a verdict and ``lift`` ends the entry. Kinds are ``domain`` (a host and all below it) and
``prefix`` (host and path up to a segment). The most specific entry in force decides, ``allow`` before ``block``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_from, saved, saved_rows, small_table

PREFIX = 1 << 30  # any prefix is more specific than any domain
KEYS = 1 << 16  # hash ranges by which probes are counted


def host(url: Column) -> Column:
    """Lower-case host without user, port and final dots; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*?)\.*(?::[0-9]*)?(?:[/?#]|$)", 1))


def path(url: Column) -> Column:
    """Path without query, fragment and final slashes."""
    return F.rtrim(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1), F.lit("/"))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, kind, action, since, until): until is null for the last entry; repeated entries count once.

    Entries with a null pattern, kind, action or date are void. Two on one date: ``allow`` comes last and wins. An entry that
    repeats the action before it goes on with its interval, so a list that is published every day has no more intervals than changes.
    """
    rank = F.expr("CASE action WHEN 'lift' THEN 0 WHEN 'block' THEN 1 ELSE 2 END")
    e = entries.select("pattern", "kind", "action", "since").dropna().withColumn("strength", rank)
    e = e.groupBy("pattern", "kind", "since").agg(F.max_by("action", "strength").alias("action"))
    nth = Window.partitionBy("pattern", "kind").orderBy("since")
    e = e.withColumn("before", F.lag("action").over(nth)).where("before IS NULL OR before <> action").drop("before")
    return e.withColumn("until", F.lead("since").over(nth)).where("action <> 'lift'")


def probes(url: Column, most_labels: int, most_parts: int) -> Column:
    """Keys under which entries for a URL can stand, with their specificity.

    Suffixes of the host of up to ``most_labels`` labels, and prefixes of up to ``most_parts`` parts between slashes, the
    host counted: as many as the longest patterns of the list have, so no entry is missed.
    """
    labels = F.split(host(url), r"\.")
    n = F.size(labels)
    domain = F.transform(
        F.sequence(F.lit(1), F.least(n, F.lit(most_labels))),
        lambda k: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, n - k + 1, k), ".").alias("pattern"), k.alias("rank")),
    )
    parts = F.split(path(url), "/")
    prefix = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(most_parts))),
        lambda k: F.struct(F.lit("prefix").alias("kind"), F.concat(host(url), F.array_join(F.slice(parts, F.lit(1), k), "/")).alias("pattern"), (k + PREFIX).alias("rank")),
    )
    return F.concat(domain, prefix)


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", at_col: str = "fetched") -> DataFrame:
    """(id, url, host, fetched, pattern, kind, action) for every capture; action ``none`` where no entry holds.

    Every capture has a written number, by which its hits are aggregated. Keys that many captures probe are dealt into parts
    by that number, as many as their load asks for, and their entries go to every part. Null URLs and times match nothing. Repeated captures
    come out as often as they came in; other columns, whatever their names, are not read; without captures there are no rows, and
    without entries every action is ``none``.
    """
    c = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(at_col).alias("fetched"))
    c = saved_rows(c, "at")
    held = saved(intervals(entries))
    longest = held.groupBy().agg(*[F.max(F.when(F.col("kind") == k, F.size(F.split("pattern", by)))) for k, by in (("domain", r"\."), ("prefix", "/"))]).first()
    key = F.pmod(F.xxhash64("kind", "pattern"), F.lit(KEYS)).cast("int").alias("key")
    probe = c.select("at", "fetched", F.explode(probes(F.col("url"), *[n or 1 for n in longest])).alias("p")).select("at", "fetched", "p.*")
    probe, held = probe.select("*", key), held.select("*", key)
    # At most KEYS counts reach the driver, and fewer than MOST_HOT of them can be hot.
    load = {r["key"]: r["n"] for r in probe.groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = hot_from(sum(load.values()))
    parts = F.broadcast(small_table(c.sparkSession, [(k, -(-n // most)) for k, n in load.items() if n > most], "key int, parts int"))
    one = F.coalesce("parts", F.lit(1))
    probe = probe.join(parts, "key", "left").withColumn("part", F.pmod(F.xxhash64("at"), one).cast("int")).drop("parts")
    held = held.join(parts, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), one - 1))).drop("parts")
    hit = probe.join(held, ["kind", "pattern", "key", "part"]).where((F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
    best = hit.groupBy("at").agg(F.max(F.struct("rank", (F.col("action") == "allow").alias("a"), "pattern", "kind", "action")).alias("b"))
    return c.join(best, "at", "left").select(
        "id", "url", host(F.col("url")).alias("host"), "fetched", F.col("b.pattern").alias("pattern"), F.col("b.kind").alias("kind"), F.coalesce("b.action", F.lit("none")).alias("action")
    )
