"""Mixing sources to target weights by systematic sampling.

Inside a source, documents lie in order of size. Each is expected ``target / size of the source`` times, and
the running sum of these expectations plus one random offset emits a document once for each whole number crossed.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cells_for, content, saved, with_rank

WORDS = r"[^\x20\x09-\x0D]+"
MOST_SOURCES = 1_000_000  # totals and rates of sources, not of documents, are handled on the driver


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> dict[str | None, Fraction]:
    """Share the sum of all sizes by weight; no target above ``most`` times its size, the excess shared again."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    rest, out, open_ = Fraction(sum(sizes.values())), {}, set(names)
    while open_:
        unit = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > most * sizes[s]}
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        out |= {s: Fraction(most * sizes[s]) for s in full}
        rest -= sum(out[s] for s in full)
        open_ -= full
    return out


def rates(sizes: dict[str | None, int], weights: tuple[int, ...], most: int, seed: int) -> list[tuple]:
    """(source, size, target, copies of each document with 18 decimals, random offset)."""
    from decimal import Decimal, localcontext

    out = []
    with localcontext() as c:
        c.prec = 60
        for s, t in targets(sizes, weights, most).items():
            copies = t / sizes[s] if sizes[s] else Fraction(0)
            digest = hashlib.sha256(f"{seed}:{'' if s is None else '=' + s}".encode()).digest()
            offset = Decimal(int.from_bytes(digest[:7], "big")) / Decimal(1 << 56)
            fine = Decimal(int(copies * 10**18)) / Decimal(10**18)
            out.append((s, sizes[s], float(t), fine, round(offset, 18) % 1))
    return out


def mix(docs: DataFrame, size, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 17, keep: list[str] | None = None, source_col: str = "source") -> DataFrame:
    """``keep`` columns of every row with source, size, source_size, target, copies, taken.

    ``size`` is a column expression (words of a text). Null sources are one source, the last; null texts have size
    0, and documents of size 0 may be copied but add no words. A source without words has target 0. Sources
    are at most ``MOST_SOURCES``. Equal seeds give equal copies, however the rows are split; repeated rows are sampled one
    by one. An empty table gives no rows.
    """
    keep = keep or []
    # Rows are told apart by all they hold, so the sample does not depend on files or partitions.
    tie = content(docs)[0].alias("tie")
    rows = docs.select(tie, *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(source_col).alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    # Documents of about one size lie together, so that what a source gives is close to its target.
    rows = saved(rows.withColumn("bin", F.floor(F.log2(F.col("size") + 1) * 64).cast("int")))
    totals = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    table = rates({r["source"]: r["size"] for r in totals}, weights, most, seed)
    spark = docs.sparkSession
    table = spark.createDataFrame(table, "s string, source_size long, target double, each decimal(19,18), offset decimal(18,18)")
    ranked = with_rank(rows, ["source"], cells_for(sum(r["n"] for r in totals), 20_000, 16), tie="tie", order=["bin"])
    at = lambda k: F.floor(k.cast("decimal(15,0)") * F.col("each") + F.col("offset")).cast("long")
    mixed = ranked.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", at(F.col("rank") + 1) - at(F.col("rank")))
    return mixed.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def words(text_col: str = "text"):
    """Number of words of a whole text; null for null."""
    return F.regexp_count(F.col(text_col), F.lit(WORDS))
