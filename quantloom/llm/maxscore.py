"""Exact top-k by inner product with MaxScore over dense integer postings.

The terms of a query are its dimensions. In a shard each dimension is a posting list over all vectors, with the least and the largest value
in it, which bound what the term can add to a score. Terms whose joint bound cannot lift a vector over the current
threshold are non-essential: only the others are traversed, and the non-essential ones are probed, strongest first, for
those vectors that can still compete. The results of all shards are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import LAST, best, meetings, numbered

SHARD, LEAST = 65_536, 4096  # most and least vectors of a shard, but for what a hash deals unevenly
FOUND = "q_uid long, query_id long, uid long, vec_id long, score long"


class Shard:
    """Postings of one shard, by dimension, with their bounds."""

    def __init__(self, ids: np.ndarray, uids: np.ndarray, vecs: np.ndarray, k: int):
        self.k = k
        order = np.argsort(ids, kind="stable")
        self.ids, self.uids = ids[order], uids[order]
        self.postings = np.ascontiguousarray(vecs[order].T)
        self.low, self.high = self.postings.min(1), self.postings.max(1)
        self.norm = float(np.abs(self.postings).max(initial=0))
        self.small = self.postings.astype(np.float32)

    def top(self, q: np.ndarray, uid: int, k: int, seed: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the ``k`` best vectors but the query's own row."""
        size = len(q) * self.norm * float(np.abs(q).max(initial=0))
        if size >= 1 << 53:
            return self._wide(q, uid, k)
        # Sums of whole numbers below 2^24 are exact in single precision too.
        if size < 1 << 24:
            q, postings = q.astype(np.float32), self.small
        else:
            postings = self.postings
        bound = np.maximum(q.astype(np.float64) * self.low, q.astype(np.float64) * self.high)
        terms = np.argsort(-np.abs(q) * (self.high - self.low), kind="stable")
        n = len(self.ids)
        # The first vectors, in full, give the threshold that the others have to reach.
        head = min(n, seed)
        score = q @ postings[:, :head]
        score[self.uids[:head] == uid] = -np.inf
        place = best(score, self.ids[:head], k)
        score = score[place]
        if n > head:
            enough = len(place) == k
            floor = float(score[-1]) if enough else -np.inf
            rest = np.r_[np.cumsum(bound[terms][::-1])[::-1], 0.0]  # what the terms from here on can add at most
            strongest = np.abs(q[terms])
            # Non-essential: the weakest terms, which together cannot reach the threshold.
            split = len(terms) if not enough else int(np.searchsorted(-rest, -max(floor, 0.0)))
            split = max(1, min(len(terms), split))
            lead = terms[:split]
            part = q[lead] @ postings[lead, head:]
            alive = np.flatnonzero(part + rest[split] >= floor)
            part = part[alive]
            for at in range(split, len(terms), 8):
                if not len(alive) or not strongest[at]:
                    break
                step = terms[at : at + 8]
                part = part + q[step] @ postings[np.ix_(step, alive + head)]
                fits = part + rest[min(at + 8, len(terms))] >= floor
                alive, part = alive[fits], part[fits]
            part = np.where(self.uids[alive + head] == uid, -np.inf, part)
            place, score = np.r_[place, alive + head], np.r_[score, part]
            keep = best(score, self.ids[place], k)
            place, score = place[keep], score[keep]
        real = score > -np.inf
        return place[real], score[real]

    def _wide(self, q: np.ndarray, uid: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Components too large for exact doubles: whole numbers without bound, then cut to the range of a long."""
        whole = [int(x) for x in q]
        scores = [max(-(1 << 63), min((1 << 63) - 1, sum(a * int(b) for a, b in zip(whole, v, strict=True)))) for v in self.postings.T]
        place = sorted((i for i in range(len(self.ids)) if self.uids[i] != uid), key=lambda i: (-scores[i], self.ids[i]))[:k]
        return np.array(place, np.int64), np.array([scores[i] for i in place], object)

    def ask(self, ids: np.ndarray, uids: np.ndarray, vecs: np.ndarray) -> pa.RecordBatch:
        """At most ``k`` rows for each query."""
        cols: list[list] = [[], [], [], [], []]
        for qid, uid, q in zip(ids.tolist(), uids.tolist(), vecs, strict=True):
            place, score = self.top(q, uid, self.k)
            cols[0] += [uid] * len(place)
            cols[1] += [qid] * len(place)
            cols[2] += self.uids[place].tolist()
            cols[3] += self.ids[place].tolist()
            cols[4] += [int(s) for s in score]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["q_uid", "query_id", "uid", "vec_id", "score"])


def top_k(vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows for each row whose id is divisible by ``every``.

    Components are floor(scale * x). Null, empty, odd-length and non-finite vectors take no part; null ids are
    candidates and lose all ties, but are no queries. A query's own row is left out, a copy of it is not; each copy of a
    query row is a query. Scores beyond a long are cut to its range. An empty table gives no rows.
    """
    rows = numbered(vectors, id_col, vec_col).withColumn("vec", F.transform("vec", lambda x: F.floor(x.cast("double") * scale).cast("double")))
    n = rows.count()
    # One shard for each task at first; more where they would grow too large.
    shards = max(1, -(-n // SHARD), min(-(-n // LEAST), vectors.sparkSession.sparkContext.defaultParallelism))
    dealt = rows.withColumn("cell", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int"))
    # A stated query set against all rows: each query goes to every shard once.
    asked = rows.where(F.col("id") % every == 0).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = meetings(dealt, asked, shards, lambda _, ids, uids, vecs: Shard(ids, uids, vecs, k), FOUND)
    nth = Window.partitionBy("q_uid").orderBy(F.desc("score"), "vec_id", "uid")
    ranked = found.withColumn("rank", F.row_number().over(nth)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("vec_id") != LAST, F.col("vec_id")).alias("vec_id"), "score")
