"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few directions, shifted, and put in the order of a Hilbert curve; several such curves
with other directions and shifts bring near vectors close together in some of them. Each order is cut into ranges of about
equal size; a query meets the ranges around its own, and what the curves find is merged and ranked by the true measure.

The measure is the inner product, so a curve sees vectors with one more coordinate, which makes up for their norm: among vectors
of one length the nearest are those with the largest product. Directions are turned principal axes of a bounded sample.

How many curves and ranges a query needs depends on the data. It is measured: a bounded sample of queries is answered
by brute force, and the cheapest number of curves with the least window that finds the stated share of their neighbours
is taken for all, with the better number of projected dimensions. Of the vectors around a query on a later curve those that the first one has shown are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import LAST, best, meetings, numbered

CURVES, DIMS, BITS = 4, (4, 2), 32  # most curves; choices of projected dimensions; bits of a key
BUCKETS = 14  # bits of the key that range bounds are set on
FOUND = "q_uid long, query_id long, uid long, vec_id long, score double"


def hilbert_key(cells: np.ndarray, order: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (n, dims) with ``order`` bits each; dims * order <= 63."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    # Undo the rotations of each level from the top bit down, which leaves the Gray code of the place.
    for bit in range(order - 1, 0, -1):
        one, low = np.int64(1 << bit), np.int64((1 << bit) - 1)
        for d in range(dims):
            up = (x[d] & one) != 0
            swap = np.where(up, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(up, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for bit in range(order - 1, 0, -1):
        turn ^= np.where((x[-1] >> bit) & 1, np.int64((1 << bit) - 1), 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(order - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> bit) & 1)
    return key


def extended(vecs: np.ndarray, long: float, query: bool) -> np.ndarray:
    """Vectors with the coordinate that brings them to length ``long`` (none for longer ones); queries are brought there by scaling."""
    norm = np.linalg.norm(vecs, axis=1, keepdims=True)
    if query:
        return np.hstack([vecs * (long / norm), np.zeros_like(norm)])
    return np.hstack([vecs, np.sqrt(np.maximum(long * long - norm * norm, 0))])


@dataclass
class Curve:
    """Directions, shifts and the quantiles by which projections become even ranks."""

    basis: np.ndarray
    shift: np.ndarray
    quantiles: np.ndarray  # (dims, points)
    long: float

    @property
    def order(self) -> int:
        return BITS // self.basis.shape[1]

    def keys(self, vecs: np.ndarray, query: bool = False) -> np.ndarray:
        z = extended(vecs, self.long, query) @ self.basis
        points = self.quantiles.shape[1]
        part = np.stack([np.interp(z[:, d], self.quantiles[d], np.linspace(0, 1, points)) for d in range(z.shape[1])], 1)
        cells = np.floor((part + self.shift) * ((1 << self.order) - 1) / 2).astype(np.int64)
        return hilbert_key(np.clip(cells, 0, (1 << self.order) - 1), self.order)


def curves_for(sample: np.ndarray, curves: int, dims: int, seed: int = 7) -> list[Curve]:
    """Curves for data like ``sample``. Each has other directions out of the span of the leading principal axes, which hold
    nine tenths of the variance or are the first 2 * ``dims`` at least.
    """
    long = float(np.quantile(np.linalg.norm(sample, axis=1), 0.99)) or 1.0
    x = extended(sample, long, False)
    spread, axes = np.linalg.eigh(np.cov(x.T).reshape(x.shape[1], -1)) if len(x) > 1 else (np.ones(x.shape[1]), np.eye(x.shape[1]))
    spread, axes = np.maximum(spread[::-1], 0), axes[:, ::-1]
    share = np.cumsum(spread) / max(spread.sum(), 1e-300)
    wide = min(len(spread), max(2 * dims, int(np.searchsorted(share, 0.9)) + 1))
    out = []
    for c in range(curves):
        rng = np.random.default_rng([seed, c, dims, wide])
        turn = np.linalg.qr(rng.normal(size=(wide, wide)))[0][:, :dims]
        basis = axes[:, :wide] @ turn
        z = np.sort(x @ basis, 0)
        at = np.linspace(0, len(z) - 1, 257)
        points = np.stack([np.interp(at, np.arange(len(z)), z[:, d]) for d in range(z.shape[1])])
        out.append(Curve(basis, rng.random(basis.shape[1]), points, long))
    return out


class Range:
    """Candidates of one cell of a curve; ``where`` are their ranges on that curve and on the first one."""

    def __init__(self, k: int, ids: np.ndarray, uids: np.ndarray, vecs: np.ndarray, where: np.ndarray | None = None, first: np.ndarray | None = None, reach: int = 0, curve: int = 0):
        order = np.argsort(ids if first is None or not curve else first, kind="stable")
        self.ids, self.uids, self.vecs, self.k, self.reach, self.curve = ids[order], uids[order], vecs[order], k, reach, curve
        self.where, self.first = (None, None) if where is None else (where[order], first[order])

    def ask(self, ids: np.ndarray, uids: np.ndarray, vecs: np.ndarray, where: np.ndarray | None = None, first: np.ndarray | None = None) -> pa.RecordBatch:
        """The ``k`` best for each query among the candidates in its window."""
        cols: list[list] = [[], [], [], [], []]
        order = np.arange(len(ids)) if first is None else np.argsort(first, kind="stable")
        for at in range(0, len(ids), 64):
            some = order[at : at + 64]
            picked = slice(None)
            if self.curve:  # candidates lie in order of the first curve; what every query of the block has met there is passed over
                low, high = np.searchsorted(self.first, [first[some[-1]] - self.reach, first[some[0]] + self.reach + 1])
                if low < high:
                    picked = np.r_[0:low, high : len(self.ids)]
            block, own_ids, own_uids = vecs[some] @ self.vecs[picked].T, self.ids[picked], self.uids[picked]
            if where is not None:
                out = np.abs(where[some][:, None] - self.where[picked][None]) > self.reach
                if self.curve:
                    out |= np.abs(first[some][:, None] - self.first[picked][None]) <= self.reach
                block[out] = -np.inf
            for row, qid, uid in zip(block, ids[some].tolist(), uids[some].tolist(), strict=True):
                row[own_uids == uid] = -np.inf
                place = best(row, own_ids, self.k)
                place = place[row[place] > -np.inf]
                cols[0] += [uid] * len(place)
                cols[1] += [qid] * len(place)
                cols[2] += own_uids[place].tolist()
                cols[3] += own_ids[place].tolist()
                cols[4] += row[place].tolist()
        kinds = [pa.int64()] * 4 + [pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["q_uid", "query_id", "uid", "vec_id", "score"])


def on_curves(rows: DataFrame, curves: list[Curve], query: bool = False) -> DataFrame:
    """(uid, id, vec, keys): each row with its key on every curve."""
    kind = rows.schema["vec"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False)
            vecs = flat.astype(np.float64).reshape(batch.num_rows, -1)
            found = np.stack([c.keys(vecs, query) for c in curves], 1)
            offsets = pa.array(np.arange(0, found.size + 1, len(curves)), pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in ("uid", "id", "vec")], pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))], names=["uid", "id", "vec", "keys"])

    return rows.select("uid", "id", "vec").mapInArrow(run, f"uid long, id long, vec {kind}, keys array<long>")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query over all that curves and cells found; a pair that several found counts once."""
    once = found.groupBy("q_uid", "uid").agg(F.first("query_id").alias("query_id"), F.first("vec_id").alias("vec_id"), F.first("score").alias("score"))
    nth = Window.partitionBy("q_uid").orderBy(F.desc("score"), "vec_id", "uid")
    return once.withColumn("rank", F.row_number().over(nth)).where(F.col("rank") <= k)


class Ranges:
    """Bounds of ranges of about equal numbers of rows on each curve, from bounded counts of key prefixes."""

    def __init__(self, counted: list[tuple[int, int, int]], n: int, parts: int, shift: int):
        self.n, self.parts, self.shift = n, parts, shift
        self.starts: dict[int, list[int]] = {}  # prefix at which each range begins
        self.sizes: dict[int, np.ndarray] = {}
        for c in sorted({c for c, _, _ in counted}):
            of = sorted((b, m) for k, b, m in counted if k == c)
            many = np.array([m for _, m in of])
            place = np.minimum(parts - 1, (np.cumsum(many) - many + many // 2) * parts // n)
            self.sizes[c] = np.bincount(place, weights=many, minlength=parts).astype(np.int64)
            bounds = np.searchsorted(place, np.arange(1, parts))  # the first prefix of range 1, 2, ...
            self.starts[c] = [of[b][0] if b < len(of) else 1 << 62 for b in bounds.tolist()]

    def range_of(self, keys: np.ndarray, curve: int) -> np.ndarray:
        return np.searchsorted(np.array(self.starts[curve]), keys >> self.shift, side="right")


@dataclass
class Layout:
    """Curves in use, the window of a query in ranges to each side, and the cells (runs of ranges, in parts where they are large)."""

    start: int  # the first curve in use
    curves: int
    reach: int
    width: int
    first: list[int]  # number of the first cell of (curve, block of ranges), one after another
    parts: list[int]
    blocks: int
    scored: float  # candidates that a query meets, as a share of all rows

    @property
    def cells(self) -> int:
        return self.first[-1] + self.parts[-1]


def layout(ranges: Ranges, start: int, curves: int, reach: int, largest: int) -> Layout:
    """Cells of about a quarter of a window, but not more than ``largest`` rows; a fuller one is dealt into parts by row number."""
    width = max(1, min(reach // 2, largest * ranges.parts // max(1, ranges.n)))
    blocks = -(-ranges.parts // width)
    parts, first, done = [], [], 0
    for c in range(start, start + curves):
        for b in range(blocks):
            rows = int(ranges.sizes[c][b * width : (b + 1) * width].sum())
            first.append(done)
            parts.append(max(1, -(-rows // (2 * largest))))
            done += parts[-1]
    share = 1 - max(0.0, 1 - (reach + 0.5) / ranges.parts) ** 2  # windows end where the curve does
    return Layout(start, curves, reach, width, first, parts, blocks, share * (1 + (curves - 1) * (1 - share)))


def neighbours(
    vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, recall: float = 0.93, curves: int = CURVES, ranges: int = 256, largest: int = 8192, sample: int = 128
) -> DataFrame:
    """(query_id, rank, vec_id, score): about the ``k`` nearest rows by inner product for each row whose id is divisible by ``every``.

    All usable rows are indexed on every curve in use, 2 to ``curves``. ``recall`` is the share of true neighbours that the windows must
    find for a sample of at most ``sample`` queries. Null, empty, zero, odd-length and non-finite vectors take no part;
    null ids are candidates alone and lose ties. A query's own row is left out, a copy of it is not. Equal
    vectors share a key; cells that they would overfill are dealt into parts by row number, and a query meets all parts. An empty table gives no rows.
    """
    rows = numbered(vectors, id_col, vec_col).where(F.exists("vec", lambda x: x != 0))
    spark, n = vectors.sparkSession, rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    curve_list, ranges_of = indexed(rows, n, curves, ranges)
    plan = layout_for(rows, curve_list, ranges_of, k, every, recall, sample, largest)
    used = curve_list[plan.start : plan.start + plan.curves]
    kind = rows.schema["vec"].dataType.simpleString()

    def deal(query: bool):
        """Rows to their cells, queries to all cells that their windows touch."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, parts = np.array(plan.first), np.array(plan.parts)
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = batch.column("keys").flatten().to_numpy().reshape(batch.num_rows, -1)
                home = ranges_of.range_of(keys[:, 0], plan.start)
                for c in range(plan.curves):
                    at = ranges_of.range_of(keys[:, c], plan.start + c)
                    if query:
                        low, high = np.maximum(0, at - plan.reach) // plan.width, np.minimum(ranges_of.parts - 1, at + plan.reach) // plan.width
                        a, b = first[c * plan.blocks + low], first[c * plan.blocks + high] + parts[c * plan.blocks + high]
                        row = np.repeat(np.arange(len(at)), b - a)
                        cell = np.arange(len(row)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
                    else:
                        block = c * plan.blocks + at // plan.width
                        row, cell = np.arange(len(at)), first[block] + batch.column("uid").to_numpy() % parts[block]
                    for s in range(0, len(row), 4096):
                        part = row[s : s + 4096]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(cell[s : s + 4096].astype(np.int32)), *[batch.column(x).take(pa.array(part)) for x in ("uid", "id", "vec")], pa.array(at[part].astype(np.int32)), pa.array(home[part].astype(np.int32))],
                            names=["cell", "uid", "id", "vec", "at", "home"],
                        )

        return run

    schema = f"cell int, uid long, id long, vec {kind}, at int, home int"
    held = on_curves(rows, used).mapInArrow(deal(False), schema)
    asked = on_curves(rows.where(F.col("id") % every == 0), used, True).mapInArrow(deal(True), schema)
    last = plan.first[plan.blocks] if plan.curves > 1 else plan.cells  # cells from here on are of later curves
    make = lambda cell, ids, uids, vecs, at, home: Range(k, ids, uids, vecs, at, home, plan.reach, int(cell >= last))
    found = meetings(held, asked, plan.cells, make, FOUND, ("at", "home"))
    return ranked(found, k).select("query_id", "rank", F.when(F.col("vec_id") != LAST, F.col("vec_id")).alias("vec_id"), "score")


def indexed(rows: DataFrame, n: int, curves: int, ranges: int, sample: int = 4096) -> tuple[list[Curve], Ranges]:
    """Curves of each choice of dimensions from a sample of about ``sample`` rows, and ranges from counts of all rows: at most curves * 2^BUCKETS of them reach the driver."""
    share = F.pmod(F.xxhash64("uid"), F.lit(1_000_003)) < math.ceil(1_000_003 * min(1.0, sample / n))
    some = np.array([r["vec"] for r in rows.where(share).orderBy("uid").limit(2 * sample).collect() or rows.limit(1).collect()], np.float64)
    found = [c for d in DIMS for c in curves_for(some, curves, d)]
    shift = BITS - BUCKETS
    counted = on_curves(rows, found).select(F.posexplode("keys").alias("curve", "key")).groupBy("curve", F.shiftright("key", shift).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    return found, Ranges([tuple(r) for r in counted], n, min(ranges, 1 << BUCKETS), shift)


def layout_for(rows: DataFrame, curves: list[Curve], ranges: Ranges, k: int, every: int, recall: float, sample: int, largest: int) -> Layout:
    """The dimensions, the number of curves and the window with the least work among those that find ``recall`` of the true neighbours of a sample of queries."""
    asked = rows.where(F.col("id") % every == 0).orderBy(F.xxhash64("uid")).limit(sample).collect()
    most = len(curves) // len(DIMS)
    least = min(2, most)
    if not asked:
        return layout(ranges, 0, least, 0, largest)
    vecs = np.array([r["vec"] for r in asked], np.float64)
    uids = np.array([r["uid"] for r in asked])
    ids = np.array([r["id"] for r in asked])

    def brute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                flat = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
                own = table.column("id").fill_null(LAST).to_numpy()
                yield Range(k, own, table.column("uid").to_numpy(), flat.astype(np.float64).reshape(batch.num_rows, -1)).ask(ids, uids, vecs)

    # The sample meets every row once; sample * k rows stay.
    true = ranked(rows.select("uid", "id", "vec").mapInArrow(brute, FOUND), k).select("q_uid", "uid").collect()
    if not true:
        return layout(ranges, 0, least, 0, largest)
    small = rows.sparkSession.createDataFrame([(u,) for u in {r["uid"] for r in true}], "uid long")  # sample * k rows at most
    near = {r["uid"]: r["vec"] for r in rows.join(F.broadcast(small), "uid", "left_semi").select("uid", "vec").collect()}
    of = {u: i for i, u in enumerate(near)}
    there, own = np.array(list(near.values()), np.float64), {u: i for i, u in enumerate(uids.tolist())}
    a, b = np.array([own[r["q_uid"]] for r in true]), np.array([of[r["uid"]] for r in true])
    apart = np.stack([np.abs(ranges.range_of(c.keys(vecs, True), i)[a] - ranges.range_of(c.keys(there), i)[b]) for i, c in enumerate(curves)])
    nth = max(0, math.ceil(recall * len(true)) - 1)
    plans = [layout(ranges, at, m, int(np.sort(apart[at : at + m].min(0))[nth]), largest) for at in range(0, len(curves), most) for m in range(least, most + 1)]
    return min(plans, key=lambda p: p.scored)
