"""SimHash near-duplicate groups through a hierarchical index in Gray order.

Fingerprints within ``distance`` bits agree in all bits of some choice of blocks, so each fingerprint
goes to one group for each choice (the pigeonhole principle; nothing is missed). Inside its groups
a worker sorts fingerprints by their rank in the Gray code, builds a tree whose upper nodes hold the bits that all
fingerprints below share, and drops a whole node once the differences added up on the way to it exceed the distance.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, join_counted, saved

GROUP = 4096  # largest group that one task compares by itself
FANOUT = 8


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles of a whole text; zero without words."""
    import xxhash

    words = text.lower().split()  # for bytes: A-Z and the six ASCII spaces alone
    if not words:
        return 0
    flat, n = b" ".join(words), len(words) - width + 1
    if n < 2:
        return xxhash.xxh64_intdigest(flat, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    ends, digest = (ends[width - 1 :] - 1).tolist(), xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = range(at, min(n, at + (1 << 16)))
        h = np.fromiter((digest(flat[starts[i] : ends[i]], seed) for i in part), np.uint64, len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp): the fingerprint as a signed long; null texts count as empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fps = [fingerprint(x or b"", width, seed) for x in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence: the prefix XOR of its bits."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """A forest over groups of fingerprints that lie one after another, each in Gray order.

    ``levels[0]`` are the fingerprints. A node above has the mask of bits that all below it share, their pattern,
    and as its own part only the bits that its parent has not compared already.
    """

    def __init__(self, codes: np.ndarray, group: np.ndarray):
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        pattern, mask, owner = codes, np.full(len(codes), full), group
        start = np.arange(len(codes) + 1)
        self.pattern, self.own, self.first = [pattern], [], [start]
        masks = [mask]
        while True:
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            if len(heads) == len(owner):
                break
            sizes = np.diff(np.r_[heads, len(owner)])
            place = np.arange(len(owner)) - np.repeat(heads, sizes)
            cut = np.flatnonzero(place % FANOUT == 0)
            base = np.repeat(pattern[cut], np.diff(np.r_[cut, len(owner)]))
            differs = np.bitwise_or.reduceat(pattern ^ base, cut)
            mask = np.bitwise_and.reduceat(mask, cut) & ~differs
            pattern, owner = pattern[cut] & mask, owner[cut]
            masks.append(mask)
            self.pattern.append(pattern)
            self.first.append(np.r_[cut, len(place)])
        for k, m in enumerate(masks):
            if k + 1 < len(masks):
                m = m & ~np.repeat(masks[k + 1], np.diff(self.first[k + 1]))
            self.own.append(m)
        self.root = np.repeat(np.arange(len(owner)), np.diff(np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(codes)]))
        last = np.arange(len(codes))
        self.least = [last]
        for first in self.first[1:]:
            last = last[first[:-1]]
            self.least.append(last)

    def pairs(self, query: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """(i, j), j < i: fingerprints of one group within the distance, for i in ``query``."""
        codes, node = self.pattern[0], self.root[query]
        top = len(self.pattern) - 1
        sums = np.bitwise_count((codes[query] ^ self.pattern[top][node]) & self.own[top][node]).astype(np.int16)
        for level in range(top, -1, -1):
            keep = (sums <= distance) & (self.least[level][node] < query)
            query, node, sums = query[keep], node[keep], sums[keep]
            if not level:
                break
            first = self.first[level]
            many = first[node + 1] - first[node]
            query, sums = np.repeat(query, many), np.repeat(sums, many)
            ends = np.cumsum(many)
            node = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many, many) + np.repeat(first[node], many)
            sums = sums + np.bitwise_count((codes[query] ^ self.pattern[level - 1][node]) & self.own[level - 1][node])
        return query, node


def linked(codes: np.ndarray, group: np.ndarray, distance: int) -> np.ndarray:
    """For each fingerprint the position of the first one that it is connected to inside its group."""
    index, label = GrayIndex(codes, group), np.arange(len(codes))
    heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[heads, len(codes)])
    work = np.cumsum(np.repeat(sizes, sizes))
    bounds = np.unique(np.r_[0, np.searchsorted(work, np.arange(2_000_000, work[-1] + 2_000_000, 2_000_000)), len(codes)])
    for a, b in itertools.pairwise(bounds.tolist()):
        i, j = index.pairs(np.arange(a, min(b, len(codes))), distance)
        while len(i):
            low = np.minimum(label[i], label[j])
            differ = label[i] != label[j]
            if not differ.any():
                break
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            while (label[label] != label).any():
                label = label[label]
    return label


def search(batches: Iterable[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links that span the connected fingerprints of each group; groups come one after another."""
    names, waiting, rows = ["a", "b"], [], 0

    def flush(part: pa.Table) -> pa.RecordBatch:
        codes = part.column("fp").to_numpy().view(np.uint64)
        keys = np.stack([part.column(c).to_numpy() for c in ("choice", "key", "cell_a", "cell_b")])
        group = np.r_[0, np.cumsum((keys[:, 1:] != keys[:, :-1]).any(0))]
        order = np.lexsort((gray_rank(codes), group))
        codes = codes[order]
        label = linked(codes, group[order], distance)
        tied = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(codes[x].view(np.int64)) for x in (tied, label[tied])], names=names)

    for batch in batches:
        waiting.append(batch)
        rows += batch.num_rows
        if rows < 100_000:
            continue
        part = pa.Table.from_batches(waiting)
        keys = np.stack([part.column(c).to_numpy() for c in ("choice", "key", "cell_a", "cell_b")])
        same = np.flatnonzero((keys != keys[:, -1:]).any(0))
        done = int(same[-1]) + 1 if len(same) else 0  # the last group may go on
        if done:
            yield flush(part.slice(0, done))
        rest = part.slice(done).combine_chunks()
        waiting, rows = rest.to_batches(), rest.num_rows
    if rows:
        yield flush(pa.Table.from_batches(waiting))


def choices(distance: int, blocks: int) -> list[int]:
    """Masks of which one agrees for any two fingerprints within the distance: all but ``distance`` blocks."""
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(cuts)]
    return [sum(x) for x in itertools.combinations(block, blocks - distance)]


def links(codes: DataFrame, rows: int, distance: int = 4) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints ``fp`` within the distance.

    More and smaller blocks are taken as the table grows, so that evenly spread groups stay under ``GROUP``. A larger
    group is dealt by hash into cells, one for each two of its parts, so every two of its members still meet.
    """
    extra = next((k for k in range(1, 5) if rows / 2 ** (64 * k / (distance + k)) < GROUP / 2), 5)
    masks = [m - (1 << 64) if m >> 63 else m for m in choices(distance, distance + extra)]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])).alias("x")
    keyed = codes.select("fp", each).select("fp", "x.choice", "x.key")
    large = saved(keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP))
    plain = F.lit(0).cast("int")
    if large.isEmpty():
        dealt = keyed.withColumn("cell_a", plain).withColumn("cell_b", plain)
    else:
        parts = F.ceil(F.col("n") / (GROUP // 2)).cast("int")
        own = F.pmod(F.xxhash64("fp"), "parts").cast("int")
        dealt = (
            keyed.join(large, ["choice", "key"], "left")
            .withColumn("parts", F.coalesce(parts, F.lit(1)))
            .withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("fp", "choice", "key", F.least("own", "other").alias("cell_a"), F.greatest("own", "other").alias("cell_b"))
        )
    keys = ["choice", "key", "cell_a", "cell_b"]
    found = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda batches: search(batches, distance), "a long, b long")
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots: large-star and small-star by turns.

    A round links larger neighbours and then smaller ones to the least neighbour. Minima are
    aggregated before they are shuffled, nodes with very many links get theirs by broadcast, and every round is written to the shared folder.
    """
    edges = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    digest, total = None, edges.count()
    degree = F.count(F.lit(1)).alias("n")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), degree).select("a", F.least("a", "m").alias("m"), "n")
        large = join_counted(both, least, "a", "n", 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Large-star never adds links, so ``total`` bounds these too.
        low = large.groupBy("a").agg(F.min("b").alias("m"), degree)
        small = join_counted(large, low, "a", "n", total)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = saved(small)
        state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_saved(edges)
        edges, total = new, state[0]
        if state == digest:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        digest = state


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, width: int = 4) -> DataFrame:
    """(id, fp, component): every document, its fingerprint and the least id of its group.

    Equal fingerprints make one class before any search, so copies are never paired with each other. Null, empty and
    blank texts have fingerprint zero and are linked like any other. Null ids stay as rows and never name
    a group that has another id; repeated rows come out once each; an empty table gives no rows.
    """
    prints = saved(fingerprints(docs, id_col, text_col, width))
    classes = saved(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    distinct, rows = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    roots = components(links(classes.select("fp"), distinct, distance))
    member = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    named = member.groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("many"))
    member = join_counted(member.select("fp", "n", "root"), named, "root", "many", distinct).select("fp", "n", "component")
    # Copies share a fingerprint, and it may be that of a third of all rows.
    return join_counted(prints, member, "fp", "n", rows).select("id", "fp", "component")
