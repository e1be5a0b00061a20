"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Token counts are integers of at most ``capacity``, so the whole packing problem is described by
one histogram with ``capacity`` counts, however many documents there are. The driver plans on that
histogram; executors only rank the pieces of each length and look their place up in the plan.
"""

from __future__ import annotations

import bisect
import string
import zlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cells_for, saved_rows, with_rank

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Ids(dict):
    """Word -> its token ids as little-endian bytes, filled on demand and emptied when full."""

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model = self.tokenizer.model
        whole = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in whole]
        self.shown = {b: b for b in whole} | {b: 256 + i for i, b in enumerate(rest)}

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        core = text.rstrip(string.punctuation)
        if core != text and core and core[-1].isascii() and core[-1].isalpha() and b"<|" not in word:
            # Letters end where the stops begin, and the stops are one pre-token. Other letters than ASCII ones may end in
            # a combining mark once they are normalised, which goes with the stops.
            out = self[core.encode()] + self[text[len(core) :].encode()]
        elif self.plain and text.isalpha() and (text.isascii() or max(text) < "ƀ") and text.lower() == text:
            # One run of small Latin letters is one pre-token and needs no normalisation.
            if not text.isascii():
                text = word.decode("latin-1").translate(self.shown)
            out = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        else:
            out = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        self[word] = out
        return out

    plain = True


_CACHE: dict[str, _Ids] = {}


def _ids_of(path: str) -> _Ids:
    """One cache for each worker process; the tokenizer must be of the kind that drops white space."""
    if path not in _CACHE:
        cache = _CACHE[path] = _Ids(path)
        probe = "the quick café"
        whole = array("I", cache.tokenizer.encode(probe, add_special_tokens=False).ids).tobytes()
        if b"".join(cache[w] for w in probe.encode().split()) != whole:
            cache.clear()
            cache.plain = False
            if b"".join(cache[w] for w in probe.encode().split()) != whole:
                raise ValueError("tokens of this tokenizer cross white space")
    return _CACHE[path]


def token_bytes(text: bytes, ids: _Ids) -> bytes:
    """Ids of a whole text. White space ends every token, so words are looked up one by one."""
    if b"<|" not in text:  # a special token in lower case must not arise from other text
        text = text.lower()
    return b"".join(map(ids.__getitem__, text.split()))


def tokenise(batches: Iterable[pa.RecordBatch], path: str, capacity: int, last_id: int) -> Iterator[pa.RecordBatch]:
    ids = _ids_of(path)
    end, step = array("I", [last_id]).tobytes(), 4 * capacity
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows: list[tuple] = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                data = token_bytes(text or b"", ids) + end
                for k, s in enumerate(range(0, len(data), step)):
                    cut = data[s : s + step]
                    rows.append((doc_id, k, s // 4, len(cut) // 4, zlib.crc32(cut)))
            if len(ids) > ids.most:
                ids.clear()
            cols = list(zip(*rows, strict=True))
            types = [part.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Pack ``counts`` (length -> pieces) and return (runs, sequences).

    Pieces above a third of the capacity are matched first: the longest with the longest partner that
    still fits, at most two in a sequence. Shorter ones follow in falling length; each goes to the
    sequence with the least room that holds it. Equal pieces move as one block, so the work
    depends on the number of distinct lengths alone.

    A run (length, first, n, per, sequence, offset): pieces of that length with rank first ..
    first + n - 1 go ``per`` to each sequence from ``sequence`` on, from ``offset`` on.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    bins: list[list] = []  # [how many alike, [(length, each), ...], room]
    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        at = bisect.bisect_right(large, capacity - a) - 1
        if at < 0:
            n, inside = left[a], [(a, 1)]
            left[a] = 0
        elif (b := large[at]) == a:
            n, inside = left[a] // 2, [(a, 2)]
            left[a] -= 2 * n
            if left[a] and at:  # the odd one takes the next shorter partner
                n2, b2 = 1, large[at - 1]
                bins.append([n2, [(a, 1), (b2, 1)], capacity - a - b2])
                left[a] -= 1
                left[b2] -= 1
                if not left[b2]:
                    large.remove(b2)
            elif left[a]:
                bins.append([1, [(a, 1)], capacity - a])
                left[a] = 0
        else:
            n, inside = min(left[a], left[b]), [(a, 1), (b, 1)]
            left[a] -= n
            left[b] -= n
            if not left[b]:
                large.remove(b)
        if n:
            bins.append([n, inside, capacity - sum(k * m for k, m in inside)])
        if not left[a]:
            large.remove(a)
    rooms: dict[int, list[list]] = {}
    for x in bins:
        rooms.setdefault(x[2], []).append(x)
    order = sorted(rooms)

    def add(n: int, inside: list, room: int) -> None:
        x = [n, inside, room]
        bins.append(x)
        if room not in rooms:
            bisect.insort(order, room)
            rooms[room] = []
        rooms[room].append(x)

    for s in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        n = left[s]
        while n:
            at = bisect.bisect_left(order, s)
            if at == len(order):
                each = capacity // s
                if n >= each:
                    add(n // each, [(s, each)], capacity - each * s)
                    n %= each
                if n:
                    add(1, [(s, n)], capacity - n * s)
                break
            room = order[at]
            x = rooms[room][-1]
            each = room // s
            full = min(x[0], n // each)
            if full:
                x[0] -= full
                add(full, [*x[1], (s, each)], room - each * s)
                n -= full * each
            if n and x[0] and n < each:
                x[0] -= 1
                add(1, [*x[1], (s, n)], room - n * s)
                n = 0
            if not x[0]:
                rooms[room].remove(x)
                if not rooms[room]:
                    del rooms[room]
                    order.remove(room)
    runs, used, sequence = [], dict.fromkeys(counts, 0), 0
    for many, inside, _ in bins:
        offset = 0
        for k, each in inside if many else []:
            runs.append((k, used[k], many * each, each, sequence, offset))
            used[k] += many * each
            offset += k * each
        sequence += many
    return runs, sequence


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, last_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their place: sequence_id and offset.

    A null or empty text is the closing id alone. Documents of more than ``capacity`` ids are cut; full pieces
    fill a sequence each. Copies, repeated rows and null ids are packed like any other row;
    an empty table gives no rows. Other columns of ``docs`` are not read.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return tokenise(batches, tokenizer, capacity, last_id)

    id_type = docs.schema[id_col].dataType.simpleString()
    pieces = saved_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES.replace("doc_id long", f"doc_id {id_type}")), "at")
    # At most `capacity` rows reach the driver.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = plan(counts, capacity)
    spark = docs.sparkSession
    # The number of runs depends on the distinct lengths, not on the documents.
    table = spark.createDataFrame(runs, "length long, first long, n long, per long, seq long, off long")
    ranked = with_rank(pieces, ["length"], cells_for(sum(counts.values())), tie="at")
    at = F.col("rank") - F.col("first")
    return (
        ranked.join(F.broadcast(table), "length")
        .where((at >= 0) & (at < F.col("n")))
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("seq") + F.floor(at / F.col("per"))).cast("long").alias("sequence_id"),
            (F.col("off") + (at % F.col("per")) * F.col("length")).cast("long").alias("offset"),
        )
    )
