"""Vectors in blocks, for searches of a stated query set against all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved_rows

LAST = (1 << 63) - 1  # stands for a null id, behind all others
MOST_TASKS = 20_000


def usable(vec_col: str):
    """Not null, not empty, no null and no non-finite component."""
    v = F.col(vec_col)
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False))


def numbered(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(uid, id, vec): usable vectors of the commonest length with a number for each row, so copies of a row stay apart.

    Vectors of another length have no inner product with the rest and take no part.
    """
    kind = "array<float>" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("vec")).where(usable("vec"))
    rows = saved_rows(rows, "uid")
    lengths = rows.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    dim = lengths[0]["d"] if lengths else 0
    return rows.where(F.size("vec") == dim)


def arrays(table: pa.Table, more: tuple[str, ...] = ()) -> tuple[np.ndarray, ...]:
    """Ids, row numbers, vectors and further columns."""
    flat = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    # Vectors travel in the precision that they came in, and are computed with in double.
    return table.column("id").to_numpy(), table.column("uid").to_numpy(), flat.astype(np.float64, copy=False).reshape(table.num_rows, -1), *[table.column(c).to_numpy() for c in more]


def meetings(candidates: DataFrame, queries: DataFrame, cells: int, run: Callable, schema: str, more: tuple[str, ...] = ()) -> DataFrame:
    """``run(cell, ids, uids, vectors, *more)`` makes an index of the candidates of one ``cell`` (0 to ``cells`` - 1); its
    ``ask(ids, uids, vectors, *more)`` gives a record batch for a block of the queries of that cell. Candidates of a cell must be bounded,
    queries stream past them. A cell is a task of its own, as far as tasks go.
    """
    columns = ["cell", "kind", "uid", F.coalesce("id", F.lit(LAST)).alias("id"), "vec", *more]
    both = candidates.withColumn("kind", F.lit(0)).select(*columns).union(queries.withColumn("kind", F.lit(1)).select(*columns))
    dealt = both.repartitionById(max(1, min(cells, MOST_TASKS)), "cell").sortWithinPartitions("cell", "kind", "uid")
    return dealt.mapInArrow(lambda batches: _meet(batches, run, more), schema)


def _meet(batches: Iterable[pa.RecordBatch], run: Callable, more: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    now, held, index = None, [], None
    for batch in batches:
        marks = np.stack([batch.column(c).to_numpy() for c in ("cell", "kind")])
        cuts = np.flatnonzero(np.r_[True, (marks[:, 1:] != marks[:, :-1]).any(0)][: batch.num_rows]).tolist()
        for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
            cell, kind = marks[:, a].tolist()
            part = pa.Table.from_batches([batch.slice(a, b - a)])
            if cell != now:
                now, held, index = cell, [], None
            if not kind:
                held.append(part)
                continue
            if index is None and held:
                index, held = run(cell, *arrays(pa.concat_tables(held), more)), []
            if index is not None:  # without candidates there is nothing to find
                yield index.ask(*arrays(part, more))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]
