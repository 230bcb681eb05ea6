"""The N best items of every group, by bounded heaps that are built before the shuffle and merged after it.

Each partition folds its rows, Arrow batch by Arrow batch, into one heap of at most N entries for each group it sees.
Only the heaps are shuffled, so a group of millions of rows costs each partition N rows. Merging two heaps is again
"the N best of both", hence the merge is associative; it runs first within (group, slice) and then within the group, so
that even the heaps of one hot group from very many partitions never meet in one task before they have shrunk.
Order: higher score first, ties to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Entries of all heaps of one partition, beyond which they are handed on and begun anew.
MAX_HELD = 500_000
#: Slices of one group's heaps in the first merge.
SLICES = 16


def _best(table: pa.Table, keys: list[str], score: str, uid: str, n: int) -> pa.Table:
    """Rows of the N best of each group of an Arrow table."""
    if not table.num_rows:
        return table
    order = pc.sort_indices(table, [(k, "ascending") for k in keys] + [(score, "descending"), (uid, "ascending")])
    table = table.take(order)
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        col = table.column(k).combine_chunks()
        codes = col.dictionary_encode() if not isinstance(col, pa.DictionaryArray) else col
        codes = np.asarray(codes.indices.fill_null(-1))
        new[1:] |= codes[1:] != codes[:-1]
    starts = np.flatnonzero(new)
    rank = np.arange(table.num_rows) - np.repeat(starts, np.diff(np.append(starts, table.num_rows)))
    return table.filter(pa.array(rank < n))


def _heaps(keys: list[str], score: str, uid: str, n: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, rows = None, [], 0
        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            # as many new rows as are held, so that what is held is sorted again only when its size may have doubled
            if rows < max(65_536, held.num_rows if held is not None else 0):
                continue
            part = pa.Table.from_batches(waiting)
            held = _best(pa.concat_tables([held, part]) if held is not None else part, keys, score, uid, n)
            waiting, rows = [], 0
            if held.num_rows > MAX_HELD:
                yield from held.combine_chunks().to_batches()
                held = None
        if waiting:
            part = pa.Table.from_batches(waiting)
            held = _best(pa.concat_tables([held, part]) if held is not None else part, keys, score, uid, n)
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return fold


def top_n_per_group(df: DataFrame, keys: list[str], score: str, uid: str, n: int) -> DataFrame:
    """(*keys, rank_no, uid, score): the ``n`` rows of each group with the highest score, ties to the smaller uid.

    A null key is a group of its own; rows with a null or NaN score or a null uid do not take part; a row repeated
    whole counts as often as it occurs; an empty input gives an empty result; other columns are ignored.
    """
    rows = df.select(*keys, F.col(score).cast("double").alias(score), uid).where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(uid).isNotNull())
    schema = rows.schema
    heaps = rows.mapInArrow(_heaps(keys, score, uid, n), schema)
    order = [F.col(score).desc(), F.col(uid).asc()]
    sliced = heaps.withColumn("_slice", F.pmod(F.xxhash64(uid), F.lit(SLICES)))
    first = Window.partitionBy(*keys, "_slice").orderBy(*order)
    merged = sliced.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= n).drop("_r", "_slice")
    final = Window.partitionBy(*keys).orderBy(*order)
    return merged.withColumn("rank_no", F.row_number().over(final)).where(F.col("rank_no") <= n).select(*keys, "rank_no", uid, score)


def latest_saves(events: DataFrame) -> DataFrame:
    """One row for each event_id: that of its highest row_id. Rows without event_id stay as they are."""
    kept = [c for c in ("module", "product", "importance_score") if c in events.columns]
    rows = events.select("event_id", "row_id", *kept)
    one = rows.where("event_id is not null").groupBy("event_id").agg(F.max_by(F.struct("row_id", *kept), "row_id").alias("s")).select("event_id", "s.*")
    return one.unionByName(rows.where("event_id is null"))


def best_of_products(events: DataFrame, n: int = 5) -> DataFrame:
    """(module, product, rank_no, row_id): the ``n`` best events of every product within every module."""
    rows = latest_saves(events).select(
        F.lower(F.trim(F.regexp_replace("module", r"[\s\x{00A0}\x{3000}]+", " "))).alias("module"), "product", "importance_score", "row_id"
    )
    rows = rows.where(F.length(F.trim(F.regexp_replace("product", r"[\s\x{00A0}\x{3000}]+", " "))) > 0)
    return top_n_per_group(rows, ["module", "product"], "importance_score", "row_id", n).select("module", "product", F.col("rank_no").cast("int").alias("rank_no"), "row_id")
