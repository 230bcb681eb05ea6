"""Histories of changing attributes, from readings that are differenced snapshot by snapshot.

Every reading of a key is compared with the key's reading before it by a null-safe full outer join. A reading
without predecessor is *inserted*, one with another value *changed*, a predecessor without successor *ended*. The
change events together give the versions, each valid until the next one starts.

Neither the predecessor nor the validity is found by a window over a whole key, because one key may hold a third of
all rows: rows are ordered within (key, time bucket), and a small table with one row for each such pair carries the
first and last reading across the bucket edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.session import cut_lineage

#: Length of a time bucket.
BUCKET_US = 30 * 86_400 * 1_000_000


def repo_key(url: Column) -> Column:
    """``host/owner/name`` in lower case, without scheme, user, ``www.``, closing slash, ``.git``, query or fragment."""
    x = F.lower(F.trim(F.regexp_replace(url, r"[\s\x{00A0}\x{3000}]+", " ")))
    x = F.regexp_replace(x, r"[?#].*$", "")
    x = F.regexp_replace(x, r"^[a-z][a-z0-9+.-]*://", "")
    x = F.regexp_replace(x, r"^[^/@]*@", "")
    x = F.regexp_replace(x, r"^www\.", "")
    x = F.regexp_replace(x, r"^([^/:]+):(?:\d+(?=/))?/*", "$1/")
    x = F.regexp_replace(x, r"/+", "/")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"/+$", ""), r"\.git$", ""), r"/+$", "")


def bucketed_neighbour(df: DataFrame, key: str, at: str, values: list[str], ahead: bool, bucket_us: int = BUCKET_US) -> DataFrame:
    """``df`` with ``near_<value>``: each value of the key's row before it (``ahead``: after it) in the order of ``at``.

    (key, at) must be unique. Works within (key, bucket of ``at``); the edge rows of the buckets go through a table of
    one row for each bucket, so that no task sorts a whole key.
    """
    rows = df.withColumn("_b", F.floor(F.col(at) / bucket_us))
    inside = Window.partitionBy(key, "_b").orderBy(at)
    step = F.lead if ahead else F.lag
    rows = rows.withColumns({f"_in_{v}": step(v).over(inside) for v in values} | {"_in": step(at).over(inside)})
    edge = F.min_by if ahead else F.max_by
    edges = rows.groupBy(key, "_b").agg(edge(F.struct(*values), at).alias("_edge"))
    across = Window.partitionBy(key).orderBy("_b")
    edges = edges.select(key, "_b", step("_edge").over(across).alias("_edge"))
    joined = rows.join(edges, [key, "_b"], "left")
    return joined.select(
        *df.columns,
        *[F.when(F.col("_in").isNotNull(), F.col(f"_in_{v}")).otherwise(F.col(f"_edge.{v}")).alias(f"near_{v}") for v in values],
    )


def change_events(readings: DataFrame, key: str, at: str, value: str, bucket_us: int = BUCKET_US) -> DataFrame:
    """(key, at, value, kind) of every reading that is *inserted* or *changed*, and *ended* ones at the last reading.

    ``readings`` has one row for each (key, at). Consecutive snapshots meet in a full outer join on (key, at of the
    reading before), null-safe, so a key's first reading has no left side and its last one no right side.
    """
    now = bucketed_neighbour(readings.select(key, at, value), key, at, [at], ahead=False, bucket_us=bucket_us)
    now = now.select(F.col(key).alias("k1"), F.col(at).alias("t1"), F.col(value).alias("v1"), F.col(f"near_{at}").alias("p1"))
    before = readings.select(F.col(key).alias("k0"), F.col(at).alias("t0"), F.col(value).alias("v0"))
    both = before.join(now, F.col("k0").eqNullSafe(F.col("k1")) & F.col("t0").eqNullSafe(F.col("p1")), "full_outer")
    kind = (
        F.when(F.col("t0").isNull(), F.lit("inserted"))
        .when(F.col("t1").isNull(), F.lit("ended"))
        .when(~F.col("v0").eqNullSafe(F.col("v1")), F.lit("changed"))
    )
    return both.select(
        F.coalesce("k1", "k0").alias(key), F.coalesce("t1", "t0").alias(at), F.when(F.col("t1").isNotNull(), F.col("v1")).otherwise(F.col("v0")).alias(value), kind.alias("kind")
    ).where(F.col("kind").isNotNull())


def versions(events: DataFrame, key: str, at: str, value: str, bucket_us: int = BUCKET_US, close_ended: bool = False) -> DataFrame:
    """(key, valid_from, valid_to, value): valid_to is the start of the key's next version. The last version of a key stays
    open (null), or with ``close_ended`` is valid until the key was last read (for sources where absence means its end)."""
    starts = events.where(F.col("kind").isin("inserted", "changed")).select(key, at, value)
    spans = bucketed_neighbour(starts, key, at, [at], ahead=True, bucket_us=bucket_us)
    spans = spans.select(key, F.col(at).alias("valid_from"), F.col(f"near_{at}").alias("valid_to"), value)
    if not close_ended:
        return spans
    ended = events.where(F.col("kind") == "ended").select(key, F.col(at).alias("_ended"))
    return spans.join(ended, key, "left").withColumn("valid_to", F.coalesce("valid_to", "_ended")).drop("_ended")


def star_history(snapshots: DataFrame, bucket_us: int = BUCKET_US) -> DataFrame:
    """Versions of every repository's star count: (repo_key, valid_from, valid_to, stars), times as UTC text.

    Null and negative counts, unreadable times and empty addresses are left out. Of several readings of a repository
    at one instant the highest snap_id holds. An empty table gives an empty result; other columns are ignored.
    """
    at = F.unix_micros(F.try_to_timestamp(F.trim(F.regexp_replace("fetched_at", r"[\s\x{00A0}\x{3000}]+", " "))))
    # unusable rows leave after the cut: a condition on the address would be moved below and taken apart from it again
    readings = (
        snapshots.where("stars >= 0")
        .select(repo_key(F.col("repo_url")).alias("repo_key"), at.alias("at"), "stars", "snap_id")
        .groupBy("repo_key", "at")
        .agg(F.max_by("stars", "snap_id").alias("stars"))
    )
    readings = cut_lineage(readings).where("at is not null and repo_key is not null and repo_key <> ''")
    spans = versions(change_events(readings, "repo_key", "at", "stars", bucket_us), "repo_key", "at", "stars", bucket_us)
    stamp = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return spans.select("repo_key", stamp(F.col("valid_from")).alias("valid_from"), F.coalesce(stamp(F.col("valid_to")), F.lit("")).alias("valid_to"), "stars")
