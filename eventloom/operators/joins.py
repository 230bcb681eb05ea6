"""Exact similarity join of titles by token sets, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.text import title_tokens
from eventloom.session import cut_lineage


def title_links(titles: DataFrame, title: str, threshold: float) -> DataFrame:
    """(title_a, title_b, similarity), title_a < title_b: all pairs of distinct lower-case titles at least so similar.

    Prefix filter: with tokens ordered from rare to common, two sets with similarity t share one of the first
    n - ceil(t * n) + 1 tokens of each. Only those tokens are joined, so common words never meet; the join on a token is
    an equality join that adaptive execution can split. Two sets that meet at places i and j of their orders share at
    most 1 + min(n - i, m - j) tokens, so pairs that meet too late are dropped as they meet. Titles go through the joins
    as numbers with their tokens cut once; what is left is written down before the overlap is taken, since the optimiser
    would otherwise move that into the join. Repeated titles count once; empty ones link to nothing.
    """
    distinct = titles.select(F.lower(F.coalesce(F.col(title), F.lit(""))).alias("t")).where("t <> ''").distinct()
    sets = cut_lineage(distinct.select(F.monotonically_increasing_id().alias("id"), "t", title_tokens("t").alias("w"))).where(F.size("w") > 0)
    flat = sets.select("id", F.explode("w").alias("w"))
    freq = flat.groupBy("w").agg(F.count("*").alias("df"))
    ordered = flat.join(freq, "w").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("ws"))  # the tokens of one title: bounded by its length
    ordered = ordered.select("id", F.size("ws").alias("n"), "ws")
    prefix = ordered.select("id", "n", F.posexplode(F.expr(f"slice(ws, 1, n - cast(ceil(n * {threshold}D - 1e-9) as int) + 1)")).alias("i", "x")).select("id", "n", "i", F.col("x.w").alias("w"))
    a, b = prefix.alias("a"), prefix.alias("b")
    near = (F.col("a.n") >= F.col("b.n") * threshold - 1e-9) & (F.col("b.n") >= F.col("a.n") * threshold - 1e-9)
    reach = F.least(F.col("a.n") - F.col("a.i"), F.col("b.n") - F.col("b.i"))  # places count from 0
    met = near & (reach * (1 + threshold) >= (F.col("a.n") + F.col("b.n")) * threshold - 1e-9)
    pairs = a.join(b, (F.col("a.w") == F.col("b.w")) & (F.col("a.id") < F.col("b.id")) & met)
    pairs = cut_lineage(pairs.select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).distinct())
    left = pairs.join(sets.select(F.col("id").alias("x"), F.col("t").alias("t1"), F.col("w").alias("w1")), "x")
    both = left.join(sets.select(F.col("id").alias("y"), F.col("t").alias("t2"), F.col("w").alias("w2")), "y")
    shared = both.select("t1", "t2", (F.size("w1") + F.size("w2")).alias("total"), F.size(F.array_intersect("w1", "w2")).alias("shared"))
    return shared.select(F.least("t1", "t2").alias("title_a"), F.greatest("t1", "t2").alias("title_b"), (F.col("shared") / (F.col("total") - F.col("shared"))).alias("similarity")).where(
        F.col("shared") >= (F.col("total") - F.col("shared")) * threshold
    )
