"""Leader clustering: a row joins the first leader like it, else becomes a leader; only leaders are compared.

Order decides, so the distinct titles of a group are one task's work; copies of a title are brought together before, since
only the first of them can lead. Groups are first split by what any match must share (a block); where a block may
still be large, use the near-duplicate or exact-key operators instead. Within a block, leaders are found by an inverted index
over tokens, rarest first, not by a scan of all.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.session import cut_lineage

_SPLIT = re.compile(r"[^一-龥a-z0-9]+")


def tokens(title: str | None) -> frozenset[str]:
    return frozenset(t for t in _SPLIT.split((title or "").lower()) if t)


def alike(a: str | None, b: str | None) -> float:
    """Similarity of two titles as the reference semantics have it."""
    if not a or not b:
        return 0.0
    if a.lower() == b.lower():
        return 1.0
    x, y = tokens(a), tokens(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def assign_leaders(titles: list[str | None], keys: list[str | None], threshold: float | None) -> list[int]:
    """For each row in order, the number of its leader: the first with its strong key, else the first alike enough (with no
    threshold, none is)."""
    leaders_by_key: dict[str, int] = {}
    index: dict[str, list[int]] = defaultdict(list)
    sets: list[frozenset[str]] = [tokens(t) for t in titles]
    exact: dict[str, int] = {}
    out = []
    for k, (title, key) in enumerate(zip(titles, keys)):
        leader = leaders_by_key.get(key) if key else None
        if leader is None and title and threshold is not None:
            best = exact.get(title.lower())
            mine = sets[k]
            # two sets alike share at least one of any |mine| - ceil(threshold * |mine|) + 1 tokens
            ordered = sorted(mine, key=lambda t: (len(index[t]), t))
            for t in ordered[: len(mine) - math.ceil(threshold * len(mine) - 1e-9) + 1]:
                for other in index[t]:
                    if (best is None or other < best) and len(mine & sets[other]) / len(mine | sets[other]) >= threshold:
                        best = other
            leader = best
        if leader is None:
            leader = k
            for t in sets[k]:
                index[t].append(k)
            if title:
                exact.setdefault(title.lower(), k)
            if key:
                leaders_by_key.setdefault(key, k)
        out.append(leader)
    return out


def leader_clusters(df: DataFrame, block: str, uid: str, title: str, seq: str, threshold: float | str, strong_key: str | None = None) -> DataFrame:
    """(uid, leader): the leader's uid for every row, within its block, in the order of ``seq``, whose values are distinct in it.

    ``threshold`` may name a column that is the same throughout a block; null there leaves the strong key alone. Rows
    without title and key lead themselves. A later copy of a title and key joins what its first did, or the leader with its key
    where that came between the two.
    """
    kind, kind_q = dict(df.dtypes)[uid], dict(df.dtypes)[seq]
    like = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    rows = cut_lineage(df.select(
        F.col(block).alias("b"), F.col(uid).alias("uid"), blank(title).alias("t"), F.col(seq).alias("q"), like.cast("double").alias("h"), (blank(strong_key) if strong_key else F.lit(None).cast("string")).alias("k")
    ))  # fmt: skip  # titles and keys may be long expressions, which are used more than once
    some = F.col("t").isNotNull() | F.col("k").isNotNull()
    nodes = rows.where(some).groupBy("b", "t", "k").agg(F.min_by("uid", "q").alias("uid"), F.min("q").alias("q"), F.max("h").alias("h"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("q")
        titles, keys = ([x if isinstance(x, str) else None for x in pdf[c]] for c in ("t", "k"))
        least = pdf["h"].iloc[0]
        numbers = assign_leaders(titles, keys, None if pd.isna(least) else float(least))
        by_key: dict[str, int] = {}
        for k, leader in enumerate(numbers):
            if k == leader and keys[k]:
                by_key.setdefault(keys[k], k)
        uids, seqs = pdf["uid"].tolist(), pdf["q"].tolist()
        of = [by_key.get(key) if key else None for key in keys]
        return pd.DataFrame({
            "b": pdf["b"].tolist(), "t": titles, "k": keys, "leader": [uids[n] for n in numbers],
            "key_leader": pd.Series([None if n is None else uids[n] for n in of], dtype=object), "key_q": pd.Series([None if n is None else seqs[n] for n in of], dtype=object),
        })

    kind_b = dict(df.dtypes)[block]
    led = nodes.groupBy("b").applyInPandas(run, f"b {kind_b}, t string, k string, leader {kind}, key_leader {kind}, key_q {kind_q}").alias("n")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("b", "t", "k")]
    joined = rows.where(some).alias("r").join(led, same).select("r.uid", F.when(F.col("key_q") < F.col("q"), F.col("key_leader")).otherwise(F.col("leader")).alias("leader"))
    return joined.unionByName(rows.where(~some).select("uid", F.col("uid").alias("leader")))


#: Undecided key pairs up to which first_by_either_key lets one task finish; each round above it runs over all executors.
ALONE = 20_000


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """The leading pairs among a few, in order."""
    seen: tuple[set, set] = set(), set()
    out = []
    for o, i, t in pdf.sort_values("o")[["o", "i", "t"]].itertuples(index=False):
        i, t = (k if isinstance(k, str) else None for k in (i, t))
        if i not in seen[0] and t not in seen[1]:
            out.append((o, i, t))
            seen[0].update([i] if i else [])
            seen[1].update([t] if t else [])
    return pd.DataFrame(out, columns=["o", "i", "t"])


def first_by_either_key(df: DataFrame, uid: str, id_key: str, title_key: str, seq: str, alone: int = ALONE) -> DataFrame:
    """(uid, leader) where a row joins the first kept row with its id, else the one with its title; a dropped row's own keys
    count for nothing. Null and empty keys match nothing. ``seq`` is unique.

    Only the first row of each pair of keys can lead. In a round, a pair that is the first undecided one of both its id and
    its title leads, and the undecided pairs that share a key with it fall; what is left below ``alone`` is walked in order.
    """
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    rows = df.select(F.col(uid).alias("uid"), blank(id_key).alias("i"), blank(title_key).alias("t"), F.col(seq).alias("o"))
    left = cut_lineage(rows.where("i is not null or t is not null").groupBy("i", "t").agg(F.min("o").alias("o")))
    found = []
    while left.count() > alone:
        first = lambda k: left.where(f"{k} is not null").groupBy(k).agg(F.min("o").alias(f"first_{k}"))  # noqa: B023, E731
        marked = left.join(first("i"), "i", "left").join(first("t"), "t", "left")
        leads = cut_lineage(marked.where("o = coalesce(first_i, o) and o = coalesce(first_t, o)").select("o", "i", "t"))
        found.append(leads)
        for k in ("i", "t"):
            left = left.join(leads.where(f"{k} is not null").select(k), k, "left_anti")
        left = cut_lineage(left)
    kinds = dict(left.dtypes)
    leads = left.select("o", "i", "t").groupBy().applyInPandas(_walk, f"o {kinds['o']}, i string, t string")
    for more in found:
        leads = leads.unionByName(more)
    leads = cut_lineage(leads.join(rows.select("uid", "o"), "o"))
    for k in ("i", "t"):
        rows = rows.join(leads.where(f"{k} is not null").select(k, F.struct("o", "uid").alias(f"by_{k}")), k, "left")
    earlier = lambda c: F.when(F.col(c)["o"] <= F.col("o"), F.col(c)["uid"])
    return rows.select("uid", F.coalesce(earlier("by_i"), earlier("by_t"), "uid").alias("leader"))
