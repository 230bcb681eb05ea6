"""Near-duplicate records, by MinHash banding and verification on the full sets.

A record's set holds its distinct words, and for Chinese and Japanese its distinct pairs of adjacent characters. Records
with equal key (here: company) and equal set are one class, numbered by a hash of both; only one representative of a class
goes on, so a group of copies costs one row, collapsed before the shuffle. A representative's signature is cut into bands;
band and row counts are chosen for the wanted recall at the threshold. Band hashes (with the key in them) are shuffled; two
representatives that share one are a candidate pair. Bands that very many share are split into cells. A sketch of one bit
for each of 128 signature values drops most chance pairs; the rest is verified on the full sets. Sets are word hashes
of 32 bits, computed for whole batches at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.leaks import _HAN_LEAD, _Hasher, plain
from eventloom.session import broadcast_if_small, cut_lineage

THRESHOLD, RECALL = 0.7, 0.98
#: Signature values at most; within that, the most selective plan that reaches the recall is taken.
HASHES = 192
SKETCH_BITS = 128
#: Standard deviations below the expected agreement of a pair at the threshold at which the sketch gives a pair up.
SKETCH_SLACK = 3.5


def band_plan(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows for which so many hashes still give a pair at the threshold the wanted recall."""
    for rows in range(hashes, 0, -1):
        bands = hashes // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)), rows
    return hashes, 1


def sketch_floor(threshold: float = THRESHOLD) -> int:
    """Agreeing sketch bits below which a pair is given up."""
    p = (1 + threshold) / 2
    return math.floor(SKETCH_BITS * p - SKETCH_SLACK * math.sqrt(SKETCH_BITS * p * (1 - p)))


@lru_cache(maxsize=2)
def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_sets(texts: list[str], hasher: _Hasher) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, 32-bit hash) of every distinct word or character pair, sorted."""
    low = [plain(t) for t in texts]
    raw = [x.encode("utf-8", "replace") for x in low]
    joined = b"\n".join(raw)
    starts, hashes = hasher.words(joined)
    data = np.frombuffer(joined, dtype=np.uint8)
    latin = ~_HAN_LEAD[data[starts]] if len(starts) else np.zeros(0, bool)
    begins = np.cumsum([0] + [len(x) + 1 for x in raw])
    docs = [np.searchsorted(begins, starts[latin], "right") - 1]
    found = [_mix(hashes[latin])]
    points = np.frombuffer("\n".join(low).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    han = ((points >= 0x3041) & (points <= 0x30FF)) | ((points >= 0x3400) & (points <= 0x9FFF))
    pair = np.flatnonzero(han[:-1] & han[1:])
    if len(pair):
        begins = np.cumsum([0] + [len(x) + 1 for x in low])
        docs.append(np.searchsorted(begins, pair, "right") - 1)
        found.append(_mix((points[pair] << np.uint64(21)) | points[pair + 1] | np.uint64(1 << 62)))
    doc, value = np.concatenate(docs), np.concatenate(found) >> np.uint64(32)
    both = np.unique((doc.astype(np.uint64) << np.uint64(32)) | value)
    return (both >> np.uint64(32)).astype(np.int64), both & np.uint64(0xFFFFFFFF)


def _fold(values: np.ndarray, seed: int) -> np.ndarray:
    """One hash for each row of a matrix."""
    out = np.full(len(values), seed, dtype=np.uint64)
    for k in range(values.shape[1]):
        out = _mix(out ^ (values[:, k] + np.uint64(0x9E3779B97F4A7C15)))
    return out


def _sign(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        a, b = _multipliers(max(bands * rows, SKETCH_BITS))
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                doc, value = word_sets(batch.column(1).to_pylist(), hasher)
                if not len(doc):
                    continue
                present, starts = np.unique(doc, return_index=True)
                spread = _mix(value)
                sig = np.empty((len(present), len(a)), dtype=np.uint64)
                for k in range(len(a)):
                    sig[:, k] = np.minimum.reduceat((spread * a[k] + b[k]) >> np.uint64(32), starts)
                total = np.add.reduceat(_mix(value + np.uint64(77)), starts).view(np.int64)
                sizes = np.diff(np.append(starts, len(doc))).astype(np.int32)
                out = np.empty((len(present), bands), dtype=np.uint32)
                for k in range(bands):
                    out[:, k] = _fold(sig[:, k * rows : (k + 1) * rows], 1000 + k) >> np.uint64(32)
                bits = sig[:, :SKETCH_BITS] & np.uint64(1)
                weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
                halves = [(bits[:, k : k + 64] * weights[None, :]).sum(axis=1, dtype=np.uint64).view(np.int64) for k in (0, 64)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(present) + 1, dtype=np.int32) * bands), pa.array(out.ravel().view(np.int32)))
                carried = batch.select([0, *range(2, batch.num_columns)]).take(pa.array(present))
                yield pa.RecordBatch.from_arrays(
                    [*carried.columns, pa.array(total), pa.array(sizes), pa.array(halves[0]), pa.array(halves[1]), lists],
                    names=[*carried.schema.names, "total", "n", "s1", "s2", "bands"],
                )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = _Hasher()
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            batch = whole.slice(at, 2048)
            doc, value = word_sets(batch.column(1).to_pylist(), hasher)
            offsets = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(offsets), pa.array(value.astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), words], names=["uid", "words"])


#: Bits of the sieve of wanted rows for each of them, and in all; with 64 to a row it is a table of at most so many / 64 rows.
SIEVE_FOR_EACH, SIEVE_BITS = 16, 1 << 26
#: Band rows for each partition of their shuffle.
BAND_ROWS = 250_000
#: A band counts as hot from so many classes in a sample of one in SAMPLED; its buckets are then joined in CELLS parts.
SAMPLED, HOT, CELLS = 64, 32, 32


def only_wanted(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose uid is in ``wanted`` (distinct uids). A sieve of hashed bits, sized by the number wanted and bounded,
    keeps most other rows out of the shuffle of the exact join that follows; where it would be too full to help, the
    join does without."""
    count = wanted.count()
    bits = min(SIEVE_BITS, -(-max(count, 1) * SIEVE_FOR_EACH // 64) * 64)
    if count * 4 > bits:
        return rows.join(wanted, "uid")
    place = lambda df: df.withColumn("_h", F.pmod(F.xxhash64("uid"), F.lit(bits))).withColumn("_slot", F.expr("_h div 64")).withColumn("_bit", F.expr("cast(_h % 64 as int)"))
    sieve = place(wanted.select("uid")).groupBy("_slot").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_mask"))
    passed = place(rows).join(F.broadcast(sieve), "_slot").where(F.expr("shiftrightunsigned(_mask, _bit) & 1") == 1)
    # an inner join with distinct ids: a semi-join would be pushed below the sieve
    return passed.select(*rows.columns).join(wanted, "uid")


#: Bits of a band row's number that hold the size of the set (as much of it as goes in); the others are the band's hash.
SIZE_BITS = 16


def _band(c: str) -> Column:
    return F.shiftrightunsigned(F.col(c), SIZE_BITS)


def bucket_pairs(flat: DataFrame, parts: int, threshold: float) -> DataFrame:
    """(a, b), a < b: all representatives that share a band and are near enough in size, each pair at least once, from
    (uid, x), where ``x`` is the band's hash above the size.

    Hot bands are looked for in a sample of the representatives (which bands are split changes no result); those in one are
    cut into cells, and each cell meets the whole band in a task of its own.
    """
    sample = flat.where(F.pmod(F.xxhash64("uid"), F.lit(SAMPLED)) == 0)
    hot = cut_lineage(sample.groupBy(_band("x").alias("band")).agg(F.count("*").alias("_n")).where(F.col("_n") >= HOT).select("band"))
    size = lambda c: F.col(c).bitwiseAND(F.lit((1 << SIZE_BITS) - 1))

    def pair(l: DataFrame, r: DataFrame, on: list[Column]) -> DataFrame:
        # sizes cut off are taken for equal, which keeps pairs
        sizes = F.least(size("l.x"), size("r.x")) >= F.greatest(size("l.x"), size("r.x")) * threshold - 1e-9
        met = l.alias("l").join(r.alias("r"), [_band("l.x") == _band("r.x"), *on, F.col("l.uid") < F.col("r.uid"), sizes])
        return met.select(F.col("l.uid").alias("a"), F.col("r.uid").alias("b"))

    if hot.isEmpty():
        cold = flat.repartition(parts, _band("x"))
        return pair(cold, cold, [])
    known = broadcast_if_small(hot)
    cold, warm = (flat.join(known, _band("x") == F.col("band"), how) for how in ("left_anti", "left_semi"))
    cold = cold.repartition(parts, _band("x"))
    left = warm.withColumn("cell", F.pmod(F.xxhash64("uid"), F.lit(CELLS)).cast("int"))
    right = warm.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))))
    return pair(cold, cold, []).unionByName(pair(left, right, [F.col("l.cell") == F.col("r.cell")]))


def near_duplicates(
    records: DataFrame, keys: DataFrame, carry: tuple[str, ...] = (), threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES
) -> tuple[DataFrame, DataFrame]:
    """(links, members) for ``records`` (uid long, label, text, *carry) and ``keys`` (label, key long); uid is unique in the
    one, label in the other.

    ``members`` is (cls, uid, *carry): every record with words, by its class. ``links`` is (a, b, similarity), a < b: pairs of
    classes of equal key that share at least ``threshold`` of all that either has. Records without words or whose label has
    no key are in no class.
    """
    bands, rows = band_plan(threshold, recall, hashes)
    rec = records.select("uid", "text", "label", *carry).where("uid is not null and text is not null and label is not null")
    kinds = dict(rec.dtypes)
    shape = ", ".join(f"`{c}` {kinds[c]}" for c in ("uid", "label", *carry)) + ", total bigint, n int, s1 bigint, s2 bigint, bands array<int>"
    signed = rec.mapInArrow(_sign(bands, rows), shape).join(broadcast_if_small(keys.select("label", "key").where("label is not null and key is not null")), "label")
    signed = cut_lineage(signed.select("uid", *carry, F.xxhash64("key", "total", "n").alias("cls"), "key", "n", "s1", "s2", "bands"))
    members = signed.select("cls", "uid", *carry)
    parts = max(8, -(-signed.count() * bands // BAND_ROWS))
    # representatives go by their uid: numbers that lie close take less room in the shuffles than hashes
    reps = signed.groupBy("cls").agg(F.min_by(F.struct("uid", "key", "n", "bands"), "uid").alias("r")).select("r.*")
    size = F.least(F.col("n"), F.lit((1 << SIZE_BITS) - 1)).cast("bigint")
    flat = reps.select("uid", "key", size.alias("n"), F.posexplode("bands").alias("no", "band")).select("uid", F.shiftleft(F.xxhash64("key", "no", "band"), SIZE_BITS).bitwiseOR(F.col("n")).alias("x"))
    sketch = signed.groupBy("cls").agg(F.min("uid").alias("uid"), F.max("s1").alias("s1"), F.max("s2").alias("s2"))
    agree = SKETCH_BITS - F.bit_count(F.col("s1").bitwiseXOR(F.col("r1"))) - F.bit_count(F.col("s2").bitwiseXOR(F.col("r2")))
    # by one end alone: the partitioning serves the removal of repeated pairs and the join
    pairs = bucket_pairs(flat, parts, threshold).repartition(parts, "a").distinct()
    likely = (
        pairs.join(sketch.select(F.col("uid").alias("a"), "s1", "s2"), "a")
        .join(sketch.select(F.col("uid").alias("b"), F.col("s1").alias("r1"), F.col("s2").alias("r2")), "b")
        .where(agree >= sketch_floor(threshold))
        .select("a", "b")
    )
    likely = cut_lineage(likely)
    wanted = likely.select(F.col("a").alias("uid")).union(likely.select("b")).distinct()
    found = only_wanted(rec.select("uid", "text"), wanted).select("uid", "text").mapInArrow(_sets, "uid bigint, words array<int>")
    x, y = (found.select(F.col("uid").alias(u), F.col("words").alias(w)) for u, w in (("a", "xs"), ("b", "ys")))
    shared = likely.join(x, "a").join(y, "b").select("a", "b", (F.size("xs") + F.size("ys")).alias("total"), F.size(F.array_intersect("xs", "ys")).alias("shared"))
    near = shared.select("a", "b", (F.col("shared") / (F.col("total") - F.col("shared"))).alias("similarity")).where(F.col("similarity") >= threshold)
    x, y = (sketch.select(F.col("uid").alias(u), F.col("cls").alias(c)) for u, c in (("a", "ca"), ("b", "cb")))
    links = near.join(x, "a").join(y, "b").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "similarity")
    return links, members


def blank_to_empty(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\x{00A0}\x{3000}]+", " "))


def event_pairs(events: DataFrame, companies: DataFrame) -> DataFrame:
    """(event_a, event_b) of all events that tell one story of one company, each pair once, event_a < event_b.

    ``companies`` is (company, company_id) with -1 outside the pool. Equal companies are the same pool entry, the same
    text outside it (blanks and case aside), or both blank. Of an event saved again every save counts. Saves with null or
    blank description, and those without event_id, are in no pair; a title may be null. An empty table gives an empty
    result. ``row_id`` must be unique.
    """
    told = events.where("event_id is not null").where(F.col("description").rlike(r"[^\s\x{00A0}\x{3000}]"))
    label = F.when(blank_to_empty(F.col("company")) == "", F.lit("")).otherwise(F.col("company"))
    records = told.select(F.col("row_id").alias("uid"), label.alias("label"), F.concat_ws(" \n ", "title", "description").alias("text"), "event_id")
    plain = F.lower(blank_to_empty(F.col("company")))
    keys = companies.where(plain != "").select(F.col("company").alias("label"), F.when(F.col("company_id") >= 0, F.col("company_id")).otherwise(F.xxhash64(plain)).alias("key"))
    keys = keys.unionByName(events.sparkSession.range(1).select(F.lit("").alias("label"), F.lit(-2).cast("bigint").alias("key")))
    links, members = near_duplicates(records, keys, carry=("event_id",))
    named = cut_lineage(members.select("cls", "event_id").distinct())
    left, right = named.alias("l"), named.alias("r")
    within = left.join(right, (F.col("l.cls") == F.col("r.cls")) & (F.col("l.event_id") < F.col("r.event_id"))).select(F.col("l.event_id").alias("event_a"), F.col("r.event_id").alias("event_b"))
    across = (
        links.select("a", "b").join(left, F.col("a") == F.col("l.cls")).join(right, F.col("b") == F.col("r.cls"))
        .select(F.least("l.event_id", "r.event_id").alias("event_a"), F.greatest("l.event_id", "r.event_id").alias("event_b"))
        .where("event_a <> event_b")
    )
    return within.unionByName(across).distinct()
