"""Encoding of whole corpora with a byte-level BPE tokenizer, by overlapping chunks.

A text longer than one chunk is cut into chunks that overlap. Every chunk is pre-tokenised as a row of its own; its first
pre-tokens may be wrong because it starts at an arbitrary place. Two chunks are stitched at a boundary that both have
in their overlap: the matches after a boundary depend only on what follows it, so from there on the later chunk is right.
Boundaries too near a chunk's end are not trusted, since a match may look ahead. Each stitch needs the boundaries of two
neighbours only, so the stitches of one giant text are found, and the pieces between them encoded, by as many tasks as
there are; the pieces' ids are put together in order. Chunks without a common boundary (one pre-token that is longer
than an overlap) are joined and stitched in one task. Decoding concatenates the tokens' bytes.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Folder of the public tokenizers' files.
TOKENIZER_DIR = os.environ.get("EVENTLOOM_TOKENIZERS", "/opt/tokenizers")
CHUNK, OVERLAP = 4096, 256
#: Characters that a match of the pattern may look ahead.
LOOKAHEAD = 4
#: Splits text before the merges (a fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR):
    """The tokenizer whose rank file lies in ``folder``; strings of special tokens are ordinary text to it."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


def pre_tokens(text: str) -> np.ndarray:
    """End offsets of the pre-tokens of a text."""
    return np.fromiter((m.end() for m in _pattern().finditer(text)), dtype=np.int64)


def stitch(chunks: list[tuple[int, str, np.ndarray]], full_length: int) -> list[tuple[int, int, int]]:
    """Pieces (chunk index, from, to) in absolute offsets that together cover a text.

    ``chunks`` has (start, text, absolute ends) in order. Where an overlap has no common boundary, the earlier chunk
    is extended by the later one's text and pre-tokenised anew from its last trusted boundary.
    """
    pieces, begun = [], 0
    for k, (start, text, ends) in enumerate(chunks):
        if k + 1 == len(chunks):
            pieces.append((k, begun, full_length))
            break
        nxt_start, nxt_text, nxt_ends = chunks[k + 1]
        trusted = ends[(ends > begun) & (ends <= start + len(text) - LOOKAHEAD)]
        common = np.intersect1d(trusted[trusted > nxt_start], nxt_ends, assume_unique=True)
        # a piece that ends in blanks would be matched otherwise when they end a text
        common = next((int(b) for b in common if not text[int(b) - 1 - start].isspace()), None)
        if common is not None:
            pieces.append((k, begun, common))
            begun = common
        else:
            joined_text = text + nxt_text[start + len(text) - nxt_start :]
            again = pre_tokens(joined_text[begun - start :]) + begun
            chunks[k + 1] = (start, joined_text, again)
    return pieces


def split_chunks(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """(start, text) of the overlapping chunks of a text."""
    if len(text) <= chunk + overlap:
        return [(0, text)]
    return [(s, text[s : s + chunk + overlap]) for s in range(0, max(1, len(text) - overlap), chunk)]


def encode_text(text: str, enc, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """Ids of one text by way of its chunks."""
    chunks = [(s, t, pre_tokens(t) + s) for s, t in split_chunks(text, chunk, overlap)]
    parts = [_encode_piece(text[a:b], enc) for _, a, b in stitch(chunks, len(text))]
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def _encode_piece(piece: str, enc) -> np.ndarray:
    """Ids of a piece between two pre-token boundaries."""
    return enc.encode_to_numpy(piece, allowed_special=set(), disallowed_special=())


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays).astype(np.int32) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _encode_short(name: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(name, folder)
        for batch in batches:
            ids = [_encode_piece(t, enc) if t else np.empty(0, np.uint32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(ids)], names=["doc_id", "ids"])

    return run


def _cut(chunk: int, overlap: int):
    """Rows of (doc_id, sum, no, start, part), and one with no = -1 for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, total, text in zip(*(c.to_pylist() for c in batch.columns)):
                chunks = split_chunks(text, chunk, overlap)
                for at in range(0, len(chunks), 1024):
                    some = chunks[at : at + 1024]
                    numbers, starts, parts = list(range(at, at + len(some))), [c[0] for c in some], [c[1] for c in some]
                    if at == 0:
                        numbers, starts, parts = [-1, *numbers], [-1, *starts], [None, *parts]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc] * len(parts), pa.int64()), pa.array([total] * len(parts), pa.int64()), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(parts, pa.string())],
                        names=["doc_id", "sum", "no", "start", "part"],
                    )

    return run


def _edges(chunk: int, overlap: int):
    """The boundaries of each chunk that may be stitches: in its overlap with the one before, and trusted ones with the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for start, text in zip(batch.column("start").to_pylist(), batch.column("part").to_pylist()):
                ends = pre_tokens(text)
                heads.append((ends[ends <= overlap] + start).tolist())
                # a piece that ends in blanks would be matched otherwise when they end a text
                tails.append([int(e) + start for e in ends[(ends > chunk) & (ends <= len(text) - LOOKAHEAD)] if not text[int(e) - 1].isspace()])
            long = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "sum", "no")), pa.array(heads, long), pa.array(tails, long)], names=["doc_id", "sum", "no", "head", "tail"])

    return run


def _encode_pieces(name: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(name, folder)
        for batch in batches:
            start, text, begin, end = (batch.column(c).to_pylist() for c in ("start", "part", "begin", "end"))
            ids = [_encode_piece(t[b - s : len(t) if e is None else e - s], enc) for s, t, b, e in zip(start, text, begin, end)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sum"), batch.column("begin"), _lists(ids)], names=["doc_id", "sum", "begin", "ids"])

    return run


def _encode_run(name: str, folder: str):
    """Chunks that have no common boundary, together."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        enc = encoding(name, folder)
        pdf = pdf.drop_duplicates("start").sort_values("start")
        begin, end = int(pdf["begin"].iloc[0]), pdf["end"].iloc[0]
        last = pdf.iloc[-1]
        full = int(last["start"]) + len(last["part"]) if pd.isna(end) else int(end)
        whole = "".join(t[max(0, begin - int(s)) : None if k + 1 == len(pdf) else int(pdf["start"].iloc[k + 1]) - int(s)] for k, (s, t) in enumerate(zip(pdf["start"], pdf["part"])))
        ids = _encode_piece(whole[: full - begin], enc).astype(np.int32)
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "sum": [pdf["sum"].iloc[0]], "begin": [begin], "ids": [ids]})

    return run


def encode_corpus(docs: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids) of every document. Empty and null texts give an empty list.

    Texts of one chunk are encoded where they lie. Longer ones are cut once from front to back; their chunks are rows of
    their own, so that one giant text is the work of many tasks, which pre-tokenise, stitch and encode.
    Repeated rows and repeated ids are each answered; other columns are ignored; an empty table gives an empty result.
    """
    long_ = F.length("text") > chunk + overlap
    short = docs.where(F.coalesce(~long_, F.lit(True))).select("doc_id", "text")
    short = short.mapInArrow(_encode_short(name, folder), "doc_id bigint, ids array<int>")
    key = ["doc_id", "sum"]
    parts = docs.where(long_).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("sum"), "text")
    parts = parts.mapInArrow(_cut(chunk, overlap), "doc_id bigint, sum bigint, no int, start bigint, part string").repartition(*key, "no")
    edges = parts.where("no >= 0").mapInArrow(_edges(chunk, overlap), "doc_id bigint, sum bigint, no int, head array<bigint>, tail array<bigint>").dropDuplicates([*key, "no"])
    before = edges.select(*key, (F.col("no") + 1).alias("no"), "tail")
    stitches = edges.select(*key, "no", "head").join(before, [*key, "no"], "left").select(*key, "no", F.when(F.col("no") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", "tail"))).alias("begin"))
    along = Window.partitionBy(*key).orderBy("no")  # three numbers for each chunk
    runs = stitches.withColumn("run", F.last(F.when(F.col("begin").isNotNull(), F.col("no")), ignorenulls=True).over(along))
    pieces = runs.groupBy(*key, "run").agg(F.min("begin").alias("begin"), F.count("*").alias("n"))
    pieces = pieces.withColumn("end", F.lead("begin").over(Window.partitionBy(*key).orderBy("run")))
    placed = parts.where("no >= 0").join(runs.select(*key, "no", "run"), [*key, "no"]).join(pieces, [*key, "run"])
    shape = "doc_id bigint, sum bigint, begin bigint, ids array<int>"
    single = placed.where("n = 1").select(*key, "start", "part", "begin", "end").mapInArrow(_encode_pieces(name, folder), shape)
    joined = placed.where("n > 1").select(*key, "run", "start", "part", "begin", "end").groupBy(*key, "run").applyInPandas(_encode_run(name, folder), shape)
    texts = parts.where("no = -1").select(*key, F.lit(-1).cast("bigint").alias("begin"), F.array().cast("array<int>").alias("ids"))
    whole = single.unionByName(joined).unionByName(texts).groupBy(*key).agg(F.count_if(F.col("begin") < 0).alias("copies"), F.array_sort(F.collect_set(F.struct("begin", "ids"))).alias("p"))
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    long = whole.select("doc_id", ids.alias("ids"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("doc_id", "ids")
    return short.unionByName(long)


def decode_ids(ids, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> bytes:
    """The bytes of a list of ids."""
    return encoding(name, folder).decode_bytes([int(x) for x in ids])
