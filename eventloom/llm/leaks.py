"""Held-out evaluation texts found in a training corpus, by suffix arrays of the training shards.

Every shard (a batch of documents) is turned into one sequence of words (for items in Chinese: of characters) and its
suffixes are sorted. Each suffix of each test item is looked up by binary search; the range found holds all places that
begin alike, which are extended to the longest verbatim matches. A passage with few words changed, added or left out
still contains a verbatim stretch of SEED words, because of the limit on edits (20 words with 2 edits leave 6 words in a
row; no allowed passage leaves less). From each such match the passage is extended to both sides with edits, always to
the furthest place that so many edits reach, and kept if it is long enough for its edits.

Two facts bound that work without losing a passage. An allowed passage of twice the least length splits into halves of
which one is allowed itself, so it is enough to look for passages shorter than that, with few edits. And a passage
with E edits consists of E+1 verbatim stretches, of which those that are no matches have less than SEED words; so the
matches of a pair on neighbouring diagonals must together be long enough for some E, or they are dropped at once.

Only suffixes whose first words all occur in test items can match; the others are left out of a shard's array. The array is
sorted to SEED words, since no shorter match matters; each longer match is read off where it lies, with its place in the
document and in the item. The corpus is read once, however many items there are: they are indexed in blocks, and every
shard is searched for one block after the other.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words (characters of items in Chinese) that a leaked passage has at least; one edit is allowed for so many of them.
MIN_WORDS, MIN_CHARS, PER_EDIT = 16, 24, 10
#: Words or characters that any allowed passage leaves in a row.
SEED_WORDS, SEED_CHARS = 6, 7
#: Items that are searched at once.
BLOCK_ITEMS = 5_000

_HAN = "぀-ヿ㐀-鿿"
_WORD = re.compile(rf"[^\W_{_HAN}]+|[{_HAN}]+")
_INVISIBLE = re.compile(r"[\u00ad\u200b-\u200f\u2060\ufeff]")
_INVISIBLES = ("\u00ad", "\u200b", "\u200c", "\u200d", "\u200e", "\u200f", "\u2060", "\ufeff")
#: A tag: short, or with attributes of any length.
_TAG = re.compile(r"""</?[A-Za-z][^<>]{0,200}>|<[A-Za-z][\w:-]*(?:\s+[\w:.-]+\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>]+))+\s*/?>""")
_HAN_RUN = re.compile(rf"[{_HAN}]+")
_MARK = re.compile(r"[\W_]+")
#: Bytes of text that are turned into words at a time.
SHARD_BYTES = 2_000_000


def plain(text: str) -> str:
    """Lower case, without markup and invisible characters, with entities resolved."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii() and any(c in text for c in _INVISIBLES):
        text = _INVISIBLE.sub("", text)
    return text.lower()


def words_of(text: str) -> list[str]:
    """Words of a text; a run of Han characters or kana counts as one word, which no word item contains."""
    return _WORD.findall(plain(text))


def chars_of(text: str) -> str:
    """The letters and digits of a text."""
    return _MARK.sub("", plain(text))


_P = np.uint64(0x9E3779B97F4A7C15)
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(48, 58), *range(97, 123), 1, *range(128, 256)]] = True
#: UTF-8 sequences that are no part of a word, by their first byte; Han characters and kana (E3 to E9) keep that byte as a word of their own.
_MARK_LENGTH = np.zeros(256, dtype=np.int8)
_MARK_LENGTH[[0xC2]], _MARK_LENGTH[[0xE2, 0xEF, *range(0xE3, 0xEA)]], _MARK_LENGTH[range(0xF0, 0xF5)] = 2, 3, 4
_HAN_LEAD = np.zeros(256, dtype=bool)
_HAN_LEAD[0xE3:0xEA] = True


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, dtype=np.uint64)
    x[0] = 1
    return np.cumprod(x, dtype=np.uint64)


class _Hasher:
    """64-bit hashes of all words of a byte sequence at once, as differences of a running polynomial."""

    def __init__(self) -> None:
        self.size = 0

    def words(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of every word."""
        data = np.frombuffer(raw, dtype=np.uint8)
        if len(data) >= self.size:
            self.size = 2 * len(data) + 2
            self.up = _powers(int(_P), self.size)
            self.down = _powers(pow(int(_P), -1, 1 << 64), self.size)
        inside = np.zeros(len(data) + 2, dtype=np.int8)
        word = _IS_WORD[data]
        lead = np.flatnonzero(_MARK_LENGTH[data])
        if len(lead):
            length = _MARK_LENGTH[data[lead]]
            word[lead] = _HAN_LEAD[data[lead]]
            for k in (1, 2, 3):
                rest = lead[length > k] + k
                word[rest[rest < len(word)]] = False
        inside[1:-1] = word
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(data.astype(np.uint64) * self.up[: len(data)], out=total[1:])
        return starts, (total[ends] - total[starts]) * self.down[starts]


class Index:
    """The suffixes of a block of test items, ready to be searched in shards."""

    def __init__(self, items: list[tuple[int, list[str] | str]], seed: int, least: int, chars: bool = False):
        self.seed, self.least, self.chars = seed, least, chars
        self.edits = (2 * least - 1) // PER_EDIT
        self.vocab = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        if chars:
            self.table = np.array([0 if not k or chr(k).isalnum() else -1 for k in range(0x30000)] + [-1] * (0x110000 - 0x30000), np.int64)
            for c, k in self.vocab.items():
                self.table[ord(c)] = k
        else:
            self.hasher = _Hasher()
            raw = [w.encode() for w in self.vocab]
            hashes = np.array([self.hasher.words(x)[1][0] for x in raw], dtype=np.uint64)
            order = np.argsort(hashes)
            self.hashes, self.hash_ids = hashes[order], np.array(list(self.vocab.values()), np.int64)[order]
        self.bits = max(1, len(self.vocab).bit_length())
        self.tokens = np.concatenate([np.zeros(1, np.int64), *[np.array([self.vocab[w] for w in ws] + [0], np.int64) for _, ws in items]])
        self.item = np.concatenate([np.zeros(1, np.int64), *[np.full(len(ws) + 1, i, np.int64) for i, ws in items]])
        self.listed = self.tokens.tolist()
        sizes = [len(ws) for _, ws in items]
        #: Words of the same item before and after each one.
        self.before = [0] + [k for n in sizes for k in range(n + 1)]
        self.after = [0] + [max(0, n - 1 - k) for n in sizes for k in range(n + 1)]
        self.at = self._starts(self.tokens)
        self.keys = self._keys(self.tokens, self.at)

    def _starts(self, tokens: np.ndarray) -> np.ndarray:
        """Positions whose next ``seed`` tokens are all known."""
        known = np.cumsum(np.concatenate([[0], tokens > 0]))
        n = len(tokens) - self.seed + 1
        return np.flatnonzero(known[self.seed :] - known[:n] == self.seed) if n > 0 else np.empty(0, np.int64)

    def _keys(self, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The first ``seed`` tokens of each suffix as byte strings that sort like them."""
        each = max(1, 62 // self.bits)
        parts = []
        for begin in range(0, self.seed, each):
            word = np.zeros(len(at), np.int64)
            for k in range(begin, min(begin + each, self.seed)):
                word = (word << self.bits) | tokens[at + k]
            parts.append(word.astype(">i8"))
        if not len(at):
            return np.empty(0, f"S{8 * len(parts)}")
        return np.ascontiguousarray(np.stack(parts, axis=1)).view(f"S{8 * len(parts)}").ravel()

    def sequence(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, number of the text) of one sequence for all texts, with a 0 before each and at the end."""
        if self.chars:
            rows = [plain(t) if t and _HAN_RUN.search(t) else "" for t in texts]
            points = [np.frombuffer(t.encode("utf-32-le", "replace"), dtype=np.uint32) for t in rows]
            tokens = self.table[np.concatenate([y for x in points for y in (np.zeros(1, np.uint32), x)] or [np.zeros(0, np.uint32)])]
            doc = np.repeat(np.arange(len(texts)), np.array([len(x) + 1 for x in points], dtype=np.int64))
            kept = tokens >= 0
            return np.append(tokens[kept], 0), doc[kept]
        tokens, doc, begin = [], [], 0
        encoded = []
        for t in texts:
            encoded.append(plain(t).encode("utf-8", "replace") if t else b"")
        while begin < len(encoded):
            stop, size = begin, 0
            while stop < len(encoded) and (stop == begin or size + len(encoded[stop]) < SHARD_BYTES):
                size += len(encoded[stop])
                stop += 1
            part = encoded[begin:stop]
            starts, hashes = self.hasher.words(b"".join(b" \x01 " + x for x in part))
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            tokens.append(np.where(self.hashes[at] == hashes, self.hash_ids[at], 0))
            doc.append(np.searchsorted(np.cumsum([0] + [len(x) + 3 for x in part]), starts, "right") - 1 + begin)
            begin = stop
        if not tokens:
            return np.zeros(1, np.int64), np.zeros(0, np.int64)
        return np.append(np.concatenate(tokens), 0), np.concatenate(doc)

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int, int]]:
        """(number of the text, item, longest verbatim match, words of the passage, and where in item and text the match
        begins, in words or characters) of every leak in a shard."""
        tokens, doc = self.sequence(texts)
        at = self._starts(tokens)
        if not len(at) or not len(self.at):
            return []
        keys = self._keys(tokens, at)
        order = np.argsort(keys, kind="stable")
        array, keys = at[order], keys[order]
        lo, hi = np.searchsorted(keys, self.keys, "left"), np.searchsorted(keys, self.keys, "right")
        hits = hi - lo
        if not hits.sum():
            return []
        e = np.repeat(self.at, hits)
        d = array[np.repeat(lo, hits) + np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits)]
        first = (self.tokens[e - 1] != tokens[d - 1]) | (self.tokens[e - 1] == 0)
        e, d = e[first], d[first]
        length = np.full(len(e), self.seed)
        going = np.arange(len(e))
        while len(going):
            a, b = self.tokens[e[going] + length[going]], tokens[d[going] + length[going]]
            going = going[(a == b) & (a != 0)]
            length[going] += 1
        keep = self._promising(doc[d], self.item[e], e, d - e, length)
        e, d, length = e[keep], d[keep], length[keep]
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for k in np.argsort(-length, kind="stable"):
            key = (int(doc[d[k]]), int(self.item[e[k]]))
            if key in best:
                continue
            covered = self._passage(tokens, int(e[k]), int(d[k]), int(length[k]))
            if covered:
                best[key] = (int(length[k]), covered, self.before[int(e[k])], int(d[k]) - int(np.searchsorted(doc, key[0])) - 1)
        return [(k[0], k[1], *v) for k, v in best.items()]

    def _promising(self, doc: np.ndarray, item: np.ndarray, e: np.ndarray, diagonal: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Matches that, with the others of their pair close by on neighbouring diagonals, can be part of a passage."""
        order = np.lexsort((e, item, doc))
        total, count = length.astype(np.int64), np.ones(len(e), np.int64)
        for step in range(1, len(e)):
            a, b = order[:-step], order[step:]
            both = (doc[a] == doc[b]) & (item[a] == item[b]) & (e[b] - e[a] < 2 * self.least)
            if not both.any():
                break
            both &= abs(diagonal[a] - diagonal[b]) <= self.edits
            a, b = a[both], b[both]
            total[a] += length[b]
            total[b] += length[a]
            count[a] += 1
            count[b] += 1
        able = length >= self.least
        for edits in range(1, self.edits + 1):
            short = (self.seed - 1) * np.maximum(0, edits + 1 - count)
            able |= total + short >= max(self.least, PER_EDIT * edits) - edits
        return able

    def _passage(self, tokens: np.ndarray, e: int, d: int, length: int) -> int:
        """Item words of an allowed passage around a verbatim match, 0 if there is none."""
        if length >= self.least:
            return length
        span = 3 * self.least + 2 * self.edits
        low = max(0, d - span)
        near = tokens[low : d + length + span].tolist()
        left = self._reach(near, e - 1, d - 1 - low, -1)
        right = self._reach(near, e + length, d + length - low, 1)
        best = 0
        for a, x in enumerate(left):
            for b, y in enumerate(right):
                # words of the item next to the passage can count as changed ones
                spare = self.before[e] + self.after[e] - length + 1 - x - y
                for more in range(self.edits - a - b + 1):
                    total = x + length + y + min(more, spare)
                    if total >= self.least and (a + b + more) * PER_EDIT <= total:
                        best = max(best, total)
        return best

    def _reach(self, tokens: list[int], e: int, d: int, step: int) -> list[int]:
        """Item words that 0, 1, 2 … edits reach from a place, in one direction, ending in an equal word.

        ``tokens`` are the document's around the match, wide enough for any passage that has to be looked for.
        """
        ours, reach, best, most = self.listed, [], 0, len(tokens)
        front = {0: 0}  # surplus of document words -> item words used
        for edits in range(self.edits + 1):
            done: dict[int, int] = {}
            for shift, used in front.items():
                gained = used
                i, j = e + step * used, d + step * (used + shift)
                while 0 <= j < most and ours[i] and ours[i] == tokens[j]:
                    gained += 1
                    i += step
                    j += step
                done[shift] = gained
                if gained > best and (gained > used or edits == 0):
                    best = gained
            reach.append(best)
            if edits == self.edits:
                break
            front = {}
            for shift, used in done.items():
                more_item = bool(ours[e + step * used])
                j = d + step * (used + shift)
                in_doc = 0 <= j < most and tokens[j] >= 0
                for s, u, ok in ((shift, used + 1, more_item and in_doc), (shift - 1, used + 1, more_item), (shift + 1, used, in_doc)):
                    if ok and u > front.get(s, -1):
                        front[s] = u
            if not front:
                break
        return reach


_LEAK = "doc_id bigint, item_id bigint, verbatim int, passage int, item_at int, doc_at int"


def _search_batches(blocks: list):
    """Every batch is searched for all blocks of items; of several, a worker holds one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for block in blocks:
                out = [(ids[found[0]], *found[1:]) for index in block.value for found in index.search(texts)]
                if len(blocks) > 1 and hasattr(block, "_value"):
                    del block._value  # read again from the worker's disk when its turn comes
                columns = list(zip(*out)) if out else [[]] * 6
                kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "verbatim", "passage", "item_at", "doc_at"])

    return run


def find_leaks(docs: DataFrame, items: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, verbatim, passage, item_at, doc_at): each document with each item that it leaks, whole or in part.

    ``verbatim`` is the longest verbatim match that led to the find, ``item_at`` and ``doc_at`` the words (characters of items
    in Chinese) before it in item and document, and ``passage`` the item's words in an allowed passage around it. Null,
    empty and short texts leak nothing, nor do items shorter than a passage. Texts are read whole; repeated rows are each
    answered; empty tables give an empty result; other columns are ignored. The items are the query set: the driver reads
    them one block at a time and sends each block's index out once; the documents are read once.
    """
    context = docs.sparkSession.sparkContext
    blocks: list = []
    held: list = []

    def close() -> None:
        han = [(r.item_id, chars_of(r.text)) for r in held if (r.lang or "").strip().lower().startswith("zh")]
        rest = [(r.item_id, words_of(r.text)) for r in held if not (r.lang or "").strip().lower().startswith("zh")]
        blocks.append(context.broadcast([Index(rest, SEED_WORDS, MIN_WORDS)] * bool(rest) + [Index(han, SEED_CHARS, MIN_CHARS, chars=True)] * bool(han)))
        held.clear()

    for row in items.select("item_id", "lang", "text").where("item_id is not null and text is not null").orderBy("item_id").toLocalIterator():
        held.append(row)
        if len(held) == block_items:
            close()
    if held:
        close()
    return docs.select("doc_id", "text").mapInArrow(_search_batches(blocks), _LEAK)


def leaked_pairs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id), each pair once."""
    return find_leaks(docs, items).select("doc_id", "item_id").distinct()


def remove_leaked(docs: DataFrame, leaks: DataFrame) -> DataFrame:
    """The documents that leak nothing."""
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")
