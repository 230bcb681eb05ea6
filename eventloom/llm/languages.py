"""Languages of documents and of the stretches of mixed ones, by hyperdimensional profiles.

Letters are random bipolar vectors. A trigram is the product of its letters' vectors, each permuted by its place; a text
is the sum of its trigrams' vectors, and a language prototype the sum over sample texts, trigrams damped by the logarithm
of their rate, without what all languages share. A sentence is scored by the cosine of its vector with the prototypes.
The dot product is linear in the trigrams, so those of all trigrams with all prototypes are laid down in one table and
summed, for whole batches at once, from running sums; and as vectors of different trigrams are uncorrelated, the norm
of a sentence's vector is the root of the sum of its trigrams' squared counts (exact as the dimensions grow).

Fields are cut into sentences (titles into their parts), sentences that carry no words of a language (names, numbers,
list words) or too few to tell it join their neighbours, and neighbours of one language form a segment. A field in which
no sentence can tell is taken as a whole and gets its best language with a low confidence, unless it consists of names and
numbers only. Text in other scripts, or in Latin letters far from every prototype, is ``other``.

Prototypes start from the sentences below and from labelled rows; rows without a label join with the language that the
round before gives them, so a corpus without any label works too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.leaks import _TAG

LANGUAGES = ("en", "zh", "de", "fr", "es", "pt", "ja")
#: Labelled rows that prototypes are made of, at most, and dimensions of the vectors.
TRAIN_ROWS, DIMENSIONS = 8_000, 2_048
#: Text in none of the languages.
OTHER = "other"
#: Letters of lower-case words, or Han characters and kana, from which a sentence differs from its neighbours by itself.
LEAST_LETTERS, LEAST_HAN = 11, 7
#: Sharpness of the confidence: log-odds for one unit of cosine.
SHARPNESS = 40.0
#: A sentence whose best language leads by less than this cosine joins its neighbours.
LEAST_LEAD = 0.01
#: Latin text of so many letters in lower-case words whose cosine with every prototype stays below is in another language.
OTHER_LETTERS, OTHER_COSINE = 30, 0.09
#: Words in title case are text and no name from this cosine and this lead.
TITLE_COSINE, TITLE_LEAD = 0.1, 0.05

# Sentences to start from, in the order of LANGUAGES.
SEEDS = {
    "en": "The team said that it will not change what the users of this service have built with their own data. How does it work, and why should they be able to use more of it than before? There is nothing new about the weather, but we were there when it happened and which of them would have known.",
    "zh": "团队表示，这个新的模型已经可以在没有网络的情况下使用。我们认为，他们的方法对于研究人员来说是很重要的。今天发布了更新，但是还有一些问题需要解决。",
    "de": "Das Team sagte, dass sich nichts an dem ändern wird, was die Nutzer mit ihren eigenen Daten gebaut haben. Wie funktioniert das und warum sollte man es für eine größere Aufgabe verwenden? Das Wetter ist heute nicht schön, aber wir sind nach der Arbeit noch über die Straße gegangen.",
    "fr": "L'équipe a déclaré que rien ne changera dans ce que les utilisateurs ont construit avec leurs propres données. Comment cela fonctionne-t-il et pourquoi faut-il s'en servir plus qu'avant ? Il fait beau aujourd'hui, mais nous étions là quand elle est arrivée chez vous.",
    "es": "El equipo dijo que no cambiará nada de lo que los usuarios han construido con sus propios datos. ¿Cómo funciona y por qué se debería usar más que antes? Hoy hace buen tiempo, pero nosotros estábamos allí cuando ella llegó con los niños a la ciudad.",
    "pt": "A equipe disse que não mudará nada do que os usuários construíram com os seus próprios dados. Como funciona e por que se deveria usar mais do que antes? Hoje faz bom tempo, mas nós estávamos lá quando ela chegou com as crianças à cidade e não havia ninguém.",
    "ja": "チームは、利用者が自分のデータで作ったものについて何も変わらないと述べた。どのように動くのか、なぜ前よりも多く使うべきなのか。今日は天気がいいですが、彼女が来たときには私たちもそこにいました。",
}

# The alphabet. Symbol 0 is everything else; Han characters and kana have one symbol each.
_LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßéèêëàâáãåçñíìîïóòôõúùûœæø"
_HAN, _HIRA, _KATA, _COMMA, _DOT, _LISTED = len(_LETTERS) + 1, len(_LETTERS) + 2, len(_LETTERS) + 3, len(_LETTERS) + 4, len(_LETTERS) + 5, len(_LETTERS) + 6

_SENTENCE = re.compile(r"[.!?…]+[\"'”’»)\]]*\s+(?=[^a-z\s]|\S*[/\d])|…+|[。！？]+[”’」』）]*\s*|\n+|</?[A-Za-z][^<>]*>")
_PARTS = re.compile(r"\s+(?:[—–|/·•]|-{1,2}|&mdash;)\s+|\n+")
#: Separates fields in a batch; no part of any text.
_END = "\x00"


def _alphabet() -> np.ndarray:
    table = np.zeros(0x110000, dtype=np.uint8)
    for k, c in enumerate(_LETTERS):
        table[ord(c)] = table[ord(c.upper()) if len(c.upper()) == 1 else ord(c)] = k + 1
    table[0x3400:0xA000], table[0x3041:0x3097], table[0x30A1:0x30FF] = _HAN, _HIRA, _KATA
    table[ord("，")], table[ord("。")], table[ord("、")] = _COMMA, _DOT, _LISTED
    return table


def _trigrams(codes: np.ndarray) -> np.ndarray:
    """Number of the trigram that ends at each position; 0 where it has no letter in the middle."""
    c = codes.astype(np.int32)
    out = np.zeros(len(c), dtype=np.int32)
    out[2:] = np.where(c[1:-1] > 0, (c[:-2] << 12) | (c[1:-1] << 6) | c[2:], 0)
    return out


class Profiles:
    """The alphabet and the table of cosines' numerators, one row for each trigram."""

    def __init__(self, table: np.ndarray):
        self.table, self.codes = table, _alphabet()

    @staticmethod
    def train(samples: list[tuple[str, str]], dimensions: int = DIMENSIONS, rounds: int = 2) -> Profiles:
        """Profiles from (language, text) pairs, of which some labels may be wrong or empty: later rounds use only the texts
        whose label the round before agrees with, and those without a label by what it finds. Without pairs, the
        sentences to start from are all there is."""
        codes = _alphabet()
        cut = lambda text: _trigrams(codes[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)])
        seeds = [(k, cut(SEEDS[lang])) for k, lang in enumerate(LANGUAGES)]
        given = [(LANGUAGES.index(lang) if lang else -1, cut(text)) for lang, text in samples if len(text) > 2]
        parts = [(k, grams) for k, grams in given if k >= 0]
        if len(parts) < len(given):
            rounds += 1
        rng = np.random.default_rng(11)
        letters = rng.choice(np.array([-1, 1], dtype=np.float32), (64, dimensions))
        first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
        table = np.zeros((1 << 18, len(LANGUAGES)), dtype=np.float32)
        for _ in range(rounds):
            counts = np.zeros((len(LANGUAGES), 1 << 18))
            for k in range(len(LANGUAGES)):
                counts[k] = np.bincount(np.concatenate([grams for lang, grams in seeds + parts if lang == k]), minlength=1 << 18)
            counts[:, 0] = 0
            weight = np.log1p(1e4 * counts / np.maximum(1, counts.sum(axis=1, keepdims=True))).astype(np.float32).reshape(-1, 64, 64, 64)
            # the sum of weight times first[a] * second[b] * letters[c], one factor at a time
            prototypes = np.stack([sum(first[a] * (second * (w[a] @ letters)).sum(axis=0) for a in range(64) if w[a].any()) + np.zeros(dimensions, np.float32) for w in weight])
            prototypes -= prototypes.mean(axis=0, keepdims=True)
            prototypes /= np.maximum(1e-6, np.linalg.norm(prototypes, axis=1, keepdims=True))
            for k, prototype in enumerate(prototypes):
                for a in range(64):
                    table[a << 12 : (a + 1) << 12, k] = ((second * (first[a] * prototype)) @ letters.T).ravel() / np.sqrt(dimensions)
            table[np.arange(1 << 18) >> 6 & 63 == 0] = 0
            found = [int(table[grams].sum(axis=0).argmax()) for _, grams in given]
            parts = [(k, grams) for k, (label, grams) in zip(found, given) if label in (-1, k)]
        return Profiles(table)

    def cosines(self, text: str, of: np.ndarray | None = None) -> np.ndarray:
        """Cosines of a whole text with the prototypes; with ``of``, of its trigrams at those places alone."""
        grams = _trigrams(self.codes[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)])
        grams = grams[(grams > 0) & (True if of is None else of)]
        counts = np.unique(grams, return_counts=True)[1].astype(float)
        return self.table[grams].sum(axis=0, dtype=np.float64) / np.sqrt(max(1.0, (counts**2).sum()))

    def sentences(self, fields: list[str], titles: bool) -> tuple[np.ndarray, ...]:
        """(field, start, end, language or -1, confidence) of every sentence, by offset in its field."""
        joined = _END.join(fields) + _END
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
        begins = np.concatenate([[0], np.flatnonzero(points == 0) + 1])[:-1] if len(fields) else np.zeros(0, np.int64)
        cuts = np.fromiter((m.end() for m in (_PARTS if titles else _SENTENCE).finditer(joined)), dtype=np.int64)
        starts = np.unique(np.concatenate([begins, cuts]))
        starts = starts[starts < len(points)]
        ends = np.append(starts[1:], len(points))
        field = np.searchsorted(begins, starts, "right") - 1
        codes = self.codes[points]
        grams = _trigrams(codes)
        total = np.zeros((len(points) + 1, len(LANGUAGES)), dtype=np.float64)
        np.cumsum(self.table[grams], axis=0, out=total[1:])
        # trigrams that reach over a start belong to neither side
        inner = np.minimum(starts + 2, ends)
        scores = total[ends] - total[inner]
        sentence = np.repeat(np.arange(len(starts)), ends - starts)
        own = (grams > 0) & (np.arange(len(points)) >= inner[sentence])
        keys = np.sort((sentence[own] << 18) | grams[own])
        edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        counts = np.diff(np.append(edges, len(keys)))
        square = np.bincount(keys[edges] >> 18, weights=counts.astype(float) ** 2, minlength=len(starts)) if len(keys) else np.zeros(len(starts))
        cosine = scores / np.sqrt(np.maximum(1.0, square))[:, None]
        latin = (codes > 0) & (codes <= len(_LETTERS))
        upper = latin & (points < 0x250) & _UPPER[np.minimum(points, 0x24F)]
        opens = latin & ~np.concatenate([[False], latin[:-1]])
        word = np.maximum.accumulate(np.where(opens, np.arange(len(points)), 0))
        plain = latin & ~upper[word]
        token = np.cumsum((points == 32) | (points == 10) | (points == 0))
        coded = np.zeros(token[-1] + 1, dtype=bool)  # tokens with a digit or a slash are names
        coded[token[(points >= 48) & (points <= 57) | (points == 47)]] = True
        plain &= ~coded[token]
        letters = lambda mask: np.concatenate([[0], np.cumsum(mask)])[ends] - np.concatenate([[0], np.cumsum(mask)])[starts]
        cjk = letters((codes >= _HAN) & (codes <= _KATA))
        small, big = letters(latin & ~upper), letters(upper)
        shouted = big > 2 * small
        words = np.where(shouted, letters(latin & ~coded[token]) // 2, letters(plain))
        able = (words >= LEAST_LETTERS) | (cjk >= LEAST_HAN) | (words + 2 * cjk >= LEAST_LETTERS + LEAST_HAN)
        order = np.sort(cosine, axis=1)
        lead = order[:, -1] - order[:, -2]
        odds = np.exp(SHARPNESS * (cosine - order[:, -1:]))
        confidence = 1.0 / odds.sum(axis=1)
        best = cosine.argmax(axis=1)
        lang = np.where(able & (lead >= LEAST_LEAD) & (~shouted | (big >= SHOUTED_LETTERS) | (lead >= SHOUTED_LEAD)), best, -1)
        foreign = letters(_FOREIGN[np.minimum(points, len(_FOREIGN) - 1)])
        alien = foreign > small + big + cjk
        lang[alien], confidence[alien] = _OTHER, (foreign / np.maximum(1, foreign + small + big + cjk))[alien]
        # names have no share in what makes Latin text foreign, so the cosine is taken again without them
        for k in np.flatnonzero((lang >= 0) & ~alien & (cjk == 0) & (words >= OTHER_LETTERS) & (order[:, -1] < 1.5 * OTHER_COSINE)):
            a, b = starts[k], ends[k]
            text = joined[a:b]
            near = self.cosines(text, plain[a:b] | shouted[k]).max()
            if near < OTHER_COSINE:
                lang[k], confidence[k] = _OTHER, 1.0 - near / (2 * OTHER_COSINE)
        return field, starts - begins[field], ends - begins[field] - 0, lang, confidence

    def whole(self, text: str) -> tuple[int, float]:
        """(language, confidence) of a field of which no sentence can tell; -1 for names and numbers only."""
        bare = _CODED.sub(" ", text)
        han = len(_HAN_KANA.findall(bare))
        words = _LATIN_WORD.findall(bare)
        cosine = self.cosines(" " + text + " ")
        order = np.sort(cosine)
        small = sum(len(w) for w in words if w[0].islower())
        told = small >= 4 or (len(words) >= 2 and bare == text and _ENDED.search(text) is not None)
        told |= len(words) >= 3 and bare == text and order[-1] >= TITLE_COSINE and order[-1] - order[-2] >= TITLE_LEAD
        if _JOINED.search(text) or not (han or told):
            return -1, 0.0
        return int(cosine.argmax()), float(1.0 / np.exp(SHARPNESS * (cosine - order[-1])).sum())

    def segments(self, fields: list[str], titles: bool) -> list[list[tuple[int, int, str, float]]]:
        """(start, end, language, confidence) of the segments of each field, which is empty for fields without words."""
        out: list[list] = [[] for _ in fields]
        if not fields:
            return out
        for f, a, b, lang, sure in zip(*(x.tolist() for x in self.sentences(fields, titles))):
            held = out[f]
            b = min(b, len(fields[f]))
            if b <= a:
                continue
            if held and (lang < 0 or held[-1][2] in (-1, lang)):
                last = held[-1]
                weight = b - a if lang >= 0 else 0
                last[1] = b
                last[2] = lang if last[2] < 0 else last[2]
                last[3] += sure * weight
                last[4] += weight
            else:
                held.append([a, b, lang, sure * (b - a) if lang >= 0 else 0.0, b - a if lang >= 0 else 0])
        for f, held in enumerate(out):
            if len(held) == 1 and held[0][2] < 0:
                held[0][2], held[0][3] = self.whole(fields[f])
                held[0][4] = 1
        return [[(a, b, _NAMES[k], s / max(1, w)) for a, b, k, s, w in held if k >= 0] for held in out]


_NAMES = (*LANGUAGES, OTHER)
_OTHER = len(LANGUAGES)
# Blocks of letters that none of the languages is written in (Greek to Georgian and on to Mongolian, Hangul).
_FOREIGN = np.zeros(0xD7A5, dtype=bool)
_FOREIGN[0x370:0x1D00], _FOREIGN[0xAC00:0xD7A4] = True, True
_CODED = re.compile(r"\S*[\d/]\S*")
_HAN_KANA = re.compile(r"[぀-ヿ㐀-鿿]")
_LATIN_WORD = re.compile(r"[^\W\d_぀-ヿ㐀-鿿]+(?:['’][^\W\d_]+)*")
_ENDED = re.compile(r"[^\W\d_]{2,}[.!?…][\s\"'”’»)]*$")
#: Names put side by side.
_JOINED = re.compile(r"\S\s*[×✕+&]\s*\S")

_UPPER = np.array([chr(k).isupper() for k in range(0x250)])
#: Letters of a sentence in capitals, where names cannot be told from words, below which it needs a clearer lead.
SHOUTED_LETTERS, SHOUTED_LEAD = 40, 0.05


def primary_subtag(label: str | None) -> str:
    """The primary subtag of a language label; empty for a missing one."""
    x = re.split(r"[-_]", (label or "").strip().lower())[0]
    return "" if x in ("und", "xx") else x


def clean_field(text: str) -> str:
    """A field without markup, with entities resolved; offsets of segments refer to this text."""
    if "&" in text:
        import html

        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("\n", text)
    return text.replace(_END, " ")


def train_profiles(events: DataFrame, rows: int = TRAIN_ROWS) -> Profiles:
    """Profiles from at most ``rows`` rows (uid, lang, text), the same on every run; rows with a known label come first."""
    lang = F.lower(F.regexp_extract(F.trim("lang"), r"^([A-Za-z]+)", 1))
    all_ = events.select(F.when(lang.isin(*LANGUAGES), lang).otherwise(F.lit("")).alias("lang"), "text", "uid").where(F.length("text") > 20)
    # thinned by hash before the cut, so that the partitions do not each send a whole sample to the driver
    share = min(1.0, 3.0 * rows / max(1, all_.count()))
    thin = all_.where(F.pmod(F.xxhash64("uid"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    sample = thin.orderBy(F.col("lang") == "", F.xxhash64("uid"), "uid").limit(rows).select("lang", "text").collect()
    return Profiles.train([(r.lang, clean_field(r.text)) for r in sample])


_SEGMENTS = "row_id bigint, fld string, seg_no int, lang string, confidence double, seg_from int, seg_to int, label string, n_segs int"


def _run(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = model.value
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                ids, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                cols: tuple[list, ...] = tuple([] for _ in range(9))
                for fld, k, titles in (("title", 2, True), ("description", 3, False)):
                    texts = [clean_field(t) if t else "" for t in batch.column(k).to_pylist()]
                    for uid, label, found in zip(ids, labels, profiles.segments(texts, titles)):
                        for no, (a, b, lang, sure) in enumerate(found, 1):
                            for col, value in zip(cols, (uid, fld, no, lang, sure, a, b, primary_subtag(label), len(found))):
                                col.append(value)
                types = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["row_id", "fld", "seg_no", "lang", "confidence", "seg_from", "seg_to", "label", "n_segs"])

    return run


def field_segments(events: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(row_id, fld, seg_no, lang, confidence, seg_from, seg_to, label, n_segs) of every segment of ``title`` and ``description``.

    ``label`` is the delivered label's primary subtag, empty if missing; it plays no part in the language found. ``n_segs``
    is the number of the field's segments. Null and empty fields and those of names and numbers only have no segments;
    however short, any other field has one. Texts are read whole; repeated rows are each answered; an empty table
    gives an empty result; other columns are ignored.
    """
    labelled = events.select(F.col("row_id").alias("uid"), "lang", F.concat_ws("\n", "title", "description").alias("text"))
    model = events.sparkSession.sparkContext.broadcast(train_profiles(labelled, rows))
    return events.select("row_id", "lang", "title", "description").mapInArrow(_run(model), _SEGMENTS)


def wrong_labels(segments: DataFrame) -> DataFrame:
    """(row_id, fld, seg_no, lang) of fields with several segments, or whose label is missing or another language."""
    return segments.where((F.col("n_segs") > 1) | (F.col("label") != F.col("lang"))).select("row_id", "fld", "seg_no", "lang")
