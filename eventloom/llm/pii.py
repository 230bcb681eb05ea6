"""Personal information in free text: found by anchor expansion and replaced by typed placeholders.

One Aho-Corasick automaton runs once over each text and reports anchors: at-signs (disguised ones too), plus-signs,
street words, words that announce a number, an identity or a person, and the closings of letters. Each anchor starts a
small deterministic parser that expands over the neighbouring text and validates what it covers: a mailbox by its domain,
an account number and an identity number by its check digits where its kind has any, a telephone number by its groups.
Numbers in a national telephone notation and account numbers need no announcing word; their own form is the anchor. How
far an announcing word reaches is counted in words and ends with the sentence. Next digits and sentence ends are looked up
once and move along, so the work is linear in the text. Overlapping finds are settled by a fixed order of kinds, then by
length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: In the order in which overlapping finds are settled.
KINDS = ("email", "account", "id_number", "phone", "address", "name")

# Anchors by kind, in lower case.
AT_SIGNS = ("@", "＠", "[at]", "(at)", "{at}", "&#64;", " at ")
PHONE_CUES = (
    "call ", "call: ", "tel:", "tel.", "tel ", "telefon", "telefone", "teléfono", "téléphone", "phone", "mobile", "fax:", "hotline", "whatsapp",
    "reach me on ", "reach me at ", "reach us on ", "reach us at ", "ring ", "dial ", "text me ", "cell: ", "rufnummer", "連絡先",
    "ask for ", "llame al ", "llame a ", "ligue para ", "ligue ", "contactez ", "appelez ", "beantwortet ", "rufen sie ", "または", "电话", "電話", "手机", "携帯", "致电", "热线",
)
ID_CUES = (
    "tax number", "tax id", "national id", "passport", "social security", "ssn", "insurance number", "identity number", "identity card", "id card",
    "dni", "nie ", "nif", "cpf", "número de contribuinte", "sécurité sociale", "passeport", "carte d'identité", "numéro fiscal", "steuer-id", "steuernummer",
    "steueridentifikationsnummer", "sozialversicherungsnummer", "personalausweis", "reisepass", "ausweisnummer", "pasaporte", "passaporte",
    "身份证", "护照", "社保号", "マイナンバー", "個人番号", "旅券番号", "パスポート",
)
STREET_WORDS = (
    " street", " st", " avenue", " ave", " road", " rd", " lane", " ln", " boulevard", " blvd", " drive", " court", " way", " square", " terrace", " place",
    " park", " close", " crescent", " gardens", " grove", " hill", " row", " mews",
    "straße ", "strasse ", "str. ", "allee ", "weg ", "gasse ", "platz ", "ring ", "damm ", "ufer ",
    "calle ", "plaza ", "avenida ", "paseo ", "camino ", "rua ", "travessa ", "praça ", "alameda ", "largo ", "rue ", "quai ", "allée ", "impasse ", "chemin ", "市", "東京都", "北海道", "府", "県",
)
NAME_CUES = (
    "contact: ", "contact ", "signed-off-by: ", "reviewed-by: ", "co-authored-by: ", "author: ", "said ", "says ", "ask for ", "dr. ", "mr. ", "mrs. ", "ms. ", "prof. ",
    "reporter\": \"", "author\": \"", "name\": \"", "owner\": \"", "copies to ", "attention of ", "next to ", "written by ", "sagte ", "beantwortet ", "händen von ", "herr ", "herrn ", "frau ",
    "contactez ", "a déclaré ", "dijo ", "disse ", "monsieur ", "madame ", "sr. ", "sra. ", "| ", "联系", "作者", "负责人", "登记信息", "姓名", "氏名", "担当者",
    "my colleague ", "colleague ", "colleagues ", "my name is ", "mr ", "mrs ", "ms ", "dr ", "prof ",
)
CLOSINGS = (
    "regards", "sincerely", "best wishes", "cheers,", "yours truly", "freundlichen grüßen", "viele grüße", "cordialement", "bien à vous", "saludos", "atentamente", "atenciosamente", "cumprimentos",
)

_AT = r"\s?(?:\[at\]|\(at\)|\{at\}|&#64;|[@＠])\s?| at "
_DOT = r"(?:\.|\s?(?:\[dot\]|\(dot\)|\{dot\})\s?)"
_EMAIL_RIGHT = re.compile(rf"(?:{_AT})(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?{_DOT})+[A-Za-z]{{2,24}}(?![A-Za-z0-9_-])", re.I)
_SPOKEN_RIGHT = re.compile(r" at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)* dot [A-Za-z]{2,24}(?![A-Za-z0-9_-])", re.I)
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOT_WORDS = ("(dot)", "[dot]", "{dot}")

_PHONE = re.compile(
    r"(?<![A-Za-z0-9_.+/-])(?:(?:\+|00)\d{1,3}[ .\-]?)?(?:[(（]\d{1,5}[)）][ .\-]?)?\d{1,11}(?:[ .\-/]\d{1,8}){0,6}(?![A-Za-z0-9_])"
    r"(?:,?\s?(?:ext\.?|x|durchwahl|poste|ramal|转|分机)\s?\d{1,6}(?!\d))?",
    re.I,
)
# National notations that are telephone numbers without any word to announce them (North America, Great Britain,
# France, Japan, China).
_BARE_PHONE = re.compile(
    r"(?<![\w.+/(-])(?:(?:\([2-9]\d{2}\) ?|[2-9]\d{2}-)[2-9]\d{2}-\d{4}|0\d{2} \d{4} \d{4}|0\d{3} \d{3} \d{4}|0\d{4} \d{6}|0[1-9](?: \d{2}){4}|0\d{1,3}-\d{1,4}-\d{4}|1[3-9]\d-\d{4}-\d{4})(?![\w/-]|\.\d| \d)"
)
_DIGIT = re.compile(r"\d")
_EXT = re.compile(r",?\s?(?:ext\.?|x|durchwahl|poste|ramal|转|分机)\s?\d{1,6}$", re.I)

_ID = re.compile(r"(?<![A-Za-z0-9])(?!ID\b)(?:[A-Z]{1,3}[ -]?)?\d+(?:([ .\-/])\d+(?:\1\d+)*(?:-\d{1,2}(?!\d))?)?(?:[ -]?[A-Z](?![A-Za-z]))?(?![A-Za-z0-9])")

_CAPS = r"[A-ZÀ-ÖØ-Þ](?:['’]?[a-zß-öø-ÿ]+|['’]?[A-ZÀ-ÖØ-Þ]+)"
_PARTICLE = r"(?:van der|van den|van de|van|von der|von|zu|de la|de los|del|de|da|dos|do|di|du|la|le|bin|ibn|el|ten|ter)"
_NAME = re.compile(
    rf"(?:{_CAPS}(?:-{_CAPS})?|[A-Z]\.)(?: (?:[A-Z]\.|{_CAPS}(?=[ ]{_CAPS})))?(?: (?i:{_PARTICLE}))? (?:(?i:al-|el-)|[DO]['’]|Mc|Mac)?{_CAPS}(?:-(?:(?i:al-|el-))?{_CAPS})?(?![\w-])"
)
_NAME_BEFORE = re.compile(rf"(?<![\w.-])({_NAME.pattern})[\"']?,? ?$")
_HAN_NAME_TITLED = re.compile(r"(?<![一-鿿])([一-鿿]{1,3}[ \u3000][一-鿿]{1,3})(?:さん|様|氏)")
_SIGNATURE = re.compile(r"[ \t]*[,.!]?\s*(?:[-—–]+\s*)?")
_HAN_NAME = re.compile(r"[：:\s]*([一-鿿]{2,4}?)(?=[，。,、；;：:\s（(]|说|表示|$)")
_AND_NAME = re.compile(r"(?:,| and| et| und| y| e| &) (?:(?:Dr|Mr|Mrs|Ms|Prof)\. )?")

_UNIT = r"(?:,?\s(?:Apt\.?|Apartment|Suite|Ste\.?|Unit|Flat|Floor|Room|#)\s?#?[\w-]+)?"
_TOWN = rf"{_CAPS}(?:[ -]{_CAPS}){{0,2}}"
#: Addresses by the language of their street word.
_ADDRESSES = {
    "en": re.compile(
        rf"\d{{1,5}}[A-Za-z]?,? (?:{_CAPS} ){{1,3}}(?i:street|st|avenue|ave|road|rd|lane|ln|boulevard|blvd|drive|dr|court|ct|way|square|sq|terrace|place|pl|park|close|crescent|gardens|grove|hill|row|mews)\b\.?{_UNIT}"
        rf"(?:,?\s+{_TOWN}(?:,? [A-Z]{{2}})?,?\s+(?:\d{{5}}(?:-\d{{4}})?|[A-Z]{{1,2}}\d[A-Z\d]? ?\d[A-Z]{{2}})(?!\w)|,\s+{_TOWN})"
    ),
    "de": re.compile(rf"{_CAPS}(?:[ -]{_CAPS})?-?(?i:straße|strasse|str\.|allee|weg|gasse|platz|ring|damm|ufer) \d{{1,4}}(?:\s?[a-z]\b)?,?\s+\d{{4,5}} {_TOWN}"),
    "es": re.compile(
        rf"(?:Calle|Plaza|Avenida|Av\.|Paseo|Camino|Rua|Travessa|Praça|PraÃ§a|Alameda|Largo)(?: (?:de la|de los|de|del|da|do|dos|das))? {_TOWN},? (?:n\.º )?\d{{1,5}}"
        rf"(?:\s?[a-zA-Z]\b)?(?:,\s\d{{1,2}}\.?(?:º|ª|Âº|Âª|o|a)(?: \w+)?)?,?\s+\d{{4,5}}(?:-\d{{3}})? {_TOWN}"
    ),
    "fr": re.compile(rf"\d{{1,4}}(?: bis| ter)?,? (?i:rue|avenue|boulevard|place|quai|allée|impasse|chemin)(?: (?:de la|de l['’]|des|du|de))? ?{_TOWN},?\s+\d{{5}} {_TOWN}"),
    "zh": re.compile(r"(?!(?:住在|位于|地址|居住|寄往|寄到|来自))(?!在|于|到|至|住)[一-鿿]{2,4}?市(?:[一-鿿]{1,6}?[区县])?[一-鿿]{1,8}?(?:路|街|道|巷|大道)\d{1,5}号(?:院)?(?:\d{1,4}(?:号楼|栋|幢|座|单元))?(?:\d{1,4}层)?(?:\d{1,5}(?:室|楼|房))?"),
    "ja": re.compile(r"(?:〒\s?\d{3}-\d{4}\s?)?(?:東京都|北海道|(?:京都|大阪)府|[一-鿿]{2,3}県)[一-鿿ぁ-んァ-ヶ]{1,8}?[市区町村郡][一-鿿ぁ-んァ-ヶ]{0,12}\d{1,4}(?:(?:丁目|番地|番|号|[-−‐ー]|の)(?:\d{1,4})?){0,4}(?:号室|室)?"),
}
# Languages of street words that are none of English.
_STREET_LANGUAGE = {
    **dict.fromkeys(("straße ", "strasse ", "str. ", "allee ", "weg ", "gasse ", "platz ", "ring ", "damm ", "ufer "), "de"),
    **dict.fromkeys(("calle ", "plaza ", "avenida ", "paseo ", "camino ", "rua ", "travessa ", "praça ", "alameda ", "largo "), "es"),
    **dict.fromkeys(("rue ", "quai ", "allée ", "impasse ", "chemin "), "fr"), "市": "zh", **dict.fromkeys(("東京都", "北海道", "府", "県"), "ja"),
}
#: Characters around a street word within which an address lies: three words and a number before it, unit, town and code after it.
_ADDRESS_BEFORE, _ADDRESS_AFTER = 160, 240

# Account numbers, and the words that end no sentence although a full stop follows.
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_CARD = re.compile(r"(?<![\w.-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?![\w-])")
_STOP = re.compile(r"\n|[。！？]|[!?;](?=\s)|(?<!\bno)(?<!\bnr)(?<!\bnum)(?<!\bnúm)(?<!\btel)(?<!\bdr)(?<!\bmr)(?<!\bms)(?<!\bst)(?<!\b[a-z])\.(?=\s)", re.I)
#: Words between an announcing word and its number.
PHONE_REACH, ID_REACH = 12, 6


def _iban_ok(found: str) -> bool:
    x = found.replace(" ", "")
    return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def _luhn_ok(found: str) -> bool:
    digits = [int(c) for c in found if c.isdigit()][::-1]
    return 12 <= len(digits) <= 19 and (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def _check_digits_ok(cue: str, found: str) -> bool:
    """Whether a Spanish identity number has the letter that its digits give; true for other kinds, whose announced numbers
    are personal even with a wrong digit."""
    x = re.sub(r"[ .\-/]", "", found).upper()
    if cue in ("dni", "nie ", "nif") and (m := re.fullmatch(r"([XYZ]?)(\d{7,8})([A-Z])", x)):
        return "TRWAGMYFPDXBNJZSQVHLCKE"[int({"": "", "X": "0", "Y": "1", "Z": "2"}[m[1]] + m[2]) % 23] == m[3]
    return True


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    kinds: dict[str, set[str]] = {}
    for kind, words in (("email", AT_SIGNS), ("phone", PHONE_CUES), ("id_number", ID_CUES), ("address", STREET_WORDS), ("name", NAME_CUES), ("closing", CLOSINGS)):
        for word in words:
            kinds.setdefault(word, set()).add(kind)
            if not word.isascii() and kind != "email":
                # as it looks after one decoding too few
                kinds.setdefault(word.encode().decode("cp1252", "replace").lower(), set()).add(kind)
    kinds.setdefault("+", set()).add("phone")
    machine = ahocorasick.Automaton()
    for word, of in kinds.items():
        machine.add_word(word, (len(word), word, tuple(sorted(of))))
    machine.make_automaton()
    return machine


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def _local_start(text: str, end: int, spoken: bool) -> int:
    """Where the part of a mailbox before its at-sign begins; ``end`` if there is none."""
    start = end
    while start:
        if text[start - 1] in _LOCAL_CHARS:
            start -= 1
        elif text[max(0, start - 5) : start].lower() in _DOT_WORDS and start < end:
            start -= 5
        elif spoken and text[max(0, start - 5) : start].lower() == " dot " and start < end:
            start -= 5
        else:
            break
    while start < end and not text[start].isalnum():
        start += 5 if text[start : start + 5].lower() in _DOT_WORDS else 1
    return start if start < end and text[end - 1].isascii() and text[end - 1].isalnum() else end


def _email(text: str, at: int) -> tuple[int, int] | None:
    """The mailbox around an at-sign that begins at ``at``."""
    begin = at - 1 if at and text[at - 1] == " " and text[at : at + 1] in "[({&＠@" else at
    right = (_SPOKEN_RIGHT if text[at] == " " else _EMAIL_RIGHT).match(text, begin)
    if not right:
        return None
    start, end = _local_start(text, begin, text[at] == " "), right.end()
    if start == begin:
        return None
    before = text[start - 1] if start else " "
    if before in "@/＠" or (before == ":" and text[max(0, start - 3) : start - 1].endswith("/")) or text[max(0, start - 3) : start] == "://":
        return None  # a package, a handle or part of an address of a site
    if end < len(text) and (text[end] in "/@" or (text[end] == ":" and end + 1 < len(text) and not text[end + 1].isspace())):
        return None  # a repository
    return start, end


def _digits(text: str) -> int:
    return len(_DIGIT.findall(text))


def _phone_ok(found: str) -> bool:
    body = _EXT.sub("", found)
    count = _digits(body)
    if not 8 <= count <= 15:
        return False
    if body.startswith(("+", "00", "(", "（")):
        return True
    groups = re.split(r"[ .\-/]", body)
    if len(groups) == 1:
        return 9 <= count <= 11
    if [len(g) for g in groups] in ([4, 2, 2], [3, 2, 4]) or max(map(len, groups)) > 8:
        return False  # a date, a national number
    return True


class _Reader:
    """A text with its next digits and sentence ends, which are looked up once as the anchors move along."""

    def __init__(self, text: str):
        self.text, self._digit, self._stop = text, -1, -1

    def digit(self, at: int) -> int:
        """The first digit from ``at`` on; the text's length if there is none."""
        if self._digit < at:
            m = _DIGIT.search(self.text, at)
            self._digit = m.start() if m else len(self.text)
        return self._digit

    def announced(self, cue_end: int, number: int, words: int) -> bool:
        """Whether a number lies in the sentence of the word before it and not too many words away."""
        if self._stop < cue_end:
            m = _STOP.search(self.text, cue_end)
            self._stop = m.start() if m else len(self.text)
        return self._stop >= number and number - cue_end <= 40 * words and len(self.text[cue_end:number].split()) <= words


_AFTER_NUMBER = re.compile(r"[.\-/]\d|\s?(?:ms|s|MB|GB|%)\b")


def _phone(reader: _Reader, start: int, cue_end: int) -> tuple[int, int] | None:
    """The number that a cue announces: the first one of its sentence."""
    text, digit = reader.text, reader.digit(cue_end)
    if digit >= len(text) or not reader.announced(cue_end, digit, PHONE_REACH):
        return None
    for p in range(max(start, digit - 2), digit + 1):
        if m := _PHONE.match(text, p):
            return m.span() if _phone_ok(m[0]) and not _AFTER_NUMBER.match(text, m.end()) else None
    return None


def _id_number(reader: _Reader, cue: str, cue_end: int) -> tuple[int, int] | None:
    text, digit = reader.text, reader.digit(cue_end)
    if digit >= len(text):
        return None
    for p in range(max(cue_end, digit - 4), digit + 1):
        if m := _ID.match(text, p):
            if 6 <= _digits(m[0]) <= 18 and reader.announced(cue_end, m.start(), ID_REACH) and _check_digits_ok(cue, m[0]):
                return m.span()
            return None
    return None


def _address(text: str, at: int, word: str) -> tuple[int, int] | None:
    """The address whose street word lies at ``at``."""
    languages = [_STREET_LANGUAGE[word]] if word in _STREET_LANGUAGE else ["en", "fr"] if word.strip() in ("avenue", "boulevard", "place") else ["en"]
    for language in languages:
        pattern, pos = _ADDRESSES[language], max(0, at - (16 if language in ("zh", "ja") else _ADDRESS_BEFORE))
        while m := pattern.search(text, pos, min(len(text), at + _ADDRESS_AFTER)):
            if m.start() > at + 1:
                break
            if m.end() > at:
                return m.span()
            pos = m.start() + 1
    return None


def _names(text: str, cue: str, cue_end: int) -> list[tuple[int, int]]:
    """The person, or the persons joined by "and", that a cue announces."""
    if cue in ("氏名", "担当者"):
        m = re.compile(r"[：:は\s]*([一-鿿]{1,3}[ \u3000]?[一-鿿]{1,3})(?![一-鿿])").match(text, cue_end)
        return [m.span(1)] if m else []
    if cue in ("联系", "作者", "负责人", "登记信息", "姓名"):
        m = _HAN_NAME.match(text, cue_end)
        if not m:
            return []
        if cue == "联系" and not re.match(r"[，,]\s?(?:电话|手机|邮箱)", text[m.end(1) : m.end(1) + 6]):
            return []
        return [m.span(1)]
    found = []
    m = _NAME.match(text, cue_end)
    if m and cue == "| " and not re.match(r" \| \S+(?:@|＠| ?\[at\]| ?\(at\))", text[m.end() : m.end() + 80]):
        return []
    while m:
        found.append(m.span())
        link = _AND_NAME.match(text, m.end()) if cue in _TITLES or cue in ("said ", "contact: ") else None
        m = _NAME.match(text, link.end()) if link else None
    return found


_TITLES = frozenset(("dr. ", "mr. ", "mrs. ", "ms. ", "prof. ", "sr. ", "sra. ", "herr ", "herrn ", "frau ", "mr ", "mrs ", "ms ", "dr ", "prof "))
_AFTER_ID = re.compile(r" (?:de|of|von|for|belongs to|belonging to|gehört|pertenece a|pertence a|appartient à) ")


def find_pii(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every find, in order, none overlapping another."""
    low, reader = _lower(text), _Reader(text)
    found: set[tuple[str, int, int]] = set()
    phone_until = -1
    for last, (length, word, kinds) in _automaton().iter(low):
        start, end = last - length + 1, last + 1
        inside = start and word[0].isascii() and word[0].isalpha() and low[start - 1].isascii() and low[start - 1].isalnum()
        for kind in kinds:
            if inside and kind in ("phone", "id_number", "name", "closing"):
                continue
            if kind == "email":
                span = _email(text, start)
                if span and span[0] and text[span[0] - 1] == "<" and (m := _NAME_BEFORE.search(text, max(0, span[0] - 161), span[0] - 1)):
                    found.add(("name", *m.span(1)))
            elif kind == "phone":
                if low[start] == "+":
                    span = _phone(reader, start, start) if end < len(low) and (low[end].isdigit() or low[end] in "(（") else None
                else:
                    span = _phone(reader, end, end)
            elif kind == "id_number":
                span = _id_number(reader, word, end)
                if span and (m := _AFTER_ID.match(text, span[1])) and (name := _NAME.match(text, m.end())):
                    found.add(("name", *name.span()))
            elif kind == "address":
                span = _address(text, start, word) if start > phone_until else None
                if span:
                    phone_until = span[1]
            elif kind == "closing":
                # the name on the line below
                if (m := _SIGNATURE.match(text, end)) and "\n" in m[0] and (name := _NAME.match(text, m.end())) and text[name.end() : name.end() + 1] in ("", "\n", "\r"):
                    found.add(("name", *name.span()))
                continue
            else:
                if word in _TITLES and not text[start].isupper():
                    continue
                for span in _names(text, word, end):
                    found.add(("name", *span))
                continue
            if span:
                found.add((kind, *span))
    found |= {("phone", *m.span()) for m in _BARE_PHONE.finditer(text) if not _AFTER_NUMBER.match(text, m.end())}
    found |= {("account", *m.span()) for m in _IBAN.finditer(text) if _iban_ok(m[0])} | {("account", *m.span()) for m in _CARD.finditer(text) if _luhn_ok(m[0]) and "card" in low[max(0, m.start() - 40) : m.start()]}
    if "さん" in text or "様" in text or "氏" in text:
        found |= {("name", *m.span(1)) for m in _HAN_NAME_TITLED.finditer(text)}
    taken: list[tuple[str, int, int]] = []
    for kind, a, b in sorted(found, key=lambda x: (KINDS.index(x[0]), x[1] - x[2], x[1])):
        if all(b <= c or a >= d for _, c, d in taken):
            taken.append((kind, a, b))
    return sorted(taken, key=lambda x: x[1])


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with ``[EMAIL]``, ``[PHONE]`` and so on in the places of the finds."""
    parts, at = [], 0
    for kind, a, b in found:
        parts += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(parts) + text[at:]


_FINDS = pa.list_(pa.struct([("kind", pa.string()), ("pii_text", pa.string())]))


def _scan(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            finds, texts = [], []
            for text in batch.column(1).to_pylist():
                found = find_pii(text) if text else []
                finds.append([{"kind": k, "pii_text": text[a:b]} for k, a, b in found])
                if with_text:
                    texts.append(redact(text, found) if found else text)
            columns = [batch.column(0), pa.array(finds, _FINDS)] + ([pa.array(texts, pa.string())] if with_text else [])
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "finds", "clean_text"][: len(columns)])

    return run


def scan_documents(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """(doc_id, finds, clean_text): the finds of each document and its text with typed placeholders.

    Null texts stay null and empty ones empty, both without finds; texts are read whole, however long; repeated rows
    are each answered; an empty table gives an empty result; other columns are ignored.
    """
    schema = "doc_id bigint, finds array<struct<kind:string,pii_text:string>>" + (", clean_text string" if with_text else "")
    return docs.select("doc_id", "text").mapInArrow(_scan(with_text), schema)


def distinct_finds(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, pii_text), each distinct find of a document once; account numbers, which are no personal detail of the
    five kinds asked for, are only replaced in the text."""
    finds = scan_documents(docs, with_text=False)
    return finds.select("doc_id", F.explode(F.array_distinct("finds")).alias("f")).select("doc_id", "f.kind", "f.pii_text").where("kind <> 'account'").distinct()
