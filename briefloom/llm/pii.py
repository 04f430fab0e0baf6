"""Personal information in free text: mail addresses, phone numbers, identity numbers, street addresses and names.

A text is first rewritten by transducers that keep, for every character they write, the place it came from: look-alike
and full-width letters to Latin, invisible characters to nothing, all blanks to one, "(at)" and "[dot]" to their signs,
spelled digits to digits.  Detectors run on that form; their spans are mapped back to the source, so that offsets and
placeholders are exact in the text as stored.

Names come from a gazetteer of given and family names that the columns of persons give over all their rows.  Its words
are marked in the texts first, in as many passes as its size needs; what the marks mean, and which mentions overlap, is
settled once with all marks of a text, so that the passes change nothing.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored
from .normalize import LOOK_ALIKES, _one

#: Names that one pass carries to the tasks, over the driver; a larger gazetteer takes several passes, one after another.
BLOCK = 500_000
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}

#: IBAN lengths by country.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24}
_DIGIT_WORDS = dict(zip("zero one two three four five six seven eight nine".split(), "0123456789")) | {"oh": "0"}

# A gap inside a mention: blanks, or a line break with the quotation marks of the next line.
_GAP = r"(?:[ ]+|[ ]*\n[>| ]*)"
_OPT = r"(?:[ ]*\n[>| ]*|[ ]*)"
_BLANK_SEP = r"(?:[ ]?[.\-/][ ]?|[ ])"
_SEP = r"(?:[ ]?[.\-/][ ]?|[ ]|[ ]*\n[>| ]*)"
_CAP = r"[^\W\d_a-zà-ÿ][\w'’\-]*"

_EMAIL = re.compile(r"(?<![\w.%+\-])[\w%+][\w.%+\-]*@(?:[^\W_](?:[\w\-]*[^\W_])?\.)+[^\W\d_]{2,}")
_AT = re.compile(rf"(?<=[\w]){_OPT}(?:[(\[{{<]{_OPT}at{_OPT}[)\]}}>]){_OPT}(?=\w)", re.I)
_DOT = re.compile(rf"(?<=[\w]){_OPT}(?:[(\[{{<]{_OPT}(?:dot|punkt|point|punto){_OPT}[)\]}}>]){_OPT}(?=\w)", re.I)
_WORD_AT = re.compile(r"(?<=[\w]) at (?=[\w\-]+(?: dot [\w\-]+)+)", re.I)
_WORD_DOT = re.compile(r"(?<=@)([\w\-]+)((?: dot [\w\-]+)+)", re.I)
_SPELLED = re.compile(rf"\b(?:{'|'.join(_DIGIT_WORDS)})(?:[ \-]+(?:{'|'.join(_DIGIT_WORDS)})){{6,}}\b", re.I)
_IBAN = re.compile(rf"(?<![\w])[A-Z]{{2}}\d{{2}}(?:{_SEP}?[A-Z0-9]{{4}}){{2,7}}(?:{_SEP}?[A-Z0-9]{{1,3}})?(?![A-Z0-9])")
_CARD = re.compile(rf"(?<![\w.\-+(])(?:\d{{4}}(?:{_SEP}\d{{4}}){{3}}|\d{{4}}{_SEP}\d{{6}}{_SEP}\d{{5}}|\d{{13,19}})(?![\w])")
_SSN = re.compile(rf"(?<![\w\-])\d{{3}}(?P<s>-|{_GAP})\d{{2}}(?P=s)\d{{4}}(?![\w\-])")
_PASSPORT = re.compile(rf"(?:passport|passeport|reisepass(?:nummer)?|pasaporte)(?:{_GAP}(?:no\.?|number|nr\.?|num\.?|#))?{_OPT}:?{_OPT}(?-i:(?P<n>(?=[A-Z0-9]*\d[A-Z0-9]*\d)[A-Z0-9]{{6,9}}))(?!\w)", re.I)
def _phone(sep: str) -> re.Pattern:
    return re.compile(
        rf"(?<![\w+@#])(?<!\d[ .\-/])(?:"
        rf"(?:\+|00)[1-9]\d{{0,2}}(?:{sep}?\(\d{{1,4}}\))?(?:{sep}?\d+){{2,7}}"
        rf"|(?:1{sep})?(?:\([2-9]\d\d\){_OPT}|[2-9]\d\d{sep})\d{{3}}{sep}\d{{4}}"
        rf"|0[1-9](?:{sep}?\d\d){{4}}"
        rf"|\(?0[1-9]\d{{1,4}}\)?{sep}\d{{3,}}(?:{_BLANK_SEP}\d{{2,}}){{0,2}}"
        rf")(?![\w])(?![.\-]\d)"
    )


#: Within one line; and over a line break, for a number that would be too short without.
_PHONE, _WRAPPED_PHONE, _FULL_PHONE = _phone(_BLANK_SEP), _phone(_SEP), 10
#: A shorter number within one line: with a country code, a bracketed or slashed area code, 9 digits in groups, or after such a word.
_CLEAR_PHONE = re.compile(r"\+|\(0|0\d+ ?/|(?=(?:\D*\d){9})0\d+[ .\-(]")
_PHONE_WORD = re.compile(r"(?:phone|tel|fon|telefon|téléphone|teléfono|mobile?|handy|fax|cell|call)[.:]* ?$", re.I)
#: How an IBAN begins.
_IBAN_CUE = re.compile(r"(?<!\w)[A-Z]{2}\d{2}")
_KINDS_EN = r"(?:Street|St\.?|Avenue|Ave\.?|Road|Rd\.?|Lane|Ln\.?|Drive|Dr\.?|Court|Ct\.?|Boulevard|Blvd\.?|Way|Place|Pl\.?|Square|Sq\.?|Terrace|Close|Crescent|Highway|Hwy\.?|Parkway|Row)"
_KINDS_FR = r"(?:rue|avenue|av\.|boulevard|bd\.?|place|chemin|impasse|allée|quai|route|cours|square|passage)"
_KINDS_ES = r"(?:Calle|C/|Avenida|Avda\.?|Av\.|Plaza|Paseo|Camino|Carretera|Ronda|Travesía)"
_KINDS_DE = r"(?:straße|strasse|str\.|weg|platz|gasse|allee|ring|damm|ufer)"
_OF = rf"(?:(?:de{_GAP}la|de{_GAP}los|de{_GAP}las|del|des|de|du|d'|l')(?:{_GAP}|(?<='))){{0,1}}"
_TAIL = rf"(?:,{_GAP}(?:(?:Apt|Flat|Unit|Suite|Apartment|Floor|Room|piso|Wohnung)\.?{_GAP}\w+|#{_OPT}\w+|\d{{1,2}}\.?[ºª°](?:{_GAP}\w{{1,3}}\b)?))?(?:,{_GAP}(?:\d{{4,5}}{_GAP}{_CAP}|{_CAP}(?:{_GAP}\d{{4,5}}(?!\d))?))?"
#: What a text with such an address holds, for a quick look before.
_CUES_EN = ("Street", "St", "Ave", "Road", "Rd", "Lane", "Ln", "Drive", "Dr.", "Court", "Ct", "Boulevard", "Blvd", "Way", "Place", "Pl.", "Square", "Sq", "Terrace", "Close", "Crescent", "Highway", "Hwy", "Parkway", "Row")
_CUES_FR = ("rue", "Rue", "RUE", "venue", "av.", "Av.", "oulevard", "bd", "Bd", "place", "Place", "hemin", "mpasse", "llée", "uai", "oute", "ours", "quare", "assage")
_CUES_ES = ("Calle", "calle", "CALLE", "C/", "c/", "Aven", "aven", "AVEN", "Avda", "avda", "Av.", "av.", "Plaza", "plaza", "Paseo", "paseo", "Camino", "camino", "Carretera", "carretera", "Ronda", "ronda", "Traves", "traves")
_CUES_DE = ("straße", "strasse", "str.", "Straße", "Strasse", "Str.", "weg", "Weg", "platz", "Platz", "gasse", "Gasse", "allee", "Allee", "ring", "Ring", "damm", "Damm", "ufer", "Ufer", "STRASSE", "STRAßE")
_ADDRESSES = [
    (re.compile(rf"(?<![\w\-/.])\d{{1,5}}[a-z]?(?:{_GAP}{_CAP}){{1,3}}{_GAP}(?-i:{_KINDS_EN})(?!\w){_TAIL}"), _CUES_EN, None),
    (re.compile(rf"(?<![\w\-/.])\d{{1,4}}(?:{_GAP}(?:bis|ter|quater))?,?{_GAP}(?i:{_KINDS_FR}){_GAP}{_OF}{_CAP}{_TAIL}"), _CUES_FR, None),
    (re.compile(rf"(?<!\w)(?i:{_KINDS_ES}){_GAP}{_OF}{_CAP}(?:{_GAP}{_CAP})?,?{_GAP}(?:n\.?º{_OPT})?\d{{1,4}}(?!\d){_TAIL}"), _CUES_ES, None),
    (re.compile(rf"(?<!\w){_CAP}(?:{_GAP}(?i:{_KINDS_DE})|(?<=\w)(?:(?<={'straße'})|(?<={'strasse'})|(?<={'weg'})|(?<={'platz'})|(?<={'gasse'})|(?<={'allee'})|(?<={'ring'})|(?<={'damm'})|(?<={'ufer'})|(?<={'str'})\.)){_GAP}\d{{1,4}}(?:{_OPT}[a-z])?(?!\w){_TAIL}"), _CUES_DE, re.compile(rf"{_KINDS_DE}{_GAP}\d", re.I)),
]
#: Seven digits close together: only around these can there be numbers.
_CLUSTER = re.compile(r"(?:\d[ \-().\/\n>|]*){7,}")
_PASSPORTS = ("passport", "passeport", "reisepass", "pasaporte")
_NEXT = re.compile(rf"{_GAP}(?:[^\W\d_]\.{_GAP})?([^\W\d_][^\W\d_'’\-]*(?:[\-'’][^\W\d_]+)*)")
_BEFORE = re.compile(rf"(?:,{_GAP}|{_GAP})$")
_INITIAL = re.compile(rf"(?<![\w.'’])[^\W\d_]\.{_OPT}(?:[^\W\d_]\.{_OPT})?$")
_AFTER_INITIAL = re.compile(rf",?{_GAP}[^\W\d_]\.(?!\w)")
_CHANGES = re.compile(r"[^\x00-\x08\x0b\x0c\x0e-\x7e\n¡-¬®-ɏ]")


@cache
def _sign(ch: str) -> str:
    """What a character reads as; only one-to-one and one-to-none rewritings, marks are left to the words."""
    if ch == "\r":
        return ""
    to = unicodedata.normalize("NFC", _one(ch))
    if to == " " or not to:
        return to
    return LOOK_ALIKES.get(ch, to)


_DISGUISES = [a + b + "at" for a in "([{<" for b in ("", " ")]


def shown(text: str) -> tuple[str, list[int] | None]:
    """The text with its characters as they read, and the source place of each (None: unchanged)."""
    places: list[int] | None = None
    if (not text.isascii() or "\r" in text or "\t" in text) and _CHANGES.search(text):
        out, places, done = [], [], 0
        for m in _CHANGES.finditer(text):
            k = m.start()
            if k > done:
                out.append(text[done:k])
                places.extend(range(done, k))
            done = k + 1
            for x in _sign(m.group()):
                if unicodedata.combining(x) and out and out[-1]:
                    both = unicodedata.normalize("NFC", out[-1][-1] + x)
                    if len(both) == 1:
                        out[-1] = out[-1][:-1] + both
                        continue
                out.append(x)
                places.append(k)
        out.append(text[done:])
        places.extend(range(done, len(text)))
        text = "".join(out)
    return text, places


def readable(text: str) -> tuple[str, list[int] | None]:
    """The text as it reads, disguised signs and spelled digits undone, and the source place of each of its characters
    (None: unchanged)."""
    text, places = shown(text)
    low = text.lower()
    if any(x in low for x in _DISGUISES):
        text, places = _rewritten(text, places, _AT, "@")
        text, places = _rewritten(text, places, _DOT, ".")
    if " at " in low and " dot " in low:
        text, places = _rewritten(text, places, _WORD_AT, "@")
        text, places = _rewritten(text, places, _WORD_DOT, None)
    if sum(low.count(x) for x in _DIGIT_WORDS) >= 7:
        text, places = _rewritten(text, places, _SPELLED, None)
    return text, places


def _rewritten(text: str, places: list[int] | None, pattern: re.Pattern, to: str | None) -> tuple[str, list[int] | None]:
    if not (found := list(pattern.finditer(text))):
        return text, places
    places = list(range(len(text))) if places is None else places
    out, at, done = [], [], 0
    for m in found:
        if pattern is _WORD_DOT:
            new, new_at = [], []
            for part in re.finditer(r" dot |[\w\-]+", m.group(), re.I):
                sign = "." if part.group()[0] == " " else part.group()
                new.append(sign)
                new_at += [places[m.start() + part.start()]] if sign == "." else places[m.start() + part.start() : m.start() + part.end()]
        elif to is None:
            new, new_at = [], []
            for part in re.finditer(r"[a-z]+", m.group(), re.I):
                new.append(_DIGIT_WORDS[part.group().lower()])
                new_at.append(places[m.start() + part.start()])
        else:
            new, new_at = [to], [places[m.start()]]
        out += [text[done : m.start()], *new]
        at += places[done : m.start()] + new_at
        done = m.end()
    return "".join([*out, text[done:]]), at + places[done:]


def _luhn(digits: str) -> bool:
    total = sum(int(x) for x in digits[-1::-2]) + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return total % 10 == 0 and len(set(digits)) > 1


def _iban(chars: str) -> bool:
    return IBAN_LENGTHS.get(chars[:2], len(chars)) == len(chars) and int("".join(str(int(x, 36)) for x in chars[4:] + chars[:4])) % 97 == 1


def _plain(name: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", name.lower()) if not unicodedata.combining(x))


class _Fold(dict):
    """Every code point to one: its lower case without accents."""

    def __missing__(self, n: int) -> str:
        self[n] = _plain(chr(n))[:1] or " "
        return self[n]


_FOLD = _Fold()


Mark = tuple[int, int, bool, bool]


class Gazetteer:
    """Words of one block, to be marked in texts."""

    def __init__(self, given: list[str], family: list[str]):
        self.given, self.family = {_plain(x) for x in given}, {_plain(x) for x in family}
        self._names = None

    def __getstate__(self):
        return {"given": self.given, "family": self.family, "_names": None}

    def marks(self, form: str) -> list[Mark]:
        """(start, end, given, family) of the whole words of a readable text that the block holds."""
        if not self.given and not self.family:
            return []
        low = form.lower() if form.isascii() else form.translate(_FOLD)
        if self._names is None:
            self._names = ahocorasick.Automaton()
            for x in self.given | self.family:
                self._names.add_word(x, len(x))
            self._names.make_automaton()
        out = []
        for last, n in self._names.iter(low):
            a, b = last - n + 1, last + 1
            if (a and (low[a - 1].isalnum() or low[a - 1] == "_")) or (b < len(low) and (low[b].isalnum() or low[b] == "_")):
                continue
            word = low[a:b]
            out.append((a, b, word in self.given, word in self.family))
        return out


def names(text: str, marks: list[Mark]) -> list[tuple[str, int, int]]:
    """The names that marked words of a readable text make up; marks of a word may come from several blocks."""
    by: dict[tuple[int, int], list[bool]] = {}
    for a, b, g, f in marks:
        kinds = by.setdefault((a, b), [False, False])
        kinds[0] |= g
        kinds[1] |= f
    firsts = sorted(x for x, (g, _) in by.items() if g)
    starts: dict[int, list[int]] = {}
    ends: dict[int, int] = {}
    for (a, b), (_, f) in sorted(by.items(), key=lambda x: (x[0][1], -x[0][0])):
        if f:
            ends[b] = a  # of words that end at one place the longest
            starts.setdefault(a, []).append(b)
    family = lambda m: m.end(1) in starts.get(m.start(1), ())
    out, taken = [], 0
    for a, b in firsts:
        if a < taken or (a and text[a - 1] in "@.-+" and (a < 2 or text[a - 2] != " ")) or (b < len(text) and text[b] == "@"):
            continue
        m = _NEXT.match(text, b)
        if m and family(m) and not (m.end() < len(text) and text[m.end()] == "@"):
            out.append(("name", a, m.end()))
            taken = m.end()
            continue
        m = _BEFORE.search(text, max(0, a - 40), a)
        if m and m.start() in ends and ends[m.start()] >= taken and text[max(0, ends[m.start()] - 1)] not in "@.":
            out.append(("name", ends[m.start()], b))
            taken = b
    covered = _Spans()
    for _, a, b in out:
        covered.add(a, b)
    for b, a in ends.items():
        m = _INITIAL.search(text, max(0, a - 12), a)
        if m and covered.add(m.start(), b):
            out.append(("name", m.start(), b))
            continue
        m = _AFTER_INITIAL.match(text, b)
        if m and covered.free(a, m.end()):
            follow = _NEXT.match(text, m.end())
            if not (follow and family(follow)):
                covered.add(a, m.end())
                out.append(("name", a, m.end()))
    return out


class _Spans:
    """Stretches that do not overlap, in order."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return not k or self.ends[k - 1] <= a

    def add(self, a: int, b: int) -> bool:
        """Whether the stretch was free; if so it is taken."""
        if not self.free(a, b):
            return False
        k = bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)
        return True


class _Stretches:
    """Stretches that may overlap: which places they cover, as a merged list in order."""

    def __init__(self, some: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for x in some:
            self.append(x)

    def free(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return not k or self.ends[k - 1] <= a

    def append(self, x: tuple[int, int]) -> None:
        a, b = x
        i, j = bisect_right(self.ends, a), bisect_left(self.starts, b)
        if i < j:
            a, b = min(a, self.starts[i]), max(b, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [a], [b]


_ORDER = {"email": 0, "id": 1, "phone": 2, "address": 3, "name": 4}


class Detector:
    """All detectors with one block of the gazetteer."""

    def __init__(self, given: list[str], family: list[str]):
        self.block = Gazetteer(given, family)

    def spans(self, text: str, marks: list[Mark] | None = None) -> list[tuple[str, int, int]]:
        """(kind, start, end) of each mention in the text as stored, in order, not overlapping; ``marks`` of the readable
        text in place of the block's own."""
        form, places = readable(text)
        found = names(form, self.block.marks(form) if marks is None else marks) + self._others(form)
        taken = _Spans()
        kept = [x for x in sorted(found, key=lambda x: (_ORDER[x[0]], x[1])) if taken.add(x[1], x[2])]
        out, end = [], 0
        for kind, a, b in sorted(kept, key=lambda x: x[1]):
            if places is not None:
                spelled = form[b - 1].isdigit()
                a, b = places[a], places[b - 1] + 1
                while spelled and text[b - 1].isalpha() and b < len(text) and text[b].isalpha():
                    b += 1  # a digit written as a word ends with the word
            if a >= end:
                out.append((kind, a, b))
                end = b
        return out

    def _others(self, t: str) -> list[tuple[str, int, int]]:
        out: list[tuple[str, int, int]] = []
        at = t.find("@")
        while at >= 0:
            a = at
            while a and (t[a - 1] in ".%+-_" or t[a - 1].isalnum()):
                a -= 1
            while a < at and t[a] in ".-":
                a += 1
            m = _EMAIL.match(t, a) if a < at else None
            if m:
                out.append(("email", m.start(), m.end()))
            at = t.find("@", max(at + 1, m.end() if m else 0))
        clusters = [(max(0, m.start() - 5), m.end() + 6) for m in _CLUSTER.finditer(t)]
        kinds = [x for x in _ADDRESSES if any(k in t for k in x[1])]
        low = t.lower()
        iban = _IBAN_CUE.search(t)
        if not clusters and not kinds and not iban and "pas" not in low and "pass" not in low:
            return out
        near = lambda pattern: [m for a, b in clusters for m in pattern.finditer(t, a, min(b, len(t)))]
        blocked = _Stretches([(a, b) for _, a, b in out])
        free = blocked.free
        m = _IBAN.search(t, iban.start()) if iban else None
        while m:
            chars, places = [], []
            for k in range(m.start(), m.end()):
                if t[k].isalnum():
                    chars.append(t[k])
                    places.append(k)
            n = IBAN_LENGTHS.get("".join(chars[:2]), len(chars))
            after = places[3] + 1  # one that is none may hold the start of another
            if n <= len(chars) and _iban("".join(chars[:n])):
                after = places[n - 1] + 1
                out.append(("id", m.start(), after))
                blocked.append((m.start(), after))
            elif "".join(chars[2:]).isdigit():
                blocked.append(m.span())
            elif n <= len(chars) and "".join(chars[:2]) in IBAN_LENGTHS:
                blocked.append((m.start(), places[n - 1] + 1))
            m = _IBAN.search(t, after)
        for m in near(_CARD):
            if not free(*m.span()):
                continue
            places = [k for k in range(m.start(), m.end()) if t[k].isdigit()]
            digits = "".join(t[k] for k in places)
            for n in dict.fromkeys([16, len(digits)]):
                if n <= len(digits) and _luhn(digits[:n]):
                    out.append(("id", m.start(), places[n - 1] + 1))
                    break
            if len(digits) >= 15 or out and out[-1][1] == m.start():
                blocked.append(m.span())
        for m in near(_SSN):
            if free(*m.span()):
                out.append(("id", m.start(), m.end()))
                blocked.append(m.span())
        for m in _PASSPORT.finditer(t) if any(x in low for x in _PASSPORTS) else []:
            if free(*m.span("n")):
                out.append(("id", m.start("n"), m.end("n")))
                blocked.append(m.span("n"))
        digits = lambda m: sum(x.isdigit() for x in m.group())
        phones = [m for m in near(_PHONE) if digits(m) >= _FULL_PHONE]
        taken = _Stretches([m.span() for m in phones])
        if "\n" in t and clusters:
            phones += [m for m in near(_WRAPPED_PHONE) if "\n" in m.group() and taken.free(*m.span())]
        taken = _Stretches([m.span() for m in phones if free(*m.span()) and 8 <= digits(m) <= 16])
        for m in near(_PHONE):
            if 8 <= digits(m) < _FULL_PHONE and (_CLEAR_PHONE.match(m.group()) or _PHONE_WORD.search(t, max(0, m.start() - 12), m.start())) and taken.free(*m.span()):
                phones.append(m)
        for m in phones:
            if free(*m.span()) and 8 <= digits(m) <= 16:
                out.append(("phone", m.start(), m.end()))
                blocked.append(m.span())
        for pattern, _, cue in kinds:
            if cue is None or cue.search(t):
                for m in pattern.finditer(t):
                    if free(*m.span()):
                        out.append(("address", m.start(), m.end()))
                        blocked.append(m.span())
        return out


def name_gazetteer(people: DataFrame, column: str) -> DataFrame:
    """``word, given`` of the given and family names in a column of persons ("Given Family" or "Family, Given"), over
    all rows.  A given name is one that stands with two or more family names; what stands with none of these isn't a person."""
    p = F.regexp_replace(F.trim(F.regexp_replace(column, r"\s+", " ")), r"^(?:Dr|Mr|Mrs|Ms|Prof)\.? ", "")
    word = r"[\p{L}'’\-]{2,}"
    straight, turned = rf"^({word})(?: \p{{L}}\.?)? ({word})$", rf"^({word}), ({word})(?: \p{{L}}\.?)?$"
    pairs = people.select(p.alias("p")).filter("p is not null").distinct().select(
        F.lower(F.when(F.col("p").rlike(turned), F.regexp_extract("p", turned, 2)).otherwise(F.regexp_extract("p", straight, 1))).alias("g"),
        F.lower(F.when(F.col("p").rlike(turned), F.regexp_extract("p", turned, 1)).otherwise(F.regexp_extract("p", straight, 2))).alias("f"),
    ).filter("g <> '' and f <> ''").distinct()
    given = pairs.groupBy("g").agg(F.count("*").alias("n")).filter("n >= 2").select("g")
    family = pairs.join(given, "g", "left_semi").select(F.col("f").alias("word"), F.lit(False).alias("given")).distinct()
    return given.select(F.col("g").alias("word"), F.lit(True).alias("given")).union(family)


def _apply(detector: Detector, masked: bool, marked: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            held = pdf["marks"] if marked else [None] * len(pdf)
            for rec, text, marks in zip(pdf["rec_id"], pdf["text"], held):
                spans = detector.spans(text, [(x["a"], x["b"], x["g"], x["f"]) for x in ([] if marks is None else marks)] if marked else None)
                if masked:
                    out, done = [], 0
                    for kind, a, b in spans:
                        out += [text[done:a], PLACEHOLDERS[kind]]
                        done = b
                    rows.append((rec, "".join([*out, text[done:]]), len(spans)))
                else:
                    rows += [(rec, kind, a, b) for kind, a, b in spans]
            yield pd.DataFrame(rows, columns=["rec_id", "masked", "n_found"] if masked else ["rec_id", "kind", "start_pos", "end_pos"])

    return run


def _marked(block: Gazetteer):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(h, [{"a": a, "b": b, "g": g, "f": f} for a, b, g, f in block.marks(readable(text)[0])]) for h, text in zip(pdf["h"], pdf["text"])]
            yield pd.DataFrame([x for x in rows if x[1]], columns=["h", "marks"])

    return run


def _blocks(gazetteer: DataFrame) -> Iterator[tuple[list[str], list[str], bool]]:
    """The given and family names of each block, and whether it is the last; the driver holds one or two at a time."""
    given: list[str] = []
    family: list[str] = []
    for row in gazetteer.toLocalIterator():  # a partition at a time, short words
        if len(given) + len(family) >= BLOCK:
            yield given, family, False
            given, family = [], []
        (given if row["given"] else family).append(row["word"])
    yield given, family, True


def _through(texts: DataFrame, gazetteer: DataFrame, masked: bool, schema: str) -> DataFrame:
    """The detectors over ``rec_id, text``: in one pass where one block holds the gazetteer, else after a pass for each block."""
    parts: list[DataFrame] = []
    for given, family, last in _blocks(gazetteer):
        if last and not parts:
            return texts.mapInPandas(_apply(Detector(given, family), masked, False), schema)
        once = texts.select(F.xxhash64("text", F.reverse("text")).alias("h"), "text")
        parts.append(stored(once.mapInPandas(_marked(Gazetteer(given, family)), "h long, marks array<struct<a int, b int, g boolean, f boolean>>").dropDuplicates(["h"])))
    marks = parts[0]
    for x in parts[1:]:
        marks = marks.union(x)
    marks = marks.groupBy("h").agg(F.flatten(F.collect_list("marks")).alias("marks"))  # of one text
    rows = texts.withColumn("h", F.xxhash64("text", F.reverse("text"))).join(marks, "h", "left").select("rec_id", "text", "marks")
    return rows.mapInPandas(_apply(Detector([], []), masked, True), schema)


def mentions(df: DataFrame, id_col: str, text_col: str, gazetteer: DataFrame) -> DataFrame:
    """``rec_id, kind, start_pos, end_pos`` of each mention (code points from 0, end exclusive), distinct.

    Rows with a null id or text give none, nor do empty texts; repeated rows count once.
    """
    texts = df.select(F.col(id_col).cast("long").alias("rec_id"), F.col(text_col).alias("text")).filter("rec_id is not null and length(text) > 0")
    return _through(texts, gazetteer, False, "rec_id long, kind string, start_pos int, end_pos int").distinct()


def masked(df: DataFrame, id_col: str, text_col: str, gazetteer: DataFrame) -> DataFrame:
    """``rec_id, masked, n_found``: each non-null text with its mentions replaced by placeholders of their type, the
    rest left as it is; a row for each row of ``df`` with an id and a text."""
    texts = df.select(F.col(id_col).cast("long").alias("rec_id"), F.col(text_col).alias("text")).filter("rec_id is not null and text is not null")
    return _through(texts, gazetteer, True, "rec_id long, masked string, n_found int")
