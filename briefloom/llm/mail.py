"""The newly written part of e-mail bodies.

A line is old for one of three reasons, looked for in this order.  Inheritance: a generalised suffix automaton of the
passages that earlier messages of the thread share with a mail marks its word runs that stand in them already, however
the lines are wrapped or marked.  Recurrence: the last lines that several mails of one sender end with.  Forms, for
quotations and signatures that the table has no other trace of: quotation marks, lead-ins ("On ... wrote:"), header
blocks of forwarded messages, signature dividers, closing formulas above the sender's name, device and legal notices.

A thread may be of any size, so its messages are never brought together.  Passages in common are found by counting
hashed windows of each thread, first selected ones, then, around those that repeat, every window of ``LEAST_WORDS``; a
mail's automaton holds the pieces of those messages that had one of its windows first, never whole messages: no more
pieces than the mail has words, however often a message was quoted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop, stored
from ._hashing import chunks, letters_and_digits, minimisers, runs_of, word_hashes
from .pii import shown

#: Least words in a run that counts as inherited.
LEAST_WORDS = 14
#: Words of a selected window; of any ``LEAST_WORDS - WINDOW + 1`` consecutive ones, all that a run of LEAST_WORDS words has, one is selected.
WINDOW = 7
#: Starts of windows in a piece of a message.
PIECE = 64
#: Mails of a sender that must end with the same lines for these to recur.
RECURS = 3
#: Characters whose words are hashed at once.
CHUNK = 1_000_000
#: Why a line is old.
INHERITED, ENDING, FORM = "inherited", "ending", "form"

_WORDS = re.compile(r"[^\W_]+")
_MARK = re.compile(r"\s*[>|]")
# How mail programs introduce an earlier message, in five languages.
_LEAD = re.compile(
    r"^\s*(?:(?:On|Le|Am|El|Il|Em|Op)\b.{0,200}\d.{0,200}?\b(?:wrote|a écrit|schrieb|escribió|ha scritto|escreveu|schreef)\b.{0,120}:"
    r"|.{1,120}\b(?:wrote|a écrit|schrieb|escribió|said)\b(?: on| le| am| el)? ?\d.{0,60}:)\s*$",
    re.S,
)
_LEAD_START = re.compile(r"^\s*(?:(?:On|Le|Am|El|Il|Em|Op)\b.{0,60}\d|.{1,120}<[^<>\s]+@[^<>\s]+>|.{1,60}\b(?:wrote|schrieb|escribió|écrit)\b)")
_HEADER_RULE = re.compile(r"^\s*(?:-{3,} ?(?:Original Message|Forwarded message|Forwarded by.*|Mensaje original|Mensaje reenviado|Ursprüngliche Nachricht|Weitergeleitete Nachricht|Message d'origine|Message transféré|Messaggio originale) ?-{3,}|_{10,}|-{10,}|Begin forwarded message:)\s*$", re.I)
_HEADER_FROM = re.compile(r"^\s*\*?(?:From|De|Von|Da|Van|Expéditeur)\*?\s?:\*?\s*\S", re.I)
_HEADER_LINE = re.compile(r"^\s*\*?(?:From|Sent|To|Cc|Bcc|Date|Subject|De|Von|Da|Van|Enviado(?: el)?|Para|Asunto|Fecha|Gesendet|An|Datum|Betreff|Envoyé|À|Objet|Expéditeur|Destinataire)\*?\s?:", re.I)
_DIVIDER = re.compile(r"^\s*--\s*$")
_SOFT_DIVIDER = re.compile(r"^\s*(?:[—–]{1,3}|={3,}|_{3,}|\*{3,}|~{3,}|-{3,})\s*$")
_CLOSING = re.compile(
    r"^\s*(?:(?:(?:with |my )?(?:best|kind|warm|kindest|warmest)(?: regards| wishes)?|regards|many thanks|thanks(?: a lot| again| in advance)?|thank you|cheers|sincerely(?: yours)?|yours(?: sincerely| truly| faithfully)?|all the best|take care)"
    r"|(?:mit )?(?:freundlichen|besten|herzlichen|vielen) grüßen|(?:viele|beste|liebe|herzliche|schöne|freundliche) grüße|(?:viele |beste |mfg|lg|vg|gruß|vielen dank)"
    r"|(?:bien )?cordialement|bien à vous|cordiales salutations|(?:meilleures|sincères) salutations|merci(?: d'avance)?"
    r"|(?:un )?(?:cordial )?saludos?(?: cordiales)?|atentamente|muchas gracias|gracias)\s*[,.!]?\s*$",
    re.I,
)
_DEVICE = re.compile(r"^\s*(?:sent from (?:my|an?) |get outlook for |von meinem .{2,40} gesendet|gesendet (?:von|mit) |envoyé (?:depuis|de) (?:mon|ma) |enviado desde (?:mi|un) |inviato da(?:l mio)? )", re.I)
_NOTICE = re.compile(
    r"^\s*(?:\*{2,}\s*)?(?:(?:confidentiality notice|legal notice|disclaimer|confidential|privileged|avertissement|aviso legal|aviso de confidencialidad|rechtlicher hinweis|hinweis|haftungsausschluss|important|notice|mention légale)\s*[:\-–—]\s*)?"
    r"(?:(?:the contents? of )?(?:this|the) (?:e-?mail|message|communication|transmission)\b.{0,90}\b(?:intended|confidential|meant only|addressee|privileged)"
    r"|(?:der inhalt dieser|le contenu de (?:ce|cet|cette)|el contenido de este) (?:e-?mail|nachricht|message|courriel|mensaje|correo)\b.{0,90}\b(?:geschützt|vertraulich|confidenti|confidencial|protég|legalmente)"
    r"|(?:diese|die) (?:e-?mail|nachricht|mitteilung)\b.{0,90}\b(?:vertraulich|bestimmt)"
    r"|(?:ce|cet|le présent) (?:message|courriel|e-?mail)\b.{0,90}\b(?:confidentiel|destin|réservé)"
    r"|(?:este|el presente) (?:mensaje|correo)\b.{0,90}\b(?:confidencial|dirigido))",
    re.I | re.S,
)
_CONTACT = re.compile(r"^\s*(?:(?:tel|phone|fon|mobile?|m|t|p|fax|cell|☎|📞|✉|e-?mail|mail|web|www)[.:]?\s*[+(\d].*|[☎📞✉].*|[\w.+\-]+@[\w.\-]+\.\w+(?:\s*\|.*)?|https?://\S+|www\.\S+|[\d+()][\d +()./\-]{6,})\s*$", re.I)


class SuffixAutomaton:
    """Generalised suffix automaton of word lists: the shortest machine that reads every run of words in any of them."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: Sequence) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def _extend(self, last: int, w) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[last] + 1 == self.length[q] else self._clone(last, w, q)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[p] + 1 == self.length[q] else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def inherited(self, words: Sequence, least: int) -> np.ndarray:
        """Which words lie in a run of ``least`` or more that one of the lists holds."""
        gain = np.zeros(len(words) + 1, np.int64)
        state = n = 0
        for k, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                n += 1
            else:
                n = 0
            if n >= least:
                gain[k - n + 1] += 1
                gain[k + 1] -= 1
        return np.cumsum(gain)[:-1] > 0


def _norm(text: str) -> str:
    return " ".join(_WORDS.findall(text.lower()))


def _lines(body: str) -> list[str]:
    return re.split(r"\r?\n", body)


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(grp, id, mail, text) to (h, id, at, mail): selected windows of words and the place of their first word."""
    for pdf in batches:
        texts, groups, ids, mail = pdf["text"].tolist(), pdf["grp"].to_numpy().view(np.uint64), pdf["id"].to_numpy(), pdf["mail"].to_numpy()
        for a, b in chunks([len(x) for x in texts], CHUNK):
            words, counts = word_hashes(texts[a:b], letters_and_digits())
            h, owner, at = runs_of(words, counts, WINDOW)
            cut = minimisers(h, LEAST_WORDS - WINDOW + 1, owner)
            row = owner[cut]
            yield pd.DataFrame({"h": (h[cut] ^ groups[a:b][row]).view(np.int64), "id": ids[a:b][row], "at": (at[cut] - (np.cumsum(counts) - counts)[row]).astype(np.int32), "mail": mail[a:b][row]})


def _near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(grp, id, mail, text, at) to (h, id, at, mail): every run of LEAST_WORDS words that holds one of the windows given."""
    for pdf in batches:
        texts, groups, ids, mail = pdf["text"].tolist(), pdf["grp"].to_numpy().view(np.uint64), pdf["id"].to_numpy(), pdf["mail"].to_numpy()
        for a, b in chunks([len(x) for x in texts], CHUNK):
            words, counts = word_hashes(texts[a:b], letters_and_digits())
            begin = np.cumsum(counts) - counts
            h, owner, at = runs_of(words, counts, LEAST_WORDS)
            wanted = np.zeros(len(words) + 1, bool)
            for k, places in enumerate(pdf["at"].iloc[a:b]):
                first = np.asarray(places, np.int64)[:, None] - np.arange(LEAST_WORDS - WINDOW + 1)[None, :]
                wanted[begin[k] + first[first >= 0]] = True
            cut = np.flatnonzero(wanted[at])
            row = owner[cut]
            yield pd.DataFrame({"h": (h[cut] ^ groups[a:b][row]).view(np.int64), "id": ids[a:b][row], "at": (at[cut] - begin[row]).astype(np.int32), "mail": mail[a:b][row]})


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(source, text, pieces) to (source, piece, words): the word hashes of the pieces of a message."""
    for pdf in batches:
        out = []
        for source, text, pieces in zip(pdf["source"], pdf["text"], pdf["pieces"]):
            words = word_hashes([text], letters_and_digits())[0].view(np.int64)
            out += [(source, int(k), words[k * PIECE : (k + 1) * PIECE + LEAST_WORDS - 1]) for k in pieces]
        yield pd.DataFrame(out, columns=["source", "piece", "words"])


def _passages(pieces: Sequence[tuple[int, int, Sequence[int]]]) -> list[list[int]]:
    """Pieces of messages (source, number, words), neighbouring ones joined to one passage."""
    out: list[list[int]] = []
    last = None
    for source, k, words in sorted(pieces, key=lambda x: (x[0], x[1])):
        if last == (source, k):
            continue
        if last == (source, k - 1):
            out[-1] += list(words)[LEAST_WORDS - 1 :]
        else:
            out.append(list(words))
        last = (source, k)
    return out


def _holds(passage: Sequence[int], own: Sequence[int]) -> bool:
    as_bytes = lambda x: np.asarray(x, np.int64).astype(">i8").tobytes()
    whole, part = as_bytes(passage), as_bytes(own)
    at = whole.find(part)
    while at >= 0 and at % 8:
        at = whole.find(part, at + 1)
    return at >= 0


def _inherited(raw: list[str], old: list[bool], passages: list[list[int]]) -> list[bool]:
    """Which lines hold words of inherited runs only.  ``old`` are the lines that a form marks: if all other words stand in
    one message, one after another, the mail is a copy of that message, not an answer to it, and these are not inherited."""
    words, counts = word_hashes(raw, letters_and_digits())
    words = words.view(np.int64)
    owner = np.repeat(np.arange(len(raw)), counts)
    machine = SuffixAutomaton()
    for x in passages:
        machine.add([int(w) for w in x])
    hit = machine.inherited([int(w) for w in words], LEAST_WORDS)
    fresh = ~np.asarray(old, bool)[owner]
    if fresh.any() and hit[fresh].all() and any(_holds(x, words[fresh]) for x in passages):
        hit &= ~fresh
    return list((np.bincount(owner[~hit], minlength=len(raw)) == 0) & (counts > 0))


_LED = ("wrote", "écrit", "schrieb", "escribió", "scritto", "escreveu", "schreef", "said")


def _forms(raw: list[str], author: str | None) -> tuple[list[bool], list[bool]]:
    """For each line whether its form shows it to be quoted or forwarded, and whether to belong to a signature or notice."""
    lines = [x.strip() if x.isascii() else shown(x)[0].strip() for x in raw]
    n = len(lines)
    old, end = [False] * n, [False] * n
    blank = [not x.strip() for x in raw]
    person = _person(author)

    def next_text(k: int) -> int:
        while k < n and blank[k]:
            k += 1
        return k

    def close(k: int) -> None:
        old[k] = end[k] = True

    # Marks, with their lead-ins above.
    for k in range(n):
        if lines[k][:1] in (">", "|") and lines[k]:
            old[k] = True
    whole = "\n".join(lines)
    for k in range(n if any(x in whole for x in _LED) else 0):
        if old[k] or blank[k] or not _LEAD_START.match(lines[k]):
            continue
        for m in (1, 2, 3):
            if k + m > n or any(blank[j] or (old[j] and j > k) for j in range(k, k + m)):
                break
            text = " ".join(lines[k : k + m])
            if _LEAD.match(text):
                j = next_text(k + m)
                quoted = j < n and old[j]
                full = bool(re.search(r"\d{1,2}[:.h]\d\d", text)) or "@" in text
                if quoted or full:
                    for i in range(k, k + m):
                        old[i] = True
                    if not quoted:  # nothing marks what follows: up to the next form it is the earlier message
                        for i in range(k + m, n):
                            if not blank[i]:
                                old[i] = True
                    break
    # Header blocks: they and all below.
    for k in range(n):
        if old[k] or blank[k] or lines[k][0] not in "*FDVEBfdveb-_":
            continue
        j = next_text(k + 1)
        rule = _HEADER_RULE.match(lines[k]) and j < n and (_HEADER_FROM.match(lines[j]) or re.match(r"^\s*[-–]+ ?\w", lines[k]))
        headed = not rule and _HEADER_FROM.match(lines[k]) and sum(bool(_HEADER_LINE.match(x)) for x in lines[k + 1 : k + 4]) >= 2
        if rule or headed:
            for i in range(k, n):
                old[i] = not blank[i]
            break
    # Legal notices: the paragraph that one begins.
    for k in range(n):
        if old[k] or blank[k] or (k and not blank[k - 1] and not old[k - 1]):
            continue
        if _NOTICE.match(" ".join(lines[k : k + 3])):
            i = k
            while i < n and not blank[i] and not old[i]:
                close(i)
                i += 1
    # Signatures and device notes.
    for k in range(n):
        if old[k] or blank[k]:
            continue
        if lines[k][0] in "sSgGvVeEiI" and _DEVICE.match(lines[k]):
            close(k)
            continue
        j = next_text(k + 1)
        soft = lines[k][0] in "-—–=_*~" and (_DIVIDER.match(lines[k]) or _SOFT_DIVIDER.match(lines[k]))
        if not soft and len(lines[k]) > 60:
            continue
        closing = not soft and _CLOSING.match(lines[k])
        named = (soft or closing) and j < n and not old[j] and _is_person(lines[j], person)
        if soft and (_DIVIDER.match(lines[k]) or (named and not (lines[k].startswith("---") and not _whole_name(lines[j], person)))):
            i = k
            while i < n and not old[i] and (i <= j or not blank[i]):
                if not blank[i]:
                    close(i)
                i += 1
        elif closing and (j >= n or old[j] or named or _DIVIDER.match(lines[j]) or _SOFT_DIVIDER.match(lines[j]) or _DEVICE.match(lines[j])):
            close(k)
            if named:
                i = j
                while i < n and not old[i] and not blank[i]:
                    close(i)
                    i += 1
        elif person and _whole_name(lines[k], person) and j < n and (_CONTACT.match(lines[j]) or (j == k + 1 and j + 1 < n and _CONTACT.match(lines[j + 1]))):
            i = k
            while i < n and not old[i] and not blank[i]:
                close(i)
                i += 1
    quoted = [o and not e and not b for o, e, b in zip(old, end, blank)]
    return quoted, [e and not b for e, b in zip(end, blank)]


def judged(body: str, author: str | None, pieces: Sequence[tuple[int, int, Sequence[int]]] = ()) -> tuple[list[str | None], list[tuple[int, int, bool]]]:
    """Why each line of a body is old (None: it is new or blank), and the sender's own lines from below, but for the topmost,
    with a hash of the rest of their paragraph, what may recur, and whether a form closes the mail there."""
    raw = _lines(body)
    quoted, closed = _forms(raw, author)
    held = _inherited(raw, [q or c for q, c in zip(quoted, closed)], _passages(pieces)) if len(pieces) else [False] * len(raw)
    why = [INHERITED if h else FORM if q or c else None for h, q, c in zip(held, quoted, closed)]
    own = [k for k in range(len(raw)) if raw[k].strip() and not held[k] and not quoted[k]]
    tail, below, last = [], 0, None
    for k in reversed(own[1:]):
        below = xxhash.xxh64_intdigest(f"{below if last == k + 1 else 0} {_norm(raw[k])}") >> 1
        tail.append((k, below, closed[k]))
        last = k
    return why, tail


def classify(body: str, author: str | None, sources: list[str] | None = None) -> list[bool]:
    """For each line of a body whether its sender did not newly write it, with whole messages as sources and no other
    mails of the sender; blank lines are False."""
    pieces = []
    for s, text in enumerate(sources or []):
        words = word_hashes([text], letters_and_digits())[0].view(np.int64)
        pieces += [(s, k, words[k * PIECE : (k + 1) * PIECE + LEAST_WORDS - 1]) for k in range(max(1, -(-len(words) // PIECE)))]
    return [x is not None for x in judged(body, author, pieces)[0]]


def _person(author: str | None) -> list[str]:
    if not author or not author.strip():
        return []
    parts = [x.strip() for x in author.split(",")]
    return _WORDS.findall(" ".join(reversed(parts)).lower()) if len(parts) == 2 else _WORDS.findall(author.lower())


def _whole_name(line: str, person: list[str]) -> bool:
    words = _WORDS.findall(line.lower())
    return bool(person) and len(words) == len(person) and (words == person or sorted(words) == sorted(person))


def _is_person(line: str, person: list[str]) -> bool:
    """Whether a line is a name: the sender's, its first word, or two or three capitalised words and nothing else."""
    words = _WORDS.findall(line.lower())
    if person and (words == person[:1] or sorted(words) == sorted(person)):
        return True
    return bool(re.fullmatch(r"[^\W\d_a-z][\w'’.\-]*(?:,? [^\W\d_a-z][\w'’.\-]*){1,2}", line.strip()))


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, author, body, pieces) to (id, lines, tail): old lines with their reason, and hashes of what mails may end with."""
    for pdf in batches:
        rows = []
        for rec, author, body, pieces in zip(pdf["id"], pdf["author"], pdf["body"], pdf["pieces"]):
            why, tail = judged(body, author, () if pieces is None else [(x["source"], x["piece"], x["words"]) for x in pieces])
            lines = [{"line_no": k + 1, "why": x} for k, x in enumerate(why) if x]
            rows.append((rec, xxhash.xxh64_intdigest(" ".join(sorted(_person(author))) or author or "") >> 1, lines, [{"line_no": k + 1, "below": x, "closed": c} for k, x, c in tail] if author else []))
        yield pd.DataFrame(rows, columns=["id", "sender", "lines", "tail"])


def _shared(texts: DataFrame) -> DataFrame:
    """``id, pieces``: for each mail among ``texts`` (grp, id, mail, text) the pieces of earlier messages of its thread that
    hold a run of LEAST_WORDS words of it, each run by the first message that has it."""
    schema = "h long, id long, at int, mail boolean"
    windows = stored(texts.mapInPandas(_windows, schema))
    twice = windows.groupBy("h").agg(F.min("id").alias("a"), F.max(F.when(F.col("mail"), F.col("id"))).alias("b")).filter("a < b").select("h")
    places = stored(windows.join(twice, "h", "left_semi").groupBy("id").agg(F.collect_set("at").alias("at")))  # of one text
    runs = stored(texts.join(places, "id").mapInPandas(_near, schema))
    drop(windows, places)
    first = runs.groupBy("h").agg(F.min(F.struct("id", "at")).alias("first"), F.max(F.when(F.col("mail"), F.col("id"))).alias("last")).filter("first.id < last")
    heirs = stored(runs.filter("mail").select("h", "id").join(first.select("h", F.col("first.id").alias("source"), F.floor(F.col("first.at") / PIECE).cast("int").alias("piece")), "h").filter("source < id").select("id", "source", "piece").distinct())
    wanted = stored(heirs.select("source", "piece").distinct().groupBy("source").agg(F.collect_list("piece").alias("pieces")))
    drop(runs)
    words = texts.select(F.col("id").alias("source"), "text").join(wanted, "source").mapInPandas(_pieces, "source long, piece int, words array<long>").dropDuplicates(["source", "piece"])
    return heirs.join(words, ["source", "piece"]).groupBy("id").agg(F.collect_list(F.struct("source", "piece", "words")).alias("pieces"))


def line_reasons(df: DataFrame, is_mail: str = "channel = 'email'") -> DataFrame:
    """``id, line_no, why`` of each non-blank line that the sender of a mail did not newly write, counted from 1, a row each;
    ``why`` is ``inherited``, ``ending`` or ``form``, the first that holds.

    ``df`` has ``comment_id, ticket_key, author, body`` and what ``is_mail`` reads.  Null ids and bodies give no row; a null
    thread has nothing to inherit from; repeated deliveries count once, and the id orders the messages of a thread.
    Other columns are ignored, whatever their names.
    """
    rows = df.filter("comment_id is not null and body is not null").select(F.col("comment_id").alias("id"), "ticket_key", F.trim("author").alias("author"), "body", F.coalesce(F.expr(is_mail), F.lit(False)).alias("mail"))
    texts = rows.filter("ticket_key is not null").select(F.xxhash64("ticket_key").alias("grp"), "id", "mail", F.col("body").alias("text"))
    mails = rows.filter("mail").select("id", "author", "body")
    ready = mails.join(_shared(texts), "id", "left").select("id", "author", "body", "pieces")
    seen = stored(ready.mapInPandas(_judge, "id long, sender long, lines array<struct<line_no int, why string>>, tail array<struct<line_no int, below long, closed boolean>>"))
    ends = seen.select("id", "sender", F.explode("tail").alias("t")).select("id", "t.line_no", "t.closed", F.col("sender").bitwiseXOR(F.col("t.below")).alias("key"))
    often = ends.select("id", "key").distinct().groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= RECURS).select("key", F.lit(True).alias("recurs"))
    ends = stored(ends.join(stored(often), "key", "left").select("id", "line_no", F.coalesce("recurs", F.lit(False)).alias("recurs"), "closed"))
    # From below, up to the first line that neither recurs nor closes the mail by its form.
    stop = ends.filter("not recurs and not closed").groupBy("id").agg(F.max("line_no").alias("stop"))
    ending = ends.filter("recurs").join(stop, "id", "left").filter("stop is null or line_no > stop").select("id", "line_no", F.lit(2).alias("rank"))
    rank = F.when(F.col("l.why") == INHERITED, 1).otherwise(3)
    lines = seen.select("id", F.explode("lines").alias("l")).select("id", "l.line_no", rank.alias("rank")).union(ending)
    return lines.groupBy("id", "line_no").agg(F.min("rank").alias("rank")).select("id", "line_no", F.element_at(F.array(F.lit(INHERITED), F.lit(ENDING), F.lit(FORM)), F.col("rank")).alias("why"))


def old_lines(df: DataFrame, is_mail: str = "channel = 'email'") -> DataFrame:
    """``comment_id, line_no`` of each non-blank line that its sender did not newly write, distinct."""
    return line_reasons(df, is_mail).select(F.col("id").alias("comment_id"), "line_no")


def newly_written(df: DataFrame, is_mail: str = "channel = 'email'") -> DataFrame:
    """Lines and text that mails did not or did newly hold: ``id, old_lines array<int>, new_text``, a row for each distinct
    mail, as ``line_reasons`` tells them.

    Null bodies give no row, empty ones an empty array and text.
    """
    mails = df.filter("comment_id is not null and body is not null").filter(F.coalesce(F.expr(is_mail), F.lit(False))).select(F.col("comment_id").alias("id"), "body").distinct()
    old = line_reasons(df, is_mail).groupBy("id").agg(F.sort_array(F.collect_list("line_no")).alias("old_lines"))  # of one mail
    lines = F.split("body", "\r?\n")
    rows = mails.join(old, "id", "left").withColumn("old_lines", F.coalesce("old_lines", F.array().cast("array<int>")))
    kept = F.transform(F.array_except(F.sequence(F.lit(1), F.size(lines)), "old_lines"), lambda k: F.element_at(lines, k))
    return rows.select("id", "old_lines", F.regexp_replace(F.array_join(kept, "\n"), r"(?U)^\s+|\s+$", "").alias("new_text"))
