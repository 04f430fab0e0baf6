"""Text functions as Column expressions: cleaning, splitting, normal forms, similarity, classifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}
_HTML_TAGS = ["p", "div", "br", "span", "table", "ul", "ol", "li", "b", "i", "strong", "em", "h1", "h2", "h3", "h4", "h5", "h6", "a"]
#: Similarity of word sets from which texts count as near-duplicates, and length over which one may contain the other.
NEAR, CONTAINED = 0.75, 20


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def is_blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(r"\S")


#: Blanks that are no plain ones.
EXOTIC = "[   -   　]"


def line_feeds(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def plain_blanks(c: Column) -> Column:
    return F.regexp_replace(c, EXOTIC, " ")


def normal_spaces(c: Column) -> Column:
    """Line feeds for all line ends, plain blanks for exotic ones."""
    return plain_blanks(line_feeds(c))


def looks_like_html(c: Column) -> Column:
    return c.rlike(rf"(?i)<\s*(?:{'|'.join(_HTML_TAGS)})\b")


def _numeric_entities(c: Column) -> Column:
    """``&#8211;`` and ``&#x2013;`` to their characters."""
    parts = F.split(c, r"(?=&#[xX]?[0-9a-fA-F]{1,6};)")
    pattern = r"^&#([xX]?)([0-9a-fA-F]{1,6});"

    def one(p: Column) -> Column:
        digits = F.regexp_extract(p, pattern, 2)
        code = F.when(F.regexp_extract(p, pattern, 1) != "", F.conv(digits, 16, 10)).otherwise(F.when(digits.rlike(r"^\d+$"), digits)).cast("int")
        valid = p.rlike(pattern) & code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(valid, F.concat(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"), F.regexp_replace(p, pattern, ""))).otherwise(p)

    return F.when(c.contains("&#"), F.array_join(F.transform(parts, one), "")).otherwise(c)


def html_to_text(c: Column) -> Column:
    """Tags to line structure: breaks and blocks to line feeds, list items to dashes; scripts, styles and comments out."""
    for pattern, to in [
        (r"(?s)<!--.*?-->", ""),
        (r"(?is)<(script|style)\b.*?</\1\s*>", ""),
        (r"\s+", " "),
        (r"(?i)<br\b[^>]*>", "\n"),
        (r"(?i)</?(?:p|div|tr|h[1-6])\b[^>]*>", "\n"),
        (r"(?i)<li\b[^>]*> ?", "- "),
        (r"(?i)</li\s*>", "\n"),
        (r"</?[A-Za-z][^>]*>", ""),
    ]:
        c = F.regexp_replace(c, pattern, to)
    c = _numeric_entities(c)
    for name, to in _ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(to))
    return F.regexp_replace(c, " {2,}", " ")


def cut_mail_quote(c: Column) -> Column:
    """Everything from the first "On ... wrote:" line on goes."""
    return F.regexp_replace(c, r"(?is)(?:(?<=\n)|^)On [^\n]{5,120} wrote:\s*?(?:(?=\n)|$).*", "")


def drop_quoted_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"(?m)^\s*>.*$", "")


# What a text holds that a step of cleaning changes, for a quick look before.
def quotes_mail(c: Column) -> Column:
    return F.lower(c).contains(" wrote:")


def blank_line_ends(c: Column) -> Column:
    """Blanks before a line end, or line ends other than line feeds; ``strip`` takes those at the end of the text."""
    return c.contains(" \n") | c.contains("\t\n") | c.contains("\r") | ((F.octet_length(c) > F.char_length(c)) & c.rlike(r"[\x{85}\x{2028}\x{2029}]"))


def cut_signature(c: Column) -> Column:
    """Everything from the first line that is just two dashes on goes."""
    return F.regexp_replace(c, r"(?s)(?:(?<=\n)|^)--\s*?(?:(?=\n)|$).*", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, r"(?m)[ \t]+$", ""), r"\n{3,}", "\n\n"))


def blocks(c: Column) -> Column:
    """Paragraphs: pieces between blank lines, without empty ones."""
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), strip), lambda x: x != "")


def sentences(c: Column) -> Column:
    """Pieces between line ends, or after a full stop and before a capital, quote or bracket."""
    return F.filter(F.transform(F.split(strip(c), r"(?<=[.!?])\s+(?=[A-Z\"'(\[])|\n+"), strip), lambda x: x != "")


def normal_form(c: Column) -> Column:
    """Lower case a-z, 0-9 and single blanks, for comparisons."""
    return F.trim(F.regexp_replace(F.replace(F.replace(F.lower(c), F.lit("'"), F.lit("")), F.lit("’"), F.lit("")), "[^a-z0-9]+", " "))


def word_set(form: Column) -> Column:
    return F.when(form == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(form, " ")))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two word sets; two empty ones are equal."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, 1.0).otherwise(common / union)


def near_duplicate(form_a: Column, form_b: Column) -> Column:
    """Equal normal forms, one long form within the other, or word sets alike."""
    long_ = (F.length(form_a) > CONTAINED) & (F.length(form_b) > CONTAINED)
    return (form_a == form_b) | (long_ & (form_a.contains(form_b) | form_b.contains(form_a))) | ((form_a != "") & (form_b != "") & (jaccard(word_set(form_a), word_set(form_b)) >= NEAR))


#: How a line of a log begins that isn't the first one; of three such lines two are that.  For a quick look before.
_LOG_LINE = rf"[\n\r\x0b\x0c\x{{85}}\x{{2028}}\x{{2029}}][ \t]*(?:at |Caused by:|\d{{4}}-|\[?{vocab.alternation(vocab.LOG_LEVELS)}|\w+\.\w[\w.]*(?:Exception|Error))"
LOG_CUE = rf"{_LOG_LINE}(?s:.*?){_LOG_LINE}"


def is_log_dump(c: Column) -> Column:
    """Three or more lines of which half (three at least) read like a log or a stack trace."""
    lines = F.split(F.regexp_replace(c, r"\s+$", ""), r"\r\n|[\n\r\x0b\x0c\u0085  ]")
    level = vocab.alternation(vocab.LOG_LEVELS)
    like = rf"^(?:at .*|Caused by:.*|\d{{4}}-\d{{2}}-\d{{2}}[T ].*|\[?{level}\]?\b.*|\w+(?:\.\w+)+(?:Exception|Error)(?::.*)?)$"
    n = F.size(F.filter(lines, lambda x: strip(x).rlike(like)))
    # As a case, for Spark would split every text before it looks for the cue.
    return F.when(c.rlike(LOG_CUE), (F.size(lines) >= 3) & (n >= F.greatest(F.lit(3), F.floor(F.size(lines) / 2)))).when(c.isNotNull(), False)


def is_bot_author(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(vocab.words(vocab.FILTER_BOTS))


#: Messages that builds and deployments write; and signs without words.
_BOT_BODY = r"(?i)\A(?:build\s+#?\d+\s+(?:started|succeeded|failed|passed)|deployment\s+(?:started|completed|triggered)|branch\s+\S+\s+was\s+(?:created|deleted))[^\n]*\z"
_SIGNS = r"\A[\p{So}\p{Sk}\p{Cs}:;()\[\]{}\-_*+~^\s]+\z"


def is_bot_body(c: Column) -> Column:
    return c.rlike(_BOT_BODY)


def is_greeting(c: Column) -> Column:
    return c.rlike(rf"(?i)\A{vocab.alternation(vocab.GREETINGS)}[\s!.,]*\z")


def is_symbols(c: Column) -> Column:
    return c.rlike(_SIGNS)


def noise_reason(text: Column, author: Column, bot: Column) -> Column:
    """Why a comment is left out: the first rule that holds, or null."""
    return (
        F.when(is_blank(text), "empty")
        .when(F.coalesce(bot, F.lit(False)) | is_bot_author(author) | is_bot_body(strip(text)), "bot message")
        .when(is_greeting(strip(text)), "greeting/acknowledgement")
        .when(is_symbols(text), "emoji/symbol spam")
        .when(is_log_dump(text), "log dump")
    )


def issue_keys(c: Column) -> Column:
    """Keys like ABC-123 in order, not the start of a longer one such as CVE-2019-1."""
    return F.regexp_extract_all(c, F.lit(r"\b([A-Z][A-Z0-9]{1,9}-\d+)\b(?!-)"), 1)


def round2(c: Column) -> Column:
    return F.floor(c * 100.0 + 0.5) / 100.0


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: code points, those beyond the basic plane twice."""
    return F.length(c) + F.when(F.octet_length(c) == F.length(c), 0).otherwise(F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]+", "")))


def estimated_tokens(c: Column) -> Column:
    return F.ceil(F.length(c) / 4.0)


# ---- extractors -------------------------------------------------------------------------------------------------
# How list items, scenario steps and headings of criteria begin.
_MARKER = r"^\s*(?:[-*+]\s*(?:\[[ xX]\]\s*)?|\d+[.)]\s+)(.+)$"
_GHERKIN = rf"(?i)^\s*(?:[-*]\s*)?{vocab.alternation(vocab.GHERKIN)}\b\s+.+$"
_HEADING = rf"(?i)^\s*(?:h\d\.\s*|#{{1,6}}\s*|\*{{0,2}})\s*{vocab.alternation(vocab.SECTION)}\b.*$"


def section_items(text: Column) -> Column:
    """List items below a heading of acceptance criteria, up to the first line that is neither item nor scenario."""
    start = F.struct(F.lit(False).alias("open"), F.array().cast("array<string>").alias("items"))

    def step(acc: Column, line: Column) -> Column:
        item = acc["open"] & line.rlike(_MARKER)
        stays = F.when(line.rlike(_HEADING), True).when(item | is_blank(line) | line.rlike(_GHERKIN), acc["open"]).otherwise(False)
        more = F.when(item & ~line.rlike(_HEADING), F.array(strip(F.regexp_extract(line, _MARKER, 1)))).otherwise(F.array().cast("array<string>"))
        return F.struct(stays.alias("open"), F.concat(acc["items"], more).alias("items"))

    return F.aggregate(F.split(text, "\n"), start, step, lambda acc: acc["items"])


def scenarios(text: Column) -> Column:
    """Runs of two or more given / when / then / and lines, each joined to one text."""
    lines = F.concat(F.split(text, "\n"), F.array(F.lit("")))  # the last one ends a run
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("run"), none.alias("out"))

    def step(acc: Column, line: Column) -> Column:
        hit = line.rlike(_GHERKIN)
        run = F.when(hit, F.concat(acc["run"], F.array(F.regexp_replace(strip(line), r"^[-*]\s*", "")))).otherwise(none)
        out = F.when(~hit & (F.size(acc["run"]) >= 2), F.concat(acc["out"], F.array(F.array_join(acc["run"], " ")))).otherwise(acc["out"])
        return F.struct(run.alias("run"), out.alias("out"))

    return F.aggregate(lines, start, step, lambda acc: acc["out"])


def is_decision(s: Column) -> Column:
    return s.rlike(vocab.words(vocab.DECISION)) | s.rlike(vocab.words(vocab.REJECTION))


#: What a sentence is searched for before it says something.
CUES = ["decisions", "constraints", "todos", "dependencies", "risky", "goal"]


def _has(s: Column, phrases: list[str]) -> Column:
    """``vocab.words``, looked for only where a first letter stands."""
    return s.rlike(rf"(?i)(?=[{''.join(sorted({p[0] for p in phrases}))}]){vocab.words(phrases)[4:]}")


def cues(s: Column) -> dict[str, Column]:
    return {
        "decisions": _has(s, [*vocab.DECISION, *vocab.REJECTION]), "constraints": _has(s, vocab.REQUIREMENT), "todos": _has(s, vocab.TODO),
        "dependencies": s.rlike("(?i)(?=[bdrw])" + vocab.DEPENDENCY_PATTERN[4:]), "risky": _has(s, vocab.RISK), "goal": _has(s, vocab.GOAL_SENTENCE),
    }


def said(s: Column, cue: dict[str, Column] | None = None) -> dict[str, Column]:
    """What a sentence may say, by name."""
    cue = cue or cues(s)
    return {
        "decisions": cue["decisions"], "constraints": cue["constraints"], "todos": cue["todos"], "dependencies": cue["dependencies"], "risks": ~cue["dependencies"] & cue["risky"],
        "architecture": cue["decisions"] & s.rlike(vocab.words(vocab.ARCHITECTURE)), "goal": cue["goal"],
    }


def without_label(s: Column) -> Column:
    """A to-do without the word that marks it."""
    return F.regexp_replace(s, r"(?i)^(?:todo|fixme)\s*[:\-]\s*", "")


#: What a block with section items or scenarios holds somewhere, for a quick look before.
_CRITERIA_CUE = rf"(?im){vocab.alternation(vocab.SECTION)}|^[\s&&[^\n]]*(?:[-*]\s*)?{vocab.alternation(vocab.GHERKIN)}\b\s"


def may_hold_criteria(text: Column) -> Column:
    return text.rlike(_CRITERIA_CUE)


def is_goal_block(text: Column) -> Column:
    return text.rlike(vocab.words(vocab.GOAL_BLOCK))
