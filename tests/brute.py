"""The record of one ticket in plain Python, one text at a time, to compare the plan with."""

import math
import re

from briefloom.functions import vocab


def has(phrases, text):
    return re.search(vocab.words(phrases), text) is not None


def form(text):
    return re.sub("[^a-z0-9]+", " ", text.lower().translate({39: None, 8217: None})).strip(" ")


def near(a, b):
    x, y = form(a), form(b)
    if x == y or (len(x) > 20 and len(y) > 20 and (x in y or y in x)):
        return True
    p, q = set(x.split()), set(y.split())
    return bool(p and q) and len(p & q) / len(p | q) >= 0.75


def strip(t):
    return re.sub(r"\A[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+\Z", "", t)


def sentences(t):
    parts = re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+(?=[A-Z\"'(\[])|\n+", strip(t))
    return [x for x in map(strip, parts) if x]


def is_log(t):
    lines = re.split(r"\r\n|[\n\r\x0b\f\x85  ]", re.sub(r"[ \t\n\x0b\f\r]+\Z", "", t))
    level = "|".join(vocab.LOG_LEVELS)
    like = rf"(at .*|Caused by:.*|\d{{4}}-\d{{2}}-\d{{2}}[T ].*|\[?({level})\]?\b.*|\w+(\.\w+)+(Exception|Error)(:.*)?)$"
    return len(lines) >= 3 and sum(bool(re.match(like, strip(x), re.A)) for x in lines) >= max(3, len(lines) // 2)


def clean(t):
    t = re.sub("\r\n?", "\n", t)
    t = re.sub("[   -   　]", " ", t)
    if re.search(r"(?i)<\s*(p|div|br|span|table|ul|ol|li|b|i|strong|em|h[1-6]|a)\b", t):
        for a, b in [(r"(?s)<!--.*?-->", ""), (r"(?is)<(script|style)\b.*?</\1\s*>", ""), (r"[ \t\n\x0b\f\r]+", " "), (r"(?i)<br\b[^>]*>", "\n"), (r"(?i)</?(p|div|tr|h[1-6])\b[^>]*>", "\n"), (r"(?i)<li\b[^>]*> ?", "- "), (r"(?i)</li\s*>", "\n"), (r"</?[A-Za-z][^>]*>", "")]:
            t = re.sub(a, b, t)
        for a, b in {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}.items():
            t = t.replace(a, b)
        t = re.sub(" {2,}", " ", t)
    m = re.search(r"(?im)^On [^\n]{5,120} wrote:[ \t\x0b\f\r]*$", t)
    t = t[: m.start()] if m else t
    t = re.sub(r"(?m)^[ \t\n\x0b\f\r]*>.*$", "", t)
    m = re.search(r"(?m)^--[ \t\x0b\f\r]*$", t)
    t = t[: m.start()] if m else t
    return strip(re.sub(r"\n{3,}", "\n\n", re.sub(r"(?m)[ \t]+$", "", t)))


def units(t):
    return len(t.encode("utf-16-le")) // 2


def record(key, title, description, linked, comments, level):
    limit, ignored, live = vocab.LEVELS[level], [], [(0, clean(description))]
    counts = dict.fromkeys(["bot", "hello", "signs"], 0)
    for no, (author, body, bot) in enumerate(comments, 1):
        t = clean(body)
        if not strip(t):
            continue
        if bot or has(vocab.FILTER_BOTS, author) or re.fullmatch(r"(?i)(build\s+#?\d+\s+(started|succeeded|failed|passed)|deployment\s+(started|completed|triggered)|branch\s+\S+\s+was\s+(created|deleted))[^\n]*", t):
            counts["bot"] += 1
        elif re.fullmatch(rf"(?i){vocab.alternation(vocab.GREETINGS)}[\s!.,]*", t):
            counts["hello"] += 1
        elif _signs(t):
            counts["signs"] += 1
        elif is_log(t):
            ignored.append(f"Log/stack-trace dump removed from comment:{no} ({units(t)} chars)")
        else:
            live.append((no, t))
    for k, what in (("bot", "bot message(s)"), ("hello", "greeting/acknowledgement comment(s)"), ("signs", "emoji-only comment(s)")):
        if counts[k]:
            ignored.append(f"{counts[k]} {what} removed")
    kept, twice = [], 0
    for no, t in live:
        for text in filter(None, map(strip, re.split(r"\n[ \t\n\x0b\f\r]*\n", t))):
            for b in kept:
                if near(b["text"], text):
                    b["times"] += 1
                    twice += 1
                    break
            else:
                kept.append({"no": no, "text": text, "times": 1, "cats": set()})
    if twice:
        ignored.append(f"{twice} duplicate/near-duplicate paragraph(s) collapsed")
    found = {k: [] for k in ("decisions", "constraints", "acceptanceCriteria", "risks", "todos", "dependencies")}
    for b in kept:
        for s in sentences(b["text"]):
            if has(vocab.DECISION, s) or has(vocab.REJECTION, s):
                found["decisions"].append(s)
                b["cats"] |= {"DECISION"} | ({"ARCHITECTURE"} if has(vocab.ARCHITECTURE, s) else set())
    heading = r"(?i)\s*(h\d\.\s*|#{1,6}\s*|\*{0,2})\s*(acceptance criteria|definition of done|dod)\b.*"
    gherkin, item = r"(?i)\s*([-*]\s*)?(given|when|then|and)\b\s+.+", r"\s*(?:[-*+]\s*(?:\[[ xX]\]\s*)?|\d+[.)]\s+)(.+)"
    for b in kept:
        inside, run = False, []
        said = []
        for line in b["text"].split("\n"):
            m = re.fullmatch(item, line)
            if re.fullmatch(heading, line):
                inside = True
            elif inside and m:
                said.append(strip(m[1]))
            elif inside and strip(line) and not re.fullmatch(gherkin, line):
                inside = False
        for line in [*b["text"].split("\n"), ""]:
            if re.fullmatch(gherkin, line):
                run.append(re.sub(r"^[-*]\s*", "", strip(line)))
            else:
                said += [" ".join(run)] if len(run) > 1 else []
                run = []
        found["acceptanceCriteria"] += said
        b["cats"] |= {"ACCEPTANCE_CRITERIA"} if said else set()
        for s in sentences(b["text"]):
            if has(vocab.REQUIREMENT, s) and not any(form(a) in form(s) or form(s) in form(a) for a in found["acceptanceCriteria"]):
                found["constraints"].append(s)
                b["cats"].add("CONSTRAINT")
    for b in kept:
        for s in sentences(b["text"]):
            if has(vocab.TODO, s):
                found["todos"].append(re.sub(r"(?i)^(todo|fixme)\s*[:\-]\s*", "", s))
                b["cats"].add("TODO")
    for b in kept:
        for s in sentences(b["text"]):
            if re.search(vocab.DEPENDENCY_PATTERN, s):
                found["dependencies"].append(s)
                b["cats"].add("DEPENDENCY")
            elif has(vocab.RISK, s):
                found["risks"].append(s)
                b["cats"].add("RISK")
    low = 0
    for b in kept:
        b["cats"] |= ({"BUSINESS_GOAL"} if has(vocab.GOAL_BLOCK, b["text"]) else set()) | ({"NOISE"} if is_log(b["text"]) else set())
        best = max(vocab.WEIGHTS[c] for c in b["cats"] or {"DISCUSSION"})
        b["score"] = 0.01 if "NOISE" in b["cats"] else min(0.99, best + min(0.10, (b["times"] - 1) * 0.05))
        low += b["score"] < limit
    if low:
        ignored.append(f"{low} low-value paragraph(s) dropped below the {level.lower()} threshold")
    rest = [b for b in kept if b["score"] >= limit]
    lists = {}
    for name, category in (("decisions", "DECISION"), ("constraints", "CONSTRAINT"), ("acceptanceCriteria", "ACCEPTANCE_CRITERIA"), ("risks", "RISK"), ("todos", "TODO"), ("dependencies", "DEPENDENCY")):
        out = []
        for s in found[name] if vocab.WEIGHTS[category] >= limit else []:
            for k, x in enumerate(out):
                if near(x, s):
                    out[k] = s if units(s) > units(x) else x
                    break
            else:
                out.append(s)
        lists[name] = out
    first = next((b["text"] for b in rest if b["no"] == 0), None)
    summary = title if first is None else " ".join(sentences(first)[:2])
    goal = next((s for b in rest for s in sentences(b["text"]) if has(vocab.GOAL_SENTENCE, s)), None)
    goal = "" if goal is None or goal in summary or near(summary, goal) else goal
    keys = [k for t in [title, *[b["text"] for b in rest]] for k in re.findall(r"\b([A-Z][A-Z0-9]{1,9}-\d+)\b(?!-)", t)]
    keys += [strip(k) for k in linked.split(",")] if strip(linked) else []
    related = [k for k in dict.fromkeys(keys) if k != key]
    issue = strip(f"{key} {title}")
    confidence = 0.5 + (0.1 if strip(summary) else 0) + (0.15 if lists["decisions"] else 0) + (0.15 if lists["acceptanceCriteria"] else 0) + (0.05 if strip(goal) or strip(summary) else 0)
    size = units(title) + units(description) + sum(units(b) for _, b, _ in comments)
    out = sum(map(units, [issue, summary, goal, *related, *[x for v in lists.values() for x in v]]))
    ratio = math.floor(max(0.0, 1 - out / size) * 100 + 0.5) / 100 if size else 0.0
    return {"issue": issue, "summary": summary, "businessGoal": goal, "architecture": [], **lists, "relatedIssues": related, "ignoredContent": ignored, "confidence": min(0.95, math.floor(confidence * 100 + 0.5) / 100), "compressionRatio": ratio}


def _signs(t):
    import unicodedata

    return all(unicodedata.category(x) in ("So", "Sk", "Cs") or x in ":;()[]{}-_*+~^ \t\n\x0b\f\r" for x in t)
