"""SQL of the brief plan, from sources to records, with the rows of the plan's queries.

One chain of common table expressions, written from the rules and not from the plan: positions by windows, the ordered
collapse and the lists that keep the longer wording by recursion over positions, everything else by set operations.
"""

from __future__ import annotations

from ..functions import vocab

_EDGE = r"[^\p{L}\p{N}\p{Mn}_]"
_BLANKS = r"[ \t\n\x0b\f\r]"
#: List, category and stage of an extract, in the order of the record.
_LISTS = {"decisions": "DECISION", "constraints": "CONSTRAINT", "acceptanceCriteria": "ACCEPTANCE_CRITERIA", "risks": "RISK", "todos": "TODO", "dependencies": "DEPENDENCY"}
_ALL = ["architecture", *_LISTS]


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def re(text: str, pattern: str, to: str = "''", flags: str = "g") -> str:
    return f"regexp_replace({text}, {q(pattern)}, {to}, '{flags}')"


def spaces(t: str) -> str:
    return re(re(t, r"\r\n?", "chr(10)"), r"[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]", "' '")


def strip(t: str) -> str:
    return re(t, rf"^{_BLANKS}+|{_BLANKS}+$")


def form(t: str) -> str:
    return f"trim({re(f'''translate(lower({t}), '’' || chr(39), '')''', '[^a-z0-9]+', chr(39) + ' ' + chr(39))})"


def words(phrases: list[str]) -> str:
    return rf"(?i)(?:^|{_EDGE}){vocab.alternation(phrases)}(?:$|{_EDGE})"


def has(text: str, phrases: list[str]) -> str:
    return f"regexp_matches({text}, {q(words(phrases))})"


def needs(text: str) -> str:
    return f"regexp_matches({text}, {q(rf'(?i)(?:^|{_EDGE})(?:{vocab.alternation(vocab.DEPENDENCY)}|requires? (?:the )?(?:[a-z][\w-]+ )?{vocab.alternation(vocab.NEEDED_THINGS)})(?:$|{_EDGE})')})"


def units(t: str) -> str:
    """Length in UTF-16 units."""
    return f"(length({t}) + length({re(t, r'[^\x{10000}-\x{10FFFF}]')}))"


def log_dump(t: str) -> str:
    lines = f"regexp_split_to_array({re(t, _BLANKS + '+$')}, {q(r'\r\n|[\n\r\x0b\f\x{85}\x{2028}\x{2029}]')})"
    level = vocab.alternation(vocab.LOG_LEVELS)
    like = rf"^(?:at .*|Caused by:.*|\d{{4}}-\d{{2}}-\d{{2}}[T ].*|\[?{level}\]?\b.*|\w+(?:\.\w+)+(?:Exception|Error)(?::.*)?)$"
    n = f"len(list_filter({lines}, lambda x: regexp_matches({strip('x')}, {q(like)})))"
    return f"(len({lines}) >= 3 AND {n} >= greatest(3, floor(len({lines}) / 2)))"


def html(t: str) -> str:
    for pattern, to in [(r"(?s)<!--.*?-->", "''"), (r"(?is)<script\b.*?</script\s*>", "''"), (r"(?is)<style\b.*?</style\s*>", "''"), (r"\s+", "' '"), (r"(?i)<br\b[^>]*>", "chr(10)"), (r"(?i)</?(?:p|div|tr|h[1-6])\b[^>]*>", "chr(10)"), (r"(?i)<li\b[^>]*> ?", "'- '"), (r"(?i)</li\s*>", "chr(10)"), (r"</?[A-Za-z][^>]*>", "''")]:
        t = re(t, pattern, to)
    for name, to in [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")]:
        t = f"replace({t}, '{name}', {q(to)})"
    return re(t, " {2,}", "' '")


HTML_HINT = r"'(?i)<\s*(?:p|div|br|span|table|ul|ol|li|b|i|strong|em|h1|h2|h3|h4|h5|h6|a)\b'"


def mail_cut(t: str) -> str:
    """``t`` is a column: it is named twice."""
    return re(t, r"(?is)(?:^|\n)On [^\n]{5,120} wrote:[ \t\x0b\f\r]*(?:\n.*)?$", f"CASE WHEN regexp_matches({t}, {q(r'(?i)^On [^\n]{5,120} wrote:[ \t\x0b\f\r]*(?:\n|$)')}) THEN '' ELSE chr(10) END", "")


def quoted_out(t: str) -> str:
    return re(t, rf"(?m)^{_BLANKS}*>[^\n\r\x{{85}}\x{{2028}}\x{{2029}}]*")


def signature_cut(t: str) -> str:
    return re(t, r"(?s)(?:^|\n)--[ \t\x0b\f\r]*(?:\n.*)?$", f"CASE WHEN regexp_matches({t}, {q(r'^--[ \t\x0b\f\r]*(?:\n|$)')}) THEN '' ELSE chr(10) END", "")


def squeeze(t: str) -> str:
    return strip(re(re(t, r"(?m)[ \t]+$"), r"\n{3,}", "chr(10) || chr(10)"))


def cleaned(table: str, keys: str, name: str) -> str:
    """CTEs that clean the column ``t`` of a table; the last is called ``name``."""
    steps = [spaces("t"), f"CASE WHEN regexp_matches(t, {HTML_HINT}) THEN {html('t')} ELSE t END", mail_cut("t"), quoted_out("t"), signature_cut("t"), squeeze("t")]
    out, last = [], table
    for k, x in enumerate(steps):
        here = name if k == len(steps) - 1 else f"{name}_{k}"
        out.append(f"{here} AS (SELECT {keys}, {x} AS t FROM {last})")
        last = here
    return ", ".join(out)


def reason(t: str) -> str:
    text = strip(t)
    body = r"(?i)^(?:build\s+#?\d+\s+(?:started|succeeded|failed|passed)|deployment\s+(?:started|completed|triggered)|branch\s+\S+\s+was\s+(?:created|deleted))[^\n]*$"
    hello = rf"(?i)^{vocab.alternation(vocab.GREETINGS)}[\s!.,]*$"
    signs = r"^[\p{So}\p{Sk}:;()\[\]{}\-_*+~^\s]+$"
    return f"""CASE WHEN NOT regexp_matches({t}, '[^ \\t\\n\\x0b\\f\\r]') THEN 'empty'
        WHEN coalesce(bot, false) OR {has("coalesce(author, '')", vocab.FILTER_BOTS)} OR regexp_matches({text}, {q(body)}) THEN 'bot message'
        WHEN regexp_matches({text}, {q(hello)}) THEN 'greeting/acknowledgement'
        WHEN regexp_matches({t}, {q(signs)}) THEN 'emoji/symbol spam'
        WHEN {log_dump(t)} THEN 'log dump' END"""


def pieces(table: str, keys: str, column: str, split: str, name: str) -> str:
    """Rows ``keys, pos, {column}`` of the non-empty stripped parts that ``split`` gives, numbered from 0."""
    return f"""SELECT {keys}, (row_number() OVER (PARTITION BY {keys} ORDER BY i) - 1)::INT AS {name}, x AS {column} FROM (
        SELECT {keys}, i, {strip("x")} AS x FROM (SELECT {keys}, unnest(parts) AS x, generate_subscripts(parts, 1) AS i FROM (SELECT {keys}, {split} AS parts FROM {table}))) WHERE x <> ''"""


def paragraphs(t: str) -> str:
    return f"regexp_split_to_array({t}, {q(rf'\n{_BLANKS}*\n')})"


def sentence_list(t: str) -> str:
    cut = re(strip(t), rf"""([.!?]){_BLANKS}+([A-Z"'(\[])""", r"'\1' || chr(10) || '\2'")
    return f"string_split({cut}, chr(10))"


def near(a: str, b: str) -> str:
    """Of rows with ``form`` and the word list ``w``."""
    long_ = f"(length({a}.form) > 20 AND length({b}.form) > 20 AND (contains({a}.form, {b}.form) OR contains({b}.form, {a}.form)))"
    common = f"len(list_intersect({a}.w, {b}.w))"
    return f"({a}.form = {b}.form OR {long_} OR ({a}.form <> '' AND {b}.form <> '' AND least(len({a}.w), len({b}.w)) >= 0.75::DOUBLE * greatest(len({a}.w), len({b}.w)) AND {common} >= 0.75::DOUBLE * (len({a}.w) + len({b}.w) - {common})))"


def collapse(items: str, p: str) -> str:
    """CTEs over ``items`` (g, pos, form; pos unique in g, from 1): ``{p}_by`` has g, form and the position of the first kept text."""
    return f"""{p}_rep AS MATERIALIZED (SELECT g, form, min(pos) AS pos, list_distinct(string_split(form, ' ')) AS w FROM {items} GROUP BY g, form),
    {p}_edge AS MATERIALIZED (SELECT x.g, x.pos AS a, y.pos AS b FROM {p}_rep x JOIN {p}_rep y ON x.g = y.g AND x.pos < y.pos WHERE {near("x", "y")}),
    {p}_adj AS MATERIALIZED (SELECT g, pos, row_number() OVER (PARTITION BY g ORDER BY pos) AS seq, adj FROM (SELECT n.g, n.pos, coalesce(list(e.a) FILTER (e.a IS NOT NULL), []) AS adj FROM (SELECT g, a AS pos FROM {p}_edge UNION SELECT g, b FROM {p}_edge) n LEFT JOIN {p}_edge e ON e.g = n.g AND e.b = n.pos GROUP BY n.g, n.pos)),
    {p}_fold AS (SELECT g, 0::BIGINT AS seq, []::BIGINT[] AS kept, NULL::BIGINT AS pos, NULL::BIGINT AS top FROM (SELECT DISTINCT g FROM {p}_adj)
        UNION ALL SELECT f.g, r.seq, CASE WHEN len(list_intersect(f.kept, r.adj)) = 0 THEN list_append(f.kept, r.pos) ELSE f.kept END, r.pos, list_min(list_intersect(f.kept, r.adj)) FROM {p}_fold f JOIN {p}_adj r ON r.g = f.g AND r.seq = f.seq + 1),
    {p}_by AS MATERIALIZED (SELECT r.g, r.form, coalesce(f.top, r.pos) AS top FROM {p}_rep r LEFT JOIN {p}_fold f ON f.g = r.g AND f.pos = r.pos)"""


def keep_longer(items: str, p: str) -> str:
    """CTEs over ``items`` (g, pos, text; pos unique in g): ``{p}_out`` has g, pos and the text that stays there."""
    return f"""{p}_item AS MATERIALIZED (SELECT g, pos, text, {form("text")} AS form, list_distinct(string_split({form("text")}, ' ')) AS w, {units("text")} AS u FROM {items}),
    {p}_edge AS MATERIALIZED (SELECT x.g, x.pos AS a, y.pos AS b FROM {p}_item x JOIN {p}_item y ON x.g = y.g AND x.pos < y.pos WHERE {near("x", "y")}),
    {p}_adj AS MATERIALIZED (SELECT i.g, i.pos, i.u, row_number() OVER (PARTITION BY i.g ORDER BY i.pos) AS seq, coalesce(list(e.a) FILTER (e.a IS NOT NULL), []) AS adj
        FROM {p}_item i SEMI JOIN (SELECT g, a AS pos FROM {p}_edge UNION SELECT g, b FROM {p}_edge) n ON n.g = i.g AND n.pos = i.pos LEFT JOIN {p}_edge e ON e.g = i.g AND e.b = i.pos GROUP BY i.g, i.pos, i.u),
    {p}_fold AS (SELECT g, 0::BIGINT AS seq, []::BIGINT[] AS first, []::BIGINT[] AS cur, []::BIGINT[] AS size FROM (SELECT DISTINCT g FROM {p}_adj)
        UNION ALL SELECT g, seq, CASE WHEN s IS NULL THEN list_append(first, pos) ELSE first END, CASE WHEN s IS NULL THEN list_append(cur, pos) WHEN u > size[s] THEN list_concat(list_append(cur[1 : s - 1], pos), cur[s + 1 :]) ELSE cur END,
            CASE WHEN s IS NULL THEN list_append(size, u) WHEN u > size[s] THEN list_concat(list_append(size[1 : s - 1], u), size[s + 1 :]) ELSE size END
        FROM (SELECT r.g, r.seq, r.pos, r.u, f.first, f.cur, f.size, nullif(list_position(list_transform(f.cur, lambda x: list_contains(r.adj, x)), true), 0) AS s FROM {p}_fold f JOIN {p}_adj r ON r.g = f.g AND r.seq = f.seq + 1)),
    {p}_last AS (SELECT g, arg_max(first, seq) AS first, arg_max(cur, seq) AS cur FROM {p}_fold GROUP BY g),
    {p}_out AS MATERIALIZED (SELECT s.g, s.pos, i.text FROM (SELECT g, unnest(first) AS pos, unnest(cur) AS cur FROM {p}_last) s JOIN {p}_item i ON i.g = s.g AND i.pos = s.cur
        UNION ALL SELECT g, pos, text FROM {p}_item i ANTI JOIN {p}_adj a ON a.g = i.g AND a.pos = i.pos)"""


TABLES = """hd AS MATERIALIZED (SELECT ticket_key AS doc, ticket_key AS key, coalesce(title, '') AS title, coalesce(description, '') AS description, coalesce(metadata['linkedIssues'], '') AS linked FROM (
        SELECT *, row_number() OVER (PARTITION BY ticket_key ORDER BY exported_at DESC NULLS LAST, ticket_id DESC) AS r FROM tickets WHERE ticket_key IS NOT NULL) WHERE r = 1),
    ca AS MATERIALIZED (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY comment_id) AS no, coalesce(author, '') AS author, coalesce(body, '') AS body, coalesce(bot, false) AS bot FROM (
        SELECT ticket_key AS doc, *, row_number() OVER (PARTITION BY ticket_key, comment_id ORDER BY ingested_at) AS r FROM ticket_comments WHERE ticket_key IS NOT NULL AND comment_id IS NOT NULL) WHERE r = 1),
    cm AS MATERIALIZED (SELECT ca.* FROM ca SEMI JOIN hd ON hd.doc = ca.doc)"""
DOCUMENTS = """hd AS MATERIALIZED (SELECT doc_id::VARCHAR AS doc, '' AS key, doc_id::VARCHAR AS title, coalesce(text, '') AS description, '' AS linked FROM documents WHERE doc_id IS NOT NULL),
    cm AS MATERIALIZED (SELECT doc, 1::BIGINT AS no, '' AS author, '' AS body, false AS bot FROM hd WHERE false)"""

_SOURCES = f"""so AS (SELECT doc, 0::BIGINT AS no, '' AS author, false AS bot, description AS t FROM hd UNION ALL SELECT doc, no, author, bot, body FROM cm),
    {cleaned("so", "doc, no, author, bot", "cl")},
    sr AS MATERIALIZED (SELECT doc, no, t, CASE WHEN no > 0 THEN {reason("t")} END AS reason FROM cl)"""
_NOISE = f"""nz AS (SELECT doc, 1 AS kind, no, 'Log/stack-trace dump removed from comment:' || no || ' (' || {units("t")} || ' chars)' AS text FROM sr WHERE reason = 'log dump'
        UNION ALL SELECT doc, CASE reason WHEN 'bot message' THEN 2 WHEN 'greeting/acknowledgement' THEN 3 ELSE 4 END, 0, count(*) || CASE reason WHEN 'bot message' THEN ' bot message(s) removed' WHEN 'greeting/acknowledgement' THEN ' greeting/acknowledgement comment(s) removed' ELSE ' emoji-only comment(s) removed' END
            FROM sr WHERE reason IN ('bot message', 'greeting/acknowledgement', 'emoji/symbol spam') GROUP BY doc, reason)"""
_BLOCKS = f"""bl AS (SELECT doc, no, k, text FROM ({pieces("(SELECT doc, no, t FROM sr WHERE reason IS NULL)", "doc, no", "text", paragraphs("t"), "k")})),
    bf AS MATERIALIZED (SELECT doc AS g, no, k, text, {form("text")} AS form, row_number() OVER (PARTITION BY doc ORDER BY no, k) AS pos FROM bl),
    {collapse("bf", "cb")},
    pb AS MATERIALIZED (SELECT b.g AS doc, b.no, b.k, b.text, b.pos, c.top FROM bf b JOIN cb_by c ON c.g = b.g AND c.form = b.form),
    kp AS MATERIALIZED (SELECT doc, no, k, text, pos, (SELECT count(*) FROM pb y WHERE y.doc = x.doc AND y.top = x.pos) AS times FROM pb x WHERE pos = top)"""


def line_rules(table: str, keys: str, p: str) -> str:
    """CTEs over ``table`` (keys, text): ``{p}_items`` and ``{p}_runs`` are the section items and scenarios (keys, i, text), i in order."""
    heading = rf"(?i)^\s*(?:h\d\.\s*|#{{1,6}}\s*|\*{{0,2}})\s*{vocab.alternation(vocab.SECTION)}(?:{_EDGE}.*)?$"
    marker, gherkin = r"^\s*(?:[-*+]\s*(?:\[[ xX]\]\s*)?|\d+[.)]\s+)(.+)$", rf"(?i)^\s*(?:[-*]\s*)?{vocab.alternation(vocab.GHERKIN)}\s+.+$"
    before = f"OVER (PARTITION BY {keys} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""{p}_line AS MATERIALIZED (SELECT *, regexp_matches(line, {q(heading)}) AS head, regexp_matches(line, {q(marker)}) AS item, regexp_matches(line, {q(gherkin)}) AS step, NOT regexp_matches(line, '[^ \\t\\n\\x0b\\f\\r]') AS blank
        FROM (SELECT {keys}, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {table})),
    {p}_items AS (SELECT {keys}, i, {strip(f"regexp_extract(line, {q(marker)}, 1)")} AS text FROM (
        SELECT *, max(CASE WHEN head THEN i END) {before} AS opened, max(CASE WHEN NOT (head OR item OR step OR blank) THEN i END) {before} AS closed FROM {p}_line) WHERE item AND NOT head AND opened > coalesce(closed, 0)),
    {p}_runs AS (SELECT {keys}, min(i) AS i, string_agg({re(strip("line"), r"^[-*]\s*")}, ' ' ORDER BY i) AS text FROM (
        SELECT *, i - row_number() OVER (PARTITION BY {keys} ORDER BY i) AS run FROM {p}_line WHERE step) GROUP BY {keys}, run HAVING count(*) >= 2)"""


def _extracts() -> str:
    decides = f"({has('s', vocab.DECISION)} OR {has('s', vocab.REJECTION)})"
    return f"""se AS MATERIALIZED ({pieces("kp", "doc, pos", "s", sentence_list("text"), "i")}),
    {line_rules("kp", "doc, pos", "ac")},
    raw AS MATERIALIZED (SELECT doc, pos, i AS j, 'decisions' AS list, 'DECISION' AS category, s AS text FROM se WHERE {decides}
        UNION ALL SELECT doc, pos, (row_number() OVER (PARTITION BY doc, pos ORDER BY kind, i) - 1)::INT, 'acceptanceCriteria', 'ACCEPTANCE_CRITERIA', text FROM (SELECT doc, pos, 1 AS kind, i, text FROM ac_items UNION ALL SELECT doc, pos, 2, i, text FROM ac_runs)
        UNION ALL SELECT doc, pos, i, 'constraints', 'CONSTRAINT', s FROM se WHERE {has("s", vocab.REQUIREMENT)}
        UNION ALL SELECT doc, pos, i, 'todos', 'TODO', {re("s", "(?i)^(?:todo|fixme)" + _BLANKS + "*[:-]" + _BLANKS + "*", flags="")} FROM se WHERE {has("s", vocab.TODO)}
        UNION ALL SELECT doc, pos, i, CASE WHEN d THEN 'dependencies' ELSE 'risks' END, CASE WHEN d THEN 'DEPENDENCY' ELSE 'RISK' END, s FROM (SELECT *, {needs("s")} AS d FROM se) WHERE d OR {has("s", vocab.RISK)}),
    crit AS (SELECT doc, {form("text")} AS f, min(pos) AS pos FROM raw WHERE list = 'acceptanceCriteria' GROUP BY 1, 2),
    ex AS MATERIALIZED (SELECT * FROM raw WHERE list <> 'constraints' UNION ALL SELECT doc, pos, j, list, category, text FROM (SELECT *, {form("text")} AS f FROM raw WHERE list = 'constraints') r
        WHERE NOT EXISTS (SELECT 1 FROM crit c WHERE c.doc = r.doc AND c.pos <= r.pos AND (contains(r.f, c.f) OR contains(c.f, r.f))))"""


def _scores() -> str:
    weight = "CASE c " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in vocab.WEIGHTS.items()) + " END"
    decides = f"({has('s', vocab.DECISION)} OR {has('s', vocab.REJECTION)})"
    return f"""cat AS (SELECT DISTINCT doc, pos, category AS c FROM ex UNION SELECT doc, pos, 'ARCHITECTURE' FROM se WHERE {decides} AND {has("s", vocab.ARCHITECTURE)}
        UNION SELECT doc, pos, 'BUSINESS_GOAL' FROM kp WHERE {has("text", vocab.GOAL_BLOCK)} UNION SELECT doc, pos, 'NOISE' FROM kp WHERE {log_dump("text")}),
    cats AS (SELECT k.doc, k.pos, coalesce(c.c, 'DISCUSSION') AS c FROM kp k LEFT JOIN cat c ON c.doc = k.doc AND c.pos = k.pos),
    sc AS MATERIALIZED (SELECT k.*, x.categories, CASE WHEN x.noise THEN {vocab.WEIGHTS["NOISE"]}::DOUBLE ELSE least(0.99::DOUBLE, x.best + least(0.1::DOUBLE, (k.times - 1) * 0.05::DOUBLE)) END AS score FROM kp k
        JOIN (SELECT doc, pos, string_agg(c, ',' ORDER BY c) AS categories, max({weight}) AS best, bool_or(c = 'NOISE') AS noise FROM cats GROUP BY doc, pos) x ON x.doc = k.doc AND x.pos = k.pos)"""


def _lists() -> str:
    return f"""li AS (SELECT doc || chr(1) || list AS g, pos * 1000000 + j AS pos, text FROM ex),
    {keep_longer("li", "ul")},
    ls AS MATERIALIZED (SELECT split_part(o.g, chr(1), 1) AS doc, split_part(o.g, chr(1), 2) AS field, b.no, b.k, (o.pos % 1000000)::INT AS j, o.text, o.pos FROM ul_out o JOIN bf b ON b.g = split_part(o.g, chr(1), 1) AND b.pos = o.pos // 1000000)"""


def _records() -> str:
    levels = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in vocab.LEVELS.items())
    weight = "CASE field " + " ".join(f"WHEN '{k}' THEN {vocab.WEIGHTS[c]}::DOUBLE" for k, c in _LISTS.items()) + " END"
    keys = lambda t: f"regexp_extract_all({t}, {q(r'\b[A-Z][A-Z0-9]{1,9}-\d+\b-?')})"
    joined = lambda name: f"(SELECT string_agg(text, chr(10) ORDER BY pos) FROM lv WHERE lv.doc = h.doc AND lv.level = h.level AND lv.field = '{name}')"
    chars = "+".join(f"coalesce((SELECT sum({units('text')}) FROM lv WHERE lv.doc = h.doc AND lv.level = h.level AND lv.field = '{f}'), 0)" for f in _LISTS)
    alike = f"""(contains(summary, said) OR (SELECT {near("x", "y")} FROM (SELECT {form("summary")} AS form, list_distinct(string_split({form("summary")}, ' ')) AS w) x, (SELECT {form("said")} AS form, list_distinct(string_split({form("said")}, ' ')) AS w) y))"""
    return f"""lvl(level, threshold) AS (VALUES {levels}),
    live AS MATERIALIZED (SELECT s.*, l.level FROM sc s, lvl l WHERE s.score >= l.threshold),
    lv AS MATERIALIZED (SELECT ls.doc, l.level, field, text, pos FROM ls, lvl l WHERE {weight} >= l.threshold),
    sm AS (SELECT doc, level, arg_min(text, pos) AS text FROM live WHERE no = 0 GROUP BY 1, 2),
    smt AS (SELECT sm.doc, sm.level, array_to_string(list_filter(list_transform({sentence_list("text")}, lambda x: {strip("x")}), lambda x: x <> '')[1:2], ' ') AS summary FROM sm),
    gl AS (SELECT l.doc, l.level, arg_min(e.s, l.pos * 1000000 + e.i) AS said FROM live l JOIN se e ON e.doc = l.doc AND e.pos = l.pos WHERE {has("e.s", vocab.GOAL_SENTENCE)} GROUP BY 1, 2),
    rk AS (SELECT h.doc, l.level, 0 AS part, 0::BIGINT AS a, generate_subscripts({keys("h.title")}, 1) AS b, unnest({keys("h.title")}) AS key FROM hd h, lvl l
        UNION ALL SELECT doc, level, 1, pos, generate_subscripts({keys("text")}, 1), unnest({keys("text")}) FROM live),
    rl AS (SELECT * FROM rk WHERE key NOT LIKE '%-' UNION ALL SELECT doc, level, 2, 0, i, {strip("x")} FROM (SELECT h.doc, l.level, unnest(string_split(h.linked, ',')) AS x, generate_subscripts(string_split(h.linked, ','), 1) AS i FROM hd h, lvl l WHERE regexp_matches(h.linked, '[^ \\t\\n\\x0b\\f\\r]'))),
    rel AS MATERIALIZED (SELECT doc, level, string_agg(key, chr(10) ORDER BY seq) AS related, sum({units("key")}) AS chars FROM (SELECT r.doc, r.level, r.key, min((part, a, b)) AS seq FROM rl r JOIN hd h ON h.doc = r.doc WHERE r.key <> h.key GROUP BY 1, 2, 3) GROUP BY 1, 2),
    ig AS (SELECT n.doc, l.level, n.kind, n.no, n.text FROM nz n, lvl l
        UNION ALL SELECT x.doc, l.level, 5, 0, x.n || ' duplicate/near-duplicate paragraph(s) collapsed' FROM (SELECT doc, count(*) AS n FROM pb WHERE pos <> top GROUP BY doc) x, lvl l
        UNION ALL SELECT s.doc, l.level, 6, 0, count(*) || ' low-value paragraph(s) dropped below the ' || lower(l.level) || ' threshold' FROM sc s, lvl l WHERE s.score < l.threshold GROUP BY s.doc, l.level),
    igt AS (SELECT doc, level, string_agg(text, chr(10) ORDER BY kind, no) AS ignored FROM ig GROUP BY 1, 2),
    r1 AS (SELECT h.doc, h.level, {strip("h.key || ' ' || h.title")} AS issue, coalesce(s.summary, h.title) AS summary, g.said, {", ".join(f"{joined(f)} AS {f}" for f in _LISTS)},
            coalesce(r.related, '') AS "relatedIssues", coalesce(i.ignored, '') AS "ignoredContent", {chars} + coalesce(r.chars, 0) AS listed,
            {units("h.title")} + {units("h.description")} + coalesce((SELECT sum({units("body")}) FROM cm WHERE cm.doc = h.doc), 0) AS "rawChars"
        FROM (SELECT * FROM hd, lvl) h LEFT JOIN smt s ON s.doc = h.doc AND s.level = h.level LEFT JOIN gl g ON g.doc = h.doc AND g.level = h.level LEFT JOIN rel r ON r.doc = h.doc AND r.level = h.level LEFT JOIN igt i ON i.doc = h.doc AND i.level = h.level),
    r2 AS (SELECT *, CASE WHEN said IS NULL OR {alike} THEN '' ELSE said END AS goal FROM r1),
    r3 AS (SELECT *, listed + {units("issue")} + {units("summary")} + {units("goal")} AS emitted,
            0.5::DOUBLE + (CASE WHEN regexp_matches(summary, '[^ \\t\\n\\x0b\\f\\r]') THEN 0.1::DOUBLE ELSE 0 END) + (CASE WHEN decisions IS NOT NULL THEN 0.15::DOUBLE ELSE 0 END) + (CASE WHEN "acceptanceCriteria" IS NOT NULL THEN 0.15::DOUBLE ELSE 0 END)
            + (CASE WHEN regexp_matches(goal || summary, '[^ \\t\\n\\x0b\\f\\r]') THEN 0.05::DOUBLE ELSE 0 END) AS points FROM r2),
    cir AS MATERIALIZED (SELECT doc, level, issue, summary, goal AS "businessGoal", '' AS architecture, {", ".join(f"coalesce({f}, '') AS {f}" for f in _LISTS)}, "relatedIssues", "ignoredContent",
            least(0.95::DOUBLE, floor(points * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE) AS confidence,
            CASE WHEN "rawChars" = 0 THEN 0.0::DOUBLE ELSE floor(greatest(0.0::DOUBLE, 1.0::DOUBLE - emitted::DOUBLE / "rawChars"::DOUBLE) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE END AS "compressionRatio", "rawChars"::BIGINT AS "rawChars", emitted::BIGINT AS "emittedChars" FROM r3)"""


_FIELDS = ["issue", "summary", "businessGoal", *_ALL, "relatedIssues", "ignoredContent"]
_HEADINGS = {"architecture": "Architecture", "decisions": "Decisions", "constraints": "Constraints", "acceptanceCriteria": "Acceptance Criteria", "risks": "Risks", "todos": "TODOs", "dependencies": "Dependencies", "relatedIssues": "Related Issues"}


def _markdown() -> str:
    """Of ``cir``, whose lists are texts with a line for each entry: an entry may itself hold line feeds, so that bullets come from the rows."""
    rows = lambda f: f"""(SELECT string_agg('- ' || text, chr(10) ORDER BY pos) FROM lv WHERE lv.doc = c.doc AND lv.level = c.level AND lv.field = '{f}')"""
    related = "CASE WHEN \"relatedIssues\" <> '' THEN '- ' || replace(\"relatedIssues\", chr(10), chr(10) || '- ') END"
    sections = " || ".join(f"coalesce('## {h}' || chr(10) || {related if f == 'relatedIssues' else 'NULL' if f == 'architecture' else rows(f)} || chr(10) || chr(10), '')" for f, h in _HEADINGS.items())
    full = r"'[^ \t\n\x0b\f\r]'"
    return f"""'# ' || issue || chr(10) || chr(10) || CASE WHEN regexp_matches(summary, {full}) THEN summary || chr(10) || chr(10) ELSE '' END || CASE WHEN regexp_matches("businessGoal", {full}) THEN '**Business goal:** ' || "businessGoal" || chr(10) || chr(10) ELSE '' END
        || {sections} || '---' || chr(10) || 'confidence: ' || confidence || ' | compression: ' || floor("compressionRatio" * 100::DOUBLE + 0.5::DOUBLE)::INT || '%' || chr(10)"""


def _json() -> str:
    """The pretty form: two blanks, " : " between name and value, lists on one line."""
    listed = lambda f: f"""'[ ' || coalesce((SELECT string_agg(to_json(text)::VARCHAR, ', ' ORDER BY pos) || ' ' FROM lv WHERE lv.doc = c.doc AND lv.level = c.level AND lv.field = '{f}'), '') || ']'"""
    lines = lambda f: f"""'[ ' || CASE WHEN "{f}" = '' THEN '' ELSE array_to_string(list_transform(string_split("{f}", chr(10)), lambda x: to_json(x)::VARCHAR), ', ') || ' ' END || ']'"""
    value = lambda f: "'[ ]'" if f == "architecture" else listed(f) if f in _LISTS else lines(f) if f in ("relatedIssues", "ignoredContent") else f'to_json("{f}")::VARCHAR'
    named = [(f, value(f)) for f in _FIELDS] + [(f, f'"{f}"') for f in ("confidence", "compressionRatio")]
    return "'{' || chr(10) || " + " || ',' || chr(10) || ".join(f"""'  "{f}" : ' || {v}""" for f, v in named) + " || chr(10) || '}'"


def _with(upto: str, select: str, sources: str = TABLES) -> str:
    chain = [sources, _SOURCES, _NOISE, _BLOCKS, _extracts(), _scores(), _lists(), _records()]
    parts = {"sources": 1, "clean": 2, "noise": 3, "blocks": 4, "extracts": 5, "scores": 6, "lists": 7, "records": 8}
    return f"WITH RECURSIVE {', '.join(chain[: parts[upto]])} {select}"


_CONTEXT = """raw AS (SELECT h.doc, coalesce((SELECT string_agg(t, chr(10) || chr(10) ORDER BY n) FROM (SELECT -2 AS n, h.title AS t UNION ALL SELECT -1, h.description UNION ALL SELECT cx.no, cx.body FROM ca cx WHERE cx.doc = h.doc) WHERE regexp_matches(t, '[^ \\t\\n\\x0b\\f\\r]')), '') AS text FROM hd h)"""
_RAW = """SELECT hd.doc, coalesce(x.text, '') AS text FROM hd LEFT JOIN (SELECT doc, string_agg(t, chr(10) || chr(10) ORDER BY n) AS text FROM (
    SELECT doc, -2 AS n, title AS t FROM hd UNION ALL SELECT doc, -1, description FROM hd UNION ALL SELECT doc, no, body FROM ca) WHERE regexp_matches(t, '[^ \\t\\n\\x0b\\f\\r]') GROUP BY doc) x ON x.doc = hd.doc"""


def oracle_sql() -> dict[str, str]:
    tokens = lambda t: f"ceil(length({t}) / 4.0)::BIGINT"
    full = "FROM cir c WHERE level = 'FULL'"
    return {
        "raw_context": _with("sources", _RAW),
        "noise_counts": _with("noise", "SELECT doc, text FROM nz"),
        "plan_blocks": _with("blocks", "SELECT x.doc, x.no, x.k, y.no AS kept_no, y.k AS kept_k, x.text FROM pb x JOIN pb y ON y.doc = x.doc AND y.pos = x.top"),
        "plan_extracts": _with("extracts", "SELECT e.doc, b.no, b.k, e.j, e.list, e.category, e.text FROM ex e JOIN kp b ON b.doc = e.doc AND b.pos = e.pos"),
        "block_score": _with("scores", "SELECT doc, no, k, times, categories, score FROM sc"),
        "section_gate": _with("lists", "SELECT doc, field, no, k, j, text FROM ls"),
        "cir_full": _with("records", "SELECT * FROM cir WHERE level = 'FULL'"),
        "cir_levels": _with("records", "SELECT * FROM cir"),
        "cir_by_level": _with("records", 'SELECT level, count(*) AS n, round(avg("compressionRatio"), 6) AS ratio, round(avg(confidence), 6) AS confidence FROM cir GROUP BY level'),
        "markdown_brief": _with("records", f"SELECT doc, level, {_markdown()} AS text {full}"),
        "json_brief": _with("records", f"SELECT doc, level, {_json()} AS text {full}"),
        "document_briefs": _with("records", "SELECT * FROM cir WHERE level = 'FULL'", DOCUMENTS),
        "context_reduction": _with("records", f""", rw AS ({_RAW}), md AS (SELECT doc, {tokens(_markdown())} AS tokens_after {full})
            SELECT rw.doc, {tokens("rw.text")} AS tokens_before, tokens_after, CASE WHEN {tokens("rw.text")} > 0 THEN greatest(0.0::DOUBLE, 1.0::DOUBLE - tokens_after::DOUBLE / {tokens("rw.text")}::DOUBLE) ELSE 0.0::DOUBLE END AS reduction FROM rw JOIN md ON md.doc = rw.doc"""),
    }
