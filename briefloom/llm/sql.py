"""DuckDB SQL with the rows of those corpus queries that SQL can express."""

from __future__ import annotations

import unicodedata


#: The letters that look like a Latin one, by their names in the Unicode tables.
_NAMED = {
    "CYRILLIC SMALL LETTER": "A a, IE e, O o, ER p, ES c, U y, HA x, BYELORUSSIAN-UKRAINIAN I i, DZE s, JE j, SHHA h, KOMI DE d, QA q, WE w, PALOCHKA l",
    "CYRILLIC CAPITAL LETTER": "A A, VE B, IE E, KA K, EM M, EN H, O O, ER P, ES C, TE T, U Y, HA X, BYELORUSSIAN-UKRAINIAN I I, DZE S, JE J, QA Q, WE W",
    "CYRILLIC LETTER": "PALOCHKA I",
    "GREEK SMALL LETTER": "OMICRON o, NU v, RHO p",
    "GREEK CAPITAL LETTER": "ALPHA A, BETA B, EPSILON E, ZETA Z, ETA H, IOTA I, KAPPA K, MU M, NU N, OMICRON O, RHO P, TAU T, UPSILON Y, CHI X, YOT J",
    "GREEK": "LUNATE SIGMA SYMBOL c, LETTER YOT j, CAPITAL LUNATE SIGMA SYMBOL C",
    "ARMENIAN SMALL LETTER": "OH o, SEH u, VO n, HO h, CO g, ZA q",
    "ARMENIAN CAPITAL LETTER": "OH O, TIWN S",
    "CHEROKEE LETTER": "GO A, YV B, TLI C, A D, GV E, NAH G, MI H, GU J, TSO K, TLE L, LU M, TLV P, E R, DU S, I T, DO V, LA W, NO Z",
    "ROMAN NUMERAL": "ONE I, FIVE V, TEN X, FIFTY L, ONE HUNDRED C, FIVE HUNDRED D, ONE THOUSAND M",
    "SMALL ROMAN NUMERAL": "ONE i, FIVE v, TEN x, FIFTY l, ONE HUNDRED c, FIVE HUNDRED d, ONE THOUSAND m",
}
#: What shows nothing though it is no format character: fillers, inherent vowels and variation selectors.
_UNSEEN = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10)}


def _like() -> dict[str, str]:
    return {unicodedata.lookup(f"{kind} {x.rpartition(' ')[0]}"): x.rpartition(" ")[2] for kind, names in _NAMED.items() for x in names.split(", ")}


def _form(text: str) -> str:
    """The consistent form for comparisons: one code point to one, invisible ones out, then composed.

    Written from the statement of the problem with the Unicode tables alone: widths, fonts and kinds of blank don't show, nor do
    format characters, nor the script of a letter that looks Latin.
    """
    like, pairs, invisible = _like(), [], []
    for n in [*range(0x80, 0xD800), *range(0xE000, 0x110000)]:
        ch = chr(n)
        kind = unicodedata.category(ch)
        if kind == "Cn":
            continue
        if n in _UNSEEN or (kind == "Cf" and not 0x600 <= n <= 0x605):
            invisible.append(f"\\x{{{n:X}}}")
        elif kind == "Zs":
            pairs.append((ch, " "))
        elif kind in ("Zl", "Zp") or n == 0x85:
            pairs.append((ch, "\n"))
        elif not 0xAC00 <= n <= 0xD7A3:
            tag = unicodedata.decomposition(ch).partition(">")[0]
            parts = unicodedata.normalize("NFKD" if tag in ("<wide", "<narrow", "<font") else "NFD", ch)
            to = unicodedata.normalize("NFC", "".join(like.get(x, x) for x in parts))
            if len(to) == 1 and to != unicodedata.normalize("NFC", ch):
                pairs.append((ch, to))
    text = rf"regexp_replace({text}, '\r\n?', chr(10), 'g')"
    text = f"regexp_replace({text}, '[{''.join(invisible)}]', '', 'g')"
    old, new = ("".join(x).replace("'", "''") for x in zip(*pairs))
    return f"nfc_normalize(translate(replace({text}, chr(9), ' '), '{old}', '{new}'))"


def _look_alikes() -> str:
    one = """SELECT DISTINCT '{src}' AS src, a.id AS id_a, b.id AS id_b FROM r a JOIN r b ON a.src = b.src AND a.g = b.g AND a.form = b.form AND a.t <> b.t AND a.id < b.id WHERE a.src = '{src}'"""
    return f"""WITH s AS (SELECT DISTINCT 'comment' AS src, comment_id AS id, ticket_key AS g, body AS t FROM ticket_comments WHERE body IS NOT NULL AND ticket_key IS NOT NULL
        UNION ALL SELECT DISTINCT 'ticket', ticket_id, ticket_key, description FROM tickets WHERE description IS NOT NULL AND ticket_key IS NOT NULL),
        r AS (SELECT *, {_form("t")} AS form FROM s) {one.format(src="comment")} UNION ALL {one.format(src="ticket")}"""


def _consistent() -> str:
    return f"""SELECT src, id, t AS text, {_form("t")} AS form FROM (SELECT DISTINCT 'comment' AS src, comment_id AS id, body AS t FROM ticket_comments UNION ALL SELECT DISTINCT 'ticket', ticket_id, description FROM tickets)"""


P5 = """WITH w AS (SELECT DISTINCT comment_id AS id, list_sort(list_distinct(regexp_extract_all(translate(lower(body), chr(39) || '’', ''), '[a-z0-9]+'))) AS w FROM ticket_comments WHERE channel <> 'email' AND body IS NOT NULL),
    s AS (SELECT w, row_number() OVER () AS k FROM (SELECT DISTINCT w FROM w WHERE len(w) >= 30)),
    m AS (SELECT id, k FROM w JOIN s USING (w)),
    c AS (SELECT k, unnest(w) AS x, len(w) AS n FROM s),
    p AS (SELECT a.k AS ka, b.k AS kb FROM c a JOIN c b ON a.x = b.x AND a.k < b.k AND least(a.n, b.n) >= 0.75::DOUBLE * greatest(a.n, b.n) GROUP BY a.k, b.k, a.n, b.n HAVING count(*) >= 0.75::DOUBLE * (a.n + b.n - count(*))),
    l AS (SELECT ka, kb FROM p UNION ALL SELECT kb, ka FROM p UNION ALL SELECT k, k FROM s)
    SELECT DISTINCT x.id AS id_a, y.id AS id_b FROM l JOIN m x ON x.k = ka JOIN m y ON y.k = kb WHERE x.id < y.id"""

P7 = """WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
    gi AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i)),
    gd AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d))
    SELECT DISTINCT doc_id, item_id FROM gd JOIN gi USING (g)"""

P5_GROUPS = f"""WITH RECURSIVE {P5[5 : P5.index("l AS (")]}
    e AS MATERIALIZED (SELECT ka AS x, kb AS y FROM p UNION ALL SELECT kb, ka FROM p),
    r AS (SELECT k AS node, k AS root FROM s UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node),
    c2 AS (SELECT node AS k, min(root) AS root FROM r GROUP BY 1),
    g AS (SELECT c2.root, min(m.id) AS group_id FROM m JOIN c2 USING (k) GROUP BY 1)
    SELECT m.id, g.group_id, coalesce((SELECT count(*) FROM e WHERE e.x = m.k), 0) AS n_links, (SELECT count(*) FROM m y WHERE y.k = m.k) AS n_copies FROM m JOIN c2 USING (k) JOIN g USING (root)"""

#: Documents by the estimate, what the packing must place of each, and what no container may exceed.
_SIZES = "d AS (SELECT doc_id, max(coalesce(ceil(length(text) / 4.0), 0))::BIGINT AS n FROM documents WHERE doc_id IS NOT NULL GROUP BY 1), k AS (SELECT DISTINCT pack_id, capacity_tokens AS c FROM pack_sizes WHERE pack_id IS NOT NULL AND capacity_tokens > 0)"
P6_PLACED = f"WITH {_SIZES} SELECT pack_id, doc_id, greatest(1, ceil(n / c::DOUBLE))::BIGINT AS n_pieces, n AS n_tokens FROM d, k"
P6_LIMITS = f"WITH {_SIZES} SELECT pack_id, count(*) AS n_documents, sum(n)::BIGINT AS n_tokens, 0::BIGINT AS n_over_tokens, 0::BIGINT AS n_over_docs, 0::BIGINT AS n_over_cost FROM d, k GROUP BY pack_id"

#: All windows of 400 characters by their MD5 number, cut from parts of 1,000 starts each so that long texts stay linear.
_SHARED = """docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 400),
    parts AS (SELECT doc_id, c * 1000 AS base, substring(text, c * 1000 + 1, 1399) AS part FROM (SELECT *, unnest(range((length(text) + 999) // 1000)) AS c FROM docs)),
    w AS MATERIALIZED (SELECT doc_id, base + j AS pos, md5_number(substring(part, j, 400)) AS h FROM (SELECT *, unnest(range(1, least(1000, length(part) - 399) + 1)) AS j FROM parts)),
    hit AS MATERIALIZED (SELECT w.doc_id, w.pos FROM w SEMI JOIN (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)) r ON r.h = w.h),
    isl AS (SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= 400 THEN 0 ELSE 1 END AS fresh FROM hit)),
    sp AS MATERIALIZED (SELECT doc_id, (min(pos) - 1)::INT AS start_pos, (max(pos) - min(pos) + 400)::INT AS n_chars FROM isl GROUP BY doc_id, island)"""
P8 = f"WITH {_SHARED} SELECT * FROM sp"
P8_SHARE = f"""WITH {_SHARED}, n AS (SELECT doc_id, max(length(text))::BIGINT AS n_chars FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL GROUP BY 1),
    x AS (SELECT doc_id, count(*) AS n_spans, sum(n_chars)::BIGINT AS shared_chars FROM sp GROUP BY 1)
    SELECT doc_id, n_chars, coalesce(n_spans, 0) AS n_spans, coalesce(shared_chars, 0) AS shared_chars, CASE WHEN n_chars > 0 THEN coalesce(shared_chars, 0)::DOUBLE / n_chars::DOUBLE ELSE 0.0::DOUBLE END AS shared_part FROM n LEFT JOIN x USING (doc_id)"""


#: Lines of mails whose words all lie in runs of 14 words that an earlier message of the thread holds.
P4_INHERITED = r"""WITH m AS (SELECT DISTINCT comment_id AS id, ticket_key AS g, coalesce(channel = 'email', false) AS mail, replace(body, chr(13) || chr(10), chr(10)) AS t FROM ticket_comments WHERE comment_id IS NOT NULL AND ticket_key IS NOT NULL AND body IS NOT NULL),
    l AS (SELECT id, g, mail, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM m),
    w AS (SELECT id, g, mail, n, unnest(regexp_extract_all(lower(line), '[\p{L}\p{N}]+')) AS x, generate_subscripts(regexp_extract_all(lower(line), '[\p{L}\p{N}]+'), 1) AS k FROM l),
    p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id, g ORDER BY n, k) AS p FROM w),
    r AS MATERIALIZED (SELECT id, g, mail, p, string_agg(x, ' ') OVER o AS s FROM p WINDOW o AS (PARTITION BY id, g ORDER BY p ROWS BETWEEN CURRENT ROW AND 13 FOLLOWING) QUALIFY count(*) OVER o = 14),
    h AS (SELECT r.id, r.g, r.p FROM r JOIN (SELECT g, s, min(id) AS first FROM r GROUP BY g, s) f ON f.g = r.g AND f.s = r.s WHERE r.mail AND f.first < r.id),
    c AS (SELECT p.id, p.n, coalesce(max(h.p) OVER (PARTITION BY p.id, p.g ORDER BY p.p) >= p.p - 13, false) AS held FROM p LEFT JOIN h ON h.id = p.id AND h.g = p.g AND h.p = p.p WHERE p.mail)
    SELECT id AS comment_id, n::INT AS line_no FROM c GROUP BY id, n HAVING bool_and(held)"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": _look_alikes(), "p2_consistent_text": _consistent(), "p4_inherited": P4_INHERITED, "p5_found": P5, "p5_groups": P5_GROUPS, "p6_placed": P6_PLACED, "p6_placed_dot": P6_PLACED, "p6_limits": P6_LIMITS, "p6_limits_dot": P6_LIMITS, "p7_found": P7, "p8_found": P8, "p8_shared_share": P8_SHARE}
