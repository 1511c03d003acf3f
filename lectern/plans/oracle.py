"""SQL for the named queries, written independently of the Spark side and run by another engine.

Valid for texts without characters that NFKC changes, which holds for the given tables. Shared steps are common table
expressions; a query pulls in those it names.
"""
from __future__ import annotations

import re

from lectern import values as v
from lectern.config import JobConfig
from lectern.operators.requests import ANSWER_SHAPE
from lectern.plans import derived

CFG = JobConfig()
LIMIT = 1500
WS = v.WS_CLASS
NL = "chr(10)"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '\A[{WS}]+|[{WS}]+\z', '', 'g')"


def collapse(x: str) -> str:
    return trim(f"regexp_replace({x}, '[{WS}]+', ' ', 'g')")


def canon(x: str) -> str:
    marks = (v.SINGLE_QUOTES + v.DOUBLE_QUOTES)
    plain = "'" * len(v.SINGLE_QUOTES) + '"' * len(v.DOUBLE_QUOTES)
    return f"lower(translate(regexp_replace({x}, '[{v.DROP_CLASS}]+', '', 'g'), {lit(marks)}, {lit(plain)}))"


def norm(x: str) -> str:
    out = rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"
    out = rf"regexp_replace({out}, '[\x{{00}}-\x{{08}}\x{{0b}}-\x{{1f}}\x{{7f}}]', ' ', 'g')"
    out = rf"regexp_replace({out}, '[ \t]+', ' ', 'g')"
    return trim(rf"regexp_replace({out}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def display(x: str) -> str:
    return rf"regexp_replace({collapse(x)}, '(\p{{L}})[-\x{{ad}}\x{{2010}}] (\p{{Ll}})', '\1\2', 'g')"


def page_of(x: str) -> str:
    def one(p):
        g = f"TRY_CAST(nullif(regexp_extract({x}, {lit(p.format(ws=WS))}, 1), '') AS INTEGER)"
        return f"CASE WHEN {g} BETWEEN 1 AND {v.MAX_PAGE_NUMBER} THEN {g} END"
    return f"coalesce({', '.join(one(p) for p in v.LOCATION_PATTERNS)}, 0)"


def filled(x: str, default: str) -> str:
    return f"coalesce(nullif({x}, ''), {lit(default)})"


def esc(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def by_category(field: int, column: str = "category") -> str:
    return f"CASE {column} " + " ".join(f"WHEN {lit(r[0])} THEN {lit(r[field])}" for r in v.CATEGORY_TABLE) + " END"


def _heading_case(field) -> str:
    rules = " ".join(f"WHEN regexp_matches(title, {lit(p.format(ws=WS))}) THEN {field(k, n)}" for k, n, p in v.HEADING_RULES)
    return f"CASE WHEN length(t) NOT BETWEEN 2 AND 60 OR regexp_matches(t, {lit(v.SUBHEADING)}) THEN NULL {rules} END"


def _quote_case(altered: str) -> str:
    typo = "left(s, 14) || '#' || substr(s, 16)"
    ending = "left(s, CAST(floor(length(s) / 2) AS INTEGER)) || ' words that nobody wrote in this paper'"
    first = {"": "", "typo": f"WHEN length(s) >= 60 THEN {typo}",
             "mixed": f"WHEN j % 4 = 2 AND length(s) >= 60 THEN {typo} WHEN j % 4 = 3 THEN {ending}"}[altered]
    return f"CASE {first} WHEN j % 4 = 1 THEN replace(s, ' ', '  ') ELSE s END"


def _claims(altered: str) -> str:
    return f"""
      SELECT doc_id, j AS claim_no, s, {_quote_case(altered)} AS quote,
        CASE j % 5 WHEN 0 THEN 'Section 2, Page ' || (j + 1) WHEN 1 THEN 'p. ' || (j + 1) WHEN 2 THEN '第 ' || (j + 1) || ' 页'
          WHEN 3 THEN 'Page 99999' ELSE '' END AS location
      FROM (SELECT doc_id, unnest(sents) AS s, CAST(generate_subscripts(sents, 1) - 1 AS INTEGER) AS j FROM sents)"""


def _grounded(claims: str, key: str) -> str:
    """Exact grounding of rows with doc_id, quote, location."""
    return f"""
      SELECT *, CASE WHEN verified AND has_page_info THEN CASE WHEN len(hits) = 1 THEN hits[1] ELSE 0 END
                ELSE {page_of('location')} END AS page
      FROM (SELECT c.*, has_page_info, coalesce(length(needle) >= 6 AND contains(hay, needle), false) AS verified,
              list_filter(list_transform(cpages, lambda p, i: CASE WHEN contains(p, needle) THEN CAST(i AS INTEGER) END),
                          lambda n: n IS NOT NULL) AS hits
            FROM (SELECT *, {canon('quote')} AS needle FROM {claims}) c LEFT JOIN corpus USING (doc_id))"""


PAGE_HITS = f"""
  SELECT f.*, t.page_index, instr(t.text, f.needle) AS first, t.text AS page_text, t.raw,
    instr(substr(t.text, instr(t.text, f.needle) + 1), f.needle) > 0 AS again
  FROM {{needles}} f JOIN page_texts t USING (doc_id)
  WHERE length(f.needle) >= 6 AND contains(t.text, f.needle)"""

CTES = {
    "lines": "SELECT doc_id, source, lang, text, string_split(text, chr(10)) AS ls FROM documents",
    "raw_pages": """SELECT *, list_transform(range(CAST(ceil(len(ls) / 5.0) AS BIGINT)),
        lambda i: array_to_string(ls[i * 5 + 1 : i * 5 + 5], chr(10))) AS rp FROM lines""",
    "raw_papers": """SELECT doc_id, source, lang, text,
        CASE WHEN doc_id % 41 = 5 THEN repeat(' ' || chr(12), 150) ELSE
          array_to_string(rp, chr(12)) || CASE WHEN doc_id % 3 = 0 THEN chr(12) ELSE '' END END AS raw_text,
        len(rp) - CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS total_pages FROM raw_pages""",
    "parts": f"""SELECT *, ps[1 : coalesce(list_max(list_filter(list_transform(ps,
          lambda p, i: CASE WHEN regexp_matches(p, '[^{WS}]') THEN i END), lambda i: i IS NOT NULL)), 1)] AS parts
        FROM (SELECT *, string_split(raw_text, chr(12)) AS ps FROM raw_papers)""",
    "papers": f"""SELECT *, CASE WHEN has_page_info THEN array_to_string(list_transform(texts,
            lambda p, i: '[PDF Page ' || i || ']' || chr(10) || p), chr(10) || chr(10)) ELSE texts[1] END AS full_text
        FROM (SELECT doc_id, source, len(parts) = total_pages AS has_page_info,
            CASE WHEN len(parts) = total_pages THEN list_transform(parts, lambda p: {norm('p')}) ELSE [{norm('raw_text')}] END AS texts
          FROM parts WHERE length(raw_text) > 200 AND regexp_matches(raw_text, '[^{WS}]'))""",
    "pages_flat": """SELECT doc_id, has_page_info, unnest(texts) AS text,
        CAST(generate_subscripts(texts, 1) - 1 AS INTEGER) AS page_index FROM papers""",
    "corpus": f"""SELECT *, CASE WHEN has_page_info THEN array_to_string(list_transform(cpages,
            lambda p, i: '[pdfpage' || i || ']' || p), '') ELSE cpages[1] END AS hay
        FROM (SELECT *, list_transform(texts, lambda p: {canon('p')}) AS cpages FROM papers)""",
    "sents": f"""SELECT doc_id, list_filter(list_transform(flatten(list_transform(ls, lambda l: regexp_extract_all(l, '{derived.SENTENCE}'))),
        lambda s: {trim("s")}), lambda s: s <> '') AS sents FROM lines""",
    "claims": _claims(""), "claims_typo": _claims("typo"), "claims_mixed": _claims("mixed"),
    "grounded_claims": _grounded("claims", "claim_no"),
    "sectioned": "SELECT doc_id, source, string_agg(line, chr(10) ORDER BY n, k) AS full_text FROM ("
                 "SELECT doc_id, source, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS n, 1 AS k FROM lines UNION ALL "
                 "SELECT doc_id, source, [" + ", ".join(lit(h) for h in derived.HEADINGS) + "][CAST(n // 4 AS BIGINT) % "
                 f"{len(derived.HEADINGS)} + 1], n, 0 FROM (SELECT doc_id, source, generate_subscripts(ls, 1) - 1 AS n FROM lines) WHERE n % 4 = 0"
                 ") GROUP BY doc_id, source",
    "heads": f"""SELECT doc_id, line_no, line, {_heading_case(lambda k, n: lit(k))} AS kind, {_heading_case(lambda k, n: str(n))} AS priority
        FROM (SELECT *, lower(regexp_replace(regexp_replace(t, {lit(v.HEADING_NUMBERING.format(ws=WS))}, ''), {lit(v.HEADING_TAIL)}, '')) AS title
          FROM (SELECT doc_id, line_no, line, {trim('line')} AS t FROM (SELECT doc_id, unnest(string_split(full_text, chr(10))) AS line,
            CAST(generate_subscripts(string_split(full_text, chr(10)), 1) - 1 AS INTEGER) AS line_no FROM sectioned)))""",
    "parts_of": f"""SELECT doc_id, sec, coalesce(max(kind), 'front') AS kind, CAST(coalesce(max(priority), 5) AS INTEGER) AS priority,
          string_agg(line, chr(10) ORDER BY line_no) || chr(10) AS text
        FROM (SELECT *, count(kind) OVER (PARTITION BY doc_id ORDER BY line_no) AS sec FROM heads) GROUP BY doc_id, sec""",
    "sections": f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS INTEGER) AS section_no, kind, priority, text
        FROM parts_of WHERE regexp_matches(text, '[^{WS}]') AND doc_id IN (SELECT doc_id FROM parts_of WHERE sec > 0 GROUP BY doc_id HAVING count(*) >= 2)""",
    "kept": """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section_no) - 1 AS INTEGER) AS part_no,
        priority, text, CAST(length(text) AS BIGINT) AS n FROM sections WHERE priority > 0""",
    "omits": """SELECT doc_id, string_agg(kind, ',' ORDER BY first) AS omitted FROM (
        SELECT doc_id, kind, min(section_no) AS first FROM sections WHERE priority = 0 GROUP BY doc_id, kind) GROUP BY doc_id""",
    "rounds": f"""SELECT doc_id, 0 AS r, CAST({LIMIT} AS BIGINT) AS remaining, list(priority ORDER BY part_no) AS ps,
          list(n ORDER BY part_no) AS ns, list(CAST(0 AS BIGINT) ORDER BY part_no) AS have FROM kept GROUP BY doc_id
        UNION ALL
        SELECT doc_id, r + 1, remaining - CAST(list_sum(list_transform(gives, lambda g: g)) AS BIGINT), ps, ns,
          list_transform(have, lambda h, i: h + gives[i])
        FROM (SELECT *, list_transform(have, lambda h, i: CASE WHEN ns[i] > h THEN least(CAST(remaining * ps[i] // w AS BIGINT), ns[i] - h)
                ELSE CAST(0 AS BIGINT) END) AS gives
              FROM (SELECT *, CAST(list_sum(list_transform(have, lambda h, i: CASE WHEN ns[i] > h THEN ps[i] ELSE 0 END)) AS BIGINT) AS w
                    FROM rounds) WHERE w > 0 AND remaining > 0)
        WHERE list_sum(gives) > 0""",
    "budgets": """SELECT doc_id, unnest(have) AS budget, CAST(generate_subscripts(have, 1) - 1 AS INTEGER) AS part_no
        FROM (SELECT doc_id, arg_max(have, r) AS have FROM rounds GROUP BY doc_id)""",
    "condensed_t": f"""SELECT s.doc_id, s.full_text, CASE WHEN length(full_text) <= {LIMIT} THEN full_text
          WHEN k.doc_id IS NULL THEN left(full_text, 900) || {lit(v.MIDDLE_MARKER)} || right(full_text, 600)
          WHEN total <= {LIMIT} THEN whole ELSE cut END AS text,
          length(full_text) > {LIMIT} AS truncated, length(full_text) > {LIMIT} AND (k.doc_id IS NULL OR total > {LIMIT}) AS partial,
          CASE WHEN length(full_text) > {LIMIT} THEN coalesce(omitted, '') ELSE '' END AS omitted
        FROM {{source}} s LEFT JOIN (SELECT doc_id, sum(n) AS total, string_agg(text, '' ORDER BY part_no) AS whole,
            string_agg(CASE WHEN budget >= n THEN text ELSE left(text, greatest(0, CAST(budget - {len(v.SECTION_MARKER)} AS INTEGER))) ||
              {lit(v.SECTION_MARKER)} END, '' ORDER BY part_no) AS cut
          FROM kept JOIN budgets USING (doc_id, part_no) GROUP BY doc_id) k USING (doc_id) LEFT JOIN omits USING (doc_id)""",
    "answer_rows": """
      SELECT doc_id, c AS category_ord, 0 AS kind, 0 AS k, q FROM (SELECT doc_id, qs, unnest([0, 1, 2, 3]) AS c FROM quote_lists), LATERAL (SELECT qs[c + 1] AS q)
      UNION ALL
      SELECT doc_id, c, 1, k, q FROM (SELECT doc_id, qs, c, unnest([c + 4, c, c + 8, c + 12]) AS x, unnest([0, 1, 2, 3]) AS k
          FROM (SELECT doc_id, qs, unnest([0, 1, 2, 3]) AS c FROM quote_lists)), LATERAL (SELECT qs[x + 1] AS q)
        WHERE q IS NOT NULL AND (qs[c + 1] IS NULL OR q.quote <> qs[c + 1].quote)
      UNION ALL
      SELECT doc_id, 4, 0, j, q FROM (SELECT doc_id, unnest(qs) AS q, generate_subscripts(qs, 1) - 1 AS j FROM quote_lists) WHERE j < 12""",
    "quote_lists": """SELECT d.doc_id, coalesce(qs, []) AS qs FROM documents d LEFT JOIN (
        SELECT doc_id, list({'quote': quote, 'location': location} ORDER BY claim_no % step, claim_no) AS qs
        FROM (SELECT *, greatest(1, (count(*) OVER (PARTITION BY doc_id) + 15) // 16) AS step FROM claims) GROUP BY doc_id) USING (doc_id)""",
    "findings_f": """SELECT doc_id, category, category_ord,
        CAST(row_number() OVER (PARTITION BY doc_id ORDER BY category_ord, kind, k) - 1 AS INTEGER) AS ord, kind = 0 AS is_primary,
        CASE WHEN category_ord = 4 THEN 'Point ' || (k + 1) END AS title,
        CASE WHEN category_ord = 4 THEN left(q.quote, 20) WHEN q IS NULL THEN ''
          WHEN kind = 1 THEN 'more ' || k || ': ' || left(q.quote, 30) ELSE category || ': ' || left(q.quote, 30) END AS summary,
        coalesce(q.location, '') AS location, coalesce(q.quote, '') AS quote
      FROM (SELECT *, ['research_question', 'method', 'results', 'limitations', 'highlight'][category_ord + 1] AS category,
              CASE WHEN kind = 1 THEN row_number() OVER (PARTITION BY doc_id, category_ord, kind ORDER BY k) ELSE 1 END AS rn FROM answer_rows)
      WHERE rn <= 2 AND doc_id % 6 <> 5""",
    "grounded_raw": _grounded("findings_f", "ord"),
    "grounded_f": """SELECT * REPLACE (CASE WHEN verified AND has_page_info AND page > 0 THEN 'PDF 第 ' || page || ' 页' ELSE location END AS location)
        FROM grounded_raw""",
    "page_texts": f"""SELECT doc_id, page_index, text AS raw, {canon('text')} AS text FROM pages_flat""",
    "hits_f": PAGE_HITS.format(needles="(SELECT * FROM grounded_f WHERE verified AND quote <> '')"),
    "placed_raw": """
      SELECT * FROM hits_f WHERE page > 0 AND page_index = page - 1
      UNION ALL
      SELECT * FROM hits_f h WHERE NOT EXISTS (SELECT 1 FROM hits_f g WHERE g.doc_id = h.doc_id AND g.ord = h.ord AND g.page > 0 AND g.page_index = g.page - 1)
        AND NOT again AND (SELECT count(*) FROM hits_f g WHERE g.doc_id = h.doc_id AND g.ord = h.ord) = 1""",
    "claim_hits": PAGE_HITS.format(needles=f"(SELECT doc_id, claim_no, {canon('quote')} AS needle FROM claims)"),
    "placed_claims": """SELECT * FROM claim_hits h WHERE NOT again AND
        (SELECT count(*) FROM claim_hits g WHERE g.doc_id = h.doc_id AND g.claim_no = h.claim_no) = 1""",
}


def _boxes(placed: str) -> str:
    """First and last character of the match on the 80-column grid, and one box per row of characters."""
    keeps = f"list_filter(list_transform(string_split(raw, ''), lambda c, i: CASE WHEN regexp_matches(c, '[{v.DROP_CLASS}]') THEN NULL ELSE i - 1 END), lambda i: i IS NOT NULL)"
    return f"""SELECT *, list_transform(range(a // 80, b // 80 + 1), lambda y: {{
          'x0': CASE WHEN y = a // 80 THEN (a % 80) * 6 ELSE 0 END, 'y0': 700 - y * 12,
          'x1': CASE WHEN y = b // 80 THEN (b % 80) * 6 + 6 ELSE 480 END, 'y1': 712 - y * 12}}) AS rects,
        lpad(CAST(page_index AS VARCHAR), 5, '0') || '|' || lpad(CAST(a AS VARCHAR), 6, '0') || '|' ||
          lpad(CAST(greatest(0, 792 - (712 - (a // 80) * 12)) AS VARCHAR), 5, '0') AS sort_index
      FROM (SELECT *, offs[first] AS a, offs[first + length(needle) - 1] AS b FROM (SELECT *, {keeps} AS offs FROM {placed}))"""


CTES["boxed_claims"] = _boxes("placed_claims")
CTES["placed"] = _boxes("placed_raw")
RECT_TEXT = "array_to_string(list_transform(rects, lambda r: r.x0 || ' ' || r.y0 || ' ' || r.x1 || ' ' || r.y1), ';')"
CTES["exports"] = f"""SELECT doc_id, ord, category, page_index AS page, rects, quote, summary,
    CASE WHEN category = 'highlight' THEN 'L3' ELSE 'L2' END AS layer FROM placed"""
CTES["marks"] = f"""SELECT doc_id, ord, 'highlight' AS type, {by_category(1)} AS color, sort_index, page_index, rects, quote AS text,
    {lit(CFG.mark_prefix)} || {by_category(4)} || ' ' || {by_category(2)} || '] ' || summary AS comment,
    CAST(page_index + 1 AS VARCHAR) AS page_label FROM placed"""
CTES["stored"] = f"""SELECT *, CASE WHEN page_index % 3 = 2 THEN 'mine' ELSE {lit(CFG.owner_tag)} END AS tags
    FROM (SELECT * REPLACE (comment || ' edited' AS comment) FROM marks WHERE ord % 2 = 0)"""
CTES["created_m"] = f"""SELECT m.* FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, text, color, page_index, rects ORDER BY ord) AS rn FROM marks) m
    WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.doc_id = m.doc_id AND s.text = m.text AND s.color = m.color
      AND s.page_index = m.page_index AND s.rects = m.rects AND s.tags = {lit(CFG.owner_tag)})"""
CTES["stats"] = """SELECT doc_id, coalesce(made, 0) AS created, coalesce(placed, 0) - coalesce(made, 0) AS existing,
      asked - coalesce(placed, 0) AS skipped, CAST(0 AS BIGINT) AS failed
    FROM (SELECT doc_id, count(*) AS asked FROM grounded_f WHERE quote <> '' GROUP BY doc_id)
      LEFT JOIN (SELECT doc_id, count(*) AS placed FROM placed GROUP BY doc_id) USING (doc_id)
      LEFT JOIN (SELECT doc_id, count(*) AS made FROM created_m GROUP BY doc_id) USING (doc_id)"""
ORACLES: dict[str, str] = {}


def sql(name: str, body: str, **ctes: str) -> None:
    """Register ``body`` with the common table expressions it names, in dependency order."""
    known = {**CTES, **ctes}
    ordered: list[str] = []

    def pull(text: str, skip: str = "") -> None:
        for word in re.findall(r"[a-z_]+", re.sub(r"'[^']*'", "", text)):
            if word in known and word != skip and word not in ordered:
                pull(known[word], word)
                if word not in ordered:
                    ordered.append(word)

    pull(body)
    with_ = ",\n".join(f"{n} AS ({known[n]})" for n in ordered)
    ORACLES[name] = (f"WITH RECURSIVE {with_}\n{body}" if ordered else body)


# --- text and pages ------------------------------------------------------------------------------------------

sql("normalise_text", "SELECT doc_id, " + norm(
    "replace(text, ' de ', ' ' || chr(9) || chr(7) || 'de' || chr(13) || chr(10) || chr(10) || chr(10) || chr(13) || ' ')")
    + " AS clean FROM documents")
_broken = r"regexp_replace(text, '(\p{L}{3})(\p{Ll}{2})', '\1- \2', 'g')"
sql("dehyphenated", rf"SELECT doc_id, regexp_replace({_broken}, '(\p{{L}})[-\x{{ad}}\x{{2010}}] (\p{{Ll}})', '\1\2', 'g') AS joined FROM documents")
sql("short_query", f"""SELECT doc_id, claim_no, CASE WHEN length(c) <= 60 THEN c
      WHEN regexp_matches(left(c, 60), ' ') AND length(regexp_replace(left(c, 60), ' [^ ]*\\z', '')) > 20
      THEN regexp_replace(left(c, 60), ' [^ ]*\\z', '') ELSE left(c, 60) END AS search
    FROM (SELECT *, {display('quote')} AS c FROM claims)""")
sql("location_page", f"SELECT doc_id, claim_no, {page_of('location')} AS page FROM claims")
sql("models_url", """SELECT endpoint, endpoint || '/models' AS models, CAST(NULL AS VARCHAR) AS none, count(*) AS requests
    FROM (SELECT 'https://host-' || (user_id % 50) || '.example/v1' AS endpoint FROM events) GROUP BY endpoint""")
sql("page_split", "SELECT doc_id, has_page_info, page_index, text FROM pages_flat")
sql("marked_full_text", "SELECT doc_id, CASE WHEN has_page_info THEN 'paged' ELSE 'fulltext' END AS method, full_text FROM papers")
sql("rejected_documents", "SELECT doc_id, 'no-text' AS reason FROM raw_papers WHERE length(raw_text) <= 200 OR NOT regexp_matches(raw_text, '[^" + WS + "]')")
sql("reader_pages_first", f"""
    SELECT doc_id, CASE WHEN r.full_text IS NOT NULL OR has_page_info THEN 'paged' ELSE 'fulltext' END AS method,
      r.full_text IS NULL AND has_page_info AS marked, CAST(coalesce(r.n, len(texts)) AS INTEGER) AS n_pages, coalesce(r.full_text, p.full_text) AS full_text
    FROM raw_papers LEFT JOIN papers p USING (doc_id) LEFT JOIN (
      SELECT * FROM (SELECT doc_id, len(string_split(raw_text, chr(12))) AS n,
        array_to_string(list_transform(string_split(raw_text, chr(12)), lambda p: {norm('p')}), chr(10)) AS full_text
        FROM raw_papers WHERE lang = 'en') WHERE length(full_text) > 200 AND regexp_matches(full_text, '[^{WS}]')) r USING (doc_id)
    WHERE r.full_text IS NOT NULL OR p.full_text IS NOT NULL""")
sql("metadata_text", """SELECT doc_id, 'TITLE: T' || doc_id || chr(10) || 'ABSTRACT: ' || coalesce(b.text, '') AS meta_text
    FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id // 3""")

# --- sections ------------------------------------------------------------------------------------------------

sql("heading_classes", "SELECT doc_id, line_no, kind, priority FROM heads WHERE kind IS NOT NULL")
sql("section_split", "SELECT * FROM sections")
sql("section_drop", "SELECT doc_id, string_agg(text, '' ORDER BY part_no) AS kept FROM kept GROUP BY doc_id")
sql("omitted_kinds", "SELECT doc_id, coalesce(omitted, '') AS omitted FROM (SELECT DISTINCT doc_id FROM sections) LEFT JOIN omits USING (doc_id)")
sql("budget_alloc", "SELECT doc_id, part_no, budget FROM budgets")
_cond = CTES["condensed_t"].format(source="sectioned")
sql("condensed", "SELECT doc_id, text, truncated, partial, omitted FROM condensed_t", condensed_t=_cond)
sql("head_tail", f"""SELECT doc_id, CASE WHEN length(text) <= {LIMIT} THEN text ELSE left(text, 900) || {lit(v.MIDDLE_MARKER)} || right(text, 600) END AS cut
    FROM documents""")
sql("highlight_range", """SELECT doc_id, CASE WHEN n < 25000 THEN 3 WHEN n < 60000 THEN 5 ELSE 7 END AS low,
    CASE WHEN n < 25000 THEN 5 WHEN n < 60000 THEN 8 ELSE 12 END AS high FROM (SELECT doc_id, length(text) * 10 AS n FROM documents)""")
_task = (
    "Read the paper below and report what it says as one JSON object.\nWrite in Simplified Chinese. Use only the text given; "
    "do not add outside knowledge.\nGive every entry a location (section and page) and a quote of one or two whole sentences "
    "copied character by character from the text. Lines such as [PDF Page 3] mark pages, are not part of the paper, and no "
    "quote may run across one.\nWhen the paper does not cover an entry, its summary is \"未在正文中找到\" with empty location and "
    "quote.\nEach of the four categories may carry up to 2 further pieces of evidence with other quotes.\nNumber of highlights "
    "(passages worth reading closely): 3-5.\nAnswer with JSON only, in this shape:\n" + ANSWER_SHAPE)
_closing = "\n\n---\nEnd of the text. Answer now with the JSON object only; copy quotes exactly."
sql("request_rows", f"""SELECT doc_id, 'https://models.example/v1/chat/completions' AS endpoint, 'default-model' AS model, 1 AS attempt, true AS json_mode,
    '{{"model":"default-model","messages":[{{"role":"user","content":' || CAST(to_json({lit(_task + chr(10) + chr(10) + 'Paper metadata:' + chr(10))}
      || 'TITLE: ' || s.source || chr(10) || 'ABSTRACT: ' || {lit(chr(10) + chr(10) + 'Paper text:' + chr(10))} || c.text || {lit(_closing)}) AS VARCHAR)
      || '}}],"temperature":0.2,"stream":true,"response_format":{{"type":"json_object"}}}}' AS body
    FROM condensed_t c JOIN sectioned s USING (doc_id)""", condensed_t=_cond)

# --- responses -----------------------------------------------------------------------------------------------

sql("parsed_answers", """SELECT d.doc_id AS request_id, CASE WHEN d.doc_id % 6 = 5 THEN 'parse' END AS error_kind,
    CASE WHEN d.doc_id % 6 <> 5 THEN coalesce(qs[2].quote, '') END AS method_quote FROM documents d JOIN quote_lists USING (doc_id)""")
_answer = "to_json({%s, 'highlights': list_transform(qs, lambda q, j: {'title': 'Point ' || j, 'description': left(q.quote, 20), 'location': q.location, 'quote': q.quote})})" % ", ".join(
    f"'{c}': {{'summary': CASE WHEN qs[{i + 1}] IS NULL THEN '' ELSE '{c}: ' || left(qs[{i + 1}].quote, 30) END, "
    f"'location': coalesce(qs[{i + 1}].location, ''), 'quote': coalesce(qs[{i + 1}].quote, ''), 'evidence': ["
    + ", ".join(f"{{'summary': CASE WHEN qs[{x + 1}] IS NULL THEN '' ELSE 'more {k}: ' || left(qs[{x + 1}].quote, 30) END, "
                f"'location': coalesce(qs[{x + 1}].location, ''), 'quote': coalesce(qs[{x + 1}].quote, '')}}"
                for k, x in enumerate((i + 4, i, i + 8, i + 12))) + "]}" for i, c in enumerate(v.CATEGORIES))
sql("assembled_answers", f"""SELECT doc_id AS request_id, CAST(NULL AS VARCHAR) AS error_kind,
    CASE doc_id % 6 WHEN 1 THEN '```json' || chr(10) || a || chr(10) || '```' WHEN 2 THEN 'Here it is:' || chr(10) || a || chr(10) || 'Done.'
      WHEN 3 THEN left(a, length(a) - 2) WHEN 5 THEN 'There is nothing to report.' ELSE a END AS content
    FROM (SELECT doc_id, CAST({_answer} AS VARCHAR) AS a FROM quote_lists)""")
_count = lambda c: f"CAST(count(*) FILTER (category = '{c}' AND NOT is_primary) AS INTEGER) AS {c}_evidence"
sql("normalised_results", "SELECT doc_id, " + ", ".join(
    f"max(quote) FILTER (category = '{c}' AND is_primary) AS {c}_quote, {_count(c)}" for c in v.CATEGORIES)
    + ", CAST(count(*) FILTER (category = 'highlight') AS INTEGER) AS highlights FROM findings_f GROUP BY doc_id")
sql("findings_flat", "SELECT * FROM findings_f")
_log = """SELECT event_id, user_id, 'https://host-' || (user_id % 50) || '.example/v1' AS endpoint, user_id % 2 = 0 AS json_mode, event_type,
    value, CASE event_type WHEN 'click' THEN 400 WHEN 'signup' THEN 401 WHEN 'error' THEN 503 WHEN 'purchase' THEN 400 ELSE 200 END AS status,
    CASE WHEN event_type = 'view' AND value > 60 THEN 'timeout' WHEN event_type <> 'view' THEN 'http'
      WHEN value < 5 THEN 'empty' WHEN value < 15 THEN 'http' END AS error_kind,
    CASE event_type WHEN 'click' THEN 'Unknown parameter: response_format' WHEN 'purchase' THEN 'upstream rejected request'
      WHEN 'error' THEN 'no available channel for this model' WHEN 'signup' THEN 'bad key' END AS detail,
    CASE event_type WHEN 'purchase' THEN 'content-review' WHEN 'error' THEN 'model-unavailable' WHEN 'signup' THEN 'bad-key' END AS hint FROM events"""
sql("response_triage", "SELECT status, error_kind, hint, detail, count(*) AS requests FROM inference GROUP BY ALL", inference=_log)
sql("retry_rows", """SELECT event_id AS request_id, endpoint, 'json-mode' AS reason, 2 AS attempt, false AS json_mode, false AS stricter
      FROM inference WHERE json_mode AND event_type = 'click' AND event_id % 5 = 0
    UNION ALL SELECT event_id, endpoint, 'unreadable', 3, false, true FROM inference
      WHERE json_mode AND event_type = 'click' AND event_id % 5 <> 0 AND event_id % 3 = 0 AND event_id % 4 <> 0
    UNION ALL SELECT event_id, endpoint, 'unreadable', 2, json_mode, true FROM inference WHERE error_kind IS NULL AND event_id % 3 = 0""", inference=_log)
sql("endpoints_without_json_mode", "SELECT DISTINCT endpoint FROM inference WHERE json_mode AND event_type = 'click' AND event_id % 5 <> 0", inference=_log)

# --- grounding -----------------------------------------------------------------------------------------------

sql("ground_exact", f"""SELECT item_id, sent_no, doc_id, CAST(instr(hay, needle) - 1 AS INTEGER) AS start FROM (
      SELECT item_id, sent_no, {canon('s')} AS needle FROM (SELECT item_id, unnest(ss) AS s, CAST(generate_subscripts(ss, 1) - 1 AS INTEGER) AS sent_no
        FROM (SELECT item_id, regexp_extract_all(text, '{derived.SENTENCE}') AS ss FROM benchmark))) q
    JOIN (SELECT doc_id, {canon('text')} AS hay FROM documents) d ON contains(hay, needle) WHERE length(needle) >= 6""")


def _own(claims: str) -> str:
    return f"(SELECT *, {canon('quote')} AS needle FROM {claims}) JOIN corpus USING (doc_id)"


sql("verify_own_doc", f"SELECT doc_id, claim_no, length(needle) >= 6 AND contains(hay, needle) AS verified FROM {_own('claims_mixed')}")
sql("ambiguous_quotes", f"""SELECT doc_id, claim_no, CASE WHEN length(needle) >= 6 THEN CAST(instr(hay, needle) - 1 AS INTEGER) ELSE -1 END AS start,
    length(needle) >= 6 AND instr(hay, needle) > 0 AND instr(substr(hay, instr(hay, needle) + 1), needle) > 0 AS repeated FROM {_own('claims')}""")
_at_page = "CASE WHEN verified AND has_page_info AND page > 0 THEN 'PDF 第 ' || page || ' 页' ELSE location END AS location"
sql("page_resolve", f"""SELECT doc_id, claim_no, quote, {_at_page}, verified, false AS corrected,
    CASE WHEN verified THEN CAST(1 AS DOUBLE) END AS similarity, page FROM grounded_claims""")
sql("fuzzy_match", f"""SELECT doc_id, claim_no, CASE WHEN fixed THEN {display('s')} ELSE quote END AS quote, {_at_page}, verified, fixed AS corrected,
      CASE WHEN fixed THEN CAST(1 AS DOUBLE) - CAST(1 AS DOUBLE) / length(typed) WHEN verified THEN CAST(1 AS DOUBLE) END AS similarity, page
    FROM (SELECT g.*, has_page_info IS NOT NULL AND NOT contains(hay, typed) AND length(typed) >= 20 AS fixed
          FROM (SELECT * REPLACE (t.quote AS quote), {canon('t.quote')} AS typed FROM grounded_original g JOIN (SELECT doc_id, claim_no, quote FROM claims_typo) t USING (doc_id, claim_no)) g
          LEFT JOIN (SELECT doc_id, hay FROM corpus) USING (doc_id))""",
    original="SELECT doc_id, claim_no, s, s AS quote, location FROM claims", grounded_original=_grounded("original", "claim_no"))
_votes = f"""SELECT doc_id, claim_no, bucket, count(*) AS votes, min(i * 100000000 + p) AS first FROM (
      SELECT *, CAST(floor((p - i) / 16.0 + 0.5) AS BIGINT) AS bucket FROM (
        SELECT g.doc_id, claim_no, i, p, row_number() OVER (PARTITION BY g.doc_id, claim_no, i ORDER BY p) AS hit
        FROM (SELECT doc_id, claim_no, i, substr(needle, i + 1, 8) AS gram FROM (SELECT doc_id, claim_no, needle, unnest(range(0, length(needle) - 7, 4)) AS i
              FROM {_own('claims_mixed')} WHERE length(needle) >= 20 AND NOT contains(hay, needle))) g
        JOIN (SELECT doc_id, p, substr(hay, p + 1, 8) AS gram FROM (SELECT doc_id, hay, unnest(range(0, length(hay) - 7)) AS p FROM corpus)) h
          ON g.doc_id = h.doc_id AND g.gram = h.gram) WHERE hit <= 50) GROUP BY ALL"""
sql("seed_votes", "SELECT doc_id, claim_no, bucket, votes FROM seed", seed=_votes)
sql("seed_top", "SELECT * FROM (SELECT doc_id, claim_no, CAST(row_number() OVER (PARTITION BY doc_id, claim_no ORDER BY votes DESC, first) AS INTEGER) AS rank, bucket, votes FROM seed) WHERE rank <= 5", seed=_votes)
ORACLES["seed_top5"] = ORACLES.pop("seed_top")

# --- locating and export -------------------------------------------------------------------------------------

sql("page_char_text", f"""SELECT doc_id, page_index, text, CAST(length(text) AS INTEGER) AS n_offsets,
    CAST(list_max(list_transform(string_split(raw, ''), lambda c, i: CASE WHEN regexp_matches(c, '[{v.DROP_CLASS}]') THEN NULL ELSE i - 1 END)) AS INTEGER) AS last_char
    FROM page_texts""")
sql("merged_rects", """SELECT doc_id, claim_no, page_index, sort_index, false AS fuzzy, false AS partial, CAST(n - 1 AS INTEGER) AS rect_no,
      CAST(r.x0 AS DOUBLE) AS x0, CAST(r.y0 AS DOUBLE) AS y0, CAST(r.x1 AS DOUBLE) AS x1, CAST(r.y1 AS DOUBLE) AS y1
    FROM (SELECT *, unnest(rects) AS r, generate_subscripts(rects, 1) AS n FROM boxed_claims)""")
sql("export_rows", f"SELECT * REPLACE ({RECT_TEXT} AS rects) FROM exports")
sql("export_counts", """SELECT doc_id, coalesce(placed, 0) AS annotated, asked - coalesce(placed, 0) AS skipped
    FROM (SELECT doc_id, count(*) AS asked FROM grounded_f WHERE quote <> '' GROUP BY doc_id)
      LEFT JOIN (SELECT doc_id, count(*) AS placed FROM placed GROUP BY doc_id) USING (doc_id)""")
sql("export_rejects", """SELECT doc_id, ord, CASE doc_id % 10 WHEN 1 THEN 'coordinate' WHEN 2 THEN 'rectangle' WHEN 3 THEN 'no-rects'
    WHEN 4 THEN 'page' WHEN 5 THEN 'page' ELSE 'category' END AS reason FROM exports WHERE doc_id % 10 BETWEEN 1 AND 7""")
sql("empty_exports", "SELECT doc_id, 'nothing-located' AS reason FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM exports)")
_ext = lambda f, c: f"{f}(list_transform(rects, lambda r: r.{c}))"
sql("markup_records", f"""SELECT doc_id, ord, page, CASE WHEN layer = 'L3' THEN 'Underline' ELSE 'Highlight' END AS subtype,
    CASE WHEN layer = 'L3' THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END AS opacity,
    {lit(CFG.mark_prefix)} || {by_category(5)} || '] AI 分析：' || summary || chr(10) || '原文：' || quote AS contents,
    {_ext('list_min', 'x0')} || ' ' || {_ext('list_min', 'y0')} || ' ' || {_ext('list_max', 'x1')} || ' ' || {_ext('list_max', 'y1')} AS rect,
    array_to_string(list_transform(rects, lambda r: concat_ws(' ', r.x0, r.y1, r.x1, r.y1, r.x0, r.y0, r.x1, r.y0)), ' ') AS quads,
    CAST(CASE category {' '.join(f"WHEN {lit(r[0])} THEN {r[6][0]}" for r in v.CATEGORY_TABLE)} END AS DOUBLE) AS red FROM exports""")
_groups = """SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_ord) AS INTEGER) AS group_ord FROM (
    SELECT doc_id, category, min(ord) AS first_ord, arg_min(page, ord) AS first_page FROM exports GROUP BY doc_id, category)"""
sql("bookmarks", f"""SELECT doc_id, 0 AS level, 0 AS group_ord, -1 AS ord, 'Reading guide' AS title, first_page AS page, CAST(NULL AS DOUBLE) AS top FROM groups_e WHERE group_ord = 1
    UNION ALL SELECT doc_id, 1, group_ord, -1, {by_category(5)}, first_page, NULL FROM groups_e
    UNION ALL SELECT doc_id, 2, group_ord, ord, left(coalesce(nullif(summary, ''), quote), 80), page, CAST({_ext('list_max', 'y1')} + 12 AS DOUBLE)
      FROM exports JOIN groups_e USING (doc_id, category)""", groups_e=_groups)
sql("layer_counts", "SELECT doc_id, layer, count(*) AS annotations FROM exports GROUP BY ALL")

# --- annotations ---------------------------------------------------------------------------------------------

sql("new_annotations", f"""SELECT doc_id, type, color, sort_index, page_index, {RECT_TEXT} AS rects, text, comment, page_label,
    {lit(CFG.owner_tag)} AS tags FROM created_m""")
sql("kept_after_clear", "SELECT doc_id, color, sort_index, comment, tags FROM stored WHERE tags = 'mine'")
sql("cleared_counts", "SELECT doc_id, count(*) FILTER (tags <> 'mine') AS removed FROM stored GROUP BY doc_id")
sql("annotation_stats", "SELECT * FROM stats")
sql("guide_notes", f"""SELECT doc_id, 'note' AS type, '#ffd400' AS color, '00000|000000|00000' AS sort_index, 0 AS page_index, '20 20 42 42' AS rects,
    'guide ' || source AS comment, '1' AS page_label, {lit(CFG.owner_tag)} AS tags FROM documents WHERE lang <> 'en'""")

# --- selection and store -------------------------------------------------------------------------------------

_att = """SELECT doc_id + 1000000000 AS attachment_id, doc_id // 3 AS parent_id, doc_id AS ord, doc_id % 4 <> 0 AS pdf, doc_id % 5 = 0 AS deleted,
    doc_id % 7 = 0 AS exported FROM documents"""
_first = "SELECT parent_id, arg_min(attachment_id, ord) AS attachment_id FROM att WHERE pdf AND NOT deleted AND NOT exported GROUP BY parent_id"
_pick = """SELECT attachment_id AS item_id, attachment_id FROM att WHERE pdf AND NOT exported
    UNION ALL SELECT a.attachment_id, f.attachment_id FROM att a JOIN firsts f USING (parent_id) WHERE a.exported
    UNION ALL SELECT parent_id, attachment_id FROM firsts"""
sql("source_pick", "SELECT * FROM pick", att=_att, firsts=_first, pick=_pick)
sql("items_with_source", "SELECT item_id FROM pick", att=_att, firsts=_first, pick=_pick)
sql("unique_selection", """SELECT target AS target_id, min(ord) AS ord, arg_max(item, ord) AS selected_id FROM (
    SELECT doc_id AS ord, doc_id + 1000000000 AS item, CASE WHEN doc_id % 4 <> 3 THEN doc_id // 3 ELSE doc_id + 1000000000 END AS target FROM documents) GROUP BY target""")
sql("pending_documents", """SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'v3:K' || doc_id || ':' || n_chars || ':' || doc_id * 1000 ELSE 'v3:K' || doc_id || ':v7' END
    || ':default-model:zh:p4' AS cache_key FROM documents WHERE doc_id % 2 = 1""")
sql("cached_results", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'r' || doc_id END AS result FROM documents")
_store = "SELECT CAST(user_id AS VARCHAR) AS cache_key, event_type AS title, 'm' AS model, ts AS created_at, props AS result FROM events"
sql("cache_upsert", f"""SELECT cache_key, title, model, created_at, result FROM (SELECT *, row_number() OVER (PARTITION BY cache_key
    ORDER BY title = 'purchase' DESC, created_at DESC) AS rn FROM ({_store})) WHERE rn = 1""")
sql("cache_evict", f"""SELECT cache_key, title, model, created_at, result FROM (SELECT *, row_number() OVER (PARTITION BY cache_key
    ORDER BY created_at DESC) AS rn FROM ({_store})) WHERE rn = 1 ORDER BY created_at DESC, cache_key DESC LIMIT {v.STORE_CAPACITY}""")

# --- reports -------------------------------------------------------------------------------------------------

_paged = "页码由逐页比对原文得出，比对不唯一处请搜索确认"
_unpaged = "没有分页文本，页码来自模型且未核对，请搜索原文确认"
_names = "replace(replace(replace(replace(omitted, 'references', '参考文献'), 'acknowledgements', '致谢'), 'appendix', '附录'), ',', '、')"
sql("coverage_note", f"""SELECT doc_id, CASE WHEN partial THEN 'partial' ELSE 'full' END AS coverage, concat_ws('；',
      CASE WHEN omitted <> '' THEN '未发送' || {_names} END, CASE WHEN partial THEN '全文超出长度，若干章节仅送出开头，结论请自行核实' END,
      CASE WHEN doc_id % 3 > 0 THEN (doc_id % 3) || ' 处引文与原文略有出入，已改用原文' END,
      CASE WHEN doc_id % 2 = 0 THEN '{_paged}' ELSE '{_unpaged}' END) AS note FROM condensed_t""", condensed_t=_cond)
CTES["reported"] = f"""SELECT g.*, 'Paper <' || doc_id || '> &  more' AS paper, 'model-' || (doc_id % 4) AS model,
    strftime(make_timestamp((1700000000 + doc_id) * 1000000), '%Y-%m-%d %H:%M:%S') AS made,
    concat_ws('；', CASE WHEN long THEN '全文超出长度，若干章节仅送出开头，结论请自行核实' END,
      CASE WHEN p.has_page_info THEN '{_paged}' ELSE '{_unpaged}' END) AS note
    FROM (SELECT * EXCLUDE (has_page_info) FROM grounded_f) g JOIN (SELECT doc_id, has_page_info, length(full_text) > {LIMIT} AS long FROM papers) p USING (doc_id)"""
_flag = "CASE WHEN verified THEN '' ELSE ' ⚠️未校验' END"
_loc = filled("location", "未标注")
_long = {r[0]: r[3] for r in v.CATEGORY_TABLE}
_block = f"""'**' || {by_category(3)} || '**：' || max(summary || {_flag}) FILTER (is_primary) || chr(10) || '   - 位置：' || max({_loc}) FILTER (is_primary)
    || chr(10) || '   - 原文：' || max(CASE WHEN quote <> '' THEN '“' || quote || '”' ELSE '无' END) FILTER (is_primary)
    || coalesce(string_agg(chr(10) || '   - 补充：' || summary || {_flag} || '（' || {_loc} || '）“' || quote || '”', '' ORDER BY ord) FILTER (NOT is_primary), '')"""
sql("markdown_report", f"""SELECT doc_id, '# ' || paper || chr(10) || chr(10) || '*生成于 ' || made || ' · 模型 ' || model || '*' || chr(10) || chr(10) || blocks
      || '## 建议重点关注' || chr(10) || chr(10) || coalesce(hl || chr(10), '') || chr(10) || '> 说明：' || note || chr(10) || chr(10) || '---' || chr(10)
      || '## 我的理解与疑问' || chr(10) || '- ' || chr(10) || '- ' AS markdown
    FROM (SELECT doc_id, paper, made, model, note, string_agg(block || chr(10) || chr(10), '' ORDER BY category_ord) AS blocks FROM (
        SELECT doc_id, paper, made, model, note, category_ord, {_block} AS block FROM reported WHERE category <> 'highlight'
        GROUP BY doc_id, paper, made, model, note, category, category_ord) GROUP BY doc_id, paper, made, model, note)
    LEFT JOIN (SELECT doc_id, string_agg(n || '. **' || title || '**' || {_flag} || '  ' || chr(10) || '   ' || summary || '  ' || chr(10) || '   位置：' || {_loc}
        || '  ' || chr(10) || '   原文：“' || quote || '”', chr(10) ORDER BY ord) AS hl FROM (
          SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM reported WHERE category = 'highlight') GROUP BY doc_id) USING (doc_id)""")
_src = f"""'<p class="src">📍 ' || {esc("CASE WHEN page > 0 THEN '第 ' || page || ' 页' ELSE " + filled('location', '未标注页码') + " END")} || ' ｜ 原文：'
    || CASE WHEN quote <> '' THEN '“' || {esc('left(quote, 120)')} || '”' ELSE '无原文片段' END || {_flag} || '</p>'"""
_chip = f"""'<b class="chip" style="border-color:' || {by_category(1)} || '">' || {by_category(2)} || '</b>'"""
_legend = "".join(f'<span style="color:{r[1]}">■</span> {r[2]} ' for r in v.CATEGORY_TABLE)
sql("html_guide", f"""SELECT doc_id, '<h1>📄 ' || {esc('paper')} || ' · 导读</h1><p>生成于 ' || made || ' · 模型 ' || model || '</p><p>颜色图例：' || {lit(_legend)}
      || '</p><h2>🗺️ 思维导图</h2>' || CASE WHEN doc_id % 2 = 0 THEN '<p>已生成并保存为本条目附件。</p><p><a href="item?a&amp;' || doc_id || '">Map</a></p>' ELSE '<p>尚未生成。</p>' END
      || '<h2>📖 文章脉络大纲</h2>' || coalesce(outline, '<p><em>未能提取大纲。</em></p>') || '<h2>📌 建议重点关注</h2>' || coalesce(hl, '<p><em>无</em></p>')
      || '<blockquote>说明：' || note || '</blockquote><hr/><h2>✍️ 我的理解与疑问</h2><p>&nbsp;</p>' AS html
    FROM (SELECT DISTINCT doc_id, paper, made, model, note FROM reported)
    LEFT JOIN (SELECT doc_id, string_agg('<section><h3>' || n || '. ' || chip || ' ' || label || '</h3><p>' || body || '</section>', '' ORDER BY n) AS outline FROM (
        SELECT doc_id, {_chip} AS chip, {by_category(3)} AS label, row_number() OVER (PARTITION BY doc_id ORDER BY category_ord) AS n,
          max({esc('summary')} || '</p>' || {_src}) FILTER (is_primary) || coalesce(string_agg('<div class="more">补充：' || {esc('summary')} || {_src} || '</div>', '' ORDER BY ord) FILTER (NOT is_primary), '') AS body
        FROM reported WHERE category <> 'highlight' GROUP BY doc_id, category, category_ord HAVING max(summary) FILTER (is_primary) <> '') GROUP BY doc_id) USING (doc_id)
    LEFT JOIN (SELECT doc_id, string_agg('<section><h3>' || n || '. ' || {_chip} || ' ' || {esc('title')} || '</h3><p>' || {esc('summary')} || '</p>' || {_src} || '</section>', '' ORDER BY ord) AS hl
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM reported WHERE category = 'highlight') GROUP BY doc_id) USING (doc_id)""")
sql("reading_index", f"""SELECT doc_id, category, category_ord, ord, coalesce(nullif(title, ''), nullif(summary, ''), {by_category(2)}) AS title,
      CASE WHEN page > 0 THEN 'p.' || page ELSE '' END AS page_label, left(quote, 160) AS jump_quote
    FROM reported r WHERE category = 'highlight' OR EXISTS (SELECT 1 FROM reported p WHERE p.doc_id = r.doc_id AND p.category = r.category AND p.is_primary AND p.summary <> '')""")
_leaves = f"""SELECT doc_id, category, {collapse("CASE WHEN category = 'highlight' THEN title || CASE WHEN summary <> '' THEN '：' || summary ELSE '' END ELSE summary END")} AS label,
    dense_rank() OVER (PARTITION BY doc_id ORDER BY category_ord) - 1 AS g, row_number() OVER (PARTITION BY doc_id, category ORDER BY ord) - 1 AS k
    FROM reported WHERE is_primary AND (category = 'highlight' OR summary <> '')"""
sql("outline_nodes", f"""
    SELECT DISTINCT doc_id, '0' AS node_id, CAST(NULL AS VARCHAR) AS parent_id, 0 AS depth, 0 AS ord, {collapse('paper')} AS label, '{v.ROOT_COLOR}' AS color FROM reported
    UNION ALL SELECT DISTINCT doc_id, '0.' || g, '0', 1, CAST(g AS INTEGER), {by_category(2)}, {by_category(1)} FROM leaves_r
    UNION ALL SELECT doc_id, '0.' || g || '.' || k, '0.' || g, 2, CAST(k AS INTEGER), label, {by_category(1)} FROM leaves_r
    UNION ALL SELECT DISTINCT doc_id, '0.0', '0', 1, 0, '{v.EMPTY_LABEL}', '{v.EMPTY_COLOR}' FROM reported WHERE doc_id NOT IN (SELECT doc_id FROM leaves_r)""", leaves_r=_leaves)
sql("unverified_counts", "SELECT doc_id, CAST(count(*) FILTER (NOT verified) AS INTEGER) AS unverified FROM grounded_f GROUP BY doc_id")
sql("guide_text", f"""SELECT doc_id, '已定位 ' || (created + existing) || ' 条，未能定位 ' || skipped || ' 条，写入失败 ' || failed
      || ' 条。未能定位的内容不作标注。' || chr(10) || '以上内容由模型写成，并非作者原话，请对照高亮处阅读。' || chr(10) || '范围：scope' || chr(10)
      || coalesce(body, '') AS guide FROM stats LEFT JOIN (SELECT doc_id, string_agg(chr(10) || CASE category WHEN 'research_question' THEN '研究问题' WHEN 'method' THEN '方法'
        WHEN 'results' THEN '结果' ELSE '作者局限' END || CASE WHEN verified THEN '' ELSE '（引文未核实）' END || '：' || summary, '' ORDER BY ord) AS body
      FROM grounded_f WHERE is_primary AND category <> 'highlight' AND summary <> '' GROUP BY doc_id) USING (doc_id)""")
sql("run_summary", "SELECT event_id % 20 AS run_id, coalesce(detail, error_kind, 'saved') AS outcome, count(*) AS items FROM inference GROUP BY ALL", inference=_log)
sql("run_failures", "SELECT event_id % 20 AS run_id, 'item ' || event_id || '：' || coalesce(detail, error_kind) AS line FROM inference WHERE error_kind IS NOT NULL", inference=_log)
sql("grounding_rate", """SELECT model, doc_id, CAST(count(*) FILTER (verified) AS BIGINT) AS verified, count(*) AS total, CAST(GROUPING(model, doc_id) AS INTEGER) AS level
    FROM (SELECT *, 'model-' || (doc_id % 4) AS model FROM grounded_f WHERE quote <> '') GROUP BY ROLLUP (model, doc_id)""")

# --- streaming -----------------------------------------------------------------------------------------------

sql("stream_annotations", "SELECT doc_id, color, sort_index, text, comment FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, text, color, page_index, rects ORDER BY ord) AS rn FROM marks) WHERE rn = 1")
sql("stream_grounding", f"""SELECT doc_id, claim_no, quote, {_at_page}, verified, false AS corrected,
    CASE WHEN verified THEN CAST(1 AS DOUBLE) END AS similarity, page FROM grounded_claims""")
sql("streamed_answers", """SELECT conv_id AS request_id,
      CASE WHEN conv_id % 3 = 0 AND NOT lost AND content <> '' THEN content END AS content,
      CASE WHEN lost OR conv_id % 3 = 2 THEN 'timeout' WHEN conv_id % 3 = 1 THEN 'http' WHEN content = '' THEN 'empty' END AS error_kind,
      CASE WHEN conv_id % 3 = 1 THEN 'overloaded' END AS detail
    FROM (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS content,
      (conv_id % 15 = 0 AND max(turn) >= 1) OR (conv_id % 21 = 0 AND max(turn) >= 5) AS lost FROM conversations GROUP BY conv_id)
    WHERE (NOT lost AND conv_id % 3 < 2) OR conv_id < (SELECT max(conv_id) FROM conversations)""")
sql("stream_requests", f"""SELECT doc_id, 'default-model' AS model, true AS json_mode, CAST(length(body) AS INTEGER) AS body_chars, md5(body) AS body_md5
    FROM (SELECT doc_id, '{{"model":"default-model","messages":[{{"role":"user","content":'
      || CAST(to_json({lit(_task + chr(10) + chr(10) + 'Paper metadata:' + chr(10))} || {lit(chr(10) + chr(10) + 'Paper text:' + chr(10))}
        || CASE WHEN length(text) <= {LIMIT} THEN text ELSE left(text, 900) || {lit(v.MIDDLE_MARKER)} || right(text, 600) END || {lit(_closing)}) AS VARCHAR)
      || '}}],"temperature":0.2,"stream":true,"response_format":{{"type":"json_object"}}}}' AS body
    FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))""")

# --- written and read back -----------------------------------------------------------------------------------

_key = """CASE WHEN doc_id % 3 <> 0 THEN 'v3:K' || doc_id || ':' || n_chars || ':' || doc_id * 1000 ELSE 'v3:K' || doc_id || ':v7' END || ':default-model:zh:p4'"""
sql("forced_documents", f"SELECT doc_id, {_key} AS cache_key FROM documents")
sql("stored_results", f"""SELECT {_key} AS cache_key, any_value(paper) AS title, any_value(model) AS model, make_timestamp((1700000000 + doc_id) * 1000000) AS created_at,
    CAST(count(*) AS INTEGER) AS findings, CAST(count(*) FILTER (verified) AS INTEGER) AS verified FROM reported JOIN documents USING (doc_id) GROUP BY doc_id, n_chars""")
sql("written_notes", """SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN doc_id // 3 END AS parent_id,
    '<p>' || replace(replace(replace(replace(coalesce(source, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</p>' AS html FROM documents""")
for _copy, _of in (("written_annotations", "new_annotations"), ("read_responses", "assembled_answers"), ("reader_page_rows", "reader_pages_first")):
    ORACLES[_copy] = ORACLES[_of]
ORACLES["written_requests"] = f"SELECT doc_id, endpoint, body FROM ({ORACLES['request_rows']})"
