"""DuckDB SQL for the registered queries, built from shared common tables.

The expected dates and counters are taken from ``events`` and never parsed, and
the patterns are written for another regular-expression engine, so the SQL is an
independent account of the same results.
"""

from __future__ import annotations

# White space, tags, entities, elements and tracking names of the records' rules.
WS = r"[\t\n\v\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
TAG = r"</?[a-zA-Z][^>]*>"
ENTITY = r"&(?:#x?[0-9a-fA-F]+|[a-zA-Z]+);"
CODE = "|".join(rf"<{e}\b[^>]*>[\s\S]*?</{e}{WS}*>" for e in ("script", "style", "noscript", "template"))
BLOCK = (
    r"</?(?:p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|section|article|header|footer"
    r"|blockquote|figure|figcaption|hr)\b[^>]*>"
)
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "''", "nbsp": " ", "ndash": "–", "mdash": "—",
    "hellip": "…", "rsquo": "’", "lsquo": "‘", "ldquo": "“", "rdquo": "”",
}
TRACKING = (
    "'utm_source','utm_medium','utm_campaign','utm_term','utm_content','utm_id','fbclid','gclid','dclid',"
    "'msclkid','igshid','mc_cid','mc_eid','ref','ref_src','source','spm'"
)


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'), ' ')"


def looks_html(x: str) -> str:
    return f"(regexp_matches({x}, '{TAG}') OR regexp_matches({x}, '{ENTITY}'))"


def drop_code(x: str) -> str:
    return f"regexp_replace({x}, '{CODE}', ' ', 'gi')"


def bare(x: str) -> str:
    spaced = f"regexp_replace({drop_code(x)}, '{BLOCK}', ' ', 'gi')"
    return f"regexp_replace(regexp_replace({spaced}, '<!--[\\s\\S]*?-->', ' ', 'g'), '{TAG}', '', 'g')"


def decode(x: str) -> str:
    """Named and numeric entities, cut apart and put together once."""
    names = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in ENTITIES.items()) + "}"
    token = (
        f"CASE WHEN regexp_matches(t, '^&[a-zA-Z]') THEN coalesce({names}[lower(t[2:-2])], t)"
        " WHEN t LIKE '&#x%' THEN coalesce(chr(try_cast('0x' || t[4:-2] AS INTEGER)), t)"
        " WHEN regexp_matches(t, '^&#[0-9]') THEN coalesce(chr(try_cast(regexp_extract(t, '[0-9]+') AS INTEGER)), t) ELSE t END"
    )
    pieces, tokens = f"string_split_regex({x}, '{ENTITY}')", f"regexp_extract_all({x}, '{ENTITY}')"
    return (
        f"array_to_string(list_transform(list_zip({pieces}, list_transform({tokens}, lambda t: {token})),"
        " lambda p: p[1] || coalesce(p[2], '')), '')"
    )


def clean(x: str) -> str:
    return f"nullif(CASE WHEN {looks_html(x)} THEN {collapse(decode(bare(x)))} ELSE {collapse(x)} END, '')"


def fold(x: str) -> str:
    stripped = f"regexp_replace(regexp_replace({collapse(x)}, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://', ''), '^www\\.', '', 'i')"
    return (
        f"list_transform([{stripped}], lambda s: regexp_replace(lower(CASE WHEN"
        " regexp_matches(s, '^[a-z0-9-]+(\\.[a-z0-9-]+)+(/.*)?$', 'i') THEN split_part(split_part(s, '/', 1), '.', 1)"
        " ELSE s END), '[^a-z0-9]', '', 'g'))[1]"
    )


def form(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')"


LINK = f"""
    lower(regexp_extract(url_in, '^(https?)://', 1)) || '://' ||
    regexp_replace(lower(regexp_extract(url_in, '://([^/?#]+)', 1)), '^www\\.', '') ||
    coalesce(nullif(regexp_replace(regexp_extract(url_in, '://[^/?#]+([^?#]*)', 1), '/$', ''), ''), '/') ||
    coalesce('?' || nullif(array_to_string(list_sort(list_filter(
        string_split(regexp_extract(url_in, '\\?([^#]*)', 1), '&'),
        lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN ({TRACKING}))), '&'), ''), '')
"""

SHAPE_DATE = """CASE
    WHEN k % 13 IN (1, 2, 9, 10) THEN date_trunc('second', ts)
    WHEN k % 13 IN (3, 12) THEN date_trunc('millisecond', ts)
    WHEN k % 13 IN (4, 5, 6, 8) THEN CAST(date_trunc('day', ts) AS TIMESTAMP)
    WHEN k % 13 = 7 THEN date_trunc('minute', ts) END"""
SHAPE_COUNT = """CASE WHEN k % 8 IN (0, 1, 2, 3, 7) THEN n WHEN k % 8 = 4 THEN n * 100
    WHEN k % 8 = 5 AND n * 100000 <= 2147483647 THEN n * 100000 END"""
COUNT_TEXT = """CASE k % 8 WHEN 0 THEN n::VARCHAR WHEN 1 THEN format('{:,}', n) WHEN 2 THEN replace(format('{:,}', n), ',', '.')
    WHEN 3 THEN replace(format('{:,}', n), ',', ' ') WHEN 4 THEN (n // 10) || '.' || (n % 10) || 'K'
    WHEN 5 THEN (n // 10) || ',' || (n % 10) || ' jt' WHEN 6 THEN 'about ' || n END"""

FEED = f"""
ev AS (SELECT event_id, ts, event_type, CAST(floor(value * 100) AS BIGINT) AS n FROM events),
doc AS (
    SELECT doc_id * 3 AS ordinal, doc_id AS k, doc_id % 47 = 13 AS not_object, doc_id % 43 = 11 AS bad, lang,
        CASE WHEN doc_id % 37 = 5 THEN '' WHEN doc_id % 3 = 1 THEN '  ' || upper(source) || ' '
             WHEN doc_id % 3 = 2 THEN 'www.' || source || '.com' ELSE source END AS source_in,
        CASE WHEN doc_id % 41 <> 7 THEN text END AS content_in, ts, event_type, n
    FROM documents LEFT JOIN ev ON event_id = (doc_id * 7919) % (SELECT count(*) FROM events)),
page AS (
    SELECT page_id * 6 + copy * 3 + 1 AS ordinal, page_id AS k, regexp_extract(url, '://([^/?#]+)', 1) AS source_in,
        regexp_extract(html, '<title>([^<]*)</title>', 1) AS title_in, html AS content_in,
        CASE WHEN copy = 0 THEN url ELSE regexp_extract(url, '^[^#]*') || (CASE WHEN contains(url, '?') THEN '&' ELSE '?' END)
             || 'utm_campaign=repost&FBCLID=' || page_id || regexp_extract(url, '(#.*)?$') END AS url_in,
        copy, ts, event_type, n
    FROM pages LEFT JOIN ev ON event_id = (page_id * 7919) % (SELECT count(*) FROM events), (VALUES (0), (1)) c(copy)),
conv AS (
    SELECT (conv_id * 1000000 + turn) * 3 + 2 AS ordinal, conv_id AS k, turn, role AS source_in, text AS content_in, ts, n
    FROM conversations LEFT JOIN ev ON event_id = (conv_id * 7919) % (SELECT count(*) FROM events)),
feed AS (
    SELECT ordinal, not_object, bad,
        CASE WHEN NOT not_object THEN nullif(source_in, '') END AS source_in, NULL::VARCHAR AS title_in,
        CASE WHEN NOT not_object THEN content_in END AS content_in, NULL::VARCHAR AS url_in, NULL::VARCHAR AS author_in,
        CASE WHEN NOT not_object THEN {SHAPE_DATE} END AS published_at,
        CASE WHEN NOT not_object AND k % 13 = 11 THEN 'some time after ' || event_type END AS published_at_raw,
        CASE WHEN NOT not_object THEN {SHAPE_COUNT} END::INTEGER AS engagement
    FROM doc
    UNION ALL
    SELECT ordinal, false, false, source_in, nullif(title_in, ''), content_in, url_in, NULL,
        {SHAPE_DATE}, CASE WHEN k % 13 = 11 THEN 'some time after ' || event_type END, ({SHAPE_COUNT})::INTEGER
    FROM page
    UNION ALL
    SELECT ordinal, false, false, source_in, NULL, content_in, NULL, '<b>Speaker</b> &amp; ' || k,
        CASE WHEN turn % 2 = 0 THEN date_trunc('second', ts) END, NULL, turn::INTEGER
    FROM conv)"""

NORM = f"""{FEED},
cleaned AS (
    SELECT ordinal, not_object, bad, {clean('source_in')} AS spelling, {clean('title_in')} AS title,
        {clean('content_in')} AS content, {clean('author_in')} AS author, url_in AS url_raw, {LINK} AS url,
        published_at, published_at_raw, engagement
    FROM feed),
sourced AS (SELECT *, nullif({fold('spelling')}, '') AS source FROM cleaned),
norm AS (
    SELECT ordinal, source, CASE WHEN source IS NOT NULL THEN spelling END AS source_raw, title, content, url, url_raw,
        published_at, published_at_raw, author, engagement,
        CASE WHEN not_object THEN 'Record must be a JSON object' WHEN bad THEN 'description: Invalid input'
             WHEN source IS NULL THEN 'source is required and must contain at least one alphanumeric character'
             WHEN title IS NULL AND content IS NULL THEN 'record must contain a title or content' END AS reason,
        CASE WHEN url IS NULL THEN 'content' ELSE 'url' END AS strategy,
        upper(sha256(CASE WHEN url IS NULL THEN concat_ws(chr(31), 'v1', 'content', source, {form('title')}, substring({form('content')}, 1, 500))
             ELSE concat_ws(chr(31), 'v1', 'url', regexp_replace(url, '^https?://', '')) END)) AS fp
    FROM sourced)"""

STORED = f"""{NORM},
ranked AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY ordinal) AS rn FROM norm WHERE reason IS NULL),
stored AS (SELECT ordinal + 1 AS id, TIMESTAMP '2024-06-01' AS created_at, * EXCLUDE (rn, reason) FROM ranked WHERE rn = 1)"""

LISTING = f"""id, source, source_raw, title, content, url, {iso('published_at')} AS published_at, author, engagement,
    {iso('created_at')} AS created_at"""
ORDER = "ORDER BY s.published_at DESC NULLS LAST, s.id DESC"

DATE_TXT = "CASE k % 13 WHEN 10 THEN epoch(date_trunc('second', ts))::BIGINT::VARCHAR WHEN 11 THEN 'some time after ' || event_type ELSE 'a date' END"


def _fact(table: str, key: str, type_: str, txt: str, where: str = "true", state: str = "NULL") -> str:
    return f"SELECT '{key}' AS key, {type_} AS type, {txt} AS txt, {state} AS state FROM {table} WHERE {where}"


def _text(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN 'null' ELSE 'string' END"


_OBJ = "NOT not_object"
FACTS = FEED + ",\nfacts AS (\n" + "\nUNION ALL ".join([
    _fact("doc", "source", "'string'", "source_in", _OBJ),
    _fact("doc", "text", _text("content_in"), "content_in", _OBJ),
    _fact("doc", "description", "CASE WHEN bad THEN 'object' ELSE 'null' END", "NULL", _OBJ),
    _fact("doc", "published_at", "CASE WHEN k % 13 IN (0, 12) THEN 'null' ELSE 'string' END", f"CASE WHEN k % 13 NOT IN (0, 12) THEN {DATE_TXT} END", _OBJ,
          "CASE WHEN k % 13 IN (0, 12) THEN 'missing' WHEN k % 13 = 11 THEN 'unparsable' ELSE 'parsed' END"),
    _fact("doc", "created_at", "CASE WHEN k % 13 = 12 THEN 'number' ELSE 'null' END", "NULL", _OBJ,
          "CASE WHEN k % 13 = 12 THEN 'parsed' ELSE 'missing' END"),
    _fact("doc", "engagement", "CASE WHEN k % 8 = 7 THEN 'null' ELSE 'string' END", COUNT_TEXT, _OBJ),
    _fact("doc", "views", "CASE WHEN k % 8 = 7 THEN 'number' ELSE 'null' END", "NULL", _OBJ),
    _fact("doc", "lang", _text("lang"), "lang", _OBJ),
    "SELECT NULL, 'array', NULL, NULL FROM doc WHERE not_object",
    _fact("page", "publisher", "'string'", "source_in"),
    _fact("page", "headline", "'string'", "title_in"),
    _fact("page", "body", "'string'", "content_in"),
    _fact("page", "link", "'string'", "url_in"),
    _fact("page", "publishedAt", "'string'", DATE_TXT, "k % 13 NOT IN (0, 12)", "CASE WHEN k % 13 = 11 THEN 'unparsable' ELSE 'parsed' END"),
    _fact("page", "date", "'number'", "NULL", "k % 13 = 12", "'parsed'"),
    _fact("page", "reach", "'string'", COUNT_TEXT, "k % 8 <> 7"),
    _fact("page", "engagement_count", "'number'", "NULL", "k % 8 = 7"),
    _fact("page", "page_id", "'number'", "NULL"),
    _fact("conv", "source_name", "'string'", "source_in"),
    _fact("conv", "content", "'string'", "content_in"),
    _fact("conv", "published_date", "'number'", "NULL", "turn % 2 = 0", "'parsed'"),
    _fact("conv", "author_name", "'string'", "'<b>Speaker</b> &amp; ' || k"),
    _fact("conv", "views", "'number'", "NULL"),
]) + "),\nspellings AS (SELECT txt AS spelling, count(*) AS count FROM facts WHERE key IN ('source', 'publisher', 'source_name') GROUP BY 1)," + f"""
folded AS (SELECT {fold(clean('spelling'))} AS source, spelling, count FROM spellings)"""

EVENT_DATES = "d AS (SELECT event_id, ts + to_days((event_id % 1461)::INTEGER) AS t FROM events)"


def _dates(cases: str) -> str:
    return f"WITH {EVENT_DATES} SELECT event_id, {iso(cases)} AS at FROM d"


def _stored(select: str) -> str:
    return f"WITH {STORED}{select if select.startswith(',') else ' ' + select}"


def _norm(select: str) -> str:
    return f"WITH {NORM} {select}"


def _facts(select: str) -> str:
    return f"WITH {FACTS} {select}"


_FOUND = f"SELECT id, source, {iso('published_at')} AS published_at FROM stored WHERE "
_WORD = "(contains(lower(coalesce(title, '')), 'the') OR contains(lower(coalesce(content, '')), 'the'))"
_FROM, _TO = "published_at >= TIMESTAMP '2024-01-05'", "published_at < TIMESTAMP '2024-01-21'"
_BY_SOURCE = "SELECT source AS \"group\", min(source_raw) AS label, count(*) AS count FROM stored"
_DAY = "strftime(published_at, '%Y-%m-%d')"
_BY_DAY = f"SELECT {_DAY} AS \"group\", count(*) AS count FROM stored WHERE published_at IS NOT NULL GROUP BY 1"
_EXPORT = f"""to_json({{'id': id, 'source': source, 'source_raw': source_raw, 'title': title, 'content': content, 'url': url,
    'published_at': {iso('published_at')}, 'author': author, 'engagement': engagement, 'created_at': {iso('created_at')}}})::VARCHAR"""
_MESSY_TAIL = "'&#38;amp; &#x41;&#0066;&Hellip;&#xZ; &#12ab &#65ab; &nbsp'"
_BASE_LINK = """split_part(url, '://', 1) || '://' || regexp_replace(regexp_extract(url, '://([^/?#]+)', 1), '^www\\.', '') ||
    coalesce(nullif(regexp_replace(regexp_extract(url, '://[^/?#]+([^?#]*)', 1), '/$', ''), ''), '/')"""
_MESSY_LINK = """upper(split_part(url, '://', 1)) || '://' || upper(regexp_extract(url, '://([^/?#]+)', 1)) ||
    (CASE WHEN url LIKE 'https:%' THEN ':443' ELSE ':080' END) || '/x/..' || regexp_extract(url, '://[^/?#]+([^?#]*)', 1) ||
    '?z=' || page_id || '&a=é%20b~&GCLID=1&&a=2&flag&ref=9#part'"""


def oracle_sql() -> dict[str, str]:
    return {
        "json_lines_batch": f"""WITH {FEED}, names AS (
            SELECT ordinal, CASE WHEN NOT not_object THEN source_in END AS name FROM doc
            UNION ALL SELECT ordinal, source_in FROM page UNION ALL SELECT ordinal, source_in FROM conv)
            SELECT row_number() OVER (ORDER BY ordinal) - 1 AS ordinal, CASE WHEN ordinal % 53 = 1 THEN 'text is not valid JSON' END AS malformed,
                CASE WHEN ordinal % 53 <> 1 THEN name END AS name FROM names""",
        "json_document_batch": """SELECT page_id, r::BIGINT AS row, NULL::VARCHAR AS malformed,
            CASE r WHEN 0 THEN url ELSE page_id::VARCHAR END AS link FROM pages, (VALUES (0), (1)) c(r) WHERE page_id % 11 NOT IN (3, 5)
            UNION ALL SELECT page_id, 0, CASE page_id % 11 WHEN 3 THEN 'text is not valid JSON'
                ELSE 'document is neither an array nor an object with a mentions array' END, NULL FROM pages WHERE page_id % 11 IN (3, 5)""",
        "large_array_documents": """SELECT NULL::VARCHAR AS malformed, page_id::BIGINT AS page_id, url AS link FROM pages""",
        "whole_file_documents": """SELECT NULL::VARCHAR AS malformed, url AS link FROM pages WHERE page_id // 100 % 2 = 0
            UNION ALL SELECT 'text is not valid JSON', NULL FROM pages WHERE page_id // 100 % 2 = 1 GROUP BY page_id // 100""",
        "stored_mentions": _stored(f"SELECT {LISTING} FROM stored"),
        "surrogate_keys": _stored(f"SELECT id, fp AS fingerprint, {iso('created_at')} AS created_at, 'feed' AS batch_id FROM stored"),
        "idempotent_append": _stored("SELECT id, fp AS fingerprint FROM stored"),
        "constraint_check": _stored(""", changed AS (
            SELECT CASE ordinal % 100 WHEN 1 THEN substring(fp, 1, 62) WHEN 5 THEN NULL ELSE fp END AS fp,
                CASE ordinal % 100 WHEN 2 THEN '  ' WHEN 6 THEN NULL ELSE source END AS source,
                CASE WHEN ordinal % 100 = 3 THEN -1 ELSE engagement END AS engagement,
                CASE WHEN ordinal % 100 <> 4 THEN id END AS id, CASE WHEN ordinal % 100 <> 7 THEN source_raw END AS source_raw,
                CASE WHEN ordinal % 100 <> 8 THEN 1 END AS raw, CASE WHEN ordinal % 100 <> 9 THEN created_at END AS created_at
            FROM stored UNION ALL SELECT fp, source, engagement, id, source_raw, 1, created_at FROM stored WHERE ordinal % 100 = 10)
            SELECT rule, violations FROM (
            SELECT count(*) FILTER (length(fp) <> 64) AS fingerprint_length, count(*) FILTER (trim(source) = '') AS source_not_blank,
                count(*) FILTER (engagement < 0) AS engagement_natural, count(*) FILTER (id IS NULL) AS id_not_null,
                count(*) FILTER (fp IS NULL) AS fingerprint_not_null, count(*) FILTER (source IS NULL) AS source_not_null,
                count(*) FILTER (source_raw IS NULL) AS source_raw_not_null, count(*) FILTER (raw IS NULL) AS raw_not_null,
                count(*) FILTER (created_at IS NULL) AS created_at_not_null, count(fp) - count(DISTINCT fp) AS fingerprint_unique
            FROM changed) UNPIVOT (violations FOR rule IN (fingerprint_length, source_not_blank, engagement_natural, id_not_null,
                fingerprint_not_null, source_not_null, source_raw_not_null, raw_not_null, created_at_not_null, fingerprint_unique))"""),
        "raw_retention": _stored("""SELECT id, lang, CASE WHEN url IS NOT NULL THEN page_id::VARCHAR END AS page_id, html AS body FROM stored
            LEFT JOIN (SELECT ordinal AS d, lang FROM doc) ON d = ordinal
            LEFT JOIN (SELECT ordinal AS p, k AS page_id, content_in AS html FROM page) ON p = ordinal"""),
        "rejected_records": _norm("SELECT ordinal, reason FROM norm WHERE reason IS NOT NULL"),
        "first_rejects": _norm("SELECT ordinal AS index, reason FROM norm WHERE reason IS NOT NULL ORDER BY ordinal LIMIT 50"),
        "exported_rows": _stored(f"SELECT id, {_EXPORT} AS json FROM stored"),
        "normalized_mentions": _norm(f"""SELECT ordinal, reason, CASE WHEN reason IS NULL THEN strategy END AS fingerprint_strategy,
            CASE WHEN reason IS NULL THEN fp END AS fingerprint, source, source_raw, title, content, url, url_raw,
            {iso('published_at')} AS published_at, published_at_raw, author, engagement FROM norm"""),
        "coerced_inputs": f"""WITH {FEED},
            texts AS (SELECT ordinal AS o, CASE WHEN k % 8 = 7 THEN n::VARCHAR ELSE {COUNT_TEXT} END AS engagement_text,
                    CASE WHEN k % 8 = 7 THEN n END AS engagement_number, CASE WHEN k % 13 = 12 THEN epoch_ms(date_trunc('millisecond', ts)) END AS published_number
                FROM (SELECT ordinal, k, n, ts FROM doc WHERE NOT not_object UNION ALL SELECT ordinal, k, n, ts FROM page)
                UNION ALL SELECT ordinal, turn::VARCHAR, turn, CASE WHEN turn % 2 = 0 THEN epoch(date_trunc('second', ts))::BIGINT END FROM conv)
            SELECT ordinal, CASE WHEN not_object THEN 'Record must be a JSON object' WHEN bad THEN 'description: Invalid input' END AS type_reason,
                source_in AS in_source, title_in AS in_title, content_in AS in_content, url_in AS in_url, author_in AS in_author,
                engagement_text AS in_engagement, engagement_number, published_number
            FROM feed LEFT JOIN texts ON o = ordinal""",
        "reject_reasons": _norm("SELECT reason, count(*) AS count FROM norm GROUP BY 1"),
        "accept_reject_split": _norm("SELECT count(*) AS records, count(reason) AS rejected FROM norm"),
        "collapsed_whitespace": f"SELECT doc_id, {collapse('text')} AS collapsed FROM documents",
        "html_detection": f"""SELECT 'page' AS kind, page_id AS k, {looks_html('html')} AS html FROM pages
            UNION ALL SELECT 'document', doc_id, {looks_html('text')} FROM documents""",
        "content_elements": f"SELECT page_id, {drop_code('html')} AS rest FROM pages",
        "cleaned_pages": f"SELECT page_id, {clean('html')} AS body FROM pages",
        "decoded_entities": f"SELECT page_id, {decode('messy')} AS decoded FROM (SELECT page_id, html || {_MESSY_TAIL} AS messy FROM pages)",
        "folded_sources": f"""SELECT doc_id, form::INTEGER AS form, {fold('spelling')} AS key FROM (
            SELECT doc_id, f AS form, CASE f WHEN 0 THEN source WHEN 1 THEN 'HTTPS://www.' || source || '.co.id/a b'
                WHEN 2 THEN ' The\t' || upper(source) || ' ' ELSE 'WWW.' || source || '-x.net' END AS spelling
            FROM documents, (VALUES (0), (1), (2), (3)) c(f))""",
        "canonical_links": f"""SELECT page_id, 0::INTEGER AS form, {LINK.replace('url_in', 'url')} AS url, url AS url_raw FROM pages
            UNION ALL SELECT page_id, 1, {_BASE_LINK} || '?a=%C3%A9+b%7E&a=2&flag=&z=' || page_id, {_MESSY_LINK} FROM pages
            UNION ALL SELECT page_id, form, 'http://' || host || '/' || page_id, 'http://' || written || '/' || page_id
            FROM pages, (VALUES (2, '127.0.0.1', '0x0000000000000007f.0.0.1'), (3, '[::1]', '[0:0:0:0:0:0:0:1]'),
                (4, 'straße.de', 'Straße.de')) h(form, host, written)""",
        "epoch_dates": _dates("CASE WHEN event_id % 3 = 0 THEN date_trunc('second', t) ELSE date_trunc('millisecond', t) END"),
        "iso_dates": _dates("""CASE event_id % 6 WHEN 0 THEN date_trunc('second', t) WHEN 1 THEN date_trunc('second', t)
            WHEN 2 THEN date_trunc('millisecond', t) WHEN 3 THEN date_trunc('minute', t) WHEN 4 THEN date_trunc('day', t)::TIMESTAMP END"""),
        "numeric_dates": _dates("""CASE WHEN event_id % 4 IN (0, 1) THEN date_trunc('day', t)::TIMESTAMP
            WHEN event_id % 4 = 2 AND day(t) > 12 THEN date_trunc('day', t)::TIMESTAMP
            WHEN event_id % 4 = 2 THEN make_timestamp(year(t), day(t), month(t), 0, 0, 0) END"""),
        "named_month_dates": _dates("""CASE event_id % 4 WHEN 0 THEN date_trunc('second', t) WHEN 1 THEN date_trunc('minute', t)
            WHEN 2 THEN date_trunc('day', t)::TIMESTAMP END"""),
        "local_zone_dates": _dates("date_trunc('second', t) - to_hours(7 + (event_id % 3)::INTEGER)"),
        "mail_dates": _dates("""date_trunc('second', t) + to_hours(CASE event_id % 4 WHEN 1 THEN -7 WHEN 3 THEN 5 ELSE 0 END)"""),
        "utc_days": f"WITH {EVENT_DATES} SELECT strftime(t, '%Y-%m-%d') AS day, count(*) AS count FROM d GROUP BY 1",
        "parsed_counts": f"""SELECT event_id, form::INTEGER AS form, (CASE WHEN form = 8 THEN 1000 ELSE {SHAPE_COUNT.replace('k % 8', 'form')} END)::INTEGER AS count
            FROM (SELECT event_id, CAST(floor(value * 100) AS BIGINT) AS n FROM events), range(9) r(form)""",
        "schemeless_links": "SELECT page_id, regexp_replace(url, '^https?://', '') AS link FROM pages",
        "comparison_forms": f"SELECT doc_id, {form('text')} AS form FROM documents",
        "mention_fingerprints": _norm("""SELECT ordinal, CASE WHEN reason IS NULL THEN fp END AS fingerprint,
            CASE WHEN reason IS NULL THEN strategy END AS fingerprint_strategy FROM norm"""),
        "first_wins_batch": _stored("SELECT ordinal, source, url FROM stored"),
        "canonical_view": _stored("SELECT id, 'feed' AS batch_id FROM stored"),
        "not_stored": _stored("""SELECT fp AS fingerprint, min(ordinal) AS ordinal FROM norm WHERE reason IS NULL
            AND fp NOT IN (SELECT fp FROM stored WHERE published_at IS NOT NULL) GROUP BY fp"""),
        "already_stored": _stored("SELECT fp AS fingerprint FROM stored WHERE published_at IS NOT NULL"),
        "within_batch_duplicates": _norm("SELECT count(*) - count(DISTINCT fp) AS within_batch FROM norm WHERE reason IS NULL"),
        "ingestion_report": _stored("""SELECT received, accepted, received - accepted AS rejected, inserted, accepted - inserted AS duplicates,
            accepted - inserted AS within_batch, 0::BIGINT AS already_stored, least(received - accepted, 50) AS errors_listed
            FROM (SELECT count(*) AS received, count(*) FILTER (reason IS NULL) AS accepted FROM norm), (SELECT count(*) AS inserted FROM stored)"""),
        "incremental_ingest": _norm("SELECT DISTINCT fp AS fingerprint, source FROM norm WHERE reason IS NULL"),
        "search_text": _stored(_FOUND + _WORD),
        "search_wildcards": _stored(_FOUND + "(contains(coalesce(title, ''), '%') OR contains(coalesce(content, ''), '%'))"),
        "search_source": _stored(_FOUND + "source = 'src3'"),
        "search_from": _stored(_FOUND + _FROM),
        "search_to": _stored(_FOUND + _TO),
        "search_combined": _stored(_FOUND + f"{_WORD} AND source = 'src3' AND {_FROM} AND {_TO}"),
        "undated_mentions": _stored("SELECT id FROM stored WHERE published_at IS NULL"),
        "dated_mentions": _stored("SELECT id FROM stored WHERE published_at IS NOT NULL"),
        "filtered_total": _stored(f"SELECT count(*) AS total FROM stored WHERE {_WORD} AND {_TO}"),
        "first_page": _stored(f"SELECT {LISTING} FROM stored s {ORDER} LIMIT 20"),
        "later_page": _stored(f"SELECT {LISTING} FROM stored s {ORDER} LIMIT 100 OFFSET 300"),
        "paged_search": _stored(f"SELECT {LISTING} FROM stored s WHERE {_WORD} AND {_FROM} AND {_TO} {ORDER} LIMIT 25 OFFSET 50"),
        "pagination": _stored(f"""SELECT 3::INTEGER AS page, 25::INTEGER AS page_size, total, ceil(total / 25)::BIGINT AS total_pages,
            3 < ceil(total / 25) AS has_next, total > 0 AS has_previous FROM (SELECT count(*) AS total FROM stored WHERE {_WORD} AND {_FROM} AND {_TO})"""),
        "next_page": _stored(f"SELECT {LISTING} FROM stored s {ORDER} LIMIT 25 OFFSET 25"),
        "count_by_source": _stored(_BY_SOURCE + " GROUP BY source"),
        "count_by_day": _stored(_BY_DAY),
        "missing_dates": _stored("SELECT count(*) AS missing_published_at FROM stored WHERE published_at IS NULL"),
        "filtered_source_counts": _stored(f"{_BY_SOURCE} WHERE {_WORD} GROUP BY source"),
        "recent_days": _stored(f"SELECT * FROM ({_BY_DAY}) ORDER BY \"group\" DESC LIMIT 14"),
        "key_figures": _stored(f"""SELECT count(*) AS total, count(*) FILTER ({_WORD} AND {_FROM}) AS matching,
            count(DISTINCT source) AS sources, count(*) FILTER (published_at IS NULL) AS undated FROM stored"""),
        "share_of_maximum": _stored(f"""SELECT *, floor(count / (max(count) OVER ()) * 100 + 0.5)::INTEGER AS share FROM ({_BY_SOURCE} GROUP BY source)"""),
        "undated_worklist": _stored("SELECT id, published_at_raw FROM stored WHERE published_at_raw IS NOT NULL"),
        "refingerprinted": _stored("SELECT id, fp AS fingerprint FROM stored").replace("'v1'", "'v2'"),
        "field_frequency": _facts("SELECT key, count(*) AS count FROM facts WHERE key IS NOT NULL GROUP BY 1"),
        "value_types": _facts("SELECT coalesce(key, 'non-object') || ': ' || type AS key, count(*) AS count FROM facts GROUP BY 1"),
        "date_fields": _facts("SELECT key, count(*) AS count FROM facts WHERE state IS NOT NULL GROUP BY 1"),
        "unparsable_dates": _facts("SELECT '\"' || txt || '\"' AS key, count(*) AS count FROM facts WHERE state = 'unparsable' GROUP BY 1"),
        "value_flags": _facts(f"""SELECT count(*) FILTER (state = 'missing') AS missing_dates, count(*) FILTER ({looks_html('txt')}) AS html_values,
            count(*) FILTER (regexp_matches(txt, '^\\s*[0-9][0-9,]*\\s*$')) AS numeric_texts FROM facts"""),
        "source_folding": _facts("SELECT source, spelling, count FROM folded WHERE source <> ''"),
        "fingerprint_groups": _norm("""SELECT count(*) AS distinct_fingerprints, count(*) FILTER (n > 1) AS repeated_groups,
            sum(n - 1)::BIGINT AS rows_collapsed FROM (SELECT count(*) AS n FROM norm WHERE reason IS NULL GROUP BY fp)"""),
        "strategy_counts": _norm("SELECT strategy, count(*) AS count FROM norm WHERE reason IS NULL GROUP BY 1"),
        "record_totals": _norm("SELECT count(*) AS records, count(reason) AS rejected FROM norm"),
        "top_report": _facts("SELECT spelling AS key, count FROM folded WHERE source <> '' ORDER BY count DESC, key LIMIT 40"),
        "rows_beyond_report": _facts("SELECT greatest(count(*) - 40, 0) AS more FROM folded WHERE source <> ''"),
    }
