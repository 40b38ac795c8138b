"""DuckDB SQL for the registered queries.

Built from small text helpers that each return an SQL expression.  RE2 knows
neither look-ahead nor back-references; where a pattern uses them the SQL says
the same in another way.
"""

from __future__ import annotations

from pagescan import catalog
from pagescan.operators.detect import default_rules
from pagescan.operators.links import tag_patterns
from registry.inputs import DANGER, FORMS, OPTIONS, SEEDS, SUFFIXES

ORACLES: dict[str, str] = {}

SCHEME = "[A-Za-z][A-Za-z0-9+.-]*"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lists(texts) -> str:
    return "[" + ", ".join(q(t) for t in texts) + "]"


def rx(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({x}, {q(pattern)}, {group})"


def rx_all(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, {q(pattern)}, {group})"


def rx_is(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def rx_sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def any_text(x: str, words) -> str:
    return "(" + (" OR ".join(f"contains({x}, {q(w)})" for w in words) or "false") + ")"


# URL parts


def scheme(u: str) -> str:
    return f"lower({rx(u, f'^({SCHEME}):', 1)})"


def netloc(u: str) -> str:
    return rx(u, f"^(?:{SCHEME}:)?//([^/?#]*)", 1)


def full_path(u: str) -> str:
    return rx(u, f"^(?:{SCHEME}:)?(?://[^/?#]*)?([^?#]*)", 1)


def path(u: str) -> str:
    return f"regexp_replace({full_path(u)}, ';[^/]*$', '')"


def query_of(u: str) -> str:
    return rx(u, r"^[^?#]*\?([^#]*)", 1)


def fragment(u: str) -> str:
    return rx(u, r"(?s)^[^#]*#(.*)$", 1)


def host(u: str) -> str:
    return f"rtrim({rx_sub(rx_sub(netloc(u), '^.*@'), ':.*$')}, '.')"


def domain(u: str) -> str:
    """Registered domain: three labels after a two-label suffix, else two."""
    parts = f"string_split({host(u)}, '.')"
    two = lists(s for s in SUFFIXES if "." in s)
    one = lists(s for s in SUFFIXES if "." not in s)
    return f"""(CASE
        WHEN {rx_is(host(u), r'^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$')} THEN {host(u)} || '.'
        WHEN list_contains({two}, lower(array_to_string({parts}[-2:], '.')))
          THEN array_to_string({parts}[-3:], '.')
        WHEN list_contains({one}, lower({parts}[-1])) THEN array_to_string({parts}[-2:], '.')
        ELSE {parts}[-1] || '.' END)"""


def valid(u: str) -> str:
    t = rx_sub(u, r"^\s+|\s+$")
    n = netloc(t)
    port = f"string_split({n}, ':')[2]"
    return f"""({scheme(t)} IN ('http', 'https', 'ftp', 'sftp', 'ws', 'wss')
        AND len(string_split({n}, '.')) >= 2 AND length(string_split({n}, '.')[-1]) >= 2
        AND CASE WHEN len(string_split({n}, ':')) = 2
              THEN {rx_is(port, '^[0-9]+$')} AND coalesce(try_cast({port} AS BIGINT), 0) BETWEEN 1 AND 65535
              ELSE true END
        AND length({t}) <= 2048)"""


def link_type(u: str) -> str:
    name = f"string_split(string_split({u}, '?')[1], '/')[-1]"
    return f"(CASE WHEN contains({name}, '.') THEN upper(string_split({name}, '.')[-1]) ELSE {q(catalog.API_LINK)} END)"


def clean(raw: str) -> str:
    return f"""(CASE WHEN {rx_is(raw, '^(?:javascript:|data:|mailto:|tel:)')} THEN NULL
        ELSE nullif({rx(raw, catalog.ALLOWED_PREFIX)}, '') END)"""


def ready(c: str, base_scheme: str) -> str:
    return f"replace(CASE WHEN starts_with({c}, '//') THEN {base_scheme} || ':' || {c} ELSE {c} END, '\\', '')"


def resolve(url: str, rel: str) -> str:
    origin = f"({scheme(url)} || '://' || {netloc(url)})"
    p = path(url)
    head = rx(p, "^(.*/)", 1)
    directory = f"(CASE WHEN ends_with({p}, '/') THEN {p} WHEN {rx_is(head, '^/*$')} THEN {head} ELSE rtrim({head}, '/') END)"
    above = f"(CASE WHEN ends_with({p}, '/') THEN {p} ELSE regexp_replace({p}, '/?[^/]*$', '') END)"
    steps = f"string_split({rel}, '/')"
    ups = f"len(list_filter({steps}, lambda s: s = '..'))"
    names = f"list_filter({steps}, lambda s: s NOT IN ('..', '.', ''))"
    dirs = f"list_filter(string_split({above}, '/'), lambda s: s <> '')"
    kept = f"list_slice({dirs}, 1, greatest(len({dirs}) - {ups}, 0))"
    climb = f"{origin} || '/' || array_to_string(list_concat({kept}, {names}), '/')"
    # general join
    rp, rq, rf, rs, rn = full_path(rel), query_of(rel), fragment(rel), scheme(rel), netloc(rel)
    own = f"({rs} NOT IN ('', {scheme(url)}) OR {rn} <> '')"
    base_dirs = f"string_split({p}, '/')"
    base_dirs = f"(CASE WHEN {base_dirs}[-1] = '' THEN {base_dirs} ELSE list_slice({base_dirs}, 1, len({base_dirs}) - 1) END)"
    segs = f"list_concat({base_dirs}, string_split({rp}, '/'))"
    tidy = (
        f"list_concat(list_concat(list_slice({segs}, 1, 1), "
        f"list_filter(list_slice({segs}, 2, len({segs}) - 1), lambda s: s <> '')), list_slice({segs}, len({segs}), len({segs})))"
    )
    walked = f"""list_reduce(list_transform({tidy}, lambda s: [s]), lambda a, b:
        CASE WHEN b[1] = '..' THEN list_slice(a, 1, len(a) - 1) WHEN b[1] = '.' THEN a ELSE list_concat(a, b) END,
        CAST([] AS VARCHAR[]))"""
    last = f"string_split({rp}, '/')[-1]"
    merged = f"array_to_string(CASE WHEN {last} IN ('.', '..') THEN list_concat({walked}, ['']) ELSE {walked} END, '/')"
    merged = f"(CASE WHEN {merged} = '' THEN '/' ELSE {merged} END)"
    joined_path = f"(CASE WHEN {own} THEN {rp} WHEN {rp} = '' THEN regexp_replace({full_path(url)}, ';$', '') ELSE {merged} END)"
    joined_path = rx_sub(joined_path, "/{2,}", "/")
    place = f"(CASE WHEN {own} THEN {rn} ELSE {netloc(url)} END)"
    rooted = f"(CASE WHEN {place} <> '' AND {joined_path} <> '' AND NOT starts_with({joined_path}, '/') THEN '/' ELSE '' END || {joined_path})"
    asked = f"(CASE WHEN NOT {own} AND {rp} = '' AND {rq} = '' THEN {query_of(url)} ELSE {rq} END)"
    marked = f"(CASE WHEN {rel} = '' THEN {fragment(url)} ELSE {rf} END)"
    general = f"""(CASE WHEN {rs} <> '' THEN {rs} ELSE {scheme(url)} END || ':'
        || CASE WHEN {place} <> '' THEN '//' || {place} ELSE '' END || {rooted}
        || CASE WHEN {asked} <> '' THEN '?' || {asked} ELSE '' END
        || CASE WHEN {marked} <> '' THEN '#' || {marked} ELSE '' END)"""
    return f"""(CASE
        WHEN starts_with({rel}, '//') THEN {scheme(url)} || ':' || {rel}
        WHEN starts_with({rel}, '#/') THEN {origin} || {p} || {rel}
        WHEN starts_with({rel}, '/') THEN {origin} || '/' || ltrim({rel}, '/')
        WHEN starts_with({rel}, './') THEN {origin} || {directory} || '/' || ltrim(substr({rel}, 3), '/')
        WHEN starts_with({rel}, '../') THEN {climb}
        WHEN starts_with({rel}, 'http://') OR starts_with({rel}, 'https://') THEN {rel}
        ELSE {general} END)"""


def has_extension(u: str, extensions=OPTIONS.extensions) -> str:
    return "(" + " OR ".join(f"ends_with(lower({path(u)}), {q(e)})" for e in extensions) + ")"


def dangerous(u: str, keywords=DANGER) -> str:
    return f"(NOT ends_with({u}, '.js') AND {any_text(f'lower({u})', keywords)})"


def danger_types(u: str, fold: bool = True) -> str:
    text = f"lower({u})" if fold else u
    hits = f"list_filter({lists(DANGER)}, lambda k: contains({text}, k))"
    return f"""(CASE WHEN ends_with({u}, '.js') OR len({hits}) = 0 THEN {q(catalog.UNKNOWN)}
        ELSE array_to_string({hits}, ', ') END)"""


# Derived inputs


def forms() -> str:
    text = f"replace({q(FORMS)}, '{{id}}', page_id::VARCHAR)"
    text = f"replace({text}, '{{hex}}', substr(md5(url), 1, 8))"
    return f"replace({text}, '{{xeh}}', substr(md5(url), 9, 8))"


RICH = f"rich AS (SELECT page_id, url, html || {forms()} AS html FROM pages)"
LINKED = """linked AS (
    SELECT p.page_id, p.url, p.html || array_to_string(list_sort(list_distinct(
        ['<a href="' || a.url || '">n</a>', '<a href="' || b.url || '">n</a>'])), '') AS html
    FROM pages p
    JOIN pages a ON a.page_id = (7 * p.page_id + 1) % (SELECT count(*) FROM pages)
    JOIN pages b ON b.page_id = (3 * p.page_id + 2) % (SELECT count(*) FROM pages))"""


def responses(source: str = "pages") -> str:
    return f"""responses AS (
    SELECT page_id, url, url AS original_url,
        CASE page_id % 20 WHEN 17 THEN 404 WHEN 18 THEN 500 WHEN 19 THEN NULL ELSE 200 END AS status_code,
        CASE WHEN page_id % 20 = 19 THEN ['ConnectionError', 'Timeout', 'TooManyRedirects'][(page_id % 3 + 1)::INT] END AS error_type,
        CASE WHEN page_id % 20 = 19 THEN 'e' || page_id END AS error_message,
        CASE WHEN page_id % 20 = 19 THEN '' ELSE html END AS content,
        CASE WHEN page_id % 10 = 0 THEN 'http://r.example.com/' || page_id ELSE '' END AS redirects,
        (page_id % 100) / 100.0::DOUBLE AS elapsed,
        {domain('url')} AS target,
        (page_id % 4)::INT AS depth
    FROM {source})"""


ENTITIES = [("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("nbsp", "\u00a0"), ("copy", "©"), ("middot", "·"), ("amp", "&")]


def unescape(x: str) -> str:
    """Named references count without their semicolon too, as in ``&amp</title>``."""
    for name, char in ENTITIES:
        x = rx_sub(x, rf"&{name}(?:;|\b)", char)
    return x


def title(html: str) -> str:
    return f"replace(replace(trim({unescape(rx(html, '(?is)<title[^>]*>(.*?)</title', 1))}, ' \t\n\r '), chr(10), ''), chr(13), '')"


def title_column() -> str:
    return f"""CASE WHEN status_code = 200 THEN {title('content')}
        WHEN status_code IS NOT NULL THEN {q(catalog.TITLE_FAILED)} || status_code ELSE '' END"""


def error_text(kind: str, message: str) -> str:
    whens = " ".join(
        f"WHEN {kind} IN ({', '.join(q(n) for n in names)}) THEN {q(prefix)} || {message}"
        for names, prefix in catalog.ERROR_PREFIXES
    )
    return f"(CASE {whens} ELSE 'Error(' || {kind} || '): ' || {message} END)"


STATUS = f"""CASE WHEN status_code IS NOT NULL THEN status_code::VARCHAR
    WHEN error_type IS NOT NULL THEN {error_text('error_type', 'error_message')} ELSE {q(catalog.NO_RESPONSE)} END"""


def collapsed(code: str = "status_code", status: str = "status") -> str:
    return f"CASE WHEN {code} IS NULL AND contains({status}, 'Err') THEN 'Err' ELSE {status} END"


RECORDS = f"""records AS (
    SELECT page_id, target, url, status_code, {STATUS} AS status, {title_column()} AS title, length(content)::INT AS length,
        CASE WHEN status_code IS NULL THEN '' ELSE redirects END AS redirects, depth,
        CASE WHEN status_code IS NULL THEN 0 ELSE elapsed END AS time,
        CASE WHEN status_code IS NULL THEN '' ELSE 'text/html' END AS content_type,
        CASE WHEN status_code IS NULL THEN 0 WHEN page_id % 2 = 0 THEN 2 ELSE 1 END::INT AS headers_count,
        CASE WHEN status_code IS NULL THEN error_type END AS error_type, original_url, content
    FROM responses)"""
SIGNED = f"""signed AS (SELECT *, length || '|' || ({collapsed()}) || '|' AS signature FROM records)"""
FLAGGED = """flagged AS (SELECT *, row_number() OVER (PARTITION BY target, signature ORDER BY depth, url) > 1
    AS is_duplicate_signature FROM signed)"""


# Link extraction


def captured(html: str, pattern: str) -> str:
    """What a pattern captures in a page: its first non-empty group."""
    import re

    groups = re.compile(pattern).groups
    if pattern == dict(catalog.PATH_PATTERNS)["call_argument"]:
        # The back-reference only lets equal quotes through, and a quote as first group is no link.
        pattern, groups = r"(?:\.get|\.post|\.ajax|fetch|axios\.get|axios\.post)\s*\(\s*([a-zA-Z0-9_/-]+)", 1
    if groups <= 1:
        return rx_all(html, "(?i)" + pattern, groups)
    parts = ", ".join(f"nullif({rx('m', '(?i)' + pattern, g)}, '')" for g in range(1, groups + 1))
    return f"list_transform({rx_all(html, '(?i)' + pattern)}, lambda m: coalesce({parts}, ''))"


def raws(source: str, kinds=("path", "tag", "dom")) -> str:
    """CTEs ending in raws(page_id, url, source, raw)."""
    import re

    parts = []
    if "path" in kinds:
        found = [captured("html", p) for _, p in catalog.PATH_PATTERNS if re.compile(p).groups]
        union = found[0]
        for one in found[1:]:
            union = f"list_concat({union}, {one})"
        parts.append(f"SELECT page_id, url, 'path' AS source, unnest({union}) AS raw FROM {source}")
    if "tag" in kinds:
        for name, _, pattern in tag_patterns():
            if name.endswith("_bare"):
                parts.append(
                    f"SELECT page_id, url, 'tag' AS source, unnest({rx_all('html', '(?i)' + pattern, 1)}) AS raw FROM {source}"
                )
    ctes = []
    if "dom" in kinds:
        ctes.append(dom(source))
        parts.append("SELECT page_id, url, 'dom' AS source, raw FROM dom")
    ctes.append("raws AS (SELECT DISTINCT * FROM (" + " UNION ALL ".join(parts) + "))")
    return ",\n".join(ctes)


def dom(source: str) -> str:
    tags = "|".join(sorted({t for t, _ in catalog.TAG_ATTRIBUTES}))
    visible = rx_sub("html", r"(?is)<!--.*?-->")
    visible = f"regexp_replace({visible}, {q('(?is)(<(?:script|style)[^>]*>).*?</(script|style)')}, {q(chr(92) + '1</' + chr(92) + '2')}, 'g')"
    attribute = r"""([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"'][^\s>]*))?"""
    pairs = lists(f"{t} {a}" for t, a in catalog.TAG_ATTRIBUTES)
    attributes = lists(sorted({a for _, a in catalog.TAG_ATTRIBUTES}))
    open_tag = rf"""(?i)<(?:{tags})(?:[\s/](?:[^>"']|"[^"]*"|'[^']*')*)?>"""
    return f"""tags AS (SELECT page_id, url, unnest({rx_all(visible, open_tag)}) AS tag FROM {source}),
bodies AS (SELECT page_id, url, lower({rx('tag', '^<([A-Za-z]+)', 1)}) AS name,
    regexp_replace(regexp_replace(tag, '^<[A-Za-z]+', ''), '>$', '') AS body FROM tags),
attrs AS (SELECT page_id, url, name,
    list_transform({rx_all('body', attribute, 1)}, lambda n: lower(n)) AS names,
    {rx_all('body', attribute, 2)} AS vals FROM bodies),
linked_attrs AS (SELECT page_id, url, names, vals, unnest(list_filter({attributes}, lambda a:
    list_contains({pairs}, name || ' ' || a) AND list_contains(names, a))) AS attribute FROM attrs),
found_values AS (SELECT page_id, url,
    coalesce(vals[len(names) - list_position(list_reverse(names), attribute) + 1], '') AS v FROM linked_attrs),
dom AS (SELECT page_id, url, {unescape("CASE WHEN v[1] IN ('\"', '''') THEN v[2:-2] ELSE v END")} AS raw FROM found_values)"""


CHUNK = r'(?i)"(chunk-[\w]+)":"([\w]+)"'


def chunks(source: str) -> str:
    return f"""chunk_names AS (SELECT page_id, url, unnest(list_transform({rx_all('html', CHUNK)},
    lambda m: {rx('m', CHUNK, 1)} || '.' || {rx('m', CHUNK, 2)} || '.js')) AS name FROM {source}),
chunks AS (SELECT DISTINCT page_id, url, {scheme('url')} || '://' || {netloc('url')} || '/static/js/' || name AS link
    FROM chunk_names WHERE length(name) > 20 AND length(name) < 28)"""


def links(source: str, scope: str = "domain", danger: bool = True, keywords=DANGER) -> str:
    """CTEs ending in links(page_id, url, link, disposition)."""
    inside = "true" if scope == "all" else f"{domain('link')} = {domain('url')}"
    risky = dangerous("link", keywords) if danger else "false"
    return f"""{raws(source)},
{chunks(source)},
cands AS (SELECT DISTINCT page_id, url, {clean('raw')} AS c FROM raws),
found AS (
    SELECT page_id, url, {rx('c', 'https?://[^ ]+')} AS link, 'full' AS kind FROM cands WHERE contains(c, 'http')
    UNION
    SELECT page_id, url, {resolve('url', 'c')} AS link, 'resolved' AS kind
    FROM (SELECT page_id, url, {ready('c', scheme('url'))} AS c FROM cands WHERE c IS NOT NULL AND NOT contains(c, 'http'))),
links AS (
    SELECT DISTINCT page_id, url, link, CASE
        WHEN kind = 'resolved' AND NOT {valid('link')} THEN 'invalid'
        WHEN kind = 'resolved' AND {risky} THEN 'danger'
        WHEN NOT ({inside}) THEN CASE kind WHEN 'full' THEN 'external' ELSE 'out_of_scope' END
        WHEN {has_extension('link')} THEN 'extension'
        ELSE 'keep' END AS disposition
    FROM found WHERE link <> ''
    UNION SELECT page_id, url, link, 'keep' FROM chunks)"""


# Detection


def _repr(x: str) -> str:
    escaped = f"replace({x}, '\\', '\\\\')"
    for char, code in (("chr(10)", "\\n"), ("chr(13)", "\\r"), ("chr(9)", "\\t")):
        escaped = f"replace({escaped}, {char}, '{code}')"
    return f"""(CASE WHEN contains({x}, '''') AND NOT contains({x}, '"') THEN '"' || {escaped} || '"'
        ELSE '''' || replace({escaped}, '''', '\\''') || '''' END)"""


def rule_matches(rule, text: str, mode: str = "findall") -> str:
    pattern = rule.pattern.replace(")*+[", ")*[").replace(r"\_", "_")
    if rule.key == "email":
        endings = pattern[pattern.index("(?!") + 3 : pattern.index(")[a-zA-Z]{2,10}")]
        plain = pattern.replace(f"(?!{endings})", "")
        return f"list_filter({rx_all(text, plain)}, lambda m: NOT {rx_is('m', rf'[.](?:{endings})[a-zA-Z]*$')})"
    if rule.groups <= 1 or mode == "match":
        group = 0 if mode == "match" else rule.groups
        return f"list_transform({rx_all(text, pattern, group)}, lambda m: coalesce(m, ''))"
    groups = " || ', ' || ".join(_repr(f"coalesce({rx('m', pattern, g)}, '')") for g in range(1, rule.groups + 1))
    return f"list_transform({rx_all(text, pattern)}, lambda m: '(' || {groups} || ')')"


def hits(source: str, key: str, text: str, mode: str = "findall") -> str:
    """CTE hits(key, ord, rule, type, samples) over all rules."""
    found = ",\n".join(
        f"{{'ord': {i}, 'rule': {q(r.key)}, 'type': {q(r.label)}, 'samples': list_sort(list_distinct({rule_matches(r, text, mode)}))}}"
        for i, r in enumerate(default_rules(), 1)
    )
    return f"""all_hits AS (SELECT {key}, unnest([{found}]) AS h FROM {source}),
hits AS (SELECT {key}, h.ord::INT AS ord, h.rule AS rule, h.type AS type, h.samples AS samples
    FROM all_hits WHERE len(h.samples) > 0)"""


def flat(key: str) -> str:
    return f"""flat AS (SELECT {key}, string_agg(type, '|' ORDER BY ord) AS sensitive_types,
    string_agg(len(samples)::VARCHAR, '|' ORDER BY ord) AS sensitive_counts,
    string_agg(type || ':' || array_to_string(samples, '; '), '|' ORDER BY ord) AS sensitive_details,
    string_agg(type || 'X' || len(samples), {q(catalog.SUMMARY_SEPARATOR)} ORDER BY ord) AS summary FROM hits GROUP BY {key})"""


FINDING_COLUMNS = "ord, rule, type, len(samples)::INT AS count, len(samples)::INT AS total, array_to_string(samples, '; ') AS samples"
NO_FINDINGS = "'' AS sensitive_types, '' AS sensitive_counts, '' AS sensitive_details"


def select(ctes: list[str], body: str, recursive: bool = False) -> str:
    return "WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(ctes) + "\n" + body


def report_of(source: str, flag: str = "is_duplicate_signature", found: str = NO_FINDINGS, extra: str = "") -> str:
    return f"""SELECT {extra}url, {collapsed()} AS status, title, length, {link_type('url')} AS link_type, redirects, depth,
    {found}, CASE WHEN {flag} THEN {q(catalog.YES)} ELSE {q(catalog.NO)} END AS is_duplicate FROM {source}"""


def placeholder(label: str, source: str, extra: str = "") -> str:
    return f"""SELECT {extra}url, {q(label)} AS status, {q(label)} AS title, 0 AS length, {link_type('url')} AS link_type,
    '' AS redirects, 0 AS depth, {NO_FINDINGS}, {q(catalog.NO)} AS is_duplicate FROM {source}"""


# Sources and result records

ORACLES["targets"] = "SELECT url FROM pages"
ORACLES["responses"] = select(
    [responses(), "frontier AS (SELECT unnest([url, url || '/missing']) AS asked FROM pages)"],
    """SELECT asked AS original_url, r.url, status_code::INT AS status_code, error_type, length(content)::INT AS length
    FROM frontier LEFT JOIN responses r ON r.original_url = asked""",
)
ORACLES["result_record"] = select([responses(), RECORDS], "SELECT * EXCLUDE (target, status_code, content) FROM records")
ORACLES["header_info"] = "SELECT page_id, 'text/html' AS content_type, CASE WHEN page_id % 2 = 0 THEN 2 ELSE 1 END::INT AS n_headers FROM pages"
ORACLES["error_status"] = select(
    ["""kinds AS (SELECT page_id, url, ['ConnectionError', 'SSLError', 'ConnectTimeout', 'ReadTimeout', 'TooManyRedirects',
    'InvalidURL', 'ValueError', 'Timeout'][(page_id % 8 + 1)::INT] AS kind FROM pages)""",
     f"texts AS (SELECT page_id, {error_text('kind', 'url')} AS status FROM kinds)"],
    f"SELECT page_id, status, {collapsed('NULL')} AS collapsed FROM texts",
)
ORACLES["status_class"] = select(
    [responses(), RECORDS],
    """SELECT page_id, CASE WHEN status_code // 100 BETWEEN 2 AND 5 THEN (status_code // 100) || 'xx'
    WHEN contains(status, 'Err') THEN 'error' ELSE 'other' END AS status_class FROM records""",
)
ORACLES["title"] = select([responses(), RECORDS], "SELECT page_id, title FROM records")

_ASCII = rx_sub("html", r"[^\x00-\x7f]", "?")
ORACLES["decode_declared"] = f"""SELECT page_id,
    md5(CASE page_id % 4 WHEN 1 THEN html || '\ufffd(' WHEN 3 THEN {_ASCII} ELSE html END) AS content,
    CASE page_id % 4 WHEN 0 THEN md5(html) WHEN 1 THEN md5(html || '(') WHEN 3 THEN md5({_ASCII}) END AS link_text FROM pages"""

# URLs

ORACLES["url_valid"] = select(
    [f"""made AS (SELECT page_id, {netloc('url')} AS n, url FROM pages)""",
     """cases AS (SELECT page_id, unnest([url, 'FTP://' || n || '/a', 'gopher://' || n, 'http://localhost/' || page_id,
    'http://' || n || ':0/', 'http://' || n || ':' || (page_id + 65530) || '/', 'http://' || n || ':abc/',
    'http://u:p@' || n || ':99999/', 'http://' || substr(n, 1, 3) || '.x/',
    url || repeat('a', (2048 - length(url) + page_id % 2)::INT), ' ' || url || '  ', '  ']) AS candidate,
    unnest(range(12))::INT AS case_no FROM made)"""],
    f"SELECT page_id, case_no, md5(candidate) AS candidate, coalesce({valid('candidate')}, false) AS valid FROM cases",
)
ORACLES["link_type"] = select(
    [f"made AS (SELECT page_id, unnest([url, 'https://' || {netloc('url')}, url || '/a.js?v=1.2', '']) AS link FROM pages)"],
    f"SELECT page_id, link, {link_type('link')} AS link_type FROM made",
)
REFS = [
    "//c.example.com/x{id}", "#/r{id}", "/x{id}", "//", "./x{id}", ".//x{id}", "../s/{id}.js", "../x/../y{id}/",
    "../../../x{id}?a=../b", "https://o.example.org/{id}", "c//d{id}", "?q={id}", "#top{id}", "a/./b/../{id}", "..",
    ".", "", "a/../../../{id}", "ws://w.example.com//s{id}", "foo:bar{id}", "x{id}?y#z",
]
ORACLES["resolve_links"] = select(
    [f"""cases AS (SELECT page_id, url, unnest(list_transform({lists(REFS)}, lambda r: replace(r, '{{id}}', page_id::VARCHAR))) AS rel,
    unnest(range({len(REFS)}))::INT AS case_no FROM pages)""",
     f"made AS (SELECT page_id, case_no, {resolve('url', 'rel')} AS link FROM cases)"],
    f"SELECT page_id, case_no, link FROM made WHERE {valid('link')}",
)
RAW_FORMS = [
    "/für{id}", "/the,{id}", "javascript:x{id}", "mailto:a{id}", "data:{id}", "tel:{id}", '"x{id}', "  ", "",
    "\\/a\\/b{id}", "/a?b=1&amp;c={id}", "//h.example.com/{id}", "\\\\", "~x-{id}_%41", " /lead{id}",
]
ORACLES["clean_links"] = select(
    [f"""cases AS (SELECT page_id, {scheme('url')} AS base_scheme,
    unnest(list_transform({lists(RAW_FORMS)}, lambda r: replace(r, '{{id}}', page_id::VARCHAR))) AS raw,
    unnest(range({len(RAW_FORMS)}))::INT AS case_no FROM pages)""",
     f"made AS (SELECT page_id, case_no, base_scheme, {clean('raw')} AS cleaned FROM cases)"],
    f"SELECT page_id, case_no, cleaned, {ready('cleaned', 'base_scheme')} AS ready FROM made WHERE cleaned IS NOT NULL",
)
ORACLES["route_expand"] = select(
    [raws("pages", ("dom",)),
     f"cands AS (SELECT DISTINCT page_id, url, {clean('raw')} AS c FROM raws)",
     f"rels AS (SELECT page_id, url, {ready('c', scheme('url'))} AS rel FROM cands WHERE c IS NOT NULL AND NOT contains(c, 'http'))",
     f"""variants AS (SELECT page_id, unnest([{resolve('url', 'rel')},
    'https://example.com/gateway/api/v1/' || ltrim(rel, '/'), 'https://example.com/' || ltrim(rel, '/'),
    'https://example.com/#/' || ltrim(rel, '/')]) AS link, unnest([1, 2, 3, 4]) AS place, rel, url FROM rels)""",
     f"valid_variants AS (SELECT * FROM variants WHERE {valid('link')})",
     f"""cut AS (SELECT *, min(CASE WHEN {dangerous('link', catalog.DANGER_KEYWORDS)} THEN place END)
    OVER (PARTITION BY page_id, url, rel) AS stop FROM valid_variants)"""],
    "SELECT DISTINCT page_id, link FROM cut WHERE stop IS NULL OR place <= stop",
)

# Extraction

ORACLES["extract_links"] = select(
    [RICH, links("rich", danger=False)], "SELECT page_id, link FROM links WHERE disposition = 'keep'"
)
ORACLES["link_disposition"] = select([RICH, links("rich")], "SELECT page_id, link, disposition FROM links")
ORACLES["tag_links"] = select(
    [RICH, raws("rich", ("tag",))],
    f"SELECT page_id, raw, {clean('raw')} AS cleaned FROM raws WHERE {clean('raw')} IS NOT NULL",
)
ORACLES["dom_links"] = select([RICH, raws("rich", ("dom",))], f"SELECT page_id, raw, {clean('raw')} AS cleaned FROM raws")
ORACLES["webpack_links"] = select([RICH, chunks("rich")], "SELECT page_id, link FROM chunks")


def _counts() -> str:
    patterns = [(name, p) for name, p in catalog.PATH_PATTERNS]
    patterns += [(name, p) for name, _, p in tag_patterns()]
    patterns.append(("webpack_chunk", catalog.WEBPACK_PATTERN))
    rows = []
    for name, p in patterns:
        if name == "call_argument":
            head, tail = p.split(r"""(['"`]?)""")
            word = tail.replace(r"\1", "")
            p = "(?:" + "|".join(f"{head}{mark}{word}{mark}" for mark in ('"', "'", "`", "")) + ")"
        elif name.endswith("_quoted"):
            p = p.replace(r"""(['"])(.*?)\1""", r"""(?:".*?"|'.*?')""")
        rows.append(f"SELECT {q(name)} AS pattern, coalesce(sum(len({rx_all('html', '(?i)' + p)})), 0)::BIGINT AS matches FROM rich")
    return " UNION ALL ".join(rows)


ORACLES["pattern_counts"] = select([RICH], _counts())
ORACLES["external_links"] = select(
    [LINKED, links("linked")], "SELECT DISTINCT link AS url FROM links WHERE disposition = 'external'"
)
ORACLES["link_stats"] = select(
    [LINKED, links("linked"),
     """firsts AS (SELECT link, min(page_id) AS page_id FROM links WHERE disposition = 'keep'
    AND link NOT IN (SELECT url FROM pages) GROUP BY link)"""],
    "SELECT l.page_id, "
    + ", ".join(
        f"count(*) FILTER (disposition = '{d}') AS n_{d}"
        for d in ("keep", "external", "danger", "out_of_scope", "extension", "invalid")
    )
    + """, count(f.link) FILTER (disposition = 'keep') AS added,
    count(*) FILTER (disposition = 'keep' AND f.link IS NULL) AS skipped
    FROM links l LEFT JOIN firsts f ON f.link = l.link AND f.page_id = l.page_id GROUP BY l.page_id""",
)

# Filters

ORACLES["ext_filter"] = f"SELECT page_id, {has_extension('url')} AS blocked FROM pages"
_PLACE = netloc("link")
ORACLES["scope_filter"] = select(
    [f"""pairs AS (SELECT p.page_id, {domain('o.url')} AS target,
    unnest([p.url, 'http://blog.spam-farm.' || {host('p.url')} || '.co.uk/']) AS link
    FROM pages p JOIN pages o ON o.page_id = (7 * p.page_id + 1) % (SELECT count(*) FROM pages))"""],
    f"""SELECT page_id, link, target,
    {domain('link')} = target AND NOT contains({_PLACE}, 'spam-farm') AS scope_0,
    {domain('link')} = target AND NOT contains({_PLACE}, 'spam-farm') AS scope_1,
    NOT contains({_PLACE}, 'spam-farm') AS scope_2,
    contains({_PLACE}, 'blog.') AND NOT contains({_PLACE}, 'spam-farm') AS scope_3 FROM pairs""",
)
ORACLES["request_gate"] = select(
    [responses(),
     f"""gates AS (SELECT page_id, original_url, CASE WHEN contains(url, 'spam-farm') THEN {q(catalog.BLACKLISTED)} || url
    WHEN NOT contains(url, 'blog.') THEN {q(catalog.NOT_WHITELISTED)} || url END AS refused,
    status_code, error_type, error_message FROM responses)"""],
    f"""SELECT page_id, original_url, CASE WHEN refused IS NOT NULL THEN 'Error(Exception): ' || refused ELSE {STATUS} END AS status,
    CASE WHEN refused IS NOT NULL THEN 'Exception' WHEN status_code IS NULL THEN error_type END AS error_type FROM gates""",
)
DANGER_URLS = "danger AS (SELECT DISTINCT link AS url FROM links WHERE disposition = 'danger')"
ORACLES["danger_links"] = select([RICH, links("rich"), DANGER_URLS], "SELECT url FROM danger")
ORACLES["danger_types"] = select(
    [RICH, links("rich"), DANGER_URLS],
    f"SELECT url, {danger_types('url')} AS types, {danger_types('url', False)} AS exact_types FROM danger",
)
ORACLES["danger_rank"] = select(
    [RICH, links("rich"), DANGER_URLS],
    f"SELECT url, row_number() OVER (ORDER BY url) AS rank, {danger_types('url')} AS danger_types FROM danger",
)
ORACLES["danger_report"] = select(
    [RICH, links("rich"), DANGER_URLS],
    f"""SELECT url, {q(catalog.DANGER)} AS status, {q(catalog.DANGER_TITLE)} AS title, 0 AS length, {q(catalog.DANGER)} AS link_type,
    '' AS redirects, 0 AS depth, {danger_types('url')} AS sensitive_types, '1' AS sensitive_counts,
    {q(catalog.DANGER_TITLE + ': ')} || {danger_types('url')} AS sensitive_details, {q(catalog.NO)} AS is_duplicate FROM danger""",
)

# Detection

ORACLES["findings"] = select([hits("documents", "doc_id", "text")], f"SELECT doc_id, {FINDING_COLUMNS} FROM hits")
ORACLES["page_findings"] = select([hits("pages", "page_id", "html")], f"SELECT page_id, {FINDING_COLUMNS} FROM hits")


def seeded() -> str:
    text = q(SEEDS)
    for size in (32, 16, 8, 2):
        text = f"replace({text}, '{{h{size}}}', substr(md5(doc_id::VARCHAR), 1, {size}))"
        text = f"replace({text}, '{{H{size}}}', upper(substr(md5(doc_id::VARCHAR), 1, {size})))"
    for size in (8, 3):
        text = f"replace({text}, '{{d{size}}}', lpad((doc_id % {10**size})::VARCHAR, {size}, '0'))"
    text = f"replace({text}, '{{b}}', (doc_id % 256)::VARCHAR)"
    return f"seeded AS (SELECT doc_id, text || {text} AS text FROM documents)"


ORACLES["findings_all_rules"] = select([seeded(), hits("seeded", "doc_id", "text")], f"SELECT doc_id, {FINDING_COLUMNS} FROM hits")
ORACLES["findings_whole_match"] = select(
    [seeded(), hits("seeded", "doc_id", "text", "match")], f"SELECT doc_id, {FINDING_COLUMNS} FROM hits"
)
ORACLES["findings_custom"] = select(
    ["items AS (SELECT item_id, text AS item, row_number() OVER (ORDER BY item_id)::INT AS ord FROM benchmark WHERE length(text) >= 16)",
     rf"""patterns AS (SELECT *, '(' || regexp_replace(left(item, 16), '([!-/:-@\[-`{{-~])', '\\\1', 'g') || '[a-z]*)([ .]?)' AS p FROM items)""",
     """matched AS (SELECT doc_id, item_id, ord, list_zip(regexp_extract_all(d.text, p, 1), regexp_extract_all(d.text, p, 2)) AS found
    FROM documents d JOIN patterns ON contains(d.text, left(item, 16)))""",
     """samples AS (SELECT doc_id, item_id, ord, list_sort(list_distinct(list_transform(found,
        lambda m: '(' || chr(39) || m[1] || chr(39) || ', ' || chr(39) || m[2] || chr(39) || ')'))) AS s FROM matched)"""],
    """SELECT doc_id, ord, 'item ' || item_id AS rule, 'item ' || item_id AS type, len(s)::INT AS count, len(s)::INT AS total,
    array_to_string(s, '; ') AS samples FROM samples""",
)
ORACLES["finding_types"] = select(
    [hits("documents", "doc_id", "text")],
    "SELECT doc_id, count(ord)::INT AS n_types FROM documents LEFT JOIN hits USING (doc_id) GROUP BY doc_id",
)
ORACLES["findings_flat"] = select(
    [hits("documents", "doc_id", "text"), flat("doc_id")],
    """SELECT doc_id, coalesce(sensitive_types, '') AS sensitive_types, coalesce(sensitive_counts, '') AS sensitive_counts,
    coalesce(sensitive_details, '') AS sensitive_details FROM documents LEFT JOIN flat USING (doc_id)""",
)
ORACLES["findings_summary"] = select(
    [hits("documents", "doc_id", "text"), flat("doc_id")],
    "SELECT doc_id, coalesce(summary, '') AS summary FROM documents LEFT JOIN flat USING (doc_id)",
)

# Duplicates

ORACLES["signature_counts"] = select(
    [responses(), RECORDS, SIGNED], "SELECT target, signature, count(*) AS n FROM signed GROUP BY target, signature"
)
ORACLES["dup_flag"] = select(
    [responses(), RECORDS, SIGNED, FLAGGED], "SELECT page_id, signature, is_duplicate_signature FROM flagged"
)
ORACLES["dup_content"] = select(
    ["signed AS (SELECT doc_id, source AS target, length(text) || '|200|' || md5(text) AS signature FROM documents)"],
    """SELECT doc_id, target, signature,
    row_number() OVER (PARTITION BY target, signature ORDER BY doc_id) > 1 AS is_duplicate_signature FROM signed""",
)
ORACLES["dup_redirect"] = select(
    [
        responses(),
        """moved AS (SELECT page_id, 't' AS target, (page_id % 2)::INT AS depth, url AS original_url, status_code, error_type, error_message,
        CASE WHEN page_id % 5 = 1 THEN 'http://r.example.com/' || (page_id % 3) ELSE url END AS url,
        CASE WHEN page_id % 10 = 1 THEN '<p>moved</p>' ELSE content END AS content FROM responses)""",
        "twice AS (SELECT * FROM moved UNION ALL SELECT * FROM moved WHERE page_id % 11 = 0)",
        f"records AS (SELECT *, {STATUS} AS status, length(content)::INT AS length FROM twice)",
        SIGNED,
    ],
    """SELECT page_id, url, original_url, signature,
    row_number() OVER (PARTITION BY target, signature ORDER BY depth, url, original_url) > 1 AS is_duplicate_signature FROM signed""",
)
ORACLES["live_rows"] = select(
    [responses(), RECORDS, SIGNED, FLAGGED],
    "SELECT target, url, depth, signature FROM flagged WHERE NOT is_duplicate_signature",
)

# Reports

FLAT_COLUMNS = """coalesce(sensitive_types, '') AS sensitive_types, coalesce(sensitive_counts, '') AS sensitive_counts,
    coalesce(sensitive_details, '') AS sensitive_details"""
ORACLES["report"] = select(
    [responses(), RECORDS, SIGNED, FLAGGED, hits("records", "page_id", "content"), flat("page_id")],
    report_of("flagged LEFT JOIN flat USING (page_id)", found=FLAT_COLUMNS),
)
EXTERNAL_URLS = "external AS (SELECT DISTINCT link AS url FROM links WHERE disposition = 'external')"
ORACLES["report_union"] = select(
    [responses(), RECORDS, SIGNED, FLAGGED, LINKED, links("linked"), EXTERNAL_URLS],
    report_of("flagged") + "\nUNION ALL\n" + placeholder(catalog.EXTERNAL, "external"),
)
ORACLES["report_partition"] = f"SELECT page_id, {rx_sub(rx_sub(netloc('url'), ':.*$'), '[^a-zA-Z0-9.]')} AS folder FROM pages"
ORACLES["scan_stats"] = select(
    [responses(), RECORDS],
    """SELECT target, count(*) AS current_requests, 100::BIGINT AS max_requests, greatest(0, 100 - count(*)) AS remaining_requests,
    count(*) AS url_count, round(sum(time), 6) AS total_time,
    CASE WHEN sum(time) > 0 THEN round(count(*) / sum(time), 6) ELSE 0.0 END AS urls_per_second FROM records GROUP BY target""",
)

# Walks

STARTS = f"starts AS (SELECT min(url) AS url, {domain('url')} AS domain FROM pages GROUP BY {domain('url')})"


def walk(depth: int, scoped: bool, source: str = "links") -> list[str]:
    """CTEs ending in walked(target, url, depth); start URLs at 0, others at their first depth from 1 on."""
    inside = f"AND {domain('e.link')} = w.domain" if scoped else ""
    return [
        f"edges AS (SELECT DISTINCT url, link FROM {source} WHERE disposition = 'keep')",
        STARTS,
        f"""steps AS (SELECT url AS target, domain, url, 0 AS depth FROM starts
    UNION SELECT w.target, w.domain, e.link, w.depth + 1 FROM steps w JOIN edges e ON e.url = w.url
    WHERE w.depth < {depth} {inside})""",
        """walked AS (SELECT url AS target, url, 0 AS depth FROM starts
    UNION ALL SELECT target, url, min(depth) AS depth FROM steps WHERE depth > 0 GROUP BY target, url)""",
    ]


ORACLES["reachable"] = select(
    [LINKED, links("linked", scope="all", danger=False), *walk(3, False)],
    "SELECT target, url, depth::INT AS depth FROM walked", recursive=True,
)
ORACLES["reachable_domain"] = select(
    [LINKED, links("linked", scope="all"), *walk(5, True)],
    "SELECT target, url, depth::INT AS depth FROM walked", recursive=True,
)
ORACLES["budget"] = select(
    [responses()],
    """SELECT target, depth, url, row_number() OVER (PARTITION BY target ORDER BY depth, url) AS request,
    row_number() OVER (PARTITION BY target ORDER BY depth, url) <= 100 AS within_budget,
    CASE WHEN row_number() OVER (PARTITION BY target ORDER BY depth, url) > 100 THEN '"""
    + catalog.OVER_BUDGET
    + """' END AS refused FROM responses""",
)


def rationed(depth: int, scoped: bool, budget: int, source: str = "links") -> list[str]:
    """CTEs ending in rationed(target, domain, url, depth, request, within_budget), one level after the other."""
    inside = "AND " + f"{domain('e.link')} = w.domain" if scoped else ""
    parts = [
        f"edges AS (SELECT DISTINCT url, link FROM {source} WHERE disposition = 'keep')",
        STARTS,
        f"level0 AS (SELECT url AS target, domain, url, 0 AS depth, 1 AS request, {budget} >= 1 AS within_budget FROM starts)",
    ]
    for d in range(1, depth + 1):
        visited = " UNION ALL ".join(f"SELECT url FROM level{i}" for i in range(1, d)) or "SELECT NULL AS url WHERE false"
        spent = " UNION ALL ".join(f"SELECT target, max(request) AS n FROM level{i} GROUP BY target" for i in range(d))
        parts += [
            f"""new{d} AS (SELECT min(w.target) AS target, min_by(w.domain, w.target) AS domain, e.link AS url
    FROM level{d - 1} w JOIN edges e ON e.url = w.url WHERE w.within_budget {inside} AND e.link NOT IN ({visited}) GROUP BY e.link)""",
            f"""level{d} AS (SELECT *, request <= {budget} AS within_budget FROM (
    SELECT n.target, domain, url, {d} AS depth, row_number() OVER (PARTITION BY n.target ORDER BY url) + s.n AS request
    FROM new{d} n JOIN (SELECT target, max(n) AS n FROM ({spent}) GROUP BY target) s ON s.target = n.target))""",
        ]
    return [*parts, "rationed AS (" + " UNION ALL ".join(f"SELECT * FROM level{i}" for i in range(depth + 1)) + ")"]


ORACLES["walk_budget"] = select(
    [LINKED, links("linked", scope="all", danger=False), *rationed(3, False, 7)],
    "SELECT target, url, depth::INT AS depth, request::BIGINT AS request, within_budget FROM rationed",
)
ORACLES["scan_budget"] = select(
    [LINKED, "answered AS (SELECT * FROM linked WHERE page_id % 20 <> 19)", links("answered"), *rationed(3, True, 3), responses("linked"),
     """visits AS (SELECT w.target, w.url, w.url AS original_url, r.page_id, r.status_code, r.error_type, r.error_message,
    coalesce(r.content, '') AS content, coalesce(r.redirects, '') AS redirects, coalesce(r.elapsed, 0) AS elapsed, w.depth
    FROM rationed w LEFT JOIN responses r ON r.url = w.url WHERE w.within_budget)""",
     RECORDS.replace("FROM responses", "FROM visits"), SIGNED, FLAGGED],
    f"""SELECT target, url, depth::INT AS depth, status, is_duplicate_signature FROM flagged
    UNION ALL SELECT target, url, depth::INT, {q(catalog.OVER_BUDGET)}, false FROM rationed WHERE NOT within_budget""",
)
ORACLES["external_once"] = select(
    [responses(), RECORDS, LINKED, links("linked"), EXTERNAL_URLS],
    f"""SELECT e.url AS original_url, coalesce(r.status, {q(catalog.NO_RESPONSE)}) AS status, coalesce(r.title, '') AS title,
    coalesce(r.length, 0)::INT AS length, 0 AS depth FROM external e LEFT JOIN records r ON r.original_url = e.url""",
)
ORACLES["external_unvisited"] = select(
    [responses(), LINKED, links("linked"), EXTERNAL_URLS,
     "unvisited AS (SELECT url FROM external WHERE url NOT IN (SELECT url FROM responses WHERE status_code = 200))"],
    placeholder(catalog.EXTERNAL, "unvisited"),
)

# The batch scan: pages that did not answer have no links.
ORACLES["scan_bad_targets"] = select(
    [LINKED, "answered AS (SELECT * FROM linked WHERE page_id % 20 <> 19)", links("answered"), *walk(1, True), responses("linked"),
     f"""bad AS (SELECT unnest(['no url ' || {netloc('url')}, 'http://gone.' || {netloc('url')}]) AS url FROM starts)""",
     """visits AS (SELECT w.target, w.url, w.url AS original_url, r.page_id, r.status_code, r.error_type, r.error_message,
    coalesce(r.content, '') AS content, coalesce(r.redirects, '') AS redirects, coalesce(r.elapsed, 0) AS elapsed, w.depth
    FROM (SELECT * FROM walked UNION ALL SELECT url, url, 0 FROM bad) w LEFT JOIN responses r ON r.url = w.url)""",
     RECORDS.replace("FROM responses", "FROM visits")],
    "SELECT target, url, depth::INT AS depth, status, length FROM records", recursive=True,
)
ORACLES["scan_one_domain"] = select(
    [LINKED, "answered AS (SELECT * FROM linked WHERE page_id % 20 <> 19)", links("answered"),
     *[part.replace("FROM pages GROUP BY", "FROM pages WHERE url = (SELECT min(url) FROM pages) GROUP BY") for part in walk(3, True)], responses("linked"),
     """visits AS (SELECT w.target, w.url, w.url AS original_url, r.page_id, r.status_code, r.error_type, r.error_message,
    coalesce(r.content, '') AS content, coalesce(r.redirects, '') AS redirects, coalesce(r.elapsed, 0) AS elapsed, w.depth
    FROM walked w LEFT JOIN responses r ON r.url = w.url)""",
     RECORDS.replace("FROM responses", "FROM visits"), SIGNED, FLAGGED],
    "SELECT target, url, depth::INT AS depth, status, length, is_duplicate_signature FROM flagged", recursive=True,
)
ANSWERED = "answered AS (SELECT * FROM linked WHERE page_id % 20 <> 19)"
ORACLES["batch_summary"] = select(
    [LINKED, ANSWERED, links("answered"), *walk(2, True), responses("linked"),
     f"""visits AS (SELECT w.target, w.url, w.url AS original_url, r.page_id, r.status_code, r.error_type, r.error_message,
    coalesce(r.content, '') AS content, coalesce(r.redirects, '') AS redirects, coalesce(r.elapsed, 0) AS elapsed, w.depth
    FROM walked w LEFT JOIN responses r ON r.url = w.url)""",
     RECORDS.replace("FROM responses", "FROM visits"), SIGNED, FLAGGED,
     hits("records", "target, url, depth", "content"),
     flat("target, url, depth"),
     "read_pages AS (SELECT DISTINCT target, url FROM walked WHERE depth < 2)",
     """side AS (SELECT DISTINCT r.target, l.link AS url, l.disposition FROM read_pages r JOIN links l ON l.url = r.url
    WHERE disposition IN ('external', 'danger'))""",
     """outside AS (SELECT min(target) AS target, url FROM side WHERE disposition = 'external'
    AND url NOT IN (SELECT url FROM walked WHERE depth > 0) GROUP BY url)""",
     "risky AS (SELECT target, url FROM side WHERE disposition = 'danger')"],
    report_of("flagged LEFT JOIN flat USING (target, url, depth)", found=FLAT_COLUMNS, extra="1 AS section, target, ")
    + "\nUNION ALL\n"
    + placeholder(catalog.EXTERNAL, "outside", extra="2 AS section, target, ")
    + "\nUNION ALL\n"
    + f"""SELECT 3 AS section, target, url, {q(catalog.DANGER)}, {q(catalog.DANGER_TITLE)}, 0, {link_type('url')}, '', 0,
    {danger_types('url')}, '1', {danger_types('url')} || ':' || url, {q(catalog.NO)} FROM risky""",
    recursive=True,
)

# Streams

ORACLES["stream_live_rows"] = select(
    [responses(), RECORDS, SIGNED], "SELECT DISTINCT target, signature FROM signed"
)
ORACLES["stream_dup_flag"] = select(
    [responses(), RECORDS, SIGNED],
    "SELECT target, signature, count(*) AS n, count(*) - 1 AS n_duplicates FROM signed GROUP BY target, signature",
)
ORACLES["stream_dup_untargeted"] = select(
    [responses(), RECORDS, SIGNED],
    """SELECT CASE WHEN page_id % 3 <> 0 THEN target END AS target, signature, count(*) AS n, count(*) - 1 AS n_duplicates
    FROM signed GROUP BY ALL""",
)
ORACLES["stream_dup_redirect"] = select(
    [responses(),
     """moved AS (SELECT * REPLACE (CASE WHEN page_id % 10 = 1 THEN '<p>moved</p>' ELSE content END AS content) FROM responses)""",
     f"records AS (SELECT *, {STATUS} AS status, length(content)::INT AS length FROM moved)",
     SIGNED],
    "SELECT signature, count(*) AS n, count(*) - 1 AS n_duplicates FROM signed GROUP BY signature",
)
ORACLES["stream_findings"] = select(
    [hits("documents", "doc_id", "text")], "SELECT doc_id, rule, len(samples)::INT AS count FROM hits"
)
ORACLES["stream_new_links"] = select(
    [RICH, links("rich")], "SELECT DISTINCT link AS url FROM links WHERE disposition = 'keep'"
)
ORACLES["flagship"] = select(
    [RICH, links("rich"), hits("rich", "page_id", "html"),
     "found_rules AS (SELECT page_id, count(*)::INT AS n FROM hits GROUP BY page_id)",
     """found_links AS (SELECT page_id, count(*) FILTER (disposition = 'keep') AS n_keep,
    count(*) FILTER (disposition = 'external') AS n_external, count(*) FILTER (disposition = 'danger') AS n_danger
    FROM links GROUP BY page_id)"""],
    f"""SELECT page_id, url, {title('html')} AS title, length(html)::INT AS length, {link_type('url')} AS link_type,
    coalesce(f.n, 0)::INT AS n_finding_types, coalesce(n_keep, 0) AS n_keep, coalesce(n_external, 0) AS n_external,
    coalesce(n_danger, 0) AS n_danger
    FROM rich LEFT JOIN found_rules f USING (page_id) LEFT JOIN found_links USING (page_id)""",
)
