"""SQL text of DuckDB expressions for the oracle: URLs and HTML evidence, written against the engine's own functions."""

from __future__ import annotations

PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(u: str, k: int) -> str:
    return rf"regexp_extract(regexp_replace(regexp_replace({u}, '^[\x00-\x20]+', ''), '[\t\r\n]', '', 'g'), '{PARTS}', {k})"


def url_parts(source: str, u: str, keep: str, name: str) -> str:
    """CTEs that give name(keep, s, n, p, q, h, o, ok, canon): scheme, netloc, path, query, host, port, usable, canonical."""
    host = r"regexp_replace(lower(CASE WHEN starts_with(n, '[') THEN regexp_extract(n, '^\[([^\]]*)\]', 1) ELSE regexp_extract(n, '^([^:]*)', 1) END), '\.+$', '')"
    port = r"CASE WHEN starts_with(n, '[') THEN regexp_extract(n, '^\[[^\]]*\]:(.*)$', 1) ELSE regexp_extract(n, '^[^:]*:(.*)$', 1) END"
    ok = r"s IN ('http', 'https') AND NOT contains(n, '@') AND length(h) > 0 AND (contains(h, ':') OR regexp_matches(h, '^[^.]{1,63}(\.[^.]{1,63})*$')) AND (o = '' OR (regexp_matches(o, '^[0-9]{1,9}$') AND try_cast(o AS INT) <= 65535))"
    canon = "s || '://' || CASE WHEN contains(h, ':') THEN '[' || h || ']' ELSE h END || CASE WHEN o = '' OR try_cast(o AS INT) = CASE s WHEN 'https' THEN 443 ELSE 80 END THEN '' ELSE ':' || try_cast(o AS INT)::VARCHAR END || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN q = '' THEN '' ELSE '?' || q END"
    return f"""{name}_1 AS (SELECT {keep}, lower({part(u, 1)}) AS s, {part(u, 2)} AS n, {part(u, 3)} AS p, {part(u, 4)} AS q FROM {source}),
{name}_2 AS (SELECT *, {host} AS h, {port} AS o FROM {name}_1),
{name} AS (SELECT *, {ok} AS ok, CASE WHEN {ok} THEN {canon} END AS canon FROM {name}_2)"""


def resolve(base: str, ref: str) -> str:
    origin = f"{part(base, 1)} || '://' || {part(base, 2)}"
    path = f"CASE WHEN {part(base, 3)} = '' THEN '/' ELSE {part(base, 3)} END"
    query = f"CASE WHEN {part(base, 4)} = '' THEN '' ELSE '?' || {part(base, 4)} END"
    return rf"""CASE WHEN {ref} = '' THEN {base} WHEN regexp_matches({ref}, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN {ref} WHEN starts_with({ref}, '//') THEN {part(base, 1)} || ':' || {ref}
  WHEN starts_with({ref}, '/') THEN {origin} || {ref} WHEN starts_with({ref}, '?') THEN {origin} || {path} || {ref} WHEN starts_with({ref}, '#') THEN {origin} || {path} || {query} || {ref} ELSE {origin} || regexp_replace({path}, '[^/]*$', '') || {ref} END"""


def unescape(t: str) -> str:
    for a, b in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("copy", "©"), ("middot", "·"), ("nbsp", " ")):
        t = f"replace({t}, '&{a};', '{b}')"
    return f"regexp_replace({t}, '&amp;?', '&', 'g')"


def title(h: str) -> str:
    return f"CASE WHEN regexp_matches({h}, '(?is)<title[^>]*>.*?</title>') THEN trim({unescape(f'''regexp_extract({h}, '(?is)<title[^>]*>(.*?)</title>', 1)''')}, ' ') END"


def links(source: str, key: str, h: str, base: str, name: str) -> str:
    """CTEs that give name(key, links): canonical targets in order of first occurrence, for each row of source."""
    raw = f"{name}_a AS (SELECT {key}, {base} AS b, unnest(hs) AS r, generate_subscripts(hs, 1) AS k FROM (SELECT {key}, {base}, regexp_extract_all({h}, '(?is)<a\\s[^>]*?href=\"([^\"]*)\"', 1) AS hs FROM {source}) AS x)"
    led = f"{name}_b AS (SELECT {key}, k, {resolve('b', unescape('r'))} AS u FROM {name}_a WHERE r <> '' AND NOT starts_with(r, '#') AND NOT starts_with(r, 'javascript:') AND NOT starts_with(r, 'mailto:') AND NOT starts_with(r, 'tel:'))"
    return f"""{raw},
{led},
{url_parts(f'{name}_b', 'u', f'{key}, k', f'{name}_c')},
{name}_d AS (SELECT {key}, canon, min(k) AS k FROM {name}_c WHERE ok GROUP BY {key}, canon),
{name}_e AS (SELECT {key}, list(canon ORDER BY k) AS links FROM {name}_d GROUP BY {key}),
{name} AS (SELECT {', '.join(f's.{x.strip()}' for x in key.split(','))}, coalesce(e.links, []::VARCHAR[]) AS links FROM {source} s LEFT JOIN {name}_e e ON {' AND '.join(f's.{x.strip()} = e.{x.strip()}' for x in key.split(','))})"""


def json_list(items: str) -> str:
    return f"'[' || array_to_string(list_transform({items}, lambda x: to_json(x)::VARCHAR), ',') || ']'"


def semantic(title: str, links: str, json_ld: str = "''", malformed: str = "0") -> str:
    """For pages without other structured evidence than JSON-LD, whose canonical payloads are given as text."""
    return f"""sha256('{{"links":' || {json_list(f'list_sort(list_distinct({links}))')} || ',"structured":{{"canonical_url":null,"json_ld":[' || {json_ld} || '],"malformed_json_ld":' || {malformed} || ',"open_graph":{{}}}},"title":' || coalesce(to_json({title})::VARCHAR, 'null') || '}}')"""


KIND = "CASE WHEN status = 304 AND prev_raw IS NULL THEN 'error' WHEN status = 304 THEN 'not_modified' WHEN prev_raw IS NULL THEN 'new' WHEN sem IS DISTINCT FROM prev_sem THEN 'semantic_changed' WHEN raw IS DISTINCT FROM prev_raw THEN 'representation_changed' ELSE 'unchanged' END"


def next_interval(kind: str, previous: str) -> str:
    held = f"CASE WHEN {previous} > 0 THEN {previous} ELSE 86400e0 END"
    return f"CASE {kind} WHEN 'new' THEN 86400e0 WHEN 'not_modified' THEN least(2592000e0, {held} * 2) WHEN 'unchanged' THEN least(2592000e0, {held} * 2) WHEN 'representation_changed' THEN greatest(900e0, least(86400e0, {held})) WHEN 'semantic_changed' THEN 900e0 END"


def fold(kinds_in_order: str) -> str:
    """The interval after a list of kinds; the kinds are numbered, as a reduction keeps one type."""
    number = f"list_transform({kinds_in_order}, lambda x: CASE x WHEN 'new' THEN 0e0 WHEN 'not_modified' THEN 1e0 WHEN 'unchanged' THEN 1e0 WHEN 'representation_changed' THEN 2e0 ELSE 3e0 END)"
    held = "CASE WHEN a > 0 THEN a ELSE 86400e0 END"
    return f"list_reduce({number}, lambda a, x: CASE x WHEN 0 THEN 86400e0 WHEN 1 THEN least(2592000e0, {held} * 2) WHEN 2 THEN greatest(900e0, least(86400e0, {held})) ELSE 900e0 END, 0e0)"


def observed(name: str = "obs") -> str:
    """CTEs that give name(page_id, url, k, observed_at, status, raw, sem, prev_raw, prev_sem, kind) of the relation log."""
    return f"""{links('log', 'page_id, k', 'html', 'url', 'lk')},
{name}_f AS (SELECT l.page_id, l.url, l.k, l.observed_at, l.status, sha256(l.html) AS raw, CASE WHEN l.html IS NOT NULL THEN {semantic(title('l.html'), 'x.links')} END AS sem FROM log l JOIN lk x ON x.page_id = l.page_id AND x.k = l.k),
{name}_p AS (SELECT *, last_value(raw IGNORE NULLS) OVER w AS prev_raw, last_value(sem IGNORE NULLS) OVER w AS prev_sem FROM {name}_f WINDOW w AS (PARTITION BY page_id ORDER BY observed_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name} AS (SELECT *, {KIND} AS kind FROM {name}_p)"""
