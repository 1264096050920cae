"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from . import decontaminate as D
from . import secrets as S
from . import url_filter as U


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _templates(table: str, key: str, named: bool) -> str:
    slots = ", ".join(map(_lit, (D.NUMBER, D.NAME, D.UNIT)))
    name = f"WHEN t <> lower(t) THEN {_lit(D.NAME)}" if named else ""
    kind = (
        f"CASE WHEN regexp_matches(t, '^\\p{{Nd}}') THEN {_lit(D.NUMBER)} WHEN lower(t) IN ({', '.join(map(_lit, D.UNITS))}) THEN {_lit(D.UNIT)}"
        f" {name} ELSE lower(t) END"
    )
    return f"""SELECT {key}, tpl, list_transform(range(1, len(raw) + 1), lambda i: CASE WHEN tpl[i] IN ({slots}) THEN tpl[i] || lower(raw[i]) ELSE tpl[i] END) AS val
 FROM (SELECT {key}, raw, list_transform(raw, lambda t: {kind}) AS tpl FROM (SELECT {key}, regexp_extract_all(coalesce(text, ''), {_lit(D.TOKEN)}) AS raw FROM {table}))"""


def _held(named: bool) -> str:
    slots = ", ".join(map(_lit, (D.NUMBER, D.NAME, D.UNIT)))
    barren = f"coalesce(list_bool_or(list_transform(range(0, n - {D.GRAM} + 1), lambda k: list_bool_and(list_transform(span[k + 1:k + {D.GRAM}], lambda t: t IN ({slots}))))), false)"
    cut = lambda key, extra="": f"SELECT {key}, n, tpl[i + 1:i + n] AS span, val[i + 1:i + n] AS vals{extra} FROM (SELECT *, unnest(range(0, len(tpl) - n + 1)) AS i FROM"
    return f"""WITH docs AS ({_templates('documents', 'doc_id', named)}), items AS ({_templates('benchmark', 'item_id', named)}),
b AS (SELECT *, least(len(tpl), {D.SPAN}) AS n, len(tpl) AS item_tokens FROM items WHERE len(tpl) > 0),
bw AS (SELECT *, n < {D.SHORTEST} OR {barren} AS literal FROM ({cut('item_id', ', item_tokens')} b))),
dw AS ({cut('doc_id')} (SELECT docs.*, l.n FROM docs JOIN (SELECT DISTINCT n FROM b) l ON len(tpl) >= l.n AND (l.n >= {D.IN_TEXT} OR len(tpl) = l.n) WHERE doc_id IS NOT NULL)))
SELECT doc_id, item_id, item_tokens FROM dw JOIN bw ON dw.n = bw.n AND dw.span = bw.span
WHERE CASE WHEN literal THEN dw.vals = bw.vals ELSE len(list_distinct(list_zip(dw.vals, bw.vals))) = len(list_distinct(dw.vals)) AND len(list_distinct(dw.vals)) = len(list_distinct(bw.vals)) END"""


def decontamination() -> str:
    return f"SELECT DISTINCT doc_id, item_id, item_tokens FROM (SELECT * FROM ({_held(True)}) UNION ALL SELECT * FROM ({_held(False)}))"


def warc(least: int = 100) -> str:
    return f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= {least} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {least} AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= {least} AND page_id <> first_id THEN first_id END AS refers_to FROM p LEFT JOIN f USING (payload_digest)"""


def secret_scans() -> str:
    parts = []
    for k, r in enumerate(S.RULES):
        re = _lit(r.pattern.replace(r"\x20", " ").replace("*+", "*"))
        holds = f"length(regexp_extract(m, {re}, {r.group})) >= {r.least}" if r.least else "true"
        parts.append(
            f"SELECT doc_id, {k} AS rank, {_lit(r.kind)} AS kind, i, ms[i] AS m, length(ms[i]) AS ml, length(gs[i]) AS gl, {holds.replace('(m,', '(ms[i],')} AS ok FROM"
            f" (SELECT doc_id, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, {re}) AS ms, string_split_regex(t, {re}) AS gs FROM docs))"
        )
    count = lambda k: f"count(*) FILTER (WHERE rank = {k})"
    span = "string_agg(kind || ':' || (e - ml) || ':' || e, ',' ORDER BY e - ml, rank)"
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({' UNION ALL '.join(parts)}),
s AS (SELECT *, sum(gl + ml) OVER (PARTITION BY doc_id, rank ORDER BY i) AS e FROM m),
f AS (SELECT doc_id, {count(0)} AS n_assign, {count(1)} AS n_access, {count(2)} AS n_hex, {span} FILTER (WHERE rank < {S.BASE}) AS base, {span} AS spans FROM s WHERE ok GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN f USING (doc_id)"""


def url_filter() -> str:
    rules = ", ".join(f"({_lit(h)}, {_lit(p)}, {_lit(v)})" for h, p, v in U.RULES)
    return f"""WITH r(h, p, v) AS (VALUES {rules}),
u AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{U._UPPER}', '{U._LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT n, h || p AS rule, v, row_number() OVER (PARTITION BY n ORDER BY length(h) + length(p) DESC, length(h) DESC) AS k FROM s JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, '{U.NO_RULE}') AS verdict FROM s LEFT JOIN (SELECT * FROM f WHERE k = 1) USING (n)"""
