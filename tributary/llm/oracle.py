"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from . import licenses, secret_scan
from .common import LOWER, UPPER


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def license_scan(k: int = 3, slack: int = 3, gap: int = 6, coverage: float = 0.6, likeness: float = 0.6) -> str:
    rows = [(i, label, i < len(licenses.BASE), phrase) for i, (phrase, label) in enumerate([*licenses.BASE, *licenses.TEMPLATES])]
    values = ", ".join(f"({i}, {_text(label)}, {str(base).lower()}, {_text(phrase)})" for i, label, base, phrase in rows)
    sizes = sorted({min(k, len(r[3].split())) for r in rows})
    leads = ", ".join(f"lead(word, {i}) OVER o AS w{i}" for i in range(1, max(sizes)))
    grams = " UNION ALL ".join(f"SELECT doc_id, pos, {n} AS size, concat_ws(' ', word, {', '.join(f'w{i}' for i in range(1, n))}) AS gram FROM e WHERE w{n - 1} IS NOT NULL" for n in sizes)
    signs = lambda words: f"list_aggregate(list_transform({words}, lambda x: chr(33 + coalesce(list_position(ws, x), 0)::INT)), 'string_agg', '')"
    return f"""WITH t(template, label, is_base, phrase) AS (VALUES {values}),
    tw AS (SELECT *, string_split(phrase, ' ') AS ws FROM t), ts AS (SELECT *, least({k}, len(ws)) AS size FROM tw), tt AS (SELECT *, len(ws) - size + 1 AS total FROM ts),
    tp AS (SELECT *, unnest(range(0, total)) AS tpos FROM tt), g AS (SELECT template, label, is_base, total, size, tpos, array_to_string(ws[tpos + 1 : tpos + size], ' ') AS gram FROM tp),
    d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    u AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM d), e AS (SELECT *, {leads} FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
    x AS ({grams}),
    v AS (SELECT doc_id, template, label, is_base, total, pos, tpos, g.size, pos - tpos AS diagonal FROM x JOIN g ON g.size = x.size AND g.gram = x.gram),
    vd AS (SELECT doc_id, template, label, is_base, total, diagonal, count(*) AS votes, min(pos) AS first, max(pos) + any_value(size) - 1 AS last FROM v GROUP BY ALL),
    o AS (SELECT *, CASE WHEN first - lag(last) OVER r > {gap} OR abs(diagonal - lag(diagonal) OVER r) > {slack} THEN 1 ELSE 0 END AS apart FROM vd WHERE NOT is_base WINDOW r AS (PARTITION BY doc_id, template ORDER BY first, diagonal)),
    n AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY first, diagonal ROWS UNBOUNDED PRECEDING) AS run FROM o),
    m AS (SELECT n.doc_id, n.template, n.run, any_value(n.total) AS total, count(DISTINCT v.tpos) AS votes, min(n.first) AS first, max(n.last) AS last FROM n JOIN v ON v.doc_id = n.doc_id AND v.template = n.template AND v.diagonal = n.diagonal GROUP BY n.doc_id, n.template, n.run),
    s AS (SELECT m.doc_id, tt.label, tt.ws, d.w[m.first + 1 : m.last + 1] AS own FROM m JOIN tt ON tt.template = m.template JOIN d ON d.doc_id = m.doc_id WHERE m.votes >= {coverage} * m.total),
    c AS (SELECT doc_id, label, greatest(0.0::DOUBLE, 1 - levenshtein({signs("own")}, {signs("ws")})::DOUBLE / len(ws)) AS score FROM s),
    b AS (SELECT doc_id, label, diagonal FROM vd WHERE is_base AND votes = total),
    f AS (SELECT doc_id, label, 1.0::DOUBLE AS score FROM b UNION ALL SELECT * FROM c WHERE score >= {likeness}),
    bb AS (SELECT doc_id, count(*) AS n, min(diagonal) AS a, max(diagonal) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM b GROUP BY doc_id),
    ff AS (SELECT doc_id, max(score) AS s, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM f GROUP BY doc_id)
    SELECT d.doc_id, len(w) AS n_words, coalesce(bb.n, 0) AS n_base, bb.a AS first_word, bb.z AS last_word, coalesce(bb.l, '') AS base_labels, coalesce(ff.l, '') AS labels, coalesce(ff.s, 0.0::DOUBLE) AS score
    FROM d LEFT JOIN bb ON bb.doc_id = d.doc_id LEFT JOIN ff ON ff.doc_id = d.doc_id"""


def secret_spans() -> str:
    """Without a text that holds a keyword in other letters than ASCII ones, the two engines' expressions agree."""
    parts = []
    for i, (_, pattern, least) in enumerate(secret_scan.KINDS):
        p = _text(pattern.replace("}+", "}"))
        value = f"regexp_extract(match, {p}, 1)" if i == 0 else "match"
        parts.append(
            f"""SELECT doc_id, source, {i} AS kind, done - length(match) AS start, done AS stop, {value} AS value FROM (SELECT *, sum(length(before) + length(match)) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS done
            FROM (SELECT doc_id, source, unnest(regexp_extract_all(text, {p})) AS match, unnest(string_split_regex(text, {p})[1:len(regexp_extract_all(text, {p}))]) AS before, unnest(range(0, len(regexp_extract_all(text, {p})))) AS n FROM docs)) WHERE length({value}) >= {least}"""
        )
    names = ", ".join(map(_text, secret_scan.NAMES))
    span = f"([{names}])[kind + 1] || ':' || start || ':' || stop"
    return f"""WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents), c AS ({" UNION ALL ".join(parts)}),
    o AS (SELECT value, count(DISTINCT coalesce(source, chr(1))) AS owners, count(DISTINCT doc_id) AS repositories FROM c GROUP BY value),
    live AS (SELECT doc_id, {secret_scan.LIVE} AS kind, stop - length(c.value) AS start, stop FROM c JOIN o ON o.value = c.value WHERE owners <= {secret_scan.MAX_OWNERS} AND repositories <= {secret_scan.MAX_REPOSITORIES} AND regexp_matches(c.value, '[0-9]') AND regexp_matches(c.value, '[A-Za-z]') AND length(c.value) >= 12
      AND len(list_distinct(string_split(c.value, ''))) >= 8 AND NOT regexp_matches(c.value, {_text(secret_scan.EXAMPLES)})),
    b AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, string_agg({span}, ',' ORDER BY start, kind, stop) AS s FROM c WHERE kind < 3 GROUP BY doc_id),
    a AS (SELECT doc_id, string_agg({span}, ',' ORDER BY start, kind, stop) AS s FROM (SELECT DISTINCT doc_id, kind, start, stop FROM c WHERE kind < 3 UNION SELECT DISTINCT doc_id, kind, start, stop FROM live) GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(b.s, '')) AS base_sha256, coalesce(a.s, '') AS spans, coalesce(h.r, 0) AS most_repositories, coalesce(h.o, 0) AS most_owners
    FROM docs d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN a ON a.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, max(repositories) AS r, max(owners) AS o FROM c JOIN o ON o.value = c.value GROUP BY doc_id) h ON h.doc_id = d.doc_id"""


TARGETS = r"""WITH RECURSIVE d AS (SELECT source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_documents, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS k FROM d GROUP BY source),
    w AS (SELECT *, 2.0::DOUBLE * source_size AS cap, [3, 1, 2][(k - 1) % 3 + 1]::DOUBLE AS weight FROM s),
    -- rounds of sharing: who would get more than its limit is full, and the rest is shared again
    r AS (SELECT 0 AS round, k, false AS is_full FROM w
      UNION ALL SELECT round + 1, k, is_full OR level * weight > cap FROM (SELECT r.round, r.k, r.is_full, w.cap, w.weight,
        ((SELECT sum(source_size) * 1.5 FROM w) - coalesce(sum(w.cap) FILTER (r.is_full) OVER (), 0)) / sum(w.weight) FILTER (NOT r.is_full) OVER () AS level FROM r JOIN w ON w.k = r.k) WHERE round < 40),
    l AS (SELECT r.k, r.is_full, ((SELECT sum(source_size) * 1.5 FROM w) - coalesce(sum(w.cap) FILTER (r.is_full) OVER (), 0)) / sum(w.weight) FILTER (NOT r.is_full) OVER () AS level FROM r JOIN w ON w.k = r.k WHERE round = 40)
    SELECT source, source_size, round(CASE WHEN is_full THEN cap ELSE level * weight END, 6) AS target, n_documents, CAST(0 AS BIGINT) AS n_beyond FROM w JOIN l ON l.k = w.k"""

SIZES = f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents)
    SELECT doc_id, CAST(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) < 5 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))) END AS BIGINT) AS n_shingles FROM d"""

PAYLOADS = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), p AS (SELECT *, CAST(greatest(64, (octet_length(b) + 63) // 64 * 64) AS BIGINT) AS n FROM d)
    SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, n AS payload_bytes, sha256(b || repeat('\\x00'::BLOB, n - octet_length(b))) AS payload_sha256 FROM p"""

SQL = {"op3_license_scan": license_scan(), "op7_secret_scan": secret_spans(), "mixing_targets": TARGETS, "ngram_sizes": SIZES, "media_payloads": PAYLOADS}
