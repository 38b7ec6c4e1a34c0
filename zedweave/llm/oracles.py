"""Queries of this package in DuckDB's SQL, where SQL can say what they return."""

from __future__ import annotations

from zedweave.llm import licences, quality

_BLANK = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"


def line_frequency() -> str:
    n = quality.WINDOW
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, source AS host FROM documents),
m AS (SELECT *, regexp_extract_all(t, '{_WORD}+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d),
windows AS (SELECT rid, i, array_to_string(words[i:i + {n - 1}], ' ') AS w FROM (SELECT rid, words, unnest(range(1, len(words) - {n - 2})) AS i FROM m WHERE len(words) >= {n})),
twice AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, w) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range({n}) r(k) GROUP BY rid),
lines AS (SELECT DISTINCT rid, host, t, trim(regexp_replace(lower(x), '{_BLANK}+', ' ', 'g')) AS l FROM (SELECT rid, host, t, unnest(lines) AS x FROM m)),
sized AS (SELECT *, len(string_split(l, ' ')) AS w FROM lines),
often AS (SELECT host, l FROM lines GROUP BY host, l HAVING count(DISTINCT t) >= {quality.LEAST_TEXTS}),
gone AS (SELECT rid, sum(w) AS w, coalesce(sum(w) FILTER (WHERE o.l IS NOT NULL), 0) AS gone
         FROM sized s LEFT JOIN often o ON s.l = o.l AND s.host IS NOT DISTINCT FROM o.host GROUP BY rid),
measured AS (SELECT rid, doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM m LEFT JOIN covered c USING (rid)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(100 * g.gone > {quality.DEPLETED} * g.w, false) AS kept
FROM judged LEFT JOIN gone g USING (rid)"""


def round_trip() -> str:
    # five hexadecimal digits are four digits to base 32
    digit = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(x, CAST(1 + 5 * (k // 4) AS BIGINT), 5) AS BIGINT) // CAST(power(32, 3 - k % 4) AS BIGINT)) % 32) AS BIGINT), 1)"
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda k: {digit}), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""


def licence_index() -> str:
    rows, places = [], []
    for t, n in enumerate(licences._notices(licences.TEMPLATES)):
        rows += [f"({t}, '{n['label']}', {p}, '{w}', {int(p in n['key'])}, {len(n['key'])}, {len(n['words'])})" for p, w in n["words"]]
    for phrase, label in licences.BASE.items():
        w = phrase.split()
        joins = " ".join(f"JOIN hits h{i} ON h{i}.rid = h0.rid AND h{i}.i = h0.i + {i} AND h{i}.w = '{x}'" for i, x in enumerate(w) if i)
        places.append(f"SELECT h0.rid, h0.i AS s, '{label}' AS label FROM hits h0 {joins} WHERE h0.w = '{w[0]}'")
    return rf"""
WITH notices(t, label, p, w, key, keys, size) AS (VALUES {", ".join(rows)}),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licences.UPPER}', '{licences.UPPER.lower()}'), '{licences.WORD}') AS words FROM documents),
spread AS (SELECT rid, unnest(words) AS w, unnest(range(len(words))) AS i FROM d),
hits AS (SELECT * FROM spread WHERE w IN (SELECT w FROM notices) OR w IN ('mit', 'apache', 'general', 'public', 'license')),
held AS (SELECT w, count(DISTINCT rid) AS n FROM hits GROUP BY w),
ranked AS (SELECT t, w, row_number() OVER (PARTITION BY t ORDER BY coalesce(n, 0), w) <= {licences.RARE} AS rare FROM (SELECT DISTINCT t, w FROM notices) LEFT JOIN held USING (w)),
needs AS (SELECT t, least({licences.AGREE}, count(*)) AS need FROM notices JOIN ranked USING (t, w) WHERE rare GROUP BY t),
alignments AS (SELECT rid, t, label, h.i - p AS at, count(*) AS n, sum(key) AS key, sum(CAST(rare AS INT)) AS rare, max(keys) AS keys, max(size) AS size
               FROM hits h JOIN notices USING (w) JOIN ranked USING (t, w) GROUP BY ALL),
found AS (SELECT rid, label, n / size AS score FROM alignments JOIN needs USING (t) WHERE rare >= need AND key >= keys),
places AS ({" UNION ALL ".join(places)}),
base AS (SELECT rid, count(*) AS n, min(s) AS first, max(s) AS last, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY rid),
every AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM (SELECT rid, label, score FROM found UNION ALL SELECT rid, label, NULL FROM places) GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(b.first AS BIGINT) AS first_word, CAST(b.last AS BIGINT) AS last_word,
       coalesce(b.labels, '') AS base_labels, coalesce(e.labels, '') AS labels, CAST(coalesce(e.score, CASE WHEN b.n > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS score
FROM d LEFT JOIN base b USING (rid) LEFT JOIN every e USING (rid)"""
