"""DuckDB SQL of operators 11 to 13, from plain patterns and joins."""

from __future__ import annotations

from tramline.llm import collocations, divergence, pii

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b(?:" + "|".join(f"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:[ -]?[0-9A-Z]){{{size - 4}}}" for size, codes in pii.IBAN_LENGTHS.items()) + r")\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "local_phone": r"\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}\b|\b[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}\b",
}
_DIGITS = "regexp_replace(x.m, '[^0-9]', '', 'g')"
_LUHN = (
    f"list_sum(list_transform(range(length({_DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN reverse({_DIGITS})[i + 1]::INT "
    f"ELSE (2 * reverse({_DIGITS})[i + 1]::INT) // 10 + (2 * reverse({_DIGITS})[i + 1]::INT) % 10 END)) % 10 = 0"
)
_ACCOUNT = "regexp_replace(x.m, '[ -]', '', 'g')"
_MOD97 = (
    f"list_reduce(list_transform(string_split({_ACCOUNT}[5:] || {_ACCOUNT}[:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c) - 55 END), "
    "lambda r, v: ((r % 97) * (CASE WHEN v > 9 THEN 100 ELSE 10 END) + v) % 97, 0) = 1"
)
_FITS = {
    "email": "true",
    "ip": "list_max(list_transform(string_split(x.m, '.'), lambda p: CASE WHEN length(ltrim(p, '0')) > 3 THEN 999 ELSE ('0' || ltrim(p, '0'))::INT END)) <= 255",
    "card": f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}",
    "phone": f"length({_DIGITS}) BETWEEN 8 AND 15",
    "iban": _MOD97,
    "ssn": "NOT regexp_matches(x.m, '^(000|666|9)|-00-|-0000$')",
    "local_phone": "true",
}


def _kind_sql(place: int, kind: pii.Kind) -> str:
    text = "x"
    if kind.name == "local_phone":
        phone = _PATTERNS["phone"]
        text = f"array_to_string(list_transform(list_zip(regexp_split_to_array(x, '{phone}'), regexp_extract_all(x, '{phone}')), lambda z: z[1] || repeat('+', coalesce(length(z[2]), 0))), '')"
    words = lambda w, points: f"CASE WHEN regexp_matches(x.about, '\\b(?:{'|'.join(w)})\\b') THEN {points} ELSE 0 END" if w else "0"
    least = 0 if kind in pii.BASE else pii.LEAST_SCORE
    return f"""
SELECT doc_id, row, {place} AS place, '{kind.name}' AS kind, x.a AS a, x.a + length(x.m) AS b FROM (
  SELECT doc_id, row, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
    'm': m[i], 'a': coalesce(list_sum(list_transform(s[1:i], lambda p: length(p))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda p: length(p))), 0),
    'about': translate(right(s[i], {pii.AROUND}) || ' ' || left(s[i + 1], {pii.AROUND}), '{_UPPER}', '{_LOWER}')}})) AS x
  FROM (SELECT doc_id, row, regexp_extract_all(t, '{_PATTERNS[kind.name]}') AS m, regexp_split_to_array(t, '{_PATTERNS[kind.name]}') AS s FROM (SELECT doc_id, row, {text} AS t FROM texts)))
WHERE {_FITS[kind.name]} AND {kind.score} + {words(kind.near, kind.gain)} - {words(kind.against, kind.loss)} >= {least}"""


_BASE = ", ".join(f"'{k.name}'" for k in pii.BASE)
PII_SQL = f"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS x FROM documents),
spans AS ({' UNION ALL '.join(_kind_sql(k, kind) for k, kind in enumerate(pii.KINDS))}),
told AS (SELECT row, {', '.join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in pii.BASE)},
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY place, a) FILTER (kind IN ({_BASE})) AS base,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY place, a) AS spans FROM spans GROUP BY row)
SELECT doc_id, {', '.join(f"coalesce(n_{k.name}, 0)::BIGINT AS n_{k.name}" for k in pii.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN told USING (row)"""

COLLOCATIONS_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
texts AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM texts GROUP BY lang),
runs AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM texts),
f AS (
  SELECT lang, w[i:i + m - 1] AS words, m, count(*) AS f FROM runs, range(1, {collocations.MAX_WORDS + 1}) AS sizes(m) WHERE i + m - 1 <= len(w)
  GROUP BY ALL HAVING count(*) >= {collocations.LEAST}),
held AS (
  SELECT lang, words[i:i + size - 1] AS words, max(f) AS longer FROM (SELECT *, unnest(range(1, m)) AS i FROM f WHERE m > 2), range(2, {collocations.MAX_WORDS}) AS sizes(size)
  WHERE size < m AND i + size - 1 <= m GROUP BY ALL),
kept AS (SELECT f.* FROM f LEFT JOIN held h ON h.lang = f.lang AND h.words = f.words WHERE m > 1 AND (h.longer IS NULL OR 100 * h.longer < {collocations.COVER} * f.f)),
cuts AS (
  SELECT k.lang, k.words, k.f AS a, k.cut, l.f AS l, r.f AS r, ({collocations.SCALE}::HUGEINT * k.f) // (l.f + r.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS cut FROM kept) k JOIN f l ON l.lang = k.lang AND l.words = k.words[1:cut] JOIN f r ON r.lang = k.lang AND r.words = k.words[cut + 1:]),
best AS (SELECT *, array_to_string(words, ' ') AS phrase FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM best JOIN totals USING (lang) QUALIFY rank <= {collocations.TOP}"""

_SHARE = f"1 + ({divergence.UNIT}::HUGEINT * ({{n}} + {divergence.PRIOR})) // ({{size}} + 2 * kept)"
_DIFFER = "((p - q) * (p - q)) // (p + q)"
DIVERGENCE_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
places AS (SELECT DISTINCT lang, source FROM docs),
terms AS (SELECT row, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_n FROM terms GROUP BY lang, term HAVING count(DISTINCT row) >= {divergence.LEAST_DOCS}),
langs AS (SELECT lang, count(*) AS kept, sum(lang_n) AS lang_size FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, source, sum(n) AS size FROM counts GROUP BY ALL),
shares AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, {_SHARE.format(n="coalesce(n, 0)", size="coalesce(size, 0)")} AS p, {_SHARE.format(n="lang_n", size="lang_size")} AS q
  FROM places JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN sizes USING (lang, source) LEFT JOIN counts USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(v.value, 0) AS value FROM places a JOIN places b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT lang, source, item, sum({_DIFFER}) AS value FROM (SELECT x.lang, x.source, y.source AS item, x.p, y.p AS q FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source)
    GROUP BY ALL) v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source),
both_parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, {_DIFFER} FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM both_parts QUALIFY part = 'pair' OR rank <= {divergence.TOP}"""

ORACLE_SQL = {"op11_pii": PII_SQL, "op12_collocations": COLLOCATIONS_SQL, "op13_divergence": DIVERGENCE_SQL}
