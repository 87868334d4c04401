"""DuckDB SQL for the registered queries, built from common table expressions."""

from __future__ import annotations

from tidemark.functions.alternative import ALIAS, DOMAIN, NOISE, SUFFIX_CODES
from tidemark.functions.alternative import ADDRESS_WORDS as ALT_ADDRESS_WORDS
from tidemark.functions.text import ADDRESS_WORDS, SUFFIX_PATTERN


def _q(s: str) -> str:
    return s.replace("'", "''")


def _map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{_q(k)}': '{_q(v)}'" for k, v in table.items()) + "}"


def _words(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda x: x <> '')"


_FOLDED = "lower(strip_accents(replace(replace(replace({c}, 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae')))"
_NORM = r"trim(regexp_replace(regexp_replace(" + _FOLDED + r", '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"

BED = r"""
bed0 AS (SELECT doc_id, lang, string_split(trim(lower(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g'))), ' ') t FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL),
bed1 AS (SELECT doc_id, lang, t[1:5] n, array_to_string(t[6:20], ' ') rest, array_to_string(t[1:5], ' ') sig FROM bed0),
bed2 AS (SELECT *, row_number() OVER (PARTITION BY lang, sig ORDER BY doc_id) rn, count(*) OVER (PARTITION BY lang, sig) n_same, min(doc_id) OVER (PARTITION BY lang, sig) first_id FROM bed1),
bed3 AS (SELECT *, CASE WHEN rn = 1 AND (n_same > 1 OR doc_id % 5 <> 0) THEN 'S1' WHEN doc_id % 2 = 0 THEN 'S2' ELSE 'S3' END source FROM bed2),
bed AS (SELECT source || '-' || doc_id AS entity_id, lang AS country, source,
  CASE WHEN source = 'S1' THEN sig || CASE doc_id % 4 WHEN 0 THEN ' GmbH' WHEN 1 THEN ' Ltd.' WHEN 2 THEN ', Inc' ELSE '' END
       WHEN doc_id % 3 = 0 THEN array_to_string(list_concat(n[1:1], n[3:5]), ' ') ELSE sig END AS business_name,
  length(sig) || ' ' || CASE WHEN rest = '' THEN '' ELSE rest END || ' ' || (10000 + length(rest) * 37 % 80000) AS business_address,
  CASE WHEN source <> 'S1' AND n_same > 1 THEN 'S1-' || first_id END AS truth_id FROM bed3),
truth AS (SELECT truth_id AS source1_entity_id, entity_id AS candidate_entity_id FROM bed WHERE truth_id IS NOT NULL)"""

NORM = f"""
norm0 AS (SELECT entity_id, country, source, business_name AS name_raw, business_address AS address_raw, {_NORM.format(c="business_name")} AS name_norm, {_NORM.format(c="business_address")} AS address_plain FROM bed),
norm1 AS (SELECT *, trim(regexp_replace(regexp_replace(name_norm, '{SUFFIX_PATTERN}', ' ', 'g'), '\\s+', ' ', 'g')) AS core0,
  array_to_string(list_sort(list_distinct(regexp_extract_all(name_norm, '{SUFFIX_PATTERN}'))), ' ') AS legal_suffix,
  array_to_string(list_transform({_words("address_plain")}, lambda x: coalesce({_map(ADDRESS_WORDS)}[x], x)), ' ') AS address_norm FROM norm0),
norm2 AS (SELECT *, CASE WHEN core0 = '' THEN name_norm ELSE core0 END AS name_core FROM norm1),
norm AS (SELECT entity_id, country, source, name_raw, name_norm, name_core, legal_suffix, array_to_string(list_sort(list_distinct({_words("name_core")})), '|') AS name_tokens, name_norm AS name_transliterated,
  regexp_matches(name_raw, '[^\\x00-\\x7F]') AS is_non_latin, address_raw, address_norm,
  array_to_string(list_filter({_words("address_norm")}, lambda x: regexp_matches(x, '[0-9]')), '|') AS address_numbers,
  coalesce(regexp_extract_all(address_norm, '\\b\\d{{5,6}}\\b')[-1], '') AS address_pin FROM norm2),
s1 AS (SELECT * FROM norm WHERE source = 'S1'), gal AS (SELECT * FROM norm WHERE source <> 'S1')"""

_CONTRACT = "entity_id, country, name_raw, name_norm, name_core, legal_suffix, name_tokens, name_transliterated, is_non_latin, address_raw, address_norm, address_numbers, address_pin"

_KEYS = """
  SELECT country, entity_id, 8 leg, 1 kind, CASE WHEN length(name_core) >= 3 THEN name_core ELSE '' END AS key FROM norm
  UNION ALL SELECT country, entity_id, 8, 2, CASE WHEN fn <> '' AND length(name_core) >= 3 THEN name_core || '|' || fn ELSE '' END FROM kn
  UNION ALL SELECT country, entity_id, 8, 3, CASE WHEN length(name_tokens) >= 3 THEN name_tokens ELSE '' END FROM norm
  UNION ALL SELECT country, entity_id, 8, 4, CASE WHEN len(list_filter(string_split(name_tokens, '|'), lambda x: x <> '')) >= 2 THEN array_to_string(list_transform(list_filter(string_split(name_tokens, '|'), lambda x: x <> ''), lambda x: x[1]), '') ELSE '' END FROM norm
  UNION ALL SELECT country, entity_id, 4, 5, CASE WHEN length(address_norm) >= 12 THEN address_norm ELSE '' END FROM norm
  UNION ALL SELECT country, entity_id, 4, 6, CASE WHEN fn <> '' AND aw <> '' THEN fn || '|' || aw ELSE '' END FROM kn
  UNION ALL SELECT country, entity_id, 16, 7, CASE WHEN regexp_matches(address_pin, '^[0-9]{5,6}$') THEN address_pin ELSE '' END FROM norm"""

KEYS = f"""
kn AS (SELECT *, coalesce(string_split(address_numbers, '|')[1], '') AS fn, array_to_string(({_words("address_norm")})[1:2], ' ') AS aw FROM norm),
keys AS (SELECT * FROM ({_KEYS}) WHERE key <> ''),
gkeys AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country, kind, key ORDER BY entity_id) r, count(*) OVER (PARTITION BY country, kind, key) c FROM keys WHERE entity_id NOT LIKE 'S1-%') WHERE c <= 200 AND r <= 30),
kpairs AS (SELECT country, s1, g, leg FROM (SELECT q.country, q.entity_id s1, k.entity_id g, q.leg, row_number() OVER (PARTITION BY q.country, q.entity_id, q.leg ORDER BY q.kind, k.kind, k.entity_id) r
  FROM keys q JOIN gkeys k ON q.country = k.country AND q.leg = k.leg AND q.key = k.key WHERE q.entity_id LIKE 'S1-%') WHERE r <= 30)"""


def _tfidf(p: str, terms: str, frac: float | None, min_df: int) -> str:
    """frac: the share of gallery records that a term may be in; None for terms of any."""
    most = "" if frac is None else f"df <= CASE WHEN n <= 1000 THEN n ELSE greatest(2, least(floor(n * {frac}), 10000)) END AND "
    return f"""
{p}c AS (SELECT country, entity_id, source, term, count(*) tf FROM (SELECT country, entity_id, source, unnest({terms}) term FROM norm) GROUP BY ALL),
{p}n AS (SELECT country, count(*) n FROM gal GROUP BY 1),
{p}t AS (SELECT d.country, d.term, ln((1 + n) / (1 + df)) + 1 idf FROM (SELECT country, term, count(*) df FROM {p}c WHERE source <> 'S1' GROUP BY ALL) d JOIN {p}n USING (country)
  WHERE {most}df >= CASE WHEN n > 100 THEN {min_df} ELSE 1 END),
{p}r AS (SELECT c.country, entity_id, source, c.term, (1 + ln(tf)) * idf w FROM {p}c c JOIN {p}t t ON c.country = t.country AND c.term = t.term),
{p}w AS (SELECT country, entity_id, source, term, w / sqrt(sum(w * w) OVER (PARTITION BY country, entity_id)) w FROM {p}r),
{p}d AS (SELECT a.country, a.entity_id s1, b.entity_id g, round(sum(a.w * b.w), 9) cos FROM {p}w a JOIN {p}w b ON a.country = b.country AND a.term = b.term WHERE a.source = 'S1' AND b.source <> 'S1' GROUP BY ALL)"""


WORD, ALL_WORDS = (_tfidf("w", f"list_concat({_words('name_norm')}, {_words('address_norm')})", frac, 1) for frac in (0.02, None))
_NOSPACE = "replace(name_norm, ' ', '')"
CHAR = _tfidf("c", f"list_concat(list_transform(range(1, length({_NOSPACE}) - 1), lambda i: substring({_NOSPACE}, i, 3)), list_transform(range(1, length({_NOSPACE}) - 2), lambda i: substring({_NOSPACE}, i, 4)))", 0.01, 2)

CAND = """
legs AS (SELECT country, s1, g, leg FROM kpairs
  UNION ALL SELECT country, s1, g, 1 FROM (SELECT *, row_number() OVER (PARTITION BY country, s1 ORDER BY cos DESC, g) r FROM wd WHERE cos > 0.15) WHERE r <= 40
  UNION ALL SELECT country, s1, g, 2 FROM (SELECT *, row_number() OVER (PARTITION BY country, s1 ORDER BY cos DESC, g) r FROM cd WHERE cos > 0.30) WHERE r <= 40
  UNION ALL SELECT country, s1, g, 128 FROM (SELECT *, row_number() OVER (PARTITION BY country, g ORDER BY cos DESC, s1) r FROM wd WHERE cos > 0.30) WHERE r <= 3),
uni AS (SELECT country, s1, g, bit_or(leg) legs FROM legs GROUP BY ALL),
sc AS (SELECT u.*, coalesce(w.cos, 0) word_cos, coalesce(c.cos, 0) char_cos, round(coalesce(w.cos, 0) + coalesce(c.cos, 0) + 0.25 * ((legs & 8 > 0)::INT + (legs & 4 > 0)::INT + (legs & 16 > 0)::INT) + 0.15 * (legs & 128 > 0)::INT, 9) score
  FROM uni u LEFT JOIN wd w ON u.s1 = w.s1 AND u.g = w.g LEFT JOIN cd c ON u.s1 = c.s1 AND u.g = c.g),
cand AS (SELECT s1 AS source1_entity_id, g AS candidate_entity_id, g[1:2] AS candidate_source, country, legs & 1 > 0 AS name_tfidf_block_hit, legs & 2 > 0 AS char_ngram_block_hit, legs & 4 > 0 AS address_block_hit, legs & 8 > 0 AS exact_key_hit,
  legs & 16 > 0 AS pin_block_hit, legs & 32 > 0 AS phonetic_block_hit, legs & 64 > 0 AS embedding_block_hit, legs & 128 > 0 AS bidirectional_block_hit, bit_count(legs)::BIGINT AS num_legs_retrieved, score AS blocking_score
  FROM (SELECT *, row_number() OVER (PARTITION BY country, s1 ORDER BY score DESC, g) r FROM sc) WHERE r <= 30)"""
PROB = """
pr AS (SELECT source1_entity_id, candidate_entity_id, country, blocking_score, round(least(blocking_score / 3.5, 0.99), 6) prob FROM cand)"""


def _select(formula: str = "expected", floor: float = 0.0, name: str = "sel", source: str = "pr") -> str:
    rest, none = ("cum", "0.0") if formula == "pdf" else ("total", "round(ef0, 12)")
    return f"""
{name}a AS (SELECT *, row_number() OVER (PARTITION BY source1_entity_id ORDER BY prob DESC, candidate_entity_id) k, sum(prob) OVER (PARTITION BY source1_entity_id ORDER BY prob DESC, candidate_entity_id ROWS UNBOUNDED PRECEDING) cum,
  sum(prob) OVER (PARTITION BY source1_entity_id) total, product(1 - prob) OVER (PARTITION BY source1_entity_id) ef0 FROM {source} WHERE prob >= {floor}),
{name}b AS (SELECT *, round(1.25 * cum / (k + 0.25 * {rest}), 12) ef, {none} none FROM {name}a),
{name}c AS (SELECT source1_entity_id s, arg_min(k, (-ef, k)) best_k, max(ef) best_ef FROM (SELECT source1_entity_id, k, ef FROM {name}b) GROUP BY 1),
{name} AS (SELECT b.* FROM {name}b b JOIN {name}c c ON b.source1_entity_id = c.s WHERE best_ef > none AND k <= best_k)"""


def _exclusive(name: str, source: str, order: str = "source1_entity_id") -> str:
    return f"""
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_entity_id ORDER BY prob DESC, {order}) xr FROM {source}) WHERE xr = 1)"""


def _f05(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> str:
    return f"CASE WHEN {tp} + {fn} = 0 THEN CASE WHEN {fp} = 0 THEN 1.0 ELSE 0.0 END WHEN {tp} = 0 THEN 0.0 ELSE 1.25 * {tp} / (1.25 * {tp} + 0.25 * {fn} + {fp}) END"


def _macro(source: str, extra: str = "") -> str:
    return f"""SELECT {extra} count(*) AS entities, round(avg({_f05()}), 6) AS macro_f05 FROM (
  SELECT e.entity_id, count(CASE WHEN p.c IS NOT NULL AND t.c IS NOT NULL THEN 1 END) tp, count(CASE WHEN p.c IS NOT NULL AND t.c IS NULL THEN 1 END) fp, count(CASE WHEN p.c IS NULL AND t.c IS NOT NULL THEN 1 END) fn FROM s1 e
  LEFT JOIN (SELECT source1_entity_id s, candidate_entity_id c FROM {source} UNION SELECT * FROM truth) u ON u.s = e.entity_id
  LEFT JOIN (SELECT DISTINCT source1_entity_id s, candidate_entity_id c FROM {source}) p ON p.s = u.s AND p.c = u.c LEFT JOIN (SELECT DISTINCT source1_entity_id s, candidate_entity_id c FROM truth) t ON t.s = u.s AND t.c = u.c GROUP BY 1)"""


_VARIANTS = (("alpha1.0", 1.0, 0.0, "expected"), ("alpha0.53", 0.53, 0.0, "expected"), ("alpha0.7_floor0.3_pdf", 0.7, 0.3, "pdf"))


def _summary(source: str) -> str:
    return f"""SELECT count(*) AS entities, coalesce(sum(n), 0)::BIGINT AS matches, round(avg(n), 6) AS matches_per_entity, count(CASE WHEN n = 0 THEN 1 END) AS singletons, round(avg((n = 0)::INT), 6) AS singleton_rate
  FROM (SELECT e.entity_id, count(DISTINCT candidate_entity_id) n FROM s1 e LEFT JOIN {source} ON source1_entity_id = e.entity_id GROUP BY 1)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


ALL = (BED, NORM, KEYS, WORD, CHAR, CAND)
_ALT_TOKENS = "list_filter(string_split(regexp_replace(regexp_replace(replace(replace({c}, '''', ''), '&', ' and '), '\\bn\\s*/\\s*a\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '' AND x NOT IN (" + ", ".join(f"'{x}'" for x in NOISE) + "))"
_SUFFIXES = ", ".join(f"'{x}'" for x in SUFFIX_CODES)
_ALT = f"""
alt0 AS (SELECT entity_id, {_FOLDED.format(c="business_name || CASE WHEN source = 'S2' THEN ' aka ' || country || ' pvt' ELSE '' END")} f FROM bed),
alt1 AS (SELECT entity_id, f, regexp_replace(f, '{ALIAS}.*$', '') left_part, CASE WHEN regexp_matches(f, '{ALIAS}') THEN regexp_replace(f, '^.*?{ALIAS}', '') END right_part FROM alt0),
alt2 AS (SELECT entity_id, CASE WHEN trim(left_part) <> '' AND trim(right_part) <> '' THEN right_part ELSE f END prim, CASE WHEN trim(left_part) <> '' AND trim(right_part) <> '' THEN left_part ELSE '' END ali FROM alt1),
alt3 AS (SELECT entity_id, {_ALT_TOKENS.format(c="prim")} toks, list_filter({_ALT_TOKENS.format(c="ali")}, lambda x: x NOT IN ({_SUFFIXES})) ali FROM alt2),
alt4 AS (SELECT *, CASE WHEN len(list_filter(toks, lambda x: x NOT IN ({_SUFFIXES}))) = 0 THEN toks ELSE list_filter(toks, lambda x: x NOT IN ({_SUFFIXES})) END core FROM alt3)"""
_FLAG_PAIRS = "SELECT c.*, {cols} FROM cand c JOIN norm a ON a.entity_id = c.source1_entity_id JOIN norm b ON b.entity_id = c.candidate_entity_id"
_SCORED = "(SELECT doc_id, quality AS label, (doc_id * 7919 % 1000) / 1000.0 * 0.5 + quality * 0.3 AS prob FROM labels)"
_SETS = lambda c: (f"list_distinct({_words(f'a.{c}')})", f"list_distinct({_words(f'b.{c}')})")


def _jaccard(c: str) -> str:
    x, y = _SETS(c)
    return f"CASE WHEN len(list_distinct(list_concat({x}, {y}))) = 0 THEN 0.0 ELSE len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y}))) END"


def _overlap(c: str) -> str:
    x, y = _SETS(c)
    return f"CASE WHEN least(len({x}), len({y})) = 0 THEN 0.0 ELSE len(list_intersect({x}, {y})) / least(len({x}), len({y})) END"


_HOUSE = "coalesce(string_split({t}.address_numbers, '|')[1], '')"
_CROSS = "SELECT orderkey, linenumber, x * y AS product, x + y AS total, least(x, y) AS low, greatest(x, y) AS high, (x > 0.8 AND y < 0.5)::DOUBLE AS high_low, (x < 0.5 AND y > 0.8)::DOUBLE AS low_high, abs(x - y) AS diff, round(2 * x * y / (x + y + 1e-6), 9) AS harmonic"

ORACLE_SQL: dict[str, str] = {
    "matching_results": _with(*ALL, PROB, _select(), _exclusive("ex", "sel")) + " SELECT entity_id AS source1_entity_id, coalesce(m, '') AS matched_entity_ids FROM s1 LEFT JOIN (SELECT source1_entity_id s, string_agg(DISTINCT candidate_entity_id, ',' ORDER BY candidate_entity_id) m FROM ex GROUP BY 1) ON s = entity_id",
    "candidate_pairs": _with(*ALL) + " SELECT entity_id AS source1_entity_id, coalesce(m, '') AS candidate_entity_ids FROM s1 LEFT JOIN (SELECT source1_entity_id s, string_agg(candidate_entity_id, ',' ORDER BY blocking_score DESC, candidate_entity_id) m FROM cand GROUP BY 1) ON s = entity_id",
    "normalize_records": _with(BED, NORM) + f" SELECT {_CONTRACT} FROM norm",
    "legal_suffix_core": f"WITH p AS (SELECT p_partkey, lower(p_name) || ' ' || (['pvt ltd', 'gmbh', '', 'company inc', 'private limited', 'co'])[p_partkey % 6 + 1] AS name FROM part) SELECT p_partkey, trim(regexp_replace(regexp_replace(name, '{SUFFIX_PATTERN}', ' ', 'g'), '\\s+', ' ', 'g')) AS name_core, array_to_string(list_sort(list_distinct(regexp_extract_all(name, '{SUFFIX_PATTERN}'))), ' ') AS legal_suffix FROM p",
    "address_normalize_numbers_pin": _with(BED, NORM) + " SELECT entity_id, address_norm, address_numbers, address_pin FROM norm",
    "alt_name_views": _with(BED, _ALT) + f" SELECT entity_id, array_to_string(core, ' ') AS name_core, array_to_string(toks, ' ') AS name_norm, array_to_string(list_sort(list_distinct(list_transform(list_filter(toks, lambda x: x IN ({_SUFFIXES})), lambda x: {_map(SUFFIX_CODES)}[x]))), ' ') AS name_suffix, array_to_string(core, '') AS name_nospace, array_to_string(list_sort(core), ' ') AS name_sorted, array_to_string(ali, ' ') AS name_alt FROM alt4",
    "domain_names": f"WITH p AS (SELECT page_id, lower(regexp_extract(url, '^(https?://[^/]+)', 1)) AS site FROM pages) SELECT page_id, replace(regexp_extract(site, '{DOMAIN}', 1), '-', '') AS host, (regexp_extract(site, '{DOMAIN}', 1) <> '')::INT AS is_domain FROM p",
    "alt_address_parts": _with(BED) + f""", a0 AS (SELECT entity_id, list_filter(regexp_split_to_array(business_address || ' ' || (['5th ave', 'apt 12b', 'nr rd', ''])[length(entity_id) % 4 + 1], '[\\s,;|/\\\\()\\[\\]{{}}]+'), lambda x: x <> '' AND NOT regexp_matches(x, '[^\\x00-\\x7F]')) p FROM bed),
  a1 AS (SELECT entity_id, list_transform({_ALT_TOKENS.format(c="lower(array_to_string(p, ' '))")}, lambda x: regexp_replace(x, '^(\\d+)(st|nd|rd|th)$', '\\1')) t FROM a0),
  a2 AS (SELECT entity_id, list_transform(t, lambda x: coalesce({_map(ALT_ADDRESS_WORDS)}[x], x)) t FROM a1),
  a3 AS (SELECT *, list_filter(t, lambda x: regexp_matches(x, '^[0-9]')) n FROM a2),
  a4 AS (SELECT *, coalesce(list_filter(n, lambda x, i: regexp_matches(x, '^[0-9]{{6}}$') OR (regexp_matches(x, '^[0-9]{{5}}$') AND i > 1))[1], '') postcode FROM a3)
  SELECT entity_id, array_to_string(t, ' ') AS addr_norm, coalesce(regexp_extract(list_filter(n, lambda x: x <> postcode)[1], '^[0-9]+'), '') AS house_no, postcode,
  array_to_string(list_sort(list_distinct(flatten(list_transform(t, lambda x: regexp_extract_all(x, '[0-9]+'))))), ' ') AS addr_nums,
  CASE WHEN len(n) = 0 THEN '' ELSE coalesce(list_filter(t[list_position(t, n[1]) + 1:], lambda x: regexp_matches(x, '^[a-z]{{3,}}$'))[1], '') END AS street, len(t)::SMALLINT AS addr_ntok FROM a4""",
    "block_exact_keys": _with(BED, NORM, KEYS) + " SELECT DISTINCT country, s1, g FROM kpairs WHERE leg = 8",
    "block_address_keys": _with(BED, NORM, KEYS) + " SELECT DISTINCT country, s1, g FROM kpairs WHERE leg = 4",
    "block_pin_key": _with(BED, NORM, KEYS) + " SELECT DISTINCT country, s1, g FROM kpairs WHERE leg = 16",
    "block_word_tfidf_topn": _with(BED, NORM, ALL_WORDS) + " SELECT country, s1, g, round(cos + 1e-10, 6) AS cos, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY country, s1 ORDER BY cos DESC, g) r FROM wd WHERE cos > 0.15) WHERE r <= 40",
    "block_char_tfidf_topn": _with(BED, NORM, CHAR) + " SELECT country, s1, g, round(cos + 1e-10, 6) AS cos, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY country, s1 ORDER BY cos DESC, g) r FROM cd WHERE cos > 0.30) WHERE r <= 40",
    "block_bidirectional": _with(BED, NORM, WORD) + " SELECT country, s1, g, round(cos + 1e-10, 6) AS cos, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY country, g ORDER BY cos DESC, s1) r FROM wd WHERE cos > 0.30) WHERE r <= 3",
    "candidate_union_score": _with(*ALL) + " SELECT * REPLACE (round(blocking_score + 1e-10, 6) AS blocking_score) FROM cand",
    "candidates_cap_check": _with(*ALL) + " SELECT 'too_many' AS rule, count(*) AS violations FROM (SELECT source1_entity_id FROM cand GROUP BY 1 HAVING count(*) > 30) UNION ALL SELECT 'repeated_pair', count(*) FROM (SELECT 1 FROM cand GROUP BY source1_entity_id, candidate_entity_id HAVING count(*) > 1) UNION ALL SELECT 'missing_columns', 0",
    "adaptive_k": _with(*ALL) + " SELECT source1_entity_id, candidate_entity_id, round(blocking_score + 1e-10, 6) AS blocking_score FROM (SELECT *, row_number() OVER (PARTITION BY source1_entity_id ORDER BY blocking_score DESC, candidate_entity_id) r, max(blocking_score) OVER (PARTITION BY source1_entity_id) m FROM cand) WHERE r <= 30 AND (r <= 5 OR blocking_score >= m - (0.1 + 1e-9))",
    "sibling_expansion": _with(*ALL) + f""", sk AS (SELECT country, entity_id g, array_to_string(list_sort(list_distinct(list_filter(string_split(address_numbers, '|'), lambda x: regexp_matches(x, '^[0-9]+$')))), '|') key FROM gal),
  sb AS (SELECT * FROM sk WHERE key <> '' AND (country, key) IN (SELECT country, key FROM sk WHERE key <> '' GROUP BY ALL HAVING count(*) <= 100))
  SELECT DISTINCT c.country, c.source1_entity_id AS s1, sb.g FROM cand c JOIN sk ON sk.g = c.candidate_entity_id AND sk.country = c.country JOIN sb ON sb.country = sk.country AND sb.key = sk.key
  WHERE c.blocking_score >= 1.5 AND NOT EXISTS (SELECT 1 FROM cand d WHERE d.source1_entity_id = c.source1_entity_id AND d.candidate_entity_id = sb.g)""",
    "blocking_recall_rollup": _with(*ALL) + " SELECT h.country, truth_pairs, hits, round(hits / truth_pairs, 6) AS recall, round(a, 6) AS avg_candidates, m AS max_candidates FROM (SELECT s1.country, count(*) truth_pairs, count(c.candidate_entity_id) hits FROM truth t JOIN s1 ON s1.entity_id = t.source1_entity_id LEFT JOIN cand c ON c.source1_entity_id = t.source1_entity_id AND c.candidate_entity_id = t.candidate_entity_id GROUP BY ROLLUP (s1.country)) h LEFT JOIN (SELECT country, avg(n) a, max(n) m FROM (SELECT country, source1_entity_id, count(*) n FROM cand GROUP BY ALL) GROUP BY ROLLUP (country)) e ON h.country IS NOT DISTINCT FROM e.country",
    "recall_at_k": _with(*ALL) + ", rk AS (SELECT t.*, r FROM truth t LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY source1_entity_id ORDER BY blocking_score DESC, candidate_entity_id) r FROM cand) c USING (source1_entity_id, candidate_entity_id)) SELECT k::INT AS k, count(CASE WHEN r <= k THEN 1 END) AS hits, round(count(CASE WHEN r <= k THEN 1 END) / count(*), 6) AS recall FROM rk, (SELECT unnest([1, 5, 10, 30]) k) GROUP BY k",
    "leg_hit_rates": _with(*ALL) + " SELECT r <= 5 AS near_top, count(*) AS n, " + ", ".join(f"round(avg({c}::INT), 6) AS {c}" for c in ("name_tfidf_block_hit", "char_ngram_block_hit", "address_block_hit", "exact_key_hit", "pin_block_hit", "phonetic_block_hit", "embedding_block_hit", "bidirectional_block_hit")) + " FROM (SELECT *, row_number() OVER (PARTITION BY source1_entity_id ORDER BY blocking_score DESC, candidate_entity_id) r FROM cand) GROUP BY 1",
    "token_set_similarities": _with(*ALL) + f" SELECT source1_entity_id, candidate_entity_id, round({_jaccard('name_norm')}, 6) AS token_jaccard, round({_overlap('name_norm')}, 6) AS token_overlap, abs(length(a.name_norm) - length(b.name_norm))::DOUBLE AS length_diff, round(CASE WHEN greatest(length(a.name_norm), length(b.name_norm)) = 0 THEN 1.0 ELSE least(length(a.name_norm), length(b.name_norm)) / greatest(length(a.name_norm), length(b.name_norm)) END, 6) AS length_ratio FROM cand c JOIN norm a ON a.entity_id = source1_entity_id JOIN norm b ON b.entity_id = candidate_entity_id",
    "jaro_winkler": _with(*ALL) + " SELECT source1_entity_id, candidate_entity_id, round(jaro_winkler_similarity(a.name_core, b.name_core), 6) AS jaro_winkler FROM cand c JOIN norm a ON a.entity_id = source1_entity_id JOIN norm b ON b.entity_id = candidate_entity_id WHERE a.name_core <> '' AND b.name_core <> ''",
    "embedding_cosine_topn": "SELECT query_id, near_id, cos, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, near_id) rank FROM (SELECT a.vec_id query_id, b.vec_id near_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) cos FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)) WHERE rank <= 5",
    "house_pin_flags": _with(*ALL) + " " + _FLAG_PAIRS.replace("c.*, ", "source1_entity_id, candidate_entity_id, ").format(cols=f"({_HOUSE.format(t='a')} = {_HOUSE.format(t='b')} AND {_HOUSE.format(t='a')} <> '')::DOUBLE AS house_number_exact, ({_HOUSE.format(t='a')} <> {_HOUSE.format(t='b')} AND {_HOUSE.format(t='a')} <> '' AND {_HOUSE.format(t='b')} <> '')::DOUBLE AS house_number_conflict, (a.address_pin = b.address_pin AND a.address_pin <> '')::DOUBLE AS pin_exact, (a.legal_suffix <> b.legal_suffix AND a.legal_suffix <> '' AND b.legal_suffix <> '')::DOUBLE AS suffix_conflict"),
    "numeric_conflict": _with(*ALL) + " " + _FLAG_PAIRS.replace("c.*, ", "source1_entity_id, candidate_entity_id, ").format(cols="(len(regexp_extract_all(a.name_raw || ' ' || a.address_raw, '\\d+')) > 0 AND len(regexp_extract_all(b.name_raw || ' ' || b.address_raw, '\\d+')) > 0 AND NOT list_has_any(regexp_extract_all(a.name_raw || ' ' || a.address_raw, '\\d+'), regexp_extract_all(b.name_raw || ' ' || b.address_raw, '\\d+')))::DOUBLE AS numeric_conflict"),
    "cross_features": _CROSS + " FROM (SELECT l_orderkey orderkey, l_linenumber linenumber, round(l_quantity / 50, 6) x, l_discount * 10 y FROM lineitem)",
    "competition_features": _with(*ALL) + " SELECT source1_entity_id, candidate_entity_id, row_number() OVER (PARTITION BY source1_entity_id ORDER BY blocking_score DESC, candidate_entity_id)::DOUBLE AS comp__rank, round((rank() OVER (PARTITION BY source1_entity_id ORDER BY blocking_score) + (count(*) OVER (PARTITION BY source1_entity_id, blocking_score) - 1) / 2) / count(*) OVER (PARTITION BY source1_entity_id) + 1e-10, 6) AS comp__score_percentile, round(max(blocking_score) OVER (PARTITION BY source1_entity_id) - blocking_score + 1e-10, 6) AS comp__score_gap_top1, round(CASE WHEN max(blocking_score) OVER (PARTITION BY candidate_entity_id) > 0 THEN blocking_score / max(blocking_score) OVER (PARTITION BY candidate_entity_id) ELSE 1.0 END + 1e-10, 6) AS comp__g_best_ratio, rank() OVER (PARTITION BY candidate_entity_id ORDER BY blocking_score DESC)::DOUBLE AS comp__g_rank FROM cand",
    "hard_vetoes": "SELECT l_orderkey, l_linenumber, CASE WHEN (l_linenumber = 1 AND l_discount * 10 < 0.30) OR ((SELECT max(abs(l_tax)) > 0 FROM lineitem) AND round(l_quantity / 50, 6) < 0.30 AND l_tax * 10 < 0.40) THEN 0.0 ELSE 0.9 END AS prob FROM lineitem",
    "prior_shift": "SELECT l_orderkey, l_linenumber, round(1.5 * p / (1.5 * p + 1 - p), 9) AS prob FROM (SELECT *, l_discount * 9 p FROM lineitem)",
    "select_expected_f05": _with(*ALL, PROB, _select()) + " SELECT source1_entity_id, candidate_entity_id, prob FROM sel",
    "select_pdf": _with(*ALL, PROB, _select("pdf", 0.2)) + " SELECT source1_entity_id, candidate_entity_id, prob FROM sel",
    "exclusivity": _with(*ALL, PROB, _exclusive("ex", "pr"), _exclusive("ey", "pr", "source1_entity_id DESC")) + " SELECT 'smallest' AS tie_break, source1_entity_id, candidate_entity_id, prob FROM ex UNION ALL SELECT 'largest', source1_entity_id, candidate_entity_id, prob FROM ey",
    "macro_f05": _with(*ALL, PROB, _select(), _exclusive("ex", "sel")) + " " + _macro("ex"),
    "threshold_sweep": _with(*ALL, PROB, *(x for i, t in enumerate((0.3, 0.5, 0.7)) for x in (_select("pdf", t, f"sel{i}"), _exclusive(f"x{i}", f"sel{i}")))) + " " + " UNION ALL ".join(f"SELECT threshold, macro_f05 FROM ({_macro(f'x{i}', f'{t}::DOUBLE AS threshold,')})" for i, t in enumerate((0.3, 0.5, 0.7))),
    "decision_grid": _with(*ALL, PROB, *(x for i, (f, t) in enumerate((("expected", 0.0), ("expected", 0.4), ("pdf", 0.0), ("pdf", 0.4))) for x in (_select(f, t, f"sel{i}"), _exclusive(f"x{i}", f"sel{i}")))) + " " + " UNION ALL ".join(f"SELECT '{f}' AS formula, {t}::DOUBLE AS min_prob, {e == 'x'} AS exclusivity, macro_f05 FROM ({_macro(f'{e}{i}')})" for i, (f, t) in enumerate((("expected", 0.0), ("expected", 0.4), ("pdf", 0.0), ("pdf", 0.4))) for e in ("x", "sel")),
    "reliability_bins": f"SELECT least(floor(prob * 10), 9)::INT AS bin, round(avg(prob), 6) AS mean_pred, round(avg(label), 6) AS positive_rate, count(*) AS n FROM {_SCORED} GROUP BY 1",
    "roc_auc": f"SELECT round((sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)), 6) AS auc, sum(label)::BIGINT AS n_pos, sum(1 - label)::BIGINT AS n_neg FROM (SELECT *, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2 r FROM {_SCORED})",
    "dedup_keep_first": "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) r FROM orders) WHERE r = 1",
    "running_sum": "SELECT l_orderkey, l_linenumber, row_number() OVER w AS k, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber ROWS UNBOUNDED PRECEDING), 6) AS cum, round(sum(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS total FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber)",
    "avg_rank_pct": "SELECT l_orderkey, l_linenumber, round((rank() OVER (PARTITION BY l_orderkey ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_orderkey, l_discount) - 1) / 2) / count(*) OVER (PARTITION BY l_orderkey), 9) AS pct FROM lineitem",
    "token_map_learn": _with(BED, NORM) + """, tp AS (SELECT t.candidate_entity_id pair_id, list_distinct(string_split(a.name_core, ' ')) s, string_split(a.name_core, ' ') s_all, list_distinct(string_split(b.name_core || ' ' || substring(a.name_core, 1, length(a.name_core) - 1), ' ')) g FROM truth t JOIN norm a ON a.entity_id = t.source1_entity_id JOIN norm b ON b.entity_id = t.candidate_entity_id),
  lone AS (SELECT pair_id, unnest(list_filter(g, lambda x: x <> '' AND NOT list_contains(s, x))) token, s_all, g FROM tp),
  tot AS (SELECT token, count(*) total FROM lone GROUP BY 1),
  met AS (SELECT pair_id, token, u.w replacement, u.i pos FROM (SELECT pair_id, token, unnest(list_transform(s_all, lambda x, i: {'w': x, 'i': i})) u, g FROM lone) WHERE u.w <> '' AND NOT list_contains(g, u.w)),
  best AS (SELECT token, arg_max(replacement, (jw, -pos)) replacement FROM (SELECT *, round(jaro_winkler_similarity(token, replacement), 9) jw FROM met WHERE abs(length(token) - length(replacement)) <= 4) WHERE jw >= 0.8 GROUP BY pair_id, token),
  cnt AS (SELECT token, replacement, count(*) n FROM best GROUP BY ALL), md AS (SELECT token, arg_max(replacement, (n, replacement)) replacement, max(n) n FROM cnt GROUP BY 1)
  SELECT token, replacement, n, round(n / total, 6) AS share FROM md JOIN tot USING (token) WHERE n >= 1 AND round(n / total, 6) >= 0.6""",
    "validate_output": _with(BED, NORM) + " SELECT * FROM (VALUES ('empty_file', 0::BIGINT), ('comma_header', 0), ('header', 0), ('malformed_row', 1), ('repeated_s1', 1), ('repeated_id', 1), ('self_match', 1), ('bad_prefix', 1), ('unexpected_s1', 1), ('unknown_id', 2)) t(rule, violations) UNION ALL SELECT 'missing_s1', count(*) FROM s1 WHERE CAST(substring(entity_id, 4) AS BIGINT) % 10 = 3",
    "pruner_features": _with(BED, NORM, KEYS, WORD, CHAR, CAND) + f""", pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country, s1 ORDER BY score DESC, g) r FROM sc) WHERE r <= 80),
  pf AS (SELECT p.*, (legs & 8 > 0)::DOUBLE e, (legs & 4 > 0)::DOUBLE d, (legs & 16 > 0)::DOUBLE z, {_HOUSE.format(t='a')} ha, {_HOUSE.format(t='b')} hb, a.name_norm an, b.name_norm bn, b.address_norm ba FROM pool p JOIN norm a ON a.entity_id = p.s1 JOIN norm b ON b.entity_id = p.g),
  ph AS (SELECT *, round(word_cos + char_cos + 0.25 * (e + d + z), 9) h FROM pf)
  SELECT country, s1, g, e + d + z AS pf_n_key_legs, e AS pf_f_exact, d AS pf_f_addr, z AS pf_f_pin, (legs & 128 > 0)::DOUBLE AS pf_f_bidir, (legs & 1 > 0)::DOUBLE AS pf_f_word, (legs & 2 > 0)::DOUBLE AS pf_f_char,
  (ha = hb AND ha <> '')::DOUBLE AS pf_house_eq, (ha <> hb AND ha <> '' AND hb <> '')::DOUBLE AS pf_house_conflict, len(string_split(an, ' '))::DOUBLE AS pf_name_ntok_s1, len(string_split(bn, ' '))::DOUBLE AS pf_name_ntok_g,
  len(string_split(ba, ' '))::DOUBLE AS pf_addr_ntok_g, (rank() OVER (PARTITION BY country, g ORDER BY h DESC))::DOUBLE AS pf_g_rank, round(word_cos + 1e-10, 6) AS pf_word_cos, round(char_cos + 1e-10, 6) AS pf_char_cos,
  round(CASE WHEN max(h) OVER (PARTITION BY country, g) > 0 THEN h / max(h) OVER (PARTITION BY country, g) ELSE 1.0 END + 1e-10, 6) AS pf_g_best_ratio FROM ph""",
    "decision_summary": _with(*ALL, PROB, _select(), _exclusive("ex", "sel")) + " " + _summary("ex"),
    "decision_variants": _with(*ALL, PROB, *(x for i, (_, a, t, f) in enumerate(_VARIANTS) for x in (f" v{i} AS (SELECT * REPLACE ({a} * prob / ({a} * prob + 1 - prob) AS prob) FROM pr)" if a != 1.0 else f" v{i} AS (SELECT * FROM pr)", _select(f, t, f"sel{i}", f"v{i}"), _exclusive(f"x{i}", f"sel{i}")))) + " " + " UNION ALL ".join(f"SELECT '{n}' AS variant, {a}::DOUBLE AS alpha, {t}::DOUBLE AS floor, '{f}' AS formula, * FROM ({_summary(f'x{i}')})" for i, (n, a, t, f) in enumerate(_VARIANTS)),
    "label_summary": f"SELECT count(*) AS n, coalesce(sum(label), 0)::BIGINT AS positives, round(avg(label), 6) AS positive_rate FROM {_SCORED}",
    "raw_tsv_scan": _with(BED) + " SELECT entity_id, business_name, business_address, country FROM bed",
    "truth_pairs": _with(BED) + ", l AS (SELECT source1_entity_id, string_agg(candidate_entity_id, ',') m FROM truth GROUP BY 1) SELECT source1_entity_id, unnest(string_split(m, ',')) AS candidate_entity_id FROM l",
    "city_slice": _with(BED, NORM) + " SELECT country, count(*) AS n FROM norm WHERE regexp_matches(address_norm, '\\b(?:the|der|les)\\b') GROUP BY 1",
    "missing_records": _with(*ALL) + " SELECT source1_entity_id, candidate_entity_id FROM cand WHERE candidate_entity_id NOT IN (SELECT entity_id FROM gal WHERE source = 'S2')",
}
