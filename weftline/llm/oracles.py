"""DuckDB SQL that gives the rows of those corpus queries which SQL can express."""

from __future__ import annotations

from weftline.llm.centroids import CLUSTERS, DIMENSIONS, ROUNDS, SCALE
from weftline.llm.license_scan import CONTAINMENT, TEMPLATES
from weftline.llm.quality_rules import AUDIT, ERROR, FOLDS, RISK, RULES, SYMBOLS

WHITE = "[\\x20\\x09-\\x0D]"

#: Occurrences of all five-word windows: texts of fewer words have none.
WORDS = f"""words AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{WHITE}+'), lambda w: w <> '') AS ws
  FROM documents)"""


def license_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ",\n    ".join(f"({quoted(f'{name}/{part}')}, {quoted(name)}, {quoted(text)})" for name, part, text in TEMPLATES)
    tokens = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
    grams = "list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))"
    return f"""WITH templates(template, license, text) AS (VALUES
    {values}),
  t AS (SELECT template, license, unnest(list_distinct({grams})) AS g FROM (SELECT template, license, {tokens} AS ws FROM templates)),
  sizes AS (SELECT template, count(*) AS size FROM t GROUP BY template),
  d AS (SELECT DISTINCT doc_id, unnest({grams}) AS g FROM (SELECT doc_id, {tokens} AS ws FROM documents)),
  m AS (SELECT doc_id, license, template, count(*) AS n FROM d JOIN t USING (g) GROUP BY ALL)
SELECT doc_id, license, template, n / size::DOUBLE AS containment FROM m JOIN sizes USING (template) WHERE n / size::DOUBLE >= {CONTAINMENT}"""


def quality_sql() -> str:
    share = RISK / len(RULES)
    tests = sum(len(cuts) for _, _, cuts in RULES)
    value = {name: v.replace(" div ", " // ") for name, v, _ in RULES}
    grid = ", ".join(f"('{name}', {cut})" for name, _, cuts in RULES for cut in cuts)
    case = "CASE rule " + " ".join(f"WHEN '{name}' THEN {v}" for name, v in value.items()) + " END"
    tail = f"""(SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share}) + (n - i) * ln(1 - {share}))) FROM range(0, k + 1) AS r(i))"""
    failed = ", ".join(f"CASE WHEN {value[name]} >= cuts['{name}'] THEN '{name}' END" for name, _, _ in RULES)
    return f"""WITH {WORDS},
  grams AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM words)),
  twice AS (SELECT rid, g FROM grams GROUP BY rid, g HAVING count(*) > 1),
  covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM grams JOIN twice USING (rid, g), range(0, 5) AS r(k) GROUP BY rid),
  base AS (
    SELECT rid, doc_id, coalesce(lang, 'und') AS stratum, len(ws)::BIGINT AS n_words,
           length(regexp_replace(text, '{WHITE}', '', 'g'))::BIGINT AS word_chars,
           (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
           (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
    FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM words) LEFT JOIN covered USING (rid)),
  judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
  good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING max(quality) > 0),
  held AS (SELECT j.* FROM judged j JOIN good USING (doc_id) WHERE NOT base_failed AND doc_id % {FOLDS} <> {AUDIT}),
  counts AS (SELECT stratum, rule, cut, count(*) AS n, sum(({case} >= cut)::INT)::BIGINT AS k FROM held, (VALUES {grid}) AS g(rule, cut) GROUP BY ALL),
  safe AS (
    SELECT stratum, rule, min(cut) AS cut FROM counts
    WHERE k <= n * {share} AND {tail} <= {ERROR} / ({tests} * (SELECT count(DISTINCT stratum) FROM held)) GROUP BY ALL),
  cutoffs AS (SELECT stratum, map(list(rule), list(cut)) AS cuts FROM safe GROUP BY stratum),
  done AS (SELECT j.*, list_filter([{failed}], lambda f: f IS NOT NULL) AS failed_rules FROM judged j LEFT JOIN cutoffs USING (stratum))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND len(failed_rules) = 0 AS kept, stratum, failed_rules FROM done"""


JACCARD = f"""WITH RECURSIVE {WORDS},
  sets AS (
    SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM words),
  g AS (SELECT doc_id, len(s) AS size, unnest(s) AS g FROM sets),
  pairs AS (
    SELECT x.doc_id AS a, y.doc_id AS b FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id
    GROUP BY x.doc_id, y.doc_id, x.size, y.size HAVING 9 * count(*) >= 4 * (x.size + y.size)),
  reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
  classes AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a),
  links AS (SELECT a AS doc_id, count(*) AS n FROM pairs GROUP BY a)
SELECT doc_id, class_id, coalesce(n, 0)::BIGINT AS n_links FROM classes LEFT JOIN links USING (doc_id)"""

#: The copies are found on the texts themselves, and every order and step is counted from the documents' failures.
FILTER_AUDIT = f"""WITH {WORDS},
  named AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
  own AS (
    SELECT coalesce(lang, '') AS part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
           (len(ws) < 200)::INT AS a, (100 * len(list_distinct(ws)) < 50 * len(ws))::INT AS b,
           (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT AS c, regexp_matches(text, '[#$%&*|]')::INT AS d,
           coalesce((min(w.doc_id) OVER (PARTITION BY text) < w.doc_id)::INT, 0) AS e
    FROM words w LEFT JOIN named n ON n.doc_id = w.doc_id),
  cells AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM own GROUP BY ALL),
  l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)),
  orders AS (
    SELECT p.letter || q.letter || r.letter || s.letter || t.letter AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
    FROM l p, l q, l r, l s, l t WHERE p.bit | q.bit | r.bit | s.bit | t.bit = 31),
  steps AS (SELECT filter_order, i::INT AS step, bits[i] AS bit, coalesce(list_sum(bits[:i - 1]), 0)::INT AS earlier FROM orders, range(1, 6) AS r(i)),
  counted AS (
    SELECT part, filter_order, step, bit,
           sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
           sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
           sum(CASE WHEN mask & bit > 0 AND mask & earlier > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
           sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
           sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
           sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM cells, steps GROUP BY ALL)
SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counted"""


def clusters_sql() -> str:
    """Every vector is compared with every centroid in every round."""
    parts = [
        f"""v AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)) AS x FROM embeddings
    WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e::DOUBLE))) = {DIMENSIONS})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, x) - 1 AS c, x FROM v QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, x) <= {CLUSTERS})""",
    ]
    for r in range(ROUNDS + 1):
        apart = "list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, k.x) + list_inner_product(k.x, k.x)"
        parts.append(f"a{r} AS MATERIALIZED (SELECT rid, vec_id, v.x, min(struct_pack(d := {apart}, c := k.c)) AS best FROM v, c{r} k GROUP BY ALL)")
        if r < ROUNDS:
            parts.append(f"""c{r + 1} AS MATERIALIZED (
    WITH m AS (SELECT best.c AS c, i, floor(sum(x[i]) / count(*)) AS mean FROM a{r}, range(1, {DIMENSIONS + 1}) AS r(i) GROUP BY ALL)
    SELECT k.c, coalesce(n.x, k.x) AS x FROM c{r} k LEFT JOIN (SELECT c, list(mean ORDER BY i) AS x FROM m GROUP BY c) n ON n.c = k.c)""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, k.c::INT AS cluster, best.d::BIGINT AS distance, (sum(best.d) OVER (PARTITION BY k.c))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(list_transform(k.x, lambda e: e::BIGINT::VARCHAR), ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} k ON k.c = best.c"""


ORACLES = {
    "op1_license_scan": license_sql(),
    "op2_quality_rules": quality_sql(),
    "op8_jaccard_join": JACCARD,
    "op11_filter_audit": FILTER_AUDIT,
    "op13_centroid_clustering": clusters_sql(),
}
