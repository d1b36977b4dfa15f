"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from tessera.llm.op01_secrets import op1_secrets
from tessera.llm.op02_sharding import op2_sharding
from tessera.llm.op03_language import op3_language
from tessera.llm.op04_lm_scoring import op4_lm_scoring
from tessera.llm.op05_toxicity import op5_toxicity
from tessera.llm.op06_mixing import op6_mixing
from tessera.llm.op07_jaccard_join import op7_jaccard_join
from tessera.llm.op08_decontamination import op8_decontamination
from tessera.llm.op09_neighbours import op9_neighbours
from tessera.llm.op10_substrings import op10_substrings

QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_sharding": op2_sharding,
    "op3_language": op3_language,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_toxicity": op5_toxicity,
    "op6_mixing": op6_mixing,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_decontamination": op8_decontamination,
    "op9_neighbours": op9_neighbours,
    "op10_substrings": op10_substrings,
}

_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}_]+'), lambda x: x <> '')"
_SHINGLES = "list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')))"

#: Brute force over all pairs. The other operators' models, hashes and searches have no SQL form.
ORACLE_SQL: dict[str, str] = {
    "op7_jaccard_join": f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
k AS (SELECT doc_id, s, len(s) AS n, md5(array_to_string(list_sort(s), '|')) AS h FROM (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE {_SHINGLES} END AS s FROM d) x),
c AS (SELECT h, min(doc_id) AS rep, any_value(s) AS s, any_value(n) AS n FROM k WHERE n > 0 GROUP BY h),
u AS (SELECT rep, n, unnest(s) AS x FROM c),
p AS (SELECT a.rep AS a, b.rep AS b FROM u a JOIN u b ON a.x = b.x AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(node, comp) AS (SELECT rep, rep FROM c UNION SELECT e.b, r.comp FROM r JOIN e ON e.a = r.node),
m AS (SELECT node, min(comp) AS comp FROM r GROUP BY node),
l AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT k.doc_id AS doc_id, coalesce(m.comp, k.doc_id) AS class_id, coalesce(c.rep, k.doc_id) AS copy_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links
FROM k LEFT JOIN c ON k.h = c.h AND k.n > 0 LEFT JOIN m ON m.node = c.rep LEFT JOIN l ON l.a = c.rep""",
    "op8_decontamination": f"""WITH d AS (SELECT DISTINCT doc_id, unnest({_SHINGLES}) AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents) x),
i AS (SELECT item_id, len(t) AS n, unnest(t) AS s FROM (SELECT item_id, {_SHINGLES} AS t FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) x) y)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS n_shingles, CAST(count(*) AS INTEGER) AS shared, count(*) / n AS containment FROM d JOIN i ON d.s = i.s GROUP BY doc_id, item_id, n HAVING count(*) >= 0.8 * n""",
}
