"""SQL that gives the same rows as the queries, where SQL can express them."""

from __future__ import annotations

from aislecraft.llm import url_tree as tree

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS words FROM documents),
items AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS words FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(10, len(words)) AS n, array_to_string(words[i:i + 9], ' ') AS win FROM items, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS r(i) WHERE len(words) > 0),
places AS (SELECT doc_id, i, n, array_to_string(words[i:i + n - 1], ' ') AS win FROM docs, (SELECT DISTINCT n FROM wins) AS s, unnest(range(1, len(words) - n + 2)) AS r(i)),
found AS (SELECT DISTINCT doc_id, item_id, i, n FROM places JOIN wins USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + n)) AS r(p) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY 1)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

NGRAM_JOIN = f"""
WITH RECURSIVE docs AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS s FROM docs, unnest(range(1, greatest(1, len(words) - 4) + 1)) AS r(i) WHERE len(words) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p JOIN sizes p1 ON p1.doc_id = a JOIN sizes p2 ON p2.doc_id = b WHERE 100 * c >= 80 * (p1.n + p2.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM docs UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least AS component_id FROM docs LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY 1) USING (doc_id)
"""

_FINITE = "vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"

HARD_NEGATIVES = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings WHERE {_FINITE} AND label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_inner_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""

NEAR_VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE {_FINITE} AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN n USING (vec_id)
"""


def _pick(values: list[str], fits: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, v in zip(fits, values)) + " END"


def _urls() -> str:
    ordered = sorted(tree.RULES, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in ordered]
    views = [
        f"split AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)",
        f"judged AS (SELECT *, {_pick([h + p for _, h, p in ordered], fits)} AS rule, {_pick([v for v, _, _ in ordered], fits)} AS by_rule, list_transform(string_split(regexp_replace(path, '^/', ''), '/'), lambda s: CASE WHEN regexp_matches(s, '[0-9]') THEN '*' || regexp_extract(s, '(\\.[A-Za-z]{{1,5}})$', 1) ELSE s END) AS general FROM split)",
        f"shaped AS (SELECT *, array_to_string(CASE WHEN len(general) > {tree.DEPTH} THEN list_append(general[1:{tree.DEPTH}], '**') ELSE general END, '/') AS shape FROM judged)",
        f"t0 AS (SELECT *, own AS parent, own AS share FROM (SELECT *, string_split(shape, '/') AS parts, '' AS template, (sum(bad) OVER h + {tree.WEIGHT} * 0.5) / (sum(bad) OVER h + sum(good) OVER h + {tree.WEIGHT}) AS own FROM (SELECT host, shape, count(*) AS n, count(*) FILTER (WHERE by_rule = 'block') AS bad, count(*) FILTER (WHERE by_rule = 'allow') AS good FROM shaped GROUP BY 1, 2) WINDOW h AS (PARTITION BY host)))",
    ]
    w = tree.WEIGHT
    for k in range(1, tree.DEPTH + 2):
        branch, level = "OVER (PARTITION BY host, template, part)", "OVER (PARTITION BY host, template)"
        of = lambda c: f"sum(CASE WHEN part IS NOT NULL THEN {c} ELSE 0 END)"
        views.append(
            f"a{k} AS (SELECT *, {of('bad')} {branch} AS b_bad, {of('good')} {branch} AS b_good, {of('n')} {level} AS l_n, {of('bad')} {level} AS l_bad, {of('good')} {level} AS l_good, count(DISTINCT part) {level} AS l_parts FROM (SELECT *, parts[{k}] AS part FROM t{k - 1}))"
        )
        common = "((l_bad + 1) / (l_bad + l_good + 2))"
        alike = f"(b_bad + b_good > 0 AND abs(b_bad / greatest(b_bad + b_good, 1) - {common}) <= {tree.ALIKE} * sqrt({common} * (1 - {common}) / greatest(b_bad + b_good, 1)))"
        variable = f"(l_parts >= {tree.LEAST_SEGMENTS} AND l_parts >= {tree.SPREAD} * l_n)"
        general = f"CASE WHEN {variable} THEN '*' WHEN l_parts > 1 AND {alike} THEN '#' ELSE part END"
        views.append(f"b{k} AS (SELECT host, shape, n, bad, good, parts, part, parent, share, CASE WHEN part IS NULL THEN template ELSE template || '/' || {general} END AS template FROM a{k})")
        views.append(
            f"t{k} AS (SELECT host, shape, n, bad, good, parts, template, CASE WHEN part IS NULL THEN parent ELSE share END AS parent, CASE WHEN part IS NULL THEN share ELSE (sum(bad) {level} + {w} * share) / (sum(bad) {level} + sum(good) {level} + {w}) END AS share FROM b{k})"
        )
    views.append(
        f"rejected AS (SELECT host, shape FROM (SELECT host, shape, parent, sum(bad) OVER t AS t_bad, sum(good) OVER t AS t_good FROM t{tree.DEPTH + 1} WINDOW t AS (PARTITION BY host, template)) WHERE t_bad + t_good >= {tree.LEAST_LABELS} AND (t_bad + {w} * parent) / (t_bad + t_good + {w}) >= {tree.REJECT} AND host <> '')"
    )
    return "WITH " + ", ".join(views) + " SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN r.host IS NOT NULL THEN 'block' END, 'allow') AS verdict FROM shaped LEFT JOIN rejected r USING (host, shape)"


ORACLES = {"op3_positional_decontamination": DECONTAMINATION, "op8_token_group_join": NGRAM_JOIN, "op10_url_template_tree": _urls(), "op12_segment_negatives": HARD_NEGATIVES, "op13_spherical_cells": NEAR_VECTORS}
