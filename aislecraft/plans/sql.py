"""Common table expressions of the oracle SQL: the canonical views, in the order of their use."""

from __future__ import annotations

import re


def h(seed: object, *keys: str) -> str:
    """The SQL of functions.hashing.hash_int."""
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(f'{k}::VARCHAR' for k in keys)})), 1, 8))::BIGINT)"


def h60(seed: object, *keys: str) -> str:
    """The SQL of functions.hashing.hash_long."""
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(f'{k}::VARCHAR' for k in keys)})), 1, 15))::BIGINT)"


def u(seed: object, *keys: str) -> str:
    return f"({h(seed, *keys)} / 4294967296.0)"


CTES = {
    "raw_inter": "SELECT r_name AS market, o_custkey AS user_id, l_partkey AS item_id, ceil(l_quantity / 10)::DOUBLE AS rating, l_orderkey * 10 + l_linenumber AS ord FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "interactions": "SELECT market, user_id, item_id, avg(rating) AS rating FROM raw_inter GROUP BY ALL",
    "sparse": "SELECT * FROM interactions WHERE rating >= 5",
    "item_features": "SELECT DISTINCT item_id, feature FROM (SELECT p_partkey AS item_id, unnest(list_concat(['brand_' || p_brand, 'type_' || p_type, 'size_' || p_size], list_transform(string_split(p_name, ' '), lambda w: 'word_' || w))) AS feature FROM part)",
    "user_features": "SELECT c_custkey AS user_id, unnest(['seg_' || c_mktsegment, 'nation_' || c_nationkey]) AS feature FROM customer",
    "checkins": "SELECT user_id, json_extract_string(props, '$.k') AS venue, ts, event_type, value, event_id FROM events",
    "split": f"SELECT market, user_id, item_id, rating, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY {h(42, chr(39) + 'loo' + chr(39), 'user_id', 'item_id')}, item_id) = 1 THEN 'test' ELSE 'train' END AS part FROM interactions",
    "train": "SELECT market, user_id, item_id, rating FROM split WHERE part = 'train'",
    "test": "SELECT market, user_id, item_id, rating FROM split WHERE part = 'test'",
    "item_dim": "SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM (SELECT DISTINCT item_id FROM interactions)",
    "negs": f"SELECT user_id, item_id, rn FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY k) AS rn FROM (SELECT d.user_id, i.item_id, min(k) AS k FROM (SELECT user_id, k, {h(42, 'user_id', 'k')} % (SELECT count(*) FROM item_dim) AS idx FROM (SELECT DISTINCT user_id FROM interactions), unnest(range(1, 348)) AS r(k)) d JOIN item_dim i ON i.idx = d.idx GROUP BY 1, 2) c WHERE NOT EXISTS (SELECT 1 FROM interactions s WHERE s.user_id = c.user_id AND s.item_id = c.item_id)) WHERE rn <= 99",
    "candidates": "SELECT user_id, item_id FROM negs UNION ALL SELECT user_id, item_id FROM test",
    "ge": "SELECT *, (SELECT avg(rating) FROM train) AS mu FROM train",
    "ge_i": "SELECT item_id, sum(rating - mu) / (count(*) + 25) AS bi FROM ge GROUP BY 1",
    "ge_u": "SELECT user_id, sum(rating - mu - bi) / (count(*) + 10) AS bu FROM ge JOIN ge_i USING (item_id) GROUP BY 1",
    "scores": "SELECT 'toppop' AS algo, c.user_id, c.item_id, log10(n + 1) AS score FROM candidates c JOIN (SELECT item_id, count(*) AS n FROM train GROUP BY 1) USING (item_id) UNION ALL SELECT 'global', c.user_id, c.item_id, (SELECT avg(rating) FROM train) + coalesce(bu, 0) + coalesce(bi, 0) FROM candidates c LEFT JOIN ge_i USING (item_id) LEFT JOIN ge_u USING (user_id) UNION ALL SELECT 'mean', c.user_id, c.item_id, m FROM candidates c JOIN (SELECT item_id, sum(rating) / (count(*) + 1e-6) AS m FROM train GROUP BY 1) USING (item_id)",
    "factors": "SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings",
    "ltr": "SELECT source AS qid, doc_id, d.n_chars / 1000.0 AS score, (quality + toxic)::DOUBLE AS rel FROM labels JOIN documents d USING (doc_id)",
}


def with_views(query: str, **more: str) -> str:
    """`query` with the views (and `more` of its own) that it uses, directly or through others; a view uses only earlier ones."""
    known = CTES | more
    names, needed = list(known), set()

    def need(text: str, before: int) -> None:
        for k in range(before - 1, -1, -1):
            if names[k] not in needed and re.search(rf"\b(?:FROM|JOIN|,)\s*\(?{names[k]}\b", text):
                needed.add(names[k])
                need(known[names[k]], k)

    need(query, len(names))
    head = ", ".join(f"{n} AS MATERIALIZED ({known[n]})" for n in names if n in needed)
    return f"WITH {head} {query}" if needed else query
