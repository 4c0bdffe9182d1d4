"""DuckDB SQL of the queries of the operators for training data, where SQL can express them over whole tables.

The others are tested against brute force on small fixtures: personal values, restorations, name links, new text, mixtures.
"""

_IDS = "regexp_extract_all(lower(coalesce({0}, '')), '[^ \\t\\n\\r\\f\\v<>,;\"()]+@[^ \\t\\n\\r\\f\\v<>,;\"()]+')"
_WORDS = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"

SQL: dict[str, str] = {
    "p3_found": f"""WITH w AS (SELECT row_idx, {_WORDS.format("concat(coalesce(subject, ''), ' ', coalesce(body, ''))")} AS w FROM email_structure),
s AS (SELECT DISTINCT row_idx, md5(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS t FROM (SELECT row_idx, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
n AS (SELECT row_idx, count(*) AS n FROM s GROUP BY row_idx HAVING count(*) >= 20),
c AS (SELECT a.row_idx AS a, b.row_idx AS b, count(*) AS shared FROM s a JOIN s b ON a.t = b.t AND a.row_idx < b.row_idx GROUP BY ALL)
SELECT a AS row_idx_a, b AS row_idx_b FROM c JOIN n x ON x.row_idx = a JOIN n y ON y.row_idx = b WHERE shared >= 0.6 * (x.n + y.n - shared)""",
    "p4_found": f"""WITH RECURSIVE r AS (SELECT row_idx, {_IDS.format("message_id")}[1] AS own, in_reply_to, ref_ids FROM email_structure),
v AS (SELECT own, min(row_idx) AS v FROM r WHERE own IS NOT NULL GROUP BY own), rv AS (SELECT r.*, coalesce(v.v, r.row_idx) AS v FROM r LEFT JOIN v USING (own)),
named AS (SELECT v, unnest({_IDS.format("t")}) AS own FROM (SELECT v, unnest(list_concat([in_reply_to], coalesce(ref_ids, []))) AS t FROM rv)),
e AS (SELECT DISTINCT n.v AS a, v.v AS b FROM named n JOIN v USING (own) WHERE n.v <> v.v), b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(x, y) AS (SELECT DISTINCT v, v FROM rv UNION SELECT reach.x, b.b FROM reach JOIN b ON b.a = reach.y), g AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
m AS (SELECT rv.row_idx, g.y FROM rv JOIN g ON g.x = rv.v)
SELECT row_idx, y AS group_row FROM m WHERE y IN (SELECT y FROM m GROUP BY y HAVING count(*) > 1)""",
    "p8_found": f"""WITH i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM eval_items), d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
gi AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i)),
gd AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d))
SELECT DISTINCT doc_id, item_id FROM gi JOIN gd USING (g)""",
    "p10_found": """WITH w AS (SELECT DISTINCT doc_id, md5(substr(text, k, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS k FROM documents WHERE length(text) >= 200)),
m AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1), x AS (SELECT * FROM w WHERE h IN (SELECT h FROM m))
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id""",
}

SQL["p3_groups"] = f"""WITH RECURSIVE e AS ({SQL["p3_found"]}), b AS (SELECT row_idx_a AS u, row_idx_b AS v FROM e UNION SELECT row_idx_b, row_idx_a FROM e),
reach(x, y) AS (SELECT DISTINCT u, u FROM b UNION SELECT reach.x, b.v FROM reach JOIN b ON b.u = reach.y) SELECT x AS row_idx, min(y) AS group_row FROM reach GROUP BY x"""
