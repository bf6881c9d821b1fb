"""DuckDB SQL for the training-data queries that SQL can express. The others have brute-force tests in tests/llm."""

from augur.llm.chat import SQL as OP13
from augur.llm.clustering import SQL as OP11
from augur.llm.resampling import SQL as OP12

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PLAIN = r"""list_filter(list_transform({words}, lambda w: regexp_replace(lower(w), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda w: w <> '')""".replace("{words}", WORDS.replace("{text}", "coalesce(text, '')"))

OP5 = f"""WITH d AS (SELECT doc_id, {PLAIN} AS ws FROM documents), i AS (SELECT item_id, {PLAIN} AS ws FROM benchmark),
  k AS (SELECT item_id, least(len(ws), 5) AS k, ws FROM i WHERE len(ws) > 0),
  si AS (SELECT DISTINCT item_id, k, ws[j : j + k - 1] AS g FROM k, unnest(range(1, len(ws) - k + 2)) t(j)), n AS (SELECT item_id, count(*) AS n_item FROM si GROUP BY 1),
  sd AS (SELECT DISTINCT doc_id, q.k, ws[j : j + q.k - 1] AS g FROM d, (SELECT DISTINCT k FROM k) q, unnest(range(1, len(ws) - q.k + 2)) t(j)),
  c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM sd JOIN si USING (k, g) GROUP BY 1, 2)
  SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM c JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_item"""

OP6 = f"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS.replace("{text}", LOWER)} AS ws FROM documents),
  s AS (SELECT DISTINCT doc_id, ws[j : j + 4] AS g FROM d, unnest(range(1, len(ws) - 3)) t(j) WHERE len(ws) >= 5 UNION ALL SELECT doc_id, ws FROM d WHERE len(ws) BETWEEN 1 AND 4),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
  r AS (SELECT doc_id, doc_id AS o FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.o)
  SELECT r.doc_id, any_value(coalesce(n, 0)) AS n_shingles, min(o) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY 1"""

OP10 = f"""WITH d AS (SELECT doc_id, {WORDS.replace("{text}", "coalesce(text, '')")} AS ws FROM documents), w AS (SELECT doc_id, j, array_to_string(ws[j : j + 12], ' ') AS g FROM d, unnest(range(1, len(ws) - 11)) t(j)),
  m AS (SELECT g, min(doc_id) AS m FROM w GROUP BY 1), x AS (SELECT DISTINCT doc_id, j + k AS j FROM w JOIN m USING (g), range(0, 13) t(k) WHERE m < doc_id), a AS (SELECT doc_id, j, ws[j] AS w FROM d, unnest(range(1, len(ws) + 1)) t(j)),
  kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY j) AS t FROM a ANTI JOIN x USING (doc_id, j) GROUP BY 1), gone AS (SELECT doc_id, count(*) AS n FROM x GROUP BY 1)
  SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)"""

SQL = {"op5_decontamination": OP5, "op6_jaccard": OP6, "op10_substrings": OP10, "op11_clustering": OP11, "op12_resampling": OP12, "op13_chat": OP13}
