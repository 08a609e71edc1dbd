"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

from .audit import ORACLE_SQL as AUDIT
from .quality import ORACLE_SQL as QUALITY
from .warc import BASE32

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, list_slice(w, p, p + n - 1) AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM i)),
dw AS (SELECT rid, n, p, list_slice(w, p, p + n - 1) AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT rid, n, p, item_id FROM dw JOIN iw USING (n, g)),
hit AS (SELECT rid, count(DISTINCT p + k) AS n_hit FROM m, range(13) r(k) WHERE k < n GROUP BY rid),
found AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM m WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN hit USING (rid) LEFT JOIN found USING (rid)
"""

ARCHIVE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), l AS (SELECT h, max(page_id) AS last FROM p GROUP BY h),
x AS (SELECT page_id, h, sha1(h) AS s, CASE WHEN page_id <> last THEN last END AS refers_to FROM p JOIN l USING (h))
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
 lambda b: substr('{BASE32}', (((('0x' || substr(s, 5 * i::INT + 1, 5))::INT >> b) & 31) + 1)::INT, 1)), '')), '') AS payload_digest,
 CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM x
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
c AS (SELECT doc_id, w, min(CASE WHEN len(w) > 0 THEN doc_id END) OVER (PARTITION BY w) AS rep FROM d),
r AS (SELECT DISTINCT rep AS a, w FROM c WHERE rep IS NOT NULL),
s AS (SELECT DISTINCT a, hash(list_slice(w, p, p + 4)) AS g FROM (SELECT a, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS p FROM r)),
n AS (SELECT a, count(*) AS n FROM s GROUP BY a),
shared AS (SELECT x.a, y.a AS b, count(*) AS k FROM s x JOIN s y USING (g) WHERE x.a <> y.a GROUP BY ALL),
e AS (SELECT sh.a, sh.b FROM shared sh JOIN n na ON na.a = sh.a JOIN n nb ON nb.a = sh.b WHERE 5 * k >= 4 * (na.n + nb.n - k)),
reach AS (SELECT a, a AS b FROM r UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
class AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a), links AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT doc_id, coalesce(rep, doc_id) AS copy_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM c LEFT JOIN class ON class.a = rep LEFT JOIN links ON links.a = rep
"""

SEARCH = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
tf AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM d) GROUP BY ALL),
df AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM tf, g GROUP BY t, n_docs),
i AS (SELECT row_number() OVER () AS iid, item_id, {_WORDS} AS w FROM benchmark),
q AS (SELECT iid, item_id, t, count(*) AS q FROM (SELECT iid, item_id, unnest(w) AS t FROM i) GROUP BY ALL),
m AS (SELECT rid, doc_id, 75 + (25 * len(w) * n_docs) // n_terms AS m FROM d, g WHERE len(w) > 0),
s AS (SELECT iid, item_id, rid, doc_id, sum(q * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN df USING (t) JOIN tf USING (t) JOIN m USING (rid) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 20
"""

SQL = {"op4_quality_rules": QUALITY, "op6_decontamination": CONTAMINATION, "op8_ngram_jaccard_join": NEAR_DUPLICATES, "op9_warc": ARCHIVE, "op11_vbm_wand": SEARCH, "op12_filter_audit": AUDIT}
