"""The registered queries of this subpackage, and their SQL where SQL can say what they return."""

from __future__ import annotations

from .gif import op7_gif_columns
from .language import op4_language_id
from .toxicity import op5_toxicity
from .packing import op1_best_fit_packing
from .pii import op6_personal_data
from .substring_index import op8_substring_index
from .suffix_dedup import op2_suffix_dedup
from .jaccard import op3_jaccard_join
from .decontaminate import op10_decontamination
from .pitman_yor import op9_pitman_yor

QUERIES = {
    "op9_pitman_yor": op9_pitman_yor,
    "op10_decontamination": op10_decontamination,
    "op3_jaccard_join": op3_jaccard_join,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op8_substring_index": op8_substring_index,
    "op6_personal_data": op6_personal_data,
    "op1_best_fit_packing": op1_best_fit_packing,
    "op5_toxicity": op5_toxicity,
    "op4_language_id": op4_language_id,
    "op7_gif_columns": op7_gif_columns,
}

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_LOWER = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op2_suffix_dedup": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, unnest(range(n)) AS i, unnest(list_transform(range(n), lambda i: substr(h, 2 * i + 1, 200))) AS s FROM d),
f AS (SELECT doc_id, i, s, length(s) = 200 AND row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS later FROM w),
c AS (SELECT doc_id, i, s, max(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM f),
e AS (SELECT doc_id, i, s, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM c),
g AS (SELECT doc_id, count(*) FILTER (gone) AS removed, count(*) FILTER (begins) AS spans, string_agg(substr(s, 1, 2), '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)""",
    "op3_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, {_LOWER} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS s FROM w),
x AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
often AS MATERIALIZED (SELECT x.* FROM x SEMI JOIN (SELECT t FROM x GROUP BY t HAVING count(*) > 1) r ON r.t = x.t),
links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM often a JOIN often b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both l ON l.a = r.b)
SELECT doc_id, len(s) AS n_shingles, component_id FROM s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = doc_id""".replace("both AS", "ways AS").replace("JOIN both l", "JOIN ways l"),
    "op8_substring_index": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word, unnest(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i + 49 <= len(w) THEN array_to_string(w[i : i + 49], ' ') END)) AS passage FROM d),
f AS (SELECT doc_id, i, word, passage IS NOT NULL AND min(doc_id) OVER (PARTITION BY passage) < doc_id AS later FROM x),
c AS (SELECT doc_id, i, word, max(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
g AS (SELECT doc_id, count(*) FILTER (gone) AS removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)""",
}
