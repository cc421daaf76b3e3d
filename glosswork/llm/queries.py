"""The queries of this package and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glosswork.llm.ann import op6_nearest_neighbours
from glosswork.llm.centroids import op12_centroid_clustering
from glosswork.llm.chat import op10_chat_formatting
from glosswork.llm.fill_middle import op11_fill_in_middle
from glosswork.llm.fingerprint import op4_document_fingerprints
from glosswork.llm.langid import op3_language_id
from glosswork.llm.ngram_join import op2_ngram_jaccard_join
from glosswork.llm.packing import op5_best_fit_packing
from glosswork.llm.pii import op13_personal_data
from glosswork.llm.secrets import op7_secret_scans
from glosswork.llm.sentencepiece_tok import op8_sentencepiece
from glosswork.llm.substring_dedup import op9_substring_dedup
from glosswork.llm.suffix_dedup import op1_suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_language_id": op3_language_id,
    "op4_document_fingerprints": op4_document_fingerprints,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_secret_scans": op7_secret_scans,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_personal_data": op13_personal_data,
}


def _clustering_sql(rounds: int = 10, k: int = 8) -> str:
    """Rounds of exact k-means, one common table expression after another."""
    out = """WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('3:'||coalesce(vec_id::VARCHAR, '')) AS h, x FROM v ORDER BY h, x LIMIT %d))""" % k
    for i in range(rounds + 1):
        distance = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
        out += f""",
a{i} AS MATERIALIZED (SELECT r, min(d) AS d, arg_min(c, d * 1000 + c) AS c FROM (SELECT v.r, c.c, {distance} AS d FROM v, c{i} c) GROUP BY r)"""
        if i < rounds:
            out += f""",
s{i} AS (SELECT c, j, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT a.c, unnest(v.x) AS y, generate_subscripts(v.x, 1) AS j FROM v JOIN a{i} a USING (r)) GROUP BY c, j),
c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS x FROM s{i} GROUP BY c) m USING (c))"""
    return out + f"""
SELECT v.vec_id, a.c::INTEGER AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM v JOIN a{rounds} a USING (r) JOIN c{rounds} c ON c.c = a.c"""


ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": r"""WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, x, len(x) // 2 AS n FROM h),
p AS (SELECT doc_id, n, unnest(range(n)) AS p, x FROM b WHERE n > 0),
w AS (SELECT doc_id, p, x[2*p+1:2*p+2] AS byte, CASE WHEN p + 200 <= n THEN md5_number(x[2*p+1:2*p+400]) END AS k FROM p),
m AS (SELECT doc_id, p, byte, k IS NOT NULL AND count(*) OVER (PARTITION BY k) > 1 AS hit FROM w),
r AS (SELECT doc_id, p, byte, coalesce(max(CASE WHEN hit THEN p END) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) > p - 200, false) AS gone FROM m),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS begins FROM r),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, coalesce(string_agg(byte, '' ORDER BY p) FILTER (NOT gone), '') AS kept FROM s GROUP BY doc_id)
SELECT b.doc_id, b.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM b LEFT JOIN g USING (doc_id)""",
    "op2_ngram_jaccard_join": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM x),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM x UNION SELECT r.doc_id, l.b FROM reach r JOIN l ON l.a = r.other)
SELECT x.doc_id, len(s)::BIGINT AS n_shingles, c.component_id FROM x JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)""",
    "op9_substring_dedup": r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
e AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS p FROM w),
k AS (SELECT doc_id, i AS p, array_to_string(ws[i+1:i+20], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(len(ws) - 19)) AS i FROM w WHERE len(ws) >= 20)),
later AS (SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM k) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, p + d AS p FROM later, range(20) t(d)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS s FROM e ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op10_chat_formatting": r"""WITH c AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) t(a, b, c, d))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role||chr(10)||text||chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum(length('<|turn|>') + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g')) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|end|>') + 1)::BIGINT AS formatted_chars FROM c GROUP BY conv_id""",
    "op11_fill_in_middle": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:'||coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (SELECT *, len(u) AS n, [('0x'||h[1:8])::UBIGINT::BIGINT, ('0x'||h[9:16])::UBIGINT::BIGINT, ('0x'||h[17:24])::UBIGINT::BIGINT, ('0x'||h[25:32])::UBIGINT::BIGINT] AS k FROM d),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR k[3] % 100 >= 90 THEN 'plain' WHEN k[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, least(k[1] % (n + 1), k[2] % (n + 1)) AS a, greatest(k[1] % (n + 1), k[2] % (n + 1)) AS b FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a+1:b], '') AS mid, array_to_string(u[b+1:], '') AS suf FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
 sha256(CASE form WHEN 'psm' THEN '<P>'||pre||'<S>'||suf||'<M>'||mid WHEN 'spm' THEN '<S>'||suf||'<P>'||pre||'<M>'||mid ELSE text END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
    "op12_centroid_clustering": _clustering_sql(),
}
