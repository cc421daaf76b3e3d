"""The queries of the library's own operators, over whole tables, and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from glosswork.functions import text as T
from glosswork.extract import index
from glosswork.operators import diff, lines, notes, patch, placement, reattach, registry, state, terms, verify, work
from glosswork.plans import fixtures as X
from glosswork.plans import reports
from glosswork.sources import cache, files, tables
from glosswork.sources.tables import settled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

def query(sql: str | None = None, fixtures: bool = True):
    """Register a query under its function's name; sql: the same for DuckDB, after the fixtures' table expressions."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"{X.SQL}{sql}" if fixtures else sql
        return f

    return add


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def _derived(spark: SparkSession, sf: str) -> DataFrame:
    return state.derive(X.new_symbols(spark, sf), X.records(spark, sf))


# --- coverage and state ---


@query(""", c AS (SELECT * FROM stat WHERE translatable OR status <> 'pending')
SELECT count(*) AS in_scope, count(*) FILTER (status='reviewed') AS reviewed, count(*) FILTER (status='translated') AS translated, count(*) FILTER (status='stale') AS stale, count(*) FILTER (status='pending') AS pending,
 coalesce(count(*) FILTER (status<>'pending')::DOUBLE / nullif(count(*),0), 0) AS coverage, coalesce(count(*) FILTER (status IN ('translated','reviewed'))::DOUBLE / nullif(count(*),0), 0) AS fresh, coalesce(count(*) FILTER (status='reviewed')::DOUBLE / nullif(count(*),0), 0) AS reviewed_ratio FROM c""")
def coverage_status(spark, sf):
    return state.coverage(_derived(spark, sf))


@query("SELECT id, status, changed, priority FROM stat")
def derive_state(spark, sf):
    return _derived(spark, sf).select("id", "status", F.array_join("changed", ",").alias("changed"), "priority")


@query("SELECT k AS kind, count(*) AS n FROM (SELECT unnest(string_split(changed, ',')) AS k FROM stat WHERE status='stale') GROUP BY k")
def stale_kinds(spark, sf):
    return state.stale_kinds(_derived(spark, sf))


@query("SELECT path, CASE WHEN bool_or(status='stale') THEN 'stale' WHEN bool_or(status<>'pending') THEN 'translated' ELSE 'pending' END AS status FROM stat GROUP BY path")
def file_status(spark, sf):
    return state.file_status(_derived(spark, sf))


@query("SELECT grp, count(*) FILTER (status NOT IN ('pending','stale')) AS done, count(*) FILTER (status='stale') AS stale, count(*) AS n FROM (SELECT *, CASE WHEN path LIKE 'moved/%' THEN 'moved' ELSE split_part(path,'/',1) END AS grp FROM stat WHERE translatable OR status<>'pending') GROUP BY grp")
def group_coverage(spark, sf):
    return state.group_coverage(_derived(spark, sf), 1)


@query("SELECT id, priority, changed FROM stat WHERE status='stale' AND id LIKE 'src1%'")
def review_queue(spark, sf):
    return state.queue(_derived(spark, sf), "stale", "src1").select("id", "priority", F.array_join("changed", ",").alias("changed"))


@query("SELECT id, \"by\" FROM recs WHERE id NOT IN (SELECT id FROM news)")
def orphans(spark, sf):
    return state.orphans(X.records(spark, sf), X.new_symbols(spark, sf)).select("id", "by")


_MERGE_SQL = """, gone AS (SELECT * FROM recs WHERE id NOT IN (SELECT id FROM news)),
un AS (SELECT * FROM news WHERE zh IS NOT NULL AND id NOT IN (SELECT id FROM recs)),
moved AS (SELECT u.id AS new_id, g.old_id FROM (SELECT zh, min(id) AS id FROM un GROUP BY zh) u JOIN (SELECT zh, max(id) AS old_id FROM gone GROUP BY zh) g USING (zh)),
mrec AS (
 SELECT id, sig AS at_sig, doc AS at_doc, body AS at_body, zh, 'me' AS by, NULL AS review_zh, 'created' AS action, NULL AS old_id FROM un WHERE id NOT IN (SELECT new_id FROM moved)
 UNION ALL SELECT m.new_id, r.at_sig, r.at_doc, r.at_body, r.zh, r.by, r.review_zh, 'migrated', m.old_id FROM recs r JOIN moved m ON r.id = m.old_id
 UNION ALL SELECT s.id, s.sig, s.doc, s.body, s.zh, 'me', NULL, 'refreshed', NULL FROM news s JOIN recs r USING (id) WHERE s.zh IS NOT NULL AND s.zh <> r.zh
 UNION ALL SELECT r.id, r.at_sig, r.at_doc, r.at_body, r.zh, r.by, r.review_zh, 'kept', NULL FROM news s JOIN recs r USING (id) WHERE s.zh IS NOT NULL AND s.zh = r.zh
 UNION ALL SELECT r.id, r.at_sig, r.at_doc, r.at_body, r.zh, r.by, r.review_zh, 'dropped', NULL FROM recs r WHERE (r.id IN (SELECT id FROM gone) AND r.id NOT IN (SELECT old_id FROM moved)) OR r.id IN (SELECT id FROM news WHERE zh IS NULL))
"""


@query(_MERGE_SQL + "SELECT * FROM mrec")
def state_update(spark, sf):
    return state.merge(X.records(spark, sf), X.new_symbols(spark, sf), "me").select("id", "at_sig", "at_doc", "at_body", "zh", "by", "review_zh", "action", "old_id")


@query(""", ok AS (SELECT * FROM news WHERE zh IS NOT NULL AND doc_id % 5 = 0)
SELECT id, at_sig, "by", review_zh FROM recs WHERE id NOT IN (SELECT id FROM ok) UNION ALL SELECT o.id, o.sig, coalesce(r."by", 'me'), o.zh FROM ok o LEFT JOIN recs r USING (id)""")
def approve(spark, sf):
    return state.approve(X.records(spark, sf), X.new_symbols(spark, sf).where("doc_id % 5 = 0"), "me").select("id", "at_sig", "by", "review_zh")


# --- lines ---


@query('SELECT path, "row", length(line) AS chars FROM ulines')
def line_relation(spark, sf):
    return lines.explode_lines(X.upstream(spark, sf)).select("path", "row", F.length("line").cast("long").alias("chars"))


@query(f"SELECT path, \"row\", trim(regexp_replace(line, '^.*?{T.MARKER}', '')) AS said FROM slines WHERE regexp_matches(line, '^[ \\t]*#[ \\t]*{T.MARKER}')")
def annotation_lines(spark, sf):
    return lines.annotation_rows(lines.explode_lines(X.study(spark, sf))).select("path", "row", T.annotation_body(F.col("line")).alias("said"))


@query("SELECT path, sha256(text) AS stripped FROM upstream")
def strip_annotations(spark, sf):
    return X.study(spark, sf).select("path", F.sha2(T.strip_annotations(F.col("text")), 256).alias("stripped"))


@query("SELECT count(*) AS files, count(*) AS equal FROM upstream")
def strip_invariant(spark, sf):
    both = X.upstream(spark, sf).withColumn("study", X.annotated(F.col("text")))
    return both.agg(F.count("*").alias("files"), F.count_if(T.strip_annotations(F.col("study")) == F.col("text")).alias("equal"))


@query(f""", z AS (SELECT path, "row", "row" - row_number() OVER (PARTITION BY path ORDER BY "row") AS g FROM slines WHERE line LIKE '# {T.MARKER}%' OR "row" % 5 = 0)
SELECT path, min("row") AS first, max("row") AS last, count(*) AS n FROM z GROUP BY path, g""")
def annotation_blocks(spark, sf):
    rows = lines.explode_lines(X.study(spark, sf)).where(T.is_annotation(F.col("line")) | (F.col("row") % 5 == 0))
    return lines.blocks(rows.select("path", "row"), "path")


@query(""", sy AS (SELECT path, path||'#s'||o AS id, a AS s, b AS e, o FROM upstream, (VALUES (0,0,9),(1,2,5),(2,4,5),(3,12,30)) v(o,a,b)),
m AS (SELECT l.path, l."row", arg_min(sy.id, (sy.e - sy.s) * 10 + sy.o) AS id FROM ulines l LEFT JOIN sy ON l.path = sy.path AND l."row" BETWEEN sy.s AND sy.e GROUP BY l.path, l."row")
SELECT path, "row", coalesce(id, path||'#<module>') AS id FROM m""")
def owner_join(spark, sf):
    return lines.owner_join(lines.explode_lines(X.upstream(spark, sf)), X.upstream_symbols(spark, sf))


@query(f"SELECT doc_id, {X._dig('text')} AS digest FROM upstream")
def digest_norm(spark, sf):
    return X.upstream(spark, sf).select("doc_id", T.digest(F.col("text")).alias("digest"))


@query("SELECT path, (SELECT count(*) FROM ulines l WHERE l.path = u.path) AS n_lines, left(sha256(text), 12) AS sha FROM upstream u")
def file_fingerprint(spark, sf):
    return lines.fingerprint(lines.explode_lines(X.upstream(spark, sf)), "path")


@query(""", cut AS (SELECT u.path, string_split(u.text, chr(10)) AS a, string_split(l.text, chr(10)) AS b FROM upstream u JOIN later l USING (doc_id) WHERE l.doc_id % 13 <> 0 AND u.text <> l.text),
k AS (SELECT path, CASE WHEN a[1] <> b[1] THEN 1 ELSE len(a) END AS i, a, b FROM cut)
SELECT path, CASE WHEN i > 1 AND a[i] = '' THEN i ELSE i END::BIGINT AS line, CASE WHEN i = len(a) AND b[i] = '' THEN '<EOF>' ELSE b[i] END AS study_line, CASE WHEN i = len(a) AND a[i] = '' THEN '<EOF>' ELSE a[i] END AS upstream_line FROM k""")
def first_divergence(spark, sf):
    return lines.first_divergence(X.later(spark, sf), X.upstream(spark, sf))


@query("""WITH l AS (SELECT conv_id, turn, unnest(string_split(coalesce(text,''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text,''), chr(10)), 1) AS r FROM conversations),
p AS (SELECT *, coalesce(lag(line) OVER w, '') AS before, CASE WHEN line = '' OR regexp_matches(line, '^(?:[-*•]|\\d+[.、)])[ \\t]') OR coalesce(lag(line) OVER w, '') = '' THEN 1 ELSE 0 END AS new FROM l WINDOW w AS (PARTITION BY conv_id, turn ORDER BY r)),
g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn ORDER BY r) AS grp FROM p),
t AS (SELECT conv_id, turn, min(r) AS r, string_agg(CASE WHEN new = 0 AND regexp_matches(before, '[A-Za-z0-9`]$') AND regexp_matches(line, '^[A-Za-z0-9`]') THEN ' ' ELSE '' END || line, '' ORDER BY r) AS text FROM g WHERE line <> '' GROUP BY conv_id, turn, grp)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY r) AS number, text FROM t""", fixtures=False)
def paragraphs(spark, sf):
    rows = lines.explode_lines(X.read(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")))
    return lines.paragraphs(rows, "conv_id", "turn")


@query("SELECT conv_id, turn, regexp_replace(replace(replace(replace(replace(replace(coalesce(text,''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'), '`([^`]+)`', '<code>\\1</code>', 'g') AS html FROM conversations", fixtures=False)
def inline_markdown(spark, sf):
    return X.read(spark, sf, "conversations").select("conv_id", "turn", T.inline_markdown(F.coalesce("text", F.lit(""))).alias("html"))


# --- differences ---


@query("""SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'A' WHEN b.path IS NULL THEN 'D' ELSE 'M' END AS change FROM upstream a FULL JOIN later b ON a.path = b.path WHERE a.text IS DISTINCT FROM b.text""")
def snapshot_diff(spark, sf):
    return diff.snapshot_diff(X.upstream(spark, sf), X.later(spark, sf))


_DIFF_SQL = """, d AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.sig<>b.sig OR a.doc<>b.doc OR a.body<>b.body THEN 'modified' END AS change_type,
 concat_ws(',', CASE WHEN a.sig<>b.sig THEN 'sig' END, CASE WHEN a.doc<>b.doc THEN 'doc' END, CASE WHEN a.body<>b.body THEN 'body' END) AS changed FROM olds a FULL JOIN news b ON a.id = b.id),
ra AS (SELECT *, row_number() OVER (PARTITION BY kind, body ORDER BY ord) AS rn FROM olds WHERE body_lines > 0 AND id NOT IN (SELECT id FROM news)),
rb AS (SELECT *, row_number() OVER (PARTITION BY kind, body ORDER BY ord) AS rn FROM news WHERE body_lines > 0 AND id NOT IN (SELECT id FROM olds)),
ren AS (SELECT ra.id AS old_id, rb.id AS new_id FROM ra JOIN rb USING (kind, body, rn))
"""


@query(_DIFF_SQL + "SELECT * FROM d WHERE change_type IS NOT NULL")
def symbol_diff(spark, sf):
    return diff.symbol_diff(X.old_symbols(spark, sf), X.new_symbols(spark, sf))


@query(_DIFF_SQL + "SELECT * FROM ren")
def rename_pairs(spark, sf):
    return diff.rename_pairs(X.old_symbols(spark, sf), X.new_symbols(spark, sf))


@query(_DIFF_SQL + "SELECT count(*) FILTER (change_type='added') - (SELECT count(*) FROM ren) AS added, count(*) FILTER (change_type='removed') - (SELECT count(*) FROM ren) AS removed, count(*) FILTER (change_type='modified') AS modified, (SELECT count(*) FROM ren) AS renamed FROM d")
def diff_stats(spark, sf):
    a, b = X.old_symbols(spark, sf), X.new_symbols(spark, sf)
    return diff.diff_stats(diff.symbol_diff(a, b), diff.rename_pairs(a, b))


@query("SELECT path, CASE WHEN a IS NULL THEN 'new-file' WHEN b IS NULL THEN 'deleted' ELSE 'code-modified' END AS code FROM (SELECT coalesce(s.path, u.path) AS path, u.text AS a, s.text AS b FROM upstream u FULL JOIN later s ON u.path = s.path) WHERE a IS DISTINCT FROM b")
def verify_issues(spark, sf):
    study = X.later(spark, sf).withColumn("text", X.annotated(F.col("text")))
    return verify.issues(study, X.upstream(spark, sf)).select("path", "code")


@query("""WITH t AS (SELECT doc_id, doc_id % 10 AS d, len(string_split(coalesce(text, ''), chr(10))) AS n, coalesce(text, '') = '' OR right(text, 1) = chr(10) AS ended FROM documents)
SELECT CASE WHEN d = 2 THEN 'gen/' ELSE 'src/' END||doc_id||CASE d WHEN 3 THEN '/guide.md' WHEN 4 THEN '.txt' WHEN 8 THEN '.rs' ELSE '.py' END AS path,
 CASE d WHEN 0 THEN 'new-file' WHEN 1 THEN 'deleted' WHEN 2 THEN 'generated' WHEN 3 THEN 'import-line' WHEN 4 THEN 'unsupported' WHEN 5 THEN 'binary' WHEN 6 THEN 'code-modified' WHEN 7 THEN 'zh-in-string' ELSE 'zh-in-code-block' END AS code,
 CASE WHEN d = 6 THEN n + (n + 6) // 7 + CASE WHEN ended THEN 1 ELSE 0 END WHEN d > 6 THEN 9 END::BIGINT AS line, CASE WHEN d > 6 THEN (n + 1) // 7 - 1 ELSE 0 END AS others
FROM t WHERE d < 9 AND (d <> 3 OR doc_id % 20 >= 10) AND (d < 7 OR n >= 6)""", fixtures=False)
def verify_ladder(spark, sf):
    mine, theirs = X.checked(spark, sf)
    return verify.issues(mine, theirs, generated="^gen/", imports=(r"/guide\.md$", X.IMPORT))


@query(X.REATTACH_SQL + 'SELECT path, first, 1::BIGINT AS n, id, outcome, spot::BIGINT AS "at" FROM placed')
def reattach_blocks(spark, sf):
    return reattach.place(X.study(spark, sf), X.theirs(spark, sf), X.study_symbols(spark, sf), X.their_symbols(spark, sf))


@query(X.REATTACH_SQL + """SELECT coalesce(u.path, t.path) AS path, CASE WHEN u.path IS NULL THEN 'unsupported' WHEN t.path IS NULL THEN 'deleted' ELSE 'merged' END AS outcome, CASE WHEN u.path IS NOT NULL THEN sha256(m.text) END AS sha
FROM upstream u FULL JOIN theirs t ON u.path = t.path LEFT JOIN merged m ON m.path = t.path""")
def resolve_conflicts(spark, sf):
    sides = (X.upstream(spark, sf), X.study(spark, sf), X.theirs(spark, sf))
    rows = [side.select("path", F.lit(n).alias("stage"), "text") for n, side in enumerate(sides, 1)]
    stages = tables.changed_stages(rows[0].unionByName(rows[1]).unionByName(rows[2]))
    return reattach.resolve(stages, X.study_symbols(spark, sf), X.their_symbols(spark, sf)).select("path", "outcome", F.sha2("text", 256).alias("sha"))


@query(f"""SELECT path, CASE WHEN doc_id % 6 = 0 THEN 'rejected' ELSE 'applied' END AS outcome, sha256(CASE WHEN doc_id % 6 = 0 THEN text ELSE regexp_extract(text, '^[ \\t]*')||'# {T.MARKER} new'||chr(10)||text END) AS sha FROM upstream WHERE {X._strip("string_split(text, chr(10))[1]")} <> ''""")
def apply_patch(spark, sf):
    files = X.upstream(spark, sf).where(T.strip(F.get(T.lines(F.col("text")), F.lit(0))) != "")
    edit = F.struct(F.lit(0).alias("row"), F.lit(0).alias("seq"), F.lit(f"# {T.MARKER} new").alias("line"))
    wrong = F.struct(F.lit(1 << 20).alias("row"), F.lit(0).alias("seq"), F.lit(f"# {T.MARKER} lost").alias("line"))
    edits = files.select("path", F.explode(F.when(F.col("doc_id") % 6 == 0, F.array(edit, wrong)).otherwise(F.array(edit))).alias("e")).select("path", "e.row", "e.seq", "e.line")
    return work.apply_patch(files.select("path", "text"), edits).select("path", "outcome", F.sha2("text", 256).alias("sha"))


@query(f""", n AS (SELECT doc_id, path, text, string_split(text, chr(10)) AS l FROM upstream),
s AS (SELECT *, len(l) > 2 AND {X._strip("l[3]")} <> '' AS s1, len(l) > 4 AND doc_id % 6 <> 0 AND {X._strip("l[5]")} <> '' AS s2, len(l) > 12 AS s3, {X._strip("l[1]")} = '' AS top FROM n),
j AS (SELECT *, list_filter(['<module>:no-slot', 'gone:no-such-symbol', 'other:not-a-target', 's0:no-such-symbol', 's1:'||CASE WHEN len(l) > 2 THEN 'not-a-code-line' ELSE 'no-such-symbol' END, 's2:'||CASE WHEN len(l) > 4 THEN 'not-a-code-line' ELSE 'no-such-symbol' END, 's3:no-such-symbol'],
 lambda x, i: [doc_id % 4 = 0 AND NOT top, doc_id % 9 = 0, doc_id % 9 = 1, false, NOT s1, NOT s2, NOT s3][i]) AS lost,
 list_filter(['<module>', 's1', 's2', 's3'], lambda x, i: [doc_id % 4 = 0 AND top, s1, s2, s3][i]) AS good FROM s),
o AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 'changed' WHEN len(good) = 0 THEN 'unchanged' WHEN doc_id % 11 = 0 THEN 'rolled-back' ELSE 'applied' END AS outcome FROM j),
r AS (SELECT path, u, 2 AS k, 0 AS m, line FROM (SELECT path, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS u FROM o WHERE outcome = 'applied')
 UNION ALL SELECT path, u, 0, 0, '# {T.MARKER} n'||u FROM (SELECT path, good, unnest(range(0, len(l), 7)) AS u FROM o WHERE outcome = 'applied') WHERE NOT (u IN (14, 21, 28) AND list_contains(good, 's3')) AND NOT ((u = 0 OR u > 28) AND list_contains(good, '<module>'))
 UNION ALL SELECT path, u, 1, m, coalesce(regexp_extract(l[u + 1], '^[ \\t]*'), '')||'# {T.MARKER} '||w FROM o, (VALUES ('<module>', 0, 0, 'about'), ('s1', 2, 0, 'fresh'), ('s2', 4, 0, 'inner'), ('s3', 12, 0, 'two'), ('s3', 12, 1, 'lines')) v(symbol, u, m, w) WHERE outcome = 'applied' AND list_contains(good, symbol)),
t AS (SELECT path, string_agg(line, chr(10) ORDER BY u, k, m) AS made FROM r GROUP BY path)
SELECT o.path, outcome, CASE WHEN outcome = 'applied' THEN array_to_string(good, ' ') ELSE '' END AS applied, CASE WHEN outcome = 'changed' THEN '' ELSE array_to_string(list_sort(CASE WHEN outcome = 'rolled-back' THEN list_concat(lost, list_transform(good, lambda x: x||':rolled-back')) ELSE lost END), ' ') END AS rejected, sha256(coalesce(t.made, study.text)) AS sha
FROM o JOIN study USING (path) LEFT JOIN t ON t.path = o.path""")
def apply_answers(spark, sf):
    told, asked = X.answers(spark, sf)
    up = X.upstream(spark, sf).select("path", F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("text"))
    out = patch.apply(X.study(spark, sf).select("path", "text"), told, X.noted_symbols(spark, sf), up, asked)
    name = lambda x: F.substring_index(x, "#", -1)
    return out.select("path", "outcome", F.array_join(F.transform("applied", name), " ").alias("applied"), F.array_join(F.transform("rejected", lambda x: F.concat(name(x["symbol"]), F.lit(":"), x["reason"])), " ").alias("rejected"), F.sha2("text", 256).alias("sha"))


@query(", c AS (SELECT coalesce(a.path, b.path) AS path, a.text AS x, b.text AS y FROM upstream a FULL JOIN later b ON a.path = b.path WHERE a.text IS DISTINCT FROM b.text), l AS (SELECT path, unnest(string_split(x, chr(10))) AS line, -1 AS d FROM c WHERE x IS NOT NULL UNION ALL SELECT path, unnest(string_split(y, chr(10))), 1 FROM c WHERE y IS NOT NULL), e AS (SELECT path, line, sum(d) AS d FROM l GROUP BY ALL) SELECT path, sum(greatest(d, 0))::BIGINT AS added, sum(greatest(-d, 0))::BIGINT AS deleted FROM e GROUP BY path")
def numstat(spark, sf):
    return diff.numstat(X.upstream(spark, sf), X.later(spark, sf))


@query("SELECT path, CASE WHEN new THEN 'A' ELSE change END AS change FROM (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'A' WHEN b.path IS NULL THEN 'D' WHEN a.text <> b.text THEN 'M' END AS change, coalesce(b.doc_id % 14 = 0, false) AS new FROM upstream a FULL JOIN later b ON a.path = b.path) WHERE change IS NOT NULL OR new")
def untracked_override(spark, sf):
    later = X.later(spark, sf)
    return tables.overridden(diff.snapshot_diff(X.upstream(spark, sf), later), later.where("doc_id % 14 = 0"))


@query("SELECT path FROM upstream WHERE regexp_matches(path, '^src1[^/]*/') AND NOT regexp_matches(path, '7\\.py$') AND NOT regexp_matches(path, '^src1[12]/')")
def scope_filter(spark, sf):
    return X.upstream(spark, sf).where(T.in_scope(F.col("path"), ["/src1*/**"], ["*7.py"], ["src11/", "src12/"])).select("path")


@query("SELECT path, CASE WHEN path LIKE 'moved/%' THEN 'overlay' WHEN regexp_matches(path, '3\\.py$') THEN 'generated' WHEN doc_id % 5 = 0 THEN 'dependency' ELSE 'code' END AS class FROM (SELECT * REPLACE (CASE WHEN doc_id % 5 = 0 THEN replace(path, '.py', '/Cargo.toml') ELSE path END AS path) FROM later)")
def path_classes(spark, sf):
    path = F.when(F.col("doc_id") % 5 == 0, F.replace("path", F.lit(".py"), F.lit("/Cargo.toml"))).otherwise(F.col("path"))
    return X.later(spark, sf).select(path.alias("path")).select("path", verify.path_class(F.col("path"), "^moved/", r"3\.py$").alias("class"))


@query("SELECT path, a.text AS base, b.text AS ours, a.text||'!' AS theirs FROM upstream a LEFT JOIN later b USING (path)")
def merge_stages(spark, sf):
    up, later = X.upstream(spark, sf), X.later(spark, sf)
    rows = up.select("path", F.lit(1).alias("stage"), "text").unionByName(later.join(up.select("path"), "path", "left_semi").select("path", F.lit(2).alias("stage"), "text")).unionByName(up.select("path", F.lit(3).alias("stage"), F.concat("text", F.lit("!")).alias("text")))
    return tables.merge_stages(rows)


@query("SELECT path, sha1(text) AS sha FROM later WHERE sha1(text) NOT IN (SELECT sha1(text) FROM upstream)")
def cache_misses(spark, sf):
    files = X.later(spark, sf).select("path", F.sha1("text").alias("sha"))
    return tables.misses(files, X.upstream(spark, sf).select(F.sha1("text").alias("sha")))


@query("SELECT l.path, length(l.text) - length(replace(l.text, ' ', '')) + 1 AS words, u.path IS NULL OR u.text <> l.text AS fresh FROM later l LEFT JOIN upstream u ON u.path = l.path")
def made_anew(spark, sf):
    made = S.StructType.fromDDL("path string, words long")
    count = lambda some: some.select("path", F.size(F.split("text", " ")).cast("long").alias("words"))
    table = tables.own_folder(spark)
    cache.made(X.upstream(spark, sf), count, made, table)
    rows, fresh = cache.made(X.later(spark, sf), count, made, table)
    return rows.join(fresh.select("path", F.lit(True).alias("fresh")), "path", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))


@query("SELECT path, sha256(text) AS sha FROM study WHERE path LIKE '%7.py'")
def written_files(spark, sf):
    folder = tables.own_folder(spark)
    files.write_files(X.study(spark, sf), folder)
    return files.worktree(spark, folder, ["*7.py"]).select("path", F.sha2("text", 256).alias("sha"))


# --- numbering, versions, registry ---


@query("SELECT p_partkey, p_name || CASE WHEN n = 1 THEN '' ELSE '~' || n END AS id FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)", fixtures=False)
def dedupe_ids(spark, sf):
    n = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey"))
    return X.read(spark, sf, "part").select("p_partkey", "p_name", n.alias("n")).select("p_partkey", F.concat("p_name", F.when(F.col("n") == 1, "").otherwise(F.concat(F.lit("~"), "n"))).alias("id"))


def _tags(spark: SparkSession, sf: str) -> DataFrame:
    o = X.read(spark, sf, "orders").join(X.read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return o.select(F.col("c_nationkey").cast("long").alias("project"), F.concat(F.lit("v"), F.month("o_orderdate"), F.lit("."), F.dayofmonth("o_orderdate"), F.lit("."), F.col("o_orderkey") % 13).alias("tag")).distinct()


_TAGS_SQL = """WITH tags AS (SELECT DISTINCT c_nationkey::BIGINT AS project, 'v'||month(o_orderdate)||'.'||day(o_orderdate)||'.'||(o_orderkey % 13) AS tag FROM orders JOIN customer ON o_custkey = c_custkey),
k AS (SELECT *, list_transform(regexp_extract_all(tag, '\\d+'), lambda x: x::BIGINT) AS v FROM tags)
"""


@query(_TAGS_SQL + ", a AS (SELECT n_nationkey::BIGINT AS project, 'v'||(n_nationkey % 12 + 1)||'.15.0' AS ref, [n_nationkey % 12 + 1, 15, 0]::BIGINT[] AS rv FROM nation) SELECT a.project, a.ref, arg_max(tag, v) AS latest, count(*) FILTER (v > rv) AS behind FROM a LEFT JOIN k ON k.project = a.project GROUP BY a.project, a.ref", fixtures=False)
def behind_count(spark, sf):
    anchors = X.read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("project"), F.concat(F.lit("v"), F.col("n_nationkey") % 12 + 1, F.lit(".15.0")).alias("ref"))
    return registry.behind(_tags(spark, sf), anchors)


@query(_TAGS_SQL + "SELECT tag, v[1] AS major, dense_rank() OVER (PARTITION BY v[1] ORDER BY v) AS rank FROM (SELECT DISTINCT tag, v FROM k)", fixtures=False)
def version_rank(spark, sf):
    return registry.version_rank(_tags(spark, sf))


@query("SELECT n_name AS project, coalesce(p, 99)::BIGINT AS priority, coalesce(printf('%.1f%%', c * 100), '—') AS coverage, z AS zh_lines FROM (SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey % 4 END AS p, count(*) FILTER (c_mktsegment = 'BUILDING')::DOUBLE / nullif(count(c_custkey), 0) AS c, count(c_custkey) AS z FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)", fixtures=False)
def registry_status(spark, sf):
    nation = X.read(spark, sf, "nation")
    projects = nation.select(F.col("n_name").alias("project"), F.when(F.col("n_nationkey") % 4 > 0, F.col("n_nationkey") % 4).cast("long").alias("priority"))
    rows = X.read(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "right").groupBy(F.col("n_name").alias("project"))
    return registry.status_rows(projects, rows.agg(F.try_divide(F.count_if(F.col("c_mktsegment") == "BUILDING"), F.count("c_custkey")).alias("coverage"), F.count("c_custkey").alias("zh_lines")))


@query("SELECT coalesce(r_name, 'key'||k) AS category, r_regionkey::BIGINT AS pos, n_name AS project FROM (SELECT n_name, unnest([n_regionkey, n_nationkey % 7]) AS k FROM nation) LEFT JOIN region ON r_regionkey = k", fixtures=False)
def registry_tree(spark, sf):
    key = lambda c: F.concat(F.lit("key"), c)
    projects = X.read(spark, sf, "nation").select(F.col("n_name").alias("project"), F.array(key(F.col("n_regionkey")), key(F.col("n_nationkey") % 7)).alias("categories"))
    categories = X.read(spark, sf, "region").select(key(F.col("r_regionkey")).alias("id"), F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("pos"))
    return registry.tree(projects, categories)


@query("WITH RECURSIVE e AS (SELECT n_nationkey::BIGINT AS sha, p::BIGINT AS parent FROM (SELECT n_nationkey, unnest([n_nationkey // 2, n_nationkey - 3]) AS p FROM nation WHERE n_nationkey > 2)), a(sha, ancestor) AS (SELECT n_nationkey::BIGINT, n_nationkey::BIGINT FROM nation UNION SELECT a.sha, e.parent FROM a JOIN e ON a.ancestor = e.sha) SELECT sha, ancestor FROM a", fixtures=False)
def ancestry(spark, sf):
    n = X.read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("sha"))
    parents = n.where("sha > 2").select("sha", F.explode(F.array(F.floor(F.col("sha") / 2), F.col("sha") - 3)).alias("parent"))
    return registry.ancestors(parents, n)


@query("WITH RECURSIVE e AS (SELECT n_nationkey::BIGINT AS sha, p::BIGINT AS parent FROM (SELECT n_nationkey, unnest([n_nationkey // 2, n_nationkey - 3]) AS p FROM nation WHERE n_nationkey > 2)), a(sha) AS (SELECT 24::BIGINT UNION SELECT e.parent FROM a JOIN e USING (sha)), b(sha) AS (SELECT 12::BIGINT UNION SELECT e.parent FROM b JOIN e USING (sha)) SELECT sha FROM a WHERE sha NOT IN (SELECT sha FROM b) AND sha NOT IN (SELECT sha FROM (SELECT DISTINCT * FROM e) GROUP BY sha HAVING count(*) > 1)", fixtures=False)
def commit_range(spark, sf):
    n = X.read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("sha"))
    parents = n.where("sha > 2").select("sha", F.explode(F.array(F.floor(F.col("sha") / 2), F.col("sha") - 3)).alias("parent"))
    return registry.commit_range(parents, n.where("sha = 12"), n.where("sha = 24"))


@query("""WITH RECURSIVE e AS (SELECT o_orderkey AS sha, unnest([o_orderkey - o_orderkey % 97 - 1, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey - 11 END]) AS parent FROM orders), q AS (SELECT 100 + r_regionkey * 13 AS old, m - r_regionkey AS new FROM region, (SELECT max(o_orderkey) AS m FROM orders)),
a(new, sha) AS (SELECT new, new FROM q UNION SELECT a.new, e.parent FROM a JOIN e USING (sha) WHERE e.parent > 0)
SELECT q.old::BIGINT AS old, q.new::BIGINT AS new, EXISTS (SELECT 1 FROM a WHERE a.new = q.new AND a.sha = q.old) AS yes FROM q""", fixtures=False)
def is_ancestor(spark, sf):
    k = F.col("o_orderkey")
    up = F.array(k - k % 97 - 1, F.when(k % 5 == 0, k - 11))
    orders = X.read(spark, sf, "orders")
    parents = orders.select(k.alias("sha"), F.explode(up).alias("parent")).where("parent > 0")
    r = F.col("r_regionkey")
    pairs = X.read(spark, sf, "region").crossJoin(F.broadcast(orders.agg(F.max("o_orderkey").alias("m")))).select((100 + r * 13).cast("long").alias("old"), (F.col("m") - r).alias("new"))  # one row
    return registry.is_ancestor(parents, pairs)


# --- documents about code ---


def _notes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents from labels, the hashes their anchors have now, the records of before."""
    old, new = X.old_symbols(spark, sf), X.new_symbols(spark, sf)
    ids = old.select("doc_id", "id")
    d = X.read(spark, sf, "labels").join(ids, "doc_id").select("doc_id", F.concat(F.lit("notes/"), "doc_id").alias("path"), F.when(F.col("doc_id") % 5 == 4, F.array().cast("array<string>")).otherwise(F.array("id")).alias("anchors"), T.short_sha(F.concat("quality", F.when(F.col("doc_id") % 8 == 0, "new").otherwise(""))).alias("body_sha"), T.short_sha(F.col("quality").cast("string")).alias("was_sha"))
    d = settled(d)
    anchors = d.select(F.explode("anchors").alias("anchor"))
    then = notes.anchor_hashes(anchors, old)
    was = d.where("doc_id % 10 <> 3").join(then, F.get("anchors", F.lit(0)) == F.col("anchor"), "left").select("path", F.col("was_sha").alias("sha"), F.when(F.col("anchor").isNotNull(), F.create_map("anchor", "hash")).otherwise(F.create_map().cast("map<string,string>")).alias("anchors"))
    return d.select("path", "body_sha", "anchors"), notes.anchor_hashes(anchors, new), was


_NOTES_SQL = """, nt AS (SELECT l.doc_id, 'notes/'||l.doc_id AS path, CASE WHEN l.doc_id % 5 <> 4 THEN o.id END AS anchor, left(sha256(quality||CASE WHEN l.doc_id % 8 = 0 THEN 'new' ELSE '' END),12) AS body_sha, left(sha256(quality::VARCHAR),12) AS was_sha,
 left(sha256(o.sig||'|'||o.doc||'|'||o.body),12) AS was_hash, left(sha256(n.sig||'|'||n.doc||'|'||n.body),12) AS hash FROM labels l JOIN olds o ON o.doc_id = l.doc_id LEFT JOIN news n ON n.id = o.id),
ns AS (SELECT *, CASE WHEN anchor IS NULL THEN 'unanchored' WHEN hash IS NULL THEN 'broken' WHEN doc_id % 10 = 3 OR was_sha <> body_sha THEN 'new' WHEN was_hash <> hash THEN 'stale' ELSE 'current' END AS status FROM nt)
"""


@query(_NOTES_SQL + "SELECT path, status FROM ns")
def doc_status(spark, sf):
    return notes.derive(*_notes(spark, sf)).select("path", "status")


@query(_NOTES_SQL + "SELECT v.status, count(ns.path) AS n FROM (VALUES ('current'),('stale'),('broken'),('unanchored'),('new')) v(status) LEFT JOIN ns ON ns.status = v.status GROUP BY v.status")
def doc_summary(spark, sf):
    return notes.summary(notes.derive(*_notes(spark, sf)))


@query(_NOTES_SQL + """, m AS (SELECT path, CASE WHEN doc_id % 7 = 0 AND status NOT IN ('broken','unanchored') THEN 'approved' WHEN status = 'new' THEN 'recorded' WHEN doc_id % 10 <> 3 THEN 'kept' END AS action, body_sha, was_sha FROM ns)
SELECT path, action, CASE WHEN action = 'kept' THEN was_sha ELSE body_sha END AS sha FROM m WHERE action IS NOT NULL""")
def doc_state_update(spark, sf):
    d, h, r = _notes(spark, sf)
    ok = d.where(F.substring_index("path", "/", -1).cast("long") % 7 == 0).select("path")
    return notes.merge(notes.derive(d, h, r), r, ok).select("path", "action", "sha")


# --- reports ---


@query(f"""SELECT path, CASE d WHEN 0 THEN 0 ELSE (len(string_split(text, chr(10))) + 6) // 7 END AS n FROM (SELECT path||CASE WHEN doc_id % 3 = 1 THEN '.rs' WHEN doc_id % 3 = 2 THEN '.sql' ELSE '' END AS path, text, doc_id % 4 AS d FROM upstream)""")
def annotation_counts(spark, sf):
    d = F.col("doc_id") % 3
    token = F.when(d == 1, "//!").when(d == 2, "--").otherwise("#")
    text = F.when(F.col("doc_id") % 4 == 0, F.replace("text", F.lit("# 【"), F.lit("* 【"))).otherwise(F.replace("text", F.lit("# 【"), F.concat(token, F.lit(" 【"))))
    some = X.study(spark, sf).select(F.concat("path", F.when(d == 1, ".rs").when(d == 2, ".sql").otherwise("")).alias("path"), text.alias("text"))
    return lines.annotation_counts(some)


def _commits(spark: SparkSession, sf: str) -> DataFrame:
    """A commit for each order of the first customers, each with a file."""
    k = F.col("o_orderkey")
    file = F.when(k % 5 == 0, F.concat(F.lit("lib/"), k % 11, F.lit("/Cargo.toml"))).otherwise(F.concat(F.lit("lib/"), k % 13, F.lit(".rs")))
    return X.read(spark, sf, "orders").select(k.alias("pos"), F.sha1(k.cast("string")).alias("sha"), F.col("o_orderpriority").alias("title"), file.alias("path"))


_REPORT_SQL = _DIFF_SQL + _MERGE_SQL + _NOTES_SQL + X.REATTACH_SQL + """, rep AS (SELECT 'stale' AS section, priority||' '||id AS key, changed AS text FROM stat WHERE status = 'stale'
 UNION ALL SELECT 'documents', path, status FROM ns WHERE status IN ('stale', 'broken')
 UNION ALL SELECT change_type, id, CASE WHEN change_type = 'modified' THEN changed ELSE '' END FROM d WHERE change_type IS NOT NULL UNION ALL SELECT 'renamed', old_id, new_id FROM ren
 UNION ALL SELECT DISTINCT 'dependencies', 'lib/'||(o_orderkey % 11)||'/Cargo.toml', '' FROM orders WHERE o_orderkey % 5 = 0
 UNION ALL SELECT 'orphaned', id, '' FROM mrec WHERE action = 'dropped' UNION ALL SELECT 'migrated', old_id, id FROM mrec WHERE action = 'migrated'
 UNION ALL SELECT 'orphaned', id||' @'||first, '1' FROM placed WHERE outcome = 'orphaned' UNION ALL SELECT 'relocated', id||' @'||first, spot::VARCHAR FROM placed WHERE outcome = 'relocated'
 UNION ALL SELECT 'resolved', path, count(*) FILTER (outcome = 'reattached')||' '||count(*) FILTER (outcome = 'relocated')||' '||count(*) FILTER (outcome = 'orphaned') FROM placed GROUP BY path
 UNION ALL SELECT 'unsupported', path, ((len(string_split(text, chr(10))) + 6) // 7)::VARCHAR FROM upstream WHERE doc_id % 10 = 3
 UNION ALL SELECT 'commits', printf('%09d', o_orderkey)||' '||left(sha1(o_orderkey::VARCHAR), 9), o_orderpriority FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 500)
 UNION ALL SELECT 'commits', '~', (count(*) - 500)::VARCHAR FROM orders HAVING count(*) > 500)
"""


def _sync_report(spark: SparkSession, sf: str) -> DataFrame:
    old, new, recs = X.old_symbols(spark, sf), settled(X.new_symbols(spark, sf)), settled(X.records(spark, sf))
    placed = reattach.place(X.study(spark, sf), X.theirs(spark, sf), X.study_symbols(spark, sf), X.their_symbols(spark, sf))
    counts = lines.annotation_counts(X.study(spark, sf).where("doc_id % 10 = 3"))
    return reports.sync_report(diff.symbol_diff(old, new), diff.rename_pairs(old, new), state.derive(new, recs), notes.derive(*_notes(spark, sf)), _commits(spark, sf), state.merge(recs, new, "me"), settled(placed), counts)


@query(_REPORT_SQL + "SELECT * FROM rep")
def sync_report(spark, sf):
    return _sync_report(spark, sf)


@query(_REPORT_SQL + f""", s AS (SELECT *, list_position({list(reports.SECTIONS)}, section) AS place, row_number() OVER (PARTITION BY section ORDER BY key, text) AS pos FROM rep)
SELECT place AS section, pos, '- `'||key||'`'||CASE WHEN text <> '' THEN ' '||text ELSE '' END AS line FROM s UNION ALL SELECT place, 0, chr(10)||'## '||section||' ('||count(*)||')'||chr(10) FROM s GROUP BY place, section UNION ALL SELECT 0, 0, '# Sync'""")
def sync_markdown(spark, sf):
    return reports.markdown(_sync_report(spark, sf), "Sync")


@query(""", e AS (SELECT path, count(*) AS n, count(*) FILTER (status <> 'pending') AS done, count(*) FILTER (status = 'reviewed') AS reviewed, count(*) FILTER (status = 'stale') AS stale FROM stat WHERE translatable OR status <> 'pending' GROUP BY path),
g AS (SELECT *, CASE WHEN path LIKE 'moved/%' THEN 'moved/'||split_part(path, '/', 2) ELSE split_part(path, '/', 1) END AS grp FROM e WHERE done > 0)
SELECT grp, count(*) AS files, '<h3>'||grp||'</h3><table>'||chr(10)||string_agg('<tr><td><a href=''src/'||path||'.html''>'||path[len(grp)+2:]||'</a></td><td><i style=''width:'||round(done * 100 / n)::INTEGER||'%''></i></td><td>'||done||' / '||n||'</td><td>'||CASE WHEN reviewed > 0 THEN reviewed::VARCHAR ELSE '' END||'</td><td>'||CASE WHEN stale > 0 THEN stale::VARCHAR ELSE '' END||'</td></tr>', chr(10) ORDER BY path)||chr(10)||'</table>' AS html FROM g GROUP BY grp""")
def site_index(spark, sf):
    return reports.site_index(_derived(spark, sf), 2)


@query("SELECT page_id, left(html, 500) AS html FROM pages", fixtures=False)
def text_heads(spark, sf):
    return work.clipped(X.read(spark, sf, "pages").select("page_id", "html"), "html", 500)


# --- glossaries ---


_TERMS_SQL = """WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+|[^a-z]') AS t FROM benchmark),
e AS (SELECT item_id, unnest(t) AS w, unnest(t[2:] || [NULL]) AS gap, unnest(t[3:] || [NULL, NULL]) AS nxt FROM w),
d AS (SELECT item_id % 7 AS p, CASE WHEN length(w) % 6 = 5 THEN 'Bad-' ELSE '' END||w AS key, w AS en, '译'||min(item_id) AS zh, CASE WHEN length(w) % 5 = 4 THEN ['译'||min(item_id)] ELSE [] END||[w[1:3]] AS avoid, list_sort(list(DISTINCT w||' '||nxt) FILTER (gap = ' ' AND nxt ~ '[a-z]+')) AS aliases FROM e WHERE length(w) > 3 AND w ~ '[a-z]+' GROUP BY item_id % 7, w),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY p DESC) AS n FROM d) WHERE n = 1),
fm AS (SELECT DISTINCT key, lower(f) AS form FROM (SELECT key, unnest([en, key] || coalesce(aliases, [])) AS f FROM m))
"""
_MENTIONS_SQL = """, x AS (SELECT {key}, t, unnest(t) AS a, unnest(t[2:] || [NULL]) AS gap, unnest(t[3:] || [NULL, NULL]) AS b FROM (SELECT {key}, regexp_extract_all(lower({text}), '[a-z]+|[^a-z]') AS t FROM {source})),
y AS (SELECT DISTINCT {key}, unnest([a, a||' '||b, a||'-'||b]) AS form, unnest([true, gap = ' ', gap = '-']) AS ok FROM x),
mt AS (SELECT DISTINCT {key}, key FROM y JOIN fm USING (form) WHERE ok)
"""


@query(_TERMS_SQL + "SELECT key, 'd'||p AS domain, zh FROM m", fixtures=False)
def term_merge(spark, sf):
    return terms.merge(X.glossary(spark, sf)).select("key", "domain", "zh")


@query(_TERMS_SQL + """, f AS (SELECT *, first_value(zh) OVER (PARTITION BY key ORDER BY p) AS first FROM d)
SELECT key, 'd'||p AS domain, 'avoids-itself' AS problem FROM f WHERE list_contains(avoid, zh) UNION ALL SELECT key, 'd'||p, 'conflict' FROM f WHERE zh <> first UNION ALL SELECT key, 'd'||p, 'bad-key' FROM f WHERE key LIKE 'Bad-%'""", fixtures=False)
def term_validate(spark, sf):
    return terms.validate(X.glossary(spark, sf))


@query(_TERMS_SQL + _MENTIONS_SQL.format(key="doc_id", text="coalesce(text, '')", source="documents") + "SELECT doc_id, key FROM mt", fixtures=False)
def relevant_terms(spark, sf):
    return terms.relevant(X.read(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), settled(terms.merge(X.glossary(spark, sf))), "doc_id")


@query(_TERMS_SQL + """, ln AS (SELECT source||'/'||doc_id||'.py' AS path, unnest(string_split(coalesce(text,''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text,''), chr(10)), 1)::BIGINT - 1 AS "row" FROM documents),
l AS (SELECT path, "row", line, concat_ws(chr(10), lag(line) OVER (PARTITION BY path ORDER BY "row"), line) AS seen FROM ln)""" + _MENTIONS_SQL.format(key='path, "row"', text="seen", source="l") + """SELECT path, "row", bad, key FROM mt JOIN (SELECT key, unnest(list_distinct(avoid)) AS bad FROM m) USING (key) JOIN l USING (path, "row") WHERE contains(line, bad)""", fixtures=False)
def term_lint(spark, sf):
    rows = lines.lines_with_above(X.upstream(spark, sf))
    return terms.lint(rows.select("path", "row", F.col("line").alias("text"), F.col("above").alias("context")), settled(terms.merge(X.glossary(spark, sf))))


# --- planning and taking in ---


_USES_SQL = """WITH w AS (SELECT page_id, regexp_extract_all(html, '[\\p{L}\\p{N}_]+') AS ws FROM pages),
x AS (SELECT page_id, unnest(list_filter(ws, lambda y: regexp_full_match(y, '[A-Z][A-Za-z0-9_]*[a-z][A-Za-z0-9_]*'))) AS name, generate_subscripts(list_filter(ws, lambda y: regexp_full_match(y, '[A-Z][A-Za-z0-9_]*[a-z][A-Za-z0-9_]*')), 1) - 1 AS pos FROM w),
u AS (SELECT page_id AS path, name, count(*) AS n, min(pos) AS first FROM x GROUP BY ALL)
"""


@query(_USES_SQL + "SELECT path AS doc_id, name, n, first FROM u", fixtures=False)
def ident_freq(spark, sf):
    return work.identifiers(X.read(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")), "doc_id")


@query(_USES_SQL + """, t AS (SELECT DISTINCT path, name FROM u WHERE n >= 2), o AS (SELECT name, min(path) AS defined_in FROM t GROUP BY name HAVING min(path) = max(path)),
r AS (SELECT u.path, u.name, o.defined_in, u.n, row_number() OVER (PARTITION BY u.path ORDER BY u.n DESC, u.first) AS k FROM u JOIN o USING (name) WHERE u.path <> o.defined_in)
SELECT path, name, defined_in, n FROM r WHERE k <= 12""", fixtures=False)
def type_refs(spark, sf):
    uses = work.identifiers(X.read(spark, sf, "pages").select(F.col("page_id").alias("path"), F.col("html").alias("text")), "path")
    return work.type_refs(uses, uses.where("n >= 2").select("name", "path"))


@query("""SELECT src AS path, id, floor((row_number() OVER (PARTITION BY src ORDER BY status <> 'stale', ord, id) - 1) / 20)::BIGINT AS chunk FROM (SELECT *, split_part(path, '/', 1) AS src FROM stat WHERE status IN ('stale','pending')) WHERE translatable OR status <> 'pending'""")
def translate_plan(spark, sf):
    rows = _derived(spark, sf).where("status IN ('stale', 'pending') AND (translatable OR status <> 'pending')")
    return work.requests(rows.select(F.substring_index("path", "/", 1).alias("path"), "id", "status", F.col("ord").alias("start")), 20)


@query("SELECT 'bench/'||(item_id % 7) AS path, sum(CASE WHEN item_id < 14 THEN strlen(text)//3 ELSE 0 END)::BIGINT AS fresh, sum(CASE WHEN item_id >= 14 THEN strlen(text)//3 ELSE 0 END)::BIGINT AS cached FROM benchmark GROUP BY 1", fixtures=False)
def token_estimate(spark, sf):
    b = X.read(spark, sf, "benchmark")
    return _long(work.token_estimate(b.select(F.concat(F.lit("bench/"), F.col("item_id") % 7).alias("path"), "text", F.when(F.col("item_id") < 14, 0).otherwise(1).alias("chunk"))), "fresh", "cached")


@query("SELECT path, CASE WHEN doc_id % 4 = 3 THEN 'unknown' WHEN doc_id % 6 = 0 THEN 'unreadable' WHEN u.text IS DISTINCT FROM l.text THEN 'changed' ELSE 'ok' END AS outcome FROM upstream u LEFT JOIN (SELECT path, text FROM later) l USING (path)")
def batch_collect(spark, sf):
    old, new = X.upstream(spark, sf), X.later(spark, sf)
    sent = old.where("doc_id % 4 <> 3").select("path", F.sha1("text").alias("sha"))
    answers = old.select("path", F.when(F.col("doc_id") % 6 == 0, "{oops").otherwise('{"annotations": []}').alias("body"))
    return work.collect_responses(answers, sent, new.select("path", F.sha1("text").alias("sha")))


@query("SELECT event_type, json_extract_string(props, '$.k')::BIGINT % 10 AS k, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY ALL", fixtures=False)
def props_json(spark, sf):
    e = X.read(spark, sf, "events").withColumn("k", F.from_json("props", "k long")["k"] % 10)
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT item_id, CASE WHEN len(ls) > 9 THEN array_to_string(ls[1:9], chr(10))||chr(10)||'…' ELSE array_to_string(ls, chr(10)) END AS text FROM (SELECT item_id, string_split(replace(text, ' ', chr(10)), chr(10)) AS ls FROM benchmark)", fixtures=False)
def definition_heads(spark, sf):
    return work.heads(X.read(spark, sf, "benchmark").select("item_id", F.replace("text", F.lit(" "), F.lit("\n")).alias("text")), 9)


@query("SELECT conv_id AS path, array_to_string(flatten(list(string_split(coalesce(text,''), chr(10)) ORDER BY turn)), '|') AS said FROM conversations GROUP BY conv_id", fixtures=False)
def merge_chunks(spark, sf):
    c = X.read(spark, sf, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("chunk"), T.lines(F.coalesce("text", F.lit(""))).alias("annotations"))
    return work.merged_chunks(c).select("path", F.array_join("annotations", "|").alias("said"))


@query("SELECT CASE WHEN page_id % 3 = 0 THEN 'Edit' ELSE 'Read' END AS tool, CASE WHEN page_id % 4 = 1 THEN NULL ELSE 'p/'||page_id||'.py' END AS path FROM pages WHERE page_id % 5 > 0", fixtures=False)
def hook_paths(spark, sf):
    d = F.col("page_id")
    file = F.concat(F.when(d % 4 == 0, "").when(d % 4 == 1, "/elsewhere/").otherwise("/w/"), F.lit("p/"), d, F.lit(".py"))
    body = F.to_json(F.struct(F.when(d % 3 == 0, "Edit").otherwise("Read").alias("tool_name"), F.struct(F.when(d % 5 > 0, file).alias("file_path")).alias("tool_input"), F.lit("/w/").alias("cwd"), "url"))
    return work.hook_paths(X.read(spark, sf, "pages").select(body.alias("body")))


@query("SELECT path, code, line, n - 1 AS others FROM (SELECT path, arg_min(code, k) AS code, min(line) AS line, count(*) AS n FROM (SELECT path, 'len'||(length(line) % 5) AS code, \"row\" AS line, \"row\" * 100 + length(line) % 5 AS k FROM ulines WHERE length(line) % 3 = 1) GROUP BY path)")
def issue_rollup(spark, sf):
    rows = lines.explode_lines(X.upstream(spark, sf)).where(F.length("line") % 3 == 1)
    return verify.rolled_up(rows.select("path", F.concat(F.lit("len"), F.length("line") % 5).alias("code"), F.col("row").alias("line")))


@query("SELECT id FROM news WHERE doc_id % 50 = 7 OR path LIKE 'src1/%' OR path LIKE 'moved/%'")
def approval_targets(spark, sf):
    symbols = X.new_symbols(spark, sf)
    return state.chosen(symbols, symbols.where("doc_id % 50 = 7").select("id"), ["src1", "moved/"]).select("id")


@query("SELECT id, priority, total FROM (SELECT id, priority, row_number() OVER (ORDER BY priority, id) AS k, count(*) OVER () AS total FROM stat WHERE status = 'stale') WHERE k <= 25")
def queue_page(spark, sf):
    return state.first_of(_derived(spark, sf).where("status = 'stale'").select("id", "priority"), 25, "priority", "id")


@query("SELECT c_name AS project, CASE WHEN c_custkey % 6 = 1 THEN NULL ELSE round(c_custkey % 100 / 100.0, 2)::DOUBLE END AS coverage, CASE WHEN c_custkey % 6 = 1 THEN NULL ELSE c_nationkey END::BIGINT AS zh_lines, c_custkey % 6 <> 1 AS ok FROM customer", fixtures=False)
def remote_status(spark, sf):
    k = F.col("c_custkey")
    told = F.to_json(F.struct(F.round(k % 100 / 100, 2).alias("coverage"), F.col("c_nationkey").alias("zh_lines"), "c_name"))
    tries = F.array(F.struct(F.lit(1).alias("attempt"), F.when(k % 3 > 0, "404: not here").otherwise(told).alias("body")), F.struct(F.lit(2).alias("attempt"), F.when(k % 6 == 1, "{}").otherwise(told).alias("body")))
    return registry.remote_status(X.read(spark, sf, "customer").select(F.col("c_name").alias("project"), F.explode(tries).alias("t")).select("project", "t.*"))


@query("SELECT o_custkey AS source, max(o_orderdate) AS fetched, arg_max(o_orderkey, (epoch(o_orderdate), o_orderkey::VARCHAR))::VARCHAR AS body, epoch(TIMESTAMP '1998-01-01') - epoch(max(o_orderdate)) > 86400 * 30 AS stale FROM orders GROUP BY o_custkey", fixtures=False)
def glossary_cache(spark, sf):
    o = X.read(spark, sf, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderdate").alias("fetched"), F.col("o_orderkey").cast("string").alias("body"))
    return tables.freshest(o, F.lit("1998-01-01 00:00:00").cast("timestamp"), 24 * 30)


@query("SELECT n_name AS project, r_regionkey::BIGINT AS priority FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 9 FROM region", fixtures=False)
def registry_entry(spark, sf):
    n = X.read(spark, sf, "nation").select(F.col("n_name").alias("project"), F.col("n_regionkey").cast("long").alias("priority"))
    new = X.read(spark, sf, "region").select(F.col("r_name").alias("project"), F.lit(9).cast("long").alias("priority"))
    return registry.onboard(n, new.unionByName(n.where("priority = 2").withColumn("priority", F.lit(7).cast("long"))))


# --- symbols of source files, by table functions ---


def _sources(spark: SparkSession, sf: str, suffix: str, code: str) -> DataFrame:
    """A file for each document: code with a function for each of its lines."""
    ls = T.lines(F.coalesce("text", F.lit("")))
    body = F.array_join(F.transform(ls, lambda l, i: F.replace(F.replace(F.lit(code), F.lit("@N"), i.cast("string")), F.lit("@L"), F.length(l).cast("string"))), "\n")
    return X.read(spark, sf, "documents").select(F.concat("source", F.lit("/"), "doc_id", F.lit(suffix)).alias("path"), body.alias("text"))


_FOUND = ("path", "kind", "qualname", "start", "item_row", "end", "body_lines")
_ROW_SQL = """WITH l AS (SELECT source||'/'||doc_id||'{suffix}' AS path, unnest(generate_series(0, len(string_split(coalesce(text,''), chr(10))) - 1)) AS i, len(string_split(coalesce(text,''), chr(10))) AS n FROM documents),
m AS (SELECT path, 'module' AS kind, '<module>' AS qualname, 0 AS start, 0 AS item_row, max(n) * {rows} - 1 AS "end", 0 AS body_lines FROM l GROUP BY path)
SELECT path, kind, qualname, start::INTEGER AS start, item_row::INTEGER AS item_row, "end"::INTEGER AS "end", body_lines::INTEGER AS body_lines FROM (SELECT * FROM m UNION ALL SELECT path, '{kind}', '{name}'||i, i * {rows}, i * {rows} + {item}, i * {rows} + {end}, {body} FROM l{more})"""


@query(_ROW_SQL.format(suffix=".py", rows=5, kind="fn", name="f", item=1, end=3, body=1, more=""), fixtures=False)
def python_symbols(spark, sf):
    return index.symbols(_sources(spark, sf, ".py", '# note @N\ndef f@N(x):\n    """Doc @L."""\n    return x\n')).select(*_FOUND)


@query(_ROW_SQL.format(suffix=".pyx", rows=4, kind="class", name="C", item=0, end=2, body=2, more=" UNION ALL SELECT path, 'method', 'C'||i||'.go', i * 4 + 1, i * 4 + 1, i * 4 + 2, 1 FROM l"), fixtures=False)
def cython_symbols(spark, sf):
    return index.symbols(_sources(spark, sf, ".pyx", "cdef class C@N:\n    cpdef int go(self, int a):\n        return @L\n")).select(*_FOUND)


@query(_ROW_SQL.format(suffix=".rs", rows=5, kind="fn", name="f", item=1, end=3, body=3, more=""), fixtures=False)
def brace_symbols(spark, sf):
    return index.symbols(_sources(spark, sf, ".rs", '/// Note {@N.\npub fn f@N(x: i32) -> i32 {\n    let s = "}"; x + @L\n}\n')).select(*_FOUND)


@query(_ROW_SQL.format(suffix=".go", rows=6, kind="type", name="Lot", item=1, end=1, body=0, more=" UNION ALL SELECT path, 'fn', 'Lot'||i||'.Weigh', i * 6 + 2, i * 6 + 3, i * 6 + 4, 2 FROM l"), fixtures=False)
def go_symbols(spark, sf):
    return index.symbols(_sources(spark, sf, ".go", "// Lot @N.\ntype Lot@N = map[string]int\n// Weighs {.\nfunc (l *Lot@N[T]) Weigh(by int) int {\nreturn by * @L }\n")).select(*_FOUND)


@query(_ROW_SQL.format(suffix=".ts", rows=6, kind="class", name="Crate", item=0, end=3, body=4, more=" UNION ALL SELECT path, 'method', 'Crate'||i||'.lift', i * 6 + 1, i * 6 + 1, i * 6 + 2, 2 FROM l UNION ALL SELECT path, 'fn', 'drop'||i, i * 6 + 4, i * 6 + 4, i * 6 + 4, 1 FROM l"), fixtures=False)
def typescript_symbols(spark, sf):
    return index.symbols(_sources(spark, sf, ".ts", "export class Crate@N {\n  lift(kg: number): string {\n    return `}@L`; }\n}\nexport const drop@N = (x: number) => { return x + @L }\n")).select(*_FOUND)


@query(_ROW_SQL.format(suffix=".hpp", rows=7, kind="mod", name="bay", item=0, end=5, body=6, more=" UNION ALL SELECT path, 'struct', 'bay'||i||'::Pallet', i * 7 + 1, i * 7 + 2, i * 7 + 4, 3 FROM l UNION ALL SELECT path, 'fn', 'bay'||i||'::Pallet::weight', i * 7 + 3, i * 7 + 3, i * 7 + 3, 1 FROM l"), fixtures=False)
def cpp_symbols(spark, sf):
    return index.symbols(_sources(spark, sf, ".hpp", "namespace bay@N {\n// A pallet; of wood.\nstruct Pallet {\n  int weight() const { return @L; }\n};\n} // bay\n")).select(*_FOUND)


@query("""SELECT source||'/'||doc_id||'.py' AS path, i * 3 + 1 AS "row", 'zh-in-string' AS code FROM (SELECT source, doc_id, unnest(generate_series(0, len(string_split(coalesce(text,''), chr(10))) - 1)) AS i FROM documents)""", fixtures=False)
def placement_lint(spark, sf):
    return placement.misplaced(_sources(spark, sf, ".py", f's@N = """\n# {T.MARKER} @L\n"""'))


_FENCE_SQL = f"""WITH l AS (SELECT source||'/'||doc_id||'.rs' AS path, unnest(string_split(coalesce(text,''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text,''), chr(10)), 1) - 1 AS i FROM documents),
r AS (SELECT path, i * 2 AS "row", CASE WHEN length(line) % 3 = 0 THEN '/// ```' WHEN length(line) % 7 = 1 THEN 'fn' WHEN length(line) % 5 = 0 THEN '//! ```' ELSE '/// said' END AS line FROM l UNION ALL SELECT path, i * 2 + 1, '/// {T.MARKER} x' FROM l),
k AS (SELECT *, CASE WHEN line = 'fn' THEN '' ELSE line[1:3] END AS token FROM r),
n AS (SELECT *, CASE WHEN token <> '' AND token = lag(token) OVER (PARTITION BY path ORDER BY "row") THEN 0 ELSE 1 END AS new FROM k),
g AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY "row") AS run FROM n),
f AS (SELECT *, coalesce(sum(CASE WHEN line LIKE '%```' THEN 1 ELSE 0 END) OVER (PARTITION BY path, run ORDER BY "row" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 AS fenced FROM g)
"""


@query(_FENCE_SQL + f"SELECT path, \"row\", 'zh-in-code-block' AS code FROM f WHERE fenced = 1 AND line LIKE '%{T.MARKER}%'", fixtures=False)
def fence_lint(spark, sf):
    n = F.length("line")
    kind = F.when(n % 3 == 0, "/// ```").when(n % 7 == 1, "fn").when(n % 5 == 0, "//! ```").otherwise("/// said")
    rows = lines.explode_lines(X.read(spark, sf, "documents").select(F.concat("source", F.lit("/"), "doc_id", F.lit(".rs")).alias("path"), F.coalesce("text", F.lit("")).alias("text")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", kind.alias("line")))), lambda x: F.concat(x["line"], F.lit(f"\n/// {T.MARKER} x"))), "\n")
    return placement.misplaced(rows.groupBy("path").agg(text.alias("text")))


@query(""", h AS (SELECT path, "row", ltrim(line, ' '||chr(9)) LIKE '# %' AS note FROM slines),
b AS (SELECT *, max(CASE WHEN NOT note THEN "row" END) OVER (PARTITION BY path ORDER BY "row" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS code FROM (SELECT path, "row", note OR "row" % 3 = 1 AS note FROM h))
SELECT path, "row", coalesce(code + 1, 0) AS first FROM b WHERE "row" % 4 = 0""")
def leading_comments(spark, sf):
    rows = lines.explode_lines(X.study(spark, sf).select("path", "text"))
    rows = rows.withColumn("line", F.when(F.col("row") % 3 == 1, F.concat(F.lit("  # also "), "line")).otherwise(F.regexp_replace("line", r"^([ \t]*)#(?! )", "$1;")))
    return placement.leading_comments(rows, rows.where("row % 4 = 0"))


# --- the same shapes under load ---


@query("SELECT l_returnflag AS status, l_linestatus AS kind, count(*) AS n, count(*) FILTER (l_shipdate > TIMESTAMP '1997-01-01') AS late, coalesce(count(*) FILTER (l_shipdate > TIMESTAMP '1997-01-01')::DOUBLE / nullif(count(*), 0), 0) AS ratio FROM lineitem GROUP BY ALL", fixtures=False)
def load_counts(spark, sf):
    late = F.count_if(F.col("l_shipdate") > F.lit("1997-01-01").cast("timestamp"))
    return X.read(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("status"), F.col("l_linestatus").alias("kind")).agg(F.count("*").alias("n"), late.alias("late"), T.safe_ratio(late, F.count("*")).alias("ratio"))


@query("SELECT l_suppkey AS path, l_orderkey, l_linenumber, floor((row_number() OVER (PARTITION BY l_suppkey ORDER BY l_returnflag <> 'R', l_orderkey, l_linenumber) - 1) / 20)::BIGINT AS chunk FROM lineitem", fixtures=False)
def load_chunks(spark, sf):
    order = Window.partitionBy("l_suppkey").orderBy(F.col("l_returnflag") != "R", "l_orderkey", "l_linenumber")
    return X.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("path"), "l_orderkey", "l_linenumber", F.floor((F.row_number().over(order) - 1) / 20).cast("long").alias("chunk"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%')", fixtures=False)
def load_semi_join(spark, sf):
    urgent = X.read(spark, sf, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_orderkey").alias("l_orderkey"))
    return X.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").join(urgent, "l_orderkey", "left_semi")
