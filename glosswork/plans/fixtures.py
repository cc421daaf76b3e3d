"""Inputs for the catalogue's queries, derived from the test tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.functions import text as T
from glosswork.operators.lines import annotation_rows, explode_lines, owner_join

WS_SQL = T.WS.replace("\\x{", "\\x{")


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def glossary(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of seven domains: the longer words of the benchmark's texts, each with the pairs of words that it begins as aliases."""
    t = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+|[^a-z])"), F.lit(1))
    rows = read(spark, sf, "benchmark").select("item_id", t.alias("t")).select("item_id", F.explode(F.transform("t", lambda w, i: F.struct(w.alias("w"), F.get("t", i + 1).alias("gap"), F.get("t", i + 2).alias("nxt")))).alias("x")).select("item_id", "x.*")
    w, zh = F.col("w"), F.concat(F.lit("译"), F.min("item_id"))
    pairs = F.array_sort(F.collect_set(F.when((F.col("gap") == " ") & F.col("nxt").rlike("^[a-z]+$"), F.concat("w", F.lit(" "), "nxt"))))
    own = rows.where((F.length(w) > 3) & w.rlike("^[a-z]+$")).groupBy((F.col("item_id") % 7).cast("int").alias("domain_pos"), "w").agg(zh.alias("zh"), pairs.alias("aliases"))
    key = F.concat(F.when(F.length(w) % 6 == 5, "Bad-").otherwise(""), w)
    avoid = F.concat(F.when(F.length(w) % 5 == 4, F.array("zh")).otherwise(F.array().cast("array<string>")), F.array(F.substring(w, 1, 3)))
    return own.select(F.concat(F.lit("d"), "domain_pos").alias("domain"), "domain_pos", key.alias("key"), w.alias("en"), "zh", avoid.alias("avoid"), "aliases")


def upstream(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("/"), "doc_id", F.lit(".py")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))


def annotated(text: Column, token: str = "#") -> Column:
    return F.array_join(F.transform(T.lines(text), lambda l, i: F.when(i % 7 == 0, F.concat(F.lit(f"{token} {T.MARKER} n"), i, F.lit("\n"), l)).otherwise(l)), "\n")


def study(spark: SparkSession, sf: str) -> DataFrame:
    return upstream(spark, sf).withColumn("text", annotated(F.col("text")))


def later(spark: SparkSession, sf: str) -> DataFrame:
    """The second version: some gone, some moved, first or last lines changed."""
    d = F.col("doc_id")
    text = F.concat(F.when(d % 7 == 0, "v2 ").otherwise(""), "text", F.when(d % 17 == 0, " tail").otherwise(""))
    path = F.when(d % 13 == 0, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    return upstream(spark, sf).where(d % 11 != 0).select("doc_id", path.alias("path"), text.alias("text"))


def symbols(files: DataFrame, note: Column) -> DataFrame:
    """Each document as one symbol: its first line is the signature, its second the doc, the rest the body."""
    ls = T.lines(F.col("text"))
    body = F.slice(ls, 3, 1 << 30)
    n = F.size(F.filter(body, lambda l: T.strip(l) != "")).cast("long")
    doc = F.coalesce(F.get(ls, F.lit(1)), F.lit(""))
    return files.select(
        "doc_id", "path", F.concat("path", F.lit("#doc")).alias("id"), F.lit("fn").alias("kind"), F.col("doc_id").alias("ord"),
        T.digest(F.get(ls, F.lit(0))).alias("sig"), T.digest(doc).alias("doc"), T.digest(F.array_join(body, "\n")).alias("body"),
        n.alias("body_lines"), ((T.strip(doc) != "") | (n >= 5)).alias("translatable"),
        F.when(F.col("doc_id") % 3 != 0, T.digest(note)).alias("zh"),
    )


def old_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return symbols(upstream(spark, sf), F.concat(F.lit("note "), F.floor(F.col("doc_id") / 2)))


def new_symbols(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    return symbols(later(spark, sf), F.concat(F.lit("note "), F.floor(d / 2), F.when(d % 19 == 0, " edited").otherwise("")))


def records(spark: SparkSession, sf: str) -> DataFrame:
    s, ok = old_symbols(spark, sf).where("zh IS NOT NULL"), F.col("doc_id") % 9 == 1
    return s.select("id", F.col("sig").alias("at_sig"), F.col("doc").alias("at_doc"), F.col("body").alias("at_body"), "zh", F.lit("first").alias("by"), *(F.when(ok, F.col(k)).alias(f"review_{k}") for k in ("sig", "doc", "body", "zh")))


#: The line that the guides of checked() may gain.
IMPORT = "@study/guide.md"


def checked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Study and upstream files of which every kind of problem befalls a tenth, by doc_id."""
    d, plain = F.col("doc_id") % 10, F.translate("text", "'\"\\`", "    ")
    rows = upstream(spark, sf).select("doc_id", d.alias("d"), plain.alias("text"))
    suffix = F.when(d == 3, "guide.md").when(d == 4, "txt").when(d == 8, "rs").otherwise("py")
    path = F.concat(F.when(d == 2, "gen/").when(d == 9, "study/").otherwise("src/"), "doc_id", F.when(d == 3, "/").otherwise("."), suffix)
    fenced = F.concat(F.lit("/// ```\n/// "), F.replace("text", F.lit("\n"), F.lit("\n/// ")), F.lit("\n/// ```"))
    theirs = F.when(d == 7, F.concat(F.lit('s = """\n'), "text", F.lit('\n"""'))).when(d == 8, fenced).otherwise(F.col("text"))
    up = rows.select("doc_id", path.alias("path"), theirs.alias("text"))
    added = F.when(F.col("doc_id") % 20 < 10, f"\n\n{IMPORT}\n").otherwise(f"\nmore\n{IMPORT}")
    mine = F.when(d == 3, F.concat("text", added)).when(d == 4, F.concat("text", F.lit("!"))).when(d == 5, F.concat("text", F.lit("\0")))
    mine = mine.when(d == 6, F.concat(annotated(F.col("text")), F.lit("\nlast"))).when(d == 8, annotated(F.col("text"), "///")).otherwise(annotated(F.col("text")))
    return up.where(d != 1).select("path", mine.alias("text")), up.where(d != 0).select("path", "text")


#: Nested symbols of every document: number, first and last row.
NESTED = ((0, 0, 9), (1, 2, 5), (2, 4, 5), (3, 12, 30))


def _spans(files: DataFrame, first, last, where: Column | None = None) -> DataFrame:
    """path, id, start, end, item_row, ord of NESTED, its rows moved by first and last."""
    spans = F.array(*(F.struct(F.lit(n).alias("ord"), first(F.lit(a)).cast("long").alias("start"), last(F.lit(b)).cast("long").alias("end")) for n, a, b in NESTED))
    rows = files.select("doc_id", "path", F.explode(spans).alias("s")).select("doc_id", "path", F.concat("path", F.lit("#s"), "s.ord").alias("id"), "s.start", "s.end", F.col("s.start").alias("item_row"), "s.ord")
    return rows.where(where) if where is not None else rows


def upstream_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return _spans(upstream(spark, sf), lambda r: r, lambda r: r)


def study_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Where NESTED is in study(), whose every seventh line has an annotation before it."""
    moved = lambda r: r + F.floor(r / 7) + 1
    return _spans(upstream(spark, sf), moved, moved)


def theirs(spark: SparkSession, sf: str) -> DataFrame:
    """later(), every third document with a line more at the top."""
    d = F.col("doc_id")
    return later(spark, sf).withColumn("text", F.concat(F.when(d % 3 == 0, "a first line\n").otherwise(""), "text"))


def their_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Where NESTED is in theirs(); every fifth document has lost one."""
    down = F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)
    return _spans(later(spark, sf), lambda r: r + down, lambda r: r + down, (F.col("doc_id") % 5 != 0) | (F.col("ord") != 1))


def noted_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """study_symbols() that begin inside their text, each file's own symbol with them, and zh_rows, the annotations of each."""
    files = study(spark, sf)
    last = files.select("path", (F.size(T.lines(F.col("text"))) - 1).cast("long").alias("last"))
    inner = study_symbols(spark, sf).join(last, "path").where("start <= last").select("path", "id", "start", "end", "item_row", "ord")
    own = last.select("path", F.concat("path", F.lit("#<module>")).alias("id"), F.lit(0).cast("long").alias("start"), F.col("last").alias("end"), F.lit(0).cast("long").alias("item_row"), F.lit(-1).alias("ord"))
    notes = annotation_rows(explode_lines(files)).select("path", "row")
    told = owner_join(notes, inner).groupBy("id").agg(F.sort_array(F.collect_list("row")).alias("zh_rows"))
    return inner.unionByName(own).join(told, "id", "left").withColumn("zh_rows", F.coalesce("zh_rows", F.array().cast("array<bigint>")))


def answers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Annotations for every document of study(), some in wrong places, for symbols nobody asked for or for another version; and the symbols asked for."""
    d = F.col("doc_id")

    def one(n: int, symbol: str, doc: bool, line: Column, *text: str) -> Column:
        return F.struct(F.lit(n).alias("n"), F.concat("path", F.lit(f"#{symbol}")).alias("symbol"), F.lit("doc" if doc else "line").alias("placement"), line.alias("line"), F.array(*map(F.lit, text)).alias("text"))

    told = F.array(
        one(0, "s1", False, F.lit(4), f"# {T.MARKER} fresh", "  "),
        one(1, "s3", True, F.lit(None).cast("int"), "two", "// lines"),
        F.when(d % 4 == 0, one(2, "<module>", True, F.lit(0), "about")),
        one(3, "s2", False, F.when(d % 6 == 0, 1).otherwise(6), "inner"),
        F.when(d % 9 == 0, one(4, "gone", True, F.lit(0), "x")),
        F.when(d % 9 == 1, one(5, "other", True, F.lit(0), "x")),
        one(6, "s0", True, F.lit(0), " "),
    )
    sha = F.when(d % 7 == 0, "another").otherwise(F.sha1("text"))
    rows = study(spark, sf).select("path", sha.alias("sha"), F.explode(F.array_compact(told)).alias("a")).select("path", "sha", "a.*")
    asked = study(spark, sf).select("path", F.explode(F.transform(F.array(*map(F.lit, ("s0", "s1", "s2", "s3", "gone", "<module>"))), lambda x: F.concat("path", F.lit("#"), x))).alias("id"))
    return rows, asked


def _dig(x: str) -> str:
    return f"left(sha256(trim(regexp_replace({x}, '{WS_SQL}+', ' ', 'g'))), 12)"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS_SQL}+|{WS_SQL}+$', '', 'g')"


def _symbols_sql(source: str, note: str) -> str:
    return f"""SELECT doc_id, path, path||'#doc' AS id, 'fn' AS kind, doc_id AS ord, {_dig("l[1]")} AS sig, {_dig("coalesce(l[2],'')")} AS doc, {_dig("array_to_string(l[3:], chr(10))")} AS body,
 len(list_filter(l[3:], lambda y: {_strip("y")} <> ''))::BIGINT AS body_lines,
 ({_strip("coalesce(l[2],'')")} <> '' OR len(list_filter(l[3:], lambda y: {_strip("y")} <> '')) >= 5) AS translatable,
 CASE WHEN doc_id % 3 <> 0 THEN {_dig(note)} END AS zh FROM (SELECT *, string_split(text, chr(10)) AS l FROM {source})"""


#: Common table expressions that mirror the functions above.
SQL = f"""WITH upstream AS (SELECT doc_id, source||'/'||doc_id||'.py' AS path, coalesce(text,'') AS text FROM documents),
study AS (SELECT doc_id, path, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: CASE WHEN (i-1) % 7 = 0 THEN '# {T.MARKER} n'||(i-1)||chr(10)||l ELSE l END), chr(10)) AS text FROM upstream),
later AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'moved/'||path ELSE path END AS path, CASE WHEN doc_id % 7 = 0 THEN 'v2 ' ELSE '' END||text||CASE WHEN doc_id % 17 = 0 THEN ' tail' ELSE '' END AS text FROM upstream WHERE doc_id % 11 <> 0),
olds AS ({_symbols_sql("upstream", "'note '||(doc_id // 2)")}),
news AS ({_symbols_sql("later", "'note '||(doc_id // 2)||CASE WHEN doc_id % 19 = 0 THEN ' edited' ELSE '' END")}),
recs AS (SELECT id, sig AS at_sig, doc AS at_doc, body AS at_body, zh, 'first' AS by, CASE WHEN doc_id % 9 = 1 THEN sig END AS review_sig, CASE WHEN doc_id % 9 = 1 THEN doc END AS review_doc, CASE WHEN doc_id % 9 = 1 THEN body END AS review_body, CASE WHEN doc_id % 9 = 1 THEN zh END AS review_zh FROM olds WHERE zh IS NOT NULL),
ulines AS (SELECT doc_id, path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT - 1 AS "row" FROM upstream),
slines AS (SELECT doc_id, path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT - 1 AS "row" FROM study),
derived AS (SELECT s.*, CASE WHEN s.zh IS NULL THEN 'pending' WHEN r.id IS NULL OR r.zh IS DISTINCT FROM s.zh THEN 'translated' WHEN r.at_sig<>s.sig OR r.at_doc<>s.doc OR r.at_body<>s.body THEN 'stale' WHEN r.review_zh=s.zh AND r.review_sig=s.sig AND r.review_doc=s.doc AND r.review_body=s.body THEN 'reviewed' ELSE 'translated' END AS status,
 CASE WHEN r.at_sig<>s.sig THEN 'sig' END AS c1, CASE WHEN r.at_doc<>s.doc THEN 'doc' END AS c2, CASE WHEN r.at_body<>s.body THEN 'body' END AS c3 FROM news s LEFT JOIN recs r ON s.id = r.id),
stat AS (SELECT * EXCLUDE (c1, c2, c3), CASE WHEN status='stale' THEN concat_ws(',', c1, c2, c3) ELSE '' END AS changed, CASE WHEN status<>'stale' THEN '' WHEN c1 IS NOT NULL THEN 'P0' WHEN c2 IS NOT NULL THEN 'P1' ELSE 'P2' END AS priority FROM derived)
"""

#: What re-attaching gives, row by row, after SQL: blocks (u: the code row they stand before) with owner and bounds, candidates, places.
REATTACH_SQL = f""", theirs AS (SELECT doc_id, path, CASE WHEN doc_id % 3 = 0 THEN 'a first line'||chr(10) ELSE '' END||text AS text FROM later),
tl AS (SELECT doc_id, path, "row", line, {_strip("line")} AS said, lag({_strip("line")}) OVER (PARTITION BY path ORDER BY "row") AS above FROM (SELECT doc_id, path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT - 1 AS "row" FROM theirs)),
spans(o, a, b) AS (VALUES {", ".join(map(str, NESTED))}),
bl AS (SELECT l.doc_id, l.path, l."row" AS u, l."row" + l."row" // 7 AS first, {_strip("l.line")} AS nxt, l.line AS nxt_line, {_strip("p.line")} AS prv FROM ulines l LEFT JOIN ulines p ON p.path = l.path AND p."row" = l."row" - 1 WHERE l."row" % 7 = 0),
ow AS (SELECT bl.*, arg_min(o, (b + b // 7 - a - a // 7) * 10 + o) AS o, arg_min(a, (b + b // 7 - a - a // 7) * 10 + o) AS a, arg_min(b, (b + b // 7 - a - a // 7) * 10 + o) AS b FROM bl LEFT JOIN spans ON first BETWEEN a + a // 7 + 1 AND b + b // 7 + 1 GROUP BY ALL),
bd AS (SELECT ow.doc_id, ow.path, u, first, nxt, nxt_line, prv, ow.path||'#'||coalesce('s'||o, '<module>') AS id, u - coalesce(a, 0) AS off,
 CASE WHEN t.path IS NULL OR (o = 1 AND t.doc_id % 5 = 0) THEN NULL WHEN o IS NULL THEN 0 ELSE a + CASE WHEN t.doc_id % 3 = 0 THEN 1 ELSE 0 END END AS lo, CASE WHEN o IS NULL THEN 1000000000 ELSE b + CASE WHEN t.doc_id % 3 = 0 THEN 1 ELSE 0 END END AS hi FROM ow LEFT JOIN theirs t ON t.path = ow.path),
n AS (SELECT bd.path, u, arg_min("row", CASE WHEN above = prv THEN 0 ELSE 1000000000000 END + abs("row" - lo - off) * 1000000 + "row") AS spot FROM bd JOIN tl ON tl.path = bd.path AND said = nxt AND "row" BETWEEN lo AND hi WHERE nxt <> '' GROUP BY bd.path, u),
q AS (SELECT bd.path, u, arg_min("row" + 1, abs("row" + 1 - lo - off) * 1000000 + "row") AS spot FROM bd JOIN tl ON tl.path = bd.path AND said = prv AND "row" BETWEEN lo AND hi WHERE prv <> '' GROUP BY bd.path, u),
placed AS (SELECT bd.path, u, first, nxt_line, id, CASE WHEN lo IS NULL THEN 'orphaned' WHEN coalesce(n.spot, q.spot) IS NOT NULL THEN 'reattached' ELSE 'relocated' END AS outcome, CASE WHEN lo IS NOT NULL THEN coalesce(n.spot, q.spot, lo) END AS spot FROM bd LEFT JOIN n USING (path, u) LEFT JOIN q USING (path, u)),
put AS (SELECT p.path, p.spot AS k, 0 AS b, first AS c, CASE WHEN outcome = 'reattached' AND coalesce(said, '') = '' THEN regexp_extract(nxt_line, '^[ \\t]*') ELSE regexp_extract(coalesce(line, ''), '^[ \\t]*') END||'# {T.MARKER} n'||u AS line FROM placed p LEFT JOIN tl ON tl.path = p.path AND tl."row" = p.spot WHERE spot IS NOT NULL),
merged AS (SELECT path, string_agg(line, chr(10) ORDER BY k, b, c) AS text FROM (SELECT path, "row" AS k, 1 AS b, 0 AS c, line FROM tl UNION ALL SELECT * FROM put) GROUP BY path)
"""
