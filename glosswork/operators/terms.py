"""Glossaries: terms (domain, domain_pos, key, en, zh, avoid array<string>, aliases array<string>, ord).

Texts meet terms by words, in joins, so that neither plans nor expressions grow with a glossary and no pairs of text and term are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A run of ASCII letters of lower-cased text, or one other character that isn't white space.
TOKEN = r"[a-z]++|[^a-z\s]"
#: Forms, of some hundred bytes each, that all executors get; more of them meet the texts' words in a shuffle.
FEW = 1 << 17


def merge(terms: DataFrame) -> DataFrame:
    """One record a key: of the last domain that has it."""
    last = Window.partitionBy("key").orderBy(F.desc("domain_pos"))
    return terms.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def validate(terms: DataFrame) -> DataFrame:
    """key, domain, problem: an avoided word that is the translation itself; a translation other than in the first domain with that key; a key that isn't lower snake case."""
    first = Window.partitionBy("key").orderBy("domain_pos")
    rows = terms.withColumn("_first", F.first("zh").over(first))
    rows = rows.select("key", "domain", F.explode(F.array_compact(F.array(F.when(F.array_contains("avoid", F.col("zh")), "avoids-itself"), F.when(F.col("zh") != F.col("_first"), "conflict"), F.when(~F.col("key").rlike("^[a-z][a-z0-9_]*$"), "bad-key")))).alias("problem"))
    return rows


def forms(terms: DataFrame) -> DataFrame:
    """key, form, head, sooner of the surface forms of terms, lower-cased: the term, its key with spaces and without, its aliases. head: the form's first word, or first character that is
    none; sooner: a pattern of the term's forms before this one, or null. A form in which another one of its term stands is left out, as the other stands wherever it does.
    """
    every = F.concat(F.array("en", F.replace("key", F.lit("_"), F.lit(" ")), F.replace("key", F.lit("_"), F.lit(""))), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = terms.select("key", F.explode(F.array_compact(every)).alias("form")).where(F.rlike(F.lower("form"), F.lit(TOKEN))).groupBy("key").agg(F.array_sort(F.collect_set(F.lower("form"))).alias("every"))
    least = F.filter("every", lambda f: ~F.exists("every", lambda g: (f != g) & _whole(f, g)))
    rows = rows.select("key", least.alias("least")).select("key", "least", F.posexplode("least").alias("pos", "form"))
    sooner = F.concat(F.lit("(?<![a-z])(?:"), F.array_join(F.transform(F.slice("least", F.lit(1), F.col("pos")), _quoted), "|"), F.lit(")(?![a-z])"))
    return rows.select("key", "form", F.regexp_extract("form", TOKEN, 0).alias("head"), F.when(F.col("pos") > 0, sooner).alias("sooner"))


def _standing(texts: DataFrame, forms: DataFrame, *key: str) -> DataFrame:
    """Rows of texts (key columns, text, others) with each row of forms (head, form, sooner, others) whose form, but none of its term before it, stands in the text, not inside a longer run
    of ASCII letters. So each term is found once.

    A form can only stand where its first word stands as a whole word. So texts and forms meet by that word, an equal join however many terms there are; a form of one word is found by
    the join alone, and only for longer forms the text is looked at. Up to `FEW` forms go to the texts. Of more, each different word of a text is sent once, and the text once to what its words met.
    """
    read = texts.withColumn("_low", F.lower("text"))
    read = read.withColumn("_heads", F.array_distinct(F.regexp_extract_all("_low", F.lit(TOKEN), F.lit(0))))
    if forms.count() <= FEW:
        met = read.select(*texts.columns, "_low", F.explode("_heads").alias("head")).join(F.broadcast(forms), "head")
    else:
        asked = read.select(*key, F.explode("_heads").alias("head")).join(forms, "head").groupBy(*key).agg(F.collect_set(F.struct(*forms.columns)).alias("_asked"))
        met = read.drop("_heads").join(asked, list(key)).select(*texts.columns, "_low", F.inline("_asked"))
    return met.where(F.col("form").rlike("^[a-z]+$") | _whole(F.col("_low"), F.col("form"))).where(F.col("sooner").isNull() | ~F.rlike("_low", F.col("sooner")))


def mentions(texts: DataFrame, terms: DataFrame, *key: str) -> DataFrame:
    """key, term: the keys of terms that stand in each text (key columns, which tell rows apart and aren't null; text), not inside a longer run of ASCII letters."""
    return _standing(texts.select(*key, "text"), forms(terms).withColumnRenamed("key", "term"), *key).select(*key, "term").distinct()


def _quoted(form: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(form, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _whole(text: Column, form: Column) -> Column:
    """Whether a form stands in a text with no letter on either side."""
    return F.contains(text, form) & F.rlike(text, F.concat(F.lit("(?<![a-z])"), _quoted(form), F.lit("(?![a-z])")))


def relevant(texts: DataFrame, terms: DataFrame, *key: str) -> DataFrame:
    """key columns, key: a row for each term (merged ones) that a text mentions."""
    return mentions(texts, terms, *key).withColumnRenamed("term", "key")


def lint(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """path, row, bad, key: each avoided word that rows (path, row, text, context) contain; path and row tell them apart. It counts only if its term is mentioned in the context or the text."""
    bad = terms.select(F.col("key").alias("term"), F.explode("avoid").alias("bad")).where("bad != ''").distinct()
    some = rows.where("path IS NOT NULL AND row IS NOT NULL")
    seen = some.select("path", "row", F.col("text").alias("line"), F.concat_ws("\n", "context", "text").alias("text"))
    found = _standing(seen, forms(terms).withColumnRenamed("key", "term").join(bad, "term"), "path", "row").where(F.contains("line", F.col("bad")))
    return found.select("path", "row", "bad", F.col("term").alias("key"))
