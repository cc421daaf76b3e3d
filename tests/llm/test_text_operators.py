"""Every operator against a brute-force version on small texts: nulls, empty and very long texts, ties, repeated rows, clashing columns, empty tables."""

import hashlib
import json
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glosswork.llm import _segments, ann, chat, fingerprint, langid, ngram_join, packing, secrets, sentencepiece_tok, substring_dedup, suffix_dedup
from glosswork.llm._base import text_buffer
from glosswork.sources import tables

WORDS = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, spans string, start int, component string"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def corpus(seed=3, n=60):
    """Random texts with copies, near copies, shared passages, junk; columns that clash with the operators' own."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(400)]
    passage = " ".join(r.choices(vocabulary, k=70))
    texts = [None, "", " ", "\n\t", "one", "one", "Two words", "a b c d", "aé" * 150, "x" * 1000, "日本語" * 90, "𝒳 y " * 60, "!!! 12 ...", " lead  and  odd \r\n\n spaces ", "<|endoftext|> </s>[INST] <|turn|> <\\|end|>"]
    for _ in range(n):
        w = r.choices(vocabulary, k=r.choice([3, 12, 40, 120, 300]))
        kind = r.random()
        if kind < 0.3:
            at = r.randint(0, len(w))
            w[at:at] = passage.split(" ")[r.randint(0, 10) : r.randint(40, 70)]
        elif kind < 0.6 and len(texts) > 20:
            w = (r.choice(texts[15:]) or "").split(" ")
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
        texts.append(r.choice([" ", " ", "\n"]).join(w))
    texts.append(" ".join(r.choices(vocabulary, k=6000)) + " " + passage)  # very long
    ids = r.sample(range(1, 1000), len(texts))
    return sorted(zip(ids, texts))


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), 7, "x", 1, "c") for i, t in docs], SCHEMA).repartition(3)


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffix_dedup(spark, hot):
    docs = corpus()
    docs.append(docs[30])  # a repeated row
    rows = suffix_dedup.remove_repeats(frame(spark, docs), hot=hot).collect()
    assert len(rows) == len(docs)
    texts = [(i, (t or "").encode()) for i, t in docs]
    count = Counter(b[p : p + 200] for _, b in texts for p in range(len(b) - 199))
    found = defaultdict(list)
    for i, b in texts:
        mask = bytearray(len(b))
        for p in range(len(b) - 199):
            if count[b[p : p + 200]] > 1:
                mask[p : p + 200] = b"\1" * 200
        kept = bytes(x for x, m in zip(b, mask) if not m)
        found[i].append((len(b), sum(mask), len(re.findall(b"\1+", bytes(mask))), sha(kept)))
    assert sum(x[1] for v in found.values() for x in v)
    for r in rows:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) in found[r.doc_id]


@pytest.mark.parametrize("words", [False, True])
def test_dedup_survives_equal_anchors(monkeypatch, spark, words):
    """All polynomial hashes equal, in workers too: one anchor for all texts."""

    class Zero:
        def __call__(self, prefix, a, b):
            return np.zeros(len(a), np.uint64)

    monkeypatch.setattr(_segments, "span_hash", Zero())
    docs = [(i, (t or "").encode()) for i, t in corpus(4, 25)[:30]]
    plan = _segments.Plan(20, 6, True, True) if words else _segments.Plan(200, 40, False, False)
    bucket = (substring_dedup if words else suffix_dedup)._bucket(plan.window)
    texts = pa.array([t for _, t in docs], pa.binary())
    asked, marks = defaultdict(list), []
    for x in _segments.batch_segments(*text_buffer(texts), np.array([i for i, _ in docs]), np.zeros(len(docs), np.int64), plan):
        assert len(set(x["key"].tolist())) == 1
        for doc, start, n, anchor in zip(*(x[c].tolist() for c in ("doc", "start", "n", "anchor_at"))):
            asked[0].append((doc, start, n, anchor))
    own = {i: t.split() if words else t for i, t in docs}
    rows = asked[0]
    table = pa.table({"key": pa.array([0] * len(rows)), "doc": pa.array([r[0] for r in rows]), "sub": pa.array([0] * len(rows)), "start": pa.array([r[1] for r in rows], pa.int32()), "anchor_at": pa.array([r[3] for r in rows], pa.int32()), "packed": pa.array([b" ".join(own[d][s : s + n]) if words else own[d][s : s + n] for d, s, n, _ in rows], pa.binary())})
    item, start = bucket(table)
    found = {(rows[i][0], p) for i, p in zip(item.tolist(), start.tolist())}
    windows = [(d, p, tuple(u[p : p + plan.window])) for d, u in own.items() for p in range(len(u) - plan.window + 1)]
    n, first = Counter(w for _, _, w in windows), {}
    for d, p, w in windows:
        if words:
            if first.setdefault(w, (d, p)) != (d, p):
                marks.append((d, p))
        elif n[w] > 1:
            marks.append((d, p))
    assert found == set(marks) and marks


def test_suffix_sort_survives_collisions(monkeypatch):
    data = np.frombuffer(b"abcabdabcabe" * 3, np.uint8)
    begin, end = np.arange(0, 30, 3), np.full(10, len(data))
    plain = suffix_dedup.Suffixes(data, begin, end, np.zeros(10))
    monkeypatch.setattr(suffix_dedup, "span_hash", lambda p, a, b: np.zeros(len(a), np.uint64))  # all hashes equal
    worst = suffix_dedup.Suffixes(data, begin, end, np.zeros(10))
    text = [data[b:].tobytes() for b in begin]
    for s in (plain, worst):
        assert [text[i] for i in s.order] == sorted(text)
        for j in range(1, 10):
            a, b = text[s.order[j - 1]], text[s.order[j]]
            assert s.common[j] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def test_without_repeats_keeps_columns_and_whole_characters(spark):
    docs = [(1, "ab" + "é" * 150), (2, "xé" + "é" * 149 + "z"), (3, "short"), (4, None)]
    rows = {r.doc_id: r for r in suffix_dedup.without_repeats(frame(spark, docs)).collect()}
    assert frame(spark, docs).columns == suffix_dedup.without_repeats(frame(spark, docs)).columns
    assert rows[1].text == "ab" and rows[1].n_chars == 2 and rows[2].text == "xz" and rows[3].text == "short" and rows[4].text is None


@pytest.mark.parametrize("hot", [4096, 2])
def test_substring_dedup(spark, hot):
    docs = corpus(5)
    docs.append(docs[30])  # a repeated row, no earlier than itself
    rows = {r.doc_id: r for r in substring_dedup.remove_later(frame(spark, docs), hot=hot).collect()}
    first, removed = {}, 0
    for i, t in docs:
        w = WORDS.findall(t or "")
        mask = [0] * len(w)
        for p in range(len(w) - 19):
            if first.setdefault(tuple(w[p : p + 20]), (i, p)) != (i, p):
                mask[p : p + 20] = [1] * 20
        removed += sum(mask)
        kept = " ".join(x for x, m in zip(w, mask) if not m)
        assert (rows[i].n_words, rows[i].n_removed, rows[i].kept_sha256) == (len(w), sum(mask), sha(kept)), i
    assert removed


def sets(text):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("big", "chunk"), [(64, 256), (1, 3)])
def test_ngram_join(spark, monkeypatch, big, chunk):
    monkeypatch.setattr(ngram_join, "BIG", big)
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    docs = corpus(11, 90)
    own = {i: sets(t) for i, t in docs}
    up = {i: i for i in own}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in own:
        for j in own:
            if i < j and own[i] and 100 * len(own[i] & own[j]) >= 80 * len(own[i] | own[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    rows = ngram_join.classes(frame(spark, docs)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in rows} == {(i, len(s), top(i)) for i, s in own.items()}
    assert len({top(i) for i in own}) < len(own) - 5
    kept = ngram_join.keep_one(frame(spark, docs))
    assert kept.columns == frame(spark, docs).columns
    assert {r.doc_id for r in kept.collect()} == {i for i in own if top(i) == i}


def test_groups_lose_no_component(spark, monkeypatch):
    """All texts as one neighbourhood, in small groups, so that pairs of groups and several rounds are needed."""
    monkeypatch.setattr(ngram_join, "BIG", 5)
    monkeypatch.setattr(ngram_join, "CHUNK", 7)
    docs = [(i, t) for i, t in corpus(13, 80) if t and sets(t)]
    hashed = dict(zip([i for i, _ in docs], (s for _, s in ngram_join.shingle_sets(*text_buffer(pa.array([t for _, t in docs])), 5))))
    matrix = spark.createDataFrame([(i, ngram_join.bits(s)) for i, s in hashed.items()], "cid long, bits binary")
    near = spark.createDataFrame([(1, i, len(s)) for i, s in hashed.items()], "g long, cid long, n long")
    texts = spark.createDataFrame(docs, "doc long, text string")
    own = {i: sets(t) for i, t in docs}
    up = {i: i for i in own}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in own:
        for j in own:
            if i < j and 100 * len(own[i] & own[j]) >= 80 * len(own[i] | own[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    got = {r.node: r.component for r in ngram_join._links(texts, near, matrix, 5, 80, 1, 2).collect()}
    assert len(got) > 5 and {i: got.get(i, i) for i in own} == {i: top(i) for i in own}


def test_groups_meet_by_size_and_component(spark):
    r = random.Random(17)
    groups = [(c, k, n := r.randrange(1, 400), n + r.choice([0, 3, 100]), r.choice([None, 1, 2, 3])) for c in (1, 2) for k in range(60)]
    want = {(a[0], min(a[1], b[1]), max(a[1], b[1])) for a in groups for b in groups if a[0] == b[0] and a[1] != b[1] and (a[4] is None or a[4] != b[4]) and a[3] * 100 >= b[2] * 80 and b[3] * 100 >= a[2] * 80}
    schema = "cluster long, chunk long, least long, most long, label long"
    got = ngram_join._group_pairs(spark.createDataFrame(groups, schema), 80).collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    one = spark.range(20_000).select(F.lit(1).alias("cluster"), F.col("id").alias("chunk"), F.lit(90).alias("least"), F.lit(99).alias("most"), F.lit(5).alias("label"))
    assert ngram_join._group_pairs(one, 80).count() == 0


def test_tables_of_a_scope_go(spark):
    from glosswork.llm._base import cut, scratch

    with scratch():
        a = cut(spark.range(3))
        with scratch():
            b, c = cut(spark.range(4), keep=True), cut(spark.range(5))
        assert (a.count(), b.count()) == (3, 4)
        with pytest.raises(Exception, match="FILE_NOT_EXIST|not exist"):
            c.count()
        d = cut(spark.range(6), keep=True)
    assert d.count() == 6
    with pytest.raises(Exception, match="FILE_NOT_EXIST|not exist"):
        b.count()


def test_tables_leave_no_shuffle_files(spark):
    dirs = [d.getPath() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for top in dirs for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}
    before, asked = files(), spark.conf.get(tables.CLEANUP, None)
    held = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()  # its plan stays in use, so no garbage collection takes its files
    table = tables.settled(held)
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(tables.CLEANUP, None) == asked
    assert table.count() == held.count() == 7


def test_counts_leave_no_shuffle_files(spark):
    dirs = [d.getPath() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for top in dirs for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}
    docs = frame(spark, [(i, " ".join(f"w{(i * k) % 7}" for k in range(20))) for i in range(50)])
    survey = tables.settled(ngram_join._survey(ngram_join._texts(docs), 5))
    time.sleep(1)
    before = files()
    assert ngram_join._last(survey).any() and ngram_join._levels(survey).any()
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before


def test_common_words_make_no_neighbourhoods(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(i, " ".join(w for k in range(6) for w in (*rng.choices("abcdef", k=8), f"x{i}y{k}"))) for i in range(300)]
    docs += [(300, docs[0][1] + " z"), (301, docs[1][1] + " z")]  # their shingles of common words are those of others, too
    shared, links = [], ngram_join._links

    def seen(texts, near, *rest):
        shared.extend(r.g for r in near.groupBy("g").count().where("count > 1").collect())
        return links(texts, near, *rest)

    monkeypatch.setattr(ngram_join, "_links", seen)
    found = {r.doc_id: r.component_id for r in ngram_join.classes(frame(spark, docs)).collect()}
    assert found == {i: i for i in range(300)} | {300: 0, 301: 1}
    assert len(shared) <= 4


def test_ranks_follow_words(spark):
    texts = pa.array(["a b c d e f g", "a b c d e a b c d e", "x", "", "B a  c"])
    levels = np.zeros(ngram_join.SLOTS, np.uint8)
    counts = np.zeros(ngram_join.SLOTS, np.int64)
    sets = list(ngram_join.shingle_sets(*text_buffer(texts), 5, counts))
    assert counts.sum() == 7 + 10 + 1 + 3 and (counts >= 4).sum() == 3
    levels[counts >= 3] = 9
    ranked = list(ngram_join.ranked_sets(*text_buffer(texts), 5, levels))
    assert [(i, s.tolist()) for i, s, _ in ranked] == [(i, s.tolist()) for i, s in sets]
    assert [sorted(r.tolist()) for _, _, r in ranked[:2]] == [[27, 36, 45], [45] * 5]


def test_ngram_join_at_its_default_sizes(spark):
    """More documents with one passage than BIG, in more groups than one, of which a few are alike."""
    r = random.Random(21)
    passage = " ".join(r.choices("abcdefgh", k=60))
    docs = []
    for i in range(600):
        own = passage.split(" ")
        if i % 50:
            own[r.randrange(60)] = f"w{i}"
        docs.append((i, " ".join([*own, *(f"x{i}y{k}" for k in range(i % 40))])))
    own = {i: sets(t) for i, t in docs}
    up = {i: i for i in own}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in own:
        for j in own:
            if i < j and 100 * len(own[i] & own[j]) >= 80 * len(own[i] | own[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    rows = ngram_join.classes(frame(spark, docs)).collect()
    assert {(x.doc_id, x.component_id) for x in rows} == {(i, top(i)) for i in own}


def test_structured_texts_are_told_apart(spark):
    """Words and texts whose polynomial hashes agree whatever the base: a Thue-Morse string and its complement."""
    bit = [bin(k).count("1") % 2 for k in range(2048)]
    word, other = "".join("ab"[b] for b in bit), "".join("ba"[b] for b in bit)
    r = random.Random(3)
    around = [f"w{r.random()}" for _ in range(25)]
    docs = [(1, " ".join([*around[:10], word, *around[10:]])), (2, " ".join([*around[:10], other, *around[10:]]))]
    docs += [(3, " ".join([word] * 9)), (4, " ".join([other] * 9))]
    docs += [(5, " ".join(("yes", "no")[b] for b in bit)), (6, " ".join(("no", "yes")[b] for b in bit))]
    rows = {x.doc_id: x for x in ngram_join.classes(frame(spark, docs)).collect()}
    assert {i: x.component_id for i, x in rows.items()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5 if sets(docs[4][1]) == sets(docs[5][1]) else 6}
    assert all(rows[i].n_shingles == len(sets(t)) for i, t in docs)
    for x in substring_dedup.remove_later(frame(spark, docs[:4])).collect():
        assert x.n_removed == 0
    cut = {x.doc_id: x for x in suffix_dedup.remove_repeats(frame(spark, [(1, "x" + word[:300] + "y"), (2, "z" + other[:300] + "w")])).collect()}
    whole = [b"x" + word[:300].encode() + b"y", b"z" + other[:300].encode() + b"w"]
    count = Counter(t[p : p + 200] for t in whole for p in range(len(t) - 199))
    for i, t in enumerate(whole, 1):
        mask = bytearray(len(t))
        for p in range(len(t) - 199):
            if count[t[p : p + 200]] > 1:
                mask[p : p + 200] = b"\1" * 200
        assert cut[i].n_removed == sum(mask)


def test_bits_never_bound_too_low():
    r = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(r.integers(0, 300, r.integers(1, 200)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        x, y = (np.frombuffer(ngram_join.bits(s), np.uint8) for s in (a, b))
        size = min(len(x), len(y))
        lacks = int(np.bitwise_count(ngram_join.folded(x, size) & ~ngram_join.folded(y, size)).sum())
        assert len(a) - lacks >= len(np.intersect1d(a, b))


def test_language_id(spark):
    r = random.Random(2)
    alphabets = {"aa": "abcde", "bb": "fghij", "cc": "éèüöß"}
    docs = [(i, " ".join("".join(r.choices(a, k=r.randint(2, 8))) for _ in range(r.randint(1, 80))), lang) for i, (lang, a) in enumerate(list(alphabets.items()) * 60)]
    docs += [(500, None, "aa"), (501, "12 !!", "bb"), (502, "", None), (503, "abc", None)]
    rows = spark.createDataFrame([(*d, 1.5) for d in docs], "doc_id long, text string, lang string, score double")
    model = langid.fit(rows.where(~langid.held_out()).select("text", "lang"), sample=20)
    found = {x.doc_id: x for x in langid.predict(rows, model).collect()}
    told = [found[i].lang_pred == lang for i, t, lang in docs[:180] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(told) > 20 and np.mean(told) > 0.95
    assert [found[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and found[500].rejected and found[503].lang_pred == "aa"
    assert all(0 <= x.score <= 1 for x in found.values())
    kept = langid.keep_known(rows, model)
    assert kept.columns == rows.columns and not {500, 501, 502} & {x.doc_id for x in kept.collect()}
    assert langid.fit(rows.where("lang = 'zz'")) is None and {x.lang_pred for x in langid.predict(rows, None).collect()} == {"und"}


def test_language_id_vectors_and_centroids(spark):
    """Vectors, centroids, scores and rejections against plain versions over dictionaries."""
    r = random.Random(9)
    docs = [(i, " ".join("".join(r.choices("abcdé" if i % 2 else "fghiö", k=r.randint(2, 6))) for _ in range(r.randint(5, 60))).replace("a", "A"), "ab"[i % 2]) for i in range(60)]
    docs += [(100, "x" * 5000 + " abc", "a"), (101, "zz 99 qq", None)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.fit(rows.select("text", "lang"), sample=15, clusters=3)

    def grams(text):
        b = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in text.lower().encode())
        return Counter(((int.from_bytes(b[i : i + 3], "big") * 0x9E3779B1) & 0xFFFFFFFF) >> 19 for i in range(len(b) - 2) if b[i : i + 3] != b"   ")

    known = [t for _, t, l in docs if l]
    df = Counter(f for t in known for f in grams(t))
    idf = {f: math.log((1 + len(known)) / (1 + df[f])) + 0.1 for f in range(langid.FEATURES)}

    def vector(text):
        v = {f: math.sqrt(n) * idf[f] for f, n in grams(text).items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1
        return {f: x / size for f, x in v.items()}

    def dot(v, c):
        return sum(x * c[f] for f, x in v.items())

    assert all(abs(float(model.idf[f]) - idf[f]) < 1e-4 for f in range(langid.FEATURES))
    sample = {lang: sorted({t for _, t, l in docs if l == lang}, key=lambda t: hashes[t])[:15] for lang in "ab"} if (hashes := {x.text: x.h for x in rows.selectExpr("text", "xxhash64(text) AS h").collect()}) else {}
    for k, lang in enumerate(model.languages):
        own = [c for c, o in zip(model.centroids, model.of) if o == k]
        assert len(own) == 3
        members = defaultdict(list)
        for t in sample[lang]:
            v = vector(t)
            members[max(range(3), key=lambda j: dot(v, own[j]))].append(v)
        for j, vs in members.items():  # each is the scaled mean of its members
            mean = np.zeros(langid.FEATURES)
            for v in vs:
                for f, x in v.items():
                    mean[f] += x
            assert np.allclose(mean / np.linalg.norm(mean), own[j], atol=1e-3)
    for x in langid.predict(rows, model).collect():
        t = next(t for i, t, _ in docs if i == x.doc_id)
        near = [dot(vector(t), c) for c in model.centroids]
        best = max(range(len(near)), key=lambda j: near[j])
        lang, n = model.of[best], sum(grams(t).values())
        assert x.lang_pred == model.languages[lang] and abs(x.score - near[best]) < 1e-4
        floor = langid.FLOOR * model.long[lang] * math.sqrt(n / (n + model.half[lang]))
        assert abs(near[best] - floor) < 1e-4 or x.rejected == (near[best] < floor)


def test_language_id_keeps_languages_of_many_copies(spark):
    same = [(i, "the same words in every row", "en") for i in range(3000)]
    model = langid.fit(spark.createDataFrame(same, "doc_id long, text string, lang string"))
    assert model.languages == ["en"] and len(model.centroids) == 1
    r = random.Random(1)
    more = [(5000 + i, " ".join("".join(r.choices("vwxyz", k=4)) for _ in range(20)), "xx") for i in range(50)]
    rows = spark.createDataFrame([*same, *more, *((9000 + i, None if i % 2 else "", "yy") for i in range(30)), (9999, "!" * 9, "zz")], "doc_id long, text string, lang string")
    model = langid.fit(rows.select("text", "lang"))
    found = Counter((x.doc_id < 5000, x.lang_pred) for x in langid.predict(rows, model).where("doc_id < 9000").collect())
    assert found == {(True, "en"): 3000, (False, "xx"): 50}


def test_short_texts_take_little_memory():
    offsets = np.arange(10_001) * 3
    assert max(j - i for i, j in langid.few(offsets)) == langid.ROWS and sum(j - i for i, j in langid.few(offsets)) == 10_000


def test_fingerprints(spark):
    docs = corpus(8)
    rows = {r.doc_id: r for r in fingerprint.fingerprints(frame(spark, docs), k=64).collect()}

    def shingles(t):
        w = WORDS.findall(t)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    def likeness(a, b):
        a, b = shingles(a), shingles(b)
        return 1.0 if not a and not b else len(a & b) / len(a | b)

    for n, (i, t) in enumerate(docs):
        t, after = t or "", docs[(n + 1) % len(docs)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha(edited))
        assert abs(r.near_edited - likeness(t, edited)) < 0.25 and abs(r.near_next - likeness(t, after)) < 0.25
        if len(shingles(t)) < 64:
            assert r.n_distinct == len(shingles(t))
            if len(shingles(edited)) < 64:
                assert r.near_edited == pytest.approx(likeness(t, edited))
    plan = fingerprint.fingerprints(frame(spark, docs))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sketches_merge(spark):
    from pyspark.sql import functions as F

    r = random.Random(4)
    words = [str(r.random()) for _ in range(900)]
    a, b = " ".join(words[:600]), " ".join(words[300:])
    rows = spark.createDataFrame([(a, b, " ".join(words))], "a string, b string, c string").select(*(fingerprint.sketch(F.col(c), 128).alias(c) for c in "abc"), fingerprint.sketch(F.col("b"), 64).alias("d"))
    a, b, c, d = (F.col(k) for k in "abcd")
    got = rows.select(fingerprint.resemblance(a, b).alias("r"), fingerprint.containment(a, b).alias("c"), fingerprint.distinct_shingles(a).alias("n"), F.size(F.array_intersect(fingerprint.merge(a, b)["hashes"], c["hashes"])).alias("m"), fingerprint.merge(a, d).alias("few"), fingerprint.resemblance(a, d).alias("q")).first()
    assert abs(got.r - 296 / 896) < 0.15 and abs(got.c - 296 / 596) < 0.2 and abs(got.n - 596) < 180 and got.m >= 126
    assert got.few.k == 64 and len(got.few.hashes) == 64 and abs(got.q - 296 / 896) < 0.2


def test_sketches_of_parts_merge_into_that_of_the_whole(spark):
    from pyspark.sql import functions as F

    r = random.Random(5)
    words = ["".join(r.choices("abcdefg", k=4)) for _ in range(500)]
    parts = [("x", " ".join(words[i : i + 24])) for i in range(0, 480, 20)] + [("y", ""), ("y", "a b")] + [("z", None)]
    made = fingerprint.merge_all(spark.createDataFrame(parts, "g string, t string").select("g", fingerprint.sketch(F.coalesce("t", F.lit("")), 50).alias("sketch")), "g")
    whole = spark.createDataFrame([(" ".join(words[:484]),)], "t string").select(fingerprint.sketch(F.col("t"), 50).alias("s")).first().s
    got = {x.g: x.sketch for x in made.collect()}
    assert got["x"] == whole and len(got["y"].hashes) == 1 and got["z"].hashes == [] and got["z"].k == 50


def test_next_document_after_null_ids_and_ranges(spark):
    docs = [(None, "b c d"), (None, "a b c d e f"), (5, "first one here"), (700_000, "far"), (2_000_000, "lot"), (2_000_001, "end of all")]
    rows = {(r.doc_id, r.n_chars): r for r in fingerprint.fingerprints(frame(spark, docs)).collect()}
    order = [docs[1], docs[0], *docs[2:]]
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        assert rows[i, len(t)].edited_sha256 == sha(t[: len(t) - len(t) // 2] + after[: len(t) // 2]), i


def test_packing(spark):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.tokenizer_path())
    docs = corpus(9)
    docs += [docs[20], (2000, "word " * 5000)]
    rows = packing.pack(frame(spark, docs)).collect()
    by, bins, total, want = defaultdict(list), defaultdict(list), 0, Counter()
    for i, t in docs:
        ids = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        cut = len(ids) - (math.ceil(len(ids) / 2048) - 1) * 2048
        edges = [0, *range(cut, len(ids) + 1, 2048)]
        want.update((i, k, a, z - a, zlib.crc32(ids[a:z].tobytes())) for k, (a, z) in enumerate(zip(edges, edges[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= math.ceil(total / 2048) * 1.1 + 1


def test_encoder_equals_the_tokenizers_library():
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.tokenizer_path())
    assert slow.encode("a<|endoftext|>b", add_special_tokens=False).ids == [64, 50256, 65]
    texts = [t or "" for _, t in corpus(10)] + ["\n\n x", "x \n y", "a\n\nb\n", "don't we'll 12 34\tx", " \n\nw", " a b ", "a\x01b c", "　x y z", "..\n..", "\n", "a<|endoftext|>b", "x <|endoftext|> y", "<|endoftext|>", " <|endoftext|>\n"]
    ids, at, *_ = packing.encoder(packing.tokenizer_path()).encode(texts)
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == slow.encode(t, add_special_tokens=False).ids, t


def test_best_fit():
    assert sorted(map(len, packing.best_fit(np.array([6, 5, 4, 3, 2]), 10))) == [2, 3]
    assert packing.best_fit(np.array([], np.int64), 10) == []


def test_nearest(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 8)).astype(np.float32)
    x[100:220] = x[100]  # one vector in many rows
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(900, None, "x"), (901, [0.0] * 8, "x"), (902, [float("nan")] + [1.0] * 7, "x"), (903, [None] + [1.0] * 7, "x"), (904, [float("inf")] * 8, "x"), (905, [1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = defaultdict(list)
    for a in ann.nearest(df, df.where("vec_id % 20 = 0"), k=5).collect():
        got[a.query_id].append((a["rank"], a.vec_id, a.score))
    d, hit = x.astype(float), 0
    assert set(got) == set(range(0, 400, 20))
    for q, found in got.items():
        s = (d * d[q]).sum(1)
        best = [j for j in np.lexsort((np.arange(400), -s)) if j != q][:5]
        hit += len(set(best) & {v for _, v, _ in found})
        assert [n for n, _, _ in sorted(found)] == [1, 2, 3, 4, 5]
        assert all(abs(c - s[v]) < 1e-12 for _, v, c in found) and [(-c, v) for _, v, c in sorted(found)] == sorted((-c, v) for _, v, c in found)
    assert hit / (5 * len(got)) >= 0.9
    assert ann.nearest(df.where("vec_id > 899"), df, k=5).count() == 0
    few = df.where("vec_id < 3")
    assert ann.nearest(few, few, k=5).count() == 6


def test_secrets(spark):
    live = "ghp_" + "a1B2" * 9
    texts = ["password=abcdefgh12 x", "PassWord : 'short'", "token=secret:abcdefghij", "AKIA" + "Q" * 12 + " AKIAQ", "0" * 31 + " " + "f" * 40, None, "", "é𝒳 api_key=abcdefgh AKIA" + "Z" * 20 + "a" * 33, f"k {live}", "xoxb-" + "1" * 12, "xoxb-" + "1" * 12, "secret=" + "a" * 40, "passwd==x_api-key"]
    docs = list(enumerate(texts)) + [(0, texts[0])]
    df = spark.createDataFrame([(i, t, f"s{i % 5}", 3, "y") for i, t in docs], "doc_id long, text string, source string, n_live int, same string")
    rows = secrets.scan(df)
    got = {r.doc_id: r for r in rows.collect()}
    assert rows.count() == len(docs)
    patterns = [(re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 8), (re.compile("AKIA[A-Z0-9]+"), 0, 16), (re.compile("[0-9a-f]+"), 0, 32)]
    for i, t in enumerate(texts):
        spans = sorted((m.start(), k, m.end()) for k, (p, g, least) in enumerate(patterns) for m in p.finditer(t or "") if len(m[g]) >= least)
        told = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{z}" for a, k, z in spans)
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3)), t
        assert r.base_sha256 == sha(told) and set(told.split(",")) - {""} <= set(r.spans.split(","))
    assert got[8].spans == f"known:2:{2 + len(live)}" and got[9].spans == ""  # the other is in the hands of two owners
    assert got[9].n_copied == 1 and got[8].n_live == 1
    wide = spark.createDataFrame([(k, f"k {live}", "one", 3, "y") for k in range(20)], df.schema)  # copied widely within one owner
    assert {(r.n_copied, r.spans) for r in secrets.scan(wide).collect()} == {(1, "")} and {(r.n_live, r.spans) for r in secrets.scan(wide.where("doc_id < 5")).collect()} == {(1, f"known:2:{2 + len(live)}")}
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert clean[0] == "[SECRET] x" and clean[8] == "k [SECRET]" and clean[5] is None and clean[7] == "é𝒳 [SECRET] [SECRET]" + "[SECRET]"
    plan = rows._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def unigram_model(path, **norm):
    """A small unigram model: bytes, letters and some overlapping words with scores."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    kinds = m.SentencePiece
    for piece, score, kind in [("<unk>", 0, kinds.UNKNOWN), ("<s>", 0, kinds.CONTROL), ("</s>", 0, kinds.CONTROL), *((f"<0x{b:02X}>", 0, kinds.BYTE) for b in range(256))]:
        m.pieces.add(piece=piece, score=score, type=kind)
    words = ["▁", "▁t", "▁th", "he", "▁the", "in", "ing", "▁ing", "est", "▁ok", "words", "▁Two", "ab", "bc", "abc", "cd", "▁▁"]
    for k, w in enumerate([*words, *"abcdefghijklmnopqrstuvwxyzTé.!"]):
        m.pieces.add(piece=w, score=-2 - 0.37 * k if k < len(words) else -9 - 0.01 * k, type=kinds.NORMAL)
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback, m.trainer_spec.unk_id, m.trainer_spec.vocab_size = m.trainer_spec.UNIGRAM, True, 0, len(m.pieces)
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.escape_whitespaces, m.normalizer_spec.remove_extra_whitespaces = "identity", norm.get("prefix", True), True, norm.get("trim", False)
    path.write_bytes(m.SerializeToString())
    return str(path)


@pytest.mark.parametrize("kind", ["bpe", "unigram", "unigram trims", "unigram without prefix"])
def test_sentencepiece(spark, tmp_path, kind):
    import sentencepiece

    path = sentencepiece_tok.model_path() if kind == "bpe" else unigram_model(tmp_path / "m.model", trim="trims" in kind, prefix="without" not in kind)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = corpus(12) + [(3001, "\x01 x"), (3002, "the thing  testing abcd the   ok "), (3003, "  in"), (3004, "a <0x41> <unk> <s>b</s>")]
    if kind == "bpe":
        docs.append((3000, "a▁b  c"))
    rows = {r.doc_id: r for r in sentencepiece_tok.digests(frame(spark, docs), path).collect()}
    for i, t in docs:
        ids = np.array(sp.encode(t or ""), "<u4")
        assert (rows[i].n_ids, rows[i].ids_crc32, rows[i].n_differ) == (len(ids), zlib.crc32(ids.tobytes()), 0), t
        assert rows[i].decoded_sha256 == sha(sp.decode(ids.tolist())), t


def test_a_wrong_backend_shows():
    b = sentencepiece_tok.Backend(sentencepiece_tok.model_path())
    assert b.remembered.encode(["plain words"])[2].tolist() == [0]
    b.units.model = type(b.units.model)({p: i for i, p in enumerate(b.pieces)}, [], unk_token=b.pieces[0], fuse_unk=True, byte_fallback=True)  # no merges
    b.remembered._clear()
    ids, at, flags, back = b.remembered.encode(["plain words"])
    assert flags.tolist() == [2] and b.unmarked(back[0]) == "plain words" and len(ids) == len("▁plain▁words")


def test_chat(spark):
    r = random.Random(6)
    said = ["</s>[INST] ok [/INST]", "<|turn|>", "<\\|end|>\n", "", None, "a\nb", "<", "|end|>", "𝒳"]
    turns = [(c, t, r.choice(["user", "assistant", "system\nx", "a\\n"]), r.choice(said)) for c in range(20) for t in range(r.choice([1, 2, 40]))]
    turns += [(None, 0, "assistant", "x"), (3, 0, None, "tie")]
    df = spark.createDataFrame([(*t, "z") for t in turns], "conv_id long, turn int, role string, text string, formatted string")
    formatted = chat.format_chats(df)
    rows = {x.conv_id: x for x in chat.read_back(formatted).collect()}
    by = defaultdict(list)
    for c, t, role, text in turns:
        by[c].append((t, role is not None, role or "", text is not None, text or ""))
    for c, ts in by.items():
        ts = [(role, text) for _, _, role, _, text in sorted(ts)]
        loss = "".join(t for role, t in ts if role == "assistant")
        x = rows[c]
        assert (x.n_turns, x.turns_sha256) == (len(ts), sha("".join(f"{a}\n{b}\n" for a, b in ts)))
        assert (x.loss_chars, x.loss_sha256) == (len(loss), sha(loss))
        whole = "".join(f.formatted for f in sorted(formatted.where(f"conv_id <=> {c if c is not None else 'NULL'}").collect(), key=lambda f: f.segment))
        assert whole == chat.marked_turns(ts) and x.formatted_chars == len(whole)


def test_templates_that_rewrite_history_are_found():
    def counting(turns):
        return f"[{len(turns)}]" + "".join(f"<{r}>{t}" for r, t in turns)

    _, found, rewritten = chat.spans([("user", "a"), ("assistant", "b")], counting)
    assert rewritten == [0, 1] and found[1][2] >= 0
    _, found, rewritten = chat.spans([("user", "a"), ("assistant", "b")], lambda ts: "".join(f"{r}:{t};" for r, t in ts))
    assert rewritten == [] and found == [(0, 7, 5, 6), (7, 19, 17, 18)]


def test_long_conversations_equal_the_whole_rendering(spark):
    def rewriting(turns):  # counts turns, and drops what was thought before the last turn
        last = len(turns) - 1
        return f"<s>[{len(turns)}]" + "".join(f"<{r}>{t if i == last else t.split('THINK')[0]}" for i, (r, t) in enumerate(turns))

    turns = [(1, i, ("user", "assistant")[i % 2], f"said {i}" + "THINK so" * (i % 3 == 1)) for i in range(40)]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    (row,) = chat.format_chats(df, rewriting).collect()
    assert row.formatted == rewriting([t[2:] for t in turns]) and row.n_turns == 40 and row.rewritten == list(range(40))
    learnt = [t[3] if t[1] == 39 else t[3].split("THINK")[0] for t in turns if t[2] == "assistant"]
    assert [row.formatted[x.start : x.stop] for x in row.loss] == learnt

    def declared(turns):
        return rewriting(turns)

    declared.stateless = True
    with pytest.raises(Exception, match="declared stateless"):
        chat.format_chats(df, declared).collect()


@pytest.mark.parametrize("kind", ["clusters", "noise"])
def test_parts_of_parts(spark, monkeypatch, kind):
    """All parts are deep: recall on vectors outside the fitting sample, and how much of the table a query searches."""
    monkeypatch.setattr(ann, "DEEP", 100)
    r = np.random.default_rng(3)
    x = r.normal(size=(4000, 16)) * (0.3 if kind == "clusters" else 1) + (r.normal(size=(40, 16))[r.integers(0, 40, 4000)] * 2 if kind == "clusters" else 0)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(4000 + i, x[0].tolist()) for i in range(50)] + [(5000, None), (5001, [0.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = df.where("vec_id % 20 = 0")
    found = Counter()
    got = {}
    for a in ann.nearest(df, queries, k=10, sample=1500).collect():
        got.setdefault(a.query_id, []).append((-a.score, a.vec_id, a["rank"]))
    every = {i: np.array(v) for i, v in rows if v and any(v)}
    ids, m = np.array(list(every)), np.array(list(every.values()))
    for q, list_ in got.items():
        assert [n for _, _, n in sorted(list_)] == list(range(1, 11)) and len({i for _, i, _ in list_}) == 10 and q not in {i for _, i, _ in list_}
        score = (m * every[q]).sum(1)
        best = sorted(zip(-score, ids, strict=True))
        true = {int(i) for _, i in [b for b in best if b[1] != q][:10]}
        found[len(true & {i for _, i, _ in list_})] += 1
    assert set(got) == {i for i in every if i % 20 == 0}
    assert sum(n * c for n, c in found.items()) / (10 * len(got)) >= 0.9


def test_a_late_change_of_a_declared_template_shows(spark, monkeypatch):
    """From its 20th turn on a conversation gets a mark, which no segment shows by itself."""

    def late(turns):
        return "".join(f"[{t}]" + "!" * (i >= 20) for i, (_, t) in enumerate(turns))

    def declared(turns):
        return late(turns)

    declared.stateless = True
    turns = [(c, i, "assistant", f"said {i}") for c, n in ((1, 40), (2, 16), (3, 19)) for i in range(n)]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    rows = {r.conv_id: r.formatted for r in chat.format_chats(df, late).collect()}
    assert rows[1] == late([t[2:] for t in turns if t[0] == 1])
    with pytest.raises(Exception, match="declared stateless"):
        chat.format_chats(df, declared).collect()
    assert {r.conv_id for r in chat.format_chats(df.where("conv_id > 1"), declared).collect()} == {2, 3}


def test_empty_tables(spark):
    none = frame(spark, []).limit(0)
    for result in (suffix_dedup.remove_repeats(none), substring_dedup.remove_later(none), ngram_join.classes(none), fingerprint.fingerprints(none), packing.pack(none), secrets.scan(none), sentencepiece_tok.encode(none), langid.predict(none, langid.fit(none))):
        assert result.count() == 0
    chats = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat.read_back(chat.format_chats(chats)).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(vectors, vectors).count() == 0


def test_rows_of_one_id_keep_their_own_words(spark):
    """Null and shared ids: every row loses its own repeats, null ids come first, then ids, then rows of one id in some fixed order."""
    r = random.Random(12)
    words = lambda n: " ".join("".join(r.choices("abcdefgh", k=7)) for _ in range(n))
    w, p, clean = words(40), words(30), words(60)
    docs = [(1, w), (7, w), (7, clean), (None, f"a {p}"), (None, f"b b b {p} tail tail"), (5, p), (-(1 << 63), f"{p} x"), (7, clean)]
    kept = sorted(((x.doc_id, x.kept) for x in substring_dedup.remove_later(frame(spark, docs)).collect()), key=str)
    told = [(1, w), (7, ""), (7, clean), (7, clean), (5, ""), (-(1 << 63), "x")]
    assert [x for x in kept if x[0] is not None] == sorted(told, key=str)
    assert [x[1] for x in kept if x[0] is None] in ([f"a {p}", "b b b tail tail"], ["a", f"b b b {p} tail tail"])


def test_columns_of_any_name_go_through_the_stages(spark):
    names = ("_row", "_id", "_n", "row", "n", "own", "_doc", "_same", "_all", "_clean", "same", "all", "clean", "changed", "doc", "sub", "spans", "asked", "component_id", "d", "f")
    text = "token=abcdefgh12 and " + " ".join(f"w{i}x" for i in range(80))
    docs = spark.createDataFrame([(1, text, "s", len(text), *(f"mine {n}" for n in names)), (2, "short", None, 5, *(None for _ in names))], "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    mine = {r.doc_id: r[4:] for r in docs.collect()}
    for stage in (ngram_join.keep_one, suffix_dedup.without_repeats, secrets.redact, lambda d: langid.keep_known(d, langid.fit(d.select("text", F.lit("xx").alias("lang"))))):
        out = stage(docs)
        assert out.columns == docs.columns
        assert {r.doc_id: tuple(r[4:]) for r in out.collect()}.items() <= mine.items()
    (clean,) = secrets.redact(docs).where("doc_id = 1").collect()
    assert clean.text.startswith("[SECRET] and") and clean.n_chars == len(clean.text)
    pieces = packing.pack(docs)
    assert {r.doc_id for r in pieces.collect()} == {1, 2}


def test_keys_that_two_rows_share_are_parted(spark, monkeypatch):
    from glosswork.llm import _base

    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (None, "a"), (None, None)], "doc_id long, text string")
    monkeypatch.setattr(_base, "row_keys", lambda *_: (F.coalesce(F.col("doc_id") * 0, F.lit(0)).alias("doc"), F.xxhash64("doc_id", "text").alias("sub")))
    assert rows.select(_base.one_key(rows).alias("k")).distinct().count() == 5


def test_null_ids(spark):
    docs = frame(spark, [(None, "one two three four five six"), (None, None), (1, "one two three four five six")])
    for result in (suffix_dedup.remove_repeats(docs), substring_dedup.remove_later(docs), ngram_join.classes(docs), fingerprint.fingerprints(docs), packing.pack(docs), secrets.scan(docs), sentencepiece_tok.encode(docs)):
        assert Counter(r.doc_id for r in result.collect()) == {None: 2, 1: 1}


def test_stages_tell_rows_of_one_id_apart(spark):
    """Null, shared and repeated ids through all stages: no row gets the text of another, and a repeated row loses none."""
    r = random.Random(8)

    def prose(n=120):
        return " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))

    passage, live = prose(60), "ghp_" + "a1B2" * 9
    twice, alone = prose(), prose()
    null = [f"{prose(40)} {passage}", prose(), f"token=abcdefgh12 {prose()}", f"k {live} {prose()}"]
    shared = [f"{prose(40)} {passage}", prose(), f"{prose(3)} password=abcdefgh13 {prose()}"]
    docs = [(1, twice), (1, twice), (2, alone), *((None, t) for t in null), *((3, t) for t in shared), (None, null[1]), (None, alone), (4, twice)]
    near = ngram_join.keep_one(frame(spark, docs))
    assert near.columns == frame(spark, docs).columns
    kept = [(1, twice), (2, alone), *((None, t) for t in null), *((3, t) for t in shared)]
    assert Counter((x.doc_id, x.text) for x in near.collect()) == Counter(kept)
    cut = suffix_dedup.without_repeats(frame(spark, kept))
    bare = [(i, t.replace(passage, "")) for i, t in kept]
    got = sorted(((x.doc_id or 0, x.text, x.n_chars) for x in cut.collect()), key=str)
    for (i, t, n), (j, b) in zip(got, sorted(((i or 0, b) for i, b in bare), key=str), strict=True):
        assert i == j and n == len(t) and b.startswith(t) and len(b) - len(t) <= 4 * b.endswith(" "), (t, b)  # what stands before the passage may be alike too
    secret = re.compile("token=abcdefgh12|password=abcdefgh13|" + live)
    clean = secrets.redact(frame(spark, bare))
    assert Counter((x.doc_id, x.text) for x in clean.collect()) == Counter((i, secret.sub("[SECRET]", b)) for i, b in bare)
    every = secrets.redact(suffix_dedup.without_repeats(near))
    pieces = packing.pack(every)
    assert Counter(x.doc_id for x in every.collect()) == Counter(i for i, _ in kept) and {x.doc_id for x in pieces.collect()} == {i for i, _ in kept}


def test_units_stay_right_when_a_worker_clears_them():
    from glosswork.llm._units import LONGEST, Units

    asked = []

    def learn(units):
        asked.extend(units)
        return [[ord(c) for c in u] for u in units], [int("x" in u) for u in units]

    r = random.Random(8)
    units = Units(lambda t: t.replace(" ", "\x01 ").split("\x01"), learn, 20, lambda ids: ["".join(map(chr, x)) for x in ids])
    for _ in range(60):
        texts = ["", "often and " * 3, *("".join(r.choices("abxyz ", k=r.randint(0, 30))) for _ in range(4)), "x" * (LONGEST + 1)]
        ids, at, flags, back = units.encode(texts)
        assert ["".join(map(chr, ids[a:z])) for a, z in zip(at[:-1], at[1:], strict=True)] == texts == back
        assert flags.tolist() == [sum("x" in u for u in t.replace(" ", "\x01 ").split("\x01")) for t in texts]
        assert len(units._number) == len(units._size) == len(units._uses) == len(units._text)
    assert asked.count(" and") == 1 and asked.count("x" * (LONGEST + 1)) > 1


def test_workers_drop_what_other_tasks_kept():
    from glosswork.llm import _base

    _base.keeping("one")["a"] = 1
    assert list(_base.trimmed(iter, "one")([1, 2])) == [1, 2] and _base.keeping("one") == {"a": 1}
    assert list(_base.trimmed(iter)([3])) == [3] and _base.keeping("one") == {}
    _base.release()
