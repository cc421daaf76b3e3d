"""Fill-in-the-middle, centroid clustering and personal data, against brute force."""

import random
import re
import string
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from glosswork.llm import centroids, fill_middle, pii


def sha(text):
    return sha256(text.encode()).hexdigest()


def frame(spark, docs, extra=True):
    rows = [(i, t, "x", "y", 1) for i, t in docs] if extra else docs
    return spark.createDataFrame(rows, "doc_id long, text string, n string, form string, fim int" if extra else "doc_id long, text string")


TEXTS = ["", None, "a", "ab cd\nefg  é𝒳 12", "\0", "<P>", "x <S", "S><", "<M> said", "<P" + ">" * 3, "word " * 3000, "z" * 200_000, "🙂" * 500, "<", "a<S" * 40]


# --- fill in the middle ---


def brute_fill(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    docs = [(i, TEXTS[i % len(TEXTS)]) for i in range(150)] + [(None, "null id text"), (7, "same id"), (7, "same id")]
    out = fill_middle.transform(frame(spark, docs))
    assert out.columns == ["doc_id", "n", "form", "fim"]
    got = out.select("doc_id", "form", "fim.*", fill_middle.restored(F.col("fim.output"), F.col("fim.form")).alias("back")).toDF("doc_id", "own", "n", "kind", "prefix", "middle", "output", "back").collect()
    assert len(got) == len(docs) and {r.kind for r in got} == {"plain", "psm", "spm"} and {r.own for r in got} == {"y"}
    told = sorted(((i, *brute_fill(i, t), t or "") for i, t in docs), key=str)
    assert sorted(((r.doc_id, r.n, r.kind, r.prefix, r.middle, r.output, r.back) for r in got), key=str) == told


def test_fill_in_middle_of_nothing_and_by_other_units(spark):
    assert fill_middle.transform(frame(spark, [])).collect() == []
    rows = fill_middle.transform(frame(spark, [(i, "one two three") for i in range(40)], False), units=r"\S+\s*|\s+", transformed=100, suffix_first=100).select("fim.*").collect()
    assert {r.form for r in rows} == {"spm"} and {r.prefix_chars for r in rows} <= {0, 4, 8, 13} and {r.n for r in rows} == {3}


def test_a_matcher_holds_no_units():
    import tracemalloc

    text, pattern = "ab, " * 500_000, re.compile(fill_middle.UNITS)
    tracemalloc.start()
    n = fill_middle.count_units(pattern, text)
    assert fill_middle.places(pattern, text, n // 3, n // 2) == (4 * (n // 9) + [0, 2, 3][n // 3 % 3], 4 * (n // 6))
    assert tracemalloc.get_traced_memory()[1] < 100_000
    tracemalloc.stop()


# --- centroids ---


def brute_clusters(rows, k, rounds, size, scale, seed):
    kept = [(i, [int(np.floor(scale * np.float64(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((sha(f"{seed}:{'' if i is None else i}"), v) for i, v in kept)[:k]
    c = [list(v) for _, v in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, x), n) for n, x in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for n in range(len(c)):
            own = [v for (_, v), m in zip(kept, of, strict=True) if m == n]
            if own:
                c[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [near(v) for _, v in kept]
    return sorted((str(i), n, d, sum(x for x, m in found if m == n), sum(x for x, _ in found), c[n]) for (i, _), (d, n) in zip(kept, found, strict=True))


VECTORS = "vec_id long, embedding array<double>, cluster string"


@pytest.mark.parametrize("kind", ["spread", "grid", "copies", "large", "few"])
def test_centroids(spark, kind):
    r = random.Random(kind)
    size = 6
    make = {"spread": lambda: [r.gauss(0, 10) for _ in range(size)], "grid": lambda: [float(r.choice([-1, 0, 1])) for _ in range(size)], "copies": lambda: [0.5] * size, "large": lambda: [r.uniform(-1e5, 1e5) for _ in range(size)], "few": lambda: [r.random() for _ in range(size)]}[kind]
    rows = [(i, make()) for i in range(3 if kind == "few" else 400)]
    rows += [(1000, None), (1001, []), (1002, [1.0] * 5), (1003, [float("nan")] * 6), (1004, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1005, [float("inf")] * 6), (None, make()), *rows[:2]]
    df = spark.createDataFrame([(*x, "z") for x in rows], VECTORS)
    got = centroids.cluster(df, k=5, rounds=4, size=size).collect()
    assert sorted((str(x.vec_id), x.cluster, x.distance, x.cluster_inertia, x.inertia, list(x.centroid)) for x in got) == brute_clusters(rows, 5, 4, size, 1024, "3")


def test_no_vectors(spark):
    assert centroids.cluster(spark.createDataFrame([], VECTORS)).collect() == []
    assert centroids.cluster(spark.createDataFrame([(1, None, "z")], VECTORS)).collect() == []


def test_a_vector_too_large_is_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e30, 0.0], "z")], VECTORS), size=2).collect()


def test_the_annulus_leaves_centroids_out():
    r = np.random.default_rng(4)
    c = r.integers(-100, 100, (200, 8)) * np.geomspace(1, 1000, 200).astype(np.int64)[:, None]
    x = c[r.integers(0, 200, 3000)] + r.integers(-20, 20, (3000, 8))
    search = centroids.Annulus(c)
    n, d = search.nearest(x)
    every = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (d == every.min(axis=1)).all() and (n == every.argmin(axis=1)).all()
    assert search.compared < every.size / 2


def test_ties_on_the_border():
    c = np.array([[4, 0], [0, 4], [2, 0], [0, 0], [-4, 0], [2, 0]])
    x = np.array([[3, 0], [0, 2], [1, 0], [2, 2], [0, 0], [-2, 0]])
    n, d = centroids.Annulus(c).nearest(x)
    every = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert n.tolist() == every.argmin(axis=1).tolist() and d.tolist() == every.min(axis=1).tolist()


# --- personal data ---


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(d) * 2 if k % 2 else int(d) for k, d in enumerate(digits[::-1])]
    return sum(x // 10 + x % 10 for x in doubled) % 10 == 0


def brute_personal(text):
    found = []
    for rank, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                found.append((m.start(), rank, kind, m.end()))
    return [f"{k}:{a}:{z}" for a, _, k, z in sorted(found)]


def random_text(r):
    card = "".join(r.choice(string.digits) for _ in range(15))
    card += next(d for d in string.digits if luhn(card + d))
    bits = ["a@b.c", "@", "@@x.y", "me@host", "x.y+z@a-b.co.uk", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "0001.2.3.4", "1.2.3", card, f"{card[:4]} {card[4:8]}-{card[8:]}", "1234567890123456", "+1 (555) 123-4567", "+1 2", "+49.30.1234567", "++1 555 123 4567)", "Mr Adam", "call (017) 555-7713", "12-34", " ", "é", "𝒳", "\n", "-", ".", "word", "0", "5 5"]
    return "".join(r.choice(bits) + r.choice(["", " ", "", "."]) for _ in range(r.randrange(30)))


def test_base_spans():
    r = random.Random(9)
    for _ in range(4000):
        text = random_text(r)
        found, _ = pii.base_spans(text)
        assert [f"{pii.KINDS[k]}:{a}:{z}" for a, k, z in found] == brute_personal(text), text


def test_personal_data(spark):
    r = random.Random(10)
    docs = [(i, random_text(r)) for i in range(200)] + [(900, None), (None, "x@y.zz"), (901, "plain prose alone"), (902, ""), (3, "again a@b.cc"), (3, "again a@b.cc")]
    rows = pii.scan(frame(spark, docs)).collect()
    assert len(rows) == len(docs)
    told = sorted((str(i), sha(",".join(brute_personal(t))), *(sum(s.startswith(f"{k}:") for s in brute_personal(t)) for k in BASE)) for i, t in docs)
    assert sorted((str(x.doc_id), x.base_sha256, x.n_email, x.n_ip, x.n_card, x.n_phone) for x in rows) == told
    for x in rows:
        assert [s for s in x.spans.split(",") if s.split(":")[0] in BASE] == ([] if x.n_email + x.n_ip + x.n_card + x.n_phone == 0 else [s for s in x.spans.split(",") if s.split(":")[0] in BASE])
    assert next(x.spans for x in rows if x.doc_id == 901) == ""
    assert pii.scan(frame(spark, [])).collect() == []


def corpus_of_spans(r, n=400):
    """Texts with a planted span of a looser kind each, or a decoy."""
    out = []
    for i in range(n):
        a, b, c = (r.randrange(10**k, 10 ** (k + 1)) for k in (2, 2, 3))
        planted = [(f"please call me: ({a}) {b}-{c} thanks", True), (f"order no ({a}) {b}-{c} shipped", False), (f"her ssn {r.randrange(100, 600)}-{r.randrange(10, 99)}-{c} was", True), (f"part 000-00-{c} in", False), (f"mail to jane.doe{i} (at) mail{i} (dot) com or", True), ("so Dear Mr. Peter Stone said", True), (f"build {a}-{b}-{c} of the release", False), (f"write me{i}@host{i}.org or +1 (212) 555-{c}", True)]
        out.append((i, *planted[i % len(planted)]))
    return out


def test_added_spans(spark):
    planted = corpus_of_spans(random.Random(11))
    rows = {x.doc_id: x.spans for x in pii.scan(frame(spark, [(i, t) for i, t, _ in planted], False)).collect()}
    right = sum((rows[i] != "") == yes for i, _, yes in planted)
    assert right >= 0.95 * len(planted), [(t, rows[i]) for i, t, yes in planted if (rows[i] != "") != yes][:8]


def test_reliabilities_follow_the_votes():
    """Votes drawn from known reliabilities: they are found again."""
    r = np.random.default_rng(5)
    true = np.array([[[0.5, 0.45, 0.05]] * 6, [[0.02, 0.38, 0.6]] * 6])
    true[:, 2] = [0.0, 1.0, 0.0]  # one labeler never votes
    y = r.random(40_000) < 0.3
    codes = np.array([pii.encode(4, tuple(int(r.choice(3, p=true[int(t), j])) - 1 for j in range(6)), (False, False)) for t in y[:4000]])
    each, counts = np.unique(codes, return_counts=True)
    reliability, share = pii.fit_reliability(each, counts.astype(float) * 10)
    assert np.abs(reliability - true)[:, [0, 1, 3, 4, 5]].max() < 0.06 and abs(share[4] - 0.3) < 0.04
    p = pii.Model(reliability, share, pii.fit_classifier(each, counts, pii.posterior(each, reliability, share))).probability(codes)
    assert ((p > 0.5) == y[:4000]).mean() > 0.93


def test_patterns_are_read_back():
    for code in [pii.encode(k, v, b) for k in range(len(pii.KINDS)) for v in [(1, -1, 0, 1, 0, -1), (0,) * 6] for b in [(True, False), (False, True)]]:
        k, v, b = pii.decode(code)
        assert pii.encode(k, tuple(v), tuple(b)) == code


def test_long_runs_take_linear_time():
    for text in ("9" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "a.b-" * 100_000, "+1 " * 100_000, "AB12" * 80_000, "a:" * 100_000, "@" * 200_000, "a@" * 100_000):
        pii.base_spans(text)
        pii.loose_spans(text + "(", True)
