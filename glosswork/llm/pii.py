"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs the labelers, a classifier decides.

1. Candidates. Four base kinds have fixed patterns and checks; what passes is found as it is and always stays. Looser patterns propose further spans: written-out
   e-mail addresses, telephone numbers without a plus, card numbers whose check fails or whose length is unusual, account numbers, identity numbers, IPv6 addresses and names
   after a form of address.
2. Labelers vote for, against or not at all on every candidate, base ones included: the strict pattern, a checksum, a gazetteer (top-level domains, reserved hosts and
   networks, calling codes, given names), words before the span that announce such data, words that announce other numbers, and the shape of what stands around it.
3. A candidate's kind, votes and shape make one pattern. Patterns are counted over the whole corpus by a grouped aggregation with partial sums; there are at most
   `len(KINDS) * 3 ** len(LABELERS) * 2 ** len(SHAPE)` of them, whatever the corpus, and a few hundred in practice.
4. On these counts expectation-maximisation estimates each labeler's reliability by kind of truth (its chances to vote for, against or not for personal data and for
   other strings) together with the share of personal data of each kind. It starts from, and is held by pseudo-counts to, labelers better than chance.
5. A logistic regression is trained on all patterns with their counts and posterior labels, on votes, shape and kind; it doesn't assume that labelers err independently. Candidates that
   it gives `LEAST` or more are added where they don't overlap a base span or a better one.

Positions are code points, ends exclusive. All patterns run in linear time: repetitions that could be tried again at every place of a long run are possessive, and
local parts of addresses are read backwards from the @.

Defined cases: null text counts as empty; repeated rows each get their spans; a null doc_id stays null; other columns are ignored; an empty table gives an
empty result; without candidates beside base ones nothing is added.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.llm._base import cut, text_buffer, trimmed

# Kinds in order, the first four of them base kinds.
KINDS = ("email", "ip", "card", "phone", "email_written", "phone_local", "card_like", "account", "identity", "ip6", "name")
N_BASE = 4
LABELERS = ("pattern", "checksum", "gazetteer", "before", "other_number", "around")
SHAPE = ("grouped", "long")
#: A candidate is added from this probability on.
LEAST = 0.8

# Patterns. Digits are ASCII.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOOSE = {
    "email_written": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?[\[({](?:at|AT|@)[\])}] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[({](?:dot|DOT)[\])}]) ?[A-Za-z0-9-]{2,63}){1,4}(?![A-Za-z0-9-])"),
    "phone_local": re.compile(r"(?<![0-9A-Za-z+.,-])(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ /.-])[0-9]{3,4}[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4})?(?![0-9A-Za-z]|[.,-][0-9])"),
    "account": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "identity": re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    "ip6": re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])"),
    "name": re.compile(r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? ([A-ZÀ-Ý][a-zà-ÿ]{1,30}(?: [A-ZÀ-Ý][a-zà-ÿ]{1,30})?)"),
}

# Gazetteers.
DOMAINS = frozenset("com org net edu gov io de fr es it nl eu uk ch at be pt pl se no dk fi ie us ca au jp cn in br mx ru info biz dev app me co".split())
RESERVED_HOSTS = frozenset("example.com example.org example.net localhost.localdomain".split())
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 354 358 359 370 371 372 380 385 386 420 421 852 880 886 966 971 972".split())
GIVEN_NAMES = frozenset(
    "James John Robert Michael William David Richard Joseph Thomas Charles Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Emma Olivia Noah Liam Lucas Hans Peter Klaus Wolfgang Jürgen Anna Maria Ursula Monika Petra Sabine Jean Pierre Michel André Philippe Marie Nathalie Isabelle Sylvie Camille José Antonio Manuel Francisco Juan Carmen Ana Isabel Laura Lucía Wei Li Ming Yuki Hiro Ahmed Fatima Omar Priya Arjun".split()
)
#: Words that announce personal data of a kind, and words that announce other numbers.
ANNOUNCE = {
    "email": "mail e-mail email contact contacto courriel write",
    "phone": "phone tel tel. telephone call mobile cell fax telefon anrufen téléphone teléfono",
    "card": "card visa mastercard amex credit debit karte carte tarjeta",
    "ip": "ip address host client server login from",
    "account": "iban account konto compte cuenta bank",
    "identity": "ssn social security insurance",
    "name": "dear by from signed sincerely regards contact",
}
FAMILY = ("email", "ip", "card", "phone", "email", "phone", "card", "account", "identity", "ip", "name")
OTHER_NUMBER = frozenset("order invoice version isbn issn doi ticket issue page no nr id ref reference part serial sku item lot batch build release section figure table chapter".split())
WORDS_BEFORE = 40

_ANNOUNCE = {k: frozenset(v.split()) for k, v in ANNOUNCE.items()}
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
SPAN = "struct<start: int, stop: int, kind: int, pattern: int>"


def apart(taken: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans (start, kind, end) that overlap none of taken."""
    taken = sorted(taken)
    reach = list(accumulate((z for _, z in taken), max))
    kept = []
    for a, k, z in spans:
        at = bisect(taken, (z, -1))  # those that begin before the span's end
        if not at or reach[at - 1] <= a:
            kept.append((a, k, z))
    return kept


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) << (k & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def account_checks(text: str) -> bool:
    """The remainder by 97 of an account number, letters as two digits, its first four characters last."""
    plain = text.replace(" ", "")
    return len(plain) >= 15 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: what stands before an @ is read back to the last one, so that every character is read once."""
    done, at = 0, text.find("@")
    while at >= 0:
        head = text[done:at]
        start = at - (len(head) - len(head.rstrip(LOCAL)))
        if start < at and (host := HOST.match(text, at + 1)):
            yield start, host.end()
            done = host.end()
        else:
            done = at + 1
        at = text.find("@", done)


def octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the base kinds, and of card-like matches that fail."""
    found, failed = [], []
    if "@" in text:
        found += [(a, 0, z) for a, z in emails(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if octets(m.group())]
    for m in CARD.finditer(text):
        if m.end() - m.start() < 12:
            continue
        digits = digits_of(m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
        elif 13 <= len(digits) <= 19:
            failed.append((m.start(), KINDS.index("card_like"), m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m.group())) <= 15]
    return sorted(found), failed


def loose_spans(text: str, numbers: bool) -> list[tuple[int, int, int]]:
    found = []
    for k, kind in enumerate(KINDS):
        if kind in LOOSE and (numbers or kind in ("email_written", "name")) and (kind != "email_written" or any(b in text for b in "[({")):
            found += [(*((m.start(1), k, m.end(1)) if kind == "name" else (m.start(), k, m.end())),) for m in LOOSE[kind].finditer(text)]
    return found


def votes(text: str, start: int, kind: int, stop: int) -> tuple[int, ...]:
    """Each labeler's vote: 1 for personal data, -1 against, 0 for none."""
    said, family = text[start:stop], FAMILY[kind]
    digits = digits_of(said)
    pattern = 1 if kind < N_BASE or KINDS[kind] in ("account", "identity", "ip6") else 0
    checksum = 0
    if family == "card":
        checksum = 1 if luhn(digits) else -1
    elif family == "account":
        checksum = 1 if account_checks(said) else -1
    elif family == "identity":
        checksum = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    gazetteer = 0
    if family == "email":
        host = re.split(r"[@)\]}]", re.sub(r" ?[\[({](?:dot|DOT)[\])}] ?", ".", said))[-1].strip().lower()
        gazetteer = -1 if host in RESERVED_HOSTS else 1 if host.rsplit(".", 1)[-1] in DOMAINS else -1
    elif kind == 1:
        first, second = (int(p[-3:]) for p in said.split(".")[:2])
        gazetteer = -1 if first in (0, 127, 255) or (first, second) == (192, 168) or first == 10 else 1
    elif family == "phone":
        gazetteer = 0 if kind != 3 else 1 if any(digits[:n] in CALLING_CODES for n in (1, 2, 3)) else -1
    elif family == "name":
        gazetteer = 1 if said.split(" ")[0] in GIVEN_NAMES else 0
    words = [w.lower() for w in _WORD.findall(text[max(0, start - WORDS_BEFORE) : start])]
    before = 1 if any(w in _ANNOUNCE[family] for w in words[-4:]) else 0
    other = -1 if family != "name" and any(w in OTHER_NUMBER for w in words[-2:]) else 0
    left, right = text[start - 1 : start], text[stop : stop + 1]
    around = -1 if left.isalnum() or right.isalnum() or left in ("_", "=", "/", "#") or right in ("_", "=", "/") else 0
    return pattern, checksum, gazetteer, before, other, around


def shape(text: str, start: int, stop: int) -> tuple[bool, bool]:
    """grouped (a separator within), long (more than 16 characters)."""
    said = text[start:stop]
    return any(c in said for c in " -()"), stop - start > 16


def encode(kind: int, cast: tuple[int, ...], bits: tuple[bool, ...]) -> int:
    code = kind
    for v in cast:
        code = code * 3 + v + 1
    for b in bits:
        code = code * 2 + b
    return code


def decode(code: int) -> tuple[int, list[int], list[bool]]:
    bits, cast = [], []
    for _ in SHAPE:
        code, b = divmod(code, 2)
        bits.append(bool(b))
    for _ in LABELERS:
        code, v = divmod(code, 3)
        cast.append(v - 1)
    return code, cast[::-1], bits[::-1]


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, spans (array of SPAN, by start, then kind, then stop) of each row of docs (doc_id, text): base spans and what may be personal data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.int32()), ("pattern", pa.int32())])
        for batch in batches:
            column, rows = batch.column("text"), []
            data, offsets = text_buffer(column)
            digits = np.searchsorted(np.flatnonzero(data - np.uint8(0x30) < 10), offsets)
            numbers = (digits[1:] > digits[:-1]).tolist()
            for i in range(batch.num_rows):
                text = column[i].as_py() or ""
                found, failed = base_spans(text) if numbers[i] or "@" in text else ([], [])
                more = apart([(a, z) for a, _, z in found], failed + loose_spans(text, numbers[i]))
                rows.append([{"start": a, "stop": z, "kind": k, "pattern": encode(k, votes(text, a, k, z), shape(text, a, z))} for a, k, z in sorted(found + more)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(of))], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), f"doc_id long, spans array<{SPAN}>")


@dataclass
class Model:
    #: For each truth (other, personal) and labeler, the chances of -1, 0 and 1.
    reliability: np.ndarray
    #: The share of personal data among candidates of each kind.
    share: np.ndarray
    weights: np.ndarray

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return _sigmoid(features(codes) @ self.weights)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _told(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds, votes and shapes of patterns."""
    told = [decode(c) for c in codes.tolist()]
    return np.array([k for k, _, _ in told], np.int64), np.array([v for _, v, _ in told], np.int64).reshape(-1, len(LABELERS)), np.array([b for _, _, b in told], float).reshape(-1, len(SHAPE))


def features(codes: np.ndarray) -> np.ndarray:
    """A constant, each kind, each labeler's votes for and against, the shape."""
    kind, cast, bits = _told(codes)
    return np.concatenate([np.ones((len(kind), 1)), kind[:, None] == np.arange(len(KINDS)), cast == 1, cast == -1, bits], axis=1).astype(float)


def posterior(codes: np.ndarray, reliability: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The chance that patterns are personal data, labelers taken as independent."""
    kind, cast, _ = _told(codes)
    logs = np.stack([np.log(reliability[y][np.arange(len(LABELERS)), cast + 1]).sum(axis=1) for y in (0, 1)], axis=1)
    logs += np.log(np.stack([1 - share[kind], share[kind]], axis=1))
    return _sigmoid(logs[:, 1] - logs[:, 0])


def fit_reliability(codes: np.ndarray, counts: np.ndarray, rounds: int = 50, pseudo: float = 20.0) -> tuple[np.ndarray, np.ndarray]:
    """Reliabilities and shares that make the counted patterns likely. Pseudo-counts keep labelers better than chance where the corpus says little."""
    prior = np.array([[0.18, 0.80, 0.02], [0.02, 0.80, 0.18]])  # for other strings and for personal data: chances of -1, 0, 1; no vote says nothing yet
    own = np.where(np.arange(len(KINDS)) < N_BASE, 0.9, 0.4)
    reliability, share = np.repeat(prior[:, None, :], len(LABELERS), axis=1), own.copy()
    kind, cast, _ = _told(codes)
    for _ in range(rounds):
        p = posterior(codes, reliability, share)
        for y, w in enumerate((counts * (1 - p), counts * p)):
            for j in range(len(LABELERS)):
                seen = np.bincount(cast[:, j] + 1, weights=w, minlength=3) + pseudo * prior[y]
                reliability[y, j] = seen / seen.sum()
        share = (np.bincount(kind, weights=counts * p, minlength=len(KINDS)) + pseudo * own) / (np.bincount(kind, weights=counts, minlength=len(KINDS)) + pseudo)
    return reliability, share


def fit_classifier(codes: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression on patterns with soft labels, by Newton's method; a pattern weighs as the logarithm of its count, so that frequent ones don't drown rare ones."""
    x, w = features(codes), np.log1p(counts)
    weights = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = _sigmoid(x @ weights)
        slope = x.T @ (w * (labels - p)) - ridge * weights
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), slope)
        weights = weights + step
        if np.abs(step).max() < 1e-9:
            break
    return weights


def fit(found: DataFrame) -> Model:
    """From candidates of a corpus: its patterns with their counts are all that reaches the driver."""
    rows = found.select(F.explode("spans").alias("s")).groupBy("s.pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()
    codes, counts = np.array([r["pattern"] for r in rows], np.int64), np.array([r["n"] for r in rows], float)
    reliability, share = fit_reliability(codes, counts)
    return Model(reliability, share, fit_classifier(codes, counts, posterior(codes, reliability, share)))


def chosen(spans: list[dict], chance: list[float], least: float) -> list[dict]:
    """Base spans and, of the others from `least` on, the likelier first and of equals the earlier, those that overlap none chosen before."""
    base, taken, more = [s for s in spans if s["kind"] < N_BASE], [], []
    for _, _, s in sorted(((-p, i, s) for i, (s, p) in enumerate(zip(spans, chance, strict=True)) if s["kind"] >= N_BASE and p >= least), key=lambda x: x[:2]):
        at = bisect(taken, (s["start"], s["stop"]))
        if (not at or taken[at - 1][1] <= s["start"]) and (at == len(taken) or s["stop"] <= taken[at][0]):
            taken.insert(at, (s["start"], s["stop"]))
            more.append(s)
    return sorted(base + more, key=lambda s: (s["start"], s["kind"], s["stop"]))


def shown(spans: list[dict]) -> str:
    """kind:start:stop, comma-joined."""
    return ",".join(f"{KINDS[s['kind']]}:{s['start']}:{s['stop']}" for s in spans)


def decided(found: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (string), all (array of SPAN) of each row of candidates."""
    of = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.int32()), ("pattern", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            codes = spans.flatten().field("pattern").to_numpy()
            each, back = np.unique(codes, return_inverse=True)
            chance = model.probability(each)[back].tolist() if len(each) else []
            at, rows = 0, []
            for told in spans.to_pylist():
                kept = chosen(told, chance[at : at + len(told)], least)
                at += len(told)
                base = [s for s in kept if s["kind"] < N_BASE]
                rows.append((*(sum(s["kind"] == k for s in base) for k in range(N_BASE)), sha256(shown(base).encode()).hexdigest(), shown(kept), kept))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            types = (*[pa.int64()] * N_BASE, pa.string(), pa.string(), pa.list_(of))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", *(f"n_{k}" for k in KINDS[:N_BASE]), "base_sha256", "spans", "all"])

    counts = ", ".join(f"n_{k} long" for k in KINDS[:N_BASE])
    return found.mapInArrow(trimmed(run), f"doc_id long, {counts}, base_sha256 string, spans string, all array<{SPAN}>")


def scan(docs: DataFrame, least: float = LEAST, model: Model | None = None) -> DataFrame:
    """decided() for docs (doc_id, text), by a model of their own corpus, or by one from another."""
    found = cut(candidates(docs))
    return decided(found, model or fit(found), least)


def op13_personal_data(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("all")
