"""Personal data by weak supervision.

Base spans (e-mail addresses, IP addresses, card and telephone numbers) are found by exact patterns and checks, and
always stay. Other tokens that might be private (passwords and keys, social security and bank account numbers) are
candidates. Labelers (pattern, shape, gazetteer, context, counter-evidence) vote on every span; expectation-maximisation
on the counts of all vote patterns estimates each labeler's reliabilities and each pattern's probability; a logistic
span classifier is trained on votes and shapes with these as targets, and adds the candidates that it accepts.

A token of more than LONG characters (JSON without blanks, links, connection strings) is judged by its parts between
quotes, commas, ampersands, semicolons and question marks; a part that is still longer only as a key with its value or
by a known prefix.

Texts that are null count as empty. Rows repeat as given; extra columns stay out. Counts of patterns cover all texts.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ordograph.llm.common import written

KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "iban")
LABELERS = ("pattern", "shape", "gazetteer", "context", "counter")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match starts at a run's first digit, which the second look says without slowing the search for digits
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT, _BLANK = re.compile(r"[0-9]"), re.compile(r"[\x20\x09-\x0D]")
_SSN, _IBAN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}\Z"), re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\Z")
_KEYED = re.compile(r"([A-Za-z_-]{2,24})[=:](.{6,})\Z", re.S)
_CLOUD = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}\Z|gh[pousr]_[A-Za-z0-9]{20,}\Z|sk-[A-Za-z0-9]{20,}\Z")
LONG, _PART = 200, re.compile(r"[^\"',&;?]+")
_WORD_BEFORE = re.compile(r"[A-Za-z]+")

# Words that name or precede private data.
NAMES = frozenset("password passwd pwd pass secret token key apikey api_key access_key secret_key auth credential pin ssn iban account".split())
CUES = frozenset("password passwd pass secret token key login mail email contact call phone tel fax mobile card visa account iban ssn ip host server address write reach".split())
HOSTS = ("example.com", "example.org", "gmail.com", "mail.")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of the first four kinds, each from left to right."""
    emails, at, low = [], text.find("@"), 0
    while at >= 0:
        s = at
        while s > low and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at) if s < at else None
        if m:
            emails.append((s, m.end()))
            low = m.end()
        at = text.find("@", max(at + 1, low))
    ips = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m.group().split("."))]
    cards = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(d) <= 19 and luhn(d):
                cards.append(m.span())
    phones = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]
    return [emails, ips, cards, phones]


def _trimmed(text: str, s: int, e: int) -> tuple[int, int]:
    while s < e and text[s] in "([{\"'<":
        s += 1
    while e > s and text[e - 1] in ".,;:!?)]}\"'>":
        e -= 1
    return s, e


def candidates(text: str, taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Tokens with digits outside the spans taken that may hold something private: (kind, start, end)."""
    out, pos, n = [], 0, len(text)
    taken = sorted(taken)
    starts, reach = [a for a, _ in taken], list(itertools.accumulate((b for _, b in taken), max))

    def judge(s: int, e: int) -> None:
        before = bisect.bisect_left(starts, e)
        if e - s < 8 or (before and reach[before - 1] > s):
            return
        token = text[s:e]
        if _SSN.match(token):
            out.append(("ssn", s, e))
        elif _IBAN.match(token):
            out.append(("iban", s, e))
        elif _CLOUD.match(token) or _KEYED.match(token) or (12 <= e - s <= LONG and any(c.isalpha() for c in token)):
            out.append(("secret", s, e))

    while m := _DIGIT.search(text, pos):
        s = m.start()
        while s > pos and not _BLANK.match(text[s - 1]):
            s -= 1
        end = _BLANK.search(text, m.end())
        e = pos = end.start() if end else n
        s, e = _trimmed(text, s, e)
        if e - s <= LONG:
            judge(s, e)
            continue
        for part in _PART.finditer(text, s, e):
            if _DIGIT.search(part.group()):
                judge(*_trimmed(text, *part.span()))
    return out


def votes(text: str, kind: str, s: int, e: int) -> str:
    """A pattern: kind, each labeler's vote (+, - or 0), band of length and share of digits."""
    token = text[s:e]
    digits = sum(c.isdigit() for c in token)
    letters = sum(c.isalpha() for c in token)
    keyed = _KEYED.match(token)
    before = [w.lower() for w in _WORD_BEFORE.findall(text[max(0, s - 40) : s])[-3:]]
    told = bool(before) and before[-1] in NAMES  # password: ..., token = "..."
    pattern = "+" if kind != "secret" or _CLOUD.match(token) else "0" if keyed or told else "-"
    shape = "+" if digits >= 4 and len(set(token)) >= 5 else "-" if len(set(token)) < 4 else "0"
    named = told or (keyed and keyed.group(1).lower() in NAMES)
    gazetteer = "+" if named or (kind == "email" and any(h in token.lower() for h in HOSTS)) or token.startswith(("AKIA", "+1", "+4", "+3")) else "0"
    context = "+" if any(w in CUES for w in before) else "0"
    value = keyed.group(2) if keyed else token
    # prose with a number in it, links and dates speak against
    counter = "-" if kind == "secret" and (letters > 0.85 * len(token) or "://" in token or re.fullmatch(r"[0-9./:-]+", value)) else "0"
    return f"{kind}|{pattern}{shape}{gazetteer}{context}{counter}|{min(4, (e - s) // 8)}{min(4, 5 * digits // max(1, e - s))}"


#: Votes (against, none, for) that each labeler is taken to have cast before, on spans that aren't private and on
#: spans that are: it votes for rather than against what it was made for, whatever a small table holds.
PRIOR = np.array([[8.0, 11.0, 1.0], [1.0, 9.0, 10.0]])


def expectation_maximisation(counts: dict[str, int], rounds: int = 100) -> dict[str, float]:
    """Probability of each vote pattern, by a model with two classes and labelers independent given the class."""
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], dtype=float)
    v = np.array([["-0+".index(c) for c in k.split("|")[1]] for k in keys])
    p = np.array([0.9 if (x == 2).sum() > (x == 0).sum() else 0.1 if (x == 0).any() else 0.5 for x in v])
    for _ in range(rounds):
        prior = (n @ p + 1) / (n.sum() + 2)
        on, off = np.full(len(keys), math.log(prior)), np.full(len(keys), math.log(1 - prior))
        for j in range(len(LABELERS)):
            table = PRIOR.copy()
            np.add.at(table[1], v[:, j], n * p)
            np.add.at(table[0], v[:, j], n * (1 - p))
            table = np.log(table / table.sum(axis=1, keepdims=True))
            on, off = on + table[1][v[:, j]], off + table[0][v[:, j]]
        new = 1 / (1 + np.exp(np.clip(off - on, -35, 35)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return dict(zip(keys, p.tolist(), strict=True))


def _features(key: str) -> np.ndarray:
    kind, told, shape = key.split("|")
    x = [1.0] + [float(kind == k) for k in KINDS] + [float(c == s) for c in told for s in "+-"]
    return np.array(x + [float(shape[0] == str(i)) for i in range(5)] + [float(shape[1] == str(i)) for i in range(5)])


def span_classifier(counts: dict[str, int], target: dict[str, float]) -> dict[str, float]:
    """Score of each pattern by a logistic model fitted on all patterns, weighted by their counts."""
    if not counts:
        return {}
    keys = sorted(counts)
    x, n, t = np.stack([_features(k) for k in keys]), np.array([counts[k] for k in keys], dtype=float), np.array([target[k] for k in keys])
    n, w = n / n.sum(), np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x.T * (n * np.maximum(p * (1 - p), 1e-6))) @ x + 1e-3 * np.eye(len(w)), x.T @ (n * (p - t)) + 1e-3 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip(keys, (1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))).tolist(), strict=True))


FOUND = "doc_id long, spans array<struct<kind: string, s: int, e: int, pattern: string>>"


def _found(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in rows:
        out = []
        for text in pdf.text:
            text = text or ""
            base = base_spans(text)
            spans = [(k, s, e) for k, own in zip(KINDS, base, strict=False) for s, e in own]
            spans += candidates(text, [x[1:] for x in spans])
            out.append([{"kind": k, "s": s, "e": e, "pattern": votes(text, k, s, e)} for k, s, e in spans])
        yield pd.DataFrame({"doc_id": pdf.doc_id, "spans": out})


def private_spans(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, spans): for each row the spans {kind, s, e, score}, by kind as listed in KINDS, then start."""
    found = written(docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(_found, FOUND), "spans")
    # kinds, votes and bands bound the number of patterns
    counts = {r["pattern"]: r["n"] for r in found.select(F.explode("spans.pattern").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    scores = span_classifier(counts, expectation_maximisation(counts)) if counts else {}

    def judged(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            out = []
            for spans in pdf.spans:
                got = [(KINDS.index(x["kind"]), x["s"], x["e"], scores[x["pattern"]]) for x in spans]
                out.append([{"kind": KINDS[k], "s": s, "e": e, "score": p} for k, s, e, p in sorted(got) if k < 4 or p >= least])
            yield pd.DataFrame({"doc_id": pdf.doc_id, "spans": out})

    return found.mapInPandas(judged, "doc_id long, spans array<struct<kind: string, s: int, e: int, score: double>>")


def digest(spans: DataFrame) -> DataFrame:
    """Counts of the base kinds, of all spans and of those added, and the spans in writing."""
    text = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*KINDS[:4]))
    plain = F.array_join(F.transform(base, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    kinds = F.transform("spans", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    added = F.size(kinds) - F.size(F.filter(kinds, lambda k: k.isin(*KINDS[:4])))
    return spans.select("doc_id", *counts, F.sha2(plain, 256).alias("base_sha256"), text.alias("spans"), F.size(kinds).cast("long").alias("n_private"), added.cast("long").alias("n_added"))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
