"""Personal data in texts: four exact kinds, and secrets by weak supervision.

Every candidate token gets votes from regex, gazetteer and context labelers. Expectation
maximisation over the vote patterns of all documents estimates each labeler's reliability
and each pattern's posterior (two classes, labelers independent given the class,
abstentions uninformative). A logistic classifier over the votes and the shape of the span
is trained on those posteriors, and it alone decides which candidates become spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, map_rows

# The contract's patterns.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
#: Finds the same: where a run of digits fails from its start, it fails from within.
IP_ONCE = re.compile(r"(?<![0-9])" + IP.pattern)
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Gazetteers of the labelers.
SECRET_WORDS = ("password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "api_key", "api-key", "key", "credential", "bearer", "auth", "login", "pin", "iban", "ssn", "account")
HARMLESS_WORDS = ("version", "license", "licence", "licensed", "copyright", "http", "https", "www", "isbn", "doi", "page", "chapter", "figure", "table", "section")

#: Candidates without context: runs of at least 12 key characters.
TOKEN = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{12,}+")
#: Candidates by context, of any length: what follows a secret word within REACH characters, or an assignment to a name.
REACH = 40
SECRET = re.compile("|".join(sorted(map(re.escape, SECRET_WORDS), key=len, reverse=True)), re.I)
ASSIGNED = re.compile(r"""[A-Za-z_]["']?[\x20\t]?[=:][\x20\t]?["']?(?=[^\s"'=:])""")
#: A value: groups of capitals and digits set apart by single blanks, or a run without blanks and quotes.
VALUE = re.compile(r"""(?<![A-Z0-9])[A-Z0-9]{2,6}(?:\x20(?=[A-Z]{0,4}[0-9])[A-Z0-9]{1,6})+(?![A-Za-z0-9])|[^\s"'`<>=:;,()\[\]{}]+""")
HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
KEY = re.compile(r"[A-Z0-9]+")
LABELERS = ("hex", "key", "mixed", "word", "secret_word", "harmless_word", "assigned", "repeated")
SIZES = (16, 20, 24, 32, 40, 64)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def _octet(digits: str) -> bool:
    """At most 255, of any number of digits."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Base spans of a whole text in code points, by kind as listed and then by start."""
    out: list[tuple[str, int, int]] = []
    if not text:
        return out
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if not _DIGIT.search(text):
        return out
    if _DOTTED.search(text):
        out += [("ip", m.start(), m.end()) for m in IP_ONCE.finditer(text) if all(_octet(x) for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _digits(m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


_DIGIT = re.compile("[0-9]")
_DOTTED = re.compile(r"[0-9]\.[0-9]")


def votes(text: str, start: int, end: int) -> tuple[int, ...]:
    """Each labeler's vote on a candidate: 1 secret, 0 not, 2 abstains."""
    token = text[start:end].replace(" ", "")
    before = text[max(0, start - REACH) : start].lower()
    near = re.split(r"[^a-z_-]+", before)[-4:]
    digits = sum("0" <= c <= "9" for c in token)
    letters = sum(c.isalpha() for c in token)
    glued = before[-1:] in ('"', "'", "=", ":") or (before.endswith(" ") and before[-2:-1] in ("=", ":"))
    return (
        1 if digits and HEX.fullmatch(token) and len(token) >= 16 else 2,
        1 if digits and letters and KEY.fullmatch(token) else 2,
        1 if digits >= 2 and letters >= 2 else 0,
        0 if not digits and not token.isupper() else 2,
        1 if any(w in SECRET_WORDS for w in near) else 2,
        0 if any(w in HARMLESS_WORDS for w in near) or before.endswith(("/", ".", "@")) else 2,
        1 if glued else 0 if before[-1:] in ("", " ", "\n") and not digits else 2,
        0 if len(set(token)) * 3 <= len(token) else 2,
    )


def cell_of(text: str, start: int, end: int) -> int:
    """Votes, length class and digit share of a candidate as one number: what the
    classifier sees. There are at most 3^8 * 7 * 5 of them, whatever the input."""
    code = 0
    for v in votes(text, start, end):
        code = code * 3 + v
    size = sum(end - start > s for s in SIZES)
    share = 4 * sum("0" <= c <= "9" for c in text[start:end]) // (end - start)
    return (code * 7 + size) * 5 + share


def unpack(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    share, rest = cells % 5, cells // 5
    size, code = rest % 7, rest // 7
    return np.stack([code // 3 ** (len(LABELERS) - 1 - i) % 3 for i in range(len(LABELERS))], axis=1), size, share


def in_context(text: str) -> set[tuple[int, int]]:
    """(start, end) of the values near secret words and in assignments, whatever their length."""
    out, done = set(), 0

    def value(m) -> None:
        end = m.end()
        while end > m.start() and text[end - 1] in ".!?":
            end -= 1
        if any(c.isalnum() for c in text[m.start() : end]):
            out.add((m.start(), end))

    for word in SECRET.finditer(text):
        a, b = word.span()
        if text[a - 1 : a].isalpha() or text[b : b + 1].isalpha():
            continue
        at, done = max(b, done), max(done, b)
        while (m := VALUE.search(text, at)) and m.start() < b + REACH:
            if m.start() == b and text[b] in "_-":  # pin-4821
                at = b + 1
                continue
            value(m)
            at = done = m.end()
    for m in ASSIGNED.finditer(text):
        if m := VALUE.match(text, m.end()):
            value(m)
    return out


def candidates(text: str | None, base: list[tuple[str, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, cell) of every candidate that no base span touches: all values in
    context, and long tokens without one. There, tokens of lower-case letters alone can't
    be told from words and are no candidates."""
    if not text:
        return []
    near = sorted(in_context(text), key=lambda x: (x[0], -x[1]))
    spans, free = [], 0
    for a, b in near:
        if a >= free:
            spans.append((a, b))
            free = b
    i, found = 0, []
    for m in TOKEN.finditer(text):
        start, end = m.span()
        while i < len(spans) and spans[i][1] <= start:
            i += 1
        if (i == len(spans) or spans[i][0] >= end) and (not m[0].isalpha() or m[0].isupper()):
            found.append((start, end))
    taken: list[list[int]] = []  # base spans, merged where they overlap
    for _, x, y in sorted(base, key=lambda s: s[1]):
        if taken and x <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], y)
        else:
            taken.append([x, y])
    out, i = [], 0
    for a, b in sorted(spans + found):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if i == len(taken) or taken[i][0] >= b:
            out.append((a, b, cell_of(text, a, b)))
    return out


def fit_reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns (P x L, values 0, 1, 2) with counts. Returns each pattern's
    posterior of class 1 and the reliabilities P(vote 1 | class, voted), 2 x L."""
    voted, ones = patterns != 2, patterns == 1
    said = np.where(voted.sum(1) > 0, ones.sum(1) / np.maximum(voted.sum(1), 1), 0.5)
    post = np.clip(said, 0.05, 0.95)
    for _ in range(rounds):
        rates = []
        for weight in ((1 - post) * counts, post * counts):
            rates.append((weight @ ones + 1) / (weight @ voted + 2))
        rates = np.array(rates)
        prior = (post @ counts + 1) / (counts.sum() + 2)
        log = [np.log(p) + (ones * np.log(r) + (voted & ~ones) * np.log1p(-r)).sum(1) for p, r in ((1 - prior, rates[0]), (prior, rates[1]))]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    return post, rates


def _features(cells: np.ndarray) -> np.ndarray:
    vote, size, share = unpack(cells)
    return np.hstack([np.ones((len(cells), 1)), vote == 1, vote == 0, size[:, None] == np.arange(7), share[:, None] == np.arange(5)]).astype(float)


def fit_classifier(cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Weights of a logistic model trained on EM posteriors, by Newton's method with ridge
    1. All candidates count, as counts of cells."""
    if not len(cells):
        return np.zeros(_features(np.array([0])).shape[1])
    patterns, group = np.unique(unpack(cells)[0], axis=0, return_inverse=True)
    post, _ = fit_reliabilities(patterns, np.bincount(group.ravel(), counts))
    target, x = post[group.ravel()], _features(cells)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (counts * (target - p)) - w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def is_secret(cells: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return _features(cells) @ weights >= 0


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """Spans of personal data in every whole text of ``docs(doc_id, text)``, a row a row.

    Returns doc_id, counts of the base kinds, base_sha256 over the base spans, spans (base
    and added ones; kind ``secret`` is what the classifier adds), n_secret, and n_private,
    the number of all spans: 0 marks a document without personal data. Texts may be of any
    length and hold runs of digits of any length. A null or
    empty text has no spans. Repeated rows give repeated rows. An empty table gives an
    empty result. Other columns are ignored. The driver gets counts of cells, whose
    number has a fixed bound, never spans or texts.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                base = base_spans(text)
                found = candidates(text, base)
                n = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                said = _joined(base)
                out.append((doc, *n, hashlib.sha256(said.encode()).hexdigest(), said, [x[0] for x in found], [x[1] for x in found], [x[2] for x in found]))
            yield pd.DataFrame(out, columns=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "starts", "ends", "cells"])

    found = cut(
        map_rows(docs.select("doc_id", "text"), scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, starts array<int>, ends array<int>, cells array<int>"),
        "pii",
    )
    counts = found.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect()
    counts.sort(key=lambda r: r["cell"])
    cells = np.array([r["cell"] for r in counts], dtype=np.int64)
    weights = fit_classifier(cells, np.array([r["count"] for r in counts], dtype=float))
    chosen = [int(c) for c, yes in zip(cells, is_secret(cells, weights) if len(cells) else [], strict=True) if yes]
    taken = F.filter(F.arrays_zip("starts", "ends", "cells"), lambda x: F.array_contains(F.lit(chosen) if chosen else F.array().cast("array<int>"), x["cells"]))
    added = F.transform(taken, lambda x: F.concat(F.lit("secret:"), x["starts"].cast("string"), F.lit(":"), x["ends"].cast("string")))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256",
        F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), added).alias("spans"),
        F.size(taken).cast("long").alias("n_secret"),
        (F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone") + F.size(taken)).alias("n_private"),
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir))
