"""Toxicity of texts that hide their words: a noisy channel restores, a classifier scores.

Channel: what is written stands for letters in one of three ways. A digit or sign looks
like a letter, letters are set apart by blanks or signs, and a letter is repeated. Each
suspect stretch becomes a lattice of what it may stand for; Viterbi decoding under a
character trigram model of the whole corpus picks one reading. The restored text is then
scored by a logistic model over words and word beginnings, trained on labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, map_rows

SYMBOLS = 64  # 0 is what is no letter, 1-26 are a-z, the rest are shared by other letters

# Which letters a sign looks like.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l",
}
DELETE, SUBSTITUTE, SHORTEN, HALVE = 1.0, 0.7, 0.5, 1.5

_SIGNS = re.escape("".join(LOOKS_LIKE))
#: Signs that are no digits; without one of them or a letter, a stretch is a number.
WORDY = "@$!|+€£"
#: Suspect: a sign beside a letter on either side, a sign beside one that is no digit, a letter twice, separators beside a letter.
HIDDEN = re.compile(rf"[^\W\d_][{_SIGNS}*]|[{_SIGNS}][^\W\d_]|[{_SIGNS}][{re.escape(WORDY)}]|[{re.escape(WORDY)}][{_SIGNS}]|([^\W\d_])\1|[^\W\d_][.*_-]+[^\W_]|\d[.*_-]+[^\W\d_]")
SPACED = re.compile(rf"(?<![^\s\"'(])(?:[^\W_]|[{_SIGNS}])(?:[ .*_-]{{1,2}}(?:[^\W_]|[{_SIGNS}]))+(?=[\s.,!?;:\"')]|$)")
WORD = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"\S+")


def symbol(c: str) -> int:
    o = ord(c)
    if 97 <= o <= 122:
        return o - 96
    return 27 + o % (SYMBOLS - 27) if c.isalpha() else 0


_TABLE = np.array([symbol(chr(o).lower()[:1]) for o in range(0x3000)], dtype=np.int64)


def trigram_counts(text: str) -> np.ndarray:
    """Counts of symbol trigrams, as a flat array of SYMBOLS ** 3; two boundaries before."""
    o = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.where(o < len(_TABLE), _TABLE[np.minimum(o, len(_TABLE) - 1)], 27 + o.astype(np.int64) % (SYMBOLS - 27))
    s = np.concatenate([[0, 0], s, [0]])
    return np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)


def language_model(docs: DataFrame) -> np.ndarray:
    """Log-probabilities of the third symbol given two, from every whole text of the
    corpus; interpolated with shorter contexts. The driver gets at most SYMBOLS ** 3 sums."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for batch in batches:
            held, size = [], 0
            for text in batch["text"]:
                if text:
                    held.append(text)
                    size += len(text)
                    if size > 1 << 20:
                        total += trigram_counts("\n\n".join(held))
                        held, size = [], 0
            if held:
                total += trigram_counts("\n\n".join(held))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "n": total[at]})

    rows = docs.select("text").mapInPandas(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    n3 = np.zeros(SYMBOLS**3)
    for row in rows:
        n3[row["at"]] = row["n"]
    n3 = n3.reshape((SYMBOLS,) * 3)
    n2 = n3.sum(0)
    p1 = (n2.sum(0) + 1) / (n2.sum() + SYMBOLS)
    p2 = (n2 + 20 * p1) / (n2.sum(1, keepdims=True) + 20)
    return np.log((n3 + 20 * p2) / (n3.sum(2, keepdims=True) + 20)).astype(np.float32)


def decode(seen: str, model: np.ndarray) -> str:
    """The likeliest letters behind a written stretch (lower case, no outer punctuation)."""
    runs: list[tuple[str, int]] = []
    for c in seen:
        if runs and runs[-1][0] == c:
            runs[-1] = (c, runs[-1][1] + 1)
        else:
            runs.append((c, 1))
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for c, n in runs:
        if c in LOOKS_LIKE:
            ways = [(x * k, SUBSTITUTE * (1 + (k < n) * SHORTEN)) for x in LOOKS_LIKE[c] for k in {1, min(n, 2)}]
            ways += [("", DELETE * 3)]
        elif c.isalpha():
            ways = [(c * min(n, 2), SHORTEN if n > 2 else 0.0)] + ([(c, SHORTEN if n > 2 else HALVE)] if n > 1 else [])
        else:
            ways = [("", DELETE if c not in " .*_-" else 0.0), (" ", 0.0)]  # the stretch may be several words
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in states.items():
            for letters, cost in ways:
                x, y, total, to = a, b, score - cost, path
                for letter in letters:
                    z = symbol(letter)
                    total += float(model[x, y, z])
                    x, y, to = y, z, (letter, to)
                if (x, y) not in new or new[x, y][0] < total:
                    new[x, y] = (total, to)
        states = new
    _, path = max((score + float(model[a, b, 0]), path or ()) for (a, b), (score, path) in sorted(states.items()))
    out = []
    while path:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out))


REPEATED = re.compile(r"([^\W\d_])\1+")


def decode_letters(seen: str, model: np.ndarray) -> str:
    """``decode`` for letters alone. There a repeated letter is the only choice, and one or
    two of it change no trigram but those that end in it or right after it, so that each
    choice is made by itself."""
    out, at = [], 0
    for m in REPEATED.finditer(seen):
        start, stop = m.span()
        c = symbol(m[1])
        before = symbol(seen[start - 1]) if start else 0
        after = symbol(seen[stop]) if stop < len(seen) else 0
        two = model[before, c, c] + model[c, c, after] - (SHORTEN if stop - start > 2 else 0.0)
        one = model[before, c, after] - (SHORTEN if stop - start > 2 else HALVE)
        out += [seen[at:start], m[1] * (2 if two >= one else 1)]
        at = stop
    return "".join(out) + seen[at:]


def decoded(seen: str, model: np.ndarray) -> str:
    """``decode``; what has no letter and no sign beside digits stays a number."""
    if seen.isalpha():
        return decode_letters(seen, model)
    return decode(seen, model) if any(c.isalpha() or c in WORDY for c in seen) else seen


def restore_token(token: str, model: np.ndarray) -> str:
    """A lower-case token without white space, decoded between its outer punctuation if it
    is suspect."""
    if not HIDDEN.search(token):
        return token
    start, stop = 0, len(token)
    while start < stop and not (token[start].isalpha() or token[start] in LOOKS_LIKE):
        start += 1
    while stop > start and not (token[stop - 1].isalpha() or token[stop - 1] in LOOKS_LIKE and token[stop - 1] != "!"):
        stop -= 1
    return token[:start] + decoded(token[start:stop], model) + token[stop:]


def joined(text: str, model: np.ndarray) -> str:
    """Lower-cased text with letters set apart by blanks or signs decoded together."""
    return SPACED.sub(lambda m: decoded(m[0], model), text.lower())


def restore(text: str, model: np.ndarray) -> str:
    """Lower-cased text with each suspect stretch replaced by what it stands for."""
    return TOKEN.sub(lambda m: restore_token(m[0], model), joined(text, model))


class Features(dict):
    """Token -> what it adds to a text's features: the words of the restored token and
    their beginnings of 4, 5 and 6 letters, as numbers of ``known`` where that is given.
    Tokens come again and again and are remembered, but for long ones."""

    def __init__(self, model: np.ndarray, known: dict[str, int] | None = None):
        self.model, self.known = model, known

    def __missing__(self, token: str) -> tuple:
        restored, known, out = restore_token(token, self.model), self.known, []
        for word in (restored,) if restored.isalpha() else WORD.findall(restored):
            for f in (word, *(word[:k] + "*" for k in (4, 5, 6) if len(word) > k)):
                if known is None:
                    out.append(f)
                elif f in known:
                    out.append(known[f])
        if len(token) <= 64:
            if len(self) >= 200_000:
                self.clear()
            self[token] = tuple(out)
        return tuple(out)

    def of(self, text: str | None) -> set:
        """Features of a whole text."""
        out: set = set()
        for token in set(joined(text, self.model).split()) if text else ():
            if found := self[token]:
                out.update(found)
        return out


def choose(pos: Counter, neg: Counter, n_pos: int, n_neg: int, most: int) -> list[str]:
    """The features that tell most, by the z-score of their log odds; at least 3 rows."""
    scored = []
    for f in pos.keys() | neg.keys():
        p, q = pos[f], neg[f]
        if p + q >= 3:
            odds = math.log((p + 0.5) / (n_pos - p + 0.5)) - math.log((q + 0.5) / (n_neg - q + 0.5))
            z = odds / math.sqrt(1 / (p + 0.5) + 1 / (q + 0.5))
            if z > 2:
                scored.append((-z, f))
    return [f for _, f in sorted(scored)[:most]]


def fit(rows: list[tuple[list[int], int]], size: int, ridge: float = 1.0, rounds: int = 300) -> np.ndarray:
    """Logistic regression over sparse binary rows, by accelerated gradient; the last
    weight is the bias."""
    w = np.zeros(size + 1)
    if not rows:
        return w
    lengths = np.array([len(f) + 1 for f, _ in rows])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    cols = np.concatenate([[*f, size] for f, _ in rows]).astype(np.int64)
    y = np.array([label for _, label in rows], dtype=float)
    owner, v, step = np.repeat(np.arange(len(rows)), lengths), w.copy(), 4.0 / (len(rows) * 8.0)
    hard = np.full(size + 1, ridge)
    hard[size] = 1e-3
    curve = np.bincount(cols, minlength=size + 1) / 4 + hard
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(v[cols], starts), -40, 40)))
        grad = np.bincount(cols, (p - y)[owner], size + 1) + hard * v
        new = v - grad / np.maximum(curve, 1 / step / 1e6) / 4
        v, w = new + (t - 1) / (t + 2) * (new - w), new
    return w


def toxicity(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, most_features: int = 4_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs(doc_id, text)``.

    Trained on rows of ``labels(doc_id, toxic)`` whose crc32(doc_id as text) mod 5 is not
    0; where there are more than about ``most_rows`` of them, a sample by hash of doc_id
    is used. A doc_id with several labels has the largest. The character model is counted
    over all texts. A null or empty text gets the score of a text without words, the
    model's bias. A null doc_id is never held out and never trains. Repeated rows give
    repeated rows; an empty table gives an empty result; without labels every score is
    0.5 less the ridge's pull, that is 0.5. Other columns are ignored.
    """
    fold = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 5
    model = language_model(docs)
    known = labels.where("doc_id is not null and toxic is not null").where(fold("doc_id") != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > most_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * most_rows / n))
    sample = cut(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"), "toxic-sample")  # known has about most_rows rows at most

    def count(batches):
        pos, neg, n_pos, n_neg, features = Counter(), Counter(), 0, 0, Features(model)
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                (pos if toxic else neg).update(features.of(text))
                n_pos, n_neg = n_pos + bool(toxic), n_neg + (not toxic)
        rows = [(f, pos[f], neg[f]) for f in pos]
        yield pd.DataFrame([*rows, ("", n_pos, n_neg)], columns=["f", "pos", "neg"])
        rest = [f for f in neg if f not in pos]
        for i in range(0, len(rest), 100_000):
            yield pd.DataFrame([(f, 0, neg[f]) for f in rest[i : i + 100_000]], columns=["f", "pos", "neg"])

    sums = sample.mapInPandas(count, "f string, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    sums = sums.where("f = '' or pos >= 3").collect()  # at most what most_rows texts have
    whole = next(((r["pos"], r["neg"]) for r in sums if r["f"] == ""), (0, 0))
    chosen = choose(Counter({r["f"]: r["pos"] for r in sums if r["f"]}), Counter({r["f"]: r["neg"] for r in sums if r["f"]}), *whole, most_features)
    at = {f: i for i, f in enumerate(chosen)}

    def rows_of(batches):
        features = Features(model, at)
        for batch in batches:
            found = [sorted(features.of(text)) for text in batch["text"]]
            yield pd.DataFrame({"f": found, "toxic": batch["toxic"].astype(int)})

    train = sample.mapInPandas(rows_of, "f array<int>, toxic int").collect()
    weights = fit(sorted((list(r["f"]), int(r["toxic"] > 0)) for r in train), len(at))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features(model, at)
        for batch in batches:
            s = [sum(weights[i] for i in sorted(features.of(text))) for text in batch["text"]]
            p = 1 / (1 + np.exp(-np.clip(np.array(s, dtype=float) + weights[-1], -40, 40)))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": p})

    return map_rows(docs.select("doc_id", "text"), score, "doc_id long, score double").select(
        "doc_id",
        F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
