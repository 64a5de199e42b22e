"""MinHash near-duplicates with sequential Bayesian verification.

Texts with the same shingle set are one class. Classes whose MinHash bands collide are
candidates. Candidates' other signature bytes are compared a batch at a time; after each
batch the posterior of the similarity (uniform prior) says whether the threshold is still
credible, and a pair is pruned when it is less credible than the chosen miss probability.
Survivors are verified on their full shingle sets. Verified links are joined into
components by distributed union-find.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, documents, link_buckets, map_rows

BATCH, BATCHES = 32, 4
FNV = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit hash of a word (bytes), remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, width: int, words: Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a whole text, A-Z
    lower-cased. Fewer words are one shingle; no words give an empty set."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - width + 1)
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(min(len(h), width)))
        for k in range(min(width, len(h))):
            out = _mix((out ^ h[k : k + n]) * FNV)
    return np.unique(out)


@functools.cache
def _constants(k: int) -> tuple[np.ndarray, np.ndarray]:
    x = _mix(np.arange(1, 2 * k + 1, dtype=np.uint64) * FNV)
    return (x[:k] >> np.uint64(32)).astype(np.uint32), ((x[k:] >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)


def signature(shingles: np.ndarray, k: int) -> np.ndarray:
    """k MinHash values of a non-empty set."""
    salt, factor = _constants(k)
    x = (shingles >> np.uint64(16)).astype(np.uint32)
    with np.errstate(over="ignore"):
        if len(x) <= 4096:
            return (((x ^ salt[:, None]) * factor[:, None]) ^ (salt[:, None] >> np.uint32(3))).min(1)
        return np.min([signature(shingles[i : i + 4096], k) for i in range(0, len(x), 4096)], axis=0)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band; the band's number is part of it."""
    out = np.arange(1, bands + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rows):
            out = _mix((out ^ sig[r : bands * rows : rows].astype(np.uint64)) * FNV)
    return out.view(np.int64)


@functools.cache
def least_matches(threshold: float, miss: float) -> tuple[int, ...]:
    """After 1, 2, ... batches, the fewest matching signature bytes at which the posterior
    probability of a similarity of at least ``threshold`` is above ``miss``. A byte also
    matches by chance, once in 256; the prior is uniform."""
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / 256
    out = []
    for b in range(1, BATCHES + 1):
        n = b * BATCH
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            w = np.exp(log - log.max())
            if w[s >= threshold].sum() / w.sum() > miss:
                out.append(m)
                break
    return tuple(out)


def prune(a: list[bytes], b: list[bytes], threshold: float, miss: float) -> np.ndarray:
    """Which pairs of signatures are still credible after all batches; batch by batch."""
    x, y = (np.frombuffer(b"".join(v), np.uint8).reshape(-1, BATCH * BATCHES) for v in (a, b))
    live, hits = np.arange(len(x)), np.zeros(len(x), np.int64)
    for i, least in enumerate(least_matches(threshold, miss)):
        part = slice(i * BATCH, (i + 1) * BATCH)
        hits[live] += (x[live, part] == y[live, part]).sum(1)
        live = live[hits[live] >= least]
    keep = np.zeros(len(x), bool)
    keep[live] = True
    return keep


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, bands: int = 24, rows: int = 6, miss: float = 1e-6) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs(doc_id, text)``.

    Linked are documents with 100 * intersection >= ``percent`` * union of their sets of
    distinct ``width``-word shingles. A pair at the threshold is missed by banding with
    probability (1 - s^rows)^bands, 1.2e-5 as given, and by pruning with ``miss``.

    A null or empty text, or one without words, has an empty set and is linked with
    nothing, not even with another empty one. Repeated rows give repeated rows; equal sets
    are linked. A null doc_id comes back with a null component, kept. Ties: the smallest
    doc_id names a component. An empty table gives an empty result; other columns are
    ignored.
    """

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                s = shingle_set(text, width, words)
                if not len(s):
                    out.append((doc, 0, None, None, None, None))
                    continue
                sig = signature(s, bands * rows + BATCH * BATCHES)
                with np.errstate(over="ignore"):
                    one, two = int(np.bitwise_xor.reduce(_mix(s + FNV)).view(np.int64)), int(_mix(s ^ FNV).sum().view(np.int64))
                out.append((doc, len(s), one, two, band_keys(sig, bands, rows), sig[bands * rows :].astype(np.uint8).tobytes()))
            frame = pd.DataFrame(out, columns=["doc_id", "n", "one", "two", "keys", "sig"])
            one, two = (pd.array([r[i] for r in out], dtype="Int64") for i in (2, 3))  # a column of ints and None would be one of floats
            yield frame.assign(one=one, two=two)

    texts = docs.select("doc_id", "text")
    signed = cut(map_rows(texts, sign, "doc_id long, n long, one long, two long, keys array<long>, sig binary"), "signatures")
    classes = cut(
        signed.where("n > 0 and doc_id is not null").groupBy("one", "two").agg(F.min(F.struct("doc_id", "n", "keys", "sig")).alias("x")).select("one", "two", F.col("x.doc_id").alias("id"), "x.n", "x.keys", "x.sig"),
        "classes",
    )
    members = classes.select(F.explode("keys").alias("bucket"), "id")
    shared = members.groupBy("bucket").agg(F.count("*").alias("size"), F.min("id").alias("first")).where("size > 1")
    members = cut(members.join(shared, "bucket"), "members")
    ids = members.select("id").distinct()

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "set": [shingle_set(t, width, words).tobytes() for t in batch["text"]]})

    held = texts.withColumnRenamed("doc_id", "id").join(ids.hint("shuffle_hash"), "id", "left_semi").mapInPandas(sets, "id long, set binary")
    held = cut(held, "held")
    sigs = classes.select("id", "n", "sig").join(ids, "id", "left_semi")
    sigs = cut(sigs, "held-signatures")

    def bayes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = prune(list(batch["x"]), list(batch["y"]), percent / 100, miss) if len(batch) else np.zeros(0, bool)
            yield batch.loc[keep, ["a", "b"]]

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.loc[np.array(good, bool), ["a", "b"]]

    def verify(pairs: DataFrame) -> DataFrame:
        a, b = (sigs.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("sig").alias(v)) for k, v in (("a", "x"), ("b", "y")))
        credible = pairs.join(a, "a").join(b, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        credible = cut(credible.select("a", "b", "x", "y").mapInPandas(bayes, "a long, b long"), "credible")
        a, b = (held.select(F.col("id").alias(k), F.col("set").alias(v)) for k, v in (("a", "x"), ("b", "y")))
        return credible.join(b, "b").join(a, "a").select("a", "b", "x", "y").mapInPandas(exact, "a long, b long")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links of a block of outliers to a block of members."""
        a, b = pdf[pdf["side"] == 0].reset_index(drop=True), pdf[pdf["side"] == 1].reset_index(drop=True)
        if a.empty or b.empty:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        least = least_matches(percent / 100, miss)[-1]
        sig_b = np.frombuffer(b"".join(b["sig"]), np.uint8).reshape(len(b), -1)
        sets_b = [np.frombuffer(x, np.uint64) for x in b["set"]]
        size = np.array([len(x) for x in sets_b])
        flat = np.concatenate(sets_b)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], np.repeat(np.arange(len(b)), size)[order]
        label_b, id_b, out_b = b["label"].to_numpy(), b["id"].to_numpy(), b["outlier"].to_numpy(bool)
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        out = []
        for row in a.itertuples(index=False):
            ok = (label_b != row.label) & ~(out_b & ((j < i) | ((i == j) & (id_b < row.id))))  # two outliers meet once
            ok &= (sig_b == np.frombuffer(row.sig, np.uint8)).sum(1) >= least
            if ok.any():
                x = np.frombuffer(row.set, np.uint64)
                lo, hi = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
                n = hi - lo
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(b))
                out += [(row.id, k) for k in id_b[ok & (100 * both >= percent * (len(x) + size - both))].tolist()]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    def settle(open_: DataFrame) -> DataFrame:
        """All links between different labels among the members of open buckets. Buckets
        that share members are pooled; in a pool, what is not of its commonest label meets
        everything, a block of about 512 against a block."""
        pools = components(open_.select(F.col("first").alias("a"), F.col("id").alias("b")))
        m = cut(open_.select("id", "label").distinct().join(pools.withColumnRenamed("component", "pool"), "id"), "pools")
        counts = m.groupBy("pool", "label").agg(F.count("*").alias("n")).groupBy("pool").agg(F.sum("n").alias("n"), F.max_by("label", F.struct("n", "label")).alias("main"))
        wide = m.join(counts, "pool").select("pool", "id", "label", (F.col("label") != F.col("main")).alias("outlier"), F.ceil(F.col("n") / 512).alias("blocks"))
        wide = wide.withColumn("k", F.pmod(F.xxhash64("id"), F.col("blocks"))).join(held, "id").join(sigs.select("id", "sig"), "id")
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        left = wide.where("outlier").select("pool", F.col("k").alias("i"), other.alias("j"), F.lit(0).alias("side"), "id", "label", "outlier", "set", "sig")
        right = wide.select("pool", other.alias("i"), F.col("k").alias("j"), F.lit(1).alias("side"), "id", "label", "outlier", "set", "sig")
        return left.unionByName(right).groupBy("pool", "i", "j").applyInPandas(compare, "a long, b long")

    labels = link_buckets(members, verify, settle=settle)
    named = classes.select("one", "two", "id")
    named = named.withColumn("component", F.col("id")) if labels is None else named.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return signed.select("doc_id", "n", "one", "two").join(named.select("one", "two", "component"), ["one", "two"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 32, rows: int = 5) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one with the
    smallest doc_id; columns as given."""
    kept = near_duplicates(docs, width, percent, bands, rows).where("kept").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
