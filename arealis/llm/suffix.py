"""Exact repeated substrings by shard-wise suffix arrays.

Which bytes are covered by a string of MATCH bytes that also starts earlier, anywhere in
the corpus? Every such string holds an anchor: a GRAM-byte string whose hash is the least
among all in the MATCH bytes. Anchors depend on the bytes alone, so both occurrences of a
repeated string have the same one. Anchors that occur twice or more pull the text around
them into shards, equal anchors into one shard, and a suffix array over each shard finds
the repeated strings. The array is induced: suffixes are classified, the leftmost-smaller
(LMS) substrings are sorted by one induction and named, the reduced string of names is
sorted by rank doubling, and a second induction sorts all suffixes. Permuted common
prefixes (in text order, each at least its predecessor less one) then tell which
neighbours in the array share MATCH bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, free, map_rows

MATCH, GRAM = 100, 24
SPAN = MATCH - GRAM + 1  # grams in a string of MATCH bytes
BLOCK = 256
SHARD_BYTES = 1 << 20
STEP = 32  # every STEP-th common prefix is measured; the others follow where it is long


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS = _mix(np.arange(300, 320, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def window_hashes(x: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of the ``size`` bytes from each position, by doubling."""
    h, have, out, done, level = _BYTE[x], 1, None, 0, 0
    with np.errstate(over="ignore"):
        while True:
            if size & have:
                if out is None:
                    out, done = h, have
                else:
                    n = len(x) - done - have + 1
                    out, done = out[:n] * _FACTORS[10 + level] + h[done : done + n], done + have
            if have * 2 > size:
                return _mix(out[: len(x) - size + 1])
            n = len(h) - have
            h = h[:n] * _FACTORS[level] + h[have : have + n]
            have, level = have * 2, level + 1


def _sliding(x: np.ndarray, size: int, f) -> np.ndarray:
    have = 1
    while have * 2 <= size:
        x = f(x[:-have], x[have:])
        have *= 2
    return f(x[: len(x) - (size - have)], x[size - have :]) if have < size else x


def anchors(x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of anchors in documents that lie one after another in ``x`` and
    end at ``ends``. Each string of MATCH bytes within a document holds one at least, and
    which one depends on its bytes alone: all grams that attain the least hash count."""
    if len(x) < MATCH:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = window_hashes(x, GRAM)
    order = (h >> np.uint64(32)).astype(np.uint32)
    least = _sliding(order, SPAN, np.minimum)
    starts = np.concatenate([[0], ends[:-1]])
    change = np.zeros(len(least) + 1, np.int32)  # where strings would cross a document's end
    lo = np.minimum(np.maximum(ends - MATCH + 1, starts), len(least))
    np.add.at(change, lo, 1)
    np.add.at(change, np.minimum(ends, len(least)), -1)
    least[np.cumsum(change[:-1]) > 0] = 0
    padded = np.zeros(len(least) + 2 * (SPAN - 1), np.uint32)
    padded[SPAN - 1 : SPAN - 1 + len(least)] = least
    most = _sliding(padded, SPAN, np.maximum)
    at = np.flatnonzero((most == order) & (most > 0))
    return at, h[at]


def _place(sa: np.ndarray, heads: np.ndarray, chars: np.ndarray, items: np.ndarray, step: int) -> None:
    """Append items to their characters' buckets, in order; step -1 fills from the end."""
    order = np.argsort(chars, kind="stable")
    c = chars[order]
    count = np.bincount(c, minlength=len(heads))
    within = np.arange(len(c)) - (np.cumsum(count) - count)[c]
    sa[heads[c] + step * within] = items[order]
    heads += step * count


def induce(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, n_chars: int) -> np.ndarray:
    """The order of all suffixes that follows from the order of the LMS suffixes ``lms``.

    Buckets are scanned as in the sequential algorithm, but a bucket at a time: what a
    bucket's suffixes induce in the bucket itself (runs of a character) is taken in waves,
    which is the order that a scan would find it in."""
    n = len(t)
    sizes = np.bincount(t, minlength=n_chars)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    sa = np.full(n, -1, dtype=np.int32)
    lms_sizes = np.bincount(t[lms], minlength=n_chars)
    lms_of = lms[np.argsort(t[lms], kind="stable")]
    lms_ends = np.cumsum(lms_sizes)
    heads = starts.copy()
    for c in range(n_chars):
        if not sizes[c]:
            continue
        wave = sa[starts[c] : heads[c]]
        done = heads[c]
        while len(wave):
            p = wave[wave > 0] - 1
            p = p[t[p] == c]
            sa[done : done + len(p)] = p
            wave = sa[done : done + len(p)]
            done += len(p)
        heads[c] = done
        both = np.concatenate([sa[starts[c] : done], lms_of[lms_ends[c] - lms_sizes[c] : lms_ends[c]]])
        p = both[both > 0] - 1
        ch = t[p]
        up = ch > c
        if up.any():
            _place(sa, heads, ch[up], p[up], 1)
    l_ends = heads.copy()
    tails = ends - 1
    sa[0] = n - 1
    tails[t[n - 1]] -= 1
    for c in range(n_chars - 1, -1, -1):
        if not sizes[c]:
            continue
        wave = sa[tails[c] + 1 : ends[c]][::-1]
        done = tails[c]
        while len(wave):
            p = wave[wave > 0] - 1
            p = p[(t[p] == c) & is_s[p]]
            sa[done - len(p) + 1 : done + 1] = p[::-1]
            wave = p
            done -= len(p)
        tails[c] = done
        both = np.concatenate([sa[done + 1 : ends[c]][::-1], sa[starts[c] : l_ends[c]][::-1]])
        p = both[both > 0] - 1
        ch = t[p]
        down = ch < c
        if down.any():
            _place(sa, tails, ch[down], p[down], -1)
    return sa


def rank_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names, by rank doubling over what isn't unique yet."""
    n = len(names)
    counts = np.bincount(names)
    rank = (np.cumsum(counts) - counts)[names].astype(np.int64)
    open_ = np.flatnonzero(counts[names] > 1)
    h = 1
    while len(open_):
        far = open_ + h
        second = np.where(far < n, rank[np.minimum(far, n - 1)] + 1, 0)
        key = (rank[open_] << 32) | second
        order = np.argsort(key)
        key, who = key[order], open_[order]
        old = key >> 32
        at = np.arange(len(key))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        fresh = np.ones(len(key), bool)
        fresh[1:] = old[1:] != old[:-1]
        first = np.maximum.accumulate(np.where(new, at, 0))
        rank[who] = old + first - np.maximum.accumulate(np.where(fresh, at, 0))
        alone = new.copy()
        alone[:-1] &= new[1:]
        open_ = np.sort(who[~alone])
        h *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def suffix_array(t: np.ndarray, n_chars: int) -> np.ndarray:
    """Suffix array of ``t`` (integers below ``n_chars``), whose last character is 0 and
    occurs nowhere else."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int32)
    at = np.flatnonzero(t[:-1] != t[1:])
    is_s = np.ones(n, bool)
    is_s[:-1] = np.repeat(t[at] < t[at + 1], np.diff(np.concatenate([[-1], at])))
    lms = (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(np.int32)
    sa = induce(t, is_s, lms, n_chars)
    if len(lms) > 1:
        number = np.full(n, -1, np.int32)
        number[lms] = np.arange(len(lms))
        sorted_ = number[sa]
        sorted_ = sorted_[sorted_ >= 0]
        length = np.append(np.diff(lms) + 1, 1)
        a, b = sorted_[:-1], sorted_[1:]
        same = np.zeros(len(a), bool)
        live, k = np.flatnonzero(length[a] == length[b]), 0
        while len(live):
            live = live[t[lms[a[live]] + k] == t[lms[b[live]] + k]]
            k += 1
            over = length[a[live]] <= k
            same[live[over]] = True
            live = live[~over]
        names = np.empty(len(lms), np.int64)
        names[sorted_] = np.concatenate([[0], np.cumsum(~same)])
        order = sorted_ if names[sorted_[-1]] == len(lms) - 1 else rank_names(names)
        sa = induce(t, is_s, lms[order], n_chars)
    return sa


def long_prefixes(x: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position of ``x`` (bytes, MATCH + STEP bytes of filling after the end that
    the array covers), whether its suffix shares MATCH symbols with the one before it in
    the array: from permuted common prefixes, measured at every STEP-th position."""
    n = len(sa)
    words = np.lib.stride_tricks.as_strided(x[:8].view(np.uint64), (len(x) - 7,), (1,))
    before = np.empty(n, np.int32)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1

    def shared(i: np.ndarray, most: int) -> np.ndarray:
        """Shared bytes, as far as whole words of 8 and at most about ``most``."""
        j = before[i]
        out = np.zeros(len(i), np.int32)
        live = np.flatnonzero(j >= 0)
        for k in range(0, most, 8):
            at = min(k, most - 8)
            a, b = i[live] + at, j[live] + at
            fits = np.maximum(a, b) < len(words)
            same = fits & (words[np.where(fits, a, 0)] == words[np.where(fits, b, 0)])
            live = live[same]
            out[live] = at + 8
            if not len(live):
                break
        return out

    known = np.zeros(n + STEP, bool)
    at = np.arange(0, n, STEP, dtype=np.int32)
    got = shared(at, MATCH + STEP)
    for d in range(STEP):
        known[at[got - d >= MATCH] + d] = True
    known = known[:n]
    rest = np.flatnonzero(~known).astype(np.int32)
    known[rest] = shared(rest, MATCH) >= MATCH
    return known


def repeated_starts(parts: list[bytes], docs: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """For each part (bytes of document ``docs[i]`` from ``starts[i]`` on) the offsets of
    strings of MATCH bytes that also start earlier in some part."""
    sizes = np.array([len(p) for p in parts])
    raw = np.frombuffer(b"\0".join([*parts, b""]), np.uint8)
    n = len(raw)
    t = np.empty(n + 1, np.int16)
    t[:n] = raw
    t[:n] += 2
    first = np.cumsum(sizes + 1) - sizes - 1
    t[first + sizes] = 1
    t[n] = 0
    sa = suffix_array(t, 258)
    # 8-bit symbols suffice to compare: a string that may be removed holds no separator.
    same = long_prefixes(np.concatenate([raw, np.zeros(1, np.uint8)]), sa)
    doc_rank = np.unique(docs, return_inverse=True)[1].ravel()
    place = np.repeat((doc_rank.astype(np.int64) << 40) + starts - first, sizes + 1) + np.arange(n)
    whole = np.repeat((first + sizes).astype(np.int32), sizes + 1) - np.arange(n, dtype=np.int32) >= MATCH
    place[~whole] = np.iinfo(np.int64).max
    sa = sa[sa < n]
    begins = np.flatnonzero(~same[sa])
    if not len(begins) or begins[0] != 0:
        begins = np.concatenate([[0], begins])
    earliest = np.minimum.reduceat(place[sa], begins)
    earliest = np.repeat(earliest, np.diff(np.append(begins, len(sa))))
    gone = np.zeros(n, bool)
    gone[sa] = place[sa] > earliest
    gone &= whole
    return [np.flatnonzero(gone[a : a + s]) for a, s in zip(first.tolist(), sizes.tolist(), strict=True)]


def runs(starts: np.ndarray, size: int = MATCH) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by strings of ``size`` bytes at the sorted starts."""
    if not len(starts):
        return starts, starts
    new = np.concatenate([[True], starts[1:] > starts[:-1] + size])
    return starts[new], np.append(starts[:-1][new[1:]], starts[-1]) + size


def parts_frame(out: list[tuple]) -> pd.DataFrame:
    """Rows (key, more, doc_id, start, stop, bytes) as a frame. Whole numbers beside None
    never pass through floats, which keep 53 bits of a hash."""
    f = pd.DataFrame(out, columns=["key", "more", "doc_id", "start", "stop", "bytes"], dtype=object)
    whole = {c: pd.array(f[c].tolist(), dtype="Int64") for c in ("key", "more", "doc_id", "start", "stop")}
    return f.assign(**whole)


def remove_repeats(docs: DataFrame, hot: int = 20_000) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of
    ``docs(doc_id, text)``: what is left without the bytes that a string of MATCH bytes
    covers which also starts earlier, by doc_id and then by place.

    A null or empty text has no bytes. Later copies of a whole text, ties included, lose
    everything if they have MATCH bytes. Repeated rows (one doc_id) count as one document
    and give repeated rows. A null doc_id comes last and is given nothing to remove. An
    empty table gives an empty result; other columns are ignored.

    A shard takes whole groups of anchors, of at most ``hot`` occurrences each, and of
    equal parts in a group the first alone, so its memory is bounded. An anchor that occurs more often is settled string by string: hashes
    (128 bits) of the SPAN strings around each of its places are grouped, each once a
    document, which combines before the shuffle and needs no group in one task.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    listed = texts.select("doc_id", F.octet_length("raw").cast("long").alias("n"), F.md5("raw").alias("digest")).where("doc_id is not null")
    firsts = listed.groupBy("digest").agg(F.min("doc_id").alias("first"))
    copies = cut(listed.join(firsts, "digest").where("doc_id <> first and n >= 100").select("doc_id").distinct(), "copies")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(held):
            x = np.frombuffer(b"".join(r for _, r in held), np.uint8)
            ends = np.cumsum([len(r) for _, r in held])
            at, h = anchors(x, ends)
            who = np.searchsorted(ends, at, side="right")
            ids = np.array([d for d, _ in held])
            begin = ends - np.array([len(r) for _, r in held])
            return pd.DataFrame({"gram": h.view(np.int64), "doc_id": ids[who], "pos": (at - begin[who]).astype(np.int32)})

        held, size = [], 0
        for batch in batches:
            for doc, raw in zip(batch["doc_id"], batch["raw"], strict=True):
                if len(raw) >= MATCH:
                    held.append((int(doc), raw))
                    size += len(raw)
                    if size > 1 << 18:
                        yield flush(held)
                        held, size = [], 0
        if held:
            yield flush(held)

    known = texts.where("doc_id is not null")
    found = known.mapInPandas(find, "gram long, doc_id long, pos int")
    groups = found.groupBy("gram").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc0"), F.min("pos").alias("pos0")).where("n > 1")
    key = F.when(F.col("n") > hot, F.lit(None).cast("long")).otherwise(F.xxhash64("doc0", F.expr(f"pos0 div {BLOCK}")))
    groups = cut(groups.select("gram", key.alias("key")), "anchor-groups")
    free(docs.sparkSession)
    places = cut(found.join(groups, "gram").select("doc_id", "pos", "key"), "anchor-places")
    free(docs.sparkSession)

    def squeeze(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "packed": [z.compress(r) for r in batch["raw"]]})

    # Rows are compressed one by one before they are shuffled: Spark's own blocks compress less.
    packed = map_rows(texts, squeeze, "doc_id long, packed binary")

    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of a part: its shard's key, or for a hot anchor a string's hash."""
        import zstandard
        import xxhash

        z = zstandard.ZstdDecompressor()
        for batch in batches:
            out, size = [], 0
            for doc, blob, where, keys, is_hot in zip(batch["doc_id"], batch["packed"], batch["pos"], batch["key"], batch["hot"], strict=True):
                raw = z.decompress(blob)
                pos, ks, cold = np.array(where, dtype=np.int64), np.array(keys, dtype=np.int64), ~np.array(is_hot, dtype=bool)
                hot_pos, p, k = pos[~cold], pos[cold], ks[cold]
                order = np.lexsort((p, k))
                p, k = p[order], k[order]
                lo, hi = np.maximum(p - SPAN + 1, 0), np.minimum(p + MATCH, len(raw))
                if len(p):
                    new = np.concatenate([[True], (k[1:] != k[:-1]) | (lo[1:] > hi[:-1] - MATCH + 1)])
                    a = np.flatnonzero(new)
                    for i, j in zip(a.tolist(), np.append(a[1:], len(p)).tolist(), strict=True):
                        b, e = int(lo[i]), int(hi[j - 1])
                        if e - b >= MATCH:
                            out.append((int(k[i]), None, int(doc), b, None, raw[b:e]))
                            size += e - b
                if len(hot_pos):
                    windows = np.unique(np.concatenate([np.arange(max(0, q - SPAN + 1), min(q, len(raw) - MATCH) + 1) for q in hot_pos.tolist()]))
                    seen, again = set(), []
                    for s in windows.tolist():  # ascending: a string that the document has had needs no other proof
                        h = xxhash.xxh3_128_intdigest(raw[s : s + MATCH])
                        if h in seen:
                            again.append(s)
                            continue
                        seen.add(h)
                        out.append((((h >> 64) ^ (1 << 63)) - (1 << 63), ((h & (2**64 - 1)) ^ (1 << 63)) - (1 << 63), int(doc), s, None, None))
                    for a, b in zip(*(x.tolist() for x in runs(np.array(again, dtype=np.int64))), strict=True):
                        out.append((0, None, int(doc), a, b, None))
                    size += 64 * len(seen)
                if size > 8 << 20:
                    yield parts_frame(out)
                    out, size = [], 0
            if out:
                yield parts_frame(out)

    lists = places.groupBy("doc_id").agg(F.collect_list(F.struct("pos", F.coalesce("key", F.lit(0)).alias("key"), F.col("key").isNull().alias("hot"))).alias("x")).select("doc_id", "x.pos", "x.key", "x.hot")
    lists = lists.join(copies, "doc_id", "left_anti")
    parts = cut(packed.join(lists, "doc_id").mapInPandas(slices, "key long, more long, doc_id long, start long, stop long, bytes binary"), "parts")
    free(docs.sparkSession)

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solve(held):
            docs_ = np.array([r[1] for r in held])
            starts = np.array([r[2] for r in held], dtype=np.int64)
            out = []
            for (_, doc, start, _), got in zip(held, repeated_starts([r[3] for r in held], docs_, starts), strict=True):
                if len(got):
                    a, b = runs(got + start)
                    out += zip([doc] * len(a), a.tolist(), b.tolist(), strict=True)
            return pd.DataFrame(out, columns=["doc_id", "a", "b"])

        held, size, last, seen = [], 0, None, {}
        for batch in batches:
            again = []
            for key, doc, start, part in zip(batch["key"], batch["doc_id"], batch["start"], batch["bytes"], strict=True):
                if key != last:
                    if size > SHARD_BYTES:
                        yield solve(held)
                        held, size = [], 0
                    last, seen = key, {}
                part = bytes(part)
                if part in seen:  # all its strings start earlier, where the part came first
                    if seen[part] != (doc, start):  # else a repeated row
                        again.append((int(doc), int(start), int(start) + len(part)))
                    continue
                seen[part] = doc, start
                held.append((int(key), int(doc), int(start), part))
                size += len(part) + 1
            if again:
                yield pd.DataFrame(again, columns=["doc_id", "a", "b"])
        if held:
            yield solve(held)

    cold = parts.where("bytes is not null").select("key", "doc_id", "start", "bytes").repartition("key").sortWithinPartitions("key", "doc_id", "start")
    spans = cold.mapInPandas(shards, "doc_id long, a long, b long")
    strings = parts.where("more is not null").select("key", "more", "doc_id", "start")
    # The earliest place of a string: its smallest doc_id, then the smallest start there.
    first_doc = strings.groupBy("key", "more").agg(F.min("doc_id").alias("doc0"), F.count("*").alias("n")).where("n > 1").select("key", "more", "doc0")
    with_doc = strings.join(first_doc, ["key", "more"])
    first_start = with_doc.where("doc_id = doc0").groupBy("key", "more").agg(F.min("start").alias("start0"))
    later = with_doc.join(first_start, ["key", "more"]).where("doc_id > doc0 or start > start0").select("doc_id", F.col("start").alias("a"), (F.col("start") + MATCH).alias("b"))
    own = parts.where("stop is not null").select("doc_id", F.col("start").alias("a"), F.col("stop").alias("b"))
    spans = cut(spans.unionByName(later).unionByName(own), "spans")
    free(docs.sparkSession)
    gone = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("x")).select("doc_id", "x.a", "x.b")

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for doc, blob, copy, a, b in zip(batch["doc_id"], batch["packed"], batch["copy"], batch["a"], batch["b"], strict=True):
                raw = z.decompress(blob)
                kept, at, n, removed = hashlib.sha256(), 0, 0, 0
                if not pd.isna(copy):
                    a, b = [0], [len(raw)]
                for lo, hi in zip(a, b, strict=True) if a is not None else ():
                    n += lo > at or n == 0
                    kept.update(raw[at:lo])
                    removed += max(0, hi - max(lo, at))
                    at = max(at, hi)
                kept.update(raw[at:])
                out.append((doc, len(raw), int(removed), n, kept.hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    facts = gone.join(copies.withColumn("copy", F.lit(True)), "doc_id", "full")
    return map_rows(
        packed.join(facts, "doc_id", "left").select("doc_id", "packed", "copy", "a", "b"), settle, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
