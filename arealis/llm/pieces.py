"""SentencePiece encoding by sampling without replacement, and decoding.

A text is a lattice of vocabulary pieces. A segmentation has the product of its pieces'
weights as its probability. Gumbel top-k: if every segmentation's log-probability is
perturbed by Gumbel noise of its own, the k largest are a sample without replacement.
They are found best first without listing segmentations. A node of the search is the set
of all segmentations that share a prefix; its perturbed value is the exact maximum over
the set, drawn from the set's total weight (backward sums over the lattice) and truncated
at its parent's value. Popping the largest node and following its maximum to the end gives
the next segmentation and, beside each of its decisions, one new node: all that differ
there first. So the values are exact bounds and the search never expands what it doesn't
emit. All documents of a block take a step together, in arrays.

Draws depend on the row key, the rank and the position alone: they are the same however
rows are dealt out.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_rows

SEGMENT = re.compile(r" [^ \n]*|\n|[^ \n]+")
BLOCK_CHARS = 1_000_000
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = np.uint64(0xD6E8FEB86659FD93)
#: ``uniform`` has 53 bits, so Gumbel noise lies in (-NOISE, NOISE_MOST): a node whose set
#: weighs less than the k-th best by more than that cannot be among the k best. Nodes are
#: valued for the NEAR first decisions, and then as far as that rule asks.
NOISE, NOISE_MOST, NEAR = math.log(37.5), 37.5, 64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: consecutive inputs give independent-looking outputs."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * M2
        x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Draws in the open interval (0, 1)."""
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def load_pieces(path: str | None = None) -> tuple[list[tuple[int, str, float]], list[int]]:
    """Normal pieces (id, string with blanks for word starts, log weight) of a model file,
    and the ids of the 256 byte pieces. Runs on the driver.

    The model's scores are merge ranks, not log-probabilities, so the weights follow
    Zipf's law over the ranks.
    """
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    normal, byte_ids = [], [0] * 256
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            normal.append((i, sp.id_to_piece(i).replace("▁", " "), -sp.get_score(i)))
    total = math.log(sum(1 / (max(r, 0.0) + 2.7) for _, _, r in normal))
    return [(i, s, -math.log(max(r, 0.0) + 2.7) - total) for i, s, r in normal], byte_ids


class Vocabulary:
    """Pieces and their prefixes in two hash tables, looked up for arrays of hashes."""

    def __init__(self, pieces: list[tuple[int, str, float]], byte_ids: list[int]):
        self.byte_ids = np.array(byte_ids)
        self.byte_weight = min(w for _, _, w in pieces) - 2.0
        self.longest = max(len(s) for _, s, _ in pieces)
        known: dict[str, int] = {}
        for n, (_, s, _) in enumerate(pieces):
            for k in range(1, len(s)):
                known.setdefault(s[:k], -1)
            known[s] = n
        self.ids = np.array([i for i, _, _ in pieces] + [-1])
        self.weights = np.array([w for _, _, w in pieces] + [-np.inf])
        strings = list(known)
        hashes = self._hash(strings)
        values = np.array([known[s] for s in strings])
        first = self._slots(hashes, 20)
        _, keep = np.unique(first, return_index=True)
        self.keys1, self.values1 = np.zeros(1 << 20, np.uint64), np.full(1 << 20, -1)
        self.keys1[first[keep]], self.values1[first[keep]] = hashes[keep], values[keep]
        rest = np.setdiff1d(np.arange(len(strings)), keep)
        order = np.argsort(hashes[rest])
        self.keys2, self.values2 = np.append(hashes[rest][order], np.uint64(2**64 - 1)), np.append(values[rest][order], -1)
        spelt = {i: s.encode() for i, s, _ in pieces} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
        spelling = [spelt.get(i, b"") for i in range(max(spelt) + 1)]
        self.size = np.array([len(x) for x in spelling])
        self.begin = np.cumsum(self.size) - self.size
        self.spelling = np.frombuffer(b"".join(spelling), np.uint8)

    @staticmethod
    def _slots(h: np.ndarray, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((h * M1) >> np.uint64(64 - bits)).astype(np.int64)

    @staticmethod
    def _hash(strings: list[str]) -> np.ndarray:
        out = []
        for s in strings:
            h = 0
            for c in s:
                h = (h * int(BASE) + ord(c) + 1) & (2**64 - 1)
            out.append(h)
        return np.array(out, dtype=np.uint64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is a prefix or piece, number of the piece or -1)."""
        slot = self._slots(h, 20)
        hit = self.keys1[slot] == h
        value = np.where(hit, self.values1[slot], -1)
        miss = np.flatnonzero(~hit & (self.keys1[slot] != 0))
        if len(miss):
            at = np.searchsorted(self.keys2, h[miss])
            also = self.keys2[at] == h[miss]
            hit[miss[also]] = True
            value[miss[also]] = self.values2[at[also]]
        return hit, value


class Lattice:
    """The lattices of distinct segments, side by side: state s is a character, and a
    segment's end is the state one past its last character. Edges are pieces; those of a
    state stand together, the longest first, and states by their distance to the end."""

    def __init__(self, segments: list[str], vocabulary: Vocabulary):
        v = vocabulary
        sizes = np.array([len(s) for s in segments], dtype=np.int64)
        self.start = np.cumsum(sizes + 1) - sizes - 1
        end = self.start + sizes
        text = "\0".join([*segments, ""])
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(code)
        left = (np.repeat(end, sizes + 1) - np.arange(n)).astype(np.int32)  # characters from a state to its segment's end
        longest = int(left.max(initial=0))
        # 16 bits are sorted by digits. The ends come first, and have no edges.
        order = np.argsort(left.astype(np.uint16) if longest < 1 << 16 else left, kind="stable")[len(segments) :].astype(np.int32)
        left = left[order]
        bounds = np.searchsorted(left, np.arange(1, longest + 2))
        live, edges = np.arange(len(order), dtype=np.int32), []
        h = np.zeros(len(live), np.uint64)
        for k in range(v.longest):
            fits = int(np.searchsorted(live, bounds[min(k, longest)]))
            live, h = live[fits:], h[fits:]
            with np.errstate(over="ignore"):
                h = h * BASE + code[order[live] + k] + np.uint64(1)
            hit, value = v.find(h)
            live, h, value = live[hit], h[hit], value[hit]
            full = value >= 0
            edges.append((live[full], v.ids[value[full]], v.weights[value[full]]))
            if not len(live):
                break
        spelt = np.ones(len(order), bool)
        spelt[edges[0][0]] = False
        bare = np.flatnonzero(spelt).astype(np.int32)  # characters that only byte pieces spell
        c = code[order[bare]].astype(np.int64)
        n_bytes = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        bytes_of = np.where(c < 0x80, v.byte_ids[np.minimum(c, 0x7F)], -c - 2)
        edges[0] = tuple(np.concatenate(x) for x in zip(edges[0], (bare, bytes_of, v.byte_weight * n_bytes), strict=True))
        count = np.zeros(len(order), np.int32)
        for at, _, _ in edges:
            count[at] += 1
        first = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
        total = int(first[-1])
        self.piece, self.next, weight = np.empty(total, np.int32), np.empty(total, np.int32), np.empty(total)
        free = first[:-1].copy()
        for k in range(len(edges) - 1, -1, -1):
            at, piece, w = edges[k]
            slot = free[at]
            free[at] += 1
            self.piece[slot], weight[slot], self.next[slot] = piece, w, order[at] + (k + 1)
        del edges, free
        #: A state's first edge, or -1 at an end, and the number of its edges.
        self.first, self.count = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        self.first[order], self.count[order] = first[:-1], count
        back, self.log, self.chance = np.zeros(n), np.empty(total), np.empty(total)
        for d in range(len(bounds) - 1):
            i, j = bounds[d], bounds[d + 1]
            begin, stop = first[i], first[j]
            own, many = first[i:j] - begin, count[i:j]
            x = weight[begin:stop] + back[self.next[begin:stop]]
            top = np.maximum.reduceat(x, own)
            x -= np.repeat(top, many)
            e = np.exp(x)
            mass = np.add.reduceat(e, own)
            log = np.log(mass)
            back[order[i:j]] = top + log
            self.log[begin:stop] = x - np.repeat(log, many)
            self.chance[begin:stop] = e / np.repeat(mass, many)
        # Sums of the edges before and after an edge, by places in the state: never as a
        # difference from 1, in which unlikely edges would be lost.
        before, after = np.zeros(total), np.zeros(total)
        most = int(count.max(initial=0))
        have = [first[:-1][count > r] + r for r in range(most)]
        for r in range(1, most):
            before[have[r]] = before[have[r] - 1] + self.chance[have[r] - 1]
        for r in range(most - 1, 0, -1):
            after[have[r] - 1] = after[have[r]] + self.chance[have[r]]
        with np.errstate(divide="ignore"):
            self.others = np.log(before + after)
        self.upto = before + self.chance
        self.upto[first[1:] - 1] = 2.0  # whatever the rounding, a draw ends at the last edge
        self.source = np.repeat(order, count)
        begins = np.zeros(n, bool)
        begins[self.start] = True
        self.begins = begins[self.source]

    def odds(self, edge: int, taken: int) -> tuple[int, np.ndarray]:
        """The first edge beside ``edge``, and the chances of all but those ``taken``."""
        s = self.source[edge]
        e, odds = int(self.first[s]), self.chance[self.first[s] : self.first[s] + self.count[s]].copy()
        odds[[x for x in range(len(odds)) if taken >> x & 1]] = 0
        return e, odds


class Paths:
    """One segmentation of each document of a block: its edges, documents one after another."""

    __slots__ = ("edge", "offset")

    def __init__(self, edge, offset):
        self.edge, self.offset = edge, offset


def _walk(lat: Lattice, state: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sample each walk from its state to its segment's end. Returns the edges of all
    walks in order, and how many each walk has."""
    count, steps = np.zeros(len(state), np.int64), []
    edge = lat.first[state]
    live = np.flatnonzero(edge >= 0)
    edge, seed = edge[live], seed[live]
    while len(live):
        with np.errstate(over="ignore"):
            u = uniform(seed + np.uint64(len(steps)) * M1)
        miss = np.flatnonzero(u >= lat.upto[edge])
        while len(miss):
            edge[miss] += 1
            miss = miss[u[miss] >= lat.upto[edge[miss]]]
        steps.append((live, edge))
        edge = lat.first[lat.next[edge]]
        more = edge >= 0
        count[live[~more]] = len(steps)
        live, edge, seed = live[more], edge[more], seed[more]
    first = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.int32)
    for i, (who, edge) in enumerate(steps):
        out[first[who] + i] = edge
    return out, count


def sample_block(keys: list[int], texts: list[str], k: int, v: Vocabulary) -> list[list[tuple[float, float, float, np.ndarray]]]:
    """For each non-empty text up to k (log-probability, perturbed value, inclusion
    probability, ids), by falling perturbed value."""
    segments_of = [SEGMENT.findall(" " + t) for t in texts]
    words, distinct = pd.factorize(np.array([s for found in segments_of for s in found], dtype=object))
    lat = Lattice(distinct.tolist(), v)
    n_docs = len(texts)
    sizes = np.array([len(f) for f in segments_of], dtype=np.int64)
    del segments_of, distinct
    first_word = np.concatenate([[0], np.cumsum(sizes)])
    word_at = np.arange(len(words)) - np.repeat(first_word[:-1], sizes)
    key = mix(np.array([x & (2**64 - 1) for x in keys], dtype=np.uint64) + M1)
    out: list[list[tuple[float, float, float, np.ndarray]]] = [[] for _ in texts]
    agenda: list[list[tuple[float, int, int, int]]] = [[] for _ in texts]
    rounds: list[Paths] = []
    row_of = [np.full(n_docs, -1) for _ in range(k)]
    scores: list[list[tuple[float, float]]] = [[] for _ in texts]

    for rank in range(k):
        # What each document follows now: (decision to replace, forbidden lengths, value).
        todo, value, parts = [], [], []
        for d in range(n_docs):
            if rank == 0:
                todo.append(d)
                value.append(-math.log(-math.log(float(uniform(key[d : d + 1])[0]))))
                parts.append(None)
            elif agenda[d]:
                g, r, t, taken = heapq.heappop(agenda[d])
                todo.append(d)
                value.append(-g)
                parts.append((r, t, taken))
        if not todo:
            break
        row_of[rank][todo] = np.arange(len(todo))
        heads, heads_taken, walk_state, walk_seed, n_walks = [], [], [], [], []
        with np.errstate(over="ignore"):
            salt = key + np.uint64(rank + 1) * M3
            for d, part in zip(todo, parts, strict=True):
                a, b = first_word[d], first_word[d + 1]
                if part is None:
                    head = np.empty(0, np.int32)
                    taken, begin = 0, a
                else:
                    r, t, taken = part
                    old, i = rounds[r], row_of[r][d]
                    o = old.offset[i]
                    first, odds = lat.odds(old.edge[o + t], taken)
                    u = float(uniform(salt[d : d + 1] ^ M2)[0])
                    new = int(np.searchsorted(np.cumsum(odds), u * odds.sum(), side="right"))
                    new = first + min(new, int(np.flatnonzero(odds)[-1]))
                    head = np.append(old.edge[o : o + t], np.int32(new))
                    begin = a + int(lat.begins[head].sum())  # past the word that decision t lies in
                    walk_state.append(lat.next[new : new + 1])
                    walk_seed.append(salt[d : d + 1] + np.uint64(begin - 1 - a) * BASE + M2)
                heads.append(head)
                heads_taken.append(taken)
                walk_state.append(lat.start[words[begin:b]])
                walk_seed.append(salt[d] + word_at[begin:b].astype(np.uint64) * BASE)
                n_walks.append(b - begin + (part is not None))
        walked, count = _walk(lat, np.concatenate(walk_state), np.concatenate(walk_seed))
        n_walked = np.add.reduceat(np.append(count, 0), np.minimum(np.cumsum([0, *n_walks])[:-1], len(count))) * (np.array(n_walks) > 0)
        cuts = np.concatenate([[0], np.cumsum(n_walked)])
        edge = np.concatenate([x for i in range(len(todo)) for x in (heads[i], walked[cuts[i] : cuts[i + 1]])])
        n_heads = np.array([len(x) for x in heads])
        offset = np.concatenate([[0], np.cumsum(n_heads + n_walked)])
        run = np.concatenate([[0.0], np.cumsum(lat.log[edge])])
        n_todo = len(todo)
        bound = np.array(value)
        los = offset[:-1] + np.maximum(0, n_heads - 1)

        def values(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Perturbed values of the new nodes at decisions lo..hi of each document, and
            the least that they could have been drawn as, with where each document begins."""
            n = hi - lo
            begin = np.concatenate([[0], np.cumsum(n)])
            owner = np.repeat(np.arange(n_todo), n)
            at = np.arange(begin[-1]) - np.repeat(begin[:-1] - lo, n)
            others = lat.others[edge[at]]
            for i in range(n_todo):
                if heads_taken[i] and n[i] and lo[i] == los[i]:
                    first, odds = lat.odds(edge[lo[i]], heads_taken[i])
                    odds[edge[lo[i]] - first] = 0
                    others[begin[i]] = math.log(odds.sum()) if odds.any() else -math.inf
            with np.errstate(divide="ignore", over="ignore"):
                mass = run[at] - run[offset[:-1]][owner] + others
                noise = np.log(-np.log(uniform((salt[todo] ^ M1)[owner] + (at - offset[:-1][owner]).astype(np.uint64) * M2)))
                over = mass - bound[owner]
                g = np.where(mass > -np.inf, mass - np.logaddexp(noise, over), -np.inf)
                least = np.where(mass > -np.inf, mass - np.logaddexp(NOISE, over), -np.inf)
            return g, least, begin

        his = np.minimum(offset[1:], los + NEAR)
        g, least, begin = values(los, his)
        need, ends = k - rank, his.copy()
        for i in range(n_todo):
            if his[i] < offset[i + 1]:
                some = least[begin[i] : begin[i + 1]]
                kth = np.partition(some, -need)[-need] if len(some) >= need else -np.inf
                far = run[his[i] : offset[i + 1]]  # falls from decision to decision
                ends[i] += int(np.searchsorted(-far, NOISE_MOST - kth - run[offset[i]], side="right"))
        rest_g, _, rest_begin = values(his, ends)
        rounds.append(Paths(edge, offset))
        for i, d in enumerate(todo):
            lo, hi = int(los[i]), int(offset[i + 1])
            scores[d].append((float(run[hi] - run[offset[i]]), value[i]))
            ids = lat.piece[edge[offset[i] : hi]]
            if ids.size and ids.min() < 0:
                ids = np.array([y for x in ids.tolist() for y in ([x] if x >= 0 else v.byte_ids[list(chr(-x - 2).encode("utf-8", "surrogatepass"))])], dtype=np.int32)
            out[d].append(ids)
            part = g[begin[i] : begin[i + 1]]
            if ends[i] > his[i]:
                part = np.concatenate([part, rest_g[rest_begin[i] : rest_begin[i + 1]]])
            best = np.argpartition(part, -need)[-need:] if len(part) > need else np.arange(len(part))
            for j in best.tolist():
                if part[j] > -np.inf:
                    t = int(lo - offset[i]) + j
                    mask = 1 << int(edge[lo + j] - lat.first[lat.source[edge[lo + j]]]) | (heads_taken[i] if n_heads[i] and t == n_heads[i] - 1 else 0)
                    heapq.heappush(agenda[d], (-float(part[j]), rank, t, mask))
    result = []
    for d in range(n_docs):
        edge = -agenda[d][0][0] if agenda[d] else -math.inf
        result.append([(p, g, -math.expm1(-math.exp(min(p - edge, 700.0))) if edge > -math.inf else 1.0, ids) for (p, g), ids in zip(scores[d], out[d], strict=True)])
    return result


def decode(ids: np.ndarray, v: Vocabulary) -> str:
    """The text of a sequence of ids; the inverse of every segmentation."""
    size = v.size[ids]
    end = np.cumsum(size)
    at = np.arange(end[-1] if len(end) else 0) + np.repeat(v.begin[ids] - end + size, size)
    return v.spelling[at].tobytes()[1:].decode("utf-8", "surrogatepass")


def encode_sampled(docs: DataFrame, k: int = 3, digest: bool = True, path: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Up to ``k`` distinct segmentations of every whole text of ``docs(doc_id, text)``.

    Returns doc_id, sample (1 is the largest perturbed value), n_tokens, log_prob (under
    the lattice's distribution), perturbed, inclusion (the probability that a segmentation
    is above the threshold, the largest value left out: log_prob's importance weight is
    its inverse) and round_trip (decoding gives the text). With ``digest`` the ids come as
    ids_crc32 of their little-endian 32-bit values, else as ids. ``carry`` names columns of
    long values that each sample takes along from its row.

    The row key that seeds the draws is doc_id and the text: repeated rows give equal
    results. A null doc_id counts as 0 there. A null or empty text has one segmentation,
    without pieces. A text with fewer than ``k`` segmentations gives all it has, each with
    inclusion 1. Blanks are word starts, other characters outside the vocabulary are
    spelt by byte pieces, so that every text decodes to itself. No piece crosses a blank
    or a line end. Blocks of about a million characters bound memory; a longer text is a
    block of its own. An empty table gives an empty result; other columns are ignored.
    """
    pieces = load_pieces(path)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # the vocabulary: its size is the model's
    last = ("ids_crc32", "long") if digest else ("ids", "array<int>")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = Vocabulary(*shared.value)

        def flush(rows):
            out = []
            full = [r for r in rows if r[1]]
            found = sample_block([int(r[0] or 0) * 0x100000001B3 + zlib.crc32(r[1].encode("utf-8", "surrogatepass")) for r in full], [r[1] for r in full], k, v) if full else []
            samples = iter(found)
            for doc, text, *kept in rows:
                for i, (p, g, q, ids) in enumerate(next(samples) if text else [(0.0, 0.0, 1.0, np.empty(0, np.int32))]):
                    ok = decode(ids, v) == text if text else True
                    ids = ids.astype("<i4")
                    out.append((doc, i + 1, len(ids), p, g, q, ok, zlib.crc32(ids.tobytes()) if digest else ids, *kept))
            return pd.DataFrame(out, columns=["doc_id", "sample", "n_tokens", "log_prob", "perturbed", "inclusion", "round_trip", last[0], *carry])

        rows, size = [], 0
        for batch in batches:
            for doc, text, *kept in zip(batch["doc_id"], batch["text"], *(batch[c] for c in carry), strict=True):
                text = text if isinstance(text, str) else ""
                if rows and size + len(text) > BLOCK_CHARS:
                    yield flush(rows)
                    rows, size = [], 0
                rows.append((doc if isinstance(doc, str) else None, text, *kept))
                size += len(text)
        if rows:
            yield flush(rows)

    return map_rows(
        docs.select("doc_id", "text", *carry), run, f"doc_id long, sample int, n_tokens long, log_prob double, perturbed double, inclusion double, round_trip boolean, {last[0]} {last[1]}" + "".join(f", {c} long" for c in carry)
    )


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_sampled(documents(spark, sf_dir)).select(
        "doc_id", "sample", "n_tokens", F.round("log_prob", 6).alias("log_prob"), F.round("perturbed", 6).alias("perturbed"), "inclusion", "round_trip", "ids_crc32"
    )
