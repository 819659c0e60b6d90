"""Evaluation texts leaking into training text.

A document leaks an item if it holds a stretch of at least ``stretch`` of the item's words in order with at
most one word in ``per_edit`` changed, left out or added.

1. Every word position of a document and of an item starts a window. A CGK random walk embeds the window:
   at each step it emits the current word and moves on or stays by a random bit of (step, word), so that a
   small edit distance becomes a small Hamming distance of the emitted strings. A walk of ``steps`` covers
   about half as many words: a window as long as a stretch would have to start at its first words and survive
   all its edits, while the shorter ones start anywhere in it and have to survive those they meet.
2. Bit sampling: each repetition has its own walk and its own sample of steps; windows whose sampled words
   agree are candidates. There are as many repetitions as ``recall_of`` needs for ``target_recall``.
3. Candidates are verified by edit alignment to both sides of the agreeing word. The alignment is banded and
   looks ``reach`` words far, which loses nothing: cut a leaking stretch into parts of 20 to 39 words; as its
   edits are at most one in six, so are those of one of the parts, which is then a leaking stretch itself, of
   at most six edits, and shifts by less than the band.

The items' index is small (their windows times the repetitions) and is broadcast in blocks of at most
``block_words`` item words, each block against all documents; the corpus is only scanned, never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import spread
from tidemark.llm.words import BREAK, batch_words, words

ITEM_PAD, DOC_PAD, MIX = -2, -1, np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class LeakRules:
    stretch: int = 20
    per_edit: int = 6
    steps: int = 22
    samples: int = 5
    target_recall: float = 0.9999
    repetitions: int | None = None
    reach: int = 40
    band: int = 8
    block_words: int = 500_000
    seed: int = 7


@lru_cache(maxsize=8)
def recall_of(rules: LeakRules, trials: int = 2000, seed: int = 1, most: int = 16) -> np.ndarray:
    """Share of the shortest leaking stretches that 1, 2, .. ``most`` repetitions find: stretches of ``stretch`` words with
    as many edits as are allowed, at random places, each changed, left out or added, in a text of other words.

    A stretch is found if a window of the text agrees with the item's window of an equal word that an alignment
    of the two can run through, that is, within the band of the stretch's own place."""
    rng = np.random.default_rng(seed)
    n, edits = rules.stretch, rules.stretch // rules.per_edit
    found = np.zeros(most)
    fixed = replace(rules, repetitions=most)
    words_ = [(k, [b"%d.%d" % (k, i) for i in range(2 * n)]) for k in range(trials)]
    index = Index(words_, fixed)
    for k, ws in words_:
        text = list(ws[n // 2 : n // 2 + n])
        for at in sorted(rng.choice(n, edits, replace=False), reverse=True):
            text[at : at + 1] = ([b"?"], [], [b"?", text[at]])[rng.integers(3)]
        doc = np.array([DOC_PAD] * fixed.steps + [index.vocab[w] for w in text] + [DOC_PAD] * 2 * fixed.steps, np.int32)
        at = np.flatnonzero(doc > 0)
        first = most
        for r in range(most):
            key, whole = index.embed(doc, at, r)
            lo, hi = np.searchsorted(index.keys[r], key, "left"), np.searchsorted(index.keys[r], key, "right")
            if (whole & (hi > lo)).any() and any(doc[p] == index.seq[q] and index.item_of[q] == k for p, a, b, w in zip(at, lo, hi, whole) if w for q in index.places[r][a:b]):
                first = r
                break
        found[first:] += 1
    return found / trials


def repetitions_for(rules: LeakRules) -> int:
    """The fewest repetitions that reach the target recall; the most that ``recall_of`` tries if none does."""
    if rules.repetitions is not None:
        return rules.repetitions
    reached = np.flatnonzero(recall_of(replace(rules, repetitions=0)) >= rules.target_recall)
    return int(reached[0]) + 1 if len(reached) else 16


class _Vocabulary(dict):
    def __missing__(self, _):
        return 0


class Index:
    """Item words, walk bits and the sampled keys of every item window, per repetition."""

    def __init__(self, items: list[tuple[int, list[str]]], rules: LeakRules):
        self.rules = rules = replace(rules, repetitions=repetitions_for(rules))
        self.vocab = _Vocabulary()
        seq, item_of, self.ids = [], [], []
        for n, (item, ws) in enumerate(items):
            self.ids.append(item)
            for w in ws:
                if w not in self.vocab:
                    self.vocab[w] = len(self.vocab) + 1
                seq.append(self.vocab[w])
                item_of.append(n)
            seq += [ITEM_PAD] * (rules.reach + rules.steps)
            item_of += [n] * (rules.reach + rules.steps)
        lead = [ITEM_PAD] * rules.reach
        self.vocab[BREAK] = DOC_PAD
        self.seq = np.array(lead + seq, np.int32)
        self.item_of = np.array([0] * len(lead) + item_of, np.int32)
        self.ids = np.array(self.ids, np.int64)
        size = len(self.vocab) + 2
        rng = np.random.default_rng(rules.seed)
        self.bits = rng.integers(0, 2, (rules.repetitions, rules.steps, size), np.int8)
        # The first step is always sampled: it names the word at which the verification starts.
        # Each sample reads one word further on from each of equal slices of the walk, so that keys span the window.
        slices = np.linspace(1, rules.steps, rules.samples).astype(int)
        self.sampled = [{0, *(int(rng.integers(a, b)) for a, b in zip(slices[:-1], slices[1:]))} for _ in range(rules.repetitions)]
        at = np.flatnonzero(self.seq > 0)
        self.keys, self.places = [], []
        for r in range(rules.repetitions):
            k, whole = self.embed(self.seq, at, r)
            o = np.argsort(k[whole], kind="stable")
            self.keys.append(k[whole][o])
            self.places.append(at[whole][o].astype(np.int64))
        self.filter = np.zeros((rules.repetitions, 1 << 20), bool)
        for r, k in enumerate(self.keys):
            self.filter[r, (k >> np.uint64(44)).astype(np.int64)] = True

    def embed(self, seq: np.ndarray, at: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
        """Sampled key of the walk from each position, and whether all sampled words are item words."""
        idx = at.astype(np.intp)
        key = np.zeros(len(at), np.uint64)
        whole = np.ones(len(at), bool)
        last = max(self.sampled[r])
        for s in range(last + 1):
            if s in self.sampled[r]:
                w = seq.take(idx)
                key = (key ^ w.astype(np.uint64)) * MIX
                key ^= key >> np.uint64(29)
                whole &= w > 0
            if s < last:
                idx += self.bits[r, s].take(seq, mode="wrap").take(idx)
        return key * MIX, whole


def _extend(doc: np.ndarray, item: np.ndarray, p: np.ndarray, q: np.ndarray, step: int, rules: LeakRules) -> np.ndarray:
    """Fewest edits for the next 0..reach item words from (p, q) in direction ``step``; padding costs too much."""
    n, big, band = len(p), 1 << 14, rules.band
    width = 2 * band + 1
    off = np.arange(width) - band
    cost = np.where(off >= 0, off, big).astype(np.int32) * np.ones((n, 1), np.int32)  # only additions so far
    best = np.zeros((n, rules.reach + 1), np.int32)
    dead = np.zeros(n, bool)
    for i in range(1, rules.reach + 1):
        w = item[np.clip(q + step * i, 0, len(item) - 1)]
        dead |= w == ITEM_PAD
        j = i + off  # how many document words are used
        d = doc[np.clip(p[:, None] + step * j, 0, len(doc) - 1)]
        same = (d == w[:, None]) & (w > 0)[:, None]
        nxt = cost + np.where(same, 0, 1)
        nxt[:, j < 1] = big
        nxt[:, :-1] = np.minimum(nxt[:, :-1], cost[:, 1:] + 1)  # item word left out
        if i <= band:
            nxt[:, band - i] = np.minimum(nxt[:, band - i], i)  # all item words left out
        for k in range(1, width):  # document words added
            nxt[:, k] = np.minimum(nxt[:, k], nxt[:, k - 1] + 1)
        cost = nxt
        best[:, i] = np.where(dead, big, cost.min(1))
    return best


def promising(doc: np.ndarray, item: np.ndarray, p: np.ndarray, q: np.ndarray, rules: LeakRules) -> np.ndarray:
    """Necessary for a leak through (p, q): some stretch around the anchor has few enough words that do not recur.

    An item word without an equal document word within ``band`` places of the anchor's diagonal costs an edit in every
    alignment that verify() tries, so it accepts no anchor whose stretches all hold more such words than edits."""
    out = np.zeros(len(p), bool)
    n, shift = rules.reach, rules.band
    off = np.arange(-n, n + 1)
    # Fewest words on the right for each number of words on the left.
    least = np.maximum(rules.stretch - 1 - np.arange(n + 1), 0)
    for a in range(0, len(p), 1 << 13):
        s = slice(a, a + (1 << 13))
        it = item[np.clip(q[s, None] + off, 0, len(item) - 1)]
        win = doc[np.clip(p[s, None] + np.arange(-n - shift, n + shift + 1), 0, len(doc) - 1)]
        hit = np.zeros(it.shape, bool)
        for k in range(2 * shift + 1):
            hit |= it == win[:, k : k + len(off)]
        worth = np.where(hit, 1, 1 - rules.per_edit).astype(np.int32)
        worth[it == ITEM_PAD] = -(1 << 14)
        left = np.cumsum(np.pad(worth[:, :n][:, ::-1], ((0, 0), (1, 0))), 1)
        right = np.cumsum(np.pad(worth[:, n + 1 :], ((0, 0), (1, 0))), 1)
        best = np.maximum.accumulate(right[:, ::-1], 1)[:, ::-1]
        out[s] = (left + 1 + best[:, least]).max(1) >= 0
    return out


def verify(doc: np.ndarray, item: np.ndarray, p: np.ndarray, q: np.ndarray, rules: LeakRules) -> np.ndarray:
    """Whether a leaking stretch runs through the equal words doc[p] = item[q]."""
    out = np.zeros(len(p), bool)
    total = np.add.outer(np.arange(rules.reach + 1), np.arange(rules.reach + 1)) + 1
    allowed = np.where(total >= rules.stretch, total // rules.per_edit, -1)
    for a in range(0, len(p), 4096):
        s = slice(a, a + 4096)
        left = _extend(doc, item, p[s], q[s], -1, rules)
        right = _extend(doc, item, p[s], q[s], 1, rules)
        out[s] = (left[:, :, None] + right[:, None, :] <= allowed).any((1, 2))
    return out


def scan(index: Index, doc: np.ndarray, chunk: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (place in doc, place in the items) of one padded word array, without repeats."""
    rules, ps, qs = index.rules, [], []
    at = np.flatnonzero(doc > 0)
    for a in range(0, len(at), chunk):
        part = at[a : a + chunk]
        for r in range(rules.repetitions):
            key, whole = index.embed(doc[part[0] : part[-1] + rules.steps + 1], part - part[0], r)
            hit = whole & index.filter[r, (key >> np.uint64(44)).astype(np.int64)]
            key, p = key[hit], part[hit]
            lo, hi = np.searchsorted(index.keys[r], key, "left"), np.searchsorted(index.keys[r], key, "right")
            n = hi - lo
            if n.any():
                first = np.repeat(lo - np.cumsum(n) + n, n)
                ps.append(np.repeat(p, n))
                qs.append(index.places[r][first + np.arange(n.sum())])
    if not ps:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.concatenate(ps).astype(np.int64) * len(index.seq) + np.concatenate(qs))
    return both // len(index.seq), both % len(index.seq)


def leaks(index: Index, texts: list[str | None]) -> list[tuple[int, int]]:
    """(number of the text, item id) of every leak in a batch of texts."""
    rules = index.rules
    flat = batch_words(texts)
    body = np.fromiter(map(index.vocab.__getitem__, flat), np.int32, len(flat))
    ends = np.flatnonzero(body == DOC_PAD)
    pad = rules.reach + rules.band + rules.steps
    # Breaks are single, so a stretch could only cross into the next text through a word that never agrees,
    # at the price of an edit: positions are kept apart by padding of their own.
    gaps = np.full(len(body), 1, np.int64)
    gaps[ends] = pad
    place = np.cumsum(gaps) - gaps + pad
    doc = np.full(int(gaps.sum()) + 2 * pad, DOC_PAD, np.int32)
    doc[place] = body
    number = np.zeros(len(doc), np.int32)
    number[place] = np.searchsorted(ends, np.arange(len(body)))
    p, q = scan(index, doc)
    if not len(p):
        return []
    keep = doc[p] == index.seq[q]
    p, q = p[keep], q[keep]
    keep = promising(doc, index.seq, p, q, rules)
    p, q = p[keep], q[keep]
    if not len(p):
        return []
    pair = number[p].astype(np.int64) * len(index.ids) + index.item_of[q]
    # One anchor of each pair first; only pairs that fail it have all their anchors verified.
    order = np.argsort(pair, kind="stable")
    p, q, pair = p[order], q[order], pair[order]
    start = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    middle = start + np.diff(np.r_[start, len(pair)]) // 2
    good = pair[middle][verify(doc, index.seq, p[middle], q[middle], rules)]
    rest = ~np.isin(pair, good)
    more = np.unique(pair[rest][verify(doc, index.seq, p[rest], q[rest], rules)])
    return [(int(x) // len(index.ids), int(index.ids[int(x) % len(index.ids)])) for x in np.concatenate([good, more])]


def item_blocks(items: DataFrame, key: str, text: str, rules: LeakRules) -> Iterator[list[tuple[int, list[str]]]]:
    """Items in blocks of at most ``block_words`` words, read one by one; no item is left out."""
    block, size = [], 0
    for row in items.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long"), F.col(text)).toLocalIterator():
        ws = words(row[1])
        if len(ws) < rules.stretch:
            continue
        if block and size + len(ws) > rules.block_words:
            yield block
            block, size = [], 0
        block.append((row[0], ws))
        size += len(ws)
    if block:
        yield block


def find_leaks(documents: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, rules: LeakRules = LeakRules()) -> DataFrame:
    """Distinct (doc_id LONG, item_id LONG) of documents that hold a leaking stretch of an item.

    Null keys or texts and items shorter than a stretch give nothing; words shared by several items count
    for each; repeated rows count once; empty tables give an empty result; extra columns are ignored.
    Texts are processed whole, however long.
    """
    spark = documents.sparkSession
    docs = spread(documents.where(F.col(doc_key).isNotNull() & F.col(doc_text).isNotNull()).select(F.col(doc_key).cast("long").alias("k"), F.col(doc_text).alias("t")))
    out = None
    for block in item_blocks(items, item_key, item_text, rules):
        shared = spark.sparkContext.broadcast(Index(block, rules))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                keys, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
                found, a, size = [], 0, 0
                for b, t in enumerate(texts):
                    size += len(t)
                    if size > 2_000_000 or b + 1 == len(texts):
                        found += [(a + n, item) for n, item in leaks(index, texts[a : b + 1])]
                        a, size = b + 1, 0
                if found:
                    n, item = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[list(n)], pa.int64()), pa.array(item, pa.int64())], ["doc_id", "item_id"])

        part = docs.mapInArrow(run, "doc_id long, item_id long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long")
    return out.distinct()
