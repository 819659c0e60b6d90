"""Splitting oversized texts at natural boundaries by agglomerative merging.

Token boundaries of the whole text are graded: paragraph, line, sentence, clause, word, none. Adjacent
segments sit in a heap keyed by the grade between them, then by their joint size, and the weakest boundaries
merge first while the joint size plus the overlap fits the limit. A stretch between boundaries of some grade
whose inner boundaries are all weaker and which fits as a whole is merged completely before any boundary of
that grade is looked at: each of its pairs lies inside it, so none is ever too large. Such a stretch starts
as one atom; only stretches that don't fit are taken apart to the next finer grade. The result is that of
merging from single tokens, as long as no character has more tokens than a piece may hold.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import RANKS, byte_lengths, encode, spread

GRADES = ("none", "word", "clause", "sentence", "line", "paragraph")
FORBIDDEN = -1
SCHEMA = "doc_id long, piece int, pieces int, start_char long, own_start_char long, end_char long, tokens int, boundary string, text string"


@dataclass(frozen=True)
class SplitRules:
    limit: int = 512
    overlap: int = 64
    path: str = RANKS

    def __post_init__(self):
        if not 0 <= self.overlap < self.limit - 4:
            raise ValueError("the overlap must leave room for at least five tokens")


def grades(data: bytes, at: np.ndarray) -> np.ndarray:
    """Grade of each byte offset ``at`` (ascending, inside the text)."""
    u = np.frombuffer(data, np.uint8)
    n = len(u)
    white = np.isin(u, np.frombuffer(b" \t\r\n\f\v", np.uint8))
    line = (u == 10) | (u == 12) | ((u == 13) & (np.r_[u[1:], 0] != 10))
    lines = np.r_[0, np.cumsum(line)]
    solid = np.r_[0, np.maximum.accumulate(np.where(white, 0, np.arange(1, n + 1)))]  # end of the last non-blank before
    q = solid[at]
    nxt = u[np.minimum(at, n - 1)]
    gap = at > q
    out = np.where(gap | white[np.minimum(at, n - 1)], 1, 0)

    def last(k: int) -> np.ndarray:
        return np.where(q >= k, u[np.maximum(q - k, 0)], 0)

    one = last(1)
    closed = np.isin(one, np.frombuffer(b"\"')]", np.uint8))
    mark = np.where(closed, last(2), one)
    spaced = out > 0
    out = np.where(spaced & np.isin(one, np.frombuffer(b",;:", np.uint8)), 2, out)
    out = np.where(spaced & np.isin(mark, np.frombuffer(b".!?", np.uint8)), 3, out)
    three = (last(3).astype(np.int64) << 16) | (last(2).astype(np.int64) << 8) | one
    code = lambda s: [int.from_bytes(c.encode(), "big") for c in s]
    out = np.where(np.isin(three, code("，、；：—")), 2, out)
    out = np.where(np.isin(three, code("。！？…")), 3, out)
    passed = lines[at] - lines[q]
    fresh = ~line[np.minimum(at, n - 1)]  # inside a run of line ends only its end counts
    out = np.where((passed == 1) & fresh, 4, out)
    out = np.where((passed >= 2) & fresh, 5, out)
    return np.where((nxt & 0xC0) == 0x80, FORBIDDEN, out)


def atoms(grade: np.ndarray, n: int, cap: int) -> list[int]:
    """Cut places (token numbers, ascending) of the atomic segments; grade[i] is the boundary before token i."""
    cuts, todo = [], [(0, n, 5)]
    while todo:
        a, b, level = todo.pop()
        if b - a <= cap or level < 0:
            continue
        inner = np.flatnonzero(grade[a + 1 : b] >= level) + a + 1
        if len(inner):
            cuts += inner.tolist()
            edges = [a, *inner.tolist(), b]
            todo += [(x, y, level - 1) for x, y in zip(edges[:-1], edges[1:]) if y - x > cap]
        else:
            todo.append((a, b, level - 1))
    return sorted(cuts)


def agglomerate(cuts: list[int], grade, n: int, cap: int) -> list[int]:
    """Cut places left after merging weakest boundaries first (ties: smaller joint size, then earlier place)."""
    edges = [0, *cuts, n]
    k = len(edges) - 1
    if k <= 1:
        return []
    left, right, alive = list(range(-1, k - 1)), list(range(1, k + 1)), [True] * k
    end = edges[1:]
    heap = [(int(grade[edges[i + 1]]), edges[i + 2] - edges[i], i) for i in range(k - 1)]
    heapq.heapify(heap)
    while heap:
        g, size, i = heapq.heappop(heap)
        if not alive[i] or right[i] >= k:
            continue
        j = right[i]
        now = end[j] - edges[i]
        if int(grade[edges[j]]) != g or now != size:
            continue
        if now > cap:
            continue  # sizes only grow, so this pair will never fit
        alive[j] = False
        end[i] = end[j]
        right[i] = right[j]
        if right[i] < k:
            left[right[i]] = i
            heapq.heappush(heap, (int(grade[end[i]]), end[right[i]] - edges[i], i))
        if left[i] >= 0:
            h = left[i]
            heapq.heappush(heap, (int(grade[edges[i]]), end[i] - edges[h], h))
    return [edges[i] for i in range(1, k) if alive[i]]


def split_text(text: str, rules: SplitRules) -> list[tuple]:
    """Pieces (start, own start, end as character offsets, tokens, boundary at the end, text); none if it fits."""
    if len(text) * 4 <= rules.limit:
        return []
    data = text.encode("utf-8", "replace")
    if len(data) <= rules.limit:
        return []
    tokens = encode(text, rules.path)
    n = len(tokens)
    if n <= rules.limit:
        return []
    offset = np.r_[0, np.cumsum(byte_lengths(rules.path)[np.array(tokens)])].astype(np.int64)
    grade = np.zeros(n + 1, np.int64)
    grade[1:n] = grades(data, offset[1:n])
    cap = rules.limit - rules.overlap
    ends = [*agglomerate(atoms(grade, n, cap), grade, n, cap), n]
    chars = np.r_[0, np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)]
    out, a, queue = [], 0, ends[::-1]
    while queue:
        b = queue[-1]
        s = max(0, a - rules.overlap) if a else 0
        while offset[s] < offset[a] and (data[offset[s]] & 0xC0) == 0x80:
            s += 1  # the overlap starts with a whole character
        piece = data[offset[s] : offset[b]].decode("utf-8", "replace")
        size = len(encode(piece, rules.path))
        if size > rules.limit:
            # Taken alone the piece needs more tokens than inside the text: merge its part anew with so much less room.
            part = np.r_[0, grade[a + 1 : b], 0]
            room = max(1, b - a - (size - rules.limit))
            again = agglomerate(atoms(part, b - a, room), part, b - a, room)
            if again:
                queue += [a + c for c in reversed(again)]
                continue
        queue.pop()
        out.append((int(chars[offset[s]]), int(chars[offset[a]]), int(chars[offset[b]]), size, "end" if b == n else GRADES[max(0, int(grade[b]))], piece))
        a = b
    return out


def split_documents(documents: DataFrame, key: str, text: str, rules: SplitRules = SplitRules()) -> DataFrame:
    """Ordered pieces of every text of more than ``limit`` tokens; one narrow pass over a large table.

    Every piece has at most ``limit`` tokens when taken alone (short of a limit below what one character and its
    overlap need), the pieces' own parts (own_start_char to
    end_char) tile the text, and each piece but the first starts ``overlap`` tokens earlier (at the next whole
    character where a token is part of one). Null texts and texts within the limit give no rows; repeated
    rows are split each; a null key stays null. Extra columns are ignored; an empty table gives none.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                pieces = split_text(t, rules)
                rows += [(k, i + 1, len(pieces), *p) for i, p in enumerate(pieces)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names)

    return spread(documents.where(F.col(text).isNotNull()).select(F.col(key).cast("long"), F.col(text))).mapInArrow(run, SCHEMA)
