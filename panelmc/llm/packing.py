"""Packing (operator 5): token windows by Karmarkar-Karp multiway differencing.

A task tokenizes its documents, cuts whole windows off the long ones, and deals what is left over
to near-equal windows. Nothing is shuffled: windows form inside a task's own stretch of the input, whose
rows and order a second attempt reads again, so a lost executor's windows come back the same.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmc.llm.shared import mixed, parts

SPACE, LETTER, NUMBER, OTHER = range(4)
#: Of the byte-level pattern: what may follow an apostrophe as a token of its own.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Distinct pre-tokens whose ids a task remembers before it starts anew.
REMEMBERED = 400_000


@lru_cache(1)
def kinds() -> np.ndarray:
    """Of each code point: SPACE, LETTER, NUMBER or OTHER."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        first = unicodedata.category(chr(c))[0]
        if first == "L":
            out[c] = LETTER
        elif first == "N":
            out[c] = NUMBER
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return out


def pretokens(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the pieces that the byte-level pattern cuts texts into; every code point is in one piece."""
    n = len(points)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind = kinds()[points]
    starts = np.ones(n, bool)
    starts[1:] = kind[1:] != kind[:-1]
    head = np.zeros(n + 1, bool)
    head[offsets] = True
    starts |= head[:n]
    # the last white space before other text: a piece of its own, or, if it is a blank, part of what follows
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~head[1:n])
    starts[last] = True
    blank = last[points[last] == 32]
    starts[blank + 1] = False
    # an apostrophe at the start of its piece takes a contraction's letters with it
    quote = np.flatnonzero((points == 39) & starts)
    if len(quote):
        text_end = offsets[np.searchsorted(offsets, quote, "right")]
        for q, end in zip(quote.tolist(), text_end.tolist(), strict=True):
            tail = "".join(map(chr, points[q + 1 : min(q + 3, end)].tolist()))
            for c in CONTRACTIONS:
                if tail.startswith(c):
                    starts[q + 1] = False
                    after = q + 1 + len(c)
                    if after < end and kind[after] == LETTER:
                        starts[after] = True
                    break
    begin = np.flatnonzero(starts)
    return begin, np.append(begin[1:], n)


class Tokens:
    """Ids of texts as the tokenizer file gives them. Each distinct piece is merged once, its ids are then remembered."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        self.path, self.whole = path, None
        self.special = [x["content"] for x in held["added_tokens"]]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        ranks = {bytes(char[c] for c in t): i for t, i in held["model"]["vocab"].items() if t not in self.special}
        # pieces go in together, a NUL between them; so one call merges many, and none across its ends
        self.merge = tiktoken.Encoding("piece", pat_str=r"[^\x00]+|\x00", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.nul = ranks[b"\x00"]
        self.merge_any = tiktoken.Encoding("any", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.forget()

    def forget(self) -> None:
        """Nothing is remembered: hashes in order, and for each where its ids are in the store and how many."""
        self.known = np.empty(0, np.uint64)
        self.at, self.size, self.store = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """Merges pieces that are new; hashes are in order."""
        merged = np.array(self.merge("\0".join(p if "\0" not in p else "" for p in pieces)), np.uint32)
        cut = np.flatnonzero(merged == self.nul)
        at = np.append(0, cut + 1)
        size = np.append(cut, len(merged)) - at
        odd = [(k, np.array(self.merge_any(p), np.uint32)) for k, p in enumerate(pieces) if "\0" in p]
        for k, ids in odd:
            at[k], size[k] = len(merged), len(ids)
            merged = np.concatenate([merged, ids])
        where = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, where, hashes)
        self.at = np.insert(self.at, where, at + len(self.store))
        self.size = np.insert(self.size, where, size)
        self.store = np.concatenate([self.store, merged])

    def slow(self, text: str) -> np.ndarray:
        """A text that spells a special token goes to the library as it is."""
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        odd = {i: self.slow(t) for i, t in enumerate(texts) if any(s in t for s in self.special)}
        plain = ["" if i in odd else t for i, t in enumerate(texts)]
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in plain], out=offsets[1:])
        joined = "".join(plain)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        begin, end = pretokens(points, offsets)
        if len(self.known) > REMEMBERED:
            self.forget()
        size = end - begin
        place = np.arange(len(points)) - np.repeat(begin, size)
        powers = np.ones(int(size.max(initial=1)), np.uint64)
        powers[1:] = 0x2545F4914F6CDD1D
        np.multiply.accumulate(powers, out=powers)
        values = (points.astype(np.uint64) + np.uint64(1)) * powers[place]
        hashes = mixed(np.add.reduceat(values, begin) + size.astype(np.uint64)) if len(begin) else np.empty(0, np.uint64)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        found = np.searchsorted(self.known, distinct)
        new = np.flatnonzero(np.append(self.known, np.uint64(0))[found] != distinct)
        if len(new):
            self.learn(distinct[new], [joined[b:e] for b, e in zip(begin[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
            found = np.searchsorted(self.known, distinct)
        at, n = self.at[found][which], self.size[found][which]
        before = np.cumsum(n) - n
        ids = self.store[np.arange(int(n.sum())) + np.repeat(at - before, n)]
        cuts = np.append(before, len(ids))[np.searchsorted(begin, offsets)]
        return [odd.get(i, ids[a:b]) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Karmarkar-Karp for `ways` parts: the two partial partitions of largest spread are merged,
    the fullest part of one with the emptiest of the other, until one is left. Gives the parts' item numbers."""
    heap = []
    for i, s in enumerate(sizes):
        heap.append((-s, i, np.array([0] * (ways - 1) + [s]), [()] * (ways - 1) + [((), i)]))
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        sums = a[2] + b[2][::-1]
        order = np.argsort(sums, kind="stable")
        items = [(x, y) if x and y else x or y for x, y in zip(a[3], reversed(b[3]), strict=True)]
        sums = sums[order]
        # only differences matter for the choice, so the smallest part counts as nothing
        heapq.heappush(heap, (-int(sums[-1] - sums[0]), serial, sums, [items[k] for k in order.tolist()]))
        serial += 1
    return [leaves(x, []) for x in heap[0][3]] if heap else []


def leaves(tree, out: list[int]) -> list[int]:
    """The item numbers of a part; a leaf is ((), number)."""
    stack = [tree]
    while stack:
        x = stack.pop()
        if not x:
            continue
        if x[0] == () and isinstance(x[1], int):
            out.append(x[1])
        else:
            stack += [x[1], x[0]]
    return sorted(out)


def dealt(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal parts of at most `capacity`: as few as may do, and one more for as long as any is too full."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        out = differencing(sizes, ways)
        if max(sum(sizes[i] for i in part) for part in out) <= capacity:
            return [p for p in out if p]
        ways += 1


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, grain: int = 256, windows: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of all documents' ids.

    ids are little-endian unsigned 32-bit values. A document's ids are its text's and then end_id; null and empty texts
    have end_id alone. Whole windows of `capacity` are cut off each document, the rest is cut into grains of at most
    `grain` ids, and the grains of about `windows` windows at a time are dealt by Karmarkar-Karp differencing; grains of
    one document that meet in a window in order become one piece. A window that ends up under half full, which only the
    last of a task can be, is cut to powers of two. Rows with the same doc_id are packed apart, ties by their order.
    sequence_id is the task's number and the window's number in it. Other columns are left out; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(tokenizer)
        base = TaskContext.get().partitionId() << 32
        serial = 0
        waiting: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        held = 0
        out: list[tuple] = []

        def put(pieces: list[tuple]) -> None:
            nonlocal serial
            at = 0
            for d, start, ids, total in pieces:
                out.append((d, start, len(ids), ids.tobytes(), total, base + serial, at))
                at += len(ids)
            serial += 1

        def split(pieces: list[tuple]) -> None:
            """A window that is far from full, as windows of a power of two, which need no padding."""
            rest = sum(len(p[2]) for p in pieces)
            while rest:
                size = 1 << (rest.bit_length() - 1)
                window, need = [], size
                while need:
                    d, start, ids, total = pieces.pop(0)
                    window.append((d, start, ids[:need], total))
                    if len(ids) > need:
                        pieces.insert(0, (d, start + need, ids[need:], total))
                    need -= len(window[-1][2])
                put(window)
                rest -= size

        def deal(final: bool) -> None:
            nonlocal waiting, held
            grains = [(k, a) for k, w in enumerate(waiting) for a in range(0, len(w[2]), grain)]
            sizes = [min(grain, len(waiting[k][2]) - a) for k, a in grains]
            for part in dealt(sizes, capacity) if grains else []:
                pieces: list[tuple] = []
                for g in part:
                    k, a = grains[g]
                    d, start, ids, total = waiting[k]
                    if pieces and pieces[-1][4] == k and pieces[-1][1] + len(pieces[-1][2]) == start + a:
                        p = pieces[-1]
                        pieces[-1] = (d, p[1], ids[p[1] - start : a + grain], total, k)
                    else:
                        pieces.append((d, start + a, ids[a : a + grain], total, k))
                pieces = [p[:4] for p in pieces]
                used = sum(len(p[2]) for p in pieces)
                if final and used < capacity // 2:
                    split(pieces)
                else:
                    put(pieces)
            waiting, held = [], 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            names = batch.column(0).to_pylist()
            sizes = np.zeros(len(batch) + 1, np.int64)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            np.cumsum([len(t) for t in texts], out=sizes[1:])
            for a, b in parts(sizes):
                for d, ids in zip(names[a:b], tokens(texts[a:b]), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    whole = len(ids) // capacity * capacity
                    for s in range(0, whole, capacity):
                        put([(d, s, ids[s : s + capacity], len(ids))])
                    if whole < len(ids):
                        waiting.append((d, whole, ids[whole:], len(ids)))
                        held += len(ids) - whole
                    # a total a little under whole windows leaves the room that near-equal parts need
                    if held >= windows * capacity and 0.2 < held % capacity / capacity < 0.7:
                        deal(False)
                if len(out) >= 2000:
                    yield flush()
        deal(True)
        if out:
            yield flush()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
