"""Benchmark decontamination (operator 2): a generalised suffix automaton of the test items' words.

The automaton is built from bounded blocks of items inside tasks; training words stream through it, and the longest match
that ends at each word gives the windows that occur.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from panelmc.llm.shared import flat, opened, parts, shared_dir, stored

#: Bytes outside words become blanks, A-Z become a-z; all bytes of other characters are word bytes.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Words of test items in one automaton, which bounds what a task holds (some 100 bytes a word).
WORDS_PER_BLOCK = 200_000
#: Bytes of texts that wait for an automaton where there are several.
HELD_BYTES = 16 << 20


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(NORMAL).split()


class Automaton:
    """Suffix automaton of several word sequences; windows are marked at the states that hold them.

    A window of length k sits in the state whose longest string is at least k and whose link's is shorter. Windows of an item without an id
    are marked with no items."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int):
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        coded = [(i, [self.vocab.setdefault(w, len(self.vocab)) for w in ws]) for i, ws in items if ws]
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        # marks: of a state, the windows in it as (length, items)
        marks: dict[int, dict[int, set[int]]] = {}
        self.least = min([window, *(len(ids) for _, ids in coded)])
        for item, ids in coded:
            k = min(window, len(ids))
            state = size = 0
            for at, c in enumerate(ids):
                while state and c not in self.next[state]:
                    state = self.link[state]
                    size = self.size[state]
                if c in self.next[state]:
                    state, size = self.next[state][c], size + 1
                while self.link[state] >= 0 and self.size[self.link[state]] >= k:
                    state = self.link[state]
                    size = self.size[state]
                size = min(size, k)
                if at + 1 >= k:
                    marks.setdefault(state, {}).setdefault(k, set()).update(() if item is None else (item,))
        self.marks = {s: sorted(((k, tuple(sorted(v))) for k, v in m.items()), reverse=True) for s, m in marks.items()}
        # the nearest state with marks, from a state by way of links, itself included
        order = sorted(range(len(self.size)), key=self.size.__getitem__)
        self.near = [-1] * len(order)
        for s in order:
            self.near[s] = s if s in self.marks else self.near[self.link[s]] if s else -1

    @classmethod
    def held(cls, data: bytes) -> Automaton:
        """From the pickled attributes of one that was built."""
        out = cls.__new__(cls)
        vars(out).update(pickle.loads(data))
        return out

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.size[q] == self.size[last] + 1 else self._clone(last, c, q)
        new = len(self.size)
        self.next.append({})
        self.size.append(self.size[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.size)
        self.next.append(dict(self.next[q]))
        self.size.append(self.size[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def matches(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Stretches of words inside windows that occur (merged, end exclusive), items they are of, and the longest match."""
        ids = np.fromiter(map(self.vocab.get, tokens, repeat(-1)), np.int64, len(tokens))
        known = np.zeros(len(ids) + 2, np.int8)
        known[1:-1] = ids >= 0
        edge = np.diff(known)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # no window is in a run of known words that is shorter than the shortest window
        runs = np.flatnonzero(end - begin >= self.least)
        out: list[tuple[int, int]] = []
        items: set[int] = set()
        longest = 0
        for a, b in zip(begin[runs].tolist(), end[runs].tolist(), strict=True):
            state = size = 0
            for at, c in enumerate(ids[a:b].tolist(), a):
                while state and c not in self.next[state]:
                    state = self.link[state]
                    size = self.size[state]
                if c in self.next[state]:
                    state, size = self.next[state][c], size + 1
                longest = max(longest, size)
                mark, widest = self.near[state], 0
                while mark >= 0:
                    for k, of in self.marks[mark]:
                        if k <= size:
                            widest = max(widest, k)
                            items.update(of)
                    mark = self.near[self.link[mark]] if mark else -1
                if widest:
                    begin_at = at + 1 - widest
                    while out and out[-1][1] >= begin_at:
                        begin_at = min(begin_at, out.pop()[0])
                    out.append((begin_at, at + 1))
        return out, items, longest


def blocks(benchmark: DataFrame, window: int) -> list[str]:
    """Files of the shared folder, each with the pickled automaton of a block of test items. Blocks are cut by a count of all items' bytes; only the files' names come
    to the driver, one for 2 * WORDS_PER_BLOCK bytes or more."""
    items = benchmark.select("item_id", F.col("text").cast("binary").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // (2 * WORDS_PER_BLOCK)))
    folder = f"{shared_dir(benchmark.sparkSession)}/automata"

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("item_id").to_pylist(), table.column("text").to_pylist(), strict=True), key=str)
        made = Automaton([(i, words(t)) for i, t in rows], window)
        path = f"{folder}/{table.column('block')[0].as_py()}-{TaskContext.get().taskAttemptId()}"
        with opened(path, "w") as f:
            f.write(pickle.dumps(vars(made)))
        return pa.table({"path": pa.array([path], pa.string())})

    rows = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))).groupBy("block").applyInArrow(build, "path string")
    return [r.path for r in stored(rows, "blocks").collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, drop_coverage: float | None = None) -> DataFrame:
    """docs with n_words, hits (stretches of words, end exclusive), n_hit, items (item_ids in order), longest (match, in words) and clean_text.

    Words are as the contract has them. A window is `window` consecutive words of an item, or all words of a shorter one;
    an item without words has none. Windows of an item whose item_id is null are hit, and it isn't in items. A document's word inside any occurrence of a window is hit. clean_text is the text
    without the hit stretches, from the first hit word's first byte to the last one's end; where more than drop_coverage of the
    words are hit, all of it goes (null). Null texts have no words and stay null. Ids of items are of any one type. Repeated rows are each a row, repeated items count once;
    columns of these names are replaced, others stay; an empty table gives none. Blocks of items take turns in a scan's task, their stretches are merged.
    """
    nets = blocks(benchmark, window)
    id_type = benchmark.schema["item_id"].dataType
    arrow_id = to_arrow_type(id_type)
    names = ("n_words", "hits", "n_hit", "items", "longest", "clean_text", "_hits", "_items", "_longest")
    docs = docs.drop(*names)
    fields = [(f.name, f.dataType.simpleString()) for f in docs.schema.fields]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: list[Automaton] = []

        def load(path: str) -> Automaton:
            with opened(path, "r") as f:
                return Automaton.held(f.read())

        def done(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            for k, path in enumerate(nets or [""]):
                if len(nets) > 1:
                    loaded[:] = [load(path)]  # one at a time
                elif path and not loaded:
                    loaded.append(load(path))
                for _, texts, n_words, found in held:
                    for i, t in enumerate(texts):
                        # only one text's words are held, which take ten times its bytes
                        ws = words(t)
                        n_words[i] = len(ws)
                        s, items, longest = loaded[0].matches(ws) if loaded else ([], (), 0)
                        if longest:
                            old = found[i]
                            found[i] = (merged(old[0] + s) if k else s, old[1] | items, max(old[2], longest))
            for piece, texts, n_words, found in held:
                n_hit = [sum(b - a for a, b in f[0]) for f in found]
                clean = [t if not h else without(t, f[0]) if drop_coverage is None or h <= drop_coverage * n else None for t, h, f, n in zip(texts, n_hit, found, n_words, strict=True)]
                pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
                yield pa.record_batch(
                    [
                        *piece.columns,
                        pa.array(n_words, pa.int64()),
                        pa.array([[{"start": a, "end": b} for a, b in f[0]] for f in found], pa.list_(pair)),
                        pa.array(n_hit, pa.int64()),
                        pa.array([sorted(f[1]) for f in found], pa.list_(arrow_id)),
                        pa.array([f[2] for f in found], pa.int64()),
                        pa.array(clean, pa.binary()).cast(pa.string()),
                    ],
                    names=[*piece.schema.names, *names[:6]],
                )

        # with several automata, texts wait until there are enough of them to be worth loading each; with one, a part of a batch goes at a time
        held, waiting = [], 0
        for batch in batches:
            _, offsets = flat(batch.column(batch.schema.names.index("text")))
            for a, b in parts(offsets):
                piece = batch.slice(a, b - a)
                texts = piece.column(piece.schema.names.index("text")).cast(pa.binary()).to_pylist()
                held.append((piece, texts, [0] * len(texts), [([], set(), 0)] * len(texts)))
                waiting += int(offsets[b] - offsets[a])
                if len(nets) < 2 or waiting > HELD_BYTES:
                    yield from done(held)
                    held, waiting = [], 0
        yield from done(held) if held else ()

    schema = ", ".join(f"`{n}` {t}" for n, t in fields) + ", n_words long, hits array<struct<start: long, end: long>>, n_hit long, items array<" + id_type.simpleString() + ">, longest long, clean_text string"
    return docs.mapInArrow(scan, schema)


def merged(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: bytes, hits: list[tuple[int, int]]) -> bytes:
    """text without the bytes of the hit words and what is between them."""
    plain = np.frombuffer(text.translate(NORMAL), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], plain.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for a, b in hits:
        out.append(text[at : begin[a]])
        at = int(end[b - 1])
    return b"".join([*out, text[at:]])
