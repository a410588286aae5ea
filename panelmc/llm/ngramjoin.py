"""N-gram Jaccard join (operator 8): prefix-tree join over globally ordered shingle sets.

1. A scan gives each document's set key and adds its shingles and words to count sketches of fixed size. Equal sets are one from here on.
2. The sketches order shingles: those that aren't frequent first, of these the ones of rare words first, which texts don't share by chance,
   however many they are. Sets within the bound share one of their first few shingles, so only sets that meet at such a shingle are
   compared: each first with a few leaders, which a hash picks, so that they are like any other set there.
3. A block is a leader and the sets that met it. Its sets go to a trie, frequent shingles first; each set walks it once, sharing the
   overlaps of common beginnings and leaving subtrees whose remaining lengths can't reach the bound, or that it is linked with.
4. A last round settles every pair that met and is in different components. Where a shingle's sets are of a few components, a set goes to the
   block of each component that it shares enough first shingles with. Where they are of many, their bits alone go to blocks of the shingle; sets
   that bits leave possible pairs of go as they are, once for what such pairs connect, and the trie compares them. So rows don't grow with
   the pairs of a common passage, and sets that share no more than it aren't sent.
Shingles and sets are known by 64-bit hashes. Texts are dealt only where a Bloom filter of those that are wanted lets them through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelmc.llm.shared import BYTE_VALUE, LOWER, NOT_WHITE, flat, mixed, parts, spans, stored, word_hashes
from panelmc.llm.urlfilter import bloom, may_hold

SKETCH_BITS = 18
SKETCH_ROWS = 64
#: Steps of a word's level to a doubling; levels of a shingle's words are added up to the bound.
LEVEL_STEPS, MOST_LEVEL = 4, (1 << 10) - 1
#: First rounds, and leaders that a set is compared with in each; the last round has all others.
ROUNDS, LEADERS = 1, 3
#: Sets beside the leader in one block; a larger group is dealt to several blocks, each with the leader.
MOST_IN_BLOCK = 800
#: Components at one shingle up to which its sets and components are joined; so a set has so many rows there at most.
FEW_COMPONENTS = 24
NO_END = (1 << 63) - 1


def hashed(column, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """Of parts of the texts in order: hashes of the words, of the `size` words from each one on, and where each text's words begin and end."""
    data, offsets = flat(column)
    for a, b in parts(offsets):
        lo, hi = offsets[a], offsets[b]
        part = LOWER[data[lo:hi]]
        begin, end, before = spans(part, offsets[a : b + 1] - lo, NOT_WHITE)
        h = word_hashes(BYTE_VALUE[part], begin, end)
        joined = np.zeros(len(h), np.uint64)
        # powers as weights: with equal steps between them, a b b a and b a a b would be one shingle
        for k in range(size):
            joined[: len(h) - k] += h[k:] * np.uint64(pow(0x9E3779B1, k + 1, 1 << 64))
        yield h, mixed(joined), list(zip(before[:-1].tolist(), before[1:].tolist(), strict=True))


def short(h: np.ndarray) -> np.ndarray:
    """The one shingle of a text of fewer words, none without words."""
    return np.frombuffer(xxhash.xxh3_64_digest(h.tobytes()), np.uint64) if len(h) else np.empty(0, np.uint64)


def shingles(column, size: int, words: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Of each text in order: its distinct shingles' hashes, sorted. Texts of fewer words have all their words as one. words: counters to which
    the words are added."""
    for h, joined, texts in hashed(column, size):
        if words is not None:
            words += np.bincount(counter(h), minlength=len(words))
        for s, e in texts:
            yield np.unique(joined[s : e - size + 1]) if e - s >= size else short(h[s:e])


def leveled_shingles(column, size: int, levels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text in order: shingles(), and the sum of each one's words' levels, MOST_LEVEL at most; 0 for texts of fewer words."""
    for h, joined, texts in hashed(column, size):
        sums = np.zeros(len(h) + 1, np.int64)
        np.cumsum(levels[counter(h)], out=sums[1:])
        level = np.minimum(sums[size:] - sums[:-size], MOST_LEVEL)
        for s, e in texts:
            if e - s >= size:
                each, at = np.unique(joined[s : e - size + 1], return_index=True)
                yield each, level[s : e - size + 1][at]
            else:
                each = short(h[s:e])
                yield each, np.zeros(len(each), np.int64)


def counter(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def frequent(counts: np.ndarray, steps: int) -> np.ndarray:
    """By counter: 0 for what is rare or hidden by the noise of its counter, then a class for each doubling, of so many steps."""
    usual = counts.mean()
    noise = max(8.0, 8 * usual**0.5)
    return np.where(counts - usual < noise, 0, 1 + steps * np.log2(np.maximum(counts - usual, noise) / noise)).astype(np.uint8)


def set_key(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def prefix_length(n: int, num: int, den: int) -> int:
    """Sets of n shingles that are within num / den of another share one of their first so many, in one global order."""
    return n - -(-num * n // den) + 1


def parities(s: np.ndarray) -> np.ndarray:
    """Bit i: whether an odd number of hashes falls on it. Bits that differ between two sets each stand for a hash that only one
    has, so there are at least so many such. A power of two of bits, half as many as hashes at least."""
    bits = max(1024, 1 << (len(s) // 2).bit_length())
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def apart_by(a: np.ndarray, b: np.ndarray) -> int:
    """Differing bits of two parities(); the longer is folded to the shorter's size."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def possible_groups(n: np.ndarray, groups: np.ndarray, rooms: np.ndarray, bits: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """A label for each set, equal where pairs connect sets that may be within the bound by sizes, rooms and bits; pairs inside one of groups don't
    count. A set of no such pair has a label of its own."""
    order = np.argsort(n, kind="stable")
    sizes, lengths, label = n[order], np.array([len(b) for b in bits])[order], np.arange(len(n))
    # bits get longer with n, so sets of the same length and those that are folded to it stand together
    for length in np.unique(lengths):
        lo, hi = np.searchsorted(lengths, (length, length + 1))
        last = int(np.searchsorted(sizes, sizes[hi - 1] * den // num, "right"))
        folded = np.stack([np.bitwise_xor.reduce(bits[i].reshape(-1, length)) for i in order[lo:last]]).view(np.uint64)
        for at in range(lo, hi):
            x = order[at]
            y = np.arange(at + 1, np.searchsorted(sizes, n[x] * den // num, "right"))
            z = order[y]
            ok = (groups[z] != groups[x]) & (label[z] != label[x]) & (rooms[x] >= num * n[z]) & (rooms[z] >= num * n[x])
            y, z = y[ok], z[ok]
            apart = np.bitwise_count(folded[at - lo] ^ folded[y - lo]).sum(1, dtype=np.int64)
            both = n[x] + n[z]
            for i in z[apart <= both - 2 * -(-num * both // (num + den))]:
                if label[i] != label[x]:
                    label[label == label[i]] = label[x]
    return label


class Trie:
    """Sorted sequences with shared beginnings; nodes hold runs of items."""

    __slots__ = ("run", "kids", "ends", "low", "high", "one", "same", "room")

    def __init__(self, run: np.ndarray, one: int, size: int, room: int):
        self.run, self.kids, self.ends, self.low, self.high, self.one, self.same, self.room = run, {}, [], size, size, one, True, room


def trie_links(sets: list[np.ndarray], num: int, den: int, groups: list[int] | None = None, rooms: list[int] | None = None) -> list[tuple[int, int]]:
    """Pairs of numbers of sets with den * intersection >= num * union that connect all such pairs (a pair inside
    what is connected already is left out). Sets of one group are connected from the start. Pairs may be
    left out unless each set's room is num times the other's size."""
    values, which, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, -counts))] = np.arange(len(values))
    ranks = np.split(rank[which], np.cumsum([len(s) for s in sets])[:-1])
    of: dict[int, int] = {}
    parent = [of.setdefault(g, i) for i, g in enumerate(groups or range(len(sets)))]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links: list[tuple[int, int]] = []
    top = Trie(np.empty(0, np.int64), -1, 0, 0)
    rooms = rooms or [NO_END] * len(sets)
    flag = np.zeros(len(values), bool)
    for x, seq in enumerate(ranks):
        seq = np.sort(seq)
        n, room = len(seq), rooms[x]
        flag[seq] = True
        stack = [(kid, 0, 0) for kid in top.kids.values()]
        while stack:
            node, depth, overlap = stack.pop()
            if node.room < num * n or room < num * node.low or (node.same and root(node.one) == root(x)):
                continue
            overlap += int(np.count_nonzero(flag[node.run]))
            depth += len(node.run)
            rest = n - int(np.searchsorted(seq, node.run[-1], "right"))
            s = min(max(depth + rest, node.low), node.high)
            if (num + den) * (overlap + min(rest, s - depth)) < num * (n + s):
                continue
            for y in node.ends:
                if root(x) != root(y) and (num + den) * overlap >= num * (n + depth):
                    parent[max(root(x), root(y))] = min(root(x), root(y))
                    links.append((x, y))
            stack += [(kid, depth, overlap) for kid in node.kids.values()]
        flag[seq] = False
        node, at = top, 0
        while True:
            if node is not top:
                node.low, node.high, node.room = min(node.low, n), max(node.high, n), max(node.room, room)
                node.same = node.same and root(node.one) == root(x)
            if at == n:
                node.ends.append(x)
                break
            kid = node.kids.get(int(seq[at]))
            if kid is None:
                kid = node.kids[int(seq[at])] = Trie(seq[at:], x, n, room)
                kid.ends.append(x)
                break
            m = min(len(kid.run), n - at)
            off = np.flatnonzero(kid.run[:m] != seq[at : at + m])
            cut = int(off[0]) if len(off) else m
            if cut < len(kid.run):
                lower = Trie(kid.run[cut:], kid.one, kid.low, kid.room)
                lower.kids, lower.ends, lower.high, lower.same = kid.kids, kid.ends, kid.high, kid.same
                kid.run, kid.kids, kid.ends = kid.run[:cut], {int(lower.run[0]): lower}, []
            at += cut
            node = kid
    return links


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that each node of edges (u, v) reaches. Large-star and small-star rounds, each a
    written table, until nothing changes; then every node's edge leads to its component."""
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    was = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).where("u <> v").distinct()
        edges = stored(small.withColumnsRenamed({"m": "v"}), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
        if now == was:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        was = now


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: components of links with intersection / union >= num / den.

    Sets are of distinct `size`-word shingles (words between white space, A-Z lower-cased); fewer words are one shingle of all. Texts that are
    null or have no word have an empty set and no links. component_id is the smallest doc_id that links reach, itself
    included (null if none there has an id); rows with the same doc_id are each a row. Other columns are left out.
    """
    members, of = grouped(docs, size, num, den)
    keys = members.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("own"))
    # a component's smallest node isn't among the nodes of components()
    of = of.union(of.select("component", "component")).distinct()
    least = of.join(keys, F.col("node") == F.col("key")).groupBy("component").agg(F.min("own").alias("least"))
    named = keys.join(of.join(least, "component").select("node", "least"), F.col("key") == F.col("node"), "left").select("key", F.coalesce("least", "own").alias("component_id"))
    return members.join(named, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def first_of_groups(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id (null comes last), and every row without a word. A row is known by its
    doc_id and text; of rows that are equal in both one stays."""
    members, of = grouped(docs, size, num, den)
    keys = members.where("n > 0").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first"), F.count("*").alias("rows"))
    keys = stored(keys.join(of, F.col("key") == F.col("node"), "left").select("key", "first", "rows", F.coalesce("component", "key").alias("c")), "keys")
    first = keys.groupBy("c").agg(F.min("first").alias("first"), F.sum("rows").alias("rows"))
    # rows that are alone in their component stay as they are; only the others are dealt, and what the filter lets through with them
    several = members.join(keys.join(first.where("rows > 1").select("c"), "c", "left_semi").select("key"), "key", "left_semi").select("h").distinct()
    rows = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).withColumn("_none", F.col("doc_id").cast("long").isNull()).withColumn("_h", F.xxhash64(F.col("text").cast("binary")))
    dealt = let_through(F.col("_h"), stored(several, "several"))
    word = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    first = first.select(F.coalesce("first.doc_id", F.lit(0)).alias("_id"), F.col("first.none").alias("_none"), F.col("first.h").alias("_h")).where(dealt)
    kept = rows.where(word & dealt).join(first, ["_id", "_none", "_h"], "left_semi")
    # by the columns of the join, so that texts are dealt once
    kept = kept.withColumn("_at", F.row_number().over(W.partitionBy("_id", "_none", "_h").orderBy("_h"))).where("_at = 1")
    return kept.unionByName(rows.where(~(word & dealt)).withColumn("_at", F.lit(1))).select(*[f"`{c}`" for c in docs.columns])


def let_through(key: Column, wanted: DataFrame) -> Column:
    """Whether key may be in wanted (one column, written): true for all that are. A Bloom filter of 8 MB at most."""
    words, blocks = bloom(wanted.toDF("key"), wanted.count())
    return may_hold(stored(words, "bloom").scalar(), key, blocks)


def grouped(docs: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, h (hash of the text), n and key (of the set) of every row; and node, component (set keys) of the sets that have links. Sets are known
    by their keys throughout, so ids may be null or repeated."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, words = np.zeros(1 << SKETCH_BITS, np.int64), np.zeros(1 << SKETCH_BITS, np.int64)
        schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("bits", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())])
        for batch in batches:
            n, keys, bits, waiting, held = [], [], [], [], 0
            for s in shingles(batch.column(1), size, words):
                n.append(len(s))
                keys.append(set_key(s))
                bits.append(parities(s).tobytes())
                waiting.append(counter(s).astype(np.int32))
                held += len(s)
                if held > 1 << 18:
                    counts += np.bincount(np.concatenate(waiting), minlength=len(counts))
                    waiting, held = [], 0
            if waiting:
                counts += np.bincount(np.concatenate(waiting), minlength=len(counts))
            none = pa.nulls(len(n), pa.int32())
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(bits, pa.binary()), none, pa.nulls(len(n), pa.binary())], schema=schema)
        each = np.concatenate([counts, words]).reshape(2 * SKETCH_ROWS, -1)
        none = pa.nulls(len(each), pa.int64())
        yield pa.record_batch([none, none, none, none, pa.nulls(len(each), pa.binary()), pa.array(range(len(each)), pa.int32()), pa.array([r.tobytes() for r in each], pa.binary())], schema=schema)

    first = stored(docs.mapInArrow(scan, "doc_id long, h long, n long, key long, bits binary, part int, counts binary"), "sets")
    members = first.where("part is null").select("doc_id", "h", "n", "key")
    # where each set's text is found: one of its rows, of the largest doc_id, so that null is taken only where there is no other
    reps = members.where("n > 0").groupBy("key").agg(F.max(F.struct("doc_id", "h")).alias("rep")).select("key", F.col("rep.doc_id").alias("rep"), F.col("rep.h").alias("rep_h"))
    # a row of every set, the bits of it taken from any of its copies
    held = stored(first.where("part is null and n > 0").groupBy("key").agg(F.first("n").alias("n"), F.first("bits").alias("bits")), "bits")

    def total(table: pa.Table) -> pa.Table:
        counts = sum(np.frombuffer(c, np.int64) for c in table.column("counts").to_pylist())
        return pa.table({"part": table.column("part")[:1], "counts": pa.array([counts.tobytes()], pa.binary())})

    # fixed size: 2 * SKETCH_ROWS rows of 32 KB, whatever the input; summed in two steps
    sketch = first.where("part is not null").select("part", "counts", F.pmod(F.xxhash64("counts"), F.lit(32)).alias("salt"))
    sketch = sketch.groupBy("part", "salt").applyInArrow(total, "part int, counts binary").groupBy("part").applyInArrow(total, "part int, counts binary")
    counts = np.concatenate([np.frombuffer(r.counts, np.int64) for r in sorted(stored(sketch, "sketch").collect(), key=lambda r: r.part)] or [np.zeros(2 << SKETCH_BITS, np.int64)])
    of_shingles, of_words = np.split(counts, 2)
    classes = spark.sparkContext.broadcast((frequent(of_shingles, 1), frequent(of_words, LEVEL_STEPS)))

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (kind, levels), seen = classes.value, set()

        def rows(out: list[np.ndarray], keys: list[int], sizes: list[int]) -> pa.RecordBatch:
            lengths = [len(x) for x in out]
            size_of = np.repeat(np.array(sizes, np.int64), lengths)
            room = den * size_of - (num + den) * np.concatenate([np.arange(p) for p in lengths])
            return pa.record_batch([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), lengths)), pa.array(size_of), pa.array(room)], names=["token", "key", "n", "room"])

        for batch in batches:
            out, keys, sizes, held = [], [], [], 0
            for s, level in leveled_shingles(batch.column(0), size, levels):
                key = set_key(s)
                if not len(s) or key in seen:
                    continue
                seen.add(key)
                order = (kind[counter(s)].astype(np.int64) * (MOST_LEVEL + 1) + level).astype(np.uint16)
                out.append(s[np.argsort(order, kind="stable")[: prefix_length(len(s), num, den)]])
                keys.append(key)
                sizes.append(len(s))
                held += len(out[-1])
                if held > 1 << 16:
                    # a batch of texts may have a million rows
                    yield rows(out, keys, sizes)
                    out, keys, sizes, held = [], [], [], 0
            if out:
                yield rows(out, keys, sizes)

    # room: of sets of n and m shingles within the bound, the first one that both have is early enough in each, room >= num * m and num * n
    w, by_size = W.partitionBy("token"), W.partitionBy("token").orderBy("n", "key")
    met = docs.select("text").mapInArrow(signatures, "token long, key long, n long, room long")
    # each set once at a shingle, if another one there is of a size within the bound: then the next smaller or larger one is
    met = met.withColumn("other", F.lag("key").over(by_size)).where("other is null or other <> key")
    near = (F.lag("n").over(by_size) * den >= F.col("n") * num) | (F.col("n") * den >= F.lead("n").over(by_size) * num)
    met = stored(met.withColumn("near", near).where("near").select("token", "key", "n", "room"), "met")

    def verified(to: DataFrame) -> DataFrame:
        """Links (u, v: set keys) that connect what stands in the same block. to: key, head and sub (the block), first (goes to the trie
        first), group (what it is connected with) and room (null where it doesn't count)."""
        to = to.groupBy("key").agg(F.collect_list(F.struct("head", "sub", "first", "group", "room")).alias("to")).join(reps, "key")
        to = stored(to, "sent")
        wanted = docs.where(let_through(F.col("h"), to.select("rep_h")))
        texts = wanted.join(to, wanted.doc_id.eqNullSafe(to.rep) & (wanted.h == to.rep_h)).select("key", "to", "text")

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in batches:
                rows: list[tuple] = []
                held = 0
                for key, to, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingles(batch.column(2), size), strict=True):
                    if key in seen or set_key(s) != key:
                        continue  # a repeated row
                    seen.add(key)
                    data = s.tobytes()
                    for t in to:
                        rows.append((t["head"], t["sub"], not t["first"], t["group"], t["room"], key, data))
                        held += len(data)
                        if held > 8 << 20:
                            yield sent(rows)
                            rows, held = [], 0
                if rows:
                    yield sent(rows)

        def sent(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["head", "sub", "later", "group", "room", "key", "data"])

        def join(table: pa.Table) -> pa.Table:
            table = table.sort_by([("later", "ascending"), ("key", "ascending")])
            keys = table.column("key").to_numpy()
            # a repeated row that came by way of several tasks counts once
            table = table.take(pa.array(np.sort(np.unique(keys, return_index=True)[1])))
            keys = table.column("key").to_pylist()
            links = trie_links([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("data")], num, den, table.column("group").to_pylist(), table.column("room").fill_null(NO_END).to_pylist()) if len(keys) > 1 else []
            return pa.table({"u": pa.array([keys[a] for a, _ in links], pa.int64()), "v": pa.array([keys[b] for _, b in links], pa.int64())})

        rows = texts.mapInArrow(send, "head long, sub int, later boolean, group long, room long, key long, data binary")
        return rows.groupBy("head", "sub").applyInArrow(join, "u long, v long")

    def enough(shared: Column, n: Column, m: Column) -> Column:
        """Whether sets of n and m shingles that share so many of their first ones may be within the bound. All that they share up to the
        earlier end of the two beginnings is counted; after it there is no more than the rest of that set."""
        most = F.greatest(n, m)
        needed = F.ceil((n + m) * num / F.lit(num + den))
        return (F.least(n, m) * den >= most * num) & (shared + F.ceil(most * num / F.lit(den)) - 1 >= needed)

    def enough_in(shared: Column, n: Column, low: Column, high: Column) -> Column:
        """Whether enough() may hold for a size from low to high. Up to n, the smallest size needs least. Above n the ceilings go up and down, but
        ceil(a) - ceil(b) is ceil(a - b) at most, and a - b grows with the size; ceil(a - b) > -shared is compared in whole numbers."""
        above = num * (high * num - n * den) + shared * (den * (num + den)) > 0
        return enough(shared, n, low) | ((low < high) & (high > n) & above)

    def led(pairs: DataFrame) -> DataFrame:
        """Blocks of pairs (key, head): each head with its keys; a large one is dealt to several blocks, each with the head."""
        wide = W.partitionBy("head")
        pairs = pairs.withColumn("sub", F.pmod(F.xxhash64("key"), F.ceil(F.count("*").over(wide) / MOST_IN_BLOCK)).cast("int"))
        rows = pairs.select("key", "head", "sub", F.lit(False).alias("first")).union(pairs.select("head", "head", "sub", F.lit(True)).distinct())
        return rows.withColumn("group", F.col("key")).withColumn("room", F.lit(None).cast("long"))

    def possible(pairs: DataFrame) -> DataFrame:
        """Those of pairs (key, head) whose bits don't rule them out."""
        one = held.select("key", F.col("n").alias("n1"), F.col("bits").alias("bits1"))
        two = held.select(F.col("key").alias("head"), F.col("n").alias("n2"), F.col("bits").alias("bits2"))

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, a, m, b = (batch.column(i).to_pylist() for i in (2, 3, 4, 5))
                ok = [apart_by(np.frombuffer(u, np.uint8), np.frombuffer(v, np.uint8)) <= x + y - 2 * -(-num * (x + y) // (num + den)) for x, u, y, v in zip(n, a, m, b, strict=True)]
                yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

        return pairs.join(one, "key").join(two, "head").select("key", "head", "n1", "bits1", "n2", "bits2").mapInArrow(test, "key long, head long")

    # first rounds: each set with the leaders that it shares most with, of those it isn't connected with; they join most groups at little cost
    of = spark.createDataFrame([], "node long, component long")
    links = None
    for k in range(ROUNDS):
        one = met.join(of, F.col("key") == F.col("node"), "left").select("token", "key", "n", F.coalesce("component", "key").alias("c")) if k else met.withColumn("c", F.col("key"))
        one = one.withColumn("lead", F.min(F.struct(F.xxhash64("key", F.lit(k)).alias("h"), "key", "n", "c")).over(w)).where("c <> lead.c")
        near = F.least("n", "lead.n") * den >= F.greatest("n", "lead.n") * num
        pairs = one.where(near).groupBy("key", F.col("lead.key").alias("head")).agg(F.countDistinct("token").alias("shared"))
        pairs = pairs.withColumn("at", F.row_number().over(W.partitionBy("key").orderBy(F.desc("shared"), "head"))).where(f"at <= {LEADERS}")
        pairs = stored(possible(pairs.select("key", "head")), "pairs")
        more = stored(verified(led(pairs)), "links")
        links = links.union(more) if k else more
        of = components(links)

    # last round: sets that met and aren't connected. A set of one component goes to the block of another, of a smaller number, if it may be
    # within the bound of any set there; so a large group takes part once, not by its pairs
    one = met.join(of, F.col("key") == F.col("node"), "left").select("token", "key", "n", "room", F.coalesce("component", "key").alias("c"))
    met_by = one.groupBy("token", "c").count().groupBy("token").agg(F.count("*").alias("ways"), F.sum("count").alias("sets")).where("ways > 1")
    one = stored(one.join(met_by, "token").distinct(), "apart")
    # a pair within the bound whose first shared shingle is a common one is found there, any other by the join of the rest
    common, rest = one.where(F.col("ways") > FEW_COMPONENTS), one.where(F.col("ways") <= FEW_COMPONENTS)
    one = rest.join(common.groupBy("key").agg(F.count("*").alias("others")), "key", "left").fillna(0, "others")
    groups = one.groupBy("token", "c").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("room").alias("room"))
    a, b = one.alias("a"), groups.alias("b")
    # of components with a set of a size within the bound
    sizes = (F.col("b.most") * den >= F.col("a.n") * num) & (F.col("a.n") * den >= F.col("b.least") * num)
    to = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.c") > F.col("b.c")) & sizes)
    early = (F.col("b.room") >= F.col("a.n") * num) & (F.col("a.room") * den >= F.greatest(F.col("b.least") * den, F.col("a.n") * num) * num)
    # common shingles aren't counted here; no more are shared than the set has
    shared = (F.count("*") + F.first("a.others")).alias("shared")
    to = to.groupBy(F.col("a.key").alias("key"), F.col("b.c").alias("head")).agg(shared, F.first("a.n").alias("n"), F.first("a.c").alias("group"), F.min("b.least").alias("least"), F.max("b.most").alias("most"), F.bool_or(early).alias("early"))
    low, high = F.greatest("least", F.ceil(F.col("n") * num / F.lit(den))), F.least("most", F.floor(F.col("n") * den / F.lit(num)))
    # each step is written, since the next ones read it several times
    to = stored(to.where(F.col("early") & (low <= high) & enough_in(F.col("shared"), F.col("n"), low, high)).select("key", "head", "group"), "candidates")
    # of the sets that are their own component, the bits tell more
    inside = stored(one.select("key", F.col("c").alias("head")).distinct(), "inside")
    inside = inside.join(inside.groupBy("head").agg(F.count("*").alias("size")), "head").select("key", "head", "size")
    single = inside.where("size = 1").select(F.col("key").alias("only"), "head")
    to = to.join(single, "head", "left")
    ruled = stored(possible(to.where("only is not null").select("key", F.col("only").alias("head"))), "ruled").withColumnRenamed("head", "only").join(single, "only").select("key", "head")
    to = stored(to.where("only is null").select("key", "head", "group").union(to.where("only is not null").select("key", "head", "group").join(ruled, ["key", "head"], "left_semi")), "to")
    # a block is a share of the component's sets with a share of its guests
    subs = inside.select("head", F.ceil(F.col("size") / MOST_IN_BLOCK).cast("int").alias("subs")).distinct()
    blocks = to.groupBy("head").agg(F.ceil(F.count("*") / MOST_IN_BLOCK).cast("int").alias("parts")).join(subs, "head")
    place = (F.col("sub") * F.col("parts") + F.col("part")).cast("int").alias("sub")

    def share(of_what: str) -> Column:
        return F.pmod(F.xxhash64("key"), F.col(of_what)).cast("int")

    def every(of_what: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(of_what) - 1))

    own = inside.join(blocks, "head").select("key", "head", "parts", share("subs").alias("sub"), every("parts").alias("part"))
    guests = to.join(blocks, "head").select("key", "head", "group", "parts", every("subs").alias("sub"), share("parts").alias("part"))
    any_room = F.lit(None).cast("long").alias("room")
    own = own.select("key", "head", place, F.lit(True).alias("first"), F.col("head").alias("group"), any_room)
    guests = guests.select("key", "head", place, F.lit(False).alias("first"), "group", any_room)
    # at a common shingle a block is two shares of its sets, or all of them, each by its bits
    dealt = common.join(held.select("key", "bits"), "key").withColumn("parts", F.ceil(F.col("sets") / MOST_IN_BLOCK).cast("int"))
    dealt = dealt.select("*", share("parts").alias("sub"), every("parts").alias("part")).where("parts = 1 or sub <> part")
    dealt = dealt.withColumn("sub", (F.least("sub", "part") * F.col("parts") + F.greatest("sub", "part")).cast("int"))

    def met_closely(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        key, c, n, room = (table.column(x).to_numpy() for x in ("key", "c", "n", "room"))
        label = possible_groups(n, c, room, [np.frombuffer(b.as_buffer(), np.uint8) for b in table.column("bits")], num, den)
        head = np.zeros(len(key), np.int64)
        several = np.flatnonzero(np.bincount(label, minlength=len(key))[label] > 1)
        for x in np.unique(label[several]):
            # the same sets that meet at several shingles are one block
            head[label == x] = xxhash.xxh3_64_intdigest(key[label == x].tobytes()) - (1 << 63)
        return pa.table({"key": key[several], "head": head[several], "group": c[several]})

    close = dealt.select("token", "sub", "key", "c", "n", "room", "bits").groupBy("token", "sub").applyInArrow(met_closely, "key long, head long, group long").distinct()
    # a number below 0 keeps these blocks apart from the others
    close = close.select("key", "head", F.lit(-1).alias("sub"), F.lit(True).alias("first"), "group", any_room)
    every_block = stored(own.union(guests).union(close), "blocks")
    if not every_block.isEmpty():
        of = components(links.union(stored(verified(every_block), "links")))

    return members, of
