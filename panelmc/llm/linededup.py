"""Line dedup (operator 6): sharded cuckoo filters over exact reference-count tables.

The exact tables hold a row for each (line key, document), and for each key that documents share its count of them and its keeper. The filters, a file a shard in the
shared folder, hold a fingerprint for each shared key. insert() and delete() bring the documents' keys to the tables, and the keys that became or ceased to be shared to their
shards' filters, in tasks, shard by shard; so a line that only one document is left with is kept again. A scan brings its keys to the shards, and what a filter lets
through goes to the exact join.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmc.llm.shared import WHITE, mixed, opened, shared_dir, stored

SLOTS = 4
KICKS = 500
#: Keys that one filter of a shard is made for. A shard has as many filters as it needs; past four each, on average, keys are dealt to more shards.
KEYS_PER_SHARD = 100_000
#: Rows of one shard that go to one task; and documents of one line from which on its row is sent to the lines, not the lines to it.
SHARD_ROWS = 4 << 20
HOT_ROWS = 1 << 20


#: How far apart a fingerprint's two buckets are, before the mask.
SPREAD = mixed(np.arange(65536, dtype=np.uint64)).tolist()


class Cuckoo:
    """Cuckoo filter of 64-bit key hashes: 16-bit fingerprints, four to a bucket, each key in one of two buckets."""

    def __init__(self, capacity: int, cells: np.ndarray | None = None):
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * 0.85)))))
        self.cells = np.zeros((buckets, SLOTS), np.uint16) if cells is None else cells
        self.mask = len(self.cells) - 1

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        print_ = ((hashes >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint64)
        one = hashes & np.uint64(self.mask)
        return print_.astype(np.uint16), one.astype(np.int64), ((one ^ mixed(print_)) & np.uint64(self.mask)).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        print_, one, two = self.places(hashes)
        return (self.cells[one] == print_[:, None]).any(1) | (self.cells[two] == print_[:, None]).any(1)

    def insert(self, h: int) -> bool:
        """False, with nothing changed, if no slot is found."""
        print_, one, two = (int(x[0]) for x in self.places(np.array([h], np.uint64)))
        for b in (one, two):
            if (at := self.free(b)) is not None:
                self.cells[b, at] = print_
                return True
        b, moved = one, []
        for k in range(KICKS):
            s = (k + print_) % SLOTS
            moved.append((b, s, int(self.cells[b, s])))
            self.cells[b, s], print_ = print_, moved[-1][2]
            b ^= SPREAD[print_] & self.mask
            if (at := self.free(b)) is not None:
                self.cells[b, at] = print_
                return True
        for b, s, old in reversed(moved):
            self.cells[b, s] = old
        return False

    def free(self, bucket: int) -> int | None:
        row = self.cells[bucket].tolist()
        return row.index(0) if 0 in row else None

    def insert_all(self, hashes: np.ndarray) -> np.ndarray:
        """Those that found no slot. Free slots are filled at once, only the rest moves others, until one finds no slot: the filter then is full."""
        print_, one, two = self.places(hashes)
        left = np.arange(len(hashes))
        for bucket in (one, two):
            left = left[np.argsort(bucket[left], kind="stable")]
            b = bucket[left]
            at = np.arange(len(b))
            rank = at - np.maximum.accumulate(np.where(np.append(True, b[1:] != b[:-1])[: len(b)], at, 0))
            free = self.cells[b] == 0
            ok = rank < free.sum(1)
            slot = np.argsort(~free[ok], axis=1, kind="stable")[np.arange(ok.sum()), rank[ok]]
            self.cells[b[ok], slot] = print_[left[ok]]
            left = left[~ok]
        for i, h in enumerate(hashes[left].tolist()):
            if not self.insert(h):
                return hashes[left[i:]]
        return np.empty(0, np.uint64)

    def delete(self, h: int) -> bool:
        print_, one, two = (int(x[0]) for x in self.places(np.array([h], np.uint64)))
        for b in (one, two):
            held = np.flatnonzero(self.cells[b] == print_)
            if len(held):
                self.cells[b, held[0]] = 0
                return True
        return False

    def delete_all(self, hashes: np.ndarray) -> np.ndarray:
        """Those that weren't found."""
        print_, one, two = self.places(hashes)
        left = np.arange(len(hashes))
        for bucket in (one, two):
            while len(left):
                same = self.cells[bucket[left]] == print_[left][:, None]
                # keys of one bucket and fingerprint take one slot each, in turn
                _, first = np.unique(np.where(same.any(1), bucket[left] * SLOTS + same.argmax(1), -1 - left), return_index=True)
                first = first[same[first].any(1)]
                if not len(first):
                    break
                self.cells[bucket[left[first]], same[first].argmax(1)] = 0
                left = np.delete(left, first)
        return hashes[left]

    @classmethod
    def of(cls, hashes: np.ndarray) -> Cuckoo:
        capacity = len(hashes)
        while True:
            out = cls(capacity)
            if not len(out.insert_all(hashes)):
                return out
            capacity = 2 * SLOTS * len(out.cells)


class Shard:
    """Filters of one shard, all of one size, so that a fingerprint means the same keys in each and may be deleted from any."""

    def __init__(self, data: bytes = b"", capacity: int | None = None):
        empty = Cuckoo(capacity or KEYS_PER_SHARD)
        self.capacity = capacity or KEYS_PER_SHARD
        self.nets = [Cuckoo(0, c) for c in np.frombuffer(data, np.uint16).reshape(-1, *empty.cells.shape).copy()]

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        return reduce(np.logical_or, (n.contains(hashes) for n in self.nets), np.zeros(len(hashes), bool))

    def insert(self, hashes: np.ndarray) -> None:
        for net in self.nets:
            hashes = net.insert_all(hashes)
        while len(hashes):
            self.nets.append(Cuckoo(self.capacity))
            hashes = self.nets[-1].insert_all(hashes)

    def delete(self, hashes: np.ndarray) -> None:
        for net in self.nets:
            hashes = net.delete_all(hashes)

    def data(self) -> bytes:
        return b"".join(n.cells.tobytes() for n in self.nets if n.cells.any())


def line_key(line: bytes) -> bytes:
    return line.strip(WHITE).lower()


def is_long(key: bytes, least: int) -> bool:
    return len(key) >= 4 * least or len(key) >= least and len(key.decode("utf-8", "replace")) >= least


def hashed(key: bytes) -> tuple[int, int]:
    """128 bits of a key as two signed longs."""
    x = xxhash.xxh3_128_intdigest(key)
    return (x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63)


KEY = ["k1", "k2"]


@dataclass
class LineIndex:
    """refs: exact rows (k1, k2, doc_id), one for each line key and document that has it. shared: exact reference counts of the keys that two documents or more have
    (k1, k2, n, keeper: the smallest doc_id). filters: the files (shard, path) that hold the fingerprints of these keys. Each state is a set of written tables and
    files that later ones leave as they are. Rows without a doc_id take no part."""

    refs: DataFrame
    shared: DataFrame
    filters: DataFrame
    shards: int = 0
    least: int = 10

    @classmethod
    def empty(cls, spark: SparkSession, least: int = 10) -> LineIndex:
        tables = ("k1 long, k2 long, doc_id long", "k1 long, k2 long, n long, keeper long", "shard int, path string")
        return cls(*(spark.createDataFrame([], t) for t in tables), 0, least)

    def insert(self, docs: DataFrame) -> LineIndex:
        """With the lines of docs (doc_id, text). A doc_id that is there already only gains keys that it lacks."""
        if not self.shards:
            return self.changed(stored(self.refs.unionByName(keyed(docs, self.least)).distinct(), "refs"), None)
        new = stored(keyed(docs, self.least).distinct(), "new")
        return self.changed(stored(self.refs.unionByName(new).distinct(), "refs"), new.select(*KEY).distinct())

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Without the references of these documents (column doc_id)."""
        ids = stored(doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "gone")
        touched = self.refs.join(ids, "doc_id", "left_semi").select(*KEY).distinct()
        return self.changed(stored(self.refs.join(ids, "doc_id", "left_anti").select(*KEY, "doc_id"), "refs"), stored(touched, "touched"))

    def changed(self, refs: DataFrame, touched: DataFrame | None) -> LineIndex:
        """The index of other refs, which differ in the touched keys (None: any)."""
        def counts(rows: DataFrame) -> DataFrame:
            return rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("doc_id").alias("keeper")).where("n > 1")

        if touched is None:
            shared = stored(counts(refs), "shared")
        else:
            now = stored(counts(refs.join(touched, KEY, "left_semi")), "now")
            shared = stored(self.shared.join(touched, KEY, "left_anti").unionByName(now), "shared")
        n = shared.count()
        if touched is None or n > 4 * self.shards * KEYS_PER_SHARD:
            shards = max(1, -(-n // KEYS_PER_SHARD))
            return LineIndex(refs, shared, filtered(None, shared.select(*KEY, F.lit(True).alias("come")), shards), shards, self.least)
        was = self.shared.join(touched, KEY, "left_semi").select(*KEY)
        come = now.select(*KEY).join(was, KEY, "left_anti").select(*KEY, F.lit(True).alias("come"))
        gone = was.join(now, KEY, "left_anti").select(*KEY, F.lit(False).alias("come"))
        return LineIndex(refs, shared, filtered(self.filters, come.union(gone), self.shards), self.shards, self.least)

    def counts(self) -> DataFrame:
        """Exact reference counts of all keys: k1, k2, n_docs, keeper (the smallest doc_id)."""
        return self.refs.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("keeper"))

    def hits(self, lines: DataFrame) -> DataFrame:
        """Those of lines (k1, k2, doc_id) whose keys the filters may hold: all whose keys are shared, and few others. Lines and filters meet by shard, the filter first, in
        sorted partitions that stream by; a shard of many lines (of one that is everywhere) is dealt to several tasks, each with its filter."""
        shard = F.pmod("k2", F.lit(self.shards)).cast("int")
        # at most a row for SHARD_ROWS lines
        full = {r.shard: -(-r["count"] // SHARD_ROWS) for r in lines.groupBy(shard.alias("shard")).count().where(f"count > {SHARD_ROWS}").collect()}
        tasks = F.coalesce(F.create_map(*[F.lit(x) for kv in full.items() for x in kv])[F.col("shard")], F.lit(1)) if full else F.lit(1)
        rows = lines.select(shard.alias("shard"), *KEY, "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id"), tasks).cast("int")).withColumn("path", F.lit(None).cast("string"))
        nets = self.filters.select("shard", *[F.lit(None).cast("long").alias(c) for c in (*KEY, "doc_id")], F.explode(F.sequence(F.lit(0), tasks.cast("int") - 1)).alias("part"), "path")
        both = rows.union(nets.select(*rows.columns)).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("path").isNull())

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, net = None, None
            for batch in batches:
                shards, paths = batch.column(0).to_numpy(), batch.column(4)
                held = np.flatnonzero(paths.is_valid().to_numpy(zero_copy_only=False)).tolist()
                cuts = np.flatnonzero(np.diff(shards, prepend=-1)).tolist()
                keys = batch.column(1).fill_null(0).to_numpy().view(np.uint64)
                hit = np.zeros(len(batch), bool)
                edges = sorted({*held, *cuts, 0})
                for a, b in zip(edges, [*edges[1:], len(batch)], strict=True):
                    s = int(shards[a])
                    if paths[a].is_valid and (s, paths[a].as_py()) != at:
                        at = (s, paths[a].as_py())
                        with opened(at[1], "r") as f:
                            net = Shard(f.read())
                    if at and at[0] == s:
                        hit[a:b] = net.contains(keys[a:b])
                hit[held] = False
                yield batch.select([1, 2, 3]).filter(pa.array(hit))

        return both.select("shard", *KEY, "doc_id", "path").mapInArrow(probe, "k1 long, k2 long, doc_id long")


def keyed(docs: DataFrame, least: int) -> DataFrame:
    """Distinct keys of each row's lines: k1, k2, doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, one, two = [], [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = {k for k in map(line_key, (text or b"").split(b"\n")) if is_long(k, least)}
                for a, b in map(hashed, keys):
                    names.append(d)
                    one.append(a)
                    two.append(b)
            yield pa.record_batch([pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(names, pa.int64())], names=["k1", "k2", "doc_id"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where("doc_id is not null")
    return rows.mapInArrow(run, "k1 long, k2 long, doc_id long")


def filtered(filters: DataFrame | None, changes: DataFrame, shards: int) -> DataFrame:
    """Files (shard, path) with the filters that hold changes (k1, k2, come: whether the key comes or goes), beside what filters hold already. Shards without a
    change keep their files. A task's file has its attempt's number in its name, so only what a finished attempt reports is read."""
    folder = f"{shared_dir(changes.sparkSession)}/filters-{uuid.uuid4().hex}"
    none = F.lit(None)
    rows = changes.select(F.pmod("k2", F.lit(shards)).cast("int").alias("shard"), F.when(F.col("come"), 2).otherwise(1).alias("kind"), "k1", none.cast("string").alias("path"))
    if filters is not None:
        rows = filters.select("shard", F.lit(0).alias("kind"), none.cast("long").alias("k1"), "path").union(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        at, net, path, same = None, Shard(), None, True

        def done() -> pa.RecordBatch:
            to = path
            if not same:
                to = f"{folder}/{at}-{attempt}"
                with opened(to, "w") as f:
                    f.write(net.data())
            return pa.record_batch([pa.array([at], pa.int32()), pa.array([to], pa.string())], names=["shard", "path"])

        for batch in batches:
            shard, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keys = batch.column(2).fill_null(0).to_numpy().view(np.uint64)
            edges = [*np.flatnonzero((np.diff(shard, prepend=-1) != 0) | (np.diff(kind, prepend=-1) != 0)).tolist(), len(batch)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if shard[a] != at:
                    if at is not None:
                        yield done()
                    at, net, path, same = int(shard[a]), Shard(), None, True
                if kind[a] == 0:
                    path = batch.column(3)[a].as_py()
                    with opened(path, "r") as f:
                        net = Shard(f.read())
                else:
                    same = False
                    (net.insert if kind[a] == 2 else net.delete)(keys[a:b])
        if at is not None:
            yield done()

    return stored(rows.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(run, "shard int, path string"), "filters")


def drop_repeated_lines(docs: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """docs with `text` without the lines that another document keeps, and n_lines, n_dropped.

    A key is the line without white space at both ends, A-Z lower-cased; keys of at least index.least code points that two
    or more documents of the index hold lose all their lines but in the keeper, the smallest doc_id, which keeps all of its own.
    Null and empty texts are one empty line (text stays null or empty), other columns stay as they are, whatever their names. Without an index
    the documents themselves are it. doc_ids are whole numbers; rows with the same one count as one document, rows without one keep all lines.
    An empty table gives none.
    """
    own = index is None
    index = index or LineIndex.empty(docs.sparkSession).insert(docs)
    least, shared = index.least, index.shared
    hits = stored(index.hits(index.refs if own else keyed(docs, least)), "hits")
    # at most a row for HOT_ROWS references
    hot = F.broadcast(shared.where(f"n > {HOT_ROWS}").select(*KEY, "keeper"))
    found = hits.join(hot, KEY).unionByName(hits.join(hot.select(*KEY), KEY, "left_anti").join(shared.select(*KEY, "keeper"), KEY))
    away = found.where("doc_id <> keeper").groupBy(F.col("doc_id").alias("_of")).agg(F.collect_set(F.struct(*KEY)).alias("_away"))

    columns = [f for f in docs.schema.fields if f.name not in ("n_lines", "n_dropped")]
    # columns go by number to the join and back, so that theirs can't clash with its own
    numbered = docs.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(columns)], F.col("doc_id").cast("long").alias("_id"))
    at = [f.name for f in columns].index("text")
    joined = numbered.join(away, F.col("_id") == F.col("_of"), "left").select(*[f"c{i}" for i in range(len(columns))], "_away")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = batch.column(len(columns))
            texts, lines, dropped = batch.column(at).cast(pa.binary()).to_pylist(), [], []
            bad = away.values.flatten() if len(away.values) else [pa.array([], pa.int64())] * 2
            one, two, edges = bad[0].to_numpy(zero_copy_only=False), bad[1].to_numpy(zero_copy_only=False), away.offsets.to_numpy()
            for i, text in enumerate(texts):
                own = (text or b"").split(b"\n")
                lines.append(len(own))
                if away[i].is_valid:
                    a, b = edges[i], edges[i + 1]
                    gone = set(zip(one[a:b].tolist(), two[a:b].tolist(), strict=True))
                    kept = [x for x in own if not (is_long(k := line_key(x), least) and hashed(k) in gone)]
                    texts[i] = b"\n".join(kept)
                    dropped.append(len(own) - len(kept))
                else:
                    dropped.append(0)
            cols = [pa.array(texts, pa.binary()).cast(batch.schema.field(at).type) if k == at else batch.column(k) for k in range(len(columns))]
            yield pa.record_batch([*cols, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[*[f.name for f in columns], "n_lines", "n_dropped"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns) + ", n_lines long, n_dropped long"
    return joined.mapInArrow(cut, schema)
