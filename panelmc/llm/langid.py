"""Language ID (operator 9): prediction by partial matching over bytes.

Each language has a variable-order context tree over bytes (A-Z as a-z): contexts of up to ORDER bytes, those that training saw most, with escapes
to the next shorter context and at last to a uniform choice. Tasks count the bytes after each context, Spark adds the counts up, and the trees are frozen into
tables, so that a text's exact code length under each language is a sum of look-ups; the shortest wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmc.llm.shared import LOWER, flat, parts, stored

#: Bytes of the longest contexts. A context and the byte after it are packed into one long, so seven at most.
ORDER = 4
#: Contexts of two bytes and more that have a node, over all languages: those with the largest share of the training positions.
MOST_NODES = 6000
#: The fit is on a bounded sample: so many distinct texts of a language, about, and so many bytes of all languages together (one text of each at least).
FIT_ROWS = 3000
FIT_BYTES = 8 << 20
#: A text whose contexts cost more bits than this beyond its bytes' shares alone is in none of the languages.
UNFIT_BITS = 128
#: What stands before a text's first byte, and the number of bytes that lower-casing leaves.
BEFORE, SYMBOLS = 10, 230


@dataclass
class Trees:
    """Frozen statistics. symbol: a byte's number; 0 is all bytes that no language's training had, which are equally likely in any context.
    child[node, symbol]: the node whose context has that symbol in front (0: none). Node 0 is the empty context.
    cost[node, symbol]: bits of a byte after that context, for each language; plain[symbol]: bits without any context, over all languages."""

    languages: list[str]
    symbol: np.ndarray
    child: np.ndarray
    cost: np.ndarray
    plain: np.ndarray

    def bits(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Code lengths in bits of each text of an Arrow column, under each language; and under the bytes' shares alone."""
        data, offsets = flat(column)
        out, plain = np.zeros((len(offsets) - 1, len(self.languages))), np.zeros(len(offsets) - 1)
        children, costs = self.child.reshape(-1), self.cost.reshape(-1, len(self.languages))
        n = self.child.shape[1]
        for a, b in parts(offsets, 1 << 19):
            lo, at = offsets[a], offsets[a : b + 1] - offsets[a]
            size = np.diff(at)
            # ORDER symbols of what stands before go in front of each text
            start = at[:-1] + ORDER * np.arange(1, b - a + 1)
            s = np.full(int(at[-1]) + ORDER * (b - a), self.symbol[BEFORE], np.int32)
            place = np.arange(int(at[-1])) + np.repeat(start - at[:-1], size)
            s[place] = self.symbol[data[lo : offsets[b]]]
            if not len(place):
                continue
            node = children[s[place - 1]]
            live = np.flatnonzero(node)
            for k in range(2, ORDER + 1):
                deeper = children[node[live] * n + s[place[live] - k]]
                more = np.flatnonzero(deeper)
                live = live[more]
                node[live] = deeper[more]
            own = s[place]
            total = np.zeros((len(place) + 1, len(self.languages)))
            np.cumsum(costs[node * n + own], axis=0, dtype=np.float64, out=total[1:])
            out[a:b] = total[at[1:]] - total[at[:-1]]
            total = np.append(0.0, np.cumsum(self.plain[own], dtype=np.float64))
            plain[a:b] = total[at[1:]] - total[at[:-1]]
        return out, plain


def grams(texts: list[bytes]) -> np.ndarray:
    """Each byte of the texts with the ORDER bytes before it, packed: the byte is the lowest eight bits, the one before it the next."""
    if not any(texts):
        return np.empty(0, np.int64)
    pad = bytes([BEFORE]) * ORDER
    joined = LOWER[np.frombuffer(b"".join(x for t in texts for x in (pad, t)), np.uint8)].astype(np.int64)
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes + ORDER) - sizes
    at = np.arange(int(sizes.sum())) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
    return sum(joined[at - k] << (8 * k) for k in range(ORDER + 1))


def fit(rows: DataFrame) -> Trees:
    """Trees of rows (text, lang); rows without either are left out. Learns from about FIT_ROWS distinct texts of each language, picked by a hash
    of text and language, whole, in hash order until a language's share of FIT_BYTES is reached. Repeated rows count once."""
    rows = rows.where("text is not null and lang is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("binary").alias("text"), F.xxhash64("text", "lang").alias("h"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return frozen([], [])
    languages = sorted(counts)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int((1 << 31) * min(1.0, FIT_ROWS / max(1, n))))])
    picked = rows.where(F.pmod("h", F.lit(1 << 31)) < share[F.col("lang")]).groupBy("lang", "h").agg(F.first("text").alias("text"))
    # about FIT_ROWS rows of a language
    own = Window.partitionBy("lang").orderBy("h")
    picked = stored(picked.withColumn("size", F.length("text")), "texts")
    fits = picked.select("lang", "h", "size").withColumns({"upto": F.sum("size").over(own), "at": F.row_number().over(own)}).where(f"upto <= {FIT_BYTES // len(languages)} or at = 1")
    number = F.create_map(*[F.lit(x) for i, k in enumerate(languages) for x in (k, i)])
    sample = picked.join(F.broadcast(fits.select("lang", "h")), ["lang", "h"], "left_semi").select(number[F.col("lang")].alias("lang"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(0).to_numpy()
            texts = batch.column(1).to_pylist()
            for k in np.unique(lang).tolist():
                own, waiting = [], 0
                for t in [texts[i] for i in np.flatnonzero(lang == k)] + [None]:
                    if t is not None:
                        own.append(t)
                        waiting += len(t)
                    if own and (t is None or waiting > 1 << 20):
                        g, n = np.unique(grams(own), return_counts=True)
                        yield pa.record_batch([pa.array(np.full(len(g), k, np.int32)), pa.array(g), pa.array(n, pa.int64())], names=["lang", "gram", "n"])
                        own, waiting = [], 0

    counted = stored(sample.mapInArrow(count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    sizes = {r.lang: r.n for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not sizes:  # nothing but empty texts
        return frozen(languages, [])
    weight = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, 1.0 / n)])
    # a context of k bytes, as a byte string's packed value; a shorter one is seen at least as often as those that it ends, so the nodes make trees
    lengths = F.explode(F.array(*[F.lit(k) for k in range(ORDER + 1)])).alias("k")
    context = F.shiftright("gram", 8).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), 8 * F.col("k")) - 1)
    each = counted.select("lang", "gram", "n", lengths).select("lang", "k", context.alias("context"), F.col("gram").bitwiseAND(F.lit(255)).cast("int").alias("byte"), "n")
    seen = each.where("k > 1").groupBy("k", "context").agg(F.round(F.sum(F.col("n") * weight[F.col("lang")]), 12).alias("seen"))
    nodes = stored(seen.orderBy(F.desc("seen"), "k", "context").limit(MOST_NODES).select("k", "context"), "nodes")
    # MOST_NODES + 257 contexts, and 256 bytes after each, at most
    table = each.join(F.broadcast(nodes), ["k", "context"], "left_semi").unionByName(each.where("k < 2")).groupBy("k", "context", "byte", "lang").agg(F.sum("n").alias("n")).toArrow()
    return frozen(languages, [table.column(c).to_numpy() for c in ("k", "context", "byte", "lang", "n")])


def frozen(languages: list[str], rows: list[np.ndarray]) -> Trees:
    """Trees from counts: rows of (length of the context, context, byte, number of the language, count). In a context of total t with d different bytes after it
    a byte of count c has the chance (c + d * p) / (t + d), p that of the next shorter context: an escape in the share of d (method C)."""
    n_lang = len(languages)
    k, context, byte, lang, n = rows or [np.empty(0, np.int64)] * 5
    bytes_seen = np.unique(byte)
    symbol = np.zeros(256, np.int32)
    symbol[bytes_seen] = np.arange(1, len(bytes_seen) + 1)
    symbol = symbol[LOWER]
    width = len(bytes_seen) + 1
    order = np.lexsort((context, k))
    which = np.stack([k[order], context[order]], 1)
    firsts = np.flatnonzero(np.append(True, (which[1:] != which[:-1]).any(1))) if len(which) else np.empty(0, np.int64)
    number = np.empty(len(k), np.int64)
    number[order] = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(which))))
    count = max(1, len(firsts))
    child = np.zeros((count, width), np.int32)
    cost = np.zeros((count, width, n_lang), np.float32)
    names = [tuple(x) for x in which[firsts].tolist()]
    at = {x: i for i, x in enumerate(names)}
    lower = np.zeros(count, np.int64)
    for i, (size, c) in enumerate(names):
        if size:
            lower[i] = at[size - 1, c & ((1 << 8 * (size - 1)) - 1)]
            child[lower[i], symbol[c >> 8 * (size - 1)]] = i
    seen = np.zeros((count, width))
    uniform = np.full(width, 1 / SYMBOLS)
    for j in range(n_lang):
        own = lang == j
        seen[:] = 0
        seen[number[own], symbol[byte[own]]] = n[own]
        total, distinct = seen.sum(1), np.count_nonzero(seen, 1)
        chance = np.empty((count, width))
        for i in range(count):  # shorter contexts come first
            below = chance[lower[i]] if i else uniform
            chance[i] = (seen[i] + distinct[i] * below) / (total[i] + distinct[i]) if total[i] else below
        cost[:, :, j] = -np.log2(chance)
    plain = -np.log2(np.exp2(-cost[0].astype(float)).mean(1)) if n_lang else np.full(width, np.log2(SYMBOLS))
    return Trees(languages, symbol, child, cost, plain)


def predict(docs: DataFrame, model: Trees) -> DataFrame:
    """docs with lang_pred, score, bits_per_byte and plain_bits_per_byte. Only `text` is read.

    lang_pred is the language of the shortest code, ties to the first by name; `und` (score 0) if the text is null, has no letter, or no
    language is known. score is the chance of lang_pred with the code lengths of 100 bytes at most as evidence, so that it stays comparable between lengths.
    bits_per_byte is that shortest code's; plain_bits_per_byte that of the bytes' shares in all languages, without contexts: a text whose contexts
    tell no more than that is in none of the languages. Columns of these names are replaced, others stay; repeated rows are each a row; an empty table gives none.
    """
    docs = docs.drop("lang_pred", "score", "bits_per_byte", "plain_bits_per_byte", "_letter")
    fields = [(f.name, f.dataType.simpleString()) for f in docs.schema.fields]
    held = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Trees(**held.value)
        names = np.array([*trees.languages, "und"], object)
        for batch in batches:
            text = batch.column(batch.schema.names.index("text"))
            _, offsets = flat(text)
            size = np.maximum(np.diff(offsets), 1)
            letter = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            if trees.languages:
                bits, plain = trees.bits(text)
                best = bits.argmin(1)
                worse = (bits - bits.min(1, keepdims=True)) * (np.minimum(size, 100) / size)[:, None]
                score = np.where(letter, 1 / np.exp2(-np.minimum(worse, 1000)).sum(1), 0.0)
                rate, plain = bits.min(1) / size, plain / size
            else:
                best, score, rate, plain = np.zeros(len(size), int), np.zeros(len(size)), np.zeros(len(size)), np.zeros(len(size))
            pred = names[np.where(letter, best, len(trees.languages)) if trees.languages else np.zeros(len(size), int)]
            added = [pa.array(pred, pa.string()), pa.array(score), pa.array(rate), pa.array(plain)]
            yield pa.record_batch([*batch.columns[:-1], *added], names=[*batch.schema.names[:-1], "lang_pred", "score", "bits_per_byte", "plain_bits_per_byte"])

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letter")
    schema = ", ".join(f"`{n}` {t}" for n, t in fields) + ", lang_pred string, score double, bits_per_byte double, plain_bits_per_byte double"
    return docs.select("*", letter).mapInArrow(run, schema)


def unfit() -> Column:
    """Of predict()'s columns: whether no language fits, since the text has no letter or the contexts of all languages tell less than none would."""
    beyond = (F.col("bits_per_byte") - F.col("plain_bits_per_byte")) * F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return (F.col("lang_pred") == "und") | (beyond > UNFIT_BITS)


def split(fold: int, of: int) -> Column:
    """Whether a row is in the fold that is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == fold, F.lit(False))
