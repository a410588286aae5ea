"""Toxicity (operator 7): a linear-chain conditional random field tags toxic spans.

Observations are words and their beginnings. Those that mark toxic documents make the lexicon, and their places in toxic rows
are the labelled tokens that the field is trained on. Forward-backward marginals then give spans, and one score a document.
The fit is on a bounded sample that is stored once; scoring is one scan of whole texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmc.llm.decontam import NORMAL, words
from panelmc.llm.shared import stored

#: Lengths in bytes of the beginnings that are observations beside the whole word.
BEGINNINGS = (4, 5, 6, 7)
#: The fit is on a bounded sample: about so many labelled rows of each label, by a hash, and whole texts; and of their token stretches of
#: STRETCH words as many different ones.
FIT_ROWS = 8000
MOST_STRETCHES = 20_000
STRETCH = 64
#: An entry is in as many toxic rows at least, and toxic rows are more than this share of those it is in.
LEAST_ROWS, LEAST_SHARE = 3, 0.6
CLEAN, TOXIC = 0, 1


def observations(w: bytes) -> list[bytes]:
    return [w, *(b"^" + w[:k] for k in BEGINNINGS if len(w) >= k)]


@dataclass
class Field:
    """lexicon: entry to column of `emit`; column 0 is any other word. emit [2, entries], move [2, 2], first [2]: log weights.
    scale, shift: of the logistic curve from a document's evidence to its score."""

    lexicon: dict[bytes, int]
    emit: np.ndarray
    move: np.ndarray
    first: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def symbols(self, tokens: list[bytes], known: dict[bytes, int]) -> np.ndarray:
        """Column of each token: that of the longest entry it has. known: what this task has looked up before."""
        get = known.get
        out = [get(w) for w in tokens]
        if None in out:
            for i, s in enumerate(out):
                if s is None:
                    w = tokens[i]
                    s = get(w)
                    if s is None:
                        s = self.lexicon.get(w, 0)
                        for k in sorted(BEGINNINGS, reverse=True):
                            if not s and len(w) >= k:
                                s = self.lexicon.get(b"^" + w[:k], 0)
                        if len(known) > 300_000:
                            known.clear()
                        known[w] = s
                    out[i] = s
        return np.array(out, np.int64)

    def marginals(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of entries, and their chances of TOXIC: forward-backward over the whole chain. A stretch of plain words counts as a power of its transfer
        matrix, which its two eigenvalues give for any length."""
        n = len(symbols)
        at = np.flatnonzero(symbols)
        if not len(at):
            return at, np.empty(0)
        move, emit = np.exp(self.move), np.exp(self.emit)
        step = move * emit[:, 0][None, :]  # a plain word: from, to; all entries are positive, so the eigenvalues are real and differ
        (a, b), (c, d) = step.tolist()
        root = float(np.sqrt((a - d) ** 2 + 4 * b * c))
        high, low = (a + d + root) / 2, (a + d - root) / 2
        one, two = (step - low * np.eye(2)) / root, (high * np.eye(2) - step) / root
        # powers over the larger eigenvalue's: scale is lost at each step anyway
        gaps = np.diff(at, prepend=-1, append=n) - 1
        powers = (one[None] + np.power(low / high, gaps)[:, None, None] * two[None]).reshape(-1, 4).tolist()
        weights = emit[:, symbols[at]].T.tolist()
        (m00, m01), (m10, m11) = move.tolist()
        f0, f1 = np.exp(self.first).tolist()
        if gaps[0]:
            # the first word has its own weights in place of a move
            f0, f1 = f0 * emit[0, 0], f1 * emit[1, 0]
            p = (one + (low / high) ** (int(gaps[0]) - 1) * two).reshape(-1).tolist()
            f0, f1 = f0 * p[0] + f1 * p[2], f0 * p[1] + f1 * p[3]
            f0, f1 = f0 * m00 + f1 * m10, f0 * m01 + f1 * m11
        ahead = []
        for i, (e0, e1) in enumerate(weights):
            if i:
                p = powers[i]
                f0, f1 = f0 * p[0] + f1 * p[2], f0 * p[1] + f1 * p[3]
                f0, f1 = f0 * m00 + f1 * m10, f0 * m01 + f1 * m11
            f0, f1 = f0 * e0, f1 * e1
            total = f0 + f1
            f0, f1 = f0 / total, f1 / total
            ahead.append((f0, f1))
        p = powers[-1]
        b0, b1 = p[0] + p[1], p[2] + p[3]
        chance = [0.0] * len(at)
        for i in range(len(at) - 1, -1, -1):
            x, y = ahead[i][0] * b0, ahead[i][1] * b1
            chance[i] = y / (x + y)
            e0, e1 = weights[i]
            b0, b1 = e0 * b0, e1 * b1
            b0, b1 = m00 * b0 + m01 * b1, m10 * b0 + m11 * b1
            p = powers[i]
            b0, b1 = p[0] * b0 + p[1] * b1, p[2] * b0 + p[3] * b1
            total = b0 + b1
            b0, b1 = b0 / total, b1 / total
        return at, np.array(chance)

    def score(self, chance: np.ndarray, n_words: int) -> float:
        """Of a document: the logistic curve of the log of expected toxic words, with half a word in all as prior."""
        evidence = np.log(chance.sum() + 0.01) if n_words else np.log(0.01)
        return float(1 / (1 + np.exp(-(self.scale * evidence + self.shift))))


def surprise(k: np.ndarray, n: np.ndarray, base: float) -> np.ndarray:
    """Log of how much likelier k toxic rows of n are at their own share than at the base rate."""
    p = k / n
    return k * np.log(p / base) + np.where(n > k, (n - k) * np.log(np.maximum(1 - p, 1e-12) / (1 - base)), 0.0)


def share_of(label: str, rows: dict[int, int]) -> Column:
    """So many of 2 ** 31 hash values as FIT_ROWS is of a label's rows."""
    return F.when(F.col(label) == 1, F.lit(int((1 << 31) * min(1.0, FIT_ROWS / rows[1])))).otherwise(F.lit(int((1 << 31) * min(1.0, FIT_ROWS / rows[0]))))


def chosen(labels: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """Of labels (doc_id, toxic) about FIT_ROWS different ids of each label, by a hash of the id, so that the documents need no shuffle to be joined; and how many
    labels each of them stands for. Null ids and labels other than 0 and 1 are left out."""
    rows = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {0: 1, 1: 1} | {r.toxic: max(1, r.n) for r in rows.groupBy("toxic").agg(F.approx_count_distinct("doc_id").alias("n")).collect()}
    ids = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < share_of("toxic", counts)).distinct()
    return ids, {k: max(1.0, n / FIT_ROWS) for k, n in counts.items()}


def fit(rows: DataFrame, weight: dict[int, float] | None = None) -> Field:
    """Field of labelled rows (text, toxic 0 or 1); rows without a label are left out, repeated rows count once, null texts have no words. About FIT_ROWS rows of
    each label are taken by a hash of their text, whole texts. weight: how many rows of the corpus a given row of either label stands for."""
    rows = rows.where("toxic in (0, 1)").select(F.col("toxic").cast("int").alias("toxic"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.xxhash64("text").alias("h"))
    counts = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.approx_count_distinct("h").alias("n")).collect()}
    n_clean, n_toxic = counts.get(0, 0), counts.get(1, 0)
    if not n_clean or not n_toxic:
        return Field({}, np.zeros((2, 1)), np.zeros((2, 2)), np.zeros(2), 0.0, 12.0 if n_toxic else -12.0)
    sample = stored(rows.where(F.pmod("h", F.lit(1 << 31)) < share_of("toxic", {0: n_clean, 1: n_toxic})).groupBy("toxic", "h").agg(F.first("text").alias("text")).select("toxic", "text", "h"), "sample")
    weight = {k: max(1.0, n / FIT_ROWS) * (weight or {}).get(k, 1.0) for k, n in ((0, n_clean), (1, n_toxic))}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            names = list(held[0].keys() | held[1].keys())
            rec = pa.record_batch([pa.array(names, pa.binary()), pa.array([held[0][w] for w in names], pa.int64()), pa.array([held[1][w] for w in names], pa.int64())], names=["entry", "clean", "toxic"])
            held[0].clear()
            held[1].clear()
            return rec

        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[y].update({o for w in set(words(t)) for o in observations(w)})
                if len(held[0]) + len(held[1]) > 500_000:
                    yield out()
        yield out()

    # counts are of distinct words in whole rows; an entry has to be more surprising than the luckiest of all that were tried
    found = sample.select("toxic", "text").mapInArrow(count, "entry binary, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    found = stored(found.where(f"toxic >= {LEAST_ROWS}"), "entries")
    tried = found.count()
    n_taken = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    base = max(1, n_taken.get(1, 0)) / max(1, sum(n_taken.values()))
    # words of at most 2 * FIT_ROWS rows
    top = found.where(f"toxic * {weight[1]} > {LEAST_SHARE} * (clean * {weight[0]} + toxic * {weight[1]})").orderBy("entry").toArrow()
    k = top.column("toxic").to_numpy().astype(float)
    g = surprise(k, k + top.column("clean").to_numpy(), base)
    lexicon = {e: i for i, e in enumerate((e for e, x in zip(top.column("entry").to_pylist(), g, strict=True) if x > np.log(max(tried, 2))), 1)}
    blank = Field(lexicon, np.zeros((2, len(lexicon) + 1)), np.zeros((2, 2)), np.zeros(2))
    held = rows.sparkSession.sparkContext.broadcast(vars(blank))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, known = Field(**held.value), {}
        for batch in batches:
            seen: Counter = Counter()
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = field.symbols(words(t), known).astype(np.int32)
                for a in range(0, len(s), STRETCH):
                    own = s[a : a + STRETCH]
                    # those without an entry are the same for either label
                    seen[y if own.any() else 0, own.tobytes()] += 1
            yield pa.record_batch([pa.array([y for y, _ in seen], pa.int32()), pa.array([x for _, x in seen], pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["toxic", "symbols", "n"])

    taken = sample.select("toxic", "text").mapInArrow(stretches, "toxic int, symbols binary, n long").groupBy("toxic", "symbols").agg(F.sum("n").alias("n"))
    taken = taken.orderBy(F.xxhash64("symbols"), "toxic").limit(MOST_STRETCHES).toArrow()
    x, size = np.zeros((len(taken), STRETCH), np.int64), np.zeros(len(taken), np.int64)
    for i, s in enumerate(taken.column("symbols").to_pylist()):
        s = np.frombuffer(s, np.int32)
        x[i, : len(s)] = s
        size[i] = len(s)
    y = ((x > 0) & (taken.column("toxic").to_numpy() == 1)[:, None]).astype(np.int64)
    train(blank, x, y, size, taken.column("n").to_numpy().astype(float))
    held = rows.sparkSession.sparkContext.broadcast(vars(blank))

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, known = Field(**held.value), {}
        for batch in batches:
            e = [float(np.log(field.marginals(field.symbols(words(t), known))[1].sum() + 0.01)) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(e, pa.float64())], names=["toxic", "e"])

    # at most 2 * FIT_ROWS rows, in classes of evidence
    pairs = sample.select("toxic", "text").mapInArrow(evidence, "toxic int, e double").groupBy("toxic", F.round("e", 1).alias("e")).count().collect()
    e, y, w = (np.array(v, float) for v in zip(*[(r.e, r.toxic, r["count"] * weight[r.toxic]) for r in pairs], strict=True))
    a = b = 0.0
    for _ in range(100):  # Newton's steps with a little ridge
        p = 1 / (1 + np.exp(-np.clip(a * e + b, -30, 30)))
        g, v = w * (y - p), w * p * (1 - p) + 1e-9
        h = np.array([[(v * e * e).sum() + 1.0, (v * e).sum()], [(v * e).sum(), v.sum() + 1e-3]])
        da, db = np.linalg.solve(h, [(g * e).sum() - a, g.sum() - 1e-3 * b])
        a, b = a + np.clip(da, -1, 1), b + np.clip(db, -1, 1)
    blank.scale, blank.shift = float(a), float(b)
    return blank


def gradient(field: Field, x: np.ndarray, y: np.ndarray, size: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the sum of weight times conditional log likelihood of tags y of symbols x, whose rows end at size: by emit, move and first.
    Counts of the tags as they are, less those that forward-backward expects."""
    n, width = x.shape
    real = np.arange(width)[None, :] < size[:, None]
    each = np.repeat(weight[:, None], width, 1)
    emit, move = np.zeros_like(field.emit), np.zeros((2, 2))
    np.add.at(emit, (y[real], x[real]), each[real])
    pairs = real[:, 1:]
    np.add.at(move, (y[:, :-1][pairs], y[:, 1:][pairs]), each[:, 1:][pairs])
    first = np.bincount(y[:, 0], weights=weight * real[:, 0], minlength=2)
    e = np.exp(field.emit)[:, x].transpose(2, 1, 0)  # place, row, tag
    m = np.exp(field.move)
    ahead = np.empty((width, n, 2))
    ahead[0] = np.exp(field.first) * e[0]
    ahead[0] /= ahead[0].sum(1, keepdims=True)
    for t in range(1, width):
        v = ahead[t - 1] @ m * e[t]
        v /= v.sum(1, keepdims=True)
        ahead[t] = np.where(real[:, t, None], v, ahead[t - 1])
    back = np.ones((n, 2)) / 2
    for t in range(width - 1, -1, -1):
        p = ahead[t] * back
        p *= (weight * real[:, t] / p.sum(1))[:, None]
        for tag in (0, 1):
            emit[tag] -= np.bincount(x[:, t], weights=p[:, tag], minlength=emit.shape[1])
        if t:
            right = e[t] * back
            joint = ahead[t - 1][:, :, None] * m[None] * right[:, None, :]
            move -= ((weight * real[:, t] / joint.sum((1, 2)))[:, None, None] * joint).sum(0)
            v = right @ m.T
            back = np.where(real[:, t, None], v / v.sum(1, keepdims=True), back)
        else:
            first = first - p.sum(0)
    return emit, move, first


def train(field: Field, x: np.ndarray, y: np.ndarray, size: np.ndarray, weight: np.ndarray | None = None, rounds: int = 60, ridge: float = 0.01) -> None:
    """Gradient ascent (Adam) on the conditional log likelihood, with a ridge."""
    if not len(x):
        return
    weight = np.ones(len(x)) if weight is None else weight
    total = weight.sum()
    params = [field.emit, field.move, field.first]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, rounds + 1):
        for p, s, g in zip(params, state, gradient(field, x, y, size, weight), strict=True):
            g = (g - ridge * p) / total
            s[0][...] = 0.9 * s[0] + 0.1 * g
            s[1][...] = 0.999 * s[1] + 0.001 * g * g
            p += 0.2 * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8)


def placed(text: bytes, stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches of words (end exclusive) as places in code points of the text."""
    plain = np.frombuffer(text.translate(NORMAL), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], plain.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(points[begin[a]]), int(points[end[b - 1]])) for a, b in stretches]


def score(docs: DataFrame, field: Field, least: float = 0.5) -> DataFrame:
    """docs with score (0 to 1) and spans (start, end in code points, end exclusive; chance): stretches of words whose chance of being toxic is `least`
    or more. Only `text` is read; null and empty texts have no words, and the score of no evidence. Columns of these names are replaced, others stay;
    repeated rows are each a row; an empty table gives none."""
    docs = docs.drop("score", "spans")
    fields = [(f.name, f.dataType.simpleString()) for f in docs.schema.fields]
    held = docs.sparkSession.sparkContext.broadcast(vars(field))
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("chance", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, known = Field(**held.value), {}
        for batch in batches:
            scores, spans = [], []
            for t in batch.column(batch.schema.names.index("text")).cast(pa.binary()).to_pylist():
                ws = words(t)
                at, chance = field.marginals(field.symbols(ws, known))
                scores.append(field.score(chance, len(ws)))
                own: list[list] = []
                for i, p in zip(at.tolist(), chance.tolist(), strict=True):
                    if p >= least:
                        if own and own[-1][1] == i:
                            own[-1][1:] = i + 1, max(own[-1][2], p)
                        else:
                            own.append([i, i + 1, p])
                spans.append([{"start": a, "end": b, "chance": x[2]} for (a, b), x in zip(placed(t, [(x[0], x[1]) for x in own]), own, strict=True)] if own else [])
            yield pa.record_batch([*batch.columns, pa.array(scores, pa.float64()), pa.array(spans, pa.list_(kind))], names=[*batch.schema.names, "score", "spans"])

    schema = ", ".join(f"`{n}` {t}" for n, t in fields) + ", score double, spans array<struct<start: long, end: long, chance: double>>"
    return docs.mapInArrow(run, schema)
