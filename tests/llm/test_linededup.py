import random

import numpy as np

from panelmc.llm import linededup
from panelmc.llm.linededup import Cuckoo, LineIndex, drop_repeated_lines

WHITE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def brute(rows):
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(d)
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(holders[key(x)]) == d]
        out[d] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def rows_of(seed=2):
    rng = random.Random(seed)
    pool = ["A shared line here", "  a SHARED line here\t", "éééééééééé", "short", "nine char", "ten chars!", "", "  ", "another long line", "x\r", "another long line\r"]
    rows = [(i, "\n".join(rng.choice([*pool, f"own line number {i}"]) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    return [*rows, (60, None), (61, ""), (62, "A shared line here\n" * 3)]


def test_against_brute_force(spark, docs):
    rows = rows_of()
    got = {r.doc_id: (r.text or "", r.n_lines, r.n_dropped) for r in drop_repeated_lines(docs(rows).withColumnRenamed("lang", "n_lines")).collect()}
    assert got == brute(rows)
    assert drop_repeated_lines(docs([])).count() == 0


def test_many_shards_full_filters_and_hot_lines(spark, docs, monkeypatch):
    rows = rows_of(4)
    want = brute(rows)
    for values in ({"KEYS_PER_SHARD": 1}, {"SHARD_ROWS": 3, "HOT_ROWS": 2}):
        with monkeypatch.context() as m:
            for name, value in values.items():
                m.setattr(linededup, name, value)
            assert {r.doc_id: (r.text or "", r.n_lines, r.n_dropped) for r in drop_repeated_lines(docs(rows)).collect()} == want


def test_clashing_names_null_ids_and_long_texts(spark):
    long = "\n".join(f"line number {i}" for i in range(5000))
    rows = [(1, long, 1, "x"), (2, "line number 7\nown", 2, "y"), (None, "line number 8\n" + long, 3, None), (None, None, 4, None)]
    out = drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string, _away int, `_of` string")).collect()
    assert {r._away: (r.text, r.n_dropped, r._of) for r in out} == {1: (long, 0, "x"), 2: ("own", 1, "y"), 3: ("line number 8\n" + long, 0, None), 4: (None, 0, None)}


def fingerprints(index):
    """What the filters hold, by shard: (fingerprint, bucket) with either of the two places as one."""
    out = []
    for r in index.filters.collect():
        with linededup.opened(r.path, "r") as f:
            for net in linededup.Shard(f.read()).nets:
                for b, s in zip(*np.nonzero(net.cells), strict=True):
                    x = int(net.cells[b, s])
                    out.append((r.shard, x, min(int(b), (int(b) ^ int(linededup.mixed(np.array([x], np.uint64))[0])) & net.mask)))
    return sorted(out)


def test_filters_follow_inserts_and_deletions(spark, docs):
    rows = [*rows_of(8), (100, "a freshly shared line"), (101, "own start\nA freshly SHARED line ")]
    index = LineIndex.empty(spark).insert(docs(rows[:20]))
    first = fingerprints(index)
    more = index.insert(docs(rows[20:]))
    assert len(fingerprints(more)) == more.shared.count() > len(first)
    back = more.delete(docs(rows[20:]))
    assert fingerprints(back) == first and sorted(back.shared.collect()) == sorted(index.shared.collect())
    gone = back.delete(docs(rows[:20]))
    assert fingerprints(gone) == [] and gone.shared.count() == gone.refs.count() == 0
    assert fingerprints(gone.insert(docs(rows[:20]))) == first


def test_insert_and_delete_are_reversible(spark, docs):
    rows = rows_of(6)
    some, rest = rows[:30], rows[30:]
    index = LineIndex.empty(spark).insert(docs(some)).insert(docs(rest))
    assert sorted(index.counts().collect()) == sorted(LineIndex.empty(spark).insert(docs(rows)).counts().collect())
    back = index.delete(docs(some))
    assert sorted(back.counts().collect()) == sorted(LineIndex.empty(spark).insert(docs(rest)).counts().collect())
    got = {r.doc_id: (r.text or "", r.n_lines, r.n_dropped) for r in drop_repeated_lines(docs(rest), back).collect()}
    assert got == brute(rest)


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    held, other = rng.integers(0, 1 << 63, 5000).astype(np.uint64), rng.integers(0, 1 << 63, 50_000).astype(np.uint64)
    f = Cuckoo.of(held)
    assert f.contains(held).all() and f.contains(other).mean() < 0.001
    assert all(f.delete(h) for h in held[:2500].tolist())
    assert f.contains(held[2500:]).all() and f.contains(held[:2500]).mean() < 0.01
    assert not Cuckoo(4).delete(5)
    # a full filter is left as it was
    small = Cuckoo(8)
    left = small.insert_all(held[:200])
    cells = small.cells.copy()
    assert len(left) == 200 - np.count_nonzero(cells) and not any(small.insert(h) for h in left[:5].tolist()) and (small.cells == cells).all()
    shard = linededup.Shard(capacity=100)
    shard.insert(held)
    again = linededup.Shard(shard.data(), 100)
    assert len(again.nets) > 30 and again.contains(held).all()
    again.delete(held[:4000])
    assert again.contains(held[4000:]).all() and again.contains(held[:4000]).mean() < 0.02
