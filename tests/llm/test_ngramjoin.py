import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from panelmc.llm import ngramjoin
from panelmc.llm.ngramjoin import components, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(t, k):
    ws = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set()


def brute(rows, k, num):
    sets = [(d, grams(t, k)) for d, t in rows]
    label = {d: d for d, _ in sets}
    changed = True
    links = [(a, b) for i, (a, s) in enumerate(sets) for b, t in sets[i + 1 :] if s and t and 100 * len(s & t) >= num * len(s | t)]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return {d: (len(s), label[d]) for d, s in sets}


def rows_of(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    shared = [rng.choice(vocab) for _ in range(60)]
    rows = []
    for base in range(14):
        words = [rng.choice(vocab) for _ in range(rng.randint(3, 160))]
        if base % 3 == 0:
            words += shared
        for _ in range(rng.randint(1, 8)):
            w = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[rng.choice(vocab)], [], [rng.choice(vocab)] * 2])
            rows.append(" ".join(w))
    rng.shuffle(rows)
    return [*enumerate(rows, 5), (1, None), (2, ""), (3, " \t"), (4, "One two"), (900, "one  TWO"), (901, "one")]


@pytest.mark.parametrize("seed,k,num", [(1, 4, 85), (2, 4, 85), (3, 5, 80), (4, 2, 60)])
def test_against_brute_force(spark, docs, seed, k, num, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(ngramjoin, "MOST_IN_BLOCK", 2)
    if seed > 1:
        monkeypatch.setattr(ngramjoin, "FEW_COMPONENTS", seed - 1)
    rows = rows_of(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(rows), k, num).collect()}
    assert got == brute(rows, k, num)


def test_empty_and_repeated_rows(spark, docs):
    assert near_duplicates(docs([])).count() == 0
    same = docs([(7, "a b c d e f"), (7, "a b c d e f"), (8, "a b c d e f"), (7, "other words are here now then")])
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(same).collect()) == [(7, 7), (7, 7), (7, 7), (8, 7)]


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 90, 95: 90, 90: 90} or got == {**dict.fromkeys(range(1, 41), 0), 100: 90, 95: 90}


def test_last_round_looks_inside_a_range_of_sizes(spark, docs):
    """A (30 words) is linked with B (33) only; B's group also has sets of 29 and 34, with which A's one common first word is too few."""
    key = lambda ws: ngramjoin.set_key(next(ngramjoin.shingles(pa.array([" ".join(ws)]), 1)))
    cases = []
    for seed in range(40):
        words = sorted((f"v{seed}x{i}" for i in range(35)), key=lambda w: int(next(ngramjoin.shingles(pa.array([w]), 1))[0]))
        own, a, common = words[:5], words[5], words[6:]
        cases.append([[*own[1:], *common], [*own[1:], *common[:25]], [*own, *common], [a, *common]])
    hashed = spark.createDataFrame([tuple(map(key, c)) for c in cases], "b long, s long, l long, a long").selectExpr("*", "xxhash64(b, 0) as hb", "xxhash64(s, 0) as hs", "xxhash64(l, 0) as hl", "xxhash64(a, 0) as ha").collect()
    # S or L leads where all meet, and A is the one that is sent
    lost = [c for c, r in zip(cases, hashed, strict=True) if min(r.hs, r.hl) < min(r.ha, r.hb) and r.a > min(r.b, r.s, r.l)]
    rows = [*enumerate(" ".join(ws) for c in lost[:3] for ws in c)]
    assert len(rows) == 12
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(rows), 1, 85).collect()}
    assert got == brute(rows, 1, 85) and got[3][1] == 0


def test_null_and_repeated_ids(spark, docs):
    say = lambda name: " ".join(f"{name}{i}" for i in range(30))
    near = lambda name: say(name) + " own end"
    rows = [(7, say("a")), (7, near("b")), (3, say("b")), (9, near("a")), (8, near("c")), (8, say("alone")), (2, say("c")), (2, say("c"))]
    rows += [(None, say("d")), (None, near("d")), (None, say("e")), (5, near("e")), (None, "own words of a row without an id"), (None, None), (None, " "), (6, "")]
    tagged = spark.createDataFrame([(i, t, str(k)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string").repartition(3)
    same = {say("a"): 7, near("a"): 7, say("b"): 3, near("b"): 3, say("c"): 2, near("c"): 2, say("alone"): 8, say("e"): 5, near("e"): 5, "": 6}
    got = sorted((str(r.doc_id), str(r.component_id)) for r in near_duplicates(tagged).collect())
    assert got == sorted((str(i), str(same.get(t))) for i, t in rows)
    kept = ngramjoin.first_of_groups(tagged)
    assert kept.dtypes == tagged.dtypes
    kept = sorted((str(r.doc_id), str(r.text)) for r in kept.collect())
    d = {(str(None), t) for t in (say("d"), near("d"))} & set(kept)
    want = [(7, say("a")), (3, say("b")), (8, say("alone")), (2, say("c")), (5, near("e")), rows[12], (None, None), (None, " "), (6, "")]
    assert len(d) == 1 and kept == sorted([*d, *((str(i), str(t)) for i, t in want)])


def test_sets_that_share_a_common_passage_only_are_not_sent(spark, docs, monkeypatch):
    """Seven texts of one passage and words of their own: only the two that are near go to blocks as they are."""
    monkeypatch.setattr(ngramjoin, "FEW_COMPONENTS", 3)
    monkeypatch.setattr(ngramjoin, "LEADERS", 0)
    tables, stored = {}, ngramjoin.stored
    monkeypatch.setattr(ngramjoin, "stored", lambda df, name="step": tables.setdefault(name, stored(df, name)) if name in ("apart", "blocks") else stored(df, name))
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"{passage} " + " ".join(f"own{d}x{i}" for i in range(100)) for d in range(6)]
    rows = [*enumerate([*texts, f"{texts[2]} one end"], 1)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(rows)).collect()}
    assert got == brute(rows, 5, 80) and got[7][1] == 3
    assert tables["apart"].where("ways > 3").select("key").distinct().count() == 7
    assert tables["blocks"].select("key").distinct().count() == 2


def test_bits_leave_every_pair_within_the_bound():
    """Sizes on both sides of those at which bits get longer, and pairs across; sets of one group are no pair, rooms rule pairs out."""
    rng = np.random.default_rng(5)
    draw = lambda k: rng.integers(0, 1 << 64, k, np.uint64)
    for num, den in ((85, 100), (80, 100), (20, 100)):
        sets = []
        for n in (1, 3, 500, 1900, 2040, 2300, 4090, 9000):
            base = draw(n)
            sets += [np.unique(np.concatenate([base[int(n * cut) :], draw(int(n * more))])) for cut, more in ((0, 0), (0.05, 0.02), (0, 0.12), (0.3, 0.3), (0, 3.9))]
        n, bits = np.array([len(s) for s in sets]), [ngramjoin.parities(s) for s in sets]
        rooms, groups = np.full(len(n), ngramjoin.NO_END), np.arange(len(n))
        label = ngramjoin.possible_groups(n, groups, rooms, bits, num, den)
        near = [(x, y) for x in range(len(n)) for y in range(x) if den * (both := len(np.intersect1d(sets[x], sets[y]))) >= num * (n[x] + n[y] - both)]
        assert len(near) > 15 and all(label[x] == label[y] for x, y in near)
        possible = lambda x, y: min(n[x], n[y]) * den >= num * max(n[x], n[y]) and ngramjoin.apart_by(bits[x], bits[y]) <= n[x] + n[y] - 2 * -(-num * (n[x] + n[y]) // (num + den))
        pairs = [(x, y) for x in range(len(n)) for y in range(x) if possible(x, y)]
        want = list(range(len(n)))
        for x, y in pairs:
            want = [want[y] if w == want[x] else w for w in want]
        assert len(set(zip(label.tolist(), want, strict=True))) == len(set(want)) == len(set(label.tolist()))
        assert len(set(ngramjoin.possible_groups(n, groups * 0, rooms, bits, num, den).tolist())) == len(n)
        assert len(set(ngramjoin.possible_groups(n, groups, rooms * 0, bits, num, den).tolist())) == len(n)


def test_sets_of_sizes_beyond_the_bound_do_not_meet(spark, docs, monkeypatch):
    """What line dedup leaves of a near copy is a small part of its source: they share shingles, but can't be linked."""
    tables, stored = {}, ngramjoin.stored
    monkeypatch.setattr(ngramjoin, "stored", lambda df, name="step": tables.setdefault(name, stored(df, name)) if name == "met" else stored(df, name))
    words = [[f"v{d}x{i}" for i in range(120)] for d in range(6)]
    rows = [*enumerate([" ".join(w[a:b]) for w in words for a, b in ((0, 120), (10, 60), (70, 110))], 1)]
    rows += [(50, " ".join(words[2][:119])), (51, rows[0][1])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(rows)).collect()}
    assert got == brute(rows, 5, 80) and got[50][1] == 7 and got[51][1] == 1
    # equal sets are one; the two parts of a text share nothing
    assert {r.n for r in tables["met"].select("n").distinct().collect()} == {115, 116}


def test_shingles_of_frequent_words_come_last(spark, docs, monkeypatch):
    """Texts of own words and a stretch of five frequent ones: no shingle is frequent, but some are in two texts by chance."""
    rng = random.Random(3)
    rows = [(d, " ".join([*(f"own{d}x{i}" for i in range(70)), *rng.choices(["the", "of", "and", "in", "to"], k=30)])) for d in range(60)]
    sets = [grams(t, 5) for _, t in rows]
    assert sum(len(a & b) for i, a in enumerate(sets) for b in sets[:i]) > 100
    tables, stored = {}, ngramjoin.stored
    monkeypatch.setattr(ngramjoin, "stored", lambda df, name="step": tables.setdefault(name, stored(df, name)) if name == "met" else stored(df, name))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(rows)).collect()}
    assert got == brute(rows, 5, 80)
    assert tables["met"].count() == 0


def test_leveled_shingles_are_the_shingles():
    rng = random.Random(4)
    texts = pa.array([" ".join(rng.choices("abcdefgh", k=k)) for k in (0, 1, 3, 4, 5, 40, 9)] + [None])
    levels = np.arange(1 << ngramjoin.SKETCH_BITS) % 7
    words = np.zeros(1 << ngramjoin.SKETCH_BITS, np.int64)
    plain = [s.tolist() for s in ngramjoin.shingles(texts, 4, words)]
    assert words.sum() == 62
    both = [(s.tolist(), level.tolist()) for s, level in ngramjoin.leveled_shingles(texts, 4, levels)]
    assert [s for s, _ in both] == plain and all(len(s) == len(level) for s, level in both)
    level_of = {}
    for s, level in both:
        for a, b in zip(s, level, strict=True):
            assert level_of.setdefault(a, b) == b
    assert len(set(level_of.values())) > 5


def test_texts_are_dealt_once_and_only_where_wanted(spark, tmp_path, monkeypatch):
    say = lambda d: " ".join(f"w{d}x{i}" for i in range(40))
    rows = [*((d, say(d)) for d in range(150)), (200, say(3) + " end"), (201, say(5)), (5, say(5)), (None, say("n")), (202, ""), (203, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/table")
    table = spark.read.parquet(f"{tmp_path}/table")
    passed, real = [], ngramjoin.let_through

    def spied(key, wanted):
        out = real(key, wanted)
        hashed = table.selectExpr("xxhash64(cast(text as binary)) as h", "xxhash64(cast(text as binary)) as _h")
        passed.append(hashed.where(out).count())
        return out

    monkeypatch.setattr(ngramjoin, "let_through", spied)
    kept = ngramjoin.first_of_groups(table)
    # no table of this size is dealt otherwise
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = kept._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert len(re.findall(r"\) Exchange\nInput \[\d+\]: \[[^\]]*\btext#", plan)) == 1
    want = [r for r in rows if r[0] not in (200, 201)]
    want.remove((5, say(5)))
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, want))
    # the pair of texts, then what goes: theirs and three rows of one text
    assert len(passed) > 1 and min(passed) >= 2 and max(passed) <= 12


def test_words_in_other_orders_are_other_shingles():
    orders = [" ".join(ws) for ws in itertools.product("ab", repeat=4)] + [" ".join(ws) for ws in itertools.permutations("abcd")]
    assert len({int(s[0]) for s in ngramjoin.shingles(pa.array(orders), 4)}) == len(orders)
