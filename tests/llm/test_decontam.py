import re

from panelmc.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items, window):
    out = {}
    sets = {i: WORD.findall(lower(t)) for i, t in items}
    for d, t in docs:
        ws = WORD.findall(lower(t))
        hit, of = set(), set()
        for i, it in sets.items():
            k = min(window, len(it))
            grams = {tuple(it[a : a + k]) for a in range(len(it) - k + 1)} if it else set()
            for a in range(len(ws) - k + 1 if it else 0):
                if tuple(ws[a : a + k]) in grams:
                    hit.update(range(a, a + k))
                    of.add(i)
        out[d] = (len(ws), len(hit), sorted(of))
    return out


def test_against_brute_force(spark, docs):
    import random

    rng = random.Random(5)
    vocab = ["ab", "Cd", "é1", "x", "y", "zz"]
    say = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", "", ",", "-"]) for _ in range(n))
    items = [(i, say(rng.randint(0, 9))) for i in range(12)] + [(12, None), (13, "--"), (14, "only")]
    rows = [(d, say(rng.randint(0, 60))) for d in range(40)] + [(40, None), (41, ""), (42, "x only é1!"), (43, " ".join(t or "" for _, t in items))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for window in (2, 4, 10):
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontam.contamination(docs(rows), bench, window).collect()}
        assert got == brute(rows, items, window)


def test_blocks_agree_and_spans_go(spark, docs, monkeypatch):
    items = [(1, "one two three four five"), (2, "six seven eight"), (3, "nine ten eleven twelve")]
    rows = [(0, "A: one, two; three four FIVE! tail six seven eight."), (1, "clean words here"), (2, None), (3, "nine ten eleven twelve")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = decontam.contamination(docs(rows), bench, 10, 0.9).collect()
    monkeypatch.setattr(decontam, "WORDS_PER_BLOCK", 8)
    assert sorted(decontam.contamination(docs(rows), bench, 10, 0.9).collect()) == sorted(whole)
    text = {r.doc_id: r.clean_text for r in whole}
    assert text == {0: "A: ! tail .", 1: "clean words here", 2: None, 3: None}


def test_empty_tables_and_clashing_columns(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    rows = docs([(1, "some words"), (1, "some words")]).withColumnRenamed("source", "n_words").withColumnRenamed("lang", "items")
    assert [(r.n_words, r.n_hit) for r in decontam.contamination(rows, bench).collect()] == [(2, 0)] * 2
    assert decontam.contamination(docs([]), bench).count() == 0


def test_items_without_an_id(spark, docs, monkeypatch):
    items = [(1, "one two three four"), (None, "six seven eight"), (None, "two three four nine ten"), (2, "six seven"), (None, None), (None, "one two three four")]
    rows = [(0, "a one two three four nine ten b"), (1, "six seven eight"), (2, "six seven x"), (3, "two three four nine"), (4, None), (5, "six two ten")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for words in (decontam.WORDS_PER_BLOCK, 8):
        monkeypatch.setattr(decontam, "WORDS_PER_BLOCK", words)
        for window in (2, 4, 10):
            got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontam.contamination(docs(rows), bench, window).collect()}
            # brute() has a set for each id: those without one get ids below zero
            want = brute(rows, [(-k - 1 if i is None else i, t) for k, (i, t) in enumerate(items)], window)
            assert got == {d: (n, h, [i for i in of if i >= 0]) for d, (n, h, of) in want.items()}


def test_text_ids_long_texts_and_waiting(spark, docs, monkeypatch):
    bench = spark.createDataFrame([("b", "one two three"), ("a", "four five"), (None, "six")], "item_id string, text string")
    long = "x " * 200_000 + "one two three four five " + "é " * 200_000
    rows = [(0, long), (1, "four five four five"), (1, "four five four five"), (2, "six")]
    for name, value in (("HELD_BYTES", 1), ("WORDS_PER_BLOCK", 5)):
        monkeypatch.setattr(decontam, name, value)
        got = sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontam.contamination(docs(rows), bench).collect())
        assert got == [(0, 400_005, 5, ["a", "b"]), (1, 4, 4, ["a"]), (1, 4, 4, ["a"]), (2, 1, 1, [])]


def test_words_of_one_text_are_held_at_a_time(spark, docs, monkeypatch):
    """A batch of many texts took ten times its bytes: all their words at once."""
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql.classic.dataframe import DataFrame

    scans = []
    run = DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, *a: (scans.append(f), run(self, f, *a))[1])
    bench = spark.createDataFrame([(1, "one two three four"), (2, "five six")], "item_id long, text string")
    texts = ["w " * 1000 + ("one two three four" if i == 7 else "") for i in range(5000)]
    batch = pa.record_batch([pa.array(range(5000)), pa.array(texts), *[pa.nulls(5000, t) for t in (pa.string(), pa.string(), pa.int64())]], names=docs([]).columns)
    for words in (decontam.WORDS_PER_BLOCK, 8):
        monkeypatch.setattr(decontam, "WORDS_PER_BLOCK", words)
        decontam.contamination(docs([]), bench)
        tracemalloc.start()
        made = n = 0
        for out in scans[-1](iter([batch])):
            made, n = made + len(out), n + sum(out.column(out.schema.names.index("n_hit")).to_pylist())
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert (made, n) == (5000, 4)
        # the batch's bytes, if they wait for several automata, and some more
        assert most < 2 * batch.nbytes
