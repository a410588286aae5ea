import random

import corpus_pipeline as p
from panelmc.llm import decontam, ngramjoin

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_planted_cases(spark, tmp_path):
    rng = random.Random(8)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))
    item = say(30)
    clean = {i: say(80) + "\n" + say(60) for i in range(20)}
    # line dedup comes before, so a near copy that shares a whole line with its source would lose it: a word of either line is changed
    changed = clean[3].replace("\n", " \n ").split(" ")
    changed[40] = changed[110] = "changed"
    near = " ".join(changed).replace(" \n ", "\n")
    noise = "".join(rng.choice("!#%&qQxXzZ0123456789+/=kKwWvV") for _ in range(900))
    texts = {**clean, 100: None, 101: "12 34 !!", 102: clean[5], 103: near, 104: say(50) + " " + item + " " + say(50), 105: item, 106: "a line that repeats\n" + say(70), 107: "A LINE that repeats \n" + say(70), 108: noise}
    rows = [(i, t, "aa" if t and t != noise else None, "s", len(t) if t else None) for i, t in texts.items()]
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, held = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(p.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.dtypes == spark.read.parquet(f"{tmp_path}/documents.parquet").dtypes
            docs.write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")
            held[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(held["language_id"]) == set(texts) - {100, 101, 108}
    lines = held["line_dedup"]
    assert lines[102] == "" and lines[106] == texts[106] and lines[107] == texts[107].split("\n")[1]
    assert set(held["near_duplicates"]) == set(lines) - {103}
    last = held["decontamination"]
    assert set(last) == set(lines) - {103, 105} and item not in last[104] and len(decontam.words(last[104].encode())) == 100
    assert all(last[i] == t for i, t in clean.items())
    # packing deals by task, so windows differ between two runs, pieces' sums don't
    sums = lambda df: {r.doc_id: (r.doc_tokens, r["sum(length)"]) for r in df.groupBy("doc_id", "doc_tokens").sum("length").collect()}
    got = sums(docs)
    assert set(got) == set(last) and all(a == b for a, b in got.values())
    assert got == sums(p.run(spark, str(tmp_path)))


def test_null_and_repeated_ids(spark, tmp_path):
    texts = ["one text of some words here", "another text of other words", None, "", "a third text that says more"]
    rows = [(i, t, "en", "s", None) for i, t in zip([None, None, None, None, 7], texts, strict=True)] + [(7, texts[4], "en", "s", None), (9, texts[0], "en", "s", None)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = p.near_duplicates(spark, p.language_id(spark, docs, str(tmp_path)), str(tmp_path))
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, texts[1]), (7, texts[4]), (9, texts[0])]
    assert {r.doc_id for r in p.run(spark, str(tmp_path)).collect()} == {None, 7, 9}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_language_id_without_languages(spark, tmp_path):
    rows = [(1, "clean words", None, "s", 11), (2, None, None, "s", None), (3, "12 34 !!", None, "s", 8), (None, "é", None, None, 1)]
    docs = spark.createDataFrame(rows, COLUMNS)
    out = p.language_id(spark, docs, str(tmp_path))
    assert out.dtypes == docs.dtypes and sorted(r.text for r in out.collect()) == ["clean words", "é"]


def test_near_duplicates_sends_no_texts_that_share_a_common_passage_only(spark, monkeypatch):
    """Two of the texts have near copies, which the stage finds; sets that share no more than the passage aren't sent to the last round's blocks."""
    monkeypatch.setattr(ngramjoin, "FEW_COMPONENTS", 3)
    monkeypatch.setattr(ngramjoin, "LEADERS", 0)
    sent, stored = [], ngramjoin.stored
    monkeypatch.setattr(ngramjoin, "stored", lambda df, name="step": (sent.append(out := stored(df, name)), out)[1] if name == "blocks" else stored(df, name))
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"{passage} " + " ".join(f"own{d}x{i}" for i in range(100)) for d in range(5)]
    rows = [(i, t, None, "s", len(t)) for i, t in enumerate([*texts, f"{texts[1]} end", f"{texts[3]} one end"])]
    out = p.near_duplicates(spark, spark.createDataFrame(rows, COLUMNS).repartition(3), "")
    assert sorted(r.doc_id for r in out.collect()) == [0, 1, 2, 3, 4]
    assert sent[0].select("key").distinct().count() == 4


def test_batches_are_bounded_by_bytes(spark, monkeypatch, tmp_path):
    """A task's batch of 10,000 long texts was held several times over, outside the executor's heap and in its Python worker."""
    from pyspark.sql.classic.dataframe import DataFrame

    most = 4 << 20
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.createDataFrame([("1", "one two three")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = spark.range(4000, numPartitions=1).selectExpr("id as doc_id", "concat(id, repeat(' some words', 300)) as text", "'en' as lang", "'s' as source", "3300L as n_chars")
    rows.write.parquet(f"{tmp_path}/documents.parquet")

    def watched(self, f, *a, run=DataFrame.mapInArrow):
        def checked(batches):
            for batch in batches:
                assert batch.nbytes < most, batch.nbytes
                yield batch

        return run(self, lambda batches: f(checked(batches)), *a)

    monkeypatch.setattr(DataFrame, "mapInArrow", watched)
    for _, stage in p.STAGES:
        spark.conf.unset(name)
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
        assert stage(spark, docs, str(tmp_path)).agg({"*": "count"}).first()[0]
    spark.conf.unset(name)
