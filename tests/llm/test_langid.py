import math
import random
from zlib import crc32

import numpy as np
import pyarrow as pa

from panelmc.llm import langid
from panelmc.llm.langid import ORDER, SYMBOLS, fit, predict, split, unfit


def lowered(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())


def plain_ppm(texts, probe, order=ORDER, kept=None):
    """Bits of probe under texts: method C from the longest context seen in any language's training (or in kept) down to the uniform choice."""
    seen = {}
    for t in texts:
        t = b"\n" * order + lowered(t)
        for i in range(order, len(t)):
            for k in range(order + 1):
                seen.setdefault(t[i - k : i], {}).setdefault(t[i], 0)
                seen[t[i - k : i]][t[i]] += 1

    def chance(context, b):
        below = chance(context[1:], b) if context else 1 / SYMBOLS
        own = seen.get(context)
        if not own or kept is not None and context not in kept:
            return below
        return (own.get(b, 0) + len(own) * below) / (sum(own.values()) + len(own))

    p = b"\n" * order + lowered(probe)
    return sum(-math.log2(chance(p[i - order : i], p[i])) for i in range(order, len(p)))


def test_code_lengths_against_a_plain_ppm(spark):
    rng = random.Random(3)
    texts = {k: ["".join(rng.choice(a) for _ in range(rng.randint(1, 40))) for _ in range(12)] + [texts] for k, a, texts in (("a", "abc é\n", "the cat"), ("b", "bcd üX", "Die Katze"), ("c", "az", ""))}
    rows = spark.createDataFrame([(t, k) for k, own in texts.items() for t in [*own, own[0]]], "text string, lang string").repartition(3)
    probes = ["the cat", "", "abc é abé", "bcdüxXQ", "zzzz\n\n", "Ж漢", "a"]
    got, plain = fit(rows).bits(pa.array([*probes, None]))
    assert got.shape == (8, 3) and (got[-1] == 0).all()
    for i, p in enumerate(probes):
        assert np.allclose(got[i], [plain_ppm(set(texts[k]), p) for k in "abc"], rtol=1e-4)
        assert np.allclose(plain[i], sum(-math.log2(np.mean([2 ** -plain_ppm(set(texts[k]), chr(b) if b < 128 else "", 0) for k in "abc"])) for b in lowered(p)), rtol=1e-4) or not p.isascii()


def test_few_nodes_are_those_seen_most(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_NODES", 3)
    text = "abababab xyz"
    model = fit(spark.createDataFrame([(text, "a")], "text string, lang string"))
    padded = b"\n" * ORDER + text.encode()
    counts = {}
    for i in range(ORDER, len(padded)):
        for k in range(2, ORDER + 1):
            counts[k, padded[i - k : i]] = counts.get((k, padded[i - k : i]), 0) + 1
    kept = {c for (_, c), _ in sorted(counts.items(), key=lambda x: (-x[1], x[0][0], int.from_bytes(x[0][1], "big")))[:3]}
    kept |= {padded[i - k : i] for i in range(ORDER, len(padded)) for k in (0, 1)}
    assert np.allclose(model.bits(pa.array(["abab", "xyz"]))[0][:, 0], [plain_ppm([text], p, kept=kept) for p in ("abab", "xyz")], rtol=1e-4)
    # in every context the chances of all bytes sum to one
    seen = model.cost.shape[1] - 1
    total = np.exp2(-model.cost[:, 1:, 0]).sum(1) + np.exp2(-model.cost[:, 0, 0]) * (SYMBOLS - seen)
    assert np.allclose(total, 1, atol=1e-4)


def test_held_out_accuracy_and_edges(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit(rows.where(~split(2, 4)).select("text", "lang"))
    got = predict(rows.select("doc_id", "text", "lang"), model).where(split(2, 4)).collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.98
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !?", "x"), (4, "the and of " * 5000, "x"), (4, "the and of " * 5000, "x")], "doc_id long, text string, score string")
    out = {r.doc_id: (r.lang_pred, r.score) for r in predict(odd, model).collect()}
    assert [out[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and out[4][0] == "en" and 0 < out[4][1] <= 1
    assert predict(odd, model).count() == 5 and predict(odd.limit(0), model).count() == 0


def test_texts_that_no_language_fits(spark):
    rng = random.Random(1)
    words = ["the", "and", "house", "river", "stone", "green"]
    rows = spark.createDataFrame([(" ".join(rng.choice(words) for _ in range(80)), "en") for _ in range(60)], "text string, lang string")
    noise = "".join(rng.choice("!#%&qQxXzZ0123456789+/=jJkKwWvV") for _ in range(600))
    probe = spark.createDataFrame([(1, "the green river and the stone house"), (2, noise), (3, None), (4, "A."), (5, "12")], "doc_id long, text string")
    assert {r.doc_id for r in predict(probe, fit(rows)).where(unfit()).collect()} == {2, 3, 5}


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([("text", None), (None, "en")], "text string, lang string")
    probe = spark.createDataFrame([(1, "word")], "doc_id long, text string")
    assert [r.lang_pred for r in predict(probe, fit(none)).collect()] == ["und"]
    # empty texts of one language: it is known, though nothing is
    assert [r.lang_pred for r in predict(probe, fit(spark.createDataFrame([("", "en")], "text string, lang string"))).collect()] == ["en"]


def test_split_is_by_crc32_of_the_id_as_text(spark):
    got = {r.doc_id: r.h for r in spark.range(300).withColumnRenamed("id", "doc_id").select("doc_id", split(2, 4).alias("h")).collect()}
    assert got == {i: crc32(str(i).encode()) % 4 == 2 for i in range(300)}


def test_bounded_fit_is_by_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(langid, "FIT_BYTES", 40)
    rows = spark.createDataFrame([("aaaa bbbb " * 3, "x"), ("cc dd", "y"), ("cc dd ee", "y")], "text string, lang string")
    assert fit(rows).languages == ["x", "y"]
