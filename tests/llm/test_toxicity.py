import itertools

import numpy as np

from panelmc.llm import toxicity
from panelmc.llm.toxicity import Field, fit, score


def test_marginals_against_all_tag_sequences():
    rng = np.random.default_rng(4)
    f = Field({}, rng.normal(size=(2, 4)), rng.normal(size=(2, 2)), rng.normal(size=2))
    for _ in range(30):
        x = rng.choice([0, 0, 0, 1, 2, 3], rng.integers(1, 9))
        total, toxic = 0.0, np.zeros(len(x))
        for tags in itertools.product((0, 1), repeat=len(x)):
            w = np.exp(f.first[tags[0]] + sum(f.emit[t, s] for t, s in zip(tags, x, strict=True)) + sum(f.move[a, b] for a, b in itertools.pairwise(tags)))
            total += w
            toxic += w * np.array(tags)
        at, chance = f.marginals(x)
        assert np.allclose(chance, (toxic / total)[at])


def test_long_plain_stretches_are_exact():
    rng = np.random.default_rng(5)
    f = Field({}, rng.normal(size=(2, 3)) * 0.3, np.array([[6.0, -6.0], [-6.0, 6.0]]), rng.normal(size=2))
    x = np.zeros(1500, int)
    x[[3, 603, 1203]] = 2, 1, 2
    ahead, back = np.empty((1500, 2)), np.ones((1500, 2))
    v = np.exp(f.first) * np.exp(f.emit[:, x[0]])
    for t in range(1500):
        v = v if not t else ahead[t - 1] @ np.exp(f.move) * np.exp(f.emit[:, x[t]])
        ahead[t] = v / v.sum()
    for t in range(1498, -1, -1):
        v = np.exp(f.move) @ (np.exp(f.emit[:, x[t + 1]]) * back[t + 1])
        back[t] = v / v.sum()
    want = (ahead * back)[:, 1] / (ahead * back).sum(1)
    at, chance = f.marginals(x)
    assert at.tolist() == [3, 603, 1203] and np.allclose(chance, want[at], rtol=1e-9)


def log_likelihood(f, x, y, size, weight):
    """By all tag sequences."""
    out = 0.0
    for row, tags, n, w in zip(x, y, size, weight, strict=True):
        def energy(t, row=row, n=n):
            return f.first[t[0]] + sum(f.emit[t[i], row[i]] for i in range(n)) + sum(f.move[t[i], t[i + 1]] for i in range(n - 1))

        out += w * (energy(tags) - np.log(sum(np.exp(energy(t)) for t in itertools.product((0, 1), repeat=n))))
    return out


def test_gradient_and_training_against_all_tag_sequences():
    rng = np.random.default_rng(6)
    f = Field({}, rng.normal(size=(2, 3)), rng.normal(size=(2, 2)), rng.normal(size=2))
    x, y, size, weight = rng.integers(0, 3, (4, 5)), rng.integers(0, 2, (4, 5)), np.array([5, 3, 1, 4]), np.array([1.0, 2.0, 0.5, 3.0])
    for p, g in zip((f.emit, f.move, f.first), toxicity.gradient(f, x, y, size, weight), strict=True):
        for i in np.ndindex(p.shape):
            old = p[i]
            p[i] = old + 1e-5
            high = log_likelihood(f, x, y, size, weight)
            p[i] = old - 1e-5
            low = log_likelihood(f, x, y, size, weight)
            p[i] = old
            assert abs((high - low) / 2e-5 - g[i]) < 1e-6
    before = log_likelihood(f, x, y, size, weight)
    toxicity.train(f, x, y, size, weight)
    assert log_likelihood(f, x, y, size, weight) > before + 1


def test_held_out_and_spans(spark):
    bad, plain = ["vile", "nasty", "foul"], [f"word{i}" for i in range(300)]
    rng = np.random.default_rng(2)
    rows = []
    for i in range(600):
        ws = list(rng.choice(plain, 40))
        toxic = int(i % 4 == 0)
        for b in rng.choice(bad, 2) if toxic else []:
            ws[rng.integers(40)] = b + rng.choice(["", "ish", "ly"])
        rows.append((i, " ".join(ws), toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = fit(docs.where("doc_id < 400").select("text", "toxic"))
    got = score(docs.where("doc_id >= 400"), model).collect()
    assert sum((r.score >= 0.5) == (r.toxic == 1) for r in got) / len(got) > 0.97
    for r in got:
        for s in r.spans:
            assert all(w.startswith(tuple(bad)) for w in r.text[s.start : s.end].split()) and (s.start == 0 or r.text[s.start - 1] == " ")
        assert not r.spans or r.score >= 0.5
    accents = spark.createDataFrame([(1, "é Ünï vile, \u6f22 Nasty nasty", 0)], "doc_id long, text string, spans int")
    assert [("é Ünï vile, \u6f22 Nasty nasty"[s.start : s.end]) for s in score(accents, model).first().spans] == ["vile", "Nasty nasty"]
    edges = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "vile " * 20_000, 0), (4, " ", None), (4, " ", None)], "doc_id long, text string, score long")
    out = {r.doc_id: r.score for r in score(edges, model).collect()}
    assert out[1] == out[2] == out[4] < 0.5 <= out[3] <= 1
    assert score(edges.limit(0), model).count() == 0


def test_one_label_only(spark):
    docs = spark.createDataFrame([("a b c", 1), ("d", None)], "text string, toxic int")
    assert [r.score > 0.9 for r in score(docs, fit(docs)).collect()] == [True, True]
    assert [r.score < 0.1 for r in score(docs, fit(docs.where("toxic = 0"))).collect()] == [True, True]


def test_held_out_rows_of_the_table(spark):
    from panelmc.llm.queries import op7_toxicity

    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = [r for r in op7_toxicity(spark, "/root/testdata/sf0.1").where("held_out").collect() if r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in got) / len(got) > 0.95
    assert toxicity.FIT_ROWS == 8000
