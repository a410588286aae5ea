"""Quality rules, URL filters and PII against plain Python."""

import random
import re
from collections import Counter

import duckdb

from panelmc.llm import pii, quality, queries, shared, urlfilter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(t):
    t = t or ""
    ws = WORD.findall(t)
    grams = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    covered = {i + k for i in range(len(ws) - 7) if grams[tuple(ws[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def test_measurements(spark, docs):
    rng = random.Random(3)
    bits = ["aé", "b", "c\n", "#", "$x", "\t", "\n\n", "d", "\x0b", "same line here\nsame line here\n"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 50)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "w " * 5000), (63, " ".join(f"x{i % 90}" for i in range(3000))), (63, "again")]
    got = sorted((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in quality.ledger(docs(rows).withColumnRenamed("lang", "failed")).collect())
    assert got == sorted((i, counts(t)) for i, t in rows)
    assert quality.ledger(docs([])).count() == 0


def test_policies_and_ablations(spark, docs):
    rows = [(1, "fine words here " * 1 + " ".join(f"word{i}" for i in range(40))), (2, "too short"), (3, "#### " * 30), (4, None)]
    ledger = quality.ledger(docs(rows)).cache()
    v1 = {r.doc_id: (r.base_failed, r.kept) for r in quality.judged(ledger, "v1").collect()}
    assert v1[1] == (False, True) and v1[2] == (True, False) and v1[4] == (True, False)
    failed = {r.doc_id: r.failed for r in ledger.collect()}
    for a in quality.ablations(ledger).collect():
        m, b = quality.POLICIES[a.policy], quality.mask(a.rule)
        assert a.n_failed == sum(bool(f & b) for f in failed.values())
        assert a.n_only == sum(f & m == b for f in failed.values())
        assert a.n_rejected == sum(bool(f & m) for f in failed.values())


def test_clean_documents_are_kept(spark):
    d = "/root/testdata/sf0.01"
    out = quality.judged(quality.ledger(spark.read.parquet(f"{d}/documents.parquet"))).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    assert out.where("quality = 1 and not base_failed and not kept").count() == 0
    assert out.where("quality = 0 and kept").count() == 0


def verdict(url, listed):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, a) for h, p, a in listed if url is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_urls(spark):
    listed = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("org", "", "block"), ("a.b", "/x", "block"), ("b", "/x/", "allow")]
    urls = [None, "", "no scheme", "http://", "http://Example.COM/en/71?x", "https://x.example.com/en/8#en/7", "http://notexample.com/en/7", "http://org", "http://my.ORG?q=://z", "ftp://a.b/x/y", "http://c.a.b/xx", "http://b/x", "http://com/EN/", "x://é.org/ü", "http://u@h.com:80/en/", "http://example.com/en/7\nz"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate([*urls, urls[4]])], "page_id long, url string, host string")
    for own in (listed, [], [(f"h{i}.com", f"/p{i}", "block") for i in range(3000)] + listed):
        rules = spark.createDataFrame(own, "host string, path string, action string")
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, rules).collect()}
        assert got == {i: verdict(u, own) for i, u in enumerate([*urls, urls[4]])}
    assert urlfilter.judge(pages.limit(0), spark.createDataFrame(listed, "host string, path string, action string")).count() == 0


def test_the_query_judges_by_the_contracts_list(spark, tmp_path):
    """The contract's words stand here by themselves, since the query and its SQL read one list."""
    contract = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    urls = [f"https://{h}{p}1?q" for h in ("a.com", "example.com", "b.example.com", "net", "a.net", "example.net", "x.example.net", "a.org") for p in ("/en/", "/en/7", "/de/", "/de/8", "/es/", "/")]
    spark.createDataFrame(list(enumerate([*urls, None, "no scheme"])), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in queries.op3_urlfilter(spark, str(tmp_path)).collect()}
    rules = [(h, f"/{p}", a) for (h, _, p), a in ((k.partition("/"), a) for k, a in contract.items())]
    assert got == {i: verdict(u, rules) for i, u in enumerate([*urls, None, "no scheme"])}
    assert {(r, v) for _, _, r, v in got.values()} == {*contract.items(), (None, "allow")}
    pages = duckdb.read_parquet(f"{tmp_path}/pages.parquet/*.parquet")  # noqa: F841
    assert {r[0]: r[1:] for r in duckdb.sql(queries.ORACLE_SQL["op3_urlfilter"]).fetchall()} == got


def test_clashing_names_hot_and_long_urls(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", 3)
    long = "http://" + ".".join(f"l{i}" for i in range(2000)) + ".bad.org/x/" + "y" * 100_000
    urls = ["http://bad.org/x/1"] * 20 + [long, None, "no host", "http://ok.org/x/1", "http://bad.org/z"]
    pages = spark.createDataFrame([(i, u, i, i, f"{i}") for i, u in enumerate(urls)], "_at int, url string, _hot int, `_url` int, best string").repartition(3)
    listed = spark.createDataFrame([("bad.org", "/x/", "block")], "host string, path string, action string")
    out = urlfilter.judge(pages, listed).collect()
    assert {r._at: (r.url, r._hot, r._url, r.best, r.verdict) for r in out} == {i: (u, i, i, f"{i}", "block" if i < 21 else "allow") for i, u in enumerate(urls)}
    assert len(out) == len(urls) and {r.rule for r in out} == {"bad.org/x/", None}


def test_bloom_lets_all_keys_through_and_few_others(spark):
    keys = spark.range(4000).selectExpr("concat('k', id) as key")
    held, blocks = urlfilter.bloom(keys, 4000)
    words = held.scalar()
    test = lambda df: df.where(urlfilter.may_hold(words, df["key"], blocks)).count()
    assert test(keys) == 4000
    assert test(spark.range(20_000).selectExpr("concat('other', id) as key")) < 600


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, m):
    d = re.sub("[^0-9]", "", m)
    total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 16 <= len(d) <= 19 and total % 10 == 0, "phone": 8 <= len(d) <= 15}[kind]


def test_base_spans(spark, docs):
    rng = random.Random(9)
    bits = ["a", "é", "@", ".", "1", "23", "255", "256", "4111111111111111", " ", "-", "+", "_", "(", ")", "x@y.com", "+1 (555) 123-4567", "1.2.3.4", "\n", "0004"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    rows += [(400, None), (401, ""), (402, "a" * 200_000 + "@"), (403, "1" * 50_000), (404, "1." * 20_000), (405, "+1" + " (" * 20_000), (406, "😀 4111 1111-1111 1111 x@y.com_z@w.org"), (406, "1.2.3.4")]
    got = sorted((r.doc_id, [(k, s.start, s.end) for k in pii.KINDS for s in r[k] if s.held]) for r in pii.detect(docs(rows)).collect())
    want = sorted((i, [(k, m.start(), m.end()) for k, p in BASE.items() if not (i == 402 and k == "email") for m in re.finditer(p, t or "") if holds(k, m[0])]) for i, t in rows)
    assert got == want


def test_added_spans_and_empty_table(spark, docs):
    rows = [(i, f"write to joe{i} (at) mail (dot) com or call (555) 123-{4000 + i} now, mail x{i}@y.com or +1 555 123 {4000 + i}") for i in range(30)]
    out = pii.detect(docs(rows)).collect()
    assert all(len(r.email) == 2 and len(r.phone) == 2 and sum(s.held for s in r.email) == 1 for r in out)
    assert pii.detect(docs([])).count() == 0
    assert [len(r.card) for r in pii.detect(docs([(1, "card 4111111111111112")])).collect()] == [0]
