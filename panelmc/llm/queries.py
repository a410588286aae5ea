"""The registered queries of the operators: thin, each over its whole table, with what DuckDB can state beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmc.llm import decontam, langid, linededup, ngramjoin, packing, pii, quality, toxicity, urlfilter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_ngramjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.near_duplicates(table(spark, sf_dir, "documents"), size=4, num=85)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(quality.ledger(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("failed").alias("failed_bits"))


#: The contract's list: beginnings of canonical URLs and what they say.
LISTED = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op3_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(("host", "path", "action"), r, strict=True)]) for r in LISTED])))
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), listed).select("page_id", "host", "path", "rule", "verdict")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.detect(table(spark, sf_dir, "documents"))

    def listed(base: bool) -> Column:
        def named(k: str) -> Column:
            own = F.filter(k, lambda x: x["held"]) if base else F.col(k)
            return F.transform(own, lambda x: F.concat_ws(":", F.lit(k), x["start"].cast("string"), x["end"].cast("string")))

        return F.array_join(F.concat(*map(named, pii.KINDS)), ",")

    counts = [F.size(F.filter(k, lambda x: x["held"])).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return out.select("doc_id", *counts, F.sha2(listed(True), 256).alias("base_sha256"), listed(False).alias("spans"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = langid.split(0, 5)
    ids, weight = toxicity.chosen(labels.where(~held_out))
    # about 2 * FIT_ROWS ids
    model = toxicity.fit(docs.join(F.broadcast(ids), "doc_id").select("text", "toxic"), weight)
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.split(2, 4)
    model = langid.fit(docs.where(~held_out).select("text", "lang"))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {f.__name__: f for f in (op1_quality, op2_decontamination, op3_urlfilter, op4_pii, op5_packing, op6_linededup, op7_toxicity, op8_ngramjoin, op9_langid, op10_warc)}

WS = r"[^\x20\x09-\x0D]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_quality": rf"""
with d as (select doc_id, coalesce(text, '') as t, row_number() over () as r from documents),
w as (select r, doc_id, t, regexp_extract_all(t, '{WS}') as words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WS}')) as lines from d),
g as (select r, unnest(range(1, greatest(len(words) - 6, 1))) as i, words from w),
k as (select r, i, count(*) over (partition by r, array_to_string(words[i:i + 7], ' ')) as n from g),
p as (select distinct r, i + o as at from k, range(0, 8) as s(o) where n > 1),
c as (select r, count(*) as n_repeat from p group by r),
s as (select r, count(*) as n_stutter from (select r, unnest(range(1, greatest(len(words), 1))) as i, words from w) where words[i] = words[i + 1] group by r),
m as (select doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
  (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n_repeat, 0)::bigint as n_repeat_words, len(lines) as n_lines, len(regexp_extract_all(t, '!')) as n_exclaim,
  len(regexp_extract_all(t, '\p{{Lu}}')) as n_capitals, coalesce(n_stutter, 0) as n_stutter
  from w left join c using (r) left join s using (r)),
b as (select *, (case when n_words < 20 then 1 else 0 end + case when 100 * n_repeat_words > 30 * n_words then 2 else 0 end + case when 10 * n_symbols > 3 * n_words then 4 else 0 end
  + case when 2 * n_dup_lines > n_lines then 8 else 0 end + case when 10 * n_exclaim > 3 * n_words then 16 else 0 end + case when 10 * n_capitals > 4 * word_chars then 32 else 0 end
  + case when 10 * n_stutter > 3 * n_words then 64 else 0 end + case when word_chars > 16 * n_words or word_chars < 2 * n_words then 128 else 0 end)::bigint as failed_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 as base_failed, failed_bits = 0 as kept, failed_bits from b""",
    "op2_decontamination": rf"""
with d as (select doc_id, row_number() over () as r, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
i as (select item_id, ws, least(10, len(ws)) as k from b where len(ws) > 0),
g as (select distinct item_id, k, array_to_string(ws[a:a + k - 1], ' ') as gram from (select item_id, ws, k, unnest(range(1, len(ws) - k + 2)) as a from i)),
x as (select r, k, a, array_to_string(ws[a:a + k - 1], ' ') as gram from (select r, ws, k, unnest(range(1, greatest(len(ws) - k + 2, 1))) as a from d, (select distinct k from g))),
h as (select r, x.k, a, item_id from x join g using (k, gram)),
n as (select r, count(distinct a + o) as n_hit from h, range(0, 10) as s(o) where o < k group by r),
t as (select r, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct item_id::varchar)), ',') as ids from h group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (r) left join t using (r)""",
    "op3_urlfilter": rf"""
with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, {LOWER.format("regexp_extract(rest, '^[^/?#]*')")} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r(rh, rp, action) as (values {", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in LISTED)})
select page_id, host, path, arg_max(rh || rp, length(rh || rp)) as rule, coalesce(arg_max(action, length(rh || rp)), 'allow') as verdict
from h left join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id, host, path""",
    "op6_linededup": rf"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select doc_id, unnest(lines) as line, unnest(range(len(lines))) as i from d),
k as (select doc_id, line, i, {LOWER.format("regexp_replace(line, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')")} as key from l),
s as (select key, min(doc_id) as keeper from k where length(key) >= 10 group by key having count(distinct doc_id) > 1),
j as (select k.*, coalesce(keeper <> doc_id, false) as gone from k left join s using (key))
select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256 from j group by doc_id""",
    "op10_warc": r"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes from pages),
f as (select hex, min(page_id) as first from p group by hex)
select page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(((('0x' || hex[5 * (k // 4) + 1:5 * (k // 4) + 5])::bigint) >> (15 - 5 * (k % 4))) & 31) + 1]), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from p join f using (hex)""",
}
