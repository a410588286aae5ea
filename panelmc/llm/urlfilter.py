"""URL filters (operator 3): a blocked Bloom filter of listed canonical URLs before an exact hash join. DataFrame functions only.

An entry is a canonical beginning of URLs: host and path. A page's candidates are its host's endings times its path's beginnings of the lengths that the list has;
the filter leaves few of them, and the exact join removes what it let through wrongly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmc.llm.shared import looked_up, stored

LANES = 8
PROBES = 4
#: Blocks of LANES 64-bit words. Past this bound (8 MB) the filter is fuller and lets more through to the exact join.
MOST_BLOCKS = 1 << 17
KEYS_PER_BLOCK = 40


def lower(text: Column | str) -> Column:
    """A-Z lower-cased, other letters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or end, A-Z lower-cased; path: then up to ? # or end. Null or no ://: both empty."""
    rest = F.when(url.contains("://"), F.substr(url, F.locate("://", url) + 3)).otherwise("")
    host = lower(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def one_bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def probes(key: Column) -> list[tuple[Column, Column]]:
    """(lane, bit) of each probe of a key."""
    h = F.xxhash64(key, F.lit("probe"))
    return [(F.shiftrightunsigned(h, 9 * i).bitwiseAND(F.lit(LANES - 1)).cast("int"), F.shiftrightunsigned(h, 9 * i + 3).bitwiseAND(F.lit(63)).cast("int")) for i in range(PROBES)]


def bloom(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """One row with `words`, the filter of keys (column key) as an array of 64-bit words, block after block; and the number of blocks."""
    blocks = max(1, min(MOST_BLOCKS, -(-n // KEYS_PER_BLOCK)))
    each = F.explode(F.array(*[F.struct(lane.alias("lane"), one_bit(bit).alias("bits")) for lane, bit in probes(F.col("key"))]))
    bits = keys.select(block_of(F.col("key"), blocks).alias("block"), each.alias("p"))
    lanes = bits.groupBy("block").agg(*[F.bit_or(F.when(F.col("p.lane") == i, F.col("p.bits"))).alias(f"lane{i}") for i in range(LANES)])
    whole = keys.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block")).join(lanes, "block", "left")
    words = F.array(*[F.coalesce(f"lane{i}", F.lit(0).cast("long")) for i in range(LANES)])
    # at most MOST_BLOCKS rows
    held = whole.agg(F.array_sort(F.collect_list(F.struct("block", words.alias("words")))).alias("e"))
    return held.select(F.flatten(F.transform("e", lambda x: x["words"])).alias("words")), blocks


def may_hold(words: Column, key: Column, blocks: int) -> Column:
    base = block_of(key, blocks) * LANES
    test = F.lit(True)
    for lane, bit in probes(key):
        test = test & (F.get(words, base + lane).bitwiseAND(one_bit(bit)) != 0)
    return test


def judge(pages: DataFrame, listed: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict.

    listed: host, path, action. An entry fits its host and all subdomains, if the page's path starts with its own; the longest (then the
    longest host, then the first by text) wins, and its host and path are the rule, its action the verdict. Where none fits, rule is null and verdict is `default`.
    Null urls have neither host nor path; an entry with an empty host fits those alone. Repeated entries count once, the smaller action first; columns of these names are replaced, others stay whatever
    their names; repeated pages are each a row; an empty table gives none.
    """
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    listed = listed.groupBy(lower("host").alias("host"), "path").agg(F.min("action").alias("action")).withColumn("key", F.concat("host", "path"))
    n, lengths = listed.agg(F.count("*"), F.array_sort(F.collect_set(F.length("path")))).first()
    # columns go by number to the joins and back, so that theirs can't clash with these
    host, path = host_and_path(F.col(f"`{url}`"))
    rows = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], host.alias("host"), path.alias("path"))
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    if not n:
        return rows.select(*own, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    held, blocks = bloom(listed.select("key"), n)
    labels = F.split("host", r"\.", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    # distinct lengths of the list's paths; a path has no beginning longer than itself
    beginnings = F.transform(F.filter(F.lit(lengths).cast("array<int>"), lambda k: k <= F.length("path")), lambda k: F.substr(F.col("path"), F.lit(1), k))
    place = f"c{names.index(url)}"
    wanted = rows.where(F.col(place).isNotNull()).groupBy(F.col(place).alias("url"), "host", "path").agg(F.count("*").alias("n"))
    wanted = wanted.withColumns({"hosts": hosts, "paths": beginnings})
    pairs = F.flatten(F.transform("hosts", lambda h: F.transform("paths", lambda p: F.struct(h.alias("host"), p.alias("path")))))
    # one row, written once, so that the plan's mentions of it don't make it anew
    words = stored(held, "bloom").scalar()
    hits = wanted.select("url", "n", F.explode(pairs).alias("c")).where(may_hold(words, F.concat("c.host", "c.path"), blocks))
    found = hits.select("url", "n", "c.host", "c.path").join(listed, ["host", "path"])
    order = F.struct(F.length("key"), F.length("host"), F.col("key"))
    best = found.groupBy("url").agg(F.first("n").alias("n"), F.max_by(F.struct("key", "action"), order).alias("best"))
    out = looked_up(rows, place, best.withColumnRenamed("url", place), "best")
    return out.select(*own, "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
