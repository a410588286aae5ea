"""PII (operator 4): weak supervision. DataFrame functions only; the fit works on sums of bounded size.

Candidates are matches of each kind's strict pattern and of wider ones. Labelers vote on each: the pattern, its checksum or
structure, a gazetteer, the words before it, and its surroundings. Expectation-maximisation over the votes' patterns estimates how
reliable each labeler is; the posteriors train the span classifier, which decides on candidates of the wider patterns. Strict matches that
the strict rules hold are spans in any case; those that they drop (a card number that fails its checksum) are known to be none.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmc.llm.shared import stored

KINDS = ("email", "ip", "card", "phone")
#: The strict patterns. Possessive, and anchored where a leftmost match can begin, so that no text makes them
#: slow: inside a run of its first class a match begins at the run's start or where the last match ended.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15}(?:[\x20-]?[0-9])*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Spellings beside the strict ones: an address with words for its signs, a number without country code.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+.()-])(?<![0-9+][\x20])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])",
}
#: What a text must have for a pattern to be tried.
HINT = {"email": "@", "phone": "+"}
#: Gazetteer: ends of mail hosts, first digits of cards, country codes; and words that go before.
TOP_DOMAINS = "com|org|net|edu|gov|int|mil|info|biz|io|co|ai|app|dev|de|fr|es|it|uk|us|eu|ch|at|nl|be|pl|pt|br|mx|ar|ca|au|jp|cn|in|ru|se|no|dk|fi"
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|address|correo|courriel|kontakt)\W{0,4}(?:\w+\W{1,3}){0,2}$",
    "ip": r"(?i)(?:\bip\b|ipv4|server|host|address|addr|ping|from)\W{0,4}(?:\w+\W{1,3}){0,2}$",
    "card": r"(?i)(?:card|visa|master|amex|credit|debit|karte|carte|tarjeta)\W{0,4}(?:\w+\W{1,3}){0,2}$",
    "phone": r"(?i)(?:phone|tel|call|mobile|cell|fax|telefon|tél|llame)\W{0,4}(?:\w+\W{1,3}){0,2}$",
}
LABELERS = ("strict", "check", "gazetteer", "context", "edges")
BEFORE = 40
ROUNDS = 50
CAND = "array<struct<start: long, end: long, held: boolean, votes: int, digits: int, size: int>>"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes."""
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int"))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def within(kind: str, m: Column) -> Column:
    """The strict rule on a strict match."""
    n = F.length(digits(m))
    if kind == "ip":
        # a part is 255 at most: leading zeros aside, three digits or fewer and so much by value
        return F.forall(F.split(m, r"\."), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return (n >= 16) & (n <= 19) & luhn(digits(m))
    if kind == "phone":
        return (n >= 8) & (n <= 15)
    return F.lit(True)


def check(kind: str, m: Column, strict: bool) -> Column:
    """The labeler of structure."""
    n = F.length(digits(m))
    if kind == "phone":
        return (n >= 10) & (n <= 13) & ~digits(m).rlike("^([0-9])\\1*$")
    if kind == "email":
        return m.rlike(r"[A-Za-z]") & m.rlike(r"[A-Za-z]{2,}$")
    return within(kind, m) if strict else F.lit(False)


def gazetteer(kind: str, m: Column) -> Column:
    if kind == "email":
        return m.rlike(rf"(?i)(?:\.|dot[)\]]\x20?)(?:{TOP_DOMAINS})$")
    if kind == "ip":
        return ~m.rlike(r"^(?:0|10|127|22[4-9]|2[3-5][0-9])\.|^192\.168\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.")
    if kind == "card":
        return m.rlike(r"^(?:4|5[1-5]|2[2-7]|3[4-7]|6[0-9])")
    return m.rlike(r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])") | m.rlike(r"^\(?[2-9][0-9]{2}")


def found(text: Column, kind: str, pattern: str, strict: bool) -> Column:
    """Candidates of one pattern: the texts between matches and the matches, laid end to end, give places in code points."""
    pieces = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(pieces, 1, F.size(hits)), hits, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("m"), F.right(p, F.lit(BEFORE)).alias("before")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, m: string, before: string>>").alias("out"))
    placed = F.aggregate(
        pairs,
        start,
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + F.length(x["m"])).alias("at"), F.array_append(a["out"], F.struct((a["at"] + x["gap"]).alias("start"), x["m"].alias("m"), x["before"].alias("before"))).alias("out")
        ),
        lambda a: a["out"],
    )

    def candidate(x: Column) -> Column:
        m = x["m"]
        votes = (F.lit(strict), check(kind, m, strict), gazetteer(kind, m), x["before"].rlike(CUES[kind]), (x["before"] == "") | x["before"].rlike(r"[\s\"'(\[<:;,=|]$"))
        held = within(kind, m) if strict else F.lit(False)
        return F.struct(
            x["start"].alias("start"),
            (x["start"] + F.length(m)).alias("end"),
            held.alias("held"),
            sum((F.when(v, F.lit(1 << i)).otherwise(F.lit(0)) for i, v in enumerate(votes)), F.lit(0)).alias("votes"),
            F.least(F.length(digits(m)), F.lit(24)).alias("digits"),
            F.least(F.floor(F.length(m) / 8), F.lit(6)).cast("int").alias("size"),
        )

    return F.transform(placed, candidate).cast(CAND)


def apart(wide: Column, strict: str) -> Column:
    """Those of wide that don't meet any of strict."""
    return F.filter(wide, lambda x: ~F.exists(strict, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and, for each kind, its candidates: strict ones in order, then wider ones that meet none of them."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    none = F.array().cast(CAND)
    t = F.col("t")
    hint = {"email": t.contains("@"), "phone": t.contains("+"), "ip": t.rlike(STRICT["ip"]), "card": t.rlike(STRICT["card"])}
    wide_hint = {"email": t.rlike(r"[(\[]at[)\]]"), "phone": t.rlike(r"[0-9]{3}[.-][0-9]{4}")}
    out = text.select("doc_id", "t", *[F.when(hint[k], found(t, k, STRICT[k], True)).otherwise(none).alias(k) for k in KINDS])
    for k in WIDE:
        out = out.withColumn(f"{k}_wide", F.when(wide_hint[k], apart(found(t, k, WIDE[k], False), k)).otherwise(none))
    return out.select("doc_id", *[F.concat(k, f"{k}_wide").alias(k) if k in WIDE else F.col(k) for k in KINDS])


@dataclass
class Classifier:
    """reliability: of each kind and labeler, its chance of a vote for private and for other spans; weights: log odds of the span classifier by
    kind, feature and value; bias by kind."""

    reliability: dict[tuple[str, str], tuple[float, float]]
    weights: dict[tuple[str, str, int], float]
    bias: dict[str, float]

    def chance(self, kind: str, x: Column) -> Column:
        """Of a candidate being private."""
        odds = F.lit(self.bias.get(kind, -20.0))
        for name, value in features(x).items():
            own = {v: w for (k, f, v), w in self.weights.items() if (k, f) == (kind, name)}
            if own:
                table = F.create_map(*[F.lit(y) for y in chain.from_iterable(own.items())])
                odds = odds + F.coalesce(F.try_element_at(table, value), F.lit(0.0))
        return 1 / (1 + F.exp(-odds))


def features(x: Column) -> dict[str, Column]:
    return {**{name: F.shiftright(x["votes"], i).bitwiseAND(F.lit(1)) for i, name in enumerate(LABELERS)}, "digits": x["digits"], "size": x["size"]}


def fit(found_: DataFrame) -> Classifier:
    """From candidates() of all documents: sums by kind and votes (32 for each kind at most), and by kind, votes and feature."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("all")) for k in KINDS])
    rows = found_.select(F.explode(each).alias("k")).select("k.kind", F.explode("k.all").alias("x"))
    dropped = (F.col("x.votes").bitwiseAND(F.lit(1)) == 1) & ~F.col("x.held")
    sums = rows.groupBy("kind", "x.votes", dropped.alias("dropped"), "x.digits", "x.size").agg(F.count("*").alias("n")).collect()
    reliability, weights, bias = {}, {}, {}
    for kind in KINDS:
        own = [r for r in sums if r.kind == kind]
        patterns: dict[tuple[int, bool], int] = {}
        for r in own:
            patterns[r.votes, r.dropped] = patterns.get((r.votes, r.dropped), 0) + r.n
        if not patterns:
            continue
        post, rates = em(patterns)
        for i, name in enumerate(LABELERS):
            reliability[kind, name] = rates[i]
        yes = sum(post[r.votes, r.dropped] * r.n for r in own)
        total = sum(r.n for r in own)
        bias[kind] = math.log((yes + 1) / (total - yes + 1))
        names = [*LABELERS, "digits", "size"]
        values = [([*(r.votes >> i & 1 for i in range(len(LABELERS))), r.digits, r.size], post[r.votes, r.dropped] * r.n, r.n) for r in own]
        for j, name in enumerate(names):
            for v in {x[0][j] for x in values}:
                a = sum(y for x, y, _ in values if x[j] == v)
                n = sum(m for x, _, m in values if x[j] == v)
                k = len({x[0][j] for x in values})
                weights[kind, name, v] = math.log((a + 1) / (yes + k)) - math.log((n - a + 1) / (total - yes + k))
    return Classifier(reliability, weights, bias)


def em(patterns: dict[tuple[int, bool], int]) -> tuple[dict[tuple[int, bool], float], list[tuple[float, float]]]:
    """Posterior of each pattern (votes, whether a strict rule drops it) and the labelers' rates. Two classes, votes independent in each. Starts from
    reliable labelers; a Beta prior keeps rates off 0 and 1. What a strict rule drops is in the class of other spans throughout."""
    k = len(LABELERS)
    share, rates = 0.5, [(0.8, 0.2)] * k
    post = dict.fromkeys(patterns, 0.0)
    for _ in range(ROUNDS):
        for v, dropped in patterns:
            odds = math.log(share / (1 - share))
            for i, (a, b) in enumerate(rates):
                odds += math.log(a / b) if v >> i & 1 else math.log((1 - a) / (1 - b))
            post[v, dropped] = 0.0 if dropped else 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
        yes = sum(post[p] * n for p, n in patterns.items())
        total = sum(patterns.values())
        share = (yes + 2) / (total + 4)
        for i in range(k):
            a = sum(post[p] * n for p, n in patterns.items() if p[0] >> i & 1)
            b = sum((1 - post[p]) * n for p, n in patterns.items() if p[0] >> i & 1)
            rates[i] = ((a + 8) / (yes + 10), (b + 2) / (total - yes + 10))
    return post, rates


def detect(docs: DataFrame, least: float = 0.9) -> DataFrame:
    """doc_id, and for each of KINDS an array of (start, end, held, strict, chance) in order of start: the spans that the strict rules hold (held),
    and those that the classifier gives a chance of `least` or more. Places are in code points, end exclusive. Null texts are empty; rows with equal doc_ids are each a row."""
    rows = stored(candidates(docs), "candidates")
    model = fit(rows)

    def kept(kind: str) -> Column:
        scored = F.transform(kind, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["held"].alias("held"), (x["votes"].bitwiseAND(F.lit(1)) == 1).alias("strict"), model.chance(kind, x).alias("chance")))
        return F.array_sort(F.filter(scored, lambda x: x["held"] | ~x["strict"] & (x["chance"] >= least)))

    return rows.select("doc_id", *[kept(k).alias(k) for k in KINDS])
