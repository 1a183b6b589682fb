"""Personal data by weak supervision, with DataFrame functions only.

Candidates are matches of loose patterns over whole texts.  Those of the base
rules (e-mail, IPv4 address, card number, phone number; a match must pass its
check) are always spans.  The others - secrets, numbers that fail a check,
national phone numbers, spelt-out addresses - become spans if the classifier
says so:

1. Four labelers vote on every candidate (1: personal, -1: not, 0: abstain):
   its strict format, a gazetteer (domains, issuers, country codes, reserved
   networks, key prefixes), the words before it, and its borders.
2. Expectation-maximisation over the vote patterns (at most 3^4 for each
   kind, counted by one aggregate) estimates how often each labeler is right
   on personal and on other candidates, and the share of personal ones per
   kind; the posterior of a pattern is the soft label of its candidates.
3. A naive-Bayes classifier over the span's own features (kind, length,
   share of digits, neighbouring characters, context word class) is trained
   on the soft labels by one aggregate over all candidates; its score decides.
4. Base spans stay.  An added span that overlaps one goes, and of added spans
   that overlap the first stays: linear sweeps over a text's spans in order.

Only sums over patterns and feature values reach the driver; their number is
bounded by the labelers and features, not by the data.

Patterns start only where a run of their characters starts and use possessive
loops: they find the same matches as the plain forms but read a long run once
and need no stack for it.

Defined results: null text is empty; repeated rows get equal results; no
candidates: nothing is learned and no span added; an empty table gives no
rows; extra columns are ignored.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import left_lookup, let, positions, running, text_hash, text_of, written

KEY = ["doc_id", "text_hash"]
KINDS = ("email", "ip", "card", "phone", "secret")
LABELERS = ("format", "gazetteer", "context", "border")
FEATURES = ("kind", "length", "digits", "before", "after", "word")

_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = (
    # kind, pattern; the first four are the base rules' patterns
    ("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    ("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]"),
    ("phone", r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("email", rf"(?<![{_LOCAL}])[{_LOCAL}]++(?:\(at\)|\[at\])[A-Za-z0-9-]++(?:(?:\(dot\)|\[dot\]|\.)[A-Za-z0-9-]++)++"),
    ("secret", r"(?<![A-Za-z0-9_])(?i:password|passwd|token|secret|api_key|apikey)[ ]?[=:][ ]?[\"']?[A-Za-z0-9+/_-]{8,}+"),
    ("secret", r"(?<![A-Za-z0-9])(?:AKIA|ghp_|sk-)[A-Za-z0-9]{16,}+"),
)
ANY = r"[0-9@]|\(at\)|\[at\]|AKIA|ghp_|sk-|(?i:password|passwd|token|secret|api_?key)"  # every pattern needs one of these

# fixed values of the gazetteers and context words
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|eu|ch|at|be|us|ca"
RESERVED_NETS = r"^(?:0|127|255|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"
COUNTRY_CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])[ (.0-9-]"
KEY_PREFIX = r"^(?:AKIA|ghp_|sk-|(?i:token|password|passwd|secret|api))"
FOR_IT = r"(?i)(?:e-?mail|contact|write to|phone|tel|call|fax|mobile|ip|server|host|card|visa|pay|credit|login|user|key|token|password)[ :=.\"']*$"
AGAINST = r"(?i)(?:version|v\.|section|isbn|issn|order|release|chapter|page|figure|§)[ :=.]*$"


def _found(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, value, left, right>> of the matches, in order."""
    rx = F.lit(pattern)
    row_type = "struct<start:int,stop:int,value:string,left:string,right:string>"

    def placed(parts, hits):
        def step(pos, i):
            value = F.get(hits, i)
            begin = pos + F.char_length(F.get(parts, i))
            stop = begin + F.char_length(value)
            row = F.struct(
                begin.alias("start"),
                stop.alias("stop"),
                value.alias("value"),
                F.right(F.get(parts, i), F.lit(24)).alias("left"),
                F.left(F.get(parts, i + 1), F.lit(1)).alias("right"),
            )
            return stop, row

        return running(positions(F.size(hits)), F.lit(0), step, row_type)

    hits = let(
        F.split(text, pattern, -1),
        lambda parts: let(F.regexp_extract_all(text, rx, F.lit(0)), lambda hits: placed(parts, hits)),
    )
    return F.when(text.rlike(pattern), hits).otherwise(F.array().cast(f"array<{row_type}>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn check of a string of up to 20 digits."""
    d = F.lpad(digits, 20, "0")
    total = F.lit(0)
    for i in range(20):
        n = F.substring(d, i + 1, 1).cast("int")
        total = total + (n if i % 2 else F.when(n > 4, 2 * n - 9).otherwise(2 * n))
    return total % 10 == 0


def _octets(value: Column) -> Column:
    """Every part at most 255, however many leading zeros."""
    part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})"
    return value.rlike(rf"^{part}(?:\.{part}){{3}}$")


def _base(kind: Column, value: Column) -> Column:
    """The base rules' checks, for matches of the base patterns."""
    n = F.length(_digits(value))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", _octets(value))
        .when(kind == "card", luhn(_digits(value)))
        .otherwise((n >= 8) & (n <= 15))
    )


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0).cast("int")


def _tagged(text: Column, i: int) -> Column:
    """Matches of pattern ``i`` with their kind."""
    kind, pattern = PATTERNS[i]
    named = [F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("number"), F.lit(i < 4).alias("ruled")]
    parts = ("start", "stop", "value", "left", "right")
    return F.transform(_found(text, pattern), lambda m: F.struct(*named, *[m[p].alias(p) for p in parts]))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, kind number, start, stop, base, votes, features)."""
    rows = docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), text_of("text").alias("text"))
    rows = rows.filter(F.col("text").rlike(ANY))
    every = F.concat(*[_tagged(F.col("text"), i) for i in range(len(PATTERNS))])
    c = rows.select(*KEY, F.inline(every))
    kind, value, left, right = (F.col(x) for x in ("kind", "value", "left", "right"))
    base = F.col("ruled") & _base(kind, value)
    digits = F.length(_digits(value))
    proper = (
        F.when(kind == "email", value.rlike(r"(?:\.|\(dot\)|\[dot\])[A-Za-z]{2,24}$"))
        .when(kind == "ip", _octets(value))
        .when(kind == "card", luhn(F.substring(_digits(value), 1, 20)))
        .when(kind == "phone", (digits >= 8) & (digits <= 15))
        .otherwise(value.rlike("[0-9]") & (F.length(value) >= 16))
    )
    known = (
        F.when(kind == "email", value.rlike(rf"(?:\.|\(dot\)|\[dot\])(?:{DOMAINS})$"))
        .when(kind == "ip", F.lit(False))
        .when(kind == "card", value.rlike(ISSUERS))
        .when(kind == "phone", value.rlike(COUNTRY_CODES))
        .otherwise(value.rlike(KEY_PREFIX))
    )
    unlikely = (
        F.when(kind == "ip", value.rlike(RESERVED_NETS))
        .when(kind == "card", _digits(value).rlike(r"^0"))
        .otherwise(F.lit(False))
    )
    loose = r"^[\s.,;:!?)\]\"'|*$%&#+/<>-]?$"
    free = (F.right(left, F.lit(1)).rlike(r"^[\s(\[\"'|*$%&#/<>:=.,-]?$")) & right.rlike(loose)
    share = F.floor(4 * digits / F.length(value)).cast("string")
    word = F.when(left.rlike(FOR_IT), "for").when(left.rlike(AGAINST), "against").otherwise("other")
    sort = lambda ch: (
        F.when(ch == "", "edge").when(ch.rlike(r"\s"), "space").when(ch.rlike("[0-9]"), "digit")
        .when(ch.rlike(r"\p{L}"), "letter").otherwise("sign")
    )
    return c.select(
        *KEY, "number", "start", "stop", base.alias("base"),
        F.array(
            _vote(proper, ~proper),
            _vote(known, unlikely),
            _vote(left.rlike(FOR_IT), left.rlike(AGAINST)),
            _vote(free, ~free),
        ).alias("votes"),
        F.array(
            kind,
            F.least(F.floor(F.length(value) / 4), F.lit(12)).cast("string"),
            share,
            sort(F.right(left, F.lit(1))),
            sort(right),
            word,
        ).alias("features"),
    )


@dataclass
class LabelModel:
    """share: prior of each kind; right: P(vote | personal?) by labeler."""

    share: list[float]
    right: list[dict[tuple[int, int], float]]  # (personal, vote) -> probability

    def posterior(self, number: Column, votes: Column) -> Column:
        odds = F.element_at(F.array(*[F.lit(log(p / (1 - p))) for p in self.share]), number + 1)
        for j, table in enumerate(self.right):
            v = F.element_at(votes, j + 1)
            odds = odds + F.element_at(
                F.array(*[F.lit(log(table[1, x] / table[0, x])) for x in (-1, 0, 1)]), v + 2
            )
        return 1 / (1 + F.exp(-odds))


def estimate(patterns: DataFrame, rounds: int = 12) -> LabelModel:
    """EM over ``patterns(number, votes, n)``; starts from labelers that are
    right in 80% of their votes."""
    start = [{(1, 1): 0.6, (1, 0): 0.25, (1, -1): 0.15, (0, 1): 0.15, (0, 0): 0.25, (0, -1): 0.6} for _ in LABELERS]
    model = LabelModel([0.5] * len(KINDS), start)
    for _ in range(rounds):
        p = model.posterior(F.col("number"), F.col("votes"))
        d = "decimal(38,9)"  # sums that do not depend on their order
        told = patterns.select(
            "number", "votes", (F.col("n") * p).cast(d).alias("yes"), (F.col("n") * (1 - p)).cast(d).alias("no")
        )
        sums = told.select(
            "yes", "no",
            F.explode(F.concat(
                F.array(F.struct(F.lit(-1).alias("j"), F.col("number").alias("v"))),
                F.transform("votes", lambda v, j: F.struct(j.alias("j"), v.alias("v"))),
            )).alias("e"),
        ).groupBy("e.j", "e.v").agg(F.sum("yes").cast("double").alias("yes"), F.sum("no").cast("double").alias("no"))
        got = {(r["j"], r["v"]): (r["yes"], r["no"]) for r in sums.collect()}  # kinds + 3 x labelers rows
        if not got:
            return model
        share = []
        for k in range(len(KINDS)):
            yes, no = got.get((-1, k), (0.0, 0.0))
            share.append((yes + 2) / (yes + no + 4))
        right = []
        for j in range(len(LABELERS)):
            rows = {x: got.get((j, x), (0.0, 0.0)) for x in (-1, 0, 1)}
            table = {}
            for c in (0, 1):
                total = sum(r[1 - c] for r in rows.values())
                # the start's probabilities as prior counts: a labeler that
                # never speaks against anything keeps its meaning
                for x in (-1, 0, 1):
                    table[c, x] = (rows[x][1 - c] + 10 * start[j][c, x]) / (total + 10)
            right.append(table)
        model = LabelModel(share, right)
    return model


def train(labelled: DataFrame) -> tuple[float, dict[tuple[int, str], float]]:
    """Prior log odds and log odds of every feature value from soft labels."""
    d = "decimal(38,9)"
    sums = (
        labelled.select(
            F.col("p").cast(d).alias("p"),
            F.posexplode(F.concat(F.array(F.lit("all")), F.col("features"))).alias("j", "v"),
        )
        .groupBy("j", "v")
        .agg(F.sum("p").cast("double").alias("yes"), F.count("*").alias("n"))
    )
    got = [(r["j"], r["v"], r["yes"], r["n"]) for r in sums.collect()]  # the features' values
    total = next(((y, n) for j, _, y, n in got if j == 0), (0.0, 0))
    yes, no = total[0] + 1, total[1] - total[0] + 1
    odds = {}
    for j, v, y, n in got:
        if j:
            odds[j - 1, v] = log((y + 1) / (yes + 2)) - log((n - y + 1) / (no + 2))
    return log(yes / no), odds


def spans(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """(doc_id, text_hash, spans array<struct<number, start, stop, base, score>>)
    of documents with candidates that are spans."""
    found = written(candidates(docs), "pii-candidates")
    patterns = found.groupBy("number", "votes").agg(F.count("*").alias("n"))
    model = estimate(written(patterns, "pii-patterns"))
    soft = found.withColumn("p", model.posterior(F.col("number"), F.col("votes")))
    prior, odds = train(soft)
    logit = F.lit(prior)
    for j in range(len(FEATURES)):
        pairs = [x for (i, v), w in sorted(odds.items()) if i == j for x in (F.lit(v), F.lit(w))]
        if pairs:
            logit = logit + F.coalesce(
                F.try_element_at(F.create_map(*pairs), F.element_at("features", j + 1)), F.lit(0.0)
            )
    scored = soft.withColumn("score", 1 / (1 + F.exp(-logit)))
    chosen = scored.filter(F.col("base") | (F.col("score") >= min_score))
    by = chosen.groupBy(*KEY).agg(
        F.collect_set(F.struct("start", (~F.col("base")).alias("added"), "number", "stop", F.round("score", 6).alias("score"))).alias("s")
    )
    return written(by.select(*KEY, _disjoint(F.col("s")).alias("spans")), "pii-spans")


def _disjoint(found: Column) -> Column:
    """All base spans, and the added ones that overlap no base span and no
    added one kept before (by start, kind, stop); in order of kind and start.

    Three sweeps over the spans in order of their start: the last stop of the
    base spans so far, their next start from behind, and the last stop kept.
    """
    row = "struct<start:int,added:boolean,number:int,stop:int,score:double,free:boolean>"
    named = ("start", "added", "number", "stop", "score")

    def with_free(x, free):
        return F.struct(*[x[n].alias(n) for n in named], free.alias("free"))

    def before(last, x):
        return F.when(x["added"], last).otherwise(F.greatest(last, x["stop"])), with_free(x, last <= x["start"])

    def behind(first, x):
        after = F.when(x["added"], first).otherwise(F.least(first, x["start"]))
        return after, with_free(x, x["free"] & (first >= x["stop"]))

    def kept(last, x):
        stay = x["free"] & (last <= x["start"])
        after = F.when(x["added"] & stay, F.greatest(last, x["stop"])).otherwise(last)
        return after, with_free(x, ~x["added"] | stay)

    far = F.lit(2**31 - 1)
    swept = let(F.sort_array(found), lambda s: running(s, F.lit(0), before, row))
    swept = let(swept, lambda s: F.reverse(running(F.reverse(s), far, behind, row)))
    swept = let(swept, lambda s: running(s, F.lit(0), kept, row))
    stay = F.transform(
        F.filter(swept, lambda x: x["free"]),
        lambda x: F.struct(
            x["number"].alias("number"), x["start"].alias("start"), x["stop"].alias("stop"),
            (~x["added"]).alias("base"), x["score"].alias("score"),
        ),
    )
    return F.sort_array(stay)


def _listed(spans_col: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans_col,
            lambda s: F.concat_ws(
                ":", F.element_at(names, s["number"] + 1), s["start"].cast("string"), s["stop"].cast("string")
            ),
        ),
        ",",
    )


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    rows = docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"))
    none = F.array().cast("array<struct<number:int,start:int,stop:int,base:boolean,score:double>>")
    both = left_lookup(rows, spans(docs), KEY).select("doc_id", F.coalesce("spans", none).alias("spans"))
    both = both.withColumn("ruled", F.filter("spans", lambda s: s["base"]))
    count = lambda k: F.size(F.filter("ruled", lambda s: s["number"] == k)).cast("long")
    return both.select(
        "doc_id",
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(_listed(F.col("ruled")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )
