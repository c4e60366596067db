"""Personal data in texts: labelers vote, EM weighs them, a span classifier decides.

Only built-in functions touch rows; what reaches the driver is one row per
pattern of votes, which the number of labelers bounds.  The project's records
hold no personal data, so the interface is general: ``text_id`` and ``text``.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import stored

#: The base patterns.  Possessive quantifiers and look-behinds keep
#: each one linear and without recursion; they match what the plain forms match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What the method may add: national phone numbers, identity numbers, account numbers.
OTHER = (
    r"(?<![0-9A-Za-z+.(-])(?:\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}"
    r"|[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+)(?![0-9A-Za-z-])"
)
KINDS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "other": OTHER}

_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Gazetteers and context words.
DOMAINS = "com org net edu gov io co uk de fr es it nl eu info".split()
DIALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 55 61 81 86 90 91".split()
CONTEXT = "call tel phone fax mobile mail email contact card visa account iban ssn address host from write".split()
AGAINST = "token version build order invoice item part page sha key id no".split()

#: Characters before a span that the context labelers read.
BEFORE = 24

#: Posterior that a span outside the base rules needs to be added.
CERTAIN = 0.9

LABELERS = ("shape", "gazetteer", "context", "against", "length")
SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string,valid:boolean,piece:string,before:string>"


def _found(text: Column, kind: str) -> Column:
    """All matches of a pattern with their places in code points.

    The pieces between matches and the matches themselves come from the same
    scan order, so places are running sums of lengths.
    """
    pattern = KINDS[kind]
    rank = list(KINDS).index(kind)
    pieces = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, piece: F.struct(gap.alias("gap"), piece.alias("piece")),
    )
    walked = F.aggregate(
        F.filter(pieces, lambda p: p["piece"].isNotNull()),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.expr(f"CAST(array() AS array<{SPAN}>)").alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["gap"]) + F.length(p["piece"])).cast("bigint").alias("at"),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        (acc["at"] + F.length(p["gap"])).cast("bigint").alias("start"),
                        F.lit(rank).alias("rank"),
                        (acc["at"] + F.length(p["gap"]) + F.length(p["piece"])).cast("bigint").alias("end"),
                        F.lit(kind).alias("kind"),
                        F.coalesce(_valid(kind, p["piece"]), F.lit(False)).alias("valid"),
                        p["piece"].alias("piece"),
                        F.lower(F.substring(p["gap"], -BEFORE, BEFORE)).alias("before"),
                    )
                ),
            ).alias("out"),
        ),
    )
    return walked["out"]


def _digits(piece: Column) -> Column:
    return F.regexp_replace(piece, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits carry a right check digit."""
    ones = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda x: x != ""),
        lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(
            (x.cast("int") * 2) - F.when(x.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(ones, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, piece: Column) -> Column:
    if kind == "ip":
        return piece.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        n = F.length(_digits(piece))
        return F.when(n.between(12, 19), luhn(_digits(piece))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(piece)).between(9, 15)
    return F.lit(kind == "email")


def _any_word(text: Column, words: list[str]) -> Column:
    return text.rlike(r"(?:^|[^a-z])(?:" + "|".join(words) + r")[^a-z0-9]*$")


def votes(s: Column) -> dict[str, Column]:
    """Each labeler's vote on a candidate span: 1 for, -1 against, 0 none."""
    kind, piece, before = s["kind"], s["piece"], s["before"]
    n = F.length(_digits(piece))
    known = (
        F.when(kind == "email", F.lower(F.substring_index(piece, ".", -1)).isin(DOMAINS))
        .when(kind == "ip", ~piece.rlike("^0*(?:0|22[4-9]|2[3-9][0-9])\\."))
        .when(kind == "card", piece.rlike("^[3-6]"))
        .when(kind == "phone", piece.rlike(r"^\+(?:" + "|".join(DIALLING) + ")"))
    )
    usual = (
        F.when(kind == "email", F.length(piece).between(6, 64))
        .when(kind == "ip", n.between(4, 12))
        .when(kind == "card", n.isin(13, 15, 16))
        .when(kind == "phone", n.between(10, 13))
        .otherwise(F.length(piece).between(10, 34))
    )
    sign = lambda c: F.when(c, 1).when(~c, -1).otherwise(0)
    return {
        "shape": F.when(kind == "other", 0).otherwise(sign(s["valid"])),
        "gazetteer": sign(known),
        "context": F.when(_any_word(before, CONTEXT), 1).otherwise(0),
        "against": F.when(_any_word(before, AGAINST) | before.rlike("[0-9#=.]$"), -1).otherwise(0),
        "length": sign(usual),
    }


def reliabilities(patterns: dict[tuple[int, ...], int], rounds: int = 60) -> tuple[dict, list[dict]]:
    """EM for a two-class model with independent labelers, on counts of vote patterns.

    Returns the posterior of each pattern and each labeler's vote tables.
    """
    total = sum(patterns.values())
    post = {p: 1 / (1 + math.exp(-1.5 * sum(p))) for p in patterns}
    tables: list[dict] = []
    for _ in range(rounds):
        yes = sum(post[p] * c for p, c in patterns.items())
        prior = (yes + 1) / (total + 2)
        tables = []
        for j in range(len(LABELERS)):
            table = {}
            for v in (-1, 0, 1):
                a = sum(post[p] * c for p, c in patterns.items() if p[j] == v)
                b = sum((1 - post[p]) * c for p, c in patterns.items() if p[j] == v)
                # a labeler is taken to be better than chance
                table[v] = ((a + 1 + (v > 0)) / (yes + 4), (b + 1 + (v < 0)) / (total - yes + 4))
            tables.append(table)
        for p in patterns:
            odds = math.log(prior / (1 - prior)) + sum(
                math.log(tables[j][v][0] / tables[j][v][1]) for j, v in enumerate(p)
            )
            post[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post, tables


def features(s: Column) -> list[Column]:
    """Bounded features of a span, as texts."""
    v = votes(s)
    n = F.least(F.length(_digits(s["piece"])), F.lit(24))
    marks = F.regexp_replace(F.regexp_replace(s["piece"], "[0-9]+", "9"), "[A-Za-z]+", "a")
    return [
        F.concat(F.lit("kind "), s["kind"], F.lit(" "), v["shape"].cast("string")),
        F.concat(F.lit("digits "), n.cast("string")),
        F.concat(F.lit("marks "), F.pmod(F.xxhash64(marks), F.lit(512)).cast("string")),
        F.concat(F.lit("near "), v["context"].cast("string"), F.lit(" "), v["against"].cast("string")),
        F.concat(F.lit("known "), v["gazetteer"].cast("string"), F.lit(" "), v["length"].cast("string")),
    ]


def train(candidates: DataFrame) -> tuple[float, dict[str, float]]:
    """Prior log odds and weights of the span classifier, from all candidates.

    The votes of all spans are counted by pattern, EM gives each pattern a
    posterior, and the weights are log ratios of posterior mass by feature.
    """
    spans = candidates.select(F.explode("candidates").alias("s"))
    named = [c.cast("int").alias(k) for k, c in votes(F.col("s")).items()]
    rows = spans.select(F.col("s"), *named).groupBy(*LABELERS).count().collect()
    patterns = {tuple(r[k] for k in LABELERS): r["count"] for r in rows}
    if not patterns:
        return -10.0, {}
    post, _ = reliabilities(patterns)
    y = F.lit(0.0)
    for p, x in post.items():
        hit = F.lit(True)
        for k, v in zip(LABELERS, p):
            hit = hit & (F.col(k) == v)
        y = F.when(hit, F.lit(x)).otherwise(y)
    mass = (
        spans.select(F.col("s"), *named)
        .select(F.explode(F.array(*features(F.col("s")))).alias("feature"), y.alias("y"))
        .groupBy("feature").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    )
    yes = sum(post[p] * c for p, c in patterns.items())
    no = sum(patterns.values()) - yes
    weights = {
        r["feature"]: math.log((r["a"] + 1) / (yes + 2)) - math.log((r["b"] + 1) / (no + 2)) for r in mass.collect()
    }
    return math.log((yes + 1) / (no + 1)), weights


def find_personal_data(texts: DataFrame) -> DataFrame:
    """Spans of personal data in texts ``(text_id, text)``.

    Returns ``text_id, base, spans``: arrays of ``(start, rank, end, kind)`` in
    code points, end exclusive, by start and then kind.  ``base`` has the valid
    matches of the four base patterns; ``spans`` also has spans of kind
    ``other`` that the trained classifier is certain of and that no base span
    overlaps.

    Null and empty texts have no span.  Repeated rows give equal results.  An
    empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    needs = {"email": text.contains("@"), "phone": text.contains("+")}
    none = F.expr(f"CAST(array() AS array<{SPAN}>)")
    digit = text.rlike("[0-9]")
    parts = [F.when(needs.get(k, digit), _found(text, k)).otherwise(none) for k in KINDS]
    candidates = stored(texts.select("text_id", F.array_sort(F.concat(*parts)).alias("candidates")))
    prior, weights = train(candidates)

    slim = lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"])
    base = F.transform(F.filter("candidates", lambda s: s["valid"]), slim)
    if weights:
        table = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(w)) for k, w in weights.items()))

        def certain(s: Column) -> Column:
            odds = F.lit(prior)
            for f in features(s):
                odds = odds + F.coalesce(F.try_element_at(table, f), F.lit(0.0))
            return odds > math.log(CERTAIN / (1 - CERTAIN))

        more = F.filter("candidates", lambda s: (s["kind"] == "other") & certain(s))
        apart = F.filter(
            more,
            lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
        )
        spans = F.array_sort(F.concat("base", F.transform(apart, slim)))
    else:
        spans = F.col("base")
    return candidates.withColumn("base", base).select("text_id", "base", spans.alias("spans"))
