"""Personal data by weak supervision, with DataFrame functions only.

Base spans are what the four patterns and their checks find; they always stay. Looser patterns, and one for secrets, propose
further spans in what the kinds before leave over, so that no two spans touch. Matches of the four patterns that their checks
refuse, and runs of letters and digits in quotes or after a sign that nothing calls a secret, are decoys: what wrong spans
look like. Labelers (patterns, gazetteers, context words)
vote on all of them; expectation-maximisation over the counts of vote patterns, a table of at most
kinds * 2 ** labelers rows, estimates how reliable each labeler is on each kind, and a linear classifier of votes and kind is
trained on the posterior labels. Proposals that it accepts are added.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, spread, stage

_LOCAL = "[A-Za-z0-9._%+-]"
#: Same matches as the plain patterns; guards and possessive quantifiers keep long runs from being tried again from within.
BASE = {
    "email": f"(?:(?<!{_LOCAL})|\\G){_LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:(?<![0-9])|\\G)[0-9]++(?:\\.[0-9]++){3}",
    "card": "[0-9](?:[\\x20-]?[0-9]){15}(?:[\\x20-]?[0-9])*+",  # runs of fewer digits fail the check anyhow
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_NAMED = "token|secret|password|passwd|api[_-]?key|access[_-]?key"
#: Looser patterns, by the kind of the span that they propose. A named secret's span is its value.
LOOSE = {
    "email": "(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,40}\\x20?(?:(?:\\(at\\)|\\[at\\])\\x20?[A-Za-z0-9-]{2,40}\\x20?(?:\\(dot\\)|\\[dot\\]|\\x20dot\\x20|\\.)|at\\x20[A-Za-z0-9-]{2,40}\\x20dot)\\x20?[A-Za-z]{2,10}",
    "ip": "(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": "(?<![0-9-])[0-9]{4}[\\x20-]?[0-9]{6}[\\x20-]?[0-9]{3,5}(?![0-9-])",
    "phone": "(?<![0-9+(])(?:\\([0-9]{3}\\)\\x20?|[0-9]{3}[.\\x20-])[0-9]{3}[.\\x20-][0-9]{4}(?![0-9])",
    "secret": f"(?<![A-Za-z0-9+/_-])(?:AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{20,64}}|sk-[A-Za-z0-9]{{20,64}}|[0-9a-f]{{32,64}}|(?<=(?i:{_NAMED})[\"']?\\x20{{0,2}}[=:]\\x20{{0,2}}[\"']?)[A-Za-z0-9+/_.-]{{8,128}})(?![A-Za-z0-9])",
}
LOOSE_NEEDS = {
    "email": "\\(at\\)|\\[at\\]|\\x20at\\x20\\S+\\x20dot\\x20", "ip": "(?:[0-9A-Fa-f]{1,4}:){7}", "card": "[0-9]{4}[\\x20-]?[0-9]{6}", "phone": "[0-9]{3}[.\\x20-][0-9]{4}",
    "secret": f"AKIA|gh[pousr]_|sk-|[0-9a-f]{{32}}|(?i:{_NAMED})[\"']?\\x20{{0,2}}[=:]",
}
KINDS = ("email", "ip", "card", "phone", "secret")
CONTEXT = {
    "email": ("mail", "contact", "write", "@", "reply"), "ip": ("ip", "server", "host", "address", "login", "from"), "card": ("card", "visa", "master", "amex", "pay", "credit", "konto", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "whatsapp"), "secret": ("key", "password", "secret", "token", "aws", "login"),
}
TOP_LEVEL = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info")
LABELERS = ("strict", "gazetteer", "context", "edges", "mixed", "not_dull")
_ROW = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


#: Quoted runs that no name of a secret stands before: decoys for that kind, as it has no base pattern.
UNNAMED = f"(?<![A-Za-z0-9+/_-])(?<!(?i:{_NAMED})[\"']?\\x20{{0,2}}[=:]\\x20{{0,2}}[\"'])(?<=[\"'=:])[A-Za-z0-9+/_.-]{{8,128}}(?=[\"']|$)"
BASE_SPAN, PROPOSED, DECOY = 1, 0, -1

#: Pieces that are listed at once: lists are grown in parts, as growing one copies it.
_RUN = 256


def _pieces(text: Column, pattern: str) -> Column:
    """The text cut at its leftmost non-overlapping matches: what is between them, and, at odd places, the matches. ``text`` must not hold U+0001."""
    return F.split(F.regexp_replace(text, F.lit(pattern), F.lit("\u0001$0\u0001")), "\u0001", -1)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, value, before, after), places in code points.

    ``before``: the 32 characters before it at most, as far as the match before; ``after``: the character after it.
    """
    nothing = F.array().cast(_ROW)

    def step(acc: Column, piece: Column) -> Column:
        to = acc["at"] + piece["n"]
        found = F.array(F.struct(acc["at"].alias("start"), to.alias("end"), *[piece[x].alias(x) for x in ("value", "before", "after")]))
        return F.struct(to.alias("at"), F.when(piece["value"].isNotNull(), F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"))

    def listed(pieces: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_ROW}>").alias("out"))

        def part(acc: Column, k: Column) -> Column:
            done = F.aggregate(F.slice(pieces, k * _RUN + 1, F.lit(_RUN)), F.struct(acc["at"].alias("at"), nothing.alias("out")), step)
            return F.get(F.transform(F.array(done), lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out"))), 0)

        return F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / _RUN).cast("int")), begin, part)["out"])

    def placed(pieces: Column) -> Column:
        match = lambda i, value: F.when(i % 2 == 1, value)
        return F.transform(pieces, lambda p, i: F.struct(F.length(p).alias("n"), match(i, p).alias("value"), match(i, F.right(F.get(pieces, i - 1), F.lit(32))).alias("before"), match(i, F.left(F.get(pieces, i + 1), F.lit(1))).alias("after")))

    return F.get(F.transform(F.transform(F.array(_pieces(text, pattern)), placed), listed), 0)


def blanked(text: Column, pattern: str, valid) -> Column:
    """The text with U+0002 in the place of its valid matches, so that nothing else is found there."""
    shown = F.transform(_pieces(text, pattern), lambda p, i: F.when((i % 2 == 1) & valid(p), F.repeat(F.lit("\u0002"), F.length(p))).otherwise(p))
    return F.array_join(shown, "")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def part(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + part(i)) % 10 == 0


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.regexp_like(value, F.lit(f"^{_PART}(?:\\.{_PART}){{3}}$"))
    if kind == "card":
        n = F.length(_digits(value))
        return F.when((n >= 16) & (n <= 19), luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def base_matches(text: Column, kind: str) -> Column:
    """All matches of a base pattern, also those that its check refuses."""
    needed = text.contains(NEEDED[kind]) if NEEDED[kind] else F.regexp_like(text, F.lit("[0-9](?:[\\x20-]?[0-9]){15}"))
    return F.when(needed, matches(text, BASE[kind])).otherwise(F.array().cast(_ROW))


#: Longest match that passes for a decoy: what is longer is no span that anybody proposes.
LONGEST_DECOY = 64


def _checked(column: str, kind: str, right: bool) -> Column:
    return F.filter(column, lambda s: _valid(kind, s["value"]) if right else (F.length(s["value"]) <= LONGEST_DECOY) & ~_valid(kind, s["value"]))


def _needs(text: Column, kind: str) -> Column:
    return F.regexp_like(text, F.lit(LOOSE_NEEDS[kind]))


def loose_spans(text: Column, kind: str) -> Column:
    return F.when(_needs(text, kind), matches(text, LOOSE[kind])).otherwise(F.array().cast(_ROW))


def _votes(kind: str, span: Column) -> Column:
    """An integer with a bit for each of LABELERS: what each says about the span."""
    value, digits = span["value"], _digits(span["value"])
    before = F.lower(span["before"])
    around = F.concat(F.right(before, F.lit(1)), F.lit(" "), span["after"])
    strict = {
        "email": F.regexp_like(value, F.lit("^[A-Za-z0-9][A-Za-z0-9._%+-]*(?:@|\\W+at\\W+)[A-Za-z0-9-]+(?:(?:\\.|\\W+dot\\W+)[A-Za-z0-9-]+)*(?:\\.|\\W+dot\\W+)[A-Za-z]{2,10}$")),
        "ip": ~F.regexp_like(value, F.lit("^(?:0|127|255)\\.")), "card": F.when(F.length(digits) > 0, luhn(digits)).otherwise(False),
        "phone": F.regexp_like(digits, F.lit("^[1-9][0-9]{9,12}$")), "secret": F.regexp_like(value, F.lit("^(?=.*[0-9])(?=.*[A-Za-z]).{12}")),
    }[kind]
    gazetteer = {
        "email": F.regexp_like(F.lower(value), F.lit(f"(?:{'|'.join(TOP_LEVEL)})$")), "ip": F.regexp_like(F.lower(value), F.lit("^(?:10|1[0-9][0-9]|2[0-2][0-9]|[1-9]?[0-9])\\.|^(?:[23][0-9a-f]{3}|f[cd][0-9a-f]{2}|fe80):")),
        "card": F.regexp_like(digits, F.lit("^(?:4|5[1-5]|2[2-7]|3[47]|6)")), "phone": F.regexp_like(digits, F.lit("^(?:1?[2-9][0-9]{2}[2-9]|3[0-9]|4[0-9])")), "secret": F.regexp_like(value, F.lit("^(?:AKIA|gh[pousr]_|sk-|(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$|(?=.*[0-9].*[0-9])(?=.*[A-Za-z].*[A-Za-z]).{10})")),
    }[kind]
    context = F.regexp_like(before, F.lit("|".join(CONTEXT[kind])))
    edges = ~F.regexp_like(around, F.lit("[\\p{L}\\p{N}]"))
    mixed = F.length(F.array_join(F.array_distinct(F.split(value, "")), "")) >= 5
    not_dull = ~F.regexp_like(digits, F.lit("^(.)\\1+$|^0+|12345678"))
    bits = [F.when(v, 1 << i).otherwise(0) for i, v in enumerate((strict, gazetteer, context, edges, mixed, not_dull))]
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return total


def _proposed(docs: DataFrame) -> DataFrame:
    """(doc_id, base: by kind (start, end), more: by kind (start, end, votes)): all that later steps need of the texts."""
    docs = spread(docs, ["doc_id", "text"]).select("doc_id", F.translate(F.coalesce("text", F.lit("")), "\u0001", "\u0002").alias("text"))
    for kind in BASE:
        docs = docs.withColumn(f"m_{kind}", base_matches(F.col("text"), kind)).withColumn(f"b_{kind}", _checked(f"m_{kind}", kind, True))
    docs = docs.withColumn("d_secret", F.when(F.regexp_like("text", F.lit(UNNAMED)), matches(F.col("text"), UNNAMED)).otherwise(F.array().cast(_ROW)))
    # what the looser patterns see: base spans, and then each kind's proposals, are blanked for those that follow
    docs = docs.withColumn("open", F.col("text")).withColumn("loose", functools.reduce(Column.__or__, [_needs(F.col("text"), k) for k in KINDS]))
    for kind in BASE:
        docs = docs.withColumn("open", F.when(F.col("loose") & (F.size(f"b_{kind}") > 0), blanked(F.col("open"), BASE[kind], lambda v, kind=kind: _valid(kind, v))).otherwise(F.col("open")))
    for kind in KINDS:
        docs = docs.withColumn(f"l_{kind}", F.when(F.col("loose"), loose_spans(F.col("open"), kind)).otherwise(F.array().cast(_ROW)))
        docs = docs.withColumn("open", F.when(F.size(f"l_{kind}") > 0, blanked(F.col("open"), LOOSE[kind], lambda v: F.lit(True))).otherwise(F.col("open")))

    def voted(kind: str, column: str | Column, known: int) -> Column:
        return F.transform(column, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _votes(kind, s).alias("votes"), F.lit(known).alias("known")))

    columns = [voted(k, f"b_{k}", BASE_SPAN).alias(f"b_{k}") for k in BASE] + [voted(k, f"l_{k}", PROPOSED).alias(f"l_{k}") for k in KINDS]
    decoys = [voted(k, "d_secret" if k == "secret" else _checked(f"m_{k}", k, False), DECOY).alias(f"d_{k}") for k in KINDS]
    return docs.select("doc_id", *columns, *decoys)


#: How many spans the rates of all kinds together count for among a kind's own.
PULL = 10


def reliabilities(counts: list[tuple[str, int, int, int]], rounds: int = 40) -> dict:
    """Posterior by (kind, votes, known), and by kind each labeler's chances to speak for (wrong, right) spans, by EM over vote counts.

    Base spans are known to be right for all but 2 in 100, decoys to be wrong as often; proposals start by their share of
    votes. A kind's chances are drawn to those of all kinds, which decide alone where a kind has few spans. A labeler speaks
    for right spans at least as often as for wrong ones: where the counts say otherwise, it has no say, so that a span's
    posterior never falls as votes for it are added.
    """
    many, kinds = len(LABELERS), sorted({k for k, *_ in counts})
    post = {(k, v, b): {BASE_SPAN: 0.98, DECOY: 0.02}.get(b, 0.25 + 0.5 * bin(v).count("1") / many) for k, v, b, _ in counts}
    theta: dict[str, list[list[float]]] = {}

    def sums(y: int, kind: str | None) -> tuple[float, list[float]]:
        rows = [(v, n * (post[k, v, b] if y else 1 - post[k, v, b])) for k, v, b, n in counts if kind in (None, k)]
        return sum(w for _, w in rows), [sum(w for v, w in rows if v >> j & 1) for j in range(many)]

    for _ in range(rounds):
        theta = {k: [[0.0, 0.0] for _ in range(many)] for k in kinds}
        for y in (0, 1):
            weight, said = sums(y, None)
            pooled = [(s + (0.3 if y == 0 else 0.7)) / (weight + 1) for s in said]
            for k in kinds:
                weight, said = sums(y, k)
                for j in range(many):
                    theta[k][j][y] = min(0.99, max(0.01, (said[j] + PULL * pooled[j]) / (weight + PULL)))
        for k in kinds:
            theta[k] = [t if t[0] <= t[1] else [sum(t) / 2] * 2 for t in theta[k]]
        for kind in kinds:
            proposed = [(v, n) for k, v, b, n in counts if k == kind and b == PROPOSED]
            right = sum(n * post[kind, v, PROPOSED] for v, n in proposed) + PULL / 2
            prior = min(0.95, max(0.05, right / (sum(n for _, n in proposed) + PULL)))
            for v, b in {(v, b) for k, v, b, _ in counts if k == kind}:
                t = theta[kind]
                z = math.log(prior / (1 - prior)) + sum(math.log(t[j][1] / t[j][0]) if v >> j & 1 else math.log((1 - t[j][1]) / (1 - t[j][0])) for j in range(many))
                chance = 1 / (1 + math.exp(-max(-30, min(30, z))))
                post[kind, v, b] = max(0.98, chance) if b == BASE_SPAN else min(0.02, chance) if b == DECOY else chance
    return {"posterior": post, "theta": theta}


def span_classifier(counts: list[tuple[str, int, int, int]], post: dict, rounds: int = 400, rate: float = 1.0) -> tuple[dict[str, list[float]], dict[str, float]]:
    """Weights of the labelers' votes and a bias for each kind: logistic regressions on the posterior labels, by gradient steps over vote counts.

    A kind's weights are drawn to nothing, and none is below 0. Base spans and decoys count together no more than a kind's proposals, where
    it has any, as these are what is decided about.
    """
    weights, bias = {}, {}
    for kind in KINDS:
        rows = [(v, b, n) for k, v, b, n in counts if k == kind]
        mine, others = (sum(n for _, b, n in rows if (b == PROPOSED) == own) for own in (True, False))
        share = min(1.0, mine / others) if mine and others else 1.0
        rows = [(v, post[kind, v, b], n * (1.0 if b == PROPOSED else share)) for v, b, n in rows]
        total, w, x = sum(n for *_, n in rows) or 1.0, [0.0] * len(LABELERS), 0.0
        for _ in range(rounds):
            slope, base = [0.001 * total * c for c in w], 0.0
            for v, y, n in rows:
                g = n * (1 / (1 + math.exp(-max(-30, min(30, x + sum(c for j, c in enumerate(w) if v >> j & 1))))) - y)
                base += g
                for j in range(len(w)):
                    slope[j] += g if v >> j & 1 else 0
            w = [max(0.0, c - rate * s / total) for c, s in zip(w, slope, strict=True)]
            x -= rate * base / total
        weights[kind], bias[kind] = w, x
    return weights, bias


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) for every row of ``docs`` (doc_id, text): arrays of (kind, start, end) in order of kind and start.

    Null and empty texts have no spans. Rows that repeat are searched each. An empty table gives no rows, and with no
    spans at all nothing is added. Time grows in proportion to a text's length and to the number of its matches.
    """
    found = stage(_proposed(docs), "spans")
    parts = [found.select(F.lit(k).alias("kind"), F.inline(F.concat(*[c for c in (f"b_{k}", f"l_{k}", f"d_{k}") if c in found.columns]))) for k in KINDS]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    counted = rows.groupBy("kind", "votes", "known").count().collect()  # len(KINDS) * 2 ** len(LABELERS) * 3 rows at most
    counts = sorted((r["kind"], r["votes"], r["known"], r["count"]) for r in counted)
    post = reliabilities(counts)["posterior"]
    weights, bias = span_classifier(counts, post)

    def plain(kind: str, column: str | Column) -> Column:
        return F.transform(column, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    def added(kind: str) -> Column:
        accepted = [v for v in range(1 << len(LABELERS)) if bias[kind] + sum(w for j, w in enumerate(weights[kind]) if v >> j & 1) > 0]
        return plain(kind, F.filter(f"l_{kind}", lambda s: s["votes"].isin(accepted)))

    found = found.withColumn("base", F.concat(*[plain(k, f"b_{k}") for k in BASE])).withColumn("taken", F.concat("base", *[added(k) for k in KINDS]))
    ordered = F.concat(*[F.array_sort(_of("taken", k)) for k in KINDS])
    return found.select("doc_id", "base", ordered.alias("spans"))


def _of(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(read(spark, sf_dir, "documents"))
    numbers = [F.size(_of("base", k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *numbers, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))
