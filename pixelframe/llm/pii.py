"""Personal data by weak supervision.

Candidates are spans that a lenient pattern finds. Four labelers vote on each one (+1, -1 or
0 for no opinion): its exact shape (regex), lists of known prefixes and endings (gazetteer),
the words before it (context) and the characters around it (boundary). Votes are counted
over all documents by pattern, a table whose size the patterns bound and not the corpus;
expectation-maximisation on those counts estimates how reliable each labeler is, and a
logistic classifier over the votes is trained on the posteriors. It decides on candidates
beyond the base detections; base detections always stay.

Positions are code points, ends are exclusive. Defined results: null and empty texts have
no spans; repeated rows are treated alike; an empty table trains the prior model and gives
no rows; columns other than the id and the text pass through `redact` untouched and are
ignored elsewhere.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, running, spread, table

KINDS = ("email", "ip", "card", "phone")
#: Runs are matched possessively from their first character, so that long runs cost linear time; the matches are those of the plain patterns.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Lenient shapes that only the classifier may accept.
SPELLED_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?[(\[]dot[)\]]\x20?[A-Za-z0-9-]++)++"
LOCAL_PHONE = r"(?<![0-9+.(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
OCTETS = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
CONTEXT_CHARS = 40
LABELERS = ("regex", "gazetteer", "context", "boundary")

#: Words that announce a kind, and words that announce something else.
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write to|reach|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|client|login|logged|from)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|call|tel|telephone|mobile|cell|fax|dial|telefon|tel[eé]fono)\b",
}
COUNTER_CUES = r"(?i)(?:version|isbn|issn|order|invoice|serial|chapter|section|page|\bv)[\x20:.#]*$"
#: Endings and prefixes in common use.
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|info|io|co|de|fr|es|it|uk|us|eu|ch|at|nl|be|ca|au)$",
    "ip": r"^(?!0\.|127\.|255\.|22[4-9]\.|2[3-5][0-9]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)",
    "phone": r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9])",
}

SPAN = "struct<start:int,end:int,kind:string,base:boolean,votes:array<int>>"


def luhn(digits: Column) -> Column:
    """True for a digit string whose Luhn sum is a multiple of ten."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, d * 2).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _starts(found: Column, gaps: Column) -> Column:
    """Where each match begins, from the matches and the texts between them."""
    before = running(F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m)), lambda a, b: a + b, F.lit(0))
    return F.transform(before, lambda p, i: p + F.length(F.get(gaps, i)))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return m.rlike(OCTETS)
    if kind == "card":
        return F.when(n.between(13, 19), luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _shape(kind: str, m: Column) -> Column:
    if kind == "email":
        return m.rlike(r"(?i)^[a-z0-9][a-z0-9._%+-]*\x20?(?:@|[(\[]at[)\]])\x20?[a-z0-9-]+.*[a-z]{2,}$")
    if kind == "phone":
        return F.length(_digits(m)).between(10, 13) & m.rlike(r"[\x20().-]")
    if kind == "card":
        return _valid(kind, m) & m.rlike(r"^[0-9]+$|^[0-9]{4}([\x20-][0-9]{3,6})+$")
    return _valid(kind, m)


def _votes(kind: str, x: Column) -> Column:
    side = lambda yes: F.when(yes, 1).otherwise(-1)
    m, glued = x["m"], r"[A-Za-z0-9]"
    subject = _digits(m) if kind == "card" else m
    return F.array(
        side(_shape(kind, m)),
        side(subject.rlike(GAZETTEER[kind])),
        F.when(x["before"].rlike(COUNTER_CUES), -1).when(x["before"].rlike(CUES[kind]), 1).otherwise(0),
        side(~F.right(x["before"], F.lit(1)).rlike(glued) & ~x["after"].rlike(glued)),
    )


def _spans(kind: str, found: Column, gaps: Column, starts: Column, lenient: bool) -> Column:
    """All candidates of one pattern. Base patterns keep their failures as candidates where the shape is near: enough digits for a card or an address of four parts."""

    def near(m: Column) -> Column:
        return F.length(_digits(m)) >= 13 if kind == "card" else F.lit(True)

    # bound by let: Spark moves a column that is read once to where it is read, here into a function of each match
    rows = let(starts, lambda at: F.transform(found, lambda m, i: F.struct(F.get(at, i).alias("start"), m.alias("m"), F.right(F.get(gaps, i), F.lit(CONTEXT_CHARS)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("after"))))
    return F.transform(
        F.filter(rows, lambda x: near(x["m"])),
        lambda x: F.struct(
            x["start"].alias("start"), (x["start"] + F.length(x["m"])).alias("end"), F.lit(kind).alias("kind"),
            (F.lit(False) if lenient else _valid(kind, x["m"])).alias("base"), _votes(kind, x).alias("votes"),
        ),
    )


_PATTERNS = (("email", EMAIL, False), ("ip", IP, False), ("card", CARD, False), ("phone", PHONE, False), ("email", SPELLED_EMAIL, True), ("phone", LOCAL_PHONE, True))
#: A cheap test that a text can hold a match at all.
_NEEDS = (lambda t: F.contains(t, F.lit("@")), lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), lambda t: F.contains(t, F.lit("+")), lambda t: t.rlike(r"[(\[]dot[)\]]"), lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"))


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """row (all columns of docs) and spans: every candidate with its votes. Works on each text where it lies: no shuffle, no Python."""
    none = F.array().cast("array<string>")
    t = F.coalesce(F.col("_t"), F.lit(""))
    step = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("_t"))
    step = step.select("*", *[F.when(need(t), _found(t, p)).otherwise(none).alias(f"_m{i}") for i, ((_, p, _), need) in enumerate(zip(_PATTERNS, _NEEDS, strict=True))])
    step = step.select("*", *[F.when(F.size(f"_m{i}") > 0, F.split(t, p, -1)).otherwise(none).alias(f"_g{i}") for i, (_, p, _) in enumerate(_PATTERNS)])
    step = step.select("*", *[F.when(F.size(f"_m{i}") > 0, _starts(F.col(f"_m{i}"), F.col(f"_g{i}"))).alias(f"_s{i}") for i in range(len(_PATTERNS))])
    parts = [F.when(F.size(f"_m{i}") > 0, _spans(k, F.col(f"_m{i}"), F.col(f"_g{i}"), F.col(f"_s{i}"), lenient)).otherwise(F.array().cast(f"array<{SPAN}>")) for i, (k, _, lenient) in enumerate(_PATTERNS)]
    step = step.withColumn("_all", F.concat(*parts))
    return step.select("row", _apart(F.col("_all")).alias("spans"))


def _apart(spans: Column) -> Column:
    """Drops candidates beyond the base that overlap a base span; base spans stay. In order of their starts, a span meets a base span if one before it ends later than it starts, or the next one starts before it ends."""
    far = F.lit((1 << 31) - 1)

    def kept(s: Column) -> Column:
        ends = running(F.transform(s, lambda x: F.when(x["base"], x["end"]).otherwise(0)), lambda a, b: F.greatest(a, b), F.lit(0))
        nexts = F.reverse(running(F.reverse(F.transform(s, lambda x: F.when(x["base"], x["start"]).otherwise(far))), lambda a, b: F.least(a, b), far))
        return let(ends, lambda e: let(nexts, lambda n: F.filter(s, lambda x, i: x["base"] | ((F.get(e, i) <= x["start"]) & (F.get(n, i) >= x["end"])))))

    all_base = F.size(F.filter(spans, lambda s: s["base"])) == F.size(spans)
    return F.when(all_base, spans).otherwise(let(F.array_sort(spans), kept))


@dataclass
class Model:
    """Reliability of each labeler, and a logistic classifier over votes and kind."""

    reliability: dict[str, tuple[float, float]]
    bias: dict[str, float]
    weights: list[float]
    threshold: float = 0.95

    def accepts(self, s: Column) -> Column:
        """The classifier's verdict on a span as a Column."""
        z = F.lit(0.0)
        for kind, b in self.bias.items():
            z = F.when(s["kind"] == kind, F.lit(b)).otherwise(z)
        for j, w in enumerate(self.weights):
            z = z + F.get(s["votes"], F.lit(j)) * F.lit(w)
        return z >= math.log(self.threshold / (1 - self.threshold))


def vote_counts(spans: DataFrame) -> list[tuple[str, bool, tuple[int, ...], int]]:
    """How often each kind came with each combination of votes, over all rows. At most 2 x 4 x 54 rows."""
    got = spread(spans.select("spans"), F.col("spans"), "s").groupBy("s.kind", "s.base", "s.votes").agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted((r["kind"], r["base"], tuple(r["votes"]), r["n"]) for r in got)


def fit(counts: list[tuple[str, bool, tuple[int, ...], int]], rounds: int = 40, epochs: int = 300) -> Model:
    """EM over the vote patterns, then logistic regression on the posteriors.

    Each labeler has the rate at which it says yes to true spans and to others; each kind has
    a prior. Base spans anchor the true class. Pseudo-counts keep every rate inside (0, 1) and
    let the empty table train to the prior model.
    """
    k = len(LABELERS)
    yes_true, yes_other, prior = [0.9] * k, [0.4] * k, dict.fromkeys(KINDS, 0.5)
    posterior = [0.5] * len(counts)
    squash = lambda z: 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    for _ in range(rounds):
        for i, (kind, base, votes, _n) in enumerate(counts):
            z = math.log(prior[kind] / (1 - prior[kind]))
            for t, o, v in zip(yes_true, yes_other, votes, strict=True):
                z += math.log(t / o) if v > 0 else math.log((1 - t) / (1 - o)) if v < 0 else 0.0
            posterior[i] = max(0.99, squash(z)) if base else squash(z)
        for j in range(k):
            yes, cast = [9.0, 4.0], [10.0, 10.0]
            for (_, _, votes, n), p in zip(counts, posterior, strict=True):
                if votes[j]:
                    for y, share in enumerate((p, 1 - p)):
                        cast[y] += n * share
                        yes[y] += n * share * (votes[j] > 0)
            yes_true[j], yes_other[j] = (min(0.995, max(0.005, a / b)) for a, b in zip(yes, cast, strict=True))
        for kind in KINDS:
            mine = [(n, p) for (kd, _, _, n), p in zip(counts, posterior, strict=True) if kd == kind]
            prior[kind] = min(0.95, max(0.05, (2 + sum(n * p for n, p in mine)) / (4 + sum(n for n, _ in mine))))
    odds = [(math.log(t / o), math.log((1 - t) / (1 - o))) for t, o in zip(yes_true, yes_other, strict=True)]
    weights, shift = [max(0.0, (a - b) / 2) for a, b in odds], sum((a + b) / 2 for a, b in odds)
    bias = {kind: math.log(p / (1 - p)) + shift for kind, p in prior.items()}
    total = sum(n for *_, n in counts) or 1
    for _ in range(epochs):
        gw, gb = [0.0] * k, dict.fromkeys(KINDS, 0.0)
        for (kind, _, votes, n), p in zip(counts, posterior, strict=True):
            d = (p - squash(bias[kind] + sum(w * v for w, v in zip(weights, votes, strict=True)))) * n / total
            gb[kind] += d
            for j, v in enumerate(votes):
                gw[j] += d * v
        weights = [max(0.0, w + 0.5 * g) for w, g in zip(weights, gw, strict=True)]
        bias = {kind: b + 0.5 * gb[kind] for kind, b in bias.items()}
    return Model({n: (t, o) for n, t, o in zip(LABELERS, yes_true, yes_other, strict=True)}, bias, weights)


def detect(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """row and spans as in candidates(), with the spans that hold: base detections, and the candidates that the classifier accepts."""
    return candidates(docs, text).withColumn("spans", F.filter("spans", lambda s: s["base"] | model.accepts(s)))


def _named(spans: Column, base_only: bool = False) -> Column:
    """kind:start:end, by kind as listed, then start."""

    def of(kind: str) -> Column:
        mine = F.filter(spans, lambda s: (s["kind"] == kind) & (s["base"] if base_only else F.lit(True)))
        placed = F.array_sort(F.transform(mine, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
        return F.transform(placed, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    return F.array_join(F.concat(*[of(kind) for kind in KINDS]), ",")


def op1_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents: votes counted over all of them, EM, classifier, verdicts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = detect(docs, fit(vote_counts(candidates(docs))))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "row.doc_id", *[n(k) for k in KINDS],
        F.sha2(_named(F.col("spans"), base_only=True).cast("binary"), 256).alias("base_sha256"), _named(F.col("spans")).alias("spans"),
    )


#: Spans of a text from which on it is cut by characters, as finding a place in a string takes time in proportion to it.
MANY_SPANS = 500


def redact(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans are replaced together under the first one's kind. Null and empty texts stay as they are, repeated rows are treated alike, other columns pass through, an empty table stays empty."""
    found = detect(docs, model, text)
    spans = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    body = F.coalesce(F.col("row")[text], F.lit(""))
    found = found.select("row", spans.alias("_s"), body.alias("_t")).withColumn("_p", running(F.transform("_s", lambda s: s["end"]), lambda a, b: F.greatest(a, b), F.lit(0)))
    found = found.withColumn("_c", F.when(F.size("_s") > MANY_SPANS, F.regexp_extract_all("_t", F.lit("(?s)."), F.lit(0))))
    chars = F.col("_c")

    def between(a: Column, b: Column) -> Column:
        return F.when(chars.isNull(), F.substring("_t", a + 1, b - a)).otherwise(F.array_join(F.slice(chars, a + 1, b - a), ""))

    pieces = F.transform("_s", lambda s, i: F.when(s["start"] < F.get("_p", i), F.lit("")).otherwise(F.concat(between(F.get("_p", i), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))))
    last = F.greatest(F.get("_p", F.size("_p") - 1), F.get("_s", F.size("_s") - 1)["end"])
    clean = F.concat(F.array_join(pieces, ""), F.substring("_t", last + 1, F.length("_t")))
    changed = F.when(F.size("_s") > 0, clean).otherwise(F.col("row")[text])
    return found.select(*[changed.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def redact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced; n_chars follows the new text. The model is fitted on this stage's own input."""
    model = fit(vote_counts(candidates(docs.select("text"))))
    clean = redact(docs, model)
    return clean.select("doc_id", "text", "lang", "source", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")).alias("n_chars"))
