r"""Personal data by weak supervision, in DataFrame functions only.

1. Candidates: leftmost non-overlapping matches of each kind's pattern, with code-point offsets, also those that fail the
   kind's validation; besides them, obfuscated mail addresses and key/value secrets.
2. Labelers vote on each candidate (1, 0 = abstains, -1): a regex/validation labeler, a gazetteer labeler (mail suffixes,
   issuer and country prefixes, reserved addresses, key names), a context labeler (cue words before the candidate) and a
   boundary labeler. Equal vote and feature patterns are counted; there are at most a few thousand patterns, whatever
   the size of the corpus.
3. Expectation-maximisation over these counts estimates each labeler's reliability per kind and each pattern's posterior.
4. A logistic regression over span features is fitted to the posteriors. It decides about candidates that are not base
   spans; base spans (valid matches) always stay.

The patterns are the contract's, rewritten with possessive quantifiers and guards against rescans, so a run of 100,000
digits or letters costs linear time and no stack.

Offsets are running totals over matches and context comes from a text's blocks, so many matches in one text cost hardly more than as many in several.

Defined cases: null text is empty and has no spans; spans added by the method that overlap a base span of any kind are
dropped; repeated rows are judged each; other columns stay, but for one with the name of the result; an empty table gives no rows and the default model.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.functions import scalars as S
from veldra.llm.common import unused

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
HIDDEN_EMAIL = r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?[\[(]at[\])] ?[a-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[a-z0-9-]++)++"
SECRET = r"(?i)(?<![a-z0-9])(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?[a-z0-9+/_-]{6,}+"
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")

# fixed values: gazetteers and cue words
MAIL_ENDS = r"\.(com|net|org|edu|gov|mil|int|info|biz|name|pro|coop|museum|aero|jobs|mobi|travel|app|dev|cloud|online|shop|site|store|tech|xyz|blog|email|[a-z]{2})$"
ISSUERS = r"^(4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|3[47]|30[0-59]|3[689]|35[2-8]|6011|64[4-9]|65|62)"
# country calling codes in use, by zones
COUNTRIES = r"^\+(1|7|2[07]|21[12368]|2[23][0-9]|24[0-9]|25[0-8]|26[0-9]|29[01789]|3[0-469]|35[0-9]|37[0-8]|38[0-35-79]|4[013-9]|42[013]|5[1-8]|50[0-9]|59[0-9]|6[0-6]|67[02-9]|68[0-35-9]|69[0-2]|8[1246]|80[08]|85[02356]|87[0-9]|88[0-368]|9[0-58]|96[0-8]|97[0-79]|99[2-689])"
RESERVED = r"^(0|127|255)\."
CUES = {
    "email": r"(mail|contact|write|address)",
    "ip": r"(\bip\b|host|server|addr)",
    "card": r"(card|visa|credit|payment|karte|tarjeta|carte)",
    "phone": r"(phone|tel|call|mobile|fax|cell)",
    "secret": r"(login|user|key|auth|credential)",
}
COUNTER_CUES = r"(version|release|isbn|order|ticket|section|build)[^a-z0-9]*$"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Digits from the right, each second one doubled, 9 taken off where that exceeds 9; the sum ends in 0."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: d.cast("int") * (F.lit(1) + i % 2))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.coalesce(F.when(d > 9, d - 9).otherwise(d), F.lit(0))) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    """The contract's checks. Length is looked at first, so a huge run of digits is never worked through."""
    digits = _digits(value)
    small = lambda part: (F.length(F.ltrim(part, F.lit("0"))) <= 3) & (
        F.coalesce(F.substring(F.ltrim(part, F.lit("0")), F.lit(1), F.lit(3)).try_cast("int"), F.lit(0)) <= 255
    )
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", F.forall(F.split(value, r"\."), small))
        .when(kind == "card", F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False)))
        .when(kind == "phone", F.length(digits).between(9, 15))
        .otherwise(F.lit(False))
    )


def candidates(text: Column) -> Column:
    """All candidates of a text; the cheap tests spare most texts the searches, and can't change what is found."""
    digit = text.rlike("[0-9]")
    patterns = {
        "email": (EMAIL, text.contains("@")),
        "ip": (IP, digit),
        "card": (CARD, digit),
        "phone": (PHONE, digit),
        "hidden": (HIDDEN_EMAIL, F.lower(text).rlike(r"[\[(]at[\])]")),
        "secret": (SECRET, text.rlike("[=:]")),
    }
    # a single digit or a digit run that is no card in length is no candidate
    likely = F.filter(S.matches(text, patterns), lambda m: (m["name"] != "card") | F.length(_digits(m["hit"])).between(13, 19))

    def named(m: Column) -> Column:
        value_only = m["end"] - F.length(F.regexp_extract(m["hit"], "[A-Za-z0-9+/_-]+$", 0))
        kind = F.when(m["name"] == "hidden", "email").otherwise(m["name"])
        return F.struct(kind.alias("kind"), F.when(m["name"] == "secret", value_only).otherwise(m["start"]).alias("start"), m["end"].alias("end"), m["hit"].alias("value"))

    return F.transform(likely, named)


def judged(text: Column, spans: Column) -> Column:
    """Each candidate with its base flag, its four votes and its features."""

    def one(c: Column, cut: Column) -> Column:
        kind, value = c["kind"], c["value"]
        ahead = F.lower(S.piece(cut, F.greatest(c["start"] - 24, F.lit(0)), c["start"]))
        last, after = F.substring(ahead, F.lit(-1), F.lit(1)), S.piece(cut, c["end"], c["end"] + 1)
        free = ~(last.rlike("[a-z0-9]")) & ~(after.rlike("[A-Za-z0-9]"))
        plain = value.contains("@")
        base = F.when(kind == "email", plain).otherwise(valid(kind, value))
        v_regex = F.when(base, 1).when(kind.isin("ip", "card", "phone"), -1).when(value.rlike("[0-9]"), 1).otherwise(0)
        v_list = (
            F.when(kind == "email", F.when(F.lower(value).rlike(MAIL_ENDS), 1).otherwise(0))
            .when(kind == "ip", F.when(value.rlike(RESERVED), -1).otherwise(0))
            .when(kind == "card", F.when(_digits(value).rlike(ISSUERS), 1).otherwise(-1))
            .when(kind == "phone", F.when(F.concat(F.lit("+"), _digits(value)).rlike(COUNTRIES), 1).otherwise(-1))
            .otherwise(F.when(F.lower(value).rlike("password|token|secret"), 1).otherwise(0))
        )
        cue = F.lit(False)
        for k, pattern in CUES.items():
            cue = cue | ((kind == k) & ahead.rlike(pattern))
        v_context = F.when(ahead.rlike(COUNTER_CUES), -1).when(cue, 1).otherwise(0)
        v_edge = F.when(free, 1).otherwise(-1)
        size = F.least(F.floor(F.length(value) / 8), F.lit(4)).cast("int")
        return F.struct(
            kind.alias("kind"),
            c["start"].alias("start"),
            c["end"].alias("end"),
            base.alias("base"),
            F.array(v_regex, v_list, v_context, v_edge).alias("votes"),
            F.array(size, F.when(value.rlike("[A-Za-z]"), 1).otherwise(0), F.when(value.rlike("[0-9]"), 1).otherwise(0)).alias("features"),
        )

    cut = F.when(F.size(spans) > 0, S.blocks(text)).otherwise(F.array().cast("array<string>"))
    return S.bound(cut, lambda b: F.transform(spans, lambda c: one(c, b)))


def with_candidates(docs: DataFrame, text_col: str = "text", out: str = "candidates") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    # two projections, so that each candidate list is made once
    return docs.withColumn(out, candidates(text)).withColumn(out, judged(text, F.col(out)))


class Model:
    """Weights of the span classifier: {name: weight}; names are those of ``terms``."""

    def __init__(self, weights: dict[str, float], reliability: dict[str, list[float]]):
        self.weights, self.reliability = weights, reliability

    def score(self, c: Column) -> Column:
        z = F.lit(self.weights.get("bias", 0.0))
        for name, w in self.weights.items():
            if name == "bias":
                continue
            field, _, value = name.partition("=")
            where, _, i = field.partition(":")
            seen = c[where] if not i else F.get(c[where], F.lit(int(i)))
            z = z + F.when(seen == (value if not i else int(value)), F.lit(float(w))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def terms(kind: str, votes: list[int], features: list[int]) -> list[str]:
    return ["bias", f"kind={kind}", *(f"votes:{i}={v}" for i, v in enumerate(votes)), *(f"features:{i}={v}" for i, v in enumerate(features))]


def fit(patterns: list[tuple[str, list[int], list[int], int]], rounds: int = 30, steps: int = 200) -> Model:
    """patterns: (kind, votes, features, count). EM over votes per kind, then logistic regression on the posteriors."""
    posterior: dict[int, float] = {}
    reliability: dict[str, list[float]] = {}
    for kind in KINDS:
        own = [(i, v, n) for i, (k, v, _, n) in enumerate(patterns) if k == kind]
        acc, prior = [0.8] * 4, 0.5
        for _ in range(rounds if own else 0):
            for i, votes, _ in own:
                odds = math.log(prior / (1 - prior)) + sum(v * math.log(a / (1 - a)) for v, a in zip(votes, acc, strict=True))
                posterior[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
            total = sum(n for _, _, n in own)
            prior = min(0.95, max(0.05, sum(posterior[i] * n for i, _, n in own) / total))
            for j in range(4):
                cast = sum(n for _, v, n in own if v[j])
                right = sum(n * (posterior[i] if v[j] > 0 else 1 - posterior[i]) for i, v, n in own if v[j])
                acc[j] = min(0.98, max(0.55, (right + 4) / (cast + 5)))  # a labeler is taken to be better than chance
        reliability[kind] = acc
    total = sum(n for *_, n in patterns) or 1
    rows = [(terms(k, v, f), posterior[i], n / total) for i, (k, v, f, n) in enumerate(patterns)]
    weights: dict[str, float] = {"bias": -1.0}
    spread: dict[str, float] = {}
    for _ in range(steps if rows else 0):
        slope: dict[str, float] = {}
        for names, p, n in rows:
            z = sum(weights.get(t, 0.0) for t in names)
            error = n * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p)
            for t in names:
                slope[t] = slope.get(t, 0.0) + error
        for t, g in slope.items():
            g += 1e-4 * weights.get(t, 0.0)
            spread[t] = spread.get(t, 1e-8) + g * g
            weights[t] = weights.get(t, 0.0) - 0.3 * g / math.sqrt(spread[t])
    return Model(weights, reliability)


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Counts vote and feature patterns over all documents; at most kinds x votes x features rows reach the driver."""
    counts = (
        with_candidates(docs.select(F.col(text_col).alias("text")))
        .where(F.size("candidates") > 0)
        .select(F.explode("candidates").alias("c"))
        .groupBy("c.kind", "c.votes", "c.features")
        .count()
    )
    return fit(sorted((r[0], list(r[1]), list(r[2]), r[3]) for r in counts.collect()))


def apart(base: Column, more: Column) -> Column:
    """Those of more that overlap none of base: by start, none of the bases up to a span ends behind its start, and the next begins behind its end."""
    flag = lambda spans, n: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("added"), s.alias("s")))

    def kept(row: Column) -> Column:
        far = F.lit(2**31 - 1)
        reach = S.running(F.transform(row, lambda x: F.when(x["added"] == 1, 0).otherwise(x["s"]["end"])), F.lit(0), F.greatest)
        ahead = F.reverse(S.running(F.reverse(F.transform(row, lambda x: F.when(x["added"] == 1, far).otherwise(x["start"]))), far, F.least))
        free = F.zip_with(F.zip_with(row, reach, lambda x, r: F.struct(x["added"].alias("added"), x["s"].alias("s"), (r <= x["start"]).alias("free"))), ahead, lambda x, a: F.struct(x["s"].alias("s"), ((x["added"] == 1) & x["free"] & (a >= x["s"]["end"])).alias("free")))
        return F.transform(F.filter(free, lambda x: x["free"]), lambda x: x["s"])

    return F.when((F.size(base) > 0) & (F.size(more) > 0), S.bound(F.array_sort(F.concat(flag(base, 0), flag(more, 1))), kept)).otherwise(more)


def detect(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5, out: str = "pii") -> DataFrame:
    """docs with ``out``: array<struct<kind, start, end, base>>, by kind as in KINDS, then start; a column of that name is replaced."""
    rank = lambda c: F.array_position(F.array(*[F.lit(k) for k in KINDS]), c["kind"]).cast("int")
    slim = lambda c: F.struct(rank(c).alias("rank"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["base"].alias("base"))
    found_col = unused(docs, "found")
    made = with_candidates(docs, text_col, found_col)
    none = F.array().cast("array<struct<rank:int,start:int,end:int,kind:string,base:boolean>>")
    base = F.transform(F.filter(found_col, lambda c: c["base"]), slim)
    more = F.transform(F.filter(found_col, lambda c: ~c["base"] & (model.score(c) >= threshold)), slim)
    spans = S.bound(base, lambda b: S.bound(more, lambda m: F.array_sort(F.concat(b, apart(b, m)))))
    return made.withColumn(out, F.when(F.size(found_col) > 0, spans).otherwise(none)).drop(*({found_col} - {out}))


def redact(text: Column, spans: Column) -> Column:
    """text with its spans replaced by ``[KIND]``; overlapping spans are replaced as one, by the kind of the first, of several that begin together the longest."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))

    def written(row: Column, reach: Column, cut: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.slice(reach, 1, F.size(reach) - 1))
        mark = lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        parts = F.zip_with(row, before, lambda s, b: F.when(s["start"] >= b, F.concat(S.piece(cut, b, s["start"]), mark(s))).otherwise(""))
        return F.concat(F.array_join(parts, ""), S.piece(cut, F.element_at(reach, -1), F.length(text)))

    def whole(row: Column) -> Column:
        reach = S.running(F.transform(row, lambda s: -s["end"]), F.lit(0), F.greatest)
        return S.bound(reach, lambda r: S.bound(S.blocks(text), lambda cut: written(row, r, cut)))

    return F.when(F.size(spans) > 0, S.bound(ordered, whole)).otherwise(text)
