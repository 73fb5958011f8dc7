"""Personal data by weak supervision.

Patterns propose spans. Five labelers (shape, checksum or range, gazetteer,
context words, company of other spans) vote on each. Expectation-maximisation
over the counts of vote patterns estimates how reliable every labeler is and
how likely each pattern is personal data; the estimates then train the final
span classifier, a naive Bayes model over the votes and the form of the span.

Spans of the fixed base patterns that pass their test always stay. What the
classifier adds are spans that the base patterns miss, for instance a card
number that directly follows a phone number.

Texts are read once, with column expressions only; the vote patterns that meet
on the driver number at most ``MAX_PATTERNS``, whatever the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from scoreloom.llm.runtime import stored

KINDS = ("email", "ip", "card", "phone")
# The base patterns, written so that matching takes linear time.
# A failing start inside a run fails at every later place of the run, hence the
# look-behinds; the repeats have nothing to give back, hence possessive.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Further candidates.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]{1,63}+(?:(?: ?[\[(] ?(?:dot|DOT) ?[\])] ?|\.)[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([\x20-])[0-9]{4}\2[0-9]{4}\2[0-9]{1,7})(?![0-9])",
    "phone": r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])",
}
# What a text must contain before a pattern is tried.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9 -]{11}", "phone": r"\+[0-9]"}
LOOSE_NEEDS = {"email": r"[\[(] ?(?:at|AT) ?[\])]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "card": r"[0-9][0-9 -]{11}", "phone": r"\+[0-9]"}
# Word lists of the labelers.
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "biz", "de", "fr", "es", "it", "uk", "us", "nl", "ch", "eu")
COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49",
                 "52", "55", "61", "64", "65", "81", "82", "86", "90", "91", "351", "353", "358", "420")
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)"
GOOD_WORDS = {"email": "mail|contact|write to|reach|correo|adresse", "ip": r"\bip\b|host|server|login|address",
              "card": "card|visa|master|amex|credit|payment|karte|tarjeta|carte", "phone": r"phone|\btel|call|mobile|fax|telefon|telefono"}
BAD_WORDS = r"version|\bv\.?$|isbn|order|invoice|serial|section|chapter|\bid\b|ref"
MARK, OTHER = "\ue000", "\ue002"        # private-use characters; no pattern knows them
BEFORE = 40
MAX_PATTERNS = 4 * 3 ** 5 * 9
ROUNDS = 60


def _marked(text: Column, needs: str, pattern: str) -> Column:
    """Pieces of the text; every second one is a match."""
    tried = F.contains(text, F.lit(needs)) if needs == "@" else F.rlike(text, F.lit(needs))
    return F.when(tried, F.split(F.regexp_replace(text, F.lit(f"({pattern})"), F.lit(f"{MARK}$1{MARK}")), MARK, -1)).otherwise(
        F.array(text))


def _places(pieces: Column) -> Column:
    """Offset of every piece in code points."""
    return F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), F.array(F.lit(0)),
                       lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.length(p))))


def _matches(kind: str, pieces: Column, places: Column) -> Column:
    even = F.when(F.size(pieces) > 2, F.sequence(F.lit(2), F.size(pieces), F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(even, lambda i: i < F.size(pieces)), lambda i: F.struct(
        F.lit(kind).alias("kind"), F.element_at(places, i).alias("start"),
        (F.element_at(places, i) + F.length(F.element_at(pieces, i))).alias("end"),
        F.element_at(pieces, i).alias("value"),
        F.lower(F.right(F.element_at(pieces, i - 1), F.lit(BEFORE))).alias("before")))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + F.when(
        i % 2 == 1, F.substr(turned, i, F.lit(1)).cast("int")).otherwise(
        F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substr(turned, i, F.lit(1)).cast("int") + 1)))
    return total % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    """The test of a base match."""
    digits = _digits(value)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3)
                        & (F.concat(F.lit("0"), F.right(p, F.lit(3))).cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(good, "+").when(bad, "-").otherwise("0")


def _key(m: Column, company: Column) -> Column:
    """Kind, votes of the five labelers and form of a candidate as one short text."""
    kind, value, digits = m["kind"], m["value"], _digits(m["value"])

    def by_kind(**of):
        out = None
        for name, column in of.items():
            out = F.when(kind == name, column) if out is None else out.when(kind == name, column)
        return out

    plain_ip = ~F.contains(value, F.lit(":"))
    shape = by_kind(
        email=_vote(F.rlike(value, F.lit(r"^[A-Za-z0-9][^@]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$")), F.rlike(value, F.lit(r"^[._%+-]|\.-|-$"))),
        ip=_vote(F.rlike(value, F.lit(r"^(?:[1-9][0-9]{0,2}|0)(?:\.(?:[1-9][0-9]{0,2}|0)){3}$|^[0-9A-Fa-f:]+:[0-9A-Fa-f:]+$")), F.lit(True)),
        card=_vote(F.rlike(value, F.lit(r"^[0-9]{13,19}$|^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$")), F.rlike(value, F.lit(r"[ -].*[ -].*[ -].*[ -].*[ -]"))),
        phone=_vote(F.rlike(value, F.lit(r"^\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}$")), F.rlike(value, F.lit(r"[ .-]{2}|\(\)"))))
    check = by_kind(
        email=F.when(F.length(value) <= 254, "+").otherwise("-"),
        ip=_vote(~plain_ip | _passes("ip", value), F.lit(True)),
        card=_vote(_passes("card", value), F.lit(True)),
        phone=_vote(_passes("phone", value), F.lit(True)))
    top = F.lower(F.regexp_extract(value, r"([A-Za-z]+)$", 1))
    gazetteer = by_kind(
        email=_vote(top.isin(*TOP_DOMAINS), top == ""),
        ip=_vote(plain_ip & ~F.rlike(value, F.lit(r"^(?:0|127|2[4-5][0-9])\.")), F.rlike(value, F.lit(r"^0\.|^255\."))),
        card=_vote(F.rlike(digits, F.lit(ISSUERS)), F.rlike(digits, F.lit("^0"))),
        phone=_vote(F.left(digits, F.lit(1)).isin(*COUNTRY_CODES) | F.left(digits, F.lit(2)).isin(*COUNTRY_CODES)
                    | F.left(digits, F.lit(3)).isin(*COUNTRY_CODES), F.rlike(digits, F.lit("^0"))))
    near = F.right(m["before"], F.lit(24))
    context = _vote(by_kind(**{k: F.rlike(near, F.lit(w)) for k, w in GOOD_WORDS.items()}), F.rlike(near, F.lit(BAD_WORDS)))
    size = F.least(F.length(value) / 12, F.lit(2)).cast("int").cast("string")
    edge = F.when(F.length(m["before"]) == 0, "0").when(F.rlike(m["before"], F.lit(r"\s$")), "1").otherwise("2")
    return F.concat_ws(":", kind, F.concat(shape, check, gazetteer, context, company), F.concat(size, edge))


# --- estimates on counts of vote patterns ------------------------------------------

def reliabilities(patterns: dict[tuple[str, str], float]):
    """Posterior of every (kind, votes) by expectation-maximisation.

    Votes are independent given the truth. A prior worth a tenth of the data
    holds that a vote is right more often than not, which keeps the two classes
    from changing places.
    """
    total = sum(patterns.values())
    if not total:
        return {}
    n = len(next(iter(patterns))[1])
    weight = max(1.0, 0.1 * total)
    lean = {True: {"+": 0.6, "0": 0.3, "-": 0.1}, False: {"+": 0.15, "0": 0.35, "-": 0.5}}
    post = {p: 1 / (1 + math.exp(-1.5 * (p[1].count("+") - 2 * p[1].count("-") - 1))) for p in patterns}
    for _ in range(ROUNDS):
        prior, table = {}, {}
        for kind in KINDS:
            mass = sum(c for (k, _), c in patterns.items() if k == kind)
            prior[kind] = (sum(c * post[k, v] for (k, v), c in patterns.items() if k == kind) + 1) / (mass + 2)
        for j in range(n):
            for truth in (True, False):
                counts = {s: weight * lean[truth][s] for s in "+0-"}
                for p, c in patterns.items():
                    counts[p[1][j]] += c * (post[p] if truth else 1 - post[p])
                mass = sum(counts.values())
                table[j, truth] = {s: c / mass for s, c in counts.items()}
        for kind, votes in patterns:
            odds = math.log(prior[kind] / (1 - prior[kind]))
            odds += sum(math.log(table[j, True][s] / table[j, False][s]) for j, s in enumerate(votes))
            post[kind, votes] = 1 / (1 + math.exp(-max(min(odds, 60), -60)))
    return post


def span_classifier(keys: dict[str, float]) -> set[str]:
    """Keys that a naive Bayes model, trained on the estimates, calls personal data."""
    split = {key: key.split(":") for key in keys}
    patterns: dict[tuple[str, str], float] = {}
    for key, count in keys.items():
        kind, votes, _ = split[key]
        patterns[kind, votes] = patterns.get((kind, votes), 0) + count
    post = reliabilities(patterns)
    seen: dict[tuple, dict[bool, float]] = {}
    features = {}
    for key, count in keys.items():
        kind, votes, form = split[key]
        features[key] = [("kind", kind), *((j, kind, s) for j, s in enumerate(votes)), *((f"form{j}", kind, s) for j, s in enumerate(form))]
        p = post[kind, votes]
        for truth, q in ((True, p), (False, 1 - p)):
            for f in features[key]:
                seen.setdefault(f, {True: 0.5, False: 0.5})[truth] += count * q
    good = set()
    for key in keys:
        # Features of a span are independent given the class and the kind.
        kind = seen["kind", split[key][0]]
        odds = math.log(kind[True] / kind[False]) + sum(
            math.log((seen[f][True] / kind[True]) / (seen[f][False] / kind[False])) for f in features[key][1:])
        # The classifier must not overrule a failed checksum or range.
        if odds > 0 and split[key][1][1] != "-" and post[split[key][0], split[key][1]] > 0.5:
            good.add(key)
    return good


# --- the operator ------------------------------------------------------------------

def _candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), MARK, OTHER)
    cut = docs.select(*keep, text.alias("__text"))
    pieces = cut.select(*keep, *[_marked(F.col("__text"), needs[k], patterns[k]).alias(f"__{level}_{k}")
                                 for level, patterns, needs in (("base", BASE, NEEDS), ("loose", LOOSE, LOOSE_NEEDS)) for k in KINDS])
    names = [f"__{level}_{k}" for level in ("base", "loose") for k in KINDS]
    placed = pieces.select("*", *[_places(F.col(c)).alias(c + "_at") for c in names])
    return placed.select(
        *keep,
        F.concat(*[_matches(k, F.col(f"__base_{k}"), F.col(f"__base_{k}_at")) for k in KINDS]).alias("__base"),
        F.concat(*[_matches(k, F.col(f"__loose_{k}"), F.col(f"__loose_{k}_at")) for k in KINDS]).alias("__loose"))


def personal_data(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, ``base`` and ``spans`` of every document: arrays of
    (kind, start, end) in code points, end exclusive, by kind as in ``KINDS``,
    then start. ``spans`` holds the base spans and those that the method adds.

    NULL and empty texts have no spans. Repeated rows and NULL ids are kept as
    they are; an empty table gives no rows and trains nothing; further columns
    are ignored. An added span never overlaps a base span of its kind.
    """
    keep = list(keep)
    found = _candidates(docs, keep)
    ok = F.filter("__base", lambda m: F.coalesce(
        F.when(m["kind"] == "ip", _passes("ip", m["value"])).when(m["kind"] == "card", _passes("card", m["value"]))
        .when(m["kind"] == "phone", _passes("phone", m["value"])).otherwise(F.lit(True)), F.lit(False)))
    failed = F.filter("__base", lambda m: ~F.exists("__ok", lambda o: (o["kind"] == m["kind"]) & (o["start"] == m["start"])))
    fresh = F.filter("__loose", lambda m: ~F.exists("__ok", lambda o: (o["kind"] == m["kind"]) & (o["start"] < m["end"]) & (m["start"] < o["end"])))
    many = F.size("__ok") + F.size("__fresh")
    company = F.when(many >= 3, "+").otherwise("0")
    rows = found.withColumn("__ok", ok).withColumn("__fresh", fresh).withColumn("__failed", failed)
    rows = rows.select(
        *keep, F.transform("__ok", lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"))).alias("base"),
        F.transform("__ok", lambda m: _key(m, company)).alias("sure_keys"),
        F.transform("__failed", lambda m: _key(m, company)).alias("failed_keys"),
        F.transform("__fresh", lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"), _key(m, company).alias("key"))).alias("fresh"))
    rows = stored(rows, "personal-data")
    keys = (rows.select(F.explode(F.concat("sure_keys", "failed_keys", F.transform("fresh", lambda m: m["key"]))).alias("key"))
            .groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    good = sorted(span_classifier({r["key"]: float(r["n"]) for r in keys.limit(MAX_PATTERNS).collect()}))
    chosen = F.array(*[F.lit(k) for k in good]) if good else F.array().cast("array<string>")
    added = F.transform(F.filter("fresh", lambda m: F.array_contains(chosen, m["key"])), lambda m: F.struct(
        m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    return rows.select(*keep, by_kind("base").alias("base"), by_kind(F.concat(F.col("base"), added)).alias("spans"))


def by_kind(spans) -> Column:
    """Spans by kind as in ``KINDS``, then start."""
    ranked = F.transform(spans, lambda s: F.struct(
        F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(ranked), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def spelled(spans) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping
    spans the first by position names the replacement."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate(order, start, lambda a, s: F.when(s["start"] >= a["at"], F.struct(
        F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"),
        s["end"].alias("at"))).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at"))),
        lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with all found spans replaced; ``n_chars``, if present, follows the text."""
    # Columns of any name travel under numbers.
    numbered = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    found = personal_data(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in numbered.items()], "text"), tuple(numbered.values()))
    text, changed = F.col(numbered["text"]), F.size("spans") > 0
    out = found.withColumn("__new", F.when(changed, redacted(F.coalesce(text, F.lit("")), F.col("spans"))).otherwise(text))

    def column(c: str) -> Column:
        if c == "text":
            return F.col("__new")
        if c == "n_chars":
            return F.when(changed, F.length("__new").cast(docs.schema[c].dataType)).otherwise(F.col(numbered[c]))
        return F.col(numbered[c])

    return out.select(*[column(c).alias(c) for c in docs.columns])
