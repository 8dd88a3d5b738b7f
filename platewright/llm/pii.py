"""Personal data by weak supervision.  Native: DataFrame and SQL functions only.

Spans of four kinds (email, ip, card, phone) are found by strict patterns, which always stay, and
by wider ones, which are candidates: spelled-out addresses, IPv6, cards with other separators,
phone numbers without a plus sign.  Labellers vote on every span: the pattern's shape, a structure
test, gazetteers (top-level domains, calling codes, card issuers, reserved networks), words before
the span, and the characters next to it.  Vote patterns are counted over all documents;
expectation maximisation on the counts estimates the labellers' accuracies, and a logistic span
classifier is fitted to the posteriors over features of shape and votes.  Candidates that the
classifier accepts, and that overlap no strict span, are added.

The counts have one row for each combination of votes and features (a fixed product, whatever the
corpus); they alone reach the driver.

Defined results: a null or empty text has no spans; offsets count code points, ends are exclusive;
matches of a kind are leftmost and do not overlap; a match that fails its test (parts over 255,
Luhn, number of digits) is dropped and its characters are not tried again.  Long runs of digits or
letters are scanned once, without recursion.  Repeated rows and null ids give results like others; an
empty table gives none; columns named like a result are replaced by it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]

# The strict patterns.  Possessive parts and the start conditions change no match: they keep a
# failing run from being tried again at each of its characters.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?[(\[{]\x20?at\x20?[)\]}]\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}+(?:(?:\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?|\x20dot\x20|(?<=[)\]}]\x20?[A-Za-z0-9-]{1,63})\.)[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}+[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:.])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[./_][0-9]{4}){3}+(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:00[1-9][0-9]{0,2}[\x20.-]?)?+\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z])",
}
#: Texts without these can have no match.
HINTS = {"email": ("@", r"(?i)at\x20?[)\]}]|\x20at\x20"), "ip": (".", r":[0-9A-Fa-f]{1,4}:"), "card": (None, r"[0-9][./_][0-9]"), "phone": ("+", r"[0-9]\)?[\x20.-][0-9]{3}")}

# Gazetteers: fixed values, public knowledge.
TLDS = "com net org edu gov mil int info biz name io co uk de fr es it nl be ch at se no dk fi pl cz pt ie eu us ca mx br ar cl au nz jp cn kr in ru za example test".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 351 352 353 354 355 356 357 358 359 370 371 372 380 385 386 420 421 971 972".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[0689]|6(?:011|5|4[4-9])|35|62)"
RESERVED = r"^(?:0|127|255|22[4-9]|2[34][0-9])\."
CONTEXT = {
    "email": r"(?i)(?:mail|contact|write|kontakt|correo|courriel|from|to|cc)\W{0,4}$",
    "ip": r"(?i)(?:\bip|host|server|address|adresse|from|client|login)\W{0,4}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|karte|tarjeta|carte|credit|payment)\W{0,4}(?:no|nr|number|num)?\W{0,4}$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|handy|telefon|t[eé]l[eé]phone|m[oó]vil|reach)\W{0,4}(?:no|nr|number|at)?\W{0,4}$",
}
AGAINST = r"(?i)(?:version|release|isbn|issn|order|invoice|serial|sha|token|uuid|price|total|section|chapter|fig|page|[$€£#=])\W{0,2}$"
LABELLERS = ["shape", "structure", "gazetteer", "context", "edges"]
BLOCK = 256


def _find(df: DataFrame, text: str, pattern: str, name: str, possible: Column) -> DataFrame:
    """Adds `name`: array of struct(start, end, value) of the pattern's matches in order."""
    found, sizes = f"_f_{name}", f"_s_{name}"
    nothing = F.array().cast("array<string>")
    df = df.withColumn(found, F.when(possible, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(nothing))
    # the text between matches gives each match its place
    df = df.withColumn(sizes, F.when(F.size(found) > 0, F.zip_with(F.slice(F.split(F.col(text), pattern, -1), F.lit(1), F.size(found)), F.col(found), lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("long")))).otherwise(F.array().cast("array<struct<gap:int,long:int>>")))
    n = F.size(found)
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x["gap"] + x["long"])

    def block(b: Column) -> Column:
        rows = F.slice(F.col(sizes), b * BLOCK + 1, F.lit(BLOCK))
        base = total(F.slice(F.col(sizes), F.lit(1), b * BLOCK))
        return F.transform(F.sequence(F.lit(1), F.size(rows)), lambda i: F.struct((base + total(F.slice(F.slice(F.col(sizes), b * BLOCK + 1, F.lit(BLOCK)), F.lit(1), i))).alias("end"), F.element_at(F.col(found), b * BLOCK + i).alias("value")))

    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    ends = F.flatten(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), block))
    placed = F.transform(ends, lambda m: F.struct((m["end"] - F.length(m["value"])).alias("start"), m["end"].alias("end"), m["value"].alias("value")))
    return df.withColumn(name, F.when(n > 0, placed).otherwise(empty)).drop(found, sizes)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, i, F.lit(1)).cast("int")
        doubled = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when((n - i) % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    n = F.length(digits(value))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits(value))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _test(kind: str):
    return lambda m: passes(kind, m["value"])


def _spans(df: DataFrame, text: str) -> DataFrame:
    """Adds `base` and `wide`: arrays of struct(start, k, end, value), k the kind's number."""
    df = df.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    tag = lambda name, k: F.transform(F.col(name), lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("k"), m["end"].alias("end"), m["value"].alias("value")))
    for k, kind in enumerate(KINDS):
        hint, wide_hint = HINTS[kind]
        df = _find(df, "_t", STRICT[kind], f"_b{k}", F.contains(F.col("_t"), F.lit(hint)) if hint else F.lit(True))
        df = df.withColumn(f"_b{k}", F.filter(tag(f"_b{k}", k), _test(kind)))
        df = _find(df, "_t", WIDE[kind], f"_w{k}", F.col("_t").rlike(wide_hint))
        df = df.withColumn(f"_w{k}", tag(f"_w{k}", k))
    df = df.withColumn("base", F.array_sort(F.concat(*(F.col(f"_b{k}") for k in range(4)))))
    clear = F.filter(F.concat(*(F.col(f"_w{k}") for k in range(4))), lambda w: ~F.exists(F.col("base"), lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    return df.withColumn("wide", F.when(F.size(F.concat(*(F.col(f"_w{k}") for k in range(4)))) > 0, clear).otherwise(F.array().cast("array<struct<start:int,k:int,end:int,value:string>>"))).drop(*(f"_{x}{k}" for k in range(4) for x in "bw"))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, 0).when(yes, 1).otherwise(2)


def _facts(m: Column, strict: Column) -> dict[str, Column]:
    """Votes (0 no, 1 yes, 2 none) and features of a span; `_t` is the text."""
    k, value = m["k"], m["value"]
    number = digits(value)
    n = F.length(number)
    before = F.substring(F.col("_t"), F.greatest(m["start"] - 31, F.lit(1)), F.least(m["start"], F.lit(32)))
    left, right = F.substring(before, -1, 1), F.substring(F.col("_t"), m["end"] + 1, F.lit(1))
    by_kind = lambda *c: F.when(k == 0, c[0]).when(k == 1, c[1]).when(k == 2, c[2]).otherwise(c[3])
    last = F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)$", 1))
    plain = number.rlike(r"^(\d)\1*$") | F.contains(F.lit("0123456789012345678"), number) & (n > 6)
    votes = {
        "shape": _vote(strict, (k >= 2) & plain),
        "structure": _vote(by_kind(last.rlike("^[a-z]{2,24}$"), ~value.rlike(r"^0"), n.between(13, 19) & luhn(number), n.between(10, 13)), by_kind(last.rlike("[0-9-]"), value.rlike(r"^0+\."), (n < 12) | ~luhn(number), (n < 9) | (n > 15))),
        "gazetteer": _vote(by_kind(last.isin(TLDS), ~value.rlike(RESERVED), number.rlike(ISSUERS), F.when(value.startswith("+"), F.exists(F.array(*map(F.lit, CALLING_CODES)), lambda c: number.startswith(c))).otherwise(value.rlike(r"^\(?0"))), by_kind(F.length(last) > 12, value.rlike(RESERVED), number.startswith("0"), number.rlike("^000"))),
        "context": _vote(by_kind(*(before.rlike(CONTEXT[x]) for x in KINDS)), before.rlike(AGAINST)),
        "edges": _vote(~left.rlike(r"[\p{L}\p{N}]") & ~right.rlike(r"[\p{L}\p{N}]"), left.rlike(r"[\p{L}\p{N}_/=]") | right.rlike(r"[\p{L}\p{N}_/=]")),
    }
    features = {
        "parts": F.least(F.size(F.split(value, r"[\x20().:_/-]+", -1)), F.lit(6)),
        "many": F.least(F.floor(n / 3).cast("int"), F.lit(6)),
        "strict": strict.cast("int"),
    }
    return {"kind": k, **votes, **features}


def _code(facts: dict[str, Column]) -> Column:
    """All facts of a span in one number: kind 4, votes 3 each, parts 7, many 7, strict 2."""
    radix = {"kind": 4, **dict.fromkeys(LABELLERS, 3), "parts": 7, "many": 7, "strict": 2}
    return reduce(lambda acc, name: acc * radix[name] + facts[name], radix, F.lit(0))


def decode(code: int) -> dict[str, int]:
    out, order = {}, [("strict", 2), ("many", 7), ("parts", 7), *((x, 3) for x in reversed(LABELLERS)), ("kind", 4)]
    for name, radix in order:
        code, out[name] = divmod(code, radix)
    return out


def reliabilities(rows: list[tuple[dict[str, int], int]], rounds: int = 100) -> tuple[list[float], dict[str, float], float]:
    """Posterior of each row, accuracies and share of true spans, by expectation maximisation."""
    accuracy, share, posterior = dict.fromkeys(LABELLERS, 0.8), 0.5, [0.5] * len(rows)
    total = max(sum(n for _, n in rows), 1)
    for _ in range(rounds):
        posterior = []
        for facts, _n in rows:
            odds = math.log(share / (1 - share)) + sum((1 if facts[x] else -1) * math.log(accuracy[x] / (1 - accuracy[x])) for x in LABELLERS if facts[x] < 2)
            posterior.append(1 / (1 + math.exp(-max(min(odds, 500), -500))))
        for x in LABELLERS:
            cast = sum(n for f, n in rows if f[x] < 2)
            right = sum(n * (p if f[x] else 1 - p) for (f, n), p in zip(rows, posterior, strict=True) if f[x] < 2)
            accuracy[x] = min(max((right + 8) / (cast + 10), 0.55), 0.99)
        share = min(max(sum(n * p for (_, n), p in zip(rows, posterior, strict=True)) / total, 0.01), 0.99)
    return posterior, accuracy, share


def span_classifier(rows: list[tuple[dict[str, int], int]], posterior: list[float], rounds: int = 300, rate: float = 0.5) -> dict[tuple[str, int], float]:
    """Logistic weights of (feature, value); the strict flag is no feature, as it would decide alone."""
    weights: dict[tuple[str, int], float] = {}
    total = max(sum(n for _, n in rows), 1)
    keys = [[(x, v) for x, v in facts.items() if x not in ("strict", "shape")] for facts, _ in rows]
    square: dict[tuple[str, int], float] = {}
    for _ in range(rounds):
        gradient: dict[tuple[str, int], float] = {}
        for (_, n), p, key in zip(rows, posterior, keys, strict=True):
            z = sum(weights.get(x, 0.0) for x in key)
            error = n / total * (1 / (1 + math.exp(-max(min(z, 500), -500))) - p)
            for x in key:
                gradient[x] = gradient.get(x, 0.0) + error
        for x, g in gradient.items():
            g += 1e-4 * weights.get(x, 0.0)
            square[x] = square.get(x, 1e-10) + g * g
            weights[x] = weights.get(x, 0.0) - rate * g / math.sqrt(square[x])
    return weights


def _score(m: Column, weights: dict[tuple[str, int], float]) -> Column:
    facts = _facts(m, F.lit(False))
    terms = []
    for name, column in facts.items():
        own = sorted((v, w) for (x, v), w in weights.items() if x == name)
        if own:
            terms.append(F.coalesce(F.element_at(F.create_map(*(F.lit(x) for v, w in own for x in (int(v), float(w)))), column), F.lit(0.0)))
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def find(df: DataFrame, keep: list[str] = ("doc_id",), text: str = "text", accept: float = 0.5) -> DataFrame:
    """`keep`, base and spans (arrays of struct(start, k, end, value)) of every row of `df`."""
    keep = [k for k in keep if k not in ("base", "wide", "spans", "_t")]
    columns = [*keep, *([] if text in keep else [text])]
    coded = lambda name, strict: F.transform(F.col(name), lambda m: _code(_facts(m, F.lit(strict))))
    codes = _spans(df.select(text), text).select(F.explode(F.concat(coded("base", True), coded("wide", False))).alias("code"))
    counts = codes.groupBy("code").agg(F.count("*").alias("n")).collect()  # one row a combination
    rows = sorted(((decode(r["code"]), r["n"]) for r in counts), key=lambda r: sorted(r[0].items()))
    posterior, _, _ = reliabilities(rows)
    weights = span_classifier(rows, posterior)
    found = _spans(df.select(*columns), text)
    added = F.filter(F.col("wide"), lambda m: _score(m, weights) > math.log(accept / (1 - accept)))
    spans = F.when(F.size("wide") == 0, F.col("base")).otherwise(F.array_sort(F.concat(F.col("base"), added)))
    return found.select(*keep, "base", spans.alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.element_at(names, m["k"] + 1), m["start"].cast("string"), m["end"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text", mask: str = "[{}]") -> DataFrame:
    """`df` with personal data in `text` replaced by the kind's mask.

    Overlapping spans go as one, by the kind of the first.  A null text stays null.
    """
    names = F.array(*(F.lit(mask.format(k.upper())) for k in KINDS))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    found = find(df.select(F.struct(*df.columns).alias("_row"), F.col(text)), ["_row", text], text)

    def step(acc: Column, m: Column) -> Column:
        gap = F.substring(F.col(text), acc["at"] + 1, m["start"] - acc["at"])
        masked = F.struct(m["end"].alias("at"), F.concat(acc["parts"], F.array(gap, F.element_at(names, m["k"] + 1))).alias("parts"))
        return F.when(m["start"] < acc["at"], F.struct(F.greatest(acc["at"], m["end"]).alias("at"), acc["parts"].alias("parts"))).otherwise(masked)

    done = F.aggregate(F.col("spans"), start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(F.col(text), acc["at"] + 1, F.length(text))))
    return found.withColumn("_new", F.when(F.size("spans") > 0, done).otherwise(F.col(text))).select(*(F.col("_new").alias(c) if c == text else F.col(f"_row.{c}").alias(c) for c in df.columns))
