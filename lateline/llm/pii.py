"""Personal data: candidate spans, boosted trees, calibrated thresholds.

Fixed base patterns (email, ip, card, phone) always count. High-recall generators propose further
spans, which may overlap: written-out addresses, numbers without a plus sign, secrets after a
label, and base matches that failed their check. Boosted trees over yes/no features of format and
context score them; a threshold, set on documents left out of the fit, decides what is added.

Everything runs as Spark SQL expressions. Positions follow from the pieces between matches: the
n-th match starts after the lengths of all pieces and matches before it. A candidate's features
are bits of a small number, so the whole corpus enters the fit as counts per number (at most 2^14
rows on the driver) and the trees' verdict per number goes back as a literal list. Each kind has
trees of its own.

Weak labels do not follow the generator. A match of a base pattern is right if it passes its check.
A high-recall candidate is not wrong for being no base match: label words, length, digits and
separators say right, wrong or nothing (then it stays out of the fit). One that overlaps a base span
stays out too, except a phone number inside a valid one that ends with it: that is the same number
without its prefix, and right.

Regular expressions use possessive quantifiers and look-behinds, so that long runs of one
character class cost linear time and no stack.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from lateline.session import materialize

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
PRECISION = 0.9
TREES, RATE = 24, 0.4
STEP = 128

_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: The base patterns, fixed values (possessive forms of the given ones).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further candidates by kind.
MORE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]\x20?at\x20?[\])]\x20?"
             r"[A-Za-z0-9-]{1,64}+(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])])\x20?[A-Za-z0-9-]{1,64}+)++",
    "phone": r"(?<![0-9+])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
    "secret": r"(?i)(?:token|secret|password|passwd|api[_-]?key)\x20{0,4}[=:]\x20{0,4}[\"']?"
              r"[A-Za-z0-9+/_-]{8,256}+",
}
GATE = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Context that names what follows.
LABEL = {
    "email": r"(?i)(?:mail|contact|write|reach)[^A-Za-z0-9]*$",
    "ip": r"(?i)(?:ip|host|server|address|addr)[^A-Za-z0-9]*$",
    "card": r"(?i)(?:card|visa|credit|account|iban)[^A-Za-z0-9]*$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax)[^A-Za-z0-9]*$",
    "secret": r"(?i)(?:export|set|env|config)[^A-Za-z0-9]*$",
}
FEATURES = ("label", "assigned", "edge_before", "edge_after", "has_space", "has_dash", "has_dot",
            "long", "grouped", "bracket", "digit")
BITS = 1 << len(FEATURES)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether up to 19 digits pass the Luhn check."""
    padded = F.lpad(digits, 19, "0")
    total = F.lit(0)
    for k in range(19):
        d = F.substring(padded, 19 - k, 1).cast("int")
        total = total + (F.when(d > 4, 2 * d - 9).otherwise(2 * d) if k % 2 else d)
    return total % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    n = F.length(_digits(match))
    return {
        "email": F.lit(True),
        "ip": F.rlike(match, F.lit(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")),
        "card": F.when(n.between(16, 19), luhn(_digits(match))).otherwise(False),
        "phone": n.between(8, 15),
    }[kind]


def _weak(kind: str, match: Column, before: Column) -> Column:
    """Whether a high-recall candidate looks right; null if nothing tells."""
    has = lambda regex: F.rlike(match, F.lit(regex))
    label, value = F.rlike(before, F.lit(LABEL[kind])), F.regexp_replace(match, r"^[^=:]*[=:]\x20*[\"']?", "")
    right, wrong = {
        "email": (label | has(r"(?i)[\[(]\x20?dot"), has(r"[^A-Za-z0-9-][0-9-]+$")),
        "phone": (label | has(r"^\("), ~label & has(r"^[0-9]+(?:\.[0-9]+)+$")),
        "secret": ((F.length(value) >= 12) & F.rlike(value, F.lit("[0-9]"))
                   & F.rlike(value, F.lit("[A-Za-z]")), ~F.rlike(value, F.lit("[0-9]"))),
    }[kind]
    return F.when(wrong, 0).when(right, 1)


def _code(kind: str, match: Column, before: Column, after: Column) -> Column:
    """The candidate's kind and features as one number."""
    features = {
        "label": F.rlike(before, F.lit(LABEL[kind])),
        "assigned": F.rlike(before, F.lit(r"[=:]\x20?[\"']?$")),
        "edge_before": F.rlike(before, F.lit(r"(?:^|[\s(\[<\"'])$")),
        "edge_after": F.rlike(after, F.lit(r"^(?:$|[\s)\]>\"'.,;])")),
        "has_space": F.contains(match, F.lit(" ")),
        "has_dash": F.contains(match, F.lit("-")),
        "has_dot": F.contains(match, F.lit(".")),
        "long": F.length(match) > 15,
        "grouped": F.rlike(match, F.lit(r"^[^0-9]*[0-9]{2,4}(?:[\x20.-][0-9]{2,4})+$")),
        "bracket": F.rlike(match, F.lit(r"[\[(]")),
        "digit": F.rlike(match, F.lit("[0-9]")),
    }
    code = F.lit(KINDS.index(kind) * BITS)
    for k, name in enumerate(FEATURES):
        code = code + F.when(features[name], F.lit(1 << k)).otherwise(F.lit(0))
    return code


def _spans(kind: str, gaps: Column, found: Column, base: bool) -> Column:
    """Array of (kind, start, end, base, code, weak label), from the pieces between matches.

    Lengths are added up in steps of STEP matches and then over the steps, so that a text with
    very many matches does not copy ever longer arrays.
    """
    empty = F.array().cast("array<struct<k:int,start:int,end:int,base:boolean,code:int,weak:int>>")

    def one(at: Column, k: Column) -> Column:
        match = F.get(found, k)
        start = at + F.length(F.get(gaps, k))
        kept = F.coalesce(_passes(kind, match), F.lit(False)) if base else F.lit(False)
        before = F.right(F.get(gaps, k), F.lit(24))
        return F.struct(
            F.lit(KINDS.index(kind)).alias("k"), start.alias("start"),
            (start + F.length(match)).alias("end"), kept.alias("base"),
            _code(kind, match, before, F.left(F.get(gaps, k + 1), F.lit(4))).alias("code"),
            (kept.cast("int") if base else _weak(kind, match, before)).alias("weak"))

    def step(first: Column) -> Column:
        last = F.least(first + STEP, F.size(found)) - 1
        return F.aggregate(
            F.sequence(first, last), F.struct(F.lit(0).alias("at"), empty.alias("out")),
            lambda acc, k: F.struct(
                (acc["at"] + F.length(F.get(gaps, k)) + F.length(F.get(found, k))).alias("at"),
                F.concat(acc["out"], F.array(one(acc["at"], k))).alias("out")))

    steps = F.transform(F.sequence(F.lit(0), F.size(found) - 1, F.lit(STEP)), step)
    joined = F.aggregate(
        steps, F.struct(F.lit(0).alias("at"),
                        F.array().cast("array<array<struct<k:int,start:int,end:int,base:boolean,"
                                       "code:int,weak:int>>>").alias("out")),
        lambda acc, s: F.struct(
            (acc["at"] + s["at"]).alias("at"),
            F.concat(acc["out"], F.array(F.transform(s["out"], lambda x: F.struct(
                x["k"].alias("k"), (x["start"] + acc["at"]).alias("start"),
                (x["end"] + acc["at"]).alias("end"), x["base"].alias("base"),
                x["code"].alias("code"), x["weak"].alias("weak"))))).alias("out")),
        lambda acc: F.flatten(acc["out"]))
    return F.when(F.size(found) > 0, joined).otherwise(empty)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and the array of candidate spans of each whole text."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    names, out = [], df
    for kinds, base in ((BASE, True), (MORE, False)):
        for kind, regex in kinds.items():
            name = f"{kind}_{'base' if base else 'more'}"
            none = F.array().cast("array<string>")
            there = (F.contains("text", F.lit(GATE[kind])) if base and GATE[kind]
                     else F.rlike("text", F.lit(r"(?i)token|secret|passw|api.?key")) if kind == "secret"
                     else F.rlike("text", F.lit(r"(?i)[\[(]\x20?at\x20?[\])]")) if kind == "email"
                     else F.rlike("text", F.lit("[0-9]")))
            out = out.withColumn(f"{name}_found", F.when(
                there, F.regexp_extract_all("text", F.lit(regex), F.lit(0))).otherwise(none))
            names.append((name, kind, regex, base))
    pieces = {f"{name}_gaps": F.when(F.size(f"{name}_found") > 0, F.split("text", regex, -1))
              .otherwise(F.array().cast("array<string>")) for name, _, regex, _ in names}
    out = out.withColumns(pieces).drop("text")
    spans = [_spans(kind, F.col(f"{name}_gaps"), F.col(f"{name}_found"), base)
             for name, kind, _, base in names]
    return out.select("doc_id", F.concat(*spans).alias("cands"))


def _leaf(rows: list[tuple[int, float, float]]) -> float:
    """Newton step for logistic loss; rows: code, gradient, curvature."""
    return sum(g for _, g, _ in rows) / (sum(h for *_, h in rows) + 1.0)


def _gain(rows: list[tuple[int, float, float]]) -> float:
    return sum(g for _, g, _ in rows) ** 2 / (sum(h for *_, h in rows) + 1.0)


def _tests() -> list[int]:
    """Bits of a code a tree may ask for: every feature, and each bit of the kind."""
    return [1 << k for k in range(len(FEATURES) + (len(KINDS) - 1).bit_length())]


def _grow(rows: list[tuple[int, float, float]], depth: int):
    """A tree: a leaf value, or (bit, tree without it, tree with it)."""
    best = None
    for bit in _tests():
        no, yes = [r for r in rows if not r[0] & bit], [r for r in rows if r[0] & bit]
        if no and yes and (best is None or _gain(no) + _gain(yes) > best[0]):
            best = (_gain(no) + _gain(yes), bit, no, yes)
    if depth == 0 or best is None or best[0] <= _gain(rows) + 1e-9:
        return _leaf(rows)
    return best[1], _grow(best[2], depth - 1), _grow(best[3], depth - 1)


def _value(tree, code: int) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if code & tree[0] else tree[1]
    return tree


def fit_trees(counts: dict[int, tuple[int, int]]) -> list:
    """Boosted trees of depth 3 for counts {code: (candidates, of them positive)}."""
    score, trees = dict.fromkeys(counts, 0.0), []
    for _ in range(TREES if counts else 0):
        rows = []
        for code, (n, y) in counts.items():
            p = 1 / (1 + math.exp(-score[code]))
            rows.append((code, y - n * p, n * p * (1 - p)))
        trees.append(_grow(rows, 3))
        for code in score:
            score[code] += RATE * _value(trees[-1], code)
    return trees


def score_of(trees: list, code: int) -> float:
    return 1 / (1 + math.exp(-RATE * sum(_value(t, code) for t in trees)))


def accepted_codes(fit: dict[int, tuple[int, int]], held_out: dict[int, tuple[int, int]],
                   codes: list[int], precision: float = PRECISION) -> list[int]:
    """Those of ``codes`` that score at or above their kind's threshold.

    The threshold of a kind is the lowest score above which its held-out candidates are right in
    ``precision`` of all cases; 0.5 if that holds for all of them. A kind without labels in the fit
    is scored by trees of all kinds, one without held-out labels takes the threshold of all kinds.
    """
    of_kind = lambda counts, k: {c: v for c, v in counts.items() if c // BITS == k}
    pooled = fit_trees(fit)
    trees = [fit_trees(own) if (own := of_kind(fit, k)) else pooled for k in range(len(KINDS))]

    def lowest(counts: dict[int, tuple[int, int]]) -> float:
        by_score: dict[float, tuple[int, int]] = {}
        for c, (a, b) in counts.items():
            score = score_of(trees[c // BITS], c)
            n, y = by_score.get(score, (0, 0))
            by_score[score] = n + a, y + b
        cut, n, y = 2.0, 0, 0
        for score in sorted(by_score, reverse=True):
            n, y = n + by_score[score][0], y + by_score[score][1]
            if y >= precision * n:
                cut = score
        return min(cut, 0.5) if n and y >= precision * n else cut

    general = max(0.5, lowest(held_out))
    cuts = [lowest(own) if (own := of_kind(held_out, k)) else general for k in range(len(KINDS))]
    return [c for c in codes if score_of(trees[c // BITS], c) >= cuts[c // BITS]]


def find_pii(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """doc_id, base and spans: sorted arrays of (kind number, start, end), in code points.

    Spans of the method that overlap a base span are left out, of overlapping ones among
    themselves all stay. A null or empty text has no spans; texts have no length limit; repeated
    rows and null ids give a row each; an empty table gives an empty result; other columns are
    ignored.
    """
    table = materialize(candidates(docs), "pii-candidates")
    base_c = F.filter("cands", lambda c: c["base"])

    def label(c: Column) -> Column:
        over = lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])
        rest = F.exists("base_c", lambda b: over(b) & (b["k"] == c["k"]) & (b["end"] == c["end"]))
        return (F.when(c["base"], 1)
                .when((c["k"] == KINDS.index("phone")) & rest, 1)
                .when(~F.exists("base_c", over), c["weak"]))

    seen = table.withColumn("base_c", base_c).select(
        F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)).alias("fold"),
        F.explode(F.transform("cands", lambda c: F.struct(
            c["code"].alias("code"), label(c).alias("y")))).alias("c"))
    rows = (seen.groupBy((F.col("fold") == 0).alias("held"), F.col("c.code").alias("code"))
            .agg(F.count("c.y").alias("n"), F.sum("c.y").alias("y")))
    fit, held, codes = {}, {}, set()
    for r in rows.collect():  # at most 2 * len(KINDS) * BITS rows
        codes.add(r["code"])
        if r["n"]:
            (held if r["held"] else fit)[r["code"]] = (r["n"], r["y"])
    good = F.array(*[F.lit(c) for c in accepted_codes(fit, held, sorted(codes), precision)]).cast("array<int>")
    flat = lambda xs: F.array_sort(F.array_distinct(F.transform(
        xs, lambda c: F.struct(c["k"].alias("k"), c["start"].alias("start"), c["end"].alias("end")))))
    base = table.withColumn("base_c", base_c)
    added = base.withColumn("more_c", F.filter("cands", lambda c: (
        ~c["base"] & F.array_contains(good, c["code"])
        & ~F.exists("base_c", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))))
    return added.select("doc_id", flat(F.col("base_c")).alias("base"),
                        flat(F.concat("base_c", "more_c")).alias("spans"))


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[private]") -> Column:
    """``text`` with every span replaced; overlapping spans leave one mark."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.when(fresh, F.concat(
            F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.concat(acc["out"], piece).alias("out"))

    return F.aggregate(by_start, start, cut, lambda acc: F.concat(
        acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
