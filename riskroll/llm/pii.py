"""Personal data and secrets by weak supervision (DataFrame functions and Spark ML only).

Candidates are the base spans of the contract and spans of broader patterns: written-out mail addresses, IPv6 addresses,
long runs of digits and grouped numbers without a valid check digit, national and 00-prefixed phone numbers, and three
kinds more: credentials (``secret``), bank accounts (``iban``) and social security numbers (``ssn``).  Labelers vote 1,
0 (abstain) or -1 on each: the rule (check digits, number ranges, what an assignment names), a gazetteer (top-level
domains and file endings, country codes, issuers, address ranges, token prefixes), the words before the span, and the
shape of its characters.  Expectation-maximisation over the counts of vote patterns (at most 3^4 per kind, all
candidates of all documents) estimates each labeler's reliability; the posterior of a pattern weighs the training of a
logistic regression on votes, votes by kind and span features.  Base spans stay whatever it says; other candidates are
added where its probability is at least one half and no base span of their kind overlaps them.

How it scales: every text is read once, nothing is shuffled but pattern counts; only spans are kept, in the shared
folder.  Patterns are anchored (``\\G`` or a look-behind) and possessive, so long runs cost linear time and no stack;
places are summed in blocks of ``BLOCK`` matches and overlaps found by bisection, so a text may hold many spans.

Defined results: null text is empty (no spans, the hash of an empty string); repeated rows are scored each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_collect, table, written

#: Kinds of the contract, then those that only the method finds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "iban", "ssn")
#: The base patterns of the contract, with anchors and possessive loops that match the same spans in linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BROAD = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20(?=[A-Za-z0-9-]{1,63}\x20dot\x20))"
             r"\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\x20dot\x20|\.)\x20?[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}"
          r"::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?|[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z+.\x20-]|[0-9A-Za-z][\x20-])(?:[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{13,19})(?![0-9A-Za-z]|[\x20-][0-9])",
    "phone": r"(?<![0-9A-Za-z+().-]|[0-9)][\x20/])(?:\(0?[0-9]{2,4}\)|00[1-9][0-9]{0,2}|0[0-9]{1,4}|[2-9][0-9]{2})"
             r"[\x20./-]{1,2}[0-9]{2,4}(?:[\x20./-]?[0-9]{2,4}){1,3}(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z+/_-]{0,64}[0-9])(?=[0-9+/_-]{0,64}[A-Za-z])[A-Za-z0-9+/_-]{16,512}+={0,2}(?![A-Za-z0-9+/_=@-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
}
#: What a text must hold for the base pattern to match, and for the broad one: any of some strings and a pattern.
NEEDS = {"email": ("@", ("(at)", "[at]", "{at}", " dot "), ""), "ip": (".", (":",), "[0-9A-Fa-f]:[0-9A-Fa-f:]"), "card": ("", (), "[0-9]{4}"),
         "phone": ("+", (), r"[0-9)][\x20./-][0-9]"), "secret": ("", (), "[0-9][A-Za-z]|[A-Za-z][0-9]"), "iban": ("", (), "[A-Z]{2}[0-9]{2}"),
         "ssn": ("", ("-",), "[0-9]-[0-9]{2}-[0-9]")}
#: Values on lists of what is personal, and of what is not (fixed values).
GAZETTEER = {
    "email": (r"(?i)(?:\.|dot[\])}]?\x20?)(?:com|org|net|edu|gov|mil|io|co|info|biz|dev|app|ai|me|tv|de|fr|es|uk|eu|it|nl|pl|se|"
              r"no|dk|fi|pt|ch|at|be|cz|ie|us|ca|au|nz|jp|cn|in|br|mx|ru|kr|za|example|test)$",
              r"(?i)\.(?:png|jpe?g|gif|svg|css|js|py|java|html?|txt|zip|local|internal|invalid|[0-9]+)$|^(?:no-?reply|postmaster|mailer-daemon)@"),
    "ip": (r"(?i)^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.|^(?:2[0-9a-f]{3}|fe80|f[cd][0-9a-f]{2}):",
           r"^(?:0|127|255|2(?:2[4-9]|[34][0-9]))\.|^::1?$|^(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}$"),
    "card": (r"^(?:4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|35|30[0-5]|3[68]|6011|64[4-9]|65|62)", r"^(?:[01789])"),
    "phone": (r"^(?:\+|00)(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|^(?:\(0?[1-9]|0[1-9])",
              r"(?:^|[^0-9])0{3}|(?:123456|000000|111111)"),
    "secret": (r"^(?:AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|sk-|sk_live_|pk_live_|rk_live_|xox[abprs]-|eyJ|AIza|ya29|npm_|SG\.)|^[0-9a-f]{40}$",
               r"^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$|^[a-z]+(?:[_/-][a-z0-9]{1,12})+$|/.*/"),
    "iban": (r"^(?:A[DELTZ]|B[AEGHR]|C[HRYZ]|D[EKO]|E[ES]|F[IOR]|G[BEILRT]|H[RU]|I[ELST]|KZ|L[BITUV]|M[CDEKRTU]|N[LO]|P[KLST]|QA|R[OS]|S[AEIKM]|T[NR]|UA|XK)",
             r"^(?:X[A-JL-Z]|[A-Z]{2}0[01])"),
    "ssn": (r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$", r"^(?:000|666|9)|-00-|-0000$"),
}
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|address|from|to|cc|by|user|login)\b",
    "ip": r"(?i)\b(?:ip|ipv[46]|host|server|address|from|login|client|remote|connected|peer|gateway)\b",
    "card": r"(?i)\b(?:card|cc|visa|master(?:card)?|amex|credit|debit|payment|pay|paid|charged?|pan)\b",
    "phone": r"(?i)\b(?:phone|tel(?:ephone)?|call|ring|mobile|cell|fax|contact|whatsapp|sms|text|dial)\b",
    "secret": r"(?i)\b(?:token|secret|password|passwd|pwd|credentials?|api|apikey|bearer|authorization|auth|key)\b|[a-z]_?(?:token|key|secret|password)\b",
    "iban": r"(?i)\b(?:iban|account|konto|bank|transfer|bic|swift|pay)\b",
    "ssn": r"(?i)\b(?:ssn|social|security|tax|id)\b",
}
COUNTER_CUE = {
    "secret": r"(?i)\b(?:sha-?[0-9]{1,3}|md5|commit|checksum|digest|hash|etag|uuid|guid|revision|blob|integrity)\b",
    **dict.fromkeys((*BASE_KINDS, "iban", "ssn"), r"(?i)\b(?:v|version|isbn|issn|doi|serial|invoice|order|section|chapter|figure|article|"
                    r"part|model|build|release|sku|ean|barcode|tracking|page|pp|case|ref)\b"),
}
LABELERS = ("rule", "gazetteer", "context", "shape")
CONTEXT_CHARS = 40
MAX_PATTERNS = 100_000
#: Matches of one text whose places are summed at a time.
BLOCK = 256
_SPANS = "array<struct<value:string,start:int,end:int,before:string>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: SQL of the spans of a pattern in ``text``, per block of matches (one expression, or the plan is built call by call).
_WIDTH = "length(x.between[i - 1]) + length(x.value[i - 1])"
_NUMBERED = f"sequence(block * {BLOCK} + 1, least((block + 1) * {BLOCK}, size(x.value)))"
_STARTS = f"""aggregate(sequence(0, cast(floor((size(x.value) - 1) / {BLOCK}) as int)),
  struct(0 as at, cast(array() as array<int>) as places),
  (a, block) -> struct(a.at + aggregate({_NUMBERED}, 0, (n, i) -> n + {_WIDTH}) as at, concat(a.places, array(a.at)) as places),
  a -> a.places)"""
_INSIDE = f"""aggregate({_NUMBERED}, struct(begin as at, cast(array() as {_SPANS}) as spans),
  (a, i) -> struct(a.at + {_WIDTH} as at, concat(a.spans, array(struct(
    x.value[i - 1] as value, a.at + length(x.between[i - 1]) as `start`, a.at + {_WIDTH} as `end`,
    right(x.between[i - 1], {CONTEXT_CHARS}) as before))) as spans),
  a -> a.spans)"""


def _located(pattern: str) -> Column:
    """Spans of ``pattern`` in code points: the texts between the matches give the places.

    Arrays grow inside a block of matches and by a number per block, so the work is linear in the matches."""
    return F.expr(f"""element_at(transform(
      array(struct(regexp_extract_all(text, r'{pattern}', 0) as value, split(text, r'{pattern}', -1) as between)),
      x -> if(size(x.value) = 0, cast(array() as {_SPANS}), element_at(transform(array({_STARTS}),
        places -> flatten(transform(places, (begin, block) -> {_INSIDE}))), 1))), 1)""")


def _free(broad: Column, base: Column) -> Column:
    """The broad spans that no base span overlaps: the first base span that ends behind a span's start is bisected."""
    def first(s: Column) -> Column:
        def halve(a: Column, _: Column) -> Column:
            middle = F.floor((a["low"] + a["high"]) / 2).cast("int")
            behind = F.get(base, middle)["end"] > s["start"]
            return F.when(a["low"] >= a["high"], a).when(
                behind, F.struct(a["low"].alias("low"), middle.alias("high"))).otherwise(
                F.struct((middle + 1).alias("low"), a["high"].alias("high")))

        steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(base) + 1)).cast("int") + 1)
        return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(base).alias("high")), halve, lambda a: a["low"])

    kept = F.filter(broad, lambda s: F.coalesce(F.get(base, first(s))["start"] >= s["end"], F.lit(True)))
    return F.when((F.size(base) == 0) | (F.size(broad) == 0), broad).otherwise(kept)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        return _let(_digits(value), lambda d: F.when(F.length(d).between(14, 19), F.call_function("luhn_check", d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def _mod97(value: Column) -> Column:
    """Remainder of an account number, its country and check digits last, letters as 10 to 35."""
    plain = F.regexp_replace(value, r"\x20", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).when(
        F.ascii(c) < 65, (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _rule(kind: str, s: Column, digits: Column) -> Column:
    """The vote of a kind's own rule on a broad span."""
    value, before = s["value"], s["before"]
    if kind == "email":
        return _vote(value.rlike(r"(?i)[(\[{]at[)\]}].*[(\[{]dot[)\]}]"), value.rlike(r"[._%+-]{3}"))
    if kind == "ip":
        return _vote(value.rlike(r"(?::[0-9A-Fa-f]{1,4}){5}") & value.rlike("[0-9]"), ~value.rlike("[0-9]") | (F.length(value) < 6))
    if kind == "card":
        return _vote(F.lit(False), ~F.call_function("luhn_check", digits) | ~F.length(digits).between(14, 19))
    if kind == "phone":
        # without a trunk or country prefix only the grouping 3-3-4 may be a telephone number
        return _vote(value.rlike(r"^(?:\(|00)") & F.length(digits).between(9, 14), ~F.length(digits).between(7, 14) | value.rlike(
            r"^(?![2-9][0-9]{2}([\x20./-])[0-9]{3}\1[0-9]{4}$)[1-9]|^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"))
    if kind == "secret":
        assigned = r"(?i)(?:token|secret|passw(?:or)?d|pwd|key|credentials?|bearer|authorization)[\"']?\x20{0,3}(?:[:=]{1,2}>?\x20{0,3}|\x20)[\"']?$"
        named = r"(?i)(?:sha-?[0-9]{1,3}|md5|commit|checksum|digest|hash|etag|u?uid|revision)[\"']?\x20{0,3}[:=\x20]\x20{0,3}[\"']?$"
        return _vote(before.rlike(assigned), before.rlike(named))
    if kind == "iban":
        return _let(_mod97(value), lambda rest: _vote(rest == 1, rest != 1))
    return _vote(F.lit(False), value.rlike(r"^(?:000|666|9)|-00-|-0000$"))


def _candidate(kind: str, s: Column, base: bool) -> Column:
    """A span with its votes and discrete features."""
    return _let(_digits(s["value"]), lambda digits: _voted(kind, s, digits, base))


def _voted(kind: str, s: Column, digits: Column, base: bool) -> Column:
    value = s["value"]
    one_digit = digits.rlike(r"^([0-9])\1+$")
    odd_shape = {"email": value.rlike(r"^[._%+-]|[.-]{2}"), "secret": value.rlike(r"(.)\1{5}|^[A-Za-z]+[0-9]{1,4}$|[0-9]{16}"),
                 "ip": value.rlike(r"(?:^|\.)0[0-9]")}.get(kind, one_digit)
    usual = {"email": F.length(value).between(6, 60), "ip": F.length(value).between(7, 39),
             "card": F.length(digits).isin(14, 15, 16), "phone": F.length(digits).between(9, 13),
             "secret": F.size(F.array_distinct(F.split(value, ""))) >= 10,
             "iban": F.length(value).between(15, 42), "ssn": F.lit(True)}[kind]
    yes, no = GAZETTEER[kind]
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base"),
        (F.lit(1) if base else _rule(kind, s, digits)).alias("rule"),
        _vote(value.rlike(yes), value.rlike(no)).alias("gazetteer"),
        _vote(s["before"].rlike(CUES[kind]), s["before"].rlike(COUNTER_CUE[kind])).alias("context"),
        _vote(usual, odd_shape).alias("shape"),
        F.least(F.length(value) / 8, F.lit(4)).cast("int").alias("size"),
        F.when(value.rlike(r"[\x20()\[\]]"), 1).otherwise(0).alias("spaced"))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and the candidate spans of every whole text, per kind and in total."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = df.select("doc_id", *[c for kind in KINDS for c in _found(kind)])
    return df.select("doc_id", F.concat(*[c for kind in KINDS for c in _judged(kind)]).alias("spans"))


def _found(kind: str) -> list[Column]:
    """Valid base spans (of the contract's kinds) and broad spans of one kind."""
    none, text, (base_need, strings, pattern) = F.array().cast(_SPANS), F.col("text"), NEEDS[kind]
    needed = reduce(or_, map(text.contains, strings)) if strings else F.lit(True)
    broad = F.when(needed & text.rlike(pattern), _located(BROAD[kind])).otherwise(none)
    if kind not in BASE:
        return [broad.alias(f"{kind}_broad")]
    base = F.when(text.contains(base_need), _located(BASE[kind])).otherwise(none)
    return [F.filter(base, lambda s: _valid(kind, s["value"])).alias(f"{kind}_base"), broad.alias(f"{kind}_broad")]


def _judged(kind: str) -> list[Column]:
    """Candidates of one kind: its base spans, and the broad ones that no base span overlaps."""
    if kind not in BASE:
        return [F.transform(f"{kind}_broad", lambda s: _candidate(kind, s, False))]
    return [F.transform(f"{kind}_base", lambda s: _candidate(kind, s, True)),
            F.transform(_free(F.col(f"{kind}_broad"), F.col(f"{kind}_base")), lambda s: _candidate(kind, s, False))]


def estimate(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 50) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Prior and, per labeler, P(vote | personal) and P(vote | other), by expectation-maximisation over counted patterns.

    Starts from the share of positive votes; one pseudo-count keeps every probability above zero.
    """
    width = len(patterns[0][0])
    belief = [(sum(v > 0 for v in votes) + 0.5) / (sum(v != 0 for v in votes) + 1) for votes, _ in patterns]
    prior, tables = 0.5, []
    for _ in range(rounds):
        yes = sum(n * b for (_, n), b in zip(patterns, belief))
        no = sum(n * (1 - b) for (_, n), b in zip(patterns, belief))
        prior = (yes + 1) / (yes + no + 2)
        tables = []
        for i in range(width):
            seen = {v: [1.0, 1.0] for v in (-1, 0, 1)}
            for (votes, n), b in zip(patterns, belief):
                seen[votes[i]][0] += n * b
                seen[votes[i]][1] += n * (1 - b)
            tables.append({v: (a / (yes + 3), b / (no + 3)) for v, (a, b) in seen.items()})
        belief = []
        for votes, _ in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(t[v][0] / t[v][1]) for t, v in zip(tables, votes))
            belief.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return prior, tables


_NUMBERS = ("size", "spaced")


def _cell(get, name: str) -> Column:
    """Place of a labeler's vote on a kind among its 3 votes on every kind, from 0."""
    return get("kind") * 3 + get(name) + 1


def _features(get) -> Column:
    """Votes by kind, one place of a labeler's block set to 1, then the numbers."""
    blocks = [_let(_cell(get, name), lambda at: F.transform(
        F.sequence(F.lit(0), F.lit(3 * len(KINDS) - 1)), lambda j: (j == at).cast("double"))) for name in LABELERS]
    return F.concat(*blocks, F.array(*[get(x).cast("double") for x in _NUMBERS]))


def _log_odds(get, tables: list[list[float]]) -> Column:
    """Sum over the labelers of a table's entry at the vote on the kind."""
    return sum((F.element_at(F.lit(t), _cell(get, name) + 1) for name, t in zip(LABELERS, tables)), F.lit(0.0))


def train(found: DataFrame) -> list[float] | None:
    """Coefficients (the intercept last) of the final classifier, learned from the labelers' posteriors; None without spans."""
    keys = ["kind", *LABELERS, *_NUMBERS]
    counts = written(found.select(F.explode("spans").alias("s")).select(*[f"s.{k}" for k in keys])
                     .groupBy(*keys).count(), "pii-patterns")
    rows = bounded_collect(counts, MAX_PATTERNS, "patterns")
    if not rows:
        return None
    priors, odds = [0.0] * len(KINDS), [[0.0] * 3 * len(KINDS) for _ in LABELERS]
    for kind in range(len(KINDS)):
        own: dict[tuple[int, ...], float] = {}
        for r in rows:
            if r["kind"] == kind:
                votes = tuple(r[x] for x in LABELERS)
                own[votes] = own.get(votes, 0) + r["count"]
        if not own:
            continue
        prior, tables = estimate(sorted(own.items()))
        priors[kind] = math.log(prior / (1 - prior))
        for out, t in zip(odds, tables):
            for v, (a, b) in t.items():
                out[kind * 3 + v + 1] = math.log(a / b)
    total = F.element_at(F.lit(priors), F.col("kind") + 1) + _log_odds(F.col, odds)
    belief = counts.select("count", array_to_vector(_features(F.col)).alias("features"), (1 / (1 + F.exp(-total))).alias("belief"))
    examples = belief.withColumn("label", F.explode(F.array(F.lit(1.0), F.lit(0.0)))).withColumn(
        "weight", F.col("count") * F.when(F.col("label") == 1, F.col("belief")).otherwise(1 - F.col("belief")))
    model = LogisticRegression(weightCol="weight", regParam=0.001, maxIter=50).fit(examples)
    return [*map(float, model.coefficients), float(model.intercept)]


def detect(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans``: kind, start, end (code points), base; by start, then kind."""
    found = written(candidates(docs), "pii-spans")
    model = train(found)

    def probable(s: Column) -> Column:
        if model is None:
            return F.lit(False)
        width = 3 * len(KINDS)
        tables = [model[i * width:(i + 1) * width] for i in range(len(LABELERS))]
        numbers = sum((s[x] * weight for x, weight in zip(_NUMBERS, model[-1 - len(_NUMBERS):])), F.lit(model[-1]))
        return _log_odds(lambda name: s[name], tables) + numbers >= 0

    chosen = F.filter("spans", lambda s: s["base"] | probable(s))
    ordered = F.array_sort(F.transform(chosen, lambda s: F.struct(s["start"], s["kind"], s["end"], s["base"])))
    return found.select("doc_id", F.transform(ordered, lambda s: F.struct(
        F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1).alias("kind"), s["start"].alias("start"),
        s["end"].alias("end"), s["base"].alias("base"))).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: base and added spans of personal data in every document, and how many there are in all."""
    df = detect(table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])

    def joined(spans) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return df.select("doc_id", *map(number, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"),
                     joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
