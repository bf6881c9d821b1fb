"""PII (3): weak-supervision aggregation, with DataFrame operations only.

Candidate spans come from one pattern for each kind, the base patterns and looser ones (addresses and numbers written
out or with other separators, long IP addresses, numbers without a plus, secrets of any length). Five labelers vote on
each candidate (1 for, -1 against, 0 abstains): validity of the base form, gazetteers, context words in the CONTEXT
characters before it, its boundaries, and its shape. Counts of the patterns of votes and features go to the driver, at
most 3**5 * 2**10 for each kind and some dozens in practice. There expectation-maximisation estimates each labeler's
reliability without labels.

The final span classifier doesn't see the votes: it is a logistic model over ten features of the span and its
surroundings (FEATURES), trained on the posteriors that EM gives each candidate, and it decides on every looser
candidate. So what labelers agree on where they vote reaches spans on which they abstain. Base spans always stay;
matches of a base pattern that fail its checks (a number that is no card) only teach what is false, and are never added.

Places are code points. A null text counts as empty and has no spans; a table without candidates trains nothing; a text
may have any number of candidates. Rows are independent: repeated rows, null doc_ids and extra columns pass through,
but for columns named like the results (_base, _spans), which give way. Of looser candidates that overlap base spans of
their kind none is added; overlapping spans of different kinds all stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from augur.llm.util import save, shielded, table

#: Kinds in the order of the results.
KINDS = ("email", "ip", "card", "phone", "secret")

#: The base patterns, written so that no text makes them slow. A match starts where a run of its first
#: characters starts, or where the last match ended; what is possessive here never has to give back.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Candidates beyond the base, of any length.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(](?:dot|DOT)[\])]\x20?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++|\x20(?:at|AT)\x20[A-Za-z0-9-]++(?:\x20(?:dot|DOT)\x20[A-Za-z0-9-]++)++)",
    "ip": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])|[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\x20dot\x20)[0-9]{1,3}){3}(?![0-9]))",
    "card": r"(?<![0-9./_])[0-9]{4}(?:(?:[./_]|\x20{2,3}|\x20-\x20)[0-9]{4}){3}(?![0-9]|[./_][0-9])",
    "phone": r"(?<![0-9A-Za-z+.(-])(?<![0-9][\x20.-])(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9][A-Za-z0-9_-]{31,}+",
}

#: A quick test that a text can hold a kind at all.
HINT = {"email": r"@|[\[(\x20](?:at|AT)[\])\x20]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]", "secret": "[A-Za-z0-9_-]{32}"}

#: Gazetteers. Endings of domains, the first digits of card numbers, calling codes, networks that name nobody.
DOMAINS = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "io", "biz", "name", "example", "at", "au", "be", "br", "ca", "ch", "cn", "cz", "de", "dk", "es", "eu", "fi", "fr", "gr", "ie", "in", "it", "jp", "kr", "mx", "nl", "no", "nz", "pl", "pt", "ru", "se", "uk", "us")
ISSUERS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "6011", "65", "35", "30", "36", "38", "50", "56", "57", "58", "62")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98", "212", "213", "216", "351", "352", "353", "354", "358", "359", "370", "371", "372", "380", "420", "421", "852", "886", "966", "971", "972")
NOBODY = ("0", "127", "255")

#: Context words before a candidate, for and against.
FOR = {
    "email": r"(?i)\b(e-?mail|contact|write|reach|courriel|correo|mailto)", "ip": r"(?i)\b(ip|host|server|address|login|client)", "card": r"(?i)\b(card|visa|carte|karte|tarjeta|payment)", "phone": r"(?i)\b(tel|phone|call|mobile|fax|ruf|llam)", "secret": r"(?i)\b(token|secret|key|password|passwd|api|bearer)",
}
AGAINST = {
    "email": r"(?i)\b(package|version)", "ip": r"(?i)\b(version|release|v|section|chapter)\W*$", "card": r"(?i)\b(isbn|order|invoice|sha|id)\b", "phone": r"(?i)\b(isbn|order|version|page)\b", "secret": r"(?i)\b(commit|sha|md5|hash|checksum|revision)",
}
SHAPE = {
    "email": r"^\S{6,}$", "ip": r"^([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$|^[1-9][0-9]{0,2}\.(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})$", "card": r"^([0-9]{13,19}|([0-9]{4}[\x20./_-]){3}[0-9]{1,7})$",
    "phone": r"^[\x20(]?\+?[0-9(][0-9().\x20-]{7,20}[0-9]$", "secret": r"^([a-f0-9]{32,}|[A-F0-9]{32,})$",
}
VOTES, ROUNDS, BLOCK, CONTEXT, THRESHOLD = 5, 50, 256, 60, 0.5

#: What the span classifier sees of a candidate.
FEATURES = ("long", "half_digits", "letters", "separators", "plus_or_bracket", "opened", "closed", "told_for", "told_against", "mixed")


def found(text: Column, pattern: str, values: Column | None = None) -> Column:
    """array of (start, end, value, before, after) of the pattern's matches: running sums of what lies between them.

    Sums run within blocks of BLOCK matches, then over the blocks, so many matches in one text are no square. values: the
    matches, where they are known; a text without any isn't split.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) if values is None else values
    blank = F.expr("array_repeat(cast(null as string), 0)")
    return blocks(F.coalesce(values, blank), F.when(F.size(values) > 0, F.split(text, pattern, -1)).otherwise(blank))


def blocks(values: Column, gaps: Column) -> Column:
    n = F.size(values)
    steps = F.zip_with(F.zip_with(values, F.slice(gaps, 1, n), lambda v, g: F.struct(v.alias("v"), g.alias("g"))), F.slice(gaps, 2, n), lambda x, a: F.struct(x["v"].alias("v"), F.length(x["g"]).alias("g"), F.substring(x["g"], -CONTEXT, CONTEXT).alias("b"), F.substring(a, 1, 2).alias("a")))
    parts = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda i: F.slice(steps, i * BLOCK + 1, BLOCK)))
    empty = F.expr("array_repeat(named_struct('start', 0, 'end', 0, 'value', '', 'before', '', 'after', ''), 0)")

    def place(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        end = start + F.length(x["v"])
        row = F.struct(start.alias("start"), end.alias("end"), x["v"].alias("value"), x["b"].alias("before"), x["a"].alias("after"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

    def add(acc: Column, block: Column) -> Column:
        done = F.aggregate(block, F.struct(acc["at"].alias("at"), empty.alias("out")), place)
        return F.struct(done["at"].alias("at"), F.concat(acc["out"], F.array(done["out"])).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.expr("array_repeat(array_repeat(named_struct('start', 0, 'end', 0, 'value', '', 'before', '', 'after', ''), 0), 0)").alias("out"))
    return F.coalesce(F.flatten(F.aggregate(parts, start, add)["out"]), empty)


def valid(kind: str, value: Column) -> Column:
    """Whether a match of a base pattern passes the kind's checks."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "card":
        doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        digit = lambda i: F.substr(digits, i, F.lit(1)).cast("int")
        total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + F.when((F.length(digits) - i) % 2 == 1, doubled(digit(i))).otherwise(digit(i)))
        return F.length(digits).between(13, 19) & (total % 10 == 0)
    return F.lit(True)


def listed(kind: str, value: Column) -> Column:
    """Whether a gazetteer knows the value."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    starts = lambda known: F.substring(digits, 1, 1).isin(*known) | F.substring(digits, 1, 2).isin(*known) | F.substring(digits, 1, 3).isin(*known) | F.substring(digits, 1, 4).isin(*known)
    if kind == "email":
        return F.lower(F.regexp_extract(value, "([A-Za-z]+)$", 1)).isin(*DOMAINS)
    if kind == "ip":
        return ~F.regexp_extract(value, "^([0-9]+)", 1).isin(*NOBODY)
    if kind == "card":
        return starts(ISSUERS)
    if kind == "phone":
        return F.when(F.startswith(value, F.lit("+")), starts(CALLING)).otherwise(F.regexp_like(value, F.lit(r"^\(?0|^\([2-9]|^[2-9]")))
    return F.regexp_like(value, F.lit("^(?=.*[0-9])(?=.*[A-Za-z])"))


def candidate(kind: str, x: Column, base: bool) -> Column:
    """A candidate with its votes (v0 to v4) and its features, as bits of f."""
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    value, before, after = x["value"], x["before"], x["after"]
    good = valid(kind, value) if base else F.lit(False)
    inside = F.lit(r"[\p{L}\p{N}]")
    whole = ~F.regexp_like(F.substring(before, -1, 1), inside) & ~F.regexp_like(F.substring(after, 1, 1), inside)
    told, denied = F.regexp_like(before, F.lit(FOR[kind])), F.regexp_like(before, F.lit(AGAINST[kind]))
    fits = F.regexp_like(value, F.lit(SHAPE[kind]))
    if kind in ("ip", "card") and not base:  # what the base's checks say of the digits alone
        plain = F.regexp_replace(value, r"[\[\](). /_-]|dot", "." if kind == "ip" else "")
        checked = valid(kind, F.regexp_replace(plain, r"\.+", ".")) if kind == "card" else F.lit(True)
        votes0 = vote(checked, ~checked)
    else:
        votes0 = vote(good, F.lit(base))
    votes = [votes0, vote(listed(kind, value), F.lit(True)), vote(told & ~denied, denied), vote(whole, ~whole), vote(fits, F.lit(True))]
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    features = [
        F.length(value) > 20, 2 * digits >= F.length(value), F.regexp_like(value, F.lit(r"\p{L}")), F.regexp_like(value, F.lit(r"[\x20().-]")), F.regexp_like(value, F.lit(r"^[+(]")),
        F.regexp_like(before, F.lit(r"(^|[\"'=:|<(\n])\x20*$")), F.regexp_like(after, F.lit(r"^([\"'|>).,;\n]|$)")), told, denied, (digits > 0) & F.regexp_like(value, F.lit("[a-z]")) & F.regexp_like(value, F.lit("[A-Z]")),
    ]
    bits = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(features)), F.lit(0))
    return F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), good.alias("base"), F.lit(not base).alias("loose"), *[v.alias(f"v{i}") for i, v in enumerate(votes)], bits.alias("f"))


def candidates(docs: DataFrame) -> DataFrame:
    """docs (text, any others) without text, with _candidates: all of a text, of all kinds."""
    others = [c for c in docs.columns if c != "text"]
    text = F.coalesce("text", F.lit(""))
    patterns = [(f"_{b}_{k}", k, p) for b, by in (("base", BASE), ("loose", LOOSE)) for k, p in by.items()]
    matched = docs.select(*others, text.alias("text"), *[F.when(text.rlike(HINT[k]), F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias(name) for name, k, p in patterns])
    staged = matched.select(*others, *[found(F.col("text"), p, F.col(name)).alias(name) for name, _, p in patterns])
    none = F.expr("array_repeat(named_struct('kind', 0, 'start', 0, 'end', 0, 'base', true, 'loose', true, 'v0', 0, 'v1', 0, 'v2', 0, 'v3', 0, 'v4', 0, 'f', 0), 0)")
    voted = lambda kind, base: lambda x: candidate(kind, x, base)
    parts = [F.coalesce(F.transform(f"_{b}_{k}", voted(k, b == "base")), none) for b, by in (("base", BASE), ("loose", LOOSE)) for k in by]
    return staged.select(*others, F.concat(*parts).alias("_candidates"))


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def reliabilities(counts: dict[tuple[int, ...], int]) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """EM over vote patterns: the share of true spans, and for each labeler and vote its odds (given true, given false)."""
    total = sum(counts.values())
    share = 0.5
    table_ = [{1: (0.7, 0.2), -1: (0.2, 0.7), 0: (0.1, 0.1)} for _ in range(VOTES)]  # labelers are right more often than not
    for _ in range(ROUNDS):
        post = {v: posterior(v, share, table_) for v in counts}
        true = sum(post[v] * n for v, n in counts.items())
        share = (true + 1) / (total + 2)
        table_ = []
        for j in range(VOTES):
            seen = {x: (sum(post[v] * n for v, n in counts.items() if v[j] == x), sum((1 - post[v]) * n for v, n in counts.items() if v[j] == x)) for x in (1, -1, 0)}
            table_.append({x: ((a + p) / (true + 10), (b + q) / (total - true + 10)) for x, (a, b) in seen.items() for p, q in [((7, 2) if x == 1 else (2, 7) if x == -1 else (1, 1))]})
    return share, table_


def posterior(votes: tuple[int, ...], share: float, table_: list[dict[int, tuple[float, float]]]) -> float:
    odds = math.log(share / (1 - share)) + sum(math.log(table_[j][v][0] / table_[j][v][1]) for j, v in enumerate(votes))
    return sigmoid(odds)


def classifier(counts: dict[tuple[tuple[int, ...], int], int]) -> list[float]:
    """Weights of the FEATURES and the intercept of the span classifier. counts: of (votes, features as bits).

    Each pattern of features is trained on the mean of the posteriors that EM gives the votes of its candidates.
    """
    votes: dict[tuple[int, ...], int] = {}
    for (v, _), n in counts.items():
        votes[v] = votes.get(v, 0) + n
    share, table_ = reliabilities(votes)
    rows: dict[int, list[float]] = {}
    for (v, f), n in counts.items():
        row = rows.setdefault(f, [0.0, 0.0])
        row[0] += n
        row[1] += n * posterior(v, share, table_)
    total, w = sum(counts.values()), [0.0] * (len(FEATURES) + 1)
    data = [([f >> i & 1 for i in range(len(FEATURES))] + [1], n / total, p / n) for f, (n, p) in rows.items()]
    for _ in range(600):
        grad = [0.003 * x for x in w[:-1]] + [0.0]
        for x, n, p in data:
            error = n * (sigmoid(sum(a * b for a, b in zip(w, x, strict=True))) - p)
            for j, on in enumerate(x):
                grad[j] += error * on
        w = [a - 1.0 * g for a, g in zip(w, grad, strict=True)]
    return w


def train(found_: DataFrame) -> dict[int, list[float]]:
    """The span classifier of each kind. Reads counts of patterns of votes and features only: their number has a bound, whatever the table's size."""
    rows = found_.select(F.explode("_candidates").alias("c")).groupBy("c.kind", *[f"c.v{i}" for i in range(VOTES)], "c.f").agg(F.count("*").alias("n")).collect()
    kinds: dict[int, dict[tuple[tuple[int, ...], int], int]] = {}
    for r in rows:
        kinds.setdefault(r["kind"], {})[tuple(r[f"v{i}"] for i in range(VOTES)), r["f"]] = r["n"]
    return {k: classifier(dict(sorted(c.items()))) for k, c in sorted(kinds.items())}


def logit_of(candidate: Column, models: dict[int, list[float]]) -> Column:
    """The classifier's log odds of a candidate; far below zero where nothing was trained."""
    own = lambda w: sum((F.when(F.shiftright(candidate["f"], i) % 2 == 1, w[i]).otherwise(0.0) for i in range(len(FEATURES))), F.lit(w[-1]))
    return F.coalesce(*[F.when(candidate["kind"] == k, own(w)) for k, w in models.items()], F.lit(-1e9))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


@shielded("text")
def private_spans(docs: DataFrame) -> DataFrame:
    """docs (text, any others) without text, with _base and _spans: sorted arrays of (kind, start, end). Base spans are in both."""
    found_ = save(candidates(docs), "candidates")
    models = train(found_)
    span = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    base = F.transform(F.filter("_candidates", lambda c: c["base"]), span)
    more = F.transform(F.filter("_candidates", lambda c: c["loose"] & (logit_of(c, models) >= math.log(THRESHOLD / (1 - THRESHOLD)))), span)
    docs = found_.withColumn("_base", F.array_sort(base)).withColumn("_more", more)
    apart = lambda m: ~F.exists("_base", lambda b: (b["kind"] == m["kind"]) & (b["start"] < m["end"]) & (m["start"] < b["end"]))
    return docs.withColumn("_spans", F.array_sort(F.array_distinct(F.concat("_base", F.filter("_more", apart))))).drop("_candidates", "_more")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every whole text the counts and digest of its base spans, and all spans; n_spans counts these. Edge cases as in the module's docstring."""
    docs = private_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("_base", lambda b: b["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return docs.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(joined(F.col("_base")), 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"), F.size("_spans").cast("long").alias("n_spans"))
