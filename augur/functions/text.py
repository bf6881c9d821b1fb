"""Titles, markup, identifiers and hashes as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: All white space, in a form that Java and RE2 read alike; the longest title.
SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LONGEST_TITLE = 256

#: What the rule main_page_and_namespaces_v1 keeps out, by title and by prefix.
RULES = {"main_page_and_namespaces_v1": (
    ("Main_Page",),
    ("Special:", "Wikipedia:", "Portal:", "Help:", "File:", "Template:", "Category:", "Draft:", "User:", "Talk:", "Wikipedia_talk:", "Portal_talk:", "Help_talk:", "File_talk:", "Template_talk:", "Category_talk:", "Draft_talk:", "User_talk:"),
)}


def _plain_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, f"{SPACE}+", "_"), F.lit("_"))


def title_problem(title: Column) -> Column:
    """Why a title is refused; null for a good one."""
    plain = _plain_title(title)
    return F.when(title.isNull(), "missing").when(plain == "", "empty").when(F.length(plain) > LONGEST_TITLE, "too long")


def canonical_title(title: Column) -> Column:
    """White space runs as one underscore, none at the ends, the first letter alone in upper case. Null for what title_problem refuses: no title is ever cut."""
    plain = _plain_title(title)
    return F.when(title_problem(title).isNull(), F.concat(F.upper(F.substring(plain, 1, 1)), F.substr(plain, F.lit(2))))


def excluded(title: Column, rule: str) -> Column:
    """Whether a rule keeps a canonical title out; an unknown rule is an error."""
    if rule not in RULES:
        raise ValueError(f"unknown exclusion rule {rule!r}; known: {sorted(RULES)}")
    titles, prefixes = RULES[rule]
    return reduce(lambda a, b: a | b, [F.startswith(title, F.lit(p)) for p in prefixes], title.isin(list(titles)))


def titled(df: DataFrame, column: str, rule: str | None = None) -> DataFrame:
    """df with title, problem and, by a rule, excluded of the titles in a column.

    In steps that Catalyst keeps apart, so the pattern runs once over a text, and what is refused is tested no further.
    """
    plain = df.withColumn("_plain", _plain_title(F.col(column)))
    problem = F.when(F.col("_plain").isNull(), "missing").when(F.col("_plain") == "", "empty").when(F.length("_plain") > LONGEST_TITLE, "too long")
    judged = plain.withColumn("problem", problem)
    canonical = F.when(F.col("problem").isNull(), F.concat(F.upper(F.substring("_plain", 1, 1)), F.substr("_plain", F.lit(2))))
    found = judged.withColumn("title", canonical).drop("_plain")
    return found.withColumn("excluded", excluded(F.col("title"), rule)) if rule else found


def archive_key(*parts: Column) -> Column:
    return F.regexp_replace(F.concat_ws("__", *parts), "[^A-Za-z0-9._-]+", "_")


def strip_junk(body: Column) -> Column:
    """Without the line that guards a JSON reply against being run as a script."""
    return F.regexp_replace(body, r"^\)\]\}'[^\n]*\n", "")


#: Wiki markup in the order in which it goes, and what stays of it. Comments and all other tags go last.
MARKUP = (
    (r"(?s)<ref[^>]*>.*?</ref>|<ref[^>]*/>", ""), (r"\{\{ill\|([^|}]+)[^}]*\}\}", "$1"), (r"\{\{[^{}]*\}\}", ""), (r"\[\[[^\]|]*\|([^\]]+)\]\]", "$1"), (r"\[\[([^\]]+)\]\]", "$1"),
    (rf"\[https?://\S+?{SPACE}+([^\]]+)\]", "($1)"), (r"\[https?://\S+?\]", ""), (r"'''?", ""), (r"<[^>]+>", ""), (f"{SPACE}+", " "),
)


def strip_markup(body: Column) -> Column:
    return F.trim(reduce(lambda c, rule: F.regexp_replace(c, *rule), MARKUP, body))


def family(entrant: Column) -> Column:
    """A model's id without its harness."""
    return F.regexp_replace(entrant, r"-web(-superfc)?$", "")


def harness(entrant: Column) -> Column:
    return F.when(F.endswith(entrant, F.lit("-web-superfc")), "web-superfc").when(F.endswith(entrant, F.lit("-web")), "web").otherwise("plain")


#: The labels that are told in public, in order, and what in a message stands for each; wordings that no retry can help.
LABELS = (
    (r"\bno [a-z0-9_]+ in the environment\b", "provider credential not configured"), (r"output limit|finish_reason=length", "provider output limit"), (r"timeout|timed out", "provider timeout"),
    (r"rate limit", "provider rate limit"), (r"stream|connection", "provider transport failure"), (r"parse|non-json|no text", "provider response invalid"),
)
TERMINAL = (
    "invalid_api_key", "incorrect api key", "account_deactivated", "organization has been disabled", "does not exist or you do not have access", "permission denied", "forbidden", "unauthorized", "authentication",
    "insufficient_quota", "credit_balance_exhausted", "no credits remaining", "billing", "unknown entrant", "unknown model", "no configured route",
)
MALFORMED = (
    "malformed", "parsed to zero", "built to zero", "zero points", "parse error", "failed to parse", "structure changed", "schema changed", "missing required", "refusing to guess", "invalid extraction",
    "not an xlsx", "not a readable xlsx", "no sheet named", "has no sheetdata element", "the sce header row", "missing median", "reached its data rows before naming", "unreadable cell address", "not a yyyymm", "not a number; a",
    "not a median expected inflation", "history jumps from", "inflation sheet parsed to", "the sce history starts at", "no conference board headline", "no month is named", "the page says the index moved", "endpoint contract changed",
    "carries no widgets", "no timeseries widget", "returned an empty timeline", "returned an empty basket timeline", "not weekly", "google trends row carries", "google trends basket row carries", "response does not answer the request",
    "returned nothing", "no civiqs tracker payload", "carries no line_chart_data", "served its index page", "ignored the subgroup filter", "has no values", "no overlapping dates", "has no dated points", "returned no daily rows",
    "returned no items", "returned no articles", "refusing to archive it under the wrong day", "top pageviews listed",
)


def error_text(message: Column) -> Column:
    """One line of 1,000 characters at most; an empty message is an unknown error."""
    line = F.trim(F.regexp_replace(message, f"{SPACE}+", " "))
    return F.when(message.isNull(), F.lit(None).cast("string")).when(line == "", "unknown error").otherwise(F.substring(line, 1, 1000))


def http_status(message: Column) -> Column:
    return F.nullif(F.regexp_extract(error_text(message), r"(?i)\bHTTP\s+([0-9]{3})\b", 1), F.lit("")).cast("int")


def public_error(message: Column) -> Column:
    """What of a failed call is told in public: fixed labels only, the status first."""
    lower, status = F.coalesce(F.lower(error_text(message)), F.lit("")), http_status(message)
    label = reduce(lambda acc, rule: acc.when(lower.rlike(rule[0]), rule[1]), LABELS, F.when(status.isNotNull(), F.concat(F.lit("provider HTTP "), status)))
    return label.otherwise("provider call failed")


def terminal(message: Column, source: bool = False) -> Column:
    """Whether a retry can't help. source: of a source's reply, where malformed bytes stay malformed."""
    lower = F.coalesce(F.lower(error_text(message)), F.lit(""))
    words = reduce(lambda a, w: a | F.contains(lower, F.lit(w)), TERMINAL + (MALFORMED if source else ()), F.lit(False))
    return F.coalesce(http_status(message).isin(401, 403, 404), F.lit(False)) | words | lower.rlike(LABELS[0][0])


def identity(*parts: Column) -> Column:
    """SHA-256 of the parts with their names in order: what makes two calls the same call."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def stable_offset(entrant: Column, question: Column) -> Column:
    """A number from -1 to 1 that depends on both names only."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", entrant, question), 256), 1, 2), 16, 10).cast("int") / 127.5 - 1
