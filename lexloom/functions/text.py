"""Column functions over chunks, citations and authority: tokens, keys, profiles, dates, sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The forms of citations and clauses.
REPORTED = r"\d+ T\.C\. No\. \d+"
MEMO = r"T\.C\. Memo\. \d{4}-\d+"
OPINION = rf"{REPORTED}|{MEMO}"
NESTED = r"\[([^\[\]]*?),?\s*\[([^\[\]]+)\]\]"
PART = r"^[ \t]*(?:#+[ \t]*)?\**[ \t]*Part[ \t]+(\d+)[ \t]*[:.\-–—][ \t]*(.*?)[ \t]*\**[ \t]*$"
EXPIRES = r"applicability of (this section|paragraphs?\b.*?) expires (?:on )?(?:or before )?([A-Z][a-z]+ \d{1,2}, \d{4})"
ISSUED = r"\b([A-Z][a-z]{2,8})\.? (\d{1,2}), (\d{4})"
SUNSET_FROM = "1988-11-20"
#: What an authority profile is called.
AUTHORITY_LABELS = {
    ("statute", "enacted"): "Statute",
    ("regulation", "final"): "Treasury regulation",
    ("regulation", "temporary"): "Treasury regulation (temporary)",
    ("regulation", "temporary_partly_expired"): "Treasury regulation (temporary)",
    ("regulation", "final_prior_version"): "Treasury regulation (earlier version)",
    ("opinion", "reported"): "Tax Court opinion (reported)",
    ("opinion", "memorandum"): "Tax Court memorandum opinion",
    ("publication", "not_binding"): "IRS publication (not binding)",
    ("client document", "client"): "Client document",
}
#: Which sources each kind of sub-query may search; client facts are never searched, unrouted means all.
ROUTES = {"statutory": ["usc", "ecfr", "irs_pub"], "case_law": ["case"]}
#: Leading bytes of the uploads that are accepted.
MAGIC = {"pdf": b"%PDF", "png": b"\x89PNG", "jpeg": b"\xff\xd8\xff", "tiff": b"II*\x00", "tiff ": b"MM\x00*"}


def words(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\s]+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\s]+"))


def tokens_of_words(n: Column) -> Column:
    """Estimated tokens of n words: 1.3 a word, halves to even."""
    return F.bround(n * F.lit(1.3), 0).cast("int")


def estimate_tokens(text: Column) -> Column:
    return tokens_of_words(word_count(text))


def chunk_key(citation: Column, excluded: Column, part: Column) -> Column:
    return F.concat_ws("#", citation, F.coalesce(F.nullif(excluded, F.lit("")), F.lit("body")), part.cast("string"))


def authority(source: Column, citation: Column, section: Column, partly_expired: Column) -> Column:
    """struct(type, status, level) from the source and the forms of citation and section, never from the text."""

    def profile(kind: str, status: Column | str, level: int) -> Column:
        return F.struct(F.lit(kind).alias("type"), (F.lit(status) if isinstance(status, str) else status).alias("status"), F.lit(level).alias("level"))

    regulation = (
        F.when(section.rlike(r"\dA$"), "final_prior_version")
        .when(section.endswith("T") & partly_expired, "temporary_partly_expired")
        .when(section.endswith("T"), "temporary")
        .otherwise("final")
    )
    return (
        F.when(source == "usc", profile("statute", "enacted", 4))
        .when(source == "ecfr", profile("regulation", regulation, 4))
        .when((source == "case") & citation.rlike(REPORTED), profile("opinion", "reported", 3))
        .when((source == "case") & citation.rlike(MEMO), profile("opinion", "memorandum", 2))
        .when(source == "irs_pub", profile("publication", "not_binding", 1))
        .when(source == "client", profile("client document", "client", 0))
        .otherwise(profile("unknown", "unknown", 0))
    )


def authority_label(kind: Column, status: Column) -> Column:
    out = F.lit(None).cast("string")
    for (t, s), label in AUTHORITY_LABELS.items():
        out = F.when((kind == t) & (status == s), label).otherwise(out)
    return F.coalesce(out, F.lit("Authority unknown"))


def revision(source: Column, as_of: Column) -> Column:
    day = F.regexp_replace(as_of.cast("string"), r"^\+", "")  # years of five digits and more have a sign
    return (
        F.when(source == "ecfr", F.concat(F.lit("eCFR "), day))
        .when(source == "case", F.concat(F.lit("filed "), day))
        .when((source == "irs_pub") & (as_of > F.lit("1900-01-01").cast("date")), F.concat(F.substring(day, 1, 4), F.lit(" edition")))
    )


def expiry(text: Column, as_of: Column) -> Column:
    """whole, partly or null: what clauses dated before as_of end."""
    what, when = (F.regexp_extract_all(text, F.lit(EXPIRES), F.lit(k)) for k in (1, 2))
    past = F.filter(F.arrays_zip(what.alias("what"), when.alias("day")), lambda c: F.coalesce(F.try_to_date(c["day"], "MMMM d, yyyy") < as_of, F.lit(False)))
    return F.when(F.exists(past, lambda c: c["what"] == "this section"), "whole").when(F.size(past) > 0, "partly")


def sunset(note: Column, as_of: Column) -> Column:
    """Whether a temporary regulation issued after November 20, 1988 has reached its third anniversary."""
    part = lambda k: F.regexp_extract(F.coalesce(note, F.lit("")), ISSUED, k)
    issued = F.try_to_date(F.concat_ws(" ", F.substring(part(1), 1, 3), part(2), part(3)), "MMM d yyyy")
    return F.coalesce((issued > F.lit(SUNSET_FROM).cast("date")) & (F.add_months(issued, 36) <= as_of), F.lit(False))


def edition(source: Column, as_of: Column) -> Column:
    return F.when(source == "irs_pub", F.year(as_of))


def tax_year(as_of: Column) -> Column:
    """The only year that a string names, or null."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(as_of, F.lit("")), F.lit(r"\b(?:19|20)\d\d\b"), F.lit(0)))
    return F.when(F.size(found) == 1, found[0].cast("int"))


def as_of_match(plan: Column, gold: Column) -> Column:
    """Whether two years agree; null where the gold names two."""
    two = F.size(F.array_distinct(F.regexp_extract_all(gold, F.lit(r"\d{4}"), F.lit(0)))) > 1
    return F.when(two, F.lit(None).cast("boolean")).otherwise(F.coalesce(F.substring(plan, 1, 4) == F.substring(gold, 1, 4), plan.isNull() & gold.isNull()))


def section_of(citation: Column) -> Column:
    """The section that a citation belongs to, without its paragraphs."""
    opinion = F.regexp_extract(citation, OPINION, 0)
    statute = F.regexp_extract(citation, r"^26 U\.S\.C\.[ §]*([^(]*)", 1)
    body = F.trim(F.regexp_replace(citation, r"^26 CFR ", ""))
    dashed = F.concat(F.regexp_extract(body, r"^([^-]*)-", 1), F.lit("-"), F.regexp_extract(body, r"^[^-]*-([^(]*)", 1))
    return (
        F.when(opinion != "", opinion)
        .when(citation.startswith("26 U.S.C."), F.trim(statute))
        .when(body.startswith("IRS Pub"), F.concat(F.lit("Pub "), F.regexp_extract(body, r"^\S+\s+\S+\s+(\S+)", 1)))
        .when(F.contains(body, F.lit("-")), dashed)
        .otherwise(body)
    )


def bracketed(text: Column) -> Column:
    """Citations in brackets, once each in order; nested brackets are flattened and semicolons part them."""
    flat = F.regexp_replace(text, NESTED, "[$1], [$2]")
    inner = F.regexp_extract_all(flat, F.lit(r"\[([^\[\]]+)\]"), F.lit(1))
    parts = F.flatten(F.transform(inner, lambda b: F.transform(F.split(b, ";"), lambda c: F.trim(c))))
    return F.array_distinct(F.filter(parts, lambda c: c != ""))


def content_words(text: Column, stop: list[str]) -> Column:
    """Distinct lower-case words of four ASCII letters at least that are not in stop."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0)))
    return F.array_except(found, F.array(*[F.lit(w) for w in stop])) if stop else found


def or_query(text: Column) -> Column:
    """Lower-cased terms of more than two letters or digits, joined by bars."""
    return F.array_join(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 2), " | ")


def half(row_id: Column) -> Column:
    """tune or report, by the parity of the digest of an id."""
    odd = F.conv(F.right(F.sha2(row_id.cast("binary"), 256), F.lit(1)), 16, 10).cast("int") % 2
    return F.when(odd == 0, "tune").otherwise("report")


def dehyphenate(page: Column) -> Column:
    """Words that a line break parted, joined."""
    return F.regexp_replace(page, r"(?U)(\w)-\s+(\w)", "$1$2")


def normalised_line(line: Column) -> Column:
    """White space collapsed and each run of digits a number sign."""
    return F.regexp_replace(F.trim(F.regexp_replace(line, r"\s+", " ")), r"[0-9]+", "#")


def squeeze(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s.]+", "")


def first_page(citation: Column) -> Column:
    """The first page that a citation names; a million if none."""
    return F.coalesce(F.nullif(F.regexp_extract(citation, r"at \*(\d+)", 1), F.lit("")).cast("int"), F.lit(1_000_000))


def pages_label(first: Column, last: Column) -> Column:
    return F.when(first == last, F.concat(F.lit("at *"), first)).otherwise(F.concat(F.lit("at *"), first, F.lit("-"), last))


def cite(prefix: Column, section: Column, first: Column, last: Column, second: Column) -> Column:
    """26 CFR 1.61-1(a)-(c), or (a)(1), or the section alone."""
    base = F.concat(prefix, F.lit(" "), section)
    one = F.concat(base, F.lit("("), first, F.lit(")"))
    return (
        F.when(first.isNull(), base)
        .when(last.isNotNull() & (last != first), F.concat(one, F.lit("-("), last, F.lit(")")))
        .when(second.isNotNull(), F.concat(one, F.lit("("), second, F.lit(")")))
        .otherwise(one)
    )


def in_scope(section: Column, prefixes: list[str]) -> Column:
    """Whether a section is one of the prefixes or a numbered child of one."""
    out = F.lit(False)
    for p in prefixes:
        out = out | (section == p) | section.startswith(p + "-") | section.startswith(p + "(")
    return out


def outline_level(token: Column, before: Column) -> Column:
    """1 for a letter, 2 for a number, null for deeper ones; i, v and x are letters only right after h, u and w."""
    roman = token.isin("i", "v", "x")
    follows = F.ascii(token) == F.ascii(before) + 1
    return (
        F.when(token.rlike("^[0-9]+$"), 2)
        .when(token.rlike("^[a-z]$") & roman, F.when(F.coalesce(follows, F.lit(False)), 1))
        .when(token.rlike("^[a-z]$"), 1)
    )


def own_designation(citation: Column) -> Column:
    """struct(path, upto) of a statute citation: its outline and the end of its range."""
    pattern = r"§ [0-9A-Za-z-]+?((?:\([^)]+\))*)(?:-\(([^)]+)\))?$"
    path = F.regexp_extract_all(F.regexp_extract(citation, pattern, 1), F.lit(r"\(([^)]+)\)"), F.lit(1))
    return F.struct(path.alias("path"), F.nullif(F.regexp_extract(citation, pattern, 2), F.lit("")).alias("upto"))


def upload_kind(content: Column) -> Column:
    """pdf, png, jpeg or tiff by the leading bytes; null for anything else."""
    out = F.lit(None).cast("string")
    for name, magic in MAGIC.items():
        out = F.when(F.substring(content, 1, len(magic)) == F.lit(bytearray(magic)), name.strip()).otherwise(out)
    return out


def point_id(key: Column, namespace: str) -> Column:
    """The version 5 UUID of a key in a namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(key, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def cost(model: Column, tokens_in: Column, tokens_out: Column, prices: dict[str, tuple[float, float]]) -> Column:
    """Dollars for tokens at prices per million; a model without prices costs nothing."""
    out = F.lit(0.0)
    for name, (a, b) in prices.items():
        out = F.when(model == name, (tokens_in * F.lit(a) + tokens_out * F.lit(b)) / 1e6).otherwise(out)
    return out
