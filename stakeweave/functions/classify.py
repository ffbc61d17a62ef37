"""Ownership, entity and register classifications as Spark columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stakeweave.functions.names import squeeze

# The closed set of ownership types.
OWNERSHIP_TYPES = ("full", "majority", "controlling", "minority", "unknown")


def derive_ownership_type(stake: Column, form: Column | None = None) -> Column:
    """99 and more is full, over 50 majority, 20 and more controlling, else minority; without a stake the form decides."""
    form = F.lit(None).cast("string") if form is None else form
    by_stake = F.when(stake >= 99, "full").when(stake > 50, "majority").when(stake >= 20, "controlling").otherwise("minority")
    by_form = F.when(form.contains("13D"), "controlling").when(form.contains("13G"), "minority").otherwise("unknown")
    return F.when(stake.isNotNull(), by_stake).otherwise(by_form)


def coerce_ownership_type(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return F.when(low.isin(*OWNERSHIP_TYPES), low).otherwise("unknown")


# Class identifiers of each entity type, the type that wins first.
TYPE_CLASSES = (
    ("fund", ("Q4201895", "Q791974", "Q845477", "Q105611", "Q1061648")),
    ("government", ("Q1802419", "Q327333", "Q4383245", "Q2659904")),
    ("foundation", ("Q157031",)),
    ("nonprofit", ("Q163740", "Q48204", "Q79913", "Q708676", "Q510785")),
    ("holding", ("Q219577",)),
    ("brand", ("Q431289",)),
)


def infer_entity_type(classes: Column) -> Column:
    hits = [(name, F.arrays_overlap(classes, F.array(*map(F.lit, ids)))) for name, ids in TYPE_CLASSES]
    return F.coalesce(*[F.when(hit, F.lit(name)) for name, hit in hits], F.lit("company"))


# Legal forms that refine an entity's type, in order.
LEGAL_FORM_TYPES = (
    ("foundation", "stiftung|stichting|foundation|fondation|fundaci|fundacja|fundo"),
    ("fund", "\\bfund\\b|fonds|sicav|mutual fund|unit trust|investment trust|\\btrust\\b|\\boeic\\b|\\bfcp\\b"),
    (
        "nonprofit",
        "verein|\\be\\.?\\s?v\\.?\\b|association|vereniging|associazione|asociaci|onlus|gemeinnütz|non[- ]?profit|\\bngo\\b|stowarzyszenie",
    ),
)


def legal_form_type(details: Column) -> Column:
    return F.coalesce(*[F.when(details.rlike(f"(?iU){pattern}"), F.lit(name)) for name, pattern in LEGAL_FORM_TYPES])


def band_floor(nature: Column) -> Column:
    return F.regexp_extract(nature, "(\\d+)-to-\\d+-percent", 1).try_cast("int")


def control(natures: Column) -> Column:
    """``struct(stake, voting, ownership_type, interest_types)`` of a register's natures of control."""
    natures = F.coalesce(natures, F.array().cast("array<string>"))
    shares = F.filter(natures, lambda x: x.contains("ownership-of-shares"))
    votes = F.filter(natures, lambda x: ~x.contains("ownership-of-shares") & x.contains("voting-rights"))
    rights = F.exists(
        natures,
        lambda x: ~x.contains("ownership-of-shares") & (x.contains("voting-rights") | x.contains("right-to-appoint") | x.contains("significant-influence")),
    )
    stake = F.array_max(F.transform(shares, band_floor)).cast("double")
    voting = F.array_max(F.transform(votes, band_floor)).cast("double")
    kind = F.when(rights, "controlling").when(stake.isNotNull(), derive_ownership_type(stake)).otherwise("minority")
    return F.struct(
        stake.alias("stake"), voting.alias("voting"), kind.alias("ownership_type"), F.array_sort(F.array_distinct(natures)).alias("interest_types")
    )


# Where a filing states the percentage of a class, tried in order.
PERCENT_PATTERNS = (
    "percent\\s+of\\s+class\\s+represented\\s+by\\s+amount\\s+in\\s+row\\s+\\d+\\s+(\\d{1,2}\\.?\\d*)\\s*%",
    "item\\s*13\\.?\\s*percent\\s+of\\s+class[^\\n]*?\\n[^\\n]*?(\\d{1,2}\\.?\\d*)\\s*%",
    "percent\\s+of\\s+class\\s+represented.{0,300}?(\\d{1,2}\\.?\\d*)\\s*%",
)
# Codes for the type of a reporting person.
REPORTER_CODES = "IN|CO|PN|IA|IC|BK|BD|SA|OO|HC|EP|GP|LP"

# Named character entities that filings use.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#160;": " ", "&#8217;": "’", "&amp;": "&"}


def plain_text(html: Column) -> Column:
    """Text without tags, common character entities decoded, white space squeezed."""
    decoded = reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), ENTITIES.items(), html)
    return squeeze(F.regexp_replace(decoded, "<[^>]+>", " "))


def percent_from_text(text: Column) -> Column:
    plain = plain_text(text)
    found = [F.regexp_extract(plain, f"(?is){p}", 1).try_cast("double") for p in PERCENT_PATTERNS]
    return F.coalesce(*[F.when((v > 0) & (v <= 100), v) for v in found])


def reporter_is_individual(text: Column) -> Column:
    code = F.upper(F.regexp_extract(plain_text(text), f"(?is)type\\s+of\\s+reporting\\s+person[^a-z]{{0,80}}\\b({REPORTER_CODES})\\b", 1))
    return F.when(code != "", code == "IN")


def stake_from_shares(shares: Column, outstanding: Column) -> Column:
    return F.when(outstanding > 0, F.round(shares / outstanding * 100, 4))


def company_type(category: Column) -> Column:
    return F.when(F.lower(F.coalesce(category, F.lit(""))).rlike("charitable|community interest"), "nonprofit").otherwise("company")


def _figure(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s*\\(\\d+\\)", ""))


def clean_table_name(text: Column) -> Column:
    return _figure(text)


def parse_percent_cell(text: Column) -> Column:
    """A table cell's percentage; a star stands for less than one percent (0.4)."""
    t = _figure(text)
    value = F.trim(F.regexp_replace(t, "[%,]", "")).try_cast("double")
    return F.when(t == "*", F.lit(0.4)).when(value.between(0, 100), value)


def parse_shares_cell(text: Column) -> Column:
    value = F.trim(F.regexp_replace(_figure(text), "[,%]", "")).try_cast("double").cast("long")
    return F.when(value > 0, value)
