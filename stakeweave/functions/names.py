"""Name, identifier and text functions as Spark columns.

``(?U)`` makes white space and word classes follow Unicode, so a no-break space counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a normalised company name loses, wherever they stand.
LEGAL_SUFFIXES = "inc|corp|corporation|llc|llp|ltd|limited|co|company|plc|sa|ag|nv|bv|lp"
TICKER_SUFFIXES = LEGAL_SUFFIXES + "|group|holding|holdings"
PROXY_SUFFIXES = "inc|corp|ltd|llc|plc|sa|ag|co|company"

# Words and abbreviations that mark a legal entity.
ENTITY_WORDS = (
    "inc|corp|corporation|llc|llp|ltd|limited|lp|plc|fund|trust|group|holdings|capital|management|partners|associates|"
    "advisors|advisers|securities|financial|investment|investments|asset|assets|bank|bancorp|"
    "sarl|s\\.a\\.r\\.l|gmbh|sa|ag|nv|bv|se|sas|srl|spa|oy|ab|as|aps"
)
ENTITY_ABBREVIATIONS = "s\\.a\\.r\\.l\\.|s\\.a\\.|n\\.v\\.|b\\.v\\.|p\\.l\\.c\\.|\\bl[.\\s]*p\\.?\\b"
ENTITY_PATTERN = f"(?iU)\\b({ENTITY_WORDS})\\b|{ENTITY_ABBREVIATIONS}"

# Holders of record that are not beneficial owners.
NOMINEE_PATTERN = "(?iU)\\bnominees?\\b|\\bcustodian\\b|\\bcustody\\b|\\bcede\\s*(?:&|and)\\s*co\\b"

# Titles that a person's name key leaves out.
HONORIFICS = ("mr", "mrs", "ms", "miss", "dr", "sir", "prof", "mx", "madam", "hon", "rev")

# Short given names and their legal forms, for duplicate persons.
NICKNAMES = {
    "bob": "robert", "bobby": "robert", "rob": "robert", "bill": "william", "billy": "william", "will": "william",
    "dick": "richard", "rick": "richard", "rich": "richard", "jim": "james", "jimmy": "james", "joe": "joseph",
    "joey": "joseph", "larry": "lawrence", "tom": "thomas", "tommy": "thomas", "tony": "anthony", "mike": "michael",
    "mickey": "michael", "dave": "david", "steve": "stephen", "chris": "christopher", "ed": "edward",
    "eddie": "edward", "ted": "theodore", "fred": "frederick", "gene": "eugene", "hank": "henry", "jack": "john",
    "johnny": "john", "sam": "samuel", "ben": "benjamin", "dan": "daniel", "danny": "daniel", "matt": "matthew",
    "nick": "nicholas", "greg": "gregory", "jeff": "jeffrey", "ron": "ronald", "don": "donald", "andy": "andrew",
    "charlie": "charles", "chuck": "charles", "al": "albert", "betty": "elizabeth", "liz": "elizabeth",
    "beth": "elizabeth", "kate": "katherine", "katie": "katherine", "peggy": "margaret", "meg": "margaret",
}

# Short given names and their legal forms, for proxy statements; they differ from those above.
PROXY_NICKNAMES = {
    "larry": "lawrence", "bill": "william", "bob": "robert", "dick": "richard", "chuck": "charles", "jim": "james",
    "mike": "michael", "ted": "edward", "tom": "thomas", "ken": "kenneth", "jeff": "jeffrey", "steve": "steven",
    "dave": "david", "andy": "andrew", "tony": "anthony", "joe": "joseph", "jack": "john", "alex": "alexander",
    "liz": "elizabeth", "beth": "elizabeth", "kate": "katherine", "sue": "susan", "jen": "jennifer", "sam": "samuel",
    "matt": "matthew", "dan": "daniel", "tim": "timothy", "pat": "patricia", "chris": "christopher",
    "nick": "nicholas",
}


def strip(text: Column) -> Column:
    """``text`` without white space at its ends, no-break spaces included."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def squeeze(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)\\s+", " ")


def normalize_entity_name(name: Column) -> Column:
    """Company name for matching across sources: no case, commas, dots or legal suffixes."""
    bare = F.regexp_replace(F.lower(name), "[,.]", "")
    return strip(squeeze(F.regexp_replace(bare, f"(?U)\\b({LEGAL_SUFFIXES})\\b\\.?", "")))


def normalize_ticker_name(name: Column) -> Column:
    bare = F.regexp_replace(F.lower(name), "[.,]", "")
    return strip(squeeze(F.regexp_replace(bare, f"(?U)\\b({TICKER_SUFFIXES})\\b", "")))


def normalize_proxy_name(name: Column) -> Column:
    bare = F.regexp_replace(F.lower(name), f"(?U)\\b({PROXY_SUFFIXES})\\b\\.?", "")
    return strip(F.regexp_replace(bare, "[^a-z0-9 ]", ""))


def _tokens(name: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("([a-z0-9]+)"))


def _named_tokens(name: Column) -> Column:
    return F.filter(_tokens(name), lambda t: ~t.isin(*HONORIFICS))


def name_key(name: Column) -> Column:
    """Sorted words of a person's name without titles; repeated words stay."""
    return F.array_sort(_named_tokens(name))


def normalize_place(place: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(place, F.lit(""))), "[^a-z0-9]", "")


def first_token(name: Column) -> Column:
    return F.coalesce(F.get(_tokens(name), F.lit(0)), F.lit(""))


def surname_key(last_name: Column, full_name: Column) -> Column:
    last = F.element_at(F.concat(F.array(F.lit("")), _named_tokens(full_name)), -1)
    return F.when(blank_to_null(last_name).isNotNull(), normalize_place(last_name)).otherwise(last)


def _mapped(value: Column, names: Mapping[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.element_at(table, value)


def full_given_name(token: Column) -> Column:
    """The full form of a nickname, or the name as it stands."""
    return F.coalesce(_mapped(token, NICKNAMES), token)


def given_names_compatible(a: Column, b: Column) -> Column:
    """Whether two given names may denote one person: equal, nickname, prefix, or the same first two letters."""
    x, y = first_token(a), first_token(b)
    stem = (F.length(x) >= 2) & (F.substring(x, 1, 2) == F.substring(y, 1, 2))
    return (x != "") & (y != "") & ((full_given_name(x) == full_given_name(y)) | x.startswith(y) | y.startswith(x) | stem)


def split_full_name(name: Column) -> Column:
    """``struct(first, last)`` split at the first space; a single word is a last name."""
    text = strip(F.coalesce(name, F.lit("")))
    at = F.instr(text, " ")
    return F.struct(
        F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(F.lit("")).alias("first"),
        F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise(text).alias("last"),
    )


def is_person_name(name: Column) -> Column:
    """Whether a name looks like a natural person's: two to four capitalised words, no digit, no entity word."""
    words = F.filter(F.split(strip(F.coalesce(name, F.lit(""))), "(?U)\\s+"), lambda w: w != "")
    capital = F.forall(words, lambda w: F.substring(w, 1, 1).rlike("^\\p{Lu}"))
    return F.coalesce(F.size(words).between(2, 4) & capital & ~name.rlike("\\p{Nd}") & ~name.rlike(ENTITY_PATTERN), F.lit(False))


def is_nominee_name(name: Column) -> Column:
    return F.coalesce(name.rlike(NOMINEE_PATTERN), F.lit(False))


def capitalize(word: Column) -> Column:
    """First letter upper, all others lower."""
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, F.lit(2), F.length(word))))


def _clean_words(name: Column) -> Column:
    return F.filter(F.split(strip(F.regexp_replace(name, "[.,]", "")), "(?U)\\s+"), lambda w: w != "")


# In which orders a name of two or three words is filed.
_ORDERS = ((2, (1, 0)), (3, (2, 0, 1)), (3, (2, 0)), (3, (0, 2)))


def _reordered(words: Column, orders: Iterable[tuple[int, tuple[int, ...]]]) -> Column:
    made = [F.when(F.size(words) == n, F.concat_ws(" ", *[F.get(words, F.lit(k)) for k in at])) for n, at in orders]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def person_name_variants(name: Column) -> Column:
    """Orders and nickname forms under which a filing may name a person, the name itself first."""
    words = _clean_words(name)
    formal = capitalize(_mapped(F.lower(F.get(words, F.lit(0))), PROXY_NICKNAMES))
    full = F.transform(words, lambda w, i: F.when(i == 0, formal).otherwise(w))
    # Of a nickname's full form only orders that begin with the surname are filed.
    forms = F.concat(F.array(F.concat_ws(" ", full)), _reordered(full, [o for o in _ORDERS if o[1][0]]))
    every = F.concat(F.array(name), _reordered(words, _ORDERS), F.array(strip(F.regexp_replace(name, "[.,]", ""))), F.when(formal.isNotNull(), forms).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull()))


def entity_name_variants(name: Column) -> Column:
    """Forms of an entity's name without a leading article and without commas and dots."""
    bases = F.array(name, F.regexp_replace(strip(name), "(?iU)^the\\s+", ""))
    every = F.concat(bases, F.transform(bases, lambda x: F.regexp_replace(x, "[,.]", "")))
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull()))


def is_reordering(a: Column, b: Column) -> Column:
    """Whether two names are the same words in another order."""
    plain = lambda x: strip(F.regexp_replace(x, "[.,]", ""))
    ordered = lambda x: F.array_sort(_clean_words(F.lower(x)))
    return (ordered(a) == ordered(b)) & (plain(a) != plain(b))


def normalize_sec_name(raw: Column) -> Column:
    """``LAST FIRST MIDDLE`` as ``First Middle Last``; a single word is title-cased."""
    words = F.filter(
        F.transform(F.split(strip(raw), "(?U)\\s+"), lambda w: F.regexp_replace(w, "^[.,]+|[.,]+$", "")), lambda w: w != ""
    )
    given = F.transform(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(1))), capitalize)
    full = F.concat_ws(" ", given, F.array(capitalize(F.get(words, F.lit(0)))))
    return F.when(F.size(words) >= 2, full).otherwise(F.initcap(raw))


def normalize_investor_name(display: Column) -> Column:
    """The name before the ticker and CIK; an individual's two words are put in order."""
    has_ticker = display.rlike("\\([A-Z]{1,5}\\)\\s+\\(CIK")
    name = strip(F.get(F.split(display, "\\s{2,}|\\s+\\("), F.lit(0)))
    words = F.split(name, "(?U)\\s+")
    flip = ~has_ticker & (F.size(words) == 2) & ~name.rlike(ENTITY_PATTERN)
    return F.when(flip, F.concat_ws(" ", capitalize(F.get(words, F.lit(1))), capitalize(F.get(words, F.lit(0))))).otherwise(name)


# Officer titles and the roles that they stand for, in order of precedence.
TITLE_ROLES = (
    ("CEO", "chief executive", "ceo"),
    ("CFO", "chief financial", "cfo"),
    ("COO", "chief operating", "coo"),
    ("CTO", "chief technology|chief technical", "cto"),
    ("General Counsel", "general counsel|chief legal", None),
    ("Chairman", "chairman", None),
)


def title_to_role(title: Column) -> Column:
    t = F.lower(title)
    out = None
    for role, inside, whole in TITLE_ROLES:
        hit = t.rlike(inside) if whole is None else t.rlike(inside) | (t == whole)
        out = F.when(hit, role) if out is None else out.when(hit, role)
    out = out.when(t.contains("president") & ~t.contains("vice"), "President")
    return out.otherwise(F.coalesce(F.nullif(title, F.lit("")), F.lit("Officer")))


def merge_aliases(existing: Column, new: Column, own_name: Column) -> Column:
    """Both lists in order, without blanks, case-insensitive repeats or the own name."""
    both = F.filter(F.transform(F.concat(F.coalesce(existing, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>"))), strip),
                    lambda x: x.isNotNull() & (x != ""))
    own = F.lower(strip(F.coalesce(own_name, F.lit(""))))
    lowered = F.transform(both, F.lower)
    first = F.zip_with(both, F.transform(lowered, lambda x, i: F.array_position(lowered, x) == i + 1), lambda x, keep: F.when(keep, x))
    return F.filter(first, lambda x: x.isNotNull() & (F.lower(x) != own))


def search_text(*parts: Column) -> Column:
    """The parts that are not empty, joined by single spaces."""
    return strip(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]))


def backfilled_search_text(name: Column, description: Column, aliases: Column) -> Column:
    """The backfill's form: empty parts keep their single spaces."""
    empty = F.lit("")
    return F.concat(
        F.coalesce(name, empty), F.lit(" "), F.coalesce(description, empty), F.lit(" "), F.concat_ws(" ", F.coalesce(aliases, F.array().cast("array<string>")))
    )


def wikidata_url(qid: Column) -> Column:
    return F.concat(F.lit("https://www.wikidata.org/wiki/"), qid)


def opencorporates_url(jurisdiction: Column, number: Column) -> Column:
    return F.concat(F.lit("https://opencorporates.com/companies/"), jurisdiction, F.lit("/"), number)


def cik_int(cik: Column) -> Column:
    return cik.cast("long").cast("string")


def filing_index_url(cik: Column, accession: Column) -> Column:
    url = F.concat(
        F.lit("https://www.sec.gov/Archives/edgar/data/"), cik_int(cik), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")),
        F.lit("/"), accession, F.lit("-index.htm"),
    )
    return F.when((cik != "") & (accession != ""), url)


def cik_from_accession(accession: Column) -> Column:
    return F.lpad(F.get(F.split(accession, "-"), F.lit(0)), 10, "0")


def normalize_lei(raw: Column) -> Column:
    lei = F.upper(strip(raw))
    return F.when(lei.rlike("^[\\p{L}\\p{Nd}]{20}$"), lei)


def normalize_cik(raw: Column) -> Column:
    digits = strip(F.regexp_replace(strip(raw), "^#+", ""))
    return F.when(digits.rlike("^[0-9]{1,10}$"), F.lpad(digits, 10, "0"))


def qid(uri: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(F.nullif(uri, F.lit("")), "/+$", ""), "/"), -1)


def parse_point(wkt: Column) -> Column:
    """``struct(lat, lng)`` of a ``Point(lng lat)`` literal, or null."""
    pattern = "(?i)^\\s*Point\\(\\s*(-?\\d+(?:\\.\\d+)?)\\s+(-?\\d+(?:\\.\\d+)?)\\s*\\)"
    lng, lat = (F.regexp_extract(wkt, pattern, k) for k in (1, 2))
    return F.when(lng != "", F.struct(lat.cast("double").alias("lat"), lng.cast("double").alias("lng")))
