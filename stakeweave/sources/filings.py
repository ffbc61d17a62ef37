"""Securities filings: tickers, holdings, insiders, indexes and proxy tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stakeweave.functions.classify import clean_table_name, parse_percent_cell, parse_shares_cell, percent_from_text, reporter_is_individual
from stakeweave.functions.names import cik_from_accession, filing_index_url, normalize_investor_name, normalize_sec_name, normalize_ticker_name, title_to_role
from stakeweave.functions.similarity import MIN_PROXY_SIMILARITY, MIN_TICKER_SIMILARITY, proxy_similarity, ticker_similarity
from stakeweave.operators.tree import cut


def match_tickers(queries: DataFrame, tickers: DataFrame) -> DataFrame:
    """``q, cik, title``: the exact normalised title, else one that starts with the query; the shortest; similar enough."""
    t = tickers.select(F.lpad(F.col("cik_str").cast("string"), 10, "0").alias("cik"), "title", normalize_ticker_name(F.col("title")).alias("norm"))
    q = queries.select("q", normalize_ticker_name(F.col("q")).alias("nq")).where("nq <> ''")
    exact = q.join(t, F.col("nq") == F.col("norm")).withColumn("pool", F.lit(0))
    # A title is posted under its beginnings that are as long as some query, so a prefix match is an equal join.
    sizes = [r.n for r in q.select(F.length("nq").alias("n")).distinct().collect()]  # as many as queries have lengths
    heads = t.withColumn("n", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>"))).where(F.length("norm") > F.col("n"))
    prefix = q.join(heads.withColumn("h", F.substring("norm", F.lit(1), F.col("n"))), F.col("nq") == F.col("h")).drop("h", "n")
    both = exact.unionByName(prefix.withColumn("pool", F.lit(1)))
    order = Window.partitionBy("q", "pool").orderBy(F.length("title"), "title", "cik")
    best = both.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    close = best.where(ticker_similarity(F.col("q"), F.col("title")) >= MIN_TICKER_SIMILARITY)
    order = Window.partitionBy("q").orderBy("pool")
    return close.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("q", "cik", "title")


def filings_of(submissions: DataFrame) -> DataFrame:
    """One row a filing from parallel arrays ``form, accessionNumber, filingDate``."""
    z = submissions.select("cik", F.explode(F.arrays_zip("form", "accessionNumber", "filingDate")).alias("z"))
    return z.select("cik", F.col("z.form").alias("form"), F.col("z.accessionNumber").alias("accession"), F.col("z.filingDate").alias("filed"))


def inbound_holdings(filings: DataFrame, most: int = 20, read_text: int = 5) -> DataFrame:
    """The newest ownership filing of each outside investor at a company; the percentage is read from the newest few texts.

    ``filings`` has ``cik, accession, form, filed, display_name, text``.
    """
    rows = filings.where(F.contains("form", F.lit("13"))).withColumn("investor_cik", cik_from_accession(F.col("accession"))).where("investor_cik <> cik")
    order = Window.partitionBy("cik", "investor_cik").orderBy(F.col("filed").desc(), "accession")
    first = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    place = F.row_number().over(Window.partitionBy("cik").orderBy(F.col("filed").desc(), "accession"))
    return first.withColumn("place", place).where(F.col("place") <= most).select(
        "cik", "investor_cik", normalize_investor_name(F.col("display_name")).alias("investor"), "form", "filed",
        F.when(F.col("place") <= read_text, percent_from_text(F.col("text"))).alias("stake_percent"), reporter_is_individual(F.col("text")).alias("is_person"),
        filing_index_url(F.col("cik"), F.col("accession")).alias("source_url"),
    )


def _xml(text: Column, *names: str) -> Column:
    """The first value of each element at any depth and under any namespace, as one array: a text is parsed once for all of them."""
    first = [f"//*[local-name()='{n}']" for n in names]
    # No XML text can hold the character between the values.
    return F.transform(F.split(F.xpath_string(text, F.lit(f"concat({", '\x01', ".join(first)}, '')")), "\x01"), lambda v: F.nullif(F.trim(v), F.lit("")))


def xml_elements(text: Column, name: str) -> Column:
    """Every element of this name, at any depth and under any namespace, as a document of its own.

    Elements that hold another of their name end with it.
    """
    tag = rf"(?:[\w.-]+:)?{re.escape(name)}"
    inner = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?s)<{tag}(?:\s[^>]*)?(?<!/)>(.*?)</{tag}\s*>"))
    # Prefixes of elements and attributes go, since what declares them stays outside.
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"(</?)[\w.-]+:(?=[\w.-])", "$1"), r"(?<=\s)[\w.-]+:(?=[\w.-]+\s*=\s*[\"'])", "")
    return F.transform(inner, lambda x: F.concat(F.lit("<x>"), bare(x), F.lit("</x>")))


def _fields(element: Column, schema: str) -> Column:
    """Children of an element; one that isn't well formed has none."""
    return F.from_xml(element, schema, {"rowTag": "x", "mode": "PERMISSIVE"})


def affiliated_managers(filings: DataFrame) -> DataFrame:
    """``cik, manager_cik, manager, source_url, source_date, form_type``: the other managers that a filer's latest 13F cover names.

    ``filings`` has ``cik, form, accession, filed, xml``.  It says who reports together, not who owns whom.  A manager
    counts once, by its id or else by its name, as it is named first.
    """
    rows = filings.where(F.col("form").rlike("^13F-(NT|HR)"))
    last = rows.groupBy("cik").agg(F.max_by(F.struct("form", "accession", "filed", "xml"), F.struct("filed", "accession")).alias("f")).select("cik", "f.*")
    named = last.select("cik", "form", "accession", "filed", F.posexplode(xml_elements(F.col("xml"), "otherManager")).alias("place", "m"))
    named = named.withColumn("m", _fields(F.col("m"), "cik string, name string")).select("*", F.trim("m.cik").alias("raw"), F.nullif(F.trim("m.name"), F.lit("")).alias("manager"))
    named = named.where("manager IS NOT NULL").withColumn("manager_cik", F.when(F.col("raw").rlike("^[0-9]+$"), F.lpad(F.regexp_replace("raw", "^0+", ""), 10, "0")))
    first = named.groupBy("cik", F.coalesce("manager_cik", F.lower("manager")).alias("key")).agg(F.min_by(F.struct("manager_cik", "manager", "form", "accession", "filed"), "place").alias("m"))
    return first.select(
        "cik", "m.manager_cik", "m.manager", filing_index_url(F.col("cik"), F.col("m.accession")).alias("source_url"), F.col("m.filed").alias("source_date"), F.col("m.form").alias("form_type")
    )


_ENTRY = "id string, title string, content struct<`accession-number`:string, `filing-date`:string, `filing-type`:string>"


def feed_companies(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """``cik, name`` of the one company that an Atom feed is about, null where it lists several; all other columns stay."""
    head = F.regexp_replace(F.coalesce(F.col(xml), F.lit("")), r"(?s)<(?:[\w.-]+:)?entry(?:\s[^>]*)?>.*?</(?:[\w.-]+:)?entry\s*>", "")
    info = _fields(F.get(xml_elements(head, "company-info"), F.lit(0)), "cik string, `conformed-name` string")
    rows = feeds.withColumn("_i", info)
    return rows.select(
        *[c for c in feeds.columns if c != xml], F.lpad(F.nullif(F.trim("_i.cik"), F.lit("")), 10, "0").alias("cik"), F.coalesce(F.trim("_i.conformed-name"), F.lit("")).alias("name")
    )


def feed_entries(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """``place, accession, filed, form, entry_cik, title`` of every entry of Atom feeds: filings, or companies by the id in theirs."""
    e = F.col("_e")
    rows = feeds.select(*[c for c in feeds.columns if c != xml], F.posexplode(xml_elements(F.col(xml), "entry")).alias("place", "_x")).withColumn("_e", _fields(F.col("_x"), _ENTRY))
    said = lambda c: F.nullif(F.trim(c), F.lit(""))
    cik = F.lpad(F.nullif(F.regexp_extract(F.coalesce(e["id"], F.lit("")), r"(?i)cik=(\d+)", 1), F.lit("")), 10, "0")
    return rows.select(
        *[c for c in feeds.columns if c != xml], "place", said(e["content"]["accession-number"]).alias("accession"), said(e["content"]["filing-date"]).alias("filed"),
        said(e["content"]["filing-type"]).alias("form"), cik.alias("entry_cik"), said(e["title"]).alias("title"),
    )


def holding_xml(filings: DataFrame) -> DataFrame:
    """``issuer_cik, issuer, percent`` of structured holding filings (column ``xml``); 0.0 is a real value.

    Texts are dealt to all tasks before they are parsed, since many lie in one part of a file.
    """
    kept = [c for c in filings.columns if c != "xml"]
    rows = filings.repartition(*filings.columns).select(*kept, _xml(F.col("xml"), "issuerCik", "issuerName", "classPercent").alias("_v"))
    v = lambda k: F.get("_v", F.lit(k))
    return rows.select(*kept, F.lpad(v(0), 10, "0").alias("issuer_cik"), v(1).alias("issuer"), v(2).try_cast("double").alias("percent"))


def latest_holdings(filings: DataFrame) -> DataFrame:
    """Per filer and issuer the newest stake above 0, with ``until`` where a later filing says 0; unreadable values are ignored.

    Filings are read once: if any filing that says 0 is not older than the stake, the newest one is not.
    """
    live, zero = F.col("percent") > 0, F.col("percent") == 0
    newest = F.max_by(F.struct("filed", "percent", "issuer"), F.when(live, F.struct("filed", "accession"))).alias("s")
    held = filings.groupBy("cik", "issuer_cik").agg(newest, F.max(F.when(zero, F.col("filed"))).alias("zero"))
    # What has no filer or issuer can't be told to end.
    until = F.when((F.col("zero") >= F.col("s.filed")) & F.col("cik").isNotNull() & F.col("issuer_cik").isNotNull(), F.col("zero")).alias("until")
    return held.where("s IS NOT NULL").select("cik", "issuer_cik", F.col("s.issuer").alias("issuer"), F.col("s.percent").alias("stake_percent"), F.col("s.filed").alias("since"), until)


def insiders(filings: DataFrame, most: int | None = 25) -> DataFrame:
    """Executives of companies from insider filings (column ``xml``), newest first, one row a person; all of them without ``most``."""
    x = F.col("xml")
    fields = ("issuerCik", "rptOwnerName", "rptOwnerCik", "officerTitle", "isDirector", "isOfficer")
    v = lambda k: F.get("_v", F.lit(fields.index(k)))
    rows = filings.where(F.col("form").isin("3", "4", "3/A", "4/A")).select("filed", "accession", "xml", _xml(x, *fields).alias("_v")).select(
        F.lpad(v("issuerCik"), 10, "0").alias("issuer_cik"), normalize_sec_name(v("rptOwnerName")).alias("person"), v("rptOwnerCik").alias("person_cik"),
        v("officerTitle").alias("title"), v("isDirector").isin("1", "true").alias("is_director"), v("isOfficer").isin("1", "true").alias("is_officer"),
        F.array_max(F.transform(F.xpath(x, F.lit("//*[local-name()='sharesOwnedFollowingTransaction']/*[local-name()='value']/text()")), lambda v: v.try_cast("double"))).alias("shares"),
        "filed", "accession",
    ).where("person IS NOT NULL")
    order = Window.partitionBy("issuer_cik", "person").orderBy(F.col("filed").desc(), "accession")
    first = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    role = F.when(F.coalesce("title", F.lit("")) != "", title_to_role(F.col("title"))).when(F.col("is_director"), "director").otherwise("Officer")
    if most is None:
        return first.withColumn("role", role)
    place = F.row_number().over(Window.partitionBy("issuer_cik").orderBy(F.col("filed").desc(), "person"))
    return first.withColumn("role", role).withColumn("_p", place).where(F.col("_p") <= most).drop("_p")


def latest_fact(facts: DataFrame) -> DataFrame:
    """Shares outstanding: the value with the latest end, per company (``cik, end, val, filed``)."""
    return facts.where("val > 0").groupBy("cik").agg(F.max_by("val", F.struct("end", "filed")).alias("shares_outstanding"), F.max("end").alias("as_of"))


def holding_pages(recent: DataFrame, archives: DataFrame, most: int = 4) -> DataFrame:
    """Holding filings of the recent page and at most ``most`` archive pages of each filer (``page`` numbers them), newest first."""
    old = archives.where(F.col("page") <= most).drop("page")
    rows = filings_of(recent.unionByName(old))
    return rows.where(F.col("form").rlike("^SC 13[DG]|^SCHEDULE 13[DG]")).orderBy(F.col("filed").desc(), "accession")


def insider_holding(filings: DataFrame, issuers: DataFrame) -> DataFrame:
    """Shares of each person at each issuer (``issuer_cik``) from the newest filing that names it; none held gives no row."""
    rows = insiders(filings.where(F.col("form").isin("4", "4/A")), most=None).join(issuers, "issuer_cik", "left_semi")
    return rows.where("shares > 0").select("issuer_cik", "person", "person_cik", "shares", "filed")


def former_names(rows: DataFrame) -> DataFrame:
    """``cik, names``: names in order without case-insensitive repeats, from arrays of former names."""
    low = F.transform("former", F.lower)
    return rows.select("cik", F.filter("former", lambda x, i: F.array_position(low, F.lower(x)) == i + 1).alias("names"))


def proxy_by_cik(queries: DataFrame, filings: DataFrame) -> DataFrame:
    """``q, cik, accession, document, filed``: the first proxy statement on a company's pages of filings, recent page first.

    ``queries`` has ``q, cik``; ``filings`` has ``cik, page, place, form, accession, document, filed``, pages counted from 0.
    """
    rows = filings.where("form = 'DEF 14A' AND document <> ''").groupBy("cik").agg(F.min_by(F.struct("accession", "document", "filed"), F.struct("page", "place")).alias("f"))
    return queries.where("cik IS NOT NULL").select("q", F.lpad("cik", 10, "0").alias("cik")).join(rows, "cik").select("q", "cik", "f.*")


def proxy_by_name(queries: DataFrame, feeds: DataFrame, companies: DataFrame, filings: DataFrame, most: int = 8) -> DataFrame:
    """``q, cik, accession, document, filed`` by what a search feed (``q, xml``) says to a name.

    A feed about one company gives its first filing, if the company's name is alike and its recent page has the filing as a proxy
    statement.  A feed that lists companies gives, of its first ``most``, the proxy statement of the most similar one,
    the latest of equals.  ``companies`` has ``cik, name``; ``filings`` as in ``proxy_by_cik``.
    """
    asked = feeds.join(queries.select("q").distinct(), "q", "left_semi")
    head = feed_companies(asked)
    entries = feed_entries(asked)
    recent = filings.where("page = 0 AND form = 'DEF 14A' AND document <> ''")
    bare = lambda c: F.replace(c, F.lit("-"), F.lit(""))
    sure = head.where("cik IS NOT NULL").withColumn("similarity", proxy_similarity(F.col("q"), F.col("name"))).where(F.col("similarity") >= MIN_PROXY_SIMILARITY)
    newest = entries.where("accession IS NOT NULL").groupBy("q").agg(F.min_by("accession", "place").alias("wanted"))
    one = sure.join(newest, "q").join(recent, "cik").where(bare(F.col("accession")) == bare(F.col("wanted")))
    one = one.groupBy("q", "cik").agg(F.min_by(F.struct("accession", "document", "filed"), "place").alias("f")).select("q", "cik", "f.*")
    listed = entries.join(head.where("cik IS NULL").select("q"), "q", "left_semi").where((F.col("place") < most) & F.col("entry_cik").isNotNull())
    listed = listed.select("q", F.col("entry_cik").alias("cik"), "place").join(companies.select("cik", "name"), "cik")
    listed = listed.withColumn("similarity", proxy_similarity(F.col("q"), F.col("name"))).where(F.col("similarity") >= MIN_PROXY_SIMILARITY)
    last = recent.groupBy("cik").agg(F.min_by(F.struct("accession", "document", "filed"), "place").alias("f"))
    best = F.max_by(F.struct("cik", "f"), F.struct("similarity", "f.filed", -F.col("place")))
    many = listed.join(last, "cik").groupBy("q").agg(best.alias("b")).select("q", "b.cik", "b.f.*")
    return one.unionByName(many)


def locate_proxy(queries: DataFrame, feeds: DataFrame, companies: DataFrame, filings: DataFrame, least_year: int) -> DataFrame:
    """``q, cik, accession, document, filed, stale, found_by`` of each query (``q`` and, where known, ``cik``).

    Looked up by id (``cik``), else by name (``name``).  Where that finds nothing of ``least_year`` or later, the
    name under which the company found is registered is looked up instead (``registered``); if that
    finds nothing recent either, the old statement stands and is ``stale``.
    """
    # The place of a filing in its page is its order; forms of other kinds don't count.
    known = proxy_by_cik(queries, filings).withColumn("found_by", F.lit("cik"))
    others = queries.join(known.select("q"), "q", "left_anti")
    # A row for each query, looked at several times.
    first = cut(known.unionByName(proxy_by_name(others, feeds, companies, filings).withColumn("found_by", F.lit("name"))))
    recent = F.coalesce(F.substring("filed", 1, 4).try_cast("int") >= least_year, F.lit(False))
    stale = first.where(~recent & (F.col("found_by") == "name")).join(companies.select("cik", F.col("name").alias("registered")), "cik").where("registered <> '' AND lower(registered) <> lower(q)")
    again = proxy_by_name(stale.select(F.col("registered").alias("q")), feeds, companies, filings).where(recent)
    better = cut(stale.select("q", "registered").join(again.withColumnRenamed("q", "registered"), "registered").drop("registered").withColumn("found_by", F.lit("registered")))
    out = first.join(better.select("q"), "q", "left_anti").unionByName(better)
    return out.select("q", "cik", "accession", "document", "filed", (~recent).alias("stale"), "found_by")


def filing_index(pages: DataFrame, html: str = "html") -> DataFrame:
    """``investor, investor_cik, document_url`` of filing index pages: who filed, and the first document of a holding form.

    What a page does not have is null; all other columns stay.
    """
    page = F.coalesce(F.col(html), F.lit(""))
    filer = r'(?is)class="companyName">\s*([^<(]+?)\s*\(Filed by\).*?CIK=(\d+)'
    name, cik = (F.nullif(F.regexp_extract(page, filer, k), F.lit("")) for k in (1, 2))
    link = r'(?is)href="(/Archives/edgar/data/\d+/[^"]+\.(?:htm|txt))"[^>]*>[^<]*</a>\s*</td>\s*<td[^>]*>SC\s*13'
    path = F.nullif(F.regexp_extract(page, link, 1), F.lit(""))
    plain = F.replace(F.replace(F.replace(name, F.lit("&#39;"), F.lit("'")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    return pages.select(
        *[c for c in pages.columns if c != html], F.trim(plain).alias("investor"), F.lpad(cik, 10, "0").alias("investor_cik"),
        F.concat(F.lit("https://www.sec.gov"), path).alias("document_url"),
    )


def find_companies(queries: DataFrame, tickers: DataFrame, registered: DataFrame, hits: DataFrame) -> DataFrame:
    """``q, cik, name, stage`` of each query (column ``q``): the first of three look-ups that finds a company.

    1. a ticker's title; 2. of ``registered`` (``q, cik, name, form_rank``: what the name index answers) the most
    similar one of the first form that has a similar one; 3. of full-text ``hits`` (``q, cik, name, form_rank``: the
    first hit of each form) the first similar one.
    """
    one = match_tickers(queries, tickers).select("q", "cik", F.col("title").alias("name"), F.lit(1).alias("stage"), F.lit(0).alias("form_rank"), F.lit(1.0).alias("similarity"))
    close = lambda rows, stage: (
        rows.join(queries.select("q").distinct(), "q", "left_semi").where("cik IS NOT NULL AND name <> ''")
        .withColumn("similarity", ticker_similarity(F.col("q"), F.col("name"))).where(F.col("similarity") >= MIN_TICKER_SIMILARITY)
        .select("q", F.lpad("cik", 10, "0").alias("cik"), "name", F.lit(stage).alias("stage"), "form_rank", "similarity")
    )
    every = one.unionByName(close(registered, 2)).unionByName(close(hits, 3))
    best = F.min_by(F.struct("cik", "name", "stage"), F.struct("stage", "form_rank", -F.col("similarity"), "name", "cik"))
    return every.groupBy("q").agg(best.alias("b")).select("q", "b.*")


class _Tables(HTMLParser):
    """Rows of cell texts of every table, each nesting level on its own: what an inner table says is not its outer cell's."""

    def __init__(self):
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.open: list[tuple[list[list[str]], list[list[str] | None]]] = []  # rows, and the cell that is open if any

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append(([], [None]))
            self.tables.append(self.open[-1][0])
        elif self.open and tag == "tr":
            self._end_cell()
            self.open[-1][0].append([])
        elif self.open and tag in ("td", "th"):
            self._end_cell()
            self.open[-1][1][0] = []

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            self._end_cell()
            self.open.pop()
        elif self.open and tag in ("td", "th", "tr"):
            self._end_cell()

    def handle_data(self, data):
        if self.open and self.open[-1][1][0] is not None:
            self.open[-1][1][0].append(data)

    def _end_cell(self):
        rows, cell = self.open[-1]
        if cell[0] is not None:
            text = re.sub(r"[\s\u200b]+", " ", "".join(cell[0])).strip()
            (rows or [rows.append([]) or rows[-1]])[-1].append(text)
            cell[0] = None


# What tells an ownership table, a table of two share classes, and rows that name no owner.
_SINGLE = re.compile(r"beneficial ownership|beneficially owned|percent of common|percent of outstanding|percent of class|percent of", re.I)
_DUAL = ("voting power", ("class a", "class b"))
_HEADING = re.compile(r"name of beneficial|^name$|shares", re.I)
_NO_OWNER = re.compile(
    r"name\s+of\s+beneficial|name\s+and\s+address|beneficial\s+owner\s+name|class\s+[abc]|shares|percent|voting\s+power"
    r"|executive\s+officers|other\s+[>5%]|all\s+(executive|directors)|^(common stock|total|number|title of class)",
    re.I,
)
_CLASS_ROW = re.compile(r"class\s+[abc]\b", re.I)
# An address that follows a name: a number, then a word.
_ADDRESS = re.compile(r"\s+\d+\s+[A-Za-z]")
_FOOTNOTE = re.compile(r"\s*(\(\w{1,3}\)|\[\w{1,3}\])+\s*$")
MOST_HEADER_ROWS, MANY_SHARES = 5, 10_000


def _count_of(cell: str) -> int:
    digits = _FOOTNOTE.sub("", cell).replace(",", "").strip()
    return int(digits) if digits.isascii() and digits.isdigit() else 0


def _percent_of(cell: str) -> str:
    """The cell if it reads as a percentage: a star, a number with its sign, or a decimal below 100."""
    plain = _FOOTNOTE.sub("", cell).strip()
    number = re.fullmatch(r"(\d[\d,]*\.?\d*|\.\d+)\s*(%?)", plain)
    if plain == "*" or number and (number[2] or "." in plain and 0 < float(number[1].replace(",", "")) < 100):
        return plain
    return ""


def owner_rows(html: str) -> list[tuple[str, str, str]]:
    """``(name, shares, percent)`` texts of ownership tables, of tables with two share classes or else of all others.

    A name is a row's first cell that says anything, wherever columns are padded.  Shares are the largest number
    above ``MANY_SHARES``.  In a table of two classes the percentage is the last column's, and a row that names a class
    instead of an owner belongs to the owner before it: its figure before the last one is that owner's percentage.  Headings
    between rows and rows of all directors and officers as a group name no owner and change none; an address behind a name is cut off.
    """
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    tables = [[row for row in t if any(row)] for t in parser.tables]
    texts = [" ".join(" ".join(r) for r in t).lower() for t in tables]
    long = [i for i, t in enumerate(tables) if len(t) >= 3]
    dual = next((i for i in long if _DUAL[0] in texts[i] and any(c in texts[i] for c in _DUAL[1])), None)
    if dual is not None:
        return _owners_of(tables[dual], True)
    single = [i for i in long if _SINGLE.search(" ".join(" ".join(r) for r in tables[i][:MOST_HEADER_ROWS]))]
    return [row for i in single for row in _owners_of(tables[i], False)]


def _owners_of(rows: list[list[str]], dual: bool) -> list[tuple[str, str, str]]:
    # Columns' headings end with the last of the first rows that reads like one.
    heads = [i for i, r in enumerate(rows[: MOST_HEADER_ROWS + 1]) if r[0] and (_HEADING.search(r[0]) or {"voting", "percent"} <= set(" ".join(r).lower().split()))]
    heads += [i for i, r in enumerate(rows[:MOST_HEADER_ROWS]) if _SINGLE.search(" ".join(r)) and not any(map(_count_of, r))]
    out: list[tuple[str, str, str]] = []
    for row in rows[max(heads, default=-1) + 1 :]:
        said = [c for c in row if c]
        figures = said[1:]
        name = _FOOTNOTE.sub("", said[0])
        address = _ADDRESS.search(name)
        name = name[: address.start()].strip() if address else said[0]
        bare = not re.search(r"[^\W\d_]{2}", said[0])
        if bare or _NO_OWNER.search(said[0]):
            if dual and out and len(figures) >= 2 and (bare or _CLASS_ROW.match(said[0])):
                name, shares, percent = out[-1]
                most = max(figures, key=_count_of)
                shares = most if _count_of(most) > max(MANY_SHARES, _count_of(shares)) else shares
                out[-1] = (name, shares, _percent_of(figures[-2]) or percent)
            continue
        if not figures:
            continue
        most = max(figures, key=_count_of)
        shares = most if _count_of(most) > MANY_SHARES else ""
        percent = _percent_of(figures[-1]) if dual else next(filter(None, map(_percent_of, figures)), "")
        if shares or percent:
            out.append((name, shares, percent))
    return out


def proxy_owners(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Owners named in the ownership tables of pages; pages without such a table give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, *row) for k, h in zip(batch["k"], batch["h"], strict=True) for i, row in enumerate(owner_rows(h))]
            yield pd.DataFrame(rows, columns=["k", "row", "name", "shares", "percent"])

    picked = pages.select(F.col(key).alias("k"), F.col(html).cast("string").alias("h"))
    kind = picked.schema["k"].dataType.simpleString()
    found = picked.mapInPandas(run, f"k {kind}, row int, name string, shares string, percent string")
    return found.select(
        F.col("k").alias(key), "row", clean_table_name(F.col("name")).alias("name"), parse_shares_cell(F.col("shares")).alias("shares"),
        parse_percent_cell(F.col("percent")).alias("percent"),
    )
