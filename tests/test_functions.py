import pytest
from pyspark.sql import functions as F

from stakeweave.functions import classify, dates, hashing, names, similarity


def values(spark, rows, schema, column):
    """The column's value for every row, in order."""
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r.v for r in frame.select("i", column.alias("v")).orderBy("i").collect()]


def one(spark, cases, f):
    """Check ``f`` of a string column against expected values."""
    assert values(spark, [(a,) for a, _ in cases], "a string", f(F.col("a"))) == [b for _, b in cases]


def two(spark, cases, f):
    assert values(spark, [(a, b) for a, b, _ in cases], "a string, b string", f(F.col("a"), F.col("b"))) == [c for *_, c in cases]


def test_names(spark):
    one(spark, [("BlackRock, Inc.", "blackrock"), ("BLACKROCK INC", "blackrock"), ("SA Brewery", "brewery"), ("Acme  Co. Holdings", "acme holdings"),
                ("Foo Incorporated", "foo incorporated"), ("", "")], names.normalize_entity_name)
    one(spark, [("Alphabet Holdings Group, Inc", "alphabet"), ("X.Y. Corp", "xy")], names.normalize_ticker_name)
    one(spark, [("Meta Platforms, Inc.", "meta platforms"), ("A&B Co.", "ab")], names.normalize_proxy_name)
    one(spark, [("Mr. Page Lawrence", ["lawrence", "page"]), ("Müller", ["ller", "m"]), (None, []), ("A A", ["a", "a"])], names.name_key)
    one(spark, [("New York, NY", "newyorkny"), (None, "")], names.normalize_place)
    two(spark, [("O'Neil", "x", "oneil"), (None, "Dr John Smith", "smith"), ("  ", "Cher", "cher"), (None, None, "")], names.surname_key)
    two(spark, [("Bob", "Robert", True), ("Dave", "David", True), ("Larry", "Laurence", True), ("Ann", "Bob", False), ("", "Bob", False), ("Ed", "Edward", True)],
        names.given_names_compatible)
    one(spark, [("Ada King Lovelace", ("Ada", "King Lovelace")), ("Cher", ("", "Cher")), (None, ("", "")), ("", ("", ""))],
        lambda c: names.split_full_name(c))
    one(spark, [("Tim Cook", True), ("BlackRock Fund", False), ("Tim", False), ("A B C D E", False), ("tim cook", False), ("Tim Cook 3", False), (None, False),
                ("Foo S.A.R.L.", False), ("Bar L.P.", False)], names.is_person_name)
    one(spark, [("HSBC Nominees Limited", True), ("Cede & Co", True), ("Cede and Co", True), ("Custody Bank", True), ("Cedeco", False), (None, False)], names.is_nominee_name)


def test_name_variants(spark):
    one(spark, [("Sergey Brin", ["Sergey Brin", "Brin Sergey"]),
                ("Warren E. Buffett", ["Warren E. Buffett", "Buffett Warren E", "Buffett Warren", "Warren Buffett", "Warren E Buffett"]),
                ("Larry Page", ["Larry Page", "Page Larry", "Lawrence Page", "Page Lawrence"])], names.person_name_variants)
    one(spark, [("The Vanguard Group, Inc.", ["The Vanguard Group, Inc.", "Vanguard Group, Inc.", "The Vanguard Group Inc", "Vanguard Group Inc"])], names.entity_name_variants)
    two(spark, [("Larry Page", "Page Larry", True), ("Larry Page", "Larry Page", False), ("A B", "A C", False)], names.is_reordering)
    one(spark, [("COOK TIMOTHY D", "Timothy D Cook"), ("NADELLA SATYA", "Satya Nadella"), ("MADONNA", "Madonna")], names.normalize_sec_name)
    one(spark, [("Musk Elon  (CIK 0001494730)", "Elon Musk"), ("BlackRock Inc.  (BLK)  (CIK 0001364742)", "BlackRock Inc.")], names.normalize_investor_name)
    one(spark, [("Chief Executive Officer", "CEO"), ("cfo", "CFO"), ("Vice President", "Vice President"), ("President", "President"), ("Chairman of the Board", "Chairman"), ("", "Officer")],
        names.title_to_role)
    got = values(spark, [(["Foo", "bar "], ["BAR", "", "Baz", "own"], "Own")], "a array<string>, b array<string>, c string", names.merge_aliases(F.col("a"), F.col("b"), F.col("c")))
    assert got == [["Foo", "bar", "Baz"]]
    assert values(spark, [("n", None, ["x", "y"])], "a string, b string, c array<string>", names.backfilled_search_text(F.col("a"), F.col("b"), F.col("c"))) == ["n  x y"]
    assert values(spark, [("n", "", "d")], "a string, b string, c string", names.search_text(F.col("a"), F.col("b"), F.col("c"))) == ["n d"]


def test_identifiers(spark):
    one(spark, [(" 5493001kjtiigc8y1r12 ", "5493001KJTIIGC8Y1R12"), ("short", None), (None, None)], names.normalize_lei)
    one(spark, [("789019", "0000789019"), ("#320193", "0000320193"), ("12x", None), ("12345678901", None)], names.normalize_cik)
    one(spark, [("http://www.wikidata.org/entity/Q95/", "Q95"), ("", None)], names.qid)
    one(spark, [("Point(-122.08 37.42)", (37.42, -122.08)), ("nope", None), (None, None)], names.parse_point)
    two(spark, [("320193", "0001104659-24-021466", "https://www.sec.gov/Archives/edgar/data/320193/000110465924021466/0001104659-24-021466-index.htm"), ("", "x", None)], names.filing_index_url)
    one(spark, [("0001104659-24-021466", "0001104659")], names.cik_from_accession)
    parts = ("owns", "a|b", "ü", "s")
    import hashlib

    want = hashlib.sha1("|".join(f"{len(p)}:{p}" for p in parts).encode()).hexdigest()
    assert values(spark, [parts], "a string, b string, c string, d string", hashing.claim_key(*map(F.col, "abcd"))) == [want]


@pytest.mark.parametrize("stake, kind", [(100.0, "full"), (99.0, "full"), (98.9, "majority"), (50.0, "controlling"), (50.1, "majority"), (20.0, "controlling"), (19.9, "minority"), (0.0, "minority")])
def test_ownership_types(spark, stake, kind):
    assert values(spark, [(stake,)], "a double", classify.derive_ownership_type(F.col("a"))) == [kind]


def test_classification(spark):
    two(spark, [(None, "SC 13D/A", "controlling"), (None, "SC 13G", "minority"), (None, None, "unknown")], lambda a, b: classify.derive_ownership_type(a.cast("double"), b))
    one(spark, [("Majority", "majority"), ("weird", "unknown"), (None, "unknown")], classify.coerce_ownership_type)
    cases = [(["Q43229", "Q157031"], "foundation"), (["Q327333", "Q1061648"], "fund"), ([], "company"), (["Q431289", "Q219577"], "holding")]
    assert values(spark, [(a,) for a, _ in cases], "a array<string>", classify.infer_entity_type(F.col("a"))) == [b for _, b in cases]
    one(spark, [("Stiftung des privaten Rechts", "foundation"), ("Unit Trust", "fund"), ("eingetragener Verein", "nonprofit"), ("GmbH", None), (None, None)], classify.legal_form_type)
    natures = [(["ownership-of-shares-25-to-50-percent"], (25.0, None, "controlling")), (["ownership-of-shares-75-to-100-percent"], (75.0, None, "majority")),
               (["ownership-of-shares-50-to-75-percent", "voting-rights-50-to-75-percent"], (50.0, 50.0, "controlling")), (["right-to-appoint-and-remove-directors"], (None, None, "controlling")),
               ([], (None, None, "minority"))]
    got = values(spark, [(a,) for a, _ in natures], "a array<string>", classify.control(F.col("a")))
    assert [tuple(r)[:3] for r in got] == [b for _, b in natures]
    one(spark, [("<p>PERCENT OF CLASS REPRESENTED BY AMOUNT IN ROW 11&nbsp; 7.5%</p>", 7.5), ("percent of class represented by all of it: 12 %", 12.0), ("none", None),
                ("percent of class represented by amount in row 9 0%", None)], classify.percent_from_text)
    one(spark, [("Type of Reporting Person: IN", True), ("TYPE OF REPORTING PERSON (1) CO", False), ("x", None)], classify.reporter_is_individual)
    one(spark, [("27.4%", 27.4), ("*", 0.4), ("—", None), ("101", None), ("5.1 (2)", 5.1)], classify.parse_percent_cell)
    one(spark, [("1,234,567", 1234567), ("*", None), ("0", None), ("12 (1)", 12)], classify.parse_shares_cell)
    one(spark, [("Charitable Incorporated Organisation", "nonprofit"), ("Private Limited Company", "company"), (None, "company")], classify.company_type)


def test_dates(spark):
    one(spark, [("1/2/1999", "1999-02-01"), ("31/12/2020", "2020-12-31"), ("x", None), ("1//2", None), (None, None)], dates.day_first_to_iso)
    one(spark, [("1999-05-01T00:00", 1999), ("99", None), (None, None)], dates.founded_year)
    one(spark, [("1999-05-01T00:00", "1999-05-01"), ("1999", None)], dates.full_date)
    got = values(spark, [(1974, 8), (1974, None), (None, 3), (0, 1)], "a int, b int", dates.partial_birth_date(F.col("a"), F.col("b")))
    assert got == ["1974-08", "1974", "", ""]
    now = "2024-03-31 00:00:00"
    two(spark, [("2024-03-30 00:00:00", now, "LastDay"), ("2024-03-25 00:00:00", now, "LastWeek"), ("2024-03-03 00:00:00", now, "LastMonth"), ("2024-01-01 00:00:00", now, None),
                (None, now, "LastMonth"), ("junk", now, "LastMonth")], dates.catchup_interval)


def test_similarity(spark):
    two(spark, [("abcd", "bcda", 0.75), ("Apple Inc", "APPLE INC.", 1.0), ("Inc", "x", 0.0)], similarity.ticker_similarity)
    got = values(spark, [("Meta", "Meta Platforms, Inc."), ("Meta", "MetaBank")], "a string, b string", similarity.proxy_similarity(F.col("a"), F.col("b")))
    assert got[0] == 0.75 and got[1] < 0.75
