import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from stakeweave.sources import arrays, filings, gleif, records, registers, snapshot, wikidata


def w(x):
    return {"$": x}


DOCUMENTS = [
    {"records": [{"LEI": w(f"L{i}"), "t": 'a "quoted } brace" [x] é日 \\', "n": {"m": [1, {"k": "\\"}]}} for i in range(12)], "more": [{"not": "this"}]},
    [{"a": '}{][\\"}'}, 5, [{"no": 1}], {"b": {"c": {}}}, "text }", None, {}, [[{}]], {"d": "x" * 90}],
    {"head": {"x": "[ {", "y": {"z": 1}}, "rows": [{"k": '\\"'}], "tail": {"a": [{"b": 1}]}},
    {"rows": []}, {"none": {"a": "b"}}, [[], {"z": "\\\\"}, {"y": '\\\\"'}], [{"deep": [[[{"x": [{}]}]]]}, {"w": 1}],
]


def records_of(document):
    """Objects in the document's first array, in the order of its text."""
    if isinstance(document, list):
        return [x for x in document if isinstance(x, dict)]
    return next((found for v in document.values() if (found := records_of(v) if isinstance(v, dict) else records_of(v) if isinstance(v, list) else None) is not None), None)


def bare(x):
    return json.dumps(x, sort_keys=True)


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("most", [1, 5, 64, 1 << 20])
def test_array_documents_are_cut_wherever_ranges_end(tmp_path, spark, indent, most):
    want = []
    for i, d in enumerate(DOCUMENTS):
        (tmp_path / f"{i}.json").write_text(json.dumps(d, indent=indent, ensure_ascii=i % 2 == 0) + "\n" * (i % 3), encoding="utf-8-sig" if i == 2 else "utf-8")
        want += [bare(x) for x in records_of(d) or []]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        if most < 1 << 20:
            spark.conf.set("spark.sql.files.maxPartitionBytes", most if most > 1 else 40)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
        path = str(tmp_path) if most > 1 else str(tmp_path / "1.json")
        if most == 1:
            spark.conf.set("spark.sql.files.maxPartitionBytes", 1)
            want = [bare(x) for x in records_of(DOCUMENTS[1])]
        assert sorted(bare(json.loads(r.value)) for r in arrays.array_records(spark, path).collect()) == sorted(want)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_ranges_of_random_documents():
    """The sums and cuts without Spark, with ranges that end behind any closing brace."""
    draw = random.Random(11)

    def value(depth):
        kind = draw.random()
        if depth > 3 or kind < 0.4:
            return "".join(draw.choice('ab"\\{}[],:é') for _ in range(draw.randrange(6)))
        if kind < 0.7:
            return {draw.choice('x"{['): value(depth + 1) for _ in range(draw.randrange(3))}
        return [value(depth + 1) for _ in range(draw.randrange(4))]

    for trial in range(300):
        document = {"h": value(1), "records": [value(2) for _ in range(6)], "t": value(1)} if trial % 2 else [value(1) for _ in range(8)]
        raw = np.frombuffer(json.dumps(document, ensure_ascii=False).encode(), np.uint8)
        places = np.flatnonzero(raw == ord("}")) + 1
        cuts = sorted({0, len(raw), *(p for p in places.tolist() if draw.random() < 0.4)})
        quotes = depth = 0
        array = begun_in = None
        inside = done = False
        found, open_ = [], {}
        starts = []
        for a, b in zip(cuts, cuts[1:]):
            r = arrays.Range()
            for x, y in zip([a, *(m := sorted({draw.randrange(a, b) for _ in range(2)} & set(places.tolist())))], [*m, b]):
                r.add(raw[x:y])
            odd = quotes % 2
            starts.append((a, b, quotes % 2, depth, r, odd))
            quotes, depth = quotes + r.quotes, depth + r.depth[odd]
        array = next((d + r.first[o] for _, _, _, d, r, o in starts if r.first[o] is not None), None)
        for a, b, q, d, r, odd in starts:
            here = not inside and r.first[odd] is not None
            c = arrays.Cutter(q, d, array, inside)
            c.over = done or array is None
            c.late = c.late and not c.over
            out = list(c.add(raw[a:b]))
            out += [c.rest()] if c.rest() else []
            for begins, ends, text in out:
                if begins and ends:
                    found.append(text)
                else:
                    open_.setdefault(a if begins else begun_in, []).append((begins, ends, text))
            low = r.low_after[odd] if here else r.low[odd] if inside else None
            if array is not None and (here or (inside and d + r.low[odd] <= array)):
                begun_in = a
            done = done or (low is not None and d + low < array)
            inside = inside or here
        found += [b"".join(x[2] for x in v) for v in open_.values() if any(x[0] for x in v) and any(x[1] for x in v)]
        want = records_of(document) or []
        assert sorted(bare(json.loads(x)) for x in found) == sorted(map(bare, want)), document


def test_broken_and_zipped_documents(tmp_path, spark):
    (tmp_path / "cut.json").write_text('{"records": [{"a": 1}, {"a": {"b": 2}')
    assert [r.value for r in arrays.array_records(spark, str(tmp_path / "cut.json")).collect()] == ['{"a": 1}']
    with zipfile.ZipFile(tmp_path / "x.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("readme.txt", "no")
        z.writestr("data.json", json.dumps(DOCUMENTS[0], indent=1))
    plain = arrays.unzip(spark, str(tmp_path / "x.zip"), str(tmp_path / "plain" / "data.json"))
    folder = arrays.split_records(spark, plain, str(tmp_path / "out"))
    schema = "LEI struct<`$`:string>"
    for rows in (records.read_records(spark, folder, schema, only=["L7", "L11", ""]), records.read_records(spark, plain, schema, array=True, only=["L7", "L11"])):
        assert sorted((r.LEI["$"], r._corrupt) for r in rows.collect()) == [("L11", None), ("L7", None)]
    assert records.read_records(spark, plain, schema, array=True, only=[]).count() == 0
    with pytest.raises(ValueError):
        arrays.unzip(spark, str(tmp_path / "x.zip"), str(tmp_path / "y"), ".xml")


def test_many_ids_make_no_larger_plan(spark):
    lines = spark.createDataFrame([(f'{{"id": "N{i:019d}"}}',) for i in range(200)] + [(None,)], "value string")
    ids = [f"N{i * 7:019d}" for i in range(100_000)]
    some = records.mentioning(lines, ids)
    assert sorted(r.value for r in some.collect()) == sorted(f'{{"id": "N{i:019d}"}}' for i in range(0, 200, 7))
    plan = lambda f: len(f._jdf.queryExecution().toString())
    assert plan(some) < plan(records.mentioning(lines, ids[:1])) + 50


def test_bad_lines_are_counted(tmp_path, spark):
    (tmp_path / "x.json").write_text('{"company_number": "1", "data": {}}\nnot json\n\n')
    rows = records.read_records(spark, str(tmp_path / "x.json"), registers.PSC_SCHEMA)
    assert rows.where("_corrupt IS NOT NULL").count() == 1 and rows.count() == 2


def test_id_lists(tmp_path, spark):
    (tmp_path / "ids.txt").write_text("# head\nA1 # first\n\n B2\n")
    assert {r.id for r in records.read_id_list(spark, "C3, A1", str(tmp_path / "ids.txt")).collect()} == {"A1", "B2", "C3"}
    records.write_id_list(spark.createDataFrame([("b",), ("a",), ("b",)], "id string"), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["a", "b"]


def _json(spark, tmp_path, rows, schema, **options):
    path = tmp_path / "in.json"
    path.write_text("\n".join(map(json.dumps, rows)))
    return records.read_records(spark, str(path), schema, **options)


def test_lei_records(spark, tmp_path):
    address = {"FirstAddressLine": w("C/O X, Main St. 1"), "AdditionalAddressLine": [w("Floor 2"), w(" ")], "City": w("London"), "PostalCode": w("E1"), "Country": w("GB")}
    rows = [
        {"LEI": w("AAA"), "Entity": {"LegalName": w(" Acme Ltd "), "LegalJurisdiction": w("GB-ENG"), "LegalForm": {"EntityLegalFormCode": w("H0PO"), "OtherLegalForm": w("Unit Trust")},
         "LegalAddress": address, "HeadquartersAddress": address | {"AdditionalAddressLine": w("Suite 3")}, "EntityCreationDate": w("1999-02-03T00:00:00Z"), "EntityStatus": w("ACTIVE"),
         "RegistrationAuthority": {"RegistrationAuthorityID": w("RA000585"), "RegistrationAuthorityEntityID": w("0123")},
         "SuccessorEntity": [{"SuccessorLEI": w("BBB")}, {"Other": w("x")}, {"SuccessorLEI": w("AAA")}]}},
        {"LEI": w("BBB"), "Entity": {"LegalName": w("Bee"), "HeadquartersAddress": {"Country": w("de")}, "EntityStatus": w("INACTIVE"), "SuccessorEntity": {"SuccessorLEI": w("CCC")}}},
        {"LEI": w("CCC"), "Entity": {"LegalName": w(" ")}},
    ]
    raw = _json(spark, tmp_path, rows, gleif.LEI_SCHEMA)
    forms = spark.createDataFrame([("H0PO", "Private Limited Company")], "code string, name string")
    got = {r.lei_id: r for r in gleif.lei_entities(raw, "g", 92, forms, forms.limit(0)).collect()}
    a, b = got["AAA"], got["BBB"]
    assert set(got) == {"AAA", "BBB"} and (a.id, a.name, a.country, a.founded, a.founded_date) == ("lei:AAA", "Acme Ltd", "GB", 1999, "1999-02-03")
    assert (a.legal_form, a.type, a.companies_house_id, a.registration_authority) == ("Private Limited Company", "fund", "0123", "RA000585")
    assert a.address == "C/O X, Main St. 1, Floor 2, London, E1, GB" and a.hq_address.startswith("C/O X, Main St. 1, Suite 3") and a.registered_address == "c o x main st 1 london e1 gb"
    assert (b.country, b.active, b.legal_form) == ("DE", False, None)
    assert sorted(map(tuple, gleif.successions(raw).collect())) == [("AAA", "BBB", "Acme Ltd", "Bee"), ("BBB", "CCC", "Bee", None)]


def relation(child, parent, kind="IS_DIRECTLY_CONSOLIDATED_BY", status="ACTIVE", periods=None, node="LEI"):
    return {"RelationshipRecord": {"Relationship": {"StartNode": {"NodeID": w(child), "NodeIDType": w(node)}, "EndNode": {"NodeID": w(parent), "NodeIDType": w("LEI")},
            "RelationshipType": w(kind), "RelationshipStatus": w(status), "RelationshipPeriods": {"RelationshipPeriod": periods}}}}


PERIOD = {"PeriodType": w("RELATIONSHIP_PERIOD"), "StartDate": w("2020-01-02T00:00:00Z"), "EndDate": w("2021-01-02T00:00:00Z")}


def test_relationships(spark, tmp_path):
    rows = [relation("C", "P", periods=PERIOD), relation("C", "U", "IS_ULTIMATELY_CONSOLIDATED_BY", periods=[{"PeriodType": w("ACCOUNTING_PERIOD"), "StartDate": w("2019")}]),
            relation("C", "F", "IS_FUND-MANAGED_BY"), relation("C", "I", status="INACTIVE", periods=[PERIOD]), relation("S", "S"), relation("N", "P", node="ISIN")]
    raw = _json(spark, tmp_path, rows, gleif.RR_SCHEMA)
    got = sorted((r.from_id, r.to_id, r.direct_or_indirect, r.since, r.until) for r in gleif.owns_edges(raw, "g", 92).collect())
    assert got == [("lei:P", "lei:C", "direct", "2020-01-02", "2021-01-02"), ("lei:U", "lei:C", "indirect", None, None)]
    up, closed = gleif.delta_edges(raw, "g", 92, F.lit("2025-01-01"))
    assert up.count() == 2 and [tuple(r) for r in closed.collect()] == [("lei:I", "lei:C", "direct", "2021-01-02")]


def test_control_register(spark, tmp_path):
    def rec(number, **data):
        return {"company_number": number, "data": data}

    rows = [
        rec("1", kind="individual-person-with-significant-control", name_elements={"forename": "Ada", "surname": "King"}, date_of_birth={"year": 1974, "month": 8},
            natures_of_control=["ownership-of-shares-75-to-100-percent"], notified_on="2016-04-06", links={"self": "/x"}),
        rec("1", kind="corporate-entity-person-with-significant-control", name="Holdco", identification={"registration_number": "99", "country_registered": "England"},
            natures_of_control=["voting-rights-25-to-50-percent"], ceased_on="2020-01-01", address={"locality": "Leeds", "country": "England & Wales", "premises": " 5 "}),
        rec("2", kind="legal-person-person-with-significant-control", name="Foreign", identification={"country_registered": "France"}, links={"self": "/y"}),
        rec("3", kind="super-secure-person-with-significant-control"), rec("4", kind="individual-beneficial-owner"),
    ]
    got = registers.control_rows(_json(spark, tmp_path, rows, registers.PSC_SCHEMA))
    assert got.count() == 3
    person = registers.control_persons(got).first()
    assert (person.id, person.first_name, person.last_name, person.birth_date) == ("chpsc:/x", "Ada", "King", "1974-08")
    entities = {r.id: r for r in registers.control_entities(got, "p", 85).collect()}
    assert set(entities) == {"gb-coh:1", "gb-coh:2", "gb-coh:99", "chpsc:/y"} and entities["gb-coh:99"].hq_country == "GB" and entities["gb-coh:99"].registered_address == "5, Leeds, England & Wales"
    e = {r.from_id: r for r in registers.control_edges(got, "p", 85).collect()}
    assert (e["chpsc:/x"].stake_percent, e["chpsc:/x"].ownership_type) == (75.0, "majority") and (e["gb-coh:99"].voting_power_pct, e["gb-coh:99"].until) == (25.0, "2020-01-01")


def test_company_csv(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('CompanyName, CompanyNumber,CompanyCategory,IncorporationDate,RegAddress.PostTown,RegAddress.AddressLine1,PreviousName_1.CompanyName, PreviousName_2.CompanyName\n'
                    '"Acme ""X""\nLtd",0123,Community Interest Company,03/02/1999,Leeds,"1, High St",OLD LTD,Old Ltd\n,,,,,,,\n')  # fmt: skip
    row = registers.company_updates(registers.read_company_csv(spark, str(path)), 90).collect()
    assert len(row) == 1 and (row[0].id, row[0].type, row[0].founded, row[0].founded_date, row[0].hq_city) == ("gb-coh:0123", "nonprofit", 1999, "1999-02-03", "Leeds")
    assert row[0].aliases == ["OLD LTD"] and row[0].registered_address == "1, High St, Leeds"


def test_filings(spark):
    t = spark.createDataFrame([(1, "Apple Inc."), (2, "Apple Hospitality REIT, Inc."), (3, "Metabank Holding")], "cik_str int, title string")
    q = spark.createDataFrame([("Apple",), ("apple hospitality",), ("Nothing",), ("Meta",)], "q string")
    assert {r.q: r.cik for r in filings.match_tickers(q, t).collect()} == {"Apple": "0000000001", "apple hospitality": "0000000002", "Meta": "0000000003"}
    xml = '<r xmlns="urn:x"><a><issuerCik>{}</issuerCik><issuerName>I</issuerName><classPercent>{}</classPercent></a></r>'
    rows = [("f", "a1", "2020-01-01", xml.format(7, 5.5)), ("f", "a2", "2021-01-01", xml.format(7, 6.5)), ("f", "a3", "2022-01-01", xml.format(7, "0.0")),
            ("f", "a4", "2020-01-01", xml.format(8, "0.0")), ("f", "a5", "2020-01-01", xml.format(9, 3)), ("f", "a6", "2021-01-01", xml.format(9, "n/a"))]
    got = filings.latest_holdings(filings.holding_xml(spark.createDataFrame(rows, "cik string, accession string, filed string, xml string")))
    assert sorted((r.issuer_cik, r.stake_percent, r.since, r.until) for r in got.collect()) == [("0000000007", 6.5, "2021-01-01", "2022-01-01"), ("0000000009", 3.0, "2020-01-01", None)]
    form = "<ownershipDocument><issuer><issuerCik>7</issuerCik></issuer><reportingOwner><rptOwnerName>COOK TIMOTHY D</rptOwnerName><isOfficer>1</isOfficer><officerTitle>Chief Executive Officer</officerTitle></reportingOwner>" \
           "<x><sharesOwnedFollowingTransaction><value>10</value></sharesOwnedFollowingTransaction></x><y><sharesOwnedFollowingTransaction><value>25</value></sharesOwnedFollowingTransaction></y></ownershipDocument>"  # fmt: skip
    people = spark.createDataFrame([("4", "a", "2020", form), ("4", "b", "2019", form), ("8-K", "c", "2021", form)], "form string, accession string, filed string, xml string")
    row = filings.insiders(people).collect()
    assert len(row) == 1 and (row[0].person, row[0].role, row[0].shares, row[0].filed) == ("Timothy D Cook", "CEO", 25.0, "2020")
    inbound = [("7", "0000000042-20-1", "SC 13G", "2020", "Musk Elon  (CIK 0000000042)", "percent of class represented by amount in row 9 7.5% type of reporting person IN"),
               ("7", "0000000042-19-1", "SC 13G", "2019", "Musk Elon  (CIK 0000000042)", "x"), ("7", "0000000007-20-9", "SC 13G", "2021", "Self", "x"), ("7", "0000000043-20-9", "10-K", "2021", "No", "x")]
    frame = spark.createDataFrame(inbound, "cik string, accession string, form string, filed string, display_name string, text string").withColumn("cik", F.lpad("cik", 10, "0"))
    row = filings.inbound_holdings(frame).collect()
    assert len(row) == 1 and (row[0].investor, row[0].stake_percent, row[0].is_person) == ("Elon Musk", 7.5, True)


def test_holdings_parse_texts_once(spark):
    """One parse a filing, whatever is read of it, and no second reading of the filings to find ends."""
    xml = '<r><issuerCik> {} </issuerCik><issuerName>I &amp; J</issuerName><classPercent>{}</classPercent></r>'
    rows = [(c, f"a{k}", f"20{k:02d}", xml.format(i, p)) for k, (c, i, p) in enumerate([("f", 7, 5), ("f", 7, 0), ("f", 7, 6), ("g", 7, 5), ("g", 7, 0), ("g", 7, 0), (None, 7, 5), (None, 7, 0), ("h", "", 5), ("h", "", 0)])]
    frame = spark.createDataFrame([*rows, ("i", "x", "2001", None), ("i", "y", "2002", "<r/>")], "cik string, accession string, filed string, xml string")
    got = filings.latest_holdings(filings.holding_xml(frame))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("XPathStringEvaluator") == 1 and "Join" not in plan
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [
        ("f", "0000000007", "I & J", 6.0, "2002", None), ("g", "0000000007", "I & J", 5.0, "2003", "2005"), (None, "0000000007", "I & J", 5.0, "2006", None), ("h", None, "I & J", 5.0, "2008", None),
    ]))


def test_proxy_tables(spark):
    html = """<p>x</p><table><tr><th>Name of Beneficial Owner</th><th>Shares</th><th>Percent of class</th></tr><tr><td>Jane Roe (1)</td><td>1,234,567</td><td>27.4%</td></tr>
    <tr><td></td><td>2,000,000</td><td>30.0</td></tr><tr><td>John Doe</td><td>12,345</td><td>*</td></tr></table><table><tr><td>other</td></tr></table>"""
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<table><tr><td>a</td></tr></table>")], "page_id long, html string")
    got = [(r.page_id, r.name, r.shares, r.percent) for r in filings.proxy_owners(pages, "page_id", "html").orderBy("row").collect()]
    # A row without a name is nobody's in a table of one share class.
    assert got == [(1, "Jane Roe", 1234567, 27.4), (1, "John Doe", 12345, 0.4)]


@pytest.mark.parametrize("dual", [False, True])
def test_proxy_rows_that_name_no_owner(dual):
    head = ["Name", "Class A", "Class B", "Voting power"] if dual else ["Name of Beneficial Owner", "Shares", "Percent of class", ""]
    rows = [head, ["5% holders:", "", "", ""], ["Jeffrey P. Bezos 410 Terry Ave N, Seattle", "1,000,000", "", "9.5%"], ["Executive Officers and Directors:", "", "", ""], ["Vanguard 500 Fund (3)", "60,000", "", "7.5%"],
            ["Other >5% Security Holders", "1", "2", "3.0%"], ["Jane Roe (1)(2)", "20,000", "", "1.5%"], ["All directors and executive officers as a group (12 persons)", "90,000", "80,000", "12.0%"]]
    html = "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"
    # A number and a word behind a name read as an address, as in "Vanguard 500 Fund".
    assert filings.owner_rows(html) == [("Jeffrey P. Bezos", "1,000,000", "9.5%"), ("Vanguard", "60,000", "7.5%"), ("Jane Roe (1)(2)", "20,000", "1.5%")]


COVER = """<?xml version="1.0"?><edgarSubmission xmlns="http://www.sec.gov/edgar/thirteenffiler" xmlns:com="http://www.sec.gov/edgar/common" xmlns:xsi="http://x/">
<formData><coverPage><com:otherManagersInfo><com:otherManager xsi:nil="false"><com:cik>102909</com:cik><form13FFileNumber>028-1</form13FFileNumber><com:name>Fund &amp; Co </com:name></com:otherManager>
<otherManager><name>No Number LLC</name></otherManager><otherManager><cik>abc</cik><name>Odd</name></otherManager><otherManager/></com:otherManagersInfo></coverPage>
<summaryPage><otherManagers2Info><otherManager2><sequenceNumber>1</sequenceNumber><otherManager><cik>0000102909</cik><name>Fund again</name></otherManager></otherManager2>
<otherManager2><otherManager><cik>7</cik></otherManager></otherManager2></otherManagers2Info></summaryPage></formData></edgarSubmission>"""


def test_affiliated_managers(spark):
    rows = [("1", "13F-HR", "0000000001-24-000002", "2024-02-01", COVER), ("1", "13F-HR", "0000000001-23-000001", "2023-02-01", COVER.replace("Odd", "Old")),
            ("2", "13F-NT/A", "0000000002-24-000001", "2024-01-01", "<a><otherManager><name>Sole</name></otherManager></a>"), ("3", "10-K", "x", "2024-01-01", COVER),
            ("4", "13F-HR", "x", "2024-01-01", "not <xml"), ("5", "13F-HR", "x", "2024-01-01", None), ("6", "13F-HR", "x", "2024-01-01", "<a><otherManager><name>br<oken</name></otherManager></a>")]
    got = filings.affiliated_managers(spark.createDataFrame(rows, "cik string, form string, accession string, filed string, xml string")).collect()
    assert sorted((r.cik, r.manager_cik or "", r.manager, r.source_date) for r in got) == [
        ("1", "", "No Number LLC", "2024-02-01"), ("1", "", "Odd", "2024-02-01"), ("1", "0000102909", "Fund & Co", "2024-02-01"), ("2", "", "Sole", "2024-01-01")]
    assert {r.form_type for r in got} == {"13F-HR", "13F-NT/A"} and all(r.source_url for r in got)


def feed(company="", entries=()):
    info = f"<company-info><cik>{company[0]}</cik><conformed-name>{company[1]}</conformed-name></company-info>" if company else ""
    body = "".join(f'<entry><id>{i}</id><title>t</title><content type="text/xml">{c}</content></entry>' for i, c in entries)
    return f'<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">{info}{body}</feed>'


def filed(accession, date):
    return f"<accession-number>{accession}</accession-number><filing-date>{date}</filing-date><filing-type>DEF 14A</filing-type>"


def test_atom_feeds(spark):
    rows = [("a", feed(("12", "Acme &amp; Co"), [("urn:x", filed("1-2-3", "2024-01-01")), ("urn:y", "")])), ("b", feed((), [("urn:tag:www.sec.gov:cik=0000000034", "<company-info><cik>34</cik></company-info>")])), ("c", "<broken"), ("d", None)]
    feeds = spark.createDataFrame(rows, "q string, xml string")
    assert sorted(map(tuple, filings.feed_companies(feeds).collect())) == [("a", "0000000012", "Acme & Co"), ("b", None, ""), ("c", None, ""), ("d", None, "")]
    assert sorted(map(tuple, filings.feed_entries(feeds).collect())) == [
        ("a", 0, "1-2-3", "2024-01-01", "DEF 14A", None, "t"), ("a", 1, None, None, None, None, "t"), ("b", 0, None, None, None, "0000000034", "t")]


def test_proxy_look_ups(spark):
    """By id over pages, by a sure feed, by a feed that lists companies, and again under the registered name."""
    k = lambda n: f"{n:010d}"
    companies = spark.createDataFrame([(k(1), "Known Corp"), (k(2), "Acme Inc"), (k(3), "Meta Platforms Inc"), (k(4), "Meta Platforms Co"), (k(5), "Alphabet Inc"), (k(6), "Google Inc"), (k(7), "Zzz")], "cik string, name string")
    rows = [(k(1), 0, 0, "10-K", "1-k", "d", "2024-05-05"), (k(1), 2, 0, "DEF 14A", "1-b", "d", "2019-01-01"), (k(1), 1, 5, "DEF 14A", "1-a", "d", "2020-01-01"), (k(1), 1, 2, "DEF 14A", "1-x", "", "2021-01-01"),
            (k(2), 0, 0, "DEF 14A", "2-new", "d", "2024-03-03"), (k(2), 0, 1, "DEF 14A", "2-old", "e", "2023-03-03"), (k(3), 0, 0, "DEF 14A", "3-a", "d", "2023-01-01"), (k(4), 0, 0, "DEF 14A", "4-a", "d", "2024-01-01"),
            (k(5), 0, 0, "DEF 14A", "5-a", "d", "2024-06-06"), (k(6), 0, 0, "DEF 14A", "6-a", "d", "2014-01-01"), (k(7), 0, 0, "DEF 14A", "7-a", "d", "2024-01-01")]
    table = spark.createDataFrame(rows, "cik string, page int, place int, form string, accession string, document string, filed string")
    listing = lambda *n: feed((), [(f"urn:tag:www.sec.gov:cik={k(i)}", "") for i in n])
    feeds = [("Acme", feed((k(2), "Acme Inc"), [("u", ""), ("u", filed("2-old", "")), ("u", filed("2-new", ""))])), ("Meta Platforms", listing(7, 3, 4)), ("Google", feed((k(6), "Google Inc"), [("u", filed("6-a", ""))])),
             ("Google Inc", listing(5)), ("Unlike", feed((k(7), "Zzz"), [("u", filed("7-a", ""))])), ("Old Google", listing(6)), ("Alphabet", listing(5, 99))]
    queries = spark.createDataFrame([("Known", "1"), ("Acme", None), ("Meta Platforms", None), ("Google", None), ("Unlike", None), ("Nobody", None), ("Alphabet", None)], "q string, cik string")
    found = filings.locate_proxy(queries, spark.createDataFrame(feeds, "q string, xml string"), companies, table, 2020)
    got = {r.q: (r.accession, r.stale, r.found_by) for r in found.collect()}
    # The feed under Google's registered name lists a company of another name, so the old statement stands.
    assert got == {"Known": ("1-a", False, "cik"), "Acme": ("2-old", False, "name"), "Meta Platforms": ("4-a", False, "name"), "Google": ("6-a", True, "name"), "Alphabet": ("5-a", False, "name")}
    renamed = companies.withColumn("name", F.when(F.col("cik") == k(6), "Alphabet").otherwise(F.col("name")))
    again = filings.locate_proxy(queries.where("q = 'Google'"), spark.createDataFrame([("Google", feeds[2][1]), ("Alphabet", listing(5))], "q string, xml string"), renamed, table, 2020)
    assert [(r.q, r.accession, r.stale, r.found_by) for r in again.collect()] == [("Google", "5-a", False, "registered")]


def test_wikidata(spark):
    def row(**k):
        return {a: {"value": b} for a, b in k.items()}

    rows = [("Q1", 0, row(itemLabel="Acme", instance="http://x/entity/Q157031", lei="short", cik="789019", coord="Point(8 47)", ceo="http://x/entity/Q9", ceoLabel="Ada")),
            ("Q1", 1, row(itemLabel="Other", alias="ACM", inception="1999-01-01T00:00:00Z", countryCode="ch"))]
    frame = spark.createDataFrame(rows, f"id string, n int, row {wikidata.ROW_SCHEMA}")
    r = wikidata.company_facts(frame).first()
    assert (r.name, r.type, r.lei_id, r.sec_cik, r.hq_lat, r.founded, r.country, r.aliases) == ("Acme", "foundation", None, "0000789019", 47.0, 1999, "CH", ["ACM"])
    assert [tuple(x)[:4] for x in wikidata.people_of(frame, {"ceo": "CEO"}).collect()] == [("Q1", "Q9", "Ada", "CEO")]


def test_snapshot_round_trip(spark, tmp_path):
    e = spark.createDataFrame([("e1", "E", "Q1"), ("e2", "F", None)], "id string, name string, wikidata_id string")
    p = spark.createDataFrame([("p1", "P", None)], "id string, full_name string, wikidata_id string")
    o = spark.createDataFrame([("x", "p1", "e1", 5.0)], "edge_id string, from_id string, to_id string, stake_percent double")
    snapshot.export_snapshot(e, p, o, str(tmp_path / "s"))
    back = snapshot.read_snapshot(spark, str(tmp_path / "s"), "entity", "id string, name string, wikidata_id string")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, e.collect()), key=str)
    edge = snapshot.read_snapshot(spark, str(tmp_path / "s"), "owns", "edge_id string, from_ref string, stake_percent double").first()
    assert json.loads(edge.from_ref)["name"] == "P"
