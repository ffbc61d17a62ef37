"""Queries over filings' XML and Atom feeds that are made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stakeweave.plans.registry import _driver, query
from stakeweave.sources import filings

def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _id(k):
    return F.lpad(k.cast("string"), 10, "0")


@query(
    """SELECT lpad(CAST(s_suppkey AS STRING), 10, '0') AS cik, lpad(CAST(s_suppkey + 1 AS STRING), 10, '0') AS manager_cik, s_name || ' & Co' AS manager, '2024-02-01' AS source_date, '13F-HR' AS form_type FROM supplier
UNION ALL SELECT lpad(CAST(s_suppkey AS STRING), 10, '0'), NULL, 'Nation ' || CAST(s_nationkey AS STRING), '2024-02-01', '13F-HR' FROM supplier WHERE s_suppkey % 3 = 0"""
)
def affiliated_managers(t, spark, sf_dir):
    """Managers that the latest of two covers names, under two namespaces, at two depths and twice each."""
    k = F.col("s_suppkey")
    s = _driver(spark, sf_dir, "supplier")
    name = F.col("s_name")
    cover = F.concat(
        _text('<e xmlns:c="http://x/c" xmlns="http://x/d"><f><c:otherManager><c:cik>', k + 1, "</c:cik><c:name>", name, " &amp; Co</c:name></c:otherManager></f><s><o><otherManager><cik>", _id(k + 1), "</cik><name>again</name></otherManager></o></s>"),
        F.when(k % 3 == 0, _text("<otherManager><name>Nation ", F.col("s_nationkey"), "</name></otherManager><otherManager><name>NATION ", F.col("s_nationkey"), "</name></otherManager>")).otherwise(F.lit("")), F.lit("</e>"),
    )
    both = F.explode(F.array(F.struct(F.lit("2023-02-01").alias("filed"), F.lit("<e><otherManager><name>Old</name></otherManager></e>").alias("xml")), F.struct(F.lit("2024-02-01").alias("filed"), cover.alias("xml"))))
    rows = s.select(_id(k).alias("cik"), F.lit("13F-HR").alias("form"), _text(_id(k), "-24-000001").alias("accession"), both.alias("x")).select("cik", "form", "accession", "x.filed", "x.xml")
    return filings.affiliated_managers(rows).drop("source_url")


def _feeds(s):
    """Of three suppliers one has a feed of its own filings, one a list of companies, and one nothing."""
    k = F.col("s_suppkey")
    entry = lambda i, c: _text("<a:entry><a:id>", i, "</a:id><a:title>t</a:title><a:content>", c, "</a:content></a:entry>")
    own = F.concat(
        _text('<a:feed xmlns:a="http://www.w3.org/2005/Atom"><a:company-info><a:cik>', k, "</a:cik><a:conformed-name>", F.col("s_name"), "</a:conformed-name></a:company-info>"),
        entry("urn:x", _text("<a:accession-number>", k, "-9</a:accession-number><a:filing-date>2024-01-01</a:filing-date>")), F.lit("</a:feed>"),
    )
    listed = F.concat(F.lit('<a:feed xmlns:a="http://www.w3.org/2005/Atom">'), entry(_text("urn:tag:www.sec.gov:cik=", _id(k + 1)), ""), entry(_text("urn:tag:www.sec.gov:CIK=", _id(k)), ""), F.lit("</a:feed>"))
    return s.select(F.col("s_name").alias("q"), F.when(k % 3 == 1, own).when(k % 3 == 2, listed).alias("xml"))


@query(
    """SELECT s_name AS q, 0 AS place, CAST(s_suppkey AS STRING) || '-9' AS accession, '2024-01-01' AS filed, NULL AS entry_cik FROM supplier WHERE s_suppkey % 3 = 1
UNION ALL SELECT s_name, 0, NULL, NULL, lpad(CAST(s_suppkey + 1 AS STRING), 10, '0') FROM supplier WHERE s_suppkey % 3 = 2
UNION ALL SELECT s_name, 1, NULL, NULL, lpad(CAST(s_suppkey AS STRING), 10, '0') FROM supplier WHERE s_suppkey % 3 = 2"""
)
def atom_entries(t, spark, sf_dir):
    return filings.feed_entries(_feeds(_driver(spark, sf_dir, "supplier"))).drop("form", "title")


@query(
    """SELECT s_name AS q, lpad(CAST(s_suppkey AS STRING), 10, '0') AS cik, CAST(s_suppkey AS STRING) || CASE WHEN s_suppkey % 3 = 0 THEN '-8' ELSE '-9' END AS accession,
  CASE WHEN s_suppkey % 5 = 0 THEN '2014' ELSE '2024' END || '-01-01' AS filed, s_suppkey % 5 = 0 AS stale, CASE WHEN s_suppkey % 3 = 0 THEN 'cik' ELSE 'name' END AS found_by FROM supplier"""
)
def proxy_look_ups(t, spark, sf_dir):
    """Proxy statements by id from an archive page, by a feed of one company, and by a feed that lists several."""
    k = F.col("s_suppkey")
    s = _driver(spark, sf_dir, "supplier")
    made = F.struct(F.when(k % 3 == 0, 1).otherwise(0).alias("page"), F.lit(3).alias("place"), F.lit("DEF 14A").alias("form"), _text(k, F.when(k % 3 == 0, F.lit("-8")).otherwise(F.lit("-9"))).alias("accession"),
                    F.lit("d.htm").alias("document"), F.concat(F.when(k % 5 == 0, "2014").otherwise("2024"), F.lit("-01-01")).alias("filed"))
    other = F.struct(F.lit(0).alias("page"), F.lit(1).alias("place"), F.lit("10-K").alias("form"), F.lit("k").alias("accession"), F.lit("k.htm").alias("document"), F.lit("2024-06-01").alias("filed"))
    rows = s.select(_id(k).alias("cik"), F.explode(F.array(made, other)).alias("f")).select("cik", "f.*")
    queries = s.select(F.col("s_name").alias("q"), F.when(k % 3 == 0, k.cast("string")).alias("cik"))
    return filings.locate_proxy(queries, _feeds(s), s.select(_id(k).alias("cik"), F.col("s_name").alias("name")), rows, 2020).drop("document")
