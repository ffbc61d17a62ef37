"""Schemas of the graph's tables, and empty tables of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PROVENANCE = "source_id string, credibility_score int, source_url string, source_date string, last_scraped_at string"
TABLES = {
    "entity": "id string, name string, name_normalized string, search_text string, type string, country string, description string, "
    "wikidata_id string, sec_cik string, lei_id string, companies_house_id string, registered_address string, address string, legal_form string, "
    "registration_authority string, registration_number string, founded int, founded_date string, hq_city string, hq_country string, "
    "hq_address string, hq_lat double, hq_lng double, hq_geo_precision string, employees int, revenue double, is_nominee boolean, active boolean, "
    "verified boolean, on_demand_scraped boolean, scrape_depth int, name_credibility int, aliases array<string>, countries array<string>, "
    "hq_locations array<string>, extra map<string,string>, source_id string, source_url string, source_date string, last_scraped_at string",
    "person": "id string, full_name string, first_name string, last_name string, search_text string, nationality string, birth_date string, "
    "death_date string, birth_place string, description string, wikidata_id string, sec_cik string, source_id string, alias array<string>, "
    "nationalities array<string>, verified boolean",
    "source": "id string, name string, url string, type string, key_id string, credibility_score int, verified boolean",
    "owns": "edge_id string, from_id string, from_kind string, to_id string, stake_percent double, voting_power_pct double, ownership_type string, "
    f"interest_types array<string>, direct_or_indirect string, since string, until string, value_usd double, file_date string, {_PROVENANCE}",
    "has_role": f"edge_id string, from_id string, to_id string, role string, since string, until string, {_PROVENANCE}",
    "related_to": f"edge_id string, from_id string, from_kind string, to_id string, relation string, {_PROVENANCE}",
    "dual_listed_with": f"edge_id string, from_id string, to_id string, {_PROVENANCE}",
    "succeeded_by": f"edge_id string, from_id string, to_id string, since string, {_PROVENANCE}",
    "not_duplicate": "kind string, a string, b string, at string",
    "claim": "claim_key string, kind string, from_id string, to_id string, source_id string, stake_percent double, voting_power_pct double, "
    "ownership_type string, role string, since string, until string, source_url string, source_date string, credibility_score int, "
    "first_seen_at string, last_seen_at string",
    "merged_id": "old_id string, new_id string, kind string, at string",
    "merge_log": "id string, kind string, keep_id string, keep_name string, dup_id string, dup_name string, at string, count int",
    "flag": "id string, target_kind string, category string, note string, status string, reporter_kind string, reporter_id string, "
    "reporter_fp string, from_id string, to_id string, role string, node_id string, created_at string, updated_at string",
    "suppression": "id string, target_kind string, from_id string, to_id string, role string, node_id string, flag_id string, created_at string",
    "pin": "id string, target_kind string, from_id string, to_id string, ownership_type string, stake_percent double, flag_id string, "
    "created_at string, updated_at string",
    "scrape_run": "id string, source string, target string, status string, started_at string, finished_at string, error string, total int",
    "import_state": "key string, last_publish_date string, last_run_at string, holder string, acquired_at string",
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])
