"""DuckDB SQL for every table the plans build, written from the table's definition.

``RELATIONS`` maps a relation to its SQL; a relation may read any other. ``query`` returns
one statement whose WITH clause holds just the relations it needs.
"""

from __future__ import annotations

import re

from plumbline import fixed_values as fixed
from plumbline.plans.intermediate import decode_measure
from plumbline.plans.marts_lending import ACTION_GROUPS
from plumbline.plans.staging import LABELLED, enrolment_name
from plumbline.sources.seeds import parse_fixed
from plumbline.testbed import raw_tables
from plumbline.testbed.dialect import DUCKDB
from plumbline.testbed.frames import PARAMS


def _values(text: str) -> str:
    header, rows = parse_fixed(text)
    cells = ", ".join(
        "(" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in row) + ")"
        for row in rows)
    return f"SELECT * FROM (VALUES {cells}) AS seed({', '.join(header)})"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


RAW = ("complaints", "claims", "policies", "declarations", "lending", "institutions", "indicators",
       "medicare", "population", "population_65", "prices", "price_series", "crosswalk")

RELATIONS: dict[str, str] = {f"raw_{name}": getattr(raw_tables, name)(DUCKDB) for name in RAW}
RELATIONS.update({
    "seed_states": _values(fixed.STATES),
    "seed_areas": _values(fixed.AREAS),
    "seed_exceptions": _values(fixed.COUNTY_EXCEPTIONS),
    "seed_cycles": _values(fixed.SURVEY_CYCLES),
    "seed_products": _values(fixed.PRODUCT_FAMILIES),
    "seed_responses": _values(fixed.RESPONSE_FAMILIES),
    "seed_services": _values(fixed.SERVICE_CATEGORIES),
    "seed_indicators": _values(fixed.INDICATORS),
    "seed_codes": _values(fixed.LENDING_CODES),
})

# ── conformed ────────────────────────────────────────────────────────────────────────────
RELATIONS["states"] = """
SELECT state_code, state_fips, state_name, entity_type, census_region, census_region_name,
  census_division, census_division_name, true AS is_us_jurisdiction, state_code = 'MI' AS is_michigan
FROM seed_states
UNION ALL BY NAME SELECT state_code, state_fips, area_name AS state_name, entity_type,
  false AS is_us_jurisdiction, false AS is_michigan FROM seed_areas
UNION ALL BY NAME SELECT 'UN' AS state_code, 'State unavailable' AS state_name, 'unknown' AS entity_type,
  false AS is_michigan"""
RELATIONS["county_refs"] = """
SELECT 'nfip_claims' AS source_name, coalesce(nullif(trim(county_code), ''), nullif(census_geoid[1:5], '')) AS county_fips FROM raw_claims
UNION SELECT 'nfip_policies', nullif(census_geoid[1:5], '') FROM raw_policies
UNION SELECT 'fema_declarations', fips_state_code || fips_county_code FROM raw_declarations
UNION SELECT 'cms_geographic_variation', BENE_GEO_CD FROM raw_medicare WHERE BENE_GEO_LVL = 'County'
UNION SELECT 'hmda_lar', county_code FROM raw_lending WHERE county_code <> 'NA'
UNION SELECT 'zip_county_crosswalk', geoid FROM raw_crosswalk
UNION SELECT 'acs5_subject', state || county FROM raw_population_65 WHERE geo_level = 'county'"""
RELATIONS["counties"] = """
SELECT k.county_fips, coalesce(a.state, k.county_fips[1:2]) AS state_fips,
  coalesce(a.county, CASE WHEN length(k.county_fips) = 5 THEN k.county_fips[3:5] END) AS county_fips_3,
  s.state_code, s.state_name,
  coalesce(nullif(split_part(a.full_name, ',', 1), ''), e.county_name,
    CASE WHEN kind.g = 'unknown_county' THEN s.state_code || '-UNKNOWN' END) AS county_name,
  a.full_name AS county_name_full, kind.g AS geography_kind, kind.g = 'county' AS is_reportable_county,
  coalesce(a.state, k.county_fips[1:2]) = '26' AS is_michigan, a.first_vintage, a.last_vintage,
  a.last_vintage = (SELECT max(vintage) FROM raw_population) AS is_current_vintage, e.note AS geography_note
FROM (SELECT county_fips FROM county_refs UNION SELECT state || county FROM raw_population WHERE geo_level = 'county'
      UNION SELECT county_fips FROM seed_exceptions) k
LEFT JOIN (SELECT state, county, min(vintage) AS first_vintage, max(vintage) AS last_vintage, arg_max(name, vintage) AS full_name
           FROM raw_population WHERE geo_level = 'county' GROUP BY ALL) a ON a.state || a.county = k.county_fips
LEFT JOIN seed_exceptions e ON e.county_fips = k.county_fips,
LATERAL (SELECT CASE WHEN a.state IS NOT NULL THEN 'county'
    WHEN length(k.county_fips) = 5 AND k.county_fips[3:5] = '000' THEN 'unknown_county'
    WHEN k.county_fips[1:2] IN """ + _in(fixed.ISLAND_AREA_FIPS) + """ THEN 'island_area' ELSE 'retired' END AS g) kind
LEFT JOIN states s ON s.state_fips = coalesce(a.state, k.county_fips[1:2])
WHERE trim(k.county_fips) <> ''"""
RELATIONS["periods"] = """
SELECT grain || ':' || period_key AS period_id, * FROM (
  SELECT 'month' AS grain, strftime(d, '%Y-%m') AS period_key, d AS period_start, last_day(d) AS period_end,
    strftime(d, '%Y-%m') AS period_label, year(d)::SMALLINT AS calendar_year, false AS spans_multiple_years
  FROM (SELECT unnest(generate_series(DATE '1953-01-01', DATE '2029-12-01', INTERVAL 1 MONTH))::DATE AS d)
  UNION ALL SELECT 'year', y::VARCHAR, make_date(y, 1, 1), make_date(y, 12, 31), y::VARCHAR, y::SMALLINT, false
  FROM (SELECT unnest(range(1913, 2030)) AS y)
  UNION ALL SELECT 'survey_cycle', cycle_key, make_date(year_start::INT, 1, 1), make_date(year_end::INT, 12, 31),
    cycle_label, year_end::SMALLINT, spans_multiple_years::BOOLEAN FROM seed_cycles)"""

# ── staging ──────────────────────────────────────────────────────────────────────────────
RELATIONS["claims"] = """
SELECT c.claim_id, c.state_code, c.date_of_loss, c.year_of_loss, c.county_code, c.census_geoid,
  amount_building AS amount_paid_on_building_claim, amount_contents AS amount_paid_on_contents_claim,
  amount_icc AS amount_paid_on_icc_claim, net_building AS net_building_payment_amount,
  net_contents AS net_contents_payment_amount, net_icc AS net_icc_payment_amount,
  reason_building AS non_payment_reason_building, reason_contents AS non_payment_reason_contents,
  rated_flood_zone, flood_zone_current, occupancy_type, pre_firm_indicator,
  post_firm_indicator AS post_firm_construction_indicator, crs_class_code,
  building_coverage AS total_building_insurance_coverage, contents_coverage AS total_contents_insurance_coverage,
  nullif(reported_zip_code, '') AS reported_zip_code, open_date, most_recent_payment_date,
  coalesce(nullif(trim(county_code), ''), nullif(census_geoid[1:5], '')) AS county_fips,
  CASE WHEN trim(county_code) <> '' THEN 'county_code' WHEN census_geoid <> '' THEN 'census_geoid' END AS county_fips_source,
  county_fips IS NOT NULL AS has_usable_county, c.state_code = 'UN' AS is_state_unknown,
  CASE WHEN s.state_fips IS NOT NULL THEN county_fips[1:2] = s.state_fips END AS county_matches_reported_state,
  strftime(date_of_loss, '%Y-%m') AS loss_year_month, month(date_of_loss)::TINYINT AS loss_month,
  amount_building + amount_contents + amount_icc AS total_amount_paid,
  net_building + net_contents + net_icc AS total_net_payment,
  amount_building IS NULL AND coalesce(reason_building, reason_contents) IS NOT NULL AS is_closed_without_payment,
  amount_building IS NULL AND coalesce(reason_building, reason_contents) IS NULL AS is_unexplained_missing_payment,
  coalesce(amount_building + amount_contents + amount_icc = 0, false) AS is_zero_paid,
  coalesce(least(amount_building, amount_contents, amount_icc) < 0, false) AS has_negative_payment
FROM raw_claims c LEFT JOIN states s USING (state_code)"""
RELATIONS["policies"] = """
SELECT policy_id, state_code, census_geoid, nullif(reported_zip_code, '') AS reported_zip_code, policy_count,
  effective_date AS policy_effective_date, termination_date AS policy_termination_date, as_of_date, policy_cost,
  premium AS total_insurance_premium_of_the_policy, building_coverage AS total_building_insurance_coverage,
  contents_coverage AS total_contents_insurance_coverage, nullif(census_geoid[1:5], '') AS county_fips,
  coalesce(census_geoid, '') <> '' AS has_usable_county,
  (termination_date - effective_date)::INT AS policy_term_days, termination_date <= effective_date AS has_invalid_term,
  policy_count > 1 AS is_multi_policy_row
FROM raw_policies"""
RELATIONS["declarations"] = f"""
SELECT area_id AS declaration_area_id, disaster_number, declaration_string AS fema_declaration_string,
  declaration_type, declaration_date, incident_type, declaration_title, ia_program_declared, pa_program_declared,
  incident_begin_date, incident_end_date, fips_state_code, fips_county_code, state_code,
  fips_state_code || fips_county_code AS county_fips, fips_county_code = '000' AS is_statewide,
  fips_county_code <> '000' AS has_usable_county, incident_end_date IS NULL AS is_incident_open,
  coalesce(incident_end_date < incident_begin_date, false) AS has_invalid_incident_window,
  (incident_end_date - incident_begin_date)::INT AS incident_duration_days, declaration_type = 'DR' AS is_major_disaster,
  lower(incident_type) IN {_in(fixed.FLOOD_INCIDENTS)} AS is_flood_related
FROM raw_declarations"""
RELATIONS["complaints"] = """
SELECT complaint_id, product, c.sub_product, c.issue, c.sub_issue, consumer_narrative, company_public_response,
  company_name, state_code_raw, zip_code_raw, tags, submitted_via, company_response, partition_year,
  try_cast(date_received AS DATE) AS date_received, try_cast(date_sent_to_company AS DATE) AS date_sent_to_company,
  date_received[1:7] AS received_year_month, date_received[1:4]::SMALLINT AS received_year,
  coalesce(date_sent_to_company < date_received, false) AS was_sent_before_received, product_family, response_family,
  grants_relief::BOOLEAN AS response_grants_relief, coalesce(is_closed = 'false', false) AS is_response_pending,
  timely_response_raw = 'Yes' AS is_timely_response, coalesce(contains(tags, 'Older American'), false) AS has_tag_older_american,
  coalesce(contains(tags, 'Servicemember'), false) AS has_tag_servicemember, consumer_narrative IS NOT NULL AS has_narrative,
  CASE WHEN length(state_code_raw) = 2 THEN state_code_raw END AS state_code,
  coalesce(length(state_code_raw) <> 2, false) AS has_malformed_state,
  CASE WHEN zip_code_raw IS NULL THEN 'null' WHEN regexp_full_match(zip_code_raw, '\\d{5}') THEN 'full'
    WHEN regexp_full_match(zip_code_raw, '\\d{3}XX') THEN 'prefix_masked'
    WHEN regexp_full_match(zip_code_raw, 'X+') THEN 'fully_masked' ELSE 'malformed' END AS zip_mask_kind,
  CASE WHEN regexp_full_match(zip_code_raw, '\\d{5}') THEN zip_code_raw END AS zip5,
  nullif(regexp_extract(zip_code_raw, '^\\d{3}'), '') AS zip3
FROM raw_complaints c LEFT JOIN seed_products USING (product) LEFT JOIN seed_responses USING (company_response)"""


def _normal(name: str) -> str:
    return (f"nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower({name}), '[^a-z0-9 ]', ' ', 'g'), "
            f"' ({fixed.COMPANY_SUFFIXES})( |$)', ' ', 'g'), ' +', ' ', 'g')), '')")


RELATIONS["institutions"] = f"""
SELECT lei, name AS institution_name, {_normal('name')} AS institution_name_normalized,
  try_cast(filings AS INT) AS filings_reported, period AS activity_year FROM raw_institutions"""


def _lending() -> str:
    amounts, parts = fixed.EXEMPTIBLE_AMOUNTS, []
    for name in amounts:
        parts.append(f"try_cast({name} AS DOUBLE) AS {name}")
        parts.append(f"CASE WHEN {name} IN ('Exempt', 'NA') THEN {name} END AS {name}_sentinel")
    for name in ("loan_amount", "income", "ffiec_msa_md_median_family_income"):
        parts.append(f"try_cast({name} AS DOUBLE) AS {name}")
    exempt = [f"{a} = 'Exempt'" for a in amounts] + [f"{c} = '1111'" for c in fixed.EXEMPTIBLE_CODES]
    parts.append(f"coalesce({' OR '.join(exempt)}, false) AS is_partially_exempt")
    labels = [
        f"(SELECT any_value(label) FROM seed_codes x WHERE x.list_name = '{lst}' AND x.code = l.{src}) AS {name}_label"
        for name, (lst, src) in LABELLED.items()]
    codes = sorted({src for _, src in LABELLED.values()})
    ages = "('8888', '9999')"
    return f"""
SELECT activity_year, lei, state_code, county_code, census_tract, {', '.join(codes)}, {', '.join(parts)},
  CASE WHEN income = 'NA' THEN 'NA' END AS income_sentinel, nullif(county_code, 'NA') AS county_fips,
  county_code = 'NA' AS has_no_reported_county, coalesce(starts_with(county_code, '26'), false) AS is_michigan_county,
  nullif(census_tract, 'NA') AS census_tract_geoid, census_tract = 'NA' AS has_no_reported_tract,
  debt_to_income_ratio AS dti_band, try_cast(debt_to_income_ratio AS DOUBLE) AS dti_exact_pct,
  CASE WHEN debt_to_income_ratio IN ('NA', 'Exempt') THEN debt_to_income_ratio END AS dti_sentinel,
  total_units AS total_units_band, try_cast(total_units AS INT) AS total_units_exact,
  CASE WHEN applicant_age NOT IN {ages} THEN applicant_age END AS applicant_age_band,
  CASE WHEN applicant_age IN {ages} THEN applicant_age END AS applicant_age_sentinel,
  CASE WHEN co_applicant_age NOT IN {ages} THEN co_applicant_age END AS co_applicant_age_band,
  CASE WHEN co_applicant_age IN {ages} THEN co_applicant_age END AS co_applicant_age_sentinel,
  {', '.join(labels)}
FROM raw_lending l"""


RELATIONS["lending"] = _lending()
RELATIONS["cells"] = f"""
SELECT locationabbr AS location_abbr, locationdesc AS location_desc, class, classid AS class_id, topic, question,
  questionid AS question_id, data_value_unit, data_value_type, footnote AS footnote_symbol,
  stratification1 AS stratification_1, stratificationcategory2 AS stratification_category_2,
  stratification2 AS stratification_2, yearstart::SMALLINT AS year_start, yearend::SMALLINT AS year_end,
  CASE WHEN yearstart = yearend THEN yearstart ELSE concat(yearstart, '-', yearend) END AS cycle_key,
  'survey_cycle' AS period_grain, yearstart <> yearend AS spans_multiple_years,
  CASE WHEN locationabbr = 'US' THEN 'national' WHEN locationabbr IN {_in(fixed.CENSUS_REGIONS)} THEN 'census_region'
    WHEN entity_type IN ('state', 'district', 'territory') THEN entity_type ELSE 'other' END AS location_kind,
  locationabbr = 'MI' AS is_michigan, class ILIKE '%cognitive decline%' AS is_cognitive_decline,
  class ILIKE '%caregiv%' AS is_caregiving, try_cast(trim(data_value) AS DOUBLE) AS data_value,
  try_cast(trim(low) AS DOUBLE) AS low_confidence_limit, try_cast(trim(high) AS DOUBLE) AS high_confidence_limit,
  trim(data_value) = '' AS is_suppressed, footnote IS NOT NULL AS has_footnote,
  trim(low) <> '' AND trim(high) <> '' AS has_confidence_interval, stratification1 = 'Overall' AS is_overall_age_group,
  coalesce(stratificationcategory2, 'None') = 'None' AS is_unstratified_second_dimension
FROM raw_indicators LEFT JOIN states ON state_code = locationabbr"""


def _medicare() -> str:
    names = {c: enrolment_name(c) for c in raw_tables.ENROLMENT}
    typed = ", ".join(f"try_cast({c} AS DOUBLE) AS {n}" for c, n in names.items())
    marked = " + ".join(f"coalesce(({c} = '*')::INT, 0)" for c in names)
    return f"""
SELECT BENE_GEO_LVL AS geo_level, BENE_GEO_CD AS geo_code, BENE_GEO_DESC AS geo_description, BENE_AGE_LVL AS age_level,
  YEAR::SMALLINT AS measure_year, {typed}, {marked} AS suppressed_cell_count,
  CASE BENE_GEO_LVL WHEN 'County' THEN BENE_GEO_CD END AS county_fips, BENE_GEO_LVL = 'County' AS is_county_row,
  coalesce(BENE_GEO_LVL = 'County' AND ends_with(BENE_GEO_CD, '000'), false) AS is_unassigned_county,
  coalesce(BENE_GEO_LVL = 'County' AND starts_with(BENE_GEO_CD, '26'), false) AS is_michigan_county,
  YEAR AS period_key, 'year' AS period_grain, BENE_AGE_LVL = 'All' AS is_all_ages,
  try_cast(BENES_OM_CNT AS DOUBLE) AS ffs_beneficiary_denominator, suppressed_cell_count > 0 AS has_suppressed_cells
FROM raw_medicare"""


RELATIONS["medicare"] = _medicare()
_VINTAGE = """vintage, vintage::SMALLINT AS vintage_year, (vintage::SMALLINT - 4)::SMALLINT AS vintage_window_start,
  vintage::SMALLINT AS vintage_window_end, concat(vintage::INT - 4, '-', vintage) AS vintage_label, geo_level,
  state AS state_fips, county AS county_fips_3, CASE WHEN geo_level = 'county' THEN state || county END AS county_fips,
  name AS geography_name, coalesce(state = '26', false) AS is_michigan"""
RELATIONS["population"] = f"""
SELECT {_VINTAGE}, B01003_001E::BIGINT AS total_population, B25001_001E::BIGINT AS total_housing_units,
  CASE WHEN B01003_001M::BIGINT >= 0 THEN B01003_001M::BIGINT END AS total_population_margin,
  CASE WHEN B25001_001M::BIGINT >= 0 THEN B25001_001M::BIGINT END AS total_housing_units_margin,
  B01003_001M LIKE '-%' AS population_is_controlled_estimate, B25001_001M LIKE '-%' AS housing_units_is_controlled_estimate
FROM raw_population"""
RELATIONS["population_65"] = f"""
SELECT {_VINTAGE}, vintage >= '2017' AS population_65_plus_is_published,
  CASE WHEN vintage >= '2017' THEN S0101_C01_030E::BIGINT END AS population_65_plus,
  CASE WHEN vintage >= '2017' AND S0101_C01_030M NOT LIKE '-%' THEN S0101_C01_030M::BIGINT END AS population_65_plus_margin,
  vintage >= '2017' AND S0101_C01_030M LIKE '-%' AS is_controlled_estimate
FROM raw_population_65"""
RELATIONS["prices"] = f"""
SELECT trim(series_id) AS series_id, year::SMALLINT AS calendar_year, period AS period_code,
  CASE period[1] WHEN 'S' THEN 'semiannual' ELSE CASE period WHEN 'M13' THEN 'annual_average' ELSE 'month' END END AS period_kind,
  CASE WHEN period LIKE 'M%' AND period < 'M13' THEN period[2:3]::TINYINT END AS calendar_month,
  CASE WHEN period = 'M13' THEN year WHEN period LIKE 'M%' THEN year || '-' || period[2:3] END AS period_key,
  try_cast(trim(value) AS DOUBLE) AS index_value, trim(value) = '-' AS is_unavailable,
  nullif(trim(footnote_codes), '') AS footnote_codes, trim(series_id) = '{fixed.DEFLATOR_SERIES}' AS is_deflator_series,
  series_id[3] = 'S' AS is_seasonally_adjusted
FROM raw_prices"""
RELATIONS["price_series"] = """
SELECT trim(series_id) AS series_id, trim(area_code) AS area_code, trim(item_code) AS item_code, trim(periodicity_code) AS periodicity_code,
  trim(base_code) AS base_code, trim(base_period) AS base_period, trim(series_title) AS series_title, trim(begin_period) AS begin_period,
  trim(end_period) AS end_period, nullif(trim(footnote_codes), '') AS footnote_codes, begin_year::SMALLINT AS begin_year,
  end_year::SMALLINT AS end_year, seasonal AS seasonal_code, seasonal = 'S' AS is_seasonally_adjusted
FROM raw_price_series"""
RELATIONS["crosswalk"] = """
SELECT zip AS zip5, zip[1:3] AS zip3, geoid AS county_fips, city AS usps_city, state AS state_code, res_ratio::DOUBLE AS res_ratio,
  bus_ratio::DOUBLE AS bus_ratio, oth_ratio::DOUBLE AS oth_ratio, tot_ratio::DOUBLE AS tot_ratio,
  if(sum(res_ratio::DOUBLE) OVER z > 0, res_ratio, tot_ratio)::DOUBLE AS allocation_weight,
  if(sum(res_ratio::DOUBLE) OVER z > 0, 'res_ratio', 'tot_ratio') AS allocation_weight_source,
  sum(res_ratio::DOUBLE) OVER z = 0 AS zip_has_no_residential_addresses, length(geoid) = 5 AS has_full_county_fips, state = 'MI' AS is_michigan
FROM raw_crosswalk WINDOW z AS (PARTITION BY zip)"""

# ── intermediate ─────────────────────────────────────────────────────────────────────────
RELATIONS["weights"] = """
SELECT zip3, county_fips, weight_sum, weight_sum / sum(weight_sum) OVER p AS allocation_weight, count(*) OVER p AS counties_in_prefix
FROM (SELECT zip3, county_fips, sum(allocation_weight) AS weight_sum FROM crosswalk GROUP BY ALL HAVING weight_sum > 0)
WINDOW p AS (PARTITION BY zip3)"""
RELATIONS["placements"] = """
SELECT c.*, x.county_fips, x.allocation_weight AS w, 'full_zip' AS allocation_method
FROM complaints c JOIN crosswalk x ON x.zip5 = c.zip5 WHERE c.state_code IS NOT NULL
UNION ALL BY NAME
SELECT c.*, x.county_fips, x.allocation_weight AS w, 'zip3_prefix' AS allocation_method
FROM complaints c JOIN weights x ON x.zip3 = c.zip3 WHERE c.zip_mask_kind = 'prefix_masked' AND c.state_code IS NOT NULL
UNION ALL BY NAME
SELECT c.*, coalesce(s.state_fips, c.state_code) || '000' AS county_fips, 1.0::DOUBLE AS w,
  CASE WHEN s.state_fips IS NULL THEN 'state_without_fips' WHEN zip_mask_kind = 'full' THEN 'zip_not_in_crosswalk'
       WHEN zip_mask_kind = 'prefix_masked' THEN 'prefix_not_in_crosswalk' ELSE 'state_unassigned' END AS allocation_method
FROM complaints c LEFT JOIN states s ON s.state_code = c.state_code
WHERE c.state_code IS NOT NULL
  AND NOT (c.zip_mask_kind = 'full' AND EXISTS (SELECT 1 FROM crosswalk x WHERE x.zip5 = c.zip5))
  AND NOT (c.zip_mask_kind = 'prefix_masked' AND EXISTS (SELECT 1 FROM weights x WHERE x.zip3 = c.zip3))"""
RELATIONS["allocation"] = """
SELECT received_year_month, state_code, county_fips, product_family, allocation_method, sum(w) AS allocated_complaints,
  coalesce(sum(w) FILTER (is_timely_response AND NOT is_response_pending), 0) AS allocated_timely,
  coalesce(sum(w) FILTER (response_grants_relief), 0) AS allocated_relief,
  coalesce(sum(w) FILTER (is_response_pending), 0) AS allocated_pending,
  coalesce(sum(w) FILTER (has_tag_older_american), 0) AS allocated_older_american,
  count(*) AS source_complaints_before_allocation
FROM placements GROUP BY ALL"""
RELATIONS["matches"] = f"""
WITH filers AS (SELECT lei, arg_max(institution_name, activity_year) AS nm, arg_max(institution_name_normalized, activity_year) AS norm
                FROM institutions WHERE institution_name_normalized IS NOT NULL GROUP BY lei),
named AS (SELECT norm, count(*) AS leis, min(lei) AS lei, min(nm) AS nm FROM filers GROUP BY norm)
SELECT company_name, c.norm AS normalized_name, complaint_count, michigan_complaint_count,
  CASE leis WHEN 1 THEN lei END AS lei, CASE leis WHEN 1 THEN nm END AS institution_name,
  CASE WHEN c.norm IS NULL THEN 'unnormalizable' WHEN leis IS NULL THEN 'no_lei_found' WHEN leis = 1 THEN 'matched' ELSE 'ambiguous' END AS match_status,
  coalesce(leis, 0) AS candidate_lei_count, 'exact_normalized_name' AS match_method
FROM (SELECT company_name, {_normal('company_name')} AS norm, count(*) AS complaint_count, count(*) FILTER (state_code = 'MI') AS michigan_complaint_count
      FROM complaints WHERE company_name IS NOT NULL GROUP BY ALL) c LEFT JOIN named n ON n.norm = c.norm"""
_names = "source_column|service_code|measure_kind|is_standardized\n" + "\n".join(
    "|".join((c, s, k or "", str(z).lower())) for c, (s, k, z) in
    ((c, decode_measure(c)) for c in raw_tables.MEASURES))
RELATIONS["measures"] = f"""
SELECT YEAR::SMALLINT AS measure_year, YEAR AS period_key, 'year' AS period_grain, BENE_GEO_LVL AS geo_level, BENE_GEO_CD AS geo_code,
  BENE_GEO_DESC AS geo_description, CASE BENE_GEO_LVL WHEN 'County' THEN BENE_GEO_CD END AS county_fips,
  coalesce(BENE_GEO_LVL = 'County' AND BENE_GEO_CD LIKE '26%', false) AS is_michigan_county, BENE_AGE_LVL AS age_level,
  n.service_code, v.service_name, v.is_long_term_care::BOOLEAN AS is_long_term_care, n.measure_kind, n.is_standardized::BOOLEAN AS is_standardized,
  try_cast(raw_value AS DOUBLE) AS measure_value, raw_value = '*' AS is_suppressed, source_column
FROM (UNPIVOT raw_medicare ON {', '.join(raw_tables.MEASURES)} INTO NAME source_column VALUE raw_value)
JOIN ({_values(_names)}) n USING (source_column) LEFT JOIN seed_services v USING (service_code)"""

# ── marts ────────────────────────────────────────────────────────────────────────────────
RELATIONS["deflator"] = f"""
SELECT calendar_year AS y, index_value AS i, (SELECT index_value FROM prices WHERE is_deflator_series AND period_kind = 'annual_average'
  AND calendar_year = {PARAMS.deflator_base_year}) AS base
FROM prices WHERE is_deflator_series AND period_kind = 'annual_average'"""
RELATIONS["denominators"] = """
SELECT county_fips, vintage_year, total_population AS county_population, concat(vintage_window_start, '-', vintage_window_end) AS population_vintage_window,
  min(vintage_year) OVER () AS lo, max(vintage_year) OVER () AS hi
FROM population WHERE geo_level = 'county' AND total_population IS NOT NULL"""
RELATIONS["bounds"] = "SELECT min(lo) AS lo, max(hi) AS hi FROM denominators"
RELATIONS["claims_monthly"] = """
WITH cell AS (SELECT year_of_loss AS loss_year, loss_month, loss_year_month, state_code, county_fips, is_state_unknown, rated_flood_zone,
  flood_zone_current, occupancy_type, pre_firm_indicator, post_firm_construction_indicator, crs_class_code, count(*) AS claim_count,
  count(*) FILTER (is_closed_without_payment) AS closed_without_payment_count, count(*) FILTER (is_zero_paid) AS zero_paid_count,
  count(*) FILTER (NOT has_usable_county) AS no_county_count, sum(amount_paid_on_building_claim) AS paid_building,
  sum(amount_paid_on_contents_claim) AS paid_contents, sum(amount_paid_on_icc_claim) AS paid_icc, sum(total_amount_paid) AS paid_total,
  sum(total_net_payment) AS net_paid_total, sum(total_building_insurance_coverage)::BIGINT AS building_coverage,
  sum(total_contents_insurance_coverage)::BIGINT AS contents_coverage FROM claims GROUP BY ALL),
last AS (SELECT max(date_of_loss) AS d FROM claims)
SELECT cell.*, 'month:' || loss_year_month AS period_id, loss_year::VARCHAR AS loss_year_key, g.county_name, g.state_name,
  coalesce(g.is_michigan, false) AS is_michigan, paid_total::DOUBLE / claim_count AS avg_paid_per_claim,
  paid_total::DOUBLE * f.base / f.i AS paid_total_constant, paid_total::DOUBLE * f.base / f.i / claim_count AS avg_paid_per_claim_constant,
  loss_year < year(last.d) AS is_complete_loss_year, last.d >= make_date(loss_year + 1, 12, 31) AS is_development_mature,
  p.county_population, p.population_vintage_window, loss_year NOT BETWEEN b.lo AND b.hi AS population_is_extrapolated, claim_count < 10 AS is_small_cell
FROM cell CROSS JOIN last CROSS JOIN bounds b LEFT JOIN counties g ON g.county_fips = cell.county_fips LEFT JOIN deflator f ON f.y = loss_year
LEFT JOIN denominators p ON p.county_fips = cell.county_fips AND p.vintage_year = greatest(b.lo, least(b.hi, loss_year))"""
RELATIONS["claims_detail"] = """
SELECT claim_id, c.county_fips, g.county_name, has_usable_county, county_matches_reported_state, date_of_loss, year_of_loss AS loss_year, loss_month,
  loss_year_month, 'month:' || loss_year_month AS period_id, amount_paid_on_building_claim, amount_paid_on_contents_claim, amount_paid_on_icc_claim,
  total_amount_paid, total_net_payment, is_closed_without_payment, is_zero_paid, has_negative_payment,
  total_amount_paid::DOUBLE * f.base / f.i AS total_amount_paid_constant, rated_flood_zone, flood_zone_current, occupancy_type, crs_class_code,
  pre_firm_indicator, post_firm_construction_indicator, total_building_insurance_coverage, total_contents_insurance_coverage, reported_zip_code,
  open_date, most_recent_payment_date, (most_recent_payment_date - date_of_loss)::INT AS days_loss_to_last_payment,
  loss_month IN (3, 4, 5) AS is_spring_melt_season
FROM claims c LEFT JOIN counties g USING (county_fips) LEFT JOIN deflator f ON f.y = year_of_loss WHERE c.state_code = 'MI'"""
RELATIONS["in_force"] = """
SELECT m.d AS month_end, strftime(m.d, '%Y-%m') AS year_month, 'month:' || strftime(m.d, '%Y-%m') AS period_id, year(m.d)::SMALLINT AS calendar_year,
  p.county_fips, any_value(g.county_name) AS county_name, coalesce(any_value(g.is_michigan), false) AS is_michigan,
  sum(policy_count)::BIGINT AS policies_in_force, count(*) AS policy_records, sum(total_insurance_premium_of_the_policy)::BIGINT AS premium_in_force,
  sum(total_building_insurance_coverage)::BIGINT AS building_coverage_in_force, sum(total_contents_insurance_coverage)::BIGINT AS contents_coverage_in_force,
  sum(policy_cost) AS policy_cost_in_force, sum(policy_count)::BIGINT - count(*) AS policies_beyond_records, count(*) < 10 AS is_small_cell
FROM policies p JOIN (SELECT DISTINCT last_day(d) AS d FROM (SELECT unnest(generate_series((SELECT min(policy_effective_date) FROM policies),
    (SELECT max(as_of_date) FROM policies), INTERVAL 1 DAY))::DATE AS d)) m
  ON m.d >= p.policy_effective_date AND m.d < p.policy_termination_date AND m.d <= (SELECT max(as_of_date) FROM policies)
LEFT JOIN counties g ON g.county_fips = p.county_fips
WHERE NOT has_invalid_term GROUP BY m.d, p.county_fips"""
RELATIONS["disasters"] = """
SELECT disaster_number, min(fema_declaration_string) AS fema_declaration_string, min(declaration_type) AS declaration_type,
  min(declaration_title) AS declaration_title, min(incident_type) AS incident_type, min(declaration_date) AS declaration_date,
  min(incident_begin_date) AS incident_begin_date,
  CASE WHEN count(incident_end_date) = count(*) THEN max(incident_end_date) END AS incident_end_date,
  count(incident_end_date) < count(*) AS is_incident_open, bool_or(has_invalid_incident_window) AS has_invalid_incident_window,
  count(*) AS designated_area_count, count(DISTINCT county_fips) AS designated_county_count, count(*) FILTER (is_statewide) AS statewide_area_count,
  count(DISTINCT state_code) AS state_count, bool_or(is_flood_related) AS is_flood_related, bool_or(is_major_disaster) AS is_major_disaster,
  bool_or(state_code = 'MI') AS touches_michigan, bool_or(ia_program_declared) AS ia_program_declared, bool_or(pa_program_declared) AS pa_program_declared
FROM declarations GROUP BY disaster_number"""
RELATIONS["bridge"] = f"""
SELECT c.claim_id, c.county_fips, c.date_of_loss, c.year_of_loss AS loss_year, c.total_amount_paid, d.disaster_number, e.declaration_type,
  e.declaration_title, e.incident_begin_date, e.incident_end_date, e.incident_type, d.is_statewide AS matched_via_statewide_declaration,
  (e.incident_end_date - e.incident_begin_date)::INT AS incident_duration_days, (c.date_of_loss - e.incident_begin_date)::INT AS days_into_incident,
  c.date_of_loss > e.incident_end_date AS is_in_grace_window, {PARAMS.event_grace_days} AS grace_window_days
FROM claims c JOIN declarations d ON d.state_code = 'MI' AND (d.is_statewide OR d.county_fips = c.county_fips)
JOIN disasters e ON e.disaster_number = d.disaster_number AND e.is_flood_related
WHERE c.state_code = 'MI' AND c.date_of_loss BETWEEN e.incident_begin_date
  AND coalesce(e.incident_end_date, DATE '{PARAMS.as_of}') + {PARAMS.event_grace_days}"""


def _outcomes(unspecified: bool) -> str:
    extra = "count(*) FILTER (response_family IN ('relief_unspecified', 'closed_unspecified')) AS relief_unspecified_count," if unspecified else ""
    return f"""count(*) AS complaint_count, count(*) FILTER (NOT is_response_pending) AS closed_complaints,
  count(*) FILTER (is_response_pending) AS pending_complaints, count(*) FILTER (is_timely_response AND NOT is_response_pending) AS timely_count,
  count(*) FILTER (response_grants_relief) AS relief_count, count(*) FILTER (response_family = 'monetary_relief') AS monetary_relief_count,
  count(*) FILTER (response_family = 'non_monetary_relief') AS non_monetary_relief_count, {extra}
  count(*) FILTER (response_family = 'untimely') AS untimely_count, count(*) FILTER (has_tag_older_american) AS older_american_count,
  count(*) FILTER (has_tag_servicemember) AS servicemember_count, count(*) FILTER (has_narrative) AS narrative_count,
  CASE WHEN closed_complaints > 0 THEN 100.0::DOUBLE * timely_count / closed_complaints END AS timely_rate_pct,
  CASE WHEN closed_complaints > 0 THEN 100.0::DOUBLE * relief_count / closed_complaints END AS relief_rate_pct, complaint_count < 10 AS is_small_cell"""


RELATIONS["complaints_daily"] = f"""
SELECT date_received, strftime(date_received, '%Y-%m') AS year_month, 'month:' || strftime(date_received, '%Y-%m') AS period_id,
  year(date_received)::SMALLINT AS received_year, quarter(date_received)::TINYINT AS received_quarter, c.state_code, s.state_name,
  coalesce(s.is_michigan, false) AS is_michigan, s.census_division_name, product_family, product, sub_product, issue, sub_issue, {_outcomes(False)}
FROM complaints c LEFT JOIN states s USING (state_code) WHERE c.state_code IS NOT NULL GROUP BY ALL"""
RELATIONS["complaints_company"] = f"""
SELECT received_year_month AS year_month, 'month:' || received_year_month AS period_id, received_year_month[1:4]::SMALLINT AS received_year, c.state_code,
  coalesce(s.is_michigan, false) AS is_michigan, company_name, product_family, {_outcomes(True)}
FROM complaints c LEFT JOIN states s USING (state_code) WHERE c.state_code IS NOT NULL GROUP BY ALL"""
RELATIONS["complaints_geo"] = """
SELECT received_year_month AS year_month, 'month:' || received_year_month AS period_id, received_year_month[1:4]::SMALLINT AS received_year, a.state_code,
  a.county_fips, g.county_name, coalesce(g.is_michigan, false) AS is_michigan, g.geography_kind, product_family, allocation_method,
  allocated_complaints, allocated_timely, allocated_relief, allocated_pending, allocated_older_american, p.county_population, p.population_vintage_window,
  received_year_month[1:4]::SMALLINT NOT BETWEEN b.lo AND b.hi AS population_is_extrapolated,
  CASE WHEN p.county_population > 0 THEN 100000.0::DOUBLE * allocated_complaints / p.county_population END AS complaints_per_100k,
  allocated_complaints < 10 AS is_small_cell
FROM allocation a LEFT JOIN counties g ON g.county_fips = a.county_fips CROSS JOIN bounds b LEFT JOIN denominators p
  ON p.county_fips = a.county_fips AND p.vintage_year = greatest(b.lo, least(b.hi, received_year_month[1:4]::SMALLINT))"""
RELATIONS["publication"] = f"""
WITH m AS (SELECT received_year_month AS ym, min(date_received) AS a, max(date_received) AS z, count(*) AS n, count(*) FILTER (is_response_pending) AS pending,
  100.0::DOUBLE * count(*) FILTER (is_response_pending) / count(*) AS share FROM complaints WHERE received_year_month IS NOT NULL GROUP BY ALL)
SELECT ym AS year_month, 'month:' || ym AS period_id, a AS first_received, z AS last_received, n AS complaint_count, pending AS pending_count,
  round(share, 4) AS pending_pct, strftime(max(z) OVER (), '%Y-%m') > ym AS is_calendar_month_over, share < {PARAMS.pending_threshold_pct} AS is_publication_complete,
  {PARAMS.pending_threshold_pct}::DOUBLE AS pending_threshold_pct, ym = max(ym) FILTER (share < {PARAMS.pending_threshold_pct}) OVER () AS is_latest_complete_month
FROM m"""
RELATIONS["lending_annual"] = f"""
SELECT l.activity_year::SMALLINT AS activity_year, 'year:' || l.activity_year AS period_id, l.county_fips, g.county_name,
  coalesce(g.is_michigan, false) AS is_michigan, has_no_reported_county, l.lei, i.institution_name, loan_purpose_label, loan_type_label, lien_status_label,
  occupancy_type_label, construction_method_label, applicant_age_band, applicant_race_label, applicant_ethnicity_label, applicant_sex_label, dti_band,
  denial_reason_1_label,
  CASE WHEN income IS NULL OR ffiec_msa_md_median_family_income IS NULL THEN NULL WHEN income * 100000 / ffiec_msa_md_median_family_income < 50 THEN 'low'
    WHEN income * 100000 / ffiec_msa_md_median_family_income < 80 THEN 'moderate' WHEN income * 100000 / ffiec_msa_md_median_family_income < 120 THEN 'middle'
    ELSE 'upper' END AS applicant_income_bracket, count(*) AS application_count,
  {', '.join(f"count(*) FILTER (action_taken IN {_in(codes)}) AS {name}" for name, codes in ACTION_GROUPS.items())},
  sum(loan_amount) FILTER (action_taken = '1') AS originated_amount, sum(loan_amount) AS application_amount,
  median(loan_amount) FILTER (action_taken = '1') AS median_originated_amount, median(income) FILTER (action_taken = '1') AS median_applicant_income,
  count(*) FILTER (is_partially_exempt) AS partially_exempt_count, count(denial_reason_2_label) AS has_secondary_denial_reason,
  CASE WHEN decided_applications > 0 THEN 100.0::DOUBLE * denied_count / decided_applications END AS denial_rate_pct, count(*) < 10 AS is_small_cell
FROM lending l LEFT JOIN counties g ON g.county_fips = l.county_fips LEFT JOIN institutions i ON i.lei = l.lei AND i.activity_year = l.activity_year
GROUP BY ALL"""
RELATIONS["match_rate"] = """
WITH t AS (SELECT count(*) AS n, sum(complaint_count)::BIGINT AS c, sum(michigan_complaint_count)::BIGINT AS f, count(*) FILTER (match_status = 'matched') AS mn,
  (sum(complaint_count) FILTER (match_status = 'matched'))::BIGINT AS mc, (sum(michigan_complaint_count) FILTER (match_status = 'matched'))::BIGINT AS mf,
  count(*) FILTER (match_status = 'ambiguous') AS amb FROM matches)
SELECT r.*, round(100.0::DOUBLE * matched / nullif(total, 0), 2) AS coverage_pct FROM (
  SELECT 'company_names' AS coverage_basis, mn AS matched, n AS total, 'Company names that found exactly one lender.' AS interpretation FROM t
  UNION ALL SELECT 'complaints_national', mc, c, 'Complaints of matched companies.' FROM t
  UNION ALL SELECT 'complaints_michigan', mf, f, 'Focus-state complaints of matched companies.' FROM t
  UNION ALL SELECT 'ambiguous_names', amb, n, 'Names shared by several lenders, left unmatched.' FROM t) r"""
RELATIONS["indicators"] = """
SELECT cycle_key, 'survey_cycle:' || cycle_key AS period_id, year_start, year_end, period_grain, spans_multiple_years, location_abbr, location_desc,
  location_kind, is_michigan, c.class_id, class, topic, question_id, question, i.indicator_family, i.short_label,
  i.higher_is_better::BOOLEAN AS higher_is_better, is_cognitive_decline, is_caregiving, coalesce(i.indicator_family = 'screening', false) AS is_screening,
  stratification_1 AS age_group, coalesce(stratification_2, 'Overall') AS stratification, coalesce(stratification_category_2, 'Overall') AS stratification_category,
  is_overall_age_group, is_unstratified_second_dimension, data_value_type, data_value_unit, data_value, low_confidence_limit, high_confidence_limit,
  is_suppressed, has_confidence_interval, footnote_symbol, CAST(NULL AS VARCHAR) AS footnote_text,
  footnote_symbol IS NOT DISTINCT FROM '**' AS is_not_comparable_pre_2019, footnote_symbol IS NOT DISTINCT FROM '#' AS is_fewer_than_50_states_reporting,
  footnote_symbol IS NOT DISTINCT FROM '&' AS is_regional_estimate
FROM cells c LEFT JOIN seed_indicators i USING (question_id)"""
RELATIONS["pairs"] = """
SELECT cycle_key, question_id, age_group, stratification, max(year_start) AS year_start, max(year_end) AS year_end,
  bool_or(spans_multiple_years) AS spans_multiple_years, max(question) AS question, max(class_id) AS class_id, max(class) AS class,
  max(indicator_family) AS indicator_family, max(short_label) AS short_label, bool_or(higher_is_better) AS higher_is_better,
  bool_or(is_cognitive_decline) AS is_cognitive_decline, bool_or(is_caregiving) AS is_caregiving, bool_or(is_screening) AS is_screening,
  bool_or(is_unstratified_second_dimension) AS is_unstratified_second_dimension,
  max(CASE WHEN location_abbr = 'MI' THEN data_value END) AS mi_value, max(CASE WHEN location_abbr = 'MI' THEN low_confidence_limit END) AS mi_low,
  max(CASE WHEN location_abbr = 'MI' THEN high_confidence_limit END) AS mi_high, max(CASE WHEN location_abbr = 'US' THEN data_value END) AS national_value,
  max(CASE WHEN location_abbr = 'US' THEN low_confidence_limit END) AS national_low, max(CASE WHEN location_abbr = 'US' THEN high_confidence_limit END) AS national_high,
  count(*) FILTER (location_abbr = 'MI' AND is_not_comparable_pre_2019) > 0 AS mi_not_comparable_pre_2019,
  count(*) FILTER (location_abbr = 'US' AND is_not_comparable_pre_2019) > 0 AS national_not_comparable_pre_2019,
  count(*) FILTER (location_abbr = 'US' AND is_fewer_than_50_states_reporting) > 0 AS national_fewer_than_50_states
FROM indicators WHERE location_abbr IN ('MI', 'US') GROUP BY ALL"""
RELATIONS["versus"] = """
SELECT * EXCLUDE (pl, ph, pb, prior_ok),
  CASE WHEN NOT is_comparable THEN 'not comparable' WHEN intervals_overlap THEN 'no significant difference'
    WHEN gap_to_national > 0 THEN 'MI higher' ELSE 'MI lower' END AS significance,
  CASE WHEN NOT is_comparable THEN 'not comparable' WHEN intervals_overlap THEN 'no significant difference'
    WHEN higher_is_better IS NOT NULL THEN if((gap_to_national > 0) = higher_is_better, 'MI better', 'MI worse') END AS benchmark_verdict,
  CASE WHEN prior_ok AND NOT spans_multiple_years THEN mi_value - mi_prior_value END AS mi_change_from_prior,
  CASE WHEN NOT spans_multiple_years THEN CASE
    WHEN NOT prior_ok OR mi_low IS NULL OR mi_high IS NULL OR pl IS NULL OR ph IS NULL THEN 'not comparable'
    WHEN mi_low <= ph AND pl <= mi_high THEN 'no significant change'
    WHEN higher_is_better IS NOT NULL THEN if((mi_value > mi_prior_value) = higher_is_better, 'improving', 'deteriorating') END END AS mi_direction
FROM (SELECT *, 'survey_cycle:' || cycle_key AS period_id, mi_value - national_value AS gap_to_national,
    mi_value IS NOT NULL AND national_value IS NOT NULL AND mi_low IS NOT NULL AND mi_high IS NOT NULL
      AND national_low IS NOT NULL AND national_high IS NOT NULL AS is_comparable,
    NOT (mi_low > national_high OR national_low > mi_high) AS intervals_overlap,
    lag(cycle_key) OVER w AS prior_cycle_key, lag(mi_value) OVER w AS mi_prior_value, lag(mi_low) OVER w AS pl, lag(mi_high) OVER w AS ph,
    lag(mi_not_comparable_pre_2019) OVER w AS pb,
    mi_value IS NOT NULL AND mi_prior_value IS NOT NULL AND NOT mi_not_comparable_pre_2019 AND NOT coalesce(pb, true) AS prior_ok
  FROM pairs WINDOW w AS (PARTITION BY question_id, age_group, stratification ORDER BY spans_multiple_years, year_end, cycle_key))"""
RELATIONS["cost"] = f"""
WITH c AS (SELECT * FROM measures WHERE service_code = 'TOT' AND measure_kind = 'per_capita' AND is_standardized AND geo_level IN ('State', 'National'))
SELECT c.measure_year, c.period_key, 'year:' || c.period_key AS period_id, c.period_grain, c.geo_level, c.geo_code, c.geo_description, s.state_name,
  c.geo_level = 'State' AND c.geo_code IS NOT NULL AS is_jurisdiction, coalesce(c.geo_code = '26', false) AS is_michigan, c.age_level,
  c.measure_value AS cost_per_capita, n.measure_value AS national_cost_per_capita, cost_per_capita - national_cost_per_capita AS gap_to_national,
  cost_per_capita * f.base / f.i AS cost_per_capita_constant, national_cost_per_capita * f.base / f.i AS national_cost_per_capita_constant,
  (cost_per_capita - national_cost_per_capita) * f.base / f.i AS gap_to_national_constant, {PARAMS.deflator_base_year} AS constant_dollar_base_year,
  e.ma_participation_rate, e.ffs_beneficiary_denominator, e.benes_total_cnt, e.bene_avg_age, e.bene_dual_eligible_pct, c.is_suppressed
FROM c LEFT JOIN c n ON n.geo_level = 'National' AND n.measure_year = c.measure_year AND n.age_level = c.age_level
LEFT JOIN medicare e ON e.measure_year = c.measure_year AND e.geo_level = c.geo_level AND e.age_level = c.age_level AND e.geo_description = c.geo_description
LEFT JOIN deflator f ON f.y = c.measure_year LEFT JOIN states s ON s.state_fips = c.geo_code"""
RELATIONS["services"] = """
WITH m AS (SELECT * FROM measures WHERE age_level = 'All' AND is_michigan_county)
SELECT m.measure_year, m.period_key, 'year:' || m.period_key AS period_id, m.period_grain, m.county_fips, g.county_name, m.geo_description AS cms_county_label,
  coalesce(g.is_michigan, false) AS is_michigan, coalesce(e.is_unassigned_county, false) AS is_unassigned_county, m.age_level, m.service_code, m.service_name,
  m.is_long_term_care, m.measure_kind, m.is_standardized, m.source_column, m.measure_value AS county_value, n.measure_value AS national_value,
  CASE WHEN m.measure_kind NOT IN ('amount', 'user_count') AND n.measure_value > 0 AND NOT m.is_suppressed THEN m.measure_value / n.measure_value END AS ratio_to_national,
  CASE WHEN m.measure_kind NOT IN ('amount', 'user_count') AND NOT m.is_suppressed THEN m.measure_value - n.measure_value END AS gap_to_national,
  m.is_suppressed, NOT m.is_suppressed AND coalesce(m.measure_value = 0, false) AS is_true_zero, coalesce(n.is_suppressed, false) AS national_is_suppressed,
  k.s AS service_suppressed_cells, round(k.share, 2) AS service_suppressed_pct, k.share >= 33 AS is_small_cell_service, e.ma_participation_rate, e.ffs_beneficiary_denominator
FROM m LEFT JOIN measures n ON n.geo_level = 'National' AND n.age_level = 'All' AND n.measure_year = m.measure_year AND n.source_column = m.source_column
LEFT JOIN (SELECT source_column, count(*) FILTER (is_suppressed) AS s, 100.0::DOUBLE * count(*) FILTER (is_suppressed) / count(*) AS share FROM m GROUP BY ALL) k
  ON k.source_column = m.source_column
LEFT JOIN medicare e ON e.is_county_row AND e.is_all_ages AND e.measure_year = m.measure_year AND e.county_fips = m.county_fips
LEFT JOIN counties g ON g.county_fips = m.county_fips"""
RELATIONS["elderly"] = """
WITH p AS (SELECT * FROM population_65 WHERE geo_level = 'county' AND is_michigan AND population_65_plus_is_published),
v AS (SELECT vintage_year, vintage_window_start > lag(vintage_window_end) OVER (ORDER BY vintage_year) AS apart
      FROM (SELECT DISTINCT vintage_year, vintage_window_start, vintage_window_end FROM p))
SELECT p.vintage, 'year:' || p.vintage AS period_id, p.vintage_year, p.vintage_window_start, p.vintage_window_end, p.vintage_label, p.county_fips,
  coalesce(g.county_name, p.geography_name) AS county_name, coalesce(g.is_michigan, false) AS is_michigan, p.population_65_plus, p.population_65_plus_margin,
  p.is_controlled_estimate, (sum(population_65_plus) OVER t)::BIGINT AS state_population_65_plus, count(*) OVER t AS counties_reporting,
  CASE WHEN sum(population_65_plus) OVER t > 0 THEN 100.0::DOUBLE * population_65_plus / (sum(population_65_plus) OVER t)::BIGINT END AS county_share_of_state_pct,
  coalesce(v.apart, false) AS is_non_overlapping_with_prior
FROM p JOIN v ON v.vintage_year = p.vintage_year LEFT JOIN counties g ON g.county_fips = p.county_fips WINDOW t AS (PARTITION BY p.vintage_year)"""
RELATIONS["need"] = f"""
WITH e AS (SELECT DISTINCT vintage_year AS y, vintage_window_start AS a, vintage_window_end AS z, state_population_65_plus AS n FROM elderly),
g AS (SELECT f.y AS from_vintage, t.y AS to_vintage, concat(f.a, '-', f.z) AS population_window_from, concat(t.a, '-', t.z) AS population_window_to,
  f.n AS population_from, t.n AS population_to, t.n - f.n AS population_change, CASE WHEN f.n > 0 THEN 100.0::DOUBLE * (t.n - f.n) / f.n END AS population_change_pct,
  t.a > f.z AS windows_are_non_overlapping
  FROM e f JOIN e t ON f.y = {PARAMS.growth_from_vintage} AND t.y = {PARAMS.growth_to_vintage}),
i AS (SELECT question_id, any_value(question) AS question, any_value(class_id) AS class_id, any_value(indicator_family) AS indicator_family,
  any_value(short_label) AS short_label, bool_or(higher_is_better) AS higher_is_better, age_group, min(year_end) AS y0, max(year_end) AS y1,
  arg_min(cycle_key, year_end) AS indicator_from_cycle, arg_max(cycle_key, year_end) AS indicator_to_cycle,
  arg_min(mi_value, year_end) AS indicator_from_value, arg_max(mi_value, year_end) AS indicator_to_value, arg_min(mi_low, year_end) AS l0, arg_min(mi_high, year_end) AS h0,
  arg_max(mi_low, year_end) AS l1, arg_max(mi_high, year_end) AS h1,
  arg_min(mi_not_comparable_pre_2019, year_end) OR arg_max(mi_not_comparable_pre_2019, year_end) AS straddles_2019_break, count(*) AS cycles_available
  FROM versus WHERE is_unstratified_second_dimension AND NOT spans_multiple_years AND mi_value IS NOT NULL
    AND indicator_family IN ('screening', 'caregiving', 'cognitive_decline') GROUP BY question_id, age_group),
r AS (SELECT i.*, g.*, CASE WHEN cycles_available < 2 OR straddles_2019_break OR l0 IS NULL OR h0 IS NULL OR l1 IS NULL OR h1 IS NULL THEN 'not comparable'
    WHEN l1 <= h0 AND l0 <= h1 THEN 'no significant change'
    WHEN higher_is_better IS NOT NULL THEN if((indicator_to_value > indicator_from_value) = higher_is_better, 'improving', 'deteriorating') END AS indicator_direction
  FROM i CROSS JOIN g)
SELECT * EXCLUDE (y0, y1, l0, l1, h0, h1), concat(y0, '-', y1) AS indicator_window, indicator_to_value - indicator_from_value AS indicator_change_pp,
  population_window_from = indicator_from_cycle AND population_window_to = indicator_to_cycle AS windows_are_aligned,
  CASE WHEN indicator_direction IS NULL THEN NULL WHEN indicator_direction = 'not comparable' OR population_change_pct IS NULL THEN 'not comparable'
    WHEN population_change_pct <= 0 THEN 'need not growing' WHEN indicator_direction = 'improving' THEN 'capacity keeping pace'
    ELSE 'need outpacing capacity' END AS need_vs_capacity_verdict
FROM r"""


def _mentions(sql: str) -> set[str]:
    return set(re.findall(r"(?:FROM|JOIN|UNPIVOT)\s+\(*([a-z_0-9]+)", sql)) & RELATIONS.keys()


def _ordered(names: set[str]) -> list[str]:
    done: list[str] = []

    def visit(name: str) -> None:
        if name not in done:
            for other in sorted(_mentions(RELATIONS[name]) - {name}):
                visit(other)
            done.append(name)

    for name in sorted(names):
        visit(name)
    return done


def query(body: str) -> str:
    """A statement over the relations its text reads."""
    used = _ordered(_mentions(body))
    if not used:
        return body
    ctes = ",\n".join(f"{name} AS ({RELATIONS[name]})" for name in used)
    own = body.lstrip()
    if own.startswith("WITH "):
        return f"WITH {ctes},\n{own.removeprefix('WITH ')}"
    return f"WITH {ctes}\n{body}"
