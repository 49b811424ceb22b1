"""Contracts of the dimensions and marts: column names and types, and what each table and column means.

``sinks.save_table`` refuses a frame that breaks the contract of its table, and stores the
descriptions with the table, where the data dictionary finds them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Each table, its meaning, its columns and their types.
TABLES = """\
conformed.dim_date: One row per day.
  date_day date, date_key int, calendar_year smallint, calendar_quarter tinyint, calendar_month tinyint, month_name
  string, year_month string, year_quarter string, month_start date, month_end date, quarter_start date, year_start
  date, day_of_year smallint, iso_day_of_week tinyint, day_name string, iso_week tinyint, is_weekend boolean,
  is_month_end boolean
conformed.dim_period: Every period that a fact may name, by grain.
  period_id string, grain string, period_key string, period_start date, period_end date, period_label string,
  calendar_year smallint, spans_multiple_years boolean
conformed.dim_state: States, the district and territories.
  state_code string, state_fips string, state_name string, entity_type string, census_region string,
  census_region_name string, census_division string, census_division_name string, is_us_jurisdiction boolean,
  is_michigan boolean
conformed.dim_geography_county: Every county code that any source names.
  county_fips string, state_fips string, county_fips_3 string, state_code string, state_name string, county_name
  string, county_name_full string, geography_kind string, is_reportable_county boolean, is_michigan boolean,
  first_vintage string, last_vintage string, is_current_vintage boolean, geography_note string
mart_ins.dim_ins_disaster_declaration: One row per declared disaster.
  disaster_number int, fema_declaration_string string, declaration_type string, declaration_title string,
  incident_type string, declaration_date date, incident_begin_date date, incident_end_date date, is_incident_open
  boolean, has_invalid_incident_window boolean, designated_area_count bigint, designated_county_count bigint,
  statewide_area_count bigint, state_count bigint, is_flood_related boolean, is_major_disaster boolean,
  touches_michigan boolean, ia_program_declared boolean, pa_program_declared boolean
mart_ins.fct_ins_claims_monthly: Flood claims by month of loss, county and traits of the building.
  loss_year int, loss_month tinyint, loss_year_month string, period_id string, loss_year_key string, state_code
  string, county_fips string, county_name string, state_name string, is_michigan boolean, is_state_unknown boolean,
  rated_flood_zone string, flood_zone_current string, occupancy_type int, pre_firm_indicator boolean,
  post_firm_construction_indicator boolean, crs_class_code int, claim_count bigint, closed_without_payment_count
  bigint, zero_paid_count bigint, no_county_count bigint, paid_building decimal(38,2), paid_contents decimal(38,2),
  paid_icc decimal(38,2), paid_total decimal(38,2), net_paid_total decimal(38,2), building_coverage bigint,
  contents_coverage bigint, avg_paid_per_claim double, paid_total_constant double, avg_paid_per_claim_constant double,
  is_complete_loss_year boolean, is_development_mature boolean, county_population bigint, population_vintage_window
  string, population_is_extrapolated boolean, is_small_cell boolean
mart_ins.fct_ins_claims_detail_mi: Flood claims of the focus state, one by one.
  claim_id string, county_fips string, county_name string, has_usable_county boolean, county_matches_reported_state
  boolean, date_of_loss date, loss_year int, loss_month tinyint, loss_year_month string, period_id string,
  amount_paid_on_building_claim decimal(12,2), amount_paid_on_contents_claim decimal(12,2), amount_paid_on_icc_claim
  decimal(12,2), total_amount_paid decimal(14,2), total_net_payment decimal(14,2), is_closed_without_payment boolean,
  is_zero_paid boolean, has_negative_payment boolean, total_amount_paid_constant double, rated_flood_zone string,
  flood_zone_current string, occupancy_type int, crs_class_code int, pre_firm_indicator boolean,
  post_firm_construction_indicator boolean, total_building_insurance_coverage bigint,
  total_contents_insurance_coverage bigint, reported_zip_code string, open_date date, most_recent_payment_date date,
  days_loss_to_last_payment int, is_spring_melt_season boolean
mart_ins.fct_ins_policies_mi_monthly: Policies of the focus state in force at each month's end.
  month_end date, year_month string, period_id string, calendar_year smallint, county_fips string, county_name string,
  is_michigan boolean, policies_in_force bigint, policy_records bigint, premium_in_force bigint,
  building_coverage_in_force bigint, contents_coverage_in_force bigint, policy_cost_in_force decimal(38,2),
  policies_beyond_records bigint, is_small_cell boolean
mart_ins.bridge_ins_claim_declaration: Which claims fall inside which flood disaster.
  claim_id string, county_fips string, date_of_loss date, loss_year int, total_amount_paid decimal(14,2),
  disaster_number int, declaration_type string, declaration_title string, incident_begin_date date, incident_end_date
  date, incident_type string, matched_via_statewide_declaration boolean, incident_duration_days int,
  days_into_incident int, is_in_grace_window boolean, grace_window_days int
mart_ins.rpt_ins_reconciliation: Counts of the insurance sources from publisher to mart.
  source_name string, measure_label string, publisher_figure bigint, rows_landing bigint, rows_raw bigint, rows_duckdb
  bigint, rows_staged bigint, rows_in_mart bigint, publisher_to_landing_gap bigint, warehouse_to_mart_gap bigint,
  retrieved_at string, source_last_refresh string, source_metadata_refresh string, interpretation string
mart_fin.fct_fin_complaints_monthly_geo: Complaints by month, county and product family, shared out by residences.
  year_month string, period_id string, received_year smallint, state_code string, county_fips string, county_name
  string, is_michigan boolean, geography_kind string, product_family string, allocation_method string,
  allocated_complaints double, allocated_timely double, allocated_relief double, allocated_pending double,
  allocated_older_american double, county_population bigint, population_vintage_window string,
  population_is_extrapolated boolean, complaints_per_100k double, is_small_cell boolean
mart_fin.fct_fin_complaints_monthly_company: Complaints by month, state, company and product family.
  year_month string, period_id string, received_year smallint, state_code string, is_michigan boolean, company_name
  string, product_family string, complaint_count bigint, closed_complaints bigint, pending_complaints bigint,
  timely_count bigint, relief_count bigint, monetary_relief_count bigint, non_monetary_relief_count bigint,
  relief_unspecified_count bigint, untimely_count bigint, older_american_count bigint, servicemember_count bigint,
  narrative_count bigint, timely_rate_pct double, relief_rate_pct double, is_small_cell boolean
mart_fin.fct_fin_complaints_daily_state: Complaints by day, state and taxonomy.
  date_received date, year_month string, period_id string, received_year smallint, received_quarter tinyint,
  state_code string, state_name string, is_michigan boolean, census_division_name string, product_family string,
  product string, sub_product string, issue string, sub_issue string, complaint_count bigint, closed_complaints
  bigint, pending_complaints bigint, timely_count bigint, relief_count bigint, monetary_relief_count bigint,
  non_monetary_relief_count bigint, untimely_count bigint, older_american_count bigint, servicemember_count bigint,
  narrative_count bigint, timely_rate_pct double, relief_rate_pct double, is_small_cell boolean
mart_fin.rpt_fin_publication_window: Which months of complaints are complete.
  year_month string, period_id string, first_received date, last_received date, complaint_count bigint, pending_count
  bigint, pending_pct double, is_calendar_month_over boolean, is_publication_complete boolean, pending_threshold_pct
  double, is_latest_complete_month boolean
mart_fin.fct_fin_hmda_annual: Loan applications by year, county, lender and traits.
  activity_year smallint, period_id string, county_fips string, county_name string, is_michigan boolean,
  has_no_reported_county boolean, lei string, institution_name string, loan_purpose_label string, loan_type_label
  string, lien_status_label string, occupancy_type_label string, construction_method_label string, applicant_age_band
  string, applicant_race_label string, applicant_ethnicity_label string, applicant_sex_label string, dti_band string,
  denial_reason_1_label string, applicant_income_bracket string, application_count bigint, decided_applications
  bigint, originated_count bigint, approved_not_accepted_count bigint, denied_count bigint, withdrawn_count bigint,
  closed_incomplete_count bigint, purchased_count bigint, preapproval_count bigint, originated_amount double,
  application_amount double, median_originated_amount double, median_applicant_income double, partially_exempt_count
  bigint, has_secondary_denial_reason bigint, denial_rate_pct double, is_small_cell boolean
mart_fin.rpt_fin_entity_match_rate: How many companies and complaints found their lender.
  coverage_basis string, matched bigint, total bigint, coverage_pct double, interpretation string
mart_hlt.fct_hlt_cdc_indicators: Health indicators as published, typed.
  cycle_key string, period_id string, year_start smallint, year_end smallint, period_grain string,
  spans_multiple_years boolean, location_abbr string, location_desc string, location_kind string, is_michigan boolean,
  class_id string, class string, topic string, question_id string, question string, indicator_family string,
  short_label string, higher_is_better boolean, is_cognitive_decline boolean, is_caregiving boolean, is_screening
  boolean, age_group string, stratification string, stratification_category string, is_overall_age_group boolean,
  is_unstratified_second_dimension boolean, data_value_type string, data_value_unit string, data_value double,
  low_confidence_limit double, high_confidence_limit double, is_suppressed boolean, has_confidence_interval boolean,
  footnote_symbol string, footnote_text string, is_not_comparable_pre_2019 boolean, is_fewer_than_50_states_reporting
  boolean, is_regional_estimate boolean
mart_hlt.fct_hlt_cdc_mi_vs_national: The focus state beside the nation, with what chance allows to say.
  cycle_key string, period_id string, year_start smallint, year_end smallint, spans_multiple_years boolean,
  question_id string, question string, class_id string, class string, indicator_family string, short_label string,
  higher_is_better boolean, is_cognitive_decline boolean, is_caregiving boolean, is_screening boolean, age_group
  string, stratification string, is_unstratified_second_dimension boolean, mi_value double, mi_low double, mi_high
  double, national_value double, national_low double, national_high double, gap_to_national double,
  national_fewer_than_50_states boolean, mi_not_comparable_pre_2019 boolean, national_not_comparable_pre_2019 boolean,
  is_comparable boolean, intervals_overlap boolean, significance string, benchmark_verdict string, prior_cycle_key
  string, mi_prior_value double, mi_change_from_prior double, mi_direction string
mart_hlt.fct_hlt_medicare_cost_annual: Medicare cost per beneficiary by year and place.
  measure_year smallint, period_key string, period_id string, period_grain string, geo_level string, geo_code string,
  geo_description string, state_name string, is_jurisdiction boolean, is_michigan boolean, age_level string,
  cost_per_capita double, national_cost_per_capita double, gap_to_national double, cost_per_capita_constant double,
  national_cost_per_capita_constant double, gap_to_national_constant double, constant_dollar_base_year int,
  ma_participation_rate double, ffs_beneficiary_denominator double, benes_total_cnt double, bene_avg_age double,
  bene_dual_eligible_pct double, is_suppressed boolean
mart_hlt.fct_hlt_medicare_service_county: Medicare service measures of counties beside the nation.
  measure_year smallint, period_key string, period_id string, period_grain string, county_fips string, county_name
  string, cms_county_label string, is_michigan boolean, is_unassigned_county boolean, age_level string, service_code
  string, service_name string, is_long_term_care boolean, measure_kind string, is_standardized boolean, source_column
  string, county_value double, national_value double, ratio_to_national double, gap_to_national double, is_suppressed
  boolean, is_true_zero boolean, national_is_suppressed boolean, service_suppressed_cells bigint,
  service_suppressed_pct double, is_small_cell_service boolean, ma_participation_rate double,
  ffs_beneficiary_denominator double
mart_hlt.fct_hlt_mi_population_65_plus: People of 65 and over by county and vintage.
  vintage string, period_id string, vintage_year smallint, vintage_window_start smallint, vintage_window_end smallint,
  vintage_label string, county_fips string, county_name string, is_michigan boolean, population_65_plus bigint,
  population_65_plus_margin bigint, is_controlled_estimate boolean, state_population_65_plus bigint,
  counties_reporting bigint, county_share_of_state_pct double, is_non_overlapping_with_prior boolean
mart_hlt.rpt_hlt_need_vs_capacity: Change of the older population beside change of an indicator.
  question_id string, question string, class_id string, indicator_family string, short_label string, higher_is_better
  boolean, age_group string, from_vintage smallint, to_vintage smallint, population_window_from string,
  population_window_to string, population_from bigint, population_to bigint, population_change bigint,
  population_change_pct double, windows_are_non_overlapping boolean, indicator_from_cycle string, indicator_to_cycle
  string, indicator_window string, cycles_available bigint, indicator_from_value double, indicator_to_value double,
  indicator_change_pp double, straddles_2019_break boolean, indicator_direction string, windows_are_aligned boolean,
  need_vs_capacity_verdict string
"""

#: What a column means, the same in every table that has it.
MEANINGS = """\
date_day: the day
date_key: the day as yyyymmdd
calendar_year: calendar year
calendar_quarter: quarter of the year, 1 to 4
calendar_month: month of the year, 1 to 12
month_name: English name of the month
year_month: month as yyyy-MM
year_quarter: quarter as yyyy-Qn
month_start: first day of the month
month_end: last day of the month
quarter_start: first day of the quarter
year_start: first day of the year
day_of_year: day of the year, from 1
iso_day_of_week: day of the week, Monday is 1
day_name: English name of the day
iso_week: ISO week of the year
is_weekend: Saturday or Sunday
is_month_end: last day of its month
period_id: key of the period: its grain, a colon and its key
grain: month, year, survey cycle or another grain of the period spine
period_key: the period within its grain
period_start: first day of the period
period_end: last day of the period
period_label: the period for display
spans_multiple_years: the period begins and ends in different years
state_code: two-letter postal code
state_fips: two-digit FIPS code of the state
state_name: name of the state
entity_type: state, district or territory
census_region: Census region number
census_region_name: Census region
census_division: Census division number
census_division_name: Census division
is_us_jurisdiction: a state, the district or a territory
is_michigan: lies in the focus state
county_fips: five-digit FIPS code of the county; null where none is usable
county_fips_3: the county within its state, three digits
county_name: county, short
county_name_full: county as the survey names it, with its state
geography_kind: what sort of place the code stands for
is_reportable_county: a county that measures are published for
first_vintage: first survey vintage with the code
last_vintage: last survey vintage with the code
is_current_vintage: the newest vintage has the code
geography_note: why a code is unlike other counties
disaster_number: number of the disaster
fema_declaration_string: declaration as the publisher writes it
declaration_type: major disaster, emergency or fire management
declaration_title: title of the declaration
incident_type: kind of incident
declaration_date: day of the declaration
incident_begin_date: first day of the incident
incident_end_date: last day of the incident; null while open
is_incident_open: the incident has no last day yet
has_invalid_incident_window: the last day lies before the first
designated_area_count: area records of the disaster
designated_county_count: counties that it designates
statewide_area_count: area records for a whole state
state_count: states that it touches
is_flood_related: an incident that floods
is_major_disaster: declared as a major disaster
touches_michigan: designates an area of the focus state
ia_program_declared: individual assistance in any area
pa_program_declared: public assistance in any area
loss_year: year of the loss
loss_month: month of the loss
loss_year_month: month of the loss as yyyy-MM
loss_year_key: period key of the year of the loss
is_state_unknown: the publisher does not know the state
rated_flood_zone: flood zone that the policy was rated in
flood_zone_current: flood zone on the current map
occupancy_type: code of the building's use
pre_firm_indicator: built before the first flood map
post_firm_construction_indicator: built after the first flood map
crs_class_code: community rating class
claim_count: claims
closed_without_payment_count: claims closed without payment
zero_paid_count: claims with a payment of zero
no_county_count: claims without a usable county
paid_building: paid for buildings
paid_contents: paid for contents
paid_icc: paid for the increased cost of compliance
paid_total: paid in all
net_paid_total: paid in all, net of recoveries
building_coverage: building coverage in dollars
contents_coverage: contents coverage in dollars
avg_paid_per_claim: paid per claim
paid_total_constant: paid in all, in dollars of the base year
avg_paid_per_claim_constant: paid per claim, in dollars of the base year
is_complete_loss_year: the year of the loss is over
is_development_mature: enough years have passed for claims to settle
county_population: people in the county
population_vintage_window: years that the population estimate covers
population_is_extrapolated: the nearest vintage stands in for an unpublished year
is_small_cell: too few cases to read a rate from
claim_id: id of the claim
has_usable_county: the claim has a county code that can be joined
county_matches_reported_state: the county lies in the reported state
date_of_loss: day of the loss
amount_paid_on_building_claim: paid for the building
amount_paid_on_contents_claim: paid for contents
amount_paid_on_icc_claim: paid for the increased cost of compliance
total_amount_paid: paid for the claim in all
total_net_payment: paid for the claim in all, net of recoveries
is_closed_without_payment: closed without payment
is_zero_paid: paid, and the payment is zero
has_negative_payment: a payment below zero
total_amount_paid_constant: paid in all, in dollars of the base year
total_building_insurance_coverage: building coverage in dollars
total_contents_insurance_coverage: contents coverage in dollars
reported_zip_code: ZIP code as reported
open_date: day the claim was opened
most_recent_payment_date: day of the last payment
days_loss_to_last_payment: days from loss to last payment
is_spring_melt_season: lost in the months of snow melt
policies_in_force: policies in force at the end of the month
policy_records: policy records in force at the end of the month
premium_in_force: premium of those policies
building_coverage_in_force: building coverage of those policies
contents_coverage_in_force: contents coverage of those policies
policy_cost_in_force: cost of those policies to their holders
policies_beyond_records: policies over records, where one record stands for several
matched_via_statewide_declaration: met through a declaration of the whole state
incident_duration_days: days from the first to the last day of the incident
days_into_incident: days from the first day of the incident to the loss
is_in_grace_window: lost after the incident, within the days of grace
grace_window_days: days of grace after an incident
source_name: source
measure_label: what is counted
publisher_figure: what the publisher reports
rows_landing: rows received
rows_raw: rows in the raw tree
rows_duckdb: rows in the warehouse table
rows_staged: rows after staging
rows_in_mart: rows that the mart stands for
publisher_to_landing_gap: reported less received
warehouse_to_mart_gap: in the mart less in the warehouse
retrieved_at: when the source was fetched
source_last_refresh: the publisher's stamp of the data
source_metadata_refresh: the publisher's stamp of its description
interpretation: how to read the row
received_year: year of receipt
product_family: product under one name over all eras
allocation_method: how complaints were placed in a county
allocated_complaints: complaints, shared out by weight
allocated_timely: complaints answered in time, shared out
allocated_relief: complaints with relief, shared out
allocated_pending: complaints still pending, shared out
allocated_older_american: complaints of older Americans, shared out
complaints_per_100k: complaints per 100,000 people
company_name: company as published
complaint_count: complaints
closed_complaints: complaints that are not pending
pending_complaints: complaints whose answer is pending
timely_count: closed complaints answered in time
relief_count: complaints closed with any relief
monetary_relief_count: complaints closed with money
non_monetary_relief_count: complaints closed with other relief
relief_unspecified_count: complaints of eras that did not name the relief
untimely_count: complaints with the answer that none came in time
older_american_count: complaints tagged older American
servicemember_count: complaints tagged servicemember
narrative_count: complaints with a narrative
timely_rate_pct: timely, in percent of closed
relief_rate_pct: with relief, in percent of closed
date_received: day of receipt
received_quarter: quarter of receipt
product: product as published
sub_product: product detail as published
issue: issue as published
sub_issue: issue detail as published
first_received: first day with a complaint
last_received: last day with a complaint
pending_count: complaints whose answer is pending
pending_pct: pending, in percent of all
is_calendar_month_over: the month has ended
is_publication_complete: few enough are pending to read the month
pending_threshold_pct: percent pending up to which a month is complete
is_latest_complete_month: the newest complete month
activity_year: year of the register
has_no_reported_county: no county was reported
lei: legal entity identifier of the lender
institution_name: lender as it filed that year
loan_purpose_label: purpose of the loan
loan_type_label: type of the loan
lien_status_label: lien
occupancy_type_label: use of the dwelling
construction_method_label: how the dwelling is built
applicant_age_band: age of the applicant
applicant_race_label: race of the applicant
applicant_ethnicity_label: ethnicity of the applicant
applicant_sex_label: sex of the applicant
dti_band: debt to income
denial_reason_1_label: first reason for denial
applicant_income_bracket: income of the applicant
application_count: register rows that are applications
decided_applications: applications approved or denied
originated_count: loans made
approved_not_accepted_count: approved, not taken up
denied_count: denied
withdrawn_count: withdrawn by the applicant
closed_incomplete_count: closed as incomplete
purchased_count: loans bought
preapproval_count: requests for preapproval
originated_amount: amount of loans made
application_amount: amount applied for
median_originated_amount: exact median of loans made
median_applicant_income: exact median income of applicants
partially_exempt_count: rows whose lender need not report all
has_secondary_denial_reason: rows with more than one reason
denial_rate_pct: denied, in percent of decided
coverage_basis: what the coverage is measured over
matched: matched
total: all
coverage_pct: matched, in percent of all
cycle_key: survey cycle
year_start: first year
year_end: last year
period_grain: grain of the period
location_abbr: place, abbreviated
location_desc: place
location_kind: state, territory, region or nation
class_id: id of the class
class: class of questions
topic: topic of questions
question_id: id of the question
question: question
indicator_family: family of indicators
short_label: question for display
higher_is_better: a higher value is the better one
is_cognitive_decline: about cognitive decline
is_caregiving: about caregiving
is_screening: about screening
age_group: age group
stratification: second stratification
stratification_category: category of the second stratification
is_overall_age_group: all ages together
is_unstratified_second_dimension: no second stratification
data_value_type: what the value is
data_value_unit: unit of the value
data_value: value; null where suppressed
low_confidence_limit: lower end of the interval
high_confidence_limit: upper end of the interval
is_suppressed: withheld by the publisher
has_confidence_interval: both ends of the interval are published
footnote_symbol: mark of the footnote
footnote_text: footnote
is_not_comparable_pre_2019: not to be compared with cycles before 2019
is_fewer_than_50_states_reporting: the national value lacks states
is_regional_estimate: value of a region
mi_value: value of the focus state
mi_low: lower end of its interval
mi_high: upper end of its interval
national_value: value of the nation
national_low: lower end of the nation's interval
national_high: upper end of the nation's interval
gap_to_national: less the nation's value
national_fewer_than_50_states: the nation's value lacks states
mi_not_comparable_pre_2019: the focus state's value breaks with earlier cycles
national_not_comparable_pre_2019: the nation's value breaks with earlier cycles
is_comparable: both values may be compared
intervals_overlap: the two intervals overlap
significance: whether the difference is more than chance
benchmark_verdict: better, worse or no different than the nation
prior_cycle_key: cycle before
mi_prior_value: value in the cycle before
mi_change_from_prior: change since the cycle before
mi_direction: whether that change is for the better
measure_year: year of the measure
geo_level: nation, state or county
geo_code: code of the place
geo_description: place
is_jurisdiction: a state, the district or a territory
age_level: age level of beneficiaries
cost_per_capita: standardized cost per beneficiary
national_cost_per_capita: the same for the nation
cost_per_capita_constant: cost in dollars of the base year
national_cost_per_capita_constant: the nation's cost in dollars of the base year
gap_to_national_constant: gap in dollars of the base year
constant_dollar_base_year: year whose dollars are used
ma_participation_rate: share of beneficiaries in private plans
ffs_beneficiary_denominator: beneficiaries that costs are divided by
benes_total_cnt: beneficiaries
bene_avg_age: their mean age
bene_dual_eligible_pct: share also eligible for Medicaid
cms_county_label: county as the publisher writes it
is_unassigned_county: beneficiaries without a county
service_code: code of the service
service_name: service
is_long_term_care: a long-term care service
measure_kind: what is measured
is_standardized: prices are standardized over places
source_column: published column of the value
county_value: value of the county
ratio_to_national: value over the nation's
is_true_zero: published as zero, not withheld
national_is_suppressed: the nation's value is withheld
service_suppressed_cells: counties whose value is withheld
service_suppressed_pct: the same in percent of counties
is_small_cell_service: a service withheld in many counties
vintage: survey vintage
vintage_year: last year of the vintage
vintage_window_start: first year of the vintage
vintage_window_end: last year of the vintage
vintage_label: vintage for display
population_65_plus: people of 65 and over
population_65_plus_margin: margin of error
is_controlled_estimate: controlled to a known total, so without sampling error
state_population_65_plus: the same for the state
counties_reporting: counties in the vintage
county_share_of_state_pct: county in percent of the state
is_non_overlapping_with_prior: shares no year with the vintage it is compared to
from_vintage: vintage at the beginning
to_vintage: vintage at the end
population_window_from: years of the vintage at the beginning
population_window_to: years of the vintage at the end
population_from: people of 65 and over at the beginning
population_to: people of 65 and over at the end
population_change: change of that
population_change_pct: change in percent
windows_are_non_overlapping: the two vintages share no year
indicator_from_cycle: cycle at the beginning
indicator_to_cycle: cycle at the end
indicator_window: years of both cycles
cycles_available: cycles with a value
indicator_from_value: value at the beginning
indicator_to_value: value at the end
indicator_change_pp: change in percentage points
straddles_2019_break: the cycles lie on both sides of the break of 2019
indicator_direction: whether the change is for the better
windows_are_aligned: cycles and vintages end in the same year
need_vs_capacity_verdict: how need and its indicator moved together
"""


class ContractBreach(ValueError):
    """A frame whose columns are not those that its table promises."""


@dataclass(frozen=True)
class Contract:
    table: str
    meaning: str
    columns: dict[str, str]
    comments: dict[str, str]

    def breaches(self, df: DataFrame) -> list[str]:
        """Where names and types differ, in contract order."""
        return differences({f.name: f.dataType.simpleString() for f in df.schema.fields}, self.columns)


def differences(found: dict[str, str], wanted: dict[str, str]) -> list[str]:
    lines = [f"{name}: missing" for name in wanted if name not in found]
    lines += [f"{name}: not in the contract" for name in found if name not in wanted]
    return lines + [f"{name}: {found[name]} instead of {kind}" for name, kind in wanted.items() if found.get(name, kind) != kind]


def contract_breaches(df: DataFrame, contract: T.StructType) -> list[str]:
    """The same for a contract given as a schema."""
    return differences(*[{f.name: f.dataType.simpleString() for f in s.fields} for s in (df.schema, contract)])


@cache
def contracts() -> dict[str, Contract]:
    """Every contract by table name."""
    meanings = dict(line.split(": ", 1) for line in MEANINGS.strip().splitlines())
    found = {}
    for block in re.split(r"\n(?=\S)", TABLES.strip()):
        head, *rest = block.splitlines()
        table, meaning = head.split(": ", 1)
        columns = dict(re.findall(r"(\w+)\s+(decimal\(\d+,\d+\)|\w+)", " ".join(rest)))
        found[table] = Contract(table, meaning, columns, {c: meanings[c] for c in columns})
    return found


def checked(df: DataFrame, table: str) -> Contract | None:
    """The contract of a table, which ``df`` keeps; None where the table has none."""
    contract = contracts().get(table)
    if contract is not None and (broken := contract.breaches(df)):
        raise ContractBreach(f"{table}: " + "; ".join(broken))
    return contract
