"""The derived raw tables as Spark frames under the publishers' own column names."""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.reshape import union_distinct
from plumbline.params import Params
from plumbline.plans import conformed, intermediate, staging
from plumbline.session import materialise
from plumbline.testbed import raw_tables
from plumbline.testbed.dialect import SPARK, TABLES

PARAMS = Params(deflator_base_year=2000, as_of=dt.date(2001, 12, 31))

# Derived column -> publisher column, where the two differ.
PUBLISHED = {
    "complaints": {v: k for k, v in staging.COMPLAINT_COLUMNS.items()},
    "claims": {
        "claim_id": "id", "state_code": "state", "date_of_loss": "dateOfLoss", "year_of_loss": "yearOfLoss",
        "county_code": "countyCode", "census_geoid": "censusGeoid",
        "amount_building": "amountPaidOnBuildingClaim", "amount_contents": "amountPaidOnContentsClaim",
        "amount_icc": "amountPaidOnIncreasedCostOfComplianceClaim",
        "net_building": "netBuildingPaymentAmount", "net_contents": "netContentsPaymentAmount",
        "net_icc": "netIccPaymentAmount", "reason_building": "nonPaymentReasonBuilding",
        "reason_contents": "nonPaymentReasonContents", "rated_flood_zone": "ratedFloodZone",
        "flood_zone_current": "floodZoneCurrent", "occupancy_type": "occupancyType",
        "pre_firm_indicator": "preFirmIndicator", "post_firm_indicator": "postFIRMConstructionIndicator",
        "crs_class_code": "crsClassCode", "building_coverage": "totalBuildingInsuranceCoverage",
        "contents_coverage": "totalContentsInsuranceCoverage", "reported_zip_code": "reportedZipCode",
        "open_date": "openDate", "most_recent_payment_date": "mostRecentPaymentDate"},
    "policies": {
        "policy_id": "id", "state_code": "propertyState", "census_geoid": "censusGeoid",
        "reported_zip_code": "reportedZipCode", "policy_count": "policyCount",
        "effective_date": "policyEffectiveDate", "termination_date": "policyTerminationDate",
        "as_of_date": "asOfDate", "policy_cost": "policyCost",
        "premium": "totalInsurancePremiumOfThePolicy",
        "building_coverage": "totalBuildingInsuranceCoverage",
        "contents_coverage": "totalContentsInsuranceCoverage"},
    "declarations": {
        "area_id": "id", "disaster_number": "disasterNumber", "declaration_string": "femaDeclarationString",
        "declaration_type": "declarationType", "declaration_date": "declarationDate",
        "incident_type": "incidentType", "declaration_title": "declarationTitle",
        "ia_program_declared": "iaProgramDeclared", "pa_program_declared": "paProgramDeclared",
        "incident_begin_date": "incidentBeginDate", "incident_end_date": "incidentEndDate",
        "fips_state_code": "fipsStateCode", "fips_county_code": "fipsCountyCode", "state_code": "state"},
    "lending": {
        "co_applicant_age": "co-applicant_age", "co_applicant_sex": "co-applicant_sex",
        "open_end_line_of_credit": "open-end_line_of_credit",
        "applicant_ethnicity_1": "applicant_ethnicity-1", "co_applicant_ethnicity_1": "co-applicant_ethnicity-1",
        "applicant_race_1": "applicant_race-1", "co_applicant_race_1": "co-applicant_race-1",
        **{f"denial_reason_{n}": f"denial_reason-{n}" for n in (1, 2, 3, 4)}},
    "institutions": {"filings": "count"},
    "indicators": {"footnote": "data_value_footnote_symbol", "low": "low_confidence_limit",
                   "high": "high_confidence_limit"},
    "population": {"name": "NAME"},
    "population_65": {"name": "NAME"},
}


class Testbed:
    """Raw, staged and conformed frames over one folder of test tables, built when asked for."""

    __test__ = False

    def __init__(self, spark: SparkSession, folder: str, params: Params = PARAMS):
        self.spark, self.folder, self.params = spark, folder, params
        self._tables: dict[str, DataFrame] = {}
        self._raw: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    def sql(self, text: str) -> DataFrame:
        used = {t: self.table(t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used)

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self._published(name)
        return self._raw[name]

    def _published(self, name: str) -> DataFrame:
        df = self.sql(getattr(raw_tables, name)(SPARK))
        names = PUBLISHED.get(name, {})
        df = df.select([F.col(c).alias(names.get(c, c)) for c in df.columns])
        if name == "indicators":
            texts = ("rowid", "locationid", "datasource", "topicid", "datavaluetypeid", "data_value_footnote",
                     "stratificationcategory1", "stratificationcategoryid1", "stratificationid1",
                     "stratificationcategoryid2", "stratificationid2", "geolocation")
            df = df.select("*", *[F.lit(None).cast("string").alias(c) for c in texts])
        return df

    @cached_property
    def claims(self) -> DataFrame:
        return staging.stage_claims(self.raw("claims"))

    @cached_property
    def policies(self) -> DataFrame:
        return staging.stage_policies(self.raw("policies"))

    @cached_property
    def declarations(self) -> DataFrame:
        return staging.stage_declarations(self.raw("declarations"))

    @cached_property
    def complaints(self) -> DataFrame:
        return staging.stage_complaints(self.raw("complaints"))

    @cached_property
    def institutions(self) -> DataFrame:
        return staging.stage_institutions(self.raw("institutions"))

    @cached_property
    def lending(self) -> DataFrame:
        return staging.stage_lending(self.raw("lending"), self.params)

    @cached_property
    def indicators(self) -> DataFrame:
        return staging.stage_indicators(self.raw("indicators"), self.params)

    @cached_property
    def medicare(self) -> DataFrame:
        return staging.stage_medicare(self.raw("medicare"), self.params)

    @cached_property
    def measures(self) -> DataFrame:
        return intermediate.service_measures(self.raw("medicare"), self.params)

    @cached_property
    def population(self) -> DataFrame:
        return staging.stage_population(self.raw("population"), self.params)

    @cached_property
    def population_65(self) -> DataFrame:
        return staging.stage_population_65(self.raw("population_65"), self.params)

    @cached_property
    def prices(self) -> DataFrame:
        return staging.stage_prices(self.raw("prices"))

    @cached_property
    def crosswalk(self) -> DataFrame:
        return staging.stage_crosswalk(self.raw("crosswalk"), self.params)

    @cached_property
    def weights(self) -> DataFrame:
        return intermediate.prefix_weights(self.crosswalk)

    @cached_property
    def allocation(self) -> DataFrame:
        return intermediate.allocate_complaints(self.complaints, self.crosswalk, self.weights)

    @cached_property
    def referenced(self) -> list[tuple[str, DataFrame]]:
        """The counties that each source names, from one scan of the sources whoever asks for them."""
        universe = conformed.county_universe(
            self.raw("claims"), self.raw("policies"), self.raw("declarations"), self.raw("medicare"),
            self.raw("lending"), self.raw("crosswalk"), self.population_65)
        written = materialise(union_distinct([df.select(F.lit(name).alias("_source"), "*") for name, df in universe]), "referenced-counties")
        return [(name, written.where(F.col("_source") == name).drop("_source")) for name, _ in universe]

    @cached_property
    def counties(self) -> DataFrame:
        # A few thousand rows looked up by every county mart: written once, then broadcast by size.
        return materialise(conformed.county_dimension(self.population, self.referenced, self.params), "counties")
