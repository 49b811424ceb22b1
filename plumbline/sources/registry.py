"""The raw tables, the key each is partitioned by, and what each may be checked against."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RawTable:
    track: str
    source: str
    partition_key: str
    form: str
    control_sums: tuple[str, ...] = ()
    first_year: int | None = None

    @property
    def prefix(self) -> str:
        return {"insurance": "ins", "fintech": "fin", "health": "hlt", "shared": "ref"}[self.track]

    @property
    def table(self) -> str:
        return f"raw.{self.prefix}_{self.source}"

    @property
    def staged(self) -> str:
        return f"stg.stg_{self.prefix}__{self.source}"


RAW_TABLES: tuple[RawTable, ...] = (
    RawTable("insurance", "nfip_claims", "state", "parquet", (
        "amountPaidOnBuildingClaim", "amountPaidOnContentsClaim",
        "amountPaidOnIncreasedCostOfComplianceClaim", "netBuildingPaymentAmount",
        "netContentsPaymentAmount", "netIccPaymentAmount")),
    RawTable("insurance", "nfip_policies", "propertyState", "parquet", (
        "policyCost", "totalInsurancePremiumOfThePolicy",
        "totalBuildingInsuranceCoverage", "totalContentsInsuranceCoverage")),
    RawTable("insurance", "fema_declarations", "state", "parquet"),
    RawTable("fintech", "cfpb_complaints", "year", "csv_multiline", first_year=2011),
    RawTable("fintech", "hmda_lar", "activity_year", "csv", first_year=2018),
    RawTable("fintech", "hmda_institutions", "period", "json_institutions", first_year=2018),
    RawTable("health", "cdc_healthy_aging", "locationabbr", "csv"),
    RawTable("health", "cms_geographic_variation", "BENE_GEO_LVL", "csv"),
    RawTable("shared", "acs5_detailed", "vintage", "json_arrays", first_year=2010),
    RawTable("shared", "acs5_subject", "vintage", "json_arrays", first_year=2010),
    RawTable("shared", "cpi_u", "year", "tsv", first_year=1913),
    RawTable("shared", "cpi_u_series", "seasonal", "tsv"),
    RawTable("shared", "zip_county_crosswalk", "state", "json_results"),
)


def raw_table(source: str) -> RawTable:
    for table in RAW_TABLES:
        if table.source == source:
            return table
    raise KeyError(source)
