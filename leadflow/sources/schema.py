"""The fact table: column catalog, Spark schema and masking metadata.

The catalog below is a fixed value: the lead/booking table's 132 columns in their
natural order, each with its declared type, whether it is categorical, its PII level
and its masking strategy.  Masking policy travels with the data as
``StructField.metadata`` so that it follows a column through aliases and joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# --- fixed values: column, type, categorical, pii_level, masking_strategy ---
_CATALOG = (
    ("leadid", "bigint", False, "none", "none"),
    ("customerid", "bigint", False, "low", "hash"),
    ("investmenttypeid", "int", True, "none", "none"),
    ("referralid", "bigint", False, "low", "hash"),
    ("referralid2", "string", True, "low", "hash"),
    ("covertypeid", "int", True, "none", "none"),
    ("leaddate", "date", False, "low", "faker"),
    ("full_leaddate", "string", False, "low", "faker"),
    ("leadmonth", "string", True, "low", "faker"),
    ("lead_year", "string", True, "low", "none"),
    ("bookingdate", "date", False, "low", "faker"),
    ("full_bookingdate", "string", False, "low", "faker"),
    ("bookingmonth", "string", True, "low", "none"),
    ("booking_year", "string", True, "low", "none"),
    ("leadassigneddate", "date", False, "low", "faker"),
    ("full_leadassigneddate", "string", False, "low", "faker"),
    ("first_assigneddate", "string", False, "low", "faker"),
    ("statusdate", "date", False, "low", "faker"),
    ("issuancedate", "date", False, "low", "faker"),
    ("revenuedate", "date", False, "low", "faker"),
    ("customer_filled_first_transitype_date", "string", False, "low", "faker"),
    ("policystartdate", "string", False, "low", "faker"),
    ("policyenddate", "string", False, "low", "faker"),
    ("paymentdate", "string", False, "low", "faker"),
    ("contact_person_name", "string", False, "high", "faker"),
    ("client", "string", True, "low", "hash"),
    ("companyname", "string", True, "low", "faker"),
    ("occupancyid", "int", True, "none", "none"),
    ("unsubscription_flag", "int", True, "none", "none"),
    ("occupancyname", "string", True, "none", "none"),
    ("parentcategoryid", "int", False, "none", "none"),
    ("occupancyname2", "string", True, "none", "none"),
    ("booking_occupancy", "varchar(500)", True, "none", "none"),
    ("lead_occupancy", "varchar(500)", True, "none", "none"),
    ("mtx_occupancy", "varchar(500)", True, "none", "none"),
    ("leadassignedagentname", "varchar(100)", True, "low", "faker"),
    ("currentlyassigneduser", "varchar(100)", True, "low", "faker"),
    ("leadreportingmanagername", "string", True, "low", "faker"),
    ("leadreportingmanagername2", "varchar(100)", True, "low", "faker"),
    ("lead_agentid", "varchar(255)", False, "none", "hash"),
    ("lead_manager_id", "varchar(100)", False, "low", "hash"),
    ("first_assigned_agent", "varchar(100)", True, "low", "faker"),
    ("first_assigned_agentid", "varchar(255)", False, "low", "hash"),
    ("booking_agent", "varchar(100)", True, "low", "faker"),
    ("booking_agent_manager", "string", True, "low", "faker"),
    ("booking_agent_manager2", "varchar(100)", True, "low", "faker"),
    ("booking_manager_id", "varchar(100)", False, "low", "hash"),
    ("bookingagent_id", "varchar(255)", False, "low", "hash"),
    ("lead2assignment_tat_mins", "double", False, "none", "none"),
    ("customer_filled_first_transitype", "string", True, "none", "none"),
    ("transittype2", "string", True, "none", "none"),
    ("assignedbyuserid", "bigint", False, "low", "hash"),
    ("assigned_to_group_name", "varchar(200)", True, "none", "none"),
    ("assigntogroupid", "int", False, "none", "none"),
    ("parentid", "bigint", False, "none", "none"),
    ("transittype", "string", True, "none", "none"),
    ("state", "varchar(30)", True, "low", "faker"),
    ("city", "varchar(50)", True, "low", "faker"),
    ("city_tier", "int", True, "none", "none"),
    ("typeofpolicy", "string", True, "low", "none"),
    ("productname", "string", True, "none", "none"),
    ("lead_subproduct", "string", True, "none", "none"),
    ("lead_subproduct2", "varchar(50)", True, "none", "none"),
    ("booking_subproduct", "string", True, "none", "none"),
    ("product_bucket", "string", True, "none", "none"),
    ("planname", "varchar(100)", True, "none", "none"),
    ("planid", "int", False, "none", "none"),
    ("leadeb_noneb", "string", True, "none", "none"),
    ("leadsource", "string", True, "low", "hash"),
    ("leadcreationsource", "string", True, "low", "hash"),
    ("utm_source", "string", True, "none", "none"),
    ("final_utmsource", "string", True, "none", "none"),
    ("utm_medium", "string", True, "none", "none"),
    ("utm_term", "string", False, "none", "none"),
    ("branchname", "string", True, "low", "faker"),
    ("utm_campaign", "string", True, "none", "none"),
    ("utm_content", "string", True, "none", "none"),
    ("mkt_category", "string", True, "none", "none"),
    ("lead_department", "string", True, "low", "none"),
    ("is_lead_hybrid", "string", True, "none", "none"),
    ("booking_eb_noneb", "string", True, "none", "none"),
    ("booking_department", "string", True, "none", "none"),
    ("is_booking_hybrid", "string", True, "none", "none"),
    ("statusname", "varchar(50)", True, "low", "redact"),
    ("bms_statusname", "varchar(50)", True, "low", "redact"),
    ("statusid", "int", False, "none", "none"),
    ("statusby", "bigint", False, "low", "hash"),
    ("substatusname", "varchar(100)", True, "low", "redact"),
    ("substatusid", "int", False, "none", "none"),
    ("booking_status", "string", True, "low", "redact"),
    ("suminsured", "double", False, "none", "none"),
    ("premium", "double", False, "none", "none"),
    ("brokerage", "double", False, "none", "none"),
    ("revenue", "double", False, "none", "none"),
    ("periodicityamount", "double", False, "none", "none"),
    ("insurername", "varchar(100)", True, "low", "faker"),
    ("supplierid", "int", False, "none", "none"),
    ("insurerfullname", "varchar(100)", True, "low", "faker"),
    ("tpaname", "string", True, "low", "faker"),
    ("totalnooflives", "int", False, "none", "none"),
    ("totalnoofemployees", "int", False, "none", "none"),
    ("paymentsource", "string", True, "low", "faker"),
    ("policyno", "string", False, "low", "hash"),
    ("paymentstatus", "bigint", True, "none", "none"),
    ("paymentstatus2", "bigint", True, "none", "none"),
    ("paymentsubstatus", "int", True, "none", "none"),
    ("paymentperiodicity", "string", True, "none", "none"),
    ("new_eb_payment_mode", "string", True, "none", "none"),
    ("policytype", "string", True, "none", "none"),
    ("ispaymentdone", "string", True, "none", "none"),
    ("isassisted", "string", True, "none", "none"),
    ("kycstatusid", "int", True, "low", "hash"),
    ("kyctypeid", "int", True, "low", "hash"),
    ("kyctype", "string", True, "low", "none"),
    ("kycstatus", "string", True, "low", "none"),
    ("is_pure", "string", True, "none", "none"),
    ("issuence", "string", True, "none", "none"),
    ("lead_count", "int", False, "none", "none"),
    ("booking_count", "int", False, "none", "none"),
    ("conversioncheck", "int", True, "none", "none"),
    ("cpmrto", "int", True, "none", "none"),
    ("customertype", "string", True, "low", "faker"),
    ("continuepq", "string", False, "low", "faker"),
    ("shipmenttype", "string", True, "none", "none"),
    ("leadgrade", "int", True, "none", "none"),
    ("leadrank", "int", True, "none", "none"),
    ("leadscore", "double", False, "none", "none"),
    ("exitpointurl", "string", False, "low", "redact"),
    ("mktcategory", "string", True, "none", "none"),
    ("mktcategoryfinal", "string", True, "none", "none"),
    ("lead_lob", "string", True, "none", "none"),
    ("booking_lob", "string", True, "none", "none"),
)
# --- end of fixed values ---


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type_name: str
    categorical: bool
    pii_level: str
    masking_strategy: str

    @property
    def spark_type(self) -> T.DataType:
        t = self.type_name
        if t == "int":
            return T.IntegerType()
        if t == "bigint":
            return T.LongType()
        if t == "double":
            return T.DoubleType()
        if t == "date":
            return T.DateType()
        return T.StringType()          # string and varchar(n): length is not enforced

    @property
    def metadata(self) -> dict:
        return {"pii_level": self.pii_level, "masking_strategy": self.masking_strategy,
                "is_categorical": self.categorical, "source_column": self.name}


CATALOG: list[ColumnSpec] = [ColumnSpec(*row) for row in _CATALOG]
CATALOG_BY_NAME: dict[str, ColumnSpec] = {c.name: c for c in CATALOG}

FACT_SCHEMA = T.StructType([T.StructField(c.name, c.spark_type, True, c.metadata) for c in CATALOG])


def with_policy(df: DataFrame, policy: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Attach masking metadata to the columns of ``df``.

    ``policy`` maps column -> (pii_level, masking_strategy); columns not in it take the
    catalog entry of the same name, and columns unknown to both are marked none/none.
    Only metadata changes, so the plan is untouched (a projection Catalyst collapses).
    """
    policy = policy or {}
    cols = []
    for field in df.schema.fields:
        if field.name in policy:
            pii, strategy = policy[field.name]
            spec = CATALOG_BY_NAME.get(field.name)
            meta = {"pii_level": pii, "masking_strategy": strategy,
                    "is_categorical": bool(spec and spec.categorical), "source_column": field.name}
        elif field.name in CATALOG_BY_NAME:
            meta = CATALOG_BY_NAME[field.name].metadata
        else:
            meta = {"pii_level": "none", "masking_strategy": "none", "is_categorical": False,
                    "source_column": field.name}
        cols.append(df[field.name].alias(field.name, metadata=meta))
    return df.select(*cols)


def policy_of(df: DataFrame) -> dict[str, tuple[str, str]]:
    """column -> (pii_level, masking_strategy) read back from the schema metadata."""
    out = {}
    for field in df.schema.fields:
        meta = field.metadata or {}
        out[field.name] = (meta.get("pii_level", "none"), meta.get("masking_strategy", "none"))
    return out
