"""Customers and their support tickets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import clean, codes


def live_customers(raw: DataFrame) -> DataFrame:
    """Accounts that are customers and not deleted; a missing flag counts as deleted."""
    return raw.where((F.col("is_deleted") == F.lit(False)) & F.col("account_type").ilike("Customer%"))


def _segment() -> Column:
    revenue = clean.to_number(F.col("annual_revenue"))
    return (
        F.when(F.col("account_type") == "Customer - Channel", "VIP").when(revenue >= 70000, "Premium").otherwise("Standard")
    )


def customers(raw: DataFrame) -> DataFrame:
    value = clean.to_decimal(F.col("annual_revenue"), 12, 2) * F.lit("0.05").cast("decimal(3,2)")
    return live_customers(raw).select(
        clean.crm_customer_key(F.col("sf_account_id")).alias("customer_id"),
        "first_name",
        "last_name",
        F.col("email_address").alias("email"),
        _segment().alias("segment"),
        value.cast("decimal(15,4)").alias("lifetime_value"),
        clean.day_of(F.col("created_date")).alias("signup_date"),
        clean.map_code(F.col("billing_state"), codes.STATE_REGION, codes.OTHER_REGION).alias("region"),
    )


def support_tickets(raw: DataFrame, customers: DataFrame, cut_keys: bool = False) -> DataFrame:
    """Product cases with the customer they belong to, or NULL where the account is not a customer."""
    status = F.upper("case_status")
    cases = raw.where((F.col("case_type") != "Information") & F.col("product_sku").isNotNull()).select(
        clean.number_key(codes.TICKET, F.col("sf_case_id"), 4, cut_keys).alias("ticket_id"),
        clean.crm_customer_key(F.col("sf_account_id")).alias("account"),
        clean.sku_key(F.col("product_sku"), cut_keys).alias("sku_id"),
        F.col("case_type").alias("issue_type"),
        F.upper("case_priority").alias("priority"),
        clean.map_code(status, codes.TICKET_STATUS, status).alias("status"),
        clean.to_timestamp(F.col("created_date")).alias("created_at"),
        clean.to_timestamp(F.col("closed_date")).alias("resolved_at"),
    )
    known = customers.select("customer_id")
    joined = cases.join(known, cases.account == known.customer_id, "left")
    return joined.select(
        "ticket_id", "customer_id", "sku_id", "issue_type", "priority", "status", "created_at", "resolved_at"
    )
