"""Chart of accounts and the monthly profit and loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import clean, codes


def gl_accounts(raw: DataFrame) -> DataFrame:
    kind = F.col("account_type_name")
    used = raw.where(
        (F.col("is_summary") == F.lit(False)) & (F.col("is_inactive") == F.lit(False)) & kind.isin(*codes.ACCOUNT_TYPE)
    )
    return used.select(
        clean.prefixed(codes.ACCOUNT, F.col("account_number")).alias("account_id"),
        clean.strip_suffix(F.col("account_name"), codes.CHANNEL_SUFFIX).alias("account_name"),
        clean.map_code(kind, codes.ACCOUNT_TYPE, F.upper(kind)).alias("account_type"),
        F.col("department_name").alias("department"),
    )


def _money(text: str) -> Column:
    return F.coalesce(clean.to_decimal(F.nullif(F.col(text), F.lit("")), 14, 2), F.lit(0).cast("decimal(14,2)"))


def monthly_pnl(journal: DataFrame, accounts: DataFrame) -> DataFrame:
    """Posted amounts per month and account, signed by the type of the account.

    The journal is summed per raw period and account before it meets the accounts, so the join and its
    shuffle see one row per pair however many entries one account holds.
    """
    summed = (
        journal.where(F.col("is_posted") == F.lit(True))
        .groupBy("posting_period", "account_number")
        .agg(F.sum(_money("debit_amount")).alias("debit"), F.sum(_money("credit_amount")).alias("credit"))
        .withColumn("account_id", clean.prefixed(codes.ACCOUNT, F.col("account_number")))
    )
    kinds = accounts.select("account_id", "account_type")
    signed = (
        F.when(F.col("account_type") == "CONTRA", -F.col("debit"))
        .when(F.col("account_type") == "REVENUE", F.col("credit"))
        .otherwise(F.col("debit"))
    )
    per_pair = (
        summed.join(kinds, "account_id")
        .groupBy("posting_period", "account_number")
        .agg(F.sum(signed).alias("amount"))
    )
    return per_pair.select(
        clean.month_period(F.col("posting_period")).alias("period"),
        clean.prefixed(codes.ACCOUNT, F.col("account_number")).alias("account_id"),
        F.col("amount").cast("decimal(18,2)").alias("amount"),
    )
