"""Column contracts of the raw feeds and the curated tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

RAW = {
    "erp_products": "item_number item_description manufacturer upc_code list_price item_type item_subtype weight "
    "weight_uom item_status created_date",
    "erp_warehouse_inventory": "facility_code item_number on_hand_qty reorder_level last_cycle_count snapshot_ts",
    "partner_contracts": "partner_name partner_domain partner_region channel_type tier_level effective_date contract_status",
    "erp_sales_orders": "order_number order_line item_number customer_account order_entered_date sales_channel "
    "line_status actual_ship_date ordered_qty unit_selling_price line_discount_pct",
    "pos_transactions": "transaction_ts item_number qty_sold sale_amount return_flag",
    "salesforce_accounts": "sf_account_id first_name last_name email_address account_type annual_revenue "
    "is_deleted:boolean created_date billing_state",
    "salesforce_cases": "sf_case_id sf_account_id product_sku case_type case_priority case_status created_date closed_date",
    "netsuite_gl": "account_number account_name account_type_name department_name is_summary:boolean is_inactive:boolean",
    "netsuite_journal_entries": "posting_period account_number debit_amount credit_amount is_posted:boolean",
    "sap_vendors": "vendor_number vendor_name_1 country_key avg_lead_time_days payment_terms_key deletion_flag",
    "sap_purchase_orders": "po_number po_line vendor_number material_number po_qty net_price doc_date delivery_date po_status",
}

CURATED = {
    "sales.orders": "order_id string, customer_id string, order_date date, channel string, "
    "total_amount decimal(18,2), status string, ship_date date",
    "sales.order_items": "order_id string, line_number int, sku_id string, quantity int, "
    "unit_price decimal(10,2), discount_pct decimal(5,2)",
    "sales.daily_sales_summary": "sale_date date, sku_id string, units_sold bigint, "
    "gross_revenue decimal(18,2), returns bigint",
    "inventory.skus": "sku_id string, product_name string, brand string, upc string, msrp decimal(10,2), "
    "category string, subcategory string, weight_lbs decimal(14,7), status string, created_at timestamp_ntz",
    "inventory.product_categories": "category_id string, category_name string, parent_category string, department string",
    "inventory.distributors": "distributor_id string, distributor_name string, website_domain string, region string, "
    "channel string, partnership_tier string, contract_start date, status string",
    "inventory.warehouse_stock": "warehouse_id string, sku_id string, quantity_on_hand int, reorder_point int, "
    "last_counted date",
    "inventory.distributor_prices": "sku_id string, product_name string, brand string, upc string, msrp decimal(10,2), "
    "distributor_id string, distributor_name string, website_domain string, listed_price decimal(10,2), "
    "price_deviation_pct decimal(8,4), discount decimal(5,2), listing_url string, enriched_at timestamp_ntz",
    "crm.customers": "customer_id string, first_name string, last_name string, email string, segment string, "
    "lifetime_value decimal(15,4), signup_date date, region string",
    "crm.support_tickets": "ticket_id string, customer_id string, sku_id string, issue_type string, priority string, "
    "status string, created_at timestamp_ntz, resolved_at timestamp_ntz",
    "finance.gl_accounts": "account_id string, account_name string, account_type string, department string",
    "finance.monthly_pnl": "period string, account_id string, amount decimal(18,2)",
    "supply_chain.suppliers": "supplier_id string, supplier_name string, country string, lead_time_days int, "
    "payment_terms string, status string",
    "supply_chain.purchase_orders": "po_id string, supplier_id string, sku_id string, quantity int, "
    "unit_cost decimal(10,2), order_date date, expected_date date, status string",
}

KEYS = {
    "sales.orders": ["order_id"],
    "sales.order_items": ["order_id", "line_number"],
    "sales.daily_sales_summary": ["sale_date", "sku_id"],
    "inventory.skus": ["sku_id"],
    "inventory.product_categories": ["category_name"],
    "inventory.distributors": ["website_domain"],
    "inventory.warehouse_stock": ["warehouse_id", "sku_id"],
    "crm.customers": ["customer_id"],
    "crm.support_tickets": ["ticket_id"],
    "finance.gl_accounts": ["account_id"],
    "finance.monthly_pnl": ["period", "account_id"],
    "supply_chain.suppliers": ["supplier_id"],
    "supply_chain.purchase_orders": ["po_id"],
}

# Tables that a stream keeps beside a curated one, and their keys.
SIDE = {
    "sales.order_totals": "order_number string, lines bigint, total_amount decimal(38,2), lowest string, own_status string, "
    "ship_date date, customer_id_low string, customer_id_high string, customer_id_known bigint, order_date_low date, "
    "order_date_high date, order_date_known bigint, channel_low string, channel_high string, channel_known bigint",
    "sales.order_files": "file string, stream string, batch bigint",
    "inventory.warehouse_stock_times": CURATED["inventory.warehouse_stock"] + ", snapshot_ts timestamp_ntz",
}
SIDE_KEYS = {
    "sales.order_totals": ["order_number"],
    "sales.order_files": ["file"],
    "inventory.warehouse_stock_times": KEYS["inventory.warehouse_stock"],
}

# Columns an update leaves as they were when the row was first inserted.
KEPT_ON_UPDATE = {
    "inventory.skus": ["created_at"],
    "inventory.product_categories": ["category_id"],
    "inventory.distributors": ["distributor_id"],
}

# Longest text each column of the price table may hold.
PRICE_TEXT_LENGTHS = {
    "sku_id": 20,
    "product_name": 200,
    "brand": 100,
    "upc": 20,
    "distributor_id": 20,
    "distributor_name": 100,
    "website_domain": 200,
    "listing_url": 500,
}


def raw_schema(name: str) -> StructType:
    columns = [c if ":" in c else f"{c}:string" for c in RAW[name].split()]
    return StructType.fromDDL(", ".join(c.replace(":", " ") for c in columns))


def curated_schema(name: str) -> StructType:
    return StructType.fromDDL(CURATED[name])


def stored_schema(name: str) -> StructType:
    """Of a curated table or one that a stream keeps beside it."""
    return StructType.fromDDL(CURATED.get(name) or SIDE[name])


def stored_keys(name: str) -> list[str]:
    return KEYS.get(name) or SIDE_KEYS[name]


def curated_columns(name: str) -> list[str]:
    """Column names of a curated table; needs no session."""
    return [c.split()[0] for c in re.split(r", (?=[a-z])", CURATED[name])]


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns of a curated table in their stated order and types; a missing column comes in as NULL."""
    fields = curated_schema(name).fields
    return df.select(
        *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    )
