"""Raw text feeds derived from the star-schema tables.

Each feed is one portable SELECT, so the same text builds the feed on Spark and, as a CTE, on DuckDB.
Every column is text except the four flags; the dirty values are there for the cleaning rules to meet.
All feeds read their whole tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events pages conversations".split()

_NUMBERED_LINES = """(SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
    l_suppkey, l_quantity, l_extendedprice, l_discount, l_shipdate) AS line FROM lineitem) l"""

FEEDS = {
    "raw_erp_products": """
SELECT CAST(p_partkey AS STRING) AS item_number, p_name AS item_description,
  CASE p_partkey % 12 WHEN 0 THEN 'Dyson Ltd' WHEN 1 THEN 'Whirlpool Corporation' WHEN 2 THEN 'SONY Electronics'
    WHEN 3 THEN 'DeLonghi Appliances' WHEN 4 THEN 'iRobot Corp.' WHEN 5 THEN 'Bose Corporation'
    WHEN 6 THEN 'Instant Brands' WHEN 7 THEN 'Samsung Electronics' WHEN 8 THEN 'The Vitamix Corp.'
    WHEN 9 THEN 'Apple Inc.' WHEN 10 THEN 'Acme Tools' ELSE 'Generic' END AS manufacturer,
  LPAD(CAST(p_partkey AS STRING), 12, '0') AS upc_code,
  CASE WHEN p_partkey % 50 = 7 THEN 'N/A' ELSE CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS STRING) END AS list_price,
  CASE WHEN p_partkey % 7 = 0 THEN 'RAW_MATERIAL' ELSE 'FINISHED_GOOD' END AS item_type,
  CASE p_partkey % 6 WHEN 0 THEN 'VACUUM' WHEN 1 THEN 'KITCHEN' WHEN 2 THEN 'AUDIO' WHEN 3 THEN 'TELEVISION'
    WHEN 4 THEN 'PERSONAL' ELSE 'GARDEN' END AS item_subtype,
  CASE WHEN p_partkey % 40 = 3 THEN '' ELSE CAST(p_size AS STRING) || '.5' END AS weight,
  CASE p_partkey % 3 WHEN 0 THEN 'LBS' WHEN 1 THEN 'KG' ELSE NULL END AS weight_uom,
  CASE WHEN p_partkey % 10 = 9 THEN 'INACTIVE' ELSE 'ACTIVE' END AS item_status,
  CASE WHEN p_partkey % 45 = 11 THEN '2024-13-01 00:00:00'
    ELSE '2024-01-' || LPAD(CAST(p_partkey % 31 + 1 AS STRING), 2, '0') || ' 08:00:00' END AS created_date
FROM part""",
    "raw_erp_warehouse_inventory": """
SELECT LPAD(CAST(l_suppkey % 10 AS STRING), 2, '0') AS facility_code, CAST(l_partkey AS STRING) AS item_number,
  CAST(CAST(l_quantity AS INT) AS STRING) AS on_hand_qty, CAST(l_linenumber * 10 AS STRING) AS reorder_level,
  substr(CAST(l_shipdate AS STRING), 1, 10) || 'T00:00:00' AS last_cycle_count,
  substr(CAST(l_shipdate AS STRING), 1, 10) || ' ' || LPAD(CAST(l_orderkey % 24 AS STRING), 2, '0') || ':'
    || LPAD(CAST(l_orderkey % 60 AS STRING), 2, '0') || ':00' AS snapshot_ts
FROM lineitem""",
    "raw_partner_contracts": """
SELECT 'Partner ' || CAST(s_suppkey AS STRING) || CASE s_suppkey % 5 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' Corp.'
    WHEN 2 THEN ' Corporation' WHEN 3 THEN ' Co., Inc.' ELSE '' END AS partner_name,
  'shop' || CAST(s_suppkey AS STRING) || '.example.com' AS partner_domain, r_name || ' - ' || n_name AS partner_region,
  CASE s_suppkey % 3 WHEN 0 THEN 'ONLINE' WHEN 1 THEN 'RETAIL' ELSE 'MARKETPLACE' END AS channel_type,
  CASE s_suppkey % 4 WHEN 0 THEN 'PLATINUM' WHEN 1 THEN 'GOLD' ELSE 'SILVER' END AS tier_level,
  '2023-' || LPAD(CAST(s_suppkey % 12 + 1 AS STRING), 2, '0') || '-'
    || LPAD(CAST(s_suppkey % 28 + 1 AS STRING), 2, '0') AS effective_date,
  CASE WHEN s_suppkey % 7 = 4 THEN 'EXPIRED' ELSE 'ACTIVE' END AS contract_status
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "raw_erp_sales_orders": f"""
SELECT CAST(o_orderkey AS STRING) AS order_number, CAST(line AS STRING) AS order_line,
  CAST(l_partkey AS STRING) AS item_number, 'ACCT-' || CAST(o_custkey AS STRING) AS customer_account,
  substr(CAST(o_orderdate AS STRING), 1, 10) || 'T00:00:00Z' AS order_entered_date,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'WEB' WHEN '2' THEN 'STORE' WHEN '3' THEN 'PHONE'
    ELSE 'PARTNER' END AS sales_channel,
  CASE (l_orderkey + line * (l_orderkey % 3)) % 5 WHEN 0 THEN 'ENTERED' WHEN 1 THEN 'PROCESSING' WHEN 2 THEN 'SHIPPED'
    WHEN 3 THEN 'CLOSED' ELSE 'BACK ORDERED' END AS line_status,
  CASE WHEN line % 4 = 0 THEN '' ELSE substr(CAST(l_shipdate AS STRING), 1, 10) || 'T09:30:00Z' END AS actual_ship_date,
  CASE WHEN l_partkey % 97 = 0 THEN 'n/a' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS ordered_qty,
  CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING) AS unit_selling_price,
  CAST(CAST(l_discount * 100 AS DECIMAL(5,2)) AS STRING) AS line_discount_pct
FROM {_NUMBERED_LINES} JOIN orders ON l_orderkey = o_orderkey""",
    "raw_pos_transactions": """
SELECT substr(CAST(l_shipdate AS STRING), 1, 10) || ' 12:00:00' AS transaction_ts,
  CAST(l_partkey AS STRING) AS item_number, CAST(CAST(l_quantity AS INT) AS STRING) AS qty_sold,
  CASE WHEN l_partkey % 89 = 0 THEN 'VOID' ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING) END AS sale_amount,
  CASE l_returnflag WHEN 'R' THEN 'Y' WHEN 'N' THEN 'N' ELSE NULL END AS return_flag
FROM lineitem""",
    "raw_salesforce_accounts": """
SELECT '001Dn00000A' || LPAD(CAST(c_custkey AS STRING), 9, '0') AS sf_account_id,
  'First' || CAST(c_custkey % 100 AS STRING) AS first_name, c_name AS last_name,
  'c' || CAST(c_custkey AS STRING) || '@example.com' AS email_address,
  CASE c_custkey % 4 WHEN 0 THEN 'Customer - Direct' WHEN 1 THEN 'Customer - Channel' WHEN 2 THEN 'customer - direct'
    ELSE 'Prospect' END AS account_type,
  CASE WHEN c_custkey % 30 = 2 THEN 'unknown' ELSE CAST(CAST(c_acctbal * 10 AS DECIMAL(12,2)) AS STRING) END AS annual_revenue,
  (c_custkey % 20 = 0) AS is_deleted,
  '2023-' || LPAD(CAST(c_custkey % 12 + 1 AS STRING), 2, '0') || '-'
    || LPAD(CAST(c_custkey % 28 + 1 AS STRING), 2, '0') || 'T10:00:00.000Z' AS created_date,
  CASE c_nationkey % 7 WHEN 0 THEN 'New York' WHEN 1 THEN 'Georgia' WHEN 2 THEN 'Ohio' WHEN 3 THEN 'California'
    WHEN 4 THEN 'Texas' WHEN 5 THEN 'Alaska' ELSE NULL END AS billing_state
FROM customer""",
    "raw_salesforce_cases": """
SELECT '500Dn' || LPAD(CAST(event_id AS STRING), 12, '0') AS sf_case_id,
  '001Dn00000A' || LPAD(CAST(user_id AS STRING), 9, '0') AS sf_account_id,
  CASE WHEN event_id % 8 = 0 THEN NULL ELSE CAST(event_id % 2000 AS STRING) END AS product_sku,
  CASE event_type WHEN 'view' THEN 'Information' WHEN 'error' THEN 'Defect' WHEN 'purchase' THEN 'Billing'
    WHEN 'click' THEN 'Return' ELSE 'Setup' END AS case_type,
  CASE event_id % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'medium' ELSE 'Low' END AS case_priority,
  CASE event_id % 4 WHEN 0 THEN 'Open' WHEN 1 THEN 'In Progress' ELSE 'Closed' END AS case_status,
  substr(CAST(ts AS STRING), 1, 19) AS created_date,
  CASE WHEN event_id % 4 >= 2 THEN '2024-02-01 00:00:00' ELSE NULL END AS closed_date
FROM events""",
    "raw_netsuite_gl": """
SELECT CAST(4000 + s_suppkey AS STRING) AS account_number,
  s_name || CASE s_suppkey % 3 WHEN 0 THEN ' - Direct' WHEN 1 THEN ' - Marketplace' ELSE '' END AS account_name,
  CASE s_suppkey % 5 WHEN 0 THEN 'Income' WHEN 1 THEN 'Cost of Sales' WHEN 2 THEN 'Expense' WHEN 3 THEN 'Other Income'
    ELSE 'Equity' END AS account_type_name,
  'DEPT-' || CAST(n_regionkey AS STRING) AS department_name,
  (s_suppkey % 25 = 10) AS is_summary, (s_suppkey % 25 = 11) AS is_inactive
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "raw_netsuite_journal_entries": """
SELECT substr('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC', CAST(month(l_shipdate) * 3 - 2 AS INT), 3) || '-'
    || CAST(year(l_shipdate) AS STRING) AS posting_period,
  CAST(4000 + l_suppkey AS STRING) AS account_number,
  CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS STRING) END AS debit_amount,
  CASE WHEN l_suppkey % 5 = 0 THEN CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS STRING) ELSE '' END AS credit_amount,
  (l_linenumber <> 4) AS is_posted
FROM lineitem""",
    "raw_sap_vendors": """
SELECT LPAD(CAST(s_suppkey AS STRING), 10, '0') AS vendor_number, s_name AS vendor_name_1,
  CASE s_nationkey % 8 WHEN 0 THEN 'MY' WHEN 1 THEN 'US' WHEN 2 THEN 'JP' WHEN 3 THEN 'IT' WHEN 4 THEN 'CN'
    WHEN 5 THEN 'KR' WHEN 6 THEN 'DE' ELSE NULL END AS country_key,
  CASE WHEN s_suppkey % 13 = 5 THEN 'TBD' ELSE CAST(s_suppkey % 45 AS STRING) END AS avg_lead_time_days,
  CASE s_suppkey % 5 WHEN 0 THEN 'Z030' WHEN 1 THEN 'Z045' WHEN 2 THEN 'Z060' WHEN 3 THEN 'Z090'
    ELSE NULL END AS payment_terms_key,
  CASE s_suppkey % 11 WHEN 0 THEN 'X' WHEN 1 THEN NULL ELSE '' END AS deletion_flag
FROM supplier""",
    "raw_sap_purchase_orders": f"""
SELECT '45' || LPAD(CAST(l_orderkey AS STRING), 12, '0') AS po_number, CAST(10 * line AS STRING) AS po_line,
  LPAD(CAST(l_suppkey AS STRING), 10, '0') AS vendor_number, CAST(l_partkey AS STRING) AS material_number,
  CAST(CAST(l_quantity AS INT) AS STRING) AS po_qty, CAST(CAST(l_extendedprice AS DECIMAL(10,2)) AS STRING) AS net_price,
  substr(CAST(l_shipdate AS STRING), 1, 10) AS doc_date,
  CASE WHEN l_orderkey % 17 = 0 THEN 'TBD' ELSE substr(CAST(l_shipdate AS STRING), 1, 8) || '28' END AS delivery_date,
  CASE l_orderkey % 4 WHEN 0 THEN 'FULLY_RECEIVED' WHEN 1 THEN 'IN_TRANSIT' WHEN 2 THEN 'ORDERED'
    ELSE 'CANCELLED' END AS po_status
FROM {_NUMBERED_LINES}""",
    # Which partner was seen selling which product: one row per sale, so pairs repeat.
    "raw_listings": """
SELECT 'SKU-' || LPAD(CAST(l_partkey AS STRING), CAST(GREATEST(5, LENGTH(CAST(l_partkey AS STRING))) AS INT), '0') AS sku_id,
  'shop' || CAST(l_suppkey AS STRING) || '.example.com' AS website_domain
FROM lineitem""",
    # One answer per supplier, some of which no reader can take: half a character, a huge number, deep nesting.
    "raw_broken_responses": """
SELECT s_suppkey, CASE s_suppkey % 50 WHEN 0 THEN '{"listed_price": "' || chr(92) || 'ud83d"}'
    WHEN 1 THEN '{"listed_price": ' || repeat('9', 5000) || '}'
    WHEN 2 THEN repeat('{"a": ', 20000) || '0' || repeat('}', 20000)
    ELSE 'Found: {"listed_price": ' || CAST(s_suppkey AS STRING) || '}' END AS output_text
FROM supplier""",
    # One provider answer per pair with a sale that stayed sold: prose, JSON, broken JSON. Other pairs have none.
    "raw_agent_responses": """
SELECT sku_id, website_domain,
  CASE k WHEN 0 THEN 'No listing could be located for this product.'
    WHEN 1 THEN '{"listed_price": null, "discount": null, "listing_url": null}'
    WHEN 2 THEN 'Result: {"listed_price": "N/A", "discount": 0, "listing_url": "https://' || website_domain || '/p/' || sku_id || '"}'
    WHEN 3 THEN 'Partial answer {"listed_price": ' || price || ', "listing_url": "https://' || website_domain || '/p/' || sku_id || '"}'
    WHEN 4 THEN 'First try {oops} then {"listed_price": ' || price || ', "discount": 0.05, "listing_url": "https://'
      || website_domain || '/p/' || sku_id || '"}'
    WHEN 5 THEN '{"listed_price": -1.00, "discount": 0, "listing_url": "https://' || website_domain || '/p/' || sku_id || '"}'
    ELSE 'Here is what I found: {"Listed Price": ' || price || ', "Discount": 0.10, "listing_url": "https://'
      || website_domain || '/p/' || sku_id || '"} Hope this helps.' END AS output_text
FROM (SELECT 'SKU-' || LPAD(CAST(p_partkey AS STRING), CAST(GREATEST(5, LENGTH(CAST(p_partkey AS STRING))) AS INT), '0') AS sku_id,
        'shop' || CAST(l_suppkey AS STRING) || '.example.com' AS website_domain, (p_partkey * 7 + l_suppkey * 13) % 20 AS k,
        CAST(CAST(CAST(p_retailprice AS DECIMAL(10,2)) * (80 + (p_partkey * 3 + l_suppkey) % 41)
          * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(10,2)) AS STRING) AS price
      FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'R') t
      JOIN part ON l_partkey = p_partkey) b""",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def feed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A raw feed over the parquet tables in ``folder``; no view of the caller is touched."""
    named = re.compile(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b")
    return spark.sql(named.sub(lambda m: f"{m[1]} parquet.`{folder}/{m[2]}.parquet`", FEEDS[name]))
