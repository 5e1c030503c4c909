"""The DuckDB text for each registered query."""

from __future__ import annotations

from millrace.sources.prior_state import PRIOR_STATE, UNREADABLE_DATES
from millrace import schemas
from millrace.expected.compose import compose
from millrace.expected.curated import number, sku

SEVERITY = """SELECT order_id, customer_id, order_date, channel, CAST(sum(amount) AS decimal(18,2)) AS total_amount,
  max(CASE stage WHEN 1 THEN 'PENDING' WHEN 2 THEN 'PROCESSING' WHEN 3 THEN 'SHIPPED' WHEN 4 THEN 'DELIVERED'
    ELSE CASE WHEN line_status NOT IN ('ENTERED', 'PROCESSING', 'SHIPPED', 'CLOSED') THEN title END END) AS status,
  max(ship_date) AS ship_date
FROM order_lines GROUP BY order_id, customer_id, order_date, channel"""

def merged(table: str, target: str, source: str) -> str:
    """Merge result spelled out: matched rows from the source, kept columns and unmatched rows from the target."""
    keys, kept = schemas.KEYS[table], schemas.KEPT_ON_UPDATE.get(table, [])
    columns = schemas.curated_columns(table)
    picks = []
    for c in columns:
        if c in keys or c in kept:
            picks.append(f"CASE WHEN t.here IS NOT NULL THEN t.{c} ELSE s.{c} END AS {c}")
        else:
            picks.append(f"CASE WHEN s.here IS NOT NULL THEN s.{c} ELSE t.{c} END AS {c}")
    on = " AND ".join(f"t.{k} = s.{k}" for k in keys)
    return (
        f"SELECT {', '.join(picks)} FROM (SELECT *, 1 AS here FROM {target}) t "
        f"FULL OUTER JOIN (SELECT *, 1 AS here FROM {source}) s ON {on}"
    )


def merge_query(view: str, table: str) -> str:
    return compose(merged(table, "prior_state", view), prior_state=PRIOR_STATE[view])


def check(name: str, one: str, passed: str, otherwise: str, observed: str, good: str = "'PASS'") -> str:
    return compose(
        f"SELECT '{name}' AS check_name, CASE WHEN {passed} THEN {good} ELSE {otherwise} END AS check_result, "
        f"CAST({observed} AS varchar) AS observed FROM ({one}) o"
    )


def none_found(name: str, found: str, level: str, what: str) -> str:
    return check(name, f"SELECT count(*) AS n FROM {found}", "n = 0", f"'{level}: ' || n || ' {what}'", "n")


def orphans(many: str, one: str, key: str) -> str:
    return f"{many} m LEFT JOIN {one} o2 ON m.{key} = o2.{key} WHERE o2.{key} IS NULL"


def key_health(table: str) -> str:
    keys, cte = schemas.KEYS[table], table.replace("supply_chain.", "supply_").replace(".", "_")
    any_null = " OR ".join(f"{k} IS NULL" for k in keys)
    return (
        f"SELECT 'key_health {table}' AS check_name, CASE WHEN nulls = 0 AND clashes = 0 THEN 'PASS' ELSE 'WARN: ' || nulls "
        "|| ' rows with a NULL key, ' || clashes || ' keys held by several rows' END AS check_result, "
        "CAST(nulls + clashes AS varchar) AS observed FROM (SELECT CAST(coalesce(sum(CASE WHEN k0 THEN n END), 0) AS bigint) "
        "AS nulls, count(CASE WHEN NOT k0 AND n > 1 THEN 1 END) AS clashes FROM "
        f"(SELECT ({any_null}) AS k0, count(*) AS n FROM {cte} GROUP BY {', '.join(keys)}, k0) g) o"
    )


def key_collisions(name: str, raw: str, full: str, short: str) -> str:
    return (
        f"SELECT 'key_collisions {name}' AS check_name, CASE WHEN n = 0 THEN 'PASS' ELSE 'WARN: ' || n || "
        f"' short keys stand for several source keys' END AS check_result, CAST(n AS varchar) AS observed FROM "
        f"(SELECT count(*) AS n FROM (SELECT {short} AS short FROM {raw} GROUP BY 1 HAVING count(DISTINCT {full}) > 1) c) o"
    )


MARGIN = """SELECT min(margin) AS low FROM (SELECT CAST(sum(CASE g.account_type WHEN 'REVENUE' THEN p.amount
    WHEN 'EXPENSE' THEN -p.amount ELSE 0 END) AS decimal(18,2)) AS margin
  FROM finance_monthly_pnl p JOIN finance_gl_accounts g ON g.account_id = p.account_id GROUP BY p.period) m"""
LIVE = "raw_salesforce_accounts WHERE is_deleted = FALSE AND account_type ILIKE 'Customer%'"

REQUESTS = r"""SELECT sku_id, website_domain,
  '{"sku_id":"' || sku_id || '","product_name":"' || product_name || '","brand":"' || brand || '","upc":"' || upc || '"'
    || CASE WHEN msrp IS NULL THEN '' ELSE ',"msrp":' || CAST(msrp AS varchar) END || ',"distributor_id":"' || distributor_id
    || '","distributor_name":"' || distributor_name || '","website_domain":"' || website_domain || '"}' AS input_json,
  'Find the following information: [listed_price, discount, listing_url] for the entity described by: sku_id: ' || sku_id
    || ', product_name: ' || product_name || ', brand: ' || brand || ', upc: ' || upc || CASE WHEN msrp IS NULL THEN ''
      ELSE ', msrp: ' || regexp_replace(regexp_replace(CAST(msrp AS varchar), '(\.[0-9]*?)0+$', '\1'), '\.$', '') END
    || ', distributor_id: ' || distributor_id || ', distributor_name: ' || distributor_name || ', website_domain: '
    || website_domain || '. Return a JSON object with these exact keys: ["listed_price", "discount", "listing_url"]. '
    || 'Use "Not found" for any field you cannot determine.' AS request
FROM price_base"""
CAPPED = """CASE WHEN length(text) > {n} THEN left(text, {n}) || chr(10) || chr(10) || '[OUTPUT TRUNCATED]' ELSE text END"""
LONG = " + ".join(f"coalesce(CAST(length({c}) > {n} AS integer), 0)" for c, n in schemas.PRICE_TEXT_LENGTHS.items())

EXPECTED = {
    "sales_orders": compose("SELECT * FROM sales_orders"),
    "sales_orders_severity": compose(SEVERITY),
    "sales_order_items": compose("SELECT * FROM sales_order_items"),
    "daily_sales_summary": compose("SELECT * FROM sales_daily_sales_summary"),
    "skus": compose("SELECT * FROM inventory_skus"),
    "product_categories": compose("SELECT * FROM inventory_product_categories"),
    "distributors": compose("SELECT * FROM inventory_distributors"),
    "warehouse_stock": compose("SELECT * FROM inventory_warehouse_stock"),
    "customers": compose("SELECT * FROM crm_customers"),
    "support_tickets": compose("SELECT * FROM crm_support_tickets"),
    "gl_accounts": compose("SELECT * FROM finance_gl_accounts"),
    "monthly_pnl": compose("SELECT * FROM finance_monthly_pnl"),
    "suppliers": compose("SELECT * FROM supply_suppliers"),
    "purchase_orders": compose("SELECT * FROM supply_purchase_orders"),
    "upsert_orders": merge_query("sales_orders", "sales.orders"),
    "upsert_order_items": merge_query("sales_order_items", "sales.order_items"),
    "upsert_skus": merge_query("inventory_skus", "inventory.skus"),
    "upsert_distributors": merge_query("inventory_distributors", "inventory.distributors"),
    "upsert_daily_sales_summary": merge_query("sales_daily_sales_summary", "sales.daily_sales_summary"),
    "upsert_product_categories": merge_query("inventory_product_categories", "inventory.product_categories"),
    "upsert_warehouse_stock": merge_query("inventory_warehouse_stock", "inventory.warehouse_stock"),
    "upsert_customers": merge_query("crm_customers", "crm.customers"),
    "upsert_support_tickets": merge_query("crm_support_tickets", "crm.support_tickets"),
    "upsert_gl_accounts": merge_query("finance_gl_accounts", "finance.gl_accounts"),
    "upsert_monthly_pnl": merge_query("finance_monthly_pnl", "finance.monthly_pnl"),
    "upsert_suppliers": merge_query("supply_suppliers", "supply_chain.suppliers"),
    "upsert_purchase_orders": merge_query("supply_purchase_orders", "supply_chain.purchase_orders"),
    "upsert_null_keys": compose(merged("sales.daily_sales_summary", "first_run", "first_run"), first_run=UNREADABLE_DATES),
    "check_skus": check("validate_skus", "SELECT count(*) AS n FROM inventory_skus WHERE status = 'ACTIVE'", "n > 0",
                        "'FAIL: SKUS table is empty after transform'", "n"),
    "check_stock": check("validate_stock", "SELECT count(*) AS n FROM inventory_warehouse_stock", "n > 0",
                         "'FAIL: WAREHOUSE_STOCK has no records'", "n"),
    "check_orders": none_found("validate_orders", orphans("sales_order_items", "sales_orders", "order_id"), "WARN",
                               "orphaned order items found"),
    "check_revenue": check("validate_revenue", "SELECT max(gross_revenue) AS top FROM sales_daily_sales_summary "
                           "WHERE sale_date >= DATE '2001-11-04' - INTERVAL 7 DAY", "top < 500000",
                           "'WARN: Unusually high daily revenue detected'", "top"),
    "check_no_deleted_customers": check("validate_no_deleted_customers", "SELECT (SELECT count(*) FROM crm_customers) AS a, "
                                        f"(SELECT count(*) FROM {LIVE}) AS b", "a = b",
                                        "'WARN: Customer count mismatch vs source'", "a"),
    "check_ticket_customer_fk": none_found("validate_ticket_customer_fk", orphans("crm_support_tickets", "crm_customers",
                                           "customer_id") + " AND m.customer_id IS NOT NULL", "WARN",
                                           "tickets with unknown customer"),
    "check_pnl_balance": check("validate_pnl_balance", MARGIN, "low > 0", "'WARN: Some periods show negative gross margin'", "low"),
    "check_gl_coverage": none_found("validate_gl_coverage", orphans("finance_monthly_pnl", "finance_gl_accounts", "account_id"),
                                    "FAIL", "P&L entries with unknown GL account"),
    "check_supplier_fk": none_found("validate_supplier_fk", orphans("supply_purchase_orders", "supply_suppliers", "supplier_id"),
                                    "FAIL", "POs with unknown supplier"),
    "check_po_amounts": none_found("validate_po_amounts", "supply_purchase_orders WHERE quantity < 0 OR unit_cost < 0", "FAIL",
                                   "POs with negative values"),
    "check_key_health": compose(" UNION ALL ".join(key_health(t) for t in schemas.KEYS)),
    "check_key_collisions": compose(" UNION ALL ".join([
        key_collisions("skus", "raw_erp_products", "item_number", sku("item_number")),
        key_collisions("support_tickets", "raw_salesforce_cases", "sf_case_id", number("sf_case_id", 4)),
        key_collisions("suppliers", "raw_sap_vendors", "vendor_number", number("vendor_number", 3)),
        key_collisions("purchase_orders", "raw_sap_purchase_orders", "po_number", number("po_number", 4)),
    ])),
    "check_key_collisions_cut": compose(" UNION ALL ".join([
        key_collisions("skus", "raw_erp_products", "item_number", "lpad(item_number, 5, '0')"),
        key_collisions("support_tickets", "raw_salesforce_cases", "sf_case_id", "right(sf_case_id, 4)"),
        key_collisions("suppliers", "raw_sap_vendors", "vendor_number", "right(vendor_number, 3)"),
        key_collisions("purchase_orders", "raw_sap_purchase_orders", "po_number", "right(po_number, 4)"),
    ])),
    "sku_distributor_base": compose("SELECT * FROM price_base"),
    "enrich_requests": compose(REQUESTS),
    "enrich_input_hygiene": "SELECT event_id, CASE WHEN event_type IN ('error', 'signup', 'click') THEN '{}' ELSE props END "
                            "AS entity FROM events",
    "parse_broken_responses": "SELECT s_suppkey, s_suppkey % 50 < 3 AS failed, CASE WHEN s_suppkey % 50 >= 3 THEN "
                              "CAST(s_suppkey AS varchar) END AS listed_price FROM supplier",
    "parse_responses": compose("SELECT * FROM parsed"),
    "distributor_prices": compose("SELECT * FROM distributor_prices"),
    "enrich_companies": "SELECT c_custkey, c_name AS name, c_mktsegment AS segment, 'Not found' AS ceo, "
                        "TIMESTAMP '2025-04-01 06:00:00' AS enriched_at FROM customer",
    "enrich_udtf": "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name END AS product_name, CASE WHEN p_size > 25 THEN p_brand "
                   "END AS brand, CASE WHEN p_size > 25 THEN NULL ELSE p_brand END AS brand_as_asked FROM part",
    "enrich_scalar": "SELECT s_suppkey, s_name AS name, 'Not found' AS site, 'No output columns specified' AS error FROM supplier",
    "variant_paths": compose("SELECT sku_id, msrp, brand, CAST(NULL AS varchar) AS absent FROM inventory_skus"),
    "last_assistant_text": "SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY 1",
    "message_blocks": "SELECT conv_id, turn, text || chr(10) || 'turn ' || CAST(turn AS varchar) AS text FROM conversations",
    "tool_output_cap": f"SELECT doc_id, md5({CAPPED.format(n=80000)}) AS capped, md5({CAPPED.format(n=1000)}) AS capped_short, "
                       f"CAST(length({CAPPED.format(n=1000)}) AS integer) AS n FROM documents",
    "check_row_count": check("validate_row_count", "SELECT (SELECT count(*) FROM inventory_skus) * (SELECT count(*) FROM "
                             "inventory_distributors) AS e, (SELECT count(*) FROM distributor_prices) AS n", "n = e",
                             "'WARN: Expected ' || e || ' but got ' || n", "n", "'PASS: ' || e || ' rows as expected'"),
    "check_no_nulls": check("validate_no_nulls", "SELECT count(*) AS n, count(listed_price) AS p FROM distributor_prices",
                            "p >= 0.8 * n", "'WARN: More than 20% of prices are NULL'", "p"),
    "check_price_range": none_found("validate_price_range", "distributor_prices WHERE listed_price < 0 OR listed_price > msrp * 10",
                                    "FAIL", "rows with suspicious prices"),
    "check_length_contract": check("length_contract", f"SELECT CAST(coalesce(sum({LONG}), 0) AS bigint) AS n FROM "
                                   "distributor_prices", "n = 0", "'FAIL: ' || n || ' values longer than their column'", "n"),
    "page_text": compose("SELECT * FROM plain_pages"),
    "site_search": compose("SELECT request_id, CAST(rank AS integer) AS rank, page_id, url, hits, array_to_string(w[greatest(first_at - 5, 1):"
                           "greatest(first_at - 5, 1) + 19], ' ') AS snippet FROM found_pages JOIN page_words USING (page_id)"),
    "site_context": compose("SELECT request_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM (SELECT "
                            f"request_id, rank, text FROM found_pages JOIN page_words "
                            "USING (page_id)) c GROUP BY 1"),
}

DOMAIN_CHECKS = ["skus", "stock", "orders", "revenue", "no_deleted_customers", "ticket_customer_fk", "pnl_balance", "gl_coverage",
                 "supplier_fk", "po_amounts", "row_count", "no_nulls", "price_range"]
EXPECTED |= {
    "full_refresh_prices": EXPECTED["distributor_prices"],
    "upsert_orders_stored": EXPECTED["upsert_orders"],
    "upsert_order_items_stored": EXPECTED["upsert_order_items"],
    "warehouse_refresh": " UNION ALL ".join(f"(SELECT * FROM ({EXPECTED['check_' + c]}) x)" for c in DOMAIN_CHECKS),
    "stream_orders": EXPECTED["sales_orders"],
    "stream_stock": EXPECTED["warehouse_stock"],
    "enrich_pairs": compose("SELECT sku_id, distributor_id, brand, website_domain, 'Not found' AS listed_price FROM price_base"),
    "enrich_events": "SELECT event_id, user_id, event_type AS kind, 'Not found' AS meaning FROM events",
    "enrich_prompts": "SELECT p_partkey, CASE WHEN p_size > 40 THEN upper(p_name) ELSE p_name END AS product_name, "
                      "CASE WHEN p_size > 40 THEN upper(p_brand) ELSE p_brand END AS brand FROM part",
    "enrich_inline_saved": "SELECT c_mktsegment AS segment, c_custkey, sells, ceo, run_id, enriched_at FROM customer LEFT JOIN (SELECT *, "
                           "'Not found' AS ceo, 'run-2' AS run_id, TIMESTAMP '2025-04-01 06:00:00' AS enriched_at FROM (VALUES "
                           "('AUTOMOBILE', 'cars'), ('BUILDING', 'houses'), ('FURNITURE', 'chairs'), ('HOUSEHOLD', 'pans')) v(segment, sells)) "
                           "ON segment = c_mktsegment",
    "distributor_prices_provider": compose(
        "SELECT sku_id, product_name, brand, upc, msrp, distributor_id, distributor_name, website_domain, listed_price, "
        "CAST(CASE WHEN msrp <> 0 THEN round((CAST(listed_price AS double) - CAST(msrp AS double)) / CAST(msrp AS double), 4) END AS "
        "decimal(8,4)) AS price_deviation_pct, CAST(0.10 AS decimal(5,2)) AS discount, 'https://' || website_domain || '/p/' || sku_id "
        "AS listing_url, TIMESTAMP '2025-04-01 06:00:00' AS enriched_at FROM (SELECT *, CAST(round(msrp * 0.9, 2) AS decimal(10,2)) AS "
        "listed_price FROM price_base) b"),
}
