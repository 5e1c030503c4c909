"""Earlier table states for the merge queries, as portable SQL over the curated tables.

Each stands for a table loaded before today's feed: part of today's rows are there with stale values, the
others are still missing, and two rows are no longer in the feed.
"""

PRIOR_STATE = {
    "sales_orders": """SELECT order_id, customer_id, order_date, channel, total_amount, 'PENDING' AS status,
      CAST(NULL AS DATE) AS ship_date FROM sales_orders WHERE order_date < DATE '1998-01-01'
    UNION ALL SELECT 'ORD-OLD-1', 'CUST-0', DATE '1990-01-01', 'WEB', CAST(10 AS DECIMAL(18,2)), 'DELIVERED', DATE '1990-02-01'
    UNION ALL SELECT 'ORD-OLD-2', 'CUST-0', DATE '1990-01-02', 'STORE', CAST(20 AS DECIMAL(18,2)), 'SHIPPED', NULL""",
    "sales_order_items": """SELECT order_id, line_number, sku_id, quantity + 1 AS quantity, unit_price,
      CAST(NULL AS DECIMAL(5,2)) AS discount_pct FROM sales_order_items WHERE discount_pct < 5
    UNION ALL SELECT 'ORD-OLD-1', 1, 'SKU-00001', 1, CAST(10 AS DECIMAL(10,2)), CAST(0 AS DECIMAL(5,2))
    UNION ALL SELECT 'ORD-OLD-2', 1, 'SKU-00002', 2, CAST(10 AS DECIMAL(10,2)), CAST(0 AS DECIMAL(5,2))""",
    "inventory_skus": """SELECT sku_id, product_name, 'Unknown' AS brand, upc, CAST(1 AS DECIMAL(10,2)) AS msrp, category,
      subcategory, weight_lbs, status, TIMESTAMP '2020-01-01 00:00:00' AS created_at
      FROM inventory_skus WHERE category = 'Home Appliances'
    UNION ALL SELECT 'SKU-OLD-1', 'old one', 'Dyson', NULL, NULL, 'Other', 'GARDEN', NULL, 'ACTIVE', NULL
    UNION ALL SELECT 'SKU-OLD-2', 'old two', 'Bose', NULL, NULL, 'Other', 'GARDEN', NULL, 'ACTIVE', NULL""",
    "inventory_distributors": """SELECT 'DIST-9' || right(distributor_id, 2) AS distributor_id, distributor_name, website_domain,
      region, 'UNKNOWN' AS channel, partnership_tier, contract_start, status
      FROM inventory_distributors WHERE region IN ('ASIA', 'EUROPE')
    UNION ALL SELECT 'DIST-801', 'Old One', 'old1.example.com', 'ASIA', 'RETAIL', 'GOLD', DATE '2020-01-01', 'ACTIVE'
    UNION ALL SELECT 'DIST-802', 'Old Two', 'old2.example.com', 'ASIA', 'RETAIL', 'GOLD', NULL, 'ACTIVE'""",
    "sales_daily_sales_summary": """SELECT sale_date, sku_id, units_sold + 1 AS units_sold, CAST(0 AS DECIMAL(18,2)) AS gross_revenue,
      returns FROM sales_daily_sales_summary WHERE returns = 0
    UNION ALL SELECT DATE '1990-01-01', 'SKU-OLD-1', CAST(1 AS BIGINT), CAST(5 AS DECIMAL(18,2)), CAST(0 AS BIGINT)
    UNION ALL SELECT DATE '1990-01-02', 'SKU-OLD-2', CAST(2 AS BIGINT), NULL, NULL""",
    "inventory_product_categories": """SELECT 'CAT-9' || right(category_id, 2) AS category_id, category_name, parent_category,
      'Closed' AS department FROM inventory_product_categories WHERE parent_category IS NOT NULL
    UNION ALL SELECT 'CAT-801', 'Old One', 'Other', 'Closed'
    UNION ALL SELECT 'CAT-802', 'Old Two', NULL, NULL""",
    "inventory_warehouse_stock": """SELECT warehouse_id, sku_id, 0 AS quantity_on_hand, reorder_point, CAST(NULL AS DATE) AS last_counted
      FROM inventory_warehouse_stock WHERE quantity_on_hand > 10
    UNION ALL SELECT 'WH-OLD', 'SKU-OLD-1', 1, 2, DATE '1990-01-01'
    UNION ALL SELECT 'WH-OLD', 'SKU-OLD-2', NULL, NULL, NULL""",
    "crm_customers": """SELECT customer_id, first_name, 'Before' AS last_name, email, segment, lifetime_value, signup_date, 'Other' AS region
      FROM crm_customers WHERE segment = 'Premium'
    UNION ALL SELECT 'CUST-OLD-1', 'Old', 'One', NULL, 'VIP', NULL, DATE '1990-01-01', 'West'
    UNION ALL SELECT 'CUST-OLD-2', 'Old', 'Two', NULL, 'Standard', NULL, NULL, 'Other'""",
    "crm_support_tickets": """SELECT ticket_id, customer_id, sku_id, issue_type, 'LOW' AS priority, 'OPEN' AS status, created_at,
      CAST(NULL AS TIMESTAMP) AS resolved_at FROM crm_support_tickets WHERE status = 'RESOLVED'
    UNION ALL SELECT 'TKT-OLD-1', NULL, 'SKU-00001', 'Defect', 'LOW', 'OPEN', NULL, NULL
    UNION ALL SELECT 'TKT-OLD-2', 'CUST-0', NULL, 'Defect', 'LOW', 'OPEN', NULL, NULL""",
    "finance_gl_accounts": """SELECT account_id, account_name, 'EXPENSE' AS account_type, 'Unknown' AS department
      FROM finance_gl_accounts WHERE account_type = 'REVENUE'
    UNION ALL SELECT 'GL-OLD-1', 'old one', 'EXPENSE', NULL
    UNION ALL SELECT 'GL-OLD-2', 'old two', 'REVENUE', NULL""",
    "finance_monthly_pnl": """SELECT period, account_id, CAST(0 AS DECIMAL(18,2)) AS amount FROM finance_monthly_pnl WHERE period < '1998'
    UNION ALL SELECT '1990-01', 'GL-OLD-1', CAST(1 AS DECIMAL(18,2))
    UNION ALL SELECT '1990-01', 'GL-OLD-2', NULL""",
    "supply_suppliers": """SELECT supplier_id, supplier_name, country, 0 AS lead_time_days, payment_terms, 'INACTIVE' AS status
      FROM supply_suppliers WHERE payment_terms = 'NET-30'
    UNION ALL SELECT 'SUP-OLD-1', 'Old One', 'Italy', 1, 'NET-30', 'ACTIVE'
    UNION ALL SELECT 'SUP-OLD-2', 'Old Two', NULL, NULL, 'NET-30', 'ACTIVE'""",
    "supply_purchase_orders": """SELECT po_id, supplier_id, sku_id, quantity + 1 AS quantity, unit_cost, order_date,
      CAST(NULL AS DATE) AS expected_date, 'OPEN' AS status FROM supply_purchase_orders WHERE status = 'RECEIVED'
    UNION ALL SELECT 'PO-OLD-1', 'SUP-OLD-1', 'SKU-00001', 1, CAST(1 AS DECIMAL(10,2)), DATE '1990-01-01', NULL, 'OPEN'
    UNION ALL SELECT 'PO-OLD-2', 'SUP-OLD-2', NULL, NULL, NULL, NULL, NULL, 'OPEN'""",
}

# A day feed whose dates could not be read on days without sales: those rows have no key.
UNREADABLE_DATES = """SELECT CASE WHEN units_sold = 0 THEN NULL ELSE sale_date END AS sale_date, sku_id, units_sold,
  gross_revenue, returns FROM sales_daily_sales_summary"""
