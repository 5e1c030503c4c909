"""Refresh of each business domain: transforms in their order of dependency, merges, then the checks.

``raw`` gives a raw feed by its name, so a caller decides where feeds live. Every function returns the check
rows of its domain; the checks read the published tables, so nothing is computed twice.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

from millrace.operators import checks, crm, finance, inventory, prices, sales, supply
from millrace.sources.tables import Warehouse

Raw = Callable[[str], DataFrame]


def _all(*rows: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rows)


def refresh_sales(wh: Warehouse, raw: Raw, as_of: dt.date) -> DataFrame:
    lines = raw("raw_erp_sales_orders")
    orders = wh.merge_into("sales.orders", sales.orders(lines))
    items = wh.merge_into("sales.order_items", sales.order_items(lines))
    summary = wh.merge_into("sales.daily_sales_summary", sales.daily_sales_summary(raw("raw_pos_transactions")))
    return _all(checks.items_have_headers(items, orders), checks.revenue_believable(summary, as_of))


def refresh_inventory(wh: Warehouse, raw: Raw) -> DataFrame:
    products = raw("raw_erp_products")
    skus = wh.merge_into("inventory.skus", inventory.skus(products))
    wh.merge_into("inventory.product_categories", inventory.product_categories(products))
    stock = wh.merge_into("inventory.warehouse_stock", inventory.warehouse_stock(raw("raw_erp_warehouse_inventory")))
    wh.merge_into("inventory.distributors", inventory.distributors(raw("raw_partner_contracts")))
    return _all(checks.skus_present(skus), checks.stock_present(stock))


def refresh_crm(wh: Warehouse, raw: Raw) -> DataFrame:
    accounts = raw("raw_salesforce_accounts")
    customers = wh.merge_into("crm.customers", crm.customers(accounts))
    tickets = crm.support_tickets(raw("raw_salesforce_cases"), customers)
    tickets = wh.merge_into("crm.support_tickets", tickets)
    return _all(checks.no_deleted_customers(customers, accounts), checks.tickets_have_customers(tickets, customers))


def refresh_finance(wh: Warehouse, raw: Raw) -> DataFrame:
    accounts = wh.merge_into("finance.gl_accounts", finance.gl_accounts(raw("raw_netsuite_gl")))
    pnl = finance.monthly_pnl(raw("raw_netsuite_journal_entries"), accounts)
    pnl = wh.merge_into("finance.monthly_pnl", pnl)
    return _all(checks.pnl_margin_positive(pnl, accounts), checks.pnl_accounts_known(pnl, accounts))


def refresh_supply_chain(wh: Warehouse, raw: Raw) -> DataFrame:
    suppliers = wh.merge_into("supply_chain.suppliers", supply.suppliers(raw("raw_sap_vendors")))
    purchases = wh.merge_into("supply_chain.purchase_orders", supply.purchase_orders(raw("raw_sap_purchase_orders")))
    return _all(checks.purchase_suppliers_known(purchases, suppliers), checks.purchase_amounts_positive(purchases))


def refresh_prices(wh: Warehouse, raw: Raw, run_at: dt.datetime) -> DataFrame:
    """Needs the inventory domain. Prices are written before they are checked."""
    skus, distributors = wh.table("inventory.skus"), wh.table("inventory.distributors")
    base = prices.price_base(raw("raw_listings"), skus, distributors)
    priced = prices.distributor_prices(base, raw("raw_agent_responses"), run_at)
    published = wh.full_refresh(prices.TABLE, priced, run_at)
    return _all(
        checks.price_row_count(published, skus, distributors),
        checks.price_fill_rate(published),
        checks.price_range(published),
    )


def refresh_all(wh: Warehouse, raw: Raw, as_of: dt.date, run_at: dt.datetime) -> DataFrame:
    wh.create_schemas()
    return _all(
        refresh_inventory(wh, raw),
        refresh_sales(wh, raw, as_of),
        refresh_crm(wh, raw),
        refresh_finance(wh, raw),
        refresh_supply_chain(wh, raw),
        refresh_prices(wh, raw, run_at),
    )
