"""Registered queries: name -> (spark, folder of parquet tables) -> DataFrame."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.sources.prior_state import PRIOR_STATE, UNREADABLE_DATES
from millrace import schemas
from millrace.functions import clean, codes
from millrace.operators import answers, checks, corpus, crm, enrich, finance, inventory, ledger, prices, sales, supply
from millrace.operators.upsert import upsert_curated
from millrace.plans import refresh
from millrace.session import shared_dir
from millrace.sources.feeds import feed, table
from millrace.sources.tables import Warehouse
from millrace.streaming import refresh as streaming

Query = Callable[[SparkSession, str], DataFrame]


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return sales.orders(feed(spark, folder, "raw_erp_sales_orders"))


def _orders_severity(spark: SparkSession, folder: str) -> DataFrame:
    return sales.orders(feed(spark, folder, "raw_erp_sales_orders"), rollup="severity")


def _order_items(spark: SparkSession, folder: str) -> DataFrame:
    return sales.order_items(feed(spark, folder, "raw_erp_sales_orders"))


def _daily_sales_summary(spark: SparkSession, folder: str) -> DataFrame:
    return sales.daily_sales_summary(feed(spark, folder, "raw_pos_transactions"))


def _skus(spark: SparkSession, folder: str) -> DataFrame:
    return inventory.skus(feed(spark, folder, "raw_erp_products"))


def _product_categories(spark: SparkSession, folder: str) -> DataFrame:
    return inventory.product_categories(feed(spark, folder, "raw_erp_products"))


def _distributors(spark: SparkSession, folder: str) -> DataFrame:
    return inventory.distributors(feed(spark, folder, "raw_partner_contracts"))


def _warehouse_stock(spark: SparkSession, folder: str) -> DataFrame:
    return inventory.warehouse_stock(feed(spark, folder, "raw_erp_warehouse_inventory"))


def _customers(spark: SparkSession, folder: str) -> DataFrame:
    return crm.customers(feed(spark, folder, "raw_salesforce_accounts"))


def _support_tickets(spark: SparkSession, folder: str) -> DataFrame:
    return crm.support_tickets(feed(spark, folder, "raw_salesforce_cases"), _customers(spark, folder))


def _gl_accounts(spark: SparkSession, folder: str) -> DataFrame:
    return finance.gl_accounts(feed(spark, folder, "raw_netsuite_gl"))


def _monthly_pnl(spark: SparkSession, folder: str) -> DataFrame:
    return finance.monthly_pnl(feed(spark, folder, "raw_netsuite_journal_entries"), _gl_accounts(spark, folder))


def _suppliers(spark: SparkSession, folder: str) -> DataFrame:
    return supply.suppliers(feed(spark, folder, "raw_sap_vendors"))


def _purchase_orders(spark: SparkSession, folder: str) -> DataFrame:
    return supply.purchase_orders(feed(spark, folder, "raw_sap_purchase_orders"))


def _over(spark: SparkSession, name: str, df: DataFrame, sql: str) -> DataFrame:
    """``sql`` with ``df`` in the place of the table ``name``; no view of the caller is touched."""
    return spark.sql(re.sub(rf"\bFROM {name}\b", f"FROM {{{name}}}", sql), **{name: df})


def _merge(build: Query, name: str, table: str, runs: int = 1) -> Query:
    """Merge today's rows of a curated table into its earlier state, which is stored if there is more than one run."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        today = build(spark, folder)
        target = schemas.conform(_over(spark, name, today, PRIOR_STATE[name]), table)
        if runs > 1:
            wh = _new_warehouse(spark)
            wh.replace(table, target)
            for _ in range(runs - 1):
                target = wh.merge_into(table, today)
        return upsert_curated(target, today, table)

    return run


def _merge_stored(build: Query, name: str, table: str, rows_per_part: int) -> Query:
    """As ``_merge`` into a table stored in parts: the index names those that the feed can hit, the others stay."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        wh = _new_warehouse(spark, {table: rows_per_part})
        with wh.staged(build(spark, folder)) as today:  # read for the earlier state and for the merge
            wh.replace(table, schemas.conform(_over(spark, name, today, PRIOR_STATE[name]), table), written=True)
            return wh.merge_into(table, today, written=True)

    return run


def _merge_null_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The second run of a feed with unreadable dates: rows without a key come in once more."""
    first = _over(spark, "sales_daily_sales_summary", _daily_sales_summary(spark, folder), UNREADABLE_DATES)
    return upsert_curated(first, first, "sales.daily_sales_summary")


AS_OF = dt.date(2001, 11, 4)  # last day of sales in the tables

CURATED: dict[str, Query] = {
    "sales.orders": _orders,
    "sales.order_items": _order_items,
    "sales.daily_sales_summary": _daily_sales_summary,
    "inventory.skus": _skus,
    "inventory.product_categories": _product_categories,
    "inventory.distributors": _distributors,
    "inventory.warehouse_stock": _warehouse_stock,
    "crm.customers": _customers,
    "crm.support_tickets": _support_tickets,
    "finance.gl_accounts": _gl_accounts,
    "finance.monthly_pnl": _monthly_pnl,
    "supply_chain.suppliers": _suppliers,
    "supply_chain.purchase_orders": _purchase_orders,
}


def _check(fn: Callable[..., DataFrame], *inputs: Query, **options) -> Query:
    return lambda spark, folder: fn(*[build(spark, folder) for build in inputs], **options)


def _raw(name: str) -> Query:
    return lambda spark, folder: feed(spark, folder, name)


def _check_key_health(spark: SparkSession, folder: str) -> DataFrame:
    rows = [checks.key_health(build(spark, folder), table) for table, build in CURATED.items()]
    return reduce(DataFrame.unionByName, rows)


def _check_key_collisions(spark: SparkSession, folder: str, cut_keys: bool = False) -> DataFrame:
    number = lambda p, c, n: clean.number_key(p, F.col(c), n, cut_keys)
    keys = [
        ("skus", "raw_erp_products", "item_number", clean.sku_key(F.col("item_number"), cut_keys)),
        ("support_tickets", "raw_salesforce_cases", "sf_case_id", number(codes.TICKET, "sf_case_id", 4)),
        ("suppliers", "raw_sap_vendors", "vendor_number", number(codes.SUPPLIER, "vendor_number", 3)),
        ("purchase_orders", "raw_sap_purchase_orders", "po_number", number(codes.PURCHASE, "po_number", 4)),
    ]
    rows = [checks.key_collisions(n, feed(spark, folder, raw), full, short) for n, raw, full, short in keys]
    return reduce(DataFrame.unionByName, rows)


def _check_key_collisions_cut(spark: SparkSession, folder: str) -> DataFrame:
    return _check_key_collisions(spark, folder, cut_keys=True)


RUN_AT = dt.datetime(2025, 4, 1, 6, 0, 0)


def _price_base(spark: SparkSession, folder: str) -> DataFrame:
    return prices.price_base(feed(spark, folder, "raw_listings"), _skus(spark, folder), _distributors(spark, folder))


def _enrich_requests(spark: SparkSession, folder: str) -> DataFrame:
    return prices.requests(_price_base(spark, folder))


def _parse_broken_responses(spark: SparkSession, folder: str) -> DataFrame:
    record = answers.parse_answer(F.col("output_text"), ["listed_price"])
    read = feed(spark, folder, "raw_broken_responses").select("s_suppkey", record.alias("r"))
    return read.select("s_suppkey", F.col("r.error").isNotNull().alias("failed"), "r.listed_price")


def _parse_responses(spark: SparkSession, folder: str) -> DataFrame:
    raw = feed(spark, folder, "raw_agent_responses")
    parsed = raw.withColumn("enriched", answers.parse_answer(F.col("output_text"), prices.FIELDS))
    picks = [F.col("enriched").getField(f).alias(f) for f in (*prices.FIELDS, "_raw")]
    return parsed.select(*prices.REQUEST_KEY, *picks)


def _distributor_prices(spark: SparkSession, folder: str) -> DataFrame:
    return prices.distributor_prices(_price_base(spark, folder), feed(spark, folder, "raw_agent_responses"), RUN_AT)


def _new_ledger(spark: SparkSession) -> ledger.Ledger:
    return ledger.Ledger(spark, f"{shared_dir(spark)}/ledger-{uuid4().hex}")


def _distributor_prices_provider(spark: SparkSession, folder: str) -> DataFrame:
    """Every listed pair priced by a provider, its answers kept in a ledger."""
    base = _price_base(spark, folder)
    return prices.provider_prices(base, enrich.list_price_provider, _new_ledger(spark), "run-1", RUN_AT)


def _enrich_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """A prompt for each row; what is answered depends on it."""
    parts = table(spark, folder, "part").select("p_partkey", F.col("p_name").alias("product_name"), F.col("p_brand").alias("brand"), "p_size")
    prompt = F.when(F.col("p_size") > 40, "Answer in capitals.").when(F.col("p_size") > 20, "Be brief.")
    asked = enrich.enrich_column(parts, ["product_name", "brand"], ["product_name", "brand"], enrich.obedient_provider, prompt)
    return enrich.record_columns(asked.select("p_partkey", "enriched"), ["product_name", "brand"])


SEGMENTS = [("AUTOMOBILE", "cars"), ("BUILDING", "houses"), ("FURNITURE", "chairs"), ("HOUSEHOLD", "pans")]


def _enrich_inline_saved(spark: SparkSession, folder: str) -> DataFrame:
    """Rows written down in the call, enriched, saved with the stamp of their run, read back and joined to the customers.

    The second run finds every answer in the ledger, so its provider, which answers nothing, is not asked.
    """
    wh, kept = _new_warehouse(spark), _new_ledger(spark)
    rows = spark.createDataFrame(SEGMENTS, "segment string, sells string")

    def silent():
        def answer(requests):
            raise RuntimeError("asked again")

        return answer

    for run, factory in (("run-1", enrich.restating_provider), ("run-2", silent)):
        done = ledger.enrich_kept(rows, ["segment", "sells"], ["sells", "ceo"], factory, kept, run)
        opened = enrich.record_columns(done.select("segment", "enriched"), ["sells", "ceo"])
        saved = wh.replace("crm.enriched_segments", opened.withColumns({"run_id": F.lit(run), "enriched_at": F.lit(str(RUN_AT)).cast("timestamp_ntz")}))
    customers = table(spark, folder, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return customers.join(saved, "segment", "left")


def _enrich_input_hygiene(spark: SparkSession, folder: str) -> DataFrame:
    """Event properties as entities: readable ones pass, cut-off and empty ones become an empty object."""
    props = F.col("props")
    cut = F.when(F.col("event_type") == "error", F.left(props, F.length(props) - 1))
    dirty = cut.when(F.col("event_type") == "signup", "").when(F.col("event_type") == "click", None).otherwise(props)
    return table(spark, folder, "events").select("event_id", enrich.clean_entity(dirty).alias("entity"))


COMPANY_FIELDS, COMPANY_TASKS = ["name", "segment", "ceo"], 8


def _enrich_companies(spark: SparkSession, folder: str) -> DataFrame:
    """Accounts enriched row by row, their records opened into columns and stamped."""
    companies = table(spark, folder, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    asked = enrich.enrich_column(companies, ["name", "segment"], COMPANY_FIELDS, enrich.restating_provider, tasks=COMPANY_TASKS)
    opened = enrich.record_columns(asked.select("c_custkey", "enriched"), COMPANY_FIELDS)
    return opened.withColumn("enriched_at", F.lit(str(RUN_AT)).cast("timestamp_ntz"))


def _enrich_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every listed pair through a provider, its record opened into columns."""
    base = _price_base(spark, folder)
    fields = ["Brand", "website_domain", "listed_price"]
    asked = enrich.enrich_column(base, prices.ENTITY, fields, enrich.restating_provider, "Prices only.")
    return enrich.record_columns(asked.select("sku_id", "distributor_id", "enriched"), fields).withColumnRenamed("Brand", "brand")


def _enrich_events(spark: SparkSession, folder: str) -> DataFrame:
    """Many rows, few entities: every kind of event is asked for once."""
    events = table(spark, folder, "events").select("event_id", "event_type", "user_id")
    asked = enrich.enrich_once(events, ["event_type"], ["event_type", "meaning"], enrich.restating_provider)
    opened = asked.select("event_id", "user_id", F.get_json_object("enriched", "$.event_type").alias("kind"),
                          F.get_json_object("enriched", "$.meaning").alias("meaning"))
    return opened


def _enrich_udtf(spark: SparkSession, folder: str) -> DataFrame:
    """The table function over all parts; the group of a row decides its task, not its fields."""
    enrich.register(spark, {"restating": enrich.restating_provider})
    out = spark.sql(
        """WITH asked AS (SELECT to_json(named_struct('part', p_partkey, 'product_name', p_name, 'brand', p_brand)) AS input_json,
             CASE WHEN p_size > 25 THEN array('product_name', 'brand') ELSE array('Brand') END AS output_columns,
             CASE WHEN p_size > 40 THEN 'Prices only.' END AS custom_prompt, p_type FROM {part})
           SELECT * FROM enrich_rows(TABLE(SELECT * FROM asked) PARTITION BY p_type)""",
        part=table(spark, folder, "part"),
    )
    read = lambda c, k: F.try_variant_get(F.parse_json(c), f"$.{k}", "string")
    return out.select(
        read("input", "part").cast("bigint").alias("p_partkey"),
        read("enriched", "product_name").alias("product_name"),
        read("enriched", "brand").alias("brand"),
        read("enriched", "Brand").alias("brand_as_asked"),
    )


def _enrich_scalar(spark: SparkSession, folder: str) -> DataFrame:
    """The SQL function with its default prompt, with a prompt, and with nothing asked for."""
    enrich.register(spark, {"restating": enrich.restating_provider})
    return spark.sql(
        """SELECT s_suppkey, get_json_object(e, '$.name') AS name, get_json_object(e, '$.site') AS site,
             get_json_object(n, '$.error') AS error
           FROM (SELECT s_suppkey, enrich(to_json(named_struct('name', s_name)), '["name", "site"]') AS e,
                   enrich_restating(to_json(named_struct('name', s_name)), '[]', 'Be brief.') AS n FROM {supplier})""",
        supplier=table(spark, folder, "supplier"),
    )


def _variant_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Typed reads out of the JSON entity, by variant path and by JSON path."""
    entity = _skus(spark, folder).select(enrich.entity_json(prices.ENTITY[:5]).alias("j"))
    v = F.parse_json("j")
    return entity.select(
        F.variant_get(v, "$.sku_id", "string").alias("sku_id"),
        F.try_variant_get(v, "$.msrp", "decimal(10,2)").alias("msrp"),
        F.get_json_object("j", "$.brand").alias("brand"),
        F.try_variant_get(v, "$.no_such_key", "string").alias("absent"),
    )


def _last_assistant_text(spark: SparkSession, folder: str) -> DataFrame:
    return answers.last_assistant_text(table(spark, folder, "conversations"))


def _message_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Every message as a list of blocks: its text, a tool call and a bare string."""
    talk = table(spark, folder, "conversations")
    text = F.to_json(F.struct(F.lit("text").alias("type"), "text"))
    bare = F.concat(F.lit('"turn '), F.col("turn").cast("string"), F.lit('"'))
    content = F.concat(F.lit("["), F.concat_ws(",", text, F.lit('{"type":"tool_use","id":"t1"}'), bare), F.lit("]"))
    return talk.select("conv_id", "turn", answers.blocks_text(content).alias("text"))


def _tool_output_cap(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents through the cap, once at its own limit and once at a limit most of them pass."""
    docs = table(spark, folder, "documents")
    own, short = answers.cap_text(F.col("text")), answers.cap_text(F.col("text"), 1000)
    return docs.select("doc_id", F.md5(own).alias("capped"), F.md5(short).alias("capped_short"), F.length(short).alias("n"))


def _page_text(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.pages_text(table(spark, folder, "pages"))


def _found(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return corpus.site_search(corpus.title_requests(pages), pages)


def _site_search(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.with_snippets(_found(spark, folder), table(spark, folder, "pages"))


def _site_context(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.context(_found(spark, folder), table(spark, folder, "pages"))


def _prices_check(fn: Callable[..., DataFrame], *more: Query) -> Query:
    return _check(fn, _distributor_prices, *more)


def _new_warehouse(spark: SparkSession, rows_per_part: dict[str, int] | None = None) -> Warehouse:
    """Databases of their own, so that a query touches no table of the session's catalog."""
    wh = Warehouse(spark, prefix=f"w{uuid4().hex[:12]}_", rows_per_part=rows_per_part or {})
    wh.create_schemas()
    return wh


def _full_refresh_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Prices without a time stamp into the price table, read back from it."""
    priced = _distributor_prices(spark, folder).drop("enriched_at")
    return _new_warehouse(spark).full_refresh(prices.TABLE, priced, RUN_AT)


def _warehouse_refresh(spark: SparkSession, folder: str) -> DataFrame:
    """Every domain merged into its tables; the rows are what the checks say about them."""
    return refresh.refresh_all(_new_warehouse(spark), lambda name: feed(spark, folder, name), AS_OF, RUN_AT)


def _arrivals(spark: SparkSession, folder: str, name: str) -> tuple[str, str, int]:
    """A raw feed laid out as files that arrive over time, a folder for the progress, and the files of a third of it."""
    root = f"{shared_dir(spark)}/stream-{name}-{uuid4().hex}"
    raw = feed(spark, folder, name)
    raw.repartition(*[c for c in raw.columns]).write.parquet(f"{root}/in")  # as many files as its size asks for
    files = len(spark.read.schema(raw.schema).parquet(f"{root}/in").inputFiles())
    return f"{root}/in", f"{root}/progress", -(-files // 3)


def _stream_orders(spark: SparkSession, folder: str) -> DataFrame:
    arrived, progress, some = _arrivals(spark, folder, "raw_erp_sales_orders")
    return streaming.stream_orders(streaming.read_feed(spark, arrived, "erp_sales_orders", some), _new_warehouse(spark, streaming.PARTS), progress)


def _stream_stock(spark: SparkSession, folder: str) -> DataFrame:
    arrived, progress, some = _arrivals(spark, folder, "raw_erp_warehouse_inventory")
    return streaming.stream_stock(streaming.read_feed(spark, arrived, "erp_warehouse_inventory", some), _new_warehouse(spark, streaming.PARTS), progress)


QUERIES: dict[str, Query] = {
    "sales_orders": _orders,
    "sales_orders_severity": _orders_severity,
    "sales_order_items": _order_items,
    "daily_sales_summary": _daily_sales_summary,
    "skus": _skus,
    "product_categories": _product_categories,
    "distributors": _distributors,
    "warehouse_stock": _warehouse_stock,
    "customers": _customers,
    "support_tickets": _support_tickets,
    "gl_accounts": _gl_accounts,
    "monthly_pnl": _monthly_pnl,
    "suppliers": _suppliers,
    "purchase_orders": _purchase_orders,
    "upsert_orders": _merge(_orders, "sales_orders", "sales.orders"),
    "upsert_order_items": _merge(_order_items, "sales_order_items", "sales.order_items"),
    "upsert_skus": _merge(_skus, "inventory_skus", "inventory.skus"),
    "upsert_distributors": _merge(_distributors, "inventory_distributors", "inventory.distributors"),
    "upsert_daily_sales_summary": _merge(_daily_sales_summary, "sales_daily_sales_summary", "sales.daily_sales_summary"),
    "upsert_product_categories": _merge(_product_categories, "inventory_product_categories", "inventory.product_categories", 2),
    "upsert_warehouse_stock": _merge(_warehouse_stock, "inventory_warehouse_stock", "inventory.warehouse_stock"),
    "upsert_customers": _merge(_customers, "crm_customers", "crm.customers"),
    "upsert_support_tickets": _merge(_support_tickets, "crm_support_tickets", "crm.support_tickets", 2),
    "upsert_gl_accounts": _merge(_gl_accounts, "finance_gl_accounts", "finance.gl_accounts"),
    "upsert_monthly_pnl": _merge(_monthly_pnl, "finance_monthly_pnl", "finance.monthly_pnl"),
    "upsert_suppliers": _merge(_suppliers, "supply_suppliers", "supply_chain.suppliers"),
    "upsert_purchase_orders": _merge(_purchase_orders, "supply_purchase_orders", "supply_chain.purchase_orders"),
    "upsert_null_keys": _merge_null_keys,
    "upsert_orders_stored": _merge_stored(_orders, "sales_orders", "sales.orders", 250_000),
    "upsert_order_items_stored": _merge_stored(_order_items, "sales_order_items", "sales.order_items", 250_000),
    "check_skus": _check(checks.skus_present, _skus),
    "check_stock": _check(checks.stock_present, _warehouse_stock),
    "check_orders": _check(checks.items_have_headers, _order_items, _orders),
    "check_revenue": _check(checks.revenue_believable, _daily_sales_summary, as_of=AS_OF),
    "check_no_deleted_customers": _check(checks.no_deleted_customers, _customers, _raw("raw_salesforce_accounts")),
    "check_ticket_customer_fk": _check(checks.tickets_have_customers, _support_tickets, _customers),
    "check_pnl_balance": _check(checks.pnl_margin_positive, _monthly_pnl, _gl_accounts),
    "check_gl_coverage": _check(checks.pnl_accounts_known, _monthly_pnl, _gl_accounts),
    "check_supplier_fk": _check(checks.purchase_suppliers_known, _purchase_orders, _suppliers),
    "check_po_amounts": _check(checks.purchase_amounts_positive, _purchase_orders),
    "check_key_health": _check_key_health,
    "check_key_collisions": _check_key_collisions,
    "check_key_collisions_cut": _check_key_collisions_cut,
    "sku_distributor_base": _price_base,
    "enrich_requests": _enrich_requests,
    "enrich_input_hygiene": _enrich_input_hygiene,
    "parse_responses": _parse_responses,
    "parse_broken_responses": _parse_broken_responses,
    "distributor_prices": _distributor_prices,
    "enrich_companies": _enrich_companies,
    "enrich_udtf": _enrich_udtf,
    "enrich_scalar": _enrich_scalar,
    "variant_paths": _variant_paths,
    "last_assistant_text": _last_assistant_text,
    "message_blocks": _message_blocks,
    "tool_output_cap": _tool_output_cap,
    "check_row_count": _prices_check(checks.price_row_count, _skus, _distributors),
    "check_no_nulls": _prices_check(checks.price_fill_rate),
    "check_price_range": _prices_check(checks.price_range),
    "check_length_contract": _prices_check(checks.length_contract),
    "page_text": _page_text,
    "site_search": _site_search,
    "site_context": _site_context,
    "full_refresh_prices": _full_refresh_prices,
    "warehouse_refresh": _warehouse_refresh,
    "stream_orders": _stream_orders,
    "stream_stock": _stream_stock,
    "enrich_pairs": _enrich_pairs,
    "enrich_events": _enrich_events,
    "enrich_prompts": _enrich_prompts,
    "enrich_inline_saved": _enrich_inline_saved,
    "distributor_prices_provider": _distributor_prices_provider,
}
