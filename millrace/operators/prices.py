"""Listed prices of active products at active distributors."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace import schemas
from millrace.functions import clean
from millrace.operators import enrich, ledger

TABLE = "inventory.distributor_prices"
ENTITY = ["sku_id", "product_name", "brand", "upc", "msrp", "distributor_id", "distributor_name", "website_domain"]
FIELDS = ["listed_price", "discount", "listing_url"]
REQUEST_KEY = ["sku_id", "website_domain"]
#: Active distributors that still go to every task, some 100 bytes each.
SHARED_DISTRIBUTORS = 500_000


def price_base(listings: DataFrame, skus: DataFrame, distributors: DataFrame) -> DataFrame:
    """The (product, distributor) pairs to price: both active, each listed pair once.

    The pairs are an input. All of them come through equi-joins, so the work follows the list and never the
    product of the two dimensions; ``checks.price_row_count`` says how far the list is from that product.

    The distributors come first, while the pairs are narrow; up to ``SHARED_DISTRIBUTORS`` of them go to every task and no
    pair moves for them.
    """
    active = F.col("status") == "ACTIVE"
    pairs = listings.select(*REQUEST_KEY).distinct()
    shops = distributors.where(active).select(*ENTITY[5:])
    if shops.limit(SHARED_DISTRIBUTORS + 1).count() <= SHARED_DISTRIBUTORS:
        shops = F.broadcast(shops)
    return pairs.join(shops, "website_domain").join(skus.where(active).select(*ENTITY[:5]), "sku_id").select(*ENTITY)


def requests(base: DataFrame) -> DataFrame:
    """Each pair with its JSON entity and its request sentence."""
    return base.select(
        *REQUEST_KEY,
        enrich.entity_json(ENTITY).alias("input_json"),
        enrich.request_sentence(base, ENTITY, FIELDS).alias("request"),
    )


def search_requests(base: DataFrame) -> DataFrame:
    """Each pair as a search on the distributor's site: the product by its name, else by its code."""
    key = F.concat_ws(" ", *REQUEST_KEY).alias("request_id")
    return base.select(key, F.col("website_domain").alias("domain"), F.array_compact(F.array("product_name", "upc")).alias("phrases"))


def price_columns(enriched: DataFrame, run_at: dt.datetime, null_text: str = "keep") -> DataFrame:
    """Typed price columns from a record in ``enriched``, a struct or the JSON text that a provider's record comes as.

    A price that is no number is NULL. A null URL in an answer comes as the text 'None'; with
    ``null_text="null"`` it is NULL instead. A list price of zero has no deviation.
    """
    if null_text not in ("keep", "null"):
        raise ValueError(f"unknown null_text {null_text!r}")

    as_text = isinstance(enriched.schema["enriched"].dataType, T.StringType)

    def field(name: str) -> Column:
        return F.get_json_object("enriched", f"$.{name}") if as_text else F.col("enriched").getField(name)

    listed, msrp, url = F.col("listed_price"), F.col("msrp"), field("listing_url")
    priced = enriched.withColumn("listed_price", clean.to_decimal(field("listed_price"), 10, 2))
    return schemas.conform(
        priced.withColumns(
            {
                "price_deviation_pct": F.round(F.try_divide(listed - msrp, msrp), 4),
                "discount": clean.to_decimal(field("discount"), 5, 2),
                "listing_url": url if null_text == "keep" else F.nullif(url, F.lit("None")),
                "enriched_at": F.lit(run_at.isoformat(sep=" ")).cast("timestamp_ntz"),
            }
        ),
        TABLE,
    )


def distributor_prices(base: DataFrame, answers: DataFrame, run_at: dt.datetime) -> DataFrame:
    return price_columns(enrich.answered(base, answers, REQUEST_KEY, FIELDS), run_at)


def provider_prices(
    base: DataFrame, factory: enrich.ProviderFactory, kept: ledger.Ledger, run_id: str, run_at: dt.datetime,
    prompt: str | None = None, tasks: int | None = None,
) -> DataFrame:
    """Prices of the listed pairs from a provider; pairs that the ledger knows are not asked for again."""
    priced = ledger.enrich_kept(base, ENTITY, FIELDS, factory, kept, run_id, prompt, tasks)
    return price_columns(priced.drop("answered_at"), run_at)
