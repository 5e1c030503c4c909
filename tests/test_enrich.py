import datetime as dt
import json
import re
import sys
from collections import Counter
from decimal import Decimal as D

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from millrace.operators import enrich, prices
from millrace.sources.tables import Warehouse

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the provider below travels with its tasks

COMPANIES = [("Alder Works", "alder.example"), ("Birch & Co", "birch.example"), ("Cedar", "cedar.example"), ("Dogwood", None)]


@pytest.fixture(scope="module")
def companies(spark):
    df = spark.sql(
        "SELECT * FROM VALUES ('Alder Works', 'alder.example'), ('Birch & Co', 'birch.example'), "
        "('Cedar', 'cedar.example'), ('Dogwood', NULL) AS t(company_name, website)"
    )
    df.createOrReplaceTempView("companies")
    return df


def shouting():
    """A provider that needs its prompt, fails on one entity and answers in prose for another."""

    def answer(requests):
        out = []
        for r in requests:
            if r.entity.get("company_name") == "Cedar":
                raise RuntimeError("no such company")
            if r.entity.get("company_name") == "Dogwood":
                out.append("I could not find anything.")
            else:
                out.append("Found " + json.dumps({"CEO": r.entity["company_name"].upper(), "prompt": r.prompt}))
        return out

    return answer


def test_request_sentence(spark, companies):
    got = [r[0] for r in companies.select(enrich.request_sentence(companies, ["company_name", "website"], ["ceo", "founded"])).collect()]
    for (name, site), text in zip(COMPANIES, got):
        entity = {k: v for k, v in {"company_name": name, "website": site}.items() if v is not None}
        assert text == enrich.sentence(entity, ["ceo", "founded"])
    assert got[0].startswith("Find the following information: [ceo, founded] for the entity described by: company_name: Alder Works, ")
    assert got[0].endswith('exact keys: ["ceo", "founded"]. Use "Not found" for any field you cannot determine.')


def test_number_text(spark):
    df = spark.createDataFrame([(D("749.90"),), (D("749.00"),), (D("100.00"),), (D("0.05"),), (None,)], "d decimal(10,2)")
    assert [r[0] for r in df.select(enrich.number_text(F.col("d"))).collect()] == ["749.9", "749", "100", "0.05", None]


def test_clean_entity(spark):
    texts = ['{"a": 1}', "{a", "", None, "[1]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(enrich.clean_entity(F.col("t"))).collect()] == ['{"a": 1}', "{}", "{}", "{}", "[1]"]


def records(df):
    return {r.company_name: json.loads(r.enriched) for r in df.collect()}


def test_rows_keep_their_own_prompt_record_and_error(spark, companies):
    got = records(enrich.enrich_column(companies, ["company_name", "website"], ["ceo", "prompt"], shouting, "Be kind."))
    assert got == {
        "Alder Works": {"ceo": "ALDER WORKS", "prompt": "Be kind."},
        "Birch & Co": {"ceo": "BIRCH & CO", "prompt": "Be kind."},
        "Cedar": {"error": "no such company"},
        "Dogwood": {"ceo": "Not found", "prompt": "Not found", "_raw": "I could not find anything."},
    }


def test_sql_function_with_and_without_prompt(spark, companies):
    enrich.register(spark, {"shouting": shouting, "restating": enrich.restating_provider}, name="ask")
    got = spark.sql(
        """SELECT company_name, ask(to_json(named_struct('company_name', company_name)), '["ceo", "prompt"]', 'Hi') AS own,
             ask(to_json(named_struct('company_name', company_name)), '["prompt"]') AS plain,
             ask_restating(to_json(named_struct('company_name', company_name)), '["company_name"]') AS restated,
             ask('[1, 2]', '["a"]') AS listed, ask('{bad', '["company_name"]') AS bad, ask('{}', 'x') AS nothing
           FROM companies WHERE company_name = 'Alder Works'"""
    ).first()
    assert json.loads(got.own) == {"ceo": "ALDER WORKS", "prompt": "Hi"}
    assert json.loads(got.plain) == {"prompt": enrich.DEFAULT_PROMPT}
    assert json.loads(got.restated) == {"company_name": "Alder Works"}
    assert json.loads(got.listed) == {"error": "'list' object has no attribute 'items'"}
    assert list(json.loads(got.bad)) == ["error"]  # an empty entity has no company_name to shout
    assert json.loads(got.nothing) == {"error": "No output columns specified"}


def test_table_function_keeps_rows_apart_in_one_partition(spark, companies):
    enrich.register(spark, {"shouting": shouting}, name="ask")
    got = spark.sql(
        """SELECT * FROM ask_rows(TABLE(SELECT to_json(struct(company_name, website)) AS input_json,
             CASE WHEN website IS NULL THEN array('x') ELSE array('CEO', 'prompt') END AS output_columns,
             CASE WHEN company_name LIKE 'A%' THEN 'One' ELSE 'Two' END AS custom_prompt, 1 AS g FROM companies)
             PARTITION BY g)"""
    ).collect()
    by_name = {json.loads(r.input)["company_name"]: json.loads(r.enriched) for r in got}
    assert by_name["Alder Works"] == {"CEO": "ALDER WORKS", "prompt": "One"}
    assert by_name["Birch & Co"] == {"CEO": "BIRCH & CO", "prompt": "Two"}
    assert by_name["Cedar"] == {"error": "no such company"}
    assert by_name["Dogwood"] == {"x": "Not found", "_raw": "I could not find anything."}


def test_short_provider_answers_are_errors():
    rows = [({"a": 1}, ["a"], None), ({"a": 2}, ["a"], None)]
    assert enrich.enrich_batch(lambda requests: [], rows) == [{"error": "list index out of range"}] * 2


def test_one_provider_per_task(spark):
    calls = spark.range(0, 4000, 1, 4).select(F.concat(F.lit('{"id": '), F.col("id").cast("string"), F.lit("}")).alias("j"))

    def counting():
        made = {"asked": 0}

        def answer(requests):
            made["asked"] += len(requests)
            return [json.dumps({"asked": made["asked"]}) for _ in requests]

        return answer

    call = enrich.scalar_function(counting)
    got = calls.select(call("j", F.lit('["asked"]'), F.lit(None).cast("string")).alias("r"))
    most = got.select(F.max(F.get_json_object("r", "$.asked").cast("int"))).first()[0]
    assert most == 1000  # the same provider saw all rows of its partition


def test_enriched_table_saved_and_read_back(spark, companies):
    wh = Warehouse(spark, prefix="saved_")
    wh.create_schemas()
    asked = enrich.enrich_column(companies, ["company_name", "website"], ["company_name", "funding"], enrich.restating_provider)
    opened = enrich.record_columns(asked.drop("company_name"), ["company_name", "funding"])
    saved = wh.replace("raw.enriched_companies", opened.withColumn("enriched_at", F.lit("2025-04-01").cast("timestamp_ntz")))
    rows = {r.company_name: r for r in saved.collect()}
    assert set(rows) == {n for n, _ in COMPANIES}
    assert rows["Cedar"].funding == "Not found" and rows["Cedar"].enriched_at == dt.datetime(2025, 4, 1)


@pytest.fixture(scope="module")
def priced(spark):
    skus = spark.createDataFrame(
        [("S1", "Vacuum", "Dyson", "1", D("200.00"), "ACTIVE"), ("S2", "Buds", "Apple", "2", None, "ACTIVE"),
         ("S3", "Old", "Bose", "3", D("5.00"), "INACTIVE"), ("S4", "Free", "Bose", "4", D("0.00"), "ACTIVE")],
        "sku_id string, product_name string, brand string, upc string, msrp decimal(10,2), status string",
    )
    shops = spark.createDataFrame(
        [("D1", "One", "one.example", "ACTIVE"), ("D2", "Two", "two.example", "ACTIVE"), ("D3", "Off", "off.example", "EXPIRED")],
        "distributor_id string, distributor_name string, website_domain string, status string",
    )
    listings = spark.createDataFrame(
        [(s, d) for s in ("S1", "S2", "S3", "S4", "S9") for d in ("one.example", "two.example", "off.example")] * 2,
        "sku_id string, website_domain string",
    )
    answers = spark.createDataFrame(
        [("S1", "one.example", 'x {"listed_price": 90.01, "discount": 0.1, "listing_url": null}'),
         ("S2", "one.example", '{"listed_price": "7", "discount": "N/A", "listing_url": "u"}'),
         ("S4", "one.example", '{"listed_price": 1}')],
        "sku_id string, website_domain string, output_text string",
    )
    return prices.price_base(listings, skus, shops), answers


def test_prices(priced):
    base, answers = priced
    got = prices.distributor_prices(base, answers, dt.datetime(2025, 4, 1)).collect()
    assert len(got) == 6  # three active products at two active shops, each pair once
    by = {(r.sku_id, r.distributor_id): (r.listed_price, r.price_deviation_pct, r.discount, r.listing_url) for r in got}
    assert by[("S1", "D1")] == (D("90.01"), D("-0.5500"), D("0.10"), "None")
    assert by[("S2", "D1")] == (D("7.00"), None, None, "u")
    assert by[("S4", "D1")] == (D("1.00"), None, None, "Not found")
    assert by[("S1", "D2")] == (None, None, None, "Not found")
    assert {r.enriched_at for r in got} == {dt.datetime(2025, 4, 1)}


def test_pairs_do_not_move_for_a_few_distributors(spark, monkeypatch):
    skus = spark.createDataFrame([(f"S{i}", "n", None, "u", D(1), "ACTIVE" if i % 5 else "OFF") for i in range(40)],
                                 "sku_id string, product_name string, brand string, upc string, msrp decimal(10,2), status string")
    shops = spark.createDataFrame([(f"D{i}", None, f"{i}.example" if i else None, "ACTIVE") for i in range(6)] + [("D9", "twice", "1.example", "ACTIVE")],
                                  "distributor_id string, distributor_name string, website_domain string, status string")
    listings = spark.createDataFrame([(f"S{i % 45}", f"{i % 8}.example") for i in range(600)] + [(None, "1.example"), ("S1", None)],
                                     "sku_id string, website_domain string")
    got, before = {}, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables beyond it
    try:
        for most in (7, 6):  # seven are active
            monkeypatch.setattr(prices, "SHARED_DISTRIBUTORS", most)
            base = prices.price_base(listings, skus, shops)
            text = base._jdf.queryExecution().executedPlan().toString()
            assert len(re.findall(r"Exchange hashpartitioning\(website_domain#\d+, \d", text)) == (0 if most == 7 else 2)
            got[most] = Counter(base.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    pairs = {(r.sku_id, r.website_domain) for r in listings.collect()}
    on = [(s, d) for s, d in pairs if s and d and s in {f"S{i}" for i in range(40) if i % 5} and d in {f"{i}.example" for i in range(1, 6)}]
    assert got[7] == got[6] and sum(got[7].values()) == len(on) + sum(d == "1.example" for _, d in on)


def test_null_url_as_null(priced):
    base, answers = priced
    enriched = enrich.answered(base, answers, prices.REQUEST_KEY, prices.FIELDS)
    got = prices.price_columns(enriched, dt.datetime(2025, 4, 1), null_text="null")
    assert got.where("sku_id = 'S1' AND distributor_id = 'D1'").first().listing_url is None
    with pytest.raises(ValueError):
        prices.price_columns(enriched, dt.datetime(2025, 4, 1), null_text="other")


def test_a_provider_that_cannot_be_made_is_every_rows_error(spark, companies):
    def broken():
        raise RuntimeError("no key configured")

    got = records(enrich.enrich_column(companies, ["company_name"], ["ceo"], broken))
    assert list(got.values()) == [{"error": "no key configured"}] * 4


def test_answers_in_blocks_and_single_failures():
    blocks = [{"type": "tool_use", "id": 1}, {"type": "text", "text": '{"a": 5}'}]
    rows = [({"n": 1}, ["a"], None), ({"n": 2}, ["a"], None), ([1], ["a"], None)]
    got = enrich.enrich_batch(lambda requests: [blocks, ValueError("busy")], rows)
    assert got == [{"a": "5"}, {"error": "busy"}, {"error": "'list' object has no attribute 'items'"}]
    # shown as text, the tool call holds an object of its own, though not one that reads as JSON
    assert enrich.enrich_batch(lambda requests: [blocks], rows[:1], stringify_blocks=True) == [{"a": "5"}]


def test_equal_entities_are_asked_for_once(spark, tmp_path):
    log = str(tmp_path)

    def logging():
        import uuid

        def answer(requests):
            with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(r.text for r in requests))
            return [json.dumps(r.entity) for r in requests]

        return answer

    # a third of the rows share one entity; some have none at all
    kind = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise((F.col("id") % 40).cast("string"))
    rows = spark.range(3000).select("id", kind.alias("kind"))
    got = enrich.enrich_once(rows, ["kind"], ["kind"], logging)
    wrong = got.where("coalesce(kind, 'Not found') <> get_json_object(enriched, '$.kind')").count()
    assert got.count() == 3000 and wrong == 0
    asked = [line for f in tmp_path.iterdir() for line in f.read_text().splitlines()]
    assert len(asked) == len(set(asked)) == rows.select("kind").distinct().count()
