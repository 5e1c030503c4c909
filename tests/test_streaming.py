import datetime as dt
import os
from decimal import Decimal as D

from uuid import uuid4

import pytest

from millrace import schemas
from millrace.operators import inventory, sales
from millrace.sources.tables import Warehouse
from millrace.streaming import refresh


def line(order, n, status, price="10.00", qty="1", ship="", account="ACCT-1"):
    return (order, str(n), "7", account, "2024-01-01T00:00:00Z", "WEB", status, ship, qty, price, "0.00")


@pytest.fixture
def arrive(spark, tmp_path):
    folder = str(tmp_path / "in")

    def write(name, rows):
        df = spark.createDataFrame(rows, schemas.raw_schema(name)).coalesce(1)
        df.write.mode("append").parquet(folder)

    wh = Warehouse(spark, prefix=f"s{uuid4().hex[:8]}_")
    wh.create_schemas()
    return write, folder, wh, str(tmp_path / "progress")


def test_orders_follow_late_lines(spark, arrive):
    write, folder, wh, progress = arrive

    def run():
        return refresh.stream_orders(refresh.read_feed(spark, folder, "erp_sales_orders", 1), wh, progress)

    write("erp_sales_orders", [line("1", 1, "SHIPPED", ship="2024-01-03T00:00:00Z"), line("2", 1, "ENTERED")])
    write("erp_sales_orders", [line("1", 2, "ENTERED", "5.50", "2")])
    first = {r.order_id: r for r in run().collect()}
    assert wh.table("sales.orders").count() == 2
    assert first["ORD-1"].total_amount == D("21.00") and first["ORD-1"].status == "PENDING"
    assert first["ORD-1"].ship_date == dt.date(2024, 1, 3)

    write("erp_sales_orders", [line("1", 3, "CLOSED", "1.00"), line("3", 1, "BACK ORDERED", "n/a")])
    second = run()
    lines = spark.read.schema(schemas.raw_schema("erp_sales_orders")).parquet(folder)
    assert sorted(map(tuple, second.collect())) == sorted(map(tuple, sales.orders(lines).select(*second.columns).collect()))
    assert second.where("order_id = 'ORD-1'").first().status == "DELIVERED"

    assert sorted(map(tuple, run().collect())) == sorted(map(tuple, second.collect()))  # nothing new came


def test_lines_that_disagree_on_the_header_fail(spark, arrive):
    write, folder, wh, progress = arrive
    write("erp_sales_orders", [line("1", 1, "ENTERED"), line("1", 2, "ENTERED", account="ACCT-2")])
    with pytest.raises(Exception, match="disagree on the header"):
        refresh.stream_orders(refresh.read_feed(spark, folder, "erp_sales_orders"), wh, progress)


def test_stock_keeps_the_newest_snapshot(spark, arrive):
    write, folder, wh, progress = arrive

    def run():
        return refresh.stream_stock(refresh.read_feed(spark, folder, "erp_warehouse_inventory", 1), wh, progress)

    write("erp_warehouse_inventory", [("01", "5", "9", "1", "2024-01-02T00:00:00", "2024-01-02 10:00:00"),
                                      ("01", "6", "4", "1", "2024-01-02T00:00:00", "soon")])
    assert {r.sku_id: r.quantity_on_hand for r in run().collect()} == {"SKU-00005": 9, "SKU-00006": 4}
    write("erp_warehouse_inventory", [("01", "5", "1", "1", "2024-01-01T00:00:00", "2024-01-01 10:00:00"),
                                      ("01", "6", "7", "1", "2024-01-01T00:00:00", "2024-01-01 10:00:00")])
    assert {r.sku_id: r.quantity_on_hand for r in run().collect()} == {"SKU-00005": 9, "SKU-00006": 7}


def test_equal_times_agree_between_batch_and_stream(spark, arrive):
    write, folder, wh, progress = arrive
    for qty in ("9", "10", "x"):
        write("erp_warehouse_inventory", [("01", "5", qty, "1", "2024-01-02T00:00:00", "2024-01-02 10:00:00")])
    raw = spark.read.schema(schemas.raw_schema("erp_warehouse_inventory")).parquet(folder)
    streamed = refresh.stream_stock(refresh.read_feed(spark, folder, "erp_warehouse_inventory", 1), wh, progress)
    assert streamed.collect() == inventory.warehouse_stock(raw).collect()
    assert streamed.first().quantity_on_hand == 10


def orders_of(wh):
    return {r.order_id: (r.total_amount, r.status) for r in wh.table("sales.orders").collect()}


def test_a_new_checkpoint_loses_no_row(spark, arrive, tmp_path):
    write, folder, wh, progress = arrive
    write("erp_sales_orders", [line("1", 1, "SHIPPED"), line("2", 1, "ENTERED")])
    refresh.stream_orders(refresh.read_feed(spark, folder, "erp_sales_orders"), wh, progress)
    later = str(tmp_path / "later")
    spark.createDataFrame([line("3", 1, "CLOSED")], schemas.raw_schema("erp_sales_orders")).write.parquet(later)
    refresh.stream_orders(refresh.read_feed(spark, later, "erp_sales_orders"), wh, progress + "-2")
    assert orders_of(wh) == {"ORD-1": (D("10.00"), "SHIPPED"), "ORD-2": (D("10.00"), "PENDING"), "ORD-3": (D("10.00"), "DELIVERED")}
    assert sorted(wh.applied("sales.orders").values()) == [0, 0]


def test_a_repeated_batch_changes_nothing(spark, arrive):
    write, folder, wh, progress = arrive
    day = "2024-01-02T00:00:00"
    write("erp_warehouse_inventory", [("01", "5", "9", "1", day, "2024-01-02 10:00:00")])
    write("erp_warehouse_inventory", [("01", None, "9", "1", day, "2024-01-02 10:00:00")])
    read = lambda: refresh.read_feed(spark, folder, "erp_warehouse_inventory")
    first = sorted(map(str, refresh.stream_stock(read(), wh, progress).collect()))
    assert len(first) == 2
    for f in os.listdir(f"{progress}/commits"):  # as if the driver had died before it wrote down the batch
        os.remove(f"{progress}/commits/{f}")
    assert sorted(map(str, refresh.stream_stock(read(), wh, progress).collect())) == first


def test_batch_and_stream_share_the_table(spark, arrive):
    write, folder, wh, progress = arrive
    schema = schemas.raw_schema("erp_sales_orders")
    wh.merge_into("sales.orders", sales.orders(spark.createDataFrame([line("1", 1, "ENTERED"), line("9", 1, "SHIPPED")], schema)))
    write("erp_sales_orders", [line("1", 1, "CLOSED")])
    run = lambda: refresh.stream_orders(refresh.read_feed(spark, folder, "erp_sales_orders"), wh, progress)
    run()
    wh.merge_into("sales.orders", sales.orders(spark.createDataFrame([line("8", 1, "ENTERED")], schema)))
    run()
    assert {k: v[1] for k, v in orders_of(wh).items()} == {"ORD-1": "DELIVERED", "ORD-9": "SHIPPED", "ORD-8": "PENDING"}
    assert list(wh.applied("sales.orders").values()) == [0]  # the record outlives batch runs


@pytest.fixture(params=[{}, {t: 2 for t in refresh.PARTS}], ids=["whole", "parts"])
def house(spark, request):
    wh = Warehouse(spark, prefix=f"s{uuid4().hex[:8]}_", rows_per_part=dict(request.param))
    wh.create_schemas()
    return wh


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, schemas.raw_schema(name)).coalesce(1).write.mode("append").parquet(folder)


def test_a_new_checkpoint_on_new_files_gives_full_totals(spark, house, tmp_path):
    first, later, name = str(tmp_path / "a"), str(tmp_path / "b"), "erp_sales_orders"
    put(spark, first, name, [line("1", 1, "SHIPPED"), line("2", 1, "ENTERED"), line("1", 2, "ENTERED", "3.00")])
    refresh.stream_orders(refresh.read_feed(spark, first, name), house, str(tmp_path / "p1"))
    put(spark, later, name, [line("1", 3, "CLOSED", "4.00", ship="2024-01-09T00:00:00Z"), line("3", 1, "CLOSED")])
    refresh.stream_orders(refresh.read_feed(spark, later, name), house, str(tmp_path / "p2"))
    lines = spark.read.schema(schemas.raw_schema(name)).parquet(first, later)
    got = house.table("sales.orders")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sales.orders(lines).select(*got.columns).collect()))


def test_a_new_checkpoint_counts_no_file_twice(spark, house, tmp_path):
    folder, name = str(tmp_path / "in"), "erp_sales_orders"
    for n, rows in enumerate([[line("1", 1, "SHIPPED"), line("2", 1, "ENTERED")], [line("1", 2, "ENTERED")], [line("2", 2, "CLOSED")]]):
        put(spark, folder, name, rows)
        refresh.stream_orders(refresh.read_feed(spark, folder, name), house, str(tmp_path / f"p{n}"))
    lines = spark.read.schema(schemas.raw_schema(name)).parquet(folder)
    got = house.table("sales.orders")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sales.orders(lines).select(*got.columns).collect()))


@pytest.mark.parametrize("lost", ["sales.order_files", "sales.order_totals", "sales.orders"])
def test_a_batch_that_broke_off_is_finished_once(spark, house, tmp_path, monkeypatch, lost):
    folder, name, progress = str(tmp_path / "in"), "erp_sales_orders", str(tmp_path / "p")
    put(spark, folder, name, [line("1", 1, "SHIPPED")])
    refresh.stream_orders(refresh.read_feed(spark, folder, name), house, progress)
    put(spark, folder, name, [line("1", 2, "CLOSED", "5.00"), line("4", 1, "ENTERED")])
    update = Warehouse.update

    def breaking(self, table, *a, **k):
        if table == lost:
            raise RuntimeError("broken off")
        return update(self, table, *a, **k)

    monkeypatch.setattr(Warehouse, "update", breaking)
    with pytest.raises(Exception):
        refresh.stream_orders(refresh.read_feed(spark, folder, name), house, progress)
    monkeypatch.undo()
    other = progress if lost == "sales.orders" else progress + "-new"  # a new checkpoint reads both files again
    refresh.stream_orders(refresh.read_feed(spark, folder, name), house, other)
    lines = spark.read.schema(schemas.raw_schema(name)).parquet(folder)
    got = house.table("sales.orders")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sales.orders(lines).select(*got.columns).collect()))


def test_a_stock_batch_that_changes_nothing_writes_nothing(spark, house, tmp_path):
    folder, name = str(tmp_path / "in"), "erp_warehouse_inventory"
    row = lambda item, qty, day: ("01", item, qty, "1", f"2024-01-0{day}T00:00:00", f"2024-01-0{day} 10:00:00")
    put(spark, folder, name, [row(str(i), "9", 2) for i in range(8)])
    run = lambda: refresh.stream_stock(refresh.read_feed(spark, folder, name), house, str(tmp_path / "p"))
    first = sorted(map(str, run().collect()))
    states = {t: house._states(t) for t in (refresh.STOCK, refresh.STOCK_TIMES)}
    put(spark, folder, name, [row("3", "1", 1)])
    assert sorted(map(str, run().collect())) == first
    assert {t: house._states(t) for t in states} == states
    put(spark, folder, name, [row("3", "2", 3)])
    assert {r.sku_id: r.quantity_on_hand for r in run().collect()}["SKU-00003"] == 2
