import glob
import json
import os
import sys
import time
from uuid import uuid4

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from millrace.operators import enrich
from millrace.operators.ledger import Ledger, enrich_kept

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the providers below travel with their tasks


def told(folder):
    """What providers wrote down: one line for each request, over all their files."""
    return [line for f in glob.glob(f"{folder}/*.log") for line in open(f).read().split("\n") if line]


def noting(folder, breaks_on=None, fails_on=None):
    def make():
        def answer(requests):
            with open(f"{folder}/{os.getpid()}.log", "a") as out:
                out.write("".join(f"{r.entity['id']}\n" for r in requests))
            if breaks_on is not None and any(r.entity["id"] == breaks_on for r in requests):
                raise KeyboardInterrupt  # ends the task, as a lost worker does
            return [RuntimeError("no") if r.entity["id"] == fails_on else json.dumps({"name": f"n{r.entity['id']}"}) for r in requests]

        return answer

    return make


@pytest.fixture
def ids(spark):
    return spark.range(400).select("id", (F.col("id") % 7).alias("group"))


def test_a_run_that_was_killed_goes_on_where_it_stopped(spark, ids, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/ledger-{uuid4().hex}")
    one, two = tmp_path / "one", tmp_path / "two"
    one.mkdir(), two.mkdir()
    with pytest.raises(Exception):
        enrich_kept(ids, ["id"], ["name"], noting(str(one), breaks_on=399), ledger, "r1", tasks=20).collect()
    kept = {json.loads(r.enriched)["name"] for r in ledger.rows().collect()}
    assert 0 < len(kept) < 400
    done = enrich_kept(ids, ["id"], ["name"], noting(str(two)), ledger, "r2", tasks=20)
    assert {r.id: json.loads(r.enriched)["name"] for r in done.collect()} == {i: f"n{i}" for i in range(400)}
    asked = told(two)
    assert len(asked) == len(set(asked)) == 400 - len(kept)
    assert not {f"n{i}" for i in asked} & kept  # no kept answer was asked for again
    three = tmp_path / "three"
    three.mkdir()
    assert enrich_kept(ids, ["id"], ["name"], noting(str(three)), ledger, "r3").count() == 400 and told(three) == []


def test_errors_are_asked_for_again(spark, ids, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/ledger-{uuid4().hex}")
    first = enrich_kept(ids, ["id"], ["name"], noting(str(tmp_path), fails_on=3), ledger, "r1", tasks=2)
    assert {r.id: r.enriched for r in first.collect()}[3] == '{"error": "no"}'
    assert ledger.rows().where("failed").count() == 1
    again = enrich_kept(ids, ["id"], ["name"], noting(str(tmp_path)), ledger, "r2", tasks=2)
    assert json.loads({r.id: r.enriched for r in again.collect()}[3]) == {"name": "n3"}
    assert sorted(told(tmp_path)).count("3") == 2 and len(told(tmp_path)) == 401


def test_fields_and_prompt_are_part_of_a_request(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/ledger-{uuid4().hex}")
    rows = spark.createDataFrame([(1,), (1,), (2,)], "id long")
    for fields, prompt, new in ((["name"], None, 2), (["name"], "", 2), (["name", "x"], None, 2), (["name"], None, 0)):
        before = len(told(tmp_path))
        assert enrich_kept(rows, ["id"], fields, noting(str(tmp_path)), ledger, "r", prompt).count() == 3
        assert len(told(tmp_path)) - before == new


def test_no_rows(spark, ids, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/ledger-{uuid4().hex}")
    assert enrich_kept(ids.where("false"), ["id"], ["name"], noting(str(tmp_path)), ledger, "r").collect() == []


def test_tasks_hold_equal_numbers_of_requests(spark):
    rows = spark.range(10_000).withColumn("wide", F.repeat(F.lit("x"), (F.col("id") % 100).cast("int")))
    sizes = [n for n in enrich.even_tasks(rows, 16, [F.col("id")]).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
    assert len(sizes) == 16 and {r["count"] for r in sizes} == {625}


def test_one_provider_for_fifty_groups_and_closed_at_the_end(spark, tmp_path):
    folder = str(tmp_path)

    class Counting:
        def __init__(self):
            open(f"{folder}/{uuid4().hex}.made", "w").write(str(os.getpid()))

        def __call__(self, requests):
            return [json.dumps(r.entity) for r in requests]

        def close(self):
            open(f"{folder}/{uuid4().hex}.closed", "w").close()

    enrich.register(spark, {"counting": Counting}, name="fifty")
    spark.range(500).select(
        F.to_json(F.struct("id")).alias("input_json"), F.array(F.lit("id")).alias("output_columns"),
        F.lit(None).cast("string").alias("custom_prompt"), (F.col("id") % 50).alias("g"),
    ).coalesce(1).createOrReplaceTempView("fifty_asks")
    got = spark.sql("SELECT * FROM fifty_rows(TABLE(SELECT * FROM fifty_asks) PARTITION BY g)").collect()
    assert sorted(int(json.loads(r.enriched)["id"]) for r in got) == list(range(500))
    makers = [open(f).read() for f in glob.glob(f"{folder}/*.made")]
    assert len(makers) == len(set(makers))  # one for each process that had work, not one for each group


def test_provider_is_closed_when_the_process_ends(tmp_path):
    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from millrace.operators import enrich\n"
        "class P:\n"
        "    def __call__(self, r): return []\n"
        "    def close(self): open(sys.argv[2] + '/closed', 'w').close()\n"
        "assert enrich._kept_provider('t', P) is enrich._kept_provider('t', P)\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert os.spawnv(os.P_WAIT, sys.executable, [sys.executable, "-c", code, root, str(tmp_path)]) == 0
    assert (tmp_path / "closed").exists()


def test_calls_hold_one_prompt_and_one_list_of_fields():
    calls = []

    def provider(requests):
        calls.append({(tuple(r.fields), r.prompt) for r in requests})
        return ["{}"] * len(requests)

    rows = [({"n": i}, ["a"] if i % 2 else ["b"], "p" if i % 3 else None) for i in range(12)]
    assert len(enrich.enrich_batch(provider, rows)) == 12
    assert len(calls) == 4 and all(len(c) == 1 for c in calls)


def test_a_call_that_fails_is_asked_again_in_halves():
    calls = []

    def provider(requests):
        calls.append(len(requests))
        if any(r.entity["n"] == 5 for r in requests):
            raise RuntimeError("five")
        return [json.dumps({"n": r.entity["n"]}) for r in requests]

    got = enrich.enrich_batch(provider, [({"n": i}, ["n"], None) for i in range(64)])
    assert got[5] == {"error": "five"} and [g["n"] for i, g in enumerate(got) if i != 5] == [str(i) for i in range(64) if i != 5]
    assert len(calls) == 13  # 64, then two halves at each of six levels


def test_rate_of_a_process_is_limited():
    provider = enrich.limited(enrich.restating_provider, 200)()
    request = enrich.Request("", {"a": 1}, ["a"], "")
    start = time.monotonic()
    for _ in range(5):
        provider([request] * 10)
    assert 0.19 <= time.monotonic() - start < 2


def test_requests_are_dealt_as_they_lie(spark, tmp_path):
    """Equal requests are asked once, in even tasks, without a sort over all of them."""
    from pyspark.sql import functions as F

    from millrace.operators import enrich, ledger
    from millrace.operators.numbering import written_row_number

    rows = spark.range(0, 90, 1, 7).select((F.col("id") % 30).alias("id"))
    asked = rows.select(F.to_json(F.struct("id")).alias("entity"), F.lit('["id"]').alias("fields"), F.lit(None).cast("string").alias("prompt"))
    kept = ledger.Ledger(spark, str(tmp_path / "l"))
    assert kept.ask(asked, enrich.restating_provider, "r", tasks=4) == 30
    assert kept.ask(asked, enrich.restating_provider, "r", tasks=4) == 0
    assert kept.answers().count() == 30
    placed = written_row_number(rows, enrich.PLACE)
    assert sorted(r[0] for r in placed.select(enrich.PLACE).collect()) == list(range(1, 91))
    sizes = enrich.even_runs(placed, 90, 4).groupBy(F.spark_partition_id()).count().collect()
    assert sorted(r["count"] for r in sizes) == [22, 22, 23, 23]


def held(folder):
    """Bytes of data in a folder."""
    return sum(os.path.getsize(f) for f in glob.glob(f"{folder}/**", recursive=True) if os.path.isfile(f))


def test_requests_do_not_stay_on_disk(spark, ids, tmp_path):
    """What was written to ask is removed once the answers are there, and when a provider broke the run, too."""
    from millrace.session import shared_dir

    shared = shared_dir(spark).removeprefix("file:")
    ledger, before = Ledger(spark, f"{tmp_path}/ledger-{uuid4().hex}"), held(shared)
    with pytest.raises(Exception):
        enrich_kept(ids, ["id"], ["name"], noting(str(tmp_path), breaks_on=399), ledger, "r1", tasks=20).collect()
    assert held(shared) <= before
    done = enrich_kept(ids, ["id", "group"], ["name"], noting(str(tmp_path)), ledger, "r2", tasks=20).select("id", "enriched")
    assert held(shared) <= before and sorted(json.loads(r.enriched)["name"] for r in done.collect()) == sorted(f"n{i}" for i in range(400))


def test_wide_requests_take_little_of_the_disk(spark, tmp_path):
    """The ledger's files are small beside the keys it holds, and these are read back whole."""
    ledger = Ledger(spark, f"{tmp_path}/ledger-{uuid4().hex}")
    rows = spark.range(4_000).select("id")
    done = enrich_kept(rows, ["id"], ["name"], noting(str(tmp_path)), ledger, "r", tasks=1)
    assert done.count() == 4_000 and ledger.answers("r").count() == 4_000
    assert held(ledger.folder) < 4_000 * 60  # a key alone has 64 digits
    assert {len(r.request_key) for r in ledger.rows().collect()} == {64}
