import json

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from millrace.functions import answer_scan
from millrace.functions.answer_scan import message_text, read_answer, read_or_error
from millrace.operators import answers

FIELDS = ["listed_price", "discount"]
NONE = {"listed_price": "Not found", "discount": "Not found"}

CASES = [
    # (answer, record)
    ('{"listed_price": 699.90, "discount": 0}', {"listed_price": "699.9", "discount": "0"}),
    ('So: {"Listed Price": "5", "DISCOUNT": true} done', {"listed_price": "5", "discount": "True"}),
    ('{"listed_price": null}', {"listed_price": "None", "discount": "Not found"}),
    ('{"listed_price": {"amount": 5}, "discount": [1, "a"]}', {"listed_price": '{"amount": 5}', "discount": '[1, "a"]'}),
    ('First {oops} then {"listed_price": 1}', {"listed_price": "1", "discount": "Not found"}),
    ('{"listed_price": 1} {"listed_price": 2}', {"listed_price": "1", "discount": "Not found"}),
    ('{"listed_price": "a}b"}', {**NONE, "_raw": '{"listed_price": "a}b"}'}),
    ('{"listed_price": "{}", "discount": 1}', {"listed_price": "{}", "discount": "1"}),
    ('} {"listed_price": 1}', {**NONE, "_raw": '} {"listed_price": 1}'}),
    ('} {"x": {"listed_price": 1}}', {"listed_price": "1", "discount": "Not found"}),
    ('{ and {"listed_price": 1}', {**NONE, "_raw": '{ and {"listed_price": 1}'}),
    ("nothing here", {**NONE, "_raw": "nothing here"}),
    ("", {**NONE, "_raw": ""}),
    ('{"listed_price": NaN, "discount": 1e3}', {"listed_price": "nan", "discount": "1000.0"}),
    ('{"discount": 1, "Discount": 2}', {"listed_price": "Not found", "discount": "2"}),
    ("{}", NONE),
]


@pytest.mark.parametrize("text,record", CASES)
def test_read_answer(text, record):
    assert read_answer(text, FIELDS) == record


def test_parse_answer_on_spark(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)] + [(len(CASES), None)], "i int, t string")
    got = df.orderBy("i").select(answers.parse_answer(F.col("t"), FIELDS).alias("r")).collect()
    expected = [r for _, r in CASES] + [{**NONE, "_raw": ""}]
    assert [{k: v for k, v in g.r.asDict().items() if v is not None} for g in got] == expected


BROKEN = ['{"a": "\\ud83d"}', '{"a": ' + "9" * 5000 + "}", '{"a": ' * 100_000 + "0" + "}" * 100_000]


@pytest.mark.parametrize("text", BROKEN)
def test_an_unreadable_answer_gives_an_error(text):
    assert list(read_or_error(text, ["a"])) == ["error"]


def test_unreadable_answers_do_not_end_the_job(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*BROKEN, '{"a": 1}'])], "i int, t string")
    got = df.orderBy("i").select(answers.parse_answer(F.col("t"), ["a"]).alias("r")).select("r.*").collect()
    assert [(g.a, g._raw, g.error is not None) for g in got] == [(None, None, True)] * 3 + [("1", None, False)]


def test_raw_text_is_cut_where_asked():
    assert read_answer("x" * 600, ["a"], 500) == {"a": "Not found", "_raw": "x" * 500}
    assert read_answer("x" * 600, ["a"])["_raw"] == "x" * 600


prose = st.text(st.characters(exclude_characters="{}", codec="utf-8"), max_size=30)
scalars = st.one_of(
    st.none(), st.booleans(), st.integers(), st.floats(allow_nan=False),
    st.text(st.characters(exclude_characters="{}", codec="utf-8"), max_size=8),
)


@settings(max_examples=200, deadline=None)
@given(prose, prose, st.dictionaries(st.sampled_from(["listed_price", "Discount", "other"]), scalars))
def test_an_object_within_prose_is_read_back(before, after, record):
    found = read_answer(before + json.dumps(record) + after, FIELDS)
    expected = {f: str(record[k]) if k in record else "Not found" for f, k in [("listed_price", "listed_price"), ("discount", "Discount")]}
    assert found == expected


def test_message_text():
    blocks = [{"type": "text", "text": "a"}, {"type": "tool_use", "id": 1}, "b", 7]
    assert message_text("plain") == "plain"
    assert message_text(blocks) == "a\nb"
    assert message_text(blocks, stringify_blocks=True) == "a\n{'type': 'tool_use', 'id': 1}\nb"
    assert message_text(None) == "None"


def test_blocks_text(spark):
    texts = ['"plain"', '[{"type":"text","text":"a"},{"type":"tool_use","text":"no"},"b"]', "[]", "not json"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(answers.blocks_text(F.col("t"))).collect()] == ["plain", "a\nb", "", None]


def test_cap_text(spark):
    df = spark.createDataFrame([("x" * 80000,), ("x" * 80001,), (None,)], "t string")
    got = [r[0] for r in df.select(answers.cap_text(F.col("t"))).collect()]
    assert got == ["x" * 80000, "x" * 80000 + "\n\n[OUTPUT TRUNCATED]", None]


def _spans_by_depth(text):
    depth, opened = 0, None
    for i, c in enumerate(text):
        depth += (c == "{") - (c == "}")
        if c == "{" and depth == 1:
            opened = i
        if c == "}" and depth == 0 and opened is not None:
            yield text[opened : i + 1]


@settings(max_examples=300)
@given(st.text(alphabet='{}"a:1, ', max_size=30))
def test_first_object_is_that_of_the_stretches(text):
    found = None
    for span in _spans_by_depth(text):
        try:
            found = json.loads(span)
            break
        except json.JSONDecodeError:
            continue
    assert list(answer_scan.balanced_spans(text)) == list(_spans_by_depth(text))
    assert answer_scan.first_object(text) == found


def test_what_follows_the_first_object_is_not_looked_at(monkeypatch):
    spans = answer_scan.balanced_spans('{"a": {}} {"b": 1}')
    assert next(spans) == '{"a": {}}' and not any(isinstance(v, list) for v in spans.gi_frame.f_locals.values())

    def refuse(text):
        raise AssertionError("stretches looked for")

    monkeypatch.setattr(answer_scan, "balanced_spans", refuse)
    assert read_answer('found {"listed_price": 1} and {"listed_price": {', FIELDS) == {"listed_price": "1", "discount": "Not found"}
    assert read_answer("{ nothing", FIELDS)["_raw"] == "{ nothing"
