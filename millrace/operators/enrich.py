"""Enrichment: requests out of rows, providers that answer them, records back onto the rows."""

from __future__ import annotations

import atexit
import json
import sys
import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import suppress
from decimal import ROUND_HALF_UP, Decimal
from typing import NamedTuple
from uuid import uuid4

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.functions.answer_scan import ERROR_KEY, key_of, message_text, read_or_error
from millrace.operators.answers import parse_answer
from millrace.operators.numbering import global_row_number
from millrace.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # as for the row helper: tasks carry the code

# The request sentence and the error for a call that asks for nothing.
ASK, FOR, RETURN = "Find the following information: [", "] for the entity described by: ", ". Return a JSON object with these exact keys: "
ELSE = '. Use "Not found" for any field you cannot determine.'
NO_FIELDS = "No output columns specified"
SCALAR_RAW_LIMIT = 500
DEFAULT_PROMPT = "Answer with one JSON object that has the requested keys."
_BATCH_ROWS = 256
#: The column of a row's running number.
PLACE = "__n"


class Request(NamedTuple):
    text: str
    entity: dict
    fields: list[str]
    prompt: str


# A provider answers a batch of requests in order. An answer is a text, a list of message blocks, or the
# exception that kept one request from being answered.
Provider = Callable[[list[Request]], list]
ProviderFactory = Callable[[], Provider]


def number_text(value: Column) -> Column:
    """A decimal without trailing zeros: 749.90 -> 749.9, 749.00 -> 749."""
    return F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def entity_json(columns: Sequence[str]) -> Column:
    """The described entity as JSON text; columns that are NULL are left out."""
    return F.to_json(F.struct(*columns))


def request_sentence(df: DataFrame, columns: Sequence[str], fields: Sequence[str]) -> Column:
    """The request for one row, in columns only; NULL columns are not mentioned."""
    types = dict(df.dtypes)

    def shown(c: str) -> Column:
        value = number_text(F.col(c)) if types[c].startswith("decimal") else F.col(c).cast("string")
        return F.concat(F.lit(f"{c}: "), value)

    described = F.concat_ws(", ", *[shown(c) for c in columns])
    tail = RETURN + json.dumps(list(fields)) + ELSE
    return F.concat(F.lit(ASK + ", ".join(fields) + FOR), described, F.lit(tail))


def clean_entity(input_json: Column) -> Column:
    """Unreadable or missing JSON becomes an empty object."""
    usable = F.try_parse_json(F.nullif(input_json, F.lit("")))
    return F.when(usable.isNull(), F.lit("{}")).otherwise(input_json)


def answered(requests: DataFrame, answers: DataFrame, keys: Sequence[str], fields: Sequence[str], raw_limit: int | None = None) -> DataFrame:
    """Enrich from a table of answers with at most one ``output_text`` per request key.

    A request without an answer gets the record of an empty one, so no request is lost.
    """
    joined = requests.join(answers.select(*keys, "output_text"), list(keys), "left")
    return joined.withColumn("enriched", parse_answer(F.col("output_text"), fields, raw_limit)).drop("output_text")


def sentence(entity: dict, fields: Sequence[str]) -> str:
    described = ", ".join(f"{k}: {v}" for k, v in entity.items())
    return ASK + ", ".join(fields) + FOR + described + RETURN + json.dumps(list(fields)) + ELSE


def _read_json(text: object, empty: dict | list) -> object:
    """The value of a JSON text; ``empty`` where there is no text or it holds none."""
    value = empty
    if isinstance(text, str) and text.strip():
        with suppress(ValueError, RecursionError):
            value = json.loads(text)
    return value


def _as_request(entity: object, fields: list[str], prompt: str | None) -> Request:
    return Request(sentence(entity, fields), entity, fields, prompt or DEFAULT_PROMPT)


def _made(factory: ProviderFactory) -> Provider:
    """The provider, or one that gives the reason it could not be made as the error of every row."""
    try:
        return factory()
    except Exception as e:
        reason = e
        return lambda requests: [reason] * len(requests)


def enrich_batch(
    provider: Provider,
    rows: Sequence[tuple[object, list[str], str | None]],
    raw_limit: int | None = None,
    stringify_blocks: bool = False,
) -> list[dict]:
    """One record per (entity, fields, prompt). What goes wrong with a row ends up in its own ``error``.

    A call to the provider holds requests with the same fields and the same prompt only.
    """
    records: list[dict | None] = [None] * len(rows)
    asked: list[tuple[int, Request]] = []
    for i, (entity, fields, prompt) in enumerate(rows):
        try:
            asked.append((i, _as_request(entity, fields, prompt)))
        except Exception as e:
            records[i] = {ERROR_KEY: str(e)}
    calls: dict[tuple, list[tuple[int, Request]]] = {}
    for i, request in asked:
        calls.setdefault((tuple(map(str, request.fields)), request.prompt), []).append((i, request))
    for call in calls.values():
        texts = _asked(provider, [r for _, r in call])
        for (i, request), text in zip(call, texts):
            try:
                if isinstance(text, Exception):
                    raise text
                records[i] = read_or_error(message_text(text, stringify_blocks), request.fields, raw_limit)
            except Exception as e:
                records[i] = {ERROR_KEY: str(e)}
    return records


def _asked(provider: Provider, requests: list[Request]) -> list:
    """One answer, or the exception that kept it away, for each request; a call that fails is asked again in halves."""
    try:
        texts = provider(requests)
        if len(requests) == 1:
            return [texts[0]]
        if len(texts) != len(requests):
            raise ValueError(f"{len(texts)} answers to {len(requests)} requests")
        return texts
    except Exception as e:
        half = len(requests) // 2
        return [e] if not half else _asked(provider, requests[:half]) + _asked(provider, requests[half:])


def _kept_provider(token: str, factory: ProviderFactory) -> Provider:
    """The provider of this worker process for ``token``, made once and closed when the process ends.

    It is kept on ``sys``, which all tasks of a process share, however their code came to it. One that could not be made
    is tried again the next time.
    """
    kept = sys.__dict__.setdefault("_millrace_providers", {})
    if token not in kept:
        try:
            kept[token] = factory()
        except Exception:
            return _made(factory)
        close = getattr(kept[token], "close", None)
        if close is not None:
            atexit.register(close)
    return kept[token]


def scalar_function(factory: ProviderFactory, raw_limit: int | None = SCALAR_RAW_LIMIT):
    """UDF (input_json, output_columns as a JSON array, custom_prompt) -> JSON record.

    The provider is made once per task and gets batches of bounded size, so a failed batch is asked again for a few
    rows only. ``raw_limit`` cuts the raw text kept of an answer without an object; None keeps it whole. A provider
    may answer differently each time, so the function is marked as such; write its result before checking it.
    """

    @F.pandas_udf("string")
    def enrich(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        provider = _made(factory)
        for inputs, columns, prompts in batches:
            rows = [(_read_json(i, {}), _read_json(c, []), p) for i, c, p in zip(inputs, columns, prompts)]
            wanted = [n for n, (_, fields, _) in enumerate(rows) if fields]
            records = [{ERROR_KEY: NO_FIELDS}] * len(rows)
            for at in range(0, len(wanted), _BATCH_ROWS):
                some = wanted[at : at + _BATCH_ROWS]
                for n, record in zip(some, enrich_batch(provider, [rows[n] for n in some], raw_limit, True)):
                    records[n] = record
            yield pd.Series([json.dumps(r) for r in records], dtype="object")

    return enrich.asNondeterministic()


def table_function(factory: ProviderFactory):
    """Arrow table function over TABLE(input_json, output_columns, custom_prompt) -> (input, enriched), both JSON.

    Rows come and go as Arrow batches and are asked for in calls of bounded size, each with its own fields and prompt. A
    worker process makes one provider and keeps it, whatever the number of groups in ``PARTITION BY``; a group only
    decides the task, so any column that spreads will do.
    """
    token = uuid4().hex

    @F.arrow_udtf(returnType="input string, enriched string")
    class EnrichRows:
        def eval(self, batch):
            provider = _kept_provider(token, factory)
            names = ("input_json", "output_columns", "custom_prompt")
            inputs, fields, prompts = (batch.column(c).to_pylist() for c in names)
            for at in range(0, len(inputs), _BATCH_ROWS):
                some = slice(at, at + _BATCH_ROWS)
                rows = [(_read_json(i, {}), list(f or []), p) for i, f, p in zip(inputs[some], fields[some], prompts[some])]
                records = enrich_batch(provider, rows)
                entities = [json.dumps(entity) for entity, _, _ in rows]
                yield pa.table({"input": pa.array(entities, pa.string()), "enriched": pa.array([json.dumps(r) for r in records], pa.string())})

    return EnrichRows


def register(
    spark: SparkSession, providers: dict[str, ProviderFactory], name: str = "enrich", raw_limit: int | None = SCALAR_RAW_LIMIT
) -> None:
    """SQL surface: ``<name>`` for the first provider, ``<name>_<provider>`` for each, ``<name>_rows`` as a table function.

    ``<name>(input_json, output_columns [, custom_prompt])`` returns a JSON record.
    """
    for i, (key, factory) in enumerate(providers.items()):
        inner = f"{name}_{key}_internal"
        spark.udf.register(inner, scalar_function(factory, raw_limit))
        for public in [f"{name}_{key}"] + ([name] if i == 0 else []):
            spark.sql(
                f"CREATE OR REPLACE TEMPORARY FUNCTION {public}(input_json STRING, output_columns STRING, "
                f"custom_prompt STRING DEFAULT NULL) RETURNS STRING NOT DETERMINISTIC "
                f"RETURN {inner}(input_json, output_columns, custom_prompt)"
            )
        if i == 0:
            spark.udtf.register(f"{name}_rows", table_function(factory))


def even_tasks(df: DataFrame, tasks: int, order: Sequence[Column]) -> DataFrame:
    """The rows dealt to ``tasks`` tasks whose row counts differ by one at most, whatever their bytes or keys.

    A running number over ``order`` is cut into even runs. Providers take their time by request, so tasks follow rows.
    The rows are written once, with the number.
    """
    numbered = global_row_number(df, order, PLACE)
    return even_runs(numbered, numbered.count(), tasks)


def even_runs(numbered: DataFrame, total: int, tasks: int) -> DataFrame:
    """Rows with a running number ``PLACE`` up to ``total``, dealt to ``tasks`` tasks in even runs."""
    task = F.floor((F.col(PLACE) - 1) * tasks / max(total, 1)).cast("int")
    return numbered.repartitionById(tasks, task).drop(PLACE)


def limited(factory: ProviderFactory, per_second: float) -> ProviderFactory:
    """A provider that asks no more than ``per_second`` requests in each worker process, waiting between its calls."""

    def make() -> Provider:
        provider, free = factory(), [0.0]

        def ask(requests: list[Request]) -> list:
            now = time.monotonic()
            start = max(now, free[0])
            free[0] = start + len(requests) / per_second
            time.sleep(start - now)
            return provider(requests)

        return ask

    return make


def _in_tasks(df: DataFrame, columns: Sequence[str], tasks: int | None) -> DataFrame:
    return df if tasks is None else even_tasks(df, tasks, [F.col(c) for c in columns])


def enrich_column(
    df: DataFrame, columns: Sequence[str], fields: Sequence[str], factory: ProviderFactory,
    prompt: str | Column | None = None, tasks: int | None = None,
) -> DataFrame:
    """Every row of a table with its record as JSON in ``enriched``.

    Runs in the partitions the table has, or in ``tasks`` tasks of equally many rows. ``prompt`` may differ by row.
    """
    call = scalar_function(factory)
    prompt_column = prompt if isinstance(prompt, Column) else F.lit(prompt).cast("string")
    dealt = _in_tasks(df, columns, tasks)
    return dealt.withColumn("enriched", call(entity_json(columns), F.lit(json.dumps(list(fields))), prompt_column))


def enrich_once(
    df: DataFrame, columns: Sequence[str], fields: Sequence[str], factory: ProviderFactory,
    prompt: str | None = None, tasks: int | None = None,
) -> DataFrame:
    """As ``enrich_column``, but equal entities are asked for once, however many rows share them.

    The answers are written before they are joined back: a provider may answer differently the next time, and
    a lost task must not lead to a second answer. Rows of a shared entity keep their partitions until the
    join, where adaptive execution splits a heavy one.
    """
    asked = df.withColumn("__entity", entity_json(columns))
    distinct = _in_tasks(asked.select("__entity").distinct(), ["__entity"], tasks)
    call = scalar_function(factory)
    answers = distinct.withColumn("enriched", call("__entity", F.lit(json.dumps(list(fields))), F.lit(prompt).cast("string")))
    return asked.join(cut_lineage(answers), "__entity").drop("__entity")


def record_columns(df: DataFrame, fields: Sequence[str], record: str = "enriched") -> DataFrame:
    """The fields of a JSON record as text columns in place of the record; an error record gives NULLs."""
    kept = [c for c in df.columns if c != record]
    return df.select(*kept, *[F.get_json_object(record, f"$.{f}").alias(f) for f in fields])


def restating_provider() -> Provider:
    """An offline provider: answers with what the request itself says about the entity."""

    def answer(requests: list[Request]) -> list[str]:
        out = []
        for r in requests:
            wanted = {key_of(f) for f in r.fields}
            known = {k: v for k, v in r.entity.items() if key_of(k) in wanted}
            out.append("Known from the request: " + json.dumps(known))
        return out

    return answer


def _of_request(answer: Callable[[Request], dict]) -> Provider:
    return lambda requests: ["Known from the request: " + json.dumps(answer(r)) for r in requests]


def obedient_provider() -> Provider:
    """An offline provider that does what the prompt says: as the restating one, in capitals where it asks for capitals."""

    def answer(r: Request) -> dict:
        wanted = {key_of(f) for f in r.fields}
        loud = "capitals" in r.prompt.lower()
        return {k: v.upper() if loud and isinstance(v, str) else v for k, v in r.entity.items() if key_of(k) in wanted}

    return _of_request(answer)


def list_price_provider() -> Provider:
    """An offline provider of prices: a tenth below the list price, at a page of the distributor's site."""

    def answer(r: Request) -> dict:
        msrp = r.entity.get("msrp")
        price = None if msrp is None else str((Decimal(str(msrp)) * Decimal("0.9")).quantize(Decimal("0.01"), ROUND_HALF_UP))
        return {"listed_price": price, "discount": "0.10", "listing_url": f"https://{r.entity.get('website_domain')}/p/{r.entity.get('sku_id')}"}

    return _of_request(answer)
