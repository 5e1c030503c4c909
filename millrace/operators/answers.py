"""Provider answers to columns: last message, text blocks, output cap, JSON object out of prose."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from millrace.functions import answer_scan
from millrace.functions.answer_scan import ERROR_KEY, RAW_KEY, read_or_error

# Tasks carry the row helper with them; the executors need no copy of this package.
cloudpickle.register_pickle_by_value(answer_scan)

# Longest tool output and the mark left where it was cut.
MAX_TOOL_CHARS = 80000
CUT_MARK = "\n\n[OUTPUT TRUNCATED]"


def cap_text(text: Column, limit: int = MAX_TOOL_CHARS) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(CUT_MARK))).otherwise(text)


def last_assistant_text(messages: DataFrame) -> DataFrame:
    """The newest assistant message of each conversation."""
    return messages.where(F.col("role") == "assistant").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


def blocks_text(content: Column) -> Column:
    """Text of a message given as JSON: a string, or a list of blocks of which the text ones are joined."""
    message = F.try_parse_json(content)
    kind = F.schema_of_variant(message)

    def block_text(block: Column) -> Column:
        is_text = F.try_variant_get(block, "$.type", "string") == "text"
        return (
            F.when(F.schema_of_variant(block) == "STRING", F.try_variant_get(block, "$", "string"))
            .when(is_text, F.try_variant_get(block, "$.text", "string"))
        )

    blocks = F.transform(F.try_variant_get(message, "$", "array<variant>"), block_text)
    joined = F.array_join(F.filter(blocks, lambda b: b.isNotNull()), "\n")
    return F.when(kind.startswith("ARRAY"), joined).when(kind == "STRING", F.try_variant_get(message, "$", "string"))


def record_type(fields: Sequence[str]) -> StructType:
    """The wanted fields as texts, ``_raw`` for the text of an answer without a JSON object, and ``error``."""
    return StructType([StructField(f, StringType()) for f in dict.fromkeys((*fields, RAW_KEY, ERROR_KEY))])


def parse_answer(text: Column, fields: Sequence[str], raw_limit: int | None = None) -> Column:
    """Record of the wanted fields out of a free-text answer; a missing answer counts as an empty one.

    An answer that cannot be read fills only ``error``; it never ends the job.

    One Arrow pass with the row helper. Only the answer crosses to Python and only the record comes back.
    """
    wanted = list(fields)

    @F.arrow_udf(record_type(wanted))
    def read(texts: pa.Array) -> pa.Array:
        empty = read_or_error("", wanted, raw_limit)
        records = [read_or_error(t, wanted, raw_limit) if t else empty for t in texts.to_pylist()]
        names = list(dict.fromkeys((*wanted, RAW_KEY, ERROR_KEY)))
        return pa.StructArray.from_arrays([pa.array([r.get(n) for r in records], pa.string()) for n in names], names=names)

    return read(text)
