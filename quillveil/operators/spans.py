"""The span type and the order of spans."""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import types as T


class Span(NamedTuple):
    """[start, end) in code points of the text as it was; spans never hold the value."""

    entity_type: str
    start: int
    end: int
    confidence: float
    recognizer: str
    tier: int
    boosted: bool = False


SPAN_TYPE = T.StructType(
    [
        T.StructField("entity_type", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("recognizer", T.StringType()),
        T.StructField("tier", T.IntegerType()),
        T.StructField("boosted", T.BooleanType()),
    ]
)
SPANS_TYPE = T.ArrayType(SPAN_TYPE)
ARROW_SPANS = pa.list_(pa.struct([("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64()), ("recognizer", pa.string()), ("tier", pa.int32()), ("boosted", pa.bool_())]))


def order(s: Span) -> tuple:
    """A total order: by start, longer first, then by what the span says."""
    return s.start, -s.end, s.entity_type, s.recognizer, -s.confidence, s.tier, s.boosted
