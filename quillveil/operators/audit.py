"""The journal: counts of what was masked, never values."""

from __future__ import annotations

import json
import os
import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.catalogs import DETERMINISTIC_TYPES, ENTITY_TYPES

#: How a request may end, and why it may be refused.
RESULTS = ("completed", "refused", "stream_failed", "aborted")
ERRORS = (
    "shape_request", "shape_unsupported", "tool_arguments_malformed", "shape_response", "shape_pointer", "detector_transport", "detector_status", "mapping_unknown_placeholder",
    "mapping_bad_span", "mapping_too_deep", "mapping_too_large", "mapping_known_values_overlap", "mapping_literal_already_issued", "mapping_mask_mismatch", "mapping_placeholder_key",
    "mapping_lossy_document", "mapping_unsafe_place", "upstream_failed", "session_bad_id", "session_disabled", "session_no_credential", "session_saturated", "audit_write_failed",
    "tool_too_large", "tool_too_many_calls", "tool_numeric_personal_data", "caller_not_served", "detection_deadline",
)
STREAM_ERRORS = (
    "stream_unrestorable", "stream_bad_span", "stream_too_deep", "stream_too_large", "stream_known_values_overlap", "stream_literal_already_issued", "stream_mask_mismatch",
    "stream_placeholder_key", "stream_lossy_document", "stream_unsafe_place", "stream_shape_request", "stream_shape_response", "stream_shape_pointer", "stream_shape_unsupported",
    "stream_tool_arguments_malformed", "stream_unplaceable", "stream_oversized", "stream_stalled", "stream_too_many_runs", "stream_tool_document_too_large", "stream_malformed", "stream_broken",
)
UNKNOWN = "unvalidated"


def digest(salt: bytes, *parts: Column) -> Column:
    """32 hex digits of salted, length-prefixed parts: equal for equal parts, telling nothing else."""
    pieces = [F.lit(salt.hex())]
    for p in parts:
        p = F.coalesce(p.cast("string"), F.lit(""))
        pieces += [F.lpad(F.hex(F.octet_length(p)), 16, "0"), F.hex(F.encode(p, "UTF-8"))]
    return F.substring(F.sha2(F.unhex(F.concat(*pieces)), 256), 1, 32)


def new_salt() -> bytes:
    return secrets.token_bytes(32)


def masked_events(found: DataFrame, requests: DataFrame, request: list[str]) -> DataFrame:
    """One row a request: texts, spans (occurrences), types (distinct values of each), redacted, forwarded.

    requests: all requests, with a column texts; found: request, entity_type, value and optionally numeric (a number leaf).
    """
    kind = F.when(F.col("entity_type").isin(*ENTITY_TYPES), F.col("entity_type")).otherwise(F.lit(UNKNOWN))
    numeric = F.col("numeric") if "numeric" in found.columns else F.lit(False)
    forwarded = numeric & ~F.col("entity_type").isin(*DETERMINISTIC_TYPES) & F.col("entity_type").isin(*ENTITY_TYPES)
    rows = found.select(*request, kind.alias("kind"), "value", forwarded.alias("forwarded"))
    totals = rows.groupBy(*request).agg(F.count("*").alias("spans"), F.sum((~F.col("forwarded")).cast("long")).alias("redacted"), F.sum(F.col("forwarded").cast("long")).alias("forwarded"))
    per_type = rows.groupBy(*request, "kind").agg(F.countDistinct("value").alias("n"))
    types = per_type.groupBy(*request).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("types"))
    out = requests.join(totals, request, "left").join(types, request, "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("spans", "redacted", "forwarded")}
    return out.withColumns(zero | {"types": F.coalesce("types", F.expr("map_from_entries(cast(array() as array<struct<kind:string,n:bigint>>))")), "event": F.lit("masked")})


def unremembered(fresh: Column, held: Column, most: int = 1000) -> Column:
    """Fresh values beyond what a session may still keep."""
    return F.greatest(fresh - F.greatest(F.lit(most) - held, F.lit(0)), F.lit(0))


def outcome_events(requests: DataFrame, result: str = "status", error: str = "error_class") -> DataFrame:
    """How each request ended; results and errors outside the vocabulary become aborted and null."""
    known = F.when(F.col(result).isin(*RESULTS), F.col(result)).otherwise(F.lit("aborted"))
    why = F.when(F.col(error).isin(*ERRORS, *STREAM_ERRORS), F.col(error))
    return requests.withColumns({"event": F.lit("outcome"), "result": known, "error": why})


def append(events: DataFrame, path: str) -> None:
    """Adds events to a JSON-lines journal; a file appears whole or not at all."""
    events.write.mode("append").json(path)


def stamped(events: DataFrame, at: Column | None = None) -> DataFrame:
    """Events with ts, the time in UTC as RFC 3339 writes it."""
    now = F.current_timestamp() if at is None else at
    return events.withColumn("ts", F.date_format(F.to_utc_timestamp(now, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


class Journal:
    """A JSON-lines file of one writer.  An event is on disk before append returns, and a line that a failure left torn is closed first."""

    def __init__(self, path: str):
        self.path = path

    def append(self, event: dict, durable: bool = True) -> None:
        line = json.dumps(event, ensure_ascii=False, separators=(",", ":")).encode() + b"\n"
        with open(self.path, "ab+") as f:
            if f.tell():
                f.seek(-1, os.SEEK_END)
                if f.read(1) != b"\n":
                    line = b"\n" + line
            f.write(line)
            f.flush()
            if durable:
                os.fsync(f.fileno())

    def events(self) -> list[dict]:
        """What can be read; torn lines are left out."""
        out = []
        with open(self.path, "rb") as f:
            for line in f:
                try:
                    out.append(json.loads(line))
                except ValueError:
                    continue
        return out


def admitted(requests: DataFrame, credential: str, accepted: list[str]) -> DataFrame:
    """Requests whose credential's SHA-256 is on the list."""
    return requests.where(F.sha2(F.col(credential), 256).isin(*accepted))


def session_id_ok(column: str) -> Column:
    return F.col(column).rlike(r"^[A-Za-z0-9._:-]{1,128}$")


def session_identity(salt: bytes, credential: Column, session: Column) -> list[Column]:
    """(caller, session) that a mapping belongs to: a session id of one caller is no session of another's."""
    return [digest(salt, credential).alias("caller"), session.alias("session")]
