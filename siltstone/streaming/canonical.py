"""The exact mode of canonicalize() over a stream of lines, with a stream's state between micro-batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.canonical import readers, utf8, with_bytes, with_contexts, with_declarations
from ..operators.stream import Declaration, State
from ..plans.packages import NO_RULES
from ..plans.rules import Rules

STREAM_DDL = (
    "stream_id string, line_no long, id long, timestamp_ns long, level string, format string, component string, host string, "
    "template_str string, template_id string, structural_role string, no_event_reason string"
)
_STATE_DDL = "sticky string, year_reference long, next_id long, context string"


def canonicalize_stream(lines: DataFrame, rules: Rules = NO_RULES, declarations=Declaration(), normalize: bool = True, contexts: DataFrame | None = None) -> DataFrame:
    """Events of a streaming DataFrame (stream_id, line_no, raw), in append mode.

    Lines of a stream are read in order of line_no within a micro-batch; batches must come in order. What a stream keeps
    is its format, the last time and the next id, however long it is. Event time is the events' own: add a watermark on
    timestamp_ns behind this where windows follow. `contexts` is as for canonicalize(), a streaming DataFrame too; a context
    must come in the batch of the first line that it is for, or before. `declarations` may be a table as there, not a stream.
    """
    reader_of = readers(rules, declarations, normalize)

    def read(key: tuple, frames: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        state, context = State(), None
        if kept.exists:
            sticky, year, next_id, context = kept.get
            state = State(sticky or "", year, next_id)
        frames = list(frames)
        own = frames[0]["declared"].iloc[0] if "declared" in frames[0] else None
        reader, rows = reader_of(key[0], None if pd.isna(own) else own), []
        if context is not None:
            reader = reader.declared(json.loads(context))
        given = ((n, pd.isna(s), "" if pd.isna(s) else s, r or b"") for f in frames for n, r, s in zip(f["line_no"], f["raw"], f["said"]))
        for number, is_line, said, raw in sorted(given):
            if not is_line:
                context = said
                reader, state.year_reference = reader.declared(json.loads(said)), None
                continue
            event, why = reader.read(bytes(raw).decode("latin-1"), state)
            if event is None:
                rows.append((key[0], number, *[None] * 9, why))
                continue
            p = event.parsed
            said = (p.level, p.format, utf8(p.component), utf8(p.host), utf8(event.template), event.template_id, event.role)
            rows.append((key[0], number, event.id, event.timestamp_ns, *said, None))
        kept.update((state.sticky, state.year_reference, state.next_id, context))
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in STREAM_DDL.split(", ")])
        for c in ("id", "timestamp_ns"):
            out[c] = out[c].astype("Int64")
        yield out

    rows = with_bytes(lines)
    rows = rows.withColumn("said", F.lit(None).cast("string")) if contexts is None else with_contexts(rows, contexts)
    if isinstance(declarations, DataFrame):
        rows = with_declarations(rows, declarations)
    return rows.groupBy("stream_id").applyInPandasWithState(read, STREAM_DDL, _STATE_DDL, "append", "NoTimeout")


def windowed_levels(events: DataFrame, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Counts of levels in event-time windows, late events dropped behind the watermark; events without a time are left out."""
    timed = events.where("timestamp_ns IS NOT NULL").withColumn("at", F.timestamp_micros(F.floor(F.col("timestamp_ns") / 1000).cast("long")))
    return timed.withWatermark("at", late).groupBy(F.window("at", width), "level").agg(F.count(F.lit(1)).alias("n"))
