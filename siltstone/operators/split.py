"""The exact mode for streams too long for one task.

A stream is cut in chunks of lines. What a chunk does to the stream's state is small and can be said without knowing the
state that reaches it, so chunks are summarised in parallel, the summaries are folded in order, and the chunks are read in
parallel, each from the state that truly reaches it. The folds see a row to a chunk.
  1. routes: the format after the chunk, for each format before it. Nearly all lines leave one format whatever the one
     before, so a few lines into a chunk there is one path to follow.
  2. times and ids: how many events the chunk has, and the last time; where no line of it has a year, its stamps.
  3. events, from the true state.
One exchange of the lines serves the three passes. Lines are read about one and a half times as long as in one pass.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..functions.formats import RAW_TEXT
from ..functions.lines import peel, without_ending, without_escapes
from .stream import Reader, State

CHUNK = 20_000
_SAID = pa.schema([("stream_id", pa.string()), ("chunk", pa.int64()), ("said", pa.string())])
_SAID_DDL = "stream_id string, chunk long, said string"


def _ordered(rows: pa.Table) -> Iterator[tuple[int, str]]:
    rows = rows.sort_by("line_no")
    if "said" in rows.column_names:
        rows = rows.filter(pc.is_null(rows["said"]))
    for number, raw in zip(rows["line_no"].to_pylist(), rows["raw"].to_pylist(), strict=True):
        yield number, (raw or b"").decode("latin-1")


def _declared(rows: pa.Table) -> Iterator[tuple[int, str | None, dict | None]]:
    """(line_no, line, None) in order, or (line_no, None, context) before the line from which a context is in force."""
    if "said" not in rows.column_names:
        yield from ((number, raw, None) for number, raw in _ordered(rows))
        return
    rows = rows.sort_by([("line_no", "ascending"), ("said", "ascending")])  # nulls last
    for number, raw, said in zip(*(rows[c].to_pylist() for c in ("line_no", "raw", "said")), strict=True):
        yield (number, (raw or b"").decode("latin-1"), None) if said is None else (number, None, json.loads(said))


def routes(reader: Reader, lines: Iterator[str]) -> dict[str, str]:
    """The sticky format after `lines`, by the one before; `*` stands for all that aren't named."""
    names = ["", RAW_TEXT.name, *reader.detector.by_name]
    now = {name: name for name in names}
    for raw in lines:
        content = peel(raw, reader.stack)[0] if reader.stack else raw
        if reader.stack and not content.strip(" \t\r"):
            continue
        content = without_ending(content)
        line = without_escapes(content) if reader.normalize else content
        if not line:
            continue
        after: dict[str, str] = {}
        for state in set(now.values()):
            routed = State(state)
            reader.route(line, routed)
            after[state] = routed.sticky
        now = {name: after[state] for name, state in now.items()}
    ends = list(now.values())
    usual = max(set(ends), key=ends.count)
    return {"*": usual} | {name: end for name, end in now.items() if end != usual}


def summary(reader: Reader, lines: Iterator[tuple[int, str | None, dict | None]], sticky: str) -> dict:
    """How many events the lines have and the last time among them; their stamps without a year while none has one.

    The last context that they declare, if any, and the times behind it alone.
    """
    state, n, last, stamps, context = State(sticky), 0, None, [], None
    for _, raw, declared in lines:
        if declared is not None:
            last, stamps, context = None, [], declared
            continue
        content = peel(raw, reader.stack)[0] if reader.stack else raw
        if reader.stack and not content.strip(" \t\r"):
            continue
        parsed, _ = reader.parse(content, state)
        if parsed is None:
            continue
        n += 1
        if parsed.yearless and last is None:
            stamps.append(parsed.yearless)
        elif parsed.yearless:
            at = times.resolve_yearless(parsed.yearless, last)
            last = last if at is None else at
        elif parsed.ts_ns is not None:
            last, stamps = parsed.ts_ns, []
    return {"n": n, "last": last, "stamps": stamps, "context": context}


def _folded(said: DataFrame, start: dict, step: Callable[[dict, dict], dict]) -> DataFrame:
    """(stream_id, chunk, said): the state that reaches each chunk, by folding summaries in order, and the chunk's format."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), start
        for batch in batches:
            out = []
            for stream, chunk, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stream != current:
                    current, state = stream, start
                own = json.loads(text)
                reached = {"sticky": own["sticky"]} | state if "sticky" in own else state
                out.append({"stream_id": stream, "chunk": chunk, "said": json.dumps(reached)})
                state = step(state, own)
            yield pa.RecordBatch.from_pylist(out, schema=_SAID)

    return said.repartition("stream_id").sortWithinPartitions("stream_id", "chunk").mapInArrow(fold, _SAID_DDL)


def _route_step(state: dict, said: dict) -> dict:
    return {"sticky": said["routes"].get(state["sticky"], said["routes"]["*"])}


def _time_step(state: dict, said: dict) -> dict:
    year = state["year"] if said["context"] is None else None
    if said["last"] is not None:
        year = said["last"]
    elif year is not None:
        for stamp in said["stamps"]:
            at = times.resolve_yearless(times.Yearless(*stamp), year)
            year = year if at is None else at
    return {"year": year, "id": state["id"] + said["n"], "context": state["context"] if said["context"] is None else said["context"]}


def canonicalize_split(
    lines: DataFrame, reader_of: Callable[..., Reader], row: Callable, arrow: pa.Schema, ddl: str, chunk_lines: int = CHUNK
) -> DataFrame:
    """Events of `lines` (stream_id, line_no, raw), the same as in the exact mode. `row` makes a row of an event."""
    chunks = lines.withColumn("chunk", F.floor(F.col("line_no") / chunk_lines).cast("long"))
    by = ("stream_id", "chunk")

    def said(key: tuple[pa.Scalar, ...], what: dict) -> pa.Table:
        return pa.Table.from_pylist([{"stream_id": key[0].as_py(), "chunk": key[1].as_py(), "said": json.dumps(what)}], schema=_SAID)

    def own(key: tuple[pa.Scalar, ...], rows: pa.Table) -> Reader:
        return reader_of(key[0].as_py(), rows["declared"][0].as_py() if "declared" in rows.column_names and len(rows) else None)

    def route(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        return said(key, {"routes": routes(own(key, rows), (raw for _, raw in _ordered(rows)))})

    def count(key: tuple[pa.Scalar, ...], rows: pa.Table, before: pa.Table) -> pa.Table:
        reader, state = own(key, rows), json.loads(before["said"][0].as_py())
        return said(key, summary(reader, _declared(rows), state["sticky"]) | {"sticky": state["sticky"]})

    def read(key: tuple[pa.Scalar, ...], rows: pa.Table, before: pa.Table) -> pa.Table:
        reader, said_ = own(key, rows), json.loads(before["said"][0].as_py())
        state = State(said_["sticky"], said_["year"], said_["id"])
        if said_["context"] is not None:
            reader = reader.declared(said_["context"])
        out = []
        for n, raw, declared in _declared(rows):
            if declared is not None:
                reader, state.year_reference = reader.declared(declared), None
                continue
            event = row(key[0].as_py(), n, *reader.read(raw, state))
            out.append(event | {"context": list(reader.context.items())} if "context" in arrow.names else event)
        return pa.Table.from_pylist(out, schema=arrow)

    routed = _folded(chunks.groupBy(*by).applyInArrow(route, _SAID_DDL), {"sticky": ""}, _route_step)
    counted = chunks.groupBy(*by).cogroup(routed.groupBy(*by)).applyInArrow(count, _SAID_DDL)
    reached = _folded(counted, {"year": None, "id": 0, "context": None}, _time_step)
    return chunks.groupBy(*by).cogroup(reached.groupBy(*by)).applyInArrow(read, ddl)
