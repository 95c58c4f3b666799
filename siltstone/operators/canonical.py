"""Lines to events on Spark.

`lines` is a DataFrame (stream_id, line_no, raw): raw is binary, or text, which is taken as UTF-8. Reading a line is one
pass of an Arrow kernel, so bytes cross to Python once; what comes before and behind are built-in expressions.

Three modes. `stateless` routes every line by itself: nothing is shuffled, time stamps without a year stay open and there are
no ids. `stream` is exact: a stream's format sticks, years follow from the line before, ids count up. For that a stream's
lines are dealt to one task and sorted by line_no; the task holds one line's state, not the stream, so a long stream
costs time, not memory.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records
from ..plans.packages import NO_RULES
from ..plans.rules import Rules
from ..session import prepare
from .split import CHUNK, canonicalize_split
from .stream import Declaration, Event, Reader, State

_ID = "decimal(20,0)"
EVENT_DDL = (
    "stream_id string, line_no long, id long, timestamp_ns long, declared_timestamp boolean, level string, declared_level boolean, "
    "format string, component string, host string, template_str string, params array<string>, structural_role string, "
    f"trace struct<present: boolean, has_parent: boolean, is_span: boolean, trace_id: {_ID}, span_id: {_ID}, parent_span_id: {_ID}>, "
    "ordinals array<struct<field_name: string, schedule: string, value: long>>, "
    f"linked_span_ids array<{_ID}>, echoed_source boolean, no_role_witness_key string, template_id string, content string, no_event_reason string"
)
_WIDE = pa.decimal128(20, 0)
EVENT_ARROW = pa.schema(
    [
        ("stream_id", pa.string()),
        ("line_no", pa.int64()),
        ("id", pa.int64()),
        ("timestamp_ns", pa.int64()),
        ("declared_timestamp", pa.bool_()),
        ("level", pa.string()),
        ("declared_level", pa.bool_()),
        ("format", pa.string()),
        ("component", pa.string()),
        ("host", pa.string()),
        ("template_str", pa.string()),
        ("params", pa.list_(pa.string())),
        ("structural_role", pa.string()),
        ("trace", pa.struct([("present", pa.bool_()), ("has_parent", pa.bool_()), ("is_span", pa.bool_()), ("trace_id", _WIDE), ("span_id", _WIDE), ("parent_span_id", _WIDE)])),
        ("ordinals", pa.list_(pa.struct([("field_name", pa.string()), ("schedule", pa.string()), ("value", pa.int64())]))),
        ("linked_span_ids", pa.list_(_WIDE)),
        ("echoed_source", pa.bool_()),
        ("no_role_witness_key", pa.string()),
        ("template_id", pa.string()),
        ("content", pa.string()),
        ("no_event_reason", pa.string()),
    ]
)

CONTEXT_DDL = EVENT_DDL + ", context map<string,string>"
CONTEXT_ARROW = EVENT_ARROW.append(pa.field("context", pa.map_(pa.string(), pa.string())))


def _trace(t: records.Trace) -> dict:
    return vars(t) | {k: Decimal(getattr(t, k)) for k in ("trace_id", "span_id", "parent_span_id")}


def utf8(latin: str) -> str:
    """Latin-1 text back as UTF-8; each ill-formed part becomes U+FFFD."""
    return latin if latin.isascii() else latin.encode("latin-1").decode("utf-8", "replace")


_NAMES = EVENT_ARROW.names
_TRACE = _NAMES.index("trace")
_NO_EVENT = (None,) * (len(_NAMES) - 3)


def event_cells(stream: str, line_no: int, event: Event | None, reason: str, stateless: bool = False) -> tuple:
    """An event in the order of EVENT_ARROW, its trace as it is; a line without one keeps its place and says why."""
    if event is None:
        return stream, line_no, *_NO_EVENT, reason
    p = event.parsed
    return (
        stream,
        line_no,
        None if stateless else event.id,
        event.timestamp_ns,
        p.declared_timestamp,
        p.level,
        p.declared_level,
        p.format,
        utf8(p.component),
        utf8(p.host),
        utf8(event.template),
        [utf8(x) for x in event.params],
        event.role,
        p.trace,
        [dict(zip(("field_name", "schedule", "value"), o)) for o in p.ordinals],
        [Decimal(x) for x in p.linked_span_ids],
        p.echoed_source,
        utf8(p.no_role_witness_key),
        event.template_id,
        utf8(p.content),
        None,
    )


def event_row(stream: str, line_no: int, event: Event | None, reason: str, stateless: bool = False) -> dict:
    """event_cells() as a row of EVENT_ARROW."""
    row = dict(zip(_NAMES, event_cells(stream, line_no, event, reason, stateless), strict=True))
    if event is not None:
        row["trace"] = _trace(row["trace"])
    return row


def event_batch(cells: list[tuple]) -> pa.RecordBatch:
    """Rows of event_cells() as columns. Hardly a line has a trace, so each different one is made once and taken by place."""
    columns = list(zip(*cells)) or [()] * len(_NAMES)
    traces = {t: k for k, t in enumerate(dict.fromkeys(columns[_TRACE]))}
    made = pa.array([None if t is None else _trace(t) for t in traces], EVENT_ARROW.field("trace").type)
    places = pa.array([traces[t] for t in columns[_TRACE]], pa.int64())
    arrays = [made.take(places) if k == _TRACE else pa.array(own, f.type) for k, (own, f) in enumerate(zip(columns, EVENT_ARROW, strict=True))]
    return pa.RecordBatch.from_arrays(arrays, schema=EVENT_ARROW)


def with_bytes(lines: DataFrame) -> DataFrame:
    prepare(lines.sparkSession)
    return lines.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("line_no").cast("long").alias("line_no"), F.col("raw").cast("binary").alias("raw"))


def latin_lines(batch: pa.RecordBatch) -> Iterator[tuple[str, int, str]]:
    for stream, number, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
        yield stream, number, (raw or b"").decode("latin-1")


def canonicalize(
    lines: DataFrame,
    rules: Rules = NO_RULES,
    declarations: Declaration | Mapping[str, Declaration] | DataFrame = Declaration(),
    mode: str = "stateless",
    normalize: bool = True,
    pinned: str = "",
    test_where: bool = False,
    chunk_lines: int = CHUNK,
    contexts: DataFrame | None = None,
) -> DataFrame:
    """A row of EVENT_DDL to each line, in no order. Null raw bytes are an empty line.

    `declarations` is one for all streams, or one by stream_id (streams that it doesn't name declare nothing), or a table
    (stream_id, dialect, channel, transports array<string>, context map<string,string>) for any number of streams, which is
    joined to the lines; see with_declarations().
    `contexts` (stream_id, line_no, context map<string,string>) declares contexts anew within streams: each replaces the
    stream's as a whole and the year to resolve by, for the lines from its line_no on. Events then have a last column,
    context: the one in force. Lines are dealt by stream for that, in stateless mode too.
    """
    if mode not in ("stateless", "stream", "split"):
        raise ValueError(f"mode {mode!r} is neither 'stateless' nor 'stream' nor 'split'")
    stateless = mode == "stateless"
    lines = with_bytes(lines)
    reader_of = readers(rules, declarations, normalize, pinned, test_where, stateless)
    arrow, ddl = EVENT_ARROW, EVENT_DDL
    if contexts is not None:
        lines, arrow, ddl = with_contexts(lines, contexts), CONTEXT_ARROW, CONTEXT_DDL
    if isinstance(declarations, DataFrame):
        lines = with_declarations(lines, declarations)
    if mode == "split":
        return canonicalize_split(lines, reader_of, event_row, arrow, ddl, chunk_lines)
    if contexts is not None:
        return _canonicalize_declared(lines, reader_of, stateless)
    if mode == "stream":
        lines = lines.repartition("stream_id").sortWithinPartitions("stream_id", "line_no")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, reader = object(), State(), None
        for batch in batches:
            rows = []
            for (stream, number, raw), said in zip(latin_lines(batch), declared(batch), strict=True):
                if reader is None or stream != current:
                    current, state, reader = stream, State(), reader_of(stream, said)
                rows.append(event_cells(stream, number, *reader.read(raw, state), stateless))
            yield event_batch(rows)

    return lines.mapInArrow(read, EVENT_DDL)


def with_declarations(lines: DataFrame, declarations: DataFrame) -> DataFrame:
    """`lines` and, as `declared`, what their stream declares: a row of `declarations` as JSON, null where none names it.

    An equi-join on stream_id: the table is broadcast only where the session's limit of size lets it, else both sides are
    dealt by stream, and a stream with a large share of the lines is split by the adaptive join. Null members declare
    nothing. Of several rows for one stream the one least as JSON counts. What a dialect or transport doesn't know fails the
    job when the stream is read.
    """
    row = F.to_json(F.struct("dialect", "channel", "transports", "context"))
    named = declarations.where("stream_id IS NOT NULL").groupBy(F.col("stream_id").cast("string").alias("stream_id")).agg(F.min(row).alias("declared"))
    return lines.join(named, "stream_id", "left")


def declared(batch: pa.RecordBatch) -> list[str | None]:
    """The declarations of a batch's lines, null where lines have none of their own."""
    return batch.column("declared").to_pylist() if "declared" in batch.schema.names else [None] * batch.num_rows


def declaration_of(said: str) -> Declaration:
    own = json.loads(said)
    context = own.get("context") or {}
    return Declaration(own.get("dialect") or "", own.get("channel") or "", tuple(own.get("transports") or ()), tuple(context.items()))


def with_contexts(lines: DataFrame, contexts: DataFrame) -> DataFrame:
    """(stream_id, line_no, raw, said): `lines`, and `contexts` as rows with said, their context as JSON."""
    context = F.coalesce(F.to_json(F.col("context")), F.lit("{}"))
    changes = contexts.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("line_no").cast("long").alias("line_no"), F.lit(None).cast("binary").alias("raw"), context.alias("said"))
    return lines.withColumn("said", F.lit(None).cast("string")).unionByName(changes)


def _canonicalize_declared(lines: DataFrame, reader_of: Callable[[str], Reader], stateless: bool) -> DataFrame:
    """Events of with_contexts(); a context stands before the line of its number."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, reader = object(), State(), None
        for batch in batches:
            rows = []
            columns = (*(batch.column(c).to_pylist() for c in ("stream_id", "line_no", "raw", "said")), declared(batch))
            for stream, number, raw, said, own in zip(*columns, strict=True):
                if reader is None or stream != current:
                    current, state, reader = stream, State(), reader_of(stream, own)
                if said is not None:
                    reader, state.year_reference = reader.declared(json.loads(said)), None
                    continue
                row = event_row(stream, number, *reader.read((raw or b"").decode("latin-1"), state), stateless)
                rows.append(row | {"context": list(reader.context.items())})
            yield pa.RecordBatch.from_pylist(rows, schema=CONTEXT_ARROW)

    ordered = lines.repartition("stream_id").sortWithinPartitions("stream_id", "line_no", F.col("said").asc_nulls_last())
    return ordered.mapInArrow(read, CONTEXT_DDL)


#: Readers that a worker keeps; each has a masker's memory.
KEPT = 256


def readers(
    rules: Rules, declarations, normalize: bool = True, pinned: str = "", test_where: bool = False, stateless: bool = False
) -> Callable[[str, str | None], Reader]:
    """A function that gives a stream's reader, made once to a declaration and worker.

    Its second argument is what with_declarations() found, which a table of declarations goes by.
    """
    if isinstance(declarations, DataFrame):
        declarations = Declaration()  # the closure must not hold the table
    elif isinstance(declarations, Mapping):
        for d in declarations.values():
            Reader(rules, d)  # a bad declaration fails here, not on an executor
    else:
        Reader(rules, declarations)

    def of(stream: str, said: str | None = None, made: dict = {}) -> Reader:  # noqa: B006
        by_name = declarations.get(stream, Declaration()) if isinstance(declarations, Mapping) else declarations
        d = by_name if said is None else said
        if d not in made:
            if len(made) >= KEPT:
                made.clear()
            made[d] = Reader(rules, d if said is None else declaration_of(said), normalize, pinned, test_where, stateless)
        return made[d]

    return of


def detect_formats(lines: DataFrame, rules: Rules = NO_RULES) -> DataFrame:
    """(stream_id, format): the format of the largest sum of confidences over each stream's lines; ties in a fixed order."""
    from ..functions.formats import Detector

    custom = rules.formats
    names = Detector(custom).order()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector(custom)
        for batch in batches:
            total: dict[tuple[str, str], int] = {}
            for stream, _, line in latin_lines(batch):
                # Sums of whole hundredths agree whatever the order of lines.
                for name, own in (detector.scores(line) or {}).items():
                    total[stream, name] = total.get((stream, name), 0) + round(100 * own)
                if line.strip(" \t"):
                    total.setdefault((stream, "RawText"), 0)
            rows = [{"stream_id": s, "format": n, "score": v} for (s, n), v in total.items()]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("stream_id", pa.string()), ("format", pa.string()), ("score", pa.int64())]))

    sums = with_bytes(lines).mapInArrow(score, "stream_id string, format string, score long").groupBy("stream_id", "format").agg(F.sum("score").alias("score"))
    order = F.array_position(F.array(*map(F.lit, names)), F.col("format"))
    best = F.max_by("format", F.struct((F.col("format") != "RawText") & (F.col("score") > 0), "score", -order))
    return sums.where("score > 0 OR format = 'RawText'").groupBy("stream_id").agg(best.alias("format"))


def unpack_exports(documents: DataFrame) -> DataFrame:
    """`documents` (stream_id, line_no, raw) with an export document as a row to each of its spans; adds sub_no, from 0."""
    schema = pa.schema([("stream_id", pa.string()), ("line_no", pa.int64()), ("sub_no", pa.int64()), ("raw", pa.binary())])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for stream, number, raw in latin_lines(batch):
                parts = records.unpack_export(raw) if records.is_export(raw) else [raw]
                rows += [{"stream_id": stream, "line_no": number, "sub_no": k, "raw": x.encode("latin-1")} for k, x in enumerate(parts)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return with_bytes(documents).mapInArrow(unpack, "stream_id string, line_no long, sub_no long, raw binary")


# --- what follows is built-in expressions over events


def template_ids(templates: Column) -> Column:
    """The ids of templates given as UTF-8 text."""
    return F.concat(F.lit("h:"), F.substring(F.sha2(templates, 256), 1, 32))


def counters(events: DataFrame) -> DataFrame:
    """(stream_id, parsed, failed, skipped, events, empty_projections) of each stream."""
    why = F.col("no_event_reason")
    skipped = why.isin("empty line", "blank line")
    return events.groupBy("stream_id").agg(
        F.count_if(why.isNull()).alias("parsed"),
        F.count_if(why.isNotNull() & ~skipped).alias("failed"),
        F.count_if(skipped).alias("skipped"),
        F.count_if(why.isNull()).alias("events"),
        F.count_if(why.isNull() & (F.col("content") == "")).alias("empty_projections"),
    )


def _escaped(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ("|", "\\|")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _flag(x: Column) -> Column:
    return F.when(x, "1").otherwise("0")


def _counted(xs: Column) -> Column:
    return F.concat_ws("|", F.size(xs).cast("string"), xs)


def projection(events: DataFrame) -> DataFrame:
    """(stream_id, line_no, template_id) and an event's sixteen members as text, lists led by their count; lines without an event are left out."""
    text = lambda c: _escaped(F.col(c)).alias(c)
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    flag = lambda c: _flag(F.col(c)).alias(c)
    trace = F.concat_ws(",", *[_flag(F.col(f"trace.{c}")) for c in ("present", "has_parent", "is_span")], *[F.col(f"trace.{c}").cast("string") for c in ("trace_id", "span_id", "parent_span_id")])
    ordinals = F.transform("ordinals", lambda o: F.concat_ws(",", _escaped(o.field_name), o.schedule, o.value.cast("string")))
    return events.where("no_event_reason IS NULL").select(
        "stream_id",
        "line_no",
        "template_id",
        number("id"),
        number("timestamp_ns"),
        flag("declared_timestamp"),
        "level",
        flag("declared_level"),
        "format",
        text("component"),
        text("host"),
        text("template_str"),
        _counted(F.transform("params", _escaped)).alias("params"),
        "structural_role",
        trace.alias("trace"),
        _counted(ordinals).alias("ordinals"),
        _counted(F.transform("linked_span_ids", lambda x: x.cast("string"))).alias("linked_span_ids"),
        flag("echoed_source"),
        text("no_role_witness_key"),
    )


