"""Aggregates over events: template counts and cardinality, entropy in fixed point, digests, run outcomes, units."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identity import FRACTION, discriminant, log2_fixed, unit_class
from ..functions.levels import LEVEL_WORDS, Line, lower
from ..plans.packages import NO_RULES
from ..plans.rules import Rules
from ..plans.walkers import console_verdict, end_of, outcome_of_token, outcome_of_token_in, unit_of
from .canonical import canonicalize, declaration_of, declared, latin_lines, projection, readers, utf8, with_bytes, with_declarations
from .stream import CELLS, Declaration, State


def template_counts(events: DataFrame, *by: str) -> DataFrame:
    """(by..., template_id, template_str, n): partial counts are made before the shuffle."""
    return events.where("no_event_reason IS NULL").groupBy(*by, "template_id", "template_str").agg(F.count(F.lit(1)).alias("n"))


def top_templates(events: DataFrame, k: int = 15) -> DataFrame:
    """The k most frequent templates, equal counts in order of text."""
    return template_counts(events).orderBy(F.desc("n"), "template_str").limit(k)


def compare_templates(events: DataFrame, side: str, before: str, after: str) -> DataFrame:
    """(template_str, n_before, n_after): how often each template occurs where column `side` is `before` and where it is `after`.

    One aggregation over both runs, rather than a full join of two.
    """
    n = lambda k: F.count_if(F.col(side) == k)
    rows = events.where(F.col("no_event_reason").isNull() & F.col(side).isin(before, after))
    return rows.groupBy("template_str").agg(n(before).alias("n_before"), n(after).alias("n_after"))


def singletons(events: DataFrame, *by: str) -> DataFrame:
    """template_counts() of the tail: the templates that one line alone has."""
    return template_counts(events, *by).where("n = 1")


def cardinality(events: DataFrame, *by: str) -> DataFrame:
    """(by..., lines, templates, singletons): how many templates there are, and how many occur once."""
    counts = template_counts(events, *by)
    return counts.groupBy(*by).agg(F.sum("n").alias("lines"), F.count(F.lit(1)).alias("templates"), F.count_if(F.col("n") == 1).alias("singletons"))


@F.pandas_udf(T.LongType())
def log2_fixed_column(values: pd.Series) -> pd.Series:
    """log2_fixed() of whole numbers."""
    return values.map(lambda v: log2_fixed(int(v)))


def weighted_log2(weight: Column, value: Column) -> Column:
    """An aggregate: the exact sum of weight * log2(value) in fixed point, the same in any order."""
    return F.sum(weight.cast("decimal(19,0)") * log2_fixed_column(value).cast("decimal(19,0)"))


def entropy_bits(counts: DataFrame, *by: str, n: str = "n") -> DataFrame:
    """(by..., total, bits): the entropy of counts, from exact fixed-point sums: log2(total) - sum(n log2 n) / total."""
    sums = counts.groupBy(*by).agg(F.sum(n).alias("total"), weighted_log2(F.col(n), F.col(n)).alias("raw"))
    fixed = log2_fixed_column(F.col("total")).cast("decimal(38,0)") - F.round(F.col("raw") / F.col("total"), 0)
    return sums.select(*by, "total", (fixed.cast("double") / float(1 << FRACTION)).alias("bits"))


def level_positions(lines: DataFrame) -> DataFrame:
    """(position, n, share): where a line's first level word stands among its words, and the share at or before there."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, text in latin_lines(batch):
                at = next((k for k, (_, w) in enumerate(Line(text).cores) if lower(w) in LEVEL_WORDS), None)
                found += [] if at is None else [at]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["position"])

    counts = with_bytes(lines).mapInArrow(find, "position long").groupBy("position").agg(F.count(F.lit(1)).alias("n"))
    # One row to a position in a line: the windows see no more than the longest line has words.
    upto = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return counts.select("position", "n", (F.sum("n").over(upto) / F.sum("n").over(whole)).alias("share"))


def digests(projected: DataFrame) -> DataFrame:
    """(stream_id, member, digest, events): the first 16 bytes of a SHA-256 over each member of a stream's rows, in order.

    A cell ends with a line feed. A stream's rows stream through one task, sorted; it holds sixteen running hashes.
    """
    schema = pa.schema([("stream_id", pa.string()), ("member", pa.string()), ("digest", pa.string()), ("events", pa.int64())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, hashes, n = None, [], 0

        def done() -> pa.RecordBatch:
            rows = [{"stream_id": current, "member": m, "digest": h.hexdigest()[:32], "events": n} for m, h in zip(CELLS, hashes)]
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for batch in batches:
            for stream, _, *cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stream != current or not hashes:
                    if hashes:
                        yield done()
                    current, hashes, n = stream, [hashlib.sha256() for _ in CELLS], 0
                n += 1
                for h, cell in zip(hashes, cells):
                    h.update(cell.encode() + b"\n")
        if hashes:
            yield done()

    rows = projected.select("stream_id", "line_no", *CELLS)
    return rows.repartition("stream_id").sortWithinPartitions("stream_id", "line_no").mapInArrow(digest, "stream_id string, member string, digest string, events long")


# --- outcomes of runs


def console_verdicts(lines: DataFrame, rules: Rules, declarations: Mapping[str, Declaration] | Declaration | DataFrame = Declaration()) -> DataFrame:
    """(stream_id, line_no, outcome, token) of each line that says an outcome; outcome is null where the token is to be read.

    A line is read in the parts between its carriage returns, by a reader of its own that keeps its format over the stream.
    `declarations` are as for canonicalize().
    """
    reader_of = readers(rules, declarations)
    schema = pa.schema([("stream_id", pa.string()), ("line_no", pa.int64()), ("outcome", pa.string()), ("token", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, reader, state = object(), None, State()
        for batch in batches:
            rows = []
            for (stream, number, raw), said in zip(latin_lines(batch), declared(batch), strict=True):
                if reader is None or stream != current:
                    current, reader, state = stream, reader_of(stream, said), State()
                best = None
                for part in raw.split("\r"):
                    parsed = reader.parse(part, state)[0] if part else None
                    found = console_verdict(parsed.content, reader.rules) if parsed else None
                    if found and (best is None or found[0] > best[0]):
                        best = found
                if best:
                    rows.append({"stream_id": stream, "line_no": number, "outcome": best[1] or None, "token": utf8(best[2])})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    lines = with_bytes(lines)
    lines = with_declarations(lines, declarations) if isinstance(declarations, DataFrame) else lines
    dealt = lines.repartition("stream_id").sortWithinPartitions("stream_id", "line_no")
    return dealt.mapInArrow(scan, "stream_id string, line_no long, outcome string, token string")


def run_outcomes(
    lines: DataFrame,
    rules: Rules,
    declarations: Mapping[str, Declaration] | Declaration | DataFrame = Declaration(),
    side_inputs: Mapping[str, tuple[str, str]] | DataFrame | None = None,
) -> DataFrame:
    """(stream_id, outcome, console, authoritative, divergent, note) of each stream.

    The last line that says an outcome is the console's. A side input, (vocabulary, token) by stream, outranks it; a token
    that its vocabulary doesn't have counts for nothing and is noted. `declarations` are as for canonicalize(). Side inputs
    for any number of streams come as a table (stream_id, vocabulary, token), joined by stream; of several rows for one
    stream the least counts, and a null vocabulary or token makes none.
    """
    said = console_verdicts(lines, rules, declarations)
    last = said.groupBy("stream_id").agg(F.max_by(F.struct("outcome", "token"), "line_no").alias("said"))
    streams = with_bytes(lines).select("stream_id").distinct().join(last, "stream_id", "left")
    rows = streams.select("stream_id", F.col("said").isNotNull().alias("marked"), "said.outcome", "said.token")
    inputs: dict[str, tuple[str, str]] = {}
    if isinstance(side_inputs, DataFrame):
        side = side_inputs.where("stream_id IS NOT NULL AND vocabulary IS NOT NULL AND token IS NOT NULL")
        side = side.groupBy(F.col("stream_id").cast("string").alias("stream_id")).agg(F.min(F.struct("vocabulary", "token")).alias("side"))
        rows = rows.join(side, "stream_id", "left")
    else:
        rows, inputs = rows.withColumn("side", F.lit(None).cast("struct<vocabulary: string, token: string>")), dict(side_inputs or {})
    rows = with_declarations(rows, declarations) if isinstance(declarations, DataFrame) else rows
    by_name = Declaration() if isinstance(declarations, DataFrame) else declarations

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("stream_id", pa.string()), ("outcome", pa.string()), ("console", pa.string()), ("authoritative", pa.bool_()), ("divergent", pa.bool_()), ("note", pa.string())]
        )
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("stream_id", "marked", "outcome", "token", "side"))
            for stream, marked, outcome, token, side, said in zip(*columns, declared(batch), strict=True):
                own = by_name.get(stream, Declaration()) if isinstance(by_name, Mapping) else by_name
                own = own if said is None else declaration_of(said)
                view = rules.for_stream(own.dialect, own.channel)
                given = inputs.get(stream) if side is None else (side["vocabulary"], side["token"])
                out.append({"stream_id": stream, **resolve_outcome(marked, outcome, token, given, view, rules)})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.mapInArrow(resolve, "stream_id string, outcome string, console string, authoritative boolean, divergent boolean, note string")


def resolve_outcome(marked: bool, outcome: str | None, token: str | None, side: tuple[str, str] | None, view: Rules, vocabularies: Rules) -> dict:
    """Side input before console tail before unknown."""
    console = (outcome or outcome_of_token(token or "", view)) if marked else None
    note = f"console verdict {token!r} is not in the stream's vocabulary" if marked and console is None else ""
    out = {"outcome": console or "UNKNOWN", "console": console or "UNKNOWN", "authoritative": False, "divergent": False, "note": note}
    if side and side[1]:
        mapped = outcome_of_token_in(side[1], side[0], vocabularies)
        if mapped:
            return out | {"outcome": mapped, "authoritative": True, "divergent": console is not None and console != mapped}
        out["note"] = f"side input {side[1]!r} is not in the {side[0]!r} vocabulary"
    return out


# --- units

_UNIT_DDL = "stream_id string, line_no long, kind string, name string, discriminant string, unit_class string, child_order string, version string, display string, revision string"
_END_DDL = "stream_id string, line_no long, kind string, outcome string, propagated string"


def _walk(events: DataFrame, ddl: str, row) -> DataFrame:
    schema = pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.string()) for x in ddl.split(", ")])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for stream, number, content in latin_lines(batch):
                own = row(content)
                if own:
                    found.append({"stream_id": stream, "line_no": number} | {k: utf8(v) for k, v in own.items()})
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    picked = events.where("no_event_reason IS NULL").select("stream_id", "line_no", F.col("content").cast("binary").alias("raw"))
    return picked.mapInArrow(walk, ddl)


def units(events: DataFrame, rules: Rules = NO_RULES) -> DataFrame:
    """The units that events name under a view of the rules; events that name none are left out."""

    def row(content: str) -> dict | None:
        u = unit_of(content, rules)
        if u.kind == "None":
            return None
        cls = unit_class(u.name, u.version)
        return {"kind": u.kind, "name": u.name, "discriminant": u.discriminant, "unit_class": cls, "child_order": u.order, "version": u.version, "display": u.display, "revision": u.since}

    return _walk(events, _UNIT_DDL, row)


def unit_ends(events: DataFrame, rules: Rules = NO_RULES) -> DataFrame:
    def row(content: str) -> dict | None:
        e = end_of(content, rules)
        return None if e.kind == "None" else {"kind": e.kind, "outcome": e.outcome, "propagated": e.propagated}

    return _walk(events, _END_DDL, row)


@F.pandas_udf(T.StringType())
def discriminant_column(names: pd.Series) -> pd.Series:
    """discriminant() of names given as UTF-8 text."""
    return names.map(lambda x: None if x is None else utf8(discriminant(x.encode().decode("latin-1"))))


def arm_digests(lines: DataFrame, arms: Mapping[str, tuple[Rules, Declaration]]) -> DataFrame:
    """(arm, stream_id, member, digest, events): digests() of the same lines read in the exact mode under several declarations."""
    out = None
    for name, (rules, declaration) in arms.items():
        projected = projection(canonicalize(lines, rules, declaration, mode="stream"))
        rows = digests(projected).select(F.lit(name).alias("arm"), "stream_id", "member", "digest", "events")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no arms")
    return out
