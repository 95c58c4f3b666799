"""Lines before any format reads them: endings, terminal escapes, transport stamps. On Latin-1 text, as Columns too."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import times

#: A terminal escape: CSI with parameters, OSC up to its end, any other two bytes, or a lone ESC at the end.
ESCAPE = r"(?s)\x1b(?:\[[0-?]*[ -/]*[@-~]?|\].*?(?:\x07|\x1b\\|\z)|[^\[\]]|\z)"
_ESCAPE = re.compile(ESCAPE.replace(r"\z", r"\Z"))
ZONED = r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+|(?!\.))(?:Z|[+-]\d\d:?\d\d|(?![Z+-]))"


def without_ending(line: str) -> str:
    return line.rstrip("\r")


def without_escapes(line: str) -> str:
    return _ESCAPE.sub("", line) if "\x1b" in line else line


def normalize(line: str) -> str:
    """A line without its ending (carriage returns behind it) and terminal escapes."""
    return without_escapes(without_ending(line))


def latin_column(raw: Column) -> Column:
    """Bytes as text of one character a byte."""
    return F.decode(raw, "ISO-8859-1")


def utf8_column(latin: Column) -> Column:
    """Latin-1 text back as UTF-8 text; each ill-formed part becomes U+FFFD."""
    return F.make_valid_utf8(F.encode(latin, "ISO-8859-1").cast("string"))


def normalize_column(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, r"\r+\z", ""), ESCAPE, "")


class Transform(NamedTuple):
    """A transport's prefix: `stamp` of `width` bytes, `bracketed` stamp, or byte order `mark`; blanks behind it go or stay."""

    name: str
    kind: str
    width: int = 0
    strips: bool = True


# The transports that can be declared.
TRANSFORMS = {
    t.name: t
    for t in (
        Transform("api-rfc3339-line-prefix", "stamp", 28),
        Transform("bracket-rfc3339-line-prefix", "bracketed"),
        Transform("utf8-bom-line-prefix", "mark", strips=False),
    )
}
BOM = "\xef\xbb\xbf"


def transport_stack(names: list[str] | tuple[str, ...]) -> list[Transform]:
    """The transforms of those names, outermost first. An unknown name is an error; no names peel nothing."""
    for name in names:
        if name not in TRANSFORMS:
            raise ValueError(f"unknown transport {name!r}; declared are {', '.join(TRANSFORMS)}")
    return [TRANSFORMS[n] for n in names]


def peel(line: str, stack: list[Transform]) -> tuple[str, int | None]:
    """(content, observation time) of a line under declared transports; a line without a prefix stays as it is."""
    seen = None
    for t in stack:
        if t.kind == "mark":
            line = line.removeprefix(BOM)
            continue
        start = int(t.kind == "bracketed")
        n = times.rfc3339_length(line, start) if not start or line[:1] == "[" else 0
        if not n or t.kind == "stamp" and n != t.width or start and line[start + n : start + n + 1] != "]":
            continue
        seen = times.iso8601(line[start : start + n])
        line = line[n + 2 * start :]
        if t.strips:
            line = line.lstrip(" \t")
    return line, seen


def peel_column(line: Column, stack: list[Transform]) -> tuple[Column, Column]:
    """(content, observed text): the same on Columns; the second is the last stamp peeled, or null."""
    seen = F.lit(None).cast("string")
    for t in stack:
        if t.kind == "mark":
            line = F.regexp_replace(line, f"^{BOM}", "")
            continue
        lead, tail = (r"^\[", r"\]") if t.kind == "bracketed" else ("^", "")
        pattern = f"{lead}({ZONED}){tail}[ \\t]*"
        stamp = F.regexp_extract(line, pattern, 1)
        hit = (stamp != "") if t.kind == "bracketed" else (F.length(stamp) == t.width)
        seen = F.when(hit, stamp).otherwise(seen)
        line = F.when(hit, F.regexp_replace(line, pattern, "")).otherwise(line)
    return line, seen


def render_transport(name: str, ts_ns: int) -> str:
    """The prefix that a writer puts before a line: only the bracketed transport has one, for years 0 to 9999."""
    if transport_stack([name])[0].kind != "bracketed":
        return ""
    ms = ts_ns // 1_000_000
    days, rest = divmod(ms, 86_400_000)
    year, month, day = _civil(days)
    if not 0 <= year <= 9999:
        return ""
    s, ms = divmod(rest, 1000)
    return f"[{year:04d}-{month:02d}-{day:02d}T{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}.{ms:03d}Z] "


def _civil(days: int) -> tuple[int, int, int]:
    """Year, month and day of a count of days since 1970, in 400-year cycles around datetime's range."""
    from datetime import date, timedelta

    cycles, rest = divmod(days, 146_097)
    d = date(1970, 1, 1) + timedelta(rest)
    return d.year + 400 * cycles, d.month, d.day


def render_transport_column(name: str, ts_ns: Column) -> Column:
    if transport_stack([name])[0].kind != "bracketed":
        return F.lit("")
    at = F.timestamp_millis(F.floor(ts_ns / 1_000_000).cast("long"))
    return F.concat(F.lit("["), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z] "))


def well_formed_prefix(raw: bytes) -> int:
    """The length of the longest head of `raw` that is UTF-8."""
    try:
        raw.decode()
    except UnicodeDecodeError as e:
        return e.start
    return len(raw)


def replace_ill_formed(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")
