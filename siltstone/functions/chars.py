"""Bytes, wrappers and tokens that the readers share."""

from __future__ import annotations

import re

# Wrapper pairs, and the marks that may trail a wrapped value (two at most).
PAIRS = {"[": "]", "(": ")", "{": "}", "<": ">", '"': '"', "'": "'", "`": "`"}
OPEN, CLOSE, TRAIL = "".join(PAIRS), "".join(dict.fromkeys(PAIRS.values())), ",;:."
WILDCARD = "<*>"

OPEN_SET, TAIL_SET = f"[{re.escape(OPEN)}]", f"[{re.escape(CLOSE + TRAIL)}]"
#: What may stand between two words of prose, and the terminal escapes that count as such.
_DELIMITERS = r" \t\n\r\f\v\[\](){}<>\"'`,:;|="
_WORD = re.compile(rf"(?:\x1b(?:\[[^@-~]*[@-~]?)?|[{_DELIMITERS}])*([^{_DELIMITERS}\x1b]+)")
_CORE = re.compile(r"[0-9A-Za-z](?:.*[0-9A-Za-z])?", re.S)
_SHELL_TAIL = re.compile(r"[,;:.]{0,2}\Z")


def latin(raw: bytes) -> str:
    return raw.decode("latin-1")


def raw_bytes(text: str) -> bytes:
    return text.encode("latin-1")


def prose_words(text: str) -> list[tuple[int, int, int, int]]:
    """(begin, end, core begin, core end) of each word; the core lacks marks at both ends and may be empty."""
    out = []
    for m in _WORD.finditer(text):
        begin, end = m.span(1)
        word = m[1]
        if word.isalnum() and word.isascii():
            out.append((begin, end, begin, end))
            continue
        core = _CORE.search(word)
        out.append((begin, end, begin + core.start(), begin + core.end()) if core else (begin, end, end, end))
    return out


def shell_core(token: str) -> str | None:
    """What a complete wrapper holds: opener, core without either wrapper byte, closer, up to two trailing marks."""
    if len(token) < 3 or token[0] not in PAIRS:
        return None
    body = token[: _SHELL_TAIL.search(token).start()]
    if len(body) < 3 or body[-1] != PAIRS[token[0]]:
        return None
    core = body[1:-1]
    return None if token[0] in core or body[-1] in core else core
