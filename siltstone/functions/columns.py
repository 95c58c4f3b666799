"""Rules as built-in expressions, for plans that stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.rules import Rules, shape_regex
from .levels import LEVEL_WORDS, UNKNOWN


def _chain(cases: list[tuple[Column, str | None]], otherwise: str | None) -> Column:
    return reduce(lambda rest, case: F.when(case[0], F.lit(case[1])).otherwise(rest), reversed(cases), F.lit(otherwise).cast("string"))


def role_column(content: Column, rules: Rules) -> Column:
    """The structural role: shapes before prefixes, longer before shorter."""
    rows = sorted(rules.roles, key=lambda r: (not r.shape, -len(r.prefix)))
    return _chain([(content.rlike(shape_regex(r.prefix)) if r.shape else content.startswith(r.prefix), r.role) for r in rows], "None")


def lift_column(content: Column, rules: Rules) -> Column:
    """The level of the first lift that opens the content, or null."""
    return _chain([(content.startswith(r.prefix), r.level) for r in rules.lifts], None)


def stop_column(content: Column, rules: Rules) -> Column:
    return reduce(lambda a, b: a | b, [content.rlike(shape_regex(r.shape)) for r in rules.stops], F.lit(False))


def opener_column(content: Column, rules: Rules) -> Column:
    rows = sorted((r for r in rules.markers if r.role == "Opens"), key=lambda r: -len(r.prefix))
    return _chain([(content.startswith(r.prefix), r.kind) for r in rows], "None")


def closer_column(content: Column, rules: Rules) -> Column:
    return reduce(lambda a, b: a | b, [content.startswith(r.prefix) for r in rules.markers if r.role == "Closes"], F.lit(False))


def outcome_column(token: Column, rules: Rules) -> Column:
    """The outcome of a verdict token, or null."""
    return _chain([(token == r.token, r.outcome) for r in rules.outcome_tokens], None)


def level_word_column(word: Column) -> Column:
    said = {level: [w for w, own in LEVEL_WORDS.items() if own == level] for level in dict.fromkeys(LEVEL_WORDS.values())}
    return _chain([(F.lower(word).isin(words), level) for level, words in said.items()], UNKNOWN)


def severity_number_column(n: Column) -> Column:
    band = F.greatest(F.lit(0), F.least(F.lit(5), F.floor((n - 1) / 4)))
    return F.element_at(F.array(*map(F.lit, ("Trace", "Debug", "Info", "Warn", "Error", "Fatal"))), (band + 1).cast("int"))


def status_column(n: Column) -> Column:
    return F.when(n >= 500, "Error").when(n >= 400, "Warn").when(n >= 200, "Info").otherwise(UNKNOWN)


def priority_column(n: Column) -> Column:
    return F.when(n.between(0, 2), "Fatal").when(n == 3, "Error").when(n == 4, "Warn").when(n.isin(5, 6), "Info").when(n == 7, "Debug").otherwise(UNKNOWN)


def regressed_column(before: Column, after: Column) -> Column:
    rank = lambda c: F.when(c == "SUCCESS", 0).when(c == "UNSTABLE", 1).when(c == "FAILURE", 2)
    return F.coalesce(rank(after) > rank(before), F.lit(False))


def simple_template(content: Column) -> Column:
    """Templates of lines whose tokens are words, signed numbers (with units) and `key=number`: what the kernel gives for those, in the JVM.

    For lines with addresses, paths, wrappers, hashes or JSON use the kernel.
    """
    token = F.regexp_replace(content, "(?<![^ ])[+~-]?[0-9][^ ]*", "<*>")
    return F.regexp_replace(token, r"(?<![^ ])([A-Za-z_][0-9A-Za-z_.-]*=)[+~-]?[0-9][0-9A-Za-z._+%~-]*(?![^ ])", "$1<*>")
