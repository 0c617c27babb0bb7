"""Text columns: clipping, names, log lines, levels in rationale texts, and JSON embedded in text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def clip(text: Column, most: int) -> Column:
    """The text with white space collapsed, cut to `most` characters with an ellipsis; null for null."""
    t = F.btrim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most)), F.lit("…"))).otherwise(t)


def safe_name(text: Column) -> Column:
    """With everything but ASCII letters, digits, _ and - replaced by _."""
    return F.regexp_replace(text, r"[^A-Za-z0-9_-]", "_")


def sha_hex(text: Column) -> Column:
    return F.sha2(text, 256)


NUMBER = r"([0-9]+(?:\.[0-9]+)?)"


def level(text: Column, name: str) -> Column:
    """The number after a level's name in a rationale ("entry 129.99"), null without one."""
    return F.nullif(F.regexp_extract(text, rf"(?i)\b{name}\s+{NUMBER}", 1), F.lit("")).cast("double")


def field(line: Column, name: str) -> Column:
    """The value of name=value in a log line, null without one."""
    return F.nullif(F.regexp_extract(line, rf"\b{name}=(\S+)", 1), F.lit(""))


_STEP = re.compile(r'["{}\[\]]')
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)


def balanced_json(text: str | None) -> str | None:
    """The first JSON object or array that lies balanced in the text and can be read, or null: prose and code fences around
    it are left out. The text is gone through once, minding strings: each bracket that closes is matched with the one that it
    closes, and the outermost spans are tried in turn, then those within the ones that cannot be read."""
    if text is None:
        return None
    spans, open_, at = [], [], 0
    while m := _STEP.search(text, at):
        i, c = m.start(), m[0]
        at = i + 1
        if c == '"':
            # a quote outside of any bracket is prose
            s = _STRING.match(text, i) if open_ else None
            at = s.end() if s else at
        elif c in "{[":
            open_.append((i, c))
        elif open_ and open_[-1][1] + c in ("{}", "[]"):
            begin = open_.pop()[0]
            while spans and spans[-1][0] > begin:  # within this one
                spans.pop()
            spans.append((begin, at))
        else:
            open_.clear()
    for begin, end in spans:
        try:
            json.loads(text[begin:end])
            return text[begin:end]
        except (ValueError, RecursionError):
            continue
    return None


@F.pandas_udf(StringType())
def first_json(text: pd.Series) -> pd.Series:
    """balanced_json of each text."""
    return text.map(balanced_json)


def card_scenarios(text: Column, most: int = 3) -> Column:
    """The scenarios that a card's text states, up to `most`, in order: an array of structs of direction, entry_type, entry_low,
    entry_high (equal unless a range is given), stop, t1, t2, runner and probability (a share). Each begins with a line like
    "TICKER long fade_pop: entry 10.1-10.3, stop 9.8, T1 10.9, T2 11.4, runner 12, probability 55%"; what is not stated is
    null. Null for null, empty without any scenario."""
    head = r"\b(long|short) ([a-z_]+): entry"
    # each scenario runs to where the next one begins
    parts = F.slice(F.split(F.regexp_replace(text, head, "\u0001$0"), "\u0001"), 2, most)

    def one(p: Column) -> Column:
        got = lambda pattern, i=1: F.nullif(F.regexp_extract(p, pattern, i), F.lit(""))
        span = rf"(?i)\bentry\s+{NUMBER}(?:\s*(?:-|–|to)\s*{NUMBER})?"
        share = got(rf"(?i)\bprob(?:ability)?\s+{NUMBER}\s*%").cast("double") / 100
        return F.struct(
            got(head, 1).alias("direction"), got(head, 2).alias("entry_type"), got(span).cast("double").alias("entry_low"), F.coalesce(got(span, 2), got(span, 1)).cast("double").alias("entry_high"),
            level(p, "stop").alias("stop"), level(p, "T1").alias("t1"), level(p, "T2").alias("t2"), level(p, "runner").alias("runner"), share.alias("probability"),
        )

    return F.when(text.isNotNull(), F.transform(parts, one))


def difference_pct(a: Column, b: Column) -> Column:
    """How far a and b lie apart in percent of their mean size; null where both are 0 or one is null."""
    return F.try_divide(F.abs(a - b) * 200, F.nullif(F.abs(a) + F.abs(b), F.lit(0.0)))


def first_of(document: Column, *names: str) -> Column:
    """The first non-null value among the spellings of a name in a JSON document (a string)."""
    return F.coalesce(*(F.get_json_object(document, f"$.{n}") for n in names))


def number_of(document: Column, *names: str) -> Column:
    """first_of as a double; null where it is no number."""
    return first_of(document, *names).try_cast("double")


def true_of(document: Column, *names: str) -> Column:
    """first_of as a boolean; null where it is none."""
    return first_of(document, *names).try_cast("boolean")


def eastern(text: Column, end_of_day: bool = False) -> Column:
    """An instant from text in New York time, "2026-03-06" or "2026-03-06 10:30"; a date alone is its begin, or its last second.
    Null where it cannot be read."""
    t = F.btrim(text)
    day = t.rlike(r"^\d{4}-\d{2}-\d{2}$")
    full = F.when(day, F.concat(t, F.lit(" 23:59:59" if end_of_day else " 00:00:00"))).otherwise(t)
    return F.to_utc_timestamp(full.try_cast("timestamp"), "America/New_York")
