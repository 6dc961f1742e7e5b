"""Shell patterns as regular expressions the JVM can run."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Names are searched in lists joined by NUL, the one character no path can hold.
NAME_SEPARATOR = "\x00"
_ANY = r"[^\x00]"
# A class has at least one member, and a bracket that comes first is one; else `[` is a plain character.
_TOKEN = re.compile(r"(?s)(\*+)|(\?)|\[(!?+)(\][^\]]*|[^\]]+)\]|(.)")
_MEMBER = re.compile(r"(?s)(.)-(.)|(.)")


def _literal(char: str) -> str:
    return char if char.isalnum() or ord(char) > 127 else "\\" + char


def _char_class(negated: bool, body: str) -> str:
    members = []
    for low, high, single in _MEMBER.findall(body):
        if single:
            members.append(_literal(single))
        elif low <= high:
            members.append(f"{_literal(low)}-{_literal(high)}")
    if negated:
        return "[^" + r"\x00" + "".join(members) + "]"
    return "[" + "".join(members) + "]" if members else "(?!)"


def to_regex(pattern: str) -> str:
    """Regex for one whole name; `*` also crosses `/`."""
    out = []
    for stars, question, bang, body, char in _TOKEN.findall(pattern):
        if stars:
            out.append(_ANY + "*")
        elif question:
            out.append(_ANY)
        elif body:
            out.append(_char_class(bool(bang), body))
        else:
            out.append(_literal(char))
    return "".join(out)


@F.pandas_udf(StringType())
def glob_regex(pattern: pd.Series) -> pd.Series:
    return pattern.map(to_regex, na_action="ignore")


def anchored(fragment):
    """A fragment that must cover one whole entry of a NUL-joined list."""
    return F.concat(F.lit(r"(?<![^\x00])(?:"), fragment, F.lit(r")(?![^\x00])"))
