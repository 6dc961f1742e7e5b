"""Lexer state over the lines of a document: exact code, strings and comments of any nesting.

The lines of a document follow each other in one partition, so a single pass carries the
state from line to line: a stack of open strings, comments and template expressions. Only the
stack and two running depths are held, however long a document is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions import text as tx
from lodestone.plans.sizing import partitions_of

#: What a line needs to open a string, comment or bracket, or to close a bracket.
_MARKS = r"""["'`/#{}()\[\]]"""
_ESCAPED = r"\\[\s\S]?|"
#: Opens an expression inside a template; the stack holds it with the number of braces open in it.
_HOLE = "${"


@dataclass(frozen=True)
class Rules:
    """What opens a string or comment of a language, and what each of them looks for until it ends."""

    line_comment: str
    opens: tuple[str, ...]
    #: Kinds that go on over the end of a line; others do so only after a backslash.
    lasting: frozenset[str]
    regex_literals: bool = False
    nested_comments: bool = False
    raw_hashes: bool = False
    inside: dict[str, re.Pattern] = field(default_factory=dict)
    start: re.Pattern = re.compile("")


def _rules(line_comment: str, opens: tuple[str, ...], lasting: tuple[str, ...], unescaped: tuple[str, ...] = (), **more) -> Rules:
    inside = {}
    for kind in opens:
        if kind == "/*":
            inside[kind] = re.compile(r"\*/|/\*" if more.get("nested_comments") else r"\*/")
        elif kind in unescaped:
            inside[kind] = re.compile(re.escape(kind))
        else:
            hole = r"|\$\{" if kind == "`" else ""
            inside[kind] = re.compile(_ESCAPED + re.escape(kind) + hole)
    parts = [re.escape(line_comment), *map(re.escape, sorted(opens, key=len, reverse=True)), "[{}]"]
    if more.get("raw_hashes"):
        # raw strings and characters; any other quote belongs to a lifetime
        parts = [r"\bb?r#*\"", r"'(?:\\[^\n']+|\\'|[^\\'\n])'", *parts]
    if more.get("regex_literals"):
        parts.append("/")
    return Rules(line_comment, opens, frozenset(lasting), inside=inside, start=re.compile("|".join(parts)), **more)


_SCRIPT = _rules("//", ("/*", "'", '"', "`"), ("/*", "`"), regex_literals=True)
RULES = {
    "python": _rules("#", ('"""', "'''", '"', "'"), ('"""', "'''")),
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "java": _rules("//", ("/*", '"""', '"', "'"), ("/*", '"""')),
    "go": _rules("//", ("/*", '"', "'", "`"), ("/*", "`"), unescaped=("`",)),
    "rust": _rules("//", ("/*", '"'), ("/*", '"'), nested_comments=True, raw_hashes=True),
}

_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
#: What a regular expression may follow; after anything else a slash divides.
_BEFORE_REGEX = re.compile(r"(?:^|[(,=:\[!&|?{};+\-*%^~<>]|\b(?:return|typeof|case|in|of|delete|void|throw|new|else|do))\s*$")


def scan_line(line: str, stack: list[str], rules: Rules) -> str:
    """The code of a line without strings and comments. `stack` is left as the line leaves it."""
    out: list[str] = []
    at = 0
    while at <= len(line):
        top = stack[-1] if stack else ""
        if top and not top.startswith(_HOLE):
            at = _leave(line, at, stack, rules, top)
            continue
        found = rules.start.search(line, at)
        if not found:
            out.append(line[at:])
            break
        out.append(line[at:found.start()])
        token, at = found.group(), found.end()
        if token == rules.line_comment:
            break
        if token in "{}":
            if not top:
                out.append(token)
            elif token == "}" and top == _HOLE + "0":
                stack.pop()
            else:
                stack[-1] = _HOLE + str(int(top[2:]) + (1 if token == "{" else -1))
                out.append(token)
        elif token == "/":
            literal = _REGEX.match(line, at - 1) if _BEFORE_REGEX.search("".join(out)) else None
            if literal:
                at = literal.end()
            else:
                out.append(token)
        elif token in rules.opens and token not in rules.lasting and not _ends(line, at, rules.inside[token]):
            # a quote without a partner, as in plain text between tags
            out.append(token)
        elif token in rules.opens or not token.startswith("'"):
            stack.append(token)
    return "".join(out)


def _ends(line: str, at: int, inside: re.Pattern) -> bool:
    """Whether a string of one line ends in it, or goes on after a backslash at its end."""
    return any(len(m.group()) == 1 for m in inside.finditer(line, at))


def _leave(line: str, at: int, stack: list[str], rules: Rules, top: str) -> int:
    """Goes on inside a string or comment; past the end of the line if it does not end here."""
    if top.lstrip("b").startswith("r"):
        closer = '"' + "#" * top.count("#")
        end = line.find(closer, at)
        if end < 0:
            return len(line) + 1
        stack.pop()
        return end + len(closer)
    found = rules.inside[top].search(line, at)
    if not found:
        if top not in rules.lasting:
            stack.pop()
        return len(line) + 1
    token = found.group()
    if token == _HOLE:
        stack.append(_HOLE + "0")
    elif token == "/*":
        stack.append(token)
    elif not token.startswith("\\"):
        stack.pop()
    elif len(token) == 1:
        # a backslash at the end: the string goes on in the next line
        return len(line) + 1
    return found.end()


class State:
    """Where the lines read so far leave a document."""

    def __init__(self) -> None:
        self.stack: list[str] = []
        self.depth = self.brackets = 0

    def scan(self, languages: pa.Array, numbers: pa.Array, lines: pa.Array) -> list[pa.Array]:
        """(code, inside, depth, bracket_depth) of lines that follow each other.

        Outside strings and comments a line without a mark is code as a whole and leaves the state as it is, so
        only the first lines of documents, lines with marks and those within strings and comments are looked at.
        """
        heads = pc.equal(numbers, 0)
        stops = np.flatnonzero(pc.or_(heads, pc.match_substring_regex(lines, _MARKS)).to_numpy(zero_copy_only=False)).tolist()
        heads = set(np.flatnonzero(heads.to_numpy(zero_copy_only=False)).tolist())
        seen: list[int] = []
        codes: list[str] = []
        # from which line on: inside, depth, bracket depth
        since, states = [0], [(self._inside(), self.depth, self.brackets)]
        at, n = 0, len(lines)
        stops.append(n)
        for stop in stops:
            # a string or comment goes on over lines of any kind
            while at < stop and self.stack:
                at = self._line(at, languages, lines, seen, codes, since, states)
            at = max(at, stop)
            if at < n:
                if at in heads:
                    self.stack, self.depth, self.brackets = [], 0, 0
                    since.append(at)
                    states.append((False, 0, 0))
                at = self._line(at, languages, lines, seen, codes, since, states)
        held = np.diff(np.append(since, n))
        inside, depth, brackets = (np.repeat([x[i] for x in states], held) for i in range(3))
        mask = np.zeros(n, bool)
        mask[seen] = True
        code = pc.replace_with_mask(lines, pa.array(mask), pa.array(codes, lines.type))
        return [code, pa.array(inside, pa.bool_()), pa.array(depth, pa.int32()), pa.array(brackets, pa.int32())]

    def _inside(self) -> bool:
        return bool(self.stack) and not self.stack[-1].startswith(_HOLE)

    def _line(self, at: int, languages: pa.Array, lines: pa.Array, seen: list, codes: list, since: list, states: list) -> int:
        rules, line = RULES.get(languages[at].as_py()), lines[at].as_py()
        code = line if rules is None else scan_line(line, self.stack, rules)
        seen.append(at)
        codes.append(code)
        braces = code.count("{") - code.count("}")
        self.depth += braces
        self.brackets += braces + code.count("(") - code.count(")") + code.count("[") - code.count("]")
        since.append(at + 1)
        states.append((self._inside(), self.depth, self.brackets))
        return at + 1


def numbered_lines(sources: DataFrame, partitions: int | None = None) -> DataFrame:
    """(doc_id, language, line_no, line) of the texts; lines are numbered from 0."""
    n = partitions or partitions_of(sources, "text")
    placed = sources.select("doc_id", "language", "text").repartition(n, "doc_id")
    return placed.select("doc_id", "language", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def lexed_lines(sources: DataFrame) -> DataFrame:
    """One row per line of (doc_id, language, text): `line`, `code` (without strings and comments),
    whether the line starts `inside` a string or comment, its `indent`, and the depth of braces and
    of all brackets before it. Lines are numbered from 0; languages without rules keep their lines as code.

    Expressions inside templates are code; the marks around them are not. The lines of a document
    are in one of as many partitions as their text needs, which the windows over them keep.
    """
    n = partitions_of(sources, "text")
    lines = numbered_lines(sources, n)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = State()
        for batch in batches:
            found = state.scan(*(batch.column(c) for c in ("language", "line_no", "line")))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *found], names=[*batch.schema.names, "code", "inside", "depth", "bracket_depth"]
            )

    schema = "doc_id string, language string, line_no int, line string, code string, inside boolean, depth int, bracket_depth int"
    return lines.mapInArrow(scan, schema).select(
        "doc_id", "language", "line_no", "line", "code", "inside", _indent().alias("indent"), "depth", "bracket_depth"
    ).repartition(n, "doc_id")


def _indent() -> Column:
    return F.length("line") - F.length(tx.lstrip(F.col("line")))
