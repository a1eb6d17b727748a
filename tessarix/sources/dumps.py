"""Dumps read as data: INSERT lines to rows. Nothing of a dump is ever executed."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

# The statement's head.
INSERT = re.compile(r"^\s*INSERT\s+(?:IGNORE\s+)?INTO\s+(?:(?:`[^`]+`|[A-Za-z_]\w*)\s*\.\s*)?(?:`([^`]+)`|([A-Za-z_]\w*))\s+VALUES\s*", re.I)
# Escapes of the dump format.
_ESCAPES = {"0": "\0", "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a"}
_VALUE = r"""(?:'((?:[^'\\]|\\.|'')*)'|"((?:[^"\\]|\\.|"")*)"|(NULL)\b|([-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?))"""
_LITERAL = re.compile(rf"\s*{_VALUE}\s*([,)])", re.S | re.I)
_NULLS = re.compile(r"(?:\s*NULL\s*,)*", re.I)
_REST = re.compile(r"\s*([,;])\s*")
#: What stands for one character in a text in either kind of quotes.
_PAIR = {q: re.compile(rf"\\(.)|{q}{q}", re.S) for q in "'\""}
LONGEST_LINE = 32 << 20


def _unescaped(text: str, quote: str) -> str:
    if "\\" not in text and quote not in text:
        return text
    return _PAIR[quote].sub(lambda e: e[0][0] if e[1] is None else _ESCAPES.get(e[1], e[1]), text)


def parse_insert(line: str) -> tuple[str | None, list[list[str | None]], str]:
    """(table, rows, error) of one line; a value that is no literal, number or NULL makes it an error, with no rows."""
    head = INSERT.match(line)
    if not head:
        return None, [], "" if not re.match(r"\s*INSERT\b", line, re.I) else "unsupported statement"
    table = head[1] or head[2]
    if len(line) > LONGEST_LINE:
        return table, [], "line too long"
    rows: list[list[str | None]] = []
    at = head.end()
    while True:
        if at >= len(line) or line[at] != "(":
            return table, [], "a tuple is expected"
        at += 1
        row: list[str | None] = []
        while True:
            m = _LITERAL.match(line, at)
            if m is None:
                return table, [], "unsupported value"
            single, double, null, number, end = m.groups()
            at = m.end()
            if single is not None:
                row.append(_unescaped(single, "'"))
            elif double is not None:
                row.append(_unescaped(double, '"'))
            elif null is None:
                row.append(number)
            else:
                row.append(None)
                if end == ",":  # most are followed by more of their kind
                    more = _NULLS.match(line, at).end()
                    row += [None] * line.count(",", at, more)
                    at = more
            if end == ")":
                break
        rows.append(row)
        rest = _REST.match(line, at)
        if not rest:
            return table, [], "a line must end its statement"
        at = rest.end()
        if rest[1] == ";":
            return (table, rows, "") if at == len(line) else (table, [], "text behind the statement")


def insert_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """table, row (array<string>), error, begins: a row for each tuple, and one with a null row for each line that can't be read; begins marks the first of a line."""

    def run(batches):
        for batch in batches:
            tables, rows, errors, begins = [], [], [], []
            for line in batch.column(column).to_pylist():
                table, found, error = parse_insert(line or "")
                if error:
                    found = [None]
                tables += [table] * len(found)
                rows += found
                errors += [error] * len(found)
                begins += [True, *[False] * (len(found) - 1)][: len(found)]
            yield pa.RecordBatch.from_arrays([pa.array(tables, pa.string()), pa.array(rows, pa.list_(pa.string())), pa.array(errors, pa.string()), pa.array(begins, pa.bool_())], names=["table", "row", "error", "begins"])

    return lines.select(column).mapInArrow(run, "table string, row array<string>, error string, begins boolean")
