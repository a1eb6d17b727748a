"""Tables and columns that a dump declares, read by one pass over its tokens; nothing of it is executed.

Comments, texts, dollar bodies and COPY blocks are tokens of their own, so what looks like a statement inside them is none
and what looks like a comment inside a text is text; quoted names are one token, whatever they hold.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

# Columns that may link tables, words that begin a constraint, and limits.
LINK = re.compile(r"accession|study.*uid|patient.*id|\bmrn\b|report|file.*path|filename|document", re.I)
CONSTRAINTS = ("CONSTRAINT", "PRIMARY", "FOREIGN", "UNIQUE", "CHECK", "KEY", "INDEX")
MOST_CHARACTERS, MOST_TABLES, MOST_COLUMNS, LONGEST_TABLE, LONGEST_NAME = 32 << 20, 200, 1000, 1 << 20, 256
_TOKEN = re.compile(
    r"""(?P<gone>^[^\S\n]*COPY\b[^\n]*\bFROM[^\S\n]+stdin[^\S\n]*;.*?^\\\.[^\S\n]*$|--[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<text>'(?:[^'\\]|\\.|'')*(?:'|\Z)|\$(?P<tag>[A-Za-z_0-9]{0,128})\$.*?(?:\$(?P=tag)\$|\Z))
    |(?P<name>"(?:[^"]|"")*"|`(?:[^`]|``)*`|\[(?:[^\]]|\]\])*\]|[A-Za-z_][A-Za-z_0-9$]*)
    |(?P<mark>[(),;.])
    |(?P<other>\S)""",
    re.X | re.S | re.M | re.I,
)


class Table(NamedTuple):
    name: str
    columns: list[str]


def _bare(name: str) -> str:
    return name.strip().strip('"`[]')[:LONGEST_NAME]


def tables(text: str) -> tuple[list[Table], bool]:
    """The declared tables in order, and whether a limit or the text's end cut something off.

    CREATE TABLE counts as the first words of a line or of a statement. A table without its closing parenthesis isn't returned.
    """
    limited = len(text) > MOST_CHARACTERS
    text = text[:MOST_CHARACTERS]
    tokens = [m for m in _TOKEN.finditer(text) if m.lastgroup != "gone" and m["gone"] is None]
    out: list[Table] = []
    word = lambda k: tokens[k][0].upper() if k < len(tokens) and tokens[k]["name"] is not None else ""
    mark = lambda k, c: k < len(tokens) and tokens[k]["mark"] == c
    k = 0
    while k < len(tokens):
        begins = k == 0 or mark(k - 1, ";") or "\n" in text[tokens[k - 1].end() : tokens[k].start()]
        if not (begins and word(k) == "CREATE" and word(k + 1) == "TABLE"):
            k += 1
            continue
        at = k + 2 + 3 * (word(k + 2) == "IF" and word(k + 3) == "NOT" and word(k + 4) == "EXISTS")
        names = [at]
        if mark(at + 1, "."):
            names.append(at + 2)
        opened = names[-1] + 1
        if not (all(n < len(tokens) and tokens[n]["name"] is not None for n in names) and mark(opened, "(")):
            k += 1
            continue
        if len(out) >= MOST_TABLES:
            return out, True
        columns, depth, first, parts, k = [], 1, True, 1, opened + 1
        while k < len(tokens) and depth and tokens[k].start() - tokens[opened].end() < LONGEST_TABLE:
            c = tokens[k]["mark"]
            if first and parts <= MOST_COLUMNS and tokens[k]["name"] is not None and text[tokens[k].end() : tokens[k].end() + 1].isspace() and word(k).strip('"`[]') not in CONSTRAINTS:
                columns.append(_bare(tokens[k][0]))
            first = c == "," and depth == 1
            parts += first
            depth += (c == "(") - (c == ")")
            k += 1
        if depth:
            limited = True
        else:
            out.append(Table(_bare(text[tokens[names[0]].start() : tokens[names[-1]].end()]), columns))
    return out, limited


def ddl_columns(dumps: DataFrame, column: str = "value", key: str | None = None) -> DataFrame:
    """dump_table, column, is_link, limited of every declared column, with ``key`` of the dump in front; a null dump declares nothing."""
    kept = [key] if key else []

    def run(batches):
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column(column).to_pylist()):
                found, limited = tables(text or "")
                rows += [(i, t.name, c, bool(LINK.search(c)), limited) for t in found for c in t.columns]
            of, *values = zip(*rows) if rows else ((),) * 5
            made = [pa.array(v, kind) for v, kind in zip(values, (pa.string(), pa.string(), pa.bool_(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(of, pa.int64())) for c in kept] + made, names=[*kept, "dump_table", "column", "is_link", "limited"])

    front = f"`{key}` {dumps.schema[key].dataType.simpleString()}, " if key else ""
    return dumps.select(*kept, column).mapInArrow(run, f"{front}dump_table string, column string, is_link boolean, limited boolean")
