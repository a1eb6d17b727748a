"""SQL fragments in Spark's words, and in those of the engine that checks results."""

from __future__ import annotations


class Spark:
    """Fragments of Spark SQL. ``tables`` maps a table to the text that names it."""

    name = "spark"

    def __init__(self, tables=None):
        self.tables = tables or {}

    def t(self, name):
        return self.tables.get(name, name)

    def once(self, head, query, name):
        """``query`` behind the common tables ``head``, which others read several times; a dialect with a session computes its rows once."""
        return query

    def lit(self, text):
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def flags(self, pattern):
        # Java's ^ in multi-line mode also follows \r; d keeps it to \n
        return pattern.replace("(?im)", "(?imd)")

    def rx(self, x, pattern, group=1):
        return f"regexp_extract({x}, {self.lit(self.flags(pattern))}, {group})"

    def has(self, x, pattern):
        return f"({x} rlike {self.lit(self.flags(pattern))})"

    def rxall(self, x, pattern, group=0):
        return f"regexp_extract_all({x}, {self.lit(self.flags(pattern))}, {group})"

    def rep(self, x, pattern, to=""):
        return f"regexp_replace({x}, {self.lit(self.flags(pattern))}, {self.lit(to)})"

    def sort(self, a):
        return f"array_sort({a})"

    def distinct(self, a):
        return f"array_distinct({a})"

    def join(self, a, by=" "):
        return f"array_join({a}, {self.lit(by)})"

    def array(self, *items):
        return f"array({', '.join(items)})"

    def concat(self, a, b):
        return f"concat({a}, {b})"

    def compact(self, *items):
        return f"array_compact(array({', '.join(items)}))"

    def filter(self, a, cond):
        return f"filter({a}, x -> {cond})"

    def map(self, a, to):
        return f"transform({a}, x -> {to})"

    def overlap(self, a, b):
        return f"arrays_overlap({a}, {b})"

    def without(self, a, b):
        return f"array_except({a}, {b})"

    def holds(self, a, x):
        return f"array_contains({a}, {x})"

    def size(self, a):
        return f"cast(size({a}) as bigint)"

    def steps(self, n):
        """1 to n, none if n is 0."""
        return f"case when {n} < 1 then array() else sequence(1, {n}) end"

    def first(self, a):
        return f"try_element_at({a}, 1)"

    def explode(self, a):
        return f"explode({a})"

    def list(self, x):
        return f"collect_list({x})"

    def set(self, x):
        return f"collect_set({x})"

    def csv(self, x, by=","):
        return f"array_join(array_sort(collect_set({x})), '{by}')"

    def sha(self, x):
        return f"sha2({x}, 256)"

    def day(self, ymd):
        return f"to_date(nullif({ymd}, ''), 'yyyyMMdd')"

    def days(self, a, b):
        return f"datediff({a}, {b})"

    def split(self, x, by):
        return f"split({x}, {self.lit(by)})"

    def date_ok(self, y, m, d):
        """YYYYMMDD of three integers, null where there is no such day."""
        return f"case when {m} between 1 and 12 and {d} between 1 and 31 and {y} between 1 and 9999 then case when {d} <= day(last_day(make_date({y}, {m}, 1))) then concat(lpad(cast({y} as string), 4, '0'), lpad(cast({m} as string), 2, '0'), lpad(cast({d} as string), 2, '0')) end end"

    def int(self, x):
        return f"try_cast({x} as int)"

    def hmac(self, key, message):
        """Keyed SHA-256 in hex; the key is at most 64 bytes."""
        inner, outer = pads(key)
        return f"sha2(concat(unhex('{outer}'), unhex(sha2(concat(unhex('{inner}'), encode({message}, 'UTF-8')), 256))), 256)"


def pads(key: bytes) -> tuple[str, str]:
    block = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block).hex(), bytes(b ^ 0x5C for b in block).hex()


class Duck(Spark):
    """The same fragments for the checking engine."""

    name = "duck"

    def lit(self, text):
        return "'" + text.replace("'", "''") + "'"

    def flags(self, pattern):
        return pattern

    def has(self, x, pattern):
        return f"regexp_matches({x}, {self.lit(pattern)})"

    def rep(self, x, pattern, to=""):
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(to)}, 'g')"

    def sort(self, a):
        return f"list_sort({a})"

    def distinct(self, a):
        return f"list_distinct({a})"

    def join(self, a, by=" "):
        return f"array_to_string({a}, {self.lit(by)})"

    def array(self, *items):
        return f"[{', '.join(items)}]"

    def concat(self, a, b):
        return f"list_concat({a}, {b})"

    def compact(self, *items):
        return f"list_filter([{', '.join(items)}], lambda x: x is not null)"

    def filter(self, a, cond):
        return f"list_filter({a}, lambda x: {cond})"

    def map(self, a, to):
        return f"list_transform({a}, lambda x: {to})"

    def overlap(self, a, b):
        return f"list_has_any({a}, {b})"

    def without(self, a, b):
        return f"list_filter({a}, lambda x: not list_contains({b}, x))"

    def holds(self, a, x):
        return f"list_contains({a}, {x})"

    def size(self, a):
        return f"cast(len({a}) as bigint)"

    def steps(self, n):
        return f"range(1, {n} + 1)"

    def first(self, a):
        return f"({a})[1]"

    def explode(self, a):
        return f"unnest({a})"

    def list(self, x):
        return f"list({x}) filter (where {x} is not null)"

    def set(self, x):
        return f"list(distinct {x}) filter (where {x} is not null)"

    def csv(self, x, by=","):
        return f"coalesce(array_to_string(list_sort(list(distinct {x}) filter (where {x} is not null)), '{by}'), '')"

    def sha(self, x):
        return f"sha256({x})"

    def day(self, ymd):
        return f"cast(try_strptime(nullif({ymd}, ''), '%Y%m%d') as date)"

    def days(self, a, b):
        return f"date_diff('day', {b}, {a})"

    def split(self, x, by):
        return f"string_split({x}, {self.lit(by)})"

    def date_ok(self, y, m, d):
        return f"strftime(try_cast(concat(lpad(cast({y} as string), 4, '0'), '-', lpad(cast({m} as string), 2, '0'), '-', lpad(cast({d} as string), 2, '0')) as date), '%Y%m%d')"

    def hmac(self, key, message):
        inner, outer = pads(key)
        return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"
