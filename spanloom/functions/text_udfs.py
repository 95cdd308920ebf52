"""The few text jobs that built-in expressions cannot do, as Arrow UDFs.

Each one maps a text column to a text column, gets null for rows that do not need
it, and returns JSON text that built-in expressions take apart again.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.values import bound

# Where a Python dict starts in free text.
DICT_IN_TEXT = r"""\{['"][\w_]+['"]\s*:\s*.+\}"""
BRACES_JSON = r"(\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\})"
BRACES_DICT = r"""(\{['"][^{}]*(?:\{[^{}]*\}[^{}]*)*\})"""


def _guarded(read: Callable) -> Callable:
    """Text that is broken, or nested too deeply to be read, is ordinary text."""

    def run(x):
        try:
            return read(x)
        except (ValueError, SyntaxError, RecursionError, MemoryError, TypeError):
            return None

    return run


_dump = _guarded(lambda value: json.dumps(value, ensure_ascii=False, default=str))
_literal = _guarded(ast.literal_eval)
_json = _guarded(json.loads)


def dict_in_text(text: str) -> dict | None:
    """The Python dict written somewhere in a text, if it is a valid one."""
    found = re.search(DICT_IN_TEXT, text)
    value = _literal(found.group(0)) if found else None
    return value if isinstance(value, dict) else None


def unpack(value):
    """Open all JSON that is written inside strings, however deep.

    Lists inside lists stay as they are, and of a list that was text itself only the
    strings are opened.
    """
    top = [value]
    todo = [(top, 0)]
    while todo:
        box, place = todo.pop()
        was_text = isinstance(box[place], str)
        while isinstance(box[place], str) and box[place].lstrip()[:1] in ("{", "[", '"'):
            inner = _json(box[place].strip())
            if inner is None:
                break
            box[place] = inner
        here = box[place]
        if isinstance(here, dict):
            todo += [(here, k) for k in here]
        elif isinstance(here, list):
            kinds = str if was_text else (str, dict)
            todo += [(here, i) for i, x in enumerate(here) if isinstance(x, kinds)]
    return top[0]


@dataclass(slots=True)
class Met:
    """A value met on a walk: its path, whether a key names it, the text it was opened
    from (`json`, `repr` or none), if it lies in a list out of text, and what stands
    before it when everything is written in one line."""

    value: object
    path: str = ""
    keyed: bool = False
    opened: str = ""
    in_text_list: bool = False
    lead: str = ""


def _within(text: str) -> tuple[object, str]:
    """The JSON value, or else the Python literal, inside a text, and which it was."""
    text = text.strip()
    whole = text[:1] in ("{", "[")
    for kind, braces, read in (("json", BRACES_JSON, _json), ("repr", BRACES_DICT, _literal)):
        part = text if whole else (found.group(1) if (found := re.search(braces, text)) else None)
        value = None if part is None else read(part)
        if value is not None:
            return value, kind
    return None, ""


def walk(value) -> Iterator[Met]:
    """Everything in a nested value in its written order, text inside of text included.
    Each opened text is shorter than the text around it, so a walk ends."""
    todo = [Met(value)]
    while todo:
        met = todo.pop()
        yield met
        here, hidden = met.value, met.in_text_list
        if isinstance(here, str):
            inner, kind = _within(here)
            if kind:
                todo.append(Met(inner, f"{met.path}.{kind}", False, kind, hidden or not isinstance(inner, dict), " "))
        elif isinstance(here, dict):
            below = [Met(v, f"{met.path}.{k}" if met.path else str(k), True, "", hidden, f" {k}=") for k, v in here.items()]
            todo += _first_unspaced(below)
        elif isinstance(here, (list, tuple)):
            below = [Met(v, f"{met.path}[{i}]", False, "", hidden, " ") for i, v in enumerate(here)]
            todo += _first_unspaced(below)


def _first_unspaced(below: list[Met]) -> list[Met]:
    if below:
        below[0].lead = below[0].lead[1:]
    return below[::-1]


def searchable(value) -> str:
    """`key=value` text of a nested object, embedded objects appended."""
    return "".join(m.lead + ("" if isinstance(m.value, (dict, list, tuple)) else str(m.value)) for m in walk(value))


def flattened(value) -> dict[str, str | None]:
    """Path to scalar of all that a key names, embedded objects included."""
    named = [m for m in walk(value) if m.keyed and not m.in_text_list and not isinstance(m.value, (dict, list))]
    return {m.path: m.value if m.value is None or isinstance(m.value, str) else _dump(m.value) for m in named}


def nested_objects(value) -> list[str]:
    """JSON text of every object found inside strings, outermost first."""
    return [_dump(m.value) for m in walk(value) if m.opened and not m.in_text_list]


def _on_text(result: T.DataType, work: Callable) -> Callable[[Column], Column]:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else work(t) for t in texts], dtype=object)

    def apply(c: Column) -> Column:
        # Marked so that filters above are not rewritten in terms of the columns
        # below: that would run the UDF again and blow up the plan.
        return F.pandas_udf(run, result).asNondeterministic()(c)

    return apply


def _unpack_line(text: str) -> str | None:
    value = _json(text)
    return _dump(unpack(value)) if isinstance(value, dict) else None


def _dict_json(text: str) -> str | None:
    value = dict_in_text(text)
    return None if value is None else _dump(value)


_unpack_udf = _on_text(T.StringType(), _unpack_line)
_dict_udf = _on_text(T.StringType(), _dict_json)
_searchable_udf = _on_text(T.StringType(), lambda t: searchable(_json(t)))
_flat_udf = _on_text(T.MapType(T.StringType(), T.StringType()), lambda t: flattened(_json(t)))
_nested_udf = _on_text(T.ArrayType(T.StringType()), lambda t: nested_objects(_json(t)))

# An object of strings and whole numbers, without a bracket or an escaped one anywhere:
# nothing is nested, and text shows values as written.
_FLAT = r"""^\s*\{\s*("(?:[^"\\{}\[\]]++|\\[^u])*+"\s*:\s*("(?:[^"\\{}\[\]]++|\\[^u])*+"|-?(0|[1-9][0-9]{0,17}))\s*(,\s*(?=")|(?=\})))+\}\s*$"""

# The pattern calls itself for each key and each escape; longer records go to Python.
_FLAT_MOST = 4000


def flat_record(json_text: Column) -> Column:
    """MAP of a record that is flat, else null; its keys stand in their order. Costly: to
    be a column of its own, which the functions below take."""
    short = F.length(json_text) <= _FLAT_MOST
    record = F.from_json(F.when(short & json_text.rlike(_FLAT), json_text), "map<string,string>")
    # A key written twice would count once.
    once = lambda r: F.when(F.size(F.json_object_keys(json_text)) == F.size(F.array_distinct(F.map_keys(r))), r)
    return bound(record, lambda r: F.when(r.isNotNull(), once(r)))


def searchable_text(json_text: Column, flat: Column | None = None) -> Column:
    """`key=value` text of a record. Flat records (see `flat_record`) do not enter Python."""
    flat = flat_record(json_text) if flat is None else flat
    parts = F.transform(F.map_entries(flat), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.coalesce(F.array_join(parts, " "), _searchable_udf(F.when(flat.isNull(), json_text)))


def flat_values(json_text: Column, flat: Column | None = None) -> Column:
    """MAP of path to value of a record. Flat records do not enter Python."""
    flat = flat_record(json_text) if flat is None else flat
    return F.coalesce(flat, _flat_udf(F.when(flat.isNull(), json_text)))


def nested_data(json_text: Column, flat: Column | None = None) -> Column:
    """Objects inside strings. Flat records do not enter Python."""
    flat = flat_record(json_text) if flat is None else flat
    return F.coalesce(F.when(flat.isNotNull(), F.array().cast("array<string>")), _nested_udf(F.when(flat.isNull(), json_text)))


# A string value that itself starts like JSON.
_STRING_HOLDS_JSON = r"""[:\[,]\s*"\s*(\{|\[|\\")"""


def unpacked_json(line: Column) -> Column:
    """JSON object text with JSON inside its strings opened. Rows without any such
    string do not enter Python."""
    needed = line.rlike(_STRING_HOLDS_JSON)
    return F.coalesce(_unpack_udf(F.when(needed, line)), line)


def embedded_dict(text: Column) -> Column:
    """JSON text of the Python dict inside a free text, else null."""
    return _dict_udf(F.when(text.rlike(r"""\{['"]\w+['"]\s*:"""), text))
