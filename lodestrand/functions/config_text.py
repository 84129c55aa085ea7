"""Edits of configuration texts: marked blocks and tables as columns, JSON objects on the driver."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def with_marked_block(text: Column, begin: str, end: str, block: str) -> Column:
    """What stands between the markers is replaced; without markers the block is appended."""
    whole = f"{begin}\n{block}\n{end}"
    pattern = f"(?s){re.escape(begin)}.*?{re.escape(end)}"
    text = F.coalesce(text, F.lit(""))
    gap = F.when((text == "") | text.endswith("\n"), "").otherwise("\n")
    return F.when(text.contains(begin) & text.contains(end), F.regexp_replace(text, pattern, _quoted(whole))).otherwise(F.concat(text, gap, F.lit(whole + "\n")))


def without_toml_table(text: Column, header: str) -> Column:
    """Without the table under ``header`` (as ``[name]``), up to the next header."""
    line = r"(?![ \t]*\[)(?:[^\n]+\n?|\n)"
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?m)^[ \t]*{re.escape(header)}(?=[ \t\r\n]|\z)[^\n]*\n?(?:{line})*", "")


def merged_json(text: str | None, path: tuple[str, ...], value: object) -> str:
    """The object in ``text`` (none or blank: an empty one) with ``value`` under ``path``; all else is as it was.  A text
    that holds no object is an error, and so is a path through something that is none."""
    root = json.loads(text) if text and text.strip() else {}
    at = root
    for key in path[:-1]:
        if not isinstance(at, dict):
            raise ValueError("not an object")
        at = at.setdefault(key, {})
    if not isinstance(at, dict):
        raise ValueError("not an object")
    at[path[-1]] = value
    return json.dumps(root, indent=2, ensure_ascii=False) + "\n"


def wants_client(clients: Column, name: str) -> Column:
    """An empty list wants every client, and so does ``all``; else it names them, separated by commas."""
    parts = F.transform(F.split(F.lower(clients), ","), lambda p: F.trim(p))
    return clients.isNull() | clients.isin("", "all") | F.array_contains(parts, name)
