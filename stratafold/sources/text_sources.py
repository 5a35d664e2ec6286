"""Group files, ini files and HTTP ranges' stand-in: line-oriented sources as tables."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def parse_group_lines(lines: list[str]) -> list[tuple[int, str, str]]:
    """(rank, type, mask) of an ordered mask list; ``;`` starts a comment, ``$name`` a type."""
    out, kind = [], "$default"
    for line in lines:
        text = line.split(";", 1)[0].strip()
        if not text:
            continue
        if text.startswith("$"):
            kind = text.split()[0]
            if kind == "$default":
                out.append((len(out), kind, "*"))
        else:
            out.append((len(out), kind, text))
    return out


def group_masks(spark: SparkSession, lines: list[str]) -> DataFrame:
    return spark.createDataFrame(parse_group_lines(lines), "rank int, type string, mask string")


def parse_ini(text: str) -> dict[str, list[tuple[str, str]]]:
    """Section name to its (key, value) lines in order; ``;`` starts a comment."""
    out: dict[str, list[tuple[str, str]]] = {}
    section = ""
    for line in text.splitlines():
        line = line.split(";", 1)[0].strip()
        if m := re.fullmatch(r"\[(.*)\]", line):
            section = m[1].strip()
            out.setdefault(section, [])
        elif line:
            key, _, value = line.partition("=")
            out.setdefault(section, []).append((key.strip(), value.strip()))
    return out


def resolve_macro(name: str, macros: Mapping[str, str], depth: int = 32) -> str:
    """Replace names by their definitions, method by method, until none is left.

    ``#`` in a definition's name stands for one digit, which replaces ``#`` in its value.
    """
    if depth == 0:
        raise ValueError(f"macro {name} refers to itself")

    def one(part: str) -> str:
        head, colon, rest = part.partition(":")
        if head in macros:
            return resolve_macro(macros[head], macros, depth - 1) + colon + rest
        general = re.sub(r"\d", "#", head, count=1)
        if general in macros and general != head:
            digit = re.search(r"\d", head)[0]
            return resolve_macro(macros[general].replace("#", digit), macros, depth - 1) + colon + rest
        return part

    return "+".join(one(p) for p in name.split("+"))
