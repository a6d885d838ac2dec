"""Path rules of a source scan, as predicates on the driver and as columns."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_REGEX = re.compile(r"[$^+{}|]|\\\.|\.\*")


def exclusion(pattern: str) -> re.Pattern | None:
    """A pattern that holds signs of a regular expression is one; others are a path, a folder or a glob (on the whole path if it has a slash, else on the name). Broken ones exclude nothing."""
    try:
        if _REGEX.search(pattern):
            return re.compile(pattern)
        p = pattern.strip("/")
        if any(c in p for c in "*?["):
            glob = fnmatch.translate(p).removesuffix(r"\Z").removesuffix(r"\z")
            return re.compile(rf"^{glob}$" if "/" in p else rf"(?:^|/){glob}$")
        return re.compile(rf"^{re.escape(p)}(?:/|$)")
    except re.error:
        return None


def excluded(path: str, patterns: list[str]) -> bool:
    return any(r.search(path) for p in patterns if (r := exclusion(p)))


def included(path: str, includes: list[str]) -> bool:
    """Whether a path is an include, lies under one, or leads to one."""
    return not includes or any(path == i or path.startswith(i + "/") or i.startswith(path + "/") for i in (x.strip("/") for x in includes))


def included_column(path: Column, includes: list[str]) -> Column:
    ok = F.lit(not includes)
    for i in (x.strip("/") for x in includes):
        ok = ok | (path == i) | F.startswith(path, F.lit(i + "/")) | F.startswith(F.lit(i), F.concat(path, F.lit("/")))
    return ok


def common_suffix_depth(a: Column, b: Column) -> Column:
    """Number of equal trailing segments of two paths."""
    same = F.zip_with(F.reverse(F.split(a, "/")), F.reverse(F.split(b, "/")), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same)).cast("int")


def split_top_level(text: str) -> list[str]:
    """Parts between commas that stand outside of round, square and angle brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "<([") - (c in ">)]")
        if c == "," and depth <= 0:
            out.append(text[start:i])
            start = i + 1
    return [p for p in (x.strip() for x in [*out, text[start:]]) if p]


def clean_target(target: str) -> str:
    """A path as it was typed: without blanks, a leading ./, doubled and outer slashes."""
    t = re.sub(r"/+", "/", target.strip().replace("\\", "/"))
    return re.sub(r"^(\./)+", "", t).strip("/")
