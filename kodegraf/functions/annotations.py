"""Structured comments: cleaning, parsing, and links in them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kodegraf.schema import TAG_KINDS

#: Other spellings of tags (fixed values).
ALIASES = {"returns": "return", "throw": "throws", "exception": "throws", "sideeffect": "sideEffect", "domainrule": "domainRule", "arg": "param", "parameter": "param"}
#: Comment openers that start a line, by language.
MARKS = {"python": ("#",), "ruby": ("#",), "lua": ("--",), "php": ("//", "#")}
SCHEMA = "struct<summary string, context string, tags array<struct<kind string, type string, name string, value string, ordinal int>>>"
_TAG = re.compile(r"^@(\w+)\s*(.*)$", re.S)
_NAMED = ("param", "typedef")


def normalize(text: str, language: str = "") -> str:
    """The words of a comment without its marks; compiler directives drop."""
    marks = MARKS.get(language, ("///", "//!", "//"))
    body = text.strip()
    for quote in ('"""', "'''"):
        if body.startswith(quote) and body.endswith(quote) and len(body) >= 6:
            body = body[3:-3]
    if body.startswith("/*"):
        body = re.sub(r"^/\*+!?|\*+/$", "", body)
    lines = []
    for line in body.splitlines():
        line = line.strip()
        if re.match(r"//(go|nolint|line|export)\b:?", line):
            continue
        mark = next((m for m in marks if line.startswith(m)), None)
        line = line[len(mark) :] if mark else re.sub(r"^\*+(?!/)\s?", "", line)
        lines.append(line.strip())
    return "\n".join(lines).strip()


def parse(text: str) -> dict:
    """summary (first paragraph), context (second one) and tags; a tag's value runs on over following lines."""
    paragraphs, tags, current, ordinals = [[]], [], None, {}
    for line in text.splitlines():
        m = _TAG.match(line.strip())
        kind = ALIASES.get(m[1].lower(), ALIASES.get(m[1], m[1])) if m else None
        if kind in TAG_KINDS:
            rest, type_ = m[2].strip(), ""
            if t := re.match(r"^(?:\{([^}]*)\}|\[([^\]]*)\])\s*", rest):
                type_, rest = t[1] or t[2] or "", rest[t.end() :]
            name = ""
            if kind in _NAMED and rest:
                name, _, rest = rest.partition(" ")
            ordinals[kind] = ordinals.get(kind, -1) + 1
            current = {"kind": kind, "type": type_, "name": name, "value": rest.strip(), "ordinal": ordinals[kind]}
            tags.append(current)
        elif current is not None:
            if line.strip():
                current["value"] = f"{current['value']} {line.strip()}".strip()
        elif line.strip():
            paragraphs[-1].append(line.strip())
        elif paragraphs[-1]:
            paragraphs.append([])
    text_of = [" ".join(p) for p in paragraphs if p]
    return {"summary": text_of[0] if text_of else "", "context": text_of[1] if len(text_of) > 1 else "", "tags": tags}


def parsed_comments(comments: DataFrame) -> DataFrame:
    """comments (…, text, language) with the struct `annotation`; parsing is a function of one text, in Arrow batches."""

    @F.pandas_udf(SCHEMA)
    def one(text, language):
        import pandas as pd

        return pd.DataFrame([parse(normalize(t or "", g or "")) for t, g in zip(text, language)])

    return comments.withColumn("annotation", one("text", "language"))


def tag_values(tags: Column, kind: str) -> Column:
    """Trimmed values of a kind in order, blank ones left out."""
    own = F.array_sort(F.transform(F.filter(tags, lambda t: t["kind"] == kind), lambda t: F.struct(t["ordinal"].alias("o"), F.trim(t["value"]).alias("v"))))
    return F.filter(F.transform(own, lambda t: t["v"]), lambda v: v != "")


def recorded_reason(tags: Column) -> Column:
    """The first intent, else the first domain rule that is not blank."""
    return F.coalesce(F.try_element_at(tag_values(tags, "intent"), F.lit(1)), F.try_element_at(tag_values(tags, "domainRule"), F.lit(1)))
