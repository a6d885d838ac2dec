"""Edge fingerprints: the text form of an edge before its ends are known.

The formats are fixed values, since stored tables hold them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# kind:file:target:line for calls and imports, kind:file:name for contains, kind:file:source:target for the others;
# inherits:v2: is followed by a JSON object of child, file and parent.
INHERITS_V2 = "inherits:v2:"
INHERITS_SCHEMA = "child string, file string, parent string"


def build(kind: str, file: Column, *parts: Column) -> Column:
    if kind == "inherits":
        child, parent = parts
        return F.concat(F.lit(INHERITS_V2), F.to_json(F.struct(child.alias("child"), file.alias("file"), parent.alias("parent"))))
    return F.concat_ws(":", F.lit(kind), file, *[p.cast("string") for p in parts])


def parse(fingerprint: Column, file: Column) -> Column:
    """kind, source, target and line. The file is known from the edge, so that colons in names do no harm where they can be told."""
    kind = F.split_part(fingerprint, F.lit(":"), F.lit(1))
    rest = F.substr(fingerprint, F.length(kind) + F.length(file) + 3)
    numbered = kind.isin("calls", "fallback_calls", "imports_from")
    line = F.regexp_extract(rest, r":(\d+)$", 1).try_cast("int")
    v2 = F.startswith(fingerprint, F.lit(INHERITS_V2))
    tree = F.from_json(F.when(v2, F.substr(fingerprint, F.lit(len(INHERITS_V2) + 1))), INHERITS_SCHEMA)
    first = F.split_part(rest, F.lit(":"), F.lit(1))
    after = F.substr(rest, F.length(first) + 2)
    source = F.when(v2, tree["child"]).when(kind.isin("implements", "inherits"), first).when(kind == "tested_by", after)
    target = F.when(v2, tree["parent"]).when(numbered, F.regexp_replace(rest, r":\d+$", "")).when(kind.isin("implements", "inherits"), after).when(kind == "tested_by", first).otherwise(rest)
    return F.struct(kind.alias("kind"), source.alias("source"), target.alias("target"), F.when(numbered, line).alias("line"))
