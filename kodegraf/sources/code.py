"""Source trees as nodes, unresolved edges and comments.

Files are read as binary and parsed one by one in Arrow batches. Python is
parsed by its own grammar; Go, Java, Kotlin, TypeScript, JavaScript, Rust, C,
C++, PHP, Ruby and Lua by declarations at the start of lines, with the extent of
a declaration from its braces (or `end`). Beside nodes, edges and comments a
file gives its declared package, runs of lines of code, methods of Go types and
methods that Go interfaces want.
"""

from __future__ import annotations

import ast
import hashlib
import io
import os
import re
import tokenize

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kodegraf.functions.paths import excluded, included, split_top_level

# Languages by the extension of a file.
LANGUAGES = {
    ".go": "go", ".py": "python", ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript",
    ".rs": "rust", ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".hpp": "cpp", ".php": "php", ".rb": "ruby", ".lua": "lua",
}
SKIPPED = ("vendor", "node_modules")
#: Of the parsers: cached records of another one are not read.
VERSION = "2"
RECORD = "rec string, file_path string, language string, kind string, name string, qualified_name string, start_line int, end_line int, target string, text string, hash string"

_NAME = r"(?P<name>[A-Za-z_]\w*)"
DECLARATIONS = {
    "go": [("function", rf"^func\s+(?:\(\s*\w*\s*\*?(?P<owner>\w+)[^)]*\)\s*)?{_NAME}\s*[\[(]"), ("class", rf"^type\s+{_NAME}\s+struct\b"), ("type", rf"^type\s+{_NAME}\s+(?!struct\b)\S")],
    "rust": [("function", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+{_NAME}"), ("class", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum)\s+{_NAME}"), ("type", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+{_NAME}")],
    "ruby": [("function", rf"^\s*def\s+(?:self\.)?{_NAME}"), ("class", rf"^\s*(?:class|module)\s+{_NAME}")],
    "lua": [("function", rf"^\s*(?:local\s+)?function\s+(?:(?P<owner>\w+)[.:])?{_NAME}\s*\(")],
    "php": [("function", rf"^\s*(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+&?{_NAME}\s*\("), ("class", rf"^\s*(?:abstract\s+|final\s+)?(?:class|trait)\s+{_NAME}"), ("type", rf"^\s*interface\s+{_NAME}")],
    "kotlin": [("function", rf"^\s*(?:(?:public|private|protected|internal|override|open|suspend|inline|abstract|operator)\s+)*fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?{_NAME}\s*\("), ("class", rf"^\s*(?:(?:public|private|internal|open|abstract|data|sealed|enum)\s+)*(?:class|object)\s+{_NAME}"), ("type", rf"^\s*(?:\w+\s+)*interface\s+{_NAME}")],
    "java": [("class", rf"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*(?:class|enum|record)\s+{_NAME}"), ("type", rf"^\s*(?:(?:public|private|protected|static)\s+)*interface\s+{_NAME}"), ("function", rf"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized|default)\s+)*(?:<[^>]*>\s*)?[\w.<>\[\],?]+\s+{_NAME}\s*\([^;]*\)?\s*(?:throws[^{{]*)?\{{\s*$")],
    "typescript": [("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{_NAME}\s*[<(]"), ("class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{_NAME}"), ("type", rf"^\s*(?:export\s+)?(?:interface|type|enum)\s+{_NAME}"), ("function", rf"^\s*(?:export\s+)?const\s+{_NAME}\s*=\s*(?:async\s*)?\([^)]*\)[^=]*=>"), ("function", rf"^\s+(?:(?:public|private|protected|static|async|get|set)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b){_NAME}\s*\([^;]*\)\s*(?::[^{{]*)?\{{\s*$")],
    "c": [("class", rf"^\s*(?:typedef\s+)?(?:struct|union|enum)\s+{_NAME}\s*\{{?\s*$"), ("function", rf"^(?!\s)(?:[\w*&:<>,\s]+?[\s*&])?(?:(?P<owner>\w+)::)?~?{_NAME}\s*\([^;]*\)\s*(?:const\s*)?\{{?\s*$")],
}
DECLARATIONS |= {"javascript": DECLARATIONS["typescript"], "cpp": [*DECLARATIONS["c"], ("class", rf"^\s*class\s+{_NAME}")]}
DECLARATIONS = {k: [(kind, re.compile(rx)) for kind, rx in v] for k, v in DECLARATIONS.items()}
IMPORTS = re.compile(r"""^\s*(?:import|from|use|require|require_once|include|#include)\b\s*(?:static\s+)?(?:[\w*{}\s,$]+\s+from\s+)?\(?\s*["'<]?([\w./:@\\*-]+)["'>]?""")
CALL = re.compile(r"(?<![\w.])((?:[A-Za-z_]\w*(?:\.|::|->))*[A-Za-z_]\w*)\s*\(")
KEYWORDS = frozenset("if for while switch return func function catch def fn fun and or not in sizeof new elif else with class struct interface".split())
TESTS = {"go": r"^(Test|Benchmark|Fuzz|Example)(?![a-z])", "python": r"^test", "java": r"^test(?![a-z])", "kotlin": r"^test(?![a-z])"}


def listed(root: str, includes: list[str] = (), excludes: list[str] = (), recursive: bool = True) -> list[str]:
    """Regular source files under root, as paths relative to it, in order; dot, vendor and dependency folders, links and excluded paths are passed over."""
    out = []
    for folder, dirs, files in os.walk(root):
        rel = os.path.relpath(folder, root).replace(os.sep, "/")
        rel = "" if rel == "." else rel
        join = lambda n: f"{rel}/{n}" if rel else n  # noqa: B023, E731
        dirs[:] = sorted(d for d in dirs if recursive and not d.startswith(".") and d not in SKIPPED and not excluded(join(d), list(excludes)) and included(join(d), list(includes)))
        for f in sorted(files):
            full = os.path.join(folder, f)
            if os.path.splitext(f)[1] in LANGUAGES and not os.path.islink(full) and not excluded(join(f), list(excludes)) and (not includes or included(join(f), list(includes))):
                out.append(join(f))
    return out


def is_test(name: str, language: str, path: str) -> bool:
    return bool(re.search(TESTS[language], name)) if language in TESTS else bool(re.search(r"(^|/)tests?/|[._]test\.|\.spec\.", path)) and name.lower().startswith("test")


#: Lines that a comment may be parted from its declaration by, beside blank ones: comments, decorators and attributes.
PASSED = re.compile(r"//|#|/\*|\*|--|@|__attribute__|\[\[")


def code_runs(lines: list[str]) -> list[dict]:
    """Runs of lines that are neither blank nor passed over."""
    rows: list[dict] = []
    for i, line in enumerate(lines, 1):
        s = line.strip()
        if s and not PASSED.match(s):
            if rows and rows[-1]["end_line"] == i - 1:
                rows[-1]["end_line"] = i
            else:
                rows.append({"rec": "code", "start_line": i, "end_line": i})
    return rows


def _hash_comments(text: str) -> list[dict]:
    """Comments that stand alone on their lines, neighbouring ones together."""
    rows: list[dict] = []
    for t in tokenize.generate_tokens(io.StringIO(text).readline):
        if t.type == tokenize.COMMENT and not t.line[: t.start[1]].strip():
            if rows and rows[-1]["end_line"] == t.start[0] - 1:
                rows[-1]["end_line"] = t.start[0]
                rows[-1]["text"] += "\n" + t.string
            else:
                rows.append({"rec": "comment", "start_line": t.start[0], "end_line": t.start[0], "text": t.string})
    return rows


def _python(path: str, text: str) -> list[dict]:
    module = re.sub(r"(/__init__)?\.py$", "", path).replace("/", ".")
    tree = ast.parse(text)
    lines = text.split("\n")
    rows = _hash_comments(text)

    def doc(node, line):
        """The docstring of a definition, or of the module for line 0, if it is in triple quotes with no prefix but r or u."""
        if ast.get_docstring(node, clean=False) is None:
            return
        at = node.body[0]
        m = re.match(r"[rRuU]?(?:\"\"\"|''')", lines[at.lineno - 1].encode()[at.col_offset :].decode("utf-8", "replace"))
        if m:
            rows.append({"rec": "comment", "start_line": at.lineno, "end_line": at.end_lineno, "text": at.value.value, "target": str(line)})

    def walk(node, owner):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                qn = f"{owner}.{child.name}"
                first = min([child.lineno, *[d.lineno for d in child.decorator_list]])
                kind = "class" if isinstance(child, ast.ClassDef) else "test" if is_test(child.name, "python", path) else "function"
                rows.append({"rec": "node", "kind": kind, "name": child.name, "qualified_name": qn, "start_line": first, "end_line": child.end_lineno})
                rows.append({"rec": "edge", "kind": "contains", "name": owner, "target": qn, "start_line": first})
                if isinstance(child, ast.ClassDef):
                    rows.extend({"rec": "edge", "kind": "inherits", "name": qn, "target": ast.unparse(b), "start_line": child.lineno} for b in child.bases)
                doc(child, first)
                walk(child, qn)
            else:
                if isinstance(child, ast.Call):
                    rows.append({"rec": "edge", "kind": "calls", "target": ast.unparse(child.func), "start_line": child.lineno})
                elif isinstance(child, ast.Import):
                    rows.extend({"rec": "edge", "kind": "imports_from", "target": a.name, "start_line": child.lineno} for a in child.names)
                elif isinstance(child, ast.ImportFrom):
                    rows.append({"rec": "edge", "kind": "imports_from", "target": "." * child.level + (child.module or ""), "start_line": child.lineno})
                walk(child, owner)

    doc(tree, 0)
    walk(tree, module)
    return rows


def _end(lines: list[str], first: int, language: str) -> int:
    """Last line of a declaration: where its braces close, or the `end` of its indent."""
    if language in ("ruby", "lua"):
        indent = len(lines[first]) - len(lines[first].lstrip())
        return next((i for i in range(first + 1, len(lines)) if re.match(rf"\s{{{indent}}}end\b", lines[i])), first)
    depth, opened = 0, False
    for i in range(first, len(lines)):
        code = re.sub(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'|//.*', "", lines[i])
        depth += code.count("{") - code.count("}")
        opened |= "{" in code
        if opened and depth <= 0:
            return i
        if not opened and (i > first + 2 or code.rstrip().endswith(";")):
            return first
    return first


PACKAGE = re.compile(r"\s*(?:package|namespace)\s+([\w.\\]+)")
#: Languages whose package clause names a package of the tree.
WITH_PACKAGES = ("go", "java", "kotlin")
IMPL = re.compile(r"^\s*(?:unsafe\s+)?impl\b\s*(?:<[^{]*?>\s*)?(?:(?P<trait>[\w:]+)(?:<[^{]*?>)?\s+for\s+)?(?P<type>[\w:]+)")
ASSERTED = re.compile(r"^\s*(?:var\s+)?_\s+([\w.]+)\s*=\s*(?:\(\*(\w+)\)\(nil\)|&(\w+)\{\})")
EMBEDDED = re.compile(r"^\s*\*?([\w.]+)\s*(?:`[^`]*`)?\s*(?://.*)?$")
WANTED = re.compile(r"^\s*([A-Za-z_]\w*)\s*\(")


def _header(lines: list[str], first: int) -> str:
    """The lines of a declaration up to its body, as one."""
    head = ""
    for line in lines[first : first + 40]:
        head += " " + re.sub(r"//.*", "", line).strip()
        if "{" in line or line.rstrip().endswith(";"):
            break
    return head.partition("{")[0]


def heritage(language: str, head: str, name: str) -> list[tuple[str, str]]:
    """(kind, target) of what a class or type extends or implements."""
    rest = re.split(rf"\b{re.escape(name)}\b", head, maxsplit=1)[-1]
    bare = lambda t: re.sub(r"<.*", "", t).strip()
    if language == "kotlin":
        depth, at, body = 0, None, rest
        for i, c in enumerate(body):
            depth += (c in "(<[") - (c in ")>]")
            if c == ":" and depth <= 0:
                at = i
                break
        return [("inherits" if "(" in t else "implements", bare(t.partition("(")[0].split(" by ")[0])) for t in split_top_level(body[at + 1 :])] if at is not None else []
    out = []
    for kind, word in (("inherits", "extends"), ("implements", "implements")):
        if m := re.search(rf"\b{word}\b(.*?)(?:\bextends\b|\bimplements\b|\bpermits\b|$)", rest):
            out += [(kind, bare(t)) for t in split_top_level(m[1]) if bare(t)]
    return out


def rust_uses(tree: str) -> list[str]:
    """Paths of a use tree: a::{b, c::d} names a::b and a::c::d; globs name nothing."""
    m = re.fullmatch(r"\s*(?:([\w:]+)::)?\{(.*)\}\s*", tree, re.S)
    if m:
        inside = [x for part in split_top_level(m[2].replace("{", "(").replace("}", ")")) for x in rust_uses(part.replace("(", "{").replace(")", "}"))]
        return [f"{m[1]}::{x}" if m[1] and x != "self" else m[1] if x == "self" else x for x in inside]
    head, brace, rest = tree.partition("::{")
    if brace:
        return [f"{head.strip()}::{x}" if x != "self" else head.strip() for x in rust_uses("{" + rest)]
    path = re.sub(r"\s+as\s+\w+\s*$", "", tree).strip()
    return [] if path.endswith("*") or not path else [path]


#: Where a variable or member gets a type, by language.
TYPED = {
    "java": re.compile(r"(?<![\w.])(?P<type>[A-Z]\w*)(?:<[^;=()]*>)?\s+(?P<name>[a-z_]\w*)\s*[=;,)]"),
    "kotlin": re.compile(r"\b(?P<name>[a-z_]\w*)\s*(?::\s*(?P<type>[A-Z]\w*)|=\s*(?P<made>[A-Z]\w*)\()"),
    "typescript": re.compile(r"\b(?P<name>[a-z_]\w*)\s*(?:\?|!)?\s*(?::\s*(?P<type>[A-Z]\w*)|=\s*new\s+(?P<made>[A-Z]\w*))"),
}


def typed_names(language: str, lines: list[str], owners: list[str]) -> tuple[dict[str, str], dict[tuple[str, str], str]]:
    """Types of variables over the whole file, the last one winning, and of members by their owner."""
    names, members = {}, {}
    rx = TYPED.get(language)
    if rx:
        for line, owner in zip(lines, owners):
            for m in rx.finditer(line):
                t = m["type"] or m.groupdict().get("made")
                if t:
                    names[m["name"]] = t
                    if owner:
                        members[owner, m["name"]] = t
    return names, members


def rewritten(callee: str, names: dict[str, str], members: dict[tuple[str, str], str]) -> str:
    """a.b.m as Type.m: from the type of a variable on along members; as it is where a type is not known."""
    *chain, method = callee.split(".")
    chain = chain[1:] if chain[:1] == ["this"] else chain
    if not chain or chain[0] not in names:
        return callee
    t = names[chain[0]]
    for x in chain[1:]:
        t = members.get((t, x))
        if t is None:
            return callee
    return f"{t}.{method}"


def _lines(path: str, text: str, language: str) -> list[dict]:
    lines, rows = text.split("\n"), []
    package = next((m[1] for line in lines[:80] if (m := PACKAGE.match(line))), "")
    owners: list[tuple[int, str, str]] = []  # last line, name and kind of what is open
    comment: list[int] = []
    block = False  # inside a block comment
    declared: dict[int, set[str]] = {}
    inside: list[str] = []  # the owner of each line
    calls: list[tuple[int, str]] = []

    def flush():
        if comment:
            rows.append({"rec": "comment", "start_line": comment[0] + 1, "end_line": comment[-1] + 1, "text": "\n".join(lines[comment[0] : comment[-1] + 1])})
            comment.clear()

    for i, line in enumerate(lines):
        while owners and owners[-1][0] < i:
            owners.pop()
        inside.append(owners[-1][1] if owners else "")
        s = line.strip()
        if block or s.startswith(("//", "/*", "--") if language not in ("ruby", "php") else ("#", "//", "/*")):
            comment.append(i)
            block = "*/" not in (s if block else s[2:]) if block or s.startswith("/*") else False
            continue
        flush()
        if not package and not declared and (m := PACKAGE.match(line)):  # behind a long comment
            package = m[1]
        if language == "rust" and (m := IMPL.match(line)):
            name = m["type"].split("::")[-1]
            if m["trait"]:
                rows.append({"rec": "edge", "kind": "implements", "name": name, "target": m["trait"], "start_line": i + 1})
            owners.append((_end(lines, i, language), name, "impl"))
            continue
        if language == "go" and (m := ASSERTED.match(line)):
            rows.append({"rec": "edge", "kind": "implements", "name": ".".join(x for x in (package, m[2] or m[3]) if x), "target": m[1], "start_line": i + 1})
        if language == "go" and owners and owners[-1][2] == "struct" and (m := EMBEDDED.match(line)):
            rows.append({"rec": "edge", "kind": "inherits", "name": ".".join(x for x in (package, owners[-1][1]) if x), "target": m[1], "start_line": i + 1})
        if language == "go" and owners and owners[-1][2] == "interface":
            if m := WANTED.match(line):
                rows.append({"rec": "wants", "name": ".".join(x for x in (package, owners[-1][1]) if x), "target": m[1]})
            continue
        for kind, rx in DECLARATIONS[language]:
            if (m := rx.match(line)) and m["name"] not in KEYWORDS:
                owner = m.groupdict().get("owner") or (owners[-1][1] if owners else "")
                qn, end = ".".join(x for x in (package, owner, m["name"]) if x), _end(lines, i, language)
                if language == "go" and kind == "function" and owner:
                    rows.append({"rec": "method", "name": ".".join(x for x in (package, owner) if x), "target": m["name"]})
                kind = "test" if kind == "function" and is_test(m["name"], language, path) else kind
                rows.append({"rec": "node", "kind": kind, "name": m["name"], "qualified_name": qn, "start_line": i + 1, "end_line": end + 1})
                rows.append({"rec": "edge", "kind": "contains", "name": path, "target": qn, "start_line": i + 1})
                declared.setdefault(i, set()).add(m["name"])
                if kind in ("class", "type") and end > i:
                    owners.append((end, m["name"], "struct" if "struct" in line else "interface" if "interface" in line else kind))
                if kind in ("class", "type") and language not in ("go", "rust", "c"):
                    rows.extend({"rec": "edge", "kind": what, "name": qn, "target": t, "start_line": i + 1} for what, t in heritage(language, _header(lines, i), m["name"]))
                break
        if language == "rust" and (m := re.match(r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]*)", line)):
            tree, k = m[1], i
            while ";" not in lines[k] and k + 1 < min(len(lines), i + 60):
                k += 1
                tree += lines[k].partition(";")[0]
            rows.extend({"rec": "edge", "kind": "imports_from", "target": t, "start_line": i + 1} for t in rust_uses(tree))
        elif (m := IMPORTS.match(line)) or (language == "go" and (m := re.match(r'^\s+(?:\w+\s+)?"([\w./-]+)"\s*$', line))):
            rows.append({"rec": "edge", "kind": "imports_from", "target": m[1], "start_line": i + 1})
        for m in CALL.finditer(line):
            if m[1] not in KEYWORDS and m[1].split(".")[-1] not in declared.get(i, ()):
                calls.append((i, m[1].replace("->", ".")))
        if language == "rust":
            calls.extend((i, f"{m[1]}::{m[2]}") for m in re.finditer(r"<\s*[\w:]+\s+as\s+([\w:]+)\s*>::(\w+)\s*\(", line))
    flush()
    names, members = typed_names({"javascript": "typescript"}.get(language, language), lines, inside)
    rows.extend({"rec": "edge", "kind": "calls", "target": rewritten(callee, names, members), "start_line": i + 1} for i, callee in calls)
    if package and language in WITH_PACKAGES:
        rows.append({"rec": "package", "name": package})
    return rows


def parse_file(path: str, content: bytes) -> list[dict]:
    """Records of one file; the first is its file node. A file that can't be parsed gives that node only."""
    language = LANGUAGES.get(os.path.splitext(path)[1], "")
    text = content.decode("utf-8", "replace")
    head = {"rec": "node", "kind": "file", "name": os.path.basename(path), "qualified_name": path, "start_line": 1, "end_line": text.count("\n") + 1}
    try:
        rest = _python(path, text) if language == "python" else _lines(path, text, language) if language in DECLARATIONS else []
    except (SyntaxError, ValueError, RecursionError):
        rest = []
    digest = hashlib.sha256(content).hexdigest()
    blank = dict.fromkeys(("kind", "name", "qualified_name", "start_line", "end_line", "target", "text"))
    runs = code_runs(text.split("\n")) if rest else []
    return [blank | r | {"file_path": path, "language": language, "hash": digest} for r in [head, *rest, *runs]]


def read_tree(spark: SparkSession, root: str, includes: list[str] = (), excludes: list[str] = (), max_file_bytes: int = 0, max_total_bytes: int = 0) -> DataFrame:
    """(file_path, content) of the source files under a root on a file system that all machines see."""
    paths = listed(root, includes, excludes)
    sizes = [os.path.getsize(os.path.join(root, p)) for p in paths]
    if max_file_bytes and (big := next((p for p, n in zip(paths, sizes) if n > max_file_bytes), None)):
        raise ValueError(f"{big} is larger than {max_file_bytes} bytes")
    if max_total_bytes and sum(sizes) > max_total_bytes:
        raise ValueError(f"the files hold more than {max_total_bytes} bytes")
    # The reader passes over empty files.
    empty = spark.createDataFrame([(p, b"") for p, n in zip(paths, sizes) if n == 0], "file_path string, content binary")
    paths = [p for p, n in zip(paths, sizes) if n]
    if not paths:
        return empty
    files = spark.read.format("binaryFile").load([os.path.join(root, p) for p in paths])
    prefix = "file:" + os.path.abspath(root).rstrip("/") + "/"
    return files.select(F.expr(f"substring(regexp_replace(path, '^file:/+', 'file:/'), {len(prefix) + 1})").alias("file_path"), "content").unionByName(empty)


def parsed(files: DataFrame) -> DataFrame:
    """Tagged records (node, edge, comment) of (file_path, content)."""
    import pandas as pd

    def run(it):
        for pdf in it:
            yield pd.DataFrame([r for p, c in zip(pdf.file_path, pdf.content) for r in parse_file(p, bytes(c))], columns=[c.split()[0] for c in RECORD.split(", ")]).astype({"start_line": "Int32", "end_line": "Int32"})

    return files.select("file_path", "content").mapInPandas(run, RECORD)
