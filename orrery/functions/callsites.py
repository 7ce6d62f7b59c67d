"""Call sites of a package's symbol in source text.

Python is parsed; the other languages go through one scanner that blanks
comments and strings and matches import forms and calls by pattern, so calls in
generated or heavily templated code may be missed.  A call counts if its name
is bound by an import of the package, or its receiver is the package or bound to
it; names bound to other packages, and calls inside a local function of the same
name, do not.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .imports import LANGUAGES, STRINGS

NAME = r"[A-Za-z_$][\w$]*"
TYPE = "array<struct<line_start:int,line_end:int,start_byte:int,end_byte:int,snippet:string>>"


def blanked(source: str, hash_comments: bool = False) -> str:
    """Comments and string contents replaced by spaces, positions kept."""
    fill = lambda m: re.sub(r"[^\n]", " ", m[0])
    text = STRINGS.sub(fill, source)
    return re.sub(r"#[^\n]*", fill, text) if hash_comments else text


def bare_symbol(symbol: str, package: str | None) -> str:
    """The symbol without its signature and package prefix."""
    name = symbol.split("(")[0].strip()
    for prefix in (f"{package}.", f"{package}::", f"{package}#") if package else ():
        name = name.removeprefix(prefix)
    return name


def _same(module: str, packages: tuple[str, ...]) -> bool:
    return any(module == p or module.startswith((p + "/", p + ".", p + "::")) for p in packages)


def python_calls(source: str, symbol: str, packages: tuple[str, ...]) -> list[tuple[int, int]]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    direct, spaces = set(), set()
    name, head = symbol.rsplit(".", 1)[-1], symbol.split(".")[0]
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            spaces |= {a.asname or a.name.split(".")[0] for a in node.names if not packages or _same(a.name, packages)}
        elif isinstance(node, ast.ImportFrom) and not node.level and (not packages or _same(node.module or "", packages)):
            direct |= {a.asname or a.name for a in node.names if a.name in (name, symbol)}
            spaces |= {a.asname or a.name for a in node.names if a.name == head and head != name}
    local = [n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.name == name]
    for node in ast.walk(tree):  # instances of an imported class
        if isinstance(node, ast.Assign) and isinstance(node.value, ast.Call) and isinstance(node.value.func, (ast.Name, ast.Attribute)):
            base = node.value.func
            while isinstance(base, ast.Attribute):
                base = base.value
            if isinstance(base, ast.Name) and base.id in spaces:
                spaces |= {t.id for t in node.targets if isinstance(t, ast.Name)}
    data = source.encode()
    starts = [0]
    for line in data.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    found = []
    for node in ast.walk(tree):
        if not isinstance(node, ast.Call):
            continue
        f = node.func
        if isinstance(f, ast.Name):
            inside = any(d.lineno <= node.lineno <= (d.end_lineno or d.lineno) for d in local)
            ok = f.id in direct and not inside and not (f.id == name and local)
        elif isinstance(f, ast.Attribute):
            base = f.value
            while isinstance(base, (ast.Attribute, ast.Call)):
                base = base.value if isinstance(base, ast.Attribute) else base.func
            ok = f.attr == name and isinstance(base, ast.Name) and base.id in spaces
        else:
            ok = False
        if ok:
            found.append((starts[node.lineno - 1] + node.col_offset, starts[node.end_lineno - 1] + node.end_col_offset))
    return found


def bindings(source: str, text: str, language: str, symbol: str, packages: tuple[str, ...]) -> tuple[set[str], set[str], set[str]]:
    """(names of the symbol, names of the package or what holds the symbol, names bound to other packages)."""
    direct, spaces, foreign = set(), set(), set()

    def bind(module: str, names: list[tuple[str, str]], whole: list[str]) -> None:
        if not packages or _same(module, packages):
            direct.update(own for name, own in names if name == symbol)
            spaces.update(own for name, own in names if name != symbol)
            spaces.update(whole)
        else:
            foreign.update([own for _, own in names] + whole)

    def listed(inner: str, word: str) -> list[tuple[str, str]]:
        parts = [re.split(word, x.strip()) for x in inner.split(",") if x.strip()]
        return [(p[0].removeprefix("type ").strip(), p[-1].removeprefix("type ").strip()) for p in parts]

    if language in ("typescript", "tsx", "javascript"):
        for m in re.finditer(rf"""\bimport\s+(?:type\s+)?(?:({NAME})\s*,?\s*)?(?:\*\s+as\s+({NAME})|\{{([^}}]*)\}})?\s*from\s*(["'])([^"']+)\4""", source):
            bind(m[5], listed(m[3] or "", r"\s+as\s+"), [x for x in (m[1], m[2]) if x])
            if m[1] and m[1] == symbol and (not packages or _same(m[5], packages)):
                direct.add(m[1])
        for m in re.finditer(rf"""\b(?:const|let|var)\s+(?:({NAME})|\{{([^}}]*)\}})\s*=\s*require\(\s*(["'])([^"']+)\3\s*\)(?:\.({NAME}))?""", source):
            if m[5]:
                bind(m[4], [(m[5], m[1])] if m[1] else [], [])
            else:
                bind(m[4], listed(m[2] or "", r"\s*:\s*"), [m[1]] if m[1] else [])
        for m in re.finditer(rf"\b(?:const|let|var)\s+({NAME})\s*(?::[^=\n]+)?=\s*(?:await\s+)?(?:new\s+)?({NAME})(?:\.{NAME})*\s*\(", text):
            if m[2] in spaces | direct:
                spaces.add(m[1])
    elif language == "go":
        lines = re.findall(r'^\s*import\s+(?:([\w.]+)\s+)?"([^"\n]+)"', source, re.M)
        for block in re.findall(r"^\s*import\s*\((.*?)\)", source, re.M | re.S):
            lines += re.findall(r'(?:([\w.]+)\s+)?"([^"\n]+)"', block)
        for alias, module in lines:
            bind(module, [], [alias or re.sub(r"^v\d+$", "", module.split("/")[-1]) or module.split("/")[-2]])
    elif language == "rust":
        for use in re.findall(r"\buse\s+([^;]+);", text):
            use = use.strip()
            root = use.split("::")[0]
            if "{" in use:
                bind(root, listed(use[use.index("{") + 1 : use.rindex("}")], r"\s+as\s+"), [])
            else:
                path, _, alias = use.partition(" as ")
                last = path.split("::")[-1].strip()
                bind(root, [(last, alias.strip() or last)], [])
        for p in packages:
            spaces.add(p.replace("-", "_"))
    elif language == "java":
        for static, path in re.findall(r"\bimport\s+(static\s+)?([\w.]+(?:\.\*)?)\s*;", text):
            last = path.split(".")[-1]
            bind(path, [(last, last)] if static and last != "*" else [], [] if static or last == "*" else [last])
            if static and last == "*" and _same(path, packages):
                direct.add(symbol)
    elif language == "ruby":
        for module in re.findall(r"""\brequire(?:_relative)?\s*\(?\s*["']([^"'\n]+)["']""", source):
            if not packages or _same(module, packages):
                direct.add(symbol)
                spaces.add("".join(x.capitalize() for x in re.split(r"[_-]", module.split("/")[-1])))
    elif language == "c_sharp":
        for alias, path in re.findall(r"\busing\s+(?:static\s+)?(?:(\w+)\s*=\s*)?([\w.]+)\s*;", text):
            if not packages or _same(path, packages) or any(p.lower() == path.lower() for p in packages):
                spaces.update(x for x in (alias, path.split(".")[-1]) if x)
                direct.add(symbol)
    if language in ("ruby", "c_sharp", "java", "go"):
        for m in re.finditer(rf"(?:\b(?:var|{NAME})\s+)?\b({NAME})\s*:?=\s*(?:new\s+|&)?({NAME})(?:(?:\.|::){NAME})*\s*[({{.]", text):
            if m[2] in spaces:
                spaces.add(m[1])
    return direct, spaces, foreign


def _close(text: str, at: int) -> int:
    """Past the bracket that closes the one at ``at``."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] in "([{") - (text[i] in ")]}")
        if not depth:
            return i + 1
    return len(text)


def scanned_calls(source: str, language: str, symbol: str, packages: tuple[str, ...], capitals: bool = False) -> list[tuple[int, int]]:
    """``capitals``: in C#, a receiver that begins with a capital is taken for a class of the package if the file uses the package."""
    text = blanked(source, language == "ruby")
    direct, spaces, foreign = bindings(source, text, language, symbol, packages)
    own = [(m.end(), _close(text, text.find("{", m.end()))) for m in re.finditer(rf"\b(?:function|func|fn|def)\s+{re.escape(symbol)}\b", text) if text.find("{", m.end()) >= 0]
    local = re.search(rf"\b(?:function|func|fn|def)\s+{re.escape(symbol)}\b", text) is not None
    found = []
    for m in re.finditer(rf"(?:\bnew\s+)?((?:{NAME}\s*(?:\(\s*\))?\s*(?:\?\.|\.|::)\s*)*)({NAME})[!?]?\s*(?:<[\w\s,<>\[\]]*>\s*)?\(", text):
        chain, name = m[1], m[2]
        if re.search(r"\b(?:function|func|fn|def)\s+$", text[max(0, m.start() - 12) : m.start()]):
            continue
        if chain:
            base = re.match(NAME, chain)[0]
            held = base in spaces or (capitals and language == "c_sharp" and bool(spaces) and base[0].isupper())
            ok = name == symbol and held and base not in foreign or (base in direct and name == symbol)
        else:
            ok = name in direct and name not in foreign and not local and not any(a <= m.start() < b for a, b in own)
        if ok:
            found.append((m.start(), _close(text, m.end() - 1)))
    to_bytes = lambda i: len(source[:i].encode())
    return [(to_bytes(a), to_bytes(b)) for a, b in found]


def find_calls(path: str, source: str, symbol: str, package: str | None = None, import_names: tuple[str, ...] = (), capitals: bool = False) -> list[dict]:
    """Call sites with 1-based lines, byte range and snippet, each range once."""
    dot = path.rfind(".")
    language = LANGUAGES.get(path[dot:].lower()) if dot >= 0 else None
    packages = tuple(dict.fromkeys(x for x in (package, *import_names) if x))
    name = bare_symbol(symbol, package)
    spans = python_calls(source, name, packages) if language == "python" else scanned_calls(source, language, name.split(".")[-1], packages, capitals) if language in ("typescript", "tsx", "javascript", "go", "rust", "java", "ruby", "c_sharp") else []
    data = source.encode()
    return [{"line_start": data[:a].count(b"\n") + 1, "line_end": data[:b].count(b"\n") + 1, "start_byte": a, "end_byte": b, "snippet": data[a:b].decode("utf-8", "replace")} for a, b in sorted(set(spans))]


def parses(path: str, source: str) -> bool | None:
    """Whether a file reads without errors: Python by its parser, others by balanced brackets, unknown ones null."""
    dot = path.rfind(".")
    language = LANGUAGES.get(path[dot:].lower()) if dot >= 0 else None
    if language == "python":
        try:
            ast.parse(source)
            return True
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
    if language not in ("typescript", "tsx", "javascript", "go", "rust", "java", "c_sharp", "c", "cpp"):
        return None
    stack, pairs = [], {")": "(", "]": "[", "}": "{"}
    for c in blanked(source):
        if c in "([{":
            stack.append(c)
        elif c in pairs and (not stack or stack.pop() != pairs[c]):
            return False
    return not stack


def call_sites(df: DataFrame, capitals: bool = False) -> DataFrame:
    """``df``: path, source, symbol, package, import_names.  One row per call site; ``capitals`` as for ``scanned_calls``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame(
                {"path": f.path, "symbol": f.symbol, "package": f.package, "found": [find_calls(p, s or "", y, k, tuple(n) if n is not None else (), capitals) for p, s, y, k, n in zip(f.path, f.source, f.symbol, f.package, f.import_names, strict=True)]}
            )

    found = df.select("path", "source", "symbol", "package", "import_names").mapInPandas(run, f"path string, symbol string, package string, found {TYPE}")
    return found.select("path", "symbol", "package", F.explode("found").alias("c")).select("path", "symbol", "package", "c.*")


def covered_by_tests(df: DataFrame) -> DataFrame:
    """(symbol, package, covered): whether some test file calls the symbol."""
    from .text import is_test_file

    hits = call_sites(df.where(is_test_file("path"))).select("symbol", "package").distinct().withColumn("hit", F.lit(True))
    asked = df.select("symbol", "package").distinct()
    return asked.join(hits, asked["symbol"].eqNullSafe(hits["symbol"]) & asked["package"].eqNullSafe(hits["package"]), "left").select(asked["symbol"], asked["package"], F.coalesce("hit", F.lit(False)).alias("covered"))
