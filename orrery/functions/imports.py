"""Import specifiers: extraction per file, candidates per specifier, resolution by joins."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .text import dirname, extension, normalized

# Languages by extension, binary extensions, pruned directories, tried suffixes, limits.
LANGUAGES = {
    ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript", ".py": "python", ".go": "go",
    ".rs": "rust", ".java": "java", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".rb": "ruby", ".php": "php", ".cs": "c_sharp", ".sh": "bash", ".bash": "bash",
    ".html": "html", ".css": "css", ".json": "json", ".yaml": "yaml", ".yml": "yaml",
}
BINARY = (
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".ico", ".bmp", ".mp4", ".mov", ".webm", ".avi", ".mp3", ".wav", ".ogg", ".pdf", ".zip", ".tar", ".gz", ".woff", ".woff2", ".ttf", ".otf", ".pyc",
    ".so", ".dylib", ".dll", ".wasm", ".db", ".sqlite",
)
PRUNED = ("node_modules", ".git", ".next", "dist", "build", "__pycache__", ".venv", "venv", ".turbo", ".vercel", "coverage", ".pytest_cache", ".mypy_cache", "target", ".terraform")
JS_SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
PY_SUFFIXES = ("", ".py", "/__init__.py")
DOTTED_SUFFIXES = ("", ".go", ".rs", ".java", ".c", ".h", ".cpp", ".hpp", ".rb", ".php")
PLAIN_SUFFIXES = ("", ".c", ".h", ".cpp", ".hpp", ".rb", ".php")
CRATE_SUFFIXES = (".rs", "/mod.rs")
SUFFIXES = {"js": JS_SUFFIXES, "python": PY_SUFFIXES, "dotted": DOTTED_SUFFIXES, "crate": CRATE_SUFFIXES, "plain": PLAIN_SUFFIXES}
PARSED_BYTES = 2_000_000
FILE_LIMIT = 6000

STRINGS = re.compile(r"""//[^\n]*|/\*.*?\*/|(?P<t>`(?:\\.|[^`\\])*`)|(?P<s>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')""", re.S)
JS_IMPORT = re.compile(r"""(?:\bimport\s+(?:type\s+)?(?:[\w*{}\s,$]+?\s+from\s+)?|\bexport\s+(?:type\s+)?[\w*{}\s,$]+?\s+from\s+|\brequire\s*\(\s*)(["'])(?P<spec>[^"'\n]+)\1""")
JS_DYNAMIC = re.compile(r"""\bimport\s*\(\s*(?:(["'])(?P<spec>[^"'\n]+)\1\s*[,)]|(?P<other>[^)]*)\))""")
LINES = {
    "go": re.compile(r'(?:^\s*import\s+(?:[\w.]+\s+)?|^\s+(?:[\w.]+\s+)?)"([^"\n]+)"', re.M),
    "rust": re.compile(r"^\s*(?:pub\s+)?use\s+([^;]+);", re.M),
    "java": re.compile(r"^\s*import\s+(?:static\s+)?([\w.]+)(?:\.\*)?\s*;", re.M),
    "c": re.compile(r'^\s*#\s*include\s+("[^"\n]+"|<[^>\n]+>)', re.M),
    "ruby": re.compile(r"""^\s*require(?:_relative)?\s*\(?\s*["']([^"'\n]+)["']""", re.M),
    "php": re.compile(r"""\b(?:include|include_once|require|require_once)\s*\(?\s*["']([^"'\n]+)["']"""),
}
LINES["cpp"] = LINES["c"]


def without_comments(source: str) -> str:
    """JavaScript-like source with comments blanked, positions kept; strings stay."""
    return STRINGS.sub(lambda m: m[0] if m["s"] or m["t"] else re.sub(r"[^\n]", " ", m[0]), source)


def python_imports(source: str) -> list[str]:
    """Module names of import statements; relative ones keep their dots.  Broken source has none."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    found = []
    for node in ast.walk(tree):
        if isinstance(node, ast.ImportFrom):
            found.append((node.lineno, node.col_offset, "." * node.level + (node.module or "")))
        elif isinstance(node, ast.Import):
            found += [(node.lineno, node.col_offset, a.name) for a in node.names]
    return [x[2] for x in sorted(found)]


def specifiers(source: str, language: str) -> list[tuple[str, bool]]:
    """(specifier, dynamic): dynamic ones cannot be told from the text."""
    if language == "python":
        return [(s, False) for s in python_imports(source)]
    if language in ("typescript", "tsx", "javascript"):
        text = without_comments(source)
        found = [(m.start(), m["spec"], False) for m in JS_IMPORT.finditer(text)]
        found += [(m.start(), m["spec"] or m["other"].strip(), m["spec"] is None) for m in JS_DYNAMIC.finditer(text)]
        return [(s, d) for _, s, d in sorted(found)]
    if language == "go":
        blocks = re.findall(r'^\s*import\s+(?:[\w.]+\s+)?"([^"\n]+)"', source, re.M)
        for block in re.findall(r"^\s*import\s*\((.*?)\)", source, re.M | re.S):
            blocks += re.findall(r'"([^"\n]+)"', block)
        return [(s, False) for s in blocks]
    return [(s.strip().strip("'\""), False) for s in LINES[language].findall(source)] if language in LINES else []


def looks_internal(spec: str, language: str) -> bool:
    if language == "python":
        return spec.startswith(".")
    if language == "rust":
        return spec.startswith(("crate::", "super::"))
    if language in ("c", "cpp"):
        return not spec.startswith("<")
    return spec.startswith((".", "@/", "~/"))


def language_of(path) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair)), extension(path))


def files(df: DataFrame, limit: int = FILE_LIMIT) -> DataFrame:
    """``df``: repo_id, path, content (binary).  The kept files as nodes, at most ``limit`` per repository in path order, with ``truncated``."""
    kept = df.where(~F.arrays_overlap(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), F.array(*map(F.lit, PRUNED))))
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy("path"))
    total = F.count("*").over(Window.partitionBy("repo_id"))
    ranked = kept.withColumn("_place", place).withColumn("truncated", total > limit).where(F.col("_place") <= limit).drop("_place")
    ext = extension("path")
    return ranked.select("repo_id", "path", "content", dirname("path").alias("folder"), ext.alias("ext"), language_of("path").alias("language"), ext.isin(*BINARY).alias("is_binary"), F.length("content").alias("size"), "truncated")


def parsed(nodes: DataFrame, keep: tuple[str, ...] = ("repo_id", "path", "language")) -> DataFrame:
    """The kept columns of all ``nodes`` with ``specs``: each specifier of a file once, in order; none for files that are not parsed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            specs = []
            for content, language in zip(f["_read"], f["_language"], strict=True):
                found = specifiers(bytes(content).decode("utf-8", "replace"), language) if content is not None else []
                specs.append([{"spec": s, "is_dynamic": d, "is_internal": looks_internal(s, language)} for s, d in dict.fromkeys(found)])
            yield f[list(keep)].assign(specs=specs)

    reads = F.col("language").isNotNull() & ~F.col("is_binary") & (F.col("size") <= PARSED_BYTES)
    rows = nodes.select(*keep, F.col("language").alias("_language"), F.when(reads, F.coalesce("content", F.lit(b""))).alias("_read"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    return rows.mapInPandas(run, types + ", specs array<struct<spec:string,is_dynamic:boolean,is_internal:boolean>>")


def extracted(nodes: DataFrame) -> DataFrame:
    """(repo_id, path, language, spec, is_dynamic, is_internal), each specifier of a file once."""
    return parsed(nodes).select("repo_id", "path", "language", F.explode("specs").alias("s")).select("repo_id", "path", "language", "s.*")


def aliases(nodes: DataFrame) -> DataFrame:
    """(repo_id, config_dir, prefix, target, place) of the path maps in tsconfig.json files; whole-line comments are dropped."""
    text = F.array_join(F.filter(F.split(F.decode("content", "UTF-8"), "\n"), lambda s: ~F.trim(s).startswith("//")), "\n")
    configs = nodes.where(F.element_at(F.split("path", "/"), -1) == "tsconfig.json").select("repo_id", F.col("folder").alias("config_dir"), text.alias("json"))
    configs = configs.select("repo_id", "config_dir", F.coalesce(F.get_json_object("json", "$.compilerOptions.baseUrl"), F.lit(".")).alias("base"), F.from_json(F.get_json_object("json", "$.compilerOptions.paths"), "map<string,array<string>>").alias("paths"))
    each = configs.select("repo_id", "config_dir", "base", F.posexplode("paths").alias("place", "pattern", "targets")).where(F.size("targets") > 0)
    joined = each.withColumn("_whole", F.concat_ws("/", "config_dir", "base", F.regexp_replace(F.col("targets")[0], r"[/*]+$", "")))
    return joined.select("repo_id", "config_dir", F.regexp_replace("pattern", r"[/*]+$", "").alias("prefix"), normalized("_whole").alias("target"), "place")


def bases(specs: DataFrame, maps: DataFrame | None) -> DataFrame:
    """(repo_id, path, spec, kind, place, base): what a specifier may mean but for a suffix of its kind; the least place comes first, there the suffixes in their order."""
    js, generic = F.col("language").isin("typescript", "tsx", "javascript"), F.col("language").isin("rust", "java", "c", "cpp", "ruby", "php", "go")
    specs = specs.withColumn("folder", dirname("path")).withColumn("clean", F.regexp_replace("spec", "^[<\"']+|[>\"']+$", ""))
    specs = specs.withColumn("_joined", F.concat_ws("/", "folder", "clean")).withColumn("beside", normalized("_joined"))
    dots = F.length(F.regexp_extract("spec", r"^\.*", 0))
    up = F.concat_ws("/", "folder", F.array_join(F.array_repeat(F.lit(".."), dots - 1), "/"), F.translate(F.regexp_replace("spec", r"^\.+", ""), ".", "/"))
    specs = specs.withColumn("_up", F.when(dots > 0, up)).withColumn("above", normalized("_up"))
    tries = lambda kind, *bases: F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("place"), F.expr(base).alias("base")) for i, base in enumerate(bases)))
    relative = F.col("clean").startswith(".")
    crate = "replace(translate(regexp_replace(clean, '^crate::', ''), ':', '/'), '//', '/')"
    ways = (
        F.when(js & relative, tries("js", "beside"))
        .when((F.col("language") == "python") & (dots > 0), tries("python", "above"))
        .when(F.col("language") == "python", tries("python", "translate(spec, '.', '/')"))
        .when(generic & relative, tries("dotted", "beside"))
        .when((F.col("language") == "rust") & F.col("clean").startswith("crate::"), tries("crate", f"concat('src/', {crate})", crate))
        .when(F.col("language").isin("c", "cpp", "ruby", "php"), tries("plain", "beside"))
    )
    keys = ["repo_id", "path", "spec"]
    direct = specs.select(*keys, F.explode(ways).alias("w")).select(*keys, "w.*")
    if maps is None:
        return direct
    # The nearest tsconfig above the file, then its aliases in order; a repository's maps, from at most as many files as are kept, meet its specifiers in one row.
    tables = maps.groupBy("repo_id").agg(F.collect_list(F.struct("config_dir", "prefix", "target", "place")).alias("_maps"))
    near = specs.where(js & ~relative).select(*keys, "folder").join(tables, "repo_id")
    near = near.withColumn("_maps", F.expr("filter(_maps, m -> m.config_dir = '' or folder = m.config_dir or startswith(folder, concat(m.config_dir, '/')))"))
    near = near.withColumn("_depth", F.expr("array_max(transform(_maps, m -> length(m.config_dir)))"))
    mapped = near.select(*keys, F.explode(F.expr("filter(_maps, m -> length(m.config_dir) = _depth and (spec = m.prefix or startswith(spec, concat(m.prefix, '/'))))")).alias("m")).select(*keys, "m.*")
    rest = F.regexp_replace(F.expr("substring(spec, length(prefix) + 1)"), "^/+", "")
    mapped = mapped.withColumn("_whole", F.concat_ws("/", "target", rest)).withColumn("base", normalized("_whole"))
    return direct.union(mapped.select(*keys, F.lit("js"), "place", "base"))


def stems(known: DataFrame) -> DataFrame:
    """(repo_id, base, ends): the paths (repo_id, target_path) without each suffix that they end in; ``ends`` has the suffixes by which a base is a path."""
    every = F.array(*(F.lit(s) for s in sorted(set().union(*SUFFIXES.values()))))
    cut = known.select("repo_id", "target_path", F.explode(F.filter(every, lambda s: F.endswith(F.col("target_path"), s))).alias("suffix"))
    return cut.groupBy("repo_id", F.expr("substring(target_path, 1, length(target_path) - length(suffix))").alias("base")).agg(F.collect_set("suffix").alias("ends"))


def direct_hits(specs: DataFrame, maps: DataFrame | None, known: DataFrame) -> DataFrame:
    """(repo_id, path, spec, target_path): the first path that a specifier means.  The paths bring their suffixes, so a specifier is one row for each base."""
    suffixes = None
    for kind, tried in SUFFIXES.items():
        hit = F.col("kind") == kind
        suffixes = (F if suffixes is None else suffixes).when(hit, F.array(*map(F.lit, tried)))
    found = bases(specs, maps).join(stems(known), ["repo_id", "base"]).withColumn("suffix", F.get(F.filter(suffixes, lambda s: F.array_contains("ends", s)), F.lit(0)))
    return found.where("suffix is not null").groupBy("repo_id", "path", "spec").agg(F.min_by(F.concat("base", "suffix"), "place").alias("target_path"))


def substrings(paths: DataFrame, texts: DataFrame) -> DataFrame:
    """``paths`` (repo_id, target_path) with every part ``text`` of a path that is as long as one of its repository's ``texts`` (repo_id, text).

    So a search inside paths becomes a join on equality.  The rows are at most a
    path's length for each length that occurs, and lengths are no more than
    paths are long.
    """
    lengths = texts.groupBy("repo_id").agg(F.collect_set(F.length("text")).alias("_lengths"))
    sized = paths.join(lengths, "repo_id").select("repo_id", "target_path", F.explode(F.filter("_lengths", lambda n: n <= F.length("target_path"))).alias("_n"))
    placed = sized.select("repo_id", "target_path", "_n", F.explode(F.sequence(F.lit(1), F.length("target_path") - F.col("_n") + 1)).alias("_at"))
    return placed.select("repo_id", "target_path", F.substring("target_path", F.col("_at"), F.col("_n")).alias("text"))


def inside_paths(specs: DataFrame, known: DataFrame) -> DataFrame:
    """(repo_id, path, spec, target_path) of Go's imports: the first path of the repository that holds the specifier and ends in ``.go``."""
    go = specs.where((F.col("language") == "go") & ~F.col("spec").startswith(".")).select("repo_id", "path", "spec")
    asked = go.select("repo_id", F.col("spec").alias("text")).distinct()
    # One row per text before the join: neither a common specifier nor a common part of paths makes pairs.
    first = substrings(known.where(F.col("target_path").endswith(".go")), asked).groupBy("repo_id", "text").agg(F.min("target_path").alias("target_path"))
    return go.join(first.withColumnRenamed("text", "spec"), ["repo_id", "spec"]).select("repo_id", "path", "spec", "target_path")


def resolved(nodes: DataFrame, specs: DataFrame, maps: DataFrame | None, go: bool = True) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved): equi-joins of specifiers and node paths.

    A caller who knows that there are no path maps, or no Go files, says so and
    spares their joins.
    """
    known = nodes.select("repo_id", F.col("path").alias("target_path"))
    hits = direct_hits(specs.where("not is_dynamic"), maps, known)
    hits = hits.union(inside_paths(specs, known)) if go else hits
    edges = hits.where("target_path <> path").select("repo_id", F.col("path").alias("source_path"), "target_path").distinct()
    missing = specs.where("is_internal or is_dynamic").join(hits.select("repo_id", "path", "spec"), ["repo_id", "path", "spec"], "left_anti").select("repo_id", "path", "spec")
    return edges, missing
