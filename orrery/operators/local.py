"""Checks of a working copy: which files count, call site reports, verification receipts, release texts.

Reports are rows, not one text, so a folder with any number of call sites is
written as it is; the status carries the count and the exit code.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import callsites
from ..functions.text import extension

# Suffixes and left-out folders of the scan and of the verification, and messages.
SCAN_SUFFIXES = (".ts", ".mts", ".cts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".rs", ".java", ".rb", ".cs")
SCAN_LEFT_OUT = ("node_modules", "venv", "env", "__pycache__", "dist", "build", "out")
VERIFY_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py")
VERIFY_LEFT_OUT = ("node_modules", "venv", "__pycache__")
NO_ANSWER = {"npm": "Failed to fetch npm metadata for package '{}'", "pypi": "Failed to fetch PyPI metadata for package '{}' at version '{}'"}
NO_VERSION = "Version '{1}' not found in npm versions for package '{0}'"
NO_README = "No usable README text available for {0} ({1}) in npm packument"
NO_TEXT = "No changelog or release text available for {0} ({2} -> {1})"


def in_scope(path: str, suffixes: tuple[str, ...], left_out: tuple[str, ...]) -> Column:
    """Whether a file has one of the suffixes (in any case) and lies in no folder that is left out or begins with a dot."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return extension(path).isin(*suffixes) & ~F.exists(folders, lambda f: f.startswith(".") | f.isin(*left_out))


def scan(files: DataFrame, symbol: str, package: str | None = None) -> DataFrame:
    """``files``: path, source.  Call sites of a symbol in the files that count."""
    asked = files.where(in_scope("path", SCAN_SUFFIXES, SCAN_LEFT_OUT)).select("path", "source", F.lit(symbol).alias("symbol"), F.lit(package).cast("string").alias("package"), F.lit(None).cast("array<string>").alias("import_names"))
    return callsites.call_sites(asked)


def scan_status(found: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """Of each key asked for: number of call sites and exit code, 0 if there are any, else 1."""
    counts = found.groupBy(key).agg(F.count("*").alias("found"))
    return asked.select(key).distinct().join(counts, key, "left").select(key, F.coalesce("found", F.lit(0)).alias("found"), F.when(F.col("found") > 0, 0).otherwise(1).alias("exit_code"))


def scan_lines(found: DataFrame, key: str) -> DataFrame:
    """The numbered lines of a report, by path and position: (key, n, line)."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("path", "start_byte", "end_byte"))
    line = F.concat(F.lit("  "), F.col("n").cast("string"), F.lit(". "), F.col("path"), F.lit(":"), F.col("line_start").cast("string"), F.lit(": "), F.trim("snippet"))
    return found.withColumn("n", n).select(key, "n", line.alias("line"))


def parse_verdicts(files: DataFrame, key: str) -> DataFrame:
    """``files``: key, path, source.  Adds ``parses`` to the files that a verification reads."""
    kind = files.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f[key], "path": f.path, "parses": [callsites.parses(p, s or "") is not False for p, s in zip(f.path, f.source, strict=True)]})

    return files.where(in_scope("path", VERIFY_SUFFIXES, VERIFY_LEFT_OUT)).select(key, "path", "source").mapInPandas(run, f"{key} {kind}, path string, parses boolean")


def receipts(files: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """Verification of each key of ``outcomes`` (key, types, tests; null where not run): all files parse and neither outcome is false.

    The files with errors stay with :func:`parse_verdicts`; a receipt has the
    first in path order.
    """
    checked = parse_verdicts(files, key).groupBy(key).agg(F.count("*").alias("files_checked"), F.count_if(~F.col("parses")).alias("parse_errors"), F.min(F.when(~F.col("parses"), F.col("path"))).alias("first_error"))
    rows = outcomes.select(key, "types", "tests").join(checked, key, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("files_checked", "parse_errors")})
    passed = (F.col("parse_errors") == 0) & F.coalesce("types", F.lit(True)) & F.coalesce("tests", F.lit(True))
    return rows.select(key, "files_checked", "parse_errors", "first_error", "types", "tests", passed.alias("all_passed"), F.when(passed, 0).otherwise(1).alias("exit_code"))


def _message(template: str, *values: Column) -> Column:
    return F.format_string(template.replace("{}", "%s").replace("{0}", "%1$s").replace("{1}", "%2$s").replace("{2}", "%3$s"), *values)


def release_texts(df: DataFrame) -> DataFrame:
    """The text from which a release's changes are read, or why there is none.

    ``df``: name, ecosystem, old_version, version, json (the registry's answer;
    on PyPI that of the release), changelog.  A changelog comes first.  Adds
    ``notes`` and ``_error``, of which one is null.
    """
    given = F.nullif(F.col("changelog"), F.lit(""))
    fields = F.from_json("json", "map<string,string>")
    empty = F.coalesce(F.size(fields), F.lit(0)) == 0
    known = F.map_contains_key(F.coalesce(F.from_json(F.get_json_object("json", "$.versions"), "map<string,string>"), F.create_map().cast("map<string,string>")), F.col("version"))
    readme, description = F.get_json_object("json", "$.readme"), F.nullif(F.get_json_object("json", "$.info.description"), F.lit(""))
    npm, pypi = F.col("ecosystem") == "npm", F.col("ecosystem") == "pypi"
    values = [F.col("name"), F.col("version"), F.col("old_version")]
    usable = F.coalesce(readme.rlike(r"\S"), F.lit(False))
    error = (
        F.when(given.isNotNull(), None)
        .when(npm & empty, _message(NO_ANSWER["npm"], *values))
        .when(npm & ~known, _message(NO_VERSION, *values))
        .when(npm & ~usable, _message(NO_README, *values))
        .when(pypi & empty, _message(NO_ANSWER["pypi"], *values))
        .when(~npm & (~pypi | description.isNull()), _message(NO_TEXT, *values))
    )
    rows = df.withColumn("_error", error)
    return rows.withColumn("notes", F.when(F.col("_error").isNull(), F.coalesce(given, F.when(npm, readme).otherwise(description))))


def directory_verdicts(files: DataFrame, key: str) -> DataFrame:
    """``files``: key, path, ok.  Files checked, errors, the failed paths in order, and the share that passed in percent."""
    bad = ~F.col("ok")
    failed = F.array_join(F.sort_array(F.collect_list(F.when(bad, F.col("path")))), ",")
    return files.groupBy(key).agg(F.count("*").alias("files_checked"), F.count_if(bad).alias("errors"), failed.alias("failed"), F.bround(F.lit(100.0) * F.count_if("ok") / F.count("*"), 1).alias("pass_rate"))


def scan_documents(found: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """The JSON form of a scan of each key: count and usages in order."""
    usage = F.struct(F.col("path").alias("file_path"), "line_start", "start_byte", "end_byte", "snippet")
    every = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("path", "start_byte", "end_byte", usage.alias("usage")))).alias("rows"))
    usages = F.coalesce(F.transform("rows", lambda r: r["usage"]), F.array().cast("array<struct<file_path:string,line_start:int,start_byte:int,end_byte:int,snippet:string>>"))
    return asked.select(key).distinct().join(every, key, "left").select(key, F.to_json(F.struct(F.size(usages).alias("count"), usages.alias("usages"))).alias("json"))


def analysis_lines(requests: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Report of an analysis of each key: (key, exit_code, text).

    ``requests``: key, package, old_version, version, changelog, named.  One that names
    a changelog which is not there (null) ends with code 2.  ``changes`` has key,
    position and the columns of changelog changes.
    """
    number, symbol = F.row_number().over(Window.partitionBy(key).orderBy("position")), F.concat(F.col("symbol"), F.coalesce(F.concat(F.lit(" -> "), F.nullif("symbol_new", F.lit(""))), F.lit("")))
    line = F.concat(F.lit("  "), F.col("n").cast("string"), F.lit(". ["), F.upper("change_type"), F.lit("] "), symbol, F.lit(" (confidence: "), F.bround(F.col("confidence") * 100, 0).cast("int").cast("string"), F.lit("%)\n     "), F.col("description"))
    listed = changes.withColumn("n", number).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("n", line.alias("line")))).alias("rows"))
    head = F.concat(F.lit("Breaking change analysis for "), F.col("package"), F.lit(" ("), F.col("old_version"), F.lit(" -> "), F.col("version"), F.lit("):"))
    body = F.coalesce(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("  No breaking changes detected."))
    missing = F.col("named").isNotNull() & F.col("changelog").isNull()
    text = F.when(missing, F.concat(F.lit("Error: changelog file not found: "), F.col("named"))).otherwise(F.concat_ws("\n", head, body))
    return requests.join(listed, key, "left").select(key, F.when(missing, 2).otherwise(0).alias("exit_code"), text.alias("text"))
