"""Readers of saved registry answers, repository trees, commit lists and logs."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import iso_time

# Keys of a project's changelog link in order, and scan limits of the repair scan.
CHANGELOG_KEYS = ("Changelog", "Change Log", "Changes", "Release Notes", "History")
FALLBACK_KEYS = ("home_page", "project_url")
CUT_NOTICE = "\n\n… (truncated, file exceeds 1MB preview limit)"
PREVIEW_CHARS = 1_000_000
SCANNED = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py")
SCANNED_BYTES = 500_000
SNAPSHOT_BYTES = 150 << 20

# The public repositories that everybody sees.
BENCHMARKS = (
    ("next-js", "vercel/next.js", "canary", ["Rust", "TypeScript", "JavaScript"], 1420, ["react", "react-dom", "turbopack", "swc"]),
    ("openai-python", "openai/openai-python", "main", ["Python", "Pydantic", "Httpx"], 684, ["httpx", "pydantic", "typing-extensions"]),
    ("stripe-node", "stripe/stripe-node", "master", ["TypeScript", "JavaScript"], 312, ["node-fetch", "qs"]),
    ("fastapi", "fastapi/fastapi", "master", ["Python", "Starlette", "Pydantic"], 915, ["starlette", "pydantic", "uvicorn"]),
)


def _text(json, path: str) -> Column:
    """A JSON string that is not empty, else null."""
    return F.nullif(F.get_json_object(json, path), F.lit(""))


def npm_version(json: str) -> Column:
    """struct(version, published_at, url, notes) of the latest npm release, null without one; url and notes are that version's own."""
    version = _text(json, "$['dist-tags'].latest")
    times = F.from_json(F.get_json_object(json, "$.time"), "map<string,string>")
    own = F.try_element_at(F.from_json(F.get_json_object(json, "$.versions"), "map<string,string>"), version)
    url = F.coalesce(_text(own, "$.homepage"), _text(own, "$.repository.url"))
    return F.when(version.isNotNull(), F.struct(version.alias("version"), iso_time(F.try_element_at(times, version)).alias("published_at"), url.alias("url"), F.coalesce(_text(own, "$.release_notes"), _text(own, "$.changelog")).alias("notes")))


def pypi_version(json: str) -> Column:
    """struct(version, published_at, url, notes) of the latest PyPI release, null without one; the first file's upload time."""
    version = _text(json, "$.info.version")
    files = "array<struct<upload_time_iso_8601:string>>"
    listed = F.try_element_at(F.from_json(F.get_json_object(json, "$.releases"), f"map<string,{files}>"), version)
    listed = F.when(F.coalesce(F.size(listed), F.lit(0)) > 0, listed).otherwise(F.from_json(F.get_json_object(json, "$.urls"), files))
    links = F.from_json(F.get_json_object(json, "$.info.project_urls"), "map<string,string>")
    url = F.coalesce(*(F.nullif(F.try_element_at(links, F.lit(k)), F.lit("")) for k in CHANGELOG_KEYS), *(_text(json, f"$.info.{k}") for k in FALLBACK_KEYS))
    return F.when(version.isNotNull(), F.struct(version.alias("version"), iso_time(F.get(listed, F.lit(0))["upload_time_iso_8601"]).alias("published_at"), url.alias("url"), F.get_json_object(json, "$.info.description").alias("notes")))


def latest_versions(df: DataFrame) -> DataFrame:
    """``df``: name, ecosystem, json.  Unknown ecosystems give null."""
    kind = F.lower(F.trim("ecosystem"))
    return df.select("name", "ecosystem", F.when(kind == "npm", npm_version("json")).when(kind == "pypi", pypi_version("json")).alias("v")).select("name", "ecosystem", "v.*")


def all_versions(df: DataFrame) -> DataFrame:
    """Versions as listed, last first."""
    kind = F.lower(F.trim("ecosystem"))
    keys = lambda path: F.reverse(F.map_keys(F.from_json(F.get_json_object("json", path), "map<string,string>")))
    return df.select("name", F.when(kind == "npm", keys("$.versions")).when(kind == "pypi", keys("$.releases")).alias("versions"))


def tree(spark: SparkSession, path: str, repo_id: str) -> DataFrame:
    """Files below a folder as (repo_id, path, content), paths relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.rstrip("/")
    return files.where(F.col("length") <= SNAPSHOT_BYTES).select(F.lit(repo_id).alias("repo_id"), F.regexp_replace("path", f"^.*?{root}/", "").alias("path"), "content")


def unpacked(content: bytes) -> Iterator[tuple[str, bytes]]:
    """Regular files of a gzipped tar archive, without the one folder that holds all of them; names that leave the archive are skipped."""

    def parts(member: tarfile.TarInfo) -> tuple[str, ...]:
        return tuple(p for p in PurePosixPath(member.name).parts if p != ".")

    def safe(member: tarfile.TarInfo) -> bool:
        return not member.name.startswith("/") and ".." not in parts(member) and bool(parts(member))

    with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as archive:
        members = [m for m in archive.getmembers() if safe(m) and (m.isfile() or m.isdir())]
        wrapped = len({parts(m)[0] for m in members}) == 1 and all(m.isdir() or len(parts(m)) > 1 for m in members)
        for m in members:
            if m.isfile():
                yield "/".join(parts(m)[wrapped:]), archive.extractfile(m).read()


def archives(spark: SparkSession, path: str) -> DataFrame:
    """Files of the archives (.tar.gz) below a path: (archive, path, content, _error).  Those over 150 MB or unreadable give one row with an error."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tar.gz").load(path)
    named = listed.withColumn("archive", F.regexp_extract("path", r"([^/]*)\.tar\.gz$", 1))
    large = named.where(F.col("length") > SNAPSHOT_BYTES).select("archive", F.lit(None).cast("string").alias("path"), F.lit(None).cast("binary").alias("content"), F.lit("too large").alias("_error"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["archive", "path", "content", "_error"]
        for f in frames:
            for name, content in zip(f.archive, f.content, strict=True):
                try:
                    for file, data in unpacked(content):  # file by file, so one archive is never held twice
                        yield pd.DataFrame([(name, file, data, None)], columns=columns)
                except (tarfile.TarError, EOFError, OSError) as broken:
                    yield pd.DataFrame([(name, None, None, f"unreadable: {broken}")], columns=columns)

    small = named.where(F.col("length") <= SNAPSHOT_BYTES).select("archive", "content")
    return small.mapInPandas(run, "archive string, path string, content binary, _error string").union(large)


def timeline(events: DataFrame, start: Column) -> DataFrame:
    """A prepared run of events (offset_ms, ...) placed in time: ``at`` instead of the offset."""
    return events.withColumn("at", F.timestamp_add("MILLISECOND", F.col("offset_ms"), start)).drop("offset_ms")


def repair_scope(blobs: DataFrame) -> DataFrame:
    """Files of a repair scan: blobs with a scanned suffix (case counts), at most 500,000 bytes."""
    return blobs.where((F.col("type") == "blob") & F.regexp_extract("path", r"(\.[^./]+)$", 1).isin(*SCANNED) & (F.coalesce("size", F.lit(0)) <= SCANNED_BYTES))


def git_log(lines: DataFrame) -> DataFrame:
    """``value``: hash|author|email|time|message; further pipes belong to the message."""
    parts = F.split("value", r"\|", 5)
    return lines.where(F.size(parts) == 5).select(*(parts[i].alias(n) for i, n in enumerate(("sha", "author", "email", "at", "message"))))


def commits(df: DataFrame, *keep: str, limit: int | None = None) -> DataFrame:
    """``json``: one commit of an API's list; first message line only.  With ``limit`` the newest so many of each ``keep``."""
    if limit is not None:
        every = commits(df, *keep)
        place = F.row_number().over(Window.partitionBy(*keep).orderBy(F.desc_nulls_last("at"), "sha"))
        return every.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")
    return df.select(
        *keep, F.get_json_object("json", "$.sha").alias("sha"), F.get_json_object("json", "$.commit.author.name").alias("author"),
        iso_time(F.get_json_object("json", "$.commit.author.date")).alias("at"), F.split(F.get_json_object("json", "$.commit.message"), "\n")[0].alias("message"),
    )


def dependencies(package_json: str, requirements: str) -> Column:
    """First six names of package.json's dependencies, else of requirements.txt."""
    named = F.map_keys(F.from_json(F.get_json_object(package_json, "$.dependencies"), "map<string,string>"))
    lines = F.filter(F.transform(F.split(requirements, "\n"), lambda s: F.trim(F.regexp_replace(s, r"(==|>=).*$", ""))), lambda s: (s != "") & ~s.startswith("#"))
    return F.slice(F.coalesce(F.when(F.size(named) > 0, named), lines), 1, 6)


def preview(content: Column) -> Column:
    """A file's text for display: cut after 1,000,000 characters with a notice; null for binary content."""
    shown = F.when(F.length(content) > PREVIEW_CHARS, F.concat(F.substring(content, 1, PREVIEW_CHARS), F.lit(CUT_NOTICE))).otherwise(content)
    return F.when(~F.contains(content, F.lit("\x00")), shown)


def last_commits(changes: DataFrame) -> DataFrame:
    """``changes``: path, sha, at.  The newest commit of each path."""
    return changes.groupBy("path").agg(F.max_by("sha", F.struct("at", "sha")).alias("sha"), F.max("at").alias("at"))


def benchmark_repos(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BENCHMARKS, "id string, full_name string, default_branch string, languages array<string>, patch_count int, dependencies array<string>")


def languages(answer: str) -> Column:
    """The three languages of most code, from an answer that lists them in this order."""
    return F.slice(F.map_keys(F.from_json(answer, "map<string,long>")), 1, 3)
