"""Graph maintenance from pushes: changed files are parsed anew, and only what they touch is resolved anew.

That is the changed files, the files whose specifiers may mean an added path,
those that imported a removed one, and all of a repository whose path maps have
changed.  The same extraction and resolution as in a full build serve them, so
both give the same graph.

Which specifiers may mean a path is told by an inverted index of their names,
kept with the graph: a push probes it with the names of its added paths instead
of cutting up every specifier.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from ..functions import imports
from ..functions.text import dirname, normalized
from ..sources.scratch import written

# What an added path may end in after the part that a specifier names.
ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rs", "/index.ts", "/index.tsx", "/index.js")
# Names of files that stand for their folder.
FOLDER_FILES = ("index", "__init__", "mod", "lib", "main")
KEYS = ["repo_id", "path"]
NODE = ["repo_id", "path", "folder", "ext", "language", "is_binary", "size", "truncated", "content_hash"]
SPEC = ["repo_id", "path", "language", "spec", "is_dynamic", "is_internal"]
CONFIG = "element_at(split(path, '/'), -1) = 'tsconfig.json'"  # SQL; its content is kept, as the path maps are read from it


class Graph(NamedTuple):
    """Nodes with content hash, specifiers, edges, the index (repo_id, name, is_go, path) of the specifiers' names, and path maps."""

    nodes: DataFrame
    specs: DataFrame
    edges: DataFrame
    tokens: DataFrame
    maps: DataFrame

    @staticmethod
    def columns() -> dict[str, str]:
        """Columns of each table after repo_id, with their types."""
        return {
            "nodes": "path string, folder string, ext string, language string, is_binary boolean, size int, truncated boolean, content_hash string",
            "specs": "path string, language string, spec string, is_dynamic boolean, is_internal boolean",
            "edges": "source_path string, target_path string",
            "tokens": "name string, is_go boolean, path string",
            "maps": "config_dir string, prefix string, target string, place int",
        }


def importers_of_added(specs: DataFrame, added: DataFrame) -> DataFrame:
    """(repo_id, path) of the files whose specifiers may mean one of the added paths.

    A relative specifier means one path, any other one every path that ends in it
    at a slash; endings may be left out.  Both sides meet in an equi-join: each
    added path brings the names that would mean it.
    """
    whole = F.concat(F.array("path"), F.transform(F.filter(F.array(*map(F.lit, ENDINGS)), lambda e: F.endswith(F.col("path"), e)), lambda e: F.substring(F.col("path"), F.lit(1), F.length("path") - F.length(e))))
    tails = lambda p: F.transform(F.sequence(F.lit(1), F.size(F.split(p, "/"))), lambda n: F.array_join(F.slice(F.split(p, "/"), n, F.size(F.split(p, "/"))), "/"))
    names = added.select("repo_id", F.explode(whole).alias("whole"))
    names = names.select("repo_id", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("relative"), F.col("whole").alias("name"))), F.transform(tails(F.col("whole")), lambda t: F.struct(F.lit(False).alias("relative"), t.alias("name"))))).alias("n")).select("repo_id", "n.*").distinct()
    clean = specs.withColumn("_clean", F.regexp_replace("spec", "^[<>\"']+|[<>\"']+$", "")).where("_clean <> ''").withColumn("relative", F.col("_clean").startswith("."))
    clean = clean.withColumn("_joined", F.concat_ws("/", dirname("path"), "_clean"))
    name = F.when(F.col("relative"), normalized("_joined")).otherwise(F.regexp_replace(F.replace("_clean", F.lit("@/"), F.lit("")), "^/+", ""))
    return clean.select("repo_id", "path", "relative", name.alias("name")).join(names, ["repo_id", "relative", "name"], "left_semi").select("repo_id", "path").distinct()


def tokens_of(parsed: DataFrame) -> DataFrame:
    """(repo_id, name, is_go, path): the names by which the specifiers of a parsed file may mean a path, each once.

    These are the last two names of a specifier, with and without suffix, and ''
    for one of dots alone.  Go's specifiers are looked for inside paths, so they
    are names as they stand.  A file's names are made distinct where it is read.
    """

    def names(spec):
        clean = F.regexp_replace(spec, "^[<>\"']+|[<>\"']+$", "")
        last = F.element_at(F.split(clean, "/"), -1)
        words = F.filter(F.split(clean, r"[/.:\\\\]+"), lambda w: w != "")
        none = F.array().cast("array<string>")
        return F.concat(F.array(last, F.regexp_replace(last, r"\.[^.]*$", "")), F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), 2), F.when(F.size(words) == 0, F.array(F.lit(""))).otherwise(none))

    named = lambda found, go: F.transform(F.array_distinct(found), lambda n: F.struct(n.alias("name"), F.lit(go).alias("is_go")))
    plain = named(F.flatten(F.transform("specs", lambda s: names(s["spec"]))), False)
    whole = F.when(F.col("language") == "go", named(F.transform("specs", lambda s: s["spec"]), True)).otherwise(F.array().cast("array<struct<name:string,is_go:boolean>>"))
    return parsed.select(*KEYS, F.explode(F.concat(plain, whole)).alias("n")).select("repo_id", "n.name", "n.is_go", "path")


def specs_of(parsed: DataFrame) -> DataFrame:
    return parsed.select(*KEYS, "language", F.explode("specs").alias("s")).select(*KEYS, "language", "s.*")


def full_build(tree: DataFrame) -> Graph:
    """``tree``: repo_id, path, content.  Every file is read and parsed once, into a table that the rest is made of."""
    kept = imports.files(tree).withColumn("content_hash", F.sha2("content", 256))
    read = written(imports.parsed(kept, (*NODE, "content")).withColumn("content", F.expr(f"if({CONFIG}, content, null)")), "parsed")
    specs, maps = specs_of(read), imports.aliases(read)
    edges, _ = imports.resolved(read, specs, maps)
    return Graph(read.select(*NODE), specs, edges, tokens_of(read), maps)


def may_import(tokens: DataFrame, added: DataFrame, go: bool = True) -> DataFrame:
    """(repo_id, path) of all files that could resolve a specifier to an added path, and of some that cannot.

    A specifier resolves to a path only if one of its last two names is the
    path's file name, with or without suffix, or its folder's; one of dots alone
    only to a file that stands for its folder.
    """
    segments = F.split("path", "/")
    file, folder = F.element_at(segments, -1), F.when(F.size(segments) > 1, F.element_at(segments, -2))
    stem = F.regexp_replace(file, r"\..*$", "")
    names = F.array_compact(F.array_distinct(F.array(file, stem, F.regexp_replace(file, r"\.[^.]*$", ""), folder, F.when(stem.isin(*FOLDER_FILES), F.lit("")))))
    asked = added.select("repo_id", F.explode(names).alias("name"), F.lit(False).alias("is_go"))
    if go:
        whole = tokens.where("is_go").select("repo_id", F.col("name").alias("text")).distinct()
        paths = added.where(F.endswith("path", F.lit(".go"))).select("repo_id", F.col("path").alias("target_path"))
        asked = asked.union(imports.substrings(paths, whole).select("repo_id", "text", F.lit(True)))
    return tokens.join(asked.distinct(), ["repo_id", "name", "is_go"], "left_semi").select(*KEYS).distinct()


class Increment(NamedTuple):
    """The graph after a push, the tables of it that the push may have changed, and the keys of the files touched and of the others resolved anew."""

    graph: Graph
    changed: tuple[str, ...]
    touched: DataFrame
    again: DataFrame


def incremental(graph: Graph, tree: DataFrame, removed: DataFrame) -> Increment:
    """The graph after a push.  ``tree``: added and modified files; ``removed``: (repo_id, path); ``graph`` may be the touched repositories' part.

    Files whose hash has not changed count as not pushed.  All other edges stay
    as they are.  The pushed files are parsed into a table first; what kinds of
    change it holds decides which joins are made.
    """
    fresh = imports.files(tree).withColumn("content_hash", F.sha2("content", 256))
    known = graph.nodes.select(*KEYS, F.col("content_hash").alias("_old"))
    changed = fresh.join(known, KEYS, "left").where(~F.col("_old").eqNullSafe(F.col("content_hash")))
    read = imports.parsed(changed.withColumn("is_new", F.col("_old").isNull()), (*NODE, "content", "is_new"))
    parsed = written(read.withColumn("content", F.expr(f"if({CONFIG}, content, null)")), "pushed")
    gone = written(removed.select(*KEYS).distinct(), "removed")
    shape = parsed.select("is_new", "language", F.expr(CONFIG).alias("config")).unionByName(gone.select(F.lit(False).alias("is_new"), F.lit(None).cast("string").alias("language"), F.expr(CONFIG).alias("config")))
    shape = shape.agg(F.bool_or("is_new").alias("added"), F.bool_or("config").alias("remapped"), F.bool_or(F.col("language") == "go").alias("go")).first()

    touched = parsed.select(*KEYS).union(gone).distinct()
    own = specs_of(parsed)
    nodes = graph.nodes.join(touched, KEYS, "left_anti").unionByName(parsed.select(*NODE))
    kept, kept_tokens, maps = graph.specs.join(touched, KEYS, "left_anti"), graph.tokens.join(touched, KEYS, "left_anti").select(*graph.tokens.columns), graph.maps
    again = graph.edges.join(gone.withColumnRenamed("path", "target_path"), ["repo_id", "target_path"], "left_semi").select("repo_id", F.col("source_path").alias("path"))
    if shape.added:
        again = again.union(may_import(graph.tokens, parsed.where("is_new"), bool(shape.go)))
    if shape.remapped:
        configs = touched.where(CONFIG).select("repo_id", dirname("path").alias("config_dir"))
        maps = maps.join(configs, ["repo_id", "config_dir"], "left_anti").select(*maps.columns).unionByName(imports.aliases(parsed))
        again = again.union(kept.join(configs, "repo_id", "left_semi").select(*KEYS))
    again = again.join(touched, KEYS, "left_anti").distinct()
    specs = written(kept.join(again, KEYS, "left_semi").unionByName(own).select(*SPEC), "resolved-anew")
    kinds = specs.agg(F.bool_or(F.col("language") == "go").alias("go"), F.bool_or(F.col("language").isin("typescript", "tsx", "javascript") & ~F.col("spec").startswith(".")).alias("bare")).first()
    edges, _ = imports.resolved(nodes, specs, maps if kinds.bare else None, go=bool(kinds.go))
    stale = touched.union(again).select("repo_id", F.col("path").alias("source_path")).distinct()
    after = Graph(nodes, kept.unionByName(own), graph.edges.join(stale, ["repo_id", "source_path"], "left_anti").unionByName(edges.select(*graph.edges.columns)), kept_tokens.unionByName(tokens_of(parsed)), maps)
    return Increment(after, Graph._fields if shape.remapped else tuple(n for n in Graph._fields if n != "maps"), touched, again)


def reparse_order(added: DataFrame, modified: DataFrame, importers: DataFrame) -> DataFrame:
    """(repo_id, path, place): added, then modified, then importing files, each once at its first place."""
    rows = [files.select(*KEYS, F.lit(place).alias("place")) for place, files in enumerate((added, modified, importers), 1)]
    return rows[0].union(rows[1]).union(rows[2]).groupBy(*KEYS).agg(F.min("place").alias("place"))
