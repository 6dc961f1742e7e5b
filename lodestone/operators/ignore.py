"""Ignore patterns: loading, matching one pattern, and pruning whole directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestone import config
from lodestone.functions import globs, text as tx
from lodestone.plans.sizing import lookup_join


def load_ignore(files: DataFrame) -> DataFrame:
    """(repo_name, pattern): lines of each root ignore file plus the patterns all share.

    `files` has `repo_name`, `rel_path` and decoded `text`.
    """
    lines = (
        files.where(F.col("rel_path") == config.IGNORE_FILE)
        .select("repo_name", F.explode(F.split(tx.fold_newlines(F.col("text")), "\n")).alias("line"))
        .select("repo_name", tx.strip(F.col("line")).alias("pattern"))
        .where((F.col("pattern") != "") & ~F.startswith("pattern", F.lit("#")))
    )
    shared = files.select("repo_name").distinct().select(
        "repo_name", F.explode(F.array(*map(F.lit, config.DEFAULT_IGNORE))).alias("pattern")
    )
    return lines.unionByName(shared).distinct()


def _bare(pattern: Column) -> Column:
    return F.regexp_replace(pattern, r"/+\z", "")


def _is_glob(pattern: Column) -> Column:
    return pattern.rlike(r"[*?]")


def _parts(path: Column) -> Column:
    return F.split(path, "/")


def ignore_literal(path: Column, pattern: Column) -> Column:
    """A pattern without wildcards equals the path or any one of its components."""
    return ~_is_glob(pattern) & ((path == pattern) | F.array_contains(_parts(path), pattern))


def ignore_glob(path: Column, pattern: Column, regex: Column) -> Column:
    """A wildcard pattern covers the whole path or any one component.

    `regex` is the pattern after `globs.glob_regex` and `globs.anchored`.
    """
    names = F.concat_ws(globs.NAME_SEPARATOR, path, _parts(path))
    return _is_glob(pattern) & F.rlike(names, regex)


def ignore_dir(path: Column, pattern: Column, regex: Column) -> Column:
    """A pattern ending in "/" covers all below that path, and whatever its bare form covers."""
    bare = _bare(pattern)
    below = F.startswith(path, F.concat(bare, F.lit("/"))) | (_parts(path)[0] == bare)
    return F.endswith(pattern, F.lit("/")) & (
        below | ignore_literal(path, bare) | ignore_glob(path, bare, regex)
    )


def with_regex(patterns: DataFrame) -> DataFrame:
    """Patterns with the regex of their bare form; NULL for those without wildcards."""
    bare = _bare(F.col("pattern"))
    wild = patterns.withColumn("_wild", F.when(_is_glob(bare), bare))
    return wild.withColumn("regex", globs.anchored(globs.glob_regex("_wild"))).drop("_wild")


def compile_rules(patterns: DataFrame) -> DataFrame:
    """One row per repository: names to compare and one regex for all wildcard patterns.

    A directory pattern needs no rule of its own here: whatever lies below it is cut off
    at the directory, which its bare form names.
    """
    bare = _bare(F.col("pattern"))
    wild = _is_glob(bare)
    split = patterns.select(
        "repo_name",
        F.when(~wild, bare).alias("literal"),
        globs.glob_regex(F.when(wild, bare)).alias("fragment"),
    )
    grouped = split.groupBy("repo_name").agg(
        F.array_sort(F.collect_set("literal")).alias("literals"),
        F.array_sort(F.collect_set("fragment")).alias("fragments"),
    )
    regex = F.when(F.size("fragments") > 0, globs.anchored(F.array_join("fragments", "|")))
    return grouped.select("repo_name", "literals", regex.alias("glob_regex"))


def ignore_status(path: Column, literals: Column, regex: Column) -> Column:
    """`pruned` below an ignored directory, `gitignore` when only the file itself matches, else NULL."""
    parts = _parts(path)
    depth = F.size(parts)
    dir_names = F.slice(parts, F.lit(1), depth - 1)
    prefix = lambda level: F.call_function("substring_index", path, F.lit("/"), level)
    dir_paths = F.when(
        depth > 1, F.transform(F.sequence(F.lit(1), F.greatest(depth - 1, F.lit(1))), prefix)
    ).otherwise(F.array().cast("array<string>"))

    def hit(names: Column) -> Column:
        # unlike rlike, this keeps a compiled pattern as long as the rows stay in one repository
        wild = F.coalesce(F.regexp_instr(F.array_join(names, globs.NAME_SEPARATOR), regex) > 0, F.lit(False))
        return F.coalesce(F.arrays_overlap(names, literals), F.lit(False)) | wild

    below = hit(F.concat(dir_names, dir_paths))
    itself = hit(F.array(F.element_at(parts, -1), path))
    return F.when((depth > 1) & below, F.lit("pruned")).when(itself, F.lit("gitignore"))


def with_ignore_status(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files plus `ignore_status`, looked up on their repository."""
    matched = lookup_join(files, rules, "repo_name", spread="rel_path", how="left")
    status = ignore_status(F.col("rel_path"), F.col("literals"), F.col("glob_regex"))
    return matched.withColumn("ignore_status", status).drop("literals", "glob_regex")


def pattern_matches(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """(repo_name, rel_path, pattern, kind) for each pattern that covers a path by itself.

    The patterns of a repository travel as one array, so only matches become rows.
    """
    path = F.col("rel_path")
    entry = F.struct("pattern", "regex")
    per_repo = with_regex(patterns).groupBy("repo_name").agg(F.collect_list(entry).alias("entries"))
    joined = lookup_join(files.select("repo_name", "rel_path"), per_repo, "repo_name", spread="rel_path")

    def kinds(e: Column) -> Column:
        pattern, regex = e["pattern"], e["regex"]
        kind = (
            F.when(ignore_dir(path, pattern, regex), F.lit("dir"))
            .when(ignore_literal(path, pattern), F.lit("literal"))
            .when(ignore_glob(path, pattern, regex), F.lit("glob"))
        )
        return F.struct(pattern.alias("pattern"), kind.alias("kind"))

    hits = F.filter(F.transform("entries", kinds), lambda h: h["kind"].isNotNull())
    return joined.select("repo_name", "rel_path", F.explode(hits).alias("hit")).select(
        "repo_name", "rel_path", "hit.pattern", "hit.kind"
    )
