"""Ignore patterns: quirks by hand, and random paths against a plain model."""

import fnmatch
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import globs
from lodestone.operators import ignore

QUIRKS = [
    ("!x.py", "x.py", False),
    ("/src", "src/a", False),
    ("[ab].py", "a.py", False),
    ("[ab]*.py", "a.py", True),
    ("**/foo", "foo", False),
    ("**/foo", "a/foo", True),
    ("*.PY", "a.py", False),
    ("*/", "anything", True),
    ("/", "a", False),
    ("build/", "build", True),
    ("build/", "a/build", True),
    ("docs/*", "docs/a/b", True),
    ("a.b", "aXb", False),
    ("f[!0-9]?", "fab", True),
    ("f[!0-9]?", "f1b", False),
    ("x[", "x[", True),
    ("x[?", "x[a", True),
    ("a+*", "a+b", True),
    ("foo[]*", "foo[]x", True),
    ("foo[]*", "foo]", False),
    ("[!]*", "[!]x", True),
    ("[!]*", "x", False),
    ("a[]?", "a[]b", True),
    ("[]]*", "]x", True),
    ("[!]]?", "]x", False),
    ("[!]]?", "ax", True),
]


def model(path: str, pattern: str) -> bool:
    """One path, one pattern: the bare form against all names, or a folder above the path."""
    bare = pattern.rstrip("/")
    same = fnmatch.fnmatchcase if set("*?") & set(bare) else str.__eq__
    above = pattern != bare and (path + "/").startswith(bare + "/")
    return above or any(same(name, bare) for name in [path, *path.split("/")])


def walk(path: str, patterns: list[str]) -> str:
    parts = path.split("/")
    for depth in range(1, len(parts) + 1):
        if any(model("/".join(parts[:depth]), p) for p in patterns):
            return "gitignore" if depth == len(parts) else "pruned"
    return "keep"


def single(spark, pairs):
    """Whether each (path, pattern) pair hits, each pair as a repository of its own."""
    files = spark.createDataFrame([(str(i), p) for i, (p, _) in enumerate(pairs)], "repo_name string, rel_path string")
    patterns = spark.createDataFrame([(str(i), t) for i, (_, t) in enumerate(pairs)], "repo_name string, pattern string")
    hits = {int(r.repo_name) for r in ignore.pattern_matches(files, patterns).collect()}
    return [i in hits for i in range(len(pairs))]


def test_quirks(spark):
    found = single(spark, [(path, pattern) for pattern, path, _ in QUIRKS])
    assert [(p, f, e) for (p, f, _), e in zip(QUIRKS, found)] == QUIRKS


def _random_cases(seed: int, n: int):
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice("ab.1-]") for _ in range(rng.randint(1, 3)))
    piece = lambda: rng.choice(["*", "?", "a", "b", ".", "1", "/", "[ab]", "[!a]", "[a-b1]", "[]a]", "[b-a]", "[", "**", "-", "^", "[^a]", "[&&b]", "[]", "[!]", "[]*", "[!]]"])
    for _ in range(n):
        path = "/".join(name() for _ in range(rng.randint(1, 4)))
        pattern = "".join(piece() for _ in range(rng.randint(1, 5)))
        yield path, pattern


def test_random_pairs(spark):
    pairs = list(_random_cases(7, 3000))
    found = single(spark, pairs)
    wrong = [(p, t, f) for (p, t), f in zip(pairs, found) if f != model(p, t)]
    assert not wrong
    assert any(found) and not all(found)


@pytest.mark.parametrize("broadcast", [True, False])
def test_random_walks(spark, monkeypatch, broadcast):
    """Whole rule sets with pruning, on the broadcast and on the salted join."""
    from lodestone.plans import sizing

    monkeypatch.setattr(sizing, "fits_broadcast", lambda df: broadcast)
    cases = list(_random_cases(11, 1200))
    repos = {str(i): [p for _, p in cases[i::40]][:4] for i in range(40)}
    files = [(repo, path) for repo in repos for path, _ in cases[:300]]
    rows = spark.createDataFrame(sorted(set(files)), "repo_name string, rel_path string")
    patterns = spark.createDataFrame([(r, p) for r, ps in repos.items() for p in set(ps)], "repo_name string, pattern string")
    status = ignore.with_ignore_status(rows, ignore.compile_rules(patterns))
    found = {(r.repo_name, r.rel_path): r.ignore_status or "keep" for r in status.collect()}
    assert found == {(r, p): walk(p, repos[r]) for r, p in set(files)}
    assert set(found.values()) == {"keep", "pruned", "gitignore"}


def test_load_ignore_reads_the_root_file_only(spark):
    rows = spark.createDataFrame(
        [
            ("r", ".gitignore", "# note\r\n\r\n a b \t\r\n!x\r\n *.log"), ("r", "sub/.gitignore", "nested"),
            ("s", "a.py", None), ("u", ".gitignore", None),
        ],
        "repo_name string, rel_path string, text string",
    )
    found = {}
    for r in ignore.load_ignore(rows).collect():
        found.setdefault(r.repo_name, set()).add(r.pattern)
    shared = {".git", ".git/**", "uv.lock"}
    assert found == {"r": shared | {"a b", "!x", "*.log"}, "s": shared, "u": shared}


def test_regex_of_a_name_with_special_characters(spark):
    assert globs.to_regex("a+(b)*") == r"a\+\(b\)[^\x00]*"
    row = spark.range(1).select(F.rlike(F.lit("x\x00a+(b)1"), globs.anchored(F.lit(globs.to_regex("a+(b)?"))))).first()
    assert row[0] is True
