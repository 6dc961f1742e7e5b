"""Code context: scopes, signatures, imports and enriched chunks on small files."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import paths
from lodestone.operators import chunking, enrich
from suite import samples


def docs_of(spark, files):
    rows = spark.createDataFrame(list(files.items()), "rel_path string, text string")
    return paths.with_document(rows.withColumn("repo_name", F.lit("r")))


def lines_of(spark, name, text):
    return enrich.code_lines(enrich.code_documents(docs_of(spark, {name: text})))


def spans(spark, name, text):
    rows = enrich.scopes(lines_of(spark, name, text)).orderBy("start_line").collect()
    return [(r.kind, r.start_line, r.end_line) for r in rows]


def test_python_scopes(spark):
    text = (
        "async def a(x,\n"
        "            y):\n"
        "    if x:\n"
        "        return {\n"
        "  1: 2}\n"
        "    # end\n"
        "\n"
        "# def no(): pass\n"
        "class B: pass\n"
        "class C:\n"
        "    s = '''\n"
        "def fake():\n"
        "'''\n"
        "    def d(self):\n"
        "        def e():\n"
        "            pass\n"
        "        return e\n"
        "\tx = 1\n"
    )
    assert spans(spark, "a.py", text) == [
        ("function", 0, 4), ("class", 8, 8), ("class", 9, 18), ("function", 13, 16), ("function", 14, 15),
    ]


def test_brace_scopes_without_an_end_reach_the_last_line(spark):
    assert spans(spark, "a.go", "func a() {\n\tx := 1\n") == [("function", 0, 2)]
    assert spans(spark, "a.java", "class A {\n  abstract int b();\n  int c;\n}\n") == [("class", 0, 3), ("function", 1, 1)]
    assert spans(spark, "a.js", "if (a) {\n}\nfoo(function () {\n});\nclass B {}\n") == [("class", 4, 4)]
    assert spans(spark, "a.rs", "struct A;\nstruct B<'a> { x: &'a str }\nfn c() {\n // }\n}\n") == [
        ("class", 0, 0), ("class", 1, 1), ("function", 2, 4),
    ]


def test_signatures(spark):
    text = "@a\n@b(\n1)\n@c\n@d\ndef f(\n  x,\n  y,\n  z):\n    pass\n"
    lines = lines_of(spark, "a.py", text)
    row = enrich.signatures(enrich.scopes(lines), lines).first()
    assert row.signature == "@c\n@d\ndef f(\n  x,\n  y,"
    stub = enrich.signatures(enrich.scopes(lines), lines).select(enrich.context_stub(F.col("signature"))).first()[0]
    assert stub.endswith("\n    # ...")


def names(spark, name, text):
    found = enrich.with_import_names(enrich.extract_imports(lines_of(spark, name, text)))
    return [(r.import_text, r.names) for r in found.orderBy("line_no").collect()]


def test_python_imports(spark):
    text = (
        "from __future__ import annotations\nimport a.b.c as d, e  # why\nfrom . import f\n"
        "from g.h import *\nif x:\n    from i import (j,  # first\n      k as l)\nimportant = 1\n\"\"\"\nimport no\n\"\"\"\n"
        "from m import n, \\\n    o\n"
    )
    assert names(spark, "a.py", text) == [
        ("import a.b.c as d, e", ["d", "e"]),
        ("from . import f", ["f"]),
        ("from g.h import *", []),
        ("from i import (j,\n      k as l)", ["j", "l"]),
        ("from m import n, \\\n    o", ["n", "o"]),
    ]


def test_other_imports(spark):
    assert names(spark, "a.ts", "import 'side';\nimport type { A } from \"a\";\nimport b, {\n  c as d,\n  e\n} from 'x';\nimport('y');\n") == [
        ("import 'side';", []), ('import type { A } from "a";', ["A"]), ("import b, {\n  c as d,\n  e\n} from 'x';", ["b", "d", "e"]),
    ]
    assert names(spark, "a.java", "import a.b.*;\nimport a.B; // note\n") == [("import a.b.*;", []), ("import a.B;", ["B"])]
    assert names(spark, "a.go", 'import (\n\t_ "x/y"\n\tz "q/r"\n\t"net/http" // web\n)\n') == [
        ('import (\n\t_ "x/y"\n\tz "q/r"\n\t"net/http"\n)', ["z", "http"])
    ]
    assert names(spark, "a.rs", "pub use a::{b::{self, C}, d as e};\nuse f::*;\n") == [
        ("pub use a::{b::{self, C}, d as e};", ["b", "C", "e"]), ("use f::*;", [])
    ]


EXAMPLE = (
    "from tools import show, load\nimport math\n\nclass Vector:\n    def length(self):\n"
    "        return math.sqrt(self.x)\n\n    def text(self):\n        return show(self.x)\n"
)


def enriched(spark, files, **options):
    docs = docs_of(spark, files)
    chunks = chunking.chunk_code(docs, lines=2, overlap=0)
    return {r.chunk_no: r for r in enrich.enrich_chunks(chunks, docs, **options).collect()}


def test_enriched_chunks(spark):
    rows = enriched(spark, {"a.py": EXAMPLE})
    assert rows[0].content == "from tools import show, load\nimport math\n\nfrom tools import show, load\nimport math"
    assert rows[2].content == (
        "import math\n\nclass Vector:\n    # ...\n\n    def length(self):\n        return math.sqrt(self.x)"
    )
    assert rows[2].metadata.original_code == "    def length(self):\n        return math.sqrt(self.x)"
    assert rows[2].metadata.context_enriched is True
    assert rows[1].content == "\nclass Vector:" and rows[1].metadata.context_enriched is None
    assert rows[4].content == (
        "from tools import show, load\n\n    def text(self):\n        # ...\n\n        return show(self.x)\n"
    )


def test_options(spark):
    bare = enriched(spark, {"a.py": EXAMPLE}, include_imports=False, include_parent=False)
    assert all(r.metadata.original_code is None for r in bare.values()) if "original_code" in bare[0].metadata else True
    everything = enriched(spark, {"a.py": EXAMPLE}, include_parent=False, smart=False)
    assert all(r.content.startswith("from tools import show, load\nimport math\n\n") for r in everything.values())


def test_orphans_and_other_languages_pass_unchanged(spark):
    docs = docs_of(spark, {"a.py": EXAMPLE, "b.cpp": "import x;\nclass A {\n int x;\n};\n"})
    chunks = chunking.chunk_code(docs, lines=2, overlap=0)
    known = docs.where("metadata.file_path = 'b.cpp'")
    rows = enrich.enrich_chunks(chunks, known).collect()
    assert {(r.chunk_id, r.content) for r in rows} == {(r.chunk_id, r.content) for r in chunks.collect()}


def test_chunks_are_located_by_their_first_line(spark):
    docs = docs_of(spark, {"a.py": "\n\nx\n  target (1)\nlast"})
    chunks = chunking.chunk_text(docs).withColumn("content", F.lit("\n\n  target (1)\nlast"))
    row = enrich.locate_chunks(chunks, docs).first()
    assert (row.start_line, row.end_line) == (3, 6)
    missing = enrich.locate_chunks(chunks.withColumn("content", F.lit("nowhere")), docs).first()
    assert (missing.start_line, missing.end_line) == (0, 0)


def test_samples_hold_what_the_expected_rows_say(spark):
    files = {f"m{i}.{ext}": text for i, (ext, text) in enumerate(samples.FILES)}
    lines = enrich.code_lines(enrich.code_documents(docs_of(spark, files)))
    found = enrich.signatures(enrich.scopes(lines), lines).collect()
    assert {(r.language, r.kind, r.start_line, r.end_line, r.signature) for r in found} == set(samples.SCOPES)


@pytest.mark.parametrize("name", ["a.py", "a.js", "a.ts", "a.java", "a.go", "a.rs"])
def test_lines_of_a_million_characters(spark, name):
    n = 1_000_000
    long = [
        "foo(" + "a" * n + ")", "f(" + "(a)" * (n // 3) + ") {", "public " * (n // 7), "static async " * (n // 13) + "x() {",
        '"' + "\\a" * (n // 2) + '"', "int" + "[]" * (n // 2) + " f(", "{" * (n // 2) + "}" * (n // 2), "import " + "a, " * (n // 3),
    ]
    for line in long:
        lines = lines_of(spark, name, line)
        enrich.scopes(lines).count()
        enrich.extract_imports(lines).count()


def sorted_spans(spark, name, text):
    return sorted((r.kind, r.start_line, r.end_line) for r in enrich.scopes(lines_of(spark, name, text)).collect())


def test_nested_braces_on_one_line(spark):
    for depth in (1, 4, 5, 20, 50):
        text = "function f() {\n  x = " + "{a:" * depth + "1" + "}" * depth + ";\n  return 1;\n}\n"
        assert sorted_spans(spark, "a.js", text) == [("function", 0, 3)]


def test_braces_far_below_the_header(spark):
    for below in (0, 1, 2, 3, 10, 30):
        head = "\n".join(["class A {", "  int g()", *["  throws X,"] * below, "  {", "  return 1;", "  }", "}"])
        assert sorted_spans(spark, "a.java", head) == [("class", 0, below + 5), ("function", 1, below + 4)]
    assert sorted_spans(spark, "a.java", "record R(int a) {\n}\nclass B\n{\n}") == [("class", 2, 4)]
    assert sorted_spans(spark, "a.ts", "function f(a: string): void\nfunction f(a: number): void\n{\n}") == [
        ("function", 0, 0), ("function", 1, 3),
    ]
    assert sorted_spans(spark, "a.go", "type X int\nfunc f() {\n}") == [("class", 0, 0), ("function", 1, 2)]
