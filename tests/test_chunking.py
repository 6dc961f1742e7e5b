"""Chunks cover their documents; sizes and overlaps hold."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import paths
from lodestone.operators import chunking


def docs_of(spark, texts, suffix=".txt"):
    rows = spark.createDataFrame([(f"d{i}{suffix}", t) for i, t in enumerate(texts)], "rel_path string, text string")
    return paths.with_document(rows.withColumn("repo_name", F.lit("r")))


def by_path(chunks):
    found = {}
    for row in chunks.orderBy("chunk_no").collect():
        found.setdefault(row.metadata.file_path, []).append(row)
    return found


def overlaps(text, contents):
    """Where each chunk starts when every chunk follows the one before; fails on a gap."""
    end, sizes = 0, []
    for content in contents:
        at = next(s for s in range(min(end, len(text)), -1, -1) if text.startswith(content, s) and s + len(content) > end)
        sizes.append(end - at)
        end = at + len(content)
    assert end == len(text)
    return sizes


def random_texts(n):
    rng = random.Random(3)
    words = ["alpha", "be", "c.", "d!?", "é", "\n", "...", "word" * 30, "x" * 1500, "y.", " "]
    return ["".join(rng.choice(words) + rng.choice([" ", "", ". "]) for _ in range(rng.randint(1, 400))) + "a" for _ in range(n)]


@pytest.mark.parametrize("mode", ["sentence", "window"])
def test_text_chunks_cover_every_character(spark, mode):
    texts = random_texts(40)
    found = by_path(chunking.chunk_text(docs_of(spark, texts), mode=mode))
    for i, text in enumerate(texts):
        contents = [r.content for r in found[f"d{i}.txt"]]
        assert [r.chunk_no for r in found[f"d{i}.txt"]] == list(range(len(contents)))
        assert all(0 < len(c) <= 1024 for c in contents)
        if mode == "window":
            assert contents == [text[k:k + 1024] for k in range(0, max(len(text) - 200, 1), 824)]
        else:
            assert max(overlaps(text, contents)) <= 200


def pack(text, size, overlap):
    """The packing rule as a plain loop."""
    import re

    pieces = [s[i:i + size] for s in re.findall(r"[^.!?]*[.!?]+|[^.!?]+", text) for i in range(0, len(s), size)]
    chunks, open_chunk, fresh = [], "", []
    for piece in pieces:
        if open_chunk and len(open_chunk) + len(piece) > size:
            chunks.append(open_chunk)
            kept = []
            for old in reversed(fresh):
                total = sum(map(len, kept)) + len(old)
                if total > overlap or total + len(piece) > size:
                    break
                kept.insert(0, old)
            open_chunk, fresh = "".join(kept), []
        open_chunk += piece
        fresh.append(piece)
    return chunks + [open_chunk]


@pytest.mark.parametrize("size,overlap", [(1024, 200), (50, 10), (10, 0), (7, 6)])
def test_sentence_packing(spark, size, overlap):
    texts = random_texts(15)
    found = by_path(chunking.chunk_text(docs_of(spark, texts), size=size, overlap=overlap))
    assert {p: [r.content for r in rows] for p, rows in found.items()} == {
        f"d{i}.txt": pack(t, size, overlap) for i, t in enumerate(texts)
    }


@pytest.mark.parametrize("n_lines", [1, 39, 40, 41, 65, 66, 200])
def test_code_windows(spark, n_lines):
    lines = [f"line {i}" for i in range(n_lines)]
    rows = by_path(chunking.chunk_code(docs_of(spark, ["\n".join(lines)], ".py")))["d0.py"]
    assert len(rows) == (1 if n_lines <= 40 else -(-(n_lines - 40) // 25) + 1)
    for k, row in enumerate(rows):
        assert row.content == "\n".join(lines[25 * k:25 * k + 40])
        assert (row.start_line, row.end_line) == (25 * k, min(25 * k + 39, n_lines - 1))


def test_long_code_windows_are_cut_without_loss(spark):
    lines = ["é" * 700, "b" * 1000, "", "c" * 4000, "d"]
    text = "\n".join(lines)
    rows = by_path(chunking.chunk_code(docs_of(spark, [text], ".py")))["d0.py"]
    assert "".join(r.content for r in rows) == text
    assert [len(r.content) for r in rows[:-1]] == [1500] * (len(rows) - 1)
    at = 0
    for row in rows:
        assert row.start_line == text[:at].count("\n")
        at += len(row.content)
        assert row.end_line == text[:at].count("\n")


def test_routing_identity_and_blank_documents(spark):
    docs = docs_of(spark, ["x = 1\ny = 2"], ".py").unionByName(docs_of(spark, ["  \n\u3000", "", "text. more"]))
    rows = chunking.chunk_docs(docs).collect()
    assert len({r.chunk_id for r in rows}) == 2
    code, text = sorted(rows, key=lambda r: r.metadata.content_type)
    assert (code.start_line, code.end_line, code.metadata.language) == (0, 1, "python")
    assert (text.start_line, text.metadata.language, text.content) == (None, None, "text. more")


@pytest.mark.parametrize("size,overlap", [(10, 10), (10, -1)])
def test_bad_limits(spark, size, overlap):
    with pytest.raises(ValueError):
        chunking.chunk_text(docs_of(spark, ["a"]), size=size, overlap=overlap)
