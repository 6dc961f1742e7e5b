"""Result rows as users see them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lodestone import config

# Defaults of missing metadata and keys that stay hidden.
METADATA_DEFAULTS = {"file_path": "Unknown", "file_name": "Unknown", "content_type": "text", "language": ""}
HIDDEN_KEYS = ["_node_content", "_node_type"]


def unwrap_metadata(meta_json: Column) -> list[Column]:
    """The metadata fields of a JSON object, nested one level under `metadata` or not."""
    nested = F.get_json_object(meta_json, "$.metadata")
    inner = F.coalesce(nested, meta_json)
    return [
        F.coalesce(F.get_json_object(inner, f"$.{name}"), F.lit(default)).alias(name)
        for name, default in METADATA_DEFAULTS.items()
    ]


def metadata_fields(metadata: Column) -> list[Column]:
    """The same fields of a metadata struct."""
    return [
        F.coalesce(metadata[name], F.lit(default)).alias(name)
        for name, default in METADATA_DEFAULTS.items()
    ]


def header(rank: Column, file_path: Column, language: Column, score: Column | None = None) -> Column:
    """`[rank] path (language) | Score: 0.000`, absent parts left out."""
    parts = [
        F.concat(F.lit("["), rank.cast("string"), F.lit("] "), file_path),
        F.when(F.coalesce(language, F.lit("")) != "", F.concat(F.lit("("), language, F.lit(")"))),
    ]
    if score is not None:
        parts.append(F.format_string("| Score: %.3f", score))
    return F.concat_ws(" ", *parts)


def preview(content: Column, size: int = config.PREVIEW_CHARS) -> Column:
    shortened = F.concat(F.substring(content, 1, size), F.lit("..."))
    return F.when(F.length(content) > size, shortened).otherwise(content)


def metadata_lines(metadata: Column) -> Column:
    """`key: value` lines of a string map, without internal keys."""
    shown = F.map_filter(metadata, lambda k, v: ~k.isin(*HIDDEN_KEYS))
    line = lambda e: F.concat(F.lit("  • "), e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None")))
    return F.array_join(F.transform(F.map_entries(shown), line), "\n")


def block(head: Column, content: Column, metadata: Column | None = None) -> Column:
    """Header between two rules, then the content: a preview, or all of it with the metadata."""
    rule = F.lit("━" * config.RULE_WIDTH)
    if metadata is None:
        return F.concat_ws("\n", rule, head, rule, preview(content))
    lines = metadata_lines(metadata)
    listed = F.when(lines != "", lines)
    return F.concat_ws("\n", rule, head, rule, content, F.lit(""), F.lit("Metadata:"), listed)
