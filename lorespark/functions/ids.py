"""Content-addressed identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "\u001f"


def _id(domain: str, *parts: Column) -> Column:
    """The first 32 hex digits of SHA-256 over a domain and its parts, so equal records have equal ids in every build."""
    return F.substring(F.sha2(F.concat_ws(SEP, F.lit(domain), *(p.cast("string") for p in parts)), 256), 1, 32)


def source_id(path: Column) -> Column:
    return F.concat(F.lit("src_"), F.substring(F.sha2(path, 256), 1, 10))


def file_id(source: Column, rel_path: Column) -> Column:
    return _id("file", source, rel_path)


def document_id(file: Column, attachment: Column | None = None) -> Column:
    return _id("document", file) if attachment is None else F.when(attachment.isNull(), _id("document", file)).otherwise(_id("document", file, F.lit("attachment"), attachment))


def chunk_id(document: Column, ordinal: Column) -> Column:
    return _id("chunk", document, ordinal)


def entity_id(file: Column, kind: Column, qualified_name: Column, ordinal: Column) -> Column:
    return _id("entity", file, kind, qualified_name, ordinal)


def relationship_id(source: Column, kind: Column, target: Column, ordinal: Column) -> Column:
    return _id("relationship", source, kind, target, ordinal)


def link_id(entity: Column, document: Column, chunk: Column, kind: Column, resolver: Column) -> Column:
    return _id("link", entity, document, F.coalesce(chunk, F.lit("")), kind, resolver)


def source_type(raw_path: Column) -> Column:
    """``network`` for UNC and network URLs, else ``local``."""
    return F.when(raw_path.rlike(r"^(\\\\|//|smb://|nfs://|afp://)") & ~raw_path.startswith("///"), "network").otherwise("local")


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def symbol_keys(qualified_name: Column, name: Column) -> Column:
    return F.array(F.concat(F.lit("q:"), qualified_name), F.concat(F.lit("n:"), name))


def semantic_file_key(kind: Column, status: Column, content_hash: Column) -> Column:
    return F.concat_ws(":", kind, status, content_hash)


def digest(rows: Column) -> Column:
    """One digest of a group's rows, whatever order they come in."""
    return F.sha2(F.array_join(F.sort_array(F.collect_list(rows)), "\n"), 256)
