"""Identifiers as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def document_id(source: Column, external: Column) -> Column:
    return F.concat_ws(":", F.lit("doc"), source, external)


def section_id(source: Column, external: Column, seq: Column) -> Column:
    return F.concat_ws(":", F.lit("sec"), source, external, seq.cast("string"))


def chunk_id(source: Column, external: Column, seq: Column) -> Column:
    return F.concat_ws(":", F.lit("chk"), source, external, seq.cast("string"))


def link_id(source: Column, external: Column, section_seq: Column, link_seq: Column) -> Column:
    return F.concat_ws(":", F.lit("lnk"), source, external, section_seq.cast("string"), link_seq.cast("string"))


def parse_document_id(doc: Column) -> Column:
    """struct(source, external); the external part may hold colons.  Malformed ids raise."""
    parts = F.split(doc, ":", 3)
    good = (F.size(parts) == 3) & (parts[0] == "doc")
    return F.when(good, F.struct(parts[1].alias("source"), parts[2].alias("external"))).otherwise(
        F.raise_error(F.concat(F.lit("malformed document id: "), doc)).cast("struct<source:string,external:string>")
    )


def source_of(doc: Column) -> Column:
    return parse_document_id(doc)["source"]


def external_of(doc: Column) -> Column:
    return parse_document_id(doc)["external"]


def shard_of(key: Column) -> Column:
    """First two hex digits of the SHA-256."""
    return F.substring(F.sha2(key, 256), 1, 2)


def safe_filename(key: Column) -> Column:
    return F.regexp_replace(key, r'[<>:"/\\|?*\x00-\x1f]', "_")
