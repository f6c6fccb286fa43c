"""From parsed rows to the corpus tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import ids
from quillgraph.functions.text import is_navigation_heading


def _items(rows: DataFrame, source: Column, external: Column, items: str, name: str) -> DataFrame:
    """A row an item.  From a plain explode Spark infers a filter on the parsed array and moves it below the dealing of the rows, where it parses the whole table in the few tasks that read it."""
    return rows.select(source.alias("s"), external.alias("x"), F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def sections_of(rows: DataFrame, source: Column, external: Column, elements: str = "sections") -> DataFrame:
    """The sections table from arrays of elements; headings of the navigation kind are flagged."""
    out = _items(rows, source, external, elements, "e")
    return out.select(
        ids.section_id(F.col("s"), F.col("x"), F.col("e.seq")).alias("id"), ids.document_id(F.col("s"), F.col("x")).alias("document_id"), F.col("e.seq").alias("seq"), "e.kind", "e.text", "e.raw", "e.heading_level", "e.anchor",
        (F.when(F.col("e.kind") == "heading", is_navigation_heading(F.col("e.text"))).otherwise(False)).alias("navigation"), F.to_json("e.metadata").alias("metadata"),
    )


def links_of(rows: DataFrame, source: Column, external: Column, links: str = "links") -> DataFrame:
    out = _items(rows, source, external, links, "l")
    return out.select(
        ids.link_id(F.col("s"), F.col("x"), F.col("l.section_seq"), F.col("l.seq")).alias("id"), ids.document_id(F.col("s"), F.col("x")).alias("document_id"), ids.section_id(F.col("s"), F.col("x"), F.col("l.section_seq")).alias("section_id"),
        "l.section_seq", "l.seq", "l.kind", F.lit(None).cast("string").alias("target_document"), "l.target_anchor", "l.resolved", "l.metadata",
    )


def documents_of(rows: DataFrame, source: Column, external: Column, title: Column, version: Column, updated: Column, metadata: Column, kind: str = "generic") -> DataFrame:
    return rows.select(
        ids.document_id(source, external).alias("id"), source.alias("source_id"), external.alias("external"), title.alias("title"), F.lit(kind).alias("kind"), version.cast("long").alias("version"),
        F.coalesce(F.try_to_timestamp(updated), F.timestamp_seconds(F.lit(0))).alias("updated_at"), F.lit(None).cast("timestamp").alias("deleted_at"), F.lit(0).cast("long").alias("graph_version"), metadata.alias("metadata"),
    )


def markdown_corpus(files: DataFrame, source_id: str) -> dict[str, DataFrame]:
    """``files``: path, text, updated_at."""
    from quillgraph.sources.markdown import parse_markdown

    rows = parse_markdown(files)
    s, x = F.lit(source_id), F.col("path")
    extra = F.to_json(F.struct(F.col("path"), F.col("front.tags").alias("tags"), F.col("front.format").alias("frontmatter_format"), F.col("front.frontmatter").alias("frontmatter")))
    return {
        "documents": documents_of(rows, s, x, F.col("front.title"), F.unix_timestamp("updated_at"), F.col("updated_at"), extra, "markdown"),
        "sections": sections_of(rows, s, x),
        "links": links_of(rows, s, x),
    }


def page_corpus(pages: DataFrame, source_id: str) -> dict[str, DataFrame]:
    """``pages``: id, space, title, version, updated_at, labels, parent, body."""
    from quillgraph.sources.xhtml import parse_pages

    rows = parse_pages(pages)
    s, x = F.lit(source_id), F.col("id").cast("string")
    extra = F.to_json(F.struct("space", "labels", F.when(F.col("parent").isNotNull(), ids.document_id(s, F.col("parent"))).alias("parent")))
    return {"documents": documents_of(rows, s, x, F.col("title"), F.col("version"), F.col("updated_at"), extra, "page"), "sections": sections_of(rows, s, x), "links": links_of(rows, s, x)}


def issue_corpus(issues: DataFrame, source_id: str) -> dict[str, DataFrame]:
    """``issues`` as of ``issues.issue_rows``."""
    from quillgraph.sources.issues import issue_links, parse_issues

    rows = parse_issues(issues)
    s, x = F.lit(source_id), F.col("key")
    extra = F.to_json(F.struct("project", "issue_type", "status", "priority", "labels", "reporter", "assignee", F.when(F.col("parent").isNotNull(), ids.document_id(s, F.col("parent"))).alias("parent")))
    links = issue_links(issues, s)
    links = links.select(
        F.concat_ws(":", F.regexp_replace("document_id", "^doc:", "lnk:"), "section_seq", "seq").alias("id"), "document_id", F.concat_ws(":", F.regexp_replace("document_id", "^doc:", "sec:"), F.lit("0")).alias("section_id"),
        "section_seq", "seq", "kind", "target_document", "target_anchor", "resolved", "metadata",
    )
    return {"documents": documents_of(rows, s, x, F.col("summary"), F.unix_timestamp("updated_at"), F.col("updated_at"), extra, "issue"), "sections": sections_of(rows, s, x), "links": links}
