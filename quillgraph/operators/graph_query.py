"""Graph-enriched reads: chunks with cluster and backlinks, peers, clusters, audits.

Joins with what is exploded or parsed are marked to shuffle: Spark takes it to be as small
as the files it comes from and would broadcast it, at the cost of the driver's memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enriched_chunks(chunks: DataFrame, clusters: DataFrame, relations: DataFrame) -> DataFrame:
    """Chunks with ``cluster_id`` and ``incoming_anchor_from`` (sorted ids of chunks that follow an anchor here)."""
    back = relations.where("channel = 'anchor_follow'").groupBy(F.col("to_chunk_id").alias("id")).agg(F.sort_array(F.collect_set("from_chunk_id")).alias("incoming_anchor_from"))
    out = chunks.join(clusters.select("document_id", "cluster_id").hint("merge"), "document_id", "left").join(back.hint("merge"), "id", "left")
    return out.withColumn("incoming_anchor_from", F.coalesce("incoming_anchor_from", F.array().cast("array<string>")))


def get_chunk(enriched: DataFrame, chunk: str) -> DataFrame:
    return enriched.where(F.col("id") == chunk)


def get_chunks(enriched: DataFrame, document: str) -> DataFrame:
    return enriched.where(F.col("document_id") == document).orderBy("seq")


def cluster_peers(chunks: DataFrame, clusters: DataFrame, chunk: str, limit: int | None = None) -> DataFrame:
    """Chunks of other documents in the cluster of the chunk's document."""
    own = chunks.where(F.col("id") == chunk).select(F.col("document_id").alias("own")).join(clusters.select(F.col("document_id").alias("own"), "cluster_id"), "own")
    docs = clusters.join(own, "cluster_id").where("document_id <> own").select("document_id", "cluster_id")
    out = chunks.join(docs, "document_id").orderBy("document_id", "seq")
    return out if limit is None else out.limit(limit)


def by_cluster(chunks: DataFrame, clusters: DataFrame, cluster: int, limit: int | None = None) -> DataFrame:
    out = chunks.join(clusters.where(F.col("cluster_id") == cluster).select("document_id", "cluster_id"), "document_id").orderBy("document_id", "seq")
    return out if limit is None else out.limit(limit)


def dead_links(links: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Resolved links of the given kinds that found nothing in the corpus."""
    return links.where(F.col("resolved") & F.col("target_document").isNull() & F.col("kind").isin(list(kinds)))


def orphans(documents: DataFrame, links: DataFrame) -> DataFrame:
    """Documents no other document links to."""
    hit = links.where(F.col("target_document").isNotNull() & (F.col("target_document") != F.col("document_id"))).select(F.col("target_document").alias("id")).distinct()
    return documents.join(hit.hint("merge"), "id", "left_anti")


def dangling_anchors(links: DataFrame, sections: DataFrame) -> DataFrame:
    """Resolved links whose anchor no section of the target has."""
    known = sections.where("anchor IS NOT NULL AND anchor <> ''").select(F.col("document_id").alias("target_document"), F.col("anchor").alias("target_anchor")).distinct()
    return links.where("target_document IS NOT NULL AND target_anchor IS NOT NULL AND target_anchor <> ''").join(known.hint("merge"), ["target_document", "target_anchor"], "left_anti")
