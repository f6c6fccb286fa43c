"""Corpus reports, cluster summaries, context windows, document graphs and exports."""

from __future__ import annotations

import colorsys
import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import first_line

LABEL_SEPARATOR, UNLABELLED = " · ", "(unlabelled)"


@dataclass(frozen=True)
class CorpusReport:
    docs_total: int
    chunks_total: int
    clusters_total: int
    unclustered_docs: int
    links_by_kind: dict[str, int]
    links_resolved: int
    links_resolved_no_target: int
    links_unresolved: int
    chunks_per_doc: tuple[int, int, float]
    top_clusters: list[tuple[int, int]]

    def __str__(self) -> str:
        low, high, mean = self.chunks_per_doc
        kinds = sorted(self.links_by_kind.items(), key=lambda x: (-x[1], x[0]))
        lines = ["# Corpus report", "", f"- documents: {self.docs_total}", f"- chunks: {self.chunks_total}", f"- clusters: {self.clusters_total}", f"- documents without cluster: {self.unclustered_docs}"]
        lines += ["", "## Links", ""] + [f"- {k}: {n}" for k, n in kinds]
        lines += [f"- resolved: {self.links_resolved}", f"- resolved, no target: {self.links_resolved_no_target}", f"- unresolved: {self.links_unresolved}"]
        lines += ["", "## Chunks per document", "", f"min {low}, max {high}, mean {mean:.1f}", "", "## Largest clusters", ""]
        return "\n".join(lines + [f"- cluster {c}: {n} chunks" for c, n in self.top_clusters]) + "\n"


def chunks_per_document(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row a document, those without chunks included."""
    counts = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n_chunks"))
    return documents.select("id").join(counts, "id", "left").select("id", F.coalesce("n_chunks", F.lit(0).cast("long")).alias("n_chunks"))


def corpus_totals(documents: DataFrame, chunks: DataFrame, links: DataFrame, clusters: DataFrame) -> DataFrame:
    """The scalar part of the report as one row."""
    per = chunks_per_document(documents, chunks).join(clusters.select(F.col("document_id").alias("id"), "cluster_id"), "id", "left")
    unclustered = (F.col("cluster_id").isNull() | (F.col("n_chunks") == 0)).cast("long")
    docs = per.agg(
        F.count("*").alias("docs_total"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks_total"),
        F.count_distinct(F.when(F.col("n_chunks") > 0, F.col("cluster_id"))).alias("clusters_total"), F.coalesce(F.sum(unclustered), F.lit(0)).alias("unclustered_docs"),
        F.min("n_chunks").alias("chunks_min"), F.max("n_chunks").alias("chunks_max"), F.avg("n_chunks").alias("chunks_mean"),
    )
    tri = links.agg(
        F.count_if(F.col("resolved") & F.col("target_document").isNotNull()).alias("links_resolved"),
        F.count_if(F.col("resolved") & F.col("target_document").isNull()).alias("links_resolved_no_target"),
        F.count_if(~F.col("resolved")).alias("links_unresolved"),
    )
    return docs.withColumn("__one", F.lit(1)).join(tri.withColumn("__one", F.lit(1)), "__one").drop("__one")  # one row each


def links_by_kind(links: DataFrame) -> DataFrame:
    return links.groupBy("kind").agg(F.count("*").alias("n"))


def top_clusters(chunks: DataFrame, clusters: DataFrame, top_n: int = 10) -> DataFrame:
    """Clusters by number of chunks, ties by id."""
    counts = chunks.join(clusters.select("document_id", "cluster_id"), "document_id").groupBy("cluster_id").agg(F.count("*").alias("n_chunks"))
    return counts.orderBy(F.desc("n_chunks"), "cluster_id").limit(top_n)


def corpus_report(documents: DataFrame, chunks: DataFrame, links: DataFrame, clusters: DataFrame, top_n: int = 10) -> CorpusReport:
    t = corpus_totals(documents, chunks, links, clusters).first()
    kinds = {r["kind"]: r["n"] for r in links_by_kind(links).collect()}
    top = [(r["cluster_id"], r["n_chunks"]) for r in top_clusters(chunks, clusters, top_n).collect()]
    return CorpusReport(t["docs_total"], t["chunks_total"], t["clusters_total"], t["unclustered_docs"], kinds, t["links_resolved"], t["links_resolved_no_target"], t["links_unresolved"], (t["chunks_min"] or 0, t["chunks_max"] or 0, t["chunks_mean"] or 0.0), top)


def cluster_labels(chunks: DataFrame, clusters: DataFrame) -> DataFrame:
    """The three most frequent first lines of each cluster's chunks, ties by text."""
    rows = chunks.join(clusters.select("document_id", "cluster_id"), "document_id").select("cluster_id", first_line(F.col("text")).alias("line"))
    counts = rows.groupBy("cluster_id", "line").agg(F.count("*").alias("n"))
    order = Window.partitionBy("cluster_id").orderBy(F.col("line").isNull(), F.desc("n"), "line")
    best = counts.withColumn("rank", F.row_number().over(order)).where("rank <= 3")
    joined = best.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("rank", "line")))).alias("l"))
    return joined.select("cluster_id", F.coalesce(F.nullif(F.array_join(F.transform("l", lambda x: x["line"]), LABEL_SEPARATOR), F.lit("")), F.lit(UNLABELLED)).alias("label"))


def doc_cluster_map(chunks: DataFrame, clusters: DataFrame) -> DataFrame:
    """Cluster of every document that has chunks; null where it has none."""
    return chunks.select("document_id").distinct().join(clusters.select("document_id", "cluster_id"), "document_id", "left")


def related_clusters(links: DataFrame, clusters: DataFrame) -> DataFrame:
    """Number of links from each cluster to each other one; multiplicity counts."""
    own = clusters.select("document_id", F.col("cluster_id").alias("from_cluster"))
    other = clusters.select(F.col("document_id").alias("target_document"), F.col("cluster_id").alias("to_cluster"))
    rows = links.where("target_document IS NOT NULL").select("document_id", "target_document").join(own, "document_id").join(other, "target_document")
    return rows.where("from_cluster <> to_cluster").groupBy("from_cluster", "to_cluster").agg(F.count("*").alias("n_links"))


@dataclass(frozen=True)
class ClusterSummary:
    cluster_id: int
    documents: list[str] = field(default_factory=list)
    chunk_count: int = 0
    samples: list[str] = field(default_factory=list)
    label: str = UNLABELLED
    related: list[tuple[int, int]] = field(default_factory=list)

    def __str__(self) -> str:
        cut = lambda s: s if len(s) <= 120 else s[:120] + "…"
        lines = [f"# Cluster {self.cluster_id}: {self.label}", "", f"{len(self.documents)} documents, {self.chunk_count} chunks", "", "## Samples", ""]
        lines += [f"- {cut(' '.join(s.split()))}" for s in self.samples] + ["", "## Related clusters", ""]
        return "\n".join(lines + [f"- cluster {c}: {n} links" for c, n in self.related]) + "\n"


def cluster_summary(chunks: DataFrame, links: DataFrame, clusters: DataFrame, cluster: int, sample_size: int = 5, related_top_n: int = 5) -> ClusterSummary:
    """An unknown cluster gives an empty summary."""
    own = clusters.where(F.col("cluster_id") == cluster)
    docs = sorted(r["document_id"] for r in own.select("document_id").collect())
    if not docs:
        return ClusterSummary(cluster)
    mine = chunks.join(own.select("document_id"), "document_id", "left_semi")
    samples = [r["text"] for r in mine.orderBy("document_id", "seq").limit(sample_size).collect()]
    label = cluster_labels(mine, own).first()
    related = related_clusters(links, clusters).where(F.col("from_cluster") == cluster).orderBy(F.desc("n_links"), "to_cluster").limit(related_top_n)
    return ClusterSummary(cluster, docs, mine.count(), samples, label["label"] if label else UNLABELLED, [(r["to_cluster"], r["n_links"]) for r in related.collect()])


def with_context(chunks: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """Each chunk with the texts before and after it in its document, and all of them joined."""
    if before < 0 or after < 0:
        raise ValueError("before and after must not be negative")
    order = Window.partitionBy("document_id").orderBy("seq")
    none = F.array().cast("array<string>")
    out = chunks.withColumns(
        {
            "before": F.collect_list("text").over(order.rowsBetween(-before, -1)) if before else none,
            "after": F.collect_list("text").over(order.rowsBetween(1, after)) if after else none,
        }
    )
    return out.withColumn("context", F.array_join(F.concat("before", F.array("text"), "after"), "\n\n"))


def chunk_with_context(chunks: DataFrame, chunk: str, before: int = 1, after: int = 1) -> DataFrame:
    document = chunks.where(F.col("id") == chunk).select("document_id")
    return with_context(chunks.join(document, "document_id", "left_semi"), before, after).where(F.col("id") == chunk)


def document_links(links: DataFrame) -> DataFrame:
    """Resolved links to other documents, multi-edges kept."""
    return links.where(F.col("resolved") & F.col("target_document").isNotNull() & (F.col("target_document") != F.col("document_id"))).select("document_id", "target_document")


def top_nodes(links: DataFrame, max_nodes: int = 50) -> DataFrame:
    """Documents (targets outside the corpus included) by degree, ties by id."""
    if max_nodes <= 0:
        raise ValueError("max_nodes must be positive")
    edges = document_links(links)
    ends = edges.select(F.col("document_id").alias("id")).union(edges.select("target_document"))
    return ends.groupBy("id").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "id").limit(max_nodes)


def collapsed_edges(links: DataFrame, max_nodes: int = 50) -> DataFrame:
    """Edges with all documents outside the top collapsed to ``_others``; edges among those drop."""
    kept = top_nodes(links, max_nodes).select("id")
    edges = document_links(links)
    edges = edges.join(kept.select(F.col("id").alias("document_id"), F.col("id").alias("src")), "document_id", "left").join(kept.select(F.col("id").alias("target_document"), F.col("id").alias("dst")), "target_document", "left")
    return edges.select(F.coalesce("src", F.lit("_others")).alias("src"), F.coalesce("dst", F.lit("_others")).alias("dst")).where("src <> '_others' OR dst <> '_others'")


def cluster_color(cluster: int) -> str:
    rgb = colorsys.hls_to_rgb((cluster * 137.508 % 360) / 360, 0.72, 0.55)
    return "#" + "".join(f"{int(c * 255):02x}" for c in rgb)


def document_graph_mermaid(documents: DataFrame, links: DataFrame, clusters: DataFrame, max_nodes: int | None = 50) -> str:
    """The documents and their links; ``None`` shows all of them."""
    if max_nodes is not None and max_nodes <= 0:
        raise ValueError("max_nodes must be positive")
    safe = lambda s: "n_" + "".join(c if c.isalnum() and c.isascii() else "_" for c in s)
    escape = lambda s: s.replace('"', "#quot;").replace("\n", " ")
    if max_nodes is None or documents.limit(max_nodes + 1).count() <= max_nodes:
        edges = document_links(links).select(F.col("document_id").alias("src"), F.col("target_document").alias("dst"))
        shown = documents.select("id", "title")
    else:
        edges = collapsed_edges(links, max_nodes)
        shown = top_nodes(links, max_nodes).select("id").join(documents.select("id", "title"), "id", "left")
    rows = shown.join(clusters.select(F.col("document_id").alias("id"), "cluster_id"), "id", "left").orderBy("id").collect()
    drawn = edges.groupBy("src", "dst").count().orderBy("src", "dst").collect()  # at most max_nodes squared rows
    lines = ["graph LR"] + [f'    {safe(r["id"])}["{escape(r["title"] or r["id"])}"]' for r in rows]
    if any("_others" in (r["src"], r["dst"]) for r in drawn):
        lines.append('    n__others["(others)"]')
    lines += [f"    {safe(r['src'])} --> {safe(r['dst'])}" for r in drawn for _ in range(r["count"])]
    lines += [f"    style {safe(r['id'])} fill:{cluster_color(r['cluster_id'])}" for r in rows if r["cluster_id"] is not None]
    return "\n".join(lines) + "\n"


def export_records(documents: DataFrame, enriched: DataFrame) -> DataFrame:
    """One record a chunk of a live document, in the order of document and chunk."""
    live = documents.where("deleted_at IS NULL").select(F.col("id").alias("document_id"), F.col("title").alias("document_title"), "source_id", "version")
    rows = enriched.join(live, "document_id")
    return rows.select(
        F.col("id").alias("chunk_id"), "document_id", "document_title", "source_id", "version", "seq", "kind", "text", "outgoing_links", "cluster_id", "incoming_anchor_from",
    )


def export_jsonl(documents: DataFrame, enriched: DataFrame, path: str) -> int:
    """Write the records as JSON lines and return their number."""
    rows = export_records(documents, enriched).orderBy("document_id", "seq")
    rows.write.mode("overwrite").json(path)
    return rows.count()


def export_jsonl_file(documents: DataFrame, enriched: DataFrame, path: str) -> int:
    """As ``export_jsonl``, to one local file, streamed through the driver a partition at a time."""
    n = 0
    with open(path, "w", encoding="utf-8") as out:
        for row in export_records(documents, enriched).orderBy("document_id", "seq").toLocalIterator():
            out.write(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str) + "\n")
            n += 1
    return n


def dump_analysis(documents: DataFrame, chunks: DataFrame, links: DataFrame, clusters: DataFrame, enriched: DataFrame, folder: str, top_n: int = 10, max_nodes: int = 50) -> dict[str, object]:
    """report.md, graph.mmd, clusters/cluster-*.md, chunks.jsonl and README.md in a local folder; returns what was written."""
    root = Path(folder)
    (root / "clusters").mkdir(parents=True, exist_ok=True)
    report = corpus_report(documents, chunks, links, clusters, top_n)
    (root / "report.md").write_text(str(report), encoding="utf-8")
    (root / "graph.mmd").write_text(document_graph_mermaid(documents, links, clusters, max_nodes), encoding="utf-8")
    for cluster, _ in report.top_clusters:
        (root / "clusters" / f"cluster-{cluster}.md").write_text(str(cluster_summary(chunks, links, clusters, cluster)), encoding="utf-8")
    n = export_jsonl_file(documents, enriched, str(root / "chunks.jsonl"))
    listed = "\n".join(f"- [cluster {c}](clusters/cluster-{c}.md)" for c, _ in report.top_clusters)
    (root / "README.md").write_text(f"# Analysis\n\n- [report](report.md)\n- [graph](graph.mmd)\n- [chunks](chunks.jsonl): {n}\n{listed}\n", encoding="utf-8")
    return {"report": report, "chunks": n, "clusters": len(report.top_clusters)}
