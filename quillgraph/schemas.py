"""DDL of the corpus tables."""

DOCUMENTS = "id STRING, source_id STRING, external STRING, title STRING, kind STRING, version BIGINT, updated_at TIMESTAMP, deleted_at TIMESTAMP, graph_version BIGINT, metadata STRING"
SECTIONS = "id STRING, document_id STRING, seq INT, kind STRING, text STRING, raw STRING, heading_level INT, anchor STRING, navigation BOOLEAN, metadata STRING"
LINKS = "id STRING, document_id STRING, section_id STRING, section_seq INT, seq INT, kind STRING, target_document STRING, target_anchor STRING, resolved BOOLEAN, metadata MAP<STRING,STRING>"
LINK_REF = "STRUCT<target_document: STRING, target_anchor: STRING, kind: STRING>"
CHUNKS = f"id STRING, document_id STRING, seq INT, kind STRING, text STRING, sections ARRAY<STRING>, outgoing_links ARRAY<{LINK_REF}>, anchors ARRAY<STRING>, metadata STRING"
CLUSTERS = "source_id STRING, document_id STRING, cluster_id BIGINT"
RELATIONS = "source_id STRING, from_chunk_id STRING, to_chunk_id STRING, channel STRING, weight DOUBLE"
META = "source_id STRING, key STRING, value STRING"
ELEMENT = "STRUCT<seq: INT, kind: STRING, text: STRING, raw: STRING, anchor: STRING, heading_level: INT, metadata: MAP<STRING,STRING>>"
LINK_ITEM = "STRUCT<section_seq: INT, seq: INT, kind: STRING, target_anchor: STRING, resolved: BOOLEAN, metadata: MAP<STRING,STRING>>"
TABLES = {"documents": DOCUMENTS, "sections": SECTIONS, "links": LINKS, "chunks": CHUNKS, "clusters": CLUSTERS, "relations": RELATIONS, "meta": META}
