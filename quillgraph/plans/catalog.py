"""Queries over the driver's tables, each with the SQL that must give the same rows.

Views: text corpus (``documents`` by lines), page corpus (``pages`` by hrefs), order
corpus (orders as documents, line items as sections, parts as targets).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import ids, text as tx
from quillgraph.operators import analysis, chunking as ck, communities, graph_query, relations, sync

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_key(c: str = "doc_id"):
    return ids.document_id(F.lit("text"), F.col(c).cast("string"))


# Text corpus -----------------------------------------------------------------------------
def text_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("seq", "text"))
    return docs.select(doc_key().alias("document_id"), "seq", F.concat_ws(":", F.lit("sec:text"), F.col("doc_id"), F.col("seq")).alias("id"), "text", F.lit("paragraph").alias("kind"))


SECTIONS_SQL = "SELECT doc_id, i - 1 AS seq, l[i] AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


@query("SELECT 'doc:' || source || ':' || doc_id AS id, 'sec:' || source || ':' || doc_id || ':0' AS first_section, source AS parsed_source, doc_id::VARCHAR AS parsed_external, substr(sha256('doc:' || source || ':' || doc_id), 1, 2) AS shard FROM documents")
def doc_ids(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("x"))
    d = d.select(ids.document_id(F.col("source"), F.col("x")).alias("id"), ids.section_id(F.col("source"), F.col("x"), F.lit(0)).alias("first_section"))
    return d.select("id", "first_section", ids.source_of(F.col("id")).alias("parsed_source"), ids.external_of(F.col("id")).alias("parsed_external"), ids.shard_of(F.col("id")).alias("shard"))


@query(f"SELECT 'doc:text:' || doc_id AS document_id, seq, text, length(text) AS n_chars FROM ({SECTIONS_SQL})")
def split_sections(spark, sf_dir):
    return text_sections(spark, sf_dir).select("document_id", F.col("seq").cast("long").alias("seq"), "text", F.length("text").cast("long").alias("n_chars"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(trim(regexp_replace(lower(string_split(text, chr(10))[1]), '[^\p{L}\p{N}_\s-]', '', 'g')), '[\s_]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents""")
def slug_anchor(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.slugify(F.split("text", "\n")[0]).alias("slug"))


@query("""SELECT page_id, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS title, regexp_matches(regexp_extract(html, '<h1>(.*?)</h1>', 1), '(?i)^\\s*(?:is|the|les?|der)[\\s:?!.]*') AS navigation FROM pages""".replace("\\\\", "\\"))
def nav_heading_flag(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<h1>(.*?)</h1>", 1).alias("title"))
    return p.withColumn("navigation", F.col("title").rlike(r"(?i)^\s*(?:is|the|les?|der)[\s:?!.]*"))


FIRST_LINE_SQL = r"substr(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '')[1], 1, 60)"


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").select("page_id", F.posexplode_outer(tx.html_hrefs(F.col("html"))).alias("seq", "href")).where("href IS NOT NULL")
    return p.select("page_id", F.col("seq").cast("long").alias("seq"), "href", tx.link_target(F.col("href")).alias("t")).select("page_id", "seq", "href", "t.*")


PAGE_LINKS_SQL = r"""(SELECT page_id, i - 1 AS seq, h[i] AS href, regexp_matches(h[i], '^[A-Za-z][A-Za-z0-9+.-]*:') AS ext,
 regexp_replace(string_split(h[i], '#')[1], '\?.*$', '') AS path FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, list_filter(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1), lambda x: x <> '') AS h FROM pages)))"""


@query(f"SELECT page_id, seq, href, CASE WHEN ext THEN 'external' ELSE 'internal' END AS kind, CASE WHEN NOT ext THEN path END AS target_path, CASE WHEN NOT ext AND contains(href, '#') THEN nullif(substr(href, strpos(href, '#') + 1), '') END AS target_anchor, ext AS resolved FROM {PAGE_LINKS_SQL}")
def html_links(spark, sf_dir):
    return page_links(spark, sf_dir)


@query(f"SELECT CASE WHEN ext THEN 'external' ELSE 'internal' END AS kind, count(*) AS n FROM {PAGE_LINKS_SQL} GROUP BY 1")
def link_kind_counts(spark, sf_dir):
    return analysis.links_by_kind(page_links(spark, sf_dir))


def _path_index(spark, sf_dir):
    """Paths that pages stand under: the first word of their title."""
    p = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<h1>([^< ]+)", 1).alias("path")).where("path <> ''")
    return p.groupBy("path").agg(F.max("page_id").alias("target"))


INDEX_SQL = "(SELECT regexp_extract(html, '<h1>([^< ]+)', 1) AS path, max(page_id) AS target FROM pages WHERE regexp_extract(html, '<h1>([^< ]+)', 1) <> '' GROUP BY 1)"


@query(f"SELECT l.page_id, l.seq, ltrim(l.path, '/') AS key, x.target FROM {PAGE_LINKS_SQL} l LEFT JOIN {INDEX_SQL} x ON ltrim(l.path, '/') = x.path WHERE NOT ext AND l.path NOT LIKE '%.%/%'")
def resolve_paths(spark, sf_dir):
    links = page_links(spark, sf_dir).where("kind = 'internal' AND target_path NOT LIKE '%.%/%'")
    links = links.select("page_id", "seq", tx.resolve_path(F.lit("index.html"), F.col("target_path")).alias("key"))
    return links.join(_path_index(spark, sf_dir).withColumnRenamed("path", "key"), "key", "left").select("page_id", "seq", "key", "target")


@query(f"SELECT l.page_id, l.seq, l.path FROM {PAGE_LINKS_SQL} l LEFT JOIN {INDEX_SQL} x ON ltrim(l.path, '/') = x.path WHERE NOT ext AND x.target IS NULL")
def dead_links(spark, sf_dir):
    links = page_links(spark, sf_dir).where("kind = 'internal'").withColumn("key", F.regexp_replace("target_path", "^/+", ""))
    found = links.join(_path_index(spark, sf_dir).withColumnRenamed("path", "key"), "key", "left")
    rows = found.select("page_id", "seq", F.col("target_path").alias("path"), F.lit(True).alias("resolved"), F.col("target").alias("target_document"), "kind")
    return graph_query.dead_links(rows, ("internal",)).select("page_id", "seq", "path")


@query(f"SELECT p.page_id AS id FROM pages p WHERE p.page_id NOT IN (SELECT x.target FROM {PAGE_LINKS_SQL} l JOIN {INDEX_SQL} x ON ltrim(l.path, '/') = x.path WHERE NOT ext AND x.target <> l.page_id)")
def orphans(spark, sf_dir):
    links = page_links(spark, sf_dir).where("kind = 'internal'").withColumn("key", F.regexp_replace("target_path", "^/+", ""))
    links = links.join(_path_index(spark, sf_dir).withColumnRenamed("path", "key"), "key").select(F.col("page_id").alias("document_id"), F.col("target").alias("target_document"))
    return graph_query.orphans(read(spark, sf_dir, "pages").select(F.col("page_id").alias("id")), links)


# The fold ----------------------------------------------------------------------------------
def _starts(sections: DataFrame, rule: ck.Rule) -> DataFrame:
    """(document_id, chunk, n_sections, n_chars)."""
    docs = ck.gathered(sections).select("document_id", "secs", ck.chunk_starts(F.col("secs"), rule).alias("starts"))
    part = F.transform("starts", lambda s, i: F.slice("secs", s + 1, F.coalesce(F.get("starts", i + 1), F.size("secs")) - s))
    rows = docs.select("document_id", F.posexplode(part).alias("chunk", "p"))
    return rows.select("document_id", F.col("chunk").cast("long").alias("chunk"), F.size("p").cast("long").alias("n_sections"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["size"]).alias("n_chars"))


def fold_sql(sections: str, state: str, first: str, merged: str, split_when: str, out: str = "") -> str:
    """The fold as a recursive CTE; ``sections``: doc, seq (from 0), n and what the rule reads."""
    return f"""WITH RECURSIVE s AS ({sections}), f AS (
  SELECT doc, seq, 0::BIGINT AS chunk, {first} FROM s WHERE seq = 0
  UNION ALL SELECT s.doc, s.seq, CAST(f.chunk + CASE WHEN {split_when} THEN 1 ELSE 0 END AS BIGINT), {merged} FROM f JOIN s ON s.doc = f.doc AND s.seq = f.seq + 1)
SELECT doc AS document_id, chunk, count(*) AS n_sections, CAST(sum(n) AS BIGINT) AS n_chars FROM (SELECT f.doc, f.chunk, s.n FROM f JOIN s ON s.doc = f.doc AND s.seq = f.seq) GROUP BY 1, 2"""


LINES_SQL = f"SELECT 'doc:text:' || doc_id AS doc, seq, length(text) AS n FROM ({SECTIONS_SQL})"
SIZE_SPLIT = "NOT (f.size + s.n < 500) AND f.size + s.n > 2000"


@query(fold_sql(LINES_SQL, "size", "n AS size", f"CASE WHEN {SIZE_SPLIT} THEN s.n ELSE f.size + s.n END", SIZE_SPLIT))
def chunk_size_policy(spark, sf_dir):
    return _starts(text_sections(spark, sf_dir), ck.policy([ck.min_size(500), ck.size_limit(2000)]))


@query("""SELECT 'conv:' || conv_id AS document_id, CAST(g AS BIGINT) AS chunk, count(*) AS n_sections, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM (
  SELECT conv_id, text, sum(CASE WHEN role = 'user' AND rn > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY rn) AS g
  FROM (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn FROM conversations)) GROUP BY 1, 2""")
def chunk_heading_policy(spark, sf_dir):
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = read(spark, sf_dir, "conversations").withColumn("seq", F.row_number().over(order) - 1)
    rows = rows.select(F.concat(F.lit("conv:"), F.col("conv_id")).alias("document_id"), "seq", F.col("role").alias("kind"), "text")
    return _starts(rows, ck.policy([ck.heading(kind="user")]))


def order_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    rows = read(spark, sf_dir, "lineitem").withColumn("seq", F.row_number().over(order) - 1)
    kind = F.when(F.col("l_returnflag") == "R", "code").otherwise("paragraph")
    return rows.select(F.concat(F.lit("doc:order:"), F.col("l_orderkey")).alias("document_id"), "seq", kind.alias("kind"), F.col("l_quantity").cast("int").alias("size"), "l_partkey", "l_linenumber")


def order_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_sections(spark, sf_dir).select(
        "document_id", F.col("seq").alias("section_seq"), F.lit(0).alias("seq"), F.lit("part").alias("kind"), F.concat(F.lit("doc:part:"), F.col("l_partkey")).alias("target_document"),
        F.col("l_linenumber").cast("string").alias("target_anchor"), F.lit(True).alias("resolved"),
    )


ORDER_ROWS = "SELECT 'doc:order:' || l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS seq, CAST(l_quantity AS INT) AS n, CASE WHEN l_returnflag = 'R' THEN 'code' ELSE 'paragraph' END AS kind, l_partkey, l_linenumber, 'doc:part:' || l_partkey AS target FROM lineitem"
ATOMIC = "NOT (s.kind = 'code' AND f.size < 60) AND f.size + s.n > 50"


@query(fold_sql(ORDER_ROWS, "size", "n AS size", f"CASE WHEN {ATOMIC} THEN s.n ELSE f.size + s.n END", ATOMIC))
def chunk_atomic_policy(spark, sf_dir):
    return _starts(order_sections(spark, sf_dir), ck.policy([ck.atomic_block(min_buffer_chars=60), ck.size_limit(50)]))


def _order_starts(spark, sf_dir, rule, clusters=None):
    docs = ck.gathered(order_sections(spark, sf_dir), order_links(spark, sf_dir), clusters)
    docs = docs.select("document_id", "secs", ck.chunk_starts(F.col("secs"), rule).alias("starts"))
    part = F.transform("starts", lambda s, i: F.slice("secs", s + 1, F.coalesce(F.get("starts", i + 1), F.size("secs")) - s))
    rows = docs.select("document_id", F.posexplode(part).alias("chunk", "p"))
    return rows.select("document_id", F.col("chunk").cast("long").alias("chunk"), F.size("p").cast("long").alias("n_sections"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["size"]).alias("n_chars"))


OVERLAP = "NOT (len(list_intersect(f.t, [s.target])) / len(list_distinct(list_concat(f.t, [s.target]))) >= 0.3) AND f.cnt >= 3"


@query(fold_sql(ORDER_ROWS, "t", "[target] AS t, 1 AS cnt", f"CASE WHEN {OVERLAP} THEN [s.target] ELSE list_distinct(list_concat(f.t, [s.target])) END, CASE WHEN {OVERLAP} THEN 1 ELSE f.cnt + 1 END", OVERLAP))
def chunk_link_overlap(spark, sf_dir):
    limit = lambda buf, cur: F.when(buf["count"] >= 3, ck.SPLIT)
    return _order_starts(spark, sf_dir, ck.policy([ck.link_overlap(0.3), limit]))


def part_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.concat(F.lit("doc:part:"), F.col("p_partkey")).alias("document_id"), F.col("p_brand").alias("cluster_id"))


BOUNDARY = "1 - len(list_intersect(f.t, [s.brand])) / len(list_distinct(list_concat(f.t, [s.brand]))) >= 0.7"


@query(fold_sql(f"SELECT o.*, p.p_brand AS brand FROM ({ORDER_ROWS}) o JOIN part p ON p.p_partkey = o.l_partkey", "t", "[brand] AS t", f"CASE WHEN {BOUNDARY} THEN [s.brand] ELSE list_distinct(list_concat(f.t, [s.brand])) END", BOUNDARY))
def chunk_cluster_boundary(spark, sf_dir):
    return _order_starts(spark, sf_dir, ck.policy([ck.cluster_boundary(0.7)]), part_clusters(spark, sf_dir))


@query(f"""WITH RECURSIVE s AS (SELECT 'doc:text:' || doc_id AS doc, seq, text FROM ({SECTIONS_SQL})), f AS (
  SELECT doc, seq, text AS t FROM s WHERE seq = 0
  UNION ALL SELECT s.doc, s.seq, CASE WHEN f.t <> '' AND s.text <> '' THEN right(f.t, 40) || chr(10) || chr(10) || s.text WHEN s.text <> '' THEN s.text ELSE right(f.t, 40) END FROM f JOIN s ON s.doc = f.doc AND s.seq = f.seq + 1)
SELECT doc AS document_id, seq, sha256(t) AS text_sha FROM f""")
def chunk_overlap_text(spark, sf_dir):
    """One chunk a line, each after the last 40 characters before it."""
    chunks = ck.PolicyChunker(ck.policy([], default=ck.SPLIT), overlap_chars=40).chunk(text_sections(spark, sf_dir))
    return chunks.select("document_id", F.col("seq").cast("long").alias("seq"), F.sha2("text", 256).alias("text_sha"))


@query(f"SELECT doc AS document_id, string_agg(target || '#' || l_linenumber, ',' ORDER BY seq) AS refs, count(DISTINCT target) AS n_targets FROM ({ORDER_ROWS}) GROUP BY 1")
def chunk_outgoing_refs(spark, sf_dir):
    """Whole orders as chunks: references in order, not deduplicated."""
    chunks = ck.PolicyChunker(ck.policy([])).chunk(order_sections(spark, sf_dir), order_links(spark, sf_dir))
    refs = F.array_join(F.transform("outgoing_links", lambda x: F.concat_ws("#", x["target_document"], x["target_anchor"])), ",")
    return chunks.select("document_id", refs.alias("refs"), F.size(F.array_distinct(F.transform("outgoing_links", lambda x: x["target_document"]))).cast("long").alias("n_targets"))


@query("SELECT conv_id, CASE WHEN arg_min(role, (turn, role, text)) = 'user' THEN 'navigation' ELSE 'generic' END AS kind FROM conversations GROUP BY 1")
def navigation_kind(spark, sf_dir):
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("document_id"), (F.row_number().over(order) - 1).alias("seq"), "text", (F.col("role") == "user").alias("navigation"))
    chunks = ck.PolicyChunker(ck.policy([]), classifier=ck.navigation_kind()).chunk(rows)
    return chunks.select(F.col("document_id").cast("long").alias("conv_id"), "kind")


BODY_SQL = f"(SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY seq) AS body FROM ({SECTIONS_SQL}) WHERE text <> '' GROUP BY 1)"


@query(f"SELECT 'doc:text:' || doc_id AS document_id, k AS seq, substr(body, CAST(k * 900 + 1 AS BIGINT), 1000) AS text FROM (SELECT doc_id, body, unnest(range(0, CAST(greatest(0, ceil((length(body) - 1000) / 900.0)) AS BIGINT) + 1)) AS k FROM {BODY_SQL})")
def fixed_window(spark, sf_dir):
    return ck.FixedWindowChunker(1000, 100).chunk(text_sections(spark, sf_dir)).select("document_id", F.col("seq").cast("long").alias("seq"), "text")


@query(f"""SELECT 'doc:text:' || w.doc_id AS document_id, w.k AS seq, string_agg(s.seq, ',' ORDER BY s.seq) AS covered FROM
 (SELECT doc_id, unnest(range(0, CAST(greatest(0, ceil((length(body) - 1000) / 900.0)) AS BIGINT) + 1)) AS k FROM {BODY_SQL}) w
 JOIN (SELECT doc_id, seq, length(text) AS n, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM ({SECTIONS_SQL}) WHERE text <> '') s
 ON s.doc_id = w.doc_id AND s.at < w.k * 900 + 1000 AND s.at + s.n > w.k * 900 GROUP BY 1, 2""")
def fixed_window_coverage(spark, sf_dir):
    rows = ck.FixedWindowChunker(1000, 100).chunk(text_sections(spark, sf_dir))
    return rows.select("document_id", F.col("seq").cast("long").alias("seq"), F.array_join(F.transform("sections", lambda x: F.element_at(F.split(x, ":"), -1)), ",").alias("covered"))


# Relations ---------------------------------------------------------------------------------
def page_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_links(spark, sf_dir).select(F.col("page_id").cast("string").alias("chunk_id"), F.col("href").alias("target_document"), F.lit("generic").alias("kind")).distinct()


def same_target_sql(rows: str) -> str:
    return f"""WITH t AS (SELECT DISTINCT c, d FROM ({rows})), n AS (SELECT c, count(*) AS n FROM t GROUP BY 1)
SELECT a.c AS from_chunk_id, b.c AS to_chunk_id, 'same_target' AS channel, round(count(*) / (na.n + nb.n - count(*)), 9) AS weight
FROM t a JOIN t b ON a.d = b.d AND a.c <> b.c JOIN n na ON na.c = a.c JOIN n nb ON nb.c = b.c WHERE na.n >= 2 GROUP BY a.c, b.c, na.n, nb.n"""


@query(same_target_sql(f"SELECT page_id::VARCHAR AS c, href AS d FROM {PAGE_LINKS_SQL}"))
def same_target_pages(spark, sf_dir):
    return relations.same_target(page_targets(spark, sf_dir)).withColumn("weight", F.round("weight", 9))


def order_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_links(spark, sf_dir).select(F.regexp_replace("document_id", "^doc:", "chk:").alias("chunk_id"), "document_id", "target_document", F.col("target_anchor"), F.lit("generic").alias("kind"))
    return rows.distinct()


@query(same_target_sql("SELECT 'chk:order:' || l_orderkey AS c, 'doc:part:' || l_partkey AS d FROM lineitem"))
def same_target_orders(spark, sf_dir):
    return relations.same_target(order_targets(spark, sf_dir)).withColumn("weight", F.round("weight", 9))


def part_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part is a document of one chunk whose anchors are 1 to its size, 7 at most."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.explode(F.sequence(F.lit(1), F.least(F.col("p_size"), F.lit(7)))).alias("a"))
    return p.select(F.concat(F.lit("chk:part:"), F.col("p_partkey")).alias("chunk_id"), F.concat(F.lit("doc:part:"), F.col("p_partkey")).alias("document_id"), F.col("a").cast("string").alias("anchor"))


ANCHOR_SQL = "SELECT DISTINCT 'chk:order:' || l_orderkey AS from_chunk_id, 'chk:part:' || l_partkey AS to_chunk_id, 'anchor_follow' AS channel, 1.0::DOUBLE AS weight FROM lineitem JOIN part ON p_partkey = l_partkey AND l_linenumber <= least(p_size, 7)"


@query(ANCHOR_SQL)
def anchor_follow(spark, sf_dir):
    return relations.anchor_follow(order_targets(spark, sf_dir), part_anchors(spark, sf_dir))


@query(f"SELECT channel, count(*) AS n, round(sum(weight), 3) AS total FROM (SELECT * FROM ({same_target_sql("SELECT 'chk:order:' || l_orderkey AS c, 'doc:part:' || l_partkey AS d FROM lineitem")}) UNION ALL {ANCHOR_SQL}) GROUP BY 1")
def relations_union(spark, sf_dir):
    t = order_targets(spark, sf_dir)
    both = relations.same_target(t).withColumn("weight", F.round("weight", 9)).unionByName(relations.anchor_follow(t, part_anchors(spark, sf_dir)))
    return both.groupBy("channel").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 3).alias("total"))


@query(f"SELECT DISTINCT page_id, ltrim(path, '/') AS target FROM {PAGE_LINKS_SQL} WHERE NOT ext")
def doc_edges(spark, sf_dir):
    rows = page_links(spark, sf_dir).where("kind = 'internal'").select(F.col("page_id").alias("document_id"), F.regexp_replace("target_path", "^/+", "").alias("target_document"))
    return relations.document_edges(rows).select(F.col("document_id").alias("page_id"), F.col("target_document").alias("target"))


def customer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of many trees: each customer to the one at half its place among the 64 keys of its block."""
    return read(spark, sf_dir, "customer").selectExpr("CAST(c_custkey AS BIGINT) AS document_id", "CAST(c_custkey - c_custkey % 64 + (c_custkey % 64) div 2 AS BIGINT) AS target_document")


@query("""WITH RECURSIVE k AS (SELECT CAST(c_custkey AS BIGINT) AS a, CAST(c_custkey - c_custkey % 64 + (c_custkey % 64) // 2 AS BIGINT) AS b FROM customer), e AS (SELECT a, b FROM k WHERE a <> b),
 n AS (SELECT a AS x FROM e UNION SELECT b FROM e), up AS (SELECT x AS node, x AS top FROM n UNION SELECT up.node, e.b FROM up JOIN e ON e.a = up.top)
SELECT node, min(top) AS component FROM up GROUP BY 1""")
def components(spark, sf_dir):
    return communities.connected_components(customer_edges(spark, sf_dir))


@query()
def communities_of_pages(spark, sf_dir):
    rows = page_links(spark, sf_dir).where("kind = 'internal'").select(F.concat(F.lit("page:"), F.col("page_id")).alias("document_id"), F.regexp_replace("target_path", "^/+", "path:").alias("target_document"))
    return communities.communities(rows)


# Reads over chunks -------------------------------------------------------------------------
def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_sections(spark, sf_dir).select(F.regexp_replace("id", "^sec:", "chk:").alias("id"), "document_id", "seq", F.lit("generic").alias("kind"), "text")


def source_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(doc_key().alias("document_id"), F.regexp_extract("source", "[0-9]+", 0).cast("long").alias("cluster_id"))


CLUSTERS_SQL = "(SELECT doc_id, CAST(regexp_extract(source, '[0-9]+') AS BIGINT) AS cluster_id FROM documents)"


@query("""SELECT 'chk:part:' || p_partkey AS id, p_brand AS cluster_id, coalesce(string_agg(DISTINCT f, ',' ORDER BY f), '') AS followed_from FROM part LEFT JOIN
 (SELECT from_chunk_id AS f, to_chunk_id AS t FROM (%s)) ON t = 'chk:part:' || p_partkey GROUP BY 1, 2""" % ANCHOR_SQL)
def enriched_chunks(spark, sf_dir):
    chunks = part_anchors(spark, sf_dir).select(F.col("chunk_id").alias("id"), "document_id").distinct()
    rel = relations.anchor_follow(order_targets(spark, sf_dir), part_anchors(spark, sf_dir))
    out = graph_query.enriched_chunks(chunks, part_clusters(spark, sf_dir), rel)
    return out.select("id", "cluster_id", F.array_join("incoming_anchor_from", ",").alias("followed_from"))


@query(f"SELECT 'chk:text:' || s.doc_id || ':' || s.seq AS id FROM ({SECTIONS_SQL}) s JOIN {CLUSTERS_SQL} c USING (doc_id) WHERE c.cluster_id = (SELECT cluster_id FROM {CLUSTERS_SQL} WHERE doc_id = 5) AND s.doc_id <> 5")
def cluster_peers(spark, sf_dir):
    return graph_query.cluster_peers(line_chunks(spark, sf_dir), source_clusters(spark, sf_dir), "chk:text:5:0").select("id")


@query(f"SELECT 'chk:text:' || s.doc_id || ':' || s.seq AS id FROM ({SECTIONS_SQL}) s JOIN {CLUSTERS_SQL} c USING (doc_id) WHERE c.cluster_id = 3")
def by_cluster(spark, sf_dir):
    return graph_query.by_cluster(line_chunks(spark, sf_dir), source_clusters(spark, sf_dir), 3).select("id")


@query(f"""SELECT (SELECT count(*) FROM documents) AS docs_total, count(*) AS chunks_total, count(DISTINCT cluster_id) AS clusters_total, 0::BIGINT AS unclustered_docs,
 (SELECT count(*) FROM {PAGE_LINKS_SQL} WHERE NOT ext) AS links_unresolved, (SELECT count(*) FROM {PAGE_LINKS_SQL} WHERE ext) AS links_resolved_no_target,
 (SELECT min(n) FROM (SELECT count(*) AS n FROM ({SECTIONS_SQL}) GROUP BY doc_id)) AS chunks_min, (SELECT max(n) FROM (SELECT count(*) AS n FROM ({SECTIONS_SQL}) GROUP BY doc_id)) AS chunks_max
 FROM ({SECTIONS_SQL}) JOIN {CLUSTERS_SQL} USING (doc_id)""")
def corpus_report(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(doc_key().alias("id"))
    links = page_links(spark, sf_dir).withColumn("target_document", F.lit(None).cast("string"))
    t = analysis.corpus_totals(docs, line_chunks(spark, sf_dir), links, source_clusters(spark, sf_dir))
    return t.select("docs_total", "chunks_total", "clusters_total", "unclustered_docs", "links_unresolved", "links_resolved_no_target", "chunks_min", "chunks_max")


@query(f"SELECT cluster_id, count(*) AS n_chunks FROM ({SECTIONS_SQL}) JOIN {CLUSTERS_SQL} USING (doc_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_clusters(spark, sf_dir):
    return analysis.top_clusters(line_chunks(spark, sf_dir), source_clusters(spark, sf_dir))


@query(f"""SELECT cluster_id, string_agg(line, ' · ' ORDER BY r) AS label FROM (SELECT cluster_id, line, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, line) AS r FROM
 (SELECT cluster_id, {FIRST_LINE_SQL} AS line, count(*) AS n FROM documents JOIN {CLUSTERS_SQL} USING (doc_id) GROUP BY 1, 2) WHERE line IS NOT NULL) WHERE r <= 3 GROUP BY 1""")
def cluster_label(spark, sf_dir):
    whole = read(spark, sf_dir, "documents").select(doc_key().alias("document_id"), "text")
    return analysis.cluster_labels(whole, source_clusters(spark, sf_dir))


@query("""SELECT o.p_brand AS from_cluster, t.p_brand AS to_cluster, count(*) AS n_links FROM lineitem JOIN part o ON o.p_partkey = 1 + l_orderkey % (SELECT count(*) FROM part) JOIN part t ON t.p_partkey = l_partkey WHERE o.p_brand <> t.p_brand GROUP BY 1, 2""")
def related_clusters(spark, sf_dir):
    parts = read(spark, sf_dir, "part").count()
    links = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("doc:part:"), F.col("l_orderkey") % parts + 1).alias("document_id"), F.concat(F.lit("doc:part:"), F.col("l_partkey")).alias("target_document"))
    return analysis.related_clusters(links, part_clusters(spark, sf_dir))


@query(f"""SELECT 'chk:text:' || doc_id || ':' || seq AS id, sha256(concat_ws(chr(10) || chr(10), lag(text) OVER w, text, lead(text) OVER w)) AS context_sha FROM ({SECTIONS_SQL}) WINDOW w AS (PARTITION BY doc_id ORDER BY seq)""")
def context_window(spark, sf_dir):
    return analysis.with_context(line_chunks(spark, sf_dir)).select("id", F.sha2("context", 256).alias("context_sha"))


def order_doc_links(spark, sf_dir):
    return order_links(spark, sf_dir).select("document_id", "target_document", "resolved")


@query("SELECT id, count(*) AS degree FROM (SELECT 'doc:order:' || l_orderkey AS id FROM lineitem UNION ALL SELECT 'doc:part:' || l_partkey FROM lineitem) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def degree_top_nodes(spark, sf_dir):
    return analysis.top_nodes(order_doc_links(spark, sf_dir))


@query("""WITH e AS (SELECT 'doc:order:' || l_orderkey AS a, 'doc:part:' || l_partkey AS b FROM lineitem), k AS (SELECT id FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 50)
SELECT CASE WHEN a IN (SELECT id FROM k) THEN a ELSE '_others' END AS src, CASE WHEN b IN (SELECT id FROM k) THEN b ELSE '_others' END AS dst FROM e WHERE a IN (SELECT id FROM k) OR b IN (SELECT id FROM k)""")
def mermaid_edges(spark, sf_dir):
    return analysis.collapsed_edges(order_doc_links(spark, sf_dir))


@query(f"SELECT 'chk:text:' || doc_id || ':' || seq AS chunk_id, 'doc:text:' || doc_id AS document_id, {FIRST_LINE_SQL.replace('text', 'd.text')} AS document_title, d.source AS source_id, n_chars AS version, seq, s.text, c.cluster_id FROM ({SECTIONS_SQL}) s JOIN documents d USING (doc_id) JOIN {CLUSTERS_SQL} c USING (doc_id)")
def export_records(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(doc_key().alias("id"), tx.first_line(F.col("text")).alias("title"), F.col("source").alias("source_id"), F.col("n_chars").alias("version"), F.lit(None).cast("timestamp").alias("deleted_at"))
    chunks = line_chunks(spark, sf_dir).withColumn("outgoing_links", F.array())
    none = spark.createDataFrame([], "from_chunk_id string, to_chunk_id string, channel string")
    rows = analysis.export_records(docs, graph_query.enriched_chunks(chunks, source_clusters(spark, sf_dir), none))
    return rows.select("chunk_id", "document_id", "document_title", "source_id", "version", F.col("seq").cast("long").alias("seq"), "text", "cluster_id")


def order_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.unix_timestamp("o_orderdate").alias("v"))
    stored = o.where("id % 10 <> 1").select("id", F.when(F.col("id") % 5 == 0, F.col("v") + 1).otherwise(F.col("v")).alias("version"), F.when(F.col("id") % 7 == 0, F.timestamp_seconds(F.lit(1))).alias("deleted_at"))
    return stored, o.where("id % 11 <> 3").select("id", F.col("v").alias("version"))


DIFF_SQL = """(SELECT coalesce(s.id, i.id) AS id, CASE WHEN i.id IS NULL THEN CASE WHEN s.id % 7 <> 0 THEN 'deleted' END WHEN s.id IS NULL THEN 'created' WHEN s.id % 7 = 0 THEN 'resurrected' WHEN s.id % 5 <> 0 THEN 'skipped' ELSE 'updated' END AS status
 FROM (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 10 <> 1) s FULL JOIN (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 11 <> 3) i ON s.id = i.id)"""


@query(f"SELECT * FROM {DIFF_SQL} WHERE status IS NOT NULL")
def sync_diff(spark, sf_dir):
    return sync.sync_diff(*order_snapshots(spark, sf_dir))


@query("SELECT " + ", ".join(f"count(*) FILTER (status = '{n}') AS {n}" for n in ("created", "updated", "skipped", "resurrected", "deleted")) + f" FROM {DIFF_SQL}")
def sync_report(spark, sf_dir):
    return sync.sync_counts(sync.sync_diff(*order_snapshots(spark, sf_dir)))
