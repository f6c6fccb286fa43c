"""Queries of the sources: files, wiki pages and issues are written out from the driver's
tables, parsed, built, linked and synced; the SQL states what must come of each row.

Parts become Markdown files, customers wiki pages, orders issues.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.corpus import Corpus
from quillgraph.functions import ids, text as tx
from quillgraph.operators import analysis, chunking as ck, communities, graph_query, resolvers, sync
from quillgraph.plans.catalog import query, read
from quillgraph.sources import build, issues as issue_source, markdown

FENCE = "```"


def _listed(rows: str, items: list[dict[str, str]], columns: dict[str, str]) -> str:
    """DuckDB: for each row of ``rows`` (with k) one row an item; ``columns`` gives name and type, missing values are null."""
    structs = ", ".join("{" + ", ".join(f"'{c}': CAST({item.get(c, 'NULL')} AS {kind})" for c, kind in columns.items()) + "}" for item in items)
    return f"SELECT k, {', '.join(f'u.{c} AS {c}' for c in columns)} FROM (SELECT *, unnest([{structs}]) AS u FROM ({rows}))"


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table over all tasks: parsing costs far more than moving its few columns."""
    return read(spark, sf_dir, name).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


# Markdown ----------------------------------------------------------------------------------
PARTS_SQL = "SELECT p_partkey AS k, p_name AS name, p_type AS kind, p_brand AS brand, p_size AS size, (SELECT count(*) FROM part) AS n FROM part"


def part_files(spark: SparkSession, sf_dir: str, root: bool = True) -> DataFrame:
    """(path, text, updated_at): one file a part, its front matter in turn YAML, TOML, JSON or none; ``root`` adds a last line of links."""
    p = dealt(spark, sf_dir, "part")
    front = """CASE p_partkey % 4
      WHEN 0 THEN concat('---\\ntitle: Part ', p_partkey, '\\ntags: [', p_type, ', s', p_size, ']\\nsize: ', p_size, '\\n---\\n')
      WHEN 1 THEN concat('+++\\ntitle = "Part ', p_partkey, '"\\ntags = ["', p_type, '", "s', p_size, '"]\\nsize = ', p_size, '\\n+++\\n')
      WHEN 2 THEN concat('{"title": "Part ', p_partkey, '", "tags": ["', p_type, '", "s', p_size, '"], "size": ', p_size, '}\\n')
      ELSE '' END"""
    body = f"""concat('# The *', p_name, '* of `', p_type, '`\\n\\nMade in ', p_type, ' style,\\nsize **', p_size, '**.\\n\\n## Overview {{#own-', p_partkey, '}}\\n\\n',
      'See [next](../parts/', p_partkey + 1, '.md#own-', p_partkey + 1, '), [up](./', p_partkey - 1, '.md?x=1) and <https://example.org/', p_partkey, '>.\\n\\n',
      '- ', p_name, '\\n- size ', p_size, '\\n\\n1. first\\n2. second ', p_brand, '\\n\\n| key | size |\\n| --- | ---- |\\n| ', p_partkey, ' | ', p_size, ' |\\n\\n> ', p_name, '\\n> again\\n\\n',
      '{FENCE}py\\nx = ', p_partkey, '\\n{FENCE}\\n\\n***\\n\\n<div>\\nraw ', p_partkey, '\\n</div>\\n\\nSee also\\n--------\\n', {f"'\\n[root](/parts/0.md) [gone](missing/', p_partkey, '.md) ![img](x.png)\\n'" if root else "''"})"""
    return p.select(F.concat(F.lit("parts/"), F.col("p_partkey"), F.lit(".md")).alias("path"), F.expr(f"concat({front}, {body})").alias("text"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("p_partkey")).alias("updated_at"))


_HEAD = "'The ' || name || ' of ' || kind"
BLOCK_COLUMNS = {"seq": "INT", "kind": "VARCHAR", "text": "VARCHAR", "heading_level": "INT", "anchor": "VARCHAR", "navigation": "BOOLEAN"}
MARKDOWN_BLOCKS = [
    {"kind": "'heading'", "text": _HEAD, "heading_level": "1", "anchor": "replace(lower('the ' || name || ' of ' || kind), ' ', '-')"},
    {"kind": "'paragraph'", "text": "'Made in ' || kind || ' style, size ' || size || '.'"},
    {"kind": "'heading'", "text": "'Overview'", "heading_level": "2", "anchor": "'own-' || k"},
    {"kind": "'paragraph'", "text": "'See next, up and https://example.org/' || k || '.'"},
    {"kind": "'list'", "text": "name || chr(10) || 'size ' || size"},
    {"kind": "'list'", "text": "'first' || chr(10) || 'second ' || brand"},
    {"kind": "'table'", "text": "'key size ' || k || ' ' || size"},
    {"kind": "'quote'", "text": "name || ' again'"},
    {"kind": "'code'", "text": "'x = ' || k"},
    {"kind": "'hr'", "text": "''"},
    {"kind": "'html'", "text": "'<div>' || chr(10) || 'raw ' || k || chr(10) || '</div>'"},
    {"kind": "'heading'", "text": "'See also'", "heading_level": "2", "anchor": "'see-also'", "navigation": "true"},
    {"kind": "'paragraph'", "text": "'root gone img'"},
]


def _numbered(blocks: list[dict[str, str]]) -> list[dict[str, str]]:
    return [{"navigation": "false", **b, "seq": str(i)} for i, b in enumerate(blocks)]


def _sections(tables: dict[str, DataFrame]) -> DataFrame:
    return tables["sections"].select("document_id", "seq", "kind", "text", "heading_level", "anchor", "navigation")


@query(f"SELECT 'doc:md:parts/' || k || '.md' AS document_id, * EXCLUDE (k) FROM ({_listed(PARTS_SQL, _numbered(MARKDOWN_BLOCKS), BLOCK_COLUMNS)})")
def markdown_blocks(spark, sf_dir):
    return _sections(build.markdown_corpus(part_files(spark, sf_dir), "md"))


@query(f"""SELECT 'doc:md:parts/' || k || '.md' AS id, CASE WHEN k % 4 = 3 THEN {_HEAD} ELSE 'Part ' || k END AS title, 'markdown' AS kind, 1700000000 + k AS version,
 ['yaml', 'toml', 'json', 'none'][k % 4 + 1] AS format, CASE WHEN k % 4 < 3 THEN kind || ',s' || size ELSE '' END AS tags, CASE WHEN k % 4 < 3 THEN size::VARCHAR END AS size FROM ({PARTS_SQL})""")
def markdown_documents(spark, sf_dir):
    d = build.markdown_corpus(part_files(spark, sf_dir), "md")["documents"]
    m = lambda path: F.get_json_object("metadata", path)
    return d.select("id", "title", "kind", "version", m("$.frontmatter_format").alias("format"), F.array_join(F.from_json(m("$.tags"), "array<string>"), ",").alias("tags"), F.get_json_object(m("$.frontmatter"), "$.size").alias("size"))


LINK_COLUMNS = {"section_seq": "INT", "seq": "INT", "kind": "VARCHAR", "target_path": "VARCHAR", "target_anchor": "VARCHAR", "target_document": "VARCHAR", "resolved": "BOOLEAN"}
MARKDOWN_LINKS = [
    {"section_seq": "3", "seq": "0", "kind": "'internal'", "target_path": "'../parts/' || (k + 1) || '.md'", "target_anchor": "'own-' || (k + 1)", "target_document": "CASE WHEN k + 1 < n THEN 'doc:md:parts/' || (k + 1) || '.md' END"},
    {"section_seq": "3", "seq": "1", "kind": "'internal'", "target_path": "'./' || (k - 1) || '.md'", "target_document": "CASE WHEN k > 0 THEN 'doc:md:parts/' || (k - 1) || '.md' END"},
    {"section_seq": "3", "seq": "2", "kind": "CASE WHEN k % 2 = 0 THEN 'internal' ELSE 'external' END", "target_path": "CASE WHEN k % 2 = 0 THEN 'parts/' || k || '.md' END", "target_anchor": "CASE WHEN k % 2 = 0 THEN 'top' END", "target_document": "CASE WHEN k % 2 = 0 THEN 'doc:md:parts/' || k || '.md' END"},
    {"section_seq": "12", "seq": "0", "kind": "'internal'", "target_path": "'/parts/0.md'", "target_document": "'doc:md:parts/0.md'"},
    {"section_seq": "12", "seq": "1", "kind": "'internal'", "target_path": "'missing/' || k || '.md'"},
]


def _rewritten(href):
    """A corpus path for the addresses of even parts."""
    return F.when(href.rlike("[02468]$"), F.concat(F.lit("parts/"), F.regexp_extract(href, "([0-9]+)$", 1), F.lit(".md#top")))


def _part_links(spark, sf_dir) -> tuple[dict[str, DataFrame], DataFrame]:
    tables = build.markdown_corpus(part_files(spark, sf_dir), "md")
    return tables, resolvers.resolve_files(tables["links"], tables["documents"], _rewritten)


@query(f"SELECT 'doc:md:parts/' || k || '.md' AS document_id, * EXCLUDE (k) FROM ({_listed(PARTS_SQL, [{'resolved': 'true', **x} for x in MARKDOWN_LINKS], LINK_COLUMNS)})")
def markdown_links(spark, sf_dir):
    links = _part_links(spark, sf_dir)[1]
    return links.select("document_id", "section_seq", "seq", "kind", F.col("metadata")["target_path"].alias("target_path"), "target_anchor", "target_document", "resolved")


@query(f"SELECT 'doc:md:parts/' || k || '.md' AS document_id, 3 AS section_seq, 'top' AS target_anchor FROM ({PARTS_SQL}) WHERE k % 2 = 0")
def dangling_anchors(spark, sf_dir):
    tables, links = _part_links(spark, sf_dir)
    return graph_query.dangling_anchors(links, tables["sections"]).select("document_id", "section_seq", "target_anchor")


@query(f"SELECT 'doc:md:parts/' || k || '.md' AS document_id, unnest(CASE WHEN k + 1 < n THEN ['missing'] ELSE ['missing', 'next'] END || CASE WHEN k = 0 THEN ['up'] ELSE [] END) AS what FROM ({PARTS_SQL})")
def dead_file_links(spark, sf_dir):
    found = graph_query.dead_links(_part_links(spark, sf_dir)[1], ("internal",))
    path = F.col("metadata")["target_path"]
    return found.select("document_id", F.when(path.startswith("missing/"), "missing").when(path.startswith("../"), "next").otherwise("up").alias("what"))


FRONT = ["---\\nk: {k}\\n---\\nb", "+++\\nk = {k}\\n+++\\nb", '{"k": {k}}\\nb', "---\\nk: {k}\\nb", "---\\nk: [{k}\\n---\\nb", "b {k}"]


@query("SELECT p_partkey AS k, ['yaml', 'toml', 'json', 'none', 'none', 'none'][p_partkey % 6 + 1] AS format, CASE WHEN p_partkey % 6 < 3 THEN 'b' END AS body, CASE WHEN p_partkey % 6 < 3 THEN p_partkey::VARCHAR END AS value FROM part")
def frontmatter_formats(spark, sf_dir):
    forms = ", ".join("'" + f.replace("'", "\\'") + "'" for f in FRONT)
    files = dealt(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.lit("x.md").alias("path"), F.expr(f"replace(array({forms})[p_partkey % 6], '{{k}}', p_partkey)").alias("text"))
    parsed = markdown.parse_markdown(files)
    fmt = F.col("front.format")
    return parsed.select("k", fmt.alias("format"), F.when(fmt != "none", F.col("sections")[0]["text"]).alias("body"), F.get_json_object("front.frontmatter", "$.k").alias("value"))


HEADINGS = ("What's next", "whats next?", "See  also:", "Related", "related topics", "Related links.", "Further reading", "Дальше", "См. также", "см ещё", "По теме", "Contents", "See also this", "Unrelated", "")


@query("SELECT p_partkey AS k, p_partkey % 15 < 11 AS navigation FROM part")
def navigation_headings(spark, sf_dir):
    listed = ", ".join("'" + h.replace("'", "\\'") + "'" for h in HEADINGS)
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.expr(f"array({listed})[p_partkey % 15]").alias("h"))
    return p.select("k", tx.is_navigation_heading(F.col("h")).alias("navigation"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE epoch_us(ts) END AS us FROM events")
def iso_times(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    shown = F.when(F.col("event_id") % 5 == 0, F.when(F.col("event_id") % 2 == 0, F.lit("not a time"))).when(F.col("event_id") % 5 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))
    return e.select("event_id", F.unix_micros(tx.parse_iso(shown)).alias("us"))


@query("""SELECT o_orderkey AS k, ['a/b/x' || o_orderkey || '.md', 'a/x' || o_orderkey || '.md', 'x' || o_orderkey || '.md', 'r/x' || o_orderkey || '.md', 'x.md', 'a/b/c/' || o_orderkey][o_orderkey % 6 + 1] AS path FROM orders""")
def resolve_dotted_paths(spark, sf_dir):
    forms = ["./x{k}.md", "../x{k}.md", "../../../x{k}.md", "/r/./q/../x{k}.md", "../../x.md", "c\\\\{k}"]
    listed = ", ".join(f"'{f}'" for f in forms)
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.expr(f"replace(array({listed})[o_orderkey % 6], '{{k}}', o_orderkey)").alias("p"))
    return o.select("k", tx.resolve_path(F.lit("a/b/here.md"), F.col("p")).alias("path"))


# Wiki pages ----------------------------------------------------------------------------------
CUSTOMERS_SQL = "SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg, (SELECT count(*) FROM customer) AS n FROM customer"


def customer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, space, title, version, updated_at, labels, parent, body): every tenth body is malformed, every third page has no time."""
    macro = lambda name, body: f'<ac:structured-macro ac:name="{name}">{body}</ac:structured-macro>'
    para = lambda name, body: f'<ac:parameter ac:name="{name}">{body}</ac:parameter>'
    body = (
        '<h1 id="c{k}">{name} &amp; &eacute;{k}</h1><p>Segment <b>{seg}</b> of <ac:link ac:anchor="a{k}"><ri:page ri:content-title="Page {k1}" ri:space-key="S{s1}"/><ac:plain-text-link-body><![CDATA[next {k}]]></ac:plain-text-link-body></ac:link> and <a href="https://e.org/{k}">site</a>.</p>'
        + '<ac:structured-macro ac:name="toc"/>' + macro("anchor", para("", "here{k}")) + "<ul><li>one {k}</li><li>two</li></ul>"
        + macro("code", para("language", "sql") + "<ac:plain-text-body><![CDATA[select {k} < 1]]></ac:plain-text-body>")
        + macro("info", para("title", "T{k}") + "<ac:rich-text-body><p>note {k}</p></ac:rich-text-body>") + macro("expand", "<ac:rich-text-body><p>more {k}</p></ac:rich-text-body>")
        + "<table><tbody><tr><th>bal</th><td>{k}</td></tr></tbody></table><blockquote><p>q {k}</p></blockquote><hr/><pre>raw {k}</pre>" + macro("jira", para("key", "AB-{k}"))
        + macro("include", para("", '<ac:link><ri:page ri:content-title="Page {k2}" ri:space-key="S{s2}"/></ac:link>'))
        + '<p><ac:link><ri:attachment ri:filename="f{k}.txt"/></ac:link><ac:link><ri:user ri:account-id="u{k}"/></ac:link></p><h2>См. также</h2><section>odd {k}</section>'
    )
    c = dealt(spark, sf_dir, "customer").withColumns({"k": F.col("c_custkey"), "bad": F.col("c_custkey") % 10 == 9})
    text = F.when(F.col("bad"), F.lit("<p>open {k}<p>two")).otherwise(F.lit(body))
    for name, value in {"k1": "k + 1", "k2": "k + 2", "s1": "(k + 1) % 3", "s2": "(k + 2) % 3", "name": "c_name", "seg": "c_mktsegment", "k": "k"}.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.expr(f"cast({value} AS string)"))
    return c.select(
        F.col("k").cast("string").alias("id"), F.expr("concat('S', k % 3)").alias("space"), F.expr("concat('Page ', k)").alias("title"), (F.col("k") % 7).alias("version"),
        F.expr("CASE WHEN k % 3 > 0 THEN date_format(timestamp_seconds(1700000000 + k), \"yyyy-MM-dd'T'HH:mm:ss'Z'\") END").alias("updated_at"),
        F.expr("array(c_mktsegment)").alias("labels"), F.expr("CASE WHEN k > 0 THEN cast(k div 2 AS string) END").alias("parent"), text.alias("body"),
    )


PAGE_BLOCKS = [
    {"kind": "'heading'", "text": "name || ' & é' || k", "heading_level": "1", "anchor": "'c' || k"},
    {"kind": "'paragraph'", "text": "'Segment ' || seg || ' of next ' || k || ' and site .'"},
    {"kind": "'list'", "text": "'one ' || k || ' two'", "anchor": "'here' || k"},
    {"kind": "'code'", "text": "'select ' || k || ' < 1'"},
    {"kind": "'callout'", "text": "'note ' || k"},
    {"kind": "'expand'", "text": "'more ' || k"},
    {"kind": "'table'", "text": "'bal ' || k"},
    {"kind": "'quote'", "text": "'q ' || k"},
    {"kind": "'hr'", "text": "''"},
    {"kind": "'code'", "text": "'raw ' || k"},
    {"kind": "'unknown'", "text": "''"},
    {"kind": "'include_page'", "text": "''"},
    {"kind": "'paragraph'", "text": "''"},
    {"kind": "'heading'", "text": "'См. также'", "heading_level": "2", "navigation": "true"},
    {"kind": "'unknown'", "text": "'odd ' || k"},
]
BAD_BLOCKS = [{"kind": "'paragraph'", "text": "'open ' || k"}, {"kind": "'paragraph'", "text": "'two'"}]


@query(f"SELECT 'doc:wiki:' || k AS document_id, * EXCLUDE (k) FROM ({_listed(f'SELECT * FROM ({CUSTOMERS_SQL}) WHERE k % 10 < 9', _numbered(PAGE_BLOCKS), BLOCK_COLUMNS)} UNION ALL {_listed(f'SELECT * FROM ({CUSTOMERS_SQL}) WHERE k % 10 = 9', _numbered(BAD_BLOCKS), BLOCK_COLUMNS)})")
def page_blocks(spark, sf_dir):
    return _sections(build.page_corpus(customer_pages(spark, sf_dir), "wiki"))


@query(f"SELECT 'doc:wiki:' || k AS document_id, * EXCLUDE (k) FROM ({_listed(f'SELECT * FROM ({CUSTOMERS_SQL}) WHERE k % 10 < 9', [{'seq': '3', 'name': repr('language'), 'value': repr('sql')}, {'seq': '4', 'name': repr('callout_type'), 'value': repr('info')}, {'seq': '4', 'name': repr('title'), 'value': "'T' || k"}, {'seq': '2', 'name': repr('list_kind'), 'value': repr('ul')}, {'seq': '10', 'name': repr('macro'), 'value': repr('jira')}, {'seq': '11', 'name': repr('title'), 'value': "'Page ' || (k + 2)"}, {'seq': '11', 'name': repr('space'), 'value': "'S' || (k + 2) % 3"}, {'seq': '14', 'name': repr('tag'), 'value': repr('section')}], {'seq': 'INT', 'name': 'VARCHAR', 'value': 'VARCHAR'})})")
def page_block_metadata(spark, sf_dir):
    s = build.page_corpus(customer_pages(spark, sf_dir), "wiki")["sections"]
    return s.select("document_id", "seq", F.explode(F.from_json("metadata", "map<string,string>")).alias("name", "value"))


@query(f"""SELECT 'doc:wiki:' || k AS id, 'Page ' || k AS title, 'page' AS kind, k % 7 AS version, CASE WHEN k % 3 > 0 THEN 1700000000 + k ELSE 0 END AS updated, 'S' || k % 3 AS space, seg AS label,
 CASE WHEN k > 0 THEN 'doc:wiki:' || (k // 2) END AS parent FROM ({CUSTOMERS_SQL})""")
def page_documents(spark, sf_dir):
    d = build.page_corpus(customer_pages(spark, sf_dir), "wiki")["documents"]
    m = lambda path: F.get_json_object("metadata", path)
    return d.select("id", "title", "kind", "version", F.unix_seconds("updated_at").alias("updated"), m("$.space").alias("space"), m("$.labels[0]").alias("label"), m("$.parent").alias("parent"))


PAGE_LINKS = [
    {"section_seq": "1", "seq": "0", "kind": "'page'", "target_anchor": "'a' || k", "target_document": "CASE WHEN k + 1 < n THEN 'doc:wiki:' || (k + 1) END", "detail": "'next ' || k"},
    {"section_seq": "1", "seq": "1", "kind": "'external'", "detail": "'https://e.org/' || k"},
    {"section_seq": "10", "seq": "0", "kind": "'jira'", "detail": "'AB-' || k"},
    {"section_seq": "11", "seq": "0", "kind": "'include'", "target_document": "CASE WHEN k + 2 < n THEN 'doc:wiki:' || (k + 2) END"},
    {"section_seq": "12", "seq": "0", "kind": "'attachment'", "detail": "'f' || k || '.txt'"},
    {"section_seq": "12", "seq": "1", "kind": "'user'", "detail": "'u' || k"},
]


@query(f"SELECT 'doc:wiki:' || k AS document_id, true AS resolved, * EXCLUDE (k) FROM ({_listed(f'SELECT * FROM ({CUSTOMERS_SQL}) WHERE k % 10 < 9', PAGE_LINKS, {**{c: t for c, t in LINK_COLUMNS.items() if c not in ('target_path', 'resolved')}, 'detail': 'VARCHAR'})})")
def page_storage_links(spark, sf_dir):
    tables = build.page_corpus(customer_pages(spark, sf_dir), "wiki")
    documents = tables["documents"].withColumn("space", F.get_json_object("metadata", "$.space"))
    links = resolvers.resolve_pages(tables["links"], documents)
    m = F.col("metadata")
    detail = F.coalesce(m["filename"], m["user"], m["key"], m["href"], m["label"])
    return links.select("document_id", "resolved", "section_seq", "seq", "kind", "target_anchor", "target_document", detail.alias("detail"))


# Issues ----------------------------------------------------------------------------------------
ORDERS_SQL = "SELECT o_orderkey AS k, o_orderstatus AS st, o_orderpriority AS pri, o_custkey AS c, (SELECT count(*) FROM orders) AS n FROM orders"
WIKI_BODY = "h2. Order *{k}* [site|http://e.org]\\nStatus {{st}} is _{pri}_\\nsecond line\\n----\\nbq. quoted [{k}]\\n{code:java}\\nint x = {k};\\n{code}\\n{panel:title=P{k}}\\nin *panel*\\n{panel}\\n{noformat}\\na_b_c\\n{noformat}\\n* item {k}\\n# other\\n|a|{k}|\\n|b| |\\n{quote}\\nsaid\\n{quote}\\n{info}\\nopen {k}"
WIKI_BLOCKS = [
    {"kind": "'heading'", "text": "'Order ' || k || ' site'", "heading_level": "2"},
    {"kind": "'paragraph'", "text": "'Status st is ' || pri || ' second line'"},
    {"kind": "'hr'", "text": "''"},
    {"kind": "'quote'", "text": "'quoted ' || k"},
    {"kind": "'code'", "text": "'int x = ' || k || ';'"},
    {"kind": "'panel'", "text": "'in panel'"},
    {"kind": "'code'", "text": "'a_b_c'"},
    {"kind": "'list'", "text": "'item ' || k || chr(10) || 'other'"},
    {"kind": "'table'", "text": "'a ' || k || ' b'"},
    {"kind": "'quote'", "text": "'said'"},
    {"kind": "'panel'", "text": "'open ' || k"},
    {"kind": "'comment'", "text": "'hi ' || k"},
]
_T = '{"type":"text","text":"%s"}'
_P = '{"type":"paragraph","content":[%s]}'
ADF_BODY = (
    '{"type":"doc","content":[{"type":"heading","attrs":{"level":3},"content":[' + _T % "H {k}" + "]},"
    + _P % (_T % "a " + ',{"type":"mention","attrs":{"text":"@u{k}"}},{"type":"hardBreak"},{"type":"emoji","attrs":{"shortName":":x:"}},{"type":"inlineCard","attrs":{"url":"http://e/{k}"}}')
    + ',{"type":"bulletList","content":[{"type":"listItem","content":[' + _P % (_T % "one {k}") + ']},{"type":"listItem","content":[' + _P % (_T % "two") + "]}]}"
    + ',{"type":"codeBlock","attrs":{"language":"py"},"content":[' + _T % "x = {k}" + ']},{"type":"blockquote","content":[' + _P % (_T % "q") + ']}'
    + ',{"type":"table","content":[{"type":"tableRow","content":[{"type":"tableCell","content":[' + _P % (_T % "c1") + ']},{"type":"tableCell","content":[' + _P % (_T % "{k}") + "]}]}]}"
    + ',{"type":"panel","attrs":{"panelType":"note"},"content":[' + _P % (_T % "careful") + ']},{"type":"rule"},{"type":"odd"}]}'
)
ADF_BLOCKS = [
    {"kind": "'heading'", "text": "'H ' || k", "heading_level": "3"},
    {"kind": "'paragraph'", "text": "'a @u' || k || ' :x:http://e/' || k"},
    {"kind": "'list'", "text": "'one ' || k || ' two'"},
    {"kind": "'code'", "text": "'x = ' || k"},
    {"kind": "'quote'", "text": "'q'"},
    {"kind": "'table'", "text": "'c1 ' || k"},
    {"kind": "'panel'", "text": "'careful'"},
    {"kind": "'hr'", "text": "''"},
    {"kind": "'unknown'", "text": "''"},
    {"kind": "'comment'", "text": "'hi ' || k"},
]


def order_issues(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Typed rows of the issues: even orders in wiki markup, odd ones in rich-text JSON."""
    body = F.lit(WIKI_BODY.replace("\\n", "\n")) if kind == "wiki" else F.lit(ADF_BODY)
    said = F.lit("hi *{k}*") if kind == "wiki" else F.lit('{"type":"doc","content":[' + _P % (_T % "hi {k}") + "]}")
    o = dealt(spark, sf_dir, "orders").where(F.col("o_orderkey") % 2 == (0 if kind == "wiki" else 1)).withColumn("k", F.col("o_orderkey").cast("string"))
    put = lambda c: F.replace(F.replace(c, F.lit("{k}"), F.col("k")), F.lit("{pri}"), F.col("o_orderpriority"))
    key = lambda expr: F.expr(f"concat('OR-', {expr})")
    name = lambda c: F.struct(c.alias("name"))
    user = lambda c: F.struct(F.lit("").alias("displayName"), c.alias("accountId"))
    other = lambda expr: F.struct(key(expr).alias("key"), F.struct(F.expr(f"concat('Order ', {expr})").alias("summary")).alias("fields"))
    fields = F.struct(
        F.expr("concat('Order ', k)").alias("summary"), put(body).alias("description"), F.when(F.col("o_orderkey") % 3 > 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSSZ")).alias("updated"), F.array("o_orderstatus").alias("labels"),
        F.struct(F.lit("OR").alias("key")).alias("project"), name(F.lit("Task")).alias("issuetype"), name(F.col("o_orderstatus")).alias("status"), name(F.col("o_orderpriority")).alias("priority"), user(F.expr("concat('u', o_custkey)")).alias("reporter"),
        F.when(F.col("o_orderkey") % 5 == 0, F.struct(key("o_orderkey div 10").alias("key"))).alias("parent"),
        F.array(other("o_orderkey + 1")).alias("subtasks"),
        F.array(F.struct(name(F.lit("blocks")).alias("type"), other("o_orderkey + 2").alias("outwardIssue")), F.struct(name(F.lit("relates")).alias("type"), F.lit(None).cast("struct<key:string,fields:struct<summary:string>>").alias("outwardIssue"))).alias("issuelinks"),
        F.struct(F.array(F.struct(user(F.expr("concat('c', k)")).alias("author"), F.lit("2024-01-01").alias("created"), put(said).alias("body"))).alias("comments")).alias("comment"),
    )
    raw = o.select(F.to_json(F.struct(F.expr("concat('OR-', k)").alias("key"), fields.alias("fields"))).alias("json"))
    return issue_source.issue_rows(raw, kind)


def _issue_tables(spark, sf_dir) -> dict[str, DataFrame]:
    wiki, adf = (build.issue_corpus(order_issues(spark, sf_dir, kind), "jira") for kind in ("wiki", "adf"))
    return {name: wiki[name].unionByName(adf[name]) for name in wiki}


@query(f"SELECT 'doc:jira:OR-' || k AS document_id, * EXCLUDE (k) FROM ({_listed(f'SELECT * FROM ({ORDERS_SQL}) WHERE k % 2 = 0', _numbered(WIKI_BLOCKS), BLOCK_COLUMNS)})")
def wiki_issue_blocks(spark, sf_dir):
    return _sections(build.issue_corpus(order_issues(spark, sf_dir, "wiki"), "jira"))


@query(f"SELECT 'doc:jira:OR-' || k AS document_id, * EXCLUDE (k) FROM ({_listed(f'SELECT * FROM ({ORDERS_SQL}) WHERE k % 2 = 1', _numbered(ADF_BLOCKS), BLOCK_COLUMNS)})")
def adf_issue_blocks(spark, sf_dir):
    return _sections(build.issue_corpus(order_issues(spark, sf_dir, "adf"), "jira"))


@query("""SELECT 'doc:jira:OR-' || o_orderkey AS id, 'Order ' || o_orderkey AS title, 'issue' AS kind, CASE WHEN o_orderkey % 3 > 0 THEN CAST(epoch(o_orderdate) AS BIGINT) ELSE 0 END AS version, o_orderstatus AS status, o_orderpriority AS priority, o_orderstatus AS label,
 'u' || o_custkey AS reporter, CASE WHEN o_orderkey % 5 = 0 THEN 'doc:jira:OR-' || (o_orderkey // 10) END AS parent FROM orders""")
def issue_documents(spark, sf_dir):
    d = _issue_tables(spark, sf_dir)["documents"]
    m = lambda path: F.get_json_object("metadata", path)
    return d.select("id", "title", "kind", "version", m("$.status").alias("status"), m("$.priority").alias("priority"), m("$.labels[0]").alias("label"), m("$.reporter").alias("reporter"), m("$.parent").alias("parent"))


ISSUE_LINKS = [
    {"seq": "0", "kind": "'issue_link'", "target_document": "CASE WHEN k + 2 < n THEN 'doc:jira:OR-' || (k + 2) END", "target_key": "'OR-' || (k + 2)", "link_type": "'blocks'", "direction": "'outward'"},
    {"seq": "1", "kind": "'subtask'", "target_document": "CASE WHEN k + 1 < n THEN 'doc:jira:OR-' || (k + 1) END", "target_key": "'OR-' || (k + 1)"},
    {"seq": "2", "kind": "CASE WHEN k % 5 = 0 THEN 'parent' END", "target_document": "'doc:jira:OR-' || (k // 10)", "target_key": "'OR-' || (k // 10)"},
]


@query(f"SELECT 'doc:jira:OR-' || k AS document_id, true AS resolved, * EXCLUDE (k) FROM ({_listed(ORDERS_SQL, ISSUE_LINKS, {c: 'VARCHAR' if c != 'seq' else 'INT' for c in ('seq', 'kind', 'target_document', 'target_key', 'link_type', 'direction')})}) WHERE kind IS NOT NULL")
def issue_links(spark, sf_dir):
    tables = _issue_tables(spark, sf_dir)
    links = resolvers.resolve_issues(tables["links"], tables["documents"])
    m = F.col("metadata")
    return links.select("document_id", "resolved", "seq", "kind", "target_document", m["target_key"].alias("target_key"), m["link_type"].alias("link_type"), m["direction"].alias("direction"))


# Jobs ------------------------------------------------------------------------------------------
CHUNKER = ck.PolicyChunker(ck.policy([ck.min_size(100_000)]))  # a chunk a document


def _snapshot(spark, sf_dir, later: bool) -> dict[str, DataFrame]:
    """The parts as files; later every tenth is gone and every tenth but one is newer."""
    files = part_files(spark, sf_dir, root=False).withColumn("k", F.regexp_extract("path", "([0-9]+)", 1).cast("long"))
    if later:
        files = files.where("k % 10 <> 0").withColumn("updated_at", F.expr("CASE WHEN k % 10 = 1 THEN updated_at + interval 1 day ELSE updated_at END"))
    return build.markdown_corpus(files.drop("k"), "md")


def _synced(spark, sf_dir) -> tuple[Corpus, list[sync.SyncReport]]:
    corpus = Corpus(spark, f"{communities.shared_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}", "md")
    return corpus, [sync.sync(corpus, *_snapshot(spark, sf_dir, later).values(), CHUNKER, resolvers.resolve_files) for later in (False, True)]


@query("""SELECT 'doc:md:parts/' || p_partkey || '.md' AS id, p_partkey % 10 = 0 AS deleted, CASE WHEN p_partkey % 10 = 1 THEN 2 ELSE 1 END AS graph_version, 1700000000 + p_partkey + CASE WHEN p_partkey % 10 = 1 THEN 86400 ELSE 0 END AS version,
 CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE 1 END AS chunks, CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE 12 END AS sections, CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE 3 END AS links FROM part""")
def sync_job(spark, sf_dir):
    corpus, _ = _synced(spark, sf_dir)
    docs = corpus.table("documents").select("id", F.col("deleted_at").isNotNull().alias("deleted"), "graph_version", "version")
    for name in ("chunks", "sections", "links"):
        docs = docs.join(corpus.table(name).groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias(name)), "id", "left").fillna(0, [name])
    return docs


@query("""SELECT * FROM (VALUES (1)) AS v(run), (SELECT count(*) AS created, 0 AS updated, 0 AS skipped, 0 AS deleted, 1 AS graph_version FROM part)
 UNION ALL SELECT 2, 0, count(*) FILTER (p_partkey % 10 = 1), count(*) FILTER (p_partkey % 10 > 1), count(*) FILTER (p_partkey % 10 = 0), 2 FROM part""")
def sync_job_reports(spark, sf_dir):
    _, reports = _synced(spark, sf_dir)
    return spark.createDataFrame([(i + 1, r.created, r.updated, r.skipped, r.deleted, r.graph_version) for i, r in enumerate(reports)], "run int, created long, updated long, skipped long, deleted long, graph_version long")


@query("""WITH t AS (SELECT p_partkey AS k, unnest([p_partkey + 1, p_partkey - 1]) AS d FROM part WHERE p_partkey % 10 <> 0), u AS (SELECT k, d FROM t WHERE d >= 0 AND d < (SELECT count(*) FROM part) AND (d % 10 <> 0 OR k % 10 <> 1)),
 s AS (SELECT k, count(*) AS n FROM u GROUP BY 1), p AS (SELECT a.k AS x, b.k AS y, count(*) AS c FROM u a JOIN u b ON a.d = b.d AND a.k <> b.k GROUP BY 1, 2)
 SELECT count(*) FILTER (p_partkey % 10 <> 0) AS documents, count(*) FILTER (p_partkey % 10 <> 0) AS chunks, 3 AS graph_version,
 (SELECT count(*) FROM p JOIN s ON s.k = p.x WHERE s.n >= 2) AS same_target, (SELECT count(*) FROM u WHERE d = k + 1 AND d % 10 <> 0) AS anchor_follow, (SELECT count(*) FROM (SELECT k FROM u UNION SELECT d FROM u)) AS clustered FROM part""")
def rechunk_job(spark, sf_dir):
    """Chunks, relations and clusters made again from what is stored; links resolved before their target went keep it."""
    corpus, _ = _synced(spark, sf_dir)
    report = sync.rechunk(corpus, CHUNKER)
    sync.recompute_clusters(corpus)
    counts = {r["channel"]: r["count"] for r in corpus.table("relations").groupBy("channel").count().collect()}
    row = (report["documents"], report["chunks"], report["graph_version"], counts.get("same_target", 0), counts.get("anchor_follow", 0), corpus.table("clusters").count())
    return spark.createDataFrame([row], "documents long, chunks long, graph_version long, same_target long, anchor_follow long, clustered long")


@query("SELECT c_custkey AS document_id, c_custkey // 5 * 5 AS leader FROM customer WHERE (SELECT max(c_custkey) FROM customer) > c_custkey // 5 * 5")
def communities_of_cliques(spark, sf_dir):
    """Customers in cliques of five: each clique is a community, led by its least member."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    edges = c.withColumn("other", F.explode(F.expr("transform(array(1, 2, 3, 4), i -> k div 5 * 5 + (k % 5 + i) % 5)"))).join(c.select(F.col("k").alias("other")), "other")
    found = communities.communities(edges.select(F.col("k").alias("document_id"), F.col("other").alias("target_document")))
    return found.select("document_id", "leader")


# Reads -----------------------------------------------------------------------------------------
@query("SELECT 'doc:order:' || o_orderkey AS document_id, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey % 7 END AS cluster_id FROM orders")
def doc_cluster_map(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(ids.document_id(F.lit("order"), F.col("o_orderkey").cast("string")).alias("document_id"), "o_orderkey", (F.col("o_custkey") % 7).alias("cluster_id"))
    chunks = o.select("document_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("seq"))
    return analysis.doc_cluster_map(chunks, o.where("o_orderkey % 3 > 0"))


@query("SELECT 'chk:line:' || l_orderkey || ':' || l_linenumber AS id, l_partkey AS cluster_id FROM lineitem WHERE l_orderkey = 5 UNION ALL SELECT 'chk:line:' || l_orderkey || ':' || l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = 7 AND l_linenumber = 1")
def chunk_lookup(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")
    chunks = l.select(F.concat_ws(":", F.lit("chk:line"), "l_orderkey", "l_linenumber").alias("id"), F.concat_ws(":", F.lit("doc:line"), "l_orderkey").alias("document_id"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("cluster_id"))
    return graph_query.get_chunks(chunks, "doc:line:5").union(graph_query.get_chunk(chunks, "chk:line:7:1")).select("id", "cluster_id")
