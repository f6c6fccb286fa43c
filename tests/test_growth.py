"""What must hold for tables of any size: where rows are parsed, what joins may broadcast."""

import datetime

from pyspark.sql import functions as F

from quillgraph.operators import chunking as ck, graph_query, relations, resolvers
from quillgraph.sources import build, issues


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files(spark, n=700):
    at = datetime.datetime(2026, 1, 1)
    return spark.createDataFrame([(f"d/{i}.md", f"---\ntitle: T{i}\n---\n# H{i}\n\n[a](x{i}.md) <https://e.org/{i}>\n", at) for i in range(n)], "path string, text string, updated_at timestamp")


def below_exchange(df):
    """What is done before the rows are dealt."""
    return plan(df).split("Exchange RoundRobinPartitioning", 1)[1]


def test_files_are_parsed_once_and_after_they_are_dealt(spark):
    tables = build.markdown_corpus(files(spark).repartition(3), "s")
    for name in tables:
        assert plan(tables[name]).count("ArrowEvalPython") == 1 and "EvalPython" not in below_exchange(tables[name])
    assert "EvalPython" not in plan(tables["documents"].select("id"))
    got = tables["sections"].where("kind = 'heading'").select("document_id", "text").collect()  # more rows than a parser holds
    assert sorted(map(tuple, got)) == sorted((f"doc:s:d/{i}.md", f"H{i}") for i in range(700))
    assert tables["links"].count() == 1400 and {r["title"] for r in tables["documents"].collect()} == {f"T{i}" for i in range(700)}


def test_lookups_are_not_broadcast(spark, tmp_path):
    files(spark).write.parquet(str(tmp_path / "f"))  # a small file, whatever comes of it
    tables = build.markdown_corpus(spark.read.parquet(str(tmp_path / "f")), "s")
    links = resolvers.resolve_files(tables["links"], tables["documents"], lambda href: F.regexp_extract(href, "([0-9]+)$", 1))
    for df in (links, graph_query.dangling_anchors(links, tables["sections"])):
        assert "Broadcast" not in plan(df)


def test_pairs_of_one_target_are_not_shuffled_and_hot_targets_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(relations, "HOT", 4)
    held = {i: {"t"} | {f"u{i % 3}"} | ({f"v{i % 5}"} if i % 2 else set()) for i in range(20)} | {20: {"t"}, 21: {"t", None}, 22: {"w"}}
    df = spark.createDataFrame([(f"c{i}", x) for i, s in held.items() for x in s] * 2, "chunk_id string, target_document string")
    found = relations.same_target(df)
    want = {(f"c{i}", f"c{j}", "same_target", len(k) / (len(a) + len(b) - len(k))) for i, a in held.items() for j, b in held.items() if i != j and len(a) >= 2 and (k := (a & b) - {None})}
    got = list(map(tuple, found.collect()))
    assert set(got) == want and len(got) == len(want)
    assert "Exchange" not in plan(found).split("SortMergeJoin")[0]


def test_anchors_are_not_broadcast(spark, tmp_path):
    chunks = spark.range(50).selectExpr("concat('c', id) AS chunk_id", "concat('d', id) AS document_id", "concat('d', id + 1) AS target_document", "'1' AS target_anchor", "array('1', '2') AS anchors", "id AS cluster_id")
    chunks.write.parquet(str(tmp_path / "c"))
    c = spark.read.parquet(str(tmp_path / "c"))
    follow = relations.anchor_follow(c, c.select("chunk_id", "document_id", F.explode("anchors").alias("anchor")))
    whole = graph_query.enriched_chunks(c.select(F.col("chunk_id").alias("id"), "document_id"), c, follow)
    assert "Broadcast" not in plan(whole) and follow.count() == 49 and whole.where("size(incoming_anchor_from) = 1").count() == 49


def test_issues_are_read_after_they_are_dealt_and_for_what_is_asked(spark, tmp_path):
    spark.range(20).selectExpr("to_json(named_struct('key', concat('K-', id), 'fields', named_struct('summary', 's', 'description', 'd', 'parent', named_struct('key', 'K-1')))) AS json").write.parquet(str(tmp_path / "i"))
    raw = spark.read.parquet(str(tmp_path / "i")).repartition(3)
    tables = build.issue_corpus(issues.issue_rows(raw, "wiki"), "j")
    links = resolvers.resolve_issues(tables["links"], tables["documents"])
    assert all("from_json" not in x.split("FileScan")[0] for x in plan(links).split("Exchange RoundRobinPartitioning")[1:])
    assert "comment" not in plan(links) and "comment" in plan(tables["sections"])
    assert {(r["document_id"], r["target_document"]) for r in links.collect()} == {(f"doc:j:K-{i}", "doc:j:K-1") for i in range(20)}


def test_a_document_is_gathered_with_one_shuffle(spark):
    s = spark.createDataFrame([("d", 0, "a"), ("d", 1, "b"), ("d", 1, "b"), ("e", 0, "c")], "document_id string, seq int, text string")
    l = spark.createDataFrame([("d", 1, 1, "y", True), ("d", 1, 0, "x", True), ("d", 7, 0, "z", True), (None, 0, 0, "z", True)], "document_id string, section_seq int, seq int, target_document string, resolved boolean").selectExpr("*", "'k' AS kind", "CAST(NULL AS string) AS target_anchor")
    found = ck.gathered(s, l)
    assert plan(found).count("Exchange hashpartitioning") == 1
    assert {r["document_id"]: [(x["seq"], x["text"], x["targets"]) for x in r["secs"]] for r in found.collect()} == {"d": [(0, "a", []), (1, "b", ["x", "y"]), (1, "b", ["x", "y"])], "e": [(0, "c", [])]}


def test_pages_are_parsed_once_and_after_they_are_dealt(spark):
    pages = spark.range(20).selectExpr("cast(id AS string) AS id", "'S' AS space", "concat('T', id) AS title", "id AS version", "'' AS updated_at", "array('l') AS labels", "'0' AS parent", "concat('<p>p', id, ' <a href=\"http://e\">e</a></p>') AS body").repartition(3)
    tables = build.page_corpus(pages, "w")
    for name in ("sections", "links"):
        assert plan(tables[name]).count("ArrowEvalPython") == 1 and "EvalPython" not in below_exchange(tables[name]) and tables[name].count() == 20
