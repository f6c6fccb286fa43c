import datetime

import pytest
from pyspark.sql import functions as F

from quillgraph import schemas
from quillgraph.corpus import Corpus
from quillgraph.functions import ids, text as tx
from quillgraph.operators import analysis, chunking as ck, communities, graph_query, relations, resolvers, sync
from quillgraph.sources import build, issues, markdown, rest, xhtml


def rows(df):
    return [tuple(r) for r in df.collect()]


def sections(spark, *texts, doc="doc:s:a", kinds=None, levels=None):
    return spark.createDataFrame([(doc, i, f"sec:s:a:{i}", (kinds or {}).get(i, "paragraph"), t, (levels or {}).get(i)) for i, t in enumerate(texts)], "document_id string, seq int, id string, kind string, text string, heading_level int")


def links(spark, targets, doc="doc:s:a"):
    data = [(doc, s, n, "page", t, None, True) for s, ts in targets.items() for n, t in enumerate(ts)]
    return spark.createDataFrame(data, "document_id string, section_seq int, seq int, kind string, target_document string, target_anchor string, resolved boolean")


def texts(df):
    return [r["text"] for r in df.orderBy("seq").collect()]


def test_ids(spark):
    d = spark.range(1).select(ids.document_id(F.lit("s"), F.lit("a:b")).alias("d"))
    assert rows(d.select("d", ids.external_of(F.col("d")), ids.shard_of(F.col("d"))))[0][:2] == ("doc:s:a:b", "a:b")
    with pytest.raises(Exception, match="malformed"):
        spark.range(1).select(ids.source_of(F.lit("x:y"))).collect()


@pytest.mark.parametrize(("base", "path", "out"), [("guides/a.md", "./setup.md", "guides/setup.md"), ("guides/a.md", "../index.md", "index.md"), ("a.md", "/docs/x.md", "docs/x.md"), ("a.md", "../../x.md", "x.md")])
def test_paths(spark, base, path, out):
    assert rows(spark.range(1).select(tx.resolve_path(F.lit(base), F.lit(path)))) == [(out,)]


def test_text_functions(spark):
    one = spark.range(1)
    assert rows(one.select(tx.slugify(F.lit("Héllo,  World_x!")), tx.heading_anchor(F.lit("Setup {#own}")), tx.first_line(F.lit(" \r\n  ab c"))))[0] == ("héllo-world-x", "own", "ab")
    for heading in ("What's next", "Further reading", "Related topics", "см. ещё", "По теме:"):
        assert rows(one.select(tx.is_navigation_heading(F.lit(heading)))) == [(True,)]
    assert rows(one.select(tx.is_navigation_heading(F.lit("Contents")))) == [(False,)]
    assert rows(one.select(tx.is_navigation_heading(F.lit(" See also:")), tx.is_navigation_heading(F.lit("Дальше")), tx.is_navigation_heading(F.lit("Setup")))) == [(True, True, False)]


def test_size_rules_are_strict(spark):
    s = sections(spark, "x" * 50, "x" * 50)
    assert len(texts(ck.PolicyChunker(ck.policy([ck.size_limit(100)])).chunk(s))) == 1
    assert len(texts(ck.PolicyChunker(ck.policy([ck.size_limit(99)])).chunk(s))) == 2
    assert len(texts(ck.PolicyChunker(ck.policy([ck.min_size(101)], default=ck.SPLIT)).chunk(s))) == 1
    assert len(texts(ck.PolicyChunker(ck.policy([ck.min_size(100)], default=ck.SPLIT)).chunk(s))) == 2


def test_heading_and_atomic_rules(spark):
    s = sections(spark, "a", "b", "c", kinds={1: "heading", 2: "heading"}, levels={1: 3})
    assert texts(ck.PolicyChunker(ck.policy([ck.heading([1])])).chunk(s)) == ["a\n\nb", "c"]
    assert texts(ck.PolicyChunker(ck.policy([ck.heading()])).chunk(s)) == ["a", "b", "c"]
    s = sections(spark, "a", "b", kinds={1: "code"})
    assert texts(ck.PolicyChunker(ck.policy([ck.atomic_block()], default=ck.SPLIT)).chunk(s)) == ["a\n\nb"]


def test_link_and_cluster_rules(spark):
    s = sections(spark, "0", "1", "2", "3")
    l = links(spark, {0: ["a"], 1: ["b"], 2: ["c"], 3: ["a", "b"]})
    assert texts(ck.PolicyChunker(ck.policy([ck.link_overlap(0.5)], default=ck.SPLIT)).chunk(s, l)) == ["0", "1", "2", "3"]
    clusters = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "document_id string, cluster_id long")
    assert texts(ck.PolicyChunker(ck.policy([ck.cluster_boundary(0.7)]), clusters=clusters).chunk(s, l)) == ["0\n\n1", "2", "3"]
    with pytest.raises(ValueError):
        ck.link_overlap(1.5)


def test_overlap_cascades(spark):
    out = texts(ck.PolicyChunker(ck.policy([], default=ck.SPLIT), overlap_chars=3).chunk(sections(spark, "abcdef", "gh", "")))
    assert out == ["abcdef", "def\n\ngh", "\ngh"]


def test_fixed_window(spark):
    s = sections(spark, "x" * 250)
    assert len(texts(ck.FixedWindowChunker(100).chunk(s))) == 3
    assert len(texts(ck.FixedWindowChunker(100, 25).chunk(s))) == 3
    first = ck.FixedWindowChunker(8).chunk(sections(spark, "AAAA", "BBBB", "CCCC")).orderBy("seq").first()
    assert first["sections"] == ["sec:s:a:0", "sec:s:a:1"]
    with pytest.raises(ValueError):
        ck.FixedWindowChunker(10, 10)


def chunks(spark, *data):
    ref = "array<struct<target_document:string,target_anchor:string,kind:string>>"
    return spark.createDataFrame([(f"{d}{s}", d, s, k, t, [(x, a, "page") for x, a in l], an) for d, s, k, t, l, an in data], f"id string, document_id string, seq int, kind string, text string, outgoing_links {ref}, anchors array<string>")


def test_relations(spark):
    c = chunks(spark, ("a", 0, "generic", "", [("x", None), ("y", None)], []), ("b", 0, "generic", "", [("x", None), ("y", None)], ["top"]), ("n", 0, "navigation", "", [("x", None), ("y", None), ("b", "top")], []))
    found = sorted(rows(relations.materialize_relations(c)))
    assert found == [("a0", "b0", "same_target", 1.0), ("b0", "a0", "same_target", 1.0), ("n0", "b0", "anchor_follow", 1.0)]


def test_components_and_communities(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "z"), ("z", "x"), ("q", "q")], "document_id string, target_document string")
    assert sorted(rows(communities.connected_components(e))) == [(n, "a") for n in "abc"] + [(n, "x") for n in "xyz"]
    got = {r["document_id"]: r["leader"] for r in communities.communities(e).collect()}
    assert got == dict.fromkeys("abc", "a") | dict.fromkeys("xyz", "x")


def test_leiden_splits_a_barbell():
    clique = lambda o: [(o + i, o + j, 1.0) for i in range(5) for j in range(i)]
    found = communities.leiden(clique(0) + clique(5) + [(0, 5, 1.0)], 10, 21)
    assert len(set(found[:5])) == len(set(found[5:])) == 1 and found[0] != found[5]


def test_queries_and_analysis(spark, tmp_path):
    docs = spark.createDataFrame([(x, x.upper(), "s", 1, None) for x in "ABCD"], "id string, title string, source_id string, version long, deleted_at timestamp")
    c = chunks(spark, ("A", 0, "generic", "Setup Guide\nx", [("B", None)], []), ("A", 1, "generic", "Setup Guide", [], []), ("B", 0, "generic", "\n Configuration", [], []), ("D", 0, "generic", "Other", [], []))
    l = spark.createDataFrame([("A", "B", "page", True), ("A", "C", "page", True), ("A", None, "external", True), ("D", None, "page", False)], "document_id string, target_document string, kind string, resolved boolean")
    k = spark.createDataFrame([("A", 1), ("B", 1), ("D", 2)], "document_id string, cluster_id long")
    rel = spark.createDataFrame([("A1", "B0", "anchor_follow"), ("A0", "B0", "anchor_follow")], "from_chunk_id string, to_chunk_id string, channel string")
    r = analysis.corpus_report(docs, c, l, k)
    assert (r.docs_total, r.chunks_total, r.clusters_total, r.unclustered_docs, r.links_resolved_no_target, r.chunks_per_doc) == (4, 4, 2, 1, 1, (0, 2, 1.0))
    assert dict(rows(analysis.cluster_labels(c, k)))[1] == "Setup Guide · Configuration"
    assert [x["id"] for x in graph_query.cluster_peers(c, k, "A0").collect()] == ["B0"]
    e = graph_query.enriched_chunks(c, k, rel)
    assert {x["id"]: x["incoming_anchor_from"] for x in e.collect()}["B0"] == ["A0", "A1"]
    assert analysis.chunk_with_context(c, "A0").first()["after"] == ["Setup Guide"]
    assert [x["id"] for x in graph_query.orphans(docs, l).orderBy("id").collect()] == ["A", "D"]
    m = analysis.document_graph_mermaid(docs, l, k)
    assert "n_A --> n_B" in m and m.startswith("graph LR")
    out = analysis.dump_analysis(docs, c, l, k, e, str(tmp_path / "d"))
    assert out["chunks"] == 4 and (tmp_path / "d" / "clusters" / "cluster-1.md").exists()
    assert analysis.collapsed_edges(l, 1).count() == 2
    assert analysis.cluster_summary(c, l, k, 99).chunk_count == 0


def test_sync_diff(spark):
    s = spark.createDataFrame([("same", 1, None), ("lower", 5, None), ("dead", 1, datetime.datetime(2026, 1, 1)), ("gone", 1, None), ("buried", 1, datetime.datetime(2026, 1, 1))], "id string, version long, deleted_at timestamp")
    i = spark.createDataFrame([("same", 1), ("lower", 4), ("dead", 1), ("new", 1)], "id string, version long")
    assert dict(rows(sync.sync_diff(s, i))) == {"same": "skipped", "lower": "updated", "dead": "resurrected", "gone": "deleted", "new": "created"}


def test_sync_end_to_end(spark, tmp_path):
    files = [("index.md", "---\ntitle: Home\ntags: [x]\n---\n# Start\n\nSee [setup](./guides/setup.md#top) and [web](https://e.org).\n"), ("guides/setup.md", "# Top\n\nBack [home](../index.md).\n")]
    make = lambda fs: build.markdown_corpus(spark.createDataFrame([(p, t, datetime.datetime(2026, 1, 1)) for p, t in fs], "path string, text string, updated_at timestamp"), "s")
    corpus = Corpus(spark, str(tmp_path), "s")
    chunker = ck.PolicyChunker(ck.policy([ck.min_size(500)]))
    first = sync.sync(corpus, *make(files).values(), chunker, resolvers.resolve_files)
    assert (first.created, first.skipped, first.relations) == (2, 0, 1)
    again = sync.sync(corpus, *make(files).values(), chunker, resolvers.resolve_files)
    assert (again.created, again.skipped, again.graph_version) == (0, 2, 2)
    assert sync.recompute_clusters(corpus) == 1
    assert sync.rechunk(corpus, chunker)["chunks"] == 2
    less = sync.sync(corpus, *make(files[:1]).values(), chunker, resolvers.resolve_files)
    assert less.deleted == 1 and corpus.table("chunks").count() == 1
    assert sync.sync(corpus, *make(files).values(), chunker).resurrected == 1


def test_markdown_blocks():
    got, links_ = markdown.parse_blocks("# A `b` {#own}\n\ntext *em* [l](x.md#y)\nmore\n\n- one\n- two\n\n```py\nx = 1\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n> quote\n\n---\n<div>\nx</div>\n\nTitle\n=====\n")
    assert [(x["kind"], x["text"]) for x in got] == [("heading", "A b"), ("paragraph", "text em l more"), ("list", "one\ntwo"), ("code", "x = 1"), ("table", "a b 1 2"), ("quote", "quote"), ("hr", ""), ("html", "<div>\nx</div>"), ("heading", "Title")]
    assert got[0]["anchor"] == "own" and got[3]["metadata"]["language"] == "py"
    assert [(x["section_seq"], x["kind"], x["target_anchor"], x["metadata"]["target_path"]) for x in links_] == [(1, "internal", "y", "x.md")]


@pytest.mark.parametrize(("text", "kind"), [("---\na: 1\n---\nb", "yaml"), ("+++\na = 1\n+++\nb", "toml"), ('{"a": 1}\nb', "json"), ("---\na: [\n---\nb", "none"), ("---\na: 1\nb", "none"), ("---\r\na: 1\r\n---\r\nb", "yaml"), ("---\n---\nb", "yaml"), ("---\n- x\n---\nb", "none")])
def test_frontmatter(text, kind):
    meta, body, got = markdown.parse_frontmatter(text)
    assert got == kind and (body == text if kind == "none" else body == "b") and (kind == "none" or meta in ({"a": 1}, {}))


def test_storage_format():
    got = xhtml.parse_storage('<h2 id="i">H&nbsp;x</h2><ac:structured-macro ac:name="anchor"><ac:parameter ac:name="">here</ac:parameter></ac:structured-macro><p>a <b>b</b></p><ac:structured-macro ac:name="code"><ac:parameter ac:name="language">py</ac:parameter><ac:plain-text-body><![CDATA[x<1]]></ac:plain-text-body></ac:structured-macro><ac:structured-macro ac:name="toc"/><ul><li>q</li></ul>')
    assert [(x["kind"], x["text"], x["anchor"]) for x in got] == [("heading", "H\xa0x", "i"), ("paragraph", "a b", "here"), ("code", "x<1", None), ("list", "q", None)]
    assert [x["kind"] for x in xhtml.parse_storage("<p>open<p>two")] == ["paragraph", "paragraph"]
    l = xhtml.storage_links('<p><ac:link ac:anchor="s"><ri:page ri:content-title="T"/><ac:plain-text-link-body><![CDATA[x]]></ac:plain-text-link-body></ac:link><a href="http://e">e</a></p>', "SP")
    assert [(x["kind"], x["target_anchor"], x["metadata"].get("space")) for x in l] == [("page", "s", "SP"), ("external", None, None)]


def test_issue_bodies():
    adf = '{"content":[{"type":"heading","attrs":{"level":9},"content":[{"type":"text","text":"H"}]},{"type":"paragraph","content":[{"type":"mention","attrs":{"text":"@m"}},{"type":"hardBreak"},{"type":"inlineCard","attrs":{"url":"u"}}]},{"type":"odd"}]}'
    assert [(x["kind"], x["text"], x["heading_level"]) for x in issues.parse_adf(adf)] == [("heading", "H", None), ("paragraph", "@m u", None), ("unknown", "", None)]
    assert issues.parse_adf("{") [0]["kind"] == "paragraph" and issues.parse_adf("[]") == []
    got = issues.parse_wiki("h1. A *b*\n----\nbq. q\n{code:java}\nx\n{code}\n* i\n* j\n|a|b|\ntext [l|http://x]\n{panel:title=T}\nopen")
    assert [(x["kind"], x["text"]) for x in got] == [("heading", "A b"), ("hr", ""), ("quote", "q"), ("code", "x"), ("list", "i\nj"), ("table", "a b"), ("paragraph", "text l"), ("panel", "open")]


def test_issue_corpus(spark):
    raw = '{"key":"P-1","fields":{"summary":"S","description":"h1. A","updated":"2026-01-01T00:00:00Z","project":{"key":"P"},"subtasks":[{"key":"P-2","fields":{"summary":"t"}}],"issuelinks":[{"type":{"name":"blocks"},"outwardIssue":{"key":"P-3","fields":{"summary":"u"}}}],"parent":{"key":"P-0"},"comment":{"comments":[{"author":{"displayName":"","accountId":"id"},"created":"c","body":"hi"}]}}}'
    t = build.issue_corpus(issues.issue_rows(spark.createDataFrame([(raw,)], "json string"), "wiki"), "j")
    assert [(r["kind"], r["text"]) for r in t["sections"].orderBy("seq").collect()] == [("heading", "A"), ("comment", "hi")]
    assert [(r["kind"], r["metadata"]["target_key"]) for r in t["links"].orderBy("seq").collect()] == [("issue_link", "P-3"), ("subtask", "P-2"), ("parent", "P-0")]
    known = spark.createDataFrame([("doc:j:P-3", None)], "id string, deleted_at timestamp")
    assert [r["target_document"] for r in resolvers.resolve_issues(t["links"], known).orderBy("seq").collect()] == ["doc:j:P-3", None, None]


def test_rest_reader(monkeypatch):
    pages = {"/wiki/api/v2/spaces?keys=S": {"results": [{"id": 7}]}, "/wiki/api/v2/spaces/7/pages?body-format=storage&limit=250": {"results": [{"id": 1, "title": "T", "version": {"number": 2}}], "_links": {"next": "/n"}}, "/n": {"results": [{"id": 2, "title": "U"}]}}
    monkeypatch.setattr(rest.Http, "request", lambda self, url, body=None: pages[url.removeprefix("http://h")])
    assert [r[0] for r in rest.RestReader({"scopes": "S", "url": "http://h"}).read(rest.Scope("S"))] == ["1", "2"]
    assert rest.Auth("u", "t").headers()["Authorization"].startswith("Basic ") and rest.Auth(token="t").headers() == {"Authorization": "Bearer t"}


def test_catalog_has_sql_for_its_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 35


def test_transactions_and_buckets(spark, tmp_path):
    corpus = Corpus(spark, str(tmp_path), "s", digits=2)
    row = lambda i, title: (f"doc:s:{i}", "s", str(i), title, "generic", 1, None, None, 0, None)
    make = lambda *r: spark.createDataFrame([row(*x) for x in r], schemas.DOCUMENTS)
    corpus.replace("documents", make(*((i, "a") for i in range(40))))
    before = corpus._current()["tables"]["documents"]
    corpus.upsert("documents", make((3, "b")), "id")
    after = corpus._current()["tables"]["documents"]
    assert [b for b in after if after[b] != before.get(b)] == corpus.buckets_of(make((3, "b")))  # the other buckets stay
    assert sorted(r["title"] for r in corpus.table("documents").collect()) == ["a"] * 39 + ["b"]
    with pytest.raises(RuntimeError, match="half"), corpus.transaction():
        corpus.replace("documents", make((1, "z")))
        corpus.bump_graph_version()
        raise RuntimeError("half way")
    assert corpus.table("documents").count() == 40 and corpus.graph_version() == 0
    for _ in range(4):
        corpus.replace("documents", make((1, "z")))
    assert [r["title"] for r in corpus.table("documents").collect()] == ["z"] and len(corpus._pointers()) == 2


def test_repeated_incoming_ids(spark, tmp_path):
    files = [("a.md", "# A"), ("a.md", "# A")]
    tables = build.markdown_corpus(spark.createDataFrame([(p, t, datetime.datetime(2026, 1, 1)) for p, t in files], "path string, text string, updated_at timestamp"), "s")
    corpus = Corpus(spark, str(tmp_path), "s")
    assert sync.sync(corpus, *tables.values(), ck.PolicyChunker(ck.policy([])), resolvers.resolve_files).created == 1
    assert corpus.table("documents").count() == corpus.table("sections").count() == corpus.table("chunks").count() == 1


def test_wiki_inline_marks():
    take = issues.strip_inline
    assert take("a [l|u] [x] {{m}} *b* _i_ a_b_c  d") == "a l x m b i abc d"
    assert take("[a|] [|b] [] ** * * {{}} {{a}b}} _\n_ [open") == "a| |b [] * * {{}} {{a}b}} _ _ [open"
    assert take("[a [b|c] *x [y*|z]") == "a [b x y|z" or take("[a [b|c]") == "a [b"


def test_mermaid_without_limit(spark):
    docs = spark.createDataFrame([(f"d{i}", None) for i in range(60)], "id string, title string")
    links_ = spark.createDataFrame([(f"d{i}", f"d{i + 1}", True) for i in range(59)], "document_id string, target_document string, resolved boolean")
    none = spark.createDataFrame([], "document_id string, cluster_id long")
    assert analysis.document_graph_mermaid(docs, links_, none, None).count("-->") == 59
    assert "(others)" in analysis.document_graph_mermaid(docs, links_, none, 50)
