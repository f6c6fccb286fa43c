"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import decontaminate, html_crf, language, line_dedup, merkle, mixing, order_minhash, secret_scan, suffix_dedup, warc
from quillgraph.llm.common import table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("__k")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language.held_out())
    profiles = language.learn(docs.where("NOT held_out"))
    return language.identify(docs.select("doc_id", "text", "held_out"), profiles, nearest=True).select("doc_id", "held_out", "lang_pred", "score")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("__k")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed_lines"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_repeats(table(spark, sf_dir, "documents"), keep_first=False, with_kept=False)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_fingerprints, op2_near_duplicates, op3_language, op4_mixing, op5_line_dedup, op6_secrets, op7_repeats, op8_decontamination, op9_html, op10_warc, pipeline)
}


def _tree(text: str) -> str:
    """(doc_id, serialised tree, leaves) of ``text`` over e, in DuckDB."""
    cuts = f"list_filter(range(1, len(w) + 1), lambda i: i = 1 OR substr(md5(w[i - 1]), 1, 1) IN {merkle.ENDS})"
    leaf = "sha256(array_to_string(w[a:coalesce(c[k + 1] - 1, len(w))], ''))"
    to = "coalesce(S[k + 1] - 1, len(P))"
    shown = f"list_transform(list_zip(H[a:{to}], C[a:{to}]), lambda z: substr(z[1], 1, 16) || '.' || array_to_string(list_transform(z[2], lambda y: substr(y, 1, 6)), ''))"
    return f"""(SELECT doc_id, sha256(array_to_string(G, '')) || ':' || array_to_string(list_transform(S, lambda a, k: substr(G[k], 1, 16) || '=' || array_to_string({shown}, ';')), '|') AS fp,
  list_distinct(list_transform(flatten(C), lambda y: substr(y, 1, 6))) AS ph
 FROM (SELECT *, list_transform(S, lambda a, k: sha256('section' || array_to_string(H[a:{to}], ''))) AS G
  FROM (SELECT *, list_filter(range(1, len(P) + 1), lambda i: i = 1 OR P[i - 1] = '' OR substr(H[i - 1], 1, 1) IN {merkle.ENDS}) AS S
   FROM (SELECT *, list_transform(C, lambda y: sha256('paragraph' || array_to_string(y, ''))) AS H
    FROM (SELECT doc_id, list(x ORDER BY n) AS P, list(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(c, lambda a, k: {leaf}) END ORDER BY n) AS C
     FROM (SELECT *, {cuts} AS c FROM (SELECT *, regexp_extract_all(x, '{merkle.WORD}', 0) AS w
      FROM (SELECT doc_id, P[n] AS x, n FROM (SELECT doc_id, P, unnest(range(1, len(P) + 1)) AS n FROM (SELECT doc_id, string_split({text}, chr(10)) AS P FROM e))))) GROUP BY doc_id)))))"""


def _near(a: str, b: str, same: str) -> str:
    return f"CASE WHEN {same} THEN 1.0::DOUBLE WHEN len({a}) + len({b}) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"


OP1 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), n AS (SELECT doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nx, length(t) AS c FROM d WINDOW w AS (ORDER BY doc_id)),
 e AS (SELECT *, substr(t, 1, c - c // 4) || substr(nx, 1, c // 4) AS x FROM n)
SELECT e.doc_id, c AS n_chars, sha256(x) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint, {_near("a.ph", "b.ph", "t = x")} AS near_edited, {_near("a.ph", "z.ph", "t = nx")} AS near_next
FROM e JOIN {_tree("t")} a ON a.doc_id = e.doc_id JOIN {_tree("x")} b ON b.doc_id = e.doc_id JOIN {_tree("nx")} z ON z.doc_id = e.doc_id"""

OP5 = f"""WITH l AS (SELECT doc_id, i - 1 AS no, list_filter(string_split_regex(lower(s[i]), '[ \t\r\f]+'), lambda x: x <> '') AS w FROM
  (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
 p AS (SELECT *, array_to_string(w, ' ') AS s, len(w) AS n, (doc_id, no) AS pos FROM l WHERE len(w) > 0),
 f AS (SELECT s, any_value(n) AS n, any_value(w) AS w, min(pos) AS pos FROM p GROUP BY s),
 v AS (SELECT pos, n, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS v FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM f WHERE n >= {line_dedup.NEAR_WORDS})),
 near AS (SELECT v.pos FROM v JOIN (SELECT n, i, v, min(pos) AS m FROM v GROUP BY ALL) g ON v.n = g.n AND v.i = g.i AND v.v = g.v WHERE g.m < v.pos
  UNION SELECT greatest(v.pos, f.pos) FROM v JOIN f ON v.v = f.s),
 gone AS (SELECT p.doc_id, p.no FROM p JOIN f ON f.s = p.s WHERE p.pos <> f.pos OR p.pos IN (SELECT pos FROM near)),
 r AS (SELECT doc_id, list(no ORDER BY no) AS g FROM gone GROUP BY 1)
SELECT doc_id, len(s) AS n_lines, coalesce(len(g), 0) AS n_removed, coalesce(array_to_string(g, ','), '') AS removed_lines,
 sha256(coalesce(array_to_string(list_filter(s, lambda x, i: NOT list_contains(coalesce(g, []), i - 1)), chr(10)), '')) AS kept_sha256
FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents) LEFT JOIN r USING (doc_id)"""


def _spans(i: int, rule: secret_scan.Rule) -> str:
    re_ = rule.regex.replace("'", "''")
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{re_}', 0)) + 1), lambda k: {{'start': list_sum(list_transform(string_split_regex(t, '{re_}')[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{re_}', 0)[1:k - 1], lambda x: length(x))), 0),
 'ord': {i}, 'size': length(regexp_extract_all(t, '{re_}', 0)[k]), 'own': length(regexp_extract_all(t, '{re_}', {rule.group})[k]), 'kind': '{rule.kind}'}}), lambda z: z.own >= {rule.least})"""


def _shown(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda z: z.kind || ':' || CAST(z.start AS BIGINT) || ':' || CAST(z.start + z.size AS BIGINT)), ',')"


OP6 = f"""SELECT doc_id, {", ".join(f"len(list_filter(f, lambda z: z.kind = '{r.kind}')) AS n_{r.kind}" for r in secret_scan.BASE_RULES)}, sha256({_shown(f"list_filter(f, lambda z: z.ord < {len(secret_scan.BASE_RULES)})")}) AS base_sha256, {_shown("f")} AS spans
FROM (SELECT doc_id, list_sort(list_concat({", ".join(_spans(i, r) for i, r in enumerate(secret_scan.RULES))})) AS f FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP8 = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{decontaminate.WORD}') AS w FROM documents),
 b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOW}, '{decontaminate.WORD}') AS w FROM benchmark),
 iw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
 dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
 h AS (SELECT doc_id, i, dw.n, item FROM dw JOIN iw ON iw.n = dw.n AND iw.g = dw.g),
 c AS (SELECT doc_id, count(DISTINCT p) AS hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
 k AS (SELECT doc_id, list_sort(list_distinct(list(item))) AS items FROM h GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)"""

ORACLE: dict[str, str] = {"op1_fingerprints": OP1, "op5_line_dedup": OP5, "op6_secrets": OP6, "op8_decontamination": OP8}
