"""A corpus pipeline of five stages over ``documents``.

Each stage works on all its predecessor kept, is written as Parquet in the shared folder
and read again.  All stages but the last return the columns of the documents they got;
the last adds rate and copies.

Edge cases: nulls are empty texts, in no language; repeated rows are settled by the
near-duplicate stage (one stays); an empty table passes through; very long texts are
handled as the operators do; extra columns pass through, but ``rate`` and ``copies`` of
the input give way to those of the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import decontaminate, language, line_dedup, mixing, order_minhash
from quillgraph.llm.common import row_key, shared_dir, table, whole_text


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__row", row_key(F.col("doc_id"), whole_text(docs)))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no known language: without letters, or sharing no n-gram with any profile; only the former where no language is known."""
    profiles = language.learn(docs.where(~language.held_out()))
    if not profiles.names:
        return docs.where(whole_text(docs).rlike(r"\p{L}"))
    return language.identify(docs, profiles, pred="__pred", score="__score").where("__pred <> 'und'").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated lines from the texts; documents with no line of their own left go."""
    own = docs.select("doc_id", whole_text(docs).alias("__t")).withColumn("__row", row_key(F.col("doc_id"), F.col("__t")))
    removed = line_dedup.removed_lines(own.select(F.col("doc_id").alias("__id"), F.col("__row").alias("__k"), "__t"))
    gone = line_dedup.small(removed, line_dedup.REMOVED_WIDTH).withColumnsRenamed({"__k": "__row", "removed": "__removed"})
    out = _keyed(docs).join(gone, "__row", "left")
    kept = "transform(array(split(text, '\\n')), l -> array_join(transform(array_except(sequence(0, size(l) - 1), __removed), i -> get(l, i)), '\\n'))[0]"
    out = out.withColumn("__kept", F.expr(f"CASE WHEN __removed IS NULL THEN text ELSE {kept} END"))
    out = out.where("__removed IS NULL OR __kept RLIKE '[^ \\\\t\\\\r\\\\n\\\\f]'")
    values = {"text": F.col("__kept")}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.expr("CASE WHEN __removed IS NULL THEN n_chars ELSE length(__kept) END").cast(docs.schema["n_chars"].dataType)
    return out.select(*[values.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each class of near duplicates."""
    kept = order_minhash.near_duplicates(docs).where("kept").select(F.col("__k").alias("__row"))
    again = kept.groupBy("__row").count().where("count > 1").limit(1).count()
    out = _keyed(docs).join(kept.distinct(), "__row", "left_semi")
    return (out.dropDuplicates(["__row"]) if again else out).select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    hit = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0").select(F.col("__k").alias("__row")).distinct()
    few = hit.limit(decontaminate.BROADCAST_ROWS + 1).count() <= decontaminate.BROADCAST_ROWS
    return _keyed(docs).join(F.broadcast(hit) if few else hit, "__row", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add rate and copies; documents whose rate is 0 (the domain without weight) go."""
    rates = mixing.mix(docs, table(spark, sf_dir, "labels")).select(F.col("__k").alias("__row"), F.col("rate").alias("__rate"), F.col("copies").alias("__copies")).dropDuplicates(["__row"])
    out = _keyed(docs).join(rates.where("__rate > 0"), "__row")
    return out.select(*[c for c in docs.columns if c not in ("rate", "copies")], F.col("__rate").alias("rate"), F.col("__copies").alias("copies"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
]

#: Language profiles, sketches and rates are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result passes through the shared folder, and goes when the next one stands."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.parquet(f"{base}/{i}-{name}")
        if before is not None:
            where = spark._jvm.org.apache.hadoop.fs.Path(before)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        before = f"{base}/{i}-{name}"
    return docs
