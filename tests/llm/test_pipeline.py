import random

import corpus_pipeline
from tests.llm.test_operators import text


def test_pipeline(spark, tmp_path):
    rnd = random.Random(2)
    spam = " ".join(f"bench{i}" for i in range(20))
    docs = [(i, text(100 + i, 60), "en", "s", 0, "extra") for i in range(30)]
    docs += [(40, docs[0][1], "en", "s", 0, ""), (40, docs[0][1], "en", "s", 0, ""), (41, None, None, None, None, None), (42, "12345", "en", "s", 5, ""), (43, text(7, 30) + " " + spam, "en", "s", 1, "")]
    long = [text(500 + k, 120) for k in range(1)]
    w = long[0].split()
    w[60] = "odd"
    docs += [(50, long[0], "en", "s", 1, ""), (51, " ".join(w[:40]) + "\n" + " ".join(w[40:]), "en", "s", 1, "")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, removed string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, spam)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in out) == [*range(30), 50]
    assert {"doc_id", "text", "lang", "source", "n_chars", "removed", "rate", "copies"} == set(out[0].asDict())
    assert rnd and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "mixing"]
