"""Benchmark decontamination by winnowing.

A window is ``length`` consecutive words of a benchmark item (an item of fewer words is
one window).  Every document word inside an occurrence of a window is hit.  Both sides
hash all k-grams of words and keep, with their positions, the smallest of every
``length - k + 1`` consecutive ones, so any shared span of ``length`` words shares a kept
fingerprint.  A joined fingerprint puts the item beside the document at one offset; there
the hit is extended: words are compared one by one, and runs of ``length`` equal words or
more are hit, so hash collisions never reach the result.  Items shorter than ``length``
lie outside winnowing's guarantee; they are looked up by the hash of all their words, in
the same pass, and compared in the same way.

Items with equal words are compared once.  Only documents with a joined fingerprint are
read a second time.

Edge cases: null and wordless texts have no words; a wordless item has no window; items
with equal windows all count; repeated rows get equal results; an empty table on either
side gives rows without hits or no rows; very long texts are one row each; extra columns
of either table are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import checkpointed, dropped, row_key, split_join, whole_text

K, LENGTH = 5, 10
#: Rows, and bytes of their lists, of a side that may be broadcast; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> str:
    pattern = WORD.replace("\\", "\\\\")
    return f"regexp_extract_all(translate({text}, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{pattern}', 0)"


def _gram(w: str, n: int) -> str:
    """SQL expression: the hash of ``n`` words from place ``i``; runs of different lengths have different ones."""
    return f"xxhash64({n}, {', '.join(f'get({w}, i + {j})' for j in range(n))})"


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _grams(w: str, n: int, least: int) -> str:
    """SQL expression: the hashes of all runs of ``n`` words, none in a text of fewer than ``least``."""
    return f"CASE WHEN size({w}) >= {least} THEN transform(sequence(0, size({w}) - {n}), i -> {_gram(w, n)}) ELSE cast(array() AS array<bigint>) END"


def winnowed(w: str, k: int = K, length: int = LENGTH) -> str:
    """SQL expression: the distinct winnowed fingerprints of the word array ``w``; none below ``length`` words."""
    width = length - k + 1
    least = f"least({', '.join(f'get(h, i + {j})' for j in range(width))})" if width > 1 else "get(h, i)"
    kept = f"CASE WHEN size(h) > 0 THEN array_distinct(transform(sequence(0, size(h) - {width}), i -> {least})) ELSE h END"
    return _let(_grams(w, k, length), "h", kept)


def places(w: str, sizes: list[int], wanted: str, length: int = LENGTH, k: int = K) -> str:
    """SQL expression: where in ``w`` (f, at) the runs of k words, and those as long as the short items (``sizes``), have a hash that is in the array ``wanted``."""
    found = [_let(_grams(w, n, n if n < length else length), "h", f"filter(transform(h, (f, at) -> struct(f AS f, at AS at)), x -> array_contains({wanted}, x.f))") for n in sizes]
    return found[0] if len(found) == 1 else f"concat({', '.join(found)})"


def _small(df: DataFrame, lists: str | None = None) -> DataFrame:
    """``df`` (checkpointed) marked for broadcast where its checked rows and bytes allow; ``lists`` is the bytes of a row as SQL."""
    size = df.agg(F.count("*").alias("n"), F.expr(f"sum({lists or 64})").alias("bytes")).first()
    return F.broadcast(df) if size["n"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES else df


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", k: int = K, length: int = LENGTH) -> DataFrame:
    """Per row of ``docs``: id, row key ``__k``, n_words, n_hit and ``items`` (ids as sorted strings)."""
    docs = docs.select(docs[doc_id].alias("__id"), whole_text(docs, text).alias("__t"))
    docs = docs.withColumn("__k", row_key(F.col("__id"), F.col("__t")))
    items = items.select(items[item_id].cast("string").alias("item"), F.expr(words("coalesce(cast(" + text + " AS string), '')")).alias("iw")).where("size(iw) > 0")
    items = checkpointed(items.withColumn("c", F.expr("sha2(array_join(iw, ' '), 256)")))
    classes = checkpointed(items.groupBy("c").agg(F.first("iw").alias("iw")))
    short = sorted(r["n"] for r in classes.select(F.size("iw").alias("n")).where(F.col("n") < length).distinct().collect())  # fewer than `length` numbers
    whole = "".join(f" WHEN size(iw) = {n} THEN {_grams('iw', n, n)}" for n in short)
    marks = classes.withColumn("kept", F.expr(f"CASE WHEN size(iw) >= {length} THEN {winnowed('iw', k, length)}{whole} END"))
    marks = marks.select("c", F.explode_outer(F.expr(places("iw", [k, *short], "kept", length, k))).alias("m")).select("m.f", F.col("m.at").alias("i"), "c").where("f IS NOT NULL")
    marks = checkpointed(marks.groupBy("f").agg(F.collect_list(F.struct("c", "i")).alias("marks"), F.count("*").alias("m")))
    # First pass over all texts: which documents share a fingerprint with an item, or the hash of a run as long as a short item.
    wanted = winnowed("__w", k, length) + "".join(f", array_distinct({_grams('__w', n, n)})" for n in short)
    seen = docs.select("__id", "__k", F.expr(words("__t")).alias("__w"))
    seen = checkpointed(seen.select("__id", "__k", F.size("__w").cast("long").alias("n_words"), F.expr(f"concat({wanted})").alias("fs")))  # the only pass over all texts
    each = seen.select("__k", F.explode_outer("fs").alias("f")).where("f IS NOT NULL")
    candidates = checkpointed(each.join(_small(marks.select("f")), "f", "left_semi").groupBy("__k").agg(F.collect_set("f").alias("fs")))
    # Their places in those documents, and so the offsets at which an item lies beside the text.
    # Words are split below an aggregation, which holds them as they are: later projections would split them again for every use.
    near = docs.join(_small(candidates, "48 + 24 * size(fs)"), "__k").select("__k", F.expr(words("__t")).alias("__w"), "fs").dropDuplicates(["__k"])
    found = checkpointed(near.select("__k", F.explode_outer(F.expr(places("__w", [k, *short], "fs", length, k))).alias("x")).select("__k", "x.f", "x.at"))
    hits = split_join(found, checkpointed(found.groupBy("f").agg(F.count("*").alias("n")).join(marks.select("f", "marks"), "f")), ["f"])
    hits = hits.select("__k", "at", F.explode_outer("marks").alias("m")).groupBy("__k", "m.c").agg(F.collect_set(F.expr("at - m.i")).alias("offsets"))
    hits = checkpointed(hits.join(classes, "c").groupBy("__k").agg(F.collect_list(F.struct("c", "offsets", "iw")).alias("beside")))
    # Extension, in the documents at hand: the runs of equal words along each offset.
    equal = "j < size(g.iw) AND get(__w, d + j) = get(g.iw, j)"
    longer = f"CASE WHEN j - a.s >= least({length}, size(g.iw)) THEN concat(a.o, array(struct(d + a.s AS at, j - a.s AS n))) ELSE a.o END"
    empty = "cast(array() AS array<struct<at: int, n: int>>)"
    runs = f"aggregate(sequence(0, size(g.iw)), named_struct('s', 0, 'o', {empty}), (a, j) -> CASE WHEN {equal} THEN a ELSE named_struct('s', j + 1, 'o', {longer}) END, a -> a.o)"
    beside = docs.join(_small(hits, "aggregate(beside, 64L, (a, g) -> a + 96 + 8 * size(g.offsets) + 24 * size(g.iw))"), "__k").select("__k", F.expr(words("__t")).alias("__w"), "beside").dropDuplicates(["__k"])
    hit = beside.select("__k", F.expr(f"filter(transform(beside, g -> struct(g.c AS c, flatten(transform(g.offsets, d -> {runs})) AS spans)), g -> size(g.spans) > 0)").alias("hit"))
    hit = checkpointed(hit).where("size(hit) > 0")
    covered = "aggregate(array_sort(array_distinct(flatten(transform(hit, g -> g.spans)))), named_struct('e', 0, 'n', 0L), (a, s) -> named_struct('e', greatest(a.e, s.at + s.n), 'n', a.n + greatest(0, s.at + s.n - greatest(s.at, a.e))), a -> a.n)"
    named = hit.select("__k", F.explode_outer("hit.c").alias("c")).join(items.select("c", "item"), "c").groupBy("__k").agg(F.sort_array(F.collect_set("item")).alias("items"))
    result = checkpointed(hit.select("__k", F.expr(covered).alias("n_hit")).join(named, "__k"))
    dropped(candidates, found, hits, marks, classes)
    out = seen.select("__id", "__k", "n_words").join(_small(result, "96 + 48 * size(items)"), "__k", "left")
    return out.select(F.col("__id").alias(doc_id), "__k", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.expr("coalesce(items, cast(array() AS array<string>))").alias("items"))
