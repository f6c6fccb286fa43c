"""Line deduplication by a deletion-neighbourhood join.

A line counts as its lower-case words.  It is removed where an earlier occurrence of
the same words exists, or, for lines of ``near_words`` words or more, where an earlier
line lies within one word insertion, deletion or substitution.  "Earlier" is by
(doc_id, row key, line number); the earliest line stays.

Each line emits, as 128-bit keys, itself and all its variants with one word deleted.
Hashes are XORs of hashes of (word, position), so running XORs give every variant of a
line in linear time, however long it is.  A deletion variant that equals another line
proves an insertion or deletion; two equal deletion variants at the same position of
equally long lines prove a substitution; others are further apart: that position test
is the verification.  Each key only carries minima of positions, so a group of any size
costs as many rows as it has lines and is pre-aggregated before it is shuffled; the joins
back to the lines are split by the keys that very many lines hold.

Only lines that share their first or last half with a different line can be within one
edit (pigeonhole), so variants are emitted for those alone; nothing is lost.

Edge cases: null is the empty text; blank lines always stay; repeated rows (same id and
text) count once and get the same result; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import checkpointed, dropped, row_key, split_join, whole_text

NEAR_WORDS = 8
#: Rows, and bytes of all of them, of a side that may be broadcast; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 300_000, 64 << 20


def _words(line: str) -> str:
    return f"split({line}, ' ')"


#: A line with its words in lower case, separated by one space.
_NORMAL = "CASE WHEN contains(x, '  ') OR contains(x, '\\t') OR contains(x, '\\r') OR contains(x, '\\f') OR startswith(x, ' ') OR endswith(x, ' ') THEN trim(regexp_replace(x, '[ \\\\t\\\\r\\\\f]+', ' ')) ELSE x END"


def small(df: DataFrame, width: str = "64") -> DataFrame:
    """``df`` (checkpointed) marked for broadcast where its checked rows and bytes allow; ``width`` is the bytes of a row as SQL."""
    size = df.agg(F.count("*").alias("n"), F.expr(f"sum({width})").alias("bytes")).first()
    return F.broadcast(df) if size["n"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES else df


#: Bytes of a row of ``removed_lines``, as SQL.
REMOVED_WIDTH = "64 + 4 * size(removed)"


def removed_lines(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """``docs``: __k (row key), __id, __t (non-null text).  Returns __k and the array of removed line numbers."""
    lines = docs.select("__id", "__k", F.posexplode_outer(F.split("__t", "\n")).alias("line_no", "line"))
    lines = lines.select("__id", "__k", "line_no", F.expr(f"transform(array(lower(line)), x -> {_NORMAL})[0]").alias("s"))
    lines = lines.withColumn("n", F.expr("CASE WHEN s = '' THEN 0 ELSE octet_length(s) - octet_length(replace(s, ' ', '')) + 1 END"))
    half = "array(xxhash64('first', h, substring_index(s, ' ', h)), xxhash64('last', h, substring_index(s, ' ', -h)))"
    halves = f"CASE WHEN n >= {near_words - 1} THEN flatten(transform(array_distinct(array(n div 2, (n - 1) div 2)), h -> transform(array(cast(h AS int)), h -> {half})[0])) END"
    # One pass over the texts; all that follows works on hashes, until the candidates' words are needed.
    # Blank lines go after the checkpoint: a filter would be pushed below and compute the line again.
    placed = checkpointed(lines.select("n", "__id", "__k", "line_no", F.xxhash64("s").alias("h1"), F.xxhash64(F.lit("second"), "s").alias("h2"), F.expr(halves).alias("halves"))).where("n > 0")
    at = F.struct("__id", "__k", "line_no").alias("at")
    # Exact copies: the first place of every distinct line.
    own = placed.select("h1", "h2", at)
    firsts = checkpointed(own.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    later = split_join(own, firsts.where("n > 1"), ["h1", "h2"]).where("at <> first").select("at.__k", "at.line_no")
    # Lines that share a half with a different line.
    halved = placed.select(F.explode_outer("halves").alias("half"), "h1").where("half IS NOT NULL")
    shared = checkpointed(halved.groupBy("half").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("half", "n"))
    candidates = checkpointed(split_join(halved, shared, ["half"]).select("h1").distinct())
    wanted = checkpointed(firsts.join(small(candidates), "h1", "left_semi").select(F.col("first.__k").alias("__k"), F.col("first.line_no").alias("line_no"), "first"))
    near = _near_copies(_lines_at(docs, wanted), near_words)
    gone = later.union(near.select("at.__k", "at.line_no"))
    out = checkpointed(gone.groupBy("__k").agg(F.collect_set("line_no").alias("removed")))
    dropped(placed, firsts, shared, candidates, wanted, near)
    return out


def _lines_at(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(first, w): the words of the lines of ``wanted`` (__k, line_no, first); moves texts only where the list is long."""
    by_doc = checkpointed(wanted.groupBy("__k").agg(F.collect_list(F.struct("line_no", "first")).alias("places")))
    found = docs.select("__k", "__t").join(small(by_doc, "64 + 96 * size(places)"), "__k")
    at = "transform(array(split(__t, '\\n')), l -> transform(places, p -> struct(p.first AS first, get(l, p.line_no) AS line)))[0]"
    found = found.select(F.explode_outer(F.expr(at)).alias("p")).select("p.first", F.expr(f"transform(array(lower(p.line)), x -> {_NORMAL})[0]").alias("s"))
    return found.select("first", F.expr(_words("s")).alias("w"))


def _before(d: str) -> str:
    """SQL expression: for each item of the array the XOR of those before it; in blocks, so that long arrays cost linear time."""
    run = "aggregate({x}, named_struct('t', {t}, 'o', cast(array() AS array<bigint>)), (a, y) -> named_struct('t', a.t ^ y, 'o', concat(a.o, array(a.t))), a -> a.o)"
    blocks = f"transform(sequence(0, (size({d}) - 1) div 256), b -> slice({d}, b * 256 + 1, 256))"
    sums = "transform(bs, b -> aggregate(b, 0L, (a, y) -> a ^ y))"
    inner = run.format(x="b", t="get(base, i)")
    return f"transform(array({blocks}), bs -> transform(array({run.format(x=sums, t='0L')}), base -> flatten(transform(bs, (b, i) -> {inner})))[0])[0]"


def _near_copies(lines: DataFrame, near_words: int) -> DataFrame:
    """``lines``: first (place), w (words); returns the places (``at``) of those with an earlier line within one edit."""
    hashed = "transform(w, (x, j) -> xxhash64('{s}', x, j + 1 - {d}))"
    xor = "aggregate({x}, 0L, (a, y) -> a ^ y)"
    lines = lines.selectExpr("first", "size(w) AS n", *[f"{hashed.format(s=s, d=d)} AS x{d}{s}" for s in "ab" for d in (0, 1)])
    lines = lines.selectExpr("first", "n", *[f"x1{s}" for s in "ab"], *[f"{xor.format(x=f'x0{s}')} AS whole{s}" for s in "ab"], *[f"{xor.format(x=f'x1{s}')} AS moved{s}" for s in "ab"], *[f"zip_with(x0{s}, x1{s}, (p, q) -> p ^ q) AS d{s}" for s in "ab"])
    # The variant without word i: words before it at their place, words after it moved by one.
    variant = "zip_with({b}, x1{s}, (p, q) -> moved{s} ^ p ^ q)"
    lines = lines.selectExpr("first", "n", "wholea", "wholeb", *[f"CASE WHEN n >= {near_words} THEN {variant.format(b=_before(f'd{s}'), s=s)} ELSE cast(array() AS array<bigint>) END AS v{s}" for s in "ab"])
    lines = checkpointed(lines)
    keyed = lines.select(F.xxhash64("first").alias("line"), F.explode_outer(F.expr("concat(va, array(wholea))")).alias("key"))
    often = checkpointed(keyed.groupBy("key").agg(F.min("line").alias("lo"), F.max("line").alias("hi")).where("lo <> hi").select("key"))
    rows = lines.select("first", "n", F.posexplode_outer(F.expr("transform(arrays_zip(concat(va, array(wholea)), concat(vb, array(wholeb))), z -> struct(z['0'] AS key, z['1'] AS key2))")).alias("p", "z"))
    rows = rows.selectExpr("first AS at", "n", "p", "z.key", "z.key2").join(small(often), "key", "left_semi")
    rows = rows.withColumn("whole", F.expr(f"p = n OR n < {near_words}"))
    kinds = "CASE WHEN whole THEN array(struct('D' AS kind, 0 AS n, 0 AS p, 2 AS role)) ELSE array(struct('S' AS kind, n AS n, p AS p, 0 AS role), struct('D' AS kind, 0 AS n, 0 AS p, 1 AS role)) END"
    keys = checkpointed(rows.select("at", "key", "key2", F.explode_outer(F.expr(kinds)).alias("k")).select("at", "key", "key2", "k.*"))
    by = ["key", "key2", "kind", "n", "p"]
    least = checkpointed(keys.groupBy(*by).agg(*[F.min(F.when(F.col("role") == r, F.col("at"))).alias(f"m{r}") for r in (0, 1, 2)], F.count("*").alias("many")))
    found = split_join(keys, least, by, "many")
    out = checkpointed(found.where("(role = 0 AND m0 < at) OR (role = 1 AND m2 < at) OR (role = 2 AND m1 < at)").select("at").distinct())
    dropped(lines, often, keys, least)
    return out


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", near_words: int = NEAR_WORDS) -> DataFrame:
    """Each input row's id with ``kept_text``, ``n_lines``, ``n_removed`` and ``removed_lines`` (numbers from 0)."""
    docs = df.select(df[doc_id].alias("__id"), whole_text(df, text).alias("__t"))
    docs = docs.withColumn("__k", row_key(F.col("__id"), F.col("__t")))
    out = docs.join(small(removed_lines(docs, near_words), REMOVED_WIDTH), "__k", "left")
    out = out.withColumns({"__lines": F.split("__t", "\n"), "removed_lines": F.expr("coalesce(sort_array(removed), cast(array() AS array<int>))")})
    return out.select(
        F.col("__id").alias(doc_id),
        F.expr("CASE WHEN removed IS NULL THEN __t ELSE array_join(transform(array_except(sequence(0, size(__lines) - 1), removed_lines), i -> get(__lines, i)), '\\n') END").alias("kept_text"),
        F.expr("cast(size(__lines) AS bigint)").alias("n_lines"),
        F.expr("cast(size(removed_lines) AS bigint)").alias("n_removed"),
        "removed_lines",
    )
