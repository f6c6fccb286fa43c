"""Document fingerprints: a Merkle tree over sections, paragraphs and phrases.

A paragraph is a line; a phrase (the leaf) is a run of words with the white space after
them that ends after a word whose MD5 starts with 0 or 1, so about every eighth, in any
script (each sign of scripts without spaces counts as a word).  A section is a run of
paragraphs; it ends after a blank one or one whose hash starts with 0 or 1.  All cuts
depend on content alone, so an edit moves no distant boundary.

Leaf = SHA-256 of the phrase, paragraph = SHA-256 over its leaves, section = SHA-256 over
its paragraphs, root = SHA-256 over the sections: two texts are equal exactly when their
roots are, and a differing root leads down to the sections, paragraphs and phrases at
fault.

Serialised form: ``root:section|section``, a section ``hash=paragraph;paragraph``, a
paragraph ``hash.leaves``; root with 64 digits, section and paragraph hashes cut to 16,
leaves to 6 digits each.

Edge cases: null is the empty text; it has one empty paragraph without a leaf.  Two trees
with equal roots have likeness 1, otherwise the Dice coefficient of their sets of leaves
(0 if both are empty).  Repeated rows get equal fingerprints, and so do equal texts under
any id; ids may be of any orderable type, null first; an empty table gives an empty
result; a very long text is one row throughout; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import whole_text

#: Signs that are words of their own: kana, Han, and the scripts of South-East Asia.
SIGNS = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}"
BLANKS = r" \t\r\f"
WORD = rf"[{SIGNS}][{BLANKS}]*|[^{SIGNS}{BLANKS}]*[{BLANKS}]+|[^{SIGNS}{BLANKS}]+"
#: The same words for Java's matcher, quicker: a plain range of letters is tried before the
#: long classes, and nothing is given back.  RE2, which reads ``WORD`` in the SQL, lacks ``++``.
QUICK_WORD = rf"[!-~\x{{A1}}-\x{{DFF}}]++(?: (?=[!-~])|[^{SIGNS}{BLANKS}]*+[{BLANKS}]*+)|[^{SIGNS}{BLANKS}]++[{BLANKS}]*+|[{BLANKS}]++|[{SIGNS}][{BLANKS}]*+"
ENDS = "('0', '1')"
#: Rows sampled for each range of ids; the sample only balances the ranges.
PER_RANGE = 40
#: Ranges at most: steps of the search for a row's range, so 4096.
STEPS = 12


def _leaves(x: str) -> str:
    """SQL expression: the leaf hashes of the paragraph ``x``."""
    words = "regexp_extract_all({}, '{}', 0)".format(x, QUICK_WORD.replace("\\", "\\\\"))
    cuts = f"filter(sequence(0, size(w) - 1), i -> i = 0 OR substr(md5(get(w, i - 1)), 1, 1) IN {ENDS})"
    leaf = "sha2(array_join(slice(w, a + 1, coalesce(get(c, k + 1), size(w)) - a), ''), 256)"
    return f"transform(array({words}), w -> CASE WHEN size(w) = 0 THEN cast(array() AS array<string>) ELSE transform(array({cuts}), c -> transform(c, (a, k) -> {leaf}))[0] END)[0]"


def with_tree(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``{out}`` (the serialised tree) and ``{out}_set`` (its distinct leaves).

    ``text`` names a non-null string column.
    """
    p, h, c, s = (f"__{out}_{x}" for x in "phcs")
    df = df.withColumn(p, F.expr(f"split({text}, '\\n')"))
    df = df.withColumn(c, F.expr(f"transform({p}, x -> {_leaves('x')})"))
    df = df.withColumn(h, F.expr(f"transform({c}, y -> sha2(concat('paragraph', array_join(y, '')), 256))"))
    cut = f"i = 0 OR get({p}, i - 1) = '' OR substr(get({h}, i - 1), 1, 1) IN {ENDS}"
    df = df.withColumn(s, F.expr(f"filter(sequence(0, size({p}) - 1), i -> {cut})"))
    part = f"slice({{}}, a + 1, coalesce(get({s}, k + 1), size({p})) - a)"
    hashes = f"transform({s}, (a, k) -> sha2(concat('section', array_join({part.format(h)}, '')), 256))"
    shown = f"zip_with({part.format(h)}, {part.format(c)}, (u, y) -> concat(substr(u, 1, 16), '.', array_join(transform(y, z -> substr(z, 1, 6)), '')))"
    listed = f"array_join(transform({s}, (a, k) -> concat(substr(get(g, k), 1, 16), '=', array_join({shown}, ';'))), '|')"
    df = df.withColumns(
        {
            out: F.expr(f"transform(array({hashes}), g -> concat(sha2(array_join(g, ''), 256), ':', {listed}))[0]"),
            f"{out}_set": F.expr(f"array_distinct(transform(flatten({c}), y -> substr(y, 1, 6)))"),
        }
    )
    return df.drop(p, h, c, s)


def likeness(a: str, b: str, same: str) -> str:
    """SQL expression: Dice coefficient of two sets of leaves; 1 where ``same`` holds."""
    total = f"(size({a}) + size({b}))"
    return f"CASE WHEN {same} THEN 1D WHEN {total} = 0 THEN 0D ELSE 2D * size(array_intersect({a}, {b})) / {total} END"


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: its id, the serialised tree and its set of leaves."""
    docs = df.select(df[doc_id].alias(doc_id), whole_text(df, text).alias("__text"))
    return with_tree(docs, "__text", "fingerprint").drop("__text")


def _middle(a: str, b: str) -> str:
    """SQL expression: struct(lo, na, nb), what is left of two arrays of branches without their common start and end."""
    least = f"least(size({a}), size({b}))"
    start = f"coalesce(filter(sequence(0, {least}), i -> i = {least} OR substr(get({a}, i).x, 1, 16) <> substr(get({b}, i).x, 1, 16))[0], 0)"
    end = f"coalesce(filter(sequence(0, {least} - lo), i -> i = {least} - lo OR substr(get({a}, size({a}) - 1 - i).x, 1, 16) <> substr(get({b}, size({b}) - 1 - i).x, 1, 16))[0], 0)"
    return f"transform(array({start}), lo -> transform(array({end}), e -> struct(lo AS lo, size({a}) - lo - e AS na, size({b}) - lo - e AS nb))[0])[0]"


def differing_paragraphs(a: str, b: str) -> str:
    """SQL expression over two serialised trees: the ``section.paragraph`` positions in ``a`` where ``b`` differs.

    Equal roots give an empty list.  Else the sections that both have at their start and
    end are left out by their hashes, then the paragraphs of the rest in the same way.
    Listed are the paragraphs left in ``a`` that are not among those left in ``b``; all
    that are left where only their order differs; the one after the gap (or the last)
    where ``b`` only has more.
    """
    sections = "transform(split(substring({}, 66), '\\\\|'), (s, n) -> struct(s AS x, cast(n AS string) AS n))"
    parts = "flatten(transform(slice({s}, m.lo + 1, m.n{w}), s -> transform(split(substring(s.x, 18), ';'), (p, j) -> struct(p AS x, concat(s.n, '.', j) AS n))))"
    at = "concat(cast(m.lo AS string), '.0')"
    left = "slice({p}, q.lo + 1, q.n{w})"
    held = f"transform({left.format(p='pb', w='b')}, y -> substr(y.x, 1, 16))"
    missing = f"filter({left.format(p='pa', w='a')}, y -> NOT array_contains({held}, substr(y.x, 1, 16)))"
    gap = f"array(coalesce(get(pa, q.lo).n, get(pa, size(pa) - 1).n, {at}))"
    picked = f"CASE WHEN q.na = 0 THEN {gap} WHEN size({missing}) > 0 THEN transform({missing}, y -> y.n) ELSE transform({left.format(p='pa', w='a')}, y -> y.n) END"
    let = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    whole = let(sections.format(a), "sa", let(sections.format(b), "sb", let(_middle("sa", "sb"), "m", let(parts.format(s="sa", w="a"), "pa", let(parts.format(s="sb", w="b"), "pb", let(_middle("pa", "pb"), "q", picked))))))
    return f"CASE WHEN substr({a}, 1, 64) = substr({b}, 1, 64) THEN cast(array() AS array<string>) ELSE {whole} END"


def in_ranges(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Deal the rows by ranges of (doc_id, text hash) that hold about as many rows each; null ids come first.

    Adds ``__key``, ``__b`` (the range, a partition of its own) and ``__guest``: rows move
    once, but the first row of a range also visits the range before it, as its guest, and
    that of the first range the last.  So neither many null ids nor one common id make a
    large range, no range has to wait for another and no single task sees all rows.  A row
    finds its range in ``STEPS`` comparisons, however many ranges there are, and the list of
    them is not copied to the rows.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(max(2 * parts, 2), 1 << STEPS)
    share = min(1.0, PER_RANGE * ranges / max(df.count(), 1))
    df = df.withColumn("__key", F.struct(F.col(doc_id).isNotNull().alias("known"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("tie")))
    # One row of about `ranges` keys: the least of all, then every PER_RANGE-th of a sample by hash.
    sampled = F.when(F.pmod(F.xxhash64("__key"), F.lit(1 << 30)) < int(share * (1 << 30)), F.col("__key"))
    table = df.agg(F.min("__key").alias("lo"), F.sort_array(F.collect_set(sampled)).alias("some"))
    bounds = table.select(F.expr(f"slice(concat(array(lo), filter(some, (x, i) -> i > 0 AND i % {PER_RANGE} = 0 AND x <> lo)), 1, {1 << STEPS})")).scalar()
    df = df.withColumn("__bounds", bounds).withColumn("__own", F.lit(0))
    for k in reversed(range(STEPS)):
        df = df.withColumn("__own", F.expr(f"CASE WHEN get(__bounds, __own + {1 << k}) <= __key THEN __own + {1 << k} ELSE __own END"))
    visits = "array(struct(__own AS b, 0 AS guest), struct(pmod(__own - 1, size(__bounds)) AS b, 1 AS guest))"
    df = df.withColumn("__at", F.expr(f"explode_outer(CASE WHEN __key = get(__bounds, __own) THEN {visits} ELSE array(struct(__own AS b, 0 AS guest)) END)"))
    df = df.select("*", F.col("__at.b").alias("__b"), F.col("__at.guest").alias("__guest")).drop("__bounds", "__own", "__at")
    return df.repartitionById(ranges, F.col("__b"))


def with_next(df: DataFrame, **leads: str) -> DataFrame:
    """Add to rows ``in_ranges`` each of ``leads``, a column's value in the next row; after the last that of the first.  Guests go."""
    order = Window.partitionBy("__b").orderBy("__guest", "__key")
    df = df.withColumns({out: F.lead(column).over(order) for out, column in leads.items()})
    return df.where("__guest = 0").drop("__key", "__b", "__guest")


def edited_fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint each text and its edited text, whose last quarter is the start of the next document's."""
    docs = in_ranges(df.select(df[doc_id].alias("doc_id"), whole_text(df, text).alias("__t")), "doc_id", "__t")
    docs = with_next(with_tree(docs, "__t", "fingerprint"), __next="__t", __next_set="fingerprint_set")
    docs = docs.withColumn("n_chars", F.length("__t").cast("long"))
    docs = docs.withColumn("__e", F.expr("concat(substring(__t, 1, cast(n_chars - n_chars div 4 AS int)), substring(__next, 1, cast(n_chars div 4 AS int)))"))
    docs = with_tree(docs, "__e", "edited_fingerprint")
    return docs.select(
        "doc_id",
        "n_chars",
        F.sha2("__e", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        F.expr(likeness("fingerprint_set", "edited_fingerprint_set", "__t = __e")).alias("near_edited"),
        F.expr(likeness("fingerprint_set", "__next_set", "__t = __next")).alias("near_next"),
    )
