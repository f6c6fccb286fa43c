"""Secret scanning through a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: any text
with a match must hold all trigrams of at least one clause.  The index maps each trigram
that some rule needs to the rows that contain it (folded to lower case); intersecting
postings clause by clause gives each rule's candidates, and only those are verified with
the rule's expression.  Rules without mandatory trigrams scan all texts.

Spans are code points, end exclusive; matches of a kind are leftmost and do not overlap,
and a match that fails its length test is consumed and dropped.

Edge cases: null is the empty text; repeated rows get equal results; rules may overlap;
an empty table gives an empty result; the spans of a very long text with many matches
cost linear time; extra columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import checkpointed, row_key, whole_text


@dataclass(frozen=True)
class Rule:
    """``group`` of the match must have ``least`` characters or more."""

    kind: str
    regex: str
    group: int
    least: int


BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
ADDED_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20),
)
RULES = BASE_RULES + ADDED_RULES
BROADCAST_BYTES = 16 << 20
MOST = 64  # strings or clauses that a derivation may hold before it is weakened

Clauses = frozenset[frozenset[str]]
ALL: Clauses = frozenset([frozenset()])


def _either(a: Clauses, b: Clauses) -> Clauses:
    both = a | b
    least = frozenset(c for c in both if not any(d < c for d in both))
    return least if len(least) <= MOST else ALL


def _both(a: Clauses, b: Clauses) -> Clauses:
    if len(a) * len(b) > MOST:
        return min(a, b, key=len)
    return _either(frozenset(x | y for x in a for y in b), frozenset())


def _of(strings: set[str]) -> Clauses:
    out: Clauses = frozenset()
    for s in strings:
        out = _either(out, frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]))
    return out


def _derive(tree) -> tuple[set[str] | None, Clauses]:
    """The exact strings of the tree, if few, and a query that each match fulfils."""
    now, query, exact = {""}, ALL, True

    def flush():
        nonlocal now, query, exact
        query, now, exact = _both(query, _of(now)), {""}, False

    for op, arg in tree:
        if op is sre.LITERAL:
            own = {chr(arg).lower()}
        elif op is sre.SUBPATTERN:
            own, inner = _derive(arg[3])
        elif op is sre.BRANCH:
            parts = [_derive(x) for x in arg[1]]
            own = None if any(p[0] is None for p in parts) else set().union(*(p[0] for p in parts))
            inner = frozenset()
            for p in parts:
                inner = _either(inner, p[1] if p[0] is None else _of(p[0]))
        elif op is sre.IN and all(x[0] is sre.LITERAL for x in arg) and len(arg) <= 5:
            own = {chr(x[1]).lower() for x in arg}
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            own, inner = _derive(arg[2])
            if arg[:2] == (0, 1) and own is not None:
                own = own | {""}
            elif arg[0] == 0:
                own, inner = None, ALL
            else:
                inner, own = (inner if own is None else _of(own)), None
        elif op is sre.AT:
            continue
        else:
            own, inner = None, ALL
        if own is not None and len(now) * len(own) <= MOST:
            now = {a + b for a in now for b in own}
        else:
            flush()
            query = _both(query, inner if own is None else _of(own))
    if exact:
        return now, _of(now)
    flush()
    return None, query


def trigram_query(regex: str) -> Clauses:
    """Clauses (sets of lower-case trigrams) of which each match fulfils at least one; an empty clause means no condition."""
    return _derive(_parser.parse(regex))[1]


def _literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, __k) of the given trigrams over ``docs`` (__k, __t)."""
    listed = "array(" + ", ".join(_literal(t) for t in trigrams) + ")"
    found = f"transform(array(lower(__t)), low -> filter({listed}, t -> contains(low, t)))[0]"
    return docs.select("__k", F.explode_outer(F.expr(found)).alias("trigram"))


def candidates(docs: DataFrame, queries: dict[str, Clauses]) -> DataFrame:
    """(__k, rules): for each row the rules one of whose clauses has all its trigrams there."""
    spark = docs.sparkSession
    clauses = [(kind, i, t, len(c)) for kind, q in queries.items() for i, c in enumerate(q) for t in c]
    rows = ", ".join(f"struct({_literal(r)} AS rule, {i} AS clause, {_literal(t)} AS trigram, {n} AS need)" for r, i, t, n in clauses)
    listed = spark.range(1).selectExpr(f"inline(array({rows}))")
    postings = trigram_index(docs, sorted({c[2] for c in clauses})).distinct()
    met = postings.join(F.broadcast(listed), "trigram").groupBy("__k", "rule", "clause", "need").count().where("count = need")  # broadcast: a few rows per rule
    return met.groupBy("__k").agg(F.collect_set("rule").alias("rules"))


def _before(d: str) -> str:
    """SQL expression: for each item of the array the sum of those before it; in blocks, so that long arrays cost linear time."""
    run = "aggregate({x}, named_struct('t', {t}, 'o', cast(array() AS array<int>)), (a, y) -> named_struct('t', a.t + y, 'o', concat(a.o, array(a.t))), a -> a.o)"
    blocks = f"transform(sequence(0, (size({d}) - 1) div 256), b -> slice({d}, b * 256 + 1, 256))"
    sums = "transform(bs, b -> aggregate(b, 0, (a, y) -> a + y))"
    inner = run.format(x="b", t="get(base, i)")
    return f"transform(array({blocks}), bs -> transform(array({run.format(x=sums, t='0')}), base -> flatten(transform(bs, (b, i) -> {inner})))[0])[0]"


NONE = "cast(array() AS array<struct<start: int, ord: int, end: int, kind: string>>)"


def _spans(rule: Rule, order: int) -> str:
    """SQL expression: the rule's spans in ``__t`` as structs (start, order, end, kind), from the lengths of the matches and of what lies between."""
    r = _literal(rule.regex)
    match = f"transform(regexp_extract_all(__t, {r}, 0), x -> length(x))"
    own = f"transform(regexp_extract_all(__t, {r}, {rule.group}), x -> length(x))" if rule.group else "m"
    gap = f"transform(split(__t, {r}, -1), x -> length(x))"
    made = f"filter(zip_with(zip_with(g, b, (x, y) -> x + y), zip_with(m, v, (x, y) -> struct(x AS m, y AS v)), (s, z) -> struct(s AS s, z.m AS m, z.v AS v)), z -> z.v >= {rule.least})"
    shown = f"transform({made}, z -> struct(z.s AS start, {order} AS ord, z.s + z.m AS end, '{rule.kind}' AS kind))"
    let = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    spans = let(match, "m", let(own, "v", let(gap, "g", let(_before("zip_with(slice(g, 1, size(m)), m, (x, y) -> x + y)"), "b", shown))))
    return f"CASE WHEN __t RLIKE {r} THEN {spans} ELSE {NONE} END"


def find_secrets(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per input row: its id, row key ``__k`` and ``found``: spans (start, ord, end, kind) in order, ``ord`` the rule's place."""
    docs = df.select(df[doc_id].alias("__id"), whole_text(df, text).alias("__t"))
    docs = docs.withColumn("__k", row_key(F.col("__id"), F.col("__t")))
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    indexed = {k: q for k, q in queries.items() if frozenset() not in q}
    if indexed:
        # Texts stay where they are if the list of candidates, checked by its bytes, may be broadcast.
        found = checkpointed(candidates(docs, indexed))
        size = found.agg(F.expr("sum(48 + 24 * size(rules))").alias("bytes")).first()["bytes"] or 0
        docs = docs.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "__k", "left")
    else:
        docs = docs.withColumn("rules", F.lit(None).cast("array<string>"))
    per_rule = [f"CASE WHEN array_contains(rules, '{r.kind}') THEN {_spans(r, i)} ELSE {NONE} END" if r.kind in indexed else _spans(r, i) for i, r in enumerate(rules)]
    return docs.select(F.col("__id").alias(doc_id), "__k", F.expr(f"array_sort(concat({', '.join(per_rule)}))").alias("found"))


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The counts, digest of base spans and list of all spans."""
    shown = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    count = "cast(size(filter(found, s -> s.kind = '{}')) AS bigint) AS n_{}"
    base = f"filter(found, s -> s.ord < {len(BASE_RULES)})"
    return found.selectExpr(doc_id, *[count.format(r.kind, r.kind) for r in BASE_RULES], f"sha2({shown.format(base)}, 256) AS base_sha256", f"{shown.format('found')} AS spans")
