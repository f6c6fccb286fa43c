"""Mixing to target weights with soft domain membership.

A classifier learned from the labelled table gives each document a posterior over the
domains ``toxic``, ``low`` and ``high`` (quality).  From a bounded sample of about
``sample`` labelled documents it learns marks, five-character word beginnings that are
far more frequent in the toxic or the low documents than elsewhere, with their log odds.
A text's evidence is the sum of the log odds of its distinct marks, one sum a domain; a
multinomial logistic regression turns the two sums into a posterior.  The regression is
fitted to evidence from marks learned on the other half of the sample, so its posteriors
are calibrated on documents that had no part in the marks.  Marks travel as a hash table
of literals (colliding ones on further levels), so classifying moves no rows.  Posteriors
are given to three decimals.

Nonnegative document rates are then fitted so that the expected tokens of each domain,
sum of rate * tokens * posterior, match the target shares of all tokens: least squares of
the deviations relative to each domain's tokens, with a ridge towards the prior rate, by
accelerated projected gradient in the inner product weighted by tokens (so that length
alone moves no rate).
A rate depends on the document's posterior alone, so documents are first added up by
posterior, of which three decimals allow 501,501 at most; a step is one aggregation over
those rows, and its three sums are all that reaches the driver.  The rates are the fold
of the steps, each clipped at 0.  The prior rate is 1 less twice the share in domains of
target 0, at least 0: the clipping takes out documents that lie there for the larger
part, while those hardly in it keep a rate near that of others.

Edge cases: null and wordless texts have 0 tokens, the posterior of no evidence and a rate
like any other; without labels the posterior is all ``high`` and rates stay 1; of
conflicting labels of one id the worst domain counts; repeated rows get equal rates; an
empty table gives an empty result; a very long text is one row; extra columns of either
table are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import checkpointed, dropped, row_key, whole_text

DOMAINS = ("toxic", "low", "high")
TARGETS = {"toxic": 0.0, "low": 0.15, "high": 0.85}
SAMPLE, FEATURES, SLOTS, STEPS, RIDGE = 20_000, 600, 4096, 120, 0.1
#: What makes a mark: documents that hold it, times its share elsewhere, standard deviations above chance.
LEAST_DOCS, LEAST_LIFT, LEAST_Z = 3, 3.0, 4.0
DECIMALS, MOST_EVIDENCE = 3, 40.0

_WORDS = "filter(split(lower({t}), '[ \\\\t\\\\r\\\\n\\\\f]+'), x -> x <> '')"


@dataclass
class Model:
    """``marks``: hash of a word beginning -> log odds of toxic and of low; ``weights``: intercept and factors of the evidence, for toxic and for low against high."""

    marks: dict[int, tuple[float, float]] = field(default_factory=dict)
    weights: list[list[float]] | None = None


def _literal(values: list[object], kind: str) -> str:
    return f"cast(split('{','.join(map(str, values))}', ',') AS array<{kind}>)"


def with_evidence(docs: DataFrame, marks: dict[int, tuple[float, float]]) -> DataFrame:
    """Add ``n_tokens`` and the evidence ``s0`` (toxic) and ``s1`` (low) to ``docs`` (with __t)."""
    levels: list[dict[int, int]] = []  # slot -> number of the mark
    order = sorted(marks)
    for n, h in enumerate(order):
        level = next((x for x in levels if h % SLOTS not in x), None)
        if level is None:
            levels.append(level := {})
        level[h % SLOTS] = n
    slot = f"cast(pmod(h, {SLOTS}) AS int)"
    number = "-1"
    for level in levels[::-1]:
        keys = _literal([order[level[i]] if i in level else 0 for i in range(SLOTS)], "bigint")
        places = _literal([level.get(i, -1) for i in range(SLOTS)], "int")
        number = f"CASE WHEN get({keys}, {slot}) = h THEN get({places}, {slot}) ELSE {number} END"
    docs = docs.withColumn("__w", F.expr(_WORDS.format(t="__t")))
    held = f"array_distinct(filter(transform(transform(__w, x -> xxhash64(substr(x, 1, 5))), h -> {number}), n -> n >= 0))"
    docs = docs.withColumns({"n_tokens": F.size("__w").cast("long"), "__m": F.expr(held)}).drop("__w")
    sums = {f"s{c}": F.expr(f"least({MOST_EVIDENCE}D, aggregate(__m, 0D, (a, n) -> a + get({_literal([f'{marks[h][c]:.6f}' for h in order] or [0], 'double')}, n)))") for c in range(2)}
    return docs.withColumns(sums).drop("__m")


def marks_of(counts: DataFrame, size: list[int], columns: tuple[str, str, str], features: int) -> dict[int, tuple[float, float]]:
    """The marks by a table of word beginnings ``f`` with the documents of each domain that hold them (``columns``)."""
    total = sum(size)
    if not total:
        return {}
    n = dict(zip(("n0", "n1", "n2"), columns, strict=True))
    table = counts.select("f", F.xxhash64("f").alias("h"), *[F.col(c).alias(k) for k, c in n.items()]).where(f"f <> '' AND n0 + n1 >= {LEAST_DOCS}")
    rate = f"((n0 + n1 + n2) / {total}D)"
    tests = [f"CASE WHEN n{i} / {max(m, 1)}D >= {LEAST_LIFT}D * {rate} THEN (n{i} - {m} * {rate}) / sqrt({m} * {rate} * (1 - {rate}) + 0.5) ELSE 0D END" for i, m in enumerate(size[:2])]
    odds = [f"ln((n{i} + 0.5D) / {m + 1}D) - ln((n0 + n1 + n2 - n{i} + 0.5D) / {total - m + 1}D)" for i, m in enumerate(size[:2])]
    found = table.selectExpr("f", "h", *[f"{t} AS z{i}" for i, t in enumerate(tests)], *[f"{o} AS w{i}" for i, o in enumerate(odds)]).where(f"greatest(z0, z1) >= {LEAST_Z}D")
    rows = found.orderBy(F.desc(F.greatest("z0", "z1")), "f").limit(features).collect()  # the classifier's features
    return {r["h"]: tuple(r[f"w{i}"] if r[f"z{i}"] >= LEAST_Z else 0.0 for i in range(2)) for r in rows}


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    n = len(b)
    rows = [[*r, x] for r, x in zip(a, b, strict=True)]
    for i in range(n):
        k = max(range(i, n), key=lambda j: abs(rows[j][i]))
        rows[i], rows[k] = rows[k], rows[i]
        for j in range(n):
            if j != i:
                f = rows[j][i] / rows[i][i]
                rows[j] = [x - f * y for x, y in zip(rows[j], rows[i], strict=True)]
    return [rows[i][n] / rows[i][i] for i in range(n)]


def posterior(weights: list[list[float]], s: tuple[float, float]) -> list[float]:
    z = [w[0] + w[1] * s[0] + w[2] * s[1] for w in weights] + [0.0]
    top = max(z)
    e = [math.exp(x - top) for x in z]
    return [x / sum(e) for x in e]


def fit_logistic(rows: list[tuple[float, float, int, int]], ridge: float = 0.5, steps: int = 40) -> list[list[float]]:
    """Weights of the multinomial logistic regression on (s0, s1, domain, number) by damped Newton steps; the ridge keeps separable data finite."""
    w = [[0.0] * 3, [0.0] * 3]

    def loss(w: list[list[float]]) -> float:
        return ridge / 2 * sum(x * x for r in w for x in r[1:]) + 1e-3 * sum(r[0] ** 2 for r in w) - sum(n * math.log(max(posterior(w, (a, b))[d], 1e-300)) for a, b, d, n in rows)

    at = loss(w)
    for _ in range(steps):
        grad = [(ridge if i % 3 else 2e-3) * w[i // 3][i % 3] for i in range(6)]
        hess = [[(ridge if i % 3 else 2e-3) * (i == j) for j in range(6)] for i in range(6)]
        for a, b, d, n in rows:
            p, x = posterior(w, (a, b)), (1.0, a, b)
            for c in range(2):
                off = n * (p[c] - (d == c))
                for k in range(3):
                    grad[3 * c + k] += off * x[k]
                for e in range(2):
                    v = n * p[c] * ((c == e) - p[e])
                    for k in range(3):
                        for m in range(3):
                            hess[3 * c + k][3 * e + m] += v * x[k] * x[m]
        step, size = _solve(hess, grad), 1.0
        while True:
            new = [[w[c][k] - size * step[3 * c + k] for k in range(3)] for c in range(2)]
            if (there := loss(new)) <= at or size < 1e-6:
                break
            size /= 2
        if at - there < 1e-6 * (1 + at):
            return w
        w, at = new, there
    return w


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Model:
    """``docs``: __id, __t."""
    domain = F.expr("CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 WHEN quality = 1 THEN 2 END")
    labels = labels.select(F.col("doc_id").alias("__id"), domain.alias("d")).where("__id IS NOT NULL AND d IS NOT NULL").groupBy("__id").agg(F.min("d").alias("d"))
    share = min(1.0, sample / max(1, labels.count()))
    chosen = labels.where(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < share * 1_000_000)
    rows = checkpointed(docs.join(F.broadcast(chosen), "__id").select("__id", "__t", "d", F.expr("pmod(xxhash64(__id, 'half'), 2)").alias("half")))  # broadcast: about `sample` ids
    held = rows.select("d", "half", F.explode_outer(F.expr(f"array_union(array(''), transform({_WORDS.format(t='__t')}, x -> substr(x, 1, 5)))")).alias("f"))
    cells = [F.count_if((F.col("d") == i) & (F.col("half") == h)).alias(f"h{h}{i}") for h in range(2) for i in range(3)]
    counts = checkpointed(held.groupBy("f").agg(*cells).withColumns({f"n{i}": F.col(f"h0{i}") + F.col(f"h1{i}") for i in range(3)}))
    whole = counts.where("f = ''").first()
    if whole is None:
        return Model()
    size = {h: [whole[f"{h}{i}"] for i in range(3)] for h in ("h0", "h1", "n")}
    marks = {h: marks_of(counts, size[h], tuple(f"{h}{i}" for i in range(3)), features) for h in size}
    crossed = with_evidence(rows.where("half = 1"), marks["h0"]).unionByName(with_evidence(rows.where("half = 0"), marks["h1"]))
    table = crossed.groupBy(F.round("s0", 1).alias("s0"), F.round("s1", 1).alias("s1"), "d").count().collect()  # at most a row a sampled document
    dropped(rows, counts)
    return Model(marks["n"], fit_logistic([tuple(r) for r in table]))


def with_posterior(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``n_tokens`` and p0..p2 (in the order of DOMAINS, to three decimals, of sum 1) to ``docs`` (with __t)."""
    docs = with_evidence(docs, model.marks)
    if model.weights is None:
        return docs.withColumns({"p0": F.lit(0.0), "p1": F.lit(0.0), "p2": F.lit(1.0)}).drop("s0", "s1")
    z = [f"({w[0]!r}D + {w[1]!r}D * s0 + {w[2]!r}D * s1)" for w in model.weights]
    top = f"greatest(0D, {z[0]}, {z[1]})"
    total = f"(exp({z[0]} - {top}) + exp({z[1]} - {top}) + exp(-{top}))"
    docs = docs.withColumns({f"p{i}": F.expr(f"round(exp({z[i]} - {top}) / {total}, {DECIMALS})") for i in range(2)}).drop("s0", "s1")
    return docs.withColumn("p2", F.expr(f"greatest(0D, round(1D - p0 - p1, {DECIMALS}))"))


def prior_rate(targets: dict[str, float] = TARGETS) -> str:
    """SQL expression: 1, less twice the share in domains of target 0, at least 0: where the ridge pulls and the descent starts."""
    return f"greatest(0D, 1D - 2D * ({' + '.join(['0D', *(f'p{i}' for i, d in enumerate(DOMAINS) if targets[d] == 0)])}))"


def rate_of(steps: list[tuple[float, float, float, float]], targets: dict[str, float] = TARGETS, momentum: float | None = None) -> str:
    """SQL expression: the rate after the given steps (momentum, and the gradient's factor for each domain), or the point ahead of it by ``momentum``."""
    prior = prior_rate(targets)
    if not steps:
        return prior
    listed = "array(" + ", ".join(f"struct({m!r}D AS m, {a!r}D AS a, {b!r}D AS b, {c!r}D AS c)" for m, a, b, c in steps) + ")"
    y = "(s.r + e.m * (s.r - s.q))"
    new = f"greatest(0D, {y} - {RIDGE / (1 + RIDGE)!r}D * ({y} - s.z) - (e.a * p0 + e.b * p1 + e.c * p2))"
    end = "s -> s.r" if momentum is None else f"s -> s.r + {momentum!r}D * (s.r - s.q)"
    return f"aggregate({listed}, named_struct('r', {prior}, 'q', {prior}, 'z', {prior}), (s, e) -> named_struct('r', {new}, 'q', s.r, 'z', s.z), {end})"


def fit_rates(parts: DataFrame, targets: dict[str, float] = TARGETS, steps: int = STEPS) -> list[tuple[float, float, float, float]]:
    """The steps of the projected gradient; ``parts``: n_tokens, p0..p2, few rows."""
    goal = [targets[d] / sum(targets.values()) for d in DOMAINS]
    whole = parts.agg(F.sum("n_tokens").cast("double").alias("n"), *[F.expr(f"sum(n_tokens * p{i})").alias(f"t{i}") for i in range(3)]).first()
    if not whole["n"]:
        return []
    # Deviations count relative to the domain's share, so every domain settles as fast; the step is safe for any memberships.
    mass = [max(whole[f"t{i}"] / whole["n"], 1e-3) for i in range(3)]
    taken: list[tuple[float, float, float, float]] = []
    root = math.sqrt((1 + RIDGE) / RIDGE)  # of the condition number
    for _ in range(steps):
        momentum = (root - 1) / (root + 1) if taken else 0.0
        got = parts.select("n_tokens", "p0", "p1", "p2", F.expr(rate_of(taken, targets, momentum)).alias("y")).agg(*[F.expr(f"sum(n_tokens * p{i} * y)").alias(f"t{i}") for i in range(3)]).first()
        off = [(got[f"t{i}"] / whole["n"] - goal[i]) / mass[i] for i in range(3)]
        step = (momentum, *[x / (1 + RIDGE) for x in off])
        still = len(taken) > 3 and max(abs(x - y) for x, y in zip(step[1:], taken[-1][1:], strict=True)) < 1e-6
        taken.append(step)
        if still:
            break
    return taken


def mix(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", targets: dict[str, float] = TARGETS, sample: int = SAMPLE) -> DataFrame:
    """Per input row: id, row key ``__k``, n_tokens, p_toxic, p_low, p_high, rate, copies (rate rounded at random by a hash of the row, on average the rate)."""
    docs = df.select(df[doc_id].alias("__id"), whole_text(df, text).alias("__t"))
    parts = with_posterior(docs.withColumn("__k", row_key(F.col("__id"), F.col("__t"))), learn(docs, labels, sample)).drop("__t")
    parts = checkpointed(parts)
    sums = checkpointed(parts.groupBy("p0", "p1", "p2").agg(F.sum("n_tokens").alias("n_tokens")).coalesce(8))
    steps = fit_rates(sums, targets)
    dropped(sums)
    names = [F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(DOMAINS)]
    out = parts.select(F.col("__id").alias(doc_id), "__k", "n_tokens", *names, F.expr(f"round({rate_of(steps, targets)}, 6)").alias("rate"))
    return out.withColumn("copies", F.expr("cast(floor(rate + pmod(xxhash64(__k, 'copies'), 1000000) / 1000000D) AS bigint)"))
