"""Near-duplicate detection by Order MinHash.

A text is the sequence of its shingles: ``shingle`` consecutive lower-case words (all of
them where there are fewer).  Each of ``rows * bands`` hash functions picks the two
smallest shingles, labelled by occurrence, and keeps them in text order, so a sketch is
sensitive to order as edit distance is.  Documents that agree on all ``rows`` sketches of
a band are candidates.  A candidate pair is settled by aligning the two sequences inside
a band of the width that the threshold allows: similarity = LCS / (|a| + |b| - LCS), the
Jaccard measure of the alignment, and ``similarity`` or more links the pair.

Copies (equal word sequences) share one representative, so a group of copies of any size
counts once.  Every pair of representatives that shares a bucket is aligned once, in the
bucket of its first common band: a bucket is dealt into blocks by a hash of its members
and each pair of blocks is one piece of work, so a large bucket is compared whole by many
tasks.  A piece returns a count of links a member and the edges that join its members,
never the pairs.  Classes are the connected components, found by min-label propagation
with pointer jumping on the distributed edge table.

Edge cases: null is the empty text; all wordless texts form one class; repeated rows
belong to one class; the class id is the smallest doc_id in it (null ids last); an empty
table gives an empty result; very long texts are hashed in segments and aligned whole;
extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import BROADCAST_KEYS, OFTEN, checkpointed, dropped, row_key, small_batches, split_join, whole_text

SHINGLE, SIMILARITY, ROWS, BANDS = 5, 0.8, 3, 20
#: Buckets up to this many members (and bytes of text) are one block; it sets the size of a piece of work, not the result.
SMALL_BUCKET, BLOCK_BYTES = 256, 1 << 24
BROADCAST_ROWS = 500_000
SEGMENT = 1 << 20

_P = 0x9E3779B97F4A7C15 | 1
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _tables or _tables["p"].size < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("p", _P), ("i", pow(_P, -1, 1 << 64))):
            _tables[name] = np.cumprod(np.append(np.uint64(1), np.full(size - 1, base, np.uint64)), dtype=np.uint64)
    return _tables["p"], _tables["i"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def shingle_hashes(norm: str, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the shingles of a normalised text, in order."""
    raw = np.frombuffer(norm.encode("utf-8", "surrogatepass"), np.uint8)
    if not raw.size:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(raw == 32)
    start, end = np.append(0, gaps + 1), np.append(gaps, raw.size)
    step = min(shingle, start.size)
    start, end = start[: start.size - step + 1], end[step - 1 :]
    out = np.empty(start.size, np.uint64)
    at = 0
    while at < start.size:  # segments bound the memory of a very long text
        to = max(at + 1, int(np.searchsorted(end, start[at] + SEGMENT, "right")))
        lo, hi = int(start[at]), int(end[to - 1])
        p, inv = _powers(hi - lo)
        sums = np.append(np.uint64(0), np.cumsum((raw[lo:hi].astype(np.uint64) + np.uint64(1)) * p[: hi - lo], dtype=np.uint64))
        s = start[at:to] - lo
        out[at:to] = (sums[end[at:to] - lo] - sums[s]) * inv[s]
        at = to
    return _mix(out)


def sketch(h: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> list[int]:
    """One 64-bit key a band (the band is part of the key); none without shingles."""
    if not h.size:
        return []
    label = h
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    if (ranked[1:] == ranked[:-1]).any():
        first = np.append(True, ranked[1:] != ranked[:-1])
        nth = np.arange(h.size) - np.maximum.accumulate(np.where(first, np.arange(h.size), 0))
        occurrence = np.empty(h.size, np.uint64)
        occurrence[order] = nth.astype(np.uint64)
        label = _mix(h + occurrence * np.uint64(0xD6E8FEB86659FD93))
    n = rows * bands
    seeds = _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_P)) | np.uint64(1)
    value, place = np.zeros((0, n), np.uint64), np.zeros((0, n), np.int64)
    width, every = np.arange(n), 1 << 14
    for at in range(0, h.size, every):
        v = seeds[:, None] * label[None, at : at + every]
        for _ in range(min(2, v.shape[1])):
            i = v.argmin(1)
            value, place = np.vstack([value, v[width, i][None]]), np.vstack([place, (i + at)[None]])
            v[width, i] = np.uint64(0xFFFFFFFFFFFFFFFF)
        if value.shape[0] > 2:
            two = np.argsort(value, 0, kind="stable")[:2]
            value, place = np.take_along_axis(value, two, 0), np.take_along_axis(place, two, 0)
    place = np.sort(place, 0)
    own = _mix(h[place[0]] * np.uint64(3) + _mix(h[place[-1]] + np.uint64(place.shape[0])))
    keys = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        keys = _mix(keys * np.uint64(_P) + own[r::rows][:bands])
    return keys.view(np.int64).tolist()


def banded_lcs(a: list[int], b: list[int], width: int) -> int:
    """Length of the longest common subsequence among alignments within ``width`` of the diagonal.

    Bit-parallel: bit i of the window is 0 where the row's LCS grows at that column.
    """
    if not a or not b:
        return 0
    size = 2 * width + 1
    full = (1 << size) - 1
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << (i + width))  # columns moved by `width`: never negative
    v, base = full, 0
    for j, y in enumerate(b):
        if j:
            base += 1 - (v & 1)
            v = (v >> 1) | (1 << (size - 1))
        m = (where.get(y, 0) >> j) & full
        u = v & m
        v = ((v + u) | (v - u)) & full
    lo = len(b) - 1 - width  # column of bit 0 after the last row
    seen = min(size, len(a) - lo)
    return base + (seen - (v & ((1 << seen) - 1)).bit_count() if seen > 0 else 0)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """LCS / (|a| + |b| - LCS), exact where it reaches ``least``; 0 where the lengths rule that out."""
    if min(a.size, b.size) < least * max(a.size, b.size) or not a.size:
        return 0.0
    n = min(a.size, b.size)
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if differ.size else n
    rest = n - head
    differ = np.flatnonzero(a[a.size - rest :][::-1] != b[b.size - rest :][::-1]) if rest else np.zeros(0)
    tail = int(differ[0]) if differ.size else rest
    x, y = a[head : a.size - tail], b[head : b.size - tail]
    width = int((a.size + b.size) * (1 - least) / (1 + least)) + 1
    both = head + tail + banded_lcs(x.tolist(), y.tolist(), min(width, max(x.size, y.size)))
    return both / (a.size + b.size - both)


def _sketched(docs: DataFrame, shingle: int, rows: int, bands: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, keys, sizes = [], [], []
            for text in batch["__t"].to_pylist():
                norm = normalise(text)
                d = hashlib.blake2b(norm.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                digests.append(np.frombuffer(d, np.int64))
                keys.append(sketch(shingle_hashes(norm, shingle), rows, bands))
                sizes.append(len(norm))
            d = np.array(digests, np.int64).reshape(-1, 2)
            yield pa.record_batch([batch["__id"], batch["__k"], pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], ["__id", "__k", "d1", "d2", "keys", "size"])

    kind = docs.schema["__id"].dataType.simpleString()
    return docs.select("__id", "__k", "__t").mapInArrow(run, f"__id {kind}, __k long, d1 long, d2 long, keys array<long>, size long")


def _reaches(a: np.ndarray, b: np.ndarray, ranked: np.ndarray, order: np.ndarray, least: float) -> bool:
    """Whether the similarity of ``a`` and ``b`` is ``least`` or more; ``ranked`` is ``a[order]``, sorted."""
    at = np.minimum(np.searchsorted(ranked, b), a.size - 1)
    hit = ranked[at] == b
    common = int(np.count_nonzero(hit))  # no alignment is longer
    if common < least * (a.size + b.size - common):
        return False
    place = order[at[hit]]
    if (place[1:] > place[:-1]).all():  # an alignment of that length
        return common / (a.size + b.size - common) >= least
    return similarity(a, b, least) >= least


def block_links(reps: list[int], texts: list[str], keys: np.ndarray, side: np.ndarray, band: int, shingle: int, least: float) -> list[tuple[int, int, int]]:
    """(member, smallest member it is joined to, links) over one piece of a bucket; members without a link are left out.

    Pairs are taken inside the block if all are on one ``side``, else across the two, and
    only if ``band`` is the first that they share.
    """
    h = [shingle_hashes(normalise(t), shingle) for t in texts]
    size = np.array([x.size for x in h])
    one = bool((side == side[0]).all())
    links, up = np.zeros(len(h), np.int64), list(range(len(h)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in range(len(h)):
        rest = np.arange(i + 1, len(h)) if one else np.flatnonzero(side > side[i])
        rest = rest[np.minimum(size[rest], size[i]) >= least * np.maximum(size[rest], size[i])]
        rest = rest[(keys[rest] == keys[i]).argmax(1) == band]
        if not rest.size:
            continue
        order = np.argsort(h[i], kind="stable")
        ranked = h[i][order]
        for j in rest.tolist():
            if _reaches(h[i], h[j], ranked, order, least):
                links[i] += 1
                links[j] += 1
                x, y = top(i), top(j)
                if reps[x] < reps[y]:
                    up[y] = x
                else:
                    up[x] = y
    return [(reps[i], reps[top(i)], int(links[i])) for i in np.flatnonzero(links).tolist()]


def _links(reps: DataFrame, texts: DataFrame, shingle: int, least: float, block: int) -> DataFrame:
    """(a, b, n) over all candidate pairs of ``reps`` (rep, keys, size): the edges that join a class, and in ``n`` the links of a."""
    buckets = reps.select("rep", "size", F.posexplode_outer("keys").alias("band", "key")).where("key IS NOT NULL")
    sets = buckets.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("band").alias("band"), F.expr("bit_xor(xxhash64(rep, 1))").alias("s1"), F.expr("bit_xor(xxhash64(rep, 2))").alias("s2")).where("n > 1")
    # Buckets of equal members offer equal pairs; the lowest band has them all.
    sets = sets.groupBy("n", "s1", "s2").agg(F.min(F.struct("band", "key", "size")).alias("f"))
    sets = checkpointed(sets.select(F.col("f.key").alias("key"), "n", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("f.size") / BLOCK_BYTES)).cast("int").alias("blocks")))
    members = split_join(buckets.select("rep", "band", "key"), sets, ["key"]).withColumn("own", F.expr("CAST(pmod(xxhash64(rep, key), blocks) AS INT)"))
    members = members.withColumn("other", F.explode_outer(F.expr("sequence(0, blocks - 1)")))
    members = checkpointed(members.select("rep", "band", "key", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))
    wanted = members.select(F.col("rep").alias("__k")).distinct()
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = texts.join(F.broadcast(wanted) if few else wanted, "__k", "left_semi").dropDuplicates(["__k"]).withColumnRenamed("__k", "rep")
    pieces = members.join(reps.select("rep", "keys"), "rep").join(texts, "rep").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settled() -> pa.RecordBatch:
            reps, texts, keys, side = (list(c) for c in zip(*piece, strict=True))
            found = block_links(reps, texts, np.array(keys, np.int64), np.array(side), at[3], shingle, least)
            return pa.record_batch([pa.array([r[c] for r in found], pa.int64()) for c in range(3)], ["a", "b", "n"])

        at, piece = None, []
        for batch in batches:
            c = {name: batch[name].to_pylist() for name in ("key", "i", "j", "band", "rep", "__t", "keys", "own")}
            for here, row in zip(zip(c["key"], c["i"], c["j"], c["band"], strict=True), zip(c["rep"], c["__t"], c["keys"], c["own"], strict=True), strict=True):
                if here != at and len(piece) > 1:
                    yield settled()
                if here != at:
                    at, piece = here, []
                piece.append(row)
        if len(piece) > 1:
            yield settled()

    return checkpointed(pieces.select("key", "i", "j", "band", "rep", "__t", "keys", "own").mapInArrow(run, "a long, b long, n long"))


def components(edges: DataFrame) -> DataFrame:
    """(k, label): the smallest member of the component, for every end of an edge (a, b).

    Edges to hubs meet the hub's label by broadcast (there are at most BROADCAST_KEYS
    hubs), so no task gathers a hub's edges.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    degree = both.groupBy("b").agg(F.count("*").alias("n"))
    hubs = checkpointed(degree.where(F.col("n") > max(OFTEN, both.count() / BROADCAST_KEYS)).select("b"))
    some = not hubs.isEmpty()
    plain = both.join(F.broadcast(hubs), "b", "left_anti") if some else both
    hub = both.join(F.broadcast(hubs), "b", "left_semi") if some else None
    labels = checkpointed(both.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m")).select("k", F.least("k", "m").alias("label")))
    rounds = 0
    while True:
        rounds += 1
        old = labels
        if rounds > 3:  # long chains: jump to the label of the label
            info = labels.groupBy("label").agg(F.count("*").alias("n")).join(labels.select(F.col("k").alias("label"), F.col("label").alias("up")), "label")
            labels = checkpointed(split_join(labels, checkpointed(info), ["label"]).select("k", F.least("label", "up").alias("label")))
            dropped(old)
        named = labels.select(F.col("k").alias("b"), "label")
        told = plain.join(named, "b").select(F.col("a").alias("k"), "label", F.lit(None).cast("long").alias("own"))
        if some:
            told = told.union(hub.join(F.broadcast(named.join(F.broadcast(hubs), "b")), "b").select(F.col("a").alias("k"), "label", F.lit(None).cast("long").alias("own")))
        told = told.union(labels.select("k", "label", F.col("label").alias("own")))
        new = checkpointed(told.groupBy("k").agg(F.min("label").alias("label"), F.max("own").alias("own")))
        dropped(labels)
        if new.where("label <> own").isEmpty():
            dropped(both, hubs)
            return new.select("k", "label")
        labels = checkpointed(new.select("k", "label"))
        dropped(new)


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, least: float = SIMILARITY, rows: int = ROWS, bands: int = BANDS, small_bucket: int = SMALL_BUCKET
) -> DataFrame:
    """Per input row: id, row key ``__k``, ``class_id``, ``class_size`` (rows), ``n_links`` (the different texts among its text's candidates that reach ``least``), ``kept`` (first of its class)."""
    small_batches(df.sparkSession)
    docs = df.select(df[doc_id].alias("__id"), whole_text(df, text).alias("__t"))
    docs = docs.withColumn("__k", row_key(F.col("__id"), F.col("__t")))
    sketched = checkpointed(_sketched(docs, shingle, rows, bands))
    firsts = sketched.groupBy("d1", "d2").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__k")).alias("f"), F.count("*").alias("n"))
    firsts = checkpointed(firsts.select("d1", "d2", F.col("f.__k").alias("rep"), "n"))
    reps = sketched.join(firsts.select("d1", "d2", F.col("rep").alias("__k")), ["d1", "d2", "__k"]).withColumnRenamed("__k", "rep").dropDuplicates(["rep"])
    found = _links(reps.select("rep", "keys", "size"), docs.select("__k", "__t"), shingle, least, small_bucket)
    # A member is joined once for each piece it was in: it keeps its smallest, to which its others are joined.
    stars = checkpointed(found.where("a <> b").groupBy("a").agg(F.min("b").alias("m"), F.collect_set("b").alias("all")))
    others = stars.where("size(all) > 1").select(F.explode_outer("all").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    labels = components(stars.select("a", F.col("m").alias("b")).union(others))
    dropped(stars)
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n_links"))
    named = firsts.join(labels.withColumnRenamed("k", "rep"), "rep", "left").join(links, "rep", "left")
    named = checkpointed(named.select("d1", "d2", "n", F.coalesce("label", "rep").alias("label"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")))
    rows_ = checkpointed(split_join(sketched.select("__id", "__k", "d1", "d2"), named, ["d1", "d2"]).select("__id", "__k", "label", "n_links"))
    dropped(sketched, firsts, named)
    classes = checkpointed(rows_.groupBy("label").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__k")).alias("f"), F.count("*").alias("class_size")))
    return split_join(rows_, classes, ["label"], "class_size").select(F.col("__id").alias(doc_id), "__k", F.col("f.__id").alias("class_id"), "class_size", "n_links", F.expr("__k = f.__k").alias("kept"))
