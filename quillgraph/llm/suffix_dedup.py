"""Removal of long repeated byte strings by longest-previous-factor arrays.

A window is ``length`` consecutive bytes of one document.  A suffix array over all texts
would not be distributed, so texts are first cut to the places that can repeat at all:
each window elects an anchor, its ``anchor`` bytes of smallest hash (leftmost on ties).
Equal windows elect equal anchors at equal distance, so a window can only repeat where
its anchor does.  Consecutive windows with the same anchor form a context; contexts with
equal bytes (by 128 bits: the anchor's hash and half a BLAKE2 digest of the context)
repeat as a whole and need no more work.
Only anchors with several different contexts go on: their contexts (one copy each) are
gathered by anchor and put in suffix order to depth ``length`` by prefix doubling.  The
longest previous factor of a position is the longer of its common prefixes with the
suffixes at the previous and the next smaller position in that order, the longest next
factor that with the larger ones; a window repeats where a factor reaches ``length``.

An anchor with more than ``hot`` different contexts is never gathered: its windows'
128-bit digests are counted by a pre-aggregated shuffle instead, with the same result.

``keep_first=False`` removes every copy of a repeated window, the first included;
``keep_first=True`` spares the first by (doc_id, row key, position).

By the same election over words (white-space-separated, by 64-bit
hashes) it finds passages of ``PASSAGE`` words or more that another document holds too,
however few bytes they have.

Edge cases: null is the empty text; texts below ``length`` bytes stay whole, as do those
below ``PASSAGE`` words; repeated rows repeat each other; an empty table gives an empty
result; very long texts are read in segments; extra columns are not read, whatever their
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import checkpointed, dropped, row_key, small_batches, split_join, whole_text
from quillgraph.llm.order_minhash import _P, _mix, _powers

LENGTH, ANCHOR, HOT = 400, 128, 1_000
PASSAGE, WORD_ANCHOR = 51, 12
#: Rows, and bytes of all their lists, of a side that may be broadcast; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 8 << 20
SEGMENT = 1 << 19
#: Bytes of contexts that one suffix array holds; a single anchor has at most ``hot`` contexts.
CHUNK = 1 << 19
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _sums(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p, inv = _powers(symbols.size + 1)
    return np.append(np.uint64(0), np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * p[: symbols.size], dtype=np.uint64)), inv


def contexts(symbols: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of windows with the same anchor: first start, number of windows, hash of the anchor, hash of the context."""
    parts = []
    last = symbols.size - length  # the last window's start
    for at in range(0, last + 1, SEGMENT):
        own = min(SEGMENT, last + 1 - at)  # windows that start in this segment
        piece = symbols[at : at + own + length - 1]
        sums, inv = _sums(piece)
        n = piece.size - anchor + 1
        h = _mix((sums[anchor:] - sums[:n]) * inv[:n])
        width = length - anchor + 1
        packed = (h & ~np.uint64((1 << 20) - 1)) | np.arange(n, dtype=np.uint64)
        blocks = -(-n // width)
        grid = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
        grid[:n] = packed
        grid = grid.reshape(blocks, width)
        ahead = np.minimum.accumulate(grid, 1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
        chosen = (np.minimum(behind[:own], ahead[width - 1 : width - 1 + own]) & np.uint64((1 << 20) - 1)).astype(np.int64)
        start = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
        count = np.diff(np.append(start, own))
        end = start + count - 1 + length
        a = chosen[start]
        whole = _mix((sums[end] - sums[start]) * inv[start]) ^ _mix(((a - start) * 4096 + count).astype(np.uint64))
        parts.append((start + at, count, h[a].view(np.int64), _mix(whole).view(np.int64)))
    if not parts:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def word_symbols(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each white-space-separated word, in order."""
    inside = np.append(~_SPACE[raw], False)
    edge = np.flatnonzero(np.diff(np.append(False, inside).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    out = np.empty(start.size, np.uint64)
    long = np.flatnonzero(end - start > 4096)
    at = 0
    while at < start.size:
        to = max(at + 1, int(np.searchsorted(start, start[at] + SEGMENT)))
        lo, hi = int(start[at]), int(min(end[to - 1], start[to - 1] + 4096))
        sums, inv = _sums(raw[lo:hi])
        s = start[at:to] - lo
        out[at:to] = (sums[np.minimum(end[at:to] - lo, hi - lo)] - sums[s]) * inv[s]
        at = to
    for i in long.tolist():
        out[i] = np.frombuffer(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    return _mix(out)


def _ranked(key: np.ndarray, most: int) -> np.ndarray:
    """The rank of each of the ``key``, equal keys sharing one; no key is above ``most``."""
    bits = key.size.bit_length()
    if int(most).bit_length() + bits > 63:
        return np.unique(key, return_inverse=True)[1].astype(np.int32)
    both = np.sort((key << bits) | np.arange(key.size))  # key and place in one word: values sort several times as fast as places
    place = both & ((1 << bits) - 1)
    both >>= bits
    rank = np.empty(key.size, np.int32)
    rank[place] = np.cumsum(np.append(False, both[1:] != both[:-1])[: key.size], dtype=np.int32)
    return rank


def rank_levels(raw: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(depth, rank of each position in suffix order cut at that depth) for depths 4, 8, ... and ``length``.

    Prefix doubling over sorted pairs of ranks; positions with fewer bytes left are padded.
    """
    padded = np.append(raw, np.zeros(length, np.uint8)).astype(np.int64)
    n, step = raw.size, 4
    key = np.zeros(n + length - step, np.int64)
    for i in range(step):
        key = (key << 8) | padded[i : i + key.size]
    out = [(step, _ranked(key, (1 << 32) - 1))]
    while step < length:
        jump, rank = min(step, length - step), out[-1][1]
        width = int(rank.max(initial=0)).bit_length()
        key = (rank[: rank.size - jump].astype(np.int64) << width) | rank[jump:]
        step += jump
        out.append((step, _ranked(key, (1 << 2 * width) - 1)))
    return out


def nearest_smaller(values: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest earlier place of a smaller value, -1 without one, and the least of the ``gaps`` after that place up to this one; by pointer jumping."""
    at, least = np.arange(values.size) - 1, gaps.copy()
    todo = np.flatnonzero(at >= 0)
    while todo.size:
        todo = todo[values[at[todo]] > values[todo]]
        least[todo] = np.minimum(least[todo], least[at[todo]])
        at[todo] = at[at[todo]]
        todo = todo[at[todo] >= 0]
    return at, least


def factors(raw: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The longest previous and the longest next factor among ``starts``, both cut at ``length``."""
    levels = rank_levels(raw, length)
    order = np.lexsort((starts, levels[-1][1][starts]))
    sa = starts[order].astype(np.int64)
    padded = np.append(raw, np.zeros(length, np.uint8))
    halves = [(d, r) for d, r in levels if d & (d - 1) == 0][::-1]

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at ``a`` and ``b``."""
        size = np.zeros(a.size, np.int64)
        for depth, rank in halves:
            inside = np.maximum(a, b) + size < rank.size
            x, y = np.where(inside, a + size, 0), np.where(inside, b + size, 0)
            size += depth * (inside & (rank[x] == rank[y]))
        open_ = np.ones(a.size, bool)
        for _ in range(3):
            open_ &= (np.maximum(a, b) + size < padded.size) & (size < length)
            open_ &= padded[np.where(open_, a + size, 0)] == padded[np.where(open_, b + size, 0)]
            size += open_
        return np.minimum(size, length)

    # The common prefix of two suffixes is the least of those of the neighbours between them.
    shared = np.append(0, common(sa[:-1], sa[1:]))[: sa.size]

    def longest(values: np.ndarray) -> np.ndarray:
        before, left = nearest_smaller(values, shared)
        after, right = nearest_smaller(values[::-1], np.append(0, shared[:0:-1])[: sa.size])
        out = np.empty(sa.size, np.int64)
        out[order] = np.maximum(np.where(before >= 0, left, 0), np.where(after >= 0, right, 0)[::-1])
        return out

    return longest(sa), longest(-sa)


def _anchored(docs: DataFrame, length: int, anchor: int, words: int) -> DataFrame:
    """Byte contexts (place, ah, ch) and word contexts (wplace, wah, wch) of each text; place = start * 2^20 + windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for text in batch["__t"].to_pylist():
                data = text.encode("utf-8", "surrogatepass")
                raw, view = np.frombuffer(data, np.uint8), memoryview(data)
                start, count, ah, _ = contexts(raw, length, anchor)
                digests = b"".join([hashlib.blake2b(view[s:e], digest_size=8).digest() for s, e in zip(start.tolist(), (start + count - 1 + length).tolist(), strict=True)])
                ws, wn, wah, wch = contexts(word_symbols(raw), words, min(WORD_ANCHOR, words))
                for col, x in zip(cols, ((start << 20) | count, ah, np.frombuffer(digests, np.int64), (ws << 20) | wn, wah, wch), strict=True):
                    col.append(x)
            yield pa.record_batch([batch["__id"], batch["__k"], *(pa.array(x, pa.list_(pa.int64())) for x in cols)], ["__id", "__k", "place", "ah", "ch", "wplace", "wah", "wch"])

    kind = docs.schema["__id"].dataType.simpleString()
    schema = ", ".join(f"{c} array<long>" for c in ("place", "ah", "ch", "wplace", "wah", "wch"))
    return docs.where(F.octet_length("__t") >= min(length, 2 * words - 1)).select("__id", "__k", "__t").mapInArrow(run, f"__id {kind}, __k long, {schema}")


def _gathered(rows: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """rows: ah, ch, ord, ctx, together by ah and sorted by (ah, ord).  Returns ah, ch and the repeating runs of windows."""

    def settle(group: list[tuple]) -> pa.RecordBatch:
        ahs, chs, texts = zip(*group, strict=True)
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"".join(texts), np.uint8)
        owner = np.repeat(np.arange(sizes.size), sizes)
        starts = np.flatnonzero(np.arange(raw.size) + length <= ends[owner])
        before, after = factors(raw, starts, length)
        found = starts[before >= length if keep_first else np.maximum(before, after) >= length]
        spans: list[list[dict]] = [[] for _ in texts]
        first = np.flatnonzero(np.append(True, (np.diff(found) != 1) | (np.diff(owner[found]) != 0))) if found.size else np.zeros(0, int)
        for s, n in zip(found[first], np.diff(np.append(first, found.size)), strict=True):
            o = owner[s]
            spans[o].append({"j": int(s - (ends[o] - sizes[o])), "n": int(n)})
        return pa.record_batch([pa.array(ahs, pa.int64()), pa.array(chs, pa.int64()), pa.array(spans, pa.list_(pa.struct([("j", pa.int32()), ("n", pa.int32())])))], ["ah", "ch", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        held = 0
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("ah", "ch", "ctx")), strict=True):
                if group and row[:2] == group[-1][:2]:
                    continue  # a repeated row
                if held >= CHUNK and row[0] != group[-1][0]:
                    yield settle(group)
                    group, held = [], 0
                group.append(row)
                held += len(row[2])
        if group:
            yield settle(group)

    return rows.select("ah", "ch", "ctx").mapInArrow(run, "ah long, ch long, runs array<struct<j: int, n: int>>")


def _counted(rows: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """As ``_gathered``, by counting the windows' digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, ctx in enumerate(batch["ctx"].to_pylist()):
                n = len(ctx) - length + 1
                d = np.frombuffer(b"".join(hashlib.blake2b(ctx[j : j + length], digest_size=16).digest() for j in range(n)), np.int64).reshape(-1, 2)
                one = batch.slice(i, 1).select(["ah", "ch", "ord"])
                yield pa.record_batch([*(pa.concat_arrays([c] * n) for c in one.columns), pa.array(np.arange(n, dtype=np.int32)), pa.array(d[:, 0]), pa.array(d[:, 1])], ["ah", "ch", "ord", "j", "h1", "h2"])

    kind = rows.schema["ord"].dataType.simpleString()
    windows = checkpointed(rows.select("ah", "ch", "ord", "ctx").mapInArrow(run, f"ah long, ch long, ord {kind}, j int, h1 long, h2 long"))
    many = windows.groupBy("h1", "h2").agg(F.min("ord").alias("first"), F.count("*").alias("n")).where("n > 1")
    hit = split_join(windows, checkpointed(many), ["h1", "h2"]).where(F.col("ord") != F.col("first") if keep_first else F.lit(True))
    return hit.groupBy("ah", "ch").agg(F.collect_list(F.struct("j", F.lit(1).alias("n"))).alias("runs"))


def _byte_contexts(places: DataFrame, keep_first: bool) -> tuple[DataFrame, DataFrame]:
    """(ah, ch, at) of every context whose anchor occurs again, and one row a distinct context: n, the first of them (ord), whether its anchor has others (mixed)."""
    first = ["__id", "__k"] if keep_first else ["__k"]
    rows = places.select(*first, F.explode_outer(F.arrays_zip("place", "ah", "ch")).alias("x")).select(*first, "x.*").where("place IS NOT NULL")
    by_anchor = checkpointed(rows.groupBy("ah").agg(F.count("*").alias("n"), F.min("ch").alias("lo"), F.max("ch").alias("hi")).where("n > 1").selectExpr("ah", "n", "lo <> hi AS mixed"))
    rows = checkpointed(split_join(rows, by_anchor, ["ah"]).select("ah", "ch", "mixed", F.struct(*first, "place").alias("at")))
    by_context = checkpointed(rows.groupBy("ah", "ch").agg(F.count("*").alias("n"), F.min("at").alias("ord"), F.first("mixed").alias("mixed")))
    dropped(by_anchor)
    return rows, by_context


def _word_contexts(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same over words: (ch, __k, place) of the contexts whose anchor another row holds, and one row a distinct context: n, its least and greatest row (lo, hi), a place of it (at)."""
    rows = places.select("__k", F.explode_outer(F.arrays_zip("wplace", "wah", "wch")).alias("x")).select("__k", F.col("x.wplace").alias("place"), F.col("x.wah").alias("ah"), F.col("x.wch").alias("ch")).where("place IS NOT NULL")
    by_anchor = checkpointed(rows.groupBy("ah").agg(F.count("*").alias("n"), F.min("__k").alias("lo"), F.max("__k").alias("hi"), F.min("ch").alias("c"), F.max("ch").alias("d")).where("lo <> hi").selectExpr("ah", "n", "c <> d AS mixed"))
    rows = checkpointed(split_join(rows, by_anchor, ["ah"]).select("ch", "mixed", "__k", "place"))
    by_context = checkpointed(rows.groupBy("ch").agg(F.count("*").alias("n"), F.min("__k").alias("lo"), F.max("__k").alias("hi"), F.min(F.struct("__k", "place")).alias("at"), F.first("mixed").alias("mixed")))
    dropped(by_anchor)
    return rows, by_context


def _pieces(docs: DataFrame, cuts: DataFrame, length: int, words: int) -> DataFrame:
    """``cuts``: __k, ``bytes`` (place, ah, ch, hot) and ``words`` (place, ch, lo, hi).  The cut-out bytes (ctx) and the hashes (h) of the word windows, in one pass over the texts concerned."""
    out = pa.schema([("ah", pa.int64()), ("ch", pa.int64()), ("hot", pa.bool_()), ("ctx", pa.binary()), ("h", pa.int64()), ("j", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, own, listed in zip(batch["__t"].to_pylist(), batch["bytes"].to_pylist(), batch["words"].to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                if own:
                    ctx = [data[c["place"] >> 20 : (c["place"] >> 20) + (c["place"] & 1048575) - 1 + length] for c in own]
                    cols = {"ah": [c["ah"] for c in own], "ch": [c["ch"] for c in own], "hot": [c["hot"] for c in own], "ctx": ctx}
                    yield pa.record_batch([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(len(own), f.type) for f in out], schema=out)
                if listed:
                    symbols = word_symbols(np.frombuffer(data, np.uint8))
                    sums, inv = _sums(symbols)
                    place = np.array([c["place"] for c in listed], np.int64)
                    start, count = place >> 20, place & 1048575
                    which = np.repeat(np.arange(count.size), count)
                    j = np.arange(which.size) - np.repeat(np.cumsum(count) - count, count)
                    s = start[which] + j
                    cols = {x: np.array([c[x] for c in listed], np.int64)[which] for x in ("ch", "lo", "hi")} | {"h": _mix((sums[s + words] - sums[s]) * inv[s]).view(np.int64), "j": j.astype(np.int32)}
                    yield pa.record_batch([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(which.size, f.type) for f in out], schema=out)

    size = cuts.agg(F.count("*").alias("n"), F.expr("sum(48 + 96 * coalesce(size(bytes), 0) + 64 * coalesce(size(words), 0))").alias("bytes")).first()
    small = size["n"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES
    texts = docs.select("__k", "__t").join(F.broadcast(cuts) if small else cuts, "__k").dropDuplicates(["__k"])
    return checkpointed(texts.select("__t", "bytes", "words").mapInArrow(run, "ah long, ch long, hot boolean, ctx binary, h long, j int, lo long, hi long"))


def repeated_spans(docs: DataFrame, places: DataFrame, length: int = LENGTH, keep_first: bool = False, hot: int = HOT, words: int = PASSAGE) -> DataFrame:
    """``docs``: __k, __t; ``places`` as of ``_anchored``.

    Returns __k, ``spans`` (the byte ranges (s, e) to remove) and ``shared`` (the word
    ranges of passages of ``words`` words or more that another row holds too); one of
    them is null in a row, and ranges may overlap.
    """
    rows, by_context = _byte_contexts(places, keep_first)
    wrows, wcontext = _word_contexts(places)
    crowds = checkpointed(by_context.where("mixed").groupBy("ah").agg(F.count("*").alias("m")).where(F.col("m") > hot).select("ah", F.lit(True).alias("hot")))  # at most contexts / hot rows
    crowded = crowds.limit(BROADCAST_ROWS + 1).count()
    mixed = by_context.where("mixed").join(F.broadcast(crowds) if crowded <= BROADCAST_ROWS else crowds, "ah", "left")
    cuts = mixed.select(F.col("ord.__k").alias("__k"), F.struct(F.col("ord.place").alias("place"), "ah", "ch", F.coalesce("hot", F.lit(False)).alias("hot")).alias("bytes"), F.lit(None).cast("struct<place: bigint, ch: bigint, lo: bigint, hi: bigint>").alias("words"))
    # One copy of each word context of a mixed anchor, with the range of rows that hold it.
    more = wcontext.where("mixed").select(F.col("at.__k").alias("__k"), F.lit(None).cast(cuts.schema["bytes"].dataType).alias("bytes"), F.struct("at.place", "ch", "lo", "hi").alias("words"))
    cuts = checkpointed(cuts.unionByName(more).groupBy("__k").agg(F.collect_list("bytes").alias("bytes"), F.collect_list("words").alias("words")))
    pieces = _pieces(docs, cuts, length, words)
    dropped(cuts)
    # Bytes: suffix order within an anchor, counts for the anchors with very many contexts.
    found = pieces.where("ctx IS NOT NULL").select("ah", "ch", "hot", "ctx")
    if keep_first:  # the order of first places decides which one is spared
        found = found.join(by_context.select("ah", "ch", "ord"), ["ah", "ch"])
    else:
        found = found.withColumn("ord", F.col("ch"))
    runs = _gathered(found.where("NOT hot").repartition("ah").sortWithinPartitions("ah", "ord", "ch"), length, keep_first)
    if crowded:
        runs = runs.union(_counted(found.where("hot").dropDuplicates(["ah", "ch"]), length, keep_first))
    runs = checkpointed(runs.where("size(runs) > 0").groupBy("ah", "ch").agg(F.flatten(F.collect_set("runs")).alias("runs")))
    # Words: counts of window hashes over the distinct contexts.
    windows = pieces.where("h IS NOT NULL").select("h", "j", "ch", "lo", "hi")
    many = checkpointed(windows.groupBy("h").agg(F.count("*").alias("n"), F.min("lo").alias("a"), F.max("hi").alias("b")).where("a <> b").select("h", "n"))
    wruns = checkpointed(split_join(windows.where("lo = hi").select("h", "j", "ch"), many, ["h"]).groupBy("ch").agg(F.collect_set("j").alias("runs")))
    dropped(pieces, many)
    info = checkpointed(by_context.select("ah", "ch", "n", "ord").join(runs, ["ah", "ch"], "left").where("n > 1 OR runs IS NOT NULL"))
    hit = split_join(rows.select("ah", "ch", "at"), info, ["ah", "ch"])
    hit = hit.select(F.col("at.__k").alias("__k"), F.shiftright("at.place", 20).alias("s"), F.expr("at.place & 1048575").alias("w"), "runs", F.expr("at <> ord" if keep_first else "n > 1").alias("whole")).where("whole OR runs IS NOT NULL")
    span = f"CASE WHEN whole THEN array(struct(s AS s, s + w - 1 + {length} AS e)) ELSE transform(runs, r -> struct(s + r.j AS s, s + r.j + r.n - 1 + {length} AS e)) END"
    none = "cast(NULL AS array<struct<s: bigint, e: bigint>>)"
    spans = hit.selectExpr("__k", f"{span} AS spans", f"{none} AS shared")
    winfo = wcontext.join(wruns, "ch", "left").where("lo <> hi OR runs IS NOT NULL").select("ch", "n", (F.col("lo") != F.col("hi")).alias("whole"), "runs")
    whit = split_join(wrows.select("ch", "__k", "place"), checkpointed(winfo), ["ch"]).select("__k", F.shiftright("place", 20).alias("s"), F.expr("place & 1048575").alias("w"), "whole", "runs")
    wspan = f"CASE WHEN whole THEN array(struct(s AS s, s + w - 1 + {words} AS e)) ELSE transform(runs, j -> struct(s + j AS s, s + j + {words} AS e)) END"
    return spans.unionByName(whit.selectExpr("__k", f"{none} AS spans", f"{wspan} AS shared"))


def _covered(spans) -> Iterator[tuple[int, int]]:
    """The disjoint runs that sorted, perhaps overlapping spans cover."""
    at, upto = None, 0
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        if at is not None and s <= upto:
            upto = max(upto, e)
            continue
        if at is not None:
            yield at, upto
        at, upto = s, e
    if at is not None:
        yield at, upto


def dedup_repeats(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, keep_first: bool = True, hot: int = HOT, with_kept: bool = True, words: int = PASSAGE
) -> DataFrame:
    """Per input row: id, n_bytes, n_removed, n_spans, kept_sha256, n_shared_words (words in passages of ``words`` or more that another document holds) and, if asked for, the ``kept`` bytes."""
    small_batches(df.sparkSession)
    docs = df.select(df[doc_id].alias("__id"), whole_text(df, text).alias("__t"))
    docs = docs.withColumn("__k", row_key(F.col("__id"), F.col("__t")))
    places = checkpointed(_anchored(docs, length, anchor, words))
    spans = repeated_spans(docs, places, length, keep_first, hot, words)
    spans = spans.groupBy("__k").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.flatten(F.collect_set("shared")).alias("shared"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, s, w in zip(batch["__t"].to_pylist(), batch["spans"], batch["shared"], strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                gone = list(_covered(s.as_py() or []))
                edges = [0, *(x for run in gone for x in run), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), sum(e - b for b, e in _covered(w.as_py() or [])), kept if with_kept else None))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            arrays = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()), strict=True)]
            yield pa.record_batch([batch["__id"], *arrays], [doc_id, "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_words", "kept"])

    kind = docs.schema["__id"].dataType.simpleString()
    out = docs.join(spans, "__k", "left").select("__id", "__t", "spans", "shared").mapInArrow(run, f"`{doc_id}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_words long, kept binary")
    return out if with_kept else out.drop("kept")
