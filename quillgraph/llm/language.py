"""Language identification by rank-order n-gram profiles.

A profile is the ``top`` most frequent n-grams (1 to 3 characters over lower-case
letters, words padded by one space) in order of frequency, ties by code points.  A
document's distance to a language is the sum, over its profile, of how far each n-gram
is out of place in the language's profile (``top`` where missing); the nearest language
wins, ties by name.  The score is the winner's share of exp(-20 d) over all languages, d
being the mean displacement as a part of ``top``.

Profiles are learned from a bounded sample: about ``sample`` documents a language,
chosen by a hash of the id.  Predictions see whole texts only.

Edge cases: null text or a text without letters is ``und`` with score 0; so is every text
where nothing could be learned.  A text none of whose n-grams occurs in any profile is
equally far from all languages: with ``nearest`` it gets the first by name, else ``und``.
Rows with null id are predicted, never learned from; repeated rows get equal results; an
empty table gives an empty result; extra columns pass through unless they are called as
the results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import small_batches

TOP, SAMPLE = 300, 2000
CHUNK = 1 << 22
_BITS = 21
_LETTER = np.zeros(0, dtype=bool)


def _letters(codes: np.ndarray) -> np.ndarray:
    global _LETTER
    if not _LETTER.size:
        _LETTER = np.array([chr(i).isalpha() for i in range(0x10000)])
    low = codes < 0x10000
    out = _LETTER[np.where(low, codes, 0)]
    if not low.all():
        out[~low] = [chr(c).isalpha() for c in codes[~low]]
    return out


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-gram codes and how often each occurs.

    A very long text is read in segments; each counts the n-grams that end in it, with the
    last two characters of the segment before, so seams change no count.
    """
    found, number = np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = text.lower()
    before = np.array([32], np.int64)  # the last characters that n-grams may begin with
    for at in range(0, len(low), CHUNK):
        c = np.frombuffer(low[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        if at + CHUNK >= len(low):
            c = np.append(c, np.uint32(32))
        c = np.append(before, np.where(_letters(c), c, 32).astype(np.int64))
        c = c[np.append(True, (c[1:] != 32) | (c[:-1] != 32))]
        old = before.size
        one = c[old:]
        two = (c[:-1] << _BITS) | c[1:]
        three = (two[:-1] << _BITS) | c[2:]
        grams = np.sort(np.concatenate([one[one != 32], two[old - 1 :], three[max(0, old - 2) :]]))
        before = c[-2:]
        if grams.size:
            first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
            own, n = grams[first], np.diff(np.append(first, grams.size))
            if found.size:
                both, back = np.unique(np.concatenate([found, own]), return_inverse=True)
                found, number = both, np.bincount(back, np.concatenate([number, n])).astype(np.int64)
            else:
                found, number = own, n
    return found, number


def profile(text: str | None, top: int = TOP) -> np.ndarray:
    """The codes of the most frequent n-grams, most frequent first; empty without letters."""
    if not text:
        return np.zeros(0, np.int64)
    codes, n = _counts(text)
    if not (codes != ((32 << _BITS) | 32)).any() or not _letters(codes[codes < 1 << _BITS]).any():
        return np.zeros(0, np.int64)
    return codes[np.argsort(-n, kind="stable")[:top]]


class Profiles:
    """The learned profiles as one table of ranks."""

    def __init__(self, ranked: dict[str, list[int]], top: int = TOP):
        self.names, self.top = sorted(ranked), top
        self.codes = np.array(sorted({c for p in ranked.values() for c in p}), np.int64)
        self.ranks = np.full((self.codes.size, len(self.names)), -1, np.int64)
        for j, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.codes, np.array(ranked[name], np.int64)), j] = np.arange(len(ranked[name]))

    def predict(self, text: str | None, nearest: bool = False) -> tuple[str, float]:
        own = profile(text, self.top)
        if not own.size or not self.codes.size:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.codes, own), self.codes.size - 1)
        known = self.codes[at] == own
        if not nearest and not known.any():
            return "und", 0.0
        ranks = np.where(known[:, None], self.ranks[at], -1)
        off = np.where(ranks >= 0, np.abs(ranks - np.arange(own.size)[:, None]), self.top).sum(0)
        best = int(np.argmin(off))
        share = np.exp(-20.0 * (off - off[best]) / (own.size * self.top)).sum()
        return self.names[best], round(float(1.0 / share), 6)


def learn(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", top: int = TOP, sample: int = SAMPLE) -> Profiles:
    """Profiles of the non-null ``lang`` values of ``df``; at most top x languages numbers reach the driver."""
    rows = df.select(df[doc_id].cast("string").alias("id"), df[lang].cast("string").alias("lang"), df[text].cast("string").alias("text")).where("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Profiles({}, top)
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, sample / n))).otherwise(share)
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, t in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                codes, n = _counts(t)
                yield pa.record_batch([pa.array([name] * codes.size, pa.string()), pa.array(codes), pa.array(n)], ["lang", "code", "n"])

    small_batches(df.sparkSession)
    counted = chosen.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    kept = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).orderBy("lang", "rank").collect()
    ranked: dict[str, list[int]] = {}
    for r in kept:
        ranked.setdefault(r["lang"], []).append(r["code"])
    return Profiles(ranked, top)


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text, mod 3, is 1; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(df: DataFrame, profiles: Profiles, text: str = "text", pred: str = "lang_pred", score: str = "score", nearest: bool = False) -> DataFrame:
    """``df`` with the prediction and its score as two more columns; all else passes through unread."""
    small_batches(df.sparkSession)
    rest = [c for c in df.columns if c not in (pred, score)]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest), f"`{pred}` string", f"`{score}` double"])
    shared = df.sparkSession.sparkContext.broadcast(profiles)  # top numbers a language

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.predict(t, nearest) for t in batch[text].cast(pa.string()).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*rest, pred, score])

    return df.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(predict, schema)
