"""Periodic runs of a text's words, by string synchronising sets.

A run is a maximal stretch of words with smallest period q that holds at least ``EXPONENT`` periods. At the
scale t = 1, 2, 4, ... a position belongs to the synchronising set if, of the hashes of the t-word substrings
that start at most t words on, the least one starts here or t words on. So membership depends on the 2t words
from a position on, its context: equal contexts agree. Positions where the t words have a period of at most
t/4 take no part. A run of period q, t <= q < 2t, holds a member among its first t positions, and the next
equal context lies exactly q words on; so two members that follow each other with equal contexts, t to 2t - 1
words apart, propose their distance as a period, and extending it word by word gives the run. The highly
periodic stretches that a scale leaves out are the runs that smaller scales have found; these supply the
omitted small periods. Members thin out in proportion to t, so all scales together take n log n time.

A batch's texts are laid end to end, longest first, with separators that occur once; a scale works on the
texts that are long enough for it. Texts longer than ``BATCH_CHARS`` form a batch alone.

Defined results: null, empty and blank texts have no runs and collapse to the empty text; an empty table
gives an empty result; repeated rows give repeated rows; other columns pass through, unless they bear the
names of the two new columns, which replace them. Hashes have 64 bits: a run is verified word by word, so
none is reported wrongly; one is missed only where two contexts of a batch collide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.llm.common import prepare, whole, words

EXPONENT = 4
LEAST_WORDS = 6
BATCH_CHARS = 1_000_000
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False)
_LAST = np.uint64(2**64 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiply and fold twice."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _extent(ids: np.ndarray, s: int, d: int) -> tuple[int, int]:
    """The maximal stretch around [s, s + d] in which words d apart are equal."""
    right, step, n = s + d, 16, len(ids)
    while right < n:
        same = ids[right : right + step] == ids[right - d : min(right + step, n) - d]
        if not same.all():
            right += int(same.argmin())
            break
        right, step = right + len(same), step * 2
    left, step = s, 16
    while left > 0:
        lo = max(0, left - step)
        same = ids[lo:left] == ids[lo + d : left + d]
        if not same.all():
            left -= int(same[::-1].argmin())
            break
        left, step = lo, step * 2
    return left, right


def _members(hashes: np.ndarray, omitted: np.ndarray, t: int) -> np.ndarray:
    """The synchronising set at scale t; ``hashes`` are those of the t-word substrings."""
    h = np.where(omitted, _LAST, hashes)
    least, width = h, 1
    while width < t:  # minima over t positions, by doubling
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(h) - t], h[t:])
    here, there = h[: len(h) - t], h[t:]
    return np.flatnonzero((least != _LAST) & ((here == least) | (there == least)))


def find_runs(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of every stretch of ``EXPONENT`` periods or more.

    ``ids`` numbers the words of texts that begin at ``starts``, longest first; one separator follows each.
    """
    found: list[tuple[int, int, int]] = []
    hashes, t = _mix(ids.astype(np.uint64) + np.uint64(1)), 1
    while True:
        fit = int(np.searchsorted(-lengths, -EXPONENT * t, side="right"))  # texts of 4t words or more
        if fit == 0:
            return found
        n = int(starts[fit - 1] + lengths[fit - 1]) + 1
        ids, h = ids[:n], hashes[: n - t + 1]
        edge = np.zeros(n + 1, np.int64)
        for a, b, q in found:
            if q * EXPONENT <= t <= b - a and b <= n:
                edge[a] += 1
                edge[b - t + 1] -= 1
        at = _members(h, np.cumsum(edge[: len(h)]) > 0, t)
        twice = _mix(h[:-t] * np.uint64(0x2545F4914F6CDD1D) + h[t:])  # of the 2t words from a position on
        context = twice[at]
        order = np.argsort(context, kind="stable")  # equal contexts in order of position
        a, b = at[order][:-1], at[order][1:]
        near = (context[order][:-1] == context[order][1:]) & (b - a >= t) & (b - a < 2 * t)
        proposed = np.stack([(b - a)[near], a[near]], 1)
        period = right = -1
        for d, s in proposed[np.lexsort((proposed[:, 1], proposed[:, 0]))].tolist():
            if d == period and s + d < right:
                continue  # within the run just found
            left, end = _extent(ids, s, d)
            period, right = d, end
            if end - left >= EXPONENT * d:
                found.append((left, end, d))
        hashes, t = twice, 2 * t


def _batches(texts: list) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, x in enumerate(texts):
        if size and size + len(x or "") > BATCH_CHARS:
            yield first, i
            first, size = i, 0
        size += len(x or "")
    if first < len(texts):
        yield first, len(texts)


def text_runs(texts: list[str | None]) -> tuple[list[list[dict]], list[str]]:
    """Per text its runs by start, then period, and the text without the words that repeat a run's first period."""
    split = [(x or "").encode().split() for x in texts]  # bytes split at the six ASCII white-space characters alone
    lengths = np.array([len(w) for w in split], np.int64)
    order = np.argsort(-lengths, kind="stable")
    number: dict[bytes, int] = {}
    parts = []
    for k, i in enumerate(order.tolist()):
        parts.append(np.array([number.setdefault(w, len(number)) for w in split[i]], np.int64))
        parts.append(np.array([-2 - k], np.int64))
    lengths = lengths[order]
    starts = np.cumsum(lengths + 1) - lengths - 1
    runs: list[list[dict]] = [[] for _ in texts]
    cut: dict[int, list[tuple[int, int]]] = {}
    for a, b, q in sorted(find_runs(np.concatenate(parts), starts, lengths), key=lambda r: (r[0], r[2])) if len(texts) else []:
        if b - a < LEAST_WORDS:
            continue
        k = int(np.searchsorted(starts, a, side="right")) - 1
        i, a0 = int(order[k]), int(a - starts[k])
        runs[i].append({"start": a0, "length": b - a, "period": q})
        cut.setdefault(i, []).append((a0 + q, a0 + b - a))
    kept = []
    for i, w in enumerate(split):
        if i in cut:
            edge = np.zeros(len(w) + 1, np.int64)
            for a, b in cut[i]:
                edge[a] += 1
                edge[b] -= 1
            w = [x for x, over in zip(w, np.cumsum(edge).tolist()) if not over]
        kept.append(b" ".join(w).decode())
    return runs, kept


def add_runs(docs: DataFrame, text_col: str = "text", runs_col: str = "runs", kept_col: str = "collapsed") -> DataFrame:
    """Add each whole text's runs (start, length, period; word numbers from 0) and its collapsed words."""
    prepare(docs.sparkSession)
    docs = docs.select(*[c for c in docs.columns if c not in (runs_col, kept_col) or c == text_col])
    at, names = docs.columns.index(text_col), [*docs.columns, runs_col, kept_col]
    runs_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for lo, hi in _batches(texts):
                runs, kept = text_runs(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(runs, runs_type), pa.array(kept, pa.string())], names)

    schema = T.StructType([*docs.schema.fields, T.StructField(runs_col, RUNS), T.StructField(kept_col, T.StringType())])
    return docs.mapInArrow(run, schema)


def with_planted(text: Column, doc_id: Column) -> Column:
    """The text, or for ids whose crc32 ends in 0 its words made periodic from word a on, joined by spaces."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def periodic(w):
        n = F.size(w).cast("bigint")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i >= a, F.element_at(w, (a + (i - a) % p + 1).cast("int"))).otherwise(x)), " ")

    # the one-element array computes the words once, not once a word
    planted = F.element_at(F.transform(F.array(words(whole(text))), lambda w: F.when(F.size(w) > 0, periodic(w)).otherwise(F.lit(""))), 1)
    return F.when(h % 10 == 0, planted).otherwise(whole(text))


def best_run(runs: Column) -> Column:
    """The run of greatest exact length / period; of equal ones the one of smallest start, then smallest period."""
    none = F.struct(*[F.lit(None).cast("bigint").alias(n) for n in ("start", "length", "period")])
    return F.aggregate(runs, none, lambda best, r: F.when(
        best["period"].isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the best run's start, length, period and exponent_milli, runs_sha256, collapsed_sha256."""
    found = add_runs(docs.select("doc_id", with_planted(F.col("text"), F.col("doc_id")).alias("text")))
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    best = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best_run(F.col("runs")).alias("best"),
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return best.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                       F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                       "runs_sha256", "collapsed_sha256")
