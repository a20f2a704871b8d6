"""Toxicity by a subsequence string-kernel SVM with Nystroem landmarks.

Two strings are alike as far as they share subsequences of three characters, each weighted by
``decay`` to the power of the stretch it covers (at most ``MAX_SPAN``): inserted characters and gaps
lower the weight and do not break the match, so "idi.ot" and "i d i o t" stay close to "idiot".
Landmarks are spans of the labelled texts; the kernel against them, made orthonormal, is the feature
map on which a linear SVM (squared hinge, Newton steps) is trained. As the machine is linear in the kernel, its
landmarks fold into one weight per subsequence, and scoring a span costs one table look-up for each.

Texts are bags of spans with their document's label: a toxic bag holds at least one toxic span, a clean
one none. Spans are words of three characters or more (two, unless they are ASCII), runs of single characters
put together, and neighbouring parts of at most ``PART`` characters put together; marks around a character or
part, and ends of sentences, break neither. A word cut into three parts of two characters or more is met only by pairs of
its parts. Spans found in toxic texts more often than chance allows, and hardly in clean ones, are the toxic examples; the
clean spans that the first machine scores highest are added as examples for the second. A document's score is
that of its worst span, calibrated by a logistic fit on documents whose spans trained nothing.

The classifier is fitted on at most ``max_docs`` labelled documents, those of smallest id hash; examples
are bounded by ``max_examples``. Scoring covers every whole text.

Defined results: null and empty texts and texts without a span get the score of the lowest margin;
labels that are null, or that stand at documents that don't exist, are ignored; without labels of both
kinds every score is the toxic share (0 without labels) and nothing is learned; ties between spans go to
the first in the text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import prepare, written

MAX_SPAN = 7
SPAN_CHARS = 20
PART = 4
CODES = 64
MAX_WORDS = 400_000
BATCH_ROWS = 128
NO_SPAN = -9.0
START, END = "\x02", "\x03"  # a span's borders are characters of their own
_STRIP = re.compile(r"^[\W_]+|[\W_]+$")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def spans(text: str | None) -> list[str]:
    """Words without a sentence's end marks, runs of three or more single characters put together, and neighbouring short parts put together.

    Fewer than three single characters go with the parts around them.
    """
    out, run, before = [], [], ""
    for w in [*(text or "").lower().split(), None]:
        bare = w if w is None or w.isalpha() else _STRIP.sub("", w)
        if bare == "":
            continue
        if bare and len(bare) == 1:
            run.append(bare)
            continue
        part = bare if bare and len(bare) <= PART else ""
        if len(run) > 2:
            out.append("".join(run))
        else:
            if before and run:
                out.append(before + "".join(run))
            if part and (before or run):
                out.append(before + "".join(run) + part)
        if w is not None:
            out.append(w.rstrip(".!?;:"))
        run, before = [], part
    return out


def pieces(span: str) -> list[str]:
    """The span without marks around it, in overlapping stretches where it is long."""
    if not span.isalpha():
        span = _STRIP.sub("", span)
    if len(span) < (3 if span.isascii() else 2):
        return []
    span = f"{START}{span}{END}"
    if len(span) <= SPAN_CHARS:
        return [span]
    return [span[i : i + SPAN_CHARS] for i in range(0, len(span) - SPAN_CHARS // 2, SPAN_CHARS // 2)]


def _triples() -> tuple[np.ndarray, np.ndarray]:
    """Positions i < j < k of a string of SPAN_CHARS that cover at most MAX_SPAN characters, by last position."""
    at = [(i, j, k) for k in range(SPAN_CHARS) for j in range(k) for i in range(max(0, k - MAX_SPAN + 1), j)]
    at = np.array(at, dtype=np.int64)
    return at, at[:, 2] - at[:, 0] + 1


_AT, _STRETCH = _triples()
_UPTO = np.searchsorted(_AT[:, 2], np.arange(SPAN_CHARS + 1))  # triples that lie in the first n characters


def _codes(strings: list[str]) -> np.ndarray:
    """Characters as small codes, a row for each string of one length."""
    a = np.array([list(map(ord, s)) for s in strings], dtype=np.int64)
    letter, digit = (a >= 97) & (a <= 122), (a >= 48) & (a <= 57)
    far = np.where(a < 128, a, (a * 0x9E3779B1) >> 15)  # the remainder alone is one for all Hangul syllables of one final
    return np.where(letter, a - 97, np.where(digit, a - 22, 36 + far % (CODES - 36)))


def subsequences(strings: list[str]) -> np.ndarray:
    """Codes of all triples, for strings of one length."""
    c, at = _codes(strings), _AT[: _UPTO[len(strings[0])]]
    return (c[:, at[:, 0]] * CODES + c[:, at[:, 1]]) * CODES + c[:, at[:, 2]]


def feature_rows(strings: list[str], decay: float) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """By length: positions in ``strings``, triples sorted within each row, their weights, and the norm of each row."""
    by: dict[int, list[int]] = {}
    for i, s in enumerate(strings):
        by.setdefault(len(s), []).append(i)
    for n, own in by.items():
        for i in range(0, len(own), 2048):
            part = own[i : i + 2048]
            u = subsequences([strings[j] for j in part])
            w = np.power(decay, _STRETCH[: u.shape[1]])
            order = np.argsort(u, axis=1)
            u = np.take_along_axis(u, order, axis=1)
            w = w[order]
            # equal subsequences of a string add up before they are squared
            new = np.ones(u.shape, dtype=bool)
            new[:, 1:] = u[:, 1:] != u[:, :-1]
            sums = np.add.reduceat(w.ravel(), np.flatnonzero(new.ravel()))
            rows = np.cumsum(new.sum(axis=1))
            norm = np.sqrt(np.add.reduceat(sums * sums, np.concatenate([[0], rows[:-1]])))
            yield part, u, w, norm


@dataclass
class Machine:
    """margin(s) = <table, subsequences of s> / norm(s) + bias; ``slope`` and ``shift`` calibrate the worst margin."""

    table: np.ndarray
    bias: float
    decay: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, strings: list[str]) -> np.ndarray:
        out = np.empty(len(strings))
        for own, u, w, norm in feature_rows(strings, self.decay):
            out[own] = (self.table[u] * w).sum(axis=1) / norm + self.bias
        return out

    def probability(self, margin):
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def train(examples: list[str], toxic: np.ndarray, weight: np.ndarray, landmarks: int = 320, decay: float = 0.6, c: float = 30.0) -> Machine:
    """A machine from example spans. Landmarks are pivots of an incomplete Cholesky factorisation of the kernel:
    again and again the example, heavy and toxic ones first, that those chosen so far describe least."""
    n = len(examples)
    groups = [(own, u, (w / norm[:, None]).astype(np.float32)) for own, u, w, norm in feature_rows(examples, decay)]
    place = {i: (g, r) for g, (own, _, _) in enumerate(groups) for r, i in enumerate(own)}
    first = np.where(toxic, weight, 0.2 * weight)
    rest, marks, pivots = np.ones(n), [], []
    phi = np.zeros((n, min(landmarks, n)))
    for j in range(phi.shape[1]):
        i = int(np.argmax(rest * first))
        if rest[i] < 0.02:
            break
        g, r = place[i]
        z = np.zeros(CODES**3, dtype=np.float32)
        np.add.at(z, groups[g][1][r], groups[g][2][r])
        column = np.empty(n)
        for own, u, w in groups:
            column[own] = (z[u] * w).sum(axis=1)
        phi[:, j] = (column - phi[:, :j] @ phi[i, :j]) / np.sqrt(rest[i])
        rest = np.maximum(rest - phi[:, j] ** 2, 0)
        rest[i] = 0
        marks.append((groups[g][1][r], groups[g][2][r]))
        pivots.append(i)
    phi = phi[:, : len(pivots)]
    w, b = _svm(phi, np.where(toxic, 1.0, -1.0), weight, c)
    alpha = np.linalg.solve(phi[pivots].T, w)  # the landmarks' weights in the kernel itself
    table = np.zeros(CODES**3)
    for (u, v), x in zip(marks, alpha):
        np.add.at(table, u, x * v)
    return Machine(table, float(b), decay)


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM in the primal, by Newton steps on the examples inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    w = np.zeros(x.shape[1])
    inside = None
    for _ in range(rounds):
        now = y * (x @ w) < 1
        if inside is not None and np.array_equal(now, inside):
            break
        inside = now
        v = x[inside] * (c * weight[inside])[:, None]
        w = np.linalg.solve(ridge + v.T @ x[inside], v.T @ y[inside])
    return w[:-1], w[-1]


def calibrated(machine: Machine, margin: np.ndarray, toxic: np.ndarray, rounds: int = 60) -> Machine:
    """Logistic fit of the worst margins, with Platt's smoothed targets."""
    pos, neg = int(toxic.sum()), int((~toxic).sum())
    if pos == 0 or neg == 0:
        return machine
    target = np.where(toxic, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * w * [0, 0])
        w = w - np.clip(step, -2, 2)
    return Machine(machine.table, machine.bias, machine.decay, float(max(w[0], 1e-3)), float(w[1]))


def _span_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, toxic) to partial (span, t, c): toxic and clean documents that hold the span."""
    def rows():
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v[0] for v in sums.values()], pa.int64()),
                                           pa.array([v[1] for v in sums.values()], pa.int64())], ["span", "t", "c"])
    sums: dict[str, list[int]] = {}
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for p in {p for w in set(spans(text)) for p in pieces(w)}:
                sums.setdefault(p, [0, 0])[0 if toxic else 1] += 1
        if len(sums) > MAX_WORDS:
            yield rows()
            sums = {}
    yield rows()


class Worst:
    """The highest margin of a text's spans; remembers spans it has met."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.known: dict[str, float] = {}

    def of(self, texts: list[str | None]) -> list[tuple[float, str | None]]:
        if len(self.known) > MAX_WORDS:
            self.known.clear()
        each = [spans(t) for t in texts]
        new = {w for ws in each for w in ws if w not in self.known}
        parts = {w: pieces(w) for w in new}
        strings = sorted({p for ps in parts.values() for p in ps})
        margin = dict(zip(strings, self.machine.margins(strings).tolist())) if strings else {}
        for w, ps in parts.items():
            self.known[w] = max((margin[p] for p in ps), default=NO_SPAN)
        out = []
        for ws in each:
            top = max(ws, key=self.known.__getitem__, default=None)
            out.append((self.known[top], top) if top is not None and self.known[top] > NO_SPAN else (NO_SPAN, None))
        return out


def _worst(df: DataFrame, machine: Machine) -> DataFrame:
    """(key, text, ...) rows with the text replaced by margin and worst span."""
    sent = df.sparkSession.sparkContext.broadcast(machine)
    rest = [f for f in df.schema.fields if f.name != "text"]
    at = df.columns.index("text")
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rest), "margin double", "worst string"])

    def run(batches):
        made = Worst(sent.value)
        for b in batches:
            for i in range(0, b.num_rows, BATCH_ROWS):
                part = b.slice(i, BATCH_ROWS)
                got = made.of(part.column(at).to_pylist())
                own = [part.column(j) for j in range(part.num_columns) if j != at]
                yield pa.RecordBatch.from_arrays([*own, pa.array([m for m, _ in got], pa.float64()), pa.array([w for _, w in got], pa.string())],
                                                 [*(f.name for f in rest), "margin", "worst"])

    return df.mapInArrow(run, schema)


def learn(docs: DataFrame, labels: DataFrame, max_docs: int = 20_000, max_examples: int = 16_000) -> tuple[Machine | None, float]:
    """A calibrated machine and the toxic share, from labels (doc_id, toxic) of documents."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col("toxic") > 0).alias("toxic"))
    some = F.broadcast(own.orderBy(F.xxhash64(F.lit("toxicity"), "doc_id")).limit(max_docs))
    rows = written(docs.join(some, "doc_id").select("text", "toxic", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("hold")), "toxicity-labelled")
    size = rows.agg(F.sum((~F.col("hold") & F.col("toxic")).cast("int")), F.sum((~F.col("hold") & ~F.col("toxic")).cast("int")),
                    F.avg(F.col("toxic").cast("double"))).first()
    n_bad, n_good, share = size[0] or 0, size[1] or 0, size[2] or 0.0
    if not n_bad or not n_good:
        return None, float(share)
    counts = rows.where(~F.col("hold")).select("text", "toxic").mapInArrow(_span_counts, "span string, t bigint, c bigint")
    counts = written(counts.groupBy("span").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "toxicity-spans")
    odd = F.col("t") / n_bad >= 8 * (F.col("c") + 0.5) / n_good
    # so often in toxic documents that chance would hardly do it to one of all their spans
    seen = counts.where("t > 0").count()
    often = max(2, math.ceil(math.log(max(seen, 2)) / -math.log(n_bad / (n_bad + n_good))))
    bad = counts.where(odd).orderBy(F.desc("t"), "span").limit(max_examples // 4).collect()
    while often > 1 and sum(r["t"] >= often for r in bad) < 8:  # little to go by
        often -= 1
    bad = [r for r in bad if r["t"] >= often]
    clean = counts.where((F.col("c") > 0) & ~odd)
    good = clean.orderBy(F.desc("c"), "span").limit(max_examples // 8).collect()
    good += clean.orderBy(F.xxhash64("span")).limit(max_examples // 4).collect()
    if not bad or not good:
        return None, float(share)
    machine = _fit(bad, good)
    hard = _worst(clean.select(F.translate("span", START + END, "").alias("text"), "t", "c", F.col("span").alias("own")), machine)
    hard = hard.orderBy(F.desc("margin"), "own").limit(max_examples // 4).select(F.col("own").alias("span"), "t", "c").collect()
    machine = _fit(bad, [*good, *hard])
    check = _worst(rows.where("hold").select("text", "toxic"), machine).select("toxic", "margin").collect()
    return calibrated(machine, np.array([r["margin"] for r in check]), np.array([r["toxic"] for r in check], dtype=bool)), float(share)


def _fit(bad, good) -> Machine:
    clean = {r["span"]: r["c"] for r in good}
    names = [r["span"] for r in bad] + sorted(clean)
    toxic = np.arange(len(names)) < len(bad)
    weight = np.sqrt(np.array([r["t"] for r in bad] + [clean[s] for s in sorted(clean)], dtype=float))
    weight[toxic] /= weight[toxic].mean()
    weight[~toxic] /= weight[~toxic].mean()
    return train(names, toxic, weight)


def score(docs: DataFrame, machine: Machine | None, share: float) -> DataFrame:
    """doc_id, score, margin, worst (the span that decides) of (doc_id, text) rows."""
    if machine is None:
        return docs.select("doc_id", F.lit(share).alias("score"), F.lit(NO_SPAN).alias("margin"), F.lit(None).cast("string").alias("worst"))
    x = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col("margin") * machine.slope + machine.shift))
    return _worst(docs.select("doc_id", "text"), machine).select("doc_id", (1 / (1 + F.exp(-x))).alias("score"), "margin", "worst")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, worst; learned from the labelled rows that aren't held out."""
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    machine, share = learn(docs, labels.where(~held_out(F.col("doc_id"))))
    out = score(docs, machine, share)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "worst")
