"""Language identification as a mixture of languages.

Every language has a model of letters given the two before them, from counts over all labelled words.
A document's words are draws from a mixture of languages; expectation-maximisation estimates the
proportions. Sets of one, two, ... of the most likely languages are compared by penalised likelihood
(Bayesian information criterion), and the largest proportion of the best set is the prediction.
A run of more than ``PIECE`` letters (text without spaces) is several draws: consecutive pieces of it, each
with the two letters before it, so that all its letters are counted and scored, and it may hold several languages.

Counts are hashed to a fixed number of buckets per language, so the model's size is bounded by
``BUCKETS`` x languages whatever the corpus; it is what travels to the executors.

Defined results: null text, and text without a letter, is ``und`` with score 0; rows without a language
or an id are not learned from; without any labelled row everything is ``und``; ties go to the language
that sorts first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import prepare

BUCKETS = 1 << 16
CONTEXTS = 1 << 13
MAX_WORDS = 400_000
BATCH_ROWS = 128
PIECE = 64
UNKNOWN = "und"
_RUN = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _letters(word: str) -> str:
    return word if word.isascii() else "".join(c for c in word if unicodedata.category(c)[0] == "L")


def _pieces(run: str) -> list[str]:
    """A long run's letters in pieces of about equal length. A piece starts with a space, as no run does, and has its context and borders with it."""
    run = _letters(run)
    if len(run) <= PIECE:
        return [run] if run else []
    ends = np.linspace(0, len(run), -(-len(run) // PIECE) + 1).astype(int).tolist()
    whole = f"  {run} "
    return [" " + whole[a : b + 2 + (b == len(run))] for a, b in pairwise(ends)]


def _draws(text: str | None) -> list[str]:
    """Runs of letters, and the pieces of those longer than ``PIECE``."""
    runs = _RUN.findall((text or "").lower())
    if max(map(len, runs), default=0) <= PIECE:
        return runs
    return [x for run in runs for x in ([run] if len(run) <= PIECE else _pieces(run))]


def _known(draws: Iterable[str]) -> dict[str, str]:
    """Draws that have a letter, and the characters whose trigrams they are."""
    return {d: d[1:] if d[0] == " " else f"  {w} " for d in draws if (w := d if d[0] == " " else _letters(d))}


def _grams(windows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the trigrams of all draws' characters, of the trigrams' first two letters, and where each draw starts."""
    c = np.frombuffer("".join(windows).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    n = np.array([len(w) - 2 for w in windows])  # trigrams of each
    at = np.arange(n.sum()) + np.repeat(2 * np.arange(len(n)), n)  # two positions at each draw's end start none
    with np.errstate(over="ignore"):
        two = (c[at] * np.uint64(0x9E3779B97F4A7C15) + c[at + 1]) * np.uint64(0xBF58476D1CE4E5B9)
        tri = ((two ^ (two >> np.uint64(29))) + c[at + 2]) * np.uint64(0x94D049BB133111EB)
    return ((tri >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64), ((two >> np.uint64(40)) % np.uint64(CONTEXTS)).astype(np.int64), np.cumsum(n) - n


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) to partial sums (lang, order, bucket, n) of a whole partition."""
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    docs = Counter()

    def take(lang, words):
        tri, two = sums.setdefault(lang, (np.zeros(BUCKETS, np.int64), np.zeros(CONTEXTS, np.int64)))
        known = [(w, words[d]) for d, w in _known(words).items()]
        for i in range(0, len(known), 20_000):
            part = known[i : i + 20_000]
            g, c, starts = _grams([w for w, _ in part])
            n = np.repeat([n for _, n in part], np.diff(starts, append=len(g)))
            tri += np.bincount(g, n, BUCKETS).astype(np.int64)
            two += np.bincount(c, n, CONTEXTS).astype(np.int64)

    words: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            docs[lang] += 1
            own = words.setdefault(lang, Counter())
            own.update(_draws(text))
            if len(own) > MAX_WORDS // 4:
                take(lang, words.pop(lang))
    for lang, own in words.items():
        take(lang, own)
    for lang, (tri, two) in sums.items():
        for order, a in ((3, tri), (2, two), (0, np.array([docs[lang]]))):
            at = np.flatnonzero(a)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), order, np.int32)), pa.array(at), pa.array(a[at])],
                                             ["lang", "order", "bucket", "n"])


@dataclass
class Model:
    langs: list[str]
    log_p: np.ndarray  # (BUCKETS, languages): log count + smoothing of a trigram
    log_c: np.ndarray  # (CONTEXTS, languages): the same for its context
    log_prior: np.ndarray

    def words(self, windows: list[str]) -> np.ndarray:
        """Log-likelihood of each draw in each language."""
        g, c, starts = _grams(windows)
        return np.add.reduceat(self.log_p[g] - self.log_c[c], starts, axis=0)


def learn(rows: DataFrame, smoothing: float = 0.05, letters: int = 64) -> Model:
    """A model from rows (lang, text). Sums are made in Spark over all rows; only buckets come to the driver."""
    sums = rows.select("lang", "text").mapInArrow(_counts, "lang string, order int, bucket bigint, n bigint")
    sums = sums.groupBy("lang", "order", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums["lang"].unique())
    def dense(order, size):
        out = np.zeros((size, len(langs)))
        for i, lang in enumerate(langs):
            s = sums[(sums["lang"] == lang) & (sums["order"] == order)]
            out[s["bucket"].to_numpy(), i] = s["n"].to_numpy()
        return out
    docs = dense(0, 1)[0] if langs else np.zeros(0)
    return Model(langs, np.log(dense(3, BUCKETS) + smoothing), np.log(dense(2, CONTEXTS) + smoothing * letters), np.log(docs / docs.sum()) if langs else docs)


class Mixture:
    """Languages of documents under a model; remembers the likelihoods of words it has met."""

    def __init__(self, model: Model, penalty: float = 2.0, rounds: int = 15):
        self.model, self.penalty, self.rounds = model, penalty, rounds
        self.at: dict[str, int] = {}
        self.ll = np.zeros((1024, len(model.langs)))
        self.used = 0

    def _learn(self, words: set[str]) -> None:
        """Give the words rows of the table; -1 to those without a letter."""
        own = _known(sorted(words))
        self.at.update(dict.fromkeys(words - own.keys(), -1))
        if own:
            while self.used + len(own) > len(self.ll):
                self.ll = np.concatenate([self.ll, np.zeros_like(self.ll)])
            self.ll[self.used : self.used + len(own)] = self.model.words(list(own.values()))
            self.at.update(zip(own, range(self.used, self.used + len(own))))
            self.used += len(own)

    def languages(self, texts: list[str | None]) -> list[list[tuple[str, float]]]:
        """Per text, the selected languages with their proportions, largest first; none if it has no letter."""
        if self.used > MAX_WORDS:
            self.at.clear()
            self.used = 0
        found = [_draws(t) for t in texts]
        new = {w for words in found for w in words}.difference(self.at)
        if new:
            self._learn(new)
        ids = [np.array([self.at[w] for w in words], dtype=np.int64) for words in found]
        ids = [x[x >= 0] for x in ids]
        lens = [len(x) for x in ids]
        out: list[list[tuple[str, float]]] = [[] for _ in texts]
        some = [i for i, n in enumerate(lens) if n]
        n_langs = len(self.model.langs)
        if not some or not n_langs:
            return out
        lens = np.array([lens[i] for i in some])
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
        ll = self.ll[np.concatenate(ids)]
        best = ll.max(axis=1, keepdims=True)
        ratio = np.exp(ll - best).astype(np.float32)
        base = np.add.reduceat(best[:, 0], starts)
        single = np.add.reduceat(ll, starts, axis=0)
        shares = np.full((len(some), n_langs), 1 / n_langs)
        shares, total = self._em(ratio, starts, lens, shares)
        order = np.argsort(-shares, axis=1, kind="stable")
        first = np.argmax(single + self.model.log_prior, axis=1)
        fits = [(np.eye(n_langs)[first], single[np.arange(len(some)), first])]
        for k in range(2, n_langs + 1):
            if k == n_langs:
                fits.append((shares, total + base))
                break
            inside = np.zeros_like(shares)
            np.put_along_axis(inside, order[:, :k], 1.0 / k, axis=1)
            own, got = self._em(ratio, starts, lens, inside)
            fits.append((own, got + base))
        scores = np.stack([2 * got - self.penalty * k * np.log(lens + 1) for k, (_, got) in enumerate(fits)])
        pick = np.argmax(scores, axis=0)
        for j, i in enumerate(some):
            own = fits[pick[j]][0][j]
            if pick[j] == 0:  # one language: how sure it is against each other one
                s = single[j] + self.model.log_prior
                s = np.exp(s - s.max())
                out[i] = [(self.model.langs[first[j]], float(s[first[j]] / s.sum()))]
            else:
                rank = np.argsort(-own, kind="stable")[: pick[j] + 1]
                out[i] = [(self.model.langs[x], float(own[x])) for x in rank if own[x] > 0]
        return out

    def _em(self, ratio, starts, lens, shares):
        total = None
        for _ in range(self.rounds):
            joint = ratio * np.repeat(shares.astype(np.float32), lens, axis=0)
            each = joint @ np.ones(joint.shape[1], dtype=np.float32)
            now = np.add.reduceat(np.log(np.maximum(each, 1e-30), dtype=np.float64), starts)
            shares = np.add.reduceat((joint / np.maximum(each, np.float32(1e-30))[:, None]).astype(np.float64), starts, axis=0) / lens[:, None]
            if total is not None and np.all(now - total <= 1e-3):
                break
            total = now
        return shares, now


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, languages (an array of lang and share, largest first)."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        mixture = Mixture(sent.value)
        for b in batches:
            for i in range(0, b.num_rows, BATCH_ROWS):
                part = b.slice(i, BATCH_ROWS)
                got = mixture.languages(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([x[0][0] if x else UNKNOWN for x in got], pa.string()),
                    pa.array([min(1.0, max(0.0, x[0][1])) if x else 0.0 for x in got], pa.float64()),
                    pa.array([[{"lang": k, "share": v} for k, v in x] for x in got], pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
                    ["doc_id", "lang_pred", "score", "languages"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, languages array<struct<lang:string,share:double>>")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages; learned from the rows of ``docs`` that aren't held out."""
    prepare(docs.sparkSession)
    train = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text")
    out = predict(docs.select("doc_id", "text"), learn(train))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages")
