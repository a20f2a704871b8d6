"""Quality rules: decision lists learned by sequential covering. DataFrame functions only.

Statistics of every whole text are Spark expressions. On the labelled rows, rules that recognise
low-quality text are grown one after the other: a rule starts empty and takes, again and again, the
threshold condition with the best FOIL gain, counted by one grouped aggregate over all labelled rows;
on held-back rows it is then pruned to the prefix with the best (bad - good) / (bad + good). Rows that
a rule covers leave the set and the next rule is grown, until no rule is precise enough. The list
becomes an ordered ``CASE WHEN``; what no rule covers is kept.

Defined results: null text has no words; a document without words fails the base rules; labels that are
null, or that stand at documents that don't exist, are ignored; a repeated label counts as often as it
stands; without labels of both kinds the list is empty and the base rules alone decide; an empty table
gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import ASCII_SPACE, UPPER, prepare, whole, words, written

SYMBOLS = "#*$%&|<>"
MARKS = "!?"
#: Statistics that the rules may test, as numerator and denominator: a rule does not depend on length alone.
RATIOS = {
    "mean_word": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "repeat_ratio": ("n_repeat_words", "n_words"), "upper_ratio": ("n_upper", "word_chars"), "mark_ratio": ("n_marks", "n_words"),
    "digit_ratio": ("n_digits", "word_chars"), "line_words": ("n_words", "n_lines"),
}


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add ``value``; the generator keeps Spark from computing it again wherever it is used."""
    return df.withColumn(name, F.explode(F.array(value)))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once and never becomes a column of its own."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_statistics(docs: DataFrame, text_col: str = "text", to: str = "__stats") -> DataFrame:
    """Add a struct ``to`` of the statistics of the whole text."""
    t = whole(F.col(text_col))
    count = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    none = F.array().cast("array<struct<h:bigint,i:int>>")

    def repeated(order: Column) -> Column:
        """Words in repeated windows: of windows sorted by hash, these stand next to one another."""
        m = F.size(order)
        pairs = F.zip_with(F.slice(order, F.lit(1), m - 1), F.slice(order, F.lit(2), m - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        at = F.flatten(F.filter(pairs, lambda x: x.isNotNull()))
        return F.when(m < 2, 0).otherwise(F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2))))))

    def of_windows(windows: Column) -> Column:
        order = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(F.when(F.size(F.array_distinct(windows)) < F.size(windows), order).otherwise(none), repeated)

    def of_words(w: Column) -> Column:
        n = F.size(w)
        window = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.struct(n.alias("n"), let(F.when(n >= 3, window).otherwise(F.array().cast("array<bigint>")), of_windows).alias("r"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))

    lines = let(F.filter(F.split(t, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(ASCII_SPACE))) > 0), of_lines)
    plain = {"word_chars": F.length(F.translate(t, ASCII_SPACE, "")), "n_symbols": count(SYMBOLS), "n_upper": count(UPPER), "n_marks": count(MARKS),
             "n_digits": count("0123456789")}

    def all_of(x: Column) -> Column:
        stats = {"n_words": x["w"]["n"], "word_chars": plain["word_chars"], "n_symbols": plain["n_symbols"], "n_dup_lines": x["l"]["n"] - x["l"]["d"],
                 "n_repeat_words": x["w"]["r"], "n_lines": x["l"]["n"], **{k: plain[k] for k in ("n_upper", "n_marks", "n_digits")}}
        return F.struct(*[v.cast("bigint").alias(k) for k, v in stats.items()])

    return once(docs, to, let(F.struct(let(words(t), of_words).alias("w"), lines.alias("l")), all_of))


def base_failed(s: str = "__stats", min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col(f"{s}.n_words") < min_words) | (100 * F.col(f"{s}.n_repeat_words") > max_repeat_percent * F.col(f"{s}.n_words"))


def ratio(name: str, s: str = "__stats") -> Column:
    over, under = RATIOS[name]
    return F.when(F.col(f"{s}.{under}") > 0, F.col(f"{s}.{over}") / F.col(f"{s}.{under}")).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float
    bin: int

    def on_bins(self) -> Column:
        return F.col(self.feature) > self.bin if self.above else F.col(self.feature) <= self.bin

    def on_statistics(self, s: str) -> Column:
        value = ratio(self.feature, s)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


def _all(conditions, each) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & each(c)
    return out


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; the first that holds rejects a document."""

    rules: tuple[tuple[Condition, ...], ...]

    def verdict(self, s: str = "__stats") -> Column:
        """The number and text of the rule that rejects the document, null where none does."""
        out = None
        for i, rule in enumerate(self.rules, 1):
            text = F.lit(f"{i}: " + " and ".join(map(str, rule)))
            test = _all(rule, lambda c: c.on_statistics(s))
            out = F.when(test, text) if out is None else out.when(test, text)
        return F.lit(None).cast("string") if out is None else out


def learn(stats: DataFrame, bad: Column, hold: Column, s: str = "__stats", bins: int = 32, max_rules: int = 8,
          max_conditions: int = 4, min_precision: float = 0.95, min_covered: int = 5) -> DecisionList:
    """Learn from every row of ``stats``; ``bad`` marks low quality, ``hold`` the rows kept back for pruning.

    Each step is one aggregate with a row per feature and bin, whatever the number of labelled rows.
    """
    rows = stats.select(*[ratio(f, s).alias(f) for f in RATIOS], bad.cast("int").alias("bad"), hold.alias("hold"))
    rows = written(rows.where(F.col("bad").isNotNull()), "quality-labelled")
    at = [i / bins for i in range(1, bins)]
    q = rows.agg(*[F.percentile_approx(f, at, 10_000).alias(f) for f in RATIOS]).first()
    cuts = {f: sorted(set(q[f] or [])) for f in RATIOS}
    rows = written(rows.select(*[sum([(F.col(f) > t).cast("int") for t in cuts[f]], F.lit(0)).alias(f) for f in RATIOS], "bad", "hold"),
                   "quality-bins")
    rules: list[tuple[Condition, ...]] = []
    left = F.lit(True)
    while len(rules) < max_rules:
        rule = _grow(rows.where(left & ~F.col("hold")), cuts, max_conditions)
        rule = rule and _prune(rows.where(left & F.col("hold")), rule, min_precision, min_covered)
        if not rule:
            break
        rules.append(tuple(rule))
        left = left & ~_all(rule, Condition.on_bins)
    return DecisionList(tuple(rules))


def _grow(rows: DataFrame, cuts: dict[str, list[float]], max_conditions: int) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < max_conditions:
        inside = rows.where(_all(rule, Condition.on_bins))
        cells = inside.select("bad", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in cuts])).alias("x"))
        cells = cells.groupBy("x.f", "x.b").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()  # features x bins
        by = {f: {} for f in cuts}
        for r in cells:
            by[r["f"]][r["b"]] = (r["p"], r["n"])
        p0, n0 = (sum(x[i] for x in next(iter(by.values())).values()) for i in (0, 1))
        best = (0.0, None)
        for f in sorted(by):
            p = n = 0
            for b in range(len(cuts[f])):
                p, n = p + by[f].get(b, (0, 0))[0], n + by[f].get(b, (0, 0))[1]
                for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                    gain = _foil(p0, n0, pp, nn)
                    if gain > best[0] + 1e-9:
                        best = (gain, Condition(f, above, cuts[f][b], b))
        if best[1] is None:
            break
        rule.append(best[1])
        if n0 == 0:
            break
    return rule


def _foil(p0: int, n0: int, p: int, n: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p and p0 else 0.0


def _prune(rows: DataFrame, rule: list[Condition], min_precision: float, min_covered: int) -> list[Condition]:
    counts = []
    for i in range(1, len(rule) + 1):
        test = _all(rule[:i], Condition.on_bins)
        counts += [F.coalesce(F.sum(F.when(test, F.col("bad"))), F.lit(0)), F.coalesce(F.sum(F.when(test, 1 - F.col("bad"))), F.lit(0))]
    got = rows.agg(*[c.alias(f"c{i}") for i, c in enumerate(counts)]).first()
    best = (-2.0, 0)
    for i in range(len(rule)):
        p, n = got[2 * i], got[2 * i + 1]
        if p >= min_covered and p >= min_precision * (p + n) and (p - n) / (p + n) > best[0]:
            best = ((p - n) / (p + n), i + 1)
    return rule[: best[1]]


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 20_000, **learning) -> DataFrame:
    """The documents with ``__stats``, ``__base_failed`` and ``__rule`` (null: no rule rejects it) added.

    The list is learned from at most ``max_labelled`` labels, chosen by a hash of their rows; only those documents'
    statistics are worked out for it. It is then applied in one pass over the documents, which are not written or
    shuffled.
    """
    prepare(docs.sparkSession)
    known = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").alias("__label_id"), "quality")
    known = known.orderBy(F.xxhash64("__label_id", "quality"), "__label_id").limit(max_labelled)
    train = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    train = train.join(F.broadcast(known), F.col("__id") == F.col("__label_id"))  # at most max_labelled rows
    train = with_statistics(train, "__text").drop("__text").where(~base_failed())
    rules = learn(train, F.col("quality") == 0, F.crc32(F.concat(F.lit("prune:"), F.col("__id").cast("string")).cast("binary")) % 3 == 0, **learning)
    return with_statistics(docs, text_col).withColumn("__base_failed", base_failed()).withColumn("__rule", rules.verdict())


def keep_good(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """The documents that neither the base rules nor the learned list rejects, with their own columns."""
    return judge(docs, labels, **kw).where(~F.col("__base_failed") & F.col("__rule").isNull()).select(docs.columns)


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the five counts, base_failed, kept and the rule that rejected the document."""
    out = judge(docs.select("doc_id", "text"), labels).drop("text")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", *[F.col(f"__stats.{x}").alias(x) for x in names], F.col("__base_failed").alias("base_failed"),
                      (~F.col("__base_failed") & F.col("__rule").isNull()).alias("kept"), F.col("__rule").alias("rule"))
