"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

Every source gets a target in words. Whole copies that fit the target are certain; the rest R of the
target is drawn by order sampling. A document of inclusion probability p and random number u ranks by
its random odds over its inclusion odds, (u / (1 - u)) / (p / (1 - p)); the sample is the shortest-rank
run of documents whose words come nearest to R, so its size is fixed, not random. Inclusion falls by
half for each doubling of a document's size over its source's mean, which keeps a few very long
documents from deciding the total; p is scaled so that the expected words are R.

Ranking a source never sorts it in one task: words are summed per rank bucket, and only the one bucket
where the total crosses R is ordered. What remains of the draw is one threshold per source.

Defined results: null text has size 0; null sources are one source, ranked last; null ids are ordinary;
rows that share id and text share their draw; a source without words has target 0; an empty table gives
an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.llm.common import WORD, prepare, whole, written

BUCKET_ROWS = 20_000
U_SCALE = float(2**52)


def size_of(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("bigint")


def draw(seed: int, doc_id: Column, text: Column) -> Column:
    """A number in (0, 1) that depends on seed, id and text alone, so reruns agree."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), whole(text)).cast("binary"))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(U_SCALE)


def targets(rows: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, n_docs, target: ``share`` of all words by weight, at most ``cap`` times a source's words.

    Resharing the excess by weight ends at min(cap * size, level * weight) with one level for all;
    sources reach their cap in the order of cap * size / weight, so the level has a closed form.
    """
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    every = Window.partitionBy(F.lit(0))
    s = s.withColumn("nth", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("nth") % len(weights)).cast("int") + 1)
    s = s.withColumns({"weight": w, "top": F.col("source_size") * F.lit(cap)})
    order = every.orderBy(F.col("top") / F.col("weight"), "nth")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("top").over(before), F.lit(0.0)))
                     / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    # the first source, in order of reaching the cap, whose level stays below its own cap fixes the level
    s = s.withColumn("at", F.row_number().over(order))
    fits = F.min(F.when(F.col("level") * F.col("weight") <= F.col("top"), F.struct("at", "level"))).over(every)
    s = s.withColumn("fits", fits)
    below = F.col("fits").isNotNull() & (F.col("at") >= F.col("fits.at"))
    target = F.when(below, F.col("fits.level") * F.col("weight")).otherwise(F.col("top"))
    return s.select("source", "source_size", "n_docs", target.alias("target"))


def inclusion(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """Per source and size class: copies that are certain, the rest to draw and the inclusion probability."""
    c = rows.join(goal, rows["source"].eqNullSafe(goal["source"])).select(goal["source"], "source_size", "n_docs", "target", "size")
    c = c.withColumn("cls", size_class(F.col("size"), F.col("n_docs"), F.col("source_size")))
    c = c.groupBy("source", "source_size", "n_docs", "target", "cls").agg(F.sum("size").alias("words"))
    c = c.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint"))
    c = c.withColumns({"rest": F.col("target") - F.col("copies") * F.col("source_size"), "w": class_weight(F.col("cls"))})
    by = Window.partitionBy("source").orderBy("cls")
    left = F.col("rest") - F.coalesce(F.sum("words").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = c.withColumn("scale", left / F.nullif(F.sum(F.col("w") * F.col("words")).over(by.rowsBetween(0, Window.unboundedFollowing)), F.lit(0.0)))
    fits = F.min(F.when(F.col("scale") * F.col("w") <= 1, F.struct("cls", "scale"))).over(Window.partitionBy("source"))
    c = c.withColumn("fits", fits)
    p = (F.when(F.col("rest") <= 0, F.lit(0.0)).when(F.col("fits").isNull() | (F.col("cls") < F.col("fits.cls")), F.lit(1.0))
         .otherwise(F.col("fits.scale") * F.col("w")))
    return c.select("source", "source_size", "n_docs", "target", "copies", "rest", "cls", p.alias("p"))


def size_class(size: Column, n_docs: Column, source_size: Column) -> Column:
    """Doublings of the source's mean size; 0 up to twice the mean."""
    q = F.when(source_size > 0, F.floor(size * n_docs / source_size)).otherwise(F.lit(0))
    return F.greatest(F.length(F.bin(F.greatest(q, F.lit(1)).cast("bigint"))) - 1, F.lit(0))


def class_weight(cls: Column) -> Column:
    return F.lit(1.0) / F.pow(F.lit(2.0), cls)


def rank_key(u: Column, p: Column) -> Column:
    return F.when(p > 0, u * (1 - p) / ((1 - u) * p))


def thresholds(rows: DataFrame, params: DataFrame) -> DataFrame:
    """source, cut: the largest rank that the sample of that source includes."""
    r = rows.withColumnRenamed("source", "s").join(params, F.col("s").eqNullSafe(F.col("source")) & (F.col("cls_of") == F.col("cls")))
    r = r.select("source", "size", "rest", "n_docs", rank_key(F.col("u"), F.col("p")).alias("key")).where(F.col("key").isNotNull())
    n = F.greatest(F.ceil(F.col("n_docs") / F.lit(BUCKET_ROWS)), F.lit(1))
    r = r.withColumn("b", F.floor(F.col("key") / (1 + F.col("key")) * n))
    r = written(r.drop("n_docs"), "mix-keys")
    sums = r.groupBy("source", "b", "rest").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    # buckets that end at or below the rest are taken whole; only those that reach it are ordered
    open_ = (F.col("ahead") <= F.col("rest")) & ((F.col("ahead") + F.col("words") > F.col("rest")) | (F.col("ahead") == F.col("rest")))
    sums = written(sums.withColumn("open", open_).where(F.col("ahead") <= F.col("rest")), "mix-buckets")
    taken = sums.where(~F.col("open")).groupBy("source").agg(F.max("b").alias("b"))
    taken = r.join(taken.withColumnRenamed("source", "s").withColumnRenamed("b", "tb"),
                   F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("tb"))).select("source", "key")
    some = r.join(sums.where("open").select(F.col("source").alias("s"), F.col("b").alias("ob"), "ahead"),
                  F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("ob")))
    run = Window.partitionBy("source", "b").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    some = some.withColumn("before", F.col("ahead") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    some = some.where(2 * F.col("before") + F.col("size") <= 2 * F.col("rest")).select("source", "key")
    return taken.unionByName(some).groupBy("source").agg(F.max("key").alias("cut"))


def plan(rows: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, cls) rows with target, copies, p and cut, from rows of source, size and u."""
    goal = written(targets(rows, weights, share, cap), "mix-targets")
    params = written(inclusion(rows, goal), "mix-inclusion")
    g = goal.select(F.col("source").alias("g_source"), "n_docs", "source_size")
    classed = rows.join(g, F.col("source").eqNullSafe(F.col("g_source")))
    classed = classed.select("source", "size", "u", size_class(F.col("size"), F.col("n_docs"), F.col("source_size")).alias("cls_of"))
    cut = thresholds(classed, params).select(F.col("source").alias("c_source"), "cut")
    return written(params.join(cut, F.col("source").eqNullSafe(F.col("c_source")), "left").drop("c_source"), "mix-plan")


def apply_plan(rows: DataFrame, mix: DataFrame, source: str, size: str, u: str) -> DataFrame:
    """Add source_size, target and copies_taken to rows that carry source, size and u under the given names."""
    per_source = mix.select(F.col("source").alias("__source"), F.col("source_size").alias("__size"), F.col("n_docs").alias("__n"),
                            F.col("target").alias("__target"), F.col("copies").alias("__copies"), F.col("cut").alias("__cut")).distinct()
    by_class = mix.groupBy(F.col("source").alias("__s")).agg(F.map_from_entries(F.collect_list(F.struct("cls", "p"))).alias("__p"))
    params = per_source.join(by_class, F.col("__source").eqNullSafe(F.col("__s"))).drop("__s")
    out = rows.join(params, F.col(source).eqNullSafe(F.col("__source")))
    p = F.element_at("__p", size_class(F.col(size), F.col("__n"), F.col("__size")))
    drawn = F.coalesce(rank_key(F.col(u), p) <= F.col("__cut"), F.lit(False))
    return out.withColumn("__taken", F.col("__copies") + drawn.cast("bigint"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it (0, 1, ... ``cap`` times), with its own columns."""
    prepare(docs.sparkSession)
    own = docs.withColumns({"__words": size_of(F.col(text_col)), "__u": draw(seed, F.col(id_col), F.col(text_col))})
    rows = written(own.select(F.col(source_col).alias("source"), F.col("__words").alias("size"), F.col("__u").alias("u")), "mix-rows")
    taken = apply_plan(own, plan(rows, weights, share, cap), source_col, "__words", "__u").where(F.col("__taken") > 0)
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__taken")))).select(docs.columns)


def amounts(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every document."""
    prepare(docs.sparkSession)
    rows = written(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"),
                               draw(seed, F.col("doc_id"), F.col("text")).alias("u")), "mix-rows")
    out = apply_plan(rows, plan(rows, weights, share, cap), "source", "size", "u")
    return out.select("doc_id", "size", F.col("__size").alias("source_size"), F.col("__target").alias("target"),
                      (F.col("__taken") * F.col("size")).alias("taken"), F.col("__taken").alias("copies"))


ORACLE = """
WITH r AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
s0 AS (SELECT source, sum(size)::DOUBLE AS s, count(*) AS n FROM r GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth, s * 2::DOUBLE AS top FROM s0),
s2 AS (SELECT *, CASE nth % 3 WHEN 0 THEN 5::DOUBLE WHEN 1 THEN 2::DOUBLE ELSE 1::DOUBLE END AS w FROM s1),
s3 AS (SELECT *, row_number() OVER o AS pos, (sum(s) OVER () * 1.5::DOUBLE - (sum(top) OVER o - top)) / (sum(w) OVER () - sum(w) OVER o + w) AS level
  FROM s2 WINDOW o AS (ORDER BY top / w, nth ROWS UNBOUNDED PRECEDING)),
f AS (SELECT min(pos) AS fpos, arg_min(level, pos) AS flevel FROM s3 WHERE level * w <= top),
t AS (SELECT source, s, n, CASE WHEN pos >= fpos THEN flevel * w ELSE top END AS target FROM s3 LEFT JOIN f ON true),
k AS (SELECT r.*, t.s, t.n, t.target, CASE WHEN t.s > 0 THEN floor(target / t.s) ELSE 0 END AS copies,
    length(bin(greatest(CASE WHEN t.s > 0 THEN floor(size * t.n::DOUBLE / t.s) ELSE 0 END, 1)::BIGINT)) - 1 AS cls
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
c0 AS (SELECT source, cls, any_value(target - copies * s) AS rest, sum(size)::DOUBLE AS words, 1::DOUBLE / pow(2::DOUBLE, cls) AS w FROM k GROUP BY source, cls),
c1 AS (SELECT *, (rest - (sum(words) OVER o - words)) / nullif(sum(w * words) OVER (PARTITION BY source) - sum(w * words) OVER o + w * words, 0) AS scale
  FROM c0 WINDOW o AS (PARTITION BY source ORDER BY cls ROWS UNBOUNDED PRECEDING)),
c2 AS (SELECT source, min(cls) AS fcls, arg_min(scale, cls) AS fscale FROM c1 WHERE scale * w <= 1 GROUP BY source),
p AS (SELECT c1.source, c1.cls, rest, CASE WHEN rest <= 0 THEN 0 WHEN fcls IS NULL OR cls < fcls THEN 1 ELSE fscale * w END::DOUBLE AS p
  FROM c1 LEFT JOIN c2 ON c1.source IS NOT DISTINCT FROM c2.source),
q AS (SELECT k.*, p.rest, CASE WHEN p.p > 0 THEN u * (1 - p.p) / ((1 - u) * p.p) END AS rk FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source AND k.cls = p.cls),
b AS (SELECT source, rk, size, rest, sum(size) OVER (PARTITION BY source ORDER BY rk, size ROWS UNBOUNDED PRECEDING) - size AS before FROM q WHERE rk IS NOT NULL),
cut AS (SELECT source, max(rk) AS cut FROM b WHERE 2 * before + size <= 2 * rest GROUP BY source)
SELECT doc_id, size, s::BIGINT AS source_size, target, ((copies + CASE WHEN coalesce(rk <= cut, false) THEN 1 ELSE 0 END) * size)::BIGINT AS taken,
  (copies + CASE WHEN coalesce(rk <= cut, false) THEN 1 ELSE 0 END)::BIGINT AS copies
FROM q LEFT JOIN cut ON q.source IS NOT DISTINCT FROM cut.source
"""
