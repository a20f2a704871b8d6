"""L12's learned scorer: an aspect and polarity lexicon induced from labelled texts, applied to whole texts.

Induction. A class is an aspect or a sentiment; ``labels`` says which texts carry which classes. A word's weight for
a class is the smoothed pointwise mutual information of their texts, in thousandths, not below 0. Weights are
then spread over the word graph, in which words that stand side by side in a clause are neighbours: in each of
``ROUNDS`` rounds a word takes 3/10 of its weight from its neighbours' mean. So a word that is rarely labelled
itself takes on the class of the words it goes with. The ``MAX_TERMS`` strongest (word, class) pairs are the lexicon:
a bounded model, broadcast for scoring. All weights are whole numbers, so sums are exact in any order.

Scoring. Within a clause, an aspect's weight times a sentiment's weight is that clause's vote; an aspect's
score for a sentiment is its share of the votes of all clauses, with ``PRIOR`` added to each of the three.
Null, empty and wordless texts mention nothing; words have three letters a-z or more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.operators.aspects import ASPECTS, EVAL_LABELS, SENTIMENTS

CLAUSE = r"[.!?;:\n\r]+"
WORD = "[a-z]{3,}"
MIN_TEXTS = 5  # texts that hold a word
MIN_PAIRS = 3  # times that two words stand side by side
ROUNDS = 2
MIN_WEIGHT = 100
MAX_TERMS = 20_000
PRIOR = 100


def clauses(texts: DataFrame, id_col: str = "review_id", text_col: str = "text") -> DataFrame:
    """(id, clause, words): the words of every clause, in order."""
    parts = F.split(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), CLAUSE)
    c = texts.select(F.col(id_col).alias("id"), F.posexplode(parts).alias("clause", "_c"))
    return c.select("id", "clause", F.regexp_extract_all("_c", F.lit(f"({WORD})"), F.lit(1)).alias("words")).where(F.size("words") > 0)


def labelled_aspects(terms: DataFrame) -> DataFrame:
    """(id, class) of labelled aspect terms: the first aspect (in order) whose name holds the term or is held by it."""
    term = F.lower(F.coalesce(F.col("term"), F.lit("")))
    match = F.coalesce(*[F.when((F.instr(term, F.lit(a.lower())) > 0) | ((F.length(term) >= 3) & (F.instr(F.lit(a.lower()), term) > 0)), a) for a in ASPECTS])
    kept = terms.where(F.col("polarity").isin(*EVAL_LABELS)).select(F.col("sentence_id").alias("id"), match.alias("class"))
    return kept.where(F.col("class").isNotNull()).distinct()


def word_weights(parts: DataFrame, labels: DataFrame) -> DataFrame:
    """(word, class, weight > 0) by mutual information over texts."""
    # dealt to a set number of tasks: few bytes here become many rows once words and classes are exploded
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = parts.repartition(tasks, "id").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"))
    classes = labels.repartition(tasks, "id").groupBy("id").agg(F.collect_list("class").alias("classes"))
    each = whole.join(classes, "id", "left").select(F.explode("words").alias("word"), F.array_append(F.coalesce("classes", F.array()), F.lit("")).alias("classes"))
    both = each.select("word", F.explode("classes").alias("class")).groupBy("word", "class").agg(F.count(F.lit(1)).alias("n_wc"))  # the class "" counts texts
    both = both.withColumn("n_w", F.max(F.when(F.col("class") == "", F.col("n_wc"))).over(Window.partitionBy("word")))
    both = both.where((F.col("class") != "") & (F.col("n_w") >= MIN_TEXTS))
    n = parts.select("id").distinct().agg(F.count(F.lit(1)).alias("n"))
    of_class = labels.groupBy("class").agg(F.count(F.lit(1)).alias("n_c"))  # a row a class
    j = both.join(F.broadcast(of_class), "class").crossJoin(F.broadcast(n))  # one row
    pmi = F.log(((F.col("n_wc") + 1) * F.col("n")).cast("double") / ((F.col("n_w") + 2) * (F.col("n_c") + 1)).cast("double"))
    return j.select("word", "class", F.floor(pmi * 1000).cast("bigint").alias("weight")).where(F.col("weight") > 0)


def word_graph(parts: DataFrame) -> DataFrame:
    """(word, other, times) of words that stand side by side, in both directions, with the word's sum of times."""
    pairs = F.arrays_zip(F.slice("words", F.lit(1), F.size("words") - 1).alias("a"), F.slice("words", F.lit(2), F.size("words") - 1).alias("b"))
    seen = parts.where(F.size("words") > 1).select(F.explode(pairs).alias("p")).select("p.a", "p.b").where("a <> b")
    counted = seen.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= MIN_PAIRS)
    both = counted.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), "times"),
                                            F.struct(F.col("b").alias("word"), F.col("a").alias("other"), "times"))).alias("e")).select("e.*")
    total = both.groupBy("word").agg(F.sum("times").alias("total"))
    return both.join(total, "word")


def spread_weights(weights: DataFrame, graph: DataFrame) -> DataFrame:
    """One round: 7/10 of the own weight and 3/10 of the neighbours' mean; words without neighbours keep theirs."""
    near = graph.join(weights.withColumnRenamed("word", "other"), "other")
    near = near.groupBy("word", "class").agg(F.sum(F.col("times") * F.col("weight")).alias("near"))
    j = weights.join(near, ["word", "class"], "full").join(graph.groupBy("word").agg(F.max("total").alias("all")), "word", "left")
    own, taken = F.coalesce("weight", F.lit(0)), F.coalesce("near", F.lit(0))
    moved = F.when(F.col("all").isNull(), own).otherwise(_div(7 * own * F.col("all") + 3 * taken, 10 * F.col("all")))
    return j.select("word", "class", moved.alias("weight")).where(F.col("weight") > 0)


def _div(a: Column, b: Column) -> Column:
    """Whole-number division of numbers that are not negative."""
    return F.call_function("div", a, b)


def induce(texts: DataFrame, labels: DataFrame, id_col: str = "review_id", text_col: str = "text") -> DataFrame:
    """The lexicon (word, class, weight) of labelled texts; ``labels``: (id, class), each once."""
    return induce_from(clauses(texts, id_col, text_col).checkpoint(eager=True), labels)


def induce_from(parts: DataFrame, labels: DataFrame) -> DataFrame:
    """``induce`` over ready ``clauses``, which are read three times."""
    graph = word_graph(parts).checkpoint(eager=True)
    weights = word_weights(parts, labels.checkpoint(eager=True)).checkpoint(eager=True)
    for _ in range(ROUNDS):
        weights = spread_weights(weights, graph)
    return weights.where(F.col("weight") >= MIN_WEIGHT).orderBy(F.desc("weight"), "word", "class").limit(MAX_TERMS).checkpoint(eager=True)


def score_by_lexicon(docs: DataFrame, lexicon: DataFrame, id_col: str = "review_id", text_col: str = "text") -> DataFrame:
    """(review_id, aspect, sentiment, score) for each aspect that a clause of the whole text mentions with a polarity."""
    return score_clauses(clauses(docs, id_col, text_col), lexicon)


def score_clauses(parts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``score_by_lexicon`` over ready ``clauses``."""
    w = parts.select("id", "clause", F.explode("words").alias("word")).join(F.broadcast(lexicon), "word")  # at most MAX_TERMS rows
    each = w.groupBy("id", "clause").agg(*[F.sum(F.when(F.col("class") == c, F.col("weight")).otherwise(0)).alias(c) for c in [*ASPECTS, *SENTIMENTS]])
    polar = sum((F.col(s) for s in SENTIMENTS[1:]), F.col(SENTIMENTS[0])) > 0
    cells = F.array(*[F.struct(F.lit(a).alias("aspect"), F.col(a).alias("strength")) for a in ASPECTS])
    votes = each.where(polar).select("id", F.explode(cells).alias("_a"), *SENTIMENTS).where(F.col("_a.strength") > 0)
    votes = votes.groupBy(F.col("id").alias("review_id"), F.col("_a.aspect").alias("aspect")).agg(
        *[F.sum(_div(F.col("_a.strength") * F.col(s), F.lit(1000))).alias(s) for s in SENTIMENTS])
    total = sum((F.col(s) for s in SENTIMENTS[1:]), F.col(SENTIMENTS[0])) + 3 * PRIOR
    out = F.array(*[F.struct(F.lit(s).alias("sentiment"), ((F.col(s) + PRIOR) / total).alias("score")) for s in SENTIMENTS])
    return votes.select("review_id", "aspect", F.explode(out).alias("s")).select("review_id", "aspect", "s.*")


def best_words(lexicon: DataFrame, n: int = 10) -> DataFrame:
    """The n strongest words of every class, for reading."""
    w = Window.partitionBy("class").orderBy(F.desc("weight"), "word")
    return lexicon.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


# ---------------------------------------------------------------------------- the same in SQL, for checks


def lexicon_sql(texts: str, labels: str) -> str:
    """CTEs ``lex`` (word, class, weight) over ``texts`` (id, text) and ``labels`` (id, class)."""
    spread = ""
    for r in range(ROUNDS):
        spread += f""",
near{r} AS (SELECT g.word, w.class, sum(g.times * w.weight) AS near FROM graph g JOIN w{r} w ON w.word = g.other GROUP BY ALL),
w{r + 1} AS (SELECT * FROM (SELECT word, class, CAST(CASE WHEN t.total IS NULL THEN coalesce(w.weight, 0)
    ELSE (7 * coalesce(w.weight, 0) * t.total + 3 * coalesce(n.near, 0)) // (10 * t.total) END AS BIGINT) AS weight
  FROM w{r} w FULL JOIN near{r} n USING (word, class) LEFT JOIN totals t USING (word)) WHERE weight > 0)"""
    return f"""{clauses_sql("parts", texts)},
words AS (SELECT DISTINCT id, unnest(words) AS word FROM parts),
n_w AS (SELECT word, count(*) AS n_w FROM words GROUP BY 1 HAVING count(*) >= {MIN_TEXTS}),
n_c AS (SELECT class, count(*) AS n_c FROM {labels} GROUP BY 1),
n_wc AS (SELECT word, class, count(*) AS n_wc FROM words JOIN {labels} USING (id) GROUP BY 1, 2),
w0 AS (SELECT * FROM (SELECT word, class, CAST(floor(1000 * ln(CAST((n_wc + 1) * (SELECT count(DISTINCT id) FROM parts) AS DOUBLE)
    / CAST((n_w + 2) * (n_c + 1) AS DOUBLE))) AS BIGINT) AS weight FROM n_wc JOIN n_w USING (word) JOIN n_c USING (class)) WHERE weight > 0),
pairs AS (SELECT unnest(list_zip(words[1:len(words) - 1], words[2:])) AS p FROM parts WHERE len(words) > 1),
counted AS (SELECT least(p[1], p[2]) AS a, greatest(p[1], p[2]) AS b, count(*) AS times FROM pairs WHERE p[1] <> p[2] GROUP BY 1, 2 HAVING count(*) >= {MIN_PAIRS}),
graph AS (SELECT a AS word, b AS other, times FROM counted UNION ALL SELECT b, a, times FROM counted),
totals AS (SELECT word, CAST(sum(times) AS BIGINT) AS total FROM graph GROUP BY 1){spread},
lex AS (SELECT * FROM w{ROUNDS} WHERE weight >= {MIN_WEIGHT} ORDER BY weight DESC, word, class LIMIT {MAX_TERMS})"""


def clauses_sql(name: str, texts: str) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT id, clause, regexp_extract_all(c, '{WORD}') AS words FROM (
  SELECT id, unnest(cs) AS c, generate_subscripts(cs, 1) AS clause FROM (
    SELECT id, regexp_split_to_array(lower(coalesce(text, '')), '[.!?;:\\n\\r]+') AS cs FROM {texts}))) WHERE len(words) > 0)"""


def scores_sql(texts: str) -> str:
    """CTE ``scores`` (review_id, aspect, sentiment, score) over ``texts`` (id, text), given ``lex``."""
    sums = ", ".join(f"sum(CASE WHEN class = '{c}' THEN weight ELSE 0 END) AS {c}" for c in [*ASPECTS, *SENTIMENTS])
    cells = ", ".join(f"{{'aspect': '{a}', 'strength': {a}}}" for a in ASPECTS)
    votes = ", ".join(f"sum((a.strength * {s}) // 1000) AS {s}" for s in SENTIMENTS)
    total = f"({' + '.join(SENTIMENTS)} + {3 * PRIOR})"
    out = ", ".join(f"{{'sentiment': '{s}', 'score': CAST({s} + {PRIOR} AS DOUBLE) / CAST({total} AS DOUBLE)}}" for s in SENTIMENTS)
    return f"""{clauses_sql("said", texts)},
hits AS (SELECT id, clause, l.* FROM (SELECT id, clause, unnest(words) AS word FROM said) JOIN lex l USING (word)),
each AS (SELECT id, clause, {sums} FROM hits GROUP BY ALL),
votes AS (SELECT id, a.aspect AS aspect, {votes} FROM (SELECT *, unnest([{cells}]) AS a FROM each WHERE {' + '.join(SENTIMENTS)} > 0) WHERE a.strength > 0 GROUP BY ALL),
scores AS (SELECT review_id, aspect, s.sentiment AS sentiment, s.score AS score FROM (SELECT id AS review_id, aspect, unnest([{out}]) AS s FROM votes))"""
