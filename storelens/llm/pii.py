"""Personal data: candidate gradient boosting. DataFrame functions and Spark's own boosted trees only.

Base spans are what the strict patterns and their checks accept; they always stay. High-recall generators
propose further spans, which may overlap: addresses with spelt-out or spaced signs, dotted numbers with
other separators, groups of digits. Each candidate is described by its format and its context, without
the strict rules' own signs (the plus, the at sign, the check digit). Boosted trees learn to tell
candidates that meet a base span from the others; on candidates kept back, a threshold for each generator
is set where the selection is ``precision`` pure. Candidates above it that overlap no base span, and no
candidate of a higher score, become spans as well.

Patterns are possessive and start only where a match can: they run in time linear in the text, without
recursion. The trees are fitted on all candidates that are not kept back, and the thresholds counted on all that are.

Defined results: null text is empty and has no spans; rows that share id and text share their spans; a
table without candidates of both kinds learns nothing and adds nothing; ties between overlapping
candidates go to the first in the text, then to the longer; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import prepare, whole, written
from storelens.llm.quality_rules import once

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = "[A-Za-z0-9._%+-]"
#: Leftmost, non-overlapping, as the plain patterns would match; a run that fails at its start fails at every later one.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be worth running.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
GENERATORS = {
    "email": r"(?i)(?<![a-z0-9])[a-z0-9][a-z0-9._%+-]{0,63}+\x20?(?:@|\(at\)|\[at\]|\x20at\x20)\x20?[a-z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\x20?[a-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:\x20?[.,:]\x20?[0-9]{1,3}+){3}+",
    "number": r"(?<![0-9])[+(]?[0-9](?:[\x20().+/-]{0,2}+[0-9]){6,24}+",
}
GENERATOR_HINTS = {"email": r"(?i)@|[(\[\x20]at[)\]\x20]", "ip": r"[0-9]\x20?[.,:]\x20?[0-9]", "number": r"[0-9][\x20().+/-]{0,2}[0-9]"}
CONTEXT = ["mail", "contact", "phone", "tel", "call", "fax", "mobile", "card", "visa", "account", "ip", "host", "server", "address"]
FEATURES = ["generator", "chars", "digits", "groups", "longest_group", "first_group", "last_group", "spaces", "dashes", "dots", "brackets",
            "letters", "after_letter", "after_space", "before_letter", "before_space", "context"]


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    value = lambda i: F.substr(back, i, F.lit(1)).cast("int") * (1 + (i - 1) % 2)
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0),
                        lambda a, i: a + F.coalesce(value(i) - F.when(value(i) > 9, 9).otherwise(0), F.lit(0)))
    return total % 10 == 0


def accepted(kind: str, match: Column) -> Column:
    digits = F.translate(match, "+ ().-", "")
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(match, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def with_matches(df: DataFrame, text: Column, name: str, pattern: str, hint: str) -> DataFrame:
    """Add ``name``: matches as structs of start, end (code points, end exclusive), match, before and after.

    The pieces between matches and the matches themselves give the positions; both come from one pattern.
    """
    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("all"))
    df = once(df, "__found", F.when(text.rlike(hint), found))
    gap, hit = (lambda i: F.get("__found.gaps", i)), (lambda i: F.get("__found.all", i))
    n = F.size("__found.all")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc, i):
        begin = acc["at"] + F.length(gap(i))
        end = begin + F.length(hit(i))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end")))).alias("out"))

    some = F.col("__found").isNotNull() & (n > 0)
    df = once(df, "__at", F.when(some, F.aggregate(F.sequence(F.lit(0), n - 1), start, step)["out"]))
    spans = F.transform("__at", lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), hit(i).alias("match"),
                                                      F.right(gap(i), F.lit(24)).alias("before"), F.left(gap(i + 1), F.lit(1)).alias("after")))
    kind = "array<struct<start:int,end:int,match:string,before:string,after:string>>"
    return once(df, name, F.coalesce(spans, F.array().cast(kind))).drop("__found", "__at")


def features(generator: str, x: Column) -> Column:
    m, before = x["match"], F.lower(x["before"])
    groups = F.regexp_extract_all(m, F.lit("([0-9]+)"), F.lit(1))
    digits, longest = F.length(F.array_join(groups, "")), F.array_max(F.transform(groups, lambda g: F.length(g)))
    count = lambda chars: F.length(m) - F.length(F.translate(m, chars, ""))
    last = F.right(before, F.lit(1))
    values = [F.lit(float(list(GENERATORS).index(generator))), F.length(F.translate(m, "+@", "")), digits, F.size(groups), F.coalesce(longest, F.lit(0)),
              F.coalesce(F.length(F.get(groups, F.lit(0))), F.lit(0)), F.coalesce(F.length(F.get(groups, F.size(groups) - 1)), F.lit(0)),
              count(" "), count("-"), count("."), count("()[]"), F.length(F.regexp_replace(m, r"[^\p{L}]", "")),
              x["after"].rlike(r"^\p{L}").cast("int"), (x["after"] == " ").cast("int"), last.rlike(r"\p{L}$").cast("int"), (last == " ").cast("int"),
              before.rlike("|".join(CONTEXT)).cast("int")]
    return F.array(*[v.cast("double") for v in values])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, mark (of the text), base and candidate spans of the whole text."""
    df = docs.select("doc_id", F.xxhash64(whole(F.col("text"))).alias("mark"), whole(F.col("text")).alias("text"))
    text = F.col("text")
    for k in KINDS:
        df = with_matches(df, text, f"__{k}", PATTERNS[k], HINTS[k])

    def strict(i, k):
        return F.transform(F.filter(f"__{k}", lambda x: accepted(k, x["match"])),
                           lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("nth"), x["end"].alias("end"), F.lit(k).alias("kind")))

    def loose(g, kind):
        def candidate(x):
            shared = lambda b: F.least(b["end"], x["end"]) - F.greatest(b["start"], x["start"])
            covered = lambda b: F.greatest(b["end"], x["end"]) - F.least(b["start"], x["start"])
            return F.struct(F.lit(g).alias("generator"), x["start"].alias("start"), x["end"].alias("end"), kind(x).alias("kind"),
                            features(g, x).alias("features"), F.exists("base", lambda b: 2 * shared(b) >= covered(b)).cast("double").alias("label"),
                            F.exists("base", lambda b: shared(b) > 0).alias("touches"))
        return F.transform(f"__{g}", candidate)

    base = F.concat(*[strict(i, k) for i, k in enumerate(KINDS)])
    df = once(df, "base", F.sort_array(base)).drop(*[f"__{k}" for k in KINDS])
    for g in GENERATORS:
        df = with_matches(df, text, f"__{g}", GENERATORS[g], GENERATOR_HINTS[g])
    kind = {"email": lambda x: F.lit("email"), "ip": lambda x: F.lit("ip"),
            "number": lambda x: F.when(F.length(F.regexp_replace(x["match"], "[^0-9]", "")) >= 14, F.lit("card")).otherwise(F.lit("phone"))}
    found = F.concat(*[loose(g, kind[g]) for g in GENERATORS])
    return df.select("doc_id", "mark", "base", found.alias("candidates"))


def candidates(found: DataFrame) -> DataFrame:
    """A row for each candidate. ``label``: it is over a base span (at least half of what the two cover); ``touches``: it meets one."""
    return found.select("doc_id", "mark", F.explode("candidates").alias("c")).select(
        "doc_id", "mark", "c.*", F.pmod(F.xxhash64("doc_id", "mark", F.lit("hold")), F.lit(3)).alias("fold"))


def select(rows: DataFrame, precision: float, trees: int, depth: int, bins: int = 200) -> DataFrame | None:
    """Candidates above their generator's threshold, with their scores; none where nothing can be learned."""
    seen = rows.select(array_to_vector("features").alias("features"), "label", "generator", "fold")
    kinds = {r["label"]: r["n"] for r in rows.where("fold <> 0").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        return None
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=11, maxBins=32).fit(seen.where("fold <> 0"))
    score = vector_to_array("probability")[1]
    cells = (model.transform(seen.where("fold = 0")).groupBy("generator", F.floor(score * bins).alias("bin"))
             .agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n")).collect())  # generators x bins
    limits = {}
    for g in GENERATORS:
        p = n = 0
        for r in sorted((r for r in cells if r["generator"] == g), key=lambda r: -r["bin"]):
            p, n = p + r["p"], n + r["n"]
            if p >= precision * n:
                limits[g] = r["bin"] / bins
    if not limits:
        return None
    limit = F.coalesce(*[F.when(F.col("generator") == g, F.lit(x)) for g, x in limits.items()])
    scored = model.transform(rows.where(~F.col("touches")).withColumn("features", array_to_vector("features"))).withColumn("score", score)
    return scored.where(F.col("score") >= limit).select("doc_id", "mark", "start", "end", "kind", "score")


def detect(docs: DataFrame, precision: float = 0.98, trees: int = 10, depth: int = 3) -> DataFrame:
    """doc_id, base and added: arrays of structs (start, nth, end, kind), sorted; ``nth`` is the kind's place in KINDS."""
    prepare(docs.sparkSession)
    found = written(find(docs), "pii-found")
    rows = written(candidates(found), "pii-candidates")
    chosen = select(rows, precision, trees, depth)
    span = "array<struct<start:int,nth:int,end:int,kind:string>>"
    if chosen is None:
        return found.select("doc_id", "base", F.array().cast(span).alias("added"))
    nth = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    own = chosen.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "end", "kind", "score", nth.alias("nth"))).alias("all"))
    ahead = lambda a, b: (a["score"] > b["score"]) | ((a["score"] == b["score"]) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (
        (a["end"] > b["end"]) | ((a["end"] == b["end"]) & (a["nth"] < b["nth"]))))))
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    stay = F.filter("all", lambda x: ~F.exists("all", lambda y: meets(x, y) & ahead(y, x)))
    own = own.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"),
                     F.sort_array(F.transform(stay, lambda x: F.struct(x["start"].alias("start"), x["nth"].alias("nth"), x["end"].alias("end"), x["kind"].alias("kind")))).alias("added"))
    out = found.join(own, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")), "left")
    return out.select("doc_id", "base", F.coalesce("added", F.array().cast(span)).alias("added"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, digest of the base spans, and all spans as text."""
    out = detect(docs.select("doc_id", "text"))
    number = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint")
    counts = [number(k).alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                      joined(F.sort_array(F.concat("base", "added"))).alias("spans"), F.size("added").cast("bigint").alias("n_added"))
