from pyspark.sql import functions as F

from storelens.functions import text as TX
from storelens.operators import images as IM


def one(spark, expr, value, typ="string"):
    return spark.createDataFrame([(value,)], f"v {typ}").select(expr(F.col("v")).alias("o")).first()["o"]


def test_clean_review_text(spark):
    assert one(spark, TX.clean_review_text, "wow!?.") == "wow.."
    assert one(spark, TX.clean_review_text, "<b>Great</b>   product!!!!!") == "Great product!!"
    assert one(spark, TX.clean_review_text, "café  naïve") == "caf na ve"
    assert one(spark, TX.clean_review_text, None) == ""


def test_validity_reasons(spark):
    df = spark.createDataFrame([("x" * 9, 3), ("x" * 10, 3), ("x" * 10, 0), ("x" * 10, 6)], "t string, r int")
    got = [r["o"] for r in df.select(TX.review_invalid_reason(F.col("t"), F.col("r")).alias("o")).collect()]
    assert got == ["too short: 9 chars", "ok", "invalid rating: 0", "invalid rating: 6"]


def _tok(spark, n):
    text = " ".join(f"w{i}" for i in range(n))
    df = spark.createDataFrame([(text,)], "t string").select(TX.head_tail_tokens(TX.word_token_ids(F.col("t"))).alias("s"))
    return df.first()["s"]


def test_head_tail_tokens(spark):
    s = _tok(spark, 1024)
    assert s["truncation_applied"] and len(s["input_ids"]) == 512 and sum(s["attention_mask"]) == 512
    full = _tok(spark, 1024 // 1)
    ids = spark.createDataFrame([(" ".join(f"w{i}" for i in range(1024)),)], "t string") \
        .select(TX.word_token_ids(F.col("t")).alias("i")).first()["i"]
    assert full["input_ids"][1:129] == ids[:128] and full["input_ids"][129:511] == ids[-382:]
    assert not _tok(spark, 510)["truncation_applied"] and _tok(spark, 511)["truncation_applied"]
    short = _tok(spark, 5)
    assert len(short["input_ids"]) == 512 and sum(short["attention_mask"]) == 7


def test_upload_and_image_rules(spark):
    import struct
    png = b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\rIHDR" + struct.pack(">II", 256, 256) + b"\x00" * 6000
    small_png = b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\rIHDR" + struct.pack(">II", 63, 63) + b"\x00" * 6000
    rows = [("a/x.png", png), ("a/y.gif", png), ("a/z.png", png[:4999]), ("a/w.jpg", png), ("a/v.png", small_png),
            ("a/big.png", b"\x89PNG" + b"\x00" * 10_000_001)]
    df = spark.createDataFrame(rows, "path string, content binary")
    up = {r["path"]: r["reason"] for r in IM.upload_rules(df).collect()}
    assert up["a/x.png"] == "ok" and up["a/y.gif"].startswith("Invalid extension")
    assert up["a/z.png"].startswith("File too small") and up["a/w.jpg"].startswith("File content does not match")
    im = {r["path"]: r["reason"] for r in IM.image_rules(df).collect()}
    assert im["a/x.png"] == "ok" and im["a/v.png"] == "image too small: 63x63px"
    assert im["a/big.png"].startswith("file too large")


def test_first_seen_dedup_across_categories(spark):
    df = spark.createDataFrame([("b/1.png", "b", "h1"), ("a/2.png", "a", "h1"), ("a/3.png", "a", "h2")],
                               "path string, category string, sha256 string")
    kept = sorted((r["path"], r["category"]) for r in IM.first_seen_dedup(df).collect())
    assert kept == [("a/2.png", "a"), ("a/3.png", "a")]


def test_scan_image_tree(spark, tmp_path):
    from storelens.sources.files import scan_image_tree
    for cat, name in [("shoes", "a.JPG"), ("shoes", "b.txt"), ("bags", "sub/c.png")]:
        p = tmp_path / "root" / cat / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"\xff\xd8" + b"0" * 10)
    got = sorted((r["category"], r["path"].split("/")[-1]) for r in scan_image_tree(spark, str(tmp_path / "root")).collect())
    assert got == [("bags", "c.png"), ("shoes", "a.JPG")]


def test_cleaning_in_three_passes_equals_the_five_of_the_rule(spark):
    import random

    def five(t):
        t = F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), r"\s+", " "))
        t = F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", " "), r"([!?.]){3,}", "$1$1")
        return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^\x20-\x7E\n]", " "), r"\s+", " "))

    rng = random.Random(8)
    parts = ["a", "<", ">", "<b>", "<>", "< >", "<\n>", "!", "?", ".", "...", "!?.", " ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c", "\x00", "\x7f", "\x1c", "\x85", "\xa0", "é", "🙂", " ", "~", "word"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + [None, "", " ", "é" * 50_000, " \n" * 50_000, "<" * 2000, "!" * 50_000]
    df = spark.createDataFrame([(x,) for x in texts], "t string").repartition(4)
    assert df.where(~five(F.col("t")).eqNullSafe(TX.clean_review_text(F.col("t")))).count() == 0
    assert str(TX.clean_review_text(F.col("t"))).count("regexp_replace") == 3
