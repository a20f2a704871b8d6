from storelens.operators import aspects as AS


def test_aspects_are_a_function_of_the_text(spark):
    filler = "the box came with a cable and a leaflet. " * 400
    texts = {
        "good": "The battery is great. The price is awful!", "turned": "Shipping wasn't fast; the screen is not bad",
        "far": filler + "Customer support was rude", "plain": "It has a screen.", "mixed": "Great battery. The battery died.",
        "but": "Delivery was quick but the build is flimsy", "none": "I like it", "empty": "", "null": None,
    }
    docs = spark.createDataFrame(list(texts.items()), "review_id string, text string")
    scores = AS.score_aspects(docs)
    assert scores.columns == ["review_id", "aspect", "sentiment", "score"]
    got = {(r.review_id, r.aspect, r.sentiment): r.score for r in AS.extract_aspects(scores).collect()}
    assert set(got) == {
        ("good", "Battery", "Positive"), ("good", "Price", "Negative"), ("turned", "Shipping", "Negative"),
        ("turned", "Display", "Positive"), ("far", "Support", "Negative"), ("plain", "Display", "Neutral"),
        ("but", "Shipping", "Positive"), ("but", "Build", "Negative"),
    }
    assert got["good", "Battery", "Positive"] == round(5 / 7, 4)
    total = scores.groupBy("review_id", "aspect").sum("score").collect()
    assert all(abs(r["sum(score)"] - 1) < 1e-12 for r in total) and ("mixed", "Battery") in {(r.review_id, r.aspect) for r in total}
    # the same texts under other ids give the same scores
    again = AS.score_aspects(docs.selectExpr("concat('x', review_id) AS review_id", "text"))
    assert sorted((r.review_id, r.aspect, r.sentiment, r.score) for r in again.collect()) == \
        sorted(("x" + r.review_id, r.aspect, r.sentiment, r.score) for r in scores.collect())
