from ledgerspark.llm import quality_rules


def test_long_words_are_counted_too(spark):
    """Only words of up to four letters were counted before."""
    rows = spark.createDataFrame([("en", "often often often it seldom"), ("en", "often it"), (None, "allein")], "_lang string, _text string")
    got = {r["_of"]: r["_common"] for r in quality_rules.common_words(rows).collect()}
    assert got == {"en": ["often", "it", "seldom"], None: ["often", "it", "allein", "seldom"]}
