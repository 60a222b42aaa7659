"""Near copies of texts with few distinct words."""

from pagemill.llm import simhash


def test_texts_of_few_distinct_words_are_compared(spark):
    line, seven = "click here to buy cheap pills now", "alpha beta gamma delta epsilon zeta eta"
    rows = [(1, " ".join([line] * 1000)), (2, " ".join([line] * 999)), (3, seven), (4, seven + " theta"), (5, "one other text"), (6, "lone"), (7, "... !"), (8, "")]
    got = {tuple(r) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(2, 1), (4, 3), (8, 7)}
