"""Columns of the input that have the names of added ones."""

from sourceassay.llm import quality, toxicity


def test_scores_beside_columns_of_their_names(spark):
    docs = spark.createDataFrame([(1, "some text", 5, "q", "t"), (2, None, 6, "q", "t")],
                                 "doc_id long, text string, score int, quality string, toxicity string")
    for found, name in (quality.score(docs, None), toxicity.score(docs, {})):
        rows = sorted(found.collect(), key=lambda r: r["doc_id"])
        assert name not in docs.columns and found.columns == [*docs.columns, name]
        assert [(r["score"], r["quality"], r["toxicity"]) for r in rows] == [(5, "q", "t"), (6, "q", "t")]
        assert all(0 <= r[name] <= 1 for r in rows)
