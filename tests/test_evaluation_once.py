"""The corpus statistics read each input once, so plans and what the driver keeps of them stay small."""

from sparkveil.operators import evaluation


def test_each_input_is_read_once(spark):
    docs = spark.createDataFrame([(1, "ab cd ef"), (2, "x y"), (3, None)], "doc_id long, text string")
    kind = "doc_id long, start int, end int, type string, pos int"
    gold = spark.createDataFrame([(1, 0, 2, "A", 1), (1, 3, 5, "B", 2), (2, 0, 1, "A", 1), (9, 0, 1, "A", 1)], kind)
    predicted = spark.createDataFrame([(1, 0, 2, "A", 1), (1, 0, 2, "A", 2), (1, 4, 5, "B", 3), (1, 2, 3, "A", 4), (2, 0, 9, "A", 1), (3, 0, 1, "A", 1), (9, 0, 1, "A", 1)], kind)
    out = evaluation.evaluate_predictions(docs, gold, predicted)
    assert out._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 3
    row = out.first()
    # Spans of documents that are not listed do not count, repeats count in totals, but not in the exact sets.
    assert (row.true_positives, row.false_positives, row.false_negatives, row.total_gold, row.total_predicted) == (1, 4, 2, 3, 6)
    assert (row.offset_failures, row.documents_with_fp, row.relaxed_recall, row.relaxed_precision) == (3, 3, 1.0, 0.5)
