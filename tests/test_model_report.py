"""A fitted model's results and report over a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from returnlens.functions import decide as D
from returnlens.operators import models as ML
from returnlens.plans import scoring as S


def test_report_agrees_with_its_results(spark):
    df = spark.range(400).selectExpr("id", "CAST(id % 4 AS STRING) AS c", "IF(id % 9 = 0, NULL, id) AS x", "CAST((id % 7) < (id % 4) + 2 AS INT) AS y",
                                     "'old' AS Prediction")
    model = ML.fit(df, [], ["c"], "y", "lr", threshold=0.6)
    results, report = S.model_report(df, model, "y")
    got, row = results.collect(), report.first()
    assert results.columns == ["id", "c", "x", "y", "Prediction", "Return_Probability", "Prediction_Label", "Confidence_Level"]
    want = {r.id: r.p for r in model.score(df).collect()}
    assert all(r.Return_Probability == want[r.id] and r.Prediction == int(want[r.id] >= 0.6) for r in got)
    bands = results.select("Confidence_Level", D.confidence_by_distance(F.col("Return_Probability"), 0.6).alias("b"))
    assert bands.where("Confidence_Level <> b").count() == 0
    hits = [(r.y, r.Prediction) for r in got]
    assert (row.tn, row.fp, row.fn, row.tp) == tuple(hits.count(k) for k in ((0, 0), (0, 1), (1, 0), (1, 1)))
    assert (row.kind, row.threshold, row.total_records, row.missing_cells) == ("lr", 0.6, 400, 45)
    assert abs(row.accuracy - (row.tn + row.tp) / 400) < 1e-6 and row.actual_rate == round(sum(y for y, _ in hits) / 400, 6)
    assert "tn" not in S.model_report(df.drop("y"), model)[1].columns
