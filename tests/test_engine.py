"""The flows end to end."""

from pyspark.ml import PipelineModel

from sessionloom.engine import Engine
from sessionloom.plans.remaining import FirstWordScorer


def conversations(spark):
    topics = ["fattura pagamento ricevuta", "prenotare visita esame", "portale accesso password"]
    rows = []
    for k in range(45):
        for turn in range(1, 6):
            rows.append((k, turn, "USER" if turn % 2 else "AGENT", f"{topics[k % 3]} {topics[k % 3]} numero"))
    rows += [(100, 1, "USER", "ciao"), (101, 1, "USER", None)]
    return spark.createDataFrame(rows, "session_id long, position long, said_by string, message string")


def test_classify_review_resolve_retrain(spark, tmp_path):
    engine = Engine(FirstWordScorer())
    messages = conversations(spark)
    sessions = engine.sessions(messages).cache()
    assert sorted(r["session_id"] for r in sessions.collect()) == list(range(45))
    assert engine.sessions(messages, sessions.where("session_id < 40")).count() == 5

    results = engine.classify(sessions).cache()
    rows = results.collect()
    assert len(rows) == 45 and {r["method"] for r in rows} <= {"OUTLIER_DIRECT", "REPRESENTATIVE_ORIGINAL", "CLUSTER_PROPAGATED"}
    for topic in range(3):
        assert len({r["label"] for r in rows if r["session_id"] % 3 == topic}) == 1
    assert any(r["method"] == "CLUSTER_PROPAGATED" for r in rows)
    assert engine.review_queue(results).count() <= 45

    decisions = spark.createDataFrame([(k, ["fatture", "visite", "accesso"][k % 3], 0.95) for k in range(30)], "session_id long, label string, confidence double")
    resolved = engine.resolve(results, decisions).cache()
    assert resolved.where("method = 'HUMAN_REVIEW'").count() == 30 and resolved.count() == 45
    assert engine.retrain(sessions, results) is None
    model = engine.retrain(sessions, resolved)
    model.write().overwrite().save(f"{tmp_path}/model")
    found = engine.predict(PipelineModel.load(f"{tmp_path}/model"), sessions).collect()
    assert all(r["label"] == ["fatture", "visite", "accesso"][r["session_id"] % 3] for r in found)
