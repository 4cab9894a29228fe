"""Topics, voters and scoring against hand-made cases."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import models as M
from sessionloom.operators import topics as T

TEXTS = [(1, "pay bill bill refund", 0), (2, "refund bill due", 0), (3, "login password reset", 1), (4, "password password login bill", 1), (5, None, 1), (6, "bill password", None), (7, "--", None)]


def test_topic_terms_shares_and_features(spark):
    rows = spark.createDataFrame(TEXTS, "id long, text string, topic long")
    counts = T.term_counts(rows, "id", "text")
    topics = rows.select("id", "topic")
    terms = T.topic_terms(counts, topics, "id")
    sums = {t: Counter(w for _, x, k in TEXTS if k == t and x for w in x.split()) for t in (0, 1)}
    mean, every = sum(map(lambda c: c.total(), sums.values())) / 2, sums[0] + sums[1]
    want = {(t, w): n / c.total() * math.log(1 + mean / every[w]) for t, c in sums.items() for w, n in c.items()}
    got = {(r["topic"], r["term"]): r["weight"] for r in terms.collect()}
    assert got == pytest.approx(want)
    shares = {}
    for i, x, _ in TEXTS:
        score = {t: sum(want.get((t, w), 0) for w in (x or "").split()) for t in (0, 1)}
        shares |= {(i, t): s / sum(score.values()) for t, s in score.items() if s}
    found = T.topic_shares(counts, terms, "id")
    assert {(r["id"], r["topic"]): r["share"] for r in found.collect()} == pytest.approx(shares)
    wide = {r["id"]: r for r in T.topic_features(found, rows, [0, 1], "id", components=1).collect()}
    assert len(wide) == 7 and all(len(r["topic_probas"]) == len(r["one_hot"]) == 2 and len(r["reduced"]) == 1 for r in wide.values())
    assert wide[1]["one_hot"] == [1.0, 0.0] and wide[3]["topic"] == 1 and wide[5]["topic"] == wide[7]["topic"] == -1 and wide[7]["topic_probas"] == [0.0, 0.0]
    best = {(r["topic"], r["place"]): r["id"] for r in T.typical_texts(counts, topics, terms, "id", 1).collect()}
    mine = lambda i: sum(want[TEXTS[i - 1][2], w] for w in TEXTS[i - 1][1].split()) / len(TEXTS[i - 1][1].split())
    assert best == {(0, 1): max((1, 2), key=mine), (1, 1): max((3, 4), key=mine)}


def test_three_voters(spark):
    rows = [(k, " ".join(["red apple", "blue car", "green tree"][k % 3].split() + [f"w{k % 5}"]), "abc"[k % 3]) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    model = M.fit_voters(df, features=64, margins=True)
    assert len(model.stages) == 6 + 2 * 3
    out = model.transform(df).select("id", M.margin_probabilities(3).alias("p")).collect()
    assert all(sum(r["p"]) == pytest.approx(1) and max(range(3), key=r["p"].__getitem__) == r["id"] % 3 for r in out)
    voted = M.soft_vote(model, df, ["id"]).collect()
    assert all(r["label"] == "abc"[r["id"] % 3] and r["confidence"] > 0.5 for r in voted)


def fussy(path):
    """A scorer that fails on any batch with a bad text, and notes each time it is asked; made here, so that it goes to the tasks by value."""

    class Fussy:
        def classify(self, texts):
            with open(path, "a") as log:
                log.write(f"{len(texts)}\n")
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            return [(t.split()[0] if t else "empty", 0.9, "ok") for t in texts]

    return Fussy()


def test_a_failing_text_costs_itself_only(spark, tmp_path):
    rows = [(k, "bad one" if k in (5, 17) else f"label{k % 3} text" if k != 9 else None) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    got = {r["id"]: r["label"] for r in M.score_texts(df, "id", "text", fussy(str(tmp_path / "log"))).collect()}
    assert got == {k: "altro" if k in (5, 17) else "empty" if k == 9 else f"label{k % 3}" for k in range(40)}
    assert (tmp_path / "log").read_text().count("\n") < 40


def test_answers_are_kept_and_resumed(spark, tmp_path):
    log, answers = tmp_path / "log", f"file://{tmp_path}/answers"
    df = spark.createDataFrame([(k, f"label{k % 4} text" if k else "bad") for k in range(20)], "id long, text string").coalesce(1)
    key = F.md5("text")
    first = {r["id"]: r["label"] for r in M.answered(df, key, "text", answers, fussy(str(log))).collect()}
    asked = log.read_text().count("\n")
    again = {r["id"]: r["label"] for r in M.answered(df, key, "text", answers, fussy(str(log))).collect()}
    assert first == again == {k: f"label{k % 4}" if k else "altro" for k in range(20)}
    # only the failed one is asked again, three times
    assert log.read_text().count("\n") == asked + 3
