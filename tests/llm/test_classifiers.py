import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codecorpus.llm import cotraining, toxicity
from codecorpus.llm.common import held_out
from llm_fixtures import edge_docs, edge_labels, no_docs, no_labels  # noqa: F401

SF = "/root/testdata/sf0.1"


def test_held_out_rule(spark):
    rows = spark.createDataFrame([(i,) for i in [None, *range(200)]], "doc_id long").select(
        "doc_id", held_out("doc_id").alias("h")).collect()
    assert all(r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def measured(rows, labels, label, decided):
    joined = rows.where("held_out").join(labels, "doc_id").where(f"{label} is not null")
    return {(r[label], r["d"]): r["count"] for r in joined.groupBy(label, F.col(decided).cast("int").alias("d")).count()
            .collect()}


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    n = measured(toxicity.toxicity(docs, labels), labels, "toxic", "predicted")
    assert n[0, 0] / (n[0, 0] + n.get((0, 1), 0)) > 0.99  # clean documents are left alone
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.7  # a tenth of these labels is noise


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    n = measured(cotraining.quality_rows(docs, labels), labels, "quality", "kept")
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.99 and n[0, 0] / (n[0, 0] + n.get((0, 1), 0)) > 0.95


@pytest.mark.parametrize("operator", [toxicity.toxicity, cotraining.quality_rows])
def test_edges(operator, edge_docs, edge_labels, no_docs, no_labels):
    for labels in (edge_labels, no_labels):
        rows = operator(edge_docs, labels).collect()
        assert len(rows) == 13 and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] == 6}) == 1
        assert operator(no_docs, labels).collect() == []


def score(text, arcs):
    grammar = toxicity.Grammar(arcs)
    return toxicity.evidence(text, grammar.automaton(), grammar.composed())


def test_grammar():
    arcs = {"=idiot": 4.0, "vequ": 3.0}
    assert score(None, arcs) == score("", arcs) == score("nothing here", arcs) == (0.0, 0.0)
    plain, direct = score("what an Idiot there", arcs)[0], score("you idiot", arcs)[0]
    assert plain == 4.0 and direct == 4.0 * toxicity.TARGET_FACTOR
    assert score("not an idiot", arcs)[0] == 4.0 * toxicity.NEGATION_FACTOR
    assert score("not that it matters much, an idiot", arcs)[0] == 4.0  # another clause
    assert score("somebody said idiot again", arcs)[0] == 4.0 * toxicity.REPORT_FACTOR
    assert score("idiotic and xvequ", arcs)[0] == 0.0 and score("vequment", arcs)[0] == 3.0
    assert score("they will kill you", arcs)[0] == toxicity.THREAT_WEIGHT and score("kill time", arcs)[0] == 0.0
    total, strongest = score("an idiot. an idiot idiot.", arcs)
    assert (total, strongest) == (12.0, 8.0)


def _by_flags(words, weights, factors):
    """The composed grammar written as one loop."""
    classes = [toxicity.word_class(w) for w in words]
    target = any(c & toxicity.TARGET for c in classes)
    total, negated, reported = 0.0, -9, False
    for i, c in enumerate(classes):
        reported = reported or bool(c & toxicity.REPORT)
        negated = i if c & toxicity.NEGATION else negated
        out = weights.get(i, 0.0) * (factors["target"] if target else 1.0)
        out += factors["threat"] if target and c & toxicity.THREAT else 0.0
        out *= factors["negation"] if i - negated <= toxicity.NEGATION_REACH else 1.0
        total += out * (factors["report"] if reported else 1.0)
    return total


def test_composition_against_one_loop():
    rng = random.Random(5)
    pool = ["kill", "you", "not", "said", "idiot", "tree", "him", "never", "burn", "house"]
    for _ in range(500):
        words = rng.choices(pool, k=rng.randrange(0, 12))
        weights = {i: rng.random() * 5 for i, w in enumerate(words) if w == "idiot"}
        grammar = toxicity.Grammar(factors={k: rng.choice(v) for k, v in toxicity.CHOICES.items()})
        got = grammar.composed().score([toxicity.word_class(w) for w in words], weights)
        assert abs(got - _by_flags(words, weights, grammar.factors)) < 1e-9


def test_factors_are_fitted_to_labels():
    """Negated insults that are always clean, addressed ones always toxic."""
    insult = ([0, 0], {1: 3.0})
    negated = ([toxicity.NEGATION, 0], {1: 3.0})
    found = [[insult]] * 40 + [[negated]] * 40 + [[]] * 40
    y = np.array([1.0] * 40 + [0.0] * 80)
    grammar = toxicity.Grammar()
    toxicity.fit_factors(grammar, found, y)
    assert grammar.factors["negation"] == 0.1 and grammar.factors["report"] == toxicity.REPORT_FACTOR


def test_every_transducer_changes_held_out_scores(spark):
    """Held-out toxic clauses with one word put before their match."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    grammar = toxicity.learn(docs, labels)
    composed, automaton = grammar.composed(), grammar.automaton()
    rows = docs.join(labels.where("toxic = 1"), "doc_id").where(toxicity.held_out("doc_id")).collect()
    found = [c for r in rows for c in toxicity.clauses(r["text"], automaton) if c[1]]
    assert len(found) > 100
    plain = toxicity.TARGET | toxicity.NEGATION | toxicity.REPORT
    for bit, rises in ((toxicity.TARGET, True), (toxicity.NEGATION, False), (toxicity.REPORT, False)):
        for words, weights in found:
            if any(w & plain for w in words):
                continue
            at = min(weights)
            put = (words[:at] + [bit] + words[at:], {i + 1: w for i, w in weights.items()})
            before, after = composed.score(words, weights), composed.score(*put)
            assert after > before if rises and grammar.factors["target"] > 1 else after < before or rises
    assert composed.score([toxicity.TARGET, toxicity.THREAT], {}) == grammar.factors["threat"]


def test_cotraining_exchanges_labels():
    """A view that few labels teach learns from the other's pseudo-labels."""
    import numpy as np
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 2000).astype(float)
    strong = y[:, None] * 4 + rng.normal(size=(2000, 1))
    weak = (y[:, None] * 2 - 1) * 0.3 + rng.normal(size=(2000, 40)) * 1.5
    fit, pool, check = slice(0, 24), slice(24, 1500), slice(1500, 2000)
    accuracy = []
    for rounds in (0, 4):
        m = cotraining.co_train((strong[fit], weak[fit]), y[fit], (strong[pool], weak[pool]),
                                (strong[check], weak[check]), y[check], rounds, 0.9, 200)
        accuracy.append(((m.views[1].logit(weak[check]) > 0) == (y[check] > 0)).mean())
    assert accuracy[1] > accuracy[0] + 0.05


def test_toxicity_learns_words_not_syllables(spark):
    """Ordinary words that share a beginning with learnt ones; figures of the
    held-out fold (144 toxic, 1,200 clean at sf0.1)."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    grammar = toxicity.learn(docs, labels)
    assert all(a.startswith("=") or len(a) >= 5 for a in grammar.arcs)
    plain = ["We discuss more training this morning.", "The discovery of sculpture and the history of travel and trade.",
             "Students pay for the train to the old town."]
    rows = toxicity.scores(spark.createDataFrame([(t,) for t in plain], "text string"), grammar).collect()
    assert all(r["toxicity"] < 0.1 for r in rows)
    judged = toxicity.scores(docs.join(labels, "doc_id").where(toxicity.held_out("doc_id")), grammar)
    n = {(r["toxic"], r["p"]): r["count"] for r in judged.groupBy("toxic", (judged["toxicity"] >= 0.7).alias("p")).count().collect()}
    assert n[1, True] >= 111 and n.get((0, True), 0) <= 3


def test_an_id_with_very_many_rows_is_one_training_row(spark, monkeypatch):
    docs = spark.range(600).selectExpr("id % 30 AS doc_id", "concat('plain text number ', id) AS text", "'s' AS source",
                                       "'en' AS lang", "20L AS n_chars")
    labels = spark.range(30).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality", "cast(id % 2 AS int) AS toxic")
    sent = []
    whole = type(docs).toPandas
    monkeypatch.setattr(type(docs), "toPandas", lambda self: (sent.append(whole(self)), sent[-1])[1])
    cotraining.learn(docs, labels)
    assert sum(map(len, sent)) <= 30 and toxicity.learn(docs, labels).arcs == {}
