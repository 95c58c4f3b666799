import random

from siltstone.llm import langid, toxicity
from siltstone.llm.common import ready

STEMS = {"en": "the ing wh tion ly and", "de": "sch ung der keit ich ein", "nl": "het een ij aan oor van", "fr": "eau le ité oi que ment", "es": "ción el ado ñ que los", "xx": "ぬ ろ む ゆ け て"}


def prose(rng, lang, n):
    stems = STEMS[lang].split()
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus(spark, rng, n=240):
    langs = list(STEMS)
    rows = [(i, prose(rng, langs[i % len(langs)], rng.randrange(8, 60)), langs[i % len(langs)]) for i in range(n)]
    return ready(spark).createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages_held_out(spark, docs, no_docs):
    rows = corpus(spark, random.Random(1))
    model = langid.train(rows.where("doc_id % 5 <> 0"))
    assert model.families == ["germanic", "romance", "xx"]
    held = langid.identify(rows.where("doc_id % 5 = 0"), model).collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    got = langid.identify(docs.selectExpr("*", "0 AS score"), model)
    assert got.columns == [*docs.columns, "score", "lang_pred", "_score"] and got.count() == docs.count()
    for r in got.collect():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r["_score"] <= 1
    assert langid.identify(no_docs, model).count() == 0
    nothing = langid.train(no_docs)
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    one = langid.train(rows.where("lang = 'fr'"))
    assert one.predict("le ment") == ("fr", 1.0)


def test_training_is_bounded_and_repeats(spark):
    rows = corpus(spark, random.Random(2), 600)
    kept = langid.sampled(rows, "lang", 20, 120)
    assert 60 < kept.count() < 200 and kept.count() == langid.sampled(rows.repartition(7), "lang", 20, 120).count()
    a, b = (langid.train(x, per_language=30) for x in (rows, rows.repartition(5)))
    assert (a.family_weights == b.family_weights).all()


def test_toxicity_held_out(spark, docs, no_docs):
    rng = random.Random(3)
    insults = ["moron", "vermin", "scumbag"]
    rows = []
    for i in range(600):
        words = prose(rng, rng.choice(["en", "fr"]), rng.randrange(10, 80)).split()
        toxic = int(rng.random() < 0.3)
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(insults))
        rows.append((i, " ".join(words), toxic))
    rows += [(600, None, 0), (601, "", 0), (602, "no label", None)]
    table = ready(spark).createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(table.where("doc_id % 3 <> 1"))
    held = toxicity.score_texts(table.where("doc_id % 3 = 1 AND toxic IS NOT NULL"), model).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in held)
    assert sum(r.predicted for r in held if r.toxic) >= 0.95 * sum(r.toxic for r in held)
    assert sum(r.predicted for r in held if not r.toxic) <= 0.02 * len(held)
    got = toxicity.score_texts(docs.withColumnRenamed("source", "score"), model)
    assert "_score" in got.columns and got.count() == docs.count() and toxicity.score_texts(no_docs, model).count() == 0
    for part in ("toxic = 0", "toxic = 1", "false"):
        assert 0 <= toxicity.train(table.where(part)).score("any text") <= 1
