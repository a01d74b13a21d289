import numpy as np
from pyspark.sql import functions as F

from chromaframe.llm.language import choose_languages, fit_languages, mixed_languages
from chromaframe.llm.queries import QUERIES
from chromaframe.llm.toxicity import fit_lexicon, make_folder, score_styles

SF = "/root/testdata/sf0.01"
EN = "the soft colours of this page were chosen by the artist with care and the shadows stay warm"
FR = "les couleurs douces de cette page sont choisies avec soin par une artiste et les ombres restent chaudes"


def test_language_of_given_documents(spark):
    got = QUERIES["op10_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert held > 0.97 and got.count() == 1000


def test_language_mixture_and_edges(spark):
    rows = [(i, t, lang, "own") for i, (t, lang) in enumerate([(EN, "en"), (FR, "fr"), (EN[::2] + EN, "en"), (FR, "fr"), (None, "en"), ("12 %", "fr"), ("x", None)])]
    df = spark.createDataFrame(rows, "style_key long, description string, lang string, score string")
    model = fit_languages(df)
    ask = spark.createDataFrame([(1, EN, "s"), (2, FR, "s"), (3, None, "s"), (4, "", "s"), (5, "2024 !!", "s"), (6, (EN + " ") * 3000, "s"),
                                 (7, " ".join([EN, FR] * 30), "s")], "style_key long, description string, score string")
    got = {r.style_key: r for r in mixed_languages(ask, model).collect()}
    assert [got[i].lang_pred for i in range(1, 7)] == ["en", "fr", "und", "und", "und", "en"]
    assert got[3].score == 0 and got[3].mixture == [] and got[1].score == 1
    assert {m.lang for m in got[7].mixture} == {"en", "fr"} and 0.3 < got[7].score < 0.7
    nothing = fit_languages(df.limit(0))
    assert {r.lang_pred for r in mixed_languages(ask, nothing).collect()} == {"und"}


def test_penalty_keeps_single_language():
    p = np.array([[0.6, 0.2], [0.3, 0.3], [0.1, 0.5]])
    assert [i for i, _ in choose_languages(p, np.array([600.0, 300.0, 100.0]))] == [0]
    assert {i for i, _ in choose_languages(p, np.array([4000.0, 3000.0, 3000.0]))} == {0, 1}


def test_folding():
    fold = make_folder()
    same = fold("clown idiot")
    for text in ("CLOWN Idiot", "cl0wn 1d10t", "с1own ídiot", "c.l.o.w.n i-d-i-o-t", "clooown i​diot", "clown id!ot"):
        assert fold(text) == same, text
    assert fold(None) == [] and fold("2024 a1") == ["2024", "ai"] and fold("the$$$ end") == fold("the end")


def test_toxicity_and_exceptions(spark):
    bad = [(i, f"what an utter {w} you are", 1, 0.0) for i, w in enumerate(["idiot", "1diot", "id!ot"] * 10)]
    good = [(100 + i, "a calm page of trees and water", 0, 0.0) for i in range(200)] + [(300 + i, "an idiot proof brush", 0, 0.0) for i in range(4)]
    df = spark.createDataFrame(bad + good + [(900, None, 0, 0.0), (901, "", None, 0.0)], "style_key long, description string, toxic int, score double")
    lexicon = fit_lexicon(df, exceptions=("idiot proof",))
    got = {r.style_key: r for r in score_styles(df, lexicon).collect()}
    assert got[0].score > 0.7 and got[1].score > 0.7 and got[100].score < 0.3 and got[300].score < 0.3
    assert got[900].score == got[901].score < 0.5 and 0 <= got[900].score and got[300].hits == 0
    long = spark.createDataFrame([(1, "calm " * 50_000), (2, "calm " * 50_000 + "IDIOT")], "style_key long, description string")
    hits = {r.style_key: r.hits for r in score_styles(long, lexicon).collect()}
    assert hits == {1: 0, 2: 1}
    assert score_styles(df.limit(0), lexicon).count() == 0


def test_toxicity_of_given_documents(spark):
    got = QUERIES["op3_toxicity"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    rank = got.score.rank()
    pos = got.toxic == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.85 and got[got.predicted == 1].toxic.mean() > 0.9
