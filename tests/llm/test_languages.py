"""Languages of words: forward-backward against enumeration, and held-out accuracy at every size."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoolmark.llm import word_languages as wl
from spoolmark.llm.tables import read


def test_words():
    assert wl.words_of("Été, l'an 2x3 ² ª b c") == ["été", "l", "an", "x", "ª", "b", "c"]
    assert wl.words_of("漢字 Ünḯ ½") == ["漢字", "ünḯ"]
    assert wl.words_of("a" * 50) == ["a" * 24, "a" * 24, "aa"]
    assert wl.words_of("") == wl.words_of("12 _ .") == []
    for text in ("The Straße\u0085 of, ÀÉ-ÿ µm 7", "x" * 23 + "é y", "ß" * 30):
        assert wl.words_of(text) == wl._WORD.findall(text.lower())


@pytest.mark.parametrize("lengths", [[1], [5, 3, 1], [7, 7, 2, 6]])
def test_posteriors_equal_enumeration(monkeypatch, lengths):
    monkeypatch.setattr(wl, "SEGMENT", 2)
    rng = np.random.default_rng(sum(lengths))
    labels = 3
    scores, transitions = rng.normal(size=(sum(lengths), labels)), rng.normal(size=(labels, labels))
    got = wl.posteriors(scores, np.array(lengths), transitions)
    start = 0
    for n in lengths:
        chance = np.zeros((n, labels))
        for path in itertools.product(range(labels), repeat=n):
            value = np.exp(transitions[:, path[0]]).sum() * np.exp(
                sum(scores[start + t, path[t]] for t in range(n))
                + sum(transitions[a, b] for a, b in zip(path, path[1:]))
            )
            chance[range(n), path] += value
        assert np.allclose(got[start : start + n], chance / chance.sum(1, keepdims=True))
        start += n


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_held_out_accuracy(spark, size):
    docs = read(spark, f"/root/testdata/{size}", "documents")
    made = wl.label_documents(docs, wl.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    for row in made.where("held_out").groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).collect():
        assert row["right"] > 0.97, row
    held = {r["doc_id"]: r["held_out"] for r in made.select("doc_id", "held_out").collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in held.items())


def test_code_switched_words_and_odd_rows(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    model = wl.learn(docs)
    own = {
        lang: wl.words_of(docs.where(F.col("lang") == lang).where("crc32(cast(doc_id as string)) % 3 = 1").orderBy(F.desc("n_chars")).first()["text"])[:60]
        for lang in ("en", "fr", "de")
    }
    mixed = " ".join(own["en"] + own["fr"] + own["de"] + own["en"])
    rows = [(1, mixed), (1, mixed), (2, None), (3, ""), (4, "12 !? ²"), (None, "the"), (5, mixed * 40), (6, "漢字" * 9000)]
    table = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit(9))
    made = wl.label_documents(table, model).collect()
    assert len(made) == len(rows)
    by_id = {r["doc_id"]: r for r in made}
    truth = ["en"] * 60 + ["fr"] * 60 + ["de"] * 60 + ["en"] * 60
    said = [r["lang"] for r in by_id[1]["runs"] for _ in range(r["words"])]
    assert len(said) == 240 and np.mean([a == b for a, b in zip(said, truth)]) > 0.9
    assert by_id[1]["lang_pred"] == "en" and 0 <= by_id[1]["score"] <= 1
    for odd in (2, 3, 4):
        assert (by_id[odd]["lang_pred"], by_id[odd]["score"], by_id[odd]["runs"]) == ("und", 0.0, [])
    assert by_id[None]["held_out"] is False and by_id[6]["lang_pred"] in model.langs
    assert wl.label_documents(table.limit(0), model).count() == 0
    # Nothing to learn from: no language, or no rows at all.
    for nothing in (docs.withColumn("lang", F.lit(None).cast("string")), docs.limit(0)):
        assert wl.learn(nothing) is None
    assert {r["lang_pred"] for r in wl.label_documents(table, None).collect()} == {"und"}
    single = wl.learn(docs.withColumn("lang", F.lit("one")))
    assert {r["lang_pred"] for r in wl.label_documents(table, single).collect()} == {"one", "und"}
