import numpy as np

from iotrail.llm import language


def test_every_language_is_learned(spark):
    """300 languages: the rarest are learned and predicted as well as the others."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rng = np.random.default_rng(4)
    words = [["".join(rng.choice(list(letters), 5)) for _ in range(40)] for _ in range(300)]
    text = lambda k: " ".join(rng.choice(words[k], 60))
    rows = [(k * 10 + i, text(k), f"l{k:03}") for k in range(300) for i in range(2 if k < 256 else 1)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(labelled)
    assert model.languages == [f"l{k:03}" for k in range(300)] and model.code.shape[0] == 300 and model.code.shape[1] > 31
    fresh = spark.createDataFrame([(k, text(k), f"l{k:03}") for k in range(300)], "doc_id long, text string, lang string")
    right = [r.lang == r.lang_pred for r in language.predict(fresh, model).orderBy("doc_id").collect()]
    assert sum(right[256:]) >= 38 and sum(right) >= 270


def test_shares_equal_plain_means(spark):
    rows = [("abc", "x"), ("abd abd", "y"), ("zz", "z"), ("abc", "z")]
    counts = language.gram_counts(spark.createDataFrame(rows, "text string, lang string"))
    plain = np.zeros((3, 2 * language.CELLS))
    for r in counts.collect():
        plain["xyz".index(r.lang), r.cell] += r.n
    code = language.codewords(3)
    share = (plain + 0.5) / (plain + 0.5).sum(1, keepdims=True)
    ones, others = language.mean_shares(counts, ["x", "y", "z"], plain.sum(1), code)
    for k in range(code.shape[1]):
        assert np.allclose(ones[:, k], share[code[:, k] > 0].mean(0)) and np.allclose(others[:, k], share[code[:, k] < 0].mean(0))


def test_many_codewords_differ():
    code = language.codewords(3000)
    assert len(np.unique(code, axis=0)) == 3000 and code.shape[1] == int(np.ceil(31 * np.log2(3000) / 8))
