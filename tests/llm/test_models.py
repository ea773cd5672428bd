"""Trained operators by held-out labels and on odd input; the pipeline against its stages' rules."""

import itertools
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import entries, langid, neardup, packing, quality, sampling, toxicity, words

from .common import WORD, empty_documents, frame, odd_documents, odd_rows, prose
from .test_exact import WORDS, base_truth, check_packing, near_truth, repeats_truth

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def crc(i):
    return zlib.crc32(str(i).encode())


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")


# --- held-out accuracy ------------------------------------------------------------------------------------------------


@tables
def test_quality_held_out(spark):
    out = entries.op3_bradley_terry_quality(spark, SF)
    got = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: crc(i) % 3 == 1)).all()
    held = got[got.held_out]
    assert auc(held.score.to_numpy(), held.quality.to_numpy()) > 0.97
    assert (held.predicted == held.quality).mean() > 0.93
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()


@tables
def test_toxicity_held_out(spark):
    out = entries.op5_toxic_spans(spark, SF)
    got = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: crc(i) % 4 == 2)).all()
    held = got[got.held_out]
    assert auc(held.score.to_numpy(), held.toxic.to_numpy()) > 0.85
    assert (held.predicted == held.toxic).mean() > 0.93
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()


@tables
def test_language_held_out(spark):
    out = entries.op7_compression_language(spark, SF)
    got = out.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: crc(i) % 4 == 2)).all()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97
    sure = held[~held.rejected]
    assert (sure.lang_pred == sure.lang).mean() >= (held.lang_pred == held.lang).mean()


def test_held_out_rows_teach_nothing(spark):
    """Labels of held-out rows may be anything: scores stay the same."""
    rng = random.Random(2)
    rows = [(k, prose(rng, 60) + (" vile awful" if k % 2 else "")) for k in range(200)]
    docs = frame(spark, rows)
    labels = lambda flip: spark.createDataFrame([(k, (k % 2) ^ (flip and crc(k) % 4 == 2), (k % 2) ^ (flip and crc(k) % 4 == 2)) for k in range(200)], "doc_id bigint, quality int, toxic int")
    score = lambda flip: {r.doc_id: r.score for r in toxicity.tag_toxic(docs, labels(flip)).collect()}
    a, b = score(False), score(True)
    assert a == b and np.mean([a[k] > 0.3 for k in range(1, 200, 2)]) > 0.95 and max(a[k] for k in range(0, 200, 2)) < 0.3


def test_toxic_offsets(spark):
    rng = random.Random(3)
    docs = frame(spark, [(k, "é " + prose(rng, 40) + (" you Vile! thing" if k % 2 else "") + " " + prose(rng, 5)) for k in range(300)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id bigint, toxic int")
    for r in toxicity.tag_toxic(docs, labels).join(docs, "doc_id").where("doc_id % 2 = 1").collect():
        assert "Vile" in {r.text[s.start : s.end] for s in r.spans}


# --- the models' mathematics ------------------------------------------------------------------------------------------


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    model = {"start": np.array([0.8, 0.3]), "move": np.array([[1.2, 0.4], [0.5, 2.0]])}
    for cuts in ([0, 9], [0, 4, 6, 9], [0, 1, 2, 9], [0, 1]):
        e = rng.normal(size=cuts[-1])
        first = np.zeros(cuts[-1], bool)
        first[cuts[:-1]] = True
        p, chain = toxicity.marginals(e, first, model)
        pairs = np.zeros((2, 2))
        for a, z in itertools.pairwise(cuts):
            total, mean, both = 0.0, np.zeros(z - a), np.zeros((2, 2))
            for y in itertools.product((0, 1), repeat=z - a):
                s = model["start"][y[0]] * np.exp(np.dot(e[a:z], y))
                for u, v in itertools.pairwise(y):
                    s *= model["move"][u, v]
                total += s
                mean += s * np.array(y)
                for u, v in itertools.pairwise(y):
                    both[u, v] += s
            assert np.allclose(p[a:z], mean / total)
            pairs += both / total
        assert np.allclose(toxicity._pair_counts(chain, first), pairs)
    assert len(toxicity.marginals(np.zeros(0), np.zeros(0, bool), model)[0]) == 0


def test_bradley_terry_ranks_by_preference():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 21))
    y = (x[:, 3] + 0.5 * x[:, 7] > -0.7).astype(int)
    model = quality.learn(x, y, (y == 0).mean())
    p = quality.probability(model, x)
    assert auc(p, y) > 0.98 and abs((p < 0.5).mean() - (y == 0).mean()) < 0.01


def test_features_do_not_depend_on_slices():
    column = pa.array([r[1] for r in odd_rows()])
    whole = np.concatenate([quality.features(w) for w in words.slices(column)])
    single = np.concatenate([quality.features(w) for w in words.slices(column, size=1)])
    assert np.allclose(whole, single)


def test_dictionaries_are_bounded():
    rows = [{"text": "x" * 60000, "label": "a"}, {"text": "y" * 60000, "label": "a"}, {"text": "z", "label": "b"}]
    got = langid.dictionaries(rows)
    assert {k: len(v) for k, v in got.items()} == {"a": langid.DICTIONARY, "b": 2}
    assert got["a"] == b"x" * 60000 + b"\n" + b"y" * (langid.DICTIONARY - 60001)  # the second is cut to the room left


def test_sample_is_bounded(spark):
    rows = spark.range(20000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("y"))
    got = sampling.sample(rows, "doc_id", "y", 300, F.lit(False)).groupBy("label").count().collect()
    assert all(200 < r["count"] < 400 for r in got) and len(got) == 2


# --- odd input --------------------------------------------------------------------------------------------------------


def some_labels(spark):
    return spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(5, 19)] + [(None, 1, 1), (8, None, None), (777, 1, 0)], "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("labels", [some_labels, no_labels])
def test_models_bear_odd_input(spark, labels):
    n = len(odd_rows())
    for f, extra in ((quality.rank_quality, []), (toxicity.tag_toxic, ["spans"])):
        out = f(odd_documents(spark), labels(spark))
        assert out.columns == ["doc_id", "held_out", "score", "predicted", *extra]
        got = out.collect()
        assert len(got) == n and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
        assert all(r.held_out for r in got if r.doc_id is None) and len({r.score for r in got if r.doc_id == 5}) == 1
        assert f(empty_documents(spark), labels(spark)).collect() == []


def test_language_bears_odd_input(spark):
    docs = odd_documents(spark)
    got = langid.identify(docs).collect()
    assert len(got) == len(odd_rows()) and {r.lang_pred for r in got} <= {"en", "de", "und"}
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (0, 1, 2))
    assert langid.identify(empty_documents(spark)).collect() == []
    unknown = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unknown} == {"und"}


# --- pipeline ---------------------------------------------------------------------------------------------------------

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rng = random.Random(13)
    at, passage = str(tmp_path_factory.mktemp("pipeline")), prose(rng, 40)
    texts = [prose(rng, rng.randint(30, 120)) for _ in range(160)]
    for k in range(0, 160, 4):
        texts[k] += " vile " + prose(rng, 2) + " awful"
    texts += [texts[k] for k in range(1, 20, 2)] + [texts[21] + " more"] + [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(6)]
    texts += [prose(rng, 20) + " password=hunter2222 " + prose(rng, 3), None, "", texts[33]]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(160)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    after = lambda df: {r.doc_id: r.text for r in df.collect()}

    one = stages["toxicity"](spark, docs, small)
    assert one.columns == docs.columns
    clean = after(one)
    gone = set(before) - set(clean)
    toxic = {k for k, t in before.items() if " vile " in (t or "")}
    assert toxic <= gone and len(gone - toxic) <= 8 and all(before[k] == t for k, t in clean.items())

    two = after(stages["near-duplicates"](spark, one, small))
    assert set(two) == {i for i, (_, _, kept) in near_truth(list(clean.items()), 5, 80).items() if kept}

    three_df = stages["repeated passages"](spark, frame_of(spark, two), small)
    three = after(three_df)
    truth = repeats_truth(list(two.items()), 20)
    assert three_df.columns == docs.columns
    assert three == {i: (t if not truth[i][1] else truth[i][2]) for i, t in two.items() if not truth[i][1] or truth[i][2]}
    assert all(r.n_chars == len(r.text) for r in three_df.collect() if r.text is not None)

    four = after(stages["secrets"](spark, frame_of(spark, three), small))
    assert set(four) == set(three)
    for i, t in four.items():
        assert not base_truth(t or "") and (t == three[i]) == (not base_truth(three[i] or ""))

    pieces = stages["packing"](spark, frame_of(spark, four), small).collect()
    assert check_packing([tuple(r) for r in pieces], four) == 0


def frame_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], COLUMNS)


def test_pipeline_run(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, small), "step")
    want = sorted((r.doc_id, r.start, r.length, bytes(r.ids)) for r in docs.collect())
    assert sorted((r.doc_id, r.start, r.length, bytes(r.ids)) for r in corpus_pipeline.run(spark, small).collect()) == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-duplicates", "repeated passages", "secrets", "packing"]


def test_pipeline_on_no_documents(spark, small, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    no_labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


# --- samples hold texts of any length ---------------------------------------------------------------------------------


def test_long_labelled_texts_teach(spark):
    """A language and a label whose texts are all longer than any usual one are learned all the same."""
    rng = random.Random(12)
    known = {lang: ["".join(rng.choice(abc) for _ in range(rng.randint(3, 8))) for _ in range(200)] for lang, abc in (("aa", "bcdfghja"), ("bb", "klmnpqre"))}
    text = lambda lang, n: " ".join(rng.choice(known[lang]) for _ in range(n))
    rows = [(k, text("aa", 60) if k % 2 else text("bb", 6000), "aa" if k % 2 else "bb", "s") for k in range(24)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    assert all(r.lang_pred == rows[r.doc_id][2] for r in langid.identify(df).collect())
    labels = spark.createDataFrame([(k, (k + 1) % 2, k % 2) for k in range(24)], "doc_id bigint, quality int, toxic int")
    out = quality.rank_quality(df, labels).collect()
    assert all(r.predicted == (r.doc_id + 1) % 2 for r in out)


def test_texts_without_a_letter_have_no_language(spark):
    texts = ["½", "²", "①", "Ⅷ", "12 ½ !", "_ ² _", "😀", "\u0301"]
    letters = ["一", "½ é", "ª", "x²", "日本"]
    train = [(k, prose(random.Random(k), 60), "en" if k % 2 else "de") for k in range(40)]
    rows = train + [(100 + k, t, None) for k, t in enumerate(texts + letters)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert all(got[100 + k] == ("und", 0.0) for k in range(len(texts)))
    assert all(got[100 + len(texts) + k][0] in ("en", "de") for k in range(len(letters)))


def test_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(k, "x" * (1000 if k else 10**6)) for k in range(50)], "doc_id bigint, text string")
    ids = docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") > 0).cast("int").alias("label"), F.lit(1).alias("n"))
    got = sampling.texts(docs, ids, "doc_id", "text", 100, 10_500)
    assert sorted(len(r["text"]) for r in got) == [1000] * 10 + [10**6]


# --- results of trained operators by plain recomputation --------------------------------------------------------------


def test_quality_equals_a_plain_version(spark):
    """Scores from the features of single texts and the same pairs, the threshold by sorting."""
    rng = random.Random(21)
    rows = [(k, (prose(rng, rng.randint(30, 90)) if k % 3 else " ".join(["buy!!! now $$$"] * rng.randint(3, 9))), "en", "s") for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(120)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality.rank_quality(df, labels).collect()}
    one = lambda t: quality.features(next(words.slices(pa.array([t]))))[0]
    place = {r.id: r.h for r in spark.range(120).select("id", F.xxhash64("id", F.lit(11)).alias("h")).collect()}
    learned = sorted((k for k in range(120) if crc(k) % 3 != 1), key=place.get)
    x, y = np.array([one(rows[k][1]) for k in learned]), np.array([int(k % 3 > 0) for k in learned])
    model = quality.learn(x, y, (y == 0).mean())
    z = np.clip((x - model["mean"]) / model["sd"], -6, 6)
    s = np.concatenate([z, z * z / 3], 1) @ model["w"]
    # all weights are equal, so as many scores lie below the threshold as there are bad texts; it lies between two of them
    ranked, bad = np.sort(s), (y == 0).sum()
    gap = max(k for k in range(1, bad + 1) if ranked[k] - ranked[k - 1] >= quality.GAP)
    assert model["t"] == pytest.approx((ranked[gap] + ranked[gap - 1]) / 2)
    for k in range(120):
        v = np.clip((one(rows[k][1]) - model["mean"]) / model["sd"], -6, 6)
        want = 1 / (1 + np.exp(-np.clip(np.concatenate([v, v * v / 3]) @ model["w"] - model["t"], -30, 30)))
        assert got[k].score == pytest.approx(want, abs=1e-9) and got[k].held_out == (crc(k) % 3 == 1) and got[k].predicted == int(want >= 0.5)


@pytest.mark.parametrize("size", [1, 7, 120])
def test_quality_does_not_depend_on_batches(size):
    """Same bits whatever rows share a batch, for the texts that the threshold was laid between too."""
    rng = random.Random(23)
    texts = [prose(rng, rng.randint(3, 90)) + "!" * (k % 9) for k in range(120)]
    x = np.concatenate([quality.features(w) for w in words.slices(pa.array(texts))])
    model = quality.learn(x, np.array([k % 2 for k in range(120)]), 0.5)
    every = quality.probability(model, x)
    parts = [quality.probability(model, quality.features(w)) for k in range(0, 120, size) for w in words.slices(pa.array(texts[k : k + size]))]
    assert np.concatenate(parts).tolist() == every.tolist()
    assert np.abs(every - 0.5).min() > 1e-8


def test_toxic_document_scores_equal_a_plain_version():
    """A document's score and spans from marginals by enumeration of all state sequences."""
    rng = random.Random(22)
    texts = [prose(rng, 9) + (" vile slur here" if k % 2 else " kind word here") for k in range(60)]
    y = np.array([k % 2 for k in range(60)])
    model = toxicity.train(pa.array(texts), y, 0.5)

    class Shared:
        value = model

    got = toxicity._tagger(Shared)(pa.array(texts[:6])).to_pylist()
    for text, row in zip(texts, got, strict=False):
        t = toxicity.Tokens(next(words.slices(pa.array([text]), lower=True)))
        who, what = toxicity._feature_ids(t, model["vocab"], model["gate"])
        e = np.full(len(t.starts), model["b"])
        np.add.at(e, who, model["w"][what])
        total, mean = 0.0, np.zeros(len(e))
        for states in itertools.product((0, 1), repeat=len(e)):
            s = model["start"][states[0]] * np.exp(np.dot(e, states)) * np.prod([model["move"][a, b] for a, b in itertools.pairwise(states)])
            total, mean = total + s, mean + s * np.array(states)
        p = mean / total
        m, sd, u, c = model["doc"]
        x = np.array([np.log1p(p.sum()), min(p.sum(), 3), p.max(), np.sqrt(p.sum() / len(p))])
        assert row["score"] == pytest.approx(1 / (1 + np.exp(-((x - m) / sd @ u + c))), abs=1e-6)
        ends = np.cumsum([len(w) + 1 for w in text.split(" ")])
        assert [(s["start"], s["end"]) for s in row["spans"]] == [(int(ends[k] - 1 - len(w)), int(ends[k] - 1)) for k, w in enumerate(text.split(" ")) if p[k] >= 0.5]


def test_language_equals_plain_compression(spark):
    """Each text goes to the dictionary with which plain zstandard makes the smallest pieces."""
    import zstandard

    rng = random.Random(23)
    known = {lang: [prose(rng, 1) for _ in range(120)] for lang in ("aa", "bb", "cc")}
    rows = [(k, " ".join(rng.choice(known[lang]) for _ in range(rng.randint(5, 600))), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 20)]
    contents = langid.dictionaries([{"text": t, "label": lang} for k, t, lang in rows if crc(k) % 4 != 2])

    class Shared:
        value = contents

    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["id", "text"])
    got = [r["lang_pred"] for b in langid._classifier(Shared)([batch]) for r in b.to_pylist()]
    for (_, text, _), pred in zip(rows, got, strict=True):
        sizes = {}
        for lang, raw in contents.items():
            made = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False)
            data, size = text.lower().encode(), 0
            while data:
                end = len(data) if len(data) <= langid.PIECE else data.rfind(b" ", 1, langid.PIECE) + 1
                size += len(made.compress(data[:end]))
                data = data[end:]
            sizes[lang] = size
        assert sizes[pred] == min(sizes.values())


def test_quality_learns_from_every_labelled_row(spark):
    """More rows of a label than a sample once took, equal to a plain version over all of them."""
    rng = random.Random(31)
    rows = [(k, prose(rng, rng.randint(1, 6)) + "!" * rng.randint(0, 3 if k % 4 else 9)) for k in range(9000)]
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(9000)], "doc_id bigint, quality int")
    got = {r.doc_id: r.score for r in quality.rank_quality(frame(spark, rows), labels).collect()}
    x = np.concatenate([quality.features(w) for w in words.slices(pa.array([t for _, t in rows]))])
    learned = np.array([crc(k) % 3 != 1 for k in range(9000)])
    y = (np.arange(9000) % 4 > 0).astype(int)[learned]
    model = quality.learn(x[learned], y, (y == 0).mean())
    assert sum(model["n"].values()) == learned.sum() and model["n"][1] > 4000
    assert np.allclose([got[k] for k in range(9000)], quality.probability(model, x), rtol=0, atol=1e-9)
