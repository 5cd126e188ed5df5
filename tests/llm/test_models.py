from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from echotide.llm import language, quality

SMALL = quality.Settings(epochs=6, sample_docs=400)


def text(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(rng, n):
    good = ["the", "an", "er", "on", "re", "th"]
    rows = []
    for i in range(n):
        t = text(rng, good, rng.randint(20, 200))
        if i % 4 == 0:
            t = t.replace(" ", " %%% | ")
        rows.append((i, t, int(i % 4 != 0)))
    return rows


def test_quality_on_held_out_rows(spark):
    rows = corpus(random.Random(1), 400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5] + [(None, 1), (3, None), (9999, 0)], "doc_id bigint, quality int")
    network = quality.train(docs, labels, settings=SMALL)
    got = {r.doc_id: r.quality_score for r in quality.score(docs, network).collect()}
    held = [(got[i] >= 0.5) == bool(y) for i, _, y in rows if i % 5 == 0]
    assert np.mean(held) > 0.95


def test_chunks_cover_whole_texts():
    s = quality.Settings()
    data = "".join(chr(97 + i % 26) for i in range(5000))
    for n in (0, 1, 255, 256, 257, 448, 449, 5000):
        chunks = quality.chunks_of(data[:n], s)
        assert len(set(data[:n])) == len(set(chunks.ravel().tolist()) - {256})
        assert chunks.shape[1] == s.chunk and bytes(chunks[-1][chunks[-1] < 256].astype(np.uint8)).decode() == data[:n][-256:]


def test_gradients():
    s = quality.Settings(filters=3, hidden=2, embed=2, block=2)
    net = quality.Network(s)
    net.begin()
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    docs = [quality.chunks_of(t, s) for t in ("hello " * 80, "x", "%%| " * 100)]
    y, w = np.array([1.0, 0.0, 1.0]), np.ones(3)

    def loss():
        p = np.array([net.head(np.concatenate([f.mean(axis=0), f.max(axis=0)])) for f in map(pooled, docs)])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    def pooled(c):
        return np.maximum((net.windows(c) @ net.weights["conv"]).max(axis=1) + net.weights["conv_b"], 0)

    grads = net._gradients(docs, y, w)
    for name in ("conv", "hid", "embed", "out"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        held, step = net.weights[name][at], 1e-5
        net.weights[name][at] = held + step
        up = loss()
        net.weights[name][at] = held - step
        down = loss()
        net.weights[name][at] = held
        assert abs((up - down) / (2 * step) - grads[name][at]) < 1e-3


def test_quality_edges(spark, docs, no_docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    network = quality.train(docs, labels)
    assert {r.quality_score for r in quality.score(docs, network).collect()} == {0.5}
    assert quality.score(docs, network).columns == [*docs.columns, "quality_score"]
    trained = quality.Network(SMALL).fit([(t, y) for _, t, y in corpus(random.Random(2), 40)])
    assert all(0 <= r.quality_score <= 1 for r in quality.score(docs, trained).collect())
    assert quality.score(no_docs, trained).count() == 0


SOUNDS = {"aa": ["the", "an", "er"], "bb": ["sch", "ung", "ein"], "cc": ["ción", "os", "lla"]}


def test_language_on_held_out_rows(spark):
    rng = random.Random(3)
    rows = [(i, text(rng, SOUNDS[lang], rng.randint(10, 80)), lang) for i in range(150) for lang in [sorted(SOUNDS)[i % 3]]]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, " 12 %% ", "cc"), (903, text(rng, SOUNDS["cc"], 20000), None), (904, "ß", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    contents = language.train(docs, learn=F.col("doc_id") % 4 != 2)
    assert sorted(contents) == sorted(SOUNDS)
    got = {r.doc_id: r for r in language.identify(docs, contents).collect()}
    held = [got[i].lang_pred == lang for i, _, lang in rows[:150] if i % 4 == 2]
    assert np.mean(held) > 0.95
    numbers = spark.createDataFrame([(k, c) for k, c in enumerate("½²①Ⅷ٣_")] + [(9, "½ Ⅷ ² a")], "doc_id bigint, text string")
    odd = {r.doc_id: r.lang_pred for r in language.identify(numbers, contents).collect()}
    assert [odd[k] for k in range(6)] == ["und"] * 6 and odd[9] in contents
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "cc"]
    assert got[904].lang_pred in contents and all(0 <= r.score <= 1 for r in got.values())


def test_language_edges(docs, no_docs):
    assert language.train(no_docs) == {}
    assert {r.lang_pred for r in language.identify(docs, {}).collect()} == {"und"}
    assert language.identify(no_docs, {"aa": b"some words here"}).count() == 0


def test_score_equals_a_plain_network():
    """The blocked, pooled score against loops over chunks, places and filters."""
    s = quality.Settings(filters=4, hidden=3, embed=3, width=5, stride=3, chunk=40, step=30, block=2)
    net = quality.Network(s)
    net.begin()
    w = net.weights
    for text in ("", "short", "longer text with é and more " * 9):
        data = list(text.encode())
        if len(data) < s.chunk:
            chunks = [data + [256] * (s.chunk - len(data))]
        else:
            starts = sorted({*range(0, len(data) - s.chunk, s.step), len(data) - s.chunk})
            chunks = [data[a : a + s.chunk] for a in starts]
        pooled = []
        for c in chunks:
            best = []
            for f in range(s.filters):
                sums = [
                    sum(float(w["embed"][c[p + k]][e]) * float(w["conv"][k * s.embed + e][f]) for k in range(s.width) for e in range(s.embed))
                    for p in range(0, s.chunk - s.width + 1, s.stride)
                ]
                best.append(max(0.0, max(sums) + float(w["conv_b"][f])))
            pooled.append(best)
        features = [*np.mean(pooled, axis=0), *np.max(pooled, axis=0)]
        hidden = np.maximum(np.array(features) @ w["hid"] + w["hid_b"], 0)
        assert abs(net.score(text) - 1 / (1 + np.exp(-(hidden @ w["out"] + w["out_b"])))) < 1e-5


def test_training_sees_the_end_of_long_texts(spark):
    rng = random.Random(4)
    rows = [(i, text(rng, ["th", "er"], 900) + (" %%% |" * 60 if i % 2 else "")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows if i % 5], "doc_id bigint, quality int")
    network = quality.train(docs, labels, settings=quality.Settings(epochs=12, sample_docs=100))
    assert all((network.score(t) >= 0.5) == bool(i % 2) for i, t in rows if i % 5 == 0)


def test_predictions_follow_the_least_compressed_size():
    import zstandard

    contents = {"aa": b"the answer there and then " * 30, "bb": b"eine schoene rechnung ohne ende " * 30}
    model = language.Dictionaries(contents, 6, 1000)
    for said in ("then there the answer and", "ohne ende schoene rechnung " * 200, "zzz", "The  ANSWER, 42"):
        data = language.folded(said)
        sizes = {}
        for lang, content in contents.items():
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            one = zstandard.ZstdCompressor(level=6, dict_data=held, write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(one.compress(data[i : i + 1000])) for i in range(0, len(data), 1000))
        assert model.sizes(data) == sizes
        assert model.predict(said, 0.01)[0] == min(sizes, key=lambda k: (sizes[k], k))


def test_language_sample_is_bounded_and_spread(spark):
    """At most ``sample_docs`` texts of a language; long ones are read over their whole length."""
    rows = [(i, f"w{'x' * (i % 7)} " * 20, "aa") for i in range(300)] + [(1000 + i, "start " * 9000 + "finish " * 9000, "bb") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    contents = language.train(docs, sample_docs=10, dictionary=4096)
    assert 0 < len(contents["aa"]) <= 10 * 200 and len(contents["bb"]) <= 4096
    assert b"start" in contents["bb"] and b"finish" in contents["bb"]
