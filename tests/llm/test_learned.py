"""Held-out accuracy of the fitted operators, gradients, and the pipeline against brute force."""

import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from hashloom.llm import langid, quality, sampling, secret_scan, textbuf as tb, toxicity, words
from test_exact import brute_contamination

SF = "/root/testdata/sf0.01"


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_language(spark):
    docs, _ = tables(spark)
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98


def test_language_does_not_read_held_out_labels(spark):
    docs, _ = tables(spark)
    mixed = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, "xx").otherwise(F.col("lang")))
    assert langid.identify(docs).exceptAll(langid.identify(mixed)).isEmpty()


def test_quality(spark):
    docs, labels = tables(spark)
    got = quality.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.93


def test_toxicity(spark):
    docs, labels = tables(spark)
    got = toxicity.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.92 and np.mean([r.predicted for r in got if not r.toxic]) < 0.05


def test_sample_of_a_repeated_id_is_bounded(spark):
    """One id with very many rows does not make the sample larger; each of its texts counts once."""
    docs = spark.range(300).selectExpr("id % 2 as doc_id", "concat('text ', id % 50) as text")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    sample = sampling.labelled(docs, labels, "toxic", 20)
    got = sampling.at_most(sample, 20).collect()
    assert len(got) == len({(r.doc_id, r.text) for r in got}) == 20
    assert sampling.at_most(sample, 100).count() == 50


def test_toxicity_gradients():
    texts, toxic = ["foo bar baz idiot x", "foo bar qux", "zap zip zop foo idiot bar"] * 3, np.array([1.0, 0, 1] * 3)
    pad, begin, end, bounds = words.spans(pa.array(texts, pa.large_string()))
    view, size = tb.words64(pad), end - begin
    _, first, number = np.unique(tb.word_hashes(view, begin, size), return_index=True, return_inverse=True)
    none = (np.zeros(0, np.uint64), np.zeros(0, np.float32))
    known = toxicity.Words({"word": none, "prefix": none}, view, begin[first], size[first])
    at, _ = toxicity.windows(bounds, len(number))
    turn = np.append(number, len(first))[at].T.copy()
    mask = (turn != len(first)).astype(np.float32)
    net = {k: v * 2 for k, v in toxicity.initial().items()}

    def loss():
        xs = np.vstack((known.vectors(net), np.zeros((1, toxicity.DIM), np.float32)))
        z = toxicity.logits(toxicity._gates(xs, net) | {}, turn.T, -1, net).astype(float) if mask.all() else None
        if z is None:
            gates = {d: xs @ net[f"x{d}"] + net[f"b{d}"] for d in "fb"}
            z = toxicity.logits(gates, turn.T, len(first), net).astype(float)
        return float((np.log1p(np.exp(z)) - toxic * z).mean())

    x = np.vstack((known.vectors(net), np.zeros((1, toxicity.DIM), np.float32)))
    grad = toxicity.gradients(net, known, x, turn, mask, toxic.astype(np.float32), np.full(9, 1 / 9, np.float32))
    for k in net:
        at_ = np.unravel_index(np.argmax(np.abs(grad[k])), grad[k].shape)
        old = net[k][at_]
        net[k][at_] = old + 0.01
        up = loss()
        net[k][at_] = old - 0.01
        down = loss()
        net[k][at_] = old
        assert abs((up - down) / 0.02 - grad[k][at_]) < 2e-3, k


def test_toxicity_scores():
    """Scores of a fitted model against the network's equations, one word at a time in double precision."""
    r = np.random.default_rng(3)
    texts = [" ".join(r.choice(["foo", "bar", "baz", "qux", "Straße", "internationalisation"] + ["idiot", "idiots"] * (k % 2), r.integers(1, 90))) for k in range(80)]
    model = toxicity.fit(texts, np.array([float("idiot" in t) for t in texts]))
    column = pa.array([*texts, "", None, "idiot"])
    pad, begin, end, bounds = words.spans(column)
    x = toxicity.Words(model["odds"], tb.words64(pad), begin, end - begin).vectors(model["net"]).astype(float)
    net, n = {k: v.astype(float) for k, v in model["net"].items()}, toxicity.HIDDEN
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def states(rows, d):
        h, out = np.zeros(n), []
        for row in rows:
            g, u = row @ net[f"x{d}"] + net[f"b{d}"], h @ net[f"h{d}"]
            z, reset = sigmoid(g[:n] + u[:n]), sigmoid(g[n : 2 * n] + u[n : 2 * n])
            new = np.tanh(g[2 * n :] + reset * u[2 * n :])
            h = z * h + (1 - z) * new
            out.append(h)
        return out

    def window(rows):
        both = np.array([np.concatenate(p) for p in zip(states(rows, "f"), states(rows[::-1], "b")[::-1])])
        a = np.exp(np.tanh(both @ net["wa"]) @ net["va"])
        return float((a / a.sum()) @ both @ net["wo"] + net["bo"][0])

    want = []
    for a, b in zip(bounds, bounds[1:]):
        starts = range(a, max(a + 1, b - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE)
        want.append(sigmoid(max(window(x[k : min(b, k + toxicity.WINDOW)]) for k in starts)) if b > a else model["rate"])
    assert np.allclose(toxicity.Scorer(model).score(column), want, atol=1e-4)
    assert np.mean([(p > 0.5) == ("idiot" in t) for p, t in zip(want, texts)]) > 0.95


def test_windows_cover_every_word():
    bounds = np.array([0, 0, 1, 33, 65, 400])
    at, doc = toxicity.windows(bounds, 400)
    assert set(at[at < 400]) == set(range(400)) and set(doc) == {1, 2, 3, 4}
    assert all((np.diff(at[doc == 4][:, 0]) == toxicity.STRIDE).tolist())


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    states = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, states[-1], SF).write.parquet(f"{tmp_path}/{k}")
        states.append(spark.read.parquet(f"{tmp_path}/{k}"))
    all_ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in states]
    assert all(b <= a for a, b in zip(all_ids, all_ids[1:])) and all(s.columns == docs.columns for s in states[:-1])
    text = [{r.doc_id: r.text for r in s.collect()} for s in states[:-1]]
    assert all(not re.search(r"[^\W\d_]", text[0][i]) for i in all_ids[0] - all_ids[1])
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in text[1].items() if (w := re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()))}
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    kept = [i for i in all_ids[2] if i in shingles]
    by_shingle = {}
    for i in kept:
        for s in shingles[i]:
            by_shingle.setdefault(s, []).append(i)
    assert not any(near(shingles[i], shingles[j]) for i in kept for j in {j for s in shingles[i] for j in by_shingle[s]} if i < j)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = brute_contamination(text[2].items(), items)
    assert all((text[2][i] == text[3].get(i)) == (not hit[i][4]) for i in all_ids[2])
    assert all(hit[i][1] > 0.5 * hit[i][0] for i in all_ids[2] - all_ids[3])
    assert not any(secret_scan._HEX.search(t) or "AKIA" in t and secret_scan._ACCESS.search(t) for t in text[4].values()) and all_ids[3] == all_ids[4]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in states[-1].collect():
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == library.encode(text[4][r.doc_id], add_special_tokens=False).ids
