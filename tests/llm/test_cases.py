"""Every operator on nulls, empty and long texts, repeated rows, clashing names and empty tables."""

import hashlib

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from hashloom.llm import bpe_codec, decontam, langid, ngram_join, quality, secret_scan, suffix_dedup, syncmers, token_counts, toxicity
from hashloom.llm.shared import stored

SF = "/root/testdata/sf0.001"
EMPTY = hashlib.sha256(b"").hexdigest()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k % 11, k % 2, k % 3 // 2) for k in range(40)] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "word"), (2, None), (3, ""), (None, "dolor")], "item_id long, text string")


def operators(items, labels):
    word, byte = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
    return {
        "contamination": lambda d: decontam.contamination(d, items),
        "fingerprints": syncmers.fingerprints,
        "edit_likeness": syncmers.edit_likeness,
        "encode": lambda d: bpe_codec.encode(d, word),
        "digests": lambda d: bpe_codec.digests(d, word),
        "add_tokens": lambda d: bpe_codec.add_tokens(d, word),
        "toxicity": lambda d: toxicity.score(d, labels),
        "count_tokens": lambda d: token_counts.count_tokens(d, byte),
        "scan": secret_scan.scan,
        "redact": secret_scan.redact,
        "remove_repeats": suffix_dedup.remove_repeats,
        "identify": langid.identify,
        "quality": lambda d: quality.score(d, labels),
        "near_links": ngram_join.near_links,
    }


NAMES = list(operators(None, None))


@pytest.mark.parametrize("name", NAMES)
def test_one_row_for_each(name, nasty, empty, items, labels):
    op = operators(items, labels)[name]
    got = op(nasty).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in nasty.collect())
    assert op(empty).count() == 0


def test_anchor_rows(nasty, empty):
    rows = syncmers.positions(nasty).collect()
    assert {r.doc_id for r in rows} <= {r.doc_id for r in nasty.collect()} and {r.position for r in rows if r.doc_id == 5} == {r.position for r in rows if r.doc_id == 6}
    assert syncmers.positions(empty).isEmpty()


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(k, spark, nasty, empty):
    name, stage = corpus_pipeline.STAGES[k]
    got = stage(spark, nasty, SF)
    rows = got.collect()
    assert {r.doc_id for r in rows} <= {r.doc_id for r in nasty.collect()} and stage(spark, empty, SF).isEmpty()
    if name != "tokens":
        assert got.columns == nasty.columns and all({r[c] for r in rows} <= {c} for c in ("n", "id", "score", "label", "rep"))
    ids = sorted(str(r.doc_id) for r in rows)
    if name == "language_id":
        assert not {"1", "2", "3", "7"} & set(ids) and {"4", "5", "6", "8", "None"} <= set(ids)
    if name == "near_duplicates":
        assert ids == sorted(["1", "3", "4", "5", "7", "8", "None", "9", "10"])
    if name in ("decontamination", "secrets", "tokens"):
        assert len(rows) == nasty.count()
    if name == "secrets":
        assert {r.doc_id: r.text for r in rows}[10].endswith("[redacted]") and {r.doc_id: r.text for r in rows}[1] is None
    if name == "tokens":
        assert all((r.n_tokens > 0) == (r.doc_id not in (1, 2, 3)) for r in rows)


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.run(spark, SF).collect()
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
    want = docs.collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in got) == sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in want) and len(got) > 50


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_defined_results(nasty, items, labels):
    op = operators(items, labels)
    found = by_id(op["contamination"](nasty))
    assert (found[1].n_words, found[2].n_words, found[4].n_hit, found[4].n_items) == (0, 0, 1, 1)
    tokens = by_id(op["digests"](nasty))
    assert all((tokens[i].n_tokens, tokens[i].ids_sha256, tokens[i].decoded_sha256) == (0, EMPTY, EMPTY) for i in (1, 2, 3))
    assert by_id(op["count_tokens"](nasty))[10].n_tokens > 2 and by_id(op["count_tokens"](nasty))[1].n_bytes == 0
    prints = by_id(op["fingerprints"](nasty))
    assert prints[1].fingerprint == prints[2].fingerprint and prints[5].fingerprint == prints[6].fingerprint
    gone = by_id(op["remove_repeats"](nasty))
    assert gone[5].n_removed == gone[5].n_bytes and gone[6].n_removed == gone[6].n_bytes and gone[4].n_removed == gone[1].n_removed == 0
    langs = by_id(op["identify"](nasty))
    assert all(langs[i].lang_pred == "und" and langs[i].score == 0 for i in (1, 2, 3, 7))
    links = by_id(op["near_links"](nasty))
    assert links[6].class_id == 5 and links[1].n_links == 0 and links[2].class_id == links[1].class_id == 1
    assert by_id(op["scan"](nasty))[10].n_assign == 1 and by_id(op["scan"](nasty))[1].spans == ""
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in op["toxicity"](nasty).collect())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in op["quality"](nasty).collect())


def test_nothing_to_learn_from(nasty, labels):
    none = labels.where("doc_id < 0")
    assert {r.score for r in toxicity.score(nasty, none).collect()} == {0.0}
    assert {r.score for r in quality.score(nasty, none).collect()} == {0.5}
    assert {r.lang_pred for r in langid.identify(nasty.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_other_id_types(nasty):
    text_ids = nasty.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {r.doc_id for r in secret_scan.scan(text_ids).collect()} == {r.doc_id for r in text_ids.collect()}
