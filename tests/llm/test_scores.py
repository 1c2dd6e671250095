"""Language and quality scores against plain versions, one word and one character at a time."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from hashloom.llm import langid, quality, textbuf as tb

MASK = (1 << 64) - 1
SYLLABLES = {"aa": ["ka", "lo", "mi", "tun"], "bb": ["été", "çon", "eau", "lo"], "cc": ["ПРИ", "вет", "мир", "да"], "dd": ["漢", "字", "語", "学"]}


def mix(low, high):
    h = low * 0x9E3779B97F4A7C15 & MASK
    h ^= h >> 29
    h = (h + high & MASK) * 0xC2B2AE3D27D4EB4F & MASK
    return h ^ h >> 32


def word_hash(word):
    low, high = int.from_bytes(word[:8], "little"), int.from_bytes(word[8:15], "little") | min(len(word), 255) << 56
    h = mix(low, high)
    for k in range(15, len(word), 8):
        h = mix(h, int.from_bytes(word[k : k + 8], "little"))
    return h


def corpus(n, seed):
    r = random.Random(seed)
    docs = []
    for i in range(n):
        lang = r.choice(sorted(SYLLABLES))
        make = lambda: "".join(r.choices(SYLLABLES[lang], k=r.randint(1, 9)))
        docs.append((i, r.choice([" ", ", ", " 12 "]).join(make() for _ in range(r.randint(1, 12))), lang if r.random() < 0.8 else None))
    return docs + [(n, "Ünïcode ÉTÉ mixed ka", "bb"), (n + 1, None, "aa"), (n + 2, "123 !", "aa"), (n + 3, "ka " * 50, None)]


def plain_language(docs):
    """(language, score) by a dictionary of counts."""
    words = lambda t: re.findall(r"[a-z\x80-\U0010ffff]+", t.lower())
    ends = lambda w, i, n: ("_" + w)[i + 1 - n : i + 1] if i + 1 >= n else None  # noqa: E731  the n-gram that ends at place i of the marked word
    counts = {n: {} for n in range(5)}
    for i, text, lang in docs:
        if lang and zlib.crc32(str(i).encode()) % 3 != 1:
            for w in words(text or ""):
                counts[0].setdefault(w, Counter())[lang] += 1
                for n in (1, 2, 3, 4):
                    for at in range(1, len(w) + 1):
                        if g := ends(w, at, n):
                            counts[n].setdefault(g, Counter())[lang] += 1
    langs = sorted({x for c in counts[0].values() for x in c})
    total = {n: {x: sum(c[x] for c in counts[n].values()) for x in langs} for n in counts}
    logs = lambda n, key: [math.log((counts[n][key][x] + 0.5) / (total[n][x] + 0.5 * len(counts[n]) + 1)) for x in langs]
    out = {}
    for i, text, _ in docs:
        if not re.search(r"[^\W\d_]", text or ""):
            out[i] = ("und", 0.0)
            continue
        sums = np.zeros(len(langs))
        for w in words(text):
            if w in counts[0]:
                sums += logs(0, w)
                continue
            for at in range(1, len(w) + 1):
                known = next((g for n in (4, 3, 2, 1) if (g := ends(w, at, n)) in counts[n]), None)
                if known:
                    sums += langid.BACKOFF * np.array(logs(len(known), known)) / len(w)
        share = np.exp(sums - sums.max())
        out[i] = (langs[int(sums.argmax())], float(share.max() / share.sum()))
    return out


def test_language_scores(spark):
    docs = corpus(300, 3)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    want = plain_language(docs)
    assert {i: p for i, (p, _) in got.items()} == {i: p for i, (p, _) in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1], abs=1e-4) for i in want)


def test_long_words_differ_in_every_byte():
    same = ["internationalisation", "internationalisatXYZ", "непревзойдённостью1", "непревзойдённостью2", "a" * 40 + "b", "a" * 40 + "c"]
    column = pa.array(same)
    at, doc = quality.features(column)
    assert len({at[doc == k][0] for k in range(len(same))}) == len(same)
    pad, begin, end, _ = langid.words(column)
    assert tb.word_hashes(tb.words64(pad), begin, end - begin).tolist() == [word_hash(re.match(r"\D+", w)[0].lower().encode()) for w in same]


def test_words_known_only_by_their_ends(spark):
    stem = "непревзойдённ"
    docs = [(i, f"{stem}{'остью' if i % 2 else 'остями'}", "xy"[i % 2]) for i in range(60)]
    got = langid.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()
    assert all(r.lang_pred == "xy"[r.doc_id % 2] for r in got)


def plain_features(text):
    kinds = [1 if c.isascii() and c.isalnum() or not c.isascii() else 2 if 0x20 < ord(c) < 0x7F else 0 for c in text]
    words, k = [], 0
    while k < len(text):
        e = k
        while e < len(text) and kinds[e] == kinds[k]:
            e += 1
        if kinds[k]:
            words.append(word_hash(text[k:e].encode()))
        k = e
    pairs = [mix(0x5EED, 0x5EED) if a == b else mix(a, b ^ 0xABCDEF) for a, b in zip(words, words[1:])]
    return Counter(h >> 64 - quality.BITS for h in words + pairs)


def plain_quality(docs, labels):
    """Scores by FTRL-proximal updates of a dictionary of weights."""
    label = {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 4 != 2}
    rows = sorted(((zlib.crc32(str(i).encode()), str(i), t, label[i]) for i, t in docs if i in label), key=lambda r: r[:2])
    z, n = Counter(), Counter()
    weight = lambda k: 0.0 if abs(z[k]) <= quality.L1 else -(z[k] - math.copysign(quality.L1, z[k])) / ((quality.BETA + math.sqrt(n[k])) / quality.ALPHA + quality.L2)
    bias = lambda: -z[None] / ((quality.BETA + math.sqrt(n[None])) / quality.ALPHA)
    values = lambda t: {k: quality.SCALE * c / sum(f.values()) for k, c in f.items()} if (f := plain_features(t or "")) else {}
    for _ in range(quality.EPOCHS):
        for _, _, text, y in rows:
            x = values(text)
            w, b = {k: weight(k) for k in x}, bias()
            p = 1 / (1 + math.exp(-sum(w[k] * x[k] for k in x) - b))
            for k, v, own in [(k, v, w[k]) for k, v in x.items()] + [(None, 1.0, b)]:
                g = (p - y) * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / quality.ALPHA * own
                n[k] += g * g
    return {i: 1 / (1 + math.exp(-sum(weight(k) * v for k, v in values(t).items()) - bias())) for i, t in docs}


def test_quality_scores(spark):
    r = random.Random(5)
    good, bad = ["clear", "written", "prose", "internationalisation", "ясный"], ["click", "!!!", "buy", "$$", "internationalisatXYZ"]
    docs = [(i, " ".join(r.choices((good, bad)[i % 2] + ["the", "of"], k=r.randint(1, 25)))) for i in range(160)] + [(500, None), (501, "")]
    labels = [(i, 1 - i % 2) for i in range(160)]
    got = quality.score(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    want = plain_quality(docs, labels)
    assert all(x.score == pytest.approx(want[x.doc_id], abs=1e-4) and x.predicted == (x.score >= 0.7) for x in got) and len(got) == len(want)
