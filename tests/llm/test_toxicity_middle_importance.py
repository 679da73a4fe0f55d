import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tapeloom.llm import fill_middle, importance, toxicity

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def folded(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def drawn(rows, target, buckets, min_words, percent, seed):
    """resample() in plain Python: {position: (doc_id, n_features, weight, score, rank)}."""
    count = lambda texts: Counter(zlib.crc32(w.encode()) % buckets for t in texts for w in folded(t))
    s, t = count([r[1] for r in rows]), count(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * float(all_s + buckets) / ((s[b] + 1) * float(all_t + buckets)))) for b in range(buckets)]
    found = []
    for doc_id, text, *_ in rows:
        words = folded(text)
        weight = sum(gain[zlib.crc32(w.encode()) % buckets] for w in words)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        found.append([doc_id, len(words), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((f for f in found if f[1] >= min_words), key=lambda f: (-f[3], f[0] is None, f[0] or 0))
    for k, f in enumerate(able[: percent * len(able) // 100]):
        f[4] = k + 1
    return found


@pytest.mark.parametrize("percent", [0, 10, 37, 100])
def test_resample_matches_plain_python(spark, docs, corpus, percent):
    target = ["the of and in", "Ünïcode 日本語 text 12ab", None, "er an th"]
    got = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), buckets=97, min_words=5, percent=percent).collect()
    want = drawn(corpus, target, 97, 5, percent, importance.SEED)
    order = lambda rows: sorted(map(tuple, rows), key=lambda r: tuple((v is None, v or 0) for v in r))
    assert order(got) == order(want)


def test_resample_of_nothing(spark, nothing, docs):
    assert importance.resample(nothing, docs).count() == 0
    assert importance.resample(docs, nothing).count() == docs.count()


def test_kth_key_finds_every_position(spark):
    draw = random.Random(2)
    rows = [(draw.choice([-(1 << 62), -5, -5, 0, 7, 1 << 62]), draw.randint(-9, 9), i) for i in range(60)]
    df = spark.createDataFrame(rows, "a long, b long, c long")
    for k in (1, 2, 30, 59, 60):
        assert tuple(importance.kth_key(df, ["a", "b", "c"], k)) == sorted(rows)[k - 1]
    assert importance.kth_key(df, ["a", "b", "c"], 61) is None and importance.kth_key(df, ["a"], 0) is None


def test_words_across_pieces(monkeypatch):
    text = "ab cd-EF " * 40 + "日本 x1"
    whole = [b for part in importance.feature_buckets(text, 1000) for b in part]
    monkeypatch.setattr(importance, "PIECE", 7)
    assert [b for part in importance.feature_buckets(text, 1000) for b in part] == whole


def cut(doc_id, text, seed=1):
    """fill_in_middle() in plain Python."""
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(tokens), "plain", None, None, text, text
    if h4 % 100 < 20:
        return doc_id, len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


@pytest.mark.parametrize("pieces", [False, True])
def test_fill_in_middle_matches_plain_python(spark, docs, corpus, pieces, monkeypatch):
    odd = [(1000 + i, t, "en", "s", 0) for i, t in enumerate(["<", "<P", "a<S>b", "x <M", "<<S", "a\nb\x00c", "é" * 50, "ab" * 4000, "1" * 3000, *(f"{'<' * i} a<b S> {i}" for i in range(40))])]
    rows = [*corpus, *odd]
    given = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted((cut(r[0], r[1]) for r in rows), key=str)
    if pieces:  # run here, where the sizes can be changed
        monkeypatch.setattr(fill_middle, "PIECE", 64)
        monkeypatch.setattr(fill_middle, "BATCH", 200)
        import pyarrow as pa

        ids, texts = pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] or "" for r in rows])
        n, form, p, m, out = (c.to_pylist() for c in fill_middle.transform(fill_middle.database(), ids, texts, 1))
        assert sorted(((i, *x[:4], x[4], t or "") for (i, t, *_), x in zip(rows, zip(n, form, p, m, out, strict=True), strict=True)), key=str) == want
    else:
        got = fill_middle.restore(fill_middle.fill_in_middle(given)).collect()
        assert sorted(map(tuple, got), key=str) == want


def test_fill_in_middle_of_nothing_and_restored_nulls(spark, nothing):
    assert fill_middle.restore(fill_middle.fill_in_middle(nothing)).count() == 0
    assert [r.text for r in fill_middle.restore(spark.createDataFrame([(None, "psm", "x"), ("a", None, "x")], "fim_text string, form string, text string")).collect()] == [None, None]


def toxic_corpus(n):
    """Texts of made-up words; every third has some words with a root that no other text has."""
    draw = random.Random(9)
    syllables = "the of and in ou er an th re ti on at en nd st es ing ed is it al ar".split()
    word = lambda: "".join(draw.choice(syllables) for _ in range(draw.randint(1, 4)))
    rows = []
    for i in range(n):
        words, bad = [word() for _ in range(draw.randint(8, 120))], i % 3 == 0
        for _ in range(max(2, len(words) // 30) if bad else 0):
            words[draw.randrange(len(words))] = draw.choice(["vexquo", "glimzak"]) + draw.choice(syllables)
        rows.append((i, " ".join(words), int(bad)))
    return rows


@pytest.fixture(scope="module")
def toxic_model(spark):
    rows = toxic_corpus(900)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows] + [(None, 1, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    return rows, docs, labels, toxicity.fit(docs, labels)


def test_toxic_texts_are_found_and_others_are_not(toxic_model):
    rows, docs, _, model = toxic_model
    held = {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2}
    found = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    caught = [found[i] for i, _, y in rows if y and i in held]
    wrong = [found[i] for i, _, y in rows if not y and i in held]
    assert sum(caught) / len(caught) > 0.9 and sum(wrong) / len(wrong) < 0.05


def test_held_out_labels_are_never_read(spark, toxic_model):
    rows, docs, labels, model = toxic_model
    turned = labels.withColumn("toxic", F.when(toxicity.remainder(4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = toxicity.fit(docs, turned)
    assert other.dictionaries == model.dictionaries and (other.evidence == model.evidence).all() and other.prior == model.prior


def test_scores_of_odd_rows(spark, docs, corpus, nothing, toxic_model):
    model = toxic_model[3]
    found = toxicity.score(docs, model).collect()
    assert len(found) == len(corpus) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    empty = {round(r.score, 12) for r in found if not r.text}
    assert empty == {round(1 / (1 + math.exp(-model.prior)), 12)}
    assert toxicity.score(nothing, model).count() == 0
    assert toxicity.fit(nothing, spark.createDataFrame([], "doc_id long, toxic int")) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}


def test_windows_of_a_long_text(monkeypatch):
    text = "Ab cd " * 500 + "x" * 200 + " ÉÉ 日本"
    whole = toxicity.windows(text)
    monkeypatch.setattr(toxicity, "PIECE", 10)
    assert toxicity.windows(text) == whole and b" ab " in whole and max(map(len, whole)) <= toxicity.WINDOW + 2
