"""Operators on documents against brute force over a small corpus full of edge cases."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeloom.llm import exact_dedup, language_id, lm_score, mixing, quality_rules, sentencepiece_codec, simhash_dedup, suffix_dedup
from tapeloom.llm.components import components

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def got(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


# ---- exact dedup ----


@pytest.mark.parametrize("k,phi", [(1000, 1 / 500), (3, 0.5), (40, 1 / 30)])
def test_exact_dedup(docs, corpus, k, phi):
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    groups = collections.defaultdict(list)
    for i, t, *_ in corpus:
        groups[norm(t)].append((-len(t or ""), i is None, i if i is not None else 0))
    want = collections.Counter()
    for i, t, *_ in corpus:
        g = groups[norm(t)]
        keep = min(g)
        keep = None if keep[1] else keep[2]
        want[i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()] += 1
    assert got(exact_dedup.exact_dedup(docs, k, phi), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want


@given(st.lists(st.integers(0, 30), max_size=300), st.integers(1, 10), st.integers(1, 50))
@settings(max_examples=60, deadline=None)
def test_misra_gries_misses_no_frequent_key(keys, k, batch):
    import pandas as pd

    counters = pd.Series(dtype="int64")
    for at in range(0, len(keys), batch):
        counters = exact_dedup.misra_gries(counters, pd.Series(keys[at : at + batch]).value_counts(), k)
    assert len(counters) <= k
    for key, n in collections.Counter(keys).items():
        assert counters.get(key, 0) <= n
        assert n - counters.get(key, 0) <= len(keys) / (k + 1)


# ---- quality rules ----


def base_rules(text):
    t = text or ""
    ws = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
    windows = collections.Counter(zip(ws, ws[1:], ws[2:], strict=False))
    covered = {j for i, w in enumerate(zip(ws, ws[1:], ws[2:], strict=False)) if windows[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, corpus):
    want = collections.Counter()
    for i, t, *_ in corpus:
        n, *rest = base_rules(t)
        want[i, n, *rest, n < 50 or 100 * rest[3] > 50 * n] += 1
    out = quality_rules.quality_rules(docs)
    assert got(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert all(not r.kept or not r.base_failed for r in out.collect())


def test_policies_and_ablations_come_from_the_ledger(docs):
    book = quality_rules.ledger(docs)
    rows = book.collect()
    for policy, rules in quality_rules.POLICIES.items():
        mask = quality_rules.mask(policy)
        found = {r.rule: (r.n_failed, r.n_only) for r in quality_rules.ablations(book, policy).collect()}
        assert found == {n: (sum(bool(r.failed & quality_rules.BIT[n]) for r in rows), sum(r.failed & mask == quality_rules.BIT[n] for r in rows)) for n in rules}
        assert sum(r.kept for r in quality_rules.judged(book, policy).collect()) == sum(not r.failed & (mask | quality_rules.mask("base")) for r in rows)


def test_quality_rules_run_no_python(docs):
    assert not re.search("Python|Pandas|Arrow", quality_rules.quality_rules(docs)._jdf.queryExecution().executedPlan().toString())


# ---- SimHash ----


def simhash(text):
    ws = (text or "").encode().translate(LOWER).split()
    if not ws:
        return 0
    sh = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [b" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_groups(docs, corpus):
    fps = [simhash(t) for _, t, *_ in corpus]
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for i, (d, *_) in enumerate(corpus):
        least.setdefault(find(i), []).append(d)
    want = collections.Counter((d, f"{fps[i]:016x}", min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, *_) in enumerate(corpus))
    assert got(simhash_dedup.simhash_groups(docs), "doc_id", "fingerprint", "component_id") == want


def test_anchors_join_all_pairs_within_the_threshold():
    draw = np.random.default_rng(3)
    x = draw.integers(0, 2**63, 400, dtype=np.uint64) << np.uint64(1)
    y = x.copy()
    for i in range(len(x)):
        for b in draw.choice(64, i % 3, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    homes = {}
    index, anchor, home = simhash_dedup.anchors(x.view(np.int64))
    for i, a in zip(index[home], anchor[home], strict=True):
        assert homes.setdefault(i, a) == a  # one home each
    index, anchor, _ = simhash_dedup.anchors(y.view(np.int64))
    visits = set(zip(index.tolist(), anchor.tolist(), strict=True))
    assert len(homes) == len(x) and all((i, a) in visits for i, a in homes.items())


def test_links_of_dense_clusters(spark):
    draw = np.random.default_rng(4)
    fps = {0}
    while len(fps) < 120:
        fps.add(int(draw.choice(list(fps))) ^ 1 << int(draw.integers(0, 64)))
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    found = {tuple(r) for r in simhash_dedup.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    assert found == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 2}


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(50)], [(0, i) for i in range(1, 60)], [(3, 1), (1, 3), (2, 2), (9, 8), (8, 7), (1, 0)], []])
def test_components(spark, edges):
    import itertools

    root = {}
    for a, b in edges:
        if a != b:
            for x in (a, b):
                root.setdefault(x, {x})
            both = root[a] | root[b]
            for x in both:
                root[x] = both
    assert got(components(spark.createDataFrame(edges, "a long, b long")), "node", "root") == collections.Counter((x, min(s)) for x, s in root.items())
    assert itertools


# ---- repeated byte strings ----


def test_repeats_against_counting():
    draw = np.random.default_rng(1)
    for span in (2, 3, 5, 9, 40):
        for _ in range(25):
            parts = [bytes(draw.integers(1, 3, draw.integers(0, 60)).astype(np.uint8)) for _ in range(5)]
            b = b"\0" + b"\0".join(parts) + b"\0"
            weight = draw.integers(1, 3, len(b)) if span % 2 else np.ones(len(b), int)
            found = suffix_dedup.repeats(np.frombuffer(b, np.uint8), span, weight)
            n = collections.Counter()
            for i in range(len(b) - span + 1):
                n[b[i : i + span]] += weight[i]
            assert all(found[i] == (n[b[i : i + span]] > 1) for i in range(len(b) - span + 1) if 0 not in b[i : i + span])


def removed(texts, span=200):
    n = collections.Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    for t in texts:
        cover = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - span + 1):
            if n[t[i : i + span]] > 1:
                cover[i] += 1
                cover[i + span] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        yield len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("group_bytes,block,part", [(2 << 20, 8 << 20, 32 << 20), (2 << 20, 1 << 15, 1 << 14), (1500, 1 << 15, 1 << 14), (0, 1 << 12, 1 << 15)])
def test_repeated_spans(docs, corpus, group_bytes, block, part, monkeypatch):
    """With few bytes to a group, anchors are cut into ranges of windows, at last into single windows."""
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", group_bytes)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", part)
    want = collections.Counter((i, *r) for (i, *_), r in zip(corpus, removed([(t or "").encode() for _, t, *_ in corpus]), strict=True))
    assert got(suffix_dedup.repeated_spans(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def spans_of(texts, pieces=None):
    """The passes over one block without Spark: (bytes removed, windows that a transform found)."""
    import pandas as pd

    import zstandard

    block = pd.DataFrame({"block": [0], "doc_id": [list(map(str, range(len(texts))))], "sizes": [[len(t) for t in texts]], "blob": [zstandard.ZstdCompressor().compress(b"".join(texts))]})
    known = pd.concat(suffix_dedup.summed(pd.DataFrame([{"block": 0, **x}])) for x in suffix_dedup.hash_block(texts, 3))
    sent = suffix_dedup.sort_block(3)(block, known)
    copies, members = sent[sent["data"].notna()], sent[sent["data"].isna()]
    found = suffix_dedup.compare(copies)
    return suffix_dedup.finish(block, members.merge(found, on=["anchor", "whole"])), found


def test_nothing_is_removed_that_the_transform_did_not_find(corpus, monkeypatch):
    texts = [(t or "").encode() for _, t, *_ in corpus]
    out, found = spans_of(texts)
    assert [tuple(r)[1:] for r in out.itertuples(index=False)] == list(removed(texts)) and len(found)
    asked = []
    monkeypatch.setattr(suffix_dedup, "repeats", lambda b, span, weight: asked.append(len(b)) or np.zeros(len(b), bool))
    out, found = spans_of(texts)
    assert asked and not len(found) and not out["n_removed"].any()


def test_long_texts_are_hashed_in_stretches(monkeypatch):
    draw = np.random.default_rng(8)
    passage = bytes(draw.integers(97, 123, 700).astype(np.uint8))
    texts = [bytes(draw.integers(97, 123, n).astype(np.uint8)) for n in (5000, 199, 200, 201, 12_000)]
    texts = [texts[0][:2000] + passage + texts[0][2000:], *texts[1:4], passage + texts[4][:4000] + passage + texts[4][4000:]]
    for chunk in (300, 1000, 1 << 19):
        monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", chunk)
        out, _ = spans_of(texts)
        assert [tuple(r)[1:] for r in out.itertuples(index=False)] == list(removed(texts))


# ---- language model ----


def test_lm_base_scores_are_exact(docs, corpus, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 1 << 15)
    toks = [[*(t or "").encode().translate(LOWER).split(), None] for _, t, *_ in corpus]
    rest = [None if i is None else zlib.crc32(str(i).encode()) % 10 for i, *_ in corpus]
    c = collections.Counter(w for t, r in zip(toks, rest, strict=True) if r for w in t)
    n, v = sum(c.values()), len(c)
    want = collections.Counter((i, r == 0, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for (i, *_), r, t in zip(corpus, rest, toks, strict=True))
    rows = lm_score.lm_score(docs).collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score <= 0 and math.isfinite(r.score) for r in rows)


def test_filter_never_reads_less_than_was_put_in():
    draw = np.random.default_rng(2)
    h = lm_score.mix(np.arange(1, 5001, dtype=np.uint64))
    counts = draw.integers(1, 100_000, len(h))
    page = lm_score.page_of(h, counts, lm_score.page_bits(counts))
    levels = lm_score.read_levels(h, page)
    assert (lm_score.least(levels) >= lm_score.VALUES[lm_score.level(counts)]).all() and (lm_score.least(levels) > counts).mean() < 0.01
    assert (lm_score.most(levels) >= counts).all() and (lm_score.most(levels) < 1.3 * counts).mean() > 0.99
    absent = lm_score.read_levels(lm_score.mix(np.arange(10**6, 10**6 + 20_000, dtype=np.uint64)), page)
    assert (absent > 0).mean() < 0.003


def test_levels_of_small_counts_are_exact():
    c = np.arange(0, 9)
    assert (lm_score.least(lm_score.level(c)) == c).all() and (lm_score.most(lm_score.level(c))[:8] == c[:8]).all()
    big = np.array([9, 10, 11, 12, 1000, 10**6, 2**40 + 1])
    assert (lm_score.least(lm_score.level(big)) <= big).all() and (lm_score.most(lm_score.level(big)) >= big).all() and (np.diff(lm_score.VALUES) > 0).all()


def test_page_grows_with_what_it_holds():
    """900,000 levels fill more than half of the 2 ** 22 bits that a page once had, and 3,600,000 nearly all."""
    for n in (300_000, 1_200_000):
        h = lm_score.mix(np.arange(1, n + 1, dtype=np.uint64))
        counts = np.full(n, 3)
        page = lm_score.page_of(h, counts, lm_score.page_bits(counts))
        assert (lm_score.read_levels(h, page) >= 3).all() and (lm_score.read_levels(h, page) > 3).mean() < 0.0025
        assert (lm_score.read_levels(lm_score.mix(np.arange(10**8, 10**8 + 100_000, dtype=np.uint64)), page) > 0).mean() < 0.003


def rounded_down(c):
    return c >> max(0, c.bit_length() - 3) << max(0, c.bit_length() - 3)


def rounded_up(c):
    step = 1 << max(0, c.bit_length() - 3)
    return c // step * step + step - 1


def test_page_is_made_without_a_byte_for_each_bit():
    h = lm_score.mix(np.arange(1, 800_001, dtype=np.uint64))
    counts = np.ones(len(h), np.int64)
    bits = lm_score.page_bits(counts)
    tracemalloc.start()
    page = lm_score.page_of(h, counts, bits)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1 << bits
    plain = np.zeros(1 << bits, bool)
    for at in lm_score.bit_places(h, 1, bits):
        plain[at] = True
    assert (page == np.packbits(plain, bitorder="little")).all()


@pytest.mark.parametrize("keys", [[], [5], [3, 1, 3, 2, 1, 3]])
def test_summed_keys(keys):
    keys = np.array(keys, np.uint64)
    found, which, total = lm_score.summed(keys, np.arange(1, len(keys) + 1, dtype=np.uint32))
    wanted, inverse = np.unique(keys, return_inverse=True)
    assert (found == wanted).all() and (which == inverse).all()
    assert total.tolist() == [int(np.arange(1, len(keys) + 1)[keys == k].sum()) for k in wanted]


def test_lm_scores_are_those_of_quantised_counts(docs, corpus, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 1 << 15)
    monkeypatch.setattr(lm_score, "SEGMENT_BYTES", 1 << 15)
    toks = [[*(t or "").encode().translate(LOWER).split(), None] for _, t, *_ in corpus]
    learned = [t for (i, *_), t in zip(corpus, toks, strict=True) if i is not None and zlib.crc32(str(i).encode()) % 10]
    one, two = collections.Counter(w for t in learned for w in t), collections.Counter(p for t in learned for p in zip([None, *t], t))
    below = sum(one.values()) + 0.1 * (len(one) + 1)

    def score(t):
        for p, w in zip([None, *t], t):
            alone = min((rounded_down(one[w]) + 0.1) / below, 1)
            known = rounded_up(one[p])
            yield math.log10((min(rounded_down(two[p, w]), known) + lm_score.MU * alone) / (known + lm_score.MU))

    want, found = collections.defaultdict(list), collections.defaultdict(list)
    for (i, *_), t in zip(corpus, toks, strict=True):
        want[i, len(t)].append(sum(score(t)))
    for r in lm_score.lm_score(docs).collect():
        found[r.doc_id, r.n_tokens].append(r.score)
    assert want.keys() == found.keys()
    off = [(abs(a - b), n) for (i, n), x in want.items() for a, b in zip(sorted(x), sorted(found[i, n]), strict=True)]
    assert sum(d for d, _ in off) < 0.002 * sum(n for _, n in off)  # but for a level here and there that the filter sees wrongly


def test_probabilities_after_any_word_add_up_to_at_most_one(corpus):
    toks = [[*(t or "").encode().translate(LOWER).split(), None] for _, t, *_ in corpus]
    one, two = collections.Counter(w for t in toks for w in t), collections.Counter(p for t in toks for p in zip([None, *t], t))
    words = list(one)
    level = lambda x: lm_score.level(np.array(x))
    sums = []
    for before in [*words[:200], None, b"never seen"]:
        p = lm_score.probabilities(level([two[before, w] for w in words] + [0]), level([one[before]] * (len(words) + 1)), level([one[w] for w in words] + [0]), sum(one.values()), len(one))
        sums.append(p.sum())
    assert max(sums) <= 1 + 1e-9 and min(sums) > 0.7 and np.mean(sums) > 0.9


@given(st.lists(st.integers(0, 2**64 - 1), max_size=200, unique=True))
@settings(max_examples=50, deadline=None)
def test_short_keys_keep_forty_bits(h):
    keys = np.array(sorted(x % 2**40 for x in h), np.uint64)
    assert (lm_score.long_keys(lm_score.short_keys(keys + np.uint64(5 << 40))) == keys).all()


def test_a_pair_seen_once_is_known():
    import pandas as pd

    sums = pd.DataFrame([{"block": 0, **x} for x in lm_score.count_block([b"never seen twice"], [True], 1)])
    parts = pd.concat(lm_score.add_up(x) for _, x in sums.groupby("seg"))
    levels = np.concatenate([np.frombuffer(x, np.uint8) for x in parts["pair_levels"]])
    assert len(levels) == 4 and (levels >= 1).all()


def test_words_of_long_texts_are_cut_in_pieces(monkeypatch):
    texts = [b"", b"one  two\nthree", b" " * 50 + b"four " * 30 + b"x" * 300 + b" Five", b"six"]
    whole = lm_score.tokens(texts)
    monkeypatch.setattr(lm_score, "PIECE_BYTES", 7)
    cut = lm_score.tokens(texts)
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True)) and np.diff(whole[1]).tolist() == [1, 4, 33, 2]


def test_large_rows_are_row_groups_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 1 << 15)
    draw = random.Random(1)
    rows = [(i, " ".join(f"{draw.getrandbits(60):x}" for _ in range(4000))) for i in range(12)]
    packed, parts, _ = lm_score.counted(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    for table, wide in ((packed, 12), (parts, 2)):
        groups = [pq.ParquetFile(urlparse(f).path).metadata for f in table.inputFiles()]
        assert max(g.num_row_groups for g in groups) >= wide, "few rows of a task make one row group of all it writes"


def test_the_filters_false_chance_is_known(docs):
    assert 0 < lm_score.false_levels(lm_score.counted(docs)[1]).first().false_chance < 0.00056


# ---- language ID ----


def test_language_id_learns_and_flags(spark):
    parts = {"en": "the of and to in is that it was for on with as his they at be this have from".split(), "de": "der die und das ist nicht ein eine zu mit den von sich auf für dem im über schön".split(), "fr": "le la les des est une que pas pour dans qui au avec été où très être français".split()}
    draw = np.random.default_rng(0)
    rows = [(i, " ".join(draw.choice(parts[lang], 30)), lang, "s", 0) for i, lang in enumerate(list(parts) * 60)]
    odd = [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0), (1002, "123 !!", "en", "s", 0), (1003, "mit den", None, "s", 0), (None, "the and", None, None, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in language_id.predict(docs, language_id.trained(docs)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert np.mean([out[r[0]].lang_pred == r[2] for r in held]) > 0.97
    assert [(out[i].lang_pred, out[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert out[1003].lang_pred == "de" and out[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in out.values())


def test_mixed_and_short_texts_are_flagged_and_plain_ones_are_not(spark):
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text is not null and lang is not null")
    model = language_id.trained(texts)
    held = [r for r in texts.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and len(r.text) > 400]
    by = {lang: [r.text for r in held if r.lang == lang] for lang in model.languages}
    one, two = sorted(by, key=lambda k: -len(by[k]))[:2]
    mixed = [a[:200] + " " + b[:200] for a, b in zip(by[one] * 9, by[two], strict=False)][:60]
    rows = [(i, t) for i, t in enumerate([*mixed, *(t[:8] for t in by[one][:40]), *(r.text for r in held)])]
    out = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    flagged = [out[i].ambiguous for i in range(len(rows))]
    n = len(mixed)
    plain = [out[n + 40 + k].lang_pred == r.lang for k, r in enumerate(held)]
    assert np.mean(plain) > 0.98
    assert np.mean(flagged[:n]) > 0.9 and np.mean(flagged[n : n + 40]) > 0.9 and np.mean(flagged[n + 40 :]) < 0.05, (np.mean(flagged[:n]), np.mean(flagged[n + 40 :]))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 8, 20])
def test_codewords_differ_and_use_both_values(n):
    code = language_id.codewords(n)
    assert len({tuple(x) for x in code}) == n and set(np.unique(code)) <= {-1.0, 1.0}
    assert n == 1 or (code.min(0) < code.max(0)).all()


def test_without_labels_nothing_is_known(docs, nothing):
    model = language_id.fit(nothing)
    assert {r.lang_pred for r in language_id.predict(docs, model).collect()} == {"und"}


# ---- SentencePiece ----


def test_encoding_is_the_librarys_unigram_and_decoding_gives_the_text(spark, docs, corpus):
    import sentencepiece
    from unigram_model import as_unigram

    pieces = sentencepiece_codec.load()
    scores = {int(i): float(s) for i, s in zip(pieces.ids, pieces.scores, strict=True)}
    library = sentencepiece.SentencePieceProcessor(model_proto=as_unigram(open(sentencepiece_codec.MODEL, "rb").read(), scores))
    out = sentencepiece_codec.decoded(sentencepiece_codec.encode(docs)).collect()
    assert len(out) == len(corpus)
    for r in out:
        assert r.decoded_text == (r.text or "") and r.n_tokens == len(r.token_ids)
        if r.text and sentencepiece_codec.SPACE_MARK not in r.text and "\x00" not in r.text:
            ids = library.encode(r.text)
            assert sum(scores.get(i, pieces.unknown_score) for i in ids) == pytest.approx(sum(scores.get(i, pieces.unknown_score) for i in r.token_ids))


@pytest.mark.parametrize("alphabet", ["ab", "日本語のを東京", "etaoinshrdlu", "=-_#aeinst", "\x01é"])
def test_long_words_in_stretches_are_those_of_plain_viterbi(alphabet, monkeypatch):
    pieces = sentencepiece_codec.load()
    draw = np.random.default_rng(6)
    for n in (600, 1024, 1025, 3000):
        word = "".join(draw.choice(list(alphabet), n))
        back, ids = sentencepiece_codec.viterbi(sentencepiece_codec.code_points([word]), pieces)
        want, end = [], n
        while end:
            want.append([ids[0, end]] if ids[0, end] >= 0 else pieces.byte_ids[list(word[end - 1].encode())])
            end -= int(back[0, end])
        for stretch, part in ((512, 1 << 17), (64, 256), (7, 21)):
            monkeypatch.setattr(sentencepiece_codec, "STRETCH", stretch)
            monkeypatch.setattr(sentencepiece_codec, "PART", part)
            assert (sentencepiece_codec.encode_long(word, pieces) == np.concatenate(want[::-1])).all()


def test_an_unbroken_line_of_a_million_characters():
    import time

    pieces = sentencepiece_codec.load()
    word = "".join(np.random.default_rng(7).choice(list("日本語のを東京漢字"), 1_000_000))
    at = time.time()
    ids, offsets = sentencepiece_codec.Encoder(pieces).encode([word, "short one"])
    assert time.time() - at < 30 and sentencepiece_codec.decode(ids, offsets, pieces) == [word, "short one"]


# ---- mixing ----


def test_mixture_meets_its_budgets(docs, corpus):
    out = mixing.mix(docs).collect()
    n = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    tokens = collections.Counter()
    for _, t, _, s, _ in corpus:
        tokens[s] += n(t)
    most, least = max(tokens.values()), min(v for v in tokens.values() if v)
    a = max(0.0, 1 - math.log(2) / math.log(most / least))
    mixed = collections.Counter()
    for r in out:
        mixed[r.source] += n(r.text)
    for s, t in tokens.items():
        share = round(most * (t / most) ** a)
        largest = max(n(x[1]) for x in corpus if x[3] == s)
        assert t <= mixed[s] <= share and share - mixed[s] <= largest * 3, s  # whole documents only; repeated rows stand together
    assert set(collections.Counter((r.doc_id, r.text) for r in out)) == {(i, t) for i, t, *_ in corpus}
    assert len({r.mix_order for r in out}) > len(corpus) // 2


def test_columns_of_any_name_and_rows_without_an_id_are_mixed(spark, docs):
    odd = docs.withColumnsRenamed({"kept": "mix_id", "fp": "mix_src", "size": "mix_hash", "data": "mix_passes", "anchor": "mix_row", "block": "src"})
    assert mixing.mix(odd).count() == mixing.mix(docs).count() and set(odd.columns) < {*mixing.mix(odd).columns, "mix_pass"}
    none = spark.createDataFrame([(None, f"text {i}", "s") for i in range(2000)], "doc_id long, text string, source string")
    assert mixing.mix(none).groupBy("mix_block").count().agg({"count": "max"}).first()[0] < 10


def test_entropy_target(docs):
    rows = mixing.mix(docs, budget=100_000, max_repeat=None, entropy_share=0.98).select("source", "mix_weight").distinct().collect()
    w = np.array([r.mix_weight for r in rows])
    assert -(w * np.log(w)).sum() >= 0.98 * np.log(len(w)) - 1e-6 and w.sum() == pytest.approx(1)


def test_mixing_runs_no_python(docs):
    assert not re.search("Python|Pandas|Arrow", mixing.mix(docs)._jdf.queryExecution().executedPlan().toString())


# ---- empty tables ----


@pytest.mark.parametrize("f", [exact_dedup.exact_dedup, quality_rules.quality_rules, simhash_dedup.simhash_groups, suffix_dedup.repeated_spans, lm_score.lm_score, mixing.mix, lambda d: language_id.predict(d, language_id.trained(d)), lambda d: sentencepiece_codec.decoded(sentencepiece_codec.encode(d))])
def test_empty_table(nothing, f):
    assert f(nothing).count() == 0
