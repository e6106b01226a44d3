"""Operators on whole texts against brute force: scoring, token files, token counts, licences, rules, sampling."""

import collections
import math
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallyframe.llm import brown, isolation, labelled, licenses, resampling, token_files, trie
from tallyframe.llm.common import KEY, keyed
from tallyframe.llm.tokens import Encoder, tokenizer_path
from tests.llm.cases import documents, frame, lower, odd_documents, plain_words, prose, rows, space_words


def test_keys_are_unique_and_ordered(spark):
    plain = keyed(frame(spark, documents()))
    assert [r[KEY] for r in plain.orderBy("doc_id").collect()] == [d for d, _ in documents()]
    odd = keyed(frame(spark, odd_documents())).orderBy(KEY).collect()
    assert len({r[KEY] for r in odd}) == len(odd_documents())
    ids = [r["doc_id"] for r in odd]
    assert ids[-2:] == [None, None] and ids[:-2] == sorted(ids[:-2])


def test_encoder_equals_the_tokenizer():
    import pyarrow as pa

    texts = [t or "" for _, t in odd_documents()] + ["a  b　", " <|endoftext|> x", "don't  'll\r\n", "é,é's ×.", "́a", "x\x85y z"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        plain = Tokenizer.from_file(tokenizer_path(name))
        ids, ends = Encoder(tokenizer_path(name)).encode(pa.array(texts))
        for i, text in enumerate(texts):
            assert ids[ends[i] : ends[i + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("make", [documents, odd_documents, list])
def test_token_files(spark, tmp_path, make):
    docs = make()
    path = str(tmp_path / "tokens")
    token_files.write_tokens(frame(spark, docs, True), path, tokenizer_path("byte_bpe_50k.json"))
    plain = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = sorted((-1 if i is None else i, plain.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in docs)
    back = token_files.read_tokens(spark, path)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["ids"]) for r in rows(back)) == want
    found = rows(token_files.starts(token_files.with_crc(back)))
    at = 0
    for r in sorted(found, key=lambda r: r["seq"]):
        assert r["start"] == at
        at += r["n_tokens"]
    if make is documents:
        crc = {i: zlib.crc32(np.array(x, "<u4").tobytes()) for i, x in want}
        assert {r["doc_id"]: r["ids_crc32"] for r in found} == crc
        some = token_files.find_tokens(spark, path, [12, 999])
        assert [r["doc_id"] for r in rows(some)] == [12]


@pytest.mark.parametrize("make", [documents, odd_documents, list])
def test_brown_scores(spark, make):
    docs = make()
    found = rows(brown.score(keyed(frame(spark, docs, True)), rounds=2, share=1e-3))
    assert len(found) == len(docs)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [(i, [*space_words(lower(t)), None]) for i, t in docs]
    count = collections.Counter(w for i, ws in tokens if not held(i) for w in ws)
    total, types = sum(count.values()), len(count)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:4], round(r[4], 6))
    want = [(i, held(i), len(ws), sum(count[w] > 0 for w in ws), sum(math.log10((count[w] + 1) / (total + types + 1)) for w in ws)) for i, ws in tokens]
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["base_score"]) for r in found]
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert all(r["train_tokens"] == total and r["score"] <= 0 and math.isfinite(r["score"]) for r in found)


def test_brown_probabilities_sum_to_one_and_beat_the_base(spark):
    docs = [(i, prose(i % 2 * 1000 + i, 60) if i % 2 else " ".join(f"z{ord(c) % 13}" for c in prose(i, 60))) for i in range(120)]
    found = rows(brown.score(keyed(frame(spark, docs)), rounds=3, share=1e-4))
    test = [r for r in found if r["held_out"]]
    assert test and sum(r["score"] for r in test) > sum(r["base_score"] for r in test)
    # one-word texts over the whole vocabulary and one unknown word: probabilities of the word after the end
    vocabulary = sorted({w for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2 for w in space_words(t)})
    probe = [w for w in [*vocabulary, "never-seen"]]
    held = [i for i in range(1000, 9000) if zlib.crc32(str(i).encode()) % 7 == 2][: len(probe) + 1]
    both = docs + list(zip(held, ["", *probe]))
    scores = {r["doc_id"]: r["score"] for r in rows(brown.score(keyed(frame(spark, both)), rounds=1, share=1.1))}
    # with all words rare: P(w) P(end | rare) over all w, and P(end | end) for the empty text
    words = sum(10 ** scores[i] for i in held[1:])
    assert 0 < words < 1


@pytest.mark.parametrize("make", [documents, odd_documents, list])
def test_trie_counts(spark, make):
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    cost, _ = trie.costs(path)
    docs = make()
    found = rows(trie.token_counts(frame(spark, docs, True), path))
    assert sorted((r["doc_id"] or 0, r["n_bytes"]) for r in found) == sorted((i or 0, len((t or "").encode())) for i, t in docs)
    table = {r["pretoken"]: r for r in rows(trie.pretoken_counts(frame(spark, docs), path))}
    for word, r in list(table.items())[:200]:
        best = [(0, 0)] + [(1 << 62, 0)] * len(word)
        for i in range(1, len(word) + 1):
            for j in range(i):
                if word[j:i] in cost:
                    best[i] = min(best[i], (best[j][0] + cost[word[j:i]], best[j][1] + 1))
        assert (r["cost"], r["n_tokens"]) == best[-1]
    assert sum(r["times"] * r["n_tokens"] for r in table.values()) == sum(r["n_tokens"] for r in found)
    assert sum(r["times"] for r in table.values()) == sum(r["n_pretokens"] for r in found)


@pytest.mark.parametrize("make", [documents, odd_documents, list])
def test_license_base_places(spark, make):
    docs = make() + ([(90, "cc by nc cc by nc under the mit license under the mit"), (91, "Licensed under the Apache License, extra Version 2.0 you may not use this file except in compliance with the License")] if make() else [])
    found = rows(keyed(frame(spark, docs, True)).select(KEY, "doc_id").join(licenses.labels(keyed(frame(spark, docs, True))), KEY)) if make is documents else rows(licenses.labels(keyed(frame(spark, docs, True))))
    want = []
    for _, text in docs:
        words = plain_words(text)
        at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        want.append((len(words), len(at), min(at)[0] if at else -1, max(at)[0] if at else -1, ",".join(sorted({x for _, x in at}))))
    none = lambda x: -1 if x is None else x
    assert sorted((r["n_words"], r["n_base"], none(r["first_word"]), none(r["last_word"]), r["base_labels"]) for r in found) == sorted(want)
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in found)
    if make is documents:  # one word put in: neighbouring diagonals are merged
        row = next(r for r in found if r["doc_id"] == 91)
        assert row["base_labels"] == "" and row["labels"] == "apache-2" and row["score"] > 0.6


@pytest.mark.parametrize("make", [documents, odd_documents, list])
def test_rule_statistics(spark, make):
    docs = make() + ([(80, "a b c\na b c\n\n \nx# <b>| a b c\na b c "), (81, "# " * 60)] if make() else [])
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in docs if i] + [(None, 1, 0), (10, None, None)], "doc_id bigint, quality int, toxic int")
    found = rows(isolation.judged(keyed(frame(spark, docs, True)), labels))
    want = []
    for i, text in docs:
        words = space_words(text)
        grams = collections.Counter(zip(words, words[1:], words[2:]))
        hit = {j + d for j, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for d in range(3)}
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if space_words(line):
                dup += line in seen
                seen.add(line)
        symbols = sum(c in "#*$%&|<>" for c in text or "")
        want.append((i or 0, len(words), sum(map(len, words)), symbols, dup, len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words)))
    assert sorted((r["doc_id"] or 0, *(r[c] for c in isolation.COUNTS), r["base_failed"]) for r in found) == sorted(want)
    assert not any(r["kept"] and r["base_failed"] for r in found)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert all(r["kept"] == (not r["base_failed"]) and r["anomaly"] is None for r in rows(isolation.judged(keyed(frame(spark, docs)), none)))


def test_forest_sets_outliers_apart():
    draw = np.random.default_rng(3)
    plain = draw.normal(size=(2000, 5))
    forest = isolation.Forest(plain)
    assert np.median(forest.score(np.full((1, 5), 6.0))) > np.quantile(forest.score(plain), 0.99)


def test_lower_bound(spark):
    values = [(float(i), True) for i in range(100, 200)] + [(float(i), False) for i in range(0, 50)]
    bound = labelled.lower_bound(spark.createDataFrame(values, "score double, clean boolean"), 0.0)
    assert 49 < bound <= 100
    assert labelled.lower_bound(spark.createDataFrame([(1.0, False)], "score double, clean boolean"), 0.0) is None


def test_lower_bound_beside_an_outlier(spark):
    values = [(i / 1000, True) for i in range(100, 200)] + [(i / 1000, False) for i in range(0, 50)] + [(1e6, False)]
    bound = labelled.lower_bound(spark.createDataFrame(values, "score double, clean boolean"), 0.002)
    assert 0.049 < bound <= 0.1


def test_resampling(spark):
    docs = [(i, prose(i, 200) + (" vile scum vile scum" if i % 5 == 0 else "")) for i in range(200)] + [(None, None), (7, ""), (7, "")]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(0, 160)], "doc_id bigint, quality int, toxic int")
    found = rows(resampling.resample(keyed(frame(spark, docs, True)), labels, false_alarms=0.0))
    assert len(found) == len(docs)
    scored = [r for r in found if r["doc_id"] is not None and r["doc_id"] != 7]
    bad = [r["kept"] for r in scored if r["doc_id"] % 5 == 0]
    good = [r["kept"] for r in scored if r["doc_id"] % 5]
    assert sum(bad) <= 2 and sum(good) >= 0.97 * len(good)
    k = sum(r["kept"] for r in found)
    top = sorted(found, key=lambda r: -r["gumbel_key"])
    assert {r["kept"] for r in top[:k]} <= {True} or top[k - 1]["gumbel_key"] == top[k]["gumbel_key"]
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert all(r["kept"] and r["log_weight"] == 0 for r in rows(resampling.resample(keyed(frame(spark, docs)), none)))
    assert rows(resampling.resample(keyed(frame(spark, [])), labels)) == []


def test_log_weights_by_hand(spark):
    import pyarrow as pa

    from tallyframe.llm.common import text_blocks

    texts = ["ab abc", "xabcdx xabcdx", "", None]
    ratio = np.random.default_rng(0).normal(size=resampling.BUCKETS).astype(np.float32)
    got = [r["log_weight"] for r in sorted(rows(resampling.log_weights(keyed(frame(spark, list(enumerate(texts)))), ratio)), key=lambda r: r["doc_id"])]
    for text, value in zip(texts, got):
        total, n = 0.0, 0
        for _, _, data, offsets in text_blocks(pa.array([text], pa.string())):
            for buckets, first in resampling.features(data, offsets):
                total += float(ratio[buckets].sum())
                n += len(buckets)
        assert n == len(space_words(text)) + max(0, len(text or "") - 4)
        assert abs(value - total / max(n, 1) ** 0.5) < 1e-4
