"""Restoring and scoring: decoding against every path of the lattice, features by hand, held-out accuracy."""

import collections
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import common, deobfuscate
from tallyframe.llm.common import keyed
from tests.llm.cases import EXTRA, documents, frame, odd_documents, prose, rows

BAD = ["idiot", "moron", "loser"]


def model_of(texts):
    counts = np.zeros((deobfuscate.SYMBOLS,) * 3, np.int64)
    for text in texts:
        s = [0, 0, *deobfuscate.SYMBOL_OF[list(text.lower().encode())].tolist(), 0, 0]
        for x in zip(s, s[1:], s[2:]):
            counts[x] += 1
    return counts


def corpus():
    draw = random.Random(5)
    return [(i, prose(i, 30) + (" " + draw.choice(BAD) if i % 3 == 0 else "") + " " + prose(1000 + i, 20)) for i in range(600)]


def every_path(token, model):
    best = None
    for path in itertools.product(*deobfuscate.readings(token), [(b" ", 0.0)]):
        s = [0, 0, *deobfuscate.SYMBOL_OF[list(b"".join(t for t, _ in path))].tolist()]
        total = sum(c for _, c in path) + sum(float(model[x]) for x in zip(s, s[1:], s[2:]))
        if best is None or total > best + 1e-6:
            best, text = total, b"".join(t for t, _ in path[:-1])
    return best, text


@pytest.mark.parametrize("token", ["1d10t", "m.o.r.o.n", "l o s e r", "looooser", "iddiot", "the$$$", "10.0", "f0r", "###", "é1é"])
def test_decoding_is_the_best_path(token):
    model = deobfuscate.log_model(model_of(t for _, t in corpus()))
    best, text = every_path(token.encode(), model)
    got = deobfuscate.decode(token.encode(), model.tolist())
    # another path may be as good; the score may not be less
    def score(read):
        return max(sum(c for _, c in p) + path_score(p, model) for p in itertools.product(*deobfuscate.readings(token.encode())) if b"".join(t for t, _ in p) == read)
    assert got == text or abs(score(got) - best) < 1e-4


def path_score(path, model):
    s = [0, 0, *deobfuscate.SYMBOL_OF[list(b"".join(t for t, _ in path) + b" ")].tolist()]
    return sum(float(model[x]) for x in zip(s, s[1:], s[2:]))


def test_character_counts(spark):
    docs = [*documents(), (99, None)]
    found = deobfuscate.trigram_counts(frame(spark, docs))
    want = model_of(t or "" for _, t in docs)
    assert (found == want).all() and found[20, 8, 5] > 0  # t, h, e


def hidden(word, draw):
    kind = draw.randrange(4)
    if kind == 0:
        return word.translate(str.maketrans("oiesl", "01351"))
    if kind == 1:
        return " ".join(word)
    if kind == 2:
        return draw.choice(".-*_").join(word)
    return "".join(c * (4 if i == 1 else 1) for i, c in enumerate(word))


def test_restored_texts(spark):
    docs = corpus()
    draw = random.Random(9)
    words = [draw.choice(BAD) for _ in range(60)]
    noisy = [(1000 + i, f"of the {hidden(w, draw)} and that") for i, w in enumerate(words)]
    model = deobfuscate.log_model(deobfuscate.trigram_counts(frame(spark, docs)))
    found = {r["doc_id"]: r["restored"] for r in rows(deobfuscate.restore(keyed(frame(spark, [*noisy, (5000, None), (5001, "")])), model))}
    right = sum(w in found[1000 + i] for i, w in enumerate(words))
    assert right >= 54 and found[5000] is None and found[5001] == ""
    clean = {r["doc_id"]: r["restored"] for r in rows(deobfuscate.restore(keyed(frame(spark, docs)), model))}
    words_kept = [a == b for i, t in docs for a, b in zip(t.lower().split(), clean[i].split()) if a.isalpha()]
    assert all(words_kept)


def test_features_by_hand():
    text = b"Idiot an  idiot, xx"
    data, offsets = np.frombuffer(text + b" ", np.uint8), np.array([0, len(text) + 1])
    found = deobfuscate.tokens(data, offsets, deobfuscate.Reader(deobfuscate.log_model(model_of(["an idiot"]))))
    assert collections.Counter(found.texts[c] for c in found.code) == {b"idiot": 2, b"an": 1, b"xx": 1}
    doc, bucket, count = deobfuscate.document_features(found)
    runs = collections.Counter()
    for word in ["idiot", "idiot", "an", "xx"]:
        padded = f" {word} "
        for n in deobfuscate.RUNS:
            runs.update((n, padded[i : i + n]) for i in range(len(padded) - n + 1))
        runs.update([("word", word)])
    assert sorted(count.tolist()) == sorted(runs.values()) and set(doc.tolist()) == {0}


@pytest.mark.parametrize("block", [64, common.BLOCK])
def test_scores(spark, monkeypatch, block):
    plain = common.text_blocks
    monkeypatch.setattr(deobfuscate, "text_blocks", lambda column: plain(column, block))
    draw = random.Random(3)
    docs = [(i, t.replace(b, hidden(b, draw))) if (b := next((b for b in BAD if b in t), None)) and i % 2 else (i, t) for i, t in corpus()]
    labels = [(i, 1, int(any(b in t for b in BAD))) for i, t in corpus()]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").selectExpr("*", *[f"1 AS {c}" for c in EXTRA])
    found = rows(deobfuscate.toxicity(keyed(frame(spark, docs, True)), table))
    truth = {i: t for i, _, t in labels}
    held = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    bad, good = ([r["score"] for r in held if truth[r["doc_id"]] == v] for v in (1, 0))
    assert sum(b > g for b in bad for g in good) >= 0.95 * len(bad) * len(good)
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in found)
    # held-out labels change nothing
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    again = rows(deobfuscate.toxicity(keyed(frame(spark, docs)), spark.createDataFrame(turned, "doc_id bigint, quality int, toxic int")))
    assert {r["doc_id"]: r["score"] for r in again} == {r["doc_id"]: r["score"] for r in found}


@pytest.mark.parametrize("make", [documents, odd_documents, list])
def test_odd_documents(spark, make):
    docs = make()
    schema = "doc_id bigint, quality int, toxic int"
    for labels in ([], [(10, 1, 1), (10, 0, 0), (16, 1, 0), (None, 1, 1), (18, None, None), (21, 1, 0), (22, 0, 1)]):
        found = rows(deobfuscate.toxicity(keyed(frame(spark, docs, True)), spark.createDataFrame(labels, schema)))
        assert sorted(map(str, (r["doc_id"] for r in found))) == sorted(map(str, (d for d, _ in docs)))
        assert all(0 <= r["score"] <= 1 for r in found)
        if not labels:
            assert all(r["score"] == 0.5 for r in found)


def test_held_out_accuracy_on_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    found = deobfuscate.op11_noisy_channel(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    got = found.filter("held_out AND toxic IS NOT NULL").select("score", F.col("toxic").alias("t")).collect()
    bad, good = [r["score"] for r in got if r["t"]], [r["score"] for r in got if not r["t"]]
    wins = sum((b > g) + 0.5 * (b == g) for b in bad for g in good)
    assert wins >= 0.8 * len(bad) * len(good)
