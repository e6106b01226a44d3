"""Operators across documents against brute force: packing, near duplicates, decontamination, substrings, pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyframe.llm import decontaminate, induced, minhash, packing, substrings
from tallyframe.llm.common import KEY, keyed
from tallyframe.llm.components import components
from tallyframe.llm.tokens import tokenizer_path
from tests.llm.cases import documents, frame, lower, odd_documents, plain_words, prose, rows, space_words


def check_pieces(pieces, lengths, window):
    """pieces: (document, start, length, sequence, offset)."""
    at, sequences = {}, {}
    for doc, start, length, sequence, offset in pieces:
        assert length > 0
        at.setdefault(doc, []).append((start, length))
        sequences.setdefault(sequence, []).append((offset, length))
    for doc, total in lengths.items():
        end = 0
        for start, length in sorted(at.get(doc, [])):
            assert start == end
            end += length
        assert end == total
    padding = 0
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window
        padding += window - end if end & (end - 1) else 0
    return padding


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_token_once(seed):
    draw = np.random.default_rng(seed)
    window = [8, 16, 64, 64, 128, 4096][seed]
    tokens = draw.integers(1, 3 * window, 400) if seed % 2 else draw.choice([3, window - 3, window // 2, 2 * window, window + 1], 400)
    order = np.lexsort((np.arange(400), tokens % window))
    rank = np.empty(400, np.int64)
    rank[order] = np.arange(400)
    blocks = (tokens // window)[order]
    before = np.empty(400, np.int64)
    before[order] = np.cumsum(blocks) - blocks
    plan = packing.make_plan(np.bincount(tokens % window, minlength=window), window)
    columns = packing.place(plan, tokens, rank, before)
    assert check_pieces(list(zip(*(c.tolist() for c in columns))), dict(enumerate(tokens.tolist())), window) == 0


def test_least_squares_uses_what_fits():
    counts = np.zeros(16, np.int64)
    counts[[5, 11, 8, 3]] = [40, 30, 20, 7]
    combos = packing.combinations(counts, 16, 8)
    assert (11, 5) in combos and (8, 5, 3) in combos and (8, 8) in combos
    plan = packing.make_plan(counts, 16)
    assert plan.planned.sum() >= 80


@pytest.mark.parametrize("make", [documents, odd_documents, list])
def test_pack(spark, make):
    docs = make()
    path = tokenizer_path("word_bpe_49k.json")
    found = rows(packing.pack(frame(spark, docs, True), path, window=64))
    plain = Tokenizer.from_file(path)
    whole = [plain.encode(t or "", add_special_tokens=False).ids + [2] for _, t in docs]
    assert sorted(i for r in found for i in r["ids"]) == sorted(i for x in whole for i in x)
    assert all(r["length"] == len(r["ids"]) for r in found)
    if make is documents:
        ids = dict(zip([i for i, _ in docs], whole))
        pieces = [(r["doc_id"], r["start"], r["length"], r["sequence_id"], r["offset"]) for r in found]
        assert check_pieces(pieces, {i: len(x) for i, x in ids.items()}, 64) == 0
        assert all(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]] == r["ids"] for r in found)
        crc = rows(packing.pack(frame(spark, docs), path, window=64, digest=True))
        want = sorted((r["doc_id"], r["start"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in found)
        assert sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in crc) == want


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (500, 501), (501, 500)]
    found = {r["node"]: r["label"] for r in rows(components(spark.createDataFrame(links, "a bigint, b bigint")))}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 500: 500, 501: 500}
    assert rows(components(spark.createDataFrame([], "a bigint, b bigint"))) == []


def near_by_force(texts, size, percent=80):
    sets = []
    for text in texts:
        words = space_words(lower(text))
        grams = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
        sets.append(grams if len(words) >= size else {tuple(words)} if words else set())
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((label[a], label[b]))
                label = [x if v == y else v for v in label]
    return [len(s) for s in sets], label


def edited(text, seed, n):
    draw, words = random.Random(seed), text.split()
    for _ in range(n):
        words[draw.randrange(len(words))] = f"e{draw.randrange(10**6)}"
    return " ".join(words)


def near_corpus():
    base = prose(50, 150)
    chain = [prose(60, 100)]
    for i in range(12):  # each step is near the one before, the ends are not near each other
        words = chain[-1].split()
        words[8 * i : 8 * i + 4] = [f"c{i}{j}" for j in range(4)]
        chain.append(" ".join(words))
    texts = [t for _, t in documents()] + [edited(base, i, i % 9) for i in range(60)] + chain + [prose(i, 90) for i in range(200, 230)]
    return list(enumerate(texts))


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(spark, size):
    docs = near_corpus()
    found = {r[KEY]: r for r in rows(minhash.near_duplicates(keyed(frame(spark, docs, True)), minhash.NearDuplicates(shingle=size)))}
    n, label = near_by_force([t for _, t in docs], size)
    assert [found[i]["n_shingles"] for i, _ in docs] == n
    assert [found[i]["component"] for i, _ in docs] == label


def test_near_duplicates_block_by_block(spark, monkeypatch):
    """Groups in one bucket that are not similar to each other; after one hub only blocks can link them."""
    monkeypatch.setattr(minhash, "SIDE", 8)
    docs = near_corpus()
    how = minhash.NearDuplicates(shingle=4, rows=1, bands=32)
    found = {r[KEY]: r["component"] for r in rows(minhash.near_duplicates(keyed(frame(spark, docs)), how))}
    assert [found[i] for i, _ in docs] == near_by_force([t for _, t in docs], 4)[1]


@pytest.mark.parametrize("side", [2, 2048])
def test_blocks_join_what_two_rounds_of_labels_leave_apart(spark, monkeypatch, side):
    """A chain: neighbours are similar, others are not; one hub links two of them, blocks must find the other links."""
    monkeypatch.setattr(minhash, "SIDE", side)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[10 * i : 10 * i + 120]) for i in (3, 0, 6, 1, 5, 2, 4)]
    docs = spark.createDataFrame(list(enumerate(texts)), f"{KEY} bigint, text string")
    found = {r[KEY]: r["component"] for r in rows(minhash.near_duplicates(docs, minhash.NearDuplicates(shingle=1, rows=1, bands=96)))}
    assert found == dict.fromkeys(range(7), 0)


@pytest.mark.parametrize("side, held", [(8, 64 << 20), (2048, 8 * 8 * 150)])
def test_blocks_are_bounded_and_give_few_links(spark, monkeypatch, side, held):
    """All in one bucket: 30 near copies of one text with labels of their own, 20 of another under one label."""
    monkeypatch.setattr(minhash, "SIDE", side)
    monkeypatch.setattr(minhash, "HELD", held)
    texts = [edited(prose(50, 150), i, 1) for i in range(30)] + [edited(prose(70, 150), i, 1) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), f"{KEY} bigint, text string")
    search = minhash.Search(docs, minhash.NearDuplicates(shingle=4))
    assert search.signatures.count() == 50
    label = F.least(F.col(KEY), F.lit(30)).alias("label")
    members = search.signatures.select(F.lit(1).alias("bucket"), KEY, "n", label)
    mapped, kind = [], type(docs)
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *how: mapped.append(self) or plain(self, *how))
    links = rows(search.by_block(members))
    blocks = rows(mapped[-1].groupBy("x", "y").agg(F.count_if("probe").alias("p"), F.count_if(~F.col("probe")).alias("q"), F.count_distinct("label").alias("labels")))
    assert len(blocks) > 4 and max(max(r["p"], r["q"]) for r in blocks) <= 20
    assert sum(r["p"] * r["q"] for r in blocks) == 30 * 50
    assert len(links) <= sum(r["labels"] - 1 for r in blocks) and all(max(r["a"], r["b"]) < 30 for r in links)
    joined = {r["node"]: r["label"] for r in rows(components(spark.createDataFrame(links)))}
    assert joined == dict.fromkeys(range(30), 0)


@pytest.mark.parametrize("make", [odd_documents, list])
def test_near_duplicates_of_odd_rows(spark, make):
    docs = make()
    kd = keyed(frame(spark, docs))
    found = rows(kd.select(KEY, "doc_id", "text").join(minhash.near_duplicates(kd), KEY))
    assert len(found) == len(docs)
    groups: dict = {}
    for r in found:
        groups.setdefault(r["component"], []).append(r["text"])
    _, label = near_by_force([t for _, t in docs], 5)
    want: dict = {}
    for (_, t), x in zip(docs, label):
        want.setdefault(x, []).append(t)
    key = lambda g: sorted(map(repr, g))
    assert sorted(map(key, groups.values())) == sorted(map(key, want.values()))


def test_bounds_of_the_posterior():
    needed = minhash.NearDuplicates().needed()
    assert [n for n, _ in needed] == [16, 32, 48, 64, 80, 96]
    assert all(a <= b for (_, a), (_, b) in zip(needed, needed[1:])) and needed[-1][1] > 40


@pytest.mark.parametrize("make", [documents, odd_documents, list])
def test_contamination(spark, make):
    docs = make()
    words = prose(2, 3000).split()
    items = [
        (1, " ".join(words[100:130])), (2, " ".join(words[5:14])), (3, "ONE two"), (4, "x"), (5, None), (6, ""), (None, "one two"),
        (7, prose(1, 120)), (7, prose(1, 120)), (8, prose(999, 30)), (9, "aaaa " * 15),
    ]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = rows(decontaminate.contamination(keyed(frame(spark, docs, True)), bench))
    want = []
    for _, text in docs:
        w, hit, ids = plain_words(text), set(), set()
        for item, item_text in items:
            v = plain_words(item_text)
            size = min(10, len(v))
            windows = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v and item is not None else set()
            for i in range(len(w) - size + 1 if windows else 0):
                if tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    ids.add(str(item))
        want.append((len(w), len(hit), sorted(ids)))
    assert sorted((r["n_words"], r["n_hit"], r["items"]) for r in found) == sorted(want)
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert all(r["n_hit"] == 0 for r in rows(decontaminate.contamination(keyed(frame(spark, docs)), empty)))


def cut_by_force(texts, window):
    seen, out = set(), []
    for text in texts:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - window + 1):
            part = data[i : i + window]
            if part in seen:
                gone[i : i + window] = True
            seen.add(part)
        out.append(bytes(np.frombuffer(data, np.uint8)[~gone]))
    return out


def shared_passages():
    draw = random.Random(5)
    pool = [prose(i, 30) for i in range(70, 78)]
    out = []
    for i in range(60):
        text = " ".join(draw.choice(pool) if draw.random() < 0.5 else prose(1000 + i, draw.randrange(3, 20)) for _ in range(6))
        out.append((i, text[draw.randrange(20) :]))
    return out + [(100 + i, t) for i, (_, t) in enumerate(documents())]


def test_substrings(spark):
    docs = shared_passages()
    found = sorted(rows(substrings.without_repeats(keyed(frame(spark, docs, True)))), key=lambda r: r["doc_id"])
    assert [bytes(r["kept"]) for r in found] == cut_by_force([t for _, t in docs], 100)
    assert all(len(r["kept"]) == r["n_bytes"] - sum(b - a for a, b in zip(r["starts"], r["ends"])) for r in found)
    assert rows(substrings.without_repeats(keyed(frame(spark, [])))) == []


def test_substrings_of_odd_rows(spark):
    docs = odd_documents()
    found = sorted(rows(substrings.without_repeats(keyed(frame(spark, docs)))), key=lambda r: r[KEY])
    texts = {r[KEY]: r["text"] for r in rows(keyed(frame(spark, docs)))}
    assert [bytes(r["kept"]) for r in found] == cut_by_force([texts[k] for k in sorted(texts)], 100)


@pytest.mark.parametrize("limit", [1, 1 << 30])
def test_induced_sorting_spills(limit):
    """Random windows over two letters; queues on disk and in memory give the same."""
    draw = np.random.default_rng(1)
    window, most, n = 8, 5, 400
    texts = draw.integers(97, 99, (n, most + window)).astype(np.uint8)
    rights = [bytes(t[most:]) for t in texts]
    order = sorted(range(n), key=rights.__getitem__)
    out = np.zeros(n, induced.tuple_type(most))
    for place, i in enumerate(order):
        before = rights[order[place - 1]] if place else b""
        shared = next((k for k in range(window) if rights[i][k : k + 1] != before[k : k + 1]), window)
        out[place] = (shared, 0, most, i, most, texts[i, :most])
    parts = [out[a : a + 37] for a in range(0, n, 37)]
    got = sorted((int(k), int(s)) for keys, starts in induced.repeated(parts, window, most, limit, 50) for k, s in zip(keys, starts))
    want = []
    for step in range(most + 1):
        seen = set()
        for i in range(n):
            part = bytes(texts[i, most - step : most - step + window])
            if part in seen:
                want.append((i, most - step))
            seen.add(part)
    assert got == sorted(want)


def test_cuts_drop_only_broken_characters(spark, tmp_path):
    """The second text repeats 120 bytes that begin and end inside characters; its own U+FFFD stay."""
    import corpus_pipeline

    shared = prose(90, 40)[:118]
    texts = ["\u4e00" + shared + "\u20ac", "a\ufffdb " + "\u4e80" + shared + "\u20ad" + " \ufffd\U0001f600 end" + "\u00e9z" * 5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: r["text"] for r in rows(corpus_pipeline.repeated_substrings(spark, docs, str(tmp_path)))}
    joint = [t.encode() for t in texts]
    at = joint[1].index(shared.encode())
    low, high = at, at + len(shared)
    while joint[1][low - 1 : high] in joint[0]:
        low -= 1
    while joint[1][low : high + 1] in joint[0]:
        high += 1
    assert low < at or high > at + len(shared)  # a character is broken
    want = joint[1][:low].decode(errors="ignore") + joint[1][high:].decode(errors="ignore")
    assert found == {0: texts[0], 1: want} and want.count("\ufffd") == 2


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    docs = frame(spark, odd_documents(), True).withColumn("n_chars", F.length("text"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(10, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "negative id")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_duplicates", "repeated_substrings", "decontamination", "packing"]
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, folder)
        out.write.parquet(f"{folder}/{i}")
        new = spark.read.parquet(f"{folder}/{i}")
        if name == "packing":
            assert sum(len(r["ids"]) for r in rows(new)) > 0
            break
        assert new.columns == docs.columns
        texts, kept = [r["text"] for r in rows(now)], [r["text"] for r in rows(new)]
        if name == "near_duplicates":
            assert len(kept) == len(set(near_by_force(texts, 5)[1]))
        if name == "repeated_substrings":
            assert len(kept) == len(texts) and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows(new))
        if name == "decontamination":
            assert "Negative id" in texts and "Negative id" not in kept and len(kept) == len(texts) - 1
        now = new
    assert rows(corpus_pipeline.run(spark, folder))
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert rows(stage(spark, empty, folder)) == []
