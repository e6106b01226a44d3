"""Ranked search against brute force."""

import collections
import math
import re

import numpy as np
import pytest

from tallyframe.llm import ranking
from tallyframe.llm.common import keyed
from tests.llm.cases import EXTRA, documents, frame, odd_documents, prose, rows


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_force(docs, items, k):
    """For each item its best (score, place in ``docs``)."""
    held = [collections.Counter(terms(t)) for _, t in docs]
    sizes = [sum(h.values()) for h in held]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = collections.Counter(t for h in held for t in h)
    out = []
    for _, text in items:
        found = []
        for place, (h, size) in enumerate(zip(held, sizes)):
            if size:
                m = 100 - 25 + (25 * size * n_docs) // n_terms
                score = 0
                for t in terms(text):
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += weight * ((1_000_000_000 * h[t]) // (1000 * h[t] + 12 * m))
                if score > 0:
                    found.append((-score, place))
        out.append([(-s, p) for s, p in sorted(found)[:k]])
    return out


def items_of(docs):
    return [
        (1, "of the THE and 1 at"), (2, prose(1, 30)), (2, prose(4, 40)), (3, None), (4, "!!"), (5, "absent words only"), (6, "é ü naïve Naïve"),
        (7, prose(2, 400)), (8, "the"), (9, "Apache license of THEY his"),
    ]


def many():
    """Copies in one large group, and near ties."""
    return [(i, prose(i % 7, 40 + i % 3)) for i in range(400)] + [(1000 + i, prose(99, 60)) for i in range(300)]


@pytest.mark.parametrize("make", [documents, odd_documents, many, list])
@pytest.mark.parametrize("shard,block", [(ranking.SHARD, ranking.TERMS), (50, 60)])
def test_search(spark, monkeypatch, make, shard, block):
    monkeypatch.setattr(ranking, "SHARD", shard)
    docs = make()
    # keys follow (id, nulls last, text hash): brute force takes them from the table
    keyed_docs = keyed(frame(spark, docs, True)).cache()
    order = sorted(keyed_docs.collect(), key=lambda r: r["__key"])
    plain = [(r["doc_id"], r["text"]) for r in order]
    items = items_of(docs)
    table = keyed(spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", *[f"1 AS {c}" for c in EXTRA]), "item_id")
    found = rows(ranking.search(keyed_docs, table, 5, block))
    texts = {r["__key"]: r["text"] for r in table.collect()}
    want = sorted((i, rank + 1, plain[p][0], s) for (i, _), best in zip(items, by_force(plain, items, 5)) for rank, (s, p) in enumerate(best))
    assert sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found) == want
    assert len({(r["__item"], r["rank"]) for r in found}) == len(found) and all(r["__item"] in texts for r in found)


def test_no_items(spark):
    docs = keyed(frame(spark, documents()))
    assert rows(ranking.search(docs, keyed(spark.createDataFrame([], "item_id bigint, text string"), "item_id"))) == []


def test_stops_before_the_ends_of_the_lists():
    """A few documents far above the rest: most of the lists is never read, and ties with the k-th are still found."""
    n, size = 5000, 3
    impact = np.concatenate([np.arange(n, 0, -1) * 10 for _ in range(size)])
    impact[::n] += 1_000_000
    docs, codes = np.tile(np.arange(n), size), np.repeat(np.arange(size), n)
    order = np.lexsort((codes, docs))
    shard = ranking.Shard(docs[order], codes[order], impact[order], n, size)
    found, scores = shard.best(np.arange(size), np.ones(size, np.int64), 0, 2)
    assert set(found.tolist()) >= {0, 1} and scores.max() == 3 * (1_000_000 + 10 * n)
    assert (shard.met > 0).sum() < 100
    tied = ranking.Shard(np.arange(n), np.zeros(n, np.int64), np.full(n, 7), n, 1)
    found, _ = tied.best(np.array([0]), np.array([2]), 0, 2)
    assert len(found) == n
