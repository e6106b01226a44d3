"""Cross-tokenizer alignment against brute force."""

import collections
import hashlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyframe.llm import alignment
from tallyframe.llm.common import keyed
from tallyframe.llm.tokens import tokenizer_path
from tests.llm.cases import documents, frame, odd_documents, rows

FIRST, SECOND = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
STRANGE = [
    (50, "two  spaces \n\n new\r\nlines\t tabs "), (51, "<|endoftext|> and <s> </s> <0x41> <unk>"), (52, "a ▁ mark"), (53, "　wide space\xa0x"),
    (54, "日本語のテキスト、句読点。"), (55, "🙂🙃 emoji \U0001f469‍\U0001f4bb"), (56, "aGVsbG8gd29ybGQ" * 40), (57, "\n \n  \n x"), (58, " "),
    (59, "don't they'll ''' !!!???"), (60, "x\x00y"), (61, "ÅÄÖ " * 50 + "Ÿ" * 90),
]


def by_force(docs):
    a = Tokenizer.from_file(FIRST)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=SECOND)
    vocabulary = {i: t for t, i in a.get_vocab().items()}
    out = []
    for _, text in docs:
        if not text:
            out.append([])
            continue
        raw = f" {text}".encode()
        ids_a, ids_b = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
        pieces = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        sizes = [len(vocabulary[i]) for i in ids_a]
        if b"".join(pieces) != raw or sum(sizes) != len(raw):
            out.append([])
            continue
        ends_a, ends_b = np.cumsum(sizes).tolist(), np.cumsum([len(p) for p in pieces]).tolist()
        groups, x, y = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            i, j = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append((ids_a[x:i], ids_b[y:j]))
            x, y = i, j
        out.append(groups)
    return out


def expected(docs):
    groups = by_force(docs)
    links = [collections.Counter((x, y) for a, b in one for x in a for y in b) for one in groups]
    count = collections.Counter(pair for one in links for pair in one)
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (doc_id, _), one, pairs in zip(docs, groups, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in one)
        n_best = sum(n for p, n in pairs.items() if count[p] == best[p[0]])
        total = sum(n * count[p] for p, n in pairs.items())
        sizes = (sum(len(a) for a, _ in one), sum(len(b) for _, b in one), len(one), sum(pairs.values()))
        out.append((doc_id, *sizes, n_best, total, hashlib.sha256(text.encode()).hexdigest() if one else ""))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [100, alignment.LIMIT])
@pytest.mark.parametrize("make", [documents, odd_documents, lambda: STRANGE, list])
def test_align(spark, make, limit):
    docs = make()
    found = rows(alignment.align(keyed(frame(spark, docs, True)), FIRST, SECOND, limit))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r[n] for n in names) for r in found), key=str) == expected(docs)


def test_large_groups_by_distinct_ids(spark, monkeypatch):
    monkeypatch.setattr(alignment, "GROUP_LINKS", 1)
    a, b = np.array([7, 7, 8, 9, 1], np.int32), np.array([3, 3, 4, 5], np.int32)
    group, pair, often = alignment.links(a, b, np.array([4, 5]), np.array([3, 4]))
    found = collections.Counter()
    for g, p, n in zip(group.tolist(), pair.tolist(), often.tolist()):
        found[g, p >> alignment.B_BITS, p & (1 << alignment.B_BITS) - 1] += n
    assert found == {(0, 7, 3): 4, (0, 7, 4): 2, (0, 8, 3): 2, (0, 8, 4): 1, (0, 9, 3): 2, (0, 9, 4): 1, (1, 1, 5): 1}


@pytest.mark.parametrize("seed", range(8))
def test_gallop(seed):
    draw = np.random.default_rng(seed)
    long = np.sort(draw.choice(10_000, [1, 5, 300, 4000, 4000, 9000, 9999, 50][seed], replace=False))
    short = np.sort(draw.choice(10_000, [4, 5, 2, 17, 3000, 600, 5000, 0][seed], replace=False))
    assert alignment.gallop(short, long).tolist() == np.searchsorted(long, short).tolist()
    a, b = alignment.common(short, long)
    assert short[a].tolist() == long[b].tolist() == sorted(set(short.tolist()) & set(long.tolist()))


def test_groups(spark):
    docs = [d for d in documents() if d[1]][:6]
    found = sorted(rows(alignment.groups(keyed(frame(spark, docs)), FIRST, SECOND)), key=lambda r: (r["doc_id"], r["place"]))
    want = dict(zip([d for d, _ in docs], by_force(docs)))
    for doc_id, text in docs:
        mine = [r for r in found if r["doc_id"] == doc_id]
        assert [(r["a_ids"], r["b_ids"]) for r in mine] == want[doc_id]
        raw = text.encode()
        assert mine[0]["start"] == -1 and mine[-1]["end"] == len(raw)
        assert b"".join(raw[max(0, r["start"]) : r["end"]] for r in mine) == raw


def test_pieces_equal_the_whole_text():
    texts = [f" {t}" for _, t in [*documents(), *STRANGE] if t]
    model = sentencepiece.SentencePieceProcessor(model_file=SECOND)
    ids, ends, good = alignment.PieceEncoder(SECOND).encode(pa.array(texts, pa.large_string()))
    for i, text in enumerate(texts):
        if good[i]:
            assert ids[ends[i] : ends[i + 1]].tolist() == model.encode(text[1:])
    assert good.sum() == len(texts) - 1  # the one with the mark in it
