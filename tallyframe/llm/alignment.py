"""Cross-tokenizer alignment: two tokenizers' tokens of a text in the least groups that cover the same bytes.

Each text is encoded by both tokenizers, and token ends become sorted lists of byte offsets. A galloping intersection
(exponential, then binary search, driven by the shorter list into the longer) finds the common ends; these cut both
token lists into groups, and differences of ranks say how many tokens of each list a group holds. All A-B occurrence
pairs inside a group are links. Documents that hold an id pair linked are counted over the whole corpus; a link is best
if its pair's count is the highest of its A id.

Texts are worked on in blocks of at most ``LIMIT`` bytes (a longer text is a block of its own). A block lists its
distinct pairs once; only these are shuffled, to be counted, and the counts come back to the block packed.

Defined cases: null and empty texts, and texts whose joined token bytes differ from a space and the text, have no
tokens: zeros and an empty string. Rows that repeat a doc_id, or have none, are documents of their own. No documents
give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import KEY, cuts, kept, keyed, list_array, word_hashes, written
from tallyframe.llm.tokens import REMEMBERED, WHOLE, Encoder, loaded, tokenizer_path
from tallyframe.session import ship

ship(__name__)

LIMIT = 2 << 20
# Links written out pair by pair at once; larger groups are worked on by their distinct ids.
GROUP_LINKS = 1 << 12
B_BITS = 20  # an id pair is a << B_BITS | b
MARK = "▁"  # stands for a space in the second tokenizer's pieces
SPACE_BYTE, NEW_LINE = 0x20, 0x0A


class PlainEncoder(Encoder):
    """Ids by a tokenizer file whose special tokens count as ordinary text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.plain = loaded(path)
        self.plain.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)  # byte-level: one character a byte

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, WHOLE).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self.encode_plain(texts)
        ids, offsets = self.encode_plain(pc.if_else(pa.array(~odd), texts, pa.scalar("", pa.large_string())))
        whole = {i: np.array(self.plain.encode(texts[i].as_py(), add_special_tokens=False).ids, np.int32) for i in np.flatnonzero(odd)}
        parts = [whole.get(i, ids[offsets[i] : offsets[i + 1]]) for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


class PieceEncoder:
    """Ids by a sentence-piece file, each distinct stretch encoded once and remembered under a 64-bit hash.

    A stretch starts at a space after another byte and at a line end. No piece of the vocabulary reaches over either
    (checked when the file is read), so stretches give the ids of the whole text.
    """

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        plain = [p for i, p in enumerate(pieces) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        if any("\n" in p or any(a != MARK and b == MARK for a, b in zip(p, p[1:])) for p in plain):
            raise ValueError("pieces reach over a space or a line end")
        self.mark = self.model.piece_to_id(MARK)
        self.raw = [bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.bytes_of = np.array([len(r) for r in self.raw], np.int64)
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.same = np.zeros(0, bool)  # the pieces' bytes are the stretch
        self.flat = np.zeros(0, np.int32)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.hashes, hashes)
        found = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        found[inside] = self.hashes[at[inside]] == hashes[inside]
        return at, found

    def learn(self, hashes: np.ndarray, stretches: list[bytes]) -> None:
        # the model puts a space before every text: that is a stretch's own first space, or it goes again
        own = [s[:1] == b" " for s in stretches]
        texts = [(s[1:] if o else s).decode() for s, o in zip(stretches, own)]
        ids = [x if o and x else [self.mark] if o else x[1:] for x, o in zip(self.model.encode(texts, num_threads=1), own)]
        same = np.array([b"".join([self.raw[i] for i in x]) == s for x, s in zip(ids, stretches)], bool)
        length = np.array([len(x) for x in ids], np.int64)
        begin = len(self.flat) + np.cumsum(length) - length
        self.flat = np.concatenate([self.flat, *[np.array(x, np.int32) for x in ids]])
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.begin = np.insert(self.begin, at, begin[order])
        self.length = np.insert(self.length, at, length[order])
        self.same = np.insert(self.same, at, same[order])
        self.hashes = np.insert(self.hashes, at, hashes[order])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, one offset per text (and the end), and whether the ids' bytes are the text. Texts start with a space."""
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64), np.ones(len(texts), bool)
        first = np.zeros(len(data) + 1, bool)
        first[1:-1] = (data[1:] == SPACE_BYTE) & (data[:-1] != SPACE_BYTE)
        first[:-1] |= data == NEW_LINE
        first[offsets] = True
        edges = np.flatnonzero(first)
        starts, ends = edges[:-1], edges[1:]
        codes, hashes = pd.factorize(word_hashes(data, starts, ends))
        at, found = self.places(hashes)
        if not found.all():
            if len(self.hashes) + len(hashes) > REMEMBERED:
                self.forget()
                found[:] = False
            where = np.zeros(len(hashes), np.int64)
            where[codes[::-1]] = np.arange(len(codes))[::-1]
            new = where[~found]
            self.learn(hashes[~found], [data[a:b].tobytes() for a, b in zip(starts[new].tolist(), ends[new].tolist())])
            at, _ = self.places(hashes)
        begin, lengths = self.begin[at][codes], self.length[at][codes]
        total = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[np.arange(total[-1]) + np.repeat(begin - total[:-1], lengths)]
        wrong = np.concatenate([[0], np.cumsum(~self.same[at][codes])])
        text_edges = np.searchsorted(edges, offsets)
        return ids, total[text_edges], np.diff(wrong[text_edges]) == 0


def encoders(first: str, second: str) -> tuple[PlainEncoder, PieceEncoder]:
    a = kept(f"plain encoder {first}", lambda: PlainEncoder(first))
    return a, kept(f"piece encoder {second}", lambda: PieceEncoder(second))


STRIDE = 16


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each of ``short`` the first place in ``long`` that is not smaller; both ascend.

    Every 16th element (of every 16th, ...) is looked for first, so that the others gallop from a near place; the
    searches of one stride go in step.
    """
    out = np.zeros(len(short), np.int64)
    if not len(short) or not len(long):
        return out
    stride = 1
    while stride * STRIDE < len(short):
        stride *= STRIDE
    top = True
    while stride:
        which = np.arange(0, len(short), stride)
        low = np.zeros(len(which), np.int64) if top else out[which - which % (stride * STRIDE)]
        value, step = short[which], 1
        high, open_ = low.copy(), np.arange(len(which))
        while len(open_):  # exponential: everything before ``low`` is smaller
            open_ = open_[(high[open_] < len(long))]
            open_ = open_[long[high[open_]] < value[open_]]
            low[open_] = high[open_] + 1
            high[open_] += step
            step *= 2
        high = np.minimum(high, len(long))
        open_ = np.flatnonzero(low < high)
        while len(open_):  # binary
            middle = (low[open_] + high[open_]) // 2
            small = long[middle] < value[open_]
            low[open_[small]] = middle[small] + 1
            high[open_[~small]] = middle[~small]
            open_ = open_[low[open_] < high[open_]]
        out[which] = low
        stride, top = stride // STRIDE, False
    return out


def common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in ``a`` and in ``b`` of the values that both have."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    at = gallop(short, long)
    hit = np.flatnonzero(at < len(long))
    hit = hit[long[at[hit]] == short[hit]]
    return (hit, at[hit]) if short is a else (at[hit], hit)


def links(a: np.ndarray, b: np.ndarray, a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id pair, number of links) of groups that end before the ranks ``a_end`` and ``b_end``; pairs may repeat."""
    n_a, n_b = np.diff(a_end, prepend=0), np.diff(b_end, prepend=0)
    small = n_a * n_b <= GROUP_LINKS
    # an A token meets all B tokens of its group
    reach = np.repeat(np.where(small, n_b, 0), n_a)
    group = np.repeat(np.arange(len(n_a)), n_a)
    owner = np.repeat(np.arange(len(a)), reach)
    place = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
    groups = [group[owner]]
    pairs = [a[owner].astype(np.int64) << B_BITS | b[(b_end - n_b)[groups[0]] + place]]
    often = [np.ones(len(owner), np.int64)]
    for g in np.flatnonzero(~small).tolist():  # by distinct ids
        ids_a, often_a = np.unique(a[a_end[g] - n_a[g] : a_end[g]], return_counts=True)
        ids_b, often_b = np.unique(b[b_end[g] - n_b[g] : b_end[g]], return_counts=True)
        pairs.append((ids_a.astype(np.int64)[:, None] << B_BITS | ids_b[None, :]).ravel())
        often.append((often_a[:, None] * often_b[None, :]).ravel())
        groups.append(np.full(len(pairs[-1]), g))
    return np.concatenate(groups), np.concatenate(pairs), np.concatenate(often)


def written_out(a: np.ndarray, b: np.ndarray, a_end: np.ndarray, b_end: np.ndarray, last: np.ndarray, names: pa.Array, size_a: int) -> tuple[memoryview, np.ndarray]:
    """``a1,a2|b1;a3|b2`` of all groups, and where each group's text ends; ``last``: groups that end a document."""
    n_a, n_b = np.diff(a_end, prepend=0), np.diff(b_end, prepend=0)
    order = np.empty(len(a) + len(b), np.int32)
    kind_a = np.zeros(len(a), np.int32)
    kind_a[a_end - 1] = 1
    kind_b = np.zeros(len(b), np.int32)
    kind_b[b_end - 1] = np.where(last, 2, 1)
    order[np.arange(len(a)) + np.repeat(b_end - n_b, n_a)] = 2 * a + kind_a
    order[np.arange(len(b)) + np.repeat(a_end, n_b)] = 2 * size_a + 3 * b + kind_b
    text = pc.take(names, pa.array(order))
    ends = np.frombuffer(text.buffers()[1], np.int64)[: len(order) + 1]
    return memoryview(text.buffers()[2] or b""), ends[a_end + b_end]


def token_names(size_a: int, size_b: int) -> pa.Array:
    """Every id's decimal digits with what may follow them."""
    first = [f"{i}{end}" for i in range(size_a) for end in (",", "|")]
    return pa.array(first + [f"{i}{end}" for i in range(size_b) for end in (",", ";", "")], pa.large_string())


def align_block(texts: pa.Array, a: PlainEncoder, b: PieceEncoder) -> dict[str, np.ndarray | list[str]]:
    """Per text n_a, n_b, n_groups, n_links, sha256; distinct (text, pair) with links; distinct pairs with texts."""
    texts = texts.cast(pa.large_string()).fill_null("")
    full = pc.greater(pc.binary_length(texts), 0)
    space, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    spaced = pc.if_else(full, pc.binary_join_element_wise(space, texts, nothing), texts)
    size = pc.binary_length(spaced).to_numpy(zero_copy_only=False).astype(np.int64)
    ids_b, at_b, good = b.encode(spaced)
    ids_a, at_a = a.encode(spaced)
    ends = np.concatenate([[0], np.cumsum(a.bytes_of[ids_a])])
    good &= np.diff(ends[at_a]) == size
    keep_a, keep_b = np.repeat(good, np.diff(at_a)), np.repeat(good, np.diff(at_b))
    ids_a, ids_b = ids_a[keep_a], ids_b[keep_b]
    n_a, n_b = np.diff(at_a) * good, np.diff(at_b) * good
    ranks_a, ranks_b = common(np.cumsum(a.bytes_of[ids_a]), np.cumsum(b.bytes_of[ids_b]))
    a_end, b_end = ranks_a + 1, ranks_b + 1
    # every text ends a group
    doc_end = np.searchsorted(a_end, np.cumsum(n_a), side="right")
    n_groups = np.diff(doc_end, prepend=0)
    n_groups[n_a == 0] = 0
    last = np.zeros(len(a_end), bool)
    last[doc_end[n_groups > 0] - 1] = True
    names = kept("token names", lambda: token_names(len(a.bytes_of), len(b.bytes_of)))
    text, text_ends = written_out(ids_a, ids_b, a_end, b_end, last, names, len(a.bytes_of))
    text_ends = np.concatenate([[0], text_ends])
    begin = np.concatenate([[0], np.cumsum(n_groups)])
    sha = [hashlib.sha256(text[x:y]).hexdigest() if y > x else "" for x, y in zip(text_ends[begin[:-1]].tolist(), text_ends[begin[1:]].tolist())]
    group, pair, often = links(ids_a, ids_b, a_end, b_end)
    codes, pairs = pd.factorize(pair)
    doc = np.repeat(np.arange(len(n_groups)), n_groups)[group]
    held, where = np.unique(doc * max(1, len(pairs)) + codes, return_inverse=True)
    often = np.bincount(where, weights=often, minlength=len(held)).astype(np.int64)
    doc, code = np.divmod(held, max(1, len(pairs)))
    n_links = np.bincount(doc, weights=often, minlength=len(n_groups)).astype(np.int64)
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "sha256": sha,
        "doc": doc.astype(np.int32), "code": code.astype(np.int32), "often": often,
        "pairs": np.asarray(pairs, np.int64), "texts": np.bincount(code, minlength=len(pairs)).astype(np.int64),
    }


PER_TEXT = [KEY, "doc_id", "n_a", "n_b", "n_groups", "n_links"]
PER_BLOCK = ["doc", "code", "often", "pairs", "texts"]
BLOCKS = ", ".join(["block bigint", *[f"{c} array<bigint>" for c in PER_TEXT], "sha256 array<string>", *[f"{c} binary" for c in PER_BLOCK]])


def aligned(docs: DataFrame, first: str, second: str, limit: int = LIMIT) -> DataFrame:
    """A row per block of keyed documents: what ``align_block`` gives, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = encoders(first, second)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for low, high in cuts(batch.column(2), limit):
                rows = batch.slice(low, high - low)
                found = align_block(rows.column(2), a, b)
                found["often"] = found["often"].astype(np.int32 if found["often"].max(initial=0) < 1 << 31 else np.int64)
                ends = np.array([0, high - low])
                columns = [pa.array([block]), list_array(rows.column(0), ends), list_array(rows.column(1), ends)]
                columns += [list_array(pa.array(found[c]), ends) for c in PER_TEXT[2:]]
                columns += [list_array(pa.array(found["sha256"], pa.string()), ends)]
                columns += [pa.array([found[c].tobytes()], pa.binary()) for c in PER_BLOCK]
                yield pa.RecordBatch.from_arrays(columns, ["block", *PER_TEXT, "sha256", *PER_BLOCK])
                block += 1

    chosen = docs.select(KEY, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, BLOCKS)


def block_pairs(blocks: DataFrame) -> DataFrame:
    """``block, code, a, b, docs``: the distinct pairs of each block with the number of its documents that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs, docs = np.frombuffer(row["pairs"], np.int64), np.frombuffer(row["texts"], np.int64)
                columns = [np.full(len(pairs), row["block"]), np.arange(len(pairs), dtype=np.int32), (pairs >> B_BITS).astype(np.int32), (pairs & (1 << B_BITS) - 1).astype(np.int32), docs]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "code", "a", "b", "docs"])

    return blocks.select("block", "pairs", "texts").mapInArrow(run, "block bigint, code int, a int, b int, docs bigint")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``a, b, count, best``: documents that hold a pair, and whether no pair of the same A id is held by more."""
    counts = written(pairs.groupBy("a", "b").agg(F.sum("docs").alias("count")))
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    return counts.join(highest, "a").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))


def scored_links(blocks: DataFrame) -> DataFrame:
    """``__key, doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` from written blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                doc, code = (np.frombuffer(row[c].as_buffer(), np.int32) for c in ("doc", "code"))
                often = np.frombuffer(row["often"].as_buffer(), np.int32 if len(row["often"].as_buffer()) == doc.nbytes else np.int64)
                counts, best = np.zeros(code.max(initial=-1) + 1, np.int64), np.zeros(code.max(initial=-1) + 1, np.int64)
                if row["answers"].is_valid:
                    answers = row["answers"].values.flatten()  # code, count, best
                    where = answers[0].to_numpy()
                    counts[where], best[where] = answers[1].to_numpy(), answers[2].to_numpy(zero_copy_only=False)
                n = len(row[KEY])
                ends = np.searchsorted(doc, np.arange(n + 1))
                # whole numbers all the way: running sums, then differences
                sums = [np.diff(np.concatenate([[0], np.cumsum(often * x[code])])[ends]) for x in (best, counts)]
                columns = [row[c].values for c in PER_TEXT] + [pa.array(x) for x in sums] + [row["sha256"].values]
                yield pa.RecordBatch.from_arrays(columns, [*PER_TEXT, "n_best", "count_sum", "groups_sha256"])

    pairs = block_pairs(blocks)
    counts = pair_counts(pairs)
    answers = pairs.join(counts, ["a", "b"]).groupBy("block").agg(F.collect_list(F.struct("code", "count", "best")).alias("answers"))
    both = blocks.drop("pairs", "texts").join(answers, "block", "left")
    kinds = ", ".join([*[f"{c} bigint" for c in PER_TEXT], "n_best bigint, count_sum bigint, groups_sha256 string"])
    return both.mapInArrow(run, kinds)


def align(docs: DataFrame, first: str, second: str, limit: int = LIMIT) -> DataFrame:
    return scored_links(written(aligned(docs, first, second, limit)))


def groups(docs: DataFrame, first: str, second: str) -> DataFrame:
    """``__key, doc_id, place, start, end, a_ids, b_ids``: the groups themselves, byte ranges of the text after its space.

    The first group starts at the space, -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = encoders(first, second)
        for batch in batches:
            for key, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                spaced = pa.array([f" {text}" if text else ""], pa.large_string())
                ids_a, _ = a.encode(spaced)
                ids_b, _, good = b.encode(spaced)
                ends_a = np.cumsum(a.bytes_of[ids_a])
                if not good[0] or not len(ids_a) or ends_a[-1] != len(spaced[0].as_buffer()):
                    continue
                ranks_a, ranks_b = common(ends_a, np.cumsum(b.bytes_of[ids_b]))
                end = ends_a[ranks_a] - 1
                n = len(end)
                lists = [list_array(pa.array(x), np.concatenate([[0], r + 1])) for x, r in ((ids_a, ranks_a), (ids_b, ranks_b))]
                start = np.concatenate([[-1], end[:-1]])
                columns = [pa.array([key] * n, pa.int64()), pa.array([doc_id] * n, pa.int64()), *[pa.array(x.astype(np.int64)) for x in (np.arange(n), start, end)], *lists]
                yield pa.RecordBatch.from_arrays(columns, [KEY, "doc_id", "place", "start", "end", "a_ids", "b_ids"])

    chosen = docs.select(KEY, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = f"{KEY} bigint, doc_id bigint, place bigint, start bigint, end bigint, a_ids array<int>, b_ids array<int>"
    return chosen.mapInArrow(run, kinds)


def op12_galloping(spark: SparkSession, folder: str) -> DataFrame:
    docs = keyed(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    found = align(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return found.drop(KEY)
