"""Token counts by dynamic programming over a trie of distinct pre-tokens.

A unigram model over a public vocabulary: a piece of rank r costs log2(r + 2), in thousandths, as under Zipf's law. The
best segmentation of a pre-token has the least cost, and of those the fewest pieces; the forward scores up to a byte
depend on the bytes before it only. So the distinct pre-tokens of a stretch of text go into a trie, the forward step is
made once per node, and a node at which a pre-token ends stores its count. Documents then add up stored counts.

Each task does this for its own texts, a bounded stretch at a time, so nothing is shuffled. ``pretoken_counts`` is the
same for the distinct pre-tokens of the whole corpus: Spark deals them out in sorted order, so that shared prefixes
meet in one task.

Pre-tokens are the places where a text may be cut for certain (see ``tokens.piece_starts``); together they are the whole
text. Defined cases: null and empty texts have no tokens; repeated rows are counted each, null ids too; other columns
are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import cuts, kept, word_hashes
from tallyframe.llm.tokens import piece_starts, tokenizer_path
from tallyframe.session import ship

ship(__name__)

STRETCH = 4 << 20  # bytes of text whose pre-tokens share a trie
NO_PATH = (1 << 62, 0)


def costs(path: str) -> tuple[dict[bytes, int], int]:
    """Cost of each piece of a rank file, and the longest piece. Single bytes are pieces, so every text has a path."""

    def read() -> tuple[dict[bytes, int], int]:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        out = {piece: round(1000 * float(np.log2(rank + 2))) for piece, rank in ranks.items()}
        return out, max(map(len, out))

    return kept(f"costs {path}", read)


def terminal_counts(pretokens: Iterable[bytes], piece_costs: dict[bytes, int], longest: int) -> Iterator[tuple[bytes, int, int]]:
    """(pre-token, tokens, cost) for sorted pre-tokens.

    Sorted order walks the trie depth first: the nodes on the path to the current one are all that is held, with their
    forward scores, and a shared prefix is walked once.
    """
    path = b""
    forward: list[tuple[int, int]] = [(0, 0)]  # least cost up to each node of the path, and its tokens
    get = piece_costs.get
    for word in pretokens:
        shared = 0
        for x, y in zip(path, word):
            if x != y:
                break
            shared += 1
        del forward[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            best = NO_PATH
            for start in range(max(0, end - longest), end):
                cost = get(word[start:end])
                if cost is not None:
                    before = forward[start]
                    way = (before[0] + cost, before[1] + 1)
                    if way < best:
                        best = way
            forward.append(best)
        path = word
        yield word, forward[-1][1], forward[-1][0]


def pretokens(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, pre-token edges, first pre-token of each text) of stretches of text."""
    for low, high in cuts(texts, STRETCH):
        part = texts.slice(low, high - low).cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        edges = np.flatnonzero(piece_starts(data, offsets)) if len(data) else np.zeros(1, np.int64)
        yield low, high, data, edges, np.searchsorted(edges, offsets)


def distinct(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Codes of the pre-tokens, and the distinct ones in sorted order."""
    starts, ends = edges[:-1], edges[1:]
    codes, unique = pd.factorize(word_hashes(data, starts, ends))
    first = np.zeros(len(unique), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    whole = data.tobytes()
    words = [whole[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    order = sorted(range(len(words)), key=words.__getitem__)
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    return place[codes], [words[i] for i in order]


def token_counts(docs: DataFrame, ranks: str) -> DataFrame:
    """``doc_id, n_bytes, n_pretokens, n_tokens, cost``: a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece_costs, longest = costs(ranks)
        for batch in batches:
            for low, high, data, edges, first in pretokens(batch.column(1)):
                codes, words = distinct(data, edges)
                found = [(n, cost) for _, n, cost in terminal_counts(words, piece_costs, longest)]
                stored = np.array(found, np.int64).reshape(-1, 2)[codes]
                sums = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(stored, axis=0)])[first]
                n_bytes = np.diff(np.append(edges, len(data))[first])
                columns = [n_bytes, np.diff(first), *np.diff(sums, axis=0).T.copy()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), *(pa.array(c.astype(np.int64)) for c in columns)],
                    ["doc_id", "n_bytes", "n_pretokens", "n_tokens", "cost"],
                )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_pretokens bigint, n_tokens bigint, cost bigint")


def pretoken_counts(docs: DataFrame, ranks: str) -> DataFrame:
    """``pretoken, times, n_tokens, cost`` of the distinct pre-tokens of all documents."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, edges, _ in pretokens(batch.column(0)):
                codes, words = distinct(data, edges)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(np.bincount(codes, minlength=len(words)))], ["pretoken", "times"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece_costs, longest = costs(ranks)
        for batch in batches:
            found = list(terminal_counts(batch.column(0).to_pylist(), piece_costs, longest))
            columns = [pa.array([f[i] for f in found], pa.int64()) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], ["pretoken", "times", "n_tokens", "cost"])

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(split, "pretoken binary, times bigint")
    whole = parts.groupBy("pretoken").agg(F.sum("times").alias("times"))
    dealt = whole.repartitionByRange("pretoken").sortWithinPartitions("pretoken")
    return dealt.mapInArrow(walk, "pretoken binary, times bigint, n_tokens bigint, cost bigint")


def op3_trie_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{folder}/documents.parquet"), tokenizer_path("byte_bpe_50k.tiktoken"))
