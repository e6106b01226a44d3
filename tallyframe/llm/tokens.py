"""Public tokenizers over Arrow batches, each distinct piece of text encoded once per task.

A piece starts where a pre-token of either tokenizer surely starts: at ASCII white space after a word and at ASCII
punctuation after a plain letter. So encoding pieces alone gives the ids of the whole text. Texts with other white
space characters or special tokens in them, where that need not hold, are encoded whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from tallyframe.llm.common import SPACE, cuts, kept, word_hashes
from tallyframe.session import ship

ship(__name__)

END_ID = 2
# Distinct pieces a task remembers before it starts over; bounds its memory, never its result.
REMEMBERED = 700_000
# White space that is not in SPACE, and special tokens.
WHOLE = r"<\|\w+\|>|[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Kinds of bytes: 1 white space, 2 punctuation, 3 letters and digits, 4 parts of longer characters, 0 the rest.
KINDS = np.array([1 if SPACE[b] else 4 if b > 127 else 3 if chr(b).isalnum() else 2 if 32 < b < 127 and b != 39 else 0 for b in range(256)], np.uint8)
# Pieces encoded in one string, apart from each other by the tokenizer's own end marker, and strings in one call.
TOGETHER, STRINGS = 256, 32


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def loaded(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Tokenizer.from_file(path)


class Encoder:
    """Ids of whole texts by a tokenizer file, without special tokens added.

    Pieces seen are remembered under a 64-bit hash, in sorted arrays.
    """

    def __init__(self, path: str):
        self.tokenizer = loaded(path)
        self.marker = "<|endoftext|>"
        self.marker_id = self.tokenizer.token_to_id(self.marker)
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int32)
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.hashes, hashes)
        found = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        found[inside] = self.hashes[at[inside]] == hashes[inside]
        return at, found

    def learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        groups = [pieces[i : i + TOGETHER] for i in range(0, len(pieces), TOGETHER)]
        lengths = []
        joined = [self.marker.join(g) for g in groups]
        calls = (joined[i : i + STRINGS] for i in range(0, len(joined), STRINGS))
        for one in (e.ids for call in calls for e in self.tokenizer.encode_batch_fast(call, add_special_tokens=False)):
            ids = np.array(one, np.int32)
            apart = ids == self.marker_id
            lengths.append(np.diff(np.concatenate([[-1], np.flatnonzero(apart), [len(ids)]])) - 1)
            ids = ids[~apart]
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) // 4 + len(ids), np.int32)])
            self.flat[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
        length = np.concatenate(lengths)
        begin = self.used - length.sum() + np.cumsum(length) - length
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.begin = np.insert(self.begin, at, begin[order])
        self.length = np.insert(self.length, at, length[order])
        self.hashes = np.insert(self.hashes, at, hashes[order])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and one offset per text (and the end). Null is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(texts, WHOLE).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self.encode_plain(texts)
        ids, offsets = self.encode_plain(pc.if_else(pa.array(~odd), texts, ""))
        whole = {i: np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.int32) for i in np.flatnonzero(odd)}
        parts = [whole.get(i, ids[offsets[i] : offsets[i + 1]]) for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def encode_plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if offsets[-1] == offsets[0]:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        edges = np.flatnonzero(piece_starts(data, offsets))  # the last one is the end of the data
        starts, ends = edges[:-1], edges[1:]
        codes, hashes = pd.factorize(word_hashes(data, starts, ends))
        at, found = self.places(hashes)
        if not found.all():
            if len(self.hashes) + len(hashes) > REMEMBERED:
                self.forget()
                found[:] = False
            first = np.zeros(len(hashes), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            new = first[~found]
            self.learn(hashes[~found], [data[a:b].tobytes().decode() for a, b in zip(starts[new].tolist(), ends[new].tolist())])
            at, _ = self.places(hashes)
        begin, lengths = self.begin[at][codes], self.length[at][codes]
        total = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        where = np.arange(total[-1]) + np.repeat(begin - total[:-1], lengths)
        return self.flat[where], total[np.searchsorted(edges, offsets)]


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True where a piece starts: each text, white space after a word, ASCII punctuation after a plain letter or digit.

    The apostrophe is no such punctuation: some pre-tokens hold it together with letters.
    """
    first = np.zeros(len(data) + 1, bool)
    kind = KINDS[data]
    first[1:-1] = (kind[1:] == 1) & (kind[:-1] != 1) | (kind[1:] == 2) & (kind[:-1] == 3)
    latin = (kind[2:] == 2) & (kind[1:-1] == 4) & (data[:-2] == 0xC3) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
    first[2:-1] |= latin
    first[offsets] = True
    return first


def shared_encoder(path: str) -> Encoder:
    """This worker process's encoder for the file; what it remembers serves later tasks too."""
    return kept(f"encoder {path}", lambda: Encoder(path))


def encoded(texts: pa.Array, encoder: Encoder, end_id: int = END_ID, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, offsets) with ``end_id`` after each text."""
    for low, high in cuts(texts, limit):
        ids, offsets = encoder.encode(texts.slice(low, high - low))
        ids = np.insert(ids, offsets[1:], end_id).astype(np.int32)
        yield low, high, ids, offsets + np.arange(len(offsets))
