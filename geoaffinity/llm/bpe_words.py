"""BPE encoding and decoding by speculation and verification.

Encoding: a text is normalised and split into words. The new words of a chunk of texts are cut
greedily into their longest vocabulary strings. All adjacent pairs of these cuts are tested at
once, as arrays: the cut of a word is its exact encoding if and only if no pair would have merged
across its border. Words that hold a failing pair are merged exactly.

The test of a pair (a, b) runs the merges of a and b backwards. At each point in time one symbol
ends at the border and one begins there; if these two merge at a rank below that of the next merge
on either side, the border would have been merged over. Of equal ranks the left merge comes first.

Decoding: the written forms of the ids, joined by one space (the tokenizer has no decoder of its
own, so the library does the same).
"""

from __future__ import annotations

import hashlib
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from geoaffinity.llm.frames import batch_of, small_columns_of, utf8
from geoaffinity.llm.merges import PAST_LATIN, MergeTable, read_merges, split_by_library, unassigned

#: Fixed value: the pattern of a word; text between words is dropped.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Encoded words that a Python worker remembers, and characters of the longest among them;
#: forgotten all together when full.
REMEMBERED, LONGEST = 150_000, 64
#: Characters of text whose words are encoded at once.
CHUNK = 1_000_000

_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
     ("decoded_sha256", pa.string()), ("n_words", pa.int64())]
)
_NO_RANK = np.iinfo(np.int64).max


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def lower(text: str) -> str:
    """Lower case character by character, without rules that look at neighbours."""
    return text.replace("Σ", "σ").lower()


class PairTest:
    """Tests many adjacent token pairs at once."""

    def __init__(self, table: MergeTable):
        size = max(table.symbols) + 1
        self.size = size
        self.rank = np.full(size, -1, np.int64)  # single symbols are there from the start
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for made, (left, right, rank) in table.halves.items():
            self.rank[made], self.left[made], self.right[made] = rank, left, right
        keys = np.array([a * size + b for a, b in table.pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.array(list(table.pairs.values()), np.int64)[order]

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NO_RANK)

    def stays_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair is the encoding of its joined string."""
        good = np.ones(len(a), bool)
        todo = np.arange(len(a))
        a, b = a.copy(), b.copy()
        # the border merges if its rank is under this bound
        bound = np.full(len(a), _NO_RANK, np.int64)
        while len(todo):
            merges = self.merge_rank(a, b) < bound
            good[todo[merges]] = False
            ra, rb = self.rank[a], self.rank[b]
            more = ~merges & ((ra >= 0) | (rb >= 0))
            todo, a, b, ra, rb = todo[more], a[more], b[more], ra[more], rb[more]
            undo_left = ra > rb  # what was merged last is undone first
            bound = np.where(undo_left, ra, rb + 1)
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
        return good


class WordEncoder:
    """Encodes texts; remembers a bounded number of words."""

    def __init__(self, path: str):
        self.path, self.library = path, None
        self.table = table = read_merges(path)
        self.unsure = unassigned()
        self.pair_test = PairTest(table)
        self.longest = max(map(len, table.ids))
        self.word = regex.compile(WORD)
        self.special = re.compile("(" + "|".join(map(re.escape, table.special)) + ")")
        self.letters = {b: table.symbols[i] for b, i in enumerate(table.first)}
        self.exact = 0
        # no word is a special string: texts are parted there before words are looked for
        self.special_form = {s: (packed([i]), s) for s, i in table.special.items()}
        self.known: dict[str, tuple[bytes, str]] = dict(self.special_form)

    def speculate(self, spelled: str) -> list[int]:
        """Longest vocabulary strings from left to right; only the last may carry the word end."""
        ids, end, suffix, longest = self.table.ids, len(spelled), self.table.suffix, self.longest
        found, at = [], 0
        while at < end:
            if end - at <= longest:
                token = ids.get(spelled[at:] + suffix)
                if token is not None:
                    found.append(token)
                    return found
            stop = min(at + longest, end - 1)
            while (token := ids.get(spelled[at:stop])) is None:
                stop -= 1
            found.append(token)
            at = stop
        return found

    def learn(self, words: list[str]) -> None:
        """Encode words: speculate, test all pairs at once, merge exactly where a pair fails."""
        raws = [utf8(word) for word in words]
        letters = self.letters
        cuts = [self.speculate("".join([letters[b] for b in raw])) for raw in raws]
        sizes = np.fromiter(map(len, cuts), np.int64, len(cuts))
        flat = np.fromiter((t for cut in cuts for t in cut), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(cuts)), sizes)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, which = np.unique(
            flat[inside] * self.pair_test.size + flat[inside + 1], return_inverse=True
        )
        good = self.pair_test.stays_apart(pairs // self.pair_test.size, pairs % self.pair_test.size)
        failing = set(owner[inside[~good[which]]].tolist())
        symbols = self.table.symbols
        for n, word in enumerate(words):
            ids = self.table.merge(raws[n]) if n in failing else cuts[n]
            self.known[word] = (packed(ids), " ".join([symbols[i] for i in ids]))
        self.exact += len(failing)

    def split(self, text: str) -> list[str]:
        """The words of a text and its special strings, in order."""
        found: list[str] = []
        for n, piece in enumerate(self.special.split(text) if "<|" in text else (text,)):
            if n % 2:
                found.append(piece)
                continue
            if not piece.isascii() and PAST_LATIN.search(piece) and self.unsure.search(piece):
                found += self.split_by_library(piece)
                continue
            if not piece.isascii():
                piece = unicodedata.normalize("NFC", piece)
            found += self.word.findall(lower(piece))
        return found

    def split_by_library(self, piece: str) -> list[str]:
        """The same for texts with characters that Python's older Unicode tables do not know."""
        if self.library is None:
            self.library = Tokenizer.from_file(self.path)
        return split_by_library(self.library, self.table, piece)

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str, int]]:
        """For each text: its ids as little-endian 32-bit integers, its decoded text, its words."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
            known.update(self.special_form)
        split = [self.split(text) for text in texts]
        new = {word for found in split for word in found}.difference(known)
        if new:
            self.learn(sorted(new))
        for found in split:
            parts = [known[word] for word in found]
            yield b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts]), len(found)
        for word in new:
            if len(word) > LONGEST:
                del known[word]

    def forget(self) -> None:
        """Forget all words. A worker outlives its task, and later stages need its memory."""
        self.known = dict(self.special_form)


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    start = size = 0
    for n, text in enumerate(texts):
        size += len(text)
        if size > CHUNK:
            yield texts[start : n + 1]
            start, size = n + 1, 0
    if start < len(texts):
        yield texts[start:]


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    """The worker's encoder, which later tasks of the worker use again, without the words."""
    return WordEncoder(path)


def encoded_rows(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """The rows of a task (doc_id, text), encoded; its words are forgotten in the end."""
    encoder = _encoder(path)
    try:
        for ids, texts in small_columns_of(batches):
            tokens, id_hashes, text_hashes, words = [], [], [], []
            for chunk in _chunks([text or "" for text in texts]):
                for raw, decoded, found in encoder.encode(chunk):
                    tokens.append(len(raw) // 4)
                    id_hashes.append(hashlib.sha256(raw).hexdigest())
                    text_hashes.append(hashlib.sha256(utf8(decoded)).hexdigest())
                    words.append(found)
            yield batch_of(_ARROW, [ids, tokens, id_hashes, text_hashes, words])
    finally:
        encoder.forget()


def encode_and_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per row of docs (doc_id, text): tokens, hashes of the ids and of the decoded text.

    tokenizer_path: a file that all executors find at this path. Null texts count as empty: no
    tokens, the hashes of nothing. A null doc_id stays null; repeated rows are encoded each; other
    columns are not read. An empty table gives an empty result.
    """
    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(
        lambda batches: encoded_rows(batches, tokenizer_path),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_words long",
    )
