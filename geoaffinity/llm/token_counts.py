"""Token counts by the whole-token shortcut.

Once, on the driver, every vocabulary string is merged alone; those that come out as themselves
are proven whole. A text is split into pre-tokens as the tokenizer splits it; a pre-token that is
proven whole counts one, and only the rest are merged. The proof holds for any text because the
merge of a pre-token looks at nothing outside it. Pieces of text with characters that Python's
Unicode tables leave unassigned are split by the tokenizer's library, whose tables may differ from
those of the pattern here.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from geoaffinity.llm.frames import batch_of, columns_of, utf8
from geoaffinity.llm.merges import (
    PAST_LATIN,
    MergeTable,
    byte_letters,
    read_merges,
    split_by_library,
    unassigned,
)

#: Fixed value: the pattern by which the tokenizer splits text before merging.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Merged pre-tokens whose counts a Python worker remembers; forgotten all together when full.
REMEMBERED = 500_000

COLUMNS = "n_bytes long, n_tokens long, over_limit boolean, n_whole long, n_merged long"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()),
     ("over_limit", pa.bool_()), ("n_whole", pa.int64()), ("n_merged", pa.int64())]
)


def prove_whole(table: MergeTable) -> frozenset[str]:
    """The pre-tokens that are one token: vocabulary strings that merge alone into themselves.

    Only strings that are whole characters in UTF-8 can be a pre-token; the others are left out.
    """
    byte_of = {letter: b for b, letter in byte_letters().items()}
    whole = set()
    for symbol, token in table.ids.items():
        if any(letter not in byte_of for letter in symbol):
            continue
        raw = bytes(byte_of[letter] for letter in symbol)
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if table.merge(raw) == [token]:
            whole.add(text)
    return frozenset(whole)


class TokenCounter:
    """Counts the tokens of texts; remembers a bounded number of merged pre-tokens."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.path, self.library = path, None
        self.table = table = read_merges(path)
        self.whole = whole
        self.unsure = unassigned()
        self.pre_token = regex.compile(PRE_TOKEN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(table.special, key=len, reverse=True))))
        self.merged: dict[str, int] = {}

    def split(self, piece: str) -> list[str]:
        """The pre-tokens of a piece of text without special strings."""
        if piece.isascii() or not PAST_LATIN.search(piece) or not self.unsure.search(piece):
            return self.pre_token.findall(piece)
        if self.library is None:
            self.library = Tokenizer.from_file(self.path)
        return split_by_library(self.library, self.table, piece)

    def count(self, text: str) -> tuple[int, int, int]:
        """(tokens, pre-tokens counted whole, pre-tokens merged) of one text."""
        specials, pieces = 0, [text]
        if self.table.special and self.special.search(text):
            pieces = self.special.split(text)
            specials = len(pieces) - 1
        counts: Counter[str] = Counter()
        for piece in pieces:
            counts.update(self.split(piece))
        shortcut = tokens = merged = 0
        for pre_token, times in counts.items():
            if pre_token in self.whole:
                shortcut += times
                continue
            length = self.merged.get(pre_token)
            if length is None:
                length = len(self.table.merge(utf8(pre_token)))
                if len(self.merged) >= REMEMBERED:
                    self.merged.clear()
                if len(pre_token) < 64:
                    self.merged[pre_token] = length
            tokens += length * times
            merged += times
        return specials + shortcut + tokens, shortcut, merged


_COUNTERS: dict[str, TokenCounter] = {}


def _counter(path: str, whole: frozenset[str]) -> TokenCounter:
    """The worker's counter, which later tasks of the worker use again."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path, whole)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """One row per row of docs (doc_id, text): bytes, tokens, whether over the limit.

    tokenizer_path: a file that all executors find at this path. Null texts count as empty: no
    bytes, no tokens. A null doc_id stays null; repeated rows are counted each; other columns are
    not read. An empty table gives an empty result. The proof set is broadcast: it is bounded by
    the vocabulary.
    """
    spark = docs.sparkSession
    whole = spark.sparkContext.broadcast(prove_whole(read_merges(tokenizer_path)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer_path, whole.value)
        for ids, texts in columns_of(batches):
            counted = [counter.count(text or "") for text in texts]
            tokens, shortcut, merged = map(list, zip(*counted, strict=True))
            sizes = [len(utf8(text)) for text in texts]
            yield batch_of(_ARROW, [ids, sizes, tokens, [n > limit for n in tokens], shortcut, merged])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(
        rows, f"doc_id long, {COLUMNS}"
    )
