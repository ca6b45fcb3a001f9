"""Byte-pair merging by rank: the vocabulary of a tokenizer file and the exact merge of one word."""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte.

    Printable Latin-1 bytes stand for themselves, the others for the code points from 256 on.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


#: The first unassigned character is U+0378; most texts hold none from there on.
PAST_LATIN = re.compile("[\u0378-\U0010ffff]")


@lru_cache(maxsize=1)
def unassigned() -> re.Pattern:
    """Matches the characters that Python's Unicode tables leave unassigned."""
    free = [unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)]
    ranges, start = [], None
    for c, is_free in enumerate([*free, False]):
        if is_free and start is None:
            start = c
        elif not is_free and start is not None:
            ranges.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return re.compile(f"[{''.join(ranges)}]")


@dataclass(frozen=True)
class MergeTable:
    """A byte-level BPE: symbols by id, ranks of the pairs that merge, special strings.

    symbols: the written form of each id. pairs: (left, right) to rank, by file order. made: the merged
    id of each rank. halves: the pair that makes an id and its rank; single symbols have none.
    first, last: ids of single bytes inside a word and at its end (these differ where a word end
    is marked). special: strings that are one token wherever they stand.
    """

    symbols: dict[int, str]
    ids: dict[str, int]
    pairs: dict[tuple[int, int], int]
    made: list[int]
    halves: dict[int, tuple[int, int, int]]
    first: list[int]
    last: list[int]
    suffix: str
    special: dict[str, int] = field(default_factory=dict)

    def spell(self, word: bytes) -> list[int]:
        """The single-symbol ids of a word in UTF-8."""
        ids = [self.first[b] for b in word]
        if ids:
            ids[-1] = self.last[word[-1]]
        return ids

    def merge(self, word: bytes) -> list[int]:
        return merge(self.spell(word), self.pairs, self.made)


@lru_cache(maxsize=4)
def read_merges(path: str) -> MergeTable:
    """Read a tokenizer file of the byte-level BPE kind."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model = content["model"]
    ids = model["vocab"]
    suffix = model["end_of_word_suffix"] or ""
    pairs, halves, made_by = {}, {}, []
    for rank, (left, right) in enumerate(model["merges"]):
        made = ids[left + right]
        pairs[ids[left], ids[right]] = rank
        made_by.append(made)
        halves.setdefault(made, (ids[left], ids[right], rank))
    letters = byte_letters()
    return MergeTable(
        symbols={n: s for s, n in ids.items()} | {t["id"]: t["content"] for t in content["added_tokens"]},
        ids=ids,
        pairs=pairs,
        made=made_by,
        halves=halves,
        first=[ids[letters[b]] for b in range(256)],
        last=[ids[letters[b] + suffix] for b in range(256)],
        suffix=suffix,
        special={t["content"]: t["id"] for t in content["added_tokens"]},
    )


def merge(ids: list[int], pairs: dict[tuple[int, int], int], made: list[int]) -> list[int]:
    """Merge the pair of least rank, leftmost first, until no pair is left."""
    return _merge_short(ids, pairs, made) if len(ids) <= 48 else _merge_long(ids, pairs, made)


def _merge_short(ids: list[int], pairs: dict[tuple[int, int], int], made: list[int]) -> list[int]:
    """Search all ranks for each merge: quickest for words of a few symbols."""
    get, none = pairs.get, len(made)
    ranks = [get(pair, none) for pair in zip(ids, ids[1:])]
    while ranks:
        rank = min(ranks)
        if rank == none:
            break
        at = ranks.index(rank)
        new = made[rank]
        ids[at : at + 2] = (new,)
        del ranks[at]
        if at:
            ranks[at - 1] = get((ids[at - 1], new), none)
        if at < len(ranks):
            ranks[at] = get((new, ids[at + 1]), none)
    return ids


def _merge_long(ids: list[int], pairs: dict[tuple[int, int], int], made: list[int]) -> list[int]:
    """A queue of pairs over a linked list: n symbols take n log n steps."""
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = [
        (rank, at)
        for at in range(n - 1)
        if (rank := pairs.get((ids[at], ids[at + 1]))) is not None
    ]
    heapq.heapify(queue)
    while queue:
        rank, at = heapq.heappop(queue)
        then = after[at]
        if ids[at] < 0 or then >= n or pairs.get((ids[at], ids[then])) != rank:
            continue  # one of the two has been merged since
        new = made[rank]
        ids[at], ids[then] = new, -1
        after[at] = end = after[then]
        if end < n:
            before[end] = at
            if (rank := pairs.get((new, ids[end]))) is not None:
                heapq.heappush(queue, (rank, at))
        start = before[at]
        if start >= 0 and (rank := pairs.get((ids[start], new))) is not None:
            heapq.heappush(queue, (rank, start))
    return [i for i in ids if i >= 0]


def split_by_library(library, table: MergeTable, piece: str) -> list[str]:
    """The words of a piece of text as the tokenizer's own library splits it.

    For texts with characters of which the Unicode tables here and there may differ.
    """
    if library.normalizer is not None:
        piece = library.normalizer.normalize_str(piece)
    byte_of = {letter: b for b, letter in byte_letters().items()}
    return [
        bytes(byte_of[letter] for letter in word).decode("utf-8")
        for word, _ in library.pre_tokenizer.pre_tokenize_str(piece)
    ]
