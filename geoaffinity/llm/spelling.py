"""Spelling variants: words one edit apart, found by a dictionary of pairs of trie nodes.

The nodes of the trie of all words and of the trie of all reversed words are numbered. A word of
length l is then a path of prefix nodes p(0) .. p(l) and one of suffix nodes s(0) .. s(l), s(i)
standing for the word from place i on. Two kinds of integer pairs make the dictionary:

* skipped: (p(i), s(i + 1)), the word without its i-th character;
* whole: (p(i), s(i)), the word itself, open at place i for an inserted character.

Words that share a skipped pair differ by one replaced character. A skipped pair of one word that
is a whole pair of another says that the first has one character more. Both are exact: nodes stand
for strings, not for hashes of them. A skip counts as a deletion only at the end of a run of equal
characters, so that a pair of words meets once. At most one word is whole at a pair, and words that
skip at the same pair differ in one character, so a pair has no more rows than the alphabet has
letters, and one. Rows are counted there as a group; no pairs of words are made.

Nodes are numbered without a list of all prefixes, whose length would be the square of a word's:
in sorted order a word's new nodes are those deeper than its common prefix with the word before.
Words are dealt by their first characters, so that the deeper nodes of a task are its own; the
shallow ones are numbered by their characters.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoaffinity.llm.frames import batch_of, columns_of, stored

#: Code points that a word has at least; words are dealt to tasks by so many.
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A form is at least this many times as frequent as its variant.
RATIO = 5
#: One in so many (document, run) has a character deleted.
DAMAGED = 199
#: Distinct words and their characters that a task counts before it passes its counts on.
TASK_WORDS, TASK_CHARACTERS = 200_000, 8_000_000
_BATCH_PAIRS = 200_000

# In Latin-1 every letter of a run is one byte, and every other character becomes a space.
_LETTERS = {*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)}
_TO_RUNS = bytes(b | 32 if 65 <= b <= 90 else b if b in _LETTERS else 32 for b in range(256))

_COUNTS = pa.schema([pa.field("word", pa.string()), pa.field("n", pa.int64())])
_NUMBERED = pa.schema([pa.field("no", pa.int64()), *_COUNTS])
_PATHS = pa.schema(
    [pa.field("no", pa.int64()), pa.field("word", pa.string()), pa.field("prefixes", pa.list_(pa.int64()))]
)
_PAIRS = pa.schema([pa.field(name, pa.int64()) for name in ("p", "s", "no")] + [pa.field("kind", pa.int32())])
#: Kinds of rows of the dictionary: a whole word, a skip, a skip that is a deletion.
WHOLE, SKIPPED, DELETED = 0, 1, 2


def runs(text: str) -> list[bytes]:
    """Maximal runs of [A-Za-zÀ-ÿ], A-Z lowered, one byte (Latin-1) a code point."""
    return text.encode("latin-1", "replace").translate(_TO_RUNS).split()


def document_words(doc_id: int | None, text: str | None) -> Counter:
    """The words of one document with their numbers, some damaged as the hash of id and word says."""
    found: Counter = Counter()
    start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
    for word, n in Counter(runs(text or "")).items():
        utf8 = word if word.isascii() else word.decode("latin-1").encode()
        h = zlib.crc32(utf8, start)
        if h % DAMAGED == 0:
            place = h % len(word)
            word = word[:place] + word[place + 1 :]
        if len(word) >= LEAST_LENGTH:
            found[word] += n
    return found


def count_words(docs: DataFrame) -> DataFrame:
    """Rows (word, n): words of enough code points that occur often enough, over all documents."""

    def batch(totals: dict) -> pa.RecordBatch:
        return batch_of(_COUNTS, [[w.decode("latin-1") for w in totals], list(totals.values())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[bytes, int] = {}
        characters = 0
        for ids, texts in columns_of(batches, 500):
            for doc_id, text in zip(ids, texts, strict=True):
                for word, n in document_words(doc_id, text).items():
                    if word not in totals:
                        characters += len(word)
                        totals[word] = n
                    else:
                        totals[word] += n
                if len(totals) > TASK_WORDS or characters > TASK_CHARACTERS:
                    yield batch(totals)
                    totals, characters = {}, 0
        yield batch(totals)

    columns = docs["doc_id"].cast("long"), docs["text"].cast("string")
    return (
        docs.select(*columns)
        .mapInArrow(rows, "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= LEAST_COUNT)
    )


def numbered(words: DataFrame) -> DataFrame:
    """Rows (no, word, n): numbers that rise with falling n, then with the word."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        following = TaskContext.get().partitionId() << 40  # ranges rise with the partition
        for found, counts in columns_of(batches):
            yield batch_of(_NUMBERED, [list(range(following, following + len(found))), found, counts])
            following += len(found)

    order = F.col("n").desc(), F.col("word")
    return words.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(rows, "no long, word string, n long")


def shallow(start: str) -> int:
    """The number of a node of fewer than LEAST_LENGTH characters, all below U+0100: negative."""
    number = 0
    for character in start:
        number = number << 8 | ord(character)
    return -1 - number


class NodeNumbers:
    """Numbers the nodes along sorted words; of one task.

    Only the path of the last word is kept. A number is the task's, in the high bits, and a
    running one.
    """

    def __init__(self, task: int):
        self.next = task << 40
        self.word = ""
        self.path: list[int] = [shallow("")]

    def of(self, word: str) -> list[int]:
        """The nodes of the word's prefixes, from the empty one to the word."""
        common, most = 0, min(len(word), len(self.word))
        while common < most and word[common] == self.word[common]:
            common += 1
        del self.path[common + 1 :]
        for depth in range(common + 1, len(word) + 1):
            if depth < LEAST_LENGTH:
                self.path.append(shallow(word[:depth]))
            else:
                self.path.append(self.next)
                self.next += 1
        self.word = word
        return list(self.path)


def with_prefix_nodes(words: DataFrame) -> DataFrame:
    """Rows (no, word, prefixes): with the nodes of the trie of all words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = NodeNumbers(TaskContext.get().partitionId())
        for nos, found in columns_of(batches, 500):
            yield batch_of(_PATHS, [nos, found, [numbers.of(w) for w in found]])

    dealt = words.repartition(F.substring("word", 1, LEAST_LENGTH)).sortWithinPartitions("word")
    return dealt.select("no", "word").mapInArrow(rows, "no long, word string, prefixes array<long>")


def pair_rows(no: int, word: str, prefixes: list[int], suffixes: list[int]) -> Iterator[tuple]:
    """The dictionary's rows of one word; suffixes: from the empty one to the word."""
    length = len(word)
    for i in range(length + 1):
        yield prefixes[i], suffixes[length - i], no, WHOLE
    for i in range(length):
        last = i + 1 == length or word[i] != word[i + 1]
        yield prefixes[i], suffixes[length - i - 1], no, DELETED if last else SKIPPED


def pair_dictionary(paths: DataFrame) -> DataFrame:
    """Rows (p, s, no, kind): every pair of a prefix node and a suffix node of every word."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, waiting = NodeNumbers(TaskContext.get().partitionId()), []
        for nos, found, prefixes in columns_of(batches, 500):
            for no, word, path in zip(nos, found, prefixes, strict=True):
                waiting.extend(pair_rows(no, word, path, numbers.of(word[::-1])))
                if len(waiting) > _BATCH_PAIRS:
                    yield batch_of(_PAIRS, [list(c) for c in zip(*waiting, strict=True)])
                    waiting = []
        if waiting:
            yield batch_of(_PAIRS, [list(c) for c in zip(*waiting, strict=True)])

    dealt = (
        paths.withColumn("backwards", F.reverse("word"))
        .repartition(F.substring("backwards", 1, LEAST_LENGTH))
        .sortWithinPartitions("backwards")
    )
    return dealt.select("no", "word", "prefixes").mapInArrow(rows, "p long, s long, no long, kind int")


def near_words(pairs: DataFrame) -> DataFrame:
    """Rows (no, n_near, best): how many words are near, and the least number among them.

    A pair's skips are sorted by number: the first is the best neighbour of all others, the second
    that of the first.
    """
    entry = F.struct("no", "kind")
    groups = (
        pairs.groupBy("p", "s")
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("kind") != WHOLE, entry))).alias("skips"),
            F.min(F.when(F.col("kind") == WHOLE, F.col("no"))).alias("whole"),
        )
        .withColumn("longer", F.filter("skips", lambda x: x["kind"] == DELETED))
    )
    skips, whole, longer = F.col("skips"), F.col("whole"), F.col("longer")

    def of_skip(x, place):
        shorter = F.when(x["kind"] == DELETED, whole)
        other = F.when(place == 0, F.try_element_at(skips, F.lit(2))["no"]).otherwise(skips[0]["no"])
        return F.struct(
            x["no"].alias("no"),
            (F.size(skips) - 1 + shorter.isNotNull().cast("int")).alias("near"),
            F.least(other, shorter).alias("best"),
        )

    of_whole = F.when(
        whole.isNotNull() & (F.size(longer) > 0),
        F.array(F.struct(whole.alias("no"), F.size(longer).alias("near"), F.get(longer, 0)["no"].alias("best"))),
    )
    members = F.concat(F.transform(skips, of_skip), F.coalesce(of_whole, F.array()))
    return (
        groups.filter((F.size(skips) > 1) | ((F.size(skips) > 0) & whole.isNotNull()))
        .select(F.inline(members))
        .filter(F.col("near") > 0)
        .groupBy("no")
        .agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    )


def roots(forms: DataFrame) -> DataFrame:
    """Rows (no, root) for rows (no, form): the last form along the chain.

    Each round a word jumps as far as its present goal has come, so rounds grow with the logarithm
    of the chain. A form is RATIO times as frequent as its word: chains are short and end.
    """
    goals = stored(forms.select("no", F.col("form").alias("root")))
    while True:
        further = goals.select(F.col("no").alias("root"), F.col("root").alias("next"))
        jumped = stored(goals.join(further, "root", "left").select("no", "root", "next"))
        goals = jumped.select("no", F.coalesce("next", "root").alias("root"))
        if jumped.filter(F.col("next").isNotNull()).isEmpty():
            return goals


def group_variants(docs: DataFrame) -> DataFrame:
    """One row for each word of docs (doc_id, text): word, form, root, n, n_near, form_n.

    Words are runs of letters of whole texts, some damaged as the hash of `<doc_id>:<run>` says
    (a null doc_id is written as nothing). Repeated rows count each; null and empty texts hold no
    words; a run of any length is a word. Of equally frequent forms the first in code point order
    is taken. Other columns are not read. Without words the result is empty.
    """
    words = stored(numbered(count_words(docs)))
    near = near_words(pair_dictionary(with_prefix_nodes(words)))
    best = words.select(F.col("no").alias("best"), F.col("n").alias("best_n"))
    form = F.when(F.col("best_n") >= RATIO * F.col("n"), F.col("best"))
    found = stored(
        words.join(near, "no", "left")
        .join(best, "best", "left")
        .select("no", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form_no"))
    )
    forms = found.filter(F.col("form_no").isNotNull())
    ends = roots(forms.select("no", F.col("form_no").alias("form")))

    def names(no: str, word: str) -> DataFrame:
        return words.select(F.col("no").alias(no), F.col("word").alias(word), F.col("n").alias(f"{word}_n"))

    linked = (
        forms.join(names("form_no", "form"), "form_no")
        .join(ends.withColumnRenamed("root", "root_no"), "no")
        .join(names("root_no", "root"), "root_no")
        .select("no", "form", "root", "form_n")
    )
    return found.join(linked, "no", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
