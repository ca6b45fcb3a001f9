"""Quality rules, line first: judge every line, remove the failures, reject texts that lose too much.

Each line that holds a word is tested by three rules.

* navigation: at least three separator words (`|`, `>`, `/` and the like), making up a tenth of
  the line's words;
* boilerplate: a phrase of consent notices, licence headers, site furniture or filler text;
* punctuation: more symbol characters than a third of its words, or no letter or digit at all, or
  more than `longest_unended` words without any sentence mark.

Lines that fail are removed. A text is kept when its base is sound and the removed words are at
most `most_lost` percent of its words. Lines without words are removed without loss.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from geoaffinity.llm.frames import batch_of, columns_of, utf8

WINDOW = 5
SEPARATORS = frozenset(
    s.encode() for s in ("|", "||", ">", ">>", "/", "//", "::", "»", "›", "•", "·", "→", "«")
)
BOILERPLATE = tuple(
    phrase.encode()
    for phrase in (
        "all rights reserved", "terms of use", "terms of service", "privacy policy",
        "cookie policy", "cookie settings", "use cookies", "uses cookies", "accept cookies",
        "accept all cookies", "enable javascript", "javascript is disabled",
        "javascript is required", "lorem ipsum", "subscribe to our newsletter",
        "sign up for our newsletter", "click here to", "skip to content",
        "skip to main content", "back to top", "powered by", "copyright (c)",
        "permission is hereby granted", "licensed under the", "spdx-license-identifier",
        "without warranty of any kind", "redistribution and use in source",
    )
)
SYMBOLS = re.compile(rb"[#*$%&|<>]")
SENTENCE_MARK = re.compile("[.!?…:;,。！？；：،۔؟।]")
LETTER_OR_DIGIT = re.compile(r"[^\W_]")
CONTINUATION_BYTE = re.compile(rb"[\x80-\xbf]")

COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, n_navigation long, n_boilerplate long, "
    "n_punctuation long, lost_words long"
)
_ARROW = pa.schema(
    [pa.field("doc_id", pa.int64())]
    + [pa.field(c.split()[0], pa.bool_() if c.endswith("boolean") else pa.int64()) for c in COLUMNS.split(", ")]
)


def repeated_words(found: list[bytes]) -> int:
    """Words inside 5-word windows that occur twice or more, the first occurrence included.

    Windows are compared exactly: words are numbered by first position, and pairs and pairs of pairs renumbered, so
    that a window is one number and memory stays a few numbers a word.
    """
    if len(found) <= WINDOW:
        return 0
    first: dict[bytes, int] = {}
    ids = np.fromiter(map(first.setdefault, found, count()), np.int64, len(found))
    _, pair = np.unique(ids[:-1] * len(found) + ids[1:], return_inverse=True)
    _, four = np.unique(pair[:-2] * (int(pair.max()) + 1) + pair[2:], return_inverse=True)
    if int(four.max()) == len(four) - 1:  # no four words occur twice
        return 0
    _, five, times = np.unique(
        four[:-1] * len(found) + ids[4:], return_inverse=True, return_counts=True
    )
    starts = np.flatnonzero(times[five] > 1)
    edges = np.zeros(len(found) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int((np.cumsum(edges) > 0).sum())


def failed_rule(
    line: bytes, found: list[bytes], phrases: list[bytes], longest_unended: int
) -> str | None:
    """The first rule that a line with words fails, if any; phrases: those the text holds."""
    if not SEPARATORS.isdisjoint(found):
        separators = sum(w in SEPARATORS for w in found)
        if separators >= 3 and 10 * separators >= len(found):
            return "navigation"
    if phrases:
        lower = line.lower()
        if any(phrase in lower for phrase in phrases):
            return "boilerplate"
    if 3 * len(SYMBOLS.findall(line)) > len(found):
        return "punctuation"
    text = line.decode("utf-8", "replace")
    if not LETTER_OR_DIGIT.search(text):
        return "punctuation"
    if len(found) > longest_unended and not SENTENCE_MARK.search(text):
        return "punctuation"
    return None


def judge(text: str | None, most_lost: int = 50, longest_unended: int = 200) -> tuple:
    """The values of COLUMNS for one text; a null text counts as empty."""
    raw = utf8(text)
    found = raw.split()
    n_words = len(found)
    dup_lines, seen = 0, set()
    failures = {"navigation": 0, "boilerplate": 0, "punctuation": 0}
    lines = lost = 0
    lower = raw.lower()
    phrases = [phrase for phrase in BOILERPLATE if phrase in lower]
    for line in raw.split(b"\n"):
        of_line = line.split()
        if not of_line:
            continue
        lines += 1
        if line in seen:
            dup_lines += 1
        seen.add(line)
        if rule := failed_rule(line, of_line, phrases, longest_unended):
            failures[rule] += 1
            lost += len(of_line)
    chars = sum(map(len, found))
    if not raw.isascii():
        chars -= len(CONTINUATION_BYTE.findall(raw))
    repeated = repeated_words(found)
    base_failed = n_words < 10 or 100 * repeated > 20 * n_words
    kept = not base_failed and 100 * lost <= most_lost * n_words
    return (
        n_words, chars, len(SYMBOLS.findall(raw)), dup_lines, repeated, base_failed, kept,
        lines, *failures.values(), lost,
    )


def judge_lines(docs: DataFrame, most_lost: int = 50, longest_unended: int = 200) -> DataFrame:
    """One row per row of docs (doc_id, text): base counts, failures by rule, verdict.

    Null and empty texts have no words, so their base fails. A null doc_id stays null; repeated
    rows are judged each; other columns are not read. An empty table gives an empty result.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in columns_of(batches):
            judged = [judge(text, most_lost, longest_unended) for text in texts]
            yield batch_of(_ARROW, [ids, *([list(c) for c in zip(*judged, strict=True)])])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(
        rows, f"doc_id long, {COLUMNS}"
    )
