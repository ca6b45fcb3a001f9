"""Main text of web pages by a linear-chain conditional random field over their leaf blocks.

Each block is article text or not. Its features are the tags around it, the words of the class, id
and role attributes around it, and properties of its text; neighbours are tied by transition
weights. The field is trained by the gradient of its log-likelihood (forward-backward) and decoded
by Viterbi.

Labelled pages: the training pages are at most FIT_PAGES of the table's own, those with the
smallest hash of page_id among pages of at most FIT_CHARS
characters and FIT_BLOCKS blocks whose markup names its parts
(an article or main element, or a class that says so). Each block is labelled by the innermost such
name. Every training page is also learnt in a second form, in which a rule built into this module
sets its article among other furniture (sidebar, notice, comments, form, banner) under other names,
and with a third of the names left out, so that weight also falls on text and neighbours.
"""

from __future__ import annotations

import random
from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoaffinity.llm.frames import batch_of, columns_of, smallest_hashes
from geoaffinity.llm.html_blocks import Block, leaf_blocks

FIT_PAGES = 300
FIT_BLOCKS = 400
FIT_CHARS = 200_000
FEATURES = 1 << 14
#: Names in tags, classes, ids and roles that tell an article from its surroundings.
ARTICLE_NAMES = frozenset("article main articlebody entry post story content".split())
OTHER_NAMES = frozenset(
    "nav navigation navbar menu breadcrumb breadcrumbs header banner masthead footer contentinfo aside sidebar complementary ad ads advert adverts advertisement sponsor sponsored promo form search login newsletter subscribe comment comments discussion disqus reply replies cookie cookies consent notice alert popup modal share social related recommended widget pagination pager toolbar copyright".split()
)
_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_blocks", pa.int64()), ("n_kept", pa.int64())])
_SAMPLE_ARROW = pa.schema([("place", pa.int64()), ("page_id", pa.int64()), ("html", pa.string())])


def _bucket(name: str) -> int:
    return xxhash.xxh32_intdigest(name) % FEATURES


class _Buckets(dict):
    def __missing__(self, name: str) -> int:
        if len(self) > 50_000:
            self.clear()
        self[name] = found = _bucket(name)
        return found


_BUCKETS = _Buckets()


def features(blocks: list[Block]) -> list[np.ndarray]:
    """The feature buckets of each block of a page."""
    rows = []
    for n, block in enumerate(blocks):
        text, words = block.text, block.text.count(" ") + 1
        names = ["bias", f"words {min(words.bit_length(), 7)}", f"links {min(4, 4 * block.linked // len(text))}"]
        names += [f"tag {tag}" for tag in set(block.tags)]
        names += [f"name {name}" for name in set(block.names)]
        if block.tags:
            names.append(f"leaf {block.tags[-1]}")
        names.append(f"end {text[-1] in '.!?…。！？”\"'}")
        names.append(f"commas {min(3, text.count(','))}")
        names.append(f"place {10 * n // len(blocks)}")
        if "©" in text or "cookie" in text.lower():
            names.append("notice")
        if n == 0 or n == len(blocks) - 1:
            names.append("edge")
        rows.append(np.array([_BUCKETS[name] for name in names], np.int32))
    return rows


@dataclass(frozen=True)
class ChainModel:
    """weights: (FEATURES, 2), for other and article. moves: (2, 2), from label to label."""

    weights: np.ndarray
    moves: np.ndarray

    def states(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[row].sum(axis=0) for row in rows])

    def decode(self, rows: list[np.ndarray]) -> list[int]:
        """The likeliest labels of a page's blocks (Viterbi)."""
        if not rows:
            return []
        states = self.states(rows).tolist()
        (oo, oa), (ao, aa) = self.moves.tolist()
        other, article = states[0]
        back = []
        for state_other, state_article in states[1:]:
            from_other, from_article = other + oo >= article + ao, other + oa >= article + aa
            back.append((0 if from_other else 1, 0 if from_article else 1))
            other, article = (
                (other + oo if from_other else article + ao) + state_other,
                (other + oa if from_article else article + aa) + state_article,
            )
        labels = [0 if other >= article else 1]
        for choice in reversed(back):
            labels.append(choice[labels[-1]])
        return labels[::-1]


def _log_add(a: np.ndarray, axis: int) -> np.ndarray:
    most = a.max(axis=axis)
    return most + np.log(np.exp(a - np.expand_dims(most, axis)).sum(axis=axis))


def marginals(states: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of each block, and expected counts of each move, by forward-backward."""
    n = len(states)
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    forward[0] = states[0]
    for i in range(1, n):
        forward[i] = _log_add(forward[i - 1][:, None] + moves, 0) + states[i]
    for i in range(n - 2, -1, -1):
        backward[i] = _log_add(moves + (states[i + 1] + backward[i + 1])[None, :], 1)
    total = _log_add(forward[-1], 0)
    blocks = np.exp(forward + backward - total)
    pairs = forward[:-1, :, None] + moves[None] + (states[1:] + backward[1:])[:, None, :] - total
    return blocks, np.exp(pairs).sum(axis=0)


def fit_chain(pages: list[tuple[list[np.ndarray], list[int]]], passes: int = 6, rate: float = 0.2, decay: float = 1e-3) -> ChainModel:
    """Maximise the log-likelihood of labelled pages by adaptive gradient steps in their order."""
    weights, moves = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    squares, move_squares = np.full((FEATURES, 2), 1e-3), np.full((2, 2), 1e-3)
    for _ in range(passes):
        for rows, labels in pages:
            if not rows:
                continue
            flat = np.concatenate(rows)
            owner = np.repeat(np.arange(len(rows)), [len(row) for row in rows])
            states = np.array([weights[row].sum(axis=0) for row in rows])
            truth = np.zeros((len(rows), 2))
            truth[np.arange(len(rows)), labels] = 1
            expected, expected_moves = marginals(states, moves)
            gradient = np.zeros((FEATURES, 2))
            np.add.at(gradient, flat, (truth - expected)[owner])
            touched = np.unique(flat)
            step = gradient[touched] - decay * weights[touched]
            squares[touched] += np.square(step)
            weights[touched] += rate * step / np.sqrt(squares[touched])
            seen = np.zeros((2, 2))
            np.add.at(seen, (labels[:-1], labels[1:]), 1)
            step = seen - expected_moves - decay * moves
            move_squares += np.square(step)
            moves += rate * step / np.sqrt(move_squares)
    return ChainModel(weights, moves)


def labels_by_markup(blocks: list[Block]) -> list[int] | None:
    """Article or other, by the names around each block; None where no name marks an article."""
    labels, marked = [], False
    for block in blocks:
        names = {*block.tags, *block.names}
        other = bool(names & OTHER_NAMES)
        article = bool(names & ARTICLE_NAMES)
        marked |= article
        labels.append(int(article and not other))
    return labels if marked else None


def other_form(blocks: list[Block], labels: list[int], chance: random.Random) -> tuple[list[Block], list[int]]:
    """A training page in another layout: its article under other names, among other furniture."""
    article = [b for b, label in zip(blocks, labels, strict=True) if label]
    frame = chance.choice((("div", "content"), ("div", "post"), ("main", ""), ("section", "entry"), ("article", ""), ("div", "")))
    outer = ("html", "body", frame[0])
    named = (frame[1],) if frame[1] and chance.random() > 0.33 else ()
    body = [Block(b.text, (*outer, b.tags[-1] if b.tags else "p"), named, b.linked if b.linked < len(b.text) else 0) for b in article]
    spoken = [w for b in blocks for w in b.text.split()][:400] or ["text"]

    def words(low: int, high: int) -> str:
        return " ".join(chance.choices(spoken, k=chance.randint(low, high)))

    def part(tag: str, name: str, leaf: str, count: int, low: int, high: int, links: bool) -> list[Block]:
        names = (name,) if name and chance.random() > 0.33 else ()
        tag = tag if names or tag != "div" else chance.choice(("aside", "header", "footer", "form"))
        texts = [words(low, high) for _ in range(count)]
        return [Block(t, ("html", "body", tag, leaf), names, len(t) if links else 0) for t in texts]

    before = [("header", "masthead", "div", 1, 1, 6, False), ("nav", "menu", "li", 6, 1, 2, True), ("div", "cookie", "p", 1, 6, 20, False), ("div", "banner", "div", 1, 2, 9, False), ("ul", "breadcrumb", "li", 3, 1, 2, True), ("div", "ad", "div", 1, 3, 15, False), ("form", "search", "label", 2, 1, 3, False), ("div", "notice", "p", 1, 5, 25, False)]
    after = [("aside", "sidebar", "li", 5, 2, 8, True), ("div", "comments", "p", 4, 5, 40, False), ("section", "comment", "div", 3, 4, 30, False), ("form", "newsletter", "label", 2, 1, 8, False), ("div", "related", "li", 4, 2, 9, True), ("div", "share", "li", 3, 1, 2, True), ("footer", "", "div", 2, 3, 12, False), ("div", "advert", "p", 1, 3, 20, False)]
    top = [b for kind in before if chance.random() < 0.4 for b in part(*kind)]
    bottom = [b for kind in after if chance.random() < 0.4 for b in part(*kind)]
    return [*top, *body, *bottom], [0] * len(top) + [1] * len(body) + [0] * len(bottom)


def fit_extractor(pages: DataFrame, fit_pages: int = FIT_PAGES) -> ChainModel:
    """Fit on a bounded sample of the pages themselves; only where no page of the table names its
    article, on a page of one paragraph and one menu."""

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the task's pages that can be learnt from, those with the smallest hash."""
        best: list[tuple] = []  # in order
        for columns in columns_of(batches):
            for row in zip(*columns, strict=True):
                if len(best) == fit_pages and row >= best[-1]:
                    continue
                blocks = leaf_blocks(row[2])
                if blocks and len(blocks) <= FIT_BLOCKS and labels_by_markup(blocks):
                    insort(best, row)
                    del best[fit_pages:]
        yield pa.RecordBatch.from_arrays(
            [pa.array(column, field.type) for column, field in zip(zip(*best), _SAMPLE_ARROW, strict=True)] if best
            else [pa.array([], field.type) for field in _SAMPLE_ARROW],
            schema=_SAMPLE_ARROW,
        )

    order = ["place", "page_id", "html"]
    readable = (
        pages.select(F.xxhash64(pages["page_id"].cast("long")).alias("place"), pages["page_id"].cast("long").alias("page_id"), pages["html"].cast("string").alias("html"))
        .filter(F.col("page_id").isNotNull() & (F.length("html") <= FIT_CHARS))
    )

    def smallest(some: DataFrame) -> list:
        return some.mapInArrow(usable, "place long, page_id long, html string").orderBy(*order).limit(fit_pages).collect()

    # pages of small hashes first, eight times as many while too few can be learnt from: so the
    # tasks together send a bounded number of pages, however many there are
    total, asked = pages.filter(F.col("page_id").isNotNull()).count(), 2 * fit_pages
    while True:
        chosen, share = smallest_hashes(F.col("place"), asked, total)
        rows = smallest(readable.filter(chosen))
        if len(rows) >= fit_pages or share >= 1:
            break
        asked *= 8
    chance = random.Random(9)
    training = []
    for row in sorted(rows, key=lambda row: (row["page_id"], row["html"])):
        blocks = leaf_blocks(row["html"])
        labels = labels_by_markup(blocks) or []
        training.append((features(blocks), labels))
        blocks, labels = other_form(blocks, labels, chance)
        training.append((features(blocks), labels))
    if not training:
        plain = [Block("Menu", ("nav", "li"), (), 4), Block("One sentence of text.", ("article", "p"), (), 0)]
        training.append((features(plain), [0, 1]))
    return fit_chain(training)


def main_text(html: str | None, model: ChainModel) -> tuple[str, int, int]:
    """The article text of a page, its number of blocks and of kept blocks."""
    blocks = leaf_blocks(html)
    labels = model.decode(features(blocks))
    kept = [block.text for block, label in zip(blocks, labels, strict=True) if label]
    return " ".join(kept), len(blocks), len(kept)


def extract_pages(pages: DataFrame, fit_pages: int = FIT_PAGES) -> DataFrame:
    """One row per row of pages (page_id, url, html): text, n_chars, n_blocks, n_kept.

    Null and empty pages give an empty text. Null ids and urls stay null; repeated rows are
    extracted each; other columns are not read. An empty table gives an empty result.
    """
    model = pages.sparkSession.sparkContext.broadcast(fit_extractor(pages, fit_pages))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, urls, htmls in columns_of(batches):
            found = [main_text(html, model.value) for html in htmls]
            texts, blocks, kept = map(list, zip(*found, strict=True))
            yield batch_of(_ARROW, [ids, urls, texts, [len(t) for t in texts], blocks, kept])

    return pages.select(
        pages["page_id"].cast("long"), pages["url"].cast("string"), pages["html"].cast("string")
    ).mapInArrow(rows, "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")
