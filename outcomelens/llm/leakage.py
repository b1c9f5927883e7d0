"""Evaluation passages inside training texts.

All word n-grams of a passage are its seeds, however many items share them. A text that shares as many 3-grams and
2-grams with a passage as any leak has (below) is aligned with it word by word (Smith-Waterman, local). Of the best
alignment the coherent stretches are taken (at least LEAST_WORDS matching words that are a share of IDENTITY of the
columns), their words are masked, and so on until no alignment has LEAST_WORDS matches. The pair is a leak if its stretches
hold at least SHARE of the words of the item's passage. Words are compared without layout, case, punctuation, markup and
escapes; reordered sentences align as stretches of their own, changed words inside them as mismatches.

Items with the same passage are one class, searched and aligned once; its members all come out. The passages travel as an
index that is broadcast, and a text is searched and aligned where it is read: no text is shuffled, and a text or passage
that leaks much is only work of its own task. Passages beyond FILTER_BOUND characters are split into blocks that fit, each
one pass over the corpus, with the same rows. Whole texts are searched; only the surroundings of shared n-grams are aligned.

What is left out before the alignment cannot be a leak:
* With m matches a stretch has at most m // 3 other columns, so its matches fall into at most m // 3 + 1 unbroken runs,
  which hold at least m - (n - 1) (m // 3 + 1) n-grams; from LEAST_WORDS matches on one run has three words. Of a passage
  of fewer words a stretch has all, hence a whole 2-gram, or the only word.
* A stretch of m matches scores at least 3 m where it ends, and the ends of two stretches lie LEAST_WORDS apart, so the
  best scores of the columns bound what all stretches of a text hold together. These scores are computed for many texts at
  once and need one row of the score matrix.

An edit of every third word leaves an identity below IDENTITY and is no match by definition; so is a passage of which less
than SHARE is left. A traceback keeps every k-th row of its score matrix and computes the rest again, so a passage of n
words takes memory of order n ** 1.5, whatever the text. Null and empty texts or passages leak nothing. Repeated document
rows come out once.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from outcomelens.llm.words import Hashes, bare_words

LEAST_WORDS = 8
IDENTITY = 0.75
BREAK = 4
SHARE = 0.25
MATCH, MISMATCH, GAP = 4, -3, -3
FILTER_BOUND = 8_000_000  # characters of passages in one broadcast index (some seven bytes each)
CELLS = 4_000_000  # cells of a score matrix that are kept at once
COLUMNS = 1_000_000  # text words aligned with one passage at once


def _held(matches: int, n: int) -> int:
    """The least number of whole n-grams in a stretch of so many matches."""
    return max(int(n <= 3), matches - (n - 1) * (matches // 3 + 1))


@functools.cache
def _needed(words: int, n: int) -> int:
    """The least number of n-grams in stretches of LEAST_WORDS matches or more that hold so many words together."""
    least = [0] * (words + 1)
    for k in range(1, words + 1):
        least[k] = min(_held(m, n) + least[max(0, k - m)] for m in range(LEAST_WORDS, max(k, LEAST_WORDS) + 1))
    return least[words]


def _gram(length: int) -> int:
    """The n-gram that every stretch of a passage of so many words holds at least one of."""
    return 3 if length >= LEAST_WORDS else min(2, length)


def _filters(length: int) -> list[tuple[int, int]]:
    """(n, need): a passage of so many words is a candidate where a text has at least `need` of its n-grams, for each n."""
    if length < LEAST_WORDS:
        return [(_gram(length), 1)]
    return [(n, _needed(math.ceil(SHARE * length), n)) for n in (3, 2)]


# ---- the index of a block of passages


def _places(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where each value stands among the sorted distinct ones, -1 where it does not."""
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return np.where(sorted_values[at] == values, at, -1)


@dataclass
class Grams:
    """The n-grams of one size: distinct, sorted; where the rows of each begin; the passages and times of the rows; and how
    many of its grams each passage needs (zero where it has none of this size)."""

    size: int
    grams: np.ndarray
    starts: np.ndarray
    owner: np.ndarray
    times: np.ndarray
    need: np.ndarray

    def enough(self, text: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The pairs (text, passage), as one sorted number each, in which the text has enough of these grams. The texts lie
        in one row; owner: the text of each word."""
        grams = Hashes.roll(text, self.size)
        first = owner[: len(grams)]
        at = _places(self.grams, grams)
        hit = np.flatnonzero((at >= 0) & (first == owner[self.size - 1 :]))
        texts, at = np.divmod(np.unique(first[hit] * len(self.grams) + at[hit]), len(self.grams))
        many = self.starts[at + 1] - self.starts[at]
        rows = np.repeat(self.starts[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
        pairs, place = np.unique(np.repeat(texts, many) * len(self.need) + self.owner[rows], return_inverse=True)
        return pairs[np.bincount(place, self.times[rows], len(pairs)) >= self.need[pairs % len(self.need)]]


@dataclass
class Index:
    classes: np.ndarray
    passages: list[np.ndarray]  # word hashes
    sizes: list[Grams]

    def near(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        """(text, passage) where the text has enough of the passage's grams of every size it has."""
        sizes = sum((g.need > 0).astype(int) for g in self.sizes)
        begin = 0
        while begin < len(texts):
            stop, words = begin + 1, len(texts[begin])
            while stop < len(texts) and words + len(texts[stop]) <= COLUMNS:
                words += len(texts[stop])
                stop += 1
            text, owner = np.concatenate(texts[begin:stop]), np.repeat(np.arange(stop - begin), [len(t) for t in texts[begin:stop]])
            pairs, times = np.unique(np.concatenate([g.enough(text, owner) for g in self.sizes]), return_counts=True)
            pairs = pairs[times == sizes[pairs % len(sizes)]]
            yield from zip((begin + pairs // len(sizes)).tolist(), (pairs % len(sizes)).tolist())
            begin = stop


def index(rows: pa.Table) -> Index:
    """The index of (class_id, passage); passages without words are left out."""
    hashes, classes, passages, seeds = Hashes(), [], [], {}
    for ident, text in zip(rows.column("class_id").to_pylist(), rows.column("passage").to_pylist()):
        codes = hashes.words(bare_words(text))
        if not len(codes):
            continue
        for n, need in _filters(len(codes)):
            grams, times = np.unique(Hashes.roll(codes, n), return_counts=True)
            seeds.setdefault(n, []).append((len(classes), need, grams, times))
        classes.append(ident)
        passages.append(codes)
    sizes = []
    for n in sorted(seeds):
        owner = np.concatenate([np.full(len(g), k, np.int32) for k, _, g, _ in seeds[n]])
        grams, times = np.concatenate([g for _, _, g, _ in seeds[n]]), np.concatenate([t.astype(np.int32) for *_, t in seeds[n]])
        order = np.argsort(grams, kind="stable")
        distinct, starts = np.unique(grams[order], return_index=True)
        need = np.zeros(len(classes), np.int64)
        for k, least, _, _ in seeds[n]:
            need[k] = least
        sizes.append(Grams(n, distinct, np.r_[starts, len(order)], owner[order], times[order], need))
    return Index(np.array(classes, np.int64), passages, sizes)


# ---- alignment


def _next_row(row: np.ndarray, same: np.ndarray, ramp: np.ndarray) -> np.ndarray:
    """The row of local alignment scores below `row`; ramp: the cost of a gap from the first column to each."""
    out = np.empty_like(row)
    out[0] = 0
    np.add(row[:-1], np.where(same, np.int32(MATCH), np.int32(MISMATCH)), out=out[1:])
    np.maximum(out, row + np.int32(GAP), out=out)
    np.maximum(out, 0, out=out)
    out -= ramp
    np.maximum.accumulate(out, out=out)
    out += ramp
    return out


def align(passage: np.ndarray, text: np.ndarray) -> list[tuple[int, int, bool]]:
    """Best local alignment of two arrays of word codes (negative codes match nothing): its columns, as (position in the
    passage, position in the text, whether they match)."""
    n, m = len(passage), len(text)
    ramp = GAP * np.arange(m + 1, dtype=np.int32)
    step = max(1, n if n * (m + 1) <= CELLS else math.isqrt(n))
    below = lambda row, i: _next_row(row, (text == passage[i]) & (passage[i] >= 0), ramp)
    row = np.zeros(m + 1, np.int32)
    tops, top_score, i, j, block, held = {0: row}, 0, 0, 0, 0 if step >= n else -1, [row]
    for k in range(n):
        row = below(row, k)
        if step >= n:
            held.append(row)
        elif (k + 1) % step == 0:
            tops[k + 1] = row
        if (high := int(row.max())) > top_score:
            top_score, i, j = high, k + 1, int(row.argmax())
    columns = []
    while i and j:
        if (i - 1) // step != block:
            block = (i - 1) // step
            held = [tops[block * step]]
            for k in range(block * step, min(n, (block + 1) * step)):
                held.append(below(held[-1], k))
        now, above = held[i - block * step], held[i - 1 - block * step]
        if now[j] <= 0:
            break
        same = bool(passage[i - 1] == text[j - 1] and passage[i - 1] >= 0)
        if now[j] == above[j - 1] + (MATCH if same else MISMATCH):
            i, j = i - 1, j - 1
            columns.append((i, j, same))
        elif now[j] == above[j] + GAP:
            i -= 1
            columns.append((i, j, False))
        else:
            j -= 1
            columns.append((i, j, False))
    return columns[::-1]


def stretches(columns: list[tuple[int, int, bool]], least: int) -> list[list[tuple[int, int]]]:
    """The matching (passage, text) positions of each coherent stretch of an alignment. It is cut where more than BREAK
    columns in a row do not match, as where a sentence moved or foreign text lies between."""
    hits = [k for k, (_, _, same) in enumerate(columns) if same]
    found, start = [], 0
    for k in range(1, len(hits) + 1):
        if k == len(hits) or hits[k] - hits[k - 1] > BREAK + 1:
            if k - start >= max(least, IDENTITY * (hits[k - 1] - hits[start] + 1)):
                found.append([columns[h][:2] for h in hits[start:k]])
            start = k
    return found


def column_scores(passage: np.ndarray, texts: list[np.ndarray]) -> list[np.ndarray]:
    """For every text the best score of a local alignment that ends at each of its words. The texts lie in one row, with
    columns between them that no alignment can cross."""
    lengths = np.array([len(t) for t in texts])
    ends = np.cumsum(lengths + 1)
    wall, text = -MATCH * (len(passage) + 1), np.full(ends[-1], -1, passage.dtype)
    for t, end in zip(texts, ends):
        text[end - 1 - len(t) : end - 1] = t
    cost = np.full(len(text), GAP, np.int64)
    cost[ends - 1] = wall
    ramp = np.r_[0, np.cumsum(cost)]
    ramp = ramp.astype(np.int32 if ramp[-1] > -(2**30) else np.int64)
    row = best = np.zeros(len(text) + 1, ramp.dtype)
    for code in passage:
        row = _next_row(row, text == code, ramp)
        row[ends] = 0
        best = np.maximum(best, row)
    return [best[end - length : end] for end, length in zip(ends, lengths)]


def most_words(scores: np.ndarray, least: int) -> float:
    """No stretches of a text with these column scores hold more words together."""
    high = np.where(scores >= 3 * least, scores, 0)
    return float(np.maximum.reduceat(high, np.arange(0, len(high), least)).sum()) / 3 if len(high) else 0.0


def stretch_share(passage: np.ndarray, windows: list[np.ndarray]) -> float:
    """Share of the passage's words in coherent stretches of the windows; at SHARE it stops, as the pair is decided."""
    p, total, least = passage.copy(), 0, min(LEAST_WORDS, len(passage))
    reach = len(p) + math.ceil(len(p) * MATCH / -GAP) + 1  # longer texts cannot score
    for window in windows:
        t = window.copy()
        while True:
            a = 0
            if len(t) > 2 * reach:
                end = int(column_scores(p, [t])[0].argmax()) + 1
                a = max(0, end - reach)
            columns = align(p, t[a : a + reach] if a or len(t) > 2 * reach else t)
            matches = [(i, j) for i, j, same in columns if same]
            if len(matches) < least:
                break
            kept = [pair for stretch in stretches(columns, least) for pair in stretch]
            total += len(kept)
            if total >= SHARE * len(p):
                return total / len(p)
            for i, j in kept or matches:
                t[a + j] = -1
                p[i] = -2 if kept else p[i]
    return total / len(p)


def windows(vocabulary: np.ndarray, grams: np.ndarray, size: int, reach: int, text: np.ndarray) -> list[np.ndarray]:
    """The surroundings, `reach` words to each side, of the passage's grams in a text of word hashes, as places of the words
    in the passage's vocabulary (-1: not in it); vocabulary and grams are sorted."""
    hit = np.flatnonzero(_places(grams, Hashes.roll(text, size)) >= 0)
    if not len(hit):
        return []
    edge = np.flatnonzero(hit[1:] - hit[:-1] > 2 * reach + size)
    starts = np.maximum(0, hit[np.concatenate([[0], edge + 1])] - reach)
    ends = hit[np.concatenate([edge, [len(hit) - 1]])] + size + reach
    return [_places(vocabulary, text[a:b]) for a, b in zip(starts, ends)]


def leaked_shares(passage: np.ndarray, texts: list[np.ndarray]) -> list[float]:
    """The share of the passage's words that each text carries in coherent stretches; zero where it cannot reach SHARE."""
    vocabulary, codes = np.unique(passage, return_inverse=True)
    least, size, reach = min(LEAST_WORDS, len(passage)), _gram(len(passage)), math.ceil(len(passage) / IDENTITY)
    grams = np.unique(Hashes.roll(passage, size))
    parts = [(k, w) for k, text in enumerate(texts) for w in windows(vocabulary, grams, size, reach, text)]
    bound, kept, shares = [0.0] * len(texts), [[] for _ in texts], [0.0] * len(texts)
    begin = 0
    while begin < len(parts):
        stop, words = begin, 0
        while stop < len(parts) and (stop == begin or words + len(parts[stop][1]) <= COLUMNS):
            words += len(parts[stop][1])
            stop += 1
        for (k, window), scores in zip(parts[begin:stop], column_scores(codes, [w for _, w in parts[begin:stop]])):
            if most := most_words(scores, least):
                bound[k] += most
                kept[k].append(window)
        begin = stop
    for k, most in enumerate(bound):
        if most >= SHARE * len(passage):
            shares[k] = stretch_share(codes, kept[k])
    return shares


def leaked_share(passage: list[str], text: list[str]) -> float:
    """The same for one passage and text, given by their words."""
    if not passage or not text:
        return 0.0
    hashes = Hashes()
    return leaked_shares(hashes.words(passage), [hashes.words(text)])[0]


def _search(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, class_id, share) of the leaks of each batch of texts: candidates by their grams, then aligned by passage."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = Hashes(), shared.value
        for batch in batches:
            idents, by_class, found = batch.column(0).to_pylist(), {}, []
            texts = [hashes.words(bare_words(text)) for text in batch.column(1).to_pylist()]
            for at, k in known.near(texts):
                by_class.setdefault(k, []).append(at)
            for k, rows in by_class.items():
                shares = leaked_shares(known.passages[k], [texts[at] for at in rows])
                found += [(idents[at], int(known.classes[k]), share) for at, share in zip(rows, shares) if share >= SHARE]
            docs, classes, shares = map(list, zip(*found)) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(classes, pa.int64()), pa.array(shares, pa.float64())], ["doc_id", "class_id", "share"])

    return search


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, share) of the pairs whose share of leaked words is at least SHARE."""
    members = items.where("passage is not null").select("item_id", "passage", F.xxhash64("passage").alias("class_id"))
    passages = members.select("class_id", "passage").distinct()
    texts = docs.select("doc_id", "text").where("text is not null")
    size = passages.agg(F.sum(F.length("passage")).alias("n")).first().n or 0
    blocks = 1 if size <= FILTER_BOUND else passages.count() if not FILTER_BOUND else math.ceil(2 * size / FILTER_BOUND)
    scored = texts.select("doc_id", F.lit(0).cast("bigint").alias("class_id"), F.lit(0.0).alias("share")).limit(0)
    for block in range(blocks):
        known = index(passages.where(F.pmod(F.col("class_id"), F.lit(blocks)) == block).toArrow())
        if len(known.classes):
            shared = docs.sparkSession.sparkContext.broadcast(known)
            part = texts.mapInArrow(_search(shared), "doc_id bigint, class_id bigint, share double")
            scored = part if block == 0 else scored.unionByName(part)
    return scored.join(members.select("item_id", "class_id"), "class_id").groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
