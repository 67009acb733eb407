"""Evaluation passages in training text: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

A case is the whole passage or a stretch of at least STRETCH = 18 of its words with at most one word in eight replaced.
Windows have the size of the least such stretch: every position of a passage gives one of WINDOW = 16 words, a document
one at every STRIDE = 3rd word, so that some window of the document lies wholly inside any stretch of 18 (a passage of
under 18 words is one window of its own length, sought at every word). Two words replaced among 16 leave the 64-bit
fingerprints about 10 bits apart; all pairs within RADIUS are found: of the four 16-bit blocks of two such fingerprints
one differs in at most RADIUS // 4 bits, and the index holds every passage window under all block values that near.
Every candidate alignment is then verified exactly: aligned one-word shingles, similarity at least 7/8 over a stretch of
at least 18 words, or over the whole of a shorter passage. The shingles have weight one, since a case is stated in words.

A stretch is missed only if all its windows are further apart than RADIUS, which takes replaced words whose hashes happen
to lean the same way; recall against trying every alignment is measured in the tests and in the README.

The passages are the stated query set; they are read in blocks of at most BLOCK_WORDS words, which bounds what a task
gets, and each block meets all documents. Nothing of the documents is collected or shuffled for the search.

Defined results: null or empty texts and passages match nothing; repeated documents and passages match each for itself;
letter case, punctuation, markup, quoting, entities and mis-decoded characters don't count; long texts are searched whole.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import plain

WINDOW, STRIDE, STRETCH, ONE_IN = 16, 3, 18, 8
RADIUS, BLOCKS = 15, 4
#: Words of passages searched in one pass over the documents: the index of 40,000 windows is 220 MB.
BLOCK_WORDS = 40_000
#: Words of documents given fingerprints at a time.
CHUNK_WORDS = 150_000
#: Passages without any lean that the centre counts beside the real ones.
CENTRED = 8
#: Pairs compared at a time.
PAIRS = 150_000

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    """The words of a text apart from case, punctuation, markup and quoting; emphasis marks around a word are no part of it."""
    if not text:
        return []
    text = plain(text).lower()
    if "\\" in text:
        text = text.replace("\\_", "_")
    return [w for w in (x.strip("_") for x in _WORD.findall(text)) if w] if "_" in text else _WORD.findall(text)


class _Hashes(dict):
    """64-bit hashes of words, each computed once per task; emptied when large, so memory is bounded."""

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


def word_hashes(ws: list[str], table: _Hashes) -> np.ndarray:
    return np.fromiter(map(table.__getitem__, ws), np.uint64, len(ws))


def _sums(hashes: np.ndarray, size: int, stride: int = 1) -> np.ndarray:
    """Summed bits (+1 or -1) of the words of the window of `size` words at every `stride`-th word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros((0, 64), np.int8)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1).view(np.int8) * np.int8(2) - np.int8(1)
    # Sums of 1, 2, 4, ... neighbouring words, put together to `size`.
    power, width, total, done = bits, 1, np.zeros((len(range(0, n, stride)), 64), np.int8), 0
    while done < size:
        if size & width:
            total += power[done : done + n : stride]
            done += width
        if done < size:
            power = power[:-width] + power[width:]
            width *= 2
    return total


def fingerprints(sums: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """SimHash, 64 bits: whether each sum is above the centre, the mean over the passages (shrunk to zero where they are few).

    Words that most windows hold lean all sums the same way; against the centre they tell nothing, so blocks are selective.
    """
    return np.packbits(sums > centre, axis=1).view("<u8").ravel().astype(np.uint64)


def _near(bits: int, radius: int) -> np.ndarray:
    """All masks of `bits` bits of which at most `radius` are set."""
    from itertools import combinations

    return np.array([sum(1 << k for k in c) for r in range(radius + 1) for c in combinations(range(bits), r)], np.uint16)


class Index:
    """The windows of a block of passages of one window size; each block's table holds them under every value within reach."""

    def __init__(self, passages: list[tuple[int, np.ndarray]], size: int, stride: int):
        self.size, self.stride, self.words, self.first = size, stride, None, None
        own = [_sums(h, size) for _, h in passages]
        means = [x.mean(axis=0) for x in own if len(x)]
        self.centre = (np.sum(means, axis=0) / (len(means) + CENTRED)).astype(np.float32) if means else np.zeros(64, np.float32)
        self.prints = fingerprints(np.concatenate(own), self.centre)
        self.item = np.concatenate([np.full(max(0, len(h) - size + 1), i, np.int32) for i, (_, h) in enumerate(passages)])
        self.at = np.concatenate([np.arange(max(0, len(h) - size + 1), dtype=np.int32) for _, h in passages])
        self.order, self.starts = [], []
        masks = _near(16, RADIUS // BLOCKS)
        for b in range(BLOCKS):
            v = (self._block(self.prints, b)[:, None] ^ masks).ravel()
            self.order.append((np.argsort(v, kind="stable") // len(masks)).astype(np.uint16 if len(self.prints) <= 1 << 16 else np.int32))
            self.starts.append(np.concatenate([[0], np.cumsum(np.bincount(v, minlength=1 << 16))]))

    @staticmethod
    def _block(prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.uint16)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in `prints`, window of the index) of all pairs within the radius; equal prints are looked up once."""
        prints, which = np.unique(prints, return_inverse=True)
        found = []
        for b in range(BLOCKS):
            v = self._block(prints, b).astype(np.int64)
            first, n = self.starts[b][v], self.starts[b][v + 1] - self.starts[b][v]
            done = np.cumsum(n)
            at = 0
            while at < len(n):
                end = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS, "right")))
                count = n[at:end]
                base = np.cumsum(count) - count
                place = np.arange(int(count.sum()), dtype=np.int32) + np.repeat((first[at:end] - base).astype(np.int32), count)
                right = self.order[b][place]
                near = np.flatnonzero(np.bitwise_count(np.repeat(prints[at:end], count) ^ self.prints[right]) <= RADIUS)
                left = at + np.searchsorted(base + count, near, "right")
                found.append(left.astype(np.int64) << 32 | right[near])
                at = end
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        left, right = both >> 32, (both & 0xFFFFFFFF).astype(np.int64)
        # Each print's places, then each pair once for every place of its print.
        order = np.argsort(which, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(prints)))])
        count = starts[left + 1] - starts[left]
        place = np.arange(int(count.sum())) + np.repeat(starts[left] - np.cumsum(count) + count, count)
        return order[place], np.repeat(right, count)


    def similar(self, text: np.ndarray, left: np.ndarray, right: np.ndarray, passages: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of windows of which at most a quarter of the words differ: every stretch has such a pair, as some window of it holds no more."""
        if self.words is None:
            self.words = np.concatenate([h for _, h in passages])
            self.first = np.concatenate([[0], np.cumsum([len(h) for _, h in passages])])
        at = self.first[self.item[right]] + self.at[right]
        same = np.zeros(len(left), np.int16)
        for k in range(self.size):
            same += text[left + k] == self.words[at + k]
        keep = same * 4 >= 3 * self.size
        return left[keep], right[keep]


def has_stretch(same: np.ndarray, whole: int) -> bool:
    """Whether aligned equal words hold a stretch of at least 18 words (or all `whole` words of a shorter passage) with at most one in eight unequal."""
    least = min(STRETCH, whole)
    if len(same) < least:
        return False
    p = np.concatenate([[0], np.cumsum(np.where(same, 1, 1 - ONE_IN))])
    return bool((p[least:] >= np.minimum.accumulate(p)[: len(p) - least]).any())


def search(doc: np.ndarray, passages: list[tuple[int, np.ndarray]], indexes: list[Index]) -> list[int]:
    """Ids of the items whose passage the document (word hashes) holds; the brute-force twin in the tests tries every alignment."""
    found: set[int] = set()
    for index in indexes:
        step = CHUNK_WORDS // index.stride * index.stride
        for a in range(0, max(1, len(doc) - index.size + 1), step):
            prints = fingerprints(_sums(doc[a : a + step + index.size - 1], index.size, index.stride), index.centre)
            left, right = index.candidates(prints)
            left = left * index.stride + a
            left, right = index.similar(doc, left, right, passages)
            shift = left - index.at[right]
            for i, s in {(int(x), int(y)) for x, y in zip(index.item[right], shift)}:
                key, own = passages[i]
                if key not in found:
                    low, high = max(0, -s), min(len(own), len(doc) - s)
                    if has_stretch(own[low:high] == doc[low + s : high + s], len(own)):
                        found.add(key)
    return sorted(found)


def build(rows: list[tuple[int, str]]) -> tuple[list[tuple[int, np.ndarray]], list[Index]]:
    """Passages as word hashes and their indexes: windows of WINDOW words, or of all words of a passage under STRETCH words."""
    table = _Hashes()
    passages = [(i, word_hashes(words(t), table)) for i, t in rows]
    passages = [(i, h) for i, h in passages if len(h)]
    none = np.zeros(0, np.uint64)
    sizes = [(WINDOW, STRIDE) if len(h) >= STRETCH else (len(h), 1) for _, h in passages]
    indexes = [Index([(i, h if own == size else none) for (i, h), own in zip(passages, sizes)], *size) for size in sorted(set(sizes))]
    return passages, indexes


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id of every document that holds an item's passage or a stretch of it."""
    size = items.select(F.sum(F.length("passage") / 5 + 1).alias("n")).collect()[0].n or 0
    blocks = max(1, -(-int(size) // BLOCK_WORDS))
    out = None
    for b in range(blocks):
        own = items.where(F.col("passage").isNotNull() & (F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)).select("item_id", "passage").collect()
        rows = sorted({(r.item_id, r.passage) for r in own})
        part = documents.select("doc_id", "text").mapInArrow(_searcher(rows), "doc_id long, item_id long")
        out = part if out is None else out.unionByName(part)
    return out.distinct() if blocks > 1 else out


def _searcher(rows: list[tuple[int, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages, indexes = build(rows)
        table = _Hashes()
        for b in batches:
            docs, found = [], []
            own = [word_hashes(words(t), table) for t in b.column("text").to_pylist()]
            ids = b.column("doc_id").to_pylist()
            # The documents of a batch are searched together, a run of words at a time, so that numpy has long arrays.
            at = 0
            while at < len(own):
                end, n = at, 0
                while end < len(own) and (end == at or n + len(own[end]) <= CHUNK_WORDS):
                    n += len(own[end])
                    end += 1
                for k, item in _search_run(own[at:end], passages, indexes):
                    docs.append(ids[at + k])
                    found.append(item)
                at = end
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.int64())], names=["doc_id", "item_id"])

    return run


def _search_run(own: list[np.ndarray], passages: list[tuple[int, np.ndarray]], indexes: list[Index]) -> list[tuple[int, int]]:
    """(place of the document, item id) over a run of documents; windows never cross a document's end."""
    if len(own) == 1:
        return [(0, i) for i in search(own[0], passages, indexes)]
    flat = np.concatenate(own) if own else np.zeros(0, np.uint64)
    starts = np.concatenate([[0], np.cumsum([len(h) for h in own])]).astype(np.int64)
    found: set[tuple[int, int]] = set()
    for index in indexes:
        prints = fingerprints(_sums(flat, index.size, index.stride), index.centre)
        left, right = index.candidates(prints)
        left = left * index.stride
        doc = np.searchsorted(starts, left, "right") - 1
        inside = left + index.size <= starts[doc + 1]
        left, right = index.similar(flat, left[inside], right[inside], passages)
        doc = np.searchsorted(starts, left, "right") - 1
        shift = left - starts[doc] - index.at[right]
        for k, i, s in {(int(x), int(y), int(z)) for x, y, z in zip(doc, index.item[right], shift)}:
            key, passage = passages[i]
            if (k, key) not in found:
                text = own[k]
                low, high = max(0, -s), min(len(passage), len(text) - s)
                if has_stretch(passage[low:high] == text[low + s : high + s], len(passage)):
                    found.add((k, key))
    return sorted(found)
