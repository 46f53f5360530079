"""Benchmark decontamination with suffix arrays over the training words.

Training documents are cut into shards of about ``SHARD_WORDS`` words (a
document is never split). A task sorts all suffixes of its shard, and every
suffix of every test item is binary-searched in it, word by word: the interval
that is left gives all places of a window, and the depth reached gives the
longest verbatim match. Words are compared by 64-bit hashes.

How it scales: documents are scanned once and not shuffled; the result has one
row per document. The benchmark is sent to all tasks in blocks of at most
``BLOCK_BYTES`` of text; should it have several, the documents pass one block
after the other in the same stage, handing on the words hit so far. The bound
is on one block, not on the benchmark: the driver and every task hold the
blocks of all of it at once, so it has to fit their memory.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A
window is ``window`` consecutive words of an item; an item of fewer, but not
none, is one window.

Cases: null and empty texts have no words and are clean; items without words
have no window; a null item_id is reported as ``null``; repeated items count
once per item_id; repeated documents are judged row by row; empty tables give
empty or clean results; extra columns pass through ``decontaminate`` and are
ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm import wordbytes
from ledgerlight.llm.memory import lean

SHARD_WORDS = 500_000
BLOCK_BYTES = 32 << 20
WINDOW = 10


@dataclass
class Items:
    """Test items: the hashes of their words one after another, and where each begins."""

    names: list[str]
    hashes: np.ndarray
    begins: np.ndarray

    def suffixes(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each suffix: its item, the words it has left, and its window (0: too short for one)."""
        lengths = np.diff(self.begins)
        item = np.repeat(np.arange(len(lengths)), lengths)
        left = self.begins[item + 1] - np.arange(len(self.hashes))
        need = np.minimum(lengths, window)[item]
        return item, left, np.where(left >= need, need, 0)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = wordbytes.LOWER[data]
    start, end, row = wordbytes.words(data, offsets, wordbytes.ALNUM)
    return wordbytes.hashes(data, start, end), row


def item_blocks(bench: DataFrame) -> list[Items]:
    """The benchmark in blocks of about ``BLOCK_BYTES``; an item is never split."""
    rows = bench.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    blocks = []
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b)
        found = sorted(part.collect(), key=lambda r: (r.item_id or "null", r.text))
        text = pa.RecordBatch.from_arrays([pa.array([r.text for r in found], pa.large_string())], ["text"])
        hashes, counts = [], []
        for a, z, data, offsets in wordbytes.parts(text):
            h, row = word_hashes(data, offsets)
            hashes.append(h)
            counts.append(np.bincount(row, minlength=z - a))
        if hashes:
            begins = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)
            blocks.append(Items([r.item_id if r.item_id is not None else "null" for r in found], np.concatenate(hashes), begins))
    return blocks


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """The suffixes of ``codes`` in order. Every run of equal codes must end in a code that occurs once."""
    n = len(codes)
    bits = max(1, int(codes.max()).bit_length()) if n else 1
    depth = max(1, 63 // bits)
    key = np.zeros(n, np.uint64)
    for k in range(depth):
        key <<= np.uint64(bits)
        key[: max(n - k, 0)] |= codes[k:].astype(np.uint64)
    order = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    # A group's rank is its first slot; groups of one suffix are in place.
    tied, rank = np.arange(n), np.empty(n, np.int64)
    while True:
        rank[order[tied]] = np.maximum.accumulate(np.where(new[tied], tied, 0))
        alone = new[tied] & np.append(new, True)[tied + 1]
        tied = tied[~alone]
        if not len(tied):
            return order
        at = order[tied]
        both = rank[at] << 32 | rank[at + depth]
        sort = np.argsort(both)
        order[tied] = at[sort]
        new[tied] = np.concatenate([[True], both[sort][1:] != both[sort][:-1]])
        depth *= 2


class Shard:
    """Training words of some documents with their suffix array."""

    def __init__(self, hashes: np.ndarray, row: np.ndarray, n_rows: int):
        self.counts = np.bincount(row, minlength=n_rows)
        self.vocabulary, codes = np.unique(hashes, return_inverse=True)
        # A code of its own ends each document, so that no match runs on into the next.
        ends = np.cumsum(self.counts) + np.arange(n_rows)
        self.begins = ends - self.counts
        n = len(hashes) + n_rows
        self.codes = np.empty(n, np.int64)
        word = np.ones(n, bool)
        word[ends] = False
        self.codes[word] = codes
        self.codes[ends] = len(self.vocabulary) + np.arange(n_rows)
        self.order = suffix_array(self.codes)

    def code_of(self, hashes: np.ndarray) -> np.ndarray:
        """The code of each word, -1 if the shard does not have it."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def _bound(self, lo: np.ndarray, hi: np.ndarray, depth: int, code: np.ndarray, right: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            here = self.codes[self.order[mid] + depth]
            on = here <= code[open_] if right else here < code[open_]
            lo[open_[on]] = mid[on] + 1
            hi[open_[~on]] = mid[~on]

    def search(self, items: Items, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each suffix of the items: longest match, a slot that has it, and the slots lo..hi of its window."""
        _, left, need = items.suffixes(window)
        codes = self.code_of(items.hashes)
        n = len(codes)
        longest, slot = np.zeros(n, np.int64), np.zeros(n, np.int64)
        window_lo, window_hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
        active, lo, hi, depth = np.arange(n), np.zeros(n, np.int64), np.full(n, len(self.order)), 0
        while len(active):
            keep = left[active] > depth
            active, lo, hi = active[keep], lo[keep], hi[keep]
            code = codes[active + depth]
            keep = code >= 0
            active, lo, hi, code = active[keep], lo[keep], hi[keep], code[keep]
            first = self._bound(lo, hi, depth, code, right=False)
            last = self._bound(first, hi, depth, code, right=True)
            keep = first < last
            active, lo, hi = active[keep], first[keep], last[keep]
            depth += 1
            longest[active], slot[active] = depth, lo
            done = need[active] == depth
            window_lo[active[done]], window_hi[active[done]] = lo[done], hi[done]
        return longest, slot, window_lo, window_hi

    def row_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, place, "right") - 1


def shards(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Shard]]:
    """Shards over consecutive rows: (first row, row after the last, shard)."""
    hashes, counts, first, n = [], [], 0, 0

    def close() -> Shard:
        count = np.concatenate(counts)
        return Shard(np.concatenate(hashes), np.repeat(np.arange(len(count)), count), len(count))

    for a, z, data, offsets in wordbytes.parts(batch):
        h, row = word_hashes(data, offsets)
        if n and n + len(h) > SHARD_WORDS:
            yield first, a, close()
            hashes, counts, first, n = [], [], a, 0
        hashes.append(h)
        counts.append(np.bincount(row, minlength=z - a))
        n += len(h)
    if hashes:
        yield first, batch.num_rows, close()


def judge(batch: pa.RecordBatch, blocks: list[Items], window: int) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """(n_words, n_hit, names of the items found) of each row of the batch.

    Equal windows of several items are one range of the suffix array: its
    places are listed once, and the names joined to the rows that it reaches.
    """
    n_words, n_hit = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
    found: list[set[str]] = [set() for _ in range(batch.num_rows)]
    for a, z, shard in shards(batch):
        n_words[a:z] = shard.counts
        change = np.zeros(len(shard.codes) + 1, np.int64)
        for items in blocks:
            item, _, need = items.suffixes(window)
            _, _, lo, hi = shard.search(items, window)
            some = np.flatnonzero(hi > lo)
            if not len(some):
                continue
            ranges, of = np.unique(np.stack([lo[some], hi[some], need[some]], axis=1), axis=0, return_inverse=True)
            begin, times = ranges[:, 0], ranges[:, 1] - ranges[:, 0]
            slot = np.repeat(begin - np.cumsum(times) + times, times) + np.arange(times.sum())
            place, width, which = shard.order[slot], np.repeat(ranges[:, 2], times), np.repeat(np.arange(len(ranges)), times)
            np.add.at(change, place, 1)
            np.add.at(change, place + width, -1)
            named: list[set[str]] = [set() for _ in ranges]
            for at, name in zip(of.ravel().tolist(), item[some].tolist(), strict=True):
                named[at].add(items.names[name])
            pairs = np.unique(shard.row_of(place) * len(ranges) + which)
            for row, at in zip((pairs // len(ranges)).tolist(), (pairs % len(ranges)).tolist(), strict=True):
                found[a + row] |= named[at]
        hit = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
        n_hit[a:z] = hit[shard.begins + shard.counts] - hit[shard.begins]
    return n_words, n_hit, found


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (names of those with an occurring window, sorted)."""
    sent = send(docs, item_blocks(bench))

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [b.value for b in sent]
        for batch in batches:
            n_words, n_hit, found = judge(batch, blocks, window)
            items = pa.array([sorted(f) for f in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words), pa.array(n_hit), items], ["doc_id", "n_words", "n_hit", "items"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ids.mapInArrow(scan, "doc_id long, n_words long, n_hit long, items array<string>")


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any hit, as they came."""
    sent = send(docs, item_blocks(bench))

    @lean
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [b.value for b in sent]
        for batch in batches:
            yield batch.filter(pa.array(judge(batch, blocks, window)[1] == 0))

    return docs.mapInArrow(keep, docs.schema)


def longest_matches(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """The longest verbatim match of each item suffix that has one of a window's length or more.

    item_id, item_word (where the suffix begins), n_words (matched), doc_id and
    doc_word (one place that has it: the smallest of those that shards report).
    """
    sent = send(docs, item_blocks(bench))

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [b.value for b in sent]
        for batch in batches:
            ids = np.array([-1 if x is None else x for x in batch.column("doc_id").to_pylist()], np.int64)
            for a, _, shard in shards(batch):
                for items in blocks:
                    item, _, need = items.suffixes(window)
                    longest, slot, _, _ = shard.search(items, window)
                    some = np.flatnonzero((need > 0) & (longest >= need))
                    place = shard.order[slot[some]]
                    row = shard.row_of(place)
                    doc = ids[a + row]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([items.names[i] for i in item[some].tolist()], pa.string()), pa.array(some - items.begins[item[some]]), pa.array(longest[some]), pa.array(doc, mask=doc < 0), pa.array(place - shard.begins[row])],
                        ["item_id", "item_word", "n_words", "doc_id", "doc_word"],
                    )

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = ids.mapInArrow(scan, "item_id string, item_word long, n_words long, doc_id long, doc_word long")
    best = F.min(F.struct((-F.col("n_words")).alias("less"), "doc_id", "doc_word")).alias("best")
    return rows.groupBy("item_id", "item_word").agg(best).select("item_id", "item_word", (-F.col("best.less")).alias("n_words"), "best.doc_id", "best.doc_word")


def send(docs: DataFrame, blocks: list[Items]) -> list:
    return [docs.sparkSession.sparkContext.broadcast(b) for b in blocks]
