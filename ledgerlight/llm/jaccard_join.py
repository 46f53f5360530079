"""N-gram Jaccard join as a blocked sparse matrix product.

The incidence matrix has one row per class of documents with equal shingle
sets and one column per shingle. Two classes link when their rows' product,
the overlap, reaches ``threshold`` of their union. The product is never formed
whole:

* Columns are ordered by how common they are, then by hash. With the
  threshold t, rows that link share a column among the first
  ``n - ceil(t n) + 1`` of each (the size-derived bound), so only those entries
  are dealt, as packed tiles, to column blocks; a block keeps the columns that
  two or more classes share.
* Rows of a kept column and of compatible sizes are multiplied with the
  column's pivot row first. Full overlaps are accumulated in blocks of packed
  rows, and pairs below the bound ``overlap >= t/(1+t) (n1+n2)`` are discarded.
  Links are contracted to components, and only columns that still hold rows of
  several components go on, with further pivots or, where that is cheaper, all
  products across components. A group of copies so costs products in
  proportion to its size, and no link between components is lost.
* An entry's place in its row bounds the overlap of all pairs that first meet
  there, by what is left of either row. Products beyond the bound are not
  formed: a passage that many rows share stands late in all rows that are not
  made of it, and makes no pairs there.
* Before rows are moved to meet each other, sketches of 2 to 4 bits an entry
  do. A bit of one row that the other lacks stands for an entry it lacks, so
  pairs whose sketches leave too little in common surely do not link.

Which columns are common is found per task over all documents; the table of
them is bounded (``COMMON``) and affects the order, and so the work, only.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Shingles are
compared by 52-bit hashes, sets by 64-bit hashes of theirs.

Cases: a null, empty or blank text has no shingles and links with nothing; one
of fewer words than ``width`` has a single shingle; equal texts and repeated
rows are one class; null doc_ids take part, and a component's id is the least
one that is not null; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlight.llm import wordbytes
from ledgerlight.llm.memory import lean, lean_group
from ledgerlight.session import stage

WIDTH = 5
NUM, DEN = 3, 4  # the threshold as a fraction
COMMON = 1 << 18
COMMON_WINDOW = 2_000_000  # entries that are counted together in a task
PRODUCTS_PER_ENTRY = 8
MOST_SEEN = 1_000_000
BLOCK_ENTRIES = 1_000_000
TILE_ENTRIES = 500_000  # entries that a task packs at once
SKETCH_BITS = 2  # of a row's sketch for each entry, up to the next power of two
SIEVE = 1 << 26  # bits of the table that tells which rows may be asked for: 2^20 words at most
MASK = np.uint64((1 << 52) - 1)
PAIR = ["a", "b", "component_a", "component_b"]
U64 = np.uint64


class Rows:
    """Shingle sets of the documents of one part: sorted, one after another."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int):
        n = len(offsets) - 1
        data = wordbytes.LOWER[data]
        start, end, row = wordbytes.words(data, offsets, wordbytes.NOT_SPACE)
        h, row = wordbytes.shingles(wordbytes.hashes(data, start, end), row, n, width)
        # Row in the high bits, shingle in the low 52: one sort orders and groups.
        both = np.sort(row.astype(U64) << U64(52) | h & MASK)
        if len(both):
            both = both[np.concatenate([[True], both[1:] != both[:-1]])]
        self.row, self.shingle = (both >> U64(52)).astype(np.int64), both & MASK
        self.counts = np.bincount(self.row, minlength=n)
        self.begins = np.cumsum(self.counts) - self.counts
        self.classes = np.zeros(n, U64)
        some = np.flatnonzero(self.counts)
        if len(some):
            self.classes[some] = wordbytes.mix64(np.add.reduceat(wordbytes.mix64(self.shingle), self.begins[some]) + self.counts[some].astype(U64))


def least_overlap(n: np.ndarray | int, num: int = NUM, den: int = DEN):
    """What a row of ``n`` shingles shares at least with any row it links to."""
    return -(-n * num // den)


def unseen(rows: Rows, seen: set[int]) -> np.ndarray:
    """Which rows are the first of their class since ``seen`` was last emptied."""
    if len(seen) > MOST_SEEN:
        seen.clear()
    new = np.zeros(len(rows.counts), bool)
    for i, c in enumerate(rows.classes.tolist()):
        if rows.counts[i] and c not in seen:
            seen.add(c)
            new[i] = True
    return new


def sketches(rows: Rows, which: np.ndarray) -> list[bytes | None]:
    """Bitmaps of the rows in ``which``, None for others: bit ``shingle`` modulo the length, a power of two bytes."""
    size = np.maximum(SKETCH_BITS * rows.counts, 8).astype(np.float64)
    size = np.where(which, 1 << np.ceil(np.log2(size)).astype(np.int64), 0)
    end = np.cumsum(size)
    keep = which[rows.row]
    row = rows.row[keep]
    bits = np.zeros(int(end[-1]) if len(end) else 0, bool)
    bits[(end - size)[row] + (rows.shingle[keep] & (size[row] - 1).astype(U64)).astype(np.int64)] = True
    packed = np.packbits(bits, bitorder="little").tobytes()
    return [packed[z - n : z] if n else None for z, n in zip((end // 8).tolist(), (size // 8).tolist(), strict=True)]


def most_common(a: bytes, n_a: int, b: bytes, n_b: int) -> int:
    """What rows of these sketches and sizes share at most."""
    size = min(len(a), len(b))
    x, y = folded(a, size), folded(b, size)
    return min(n_a - (x & ~y).bit_count(), n_b - (y & ~x).bit_count())


def folded(sketch: bytes, size: int) -> int:
    """The sketch as it were with ``size`` bytes: bits that agree modulo the lesser length fall together."""
    bits, n = int.from_bytes(sketch, "little"), 8 * len(sketch)
    while n > 8 * size:
        n //= 2
        bits = bits >> n | bits & (1 << n) - 1
    return bits


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """kind 0: (doc_id, key, text_hash, n, class) of each document, with the sketch where its class is first seen; kind 1: (n, class) as count and shingle of what repeats within a task."""

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        window: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for a, z, data, offsets in wordbytes.parts(batch):
                rows = Rows(data, offsets, width)
                cls = pa.array(rows.classes.view(np.int64), mask=rows.counts == 0)
                new = unseen(rows, seen)
                yield out(np.zeros(z - a, np.int8), *(batch.column(c).slice(a, z - a) for c in ("doc_id", "key", "text_hash")), rows.counts, cls, pa.array(sketches(rows, new), pa.binary()))
                window.append(rows.shingle[new[rows.row]])
                held += len(window[-1])
                if held >= COMMON_WINDOW:
                    yield repeated(window)
                    window, held = [], 0
        if window:
            yield repeated(window)

    def repeated(window: list[np.ndarray]) -> pa.RecordBatch:
        shingles, times = np.unique(np.concatenate(window), return_counts=True)
        shingles, times = shingles[times > 1], times[times > 1]
        nulls = pa.nulls(len(times), pa.int64())
        return out(np.ones(len(times), np.int8), nulls, nulls, nulls, times, pa.array(shingles.view(np.int64)), pa.nulls(len(times), pa.binary()))

    def out(kind, doc_id, key, text_hash, n, cls, sketch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(kind), doc_id, key, text_hash, pa.array(n.astype(np.int64)), cls, sketch], ["kind", "doc_id", "key", "text_hash", "n", "class", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(scan, "kind byte, doc_id long, key long, text_hash long, n long, class long, sketch binary")


def tiles(docs: DataFrame, common: np.ndarray, n_blocks: int, width: int, num: int, den: int) -> DataFrame:
    """The first entries of each class's row, packed by column block; below 0 are blocks of common columns only."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(sent.value)
        table = sent.value[order]
        seen: set[int] = set()
        found: list[tuple[np.ndarray, ...]] = []
        held = 0
        for batch in batches:
            for _, _, data, offsets in wordbytes.parts(batch):
                rows = Rows(data, offsets, width)
                new = unseen(rows, seen)
                keep = new[rows.row]
                row, shingle = rows.row[keep], rows.shingle[keep]
                # Rank 0: not common; the others from the least to the most common.
                rank = np.zeros(len(row), np.int64)
                if len(table):
                    at = np.minimum(np.searchsorted(table, shingle), len(table) - 1)
                    is_common = table[at] == shingle
                    rank[is_common] = len(table) - order[at[is_common]]
                    if is_common.any():
                        by = np.argsort(row * (len(table) + 1) + rank, kind="stable")
                        row, shingle, rank = row[by], shingle[by], rank[by]
                counts = np.where(new, rows.counts, 0)
                begins = np.cumsum(counts) - counts
                place = np.arange(len(row)) - begins[row]
                first = place < (counts - least_overlap(counts, num, den) + 1)[row]
                row, shingle, rank = row[first], shingle[first], rank[first]
                found.append((shingle, rank > 0, rows.classes[row], counts[row], place[first].astype(np.uint32)))
                held += len(row)
                if held >= TILE_ENTRIES:
                    yield from packed(found)
                    found, held = [], 0
        if held:
            yield from packed(found)

    def packed(found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        shingle, is_common, cls, n, place = (np.concatenate(x) for x in zip(*found, strict=True))
        block = (shingle % U64(n_blocks)).astype(np.int64)
        block = np.where(is_common, -1 - (wordbytes.mix64(cls) % U64(n_blocks)).astype(np.int64), block)
        by = np.argsort(block, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(block[by])) + 1):
            classes, index = np.unique(cls[part], return_inverse=True)
            sizes = np.zeros(len(classes), np.uint32)
            sizes[index] = n[part]
            index = index.astype(np.uint16 if len(classes) <= 1 << 16 else np.uint32)
            row = [pa.array([x.tobytes()], pa.binary()) for x in (shingle[part], index, classes, sizes, place[part])]
            yield pa.RecordBatch.from_arrays([pa.array([block[part[0]]]), *row], ["block", "shingles", "index", "classes", "sizes", "places"])

    return docs.select("text").mapInArrow(scan, "block long, shingles binary, index binary, classes binary, sizes binary, places binary")


def shared_entries(tiled: DataFrame, num: int, den: int) -> DataFrame:
    """(shingle, class, n, place): the entries of columns that two or more classes of compatible sizes share."""

    @lean_group
    def merge(key: tuple, table: pa.Table) -> pa.Table:
        shingle, cls, n, place = [], [], [], []
        for row in table.select(["shingles", "index", "classes", "sizes", "places"]).to_pylist():
            classes = np.frombuffer(row["classes"], U64)
            index = np.frombuffer(row["index"], np.uint16 if len(classes) <= 1 << 16 else np.uint32)
            shingle.append(np.frombuffer(row["shingles"], U64))
            cls.append(classes[index])
            n.append(np.frombuffer(row["sizes"], np.uint32)[index].astype(np.int64))
            place.append(np.frombuffer(row["places"], np.uint32))
        shingle, cls, n, place = (np.concatenate(x) for x in (shingle, cls, n, place))
        by = np.lexsort((cls, n, shingle))
        shingle, cls, n, place = shingle[by], cls[by], n[by], place[by]
        once = np.ones(len(by), bool)
        once[1:] = (shingle[1:] != shingle[:-1]) | (cls[1:] != cls[:-1])
        shingle, cls, n, place = shingle[once], cls[once], n[once], place[once]
        if key[0].as_py() >= 0:
            # In order of size, an entry has a partner in its column if one of its neighbours is one.
            fits = np.zeros(len(shingle) + 1, bool)
            fits[1:-1] = (shingle[1:] == shingle[:-1]) & (n[:-1] * den >= n[1:] * num)
            shared = fits[:-1] | fits[1:]
            shingle, cls, n, place = shingle[shared], cls[shared], n[shared], place[shared]
        return pa.table([pa.array(shingle.view(np.int64)), pa.array(cls.view(np.int64)), pa.array(n), pa.array(place.astype(np.int32))], ["shingle", "class", "n", "place"])

    return tiled.groupBy("block").applyInArrow(merge, "shingle long, class long, n long, place int")


def sieved(rows: DataFrame, by: Column, hashes: DataFrame) -> DataFrame:
    """``rows`` and ``perhaps``: false where the hash ``by`` is surely not in the one column of ``hashes``.

    Texts so need no shuffle to meet a long list of a few of them. The bitmap
    that is broadcast is bounded: a list that fills it lets other rows pass,
    which an exact join has to take out, so the work depends on it only.
    """
    word = lambda h: F.shiftright(F.pmod(h, F.lit(SIEVE)), 6)
    bit = lambda h: F.pmod(h, F.lit(64)).cast("int")
    h = F.col(hashes.columns[0])
    bits = hashes.select(word(h).alias("sieve_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit(h)).alias("bit"))
    bits = bits.groupBy("sieve_word").agg(F.bit_or("bit").alias("sieve_bits"))
    met = rows.join(F.broadcast(bits), word(by) == F.col("sieve_word"), "left")
    return met.select(*rows.columns, F.coalesce(F.getbit("sieve_bits", bit(by)) == 1, F.lit(False)).alias("perhaps"))


def class_rows(docs: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """(class, n, row): the packed sorted shingles of the classes in ``asked`` (class, key of one of its documents)."""

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in wordbytes.parts(batch):
                rows = Rows(data, offsets, width)
                some = np.flatnonzero(rows.counts)
                packed = [rows.shingle[b : b + n].tobytes() for b, n in zip(rows.begins[some].tolist(), rows.counts[some].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(rows.classes[some].view(np.int64)), pa.array(rows.counts[some]), pa.array(packed, pa.binary())], ["class", "n", "row"])

    wanted = sieved(docs.select(row_key().alias("key"), "text"), F.xxhash64("key"), asked.select(F.xxhash64("key"))).where("perhaps")
    rows = wanted.select("text").mapInArrow(scan, "class long, n long, row binary")
    return rows.join(asked.select("class"), "class", "left_semi").dropDuplicates(["class"])


def row_key():
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))


def possible(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs of classes whose sketches leave enough in common for a link."""

    @lean
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            sides = (batch.column(c).to_pylist() for c in ("sketch_a", "n_a", "sketch_b", "n_b"))
            most = np.fromiter(map(most_common, *sides), np.int64, batch.num_rows)
            yield batch.select(PAIR).filter(pa.array(most >= least_overlap(n_a + n_b, num, num + den)))

    side = lambda s: classes.select(F.col("class").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(compare, ", ".join(f"{c} long" for c in PAIR))


def overlaps(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs of classes (a, b), with n_a, n_b and overlap."""
    names = [*PAIR, "n_a", "n_b"]

    @lean
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                left, right = tagged(part.column("row_a")), tagged(part.column("row_b"))
                # The block's product: entries of both sides that agree in pair and column.
                where = np.minimum(np.searchsorted(right, left), max(len(right) - 1, 0))
                both = left[right[where] == left] if len(right) else left[:0]
                overlap = np.bincount((both >> U64(52)).astype(np.int64), minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(overlap)], [*names, "overlap"])

    def tagged(column: pa.Array) -> np.ndarray:
        rows = [np.frombuffer(x, U64) for x in column.to_pylist()]
        return np.concatenate([r | U64(i << 52) for i, r in enumerate(rows)])

    side = lambda s: rows.select(F.col("class").alias(s), F.col("n").alias(f"n_{s}"), F.col("row").alias(f"row_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select(*names, "row_a", "row_b").mapInArrow(multiply, ", ".join(f"{c} long" for c in [*names, "overlap"]))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for the nodes of ``links`` (a, b) that reach a lesser one.

    Alternating stars: each node's neighbours are hung on the least of them,
    first the greater ones, then the smaller, until nothing changes. A round
    shuffles the edges twice, by the node whose neighbours meet; it may leave
    an edge twice, but never more edges than it was given.
    """
    edges, node = links.select(F.col("a").alias("u"), F.col("b").alias("v")), W.partitionBy("u")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least("u", F.min("v").over(node))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.repartition("u").distinct().withColumn("m", F.min("v").over(node))
        edges = stage(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")), "stars")
        roles = edges.select(F.col("u").alias("x"), F.col("v").alias("parent")).unionByName(edges.select(F.col("v").alias("x"), F.lit(None).cast("long").alias("parent")))
        roles = roles.groupBy("x").agg(F.min("parent").alias("least"), F.max("parent").alias("most"), F.max(F.col("parent").isNull()).alias("is_parent"))
        if not roles.agg(F.max(F.col("least").isNotNull() & (F.col("is_parent") | (F.col("least") < F.col("most"))))).first()[0]:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def common_shingles(profile: DataFrame) -> np.ndarray:
    """The most common shingles, most common first: at most ``COMMON``, 8 bytes each."""
    counts = profile.where("kind = 1").groupBy("class").agg(F.sum("n").alias("times"))
    top = counts.orderBy(F.desc("times"), "class").limit(COMMON).select("class").toArrow()
    return top.column("class").to_numpy().view(U64) if top.num_rows else np.zeros(0, U64)


def linked(products: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): the components that the pairs with enough overlap link."""
    return products.where(F.col("overlap") * den >= (F.col("n_a") + F.col("n_b") - F.col("overlap")) * num).select(F.col("component_a").alias("a"), F.col("component_b").alias("b"))


def class_components(docs: DataFrame, profile: DataFrame, width: int, num: int, den: int) -> DataFrame | None:
    """(class, component) of the classes that are linked with a lesser one; None if there are none.

    A turn's links are contracted by themselves, as links between the
    components of the turn before, so that later turns handle few of them.
    """
    spark = docs.sparkSession
    classes = profile.where("kind = 0 AND class IS NOT NULL").groupBy("class").agg(F.min("n").alias("n"), F.min("key").alias("key"), F.max("sketch").alias("sketch"))
    classes = stage(classes, "classes")
    entries = classes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * num / den) + 1)).first()[0]
    if not entries:
        return None
    n_blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // BLOCK_ENTRIES))
    q = stage(shared_entries(tiles(docs, common_shingles(profile), n_blocks, width, num, den), num, den), "entries")
    fits = lambda a, b: F.least(a, b) * den >= F.greatest(a, b) * num
    rows, turns = None, []
    before, turn = float("inf"), 0
    open_ = q.withColumn("component", F.col("class"))
    while True:
        open_ = stage(open_columns(open_, turn, num, den), "open-entries")
        size, across = open_.agg(F.count("*"), F.sum("products")).first()
        if not size:
            break
        # Pivots come first and go on while they settle columns; what they leave is multiplied out.
        last = turn > 0 and (across <= PRODUCTS_PER_ENTRY * size or 2 * across > before)
        if last:
            pairs = across_components(open_, fits, num, den)
        else:
            pairs = with_pivots(open_, fits, num, den)
        pairs = stage(possible(pairs, classes, num, den), "pairs")
        asked = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
        if rows is not None:
            asked = asked.join(rows.select("class"), "class", "left_anti")
        asked = stage(asked.join(classes, "class").select("class", "key"), "asked")
        more = stage(class_rows(docs, asked, width), "class-rows")
        rows = more if rows is None else rows.unionByName(more)
        new = stage(linked(overlaps(pairs, rows), num, den), "links")
        before, turn = across, turn + 1
        if not new.isEmpty():
            turns.append(stage(components(new), "components"))
            if not last:
                open_ = open_.select("shingle", "class", "n", "place", F.col("component").alias("node")).join(turns[-1], "node", "left")
                open_ = open_.withColumn("component", F.coalesce("component", "node"))
        if last:
            break
    whole = None
    for found in reversed(turns):
        # A node is hung up once: what it hangs on may go on in later turns, it does not.
        if whole is not None:
            on = found.join(whole.select(F.col("node").alias("component"), F.col("component").alias("onward")), "component", "left")
            found = on.select("node", F.coalesce("onward", "component").alias("component")).unionByName(whole)
        whole = found
    return None if whole is None else whole.select(F.col("node").alias("class"), "component")


def open_columns(entries: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """The entries of columns that may still link two components, with the column's pivot row and how many products the entry stands for.

    Of a pair that links, the smaller row has an early entry in the first
    column they share. The pivot is at first the row that reaches the column
    earliest, as it has the fewest entries of its own; later any. All windows
    are dealt by column: one shuffle.
    """
    by = F.col("place").cast("long") if turn == 0 else F.xxhash64("class", F.lit(turn))
    column, part = W.partitionBy("shingle"), W.partitionBy("shingle", "component")
    dealt = entries.select("shingle", "class", "n", "place", "component").repartition("shingle")
    rows = dealt.withColumn("early", early(num, den)).withColumns({
        "several": F.min("component").over(column) != F.max("component").over(column), "any": F.max("early").over(column),
        "m": F.count("*").over(column), "within": F.count("*").over(part),
        "pivot": F.min(F.struct(by.alias("by"), "class", "n", "place", "component")).over(column),
    }).where(F.col("several") & F.col("any"))
    products = F.when(F.col("early"), F.col("m") - F.col("within")).otherwise(0).alias("products")
    return rows.select("shingle", "class", "n", "place", "component", "pivot", products)


def with_pivots(entries: DataFrame, fits, num: int, den: int) -> DataFrame:
    """Pairs of each row with its columns' pivots that may reach the bound."""
    n, of = F.col("n"), F.col("pivot.n")
    left = F.least(n - F.col("place"), of - F.col("pivot.place"))
    both = entries.where((F.col("component") != F.col("pivot.component")) & fits(n, of) & (left >= least_common(n, of, num, den)))
    return both.select(F.col("class").alias("a"), F.col("pivot.class").alias("b"), F.col("component").alias("component_a"), F.col("pivot.component").alias("component_b")).distinct()


def early(num: int, den: int):
    """Entries that a row can share first with one of its size or larger: their overlap is 2t/(1+t) of the row at least."""
    return F.col("place") <= F.col("n") - F.ceil(F.col("n") * (2 * num) / (num + den))


def across_components(entries: DataFrame, fits, num: int, den: int) -> DataFrame:
    """Pairs of classes in different components that may reach the size-derived bound.

    All entries that two rows share stand at or after the first of them, so
    the overlap is at most what is left of either row there. Columns that a
    row only reaches late so make no pairs, however common they are.
    """
    side = lambda rows, s: rows.select("shingle", *[F.col(c).alias(f"{c}_{s}") for c in ("class", "n", "place", "component")])
    both = side(entries.where(early(num, den)), "a").join(side(entries, "b"), "shingle")
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("class_a") < F.col("class_b")))
    left = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    both = both.where(smaller & (F.col("component_a") != F.col("component_b")) & fits(F.col("n_a"), F.col("n_b")) & (left >= least_common(F.col("n_a"), F.col("n_b"), num, den)))
    return both.select(F.col("class_a").alias("a"), F.col("class_b").alias("b"), "component_a", "component_b").distinct()


def least_common(n_a, n_b, num: int, den: int):
    """The least overlap of rows that link."""
    return F.ceil((n_a + n_b) * num / (num + den))


def join(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, class (of equal sets), component_id (least doc_id reachable by links), kept.

    Kept are, of each component, the rows of one doc_id and text, the least ones; and all rows without shingles.
    """
    profile = stage(profiles(docs, width), "profiles")
    each = profile.where("kind = 0").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "class")
    parts = class_components(docs, profile, width, num, den)
    classes = each.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash")).alias("first"))
    if parts is None:
        named = classes.select("class", F.col("least").alias("component_id"), "first")
    else:
        classes = classes.join(parts, "class", "left").withColumn("component", F.coalesce("component", "class"))
        ids = classes.groupBy("component").agg(F.min("least").alias("component_id"), F.min("first").alias("first"))
        named = classes.select("class", "component").join(ids, "component").select("class", "component_id", "first")
    alone = F.col("class").isNull()
    return each.join(named, "class", "left").select(
        "doc_id", "text_hash", "n_shingles", "class", F.coalesce("component_id", F.when(alone, F.col("doc_id"))).alias("component_id"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")))).alias("kept"),
    )


def one_of_each(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """One document of each component, as it came: that of the least doc_id, and of several texts of that id the one of the least hash.

    A component without any doc_id keeps the document of the least text hash.
    Rows are told apart by doc_id and text, so a doc_id may repeat with other
    texts; of rows equal in both, one stays, with shingles or without: that
    of the least hash of all its columns. Columns of any names pass through.
    """
    rows = stage(join(docs, width, num, den).select("doc_id", "text_hash", "kept"), "joined")
    dropped = stage(rows.where("NOT kept").select(F.col("doc_id").alias("dropped_id"), F.col("text_hash").alias("dropped_hash")).distinct(), "dropped")
    whole = docs.select(F.struct("*").alias("doc"))
    doc_id, text_hash = F.col("doc.doc_id").cast("long"), F.xxhash64("doc.text")
    # Texts stay where they are, but those that seem to be among the dropped.
    whole = sieved(whole, F.xxhash64(doc_id, text_hash), dropped.select(F.xxhash64("dropped_id", "dropped_hash")))
    unsure = whole.where("perhaps").join(dropped, doc_id.eqNullSafe(F.col("dropped_id")) & (text_hash == F.col("dropped_hash")), "left_anti")
    kept = whole.where("NOT perhaps").unionByName(unsure)
    if not rows.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        same = W.partitionBy(doc_id, text_hash).orderBy(F.xxhash64(F.to_json("doc")))
        kept = kept.withColumn("place", F.row_number().over(same)).where("place = 1")
    return kept.select("doc.*")
