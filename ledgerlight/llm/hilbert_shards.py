"""Shards along a Hilbert curve over document metadata, for multidimensional file pruning.

Each dimension of a document (by default source, language and length) is
quantised to ``2**bits`` bins; the bins are coordinates of a Hilbert curve,
whose neighbours along the curve differ by one bin in one dimension. Documents
are put in order of their curve index, and the order is cut into shards of
equal row counts (``law="rows"``: at most one apart) or of near equal bytes
(``law="bytes"``: a cut falls within half a document of its place). A run of
the curve covers a compact box of the metadata, so the files of a shard have
narrow ranges in every dimension.

How it scales: texts are read once, into narrow rows; equal rows become one
row with a count before the shuffle. The order is two-level: cells of the curve
(4,096) are summed by partial aggregation, and a cell is cut into slices by a
hash of id and checksum, as many as its rows ask for, so that a cell with a third of all
documents meets neither one task nor one sort. Positions come from the sums
before a cell, before a slice, and before a row of a slice.

Cases: a null text has no bytes (size 1) and the checksum of an empty one; a
null source, language or doc_id is a value of its own; equal rows get
consecutive slots; with fewer rows than shards some shards are empty; an empty
table gives an empty result. Rows may hold any columns that can be hashed (no
maps); they are compared by a 64-bit hash of all columns beside doc_id,
checksum and size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.session import stage

BITS = 4
SHARDS = 8
SLICE_ROWS = 2_000
KEYS = ("doc_id", "size", "text_crc32", "row", "curve", "place")
LAWS = ("rows", "bytes")


def curve_table(n: int) -> tuple[list[int], list[int]]:
    """(digit, next state) of each state * 2**n + corner of the curve in ``n`` dimensions.

    A state is the corner where the curve enters a cube and the axis it leaves
    along; within the cube the corners follow a reflected Gray code, and each
    sub-cube is turned so that its ends meet its neighbours'.
    """
    size = 1 << n
    gray = [i ^ i >> 1 for i in range(size)]
    place = {g: i for i, g in enumerate(gray)}
    ones = lambda i: (~i & i + 1).bit_length() - 1  # noqa: E731  (trailing ones)
    enters = [0] + [gray[2 * ((i - 1) // 2)] for i in range(1, size)]
    leaves = [0] + [(ones(i) if i % 2 else ones(i - 1)) % n for i in range(1, size)]
    turn = lambda x, by: (x << by | x >> n - by) & size - 1
    digits, states = [], []
    for state in range(n * size):
        enter, axis = divmod(state, n)
        for corner in range(size):
            digit = place[turn(corner ^ enter, n - (axis + 1) % n)]
            digits.append(digit)
            states.append((enter ^ turn(enters[digit], (axis + 1) % n)) * n + (axis + leaves[digit] + 1) % n)
    return digits, states


def curve_index(dims: Sequence[Column], bits: int = BITS) -> Column:
    """Index along the Hilbert curve of a point whose coordinates are in [0, 2**bits)."""
    n = len(dims)
    digits, states = (F.lit(t) for t in curve_table(n))

    def step(acc: Column, power: Column) -> Column:
        corner = F.lit(0)
        for j, x in enumerate(dims):
            corner = corner + (F.floor(x / power) % 2).cast("int") * (1 << j)
        at = acc["state"] * (1 << n) + corner + 1
        return F.struct((acc["index"] * (1 << n) + F.element_at(digits, at)).cast("int").alias("index"), F.element_at(states, at).cast("int").alias("state"))

    powers = F.array(*[F.lit(1 << b) for b in reversed(range(bits))])
    return F.aggregate(powers, F.struct(F.lit(0).alias("index"), F.lit(0).alias("state")), step, lambda acc: acc["index"])


def spread(value: Column) -> Column:
    """A number in [0, 2**60) from the md5 of a string."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("long")


def category_bin(value: Column, bits: int = BITS) -> Column:
    """A bin by hash, so that any number of categories fits; null has bin 0."""
    return F.coalesce(spread(value.cast("string")) % (1 << bits), F.lit(0)).cast("int")


def length_bin(n: Column, bits: int = BITS) -> Column:
    """Powers of two; the last bin is open."""
    return F.least(F.length(F.bin(n)) - 1, F.lit((1 << bits) - 1))


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def default_dims(bits: int = BITS) -> list[Column]:
    return [category_bin(F.col("source"), bits), category_bin(F.col("lang"), bits), length_bin(size_of(F.col("text")), bits)]


def described(docs: DataFrame, dims: Sequence[Column] | None = None, bits: int = BITS) -> list[Column]:
    """Narrow columns of a document: doc_id, size, text_crc32, row (hash of all columns), its curve index and its place in the cell."""
    crc = F.coalesce(F.crc32("text"), F.lit(0)).cast("long")
    place = spread(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), crc.cast("string")))
    return [
        F.col("doc_id"), size_of(F.col("text")).alias("size"), crc.alias("text_crc32"), F.xxhash64(*[docs[c] for c in docs.columns]).alias("row"),
        curve_index(dims or default_dims(bits), bits).alias("curve"), place.alias("place"),
    ]


def positions(groups: DataFrame) -> DataFrame:
    """The groups of equal rows (with their count n) with at_row and at_byte: rows and bytes before them in curve order."""
    total = [F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("size")).alias("bytes")]
    ahead = lambda w, c: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(c)
    cells = groups.groupBy("curve").agg(*total, F.count("*").alias("groups"))
    along = Window.orderBy("curve")
    cells = cells.select("curve", F.ceil(F.col("groups") / SLICE_ROWS).alias("slices"), ahead(along, "rows").alias("cell_row"), ahead(along, "bytes").alias("cell_byte"))
    cells = stage(cells, "hilbert-cells")
    sliced = groups.join(cells.select("curve", "slices"), "curve").withColumn("slice", F.floor(F.col("place") / 2.0**60 * F.col("slices"))).drop("slices")
    slices = sliced.groupBy("curve", "slice").agg(*total)
    within = Window.partitionBy("curve").orderBy("slice")
    slices = slices.select("curve", "slice", ahead(within, "rows").alias("slice_row"), ahead(within, "bytes").alias("slice_byte")).join(cells, "curve")
    slices = slices.select("curve", "slice", (F.col("cell_row") + F.col("slice_row")).alias("row0"), (F.col("cell_byte") + F.col("slice_byte")).alias("byte0"))
    rows = sliced.join(slices, ["curve", "slice"]).withColumn("bytes", F.col("n") * F.col("size"))
    in_order = Window.partitionBy("curve", "slice").orderBy("place", "doc_id", "text_crc32", "size", "row")
    return rows.withColumn("at_row", F.col("row0") + ahead(in_order, "n")).withColumn("at_byte", F.col("byte0") + ahead(in_order, "bytes"))


def assign(docs: DataFrame, law: str = "rows", shards: int = SHARDS, dims: Sequence[Column] | None = None, bits: int = BITS) -> DataFrame:
    """One row per document: the narrow columns with its shard and slot (position in the shard, along the curve)."""
    if law not in LAWS:
        raise ValueError(f"law must be one of {LAWS}")
    groups = docs.select(described(docs, dims, bits)).groupBy(*KEYS).agg(F.count("*").alias("n"))
    groups = stage(groups, "hilbert-groups")
    n_rows, n_bytes = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0))).first()
    rows = positions(groups).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    rows = rows.withColumn("at_row", F.col("at_row") + F.col("copy")).withColumn("at_byte", F.col("at_byte") + F.col("copy") * F.col("size"))
    names = [*KEYS, "shard"]
    if law == "rows":
        # Shard s holds the places from ceil(s * rows / shards) on.
        rows = rows.withColumn("shard", F.expr(f"at_row * {shards} DIV {max(n_rows, 1)}").cast("int"))
        return rows.select(*names, (F.col("at_row") - F.expr(f"(shard * {n_rows}L + {shards - 1}) DIV {shards}")).alias("slot"))
    # The shard that the document's middle byte falls into.
    rows = stage(rows.withColumn("shard", F.expr(f"(2 * at_byte + size) * {shards} DIV {max(2 * n_bytes, 1)}").cast("int")).select(*names, "at_row"), "hilbert-rows")
    first = rows.groupBy("shard").agg(F.min("at_row").alias("first"))
    return rows.join(first, "shard").select(*names, (F.col("at_row") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, law: str = "bytes", shards: int = SHARDS, dims: Sequence[Column] | None = None, bits: int = BITS, files: int | None = None) -> str:
    """Write whole documents as Parquet, one folder a shard, rows in curve order; returns the partition column's name.

    ``files`` is how many runs are written (by default as many as there are
    shuffle partitions). Texts are shuffled once to meet their places, equal
    rows as one, and once to be written in order.
    """
    spark = docs.sparkSession
    unused = lambda name: name if name not in docs.columns else unused(f"{name}_")
    shard = unused("shard")
    placed = assign(docs, law, shards, dims, bits)
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("document"), *described(docs, dims, bits)).dropDuplicates(list(KEYS))
    same = [placed[k].eqNullSafe(whole[k]) if k == "doc_id" else placed[k] == whole[k] for k in KEYS]
    on = same[0]
    for condition in same[1:]:
        on = on & condition
    rows = placed.join(whole, on).select("document", placed["shard"].alias("to"), placed["slot"].alias("at"))
    runs = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(runs, "to", "at").sortWithinPartitions("to", "at")
    rows.select("document.*", F.col("to").alias(shard)).write.partitionBy(shard).parquet(path)
    return shard


def shard_rows(docs: DataFrame, law: str = "rows", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: neither law keeps shards when their number grows)."""
    rows = assign(docs, law, shards)
    return rows.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def oracle_sql(law: str = "rows", shards: int = SHARDS, bits: int = BITS) -> str:
    """The same rows by plain windows; the checksum is computed byte by byte, from its polynomial."""
    digits, states = curve_table(3)
    steps = "".join(
        f""", level{b} AS (
  SELECT * EXCLUDE (index, state, corner), index * 8 + digits[state * 8 + corner + 1] AS index, states[state * 8 + corner + 1] AS state
  FROM (SELECT *, ((d0 >> {b}) & 1) + 2 * ((d1 >> {b}) & 1) + 4 * ((d2 >> {b}) & 1) AS corner FROM {'binned' if b == bits - 1 else f'level{b + 1}'})
)""" for b in reversed(range(bits)))
    cut = {
        "rows": f"(at_row * {shards}) // n_rows",
        "bytes": f"((2 * at_byte + size) * {shards}) // (2 * n_bytes)",
    }[law]
    return f"""
WITH RECURSIVE steps AS (
  SELECT i AS byte, i AS value, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT byte, CASE WHEN value % 2 = 1 THEN xor(value >> 1, 3988292384) ELSE value >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (
  SELECT list(value ORDER BY byte) AS t FROM steps WHERE k = 8
), sized AS (
  SELECT doc_id, source, lang, coalesce(octet_length(encode(text)), 0)::BIGINT + 1 AS size,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295)::BIGINT AS text_crc32
  FROM documents, crc
), binned AS (
  SELECT doc_id, size, text_crc32, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || text_crc32), 1, 15))::BIGINT AS place,
    coalesce(('0x' || substr(md5(source), 1, 15))::BIGINT % {1 << bits}, 0)::INT AS d0, coalesce(('0x' || substr(md5(lang), 1, 15))::BIGINT % {1 << bits}, 0)::INT AS d1,
    least(length(bin(size)) - 1, {(1 << bits) - 1})::INT AS d2, 0 AS index, 0 AS state, {digits} AS digits, {states} AS states
  FROM sized
){steps}, ordered AS (
  SELECT doc_id, size, text_crc32, row_number() OVER run - 1 AS at_row, (sum(size) OVER run - size)::BIGINT AS at_byte, count(*) OVER () AS n_rows, (sum(size) OVER ())::BIGINT AS n_bytes
  FROM level0 WINDOW run AS (ORDER BY index, place, doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING)
), cut AS (
  SELECT *, ({cut})::INT AS shard FROM ordered
)
SELECT doc_id, size, text_crc32, '{law}' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY at_row) - 1)::BIGINT AS slot, NULL::INT AS grown_shard FROM cut
"""
