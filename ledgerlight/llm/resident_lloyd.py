"""Vector codes of a product quantiser, trained by member-resident Lloyd rounds.

Vectors are scaled to integers and cut into equal parts; each position has a
codebook. The parts are members of owners, keyed by (position, entry, salt):

* The first assignment deals every part to its owner in one shuffle, packed in
  blocks of many parts. From then on a part stays where it is as long as its
  nearest entry stays the same.
* An owner updates from its resident members: sums and counts of each block,
  combined before they leave the task. A codebook so costs a shuffle of a few
  rows a task, and the driver only ever holds codebooks.
* Before the next round each owner assigns its residents again. Only the parts
  that change entry are written to the next shuffle, to the owner of their new
  entry; the residents' sums go along. A part that left is told from one that
  stayed by the codebooks since it was dealt, so what stays is never rewritten.

An entry may hold any share of the parts: the salt belongs to the block, so an
owner has about ``OWNER_MEMBERS`` parts at most even if one entry holds all.
Dealt members are tables in the shared folder; lost executors cost their tasks.

Codes are the nearest entries of the last codebooks, which are bounded
(entries x dimensions) and sent to the tasks of one narrow pass.

Cases: rows whose vector is null or holds null or non-finite components are
dropped, and so are rows whose vector is of another length than that of the
smallest kept id; a length that the parts do not divide is filled up with
zeros. Scaled components are held at the largest magnitude whose error
certainly fits a long (524,288 before scaling, at 64 dimensions). Null ids come
last; of rows with one id the lesser vector comes first. With fewer vectors
than entries the codebooks are smaller; repeated rows count each time; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.llm.wordbytes import mix64
from ledgerlight.session import stage

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
WINDOW = 16_384  # vectors that a task packs into blocks at once
OWNER_MEMBERS = 1 << 20
MEMBERS = "position int, entry int, salt int, n long, sums array<long>, members binary"


def usable(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows with a vector of finite components."""
    x = F.col(vector)
    return embeddings.where(x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))))


def scaled(column: pa.Array, dim: int, parts: int, scale: int) -> np.ndarray:
    """(vector, position, component) of integers."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    most = math.isqrt((1 << 62) // max(dim, 1)) // 2
    x = np.clip(np.floor(flat.astype(np.float64) * scale), -most, most).astype(np.int64).reshape(len(column), dim)
    width = -(-dim // parts)
    if width * parts != dim:
        x = np.concatenate([x, np.zeros((len(x), width * parts - dim), np.int64)], axis=1)
    return x.reshape(len(x), parts, width)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest entry of each part; of ties the lowest."""
    entry, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    if not x.shape[1]:
        return entry, error
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    # All terms are whole numbers below 2**53, so doubles hold them exactly.
    doubles = 4 * x.shape[1] * most * most < 1 << 52
    at = max(1, (1 << 20) // (len(book) * (1 if doubles else x.shape[1])))
    for a in range(0, len(x), at):
        part = x[a : a + at]
        if doubles:
            p, b = part.astype(np.float64), book.astype(np.float64)
            far = (p * p).sum(1)[:, None] - 2 * (p @ b.T) + (b * b).sum(1)
        else:
            far = np.square(part[:, None, :] - book[None]).sum(2)
        entry[a : a + at] = far.argmin(1)
        error[a : a + at] = far.min(1)
    return entry, error


def blocks(position: int, entry: np.ndarray, salt: int, x: np.ndarray, out: list[tuple]) -> None:
    """One packed row for each entry that parts of ``x`` go to."""
    by = np.argsort(entry, kind="stable")
    ends = np.flatnonzero(np.diff(entry[by], append=-1)) + 1
    for a, z in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        out.append((position, int(entry[by[a]]), salt, None, None, x[by[a:z]].astype("<i4").tobytes()))


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["position", "entry", "salt", "n", "sums", "members"])


def first_members(rows: DataFrame, vector: str, books: np.ndarray, dim: int, scale: int, salts: int) -> DataFrame:
    """Every part, packed by position and nearest entry of the first codebooks."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, window = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a in range(0, batch.num_rows, WINDOW):
                x = scaled(batch.column(0).slice(a, WINDOW), dim, len(books), scale)
                salt = int(mix64(np.array([(task << 24) + window], np.uint64))[0] % np.uint64(salts))
                window += 1
                out: list[tuple] = []
                for position, book in enumerate(books):
                    blocks(position, nearest(x[:, position], book)[0], salt, x[:, position], out)
                yield batch_of(out)

    return rows.select(vector).mapInArrow(scan, MEMBERS)


def unpacked(members: bytes, width: int) -> np.ndarray:
    return np.frombuffer(members, "<i4").astype(np.int64).reshape(-1, width)


def owner_sums(members: DataFrame, width: int) -> DataFrame:
    """(position, entry, n, sums): what each owner's residents and the sums dealt with them come to, combined within a task's batch."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[tuple[int, int], list] = {}
            for row in batch.to_pylist():
                n, sums = row["n"], row["sums"]
                if row["members"] is not None:
                    x = unpacked(row["members"], width)
                    n, sums = len(x), x.sum(0)
                kept = total.setdefault((row["position"], row["entry"]), [0, np.zeros(width, np.int64)])
                kept[0] += n
                kept[1] += np.asarray(sums, np.int64)
            keys = list(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k][0] for k in keys], pa.int64()),
                 pa.array([total[k][1].tolist() for k in keys], pa.list_(pa.int64()))], ["position", "entry", "n", "sums"])

    return members.mapInArrow(scan, "position int, entry int, n long, sums array<long>")


def migrants(dealt: Sequence[DataFrame], books: Sequence[np.ndarray], width: int) -> DataFrame:
    """What the next shuffle carries: parts that change entry under the last of ``books``, and the sums of those that stay.

    ``dealt[i]`` are the members dealt for ``books[i]``. One of them is still
    resident if its entry has been the nearest in every codebook since.
    """
    sent = dealt[0].sparkSession.sparkContext.broadcast(list(books))
    residents = None
    for since, table in enumerate(dealt):
        part = table.where("members IS NOT NULL").select("position", "entry", "salt", F.lit(since).alias("since"), "members")
        residents = part if residents is None else residents.unionByName(part)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay: dict[tuple[int, int, int], list] = {}
            out: list[tuple] = []
            for row in batch.to_pylist():
                position, entry, salt = row["position"], row["entry"], row["salt"]
                x = unpacked(row["members"], width)
                for book in sent.value[row["since"] + 1 : -1]:
                    x = x[nearest(x, book[position])[0] == entry]
                now = nearest(x, sent.value[-1][position])[0]
                here = now == entry
                kept = stay.setdefault((position, entry, salt), [0, np.zeros(width, np.int64)])
                kept[0] += int(here.sum())
                kept[1] += x[here].sum(0)
                if not here.all():
                    blocks(position, now[~here], salt, x[~here], out)
            out += [(*owner, n, sums.tolist(), None) for owner, (n, sums) in stay.items() if n]
            yield batch_of(out)

    return residents.mapInArrow(scan, MEMBERS)


def deal(members: DataFrame, name: str) -> DataFrame:
    return stage(members.repartition("position", "entry", "salt"), name)


def updated(books: np.ndarray, members: DataFrame) -> np.ndarray:
    """Each entry becomes the floor of its members' mean; an entry without members stays."""
    parts = owner_sums(members, books.shape[2]).select("position", "entry", "n", F.posexplode("sums").alias("component", "part"))
    rows = parts.groupBy("position", "entry", "component").agg(F.sum("n").alias("n"), F.sum("part").alias("total")).toArrow()
    out = books.copy()
    position, entry, component, n, total = (rows.column(i).to_numpy() for i in range(5))
    out[position, entry, component] = total // np.maximum(n, 1)
    return out


def train(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[np.ndarray, int] | None:
    """(codebooks as position x entry x component, dimensions); None if no row is usable."""
    rows = usable(embeddings, vector).select(key, vector)
    least = lambda frame: frame.orderBy(F.col(key).asc_nulls_last(), vector).limit(entries).toArrow().column(vector)
    first = least(rows)
    if not len(first):
        return None
    dim = len(first[0])
    rows = rows.where(F.size(vector) == dim)
    if any(len(v) != dim for v in first):
        first = least(rows)
    books = scaled(first, dim, parts, scale).swapaxes(0, 1).copy()
    if not dim:
        return books, dim
    salts = max(1, -(-embeddings.count() // OWNER_MEMBERS))
    known, dealt = [books], [deal(first_members(rows, vector, books, dim, scale, salts), "members")]
    for turn in range(1, rounds + 1):
        known.append(updated(known[-1], dealt[-1]))
        if turn < rounds:
            dealt.append(deal(migrants(dealt, known, books.shape[2]), "members"))
    return known[-1], dim


def encode(embeddings: DataFrame, books: np.ndarray, dim: int, vector: str = "embedding", keep: Sequence[str] = ("vec_id", "label"), scale: int = SCALE) -> DataFrame:
    """The ``keep`` columns, code (two hex digits a part) and error (squared distances, summed) of every usable row."""
    rows = usable(embeddings, vector).where(F.size(vector) == dim).select(*keep, vector)
    sent = rows.sparkSession.sparkContext.broadcast(books)
    fields = [rows.schema[c] for c in keep] + [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = scaled(batch.column(len(keep)), dim, len(sent.value), scale)
            codes, error = np.zeros(x.shape[:2], np.uint8), np.zeros(len(x), np.int64)
            for position, book in enumerate(sent.value):
                entry, far = nearest(x[:, position], book)
                codes[:, position] = entry
                error += far
            text = codes.tobytes().hex()
            step = 2 * codes.shape[1]
            code = [text[i : i + step] for i in range(0, len(text), step)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(code, pa.string()), pa.array(error)], [*keep, "code", "error"])

    return rows.mapInArrow(scan, T.StructType(fields))


def books_text(books: np.ndarray) -> str:
    """All entries' components by part, entry and place within the part."""
    return ",".join(map(str, books.ravel().tolist()))


def codes(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error (summed over rows of an equal label) and codebooks_sha256 of every usable row."""
    found = train(embeddings, parts=parts, entries=entries, rounds=rounds, scale=scale)
    books, dim = found if found else (np.zeros((parts, 0, 0), np.int64), 0)
    kept = embeddings if found else embeddings.limit(0)
    rows = stage(encode(kept, books, dim, scale=scale), "codes")
    errors = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    rows = rows.join(errors, F.col("label").eqNullSafe(F.col("of")))
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same rows: every part's nearest entry by the least (distance, entry), every entry the floor of a mean."""
    text = f"""
WITH rows AS (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id, embedding) AS row FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), components AS (
  SELECT row, unnest(range(len(embedding))) AS place, unnest(list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT)) AS x, len(embedding) // {parts} AS width FROM rows
), parts AS (
  SELECT row, (place // width)::INT AS position, list(x ORDER BY place) AS part FROM components GROUP BY row, position
), book0 AS (
  SELECT position, (row - 1)::INT AS entry, part FROM parts WHERE row <= {entries}
)"""
    near = """, near{0} AS (
  SELECT p.row, p.position, p.part, min({{'far': list_sum(list_transform(list_zip(p.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'entry': b.entry}}) AS best
  FROM parts p JOIN book{0} b ON p.position = b.position GROUP BY p.row, p.position, p.part
)"""
    for turn in range(rounds):
        text += near.format(turn)
        text += """, places{1} AS (
  SELECT position, best.entry AS entry, unnest(range(len(part))) AS place, unnest(part) AS x FROM near{0}
), means{1} AS (
  SELECT position, entry, list(mean ORDER BY place) AS part
  FROM (SELECT position, entry, place, floor(sum(x) / count(*))::BIGINT AS mean FROM places{1} GROUP BY position, entry, place) GROUP BY position, entry
), book{1} AS (
  SELECT b.position, b.entry, coalesce(m.part, b.part) AS part FROM book{0} b LEFT JOIN means{1} m ON b.position = m.position AND b.entry = m.entry
)""".format(turn, turn + 1)
    text += near.format(rounds)
    return text + f""", coded AS (
  SELECT row, string_agg(printf('%02x', best.entry), '' ORDER BY position) AS code, sum(best.far)::BIGINT AS error FROM near{rounds} GROUP BY row
), digest AS (
  SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY position, entry)) AS codebooks_sha256 FROM book{rounds}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM rows JOIN coded USING (row), digest
"""
