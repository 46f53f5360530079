"""Vector codes, Hilbert shards and periodic runs: brute force, planted cases and odd rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlight.llm import grammar_runs, hilbert_shards, queries, resident_lloyd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Vector codes


def lloyd(rows, parts, entries, rounds):
    """(codes, errors, codebooks) by plain loops over whole numbers."""
    rows = sorted(rows)
    vectors = [[int(np.floor(256 * float(x))) for x in v] for _, v in rows]
    width = len(vectors[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in vectors]
    books = [[cut[i][p] for i in range(min(entries, len(cut)))] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            members = collections.defaultdict(list)
            for v in cut:
                members[near(v[p], book)[1]].append(v[p])
            books[p] = [[sum(c) // len(members[i]) for c in zip(*members[i], strict=True)] if i in members else e for i, e in enumerate(book)]
    found = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    return ["".join(f"{i:02x}" for _, i in f) for f in found], [sum(d for d, _ in f) for f in found], books


@pytest.mark.parametrize("rounds", [1, 2, 5])
def test_codes_by_plain_loops(spark, rounds):
    rng = np.random.default_rng(rounds)
    centres = rng.normal(size=(12, 32))
    vectors = (centres[rng.integers(0, 12, 300)] + rng.normal(scale=0.3, size=(300, 32))).astype("float32")
    vectors[100:200] = vectors[0]  # a third of all rows is one vector
    rows = [(i // 2, v.tolist(), i % 3 or None) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(7)
    got = resident_lloyd.codes(table, parts=8, entries=10, rounds=rounds).collect()
    codes, errors, books = lloyd([(i, v) for i, v, _ in rows], 8, 10, rounds)
    assert sorted((r.vec_id, r.code, r.error) for r in got) == sorted(zip([i for i, _ in sorted((i, v) for i, v, _ in rows)], codes, errors, strict=True))
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()}
    assert len({r.label_error for r in got}) == 3 and sum({r.label_error for r in got}) == sum(errors)


def test_only_changed_parts_migrate(spark):
    """The second deal carries the parts whose nearest entry changed, and the sums of all the others."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 16)).astype("float32")
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    parts = np.floor(x.astype("float64") * 256).astype("int64").reshape(500, 4, 4)
    books = parts[:8].swapaxes(0, 1).copy()
    first = resident_lloyd.deal(resident_lloyd.first_members(table, "embedding", books, 16, 256, 1), "t")
    after = resident_lloyd.updated(books, first)
    moved = resident_lloyd.migrants([first], [books, after], 4).collect()
    changed = sum((resident_lloyd.nearest(parts[:, p], books[p])[0] != resident_lloyd.nearest(parts[:, p], after[p])[0]).sum() for p in range(4))
    assert 0 < changed < 2000 and sum(len(r.members) // 16 for r in moved if r.members is not None) == changed
    assert sum(r.n for r in moved if r.n is not None) == 2000 - changed


def test_codes_of_odd_rows(spark):
    schema = "vec_id long, embedding array<double>, label string, code string, error int, `of` string"
    nan, inf = float("nan"), float("inf")
    good = [0.25 * i for i in range(16)]
    rows = [(1, good), (1, good), (2, None), (3, [nan] * 16), (4, [inf] + good[1:]), (5, [None] + good[1:]), (6, []), (7, good[:5]), (None, good), (8, [1e300] * 16), (9, [-1e300] * 16)]
    table = spark.createDataFrame([(*r, None, "c", 1, "o") for r in rows], schema)
    got = resident_lloyd.codes(table).collect()
    assert sorted(r.vec_id or 0 for r in got) == [0, 1, 1, 8, 9] and all(len(r.code) == 32 and r.error >= 0 for r in got)
    assert len({r.label_error for r in got}) == 1
    assert resident_lloyd.codes(table.limit(0)).count() == 0 and resident_lloyd.codes(table.where("vec_id = 2")).count() == 0
    ragged = spark.createDataFrame([(i, [float(i + j) for j in range(5)], "l") for i in range(9)], "vec_id long, embedding array<double>, label string")
    assert all(len(r.code) == 32 and r.error == 0 for r in resident_lloyd.codes(ragged).collect())


# Shards


@pytest.mark.parametrize("n,bits", [(1, 4), (2, 3), (3, 3), (4, 2)])
def test_curve_visits_neighbours(spark, n, bits):
    points = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=n)), [f"x{i}" for i in range(n)])
    rows = sorted((r.h, tuple(r)[:-1]) for r in points.withColumn("h", hilbert_shards.curve_index([F.col(f"x{i}") for i in range(n)], bits)).collect())
    assert [h for h, _ in rows] == list(range(1 << n * bits))
    assert all(sum(abs(x - y) for x, y in zip(p, q, strict=True)) == 1 for (_, p), (_, q) in zip(rows, rows[1:], strict=False))


def check_shards(docs, rows, law, shards=8):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    held = collections.defaultdict(list)
    for r in rows:
        held[r.shard].append(r)
        assert r.law == law and r.grown_shard is None
    assert set(held) <= set(range(shards))
    assert all(sorted(r.slot for r in part) == list(range(len(part))) for part in held.values())
    if law == "rows":
        counts = [len(held[s]) for s in range(shards)]
        assert max(counts) - min(counts) <= 1
    else:
        sizes = [sum(r.size for r in held[s]) for s in range(shards)]
        assert max(sizes) - min(sizes) <= 2 * max((r.size for r in rows), default=0)


@pytest.mark.parametrize("law", hilbert_shards.LAWS)
def test_shards_of_the_small_table(spark, small, law):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{small}/documents.parquet").to_pylist()]
    rows = hilbert_shards.shard_rows(spark.read.parquet(f"{small}/documents.parquet"), law)
    check_shards(docs, rows.collect(), law)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
        assert sorted(con.execute(hilbert_shards.oracle_sql(law)).fetchall()) == sorted(map(tuple, rows.collect()))


@pytest.mark.parametrize("law", hilbert_shards.LAWS)
def test_shards_of_odd_rows(spark, law, monkeypatch):
    monkeypatch.setattr(hilbert_shards, "SLICE_ROWS", 3)
    schema = "doc_id long, text string, lang string, source string, shard string, slot long, row string, curve int, n int"
    texts = [(1, None), (1, ""), (2, "a b"), (None, "a b"), (None, None), (3, "é" * 50_000)] + [(7, "copy")] * 40 + [(8, f"t{i}") for i in range(30)]
    docs = spark.createDataFrame([(i, t, None if i == 2 else "en", "s", "x", 1, "r", 5, 6) for i, t in texts], schema)
    rows = hilbert_shards.shard_rows(docs, law)
    check_shards(texts, rows.collect(), law)
    assert sorted(map(str, rows.collect())) == sorted(map(str, hilbert_shards.shard_rows(docs.repartition(5), law).collect()))
    check_shards(texts[:3], hilbert_shards.shard_rows(docs.limit(3), law).collect(), law)
    assert hilbert_shards.shard_rows(docs.limit(0), law).count() == 0


def test_written_shards_prune(spark, small, tmp_path):
    """The files hold every row as it came, as many as the law says, and a filter on metadata meets few of them."""
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("shard", F.lit("theirs"))
    name = hilbert_shards.write_shards(docs, str(tmp_path / "h"), law="rows", files=16)
    back = spark.read.parquet(str(tmp_path / "h"))
    assert name == "shard_" and back.drop(name).exceptAll(docs).count() == 0 and back.count() == docs.count()
    assert sorted(r["count"] for r in back.groupBy(name).count().collect()) == [25] * 8
    dims = hilbert_shards.default_dims()
    boxes = back.withColumns({f"d{i}": d for i, d in enumerate(dims)}).withColumn("file", F.input_file_name())
    spans = boxes.groupBy("file").agg(*[(F.max(f"d{i}") - F.min(f"d{i}")).alias(f"d{i}") for i in range(3)])
    mixed = docs.withColumns({f"d{i}": d for i, d in enumerate(dims)}).agg(*[(F.max(f"d{i}") - F.min(f"d{i}")).alias(f"d{i}") for i in range(3)]).first()
    means = spans.agg(*[F.avg(f"d{i}") for i in range(3)]).first()
    assert sum(means) < 0.6 * sum(mixed)
    with pytest.raises(ValueError):
        hilbert_shards.assign(docs, "key")


# Periodic runs


def runs_by_force(x, exponent=4, least=6):
    n, out = len(x), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            a = i
            while i < n - q and x[i] == x[i + q]:
                i += 1
            length = i - a + q
            if i > a and length >= max(least, exponent * q) and not any(x[a : a + length - p] == x[a + p : a + length] for p in range(1, q)):
                out.append((a, a + length, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(deadline=None, max_examples=300)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(1, 9)), max_size=6))
def test_runs_by_force(pieces):
    x = [w for words, times in pieces for w in words * times]
    assert grammar_runs.runs_of(x) == runs_by_force(x)


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(1500):
        x = [rng.randrange(rng.choice((1, 2, 3))) for _ in range(rng.randint(0, 80))]
        assert grammar_runs.runs_of(x) == runs_by_force(x)
        assert grammar_runs.runs_of(x, 5, 12) == runs_by_force(x, 5, 12) and grammar_runs.runs_of(x, 4, 4) == runs_by_force(x, 4, 4)
    with pytest.raises(ValueError):
        grammar_runs.runs_of([1] * 9, 3)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 3), min_size=2, max_size=200))
def test_grammar_derives_its_text(x):
    left, rules, first = grammar_runs.re_pair([x, x[:3]])
    words = lambda s: [s] if s < first else words(rules[s - first][0]) + words(rules[s - first][1])
    assert [[w for s in piece for w in words(s)] for piece in left] == [x, x[:3]]


def digest(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = runs_by_force(words)
    dropped = {i for a, z, q in runs for i in range(a + q, z)}
    best = max(runs, key=lambda r: (Fraction(r[1] - r[0], r[2]), -r[0], -r[2]), default=None)
    top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    lines = "".join(f"{a},{z - a},{q}\n" for a, z, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_run_query_by_force(spark, small):
    docs = [r for r in pq.read_table(f"{small}/documents.parquet").to_pylist() if len(r["text"] or "") < 6000]
    ids = {r["doc_id"] for r in docs}
    got = {r.doc_id: tuple(r) for r in queries.op13_grammar_runs(spark, small).collect()}
    assert len(got) == 200 and all(got[r["doc_id"]] == digest(r["doc_id"], r["text"]) for r in docs)
    assert sum(got[i][1] > 0 for i in ids) > 5


def test_runs_of_odd_rows(spark):
    texts = [
        (1, None), (2, ""), (3, " \n\t\x0b"), (4, "a a a a a a"), (4, "a a a a a a"), (None, "x\ty  x y x\ny x y z"), (5, "a a a a a"),
        (6, "w " * 200_000), (7, " ".join(f"w{i}" for i in range(100_000))), (8, "é ß " * 3 + "é"), (9, "x" * 100_000),
    ]
    docs = spark.createDataFrame([(i, t, 1, "r", 2) for i, t in texts], "doc_id long, text string, n_words int, runs string, collapsed int")
    got = grammar_runs.detect(docs).collect()
    seen = {(r.doc_id, r.n_words): ([(x.start, x.length, x.period) for x in r.runs], r.collapsed) for r in got}
    assert len(got) == 11 and seen[4, 6] == ([(0, 6, 1)], "a") and seen[5, 5] == ([], "a a a a a")
    assert seen[None, 9] == ([(0, 8, 2)], "x y z") and seen[6, 200_000] == ([(0, 200_000, 1)], "w")
    assert seen[1, 0] == seen[2, 0] == seen[3, 0] == ([], "") and seen[7, 100_000][0] == [] and seen[8, 7] == ([], "é ß é ß é ß é")
    assert grammar_runs.detect(docs.limit(0)).count() == 0
    rows = grammar_runs.digests(grammar_runs.detect(grammar_runs.repeated_tails(docs.where("n_words = 1 AND doc_id < 5 OR doc_id IS NULL")))).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(str(digest(i, t)) for i, t in texts if i is None or i < 5)
