"""Periodic runs of words, found on a Re-Pair grammar of each document.

A run is a stretch of words with smallest period q that repeats at least
``EXPONENT`` times, is at least ``LEAST`` words long and is extended by neither
neighbour. Within a document:

* An adjacent pair of words inside a run occurs in it ``EXPONENT`` - 1 times or
  more, so the document is cut at rarer pairs; most texts have nothing left.
* Re-Pair replaces the most frequent pair by a nonterminal until no pair occurs
  twice; of equally frequent pairs the oldest goes first, which keeps rules
  balanced. What is left of a stretch becomes a balanced tree of further rules.
* Every run crosses the boundary of exactly one lowest rule that holds it
  whole. The runs that cross a rule's boundary are computed once, from the
  borders of its two halves, and translated to every place the rule derives.
* A place may show only a part of a run; intervals of one period that overlap
  by that period are one run, so the maximal intervals are kept.

Work is the length of the rules, n log n for a document of n repeating words.
Documents are independent: one narrow pass, no shuffle, no state between rows.

Words are ``[^\\x20\\x09-\\x0D]+``. Cases: a null, empty or blank text has no
words and no runs; very long texts and texts of one word over and over are
handled whole; null and repeated doc_ids are kept row by row; an empty table
gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXPONENT = 4
LEAST = 6
SPACE = r"[\x20\x09-\x0D]+"
Run = tuple[int, int, int]  # start, end, period


def stretches(ids: Sequence[int], exponent: int, least: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches all of whose adjacent pairs are frequent enough for a run."""
    if len(ids) < least:
        return []
    pairs = list(zip(ids, ids[1:], strict=False))
    times = Counter(pairs)
    if max(times.values()) < exponent - 1:
        return []
    cuts = [i for i, pair in enumerate(pairs) if times[pair] < exponent - 1]
    begins, ends = [0, *(c + 1 for c in cuts)], [*(c + 1 for c in cuts), len(ids)]
    return [(a, z) for a, z in zip(begins, ends, strict=True) if z - a >= least]


def re_pair(pieces: Sequence[Sequence[int]]) -> tuple[list[list[int]], list[tuple[int, int]], int]:
    """(what is left of each piece, rules, first nonterminal); rule i replaces a pair by the symbol first + i."""
    first = 1 + max(max(p) for p in pieces)
    symbols: list[int] = []
    for piece in pieces:
        symbols += [*piece, -1]  # -1 ends a piece and pairs with nothing
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], list[int]] = {}
    times: Counter[tuple[int, int]] = Counter()
    queues: dict[int, deque[tuple[int, int]]] = {}

    def add(at: int) -> tuple[int, int] | None:
        """Count the pair that begins at ``at``."""
        pair = symbols[at], symbols[after[at]] if after[at] < n else -1
        if pair[0] < 0 or pair[1] < 0:
            return None
        places.setdefault(pair, []).append(at)
        times[pair] += 1
        return pair

    last_same = -2
    for i in range(n - 1):
        # In a row of equal symbols every second pair counts, as pairs must not overlap.
        if symbols[i] == symbols[i + 1] and last_same == i - 1 and symbols[i - 1] == symbols[i]:
            last_same = -2
            continue
        if add(i) and symbols[i] == symbols[i + 1]:
            last_same = i
    for pair, count in times.items():
        if count > 1:
            queues.setdefault(count, deque()).append(pair)
    rules: list[tuple[int, int]] = []
    top = max(queues, default=1)
    while top > 1:
        queue = queues.get(top)
        if not queue:
            top -= 1
            continue
        pair = queue.popleft()
        count = times[pair]
        if count != top:
            if 1 < count < top:
                queues.setdefault(count, deque()).append(pair)
            continue
        name, fresh = first + len(rules), {}
        replaced = 0
        for at in places.pop(pair):
            right = after[at] if at < n else n
            if symbols[at] != pair[0] or right >= n or symbols[right] != pair[1]:
                continue
            left, beyond = before[at], after[right]
            for one in ((symbols[left], pair[0]) if left >= 0 else None, (pair[1], symbols[beyond]) if beyond < n else None):
                if one is not None and one != pair and one in times:
                    times[one] -= 1
            symbols[at], symbols[right] = name, -2  # -2: taken over by its left neighbour
            after[at] = beyond
            if beyond < n:
                before[beyond] = at
            replaced += 1
            for begin in (left, at):
                if begin >= 0 and symbols[begin] != -1 and (made := add(begin)):
                    fresh[made] = None
        del times[pair]
        if replaced:
            rules.append(pair)
        for made in fresh:
            count = times[made]
            if count > 1:
                queues.setdefault(count, deque()).append(made)
                top = max(top, count)
    left_over, piece = [], []
    at = 0
    while at < n:
        if symbols[at] == -1:
            left_over.append(piece)
            piece = []
        else:
            piece.append(symbols[at])
        at = after[at]
    return left_over, rules, first


def prefix_matches(x: Sequence[int]) -> list[int]:
    """For each place, how long the sequence from there agrees with its beginning."""
    n = len(x)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def crossing(x: Sequence[int], m: int, exponent: int, least: int) -> list[Run]:
    """The runs of ``x`` that hold the places m - 1 and m, maximal within ``x``.

    Such a run has two periods on one side of the boundary at least. On the
    right these show as q words from ``m`` that repeat at once; the run goes on
    left as far as words agree with those q later. The left is its mirror.
    """
    n = len(x)
    found: set[Run] = set()
    for mirrored in (False, True):
        y, at = (x[::-1], n - m) if mirrored else (x, m)
        right = y[at:]
        match = prefix_matches(right)
        squares: list[tuple[int, int]] = []
        for q in range(1, min(len(right) // 2, n // exponent) + 1):
            if match[q] < q:
                continue
            end = at + q + match[q]
            # A multiple of a period that ends where that one ends is the same run.
            if any(end == z and q % p == 0 for p, z in squares):
                continue
            squares.append((q, end))
            start = at
            while start > 0 and y[start - 1] == y[start - 1 + q]:
                start -= 1
            if start < at and end - start >= max(least, exponent * q):
                found.add((n - end, n - start, q) if mirrored else (start, end, q))
    runs: list[Run] = []
    for start, end, q in sorted(found, key=lambda r: r[2]):
        if not any(q % p == 0 and a <= start and end <= z for a, z, p in runs):
            runs.append((start, end, q))
    return runs


def runs_of(ids: Sequence[int], exponent: int = EXPONENT, least: int = LEAST) -> list[Run]:
    """All runs of a sequence, by start, then period; ``exponent`` is 4 at least, so that a run has two periods beside any boundary."""
    if exponent < 4:
        raise ValueError("exponent must be 4 at least")
    pieces = stretches(ids, exponent, least)
    if not pieces:
        return []
    left_over, rules, first = re_pair([ids[a:z] for a, z in pieces])
    length: dict[int, int] = {}
    size = lambda s: length.get(s, 1)
    for i, (a, b) in enumerate(rules):
        length[first + i] = size(a) + size(b)
    # What is left of a piece becomes balanced rules, each used once.
    tops: list[tuple[int, int]] = []
    for (begin, _), level in zip(pieces, left_over, strict=True):
        while len(level) > 1:
            paired = []
            for i in range(0, len(level) - 1, 2):
                rules.append((level[i], level[i + 1]))
                paired.append(first + len(rules) - 1)
                length[paired[-1]] = size(level[i]) + size(level[i + 1])
            level = paired + level[len(level) - len(level) % 2 :]
        tops.append((level[0], begin))
    # One place of each rule, parents before children, gives its words.
    place: dict[int, int] = dict(tops)
    for i in reversed(range(len(rules))):
        at = place[first + i]
        a, b = rules[i]
        if a >= first:
            place[a] = at
        if b >= first:
            place[b] = at + size(a)
    own: dict[int, list[Run]] = {}
    holds: set[int] = set()
    for i, (a, b) in enumerate(rules):
        s = first + i
        at, whole = place[s], length[s]
        if whole >= least:
            here = crossing(ids[at : at + whole], size(a), exponent, least)
            if here:
                own[s] = here
        if s in own or a in holds or b in holds:
            holds.add(s)
    shown: dict[int, list[tuple[int, int]]] = {}
    todo = [(s, at) for s, at in tops if s in holds]
    while todo:
        s, at = todo.pop()
        for start, end, q in own.get(s, ()):
            shown.setdefault(q, []).append((at + start, at + end))
        a, b = rules[s - first]
        if a in holds:
            todo.append((a, at))
        if b in holds:
            todo.append((b, at + size(a)))
    return merged(shown)


def merged(shown: dict[int, list[tuple[int, int]]]) -> list[Run]:
    """Maximal intervals: of one period, those that overlap by the period are one."""
    runs: list[Run] = []
    for q, spans in shown.items():
        spans.sort()
        start, end = spans[0]
        for a, z in spans[1:]:
            if a <= end - q:
                end = max(end, z)
            else:
                runs.append((start, end, q))
                start, end = a, z
        runs.append((start, end, q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def detect(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed (each run's first period kept, words joined by a space)."""
    run = T.StructType([T.StructField(f, T.LongType()) for f in ("start", "length", "period")])
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])
    arrow = pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "length", "period")]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found, collapsed = [], [], []
            for text in batch.column(1).cast(pa.large_binary()):
                words = (text.as_py() or b"").split()
                names: dict[bytes, int] = {}
                runs = runs_of([names.setdefault(w, len(names)) for w in words], exponent, least) if len(words) >= least else []
                counts.append(len(words))
                found.append([{"start": a, "length": z - a, "period": q} for a, z, q in runs])
                collapsed.append(b" ".join(kept(words, runs)).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, arrow), pa.array(collapsed, pa.string())], schema.names)

    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def kept(words: list[bytes], runs: Sequence[Run]) -> list[bytes]:
    """The words outside of every run's repeats."""
    if not runs:
        return words
    out: list[bytes] = []
    at = 0
    for a, z in sorted((a + q, z) for a, z, q in runs):
        if a > at:
            out += words[at:a]
        at = max(at, z)
    return out + words[at:]


def repeated_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one document in ten (by the checksum h of its id) repeats a stretch up to its end.

    With g = h // 10 and n words, the words from a = g % n on become copies of
    the p = 1 + (n - a) // (3 + g % 8) words there; such a text is joined by spaces.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).cast("long").alias("g"), F.array_remove(F.split("text", SPACE), "").alias("words"))
    n = F.size("words").cast("long")
    a = F.col("g") % F.greatest(n, F.lit(1))
    p = F.floor((n - a) / (3 + F.col("g") % 8)) + 1
    changed = (F.col("h") % 10 == 0) & (n > 0)
    period = F.slice("words", (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    text = F.array_join(F.concat(F.slice("words", F.lit(1), a.cast("int")), tail), " ")
    return rows.select("doc_id", F.when(changed, text).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns of detected runs."""
    runs: Column = F.col("runs")
    # The greatest exact length / period: cross products of whole numbers; of ties the first, as runs are in order.
    best = F.aggregate(
        F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, F.lit(0)),
        lambda acc, r: F.when(r["length"] * acc["period"] > acc["length"] * r["period"], r).otherwise(acc),
    )
    lines = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    rows = found.select("doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select(
        "doc_id", "n_runs", *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("best.length * 1000 DIV best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
