"""Personal data: exact base patterns, and a skip-chain CRF that adds what they imply.

Base spans come from four patterns. The CRF then labels the tokens of a
document that carry a digit or an ``@``: chain edges join consecutive such
tokens, skip edges join distant tokens that are equal or similar (the same
digits, or the same text but for case and marks), and loopy message passing
lets evidence at one place reach the others. A token that the CRF labels with
a kind although no base span covers it becomes an added span of that kind, so a
number whose neighbours spoil its pattern is still found.

Weights are learned by pseudo-likelihood ascent on a bounded sample of
documents that have base spans (``MOST_DOCUMENTS``, those of the least hash);
the labels are the base spans.

How it scales: one pass over the documents without shuffle; a document's graph
has only its candidate tokens, and the equal or similar ones are joined in
order of position, each to the next, so edges grow with tokens.

Cases: null and empty texts have no spans; null doc_ids and repeated rows are
handled row by row; without any base span in the corpus no span is added; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LOCAL = string.ascii_letters + string.digits + "._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match takes whole runs of digits, so none begins inside one; said here, a long run is read once.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HOLDS_CANDIDATE = re.compile(r"[0-9@]")
CANDIDATE = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")  # a whole word
MOST_DOCUMENTS = 4_000
ROUNDS = 400  # most rounds of message passing; a document ends its own as soon as its messages stand still
STILL = 1e-4
STEPS = 200
SURE = 0.5  # least belief of an added span
NOT_DIGIT = re.compile(r"[^0-9]+")
NUMBER = re.compile(r"[+(]*[0-9][0-9()-]*")
MARKS = ".,;:!?[]{}<>\"'*#$%&|="
MARKS_LEFT, MARKS_RIGHT = MARKS + ")", MARKS + "(+-"

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """The addresses, each sought around its ``@``: the local part is all that leads up to it since the last match."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        free = domain.end() if domain else at + 1
        if domain:
            yield 0, start, free
        at = text.find("@", free)


def is_octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) in code points, by start, then kind; in time linear in the text."""
    out: list[Span] = list(emails(text))
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(is_octet, m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], s[0], s[2]))


def nodes(text: str, spans: list[Span]) -> list[tuple[int, int, int]]:
    """(start, end, label) in order: each base span, and each other candidate; numbers in a row are one."""
    out: list[tuple[int, int, int]] = []
    at, joined = 0, False
    for m in CANDIDATE.finditer(text):
        while at < len(spans) and spans[at][2] <= m.start():
            at += 1
        inside = at
        while inside < len(spans) and spans[inside][1] < m.end():
            kind, start, end = spans[inside]
            if not out or out[-1][1] <= start:
                out.append((start, end, kind + 1))
                joined = False
            inside += 1
        if inside > at:
            continue
        token = m[0]
        start = m.start() + len(token) - len(token.lstrip(MARKS_LEFT))
        end = max(start, m.start() + len(token.rstrip(MARKS_RIGHT)))
        number = NUMBER.fullmatch(text, start, end) is not None
        if joined and number and start - out[-1][1] == 1:
            out[-1] = (out[-1][0], end, 0)
        else:
            out.append((start, end, 0))
        joined = number
    return out


# Node features. None of them says whether a base pattern matched.
def node_features(token: str, before: str, after: str) -> list[int]:
    digits = NOT_DIGIT.sub("", token)
    n = len(digits)
    return [
        0, 1 + min(n, 20), 22 + min(token.count("."), 4), 27 + ("@" in token), 29 + token.startswith("+"),
        31 + any(c.isalpha() for c in token), 33 + ("-" in token), 35 + ("(" in token), 37 + (" " in token),
        39 + before.isalnum() + 2 * after.isalnum(), 43 + (n >= 14 and luhn(digits)),
    ]


N_FEATURES = 45
N_LABELS = 1 + len(KINDS)


class Graph:
    """Candidate tokens of some documents: nodes, their labels by base spans, and edges (chain 0, skip 1)."""

    def __init__(self) -> None:
        self.row: list[int] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.label: list[int] = []
        self.features: list[list[int]] = []
        self.edges: list[tuple[int, int, int]] = []

    def add(self, row: int, text: str, spans: list[Span]) -> None:
        first, seen = len(self.row), {}
        places = nodes(text, spans)
        for i, (start, end, label) in enumerate(places):
            node, token = first + i, text[start:end]
            self.row.append(row)
            self.start.append(start)
            self.end.append(end)
            self.label.append(label)
            self.features.append(node_features(token, text[max(0, start - 1) : start], text[end : end + 1]))
            if i and start - places[i - 1][1] <= 2:
                self.edges.append((node - 1, node, 0))
            for key in similar(token):
                if key in seen:
                    self.edges.append((seen[key], node, 1))
                seen[key] = node

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        features = np.array(self.features, np.int64) if self.row else np.zeros((0, 1), np.int64)
        edges = np.array(self.edges, np.int64).reshape(-1, 3)
        return features, edges, np.array(self.label, np.int64)


def similar(token: str) -> set[str]:
    """Keys that tokens standing for the same thing share: the text but for case, or the last ten digits of a number."""
    digits = NOT_DIGIT.sub("", token)
    return {token.lower()} | ({f"#{digits[-10:]}"} if len(digits) >= 10 else set())


def unary(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return weights[features].sum(axis=1) if len(features) else np.zeros((0, N_LABELS))


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis=axis, keepdims=True)
    return np.squeeze(most, axis) + np.log(np.exp(x - most).sum(axis=axis))


def beliefs(node: np.ndarray, edges: np.ndarray, pair: np.ndarray, row: np.ndarray | None = None) -> np.ndarray:
    """Marginals by damped loopy sum-product message passing over all graphs at once.

    ``row`` tells the nodes' documents apart: each goes on until its own
    messages stand still, whatever its neighbours in the slice do.
    """
    n, e = len(node), len(edges)
    if not n:
        return node
    row = np.zeros(n, np.int64) if row is None else np.unique(row, return_inverse=True)[1]
    source = np.concatenate([edges[:, 0], edges[:, 1]])
    target = np.concatenate([edges[:, 1], edges[:, 0]])
    potential = np.concatenate([pair[edges[:, 2]], pair[edges[:, 2]].transpose(0, 2, 1)]) if e else np.zeros((0, N_LABELS, N_LABELS))
    back = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
    message = np.zeros((2 * e, N_LABELS))
    moving = np.arange(2 * e)
    for _ in range(ROUNDS):
        if not len(moving):
            break
        total = node.copy()
        np.add.at(total, target[moving], message[moving])
        new = log_sum(potential[moving] + (total[source[moving]] - message[back[moving]])[:, :, None], 1)
        new -= log_sum(new, 1)[:, None]
        change = np.zeros(row.max() + 1)
        np.maximum.at(change, row[source[moving]], np.abs(new - message[moving]).max(axis=1))
        message[moving] = 0.5 * message[moving] + 0.5 * new
        moving = moving[change[row[source[moving]]] >= STILL]
    total = node.copy()
    np.add.at(total, target, message)
    return np.exp(total - log_sum(total, 1)[:, None])


def train(graph: Graph) -> tuple[np.ndarray, np.ndarray]:
    """(node weights, edge potentials by type): pseudo-likelihood ascent with a quadratic penalty."""
    features, edges, label = graph.arrays()
    weights, pair = np.zeros((N_FEATURES, N_LABELS)), np.zeros((2, N_LABELS, N_LABELS))
    if not len(label) or not label.any():
        weights[0, 0] = 30.0
        return weights, pair
    squares = [np.zeros_like(weights), np.zeros_like(pair)]
    given = np.eye(N_LABELS)[label]
    for _ in range(STEPS):
        score = unary(features, weights)
        for a, b, t in ((edges[:, 0], edges[:, 1], False), (edges[:, 1], edges[:, 0], True)):
            table = pair.transpose(0, 2, 1) if t else pair
            # Of node a, given the label of its neighbour b.
            np.add.at(score, a, table[edges[:, 2], :, label[b]])
        off = given - np.exp(score - log_sum(score, 1)[:, None])
        step_w, step_p = -1e-3 * weights, -1e-3 * pair
        for column in features.T:
            np.add.at(step_w, column, off / len(label))
        if len(edges):
            np.add.at(step_p, (edges[:, 2], slice(None), label[edges[:, 1]]), off[edges[:, 0]] / len(label))
            np.add.at(step_p, (edges[:, 2], label[edges[:, 0]], slice(None)), off[edges[:, 1]] / len(label))
        for value, step, square in ((weights, step_w, squares[0]), (pair, step_p, squares[1])):
            square += step**2
            value += 0.3 * step / (np.sqrt(square) + 1e-8)
    return weights, pair


def sample(docs: DataFrame) -> list[str]:
    """Whole texts to learn from: those of the least hash among texts that may hold a base span."""
    may = docs.where(F.col("text").rlike("[0-9]{3}|@")).select("text", F.xxhash64("text").alias("h"))
    narrow = may.select("h").distinct().orderBy("h").limit(MOST_DOCUMENTS)
    bound = narrow.agg(F.max("h")).first()[0]
    if bound is None:
        return []
    texts = may.where(F.col("h") <= bound).dropDuplicates(["h"]).select(F.col("text"))
    return sorted(texts.toArrow().column("text").to_pylist())


def fit(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    graph = Graph()
    for i, text in enumerate(sample(docs)):
        graph.add(i, text, base_spans(text))
    return train(graph)


def find(texts: list[str | None], weights: np.ndarray, pair: np.ndarray) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    graph, out = Graph(), []
    for i, text in enumerate(texts):
        base = base_spans(text) if text else []
        out.append((base, list(base)))
        if text and HOLDS_CANDIDATE.search(text):
            graph.add(i, text, base)
    if graph.row:
        features, edges, label = graph.arrays()
        # A base span is evidence that no other label can outweigh.
        node = unary(features, weights)
        known = np.flatnonzero(label)
        node[known, label[known]] += 30.0
        belief = beliefs(node, edges, pair, np.array(graph.row, np.int64))
        for i in np.flatnonzero((label == 0) & (belief[:, 1:].max(axis=1) >= SURE)).tolist():
            if graph.end[i] > graph.start[i]:
                out[graph.row[i]][1].append((int(belief[i, 1:].argmax()), graph.start[i], graph.end[i]))
    return [(base, sorted(set(every), key=lambda s: (s[1], s[0], s[2]))) for base, every in out]


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, base and spans (both as ``kind:start:end`` in order), and the base counts."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, pair = sent.value
        for batch in batches:
            found = [f for at in range(0, batch.num_rows, 512) for f in find(batch.column("text").slice(at, 512).to_pylist(), weights, pair)]
            counts = [pa.array([sum(k == kind for k, _, _ in base) for base, _ in found], pa.int64()) for kind in range(len(KINDS))]
            spans = [pa.array([written(f[i]) for f in found], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, *spans], ["doc_id", *[f"n_{k}" for k in KINDS], "base", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(scan, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string")
