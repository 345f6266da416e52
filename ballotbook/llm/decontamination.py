"""Benchmark decontamination by a prefix-filtered join and exact check of item-sized windows.

Each benchmark item is cut into windows of ``window`` consecutive words (an item of fewer words, but not
none, is one window). A window's tokens are its runs of ``shingle`` words. All documents' tokens are counted
for the tokens that the benchmark has, and each window's tokens are put in order of rarity. A window occurs
only where all its tokens do, so the prefix that must be joined is one token: the rarest; a window with a
token of count zero occurs nowhere. Documents join their tokens to those prefixes. The token's place in the
window gives the place of the window in the document, which must lie within the document (positional and
length bounds), and there the words are compared one by one.

The benchmark is read in blocks of at most ``block_words`` words, so a task holds one block's index
whatever the size of the benchmark; documents pass once for counting and once for matching per block.

Null texts have no words; items without id take no part; items that repeat an id are one item. Empty
tables give zero hits or no rows. Repeated documents each have their row; null doc_ids stay null. Of further
columns none is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .workspace import Workspace

_BITS = 20


class Tokens:
    """Sorted token hashes with a bit table in front."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.table = np.zeros(1 << _BITS, bool)
        self.table[hashes & np.uint64((1 << _BITS) - 1)] = True

    def find(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``runs``, indices of the tokens there)."""
        at = np.flatnonzero(self.table[runs & np.uint64((1 << _BITS) - 1)])
        where = np.minimum(np.searchsorted(self.hashes, runs[at]), max(0, len(self.hashes) - 1))
        hit = self.hashes[where] == runs[at] if len(self.hashes) else np.zeros(len(at), bool)
        return at[hit], where[hit]


class Windows:
    """The distinct windows of one length of a block of items, and the items of each."""

    def __init__(self, items: list[tuple[int, np.ndarray]], length: int, shingle: int):
        self.length, self.shingle = length, min(shingle, length)
        found: dict[bytes, set[int]] = {}
        for item, own in items:
            for k in range(len(own) - length + 1):
                found.setdefault(own[k : k + length].tobytes(), set()).add(item)
        self.words = np.frombuffer(b"".join(found), np.uint64).reshape(-1, length)
        self.items = [sorted(x) for x in found.values()]
        runs = np.stack(
            [W.sequences(row, self.shingle) for row in self.words]
        ) if len(self.words) else np.zeros((0, 1), np.uint64)
        self.runs = runs
        self.tokens = Tokens(np.unique(runs))

    def set_prefixes(self, counts: np.ndarray) -> None:
        """Keep for each window the place of its rarest token; drop windows that cannot occur."""
        index = np.searchsorted(self.tokens.hashes, self.runs)
        of = counts[index]
        place = of.argmin(axis=1)
        some = np.flatnonzero(of.min(axis=1) > 0) if len(of) else np.zeros(0, np.int64)
        self.words, self.items = self.words[some], [self.items[k] for k in some]
        self.place = place[some]
        chosen = self.runs[some, self.place]
        order = np.argsort(chosen, kind="stable")
        self.order, self.prefix = order, chosen[order]
        self.tokens = Tokens(np.unique(chosen))
        self.first = np.searchsorted(self.prefix, self.tokens.hashes)
        self.number = np.searchsorted(self.prefix, self.tokens.hashes, side="right") - self.first
        self.runs = None

    def occurrences(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start word, window) of every occurrence in a chunk's words."""
        if not len(self.prefix):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, token = self.tokens.find(W.sequences(hashes, self.shingle))
        n = self.number[token]
        at = np.repeat(at, n)
        within = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        window = self.order[np.repeat(self.first[token], n) + within]
        start = at - self.place[window]
        edges = np.concatenate([[0], np.cumsum(counts)])
        row = np.searchsorted(edges, at, side="right") - 1
        fits = (start >= edges[row]) & (start + self.length <= edges[row + 1])
        start, window = start[fits], window[fits]
        same = np.ones(len(start), bool)
        for k in range(self.length):
            same &= hashes[np.where(same, start + k, 0)] == self.words[window, k]
        return start[same], window[same]


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Items as word hashes, about ``block_words`` words at a time; one block is on the driver at a time."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (4 * block_words)))
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        if not part:
            continue
        data, offsets = W.text_bytes(pa.array([r["text"] for r in part], pa.string()))
        _, _, hashes, counts = W.split_words(data, offsets, W.ALNUM)
        edges = np.concatenate([[0], np.cumsum(counts)])
        yield [(r["item_id"], hashes[edges[k] : edges[k + 1]]) for k, r in enumerate(part)]


def _count_tokens(docs: DataFrame, tables) -> DataFrame:
    """Occurrences in all documents of each token of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {n: np.zeros(len(t.hashes), np.int64) for n, t in tables.value.items()}
        for batch in batches:
            for _, _, data, offsets in W.chunks(batch.column(0)):
                _, _, hashes, words = W.split_words(data, offsets, W.ALNUM)
                for n, t in tables.value.items():
                    runs = W.sequences(hashes, n)
                    at, token = t.find(runs)
                    ok = W.inside(words, n, len(runs))[at]
                    counts[n] += np.bincount(token[ok], minlength=len(t.hashes))
        for n, c in counts.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array([n] * len(some), pa.int32()), pa.array(some, pa.int64()), pa.array(c[some], pa.int64())],
                names=["n", "token", "c"],
            )

    found = docs.select("text").mapInArrow(run, "n int, token long, c long")
    return found.groupBy("n", "token").agg(F.sum("c").alias("c"))


def _match(docs: DataFrame, windows) -> DataFrame:
    """Adds to each document's spans (word from, to) and items those of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in W.chunks(batch.column(1)):
                _, _, hashes, counts = W.split_words(data, offsets, W.ALNUM)
                edges = np.concatenate([[0], np.cumsum(counts)])
                spans = [[list(s) for s in _pairs(x)] for x in batch.column(2)[first:end].to_pylist()]
                items = [set(x) for x in batch.column(3)[first:end].to_pylist()]
                for w in windows.value:
                    start, window = w.occurrences(hashes, counts)
                    row = np.searchsorted(edges, start, side="right") - 1
                    for s, k, r in zip((start - edges[row]).tolist(), window.tolist(), row.tolist()):
                        spans[r].append([s, s + w.length])
                        items[r].update(w.items[k])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[first:end],
                        batch.column(1)[first:end],
                        pa.array([np.array(_merged(s), "<i8").tobytes() for s in spans], pa.binary()),
                        pa.array([sorted(s) for s in items], pa.list_(pa.int64())),
                        pa.array(counts, pa.int64()),
                    ],
                    names=["doc_id", "text", "spans", "items", "n_words"],
                )

    return docs.mapInArrow(run, "doc_id long, text string, spans binary, items array<long>, n_words long")


def _pairs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8").reshape(-1, 2)


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    ).filter(F.col("item_id").isNotNull())


def _prepared(docs: DataFrame, items: DataFrame, window: int, shingle: int, block_words: int) -> Iterator[list[Windows]]:
    """The windows of each block with their rarest tokens, by counts over all documents."""
    for block in _blocks(items, block_words):
        by_length: dict[int, list] = {}
        for item, own in block:
            if len(own):
                by_length.setdefault(min(window, len(own)), []).append((item, own))
        windows = [Windows(own, n, shingle) for n, own in sorted(by_length.items())]
        tables: dict[int, np.ndarray] = {}
        for w in windows:
            tables[w.shingle] = np.union1d(tables.get(w.shingle, w.tokens.hashes), w.tokens.hashes)
        if not tables:
            continue
        shared = {n: Tokens(h) for n, h in tables.items()}
        counts = {n: np.zeros(len(h), np.int64) for n, h in tables.items()}
        # At most one row for each token of the block.
        for r in _count_tokens(docs, docs.sparkSession.sparkContext.broadcast(shared)).collect():
            counts[r["n"]][r["token"]] = r["c"]
        for w in windows:
            w.set_prefixes(counts[w.shingle][np.searchsorted(tables[w.shingle], w.tokens.hashes)])
        yield windows


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, block_words: int = 1 << 19
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    ``spans`` are the hit word ranges, [from, to) pairs of little-endian 64-bit integers.
    """
    spark: SparkSession = docs.sparkSession
    ws = Workspace(spark, "decontamination")
    items = ws.keep(_items(benchmark), "items")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )
    found = rows.withColumn("spans", F.lit(b"")).withColumn("items", F.array().cast("array<long>"))
    passes = 0
    for windows in _prepared(rows, items, window, shingle, block_words):
        if passes:
            found = ws.keep(found.drop("n_words"), "found")
        found = _match(found, spark.sparkContext.broadcast(windows))
        passes += 1
    if not passes:
        found = _match(found, spark.sparkContext.broadcast([]))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [int((p[:, 1] - p[:, 0]).sum()) for p in map(_pairs, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(hit, pa.int64())], names=[*batch.schema.names, "n_hit"]
            )

    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return (
        found.select("doc_id", "n_words", "spans", "items")
        .mapInArrow(totals, "doc_id long, n_words long, spans binary, items array<long>, n_hit long")
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
            "spans",
        )
    )


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, block_words: int = 1 << 19
) -> DataFrame:
    """The documents in which no benchmark window occurs, all columns, in one pass per block without a join."""
    ws = Workspace(docs.sparkSession, "decontaminate")
    items = ws.keep(_items(benchmark), "items")
    names, at = docs.columns, docs.columns.index("text")
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    out = docs
    for windows in _prepared(docs, items, window, shingle, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(windows)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for first, _, data, offsets in W.chunks(batch.column(at)):
                    _, _, hashes, counts = W.split_words(data, offsets, W.ALNUM)
                    edges = np.concatenate([[0], np.cumsum(counts)])
                    for w in sent.value:
                        start, _ = w.occurrences(hashes, counts)
                        clean[first + np.searchsorted(edges, start, side="right") - 1] = False
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(clean)) for c in batch.columns], names=names)

        out = out.mapInArrow(run, schema)
    return out
