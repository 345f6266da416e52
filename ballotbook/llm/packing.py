"""Mixture-controlled packing of documents into fixed-length token sequences.

Each source is a queue of its documents' tokens. Windows of ``window`` tokens (a whole number of
sequences) are served by deficit round-robin: in every window queue s earns window * share(s) tokens of
credit, is served whole tokens, and its deficit, credit less service, goes on to the next window. Service
after w windows is the largest-remainder apportionment of the credit, so every deficit stays
between -1 and 1 and is known for any w without running the windows before it: partitions of documents
work on their own, and deficits carry across windows and partitions alike. Target ``shares`` may be given by
source; the others divide what is left by their tokens. Where a queue ends, the shares of the others grow in
proportion from there on, so that every document is packed. Without targets the shares are the corpus' own, with
which all queues end together in the last window. Sources without a target that earn under two tokens a window
share one queue, at every size: tokens are whole, and no more than window / 2 + 1 queues can each be given some in
every window. The pieces still name their own source.

All sequences but the last are full; only the last is shorter. Inside a window a queue's tokens lie
together, so few documents are cut.

Null text is empty: the document is its end token alone. Null sources are one source. Repeated rows are
packed each. A null doc_id is kept as it is. An empty table gives no rows. Of further columns none is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, source string"
)
TOKENS = "doc_id long, source string, doc_tokens long, ids binary, part int, before long"


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """One row per document: ids (little-endian 32 bit) with the end id, and the tokens of its source
    that the same partition has before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import defaultdict

        from pyspark import TaskContext

        from .tokens import encoding

        enc, part, before = encoding(tokenizer_path), TaskContext.get().partitionId(), defaultdict(int)
        special = enc.special_tokens_set
        for batch in batches:
            ids, counts, starts = [], [], []
            sources = batch.column(2).to_pylist()
            for text, source in zip(batch.column(1).to_pylist(), sources):
                own = enc.encode(text or "", allowed_special=special)
                own.append(end_id)
                ids.append(np.array(own, dtype="<u4").tobytes())
                counts.append(len(own))
                starts.append(before[source])
                before[source] += len(own)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    batch.column(2),
                    pa.array(counts, pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array([part] * len(ids), pa.int32()),
                    pa.array(starts, pa.int64()),
                ],
                names=["doc_id", "source", "doc_tokens", "ids", "part", "before"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
    )
    return rows.mapInArrow(run, TOKENS)


class Service:
    """Tokens served to each queue after any number of tokens in all, by largest remainders in whole numbers.

    A phase lasts until a queue ends; from then on the others divide the windows by their weights. Queues of
    weight 0 are served by their tokens when no other is left.
    """

    def __init__(self, totals: list[int], weights: list[int]):
        self.phases, at, base = [], 0, [0] * len(totals)
        active = [s for s, n in enumerate(totals) if n]
        while active:
            own = weights if any(weights[s] for s in active) else totals
            share = {s: own[s] for s in active if own[s]}
            whole = sum(share.values())
            length = min((totals[s] - base[s]) * whole // w for s, w in share.items())
            self.phases.append((at, base, share, whole))
            base = self._in_phase(self.phases[-1], at + length)
            at += length
            active = [s for s in active if base[s] < totals[s]]
        self.total = at

    @staticmethod
    def _in_phase(phase, tokens: int) -> list[int]:
        at, base, share, whole = phase
        out, rest = list(base), []
        for s, w in share.items():
            more, left = divmod((tokens - at) * w, whole)
            out[s] += more
            rest.append((-left, s))
        for _, s in sorted(rest)[: tokens - at - sum(out) + sum(base)]:
            out[s] += 1
        return out

    def after(self, tokens: int) -> list[int]:
        tokens = min(tokens, self.total)
        phase = next((p for p in reversed(self.phases) if p[0] <= tokens), None)
        return self._in_phase(phase, tokens) if phase else []


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    sequence: int = 1024,
    window: int = 65536,
    end_id: int = 0,
    shares: dict[str, float] | None = None,
) -> DataFrame:
    """Pack every document; one row per piece of a document in a sequence.

    ``shares`` are the target proportions of tokens by source, of 1 in all; a null source is ``""``.
    """
    shares = shares or {}
    if window % sequence:
        raise ValueError("window must be a whole number of sequences")
    if any(x < 0 or 0 < x * window < 2 for x in shares.values()) or sum(shares.values()) > 1 + 1e-9:
        raise ValueError("shares must be 0 or earn two tokens a window, and 1 in all at most")
    spark = docs.sparkSession
    ws = Workspace(spark, "packing")
    tokens = ws.keep(tokenize(docs, tokenizer_path, end_id), "tokens")
    sums = ws.keep(
        tokens.groupBy("source", "part").agg(F.sum("doc_tokens").alias("n")), "sums"
    )
    by_source = sums.groupBy("source").agg(F.sum("n").alias("n"))
    named = {r["source"]: int(r["n"]) for r in by_source.filter(F.col("source").isin(*shares)).collect()} if shares else {}
    total = int(sums.agg(F.sum("n")).first()[0] or 0)
    free, left = total - sum(named.values()), max(0.0, 1 - sum(shares.get(s, 0) for s in named))
    # At most window / 2 other sources earn two tokens a window or more; all the rest share a queue.
    others = by_source.filter(~F.col("source").isin(*named)) if named else by_source
    large = sorted(
        (r["source"], int(r["n"]))
        for r in others.filter(F.col("n") * F.lit(left * window) >= F.lit(2.0 * free)).collect()
    )
    rest = free - sum(n for _, n in large)
    if rest and rest * left * window < 2 * free and large:  # the shared queue is itself too small: the smallest joins it
        small = min(large, key=lambda x: (x[1], x[0]))
        large.remove(small)
        rest += small[1]
    parts = 10**9  # weights are whole billionths
    totals = [*named.values(), *[n for _, n in large], rest]
    weights = [round(shares[s] * parts) * max(1, free) for s in named] + [
        round(left * parts) * n for n in [*[n for _, n in large], rest]
    ] if named else totals
    large, shared = [(s, n) for s, n in named.items()] + large, len(totals) - 1
    served_after = Service(totals, weights)
    queues = spark.createDataFrame([(s, k) for k, (s, _) in enumerate(large)], "source string, queue int")
    order = Window.partitionBy("queue").orderBy("source", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ws.keep(
        sums.join(F.broadcast(queues), "source", "left")  # at most window / 2 rows
        .withColumn("queue", F.coalesce("queue", F.lit(shared)))
        .withColumn("base", F.coalesce(F.sum("n").over(order), F.lit(0)).cast("long"))
        .select("source", "part", "queue", "base"),
        "starts",
    )
    if starts.count() <= 1_000_000:  # one row per source and partition; below 64 MB
        starts = F.broadcast(starts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        done: dict[int, np.ndarray] = {}

        def served(w: int) -> np.ndarray:
            if w not in done:
                if len(done) > 65536:
                    done.clear()
                done[w] = np.array(served_after.after(w * window), dtype=np.int64)
            return done[w]

        for batch in batches:
            rows = []
            names = ["doc_id", "source", "doc_tokens", "ids", "queue", "at"]
            for doc, source, n, ids, queue, at in zip(*[batch.column(c).to_pylist() for c in names]):
                begin = at
                w, high = 0, -(-total // window)
                while w + 1 < high:  # the last window before which no more than ``at`` tokens are served
                    middle = (w + high) // 2
                    w, high = (middle, high) if served(middle)[queue] <= at else (w, middle)
                raw = memoryview(ids)
                while at < begin + n:
                    while served(w + 1)[queue] <= at:
                        w += 1
                    low, high = served(w), served(w + 1)
                    end = min(begin + n, int(high[queue]))
                    place = w * window + int((high[:queue] - low[:queue]).sum()) + at - int(low[queue])
                    while at < end:
                        size = min(end - at, sequence - place % sequence)
                        own = raw[4 * (at - begin) : 4 * (at - begin + size)]
                        rows.append(
                            (doc, at - begin, size, zlib.crc32(own), n, place // sequence, place % sequence, source)
                        )
                        at += size
                        place += size
                    if len(rows) >= 20000:
                        yield _pieces(rows)
                        rows = []
            if rows:
                yield _pieces(rows)

    return (
        tokens.join(starts, ["source", "part"])
        .select("doc_id", "source", "doc_tokens", "ids", "queue", (F.col("base") + F.col("before")).alias("at"))
        .mapInArrow(cut, PIECES)
    )


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in PIECES.split(", ")]
    types = [pa.string() if c.endswith("string") else pa.int64() for c in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)
