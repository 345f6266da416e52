"""Minimax contiguous partition of documents into shards [native].

Rows are put in the order of (digest of the text, doc_id): equal texts form one atomic group, and the
order is the same however the input is split. The smallest shard capacity for which greedy filling
needs at most ``shards`` shards is found by binary search over the group sizes, and the order is cut
there. The search runs on block sums (at most ``max_blocks`` of them, and two more for each group that has
over 1 / ``LARGE`` of all bytes, which is a block of its own). A cut of the true search lies between two
bounds: that of the smallest capacity that can do if blocks may be cut anywhere, taken at the starts of the
blocks it falls in, and that of the smallest capacity that surely does. Only blocks between the bounds of a
cut are opened into finer ones, until none is left. The result is that of the search over single groups.

Null and empty texts: size 1 (no bytes plus the separator), one group. Very long texts are one group each and
are read once. Ties: rows of one text lie by doc_id, repeated rows are each placed. A null doc_id is placed like
any other value, first in its group. An empty table gives an empty result. Of further columns none is read,
whatever their names.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

_INDEX = (1 << 33) - 1
#: Groups of over this share of all bytes, of which there are fewer than so many, are known one by one.
LARGE = 4096


@dataclass(frozen=True)
class Item:
    """Consecutive groups: a block (``whole`` false) or one group."""

    last: int
    size: int
    rows: int
    whole: bool


class Order:
    """The items in order, with the bytes before each."""

    def __init__(self, items: list[Item]):
        self.items = items
        self.starts = [0]
        for item in items:
            self.starts.append(self.starts[-1] + item.size)
        self.total = self.starts[-1]

    def cut(self, start: int, capacity: int, late: bool) -> int:
        """Where a shard that begins at ``start`` ends, at the latest or at the earliest."""
        full = start + capacity
        if full >= self.total:
            return self.total
        k = bisect.bisect_right(self.starts, full) - 1
        if late and not self.items[k].whole:
            return full
        return max(start, self.starts[k])

    def cuts(self, capacity: int, shards: int, late: bool) -> list[int]:
        """The ends of ``shards`` shards; the last is the total if the capacity does."""
        out = [0]
        for _ in range(shards):
            out.append(self.cut(out[-1], capacity, late))
        return out[1:]

    def smallest(self, shards: int, floor: int, late: bool) -> int:
        """Binary search for the smallest capacity that does."""
        low, high = max(floor, -(-self.total // shards)), max(self.total, floor)
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, shards, late)[-1] == self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def uncertain(self, shards: int, floor: int) -> list[tuple[int, int]]:
        """Ranges of items, [from, to), that hold a block in which a cut may fall; at most one for each cut."""
        first = self.cuts(self.smallest(shards, floor, True), shards, False)
        last = self.cuts(self.smallest(shards, floor, False), shards, True)
        ranges: list[list[int]] = []
        for a, b in zip(first[:-1], last[:-1]):
            low = bisect.bisect_right(self.starts, a) - 1
            high = bisect.bisect_left(self.starts, b)
            open_ = [k for k in range(low, min(high, len(self.items))) if not self.items[k].whole]
            if not open_:
                continue
            if ranges and open_[0] <= ranges[-1][1]:
                ranges[-1][1] = max(ranges[-1][1], open_[-1] + 1)
            else:
                ranges.append([open_[0], open_[-1] + 1])
        return [(a, b) for a, b in ranges]


def shard_documents(
    docs: DataFrame,
    shards: int = 16,
    max_blocks: int = 1 << 14,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Place every row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``shards`` cuts give shards 0 to ``shards`` - 1; small inputs leave the last ones empty.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = text.cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.unhex(F.sha2(raw, 256)).alias("digest"),
    )
    # The digest is uniform, so ranges of (digest, doc_id) are even; one digest with many rows is split.
    placed = (
        ws.keep(rows, "rows")
        .repartitionByRange(F.col("digest"), F.col("doc_id"))
        .sortWithinPartitions("digest", "doc_id")
        .withColumn("at", F.monotonically_increasing_id())
    )
    placed = ws.keep(placed, "placed")
    groups = ws.keep(
        placed.groupBy("digest").agg(
            F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"), F.max("at").alias("last")
        ),
        "groups",
    ).drop("digest")
    sums = groups.agg(F.max("size").alias("floor"), F.sum("size").alias("total")).first()
    floor, total = sums["floor"] or 1, sums["total"] or 0
    large: dict[int, list[int]] = {}
    for r in groups.filter(F.col("size") > total // LARGE).select("last").collect():  # fewer than LARGE rows
        large.setdefault(r["last"] >> 33, []).append(r["last"])
    large_of = spark.createDataFrame([(p, sorted(x)) for p, x in large.items()], "part long, large array<long>")
    # Twice the large groups before a group in its part, and one more for a large group itself.
    near = F.coalesce("large", F.array().cast("array<long>"))
    zone = F.size(F.filter(near, lambda x: x < F.col("last"))) + F.size(F.filter(near, lambda x: x <= F.col("last")))
    groups = groups.withColumn("part", F.shiftright("last", 33)).join(
        F.broadcast(large_of), "part", "left"  # fewer than LARGE numbers in all
    ).select("last", "size", "rows", "part", zone.alias("zone"))

    part = F.shiftright("at", 33)
    per_part = sorted(
        (r["part"], r["n"])
        for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    )  # one row for each partition of the range exchange
    before, total_rows = {}, 0
    for p, n in per_part:
        before[p] = total_rows
        total_rows += n

    def blocks_of(frame: DataFrame, width: int) -> list[Item]:
        block = F.struct("part", "zone", F.floor(F.col("last").bitwiseAND(_INDEX) / width))
        found = (
            frame.groupBy(block.alias("b"))
            .agg(
                F.max("last").alias("last"),
                F.sum("size").alias("size"),
                F.sum("rows").alias("rows"),
                F.count(F.lit(1)).alias("groups"),
            )
            .collect()
        )  # at most max_blocks rows and two for each large group
        return sorted((Item(r["last"], r["size"], r["rows"], r["groups"] == 1) for r in found), key=lambda i: i.last)

    width = max(1, -(-total_rows // max_blocks))
    order = Order(blocks_of(groups, width))
    while ranges := order.uncertain(shards, floor):
        items = order.items
        inside, n_inside, kept = F.lit(False), 0, []
        for k, (a, b) in enumerate(ranges):  # at most one for each shard
            low = items[a - 1].last if a else -1
            inside = inside | ((F.col("last") > low) & (F.col("last") <= items[b - 1].last))
            n_inside += sum(i.rows for i in items[a:b])
            kept += items[ranges[k - 1][1] if k else 0 : a]
        kept += items[ranges[-1][1] :]
        width = max(1, min(width // 2, -(-n_inside // max_blocks)))
        order = Order(sorted(kept + blocks_of(groups.filter(inside), width), key=lambda i: i.last))

    cuts, firsts = [], [0]
    ends = order.cuts(order.smallest(shards, floor, False), shards, False) if order.items else []
    done = 0
    for k, item in enumerate(order.items):
        done += item.rows
        if order.starts[k + 1] in ends and order.starts[k + 1] < order.total:
            cuts.append(item.last)
            firsts.append(done)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("at") > F.lit(cut)).cast("int")
    offsets = spark.createDataFrame([(p, b) for p, b in before.items()], "part long, before long")
    first = F.element_at(F.array(*[F.lit(f).cast("long") for f in firsts]), F.col("shard") + 1)
    return (
        placed.withColumn("part", part)
        .join(F.broadcast(offsets), "part")  # one row for each partition of the range exchange
        .withColumn("shard", shard.cast("int"))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("before") + F.col("at").bitwiseAND(_INDEX) - first).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
