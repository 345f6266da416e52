"""Near-duplicate documents by an LSH forest over MinHash signatures.

Documents with equal shingle sets are one class at once. Each class's signature is put in several orders
(trees); in each order the classes are sorted by their signature's label, and neighbours with a common
prefix of at least ``least_depth`` values are candidates. Depth adapts to the region: each class is compared with
its ``WINDOW`` neighbours on either side, which is all of a sparse region, and in a dense one those of the longest
common prefix. Sorting by (tree, label, id) splits a region of any size evenly over tasks. A candidate whose
signature estimate is far below the threshold is left out (about five standard errors), the rest is confirmed
on the full shingle sets of the texts.

Confirmation goes in rounds: each class's best candidate first, then all candidates that still lie in different
components, so members of a large group are not compared with each other again and again. Last, in regions with
more classes than neighbours and several components, the classes outside the largest component are compared with
all others of the region in blocks. Links are made into components by star steps.

Small regions that lie over the border of two tasks' ranges have all their pairs compared, so the ranges do not
matter. Null and empty texts, or texts without words, have no shingles: linked with nothing. Equal sets are linked.
Very long texts are read whole, a mebibyte at a time. Ties between candidates go to the greater id. Rows that share a
doc_id have the component of their own set; in links the smallest text stands for the id.
A null doc_id belongs to its class's component, and is kept only without one. Repeated rows of one doc_id
are each returned. An empty table gives no rows. Of further columns none is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import connected
from .workspace import Workspace

TREES, DEPTH, SKETCH = 12, 8, 96
HASHES = TREES * DEPTH
WINDOW = 16
_seeds = W.mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR = (_seeds[:HASHES] >> np.uint64(32)).astype(np.uint32)
_TIMES = (_seeds[HASHES:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over a set."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for s in range(0, len(low), 4096):
        x = low[s : s + 4096][None, :] ^ _XOR[:, None]
        x *= _TIMES[:, None]
        x ^= x >> np.uint32(15)
        np.minimum(out, (x * np.uint32(0x2C1B3C6D)).min(axis=1), out=out)
    return out


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """Each document's set size, two set hashes and signature (null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in W.chunks(batch.column(1)):
                _, _, hashes, counts = W.split_words(data, offsets, W.SPACED)
                n, one, two, signs = [], [], [], []
                for own in W.shingle_sets(hashes, counts, shingle):
                    n.append(len(own))
                    if len(own):
                        one.append(int(own.sum(dtype=np.uint64).view(np.int64)))
                        two.append(int(W.mix(own ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64).view(np.int64)))
                        signs.append(signature(own).astype(">u4").tobytes())
                    else:
                        one.append(None)
                        two.append(None)
                        signs.append(None)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[first:end],
                        pa.array(n, pa.int64()),
                        pa.array(one, pa.int64()),
                        pa.array(two, pa.int64()),
                        pa.array(signs, pa.binary()),
                    ],
                    names=["doc_id", "n", "one", "two", "signature"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, one long, two long, signature binary")


def _labels(classes: DataFrame) -> DataFrame:
    """One row for each class and tree: the tree's part of the signature, and one byte of each value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(-1, HASHES)
            labels = np.ascontiguousarray(values).tobytes()
            step = 4 * DEPTH
            sketch = [x.tobytes() for x in (values[:, :SKETCH] & 0xFF).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(ids, TREES)),
                    pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(ids))),
                    pa.array([labels[k * step : (k + 1) * step] for k in range(len(ids) * TREES)], pa.binary()),
                    pa.array([x for x in sketch for _ in range(TREES)], pa.binary()),
                ],
                names=["id", "tree", "label", "sketch"],
            )

    return classes.mapInArrow(run, "id long, tree int, label binary, sketch binary")


def _neighbours(forest: DataFrame, least_depth: int, least_match: float) -> DataFrame:
    """Candidate pairs among sorted neighbours: (a, b, match), and, with a match of -1, the regions at the ends of the
    task's range, whose pairs over the border no task sees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, ends = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            regions = batch.column(4).to_numpy(zero_copy_only=False)
            ends = [*ends[:WINDOW], *(ends[WINDOW:] + regions[:WINDOW].tolist() + regions[-WINDOW:].tolist())[-2 * WINDOW :]] if ends else [
                *regions[:WINDOW].tolist(), *regions[-WINDOW:].tolist()
            ]
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            trees = batch.column(1).to_numpy(zero_copy_only=False)
            labels = np.frombuffer(b"".join(batch.column(2).to_pylist()), ">u4").reshape(-1, DEPTH)
            sketches = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, SKETCH)
            if kept is not None:
                ids, trees, labels, sketches = (
                    np.concatenate([k, x]) for k, x in zip(kept, (ids, trees, labels, sketches))
                )
            old = 0 if kept is None else len(kept[0])
            kept = ids[-WINDOW:], trees[-WINDOW:], labels[-WINDOW:], sketches[-WINDOW:]
            found = []
            for gap in range(1, min(WINDOW, len(ids) - 1) + 1):
                at = np.arange(max(gap, old), len(ids))
                if not len(at):
                    continue
                before = at - gap
                near = (trees[at] == trees[before]) & (ids[at] != ids[before])
                near &= (labels[at, :least_depth] == labels[before, :least_depth]).all(axis=1)
                at, before = at[near], before[near]
                match = (sketches[at] == sketches[before]).mean(axis=1)
                ok = match >= least_match
                found.append((at[ok], before[ok], match[ok]))
            if not found:
                continue
            at, before, match = (np.concatenate(x) for x in zip(*found))
            if not len(at):
                continue
            a, b = ids[at], ids[before]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(match)],
                names=["a", "b", "match"],
            )
        some = sorted(set(ends))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(some, pa.int64()), pa.array([-1.0] * len(some))], names=["a", "b", "match"])

    return forest.mapInArrow(run, "a long, b long, match double")


def _confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for c in (2, 3):
                sets = []
                for _, _, data, offsets in W.chunks(batch.column(c)):
                    _, _, hashes, counts = W.split_words(data, offsets, W.SPACED)
                    sets += W.shingle_sets(hashes, counts, shingle)
                sides.append(sets)
            ok = []
            for x, y in zip(*sides):
                small, big = min(len(x), len(y)), max(len(x), len(y))
                if 100 * small < percent * big:
                    ok.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (small + big - common))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _crowd_links(
    members: DataFrame, groups: DataFrame, texts: DataFrame, shingle: int, percent: int, least_depth: int, least_match: float, ws: Workspace
) -> DataFrame:
    """Links between different components inside crowded regions, which sorted neighbours may miss.

    In a region (classes of one tree with a common prefix of ``least_depth`` values) of more than ``WINDOW`` classes
    and several components every class outside the region's largest component is compared with all others of the
    region: in blocks, so that no task holds more than two of them, and each pair in its first common tree only.
    """
    rows = members.join(groups.select(F.col("node").alias("id"), "component"), "id", "left")
    rows = ws.keep(rows.withColumn("component", F.coalesce("component", "id")), "regions")
    each = rows.groupBy("region", "component").agg(F.count(F.lit(1)).alias("n"))
    crowded = each.groupBy("region").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n")
    ).filter((F.col("n") > WINDOW) & (F.col("n") > F.col("n_main")))
    small, large = 512, 2048
    blocks = ws.keep(
        crowded.select(
            "region", "main", F.ceil((F.col("n") - F.col("n_main")) / small).alias("co"), F.ceil(F.col("n_main") / large).alias("cm")
        ),
        "crowded",
    )
    member = rows.join(blocks, "region")
    member = member.withColumn("outside", F.col("component") != F.col("main")).withColumn(
        "own", F.when(F.col("outside"), F.pmod(F.xxhash64("id"), "co")).otherwise(F.pmod(F.xxhash64("id"), "cm"))
    )
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    place = lambda kind, x, y, side: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), side.alias("side"))
    own = F.col("own")
    # Blocks of outsiders meet blocks of the main component (kind 0) and each other (kind 1).
    outsider = F.concat(
        F.transform(upto("cm"), lambda m: place(0, own, m, F.lit(0))),
        F.transform(upto("co"), lambda o: place(1, F.least(own, o), F.greatest(own, o), (own > o).cast("int"))),
    )
    insider = F.transform(upto("co"), lambda o: place(0, o, own, F.lit(1)))
    member = member.withColumn("p", F.explode(F.when(F.col("outside"), outsider).otherwise(insider)))
    member = member.select("region", "p.kind", "p.x", "p.y", "p.side", "id", "component", "tree")
    held = member.join(texts.select(F.col("doc_id").alias("id"), "text", "signature").hint("merge"), "id")
    ordered = held.repartition("region", "kind", "x", "y").sortWithinPartitions("region", "kind", "x", "y").select(
        "region", "kind", "x", "y", "side", "id", "component", "tree", "signature", "text"
    )

    def compare(parts: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        side, ids, comps = (np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts]) for c in (4, 5, 6))
        tree, kind = parts[0].column(7)[0].as_py(), parts[0].column(1)[0].as_py()
        signs = np.frombuffer(b"".join(x for p in parts for x in p.column(8).to_pylist()), ">u4").reshape(-1, HASHES)
        signs = np.ascontiguousarray(signs.astype(np.uint32))
        prefixes = signs.reshape(-1, TREES, DEPTH)[:, :tree, :least_depth]
        sets = []
        for p in parts:
            for _, _, data, offsets in W.chunks(p.column(9)):
                _, _, hashes, counts = W.split_words(data, offsets, W.SPACED)
                sets += W.shingle_sets(hashes, counts, shingle)
        size = np.array([len(x) for x in sets])
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        same_block = kind == 1 and not side.any()
        left = np.arange(len(ids)) if same_block else np.flatnonzero(side == 0)
        right = None if same_block else np.flatnonzero(side == 1)
        links = []
        for a in left:
            other = np.arange(a + 1, len(ids)) if same_block else right
            other = other[comps[other] != comps[a]]
            other = other[(100 * np.minimum(size[other], size[a]) >= percent * np.maximum(size[other], size[a]))]
            other = other[(signs[other] == signs[a]).mean(axis=1) >= least_match]
            if tree:  # pairs of an earlier common tree are compared there
                other = other[~(prefixes[other] == prefixes[a]).all(axis=2).any(axis=1)]
            for b in other:
                x, y = find(int(comps[a])), find(int(comps[b]))
                if x == y:
                    continue
                both = np.concatenate([sets[a], sets[b]])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (size[a] + size[b] - common):
                    parent[x] = y
                    links.append((int(ids[a]), int(ids[b])))
        return links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, parts = None, []

        def out():
            links = compare(parts)
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)])
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for s, e in zip(edges[:-1], edges[1:]):
                key = tuple(keys[s])
                if key != held_key and parts:
                    yield out()
                    parts = []
                held_key = key
                parts.append(batch.slice(s, e - s))
        if parts:
            yield out()

    return ordered.mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, least_depth: int = 3
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    ``percent`` is the least Jaccard similarity of linked sets in hundredths; component_id is the smallest
    doc_id reachable over links.
    """
    ws = Workspace(docs.sparkSession, "minhash")
    sets = ws.keep(_sets(docs, shingle), "sets")
    classes = ws.keep(
        sets.filter("n > 0 and doc_id is not null")
        .groupBy("one", "two", "n")
        .agg(F.min("doc_id").alias("id"), F.min("signature").alias("signature")),
        "classes",
    )
    forest = ws.keep(_labels(classes.select("id", "signature")), "forest")
    region = F.xxhash64("tree", F.substring("label", 1, 4 * least_depth))
    ordered = forest.repartitionByRange("tree", "label", "id").sortWithinPartitions("tree", "label", "id").withColumn("region", region)
    share = percent / 100
    least_match = max(0.1, share - 5 * (share * (1 - share) / SKETCH) ** 0.5)
    near = ws.keep(_neighbours(ordered, least_depth, least_match), "neighbours")
    regions = forest.select("id", "tree", region.alias("region"))
    # Small regions at the ends of ranges, at most 48 for each range, have all their pairs compared.
    at_ends = regions.join(near.filter("match < 0").select(F.col("a").alias("region")).distinct().hint("merge"), "region")
    small = at_ends.groupBy("region").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(2, WINDOW))
    at_ends = ws.keep(at_ends.join(small.select("region").hint("merge"), "region").select("region", "id"), "ends")
    over = at_ends.withColumnRenamed("id", "a").join(at_ends.withColumnRenamed("id", "b").hint("merge"), "region").filter("a < b")
    pairs = ws.keep(
        near.filter("match >= 0").unionByName(over.select("a", "b", F.lit(0.0).alias("match"))).groupBy("a", "b").agg(F.max("match").alias("match")), "pairs"
    )
    crowded = regions.groupBy("region").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > WINDOW)
    members = ws.keep(regions.join(crowded.select("region"), "region", "left_semi"), "members")
    ws.drop(forest)
    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(members.select(F.col("id").alias("doc_id"))).distinct()
    needed = needed.join(classes.select(F.col("id").alias("doc_id"), "signature").hint("merge"), "doc_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Hinted, so that every size takes the plan that large inputs need.
    texts = rows.join(needed.hint("merge"), "doc_id")
    texts = ws.keep(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("signature").alias("signature")) if _repeats(sets) else texts, "texts")
    first = pairs.groupBy("b").agg(F.max(F.struct("match", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")
    links = ws.keep(_confirm(first, texts, shingle, percent), "links")
    groups = ws.keep(connected(links, ws), "groups")
    group = lambda side: groups.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
    rest = (
        pairs.select("a", "b").join(first, ["a", "b"], "left_anti")
        .join(group("a"), "a", "left").join(group("b"), "b", "left")
        .filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
    )
    more = ws.keep(_confirm(ws.keep(rest.select("a", "b"), "rest"), texts, shingle, percent), "more")
    if more.count():
        links = links.unionByName(more)
        groups = ws.keep(connected(links, ws), "groups")
    crowd = ws.keep(_crowd_links(members, groups, texts, shingle, percent, least_depth, least_match, ws), "crowd")
    if crowd.count():
        groups = ws.keep(connected(links.unionByName(crowd), ws), "groups")
    ws.drop(texts, pairs)
    of_class = classes.select("one", "two", "n", "id").join(
        groups.select(F.col("node").alias("id"), "component"), "id", "left"
    ).select("one", "two", "n", F.coalesce("component", "id").alias("component_id"))
    of_class = ws.keep(of_class, "components")
    return (
        sets.select("doc_id", F.col("n").alias("n_shingles"), "one", "two")
        .join(of_class.withColumnRenamed("n", "n_shingles"), ["one", "two", "n_shingles"], "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("component_id", "doc_id").alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def _repeats(sets: DataFrame) -> bool:
    """Whether a doc_id occurs on several rows."""
    return bool(sets.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count())


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, the smallest doc_id; all columns. Rows without id stay."""
    ws = Workspace(docs.sparkSession, "minhash-filter")
    copies = ws.keep(
        near_duplicates(docs, shingle, percent).filter("not kept and doc_id is not null").select("doc_id").distinct(),
        "copies",
    )
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)
