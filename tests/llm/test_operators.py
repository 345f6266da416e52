"""Operators against brute force on small tables, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballotbook.llm import (
    decontamination, lines, minhash, packing, passages, quality, sharding, surrogates, topk, warc,
)
from ballotbook.llm.queries import tokenizer_path

LOWER = {c: c + 32 for c in range(65, 91)}
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text, pattern=SPACED):
    return pattern.findall((text or "").translate(LOWER))


def sentence(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, changes):
    own = text.split(" ")
    for _ in range(changes):
        own[rng.randrange(len(own))] = f"edit{rng.randrange(10**6)}"
    return " ".join(own)


# ---- near duplicates ----


def true_components(rows, percent):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_match_brute_force(docs_of, percent):
    rng = random.Random(percent)
    rows, k = [], 0
    for _ in range(40):
        base = sentence(rng, rng.choice([3, 8, 60, 200]))
        for _ in range(rng.choice([1, 1, 2, 6])):
            rows.append((k, edited(rng, base, rng.choice([0, 1, 2, 4]))))
            k += 1
    crowd = sentence(rng, 150)
    rows += [(k + j, edited(rng, crowd, rng.choice([0, 1, 1, 2]))) for j in range(60)]
    expected, sizes = true_components(rows, percent)
    found = {r["doc_id"]: r for r in minhash.near_duplicates(docs_of(rows), percent=percent).collect()}
    assert {i: r["component_id"] for i, r in found.items()} == expected
    assert {i: r["n_shingles"] for i, r in found.items()} == sizes
    assert all(r["kept"] == (i == r["component_id"]) for i, r in found.items())


def test_weak_links_in_a_crowd_are_found(docs_of):
    rng = random.Random(21)
    base = sentence(rng, 150)
    rows = [(k, edited(rng, base, 1)) for k in range(250)]
    rows += [(1000 + k, edited(rng, rows[rng.randrange(250)][1], 1)) for k in range(12)]
    rows += [(2000 + k, edited(rng, base, 4)) for k in range(60)]
    expected, _ = true_components(rows, 85)
    assert len(set(expected.values())) > 20
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs_of(rows), percent=85).collect()}
    assert found == expected


def test_near_duplicates_odd_rows(docs_of, odd_texts):
    out = minhash.near_duplicates(docs_of([*odd_texts, odd_texts[3]])).collect()
    assert len(out) == len(odd_texts) + 1
    by = {r["doc_id"]: r for r in out}
    assert by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0
    assert by[6]["component_id"] == 5 and not by[6]["kept"] and by[5]["kept"] and by[1]["kept"]
    assert minhash.near_duplicates(docs_of([])).count() == 0


def test_filter_keeps_all_columns(docs_of, odd_texts):
    frame = docs_of(odd_texts)
    kept = minhash.drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4, 5, 7, 8, None}


# ---- decontamination ----


def hits(text, items, window=10):
    own, cover, found = words(text, ALNUM), set(), set()
    for item, w in items.items():
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            for s in range(len(own) - n + 1):
                if own[s : s + n] == w[k : k + n]:
                    cover |= set(range(s, s + n))
                    found.add(item)
    return len(own), len(cover), found


@pytest.mark.parametrize("block_words", [1 << 19, 40])
def test_contamination_matches_brute_force(spark, docs_of, odd_texts, block_words):
    rng = random.Random(3)
    bench = [(k, sentence(rng, rng.choice([1, 3, 9, 10, 14, 30]), 60)) for k in range(20)] + [(20, None), (21, ""), (None, "no id"), (4, "and, more 4")]
    rows = [(k, sentence(rng, 80, 60)) for k in range(30)]
    rows += [(100 + k, sentence(rng, 20, 60) + " — " + (t or "").upper() + "! " + sentence(rng, 5, 60)) for k, (_, t) in enumerate(bench)]
    rows += [(1000 + (i or 0), t) for i, t in odd_texts]
    items = defaultdict(list)
    for i, t in bench:
        if i is not None:
            items[i].append(words(t, ALNUM))
    frame = spark.createDataFrame(bench, "item_id long, text string")
    found = {r["doc_id"]: r for r in decontamination.contamination(docs_of(rows), frame, block_words=block_words).collect()}
    for i, t in rows:
        n, cover, names = len(words(t, ALNUM)), set(), set()
        for item, texts in items.items():
            for w in texts:
                _, _, own = hits(t, {item: w})
                names |= own
        flat = {(item, k): w for item, texts in items.items() for k, w in enumerate(texts)}
        _, covered, _ = hits(t, flat)
        digest = hashlib.sha256(",".join(sorted(map(str, names))).encode()).hexdigest()
        r = found[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, covered, len(names), digest, covered > 0)
    clean = decontamination.remove_contaminated(docs_of(rows), frame, block_words=block_words)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, r in found.items() if not r["contaminated"]}


# ---- lines ----


def line_words(line):
    norm = line.replace("\t", " ").rstrip(" \r").lower()
    by_space = norm.split(" ")
    return [w.rstrip(".,;:!?") for w in (list(norm) if len(norm) > 16 * len(by_space) else by_space) if w]


def word_distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x):
        new = [i + 1]
        for j, b in enumerate(y):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def alike(x, y):
    """Plain definition: equal normalised lines, or at most max(1, words / 20) word edits from ten words on."""
    a, b = line_words(x), line_words(y)
    if x.replace("\t", " ").rstrip(" \r").lower() == y.replace("\t", " ").rstrip(" \r").lower():
        return True
    allowed = max(1, int(max(len(a), len(b)) / 20 + 1e-9))
    return min(len(a), len(b)) >= 10 and abs(len(a) - len(b)) <= allowed and word_distance(a, b) <= allowed


def true_lines_kept(rows):
    """Texts after a plain all-pairs line dedup."""
    each = [(i, k, n, line) for n, (i, t) in enumerate(rows) if i is not None and t for k, line in enumerate(t.split("\n")) if line.rstrip(" \r\t")]
    parent = list(range(len(each)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for p in range(len(each)):
        for q in range(p):
            if alike(each[p][3], each[q][3]):
                links += 1
                parent[find(p)] = find(q)
    first = {}
    for p, (i, k, n, _) in enumerate(each):
        r = find(p)
        first[r] = min(first.get(r, (i, n, k)), (i, n, k))
    cut = {(n, k) for p, (i, k, n, _) in enumerate(each) if first[find(p)] != (i, n, k)}
    return [
        (i, t if t is None or i is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (n, k) not in cut)) for n, (i, t) in enumerate(rows)
    ], links


def test_equal_and_like_lines_stay_once(docs_of):
    rng = random.Random(5)
    long = sentence(rng, 40)
    rows = [
        (1, f"head\n{long}\nalpha beta gamma delta epsilon"),
        (2, f"{long.upper()}!\nown words of the second document here\n\nhead"),
        (3, "Alpha\tbeta gamma delta EPSILON \ntail"),
        (4, "nothing repeated in this line at all\nshort line\n这是一个没有空格的中文句子请保留一次\nChapter One Summary"),
        (5, "这是一个没有空格的中文句子请保留一次\nChapter One Summary\n这是一个没有空格的中文句子请保留一回"),
    ]
    out = {r["doc_id"]: r for r in lines.dedup_lines(docs_of(rows)).collect()}
    assert out[1]["text"] == rows[0][1] and out[4]["text"] == rows[3][1]
    assert out[2]["text"] == "own words of the second document here\n" and out[2]["n_lines_cut"] == 2
    assert out[3]["text"] == "tail" and out[2]["n_chars"] == len(out[2]["text"])
    assert out[5]["text"] == "" and out[5]["n_lines_cut"] == 3


def test_lines_match_brute_force(docs_of):
    """Lines of 5 to 130 words with edits on either side of the threshold, against all pairs."""
    rng = random.Random(6)
    rows, k = [], 0
    for _ in range(130):
        base = sentence(rng, rng.choice([5, 10, 12, 15, 19, 20, 25, 35, 45, 60, 80, 100, 130]), 3000)
        own = [base]
        for _ in range(rng.choice([0, 1, 2])):
            n = len(base.split(" "))
            text = edited(rng, base, rng.choice([1, max(1, n // 20), max(1, n // 20), max(2, n // 6)]))
            words_ = text.split(" ")
            if rng.random() < 0.3:
                words_.insert(rng.randrange(n), "added")
            own.append(" ".join(words_))
        for line in own:
            rows.append((k, f"{line}\n{sentence(rng, 30, 3000)}"))
            k += 1
    rng.shuffle(rows)
    expected, links = true_lines_kept(rows)
    assert links > 60
    found = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs_of(rows)).collect()}
    cut = lambda texts: {i for i, t in texts if t.count("\n") == 0}
    wanted, got = cut(expected), cut(found.items())
    assert got <= wanted and len(got) >= 0.9 * len(wanted)


def test_lines_with_one_edit_are_found(docs_of):
    """Recall of one changed word by length; the figures in the README are from here."""
    rng, rows, sizes = random.Random(16), [], {10: 0.8, 15: 0.9, 20: 0.95, 60: 0.98, 600: 0.98}
    for size in sizes:
        for k in range(150):
            base = sentence(rng, size)
            rows += [(10000 * size + 2 * k, base), (10000 * size + 2 * k + 1, edited(rng, base, 1))]
    out = {r["doc_id"]: r["n_lines_cut"] for r in lines.dedup_lines(docs_of(rows)).collect()}
    for size, least in sizes.items():
        recall = sum(out[10000 * size + 2 * k + 1] for k in range(150)) / 150
        print(f"one word of {size} changed: {recall:.3f} found")
        assert recall >= least and not any(out[10000 * size + 2 * k] for k in range(150))


def test_no_like_lines_are_left_out(docs_of):
    """All links at the threshold: short words, few different words, no ends of chunks, letters as words, and lengths
    where the allowed edits change; against all pairs."""
    rng, rows = random.Random(23), []
    made = [
        lambda n: [rng.choice("abcd") + rng.choice("xyz") for _ in range(n)],
        lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)],
        lambda n: ["word"] * (n // 2) + [f"q{rng.randrange(90)}x" for _ in range(n - n // 2)],
        lambda n: [chr(0x5F00 + rng.randrange(800)) for _ in range(n)],
    ]
    for k in range(240):
        n, kind = rng.choice([10, 11, 19, 20, 21, 38, 39, 40, 41, 59, 60, 100, 140]), k % 4
        line = made[kind](n)
        gap = "" if kind == 3 else " "
        rows.append((2 * k, gap.join(line)))
        for _ in range(max(1, n // 20)):
            at = rng.randrange(len(line))
            line[at : at + rng.choice([0, 1, 1])] = rng.choice([[], made[kind](2)[:1], made[kind](2)[:1]])
        rows.append((2 * k + 1, gap.join(line)))
    rng.shuffle(rows)
    expected, links = true_lines_kept(rows)
    assert links > 150
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs_of(rows)).collect()} == dict(expected)


def test_crowded_buckets_are_compared_whole(docs_of):
    """3,000 lines of one template, each like only a few others: groups as by brute force over the changed words."""
    rng = random.Random(7)
    base = sentence(rng, 60)
    rows = [(k, edited(rng, base, 1)) for k in range(2000)]
    other = base.split(" ")
    for k in range(6):
        other[7 * k] = f"far{k}"
    rows += [(5000 + k, edited(rng, " ".join(other), 1)) for k in range(1000)]
    out = {r["doc_id"]: r["n_lines_cut"] for r in lines.dedup_lines(docs_of(rows)).collect()}
    assert [i for i, n in out.items() if not n] == [0, 5000]


def test_long_lines_of_one_pair_of_words_are_not_compared_in_pairs(docs_of, monkeypatch):
    """120 lines of 700 words, like in all but 60 words each: few of the 7,140 pairs are verified, the like ones found."""
    rng = random.Random(31)
    rows = []
    for k in range(120):
        own = [f"x{k}w{j}e" for j in range(60)]
        rows.append((k, " ".join([*own, *["to", "be"] * 320])))
        if k % 10 == 0:
            for j in rng.sample(range(60), 30):
                own[j] += "s"
            rows.append((1000 + k, " ".join([*own, *["to", "be"] * 320])))
    rest, keep = [], lines.Workspace.keep

    def spy(self, df, label):
        out = keep(self, df, label)
        if label == "rest":
            rest.append(out.count())
        return out

    monkeypatch.setattr(lines.Workspace, "keep", spy)
    out = {r["doc_id"]: r["n_lines_cut"] for r in lines.dedup_lines(docs_of(rows)).collect()}
    assert out == {k: int(k >= 1000) for k, _ in rows}
    assert sum(rest) < 700


def test_texts_are_read_only_for_pairs_whose_parities_allow_it(docs_of, monkeypatch):
    """100 pairs of lines that share a chunk and little else, and 10 like ones: no texts are joined for the former."""
    rng, rows = random.Random(41), []
    for k in range(110):
        own = [f"chunk{k}withalongname"] + [f"v{rng.randrange(4000)}e" for _ in range(49)]
        other = list(own) if k < 10 else own[:1] + [f"v{rng.randrange(4000)}e" for _ in range(49)]
        other[25] += "e"
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
    seen, keep = defaultdict(int), lines.Workspace.keep

    def spy(self, df, label):
        out = keep(self, df, label)
        if label in ("pairs", "close"):
            seen[label] += out.count()
        return out

    monkeypatch.setattr(lines.Workspace, "keep", spy)
    out = {r["doc_id"]: r["n_lines_cut"] for r in lines.dedup_lines(docs_of(rows)).collect()}
    assert {i for i, n in out.items() if n} == {2 * k + 1 for k in range(10)}
    assert seen["pairs"] >= 110 and 10 <= seen["close"] < 20


def test_lines_odd_rows(docs_of, odd_texts):
    many = "\n".join(f"line number {k} of a long document with {k * 7} words" for k in range(3000))
    frame = docs_of([*odd_texts, (9, many), (10, many)])
    out = {r["doc_id"]: r for r in lines.dedup_lines(frame).collect()}
    assert out[1]["text"] is None and out[2]["text"] == "" and out[3]["text"] == " \n\t "
    assert out[5]["text"] == "the same few words here again" and out[6]["text"] == ""
    assert out[9]["text"] is not None and out[10]["text"] == "" and out[None]["text"] == odd_texts[-1][1]
    assert lines.dedup_lines(docs_of([])).count() == 0
    clash = lines.dedup_lines(frame.withColumn("n_lines_cut", F.lit(77)).withColumn("row", F.lit("x")))
    assert clash.columns == [*frame.columns, "n_lines_cut", "row"] and {r["n_lines_cut"] for r in clash.collect()} == {77}


def test_rows_that_share_an_id_are_told_apart(docs_of):
    rows = [(1, "first line here\nsecond line"), (1, "only in the second row\nsecond line"), (2, "only in the second row"), (1, "first line here\nsecond line")]
    out = sorted((r["doc_id"], r["text"]) for r in lines.dedup_lines(docs_of(rows)).collect())
    assert out == [(1, ""), (1, "first line here\nsecond line"), (1, "only in the second row"), (2, "")]


# ---- passages ----


def test_passages_match_brute_force(docs_of):
    rng = random.Random(8)
    shared = [sentence(rng, n) for n in (51, 60, 90)]
    rows = []
    for k in range(60):
        own = sentence(rng, rng.choice([30, 100, 300]))
        if k % 4 == 0:
            own += " " + shared[k // 4 % 3] + " " + sentence(rng, 20)
        if k % 10 == 5:
            own += " " + edited(rng, shared[2], 3) + " " + sentence(rng, 20)
        rows.append((k, own))
    seen = defaultdict(set)
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 50):
            seen[tuple(w[k : k + 51])].add(i)
    expected = {i for v in seen.values() if len(v) > 1 for i in v}
    found = passages.repeated_passages(docs_of(rows)).collect()
    got = {r["doc_id"] for r in found} | {r["other_id"] for r in found}
    assert expected <= got
    assert got <= {k for k in range(60) if k % 4 == 0 or k % 10 == 5}
    text = {i: words(t) for i, t in rows}
    for r in found:
        assert r["doc_id"] > r["other_id"] and r["identity"] >= 0.8
        a = text[r["doc_id"]][r["from_word"] : r["to_word"]]
        b = text[r["other_id"]][r["other_from"] : r["other_to"]]
        assert min(len(a), len(b)) > 50 and len(set(a) & set(b)) >= 0.8 * len(set(a))


def test_chain_prefers_ordered_segments():
    good = [(0, 10, 100, 110), (12, 22, 112, 122), (25, 35, 126, 136)]
    best, *rest = passages.chain([*good, (11, 19, 5, 13)], 32)
    assert best == good and rest == [[(11, 19, 5, 13)]]


def test_chain_takes_near_predecessors_where_the_best_is_far():
    chains = passages.chain([(0, 1000, 0, 1000), (1200, 1230, 1200, 1230), (1235, 3235, 1235, 3235)], 64)
    assert sorted(map(len, chains)) == [1, 2]


def test_parts_of_chains_with_low_identity_are_found():
    rng = np.random.default_rng(19)
    x = rng.integers(0, 1 << 60, 132).astype(np.uint64)
    y = x.copy()
    y[51:81] = rng.integers(0, 1 << 60, 30).astype(np.uint64)
    for own in ([[0, 132, 0, 132]], [[0, 51, 0, 51], [81, 132, 81, 132]]):
        found = passages.like_parts(np.array(own), x, 0, y, 0, 50, 0.8)
        assert sorted((b0, b1) for b0, b1, *_ in found) == [(0, 51), (81, 132)]


def test_passages_that_longer_chains_cover_are_found(docs_of):
    """A longer chain whose identity is too low, a longer passage, and one that adds few words hide no source."""
    rng = random.Random(21)
    x = sentence(rng, 90).split(" ")
    low = [f"{w}no" if k % 40 >= 25 else w for k, w in enumerate(x)]  # runs of 25 equal words, 0.67 in all
    y = sentence(rng, 130).split(" ")
    rows = [
        (1, sentence(rng, 20) + " " + " ".join(low)), (2, " ".join(x[5:65]) + " " + sentence(rng, 20)), (3, " ".join(x)),
        (11, " ".join(y[:100])), (12, sentence(rng, 10) + " " + " ".join(y[20:80])), (13, " ".join(y[60:120])), (14, " ".join(y)),
    ]
    found = passages.repeated_passages(docs_of(rows)).collect()
    assert {(3, 2), (14, 11), (14, 13), (12, 11)} <= {(r["doc_id"], r["other_id"]) for r in found}
    covered = {k for r in found if r["doc_id"] == 14 for k in range(r["from_word"], r["to_word"])}
    assert covered == set(range(120))


def rows_of_joins(frame):
    """Output rows of each join, once the frame has been collected."""
    frame.collect()
    todo, out = [frame._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
        if "Join" in name:
            out.append(node.metrics().apply("numOutputRows").value())
    return out


def test_chains_of_repeated_words_are_not_joined_one_by_one(spark):
    """Of 400 chains of one pair of documents the documents' groups are looked up once."""
    chains = [(9, a, bytearray(16), k, k + 8, 0, 8, False) for a in (1, 2) for k in range(0, 3200, 8)]
    others = spark.createDataFrame(chains, "b long, a long, segments binary, b_from int, b_to int, a_from int, a_to int, first boolean")
    spans = [(9, 1000, 1500, 1, False), (9, 1600, 3210, 1, True), (9, 0, 900, 1, False), (9, 900, 1000, 1, False)]
    found = spark.createDataFrame(spans, "doc_id long, from_word int, to_word int, other_id long, at_end boolean")
    groups = spark.createDataFrame([(9, 1), (1, 1)], "node long, component long")
    kept = passages._may_add(others, found, groups, 23)
    got = {(r["a"], r["b_from"]) for r in kept.collect()}
    assert got == {(2, k) for k in range(0, 3200, 8)} | {(1, k) for k in range(0, 3200, 8) if k + 8 + 23 > 1500 and k - 23 < 1600}
    assert max(rows_of_joins(kept)) <= 2


def test_words_over_and_over_are_one_chain_a_pair(spark):
    """A word pair over and over in each of 40 documents: a chain for each range of words, not for each occurrence."""
    texts = [(k, " ".join(["to be"] * (150 if k % 2 else 400)) + f" end{k}") for k in range(40)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    seeds = passages._seeds(frame, 8, 16, 50).coalesce(1).sortWithinPartitions("seed", "doc", "pos")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for rows in ("64", "10000"):  # runs over the borders of batches, and within them
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            anchors = passages._anchors(seeds, 16).filter("b_pos >= 0").coalesce(1).sortWithinPartitions("b", "a", "b_pos")
            assert passages._chains(anchors, 8, 16, 64, 16).count() <= 40 * 8
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    spans = defaultdict(set)
    for r in passages.repeated_passages(frame).collect():
        spans[r["doc_id"]] |= set(range(r["from_word"], r["to_word"]))
    assert all(len(spans[k]) >= (299 if k % 2 else 799) for k in range(1, 40))


@pytest.mark.parametrize("partitions", [2, 37])
def test_passages_over_the_borders_of_ranges(spark, docs_of, partitions):
    """Every document repeats one passage: each range of seeds ends inside an equal seed."""
    rng = random.Random(20)
    shared = sentence(rng, 60)
    rows = [(k, f"{sentence(rng, 30)} {shared} {sentence(rng, 30)}") for k in range(150)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = passages.repeated_passages(docs_of(rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert {r["doc_id"] for r in found} == set(range(1, 150))


def test_minimizers_cover_every_window():
    hashes = np.random.default_rng(0).integers(0, 1 << 63, 500).astype(np.uint64)
    at = set(passages.minimizers(hashes, 16).tolist())
    for k in range(len(hashes) - 15):
        assert k + int(hashes[k : k + 16].argmin()) in at
    assert len(at) < 120


def test_cut_passages_and_odd_rows(docs_of, odd_texts):
    frame = docs_of([*odd_texts, (20, sentence(random.Random(1), 80)), (21, "first words " + sentence(random.Random(1), 80) + "\nlast words")])
    found = passages.repeated_passages(frame)
    assert {(r["doc_id"], r["other_id"]) for r in found.collect()} == {(21, 20)}
    out = {r["doc_id"]: r["text"] for r in passages.cut_passages(frame, found).collect()}
    assert out[21] == "first words last words" and out[1] is None and out[8] == odd_texts[7][1]
    assert passages.repeated_passages(docs_of([])).count() == 0


# ---- surrogates ----

KEY = b"test key"


def test_mentions_and_formats():
    text = (
        "Write to Ann.Lee@Mail.example.com or ann.lee@mail.example.com, call +1 (743) 555-3824, card 4111 1111 1111 1111, "
        "host 10.1.2.3 and 152.143.123.131, ssn 123-45-6789, token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\", "
        "iban DE89 3704 0044 0532 0130 00. Mrs. Maria Gomez met Herr Schulz; Gomez left. Господин Иван Петров."
    )
    out, n = surrogates.replace(text, KEY, {})
    kinds = [m.kind for m in surrogates.mentions(text)]
    assert n == len(kinds) and {"email", "phone", "card", "ip", "ssn", "secret", "iban", "given-f", "family-n"} <= set(kinds)
    for raw in ("Ann.Lee", "ann.lee", "555-3824", "4111 1111", "152.143", "123-45-6789", "24be64", "3704 0044", "Maria", "Gomez", "Schulz", "Петров"):
        assert raw not in out
    again = surrogates.mentions(out)
    assert [m.kind for m in again if m.kind in ("email", "phone", "card", "ip", "ssn", "secret", "iban")] == [
        k for k in kinds if k in ("email", "phone", "card", "ip", "ssn", "secret", "iban")
    ]
    by = defaultdict(list)
    for m in again:
        by[m.kind].append(out[m.start : m.end])
    assert by["email"][0].lower() == by["email"][1] and surrogates.luhn(re.sub(r"\D", "", by["card"][0]))
    assert by["ip"][0].startswith("10.") and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", by["phone"][0])
    assert re.fullmatch("[0-9a-f]{40}", by["secret"][0])
    assert surrogates.replace(text, KEY, {})[0] == out and surrogates.replace(text, b"other", {})[0] != out


def test_collisions_draw_again(spark):
    from ballotbook.llm.workspace import Workspace

    found = spark.createDataFrame([("ssn", f"{k:09d}") for k in range(40)], "kind string, canonical string")

    def narrow(frame, key, attempt):
        # every fourth entity meets another or a real one at attempt 0
        made = F.when((F.lit(attempt) == 0) & (F.col("canonical").cast("int") % 4 == 0), F.lit("000000003")).otherwise(
            F.concat(F.lit("9"), F.substring("canonical", 2, 8))
        )
        return frame.select("kind", "canonical", made.alias("surrogate"))

    again = surrogates.assign(found, KEY, Workspace(spark, "t"), draws=narrow).collect()
    assert {r["canonical"] for r in again} == {f"{k:09d}" for k in range(0, 40, 4)}
    assert len({r["surrogate"] for r in again}) == 10


@pytest.mark.parametrize("send", [100_000, -1])
def test_surrogates_odd_rows(docs_of, odd_texts, send):
    frame = docs_of([*odd_texts, (30, "mail a.b@c.example.com and 1.2.3.4"), (31, "again A.B@c.example.com")])
    out = surrogates.replace_personal_data(frame, KEY, send_at_most=send)
    assert out.columns == [*frame.columns, "n_entities"]
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[1]["text"] is None and by[8]["text"] == odd_texts[7][1] and by[30]["n_entities"] == 2
    assert by[30]["text"].split()[1] == by[31]["text"].split()[1].lower() != "a.b@c.example.com"
    assert surrogates.replace_personal_data(docs_of([]), KEY).count() == 0


# ---- sharding ----


def test_surrogates_are_distinct_and_coreferent_over_a_corpus(docs_of):
    """Plain mapping of every mention: one surrogate for one entity in all formats, none for two."""
    rng = random.Random(17)
    people = [f"{a} {b}" for a in ("Anna", "Jonas", "Maria", "Peter") for b in ("Gray", "Lopez", "Schulz")]
    rows = []
    for k in range(120):
        who, n = rng.choice(people), rng.randrange(40)
        form = rng.choice(["Mrs", "Dr", "Mr", "my name is"])
        phone = rng.choice(["(743) 555-38%02d", "+1 743 555 38%02d", "743-555-38%02d", "+1 (743) 555-38%02d"]) % n
        rows.append((k, f"{form} {who} has {phone} and u{n}@site{n % 7}.org"))
    out = {r["doc_id"]: r["text"] for r in surrogates.replace_personal_data(docs_of(rows), KEY).collect()}
    seen = defaultdict(set)
    for k, text in rows:
        a, b = text.split(" has "), out[k].split(" has ")
        for x, y in zip(a[0].split()[-2:], b[0].split()[-2:]):
            seen["name", x].add(y)
        (p, e), (q, f) = a[1].split(" and "), b[1].split(" and ")
        assert re.sub(r"\d", "0", p) == re.sub(r"\d", "0", q) and p != q
        seen["phone", re.sub(r"\D", "", p)[-10:]].add(re.sub(r"\D", "", q)[-10:])
        seen["mail", e].add(f)
        seen["site", e.split("@")[1]].add(f.split("@")[1])
    assert all(len(v) == 1 for v in seen.values())
    for kind in ("name", "phone", "mail", "site"):
        own = [next(iter(v)) for (k, _), v in seen.items() if k == kind]
        assert len(set(own)) == len(own) and not set(own) & {x for k, x in seen if k == kind}
    clash = surrogates.replace_personal_data(docs_of(rows[:3]).withColumn("n_entities", F.lit(77)), KEY)
    assert {r["n_entities"] for r in clash.collect()} == {77}


def test_secrets_of_symbols_and_other_scripts_are_replaced(docs_of):
    secrets = ["********", "парольсекрет", "密码密码密码密码"] + [f"*******{d}" for d in range(4)]
    rows = [(k, f'password="{x}"') for k, x in enumerate(secrets)]
    out = [r["text"][10:-1] for r in surrogates.replace_personal_data(docs_of(rows), b"key").collect()]
    assert len(set(out)) == len(secrets) and not set(out) & set(secrets)
    assert {len(x) for x in out} == {len(x) for x in secrets}


def test_rows_without_id_get_redrawn_entities_at_any_size(docs_of):
    rows = [(1 + k, f'password="*******{k}"') for k in range(4)] + [(None, f'password="*******{k}"') for k in range(4)]
    sent, joined = (
        sorted((r["doc_id"] or 0, r["text"]) for r in surrogates.replace_personal_data(docs_of(rows), b"key", send_at_most=n).collect())
        for n in (100_000, 0)
    )
    assert sent == joined


def best_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, used, at = (low + high) // 2, 1, 0
        for s in sizes:
            if at + s > middle:
                used, at = used + 1, 0
            at += s
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("max_blocks", [1 << 14, 24])
def test_sharding_is_minimax(docs_of, max_blocks):
    rng = random.Random(9)
    texts = [sentence(rng, rng.choice([1, 5, 50, 400])) for _ in range(300)]
    rows = [(k, rng.choice(texts) if k % 3 else texts[0]) for k in range(900)]
    out = sharding.shard_documents(docs_of(rows), max_blocks=max_blocks).collect()
    groups = defaultdict(int)
    for i, t in rows:
        groups[hashlib.sha256(t.encode()).digest()] += len(t.encode()) + 1
    text, shard_of, size = dict(rows), {}, defaultdict(int)
    for r in out:
        assert r["size"] == len(text[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
        assert shard_of.setdefault(text[r["doc_id"]], r["shard"]) == r["shard"]
        size[r["shard"]] += r["size"]
    assert max(size.values()) == best_capacity([groups[d] for d in sorted(groups)], 16)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_with_one_group_of_half_the_corpus(spark):
    """Half of all rows are one text, some others are repeated, over many partitions; against the plain search."""
    rows = 50_000
    text = F.when(F.col("id") % 2 == 0, F.lit("one text that half of the corpus has")).when(
        F.col("id") % 10 == 1, F.concat(F.lit("repeated "), F.expr("id % 40"))
    ).otherwise(F.concat(F.lit("text "), F.sha2(F.col("id").cast("string"), 256)))
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.range(rows).select(F.col("id").alias("doc_id"), text.alias("text"))
        out = sharding.shard_documents(frame).join(frame, "doc_id").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert len(out) == rows and (out.groupby("text")["shard"].nunique() == 1).all()
    sizes = out.groupby("text")["size"].sum()
    ordered = sizes.loc[sorted(sizes.index, key=lambda t: hashlib.sha256(t.encode()).digest())].tolist()
    assert out.groupby("shard")["size"].sum().max() == best_capacity(ordered, 16)
    assert all(sorted(s) == list(range(len(s))) for _, s in out.groupby("shard")["slot"])


@pytest.mark.parametrize("seed", range(6))
def test_the_search_over_blocks_is_that_over_groups(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 3, 50, 50, 400, 9000 if seed % 2 else 5]) for _ in range(400)]
    items = [sharding.Item(k, s, 1, True) for k, s in enumerate(sizes)]
    best, shards = best_capacity(sizes, 16), 16
    assert sharding.Order(items).smallest(shards, max(sizes), False) == best
    blocks = [sharding.Item(k + 19, sum(sizes[k : k + 20]), 20, False) for k in range(0, 400, 20)]
    order = sharding.Order(blocks)
    while ranges := order.uncertain(shards, max(sizes)):
        assert len(ranges) <= shards
        a, b = ranges[0]
        inside = items[order.items[a - 1].last + 1 if a else 0 : order.items[b - 1].last + 1]
        order = sharding.Order(order.items[:a] + inside + order.items[b:])
    assert order.smallest(shards, max(sizes), False) == best


def test_sharding_odd_rows(docs_of, odd_texts):
    out = {r["doc_id"]: r for r in sharding.shard_documents(docs_of(odd_texts)).collect()}
    assert len(out) == len(odd_texts) and out[1]["size"] == out[2]["size"] == 1 and out[1]["shard"] == out[2]["shard"]
    assert out[1]["law"] == "bytes" and out[1]["grown_shard"] is None
    assert sharding.shard_documents(docs_of([])).count() == 0


# ---- quality ----


def test_quality_learns_and_compiles(spark, docs_of):
    rng = random.Random(10)
    rows, labels = [], []
    for k in range(600):
        bad = k % 4 == 0
        text = " ".join(f"{w}###" for w in sentence(rng, 60).split()) if bad else sentence(rng, 60) + "."
        rows.append((k, text))
        labels.append((k, int(not bad), 0))
    frame = docs_of(rows)
    marks = spark.createDataFrame([*labels, (10**6, 1, 0), (1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.score_quality(frame, marks).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    held = [i for i, r in out.items() if r["held_out"]]
    assert np.mean([out[i]["predicted"] == int(i % 4 != 0) for i in held]) > 0.97
    model = quality.train(frame, marks)
    stats = quality.document_statistics(frame).orderBy("doc_id").collect()
    x = np.array([[r[s] for s in quality.STATISTICS] for r in stats])
    assert np.allclose(model.score(x), [out[r["doc_id"]]["score"] for r in stats])
    kept = quality.keep_quality(frame, marks)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in out.items() if r["predicted"]}
    # labels of held-out rows do not move any score
    flipped = marks.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r["doc_id"]: r["score"] for r in quality.score_quality(frame, flipped).collect()} == {i: r["score"] for i, r in out.items()}


def test_quality_odd_rows(spark, docs_of, odd_texts):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.score_quality(docs_of(odd_texts), none).collect()
    assert len(out) == len(odd_texts) and all(0 <= r["score"] <= 1 for r in out)
    assert quality.score_quality(docs_of([]), none).count() == 0


# ---- archives ----


def test_archives_round_trip(spark):
    rng = random.Random(11)
    rows = [(k, f"http://h{k % 5}.example/p/{k}", f"<p>{sentence(rng, 30)}é</p>" if k % 3 else "<p>same</p>") for k in range(200)]
    rows += [(300, "u", None), (301, None, ""), (302, "long", "x" * 3_000_000), (None, "n", "<p>same</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    from ballotbook.llm.workspace import Workspace

    ws = Workspace(spark, "t")
    folder = ws.path("archives")
    index = ws.keep(warc.write_archives(pages, folder), "index")
    html = {i: (h or "").encode() for i, _, h in rows}
    first = {}
    for i, h in html.items():
        if i is not None:
            first[h] = min(i, first.get(h, i))
    out = {r["page_id"]: r for r in warc.read_records(index, folder).collect()}
    assert len(out) == len(rows) and all(r["intact"] for r in out.values())
    import base64

    for i, h in html.items():
        r = out[i]
        assert r["payload_bytes"] == len(h) and r["payload_digest"] == base64.b32encode(hashlib.sha1(h).digest()).decode()
        if i is not None and first[h] == i:
            assert r["record_type"] == "response" and bytes(r["payload"]) == h and r["refers_to"] is None
        else:
            assert r["record_type"] == "revisit" and r["refers_to"] == first[h]
    import gzip
    from pathlib import Path

    ids = []
    for f in Path(folder.removeprefix("file:").replace("//", "/")).glob("*.warc.gz"):
        heads = [h.split(b"\r\n") for h in re.findall(rb"WARC/1\.1\r\n(?:[^\r\n]+\r\n)+", gzip.decompress(f.read_bytes()))]
        assert heads[0][1] == b"WARC-Type: warcinfo"
        ids += [line for h in heads for line in h if line.startswith(b"WARC-Record-ID")]
        assert all(any(line.startswith(b"WARC-Date: 2") for line in h) for h in heads)
    assert len(ids) == len(set(ids)) > len(rows)
    some = warc.read_records(index.filter("page_id % 7 = 0"), folder)
    assert {r["page_id"] for r in some.collect()} == {i for i in html if i is not None and i % 7 == 0}
    twice = warc.archive_round_trip(pages.filter("page_id < 4").unionAll(pages.filter("page_id < 4")).withColumn("file", F.lit("x"))).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in twice) == sorted(
        [(0, "response", None), (3, "revisit", 0), (1, "response", None), (2, "response", None)] * 2, key=str
    )
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_round_trip(none).count() == 0
    small = {r["page_id"]: r["record_type"] for r in warc.archive_round_trip(pages, min_revisit_bytes=100).collect()}
    assert small[3] == small[0] == "response"


# ---- search ----


@pytest.mark.parametrize("block_rows,query_rows", [(8192, 4096), (50, 7)])
def test_top_k_is_exact(spark, block_rows, query_rows):
    rng = np.random.default_rng(12)
    vectors = np.round(rng.normal(size=(400, 16)), 1)
    vectors[50:120] = vectors[49]
    rows = [(int(k), [float(x) for x in v]) for k, v in enumerate(vectors)]
    odd = [(1000, None), (1050, [1.0, None]), (1100, [float("nan")] * 16), (1150, []), (1200, [1.0, 2.0]), (1250, [3.0, -1.0]), (None, rows[0][1])]
    frame = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).repartition(3)
    out = defaultdict(list)
    for r in topk.top_inner_products(frame, F.col("vec_id") % 50 == 0, block_rows=block_rows, query_rows=query_rows).collect():
        out[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    whole = np.floor(256 * vectors.astype(np.float32).astype(np.float64)).astype(np.int64)
    for q in range(0, 400, 50):
        best = sorted((-int(whole[q] @ whole[k]), k) for k in range(400) if k != q)[:5]
        assert sorted(out[q]) == [(n + 1, k, -s) for n, (s, k) in enumerate(best)]
    assert sorted(out[1200]) == [(1, 1250, 256 * 256 * 1)] and set(out) == {*range(0, 400, 50), 1200, 1250}
    assert topk.top_inner_products(frame.filter("false"), F.col("vec_id") % 50 == 0).count() == 0


# ---- packing ----


def test_top_k_with_a_query_id_on_several_rows():
    queries = np.array([[10, 1]])
    block = np.array([[1000, 1]] * 4 + [[v, 0] for v in range(400)])
    ids = np.array([7] * 4 + list(range(100, 500)))
    lists = topk.Lists(ids, block.astype(np.float64))
    _, b, scores = topk.block_top(queries.astype(np.float64), np.array([7]), lists, 5, np.full(1, -np.inf), scale=1)
    best = sorted(zip(-scores, ids[b]))[:5]
    assert best == [(-10 * v, 100 + v) for v in (399, 398, 397, 396, 395)]


@pytest.mark.parametrize("skew", [True, False])
def test_top_k_reading_stops_early_on_skewed_lists(skew):
    rng = np.random.default_rng(18)
    vectors = rng.normal(size=(4000, 8))
    if skew:
        vectors[:, 0] = rng.pareto(1.0, 4000) * 50
        vectors *= np.array([1, *[0.01] * 7])
    queries = np.abs(rng.normal(size=(6, 8))) + 0.5
    lists = topk.Lists(np.arange(4000), vectors)
    a, b, scores = topk.block_top(queries, np.full(6, -1), lists, 5, np.full(6, -np.inf))
    whole = np.floor(256 * vectors).astype(np.int64) @ np.floor(256 * queries).astype(np.int64).T
    for k in range(6):
        got = sorted(zip(-scores[a == k], b[a == k]))[:5]
        assert got == sorted(zip(-whole[:, k], range(4000)))[:5]
    assert lists.entries < 0.2 * vectors.size if skew else lists.entries <= vectors.size


def test_top_k_of_large_and_repeated_components(spark):
    rows = [(0, [600000.0, 1.0]), (50, [1e200, 1.0]), (1, [2.0**40, 3.0]), (2, [-1e300, 0.0]), (3, [1.0, 1.0]), (4, [2.0**53, 5.0]), (3, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = defaultdict(list)
    for r in topk.top_inner_products(frame, F.col("vec_id") % 50 == 0).collect():
        out[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    score = lambda x, y: max(-topk.LONG - 1, min(topk.LONG, sum(topk.whole(a, 256) * topk.whole(b, 256) for a, b in zip(x, y))))
    for q, v in rows[:2]:
        best = sorted((-score(v, w), i) for i, w in rows if i != q)[:5]
        assert sorted(out[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]


def test_packing_covers_every_token_and_keeps_shares(docs_of, odd_texts):
    from tokenizers import Tokenizer

    rng = random.Random(13)
    rows = [(k, sentence(rng, rng.choice([2, 30, 300, 900])) + " naïve <|endoftext|>") for k in range(300)] + [(1000 + (i or 500), t) for i, t in odd_texts]
    source = ["big" if k % 3 else f"s{k % 12}" for k in range(len(rows))]
    out = packing.pack_documents(docs_of(rows, source), tokenizer_path(), sequence=256, window=4096).collect()
    own = Tokenizer.from_file(tokenizer_path())
    ids = {i: np.array(own.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for i, t in rows}
    pieces, places = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
    for i, x in ids.items():
        at = 0
        for s, n in sorted(pieces[i]):
            assert s == at
            at += n
        assert at == len(x)
    last = max(places)
    assert sorted(places) == list(range(last + 1))
    for k, p in places.items():
        at = 0
        for s, n in sorted(p):
            assert s == at
            at += n
        assert at == 256 or k == last
    share = sum(len(ids[i]) for (i, _), s in zip(rows, source) if s == "big") / sum(map(len, ids.values()))
    windows = defaultdict(int)
    for r in out:
        windows[r["sequence_id"] // 16] += r["length"] * (r["source"] == "big")
    full = [n for w, n in windows.items() if (w + 1) * 16 <= last]
    assert full and all(abs(n - 4096 * share) <= 2 for n in full)
    assert packing.pack_documents(docs_of([]), tokenizer_path()).count() == 0


@pytest.mark.parametrize("shares", [{"a": 0.5, "b": 0.2}, {"a": 0.0, "b": 0.9}, {"b": 0.25, "c": 0.25, "a": 0.5}])
def test_packing_fills_windows_to_target_shares(docs_of, shares):
    rng = random.Random(14)
    rows = [(k, sentence(rng, rng.choice([20, 90, 200]))) for k in range(240)]
    source = ["abc"[k % 3] for k in range(240)]
    out = packing.pack_documents(docs_of(rows, source), tokenizer_path(), sequence=128, window=2048, shares=shares).collect()
    assert sum(r["length"] for r in out) == sum({r["doc_id"]: r["doc_tokens"] for r in out}.values())
    total, windows = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for r in out:
        total[r["source"]] += r["length"]
        windows[r["sequence_id"] // 16][r["source"]] += r["length"]
    first = {"a": shares.get("a"), "b": shares.get("b"), "c": shares.get("c", 1 - sum(shares.values()))}
    done, deficit = defaultdict(int), 0
    for w in sorted(windows):
        if any(done[s] + 2048 * p > total[s] for s, p in first.items()):
            break
        for s, p in first.items():
            done[s] += windows[w][s]
            deficit = max(deficit, abs(done[s] - 2048 * (w + 1) * p))
    assert w > 2 and deficit <= 1 + 1e-6


def test_packing_with_many_small_sources(docs_of):
    rng = random.Random(15)
    rows = [(k, sentence(rng, 12)) for k in range(1500)]
    source = [f"s{k}" if k % 3 else "big" for k in range(1500)]
    out = packing.pack_documents(docs_of(rows, source), tokenizer_path(), sequence=64, window=256).collect()
    places = defaultdict(list)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["source"] == source[r["doc_id"]]
    assert sum(r["length"] for r in out) == sum({r["doc_id"]: r["doc_tokens"] for r in out}.values())
    for k, p in places.items():
        assert [o for o, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:j]) for j in range(len(p))]
        assert sum(n for _, n in p) == 64 or k == max(places)


def test_packing_null_id_and_source(spark):
    frame = spark.createDataFrame([(None, "a b c", None), (1, None, None), (1, "a b c", "x"), (1, "a b c", "x")], "doc_id long, text string, source string")
    out = packing.pack_documents(frame, tokenizer_path()).collect()
    assert len(out) == 4 and sum(r["doc_id"] is None for r in out) == 1
