"""Fuzzy line deduplication [native].

Lines are normalised: lower case, tabs as spaces, no white space at the end. Equal normalised lines that are not
blank are one line class, whatever their length or script. Words are apart by single spaces and lose punctuation at
the end; a line with over ``CHARACTERS`` characters to the word, such as text without spaces, has its characters as
words.

Lines of ``LEAST_WORDS`` words or more are alike if they differ in at most one word, and from 20 words on in at most
one word in twenty (edit distance over words; ``similarity`` is 0.95). Every such pair has an equal key:

- Where one edit is allowed (to 39 words) one half of the line that is not longer is untouched. Keys are the halves of
  the line's own length and of one word less, so that lines of n and n + 1 words meet at the halves of n.
- Where e > 1 edits are allowed a line is cut into chunks behind words whose last character is in ``ENDS``. An edit
  takes at most two chunks from a line, so of m chunks m - 2 e are in both lines. In any order of all chunks the first
  2 e + 1 of each line then have one in common (prefix filter). The order is longest first, as those are rarest.
- Two lines may both have at most 2 e chunks. Such lines have single words as chunks too, of which an edit takes one.

Classes are joined on equal keys: every class of a bucket with the most central class (the one whose buckets are
largest) of the bucket and of its own length there, and once more outside the largest component, which is linear in
the bucket; a bucket of two is its own pair. Pairs whose lengths and words' parities allow the distance are verified on
the texts. Classes of buckets of over ``CROWDED`` rows that still have several
components get finer keys: an edit takes at most two pairs of neighbouring words from a line, so in any order of all such
pairs the first 2 e + 1 of each of two like lines have one in common. The order is rarest first, so that lines of one
template share a key only where the same words are changed alike. Buckets of these keys have pivots too. Last, in every
bucket with several components the classes outside the largest one are joined with all classes of other components, by
bands of length and in salted parts; pairs whose lengths and whose words' parities allow the distance are verified. So no
link of a bucket is left out and no bucket is capped. Links make groups; the first occurrence (by doc_id, then stored
order for rows that share one, then line number) of each group stays and all other lines of it are cut.

Null and empty texts have one blank line, which stays. Very long texts are read whole, line by line. Ties: of equal
lines of one document the upper one stays. Rows without doc_id stay as they are and are not compared. Repeated rows
and rows that share a doc_id are told apart. An empty table stays empty. Other columns pass through; a column of the
name ``n_lines_cut`` passes through too, and the count is then left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected
from .workspace import Workspace

LEAST_WORDS, CHARACTERS = 10, 16
PUNCTUATION = ".,;:!?"
#: Last characters of the words behind which a chunk ends: about a third of words. Any set gives the same links.
ENDS = "es147\u0430-\u0438\u0627-\u062c\u0905-\u091f\u3040-\u3060\u4e00-\u5fff\uac00-\ub8ff"
PART = 512
#: Rows of a bucket up to which classes outside its largest component meet the others by the bucket's own key.
CROWDED = 64
_ROW = "__ballotbook_row"


def normalised(line: Column) -> Column:
    """Lower case, tabs as spaces, without white space at the end."""
    return F.lower(F.rtrim(F.replace(line, F.lit("\t"), F.lit(" ")), F.lit(" \r")))


def words_of(plain: Column, by_letter: Column) -> Column:
    """The words of a line's plain text."""
    return F.when(by_letter, F.split(plain, "")).otherwise(F.split(plain, " "))


def blank() -> Column:
    """The class of blank lines."""
    return F.xxhash64(F.lit(""))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, line_no, norm, id) of every line of documents with an id that is not blank."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    each = docs.filter("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(_ROW).alias("row"), F.posexplode(F.split(text, "\n")).alias("line_no", "line")
    )
    each = each.select("doc_id", "row", "line_no", normalised(F.col("line")).alias("norm"))
    return each.withColumn("id", F.xxhash64("norm")).filter(F.col("id") != blank())


def allowed(longer: Column, similarity: float) -> Column:
    """Words in which lines may differ, by the words of the longer one."""
    return F.greatest(F.lit(1), F.floor(longer * F.lit(1 - similarity) + F.lit(1e-9)).cast("int"))


def _sketches(lines: DataFrame, similarity: float) -> DataFrame:
    """The lines with by_letter, plain, words and keys, all null below ``LEAST_WORDS`` words; lines that are alike have
    an equal key."""
    # One projection after another, and a number that no filter passes, so that nothing is worked out twice.
    norm, place = F.col("norm"), ("doc_id", "row", "line_no", "id")
    held = lines.select(*place, "norm", F.size(F.split("norm", " ")).alias("n"))
    # A line of at most that many bytes has no more characters.
    long = (F.octet_length("norm") > CHARACTERS * F.col("n")) & (F.length("norm") > CHARACTERS * F.col("n"))
    odd = F.contains(norm, F.lit("  ")) | F.startswith(norm, F.lit(" "))
    held = held.select(*place, "norm", "n", long.alias("by_letter"), odd.alias("odd"))
    # The words' text: a single space between words, no punctuation at their ends; of letters all punctuation alike.
    single = F.when(F.col("odd"), F.trim(F.regexp_replace(norm, " {2,}", " "))).otherwise(norm)
    plain = F.regexp_replace(single, r"[.,;:!?]+(?= |\z)", "")
    letters_ = F.translate(norm, PUNCTUATION, "." * len(PUNCTUATION))
    some = F.col("by_letter") | (F.col("n") >= LEAST_WORDS)
    held = held.select(*place, "by_letter", "odd", "n", F.when(some, F.when(F.col("by_letter"), letters_).otherwise(plain)).alias("plain"))
    words = F.when(F.col("odd"), F.size(F.split("plain", " "))).otherwise(F.col("n"))
    held = held.select(*place, "by_letter", "plain", F.when(F.col("by_letter"), F.length("plain")).otherwise(words).alias("words"))
    enough = F.col("words") >= LEAST_WORDS
    held = held.select(
        *place, "by_letter", F.when(enough, F.col("plain")).alias("plain"), F.when(enough, F.col("words")).alias("words"), F.monotonically_increasing_id().alias("line")
    )
    # The most edits that a line of at least as many words may have against this one.
    longest = F.floor(F.col("words") / F.lit(similarity) + F.lit(1e-9))
    held = held.withColumn("e", allowed(longest, similarity)).withColumn("one", allowed(F.col("words"), similarity) == 1)
    chunks = F.when(F.col("by_letter"), F.split("plain", f"(?<=[{ENDS}])")).otherwise(F.split("plain", f" (?<=[{ENDS}] )"))
    held = held.withColumn("chunks", F.when(F.col("e") > 1, F.array_remove(chunks, "")))
    poor = (F.col("e") > 1) & (F.size("chunks") <= 2 * F.col("e"))
    held = held.withColumn("poor", poor).withColumn("t", F.when(F.col("poor"), words_of(F.col("plain"), F.col("by_letter"))))

    def prefix(of: Column, kind: int) -> Column:
        """The first 2 e + 1 of all: eight bits of length, 55 of hash, in falling order."""
        rank = lambda c: F.shiftleft(F.least(F.octet_length(c), F.lit(255)).cast("long"), 55).bitwiseOR(
            F.shiftrightunsigned(F.xxhash64(F.lit(kind), c), 9))
        return F.array_distinct(F.slice(F.sort_array(F.transform(of, rank), asc=False), 1, 2 * F.col("e") + 1))

    def halves(n: Column) -> list[Column]:
        half, text = F.floor(n / 2).cast("int"), F.col("plain")
        part = lambda words, letters: F.when(F.col("by_letter"), letters).otherwise(words)
        count = lambda k: F.call_function("substring_index", text, F.lit(" "), k)
        return [
            F.xxhash64(F.lit(2), n, part(count(half), F.substring(text, F.lit(1), half))),
            F.xxhash64(F.lit(3), n, part(count(half - n), F.substring(text, F.col("words") - n + half + 1, n - half))),
        ]

    none = F.array().cast("array<bigint>")
    n = F.col("words")
    shorter = F.when(n > LEAST_WORDS, F.array(*halves(n - 1))).otherwise(none)
    keys = F.concat(
        F.when(F.col("one"), F.concat(F.array(*halves(n)), shorter)).otherwise(none),
        F.when(F.col("e") > 1, prefix(F.col("chunks"), 0)).otherwise(none),
        F.when(F.col("poor"), prefix(F.col("t"), 1)).otherwise(none),
    )
    return held.select(*place, "line", "by_letter", "plain", "words", F.when(n.isNotNull(), keys).alias("keys"))


def _plausible(similarity: float) -> Column:
    """Of two lines (suffixes a and b) whether their lengths allow the similarity."""
    longer, shorter = F.greatest("words_a", "words_b"), F.least("words_a", "words_b")
    return longer - shorter <= allowed(longer, similarity)


def _side(members: DataFrame, side: str, *more: str) -> DataFrame:
    return members.select("key", *more, *[F.col(c).alias(f"{c}_{side}") for c in ("id", "words")])


def _pair(found: DataFrame) -> DataFrame:
    return found.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def _members(sketches: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """The pairs of the buckets of two classes, and (key, id, words, size, pivots) of the classes in larger buckets, with
    the most central classes of each."""
    keyed = sketches.filter("words is not null").select(F.explode("keys").alias("key"), "id", "words")
    ends = keyed.groupBy("key").agg(F.min("id").alias("__a"), F.max("id").alias("__z"))
    buckets = ws.keep(ends.filter("__a != __z").select("key"), "buckets")
    ws.release()
    shared = ws.keep(keyed.join(buckets.hint("shuffle_hash"), "key").distinct(), "shared")
    ws.release()
    sizes = ws.keep(shared.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a"), F.max("id").alias("b")), "sizes")
    two = sizes.filter("n = 2").select("a", "b").distinct()
    shared = ws.keep(shared.join(sizes.filter("n > 2").select("key", "n").hint("shuffle_hash"), "key"), "larger")
    # A class whose buckets are large is in the middle of its like: the least words changed from all others.
    central = shared.groupBy("id").agg(F.sum("n").alias("size"))
    members = ws.keep(shared.drop("n").join(central.hint("shuffle_hash"), "id"), "members")
    return two, ws.keep(_with_pivots(members), "pivots")


def _with_pivots(members: DataFrame) -> DataFrame:
    """The members with the most central class of their bucket and that among those of their own length."""
    own = members.groupBy("key", "words").agg(F.max(F.struct("size", "id")).alias("most"))
    of_key = own.groupBy("key").agg(F.max("most").alias("all"))
    both = own.join(of_key.hint("shuffle_hash"), "key")
    both = both.select("key", "words", F.array_distinct(F.array("most.id", "all.id")).alias("pivots"))
    return members.join(both.hint("shuffle_hash"), ["key", "words"])


def _first_pairs(members: DataFrame) -> DataFrame:
    """Each class of a bucket with the pivots of the bucket."""
    found = members.select("id", F.explode("pivots").alias("pivot")).filter("id != pivot")
    return found.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()


def _mixed(members: DataFrame, groups: DataFrame, ws: Workspace) -> DataFrame:
    """The rows of buckets with several components: with component, largest component and the bucket's rows."""
    of = groups.select(F.col("node").alias("id"), "component")
    rows = members.select("key", "id", "words", "size").join(of.hint("shuffle_hash"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    rows = ws.keep(rows, "components")
    sizes = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("key").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("rows"),
    ).filter("k > 1").drop("k")
    out = ws.keep(rows.join(mixed.hint("shuffle_hash"), "key"), "mixed")
    ws.drop(rows)
    ws.release()
    return out


def _finer(crowded: DataFrame, texts: DataFrame, similarity: float, ws: Workspace) -> DataFrame:
    """(id, words, size, poor, keys, p0 to p7): the rarest pairs of neighbouring words of each class, where there are
    more than edits may take (else ``poor``), and more bits of parity."""
    own = crowded.groupBy("id").agg(F.first("size").alias("size"))
    held = texts.join(own.hint("shuffle_hash"), "id").select("id", "words", "size", "plain", "by_letter")
    held = ws.keep(held, "crowded").select("id", "words", "size", words_of(F.col("plain"), F.col("by_letter")).alias("t"))
    edge = F.array(F.lit(""))
    two = F.zip_with(F.concat(edge, "t"), F.concat("t", edge), lambda a, b: F.xxhash64(F.lit(4), a, b))
    longest = F.floor(F.col("words") / F.lit(similarity) + F.lit(1e-9))
    marks = tuple(f"p{g}" for g in range(8))
    bits = _parities(held.select("id", "t"), marks)
    held = held.select("id", "words", "size", two.alias("two"), (2 * allowed(longest, similarity)).alias("gone"))
    each = held.select("id", "gone", F.explode("two").alias("two"))
    # The second of equal pairs in a line is another key than the first.
    nth = F.row_number().over(Window.partitionBy("id", "two").orderBy("two"))
    each = each.select("id", "gone", F.xxhash64("two", nth).alias("key"))
    each = each.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key")))
    rare = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("all"), F.first("gone").alias("gone"))
    first = F.filter(F.slice("all", F.lit(1), F.col("gone") + 1), lambda x: x["n"] > 1)
    rare = rare.select("id", F.transform(first, lambda x: x["key"]).alias("keys"))
    poor = held.select("id", "size", (F.size("two") <= F.col("gone")).alias("poor")).join(rare.hint("shuffle_hash"), "id")
    return poor.join(bits.hint("shuffle_hash"), "id")


def _rest_pairs(mixed: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """Pairs of lines whose lengths and parities allow the similarity, among the classes outside the largest component
    of a bucket and all classes of others. No text is copied. Where ``marks`` has keys, pairs meet at their least
    common one only."""
    rows = mixed.join(marks.hint("shuffle_hash"), "id")
    own = tuple(marks.drop("id").columns) + ("component", "outside")
    parities = [[g for g in own if g in names] for names in (("g0", "g1"), [f"p{g}" for g in range(8)])]
    # Lines whose lengths allow the similarity are in the same or neighbouring bands of length.
    band = F.floor(F.log(F.col("words")) / F.lit(-math.log(min(similarity, 1 - 1 / LEAST_WORDS) - 0.001))).cast("int")
    rows = rows.withColumn("outside", F.col("component") != F.col("main")).withColumn("band", band)
    parts = mixed.withColumn("band", band).groupBy("key", "band").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts")).hint("shuffle_hash")
    one = rows.filter("outside").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).join(parts, ["key", "band"])
    one = one.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    two = rows.join(parts, ["key", "band"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    named = lambda f, side: _side(f, side, "band", "part", *[F.col(c).alias(f"{c}_{side}") for c in own])
    longer = allowed(F.greatest("words_a", "words_b"), similarity)
    turned = [sum((F.bit_count(F.col(f"{g}_a").bitwiseXOR(F.col(f"{g}_b"))) for g in names), F.lit(0)) for names in parities]
    least = F.array_min(F.array_intersect("keys_a", "keys_b")) == F.col("key") if "keys" in own else F.lit(True)
    both = named(one, "a").join(named(two, "b"), ["key", "band", "part"]).filter(
        (F.col("component_a") != F.col("component_b")) & (~F.col("outside_b") | (F.col("id_a") < F.col("id_b")))
        & _plausible(similarity) & (turned[0] <= 2 * longer) & (turned[1] <= 2 * longer) & least
    )
    return _pair(both)


#: Bits of the table that says which line classes are needed; its size, 4 MB, does not depend on the data.
NEEDED_BITS = 25


def _texts(sketches: DataFrame, ids: DataFrame, ws: Workspace) -> DataFrame:
    """(id, words, by_letter, plain) of each class of ``ids``. A bit table sorts most other lines out before the exchange."""
    ids = ws.keep(ids, "needed")
    spread = F.shiftrightunsigned(F.xxhash64("id"), 64 - NEEDED_BITS)
    words = ids.groupBy(F.shiftright(spread, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(id), {64 - NEEDED_BITS}) & 63 as int))")).alias("bits"))
    every = ids.sparkSession.range(1 << (NEEDED_BITS - 6)).withColumnRenamed("id", "at")
    dense = every.join(words, "at", "left").select("at", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    table = ws.keep(dense.agg(F.array_sort(F.collect_list(F.struct("at", "bits"))).alias("x")).select(F.col("x.bits").alias("bits")), "bits")
    held = sketches.select("id", "words", "by_letter", "plain").filter("words is not null").join(F.broadcast(table))  # one row of fixed size
    bit = F.expr(f"shiftrightunsigned(bits[cast(shiftright(shiftrightunsigned(xxhash64(id), {64 - NEEDED_BITS}), 6) as int)], cast(shiftrightunsigned(xxhash64(id), {64 - NEEDED_BITS}) & 63 as int)) & 1")
    return held.filter(bit == 1).drop("bits").join(ids.hint("shuffle_hash"), "id").dropDuplicates(["id"])


def letters(words: Column) -> Column:
    """A line with one letter for each word: the edit distance of letters is at most that of words, and the same
    where no two different words of the lines share one of the 983,040 letters."""
    code = F.transform(words, lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(w), F.lit(0xF0000)) + 0x10000), 8, "0"))
    return F.decode(F.unhex(F.array_join(code, "")), "UTF-32")


def _parities(held: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(id, words, names): 64 bits each, of which each word of the arrays t turns one, if its hash names one of these:
    an edit turns at most two in all."""
    h = F.col("h")
    at = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))
    bits = [F.when(F.shiftrightunsigned(h, 6).bitwiseAND(len(names) - 1) == g, at).otherwise(F.lit(0).cast("long")) for g in range(len(names))]
    each = held.select("id", F.explode("t").alias("word")).select("id", F.xxhash64("word").alias("h"))
    return each.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("words"), *[F.bit_xor(b).alias(n) for b, n in zip(bits, names)])


def _close(pairs: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose lines' lengths and parities allow the similarity, found without their texts."""
    of = lambda side: marks.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("words", "g0", "g1")]).hint("shuffle_hash")
    longer = allowed(F.greatest("words_a", "words_b"), similarity)
    turned = sum((F.bit_count(F.col(f"{g}_a").bitwiseXOR(F.col(f"{g}_b"))) for g in ("g0", "g1")), F.lit(0))
    return pairs.join(of("a"), "a").join(of("b"), "b").filter(_plausible(similarity) & (turned <= 2 * longer)).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float, ws: Workspace) -> DataFrame:
    """The pairs whose lines have the edit similarity over words."""
    pairs = ws.keep(pairs, "close")
    of = lambda side, name: texts.select(F.col("id").alias(side), F.col("plain").alias(name), F.col("by_letter").alias(f"{name}l"))
    both = of("a", "x").join(pairs.hint("shuffle_hash"), "a")
    both = of("b", "y").join(both.hint("shuffle_hash"), "b")
    # A number that no filter passes, and that a filter reads, so that nothing is worked out twice.
    both = both.select("a", "b", *[words_of(F.col(c), F.col(f"{c}l")).alias(c) for c in ("x", "y")], F.monotonically_increasing_id().alias("row"))
    both = both.select("a", "b", "x", "y", "row", allowed(F.greatest(F.size("x"), F.size("y")), similarity).alias("allowed"), letters(F.col("x")).alias("xz"), letters(F.col("y")).alias("yz"))
    close = both.filter("row >= 0").filter(F.expr("levenshtein(xz, yz, allowed)") >= 0)
    # Where two words share a letter the words' places in the pair's own list are letters: no two share one.
    own = F.array_distinct(F.concat("x", "y"))
    told = F.size(own) == F.size(F.array_distinct(F.split(F.concat("xz", "yz"), "")))
    place = lambda words: F.decode(F.unhex(F.array_join(F.transform(words, lambda w: F.lpad(F.hex(F.array_position(own, w) + 0x10000), 8, "0")), "")), "UTF-32")
    exact = F.when(told, F.lit(0)).otherwise(F.levenshtein(place(F.col("x")), place(F.col("y"))))
    return close.filter(exact <= F.col("allowed")).select("a", "b")


def line_groups(sketches: DataFrame, ws: Workspace, similarity: float) -> DataFrame:
    """(node, component) of the line classes that are linked to another."""
    two, members = _members(sketches, ws)
    ws.release()
    pairs = ws.keep(_first_pairs(members).unionByName(two).distinct(), "pairs")
    # The texts of all classes that share a bucket are taken once, for all rounds.
    needed = members.select("id").unionByName(two.select(F.explode(F.array("a", "b")).alias("id"))).distinct()
    texts = Workspace(sketches.sparkSession, "line_texts").keep(_texts(sketches, needed, ws), "texts")
    ws.drop(sketches)
    marks = ws.keep(_parities(texts.select("id", words_of(F.col("plain"), F.col("by_letter")).alias("t")), ("g0", "g1")), "marks")
    links = ws.keep(_verified(_close(pairs, marks, similarity), texts, similarity, ws), "links")
    ws.drop(pairs)
    ws.release()
    groups = ws.keep(connected(links, ws), "groups")
    # Once more with pivots among the classes outside the largest component, so that few are left for all pairs.
    mixed = _mixed(members, groups, ws)
    ws.drop(members)
    again = _close(_first_pairs(_with_pivots(mixed.filter("component != main"))), marks, similarity)
    links = ws.keep(links.unionByName(_verified(again, texts, similarity, ws)), "links")
    groups = ws.keep(connected(links, ws), "groups")
    mixed = _mixed(mixed, groups, ws)
    crowded = mixed.filter(F.col("rows") > CROWDED)
    marks = marks.drop("words")
    if crowded.limit(1).count():
        finer = ws.keep(_finer(crowded, texts, similarity, ws), "finer")
        keyed = ws.keep(finer.select(F.explode("keys").alias("key"), "id", "words", "size"), "finer_keys")
        kinds = ws.keep(marks.join(finer.drop("size", "poor").hint("shuffle_hash"), "id"), "kinds")
        links = ws.keep(links.unionByName(_verified(_close(_first_pairs(_with_pivots(keyed)), kinds, similarity), texts, similarity, ws)), "links")
        groups = ws.keep(connected(links, ws), "groups")
        # By their old keys the classes of crowded buckets meet only where both have too few pairs of words.
        few = crowded.join(finer.filter("poor").select("id").hint("shuffle_hash"), "id", "left_semi")
        old = mixed.filter(F.col("rows") <= CROWDED).unionByName(few).select(*keyed.columns)
        fine = _rest_pairs(_mixed(keyed, groups, ws), kinds.drop("words"), similarity)
        rest = ws.keep(_rest_pairs(_mixed(old, groups, ws), marks, similarity).unionByName(fine).distinct(), "rest")
    else:
        rest = ws.keep(_rest_pairs(mixed, marks, similarity), "rest")
    more = ws.keep(_verified(rest, texts, similarity, ws), "more")
    if more.limit(1).count():
        groups = ws.keep(connected(links.unionByName(more), ws), "groups")
    return groups


#: Parts in which the classes of one component meet its first occurrence.
SALTS = 16


def _cuts(docs: DataFrame, ws: Workspace, similarity: float) -> DataFrame:
    """(row, line_no) of the lines to cut."""
    sketches = Workspace(docs.sparkSession, "line_sketches").keep(_sketches(_lines(docs), similarity), "sketches")
    placed = ws.keep(sketches.select("doc_id", "row", "line_no", "id"), "lines")
    place = F.struct("doc_id", "row", "line_no")
    classes = ws.keep(placed.groupBy("id").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    groups = line_groups(sketches, ws, similarity).withColumnRenamed("node", "id")
    members = ws.keep(classes.select("id", "first").join(groups.hint("shuffle_hash"), "id"), "grouped")
    firsts = members.groupBy("component").agg(F.min("first").alias("first"))
    salted = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    of_groups = members.drop("first").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(
        salted.hint("shuffle_hash"), ["component", "salt"]
    ).select("id", "first")
    of_copies = classes.filter("n > 1").join(groups.hint("shuffle_hash"), "id", "left_anti").select("id", "first")
    keep = ws.keep(of_groups.unionByName(of_copies), "firsts")
    return placed.join(keep.hint("shuffle_hash"), "id").filter(place != F.col("first")).select("row", "line_no")


def dedup_lines(docs: DataFrame, similarity: float = 0.95) -> DataFrame:
    """The documents with repeated lines cut: all columns, and n_lines_cut.

    ``n_chars``, where it is a column, follows the new text. ``similarity`` is the least edit similarity over words
    of linked lines, where it allows more than one edit.
    """
    # Hashes and counts hardly shrink beyond the dictionaries of the columns.
    ws = Workspace(docs.sparkSession, "lines", codec="uncompressed")
    several = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count()
    if several:  # rows that share an id are told apart by a number that is written with them
        rows = Workspace(docs.sparkSession, "rows").keep(docs.withColumn(_ROW, F.monotonically_increasing_id()), "rows")
    else:
        rows = docs.withColumn(_ROW, F.col("doc_id").cast("long"))
    word = F.floor(F.col("line_no") / 32)
    bits = F.expr("bit_or(shiftleft(1L, line_no % 32))")
    cut = _cuts(rows, ws, similarity).groupBy("row", word.alias("word")).agg(bits.alias("bits"))
    # One array element for each 32 lines of a document up to its last cut one, found by position.
    marks = F.map_from_entries(F.collect_list(F.struct("word", "bits")))
    per_row = (
        cut.groupBy("row")
        .agg(marks.alias("__marks"), F.max("word").alias("__last"), F.sum(F.bit_count("bits")).alias("__ballotbook_cut"))
        .select(
            F.col("row").alias("__ballotbook_id"),
            F.transform(
                F.sequence(F.lit(0).cast("long"), F.col("__last")),
                lambda w: F.coalesce(F.try_element_at(F.col("__marks"), w), F.lit(0).cast("long")),
            ).alias("__ballotbook_bits"),
            "__ballotbook_cut",
        )
    )
    kept = F.filter(
        F.split(F.col("text").cast("string"), "\n"),
        lambda line, i: F.call_function(
            "shiftright", F.coalesce(F.get(F.col("__ballotbook_bits"), F.floor(i / 32).cast("int")), F.lit(0).cast("long")), i % 32
        ).bitwiseAND(F.lit(1).cast("long")) == 0,
    )
    unchanged = F.col("__ballotbook_bits").isNull()
    # Hinted, so that every size takes the plan that large inputs need. Rows without id have no number to join on.
    own = F.when(F.col("doc_id").isNotNull(), F.col(_ROW))
    out = rows.join(per_row.hint("shuffle_hash"), own == F.col("__ballotbook_id"), "left").withColumn(
        "text", F.when(unchanged, F.col("text").cast("string")).otherwise(F.array_join(kept, "\n"))
    )
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(unchanged, F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    count = [] if "n_lines_cut" in docs.columns else [F.coalesce("__ballotbook_cut", F.lit(0)).cast("long").alias("n_lines_cut")]
    return out.select(*docs.columns, *count)
