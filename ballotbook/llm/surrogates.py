"""Keyed, type-consistent surrogates for personal data.

Entities: e-mail addresses, telephone numbers, payment cards, social security numbers, IBANs, IPv4 addresses,
secrets (long hex strings and quoted values of token-like names) and names after a form of address or introduction. Each mention
has a canonical form (case, separators and spaces apart); a keyed stream (HMAC-SHA256 of key, kind, canonical form
and attempt) draws a replacement of the same shape: letters stay letters of their script and case, digits
digits, separators and country codes stay; card and IBAN check digits stay right (or wrong), IP addresses
keep their class, given names keep the gender that the form of address says. One canonical form has one
replacement in the whole corpus, so mentions stay coreferent in whatever format; a name that a form of address
introduced is also replaced where the same text uses it alone.

Distinctness is checked over the corpus: the distinct entities are drawn at attempt 0, and those whose
replacement equals another's or a real entity draw again until none does. Only the redrawn ones need a table;
it is sent to the tasks when it is small and joined per text otherwise.

Letters of other scripts in a secret become others of their kind; a secret of symbols only, such as a mask, and
one whose first two draws were taken, has its symbols drawn too, so a free replacement is found for each.

A name counts as one where a form of address or an introduction (``INTRODUCTIONS``) stands before it, and then wherever
the text has it. Names that nothing introduces stay.

Null texts stay null. Very long texts are read whole. Ties: of entities that draw one replacement the first by kind
and form keeps it. Rows without id are replaced too, as redrawn entities are joined by text.
Repeated rows are each replaced. An empty table stays empty. Other columns pass through.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .workspace import Workspace

# Forms of address by gender.
ADDRESSES = {
    "m": ["Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "господин", "г-н", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "госпожа", "г-жа", "Κυρία"],
    "n": ["Dr", "Prof"],
}
# Words by which people give their names.
INTRODUCTIONS = [
    "my name is", "my name's", "mein Name ist", "ich heiße", "je m'appelle", "je m’appelle", "mon nom est", "me llamo", "mi nombre es",
    "меня зовут", "με λένε", "ονομάζομαι",
]
_GENDER = {a.lower(): g for g, names in (ADDRESSES | {"n": ADDRESSES["n"] + INTRODUCTIONS}).items() for a in names}
# Letters that a drawn name is made of, by script, and its endings by gender.
SYLLABLES = {
    "latin": ("bdfgklmnprstvz", "aeiou", {"m": "or en us ian", "f": "a ia ina elle", "n": "er an son ey"}),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", {"m": "ов ин ей ан", "f": "ова ина ея ана", "n": "енко ко ич ук"}),
    "greek": ("βγδζκλμνπρστ", "αεηιο", {"m": "ος ης ας ων", "f": "α η ια ινα", "n": "ου ίδης άκης έας"}),
}
_NAME = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ'’-]+|[А-ЯЁ][а-яё-]+|[Α-ΩΆ-Ώ][α-ωά-ώ-]+"
NAMES = re.compile(
    r"(?<!\w)((?i:" + "|".join(sorted((re.escape(a) for a in _GENDER), key=len, reverse=True))
    + r"))\.?[  ]((?:" + _NAME + r")(?: (?:" + _NAME + r")){0,2})"
)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
MARKS = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9](?:[\w.+-]*[\w+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,})"
    r"|(?P<named>(?i:token|secret|password|passwd|api[_-]?key)\s*[=:]\s*[\"'](?P<value>[^\s\"']{8,})[\"'])"
    r"|(?P<secret>(?<![0-9A-Za-z])(?=[a-fA-F]*\d)[0-9a-fA-F]{32,}(?![0-9A-Za-z]))"
    r"|(?P<iban>(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z]))"
    rf"|(?P<ip>(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\d]|\.\d))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)"
    r"|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-]))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d]))"
)
_MARKED = ((np.arange(256) >= 0x30) & (np.arange(256) <= 0x39)) | (np.arange(256) == ord("@")) | np.isin(
    np.arange(256), [ord("="), ord(":")]
)


@dataclass(frozen=True)
class Mention:
    start: int
    end: int
    kind: str
    canonical: str


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def ip_class(octets: list[int]) -> str:
    a, b = octets[:2]
    if a == 10 or (a == 172 and 16 <= b < 32) or (a == 192 and b == 168):
        return "private"
    return "loopback" if a == 127 else "null" if a == 0 else "high" if a >= 224 else "public"


def script(word: str) -> str:
    c = ord(word[0])
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 else "latin"


def mentions(text: str, marked: bool = True) -> list[Mention]:
    """The entities of a text, in order and apart from each other. ``marked``: it has digits or marks."""
    found: list[Mention] = []
    if marked:
        for m in MARKS.finditer(text):
            kind, raw = m.lastgroup, m.group()
            start, end = m.span()
            if m.group("named"):
                kind, raw = "secret", m.group("value")
                start, end = m.span("value")
            if kind == "email":
                canonical = raw.lower()
            elif kind == "secret":
                canonical = raw
            elif kind == "ip":
                canonical = ".".join(str(int(o)) for o in raw.split("."))
            elif kind == "iban":
                canonical = raw.replace(" ", "")
                if iban_rest(canonical) != 1:
                    continue
            else:
                canonical = re.sub(r"[^\d+]", "", raw)
                if kind == "phone" and not 8 <= sum(c.isdigit() for c in canonical) <= 15:
                    continue
                if kind == "phone" and not canonical.startswith("+"):  # three, three and four digits
                    canonical = "+1" + canonical
            found.append(Mention(start, end, kind, canonical))
    people: dict[str, str] = {}
    for m in NAMES.finditer(text):
        parts, gender = m.group(2).split(" "), _GENDER[m.group(1).lower()]
        at = m.start(2)
        for k, p in enumerate(parts):
            given = k < len(parts) - 1
            kind = f"given-{gender}" if given else f"family-{gender}" if script(p) != "latin" else "family-n"
            people.setdefault(p, kind)
            found.append(Mention(at, at + len(p), people[p], p.lower()))
            at += len(p) + 1
    if people:
        alone = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(people, key=len, reverse=True))) + r")(?!\w)")
        found += [Mention(*m.span(), people[m.group()], m.group().lower()) for m in alone.finditer(text)]
    out: list[Mention] = []
    for m in sorted(found, key=lambda m: (m.start, -m.end)):
        if not out or m.start >= out[-1].end:
            out.append(m)
    return out


class Stream:
    """Keyed choices for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, canonical: str, attempt: int):
        self.seed = hmac.new(key, f"{kind}\0{canonical}\0{attempt}".encode(), hashlib.sha256).digest()
        self.pool, self.n = int.from_bytes(self.seed), 0

    def below(self, n: int) -> int:
        if self.pool < n << 64:
            self.n += 1
            more = hashlib.sha256(self.seed + self.n.to_bytes(4)).digest()
            self.pool = (self.pool << 256) | int.from_bytes(more)
        self.pool, out = divmod(self.pool, n)
        return out

    def shape(self, text: str) -> str:
        return "".join(
            "0123456789"[self.below(10)] if c.isdigit()
            else "abcdefghijklmnopqrstuvwxyz"[self.below(26)] if "a" <= c <= "z"
            else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[self.below(26)] if "A" <= c <= "Z"
            else c
            for c in text
        )


SYMBOLS = "!#$%&*+-=?@^_~"


@lru_cache(4096)
def alike(c: str) -> str:
    """The characters of a letter's, mark's or number's category in its 128 code points."""
    start = ord(c) & ~0x7F
    return "".join(x for x in map(chr, range(start, start + 128)) if unicodedata.category(x) == unicodedata.category(c))


def secret_shape(s: Stream, text: str, attempt: int) -> str:
    """A secret's replacement; symbols are drawn where nothing else is, and from the third attempt."""
    symbols = attempt >= 2 or not any(unicodedata.category(c)[0] in "LMN" for c in text)
    out = []
    for c in s.shape(text):
        if not c.isascii() and unicodedata.category(c)[0] in "LMN":
            own = alike(c)
            c = own[s.below(len(own))]
        elif symbols and not (c.isascii() and c.isalnum()):
            c = SYMBOLS[s.below(len(SYMBOLS))]
        out.append(c)
    return "".join(out)


def draw(key: bytes, kind: str, canonical: str, attempt: int = 0) -> str:
    """The replacement of a canonical form."""
    s = Stream(key, kind, canonical, attempt)
    if kind == "email":
        local, _, domain = canonical.partition("@")
        return s.shape(local + "x" * (attempt // 8)) + "@" + draw(key, "domain", domain)
    if kind == "domain":  # one replacement for all addresses of a domain
        labels = canonical.split(".")
        more = "x" * (attempt // 8)
        return ".".join(x if k >= len(labels) - 1 or x == "example" else s.shape(x + more) for k, x in enumerate(labels))
    if kind == "secret":
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", canonical):
            hexes = "0123456789ABCDEF" if canonical.upper() == canonical else "0123456789abcdef"
            return "".join(hexes[s.below(16)] for _ in canonical)
        return secret_shape(s, canonical, attempt)
    if kind == "ip":
        own = [int(o) for o in canonical.split(".")]
        while True:
            o = [s.below(256) for _ in range(4)]
            if ip_class(own) == "private":
                o = {10: [10, *o[1:]], 172: [172, 16 + o[1] % 16, *o[2:]], 192: [192, 168, *o[2:]]}[own[0]]
            elif ip_class(own) in ("loopback", "null"):
                o = [own[0], *o[1:]]
            if ip_class(o) == ip_class(own):
                return ".".join(map(str, o))
    if kind == "iban":
        body = canonical[4:]
        drawn = s.shape(body)
        return canonical[:2] + f"{98 - iban_rest(canonical[:2] + '00' + drawn):02d}" + drawn
    if kind == "card":
        valid = luhn(canonical)
        while True:
            out = canonical[0] + s.shape(canonical[1:])
            if valid:
                out = next(out[:-1] + d for d in "0123456789" if luhn(out[:-1] + d))
            if luhn(out) == valid:
                return out
    if kind == "phone":
        fixed = 0
        if canonical.startswith("+"):
            fixed = 2 if canonical[1] in "17" else 3
        rest = s.shape(canonical[fixed:])
        return canonical[:fixed] + ("123456789"[s.below(9)] if rest[0] == "0" and canonical[fixed] != "0" else rest[0]) + rest[1:]
    if kind == "ssn":
        return s.shape(canonical)
    consonants, vowels, endings = SYLLABLES[script(canonical)]
    ends = endings[kind[-1]].split()
    n = max(1, min(4, len(canonical) // 3)) + attempt // 8
    return "".join(consonants[s.below(len(consonants))] + vowels[s.below(len(vowels))] for _ in range(n)) + (
        consonants[s.below(len(consonants))] + ends[s.below(len(ends))]
    )


def render(mention: str, kind: str, surrogate: str) -> str:
    """The surrogate in the mention's format."""
    if kind in ("phone", "card", "ssn", "iban"):
        if kind == "phone" and "+" not in mention:  # the national form of a +1 number
            surrogate = surrogate[2:]
        chars = iter(surrogate)
        return "".join(next(chars, "") if c.isalnum() or c == "+" else c for c in mention)
    if kind == "email":
        return surrogate.upper() if mention.isupper() else surrogate
    if kind.startswith(("given", "family")):
        return surrogate.upper() if mention.isupper() and len(mention) > 1 else surrogate[0].upper() + surrogate[1:]
    return surrogate


def replace(text: str, key: bytes, redrawn: dict[tuple[str, str], str], marked: bool = True) -> tuple[str, int]:
    found = mentions(text, marked)
    if not found:
        return text, 0
    out, at = [], 0
    for m in found:
        new = redrawn.get((m.kind, m.canonical)) or draw(key, m.kind, m.canonical)
        if m.kind == "email" and (site := redrawn.get(("domain", m.canonical.partition("@")[2]))):
            new = new.partition("@")[0] + "@" + site
        out += [text[at : m.start], render(text[m.start : m.end], m.kind, new)]
        at = m.end
    return "".join([*out, text[at:]]), len(found)


def _marked(column) -> np.ndarray:
    """Which texts have a digit or another mark: the others need no look but for names."""
    data, offsets = W.text_bytes(column)
    sums = np.concatenate([[0], np.cumsum(_MARKED[data], dtype=np.int64)])
    return np.diff(sums[offsets]) > 0


def entities(docs: DataFrame, per_document: bool = False) -> DataFrame:
    """Distinct (kind, canonical) of all texts; with ``per_document`` those of each doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, None] = {}
            ids = batch.column(0).to_pylist()
            for doc, text, marked in zip(ids, batch.column(1).to_pylist(), _marked(batch.column(1))):
                if text:
                    for m in mentions(text, bool(marked)):
                        found[(doc if per_document else None, m.kind, m.canonical)] = None
                        if m.kind == "email" and set((site := m.canonical.partition("@")[2]).split(".")[:-1]) != {"example"}:
                            found[(doc if per_document else None, "domain", site)] = None
            rows = list(found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.string()),
                    pa.array([r[2] for r in rows], pa.string()),
                ],
                names=["doc_id", "kind", "canonical"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, kind string, canonical string")
    return out.distinct() if per_document else out.select("kind", "canonical").distinct()


def _drawn(frame: DataFrame, key: bytes, attempt: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, own = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            new = [draw(key, k, c, attempt) for k, c in zip(kinds, own)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(new, pa.string())], names=["kind", "canonical", "surrogate"]
            )

    return frame.select("kind", "canonical").mapInArrow(run, "kind string, canonical string, surrogate string")


def assign(found: DataFrame, key: bytes, ws: Workspace, rounds: int = 64, draws=_drawn) -> DataFrame:
    """Redrawn entities (kind, canonical, surrogate): those whose first draw met another's or a real entity.

    Kinds of one family share a name space: a surrogate is compared within its group of kinds, and a name that
    several forms of address introduce has one replacement, of the first gender among f, m and n; its other kinds
    are in the result too.
    """
    space = F.split("kind", "-").getItem(0)
    several = ws.keep(
        found.groupBy(space.alias("space"), "canonical").agg(F.min("kind").alias("kind"), F.collect_set("kind").alias("kinds")), "kinds"
    )
    found = several.select("kind", "canonical")
    first = None
    real = found.select(space.alias("space"), F.col("canonical").alias("taken"))
    pending, given, redrawn = found, None, []
    for attempt in range(rounds):
        drawn = ws.keep(draws(pending, key, attempt).withColumn("space", space), f"drawn-{attempt}")
        first = drawn if first is None else first
        held = real if given is None else real.unionByName(given)
        free = drawn.join(
            held.withColumnRenamed("taken", "surrogate"), ["space", "surrogate"], "left_anti"
        )
        winners = free.groupBy("space", "surrogate").agg(F.min(F.struct("kind", "canonical")).alias("x"))
        won = ws.keep(winners.select("space", "surrogate", "x.kind", "x.canonical"), f"won-{attempt}")
        if attempt:
            redrawn.append(won.select("kind", "canonical", "surrogate"))
        taken = won.select("space", F.col("surrogate").alias("taken"))
        given = taken if given is None else given.unionByName(taken)
        pending = ws.keep(drawn.join(won, ["kind", "canonical"], "left_anti").select("kind", "canonical"), f"pending-{attempt}")
        if not pending.limit(1).count():
            break
    else:
        raise ValueError("no distinct surrogates found")
    out = found.sparkSession.createDataFrame([], "kind string, canonical string, surrogate string")
    for r in redrawn:
        out = out.unionByName(r)
    out = ws.keep(out, "redrawn")
    others = several.filter(F.size("kinds") > 1)
    again = out.withColumnRenamed("surrogate", "again")
    own = others.join(first.select("kind", "canonical", "surrogate"), ["kind", "canonical"]).join(again, ["kind", "canonical"], "left")
    alike = own.withColumn("other", F.explode("kinds")).filter(F.col("other") != F.col("kind")).select(
        F.col("other").alias("kind"), "canonical", F.coalesce("again", "surrogate").alias("surrogate")
    )
    return out.unionByName(alike)


def replace_personal_data(docs: DataFrame, key: bytes, send_at_most: int = 100_000) -> DataFrame:
    """The documents with surrogates in ``text``: all columns, and n_entities, which is left out where a column of the
    name exists: that passes through."""
    ws = Workspace(docs.sparkSession, "surrogates")
    found = ws.keep(entities(docs), "entities")
    redrawn = ws.keep(assign(found, key, ws), "redrawn")
    columns, count = docs.columns, [] if "n_entities" in docs.columns else ["n_entities"]
    frame = docs.select(*columns)
    few = redrawn.count() <= send_at_most
    table = {(r["kind"], r["canonical"]): r["surrogate"] for r in redrawn.collect()} if few else {}
    sent = docs.sparkSession.sparkContext.broadcast(table)
    if few:
        frame = frame.withColumn("__ballotbook_redrawn", F.lit(None).cast("array<struct<kind:string,canonical:string,surrogate:string>>"))
    else:
        # By text, so that rows without id have theirs; texts that share a hash share a longer table only.
        by_text = F.when(F.col("text").isNotNull(), F.xxhash64(F.col("text").cast("string")))
        own = (
            entities(docs.select(by_text.alias("doc_id"), "text"), per_document=True).join(redrawn, ["kind", "canonical"])
            .groupBy(F.col("doc_id").alias("__ballotbook_id"))
            .agg(F.collect_list(F.struct("kind", "canonical", "surrogate")).alias("__ballotbook_redrawn"))
        )
        frame = frame.join(own, by_text == F.col("__ballotbook_id"), "left").drop("__ballotbook_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            own = batch.column(batch.schema.get_field_index("__ballotbook_redrawn")).to_pylist()
            new, counts = [], []
            for text, marked, more in zip(batch.column(at).to_pylist(), _marked(batch.column(at)), own):
                held = sent.value
                if more:
                    held = {(r["kind"], r["canonical"]): r["surrogate"] for r in more}
                text, n = (text, 0) if text is None else replace(text, key, held, bool(marked))
                new.append(text)
                counts.append(n)
            cols = [c for k, c in enumerate(batch.columns) if batch.schema.names[k] != "__ballotbook_redrawn"]
            cols[at] = pa.array(new, pa.string())
            cols += [pa.array(counts, pa.int32())] if count else []
            yield pa.RecordBatch.from_arrays(cols, names=[*columns, *count])

    frame = frame.withColumn("text", F.col("text").cast("string"))
    schema = ", ".join([f"`{c}` {t}" for c, t in frame.select(*columns).dtypes] + [f"{c} int" for c in count])
    return frame.select(*columns, "__ballotbook_redrawn").mapInArrow(run, schema)
