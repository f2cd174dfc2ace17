"""Visually identical text with different characters: the skeleton of a text under a look-alike table.

A text is decomposed, every character is replaced by the prototype of its look, and the result is
decomposed again; texts with equal skeletons look the same. Widths, kinds of blank, invisible
characters, compatibility ideographs, radicals and look-alike letters of other scripts fall
together; marks on letters, shapes of figures (circled, raised) and letter case don't. Prototypes
come from the public table of confusable characters, less what a reader can tell apart.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .expand import CHUNK, expand_pairs

# Looks that the public table doesn't hold or gives otherwise; the first two of a kind stand for one another.
OWN = {
    "letters": ("ҺԚӏ", "hQl"),
    "katakana": ("ノー", "丿一"),
    "signs": ("〇―─", "○——"),
    "radicals": ("⺁⺄⺆⺊⺕⺜⺝⺩⺪⺰⻆⻗⻣⻦⻧⻪⻱", "厂乙冂卜彐日月王疋纟角雨骨鸟卤黾龜"),
}
#: Fixed value: one sign that stands for a row of others.
ELLIPSIS = (0x2026, "...")
#: Decompositions that change only the width or the form of the code, not the look.
SAME_LOOK = ("<wide>", "<narrow>", "<small>", "<noBreak>")
#: Decompositions into characters that a reader can tell from the composed one by its form.
OTHER_LOOK = ("<font>", "<circle>", "<super>", "<sub>", "<fraction>", "<square>", "<vertical>")
#: Blocks whose characters are other codes of ideographs, and of their strokes.
RADICALS, STROKES = range(0x2E80, 0x2FE0), range(0x31C0, 0x31F0)


def _invisible(c: str) -> bool:
    """Characters that show nothing: format characters, variation selectors, fillers, controls that are no blank."""
    p = ord(c)
    return (
        unicodedata.category(c) in ("Cf", "Cc")
        or p in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)
        or 0x180B <= p <= 0x180F
        or 0xFE00 <= p <= 0xFE0F
        or 0xE0000 <= p <= 0xE0FFF
    )


def _form(c: str) -> str:
    d = unicodedata.decomposition(c)
    return d.split()[0] if d.startswith("<") else ""


def _prototype(c: str, given: str) -> str | None:
    """The public table's prototype of a character, or None where a reader sees a difference.

    The table is made to find deceptive names and folds more than looks: letters, figures and bars
    that are one stroke; m and rn; marks on letters; quotation marks and brackets of all shapes;
    letters in other type; variants of ideographs.
    """
    kind, form = unicodedata.category(c), _form(c)
    of = {unicodedata.category(x)[0] for x in given}
    if c.isascii() or kind[0] in "MCZ" or form in OTHER_LOOK or unicodedata.normalize("NFD", c) != c:
        return None
    name = unicodedata.name(c, "")
    if name.startswith(("CJK UNIFIED", "HANGUL")) or kind in ("Ps", "Pe", "Pi", "Pf"):
        return None
    if kind == "So" and not (ord(c) in RADICALS or ord(c) in STROKES) or kind in ("Sk", "Sc", "No"):
        return None
    if kind == "Nl":
        return unicodedata.normalize("NFKC", c) if form == "<compat>" else None
    if kind in ("Po", "Pd", "Pc", "Sm"):
        if given == "l":
            return "|"
        return given if of <= {"P", "S"} and not set(given) <= set("'") and not any(unicodedata.category(x) in ("So", "Sk") for x in given) else None
    if kind == "Nd":
        return given if of == {"N"} else None
    if not of & {"L", "N"}:
        return None
    if given == "l" and kind in ("Lu", "Lt"):
        return "I"
    return given.replace("rn", "m")


def prototypes(spark: SparkSession) -> dict[int, str]:
    """Characters and the ones they can't be told from, out of the public table of confusable characters that Spark's own ICU library holds.

    The table is read once for a session, in one call; it has a few thousand entries.
    """
    sc = spark.sparkContext
    if not hasattr(sc, "_inkstone_looks"):
        points = [p for p in range(0x21, 0x110000) if unicodedata.category(chr(p)) not in ("Cn", "Co", "Cc", "Cs")]
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        given = checker.getSkeleton("\n".join(map(chr, points))).split("\n")
        table = {}
        for p, g in zip(points, given, strict=True):
            if g != chr(p) and (own := _prototype(chr(p), g)) is not None and own != chr(p):
                table[p] = own
        for likes, looks in OWN.values():
            table |= {ord(a): b for a, b in zip(likes, looks, strict=True)}
        table[ELLIPSIS[0]] = ELLIPSIS[1]
        sc._inkstone_looks = table
    return sc._inkstone_looks


class Look(dict):
    """Translation table that works out a character's prototype when it first appears, and the skeletons made with it."""

    def __init__(self, table: dict[int, str]):
        super().__init__()
        self.table = table

    def __reduce__(self):
        return Look, (self.table,)

    def __missing__(self, p: int) -> str:
        c = chr(p)
        if c.isspace() or c == "\u2800":
            out = " "
        elif _invisible(c):
            out = ""
        else:
            out, form = c, _form(c)
            if form in SAME_LOOK or form == "<compat>" and p in RADICALS:
                out = "".join(self[ord(x)] if ord(x) != p else x for x in unicodedata.normalize("NFKD" if form != "<noBreak>" else "NFKC", c))
            elif p in self.table:
                self[p] = c  # should a prototype lead back here
                out = "".join(self[ord(x)] for x in unicodedata.normalize("NFD", self.table[p]))
        self[p] = out
        return out

    def skeleton(self, text: str) -> str:
        """The consistent spelling of one text: equal for texts that look the same, without blanks at its ends."""
        if text.isascii() and text.isprintable():
            return text.strip()
        d = unicodedata.normalize("NFD", text.replace("\r\n", "\n")).translate(self)
        return unicodedata.normalize("NFD", d).strip(" ")

    def readable(self, text: str) -> str:
        """The skeleton in composed form."""
        return unicodedata.normalize("NFC", self.skeleton(text))

    def record(self, elements: list[str | None]) -> tuple[bytes | None, bytes]:
        """Digest of a record's look (None if nothing can be seen) and of its elements as delivered."""
        bones = [self.skeleton(e) if e else "" for e in elements]
        return (_digest(bones, "") if any(bones) else None), _digest(elements, "\x1e")


def _digest(parts: list[str | None], missing: str) -> bytes:
    return hashlib.blake2b("\x1f".join(missing if p is None else p for p in parts).encode(), digest_size=16).digest()


def _looks(look: Look):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [look.record(p) for p in b.column("paragraphs").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("rec_id"), pa.array([x for x, _ in both], pa.binary()), pa.array([y for _, y in both], pa.binary())], names=["rec_id", "look", "spelling"])

    return run


def record_looks(df: DataFrame) -> DataFrame:
    """rec_id, look, spelling (digests) of every record with visible text, once."""
    rows = df.where("rec_id is not null and size(paragraphs) > 0").select("rec_id", "paragraphs")
    return rows.mapInArrow(_looks(Look(prototypes(df.sparkSession))), "rec_id long, look binary, spelling binary").where("look is not null").dropDuplicates(["rec_id"])


def same_look_pairs(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """rec_a < rec_b: records whose paragraphs look the same but aren't equal as delivered.

    Records meet through the skeletons, which are worked out once: spellings of one look are paired,
    then each spelling's records are put in, chunk by chunk, so that copies of one spelling are never
    compared and a frequent spelling is spread. Null and empty paragraphs, and those without visible
    text, are left out; a null element looks like an empty one but isn't equal to it. Repeated rows
    count once; other columns are ignored.
    """
    records = cut(record_looks(df))
    several = records.groupBy("look").agg(F.min("spelling").alias("least"), F.max("spelling").alias("most")).where("least <> most").select("look")
    held = records.join(several, "look", "left_semi")
    spellings = held.select("look", "spelling").distinct()
    pairs = spellings.withColumnRenamed("spelling", "a").join(spellings.withColumnRenamed("spelling", "b"), "look").where("a < b").select("a", "b")
    return expand_pairs(pairs, held.select("rec_id", F.col("spelling").alias("group")), chunk)


def _spell(look: Look):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column("paragraphs").to_pylist()
            spelt = [[None if e is None else look.readable(e) for e in p] for p in rows]
            digests = [look.record(p)[0] for p in rows]
            yield pa.RecordBatch.from_arrays([b.column("rec_id"), pa.array(spelt, pa.list_(pa.string())), pa.array([x and x.hex() for x in digests], pa.string())], names=["rec_id", "spelling", "look"])

    return run


def consistent_spelling(df: DataFrame) -> DataFrame:
    """rec_id, spelling (paragraphs in one consistent form), look (equal for records that look the same) of each record once.

    Records without paragraphs are left out; look is null where nothing can be seen.
    """
    rows = df.where("rec_id is not null and paragraphs is not null").select("rec_id", "paragraphs")
    return rows.mapInArrow(_spell(Look(prototypes(df.sparkSession))), "rec_id long, spelling array<string>, look string").dropDuplicates(["rec_id"])
