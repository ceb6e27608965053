"""Secrets in texts: known forms, and windows of high entropy in strings of one character class.

Known forms are three patterns (:data:`FORMS`). The method adds spans: a candidate is a longest string of characters of a class, and a
window of the class's width slides over it. The counts of the window's characters change by one character in and one out a step, and with
them the sum of ``c * log2(c)``, which gives Shannon's entropy; the sums are integers (parts of ``2**-20``), so that nothing drifts and
ties are exact. Windows at or above the class's entropy are joined where they overlap or touch. Candidates that fit an allow-list (words, paths
of words, plain numbers, runs of the alphabet or of digits, given examples) add nothing, and neither do spans inside one that is listed already.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import floor, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .cluster import packed, unpacked

#: kind: pattern, the group whose length counts, and its least length. Shorter matches are dropped, but what they matched is used up.
FORMS = {
    "assign": (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}

#: Of these words, in lower case, a text with an assign match has one; the pattern is tried on no other.
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api")

#: Parts of a bit.
UNIT = 1 << 20


@dataclass(frozen=True)
class CharacterClass:
    """Strings of ``characters`` (as inside a pattern's brackets, ASCII) and the entropy, in bits, from which a window of ``width`` of them stands out."""

    kind: str
    characters: str
    width: int
    bits: float

    @property
    def most(self) -> int:
        """The largest sum of ``c * log2(c)``, in units, of a window with that entropy."""
        return floor(self.width * (log2(self.width) - self.bits) * UNIT)

    def terms(self) -> list[int]:
        """``c * log2(c)`` in units, for ``c`` from 0."""
        return [0, *(round(c * log2(c) * UNIT) for c in range(1, self.width + 1))]


CLASSES = (CharacterClass("entropy_hex", "0-9A-Fa-f", 16, 2.9), CharacterClass("entropy_text", "A-Za-z0-9+/_-", 20, 3.7))

#: Whole candidates that are no secrets: numbers, words and paths of words, placeholders, the alphabet or digits in order.
ALLOWED = (
    r"[0-9]+",
    r"[A-Za-z]?[a-z]*([/_-]+[A-Za-z]?[a-z]*)*",
    r"[A-Z]+([/_-]+[A-Z]+)*",
    r".*([Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Xx]{6}|[Cc][Hh][Aa][Nn][Gg][Ee]_?[Mm][Ee]).*",
    r".*([Aa][Bb][Cc][Dd][Ee][Ff][Gg][Hh]|0123456789|1234567890).*",
)


def _compiled(form: tuple[str, int, int]):
    pattern, group, least = form
    if group == 0 and re.fullmatch(r"\[[^\]]+\]\+", pattern):
        pattern = f"{pattern[:-1]}{{{least},}}"  # the same matches, without the short ones on the way
    return re.compile(pattern.encode()), group, least


def window_sums(codes: np.ndarray, width: int, terms: np.ndarray) -> np.ndarray:
    """For each window of ``width`` characters the sum of ``terms`` of its counts.

    A character's count when it enters, and when it leaves, is its number of like characters since; the sums add up the changes.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    # like characters lie side by side in order, by position; one comes in after those that the window of the character still holds
    keys = codes[order].astype(np.int64) * (n + 1) + order
    begin = np.maximum(np.arange(n) - width + 1, 0)
    enters = rank - np.searchsorted(keys, codes.astype(np.int64) * (n + 1) + begin) + 1
    last = np.minimum(np.arange(n) + width, n)
    leaves = np.searchsorted(keys, codes.astype(np.int64) * (n + 1) + last) - rank
    # before a character comes in, the one that is width before it goes; if they are alike, the window's counts stay
    gone = np.zeros(n, np.int64)
    gone[width:] = terms[leaves[: n - width] - 1] - terms[leaves[: n - width]]
    come = terms[enters] - terms[enters - 1]
    return np.cumsum(gone + come)[width - 1 :]


def dense_windows(candidate: bytes, kind: CharacterClass) -> list[tuple[int, int]]:
    """Where the windows with the class's entropy lie in a candidate, joined."""
    codes = np.frombuffer(candidate, np.uint8)
    if len(codes) < kind.width:
        return []
    high = np.flatnonzero(window_sums(codes, kind.width, np.array(kind.terms(), np.int64)) <= kind.most)
    if not len(high):
        return []
    cuts = np.flatnonzero(np.diff(high) > kind.width) + 1
    return [(int(part[0]), int(part[-1]) + kind.width) for part in np.split(high, cuts)]


class Scanner:
    """The spans of one text after another."""

    def __init__(self, classes: tuple[CharacterClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED):
        self.kinds = [*FORMS, *(c.kind for c in classes)]
        self.forms = [_compiled(form) for form in FORMS.values()]
        self.classes = [(c, re.compile(f"[{c.characters}]{{{c.width},}}".encode())) for c in classes]
        self.allowed = re.compile("|".join(f"(?:{x})" for x in allowed).encode()) if allowed else None

    def spans(self, text: bytes) -> list[tuple[int, int, int]]:
        """``(start, number of the kind, end)`` in code points, by start and kind."""
        found = []
        lower = text.lower()
        for k, (pattern, group, least) in enumerate(self.forms):
            if self.kinds[k] == "assign" and not any(w in lower for w in ASSIGN_WORDS):
                continue
            found += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
        for k, (kind, pattern) in enumerate(self.classes, len(self.forms)):
            added = []
            for m in pattern.finditer(text):
                if not (self.allowed and self.allowed.fullmatch(m.group())):
                    added += [(m.start() + a, k, m.start() + b) for a, b in dense_windows(m.group(), kind)]
            found += _outside(added, found) if found else added
        if found and not text.isascii():
            points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
            found = [(int(points[a]), k, int(points[b])) for a, k, b in found]
        return sorted(found)


def _outside(added: list[tuple[int, int, int]], found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of ``added`` that lie inside none of ``found``: none that starts at or before them reaches their end."""
    starts = np.array(sorted((a, b) for a, _, b in found), np.int64)
    reach = np.maximum.accumulate(starts[:, 1])
    before = np.searchsorted(starts[:, 0], [x[0] for x in added], "right")
    return [x for x, n in zip(added, before.tolist(), strict=True) if not n or reach[n - 1] < x[2]]


_SPANS = "array<struct<start:long,kind:string,end:long>>"


def find_secrets(docs: DataFrame, *, classes: tuple[CharacterClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """``docs(text)`` with ``spans``, an array of ``(start, kind, end)`` in code points, end excluded, by start and then kind in the order assign, access,
    hex, and those of ``classes``. A span of a known form is its whole match. A column of that name is replaced.

    Null text counts as empty; an empty text has no spans. Each whole text is read, of any length, in one task. Repeated rows have equal results;
    null ids and other columns pass through. Empty table: no rows.
    """
    names = [c for c in docs.columns if c != "spans"]
    rows = packed(docs.withColumn("_whole", F.coalesce(F.col("text").cast("string"), F.lit(""))), "_whole", without=("spans", "_whole"))
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def scan(batches):
        scanner = Scanner(classes, allowed)
        for batch in batches:
            data, offsets = T.utf8(batch.column("_whole"))
            found = [scanner.spans(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            spans = [[{"start": a, "kind": scanner.kinds[k], "end": b} for a, k, b in own] for own in found]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(spans, span_type)], ["row", "spans"])

    schema = rows.select("row").withColumn("spans", F.array().cast(_SPANS)).schema
    return rows.mapInArrow(scan, schema).select(*unpacked(names), "spans")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with ``mark`` in place of each span; spans that overlap share one."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc, span):
        between = F.substring(text, (acc["at"] + 1).cast("int"), (F.greatest(span["start"], acc["at"]) - acc["at"]).cast("int"))
        new = F.concat(acc["out"], between, F.when((span["start"] >= acc["at"]) | (acc["at"] == 0), F.lit(mark)).otherwise(F.lit("")))
        return F.struct(new.alias("out"), F.greatest(acc["at"], span["end"]).alias("at"))

    return F.aggregate(spans, state, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text))))
