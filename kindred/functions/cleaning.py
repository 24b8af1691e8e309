"""Text cleaning as a Column expression: NFC, lower case, white space, stop words, length - in this order."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions.stopwords import DEFAULT
from kindred.functions.text import SPACE, ColumnOrName, _c


#: Text without such characters is in NFC already.
WIDE = r"[^\x{0000}-\x{02FF}]"


def nfc_udf():
    def run(s: pa.Array) -> pa.Array:
        import unicodedata

        return pa.array([None if x is None else unicodedata.normalize("NFC", x) for x in s.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")


@dataclass(frozen=True)
class Cleaner:
    """Each with_ method returns a changed copy; apply() builds the expression."""

    normalize_unicode: bool = True
    lowercase: bool = True
    collapse_whitespace: bool = True
    trim: bool = True
    remove_stopwords: bool = False
    stopwords: frozenset[str] = DEFAULT
    max_length: int = 0

    def with_normalize_unicode(self, on: bool = True) -> Cleaner:
        return replace(self, normalize_unicode=on)

    def with_lowercase(self, on: bool = True) -> Cleaner:
        return replace(self, lowercase=on)

    def with_collapse_whitespace(self, on: bool = True) -> Cleaner:
        return replace(self, collapse_whitespace=on)

    def with_trim(self, on: bool = True) -> Cleaner:
        return replace(self, trim=on)

    def with_remove_stopwords(self, on: bool = True) -> Cleaner:
        return replace(self, remove_stopwords=on)

    def with_stopwords(self, words: Iterable[str]) -> Cleaner:
        """Own words instead of the default ones; none at all means the default ones again."""
        return replace(self, stopwords=frozenset(words) or DEFAULT)

    def with_max_length(self, size: int) -> Cleaner:
        """UTF-8 bytes at the end of all steps, cut down to a whole character; 0 for no limit."""
        if size < 0:
            raise ValueError("max_length must not be negative")
        return replace(self, max_length=size)

    def apply(self, text: ColumnOrName) -> Column:
        s = _c(text)
        if self.normalize_unicode:  # text below U+0300 is in NFC already and never reaches Python
            s = F.coalesce(nfc_udf()(F.when(s.rlike(WIDE), s)), s)
        if self.lowercase:
            s = F.lower(s)
        if self.collapse_whitespace:
            s = F.regexp_replace(s, SPACE, " ")
        if self.trim:
            s = F.regexp_replace(s, rf"^{SPACE}|{SPACE}\z", "")
        if self.remove_stopwords:
            listed = F.array(*[F.lit(w) for w in sorted(self.stopwords)])
            s = F.array_join(F.filter(F.split(s, SPACE), lambda x: (x != "") & ~F.array_contains(listed, x)), " ")
        if self.max_length:
            n, raw = self.max_length, s.cast("binary")
            cuts = [F.substring(raw, 1, n - k) for k in range(4) if n - k > 0]
            cut = F.lit("")
            for x in reversed(cuts):
                cut = F.when(F.is_valid_utf8(x), x.cast("string")).otherwise(cut)
            s = F.when(F.octet_length(s) <= n, s).when(s.isNotNull(), cut)
        return s


def clean_text(text: ColumnOrName) -> Column:
    return Cleaner().apply(text)


def clean_text_stopwords(text: ColumnOrName) -> Column:
    return Cleaner(remove_stopwords=True).apply(text)
