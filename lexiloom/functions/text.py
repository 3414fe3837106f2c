"""Scalar text functions as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

GLYPH = r"(@[0-9]{3};|.)"


def glyphs(word: Column) -> Column:
    """The glyphs of a word: ``@nnn;`` is one, and so is any other character."""
    return F.regexp_extract_all(word, F.lit(GLYPH), F.lit(1))


def glyph_count(word: Column) -> Column:
    return F.size(glyphs(word))


def recoded(word: Column) -> Column:
    """The word with each ``@nnn;`` as one private-use character, U+E000 + nnn, for functions that count characters."""

    def one(g: Column) -> Column:
        n = F.substring(g, 2, 3).cast("int")
        code = F.concat(F.lit("EE"), F.hex(F.lit(128) + F.floor(n / 64)), F.hex(F.lit(128) + n % 64))
        return F.when(F.length(g) == 1, g).otherwise(F.decode(F.unhex(code), "UTF-8"))

    return F.when(word.contains("@"), F.array_join(F.transform(glyphs(word), one), "")).otherwise(word)


def folio_of(page: Column) -> Column:
    """The leaf of a page name: ``f85r2`` is of ``f85``; names of another form are leaves themselves."""
    leaf = F.regexp_extract(page, r"^(f[0-9]+)[rv][0-9]*$", 1)
    return F.when(leaf == "", page).otherwise(leaf)


def strip_vowels(word: Column, keep_initial: bool = False) -> Column:
    if not keep_initial:
        return F.regexp_replace(word, "[aeiou]", "")
    return F.concat(F.substring(word, 1, 1), F.regexp_replace(word.substr(F.lit(2), F.length(word)), "[aeiou]", ""))


def _folds() -> tuple[str, str]:
    """Precomposed Latin letters whose decomposition is an ASCII letter with marks, and that letter."""
    found = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(unicodedata.normalize("NFD", chr(c))) > 1]
    found = [(a, b) for a, b in found if b.isascii()]
    return "".join(a for a, _ in found), "".join(b for _, b in found)


def strip_marks(text: Column) -> Column:
    """Accented Latin letters without their marks, composed or not."""
    return F.regexp_replace(F.translate(text, *_folds()), "[̀-ͯ]", "")
