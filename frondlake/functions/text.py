"""Text expressions: slugs, derived class names, folded LIKE, report formatting."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters whose full case folding contains a-z but whose
# lower-case form does not.
FOLDED_LETTERS = {
    "ß": "ss", "ŉ": "ʼn", "ſ": "s", "ǰ": "ǰ", "ẖ": "ẖ", "ẗ": "ẗ", "ẘ": "ẘ",
    "ẙ": "ẙ", "ẚ": "aʾ", "ẞ": "ss", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl",
    "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st",
}


def slug(value: Column) -> Column:
    """Case-folded text with every run outside ``[a-z0-9]`` turned into one ``_``.

    Empty text when nothing is left; :func:`checked_slug` makes that an error.
    """
    folded = F.lower(value)
    for letter, letters in FOLDED_LETTERS.items():
        folded = F.replace(folded, F.lit(letter), F.lit(letters))
    return F.btrim(F.regexp_replace(folded, "[^a-z0-9]+", "_"), F.lit("_"))


def checked_slug(value: Column, field: str) -> Column:
    made = slug(value)
    return F.when(
        (made == "") | made.isNull(), F.raise_error(F.lit(f"{field} must contain letters or numbers"))
    ).otherwise(made)


def title_words(name: Column) -> Column:
    """Upper-case each letter that does not follow a letter, lower-case the others."""
    letters = F.split(F.replace(name, F.lit("_"), F.lit(" ")), "")

    def cased(letter: Column, position: Column) -> Column:
        before = F.when(position > 0, F.get(letters, position - 1)).otherwise(F.lit(" "))
        starts = F.lower(before) == F.upper(before)
        return F.when(starts, F.upper(letter)).otherwise(F.lower(letter))

    return F.array_join(F.transform(letters, cased), "")


def class_key(crop: Column, disease: Column) -> Column:
    return F.concat(crop, F.lit("__"), disease)


def class_directory(crop: Column, disease: Column) -> Column:
    return F.concat(crop, F.lit("/"), disease)


def class_display_name(crop: Column, disease: Column) -> Column:
    return F.concat(title_words(crop), F.lit(" "), title_words(disease))


def ascii_fold(value: Column) -> Column:
    """Lower-case A-Z only, as SQLite's LIKE does."""
    return F.translate(value, string.ascii_uppercase, string.ascii_lowercase)


def folded_like(value: Column, pattern: str) -> Column:
    """LIKE with ASCII case folding and no escape character.

    Spark's LIKE always has an escape character, so one is chosen that does
    not occur in the pattern.
    """
    folded = pattern.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    escape = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in folded)
    return F.like(ascii_fold(value), F.lit(folded), F.lit(escape))


def is_healthy(class_key_column: Column) -> Column:
    """The history's category test; ``_`` stays a wildcard, so ``x__unhealthy`` passes."""
    return folded_like(class_key_column, "%__healthy")


def fixed_decimals(value: Column, digits: int) -> Column:
    """Text with ``digits`` decimals, rounded half-even on the exact binary value."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", value.cast("double"), F.lit(pattern))


def rounded(value: Column, digits: int) -> Column:
    """Round the exact binary value half-even (``0.35`` to one digit is ``0.3``)."""
    return fixed_decimals(value, digits).cast("double")


def percent_text(value: Column, total: Column) -> Column:
    return F.when(total <= 0, F.lit("0.00%")).otherwise(
        F.concat(fixed_decimals(value / total * 100, 2), F.lit("%"))
    )


def ratio_text(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator <= 0, F.lit("N/A")).otherwise(
        F.concat(fixed_decimals(numerator / denominator, 2), F.lit(":1"))
    )


def byte_size_text(size: Column) -> Column:
    """Byte count in the largest unit (1024 steps, B to TB) below which it does not fall."""
    units = ["B", "KB", "MB", "GB", "TB"]
    text = None
    for power, unit in enumerate(units):
        shown = F.concat(fixed_decimals(size / float(1024 ** power), 2), F.lit(f" {unit}"))
        fits = size < float(1024 ** (power + 1))
        if unit == units[-1]:
            text = text.otherwise(shown)
        else:
            text = F.when(fits, shown) if text is None else text.when(fits, shown)
    return text


def file_extension(path: Column) -> Column:
    """Lower-cased last suffix of the file name, with its dot; empty when there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def score_band(score: Column) -> Column:
    return (
        F.when(score >= 90, "EXCELLENT").when(score >= 80, "GOOD").when(score >= 70, "FAIR")
        .when(score >= 50, "NEEDS IMPROVEMENT").otherwise("POOR")
    )
