"""Text folding, unknown values and number parsing, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters whose marks are stripped, and what they become. Letters with a stroke
# (l, d) and sharp s are not composed of a letter and a mark; each fold treats them its own way.
MARKED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"

# How an unknown value is written, after folding, in four languages.
UNKNOWN = (
    r"^(nie\s+ustalono|nieokreslon[ay]?|brak|do\s+potwierdzenia|not\s+determined|undetermined|unknown|to\s+be\s+confirmed"
    r"|nicht\s+bestimmt|unbekannt|zu\s+bestatigen|non\s+determinee?|inconnue?|a\s+confirmer)?$"
)


def strip_marks(text: Column) -> Column:
    """Lower case, without marks; strokes stay."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def fold(text: Column) -> Column:
    """Full fold: ł, đ and ß spelled out, other characters between words become one blank."""
    plain = F.replace(F.translate(strip_marks(text), "łđ", "ld"), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def fold_plain(text: Column) -> Column:
    """As fold(), but special letters count as blanks."""
    return F.trim(F.regexp_replace(strip_marks(text), "[^a-z0-9]+", " "))


def fold_l(text: Column) -> Column:
    """As fold_plain(), but ł is l."""
    return F.trim(F.regexp_replace(F.translate(strip_marks(text), "ł", "l"), "[^a-z0-9]+", " "))


def comparable(text: Column) -> Column:
    """Trimmed, lower case, without marks; punctuation and ł stay."""
    return strip_marks(F.trim(F.coalesce(text, F.lit(""))))


def minimal(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def is_unknown(text: Column) -> Column:
    return F.coalesce(F.translate(strip_marks(F.trim(text)), "ł", "l"), F.lit("")).rlike(UNKNOWN)


def known(text: Column) -> Column:
    """The text, or null where it stands for an unknown value: then = and <> are three-valued."""
    return F.when(~is_unknown(text), text)


def number(text: Column) -> Column:
    """A number whose first comma is a decimal point; null if it is none."""
    return F.regexp_replace(F.trim(text), "^([^,]*),", "$1.").try_cast("double")


def year_of(text: Column) -> Column:
    """The first year from 900 to 2099 in the text."""
    return F.regexp_extract(text, r"\b(9\d{2}|1\d{3}|20\d{2})\b", 1).try_cast("int")


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def key_of(*parts: Column) -> Column:
    """Parts joined by bars; null counts as empty, so the number of parts is always the same."""
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
