"""Sort keys in the order of the alphabet: Cyrillic words before Latin ones, Latin pairs as letters of their own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# The two alphabets in order.
CYRILLIC_ORDER = "абвгғдеёжзийкқлмнопрстуўфхҳцчшъэюя"
LATIN_ORDER = ["a", "b", "ch", "d", "e", "f", "g", "g'", "h", "i", "j", "k", "l", "m", "n", "ng", "o", "o'", "p", "q", "r", "s", "sh", "t", "u", "v", "x", "y", "z"]
LATIN_PAIRS = "ch|g'|ng|o'|sh"


def is_cyrillic_word(word: Column) -> Column:
    """At least as many Cyrillic letters as Latin ones; so is a word without letters."""
    lower = F.lower(word)
    return F.regexp_count(lower, F.lit("[а-яўқғҳё]")) >= F.regexp_count(lower, F.lit("[a-z]"))


def sort_key(word: Column) -> Column:
    """``struct<script, weights>``: sorts as the alphabet does, shorter words first; null words have a null key."""
    lower = F.lower(word)
    cyrillic = F.transform(T.chars(lower), lambda c: F.coalesce(F.nullif(F.position(c, F.lit(CYRILLIC_ORDER)), F.lit(0)), F.ascii(c) + 1000))
    plain = F.translate(lower, T.APOSTROPHES + "`", "'" * 5)
    order = F.array(*map(F.lit, LATIN_ORDER))
    latin = F.transform(F.regexp_extract_all(plain, F.lit(f"(?s){LATIN_PAIRS}|."), F.lit(0)), lambda t: F.coalesce(F.nullif(F.array_position(order, t), F.lit(0).cast("long")).cast("int"), F.ascii(t) + 10000))
    first = is_cyrillic_word(word)
    return F.when(word.isNotNull(), F.struct(F.when(first, 0).otherwise(1).alias("script"), F.when(first, cyrillic).otherwise(latin).alias("weights")))
