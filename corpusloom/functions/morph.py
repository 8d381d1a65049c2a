"""Morphology: suffixes are stripped one of each order, from the outermost order in, as chained expressions."""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import data
from . import text as T
from . import translit

# Consonants that harden a suffix, vowels, and letters that soften before a possessive.
VOICELESS, VOWELS = "кқптсшчфҳхц", "аеёиоуўэюя"
SOFTENED = {"к": "г", "қ": "ғ"}
PLURALS = ("PL", "AGR_LAR")


def suffix_groups(suffixes: list[tuple] | None = None) -> list[list[tuple]]:
    """Groups of an order, the outermost first; within a group the longest first, else as listed."""
    rows = sorted((s for s in suffixes or data.SUFFIXES if s[0] and s[1]), key=lambda s: (-s[5], -len(s[1])))
    return [list(g) for _, g in groupby(rows, key=lambda s: s[5])]


def strip_suffixes(word: Column, suffixes: list[tuple] | None = None) -> Column:
    """``struct<root, ids, forms>`` of a Cyrillic word; ids and forms from the root out.

    A suffix goes if the word has three letters or more and two are left.
    """
    none = F.array().cast("array<string>")
    state = F.struct(word.alias("root"), none.alias("ids"), none.alias("forms"))
    for group in suffix_groups(suffixes):
        state = T.let(state, _strip_one(group))
    return state


def _strip_one(group: list[tuple]) -> Callable[[Column], Column]:
    """Strips the first of a group's suffixes that fits, from a state."""

    def strip(s: Column) -> Column:
        out, n = None, F.char_length(s["root"])
        for sid, form, *_ in group:
            k = len(form)
            fits = (n >= max(3, k + 2)) & s["root"].endswith(F.lit(form))
            stripped = F.struct(F.left(s["root"], n - k).alias("root"), F.array_prepend(s["ids"], F.lit(sid)).alias("ids"), F.array_prepend(s["forms"], F.lit(form)).alias("forms"))
            out = F.when(fits, stripped) if out is None else out.when(fits, stripped)
        return out.otherwise(F.struct(s["root"].alias("root"), s["ids"].alias("ids"), s["forms"].alias("forms")))

    return strip


def attached_to(kind: str, suffixes: list[tuple] | None = None) -> list[str]:
    return [s[0] for s in suffixes or data.SUFFIXES if kind in s[4]]


def part_of_speech(ids: Column) -> Column:
    """A verb if any suffix is one of verbs, else a noun if any is one of nouns, else unknown."""
    has = lambda names: F.arrays_overlap(ids, F.array(*map(F.lit, names)))
    return F.when(has(attached_to("verb")), "verb").when(has(attached_to("noun")), "noun").otherwise("unknown")


def analyze(words: DataFrame, lexicon: DataFrame, word: str = "normalized") -> DataFrame:
    """Distinct ``words`` with ``script, cyrillic, root, suffix_ids, suffixes, is_known_root, part_of_speech``.

    A word in the lexicon (``word``, of either script) is its own root. Roots are looked up as they are and with a
    softened last letter hardened. Look-ups are left joins, which Spark broadcasts if the lexicon is small.
    """
    w = words.select(F.col(word).alias("word")).distinct().withColumn("script", T.detect_script(F.col("word")))
    w = w.withColumn("cyrillic", F.when(F.col("script") == "Latin", T.normalize_word(translit.to_cyrillic(F.col("word")))).otherwise(F.col("word")))
    w = w.withColumn("_s", strip_suffixes(F.col("cyrillic")))
    hard = F.translate(F.right("_s.root", F.lit(1)), "".join(SOFTENED.values()), "".join(SOFTENED))
    w = w.withColumn("_hard", F.concat(F.left(F.col("_s.root"), F.char_length("_s.root") - 1), hard))
    known = lexicon.select(F.col("word").alias("_k")).distinct().withColumn("_in", F.lit(True))
    for column, name in (("cyrillic", "_whole"), ("_s.root", "_root"), ("_hard", "_hardened")):
        w = w.join(known.withColumnRenamed("_in", name).withColumnRenamed("_k", f"{name}_k"), F.col(column) == F.col(f"{name}_k"), "left").drop(f"{name}_k")
    whole, none = F.coalesce("_whole", F.lit(False)), F.array().cast("array<string>")
    root_known = (F.char_length("_s.root") >= 2) & (F.coalesce("_root", F.lit(False)) | F.coalesce("_hardened", F.lit(False)))
    ids = F.when(whole, none).otherwise(F.col("_s.ids"))
    return w.select(
        F.col("word").alias(word), "script", "cyrillic", F.when(whole, F.col("cyrillic")).otherwise(F.col("_s.root")).alias("root"), ids.alias("suffix_ids"),
        F.when(whole, none).otherwise(F.col("_s.forms")).alias("suffixes"), (whole | root_known).alias("is_known_root"),
        (whole | F.coalesce("_root", F.lit(False))).alias("root_in_lexicon"), F.when(whole, "unknown").otherwise(part_of_speech(F.col("_s.ids"))).alias("part_of_speech"),
    )


def expected_dative(root: Column) -> Column:
    last = F.right(root, F.lit(1))
    return F.when(last == "к", "ка").when(last.isin("қ", "ғ"), "қа").otherwise("га")


def is_voiceless(letter: Column) -> Column:
    return F.lower(letter).isin(*VOICELESS)


def is_vowel(letter: Column) -> Column:
    return F.lower(letter).isin(*VOWELS)


def expected_locative(root: Column) -> Column:
    return F.when(F.right(root, F.lit(1)).isin(*VOICELESS), "та").otherwise("да")


def expected_ablative(root: Column) -> Column:
    return F.when(F.right(root, F.lit(1)).isin(*VOICELESS), "тан").otherwise("дан")
