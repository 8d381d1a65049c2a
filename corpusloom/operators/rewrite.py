"""Rewrites of whole texts: replacements by place, and text-to-text functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import translit


#: Characters of a text that are kept together, and fixes that are decided together, so that neither is gone through once a fix.
CHUNK, BLOCK = 256, 128
FIX = "struct<start_index:int,end_index:int,original_text:string,replacement:string>"


def cut(chunks: Column, start: Column, end: Column) -> Column:
    """A part of a text that lies in chunks of CHUNK characters; what lies elsewhere isn't looked at."""
    first = F.floor(start / CHUNK).cast("int")
    count = F.greatest(F.lit(0), F.floor((end - 1) / CHUNK).cast("int") - first + 1)
    return F.substring(F.array_join(F.slice(chunks, first + 1, count), ""), start - first * CHUNK + 1, F.greatest(F.lit(0), end - start))


def chosen(fixes: Column) -> Column:
    """Of fixes in order of place, those that are put in: from the right, each that ends where the next one begins, or before. In order of place.

    They are gone through in blocks, so that no long array is copied at each fix.
    """
    none = F.array().cast(f"array<{FIX}>")
    turned = F.reverse(fixes)
    last = F.floor((F.size(fixes) - 1) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(turned, k * BLOCK + 1, F.lit(BLOCK)))

    def step(s: Column, x: Column) -> Column:
        ok = s["at"].isNull() | (x["end_index"] <= s["at"])
        return F.struct(F.when(ok, x["start_index"]).otherwise(s["at"]).alias("at"), F.when(ok, F.array_append(s["out"], x)).otherwise(s["out"]).alias("out"))

    def block(s: Column, xs: Column) -> Column:
        inner = F.aggregate(xs, F.struct(s["at"].alias("at"), none.alias("out")), step)
        return T.let(inner, lambda r: F.struct(r["at"].alias("at"), F.array_append(s["out"], r["out"]).alias("out")))

    start = F.struct(F.lit(None).cast("int").alias("at"), F.array().cast(f"array<array<{FIX}>>").alias("out"))
    return F.when(F.size(fixes) > 0, F.reverse(F.flatten(F.aggregate(blocks, start, block)["out"]))).otherwise(none)


def replace_all(docs: DataFrame, fixes: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with their fixes put in, from the last to the first, and how many were put in or skipped.

    ``fixes`` have ``(key, start_index, end_index, original_text, replacement)``. One is skipped if the text at its place isn't
    ``original_text``, or if it reaches into one that is put in. A text is cut into chunks once, and put together once from what
    stands between the fixes, so that a long text with many fixes takes time in proportion to both.
    """
    good = fixes.where((F.coalesce("replacement", F.lit("")) != "") & F.col("start_index").isNotNull() & F.col("end_index").isNotNull())
    one = F.struct(F.col("start_index").cast("int").alias("start_index"), F.col("end_index").cast("int").alias("end_index"), "original_text", "replacement")
    by = good.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("_f"))
    n = F.char_length("text")

    def made(chunks: Column) -> Column:
        there = F.filter("_f", lambda x: (x["start_index"] >= 0) & (x["end_index"] <= n) & (x["start_index"] <= x["end_index"]) & (cut(chunks, x["start_index"], x["end_index"]) == x["original_text"]))

        def rebuilt(put: Column) -> Column:
            before = F.transform(put, lambda x, i: F.concat(cut(chunks, F.when(i > 0, F.get(put, i - 1)["end_index"]).otherwise(F.lit(0)), x["start_index"]), x["replacement"]))
            rest = cut(chunks, F.coalesce(F.element_at(put, -1)["end_index"], F.lit(0)), n)
            return F.struct(F.concat(F.array_join(before, ""), rest).alias("text"), F.size(put).alias("done"))

        return T.let(there, lambda fixes: T.let(chosen(fixes), lambda put: F.when(F.size(put) > 0, rebuilt(put))))

    chunks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    both = docs.join(by, key, "left").withColumn("_r", F.when(F.col("_f").isNotNull() & F.col("text").isNotNull(), T.let(chunks, made)))
    done = F.coalesce("_r.done", F.lit(0))
    both = both.withColumns({"text": F.coalesce("_r.text", "text"), "replaced": done, "skipped": F.coalesce(F.size("_f"), F.lit(0)) - done})
    return both.drop("_f", "_r")


def convert(docs: DataFrame, mixed_to: str | None = None, exceptions: list[dict] = ()) -> DataFrame:
    """Texts in the other script, with their words counted."""
    return docs.withColumns({"text": translit.switch_script(F.col("text"), mixed_to, exceptions), "words": T.word_count(F.col("text"))})


def cleanup(docs: DataFrame, paragraph: str = "\n") -> DataFrame:
    return docs.withColumn("text", translit.cleanup_spaces(F.col("text"), paragraph))


def fix_apostrophes(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"text": translit.normalize_apostrophes(F.col("text")), "edits": translit.apostrophe_edits(F.col("text"))})


def replace_keeping_end(old, new):
    """A range's new text, with the old one's trailing white space."""
    return F.concat(F.rtrim(new), F.regexp_extract(old, r"(\s*)$", 1))
