"""Tokens with places, per document and without a shuffle: a document's segments are summed up where it lies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

PARAGRAPH = "\n"
SENTENCE_END = "[.!?]"


def measure(segment: Column, paragraph: str) -> Column:
    """A segment's length, and in the upper half of a long its ends of paragraphs: both are summed up at once."""
    return F.char_length(segment).cast("long") + F.shiftleft(T.occurrences(segment, paragraph).cast("long"), 32)


def lower_half(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def upper_half(x: Column) -> Column:
    return F.shiftright(x, 32).cast("int")


#: Texts whose segments are summed up at once, by a task.
DOCS = 256
#: What ``gaps`` may ask for, and its type.
AROUND = {"gap_before": "string", "next_char": "string", "previous": "string", "following": "array<string>", "sentence_id": "long"}


def _placed(keep: list[str], paragraph: str, gaps: tuple[str, ...], ahead: int, filtered: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From documents' segments (``_s``; ``_first`` is where their first token is) to a row a token: sums over a batch's segments as one array.

    ``filtered``: only tokens whose normal form (``_n``, of all tokens) is in the list ``_w`` of any document of the batch.
    """

    def made(b: pa.RecordBatch) -> pa.RecordBatch:
        lists = b.column("_s")
        s, ends = lists.flatten(), lists.offsets.to_numpy()
        ends = ends - ends[0]
        owner, n = np.repeat(np.arange(b.num_rows), np.diff(ends)), len(s)

        def before(x: np.ndarray) -> np.ndarray:
            """Sums of all before each, within its document."""
            sums = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
            return sums[:-1] - sums[ends[owner]]

        length = pc.utf8_length(s).to_numpy(zero_copy_only=False)
        start, breaks = before(length), before(pc.count_substring(s, paragraph).to_numpy(zero_copy_only=False))
        i = np.arange(n) - ends[owner]
        odd = i - b.column("_first").to_numpy()[owner]
        at = np.flatnonzero(odd % 2 == 0)
        columns = {}
        if filtered:
            normal = b.column("_n").flatten()
            hit = pc.is_in(normal, value_set=b.column("_w").flatten())
            at, columns["normalized"] = at[hit.to_numpy(zero_copy_only=False)], normal.filter(hit)
        whose = pa.array(owner[at])
        columns = {k: b.column(k).take(whose) for k in keep} | {"pos": pa.array((odd[at] // 2).astype(np.int32)), "original": s.take(pa.array(at))} | columns
        columns |= {"start_index": pa.array(start[at].astype(np.int32)), "end_index": pa.array((start[at] + length[at]).astype(np.int32)), "paragraph_index": pa.array((breaks[at] + 1).astype(np.int32))}

        def neighbour(d: int) -> pa.Array:
            """The segment ``d`` further on in the same document, or null."""
            to = at + d
            return s.take(pa.array(to, mask=(to < ends[owner[at]]) | (to >= ends[owner[at] + 1])))

        if "gap_before" in gaps:
            columns["gap_before"] = pc.fill_null(neighbour(-1), "")
        if "next_char" in gaps:
            columns["next_char"] = pc.fill_null(pc.utf8_slice_codeunits(neighbour(1), 0, 1), "")
        if "previous" in gaps:
            columns["previous"] = neighbour(-2)
        if "following" in gaps:
            many = np.minimum(2 * ahead, ends[owner[at] + 1] - at - 1)
            cuts = np.concatenate([[0], np.cumsum(many)])
            columns["following"] = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), s.take(pa.array(np.arange(cuts[-1]) - np.repeat(cuts[:-1] - at - 1, many))))
        if "sentence_id" in gaps:
            stop = pc.match_substring_regex(s, f"^{SENTENCE_END}").to_numpy(zero_copy_only=False) & (odd % 2 != 0) & (i > 0)
            columns["sentence_id"] = pa.array(before(stop)[at])
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, DOCS):
                yield made(b.slice(k, DOCS))

    return run


def tokenize(docs: DataFrame, key: str = "doc_id", paragraph: str = PARAGRAPH, gaps: bool | tuple[str, ...] = False, ahead: int = 1, only: str | None = None) -> DataFrame:
    """``(key, pos, original, normalized, start_index, end_index, paragraph_index)``, and if asked what stands around a token.

    Places are code points, the end exclusive; ``pos`` counts from 0, ``paragraph_index`` from 1. With ``gaps``, or those of them
    that it names: ``gap_before`` is what stands between the previous token (or the text's start) and this one, ``next_char`` the
    character right after it, ``previous`` the token before (null for the first), ``following`` the next gap, token, gap, ... up to
    ``ahead`` tokens, and ``sentence_id`` counts the tokens before it that an end of sentence follows at once.
    Words and what is between them alternate, so that every other segment is a token and neighbours need no window.
    ``only`` names a column of lists of words: of a document, tokens whose normal form isn't in its list may be left out (those
    in the list never are).
    """
    around = tuple(AROUND) if gaps is True else tuple(c for c in AROUND if gaps and c in gaps)
    text = F.coalesce("text", F.lit(""))
    columns = [F.col(key), F.regexp_extract_all(text, F.lit(T.SEGMENT), F.lit(0)).alias("_s"), F.when(text.rlike("^" + T.TOKEN), 0).otherwise(1).alias("_first")]
    columns += [T.normal_tokens(text).alias("_n"), F.col(only).alias("_w")] if only else []
    schema = [f"`{key}` {docs.schema[key].dataType.simpleString()}", "pos int, original string", *["normalized string"] * bool(only), "start_index int, end_index int, paragraph_index int", *(f"{c} {AROUND[c]}" for c in around)]
    rows = docs.select(*columns).mapInArrow(_placed([key], paragraph, around, ahead, bool(only)), ", ".join(schema))
    normal = F.col("normalized") if only else T.normalize_token(F.col("original")).alias("normalized")
    return rows.select(key, "pos", "original", normal, "start_index", "end_index", "paragraph_index", *around)


def words(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, normalized)``: tokens without places, for counting."""
    return docs.select(key, F.explode(T.normal_tokens(F.coalesce("text", F.lit("")))).alias("normalized"))


def spans(text: Column, pattern: str, paragraph: str = PARAGRAPH) -> Column:
    """``array<struct<match, start_index, end_index, paragraph_index>>`` of all matches of a pattern that matches no empty text.

    Texts without a match are passed over by one look. Else a text is split at the matches, and lengths summed up.
    """
    none = F.array().cast("array<struct<match:string,start_index:int,end_index:int,paragraph_index:int>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(m: Column) -> Column:
        parts = F.flatten(F.zip_with(F.split(text, pattern, -1), F.concat(m, F.array(F.lit(""))), lambda b, x: F.array(measure(b, paragraph), measure(x, paragraph))))

        def span(x: Column, at: Column) -> Column:
            start = lower_half(at)
            return F.struct(x.alias("match"), start.alias("start_index"), (start + F.char_length(x)).alias("end_index"), (upper_half(at) + 1).alias("paragraph_index"))

        return T.let(T.running_starts(parts, "long"), lambda at: F.transform(m, lambda x, i: span(x, F.get(at, 2 * i + 1))))

    return F.when(text.rlike(pattern), T.let(found, placed)).otherwise(none)


def matches(docs: DataFrame, pattern: str, key: str = "doc_id", paragraph: str = PARAGRAPH) -> DataFrame:
    """``(key, match, start_index, end_index, paragraph_index)``: the pattern's ``spans``, a row each."""
    return docs.where(F.col("text").rlike(pattern)).select(key, F.explode(spans(F.col("text"), pattern, paragraph)).alias("x")).select(key, "x.*")


def with_text(rows: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows beside their document's text, for what needs a context."""
    return rows.join(docs.select(key, "text"), key)
