"""Spelling: lexicons, the anti-join that finds errors, and statistics on errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import translit
from . import tokens as K


def words_by_document(docs: DataFrame, *columns: Column) -> DataFrame:
    """``columns`` and ``word``: each document's words of at least two letters, once each."""
    found = F.array_distinct(T.normal_tokens(F.coalesce("text", F.lit(""))))
    return docs.select(*columns, F.explode(found).alias("word")).where(F.char_length("word") > 1)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """``(word, df)``: in how many documents each word of at least two letters stands.

    Words are made distinct per document by arrays before the shuffle, so that a document counts once.
    """
    return words_by_document(docs).groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def lexicon_of(docs: DataFrame, min_docs: int = 2, key: str = "doc_id") -> DataFrame:
    """``(word, df)``: words of at least two letters found in ``min_docs`` documents."""
    return document_frequencies(docs).where(F.col("df") >= min_docs)


def expand_scripts(lexicon: DataFrame, word: str = "word") -> DataFrame:
    """Distinct words of a lexicon, in their own script and in the other one."""
    forms = F.array(F.col(word), translit.other_script(F.col(word)))
    return lexicon.select(F.explode(F.array_compact(forms)).alias("word")).distinct()


def checked(tokens: DataFrame) -> DataFrame:
    """Tokens that are checked at all."""
    return tokens.where((F.char_length("normalized") > 1) & ~T.skip_word(F.col("normalized")))


def misspelled(tokens: DataFrame, lexicon: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Checked tokens whose word is in ``lexicon`` (``word``) neither in its own script nor in the other: two anti-joins.

    Words are made distinct before they meet the lexicon, and the unknown ones meet the tokens. ``words`` (``normalized``)
    may give the tokens' words in a cheaper way than tokens with places.
    """
    tokens = checked(tokens)
    unknown = checked(words if words is not None else tokens).select("normalized").distinct().join(lexicon.select("word"), F.col("normalized") == F.col("word"), "left_anti")
    # few words are left to be written in the other script
    unknown = unknown.withColumn("_other", translit.other_script(F.col("normalized"))).join(lexicon.select("word"), F.col("_other") == F.col("word"), "left_anti")
    return tokens.join(unknown.select("normalized"), "normalized", "left_semi")


def is_member(word: Column, lexicon_words: Column) -> Column:
    """Membership in a small lexicon held as an array, by a word's own form or the other script's."""
    return F.array_contains(lexicon_words, word) | F.coalesce(F.array_contains(lexicon_words, translit.other_script(word)), F.lit(False))


def errors(docs: DataFrame, lexicon: DataFrame, key: str = "doc_id", paragraph: str = K.PARAGRAPH) -> DataFrame:
    """Spelling errors: ``(key, word, original_text, start_index, end_index, paragraph_index)``."""
    found = misspelled(K.tokenize(docs, key, paragraph), lexicon, K.words(docs, key))
    return found.select(key, F.col("normalized").alias("word"), F.col("original").alias("original_text"), "start_index", "end_index", "paragraph_index")


#: Documents that a rare word's figures tell: the first, the last, and by what is left of all together, one between.
TOLD = 3


def own_errors(docs: DataFrame, min_docs: int = 2, key: str = "doc_id", paragraph: str = K.PARAGRAPH) -> DataFrame:
    """``errors`` against the documents' own lexicon, from one count of their words: rare ones are unknown, but for their form in the other script.

    The count says which documents rare words stand in, by hashes of their keys, so that only texts move to their unknown words, and
    tokens never do. It is read twice and made once, as Spark sees that both plans begin alike.
    """
    if min_docs > TOLD + 1:
        return errors(docs, lexicon_of(docs, min_docs, key), key, paragraph)
    h = F.xxhash64(key)
    each = words_by_document(docs, h.alias("_h")).groupBy("word")
    counts = each.agg(F.count(F.lit(1)).alias("df"), F.min("_h").alias("_low"), F.max("_h").alias("_high"), F.bit_xor("_h").alias("_all"))
    # conditions that need all of the count stay above it, so that both uses of it stay the same: no low is above its high
    known = F.when(F.col("df") >= min_docs, True).otherwise((F.col("_low") > F.col("_high")) & F.col("_all").isNull())
    rare = counts.where(F.when(F.col("df") < min_docs, ~T.skip_word(F.col("word"))).otherwise(False))
    lexicon = counts.where(known).select(F.col("word").alias("_known"))
    unknown = rare.withColumn("_other", translit.other_script(F.col("word"))).join(lexicon, F.col("_other") == F.col("_known"), "left_anti")
    between = F.col("_all").bitwiseXOR(F.col("_low")).bitwiseXOR(F.col("_high"))
    told = F.array_distinct(F.when(F.col("df") == TOLD, F.array("_low", "_high", between)).otherwise(F.array("_low", "_high")))
    return found_in(docs, unknown.select("word", F.explode(told).alias("_h")), key, paragraph)


def found_in(docs: DataFrame, words: DataFrame, key: str = "doc_id", paragraph: str = K.PARAGRAPH) -> DataFrame:
    """Places of ``words`` (``word``, ``_h``: a hash of the key of a document that it stands in): ``(key, word, original_text, start_index, end_index, paragraph_index)``.

    All documents of each word are given, so that one of another document that is met beside it is right as well.
    """
    lists = words.groupBy("_h").agg(F.collect_list("word").alias("_words"))
    texts = docs.select(key, "text", F.xxhash64(key).alias("_key")).join(lists, F.col("_key") == F.col("_h"))
    found = K.tokenize(texts, key, paragraph, only="_words")
    return found.select(key, F.col("normalized").alias("word"), F.col("original").alias("original_text"), "start_index", "end_index", "paragraph_index")


def with_context(errors: DataFrame, docs: DataFrame, key: str = "doc_id", radius: int = 30, paragraph: str = K.PARAGRAPH) -> DataFrame:
    """Errors with a snippet of what stands around them in their paragraph."""
    both = K.with_text(errors, docs, key)
    return both.withColumn("context", T.spelling_context(F.col("text"), F.col("start_index"), F.col("end_index"), radius, paragraph)).drop("text")


def statistics(errors: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row of counts. ``errors`` have ``severity`` and ``is_resolved``; errors in punctuation have no count of their own."""
    of = lambda name: F.count_if(F.col("severity") == name).alias(f"{name.lower()}_count")
    return errors.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_resolved").alias("resolved"), F.count_if(~F.col("is_resolved")).alias("unresolved"),
                      *map(of, ("Spelling", "Grammar", "Style", "Typo")), F.count_distinct(key, "paragraph_index").alias("paragraphs"))


def top_words(errors: DataFrame, k: int = 10, key: str = "doc_id") -> DataFrame:
    """The most common error words, lower-cased; ties in order of first place."""
    by = errors.groupBy(F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("errors"), F.min(F.struct(key, "start_index")).alias("first"))
    return by.orderBy(F.col("errors").desc(), "first").limit(k).select("word", "errors")


def per_document(errors: DataFrame, key: str = "doc_id") -> DataFrame:
    """Numbers of spelling and grammar errors of each document that has any; grammar errors have a ``rule_id``."""
    return errors.groupBy(key).agg(F.count_if(F.col("rule_id").isNull()).alias("spelling"), F.count_if(F.col("rule_id").isNotNull()).alias("grammar"), F.count(F.lit(1)).alias("total"))


def resolve_word(errors: DataFrame, word: str) -> DataFrame:
    """Errors without those of a word: equal but for case and blanks, or equal when normalised."""
    lit = F.lit(word)
    same = (F.lower(F.trim("word")) == F.lower(F.trim(lit))) | (T.normalize_word(F.col("word")) == T.normalize_word(lit))
    return errors.where(~same)


def search(errors: DataFrame, query: str) -> DataFrame:
    """Errors whose word, context or message holds the query, whatever the case."""
    needle = F.lower(F.lit(query.strip()))
    hit = [F.coalesce(F.lower(c).contains(needle), F.lit(False)) for c in ("word", "context", "message") if c in errors.columns]
    out = hit[0]
    for h in hit[1:]:
        out = out | h
    return errors.where(out)


def first_overlap(spans: DataFrame, errors: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of the errors that overlap a span (``start_index``, ``end_index``) of the same document, the first by place."""
    e = errors.select(F.col(key).alias("_k"), F.col("start_index").alias("error_start"), F.col("end_index").alias("error_end"), "rule_id")
    both = spans.join(e, (F.col(key) == F.col("_k")) & (F.col("error_start") < F.col("end_index")) & (F.col("error_end") > F.col("start_index"))).drop("_k")
    first = Window.partitionBy(key, "start_index", "end_index").orderBy("error_start", "error_end", "rule_id")
    return both.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
