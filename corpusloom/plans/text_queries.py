"""Queries on tokens, spelling and scripts over the document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import data
from ..functions import text as T
from ..functions import translit
from ..functions.collation import CYRILLIC_ORDER, LATIN_ORDER, is_cyrillic_word, sort_key
from ..operators import lexicon as L
from ..operators import reports, rewrite, spelling
from ..operators import tokens as K
from ..operators.ranking import ranked
from . import sql


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores where the input has fewer splits than there are; larger inputs stay where they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents"))


def tokenize(spark, sf_dir):
    return K.tokenize(docs_of(spark, sf_dir)).select("doc_id", "pos", "original", "normalized", "start_index", "end_index", "paragraph_index")


def normalize_words(spark, sf_dir):
    return K.words(docs_of(spark, sf_dir)).groupBy("normalized").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


def detect_script(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", T.detect_script(F.col("text")).alias("script"), T.count_latin(F.col("text")).alias("latin"), T.count_cyrillic(F.col("text")).alias("cyrillic"))


def script_histogram(spark, sf_dir):
    return docs_of(spark, sf_dir).groupBy("lang", T.detect_script(F.col("text")).alias("script")).agg(F.count(F.lit(1)).alias("docs"))


def word_count(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).alias("words"))


def skip_words(spark, sf_dir):
    """Distinct pieces between blanks that aren't checked."""
    pieces = docs_of(spark, sf_dir).select(F.explode(F.split("text", r"[ \n]+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return pieces.where(T.skip_word(F.col("word")))


def spell_check(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    return spelling.own_errors(docs)


def severe(errors: DataFrame) -> DataFrame:
    return errors.withColumns({"severity": F.lit("Spelling"), "rule_id": F.lit(None).cast("string"), "is_resolved": F.col("start_index") % 7 == 0})


def spell_stats(spark, sf_dir):
    return spelling.statistics(severe(spell_check(spark, sf_dir)))


def top_errors(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    # words of three documents or fewer are errors here, so that there are counts to order
    return spelling.top_words(spelling.own_errors(docs, 4))


def error_context(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    return spelling.with_context(spell_check(spark, sf_dir), docs).select("doc_id", "start_index", "context")


def document_check(spark, sf_dir):
    return spelling.per_document(severe(spell_check(spark, sf_dir)))


def search_errors(spark, sf_dir):
    return spelling.search(spell_check(spark, sf_dir), "TION")


def resolve_errors(spark, sf_dir):
    return spelling.resolve_word(spell_check(spark, sf_dir), "The")


def export_csv_rows(spark, sf_dir):
    errors = severe(spell_check(spark, sf_dir)).withColumns({"suggestion": F.lit(None).cast("string"), "context": F.col("original_text")})
    return reports.csv_rows(errors)


def export_text_rows(spark, sf_dir):
    errors = severe(spell_check(spark, sf_dir)).withColumns({"suggestion": F.reverse("word"), "context": F.col("original_text")})
    return reports.text_rows(errors)


def to_cyrillic(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", translit.to_cyrillic(F.col("text")).alias("text"))


def switch_script(spark, sf_dir):
    """With the exceptions in force."""
    return rewrite.convert(docs_of(spark, sf_dir).select("doc_id", "text"), "Cyrillic", data.EXCEPTIONS)


def round_trip(spark, sf_dir):
    """Texts to Cyrillic and back."""
    return docs_of(spark, sf_dir).select("doc_id", translit.to_latin(translit.to_cyrillic(F.col("text"))).alias("text"))


def cleanup_spaces(spark, sf_dir):
    """Over texts whose blanks were doubled and set around line ends."""
    loose = F.replace(F.replace(F.col("text"), F.lit(" "), F.lit("  ")), F.lit("\n"), F.lit(" \n "))
    return rewrite.cleanup(docs_of(spark, sf_dir).select("doc_id", loose.alias("text")))


def normalize_apostrophes(spark, sf_dir):
    """Over texts whose letter e was made an apostrophe."""
    marked = F.replace(F.col("text"), F.lit("e"), F.lit("`"))
    return rewrite.fix_apostrophes(docs_of(spark, sf_dir).select("doc_id", marked.alias("text")))


def replace_word(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", translit.replace_word(F.col("text"), "the", "THE$1").alias("text"))


def replace_all(spark, sf_dir):
    """All misspelled words spelled backwards."""
    docs = docs_of(spark, sf_dir).select("doc_id", "text")
    fixes = spell_check(spark, sf_dir).withColumn("replacement", F.reverse("original_text"))
    out = rewrite.replace_all(docs, fixes)
    return out.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "replaced", "skipped")


def bigram_index(spark, sf_dir):
    """How many words of the lexicon hold a pair of letters, and how often."""
    words = spelling.lexicon_of(docs_of(spark, sf_dir))
    each = words.select("word", F.explode(T.bigrams(F.col("word"))).alias("bigram"))
    return each.groupBy("bigram").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("word").alias("words"))


def length_index(spark, sf_dir):
    return spelling.lexicon_of(docs_of(spark, sf_dir)).groupBy(F.char_length("word").alias("len")).agg(F.count(F.lit(1)).alias("words"), F.min("word").alias("first"))


def collation_sort(spark, sf_dir):
    """The lexicon's words with their place in order of the alphabet."""
    from .stream_queries import work_dir

    words = spelling.lexicon_of(docs_of(spark, sf_dir)).select("word")
    return ranked(words, [sort_key(F.col("word")), F.col("word")], work_dir(spark, "collation"))


def lexicon_union(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    talk = read(spark, sf_dir, "conversations").select("text", (F.col("conv_id") * 100_000 + F.col("turn")).alias("doc_id"))
    return L.union(spelling.lexicon_of(docs), spelling.lexicon_of(talk))


def import_classify(spark, sf_dir):
    """Words of conversations against a main lexicon of frequent words and a user lexicon of rarer ones."""
    docs = docs_of(spark, sf_dir)
    lex = spelling.lexicon_of(docs)
    talk = K.words(read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "text")).groupBy("normalized").agg(F.count(F.lit(1)).alias("n"))
    rows = talk.select(F.xxhash64("normalized").alias("ordinal"), F.col("normalized").alias("word"))
    return L.classify_import(rows, lex.where("df >= 20"), lex.where("df < 20")).select("word", "outcome")


def import_counters(spark, sf_dir):
    return L.import_counters(import_classify(spark, sf_dir))


def lexicon_search(spark, sf_dir):
    return L.search(spelling.lexicon_of(docs_of(spark, sf_dir)).select("word"), "Tion", "Latin")


def lexicon_scripts(spark, sf_dir):
    words = spelling.lexicon_of(docs_of(spark, sf_dir)).select("word")
    return words.groupBy(is_cyrillic_word(F.col("word")).alias("cyrillic")).agg(F.count(F.lit(1)).alias("words"))


TOK = sql.tokens()
LEX2 = f"{TOK}, {sql.lexicon(2)}"
ERR = f"{LEX2}, {sql.ERRORS}"

QUERIES = {f.__name__: f for f in (
    tokenize, normalize_words, detect_script, script_histogram, word_count, skip_words, spell_check, spell_stats, top_errors, error_context, document_check,
    search_errors, resolve_errors, export_csv_rows, export_text_rows, to_cyrillic, switch_script, round_trip, cleanup_spaces, normalize_apostrophes, replace_word,
    replace_all, bigram_index, length_index, collation_sort, lexicon_union, import_classify, import_counters, lexicon_search, lexicon_scripts,
)}

SCRIPT = """CASE WHEN cyrillic + latin = 0 THEN 'Unknown' WHEN cyrillic / (cyrillic + latin) > 0.8 THEN 'Cyrillic' WHEN latin / (cyrillic + latin) > 0.8 THEN 'Latin'
            WHEN cyrillic + latin < 3 THEN 'Unknown' ELSE 'Mixed' END"""
SCRIPTS = "c AS (SELECT doc_id, lang, len(regexp_extract_all(text, '[a-zA-Z]')) AS latin, len(regexp_extract_all(text, '[а-яА-ЯёЁўЎғҒҳҲқҚ]')) AS cyrillic FROM documents)"
TALK = sql.tokens("conversations", "conv_id * 100000 + turn", "2")
CLASSIFIED = f"""
WITH {LEX2}, {TALK},
w AS (SELECT DISTINCT normalized FROM tok2),
o AS (SELECT normalized AS word, CASE WHEN {sql.SKIP} THEN 'skipped' WHEN (SELECT max(df) FROM lex WHERE lex.word = normalized) >= 20 THEN 'in_main'
      WHEN normalized IN (SELECT word FROM lex) THEN 'in_user' ELSE 'added' END AS outcome FROM w)
"""

LATIN_WEIGHT = f"list_position([{', '.join(repr(x) if chr(39) not in x else chr(39) + x.replace(chr(39), chr(39) * 2) + chr(39) for x in LATIN_ORDER)}], t)"
ORACLE_SQL = {
    "collation_sort": rf"""WITH {LEX2}, k AS (SELECT word, len(regexp_extract_all(lower(word), '[а-яўқғҳё]')) >= len(regexp_extract_all(lower(word), '[a-z]')) AS c,
  list_transform(regexp_extract_all(lower(word), '.'), lambda t: coalesce(nullif(strpos('{CYRILLIC_ORDER}', t), 0), unicode(t) + 1000)) AS cw,
  list_transform(regexp_extract_all(translate(lower(word), 'ʻʼ‘’`', repeat('''', 5)), 'ch|g''|ng|o''|sh|.'), lambda t: coalesce(nullif({LATIN_WEIGHT}, 0), unicode(t) + 10000)) AS lw FROM lex)
SELECT word, row_number() OVER (ORDER BY NOT c, CASE WHEN c THEN cw ELSE lw END, word) AS place FROM k""",
    "tokenize": f"WITH {TOK} SELECT doc_id, pos, original, normalized, start_index, end_index, paragraph_index FROM tok",
    "normalize_words": f"WITH {TOK} SELECT normalized, count(*) AS n, count(DISTINCT doc_id) AS docs FROM tok GROUP BY 1",
    "detect_script": f"WITH {SCRIPTS} SELECT doc_id, {SCRIPT} AS script, latin, cyrillic FROM c",
    "script_histogram": f"WITH {SCRIPTS} SELECT lang, {SCRIPT} AS script, count(*) AS docs FROM c GROUP BY 1, 2",
    "word_count": r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \n\r]+')) AS words FROM documents",
    "skip_words": r"""
WITH p AS (SELECT unnest(string_split_regex(text, '[ \n]+')) AS word FROM documents), w AS (SELECT word, count(*) AS n FROM p WHERE word <> '' GROUP BY 1)
SELECT word, n FROM w WHERE length(word) <= 1 OR regexp_full_match(word, '\d+') OR regexp_full_match(word, '[\p{Lu}.]+') OR regexp_matches(word, '[^\p{L}\-\x{00AD}ʻʼ‘’'']')""",
    "spell_check": f"WITH {ERR} SELECT * FROM err",
    "spell_stats": f"""WITH {ERR} SELECT count(*) AS total, count(*) FILTER (WHERE start_index % 7 = 0) AS resolved, count(*) FILTER (WHERE start_index % 7 <> 0) AS unresolved,
count(*) AS spelling_count, 0::BIGINT AS grammar_count, 0::BIGINT AS style_count, 0::BIGINT AS typo_count, count(DISTINCT (doc_id, paragraph_index)) AS paragraphs FROM err""",
    "top_errors": f"""WITH {TOK}, {sql.lexicon(4)}, {sql.ERRORS}
SELECT lower(word) AS word, count(*) AS errors FROM err GROUP BY 1 ORDER BY errors DESC, min(row(doc_id, start_index)) LIMIT 10""",
    "error_context": f"""WITH {ERR}, j AS (
  SELECT e.doc_id, e.start_index, string_split(substr(text, 1, start_index), chr(10))[-1] AS l, string_split(substr(text, end_index + 1), chr(10))[1] AS r,
         substr(text, start_index + 1, end_index - start_index) AS w FROM err e JOIN documents d ON e.doc_id = d.doc_id)
SELECT doc_id, start_index, trim(CASE WHEN length(l) > 30 THEN '...' ELSE '' END || CASE WHEN length(l) > 30 THEN right(l, 30) ELSE l END || w
       || CASE WHEN length(r) > 30 THEN left(r, 30) ELSE r END || CASE WHEN length(r) > 30 THEN '...' ELSE '' END) AS context FROM j""",
    "document_check": f"WITH {ERR} SELECT doc_id, count(*) AS spelling, 0::BIGINT AS grammar, count(*) AS total FROM err GROUP BY 1",
    "search_errors": f"WITH {ERR} SELECT * FROM err WHERE contains(lower(word), 'tion')",
    "resolve_errors": f"WITH {ERR} SELECT * FROM err WHERE lower(trim(word)) <> 'the'",
    "export_csv_rows": f"""WITH {ERR}, u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_index, end_index) AS no FROM err WHERE start_index % 7 <> 0)
SELECT doc_id, no, no || ',"' || word || '",Имло,Spelling,"",' || paragraph_index || ',"' || replace(original_text, '"', '""') || '"' AS line FROM u""",
    "export_text_rows": f"""WITH {ERR}, u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_index, end_index) AS no FROM err WHERE start_index % 7 <> 0)
SELECT doc_id, no, '  ' || lpad(no::VARCHAR, 3, ' ') || '. ' || word || '  →  ' || reverse(word) || '  (§' || paragraph_index || ')' || chr(10) || '       Контекст: ' || original_text AS line FROM u""",
    "to_cyrillic": f"SELECT doc_id, {sql.to_cyrillic('text')} AS text FROM documents",
    "cleanup_spaces": r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(text, ' ', '  '), chr(10), ' ' || chr(10) || ' '), ' {2,}', ' ', 'g'), ' +\n', chr(10), 'g'), '\n +', chr(10), 'g') AS text FROM documents""",
    "replace_all": f"""WITH {ERR}, x AS (SELECT r.doc_id, string_agg(CASE WHEN e.word IS NULL THEN r.s ELSE reverse(r.s) END, '' ORDER BY r.i) AS text, count(e.word) AS replaced
  FROM run r LEFT JOIN err e ON r.doc_id = e.doc_id AND r.st = e.start_index GROUP BY 1)
SELECT doc_id, sha256(text) AS text_sha256, replaced::INT AS replaced, 0::INT AS skipped FROM x""",
    "replace_word": r"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'), lambda s: CASE WHEN lower(s) = 'the' THEN 'THE$1' ELSE s END), '') AS text FROM documents""",
    "normalize_apostrophes": r"""WITH RECURSIVE t AS (SELECT doc_id, string_split(replace(text, 'e', '`'), '') AS c FROM documents),
x AS (SELECT doc_id, list_transform(c, lambda v, i: CASE WHEN v IN ('`', chr(39), '‘', '’') AND i > 1 AND regexp_full_match(coalesce(c[i - 1], ''), '[A-Za-z]') AND regexp_full_match(coalesce(c[i + 1], ''), '[A-Za-z]')
        THEN CASE WHEN c[i - 1] IN ('o', 'O', 'g', 'G') THEN '‘' ELSE '’' END ELSE v END) AS d, c FROM t)
SELECT doc_id, array_to_string(d, '') AS text, len(list_filter(range(1, len(c) + 1), lambda i: c[i] <> d[i]))::INT AS edits FROM x""",
    "bigram_index": f"""WITH {LEX2}, g AS (SELECT word, unnest(list_transform(range(1, length(word)), lambda i: substr(word, i, 2))) AS bigram FROM lex)
SELECT bigram, count(*) AS n, count(DISTINCT word) AS words FROM g GROUP BY 1""",
    "length_index": f"WITH {LEX2} SELECT length(word) AS len, count(*) AS words, min(word) AS first FROM lex GROUP BY 1",
    "lexicon_union": f"""WITH {LEX2}, {TALK}
SELECT word FROM lex UNION SELECT normalized AS word FROM tok2 WHERE length(normalized) > 1 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2""",
    "import_classify": f"{CLASSIFIED} SELECT word, outcome FROM o",
    "import_counters": f"""{CLASSIFIED} SELECT count(*) FILTER (WHERE outcome <> 'skipped') AS parsed, count(*) FILTER (WHERE outcome = 'added') AS added,
count(*) FILTER (WHERE outcome = 'in_main') AS skipped_main, count(*) FILTER (WHERE outcome = 'in_user') AS skipped_user FROM o""",
    "lexicon_search": f"WITH {LEX2} SELECT word FROM lex WHERE contains(word, 'tion') AND len(regexp_extract_all(word, '[а-яўқғҳё]')) < len(regexp_extract_all(word, '[a-z]'))",
    "lexicon_scripts": f"WITH {LEX2} SELECT len(regexp_extract_all(word, '[а-яўқғҳё]')) >= len(regexp_extract_all(word, '[a-z]')) AS cyrillic, count(*) AS words FROM lex GROUP BY 1",
}
