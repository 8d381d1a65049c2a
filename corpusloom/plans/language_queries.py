"""Queries on grammar, morphology, suggestions and language models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import data
from ..functions import morph as M
from ..functions import text as T
from ..functions import translit
from ..operators import grammar as G
from ..operators import language_model as LM
from ..operators import lexicon as L
from ..operators import spelling, suggest
from ..operators import tokens as K
from . import sql
from .text_queries import docs_of, read

# Small inputs in the language, with results worked out by hand.
LEXICON = ("китоб", "мактаб", "юрак", "тоғ", "дарахт", "бор", "келди", "тошкент", "шаҳар")
MORPH_WORDS = ("мактабтан", "дарахтдан", "китобларлар", "юраким", "мактабка", "бораман", "китоб")
SAMPLES = [
    (1, "Мен мактабтан келди. дарахтдан китобларлар."), (2, "мен бораман. Сен бораман, юраким тоғ"), (3, "У эмас ман. тошкент шаҳар"), (4, "Амир темур (китоб [бор) \"тоғ"), (5, "a,b, c,1,,x"),
    (6, "Bir  ikki   uch ,to'rt"), (7, "so'z so'z. yangi Gap.davom"), (8, ""), (9, None),
]


def literals(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sample_docs(spark: SparkSession) -> DataFrame:
    return literals(spark, SAMPLES, "doc_id long, text string")


def sample_lexicon(spark: SparkSession) -> DataFrame:
    return literals(spark, [(w,) for w in LEXICON], "word string")


def gr_double_space(spark, sf_dir):
    """Over texts whose line ends were made pairs of spaces."""
    return G.double_space(docs_of(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("  "))))


def gr_comma_space(spark, sf_dir):
    """Over texts whose commas before an a lost their space."""
    return G.comma_space(docs_of(spark, sf_dir).withColumn("text", F.replace("text", F.lit(", a"), F.lit(",a"))))


def gr_period_space(spark, sf_dir):
    return G.period_space(docs_of(spark, sf_dir))


def gr_sentence_caps(spark, sf_dir):
    return G.sentence_caps(K.tokenize(docs_of(spark, sf_dir), gaps=("gap_before",)))


def gr_repeated_word(spark, sf_dir):
    return G.repeated_word(K.tokenize(docs_of(spark, sf_dir), gaps=("previous",)))


def gr_brackets(spark, sf_dir):
    """Over texts whose commas were made opening brackets, and whose full stops were made closing ones."""
    return G.brackets(docs_of(spark, sf_dir).withColumn("text", F.translate("text", ",.", "()")))


def sentences(spark, sf_dir):
    tokens = K.tokenize(docs_of(spark, sf_dir), gaps=("sentence_id",))
    return tokens.groupBy("doc_id", "sentence_id").agg(F.count(F.lit(1)).alias("words"), F.min("start_index").alias("start_index"), F.max("end_index").alias("end_index"))


def grammar_check(spark, sf_dir):
    """All rules over all documents, by rule."""
    docs = docs_of(spark, sf_dir).select("doc_id", "text")
    errors = G.enrich(G.check(docs, spelling.lexicon_of(docs)))
    return errors.groupBy("rule_id", "severity", "category").agg(F.count(F.lit(1)).alias("errors"), F.count_distinct("doc_id").alias("docs"))


def grammar_samples(spark, sf_dir):
    return G.check(sample_docs(spark), sample_lexicon(spark))


def grammar_context(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    return G.with_context(gr_period_space(spark, sf_dir), docs).select("doc_id", "start_index", "context")


def morph_analyze(spark, sf_dir):
    words = literals(spark, [(w,) for w in MORPH_WORDS], "normalized string")
    m = M.analyze(words, sample_lexicon(spark))
    return m.select("normalized", "root", F.array_join("suffix_ids", ",").alias("suffix_ids"), "is_known_root", "part_of_speech")


def morph_corpus(spark, sf_dir):
    """Parts of speech and suffixes over the lexicon's words written in Cyrillic."""
    lex = spelling.lexicon_of(docs_of(spark, sf_dir)).select(translit.to_cyrillic(F.col("word")).alias("word")).distinct()
    m = M.analyze(lex.select(F.col("word").alias("normalized")), lex.where("word rlike '^к'"))
    return m.groupBy("part_of_speech", F.size("suffix_ids").alias("suffixes")).agg(F.count(F.lit(1)).alias("words"), F.count_if("is_known_root").alias("known"))


def transliteration_samples(spark, sf_dir):
    words = ["kitob", "o'zbek", "oʻzbek", "g'isht", "shahar", "mas'ul", "qat'iy", "'test'", "yo'l", "qo'ng'iroq", "eshik", "web", "китоб", "ЮРИДА", "Юрида", "компьютер", "октябрь", "ўзбек", "Farg'ona", "iPhone", "NATO"]
    rows = literals(spark, [(w,) for w in words], "word string")
    w = F.col("word")
    return rows.select("word", translit.to_cyrillic(w, data.EXCEPTIONS).alias("cyrillic"), translit.to_latin(w).alias("latin"), translit.normalize_apostrophes(w).alias("apostrophes"), translit.other_script(w).alias("other"))


def lexicon_words(spark, sf_dir) -> DataFrame:
    return spelling.lexicon_of(docs_of(spark, sf_dir)).select("word")


def asked_words(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The documents' own misspelled words (``query``), those that are checked and stand in one document alone, and ``lexicon_words``.

    Both come from one count of the documents' words, written once, as searches read them several times.
    """
    from .stream_queries import work_dir

    path, word = work_dir(spark, "words"), F.col("word")
    counts = spelling.document_frequencies(docs_of(spark, sf_dir)).select("word", (F.col("df") >= 2).alias("known"))
    counts.where(F.col("known") | ~T.skip_word(word)).write.parquet(path)
    found = spark.read.schema(counts.schema).parquet(path)
    return found.where(~F.col("known")).select(word.alias("query")), found.where("known").select("word")


def unknown_words(spark, sf_dir) -> DataFrame:
    """Words of all the benchmark's texts that no two documents hold."""
    words = K.words(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text"))
    words = words.select("normalized").distinct().where("length(normalized) > 1")
    return words.join(lexicon_words(spark, sf_dir), F.col("normalized") == F.col("word"), "left_anti").select(F.col("normalized").alias("query"))


def fuzzy_candidates(spark, sf_dir):
    """Of all the documents' misspelled words, as the next ones."""
    return suggest.candidates(*asked_words(spark, sf_dir))


def shared_bigrams(spark, sf_dir):
    """Of each unknown word: how many lexicon words share a bigram with it, and how many bigrams they share."""
    pairs = suggest.shared_bigrams(unknown_words(spark, sf_dir), lexicon_words(spark, sf_dir))
    return pairs.groupBy("query").agg(F.count(F.lit(1)).alias("words"), F.sum("shared").alias("shared"), F.max("shared").alias("most"))


def osa_distance(spark, sf_dir):
    """Between the benchmark's unknown words, each and the next in order, and their bounded distance."""
    from pyspark.sql import Window

    words = unknown_words(spark, sf_dir)
    pairs = words.select("query", F.lead("query").over(Window.partitionBy(F.substring("query", 1, 1)).orderBy("query")).alias("word")).where("word is not null")
    return pairs.select("query", "word", T.edit_distance(F.col("query"), F.col("word")).alias("distance"), T.bounded_edit_distance(F.col("query"), F.col("word"), F.lit(2)).alias("bounded"))


def phonetic_variants(spark, sf_dir):
    words = lexicon_words(spark, sf_dir).select(translit.to_cyrillic(F.col("word")).alias("word")).distinct()
    return words.select("word", F.explode(T.phonetic_variants(F.col("word"))).alias("variant"))


def transposition_variants(spark, sf_dir):
    return lexicon_words(spark, sf_dir).select("word", F.explode(T.transposition_variants(F.col("word"))).alias("variant"))


def suggestions(spark, sf_dir):
    found = suggest.same_script_suggestions(*asked_words(spark, sf_dir))
    return found.select("query", "rank", "suggestion", "distance", F.round("score", 6).alias("score"))


def best_suggestion(spark, sf_dir):
    found = suggest.same_script_suggestions(*asked_words(spark, sf_dir), 1)
    return found.select("query", "suggestion", "distance", suggest.live_threshold(F.col("distance"), F.col("score")).alias("certain"))


def token_arrays(spark, sf_dir) -> DataFrame:
    found = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(T.TOKEN), F.lit(0)), T.normalize_token)
    return docs_of(spark, sf_dir).select("doc_id", found.alias("tokens"))


def lm_unigrams(spark, sf_dir):
    return LM.unigrams(K.words(docs_of(spark, sf_dir)))


def lm_bigrams(spark, sf_dir):
    return LM.bigram_counts(token_arrays(spark, sf_dir), F.col("tokens"))


def lm_prune(spark, sf_dir):
    return LM.prune(lm_bigrams(spark, sf_dir), LM.MAX_BIGRAMS, ["left", "right"])


def lm_context_score(spark, sf_dir):
    """Of each neighbouring pair and the word after it, within the benchmark's texts."""
    from pyspark.sql import Window

    tokens = K.tokenize(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    triples = tokens.select("doc_id", "pos", F.coalesce(F.lag("normalized").over(w), F.lit("")).alias("prev"), F.col("normalized").alias("word"), F.coalesce(F.lead("normalized").over(w), F.lit("")).alias("next"))
    scored = LM.with_context_scores(triples, lm_unigrams(spark, sf_dir), lm_bigrams(spark, sf_dir))
    return scored.select("doc_id", "pos", F.round("context", 9).alias("context"))


def lm_priors(spark, sf_dir):
    counts = lm_unigrams(spark, sf_dir)
    seeds = LM.fallback_priors(counts)
    return counts.join(seeds, "word", "left").select("word", F.round(LM.unigram_prior(F.col("prior"), F.col("cnt")), 9).alias("prior"))


def lm_learn(spark, sf_dir):
    """From the conversations' tokens, each the correction of itself spelled backwards between its neighbours."""
    found = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(T.TOKEN), F.lit(0)), T.normalize_token)
    turns = read(spark, sf_dir, "conversations").select(found.alias("t"))
    events = turns.select(F.explode(F.transform("t", lambda w, i: F.struct(F.reverse(w).alias("source"), w.alias("replacement"), F.get("t", i - 1).alias("prev"), F.get("t", i + 1).alias("next")))).alias("x")).select("x.*")
    learned = LM.learn(events)
    uni = learned["unigrams"].select(F.lit("unigram").alias("kind"), "word", F.lit("").alias("other"), "cnt")
    return uni.unionByName(learned["bigrams"].select(F.lit("bigram").alias("kind"), F.col("left").alias("word"), F.col("right").alias("other"), "cnt")).unionByName(learned["corrections"].select(F.lit("correction").alias("kind"), F.col("source").alias("word"), F.col("target").alias("other"), "cnt"))


PLACE = ("query", "prev", "next")


def ranked(spark, sf_dir) -> DataFrame:
    """Candidates of each misspelled word between its neighbours, ranked with the documents' counts of words and pairs.

    The history is what the benchmark's unknown words were corrected to: their best suggestions. Priors are by rank.
    """
    (errors, lex), unigrams = asked_words(spark, sf_dir), lm_unigrams(spark, sf_dir)
    tokens = K.tokenize(docs_of(spark, sf_dir), gaps=("previous", "following"))
    at = tokens.select(F.col("normalized").alias("query"), F.coalesce(T.normalize_token(F.col("previous")), F.lit("")).alias("prev"), F.coalesce(T.normalize_token(F.get("following", 1)), F.lit("")).alias("next"))
    asks = at.join(errors, "query", "left_semi").distinct()
    accepted = suggest.same_script_suggestions(unknown_words(spark, sf_dir), lex, 1).select(F.col("query").alias("source"), F.col("word").alias("target"), F.lit(1).alias("cnt"))
    counts = {"unigrams": unigrams, "bigrams": lm_bigrams(spark, sf_dir), "corrections": accepted}
    return suggest.rank(suggest.with_model(asks, suggest.candidates(errors, lex), counts, LM.fallback_priors(unigrams)), by=PLACE)


def rank_candidates(spark, sf_dir):
    return ranked(spark, sf_dir).select(*PLACE, "word", "rank", "distance", F.round("rank_score", 6).alias("rank_score"), "reason")


def autocorrect_decision(spark, sf_dir):
    return suggest.decide(ranked(spark, sf_dir), "balanced", by=PLACE).select(*PLACE, "should_replace", "replacement", F.round("score", 6).alias("score"), "reason")


def entries_of(spark, sf_dir) -> DataFrame:
    """An explanation of each lexicon word: its length, in order of the words; those of an odd length say nothing."""
    words = lexicon_words(spark, sf_dir)
    n = F.char_length("word")
    said = F.when(n % 2 == 0, F.concat(F.lit("a word of "), n)).otherwise(" ")
    return words.select(n.alias("ordinal"), "word", said.alias("definition"), F.lit(None).cast("string").alias("spelling_rule"), F.lit("").alias("grammar_note"), F.array().cast("array<string>").alias("examples"))


def talk_words(spark, sf_dir) -> DataFrame:
    return K.words(read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "text")).select(F.col("normalized").alias("word")).distinct()


def explanation_lookup(spark, sf_dir):
    """Of the conversations' words."""
    return L.explain(talk_words(spark, sf_dir), entries_of(spark, sf_dir)).select("word", "definition")


def get_explanation(spark, sf_dir):
    """Of the benchmark's words: local entries are the lexicon's words of an even length, bundled ones the others."""
    words = K.words(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")).select(F.col("normalized").alias("word")).distinct()
    entries = entries_of(spark, sf_dir).select("ordinal", "word")
    return L.get_explanation(words, entries.where("ordinal % 2 = 0"), entries.where("ordinal % 2 = 1"))


def validate_dictionary(spark, sf_dir):
    """All lines of all documents as a word list."""
    return L.validate(docs_of(spark, sf_dir).select(F.explode(F.split("text", "\n")).alias("word")))


QUERIES = {f.__name__: f for f in (
    gr_double_space, gr_comma_space, gr_period_space, gr_sentence_caps, gr_repeated_word, gr_brackets, sentences, grammar_check, grammar_samples, grammar_context,
    morph_analyze, morph_corpus, transliteration_samples, fuzzy_candidates, shared_bigrams, osa_distance, phonetic_variants, transposition_variants, suggestions,
    best_suggestion, lm_unigrams, lm_bigrams, lm_prune, lm_context_score, lm_priors, lm_learn, rank_candidates, autocorrect_decision, explanation_lookup,
    get_explanation, validate_dictionary,
)}

TOK = sql.tokens()
SENTENCES = "sen AS (SELECT *, coalesce(sum((next_char IN ('.', '!', '?'))::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sentence_id FROM tok)"
BENCH = sql.tokens("benchmark", "item_id", "b")
UNKNOWN = f"{TOK}, {BENCH}, {sql.lexicon(2)}, unk AS (SELECT DISTINCT normalized AS query FROM tokb WHERE length(normalized) > 1 AND normalized NOT IN (SELECT word FROM lex)), freq AS (SELECT word FROM lex)"
GRAMS = "list_transform(range(1, length({0})), lambda i: substr({0}, i, 2))"
SHARED = f"""qg AS (SELECT query, unnest({GRAMS.format('query')}) AS g FROM unk), dg AS (SELECT word, unnest({GRAMS.format('word')}) AS g FROM freq),
shared AS (SELECT query, word, count(*) AS shared FROM qg JOIN dg USING (g) GROUP BY 1, 2)"""
HEAD = "doc_id, '{0}' AS rule_id, m AS word, start_index, end_index, paragraph_index"

TURNS = sql.tokens("(SELECT row_number() OVER () AS turn_id, text FROM conversations)", "turn_id", "b")
#: A token's key in language models; of text in neither script as it is.
KEY = "(CASE WHEN regexp_matches({0}, '[a-z]') THEN " + sql.to_cyrillic("{0}") + " ELSE {0} END)"

ORACLE_SQL = {
    "gr_double_space": "WITH x AS (SELECT doc_id, replace(text, chr(10), '  ') AS text FROM documents), " + sql.matches(" {2,}", "x") + f" SELECT {HEAD.format('DOUBLE_SPACE')}, ' ' AS suggestion, length(m) - 1 AS distance FROM hit",
    "gr_period_space": "WITH " + sql.matches(r"\.\p{Ll}") + f" SELECT {HEAD.format('PERIOD_SPACE')}, '. ' || upper(m[-1]) AS suggestion, 1 AS distance FROM hit",
    "gr_comma_space": r"WITH x AS (SELECT doc_id, replace(text, ', a', ',a') AS text FROM documents), " + sql.matches(",", "x") + f""", c AS (SELECT hit.*, substr(x.text, end_index + 1, 1) AS nxt, CASE WHEN start_index > 0 THEN substr(x.text, start_index, 1) END AS prv FROM hit JOIN x USING (doc_id))
SELECT {HEAD.format('COMMA_SPACE')}, ', ' AS suggestion, 1 AS distance FROM c WHERE nxt <> '' AND nxt NOT IN (' ', '0', '1', '2', '3', '4', '5', '6', '7', '8', '9')
UNION ALL SELECT doc_id, 'COMMA_SPACE', ' ,', start_index - 1, end_index, paragraph_index, ',', 1 FROM c WHERE prv = ' '""",
    "gr_sentence_caps": f"WITH {TOK} SELECT doc_id, 'SENT_CAPITALIZATION' AS rule_id, original AS word, start_index, end_index, paragraph_index, upper(original[1]) || original[2:] AS suggestion, 1 AS distance FROM tok WHERE (pos = 0 OR regexp_matches(gap_before, '[.!?]')) AND regexp_matches(original, '^\\p{{Ll}}')",
    "gr_repeated_word": f"WITH {TOK}, l AS (SELECT *, lag(normalized) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM tok) SELECT doc_id, 'REPEATED_WORD' AS rule_id, original AS word, start_index, end_index, paragraph_index, NULL::VARCHAR AS suggestion, 1 AS distance FROM l WHERE p = normalized AND NOT {sql.SKIP}",
    "sentences": f"WITH {TOK}, {SENTENCES} SELECT doc_id, sentence_id, count(*) AS words, min(start_index) AS start_index, max(end_index) AS end_index FROM sen GROUP BY 1, 2",
    "grammar_context": "WITH " + sql.matches(r"\.\p{Ll}") + " SELECT h.doc_id, start_index, substr(text, greatest(0, start_index - 25) + 1, least(length(text), start_index + 25) - greatest(0, start_index - 25)) AS context FROM hit h JOIN documents d ON d.doc_id = h.doc_id",
    "morph_analyze": """SELECT * FROM (VALUES ('мактабтан', 'мактаб', 'ABL_TAN', true, 'noun'), ('дарахтдан', 'дарахт', 'ABL_DAN', true, 'noun'), ('китобларлар', 'китоб', 'PL,AGR_LAR', true, 'verb'),
('юраким', 'юрак', 'POSS_1S', true, 'noun'), ('мактабка', 'мактабк', 'V_PRES', false, 'verb'), ('бораман', 'бор', 'V_PRES,AGR_MAN', true, 'verb'), ('китоб', 'китоб', '', true, 'unknown')) AS t(normalized, root, suffix_ids, is_known_root, part_of_speech)""",
    "osa_distance": f"""WITH {UNKNOWN}, pr AS (SELECT query, lead(query) OVER (PARTITION BY substr(query, 1, 1) ORDER BY query) AS word FROM unk),
pp AS (SELECT query, word, string_split(query, '') AS qa, string_split(word, '') AS wa, abs(length(query) - length(word))::INT AS gap FROM pr WHERE word IS NOT NULL),
dd AS (SELECT query, word, gap, {sql.osa('qa', 'wa')}::INT AS d FROM pp)
SELECT query, word, (CASE WHEN gap > 3 THEN gap ELSE d END)::INT AS distance, (CASE WHEN gap > 2 THEN 3 ELSE least(d, 3) END)::INT AS bounded FROM dd""",
    "shared_bigrams": f"WITH {UNKNOWN}, {SHARED} SELECT query, count(*) AS words, sum(shared)::BIGINT AS shared, max(shared) AS most FROM shared GROUP BY 1",
    "transposition_variants": f"""WITH {TOK}, {sql.lexicon(2)}, v AS (SELECT DISTINCT word, unnest(list_transform(range(1, length(word)), lambda i: substr(word, 1, i - 1) || reverse(substr(word, i, 2)) || substr(word, i + 2))) AS variant FROM lex)
SELECT word, variant FROM v WHERE variant <> word""",
    "phonetic_variants": f"""WITH {TOK}, {sql.lexicon(2)}, c AS (SELECT DISTINCT {sql.to_cyrillic('word')} AS word FROM lex),
v AS (SELECT DISTINCT word, unnest(list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || translate(substr(word, i, 1), 'хҳкқгғуўеэийо', 'ҳхқкғгўуэейиў') || substr(word, i + 1))) AS variant FROM c)
SELECT word, variant FROM v WHERE variant <> word""",
    "lm_unigrams": f"WITH {TOK} SELECT normalized AS word, count(*) AS cnt FROM tok GROUP BY 1",
    "lm_bigrams": f"WITH {TOK}, l AS (SELECT lag(normalized) OVER (PARTITION BY doc_id ORDER BY pos) AS \"left\", normalized AS \"right\" FROM tok) SELECT \"left\", \"right\", count(*) AS cnt FROM l WHERE \"left\" IS NOT NULL GROUP BY 1, 2",
    "lm_prune": f"WITH {TOK}, l AS (SELECT lag(normalized) OVER (PARTITION BY doc_id ORDER BY pos) AS \"left\", normalized AS \"right\" FROM tok) SELECT \"left\", \"right\", count(*) AS cnt FROM l WHERE \"left\" IS NOT NULL GROUP BY 1, 2 ORDER BY cnt DESC, \"left\" DESC, \"right\" DESC LIMIT 30000",
    "lm_context_score": f"""WITH {TOK}, {BENCH}, bw AS MATERIALIZED (SELECT DISTINCT normalized AS w FROM tokb), u AS MATERIALIZED (SELECT normalized AS w, count(*) AS c FROM tok WHERE normalized IN (SELECT w FROM bw) GROUP BY 1),
p AS MATERIALIZED (SELECT l, r, count(*) AS c FROM (SELECT lag(normalized) OVER (PARTITION BY doc_id ORDER BY pos) AS l, normalized AS r FROM tok) WHERE l IN (SELECT w FROM bw) AND r IN (SELECT w FROM bw) GROUP BY 1, 2),
t AS MATERIALIZED (SELECT doc_id, pos, normalized AS w, lag(normalized) OVER o AS pv, lead(normalized) OVER o AS nx FROM tokb WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
s AS (SELECT doc_id, pos, CASE WHEN pv IS NULL THEN 0 ELSE least(1, (coalesce(a.c, 0) + 1.0) / (coalesce(ua.c, 0) + 48.0) * 6.0) END AS x, CASE WHEN nx IS NULL THEN 0 ELSE least(1, (coalesce(b.c, 0) + 1.0) / (coalesce(ub.c, 0) + 48.0) * 6.0) END AS y
  FROM t LEFT JOIN p a ON a.l = pv AND a.r = t.w LEFT JOIN p b ON b.l = t.w AND b.r = nx LEFT JOIN u ua ON ua.w = pv LEFT JOIN u ub ON ub.w = t.w)
SELECT doc_id, pos, round(CASE WHEN x > 0 AND y > 0 THEN (x::DOUBLE + y::DOUBLE) / 2 ELSE greatest(x, y)::DOUBLE END, 9) AS context FROM s""",
    "lm_priors": f"""WITH {TOK}, u AS (SELECT normalized AS word, count(*) AS c FROM tok GROUP BY 1), f AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS at FROM u ORDER BY word LIMIT 5000)
SELECT u.word, round((CASE WHEN f.at IS NULL THEN 0.30::DOUBLE ELSE 0.35::DOUBLE + 0.25::DOUBLE * (1 - f.at::DOUBLE / (SELECT greatest(1, count(*) - 1) FROM f)) END) * 0.65::DOUBLE + c / (c + 8.0::DOUBLE) * 0.35::DOUBLE, 9) AS prior FROM u LEFT JOIN f USING (word)""",
    "lm_learn": f"""WITH {TURNS}, e AS (SELECT {KEY.format('reverse(normalized)')} AS s, {KEY.format('normalized')} AS r, {KEY.format('lag(normalized) OVER o')} AS pv, {KEY.format('lead(normalized) OVER o')} AS nx FROM tokb WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
p AS (SELECT pv AS a, r AS b, 2 AS w FROM e WHERE pv IS NOT NULL UNION ALL SELECT r, nx, 1 FROM e WHERE nx IS NOT NULL)
SELECT 'unigram' AS kind, r AS word, '' AS other, (2 * count(*))::BIGINT AS cnt FROM e GROUP BY ALL UNION ALL SELECT 'bigram', a, b, sum(w)::BIGINT FROM p GROUP BY ALL UNION ALL SELECT 'correction', s, r, count(*) FROM e GROUP BY ALL""",
    "validate_dictionary": r"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS word FROM documents)
SELECT CASE WHEN trim(word) = '' THEN 'blank' WHEN starts_with(word, '#') THEN 'comment' WHEN contains(word, chr(13)) THEN 'line_break' ELSE 'control' END AS problem, word FROM l
WHERE trim(word) = '' OR starts_with(word, '#') OR regexp_matches(word, '[\p{Cc}\p{Cf}]') UNION ALL SELECT 'repeated', lower(word) FROM l WHERE trim(word) <> '' GROUP BY lower(word) HAVING count(*) > 1""",
}
