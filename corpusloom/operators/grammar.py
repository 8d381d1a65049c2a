"""Grammar rules: each is a detector from documents or analysed tokens to error rows.

An error row is ``(doc_id, rule_id, word, start_index, end_index, paragraph_index, suggestion, distance)``; ``enrich`` adds
severity and category by the rule table, and a context.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import data
from ..functions import morph as M
from ..functions import text as T
from ..functions import translit, tries
from . import spelling
from . import tokens as K

COLUMNS = ["doc_id", "rule_id", "word", "start_index", "end_index", "paragraph_index", "suggestion", "distance"]
# Subject pronouns and the ending their verb takes, and the copula. Compared in Cyrillic.
PRONOUNS = {"мен": "ман", "сен": "сан", "биз": "миз", "сиз": "сиз"}
LATIN_PRONOUNS = {"men": "ман", "sen": "сан", "biz": "миз", "siz": "сиз"}
COPULAS, ENDINGS = ("эмас", "emas"), ("ман", "сан", "миз", "сиз", "man", "san", "miz", "siz")
BRACKETS = {"(": ")", "[": "]", "{": "}", "«": "»"}
QUOTE = '"'
ERRORS = "array<struct<rule_id:string,word:string,start_index:int,end_index:int,paragraph_index:int,suggestion:string,distance:int>>"


def error(rule: str, word: Column, start: Column, end: Column, paragraph: Column, suggestion: Column | None = None, distance: Column | int = 1) -> Column:
    """An error as a struct."""
    return F.struct(
        F.lit(rule).alias("rule_id"), word.alias("word"), start.alias("start_index"), end.alias("end_index"), paragraph.alias("paragraph_index"),
        (F.lit(None).cast("string") if suggestion is None else suggestion).alias("suggestion"), (F.lit(distance) if isinstance(distance, int) else distance).alias("distance"),
    )


def token_error(rule: str, suggestion: Column | None = None, word: Column | None = None, end: Column | None = None) -> Column:
    return error(rule, F.col("original") if word is None else word, F.col("start_index"), F.col("end_index") if end is None else end, F.col("paragraph_index"), suggestion)


def rows_of(df: DataFrame, *arrays: Column) -> DataFrame:
    """The errors of all arrays, a row each: rules that look at the same rows share one pass over them."""
    return df.select("doc_id", F.explode(F.concat(*arrays)).alias("e")).select("doc_id", "e.*")


def if_so(condition: Column, e: Column) -> Column:
    """An array of one error, or none."""
    return F.filter(F.array(F.when(condition, e)), lambda x: x.isNotNull())


def rows_where(tokens: DataFrame, *rules: tuple[Column, Column]) -> DataFrame:
    """The errors of rules that are a condition and an error each: only rows on which one of them holds are gone through by rule."""
    some = reduce(lambda a, b: a | b, [condition for condition, _ in rules])
    return rows_of(tokens.where(some), *(if_so(*rule) for rule in rules))


# Punctuation and style, from the text alone: arrays of errors of a text


def _of_spans(pattern: str, rule: str, paragraph: str, suggestion, distance=None) -> Column:
    made = K.spans(F.col("text"), pattern, paragraph)
    return F.transform(made, lambda x: error(rule, x["match"], x["start_index"], x["end_index"], x["paragraph_index"], suggestion(x["match"]), 1 if distance is None else distance(x["match"])))


def double_space_errors(paragraph: str = K.PARAGRAPH) -> Column:
    return _of_spans(" {2,}", "DOUBLE_SPACE", paragraph, lambda m: F.lit(" "), lambda m: F.char_length(m) - 1)


def comma_space_errors(paragraph: str = K.PARAGRAPH) -> Column:
    """A space before a comma; a comma that neither a space nor a digit follows, but at the text's end."""
    return F.concat(_of_spans(" ,", "COMMA_SPACE", paragraph, lambda m: F.lit(",")), _of_spans(r",(?=[^ \d])", "COMMA_SPACE", paragraph, lambda m: F.lit(", ")))


def period_space_errors(paragraph: str = K.PARAGRAPH) -> Column:
    return _of_spans(r"\.\p{Ll}", "PERIOD_SPACE", paragraph, lambda m: F.concat(F.lit(". "), T.upper(F.right(m, F.lit(1)))))


def bracket_errors(paragraph: str = K.PARAGRAPH) -> Column:
    """Brackets without a partner: a stack machine over the bracket characters alone, folded where the text lies.

    A quote closes if one is on top, else opens. A closing bracket that doesn't fit what is on top is an error and leaves
    the stack; what is left on the stack at the end is an error too, the last first.
    """
    opening, closing = "".join(BRACKETS), "".join(BRACKETS.values())
    none = F.array().cast("array<struct<match:string,start_index:int,end_index:int,paragraph_index:int>>")

    def step(s: Column, x: Column) -> Column:
        c, top = x["match"], F.get(s["stack"], F.size(s["stack"]) - 1)["match"]
        partner = F.when(c == QUOTE, F.lit(QUOTE)).otherwise(F.translate(c, closing, opening))
        closes = ~c.isin(*opening) & F.coalesce(top == partner, F.lit(False))
        odd = c.isin(*closing) & ~closes
        stack = F.when(closes, F.slice(s["stack"], F.lit(1), F.greatest(F.size(s["stack"]) - 1, F.lit(0)))).when(odd, s["stack"]).otherwise(F.array_append(s["stack"], x))
        return F.struct(stack.alias("stack"), F.when(odd, F.array_append(s["odd"], x)).otherwise(s["odd"]).alias("odd"))

    left = F.aggregate(K.spans(F.col("text"), r"[(\[{«)\]}»" + QUOTE + "]", paragraph), F.struct(none.alias("stack"), none.alias("odd")), step)
    bad = T.let(left, lambda s: F.concat(s["odd"], F.reverse(s["stack"])))
    return F.transform(bad, lambda x: error("BRACKET_MATCH", x["match"], x["start_index"], x["end_index"], x["paragraph_index"]))


def double_space(docs: DataFrame) -> DataFrame:
    return rows_of(docs, double_space_errors())


def comma_space(docs: DataFrame) -> DataFrame:
    return rows_of(docs, comma_space_errors())


def period_space(docs: DataFrame) -> DataFrame:
    return rows_of(docs, period_space_errors())


def brackets(docs: DataFrame) -> DataFrame:
    return rows_of(docs, bracket_errors())


# Rules on tokens and their neighbours (``tokens.tokenize`` with gaps): when a token is wrong, and its error


def sentence_caps_errors() -> tuple[Column, Column]:
    """The text's first token, or one after a gap with an end of sentence, that starts in lower case."""
    starts = (F.col("pos") == 0) | F.col("gap_before").rlike(K.SENTENCE_END)
    return starts & F.col("original").rlike(r"^\p{Ll}"), token_error("SENT_CAPITALIZATION", T.capitalized(F.col("original")))


def repeated_word_errors() -> tuple[Column, Column]:
    """A word that is the one before, whatever stands between."""
    same = F.coalesce(T.normalize_token(F.col("previous")) == F.col("normalized"), F.lit(False))
    return same & ~T.skip_word(F.col("normalized")), token_error("REPEATED_WORD")


def _ahead(j: int) -> tuple[Column, Column, Column]:
    """The j-th next token: the gap before it, as it is written, and where it ends."""
    f = F.col("following")
    length = F.aggregate(F.slice(f, F.lit(1), F.lit(2 * j)), F.lit(0), lambda s, x: s + F.char_length(x))
    return F.get(f, 2 * j - 2), F.get(f, 2 * j - 1), F.col("end_index") + length


def copula_spacing_errors() -> tuple[Column, Column]:
    """The copula and its ending written apart; only blanks between, so that no sentence ends there."""
    gap, word, end = _ahead(1)
    apart = F.col("normalized").isin(*COPULAS) & T.normalize_token(word).isin(*ENDINGS) & gap.rlike(r"^\s+$")
    return F.coalesce(apart, F.lit(False)), token_error("COPULA_SPACING", F.concat("original", word), F.concat("original", gap, word), end)


def proper_nouns(nouns: list[str] | None = None) -> tuple[list[str], list[tuple[str, list[str]]]]:
    """Single names as they are written, and names of several words with their normalised words."""
    nouns = nouns or data.PROPER_NOUNS
    split = [(n, n.split()) for n in nouns]
    clean = lambda w: w.lower().translate(str.maketrans(T.APOSTROPHES, "'" * 4))
    return [n for n, parts in split if len(parts) == 1], [(n, [clean(p) for p in parts]) for n, parts in split if len(parts) > 1]


def proper_noun_errors(nouns: list[str] | None = None) -> tuple[Column, Column]:
    """Single proper nouns in lower case, by a look-up."""
    single, _ = proper_nouns(nouns)
    o = F.col("original")
    low = (F.char_length(o) >= 2) & ~o.rlike(r"^\p{Lu}") & F.lower(o).isin(sorted({n.lower() for n in single}))
    return low, token_error("PROPER_NOUN_CAPS", T.capitalized(o))


def proper_phrase_errors(paragraph: str = K.PARAGRAPH, nouns: list[str] | None = None) -> Column:
    """Proper nouns of several words, any of them in lower case, from the text alone: a trie of words is walked from those that begin a name.

    Names may be as long and as many as they like; two that end at one place are one error.
    """
    phrases = tries.Phrases(proper_nouns(nouns)[1])
    none = F.array().cast(ERRORS)
    if not phrases.longest:
        return none
    text = F.col("text")
    written = lambda c: f"[{T.APOSTROPHES}']" if c == "'" else tries._escaped(c)
    begins = rf"(?iu)(?<![{T.WORD_CLASS}]){tries.pattern(phrases.firsts, written)}(?![{T.WORD_CLASS}])"

    def found(s: Column) -> Column:
        first = F.when(F.get(s, 0).rlike("^" + T.TOKEN), 0).otherwise(1)
        starts = F.filter(F.transform(s, lambda x, i: F.when((i % 2 == first) & T.normalize_token(x).isin(phrases.firsts), i)), lambda i: i.isNotNull())

        def errors(at: Column) -> Column:
            place = lambda k: K.lower_half(F.get(at, k))

            def one(i: Column, e: Column) -> Column:
                words = F.transform(F.sequence(i, e["last"], F.lit(2)), lambda k: F.get(s, k))
                end = place(e["last"]) + F.char_length(F.get(s, e["last"]))
                wrong = error("PROPER_NOUN_CAPS", F.array_join(words, " "), place(i), end, K.upper_half(F.get(at, i)) + 1, e["display"])
                return F.when(F.exists(words, lambda w: w.rlike(r"^\p{Ll}")), wrong)

            return F.array_compact(F.flatten(F.transform(starts, lambda i: F.transform(phrases.ends(s, i), lambda e: one(i, e)))))

        return T.let(T.running_starts(F.transform(s, lambda x: K.measure(x, paragraph)), "long"), errors)

    return F.when(text.rlike(begins), T.let(F.regexp_extract_all(text, F.lit(T.SEGMENT), F.lit(0)), found)).otherwise(none)


def sentence_caps(tokens: DataFrame) -> DataFrame:
    return rows_where(tokens, sentence_caps_errors())


def repeated_word(tokens: DataFrame) -> DataFrame:
    return rows_where(tokens, repeated_word_errors())


def copula_spacing(tokens: DataFrame) -> DataFrame:
    return rows_where(tokens, copula_spacing_errors())


def proper_noun_caps(docs: DataFrame, nouns: list[str] | None = None, paragraph: str = K.PARAGRAPH) -> DataFrame:
    """Of texts: single names, and names of several words."""
    single = rows_where(K.tokenize(docs, paragraph=paragraph), proper_noun_errors(nouns))
    return single.unionByName(rows_of(docs, proper_phrase_errors(paragraph, nouns)))


# Rules on analysed tokens: tokens joined with ``morph.analyze`` of their distinct words


def _shown(word: Column) -> Column:
    """A correction, made in Cyrillic, in the script of the token."""
    return F.when(F.col("script") == "Latin", translit.to_latin(word)).otherwise(word)


def allomorph_errors(rule: str, ids: tuple[str, ...], expected: Column) -> Column:
    """Case endings of a known root that aren't the one the root asks for; what follows is kept."""

    def wrong(x: Column, i: Column) -> Column:
        rest = F.array_join(F.slice("suffixes", i + 2, F.greatest(F.size("suffixes"), F.lit(1))), "")
        return F.when(F.col("is_known_root") & x.isin(*ids) & (F.get("suffixes", i) != expected), token_error(rule, _shown(F.concat("root", expected, rest))))

    return F.filter(F.transform("suffix_ids", wrong), lambda x: x.isNotNull())


def dative_errors() -> Column:
    return allomorph_errors("DAT_ALLOMORPH", ("DAT_GA", "DAT_KA", "DAT_QA"), M.expected_dative(F.col("root")))


def locative_errors() -> Column:
    return allomorph_errors("LOC_VOICING", ("LOC_DA", "LOC_TA"), M.expected_locative(F.col("root")))


def ablative_errors() -> Column:
    return allomorph_errors("ABL_VOICING", ("ABL_DAN", "ABL_TAN"), M.expected_ablative(F.col("root")))


def double_plural_errors() -> Column:
    return if_so(F.size(F.filter("suffix_ids", lambda x: x.isin(*M.PLURALS))) >= 2, token_error("DOUBLE_PLURAL"))


def possessive_errors() -> Column:
    """A root in the lexicon that ends hard before a possessive."""
    last = F.right("root", F.lit(1))
    hard = F.col("is_known_root") & F.col("root_in_lexicon") & F.exists("suffix_ids", lambda x: x.startswith("POSS_")) & last.isin(*M.SOFTENED)
    soft = F.concat(F.left(F.col("root"), F.char_length("root") - 1), F.translate(last, "".join(M.SOFTENED), "".join(M.SOFTENED.values())))
    return if_so(hard, token_error("POSS_MUTATION", _shown(F.concat(soft, F.array_join("suffixes", "")))))


def verb_agreement(analysed_sentences: DataFrame) -> DataFrame:
    """Of a sentence with a subject pronoun, the last verb if it has an ending, but not the pronoun's.

    Takes all tokens with ``sentence_id``, and analyses where they have one. Pronoun and verb come from one aggregation,
    combined before its shuffle.
    """
    endings = F.create_map(*(F.lit(x) for kv in (PRONOUNS | LATIN_PRONOUNS).items() for x in kv))
    known = F.when(F.col("normalized").isin(*PRONOUNS, *LATIN_PRONOUNS), F.struct("pos", "normalized"))
    verb = F.when(F.col("part_of_speech") == "verb", F.struct("pos", "original", "cyrillic", "suffix_ids", "start_index", "end_index", "paragraph_index"))
    by = analysed_sentences.groupBy("doc_id", "sentence_id").agg(F.min(known).alias("p"), F.max(verb).alias("v"), F.count(F.lit(1)).alias("n")).where("n >= 2 and p is not null and v is not null")
    wrong = by.where(~F.col("v.cyrillic").endswith(F.element_at(endings, F.col("p.normalized"))) & F.exists("v.suffix_ids", lambda x: x.startswith("AGR_")))
    return rows_of(wrong.select("doc_id", "v.*"), F.array(token_error("VERB_AGREEMENT")))


# All rules


def rules_table(spark: SparkSession, rules: list[tuple] | None = None) -> DataFrame:
    """Rules in order of priority; of rules that share an id the first holds."""
    first: dict[str, tuple] = {}
    for r in sorted(rules or data.RULES, key=lambda r: r[2]):
        first.setdefault(r[0], r)
    return spark.createDataFrame(list(first.values()), "rule_id string, category string, priority int, enabled boolean, severity string")


def enabled_rules(rules: list[tuple] | None = None, disabled: tuple[str, ...] = ()) -> set[str]:
    first: dict[str, bool] = {}
    for r in sorted(rules or data.RULES, key=lambda r: r[2]):
        first.setdefault(r[0], r[3])
    return {rule for rule, on in first.items() if on and rule not in disabled}


TEXT_RULES = [("DOUBLE_SPACE", double_space_errors), ("COMMA_SPACE", comma_space_errors), ("PERIOD_SPACE", period_space_errors), ("BRACKET_MATCH", bracket_errors), ("PROPER_NOUN_CAPS", proper_phrase_errors)]
TOKEN_RULES = {"SENT_CAPITALIZATION": sentence_caps_errors, "REPEATED_WORD": repeated_word_errors, "COPULA_SPACING": copula_spacing_errors, "PROPER_NOUN_CAPS": proper_noun_errors}
WORD_RULES = {"DAT_ALLOMORPH": dative_errors, "LOC_VOICING": locative_errors, "ABL_VOICING": ablative_errors, "DOUBLE_PLURAL": double_plural_errors, "POSS_MUTATION": possessive_errors}


def word_errors(docs: DataFrame, words: DataFrame, *arrays: Column, paragraph: str = K.PARAGRAPH) -> DataFrame:
    """Errors of rules on analysed ``words``, which look at the word alone: those that are wrong are found before any token is.

    Each document's own wrong words move to its text, so that tokens never move.
    """
    nowhere = {"original": F.col("normalized"), **{c: F.lit(0) for c in ("start_index", "end_index", "paragraph_index")}}
    wrong = words.withColumns(nowhere).where(F.size(F.concat(*arrays)) > 0).drop(*nowhere)
    each = spelling.words_by_document(docs, F.xxhash64("doc_id").alias("_h"))
    found = spelling.found_in(docs, each.join(wrong.select("normalized"), F.col("word") == F.col("normalized"), "left_semi"), paragraph=paragraph)
    return rows_of(found.withColumnsRenamed({"word": "normalized", "original_text": "original"}).join(wrong, "normalized"), *arrays)


def with_pronouns(docs: DataFrame, paragraph: str = K.PARAGRAPH) -> DataFrame:
    """All tokens of the sentences that have a subject pronoun; texts without one are passed over by one look."""
    pronouns = (*PRONOUNS, *LATIN_PRONOUNS)
    some = docs.where(F.col("text").rlike(rf"(?iu)(?<![{T.WORD_CLASS}])(?:{'|'.join(pronouns)})(?![{T.WORD_CLASS}])"))
    tokens = K.tokenize(some, paragraph=paragraph, gaps=("sentence_id",))
    theirs = tokens.where(F.col("normalized").isin(*pronouns)).select(F.col("doc_id").alias("_d"), F.col("sentence_id").alias("_s")).distinct()
    return tokens.join(theirs, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("sentence_id") == F.col("_s")), "left_semi")


def check(docs: DataFrame, lexicon: DataFrame, disabled: tuple[str, ...] = (), paragraph: str = K.PARAGRAPH) -> DataFrame:
    """Errors of all rules that are enabled: one pass for the rules on texts, one for those on tokens, one for those on words.

    Only words with a suffix are of interest to the last, and words are analysed once each; only sentences with a pronoun are to
    verb agreement.
    """
    on = enabled_rules(disabled=disabled)
    parts = []
    if chosen := [f(paragraph) for rule, f in TEXT_RULES if rule in on]:
        parts.append(rows_of(docs, *chosen))
    if chosen := [f() for rule, f in TOKEN_RULES.items() if rule in on]:
        parts.append(rows_where(K.tokenize(docs, paragraph=paragraph, gaps=("gap_before", "previous", "following")), *chosen))
    checked = spelling.words_by_document(docs).where(~T.skip_word(F.col("word")))
    words = M.analyze(checked.select(F.col("word").alias("normalized")), lexicon).where(F.size("suffix_ids") > 0)
    if chosen := [f() for rule, f in WORD_RULES.items() if rule in on]:
        parts.append(word_errors(docs, words, *chosen, paragraph=paragraph))
    if "VERB_AGREEMENT" in on:
        verbs = words.where("part_of_speech = 'verb'").select("normalized", "cyrillic", "suffix_ids", "part_of_speech")
        parts.append(verb_agreement(with_pronouns(docs, paragraph).join(verbs, "normalized", "left")))
    return reduce(DataFrame.unionByName, [p.select(*COLUMNS) for p in parts])


def enrich(errors: DataFrame) -> DataFrame:
    """Errors with ``severity``, ``category`` and ``priority`` of their rule; an unknown rule is one of grammar."""
    rules = rules_table(errors.sparkSession).drop("enabled")
    return errors.join(F.broadcast(rules), "rule_id", "left").withColumn("severity", F.coalesce("severity", F.lit("Grammar")))


def with_context(errors: DataFrame, docs: DataFrame, radius: int = 25) -> DataFrame:
    both = K.with_text(errors, docs)
    return both.withColumn("context", T.grammar_context(F.col("text"), F.col("start_index"), radius)).drop("text")
