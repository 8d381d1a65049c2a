"""Golden rows and properties of the expressions, readers, writers and rewrites."""

import functools
import itertools
import json
import random
import time

import pytest
from corpusloom import data
from corpusloom.functions import collation, morph, translit
from corpusloom.functions import text as T
from corpusloom.operators import grammar, language_model, lexicon, reports, rewrite, spelling, suggest
from corpusloom.operators import tokens as K
from corpusloom.sources import readers, writers
from pyspark.sql import functions as F


def values(spark, words, column):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    return [r.x for r in df.select("i", column(F.col("w")).alias("x")).orderBy("i").collect()]


def pairs(spark, rows, column):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a string, b string")
    return [r.x for r in df.select("i", column(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()]


def osa(a, b):
    @functools.cache
    def d(i, j):
        if not i or not j:
            return i + j
        best = min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            best = min(best, d(i - 2, j - 2) + 1)
        return best

    return d(len(a), len(b))


def test_normalize(spark):
    got = values(spark, ["  Hello!  ", "...word...", "   ", None, "o'zbek", "oʻzbek", "oʼzbek", "o‘zbek", "o’zbek", "'test'"], T.normalize_word)
    assert got == ["hello", "word", "", ""] + ["o'zbek"] * 5 + ["'test'"]
    again = values(spark, got, T.normalize_word)
    assert again == got


def test_tokens_have_their_places(spark):
    texts = ["O‘zbek va gʼisht", "a\nb, c\n\nd.E 12", "", None, "...", "x" * 50 + "\n" + "word, " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = K.tokenize(docs, gaps=True).orderBy("doc_id", "pos").collect()
    assert [r.normalized for r in rows if r.doc_id == 0] == ["o'zbek", "va", "g'isht"]
    for r in rows:
        text = texts[r.doc_id]
        assert text[r.start_index : r.end_index] == r.original
        assert r.paragraph_index == 1 + text[: r.start_index].count("\n")
        assert text[: r.start_index].endswith(r.gap_before) and text[r.end_index : r.end_index + 1] == r.next_char
    assert [r.pos for r in rows if r.doc_id == 5] == list(range(301))


def test_matches_have_their_places(spark):
    import re

    texts = ["a,b, c,1,,x", " ,x  y", ",,", "none", None, "\n  \n   z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for pattern in (",", " {2,}", r",(?=[^ \d])"):
        got = sorted((r.doc_id, r.start_index, r.end_index, r.paragraph_index) for r in K.matches(docs, pattern).collect())
        assert got == [(i, m.start(), m.end(), 1 + t[: m.start()].count("\n")) for i, t in enumerate(texts) if t for m in re.finditer(pattern, t)]


def test_distances(spark):
    r = random.Random(1)
    rows = [("kitob", "kiotb"), ("ca", "abc"), ("abc", "uvwxyz"), ("a", "a")] + [("".join(r.choice("abc") for _ in range(r.randint(1, 7))), "".join(r.choice("abc") for _ in range(r.randint(1, 7)))) for _ in range(200)]
    full, bounded = pairs(spark, rows, T.osa_full), pairs(spark, rows, lambda a, b: T.bounded_edit_distance(a, b, F.lit(2)))
    assert full == [osa(a, b) for a, b in rows] and full[:2] == [1, 3]
    assert bounded == [min(3, osa(a, b)) if abs(len(a) - len(b)) <= 2 else 3 for a, b in rows]
    assert pairs(spark, rows, T.edit_distance) == [abs(len(a) - len(b)) if abs(len(a) - len(b)) > 3 else osa(a, b) for a, b in rows]
    swapped = pairs(spark, rows, T.adjacent_transposition)
    assert swapped == [len(a) == len(b) and a != b and any(a[:i] + a[i + 1] + a[i] + a[i + 2 :] == b for i in range(len(a) - 1)) for a, b in rows]
    prefix = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert pairs(spark, rows, T.common_prefix) == [prefix(a, b) for a, b in rows]
    assert pairs(spark, rows, T.common_suffix) == [prefix(a[::-1], b[::-1]) for a, b in rows]


def test_phonetics(spark):
    assert pairs(spark, [("хона", "ҳона"), ("кор", "қор"), ("абв", "абг"), ("хк", "ҳқ"), ("ххх", "ҳҳҳ"), ("о", "ў")], T.phonetically_similar) == [True, True, False, True, False, True]
    assert sorted(values(spark, ["хок"], T.phonetic_variants)[0]) == sorted(["ҳок", "хўк", "хоқ"])


def test_gate_is_lossy_and_can_be_lossless(spark):
    queries, words = spark.createDataFrame([("kitob",)], "query string"), spark.createDataFrame([("kutib",), ("kitoblar",), ("kiotb",)], "word string")
    assert {r.word for r in suggest.candidates(queries, words).collect()} == set()
    assert {(r.word, r.distance) for r in suggest.candidates(queries, words, "lossless").collect()} == {("kutib", 2), ("kiotb", 1)}


BOUND = lambda q: 1 if len(q) <= 4 else 2 if len(q) <= 8 else 3


def frames(spark, queries, words):
    return spark.createDataFrame([(q,) for q in queries], "query string"), spark.createDataFrame([(w,) for w in words], "word string")


@pytest.mark.parametrize("letters", ["abcde", "ab", "китобларўғ'"])
def test_suggestions_are_brute_force(spark, letters):
    """Segments lose none of what a comparison of all pairs finds, and the usual gate leaves out what shares few bigrams."""
    r = random.Random(3)
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(1, 12)))

    def mistyped(w):
        w = list(w)
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(w) + 1)
            kind = r.randrange(4)
            if kind == 0:
                w.insert(i, r.choice(letters))
            elif kind == 1 and i < len(w) > 1:
                del w[i]
            elif kind == 2 and i < len(w):
                w[i] = r.choice(letters)
            elif i + 1 < len(w):
                w[i], w[i + 1] = w[i + 1], w[i]
        return "".join(w)

    lex = sorted({word() for _ in range(250)})
    ask = sorted({word() for _ in range(40)} | {mistyped(w) for w in lex[::2]})
    near = {(q, w, osa(q, w)) for q in ask for w in lex if 0 < osa(q, w) <= BOUND(q)}
    rows = lambda gate: {(x.query, x.word, x.distance) for x in suggest.candidates(*frames(spark, ask, lex), gate).collect()}
    variants = {(q, v, 1) for q in ask for v in phonetic(q) if v in lex}
    assert rows("lossless") == {x for x in near if (x[0], x[1], 1) not in variants} | variants
    grams = lambda w: [w[i : i + 2] for i in range(len(w) - 1)]
    shares = lambda q, w: sum(grams(w).count(g) for g in grams(q))
    gated = {x for x in near if len(x[0]) - 1 - BOUND(x[0]) < 1 or shares(x[0], x[1]) >= len(x[0]) - 1 - BOUND(x[0])}
    assert rows("reference") == {x for x in gated if (x[0], x[1], 1) not in variants} | variants


def phonetic(word):
    return {word[:i] + T.CONFUSABLE[c] + word[i + 1 :] for i, c in enumerate(word) if c in T.CONFUSABLE}


def test_swaps_across_segments(spark):
    """Each swap of neighbours is found, alone and with another edit, wherever segments end."""
    lex = ["abcdefghijkl", "abcdefg", "abcd", "ab"]
    ask = {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for w in lex for i in range(len(w) - 1)}
    ask |= {q[:i] + "z" + q[i + 1 :] for q in ask if len(q) > 4 for i in range(len(q))}
    got = {(x.query, x.word) for x in suggest.candidates(*frames(spark, sorted(ask), lex), "lossless").collect()}
    assert got >= {(q, w) for q in ask for w in lex if 0 < osa(q, w) <= BOUND(q)}


def test_ranking_with_a_model(spark):
    """Context, history and priors decide between candidates that are equally near."""
    asks = spark.createDataFrame([("katta", "juda", "uy"), ("katta", "", "")], "query string, prev string, next string")
    near = spark.createDataFrame([("katta", "kattu", 1), ("katta", "katti", 1)], "query string, word string, distance int")
    counts = {
        "unigrams": spark.createDataFrame([("juda", 10), ("kattu", 1), ("katti", 5)], "word string, cnt long"),
        "bigrams": spark.createDataFrame([("juda", "kattu", 30)], "left string, right string, cnt long"),
        "corrections": spark.createDataFrame([("katta", "katti", 3)], "source string, target string, cnt long"),
    }
    got = {(r.prev, r.word): r for r in suggest.with_model(asks, near, counts).collect()}
    pair, single = min(1.0, 31 / 58 * 6), min(1.0, 1 / 49 * 6)
    assert got["juda", "kattu"].context == pytest.approx((pair + single) / 2) and got["", "kattu"].context == 0
    assert got["", "katti"].history == pytest.approx(0.06) and got["", "katti"].prior == pytest.approx(0.65 * 0.30 + 0.35 * 5 / 13)
    assert got["juda", "kattu"].reason == "CONTEXT_BIGRAM" and got["juda", "katti"].reason == "USER_ACCEPTED_HISTORY"
    q, w, d, one = F.col("query"), F.col("word"), F.col("distance"), suggest.with_model(asks, near, counts)
    whole = suggest.rank_score(q, w, d, T.max_distance(q), F.col("prior"), F.col("context"), F.col("history"))
    assert one.where(F.abs(whole - F.col("rank_score")) > 1e-9).count() == 0
    assert one.count() == 4 and suggest.rank(one, 1, ("query", "prev")).count() == 2


def test_transliteration(spark):
    latin = {"kitob": "китоб", "o'zbek": "ўзбек", "oʻzbek": "ўзбек", "g'isht": "ғишт", "shahar": "шаҳар", "mas'ul": "масъул", "sur'at": "суръат", "qat'iy": "қатъий", "'test'": "'тест'", "yo'l": "ё'л", "qo'ng'iroq": "қўнг'ироқ", "eshik": "ешик", "tsirk": "тсирк", "web": "wеб", "COVID-19": "КОВИД-19", "Farg'ona": "Фарғона", "NATO nato Nato": "НАТО нато Нато", "iPhone": "ипҳоне"}
    assert values(spark, list(latin), lambda w: translit.to_cyrillic(w, data.EXCEPTIONS)) == list(latin.values())
    cyrillic = {"китоб": "kitob", "ўзбек": "oʻzbek", "ғишт": "gʻisht", "масъул": "masʻul", "суръат": "surʻat", "октябрь": "oktabr", "ЮРИДА": "YURIDA", "Юрида": "Yurida", "компьютер": "kompyuter", "цирк, поезд!": "sirk, poyezd!"}
    assert values(spark, list(cyrillic), translit.to_latin) == list(cyrillic.values())
    assert values(spark, ["o'zbek", "mas'ul", "'a'", "G`oz"], translit.normalize_apostrophes) == ["o‘zbek", "mas’ul", "'a'", "G‘oz"]
    assert values(spark, ["o'zbek", "mas’ul", "o‘zbek a'b"], translit.apostrophe_edits) == [1, 0, 1]


def test_scripts(spark):
    assert values(spark, ["", "12", "аб", "абвгd", "абвгдежd", "hello", "ab", "aб", "abв г"], T.detect_script) == ["Unknown", "Unknown", "Cyrillic", "Mixed", "Cyrillic", "Latin", "Latin", "Unknown", "Mixed"]
    assert values(spark, ["BMT", "a", "12", "word", "a-b", "x(y", "o'z", ""], T.skip_word) == [True, True, True, False, False, True, False, True]
    assert values(spark, ["salom dunyo", "salom, ", "x", ""], T.previous_word) == ["dunyo", "salom", "x", ""]


def test_collation(spark):
    words = ["zar", "char", "dala", "bola", "shar", "sar", "tosh", "nur", "ngor", "ona", "o'zbek", "pul", "қор", "кор", "ғоз", "гул", "ъ", "w"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = [r.word for r in lexicon.sort(df).collect()]
    assert got == ["гул", "ғоз", "кор", "қор", "ъ", "bola", "char", "dala", "nur", "ngor", "ona", "o'zbek", "pul", "sar", "shar", "tosh", "zar", "w"]
    assert df.select(collation.sort_key(F.lit(None).cast("string")).alias("k")).first().k is None


def test_morphology(spark):
    expected = {"тоғ": ("қа", "да", "дан"), "мактаб": ("га", "да", "дан"), "юрак": ("ка", "та", "тан"), "дарахт": ("га", "та", "тан")}
    for f, k in ((morph.expected_dative, 0), (morph.expected_locative, 1), (morph.expected_ablative, 2)):
        assert values(spark, list(expected), f) == [v[k] for v in expected.values()]


def test_brackets(spark):
    texts = ["(a]b)", '"a (b" c)', "((", "«a» [b] {c}", 'say "hi" now', ")("]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def brute(t):
        stack, odd, close = [], [], {")": "(", "]": "[", "}": "{", "»": "«"}
        for i, c in enumerate(t):
            if c == '"':
                stack.pop() if stack and stack[-1][0] == c else stack.append((c, i))
            elif c in "([{«":
                stack.append((c, i))
            elif c in close:
                stack.pop() if stack and stack[-1][0] == close[c] else odd.append(i)
        return sorted(odd + [i for _, i in stack])

    got = {i: [] for i in range(len(texts))}
    for r in grammar.brackets(docs).collect():
        got[r.doc_id].append(r.start_index)
    assert {i: sorted(v) for i, v in got.items()} == {i: brute(t) for i, t in enumerate(texts)}


def test_grammar_rules(spark):
    docs = spark.createDataFrame([(1, "Мен мактабтан бордасан. дарахтдан китобларлар."), (2, "У эмас  ман. тошкент шаҳар"), (3, "сен бораман"), (4, "Амир темур келди келди")], "doc_id long, text string")
    lex = spark.createDataFrame([(w,) for w in ("китоб", "мактаб", "дарахт", "бор", "тоғ")], "word string")
    got = {(r.doc_id, r.rule_id, r.suggestion) for r in grammar.enrich(grammar.check(docs, lex)).collect()}
    assert {(1, "ABL_VOICING", "мактабдан"), (1, "ABL_VOICING", "дарахттан"), (1, "DOUBLE_PLURAL", None), (2, "COPULA_SPACING", "эмасман"), (2, "PROPER_NOUN_CAPS", "Тошкент"), (3, "VERB_AGREEMENT", None), (3, "SENT_CAPITALIZATION", "Сен"), (4, "PROPER_NOUN_CAPS", "Амир Темур"), (4, "REPEATED_WORD", None)} <= got
    assert not [r for r in grammar.check(docs, lex, ("REPEATED_WORD",)).collect() if r.rule_id == "REPEATED_WORD"]


def test_replace_all(spark):
    docs = spark.createDataFrame([(1, "kiotb other"), (2, "x"), (3, None)], "doc_id long, text string")
    fixes = spark.createDataFrame([(1, 0, 5, "kiotb", "kitob"), (1, 6, 11, "kiotb", "kitob"), (1, 0, 3, "kio", "no"), (3, 0, 1, "a", "b")], "doc_id long, start_index int, end_index int, original_text string, replacement string")
    got = {r.doc_id: (r.text, r.replaced, r.skipped) for r in rewrite.replace_all(docs, fixes).collect()}
    assert got[1] == ("kitob other", 1, 2) and got[2] == ("x", 0, 0) and got[3][0] is None
    assert values(spark, ["a  b \n c", "a\tb"], translit.cleanup_spaces) == ["a b\nc", "a\tb"]


def test_replace_all_is_brute_force(spark):
    """Overlaps, missing texts, odd places, characters beyond the basic plane; and many fixes in one long text."""
    r = random.Random(2)
    docs, fixes, want = [], [], {}
    for d in range(30):
        text = "".join(r.choice("ab \n😀é") for _ in range(r.choice([0, 5, 600])))
        own = []
        for _ in range(r.randint(0, 40)):
            a = r.randint(-1, len(text) + 1)
            b = a + r.randint(0, 5)
            own.append((a, b, text[max(0, a) : b] if r.random() < 0.8 else "zz", r.choice(["X", "yy", "😀"])))
        out, at, done = text, len(text) + 9, 0
        for a, b, old, new in sorted(own, reverse=True):
            if 0 <= a and b <= len(text) and text[a:b] == old and b <= at:
                out, at, done = out[:a] + new + out[b:], a, done + 1
        want[d] = (out, done, len(own) - done)
        docs.append((d, text))
        fixes += [(d, *f) for f in own]
    long = "word " * 20000
    docs.append((99, long))
    fixes += [(99, 5 * i, 5 * i + 4, "word", "w") for i in range(20000)]
    want[99] = ("w " * 20000, 20000, 0)
    frame = spark.createDataFrame(fixes, "doc_id long, start_index int, end_index int, original_text string, replacement string")
    began = time.time()
    got = {x.doc_id: (x.text, x.replaced, x.skipped) for x in rewrite.replace_all(spark.createDataFrame(docs, "doc_id long, text string"), frame).collect()}
    assert got == want and time.time() - began < 30


def test_own_errors_are_errors(spark):
    docs = spark.createDataFrame([(1, "kitob uy қалам китоб"), (2, "uy Kitob kitb"), (3, "qalam UY x")], "doc_id long, text string")
    for n in (1, 2, 3):
        assert sorted(map(tuple, spelling.own_errors(docs, n).collect())) == sorted(map(tuple, spelling.errors(docs, spelling.lexicon_of(docs, n)).collect()))


def test_own_errors_move_no_tokens(spark):
    """Rare words of up to three documents, of repeated and null keys, and with letters whose lower case hangs on the word."""
    r = random.Random(4)
    words = ["kitob", "uy", "ΑΣ", "Σας", "İzmir", "O‘zbek", "ẞe", "don't"] + ["w" + "".join(r.choice("abcş") for _ in range(3)) for _ in range(150)]
    rows = [(r.choice([i, i // 2, None]), "".join(r.choice(words) + r.choice([" ", ".\n", ", "]) for _ in range(r.randint(0, 9)))) for i in range(60)]
    docs = spark.createDataFrame([*rows, (99, None)], "doc_id long, text string")
    for n in (1, 2, 3, 4, 5):
        got = spelling.own_errors(docs, n)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, spelling.errors(docs, spelling.lexicon_of(docs, n)).collect()))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert n == 5 or "Exchange" not in plan[: plan.index("MapInArrow")]


def test_neighbours_of_tokens(spark):
    """What stands around tokens, all of it or by name, against what a plain walk finds; more documents than are summed up at once."""
    import re

    r = random.Random(6)
    docs = [(i, "".join(r.choice(["Ab", "o'z", "😀", ". ", "!", " ", "\n", "ғa"]) for _ in range(r.randint(0, 12)))) for i in range(600)]
    want = set()
    for i, text in docs:
        found = [(m.group(), m.start(), m.end()) for m in re.finditer("[Aboz'ғa]+", text)]
        parts = re.findall("[Aboz'ғa]+|[^Aboz'ғa]+", text)
        first = 0 if found and found[0][1] == 0 else 1
        for n, (w, a, b) in enumerate(found):
            at = 2 * n + first
            stops = sum(text[e : e + 1] in (".", "!") and bool(text[e : e + 1]) for _, _, e in found[:n])
            want.add((i, n, w, a, b, 1 + text[:a].count("\n"), parts[at - 1] if at else "", text[b : b + 1], found[n - 1][0] if n else None, tuple(parts[at + 1 : at + 5]), stops))
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = K.tokenize(frame, gaps=True, ahead=2).drop("normalized").collect()
    assert {tuple(tuple(v) if isinstance(v, list) else v for v in x) for x in got} == want and len(got) == len(want)
    assert K.tokenize(frame, gaps=("previous",)).columns[-2:] == ["paragraph_index", "previous"]


def test_grammar_moves_wrong_words_and_pronouns_alone(spark):
    """Words are judged before tokens are made, and verb agreement looks at sentences with a pronoun alone."""
    texts = ["Мен бордасан. nonlarlar бордасан", "бордасан", "siz. бораман", "СЕН бораман ва дарахтдан. мен", "nonlarlar X nonlarlar"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lex = spark.createDataFrame([("дарахт",), ("бор",)], "word string")
    assert sorted((x.doc_id, x.original) for x in grammar.with_pronouns(docs).collect()) == [(0, "Мен"), (0, "бордасан"), (2, "siz"), (3, "СЕН"), (3, "бораман"), (3, "ва"), (3, "дарахтдан"), (3, "мен")]
    got = sorted((x.doc_id, x.rule_id, x.start_index) for x in grammar.check(docs, lex, ("SENT_CAPITALIZATION",)).collect())
    assert got == [(0, "DOUBLE_PLURAL", 14), (0, "VERB_AGREEMENT", 4), (3, "ABL_VOICING", 15), (3, "VERB_AGREEMENT", 4), (4, "DOUBLE_PLURAL", 0), (4, "DOUBLE_PLURAL", 12)]


def test_records_and_headers():
    assert readers.records('Word;Definition\nkitob;"Bilim, manbai;\nIkkinchi satr"\n\n', ";") == [["Word", "Definition"], ["kitob", "Bilim, manbai;\nIkkinchi satr"]]
    assert [readers.find_delimiter(x) for x in ("a;b", "\n\na\tb;c", 'a,"b;c;d"', "word", "a;b,c")] == [";", "\t", ",", ",", ";"]
    assert readers.map_header(["№", "Сўз", "Изоҳ"]) == {"word": 1, "definition": 2, "spelling_rule": 2, "grammar_note": 3, "examples": 4}
    assert readers.map_header(["a", "b"]) is None
    assert readers.structured_line("kitob — a book")["definition"] == "a book" and readers.structured_line("a|b|c|d|x; y")["examples"] == ["x", "y"]
    assert readers.structured_line("no mark here") is None
    assert [r["word"] for r in readers.json_rows({"Words": ["a", {"term": "b", "izoh": "x", "items": ["c"]}], "items": ["never"]})] == ["a", "b", "c"]
    assert readers.decode("сўз".encode("cp1251", "replace")).startswith("с") and readers.decode("сўз".encode("utf-16")) == "сўз"


def test_import_files(spark, tmp_path):
    book = writers.xlsx_bytes(["Word", "Definition"], [["olma", "apple"], ["", "nothing"], ["nok<&>", None]])
    (tmp_path / "a.csv").write_text("word;meaning\nkitob;book\n", encoding="utf-8")
    (tmp_path / "b.xlsx").write_bytes(book)
    (tmp_path / "c.json").write_text(json.dumps({"entries": [{"word": "uy", "examples": ["x"]}]}))
    (tmp_path / "d.txt").write_bytes("дарахт — tree\nбир икки".encode("cp1251"))
    (tmp_path / "e.xls").write_bytes(b"old")
    (tmp_path / "f.xlsx").write_bytes(b"broken")
    (tmp_path / "g.pdf").write_bytes(b"not read")
    rows, status = readers.import_files(spark, str(tmp_path))
    assert sorted(r.word for r in rows.collect()) == sorted(["kitob", "olma", "nok<&>", "uy", "дарахт", "бир", "икки"])
    state = {r.file.rpartition("/")[2]: (r["rows"], r.error) for r in status.collect()}
    assert len(state) == 6 and state["e.xls"][1] and state["f.xlsx"][1] and state["b.xlsx"] == (2, None)
    texts = {r.file.rpartition("/")[2]: r.text for r in readers.text_files(spark, str(tmp_path / "d.txt")).collect()}
    assert texts["d.txt"].startswith("дарахт")


def test_word_lists(spark, tmp_path):
    (tmp_path / "w.dic").write_text("# head\n Kitob \nkitob\n\nolma\n", encoding="utf-8")
    words = readers.word_list(spark, str(tmp_path / "w.dic"))
    assert sorted(r.word for r in words.collect()) == ["kitob", "olma"]
    writers.write_word_list(spark.createDataFrame([("char",), ("dala",), ("bola",), ("кор",)], "word string"), str(tmp_path / "out"))
    lines = [x for p in sorted((tmp_path / "out").glob("part*")) for x in p.read_text(encoding="utf-8").split()]
    assert lines == ["кор", "bola", "char", "dala"]


def test_lexicon_changes(spark):
    user, main = (spark.createDataFrame([(w,) for w in ws], "word string") for ws in (["китоб", "kitob", "uy"], ["мактаб"]))
    rows = spark.createDataFrame([(0, "Kitob"), (1, "maktab"), (2, "olma"), (3, "олма"), (4, "olma"), (5, "12"), (6, None)], "ordinal int, word string")
    got = lexicon.classify_import(rows, main, user)
    assert [r.outcome for r in got.orderBy("ordinal").collect()] == ["in_user", "in_main", "added", "in_user", "in_user", "skipped", "skipped"]
    assert tuple(lexicon.import_counters(got).first()) == (5, 1, 1, 3)
    assert {r.word for r in lexicon.add_words(user, got).collect()} >= {"olma", "олма", "uy"}
    assert {r.word for r in lexicon.remove_words(user, spark.createDataFrame([("KITOB",)], "word string")).collect()} == {"uy"}


def test_words_of_one_script_with_one_search_form_are_added_each(spark):
    none = spark.createDataFrame([], "word string")
    rows = spark.createDataFrame([(0, "yesquell"), (1, "esquell"), (2, "есқуелл"), (3, "esquell")], "ordinal int, word string")
    got = lexicon.classify_import(rows, none, none)
    assert len({r.canonical for r in got.collect()}) == 1
    assert [r.outcome for r in got.orderBy("ordinal").collect()] == ["added", "added", "in_user", "in_user"]
    assert tuple(lexicon.import_counters(got).first()) == (4, 2, 0, 2)


def test_upper_case_keeps_a_words_length(spark):
    words = ["ßer", "maß", "abc", "ŉa", "ᾳx", "ﬁx", "юрак", "", None]
    assert values(spark, words, T.upper) == ["ẞER", "MAẞ", "ABC", "ŉA", "ᾼX", "ﬁX", "ЮРАК", "", None]
    docs = spark.createDataFrame([(1, "Abc. ßer x.ßa")], "doc_id long, text string")
    assert [r.suggestion for r in grammar.sentence_caps(K.tokenize(docs, gaps=True)).orderBy("start_index").collect()] == ["ẞer", "ẞa"]
    assert [r.suggestion for r in grammar.period_space(docs).collect()] == [". ẞ"]


def test_autocorrect_keeps_case_of_sharp_s(spark):
    from corpusloom.streaming import autocorrect

    turns = spark.createDataFrame([(1, "die Schzuungß "), (2, "SCHZUUNG ")], "conv_id long, text string")
    best = spark.createDataFrame([("schzuungß", "ßgnuuzhcs", 1, 0.9), ("schzuung", "gnuuzhßs", 1, 0.9)], "query string, suggestion string, distance int, score double")
    got = autocorrect.autocorrect(turns, spark.createDataFrame([], "word string"), best)
    assert [r.replacement for r in got.orderBy("conv_id").collect()] == ["ẞgnuuzhcs", "GNUUZHẞS"]


def test_autocorrect_capitalizes_after_any_capital(spark):
    from corpusloom.streaming import autocorrect

    turns = spark.createDataFrame([(1, "die SSer "), (2, "iPod "), (3, "Gnudl "), (4, "GNUDL "), (5, "STRAßE ")], "conv_id long, text string")
    best = spark.createDataFrame([("sser", "ress", 1, 0.9), ("ipod", "dopi", 1, 0.9), ("gnudl", "ldung", 1, 0.9), ("straße", "eßarts", 1, 0.9)], "query string, suggestion string, distance int, score double")
    got = autocorrect.autocorrect(turns, spark.createDataFrame([], "word string"), best)
    assert [r.replacement for r in got.orderBy("conv_id").collect()] == ["Ress", "dopi", "Ldung", "LDUNG", "Eßarts"]


def test_near_words_meet_by_most_of_their_letters(spark):
    """Short and long words against all pairs; of words that share common segments, few that aren't near meet."""
    from corpusloom.operators import near_words

    r = random.Random(5)
    base = ["".join(r.choice(["en", "ta", "mi", "s", "lo"]) for _ in range(r.choice([2, 4, 5, 9, 10]))) for _ in range(60)]
    words = sorted({w[:i] + r.choice(["", "x", w[i : i + 2][::-1]]) + w[i + r.choice([0, 1, 2]) :] for w in base for i in (r.randrange(len(w)), 0)} | set(base) | {"a"})
    asks = [(w, 1 if len(w) <= 4 else 2 if len(w) <= 8 else 3) for w in words]
    queries, lex = spark.createDataFrame(asks, "query string, reach int"), spark.createDataFrame([(w,) for w in words if w], "word string")
    got = near_words.near_pairs(queries, lex).select("query", "word", "reach", near_words.distance().alias("d")).collect()
    assert len({(x.query, x.word) for x in got}) == len(got)
    assert {(x.query, x.word, x.d) for x in got if x.d <= x.reach} == {(q, w, osa(q, w)) for q, t in asks for w in words if q and w and osa(q, w) <= t}
    assert max(len(w) for w in words) > near_words.LONG
    assert sorted(values(spark, ["abca"], lambda w: near_words.without(w, 2))[0]) == sorted({"abca", "bca", "aca", "aba", "abc", "ca", "ba", "bc", "aa", "ac", "ab"})
    # segments of these four-letter halves are all alike: as keys they make every word meet every other
    alike = [a + b for a in ("enta", "mita", "loen") for b in ("".join(x) for x in itertools.permutations(["en", "ta", "mi", "lo"]))]
    q, w = spark.createDataFrame([(x, 3) for x in alike], "query string, reach int"), spark.createDataFrame([(x,) for x in alike], "word string")
    assert {(x.query, x.word) for x in near_words.near_pairs(q, w).where("steps <= 3").collect()} >= {(a, b) for a in alike for b in alike if osa(a, b) <= 3}


def test_gated_pairs_are_brute_force(spark, monkeypatch):
    """Blocks, tables and chunks of any size find the same pairs: all that are near and share enough bigrams, repeats multiplied."""
    import pyarrow as pa

    from corpusloom.operators import gated_words as G

    r = random.Random(9)
    words = sorted({"".join(r.choice(["ha", "en", "ßa", "t", "語", "𝒂b"]) for _ in range(r.choice([1, 2, 4, 5, 6]))) for _ in range(250)} | {"a" * k for k in (1, 2, 15, 16, 19)})
    grams = lambda w: [w[i : i + 2] for i in range(len(w) - 1)]
    shares = lambda q, w: sum(grams(w).count(g) for g in grams(q))
    asks = [(w, BOUND(w)) for w in words if len(w) <= G.LONG]
    want = {(q, w, osa(q, w)) for q, t in asks for w in words if 0 < osa(q, w) <= t and shares(q, w) >= len(q) - 1 - t}
    got = G.gated_pairs(spark.createDataFrame(asks, "query string, reach int"), spark.createDataFrame([(w,) for w in words], "word string")).collect()
    assert len(got) == len(want) > 200 and {tuple(x) for x in got} == want
    for name, value in {"WIDTH": 24, "ROWS": 3, "PAIRS": 7}.items():
        monkeypatch.setattr(G, name, value)
    own = lambda n: pa.array([w for w in words if len(w) == n])
    small = {tuple(x.values()) for n in range(1, 17) for m in range(max(1, n - 3), n + 4) if len(own(n)) and len(own(m)) for b in G.near(own(n), own(m), n, m, 1 if n <= 4 else 2 if n <= 8 else 3) for x in b.to_pylist()}
    assert small == {x for x in want if abs(len(x[0]) - len(x[1])) <= BOUND(x[0])}


def test_learned_words_are_counted_before_they_are_converted(spark):
    events = spark.createDataFrame([("kitb", "Kitob ", None, "uy"), ("китб", "китоб", "bu", "уй"), ("kitb", "kitob", "бу", ""), ("!", "kitob", "bu", "uy")], "source string, replacement string, prev string, next string")
    got = language_model.learn(events)
    assert {tuple(r) for r in got["unigrams"].collect()} == {("китоб", 6)}
    assert {tuple(r) for r in got["bigrams"].collect()} == {("бу", "китоб", 4), ("китоб", "уй", 2)}
    assert {tuple(r) for r in got["corrections"].collect()} == {("китб", "китоб", 3)}
    lines = got["unigrams"]._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert [i for i, x in enumerate(lines) if "Aggregate" in x][1] >= [i for i, x in enumerate(lines) if "sh, ш" in x][-1]


def test_reports(spark):
    errors = spark.createDataFrame(
        [(1, 'a"b', 0, 3, 1, "Spelling", None, False, "<x>", "c & d"), (1, "z", 9, 10, 2, "Style", "R", False, None, None), (1, "r", 5, 6, 1, "Spelling", None, True, None, None)],
        "doc_id long, word string, start_index int, end_index int, paragraph_index int, severity string, rule_id string, is_resolved boolean, suggestion string, context string",
    )
    lines = lambda df: [r.line for r in df.orderBy("no").collect()]
    assert lines(reports.csv_rows(errors)) == ['1,"a""b",Имло,Spelling,"<x>",1,"c & d"', '2,"z",Грамматика,Style,"",2,""']
    assert lines(reports.html_rows(errors))[0] == "<tr><td>1</td><td>a&quot;b</td><td>Имло</td><td>&lt;x&gt;</td><td>1</td><td>c &amp; d</td></tr>"
    assert json.loads(lines(reports.json_rows(errors))[1])["rule_id"] == "R"
    assert lines(reports.preview(reports.csv_rows(errors), 1)) == ['1,"a""b",Имло,Spelling,"<x>",1,"c & d"', "... 1"]
    stats = spelling.statistics(errors).first()
    assert (stats.total, stats.resolved, stats.spelling_count, stats.style_count, stats.paragraphs) == (3, 1, 2, 1, 2)
    assert [(r.word, r.width) for r in reports.bars(spelling.top_words(errors)).collect()] == [('a"b', 100), ("r", 100), ("z", 100)]


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 1000])
def test_running_starts(spark, n):
    lengths = [i % 7 for i in range(n)]
    df = spark.createDataFrame([(lengths,)], "x array<int>")
    assert df.select(T.running_starts(F.col("x")).alias("y")).first().y == [sum(lengths[:i]) for i in range(n)]


def test_word_context(spark):
    rows = [("abc " * 20 + "word" + " xyz" * 20, "word"), ("short word here", "word"), ("x" * 100, "word"), ("short", "word")]
    got = pairs(spark, rows, lambda a, b: T.word_context(a, b))
    assert got[0].startswith("...") and got[0].endswith("...") and "word" in got[0] and got[1] == "short word here"
    assert got[2] == "x" * 80 + "..." and got[3] == "short"


def test_settings():
    from corpusloom import settings

    s = settings.loads("MaxPredictions=99\nPreferredScript=Greek\nAutoLearn=False\nPredictionSensitivity=x\nnonsense\n")
    assert (s.MaxPredictions, s.PreferredScript, s.AutoLearn, s.PredictionSensitivity) == (10, "Auto", False, 0.5)
    assert settings.loads(settings.dumps(s)) == s


def test_membership_in_either_script(spark):
    """A token is known if the lexicon has it in its own script or in the other one."""
    from corpusloom.operators import spelling

    docs = spark.createDataFrame([(1, "kitob китоб maktab мактаб olma xatoo")], "doc_id int, text string")
    lexicon = spark.createDataFrame([("китоб",), ("maktab",)], "word string")
    assert sorted(r.word for r in spelling.errors(docs, lexicon).collect()) == ["olma", "xatoo"]


def test_rules_by_priority_and_the_first_of_an_id(spark):
    from corpusloom.operators import grammar

    rules = [("B", "x", 5, True, "Style"), ("A", "x", 2, False, "Grammar"), ("B", "y", 1, True, "Grammar"), ("A", "z", 9, True, "Style")]
    assert [tuple(r) for r in grammar.rules_table(spark, rules).collect()] == [("B", "y", 1, True, "Grammar"), ("A", "x", 2, False, "Grammar")]
    assert grammar.enabled_rules(rules) == {"B"} and grammar.enabled_rules(rules, ("B",)) == set()


EXPLANATIONS = [(0, "китоб", "a book", None, None, []), (1, "maktab", "a school", None, "noun", ["x"]), (2, "тоғ", " ", "", None, []), (3, "kitob", "the book", None, None, [])]
CORRECTIONS = [("kiotb", "kitob", "yangi", "bor"), ("kiotb", "kitob", "", "bor"), ("maktap", "maktab", "yangi", None), ("", "x", None, None)]


def test_learned_counts(spark):
    learned = language_model.learn(spark.createDataFrame(CORRECTIONS, "source string, replacement string, prev string, next string"))
    assert {tuple(r) for r in learned["unigrams"].collect()} == {("китоб", 4), ("мактаб", 2)}
    assert {tuple(r) for r in learned["bigrams"].collect()} == {("янги", "китоб", 2), ("китоб", "бор", 2), ("янги", "мактаб", 2)}
    assert {tuple(r) for r in learned["corrections"].collect()} == {("киотб", "китоб", 2), ("мактап", "мактаб", 1)}


def test_explanations(spark):
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    entries = spark.createDataFrame(EXPLANATIONS, "ordinal int, word string, definition string, spelling_rule string, grammar_note string, examples array<string>")
    got = lexicon.explain(words("kitob", "Мактаб", "тоғ", "nomalum"), entries).select("word", "definition", "grammar_note").collect()
    assert {tuple(r) for r in got} == {("kitob", "the book", None), ("Мактаб", "a school", "noun"), ("тоғ", None, None), ("nomalum", None, None)}
    local, bundled = (spark.createDataFrame(list(enumerate(w)), "ordinal int, word string") for w in (("китоб", "китоби"), ("мактаб", "юрак")))
    got = {r.word: (r.source, r.key) for r in lexicon.get_explanation(words("китоблар", "китоп", "мактабда", "осмон", "юрак"), local, bundled).collect()}
    assert got == {"китоблар": ("local", "китоб"), "китоп": ("local", "китоб"), "мактабда": ("bundled", "мактаб"), "осмон": (None, None), "юрак": ("bundled", "юрак")}


def test_words_one_edit_apart_are_found(spark):
    """Against comparing all with all: swaps, changes, one letter more or less, empty and repeated letters."""
    r = random.Random(7)
    some = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(120)})
    ask, entries = some[::3], [w for i, w in enumerate(some) if i % 3]
    local = spark.createDataFrame(list(enumerate(entries)), "ordinal int, word string")
    none = spark.createDataFrame([], "ordinal int, word string")
    got = {x.word: x.key for x in lexicon.get_explanation(spark.createDataFrame([(w,) for w in ask], "word string"), local, none).collect()}

    def near(a, b):
        swaps = [a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)]
        cuts = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
        return b in swaps or b in cuts(a) or a in cuts(b) or len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) <= 1

    assert got == {q: next((e for e in entries if near(q, e)), None) for q in ask}


def test_validated_list(spark):
    entries = spark.createDataFrame([("китоб",), ("Китоб",), (" ",), ("# x",), ("a\nb",), ("a\u200bb",), ("тоғ",), (None,)], "word string")
    assert sorted(map(tuple, lexicon.validate(entries).collect())) == sorted([("blank", " "), ("blank", ""), ("comment", "# x"), ("line_break", "a\nb"), ("control", "a\u200bb"), ("repeated", "китоб")])


def test_near_lengths_join_with_bigrams(spark):
    """Pairs within reach are those of the plain join; others are left out."""
    words = spark.createDataFrame([(w,) for w in ("banana", "bananas", "ananas", "an", "cabana", "nananana")], "word string")
    ask = spark.createDataFrame([("banan",), ("ana",), ("a",)], "query string")
    plain = {tuple(x) for x in suggest.shared_bigrams(ask, words).collect()}
    near = {tuple(x) for x in suggest.shared_bigrams(ask, words, F.lit(1)).collect()}
    assert near == {x for x in plain if abs(len(x[0]) - len(x[1])) <= 1} and near < plain

def test_phrases_of_any_length(spark):
    nouns = ["Buyuk Ipak Yo'li Xalqaro Markazi", "Buyuk Ipak", "Amir Temur", "Toshkent"] + [f"Nom{a} Ikkinchi{b} So'z" for a in "abcdefgh" for b in map("".join, itertools.product("abcdefgh", repeat=3))]
    texts = ["bu buyuk  ipak yoʻli\nxalqaro Markazi va amir, temur Amir temur.", "Buyuk Ipak Yo'li Xalqaro Markazi toshkent", "noma ikkinchibca so’z nomx ikkinchibca so'z buyuk buyuk ipak", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.start_index, r.end_index, r.paragraph_index, r.suggestion) for r in grammar.proper_noun_caps(docs, nouns).collect())
    one = texts[0]
    assert got == [
        (0, 3, 14, 1, "Buyuk Ipak"), (0, 3, one.index(" va"), 1, nouns[0]), (0, one.index("Amir temur"), one.index("Amir temur") + 10, 2, "Amir Temur"),
        (1, 33, 41, 1, "Toshkent"), (2, 0, 21, 1, "Noma Ikkinchibca So'z"), (2, texts[2].index("buyuk ipak"), len(texts[2]), 1, "Buyuk Ipak"),
    ]


def test_exceptions_at_once_and_in_order(spark):
    """Exceptions that can't touch each other are put in by one pass, with the result of one after the other; chains keep their order."""
    chained = [{"original": "ab", "replacement": "cd"}, {"original": "cd", "replacement": "ef"}, {"original": "x-ray", "replacement": "рентген"}, {"original": "ray", "replacement": "нур"}]
    plain = [{"original": f"word{i}", "replacement": f"сўз{i}"} for i in range(300)] + [{"original": "kino teatr", "replacement": "кинотеатр"}, {"original": "off", "replacement": "x", "enabled": False}]
    both = translit.directed(chained + plain, True)
    assert translit.independent(both) == [False] * 4 + [True] * 301
    words = ["word1 Word2 WORD3 wORD4 word1x", "ab AB Ab cd", "X-ray ray Ray", "Kino teatr KINO TEATR kino  teatr", "no off", "", "word299,word29;word2"]
    got = values(spark, words, lambda w: translit.apply_exceptions(w, chained + plain, True))
    assert got == ["сўз1 Сўз2 СЎЗ3 сўз4 word1x", "ef EF Ef ef", "Рентген нур Нур", "Кинотеатр КИНОТЕАТР kino  teatr", "no off", "", "сўз299,сўз29;сўз2"]
    texts = ["Sentabr OKTABR oktabr, sentabr", "aksiya Aksiya AKSIYA"]
    pairs = translit.directed(data.EXCEPTIONS, True)
    texts += [" ".join((f, f.upper(), f.capitalize(), f + "x")) for f, _ in pairs]
    assert values(spark, texts, lambda w: translit.apply_exceptions(w, data.EXCEPTIONS, True)) == values(spark, texts, lambda w: translit._one_by_one(w, pairs))


def test_script_is_counted_once_a_text(spark):
    """Letters are counted as before, and a conversion counts them, and looks for exceptions, once."""
    texts = ["Salom, дунё!", "ſtraße ҚҲқҳ Ёё ўЎ", "", None, "🙂aЯ𝐀", "ѐѓ àé", "iPhone vaqti", "aPi", "Rapid apis", "salom dunyo ёз"]
    latin, cyrillic = (lambda w: None if w is None else sum(c.isascii() and c.isalpha() for c in w)), (lambda w: None if w is None else sum("а" <= c <= "я" or "А" <= c <= "Я" or c in "ёЁўЎғҒҳҲқҚ" for c in w))
    assert values(spark, texts, T.count_latin) == list(map(latin, texts)) and values(spark, texts, T.count_cyrillic) == list(map(cyrillic, texts))
    got = values(spark, texts, lambda w: translit.switch_script(w, "Cyrillic", data.EXCEPTIONS))
    assert got == ["Салом, дунё!", "ſтраßе ҚҲқҳ Ёё ўЎ", "", None, "🙂aЯ𝐀", "ѐѓ àé", "ипҳоне вақти", "апи", "Рапид апис", "салом дунё ёз"]
    plan = spark.createDataFrame([("a",)], "w string").select(translit.switch_script(F.col("w"), "Cyrillic", data.EXCEPTIONS).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(T.LATIN_LETTERS) == plan.count(T.CYRILLIC_LETTERS) == 1
    assert plan.count(translit._seen(translit.directed(data.EXCEPTIONS, True))) == 1


def test_exceptions_are_found_in_any_case(spark):
    """What is looked for first is found wherever the exceptions are: letters that only equal others without case, and at edges."""
    exceptions = [{"original": "kilo six", "replacement": "кило олти"}, {"original": "straße", "replacement": "кўча"}, {"original": "'tis", "replacement": "шу"}, {"original": "tis", "replacement": "тис"}]
    texts = ["KİLO", "Kilo ſix", "KILO SIX", "xkilo six", "яkilo six", "-kilo six-", "Straße STRASSE", "it's 'tis", "a'tis", "Kılo sıx"]
    pairs = translit.directed(exceptions, True)
    free = translit.independent(pairs)
    one = lambda w: translit._one_by_one(translit._all_at_once(w, [p for p, x in zip(pairs, free, strict=True) if x]), [p for p, x in zip(pairs, free, strict=True) if not x])
    got = values(spark, texts, lambda w: translit.apply_exceptions(w, exceptions, True))
    assert got == values(spark, texts, one) and sum(a != b for a, b in zip(texts, got, strict=True)) >= 4


def test_whole_texts_to_latin(spark, monkeypatch):
    """A whole text is what its letter runs are, one by one, and only texts with odd letters are cut into runs."""
    rng = random.Random(5)
    odd = list("абвгдеёжцшщъыьэюяўғқҳі" * 4 + "abeghoʻ'" * 3 + "ßİıſKϴΣσςǅẞªʰⒶⅣ𝐀𝐐中é😀́ \n-1" + " " * 12) + ["сентябрь", "октябр", "Ье", "Еш", "аЦ", "ац"]
    texts = ["", None, "Шаҳар ШАҲАР шаҲар Я яЯ Ер ЕР ель Поезд ПОЕЗД циркЦ АЦЕТ ацет Ацет Ььa", "Сентябрь ОКТЯБР сенТябрь тябр", "ШЕ Ше шЕ Ёе Щʻа Щʻ"]
    texts += ["".join(c.upper() if rng.random() < p else c for c in rng.choices(odd, k=rng.choice([3, 12, 40]))) for p in (0, 0.1, 0.5, 1) for _ in range(500)]
    assert values(spark, texts, translit.to_latin) == values(spark, texts, translit._runs_to_latin)

    monkeypatch.setattr(translit, "_runs_to_latin", lambda t: F.lit("run by run"))
    assert values(spark, ["Тошкент шаҳрида ЯНГИ йил; поездЛАР — Ер", "oʻzbek «ñandú» ΣΑΣ 🙂 中", "Ья", "ǅ"], translit.to_latin) == ["Toshkent shahrida YANGI yil; poyezdlar — Yer", "oʻzbek «ñandú» ΣΑΣ 🙂 中", "run by run", "run by run"]
