"""Script conversion between Latin and Cyrillic, apostrophes, and blanks, as Column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from . import tries

# Pairs of letters, letters with an apostrophe, and single letters, Latin to Cyrillic. Order matters.
DIGRAPHS = [
    ("SH", "Ш"), ("Sh", "Ш"), ("sh", "ш"), ("CH", "Ч"), ("Ch", "Ч"), ("ch", "ч"), ("NG", "НГ"), ("Ng", "Нг"), ("ng", "нг"),
    ("YO", "Ё"), ("Yo", "Ё"), ("yo", "ё"), ("YA", "Я"), ("Ya", "Я"), ("ya", "я"), ("YU", "Ю"), ("Yu", "Ю"), ("yu", "ю"),
    ("YE", "Е"), ("Ye", "Е"), ("ye", "е"),
]
MARK = "['ʻ-ʼ‘-’]"
MARKED = {"O": "Ў", "o": "ў", "G": "Ғ", "g": "ғ"}
LATIN_LETTERS = "ABDEFGHIJKLMNOPQRSTUVXYZabdefghijklmnopqrstuvxyz"
CYRILLIC_LETTERS = "АБДЕФГҲИЖКЛМНОПҚРСТУВХЙЗабдефгҳижклмнопқрстувхйз"
# Cyrillic to Latin, of lower-case letters.
TO_LATIN_LONG = {"ш": "sh", "ч": "ch", "ё": "yo", "я": "ya", "ю": "yu", "ў": "oʻ", "ғ": "gʻ", "щ": "sh"}
TO_LATIN_SINGLE = ("ҳқъыабвгджзийклмнопрстуфхэ", "hqʻiabvgdjziyklmnoprstufxe")
CYRILLIC_VOWELS = "аеёиоуўэюя"
#: What looks like an apostrophe between Latin letters.
APOSTROPHE_LIKE = "'‘’ʻʼ`´ʹ＇"
#: What stands behind a letter while a text is converted: that it is ye or ts, and that it alone is upper case in its run.
LONG, ALONE = "\ue000", "\ue001"
#: Letters that aren't what they were after lower and upper case, or that lower case changes though they aren't upper case.
UNSTABLE = "".join(c for c in map(chr, range(0x10000)) if unicodedata.category(c) in ("Lu", "Lt", "Lm", "Lo") and (c.lower().upper() != c or (c.lower() != c and unicodedata.category(c) != "Lu")))
#: A class of few ranges with all of these, the marks, and what lies beyond the first plane. Long and negated classes take ten times as long.
PERHAPS_ODD = r"[\u0130-\u01F2\u03F4\u1E9E-\u1FFF\u2126-\x{10FFFF}]"
#: A letter run with lower case and an upper-case letter that isn't its first.
MIXED = r"(?<!\p{L})(?=\p{L}[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]*+\p{Lu})(?=[\p{Lu}\p{Lt}\p{Lm}\p{Lo}]*+\p{Ll})\p{L}++"
#: Characters by what they are without case, as regular expressions compare them.
FOLDED: dict[str, list[str]] = {}
for _c in map(chr, range(0x10000)):
    FOLDED.setdefault((_c.upper() if len(_c.upper()) == 1 else _c).lower()[0], []).append(_c)


def _escaped(word: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}-])", r"\\\1", word)


def _literal(replacement: str) -> str:
    return re.sub(r"([\\$])", r"\\\1", replacement)


def directed(exceptions: list[dict], to_cyrillic: bool) -> list[tuple[str, str]]:
    """What is found and what is put in, of the exceptions that are enabled and have both."""
    pairs = ((e["original"], e["replacement"]) if to_cyrillic else (e["replacement"], e["original"]) for e in exceptions if e.get("enabled", True))
    return [(find, new) for find, new in pairs if find and new]


def independent(pairs: list[tuple[str, str]]) -> list[bool]:
    """Which pairs can't touch what others find or make, so that their order doesn't matter.

    Both sides begin and end with a letter or digit, and no run of these that the pair finds stands in another pair's found word or in
    any replacement, nor one that it makes in any found word. Two matches that overlap would share a run.
    """
    runs = [(set(tries.word_runs(find)), set(tries.word_runs(new))) for find, new in pairs]
    found, made = Counter(r for a, _ in runs for r in a), Counter(r for _, b in runs for r in b)
    whole = lambda w: bool(re.match(r"\w", w) and re.search(r"\w$", w))
    return [whole(find) and whole(new) and all(found[r] == 1 and not made[r] for r in a) and not any(found[r] for r in b) for (find, new), (a, b) in zip(pairs, runs, strict=True)]


def _any_case(char: str) -> str:
    same = FOLDED.get((char.upper() if len(char.upper()) == 1 else char).lower()[0], [char])
    return f"[{''.join(same)}]" if char.isalpha() else _escaped(char)


def _seen(pairs: list[tuple[str, str]]) -> str:
    """A pattern that is found in every text that holds one of the pairs' words, and in few others."""
    found = [find for find, _ in pairs]
    start = r"(?<![A-Za-z0-9_])" if all(re.match(r"\w", find) for find in found) else ""
    return start + tries.pattern(sorted({w for find in found for w in (find.lower(), find.upper().lower())}), _any_case)


def _one_by_one(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Each is three replacements that exclude each other: all upper case, first letter upper, and else. Later ones see what earlier ones made."""
    made = text
    for find, new in pairs:
        word = f"(?iu:{_escaped(find)})"
        title = new[:1].upper() + new[1:].lower()
        for pattern, replacement in (
            (rf"(?U)\b{_escaped(find.upper())}\b", new.upper()),
            (rf"(?U)\b(?=\p{{Lu}})(?=.{{0,{len(find) - 1}}}\p{{Ll}}){word}\b", title),
            (rf"(?U)\b(?=\P{{Lu}}){word}\b", new.lower()),
        ):
            made = F.regexp_replace(made, pattern, _literal(replacement))
    return made


def _all_at_once(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """One pass for any number of pairs: a text is split at the matches of a trie, and each match is looked up."""
    key = lambda w: F.lower(F.upper(w))  # noqa: E731  as matching without case has it
    table = tries.Table({find.upper().lower(): (find.upper(), new.upper(), new[:1].upper() + new[1:].lower(), new.lower()) for find, new in pairs}, "find string, upper string, title string, lower string")
    pattern = rf"(?<![A-Za-z0-9_])(?iuU)\b{tries.pattern(sorted({find.lower() for find, _ in pairs}))}\b"

    def put(m: Column) -> Column:
        cased = lambda e: F.when(m == e["find"], e["upper"]).when(~m.rlike(r"^\p{Lu}"), e["lower"]).when(m.rlike(r"\p{Ll}"), e["title"])
        return F.coalesce(T.let(table.get(key(m)), cased), m)

    def joined(matches: Column) -> Column:
        new = F.concat(F.transform(matches, put), F.array(F.lit("")))
        return F.array_join(F.flatten(F.zip_with(F.split(text, pattern, -1), new, lambda b, x: F.array(b, x))), "")

    return T.let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), joined)


def apply_exceptions(text: Column, exceptions: list[dict], to_cyrillic: bool) -> Column:
    """Replaces whole words in order of the list, whatever their case; a replacement takes the found word's case.

    An exception has ``original`` (Latin), ``replacement`` (Cyrillic) and ``enabled``. Those whose order can't matter are put in by
    one pass, however many they are; the others one after the other, in order. Texts that hold none are passed over by one look.
    """
    pairs = directed(exceptions, to_cyrillic)
    if not pairs:
        return text
    free = independent(pairs)
    rest = [p for p, x in zip(pairs, free, strict=True) if not x]

    def put(t: Column) -> Column:
        made = _all_at_once(t, [p for p, x in zip(pairs, free, strict=True) if x]) if any(free) else t
        return _one_by_one(made, rest)

    return T.let(text, lambda t: F.when(t.rlike(_seen(pairs)), put(t)).otherwise(t))


def to_cyrillic(text: Column, exceptions: list[dict] = ()) -> Column:
    """Latin to Cyrillic: exceptions, then pairs of letters, letters with apostrophes, and single letters.

    An apostrophe between Latin letters, the left one not o or g, is a hard sign. Letters without a counterpart stay.
    """
    if exceptions:
        text = apply_exceptions(text, exceptions, True)

    def plain(t: Column) -> Column:
        for latin, cyrillic in DIGRAPHS:
            if latin.translate(single) != cyrillic:
                t = F.replace(t, F.lit(latin), F.lit(cyrillic))
        return t

    def marked(t: Column) -> Column:
        t = F.regexp_replace(t, rf"{MARK}(?<=[A-Za-z&&[^oOgG]]{MARK})(?=[A-Za-z])", "ъ")
        for latin, cyrillic in DIGRAPHS:
            t = F.replace(t, F.lit(latin), F.lit(cyrillic))
        for letter, cyrillic in MARKED.items():
            t = F.regexp_replace(t, letter + MARK, cyrillic)
        return t

    single = str.maketrans(LATIN_LETTERS, CYRILLIC_LETTERS)
    return F.translate(T.let(text, lambda t: F.when(t.rlike(MARK), marked(t)).otherwise(plain(t))), LATIN_LETTERS, CYRILLIC_LETTERS)


def word_case(word: Column) -> Column:
    """Upper, Title, Lower or Mixed. One upper-case letter is Upper."""
    return (F.when(~word.rlike(r"\p{Ll}"), "Upper").when(word.rlike(r"^\p{Lu}") & ~word.rlike(r"^.+\p{Lu}"), "Title")
            .when(~word.rlike(r"^\p{Lu}"), "Lower").otherwise("Mixed"))


def restore_case(word: Column, case: Column) -> Column:
    return F.when(case == "Upper", F.upper(word)).when(case == "Title", F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.char_length(word)))).otherwise(word)


def _word_to_latin(word: Column) -> Column:
    """A run of letters to Latin, in the run's case."""

    def lower_to_latin(w: Column) -> Column:
        v = CYRILLIC_VOWELS
        out = F.regexp_replace(w, f"(?<=[{v}])ц", "ts")
        out = F.replace(out, F.lit("ц"), F.lit("s"))
        out = F.regexp_replace(out, f"(?:(?<=[{v}ъь])|^)е", "ye")
        out = F.replace(out, F.lit("е"), F.lit("e"))
        for cyrillic, latin in TO_LATIN_LONG.items():
            out = F.replace(out, F.lit(cyrillic), F.lit(latin))
        out = F.translate(out, *TO_LATIN_SINGLE)
        return F.replace(out, F.lit("ь"), F.lit(""))

    lower = F.lower(word)
    month = F.when(lower.isin("сентябр", "сентябрь"), "sentabr").when(lower.isin("октябр", "октябрь"), "oktabr")
    return restore_case(F.coalesce(month, lower_to_latin(lower)), word_case(word))


def _runs_to_latin(text: Column) -> Column:
    """Letter run by letter run, for any text."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda w: F.when(w.rlike(r"^\p{L}"), _word_to_latin(w)).otherwise(w)), "")


def _lower_mixed(text: Column) -> Column:
    """A text whose runs of mixed case are lower-cased."""
    runs = F.transform(F.regexp_extract_all(text, F.lit(MIXED), F.lit(0)), F.lower)
    whole = F.array_join(F.flatten(F.zip_with(F.split(text, MIXED, -1), F.concat(runs, F.array(F.lit(""))), lambda b, x: F.array(b, x))), "")
    return F.when(text.rlike(r"\p{Lu}(?<=\p{L}\p{Lu})"), whole).otherwise(text)


def _text_to_latin(text: Column) -> Column:
    """A whole text without odd letters and runs of mixed case: upper case is a run's first letter or all of it."""
    v = CYRILLIC_VOWELS + CYRILLIC_VOWELS.upper()

    def months(t: Column) -> Column:
        for cyrillic, latin in (("сентябр", "sentabr"), ("октябр", "oktabr")):
            for case in (str.lower, str.capitalize, str.upper):
                t = F.regexp_replace(t, rf"(?<!\p{{L}}){case(cyrillic)}[ьЬ]?(?!\p{{L}})", case(latin))
        return t

    made = F.when(text.contains("тябр") | text.contains("ТЯБР"), months(text)).otherwise(text)
    made = F.regexp_replace(made, rf"[еЕцЦ](?:(?<=[{v}][еЕцЦ])|(?<=[ъьЪЬ][еЕ])|(?<![цЦ]|\p{{L}}[еЕ]))", f"$0{LONG}")
    made = F.regexp_replace(made, rf"[Ч-ЩЮЯЁЕ]{LONG}?(?=[\p{{Lu}}\p{{Lt}}\p{{Lm}}\p{{Lo}}]*+\p{{Ll}})", f"$0{ALONE}")
    cyrillic, latin = TO_LATIN_SINGLE[0] + "це", TO_LATIN_SINGLE[1] + "se"
    made = F.translate(made, cyrillic + cyrillic.upper() + "ьЬ", latin + latin.upper())
    long = {f"e{LONG}": "ye", f"s{LONG}": "ts", **TO_LATIN_LONG}
    alone = {f"E{LONG}{ALONE}": "Ye"} | {c.upper() + ALONE: pair.capitalize() for c, pair in TO_LATIN_LONG.items() if pair[1].upper() != pair[1]}
    for find, new in {**alone, **{c.upper(): pair.upper() for c, pair in long.items()}, **long}.items():
        made = F.replace(made, F.lit(find), F.lit(new))
    return made


def to_latin(text: Column, exceptions: list[dict] = ()) -> Column:
    """Cyrillic to Latin, each letter run in its case; ye, ts and s by what stands before."""
    if exceptions:
        text = apply_exceptions(text, exceptions, False)

    def either(t: Column) -> Column:
        # a soft sign that begins a run goes, and the next letter is its first
        odd = t.rlike(PERHAPS_ODD) & ((F.translate(t, UNSTABLE + LONG + ALONE, "") != t) | t.rlike(r"(?=[\x{10000}-\x{10FFFF}])\p{L}"))
        odd |= t.contains("Ь") & t.rlike(r"Ь(?<!\p{L}Ь)")
        return F.when(odd, _runs_to_latin(t)).when(t.isNotNull(), T.let(_lower_mixed(t), _text_to_latin))

    return T.let(text, either)


def normalize_apostrophes(text: Column) -> Column:
    """What looks like an apostrophe between Latin letters: the opening quote after o and g, else the closing one."""
    mark = f"[{APOSTROPHE_LIKE}]"
    text = F.regexp_replace(text, rf"{mark}(?<=[oOgG]{mark})(?=[A-Za-z])", "‘")
    return F.regexp_replace(text, rf"{mark}(?<=[A-Za-z&&[^oOgG]]{mark})(?=[A-Za-z])", "’")


def apostrophe_edits(text: Column) -> Column:
    """How many apostrophes ``normalize_apostrophes`` changes: those it touches less those that are right."""
    touched = F.regexp_count(text, F.lit(rf"(?<=[A-Za-z])[{APOSTROPHE_LIKE}](?=[A-Za-z])"))
    right = F.regexp_count(text, F.lit(r"(?<=[oOgG])‘(?=[A-Za-z])|(?<=[A-Za-z&&[^oOgG]])’(?=[A-Za-z])"))
    return touched - right


def switch_script(text: Column, mixed_to: str | None = None, exceptions: list[dict] = ()) -> Column:
    """Cyrillic to Latin with apostrophes put right, Latin to Cyrillic, mixed to the chosen script; else as it is."""
    latin, cyrillic = normalize_apostrophes(to_latin(text, exceptions)), to_cyrillic(text, exceptions)
    becomes = lambda s, target, source: (s == source) | ((s == "Mixed") & F.lit(mixed_to == target))
    return T.let(T.detect_script(text), lambda s: F.when(becomes(s, "Latin", "Cyrillic"), latin).when(becomes(s, "Cyrillic", "Latin"), cyrillic).otherwise(text))


def to_cyrillic_canonical(word: Column, exceptions: list[dict] = ()) -> Column:
    """A word's search form: Latin words in Cyrillic and normalised, others as they are."""
    return F.when(T.detect_script(word) == "Latin", T.normalize_word(to_cyrillic(word, exceptions))).otherwise(word)


def other_script(word: Column, exceptions: list[dict] = ()) -> Column:
    """A word in the other script, normalised; null if it is mixed or of no script."""
    script = T.detect_script(word)
    return F.when(script == "Latin", T.normalize_word(to_cyrillic(word, exceptions))).when(script == "Cyrillic", T.normalize_word(to_latin(word, exceptions)))


def to_script(word: Column, script: Column) -> Column:
    """A suggestion in lower case and in the script that is asked for."""
    lower = F.lower(word)
    own = T.detect_script(lower)
    return F.when((script == "Latin") & (own == "Cyrillic"), F.lower(to_latin(lower))).when((script == "Cyrillic") & (own == "Latin"), F.lower(to_cyrillic(lower))).otherwise(lower)


def for_model(word: Column) -> Column:
    """A word's key in language models: its search form, lower-cased."""
    return F.lower(to_cyrillic_canonical(T.normalize_word(word)))


def cleanup_spaces(text: Column, paragraph: str = "\n") -> Column:
    """Runs of spaces to one, and none at either side of a paragraph's end."""
    text = F.regexp_replace(text, " {2,}", " ")
    return F.regexp_replace(F.regexp_replace(text, f" +{paragraph}", paragraph), f"{paragraph} +", paragraph)


def replace_word(text: Column, word: str, replacement: str) -> Column:
    """Replaces a whole word, whatever its case."""
    return F.regexp_replace(text, rf"(?iuU)\b{_escaped(word)}\b", _literal(replacement))
