"""Quality by weak supervision: rules vote or abstain, and expectation-maximisation weighs their votes.

Each rule looks at one figure of a text and votes good, bad, or abstains. Several rules look at each kind of junk from
different sides, and none is right alone: their limits are those of published filters for web text, which some clean
texts pass. Texts with the same votes are one *pattern*, and counts of patterns over all documents are all that EM reads;
where there are many, tasks sum them up and the driver sees sums of classes and rules. EM fits, for good texts and
for each kind of junk, how often each rule objects; a pattern's posterior probability of being good then replaces an
all-must-pass filter, which drops whatever any rule objects to.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, materialize, read

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
KEEP, ROUNDS, SETTLED, PRIOR_BAD, STRENGTH = 0.5, 200, 1e-9, 0.1, 20.0
#: Patterns that EM takes into the driver (some 100 MB); rows that a task weighs at once.
IN_DRIVER, BLOCK = 1 << 16, 1 << 13
#: What EM expects beforehand: the share of good texts that a rule objects to, and of the kind of junk it is there for.
MISFIRE, CAUGHT = 1e-3, 0.9
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = "#*$%&|<>"
_SYMBOL = re.compile(f"[{re.escape(SYMBOLS)}]")
_SPACE = re.compile("[\x20\x09-\x0d]")


@dataclass(frozen=True)
class Rule:
    """Of a share that speaks against a text: bad from ``limit`` on, good up to half of it, else no vote. ``kind`` is of junk."""

    name: str
    kind: str
    limit: float

    def votes(self, x: np.ndarray) -> np.ndarray:
        return np.where(x >= self.limit, 2, np.where(x <= self.limit / 2, 1, 0)).astype(np.int64)


#: In the order of ``figures``. Limits of Gopher's filters (Rae et al. 2021) but where others are named; what those have no
#: limit for takes a fifth, or half or thrice as much where that is much or little. Windows that repeat are the base's matter.
RULES = (
    Rule("symbols_per_word", "symbols", 0.1),
    Rule("words_with_symbols", "symbols", 0.2),
    Rule("characters_not_letters", "symbols", 0.2),
    Rule("words_without_letters", "tables", 0.2),
    Rule("words_without_letters_or_digits", "tables", 0.1),
    Rule("most_common_word", "tables", 0.2),
    Rule("words_in_the_most_common_pair", "repetition", 0.2),
    Rule("repeated_lines", "repetition", 0.3),
    Rule("words_like_the_one_before", "repetition", 0.1),
    Rule("words_seen_before", "repetition", 0.6),
    Rule("upper_case_letters", "shouting", 0.2),
    Rule("upper_case_words", "shouting", 0.2),
    Rule("words_with_exclamations", "shouting", 0.1),
    Rule("short_lines", "fragments", 0.67),  # FineWeb (Penedo et al. 2024), as the next
    Rule("lines_without_an_end", "fragments", 0.88),
    Rule("digits", "fragments", 0.2),
)
KINDS = tuple(dict.fromkeys(r.kind for r in RULES))
SHORT_LINE, ENDS, SEEN = 30, tuple(".!?…\"'”’»"), 200
#: Words whose marks a worker remembers.
REMEMBERED = 1 << 18


def marks(word: bytes) -> int:
    """What a word is, by bits: with a symbol, without a letter, without a letter or digit, upper case, exclaimed."""
    w = word.decode("utf-8", "surrogatepass")
    letter = any(map(str.isalpha, w))
    return (bool(_SYMBOL.search(w)) | (not letter) << 1 | (not letter and not any(map(str.isalnum, w))) << 2
            | (w.isupper() and sum(map(str.isalpha, w)) > 1) << 3 | w.endswith("!!") << 4)


def repeat_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows that are found twice or more; ``ids`` are equal for equal words. Exact: windows double by pairs of ids."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    span = 1
    while span < window:
        step = min(span, window - span)
        pairs = ids[: len(ids) - step].astype(np.int64) * (int(ids.max()) + 1) + ids[step:]
        values, ids, count = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(values) == len(pairs):
            return 0
        span += step
    hit = np.concatenate([count[ids] > 1, np.zeros(window - 1, bool)])
    at = np.flatnonzero(hit)
    cover = np.zeros(len(hit) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, np.minimum(at + window, len(hit)), -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def seen_before(ids: np.ndarray, window: int = SEEN) -> float:
    """The share of words that repeat an earlier one of their window, over all windows of so many words: fair to length and order. A shorter text is one window."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    last = np.full(n, -1)
    again = ids[order[1:]] == ids[order[:-1]]
    last[order[1:][again]] = order[:-1][again]
    at, width = np.arange(n), min(n, window)
    # a word counts as new in the windows that hold it and not the one before it
    new = np.minimum(at, n - width) - np.maximum(np.maximum(last + 1, at - width + 1), 0) + 1
    return 1 - float(np.maximum(0, new).sum()) / ((n - width + 1) * width)


def figures(text: str | None, known: dict[bytes, int]) -> tuple[int, int, int, int, int, list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the figure that each rule looks at. ``known`` keeps words' marks."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        return 0, 0, len(_SYMBOL.findall(text)), 0, 0, [0.0] * len(RULES)
    first: dict[bytes, int] = {}
    ids = np.fromiter(map(first.setdefault, words, itertools.count()), np.int64, n)
    if len(known) > REMEMBERED:
        known.clear()
    for w in first:
        if w not in known:
            known[w] = marks(w)
    counts = np.bincount(ids, minlength=n)[list(first.values())]
    bits = np.fromiter(map(known.__getitem__, first), np.int64, len(first))
    of = lambda k: float(counts @ (bits >> k & 1)) / n
    chars, symbols = len(text) - len(_SPACE.findall(text)), len(_SYMBOL.findall(text))
    lines = [x for x in text.split("\n") if x and _SPACE.sub("", x)]
    dup, repeats = len(lines) - len(set(lines)), repeat_words(ids)
    letters, upper = sum(map(str.isalpha, text)), sum(map(str.isupper, text))
    pairs = np.unique(ids[:-1] * n + ids[1:], return_counts=True)[1].max(initial=0)
    look = [
        symbols / n, of(0), 1 - letters / chars, of(1), of(2), counts.max() / n, 2 * pairs / n if pairs > 1 else 0.0, dup / len(lines),
        float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0, seen_before(ids), upper / max(1, letters), of(3), of(4),
        sum(len(x) < SHORT_LINE for x in lines) / len(lines), sum(not x.rstrip().endswith(ENDS) for x in lines) / len(lines), sum(map(str.isdigit, text)) / chars,
    ]
    return n, chars, symbols, dup, repeats, look


def features(docs: DataFrame) -> DataFrame:
    """Base figures per row of ``docs``, ``base_failed``, and the rules' votes as one number (``pattern``)."""

    known: dict[bytes, int] = {}

    def make(texts: list[str | None]) -> dict[str, np.ndarray]:
        got = [figures(t, known) for t in texts]
        base = np.array([g[:5] for g in got], np.int64).reshape(-1, 5)
        look = np.array([g[5] for g in got]).reshape(-1, len(RULES))
        pattern = np.zeros(len(got), np.int64)
        for j, rule in enumerate(RULES):
            pattern = pattern * 3 + rule.votes(look[:, j])
        failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEAT_PERCENT * base[:, 0])
        return {**dict(zip(BASE, base.T, strict=True)), "base_failed": failed, "pattern": pattern}

    return map_texts(docs, make, f"{', '.join(f'{c} long' for c in BASE)}, base_failed boolean, pattern long")


def votes_of(pattern: np.ndarray) -> np.ndarray:
    """(pattern, rule): 0 abstains, 1 good, 2 bad."""
    return np.stack([pattern // 3 ** (len(RULES) - 1 - j) % 3 for j in range(len(RULES))], axis=1)


def posterior(votes: np.ndarray, share: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """(row, class): how probable the classes are of texts with such votes. Whether a rule abstains says nothing."""
    score = (votes == 2) @ np.log(rate).T + (votes == 1) @ np.log1p(-rate).T + np.log(share)
    p = np.exp(score - score.max(axis=1, keepdims=True, initial=-np.inf))
    return p / p.sum(axis=1, keepdims=True)


def sums(votes: np.ndarray, counts: np.ndarray, share: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """(class, 1 + 2 rules): expected documents of each class, and their objections and votes by rule."""
    bad = (votes == 2).astype(float)
    weight = (posterior(votes, share, rate) * counts[:, None]).T
    return np.concatenate([weight.sum(axis=1, keepdims=True), weight @ bad, weight @ (bad + (votes == 1))], axis=1)


def fit(total: Callable[[np.ndarray, np.ndarray], np.ndarray], rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the classes, and (class, rule) rates of objection, by EM; ``total`` gives ``sums`` over all documents.

    Class 0 are good texts, the others the KINDS of junk. EM finds the classes' shares and how often each rule objects to
    texts of each, from where the prior says it starts: PRIOR_BAD of the texts are junk, a rule objects to CAUGHT of the kind
    it is there for, and to MISFIRE of all else, or to as much as it objects to beyond PRIOR_BAD. Nothing but the prior's
    pseudo-counts of STRENGTH documents a class binds what is found. So junk is what the rules of its kind agree on: an
    objection that the kind's other rules contradict is a misfire, however rare, and one that they share or abstain
    from is believed.
    """
    n = len(RULES)
    (everything,) = total(np.ones(1), np.full((1, n), 0.5))
    objects = everything[1 : n + 1] / np.maximum(1, everything[n + 1 :])
    own = np.array([[r.kind == k for r in RULES] for k in KINDS])
    prior = np.tile(np.maximum(MISFIRE, objects - PRIOR_BAD), (len(KINDS) + 1, 1))
    prior[1:][own] = CAUGHT
    expected = np.array([1 - PRIOR_BAD] + [PRIOR_BAD / len(KINDS)] * len(KINDS))
    share, rate = expected, prior
    for _ in range(rounds):
        got = total(share, rate)
        new_share = (got[:, 0] + STRENGTH * expected) / (got[:, 0].sum() + STRENGTH)
        new_rate = (got[:, 1 : n + 1] + STRENGTH * prior) / (got[:, n + 1 :] + STRENGTH)
        moved = max(np.abs(new_share - share).max(), np.abs(new_rate - rate).max())
        share, rate = new_share, new_rate
        if moved < SETTLED:
            break
    return share, rate


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Each pattern's probability of good, and (class, rule, vote) probabilities; vote 0 is good."""
    share, rate = fit(lambda s, r: sums(votes, counts, s, r), rounds)
    return posterior(votes, share, rate)[:, 0], np.stack([1 - rate, rate], axis=2)


def spread_sums(counted: DataFrame, share: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """``sums`` of a table of patterns by its tasks: only the figures of the classes and rules come to the driver."""
    shape = (len(share), 1 + 2 * len(RULES))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = np.zeros(shape)
        for f in frames:
            for k in range(0, len(f), BLOCK):
                b = f.iloc[k : k + BLOCK]
                got += sums(votes_of(b["pattern"].to_numpy()), b["count"].to_numpy(), share, rate)
        yield pd.DataFrame({"at": np.arange(got.size), "x": got.ravel()})

    rows = counted.mapInPandas(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(shape)
    for r in rows:
        out.flat[r["at"]] = r["x"]
    return out


def learned(found: DataFrame, in_driver: int = IN_DRIVER) -> tuple[np.ndarray, np.ndarray]:
    """``fit`` to ``features``' patterns, counted over all documents that didn't fail the base.

    Up to ``in_driver`` patterns EM runs in the driver, beyond that each round is a job over the table of patterns.
    """
    counted = materialize(found.where(~F.col("base_failed")).groupBy("pattern").count(), "quality_patterns")
    if counted.count() > in_driver:
        return fit(lambda s, r: spread_sums(counted, s, r))
    table = counted.toPandas().sort_values("pattern")
    votes, counts = votes_of(table["pattern"].to_numpy(np.int64)), table["count"].to_numpy(float)
    return fit(lambda s, r: sums(votes, counts, s, r))


def quality(docs: DataFrame, keep: float = KEEP, in_driver: int = IN_DRIVER) -> DataFrame:
    """Base figures, ``base_failed``, ``p_good`` and ``kept`` for each row of ``docs`` (``doc_id``, ``text``).

    Also ``n_bad``, how many rules object. Null, empty or blank text has no words, fails the base and isn't kept; ``p_good``
    is null where the base failed. A text is kept from ``p_good`` = ``keep`` on. Repeated rows get equal values. Other columns
    are left out. Empty table: empty result.
    """
    found = materialize(features(docs), "quality_features")
    share, rate = learned(found, in_driver)

    @F.pandas_udf("double")
    def p_good(pattern: pd.Series) -> pd.Series:
        return pd.Series(posterior(votes_of(pattern.to_numpy()), share, rate)[:, 0])

    out = found.withColumn("p_good", F.when(~F.col("base_failed"), p_good("pattern")))
    digits = [F.floor(F.col("pattern") / 3**j) % 3 == 2 for j in range(len(RULES))]
    return out.withColumns({"kept": F.coalesce(F.col("p_good") >= keep, F.lit(False)), "n_bad": sum(d.cast("int") for d in digits)}).select("doc_id", *BASE, "base_failed", "kept", "p_good", "n_bad")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"))
