"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

The patterns' matches are found natively: a text is split at the matches, and running lengths of the pieces
give the places. To these the method adds tokens that look random, whether or not a pattern's match holds them: two
first-order Markov models over characters, one of random strings and one of ordinary identifiers, are trained by
counting character pairs in labelled samples, and a token whose log-likelihood ratio is high enough is a span of
kind ``random``. What speaks for randomness is summed over a token's pairs, so a short token needs more of each pair than a long one.
All is DataFrame expressions; the models are one array literal of log ratios by character pair.

Labelled samples are tables ``(token, random)``. By default there are two, and a model is the mean of what each teaches. One is
made by rule, for alphabets that no pattern has a value in: strings in the alphabets of keys and digests, and identifiers put
together from ordinary words in the usual styles, with numbers. The other is of the documents themselves, of SAMPLED of them: values
that the patterns find are random and other tokens are not, but where the first models say the opposite, as a password
may be a word and a key may stand without a pattern. A part of both is held out to measure precision and recall.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .common import read, shielded, unit_interval

#: Kind, pattern, the group that is measured, and its least length. The order of kinds at equal starts.
PATTERNS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: A match is at least so long, which lets most texts be passed over by one cheap look.
LOOK = (r"(?i:passw|secret|token|api_?key)", r"AKIA", r"[0-9a-f]{32}")
#: A maximal run is the match whatever its least length, so short runs of the last two kinds needn't be split off.
EXACT = {1: r"AKIA[A-Z0-9]{12,}+", 2: r"(?<![0-9a-f])[0-9a-f]{32,}+"}
#: Tokens that the models judge. A random one has each pair twice as likely on average, and all together as much likelier as 19 such pairs
#: are: a token of 20 characters needs no more than the average, one of 12 has to be 3.3 times as likely a pair.
TOKEN, MIN_RATIO, KIND = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}+={0,2}", math.log(2), "random"
MIN_TOTAL = 19 * MIN_RATIO
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
#: Labelled samples of each kind, of which every HELD_OUT-th is held out.
SAMPLES, HELD_OUT, SMOOTHING, LEAN = 4000, 5, 0.5, 10.0
#: Documents that labels are taken from, roughly.
SAMPLED = 20_000
#: Words that identifiers are made of.
WORDS = """
    access account active address allocation and argument array background balance batch boundary browser buffer build cache
    callback check client collection column command compression condition configuration connection container content context
    control create customer database default delete delivery description developer display document domain download driver
    element enable encoding environment error estimate event exception execution expression feature file filter folder format
    frame function global group handler history identifier image index input install interface keyboard language last latest
    learning length level library limit local logging machine management memory message method model module network number
    object operation option order package page partition path payment permission pipeline process product project property
    public query queue record reference request resource response result route schedule schema search section sequence server
    service session setting shared signature source storage stream string system table thread token total transaction update
    user validation value view window worker alle andere arbeit bericht entwicklung gesellschaft geschwindigkeit möglichkeit
    versicherung wahrscheinlich zusammen ambiente ciudad considerar desarrollo establecimiento gobierno información nacional
    responsabilidad siempre ainsi beaucoup connaissance développement entreprise fondamentalement gouvernement naturellement
    quelque toujours although another between because everything however nevertheless something therefore thought through
    together understanding without yesterday
""".split()


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """``(token, random, held_out)``: ``n`` random strings and as many identifiers, always the same."""
    h = lambda *x: F.xxhash64(*(F.lit(y) if isinstance(y, int | str) else y for y in x))
    rows = spark.range(n).withColumn("held_out", F.col("id") % HELD_OUT == 0)
    bits = F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")), 512)
    base64 = F.base64(F.unhex(bits))
    plain = F.regexp_replace(base64, "[+/=\r\n]", "")
    kinds = [bits, F.upper(bits), F.regexp_replace(base64, "[=\r\n]", ""), plain, F.translate(F.regexp_replace(base64, "[=\r\n]", ""), "+/", "-_"), F.upper(plain)]
    secret = F.left(F.get(F.array(*kinds), F.col("id") % len(kinds)), F.pmod(h("length", F.col("id")), F.lit(29)) + 20)
    seen, unseen = (F.array(*map(F.lit, w)) for w in ([w for i, w in enumerate(WORDS) if i % HELD_OUT], WORDS[::HELD_OUT]))
    word = lambda k: F.when(F.col("held_out"), F.get(unseen, F.pmod(h("word", F.col("id"), k), F.size(unseen)))).otherwise(F.get(seen, F.pmod(h("word", F.col("id"), k), F.size(seen))))
    parts = F.transform(F.sequence(F.lit(1), F.pmod(h("parts", F.col("id")), F.lit(3)) + 2), word)
    titles = F.array_join(F.transform(parts, F.initcap), "")
    number = F.pmod(h("number", F.col("id")), F.lit(2100)).cast("string")
    digits = F.lpad(F.pmod(h("digits", F.col("id")), F.lit(10**16)).cast("string"), 16, "0")
    styles = [
        F.array_join(parts, "_"), F.array_join(parts, "-"), titles, F.concat(F.lower(F.left(titles, F.lit(1))), F.substring(titles, F.lit(2), F.char_length(titles))),
        F.upper(F.array_join(parts, "_")), F.array_join(parts, ""), F.array_join(parts, "/"), F.concat_ws("_", F.array_join(parts, "_"), number),
        F.concat(F.array_join(parts, "/"), F.lit("/"), number), F.concat_ws("-", number, number, F.array_join(parts, "-")), digits, F.upper(F.array_join(parts, "")),
    ]
    name = F.get(F.array(*styles), F.pmod(h("style", F.col("id")), F.lit(len(styles))))
    return rows.select(F.explode(F.array(F.struct(secret.alias("token"), F.lit(True).alias("random")), F.struct(name.alias("token"), F.lit(False).alias("random")))).alias("x"), "held_out").select("x.*", "held_out")


def codes(token: Column) -> Column:
    """Places of a token's characters in ALPHABET; other characters share the place after it."""
    return F.transform(F.split(token, ""), lambda c: F.coalesce(F.nullif(F.position(c, F.lit(ALPHABET)), F.lit(0)), F.lit(len(ALPHABET) + 1)) - 1)


def neighbours(token: Column, body) -> Column:
    """``body`` of each character's code and the next one's."""
    n = F.greatest(F.char_length(token) - 1, F.lit(0))
    return F.zip_with(F.slice(codes(token), F.lit(1), n), F.slice(codes(token), F.lit(2), n), body)


def pair_counts(labelled: DataFrame) -> DataFrame:
    """``(random, pair, n)``: how often one character (times the alphabet's size) is followed by another, by label."""
    pairs = F.explode(neighbours(F.col("token"), lambda a, b: a * (len(ALPHABET) + 1) + b))
    return labelled.where("token is not null and random is not null").select("random", pairs.alias("pair")).groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n"))


def log_probabilities(counts: dict[int, int]) -> list[float]:
    """A Markov model by pairs: log probabilities of the next character; rare pairs lean on how common the next is."""
    n = len(ALPHABET) + 1
    table = [[float(counts.get(a * n + b, 0)) for b in range(n)] for a in range(n)]
    single = [SMOOTHING + sum(row[b] for row in table) for b in range(n)]
    common = [x / sum(single) for x in single]
    return [math.log((x + LEAN * common[b]) / (sum(row) + LEAN)) for row in table for b, x in enumerate(row)]


def log_ratios(*labelled: DataFrame) -> list[float]:
    """Random's log-likelihood less identifiers', by character pair. What is collected has a row a label and pair of characters at most.

    Of several tables each gives a model of either kind, if it has any such token, and probabilities are averaged.
    """
    models: dict[bool, list[list[float]]] = {True: [], False: []}
    for table in labelled:
        counts: dict[bool, dict[int, int]] = {True: {}, False: {}}
        for r in pair_counts(table).collect():
            counts[r.random][r.pair] = r.n
        for kind, found in counts.items():
            if found:
                models[kind].append(log_probabilities(found))
    mean = lambda several: [math.log(sum(map(math.exp, x)) / len(x)) for x in zip(*(several or [log_probabilities({})]), strict=True)]
    return [p - q for p, q in zip(mean(models[True]), mean(models[False]), strict=True)]


def ratio(token: Column, ratios: Column) -> Column:
    """The mean log ratio of a token's character pairs."""
    n = len(ALPHABET) + 1
    return F.aggregate(neighbours(token, lambda a, b: F.get(ratios, a * n + b)), F.lit(0.0), lambda s, x: s + x) / (F.char_length(token) - 1)


def is_random(token: Column, ratios: Column, min_ratio: float = MIN_RATIO, min_total: float = MIN_TOTAL) -> Column:
    """Whether the mean is high enough, and the sum."""
    return ratio(token, ratios) >= F.greatest(F.lit(min_ratio), F.lit(min_total) / (F.char_length(token) - 1))


def labelled_documents(docs: DataFrame, ratios: list[float], sampled: int = SAMPLED) -> DataFrame:
    """``(token, random, held_out)`` of the tokens of some ``sampled`` documents by hash of doc_id: the patterns' values, and what is left without them.

    Values that ``ratios`` call ordinary and other tokens that they call random are left out. A fifth is held out, by doc_id.
    """
    rate = min(1.0, sampled / max(1, docs.count()))
    text, none = F.coalesce("text", F.lit("")), F.array().cast("array<string>")
    values, rest = [], text
    for k, ((_, pattern, group, least), look) in enumerate(zip(PATTERNS, LOOK, strict=True)):
        found = F.regexp_extract_all(text, F.lit(EXACT.get(k, pattern)), F.lit(group))
        values.append(F.when(text.rlike(look), F.filter(found, lambda x, least=least: F.char_length(x) >= least)).otherwise(none))
        rest = F.when(rest.rlike(look), F.regexp_replace(rest, EXACT.get(k, pattern), " ")).otherwise(rest)
    label = lambda tokens, random: F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(random).alias("random")))
    tokens = F.explode(F.concat(label(F.concat(*values), True), label(F.regexp_extract_all(rest, F.lit(TOKEN), F.lit(0)), False)))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % HELD_OUT == 0, F.lit(False))
    rows = docs.where(unit_interval(F.lit("secrets"), F.col("doc_id")) < rate).select(tokens.alias("x"), held.alias("held_out")).select("x.*", "held_out")
    said = rows.where(F.char_length("token") > 1).withColumn("_r", ratio(F.col("token"), F.array(*map(F.lit, ratios))))
    return said.where(F.when(F.col("random"), F.col("_r") > 0).otherwise(F.col("_r") < 0)).select("token", "random", "held_out")


def evaluate(labelled: DataFrame, ratios: list[float], min_ratio: float = MIN_RATIO) -> tuple[float, float]:
    """Precision and recall over labelled tokens that are long enough to be judged."""
    judged = labelled.where(F.col("token").rlike(TOKEN)).withColumn("_r", F.array(*map(F.lit, ratios)))
    said = judged.select("random", is_random(F.col("token"), F.col("_r"), min_ratio).alias("said"))
    r = said.agg(F.count_if(F.col("said") & F.col("random")).alias("both"), F.count_if("said").alias("said"), F.count_if("random").alias("random")).first()
    return r.both / max(1, r.said), r.both / max(1, r.random)


def spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 1, token: bool = False) -> Column:
    """``array<struct<start, kind, end>>`` of the pattern's matches whose ``group`` has ``least`` characters, in code points; with ``token`` also the match.

    Lengths are summed up by blocks, so that many matches in one text take time in proportion.
    """

    def placed(found: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        at = T.running_starts(F.flatten(F.zip_with(between, found, lambda b, m: F.array(F.char_length(b), F.char_length(m)))))

        def one(m: Column, i: Column, at: Column) -> Column:
            start = F.get(at, 2 * i + 1)
            return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.char_length(m)).alias("end"), *([m.alias("token")] if token else []))

        return T.let(at, lambda at: F.transform(found, lambda m, i: one(m, i, at)))

    made = T.let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    if not group:
        return F.filter(made, lambda s: s["end"] - s["start"] >= least) if least > 1 else made
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return T.let(tested, lambda t: F.filter(made, lambda _, i: F.char_length(F.get(t, i)) >= least))


def scan(docs: DataFrame, min_ratio: float = MIN_RATIO, labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``base`` and ``found``: ``array<struct<start, kind, end>>`` of the patterns' spans and of the models' more.

    ``kind`` is the place in PATTERNS, or after them for the models'. Null or empty text has no spans. Repeated rows get
    equal spans. Other columns pass through, whatever their names; ``base`` and ``found`` replace columns of the same names.
    The models learn from ``labelled`` (``token``, ``random``), by default from ``labelled_samples`` and ``labelled_documents`` but those held
    out. Empty table: empty result.
    """
    docs = docs.drop("base", "found")
    plain, spark = shielded(docs, "text", "doc_id"), docs.sparkSession
    if labelled is None:
        made = labelled_samples(spark).where("not held_out")
        ratios = log_ratios(made, labelled_documents(plain, log_ratios(made)).where("not held_out"))
    else:
        ratios = log_ratios(labelled)
    text, empty = F.coalesce("text", F.lit("")), F.array().cast("array<struct<start:int,kind:int,end:int>>")
    each = []
    for k, ((_, pattern, group, least), look) in enumerate(zip(PATTERNS, LOOK, strict=True)):
        each.append(F.when(text.rlike(look), spans(text, EXACT.get(k, pattern), k, group, least)).otherwise(empty))
    more = F.filter(spans(text, TOKEN, len(PATTERNS), token=True), lambda t: is_random(t["token"], F.col("_ratios"), min_ratio))
    bare = F.when(text.rlike(TOKEN), F.transform(more, lambda t: F.struct(t["start"].alias("start"), t["kind"].alias("kind"), t["end"].alias("end")))).otherwise(empty)
    found = plain.withColumns({"_base": F.array_sort(F.concat(*each)), "_ratios": F.array(*map(F.lit, ratios))})
    return found.select(*plain.columns, "_base", bare.alias("_found")).toDF(*docs.columns, "base", "found")


def listed(found: Column) -> Column:
    """kind:start:end by start, then kind as listed; comma-joined."""
    names = F.array(*(F.lit(p[0]) for p in PATTERNS), F.lit(KIND))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return docs.select("doc_id", *(count(k).alias(f"n_{p[0]}") for k, p in enumerate(PATTERNS)), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "found"))).alias("spans"))
