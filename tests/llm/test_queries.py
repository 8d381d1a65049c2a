"""The registered queries over a whole small table: against DuckDB where there is SQL, else against brute force from the contract."""

import collections
import hashlib
import itertools
import math
import os
import re
import zlib

import numpy as np
import pytest
from corpusloom.llm import quality, queries, secret_scan, token_counts
from test_entry import SF, duck, rows  # noqa: F401  a fixture
from test_ops import brute_components, brute_fingerprint, brute_targets, words

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def documents(duck):  # noqa: F811
    return duck.execute("SELECT doc_id, text, lang, source FROM documents").fetchall()


@pytest.fixture(scope="module")
def result(spark):
    held = {}

    def run(name):
        if name not in held:
            held[name] = queries.QUERIES[name](spark, SF).toPandas()
        return held[name]

    return run


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_is_its_oracle(duck, result, name):  # noqa: F811
    assert rows(result(name)) == rows(duck.execute(queries.ORACLES[name]).df())


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)


def test_op2(documents, result):
    got = result("op2_mixing")
    sizes = collections.Counter()
    for _, text, _, source in documents:
        sizes[source] += len(words(text))
    source_of, size_of = {d[0]: d[3] for d in documents}, {d[0]: len(words(d[1])) for d in documents}
    want, taken, largest = brute_targets(sizes), collections.Counter(), collections.Counter()
    assert sorted(got["doc_id"]) == sorted(source_of)
    for r in got.itertuples():
        s = source_of[r.doc_id]
        assert r.size == size_of[r.doc_id] and r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert all(want[s] - largest[s] <= taken[s] <= want[s] + 1e-6 for s in want)


def test_op3(documents, result):
    """A recount, although the query revises and deletes on its way."""
    import tiktoken

    version, ranks = token_counts.load_ranks()
    e = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.defaultdict(lambda: [0, 0, 0])
    for _, text, lang, source in documents:
        for k, x in enumerate((1, len(e.encode_ordinary(text or "")), len((text or "").encode()))):
            want[source, lang][k] += x
    got = {(r.source, r.lang): [r.n_docs, r.n_tokens, r.n_bytes] for r in result("op3_token_counts").itertuples()}
    assert got == dict(want) and set(result("op3_token_counts")["tokenizer"]) == {version}


def test_op4(documents, result):
    got = {r.doc_id: r for r in result("op4_media_columns").itertuples()}
    assert len(got) == len(documents)
    for doc, text, *_ in documents:
        raw = (text or "").encode()
        padded = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got[doc]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert r.media_bytes > r.payload_bytes and len(r.media_sha256) == 64 and r.feature


def test_op5(documents, result):
    got = {r.doc_id: r for r in result("op5_quality").itertuples()}
    for doc, text, *_ in documents:
        w, lines, at = words(text), [x for x in (text or "").split("\n") if words(x)], collections.defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        cover = len({j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)})
        r = got[doc]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), cover)
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text or "")) and r.base_failed == (len(w) < 20 or 100 * cover > 30 * len(w))
        assert not (r.kept and r.base_failed)
    votes = {d[0]: tuple(int(rule.votes(np.array([x]))[0]) for rule, x in zip(quality.RULES, quality.figures(d[1], {})[5], strict=True)) for d in documents if not got[d[0]].base_failed}
    good = independent_em(collections.Counter(votes.values()))
    for doc, v in votes.items():
        assert abs(got[doc].p_good - good[v]) < 1e-6 and got[doc].kept == (good[v] >= 0.5)


def independent_em(patterns):
    """Each pattern's probability of good, from the method's description alone: plain sums, one pattern and rule after the other."""
    rules, kinds = range(len(quality.RULES)), list(dict.fromkeys(r.kind for r in quality.RULES))
    voted = [sum(n for v, n in patterns.items() if v[j]) for j in rules]
    objects = [sum(n for v, n in patterns.items() if v[j] == 2) / max(1, voted[j]) for j in rules]
    start = [[max(1e-3, objects[j] - 0.1) for j in rules]] + [[0.9 if quality.RULES[j].kind == k else max(1e-3, objects[j] - 0.1) for j in rules] for k in kinds]
    first = [0.9] + [0.1 / len(kinds)] * len(kinds)
    share, rate = first, start

    def odds(v):
        each = [math.log(s) + sum(math.log(r[j] if v[j] == 2 else 1 - r[j]) for j in rules if v[j]) for s, r in zip(share, rate, strict=True)]
        top = [math.exp(x - max(each)) for x in each]
        return [x / sum(top) for x in top]

    for _ in range(200):
        weight = {v: [n * p for p in odds(v)] for v, n in patterns.items()}
        total = [sum(w[c] for w in weight.values()) for c in range(len(share))]
        new = [(t + 20 * f) / (sum(total) + 20) for t, f in zip(total, first, strict=True)]
        said = lambda c, j, kinds: sum(w[c] for v, w in weight.items() if v[j] in kinds)
        table = [[(said(c, j, (2,)) + 20 * start[c][j]) / (said(c, j, (1, 2)) + 20) for j in rules] for c in range(len(share))]
        moved = max([abs(a - b) for a, b in zip(new, share, strict=True)] + [abs(a - b) for x, y in zip(table, rate, strict=True) for a, b in zip(x, y, strict=True)])
        share, rate = new, table
        if moved < 1e-9:
            break
    return {v: odds(v)[0] for v in patterns}


def test_op11_and_op12_have_rows(result):
    assert len(result("op12_exact_topk")) == 50 and len(result("op11_hard_negatives"))


def test_op7(spark, documents, result):
    """Base spans by the patterns, the models' by their log ratios: both worked out token by token."""
    docs = spark.createDataFrame([d[:2] for d in documents], "doc_id long, text string")
    made = secret_scan.labelled_samples(spark).where("not held_out")
    ratios = secret_scan.log_ratios(made, secret_scan.labelled_documents(docs, secret_scan.log_ratios(made)).where("not held_out"))
    n = len(secret_scan.ALPHABET) + 1
    code = lambda c: secret_scan.ALPHABET.find(c) if c in secret_scan.ALPHABET else n - 1
    token = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}={0,2}")
    got = {r.doc_id: r for r in result("op7_secret_scan").itertuples()}
    for doc, text, *_ in documents:
        base = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(secret_scan.PATTERNS) for m in re.finditer(p, text or "") if len(m[g]) >= n)
        listed = [f"{secret_scan.PATTERNS[k][0]}:{a}:{b}" for a, k, b in base]
        r = got[doc]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest() and (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        sums = ((m, sum(ratios[code(a) * n + code(b)] for a, b in itertools.pairwise(m[0]))) for m in token.finditer(text or ""))
        more = [(m.start(), len(secret_scan.PATTERNS), m.end()) for m, x in sums if x >= max(secret_scan.MIN_TOTAL, secret_scan.MIN_RATIO * (len(m[0]) - 1))]
        names = [p[0] for p in secret_scan.PATTERNS] + [secret_scan.KIND]
        assert r.spans == ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(base + more))


def test_op8(documents, result):
    got, sizes, held = result("op8_best_fit_packing"), collections.Counter(), collections.defaultdict(list)
    prints = [brute_fingerprint(t) for _, t, *_ in documents]
    near = dict(zip((d[0] for d in documents), brute_components(prints), strict=True))
    for r in got.itertuples():
        sizes[r.doc_id] += r.n_words
        held[r.bin_id].append(r)
    assert sizes == {d[0]: len(words(d[1])) for d in documents}
    for b in held.values():
        assert sum(r.n_words for r in b) == b[0].bin_words <= 2048 and len({near[r.doc_id] for r in b}) == len(b)
        assert max(collections.Counter(r.source for r in b).values()) <= 6


def test_op9(documents, result):
    truth = {d[0]: d[2] for d in documents}
    got = result("op9_language_id")
    assert sorted(got["doc_id"]) == sorted(truth) and got["score"].between(0, 1).all()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.itertuples())
    held = [r for r in got.itertuples() if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_op10(documents, result):
    prints = [brute_fingerprint(t) for _, t, *_ in documents]
    ids = brute_components(prints)
    least = {c: min(d[0] for d, x in zip(documents, ids, strict=True) if x == c) for c in set(ids)}
    want = sorted((d[0], f"{p:016x}", least[c]) for d, p, c in zip(documents, prints, ids, strict=True))
    assert sorted(result("op10_simhash").itertuples(index=False, name=None)) == want
