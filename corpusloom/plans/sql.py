"""Pieces of DuckDB SQL that several oracles share."""

TOKEN = r"[\p{L}''ʻʼ‘’]+"
SEGMENT = rf"{TOKEN}|[^\p{{L}}''ʻʼ‘’]+"


def tokens(table: str = "documents", key: str = "doc_id", suffix: str = "") -> str:
    """CTEs ``seg``, ``run`` and ``tok``, with a suffix: tokens with places."""
    return rf"""
seg{suffix} AS (
  SELECT {key} AS doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{SEGMENT}')) AS s,
         generate_subscripts(regexp_extract_all(coalesce(text, ''), '{SEGMENT}'), 1) AS i FROM {table}
), run{suffix} AS (
  SELECT doc_id, s, i, length(s) AS n,
         coalesce(sum(length(s)) OVER before, 0) AS st, coalesce(sum(length(s) - length(replace(s, chr(10), ''))) OVER before, 0) AS br,
         lag(s) OVER (PARTITION BY doc_id ORDER BY i) AS prev, lead(s) OVER (PARTITION BY doc_id ORDER BY i) AS nxt
  FROM seg{suffix} WINDOW before AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), tok{suffix} AS (
  SELECT doc_id, (i - 1) // 2 AS pos, s AS original, translate(lower(s), 'ʻʼ‘’', '''''''''') AS normalized, st::BIGINT AS start_index,
         (st + n)::BIGINT AS end_index, (br + 1)::BIGINT AS paragraph_index, coalesce(prev, '') AS gap_before, coalesce(substr(nxt, 1, 1), '') AS next_char
  FROM run{suffix} WHERE regexp_matches(s, '^{TOKEN}')
)"""


SKIP = r"(length(normalized) <= 1 OR regexp_full_match(normalized, '[\p{Lu}.]+'))"


def matches(pattern: str, table: str = "documents", key: str = "doc_id") -> str:
    """CTE ``hit``: all matches of a pattern with places, by splitting at them."""
    return rf"""
parts AS (
  SELECT {key} AS doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS b FROM {table} WHERE regexp_matches(text, '{pattern}')
), piece AS (
  SELECT doc_id, unnest(b) AS b, unnest(list_concat(m, [''])) AS m, generate_subscripts(b, 1) AS i FROM parts
), placed AS (
  SELECT doc_id, m, i, sum(length(b)) OVER upto + coalesce(sum(length(m)) OVER before, 0) AS st,
         sum(length(b) - length(replace(b, chr(10), ''))) OVER upto + coalesce(sum(length(m) - length(replace(m, chr(10), ''))) OVER before, 0) AS br
  FROM piece WINDOW upto AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING), before AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), hit AS (SELECT doc_id, m, st::BIGINT AS start_index, (st + length(m))::BIGINT AS end_index, (br + 1)::BIGINT AS paragraph_index FROM placed WHERE m <> '')"""


def lexicon(min_docs: int = 2) -> str:
    """CTE ``lex``, after ``tok``."""
    return f"lex AS (SELECT normalized AS word, count(DISTINCT doc_id) AS df FROM tok WHERE length(normalized) > 1 GROUP BY 1 HAVING count(DISTINCT doc_id) >= {min_docs})"


ERRORS = rf"""
err AS (
  SELECT doc_id, normalized AS word, original AS original_text, start_index, end_index, paragraph_index FROM tok
  WHERE NOT {SKIP} AND normalized NOT IN (SELECT word FROM lex)
)"""


def to_cyrillic(column: str) -> str:
    """The Latin to Cyrillic chain without apostrophes, of which the tables have none."""
    from ..functions.translit import CYRILLIC_LETTERS, DIGRAPHS, LATIN_LETTERS

    for latin, cyrillic in DIGRAPHS:
        column = f"replace({column}, '{latin}', '{cyrillic}')"
    return f"translate({column}, '{LATIN_LETTERS}', '{CYRILLIC_LETTERS}')"


#: Optimal string alignment as a macro-like expression over two words, by rows of the table.
def osa(a: str, b: str) -> str:
    cell = (
        "least(r[len(r)] + 1, s.p[j + 1] + 1, s.p[j] + (CASE WHEN {a}[i] = {b}[j] THEN 0 ELSE 1 END),"
        " CASE WHEN i > 1 AND j > 1 AND {a}[i] = {b}[j - 1] AND {a}[i - 1] = {b}[j] THEN s.q[j - 1] + 1 ELSE 999 END)"
    ).format(a=a, b=b)
    row = f"list_reduce(list_concat([[i]], list_transform(range(1, length({b}) + 1), lambda j: [j])), lambda r, jj: list_append(r, list_transform([jj[1]], lambda j: {cell})[1]))"
    return f"(list_reduce(list_concat([{{'i': 0, 'p': range(0, length({b}) + 1), 'q': range(0, length({b}) + 1)}}], list_transform(range(1, length({a}) + 1), lambda i: {{'i': i, 'p': CAST([] AS BIGINT[]), 'q': CAST([] AS BIGINT[])}})), lambda s, x: list_transform([x.i], lambda i: {{'i': i, 'p': {row}, 'q': s.p}})[1])).p[length({b}) + 1]"
