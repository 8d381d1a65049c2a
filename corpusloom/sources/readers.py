"""Readers: word lists, delimited and free text, JSON, XLSX and DOCX, each to rows of one schema.

Files are read by Spark's own readers (``binaryFile``, ``text``), so that any store they reach will do; a file that
can't be parsed is one row of status, not a failed job.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

ROW = "file string, ordinal long, word string, definition string, spelling_rule string, grammar_note string, examples array<string>"
FIELDS = ("word", "definition", "spelling_rule", "grammar_note", "examples")
EXTENSIONS = ("txt", "dic", "csv", "tsv", "json", "xlsx", "docx")
UNSUPPORTED = ("xls", "doc")
# What a column's head holds, and a JSON object's keys, by field.
HEADS = {
    "word": ("word", "сўз", "суз", "so'z", "soz", "term"), "definition": ("definition", "meaning", "изоҳ", "изох", "таъриф", "tarif", "ta'rif"),
    "spelling_rule": ("spelling", "имло", "imlo", "rule", "қоида", "qoida"), "grammar_note": ("grammar", "grammatika", "грамматика", "note"),
    "examples": ("example", "examples", "мисол", "misol"),
}
JSON_KEYS = {
    "word": ("word", "term", "text", "name", "latin", "cyrillic"), "definition": ("definition", "meaning", "izoh", "ta'rif", "tarif"),
    "spelling_rule": ("spellingrule", "spelling", "imlo", "rule"), "grammar_note": ("grammarnote", "grammar", "note"), "examples": ("examples", "misollar"),
}
JSON_LISTS = ("words", "entries", "items", "data", "rows", "dictionary", "lexicon")
SEPARATORS = (" — ", " - ", ": ", " : ")
_EXAMPLES = re.compile(r"[\r\n;|•]")


def word_list(spark: SparkSession, path: str, comments: bool = True) -> DataFrame:
    """``(word)``: a word a line, normalised and distinct; lines of ``#`` are comments in main lexicons."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")
    lines = lines.where(~F.col("line").startswith("#")) if comments else lines
    return lines.select(T.normalize_word(F.col("line")).alias("word")).where("word <> ''").distinct()


def decode(data: bytes) -> str:
    """UTF-16 or UTF-8 by its mark, else strict UTF-8, else the whole file as Windows-1251."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1251", "replace")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """``(file, text)`` with the encoding found by looking: natively where the bytes are UTF-8, else by ``decode``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"file": b["path"], "text": [decode(bytes(x)) for x in b["content"]]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    plain = F.is_valid_utf8(F.col("content").cast("string")) & ~F.hex(F.substring("content", 1, 3)).rlike("^(EFBBBF|FFFE|FEFF)")
    good = files.where(plain).select(F.col("path").alias("file"), F.col("content").cast("string").alias("text"))
    return good.unionByName(files.where(~plain).mapInPandas(run, "file string, text string"))


def records(text: str, delimiter: str) -> list[list[str]]:
    """Delimited records: quotes toggle anywhere, doubled ones are quotes, quoted line ends are kept; fields trimmed."""
    out, row, field, quoted, i = [], [], [], False, 0
    text = text.replace("\r\n", "\n").replace("\r", "\n") + "\n"
    while i < len(text):
        c = text[i]
        if c == '"':
            if quoted and text[i + 1 : i + 2] == '"':
                field.append(c)
                i += 1
            else:
                quoted = not quoted
        elif c == delimiter and not quoted or c == "\n" and (not quoted or i == len(text) - 1):
            row.append("".join(field).strip())
            field = []
            if c == "\n":
                if len(row) > 1 or row[0]:
                    out.append(row)
                row = []
        else:
            field.append(c)
        i += 1
    return out


def find_delimiter(text: str) -> str:
    """By the first record with content, outside quotes: tab before semicolon before comma; comma if there is none."""
    for line in text.replace("\r", "\n").split("\n"):
        if line.strip():
            plain = re.sub(r'"[^"]*"', "", line)
            counts = [plain.count(d) for d in "\t;,"]
            return "\t;,"[counts.index(max(counts))] if max(counts) else ","
    return ","


def map_header(cells: list[str]) -> dict[str, int] | None:
    """Columns by field if the first row is a header that names the word; fields it doesn't name keep their usual place."""
    found: dict[str, int] = {}
    for i, cell in enumerate(c.strip().lower() for c in cells):
        field = next((f for f, keys in HEADS.items() if f not in found and any(k in cell for k in keys)), None)
        if cell and field:
            found[field] = i
    return {f: found.get(f, k) for k, f in enumerate(FIELDS)} if "word" in found else None


def split_examples(raw: str | None) -> list[str]:
    return [x.strip() for x in _EXAMPLES.split(raw or "") if x.strip()]


def table_rows(table: list[list[str]]) -> list[dict]:
    if not table:
        return []
    header = map_header(table[0])
    at, rows = (header, table[1:]) if header else (dict(zip(FIELDS, range(5), strict=True)), table)
    cell = lambda r, f: r[at[f]] if at[f] < len(r) else None
    return [{f: split_examples(cell(r, f)) if f == "examples" else cell(r, f) for f in FIELDS} for r in rows if (cell(r, "word") or "").strip()]


def likely_word(v: str) -> bool:
    return bool(v.strip()) and len(v) <= 100 and sum(map(str.isspace, v)) <= 2


def structured_line(line: str) -> dict | None:
    """A word and what is said of it: fields between bars or tabs, or a word before a dash or colon."""
    row = dict.fromkeys(FIELDS) | {"examples": []}
    mark = next((m for m in "|\t" if m in line), None)
    if mark:
        cells = [c.strip() for c in line.split(mark)]
        if len(cells) >= 2 and likely_word(cells[0]):
            row |= dict(zip(FIELDS, cells, strict=False))
            return row | {"examples": split_examples(cells[4]) if len(cells) > 4 else []}
    for sep in SEPARATORS:
        left, found, right = line.partition(sep)
        if found and left and likely_word(left.strip()) and right.strip():
            return row | {"word": left.strip(), "definition": right.strip()}
    return None


def text_rows(text: str) -> list[dict]:
    """Each line as ``structured_line`` has it, else a row a word."""
    import regex

    out = []
    for line in re.split(r"\r\n|\n|\r", text):
        row = structured_line(line) if line.strip() else None
        out += [row] if row else [dict.fromkeys(FIELDS) | {"word": w, "examples": []} for w in regex.findall(T.TOKEN, line)]
    return out


def json_rows(node) -> list[dict]:
    """Walks a parsed file: strings are words, objects rows by their keys; below an object, the first list key it has."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out += [dict.fromkeys(FIELDS) | {"word": x, "examples": []}] if x.strip() else []
        elif isinstance(x, list):
            todo += reversed(x)
        elif isinstance(x, dict):
            low = {str(k).lower(): v for k, v in x.items()}
            get = lambda f: next((low[k] for k in JSON_KEYS[f] if low.get(k) not in (None, "")), None)
            word = get("word")
            if word is not None and not isinstance(word, list | dict):
                said = get("examples")
                examples = [str(e).strip() for e in said if str(e).strip()] if isinstance(said, list) else split_examples(said)
                out.append({f: None if get(f) is None else str(get(f)) for f in FIELDS[:4]} | {"examples": examples})
            below = next((low[k] for k in JSON_LISTS if isinstance(low.get(k), list | dict)), None)
            if below is not None:
                todo.append(below)
    return out


def xlsx_table(data: bytes) -> list[list[str]]:
    """The first sheet's cells, by row and column letters; shared, inline and plain values."""
    name = lambda e: e.tag.rpartition("}")[2]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parse = lambda p: ElementTree.fromstring(z.read(p))
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter() if name(t) == "t") for si in parse("xl/sharedStrings.xml")]
        sheet = "xl/worksheets/sheet1.xml"
        if "xl/workbook.xml" in z.namelist() and "xl/_rels/workbook.xml.rels" in z.namelist():
            first = next((e for e in parse("xl/workbook.xml").iter() if name(e) == "sheet"), None)
            rid = next((v for k, v in first.attrib.items() if k.endswith("}id")), None) if first is not None else None
            target = next((r.get("Target") for r in parse("xl/_rels/workbook.xml.rels") if r.get("Id") == rid), None)
            sheet = target.lstrip("/") if target and target.startswith("/") else f"xl/{target}" if target else sheet
        table = []
        for row in (e for e in parse(sheet).iter() if name(e) == "row"):
            cells: dict[int, str] = {}
            for k, c in enumerate(e for e in row if name(e) == "c"):
                letters = re.match(r"[A-Z]*", c.get("r", ""))[0]
                at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1 if letters else k
                value = next((v.text or "" for v in c if name(v) == "v"), "")
                if c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter() if name(t) == "t")
                elif c.get("t") == "s" and value:
                    value = shared[int(value)]
                cells[at] = value.strip()
            if any(cells.values()):
                table.append([cells.get(i, "") for i in range(max(cells) + 1)])
        return table


def docx_text(data: bytes) -> str:
    """A document's paragraphs, a line each."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    name = lambda e: e.tag.rpartition("}")[2]
    return "\n".join("".join(t.text or "" for t in p.iter() if name(t) == "t") for p in root.iter() if name(p) == "p")


def rows_of(path: str, data: bytes) -> list[dict]:
    """A file's rows by its extension; unknown ones are text."""
    kind = path.rpartition(".")[2].lower()
    if kind in UNSUPPORTED:
        raise ValueError(f".{kind} needs an office suite; save it as .{kind}x")
    if kind == "xlsx":
        return table_rows(xlsx_table(data))
    if kind == "docx":
        return text_rows(docx_text(data))
    text = decode(data)
    if kind == "json":
        try:
            return json_rows(json.loads(text))
        except ValueError:
            return []
    if kind in ("csv", "tsv"):
        return table_rows(records(text, find_delimiter(text)))
    return text_rows(text)


def import_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, status)`` of a file or of a folder's files with a known extension; a bad file is a status, not a failure."""
    glob = "*.{" + ",".join(EXTENSIONS + UNSUPPORTED) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows, error = rows_of(file, bytes(content)), None
                except Exception as e:  # noqa: BLE001  whatever is wrong with a file is its status
                    rows, error = [], f"{type(e).__name__}: {e}"
                for k in range(0, len(rows), 5000):
                    out = pd.DataFrame(rows[k : k + 5000], columns=list(FIELDS))
                    out.insert(0, "file", file)
                    out.insert(1, "ordinal", range(k, k + len(out)))
                    yield out.assign(rows=0, error=None)
                yield pd.DataFrame({"file": [file], "ordinal": [-1]} | {f: [None] for f in FIELDS} | {"rows": [len(rows)], "error": [error]})

    found = files.mapInPandas(parse, f"{ROW}, rows long, error string")
    return found.where("ordinal >= 0").drop("rows", "error"), found.where("ordinal < 0").select("file", "rows", "error")


def table_columns(df: DataFrame) -> DataFrame:
    """A table read by Spark with its columns mapped by their heads."""
    at = map_header(df.columns) or dict(zip(FIELDS, range(5), strict=True))
    pick = lambda f: F.col(f"`{df.columns[at[f]]}`") if at[f] < len(df.columns) else F.lit(None).cast("string")
    examples = F.filter(F.transform(F.split(F.coalesce(pick("examples"), F.lit("")), r"[\r\n;|•]"), F.trim), lambda x: x != "")
    return df.select(*(F.trim(pick(f)).alias(f) for f in FIELDS[:4]), examples.alias("examples")).where("coalesce(word, '') <> ''")


def parse_enabled(raw: Column, default: bool = True) -> Column:
    """Whether a cell says yes or no; else ``default``."""
    v = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    yes, no = ("true", "1", "yes", "y", "enabled", "on", "ha", "faol", "ҳа", "фаол"), ("false", "0", "no", "n", "disabled", "off", "yo'q", "nofaol", "йўқ", "нофаол")
    return F.when(v.isin(*yes), True).when(v.isin(*no), False).otherwise(F.lit(default))


def exceptions_table(spark: SparkSession, path: str) -> DataFrame:
    """``(ordinal, original, replacement, category, enabled)`` from a JSON list; rows lacking a side are dropped."""
    schema = "Original string, Replacement string, Category string, Description string, Note string, Enabled string"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path).withColumn("ordinal", F.monotonically_increasing_id())
    good = rows.where("trim(coalesce(Original, '')) <> '' and trim(coalesce(Replacement, '')) <> ''")
    return good.select("ordinal", F.trim("Original").alias("original"), F.trim("Replacement").alias("replacement"), F.coalesce("Category", F.lit("Other")).alias("category"), parse_enabled(F.col("Enabled")).alias("enabled"))
