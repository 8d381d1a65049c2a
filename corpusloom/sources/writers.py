"""Writers: word lists, migrations, explanations, reports, and XLSX files."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.collation import sort_key
from ..operators import reports

SCHEMA_ID = "corpusloom-migration-v1"
_BAD = {c: None for c in range(32) if c not in (9, 10, 13)}
PACKAGE = {
    "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def write_word_list(words: DataFrame, path: str) -> None:
    """A word a line in order of the alphabet. Sorted by range, so that part files in order of name are the list."""
    words.select("word").distinct().orderBy(sort_key(F.col("word")), "word").write.mode("overwrite").text(path)


def write_dic(words: DataFrame, path: str) -> None:
    """Trimmed words without repeats but for case, in order of their upper-case form."""
    one = words.select(F.trim("word").alias("word")).where("word <> ''").groupBy(F.upper("word").alias("_u")).agg(F.min("word").alias("word"))
    one.orderBy("_u").select("word").write.mode("overwrite").text(path)


def write_migration(entries: DataFrame, path: str) -> None:
    """Entries as JSON lines, and beside them one line of header with their counts."""
    entries.write.mode("overwrite").json(f"{path}/entries", ignoreNullFields=True)
    said = F.coalesce("definition", F.lit("")) != ""
    head = entries.agg(F.lit(SCHEMA_ID).alias("schema"), F.count(F.lit(1)).alias("word_count"), F.count_if(said).alias("definition_count"))
    head.coalesce(1).write.mode("overwrite").json(f"{path}/header")


def write_explanations(explanations: DataFrame, path: str) -> None:
    blank = lambda c: F.when(F.trim(c) != "", F.col(c)).alias(c)
    explanations.select("word", blank("definition"), blank("spelling_rule"), blank("grammar_note"), F.when(F.size("examples") > 0, F.col("examples")).alias("examples")).write.mode("overwrite").json(path, ignoreNullFields=True)


def write_report(errors: DataFrame, path: str, kind: str) -> None:
    """A report's lines partitioned by document; kind is csv, short_csv, text, html or json."""
    rows = {"csv": reports.csv_rows, "short_csv": reports.short_csv_rows, "text": reports.text_rows, "html": reports.html_rows, "json": reports.json_rows}[kind](errors)
    rows.repartition("doc_id").sortWithinPartitions("doc_id", "no").select("doc_id", "line").write.mode("overwrite").partitionBy("doc_id").text(path)


def write_counts(counts: dict[str, DataFrame], path: str) -> None:
    """A language model: a table of counts each."""
    for name, df in counts.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def xlsx_bytes(head: list[str], rows: list[list], sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet of inline strings; characters that XML has no place for are dropped."""

    def letters(k: int) -> str:
        out = ""
        while k >= 0:
            out, k = chr(65 + k % 26) + out, k // 26 - 1
        return out

    def cell(r: int, k: int, v) -> str:
        return f'<c r="{letters(k)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(("" if v is None else str(v)).translate(_BAD))}</t></is></c>'

    body = "".join(f'<row r="{r}">{"".join(cell(r, k, v) for k, v in enumerate(row))}</row>' for r, row in enumerate([head, *rows], 1))
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    parts = PACKAGE | {
        "xl/workbook.xml": f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/worksheets/sheet1.xml": f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def workbooks(rows: DataFrame, key: str, head: list[str], columns: list[str], order: str, rows_per_book: int = 100_000) -> DataFrame:
    """``(key, book, content)``: a workbook for each key's rows, several for more than a sheet should hold."""
    import pandas as pd
    from pyspark.sql import Window

    rows = rows.withColumn("_book", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / rows_per_book))

    def make(keys, pdf):
        pdf = pdf.sort_values(order)
        return pd.DataFrame({key: [keys[0]], "book": [keys[1]], "content": [xlsx_bytes(head, pdf[columns].values.tolist())]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(*dict.fromkeys([key, "_book", order, *columns])).groupBy(key, "_book").applyInPandas(make, f"{key} {kind}, book long, content binary")
