"""Error reports as rows: CSV, text, HTML and JSON; whoever writes them chooses the sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spelling

# Column heads and labels of the reports.
HEADS = ("№", "Сўз", "Тури", "Турлари", "Тузатиш варианти", "Параграф", "Контекст", "Сана")
SHORT_HEADS = ("№", "Сўз", "Тури", "Вариант", "Параграф", "Контекст")
GRAMMAR, SPELLING = "Грамматика", "Имло"


def csv_cell(x: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(x, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def html_cell(x: Column) -> Column:
    out = F.coalesce(x, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def kind(rule_id: Column) -> Column:
    return F.when(rule_id.isNull(), SPELLING).otherwise(GRAMMAR)


def numbered(errors: DataFrame, key: str = "doc_id") -> DataFrame:
    """Unresolved errors with ``no`` from 1 within each document's report."""
    order = Window.partitionBy(key).orderBy("start_index", "end_index", F.coalesce("rule_id", F.lit("")))
    return errors.where(~F.col("is_resolved")).withColumn("no", F.row_number().over(order))


def csv_rows(errors: DataFrame, key: str = "doc_id", suggestions: bool = True, paragraphs: bool = True, context: bool = True) -> DataFrame:
    """``(key, no, line)``: a report's lines, text cells quoted."""
    cells = [F.col("no").cast("string"), csv_cell(F.col("word")), kind(F.col("rule_id")), F.col("severity")]
    cells += [csv_cell(F.col("suggestion"))] * suggestions + [F.col("paragraph_index").cast("string")] * paragraphs + [csv_cell(F.col("context"))] * context
    if "detected_at" in errors.columns:
        cells.append(F.date_format("detected_at", "dd.MM.yyyy HH:mm"))
    return numbered(errors, key).select(key, "no", F.concat_ws(",", *cells).alias("line"))


def short_csv_rows(errors: DataFrame, key: str = "doc_id") -> DataFrame:
    """The quick export: only the context's quotes are made harmless."""
    cells = [F.col("no").cast("string"), F.coalesce("word", F.lit("")), kind(F.col("rule_id")), F.coalesce("suggestion", F.lit("")), F.col("paragraph_index").cast("string"), F.concat(F.lit('"'), F.replace(F.coalesce("context", F.lit("")), F.lit('"'), F.lit("'")), F.lit('"'))]
    return numbered(errors, key).select(key, "no", F.concat_ws(",", *cells).alias("line"))


def text_rows(errors: DataFrame, key: str = "doc_id") -> DataFrame:
    line = F.concat(F.lit("  "), F.lpad(F.col("no").cast("string"), 3, " "), F.lit(". "), F.coalesce("word", F.lit("?")), F.when(F.coalesce("suggestion", F.lit("")) != "", F.concat(F.lit("  →  "), F.col("suggestion"))).otherwise(F.lit("")), F.lit("  (§"), F.col("paragraph_index").cast("string"), F.lit(")"))
    context = F.when(F.trim(F.coalesce("context", F.lit(""))) != "", F.concat(F.lit("\n       Контекст: "), F.trim("context"))).otherwise(F.lit(""))
    return numbered(errors, key).select(key, "no", F.concat(line, context).alias("line"))


def html_rows(errors: DataFrame, key: str = "doc_id") -> DataFrame:
    cells = [F.col("no").cast("string"), html_cell(F.col("word")), kind(F.col("rule_id")), html_cell(F.col("suggestion")), F.col("paragraph_index").cast("string"), html_cell(F.col("context"))]
    return numbered(errors, key).select(key, "no", F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells), F.lit("</tr>")).alias("line"))


def bars(top: DataFrame) -> DataFrame:
    """Top words with the width of their bar, in whole percent of the longest."""
    longest = F.max("errors").over(Window.partitionBy())
    return top.withColumn("width", F.floor(F.col("errors") * 100 / longest).cast("int"))


def json_rows(errors: DataFrame, key: str = "doc_id") -> DataFrame:
    row = F.struct(F.col("no").alias("index"), "word", kind(F.col("rule_id")).alias("type"), "severity", "rule_id", "suggestion", F.col("paragraph_index").alias("paragraph"), "context")
    return numbered(errors, key).select(key, "no", F.to_json(row).alias("line"))


def preview(rows: DataFrame, n: int = 30) -> DataFrame:
    """The first ``n`` lines of each report, and a line on how many there are more."""
    total = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_t")).where(F.col("_t") > n)
    more = total.select("doc_id", F.lit(n + 1).alias("no"), F.concat(F.lit("... "), (F.col("_t") - n).cast("string")).alias("line"))
    return rows.where(F.col("no") <= n).select("doc_id", "no", "line").unionByName(more)


def summary(errors: DataFrame, key: str = "doc_id") -> DataFrame:
    return spelling.statistics(errors, key)
