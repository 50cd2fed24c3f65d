"""CSV with the semantics that the built-in reader lacks: blank lines are rows without fields, ragged rows stay ragged, text after a closing quote joins the field."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import as_number

BOM = "\ufeff"


def parse(text: str, delimiter: str = ",", quote: str = '"', strip_bom: bool = True) -> Iterator[list[str]]:
    """The rows of a whole CSV text. CR, LF and CRLF end a row; inside quotes they are data, and a doubled quote is one.

    A quote opens a field only at its start. An unterminated quote runs to the end of the text.
    """
    plain = re.compile(f"[^{re.escape(delimiter)}\r\n]*")
    if strip_bom and text.startswith(BOM):
        text = text[1:]
    at, end, row = 0, len(text), []
    while at < end or row:
        field, quoted = "", False
        if at < end and text[at] == quote:
            quoted, at = True, at + 1
            parts = []
            while True:
                close = text.find(quote, at)
                if close < 0:
                    parts.append(text[at:])
                    at = end
                    break
                parts.append(text[at:close])
                at = close + 1
                if at < end and text[at] == quote:
                    parts.append(quote)
                    at += 1
                    continue
                break
            field = "".join(parts)
        m = plain.match(text, at)
        field += m[0]
        at = m.end()
        if at < end and text[at] == delimiter:
            row.append(field)
            at += 1
            if at == end:
                row.append("")
                yield row
                return
            continue
        yield row + [field] if row or field or quoted else []
        row = []
        if at < end:
            at += 2 if text.startswith("\r\n", at) else 1


def naive(text: str) -> list[list[str]]:
    """Lines split at commas: what quoting breaks."""
    return [line.split(",") for line in text.splitlines()]


def read_rows(spark: SparkSession, path: str, delimiter: str = ",", quote: str = '"') -> DataFrame:
    """(file, row_id, fields): every row of every file, which is read whole because a quote may span lines."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows, start = [], 0
                for r in parse(raw.decode("utf-8-sig", "replace"), delimiter, quote):
                    rows.append(r)
                    if len(rows) == 10_000:
                        yield _batch(pa, name, start, rows)
                        start, rows = start + len(rows), []
                if rows:
                    yield _batch(pa, name, start, rows)

    return files.mapInArrow(run, "file string, row_id long, fields array<string>")


def _batch(pa, name, start, rows):
    return pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(range(start, start + len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.string()))], names=["file", "row_id", "fields"])


def read_text_table(spark: SparkSession, path: str, exact: bool = False) -> DataFrame:
    """A table of text cells by its header, with row_id; BOM stripped, missing cells empty. exact reads with the grammar above and drops surplus fields."""
    if not exact:
        df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
        return df.fillna("").withColumn("row_id", F.monotonically_increasing_id())
    rows = read_rows(spark, path)
    header = rows.where("row_id = 0").select("fields").first()["fields"]
    return rows.where("row_id > 0 and size(fields) > 0").select("row_id", *[F.coalesce(F.get("fields", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(header)])


def write_table(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Chosen columns in their order, with a header and doubled quotes."""
    df.select(*(columns or df.columns)).write.csv(path, header=True, escape='"', quote='"')


def import_expenses(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, refused) of rows with date, category and amount as text: a real date, a category, a positive amount."""
    date = F.try_to_date("date", "yyyy-MM-dd")
    amount = as_number(F.col("amount"))
    ok = F.coalesce(F.col("date").rlike(r"\A\d{4}-\d{2}-\d{2}\z") & date.isNotNull() & (F.length(F.trim("category")) > 0) & (amount > 0), F.lit(False))
    return rows.where(ok).withColumns({"date": date, "amount": amount}), rows.where(~ok)


def failure_cause(got, want):
    """Column: why rows (arrays of arrays of fields) that a naive split got differ from the right ones, by the first cause that applies; null if they do not differ."""
    has = lambda rows, signs: F.exists(rows, lambda row: F.exists(row, lambda f: f.rlike(signs)))
    both = F.arrays_zip(got.alias("g"), want.alias("w"))
    cells = F.filter(F.flatten(F.transform(both, lambda p: F.arrays_zip(p["g"].alias("g"), p["w"].alias("w")))), lambda p: p["g"] != p["w"])
    cell = F.get(cells, F.lit(0))
    wide = F.get(F.filter(both, lambda p: F.size(p["g"]) != F.size(p["w"])), F.lit(0))
    by_width = F.when(F.exists(wide["w"], lambda f: f.contains(",")), "comma in quotes").when(F.size(wide["w"]) == 0, "blank line").otherwise("number of fields")
    by_cell = F.when(cell["g"] == F.concat(F.lit('"'), cell["w"], F.lit('"')), "quotes kept").when(cell["g"].contains('""'), "doubled quote").otherwise("other value")
    by_rows = F.when(has(want, r"[\r\n]"), "newline in quotes").otherwise("number of rows")
    return F.when(got == want, F.lit(None)).when(F.size(got) != F.size(want), by_rows).when(wide.isNotNull(), by_width).otherwise(by_cell)


def positional(lines: DataFrame, columns: list[str], line_col: str = "line") -> tuple[DataFrame, DataFrame]:
    """(rows, refused) of lines split at commas: columns by position, surplus cells dropped and missing ones null; blank lines vanish. refused holds the lines whose number of cells is another one; they stand in rows too."""
    t = lines.where(F.length(F.trim(line_col)) > 0).withColumn("_cells", F.split(line_col, ","))
    return t.select("*", *[F.get("_cells", F.lit(i)).alias(c) for i, c in enumerate(columns)]).drop("_cells"), t.where(F.size("_cells") != len(columns)).drop("_cells")


def export_expenses(rows: DataFrame) -> DataFrame:
    """(date, description, amount) as text: expenses leave with a minus sign and two decimals, as an account statement has them."""
    return rows.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "description", F.format_string("%.2f", (-F.col("amount")).cast("double")).alias("amount"))
