"""Rows written for people: CSV, JSON lines and XLSX, streamed through the driver as single
files (exports are bounded by a row limit per job), and tables replaced as a whole."""

from __future__ import annotations

import json
import os
import re
import zipfile
from collections.abc import Iterator
from decimal import Decimal
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the columns of an exported product, in order.
PRODUCT_COLUMNS = ("title", "brand", "price", "currency", "available", "url", "sku", "sizes", "images", "description", "source_platform")


def flat(c: str, kind: str) -> Column:
    """A value as one text: lists joined by " | ", null as an empty text."""
    col = F.col(c)
    if kind.startswith("array"):
        return F.coalesce(F.array_join(col.cast("array<string>"), " | "), F.lit(""))
    if kind == "boolean":
        return F.coalesce(F.initcap(col.cast("string")), F.lit(""))
    if kind.startswith("decimal"):
        # the digits as recorded, without the column's padding
        return F.coalesce(F.regexp_replace(F.regexp_replace(col.cast("string"), r"(\.\d*?[1-9])0+$", "$1"), r"\.0+$", ""), F.lit(""))
    return F.coalesce(col.cast("string"), F.lit(""))


def product_rows(products: DataFrame) -> DataFrame:
    kinds = dict(products.dtypes)
    return products.select(*[flat(c, kinds[c]).alias(c) for c in PRODUCT_COLUMNS])


def record_columns(records: DataFrame) -> list[str]:
    """The fields of ``records(row, data map)``, in the order in which they first come up."""
    at = records.select("row", F.posexplode(F.map_keys("data")).alias("pos", "k")).groupBy("k").agg(F.min(F.struct("row", "pos")).alias("at"))
    return [r["k"] for r in at.orderBy("at").collect()]


def record_rows(records: DataFrame) -> DataFrame:
    """``records(row, url, source_platform, data map<string,string>)`` as one column per field, then
    address and platform; a field the row lacks is an empty text."""
    names = record_columns(records)
    return records.select("row", *[F.coalesce(F.col("data")[n], F.lit("")).alias(n) for n in names], F.coalesce("url", F.lit("")).alias("url"), F.coalesce("source_platform", F.lit("")).alias("source_platform"))


def _lines(df: DataFrame) -> Iterator[list[str]]:
    for r in df.toLocalIterator():
        yield ["" if v is None else " | ".join(map(str, v)) if isinstance(v, list) else str(v) for v in r]


def write_csv(df: DataFrame, path: str) -> int:
    """UTF-8 with a byte-order mark and a header."""
    import csv

    n = 0
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        for n, row in enumerate(_lines(df), 1):  # noqa: B007
            out.writerow(row)
    return n


def _plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    return v if v is None or isinstance(v, (str, int, float, bool)) else str(v)


def write_jsonl(df: DataFrame, path: str) -> int:
    """One object a line; decimals as numbers, letters as they are."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        for n, row in enumerate(df.toLocalIterator(), 1):  # noqa: B007
            f.write(json.dumps(_plain(row.asDict(recursive=True)), ensure_ascii=False) + "\n")
    return n


def _cell_name(col: int, row: int) -> str:
    name = ""
    while col:
        col, rest = divmod(col - 1, 26)
        name = chr(65 + rest) + name
    return f"{name}{row}"


#: A sheet holds no more rows, its header among them.
XLSX_ROWS = 1_048_576


def write_xlsx(df: DataFrame, path: str, wide: tuple[str, ...] = ("title", "url", "description", "images")) -> int:
    """A workbook with one sheet "data", its header frozen; text columns that run long are wider."""
    bad = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        ns = "http://schemas.openxmlformats.org"
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="{ns}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{ns}/package/2006/relationships"><Relationship Id="r1" Type="{ns}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{ns}/spreadsheetml/2006/main" xmlns:r="{ns}/officeDocument/2006/relationships"><sheets><sheet name="data" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{ns}/package/2006/relationships"><Relationship Id="r1" Type="{ns}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:

            def line(i: int, values: list[str]) -> None:
                cells = "".join(f'<c r="{_cell_name(j, i)}" t="inlineStr"><is><t xml:space="preserve">{escape(bad.sub("", v))}</t></is></c>' for j, v in enumerate(values, 1))
                f.write(f'<row r="{i}">{cells}</row>'.encode())

            cols = "".join(f'<col min="{j}" max="{j}" width="{60 if c in wide else 24}" customWidth="1"/>' for j, c in enumerate(df.columns, 1))
            f.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{ns}/spreadsheetml/2006/main"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><cols>{cols}</cols><sheetData>'.encode())
            line(1, df.columns)
            for n, row in enumerate(_lines(df), 1):
                if n >= XLSX_ROWS:
                    raise ValueError(f"a sheet holds {XLSX_ROWS - 1} rows; write .csv or .jsonl, or fewer rows")
                line(n + 1, row)
            f.write(b"</sheetData></worksheet>")
    return n


def write(df: DataFrame, path: str, most: int | None = None) -> int:
    """By the path's ending: .csv, .jsonl, .ndjson or .xlsx. Rows written. The file is one, written by
    the driver row by row; with ``most`` a longer table is refused before anything is written."""
    if most is not None and df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows to export")
    kind = os.path.splitext(path)[1].lower()
    writers = {".csv": write_csv, ".jsonl": write_jsonl, ".ndjson": write_jsonl, ".xlsx": write_xlsx}
    if kind not in writers:
        raise ValueError(f"cannot write {kind or 'a file without ending'}; use .csv, .jsonl, .ndjson or .xlsx")
    return writers[kind](df, path)


def replace_table(df: DataFrame, path: str) -> None:
    """A table replaced as a whole: written beside the old one, then renamed into its place, so
    readers see the old rows or the new ones. One writer at a time."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    new, old, here = (jvm.org.apache.hadoop.fs.Path(path + end) for end in (".new", ".old", ""))
    df.write.mode("overwrite").parquet(path + ".new")
    fs = here.getFileSystem(conf)
    fs.delete(old, True)
    if fs.exists(here):
        fs.rename(here, old)
    fs.rename(new, here)
    fs.delete(old, True)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table as replaced last; an empty one where there is none or it cannot be read."""
    from pyspark.errors import AnalysisException

    for at in (path, path + ".old"):
        try:
            return spark.read.schema(schema).parquet(at)
        except AnalysisException:
            continue
    return spark.createDataFrame([], schema)


def backup(df: DataFrame, path: str) -> bool:
    """A snapshot of a table, written only if it differs from the last one; whether it was."""
    last = _last(df, path)
    if last is not None and df.exceptAll(last).isEmpty() and last.exceptAll(df).isEmpty():
        return False
    replace_table(df, path)
    return True


def _last(df: DataFrame, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return df.sparkSession.read.schema(df.schema).parquet(path)
    except AnalysisException:
        return None


def restore(spark: SparkSession, path: str, snapshot: str) -> bool:
    """The snapshot put in place of a table that is missing or cannot be read; a readable one stays."""
    from pyspark.errors import AnalysisException

    try:
        spark.read.parquet(path).schema
        return False
    except AnalysisException:
        pass
    try:
        replace_table(spark.read.parquet(snapshot), path)
    except AnalysisException:
        return False
    return True
