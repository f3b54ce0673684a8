"""Sinks: parsed documents and notices as JSON, notices under a derived file name."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revdiff.functions import text as T


def document_json(elements: DataFrame, doc: str = "doc_id", ord_col: str = "ord") -> DataFrame:
    """Documents as JSON, one row and one JSON value per document, elements in order."""
    fields = F.struct(*[c for c in elements.columns if c != doc])
    rank = F.struct(F.col(ord_col).alias("o"), fields.alias("e"))
    return (elements.groupBy(doc).agg(F.array_sort(F.collect_list(rank)).alias("x"))
            .select(doc, F.lit(0).alias("part"), F.to_json(F.struct(F.col(doc), F.transform("x", lambda r: r["e"]).alias("elements"))).alias("json")))


def write_json(elements: DataFrame, path: str, **kw) -> None:
    document_json(elements, **kw).select("json").write.mode("overwrite").text(path)


def json_lines(families: dict[str, DataFrame], doc: str = "doc_id") -> DataFrame:
    """One JSON value per document with a list for each family, as rows (doc, n, line): a document's lines in order are its value.

    Every frame carries `doc` and `ord`, which orders the elements of a document and is not written; the other columns are an element's fields, null ones left out.
    Elements are sorted and written one by one, so no document is ever held; documents without elements and null ones have no value.
    """
    def rows(no: int, df: DataFrame) -> DataFrame:
        fields = [c for c in df.columns if c not in (doc, "ord")]
        return df.filter(F.col(doc).isNotNull()).select(F.col(doc).alias("__doc"), F.to_json(F.struct(F.col(doc).alias(doc))).alias("head"), F.lit(no).alias("no"),
                                                        F.col("ord").cast("long").alias("ord"), F.to_json(F.struct(*fields)).alias("element"))

    names = list(families)
    every = reduce(DataFrame.unionByName, [rows(i, df) for i, df in enumerate(families.values())])
    kind = dict(every.dtypes)["__doc"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_now, family, n, held = None, -1, 0, None
        out: list[tuple] = []

        def put(line: str) -> None:
            nonlocal n
            n += 1
            out.append((doc_now, n, line))

        def open_until(no: int) -> None:
            nonlocal family
            while family < no:
                family += 1
                put(f'],"{names[family]}":[' if family else f'{head},"{names[0]}":[')

        def close() -> None:
            nonlocal held
            if held is not None:
                put(held)
                held = None
                open_until(len(names) - 1)
                put("]}")

        for b in batches:
            for key, first, no, element in zip(*(b.column(c).to_pylist() for c in ("__doc", "head", "no", "element")), strict=True):
                if held is None or key != doc_now:
                    close()
                    doc_now, family, n, head = key, -1, 0, first[:-1]
                else:
                    put(held + ("," if no == family else ""))
                open_until(no)
                held = element
            yield _rows(out, b.schema.field("__doc").type)
            out.clear()
        close()
        if out:
            yield _rows(out, b.schema.field("__doc").type)

    by_doc = every.repartition("__doc").sortWithinPartitions("__doc", "no", "ord", "element")
    return by_doc.mapInArrow(write, f"__doc {kind}, n long, line string").withColumnRenamed("__doc", doc)


def _rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["__doc", "n", "line"])


def write_full_json(families: dict[str, DataFrame], path: str, doc: str = "doc_id") -> None:
    """Text files of whole documents, each element on a line of its own; a document never spans files."""
    json_lines(families, doc).select("line").write.mode("overwrite").text(path)


def filename_part(c: Column, default: str = "ИИ") -> Column:
    text = T.strip(F.coalesce(F.nullif(c, F.lit("")), F.lit(default)))
    safe = F.translate(text, '<>:"/\\|?*\n\r\t', "_" * 12)
    return F.coalesce(F.nullif(F.left(T.squeeze(safe), F.lit(120)), F.lit("")), F.lit(default))


def notice_file_name(notice_id: Column, number: Column) -> Column:
    """`ИИ_<notice>_<number>.pdf`."""
    return F.concat(F.lit("ИИ_"), filename_part(notice_id), F.lit("_"), filename_part(number), F.lit(".pdf"))


def write_notices(lines: DataFrame, path: str, name: str = "file_name") -> None:
    """Notice lines, sorted within files; readers group by the name column."""
    lines.repartitionByRange(name, "line_no").sortWithinPartitions(name, "line_no").write.mode("overwrite").parquet(path)
