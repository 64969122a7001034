"""Small column helpers shared by the operators of this package."""

from __future__ import annotations

import functools
import string
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The six characters of ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null id inside joins and groups; it orders before every other id.
NO_ID = -(2**63)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def key_of(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def id_of(key: str) -> Column:
    """The id again, null where ``key_of`` met a null."""
    return F.when(F.col(key) != NO_ID, F.col(key))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is.

    ``lower`` does just that where each character takes one byte, and is much faster than ``translate``.
    """
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def fresh(df: DataFrame, *names: str) -> dict[str, str]:
    """Column names for the given roles that clash with no column of ``df`` (names differ in more than case)."""
    taken = {name.lower() for name in df.columns}
    out = {}
    for name in names:
        wanted = f"__{name}"
        while wanted.lower() in taken:
            wanted += "_"
        out[name] = wanted
        taken.add(wanted.lower())
    return out


def plain_names(operator):
    """For operators on a table: columns whose names hold dots or backticks go through under other names."""

    @functools.wraps(operator)
    def run(documents: DataFrame, *args, **kwargs) -> DataFrame:
        odd = [c for c in documents.columns if set(c) & set(".`")]
        if not odd:
            return operator(documents, *args, **kwargs)
        inner = fresh(documents, *[f"odd{i}" for i in range(len(odd))])
        there = dict(zip(odd, inner.values(), strict=True))
        back = {v: k for k, v in there.items()}
        out = operator(documents.toDF(*[there.get(c, c) for c in documents.columns]), *args, **kwargs)
        return out.toDF(*[back.get(c, c) for c in out.columns])

    return run


def add_columns(
    documents: DataFrame, fields: list[T.StructField], run: Callable[[Iterator[pa.RecordBatch], list[str]], Iterator[list[pa.Array]]]
) -> DataFrame:
    """``documents`` with what ``run`` computes from its batches; columns named as one of ``fields`` are replaced.

    ``run`` gets the batches and the lower-cased names of their columns, and yields lists of arrays: the columns of some rows
    and then the new ones. Inside, columns go by place, so that names with dots, which ``mapInArrow`` can't resolve, are kept.
    """
    added = {field.name.lower() for field in fields}
    kept = [c for c in documents.columns if c.lower() not in added]
    lowered = [c.lower() for c in kept]
    rows = documents.select(*[F.col(f"`{c.replace('`', '``')}`") for c in kept])
    inner = [T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate([*rows.schema.fields, *fields])]
    names = [f.name for f in inner]

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in run(batches, lowered):
            yield pa.RecordBatch.from_arrays(columns, names=names)

    mapped = rows.toDF(*names[: len(kept)]).mapInArrow(batches_of, T.StructType(inner))
    return mapped.toDF(*kept, *[field.name for field in fields])
