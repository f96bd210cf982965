"""Rows on their way through tasks: columns that are kept as they are, one text, and results under names that nothing else has."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def fresh(columns: Iterable[str], *stems: str) -> list[str]:
    """A name for each stem, ``__stem``, with as many more underscores as keep it apart from the columns' names."""
    taken = {c.lower() for c in columns}
    out = []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def named(*names: str) -> list[Column]:
    """The columns of these names, which may hold dots or backticks."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def batch_of(columns: list[pa.Array]) -> pa.RecordBatch:
    """The columns by place; Spark has their names."""
    return pa.RecordBatch.from_arrays(columns, [f"c{k}" for k in range(len(columns))])


class Texts:
    """The ``keep`` columns of ``docs`` with the text of ``column``, which is sent once even if it is kept too.

    On their way the kept columns are called c0, c1, ...: a task's rows may not have dots in their names, nor a name twice.
    """

    def __init__(self, docs: DataFrame, keep: list[str], column: str) -> None:
        self.names, self.keep = keep, len(keep)
        self.fields = docs.select(*named(*keep)).schema.fields
        self.at = next((k for k, f in enumerate(self.fields) if f.name == column and isinstance(f.dataType, StringType)), self.keep)
        extra = [] if self.at < self.keep else [named(column)[0].cast("string").alias(f"c{self.keep}")]
        self.rows = docs.select(*(c.alias(f"c{k}") for k, c in enumerate(named(*keep))), *extra)

    def __getstate__(self) -> dict:
        return {"keep": self.keep, "at": self.at}  # what tasks use

    def text(self, batch: pa.RecordBatch) -> pa.Array:
        return batch.column(self.at)

    def kept(self, batch: pa.RecordBatch, a: int, b: int) -> list[pa.Array]:
        return [batch.column(k).slice(a, b - a) for k in range(self.keep)]

    def schema(self, new: str, with_text: bool = False) -> StructType:
        """The kept columns' schema and the new ones, as DDL; ``with_text``: also the text's, if it is apart."""
        kept = [StructField(f"c{k}", f.dataType) for k, f in enumerate(self.fields)]
        text = [StructField(f"c{self.keep}", StringType())] if with_text and self.at == self.keep else []
        return StructType([*kept, *text, *StructType.fromDDL(new).fields])

    def restored(self, rows: DataFrame, *new: Column) -> DataFrame:
        """The kept columns under their names, and further ones."""
        return rows.select(*(F.col(f"c{k}").alias(n) for k, n in enumerate(self.names)), *new)
