"""Expressions shared by the corpus operators."""
from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.session import ensure_checkpoint_dir
from quire.sources.tables import read_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and leave every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def text_or_empty(c="text") -> Column:
    return F.coalesce(F.col(c), F.lit("")) if isinstance(c, str) else F.coalesce(c, F.lit(""))


def words_of(text: str | None) -> list[bytes]:
    """The runs of ``[^\\x20\\x09-\\x0D]+`` in a text with A-Z lower-cased, as UTF-8 (null: none).

    bytes.lower() acts on A-Z alone and bytes.split() parts at these six characters alone.
    """
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def blocks(texts: list[str], chars: int):
    """(from, to) runs of texts that hold about ``chars`` characters, whole texts only."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= chars):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def stable(df: DataFrame) -> DataFrame:
    """Written once to the shared checkpoint folder: cuts lineage, survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def fold_of(c: str, n: int) -> Column:
    """crc32 of an id's decimal text, modulo n (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))) % n


def beside(docs: DataFrame, make: Callable, added: str, keep: Sequence[str] = ("doc_id",),
           read: Sequence[str] = ("text",)) -> DataFrame:
    """The ``keep`` columns of each row as they are, and beside them the columns ``added`` (DDL).

    ``make()`` is called once a task; what it returns is called with one list for each ``read`` column
    of a batch and gives a dict of the added columns. Where a row has several results (or none), the dict
    also holds ``_row``, the batch row that each result stands for. Kept columns stay Arrow columns:
    integer ids next to nulls never become doubles.
    """
    keep, read = list(keep), list(read)
    schema = StructType([docs.schema[c] for c in keep] + StructType.fromDDL(added).fields)
    columns = [F.col(f"`{c}`") for c in keep] + [F.col(f"`{c}`").alias(f"_read{i}") for i, c in enumerate(read)]

    def run(batches):
        of, shape = make(), to_arrow_schema(schema)
        for b in batches:
            out = of(*[b.column(len(keep) + i).to_pylist() for i in range(len(read))])
            rows = out.pop("_row", None)
            kept = [b.column(i) if rows is None else b.column(i).take(pa.array(rows, pa.int64())) for i in range(len(keep))]
            kept = [c.cast(f.type) for c, f in zip(kept, shape)]
            new = [v.cast(f.type) if isinstance(v := out[f.name], pa.Array) else pa.array(v, f.type) for f in list(shape)[len(keep):]]
            yield pa.RecordBatch.from_arrays([*kept, *new], schema=shape)

    return docs.select(*columns).mapInArrow(run, schema)


#: Keys that hold more than 1 / HOT_KEYS of all rows are hot: there are fewer than this.
HOT_KEYS = 1000


def spread_join(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join with a table of one row for each key that counts the key's rows in ``n``.

    The few hot keys are broadcast, so their rows stay where they are; no other key can fill a task.
    """
    most, total = table.agg(F.max(n), F.sum(n)).first()
    if not total or most * HOT_KEYS <= total:
        return rows.join(table, key)
    limit = total / HOT_KEYS
    hot = F.broadcast(table.where(F.col(n) > limit))
    cold = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col(n) <= limit), key)
    return rows.join(hot, key).unionByName(cold)
