"""Helpers shared by the corpus operators: stored tables, text columns as bytes, joins around hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word pattern ``[^\x20\x09-\x0D]+`` (fixed value).
BLANKS = " \t\n\x0b\x0c\r"
#: A key holding more than one part in this many of all rows is joined by broadcast, so such keys
#: can never be more than this many.
HOT_PARTS = 2000

#: Rows of an Arrow batch that are worked on together.
PIECE_ROWS = 1024

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs in one
    process, as in tests. On a cluster the setting is needed."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        master, application = spark.sparkContext.master, spark.sparkContext.applicationId
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        if application not in _own_folders:
            _own_folders[application] = tempfile.mkdtemp(prefix="spark-")
        base = _own_folders[application]
    return f"{base.rstrip('/')}/corpus-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cut lineage that outlives any executor."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(
    df: DataFrame, columns: Sequence[str], run: Callable[[pa.RecordBatch], dict[str, pa.Array]], schema: str
) -> DataFrame:
    """``run`` over pieces of Arrow batches of the given columns; it returns the output columns by name.

    Pieces are short, so that few texts are Python objects at a time.
    """
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE_ROWS):
                yield pa.RecordBatch.from_pydict(run(batch.slice(at, PIECE_ROWS)))

    return df.select(*columns).mapInArrow(over, schema)


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null counts as 0."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(bare) > 0, F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).otherwise(0).cast("long")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them where ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        found.append(name)
    return found


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of the named columns."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def attach(rows: DataFrame, facts: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Inner join of one row of ``facts`` a key onto many ``rows`` a key.

    ``weight`` names the number of rows the key has. Keys above one part in ``HOT_PARTS`` of the
    sum of weights, of which there are fewer than that, are joined by broadcast, all others by a shuffle;
    so no task gets a hot key. Both tables are read twice: pass stored ones. Keys must not be null.
    """
    total = facts.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * F.lit(HOT_PARTS) > F.lit(total)
    hot, cold = facts.where(is_hot).drop(weight), facts.where(~is_hot).drop(weight)
    keys = list(keys)
    few = F.broadcast(hot)
    return rows.join(few, keys).unionByName(
        rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    )
