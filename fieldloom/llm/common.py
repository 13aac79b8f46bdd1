"""What the corpus operators share: tables, checkpoints and the column rules that hold for all of them.

Rules for every operator here: a null text counts as empty; columns other than those an operator names are
carried or ignored but never clash, since working columns begin with ``_fl_``; an empty table gives an empty result.
"""

from __future__ import annotations

import ctypes
import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import checkpointed  # noqa: F401  the operators take it from here

#: Upper and lower case letters that texts are folded by: A-Z only, so that "É" and "é" stay different.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: white space between words.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch, so that a worker holds a few MB of texts at a time; Spark's default is 10,000.
ARROW_ROWS, ARROW_CONF = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose session from now on sends Python workers batches of at most ARROW_ROWS rows."""
    conf = df.sparkSession.conf
    if int(conf.get(ARROW_CONF, "10000")) > ARROW_ROWS or int(conf.get(ARROW_CONF, "10000")) <= 0:
        conf.set(ARROW_CONF, str(ARROW_ROWS))
    return df


def folded(text):
    """The text with A-Z in lower case and nothing else changed; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def raw_texts(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; null becomes empty.

    ``bytes.split()`` cuts at exactly \\x20 and \\x09-\\x0D and ``bytes.lower()`` folds exactly A-Z, which is what the
    operators' words need; str.split() and str.lower() would do more.
    """
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: Keys of dropped rows are broadcast up to this many (some 30 MB); beyond, the join is shuffled.
BROADCAST_ROWS = 200_000


def text_key(text):
    """64 bits of a text, null as empty; with the id it tells rows apart where ids repeat."""
    return F.xxhash64(F.coalesce(text, F.lit("")), F.lit(29))


def without(docs: DataFrame, dropped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs without the rows whose id (null-safe) and text_key are among dropped (_fl_drop_id, _fl_drop_key).

    All columns of docs stay. dropped should be checkpointed: it is counted, and broadcast only if it is small.
    """
    dropped = dropped.distinct()
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    same = docs[id_col].eqNullSafe(dropped["_fl_drop_id"]) & (text_key(docs[text_col]) == dropped["_fl_drop_key"])
    return docs.join(dropped, same, "left_anti")


def give_back() -> None:
    """Return a Python worker's free memory to the machine; workers idle between the stages of other operators."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library; it keeps its memory


def lean(run):
    """A function for mapInArrow that gives memory back when its task is over."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


_KEPT: dict = {"name": None, "value": None}


def worker_state(name: str, make):
    """What a Python worker keeps between the tasks of one operator, made when there is none.

    Workers are used again by the stages of other operators; so that tables don't add up, another operator's is dropped
    first and its memory given back.
    """
    if _KEPT["name"] != name:
        _KEPT.update(name=None, value=None)
        gc.collect()
        give_back()
        _KEPT.update(name=name, value=make())
    return _KEPT["value"]
