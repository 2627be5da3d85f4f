"""Tables in buckets by a key: joins and aggregates on the key move no rows of them, and a look-up of some keys reads
the buckets of these keys only.

A bucket is read by one task, so a key that holds much of a table would make one task's work of it. ``bucketed`` counts
rows by bucket first, and where one is too large it stores the table without buckets: then Spark shuffles it and splits
what is skewed, with the same rows. A null key is a key like others here; an empty table is stored as it is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialize, shared_dir

#: The largest bucket, as a multiple of a mean bucket, and the rows that any bucket may have.
MOST, ALWAYS = 4, 100_000


def is_even(rows: DataFrame, key: str, buckets: int, most: float = MOST, always: int = ALWAYS) -> bool:
    """Whether no bucket is much larger than the rest. Runs a job: counts by bucket, combined before they are moved."""
    sizes = rows.groupBy(F.pmod(F.hash(key), F.lit(buckets)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    total, largest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    return largest <= max(always, most * total / buckets)


def bucketed(rows: DataFrame, key: str, label: str, buckets: int | None = None, most: float = MOST, always: int = ALWAYS) -> DataFrame:
    """``rows``, stored in ``buckets`` files by a hash of ``key``, sorted by it; the session's number of shuffle partitions
    where none is given, and no fewer, since Spark shuffles a side with less. Runs jobs: ``rows`` are counted, which reads
    their key alone, and stored; rows that are dear to compute, or differ from run to run, are to be stored before.

    Files are in the shared folder. The table is known by its name in the session's catalog; with a catalog of one
    session the next one stores it anew.
    """
    spark = rows.sparkSession
    n = max(buckets or 0, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if not is_even(rows, key, n, most, always):
        return materialize(rows, label)
    name = f"{label}_{uuid.uuid4().hex}"
    # the hash is that of buckets, so a task writes one file, a whole bucket
    rows.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def of_keys(table: DataFrame, key: str, keys: list) -> DataFrame:
    """Rows of some keys, few enough to be named: of a table in buckets by ``key`` only their buckets are read, of others
    the parts of files that may hold them. Nulls among ``keys`` find nothing."""
    return table.where(F.col(key).isin([k for k in keys if k is not None]))
