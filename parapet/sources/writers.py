"""Writers. Only what passed screening is forwarded, only names are recorded."""

import uuid

from pyspark.sql import functions as F

from parapet import schemas, settings as S
from parapet.operators import ledger
from parapet.sources import known, readers, snapshots


def append_ledger(df, path, run=None):
    """Add ledger rows as a run; writing the same run again replaces it, one that was compacted stays as it is.

    The run's folder, its keys and their filters are written first; one commit makes it visible.
    """
    spark, folder = df.sparkSession, snapshots.Folder(df.sparkSession, path)
    name = run or f"write~{uuid.uuid4().hex}"
    if snapshots.is_covered(snapshots.load(folder)[1], name):
        return
    snapshots.commit(folder, snapshots.with_run(_written(spark, df, path, name)))


def compact_ledger(spark, path, keep=S.LEDGER_KEEP):
    """Retention: the newest `keep` rows (None: all) as one run in place of the runs that they come from.

    Runs that are added meanwhile stay; if one is replaced meanwhile, it is done again. The
    old folders stay for their readers until `vacuum_ledger`.
    """
    folder = snapshots.Folder(spark, path)
    while True:
        base = snapshots.load(folder)[1]["runs"]
        if not base:
            return
        rows = readers.read_runs(spark, path, base)
        run = _written(spark, rows if keep is None else ledger.newest(rows, keep), path, f"kept~{uuid.uuid4().hex}")
        try:
            snapshots.commit(folder, snapshots.with_compacted(base, run))
            return
        except snapshots.Conflict:
            continue


def vacuum_ledger(spark, path, older_than_seconds=7 * 24 * 3600):
    """Delete what no reader of a list that young can need: replaced and compacted runs, and writes that were never committed."""
    snapshots.vacuum(snapshots.Folder(spark, path), older_than_seconds)


def _written(spark, df, path, name):
    place = f"run={name}~{uuid.uuid4().hex}"
    df.select([f.name for f in schemas.LEDGER.fields]).write.parquet(f"{path}/{place}")
    rows = spark.read.schema(schemas.LEDGER).parquet(f"{path}/{place}")
    slices = known.write_keys(spark, rows, f"{path}/_keys/{place}", f"{path}/_filters/{place}")
    return {"name": name, "folder": place, "slices": slices}


def allowed_only(items, verdicts, keys):
    """Items of the requests that passed; a request without a verdict did not."""
    # An inner join of distinct keys: a semi join would be pushed into each input of a union of
    # items, with a copy of all screening.
    passed = verdicts.where(F.col("verdict") == S.ALLOWED).select(*keys).distinct()
    return items.join(passed, keys).select(items.columns)


def write_forwarded(df, path, keys, payload="payload", run=None):
    """Write the rebuilt payloads of rows whose verdict is allowed, as JSON lines, in a run folder; a repeated run replaces its own."""
    passed = df.where(F.col("verdict") == S.ALLOWED).select(*keys, payload)
    passed.write.mode("overwrite").json(f"{path}/run={run or uuid.uuid4().hex}")
