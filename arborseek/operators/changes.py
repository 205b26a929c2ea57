"""Processing only new or changed records: a ledger of processed (key, version) pairs and the diff against it.

A run rereads the source from the oldest transaction that was open when the last successful run read
(:func:`reread_from`), because such a transaction may commit rows stamped earlier than others already seen, and
removes the overlap by an anti-join of (key, version) pairs with the ledger (:func:`unprocessed`). What is left is
written once, so that what is processed and what is recorded are the same rows (:func:`run_once`). The ledger is
appended to only by a commit marker that is written last and never replaced (:class:`Ledger`): a run that fails
leaves nothing that the next one would take for done, a run that is repeated after its commit does nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborseek.session import written


COMPACT = 64  # runs whose pairs lie in folders of their own at most


def clean_path(path: Column | str) -> Column:
    """A relative path with single forward slashes and without dot segments.

    ``..`` takes back the segment before it, and is dropped at the start. A null path stays null, an empty
    one or one of separators and dots only becomes empty.
    """
    col = F.col(path) if isinstance(path, str) else path
    tidy = F.regexp_replace(F.translate(col, "\\", "/"), "/+", "/")
    parts = F.split(tidy, "/")
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, part: F.when(part.isin("", "."), done)
        .when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(part))),
    )
    # most paths are tidy already, so that the fold over segments runs for few
    odd = tidy.rlike(r"(^|/)\.{1,2}(/|$)|^/|/$")
    return F.when(odd, F.array_join(folded, "/")).otherwise(tidy)


def committed(runs: DataFrame) -> DataFrame:
    """Ids of the runs that committed; a run that finished without committing isn't one."""
    return runs.where(F.col("status") == "committed").select("run_id").distinct()


def reread_from(runs: DataFrame) -> datetime | None:
    """The start of the oldest run that was open when the last committed run started; None if nothing committed.

    A run is open at a moment if it started before it and had not finished, or never did. Rows stamped before
    the returned moment were complete at the last run and need no rereading, provided that stamps never move
    backwards; where they may, as with file times, reread everything (``since=None``).
    """
    last = runs.where(F.col("status") == "committed").agg(F.max(F.struct("run_id", "started_at")).alias("last"))
    row = last.select("last.*").first()
    if row is None or row["started_at"] is None:
        return None
    moment = F.lit(row["started_at"])
    still_open = F.col("finished_at").isNull() | (F.col("finished_at") >= moment)
    oldest = runs.where((F.col("started_at") <= moment) & still_open).agg(F.min("started_at")).first()
    return oldest[0]


def recorded_state(log: DataFrame, runs: DataFrame, key: Column) -> DataFrame:
    """``(key, version)`` of every file that the log's committed runs leave recorded.

    The state of a file is its entry with the largest run_id; after ``drop`` it isn't recorded. Entries of
    runs that didn't commit, or without run, tree or path, count for nothing. Were one committed run to hold
    several entries of a file, the last in the order (op, mtime) counts, ``put`` after ``drop``.
    """
    done = log.join(committed(runs), "run_id", "left_semi")
    entry = F.struct("run_id", F.when(F.col("op") == "put", 1).otherwise(0).alias("put"), F.col("mtime").alias("version"))
    last = done.select(key.alias("key"), entry.alias("entry")).where("key is not null").groupBy("key").agg(F.max("entry").alias("entry"))
    return last.where("entry.put = 1").select("key", "entry.version")


def unprocessed(source: DataFrame, ledger: DataFrame, since: datetime | None = None, stamp: str = "version", single: bool = False) -> DataFrame:
    """Rows of ``source(key, version, ...)`` whose (key, version) pair the ledger lacks; null versions are a version.

    ``since`` bounds what is reread by the column ``stamp``, the moment a row was written, which must never move
    backwards; rows without a stamp are always reread. Without ``since`` everything is.

    With ``single`` both sides hold one row a key: the pairs are then compared within a join by key alone, which uses
    the partitioning that an aggregation by key left behind.
    """
    fresh = source if since is None else source.where((F.col(stamp) >= F.lit(since)) | F.col(stamp).isNull())
    seen = ledger.select(F.col("key").alias("__key"), F.col("version").alias("__version"))
    version, known = F.col("version"), F.col("__version")
    # an equality would be taken for a key of the join, which would shuffle both sides by it anew
    agree = (version.isNull() & known.isNull()) | ((version <= known) & (version >= known)) if single else version.eqNullSafe(known)
    return fresh.join(seen, (F.col("key") == F.col("__key")) & agree, "left_anti")


def changes(source: DataFrame, recorded: DataFrame) -> DataFrame:
    """``(key, change_kind)``: ``added``, ``modified`` or ``removed``, once for each key that differs.

    ``source`` has ``(key, version)`` with any number of rows a key, of which the greatest version counts;
    ``recorded`` has one row a key. The pairs of the source that the record lacks and those of the record that the
    source lacks come from :func:`unprocessed`, asked in both directions: a key on both sides was modified, one on
    the first only added, one on the second only removed. All three joins are by key and share one shuffle of each
    side. Rows without a key are left out.
    """
    now = source.where("key is not null").groupBy("key").agg(F.max("version").alias("version"))
    then = recorded.select("key", "version").where("key is not null")
    fresh = unprocessed(now, then, single=True).select("key", F.lit(True).alias("__fresh"))
    stale = unprocessed(then, now, single=True).select("key", F.lit(True).alias("__stale"))
    both = fresh.join(stale, "key", "full_outer")
    kind = F.when(F.col("__stale").isNull(), "added").when(F.col("__fresh").isNull(), "removed").otherwise("modified")
    return both.select("key", kind.alias("change_kind"))


def document_changes(chunks: DataFrame, manifest: DataFrame, runs: DataFrame) -> DataFrame:
    """``(doc_id, change_kind)`` of the documents in ``chunks`` against the committed state of ``manifest``.

    Versions are compared in whole seconds, and differ in either direction: a file restored with an older time
    is modified too. That is why the source is read whole here and :func:`reread_from` bounds nothing.
    """
    source = chunks.select(F.col("doc_id").alias("key"), F.date_trunc("second", "mtime").alias("version"))
    key = F.concat(F.col("tree"), F.lit(":"), clean_path("path"))
    log = manifest.withColumn("mtime", F.date_trunc("second", "mtime"))
    recorded = recorded_state(log, runs, key)
    return changes(source, recorded).select(F.col("key").alias("doc_id"), "change_kind")


class Ledger:
    """Processed (key, version) pairs in a folder all executors share.

    Every run writes its pairs to ``pairs/<token>`` and then one small marker ``runs/<run_id>.json``, which names that
    folder; only pairs with a marker count. A marker is written whole under another name and renamed, and is final:
    nothing deletes or replaces it. A crash before the rename leaves pairs that nobody reads, and the rerun finds the
    same records unprocessed; after it the run is committed, and committing it again does nothing. One run at a time
    commits. :meth:`compact` brings the pairs of all runs into one folder; ``run_once`` does so every COMPACT runs.

    Transactions of the source that are open are told by :meth:`begin` and :meth:`end`; a run records the start of
    the oldest of them, and :meth:`since` gives it to the next run.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- small files

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.folder}/{folder}")
        if not self._fs.exists(at):
            return []
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at) if x.getPath().getName().endswith(".json"))

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.folder}/{name}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, name: str, value: dict) -> None:
        draft, final = self._path(f"{self.folder}/draft/{uuid.uuid4().hex}"), self._path(f"{self.folder}/{name}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        self._fs.mkdirs(final.getParent())
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise OSError(f"could not put {name}")

    def _marks(self) -> list[dict]:
        """Markers in force, in the order of their commits; those a compaction took in are left out unread."""
        names = self._names("runs")
        known = {n: self._read(f"runs/{n}") | {"name": n} for n in names if n.startswith("compaction-")}
        gone = {n for m in known.values() for n in m["replaces"]}
        found = [known.get(n) or self._read(f"runs/{n}") | {"name": n} for n in names if n not in gone]
        return sorted(found, key=lambda m: m["place"])

    @staticmethod
    def _name(run_id: int | str) -> str:
        return f"{run_id:020d}.json" if isinstance(run_id, int) else f"{run_id}.json"

    # --- transactions of the source

    def begin(self, transaction: str, started: datetime) -> None:
        self._put(f"open/{transaction}.json", {"started": started.isoformat()})

    def end(self, transaction: str) -> None:
        self._fs.delete(self._path(f"{self.folder}/open/{transaction}.json"), False)

    def open_from(self, now: datetime) -> datetime:
        """The start of the oldest open transaction, or ``now`` if none is open."""
        return min([now, *(datetime.fromisoformat(self._read(f"open/{n}")["started"]) for n in self._names("open"))])

    # --- runs

    def has(self, run_id: int | str) -> bool:
        """Whether the run committed."""
        return self._fs.exists(self._path(f"{self.folder}/runs/{self._name(run_id)}"))

    def pairs(self, key: str = "string", version: str = "timestamp") -> DataFrame:
        """All (key, version) pairs of committed runs."""
        folders = [m["pairs"] for m in self._marks()]
        schema = f"key {key}, version {version}"
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def since(self) -> datetime | None:
        """Where the next run starts to reread: the bound the last committed run recorded."""
        marks = self._marks()
        last = marks[-1]["open_from"] if marks else None
        return None if last is None else datetime.fromisoformat(last)

    def commit(self, run_id: int | str, processed: DataFrame, open_from: datetime | None) -> None:
        """Record the pairs of ``processed(key, version, ...)`` as done by ``run_id``; a committed run stays as it is.

        ``open_from`` is the start of the oldest transaction still open when this run read its source. ``processed``
        should be a written table, or what is recorded may be more than what was processed.
        """
        if self.has(run_id):
            return
        target = f"{self.folder}/pairs/{uuid.uuid4().hex}"
        processed.select("key", "version").distinct().write.parquet(target)
        self._mark(self._name(run_id), target, open_from.isoformat() if open_from else None)

    def _mark(self, name: str, pairs: str, open_from: str | None, replaces: tuple[str, ...] = ()) -> None:
        places = [m["place"] for m in self._marks()]
        self._put(f"runs/{name}", {"place": max(places, default=0) + 1, "pairs": pairs, "open_from": open_from, "replaces": list(replaces)})

    def compact(self) -> None:
        """Bring the pairs of all runs into one folder; markers of the runs stay, so that they still count as committed."""
        marks = self._marks()
        if len(marks) > 1:
            target = f"{self.folder}/pairs/{uuid.uuid4().hex}"
            self.pairs().distinct().write.parquet(target)
            self._mark(f"compaction-{uuid.uuid4().hex}.json", target, marks[-1]["open_from"], tuple(m["name"] for m in marks))


def run_once(source: DataFrame, ledger: Ledger, run_id: int | str, process: Callable[[DataFrame, int | str], None], now: datetime, stamp: str | None = None) -> bool:
    """One run over ``source(key, version, ...)``: process what the ledger lacks, then record it. False if it had committed before.

    ``now`` is a moment before the source was read. Where ``stamp`` names a column that tells when a row was written,
    in times that only grow, just the rows from the ledger's bound on are reread; without it all are, since versions
    such as file times may lie before any bound. The bound for the next run is taken before the source is read.

    A run that dies before its marker is repeated whole under its id: ``process`` must replace by ``run_id``, not append.
    """
    if ledger.has(run_id):
        return False
    open_from = ledger.open_from(now)
    if len(ledger._marks()) > COMPACT:
        ledger.compact()
    new = written(unprocessed(source, ledger.pairs(), ledger.since() if stamp else None, stamp or "version"), "run")
    process(new, run_id)
    ledger.commit(run_id, new, open_from)
    return True
