"""Version logs, and a cleaning session with numbered versions, history and undo."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rinseframe.operators.joins import join_two
from rinseframe.plans.lineage import cut_lineage

HISTORY_LENGTH = 5


def latest_version(log: DataFrame) -> DataFrame:
    """The last version of every dataset in a (data_id, version, description) log."""
    return log.groupBy("data_id").agg(F.max("version").alias("version"))


def next_version(log: DataFrame, datasets: DataFrame | None = None) -> DataFrame:
    """Last version plus one; 1 for datasets without any version."""
    following = log.groupBy("data_id").agg((F.max("version") + 1).alias("version"))
    if datasets is None:
        return following
    known = datasets.select("data_id").distinct()
    return known.join(following, "data_id", "left").select("data_id", F.coalesce("version", F.lit(1)).alias("version"))


def history(log: DataFrame, length: int = HISTORY_LENGTH) -> DataFrame:
    """The newest descriptions of every dataset, newest first (position 1)."""
    newest = Window.partitionBy("data_id").orderBy(F.desc("version"))
    return (
        log.withColumn("position", F.row_number().over(newest))
        .where(F.col("position") <= length)
        .select("data_id", "position", "version", "description")
    )


def undo(log: DataFrame) -> DataFrame:
    """The log without the newest version of each dataset that has more than one."""
    ends = log.groupBy("data_id").agg(F.max("version").alias("_last"), F.count(F.lit(1)).alias("_n"))
    return (
        log.join(ends, "data_id")
        .where((F.col("version") < F.col("_last")) | (F.col("_n") == 1))
        .select(*log.columns)
    )


def drop_snapshot(log: DataFrame, dropped: DataFrame) -> DataFrame:
    """The log without the (data_id, version) rows listed."""
    return log.join(dropped.select("data_id", "version").distinct(), ["data_id", "version"], "left_anti")


def in_order(log: DataFrame) -> DataFrame:
    """The log by dataset, then by version."""
    return log.orderBy("data_id", "version")


LOG = "at long, action string, snapshot string, version int, description string, tables array<struct<name:string,path:string>>"


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _exists(spark: SparkSession, path: str) -> bool:
    files, place = _file_system(spark, path)
    return files.exists(place)


def stored_tables(spark: SparkSession, folder: str) -> dict[str, int]:
    """Paths of all tables below a folder of saved sessions, as the log writes them, with their time in milliseconds."""
    files, place = _file_system(spark, f"{folder}/tables")
    found = {}
    for snapshot in files.listStatus(place) if files.exists(place) else []:
        for table in files.listStatus(snapshot.getPath()):
            name = f"{folder}/tables/{snapshot.getPath().getName()}/{table.getPath().getName()}"
            found[name] = table.getModificationTime()
    return found


def collect_snapshots(spark: SparkSession, folder: str, retention: float) -> list[str]:
    """Remove the tables that no version left in the log points to, and return their paths.

    Tables written, or let go by the last version that had them, within ``retention`` seconds
    stay: a save writes its tables before its log row, so the time must be longer than a save
    takes, and longer than sessions that may still read what others drop. Files are listed
    before the log is read, so a save that ends in between is seen.
    """
    there = stored_tables(spark, folder)
    log = spark.read.parquet(f"{folder}/log").collect()  # a row for each save and undo
    dropped = {row["snapshot"]: row["at"] for row in log if row["action"] == "drop"}
    live, let_go = set(), {}
    for row in log:
        for table in row["tables"] if row["action"] == "save" else []:
            if row["snapshot"] in dropped:
                let_go[table["path"]] = max(let_go.get(table["path"], 0), dropped[row["snapshot"]])
            else:
                live.add(table["path"])
    before = time.time_ns() - int(retention * 1e9)
    gone = [p for p, at in there.items() if p not in live and at * 10**6 <= before and let_go.get(p, 0) <= before]
    for path in gone:
        files, place = _file_system(spark, path)
        files.delete(place, True)
        if not files.listStatus(place.getParent()):
            files.delete(place.getParent(), False)
    return sorted(gone)


@dataclass
class Version:
    number: int
    description: str
    tables: dict[str, DataFrame]
    #: folder -> (snapshot id, paths of the tables), for every folder it was saved in
    saved: dict[str, tuple[str, dict[str, str]]] = field(default_factory=dict)


class Session:
    """Tables of one dataset under cleaning.

    Every step makes a new version holding all tables; tables stay lazy until they
    are written. ``save`` writes the newest version's new tables under fresh paths and
    appends a row to the folder's log; tables that a saved version already holds are
    pointed to. Undoing a saved version, or dropping one, is a log row as well, so
    nothing is overwritten and a lost run leaves earlier versions whole.
    """

    def __init__(self, tables: dict[str, DataFrame], description: str):
        self._versions = [Version(1, description, dict(tables))]

    @property
    def version(self) -> int:
        return self._versions[-1].number

    @property
    def tables(self) -> dict[str, DataFrame]:
        return dict(self._versions[-1].tables)

    def table(self, name: str | None = None) -> DataFrame:
        tables = self._versions[-1].tables
        return tables[name] if name is not None else tables[next(iter(tables))]

    def _add(self, description: str, tables: dict[str, DataFrame]) -> Session:
        self._versions.append(Version(self.version + 1, description, tables))
        return self

    def step(
        self, operator: Callable[..., DataFrame], *args, describe: str, table: str | None = None, **kwargs
    ) -> Session:
        """Apply an operator to one table (the first by default)."""
        tables = self.tables
        name = table if table is not None else next(iter(tables))
        tables[name] = operator(tables[name], *args, **kwargs)
        return self._add(describe, tables)

    def join(self, left: str, right: str, left_columns: list[str], right_columns: list[str], name: str) -> Session:
        on = ",".join(f"{a}={b}" for a, b in zip(left_columns, right_columns))
        joined = join_two(self.tables, left, right, left_columns, right_columns, name)
        return self._add(f"JOIN TABLES {left} AND {right} ON {on}", joined)

    def rename(self, old: str, new: str) -> Session:
        tables = {new if n == old else n: df for n, df in self.tables.items()}
        return self._add(f"RENAME {old} TO {new}", tables)

    def undo(self) -> Session:
        """Go back one version; where the undone one was saved, the folder's log says so."""
        if len(self._versions) > 1:
            undone = self._versions.pop()
            for folder, (snapshot, _) in undone.saved.items():
                self._note(folder, "drop", snapshot, undone, [])
        return self

    def history(self, length: int = HISTORY_LENGTH) -> list[str]:
        return [v.description for v in self._versions[::-1][:length]]

    def settle(self) -> Session:
        """Compute what the newest version changed once, so that later steps start from its rows."""
        newest = self._versions[-1]
        before = [df for v in self._versions[:-1] for df in v.tables.values()]
        for name, df in newest.tables.items():
            if not any(df is old for old in before):
                newest.tables[name] = cut_lineage(df)
        return self

    @staticmethod
    def _note(folder: str, action: str, snapshot: str, version: Version, tables: list[tuple[str, str]]) -> None:
        spark = next(iter(version.tables.values())).sparkSession
        row = [(time.time_ns(), action, snapshot, version.number, version.description, tables)]
        spark.createDataFrame(row, LOG).coalesce(1).write.mode("append").parquet(f"{folder}/log")

    def save(self, folder: str) -> str:
        """Write the newest version's tables that are not yet in the folder, then its log row."""
        newest = self._versions[-1]
        if folder in newest.saved:
            raise ValueError(f"version {newest.number} is already saved in {folder!r}")
        there = [
            (df, v.saved[folder][1][name]) for v in self._versions if folder in v.saved for name, df in v.tables.items()
        ]
        snapshot, paths = uuid.uuid4().hex, {}
        for position, (name, df) in enumerate(newest.tables.items()):
            known = next((path for old, path in there if old is df), None)
            if known is not None and not _exists(df.sparkSession, known):
                raise FileNotFoundError(f"{known!r} was collected; load the session anew")
            paths[name] = known or f"{folder}/tables/{snapshot}/{position}"
            if known is None:
                df.write.mode("errorifexists").parquet(paths[name])
        self._note(folder, "save", snapshot, newest, list(paths.items()))
        newest.saved[folder] = (snapshot, paths)
        return snapshot

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Session:
        """The saved versions, oldest first, without those undone or dropped."""
        log = spark.read.parquet(f"{folder}/log").orderBy("at").collect()  # a row for each save and undo
        dropped = {row["snapshot"] for row in log if row["action"] == "drop"}
        session, frames = cls.__new__(cls), {}
        session._versions = []
        for row in log:
            if row["action"] != "save" or row["snapshot"] in dropped:
                continue
            paths = {t["name"]: t["path"] for t in row["tables"]}
            for path in paths.values():
                if path not in frames:
                    frames[path] = spark.read.parquet(path)
            tables = {name: frames[path] for name, path in paths.items()}
            session._versions.append(Version(row["version"], row["description"], tables, {folder: (row["snapshot"], paths)}))
        if not session._versions:
            raise ValueError(f"no version is left in {folder!r}")
        return session

    def drop(self, number: int) -> Session:
        """Take out one version that is not the only one, here and in the folders it was saved in."""
        chosen = [v for v in self._versions if v.number == number]
        if not chosen or len(self._versions) == 1:
            raise ValueError(f"version {number} cannot be dropped")
        self._versions.remove(chosen[0])
        for folder, (snapshot, _) in chosen[0].saved.items():
            self._note(folder, "drop", snapshot, chosen[0], [])
        return self
