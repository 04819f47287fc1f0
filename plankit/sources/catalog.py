"""A catalog of stored data sets and their secondary indexes, over Parquet files that are never changed.

A data set is a list of folders of Parquet files, written down in a numbered state file; the state of
the highest number is the data set. A change writes folders of its own and then publishes the next
state by a rename that fails if that number exists: readers see the old state or the new one, a change
that fails leaves the old one, and of two changes at a time one raises. An insert adds a folder. A
delete or an update writes anew only the folders that hold one of its keys. Folders that no state
names any more stay for those who still read them, until vacuum().

An index is stored in the same way: rows of (secondary key, primary key), range-partitioned and
sorted by the secondary key, so that row-group statistics prune a search. Data and indexes are
published one after another, the data first.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plankit.operators.relation import Relation
from plankit.sources.shared import drop_path, file_system


class Stored:
    """Rows as a list of folders, with numbered states."""

    def __init__(self, spark: SparkSession, path: str, partition_by: list[str] = (), given: str | None = None):
        self.spark, self.path, self.partition_by = spark, path, list(partition_by)
        #: A folder of Parquet files that is the content before any state was published.
        self.given = given

    # states

    def number(self) -> int:
        """The number of the current state; 0 if none was published."""
        files, folder = file_system(self.spark, f"{self.path}/state")
        return max((int(s.getPath().getName()) for s in files.listStatus(folder) if s.getPath().getName().isdigit()), default=0) if files.exists(folder) else 0

    def folders(self, number: int | None = None) -> list[str]:
        number = self.number() if number is None else number
        if not number:
            return [self.given] if self.given else []
        content = self.spark.read.text(f"{self.path}/state/{number:010d}", wholetext=True).first()[0]
        return json.loads(content)

    def publish(self, number: int, folders: list[str]) -> None:
        """Make folders the state of that number. Raises, and changes nothing, if there is one already."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        target = f"{self.path}/state/{number:010d}"
        draft = f"{self.path}/state/_{uuid.uuid4().hex}"
        files, to = file_system(self.spark, draft)
        stream = files.create(to, False)
        stream.write(bytearray(json.dumps(folders).encode()))
        stream.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        kinds = gateway.new_array(rename, 1)
        kinds[0] = getattr(rename, "NONE")
        try:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri() if to.toUri().getScheme() else files.getUri(), self.spark._jsc.hadoopConfiguration())
            context.rename(to, jvm.org.apache.hadoop.fs.Path(target), kinds)
        except Exception:
            files.delete(to, False)
            raise

    # rows

    def read(self, folders: list[str] | None = None) -> DataFrame:
        found = self.folders() if folders is None else folders
        if not found:
            raise FileNotFoundError(f"nothing is stored in {self.path}")
        if not self.partition_by:
            return self.spark.read.parquet(*found)
        return reduce(lambda a, b: a.unionByName(b), [self.spark.read.parquet(f) for f in found])

    def _written(self, rows: DataFrame) -> str:
        folder = f"{self.path}/rows-{uuid.uuid4().hex}"
        rows.write.partitionBy(*self.partition_by).parquet(folder)
        return folder

    def change(self, remove: DataFrame | None = None, on: list[str] = (), add: DataFrame | None = None, replace: bool = False) -> None:
        """Publish a state without the rows that agree with one of remove on some columns, and with the rows of add.

        replace: of the rows before, none stays.
        """
        number = self.number()
        folders = [] if replace else self.folders(number)
        if remove is not None and folders:
            gone = remove.select(*on).distinct()
            kept = []
            for folder in folders:
                rows = self.read([folder])
                # a folder without such a key stays as it is
                kept.append(self._written(rows.join(gone, on, "left_anti").select(*rows.columns)) if rows.join(gone, on, "left_semi").limit(1).count() else folder)
            folders = kept
        if add is not None:
            folders = [*folders, self._written(add)]
        self.publish(number + 1, folders)

    def vacuum(self) -> None:
        """Remove folders and states but for the current ones. Only when nothing reads older ones."""
        number, kept = self.number(), set(self.folders())
        files, folder = file_system(self.spark, self.path)
        for status in files.listStatus(folder):
            name = status.getPath().getName()
            if name.startswith("rows-") and f"{self.path}/{name}" not in kept:
                drop_path(self.spark, f"{self.path}/{name}")
        files, folder = file_system(self.spark, f"{self.path}/state")
        for status in files.listStatus(folder):
            if status.getPath().getName() != f"{number:010d}":
                files.delete(status.getPath(), False)


@dataclass
class DataSet:
    name: str
    stored: Stored
    keys: list[str]
    indexes: dict[str, list[str]] = field(default_factory=dict)  # index name: secondary keys


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.sets: dict[str, DataSet] = {}

    # names

    def declare(self, name: str, keys: list[str], path: str | None = None, partition_by: list[str] = ()) -> DataSet:
        """A data set by its primary keys. path: a folder of Parquet files that holds its rows so far, which stays as it is."""
        made = self.sets[name] = DataSet(name, Stored(self.spark, f"{self.root}/{name}", partition_by, path), list(keys))
        return made

    def find(self, name: str) -> DataSet:
        if name not in self.sets:
            raise KeyError(f"unknown data set {name}")
        return self.sets[name]

    def index(self, name: str, index: str) -> Stored:
        return Stored(self.spark, f"{self.root}/_{self.find(name).name}_{index}")

    def scan(self, name: str) -> Relation:
        """The rows of the current state; what is read later does not change them."""
        return Relation(self.find(name).stored.read())

    def scan_index(self, name: str, index: str) -> Relation:
        return Relation(self.index(name, index).read())

    def search(self, name: str, index: str, condition: Column) -> Relation:
        """Primary keys whose secondary keys satisfy the condition, which reaches the scan of the index."""
        return self.scan_index(name, index).select(condition).project(*self.find(name).keys)

    # changes

    def write_result(self, name: str, relation: Relation) -> None:
        """Load a data set: rows are dealt out by primary key, whatever was there goes."""
        found = self.find(name)
        found.stored.change(add=relation.df.repartition(*found.keys), replace=True)
        for index in found.indexes:
            self.index(name, index).change(add=self._entries(found, index, self.scan(name).df), replace=True)

    def insert(self, name: str, relation: Relation) -> None:
        """Add rows, matched by column name, as they are: keys are not looked for."""
        self._change(self.find(name), None, relation.df)

    def delete(self, name: str, keys: Relation) -> None:
        """Remove the rows whose primary keys the relation has. Null keys equal nothing."""
        self._change(self.find(name), keys.df, None)

    def update(self, name: str, relation: Relation) -> None:
        """Replace rows by those with the same primary keys, and add the others: delete and insert in one state."""
        self._change(self.find(name), relation.df, relation.df)

    def create_index(self, name: str, index: str, secondary: list[str]) -> None:
        found = self.find(name)
        found.indexes[index] = list(secondary)
        self.index(name, index).change(add=self._entries(found, index, self.scan(name).df), replace=True)

    def insert_into_index(self, name: str, index: str, relation: Relation) -> None:
        """Add (secondary key, primary key) rows to an index alone."""
        self.index(name, index).change(add=self._entries(self.find(name), index, relation.df))

    def delete_from_index(self, name: str, index: str, relation: Relation) -> None:
        """Remove the entries that agree in secondary and primary keys from an index alone."""
        found = self.find(name)
        self.index(name, index).change(remove=relation.df, on=[*found.indexes[index], *found.keys])

    def vacuum(self, name: str) -> None:
        """Remove what older states of a data set and its indexes needed. Only when nothing reads them."""
        found = self.find(name)
        for stored in (found.stored, *[self.index(name, i) for i in found.indexes]):
            stored.vacuum()

    def _entries(self, found: DataSet, index: str, rows: DataFrame) -> DataFrame:
        secondary = found.indexes[index]
        columns = [*secondary, *found.keys]
        return rows.select(*columns).repartitionByRange(*secondary).sortWithinPartitions(*columns)

    def _change(self, found: DataSet, remove: DataFrame | None, add: DataFrame | None) -> None:
        columns = found.stored.read().columns
        found.stored.change(remove, found.keys, add.select(*columns) if add is not None else None)
        for index in found.indexes:
            self.index(found.name, index).change(remove, found.keys, self._entries(found, index, add) if add is not None else None)


def deleted(rows: DataFrame, keys: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """The rows that a delete leaves: those without a match among keys. on: (column of rows, column of keys)."""
    condition = F.lit(True)
    for a, b in on:
        condition = condition & (rows[a] == keys[b])
    return rows.join(keys, condition, "left_anti")
