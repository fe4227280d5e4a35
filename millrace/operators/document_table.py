"""A table of documents' rows that is replaced document by document, in commits that are switched in at once."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators import versions
from millrace.operators.runs import latest


@dataclass(frozen=True)
class DocumentTable:
    """A version of the table: its commits, in order, and the last batch of each stream that it holds."""

    spark: SparkSession
    path: str
    version: int
    commits: tuple[str, ...] = ()
    batches: dict[str, int] = field(default_factory=dict)

    def _read(self, kind: str, schema: StructType | str) -> DataFrame:
        if not self.commits:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/commit={c}" for c in self.commits])

    def standing(self) -> DataFrame:
        """(document_id, revision, commit): for each document the commit that has its greatest revision, of equal ones the last.
        A document whose text went is here too, so that an older revision that comes late doesn't bring it back."""
        held = self._read("documents", "document_id long, revision long, commit string")
        return held.groupBy("document_id").agg(F.max(F.struct("revision", "commit")).alias("m")).select("document_id", "m.revision", "m.commit")

    def rows(self, schema: StructType | str = "document_id long") -> DataFrame:
        """The rows of all documents as they stand; schema is what an empty table has."""
        if not self.commits:
            return self.spark.createDataFrame([], schema)
        return self._read("rows", schema).join(self.standing().select("document_id", "commit"), ["document_id", "commit"], "left_semi").drop("commit")


def open_table(spark: SparkSession, path: str, version: int | None = None) -> DocumentTable:
    """The newest version of a table, or the one asked for; version 0, without commits, where nothing was written."""
    version, held = versions.told(spark, path, version)
    return DocumentTable(spark, path, version, tuple(held.get("commits", ())), held.get("batches", {}))


def _next(table: DocumentTable, commits: tuple[str, ...], batches: dict[str, int]) -> DocumentTable:
    versions.switch(table.spark, table.path, table.version + 1, {"commits": commits, "batches": batches})
    return DocumentTable(table.spark, table.path, table.version + 1, commits, batches)


def _named(table: DocumentTable) -> str:
    """A commit's name: names are in the order of versions."""
    return f"{table.version + 1:09d}-{uuid.uuid4().hex}"


def replace_documents(table: DocumentTable, docs: DataFrame, make: Callable[[DataFrame], DataFrame], id_col: str = "doc_id", revision_col: str = "revision", stream: str = "", batch: int | None = None) -> DocumentTable:
    """The next version: all rows of these documents are those that make() makes of them (with document_id), none if it makes none.

    Of several rows of a document the greatest revision (null: least) counts, whatever comes first; rows equal in it count by all
    their columns. Only the new rows are written. A batch of a stream that the table holds already changes nothing.
    """
    if batch is not None and table.batches.get(stream, -1) >= batch:
        return table
    name = _named(table)
    ties = F.to_json(F.struct(*sorted(docs.columns)), {"ignoreNullFields": "false"})
    last = latest(docs.where(F.col(id_col).isNotNull()), [id_col], [F.desc_nulls_last(revision_col), F.desc(ties)])
    make(last).write.parquet(f"{table.path}/rows/commit={name}")
    last.select(F.col(id_col).alias("document_id"), F.col(revision_col).alias("revision")).write.parquet(f"{table.path}/documents/commit={name}")
    return _next(table, (*table.commits, name), table.batches | ({stream: batch} if batch is not None else {}))


def compact(table: DocumentTable) -> DocumentTable:
    """The next version: one commit, of the rows as they stand. Readers of older versions go on reading theirs."""
    if len(table.commits) < 2:
        return table
    name = _named(table)
    table.rows().write.parquet(f"{table.path}/rows/commit={name}")
    table.standing().drop("commit").write.parquet(f"{table.path}/documents/commit={name}")
    return _next(table, (name,), table.batches)
