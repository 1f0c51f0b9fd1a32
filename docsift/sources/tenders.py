"""Tenders and their price records, from tables in memory, files or a database alike."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.operators.audit import price_records, tenders_with_registry
from docsift.sources.readers import read_jdbc


@dataclass(frozen=True)
class TenderTables:
    """tenders: id, tender_number and others; records: tender_id and others. Every method gives a lazy DataFrame, in which
    a filter on an id reaches the scan or the database."""

    tenders: DataFrame
    records: DataFrame
    on_close: Callable[[], None] | None = None

    def list_for_audit(self, tender_ids: list[str] | None = None) -> DataFrame:
        """All tenders, or those of the given ids."""
        ids = [str(i) for i in tender_ids or []]
        return self.tenders.filter(F.col("id").cast("string").isin(ids)) if ids else self.tenders

    def _by(self, column: str, value: object) -> Column:
        return F.col(column).cast("string") == F.lit(str(value or "").strip())

    def find_by_id(self, tender_id: str) -> DataFrame:
        """No row or one; where an id repeats, any of its rows."""
        return self.tenders.filter(self._by("id", tender_id)).limit(1)

    def find_by_number(self, number: str) -> DataFrame:
        return self.tenders.filter(self._by("tender_number", number)).limit(1)

    def price_records(self, tender_id: str) -> DataFrame:
        return self.records.filter(self._by("tender_id", tender_id))

    def close(self) -> None:
        if self.on_close:
            self.on_close()


def from_database(spark: SparkSession, url: str, **options: str) -> TenderTables:
    """The same from the tables tenders, tender_registry, boq_items, client_positions, material_names and work_names."""
    t = lambda name: read_jdbc(spark, url, f"SELECT * FROM {name}", **options)
    records = price_records(t("boq_items"), t("client_positions"), t("material_names"), t("work_names"))
    return TenderTables(tenders_with_registry(t("tenders"), t("tender_registry")), records)
