"""Occurrence and record counts of every term, kept up to date by signed deltas.

Only added, changed or deleted records are read: each gives +1 or -1 for its terms, the deltas are
aggregated per term and appended as one segment of the store. The store's first segment, its base, holds nearly
all terms and is bucketed by term, so the later ones are merged into it bucket by bucket, without
a shuffle of the base, both where counts are read and where ``compact`` writes a new base.

Terms are compared without outer spaces and in upper case; null, '' and NA are no terms. A record
that holds a term twice adds 2 occurrences and 1 record. A term whose counts return to 0 disappears.
The row with a null term holds the number of records with at least one term in the field. Repeated
rows count as often as they stand. An empty table gives no rows, and every other column is ignored.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repspark.functions.missing import MISSING
from repspark.runtime import file_system, remove

COUNTS = "field_name string, term string, occurrences bigint, records bigint"
_MANIFEST = re.compile(r"(\d+)\.json")


def normal(col: Column) -> Column:
    return F.upper(F.trim(col))


def terms_of(col: str, separator: str | None) -> Column:
    """The terms of a field, in order and with repeats; an empty array if it has none."""
    c = F.col(col).cast("string")
    parts = F.split(c, separator) if separator else F.array(c)
    terms = F.filter(F.transform(parts, normal), lambda t: t.isNotNull() & ~t.isin(*MISSING))
    return F.coalesce(terms, F.array().cast("array<string>"))


def _field_rows(name: str, terms: Column) -> Column:
    """One struct per term, telling whether it is the record's first such term, and one for the record itself."""

    def row(term: Column, occ: Column, rec: Column) -> Column:
        return F.struct(F.lit(name).alias("field_name"), term.alias("term"), occ.alias("occ"), rec.alias("rec"))

    each = F.transform(terms, lambda t, i: row(t, F.lit(1), (F.array_position(terms, t) == i + 1).cast("int")))
    record = F.array(row(F.lit(None).cast("string"), F.lit(0), F.lit(1)))
    return F.when(F.size(terms) > 0, F.concat(each, record)).otherwise(F.filter(record, lambda _: F.lit(False)))


def signed_deltas(changes: DataFrame, fields: dict[str, str | None], sign: str = "sign") -> DataFrame:
    """(field_name, term, occurrences, records) added up over changed records; ``fields`` gives each field's separator."""
    each = [_field_rows(name, terms_of(name, separator)) for name, separator in fields.items()]
    rows = changes.select(F.col(sign).alias("sign"), F.explode(F.concat(*each)).alias("x"))
    return rows.groupBy("x.field_name", "x.term").agg(F.sum(F.col("sign") * F.col("x.occ")).cast("bigint").alias("occurrences"), F.sum(F.col("sign") * F.col("x.rec")).cast("bigint").alias("records"))


def changes_between(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Signed records that lead from ``old`` to ``new``: a record in both in equal number cancels out."""
    both = old.select(*columns, F.lit(-1).alias("sign")).unionByName(new.select(*columns, F.lit(1).alias("sign")))
    net = both.groupBy(*columns).agg(F.sum("sign").alias("sign"))
    return net.where(F.col("sign") != 0)


@dataclass
class TermCountStore:
    """Persistent counts under ``path``: segments of parquet files, the first bucketed and sorted by (field_name, term).

    Which segments count is told by the manifest of the highest number. A manifest is written under another name, then
    renamed, and never replaced, so at any time the store reads as before or as after a commit; segments have names of
    their own, so one that was written but not committed is no part of it. Of two writers at once the second raises.
    ``note`` of the manifest is the caller's: how far the source had been read when it was written.
    """

    spark: SparkSession
    path: str
    fields: dict[str, str | None]
    buckets: int = 32
    max_segments: int = 16

    def _manifests(self) -> list[tuple[int, str]]:
        """(number, path) of the committed manifests, in order."""
        fs, p = file_system(self.spark, f"{self.path}/manifests")
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return sorted((int(m.group(1)), f"{self.path}/manifests/{n}") for n in names if (m := _MANIFEST.fullmatch(n)))

    def _manifest(self) -> dict:
        found = self._manifests()
        if not found:
            return {"number": 0, "buckets": self.buckets, "segments": [], "stale": [], "note": None}
        fs, p = file_system(self.spark, found[-1][1])
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        number = manifest["number"]
        fs, new = file_system(self.spark, f"{self.path}/manifests/{uuid.uuid4().hex}.tmp")
        _, final = file_system(self.spark, f"{self.path}/manifests/{number}.json")
        stream = fs.create(new, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if fs.exists(final) or not self._rename(fs, new, final):
            fs.delete(new, False)
            raise RuntimeError(f"another writer has committed manifest {number} of {self.path}")
        for n, p in self._manifests():
            if n < number - 1:
                remove(self.spark, p)

    @staticmethod
    def _rename(fs, old, new) -> bool:
        return fs.rename(old, new)

    def _base(self, segment: str) -> DataFrame:
        name = f"terms_{segment}"
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({COUNTS}) USING parquet CLUSTERED BY (field_name, term) SORTED BY (field_name, term) INTO {self._manifest()['buckets']} BUCKETS LOCATION '{self.path}/{segment}'")
        return self.spark.table(name)

    def _files(self, segments: list[str]) -> DataFrame:
        return self.spark.read.schema(COUNTS).parquet(*[f"{self.path}/{s}" for s in segments])

    def _write(self, counts: DataFrame, buckets: int | None, whole: bool = False) -> str:
        """Name of a new segment that holds ``counts``, in ``buckets`` if it is a base; ``whole`` if these come bucket by bucket.

        A field's records stand under ''.
        """
        segment = uuid.uuid4().hex
        rows = counts.select("field_name", F.coalesce("term", F.lit("")).alias("term"), "occurrences", "records")
        if buckets is None:
            rows.write.parquet(f"{self.path}/{segment}")
            return segment
        rows = rows if whole else rows.repartition(buckets, "field_name", "term")
        rows.write.format("parquet").bucketBy(buckets, "field_name", "term").sortBy("field_name", "term").option("path", f"{self.path}/{segment}").saveAsTable(f"terms_{segment}")
        return segment

    def _drop(self, segment: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS terms_{segment}")
        remove(self.spark, f"{self.path}/{segment}")

    def note(self):
        """What the last caller of ``apply`` left as a note; None for a new store."""
        return self._manifest()["note"]

    def apply(self, changes: DataFrame, sign: str = "sign", note=None) -> None:
        """Count changed records: ``sign`` is +1 for a record that is there now and -1 for one that isn't any more."""
        m = self._manifest()
        deltas = signed_deltas(changes, self.fields, sign).where((F.col("occurrences") != 0) | (F.col("records") != 0))
        segment = self._write(deltas, None if m["segments"] else m["buckets"])
        self._commit(m | {"number": m["number"] + 1, "segments": [*m["segments"], segment], "note": m["note"] if note is None else note})
        if len(m["segments"]) + 1 > self.max_segments:
            self.compact()

    def compact(self) -> None:
        """Fold all segments into one. The old ones are left for readers that have begun, until the next compaction."""
        m = self._manifest()
        segment = self._write(self.counts(), m["buckets"], whole=len(m["segments"]) > 1)
        self._commit(m | {"number": m["number"] + 1, "segments": [segment], "stale": m["segments"]})
        for s in m["stale"]:
            self._drop(s)

    def counts(self) -> DataFrame:
        """(field_name, term, occurrences, records) as of now."""
        segments = self._manifest()["segments"]
        if not segments:
            return self.spark.createDataFrame([], COUNTS)
        key, both = ["field_name", "term"], ["occurrences", "records"]
        now = self._base(segments[0])
        if segments[1:]:
            later = self._files(segments[1:]).groupBy(*key).agg(*[F.sum(c).alias(f"_{c}") for c in both])
            # a sort-merge join keeps the base where it lies: each task has one bucket of it
            now = now.join(later.hint("merge"), key, "full_outer").select(*key, *[(F.coalesce(c, F.lit(0)) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in both])
        return now.where((F.col("occurrences") != 0) | (F.col("records") != 0)).withColumn("term", F.nullif("term", F.lit("")))

    def totals(self) -> dict[str, int]:
        """Records with at least one term, per field (as many entries as there are fields)."""
        segments = self._manifest()["segments"]
        if not segments:
            return {}
        rows = self._files(segments).where("term = ''").groupBy("field_name").agg(F.sum("records").alias("n"))
        return {r["field_name"]: r["n"] for r in rows.where("n <> 0").collect()}


def marked(store: TermCountStore, rare_below: int = 3, common_above: float = 0.02) -> DataFrame:
    """(field_name, term, occurrences, records, mark): rare if fewer than ``rare_below`` records hold the term,
    else common if more than ``common_above`` of the field's records do, else null."""
    limit = F.lit(None).cast("double")
    for name, n in store.totals().items():
        limit = F.when(F.col("field_name") == name, F.lit(common_above * n)).otherwise(limit)
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > limit, "common")
    return store.counts().where(F.col("term").isNotNull()).withColumn("mark", mark)
