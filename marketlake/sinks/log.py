"""A log of batches as folders of Parquet files under a manifest that is swapped whole.

``<path>/data/<folder>`` holds a base and the batches after it, ``<path>/manifest/<number>.json``
which of them count. A new manifest is written beside the others and renamed to the next number,
which fails if another writer took it, so readers see all of a batch or nothing, and a lost run
leaves the last manifest valid. When enough batches have gathered they are merged into one base.
Folders that no recent manifest names are removed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Batches beside the base before they are merged, and manifests that are kept for readers.
MERGE_AFTER, KEEP_MANIFESTS = 16, 3
#: Names of batches a manifest remembers to recognise repeated ones.
REMEMBERED = 1_000


class Log:
    """One log. ``merge`` turns all rows into the rows of a new base (default: as they are, in fewer files)."""

    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame] | None = None,
                 merge_after: int = MERGE_AFTER) -> None:
        self.spark, self.path, self.merge, self.merge_after = spark, path.rstrip("/"), merge, merge_after
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, name: str) -> list[str]:
        folder = self._at(f"{self.path}/{name}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def manifest(self) -> dict:
        """The current manifest; an empty log has number 0."""
        numbers = [int(x[:-5]) for x in self._list("manifest") if x.endswith(".json")]
        if not numbers:
            return {"number": 0, "folders": [], "batches": [], "schema": None}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{max(numbers):012d}.json", wholetext=True).first()[0])

    def _commit(self, made: dict) -> bool:
        """Put a manifest in place; False if its number is taken."""
        target = self._at(f"{self.path}/manifest/{made['number']:012d}.json")
        draft = self._at(f"{self.path}/drafts/{uuid.uuid4().hex}")
        self._fs.mkdirs(target.getParent())
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        taken = self._fs.exists(target) or not self._fs.rename(draft, target)
        if taken:
            self._fs.delete(draft, False)
        return not taken

    def _write(self, df: DataFrame) -> str:
        folder = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/data/{folder}")
        return folder

    def append(self, df: DataFrame, batch: str) -> bool:
        """Add a batch under its name; a name that is there already adds nothing."""
        if batch in self.manifest()["batches"]:
            return False
        folder = self._write(df)
        while True:
            now = self.manifest()
            if batch in now["batches"]:
                return False
            if self._commit({"number": now["number"] + 1, "folders": [*now["folders"], folder],
                             "batches": [*now["batches"], batch][-REMEMBERED:], "schema": df.schema.json()}):
                break
        if len(now["folders"]) >= self.merge_after:
            self.compact()
        return True

    def compact(self) -> None:
        """Merge all folders of the current manifest into one; batches that come meanwhile stay beside it."""
        old = self.manifest()
        if len(old["folders"]) < 2:
            return
        rows = self._read(old)
        base = self._write((self.merge(rows) if self.merge else rows).select(*rows.columns))
        while True:
            now = self.manifest()
            if set(old["folders"]) - set(now["folders"]):
                return  # merged by another writer
            if self._commit({**now, "number": now["number"] + 1, "folders": [base, *[f for f in now["folders"] if f not in old["folders"]]]}):
                break
        self.vacuum()

    def vacuum(self) -> None:
        """Remove old manifests and folders that none of the kept ones names. Folders are made by the one
        writer of a log, so none is under way here."""
        names = [x for x in self._list("manifest") if x.endswith(".json")]
        for x in names[:-KEEP_MANIFESTS]:
            self._fs.delete(self._at(f"{self.path}/manifest/{x}"), False)
        used = set()
        for x in names[-KEEP_MANIFESTS:]:
            used |= set(json.loads(self.spark.read.text(f"{self.path}/manifest/{x}", wholetext=True).first()[0])["folders"])
        for x in set(self._list("data")) - used:
            self._fs.delete(self._at(f"{self.path}/data/{x}"), True)

    def _read(self, manifest: dict) -> DataFrame | None:
        from pyspark.sql.types import StructType

        if not manifest["schema"]:
            return None
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{f}" for f in manifest["folders"]])

    def read(self) -> DataFrame | None:
        """All rows of the current manifest; None before the first batch."""
        return self._read(self.manifest())
