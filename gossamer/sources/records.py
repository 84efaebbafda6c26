"""Record files: JSON lines, or one array for small results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def write_records(records: DataFrame, path: str) -> None:
    """A path that ends in .jsonl gets a folder of JSON-lines files; any other one pretty array, written by the driver a row at a time."""
    if path.endswith(".jsonl"):
        records.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
        return
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for k, row in enumerate(records.toLocalIterator()):
            f.write(("," if k else "") + "\n  " + json.dumps(row.asDict(recursive=True), ensure_ascii=False))
        f.write("\n]\n")
