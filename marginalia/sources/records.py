"""A Python data source of tagged reference records, each with its source text and error."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def parse(lines: Iterator[str]) -> Iterator[tuple[str | None, str | None, str | None, str, str | None]]:
    """(title, author, year, source, error) of records "TAG  - value" that end in "ER  -"; authors are joined by " & "."""
    said: list[str] = []
    fields: dict[str, list[str]] = {}
    for line in lines:
        line = line.rstrip("\n")
        if not line.strip():
            continue
        said.append(line)
        tag, sep, value = line.partition("  - ")
        if line.startswith("ER"):
            year = fields.get("PY", [None])[0]
            error = None if "TI" in fields else "no title"
            yield fields.get("TI", [None])[0], " & ".join(fields.get("AU", [])) or None, year, "\n".join(said), error
            said, fields = [], {}
        elif sep:
            fields.setdefault(tag, []).append(value)
    if said:
        yield None, None, None, "\n".join(said), "unfinished record"


class TaggedReferences(DataSource):
    """spark.read.format("tagged_references").option("path", ...): one partition per file, read line by line. Paths are local or mounted."""

    @classmethod
    def name(cls) -> str:
        return "tagged_references"

    def schema(self) -> str:
        return "title string, author string, year string, source string, error string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:  # noqa: ANN001
        self.path = options["path"].removeprefix("file://")

    def partitions(self) -> list[InputPartition]:
        import glob

        return [InputPartition(p) for p in sorted(glob.glob(self.path))]

    def read(self, partition: InputPartition):  # noqa: ANN201
        with open(partition.value, encoding="utf-8") as f:
            yield from parse(f)


def register(spark) -> None:  # noqa: ANN001
    spark.dataSource.register(TaggedReferences)
