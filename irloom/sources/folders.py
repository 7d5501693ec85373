"""A data source for folders of function files, in batch and as a stream: one partition for each folder."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from irloom.functions.text import opt_level

MAP = "function_map.csv"


class Folder(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def folder_rows(folder: Path) -> Iterator[tuple]:
    """file_path, file_name, function_name, text, error of the .ll files that the folder's map names; of repeated names the last line counts.

    A file that cannot be read as UTF-8 is a row with an error and no text; so is a map, without a file_path.
    """
    try:
        with open(folder / MAP, encoding="utf-8", newline="") as f:
            names = {row[1]: row[0] for row in csv.reader(f) if len(row) >= 2}
    except (OSError, UnicodeDecodeError, csv.Error) as e:
        yield None, folder.name, None, None, f"{type(e).__name__}: {e}"
        return
    for file in sorted(folder.glob("*.ll")):
        if names.get(file.name) and file.is_file():
            text = error = None
            try:
                text = file.read_bytes().decode("utf-8")
            except (OSError, UnicodeDecodeError) as e:
                error = f"{type(e).__name__}: {e}"
            yield file.as_uri().replace("file://", "file:", 1), folder.name, names[file.name], text, error


class FolderReader(DataSourceReader):
    def __init__(self, root: Path):
        self.root = root

    def partitions(self) -> list[Folder]:
        return [Folder(str(m.parent)) for m in sorted(self.root.glob(f"*/{MAP}"))]

    def read(self, partition: Folder | None) -> Iterator[tuple]:  # None: there are no folders
        return folder_rows(Path(partition.path)) if partition else iter(())


class FolderStream(DataSourceStreamReader):
    """An offset is the time at which a map was last written, in nanoseconds: a folder belongs to the batch in which its map falls."""

    def __init__(self, root: Path):
        self.root = root

    def maps(self) -> list[tuple[int, str]]:
        return sorted((m.stat().st_mtime_ns, str(m.parent)) for m in self.root.glob(f"*/{MAP}"))

    def initialOffset(self) -> dict:
        return {"after": 0}

    def latestOffset(self) -> dict:
        return {"after": max((t for t, _ in self.maps()), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        return [Folder(p) for t, p in self.maps() if start["after"] < t <= end["after"]]

    def read(self, partition: Folder | None) -> Iterator[tuple]:  # None: there are no folders
        return folder_rows(Path(partition.path)) if partition else iter(())


class FunctionFolders(DataSource):
    """path: a folder, mounted alike on the driver and all executors, with a folder for each binary.

    The map of a folder is written last: a stream takes a folder up once it has one, and again when
    the map is written anew.  For other file systems there is files.scan_corpus_dirs.
    """

    @classmethod
    def name(cls) -> str:
        return "function_folders"

    def schema(self) -> str:
        return "file_path string, file_name string, function_name string, text string, error string"

    def root(self) -> Path:
        return Path(self.options["path"].removeprefix("file://")).absolute()

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.root())

    def streamReader(self, schema) -> FolderStream:
        return FolderStream(self.root())


def read_folders(spark: SparkSession, root: str, stream: bool = False) -> DataFrame:
    """file_path, file_name (the folder's name), function_name, text, error, opt."""
    spark.dataSource.register(FunctionFolders)
    reader = spark.readStream if stream else spark.read
    return reader.format("function_folders").option("path", root).load().withColumn("opt", opt_level("file_name"))
