"""A streaming source of landed daily files whose offset is the cursor: the last day before the first that isn't complete.

Layout: ``<path>/<day>/<files>``, a day (as 2024-01-31) being complete once it holds the file ``_COMPLETE``. An incomplete day holds back itself and all later ones, so a
cursor never passes a gap. Files are found and read by Arrow's file systems (local, HDFS, object stores by their URI), in parts of whole lines.

    spark.dataSource.register(landed.LandedDays)
    spark.readStream.format("landed_days").option("path", "...").load()
"""

from __future__ import annotations

import ast
import io
import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

_DAY = re.compile(r"\d{4}-\d\d-\d\d")


class Part(InputPartition):
    def __init__(self, day: str, file: str, start: int, end: int) -> None:
        self.day, self.file, self.start, self.end = day, file, start, end


class _Folder:
    def __init__(self, options: dict) -> None:
        from pyarrow import fs

        self.uri, self.size = options["path"], int(options.get("partbytes", 16 << 20))
        self.first = options.get("startday", "")
        self.fs, self.root = fs.FileSystem.from_uri(self.uri if "://" in self.uri else f"file://{self.uri}")

    def days(self) -> dict[str, list]:
        """Files of each day, in order of days."""
        from pyarrow import fs

        found: dict[str, list] = {}
        for f in self.fs.get_file_info(fs.FileSelector(self.root, recursive=True, allow_not_found=True)):
            day = f.path.rsplit("/", 2)[-2]
            if f.is_file and _DAY.fullmatch(day) and day >= self.first:
                found.setdefault(day, []).append(f)
        return dict(sorted(found.items()))

    def through(self) -> str:
        """The cursor: the last of the complete days before any other; empty before the first."""
        last = ""
        for day, files in self.days().items():
            if not any(f.base_name == "_COMPLETE" for f in files):
                break
            last = day
        return last

    def parts(self, after: str, through: str) -> list[Part]:
        days = {d: fs for d, fs in self.days().items() if after < d <= through}
        return [Part(d, f.path, a, min(a + self.size, f.size)) for d, files in days.items() for f in sorted(files, key=lambda f: f.path) if not f.base_name.startswith(("_", ".")) for a in range(0, f.size, self.size)]

    def read(self, part: Part) -> Iterator[tuple[str, str, str]]:
        """Lines that begin in the part."""
        with io.BufferedReader(self.fs.open_input_file(part.file)) as f:
            at = part.start
            if at:
                f.seek(at - 1)
                at += len(f.readline()) - 1  # a line that began before is another part's
            else:
                f.seek(0)
            name = part.file.rsplit("/", 1)[-1]
            while at < part.end and (line := f.readline()):
                at += len(line)
                yield part.day, name, line.decode("utf-8", "replace").rstrip("\r\n")


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def initialOffset(self) -> dict:
        return {"day": ""}

    def latestOffset(self) -> dict:
        return {"day": _Folder(self.options).through()}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return _Folder(self.options).parts(start["day"], end["day"])

    def read(self, partition: Part) -> Iterator[tuple]:
        return _Folder(self.options).read(partition)

    def commit(self, end: dict) -> None:
        pass


class _Batch(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[Part]:
        """Complete days, or all days between startDay and throughDay where the latter is given: a re-scan."""
        folder = _Folder(self.options)
        return folder.parts("", self.options.get("throughday") or folder.through()) or [Part("", "", 0, 0)]

    def read(self, partition: Part) -> Iterator[tuple]:
        return _Folder(self.options).read(partition) if partition.file else iter(())


class LandedDays(DataSource):
    """Columns day, file, line. Options: path; startDay, the first day read; partBytes; throughDay, for a batch."""

    @classmethod
    def name(cls) -> str:
        return "landed_days"

    def schema(self) -> str:
        return "day string, file string, line string"

    def reader(self, schema) -> DataSourceReader:
        return _Batch({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream({k.lower(): v for k, v in self.options.items()})


def cursor_of(progress: dict) -> str:
    """The cursor of a query's last progress (``query.lastProgress``): the day through which it has read."""
    end = progress["sources"][0]["endOffset"]
    return (ast.literal_eval(end) if isinstance(end, str) else end)["day"]
