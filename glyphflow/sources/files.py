"""A sink of text files, one for each value of a column: staged by the tasks, moved into place when the job commits."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def place(path: str):
    """The file system and the path in it, of a path or an address that ``pyarrow.fs`` knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, str]]  # where each lies, and its name


class LineFiles(DataSource):
    """Rows (file, line) as files of UTF-8 lines, below the path. Rows of a file come together, in order."""

    @classmethod
    def name(cls) -> str:
        return "glyphflow_lines"

    def schema(self) -> str:
        return "file string, line string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def _staging(self, root: str) -> str:
        return f"{root}/_staging-{self.job}"

    def write(self, iterator: Iterator[Row]) -> Staged:
        """Each file under a name of this attempt: another attempt of the task writes others, and one of them counts."""
        system, root = place(self.path)
        own, done, out, now = f"{self._staging(root)}/{uuid.uuid4().hex}", [], None, None
        system.create_dir(own, recursive=True)
        try:
            for row in iterator:
                if row.file != now or out is None:
                    if out is not None:
                        out.close()
                    now = row.file
                    at = f"{own}/{len(done)}"
                    out = system.open_output_stream(at)
                    done.append((at, now))
                    out.write((row.line or "").encode())
                else:
                    out.write(("\n" + (row.line or "")).encode())
        finally:
            if out is not None:
                out.close()
        return Staged(done)

    def commit(self, messages: list[Staged | None]) -> None:
        system, root = place(self.path)
        for at, name in (f for m in messages if m for f in m.files):
            target = f"{root}/{name}"
            if "/" in name:
                system.create_dir(target.rpartition("/")[0], recursive=True)
            system.move(at, target)
        system.delete_dir(self._staging(root))

    def abort(self, messages: list[Staged | None]) -> None:
        system, root = place(self.path)
        try:
            system.delete_dir(self._staging(root))
        except FileNotFoundError:
            pass
