"""Folders of part files that a job's tasks write in two phases, and how they are read again."""

from __future__ import annotations

import contextlib
import time
import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage


def filesystem(path: str):
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), path)


def files(paths: list[str], suffix: str) -> list[str]:
    """Files as they are, folders as the parts that a writer has left in them, in order."""
    from pyarrow.fs import FileSelector, FileType

    out = []
    for path in paths:
        fs, name = filesystem(path)
        if fs.get_file_info(name).type != FileType.Directory:
            out.append(path)
            continue
        found = sorted(x.base_name for x in fs.get_file_info(FileSelector(name)) if x.base_name.startswith("part-") and x.base_name.endswith(suffix))
        out += [f"{path.rstrip('/')}/{x}" for x in found]
    return out


@dataclass
class Part(WriterCommitMessage):
    names: list[str]


class PartsWriter(DataSourceArrowWriter):
    """A folder of complete files, one for each task that has rows.

    Tasks write into a hidden folder of the job. The driver moves the files of successful tasks to their place when all
    are done, and only then; what other attempts have left goes with the hidden folder, and when the job fails everything
    does.
    """

    suffix = ""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.hidden = f".parts-{uuid.uuid4().hex}"
        # here and not in tasks: one that still runs when its job is given up finds no folder to write into
        fs, place = self.place(self.hidden)
        fs.create_dir(place, recursive=True)

    def place(self, *parts: str):
        fs, base = filesystem(self.path)
        return fs, "/".join([base, *parts])

    def part(self) -> tuple:
        """For a task: the file system, the name of its part and where to write it."""
        from pyspark import TaskContext

        ctx = TaskContext.get()
        name = f"part-{ctx.partitionId():05d}-{ctx.taskAttemptId()}{self.suffix}"
        fs, place = self.place(self.hidden, name)
        return fs, name, place

    def empty(self, file) -> None:
        """Writes a complete file without records."""
        raise NotImplementedError

    def commit(self, messages):
        from pyarrow.fs import FileSelector, FileType

        names = [n for m in messages if m is not None for n in m.names]
        fs, base = self.place()
        if not names:
            names = [f"part-00000-0{self.suffix}"]
            with fs.open_output_stream(self.place(self.hidden, names[0])[1], compression=None) as f:
                self.empty(f)
        old = [x for x in fs.get_file_info(FileSelector(base)) if x.type == FileType.File and (x.base_name.startswith("part-") or x.base_name == "_SUCCESS")]
        if old and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{self.path} has files already")
        for x in old:
            fs.delete_file(x.path)
        for n in names:
            fs.move(self.place(self.hidden, n)[1], self.place(n)[1])
        self.abort(messages)  # what is left in the hidden folder
        with fs.open_output_stream(self.place("_SUCCESS")[1], compression=None) as f:
            f.write(b"")

    def abort(self, messages):
        from pyarrow.fs import FileSelector, FileType

        fs, place = self.place(self.hidden)
        for _ in range(5):  # a task may just be writing a file
            if fs.get_file_info(place).type != FileType.Directory:
                break
            with contextlib.suppress(OSError):
                fs.delete_dir(place)
                break
            time.sleep(0.2)
        base = self.place()[1]
        if not fs.get_file_info(FileSelector(base)):  # made for this job
            fs.delete_dir(base)
