"""A write-only data source for documents that frame their rows: one head, one tail, separators between rows.

Tasks write their rows to a folder of this job alone; only when all have succeeded does the commit step put
the pieces in place, in the order of the partitions, with the head before and the tail after them.  Read in name order the
pieces are one valid document.  A document of at most ``single_bytes`` is also joined into one file.  A failed
job leaves nothing behind.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Documents up to this size become one file; larger ones stay in pieces.
SINGLE_BYTES = 256 << 20
COPY_BYTES = 4 << 20


def store(path: str):
    from pyarrow import fs
    if path.startswith("file:"):
        path = path.removeprefix("file:").replace("//", "/")                              # Hadoop writes file:/x as well as file:///x
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")


@dataclass
class Piece(WriterCommitMessage):
    partition: int
    name: str
    rows: int
    size: int


class DocumentWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.head, self.tail, self.separator = (options.get(k, "") for k in ("head", "tail", "separator"))
        self.file = options.get("file", "document.txt")
        self.single = int(options.get("single_bytes", SINGLE_BYTES))
        self.overwrite = options.get("replace", "false") == "true"
        self.job = f"_job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Piece:
        from pyspark import TaskContext
        context = TaskContext.get()
        target, root = store(self.path)
        folder = f"{root}/{self.job}"
        target.create_dir(folder, recursive=True)
        name = f"{folder}/{context.partitionId():06d}-{context.taskAttemptId()}"
        rows = 0
        with target.open_output_stream(name) as out:
            for row in iterator:
                out.write(((self.separator if rows else "") + row[0]).encode())
                rows += 1
            size = out.tell()
        return Piece(context.partitionId(), name, rows, size)

    def commit(self, messages: list) -> None:
        target, root = store(self.path)
        pieces = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition)
        if self.overwrite:
            for old in target.get_file_info(_listing(root)):
                if not old.base_name.startswith(self.job):
                    target.delete_dir(old.path) if old.type.name == "Directory" else target.delete_file(old.path)
        else:
            target.create_dir(root, recursive=True)
        framed = []

        def frame(text: str) -> None:
            name = f"{root}/piece-{len(framed):06d}"
            with target.open_output_stream(name) as out:
                out.write(text.encode())
            framed.append(name)

        frame(self.head)
        for k, m in enumerate(pieces):
            if k and self.separator:
                frame(self.separator)
            name = f"{root}/piece-{len(framed):06d}"
            target.move(m.name, name)
            framed.append(name)
        frame(self.tail)
        target.create_dir(f"{root}/{self.job}", recursive=True)
        target.delete_dir(f"{root}/{self.job}")
        if sum(m.size for m in pieces) <= self.single:
            joined = f"{root}/{self.file}"
            with target.open_output_stream(joined) as out:
                for name in framed:
                    with target.open_input_stream(name) as part:
                        while block := part.read(COPY_BYTES):
                            out.write(block)
            for name in framed:
                target.delete_file(name)
        with target.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list) -> None:
        target, root = store(self.path)
        target.create_dir(f"{root}/{self.job}", recursive=True)
        target.delete_dir(f"{root}/{self.job}")


def _listing(root: str):
    from pyarrow import fs
    return fs.FileSelector(root, allow_not_found=True)


class Document(DataSource):
    """Rows of one text column, framed."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_document"

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        if len(schema) != 1:
            raise ValueError("a document has one text column")
        return DocumentWriter({**self.options, "replace": str(overwrite).lower()})


def write_document(df, path: str, head: str = "", tail: str = "", separator: str = "", file: str = "document.txt", mode: str = "overwrite", single_bytes: int = SINGLE_BYTES) -> None:
    """Write the rows of a one-column frame as one document; order them first if their order matters."""
    df.sparkSession.dataSource.register(Document)
    options = {"head": head, "tail": tail, "separator": separator, "file": file, "single_bytes": str(single_bytes)}
    df.write.format(Document.name()).mode(mode).options(**options).save(path)
