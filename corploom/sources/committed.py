"""Files that tasks write and the driver commits, for data sources whose files aren't Spark's own.

Each write has a folder of its own below the target, and each task attempt its own file names in it.
A table is what its manifest lists, which is put in place last and in one step: a task that dies, runs
twice or is cut off in the middle leaves nothing that a reader sees, and what it left is removed with
the commit. Paths may be of any store that pyarrow knows (``file://``, ``hdfs://``, ``s3://``, ...).
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field

from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql.datasource import WriterCommitMessage

MANIFEST = "_manifest.json"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path or URI and the path within it."""
    if local := re.fullmatch(r"file:(?://[^/]*)?(/.*)", path):
        path = local[1]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: its partition and, for each file, the name and facts that the manifest keeps."""

    partition: int
    files: list[dict] = field(default_factory=list)


class Commit:
    """One write below ``path``; sent to the tasks, which open files by it."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.folder = path.rstrip("/"), f"data-{uuid.uuid4().hex[:12]}"
        store, root = file_system(self.path)
        if not overwrite and store.get_file_info(f"{root}/{MANIFEST}").type != pafs.FileType.NotFound:
            raise ValueError(f"{path} holds a table already; overwrite it or choose another path")

    def message(self) -> Written:
        context = TaskContext.get()
        return Written(context.partitionId() if context else 0)

    def open(self, stem: str, ending: str):
        """(name, output stream) of a new file of this attempt."""
        store, root = file_system(self.path)
        store.create_dir(f"{root}/{self.folder}")
        name = f"{self.folder}/{stem}-{uuid.uuid4().hex[:8]}{ending}"
        return name, store.open_output_stream(f"{root}/{name}")

    def commit(self, messages: list[Written | None], order: str | None = None, **facts) -> None:
        """Puts the manifest in place, files by the fact ``order`` or as the tasks wrote them; removes strays and what was there before."""
        store, root = file_system(self.path)
        files = [f for m in sorted((m for m in messages if m), key=lambda m: m.partition) for f in m.files]
        if order:
            files.sort(key=lambda f: f[order])
        store.create_dir(root)
        draft = f"{root}/_{self.folder}.json"
        with store.open_output_stream(draft) as out:
            out.write(json.dumps({**facts, "files": files}).encode())
        store.move(draft, f"{root}/{MANIFEST}")
        kept = {f"{root}/{f['name']}" for f in files}
        for found in store.get_file_info(pafs.FileSelector(root, recursive=True)):
            if found.type == pafs.FileType.File and found.base_name != MANIFEST and found.path not in kept:
                store.delete_file(found.path)

    def abort(self) -> None:
        store, root = file_system(self.path)
        if store.get_file_info(f"{root}/{self.folder}").type != pafs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.folder}")


def committed(path: str) -> dict:
    """The manifest of a table; FileNotFoundError if nothing was committed."""
    store, root = file_system(path.rstrip("/"))
    with store.open_input_stream(f"{root}/{MANIFEST}") as lines:
        return json.loads(lines.read())


def open_file(path: str, name: str):
    """A file of the table, for reads at any place."""
    store, root = file_system(path.rstrip("/"))
    return store.open_input_file(f"{root}/{name}")
