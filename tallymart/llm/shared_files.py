"""Files that tasks write themselves, in a folder all executors share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyarrow import fs


class Folder:
    """A folder by URI (``file:``, ``hdfs:``, ``s3:`` ...) or absolute path.

    A file becomes visible under its name only when it is complete: it is written
    under a temporary name and renamed. A task that runs twice writes the same
    bytes twice, so either copy may stay.
    """

    def __init__(self, uri: str):
        self.system, self.path = fs.FileSystem.from_uri(uri)

    def made(self) -> Folder:
        self.system.create_dir(self.path, recursive=True)
        return self

    @contextmanager
    def new(self, name: str) -> Iterator:
        temporary = f"{self.path}/_tmp-{uuid.uuid4().hex}"
        stream = self.system.open_output_stream(temporary)
        try:
            yield stream
        except BaseException:
            stream.close()
            self.system.delete_file(temporary)
            raise
        stream.close()
        self.system.move(temporary, f"{self.path}/{name}")

    def read(self, name: str) -> bytes:
        with self.system.open_input_stream(f"{self.path}/{name}") as stream:
            return stream.read()

    def open(self, name: str):
        return self.system.open_input_file(f"{self.path}/{name}")

    def array(self, name: str, kind: str) -> np.ndarray:
        """A file as a flat array: memory-mapped if its store is a local file system, else read."""
        if isinstance(self.system, fs.LocalFileSystem):
            path = f"{self.path}/{name}"
            return np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)
        return np.frombuffer(self.read(name), kind)
