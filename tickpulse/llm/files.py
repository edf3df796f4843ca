"""Small whole files in the shared folder, written from tasks so that a repeated attempt replaces nothing half-way."""

from __future__ import annotations

import pickle
import uuid
from collections import OrderedDict

import numpy as np
from pyarrow import fs


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def write_file(path: str, content: bytes) -> None:
    """Write beside the target, then rename."""
    system, place = _open(path)
    system.create_dir(place.rpartition("/")[0], recursive=True)
    part = f"{place}.{uuid.uuid4().hex[:8]}.tmp"
    with system.open_output_stream(part) as out:
        out.write(content)
    system.move(part, place)


def map_file(path: str) -> np.ndarray:
    """The bytes of a file: memory-mapped where the store is a file system, read into memory elsewhere."""
    system, place = _open(path)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(place, np.uint8, "r")
    with system.open_input_file(place) as f:
        return np.frombuffer(f.read(), np.uint8)


class RecordWriter:
    """Appends records to a file of its own in a shared folder; ``file, at, size`` finds one again.  Every attempt of a task writes
    another file, so what a failed one leaves is named by no row."""

    def __init__(self, folder: str):
        self._folder, self._file, self._out, self._at = folder, uuid.uuid4().int >> 65, None, 0

    def add(self, record: object) -> tuple[int, int, int]:
        if self._out is None:
            system, place = _open(self._folder)
            system.create_dir(place, recursive=True)
            self._out = system.open_output_stream(f"{place}/{self._file}", buffer_size=1 << 20)
        content = pickle.dumps(record, protocol=5)
        self._out.write(content)
        self._at += len(content)
        return self._file, self._at - len(content), len(content)

    def close(self) -> None:
        if self._out is not None:
            self._out.close()


class RecordReader:
    """Reads records of a folder by ``file, at, size``; the last ones used, about 32 MB, stay in memory."""

    def __init__(self, folder: str):
        self._system, self._place = _open(folder)
        self._files, self._last, self._held = {}, OrderedDict(), 0

    def get(self, file: int, at: int, size: int) -> object:
        if (file, at) in self._last:
            self._last.move_to_end((file, at))
            return self._last[file, at][0]
        if file not in self._files:
            if len(self._files) == 64:
                self.close()
            self._files[file] = self._system.open_input_file(f"{self._place}/{file}")
        record = pickle.loads(self._files[file].read_at(size, at))
        self._last[file, at] = record, size
        self._held += size
        while self._held > 1 << 25 and len(self._last) > 2:
            self._held -= self._last.popitem(last=False)[1][1]
        return record

    def close(self) -> None:
        for f in self._files.values():
            f.close()
        self._files.clear()
