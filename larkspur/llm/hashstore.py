"""Sorted arrays in the shared folder, written by tasks and memory-mapped by workers.

A store is a folder of raw arrays named ``<kind>-<shard>``. Tasks write a shard under a name of
their own and move it into place, so a task that runs twice does no harm. Where the folder is on a
local or mounted file system workers map the files; elsewhere they read the shards they need.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs


def put(uri: str, kind: str, shard: int, values: np.ndarray) -> None:
    system, path = pafs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)
    own, final = f"{path}/.{kind}-{shard}-{uuid.uuid4().hex}", f"{path}/{kind}-{shard}"
    with system.open_output_stream(own) as out:
        out.write(memoryview(np.ascontiguousarray(values)).cast("B") if len(values) else b"")
    try:
        system.move(own, final)
    except OSError:  # another attempt was first; its content is the same
        system.delete_file(own)


class Store:
    """Arrays by kind and shard, opened when first asked for."""

    def __init__(self, uri: str):
        self.uri, self.open = uri, {}

    def get(self, kind: str, shard: int, dtype) -> np.ndarray:
        if (kind, shard) not in self.open:
            system, path = pafs.FileSystem.from_uri(self.uri)
            name = f"{path}/{kind}-{shard}"
            if not system.get_file_info(name).size:  # no task had anything for it
                found = np.empty(0, dtype)
            elif isinstance(system, pafs.LocalFileSystem):
                found = np.memmap(name, dtype, "r")
            else:
                found = np.frombuffer(system.open_input_file(name).read_buffer(), dtype)
            self.open[kind, shard] = found
        return self.open[kind, shard]

    def close(self) -> None:
        """Lets all arrays go."""
        self.open = {}


def by_shard(shards: np.ndarray):
    """(shard, positions) for each shard that occurs."""
    order = np.argsort(shards, kind="stable")
    edges = np.flatnonzero(np.diff(shards[order])) + 1
    for own in np.split(order, edges):
        if len(own):
            yield int(shards[own[0]]), own


def packed(values: np.ndarray) -> bytes:
    """Compressed, byte plane by byte plane."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T.copy() if len(values) else np.empty(0, np.uint8)
    return len(values).to_bytes(8, "little") + (pa.compress(planes.tobytes(), "zstd", asbytes=True) if len(values) else b"")


def unpacked(data: bytes, dtype) -> np.ndarray:
    n, dtype = int.from_bytes(data[:8], "little"), np.dtype(dtype)
    if not n:
        return np.empty(0, dtype)
    planes = np.frombuffer(pa.decompress(data[8:], n * dtype.itemsize, "zstd", asbytes=True), np.uint8)
    return planes.reshape(dtype.itemsize, n).T.copy().view(dtype).reshape(n)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of each one's counts."""
    if not len(keys):
        return keys, counts.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order].astype(np.int64), first)
