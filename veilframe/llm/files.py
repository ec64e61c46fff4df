"""Files in the shared folder, written and read on the executors through Arrow's file systems."""

from __future__ import annotations

import pyarrow.fs as fs


def put(uri: str, data: bytes) -> None:
    """Writes a whole file; a repeated task replaces it by the same bytes."""
    import uuid

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, path)


def get(uri: str) -> bytes:
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_stream(path) as f:
        return f.read()


def part(uri: str, at: int, size: int) -> bytes:
    """``size`` bytes of a file from an offset, without reading the rest."""
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as f:
        return f.read_at(size, at)
