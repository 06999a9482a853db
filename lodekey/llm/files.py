"""Files in the shared folder, opened by executors.

Plain paths and ``file:`` URIs go through the operating system, any other
scheme through Arrow's file systems.
"""

from __future__ import annotations

import contextlib
import os
import uuid
from urllib.parse import unquote, urlparse


def _local(uri: str) -> str | None:
    u = urlparse(uri)
    return unquote(u.path) if u.scheme in ("", "file") else None


def _remote(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    if (path := _local(uri)) is not None:
        os.makedirs(path, exist_ok=True)
    else:
        system, path = _remote(uri)
        system.create_dir(path, recursive=True)


@contextlib.contextmanager
def replacing(uri: str):
    """A file to write that appears under its name whole or not at all."""
    part = f"{uri}.{uuid.uuid4().hex}.part"
    if (path := _local(uri)) is not None:
        part = _local(part)
        try:
            with open(part, "wb") as f:
                yield f
            os.replace(part, path)
        finally:
            with contextlib.suppress(FileNotFoundError):
                os.unlink(part)
    else:
        system, path = _remote(uri)
        temporary = f"{path}.{part.rsplit('.', 2)[1]}.part"
        with system.open_output_stream(temporary) as f:
            yield f
        system.move(temporary, path)


@contextlib.contextmanager
def reading(uri: str):
    """A file that can be read and sought."""
    if (path := _local(uri)) is not None:
        with open(path, "rb") as f:
            yield f
    else:
        system, path = _remote(uri)
        with system.open_input_file(path) as f:
            yield f


def listing(uri: str, suffix: str) -> list[tuple[str, int]]:
    """Names and sizes of the files in a folder, by name."""
    if (path := _local(uri)) is not None:
        found = [(e.name, e.stat().st_size) for e in os.scandir(path)]
    else:
        from pyarrow import fs

        system, path = _remote(uri)
        found = [(i.base_name, i.size) for i in system.get_file_info(fs.FileSelector(path))]
    return sorted(x for x in found if x[0].endswith(suffix))
