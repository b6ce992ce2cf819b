"""Whole files written by tasks into a shared folder.

A task names its files by partition and number, and a file appears in one step (a rename, or an object store's put). A task that
runs again writes the same rows, sorted the same way, under the same names, so a lost executor leaves neither gaps nor copies.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse


def write_file(folder: str, name: str, data: bytes) -> None:
    url = urlparse(folder)
    if url.scheme in ("", "file"):
        at = unquote(url.path)
        os.makedirs(at, exist_ok=True)
        with open(tmp := f"{at}/.{name}.{uuid.uuid4().hex}", "wb") as f:
            f.write(data)
        os.replace(tmp, f"{at}/{name}")
        return
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(folder)
    store.create_dir(at, recursive=True)
    tmp = f"{at}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(tmp) as f:
        f.write(data)
    store.move(tmp, f"{at}/{name}")
