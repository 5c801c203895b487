"""Versions of what lies in a folder: small numbered records, of which readers take the last.

A record appears under its number only when it is whole, and what it names is never changed afterwards. So a job
that ends midway leaves the version before in force, and a reader that has begun goes on with what it has. One
writer at a time publishes in a folder.
"""

from __future__ import annotations

import json
import re
import uuid

from pyarrow import fs

from postweave.sources.generated import open_store

RECORDS = "_versions"  # hidden from listings


def _numbers(store: fs.FileSystem, folder: str) -> list[int]:
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(int(m[1]) for info in found if (m := re.fullmatch(r"(\d+)\.json", info.base_name)))


def publish(root: str, record: dict) -> int:
    """Make ``record`` the version that readers see; gives its number."""
    store, folder = open_store(f"{root}/{RECORDS}")
    store.create_dir(folder, recursive=True)
    number = max(_numbers(store, folder), default=-1) + 1
    part = f"{folder}/{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(json.dumps(record).encode())
    target = f"{folder}/{number:09d}.json"
    if store.get_file_info(target).type != fs.FileType.NotFound:
        raise RuntimeError(f"version {number} of {root} was published meanwhile")
    store.move(part, target)
    return number


def latest(root: str) -> dict | None:
    """The last published record, or none."""
    store, folder = open_store(f"{root}/{RECORDS}")
    numbers = _numbers(store, folder)
    if not numbers:
        return None
    with store.open_input_stream(f"{folder}/{numbers[-1]:09d}.json") as source:
        return json.loads(source.read())
