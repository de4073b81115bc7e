"""Tables that are replaced as a whole: numbered manifests name the folders that make up a version.

A version is written to folders of its own, and then one small manifest is created under the next number, which
fails if another writer took it. Readers take the manifest with the highest number that is complete. So nothing that a
reader may use is ever moved or changed, and a run that breaks off at any point leaves the version before in place.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

#: Versions that stay, so that readers of the one before can finish.
KEPT = 2


class Store:
    """The file operations, by the file system of a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.new = spark._jvm.org.apache.hadoop.fs.Path
        self.top = path.rstrip("/")
        self.files = self.new(self.top).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        at = self.new(f"{self.top}/{folder}")
        return [x.getPath().getName() for x in self.files.listStatus(at)] if self.files.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.files.open(self.new(f"{self.top}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A new file; an error if there is one."""
        stream = self.files.create(self.new(f"{self.top}/{name}"), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        at = self.new(f"{self.top}/{name}")
        if not self.files.delete(at, True) and self.files.exists(at):
            raise OSError(f"{at} can't be deleted")


def _numbers(store: Store) -> list[int]:
    return sorted(int(n) for n in store.names("manifests") if n.isdigit())


def _manifest(store: Store, number: int) -> dict | None:
    """None for one that a writer didn't finish."""
    try:
        found = json.loads(store.read(f"manifests/{number:010d}"))
    except ValueError:
        return None
    return found if isinstance(found, dict) and "folders" in found else None


def current(store: Store) -> tuple[int, dict] | None:
    """Number and manifest of the version that readers see."""
    for number in reversed(_numbers(store)):
        found = _manifest(store, number)
        if found is not None:
            return number, found
    return None


def fresh(store: Store, tag: str) -> str:
    """A name for a new folder of the table."""
    return f"{tag}-{uuid.uuid4().hex}"


def commit(store: Store, manifest: dict, after: int | None) -> int:
    """Make a manifest (with the names of its `folders`) the current one, if `after` still is; then folders of older versions go.

    after: the number of the version that this one was made from, None for none.
    """
    found = current(store)
    if (found[0] if found else None) != after:
        raise RuntimeError(f"{store.top} was changed meanwhile: version {found and found[0]} in place of {after}")
    number = max(_numbers(store), default=0) + 1
    store.create(f"manifests/{number:010d}", json.dumps(manifest, sort_keys=True))
    back = current(store)
    if back is None or back != (number, manifest):
        raise RuntimeError(f"{store.top}: version {number} can't be read back")
    clean(store)
    return number


def clean(store: Store) -> None:
    """Remove what only versions before the last KEPT name. Folders that no manifest names may be in the making, and stay."""
    known = [(n, m) for n in _numbers(store) if (m := _manifest(store, n)) is not None]
    kept = {f for _, m in known[-KEPT:] for f in m["folders"]}
    for number, manifest in known[:-KEPT]:
        for folder in set(manifest["folders"]) - kept:
            store.delete(folder)
        store.delete(f"manifests/{number:010d}")
