"""Small driver-side files on any file system that Spark reaches."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

#: Calls that one driver has under way.
AT_ONCE = 32


class Files:
    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str | None:
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def list(self, path: str, suffix: str = "") -> list[str]:
        """The files right inside a folder."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return []
        found = (s.getPath() for s in fs.listStatus(p) if s.isFile())
        return sorted(f.toString() for f in found if f.getName().endswith(suffix) and f.getName()[0] not in "._")

    def read_all(self, path: str) -> list[str]:
        with ThreadPoolExecutor(AT_ONCE) as pool:
            return [t for t in pool.map(self.read, self.list(path)) if t]

    def there(self, paths: list[str]) -> list[str]:
        """Those of ``paths`` that exist."""
        with ThreadPoolExecutor(AT_ONCE) as pool:
            return [p for p, ok in zip(paths, pool.map(self.exists, paths), strict=True) if ok]

    def delete(self, paths: list[str]) -> None:
        for path in paths:
            fs, p = self._at(path)
            fs.delete(p, False)

    def write(self, path: str, text: str) -> None:
        self._put(path, text, True)

    def create(self, path: str, text: str) -> bool:
        """Whether the file was made here: false if it was there before."""
        try:
            self._put(path, text, False)
        except Exception as e:
            if "FileAlreadyExistsException" in str(e) or "already exists" in str(e):
                return False
            raise
        return True

    def _put(self, path: str, text: str, overwrite: bool) -> None:
        fs, p = self._at(path)
        stream = fs.create(p, overwrite)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
