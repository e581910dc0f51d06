"""Files of a store, through the file systems that Spark itself uses."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def is_dir(self, name: str = "") -> bool:
        return self.exists(name) and self._fs.getFileStatus(self._path(name)).isDirectory()

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._path(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self._fs.create(self._path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def create(self, name: str) -> bool:
        """Make an empty file; False if it is there already, also when another process makes it just now."""
        try:
            self._fs.create(self._path(name), False).close()
        except Exception as error:
            if self.exists(name):
                return False
            raise error
        return True

    def escaped(self, key: str) -> str:
        """A key as Spark writes it in the name of a folder."""
        return self._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(key)

    def unescaped(self, name: str) -> str:
        return self._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def folders(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name)) if s.isDirectory() and s.getPath().getName()[0] not in "._")

    def under(self, name: str) -> list[str]:
        """Paths of the data files in a folder and all below it."""
        out, todo = [], [self._path(name)] if self.exists(name) else []
        while todo:
            for s in self._fs.listStatus(todo.pop()):
                if s.getPath().getName()[0] in "._":
                    continue
                if s.isDirectory():
                    todo.append(s.getPath())
                else:
                    out.append(s.getPath().toString())
        return sorted(out)

    def move_files(self, source: str, target: str) -> None:
        """Move all data files below a folder to the same places below another; their names are unique."""
        base = self._path(source).toUri().getPath()
        moves = []
        for path in self.under(source):
            own = self._jvm.org.apache.hadoop.fs.Path(path)
            inner = own.getParent().toUri().getPath()[len(base) :].strip("/")
            moves.append((own, self._path(f"{target}/{inner}")))
        for folder in {f.toString(): f for _, f in moves}.values():
            self._fs.mkdirs(folder)

        def move(one: tuple) -> None:
            if not self._fs.rename(one[0], self._jvm.org.apache.hadoop.fs.Path(one[1], one[0].getName())):
                raise OSError(f"{one[0].toString()} can't be moved")

        with ThreadPoolExecutor(16) as pool:
            list(pool.map(move, moves))

    def delete_file(self, name: str) -> None:
        """Delete a file by its path, and the folders that this leaves empty."""
        path = self._jvm.org.apache.hadoop.fs.Path(name)
        self._fs.delete(path, False)
        folder = path.getParent()
        while folder.getName() not in ("", "data") and not [s for s in self._fs.listStatus(folder) if s.getPath().getName()[0] not in "._"]:
            self._fs.delete(folder, True)
            folder = folder.getParent()
