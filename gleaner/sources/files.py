"""Small files and folders through the session's own file system (any that Spark can read)."""

from __future__ import annotations

from pyspark.sql import SparkSession


class AlreadyThere(Exception):
    """A file that must be new exists."""


class Files:
    """Operations on paths, in the file system that each path names."""

    def __init__(self, spark: SparkSession):
        self.sc = spark.sparkContext
        self.jvm = self.sc._jvm
        self.conf = self.sc._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.conf)

    def names(self, folder: str) -> dict[str, int]:
        """Names in a folder and when each was written (milliseconds); nothing for a missing folder."""
        fs = self._fs(folder)
        if not fs.exists(self._path(folder)):
            return {}
        return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(self._path(folder))}

    def read(self, path: str) -> str:
        stream = self._fs(path).open(self._path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, path: str, text: str, temporary: str) -> None:
        """Write a file whole or not at all; :class:`AlreadyThere` if another has it. Needs a file system whose
        rename is atomic and does not replace (HDFS, local folders)."""
        fs = self._fs(temporary)
        stream = fs.create(self._path(temporary), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        fs.mkdirs(self._path(path).getParent())
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(path).toUri(), self.conf) \
            if self._path(path).isAbsolute() and self._path(path).toUri().getScheme() else \
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.conf)
        none = self.sc._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(self._path(temporary)), fs.makeQualified(self._path(path)), none)
        except Exception as e:  # the gateway wraps what the file system throws
            fs.delete(self._path(temporary), False)
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                raise AlreadyThere(path) from None
            raise

    def delete(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)
