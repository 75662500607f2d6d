"""Files fetched over HTTP into a folder that Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


def fetch(spark: SparkSession, url: str, path: str, sha256: str | None = None) -> bool:
    """Streams url to path, in any file system that Spark writes; False where path is there already.

    The file gets its name only when it is whole; one of another SHA-256 than expected is deleted and raises ValueError.
    A *.gz needs no unpacking: Spark's text reader does that.
    """
    jvm = spark.sparkContext._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    files = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(to):
        return False
    part = jvm.org.apache.hadoop.fs.Path(path + ".part")
    digest = jvm.java.security.MessageDigest.getInstance("SHA-256")
    connection = jvm.java.net.URI(url).toURL().openConnection()
    connection.setRequestProperty("User-Agent", "quillsieve")
    source = jvm.java.security.DigestInputStream(connection.getInputStream(), digest)
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, files.create(part, True), 1 << 20, True)
    found = bytes(digest.digest()).hex()
    if sha256 is not None and found != sha256.lower():
        files.delete(part, False)
        raise ValueError(f"{url} has the SHA-256 {found}, not {sha256}")
    if not files.rename(part, to):
        raise OSError(f"{path} cannot be written")
    return True
