"""Small files of any Hadoop file system, read and written by the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none where there is no folder."""
    fs, place = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, place = _at(spark, path)
    return fs.exists(place) and fs.getFileStatus(place).isDirectory()


def read_text(spark: SparkSession, path: str) -> str:
    fs, place = _at(spark, path)
    stream = fs.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """The whole file, or none: it is written beside its place and renamed. An existing file is an error."""
    fs, place = _at(spark, path)
    if fs.exists(place):
        raise FileExistsError(path)
    _, draft = _at(spark, f"{path}.draft")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not fs.rename(draft, place):
        raise OSError(f"could not rename {path}.draft")


def remove(spark: SparkSession, path: str) -> None:
    fs, place = _at(spark, path)
    fs.delete(place, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """A folder to a new place; what stood there is removed first."""
    fs, place = _at(spark, target)
    fs.delete(place, True)
    fs.mkdirs(place.getParent())
    _, given = _at(spark, source)
    if not fs.rename(given, place):
        raise OSError(f"could not rename {source}")
