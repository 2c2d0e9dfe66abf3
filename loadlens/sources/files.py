"""File listing, charsets and headers through the cluster's own file system client."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import SparkSession, functions as F


@dataclass(frozen=True)
class Layout:
    """How a delimited text file is written."""

    encoding: str
    sep: str
    header: tuple[str, ...]


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def list_files(spark: SparkSession, path: str, suffixes=(".csv", ".parquet")) -> list[str]:
    """The file itself, or the matching files of a directory and of the folders below it; names
    starting with _ or . are skipped, folders too."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    if fs.getFileStatus(p).isFile():
        return [path]
    found, walk = [], fs.listFiles(p, True)
    root = len(fs.makeQualified(p).toUri().getPath().rstrip("/"))
    while walk.hasNext():
        at = walk.next().getPath()
        below = at.toUri().getPath()[root:].strip("/").split("/")
        if below[-1].lower().endswith(tuple(suffixes)) and not any(
                n.startswith(("_", ".")) for n in below):
            found.append(at.toString())
    return sorted(found)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def rename(spark: SparkSession, src: str, dst: str) -> None:
    """Move a written folder into place; an older version there is replaced."""
    fs, s = _fs(spark, src)
    _, d = _fs(spark, dst)
    if fs.exists(d):
        fs.delete(d, True)
    fs.mkdirs(d.getParent())
    if not fs.rename(s, d):
        raise OSError(f"cannot move {src} to {dst}")


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A metadata file as text, whole."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readNBytes(int(fs.getFileStatus(p).getLen()))).decode("utf-8")
    finally:
        stream.close()


# One character of a text in ASCII and the two-byte Korean charset.
KOREAN = r"[\x00-\x7f]|[\x81-\xfe][\x41-\x5a\x61-\x7a\x81-\xfe]"


@dataclass(frozen=True)
class Survey:
    """What one pass over a text file's lines tells: its charset, the lines, those that the
    charset cannot decode whole, the bytes that it replaces, and the first line not blank."""

    charset: str
    lines: int
    lines_damaged: int
    bytes_replaced: int
    first: bytes


def surveys(spark: SparkSession, paths: list[str]) -> dict[str, Survey]:
    """Charset and first line of each file from all its lines, in one distributed pass that
    brings one row per file to the driver; files without a line that is not blank are left out.

    Of UTF-8 and CP949 (which holds EUC-KR) that charset is chosen in which fewer bytes are
    damaged, then UTF-8: a broken byte here and there does not decide about a whole file, and
    what the choice cannot decode is counted. Only files with bytes that are no UTF-8 are read
    again as CP949.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), "value",
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))
    utf8 = F.is_valid_utf8("value")
    blank = F.col("value").rlike(r"^\s*$")
    rows = lines.groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(~utf8).alias("utf8_lines"),
        # only damaged lines are looked at byte by byte
        F.sum(F.when(utf8, 0).otherwise(F.regexp_count(
            F.make_valid_utf8("value"), F.lit("\ufffd")))).alias("utf8_bytes"),
        F.min_by(F.when(~blank, F.col("value").cast("binary")),
                 F.when(~blank, F.col("at"))).alias("first")).collect()
    damaged = {plain_path(r["file"]) for r in rows if r["utf8_bytes"]}
    others = korean_damage(spark, [p for p in paths if plain_path(p) in damaged])
    out = {}
    for r in rows:
        file, charset, bad = plain_path(r["file"]), "utf-8", (r["utf8_lines"], int(r["utf8_bytes"]))
        if file in others and others[file][1] < bad[1]:
            charset, bad = "cp949", others[file]
        if r["first"] is not None:
            out[file] = Survey(charset, r["lines"], *bad, bytes(r["first"]).rstrip(b"\r"))
    return {p: out[plain_path(p)] for p in paths if plain_path(p) in out}


def korean_damage(spark: SparkSession, paths: list[str]) -> dict[str, tuple[int, int]]:
    """Lines and bytes of each file that CP949 cannot decode."""
    if not paths:
        return {}
    as_bytes = F.decode(F.col("value").cast("binary"), "ISO-8859-1")  # a character per byte
    korean = as_bytes.rlike(f"(?s)^(?:{KOREAN})*+$")
    rows = spark.read.text(paths).groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count_if(~korean).alias("lines"), F.sum(F.when(korean, 0).otherwise(F.length(
            F.regexp_replace(as_bytes, f"(?s){KOREAN}", "")))).alias("bytes")).collect()
    return {plain_path(r["file"]): (r["lines"], int(r["bytes"])) for r in rows}


def plain_path(uri: str) -> str:
    """Path of a file without scheme spelling differences."""
    return "/" + unquote(uri.split(":", 1)[-1]).lstrip("/")


def layout_of(line: bytes, charset: str) -> Layout:
    """Delimiter and header of a delimited file from its first line."""
    first = line.decode(charset, errors="replace").lstrip("\ufeff")
    sep = "\t" if "\t" in first else ","
    return Layout(charset, sep, tuple(c.strip().strip('"') for c in first.split(sep)))
