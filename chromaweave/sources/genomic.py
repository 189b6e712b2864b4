"""Readers and writers of genomic text formats and of contact matrices kept as Parquet.

Matrices are HDF5 files (``sources/cooler.py``) by their ending, else Parquet tables of pixels beside a JSON description.
Tracks are bedGraph, bigWig or Parquet.
"""

from __future__ import annotations

import json
import lzma

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chromaweave.functions.formulas import strip_quotes
from chromaweave.sources.bigwig import read_bigwig, write_bigwig
from chromaweave.sources.cooler import read_cooler, write_cooler
from chromaweave.sources.xz import read_xz_lines, write_xz_lines


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) of text files: plain, gz, bz2 and zstd as Spark reads them, xz in runs of blocks, lzma and lz4 frames file by
    file."""
    if path.endswith(".xz"):
        return read_xz_lines(spark, path)
    if not path.endswith((".lzma", ".lz4")):
        return spark.read.text(path).select(F.input_file_name().alias("path"), F.col("value").alias("line"))

    def unpack(parts):
        for part in parts:
            for name, content in zip(part["path"], part["content"]):
                text = pa.CompressedInputStream(pa.BufferReader(content), "lz4").read() if name.endswith(".lz4") else lzma.decompress(content)
                yield part.__class__({"path": name, "line": text.decode().splitlines()})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "path string, line string")


def read_chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(chrom_id, chrom, size) in file order. Blank lines are skipped; another number of fields than two, a repeated
    name and a size of 0 are errors. The file has a line per chromosome and is read on the driver."""
    rows, seen = [], set()
    for row in text_lines(spark, path).toLocalIterator():
        line = row["line"].rstrip()
        if not line:
            continue
        fields = [f.strip('"').strip("'") for f in line.split("\t")]
        if len(fields) != 2:
            raise ValueError(f"expected 2 fields, got {len(fields)}: {line!r}")
        name, size = fields[0], int(fields[1])
        if name in seen:
            raise ValueError(f"chromosome {name!r} is listed twice")
        if size <= 0:
            raise ValueError(f"chromosome {name!r} has size {size}")
        seen.add(name)
        rows.append((len(rows), name, size))
    return spark.createDataFrame(rows, "chrom_id int, chrom string, size bigint")


def _checked(bad: Column, what: str, line: Column, value: Column) -> Column:
    return F.when(bad, F.raise_error(F.concat(F.lit(what + ": "), line))).otherwise(value)


#: Field names of the dialects by number of fields.
BED_FIELDS = ["chrom", "start", "end", "name", "score", "strand", "thick_start", "thick_end", "rgb", "block_count", "block_sizes", "block_starts"]
_NUMBERS = {"start": "bigint", "end": "bigint", "score": "double", "thick_start": "bigint", "thick_end": "bigint", "block_count": "bigint"}


def parse_bed(lines: DataFrame, fields: int, unique: bool = False) -> DataFrame:
    """Records of (line): fields split on tabs and spaces, empty ones dropped, quotes around texts removed.

    Blank lines and lines that begin with # or hold ``track`` or ``browser`` as a header are left out. Wrong numbers,
    start > end, scores outside [0, 1000], strands other than + - . and thick ends outside the record are errors, and
    with ``unique`` so are two records at one place.
    """
    line = F.col("line")
    header = (F.trim(line) == "") | line.startswith("#") | line.rlike(r"^(track|browser)\b")
    tokens = F.filter(F.split(line, "[\t ]+"), lambda x: x != "")
    rows = lines.where(~header).select(line, tokens.alias("t"))
    names = BED_FIELDS[:fields]
    out = rows.withColumn("t", _checked(F.size("t") < fields, "too few fields", line, F.col("t")))
    for k, name in enumerate(names):
        raw = F.get("t", F.lit(k))
        if name in _NUMBERS:
            value = raw.try_cast(_NUMBERS[name])
            out = out.withColumn(name, _checked(value.isNull(), f"bad {name}", line, value))
        else:
            out = out.withColumn(name, strip_quotes(raw))
    checks = [("start > end", F.col("start") > F.col("end"))]
    if fields >= 5:
        checks.append(("score outside [0, 1000]", ~F.col("score").between(0, 1000)))
    if fields >= 6:
        checks.append(("bad strand", ~F.col("strand").isin("+", "-", ".")))
    if fields >= 8:
        checks.append(("thick part outside the record", (F.col("thick_start") < F.col("start")) | (F.col("thick_end") > F.col("end"))))
    if fields >= 9:
        out = out.withColumn("rgb", F.when(F.col("rgb") != ".", F.transform(F.split("rgb", ","), lambda x: x.try_cast("int"))))
        checks.append(("bad colour", F.col("rgb").isNotNull() & ((F.size("rgb") != 3) | F.exists("rgb", lambda x: x.isNull() | ~x.between(0, 255)))))
    if fields >= 12:
        for name in ("block_sizes", "block_starts"):
            out = out.withColumn(name, F.transform(F.filter(F.split(name, ","), lambda x: x != ""), lambda x: x.try_cast("bigint")))
            checks.append((f"bad {name}", (F.size(name) != F.col("block_count")) | F.exists(name, lambda x: x.isNull())))
    for what, bad in checks:
        out = out.withColumn("start", _checked(bad, what, line, F.col("start")))
    out = out.select(*names)
    if unique:
        again = F.count(F.lit(1)).over(Window.partitionBy("chrom", "start", "end")) > 1
        out = out.withColumn("start", F.when(again, F.raise_error(F.concat(F.lit("two records at "), "chrom", F.lit(":"), F.col("start").cast("string")))).otherwise(F.col("start")))
    return out


def read_bed(spark: SparkSession, path: str, fields: int = 6, unique: bool = False) -> DataFrame:
    return parse_bed(text_lines(spark, path), fields, unique)


def read_first_records(spark: SparkSession, path: str, n: int, fields: int = 6) -> DataFrame:
    """The first ``n`` records, headers and blank lines not counted; a limit, so no more of the file is read than it takes."""
    return parse_bed(text_lines(spark, path), fields).limit(n)


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, value) of a track."""
    out = spark.read.schema("chrom string, start bigint, end bigint, value double").csv(path, sep="\t", comment="#")
    return out.where("start IS NOT NULL")


def read_track(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, value) of a track: bigWig by its ending, bedGraph otherwise."""
    return read_bigwig(spark, path) if path.lower().endswith((".bw", ".bigwig")) else read_bedgraph(spark, path)


def write_track(track: DataFrame, chroms: DataFrame, path: str) -> None:
    """A track as bigWig by its ending, bedGraph otherwise."""
    if path.lower().endswith((".bw", ".bigwig")):
        write_bigwig(track, chroms, path)
    else:
        write_bedgraph(track, path)


def write_bedgraph(track: DataFrame, path: str, compression: str | None = None) -> None:
    """A track as text, sorted by chrom and start."""
    writer = track.select("chrom", "start", "end", "value").sort("chrom", "start").write
    (writer.option("compression", compression) if compression else writer).csv(path, sep="\t")


def track_statistics(track: DataFrame, chroms: DataFrame, chrom: str, start: int, end: int, window: int) -> DataFrame:
    """(window, mean, least, largest, n) of the track over equal windows of a query; null where it has no value.

    Means weigh values by the bases they cover. Unknown chromosomes, empty queries and ends beyond the chromosome are errors.
    """
    size = chroms.where(F.col("chrom") == chrom).select("size").first()
    if size is None or start >= end or end > size[0]:
        raise ValueError(f"{chrom}:{start}-{end} is no part of a known chromosome")
    spark = track.sparkSession
    windows = spark.range(0, -(-(end - start) // window)).select(F.col("id").alias("window"), (F.col("id") * window + start).alias("_start"), F.least((F.col("id") + 1) * window + start, F.lit(end)).alias("_end"))
    near = track.where((F.col("chrom") == chrom) & (F.col("start") < end) & (F.col("end") > start))
    dealt = near.withColumn("window", F.explode(F.sequence(F.floor((F.greatest("start", F.lit(start)) - start) / window), F.floor((F.least("end", F.lit(end)) - 1 - start) / window)))).join(windows, "window")
    bases = F.least("end", "_end") - F.greatest("start", "_start")
    found = dealt.groupBy("window").agg((F.sum(F.col("value") * bases) / F.sum(bases)).alias("mean"), F.min("value").alias("least"), F.max("value").alias("largest"), F.sum(bases).alias("n"))
    return windows.select("window").join(found, "window", "left")


def read_dense_text(spark: SparkSession, path: str, chrom: str) -> DataFrame:
    """Pixels of the upper triangle of a square tab-separated matrix; the file's lines are its rows."""
    place = F.monotonically_increasing_id()
    lines = text_lines(spark, path).select("line", F.shiftright(place, 33).alias("_part"), place.bitwiseAND((1 << 33) - 1).alias("_row"))
    sizes = lines.groupBy("_part").agg((F.max("_row") + 1).alias("_n"))  # one row for each partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    cells = lines.join(F.broadcast(before), "_part").withColumn("bin1", F.col("_before") + F.col("_row")).select("bin1", F.posexplode(F.split("line", "\t")).alias("bin2", "value"))
    return cells.where("bin2 >= bin1").select(F.lit(chrom).alias("chrom"), "bin1", F.col("bin2").cast("bigint").alias("bin2"), F.col("value").cast("double").alias("count")).where("count <> 0")


#: Rows of a matrix that one task writes, at least.
_BINS_A_FILE = 8192


def write_lines(lines: DataFrame, path: str, compression: str | None = None) -> None:
    """(line) as text files: plain, or by any codec that Spark writes (gzip, bzip2, lz4, zstd, ...); as one xz file if the path
    ends so."""
    if path.endswith(".xz"):
        return write_xz_lines(lines, path)
    (lines.write.option("compression", compression) if compression else lines.write).text(path)


def write_matrix(pixels: DataFrame, chroms: DataFrame, path: str, bin_size: int, nrows: int, metadata: dict | None = None) -> None:
    """Pixels that are not 0, by chrom and sorted in files of some rows of bins, with their distance from the diagonal, and
    a description beside; as one HDF5 file if the path ends in .cool."""
    if path.endswith(".cool"):
        return write_cooler(pixels, chroms, path, bin_size, {"nrows": nrows, **(metadata or {})})
    kept = pixels.where("count <> 0").withColumn("diag", F.col("bin2") - F.col("bin1"))
    kept.repartition("chrom", F.floor(F.col("bin1") / _BINS_A_FILE)).sortWithinPartitions("chrom", "bin1", "bin2").write.partitionBy("chrom").parquet(f"{path}/pixels")
    about = json.dumps({"bin_size": bin_size, "nrows": nrows, **(metadata or {})})
    chroms.select("chrom", "size").withColumn("about", F.lit(about)).coalesce(1).write.parquet(f"{path}/chroms")


def read_matrix(spark: SparkSession, path: str, chrom: str | None = None, start: int = 0, end: int | None = None, diagonal_width: int = 0) -> tuple[DataFrame, DataFrame, dict]:
    """Pixels, chroms and description of a written matrix; of one region and band only, if asked for. The filters are on
    the partition column and on columns with statistics, so other data is not read. HDF5: ``path.cool`` or ``path.mcool::/group``."""
    if path.partition("::")[0].endswith((".cool", ".mcool")):
        pixels, chroms, about = read_cooler(spark, path, chrom, start, end, diagonal_width)
        written = json.loads(about.get("metadata") or "{}")
        return pixels, chroms, about | {"nrows": written["nrows"] if not diagonal_width and "nrows" in written else about["nrows"]}
    chroms = spark.read.parquet(f"{path}/chroms")
    about = json.loads(chroms.select("about").first()[0])
    pixels = spark.read.parquet(f"{path}/pixels")
    if chrom is not None:
        size = chroms.where(F.col("chrom") == chrom).select("size").first()
        if size is None:
            raise ValueError(f"no chromosome {chrom!r}")
        if end is not None and end > size[0]:
            raise ValueError(f"{chrom} ends at {size[0]}")
        last = -(-(end or size[0]) // about["bin_size"])
        pixels = pixels.where((F.col("chrom") == chrom) & (F.col("bin1") >= start // about["bin_size"]) & (F.col("bin2") < last))
    if diagonal_width:
        pixels = pixels.where(F.col("diag") < -(-diagonal_width // about["bin_size"]))
    return pixels.select("chrom", "bin1", "bin2", "count"), chroms.drop("about"), about


def has_no_pixels(pixels: DataFrame) -> bool:
    return pixels.isEmpty()


def read_weights(spark: SparkSession, path: str, column: str = "balanced.sum") -> DataFrame:
    """(chrom, diag, weight) of a tab-separated file with a header; the first column may be ``chrom`` or ``region``."""
    table = spark.read.csv(path, sep="\t", header=True)
    name = "chrom" if "chrom" in table.columns else "region"
    if missing := {name, "diag", column} - set(table.columns):
        raise ValueError(f"{path} lacks {sorted(missing)}")
    return table.select(F.col(name).alias("chrom"), F.col("diag").cast("bigint").alias("diag"), F.col(f"`{column}`").try_cast("double").alias("weight"))


def read_ranges(spark: SparkSession, path: str) -> list[tuple[float, float, float]]:
    """Discretisation ranges (start, end, value); a few lines, read on the driver. start >= end is an error."""
    rows = [tuple(map(float, r["line"].split("\t"))) for r in text_lines(spark, path).toLocalIterator() if r["line"].strip()]
    for start, end, _ in rows:
        if start >= end:
            raise ValueError(f"range {start} to {end} is empty")
    return rows
