"""Bytes of media: metafiles inside OLE objects, equation headers, and which external tools could convert them."""

from __future__ import annotations

import shutil

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

from paperloom.functions.equations import equation
from paperloom.sources.ole import EQUATION, ole_streams

# First bytes of metafiles, in the order in which they are looked for.
SIGNATURES = ((".wmf", b"\xd7\xcd\xc6\x9a"), (".emf", b" EMF"))
# External programs by use, in order of preference.
TOOLS = {"image": ("inkscape", "magick", "convert", "ffmpeg"), "metafile": ("inkscape", "magick", "soffice", "sips"), "latex": ("xelatex", "pdflatex", "lualatex"), "document": ("pandoc",)}
FONTS = 5


@pandas_udf(StructType([StructField("suffix", StringType()), StructField("data", BinaryType())]))
def metafile(data: pd.Series) -> pd.DataFrame:
    """The metafile inside the bytes: the first WMF, else the first EMF; null data and .wmf where there is none."""
    rows = []
    for x in data:
        found = next(((kind, x[at:]) for kind, mark in SIGNATURES if x and (at := x.find(mark)) >= 0), (".wmf", None))
        rows.append(found)
    return pd.DataFrame(rows, columns=["suffix", "data"])


@pandas_udf(StructType([StructField("version", IntegerType()), StructField("fonts", ArrayType(StringType()))]))
def equation_header(data: pd.Series) -> pd.DataFrame:
    """Version and first font names of equation data; null and none where it is shorter than a header (28 bytes)."""
    rows = []
    for x in data:
        if x is None or len(x) < 28:
            rows.append((None, []))
            continue
        at = x.find(b"Times New Roman")
        names = x[at:].split(b"\0")[:-1] if at > 0 else []
        rows.append((x[4], [n.decode("latin-1") for n in names if 2 < len(n) < 50][:FONTS]))
    return pd.DataFrame({"version": pd.Series([r[0] for r in rows], dtype="Int32"), "fonts": [r[1] for r in rows]})


def equations(media: DataFrame) -> DataFrame:
    """(file_id, original_filename, version, fonts, latex, error) of the OLE media: a row for each equation stream or unreadable object.

    version and fonts are those of ``equation_header``; objects without an equation give no row.
    """
    found = ole_streams(media.where("kind = 'ole'").select("file_id", "original_filename", "bytes"), (EQUATION,))
    read = found.withColumns({"_h": equation_header(F.col("data")), "_e": equation(F.col("data"))})
    return read.select("file_id", "original_filename", "_h.version", "_h.fonts", "_e.latex", F.coalesce("error", "_e.error").alias("error"))


def capabilities(spark: SparkSession) -> DataFrame:
    """(use, tool, rank, available): the external programs that the driver finds; none of them is needed."""
    rows = [(use, tool, i, shutil.which(tool) is not None) for use, tools in TOOLS.items() for i, tool in enumerate(tools)]
    return spark.createDataFrame(rows, "use string, tool string, rank int, available boolean")


def previews(media: DataFrame) -> DataFrame:
    """OLE media with the metafile inside them (suffix, data) and status: preview, or unavailable without one.

    Turning a metafile into a web image takes an external program; the metafile itself is kept for it.
    """
    found = metafile(F.col("bytes"))
    ole = media.where("kind = 'ole'").withColumn("_m", found)
    return ole.select("file_id", "original_filename", "filename", F.col("_m.suffix").alias("suffix"), F.col("_m.data").alias("data"), F.when(F.col("_m.data").isNotNull(), "preview").otherwise("unavailable").alias("status"))
