"""Image files: what they are by their first bytes, how photographs were held, and what is stored of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.scalars import sheet_name
from quillmark.operators import imaging, jpeg
from quillmark.operators.scanning import BAD_IMAGE, NO_IMAGE, colours_of

#: Longest side and quality of the stored image and of its thumbnail.
FULL, THUMB = (1600, 90), (220, 70)
#: Bytes of files that leave a task at a time, about.
FILE_BYTES = 8 << 20
#: Leading bytes of image files in hexadecimal, and their kind.
SIGNATURES = {"FFD8FF": "image/jpeg", "89504E470D0A1A0A": "image/png", "474946383761": "image/gif", "474946383961": "image/gif", "424D": "image/bmp", "49492A00": "image/tiff", "4D4D002A": "image/tiff"}


def read_images(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(sheet_id, file_name, name, page_index, height, width, n_channels, data) of the image files under ``path``.

    Spark decodes JPEG, PNG, BMP and GIF. A file that is no image has height -1
    and stays, so that it can be counted.
    """
    reader = spark.read.format("image").option("recursiveFileLookup", True)
    return image_rows((reader.option("pathGlobFilter", glob) if glob else reader).load(path))


def image_rows(images: DataFrame) -> DataFrame:
    """The columns of ``read_images`` from Spark's image struct; the id is a hash of the path, so it is the same each time."""
    file = F.element_at(F.split(F.url_decode(F.replace(F.col("image.origin"), F.lit("+"), F.lit("%2B"))), "/"), -1)
    return images.select(
        F.sha2(F.col("image.origin").cast("binary"), 256).alias("sheet_id"), file.alias("file_name"), sheet_name(file).alias("name"), F.lit(0).alias("page_index"),
        F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("n_channels"), F.col("image.data").alias("data"),
    )


def intake_counts(images: DataFrame) -> DataFrame:
    """One row (readable, rejected)."""
    return images.agg(F.count_if(F.col("height") > 0).alias("readable"), F.count_if(F.col("height") <= 0).alias("rejected"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of any files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def kind_of(content: Column) -> Column:
    """The MIME type that a file's first bytes tell, WebP too; null if they tell none."""
    head = F.hex(F.substring(content, 1, 12))
    kind = F.when(F.startswith(head, F.lit("52494646")) & F.endswith(head, F.lit("57454250")), "image/webp")
    for signature, name in SIGNATURES.items():
        kind = kind.when(F.startswith(head, F.lit(signature)), name)
    return kind


def _number(hexed: Column, at: Column, size: int, little: Column) -> Column:
    """An unsigned number of ``size`` bytes at byte ``at`` of hexadecimal text, in either order; null beyond the end."""
    part = [F.substr(hexed, (at + i) * 2 + 1, F.lit(2)) for i in range(size)]
    text = F.when(little, F.concat(*reversed(part))).otherwise(F.concat(*part))
    return F.when((at >= 0) & (F.length(hexed) >= (at + size) * 2), F.conv(text, 16, 10).cast("long"))


#: Bytes of a file that are searched for its orientation: directories stand at the front.
EXIF_BYTES = 65_536
#: Entries of a directory that are looked at: it is sorted, and orientation is among the first.
EXIF_ENTRIES = 64


def orientation_of(content: Column) -> Column:
    """How a JPEG photograph was held, 1 to 8 as its EXIF directory says; 1 where it doesn't.

    The directory is found by its marker and read as columns: byte order, place
    of the first directory, then its entries up to the one of orientation.
    """
    hexed = F.hex(F.substring(content, 1, EXIF_BYTES))
    # An even place is that of a byte.
    found = F.locate("457869660000", hexed)
    marker = F.when((found > 0) & (found % 2 == 1) & F.startswith(hexed, F.lit("FFD8")), (found - 1) / 2).cast("int")
    start = marker + 6
    little = F.substr(hexed, start * 2 + 1, F.lit(4)) == "4949"
    directory = start + _number(hexed, start + 4, 4, little)
    n = F.least(_number(hexed, directory, 2, little), F.lit(EXIF_ENTRIES))
    entry = lambda i: (directory + 2 + i * 12).cast("int")
    values = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)).cast("int")), lambda i: F.when(_number(hexed, entry(i), 2, little) == 0x0112, _number(hexed, entry(i) + 8, 2, little)))
    value = F.get(F.array_compact(values), F.lit(0))
    return F.when(value.between(1, 8), value).otherwise(1).cast("int")


def taken_in(files: DataFrame) -> DataFrame:
    """``files`` (path, mime, content) that may be images, with kind, orientation and accepted.

    A file without a MIME type is kept, as is one whose type is an image's;
    what no first bytes confirm is refused whatever its type says. Refused files
    stay as rows, so they can be counted.
    """
    offered = files.where((F.coalesce("mime", F.lit("")) == "") | F.startswith("mime", F.lit("image/")))
    kind = kind_of(F.col("content"))
    return offered.withColumns({"kind": kind, "orientation": orientation_of(F.col("content")), "accepted": kind.isNotNull()})


def upright(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """Pixels as they were seen when the photograph was taken."""
    if orientation in (2, 4, 5, 7):
        pixels = pixels[:, ::-1]
    return np.rot90(pixels, {3: 2, 4: 2, 5: 1, 6: 3, 7: 3, 8: 1}.get(orientation, 0))


def prepared(images: DataFrame) -> DataFrame:
    """(sheet_id, full, thumb, error): JPEG files of each row of ``images`` (sheet_id, height, width, n_channels, data, and orientation if there is one).

    The longest side is at most 1,600 and 220 pixels, smaller images keep their
    size, transparent pixels lie on white, and turned photographs stand upright.
    A row without an image or with bytes that are none has an error instead.
    """

    def one(s) -> tuple:
        if s.data is None or pd.isna(s.height):
            return s.sheet_id, None, None, NO_IMAGE
        if s.height < 1 or s.width < 1:
            return s.sheet_id, None, None, BAD_IMAGE
        try:
            pixels = colours_of(int(s.height), int(s.width), int(s.n_channels), s.data)
        except (ValueError, TypeError, IndexError) as e:
            return s.sheet_id, None, None, f"{BAD_IMAGE}: {type(e).__name__}"
        pixels = upright(pixels, s.orientation)
        return s.sheet_id, *(jpeg.encode(imaging.shrunk(pixels, side), quality) for side, quality in (FULL, THUMB)), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda made: pd.DataFrame(made, columns=["sheet_id", "full", "thumb", "error"])
        for pdf in batches:
            made, held = [], 0
            for s in pdf.itertuples(index=False):
                made.append(one(s))
                held += sum(len(x) for x in made[-1][1:3] if x)
                if held >= FILE_BYTES:
                    yield frame(made)
                    made, held = [], 0
            if made:
                yield frame(made)

    held = F.coalesce("orientation", F.lit(1)) if "orientation" in images.columns else F.lit(1)
    return images.select("sheet_id", "height", "width", "n_channels", "data", held.cast("int").alias("orientation")).mapInPandas(run, "sheet_id string, full binary, thumb binary, error string")


def jpeg_size(file: Column) -> Column:
    """(height, width) that a baseline JPEG file states."""
    hexed = F.hex(F.substring(file, 1, 1024))
    at = F.locate("FFC00011", hexed) + F.locate("FFC0000B", hexed)
    number = lambda skip: F.conv(F.substr(hexed, at + skip, F.lit(4)), 16, 10).cast("int")
    return F.when(at > 0, F.struct(number(10).alias("height"), number(14).alias("width")))
