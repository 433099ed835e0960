"""Reading scanned pages: an Arrow batch function around the image kernels.

A page that cannot be read becomes a row with ok false and an error, never an
exception, so one bad photograph does not fail a task. What leaves is the
darkness of every bubble; decisions are columns (see ``decisions``).
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark import schemas
from quillmark.config import Layout, OmrOptions
from quillmark.operators import imaging as im

#: Images that one task reads, a second or so each sixty.
IMAGES_PER_TASK = 128
#: Read pages that leave a task in one batch.
ROWS = 64

#: What a failed page says.
NO_MARKS = "corner marks not found"
NO_PLANE = "corner marks do not form a plane"
NO_ITEMS = "page has no items"
WRONG_SIZE = "corner marks do not fit the sheet's geometry"
MISALIGNED = "grid is not aligned with the sheet"
NO_IMAGE = "image is not available"
BAD_IMAGE = "image could not be decoded"


@lru_cache(maxsize=64)
def page_centers(layout: Layout, page: int = 0) -> dict[str, np.ndarray]:
    """Bubbles of one page as arrays, shared and not to be changed: no, option_index, column, row, x_mm, y_mm."""
    per_page = layout.columns * layout.rows_per_column
    start = page * per_page
    count = max(0, min(per_page, layout.num_questions - start))
    rows = -(-count // layout.columns)
    k = len(layout.option_set)
    item, option = np.divmod(np.arange(count * k), k)
    column, row = np.divmod(item, max(rows, 1))
    width = (layout.page_width_mm - 2 * layout.margin_mm - layout.column_gap_mm * (layout.columns - 1)) / layout.columns
    left = layout.margin_mm + column * (width + layout.column_gap_mm) + layout.number_gutter_mm
    half = layout.bubble_diameter_mm / 2
    x = left + option * (layout.bubble_diameter_mm + layout.bubble_gap_mm) + half
    return {"no": start + item + 1, "option_index": option, "column": column, "row": row, "x_mm": x, "y_mm": layout.grid_top_mm + row * layout.row_pitch_mm + half}


def mark_centers(layout: Layout) -> np.ndarray:
    """(4, 2): tl, tr, br, bl."""
    inset = layout.fiducial_inset_mm + layout.fiducial_size_mm / 2
    right, bottom = layout.page_width_mm - inset, layout.page_height_mm - inset
    return np.array([(inset, inset), (right, inset), (right, bottom), (inset, bottom)])


def _measured(mask: np.ndarray, found: dict[str, np.ndarray], layout: Layout, c: dict[str, np.ndarray]) -> Callable[[np.ndarray], tuple[np.ndarray | None, float]]:
    """Of four marks: the plane they span and the ink on its printed rings, once for each four."""
    marks, at, known = mark_centers(layout), np.column_stack((found["cx"], found["cy"])), {}

    def measure(quad: np.ndarray) -> tuple[np.ndarray | None, float]:
        if (key := tuple(quad.tolist())) not in known:
            hom = im.homography(marks, at[quad])
            known[key] = hom, -np.inf if hom is None else im.ring_density(mask, hom, c["x_mm"], c["y_mm"], layout.bubble_diameter_mm / 2)
        return known[key]

    return measure


def _turned(mask: np.ndarray, layout: Layout, measure: Callable):
    """Chooser of the orientation whose bubbles stand on printed rings, the head of the page having more ink than its foot."""
    m, w, h = layout.margin_mm, layout.page_width_mm, layout.page_height_mm

    def evidence(quad: np.ndarray) -> float:
        hom, ring = measure(quad)
        if hom is None:
            return -np.inf
        head = im.band_density(mask, hom, m, m, w - m, layout.grid_top_mm - 4)
        return 2 * ring + head - im.band_density(mask, hom, m, h - m - layout.footer_mm, w - m, h - m)

    def choose(quads: list[np.ndarray]) -> np.ndarray:
        return quads[int(np.argmax([evidence(q) for q in quads]))]

    return choose


def read_page(grey: np.ndarray, layout: Layout, page: int = 0, options: OmrOptions = OmrOptions()) -> dict:
    """Fields of a scan row (see schemas.SCAN) without its keys."""
    row = _read(grey, layout, page, options)
    if row["samples"] is not None:
        values = {k: v.tolist() for k, v in row["samples"].items()}
        values["option"] = [layout.option_set[i] for i in values["option_index"]]
        row["samples"] = [dict(zip(_BUBBLE, s, strict=True)) for s in zip(*(values[k] for k in _BUBBLE), strict=True)]
    return row


def _read(grey: np.ndarray, layout: Layout, page: int, options: OmrOptions) -> dict:
    """``read_page`` with arrays of all samples, without their option."""
    mask, level = im.dark_mask(grey, options.local_window_divisor, options.local_bias)
    c = page_centers(layout, page)
    out = {"ok": False, "error": None, "threshold": level, "alignment": None, "homography": None, "samples": None}
    found = quad = measure = None
    for factor in im.STRICTNESS:
        found = im.components(im.mark_mask(grey, level, factor))
        measure = _measured(mask, found, layout, c)
        quad = im.corner_marks(found, grey.shape, layout.page_width_mm / layout.page_height_mm, _turned(mask, layout, measure))
        if quad is not None:
            break
    if quad is None:
        return out | {"error": NO_MARKS}
    marks = mark_centers(layout)
    hom, alignment = measure(quad)
    if hom is None:
        return out | {"error": NO_PLANE}
    if not len(c["no"]):
        return out | {"error": NO_ITEMS}
    x, y = im.project(hom, marks[:, 0], marks[:, 1])
    ex, ey = im.project(hom, marks[:, 0] + layout.fiducial_size_mm, marks[:, 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.sqrt(found["area"][quad]) / np.hypot(ex - x, ey - y)
    if np.count_nonzero((ratio >= 0.55) & (ratio <= 1.8)) < 3:
        return out | {"error": WRONG_SIZE}
    if alignment < 0.12:
        return out | {"error": MISALIGNED, "alignment": alignment}
    radius = layout.bubble_diameter_mm * options.sample_radius_factor
    x, y = im.project(hom, c["x_mm"], c["y_mm"])
    (ax, ay), (bx, by) = im.project(hom, c["x_mm"] + radius, c["y_mm"]), im.project(hom, c["x_mm"], c["y_mm"] + radius)
    r = (np.hypot(ax - x, ay - y) + np.hypot(bx - x, by - y)) / 2
    ok = np.isfinite(x) & np.isfinite(r)
    samples = {k: c[k][ok] for k in ("no", "option_index", "column", "row", "x_mm", "y_mm")}
    samples |= {"x": x[ok], "y": y[ok], "radius": r[ok], "fill": im.disc_shares(mask, x[ok], y[ok], r[ok])}
    return out | {"ok": True, "alignment": alignment, "homography": hom.tolist(), "samples": samples}


def colours_of(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Grey (h, w) or red, green and blue (h, w, 3) bytes of Spark's image struct: rows of grey, BGR or BGRA; transparent pixels lie on white."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return a[:, :, 0]
    rgb = a[:, :, 2::-1]
    if channels == 4:
        alpha = a[:, :, 3:4] / 255.0
        rgb = np.rint(rgb * alpha + 255.0 * (1 - alpha)).astype(np.uint8)
    return rgb


def pixels_of(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Grey image of Spark's image struct: rows of grey, BGR or BGRA bytes; transparent pixels lie on white."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return a[:, :, 0]
    if channels == 3:
        return im.grey_of(a, im.LUMA[::-1])
    rgb = a[:, :, 2::-1]
    if channels == 4:
        alpha = a[:, :, 3:4] / 255.0
        rgb = rgb.astype(np.float64) * alpha + 255.0 * (1 - alpha)
    return im.to_grey(rgb)


def spread(rows: DataFrame, n: int, by: str = "sheet_id", each: int = IMAGES_PER_TASK) -> DataFrame:
    """``n`` rows dealt over so many tasks that each has ``each`` of them, about, and every core some; adaptive planning doesn't join them again."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // each))
    return rows.repartition(tasks, by)


def scanned(images: DataFrame, layout: Layout, options: OmrOptions = OmrOptions(), source: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None = None) -> DataFrame:
    """One row of schemas.SCAN per row of ``images`` (sheet_id, page_index, height, width, n_channels, data).

    A null image and one that the source could not decode (height below 1) are
    failed rows. A null page_index is page 0. Arrow batches are bounded by
    bytes (spark.sql.execution.arrow.maxBytesPerBatch); deal images out with
    ``spread`` where few partitions hold them. A ``source`` makes batches of
    images of batches of other rows, in the task that reads them, so no image
    leaves it.
    """

    def read(sheet_id, page_index, height, width, channels, data) -> tuple:
        page = 0 if pd.isna(page_index) else int(page_index)
        row = {"ok": False, "error": None, "threshold": None, "alignment": None, "homography": None, "samples": None}
        # A missing number is no number, whichever of Arrow and pandas brings it.
        height, width, channels = (np.nan if v is None else v for v in (height, width, channels))
        if data is None or pd.isna(height):
            row["error"] = NO_IMAGE
        elif height < 1 or width < 1:
            row["error"] = BAD_IMAGE
        else:
            try:
                grey = pixels_of(int(height), int(width), int(channels), data)
            except (ValueError, TypeError, IndexError) as e:  # bytes that are no such image: a failed row, not a failed job
                row["error"] = f"{BAD_IMAGE}: {type(e).__name__}"
            else:
                row = _read(im.shrink(grey, options.max_dim), layout, page, options)
        return sheet_id, page, row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_memory()
        rows = []
        for columns in (([f[c] for c in _IMAGE] for f in source(b.to_pandas() for b in batches)) if source else map(_columns, batches)):
            for image in zip(*columns, strict=True):
                rows.append(read(*image))
                if len(rows) == ROWS:
                    yield _scans(rows, layout)
                    rows = []
        if rows:
            yield _scans(rows, layout)

    if source:
        return images.mapInArrow(run, schemas.SCAN)
    cols = [F.col("sheet_id").cast("string"), F.col("page_index").cast("int"), "height", "width", F.col("n_channels"), "data"]
    return images.select(*cols).mapInArrow(run, schemas.SCAN)


@lru_cache(maxsize=1)
def _keep_memory() -> None:
    """The worker keeps the megabytes that each page takes and frees, 128 at most, instead of getting them from the system for every page."""
    with contextlib.suppress(OSError, AttributeError):  # a C library without these settings
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 128 << 20)  # M_TRIM_THRESHOLD


_IMAGE = ("sheet_id", "page_index", "height", "width", "n_channels", "data")
_BUBBLE = schemas.BUBBLE.fieldNames()
_KINDS = {"no": pa.int32(), "option_index": pa.int32(), "column": pa.int32(), "row": pa.int32()}


def _columns(batch: pa.RecordBatch) -> list[list]:
    """Values of a batch of images, the bytes where they are."""
    columns = [c.to_pylist() for c in batch.columns[:-1]]
    return [*columns, [v.as_buffer() if v.is_valid else None for v in batch.column(len(columns))]]


def _scans(rows: list[tuple], layout: Layout) -> pa.RecordBatch:
    """Rows (sheet_id, page_index, what ``_read`` gives) as a batch of schemas.SCAN."""
    read = [r for _, _, r in rows]
    of = [r["samples"] for r in read]
    none = pa.array([s is None for s in of])
    ends = np.cumsum([0, *(0 if s is None else len(s["no"]) for s in of)]).astype(np.int32)
    held = [s for s in of if s is not None]
    join = lambda k: np.concatenate([s[k] for s in held]) if held else np.zeros(0)
    bubbles = {k: pa.array(join(k)).cast(_KINDS.get(k, pa.float64())) for k in _BUBBLE if k != "option"}
    bubbles["option"] = pa.array(list(layout.option_set), pa.string()).take(bubbles["option_index"])
    samples = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([bubbles[k] for k in _BUBBLE], _BUBBLE), mask=none)
    plain = {"ok": pa.bool_(), "error": pa.string(), "threshold": pa.int32(), "alignment": pa.float64(), "homography": pa.list_(pa.float64())}
    keys = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())]
    return pa.RecordBatch.from_arrays([*keys, *(pa.array([r[k] for r in read], t) for k, t in plain.items()), samples], names=schemas.SCAN.fieldNames())


def samples_of(scans: DataFrame) -> DataFrame:
    """(sheet_id, page_index, no, option, ..., fill): a row per bubble of the pages that were read."""
    return scans.where("ok").select("sheet_id", "page_index", F.explode("samples").alias("s")).select("sheet_id", "page_index", "s.*")


def sheets_after(sheets: DataFrame, decided: DataFrame, n: int) -> DataFrame:
    """``sheets`` with status, error, answers, confidence and baseline from decided scans of the same sheet_id.

    Detected items replace earlier answers, blanks too; a failed page keeps its
    answers. Sheets without a scan stay as they are.
    """
    found = F.transform_values(F.map_from_entries(F.transform("answers", lambda a: F.struct(a["no"], a))), lambda k, a: a)
    scan = decided.select(F.col("sheet_id").alias("_qm_id"), F.col("ok").alias("_qm_ok"), F.col("error").alias("_qm_error"), found.alias("_qm_a"), F.col("fill_rate").alias("_qm_rate"), F.col("baseline").alias("_qm_base"))
    joined = sheets.join(scan, F.col("sheet_id") == F.col("_qm_id"), "left")
    old = F.coalesce("answers", F.array().cast("array<string>"))
    item = lambda i: F.when(F.map_contains_key("_qm_a", i), F.try_element_at("_qm_a", i)["response"]).otherwise(F.get(old, i - 1))
    read, done = F.col("_qm_ok").isNotNull(), F.coalesce("_qm_ok", F.lit(False))
    return joined.withColumns(
        {
            "status": F.when(done, "done").when(read, "error").otherwise(F.col("status")),
            "error": F.when(read, F.col("_qm_error")).otherwise(F.col("error")),
            "answers": F.when(done, F.transform(F.sequence(F.lit(1), F.lit(n)), item)).otherwise(F.col("answers")),
            "confidence": F.when(done, F.col("_qm_rate")).otherwise(F.col("confidence")),
            "baseline": F.when(done, F.col("_qm_base")).otherwise(F.col("baseline")),
        }
    ).select(*sheets.columns)
