"""Pages drawn as images from answers of the tables: what the scanning queries read."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.config import Layout
from quillmark.operators.scanning import mark_centers, page_centers


class Canvas:
    """A white page that takes ink where a function of millimetres says so, ``px`` pixels a millimetre."""

    def __init__(self, width_mm: float, height_mm: float, px: float):
        self.px = px
        self.grey = np.full((round(height_mm * px), round(width_mm * px)), 255, np.uint8)

    def ink(self, box: tuple[float, float, float, float], shape: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, value: int = 0) -> None:
        """Set the pixels in ``box`` (left, top, right, bottom) for which ``shape`` of the offsets from its middle holds; all, without one."""
        rows, cols = (slice(max(0, round(lo * self.px)), max(0, round(hi * self.px))) for lo, hi in ((box[1], box[3]), (box[0], box[2])))
        part = self.grey[rows, cols]
        if shape is None:
            part[:] = value
        elif part.size:
            v = (np.arange(rows.start, rows.start + part.shape[0]) + 0.5)[:, None] / self.px - (box[1] + box[3]) / 2
            u = (np.arange(cols.start, cols.start + part.shape[1]) + 0.5)[None, :] / self.px - (box[0] + box[2]) / 2
            part[shape(u, v)] = value


#: What fills a bubble of unit radius: pencil lines, and two bars that cross.
PENCIL = lambda u, v: (u * u / 0.62 + v * v / 0.72 < 1) & ((u + v) % 0.34 < 0.29)
CROSS = lambda u, v: (np.minimum(abs(u - v), abs(u + v)) < 0.17) & (np.maximum(abs(u), abs(v)) < 0.68)


def _square(x: float, y: float, half: float) -> tuple[float, float, float, float]:
    return x - half, y - half, x + half, y + half


def draw_page(layout: Layout, answers: dict[int, str], crossed: frozenset[int] = frozenset(), page: int = 0, px: float = 4) -> np.ndarray:
    """A page as printed and filled in: answers by item, marked by pencil lines, or by a cross for items in ``crossed``.

    The head is a framed title over two columns of broken lines, as text is; a
    bubble is a circle around as many dots as its option's number.
    """
    blank, inks = _printed(layout, page, px)
    grey = blank.copy()
    flat = grey.ravel()
    for no, answer in answers.items():
        for which in inks.get((no, answer, no in crossed), ()):
            flat[which] = 0
    return grey


@lru_cache(maxsize=64)
def _printed(layout: Layout, page: int, px: float) -> tuple[np.ndarray, dict[tuple[int, str, bool], list[np.ndarray]]]:
    """The page before anything is filled in, and the places of the pixels that each mark (item, letter, whether crossed) blackens."""
    canvas = Canvas(layout.page_width_mm, layout.page_height_mm, px)
    for x, y in mark_centers(layout):
        canvas.ink(_square(x, y, layout.fiducial_size_mm / 2))
    left, right = layout.margin_mm + 10, layout.page_width_mm - layout.margin_mm - 10
    top, foot = layout.margin_mm + 8, layout.grid_top_mm - 8
    title = (left, top, right, top + (foot - top) * 0.3)
    across, up = (right - left) / 2, (title[3] - title[1]) / 2
    canvas.ink(title, lambda u, v: (abs(u) > across - 0.8) | (abs(v) > up - 0.8) | ((abs(v) < 1.2) & (u % 9 < 7)), 20)
    canvas.ink((left, title[3] + 4, right, foot), lambda u, v: (v % 5 < 1.6) & (u % 13 < 11) & (abs(u) > 3), 20)
    radius, inks = layout.bubble_diameter_mm / 2, {}
    spots = page_centers(layout, page)
    for no, option, x, y in zip(*(spots[k].tolist() for k in ("no", "option_index", "x_mm", "y_mm")), strict=True):
        bubble = _square(x, y, radius)
        canvas.ink(bubble, lambda u, v: abs(np.hypot(u, v) - radius + 0.16) < 0.16)
        canvas.ink(bubble, lambda u, v, n=option + 1: (abs(v) < 0.25) & (abs(u) < 0.35 * n) & ((u + 0.35 * n) % 0.7 < 0.4), 60)
        for fill in (PENCIL, CROSS):
            mark = Canvas.__new__(Canvas)
            mark.px, mark.grey = px, np.full_like(canvas.grey, 255)
            mark.ink(bubble, lambda u, v, fill=fill: fill(u / radius, v / radius))
            inks.setdefault((no, layout.option_set[option], fill is CROSS), []).append(np.flatnonzero(mark.grey == 0))
    return canvas.grey, inks


def drawer(layout: Layout, px: float = 4, image: Callable[[int, np.ndarray], tuple[int, int, int, bytes]] | None = None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Makes batches of images (sheet_id, page_index, height, width, n_channels, data) of batches of (sheet_id, answers); every third item is crossed.

    ``image`` makes the last four of a sheet's number and its page; without it pages stay grey.
    """
    pages = -(-layout.num_questions // (layout.columns * layout.rows_per_column))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        crossed = frozenset(range(2, layout.num_questions + 1, 3))
        for pdf in batches:
            for s in pdf.itertuples(index=False):
                answers = {i + 1: a for i, a in enumerate(s.answers) if a is not None}
                for page in range(pages):
                    grey = draw_page(layout, answers, crossed, page, px)
                    made = image(int(s.sheet_id), grey) if image else (*grey.shape, 1, grey.tobytes())
                    yield pd.DataFrame([(s.sheet_id, page, *made)], columns=["sheet_id", "page_index", "height", "width", "n_channels", "data"])

    return run


def drawn_pages(sheets: DataFrame, layout: Layout, px: float = 4) -> DataFrame:
    """Pages drawn from (sheet_id, answers array<string>) as images."""
    return sheets.select(F.col("sheet_id").cast("string"), "answers").mapInPandas(drawer(layout, px), "sheet_id string, page_index int, height int, width int, n_channels int, data binary")
