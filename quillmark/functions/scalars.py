"""Scalar functions: Column in, Column out, all inside whole-stage code or JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least deviation score of each class, best class first.
CLASSES = (
    (130.0, "Sangat Superior"),
    (120.0, "Superior"),
    (110.0, "Di Atas Rata-rata"),
    (90.0, "Rata-rata"),
    (80.0, "Di Bawah Rata-rata"),
    (70.0, "Batas Ambang"),
    (float("-inf"), "Sangat Rendah"),
)

#: Least KR-20 of each verbal grade.
RELIABILITY = ((0.9, "sangat tinggi"), (0.8, "tinggi"), (0.7, "memadai untuk keputusan kelompok"), (0.6, "marginal"))

#: Abramowitz and Stegun 7.1.26, highest power first, and its t.
ERF = (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592)
ERF_T = 0.3275911

#: Month names of long dates.
MONTHS = ("Januari", "Februari", "Maret", "April", "Mei", "Juni", "Juli", "Agustus", "September", "Oktober", "November", "Desember")

#: Judgements of an item, and states of a response.
NO_KEY, REVISE, REVIEW, GOOD = "Tanpa kunci", "Revisi", "Tinjau", "Layak"
NOKEY, BLANK, CORRECT, WRONG = "nokey", "blank", "correct", "wrong"

PX_PER_MM = 96 / 25.4


def clamp(v: Column, low, high) -> Column:
    """Null stays null: least and greatest would skip it."""
    return F.when(v.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), v)))


def half_up(v: Column) -> Column:
    """Nearest integer, halves towards plus infinity."""
    return F.floor(v + 0.5)


def trimmed(v: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(v, "^[\\s\u00a0\ufeff]+|[\\s\u00a0\ufeff]+$", "")


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function by the polynomial, absolute error below 1e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + F.lit(ERF_T) * x)
    poly = F.lit(0.0)
    for c in ERF:
        poly = poly * t + F.lit(c)
    y = 1 - poly * t * F.exp(-x * x)
    return 0.5 * (1 + F.when(z < 0, -1.0).otherwise(1.0) * y)


def classify(deviation: Column) -> Column:
    """Class of an unrounded deviation score; null for null."""
    out = F.when(deviation.isNull(), F.lit(None).cast("string"))
    for least, label in CLASSES[:-1]:
        out = out.when(deviation >= least, label)
    return out.otherwise(CLASSES[-1][1])


def verdict(p: Column, discrimination: Column) -> Column:
    """Judgement of an item; a low discrimination comes before an extreme difficulty."""
    return F.when(p.isNull(), NO_KEY).when(discrimination < 0.2, REVISE).when((p < 0.2) | (p > 0.9), REVIEW).otherwise(GOOD)


def reliability_grade(kr20: Column) -> Column:
    out = F.when(kr20.isNull(), "belum dapat diestimasi")
    for least, label in RELIABILITY:
        out = out.when(kr20 >= least, label)
    return out.otherwise("rendah")


def item_status(key: Column, response: Column) -> Column:
    return F.when(key.isNull(), NOKEY).when(response.isNull(), BLANK).when(response == key, CORRECT).otherwise(WRONG)


def raw_score(correct: Column, wrong: Column, penalty: bool, options: int) -> Column:
    """Number right, or corrected for guessing; may then be negative."""
    c = correct.cast("double")
    return c - wrong / F.lit(float(max(1, options - 1))) if penalty else c


def scaled_score(raw: Column, scored: Column, scale_max: float) -> Column:
    return F.when(scored > 0, F.greatest(F.lit(0.0), raw) / scored * F.lit(float(scale_max))).otherwise(0.0)


def slugify(text: Column) -> Column:
    """Lower case with single hyphens, 60 characters at most; absent or empty text is ``laporan``."""
    base = F.when(text.isNull() | (text == ""), "laporan").otherwise(text)
    hyphens = F.regexp_replace(F.lower(base), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(hyphens, "^-+|-+$", ""), 1, 60)


def sanitize_filename(name: Column) -> Column:
    """Last path segment of safe characters, never hidden, never empty, 120 characters at most."""
    last = F.element_at(F.split(F.coalesce(name, F.lit("")), r"[\\/]", -1), -1)
    safe = F.regexp_replace(F.regexp_replace(last, r"[^A-Za-z0-9_.\-]+", "-"), r"^[.\-]+", "")
    return F.coalesce(F.nullif(F.substring(safe, 1, 120), F.lit("")), F.lit("berkas"))


def sheet_name(file_name: Column) -> Column:
    """A file's name without its last extension, in capitals."""
    return F.upper(F.regexp_replace(file_name, r"\.[^.]+$", ""))


def normalised_name(name: Column) -> Column:
    """Trimmed capitals; null where nothing is left."""
    return F.nullif(F.upper(trimmed(name)), F.lit(""))


def merge_key(name: Column, sheet_id: Column) -> Column:
    """Sheets of equal keys belong to one participant; an unnamed sheet stands alone."""
    return F.coalesce(normalised_name(name), sheet_id.cast("string"))


def long_date(iso: Column) -> Column:
    """``d MMMM yyyy`` of an ISO date; other text comes back as it is, null as a dash."""
    d = F.try_to_date(iso, "yyyy-MM-dd")
    months = F.array(*[F.lit(m) for m in MONTHS])
    long = F.concat_ws(" ", F.dayofmonth(d).cast("string"), F.get(months, F.month(d) - 1), F.year(d).cast("string"))
    return F.coalesce(F.when(d.isNotNull(), long), F.nullif(iso, F.lit("")), F.lit("—"))


def letters_of(text: Column, n: int) -> Column:
    """The first ``n`` letters and hyphens of typed answers, in capitals; everything else is deleted."""
    kept = F.substring(F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z-]+", ""), 1, n)
    return F.when(kept == "", F.array().cast("array<string>")).otherwise(F.split(kept, "", -1))


def parse_answers(text: Column, n: int, option_set: str) -> Column:
    """The first ``n`` typed answers; a letter outside the options holds its place as null."""
    options = [F.lit(c) for c in option_set]
    only = F.transform(letters_of(text, n), lambda c: F.when(c.isin(*options), c))
    return F.slice(F.concat(only, F.array_repeat(F.lit(None).cast("string"), n)), 1, n)


def fit_length(answers: Column, n: int) -> Column:
    """Cut to ``n`` or filled up with nulls; an empty answer counts as null."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.nullif(F.get(answers, i), F.lit("")))


def answer_pattern(answers: Column) -> Column:
    """Responses in a row, a hyphen for each blank."""
    return F.array_join(F.transform(answers, lambda a: F.coalesce(a, F.lit("-"))), "")


def base64_of_data_url(url: Column) -> Column:
    return F.coalesce(F.get(F.split(url, ",", -1), F.lit(1)), F.lit(""))


def data_url(content: Column, mime: str) -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def mm_to_px(v: Column) -> Column:
    return v * F.lit(PX_PER_MM)


def project_x(h: list[Column], x: Column, y: Column) -> Column:
    """Image column of a page point under a homography of nine coefficients; null at infinity."""
    d = h[6] * x + h[7] * y + h[8]
    return F.when(F.abs(d) >= 1e-12, (h[0] * x + h[1] * y + h[2]) / d)


def project_y(h: list[Column], x: Column, y: Column) -> Column:
    d = h[6] * x + h[7] * y + h[8]
    return F.when(F.abs(d) >= 1e-12, (h[3] * x + h[4] * y + h[5]) / d)
