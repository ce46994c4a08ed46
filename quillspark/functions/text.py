"""Column functions over texts, paths and vectors."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category of each extension.
CATEGORIES = {
    "document": (".pdf", ".doc", ".docx", ".odt", ".rtf"),
    "spreadsheet": (".xls", ".xlsx", ".ods", ".csv"),
    "presentation": (".ppt", ".pptx", ".odp"),
    "image": (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".tiff"),
    "code": (".py", ".js", ".ts", ".java", ".c", ".cpp", ".go", ".rs"),
    "text": (".md", ".markdown", ".txt", ".rst"),
    "config": (".json", ".yaml", ".yml", ".toml", ".xml"),
    "web": (".html", ".htm", ".css"),
}

TERM = r"[\p{L}\p{N}]+"


def category(extension: Column) -> Column:
    found = F.lit("other")
    for name, extensions in CATEGORIES.items():
        found = F.when(F.lower(extension).isin(*extensions), name).otherwise(found)
    return found


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(?<=.)(\.[^.]+)$", 1))


def title(path: Column, given: Column) -> Column:
    return F.coalesce(F.nullif(given, F.lit("")), F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", ""))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), 0)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda x: x != "")).cast("long")


def line_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalise_text(text: Column) -> Column:
    """LF line ends, at most one blank line and one space in a row, no white space at the ends."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), " {2,}", " "))


def compact_date(text: Column) -> Column:
    """``D:YYYYMMDD[HHmmss]`` as ISO text; anything shorter stays as it is."""
    bare = F.regexp_replace(text, "^D:", "")
    cut = lambda a, n: F.substring(bare, a, n)
    day = F.concat_ws("-", cut(1, 4), cut(5, 2), cut(7, 2))
    full = F.concat(day, F.lit("T"), F.concat_ws(":", cut(9, 2), cut(11, 2), cut(13, 2)))
    return F.when(F.length(bare) >= 14, full).when(F.length(bare) >= 8, day).otherwise(bare)


def dms_to_decimal(degrees: Column, minutes: Column, seconds: Column, hemisphere: Column) -> Column:
    value = degrees + minutes / 60 + seconds / 3600
    return F.when(F.upper(hemisphere).isin("S", "W"), -value).otherwise(value)


def tokens_estimate(text: Column, chars_per_token: int) -> Column:
    return (F.length(F.coalesce(text, F.lit(""))) / chars_per_token).cast("long")


def truncate_to_tokens(text: Column, tokens: Column) -> Column:
    return F.when(F.length(text) <= tokens * 4, text).otherwise(F.concat(F.substr(text, F.lit(1), tokens * 4), F.lit("...")))


def preview(text: Column, chars: int = 500) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text)


def fold(values: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(values, start, step)


def dot(a: Column, b: Column) -> Column:
    return fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    gap = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return fold(F.zip_with(a, b, gap), F.lit(0.0), lambda s, x: s + x)


def document_score(distance: Column) -> Column:
    return 1 / (1 + distance)


def chunk_score(distance: Column) -> Column:
    """Falls from 1 to 0 at distance 2 and then goes on from 1/3: the jump is kept on purpose."""
    return F.when(distance <= 2, F.greatest(F.lit(0.0), 1 - distance / 2)).otherwise(1 / (1 + distance))


def normalised_score(score: Column, rank: Column, total: Column) -> Column:
    """A score between 0 and 1 as it is, others as distances; without one, by place (``rank`` from 0 of ``total``)."""
    place = F.when(total <= 1, 1.0).otherwise(1 - rank / total)
    return F.when(score.isNull(), place).when(score.between(0, 1), score).otherwise(1 / (1 + F.abs(score)))


#: Beginnings of words that ask for a summary, and words or phrases that ask for a count or a list.
SUMMARY = ("summar", "résum", "synthès", "synthét", "condens", "abrég", "overview of", "tl dr")
FACTUAL = (
    "how many", "number of", "count", "list", "which files", "which documents", "what files", "do you have", "combien", "liste",
    "énumère", "nombre de", "quels fichiers", "quels documents", "quelles pages", "tu as", "as tu",
)


def intent(prompt: Column, summary: tuple[str, ...] = SUMMARY, factual: tuple[str, ...] = FACTUAL) -> Column:
    """summarize before factual, else rag; the prompt is read as words, without case and punctuation."""
    words = F.concat(F.lit(" "), F.array_join(terms(prompt), " "), F.lit(" "))
    says = lambda signs: reduce(lambda a, b: a | b, (words.contains(x) for x in signs), F.lit(False))
    wishes = F.when(says([f" {x}" for x in summary]), "summarize")
    return wishes.when(says([f" {x} " for x in factual]), "factual").otherwise("rag")


def image_text(name: Column, width: Column, height: Column, kind: Column, date: Column, camera: Column, latitude: Column, longitude: Column) -> Column:
    """Searchable text of an image's tags, a line each; lines of missing tags are left out."""
    line = lambda head, value: F.when(value.isNotNull(), F.concat(F.lit(f"{head}: "), value))
    size = F.concat(width.cast("string"), F.lit("x"), height.cast("string"))
    place = F.format_string("%.6f, %.6f", latitude, longitude)
    place = F.when(latitude.isNotNull() & longitude.isNotNull(), place)
    pairs = (("Image", name), ("Dimensions", size), ("Format", kind), ("Date", date), ("Camera", camera), ("GPS", place))
    return F.concat_ws("\n", *(line(*p) for p in pairs))


def image_details(text: Column, exposure: Column, aperture: Column, iso: Column) -> Column:
    """``image_text`` with lines for exposure, aperture and ISO, as far as they are there."""
    line = lambda head, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(head), value))
    return F.concat_ws("\n", text, line("Exposure: ", exposure), line("Aperture: f/", aperture), line("ISO: ", iso))


def crop(text: Column, term: Column, words: int = 200) -> Column:
    """``words`` words of the text around the first that equals ``term``, or from the start."""
    parts = F.split(F.coalesce(text, F.lit("")), " ")
    at = F.greatest(F.coalesce(F.array_position(parts, term), F.lit(0)) - words // 2, F.lit(1)).cast("int")
    return F.array_join(F.slice(parts, at, F.lit(words)), " ")


def highlight(text: Column, term: str, before: str = "<em>", after: str = "</em>") -> Column:
    """The text with each whole word ``term`` (in any case) between tags. A word ends where no letter or digit
    follows, in any script; the term is taken as it is."""
    quoted = "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{N}}])({quoted})(?![\p{{L}}\p{{N}}])", f"{before}$1{after}")
