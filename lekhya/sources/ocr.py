"""Scanned files as a source: dispatch on the extension, pluggable OCR providers, pages and documents.

No OCR library is needed to import this module; a provider that is not registered raises when used, never falls back
to made-up data.
"""

from __future__ import annotations

import importlib.util
import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lekhya.session import nonempty

IMAGES, DOCUMENTS = (".png", ".jpg", ".jpeg", ".tiff", ".bmp"), (".pdf",)
PAGES = "file_path string, page_number int, text string, confidence double, backend string"
#: name -> function(bytes, extension) yielding (page_number, text, confidence)
PROVIDERS: dict[str, Callable[[bytes, str], Iterator[tuple[int, str, float]]]] = {}


def register(name: str, provider: Callable) -> None:
    PROVIDERS[name.lower()] = provider


def plain_text(data: bytes, extension: str) -> Iterator[tuple[int, str, float]]:
    """Text files with form feeds between pages; for tests and born-digital text."""
    for k, page in enumerate(data.decode("utf-8", "replace").split("\f")):
        yield k + 1, page, 1.0


register("text", plain_text)


def rasterised(data: bytes, extension: str, dpi: int = 200) -> Iterator:
    """The images of a file: one of an image, those of the pages of a PDF, with whichever renderer is installed."""
    if extension not in DOCUMENTS:
        from PIL import Image

        yield Image.open(io.BytesIO(data))
        return
    try:
        from pdf2image import convert_from_bytes
    except ImportError:
        try:
            import fitz
        except ImportError:
            raise RuntimeError("a PDF renderer is needed: pdf2image or PyMuPDF") from None
        from PIL import Image

        for page in fitz.open(stream=data, filetype="pdf"):
            shot = page.get_pixmap(dpi=dpi)
            yield Image.frombytes("RGB", (shot.width, shot.height), shot.samples)
        return
    yield from convert_from_bytes(data, dpi=dpi)


def mean_word_confidence(confidences: list[float]) -> float:
    """The mean of the confidences above zero, as a share; 0 without any."""
    good = [float(c) for c in confidences if float(c) > 0]
    return sum(good) / len(good) / 100 if good else 0.0


def tesseract(data: bytes, extension: str) -> Iterator[tuple[int, str, float]]:
    import pytesseract

    for k, image in enumerate(rasterised(data, extension)):
        words = pytesseract.image_to_data(image, output_type=pytesseract.Output.DICT)
        yield k + 1, pytesseract.image_to_string(image), mean_word_confidence(words["conf"])


def easyocr(data: bytes, extension: str, languages: tuple[str, ...] = ("en",)) -> Iterator[tuple[int, str, float]]:
    import easyocr as library
    import numpy as np

    reader = library.Reader(list(languages))
    for k, image in enumerate(rasterised(data, extension)):
        found = reader.readtext(np.asarray(image.convert("RGB")))
        yield k + 1, " ".join(f[1] for f in found), sum(f[2] for f in found) / len(found) if found else 0.0


def remote(ask: Callable[[bytes], str], confidence: float = 0.95) -> Callable[[bytes, str], Iterator[tuple[int, str, float]]]:
    """A provider that sends each page image, as PNG, to a service; every answer has the same confidence, a failure none."""

    def provider(data: bytes, extension: str) -> Iterator[tuple[int, str, float]]:
        for k, image in enumerate(rasterised(data, extension)):
            png = io.BytesIO()
            image.save(png, format="PNG")
            try:
                yield k + 1, ask(png.getvalue()), confidence
            except Exception:
                yield k + 1, "", 0.0

    return provider


def backend_of(name: str) -> str:
    """The provider that serves a backend name: its own if it is registered or known, any other name means easyocr. One whose library is missing is an error."""
    name = name.lower()
    if name in PROVIDERS:
        return name
    library = {"tesseract": "pytesseract"}.get(name, "easyocr")
    if name == "remote" or importlib.util.find_spec(library) is None:
        raise ValueError(f"OCR provider {name!r} is not registered and {library} is not installed; known: {sorted(PROVIDERS)}")
    register("tesseract" if library == "pytesseract" else "easyocr", tesseract if library == "pytesseract" else easyocr)
    return "tesseract" if library == "pytesseract" else "easyocr"


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file_path, extension, content); extensions are lower-cased."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    df = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return df.select(F.col("path").alias("file_path"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("extension"), "content")


def checked(files: DataFrame, allowed: tuple[str, ...] = IMAGES + DOCUMENTS) -> DataFrame:
    """The files, an error on the first with another extension."""
    bad = F.concat(F.lit("unsupported file type: "), F.col("extension"))
    return files.withColumn("extension", F.when(F.col("extension").isin(*allowed), F.col("extension")).otherwise(F.raise_error(bad).cast("string")))


def process(files: DataFrame, backend: str = "text") -> DataFrame:
    """Pages of files by a registered provider; a failing page is (\"\", 0.0), a missing provider is an error."""
    provider = PROVIDERS[backend_of(backend)]

    @nonempty
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, ext, content in zip(b["file_path"], b["extension"], b["content"]):
                try:
                    rows += [(path, n, t, c, backend) for n, t, c in provider(bytes(content), ext)]
                except Exception:
                    rows.append((path, 1, "", 0.0, backend))
            yield pd.DataFrame(rows, columns=["file_path", "page_number", "text", "confidence", "backend"])

    return files.mapInPandas(run, PAGES)


def extracted(files: DataFrame, backend: str = "text") -> DataFrame:
    """(file_path, text, confidence, total_pages, pages): one row per file, its pages nested. The text of an image has no page marker."""
    pages = process(files, backend)
    whole = assemble(pages, "file_path")
    nested = pages.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("page_number", "text", "confidence"))).alias("pages"))
    image = F.lower(F.regexp_extract("file_path", r"(\.[^./]+)$", 1)).isin(*IMAGES)
    text = F.when(image, F.col("pages")[0]["text"]).otherwise(F.col("full_text"))
    return whole.join(nested, "file_path").select("file_path", text.alias("text"), F.col("avg_confidence").alias("confidence"), "total_pages", "pages")


def assemble(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, full_text, avg_confidence, total_pages): pages joined in page order behind their markers; the mean counts failed pages."""
    p = pages.select(key, "page_number", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence")).distinct()
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    joined = F.array_join(F.transform(ordered, lambda x: F.concat(F.lit("--- Page "), x["page_number"].cast("string"), F.lit(" ---\n"), x["text"])), "\n\n")
    return p.groupBy(key).agg(joined.alias("full_text"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"), F.count("*").cast("int").alias("total_pages"))


def word_confidence(pages: DataFrame, key: str = "doc_id", backend: str = "tesseract") -> DataFrame:
    """(key, confidence): mean of the confidences above zero of one backend, 0.0 without any."""
    p = pages.filter(F.lower("backend") == backend).distinct()
    return p.groupBy(key).agg(F.coalesce(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), F.lit(0.0)).alias("confidence"))
