"""PDF files as a data source of dumped pages, where a glyph extractor is installed (it isn't needed for anything else)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.documents import read_uploads
from quillspark.operators.parse import PAGES

try:
    import fitz
except ImportError:
    fitz = None


def available() -> bool:
    return fitz is not None


def dump(doc_id: int, content: bytes) -> list[dict]:
    """The pages of a PDF in the form of PAGES."""
    out = []
    with fitz.open(stream=content, filetype="pdf") as doc:
        for i, page in enumerate(doc):
            blocks = [{"kind": b["type"], "bbox": list(b["bbox"]), "lines": [{"bbox": list(x["bbox"]), "spans": [{"text": s["text"], "size": s["size"], "font": s["font"], "flags": s["flags"] & 1, "y": s["origin"][1]} for s in x["spans"]]} for x in b.get("lines", [])]} for b in page.get_text("dict")["blocks"]]
            out.append({"doc_id": doc_id, "page": i + 1, "width": page.rect.width, "height": page.rect.height, "blocks": blocks, "images": [list(x["bbox"]) for x in page.get_image_info()], "art": []})
    return out


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """Dumped pages of all PDFs of a folder; ids are hashes of the files' paths."""
    if not available():
        raise RuntimeError("no glyph extractor is installed; read dumped pages with read_pages()")
    files = read_uploads(spark, path).select(F.xxhash64("path").alias("doc_id"), "content")

    def run(batches):
        import pandas as pd

        for frame in batches:
            for doc_id, content in zip(frame["doc_id"], frame["content"], strict=True):
                yield pd.DataFrame(dump(doc_id, content))

    return files.mapInPandas(run, PAGES)
