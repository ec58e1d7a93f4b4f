"""File kinds: label by suffix, and what the corpus run does with each."""

from __future__ import annotations

# Label of each known suffix.
FILE_LABELS: dict[str, str] = {
    ".pdf": "PDF Document",
    ".docx": "Word Document",
    ".pptx": "PowerPoint Presentation",
    ".xlsx": "Excel Spreadsheet",
    ".csv": "CSV Data File",
    ".png": "PNG Image",
    ".jpg": "JPEG Image",
    ".jpeg": "JPEG Image",
    ".gif": "GIF Image",
    ".bmp": "BMP Image",
    ".webp": "WebP Image",
    ".txt": "Text File",
}
UNKNOWN_LABEL = "Unknown File Type"

# How a file of each cleansed suffix is cut into text units.
CLEANSERS: dict[str, str] = {
    ".png": "image", ".jpg": "image", ".jpeg": "image",
    ".csv": "spreadsheet", ".xlsx": "spreadsheet",
    ".pdf": "pdf", ".pptx": "presentation", ".docx": "document",
}

# Suffixes treated as images by the analysis.
IMAGE_SUFFIXES: tuple[str, ...] = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp")
