"""Fixed dimensions of the data model and its table schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: representation types ---------------------------------------
# rep_type, stage, file name, modality
REP_DIMS = [
    ("source_original", "source", "original", "text"),
    ("canonical_md", "extract", "canonical.md", "text"),
    ("plain_text", "extract", "plain_text.txt", "text"),
    ("layout_json", "extract", "layout.json", "text"),
    ("page_image", "extract", "page_image", "image"),
    ("vlm_md", "recognize", "vlm.md", "text"),
    ("ocr_text", "recognize", "ocr.md", "text"),
    ("transcript", "recognize", "transcript.md", "text"),
    ("audio_segment", "recognize", "audio_segment", "audio"),
    ("graph_json", "compile", "graph.json", "text"),
    ("mind_map", "compile", "mind_map.json", "text"),
    ("summary", "compile", "summary.md", "text"),
    ("wiki_md", "compile", "wiki.md", "text"),
    ("table_md", "compile", "table.md", "table"),
    ("table_json", "compile", "table.json", "table"),
    ("table_parquet", "compile", "table.parquet", "table"),
]

# --- fixed values: lineage depth of a stage -----------------------------------
STAGE_DEPTH = {"source": 0, "extract": 1, "recognize": 2, "compile": 3}

# --- fixed values: built-in lineage steps --------------------------------------
# step, input format, output format, index mode, input rep, output rep
LINEAGE_STEPS = [
    ("md_passthru", "md", "md", "text", "source_original", "canonical_md"),
    ("word_to_pdf", "docx", "pdf", "text", "source_original", "rep_pdf"),
    ("pdf_to_png", "pdf", "png", None, "rep_pdf", "page_image"),
    ("png_to_md", "png", "md", "text", "page_image", "canonical_md"),
]

# --- fixed values: file extensions by format -----------------------------------
FORMAT_EXTENSIONS = {
    "md": (".md", ".markdown", ".txt", ".html"),
    "docx": (".docx", ".doc", ".pptx", ".ppt"),
    "pdf": (".pdf",),
    "png": (".png", ".jpg", ".jpeg", ".tiff", ".bmp", ".gif", ".webp", ".svg", ".heic", ".avif"),
    "audio": (".wav", ".mp3", ".flac", ".ogg", ".m4a", ".opus"),
    "video": (".mp4", ".avi", ".mov", ".mkv", ".webm", ".flv", ".wmv"),
    "table": (".csv", ".tsv", ".xlsx", ".xls", ".parquet", ".json"),
}

# --- fixed values: entity type by format, and extensions without a format --------
FORMAT_ENTITY_TYPE = {
    "md": "document", "docx": "document", "pdf": "document", "png": "image",
    "audio": "audio", "video": "video", "table": "table",
}
UNFORMATTED_DOCUMENTS = (".wps", ".wpt", ".dps", ".dpt")

# --- fixed values: required reps, text reps, virtual names ------------------------
REQUIRED_REPS = ["source_original", "canonical_md"]
TEXT_REPS = ["source_original", "canonical_md"]
VIRTUAL_NAMES = {"source_original": "original", "canonical_md": "canonical.md"}

CHUNK_SCHEMA = (
    "entity_id string, rep_name string, chunk_index bigint, text string, "
    "embedding array<float>, metadata string, embedding_text string"
)
VERSION_LOG_SCHEMA = (
    "workspace_id string, collection_id string, entity_id string, version int, content_hash string, "
    "timestamp string, trigger string"
)
MANIFEST_SCHEMA = (
    "entity_id string, workspace_id string, collection_id string, entity_type string, name string, "
    "source_type string, source_uri string, content_hash string, version int, status string, "
    "labels array<string>, model_version string, created_at string, updated_at string, "
    "rep_info map<string, struct<rep_type: string, status: string, modality: string>>"
)
ENTITY_COLUMNS = [
    "workspace_id", "collection_id", "entity_id", "entity_type", "name", "source_type", "source_uri",
    "content_hash", "version", "status", "labels", "model_version", "created_at", "updated_at",
]


def rep_dims(spark: SparkSession) -> DataFrame:
    """The representation dimension; 16 rows, safe to broadcast."""
    rows = [
        (rep, stage, name, f"{stage}/{name}", STAGE_DEPTH[stage], modality)
        for rep, stage, name, modality in REP_DIMS
    ]
    return spark.createDataFrame(
        rows, "rep_type string, stage string, file_name string, relpath string, depth int, modality string"
    )


def lineage_rules(spark: SparkSession) -> DataFrame:
    """The built-in lineage edges; a handful of rows."""
    return spark.createDataFrame(
        LINEAGE_STEPS,
        "step string, input_format string, output_format string, index_mode string, "
        "input_rep string, output_rep string",
    )


def ext_routes(spark: SparkSession) -> DataFrame:
    """Extension to format and entity type; about fifty rows."""
    rows = [
        (ext, fmt, FORMAT_ENTITY_TYPE[fmt])
        for fmt, exts in FORMAT_EXTENSIONS.items()
        for ext in exts
    ]
    rows += [(ext, None, "document") for ext in UNFORMATTED_DOCUMENTS]
    return spark.createDataFrame(rows, "ext string, format string, entity_type string")
