"""Constants and schemas of the layout engine. Every order has a total tiebreak, every page key is (doc_id, page_no)."""

from __future__ import annotations

from pyspark.sql import types as T

FULL_WIDTH, LEFT_EDGE = 0.92, 0.08
COLUMN_GAP, MIN_REGIONS, MIN_SIDE = 0.03, 4, 2
LINE_GAP, GUTTER_GAP, GUTTER_TOLERANCE, MIN_CLUSTER = 0.01, 0.03, 0.02, 3
GARBLED_MIN, GARBLED_PERCENT, GARBLED_ITEMS = 50, 20, 4000
DEEP_PAGES, DEEP_PERCENT = 3, 20
FURNITURE_RATIO, FURNITURE_MIN = 0.6, 3
TITLE_MAX, HINT_MAX = 60, 40
PARAGRAPH_FACTOR, PARAGRAPH_FLOOR, PARAGRAPH_DEFAULT = 1.5, 8.0, 20.0
VERTICAL_RATIO, VERTICAL_WIDTH, VERTICAL_TOLERANCE, VERTICAL_FLOOR = 2.5, 0.4, 1.5, 6.0
GRID_GAP, GRID_COLUMN, GRID_COLUMN_FLOOR, GRID_OUTLIERS = 0.012, 0.02, 10.0, 30
ROW_FLOOR, ROW_CEILING, PITCH_DEFAULT, HEIGHT_DEFAULT = 4.0, 0.3, 12.0, 10.0
SPAN_FACTOR, PITCH_FLOOR = 1.5, 4.0
IMAGE_REGIONS, IMAGE_FILL = 4, 50
PROSE_LENGTH, PROSE_TENTHS = 15, 6
OFD_TEXT_MIN = 5
WATERMARK_DEGREES = 12.0
CONFIDENCE = 0.6
DPI, DPI_SIDE = 100, 12

NOISE_TYPES = ("header", "header_image", "footer", "footer_image", "number", "seal")
TITLE_TYPES = ("doc_title", "paragraph_title")
MARGIN_TYPES = ("header", "header_image", "footer", "footer_image")
TIERS = ("tiny", "small", "medium")
KINDS = ("pdf", "ofd", "other")
SUPPORTED = ("pdf", "ofd", "docx", "doc", "xlsx", "xls", "pptx", "ppt")
HEADER_WORDS = tuple("备注 标准 编号 代号 单位 数量 类型 类别 名称 说明 内容 条款 项目 序号".split())

#: kind of error: (text shown, advice)
ERRORS = {
    "io": ("io error", "can't read or write: check the path, the permissions and the disk"),
    "encrypted": ("encrypted", "the document needs a password"),
    "malformed": ("malformed document", "the document is damaged: check that it is whole"),
    "missingPart": ("missing part", "the document lacks a part that it must have"),
    "resourceLimit": ("resource limit exceeded", "the document is larger than the limits allow"),
    "unsupported": ("unsupported", "no parser for this format"),
    "runtime": ("runtime", "no recognition engine, or it failed: check its set-up"),
}
NO_HINT = "unknown error: see its detail"
STAGES = ("detect", "extract", "render", "ocr", "assemble", "convert", "output")

ERROR = T.StructType([T.StructField(n, t, True) for n, t in (("kind", T.StringType()), ("stage", T.StringType()), ("page", T.IntegerType()), ("detail", T.StringType()))])
REGION = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("page_no", T.IntegerType()),
        T.StructField("region_idx", T.IntegerType()),
        T.StructField("x_min", T.FloatType()),
        T.StructField("x_max", T.FloatType()),
        T.StructField("y_min", T.FloatType()),
        T.StructField("y_max", T.FloatType()),
        T.StructField("text", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("confidence", T.FloatType()),
    ]
)
MODEL_SPEC = "tier string, det string, rec string, next string"
MODELS = [("tiny", "det_tiny", "rec_tiny", "small"), ("small", "det_small", "rec_small", "medium"), ("medium", "det_medium", "rec_medium", None)]
