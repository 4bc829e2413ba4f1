"""Relations of a program graph, and the ordered confidence of its edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CERTAIN, INFERRED, POSSIBLE = 2, 1, 0
CONFIDENCE = {CERTAIN: "certain", INFERRED: "inferred", POSSIBLE: "possible"}

FILES = "file_id long, path string, language string, content_hash string, size long, mtime_ns long, parse_status string"
SYMBOLS = "symbol_id string, path string, kind string, name string, fqn string, signature string, doc string, start_line int, start_col int, end_line int, end_col int, body_hash string, visibility string, parent_fqn string"
REFS = "path string, kind string, src_fqn string, dst_name string, line int, col int"
EDGES = "kind string, src string, dst string, dst_name string, path string, line long, conf int, resolver string"

IMPACT_KINDS = ("calls", "imports", "inherits", "references")
COMMUNITY_KINDS = ("calls", "imports", "inherits")
CALLABLE_KINDS = ("function", "method", "class")
CLASS_KINDS = ("class", "interface", "struct", "module")
STYLE_KINDS = ("css_class", "html_id")
LOW_INFO_KINDS = ("css_class", "css_id", "html_id", "key", "section", "file")
MOST_CANDIDATES = 5
MAX_FILE_BYTES = 2 * 1024 * 1024


def confidence_name(conf: Column) -> Column:
    return F.when(conf == CERTAIN, "certain").when(conf == INFERRED, "inferred").when(conf == POSSIBLE, "possible")
