"""Column layouts of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

POSITION = T.StructType([
    T.StructField("page_idx", T.IntegerType()),
    T.StructField("x0", T.DoubleType()),
    T.StructField("y0", T.DoubleType()),
    T.StructField("x1", T.DoubleType()),
    T.StructField("y1", T.DoubleType()),
])
POSITIONS = T.ArrayType(POSITION)
POSITIONS_DDL = "array<struct<page_idx:int,x0:double,y0:double,x1:double,y1:double>>"

# One item of a layout-block list as it stands in JSON; missing keys read as null.
BLOCK_ITEM_DDL = ("array<struct<type:string,text:string,list_items:array<string>,image_caption:array<string>,"
                  "table_caption:array<string>,table_body:string,img_path:string,page_idx:int,bbox:array<double>>>")
BLOCK_COLUMNS = ["doc_id", "block_idx", "type", "text", "list_items", "image_caption", "table_caption",
                 "table_body", "img_path", "page_idx", "bbox"]

PARSE_DETAIL_DDL = ("struct<pdf_info:array<struct<para_blocks:array<struct<lines:array<struct<"
                    "spans:array<struct<score:double>>>>>>>>>")

NODE_COLUMNS = ["doc_id", "node_idx", "node_id", "parent_idx", "level", "structure", "title", "start_index",
                "end_index", "summary", "original_text", "positions"]

CLAUSE_COLUMNS = ["task_id", "matrix_id", "section_id", "section_title", "page_number", "type", "actor", "action",
                  "object", "condition", "deadline", "metric", "original_text", "image_caption", "table_caption",
                  "img_path", "positions"]

# One row of a model answer holding clauses.
CLAUSE_ITEM_DDL = ("array<struct<matrix_id:string,section_id:string,section_title:string,page_number:int,type:string,"
                   "actor:string,action:string,object:string,condition:string,deadline:string,metric:string,"
                   "original_text:string,image_caption:string,table_caption:string,img_path:string>>")

# The clause types and the task states.
CLAUSE_TYPES = ("obligation", "requirement", "prohibition", "deliverable", "deadline", "penalty", "definition")
TASK_STATES = ("pending", "running", "completed", "failed")
DEFAULT_CLAUSE_TYPE = "requirement"
UNKNOWN_NODE = "UNKNOWN"

# Columns a task update may touch; other names are ignored.
TASK_FIELDS = ("file_name", "file_size", "file_hash", "status", "progress", "current_message", "error_message",
               "total_sections", "total_clauses", "document_tree_json", "quality_report_json", "started_at",
               "completed_at", "elapsed_seconds")
