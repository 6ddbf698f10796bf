"""Explicit schemas of the engine's records. An absent key is a null."""

from __future__ import annotations

from pyspark.sql import types as T

_PLAIN = {"string": T.StringType, "int": T.IntegerType, "long": T.LongType, "double": T.DoubleType, "boolean": T.BooleanType, "timestamp_ntz": T.TimestampNTZType, "binary": T.BinaryType}


def _parts(s: str) -> list[str]:
    """s cut at the commas outside angle brackets."""
    out, depth = [""], 0
    for c in s:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out if x.strip()]


def _kind(s: str) -> T.DataType:
    if s.startswith("array<"):
        return T.ArrayType(_kind(s[6:-1]))
    if s.startswith("struct<"):
        return T.StructType([T.StructField(n, _kind(k)) for n, k in (x.split(":", 1) for x in _parts(s[7:-1]))])
    return _PLAIN[s]()


def schema(text: str) -> T.StructType:
    """A schema from `name type, ...`, without a session: modules can be imported before there is one."""
    return T.StructType([T.StructField(n, _kind(k.strip())) for n, k in (x.split(" ", 1) for x in _parts(text))])


BOX = schema("x0 double, y0 double, x1 double, y1 double")
TEXT_ELEMENT = schema("text string, x double, y double")
IMAGE_ELEMENT = schema("name string, bbox struct<x0:double,y0:double,x1:double,y1:double>")
PAGE_REPORT = schema("pdf_name string, page int, mediabox struct<x0:double,y0:double,x1:double,y1:double>, text_elements array<struct<text:string,x:double,y:double>>, image_elements array<struct<name:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>")
RESPONSE = schema("primary_language string, is_rotation_valid boolean, rotation_correction int, is_table boolean, is_diagram boolean, natural_text string")
PAGE_RESULT = T.StructType([*schema("page int").fields, *RESPONSE.fields, *schema("error string").fields])
USAGE = schema("prompt_tokens int, completion_tokens int, total_tokens int, cost double, provider string")
HTML_PAGE = schema("html string, page int, source string, width int, height int, usage struct<prompt_tokens:int,completion_tokens:int,total_tokens:int,cost:double,provider:string>, elapsed double")
YAML_PAGE = schema("yaml string, page int, source string, width int, height int, is_scanned boolean, document_id string, usage struct<prompt_tokens:int,completion_tokens:int,total_tokens:int,cost:double,provider:string>, elapsed double")
PAGE_TEST = schema("id string, type string, pdf string, page int, text string, max_diffs int, cell string, up string, down string, left string, right string, top_heading string, before string, after string, latex string, format_type string")
TEST_RESULT = schema("id string, type string, passed boolean, error string")
SFT_LINE = schema("messages array<struct<role:string,content:string>>, metadata struct<source:string,page:int,html_source:string,yaml_source:string,generated_by:string,primary_language:string,is_table:boolean,is_diagram:boolean>")
RLVR = schema("image string, prompt string, tests string, pdf_name string, page_num int")
TRANSLATION = schema("document_id string, primary_language string, is_rotation_valid boolean, rotation_correction int, is_table boolean, is_diagram boolean, sentences array<struct<id:int,text:string>>, tables array<struct<table_id:int,headers:array<string>,rows:array<array<string>>>>")
DEAD_LETTER = schema("ts timestamp_ntz, pdf_name string, page int, reason string")
LOG_EVENT = schema("ts timestamp_ntz, kind string, pdf_name string, page int, chars int, seconds double, prompt int, completion int, total int, provider string")
