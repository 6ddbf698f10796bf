"""Text columns: normalisation, keys, clean-up, script detection, prompts. All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip and re see it (fixed values).
SPACES = r" \t\n\x0B\f\r\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS = f"[{SPACES}]"
#: The same as plain characters, and what a run of white space needs to be more than one space.
_CHARS = "".join(chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
#: Most characters are in one of three ranges, which are asked before the many members of the class.
_RUN = f" {{2}}{WS}*| ?[[^ -~\\xA1-\\x{{167F}}\\x{{3001}}-\\x{{10FFFF}}]&&[{SPACES[1:]}]]{WS}*"


def strip(c: Column) -> Column:
    """Unicode white space off both ends."""
    return F.btrim(c, F.lit(_CHARS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(_CHARS))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(_CHARS))


def normalize_text(c: Column) -> Column:
    """Lower case, ends stripped, white space runs as one space. Punctuation stays."""
    return F.regexp_replace(strip(F.lower(c)), _RUN, " ")


def squeeze(c: Column) -> Column:
    """Lower case without any white space: how formulas are compared."""
    return F.lower(F.regexp_replace(c, WS, ""))


PAGE_KEY = r"(?s)^(.+)_page_(\d+)$"


def page_key(stem: Column, fallback: bool = False) -> Column:
    """struct<pdf_name,page> of a file stem; the last `_page_N` counts. A stem without one is null, or with `fallback` page 1 of itself."""
    other = F.struct(stem.alias("pdf_name"), F.lit(1).alias("page")) if fallback else F.lit(None)
    return F.when(stem.rlike(PAGE_KEY), F.struct(F.regexp_extract(stem, PAGE_KEY, 1).alias("pdf_name"), F.regexp_extract(stem, PAGE_KEY, 2).try_cast("int").alias("page"))).otherwise(other)


def file_stem(path: Column) -> Column:
    """The last path part without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def strip_pdf(c: Column) -> Column:
    """A trailing `.pdf` in any case: one rule for every place that names sources."""
    return F.regexp_replace(c, r"(?i)\.pdf$", "")


def doc_tag(c: Column) -> Column:
    """What follows the last tilde."""
    return F.substring_index(c, "~", -1)


def clean_anchor(c: Column, most: int = 250) -> Column:
    """An element's text on one line: stripped, brackets and line controls escaped, long ones as head ... tail cut at spaces."""
    x = strip(c)
    for raw, shown in (("[", r"\["), ("]", r"\]"), ("\n", r"\n"), ("\r", r"\r"), ("\t", r"\t")):
        x = F.replace(x, F.lit(raw), F.lit(shown))
    half = most // 2 - 3

    def cut(x: Column) -> Column:
        start, end = F.left(x, F.lit(half)), F.right(x, F.lit(half))
        head = F.regexp_extract(start, r"(?s)^(.*) [^ ]*$", 1)
        tail = F.regexp_extract(end, r"(?s)^[^ ]* (.*)$", 1)
        head = F.when(F.contains(start, F.lit(" ")) & (head != ""), head).otherwise(start)
        tail = F.when(F.contains(end, F.lit(" ")) & (tail != ""), tail).otherwise(end)
        return F.when(F.length(x) > most, F.concat(head, F.lit(" ... "), tail)).otherwise(x)

    return F.get(F.transform(F.array(x), cut), F.lit(0))  # the escaped text is made once, however often it is named


def detect_script(c: Column) -> Column:
    """bn or hi where over a tenth of the code points are of that script (Bengali first), else en."""
    n = F.length(c)
    share = lambda s: F.length(F.regexp_replace(c, f"[^{s}]", "")) / n
    return F.when((c.isNull()) | (n == 0), "en").when(share(r"\x{0980}-\x{09FF}") > 0.1, "bn").when(share(r"\x{0900}-\x{097F}") > 0.1, "hi").otherwise("en")


def clip(c: Column, most: int) -> Column:
    """The first `most` code points."""
    return F.substring(c, 1, most)


def allowed_diffs(c: Column) -> Column:
    """Edits that a presence test allows: 2 percent of its text, 3 at least."""
    return F.greatest(F.lit(3), F.floor(F.length(c) / 50).cast("int"))


def build_prompt(anchor: Column, template: str) -> Column:
    """The template, with the anchor text between its markers where there is one."""
    return F.when(anchor.isNull(), F.lit(template)).otherwise(F.concat(F.lit(f"{template}\n\n<|anchor_start|>\n"), anchor, F.lit("\n<|anchor_end|>")))


def is_blank(c: Column) -> Column:
    """Null, empty, or the word null."""
    return c.isNull() | (c == "") | c.rlike(rf"(?i)\A{WS}*null{WS}*\z")


def scanned_page(anchor: Column, elements_only: bool = True) -> Column:
    """Whether an anchor text says so little that the page is a scan: under 20 characters. With elements_only its first
    line, which only names the page's dimensions and alone is longer, doesn't count."""
    x = F.regexp_replace(anchor, r"^Page dimensions: [^\n]*\n?", "") if elements_only else anchor
    return F.length(strip(x)) < 20


def stable_order(*parts: Column | str, seed: int = 42) -> Column:
    """A reproducible random sort key: md5 of the seed and the parts, equal in any engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]).cast("binary"))
