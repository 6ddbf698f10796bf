"""Rule-based sentence splitting as one chain of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, is_blank, strip

# Abbreviations whose full stop doesn't end a sentence; they match anywhere, inside words too.
ABBREVIATIONS = ("Mr.", "Mrs.", "Ms.", "Dr.", "Hon.", "No.", "vs.", "Ltd.", "Inc.", "Jr.", "Sr.", "Vol.", "Art.", "Sec.", "Para.", "v.", "pp.", "Fig.", "approx.", "est.", "etc.", "Ors.", "Anr.", "Govt.", "Pvt.", "Assn.", "Commr.", "Admn.", "Crl.", "Cr.", "Dist.", "Ref.", "e.g.", "i.e.")
#: A full stop that doesn't end a sentence.
DOT = "\ue001"

_ONE = "|".join(a[:-1] for a in ABBREVIATIONS if a.count(".") == 1)
#: Full stops of abbreviations, of single capitals and of `p.` before a number. Each begins with the full stop and looks
#: back from there, so that other characters are passed over at once.
_INNER = (
    rf"(?<=(?:{_ONE})\.)",
    r"(?<=e\.)(?=g\.)|(?<=e\.g\.)|(?<=i\.)(?=e\.(?!g\.))|(?<=i\.e\.)",
    rf"(?<=(?:^|{WS}|[\"'(,])[A-Z]\.)",
    rf"(?<=(?<![\p{{L}}\p{{N}}_])p\.)(?={WS}*\d)",
)
#: Names with such a full stop don't begin a sentence.
_NAME = rf"(?:{_ONE}|[A-Z]){DOT}"


def protect(c: Column) -> Column:
    """The text with DOT for those full stops."""
    return F.regexp_replace(c, rf"\.(?:{'|'.join(_INNER)})", DOT)


def restore(c: Column) -> Column:
    return F.replace(c, F.lit(DOT), F.lit("."))


def split_sentences(c: Column) -> Column:
    """array<string> of the sentences of a text: split at white space after . ! ? and before an ASCII capital, a double
    quote or an opening bracket. Blank texts, null and the word null have none."""
    parts = F.split(protect(c), rf"(?<=[.!?]){WS}+(?=[A-Z\"(])(?!{_NAME})")
    done = F.filter(F.transform(parts, lambda p: strip(restore(p))), lambda p: p != "")
    return F.when(is_blank(c), F.array().cast("array<string>")).otherwise(done)


def numbered(c: Column) -> Column:
    """array<struct<id,text>> with ids from 1."""
    return F.transform(split_sentences(c), lambda s, i: F.struct((i + 1).cast("int").alias("id"), s.alias("text")))
