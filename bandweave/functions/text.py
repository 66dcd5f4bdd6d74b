"""Text and name functions as column expressions."""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from bandweave.functions.draws import choice

# Words of the drawn caption.
ADJECTIVES = (
    "a simple",
    "an interesting",
    "a strange",
    "a freshly captured",
    "a sample",
    "an example",
    "a new",
    "an archive",
    "a cover",
)
NOUNS = ("photo", "frame", "image")
PLACES = ("archive", "newspaper", "magazine", "journal", "webpage", "wallpaper", "wall", "flayer")

# Fixed value: pre-token pattern, matched without case: markers, contractions, letter runs, single digits, other runs.
PRETOKEN = r"<\|startoftext\|>|<\|endoftext\|>|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def key_from_path(path: Column) -> Column:
    """Integer base name of an .npz path."""
    return F.regexp_extract(path, r"(\d+)\.npz$", 1).cast("bigint")


def parse_artefact(name: Column) -> dict[str, Column]:
    """Parameters held in a model file name, and the name part after its first four words."""
    stem = F.element_at(F.split(name, r"\."), 1)
    words = F.split(stem, "_")

    def number(key: str) -> Column:
        found = F.regexp_extract(name, key + r"=(\d+)", 1)
        return F.when(found != "", found.cast("bigint"))

    return {
        "target": F.regexp_extract(name, r"ix=\[(\d+)\]", 1).cast("int"),
        "trees": number("nest"),
        "depth": number("maxd"),
        "leaf": number("minsl"),
        "label": F.array_join(F.slice(words, F.lit(5), F.size(words)), "_"),
    }


# Fixed values below: the wording of both captions.
def caption(label: Column, seed: int, *key) -> Column:
    return F.format_string(
        "This is %s %s of the %s from the %s",
        choice(seed, ADJECTIVES, *key, "adjective"),
        choice(seed, NOUNS, *key, "noun"),
        label,
        choice(seed, PLACES, *key, "place"),
    )


def plain_caption(label: Column) -> Column:
    return F.concat(F.lit("This is a photo of the "), label)


@F.arrow_udf(StringType())
def unescape_twice(texts: pa.Array) -> pa.Array:
    """HTML entities by the standard library's table; Spark has no function for it."""
    return pa.array([None if s is None else html.unescape(html.unescape(s)) for s in texts.to_pylist()], pa.string())


def clean_text(text: Column) -> Column:
    """Unescape HTML twice, collapse whitespace, trim, lower."""
    marked = unescape_twice(F.when(F.instr(text, "&") > 0, text))  # only texts with a mark reach Python
    spaced = F.regexp_replace(F.coalesce(marked, text), r"(?U)\s+", " ")
    return F.lower(F.trim(spaced))


def pretokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?i)" + PRETOKEN), 0)


def run_id(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmm")
