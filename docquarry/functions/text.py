"""Text operators of indexing and assembly, as column functions. Lengths are bytes throughout."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

MAX_CHUNK = 1500
MIN_CHUNK = 50
SNIPPET = 200


@pandas_udf(StringType())
def sanitize_utf8(raw: pd.Series) -> pd.Series:
    """Bytes to text: invalid bytes go, a genuine U+FFFD stays. (The built-in decoders substitute or fail instead.)"""
    return raw.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


#: White space of any kind: what Unicode calls so.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim(text: Column) -> Column:
    """Without white space of any kind (Unicode) at both ends."""
    return F.btrim(text, F.lit(WHITE))


def _starts(line: Column, *prefixes: str) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(line, F.lit(p))
    return out


# Markers of metadata and navigation lines.
METADATA = ("---", "layout:", "title:", "parent:", "nav_order:")
NAVIGATION_IN = ("[Edit this page]", "Table of contents")
NAVIGATION_AT = ("Created by", "last modified")


def is_noise(trimmed: Column) -> Column:
    out = _starts(trimmed, *METADATA, *NAVIGATION_AT)
    for part in NAVIGATION_IN:
        out = out | F.contains(trimmed, F.lit(part))
    return out


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body uses it."""
    return F.transform(F.array(value), body).getItem(0)


def drop_noise_lines(text: Column) -> Column:
    """Without metadata and navigation lines, and without breadcrumbs (numbered links) before the first header.

    Each line is trimmed once and travels with its trimmed form.
    """
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.struct(x.alias("x"), trim(x).alias("t")))
    lines = F.filter(lines, lambda x: ~is_noise(x["t"]))
    crumb = lambda t: F.substring(t, 1, 1).between("0", "9") & F.contains(t, F.lit("[")) & F.contains(t, F.lit("]("))
    keep = lambda ls, header: F.array_join(F.transform(F.filter(ls, lambda x, i: ~(((header == 0) | (i + 1 < header)) & crumb(x["t"]))), lambda x: x["x"]), "\n")
    return _let(lines, lambda ls: _let(F.array_position(F.transform(ls, lambda x: F.startswith(x["t"], F.lit("#"))), True), lambda header: keep(ls, header)))


def strip_images(text: Column) -> Column:
    """Without image references, to a fixpoint: removing one can make another.

    A round takes all that stand alone; a text that still holds one goes through a fold over as many rounds as it has
    openings. Texts without an opening are left as they are.
    """
    once = lambda x: F.regexp_replace(x, r"!\[[^)]*\)", "")
    openings = lambda o: F.filter(F.split(o, ""), lambda c: c == "!")
    folded = lambda o: F.when(o.rlike(r"!\[[^)]*\)"), F.aggregate(openings(o), o, lambda x, _: once(x))).otherwise(o)
    return F.when(F.contains(text, F.lit("![")), _let(once(text), folded)).otherwise(text)


def strip_links(text: Column) -> Column:
    """[text](url) becomes text."""
    return F.when(F.contains(text, F.lit("](")), F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1")).otherwise(text)


def clean_markdown(text: Column) -> Column:
    return _let(drop_noise_lines(text), lambda lines: _let(strip_images(lines), lambda plain: trim(strip_links(plain))))


#: Closed chunks that a fold copies at once; more are moved on to an outer array, so that long files stay near linear.
_GROUP = 256


def chunk_by_headers(text: Column, most: int = MAX_CHUNK) -> Column:
    """Array of chunks: a fold over the lines. A second-level header starts a new chunk if the open one would outgrow
    `most` bytes; a chunk that outgrows it closes; a line is never split."""
    none = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<array<string>>").alias("groups"), none.alias("chunks"), none.alias("open"), F.lit(0).alias("size"))

    def close(s, parts, opened, size):
        """The fold's state with the chunk of these lines closed."""
        chunks = F.concat(s["chunks"], F.array(F.array_join(parts, "\n")))
        full = F.size(s["chunks"]) >= _GROUP - 1
        return F.struct(F.when(full, F.concat(s["groups"], F.array(chunks))).otherwise(s["groups"]).alias("groups"), F.when(full, none).otherwise(chunks).alias("chunks"), opened.alias("open"), size.alias("size"))

    def step(s, line):
        n = F.octet_length(line)
        fresh = (s["size"] > 0) & (s["size"] + n > most) & F.startswith(trim(line), F.lit("##"))
        grown = s["size"] + n + 1
        more = F.concat(s["open"], F.array(line))
        return (
            F.when(fresh, close(s, s["open"], F.array(line), n))
            .when(grown > most, close(s, more, none, F.lit(0)))
            .otherwise(F.struct(s["groups"].alias("groups"), s["chunks"].alias("chunks"), more.alias("open"), grown.alias("size")))
        )

    def finish(s):
        last = F.when(F.size(s["open"]) > 0, F.array(F.array_join(s["open"], "\n"))).otherwise(none)
        return F.concat(F.flatten(s["groups"]), s["chunks"], last)

    return F.aggregate(F.split(text, "\n", -1), start, step, finish)


def kept_chunks(chunks: Column, least: int = MIN_CHUNK) -> Column:
    """Trimmed chunks of at least `least` bytes; those dropped use up no index."""
    return F.filter(F.transform(chunks, trim), lambda x: F.octet_length(x) >= least)


def path_to_title(path: Column) -> Column:
    base = F.regexp_extract(path, r"([^/]*)/*$", 1)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    decoded = F.coalesce(F.try_url_decode(F.replace(stem, F.lit("+"), F.lit("%2B"))), stem)
    return trim(F.translate(F.regexp_replace(decoded, r"_[0-9]{6,}$", ""), "-_", "  "))


def embed_text(title: Column, chunk: Column) -> Column:
    return F.concat_ws("\n", title, chunk)


def snippet(text: Column, most: int = SNIPPET) -> Column:
    """One line, at most `most` bytes and then '...'; a character that is cut gives one U+FFFD."""
    line = trim(F.replace(text, F.lit("\n"), F.lit(" ")))
    cut = F.make_valid_utf8(F.substring(line.cast("binary"), 1, most).cast("string"))
    return F.when(F.octet_length(line) > most, F.concat(cut, F.lit("..."))).otherwise(line)


def relevance(distance: Column) -> Column:
    return F.round(1 - distance, 2)


def relevance_band(distance: Column) -> Column:
    return F.when(distance < 0.2, "good").when(distance < 0.3, "medium").otherwise("poor")


def context_block(rank: Column, path: Column, content: Column) -> Column:
    return F.concat(F.lit("[Fonte "), rank.cast("string"), F.lit(": "), path, F.lit("]\n"), content)


CONTEXT_RULE = "\n\n---\n\n"
