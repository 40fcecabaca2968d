"""Words, stems and identifiers of full-text search."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType

VOWELS = set("aeiouáéíóúâêô")


def _after_vowel_pair(word: str, start: int) -> int:
    """Place after the first consonant that follows a vowel, from start on."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _rv(word: str) -> int:
    if len(word) < 3:
        return len(word)
    if word[1] not in VOWELS:
        found = (i + 1 for i in range(2, len(word)) if word[i] in VOWELS)
    elif word[0] in VOWELS:
        found = (i + 1 for i in range(2, len(word)) if word[i] not in VOWELS)
    else:
        return 3
    return next(found, len(word))


# The suffix classes of the published Portuguese stemming algorithm (a nasal vowel is the vowel and ~).
DELETE_R2 = "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância".split()
REPLACE_R2 = {"logia": "log", "logias": "log", "uça~o": "u", "uço~es": "u", "ência": "ente", "ências": "ente"}
VERB = (
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam "
    "aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias "
    "arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is "
    "ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos "
    "aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos "
    "eu iu ou ira iras"
).split()
RESIDUAL = "os a i o á í ó".split()


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


_STANDARD = [*DELETE_R2, *REPLACE_R2, "amente", "mente", "idade", "idades", "iva", "ivo", "ivas", "ivos", "ira", "iras"]


def _without(word: str, region: int, *endings: str) -> str:
    for e in endings:
        if word.endswith(e):
            return word[: -len(e)] if len(word) - len(e) >= region else word
    return word


def _standard(word: str, rv: int, r1: int, r2: int) -> str:
    suffix = _longest(word, _STANDARD)
    if suffix is None:
        return word
    stem, at = word[: -len(suffix)], len(word) - len(suffix)
    if suffix in ("ira", "iras"):
        return stem + "ir" if at >= rv and stem.endswith("e") else word
    if suffix == "amente":
        if at < r1:
            return word
        if stem.endswith("iv"):
            shorter = _without(stem, r2, "iv")
            return _without(shorter, r2, "at") if shorter != stem else stem
        return _without(stem, r2, "os", "ic", "ad")
    if at < r2:
        return word
    if suffix in REPLACE_R2:
        return stem + REPLACE_R2[suffix]
    if suffix == "mente":
        return _without(stem, r2, "ante", "avel", "ível")
    if suffix in ("idade", "idades"):
        return _without(stem, r2, "abil", "ic", "iv")
    if suffix in ("iva", "ivo", "ivas", "ivos"):
        return _without(stem, r2, "at")
    return stem


@lru_cache(1 << 16)
def stem_portuguese(word: str) -> str:
    """The Snowball stem of a lower-case word, after the published description of the algorithm."""
    word = word.replace("ã", "a~").replace("õ", "o~")
    r1 = _after_vowel_pair(word, 0)
    r2 = _after_vowel_pair(word, r1)
    rv = _rv(word)
    done = _standard(word, rv, r1, r2)
    if done == word:
        suffix = _longest(word, [s for s in VERB if len(word) - len(s) >= rv])
        done = word[: -len(suffix)] if suffix else word
    if done != word:
        if done.endswith("ci") and len(done) - 1 >= rv:
            done = done[:-1]
    else:
        suffix = _longest(word, RESIDUAL)
        if suffix and len(word) - len(suffix) >= rv:
            done = word[: -len(suffix)]
    if done and done[-1] in "eéê" and len(done) - 1 >= rv:
        done = done[:-1]
        if (done.endswith("gu") or done.endswith("ci")) and len(done) - 1 >= rv:
            done = done[:-1]
    elif done.endswith("ç"):
        done = done[:-1] + "c"
    return done.replace("a~", "ã").replace("o~", "õ")


_LETTERS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


@arrow_udf(ArrayType(StringType()))
def _stems(words: pa.Array) -> pa.Array:
    """Each distinct word of a batch is stemmed once; what is not of letters (and hyphens) stays."""
    flat = words.flatten().dictionary_encode()
    stems = pa.array([stem_portuguese(w) if _LETTERS.fullmatch(w) else w for w in flat.dictionary.to_pylist()], pa.string())
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(ends, stems.take(flat.indices), mask=words.is_null())


def stopwords(language: str = "portuguese") -> list[str]:
    from pyspark.ml.feature import StopWordsRemover

    return list(StopWordsRemover.loadDefaultStopWords(language))


def words(text: Column) -> Column:
    """Lower-case runs of letters, with repetitions."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), 0)


_ALNUM = r"[\p{L}\p{Nd}]"
_HOST = rf"(?:{_ALNUM}(?:[\p{{L}}\p{{Nd}}_-]{{0,62}})\.){{1,10}}\p{{L}}{{2,63}}+(?![\p{{L}}\p{{Nd}}_@]|\.{_ALNUM})"
_PATH = r"/[!-~&&[^\"<>\\^`{|}]]*+"

#: The tokens of a text, in the order in which they are tried at a place.
TOKENS = {
    "tag": r"</?\p{L}[^<>]{0,1000}+>",
    "entity": r"&(?:[a-z][a-z0-9]{0,31}+|#[0-9]{1,7}+|#x[0-9a-f]{1,6}+);",
    "protocol": r"[a-z][a-z0-9]{0,15}+://",
    "email": rf"{_ALNUM}[\p{{L}}\p{{Nd}}._+-]{{0,63}}+@{_HOST}",
    "url": rf"{_HOST}(?::[0-9]{{1,5}}+)?(?:{_PATH})?",
    "file": rf"(?:{_ALNUM}[\p{{L}}\p{{Nd}}_.-]{{0,63}}+|[~.]{{0,2}}+)(?:/[\p{{L}}\p{{Nd}}_.~-]++)++/?",
    "science": r"[-+]?[0-9]++(?:\.[0-9]++)?e[-+]?[0-9]++(?![\p{L}\p{Nd}])",
    "version": r"[0-9]++(?:\.[0-9]++){2,}+(?!\p{L})",
    "decimal": r"[-+]?[0-9]++\.[0-9]++(?!\p{L})",
    "compound": rf"\p{{L}}[\p{{L}}\p{{Nd}}]*+(?:-{_ALNUM}++)++",
    "whole": r"[-+][0-9]++(?!\p{L})",
    "word": rf"{_ALNUM}++",
}


def tokens(text: Column) -> Column:
    """What a text search sees in a lower-cased text: words, words with digits, numbers, versions, hosts, addresses and paths as
    they stand; a URL also by its host and by its path, a hyphenated compound also by its parts; tags, entities and protocols not."""
    low = F.lower(text)
    raw = F.regexp_extract_all(low, F.lit("|".join(f"(?:{p})" for p in TOKENS.values())), 0)
    is_a = lambda t, *kinds: t.rlike("|".join(rf"\A(?:{TOKENS[k]})\z" for k in kinds))

    def parts(t: Column) -> Column:
        host = F.regexp_extract(t, "^[^/:]+", 0)
        path = F.regexp_extract(t, "/.*$", 0)
        return (
            F.when(is_a(t, "tag", "entity", "protocol"), F.array().cast("array<string>"))
            .when(t.contains("@"), F.array(t))
            .when(is_a(t, "url"), F.when(path != "", F.array(t, host, path)).otherwise(F.when(t.contains(":"), F.array(t, host)).otherwise(F.array(t))))
            .when(is_a(t, "compound"), F.concat(F.array(t), F.split(t, "-")))
            .otherwise(F.array(t))
        )

    # plain words, by far the most, need no look at what they are
    return F.flatten(F.transform(raw, lambda t: F.when(t.rlike(r"\A[\p{L}\p{Nd}]+\z"), F.array(t)).otherwise(parts(t))))


def lexemes(text: Column, language: str | None = None, wanted: list[str] | None = None, whole: bool = False) -> Column:
    """What full-text search matches: words, for Portuguese without stopwords and stemmed. whole: all tokens, not runs of letters alone.

    With wanted only words are kept (and stemmed) that can have one of these as a lexeme: stemming leaves the first two
    letters as they are, but for a final c with cedilla.
    """
    found = tokens(text) if whole else words(text)
    if wanted is not None:
        heads = sorted({w[:2].replace("ç", "c") for w in wanted})
        found = F.filter(found, lambda w: F.translate(F.substring(w, 1, 2), "ç", "c").isin(heads))
    if language is None:
        return found
    stop = stopwords(language)
    kept = F.filter(found, lambda w: ~w.isin(stop))
    return _stems(kept) if language == "portuguese" else kept


_TERM = re.compile(r"[^\W\d_]{4,}")


def fts_terms(query: str) -> list[str]:
    """Runs of at least four letters, each spelling once without regard to case, first spelling kept."""
    out: dict[str, str] = {}
    for w in _TERM.findall(query):
        out.setdefault(w.lower(), w)
    return list(out.values())


def query_lexemes(query: str, language: str | None = None) -> list[str]:
    found = [w.lower() for w in fts_terms(query)]
    if language:
        stop = set(stopwords(language))
        found = [w for w in found if w not in stop]
    if language == "portuguese":
        found = [stem_portuguese(w) for w in found]
    return list(dict.fromkeys(found))


def fts_terms_column(query: Column) -> Column:
    """fts_terms of a column, joined with ' | '. Words spelt alike go first (by hashing); of the rest the first of each is found by
    sorting, so long texts do no harm."""
    found = F.array_distinct(F.regexp_extract_all(query, F.lit(r"\p{L}{4,}"), 0))
    placed = F.sort_array(F.transform(found, lambda w, i: F.struct(F.lower(w).alias("low"), i.alias("at"), w.alias("word"))))
    pick = lambda ws: F.filter(ws, lambda w, i: (i == 0) | (F.get(ws, i - 1)["low"] != w["low"]))
    first = F.transform(F.array(placed), pick).getItem(0)
    ordered = F.sort_array(F.transform(first, lambda w: F.struct(w["at"].alias("at"), w["word"].alias("word"))))
    return F.array_join(F.transform(ordered, lambda w: w["word"]), " | ")


def tech_term_column(text: Column) -> Column:
    """The first word of ASCII letters, digits and _ that has a _ with something on both sides; '' if none."""
    return F.regexp_extract(text, r"(?<![A-Za-z0-9_])[A-Za-z0-9_]+_[A-Za-z0-9_]+(?![A-Za-z0-9_])", 0)


def tech_term(query: str) -> str:
    m = re.search(r"\b\w+_\w+\b", query, re.ASCII)
    return m[0] if m else ""
