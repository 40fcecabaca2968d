"""The Portuguese stemmer as SQL, word for word what functions/lexing.py computes, for comparison with it."""

from __future__ import annotations

from ..functions import lexing

_V = "aeiouáéíóúâêô"


def _ends(suffixes) -> str:
    return "(" + "|".join(suffixes) + ")$"


def _without(stem: str, gone: str, *endings: str) -> str:
    """stem without the first of the endings that it has, if this lies in r2; gone: letters already taken off the word."""
    cases = " ".join(f"WHEN suffix({stem}, '{e}') THEN CASE WHEN length(r2) >= {gone} + {len(e)} THEN left({stem}, length({stem}) - {len(e)}) ELSE {stem} END" for e in endings)
    return f"CASE {cases} ELSE {stem} END"


_REPLACED = " ".join(f"WHEN sfx = '{k}' THEN stem || '{v}'" for k, v in lexing.REPLACE_R2.items())
_IV = _without("stem", "length(sfx)", "iv")


def stemmed(source: str, column: str) -> str:
    """CTEs that end in `stems (w, stem)` for the distinct values of a column."""
    return f"""sw AS (SELECT DISTINCT {column} AS w, replace(replace({column}, 'ã', 'a~'), 'õ', 'o~') AS x FROM {source}),
s1 AS (SELECT w, x, regexp_extract(x, '[{_V}][^{_V}](.*)$', 1) AS r1,
  CASE WHEN length(x) < 3 THEN '' WHEN regexp_matches(x, '^.[^{_V}]') THEN regexp_extract(x, '^.[^{_V}][^{_V}]*[{_V}](.*)$', 1)
       WHEN regexp_matches(x, '^[{_V}]') THEN regexp_extract(x, '^[{_V}][{_V}]+[^{_V}](.*)$', 1) ELSE substring(x, 4) END AS rv FROM sw),
s2 AS (SELECT *, regexp_extract(r1, '[{_V}][^{_V}](.*)$', 1) AS r2, regexp_extract(x, '{_ends(lexing._STANDARD)}') AS sfx FROM s1),
s3 AS (SELECT *, left(x, length(x) - length(sfx)) AS stem FROM s2),
s4 AS (SELECT *, {_IV} AS no_iv FROM s3),
s5 AS (SELECT *, CASE WHEN sfx = '' THEN x
  WHEN sfx IN ('ira', 'iras') THEN CASE WHEN length(sfx) <= length(rv) AND suffix(stem, 'e') THEN stem || 'ir' ELSE x END
  WHEN sfx = 'amente' THEN CASE WHEN length(r1) < 6 THEN x
    WHEN suffix(stem, 'iv') THEN CASE WHEN no_iv <> stem THEN {_without("no_iv", "8", "at")} ELSE stem END
    ELSE {_without("stem", "6", "os", "ic", "ad")} END
  WHEN length(sfx) > length(r2) THEN x
  {_REPLACED}
  WHEN sfx = 'mente' THEN {_without("stem", "5", "ante", "avel", "ível")}
  WHEN sfx IN ('idade', 'idades') THEN {_without("stem", "length(sfx)", "abil", "ic", "iv")}
  WHEN sfx IN ('iva', 'ivo', 'ivas', 'ivos') THEN {_without("stem", "length(sfx)", "at")}
  ELSE stem END AS a FROM s4),
s6 AS (SELECT *, CASE WHEN a = x THEN left(x, length(x) - length(regexp_extract(rv, '{_ends(lexing.VERB)}'))) ELSE a END AS b, length(x) - length(rv) AS from_rv,
  regexp_extract(x, '{_ends(lexing.RESIDUAL)}') AS rest FROM s5),
s7 AS (SELECT *, CASE WHEN b <> x THEN CASE WHEN suffix(b, 'ci') AND length(b) - 1 >= from_rv THEN left(b, length(b) - 1) ELSE b END
  WHEN rest <> '' AND length(x) - length(rest) >= from_rv THEN left(x, length(x) - length(rest)) ELSE x END AS c FROM s6),
s8 AS (SELECT *, regexp_matches(c, '[eéê]$') AND length(c) - 1 >= from_rv AS cut FROM s7),
s9 AS (SELECT *, CASE WHEN cut THEN left(c, length(c) - 1) WHEN suffix(c, 'ç') THEN left(c, length(c) - 1) || 'c' ELSE c END AS d FROM s8),
stems AS (SELECT w, replace(replace(CASE WHEN cut AND (suffix(d, 'gu') OR suffix(d, 'ci')) AND length(d) - 1 >= from_rv THEN left(d, length(d) - 1) ELSE d END, 'a~', 'ã'), 'o~', 'õ') AS stem FROM s9)"""
