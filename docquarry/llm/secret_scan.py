"""Operator 12: secrets found by regular expressions behind an inverted index of trigrams. DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived (`needed`): clauses that must all hold, each a
choice of sets of trigrams of which one must be there whole. The index has, for each trigram that a rule asks for (others
would never be read) and each slice of the documents' keys, the sorted keys of the documents whose lower-cased text holds it.
Within a slice the lists are intersected and united as the query says; what is left are candidates, whose texts the
expression itself then verifies. A rule without a mandatory trigram (hex) has no query and is run over every text.

Plan: slices are of about SLICE documents by a hash, so a trigram that all documents hold is many lists of bounded length, and
lists are joined only within a slice; copies have the keys of their own rows. Trigrams are counted once a document before they
are shuffled. Candidates are one row a document with a bit for each rule, and only they meet the texts (Spark broadcasts them
when they are small, else both sides are shuffled by the key). Places come from the lengths of what lies between matches, summed
in two steps, so they cost little even where a text holds very many.

Defined cases: a null text is empty and has no spans. Every row is a document of its own, repeated rows and rows without
doc_id included (equal rows share a key, and so their candidates). Matches of a rule never overlap, those of different rules may.
Other columns are ignored, whatever their names. No rows: no result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

SLICE = 1 << 14
MOST_STRINGS = 64  # that a part of an expression may stand for and still be spelt out
BLOCK = 256  # matches that are summed together


def either(word: str) -> str:
    """An expression for a word whose ASCII letters may be in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isascii() and c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` whose group `group` has at least `least` characters; of syntax that Java, RE2 and Python share."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


_NAMES = "|".join([*map(either, ("password", "passwd", "secret", "token")), f"{either('api')}_?{either('key')}"])

#: The base rules, in the order of their kinds.
BASE = [
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
]

#: Public formats of keys and tokens.
ADDED = [
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]+-----END [A-Z ]*PRIVATE KEY-----"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("git_token", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment_key", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("bearer", r"[Bb]earer [A-Za-z0-9._~+/-]{20,}"),
    Rule("url_login", r"(https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x00-\x20/:@]+:[^\x00-\x20/@]+@"),
]

RULES = [*BASE, *ADDED]

Clause = list[frozenset[str]]  # one of these sets of trigrams is there whole


def _clause(strings: set[str]) -> Clause | None:
    """What a text needs to hold one of the strings; None if one of them is too short to tell."""
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    if frozenset() in sets:
        return None
    return sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)


def _class(items) -> set[str] | None:
    """The letters (in lower case) of a character class; None if it is negated or large."""
    out: set[str] = set()
    for kind, value in items:
        name = str(kind)
        if name == "LITERAL":
            out.add(chr(value).lower())
        elif name == "RANGE" and value[1] - value[0] < MOST_STRINGS:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 16 else None


def _item(kind: str, value) -> tuple[set[str] | None, list[Clause]]:
    """The strings a part of an expression stands for, if they can be spelt out, else the clauses it needs."""
    if kind == "LITERAL":
        return {chr(value).lower()}, []
    if kind == "IN":
        return _class(value), []
    if kind == "AT":
        return {""}, []
    if kind == "SUBPATTERN":
        return _sequence(value[3])
    if kind == "BRANCH":
        parts = [_sequence(p) for p in value[1]]
        if all(strings is not None for strings, _ in parts):
            return set().union(*(strings for strings, _ in parts)), []
        best = [_clause(s) if s is not None else min(c, key=len, default=None) for s, c in parts]
        return None, [] if None in best else [[a for c in best for a in c]]
    if kind in ("MAX_REPEAT", "MIN_REPEAT"):
        low, high, inner = value
        strings, clauses = _sequence(inner)
        if strings is not None and (low, high) == (0, 1):
            return strings | {""}, []
        if strings is not None and low == high and len(strings) ** low <= MOST_STRINGS:
            return reduce(lambda a, _: {x + y for x in a for y in strings}, range(low), {""}), []
        if low:
            own = _clause(strings) if strings is not None else None
            return None, clauses + ([own] if own else [])
    return None, []


def _sequence(items) -> tuple[set[str] | None, list[Clause]]:
    clauses, run, whole = [], {""}, True
    for kind, value in items:
        strings, more = _item(str(kind), value)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        whole = False
        clauses += [*([own] if (own := _clause(run)) else []), *more]
        run = strings if strings is not None else {""}
    if whole:
        return run, []
    own = _clause(run)
    return None, clauses + ([own] if own else [])


def needed(pattern: str) -> list[Clause]:
    """The trigram query of an expression: every text with a match satisfies all clauses, when lower-cased. Empty: no query."""
    strings, clauses = _sequence(re._parser.parse(pattern))  # the standard library's own reading of the expression
    if strings is not None:
        own = _clause(strings)
        clauses = [own] if own else []
    return clauses


def _one_of(words: list[str]) -> str:
    """An expression for one of several words, as a tree of their letters."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[0], []).append(w[1:])
    parts = [re.escape(c) + (_one_of(rest) if all(rest) else "") for c, rest in sorted(heads.items())]
    return f"(?:{'|'.join(parts)})"


def trigram_index(docs: DataFrame, trigrams: list[str], slices: int) -> DataFrame:
    """slice, trigram, keys (sorted): the postings of these trigrams over docs (key, text)."""
    held = F.regexp_extract_all(F.lower("text"), F.lit(f"(?=({_one_of(trigrams)}))"), 1)
    rows = docs.select("key", F.explode(F.array_distinct(held)).alias("trigram"))
    return rows.groupBy(F.pmod("key", F.lit(slices)).alias("slice"), "trigram").agg(F.sort_array(F.collect_set("key")).alias("keys"))


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """key, rules: a bit for each of the rules whose trigram query the document satisfies."""
    none = F.array().cast("array<long>")
    lists = index.groupBy("slice").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("lists"))
    both = lambda parts: reduce(F.array_intersect, parts)
    found = []
    for k, rule in enumerate(rules):
        clauses = needed(rule.pattern)
        if clauses:
            ways = [[both([F.coalesce(F.col("lists").getItem(t), none) for t in sorted(way)]) for way in clause] for clause in clauses]
            found.append(F.struct(F.lit(1 << k).cast("long").alias("bit"), both([reduce(F.array_union, w) for w in ways]).alias("keys")))
    if not found:
        return lists.select(F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("rules")).limit(0)
    each = lists.select(F.explode(F.array(*found)).alias("x")).select("x.bit", F.explode("x.keys").alias("key"))
    return each.groupBy("key").agg(F.bit_or("bit").alias("rules"))


def _let(value: Column, f) -> Column:
    """f of a value that is worked out once."""
    return F.transform(F.array(value), f).getItem(0)


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def sums_before(numbers: Column) -> Column:
    """For each element of an array of ints the sum of those before it, by blocks."""
    blocks = F.when(F.size(numbers) > 0, F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    totals = F.transform(blocks, lambda b: _sum(F.slice(numbers, b * BLOCK + 1, F.lit(BLOCK))))
    bases = _let(totals, lambda t: F.transform(t, lambda _, i: _sum(F.slice(t, F.lit(1), i))))
    block = lambda i: F.floor(i / BLOCK).cast("int")
    return _let(bases, lambda base: F.transform(numbers, lambda _, i: F.get(base, block(i)) + _sum(F.slice(numbers, block(i) * BLOCK + 1, i % BLOCK))))


def spans(text: Column, rule: Rule, order: int) -> Column:
    """The spans of a rule in a text: start, order, end (code points), kind."""
    sizes = lambda parts: F.transform(parts, lambda x: F.char_length(x))
    gaps = sizes(F.split(text, rule.pattern, -1))
    found = sizes(F.regexp_extract_all(text, F.lit(rule.pattern), 0))
    counted = sizes(F.regexp_extract_all(text, F.lit(rule.pattern), rule.group)) if rule.group else F.col("size")

    def placed(both: Column) -> Column:
        before = sums_before(F.zip_with(both["gaps"], both["sizes"], lambda g, n: g + F.coalesce(n, F.lit(0))))
        rows = F.zip_with(F.arrays_zip(before.alias("before"), both["gaps"].alias("gap")), both["sizes"], lambda x, n: F.struct((x["before"] + x["gap"]).alias("start"), n.alias("size")))
        rows = F.zip_with(rows, both["counted"], lambda x, c: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), (x["start"] + x["size"]).alias("end"), F.lit(rule.kind).alias("kind"), c.alias("counted")))
        kept = F.filter(rows, lambda x: x["counted"] >= rule.least)  # after the last match there is a gap alone
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["order"].alias("order"), x["end"].alias("end"), x["kind"].alias("kind")))

    def measured(n: Column) -> Column:
        return _let(F.struct(gaps.alias("gaps"), n.alias("sizes"), (counted if rule.group else n).alias("counted")), placed)

    return _let(found, measured)


SPANS = "array<struct<start:int,order:int,end:int,kind:string>>"


def find_secrets(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """row (the document as it came), spans: start, order of the rule, end, kind, by start and order."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text.alias("text"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("key"))
    trigrams = sorted({t for rule in rules for clause in needed(rule.pattern) for way in clause for t in way})
    if trigrams:
        slices = max(1, -(-docs.count() // SLICE))
        index = shared.store(trigram_index(rows.select("key", "text"), trigrams, slices), "trigrams")
        asked = shared.store(candidates(index, rules), "candidates")
        shared.drop(index)
        rows = rows.join(asked, "key", "left").withColumn("rules", F.coalesce("rules", F.lit(0).cast("long")))
    else:
        rows = rows.withColumn("rules", F.lit(0).cast("long"))
    none = F.array().cast(SPANS)
    found = []
    for k, rule in enumerate(rules):
        may = F.col("rules").bitwiseAND(F.lit(1 << k).cast("long")) != 0 if needed(rule.pattern) else F.lit(True)
        found.append(F.when(may & F.col("text").rlike(rule.pattern), spans(F.col("text"), rule, k).cast(SPANS)).otherwise(none))
    return rows.select("row", F.array_sort(F.concat(*found)).alias("spans"))


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(shared.table(spark, sf_dir, "documents"))
    number = lambda k: F.size(F.filter("spans", lambda x: x["order"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["order"] < len(BASE))
    return out.select("row.doc_id", *[number(k).alias(f"n_{rule.kind}") for k, rule in enumerate(BASE)], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def _sql() -> str:
    """The same by running every rule over every text."""
    parts = []
    for k, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, {k} AS k, '{r.kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)))::BIGINT AS start,
  unnest(list_transform(m, lambda x: length(x))) AS n, unnest(list_transform(v, lambda x: length(x))) AS counted, {r.least} AS least
  FROM (SELECT doc_id, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {r.group}) AS v, string_split_regex(t, '{p}') AS g FROM d)""")
    text = "kind || ':' || start || ':' || (start + n)"
    counts = ", ".join(f"count(*) FILTER (WHERE k = {k}) AS n_{r.kind}" for k, r in enumerate(BASE))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS (
{" UNION ALL ".join(parts)}), f AS (SELECT * FROM s WHERE counted >= least)
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({text}, ',' ORDER BY start, k) FILTER (WHERE k < {len(BASE)}), '')) AS base_sha256,
  coalesce(string_agg({text}, ',' ORDER BY start, k), '') AS spans
FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id"""


OP12_SQL = _sql()
