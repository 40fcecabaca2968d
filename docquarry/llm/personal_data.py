"""Operator 9: personal data by rules and a semi-Markov conditional random field.

The rules (email, ip, card, phone) give the base spans; they always stay. The random field finds what the rules miss:
obfuscated addresses, defanged ips, dotted card numbers, numbers that the rules' longest match has swallowed, phone numbers
with a 00 prefix or beside a cue word. It works on regions (runs of digits and number marks, and spelled-out addresses),
without the base spans in them. In a region it scores every segment of at most MOST_TOKENS tokens whose borders can be an
entity's (no letter or digit beside it, brackets in pairs) and that has the digits of its kind (an ip four groups of at most
255 with a dot, bare or in brackets, between them, a card 16 to 19 that pass Luhn in even groups with one mark between them, a phone 7 to 15; an address a spelled-out `at`
and a dot), by features of the whole span, its borders and its left context. Dynamic programming over all segmentations into
such segments and single tokens chooses boundaries and types together; regions have any length.

The weights are trained here by gradient ascent on the exact log-likelihood, on a bounded sample. Parameters: base spans, and
regions without any, of the TRAIN_ROWS documents of least doc_id that have base spans, among those whose crc32(doc_id) is 3
modulo TRAIN_SHARE, or among all if these are too few; of a document the first TRAIN_EACH of each, those of at most
TRAIN_LETTERS letters. They are rewritten in the ways above, alone and side by side, beside made-up numbers that are nothing (dates, times, sort codes, versions,
ISBNs, amounts, digit runs). A segment whose marks were in no example scores UNSEEN for them.
Every whole text is searched.

Defined cases: null is an empty text. Offsets count code points. Equal rows get equal results. Extra columns are ignored.
No rows: no result; where no row has base spans, a few written examples train the field.
"""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

KINDS = ("email", "ip", "card", "phone")
TRAIN_ROWS, TRAIN_SHARE, TRAIN_EACH, TRAIN_LETTERS = 300, 16, 8, 120
MOST_TOKENS = 32
UNSEEN = -3.0

# The patterns of the rules. Possessive runs keep them linear.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def ips(text: str):
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def cards(text: str):
    for m in _CARD.finditer(text):
        digits = digits_of(m[0]) if len(m[0]) <= 40 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str):
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(digits_of(m[0])) <= 15:
                yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start."""
    out = []
    for k, find in enumerate((emails, ips, cards, phones)):
        out += [(k, s, e) for s, e in find(text)]
    return out


# --- the random field -------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s|[^A-Za-z0-9\s]")
_NUMBER = re.compile(r"\+?\(?[0-9][0-9 ().\[\]+-]{5,}[0-9]")
_AT = re.compile(r"[(\[]\s?at\s?[)\]]", re.I)
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]\s?\Z")
_HOST = re.compile(r"\s?[A-Za-z0-9-]++(?:\s?[(\[]\s?dot\s?[)\]]\s?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++", re.I)
_DOT = re.compile(r"\s?[(\[]\s?dot\s?[)\]]|\.[A-Za-z0-9]", re.I)
_HINTS = ("at)", "at]", "at )", "at ]")
_CUE = re.compile(r"(tel|phone|call|fax|mobile|card|visa|ip|host|server|mail)[\s.:#]*\Z", re.I)
CUES = {"tel": 3, "phone": 3, "call": 3, "fax": 3, "mobile": 3, "card": 2, "visa": 2, "ip": 1, "host": 1, "server": 1, "mail": 0}
CONTEXT = 16  # letters to the left in which a cue is looked for
_JOINT = re.compile(r"\s?(?:\.|\(\s?\.\s?\)|\[\s?\.\s?\])\s?")
_ALNUM = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_LOCAL_MARKS = _ALNUM | set("._%+-")


def regions(text: str):
    """Stretches in which candidates may lie: numbers and spelled-out addresses."""
    for m in _NUMBER.finditer(text):
        yield m.span()
    low = text.lower()
    if any(h in low for h in _HINTS):
        end = 0
        for m in _AT.finditer(text):
            start = m.start()
            if start > end and text[start - 1].isspace():
                start -= 1
            local = start
            while start > end and text[start - 1] in _LOCAL_MARKS:
                start -= 1
            host = _HOST.match(text, m.end())
            if start < local and host:
                yield start, host.end()
                end = host.end()


def _class(c: str) -> str:
    return "none" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else c


def _cue(text: str, at: int) -> int | None:
    """The kind that the word just before a place announces."""
    m = _CUE.search(text[max(0, at - CONTEXT) : at])
    return CUES[m[1].lower()] if m else None


def _prefix(text: str, at: int) -> str:
    return "plus" if text[at] == "+" else "double" if text.startswith("00", at) else "bare"


def _shared_features(kind: int, text: str, a: int, b: int, marks: str, digits: int, cue: int | None, lead: int | None) -> list[str]:
    k = KINDS[kind]
    return [
        f"{k}:bias",
        f"{k}:marks={marks}",
        f"{k}:digits={digits}",
        f"{k}:cue={'none' if cue is None else cue == kind}",
        f"{k}:lead={'none' if lead is None else lead == kind}",
        f"{k}:prefix={_prefix(text, a)}",
        f"{k}:edges={_class(text[a - 1 : a])},{_class(text[a])},{_class(text[b - 1])},{_class(text[b : b + 1])}",
    ]


def paired(span: str) -> bool:
    """Whether its brackets stand in pairs, none within another."""
    marks = re.sub(r"[^()\[\]]", "", span)
    return not marks.replace("()", "").replace("[]", "")


def _number_candidates(text: str, borders: list[int], tokens: list[str], lead: int | None):
    for i, first in enumerate(tokens):
        a = borders[i]
        if not (first[0].isdigit() or first in "+(") or text[a - 1 : a] in _ALNUM and a:
            continue
        digits, groups, seen, cue = "", [], {}, _cue(text, a)
        for j in range(i, min(i + MOST_TOKENS, len(tokens))):
            token = tokens[j]
            if not token[0].isdigit():
                if token.isalpha():
                    break
                seen[token] = None
                continue
            digits += token
            groups.append(token)
            if len(digits) > 19:
                break
            b = borders[j + 1]
            if text[b : b + 1] in _ALNUM and b < len(text) or not paired(text[a:b]):
                continue
            marks, joints = "".join(seen), set(re.split("[0-9]+", text[a:b])[1:-1])
            if len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups) and all(map(_JOINT.fullmatch, joints)):
                yield i, j + 1, 1, [*_shared_features(1, text, a, b, marks, len(digits), cue, lead), f"ip:joints={len(joints)}"]
            if len(digits) >= 16 and len(joints) <= 1 and len({len(g) for g in groups[:-1]}) <= 1 and luhn(digits):
                yield i, j + 1, 2, _shared_features(2, text, a, b, marks, len(digits), cue, lead)
            if 7 <= len(digits) <= 15:
                names = _shared_features(3, text, a, b, marks, len(digits), cue, lead)
                opens = text.find("(", a, b)
                yield i, j + 1, 3, [*names, f"phone:opens={'no' if opens < 0 else 'first' if opens == a else _prefix(text, a)}", f"phone:groups={len(groups)}", f"phone:zeros={'00' in (g[:2] for g in groups[1:])}", f"phone:last={len(groups[-1])}"]


def _address_candidates(text: str, borders: list[int], tokens: list[str], lead: int | None):
    lows = [t.lower() for t in tokens]
    spelled = lambda k, word: lows[k] == word and next((t for t in tokens[k + 1 : k + 3] if not t.isspace()), "") in (")", "]")
    for i, first in enumerate(tokens):
        a = borders[i]
        if first[0] not in _ALNUM or text[a - 1 : a] in _LOCAL_MARKS and a:
            continue
        at = dots = 0
        for j in range(i, min(i + MOST_TOKENS, len(tokens))):
            if spelled(j, "at"):
                at += 1
            elif at and (spelled(j, "dot") or tokens[j] == "."):
                dots += 1
            b = borders[j + 1]
            if not (at and dots) or tokens[j][0] not in _ALNUM or text[b : b + 1] in _LOCAL_MARKS - {"."} and b < len(text) or not paired(text[a:b]):
                continue
            marks = "".join(dict.fromkeys(t for t in tokens[i : j + 1] if t[0] not in _ALNUM))
            names = _shared_features(0, text, a, b, marks, 0, _cue(text, a), lead)
            yield i, j + 1, 0, [*names, f"email:at={at}", f"email:dots={min(dots, 3)}", f"email:ends={lows[j] in ('dot', 'at')}", f"email:more={bool(_DOT.match(text, b))}"]


def segments(text: str, start: int, end: int, lead: int | None = None):
    """Token borders of a region, and its candidates as (first border, last border, kind, feature names)."""
    tokens = _TOKEN.findall(text, start, end)
    borders = [start]
    for t in tokens:
        borders.append(borders[-1] + len(t))
    found = list(_number_candidates(text, borders, tokens, lead))
    if any(t.isalpha() for t in tokens):
        found += _address_candidates(text, borders, tokens, lead)
    return borders, found


def _sweep(n: int, scored):
    """Log sums over all segmentations of borders 0..i and of i..n; a token outside segments scores 0."""
    ends: list[list] = [[] for _ in range(n + 1)]
    starts: list[list] = [[] for _ in range(n + 1)]
    for i, j, score in scored:
        ends[j].append((i, score))
        starts[i].append((j, score))

    def add(values):
        top = max(values)
        return top + math.log(sum(math.exp(v - top) for v in values))

    before, after = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        before[j] = add([before[j - 1], *(before[i] + s for i, s in ends[j])])
    for i in range(n - 1, -1, -1):
        after[i] = add([after[i + 1], *(after[j] + s for j, s in starts[i])])
    return before, after


def train(examples: list[tuple[str, int, int, set]], rounds: int = 5, rate: float = 0.3) -> dict[str, float]:
    """examples: (text, region start, end, true segments as (start, end, kind)). Gradient ascent with decay."""
    weights: dict[str, float] = {}
    ready = []
    for text, start, end, truth in examples:
        borders, found = segments(text, start, end, _cue(text, start))
        ready.append((len(borders) - 1, found, [(borders[i], borders[j], k) in truth for i, j, k, _ in found]))
    for r in range(rounds):
        step = rate / (1 + r / 2)
        for n, found, true in ready:
            scores = [sum(weights.get(f, 0.0) for f in names) for *_, names in found]
            before, after = _sweep(n, [(i, j, s) for (i, j, _, _), s in zip(found, scores, strict=True)])
            for (i, j, _, names), score, gold in zip(found, scores, true, strict=True):
                slope = gold - math.exp(min(0.0, before[i] + score + after[j] - before[n]))
                if abs(slope) > 1e-4:
                    for f in names:
                        weights[f] = weights.get(f, 0.0) * (1 - 1e-4) + step * slope
    return weights


def decode(text: str, start: int, end: int, weights: dict[str, float], lead: int | None = None) -> list[tuple[int, int, int]]:
    """The best segmentation of a region: (kind, start, end) of its segments."""
    borders, found = segments(text, start, end, lead)
    if not found:
        return []
    n = len(borders) - 1
    ends: dict[int, list] = {}
    for i, j, k, names in found:
        score = sum(weights[f] if f in weights else UNSEEN if ":marks=" in f else 0.0 for f in names)
        if score > 0:
            ends.setdefault(j, []).append((score, i, k))
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for score, i, k in ends.get(j, ()):
            if best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, (i, k)
    out, j = [], n
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            i, k = back[j]
            out.append((k, borders[i], borders[j]))
            j = i
    return out[::-1]


def _rewritten(rng: random.Random, kind: int, span: str) -> list[tuple[str, str]]:
    """(left context, span) in forms that the rules miss."""
    if kind == 0:
        a, b = span.split("@", 1)
        return [("", f"{a}{at}{b.replace('.', dot)}") for at, dot in ((" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), ("[at]", "(dot)"))]
    if kind == 1:
        return [("", span.replace(".", mark)) for mark in ("[.]", "(.)")]
    if kind == 2:
        digits = digits_of(span)
        return [("", ".".join(digits[k : k + 4] for k in range(0, len(digits), 4)))]
    digits = digits_of(span)
    cue = rng.choice(["tel: ", "phone ", "call ", "Tel. "])
    own = digits[-10:]
    split = rng.choice([1, 2, 3])
    spaced = " ".join([digits[:split], digits[split : split + 2], digits[split + 2 :]])
    return [("", "00" + span[1:]), ("", "00" + spaced), *((cue, form) for d in (digits, own) for form in (f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}"))]


SEEDS = ["mail ann.lee@example.org now", "from 10.20.30.40 to", "card 4539 1488 0343 6467 ok", "call +49 30 1234 5678 or"]


def _line(parts: list[tuple[str, str, int | None]], joint: str) -> list[tuple[str, int, int, set]]:
    """Examples from a line of (left context, span, kind) pieces; kind is None for what is nothing."""
    line, truth = "and ", set()
    for k, (left, form, kind) in enumerate(parts):
        line += (joint if k else "") + left
        if kind is not None:
            truth.add((len(line), len(line) + len(form), kind))
        line += form
    line += " the"
    return [(line, s, e, {t for t in truth if s <= t[0] and t[1] <= e}) for s, e in regions(line)]


def _nothing(rng: random.Random) -> str:
    """A number that is nothing personal: digit runs, and the shapes that dates, times, codes, versions and amounts are written in."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    to = lambda n: f"{rng.randrange(1, n + 1):02d}"
    year, run = str(rng.randrange(1950, 2040)), d(rng.choice([6, 7, 8, 9, 10, 12, 14, 16, 20]))
    shapes = [
        *[run] * 3, f"{run[:3]}.{run[3:]}", f"{run[:2]} {run[2:]}",
        f"{year}-{to(12)}-{to(28)}", f"{to(28)}.{to(12)}.{year}", f"{to(28)}-{to(12)}-{year}", f"{year}-{to(12)}-{to(28)} {to(23)}", f"{year} - {int(year) + 3}", f"{year} {year}", f"{year}{to(12)}{to(28)} {to(23)}{to(59)}",
        f"{d(2)}-{d(2)}-{d(2)}", f"{d(2)}-{d(2)}-{d(2)}-{d(2)}", f"{d(2)}-{d(2)}-{d(2)} {d(8)}", f"{rng.choice(['978', '979'])}-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"{d(4)}-{d(4)}",
        f"{rng.randrange(20)}.{rng.randrange(40)}.{rng.randrange(300)}.{rng.randrange(256, 9999)}", f"{rng.randrange(9)}.{rng.randrange(9)}.{rng.randrange(9)}.{rng.randrange(9)}.{rng.randrange(9)}",
        f"{rng.randrange(1, 999)}.{d(3)}.{d(3)}", f"{rng.randrange(1, 999)} {d(3)} {d(3)}", f"{rng.randrange(1, 99)}.{d(3)}.{d(3)}.{d(3)}", f"{rng.randrange(1, 999)} {d(3)}.{d(2)}", f"({year}) {d(3)}-{d(3)}", f"{d(3)}.{d(5)} {d(3)}.{d(5)}",
    ]
    return rng.choice(shapes)


def examples_of(found: list[tuple[list[tuple[int, str]], list[str]]]) -> list[tuple[str, int, int, set]]:
    """Training regions from (base spans as (kind, text), lines that hold a region but no base span) of each document."""
    rng, out = random.Random(17), []
    forms: list[tuple[str, str, int]] = []
    seeds = [([(k, t[a:b]) for k, a, b in base_spans(t)], []) for t in SEEDS * 3]
    for spans, lines in [*seeds, *found]:
        out += [(line, s, e, set()) for line in lines for s, e in regions(line)]
        for kind, span in spans:
            own = [(left, form, kind) for left, form in _rewritten(rng, kind, span)]
            for f in own:
                out += _line([f], "")
            forms += [*own, ("", span, kind)]
        for form in (_nothing(rng) for _ in range(4)):  # numbers that are nothing
            if not base_spans(form):
                out += _line([("", form, None)], "")
    for left, form, kind in list(forms):  # side by side: the same kind again, another one, a number that is nothing
        if kind:
            more = rng.choice([[("", form, kind)], [("", form, kind)] * 2, [("", f, k) for _, f, k in [rng.choice(forms)] if k], [("", _nothing(rng), None)]])
            parts = [(left, form, kind), *more]
            if not left and rng.random() < 0.5:
                parts.reverse()
            out += [x for x in _line(parts, " ") if not base_spans(x[0])]
    rng.shuffle(out)
    return out


def learn(docs: DataFrame) -> dict[str, float]:
    """Weights from a bounded sample; what it is, and its parameters, are stated above."""

    def find(batches):
        for batch in shared.pieces_of(batches):
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                base = base_spans(text)
                spans = [(k, text[a:b]) for k, a, b in base if b - a <= TRAIN_LETTERS]
                if spans:
                    parts = ((max(0, s - CONTEXT), s, e) for s, e in regions(text) if e - s <= TRAIN_LETTERS)
                    free = [text[at : e + 1] for at, s, e in parts if not any(a < e and s < b for _, a, b in base)]
                    out.append((doc, [k for k, _ in spans[:TRAIN_EACH]], [t for _, t in spans[:TRAIN_EACH]], free[:TRAIN_EACH]))
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["doc_id", "kinds", "spans", "free"])

    some = shared.id_text(docs).where(F.col("text").contains("@") | F.col("text").rlike("[0-9]{2}"))
    for part in (some.where(f"crc32(cast(doc_id as string)) % {TRAIN_SHARE} = 3"), some):
        rows = part.mapInArrow(find, "doc_id long, kinds array<long>, spans array<string>, free array<string>").orderBy("doc_id", "spans").limit(TRAIN_ROWS).collect()
        if len(rows) == TRAIN_ROWS:
            break
    return train(examples_of([(list(zip(r.kinds, r.spans, strict=True)), r.free) for r in rows]))


def spans_of(text: str, weights: dict[str, float]) -> tuple[list, list]:
    """Base spans, and those that the field adds in what the base spans leave of the regions."""
    base = base_spans(text)
    covered = sorted((s, e) for _, s, e in base)
    added: list[tuple[int, int, int]] = []
    last = at = 0
    for s, e in sorted(regions(text)):
        lead = _cue(text, s)
        s = max(s, last)
        while at and covered[at - 1][1] > s:
            at -= 1
        while at < len(covered) and covered[at][1] <= s:
            at += 1
        k = at
        while s < e:
            stop = min(e, covered[k][0]) if k < len(covered) else e
            if s < stop:
                added += decode(text, s, stop, weights, lead)
            if k == len(covered) or covered[k][0] >= e:
                break
            s, k = max(s, covered[k][1]), k + 1
        last = max(last, e)
    return base, added


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added)."""
    weights = learn(docs)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def find(batches):
        for batch in shared.pieces_of(batches):
            cols: list[list] = [[] for _ in names[1:]]
            for text in batch.column("text").to_pylist():
                base, added = spans_of(text or "", weights)
                counts = [sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))]
                for c, v in zip(cols, (*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(sorted(base + added))), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], names)

    return shared.id_text(docs).mapInArrow(find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(shared.table(spark, sf_dir, "documents"))
