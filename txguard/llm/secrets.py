"""Secret scans with built-in columns only: fixed patterns, and windows of high Shannon entropy in candidate strings.

A candidate is a maximal run of one character class. A window slides over it; the counts of the entering and of the leaving character are updated in their
slots, and with them the sum of ``c log2 c`` from which the entropy follows, so a step costs the same at any window length. Windows at or above
the class's threshold are joined into spans. Candidates that the allow-list knows are left out.

Texts of any length take time in proportion to it: patterns repeat single characters only, which needs no recursion, and arrays are built in
blocks, as adding to an array copies it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns. The value's length is checked after matching, as a failing match takes part of the text with it.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
MIN_VALUE = 6


@dataclass(frozen=True)
class CharacterClass:
    """Runs of ``members`` (a regular expression's class) are candidates; ``alphabet`` numbers the characters for counting. Windows are below 64 characters.

    ``longest`` bounds the runs that are looked at, None for any; ``mixed`` asks for a small letter, a capital and a digit.
    """

    kind: str
    members: str
    alphabet: str
    window: int
    threshold: float
    longest: int | None = None
    mixed: bool = False


_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_KEYS = "A-Za-z0-9+/_-", _LOWER + _LOWER.upper() + _DIGITS + "+/_-"
# Thresholds stand against the greatest entropy of a window: log2 of the class's size or of the window's length. Runs too short for the long window
# are looked at with a short one, nearly all of whose characters must differ.
CLASSES = (
    CharacterClass("entropy_hex", "0-9A-Fa-f", "0123456789abcdefABCDEF", 24, 3.0),
    CharacterClass("entropy_base64", *_KEYS, 24, 4.0),
    CharacterClass("entropy_short", *_KEYS, 16, 3.7, longest=23, mixed=True),
)
# Candidates that are no secrets: plain words and paths of words, numbers, unique ids. Loops over single characters, so that no text is too long.
ALLOWED = (r"^[A-Za-z][A-Za-z_/-]*+$", r"^[0-9]++$", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")
# Words of examples: a candidate with one is left out unless a part of it between / _ - without any is as long as a key.
PLACEHOLDER, PART, KEY = r"(?i)example|sample|placeholder|changeme|dummy|xxxxxx", "[/_-]", 16
# Array elements that are added one by one; blocks of them are put together at once.
BLOCK = 256
# Counts of six bits, eight (2 ** 3) to a long.
_BITS, _SLOTS = 6, 3
_SPANS = "array<struct<start: bigint, kind: int, name: string, end: bigint>>"


def _no_spans() -> Column:
    return F.array().cast(_SPANS)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: what a lambda takes from outside is computed for each element, its arguments are not."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _blocks(size: Column, step: int = BLOCK) -> Column:
    """Where blocks of an array begin, from 0; one block if it is empty."""
    return F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(step))


def _matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, hit) of a pattern's matches, in code points: the parts between them give their places.

    Places within a block of matches are added up first, then those of blocks.
    """
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("hit"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.char_length(pair["gap"])
        end = start + F.char_length(pair["hit"])
        return F.struct(end.alias("at"), F.array_append(state["out"], F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("hit"))).alias("out"))

    empty = F.array().cast("array<struct<start: bigint, end: bigint, hit: string>>")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out"))
    blocks = _with(pairs, lambda every: F.transform(_blocks(F.size(every)), lambda at: F.aggregate(F.slice(every, at + 1, BLOCK), start, step)))

    def add(state: Column, block: Column) -> Column:
        return F.struct((state["at"] + block["at"]).alias("at"), F.array_append(state["out"], F.struct(state["at"].alias("before"), block["out"].alias("own"))).alias("out"))

    none = F.array().cast("array<struct<before: bigint, own: array<struct<start: bigint, end: bigint, hit: string>>>>")
    placed = F.aggregate(blocks, F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out")), add, lambda x: x["out"])
    return F.flatten(F.transform(placed, lambda b: F.transform(b["own"], lambda m: F.struct(
        (b["before"] + m["start"]).alias("start"), (b["before"] + m["end"]).alias("end"), m["hit"].alias("hit")))))


def _spans(text: Column, pattern: str, number: int, name: str, keep: Column | None = None) -> Column:
    found = _matches(text, pattern)
    if keep is not None:
        # One flag for each match, in order.
        zipped = F.arrays_zip(found.alias("m"), keep.alias("ok"))
        found = F.transform(F.filter(zipped, lambda x: x["ok"]), lambda x: x["m"])
    spans = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), F.lit(name).alias("name"), m["end"].alias("end")))
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(_no_spans())


def _hot_in_block(places: Column, cls: CharacterClass) -> Column:
    """Spans (start, end) of hot windows in an array of character numbers. Counts stand in slots of longs."""
    w = cls.window
    cost = F.array(*(F.lit(n * math.log2(n) if n else 0.0) for n in range(w + 2)))
    longs = (len(cls.alphabet) - 1 >> _SLOTS) + 1

    def shift(slot: Column) -> Column:
        return slot.bitwiseAND(F.lit((1 << _SLOTS) - 1)) * _BITS

    def count(counts: Column, slot: Column) -> Column:
        held = F.get(counts, F.shiftright(slot, _SLOTS))
        return F.call_function("shiftright", held, shift(slot)).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")

    def one(slot: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), shift(slot))

    def step(state: Column, i: Column) -> Column:
        inside, full = F.get(state["places"], i), i >= w
        outside = F.get(state["places"], F.greatest(i - w, F.lit(0)))
        entering, leaving = count(state["counts"], inside), count(state["counts"], outside)
        moved = ~full | (inside != outside)
        change = F.get(cost, entering + 1) - F.get(cost, entering) + F.when(
            full, F.get(cost, leaving - 1) - F.get(cost, leaving)).otherwise(0.0)
        into, out_of = F.shiftright(inside, _SLOTS), F.shiftright(outside, _SLOTS)
        counts = F.when(moved, F.transform(state["counts"], lambda n, k: n + F.when(k == into, one(inside)).otherwise(F.lit(0).cast("bigint")) - F.when(
            full & (k == out_of), one(outside)).otherwise(F.lit(0).cast("bigint")))).otherwise(state["counts"])
        total = state["total"] + F.when(moved, change).otherwise(0.0)
        # Sums of doubles may be off by their last bits.
        hot = (i >= w - 1) & (math.log2(w) - total / w >= cls.threshold - 1e-9)
        out, last = state["out"], F.get(state["out"], F.size(state["out"]) - 1)
        start, end = i - w + 1, i + 1
        grown = F.when(~hot, out).when(
            (F.size(out) > 0) & (last["end"] >= start),
            F.array_append(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.struct(last["start"].alias("start"), end.alias("end")))).otherwise(
            F.array_append(out, F.struct(start.alias("start"), end.alias("end"))))
        return F.struct(state["places"].alias("places"), counts.alias("counts"), total.alias("total"), grown.alias("out"))

    empty = F.array().cast("array<struct<start: int, end: int>>")
    start = F.struct(places.alias("places"), F.array_repeat(F.lit(0).cast("bigint"), longs).alias("counts"), F.lit(0.0).alias("total"), empty.alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.size(places) - 1), start, step, lambda s: s["out"])


def hot_windows(candidate: Column, cls: CharacterClass) -> Column:
    """Spans (start, end) within one candidate whose windows reach the threshold.

    The windows are taken in blocks, each with the characters its last windows reach into; spans that touch across blocks become one.
    """
    w = cls.window
    places = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(cls.alphabet), c) - 1)

    def in_block(at: Column, every: Column) -> Column:
        return F.transform(_hot_in_block(F.slice(every, at + 1, BLOCK + w - 1), cls), lambda s: F.struct((at + s["start"]).alias("start"), (at + s["end"]).alias("end")))

    found = _with(places, lambda every: F.flatten(F.transform(_blocks(F.size(every) - (w - 1)), lambda at: in_block(at, every))))
    return _with(found, _joined)


def _joined(found: Column) -> Column:
    """Spans that touch become one. Windows are equally long, so spans sorted by their start are sorted by their end."""
    starts = F.filter(found, lambda s, i: (i == 0) | (F.get(found, i - 1)["end"] < s["start"]))
    ends = F.filter(found, lambda s, i: (i == F.size(found) - 1) | (F.get(found, i + 1)["start"] > s["end"]))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))


def _is_allowed(candidate: Column, allowed: tuple[str, ...]) -> Column:
    whole = F.regexp_like(candidate, F.lit("|".join(f"(?:{a})" for a in allowed))) if allowed else F.lit(False)
    key = F.exists(F.split(candidate, PART), lambda part: (F.char_length(part) >= KEY) & ~F.regexp_like(part, F.lit(PLACEHOLDER)))
    return whole | (F.regexp_like(candidate, F.lit(PLACEHOLDER)) & ~key)


def _entropy_spans(text: Column, cls: CharacterClass, number: int, allowed: tuple[str, ...]) -> Column:
    run = f"[{cls.members}]{{{cls.window},{cls.longest or ''}}}" + (f"(?![{cls.members}])" if cls.longest else "+")
    pattern = f"(?<![{cls.members}]){run}"
    looked_at = F.filter(_matches(text, pattern), lambda m: ~_is_allowed(m["hit"], allowed))
    if cls.mixed:
        looked_at = F.filter(looked_at, lambda m: F.regexp_like(m["hit"], F.lit("[a-z]")) & F.regexp_like(m["hit"], F.lit("[A-Z]")) & F.regexp_like(m["hit"], F.lit("[0-9]")))
    spans = F.flatten(F.transform(looked_at, lambda m: F.transform(hot_windows(m["hit"], cls), lambda s: F.struct(
        (m["start"] + s["start"]).alias("start"), F.lit(number).alias("kind"), F.lit(cls.kind).alias("name"), (m["start"] + s["end"]).alias("end")))))
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(_no_spans())


def find_secrets(docs: DataFrame, classes: tuple[CharacterClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """doc_id, assign, access, hex (spans of the base patterns), entropy (spans that the windows add), one row per row.

    A span is (start, kind number, kind name, end) in code points, end exclusive. Null text counts as empty; texts of any length are scanned whole, in time
    proportional to it. Repeated rows give equal rows, an empty table none. Rows need no exchange; other columns are ignored.
    """
    text = F.col("text")
    value_long = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= MIN_VALUE)
    found = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    entropy = [_entropy_spans(text, c, 3 + i, allowed) for i, c in enumerate(classes)]
    return found.select(
        "doc_id", _spans(text, ASSIGN, 0, "assign", value_long).alias("assign"), _spans(text, ACCESS, 1, "access").alias("access"),
        _spans(text, HEX, 2, "hex").alias("hex"), (F.concat(*entropy) if entropy else _no_spans()).alias("entropy"))


def as_text(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")
