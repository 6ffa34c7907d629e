"""Benchmark decontamination by template windows.

Words become template tokens: numbers, names (a capital inside a sentence) and units turn into typed
placeholders, others into their letters and digits in lower case. The hashes of WINDOW successive template
tokens (a shorter item is one window of its own length) are joined with those of the benchmark's windows, once
with placeholders for names and once with the names' own letters, so copies in another case meet as well.
Along each diagonal (document position minus item position) that has hits, runs of alike tokens are taken:
equal template tokens, equal values, or a name of the item and any word, so names count in whatever case they
are written. A stretch is a part of a run in which every placeholder of the item maps to one value of the document
and equal values stay equal (slot consistency; a run is cut where a slot conflicts) and at least `literal`
tokens are no placeholders, which finds re-parameterised questions and rejects chance alignments; or a part
of equal values, whatever its tokens. A stretch that covers `share` of an item, or `least` tokens of it,
contaminates the document.

The hash join's build side is the benchmark: sorted arrays of window hashes, broadcast in parts of at most
MAX_WINDOWS windows (or one item, if that has more), made once in a worker process. Parts follow one another, each in
a pass of its own over a written table, so neither the driver nor a worker ever holds more than one. Documents are the
probe side and are never shuffled, so a window that many documents share is no hot key.

Null and empty texts, of documents and items, match nothing; items without an id are left out. Texts of any
length are read whole. Several items may match; all are listed, in ascending order, each once. Repeated rows are
judged alike, an empty table on either side gives no matches. Columns `contaminated`, `item_ids` and `longest` of
the documents are replaced; others are kept, whatever their names.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded, mix, staged

WINDOW, SHARE, LEAST, LITERAL, MAX_WINDOWS, PAIRS = 8, 0.5, 13, 5, 2_000_000, 1 << 20
#: Template tokens are 64-bit numbers: these placeholders, or the hash of a word, which holds within a process.
NUMBER, NAME, UNIT = PLACEHOLDERS = 1, 2, 3
#: Units of measure and currency in their common short and long forms.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons l ml liter liters litre litres "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent usd eur gbp mph kmh kph".split()
)
#: Patterns of Arrow's kernels. Signs around a word do not count, so `(12)` and `"12,5"` are numbers.
_BARE, _NUM, _ENDS, _CAPITAL = r"[^\p{L}\p{N}]+", r"^[()\[\]\"'!?;]*[+\-$€£]*\d[\d.,:/%]*[()\[\]\"'!?;]*$", r"[.!?:]$|^$", r"^\p{Lu}"
_NUMBER_WORDS = frozenset("one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split())


def read(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template tokens and the bare words behind them, of all texts in a row, and where each text's begin.

    Words without letters and digits are left out. What a word is, is found once for each distinct word of the texts.
    """
    texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
    split = pc.utf8_split_whitespace(texts.fill_null(""))
    size = split.offsets.to_numpy() - split.offsets[0].as_py() if len(split) else np.zeros(1, np.int64)
    words = split.flatten().dictionary_encode()
    own, at = words.dictionary, words.indices.to_numpy()
    bare = pc.replace_substring_regex(own, _BARE, "")
    low = pc.utf8_lower(bare)
    value = np.fromiter(map(hash, low.to_pylist()), np.int64, len(low))
    flag = lambda x: x.to_numpy(zero_copy_only=False).astype(bool)
    is_number = flag(pc.match_substring_regex(own, _NUM)) | flag(pc.is_in(low, pa.array(sorted(_NUMBER_WORDS), low.type)))
    is_name = flag(pc.match_substring_regex(bare, _CAPITAL)) & ~flag(pc.utf8_is_upper(bare))
    keep, number, unit, capital = (x[at] for x in (flag(pc.not_equal(low, "")), is_number, flag(pc.is_in(low, pa.array(sorted(UNITS), low.type))), is_name))
    ends = flag(pc.match_substring_regex(own, _ENDS))[at]
    opening = np.r_[True, ends[:-1]] if len(at) else ends
    opening[size[:-1][size[:-1] < len(at)]] = True
    bounds = np.r_[0, np.cumsum(keep)][size]
    values, number, opening = value[at[keep]], number[keep], opening[keep]
    after = np.r_[False, number[:-1]] if len(number) else number
    after[bounds[:-1][bounds[:-1] < len(number)]] = False
    kinds = np.where(capital[keep] & ~opening, NAME, values)
    kinds[unit[keep] & after] = UNIT
    kinds[number] = NUMBER
    return kinds, values, bounds


def template(text: str | None) -> tuple[list[int], list[int]]:
    kinds, values, _ = read([text])
    return kinds.tolist(), values.tolist()


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    codes = codes.view(np.uint64)
    out = np.zeros(max(len(codes) - size + 1, 0), np.uint64)
    for j in range(size):
        out = mix(out * np.uint64(3) + codes[j : j + len(out)])
    return out.view(np.int64)


def folded(kinds, values):
    """Template tokens with names as bare words, which no change of case or closing punctuation alters."""
    return np.where(np.equal(kinds, NAME), values, kinds)


def slot_stretch(item: list[int], doc: list[int], kinds: list[int], literal: int) -> int:
    """Longest part of a run with consistent slots and at least `literal` tokens that are no placeholders."""
    there, back, firm = {}, {}, [0]
    best = start = 0
    for p, (a, b, k) in enumerate(zip(item, doc, kinds, strict=True)):
        firm.append(firm[-1] + (k not in PLACEHOLDERS))
        if k in PLACEHOLDERS:
            for seen, x, y in ((there, (k, a), b), (back, (k, b), a)):
                at, was = seen.get(x, (p, y))
                if was != y:
                    start = max(start, at + 1)
                seen[x] = p, y
        if firm[-1] - firm[start] >= literal:
            best = max(best, p + 1 - start)
    return best


def equal_stretch(item: list[int], doc: list[int]) -> int:
    """Longest part of a run whose values are equal."""
    best = n = 0
    for a, b in zip(item, doc, strict=True):
        n = n + 1 if a == b else 0
        best = max(best, n)
    return best


def alike(own: int, own_value: int, kind: int, value: int) -> bool:
    return own == kind or own_value == value or own == NAME and kind not in (NUMBER, UNIT)


class Benchmark:
    """Items and, for each window length in use, the sorted hashes of their windows with item and position."""

    def __init__(self, rows: list[tuple[int, str]], size: int):
        self.items = []
        found: dict[int, list] = {}
        every, every_value, bounds = read([t for _, t in rows])
        for k, (name, _) in enumerate(rows):
            kinds, values = every[bounds[k] : bounds[k + 1]], every_value[bounds[k] : bounds[k + 1]]
            self.items.append((name, kinds.tolist(), values.tolist()))
            n = min(size, len(kinds))
            for form in (kinds, folded(kinds, values)) if n else ():
                h = window_hashes(form, n)
                found.setdefault(n, []).append(np.stack([h, np.full(len(h), k), np.arange(len(h))]))
        self.at = {}
        for n, parts in sorted(found.items(), reverse=True):
            table = np.unique(np.concatenate(parts, axis=1), axis=1)  # in order of hash; both forms of a window may be one
            first = np.zeros(1 << 16, bool)
            first[table[0] >> 48] = True  # most windows of documents already fall through here
            self.at[n] = table[0], table[1], table[2], first

    def hits(self, forms: list[np.ndarray], doc: np.ndarray, place: np.ndarray):
        """Arrays (document, item, shift) of the diagonals with hits, in slices of at most PAIRS joined rows or one window's."""
        for n, (hashes, item, pos, first) in self.at.items():
            for codes in forms:
                w = window_hashes(codes, n)
                at = np.flatnonzero(first[w >> 48])
                at = at[doc[at] == doc[at + n - 1]]
                low = np.minimum(np.searchsorted(hashes, w[at]), len(hashes) - 1)
                same = hashes[low] == w[at]
                at, low = at[same], low[same]
                many = np.searchsorted(hashes, hashes[low], side="right") - low
                upto, start = np.cumsum(many), 0
                while start < len(at):
                    end = max(start + 1, int(np.searchsorted(upto, upto[start] - many[start] + PAIRS, side="right")))
                    k = many[start:end]
                    entry = np.repeat(low[start:end] - (np.cumsum(k) - k), k) + np.arange(k.sum())
                    where = np.repeat(at[start:end], k)
                    yield np.unique(np.stack([doc[where], item[entry], place[where] - pos[entry]]), axis=1)
                    start = end

    def matches(self, texts, share: float, least: int, literal: int) -> list[dict[int, int]]:
        """{item_id: longest accepted stretch} of each text."""
        kinds, values, bounds = read(texts)
        out: list[dict[int, int]] = [{} for _ in texts]
        if not len(kinds):
            return out
        forms = [kinds, folded(kinds, values)] if (kinds == NAME).any() else [kinds]
        sizes = np.diff(bounds)
        doc = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(doc)) - np.repeat(bounds[:-1], sizes)
        seen: set[tuple[int, int, int]] = set()
        for part in self.hits(forms, doc, place):
            for d, k, shift in zip(*part.tolist(), strict=True):
                if (d, k, shift) not in seen:
                    seen.add((d, k, shift))
                    name, own, own_values = self.items[k]
                    low, high = bounds[d] + max(0, shift), min(bounds[d + 1], bounds[d] + shift + len(own))
                    best = diagonal(own, own_values, kinds[low:high].tolist(), values[low:high].tolist(), min(shift, 0), literal)
                    if best and (best >= least or best >= share * len(own)):
                        out[d][name] = max(out[d].get(name, 0), best)
        return out


def diagonal(own: list[int], own_values: list[int], kinds: list[int], values: list[int], shift: int, literal: int) -> int:
    """Longest accepted stretch of an item against a document that begins `shift` tokens after it."""
    best, firm = 0, min(literal, max(1, len(own) // 2))
    p, end = max(0, -shift), min(len(own), len(kinds) - shift)
    while p < end:
        start = p
        while p < end and alike(own[p], own_values[p], kinds[p + shift], values[p + shift]):
            p += 1
        if p - start > best:
            run, there = slice(start, p), values[start + shift : p + shift]
            best = max(best, slot_stretch(own_values[run], there, own[run], firm), equal_stretch(own_values[run], there))
        p += 1
    return best


_BUILT: dict[str, Benchmark] = {}


def _built(name: str, held, window: int) -> Benchmark:
    """The part's arrays, made once a process; an earlier part's are let go."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Benchmark(held.value, window)
    return _BUILT[name]


def _parts(benchmark: DataFrame):
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null and item_id is not null")
    part, n = [], 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        more = 2 * len(r[1].split())  # with and without placeholders for names
        if part and n + more > MAX_WINDOWS:
            yield part
            part, n = [], 0
        part.append((r[0], r[1]))
        n += more
    if part:
        yield part


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, least: int = LEAST, literal: int = LITERAL) -> DataFrame:
    """docs with contaminated, item_ids (ascending) and longest (tokens of the longest stretch)."""
    docs = docs.drop("contaminated", "item_ids", "longest")
    at = docs.columns.index("text")
    out = docs.withColumns({"item_ids": F.array().cast("array<long>"), "longest": F.coalesce(F.lit(None).cast("long"), F.lit(0).cast("long"))})

    def matched(frame: DataFrame, part) -> DataFrame:
        held, name, last = frame.sparkSession.sparkContext.broadcast(part), uuid.uuid4().hex, len(frame.columns) - 1

        def run(batches):
            for batch in bounded(batches, at):
                found = _built(name, held, window).matches(batch.column(at), share, least, literal)
                ids = [sorted({*before, *x}) for before, x in zip(batch.column(last - 1).to_pylist(), found, strict=True)]
                longest = [max([most, *x.values()]) for most, x in zip(batch.column(last).to_pylist(), found, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(ids, pa.list_(pa.int64())), pa.array(longest, pa.int64())], names=batch.schema.names)

        return frame.mapInArrow(run, frame.schema)

    first = True
    for part in _parts(benchmark):
        out = matched(out if first else staged(out, "decontaminate"), part)
        first = False
    return out.withColumn("contaminated", F.size("item_ids") > 0)
