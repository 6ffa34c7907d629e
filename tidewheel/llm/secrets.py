"""Secret scans through one combined automaton.

The mirror images of all rules are compiled into one minimal automaton. Its single pass over a text's bytes,
from the right, tells for every byte which rules have a match that starts there. From the leftmost start of
a rule an automaton of that rule alone, anchored there, gives the longest match; the next one is sought from
its end on, so spans of a rule are leftmost and do not overlap, as with a greedy expression. Matches whose
value is too short are dropped without a retry. Every byte is read once backwards and, within matches, once
forwards for each rule (twice where a rule has a value), however long lines and texts are.
Offsets are code points, the end exclusive.

Null and empty texts have no spans. Texts are scanned whole and as UTF-8, so no letter outside ASCII is taken for
one of a rule. Repeated rows are scanned alike, an empty table gives no rows, extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton
from .shared import bounded, chunks

SCAN_BYTES = 1 << 20  # lanes side by side in a step


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "(?:" + "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
_HEAD = _NAMES + "[\"']?\\x20*[:=]\\x20*[\"']?"
#: kind, rule, least length of the value, head (the part of a match before its value). A rule that is one long run of a
#: class asks for its least length at once, as a run is taken whole or not at all.
BASE = (
    ("assign", _HEAD + "[A-Za-z0-9+/_.=-]+", 12, _HEAD),
    ("access", "AKIA[A-Z0-9]+", 18, ""),
    ("hex", "[0-9a-f]{16,}", 16, ""),
)
#: Rules that the method adds.
EXTRA = (
    ("github", "gh[opsu]_[A-Za-z0-9]+", 40, ""),
    ("slack", "xox[abprs]-[A-Za-z0-9-]+", 15, ""),
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, ""),
    ("jwt", "eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 30, ""),
)
RULES = BASE + EXTRA


@cache
def compiled():
    starts = Automaton([r[1] for r in RULES], backwards=True)
    return starts, [(Automaton([rule], anchored=True), Automaton([head], anchored=True) if head else None, least) for _, rule, least, head in RULES]


def text_spans(texts: pa.Array):
    """For each text its spans (start, kind number, end) in code points."""
    starts, rules = compiled()
    for lo, hi, data, offsets in chunks(texts, SCAN_BYTES):
        found: list[list] = [[] for _ in range(hi - lo)]
        marks = starts.scan(data, offsets)
        if len(marks):
            raw = data.tobytes()
            text = np.searchsorted(offsets, marks[:, 0], side="right") - 1
            for k, (whole, head, least) in enumerate(rules):
                own = (marks[:, 1] >> k) & 1 == 1
                done = 0
                for i, at in zip(text[own].tolist(), marks[own, 0].tolist(), strict=True):
                    if at >= done:
                        end = int(offsets[i + 1])
                        done = whole.longest(raw, at, end)
                        if done - (head.longest(raw, at, end) if head else at) >= least:
                            found[i].append((k, at - int(offsets[i]), done - int(offsets[i])))
        for i, spans in enumerate(found):
            yield _code_points(raw[offsets[i] : offsets[i + 1]], spans) if spans else []


def _code_points(raw: bytes, spans):
    at = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
    return sorted((int(at[a]), k, int(at[z])) for k, a, z in spans)


def joined(spans, names, only: int | None = None) -> str:
    return ",".join(f"{names[x[1]]}:{x[0]}:{x[2]}" for x in spans if only is None or x[1] < only)


def span_columns(names, base: int, spans_of, scores: bool = False):
    """A mapInArrow function: doc_id, counts of the base kinds, digest of the base spans, all spans, and their scores if asked for.

    spans_of gives (start, kind number, end) of each text in order, and a score as a fourth value if asked for.
    """

    def run(batches):
        for batch in bounded(batches, 1):
            counts, digests, texts, marks = [[] for _ in range(base)], [], [], []
            for spans in spans_of(batch.column(1)):
                for k in range(base):
                    counts[k].append(sum(x[1] == k for x in spans))
                digests.append(hashlib.sha256(joined(spans, names, base).encode()).hexdigest())
                texts.append(joined(spans, names))
                marks.append(",".join(f"{x[3]:.3f}" for x in spans) if scores else None)
            last = [pa.array(x, pa.string()) for x in ([digests, texts, marks] if scores else [digests, texts])]
            out = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), *last]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", *(f"n_{n}" for n in names[:base]), "base_sha256", "spans", *["scores"] * scores])

    return run


def find_secrets(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    run = span_columns([r[0] for r in RULES], len(BASE), text_spans)
    return docs.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
