"""Language identification by unigrams over a public vocabulary, summed over all segmentations.

Each language has a probability for every piece of the vocabulary. A text's likelihood in a language is
the product over its words (runs of letters, lower-cased, with the word mark in front) of the sum, over
all ways to cut the word into pieces, of the pieces' probabilities; the forward algorithm sums them, word
lengths of any size alike: sums are rescaled as they run, so none underflows. Letters are the characters
of Unicode's general category L. Probabilities come from expectation maximisation over the words of at most
SAMPLE documents outside the held-out fold, an equal share of each language (at most 1,000), those of the
smallest hash of doc_id and text; words of over LONGEST letters are left out of the fit only. Every whole
text is scored. Letters outside the vocabulary are single pieces of a small fixed probability.

Null texts and texts without a letter are `und` with score 0. Equal likelihoods go to the first language
by code point. Without labelled rows everything is `und`. Repeated rows are judged alike, and count as one
where the model is fitted. An empty table gives no rows. Columns `lang_pred` and `score` of the input are
replaced; others are kept, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict, deque

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded, crc_mod5

SAMPLE, ROUNDS, SMOOTH, UNKNOWN, LONGEST, FEW_LANGUAGES = 3000, 3, 0.05, 1e-7, 64, 10_000
MARK = "▁"
LETTERS = regex.compile(r"\p{L}+")
KNOWN_BYTES = 128 << 20


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model that consist of letters and the word mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = dict.fromkeys(model.id_to_piece(i).lower() for i in range(model.get_piece_size()))
    return [p for p in pieces if LETTERS.fullmatch(p.removeprefix(MARK) or "x")]


def words(text: str | None) -> Counter:
    return Counter(LETTERS.findall(text.lower())) if text else Counter()


class Lattice:
    """Forward and backward sums over the segmentations of many words at once."""

    def __init__(self, pieces: list[str]):
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)
        self.unknown = len(pieces)  # row of single letters outside the vocabulary; the next row is zero

    def table(self, p: np.ndarray) -> np.ndarray:
        k = p.shape[1]
        return np.concatenate([p, np.full((1, k), UNKNOWN), np.zeros((1, k))])

    def groups(self, ws: list[str]):
        """(positions in ws, their words with the mark) for the words of each length."""
        by = defaultdict(list)
        for i, w in enumerate(ws):
            by[len(w) + 1].append(i)
        for n, at in by.items():
            step = max(1, 400_000 // n)
            for lo in range(0, len(at), step):
                part = at[lo : lo + step]
                yield np.array(part), [MARK + ws[i] for i in part]

    def pieces(self, marked: list[str], e: int):
        """(length, piece ids) of the pieces that end at e, in words of one length; lengths that no word has are left out."""
        get = self.ids.get
        for size in range(1, min(e, self.longest) + 1):
            miss = self.unknown if size == 1 else self.unknown + 1
            got = [get(w[e - size : e], miss) for w in marked]
            if size == 1 or any(x != miss for x in got):
                yield size, np.array(got, np.int64)

    def score(self, ws: list[str], table: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language."""
        out = np.zeros((len(ws), table.shape[1]))
        for at, marked in self.groups(ws):
            last = deque([np.ones((len(at), table.shape[1]))], self.longest)  # sums up to the last places, newest last
            scale = np.zeros((len(at), table.shape[1]))
            for e in range(1, len(marked[0]) + 1):
                total = np.zeros_like(scale)
                for size, ids in self.pieces(marked, e):
                    total += last[-size] * table[ids]
                last.append(total)
                if e % 16 == 0:
                    top = np.max(last, axis=0)
                    for a in last:
                        a /= top
                    scale += np.log(top)
            out[at] = np.log(last[-1]) + scale
        return out


def fit(counts: list[tuple[str, str, int]], pieces: list[str], rounds: int = ROUNDS):
    """(languages, table of piece probabilities) from (language, word, count)."""
    langs = sorted({x[0] for x in counts})
    lattice = Lattice(pieces)
    k, v = len(langs), len(pieces)
    p = np.full((v, k), 1.0 / max(v, 1))
    ws = sorted({x[1] for x in counts})
    place, of = {w: i for i, w in enumerate(ws)}, {x: i for i, x in enumerate(langs)}
    weight = np.zeros((len(ws), k))
    for lang, w, n in counts:
        weight[place[w], of[lang]] += n
    groups = [(at, len(m[0]), {(e, size): ids for e in range(1, len(m[0]) + 1) for size, ids in lattice.pieces(m, e)}) for at, m in lattice.groups(ws)]
    for _ in range(rounds):
        with np.errstate(divide="ignore", invalid="ignore"):
            logs, seen = np.log(lattice.table(p)), np.zeros((v + 2, k))
            for at, n, cuts in groups:
                a = np.full((n + 1, len(at), k), -np.inf)
                a[0] = 0
                for (e, size), ids in cuts.items():
                    a[e] = np.logaddexp(a[e], a[e - size] + logs[ids])
                b = np.full_like(a, -np.inf)
                b[n] = 0
                for (e, size), ids in reversed(cuts.items()):
                    b[e - size] = np.logaddexp(b[e - size], b[e] + logs[ids])
                for (e, size), ids in cuts.items():
                    share = np.exp(a[e - size] + logs[ids] + b[e] - a[n])
                    np.add.at(seen, ids, np.nan_to_num(share) * weight[at])
        seen = seen[:v] + SMOOTH
        p = seen / seen.sum(axis=0)
    return langs, lattice.table(p)


def train(docs: DataFrame, pieces: list[str], sample: int = SAMPLE):
    """The word counts of at most `sample` documents (one of each language at least) come to the driver."""
    own = docs.where("lang is not null and text is not null and doc_id is not null").where(crc_mod5(F.col("doc_id")) != 0)
    own = own.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    sizes = own.groupBy("lang").agg(F.count("*").alias("rows"))
    several = sizes.count()
    each = min(1000, max(1, sample // max(several, 1)))
    # hashes are even, so about four times what is needed lies below this share of them: nothing else is shuffled
    low = (F.col("h").cast("double") / 2.0**64 + 0.5) * F.col("rows") <= 4.0 * each + 40
    few = own.select("lang", "h").join(F.broadcast(sizes) if several <= FEW_LANGUAGES else sizes, "lang").where(low)
    order = F.row_number().over(Window.partitionBy("lang").orderBy("h"))  # cut to `each` rows a language before the shuffle
    chosen = few.select("lang", "h", order.alias("place")).where(F.col("place") <= each).select("lang", "h").distinct()
    rows = own.join(F.broadcast(chosen), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("lang", "text")

    def run(batches):
        for batch in bounded(batches, 1):
            total = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w, n in words(text).items():
                    if len(w) <= LONGEST:
                        total[lang, w] += n
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in total], pa.string()), pa.array([x[1] for x in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["lang", "word", "n"])

    got = rows.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    return fit(list(zip(*(got[c].to_pylist() for c in ("lang", "word", "n")), strict=True)), pieces)


def identify(docs: DataFrame, langs: list[str], table: np.ndarray, pieces: list[str]) -> DataFrame:
    """docs with lang_pred and score."""
    held = docs.sparkSession.sparkContext.broadcast((langs, table, pieces))
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index("text")

    def run(batches):
        langs, table, pieces = held.value
        lattice, known, logs, size = Lattice(pieces), {}, np.zeros((0, len(langs))), 0
        for batch in bounded(batches, at):
            counted = [words(t) for t in batch.column(at).to_pylist()] if langs else [{}] * batch.num_rows
            if size > KNOWN_BYTES:
                known, logs, size = {}, logs[:0], 0
            new = list({w for c in counted for w in c if w not in known})
            logs = np.concatenate([logs, lattice.score(new, table)])
            known |= {w: len(known) + i for i, w in enumerate(new)}
            size += sum(4 * len(w) + 200 for w in new)
            preds, scores = [], np.zeros(batch.num_rows)
            for i, c in enumerate(counted):
                if not c:
                    preds.append("und")
                    continue
                total = np.array(list(c.values()), np.float64) @ logs[[known[w] for w in c]]
                best = int(total.argmax())
                preds.append(langs[best])
                scores[i] = 1 / np.exp(total - total[best]).sum()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    schema = docs.withColumns({"lang_pred": F.lit(None).cast("string"), "score": F.lit(None).cast("double")}).schema
    return docs.mapInArrow(run, schema)
