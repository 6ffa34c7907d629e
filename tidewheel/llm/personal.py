"""Personal data: generators propose spans, boosted trees and calibrated thresholds select.

Generators look only at runs of characters that can hold a candidate and read each run once, so long lines
cost no more than short ones. The four base kinds (email, ip, card, phone) follow fixed formats: leftmost,
not overlapping within a kind, failing matches dropped without a retry. Wider generators propose further,
overlapping candidates: national phone numbers (3-3-4, with a leading 0 in two to five groups, nine digits
from 6 on), social security numbers, account numbers with a country code, cards of 4-4-4-4 or 4-6-5 digits
with up to three blanks, dots or hyphens between groups, and addresses whose @ or dots are blanked,
bracketed or spelt.

Every candidate, base ones as well, is described by its format and its context (words that go with personal
data, words that go with orders, parts and versions, digits around it) and scored by boosted trees that are
trained on generated examples with a fixed seed. The examples hold well-formed numbers in innocent contexts
as negatives, and a share of those in contexts that say nothing. A kind's threshold is the lowest at which
PRECISION of the candidates taken from a held-out set are right. Base spans stay whatever their score, which
is given in `scores`; of added spans that overlap a base span or a better one none is taken.

Null and empty texts have no spans. Texts are read whole, whatever their length. Offsets are code points, ends
exclusive. Candidates of equal score are taken in order of their place. Repeated rows are judged alike, an empty
table gives no rows, extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, insort
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boost import Boosted, fit
from .secrets import span_columns

BASE = ("email", "ip", "card", "phone")
ADDED = ("national_phone", "ssn", "iban", "loose_card", "loose_email")
KINDS = BASE + ADDED
PRECISION, NEUTRAL = 0.95, 0.12
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Runs of characters that no candidate made of digits leaves.
_NUMBER_RUN = re.compile(r"[\x20().0-9+-]{7,}")
_DIGITS = re.compile(r"[0-9]")
_WIDE = (
    ("national_phone", re.compile(r"(?<![0-9])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")),
    ("national_phone", re.compile(r"(?<![0-9])(?=(\(?0[0-9]{1,4}\)?(?:[\x20.-][0-9]{2,8}){1,4})(?![0-9]))")),
    ("national_phone", re.compile(r"(?<![0-9])(?=([6-9][0-9]{1,2}(?:[\x20.-][0-9]{2,3}){2,3})(?![0-9]))")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("loose_card", re.compile(r"(?<![0-9])(?=([0-9]{4}(?:[\x20.-]{1,3}[0-9]{4}){3}|[0-9]{4}[\x20.-]{1,3}[0-9]{6}[\x20.-]{1,3}[0-9]{5})(?![0-9]))")),
)
_GROUPS, _GROUPS_OF_LETTERS = re.compile(r"[0-9]+"), re.compile(r"[A-Za-z]+")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_IBAN_HINT = re.compile(r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]{12}")
_AT = r"(?:\x20{0,2}[\[({]\x20?at\x20?[\])}]\x20{0,2}|\x20{1,2}@\x20{0,2}|@\x20{1,2})"
_DOT = r"(?:\x20{0,2}[\[({]\x20?dot\x20?[\])}]\x20{0,2}|\x20{1,2}dot\x20{1,2})"
_HOST = r"[a-z0-9-]{1,63}"
_ADDRESS = re.compile(rf"(?<![a-z0-9._%+-])[a-z0-9][a-z0-9._%+-]{{0,63}}(?:{_AT}{_HOST}(?:(?:{_DOT}|\.){_HOST})*(?:{_DOT}|\.)|(?:@|\x20{{1,2}}at\x20{{1,2}}){_HOST}(?:(?:{_DOT}|\.){_HOST})*{_DOT})[a-z]{{2,24}}(?![a-z0-9])", re.IGNORECASE)
_ADDRESS_HINT = re.compile(rf"\x20@|@\x20|[\[({{]\x20?at\x20?[\])}}]|(?:@|\x20at\x20{{1,2}})[a-z0-9.-]{{1,255}}(?:\x20{{0,2}}[\[({{]\x20?dot|\x20{{1,2}}dot)", re.IGNORECASE)
ENDINGS = frozenset("com org net edu gov io info co uk us de fr es it nl ch at eu ca au jp in br pl ru se".split())
CUES = ("phone", "tel", "call", "mobile", "fax", "ssn", "social", "security", "iban", "account", "bank", "card", "contact", "mail", "reach", "write", "address", "host", "login")
INNOCENT = ("order", "serial", "version", "lot", "item", "part", "model", "ref", "invoice", "ticket", "tracking", "release", "build", "batch", "isbn", "article", "sku", "shipped", "pump", "chapter", "section", "case no", "catalog", "edition")
_CUES, _INNOCENT = (re.compile("|".join(rf"\b{w}" for w in words)) for words in (CUES, INNOCENT))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGITS.findall(s))


def base_spans(text: str):
    """(start, kind number, end) of the base kinds."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:  # each @ with the run of address characters before it and the domain after it, both short of the next @
        before = text[free:at]
        a = free + len(before.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if a < at else None
        if domain:
            out.append((a, 0, domain.end()))
        free = domain.end() if domain else at + 1
        at = text.find("@", max(free, at + 1))
    for run in _NUMBER_RUN.finditer(text):
        part = run.group().rstrip("\x20().+-")
        a = run.start() + len(part) - len(part := part.lstrip("\x20).-"))
        if len(part) < 7:
            continue
        if part.count(".") >= 3:
            for m in _CHAIN.finditer(part):  # each four numbers of a chain are a match
                groups = [(g.start(), g.end()) for g in _GROUPS.finditer(m.group())] if m.group().count(".") >= 3 else []
                for j in range(0, len(groups) - 3, 4):
                    four = groups[j : j + 4]
                    if all(len(x := m.group()[p:q].lstrip("0")) <= 3 and int(x or "0") <= 255 for p, q in four):
                        out.append((a + m.start() + four[0][0], 1, a + m.start() + four[3][1]))
        if len(part) >= 12:
            for m in _CARD.finditer(part):
                if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                    out.append((a + m.start(), 2, a + m.end()))
        if "+" in part:
            out += [(a + m.start(), 3, a + m.end()) for m in _PHONE.finditer(part) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(out)


def candidates(text: str):
    """(start, end, kind) of the wide generators."""
    for run in _NUMBER_RUN.finditer(text):
        if run.end() - run.start() >= 10 and _DIGITS.search(run.group()):
            part = text[max(0, run.start() - 1) : run.end() + 1]
            a = max(0, run.start() - 1)
            for kind, rule in _WIDE:
                for m in rule.finditer(part):
                    p, q = m.span(rule.groups)
                    if not rule.groups or kind != "national_phone" or 9 <= len(_digits(m.group(1))) <= 11:
                        yield a + p, a + q, kind
    if _IBAN_HINT.search(text):
        for m in _IBAN.finditer(text):
            yield m.start(), m.end(), "iban"
    done = 0
    for hint in _ADDRESS_HINT.finditer(text):  # the name before a hint is where an address begins
        name = text[max(0, hint.start() - 68) : hint.start()].rstrip(" ")
        a = max(0, hint.start() - 68) + len(name.rstrip(_LOCAL))
        own = name[len(name.rstrip(_LOCAL)) :].lstrip("._%+-")
        a += len(name) - len(name.rstrip(_LOCAL)) - len(own) if own else 0
        if own and a >= done and (m := _ADDRESS.match(text, a, min(len(text), a + 400))):
            done = m.end()
            yield m.start(), m.end(), "loose_email"


def features(text: str, a: int, z: int, kind: str) -> tuple[float, ...]:
    return _features(text[a:z], text[max(0, a - 40) : a], text[z : z + 20], kind)


@lru_cache(maxsize=50_000)
def _features(span: str, before: str, after: str, kind: str) -> tuple[float, ...]:
    digits, before, after = _digits(span), before.lower(), after.lower()
    iban = 0.0
    if kind == "iban":
        turned = span.replace(" ", "")
        iban = float(int("".join(str(int(c, 36)) for c in turned[4:] + turned[:4])) % 97 == 1)
    area = digits[:3]
    groups = [len(g) for g in _GROUPS.findall(span)]
    ending = _GROUPS_OF_LETTERS.findall(span)[-1:] if "mail" in kind else []
    cue = max((m.end() for m in _CUES.finditer(before)), default=0)  # nearest to the span
    odd = max((m.end() for m in _INNOCENT.finditer(before)), default=0)
    return (
        float(len(span)), float(len(digits)), float(len(set(digits))), float(span.count(" ")), float(span.count("-")), float(span.count(".")), float("(" in span),
        iban, float(area in ("000", "666") or area >= "900"), float(digits[:1] in ("0", "1")), float(digits[3:4] in ("0", "1")),
        float(digits[3:5] == "00" or digits[5:] == "0000"), float(cue > 0), float(odd > 0), float(cue - odd), float(bool(_INNOCENT.search(after))), float(bool(_CUES.search(after))),
        float(sum(c.isdigit() for c in before[-12:])), float(sum(c.isdigit() for c in after[:12])), float(before[-1:].isalnum()), float(before[-1:] in "+$€£#"), float(before[-1:] == "v"),
        float(luhn(digits)), float(len(groups)), float(groups[0] if groups else 0), float(groups[1] if len(groups) > 1 else 0), float(groups[-1] if groups else 0),
        float(digits[:2] in ("19", "20")), float(digits[:1] in ("3", "4", "5", "6")), float(any(e.lower() in ENDINGS for e in ending)), float(any(c in span for c in "[({@")), float(digits[:1] == "0"), float(digits[:2] == "00"),
        *(float(kind == k) for k in KINDS),
    )


def _examples(seed: int, n: int = 9000):
    """Generated texts with one candidate each, and whether it is personal data.

    A candidate is malformed, and then none; or well-formed, and then none where its context is innocent and in a
    NEUTRAL share of the contexts that say nothing.
    """
    r = random.Random(seed)

    def num(k, first="0123456789"):
        return r.choice(first) + "".join(r.choice("0123456789") for _ in range(k - 1))

    def card(real, first="3456"):
        shape = r.choice([(4, 4, 4, 4), (4, 4, 4, 4), (4, 6, 5)])
        body = num(sum(shape) - 1, "3" if len(shape) == 3 and first == "3456" else first)
        check = next(c for c in "0123456789" if luhn(body + c))
        body += check if real else r.choice([c for c in "0123456789" if c != check])
        return [body[sum(shape[:i]) : sum(shape[: i + 1])] for i in range(len(shape))]

    filler = ["the", "of", "this", "was", "then", "report", "page", "la", "und", "que", "with", "near", "old", "house", "see"]
    for _ in range(n):
        real, kind = r.random() < 0.75, r.choice(KINDS)
        crowd = ""
        if kind == "email":
            word = lambda k=8: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, k)))
            span = f"{word()}{r.choice(['', '.' + word()])}@{word(10)}.{r.choice(sorted(ENDINGS)) if real else num(3)}"
        elif kind == "ip":
            span = ".".join(str(r.randint(1, 255) if real else r.choice([0, 0, 1, 2, 3])) for _ in range(4))
        elif kind == "card":
            span = r.choice([" ", "-", ""]).join(card(True, "3456" if real else "01279"))
        elif kind == "phone":
            span = f"+{num(2, '123456789')} {num(3)} {num(3)} {num(4)}" if real else f"+{num(1)}.{num(8)}"
        elif kind == "national_phone" and r.random() < 0.6:
            sep = r.choice(" .-")
            area, shape = r.choice([("0", (2, 2, 2, 2, 2)), ("0", (3, 4, 4)), ("0", (4, 3, 4)), ("0", (5, 6)), ("0", (3, 8)), ("0", (4, 7)), ("0", (3, 3, 4)), ("0", (2, 3, 2, 2)), ("6789", (3, 2, 2, 2)), ("6789", (3, 3, 3)), ("6789", (2, 3, 2, 2))])
            first = area + r.choice("123456789") + num(3) if area == "0" else num(1, area) + num(3)
            span = sep.join([first[: shape[0]], *map(num, shape[1:])])
            if not real:
                other = r.random()
                if other < 0.4:
                    crowd = f"{num(2)}{sep}{num(3)}{sep}"  # a stretch of a row of numbers
                elif other < 0.7:
                    span = f"{r.randint(1, 9):02d}{sep}{r.randint(1, 12):02d}{sep}{r.choice(['19', '20'])}{num(2)} {r.randint(10, 23)}"
                else:
                    span = f"00{num(r.choice([1, 1, 2]))}{sep}{num(3)}{sep}{num(4)}"
        elif kind == "national_phone":
            sep = r.choice(" .-")
            span = f"({num(3, '23456789')}) {num(3, '23456789')}-{num(4)}" if r.random() < 0.4 else f"{num(3, '23456789')}{sep}{num(3, '23456789')}{sep}{num(4)}"
            if not real:
                span = f"{num(3, '01')}{sep}{num(3, '01')}{sep}{num(4)}"
        elif kind == "loose_card":
            sep = r.choice([".", "  ", " - ", "-", "   ", ". "])
            span = sep.join(card(real))
            if not real and r.random() < 0.5:
                span = sep.join(card(True, r.choice("012789"))) if r.random() < 0.5 else sep.join(r.choice(["19", "20"]) + num(2) for _ in range(4))
        elif kind == "loose_email":
            word = lambda k=8: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, k)))
            at, dot = r.choice([(" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "."), (" {at} ", " {dot} "), (" at ", " dot "), (" @ ", "."), (" @ ", " dot "), ("@", " dot ")])
            ending = r.choice(sorted(ENDINGS)) if at == " at " or r.random() < 0.8 else word(5)
            span = f"{word()}{r.choice(['', '.' + word(), str(r.randint(1, 99))])}{at}{word(12)}{dot}{ending}"
            if not real:
                span = f"{word()} at {word()} dot {next(w for w in iter(word, None) if w not in ENDINGS)}"
        elif kind == "ssn":
            span = f"{num(3, '12345')}-{r.choice('123456789')}{num(1)}-{num(4, '123456789')}" if real else f"{r.choice(['000', '666', '9' + num(2)])}-{num(2)}-{num(4)}"
        else:
            body = num(18)
            check = 98 - int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
            span = f"DE{check if real else (check + r.randint(1, 90)) % 97:02d}{body}"
        context = r.choice(("cue", "cue", "innocent", "neutral"))
        some = lambda k: [r.choice(filler) for _ in range(k)]
        before, after = some(r.randint(2, 4)), some(4)
        if context != "neutral":
            word = r.choice(CUES if context == "cue" else INNOCENT)
            if context == "innocent" and r.random() < 0.2:
                after.insert(0, word)
            else:
                before[-1:] = [r.choice([word, f"{word}:", f"{word.capitalize()}", f"{word} {r.choice(['no', 'is', 'number', '#', 'at'])}"]), *some(r.choice([0, 0, 0, 1]))]
        real = real and context != "innocent" and (context == "cue" or r.random() >= NEUTRAL)
        head = " ".join(before) + " "
        text = f"{head}{crowd}{span} {' '.join(after)}"
        a = len(head) + len(crowd)
        yield text, a, a + len(span), kind, real


def lowest_limit(score: np.ndarray, real: np.ndarray, precision: float) -> float:
    """The lowest score from which on `precision` of the candidates are real; 1 where there is none."""
    order = np.argsort(-score, kind="stable")
    right = np.cumsum(real[order]) / np.arange(1, len(order) + 1)
    last = np.r_[score[order][1:] != score[order][:-1], True] if len(order) else np.zeros(0, bool)  # equal scores go together
    good = np.flatnonzero((right >= precision) & last)
    return float(score[order][good[-1]]) if len(good) else 1.0


@cache
def train(seed: int = 3) -> tuple[Boosted, dict[str, float]]:
    own, other = list(_examples(seed)), list(_examples(seed + 1))
    model = fit(np.array([features(*x[:4]) for x in own]), np.array([float(x[4]) for x in own]), trees=80, depth=5)
    score = model.score(np.array([features(*x[:4]) for x in other]))
    kind, real = np.array([x[3] for x in other]), np.array([x[4] for x in other])
    return model, {k: lowest_limit(score[kind == k], real[kind == k], PRECISION) for k in KINDS}


def scored_spans(text: str, model: Boosted, limits: dict[str, float]):
    """(start, kind number, end, score) of the base spans and of the added ones that pass."""
    base = base_spans(text)
    more = list(candidates(text))
    if not base and not more:
        return []
    rows = [features(text, a, z, KINDS[k]) for a, k, z in base] + [features(text, *x) for x in more]
    alike = dict.fromkeys(rows)  # repeated lines have few kinds of candidates
    alike = dict(zip(alike, model.score(np.array(list(alike))).tolist(), strict=True))
    score = [alike[x] for x in rows]
    spans = [(*x, s) for x, s in zip(base, score, strict=False)]
    busy: list[tuple[int, int]] = []  # apart and in order
    for a, _, z in base:
        while busy and busy[-1][1] >= a and busy[-1][0] <= z:
            p, q = busy.pop()
            a, z = min(a, p), max(z, q)
        busy.append((a, z))
    for s, (a, z, kind) in sorted(zip(score[len(base) :], more, strict=True), key=lambda x: (-x[0], x[1])):
        i = bisect_left(busy, (a, a))
        if s >= limits[kind] and (i == 0 or busy[i - 1][1] <= a) and (i == len(busy) or busy[i][0] >= z):
            insort(busy, (a, z))
            spans.append((a, KINDS.index(kind), z, s))
    return sorted(spans)


def find_spans(text: str, model: Boosted, limits: dict[str, float]):
    return [x[:3] for x in scored_spans(text, model, limits)]


def find_personal(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores (of the spans, in their order)."""
    held = docs.sparkSession.sparkContext.broadcast(train())
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def spans_of(texts: pa.Array):
        model, limits = held.value
        for t in texts.to_pylist():
            yield scored_spans(t, model, limits) if t else []

    run = span_columns(KINDS, len(BASE), spans_of, scores=True)
    return docs.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string")
