"""Personal data by boosted candidates.

**Base spans.** E-mail addresses, IP addresses, card and phone numbers by fixed patterns and checks,
leftmost and without overlap within a kind. They are always redacted.

**Candidates.** High-recall generators propose overlapping spans of each kind: addresses with
spelled-out or spaced signs, and every stretch of digit groups, with any separators, that has as many
digits as a kind allows. Features describe the format of a span (digits, groups, separators, check digits) and its
context (neighbouring characters, words before it). Trees are boosted for each kind on the candidates of all
different texts, equal ones counted together, and each kind by itself, so that copies and kinds
with many candidates crowd out nobody. Those that are base spans are right. Wrong are only those that a check refutes: a
part of a longer word or number, a card without its check digit, an address with a part over 255, a quad or what
meets a date or goes on as a phone, what lies in a base span of another kind. All others are what the trees are to judge, and don't train. A right span
is shown a second time without the mark that its pattern asks for (the plus sign, the at sign, the separators of a card
or quad), so that the trees must weigh the rest, and a candidate is judged with and without, the higher one counts. Probabilities are calibrated on a held-out quarter, and a kind's
threshold is the lowest one with the wanted precision there. A kind with under ``LEAST_TRAIN``
candidates to train on or ``LEAST_HELD`` held-out ones, or none right among the first, takes the
fixed weights of ``PRIORS`` and the threshold ``PRIOR_THRESHOLD`` instead, at every size of table.

**Selection.** Candidates over the threshold that no check refutes and that touch no base span are added, the most probable
first, without overlap.

Defined results: a null text has no spans; it stays null when redacted. Positions are code points.
"""

from __future__ import annotations

import bisect
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions.vectors import matrix
from themeloom.lineage import Workspace
from themeloom.llm.boosting import BINS, Boosted, Rows, bend, boost, counted, cuts_of, grow, start_of, threshold_for
from themeloom.llm.tokens import batch_udf, free_names

KINDS = ("email", "ip", "card", "phone")
ROWS_ON_DRIVER = 200_000  # different rows that the trees are grown from at once; more are summed up by Spark, level by level
TREES = 30
PRECISION = 0.995
LEAST_TRAIN = 50
LEAST_HELD = 20

# Numbers of digits.
CARD_DIGITS = (13, 19)
PHONE_DIGITS = (9, 15)

SPANS = "struct<base: array<struct<kind: string, s: int, e: int>>, added: array<struct<kind: string, s: int, e: int, p: double>>>"

# The patterns that define base spans, in forms that never go back over a run.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_AT = re.compile(r"@|[(\[{] ?at ?[)\]}]", re.I)
_HOST = re.compile(r" {0,2}([\w-]{1,63}(?: {0,2}(?:\.|[(\[{] ?dot ?[)\]}]) {0,2}[\w-]{1,63})+)", re.I)
_NUMBER = re.compile(r"[+(]?[0-9](?:[ ().\-/]{0,3}[0-9])++")
_GROUP = re.compile(r"[0-9]+")
_MORE_AFTER, _MORE_BEFORE = re.compile(r"[-./][0-9]"), re.compile(r"[0-9][-./]$")
_DATE = re.compile(r"(?<![0-9])[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}(?![0-9])")
_QUAD = re.compile(r" {0,3}\. {0,3}".join([r"([0-9]+)"] * 4))
_SPELLED = re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64} at [\w-]{1,63}(?: dot [\w-]{1,63})*? dot (?:com|org|net|edu|gov|int|mil|info|biz|name|[a-z]{2})\b", re.I)
_SOME = re.compile(r"[0-9@]|[(\[{] ?at ?[)\]}]| dot ", re.I)
_WORDS = {
    "email": re.compile(r"mail|contact|write|address", re.I),
    "ip": re.compile(r"\bip\b|host|server|addr|client", re.I),
    "card": re.compile(r"card|visa|credit|debit|payment|amex", re.I),
    "phone": re.compile(r"phone|tel|call|fax|mobil|dial", re.I),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += (d if k % 2 == 0 else d * 2 - 9 * (d > 4))
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind, then start."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append(("email", start, found.end()))
            free = found.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if PHONE_DIGITS[0] <= sum(map(str.isdigit, m.group())) <= PHONE_DIGITS[1]:
                out.append(("phone", m.start(), m.end()))
    return out


class Places:
    """Stretches of a text, joined where they touch; which of them others overlap is found by bisection."""

    def __init__(self, spans=()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def touch(self, s: int, e: int) -> bool:
        at = bisect.bisect_left(self.starts, e) - 1
        return at >= 0 and self.ends[at] > s

    def add(self, s: int, e: int) -> None:
        at = bisect.bisect_left(self.starts, s)
        self.starts.insert(at, s)
        self.ends.insert(at, e)


def refuted(text: str, kind: str, start: int, end: int) -> bool:
    """Whether a check rules a candidate out."""
    if text[start - 1 : start].isalnum() or text[end : end + 1].isalnum():
        return True
    span = text[start:end]
    quad = _QUAD.fullmatch(span)
    if kind == "card":
        return not luhn("".join(c for c in span if c.isdigit()))
    if kind == "ip":
        return quad is None or any(len(p.lstrip("0")) > 3 or int(p) > 255 for p in quad.groups())
    if kind == "phone":
        # A stretch of a longer number with the same separators is no number of its own.
        if _MORE_AFTER.match(text, end) or _MORE_BEFORE.search(text, max(0, start - 2), start):
            return True
        return quad is not None or any(m.start() < end and start < m.end() for m in _DATE.finditer(text, max(0, start - 10), end + 10))
    return not re.search(r"[^\W\d_]{2,}$", span)


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping proposals of all generators. A phone number without a plus sign has separators or a hint before it."""
    out = {("email", m.start(), m.end()) for m in _SPELLED.finditer(text)}
    for m in _AT.finditer(text):
        host = _HOST.match(text, m.end())
        if not host:
            continue
        end = host.end()
        start = m.start()
        gap = start
        while gap > 0 and text[gap - 1] == " " and start - gap < 2:
            gap -= 1
        low = gap
        while low > 0 and gap - low < 64 and text[low - 1] in _LOCAL:
            low -= 1
        if low < gap:
            out.add(("email", low, end))
            short = re.match(r" {0,2}[\w-]+(?:\.[\w-]+)*", text[m.end() : end])
            if short:
                out.add(("email", low, m.end() + short.end()))
    for m in _NUMBER.finditer(text):
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in _GROUP.finditer(m.group())]
        for a, (start, _) in enumerate(groups):
            opened = start - 1 if start > m.start() and text[start - 1] in "(+" else start
            digits = 0
            for low, high in groups[a:]:
                # No kind has more digits; every end within them is proposed.
                digits += high - low
                if digits > CARD_DIGITS[1]:
                    break
                if PHONE_DIGITS[0] <= digits <= PHONE_DIGITS[1] and (
                    low > start or text[opened] == "+" or _WORDS["phone"].search(text, max(0, start - 24), start)
                ):
                    out.add(("phone", opened, high))
                if digits >= CARD_DIGITS[0]:
                    out.add(("card", start, high))
            if a + 4 <= len(groups):
                out.add(("ip", start, groups[a + 3][1]))
    return sorted(out)


def features(text: str, kind: str, start: int, end: int, masked: bool = False) -> list[float]:
    """Format and context of a candidate; ``masked`` hides the mark of its pattern: the sign, or the separators of a card or quad."""
    span = text[start:end]
    if masked and kind in ("card", "ip"):
        span = ("" if kind == "card" else ".").join(_GROUP.findall(span))
    before, after = text[max(0, start - 24) : start], text[end : end + 1]
    digits = [len(g) for g in _GROUP.findall(span)] or [0]
    number = "".join(c for c in span if c.isdigit())
    letters = sum(c.isalpha() for c in span)
    parts = span.split(".")
    last = before[-1:] or "\n"
    return [
        len(span), sum(digits), len(digits), max(digits), min(digits), digits[-1], digits[0], letters,
        span.count(" "), span.count("-"), span.count("."), span.count("(") + span.count("["), span.count("/"),
        0.0 if masked else float("@" in span), 0.0 if masked else float(span[:1] == "+"),
        float(span.count("(") == span.count(")")), float(len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)),
        float(13 <= len(number) <= 19 and luhn(number)), float(number[:1] == "0"),
        float(last.isalnum()), float(last in "+(.-"), float(last in "=#\"'$€£v"), float(after.isalnum()), float(after in "%-/" if after else 0),
        float(bool(_WORDS[kind].search(before))), float(bool(re.search(r"\b(?:at|dot)\b", span, re.I))),
        float(len(parts[-1]) if letters else 0), float("  " in span),
    ]


# Names of the features, in their order.
NAMES = (
    "length", "digits", "groups", "longest", "shortest", "last", "first", "letters", "spaces", "hyphens", "dots", "opened",
    "slashes", "at_sign", "plus", "balanced", "quad", "luhn", "zero", "after_word", "after_sign", "after_mark", "before_word",
    "before_sign", "hint", "spelled", "last_part", "two_spaces",
)
# Constant and weights of a kind without enough examples. Addresses need a spelled-out or
# an at sign, the others a hint word before them and the digits of their format, apart from words.
PRIORS = {
    "email": {"": -3.0, "at_sign": 3.5, "spelled": 3.5, "hint": 2.0, "after_word": -4.0, "before_word": -4.0},
    "ip": {"": -3.0, "hint": 4.0, "dots": 2.0, "longest": -2.0, "after_word": -4.0, "after_sign": -4.0, "before_word": -4.0},
    "card": {"": -6.0, "luhn": 4.0, "hint": 3.0, "after_word": -4.0, "after_sign": -4.0, "before_word": -4.0},
    "phone": {
        "": -6.0, "hint": 5.0, "groups": 0.6, "balanced": 0.5, "slashes": -2.0, "quad": -3.0, "longest": -0.2,
        "after_word": -4.0, "after_mark": -2.0, "before_word": -4.0, "before_sign": -2.0,
    },
}
PRIOR_THRESHOLD = 0.6


class Prior(NamedTuple):
    """Logistic model of fixed weights."""

    weights: dict[str, float]

    def probability(self, x: np.ndarray) -> np.ndarray:
        own = np.array([self.weights.get(name, 0.0) for name in NAMES])
        return 1 / (1 + np.exp(-(self.weights[""] + np.asarray(x, float) @ own)))


class Detector(NamedTuple):
    models: dict[str, Boosted | Prior]
    threshold: dict[str, float]


def _examples(batches):
    """Rows (kind, right, features, document, place in it) of the candidates of a task."""
    for batch in batches:
        kinds, right, rows, docs, places_in = [], [], [], [], []
        for doc, text in zip(batch["h"].to_pylist(), batch["text"].to_pylist()):
            if not text or not _SOME.search(text):
                continue
            before = len(rows)
            base = set(base_spans(text))
            places = {kind: Places([(s, e) for k, s, e in base if k == kind]) for kind in KINDS}
            for c in candidates(text):
                if c not in base:
                    if places[c[0]].touch(*c[1:]):
                        continue  # another boundary of a right span teaches nothing about its kind
                    if not refuted(text, *c) and not any(p.touch(*c[1:]) for p in places.values()):
                        continue
                for masked in (False, True) if c in base else (False,):
                    kinds.append(c[0])
                    right.append(c in base)
                    rows.append(features(text, *c, masked=masked))
                    docs.append(doc)
                    places_in.append(len(rows) - before)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kinds, pa.string()), pa.array(right, pa.bool_()), pa.array(rows, pa.list_(pa.float64())), pa.array(docs, pa.int64()), pa.array(places_in, pa.int32())],
            ["kind", "right", "x", "h", "n"],
        )


def _level_sums(rows: DataFrame, cuts: list[np.ndarray], start: float):
    """What ``grow`` asks for, added up by Spark: a task gives out at most a row for each node, feature and bin."""

    def sums(model: Boosted, feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
        shape = (2**level, len(cuts), BINS + 1, 2)

        def add_up(batches):
            total = np.zeros(shape, np.int64)
            for batch in batches:
                if batch.num_rows:
                    y, weight = batch["right"].to_numpy(zero_copy_only=False).astype(float), batch["n"].to_numpy()
                    total += Rows(matrix(batch["x"]), y, weight, cuts, start).sums(model, feature, cut, level).astype(np.int64)
            flat = total.reshape(-1, 2)
            some = np.flatnonzero(flat.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[some, 0]), pa.array(flat[some, 1])], ["slot", "g", "h"])

        each = rows.select("right", "x", "n").mapInArrow(add_up, "slot long, g long, h long")
        out = np.zeros((int(np.prod(shape[:3])), 2))
        for r in each.groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            out[r["slot"]] = r["g"], r["h"]
        return out.reshape(shape)

    return sums


def _fit_kind(rows: DataFrame, train: int, right: int, at_once: bool, precision: float, trees: int) -> tuple[Boosted, float]:
    """Trees and threshold from all rows (held, right, x, n) of a kind, read at once or summed up by Spark."""
    if at_once:
        own = rows.toArrow()
        x, y, weight = matrix(own["x"]), own["right"].to_numpy().astype(float), own["n"].to_numpy().astype(float)
        held = own["held"].to_numpy()
        model = boost(x[~held], y[~held], trees, weight=weight[~held])
        code, n = counted(np.rint(model.margin(x[held]) * 2048) + y[held], weight[held])
    else:
        fitted = rows.filter("not held")
        values = fitted.select(F.posexplode("x").alias("f", "value"), "n").groupBy("f", "value").agg(F.sum("n").alias("n"))
        # A row for each value of a feature, and these are lengths and counts of digits and signs.
        table = values.orderBy("f", "value").toArrow()
        feature, value, n = (table[c].to_numpy() for c in ("f", "value", "n"))
        cuts = [cuts_of(value[feature == f], n[feature == f]) for f in range(len(NAMES))]
        start = start_of(right, train)
        model = grow(_level_sums(fitted, cuts, start), cuts, start, trees)

        def scored(batches):
            for batch in batches:
                y = batch["right"].to_numpy(zero_copy_only=False).astype(float)
                code = np.rint(model.margin(matrix(batch["x"])) * 2048) + y if batch.num_rows else y
                yield pa.RecordBatch.from_arrays([pa.array(code), batch["n"]], ["code", "n"])

        codes = rows.filter("held").select("right", "x", "n").mapInArrow(scored, "code double, n long").groupBy("code").agg(F.sum("n").alias("n"))
        table = codes.orderBy("code").toArrow()
        code, n = table["code"].to_numpy(), table["n"].to_numpy().astype(float)
    # Margins are multiples of 1/1024, so that a code, twice as fine, holds the margin and whether it is right.
    y = np.mod(code, 2)
    margin = (code - y) / 2048
    model = bend(model, margin, y, n)
    p = 1 / (1 + np.exp(-np.clip(model.bend[0] + model.bend[1] * margin, -35, 35)))
    return model, threshold_for(p, y, precision, weight=n)


def fit_detector(
    docs: DataFrame, text: str = "text", sample_docs: int | None = None, sample_rows: int | None = None,
    precision: float = PRECISION, rows_on_driver: int = ROWS_ON_DRIVER, trees: int = TREES,
) -> Detector:
    """Boosted trees and thresholds from the candidates of all different texts; fixed weights where they are too few.

    Equal candidates are counted by Spark. Up to ``rows_on_driver`` different ones are read at once; of more, Spark adds
    up what each level of a tree needs, with the same result. ``sample_docs`` asks for a sample of about so many different texts,
    ``sample_rows`` for one of at most so many rows, with equal parts for the kinds.
    """
    rows = docs.select(F.col(text).alias("text"), F.xxhash64(text).alias("h")).filter("text IS NOT NULL")
    if sample_docs is not None:
        share = min(1.0, sample_docs / max(1, rows.select("h").distinct().count()))
        rows = rows.filter(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)))
    # Copies of a text give the same rows, which count once.
    made = rows.mapInArrow(_examples, "kind string, right boolean, x array<double>, h bigint, n int").distinct()
    if sample_rows is not None:
        # The bound on rows of a kind; which ones go is decided by a hash.
        order = Window.partitionBy("kind").orderBy(F.xxhash64("h", "kind", "x"))
        made = made.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= sample_rows // len(KINDS))
    held = (F.pmod("h", F.lit(4)) == 0).alias("held")
    equal = made.groupBy("kind", held, "right", "x").agg(F.count("*").alias("n"))
    equal = Workspace(docs.sparkSession, "pii").save(equal, "examples")
    seen = equal.groupBy("kind", "held", "right").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()
    models, threshold = {}, {}
    for kind in KINDS:
        own = [r for r in seen if r["kind"] == kind]
        train, test = (sum(r["n"] for r in own if r["held"] == held) for held in (False, True))
        right = sum(r["n"] for r in own if r["right"] and not r["held"])
        if train < LEAST_TRAIN or test < LEAST_HELD or not right:
            models[kind], threshold[kind] = Prior(PRIORS[kind]), PRIOR_THRESHOLD
            continue
        at_once = sum(r["rows"] for r in own) <= rows_on_driver // len(KINDS)
        models[kind], threshold[kind] = _fit_kind(equal.filter(F.col("kind") == kind), train, right, at_once, precision, trees)
    return Detector(models, threshold)


def find(text: str, detector: Detector) -> tuple[list, list]:
    """Base spans, and added spans with their probabilities."""
    if not text or not _SOME.search(text):
        return [], []
    base = base_spans(text)
    taken = Places([(s, e) for _, s, e in base])
    by_kind: dict[str, list] = {}
    for c in candidates(text):
        if not taken.touch(*c[1:]) and not refuted(text, *c):
            by_kind.setdefault(c[0], []).append(c)
    likely = []
    for kind, own in by_kind.items():
        seen = [features(text, *c, masked=m) for m in (False, True) for c in own]
        p = detector.models[kind].probability(np.array(seen, float)).reshape(2, -1).max(0)
        likely += [(-q, *c) for q, c in zip(p.tolist(), own) if q >= detector.threshold[kind]]
    added, filled = [], Places()
    for q, kind, s, e in sorted(likely):
        if not filled.touch(s, e):
            filled.add(s, e)
            added.append((kind, s, e, -q))
    return base, sorted(added, key=lambda a: (KINDS.index(a[0]), a[1]))


def spans(detector: Detector, spark, text: Column) -> Column:
    shared = spark.sparkContext.broadcast(detector)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32())]))
    added = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32()), ("p", pa.float64())]))

    def make(column: pa.Array) -> pa.Array:
        own = shared.value
        found = [find(t, own) for t in column.to_pylist()]
        return pa.StructArray.from_arrays(
            [
                pa.array([[{"kind": k, "s": s, "e": e} for k, s, e in b] for b, _ in found], kind),
                pa.array([[{"kind": k, "s": s, "e": e, "p": p} for k, s, e, p in a] for _, a in found], added),
            ],
            ["base", "added"],
        )

    return batch_udf(SPANS, make)(text)


def written(found: Column) -> Column:
    """``kind:start:end`` of spans, by kind, then start, comma-joined."""
    order = F.transform(
        found, lambda x: F.struct(
            F.array_position(F.lit(list(KINDS)), x["kind"]).alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")
        )
    )
    return F.array_join(F.transform(F.array_sort(order), lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def all_spans(found: Column) -> Column:
    plain = F.transform(found["added"], lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    return F.concat(found["base"], plain)


def redact(docs: DataFrame, text: str = "text", detector: Detector | None = None, **fit) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans share one mark."""
    detector = detector or fit_detector(docs, text, **fit)

    def cut(column: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for t, own in zip(column.to_pylist(), found.to_pylist()):
            at, kept = 0, []
            for x in sorted(own or [], key=lambda x: (x["s"], -x["e"])):
                if x["s"] >= at:
                    kept += [t[at : x["s"]], f"[{x['kind'].upper()}]"]
                at = max(at, x["e"])
            out.append(None if t is None else "".join([*kept, t[at:]]))
        return pa.array(out, pa.string())

    (name,) = free_names(["_spans"], docs.columns)
    found = docs.withColumn(name, spans(detector, docs.sparkSession, F.col(text)))
    return found.withColumn(text, batch_udf("string", cut)(F.col(text), all_spans(F.col(name)))).select(docs.columns)
