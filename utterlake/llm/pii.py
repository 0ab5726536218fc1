"""Personal data: candidate spans scored by boosted trees, beside exact base patterns.

Generators with high recall propose spans that may overlap: address-like runs around ``@``, runs of
digits with their separators, whole, cut at blanks and cut at marks, and long runs of letters and
digits. Each is described by its format (kind of run, digits, groups, separators) and by its context
(neighbouring characters, words before it), never by the checks that decide about base spans (ranges,
check digits). Boosted trees learn from a bounded sample of documents which candidates pass their
check; calibrated probabilities at or above ``THRESHOLD`` make added spans, best first, as long as
they overlap no span that stands. Spans that the base patterns find always stand.

Labels are weak: an address, number or telephone number counts as found if a base pattern finds just that
span, or if its format is plausible and a word of its kind (tel, mail, card) stands before it, a secret
if an assignment to a telling name does. To learn what the base patterns miss, base spans are also written
in other ways in their place: telephone numbers without their country code, addresses without the dot,
card numbers with wide separators. Candidates in such formats that nothing speaks for are left out.

A null or empty text has no spans and an empty redacted text (null stays null). Repeated rows are
handled one by one. An empty table gives an empty result; a sample with one class only adds no spans.
Columns named in ``keep`` are carried, all others are left out.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlake.llm.boosting import Boosted, fit_boosted
from utterlake.llm.tables import lean, read

KINDS = ["email", "ip", "card", "phone", "secret"]
BASE_KINDS = KINDS[:4]
#: Documents that the trees may learn from, at most about this many.
SAMPLE_DOCS = 20_000
THRESHOLD = 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_RUN = re.compile(r"\+?\(?[0-9](?:[ ().-]{0,3}[0-9])+")
_LONG = re.compile(r"[A-Za-z0-9_+/=-]{16,}")
_AFTER = re.compile(r"[A-Za-z0-9.-]+")
_NAMED = re.compile(r"(?i)(?:token|secret|password|passwd|api[_-]?key|key)[\"']?\s*[=:]\s*[\"']?$")
#: Digits that a run of digits goes on with, on either side of a candidate.
_RUN_BEFORE = re.compile(r"[0-9+][ ().-]{0,3}$")
_RUN_AFTER = re.compile(r"[ ().-]{0,3}[0-9]")
_HOST = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+")
_NATIONAL = re.compile(r"\(?[0-9]{2,4}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}")
_WIDE = re.compile(r"[0-9]{4}(?:[ -]{2,3}[0-9]{1,4}){3,4}")
_CONTEXT = {
    "email": re.compile(r"(?i)mail\W*(?:to\W*)?$"),
    "card": re.compile(r"(?i)(?:card|visa)\W*$"),
    "phone": re.compile(r"(?i)(?:tel|phone|call|fax)[^\w(]*$"),
}


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        v = int(d) * (1 + n % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses; looks only around each ``@``, so long runs stay cheap."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            last = domain.end()
            out.append((begin, last))
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns, by kind, then by start; matches that fail their check are dropped."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if max(len(p.lstrip("0")) for p in m.group().split(".")) < 4 and max(map(int, m.group().split("."))) <= 255]
        for m in _CARD.finditer(text):
            if 13 <= m.end() - m.start() <= 40 and 13 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Proposed spans with the kind that their generator looks for; they may overlap."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
        last = 0
        for at in (m.start() for m in re.finditer("@", text)):
            begin = at
            while begin > last and text[begin - 1] in _LOCAL:
                begin -= 1
            after = _AFTER.match(text, at + 1)
            last = at + 1
            if begin < at and after:
                out.append(("email", begin, at + 1 + len(after.group().rstrip(".-"))))
    if _DIGIT.search(text):
        for m in _RUN.finditer(text):
            run, begin = m.group(), m.start()
            pieces = [(0, len(run))]
            for cut in (" ", " (-"):
                at = 0
                for part in re.split(f"[{re.escape(cut)}]+", run):
                    at = run.index(part, at)
                    pieces.append((at, at + len(part)))
                    at += len(part)
            for a, b in pieces:
                n = sum(c.isdigit() for c in run[a:b])
                if n < 4:
                    continue
                if run[a:b].count(".") >= 3:
                    out.append(("ip", begin + a, begin + b))
                if n >= 9 and "." not in run[a:b]:
                    out.append(("phone" if run[a] in "+(" else "card", begin + a, begin + b))
                if n >= 7:
                    out.append(("phone", begin + a, begin + b))
        out += [("secret", *m.span()) for m in _LONG.finditer(text) if _DIGIT.search(m.group())]
    return sorted(set(out), key=lambda s: (s[1], s[2], s[0]))


def describe(text: str, span: tuple[str, int, int]) -> list[float]:
    """Format and context of a candidate as numbers."""
    kind, a, b = span
    body, before, after = text[a:b], text[max(0, a - 24) : a], text[b : b + 8]
    groups = re.findall("[0-9]+", body)
    digits = sum(map(len, groups))
    left, right = before[-1:], after[:1]
    letters = sum(c.isalpha() for c in body)
    return [
        float(KINDS.index(kind)),
        float(b - a),
        float(digits),
        float(letters),
        float(len(groups)),
        float(max(map(len, groups), default=0)),
        float(min(map(len, groups), default=0)),
        float(body.count(".")),
        float(body.count("-")),
        float(body.count(" ")),
        float(body.count("(")),
        float(body[:1] == "+"),
        float(body.count("@")),
        float(len(body.rpartition("@")[2].split("."))),
        float(int(groups[0][:1]) if groups else -1),
        float(left.isalnum()),
        float(right.isalnum()),
        float(left in ("", " ", "\n")),
        float(right in ("", " ", "\n", ".", ",")),
        float(left in "\"'" and left != ""),
        float(bool(re.search("[=:]", before[-4:]))),
        float(letters and all(c in "0123456789abcdefABCDEF" for c in body)),
        float(len(set(body))),
        float(bool(re.search(r"(?i)(tel|phone|call|fax|mail|card|visa|ip|host|key|token|secret)", before))),
        float(bool(_RUN_BEFORE.search(before))),
        float(bool(_RUN_AFTER.match(after))),
    ]


def plausible(text: str, span: tuple[str, int, int]) -> bool:
    """A format that the base patterns do not look for and that may well be of its kind."""
    kind, a, b = span
    body = text[a:b]
    if kind == "email":
        return bool(_HOST.fullmatch(body))
    if kind == "ip" or _RUN_BEFORE.search(text[max(0, a - 8) : a]) or _RUN_AFTER.match(text[b : b + 8]):
        return False
    return bool((_NATIONAL if kind == "phone" else _WIDE).fullmatch(body)) if kind in ("phone", "card") else False


def weak_label(text: str, span: tuple[str, int, int], base: set[tuple[str, int, int]]) -> int | None:
    """1 or 0, None if nothing tells."""
    kind, a, b = span
    if kind == "secret":
        return int(bool(_NAMED.search(text[max(0, a - 40) : a])))
    if span in base or any(x < b and a < y for _, x, y in base):
        return int(span in base)
    if plausible(text, span):
        return 1 if _CONTEXT[kind].search(text[max(0, a - 24) : a]) else None
    return 0


def rewritten(text: str, span: tuple[str, int, int]) -> list[str]:
    """Other ways to write a base span, which the base patterns do not find."""
    kind, a, b = span
    body = text[a:b]
    if kind == "email":
        local, _, domain = body.partition("@")
        return [f"{local}@{domain.split('.')[0]}"]
    if kind == "card":
        digits = re.sub("[^0-9]", "", body)
        return [" - ".join(digits[n : n + 4] for n in range(0, len(digits), 4))]
    if kind == "phone":
        digits = re.sub("[^0-9]", "", body)[-10:]
        parts = [digits[:-7], digits[-7:-4], digits[-4:]]
        if len(parts[0]) < 2:
            return []
        return ["-".join(parts), " ".join(parts), ".".join(parts), f"({parts[0]}) {parts[1]}-{parts[2]}"]
    return []


def examples(text: str):
    """Labels and features of the candidates of a text, and of its base spans written in other ways."""
    base = set(base_spans(text))
    for span in candidates(text):
        label = weak_label(text, span, base)
        if label is not None:
            yield label, describe(text, span)
    for kind, a, b in sorted(base):
        for body in rewritten(text, (kind, a, b)):
            before = text[max(0, a - 40) : a]
            near, own = before + body + text[b : b + 40], (kind, len(before), len(before) + len(body))
            if own in base_spans(near):
                continue
            for span in candidates(near):
                if span[1] < own[2] and own[1] < span[2] and span[0] != "secret":
                    yield int(span == own), describe(near, span)


@dataclass
class PiiModel:
    trees: Boosted
    threshold: float = THRESHOLD

    def spans(self, text: str | None) -> list[tuple[str, int, int, float, bool]]:
        """``(kind, start, end, probability, base)`` by kind, then by start."""
        if not text:
            return []
        base = base_spans(text)
        found = [(k, a, b, 1.0, True) for k, a, b in base]
        known = set(base)
        offered = [c for c in candidates(text) if c not in known]
        if offered:
            chances = self.trees.probability(np.array([describe(text, c) for c in offered]))
            taken = sorted((a, b) for _, a, b in base)
            for n in sorted(range(len(offered)), key=lambda n: (-chances[n], offered[n][1] - offered[n][2], offered[n])):
                kind, a, b = offered[n]
                if chances[n] >= self.threshold and all(b <= x or y <= a for x, y in taken):
                    found.append((kind, a, b, float(chances[n]), False))
                    taken.append((a, b))
        return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))

    def redact(self, text: str | None) -> str | None:
        return redacted(text, self.spans(text))


def redacted(text: str | None, spans: Sequence[tuple]) -> str | None:
    """The text with each span, or chain of overlapping spans, replaced by the kind of its first one in brackets."""
    if not text or not spans:
        return text
    out, last, open_end = [], 0, -1
    for kind, a, b, *_ in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= open_end:
            out += [text[last:a], f"[{kind}]"]
        last = open_end = max(open_end, b)
    return "".join(out) + text[last:]


def candidate_rows():
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys, labels, features = [], [], []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text:
                    for label, values in examples(text):
                        keys.append(key)
                        labels.append(label)
                        features.append(values)
            columns = [pa.array(keys, pa.int64()), pa.array(labels, pa.int32()), pa.array(features, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "features"])

    return run


def fit_pii(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, threshold: float = THRESHOLD, limit: int = 50_000) -> PiiModel:
    """Trees learned from about ``sample_docs`` documents and at most ``limit`` candidates, chosen by hash; a quarter calibrates."""
    rows = lean(docs)
    every = max(1, -(-rows.count() // sample_docs))
    some = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("pii")), F.lit(every)) == 0)
    found = some.mapInArrow(candidate_rows(), "doc_id long, label int, features array<double>")
    table = found.orderBy(F.xxhash64("doc_id"), "label", "features").limit(limit).toPandas()
    if not len(table):
        return PiiModel(fit_boosted(np.zeros((0, 26)), np.zeros(0), np.zeros(0, bool)), threshold)
    x = np.array(table["features"].tolist(), float)
    calibrate = ((table["doc_id"].fillna(0).to_numpy().astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(62)) == 0
    return PiiModel(fit_boosted(x, table["label"].to_numpy(), calibrate), threshold)


SPAN = "array<struct<kind:string,start:int,end:int,probability:double,base:boolean>>"


def span_rows(model: PiiModel, names: Sequence[str], text_out: bool):
    def run(batches):
        import pyarrow as pa

        kind = pa.list_(
            pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64()), ("base", pa.bool_())])
        )
        fields = ("kind", "start", "end", "probability", "base")
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [model.spans(t) for t in texts]
            columns = [batch.column(n) for n in names]
            columns.append(pa.array([[dict(zip(fields, s, strict=True)) for s in spans] for spans in found], kind))
            if text_out:
                columns.append(pa.array([redacted(t, s) for t, s in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "spans", *(["redacted"] if text_out else [])])

    return run


def find_pii(docs: DataFrame, model: PiiModel, keep: Sequence[str] = (), text_out: bool = True) -> DataFrame:
    """``doc_id, *keep, spans`` and the ``redacted`` text of every document; offsets are code points, ends exclusive."""
    rows = lean(docs, keep=keep)
    names = ["doc_id", *keep]
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keep)
    return rows.mapInArrow(span_rows(model, names, text_out), f"doc_id long{kept}, spans {SPAN}" + (", redacted string" if text_out else ""))


def written(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def op10_pii(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = find_pii(docs, fit_pii(docs), text_out=False)
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
