"""Personal data by a skip-chain conditional random field.

Each text's mentions (runs that look like numbers, addresses or spelled-out addresses) are nodes
with a label: none, email, ip, card or phone. Mentions that a base pattern matches keep its label.
The others have a potential from their shape and the word before them, a chain potential with
the mention before, and skip potentials with distant mentions of equal form, of equal last nine
digits, or of as many digits of which one differs. Loopy message passing over each document's
graph spreads labels along those links, so that a number repeated without its plus sign, or with a
slip in it, is labelled as its full form is. Some labels are ruled out by form: a number is no
address, one without four groups of up to 255 no ip unless an ip of the text has its digits, one of
under 13 digits no card, and one of more than 15 no phone. Labelled numbers without their signs are
negative examples, so that a plain number is nothing unless a link or the word before it says so.

The base patterns are exact and their spans always stay; a labelled mention adds a span only
where it overlaps none of them. Potentials are learned from a bounded sample of documents.

Defined results: a null text is an empty one and has no spans; repeated rows have equal results;
of equal labels the first kind wins; texts of any length are read whole, and messages of a
document with very many mentions pass in tables that grow as its mentions do; an empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estimora.llm.arrays import row_chunks
from estimora.llm.shared import bounded

KINDS = ("email", "ip", "card", "phone")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
#: Documents with mentions to learn the potentials from at most, and rounds of message passing.
SAMPLE_DOCS, ROUNDS = 2000, 12
#: Links whose messages are computed at once.
LINKS_AT_ONCE = 50_000
#: A neighbour is weighed as half a piece, a mention of the same form as three.
SKIP_WEIGHT = 3
#: Mentions of a document and characters of a form that potentials are learned from, at most.
FIT_MENTIONS, FIT_FORM = 200, 40

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't begin inside a run of digits: it would have begun at the run's first digit.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[\[(] ?(?:at|AT) ?[\])]")
#: What may be a mention without matching a base pattern.
_LOOSE = re.compile(
    r"[A-Za-z0-9._%+-]{1,64} ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]{1,64}(?:(?:\.| ?[\[(] ?(?:dot|DOT) ?[\])] ?)[A-Za-z0-9-]{1,64})+"
    r"|(?<![\w.+@-])[+(]?[0-9](?:[ ().-]{0,2}[0-9]){6,22}(?![\w@-])"
)
_WORD_BEFORE = re.compile(r"([^\W\d_]+)\W{0,3}\Z")
#: Words that announce a kind, in the languages at hand (fixed values).
_CUES = {
    0: "email mail e-mail correo courriel adresse",
    1: "ip host server servidor serveur",
    2: "card visa mastercard karte carte tarjeta kreditkarte",
    3: "tel phone telephone call fax mobile telefon teléfono téléphone móvil handy",
}
_CUE = {word: kind for kind, found in _CUES.items() for word in found.split()}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of the base patterns: leftmost, non-overlapping for each kind, failing ones dropped."""
    found: list[list[tuple[int, int]]] = [[], [], [], []]
    end = at = 0
    while (at := text.find("@", at)) >= 0:
        begin = at
        while begin > end and (text[begin - 1].isascii() and text[begin - 1].isalnum() or text[begin - 1] in "._%+-"):
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            found[0].append((begin, m.end()))
            end = at = m.end()
        else:
            at += 1
    for m in _IP.finditer(text):
        if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split(".")):
            found[1].append(m.span())
    for m in _CARD.finditer(text):
        d = digits_of(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            found[2].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(digits_of(m[0])) <= 15:
                found[3].append(m.span())
    return found


@dataclass
class Mention:
    start: int
    end: int
    form: str
    label: int  # of a base pattern, or -1
    shape: np.ndarray
    dotted: bool = False  # four groups of digits up to 255


def shape_of(raw: str, form: str, cue: int) -> np.ndarray:
    """Features of a mention, the bias last."""
    n = len(form) if form.isdigit() else 0
    groups = [len(g) for g in re.findall("[0-9]+", raw)]
    flags = [
        not n, n and n < 9, 9 <= n <= 12, 13 <= n <= 15, 16 <= n <= 19, n > 19,
        raw[:1] == "+", "(" in raw, raw.count(".") == 3 and len(groups) == 4 and max(groups) <= 3, "-" in raw, " " in raw,
        13 <= n <= 19 and luhn(form), len(groups) == 1, cue == 0, cue == 1, cue == 2, cue == 3, True,
    ]
    return np.array(flags, float)


def mentions(text: str, base: list[list[tuple[int, int]]]) -> list[Mention]:
    """All mentions of a text in order: those of base patterns, and loose ones that overlap none."""
    spans = sorted((a, b, k) for k, found in enumerate(base) for a, b in found)
    taken = []
    for a, b, k in spans:
        if not taken or a >= taken[-1][1]:
            taken.append((a, b, k))
        elif b > taken[-1][1]:
            taken.append((taken[-1][1], b, k))
    out, at = [], 0
    for a, b, k in [*taken, (len(text), len(text), -1)]:
        for m in _LOOSE.finditer(text, at, a):
            out.append((m.start(), m.end(), -1))
        if k >= 0:
            out.append((a, b, k))
        at = b
    found = []
    for a, b, k in out:
        raw = text[a:b]
        form = digits_of(raw) if not re.search("[A-Za-z]", raw) else re.sub(r"[^a-z0-9]", "", re.sub(r"[\[( ]+(?:at|dot)[\]) ]+|[@.]", "", raw.lower()))
        w = _WORD_BEFORE.search(text, max(0, a - 40), a)
        groups = re.findall("[0-9]+", raw) if len(raw) < 30 else []
        dotted = len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
        found.append(Mention(a, b, form, k, shape_of(raw, form, _CUE.get(w[1].lower(), -1) if w else -1), dotted))
    return found


def links(found: list[Mention]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbouring mentions, and pairs of equal or similar ones: the members of each
    class of forms are linked one to the next, and to the last one that a base pattern matches, so
    pairs grow as the mentions do."""
    chain = np.stack([np.arange(len(found) - 1), np.arange(1, len(found))], axis=1)
    last: dict[tuple, int] = {}
    sure: dict[tuple, int] = {}
    skips = set()
    for k, m in enumerate(found):
        f, keys = m.form, [("=", m.form)]
        if f.isdigit() and len(f) >= 9:
            # numbers that end alike, as without a country prefix, and numbers that differ in one digit
            keys += [("end", f[-9:]), *(("but", f[:at], f[at + 1 :]) for at in range(len(f)))]
        for key in keys:
            skips |= {(x[key], k) for x in (last, sure) if key in x}
            last[key] = k
            if m.label >= 0:
                sure[key] = k
    return chain.reshape(-1, 2), np.array(sorted(skips), np.int64).reshape(-1, 2)


def ruled_out(found: list[Mention]) -> np.ndarray:
    """For each mention the labels that its form can't have."""
    out = np.zeros((len(found), len(KINDS) + 1), bool)
    ips = {m.form for m in found if m.label == 1}
    for k, m in enumerate(found):
        number = m.form.isdigit()
        out[k, 1] = number
        out[k, 2] = not number or not m.dotted and m.form not in ips
        out[k, 3] = not number or len(m.form) < 13 or len(m.form) > 19
        out[k, 4] = not number or len(m.form) < 7 or len(m.form) > 15
    return out


def negatives(docs: list[list[Mention]]) -> list[np.ndarray]:
    """Shapes of labelled numbers without their signs; a card's with its last digit changed."""
    out = []
    for d in docs:
        for m in d:
            if m.label > 0 and m.form.isdigit():
                form = m.form if m.label != 2 else m.form[:-1] + str((int(m.form[-1]) + 1) % 10)
                out.append(shape_of(form, form, -1))
    return out


@dataclass
class Field:
    """Potentials, in logarithms: of shapes, of neighbours, and of the ends of a skip link."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def learned(docs: list[list[Mention]]) -> Field:
    """Piecewise training: softmax regression for shapes with the base labels as targets, smoothed
    log ratios of label pairs for neighbours and for the ends of skip links."""
    labels = len(KINDS) + 1
    plain = negatives(docs)
    x = np.array([m.shape for d in docs for m in d] + plain).reshape(-1, 18)
    y = np.array([m.label + 1 for d in docs for m in d] + [0] * len(plain), np.int64)
    w = np.zeros((18, labels))
    for _ in range(300 if len(y) else 0):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        w -= 1.0 * (x.T @ p / len(y) + 0.003 * w)
    chain, skip = np.full((labels, labels), 5.0), np.full((labels, labels), 1.0) + 40 * np.eye(labels)
    skip[0, 0] = 1.0  # an unlabelled mention says nothing of another
    for d in docs:
        near, far = links(d)
        for pairs, table in ((near, chain), (far, skip)):
            for a, b in pairs:
                la, lb = d[a].label + 1, d[b].label + 1
                if table is chain or la and lb:
                    table[la, lb] += 1
                    table[lb, la] += 1
    out = []
    for table in (chain, skip):
        p = table / table.sum()
        out.append(np.clip(np.log(p / np.outer(p.sum(1), p.sum(0))), -4, 4))
    out[1][0, :] = np.minimum(out[1][0, :], 0)
    out[1][:, 0] = np.minimum(out[1][:, 0], 0)
    return Field(w, out[0] / 2, out[1] * SKIP_WEIGHT)


def labelled(found: list[Mention], field: Field) -> np.ndarray:
    """The probability of each label of each mention after message passing along all links."""
    n, labels = len(found), len(KINDS) + 1
    unary = np.array([m.shape for m in found]) @ field.unary
    unary[ruled_out(found)] = -30
    for k, m in enumerate(found):
        if m.label >= 0:
            unary[k] = -30
            unary[k, m.label + 1] = 0
    chain, skip = links(found)
    pairs = np.concatenate([chain, skip])
    source = np.concatenate([pairs[:, 0], pairs[:, 1]])
    target = np.concatenate([pairs[:, 1], pairs[:, 0]])
    # one table for each kind of link and direction, not for each link
    tables = np.stack([field.chain, field.skip, field.chain.T, field.skip.T])
    kind = np.repeat([0, 1, 2, 3], [len(chain), len(skip), len(chain), len(skip)])
    back = np.concatenate([np.arange(len(pairs), 2 * len(pairs)), np.arange(len(pairs))])
    sent = np.zeros((len(source), labels))

    def belief() -> np.ndarray:
        total = unary.copy()
        np.add.at(total, target, sent)
        return total

    for _ in range(ROUNDS if len(source) else 0):
        known = belief()
        new = np.empty_like(sent)
        for at in range(0, len(source), LINKS_AT_ONCE):
            some = slice(at, at + LINKS_AT_ONCE)
            z = (known[source[some]] - sent[back[some]])[:, :, None] + tables[kind[some]]
            top = z.max(axis=1)
            new[some] = top + np.log(np.exp(z - top[:, None]).sum(axis=1))
        sent = 0.5 * sent + 0.5 * (new - new.max(axis=1, keepdims=True))
    p = np.exp((b := belief()) - b.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def spans_of(text: str, field: Field) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
    """Spans by kind: of the base patterns, and those that the field adds."""
    added: list[list[tuple[int, int]]] = [[], [], [], []]
    if not _TRIGGER.search(text):
        return [[], [], [], []], added
    base = base_spans(text)
    found = mentions(text, base)
    if any(m.label < 0 for m in found):
        p = labelled(found, field)
        for m, row in zip(found, p, strict=True):
            k = int(np.argmax(row))
            if m.label < 0 and k and row[k] > 0.6:
                added[k - 1].append((m.start, m.end))
    return base, added


def written(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, found in zip(KINDS, spans, strict=True) for a, b in found)


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field:
    """Potentials from about `sample_docs` of the documents that hold mentions, each with its first
    FIT_MENTIONS mentions, forms cut to FIT_FORM; their features are all that reaches the driver."""
    some = bounded(docs).select("text").filter(F.col("text").rlike("[0-9@]"))
    total = some.count()
    drawn = some.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(min(1.0, sample_docs / max(total, 1)) * (1 << 20)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in row_chunks(batches, "text"):
            rows = []
            for text in chunk.column("text").to_pylist():
                found = mentions(text, base_spans(text))[:FIT_MENTIONS]
                rows.append([{"form": m.form[:FIT_FORM], "label": m.label, "shape": m.shape.tolist()} for m in found])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.struct([("form", pa.string()), ("label", pa.int32()), ("shape", pa.list_(pa.float64()))])))], ["m"])

    rows = drawn.distinct().mapInArrow(features, "m array<struct<form: string, label: int, shape: array<double>>>").limit(4 * sample_docs).collect()
    return learned(sorted(([Mention(0, 0, m["form"], m["label"], np.array(m["shape"])) for m in r["m"]] for r in rows), key=lambda d: [(m.form, m.label) for m in d]))


def detect(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans and the number of added ones."""
    field = fit(docs, sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in row_chunks(batches, "text"):
            counts, digests, spans, more = [], [], [], []
            for text in chunk.column("text").to_pylist():
                base, added = spans_of(text or "", field)
                counts.append([len(x) for x in base])
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written([sorted(a + b) for a, b in zip(base, added, strict=True)]))
                more.append(sum(map(len, added)))
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)), pa.array(digests), pa.array(spans), pa.array(more, pa.int64())], SCHEMA.replace(" long", "").replace(" string", "").split(", "))

    return bounded(docs).select("doc_id", "text").mapInArrow(run, SCHEMA)


def masked(text: str, field: Field) -> str:
    """The text with each span, overlapping ones together, replaced by its kind in brackets."""
    base, added = spans_of(text, field)
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k in range(4) for a, b in base[k] + added[k]):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def redacted(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """docs with personal data masked in column text, null where it was null; all columns stay."""
    field = fit(docs, sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in row_chunks(batches, "text"):
            texts = pa.array([t and masked(t, field) for t in chunk.column("text").to_pylist()], pa.string())
            yield chunk.set_column(chunk.schema.get_field_index("text"), "text", texts)

    return bounded(docs).mapInArrow(run, docs.schema)
