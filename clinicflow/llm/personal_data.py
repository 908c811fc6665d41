"""Personal data in texts: fixed patterns, and a span classifier from weak supervision.

Four kinds of spans follow fixed patterns and are always reported. Further candidates, secrets and
numbers, are voted on by labelers: a pattern, a gazetteer of prefixes, the words around, and the
marks around. Nobody has labelled them, so expectation-maximisation estimates from the votes of
the whole corpus how reliable each labeler is, and its posteriors train the final classifier, which
sees the votes and the shape of a span. All training runs on counts of (vote, shape) patterns,
which are few however large the corpus is.
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

from clinicflow.llm.shared import text_of

BASE_KINDS, ADDED_KINDS = ("email", "ip", "card", "phone"), ("secret", "number")

# The patterns of the base kinds.
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Every candidate of any kind has a digit or an @.
TELLTALE = re.compile(r"[0-9@]")
TOKEN = re.compile(r"[A-Za-z0-9_]{16,}")
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk_live", "sk_test", "xoxb", "AIza")
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65")
SECRET_WORDS = re.compile(r"token|secret|passw|api|key|bearer|credential|auth", re.I)
NUMBER_WORDS = re.compile(r"card|visa|account|iban|ssn|social|tel|phone|fax|mobile|konto|carte|tarjeta", re.I)
CONTEXT = 24
YES, NO, ABSTAIN = 1, 0, 2
LABELERS = 4
# Rounds of expectation-maximisation and of the classifier's Newton steps; the added spans' limit.
EM_ROUNDS, NEWTON_ROUNDS, LIMIT = 50, 25, 0.5

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """Leftmost, non-overlapping. Looks left from each @, so long texts take linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        domain = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        done = domain.end() if domain else at + 1
        if domain:
            out.append((start, done))
        at = text.find("@", done)
    return out


def addresses(text: str) -> list[Span]:
    """Four numbers with dots between them; a longer row of numbers is taken four by four."""
    out = []
    for row in DOTTED.finditer(text):
        parts = row.group().split(".")
        at = row.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, digit in enumerate(map(int, reversed(digits))):
        total += digit if k % 2 == 0 else (digit * 2 - 9 if digit > 4 else digit * 2)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def base_spans(text: str) -> dict[str, list[Span]]:
    """The spans of the four base kinds."""
    cards = [m.span() for m in DIGITS.finditer(text) if _is_card(m.group())]
    phones = [m.span() for m in PHONE.finditer(text) if 8 <= len(only_digits(m.group())) <= 15]
    return {"email": emails(text), "ip": addresses(text), "card": cards, "phone": phones}


def _is_card(found: str) -> bool:
    digits = only_digits(found)
    return 16 <= len(digits) <= 19 and luhn(digits)


@dataclass(frozen=True)
class Candidate:
    kind: str
    start: int
    end: int
    pattern: str  # votes and shape, comma-joined: what training and deciding see


def candidates(text: str, base: dict[str, list[Span]]) -> list[Candidate]:
    """Further spans that may be personal data, not overlapping the base spans or one another."""
    taken = sorted(s for spans in base.values() for s in spans)
    found = [("secret", m.span()) for m in TOKEN.finditer(text) if _mixed(m.group())]
    found += [("number", m.span()) for m in DIGITS.finditer(text) if 9 <= len(only_digits(m.group())) <= 19]
    out, at = [], 0
    for kind, (start, end) in sorted(found, key=lambda x: (x[1], x[0])):
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if (at < len(taken) and taken[at][0] < end) or (out and out[-1].end > start):
            continue
        out.append(Candidate(kind, start, end, _pattern(kind, text, start, end)))
    return out


def _mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.isalpha() for c in token)


def _pattern(kind: str, text: str, start: int, end: int) -> str:
    span, before = text[start:end], text[max(0, start - CONTEXT) : start]
    digits = only_digits(span)
    quoted = before[-1:] in "\"'`" and text[end : end + 1] in "\"'`" and bool(before)
    if kind == "secret":
        whole_hex = re.fullmatch(r"[0-9a-f]{32,}|[0-9A-F]{32,}", span) is not None
        pattern = YES if whole_hex or re.fullmatch(r"[A-Z0-9]{16,}", span) else NO
        gazetteer = YES if span.startswith(KEY_PREFIXES) else ABSTAIN
        context = YES if SECRET_WORDS.search(before) else NO
    else:
        pattern = YES if luhn(digits) else NO
        gazetteer = YES if digits.startswith(ISSUERS) and len(digits) >= 15 else NO
        context = YES if NUMBER_WORDS.search(before) else ABSTAIN
    marks = YES if quoted else NO if text[end : end + 1].isalnum() else ABSTAIN
    size = min(len(span), 79) // 8
    share = len(digits) * 4 // len(span)
    return ",".join(map(str, (ADDED_KINDS.index(kind), pattern, gazetteer, context, marks, size, share)))


def reliabilities(votes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Posterior of "personal" for each row of votes, by EM over independent labelers.

    Starts from the share of yes among the votes given. Rates are smoothed by one vote.
    """
    given = votes != ABSTAIN
    posterior = ((votes == YES).sum(axis=1) + 0.5) / (given.sum(axis=1) + 1)
    for _ in range(EM_ROUNDS):
        logs = []
        for weight in (counts * posterior, counts * (1 - posterior)):
            total = np.log((weight.sum() + 1) / (counts.sum() + 2)) * np.ones(len(votes))
            for k in range(votes.shape[1]):
                rates = np.bincount(votes[:, k], weight, 3) + 1
                total += np.log(rates / rates.sum())[votes[:, k]]
            logs.append(total)
        posterior = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -40, 40)))
    return posterior


def _design(patterns: np.ndarray) -> np.ndarray:
    """One column per value of each vote and shape, and a constant."""
    columns = [np.ones(len(patterns))]
    for k, values in enumerate((3,) * LABELERS + (10, 5), start=1):
        columns += [(patterns[:, k] == v).astype(float) for v in range(values)]
    return np.stack(columns, axis=1)


def train(counts: dict[str, int]) -> dict[str, bool]:
    """Which patterns are personal data, from how often each comes in the corpus.

    For each kind the posteriors of EM are the soft labels of a logistic regression with ridge 1.
    """
    keep: dict[str, bool] = {}
    rows = sorted(counts)
    table = np.array([list(map(int, r.split(","))) for r in rows]).reshape(-1, LABELERS + 3)
    number = np.array([counts[r] for r in rows], float)
    for kind in range(len(ADDED_KINDS)):
        own = np.flatnonzero(table[:, 0] == kind)
        if not len(own):
            continue
        x, n = _design(table[own]), number[own]
        y = reliabilities(table[own, 1 : LABELERS + 1], n)
        beta = np.zeros(x.shape[1])
        for _ in range(NEWTON_ROUNDS):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            slope = x.T @ (n * (y - p)) - beta
            curve = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(beta))
            beta += np.clip(np.linalg.solve(curve, slope), -5, 5)
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        keep.update((rows[i], bool(q >= LIMIT)) for i, q in zip(own, p, strict=True))
    return keep


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_number.

    `spans` has kind:start:end of all spans by kind, then start; base_sha256 is the hash of those of
    the base kinds. Places are code points, ends exclusive. A null text counts as empty and has no
    spans. Rows are judged alone, so repeated rows and null ids stay as they are; other columns are
    not read. A corpus without candidates adds no spans.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value in batch.column("text"):
                content = value.as_py()
                if TELLTALE.search(content):
                    found += [c.pattern for c in candidates(content, base_spans(content))]
            names, numbers = np.unique(found, return_counts=True) if found else ([], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(numbers, pa.int64())], ["pattern", "n"]
            )

    # At most 2 * 3^4 * 10 * 5 patterns come to the driver, whatever the size of the corpus.
    patterns = rows.select("text").mapInArrow(count, "pattern string, n bigint").groupBy("pattern").agg(F.sum("n").alias("n"))
    keep = rows.sparkSession.sparkContext.broadcast(train({r.pattern: r.n for r in patterns.collect()}))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            out = []
            for value in batch.column("text"):
                content = value.as_py()
                if not TELLTALE.search(content):
                    out.append((0, 0, 0, 0, nothing, "", 0, 0))
                    continue
                base = base_spans(content)
                added = [c for c in candidates(content, base) if keep.value.get(c.pattern)]
                first = ",".join(f"{kind}:{a}:{b}" for kind in BASE_KINDS for a, b in base[kind])
                own = {kind: [c for c in added if c.kind == kind] for kind in ADDED_KINDS}
                rest = [f"{c.kind}:{c.start}:{c.end}" for kind in ADDED_KINDS for c in own[kind]]
                out.append(
                    (
                        *(len(base[k]) for k in BASE_KINDS),
                        hashlib.sha256(first.encode()).hexdigest(),
                        ",".join([first, *rest] if first else rest),
                        *(len(own[k]) for k in ADDED_KINDS),
                    )
                )
            columns = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names
            )

    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_secret", "n_number"]
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        report,
        f"doc_id {id_type}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, "
        "spans string, n_secret bigint, n_number bigint",
    )
