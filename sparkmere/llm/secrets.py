"""Secret scans: three fixed patterns, and sliding-window Shannon entropy per character class.

Base kinds (each leftmost, non-overlapping, over the whole text): ``assign`` a named value of 8 or more characters,
``access`` an access key of 16 or more, ``hex`` a run of 32 or more lower-case hex digits. The method adds kind
``entropy``: in every candidate string (a run of the characters that keys are written in) a window slides over each
character class; symbol counts are updated by one leaving and one entering symbol; windows at or above the class's
threshold are united to a span. Candidates that the allow-list knows (URLs and paths whose pieces are words or numbers, UUIDs, plain words, dates and
versions) add no entropy span; base spans are never suppressed. An entropy span that lies in a base span is not repeated.

Positions are code points, ends exclusive. Defined cases: null text is empty and has no spans; texts of any length are
scanned whole; repeated rows each get their result; extra columns are kept, result columns win over clashing names.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate

# Patterns of the base kinds. Upper and lower case are spelled out, as only ASCII letters may fold.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a shorter run of these characters has no longer match inside it
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")

#: Per character class: its characters, window in symbols, bits per symbol from which a window is a secret.
CLASSES = {
    "base64": ("A-Za-z0-9+/_-", 24, 4.0),
    "alnum": ("A-Za-z0-9", 24, 4.0),
    "hex": ("0-9A-Fa-f", 32, 3.2),
}
#: Of a path: words (in lower case, of one capital, in capitals, or run together) and numbers of up to 8 digits; a word may
#: end in up to 4 digits. Random letters, with case or digits changing at random, aren't of this form.
WORD = r"(?:(?:[A-Z]?[a-z]+|[A-Z]+|(?:[A-Z]?[a-z]{2,}|[A-Z]{2,})(?:[A-Z][a-z]{2,})+)[0-9]{0,4}|[0-9]{1,8})"
PIECE = rf"(?:[_-]*{WORD}(?:[_-]+{WORD})*[_-]*)"
ALLOW = (
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUIDs
    rf"(?=[^/]*/)/*{PIECE}(?:/+{PIECE})*/*",  # paths; a candidate has no dots, so hosts and extensions lie outside it
    r"[A-Z]?[a-z]+(?:[-_/+][A-Z]?[a-z]+)*",  # words
    r"[0-9]+(?:[-_/+][0-9]+)*",  # numbers, dates
    r"[A-Z]+(?:[-_/+][A-Z]+)*",
)


class Scanner:
    def __init__(self, classes: dict[str, tuple[str, int, float]] | None = None, allow: tuple[str, ...] = ALLOW):
        self.classes = [(name, re.compile(f"[{chars}]{{{window},}}"), window, bits) for name, (chars, window, bits) in (classes or CLASSES).items()]
        least = min(c[2] for c in self.classes)
        self.candidate = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % least)
        self.allow = re.compile("|".join(f"(?:{a})" for a in allow))
        self.patterns = ((0, re.compile(ASSIGN), 1, 8), (1, re.compile(ACCESS), 0, 16), (2, re.compile(HEX), 0, 32))
        most = max(c[2] for c in self.classes)
        self.part = [[(c / w) * math.log2(w / c) if c else 0.0 for c in range(w + 1)] for w in range(most + 1)]

    def windows(self, s: str, window: int, bits: float) -> list[tuple[int, int]]:
        """United windows of s with at least `bits` of entropy; counts change by two symbols a step."""
        part = self.part[window]
        counts: dict[str, int] = {}
        entropy, out = 0.0, []
        for i, c in enumerate(s):
            n = counts.get(c, 0)
            entropy += part[n + 1] - part[n] if n < window else 0.0
            counts[c] = n + 1
            if i >= window:
                old = s[i - window]
                n = counts[old]
                if n > window:  # only while one symbol fills more than the window
                    counts[old] = n - 1
                    continue
                entropy += part[n - 1] - part[n]
                counts[old] = n - 1
            if i >= window - 1 and entropy >= bits - 1e-9:
                if out and i - window + 1 <= out[-1][1]:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((i - window + 1, i + 1))
        return out

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end), sorted."""
        found = []
        for kind, pattern, group, least in self.patterns:
            if kind == 1 and "AKIA" not in text:
                continue
            if kind == 0 and ":" not in text and "=" not in text:
                continue
            found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
        base = sorted((s, e) for s, _, e in found)
        united: list[tuple[int, int]] = []
        for m in self.candidate.finditer(text):
            token = m.group()
            if self.allow.fullmatch(token):
                continue
            for _, pattern, window, bits in self.classes:
                for run in pattern.finditer(token):
                    s = run.group()
                    if self.allow.fullmatch(s):
                        continue
                    united += [(m.start() + run.start() + a, m.start() + run.start() + b) for a, b in self.windows(s, window, bits)]
        united.sort()
        merged: list[list[int]] = []
        for a, b in united:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        at = far = 0  # far: the furthest end of the base spans that start at or before a
        for a, b in merged:
            while at < len(base) and base[at][0] <= a:
                far = max(far, base[at][1])
                at += 1
            if b > far:
                found.append((a, 3, b))
        return sorted(found)


RESULT = T.StructType([T.StructField("secret_spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``secret_spans``: all spans of each whole text, by start, then kind as listed. One narrow pass."""

    def make():
        scanner = Scanner()

        def work(columns: list[pa.Array]) -> list[pa.Array]:
            out = []
            for t in columns[0].to_pylist():
                out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scanner.spans(t)] if t else [])
            return [pa.array(out, _SPANS)]

        return work

    return annotate(docs, [text], RESULT, make)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", chars: str | None = None) -> DataFrame:
    """docs with every span of the text replaced by a mark (overlapping spans by one). `chars`: a column that counts the text's code points."""

    def make():
        scanner = Scanner()

        def work(columns: list[pa.Array]) -> list[pa.Array]:
            out = []
            for t in columns[0].to_pylist():
                done, parts = 0, []
                for s, _, e in scanner.spans(t) if t else ():
                    if s >= done:
                        parts += [t[done:s], mark]
                    done = max(done, e)
                out.append(t if not parts else "".join([*parts, t[done:]]))
            return [pa.array(out, pa.string())]

        return work

    order = docs.columns
    done = annotate(docs, [text], T.StructType([T.StructField(text, T.StringType())]), make).select(*[F.col(f"`{c}`") for c in order])
    return done if chars is None else done.withColumn(chars, F.char_length(text).cast(docs.schema[chars].dataType))
