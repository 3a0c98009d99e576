"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def words(text: str | None) -> list[str]:
    return ALNUM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def grams(text: str | None, k: int = 5) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def near(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, int]]:
    """class_id, copy_id, n_links for unique ids."""
    sets = {i: grams(t) for i, t in docs}
    up = {i: i for i in sets}

    def find(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    links: dict[int, int] = defaultdict(int)
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both * 5 >= (len(sets[a]) + len(sets[b]) - both) * 4:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    copies: dict[frozenset, int] = {}
    for i in ids:
        if sets[i]:
            copies.setdefault(sets[i], i)
    return {i: (find(i), copies.get(sets[i], i), links[i]) for i in ids}


def substring_bytes(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, int, str]]:
    seen: set[bytes] = set()
    out = {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = [True] * 100
            seen.add(w)
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def substring_words(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, str]]:
    w = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs}
    first: dict[tuple, int] = {}
    for i in sorted(w):
        for s in range(len(w[i]) - 12):
            first.setdefault(tuple(w[i][s : s + 13]), i)
    out = {}
    for i, x in w.items():
        gone: set[int] = set()
        for s in range(len(x) - 12):
            if first[tuple(x[s : s + 13])] < i:
                gone.update(range(s, s + 13))
        out[i] = (len(x), len(gone), sha(" ".join(v for k, v in enumerate(x) if k not in gone)))
    return out


def contaminated(docs: list[tuple[int, str | None]], items: list[tuple[int | None, str | None]]) -> dict[int, tuple[int, int, list[str]]]:
    windows: dict[tuple, set[str]] = defaultdict(set)
    for item, text in items:
        w = words(text)
        if item is not None and w:
            size = min(10, len(w))
            for s in range(len(w) - size + 1):
                windows[tuple(w[s : s + size])].add(str(item))
    out = {}
    for i, text in docs:
        w = words(text)
        hit: set[int] = set()
        ids: set[str] = set()
        for size in {len(k) for k in windows}:
            for s in range(len(w) - size + 1):
                if found := windows.get(tuple(w[s : s + size])):
                    hit.update(range(s, s + size))
                    ids |= found
        out[i] = (len(w), len(hit), sorted(ids))
    return out


def base_secrets(text: str | None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns."""
    text = text or ""
    key = r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    found = [(m.start(), 0, m.end()) for m in re.finditer(key, text) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(s, ("assign", "access", "hex")[k], e) for s, k, e in sorted(found)]


def entropy_spans(text: str | None, base: list[tuple[int, str, int]], classes: dict, allow: tuple[str, ...]) -> list[tuple[int, str, int]]:
    """Windows counted anew at each place, marked character by character."""
    text = text or ""
    hot = [False] * (len(text) + 1)
    for m in re.finditer(r"[A-Za-z0-9+/_-]+", text):
        if any(re.fullmatch(a, m[0]) for a in allow):
            continue
        for chars, size, bits in classes.values():
            for run in re.finditer(f"[{chars}]+", m[0]):
                if len(run[0]) < size or any(re.fullmatch(a, run[0]) for a in allow):
                    continue
                for i in range(len(run[0]) - size + 1):
                    counts = Counter(run[0][i : i + size])
                    if -sum(c / size * math.log2(c / size) for c in counts.values()) >= bits - 1e-9:
                        at = m.start() + run.start() + i
                        hot[at : at + size] = [True] * size
    out, start = [], None
    for i, h in enumerate(hot):
        if h and start is None:
            start = i
        if not h and start is not None:
            if not any(s <= start and i <= e for s, _, e in base):
                out.append((start, "entropy", i))
            start = None
    return out
