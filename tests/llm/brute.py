"""Plain Python versions of the numbered operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


class Union:
    def __init__(self, n):
        self.parent = list(range(n))

    def find(self, i):
        while self.parent[i] != i:
            i = self.parent[i]
        return i

    def link(self, i, j):
        a, b = self.find(i), self.find(j)
        self.parent[max(a, b)] = min(a, b)


def word_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def base_failed(counts):
    return counts[0] < 10 or 100 * counts[4] > 20 * counts[0]


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def groups(keys, links):
    """The least key of each row's component; None is least only alone."""
    union = Union(len(keys))
    for i, j in links:
        union.link(i, j)
    least = {}
    for i, key in enumerate(keys):
        if key is not None:
            root = union.find(i)
            least[root] = min(least.get(root, key), key)
    return [least.get(union.find(i)) for i in range(len(keys))]


def near_pairs(values, bits=2):
    return [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= bits]


def vector_links(vectors, labels, cosine=0.93):
    def good(v, label):
        return label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)

    ok = [good(v, label) for v, label in zip(vectors, labels)]
    found = []
    for i in range(len(vectors)):
        for j in range(i):
            if ok[i] and ok[j] and labels[i] == labels[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                    found.append((i, j))
    return found


def without_repeats(texts, length=200):
    """(n_bytes, n_removed, n_spans, sha256 of what stays) of each text."""
    counts = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(x for x, y in zip(b, gone) if not y)
        spans = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def base_secrets(text):
    """(counts by kind, digest of the spans)."""
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    listed = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))
    return [sum(f[1] == k for f in found) for k in range(3)], hashlib.sha256(listed.encode()).hexdigest()


def deduped_lines(docs, similarity=0.8):
    """{(key, text): text without lines that repeat}; a None key comes last."""
    documents = sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0, hashlib.md5((("-" if d[0] is None else f"={d[0]}") + "\n" + (d[1] or "")).encode()).digest()))
    where = defaultdict(list)
    for n, (_, text) in enumerate(documents):
        for pos, line in enumerate((text or "").split("\n")):
            if WORD.search(line):
                where[line].append((n, pos))
    lines = list(where)
    sets = [{x[i : i + 8] for i in range(max(1, len(x) - 7))} for x in lines]
    union = Union(len(lines))
    for i in range(len(lines)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                union.link(i, j)
    held = defaultdict(list)
    for i, line in enumerate(lines):
        held[union.find(i)] += where[line]
    gone = {x for own in held.values() for x in sorted(own)[1:]}
    return {
        d: None if d[1] is None else "\n".join(line for pos, line in enumerate(d[1].split("\n")) if (n, pos) not in gone)
        for n, d in enumerate(documents)
    }


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())
