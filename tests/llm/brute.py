"""Plain Python versions of the operators, for small inputs."""

import base64
import hashlib
import re

import numpy as np
import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def fingerprint(text, shingle=3):
    words = WORD.findall(lower(text or ""))
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + shingle]).encode(), 42) for k in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def components(ids, prints, max_bits=3):
    """Smallest id reachable, for each row."""
    prints = np.array(prints, np.uint64)
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= max_bits):
            parent[find(i)] = find(i + 1 + int(j))
    smallest = {}
    for i, one in enumerate(ids):
        if one is not None:
            smallest[find(i)] = min(smallest.get(find(i), one), one)
    return [smallest.get(find(i)) for i in range(len(ids))]


def passages(rows, window=13):
    """(id, words, removed, kept text) of (id, text) rows."""
    owner = {}
    split = [(one, WORD.findall(text or "")) for one, text in rows]
    for one, words in split:
        if one is not None:
            for i in range(len(words) - window + 1):
                key = tuple(words[i : i + window])
                owner[key] = min(owner.get(key, one), one)
    result = []
    for one, words in split:
        gone = set()
        if one is not None:
            for i in range(len(words) - window + 1):
                if owner[tuple(words[i : i + window])] < one:
                    gone.update(range(i, i + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        result.append((one, len(words), len(gone), kept))
    return result


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def line_links(lines, max_edits=2, rate=0.05):
    """Pairs of places of distinct lines within the allowed edits."""
    found = set()
    for i, a in enumerate(lines):
        for j in range(i):
            b = lines[j]
            k = min(max_edits, int(min(len(a), len(b)) * rate))
            if k and abs(len(a) - len(b)) <= k and edit_distance(a, b) <= k:
                found.add((j, i))
    return found


def line_dedup(rows):
    """Kept text of (text) rows in document order."""
    split = [None if t is None else t.split("\n") for t in rows]
    first, order = {}, []
    for d, lines in enumerate(split):
        for p, line in enumerate(lines or []):
            if line.strip(" \t\n\v\f\r") and line not in first:
                first[line] = (d, p)
                order.append(line)
    late = {order[j] for _, j in line_links(order)}
    return [
        None if lines is None else "\n".join(
            x for p, x in enumerate(lines) if not x.strip(" \t\n\v\f\r") or (first[x] == (d, p) and x not in late)
        )
        for d, lines in enumerate(split)
    ]


_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)


def secret_spans(text):
    """(start, kind number, end) of the patterns' spans."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def warc_rows(pages, least=0):
    """(page_id, bytes, digest, type, refers to) of (page_id, html) rows."""
    first = {}
    for one, html in pages:
        body = (html or "").encode()
        if one is not None:
            first[body] = min(first.get(body, one), one)
    rows = []
    for one, html in pages:
        body = (html or "").encode()
        head = first.get(body)
        revisit = one is not None and len(body) >= least and head != one
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        rows.append((one, len(body), digest, "revisit" if revisit else "response", head if revisit else None))
    return rows
