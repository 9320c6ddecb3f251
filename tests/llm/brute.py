"""Plain versions of the operators' contracts, for small tables."""

import hashlib
import random
import re

import xxhash

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def simhash(text):
    words = SPACE.findall(lower(text))
    if not words:
        return 0
    n = 4 if len(words) > 4 else len(words)
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, radius=4):
    """rows: (doc_id, fingerprint); the smallest doc_id reachable, by row."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if (a ^ rows[j][1]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = root(i)
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    return [least.get(root(i)) for i in range(len(rows))]


def contaminated(text, items, window=10):
    words = WORD.findall(lower(text))
    hit, found = set(), set()
    for item, item_text in items:
        own = WORD.findall(lower(item_text))
        n = min(window, len(own))
        grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(item)
    ids = sorted(str(i) for i in found if i is not None)
    return len(words), len(hit), len(ids), sha(",".join(ids)), bool(hit)


def words_removed(docs, window=50):
    """docs: (doc_id, text).  (n_words, n_removed, kept digest) by row."""
    first = {}
    for doc, text in docs:
        words = SPACE.findall(text or "")
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if doc is not None:
                first[key] = min(doc, first.get(key, doc))
    out = []
    for doc, text in docs:
        words, gone = SPACE.findall(text or ""), set()
        for i in range(len(words) - window + 1):
            least = first.get(tuple(words[i : i + window]))
            if doc is not None and least is not None and least < doc:
                gone |= set(range(i, i + window))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((len(words), len(gone), sha(" ".join(kept))))
    return out


def bytes_removed(docs, length=100):
    """docs: (doc_id, text).  (n_bytes, n_removed, n_spans, kept digest) by row."""
    first = {}
    for doc, text in docs:
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            key = data[i : i + length]
            if doc is not None:
                first[key] = min((doc, i), first.get(key, (doc, i)))
    out = []
    for doc, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            least = first.get(data[i : i + length])
            if doc is not None and least is not None and least < (doc, i):
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(data), sum(gone), spans, sha(kept)))
    return out


def prose(seed, n, vocabulary=400):
    """n invented words."""
    r = random.Random(seed)
    return " ".join("w%d" % r.randrange(vocabulary) for _ in range(n))


def mutated(text, seed, edits):
    r, words = random.Random(seed), text.split(" ")
    for _ in range(edits):
        words[r.randrange(len(words))] = "x%d" % r.randrange(1000)
    return " ".join(words)


def corpus(seed=0, n=60):
    """(doc_id, text, source) rows with copies, near copies, shared passages, empty
    and missing texts, a very long text and repeated words."""
    r = random.Random(seed)
    passage, base = prose(1000 + seed, 70), prose(2000 + seed, 160)
    rows = []
    for i in range(n):
        kind = i % 10
        text = {
            0: lambda: prose(i, 30),
            1: lambda: prose(i, 60) + " " + passage + "\n" + prose(i + 500, 40),
            2: lambda: base,
            3: lambda: mutated(base, i, 2),
            4: lambda: "",
            5: lambda: None,
            6: lambda: "be " * (120 + i % 3),
            7: lambda: prose(7, 200) if i % 20 == 7 else prose(i, 300),
            8: lambda: "é" * r.randrange(1, 300) + " ünï\tcode",
            9: lambda: passage[: 5 * i + 20] + " " + prose(i, 80),
        }[kind]()
        rows.append((i, text, None if i % 7 == 0 else f"s{i % 3}"))
    rows.append((n, prose(9999, 12_000), "s0"))
    rows.append((n + 1, passage + " " + prose(9999, 12_000), "s0"))
    return rows
