"""Plain single-process versions of what the training-data operators compute."""

import hashlib
import zlib

import numpy as np
import xxhash

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
# Columns whose names the operators use inside.
CLASHING = "row string, mark int, words string, size string, score string, kept int, along int, place string, number int, print int"


def documents(spark, rows, clashing=False):
    """Documents from (doc_id, text[, lang[, source]]) tuples."""
    full = [(*r, *("en", "src")[len(r) - 2 :]) if len(r) < 4 else r for r in rows]
    full = [(*r, None if r[1] is None else len(r[1])) for r in full]
    if not clashing:
        return spark.createDataFrame(full, DOCUMENTS)
    extra = ("x", 1, "y", "z", "s", 2, 3, "p", 4, 5)
    return spark.createDataFrame([(*r, *extra) for r in full], f"{DOCUMENTS}, {CLASHING}")


def words(text):
    return (text or "").encode().split()


def without_repeats(rows, window=20):
    """doc_id -> (words, removed, hash of the kept words), for rows with unique ids."""
    seen, out = set(), {}
    for doc_id, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0])):
        found = words(text)
        covered = [False] * len(found)
        for at in range(len(found) - window + 1):
            run = tuple(found[at : at + window])
            if run in seen:
                covered[at : at + window] = [True] * window
            seen.add(run)
        kept = b" ".join(w for w, c in zip(found, covered) if not c)
        out[doc_id] = (len(found), sum(covered), hashlib.sha256(kept).hexdigest())
    return out


def fingerprint(text):
    found = (text or "").encode().lower().split()
    shingles = [b" ".join(found[i : i + 4]) for i in range(max(1, len(found) - 3))] if found else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, bits=4):
    """Component number of each fingerprint, by comparing all pairs."""
    values, owner = np.array(prints, np.uint64), list(range(len(prints)))

    def find(i):
        while owner[i] != i:
            i = owner[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= bits) + i + 1:
            owner[find(j)] = find(i)
    return [find(i) for i in range(len(values))]


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def ids_of(tokenizer, text, end=0):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def water_filling(sizes, weights, share, epochs):
    """Targets of sources (in order) by repeated clamping."""
    total, open_ = share * sum(sizes), set(range(len(sizes)))
    while True:
        left = total - sum(epochs * sizes[i] for i in range(len(sizes)) if i not in open_)
        weight = sum(weights[i % len(weights)] for i in open_)
        level = {i: left * weights[i % len(weights)] / weight for i in open_}
        above = {i for i in open_ if level[i] > epochs * sizes[i]}
        if not above:
            return [level.get(i, epochs * sizes[i]) for i in range(len(sizes))]
        open_ -= above
        if not open_:
            return [epochs * s for s in sizes]
