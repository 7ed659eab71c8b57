"""Plain single-process versions of operators, to compare with."""

import re

import xxhash


def token_set(line):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", line) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def lines(rows):
    """Texts without lines that equal or resemble an earlier line; ``rows`` are ``(id, text)``."""
    placed = [(i, line) for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)) if t is not None for line in t.split("\n")]
    sets = [token_set(line) for _, line in placed]
    out = {i: None if t is None else [] for i, t in rows}
    holders = {}
    for k, (i, line) in enumerate(placed):
        seen = {j for t in sets[k] for j in holders.get(t, ())}
        if not any(len(sets[k] & sets[j]) * 9 >= 4 * (len(sets[k]) + len(sets[j])) for j in seen):
            out[i].append(line)
        for t in sets[k]:
            holders.setdefault(t, []).append(k)
    return {i: None if ls is None else "\n".join(ls) for i, ls in out.items()}


def fingerprint(text):
    text = "" if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius=4):
    """For every fingerprint the first place of its group."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def near_copies(rows):
    """Ids of the first document of each group of similar ones; ``rows`` are ``(id, text)``."""
    rows = sorted(rows)
    sets = [token_set((t or "").lower()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if 9 * shared >= 4 * (len(sets[i]) + len(sets[j])):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [rows[i][0] for i in range(len(rows)) if find(i) == i]


def edits(item, text):
    """Least edits of the item against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)
