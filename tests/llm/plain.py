"""What the operators decide, in plain Python over all pairs; for small tables."""

import itertools
import re


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def within_one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def kept_lines(texts, least):
    """doc_id: (its lines that had a word, the lines left); texts by doc_id."""
    seen, out = {}, {}
    for i in sorted(texts):
        lines, left = (texts[i] or "").split("\n"), []
        for line in lines:
            w = tuple(words(lower(line)))
            gone = bool(w) and (w in seen.get(len(w), ()) or len(w) >= least and any(within_one_edit(w, v) for n in (len(w) - 1, len(w), len(w) + 1) if n >= least for v in seen.get(n, ())))
            if w:
                seen.setdefault(len(w), {})[w] = True
            if not gone:
                left.append(line)
        out[i] = (sum(1 for x in lines if words(x)), left)
    return out


def components(texts, k, t):
    """doc_id: (size of its set of k-word shingles, least doc_id of its component)."""
    sets = {}
    for i, text in texts.items():
        w = words(lower(text))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if min(len(sets[a]), len(sets[b])) * t.denominator < max(len(sets[a]), len(sets[b])) * t.numerator:
            continue
        both = len(sets[a] & sets[b])
        if both and both * t.denominator >= t.numerator * (len(sets[a]) + len(sets[b]) - both):
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    return {i: (len(s), root(i)) for i, s in sets.items()}


def contamination(texts, items):
    """doc_id: (words, which of them are hit, items found as sorted strings)."""
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for item, t in items:
        p = norm(t)
        for s in range(max(1, len(p) - 12) if p else 0):
            windows.setdefault(tuple(p[s : s + 13]), set()).add(str(item if item is not None else ""))
    sizes, out = {len(w) for w in windows}, {}
    for i, t in texts.items():
        w, hit, found = norm(t), set(), set()
        for n in sizes:
            for at in range(len(w) - n + 1):
                if (held := windows.get(tuple(w[at : at + n]))) is not None:
                    hit |= set(range(at, at + n))
                    found |= held
        out[i] = (w, hit, sorted(found))
    return out


def is_contaminated(w, hit):
    return bool(hit) and 20 * len(hit) >= len(w)


def best_fit(sizes, capacities, overhead):
    """(bin, offset, capacity) of each piece: least room first, the latest of equals; a new bin by the least cost a token."""
    bins, place, order = [], [], 0
    for i, s in enumerate(sizes):
        fits = [b for b in bins if b["room"] >= s]
        if fits:
            b = min(fits, key=lambda b: (b["room"], -b["order"]))
        else:
            def cost(c):
                return (c + overhead) / (s + min(c - s, sum(x for x in sizes[i + 1 :] if x <= c - s)))  # noqa: B023

            capacity = min((c for c in sorted(capacities) if c >= s), key=cost)
            b = {"id": len(bins), "room": capacity, "used": 0, "order": 0}
            bins.append(b)
        order += 1
        place.append((b["id"], b["used"]))
        b["used"], b["room"], b["order"] = b["used"] + s, b["room"] - s, order
    final = [min(c for c in capacities if c >= b["used"]) for b in bins]
    return [(b, at, final[b]) for b, at in place]
