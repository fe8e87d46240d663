"""Plain versions of the contracts, for comparison."""

import re

import xxhash


def squeeze(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute_fp(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, distance):
    """fps: (id, fp); smallest reachable id by repeated scans."""
    comp = {i: i for i, _ in fps}
    changed = True
    while changed:
        changed = False
        for i, a in fps:
            for j, b in fps:
                if (a ^ b).bit_count() <= distance and comp[j] < comp[i]:
                    comp[i], changed = comp[j], True
    return comp


def runs_in_common(words, n):
    """Smallest id reachable over texts (lists of word hashes) that share any ``n`` neighbouring words."""
    seen, root = {}, {i: i for i in words}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(words):
        for k in range(len(words[i]) - n + 1):
            a, b = find(i), find(seen.setdefault(tuple(words[i][k : k + n]), i))
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in words}
