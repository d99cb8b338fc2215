"""Plain versions of text operators that several test modules compare with."""


def shingle_sets(docs, k):
    out = []
    for doc, text in docs:
        w = (text or "").encode().lower().split()
        out.append((doc, frozenset([tuple(w)] if 0 < len(w) < k else (tuple(w[i:i + k]) for i in range(len(w) - k + 1)))))
    return out


def linked_by_hand(docs, k, num, den):
    sets = shingle_sets(docs, k)
    up = {d: d for d, _ in sets if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, t in sets[:i]:
            if d is None or e is None or not s or not t:
                continue
            both = len(s & t)
            if den * both >= num * (len(s) + len(t) - both):
                a, b = root(d), root(e)
                up[max(a, b)] = min(a, b)
    return sorted(((d, len(s), None if d is None else root(d) if s else d) for d, s in sets), key=repr)
