"""Slow and plain versions of the operators."""

import collections
import re


def fold(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingle_set(text, k):
    w = fold(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def components(docs, k, percent=80):
    """{id: (set size, component)} of [(id, text)] with distinct ids."""
    sets = {i: shingle_set(t, k) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def dropped_lines(docs, least=5):
    """{id: [line numbers]} of [(id, text)]: lines equal to an earlier one, or one word's edit from it if both have least words."""
    seen, out = [], collections.defaultdict(list)
    for i, text in sorted(docs):
        for n, line in enumerate((text or "").split("\n")):
            w = tuple(fold(line))
            if not w:
                continue
            if any(w == v or min(len(w), len(v)) >= least and near(w, v) for v in seen):
                out[i].append(n)
            seen.append(w)
    return dict(out)


def near(a, b):
    """At most one word inserted, deleted or substituted."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _template_words(text):
    """(word in lower case, placeholder or None) of each word of a text."""
    from tamarack.llm.decontaminate import NAMES, UNITS

    out, after_number, head = [], False, True
    for m in re.finditer(r"(?:[0-9A-Za-z\x80-\U0010ffff]|(?<=[0-9])[.,](?=[0-9]))+|[.!?:\n]", text):
        w = m[0]
        if w in ".!?:\n":
            head = True
            continue
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
        number = re.fullmatch(r"[0-9.,]+", w) is not None
        capital = "A" <= w[0] <= "Z" or "À" <= w[0] <= "Þ"
        kind = None
        if capital and (not head or low in NAMES):
            kind = "name"
        if number:
            kind = "number"
        elif after_number and low in UNITS:
            kind = "unit"
        out.append((low, kind))
        after_number, head = number, False
    return out


def _template_windows(text, size):
    """[(key, words, slots)] at each place; the key is the words where few of them are plain."""
    w = _template_words(text)
    out = []
    for i in range(len(w) - size + 1):
        part = w[i : i + size]
        words = tuple(x for x, _ in part)
        plain = sum(k is None for _, k in part)
        key = tuple(k and f"<{k}>" or x for x, k in part) if plain >= min(2, size) else words
        out.append((key, words, [x for x, k in part if k]))
    return out


def leaks(docs, items, window=5, contained=0.8):
    """{(doc_id, item_id): share of the item's windows found}, by comparing all windows with all."""
    out = {}
    for j, item in items:
        n = len(_template_words(item or ""))
        size = min(window, n)
        if not n:
            continue
        theirs = _template_windows(item, size)
        for i, text in docs:
            by_shift = collections.defaultdict(list)
            for at, (key, words, values) in enumerate(_template_windows(text or "", size)):
                for place, (k, w, slots) in enumerate(theirs):
                    if key == k or words == w:
                        by_shift[at - place].append((place, words == w, slots, values))
            held = set()
            for found in by_shift.values():
                pairs = {p for _, _, slots, values in found for p in zip(slots, values)}  # noqa: B905
                fit = len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})
                held |= {place for place, same, _, _ in found if fit or same}
            if len(held) >= contained * len(theirs):
                out[i, j] = len(held) / len(theirs)
    return out
