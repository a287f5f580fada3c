"""Benchmark items looked for in texts by comparing every window with every other, without hashes or joins."""

from quillmill.llm import decontaminate as D


def tokens(text):
    """(piece, literal, kind as it stands, kind if sentences may open with names) of each token."""
    out, starts = [], True
    for k, line in enumerate((text or "").split("\n")):
        for piece in ([D.BREAK.strip()] if k else []) + line.split():
            literal, at_start, inside, ends = D.classify(piece)
            if literal:
                out.append((piece, literal, at_start if starts else inside, inside))
            starts = ends
    return out


def windows(own, width, way):
    """way 0: as they stand, 1: with names that open sentences, None: literally."""
    shown = [t[1] if way is None or not t[2 + way] else t[2 + way] for t in own]
    return [tuple(shown[i : i + width]) for i in range(len(own) - width + 1)]


def search(items, text):
    """(item_id, matched, windows, slots, changed, consistent) of the best passage for each item (item_id, text) found."""
    doc, out = tokens(text), []
    for item_id, item_text in items:
        own = tokens(item_text)
        if not own:
            continue
        width = min(D.WIDTH, len(own))
        usable = lambda way: [i for i in range(len(own) - width + 1) if sum(not t[2 + way] for t in own[i : i + width]) >= min(D.LITERALS, (width + 1) // 2)]  # noqa: E731, B023
        places = usable(0) or list(range(len(own) - width + 1))
        hits = []
        for way in (0, 1) if usable(0) else (None,):
            mine = windows(own, width, way)
            for p in places if not way else [p for p in places if p in usable(1) and mine[p] != windows(own, width, 0)[p]]:
                slots = [(j, D.value_of(own[p + j][0]), own[p + j][3], bool(own[p + j][2])) for j in range(width) if own[p + j][3]]
                for theirs in [windows(doc, width, None)] if way is None else [windows(doc, width, 0), windows(doc, width, 1)]:
                    hits += [(d, p, way == 1, places.index(p), [t[0] for t in doc[d : d + width]], slots) for d, w in enumerate(theirs) if w == mine[p]]
        if hits:
            best = D.best_passage(hits, len(own))
            out.append((item_id, best[0], len(places), *best[1:]))
    return out


def leaks(items, text):
    return [h for h in search(items, text) if D.leaked(h[1], h[2], h[5])]
