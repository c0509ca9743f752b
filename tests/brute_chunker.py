"""Packing as cut positions in a document's word stream, used only to check the engine."""


def pack(units, target, overlap):
    """``units`` are ``(kind, page, words)``; returns dictionaries in order.

    A chunk is a range of words. It ends before a section, before a unit that would make it
    longer than the target, once it has reached the target, and at the end; the next one
    starts up to ``overlap`` words earlier.
    """
    cuts, low, high, fresh = [], 0, 0, 0

    def cut(unit):
        nonlocal low, fresh
        cuts.append((low, high, fresh, unit))
        low, fresh = high - min(overlap, high - low), unit

    for i, (kind, _, words) in enumerate(units):
        if i > fresh and (kind == "section" or high - low + len(words) > target):
            cut(i)
        high += len(words)
        if high - low >= target:
            cut(i + 1)
    if fresh < len(units):
        cut(len(units))

    stream = [w for _, _, words in units for w in words]
    ends = [0]
    for _, _, words in units:
        ends.append(ends[-1] + len(words))
    out = []
    for number, (low, high, first, last) in enumerate(cuts, 1):
        repeated = low < ends[first]
        own = units[first:last]
        # Repeated words count as being on the page of the unit before.
        pages = [page for _, page, _ in own] + ([units[first - 1][1]] if repeated else [])
        kinds = (["overlap"] if repeated else []) + [kind for kind, _, _ in own]
        out.append(
            {
                "sequence": number,
                "text": " ".join(stream[low:high]),
                "start_page": min(pages),
                "end_page": max(pages),
                "word_count": high - low,
                "source_boundaries": sorted(set(kinds), key=kinds.index),
            }
        )
    return out
