"""Plain restatements that several tests use."""

import hashlib

from axisframe.llm.decontaminate import words


def windows(docs: list[tuple], items: list[tuple], size: int = 10) -> list[tuple]:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    out = []
    for d, t in docs:
        w, hit, who = words(t), set(), set()
        for item, text in items:
            v = words(text) if item is not None else []
            n = min(size, len(v))
            grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1) if n else ():
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    who.add(item)
        out.append((d, len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(map(str, who))).encode()).hexdigest(), bool(hit)))
    return out
