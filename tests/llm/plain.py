"""Plain-Python versions of the operators, for the tests."""

from __future__ import annotations

import hashlib
from collections import defaultdict

WHITE = b" \t\n\x0b\x0c\r"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return (text or "").encode().split()


def write(spark, rows, path, schema=DOCUMENTS, name="documents"):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def documents(texts):
    return [(k, v, "en", "s", len(v or "")) for k, v in texts]


def without_repeats(texts, length=13):
    """{doc_id: (n_words, n_removed, sha256 of kept words)} for (doc_id, text) rows with distinct ids."""
    first = {}
    for doc_id, text in texts:
        w = words(text)
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            first[key] = min(first.get(key, doc_id), doc_id)
    result = {}
    for doc_id, text in texts:
        w = words(text)
        gone = set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < doc_id:
                gone.update(range(i, i + length))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        result[doc_id] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return result


def shingles(text, k):
    w = [x.lower() for x in words(text)]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def reachable(nodes, links):
    """{node: smallest node reachable}."""
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    root = {}
    for start in sorted(nodes):
        if start not in root:
            todo = [start]
            while todo:
                node = todo.pop()
                if node not in root:
                    root[node] = start
                    todo.extend(near[node])
    return root


def near_groups(texts, k=3, percent=85):
    """{doc_id: (n_shingles, component_id)} from all pairs."""
    sets = {d: shingles(t, k) for d, t in texts}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    common = defaultdict(int)
    for ids in holders.values():
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                common[a, b] += 1
    links = [(a, b) for (a, b), c in common.items() if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c)]
    root = reachable(sets, links)
    return {d: (len(s), root[d]) for d, s in sets.items()}
