"""Brute-force versions that the tests compare with."""

from __future__ import annotations

import hashlib
from collections import Counter


def repeats(texts: list[str | None], width: int) -> list[tuple[int, int, int, str]]:
    """(bytes, removed, spans, digest of the rest) per text."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


def personal(text: str | None) -> list[tuple[str, int, int]]:
    """Base spans of personal data, by kind as listed, then by start."""
    import re

    text = text or ""

    def luhn(d: str) -> bool:
        total = 0
        for i, c in enumerate(reversed(d)):
            n = int(c) * (1 + i % 2)
            total += n - 9 if n > 9 else n
        return total % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text) if ok(m[0])]


def words(text: str | None) -> list[str]:
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]


def shingles(text: str | None, k: int) -> set:
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(nodes: list, links: list[tuple]) -> dict:
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near(docs: list[tuple[int, str | None]], k: int, percent: int = 80) -> dict[int, tuple[int, int]]:
    """(shingles, component) per id."""
    sets = {i: shingles(t, k) for i, t in docs}
    ids = sorted(sets)
    links = []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    reach = components(ids, links)
    return {i: (len(sets[i]), reach[i]) for i in ids}


def exact(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """(keep_id, group_size) per id."""
    import re
    from collections import defaultdict

    groups = defaultdict(list)
    for i, t in docs:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return {i: (min(g), len(g)) for g in groups.values() for i in g}


def passages(texts: list[str | None], k: int) -> list[int]:
    """Maximal runs of at least k words that another text holds too, per text."""
    held = [words(t) for t in texts]
    where: dict[tuple, set[int]] = {}
    for i, w in enumerate(held):
        for a in range(len(w) - k + 1):
            where.setdefault(tuple(w[a : a + k]), set()).add(i)
    out = []
    for i, w in enumerate(held):
        n, end = 0, -1
        for a in range(len(w) - k + 1):
            if len(where[tuple(w[a : a + k])]) > 1:
                n += a > end
                end = a + k
        out.append(n)
    return out


def posteriors(rows: list[tuple[str, str, float]]) -> dict[tuple[str, str], tuple[float, float]]:
    """{(host, path): (host posterior, path posterior)} of evidence, shrunk by the method of moments."""
    import numpy as np

    def strength(groups: list[tuple[np.ndarray, float]]) -> float:
        n = sum(len(x) for x, _ in groups)
        if not n or len(groups) < 2:
            return 1e6
        within = sum(len(x) * x.var() for x, _ in groups) / n
        spread = sum(len(x) * (x.mean() - prior) ** 2 for x, prior in groups)
        effective = n - sum(len(x) ** 2 for x, _ in groups) / n
        between = max(0.0, (spread - (len(groups) - 1) * within) / effective) if effective > 0 else 0.0
        return min(1e6, within / between) if between > 0 else 1e6

    hosts, paths = {}, {}
    for h, p, e in rows:
        hosts.setdefault(h, []).append(e)
        paths.setdefault((h, p), []).append(e)
    hosts, paths = ({k: np.array(v) for k, v in x.items()} for x in (hosts, paths))
    overall = float(np.mean([e for _, _, e in rows]))
    s = strength([(x, overall) for x in hosts.values()])
    host = {h: (x.sum() + s * overall) / (len(x) + s) for h, x in hosts.items()}
    s = strength([(x, host[k[0]]) for k, x in paths.items()])
    return {k: (host[k[0]], (x.sum() + s * host[k[0]]) / (len(x) + s)) for k, x in paths.items()}


def packed(rows: list, ids: dict[int, list[int]], capacity: int = 1024) -> int:
    """Check pieces against their documents' ids; the number of sequences."""
    import zlib
    from collections import defaultdict

    import numpy as np

    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
        own = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert r["ids_crc32"] == zlib.crc32(own)
    assert set(by_doc) == set(ids)
    for i, x in ids.items():
        p = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in p] == list(range(-(-len(x) // capacity))) and p[0]["start"] == 0
        assert all(b["start"] == a["start"] + a["length"] for a, b in zip(p, p[1:])) and all(r["length"] == capacity for r in p[1:]) and sum(r["length"] for r in p) == len(x)
    for p in by_seq.values():
        at = 0
        for r in sorted(p, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_seq)
