"""Plain versions of the contracts, row by row."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""(?:(?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def quality(text, window=8):
    text = text or ""
    words = WORD.findall(text)
    runs = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
    times, covered = Counter(runs), set()
    for i, r in enumerate(runs):
        if times[r] > 1:
            covered.update(range(i, i + window))
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def base_digest(text):
    s = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base_spans(text))
    return hashlib.sha256(s.encode()).hexdigest()


def shingles(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def components(sets):
    """sets: id -> set; the smallest id reachable by links of 100 * intersection >= 85 * union."""
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i in ids:
        for s in sets[i]:
            by.setdefault(s, []).append(i)
    for i in ids:
        shared = Counter(j for s in sets[i] for j in by[s] if j > i)
        for j, n in shared.items():
            if 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def same_as_sql(spark, folder, query, sql, **tables):
    """The query over ``tables`` gives the rows that DuckDB gives for ``sql``."""
    import duckdb

    con = duckdb.connect()
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS FROM '{folder}/{name}.parquet/*.parquet'")
    out = query(spark, str(folder))
    got = sorted(map(repr, map(tuple, out.collect())))
    found = con.sql(sql)
    assert sorted(found.columns) == sorted(out.columns)
    assert got == sorted(map(repr, found.select(*[f'"{c}"' for c in out.columns]).fetchall())) and got


def sentences(text):
    """Pieces that join to the text: by stops and line breaks, then long ones after the word of least hash in each seven."""
    import re
    import xxhash

    space = "\t\n\x0b\x0c\r "
    out, words = [], list(re.finditer(f"[^{space}]+", text))
    ends = [m[0][-1] in ".!?" or i + 1 == len(words) or "\n" in text[m.end() : words[i + 1].start()] for i, m in enumerate(words)]
    cuts, at = set(), 0
    for i, end in enumerate(ends):
        if end:
            cuts.add(i)
            if i + 1 - at > 12:
                h = [xxhash.xxh3_64_intdigest(m[0].encode().lower()) for m in words[at : i + 1]]
                cuts.update(at + max(range(k, k + 7), key=lambda j: (-h[j], j)) for k in range(len(h) - 6))
            at = i + 1
    at = 0
    for i in sorted(cuts):
        stop = words[i + 1].start() if i + 1 < len(words) else len(text)
        out.append(text[at:stop])
        at = stop
    return out


def spans(pieces):
    """(first, end, words) of the shortest runs of three pieces and twenty words from each piece and up to each."""
    fold = lambda p: p.encode().lower().split()
    n, found = [len(fold(p)) for p in pieces], set()
    for i in range(len(pieces)):
        ends = [e for e in range(i + 3, len(pieces) + 1) if sum(n[i:e]) >= 20]
        starts = [s for s in range(i + 1 - 3, -1, -1) if sum(n[s : i + 1]) >= 20][:1]
        found |= {(i, ends[0])} if ends else set()
        found |= {(starts[0], i + 1)} if starts else set()
    return [(a, b, tuple(w for p in pieces[a:b] for w in fold(p))) for a, b in sorted(found)]


def without_repeats(docs):
    """{id: (text left, sentences removed)} of {id: text}."""
    first, out, parts = {}, {}, {i: sentences(t) for i, t in docs.items()}
    found = {i: spans(p) for i, p in parts.items()}
    for i in sorted(docs):
        for a, b, w in found[i]:
            first.setdefault(w, (i, a, b))
    for i in docs:
        gone = {k for a, b, w in found[i] if first[w] != (i, a, b) for k in range(a, b)}
        out[i] = "".join(p for k, p in enumerate(parts[i]) if k not in gone), len(gone)
    return out
