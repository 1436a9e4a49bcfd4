"""Plain versions of the numbered queries' contracts, row by row, to hold the queries against."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""((?:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def base_secrets(text: str | None) -> tuple[int, int, int, str]:
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    kinds = Counter(k for _, k, _ in spans)
    listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return kinds[0], kinds[1], kinds[2], sha(listed)


def windows_removed(docs: list[tuple[int | None, str | None]], window: int = 13) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept_sha256) per row."""
    first: dict[tuple, int] = {}
    rows = [(i, WORD.findall(t or "")) for i, t in docs]
    for i, words in rows:
        for k in range(len(words) - window + 1 if i is not None else 0):
            key = tuple(words[k:k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, words in rows:
        gone = set()
        for k in range(len(words) - window + 1 if i is not None else 0):
            if first[tuple(words[k:k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(words), len(gone), sha(" ".join(w for k, w in enumerate(words) if k not in gone))))
    return out


def shingle_set(text: str | None, length: int) -> frozenset:
    words = WORD.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))
    if not words:
        return frozenset()
    length = min(length, len(words))
    return frozenset(tuple(words[k:k + length]) for k in range(len(words) - length + 1))


def near_components(docs: list[tuple[int, str | None]], length: int, percent: int = 80) -> list[tuple]:
    """(doc_id, n_shingles, component_id, kept) per row, by way of all pairs that share a shingle."""
    sets = [shingle_set(t, length) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    shared = Counter()
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return [(doc, len(sets[i]), least[root(i)], least[root(i)] == doc) for i, (doc, _) in enumerate(docs)]


def rule_counts(text: str | None) -> tuple:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {k + d for k in range(len(words) - 2) if grams[tuple(words[k:k + 3])] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def owners(docs: list[tuple[int | None, str | None]]) -> list[tuple]:
    """(doc_id, keep_id, group_size, kept, text_sha256) per row."""
    normal = [SPACE.sub(" ", t or "") for _, t in docs]
    groups = defaultdict(list)
    for (i, _), t in zip(docs, normal):
        groups[t].append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return [(i, keep[t], len(groups[t]), i == keep[t], sha(t)) for (i, _), t in zip(docs, normal)]


def conversations(turns: list[tuple]) -> list[tuple]:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256) of (conv_id, turn, role, text) rows with distinct turns."""
    by = defaultdict(list)
    for conv, turn, role, text in turns:
        by[conv].append((turn, role or "", text or ""))
    out = []
    for conv, rows in by.items():
        rows.sort(key=lambda r: r[0])
        loss = "".join(t for _, r, t in rows if r == "assistant")
        out.append((conv, len(rows), sha("".join(f"{r}\n{t}\n" for _, r, t in rows)), len(loss), sha(loss)))
    return out


def crc(text: str | None) -> int:
    return zlib.crc32((text or "").encode("utf-8", "surrogatepass"))


def lowered(text: str | None) -> str:
    return (text or "").translate({k: k + 32 for k in range(65, 91)})


def one_edit(a: str, b: str) -> bool:
    """By the whole edit matrix."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1] == 1


def spelling_variants(counts: dict[str, int], factor: int = 5) -> list[tuple]:
    """(word, form, root, n, n_near, form_n) per word, by way of all pairs of like lengths."""
    by_length = defaultdict(list)
    for w in counts:
        by_length[len(w)].append(w)
    form, n_near = {}, {}
    for w, n in counts.items():
        near = [x for k in (-1, 0, 1) for x in by_length[len(w) + k] if one_edit(w, x)]
        n_near[w] = len(near)
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= factor * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return [(w, form[w], root(w), n, n_near[w], counts[form[w]] if form[w] else None) for w, n in counts.items()]


def spelt_words(docs: list[tuple[int | None, str | None]], one_in: int = 199, signs: int = 6, least: int = 5) -> dict[str, int]:
    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered(t)):
            h = crc(f"{'' if i is None else i}:{run}")
            if h % one_in == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += len(run) >= signs
    return {w: n for w, n in counts.items() if n >= least}


def resampled(docs: list[tuple[int | None, str | None]], target: list[str | None], buckets=10_000, most=1, least=20, percent=10) -> list[tuple]:
    """(doc_id, n_features, weight, score, rank) per row."""
    def features(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text))
        return len(words), [crc(" ".join(words[k:k + n])) % buckets for n in range(1, most + 1) for k in range(len(words) - n + 1)]

    s, t = Counter(), Counter()
    rows = [(i, *features(x)) for i, x in docs]
    for _, _, found in rows:
        s.update(found)
    for x in target:
        t.update(features(x)[1])
    all_s, all_t = s.total() + buckets, t.total() + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t)))
    out = []
    for i, words, found in rows:
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    entered = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(entered[:percent * len(entered) // 100], 1)}
    return [(r[0], *r[2:], rank.get(id(r))) for r in out]


def simhash(text: str | None, length: int = 4) -> int:
    words = WORD.findall(lowered(text))
    length = min(length, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k:k + length]).encode(), 42) for k in range(len(words) - length + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def hamming_components(docs: list[tuple[int | None, str | None]], distance: int = 4) -> list[tuple]:
    """(doc_id, fingerprint, component_id) per row, by way of all pairs of fingerprints."""
    prints = [simhash(t) for _, t in docs]
    kinds = sorted(set(prints))
    parent = {x: x for x in kinds}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for k, a in enumerate(kinds):
        for b in kinds[:k]:
            if (a ^ b).bit_count() <= distance:
                parent[root(a)] = root(b)
    least = {}
    for (i, _), x in zip(docs, prints):
        if i is not None:
            least[root(x)] = min(least.get(root(x), i), i)
    return [(i, f"{x:016x}", least.get(root(x))) for (i, _), x in zip(docs, prints)]
