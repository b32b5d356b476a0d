"""Plain-Python versions of the operators, for small tables."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fold(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def library_ids(rows, name: str, end: list[int]) -> dict:
    library = Tokenizer.from_file(public_tokenizers.path(name))
    coded = library.encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    return {k: np.array(c.ids + end, "<u4") for (k, _), c in zip(rows, coded, strict=True)}


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def exact(rows) -> dict:
    groups = collections.defaultdict(list)
    for k, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), k))
    return {k: (min(g)[1], len(g), min(g)[1] == k, sha256(bare)) for bare, g in groups.items() for _, k in g}


def substring(rows, size: int = 20) -> dict:
    first, found = {}, {}
    for k, t in sorted(rows):
        w = found[k] = WORD.findall(t or "")
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i:i + size]), (k, i))
    out = {}
    for k, w in found.items():
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i:i + size])] != (k, i):
                gone[i:i + size] = [True] * size
        out[k] = (len(w), sum(gone), sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def shingles(text: str | None, k: int) -> set:
    w = WORD.findall(fold(text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near(rows, k: int = 3, percent: int = 85) -> dict:
    """All pairs that share a shingle are compared."""
    sets = {d: shingles(t, k) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for d in sorted(sets):
        shared = collections.Counter(e for s in sets[d] for e in holders[s])
        for e, both in shared.items():
            if 100 * both >= percent * (len(sets[d]) + len(sets[e]) - both):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
        for s in sets[d]:
            holders[s].append(d)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in sets}


def subsequence(a: list, b: list) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain_words(text: str | None) -> list[str]:
    """Lower-case words without marks around them."""
    marks = ".!?,;:\"'()[]{}*_-"
    return [w.strip(marks) or w for w in WORD.findall((text or "").lower())]


def leaks(rows, items, least: float = 0.8) -> dict:
    """{doc: items whose words stand in order, to that part, in a stretch of 1.2 item lengths}."""
    out = {k: set() for k, _ in rows}
    for k, t in rows:
        w = plain_words(t)
        have = set(w)
        for number, text in items:
            item = plain_words(text)
            if not item or sum(x in have for x in item) < least * len(item):
                continue
            reach = int(1.2 * len(item)) + 1
            step = max(1, len(item) // 20)
            if any(subsequence(w[i:i + reach], item) >= least * len(item) for i in range(0, max(1, len(w) - len(item) + 1), step)):
                out[k].add(number)
    return out


def pages(rows, least: int = 1000) -> dict:
    best = {}
    for k, html in rows:
        data = (html or "").encode()
        if len(data) >= least:
            best[data] = max(best.get(data, k), k)
    out = {}
    for k, html in rows:
        data = (html or "").encode()
        target = best.get(data, k)
        out[k] = (len(data), hashlib.sha1(data).hexdigest(), "response" if target == k else "revisit", None if target == k else target)
    return out


def chats(rows) -> dict:
    """{conv: (n_turns, turns_sha256, loss_chars, loss_sha256)} of (conv, turn, role, text)."""
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn if turn is not None else -1 << 62, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha256("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha256(loss))
    return out


def quality(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    times = collections.Counter(windows)
    covered = {j for i, x in enumerate(windows) if times[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


def whitening(rows, components: int = 16) -> tuple[dict, dict, int]:
    """(vec_id: grid vector of usable rows, (vec_id, component): (deviation, whitened size, explained), n)."""
    used = {k: [int(np.floor(64 * float(c))) + 1_000_000 for c in v] for k, v in rows
            if v is not None and all(c is not None and np.isfinite(c) for c in v)}
    fit = sorted({tuple(x) for x in used.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array(fit, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    out = {}
    for k, x in used.items():
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        for number, at in enumerate(order, 1):
            if values[at] > 1e-9 * values[order[0]]:
                out[k, number] = (deviation, (np.array(x) - np.array(sums) / n) @ vectors[:, at] / np.sqrt(values[at]),
                                  values[at] / values.sum())
    return used, out, n


PLAIN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
OTHERS = [b for b in range(256) if b not in PLAIN]


def _byte_of(letter: str) -> int:
    return ord(letter) if ord(letter) < 256 else OTHERS[ord(letter) - 256]


def alignment(rows) -> dict:
    """Per row the tuple that op12 returns, token by token."""
    import itertools

    import sentencepiece

    a_lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found, counts = {}, collections.Counter()
    for k, text in rows:
        found[k] = (0, 0, 0, collections.Counter(), "")
        if not text:
            continue
        a, b = a_lib.encode(" " + text, add_special_tokens=False), b_lib.encode(text)
        bytes_a = [bytes(_byte_of(c) for c in t) for t in a.tokens]
        names = [b_lib.id_to_piece(i) for i in b]
        bytes_b = [bytes([int(n[3:-1], 16)]) if b_lib.is_byte(i) else n.replace("\u2581", " ").encode()
                   for i, n in zip(b, names, strict=True)]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            continue
        spans_a, spans_b = ([(e - len(t), e, i) for t, e, i in zip(ts, itertools.accumulate(map(len, ts)), ids, strict=True)]
                            for ts, ids in ((bytes_a, a.ids), (bytes_b, b)))
        links, j = collections.Counter(), 0
        for low, high, i in spans_a:
            while spans_b[j][1] <= low:
                j += 1
            for m in range(j, len(spans_b)):
                if spans_b[m][0] >= high:
                    break
                links[i, spans_b[m][2]] += 1
        cuts = sorted({s[1] for s in spans_a} & {s[1] for s in spans_b})
        groups, x, y = [], 0, 0
        for cut in cuts:
            ids = [[], []]
            while x < len(spans_a) and spans_a[x][1] <= cut:
                ids[0].append(str(spans_a[x][2]))
                x += 1
            while y < len(spans_b) and spans_b[y][1] <= cut:
                ids[1].append(str(spans_b[y][2]))
                y += 1
            groups.append("|".join(map(",".join, ids)))
        found[k] = (len(a.ids), len(b), len(groups), links, sha256(";".join(groups)))
        counts.update(links.keys())
    most = collections.Counter()
    for (a, _), c in counts.items():
        most[a] = max(most[a], c)
    return {k: (na, nb, ng, sum(links.values()), sum(m for p, m in links.items() if counts[p] == most[p[0]]),
                sum(m * counts[p] for p, m in links.items()), sha)
            for k, (na, nb, ng, links, sha) in found.items()}
