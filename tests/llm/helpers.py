"""Small fixtures and slow, plain versions of the operators."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
# columns whose names the operators use inside
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, label int, place string, sig long, "
          "key_range string, score string, rest string, component_id string")


def frame(spark, rows, partitions=3):
    """Documents with extra columns that clash; rows are (doc_id, text)."""
    full = [(d, t, "en", "s", None if t is None else len(t), 7, "here", 1, "r", "none", "x", "y") for d, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions) if full else spark.createDataFrame([], SCHEMA)


def prose(seed, words):
    """Different words for every seed."""
    return " ".join(hashlib.md5(f"{seed}-{i}".encode()).hexdigest()[:6] for i in range(words))


def messy():
    """Nulls, empty, blank, short, very long, repeated and copied texts, other scripts, odd spaces, special strings."""
    long = prose("long", 6000)
    same = prose("same", 60)
    return [
        (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one two"), (5, same), (6, same), (7, same.upper()),
        (8, same + " more"), (9, long), (10, long + " tail"), (11, "x" * 5000), (12, "ab " * 400), (13, "日本語 한국어 ไทย é é Å"),
        (14, "a b c\x1cd\x85e  f\r\ng"), (15, "<|endoftext|>a <|startoftext|> <|ENDOFTEXT|> ▁b ▁▁"),
        (16, "İI 'twas he's we'RE ''s 12ab3 ½ Ⅷ ﬁ 🙂🙂"), (17, "line\nline\n\nline \nother line"), (18, "don't!'s I'll (a),(b)-c"),
        (20, prose("p", 40) + " " + prose("q", 40)), (21, prose("q", 40) + " " + prose("r", 40)), (40, same), (40, same),
        (None, "text without id"), (-5, prose("neg", 30)),
    ]


def shingles(text, size):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def components(rows, size, percent):
    """doc_id -> (set size, smallest doc_id reachable), by comparing all pairs that share a shingle."""
    sets = {d: shingles(t, size) for d, t in rows if d is not None}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    holders = defaultdict(list)
    for d in sorted(sets):
        shared = Counter(other for s in sets[d] for other in holders[s])
        for other, n in shared.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[other]) - n):
                a, b = root(d), root(other)
                parent[max(a, b)] = min(a, b)
        for s in sets[d]:
            holders[s].append(d)
    return {d: (len(sets[d]), root(d)) for d in sets}


def without_repeats(rows, window):
    """doc_id -> (bytes, removed, spans, sha256 of the rest), string by string."""
    seen, out = set(), {}
    for doc_id, text in sorted({(d, t or "") for d, t in rows if d is not None}):
        data = text.encode()
        cover = bytearray(len(data))
        for at in range(len(data) - window + 1):
            piece = data[at:at + window]
            if piece in seen:
                cover[at:at + window] = b"\1" * window
            seen.add(piece)
        kept = bytes(b for b, c in zip(data, cover) if not c)
        spans = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        out[doc_id] = (len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out
