"""Small corpora with every awkward case, and plain Python twins of the operators."""

import hashlib
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, order_id long, text_key string, row string, spans int, n int, label string, flags string"
COLUMNS = ["doc_id", "text"]


def corpus(seed=0, n=60):
    """Texts with copies, near copies, shared passages, repeated lines, null, empty, short, very long and odd ones."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh éüñ"[:8] + "éü") for _ in range(rng.randint(1, 7))) for _ in range(80)]
    sentence = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage = sentence(60)
    texts = [sentence(rng.randint(1, 90)) for _ in range(n)]
    texts += [texts[3], texts[3], texts[5].upper(), None, "", " \n\t", "one", "one two three", "one two three", passage + " " + sentence(12), sentence(9) + " " + passage, sentence(5) + "\n" + passage + "\n" + sentence(5)]
    for k in (7, 8, 9):
        near = texts[k].split() or ["x"]
        near[len(near) // 2] = "changed"
        texts.append(" ".join(near))
        texts.append(texts[k] + " and more")
    line = sentence(30)
    texts += ["\n".join([line] * 4), "a " * 300, "ß" * 200, "日本語 " * 40, "x" * 49, "x" * 50, "x" * 51, sentence(4000), "<|endoftext|> a<|endoftext|>", "\x00\x01 nul \x7f é"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts))
    return rows + [rows[4], (rows[6][0], "another text of an id that is there already " + passage), (None, texts[3]), (None, "of no id " + passage)]


def table(spark, rows):
    """With further columns whose names the operators use inside."""
    filled = [(i, t, ("en", "de", None)[k % 3], f"s{k % 2}", len(t or ""), -k, "k", "r", k, k, "l", "f") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(filled, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(data):
    return hashlib.sha256(data).hexdigest()


LATE = 1 << 62


def repeated_bytes(rows, length):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            first[w] = min(first.get(w, LATE + 1), LATE if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < (LATE if i is None else i):
                gone[s : s + length] = [True] * length
        runs = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def without_repeated_bytes(rows, length):
    first, out = {}, {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            first[w] = min(first.get(w, i), i)
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < i:
                gone[s : s + length] = [True] * length
        out[i] = bytes(x for x, g in zip(b, gone) if not g)
    return out


def repeated_words(rows, length):
    space = re.compile(rb"[^\x20\x09-\x0D]+")
    first = {}
    for i, t in rows:
        w = space.findall((t or "").encode())
        for s in range(len(w) - length + 1):
            key, at = tuple(w[s : s + length]), (LATE if i is None else i, s)
            first[key] = min(first.get(key, at), at)
    out = []
    for i, t in rows:
        w = space.findall((t or "").encode())
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] < (LATE if i is None else i, s):
                gone[s : s + length] = [True] * length
        out.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def near_components(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    out = []
    for k, (i, _) in enumerate(rows):
        own = [rows[j][0] for j in range(len(rows)) if root(j) == root(k) and rows[j][0] is not None] if sets[k] else [i]
        out.append((i, len(sets[k]), min(own, default=None) if own and own != [None] else None))
    return out, [root(k) if sets[k] else None for k in range(len(rows))]


def contamination(rows, items, window=13, one_in=20):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    windows = {}
    for item, t in items:
        w = cut(t)
        if item is None or not w:
            continue
        for k in range(max(1, len(w) - window + 1)):
            windows.setdefault(tuple(w[k : k + window]), set()).add(str(item))
    out = []
    for i, t in rows:
        w = cut(t)
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                got = windows.get(tuple(w[s : s + n]))
                if got:
                    hit |= set(range(s, s + n))
                    found |= got
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), len(hit) > 0 and one_in * len(hit) >= len(w)))
    return out
