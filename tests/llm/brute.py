"""Plain versions of the operators, for small tables."""

import collections
import functools
import hashlib
import itertools
import re
import zlib

WS = r"[^\x20\x09-\x0D]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def statistics(text):
    text = text or ""
    w, win = re.findall(WS, text), collections.defaultdict(list)
    for i in range(len(w) - 2):
        win[tuple(w[i : i + 3])].append(i)
    hit = {i + k for v in win.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WS, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def shingles(text):
    w = re.findall(WS, lower(text))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def components(docs, roots=False, percent=80):
    """docs: (id, text); (n, least id) by position, or the number of components of texts with words."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(least[r], d)
    if roots:
        return len({find(i) for i, s in enumerate(sets) if s})
    return [(len(s), least[find(i)] if s else d) for i, (s, (d, _)) in enumerate(zip(sets, docs, strict=True))]


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contamination(docs, items):
    out = []
    for _, text in docs:
        w, hit, found = item_words(text), set(), set()
        for item, t in items:
            iw = item_words(t)
            n = min(13, len(iw))
            if n:
                for win in {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)}:
                    for k in range(len(w) - n + 1):
                        if tuple(w[k : k + n]) == win:
                            hit.update(range(k, k + n))
                            found.add("" if item is None else str(item))
        out.append((len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def line_dedup(docs, passage=None):
    """docs sorted by id, ids distinct: texts. passage: words that make one or two lines a window, as being the whole text does."""
    seen, out = set(), []
    for _, text in docs:
        lines, gone = text.split("\n") if text is not None else [], set()
        for size in (1, 2, 3):
            for k in range(len(lines) - size + 1):
                win = tuple(lines[k : k + size])
                n = sum(len(x.split()) for x in win)
                if n and (size == 3 or passage and (len(lines) == size or n >= passage)):
                    gone.update(range(k, k + size)) if win in seen else seen.add(win)
        out.append(None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def tokens(word, pieces):
    """Fewest tokens among the best segmentations of a marked word, by a table over all its prefixes."""
    text, worst = "▁" + word, min(pieces.values()) - 10.0
    best = [(0.0, 0)]
    for i in range(1, len(text) + 1):
        n = len(text[i - 1].encode())
        ways = [(best[i - 1][0] + worst * n, -(-best[i - 1][1] + n))]
        ways += [(best[j][0] + pieces[text[j:i]], best[j][1] + 1) for j in range(i) if text[j:i] in pieces]
        best.append(max(ways, key=lambda x: (x[0], -x[1])))
    return best[-1][1]


def rebuilt(rows):
    """rows (conv, turn, role, text): the turns (role, text) of each rebuilt conversation by id."""
    own = collections.defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own[c].append((role or "", text or ""))
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def trie(convs):
    """convs: turns (role, text) by id; the figures of each node of the trie of prefixes."""
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    below = collections.defaultdict(lambda: [0, 0])
    for p, m in members.items():
        gain = (len(m) - 1) * len(re.findall(WS, p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            below[p[:d]][0] += not children[p]
            below[p[:d]][1] += gain
    ends = {p: ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p)))) for p, m in members.items()}
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], *below[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items()]


def super_minhash(elements, m, draws):
    """One element after the other, each with a permutation of its own; draws(element, step): place to swap in, and rank."""
    least = [None] * m
    for e in elements:
        order = list(range(m))
        for step in range(m):
            k, rank = draws(e, step)
            order[step], order[k] = order[k], order[step]
            if least[order[step]] is None or rank < least[order[step]]:
                least[order[step]] = rank
    return least


@functools.cache
def tokenizers(a_file="/opt/tokenizers/byte_bpe_50k.json", b_file="/opt/tokenizers/piece_bpe_32k.model"):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(a_file), sentencepiece.SentencePieceProcessor(model_file=b_file)
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code = {chr(x): x for x in shown} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in shown)}
    return a, b, code


def alignment(text):
    """Tokens of A and B of a whole text, its links (a, b), and its groups as text; None without tokens."""
    if not text:
        return None
    a, b, code = tokenizers()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(code[c] for c in a.id_to_token(i)) for i in ids_a]
    pieces = map(b.id_to_piece, ids_b)
    bytes_b = [bytes([int(p[1:-1], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    ends = lambda xs: {e: i for i, e in enumerate(itertools.accumulate(map(len, xs)))}
    ends_a, ends_b, links, groups, i, j = ends(bytes_a), ends(bytes_b), [], [], 0, 0
    for e in sorted(ends_a.keys() & ends_b.keys()):
        to_i, to_j = ends_a[e] + 1, ends_b[e] + 1
        links.append((ids_a[to_i - 1], ids_b[to_j - 1]))
        groups.append(",".join(map(str, ids_a[i:to_i])) + "|" + ",".join(map(str, ids_b[j:to_j])))
        i, j = to_i, to_j
    return len(ids_a), len(ids_b), links, ";".join(groups)


def alignments(texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), counts of pairs being those of all texts."""
    found = [alignment(t) for t in texts]
    counts = collections.Counter(x for f in found if f for x in f[2])
    most = collections.defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    none = (0, 0, 0, 0, 0, 0, "")
    return [none if f is None else (f[0], f[1], len(f[2]), len(f[2]), sum(counts[x] == most[x[1]] for x in f[2]), sum(counts[x] for x in f[2]), hashlib.sha256(f[3].encode()).hexdigest()) for f in found]
