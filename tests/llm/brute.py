"""Plain versions of the operators, one row after another, to hold the Spark versions against."""

import collections
import hashlib
import itertools
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def base_rules(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            inside.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside), failed,
    )


def components(rows):
    """doc_id, n_shingles, component_id."""
    sets = []
    for _, text in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        common = collections.Counter(j for x in s for j in holders[x])
        for j, k in common.items():
            if rows[i][0] is not None and rows[j][0] is not None and 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                parent[find(i)] = find(j)
        for x in s:
            holders[x].append(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return ordered((doc, len(sets[i]), None if doc is None else least[find(i)]) for i, (doc, _) in enumerate(rows))


def without_repeats(rows):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    first = {}
    data = [(doc, (text or "").encode()) for doc, text in rows]
    for doc, b in data:
        for p in range(len(b) - 49 if doc is not None else 0):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], doc), doc)
    out = []
    for doc, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - 49 if doc is not None else 0):
            if first[b[p : p + 50]] < doc:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return ordered(out)


def filter_audit(docs, labels):
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley; docs: (doc_id, text, source)."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    known = []
    for i, text, source in docs:
        text = text or ""
        words = WORD.findall(text)
        failed = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and first[text] < i,
        }
        known.append((source or "", {f for f in failed if failed[f]}, i is not None and i in good, i is not None and i in toxic))
    out = []
    for part in {k[0] for k in known}:
        here = [k for k in known if k[0] == part]
        rows, shapley = [], collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = here
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in k[1]]
                left = [k for k in left if f not in k[1]]
                redundant = sum(f in k[1] for k in here) - len(gone)
                shapley[f] += len(gone)
                rows.append((
                    "".join(order), step, len(left), len(gone), redundant, sum(k[1] == {f} for k in here), sum(k[2] for k in gone), sum(k[3] for k in gone),
                ))
        out += [(part, *r, shapley[r[0][r[1] - 1]]) for r in rows]
    return ordered(out)


def prefix_trie(rows):
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; rows: (conv_id, turn, role, text)."""
    said = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            said[conv].append((turn is not None, turn or 0, digest, (role, text)))
    said = {c: [t[-1] for t in sorted(x)] for c, x in said.items()}
    members, ends, children = collections.defaultdict(list), collections.defaultdict(list), collections.defaultdict(set)
    for c, own in sorted(said.items()):
        h = zlib.crc32(str(c).encode()) % 4
        way = tuple(said.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])
        ends[way].append(c)
        for d in range(len(way) + 1):
            members[way[:d]].append(c)
            if d:
                children[way[: d - 1]].add(way[:d])
    out = {}
    for node in sorted(members, key=len, reverse=True):
        below = [out[x] for x in children[node]]
        saved = (len(members[node]) - 1) * (len(WORD.findall(node[-1][1])) if node else 0)
        out[node] = (
            members[node][0], len(node), members[node[:-1]][0] if node else None, len(members[node]), len(below),
            sum(x[5] for x in below) or 1, saved + sum(x[6] for x in below), hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest(),
        )
    return ordered(out.values())


def contamination(docs, items):
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    windows = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - 9, 1 if w else 0)):
            windows[tuple(w[i : i + 10])].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for m in {len(x) for x in windows}:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in windows:
                    hit.update(range(i, i + m))
                    found |= windows[tuple(w[i : i + m])] - {None}
        names = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return ordered(out)
