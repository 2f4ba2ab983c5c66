"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter

GAP = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return GAP.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text, k):
    w = words(text)
    return [tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def components(ids, linked):
    """Smallest reachable id of each, for a list of linked index pairs."""
    up = list(range(len(ids)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in linked:
        i, j = root(i), root(j)
        if i != j:
            i, j = sorted((i, j), key=lambda x: ids[x])
            up[j] = i
    return [ids[root(i)] for i in range(len(ids))]


def jaccard_links(sets, percent):
    """Index pairs of sets that link; pairs without a common element are passed by."""
    found = []
    by_element = {}
    for j, s in enumerate(sets):
        common = Counter(i for x in s for i in by_element.get(x, ()))
        found += [(i, j) for i, n in common.items() if 100 * n >= percent * (len(s) + len(sets[i]) - n)]
        for x in s:
            by_element.setdefault(x, []).append(j)
    return found


def contamination(texts, items, percent=80, k=5):
    """Pairs (text, item) with a window of the item's size that is similar enough."""
    found = set()
    for t, text in enumerate(texts):
        for i, item in enumerate(items):
            wanted = shingles(item, k)
            own = shingles(text, min(k, len(words(item)) or 1))
            if not set(own) & set(wanted):
                continue
            counts = Counter(wanted)
            for at in range(1 - len(wanted), len(own)):
                window = Counter(own[max(0, at):max(0, at + len(wanted))])
                if 100 * (window & counts).total() >= percent * (window | counts).total():
                    found.add((t, i))
                    break
    return found


# The patterns as the task states them.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base_spans(text):
    found = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fits = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                    "card": 14 <= len(digits) <= 19 and _luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if fits:
                found.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [text for _, _, text in sorted(found)]


def digest(spans):
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_paths(nodes, fanout=8):
    """Root of a list of digests, and for each its (left, right) siblings by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = p // fanout * fanout
            paths[i].append(("".join(nodes[run:p]), "".join(nodes[p + 1:run + fanout])))
        at = [p // fanout for p in at]
        nodes = [sha(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def dataset_manifest(rows):
    """Rows (key, leaf, subroot, root, proof, folded) of (key, group, leaf, altered) rows."""
    first = lambda x: (x is not None, x)
    groups = {}
    for key, group, leaf, altered in sorted(rows, key=lambda r: (first(r[0]), r[2])):
        groups.setdefault(group, []).append((key, leaf, altered))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree_paths([leaf for _, leaf, _ in groups[g]]) for g in names]
    root, tops = tree_paths([t[0] for t in trees])
    out = []
    for name, (subroot, paths), top in zip(names, trees, tops):
        for (key, leaf, altered), path in zip(groups[name], paths):
            folded = altered or leaf
            for left, right in path + top:
                folded = sha(left, folded, right)
            out.append((key, leaf, subroot, root, sha(*(l + r for l, r in path + top)), folded))
    return out


def trie(conversations):
    """Node rows of {conv_id: [(role, text), ...]}."""
    nodes = {}
    for conv, turns in conversations.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(conv)
    out = []
    for node, members in nodes.items():
        under = [n for n in nodes if n[:len(node)] == node]
        leaves = [n for n in under if not any(m[:-1] == n for m in nodes if m)]
        saved = sum((len(nodes[n]) - 1) * len(n[-1][1].encode()) for n in under if n)
        ends = sorted(c for c in members if len(conversations[c]) == len(node))
        out.append((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members),
                    sum(1 for m in nodes if m and m[:-1] == node), len(leaves), saved, sha(",".join(map(str, ends)))))
    return out


def without_repeats(rows, window=13):
    """(doc_id, n_words, n_removed, digest of the kept words) of (doc_id, text) rows."""
    lists = [GAP.findall(text or "") for _, text in rows]
    first = {}
    for (doc, _), ws in zip(rows, lists):
        for i in range(len(ws) - window + 1 if doc is not None else 0):
            key = tuple(ws[i:i + window])
            first[key] = min(doc, first.get(key, doc))
    out = []
    for (doc, _), ws in zip(rows, lists):
        gone = set()
        for i in range(len(ws) - window + 1 if doc is not None else 0):
            if first[tuple(ws[i:i + window])] < doc:
                gone.update(range(i, i + window))
        out.append((doc, len(ws), len(gone), sha(" ".join(w for i, w in enumerate(ws) if i not in gone))))
    return out
