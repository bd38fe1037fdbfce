"""Brute-force versions that several tests use."""

import re

from shotplane.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def base(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def linked(text):
    masked = text
    for p in (ASSIGN.pattern, "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"):
        masked = re.sub(p, lambda m: "\x01" * len(m[0]), masked, flags=re.A | (re.I if p == ASSIGN.pattern else 0))
    parts = [(s, k, e) for s, _, k, e in base(text)]
    weak = []
    for kind, p in (("ident", secrets.IDENT), ("key", secrets.KEY), ("endpoint", secrets.ENDPOINT)):
        for m in re.finditer(p, masked, re.A):
            if kind != "key" or all(re.search(c, m[0]) for c in ("[0-9]", "[A-Z]", "[a-z]")):
                weak.append((m.start(), list(secrets.KINDS).index(kind), kind, m.end()))
    parts += [(s, k, e) for s, _, k, e in weak]
    return [w for w in weak if any(max(s - w[3], w[0] - e) <= secrets.SCOPE and secrets.KINDS[k] in secrets.COMPLEMENTS[w[2]] for s, k, e in parts)]


def linked_spans(text):
    return sorted(base(text) + linked(text))
