"""Fixture corpus (FIXTURES §2-§4): eight code templates, queries and their goldens."""
from __future__ import annotations

# FIXED values: template texts, ``{k}`` is a free name suffix (names never reach a term).
TEMPLATES = {
    0: "v{k} = cfg.load()\nw{k} = v{k} + 3\n",
    1: "def f{k}(a, b):\n    total = a * b\n    return total.sum() + 3\n",
    2: "class C{k}(Base):\n    def run(self, n):\n        for i in range(n):\n            self.items.append(i)\n        return self.items\n",
    3: "def broken{k}(:\n    return 3\n",
    4: "x{k} = 3\n",
    5: "import os\n\nz = 1\nrows = [r.key for r in data if r.size > 3]\nprint(rows[0].name)\n",
    6: "",
    7: "a = 1\n\n\nb = 2\ntry:\n    go.fast(3)\nexcept ValueError as e:\n    log.warn(e)\n    raise\n",
}
NODES = {0: 17, 1: 23, 2: 31, 4: 5, 5: 38, 6: 1, 7: 29}
TERMS = {0: 1, 1: 3, 2: 5, 4: 0, 5: 5, 6: 0, 7: 4}
# query templates ({k} free) and the corpus template each one hits, with its matched term count
QUERIES = {
    0: ("q{k} = k.load()", 0, 1),
    1: ("for j in range(m{k}):\n    o.items.append(j)", 2, 3),
    2: ("p{k}.fast(3)", 7, 1),
    3: ("def g{k}(p, q):\n    t = p * q\n    return t.sum() + 3", 1, 3),
    4: (TEMPLATES[5], 5, 5),
    5: ("x{k} = 1", None, 0),
    6: ("def broken{k}(:\n    return 3\n", None, None),
}


def template_text(t: int, k: int | str = "") -> str:
    return TEMPLATES[t].replace("{k}", str(k))
