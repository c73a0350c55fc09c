"""Per-text helper: Python source -> preorder node records and structural term hashes.

Called once per text inside a Spark task (``operators.terms`` wraps it in ``mapInArrow``); it
contains no Spark code and no cross-row state. Everything after it is relational.

Nodes are numbered in preorder (``pre``); the subtree of node ``i`` is ``[i, i + size - 1]``.
``height`` is the longest downward path (leaf = 0), so "some node at relative depth >= k"
is ``height >= k``. Hashes are computed bottom-up in O(n) (a 128-bit Merkle digest over the canonical
dump's structure, of which the first half is the term hash) unless an option makes the dump depend on the
term root, in which case the printed dump text is hashed. Dumps are made bottom-up too; nothing recurses.
"""
from __future__ import annotations

import ast
import struct
from decimal import Decimal
from typing import get_args

import xxhash

from ..config import TokenizerOptions

AST = ast.AST
_SEED = 42
_HALVES = struct.Struct(">qq").unpack
PARSE_ERRORS = (SyntaxError, ValueError, RecursionError, MemoryError, OverflowError)


def halves(digest: bytes) -> tuple[int, int]:
    """A 128-bit digest as two signed 64-bit integers: the term hash, and the check that tells hash clashes."""
    return _HALVES(digest)


def text_digest(text: str) -> tuple[int, int]:
    """Term hash and check of a printed term; the hash is that of ``xxhash64`` in Spark."""
    data = text.encode("utf-8", "surrogatepass")
    return halves(xxhash.xxh64_digest(data, seed=_SEED) + xxhash.xxh3_64_digest(data, seed=_SEED))


def scalar_text(value) -> str:
    """``repr`` of a field value that is neither a node nor a list; integers of any length in decimal digits."""
    if type(value) is int and value.bit_length() > 14_000:  # the interpreter refuses to print these
        return format(Decimal(value), "f")
    return repr(value)


class Dumps:
    """Canonical dumps of subtrees, made from the leaves up: ``Type(field=value, ...)``, ``[a, b]`` or ``repr``.

    A node keeps its variants by the number of levels that may still be printed below it (the last variant is the whole
    subtree; without ``max_depth`` it is the only one). They are put together from the variants of its values, so
    nothing recurses, and they go when the parent has used them.
    """

    def __init__(self, opts: TokenizerOptions) -> None:
        self.opts = opts
        self.drop_fields = opts.drop_field_names if opts.annotate_fields else frozenset()
        self.drop_values = opts.drop_field_values if opts.annotate_fields else frozenset()
        self.variants: dict[int, tuple[int, list[str]]] = {}  # by id(node): levels of the first, and all that may be asked for

    def _levels(self, value) -> int:
        """Levels below ``value`` in its longest dump."""
        if isinstance(value, AST):
            low, known = self.variants[id(value)]
            return low + len(known) - 1
        if type(value) is list:
            return 1 + max(map(self._levels, value)) if value else 0
        return 0

    def _shown(self, value, left: int | None) -> str:
        if left is not None and left < 0:
            return type(value).__name__
        if isinstance(value, AST):
            low, known = self.variants[id(value)]
            return known[-1 if left is None else min(left - low, len(known) - 1)]
        if type(value) is list:
            return "[" + ", ".join([self._shown(x, None if left is None else left - 1) for x in value]) + "]"
        return scalar_text(value)

    def _text(self, node, values: list, left: int | None) -> str:
        below = None if left is None else left - 1
        pieces = []
        for name, value in zip(node._fields, values, strict=True):
            if name in self.drop_fields:
                continue
            text = self._shown(value, below)
            if text not in self.drop_values:
                pieces.append(f"{name}={text}" if self.opts.annotate_fields else text)
        out = f"{type(node).__name__}({', '.join(pieces)}"
        if self.opts.include_attributes and node._attributes:
            shown = ", ".join([f"{a}={self._shown(getattr(node, a), below)}" for a in node._attributes])
            out += (", " if values else " ") + shown
        return out + ")"

    def add(self, node, values: list, depth: int) -> str:
        """The dump of ``node`` under the options, given that all nodes below it have been added. At ``depth`` below the topmost
        node that is printed, no more than two levels a step (a list is one) can be missing."""
        low = 0
        if self.opts.max_depth is None:
            made = [self._text(node, values, None)]
        else:
            levels = 1 + max(map(self._levels, values)) if values else 0
            if self.opts.include_attributes and node._attributes:
                levels = max(levels, 1)
            top = min(levels, self.opts.max_depth)
            low = min(top, max(0, self.opts.max_depth - 2 * depth - 2))
            made = [self._text(node, values, left) for left in range(low, top + 1)]
        for v in values:
            for x in v if type(v) is list else (v,):
                if isinstance(x, AST) and x._fields:  # nodes without fields may be one object in many places
                    self.variants.pop(id(x), None)
        self.variants[id(node)] = low, made
        return made[-1]


def _values(node) -> list:
    return [getattr(node, f, None) for f in node._fields]


def dump_text(node, opts: TokenizerOptions) -> str:
    """Canonical dump of the subtree of ``node``."""
    order, stack = [], [(node, 0)]
    while stack:
        x, depth = stack.pop()
        order.append((x, _values(x), depth))
        for v in order[-1][1]:
            stack += [(y, depth + 1) for y in (v if type(v) is list else (v,)) if isinstance(y, AST)]
    dumps, text = Dumps(opts), ""
    for x, values, depth in reversed(order):
        text = dumps.add(x, values, depth)
    return text


_NONE, _EMPTY = b"R\x04\x00\x00\x00None", b"L\x00\x00\x00\x00"


def _encode_value(value, marked: dict) -> bytes:
    """``marked``: ``A`` and the digest, by id(node)."""
    if value is None:
        return _NONE
    if isinstance(value, AST):
        return marked[id(value)]
    if isinstance(value, list):
        if not value:
            return _EMPTY
        known = marked.get
        return b"L" + len(value).to_bytes(4, "little") + b"".join([known(id(x)) or _encode_value(x, marked) for x in value])
    # hexadecimal digits of integers: the decimal form of a long one is refused by the interpreter
    r = (hex(value) if type(value) is int else repr(value)).encode("utf-8", "surrogatepass")
    return b"R" + len(r).to_bytes(4, "little") + r


class Parsed:
    """Flat preorder arrays of one parsed text."""

    __slots__ = ("order", "node_type", "depth", "parent", "size", "height", "term_hash", "term_check", "pos", "term_at",
                 "first_term_hash", "term_text", "n_terms")

    def __len__(self):
        return len(self.node_type)

    @property
    def lineno(self) -> list:
        return [getattr(x, "lineno", None) for x in self.order]


_FIELD_CACHE: dict = {}  # by the fields dropped: {node type: _type_info}


#: Field types of the grammar that never hold a node (a Python without ``_field_types`` has every field looked at).
_PLAIN_TYPES = (str, int, object, str | None, int | None, list[str])


def _type_info(cls, drop, known):
    """Per node type: (name, encoded name, [(field, b"|field=")] of the fields kept, fields that may hold nodes, the last first,
    ``A`` and the digest of a node without fields). ``known`` keeps it."""
    kinds = getattr(cls, "_field_types", {})
    below = tuple(f for f in reversed(cls._fields) if kinds.get(f) not in _PLAIN_TYPES)
    name = cls.__name__.encode()
    alone = None if cls._fields else b"A" + xxhash.xxh3_128_digest(name, seed=_SEED)
    info = known[cls] = (cls.__name__, name, [(f, b"|" + f.encode() + b"=") for f in cls._fields if f not in drop], below, alone)
    return info


def _bare(kind) -> bool:
    """Whether a field type of the grammar holds only nodes without fields (contexts and operators), alone or in a list."""
    kind = get_args(kind)[0] if get_args(kind) else kind
    types = kind.__subclasses__() if isinstance(kind, type) and issubclass(kind, AST) else []
    return bool(types) and not any(t._fields for t in types)


_OUTLINE: dict = {}


def _outline_info(cls):
    """Per node type: (name, fields that may hold nodes, the last first, those of them that hold nodes without fields, the others)."""
    below = _type_info(cls, frozenset(), {})[3]
    kinds = getattr(cls, "_field_types", {})
    bare = tuple(f for f in reversed(below) if _bare(kinds.get(f)))
    info = _OUTLINE[cls] = (cls.__name__, below, bare, tuple(f for f in below if f not in bare))
    return info


_RECORDS: dict = {}  # by the fields dropped: {node type: _records_info}


def _records_info(cls, drop, known):
    """``_type_info``, and the field of a node's context where nothing else is below the node (a name). The digest is there only
    for types that have no line either (a ``pass`` has one). Per field kept: its name, what comes before its value (with the
    node's name at the first), and the whole where the value is None or an empty list."""
    info = _type_info(cls, drop, {})
    if cls._attributes:
        info = (*info[:4], None)
    before = [(f, b"" if at else info[1], fb) for at, (f, fb) in enumerate(info[2])]
    fields = [(f, name + fb, name + fb + _NONE, name + fb + _EMPTY) for f, name, fb in before]
    bare = info[3][0] if len(info[3]) == 1 and getattr(cls, "_field_types", {}).get(info[3][0]) is ast.expr_context else None
    known[cls] = info = (*info, bare, fields)
    return info


def analyze(source: str, opts: TokenizerOptions, with_text: bool = False, hashes: bool = True) -> Parsed:
    """Parse ``source`` and return its nodes in preorder with term hashes. Raises PARSE_ERRORS.

    ``hashes=False`` skips hashing (term positions and counts only), for status-only callers."""
    tree = ast.parse(source)
    drop = frozenset(opts.drop_field_names) if opts.annotate_fields else frozenset()
    infos_of = _FIELD_CACHE.setdefault(drop, {})
    order, depth, parent, infos = [], [], [], []
    stack = [(tree, 0, -1)]
    push, pop = stack.append, stack.pop
    n = 0
    while stack:
        node, d, p = pop()
        order.append(node)
        depth.append(d)
        parent.append(p)
        cls = type(node)
        info = infos_of.get(cls)
        if info is None:
            info = _type_info(cls, drop, infos_of)
        infos.append(info)
        if info[3]:
            d += 1
            for f in info[3]:
                v = getattr(node, f, None)
                if isinstance(v, AST):
                    push((v, d, n))
                elif type(v) is list:
                    for x in reversed(v):
                        if isinstance(x, AST):
                            push((x, d, n))
        n += 1
    size = [1] * n
    height = [0] * n
    for i in range(n - 1, 0, -1):
        p = parent[i]
        size[p] += size[i]
        if height[i] >= height[p]:
            height[p] = height[i] + 1

    names = [info[0] for info in infos]
    min_depth = opts.min_depth or 0
    drop_nodes = opts.drop_node_names
    term_at = [i for i, h in enumerate(height) if h >= min_depth and names[i] not in drop_nodes]

    term_hash, term_check = [None] * n, [None] * n
    term_text = [None] * n if with_text else None
    pos = [None] * n
    for k, i in enumerate(term_at):
        pos[i] = k
    if hashes and term_at:
        # only nodes at or below a term matter (a term covers its whole subtree): disjoint intervals of the outermost terms
        outer, end = [], 0
        for i in term_at:
            if i >= end:
                end = i + size[i]
                outer.append((i, end))
        outer.reverse()
        if with_text or opts.uses_text_hash:
            dumps, same = Dumps(opts), {}
            for lo, end in outer:
                for i in range(end - 1, lo - 1, -1):
                    text = dumps.add(order[i], _values(order[i]), depth[i])
                    if pos[i] is not None:
                        if with_text:
                            term_text[i] = same.setdefault(text, text)  # equal subtrees share one text
                        if opts.uses_text_hash:
                            term_hash[i], term_check[i] = text_digest(text)
        if not opts.uses_text_hash:
            marked: dict = {}
            digest = xxhash.xxh3_128_digest
            for lo, end in outer:
                for i in range(end - 1, lo - 1, -1):
                    info = infos[i]
                    if info[4] is not None:  # ctx/operator singletons: no fields, one digest per type
                        marked[id(order[i])] = info[4]
                        continue
                    node = order[i]
                    parts = [info[1]]
                    for f, fb in info[2]:
                        v = getattr(node, f, None)
                        parts.append(fb)
                        parts.append(marked[id(v)] if isinstance(v, AST) else _encode_value(v, marked))
                    dg = digest(b"".join(parts), seed=_SEED)
                    marked[id(node)] = b"A" + dg
                    if pos[i] is not None:
                        term_hash[i], term_check[i] = _HALVES(dg)
            for i in term_at if min_depth < 1 else ():
                if infos[i][4] is not None:
                    term_hash[i], term_check[i] = _HALVES(infos[i][4][1:])

    # first term in each subtree's preorder (the first token of that subtree's own term stream)
    first = [None] * n
    if hashes and term_at:
        nxt = None
        for i in range(n - 1, -1, -1):
            if pos[i] is not None:
                nxt = i
            if nxt is not None and nxt < i + size[i]:
                first[i] = term_hash[nxt]

    out = Parsed()
    out.order = order
    out.node_type = names
    out.depth = depth
    out.parent = parent
    out.size = size
    out.height = height
    out.term_hash = term_hash
    out.term_check = term_check
    out.pos = pos
    out.term_at = term_at
    out.first_term_hash = first
    out.term_text = term_text
    out.n_terms = len(term_at)
    return out


def has_index_records(opts: TokenizerOptions) -> bool:
    """Whether :func:`index_records` knows the options: terms by digest, none of which has only a leaf below it."""
    return (opts.min_depth or 0) >= 2 and not opts.uses_text_hash


def index_records(source: str, opts: TokenizerOptions, lines: bool = True) -> tuple[int, int, tuple, dict]:
    """What an index keeps of ``source``: its nodes and terms, the records of the nodes line matching needs (as columns: pre,
    size, lineno, term hash, first term hash) and each term's positions, as :func:`analyze` finds them and
    ``operators.terms`` picks them. Contexts and operators are only numbered: they are never terms and have no line. Without
    ``lines`` no records are made. Raises PARSE_ERRORS."""
    tree = ast.parse(source)
    drop = frozenset(opts.drop_field_names) if opts.annotate_fields else frozenset()
    infos_of = _RECORDS.setdefault(drop, {})
    order, up, pre, size, height, infos = [], [], [], [], [], []  # of all nodes but contexts and operators
    marked: dict = {}
    stack = [(tree, -1)]
    push, pop = stack.append, stack.pop
    n = k = 0
    while stack:
        node, p = pop()
        cls = type(node)
        info = infos_of.get(cls) or _records_info(cls, drop, infos_of)
        if info[4] is not None:  # contexts and operators
            marked[id(node)] = info[4]
            size[p] += 1
            if not height[p]:
                height[p] = 1
            n += 1
            continue
        order.append(node)
        up.append(p)
        pre.append(n)
        infos.append(info)
        n += 1
        if info[5] is not None:  # a name, which has a context below it and nothing else
            n += 1
            size.append(2)
            height.append(1)
            x = getattr(node, info[5])
            marked[id(x)] = (infos_of.get(type(x)) or _records_info(type(x), drop, infos_of))[4]
        else:
            size.append(1)
            height.append(0)
            if info[3]:
                get = node.__dict__.get
                for f in info[3]:
                    v = get(f)
                    if v is None:
                        continue
                    if type(v) is list:
                        for x in reversed(v):
                            if isinstance(x, AST):
                                push((x, k))
                    elif isinstance(v, AST):
                        push((v, k))
        k += 1
    for i in range(k - 1, 0, -1):
        p, h = up[i], height[i]
        size[p] += size[i]
        if h >= height[p]:
            height[p] = h + 1

    least, dropped = opts.min_depth, opts.drop_node_names
    term_at = [i for i, h in enumerate(height) if h >= least and infos[i][0] not in dropped]
    own, first = [None] * k, [None] * k
    by_term: dict = {}
    if term_at:
        # a term covers its whole subtree: disjoint intervals of the outermost terms are hashed, from the last node to the first
        outer, end = [], 0
        for t in term_at:
            if pre[t] >= end:
                end = pre[t] + size[t]
                outer.append((t, end))
        outer.reverse()
        digest, known, i = xxhash.xxh3_128_digest, marked.get, k - 1
        for lo, end in outer:
            while pre[i] >= end:
                i -= 1
            for i in range(i, lo - 1, -1):
                info, node = infos[i], order[i]
                get, parts = node.__dict__.get, []
                part = parts.append
                for f, named, none, empty in info[6]:
                    v = get(f)
                    if v is None:
                        part(none)
                    elif type(v) is list:
                        if v:
                            part(named)
                            part(_encode_value(v, marked))
                        else:
                            part(empty)
                    else:
                        part(named)
                        part(known(id(v)) or _encode_value(v, marked))
                dg = digest(b"".join(parts) or info[1], _SEED)
                marked[id(node)] = b"A" + dg
                if height[i] >= least and info[0] not in dropped:
                    own[i] = _HALVES(dg)[0]
        for at, i in enumerate(term_at):
            by_term.setdefault(own[i], []).append(at)
    if not lines:
        return n, len(term_at), ((), (), (), (), ()), by_term
    if term_at:
        for i in range(k - 1, -1, -1):  # the first term of a subtree is that of the first node below that has one
            if own[i] is not None:
                first[i] = own[i]
            if first[i] is not None and i:
                first[up[i]] = first[i]

    kept, lines = [], []
    line_of, gap_of = [None] * k, [False] * k  # see operators.terms
    for i, node in enumerate(order):
        line, p, has = node.__dict__.get("lineno"), up[i], first[i] is not None
        above, gap = (line_of[p], gap_of[p]) if p >= 0 else (None, False)
        if line is None:
            line_of[i], gap_of[i] = above, gap or has
        else:
            line_of[i] = line
        if has or (line is not None and (line != above or gap)):
            kept.append(i)
            lines.append(line)
    columns = ([pre[i] for i in kept], [size[i] for i in kept], lines, [own[i] for i in kept], [first[i] for i in kept])
    return n, len(term_at), columns, by_term


def counts(source: str, opts: TokenizerOptions) -> tuple[int, int]:
    """Nodes and terms of ``source``, as :func:`analyze` counts them. Raises PARSE_ERRORS."""
    least = opts.min_depth or 0
    if least < 1:  # nodes without fields may be terms
        p = analyze(source, opts, hashes=False)
        return len(p), p.n_terms
    order, parent, height = [ast.parse(source)], [-1], []
    found, up, high = order.append, parent.append, height.append
    n, infos = 0, _OUTLINE
    for i, node in enumerate(order):  # it grows while it is read: a parent comes before its children
        cls, get = type(node), node.__dict__.get
        info = infos.get(cls) or _outline_info(cls)
        h = 0
        for f in info[2]:  # these have nothing below them: they are counted where they hang
            v = get(f)
            if v is not None:
                more = len(v) if type(v) is list else 1
                if more:
                    n += more
                    h = 1
        high(h)
        for f in info[3]:
            v = get(f)
            if v is None:
                continue
            if type(v) is list:
                for x in v:
                    if isinstance(x, AST):
                        found(x)
                        up(i)
            elif isinstance(v, AST):
                found(v)
                up(i)
    for i in range(len(order) - 1, 0, -1):
        p, h = parent[i], height[i]
        if h >= height[p]:
            height[p] = h + 1
    dropped = opts.drop_node_names
    return n + len(order), sum([1 for i, h in enumerate(height) if h >= least and type(order[i]).__name__ not in dropped])


def node_types(source: str, opts: TokenizerOptions, terms_only: bool = False) -> tuple[int, int, list[str]]:
    """Nodes and terms of ``source``, and the types of its nodes (``terms_only``: of its terms) in preorder, as
    :func:`analyze` finds them. Raises PARSE_ERRORS."""
    least, dropped = opts.min_depth or 0, opts.drop_node_names
    if least < 2:  # nodes with nothing but a context below them may be terms
        p = analyze(source, opts, hashes=False)
        return len(p), p.n_terms, [p.node_type[i] for i in p.term_at] if terms_only else p.node_type
    names, parent, height, inner = [], [], [], []  # all names; of the nodes that may be terms: parent, height, name
    name, up, high, into = names.append, parent.append, height.append, inner.append
    stack = [(ast.parse(source), -1)]
    push, pop = stack.append, stack.pop
    infos, k = _OUTLINE, 0
    while stack:
        node, p = pop()
        cls, get = type(node), node.__dict__.get
        info = infos.get(cls) or _outline_info(cls)
        name(info[0])
        if not info[1]:
            if p >= 0 and not height[p]:
                height[p] = 1
        elif not info[3]:  # e.g. a name and its context
            h = 1
            for f in info[2]:
                v = get(f)
                for x in v if type(v) is list else (v,):
                    if isinstance(x, AST):
                        name(type(x).__name__)
                        h = 2
            if p >= 0 and height[p] < h:
                height[p] = h
        else:
            up(p)
            high(0)
            into(info[0])
            for f in info[1]:
                v = get(f)
                if v is None:
                    continue
                if type(v) is list:
                    for x in reversed(v):
                        if isinstance(x, AST):
                            push((x, k))
                elif isinstance(v, AST):
                    push((v, k))
            k += 1
    for i in range(k - 1, 0, -1):
        p, h = parent[i], height[i]
        if h >= height[p]:
            height[p] = h + 1
    terms = [inner[i] for i, h in enumerate(height) if h >= least and inner[i] not in dropped]
    return len(names), len(terms), terms if terms_only else names


def terms_of(source: str, opts: TokenizerOptions) -> list[str]:
    """Term texts of ``source`` in stream order (for tests and audits)."""
    p = analyze(source, opts, with_text=True)
    return [t for t in p.term_text if t is not None]
