"""Operator 10, BPE encoding by backtracking and decoding by an offset table.

A word's symbols are its bytes, the last one marked as the end of the word. The Aho-Corasick automaton over all tokens
gives the longest token that starts at a position. The encoder takes longest tokens and goes back to a shorter one
only when a pair cannot stand side by side: the pair table tells whether merging by rank would have joined symbols across
their border. Positions from which no encoding goes on are remembered, so each is tried once and the work is linear in
the word. The result equals merging the lowest-ranked pair again and again.

Decoding keeps all token strings in one byte buffer with an offset per id, and gathers the ranges of many ids at once.
"""
from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from .common import prepare, table, with_columns_of_text

#: Words (in each of two generations) and pairs that a worker remembers; caches only, results do not depend on them.
WORD_CACHE, PAIR_CACHE = 200_000, 250_000
DECODE_STEP = 1 << 18  # ids decoded at once
#: FIXED values of the byte-level alphabet: printable bytes stand for themselves, the others for code points from 256.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: FIXED: white space of Unicode.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LOW = 0x530
#: Private code points that mark a word's last symbol.
END = 0xF0000


def byte_alphabet() -> list[str]:
    rest = iter(range(256, 512))
    keep = set(PRINTABLE)
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


def load_spec(path: str) -> dict:
    """What encoding needs of a tokenizer file (a BPE model with a word-end suffix), small enough to ship to tasks.
    Its size is that of the vocabulary file, a fixed parameter."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    m = d["model"]
    pattern = d["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in m["merges"]]
    return {"vocab": m["vocab"], "merges": merges, "suffix": m["end_of_word_suffix"], "pattern": pattern,
            "special": {t["content"]: t["id"] for t in d["added_tokens"]}}


def category_class(major: str, below: int) -> str:
    """Code point ranges of a general category, from Python's own tables (the library's engine has the same
    version of Unicode)."""
    out, start = [], None
    for c in range(below + 1):
        inside = c < below and unicodedata.category(chr(c))[0] == major
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append((start, c - 1))
            start = None
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


class WordBpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, spec: dict) -> None:
        vocab, suffix = spec["vocab"], spec["suffix"]
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.alphabet = byte_alphabet()
        marked = {t: self._marked(t, suffix) for t in vocab}
        self.id_of = {marked[t]: i for t, i in vocab.items()}
        self.by_id = {i: marked[t] for t, i in vocab.items()}
        # rank of a token: symbols first, then in the order of the merges that make them
        self.rank: dict[int, int] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.pair: dict[tuple[int, int], int] = {}
        symbols = [i for i, t in self.by_id.items() if len(t) == 1]
        for n, i in enumerate(symbols):
            self.rank[i], self.split[i] = n, (i, i)
        for n, (a, b) in enumerate(spec["merges"]):
            ia, ib, whole = vocab[a], vocab[b], vocab[a + b]
            self.pair.setdefault((ia, ib), len(symbols) + n)
            if whole not in self.split:
                self.rank[whole], self.split[whole] = len(symbols) + n, (ia, ib)
        self.automaton = ahocorasick.Automaton()
        for i in self.split:  # tokens that no merge makes can't be produced
            self.automaton.add_word(self.by_id[i], i)
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        # Contractions begin with an apostrophe, so the order of the alternatives is free. Texts without characters from
        # LOW on (nearly all) take the same pattern with shorter classes.
        self.low, self.full = (self._pattern(spec["pattern"], n) for n in (LOW, 0x110000))
        self.high = re.compile(f"[{chr(LOW)}-{chr(0x10FFFF)}]")
        self.special = spec["special"]
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        top = max([*vocab.values(), *self.special.values()]) + 1
        strings = [""] * top
        for t, i in [*vocab.items(), *self.special.items()]:
            strings[i] = t
        parts = [(s + " ").encode() for s in strings]
        self.buffer = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    @staticmethod
    def _marked(token: str, suffix: str) -> str:
        if suffix and token.endswith(suffix) and len(token) > len(suffix):
            token = token[: -len(suffix)]
            return token[:-1] + chr(END + ord(token[-1]))
        return token

    @staticmethod
    def _pattern(pattern: str, below: int) -> re.Pattern:
        *contractions, words, number, rest = pattern.split("|")
        pattern = "|".join([words, f"(?:{'|'.join(contractions)})", number, rest] if contractions else [words, number, rest])
        return re.compile(pattern.replace(r"\p{L}", category_class("L", below)).replace(r"\p{N}", category_class("N", below)).replace(r"\s", WHITE))

    # pairs

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves ``left`` and ``right`` side by side: undo the merges of both, the latest first,
        and see that at no earlier point a pair across the border would have been merged first."""
        rank, split, pair = self.rank, self.split, self.pair
        limit = 1 << 60
        a, b = left, right
        while True:
            merged = pair.get((a, b))
            if merged is not None and merged < limit:
                return False
            ra, rb = rank[a], rank[b]
            a2, b2 = split[a][1], split[b][0]
            if ra > rb and a2 != a or b2 == b and a2 != a:
                # the left token was made last; across the border its right half stood before that
                limit, a = min(limit, ra), a2
            elif b2 != b:
                # pairs of equal rank merge from the left: the border pair goes first
                limit, b = min(limit, rb + 1), b2
            else:
                return True

    def compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > PAIR_CACHE:
                self.fits.clear()
            known = self.fits[key] = self._compatible(left, right)
        return known

    # encoding

    def _longest(self, word: str, at: int) -> int:
        return next(self.automaton.iter_long(word, at))[1]

    def _prefix(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``; -1: none."""
        known = self.shorter.get(token)
        if known is None:
            s, known = self.by_id[token], -1
            for n in range(len(s) - 1, 0, -1):
                i = self.id_of.get(s[:n])
                if i is not None and i in self.split:
                    known = i
                    break
            self.shorter[token] = known
        return known

    def symbols(self, word: str) -> str:
        s = "".join(map(self.alphabet.__getitem__, word.encode()))
        return s[:-1] + chr(END + ord(s[-1]))

    def encode_symbols(self, s: str) -> list[int]:
        out: list[int] = []
        dead = bytearray(len(s) + 1)
        at, token = 0, self._longest(s, 0)
        by_id = self.by_id
        while True:
            end = at + len(by_id[token])
            if not dead[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                if at == len(s):
                    return out
                token = self._longest(s, at)
                continue
            shorter = self._prefix(token)
            while shorter < 0:  # nothing goes on from here: go back by one token
                dead[at] = 1
                last = out.pop()
                at -= len(by_id[last])
                shorter = self._prefix(last)
            token = shorter

    def _ids(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = np.array(self.encode_symbols(self.symbols(word)), dtype="<u4").tobytes()
        if len(self.words) >= WORD_CACHE:  # words that come again are carried over as they do
            self.older, self.words = self.words, {}
        self.words[word] = ids
        return ids

    def encode_ordinary(self, text: str, out: list[bytes]) -> None:
        """Appends the ids of a text's words; special strings are text like any other."""
        if not text.isascii():
            # single characters are lowered one by one: no special final sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        for w in (self.full if self.high.search(text) else self.low).findall(text):
            out.append(self.words.get(w) or self._ids(w))

    def encode(self, text: str) -> bytes:
        """Token ids of a text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        if self.cut is None or "<" not in text:
            self.encode_ordinary(text, out)
        else:
            for n, part in enumerate(self.cut.split(text)):
                if n % 2:
                    out.append(np.uint32(self.special[part]).tobytes())
                elif part:
                    self.encode_ordinary(part, out)
        return b"".join(out)

    # decoding

    def decode_bytes(self, ids: np.ndarray):
        """The decoded text in UTF-8, in steps: token strings, a space between them."""
        for k in range(0, len(ids), DECODE_STEP):
            part = ids[k : k + DECODE_STEP].astype(np.int64)
            start = self.offset[part]
            n = self.offset[part + 1] - start
            ends = np.cumsum(n)
            at = np.arange(int(ends[-1])) + np.repeat(start - (ends - n), n)
            chunk = self.buffer[at]
            yield (chunk[:-1] if k + DECODE_STEP >= len(ids) else chunk).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.decode_bytes(ids)).decode()


_LOADED: dict[str, WordBpe] = {}


def _bpe(key: str, shipped) -> WordBpe:
    """One encoder per worker process."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBpe(shipped.value)
    return _LOADED[key]


def _run(df: DataFrame, path: str, keep: list[str], row, fields: str) -> DataFrame:
    spark = prepare(df)
    shipped = spark.sparkContext.broadcast(load_spec(path))

    def make():
        bpe = _bpe(path, shipped)
        return lambda texts: list(zip(*[row(bpe, t) for t in texts], strict=True)) or [[] for _ in fields.split(", ")]

    return with_columns_of_text(df, keep, make, fields)


def _digest(bpe: WordBpe, text: str):
    ids = bpe.encode(text)
    h = hashlib.sha256()
    for part in bpe.decode_bytes(np.frombuffer(ids, dtype="<u4")):
        h.update(part)
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), h.hexdigest()


def encode_documents(df: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``ids`` (array of int), ``n_tokens`` and ``decoded`` for its column ``text``; null and empty texts
    have no tokens. Columns of ``keep`` (all, if None) stay; a clash of names with the three is an error."""
    keep = [c for c in df.columns if keep is None or c in keep]

    def row(bpe: WordBpe, text: str):
        ids = np.frombuffer(bpe.encode(text), dtype="<u4")
        return len(ids), ids.astype("int32"), bpe.decode(ids)

    return _run(df, path, keep, row, "n_tokens long, ids array<int>, decoded string")


def encode_digests(df: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens and SHA-256 of the ids and of the decoded text."""
    return _run(df, path, ["doc_id"], _digest, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole document encoded and decoded with the public word BPE vocabulary."""
    return encode_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path())
