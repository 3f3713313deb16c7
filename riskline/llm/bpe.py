"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a pre-token there is exactly one last token of its encoding.
The vocabulary tokens that end at a position are read off a suffix automaton of
the vocabulary, longest first; the one that may follow the last token of the
prefix before it is stored.  Following the stored tokens back from the end
gives the exact ids, in time linear in the pre-token.

Two neighbouring tokens may stand side by side if no merge across their border
would have come first: merges apply in order of rank, and a piece at the border
is there until the rank that merges it into the next larger piece.

NULL text counts as empty and has no tokens; repeated rows are encoded each;
added columns replace columns of the same name; an empty table stays empty.
The vocabulary is read once on the driver and broadcast (a file of fixed size);
texts are handled row by row, so memory follows the longest text.
"""

from __future__ import annotations

import json
import re
import struct

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from riskline.llm.rowwise import with_columns_of

END = 0x10000
#: str.split() also splits at these four, which the tokenizer keeps.
CONTROL = re.compile("[\x1c-\x1f]")
BLANK = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
#: Chunks, pre-tokens and token pairs that a worker remembers, and their longest length: bounds its memory, not the result.
CHUNKS, PIECES, PAIRS, CACHED_CHARS = 400_000, 800_000, 2_000_000, 48
#: Below this character nothing composes with its neighbours, so normal form C changes nothing; of these only
#: the dotted capital I becomes two characters in lower case.
SIMPLE, DOTTED = "\u0300", "\u0130"
# The normaliser that lower-cases and the byte-level step, as tokenizer files write them.
LOWER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
# The split pattern that leaves a run of letters whole.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def _byte_chars() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next free one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


BYTE_CHARS = _byte_chars()


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Automaton:
    """Generalised suffix automaton of sequences (strings, or tuples of words), each with its number."""

    def __init__(self, strings: dict):
        self.next: list[dict] = [{}]
        self.link, self.size = [-1], [0]
        for s in strings:
            last = 0
            for c in s:
                last = self._extend(last, c)
        token = [-1] * len(self.next)
        for s, t in strings.items():
            state = 0
            for c in s:
                state = self.next[state][c]
            token[state] = t
        #: For each state the strings that end it and those above it, longest first, as (string, length).
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.size.__getitem__):
            above = self.ends[self.link[state]]
            self.ends[state] = ((token[state], self.size[state]), *above) if token[state] >= 0 else above

    def _state(self, size: int, link: int, arcs: dict) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.size.append(size)
        return len(self.next) - 1

    def _split(self, at: int, c, q: int) -> int:
        """A copy of ``q`` one longer than ``at``, which takes over the shorter strings of ``q``."""
        copy = self._state(self.size[at] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while at >= 0 and self.next[at].get(c) == q:
            self.next[at][c] = copy
            at = self.link[at]
        return copy

    def _extend(self, last: int, c) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.size[q] == self.size[last] + 1 else self._split(last, c, q)
        new = self._state(self.size[last] + 1, 0, {})
        at = last
        while at >= 0 and c not in self.next[at]:
            self.next[at][c] = new
            at = self.link[at]
        if at >= 0:
            q = self.next[at][c]
            self.link[new] = q if self.size[q] == self.size[at] + 1 else self._split(at, c, q)
        return new


class Encoder:
    """Encodes and decodes with the vocabulary and merges of a tokenizer file."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(spec)
        self.normalize, self.pieces = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        described = json.loads(spec)
        model = described["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        added = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.added = added
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.names = {i: t for t, i in (vocab | added).items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self._learn(vocab, merges)
        self.whole = self._reachable(vocab, merges)
        self.automaton = Automaton(self.whole)
        self.chunks: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}
        self.known: dict[str, tuple[bytes, str]] = {}
        self.fits: dict[int, bool] = {}
        self.split = self._simple_split(described)
        self.letters = self.split is not None and self.split.pattern == SPLIT

    def _simple_split(self, described: dict):
        """The split pattern, if the file's steps are those that ``_simple`` restates."""
        steps = (described["pre_tokenizer"] or {}).get("pretokenizers", [])
        if described["normalizer"] != LOWER or len(steps) != 2 or steps[1] != BYTES:
            return None
        cut = steps[0]
        fits = cut.get("type") == "Split" and cut.get("behavior") == "Removed" and cut.get("invert") is True
        return regex.compile(cut["pattern"]["Regex"]) if fits else None

    def _simple(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk of simple characters, as the library makes them."""
        text = chunk.lower()
        pieces = [text] if self.letters and chunk.isalpha() else self.split.findall(text)
        if chunk.isascii() and chunk.isprintable():
            return pieces
        return [p if p.isascii() and p.isprintable() else "".join([BYTE_CHARS[b] for b in p.encode()]) for p in pieces]

    def _marked(self, token: str) -> str:
        """The token with its end of word, if it has one, as a mark on its last character."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(ord(token[-1]) + END)
        return token

    def _learn(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        """Ranks of pairs, and for each token the pieces at its borders with the rank at which each is used up."""
        never = len(merges)
        self.width = max(vocab.values()) + 1
        self.rank: dict[int, int] = {}
        self.left = {i: [(i, never)] for i in vocab.values()}
        self.right = {i: [(i, never)] for i in vocab.values()}
        made: dict[int, int] = {}
        for r, (a, b) in enumerate(merges):
            x, y, whole = vocab[a], vocab[b], vocab[a + b]
            if made.get(x, -1) >= r or made.get(y, -1) >= r or whole in made:
                raise ValueError("merges are not in the order in which their parts are made")
            made[whole] = r
            self.rank[x * self.width + y] = r
            self.left[whole] = [(whole, never), (x, r), *self.left[x][1:]]
            self.right[whole] = [(whole, never), (y, r), *self.right[y][1:]]

    def _border(self, before: list[tuple[int, int]], after: list[tuple[int, int]]) -> bool:
        """Whether no merge across the border comes before its pieces are used up (of equal ranks the left one applies)."""
        rank, width = self.rank.get, self.width
        for a, until_a in before:
            at = a * width
            for b, until_b in after:
                r = rank(at + b)
                if r is not None and r < until_a and r <= until_b:
                    return False
        return True

    def _reachable(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> dict[str, int]:
        """The tokens that their own text is encoded as."""
        made = {vocab[a + b] for a, b in merges}
        good = {i for i in vocab.values() if i not in made}
        for r, (a, b) in enumerate(merges):
            x, y = vocab[a], vocab[b]
            if x in good and y in good and self._border([(x, r), *self.right[x][1:]], [(y, r), *self.left[y][1:]]):
                good.add(vocab[a + b])
        return {m: i for t, i in vocab.items() if i in good and (i in made or len(m := self._marked(t)) == 1) and (m := self._marked(t))}

    def tokens(self, piece: str) -> list[int]:
        """The ids of one pre-token."""
        if self.suffix:
            piece = piece[:-1] + chr(ord(piece[-1]) + END)
        if (own := self.whole.get(piece)) is not None:
            return [own]
        sam = self.automaton
        arcs, link, size, ends = sam.next, sam.link, sam.size, sam.ends
        fits, width = self.fits, self.width
        last, back = [-1] * (len(piece) + 1), [0] * (len(piece) + 1)
        state = matched = i = 0
        for c in piece:
            i += 1
            to = arcs[state].get(c)
            while to is None and state:
                state = link[state]
                matched = size[state]
                to = arcs[state].get(c)
            if to is not None:
                state = to
                matched += 1
            for t, n in ends[state if size[state] <= matched else link[state]]:
                if n == i:
                    last[i] = t
                    break
                p = last[i - n]
                key = p * width + t
                try:
                    ok = fits[key]
                except KeyError:
                    ok = fits[key] = p >= 0 and self._border(self.right[p], self.left[t])
                if ok:
                    last[i], back[i] = t, i - n
                    break
        out = []
        i = len(piece)
        while i:
            if last[i] < 0:
                raise ValueError("a character has no token of its own")
            out.append(last[i])
            i = back[i]
        return out[::-1]

    def piece(self, piece: str) -> tuple[bytes, str]:
        """Ids (little-endian, unsigned, 32 bits) and decoded text of a pre-token."""
        made = self.known.get(piece)
        if made is None:
            ids = self.tokens(piece)
            made = _packed(ids), " ".join([self.names[t] for t in ids])
            if len(self.fits) > PAIRS:
                self.fits.clear()
            if len(piece) <= CACHED_CHARS:
                if len(self.known) >= PIECES:
                    self.known.clear()
                self.known[piece] = made
        return made

    def chunk(self, chunk: str) -> tuple[bytes, str]:
        """Ids and decoded text of a run without white space."""
        made = self.chunks.get(chunk) or self.older.get(chunk)
        if made is None:
            if self.split and (chunk.isascii() or max(chunk) < SIMPLE and DOTTED not in chunk):
                pieces = self._simple(chunk)
            else:
                pieces = [p for p, _ in self.pieces(self.normalize(chunk))]
            made = self.piece(pieces[0]) if len(pieces) == 1 else self._joined([self.piece(p) for p in pieces])
        if len(chunk) <= CACHED_CHARS:
            if len(self.chunks) >= CHUNKS:  # what is still in use comes back from the older half
                self.older, self.chunks = self.chunks, {}
            self.chunks[chunk] = made
        return made

    @staticmethod
    def _joined(parts: list[tuple[bytes, str]]) -> tuple[bytes, str]:
        if not parts:
            return b"", ""
        ids, decoded = zip(*parts, strict=True)
        return b"".join(ids), " ".join(filter(None, decoded))

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids and decoded text of a whole text."""
        parts: list[tuple[bytes, str]] = []
        known = self.chunks
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                parts.append((_packed([self.added[part]]), part))
                continue
            chunks = part.split() if CONTROL.search(part) is None else [c for c in BLANK.split(part) if c]
            found = list(map(known.get, chunks))
            if None in found:
                found = [f or self.chunk(c) for f, c in zip(found, chunks, strict=True)]
            parts += found
        return self._joined(parts)


_ENCODERS: dict[int, Encoder] = {}


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` (binary: little-endian unsigned 32-bit integers) and ``decoded``, from the tokenizer file at ``path``."""
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    fields = [T.StructField("token_ids", T.BinaryType()), T.StructField("decoded", T.StringType())]

    def start():
        key = hash(spec.value)
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(spec.value)
        return _ENCODERS[key].encode

    return with_columns_of(docs, text, fields, start)
