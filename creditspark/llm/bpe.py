"""Encoding and decoding by a byte-pair merge list, as a streaming transducer.

Encoding.  For every position of a word one token ends the tokenization of the text up to there.  It is found
from the tokens that end there: exactly one of them keeps its border with the token before it, that
is, no merge of a lower rank would have crossed the border.  Borders are judged by undoing the later merge
on either side.  So the transducer reads symbols one by one and keeps, per position, the start
of its last token.  Later tokens reach back at most the longest token, so a token is stable, and is
emitted, as soon as the chains of all positions within that reach agree on it.

Memory.  A merge across a border can be prevented only by a merge of lower rank further right, that one by
another of yet lower rank, and so on.  `sufficient_lookahead` adds up the longest such chain of the merge list:
what lies further ahead cannot change a token.  That number is only tested, it does not govern the encoder: words of up to four
times the longest token are encoded whole, in longer ones a token waits until the chains agree, for which the code sets no
bound.  Texts are read in pieces cut before white space.

Decoding.  A state machine takes token after token and emits text.  Where the tokenizer names no decoder, the text
is the token strings with one space between; `BytesDecoder` instead restores the bytes and emits
characters as soon as their last byte has come.

Defined cases: a null text counts as empty; an empty text has no tokens, and its digests are those of empty
strings; special tokens written in a text are encoded as such, as the tokenizers library does; repeated rows are encoded each; extra
columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from creditspark.llm.common import pieces

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Characters of a text handled at once.
PIECE = 1 << 18
#: Words remembered with their tokens, twice (a current and a previous generation).
REMEMBERED = 120_000
_END = "</w>"
_NO_RANK = -1


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable bytes for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols after a border that can decide whether it holds, at most.

    The border between x and y of a merge (x, y) is undecided as long as a merge of lower rank can take y's last
    symbol away; that merge starts with the symbol y ends with, and is itself undecided as far as its own right part.
    """
    reach: dict[str, int] = {}  # first-part end symbol -> longest chain of the merges so far
    longest = 0
    for left, right in merges:
        ends = right[-1] if not right.endswith(_END) else right
        own = len(right.removesuffix(_END)) + reach.get(ends, 0)
        longest = max(longest, own)
        starts = left[-1] if not left.endswith(_END) else left
        reach[starts] = max(reach.get(starts, 0), own)
    return longest


#: Fixed values.  Unicode 16 letters and numbers that the tokenizers library knows and Python's tables may not know yet.
_NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
_NEW_NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
    (0x1E5F1, 0x1E5FA),
)
#: Fixed values.  Capitals whose small letters Python's tables may not know yet, and two rows of such capitals (first, last, distance).
_NEW_SMALL = {
    0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B,
}
_NEW_ROWS = ((0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27))
_SMALL = {ord("Σ"): "σ", **_NEW_SMALL, **{c: c + d for a, b, d in _NEW_ROWS for c in range(a, b + 1)}}
_RARE = re.compile("[" + "".join(map(chr, _SMALL)) + "]")
#: Characters from here on may have other classes in other versions of Unicode.
_LATER = re.compile("[\u0500-\U0010ffff]")
#: The white space of the Unicode standard, as a part of a character class.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def character_class(kind: str, more: tuple[tuple[int, int], ...]) -> str:
    """All code points of a general category (L, N), as a part of a character class."""
    points = sorted({c for c in range(0x110000) if unicodedata.category(chr(c))[0] == kind}
                    | {c for a, b in more for c in range(a, b + 1)})
    parts, start = [], points[0]
    for here, after in zip(points, [*points[1:], -1]):
        if after != here + 1:
            parts.append(f"\\U{start:08x}-\\U{here:08x}")
            start = after
    return "".join(parts)


class Tokenizer:
    """A merge list with word ends, its vocabulary, and the rules that cut a text into words."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.pair_rank = {(self.ids[a], self.ids[b]): i for i, (a, b) in enumerate(merges)}
        size = max([*self.ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.rank, self.left, self.right = [_NO_RANK] * size, [0] * size, [0] * size
        for i, (a, b) in enumerate(merges):
            t = self.ids[a + b]
            self.rank[t], self.left[t], self.right[t] = i, self.ids[a], self.ids[b]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * size
        for s, i in [*self.ids.items(), *self.special.items()]:
            self.strings[i] = s
        self.longest = max(len(s.removesuffix(_END)) for s in self.ids)
        self.lookahead = sufficient_lookahead(merges)
        self.alphabet = byte_alphabet()
        self.to_symbols = {b: c for b, c in enumerate(self.alphabet)}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._find_settled = regex.compile(pattern).findall  # faster, and the same where no character class has changed
        pattern = pattern.replace(r"\s", _SPACE)
        for kind, more in (("L", _NEW_LETTERS), ("N", _NEW_NUMBERS)):
            pattern = pattern.replace(rf"\p{{{kind}}}", character_class(kind, more))
        self._find_any = re.compile(pattern).findall
        self._holds: dict[tuple[int, int], bool] = {}
        #: every ending of a token -> the token that it is, or -1: a search to the left stops where no token goes on
        self.endings: dict[str, int] = {}
        for s, i in self.ids.items():
            self.endings[s] = i
            for j in range(1, len(s.removesuffix(_END))):
                self.endings.setdefault(s[j:], -1)

    def find_words(self, text: str) -> list[str]:
        return (self._find_any if not text.isascii() and _LATER.search(text) else self._find_settled)(text)

    def holds(self, a: int, b: int) -> bool:
        """Whether the tokens a, b in a row stay as they are, that is, no merge crosses the border between them."""
        known = self._holds.get((a, b))
        if known is None:
            if len(self._holds) > 1_000_000:
                self._holds.clear()
            known = self._holds[a, b] = self._border(a, b)
        return known

    def _border(self, a: int, b: int) -> bool:
        rank, before = self.rank, len(self.rank)
        while True:
            crossing = self.pair_rank.get((a, b))
            if crossing is not None and crossing < before:
                return False
            if rank[a] == rank[b] == _NO_RANK:
                return True
            if rank[a] > rank[b]:
                before, a = rank[a], self.right[a]
            else:  # of equal ranks the one further left is merged first
                before, b = rank[b] + 1, self.left[b]

    def encode_word(self, symbols: str) -> list[int]:
        """The tokens of a whole word; the short ones, which fit the window, without the machinery of the stream."""
        n = len(symbols)
        if n > 4 * self.longest:
            return list(self.stream(symbols))
        get, known = self.endings.get, self._holds
        tokens, starts = [-1], [0]
        for i in range(1, n + 1):
            tail = symbols[:i] if i < n else symbols + _END
            j = i - 1
            while True:
                t = get(tail[j:])
                if t is None or j < 0:
                    raise ValueError("a symbol is not in the vocabulary")
                if t >= 0:
                    if not j:
                        break
                    p = tokens[j]
                    if known[p, t] if (p, t) in known else self.holds(p, t):
                        break
                j -= 1
            tokens.append(t)
            starts.append(j)
        return self._path(tokens, starts, n)

    def _last(self, window: str, i: int, tail: str, tokens: list[int], before: int) -> tuple[int, int]:
        """The last token of the text up to i, and its start."""
        get, known = self.endings.get, self._holds.get
        for j in range(i - 1, -1, -1):
            t = get(window[j:i] + tail)
            if t is None:
                break
            if t >= 0:
                p = tokens[j] if j else before
                if p < 0 or (h := known((p, t))) or (h is None and self.holds(p, t)):
                    return t, j
        raise ValueError("a symbol is not in the vocabulary")

    def stream(self, symbols: Iterable[str]) -> Iterator[int]:
        """Tokens of a word, given symbol by symbol; a token is emitted once it is stable."""
        longest = self.longest
        window = ""  # the symbols after the last stable position
        tokens, starts = [-1], [0]  # per position of the window: its last token and where that begins
        before = -1  # the last stable token
        source = iter(symbols)
        held = next(source, None)
        while held is not None:
            symbol, held = held, next(source, None)
            window += symbol
            i = len(window)
            t, j = self._last(window, i, _END if held is None else "", tokens, before)
            tokens.append(t)
            starts.append(j)
            if i >= 4 * longest and held is not None and i % longest == 0:
                at = self._agreed(starts, i)
                if at:
                    out = self._path(tokens, starts, at)
                    yield from out
                    before = out[-1]
                    window = window[at:]
                    tokens = [-1, *tokens[at + 1:]]
                    starts = [0, *(s - at for s in starts[at + 1:])]
        if window:
            yield from self._path(tokens, starts, len(window))

    def _agreed(self, starts: list[int], i: int) -> int:
        """The last position that the chains of all positions a later token can start from have in common."""
        live = set(range(max(0, i - self.longest + 1), i + 1))
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(starts[last])
        return live.pop()

    @staticmethod
    def _path(tokens: list[int], starts: list[int], at: int) -> list[int]:
        out = []
        while at:
            out.append(tokens[at])
            at = starts[at]
        return out[::-1]

    def words(self, text: str) -> Iterator[list[str]]:
        """Words of a text, piece by piece; a special token is a list of its own, as a word that starts with a NUL."""
        for piece in cut_pieces(text):
            parts = self.cut_special.split(piece) if self.cut_special and "<|" in piece else [piece]
            for i, part in enumerate(parts):
                if i % 2:
                    yield ["\0" + part]
                elif part:
                    yield self.find_words(normalized(part))

    def word_ids(self, word: str) -> list[int]:
        if word[0] == "\0" and word[1:] in self.special:
            return [self.special[word[1:]]]
        return self.encode_word(word.encode().decode("latin-1").translate(self.to_symbols))

    def encode(self, text: str | None) -> list[int]:
        return [i for words in self.words(text or "") for w in words for i in self.word_ids(w)]


def normalized(text: str) -> str:
    """Composed, lower case character by character (a final sigma has no form of its own)."""
    text = unicodedata.normalize("NFC", text)
    if not text.isascii() and _RARE.search(text):
        text = text.translate(_SMALL)
    return text.lower()


def cut_pieces(text: str, limit: int = PIECE) -> Iterator[str]:
    """Pieces of about `limit` characters, cut before white space, so that no word and no composition is cut."""
    start = 0
    space = re.compile(f"[{_SPACE}]")
    while len(text) - start > limit:
        found = space.search(text, start + limit)
        if not found:
            break
        yield text[start:found.start()]
        start = found.start()
    yield text[start:]


class TextDecoder:
    """Token strings with one space between, token after token; its state is whether a token has come."""

    def __init__(self, tokenizer: Tokenizer):
        self.strings, self.begun = tokenizer.strings, False

    def feed(self, token: int) -> str:
        out = f" {self.strings[token]}" if self.begun else self.strings[token]
        self.begun = True
        return out


class BytesDecoder:
    """The text that the tokens spell, with a space at word ends; its state is the bytes of an unfinished character."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.to_byte = {c: b for b, c in enumerate(tokenizer.alphabet)}
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, token: int) -> str:
        string = self.tokenizer.strings[token]
        if string in self.tokenizer.special:
            return self.state.decode(b"", True) + string + " "
        out = self.state.decode(bytes(self.to_byte[c] for c in string.removesuffix(_END)))
        return out + (self.state.decode(b"", True) + " " if string.endswith(_END) else "")

    def finish(self) -> str:
        return self.state.decode(b"", True)


class _Memory(dict):
    """A function of a word, remembered for the words seen lately; two generations bound its size."""

    def __init__(self, made, size: int = REMEMBERED):
        super().__init__()
        self.made, self.size, self.old = made, size, {}

    def __missing__(self, word: str):
        value = self.old.get(word)
        if value is None:
            value = self.made(word)
        self[word] = value
        return value

    def trim(self) -> None:
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()


class Digester:
    """Counts and digests of a text's tokens and of the text decoded from them, in constant memory."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.ids = _Memory(lambda w: " ".join(map(str, tokenizer.word_ids(w))).encode())
        self.texts = _Memory(self._decoded)

    def _decoded(self, word: str) -> bytes:
        machine = TextDecoder(self.tokenizer)
        return "".join(machine.feed(int(i)) for i in self.ids[word].split()).encode()

    def digest(self, text: str | None) -> tuple[int, str, str]:
        count, ids, back = 0, hashlib.sha256(), hashlib.sha256()
        for words in self.tokenizer.words(text or ""):
            if not words:
                continue
            got = b" ".join(map(self.ids.__getitem__, words))
            ids.update(b" " + got if count else got)
            got_text = b" ".join(map(self.texts.__getitem__, words))
            back.update(b" " + got_text if count else got_text)
            count += got.count(b" ") + 1
            self.ids.trim()
            self.texts.trim()
        return count, ids.hexdigest(), back.hexdigest()


_loaded: dict[str, Digester] = {}


def digester(path: str) -> Digester:
    """One per Python worker."""
    if path not in _loaded:
        _loaded[path] = Digester(Tokenizer(path))
    return _loaded[path]


def token_digests(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = digester(path)
        for b in pieces(batches, "text"):
            made = list(zip(*(own.digest(t.as_py()) for t in b.column("text"))))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(made[0], pa.int64()), pa.array(made[1]), pa.array(made[2])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and ids, the tokens of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = digester(path)
        for b in pieces(batches, "text"):
            ids = [[int(i) for words in own.tokenizer.words(t.as_py() or "") for w in words for i in own.ids[w].split()]
                   for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")
