"""Byte-pair encoding and decoding as streams with constant memory.

**Lookahead.**  A boundary between two bytes vanishes when a rule merges the token
that ends there with the one that starts there.  Which token starts there at the time
of a rule depends on bytes to the right only as far as earlier rules reach: a token is
there if its own parts were merged and no earlier rule joined it with what follows.
``sufficient_lookahead`` follows these reaches through the merge list in order of rank
and returns the number of bytes after a boundary that settle it whatever comes later
(130 for ``byte_bpe_50k``).  A run of bytes that ends at no known place is therefore
encoded in windows: tokens that end at least a lookahead before the window's end are
emitted, the rest is kept.  The tokens of a text that starts at a settled boundary are
those of the whole text from there on.

**Words.**  Rules apply within words of the vocabulary's pattern.  A space after
another character always starts a word, so everything before the last such place is
stable; where a word grows beyond ``LONG`` characters its bytes go through the windows.
Strings of added tokens are split off first.

**Decoding.**  Ids become bytes, and the state is the unfinished UTF-8 sequence at
their end (at most 3 bytes); invalid sequences become U+FFFD as soon as they are known.

A stream holds at most a chunk, ``LONG`` characters, a window, and a table of recent
short words in two halves of at most ``WORDS`` entries, however long its text is.

Edge cases of ``round_trip``: null text is an empty text (no ids, empty decoded text);
a text that is not valid UTF-8 is read with U+FFFD for the invalid bytes; repeated rows
give repeated rows; a null ``doc_id`` is kept; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import struct
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import small_batches

VOCABULARY = "byte_bpe_50k.json"
CHUNK, LONG, WINDOW, WORDS, SHORT = 1 << 16, 1024, 4096, 1 << 18, 32
CODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Letters and numbers assigned after Unicode 16, which the tokenizers' patterns do not know as such.
LATER = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f"
    r"\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9"
    r"\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6"
    r"\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128"
    r"\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    r"\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e"
    r"\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)


def sufficient_lookahead(merges: Iterable[tuple[bytes, bytes]]) -> int:
    """Bytes behind a boundary that settle it, from the merge rules in order of rank."""
    formed: dict[bytes, int] = {}
    joined: dict[bytes, int] = {}

    def reach(token: bytes) -> int:
        """Bytes from a token's start that tell whether it stands there at the time of the current rule."""
        return max(formed.get(token, 1), joined.get(token, 0))

    for left, right in merges:
        here = max(reach(left), len(left) + reach(right))
        joined[left] = max(joined.get(left, 0), here)
        formed[left + right] = max(formed.get(left + right, 0), here)
    return max([1, *formed.values(), *joined.values()])


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in byte-level vocabularies: visible Latin-1 ones for themselves, U+0100 onwards for the others."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """Merge rules, byte strings of ids and patterns of one byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        letters, model = byte_letters(), given["model"]
        plain = lambda token: bytes(letters[c] for c in token)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = model["vocab"]
        self.ranks = {(ids[a], ids[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made = [ids[a + b] for a, b in pairs]
        self.lookahead = sufficient_lookahead((plain(a), plain(b)) for a, b in pairs)
        self.added = {t["content"]: t["id"] for t in given["added_tokens"]}
        self.bytes = {i: plain(t) for t, i in ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.byte_ids = [0] * 256
        for letter, b in letters.items():
            self.byte_ids[b] = ids[letter]
        self.specials = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        self.words = _Words(self)

    def merge(self, data: bytes) -> list[int]:
        """Ids of a complete word: the rule of lowest rank first, leftmost first."""
        ids = [self.byte_ids[b] for b in data]
        return self._merge_few(ids) if len(ids) <= SHORT else self._merge_many(ids)

    def _merge_few(self, ids: list[int]) -> list[int]:
        rank, none = self.ranks.get, len(self.made)
        found = [rank(pair, none) for pair in zip(ids, ids[1:])]
        while found and (lowest := min(found)) < none:
            k = found.index(lowest)
            ids[k : k + 2] = (self.made[lowest],)
            del found[k]
            if k:
                found[k - 1] = rank((ids[k - 1], ids[k]), none)
            if k < len(found):
                found[k] = rank((ids[k], ids[k + 1]), none)
        return ids

    def _merge_many(self, ids: list[int]) -> list[int]:
        ranks, made, n = self.ranks, self.made, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, k, ids[k], ids[k + 1]) for k in range(n - 1) if (rank := ranks.get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k, left, right = heapq.heappop(heap)
            j = after[k]
            if ids[k] != left or j >= n or ids[j] != right:
                continue
            ids[k], ids[j], after[k] = made[rank], -1, after[j]
            if after[j] < n:
                before[after[j]] = k
            for a in (before[k], k):
                b = after[a] if a >= 0 else n
                if b < n and (rank := ranks.get((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (rank, a, ids[a], ids[b]))
        return [x for x in ids if x >= 0]


class _Words(dict):
    """Packed ids of recent short words: those asked for since this half filled up, and the half before."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.before = vocabulary, {}

    def __missing__(self, word: str) -> bytes:
        packed = self.before.get(word) or _packed(self.vocabulary.merge(word.encode()))
        if len(word) <= SHORT:
            if len(self) >= WORDS:
                self.before = dict(self)
                self.clear()
            self[word] = packed
        return packed


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _pattern(letter: str, number: str, other: str) -> regex.Pattern:
    return regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|\s+(?!\S)|\s+")


_later = regex.compile(f"[{LATER}]")
_plain = {"letter": r"\p{L}", "number": r"\p{N}", "other": r"[^\s\p{L}\p{N}]"}
_exact = {"letter": rf"[\p{{L}}--[{LATER}]]", "number": rf"[\p{{N}}--[{LATER}]]", "other": rf"[[^\s\p{{L}}\p{{N}}]{LATER}]"}
_fast, _slow = _pattern(**_plain), _pattern(**_exact)
_going_on = [(kind, regex.compile(f"(?V1){x}*")) for kind, x in (*_exact.items(), ("space", r"\s"))]
_space = regex.compile(r"\s")


def _last_start(text: str) -> int:
    """Place of the last space that follows another character, or 0."""
    at = len(text)
    while (at := text.rfind(" ", 1, at)) > 0 and _space.match(text[at - 1]):
        pass
    return max(at, 0)


def _split(text: str) -> list[str]:
    try:
        text.encode("latin-1")  # far faster than a search
    except UnicodeEncodeError:
        return (_slow if _later.search(text) else _fast).findall(text)
    return _fast.findall(text)


class _Run:
    """The bytes of a word whose end is not in sight."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.held = vocabulary, b""

    def feed(self, data: bytes) -> Iterator[bytes]:
        for a in range(0, len(data), WINDOW):
            self.held += data[a : a + WINDOW]
            if len(self.held) >= WINDOW + self.vocabulary.lookahead:
                yield self._settled(len(self.held) - self.vocabulary.lookahead)

    def _settled(self, until: int) -> bytes:
        out, at = [], 0
        for i in self.vocabulary.merge(self.held):
            at += len(self.vocabulary.bytes[i])
            if at > until:
                at -= len(self.vocabulary.bytes[i])
                break
            out.append(i)
        self.held = self.held[at:]
        return _packed(out)

    def close(self) -> bytes:
        return self._settled(len(self.held))


class Encoding:
    """One text as a stream: ``feed`` and ``close`` yield packed little-endian 32-bit ids as soon as they are stable."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.tail, self.rest = vocabulary, "", ""
        self.run: _Run | None = None
        self.kind, self.more = "", None

    def feed(self, chars: str) -> Iterator[bytes]:
        text = self.tail + chars
        at = 0
        for found in self.vocabulary.specials.finditer(text):
            yield from self._words(text[at : found.start()], True)
            yield _packed([self.vocabulary.added[found.group()]])
            at = found.end()
        text = text[at:]
        keep = max((k for t in self.vocabulary.added for k in range(1, min(len(t), len(text) + 1)) if text.endswith(t[:k])), default=0)
        self.tail = text[len(text) - keep :]
        yield from self._words(text[: len(text) - keep], False)

    def close(self) -> Iterator[bytes]:
        text, self.tail = self.tail, ""
        yield from self._words(text, True)

    def _words(self, chars: str, last: bool) -> Iterator[bytes]:
        """Ids of the words that ``chars`` completes; with ``last`` the text ends there."""
        text, self.rest = self.rest + chars, ""
        if self.run:
            end = self.more.match(text).end()
            done = last or end < len(text)
            if self.kind == "space" and end and not (last and end == len(text)):
                end -= 1  # the last space may belong to the next word
            yield from self.run.feed(text[:end].encode())
            text = text[end:]
            if not done:
                self.rest = text
                return
            yield self.run.close()
            self.run = None
        cut = len(text) if last else _last_start(text)
        yield b"".join(map(self.vocabulary.words.__getitem__, _split(text[:cut])))
        text = text[cut:]
        if len(text) > LONG:
            *whole, text = _split(text)
            yield b"".join(map(self.vocabulary.words.__getitem__, whole))
            if len(text) > LONG:
                self.run = _Run(self.vocabulary)
                self.kind, self.more = next((k, p) for k, p in _going_on if p.match(text[-1]).end())
                held = 1 if self.kind == "space" else 0
                yield from self.run.feed(text[: len(text) - held].encode())
                text = text[len(text) - held :]
        self.rest = text


class Decoding:
    """Ids of one text as a stream of text; the state is an unfinished UTF-8 sequence."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.held = vocabulary, b""

    def feed(self, packed: bytes) -> str:
        table = self.vocabulary.bytes
        data = self.held + b"".join(map(table.__getitem__, np.frombuffer(packed, "<u4").tolist()))
        cut = len(data)
        for k in range(1, min(3, len(data)) + 1):
            lead = data[-k]
            if lead >= 0xC0:
                needs = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                cut -= k if needs > k else 0
                break
            if lead < 0x80:
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        data, self.held = self.held, b""
        return data.decode("utf-8", "replace")


def encode(text: str, vocabulary: Vocabulary, chunk: int = CHUNK) -> Iterator[bytes]:
    """Packed ids of a text, fed ``chunk`` characters at a time."""
    stream = Encoding(vocabulary)
    for a in range(0, len(text), chunk):
        yield from stream.feed(text[a : a + chunk])
    yield from stream.close()


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Columns of ``CODED``: number and digest of every text's ids, digest of the text decoded from them.

    ``path`` is a byte-level tokenizer file that every executor can read (default: ``VOCABULARY``).
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path or public_tokenizers.path(VOCABULARY))
        for batch in batches:
            rows = []
            for raw in batch.column(1):
                text = (raw.as_py() or b"").decode("utf-8", "replace")
                n, ids, decoded, back = 0, sha256(), sha256(), Decoding(vocabulary)
                for packed in encode(text, vocabulary):
                    n += len(packed) // 4
                    ids.update(packed)
                    decoded.update(back.feed(packed).encode())
                decoded.update(back.close().encode())
                rows.append((n, ids.hexdigest(), decoded.hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, CODED)
