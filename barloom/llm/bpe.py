"""Byte-pair encoding of research reports: speculate by longest match, verify, repair."""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from barloom.llm.common import any_key, byte_view, release_memory, slices

#: Entries in the younger half of a task's memory of pieces, and of words.
MEMORY = 100_000

#: Bytes of text taken at once for each entry; all pieces of a step enter the memory together.
STEP = 10

#: Symbols up to which merging scans instead of keeping a heap.
SHORT = 24

#: Marks that end many pieces; they are words of their own after letters.
_TAILS = frozenset(".,;:!?|")

_NO_MERGE = 1 << 80
_ID = (1 << 32) - 1
_NEVER = np.int64(1 << 40)
_BASE = np.int64(-1)


def _byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + k)
    return out


class Vocabulary:
    """Merge rules as arrays: ids, ranks, and the two parts of every token."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        model = spec["model"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.id_of: dict[str, int] = dict(model["vocab"])
        size = max([*self.id_of.values(), *self.special.values()]) + 1
        self.token_of = [""] * size
        for token, i in [*self.id_of.items(), *self.special.items()]:
            self.token_of[i] = token
        #: Two ids in one number; rank and new id in another: tuples would take three times the memory.
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.id_of[left] << 32 | self.id_of[right]] = rank << 32 | self.id_of[left + right]
        splits = next(
            p["pattern"]["Regex"]
            for p in spec["pre_tokenizer"]["pretokenizers"]
            if p["type"] == "Split"
        )
        self.pattern = splits.replace(r"\s", r"\p{White_Space}")
        self._prepare(size)

    def _prepare(self, size: int) -> None:
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.birth = np.full(size, _BASE, np.int64)
        reachable: dict[str, int] = {}
        for token, i in self.id_of.items():
            final: list[tuple[int, int, int]] = []
            if self.exact(self.symbols(token), final) == [i]:
                reachable[token] = i
                if final:
                    self.left[i], self.right[i], self.birth[i] = final[-1]
        self.reachable = reachable
        #: Length of the longest token that begins with two symbols.
        self.reach: dict[str, int] = {}
        for token in reachable:
            self.reach[token[:2]] = max(self.reach.get(token[:2], 0), len(token))
        keys = np.array([*self.merges], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.array([m >> 32 for m in self.merges.values()], np.int64)[order]
        #: The check below needs merges that only use tokens made earlier.
        self.ordered = all(
            max(self.birth[k >> 32], self.birth[k & _ID]) < m >> 32 for k, m in self.merges.items()
        )

    def symbols(self, token: str) -> list[int]:
        """Base ids of a byte-level string, the word end joined to the last one."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            parts = [*body[:-1], body[-1] + self.suffix]
        else:
            parts = list(token)
        return [self.id_of[p] for p in parts if p in self.id_of]

    def exact(self, ids: list[int], made: list | None = None) -> list[int]:
        """Apply the lowest-ranked merge, leftmost first, until none is left."""
        n = len(ids)
        if n <= SHORT and made is None:
            return self._exact_short(ids)
        ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (m := self.merges.get(ids[i] << 32 | ids[i + 1])) is not None:
                heap.append((m >> 32, i, ids[i], ids[i + 1], m & _ID))
        heapq.heapify(heap)
        while heap:
            rank, i, a, b, new = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            if made is not None:
                made.append((a, b, rank))
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (m := self.merges.get(new << 32 | ids[after[i]])) is not None:
                    heapq.heappush(heap, (m >> 32, i, new, ids[after[i]], m & _ID))
            if (h := before[i]) >= 0 and (m := self.merges.get(ids[h] << 32 | new)) is not None:
                heapq.heappush(heap, (m >> 32, h, ids[h], new, m & _ID))
        return [x for x in ids if x >= 0]

    def _exact_short(self, ids: list[int]) -> list[int]:
        """The same for few symbols: a scan of the ranks costs less than a heap."""
        get = self.merges.get
        due = [get(a << 32 | b, _NO_MERGE) for a, b in zip(ids, ids[1:])]
        while due:
            best = min(due)
            if best == _NO_MERGE:
                break
            i = due.index(best)
            ids[i : i + 2] = [best & _ID]
            del due[i]
            if i < len(due):
                due[i] = get(ids[i] << 32 | ids[i + 1], _NO_MERGE)
            if i:
                due[i - 1] = get(ids[i - 1] << 32 | ids[i], _NO_MERGE)
        return ids

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(a), _NEVER)
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging ``a + b`` from its base symbols ends with just these two tokens.

        Merging runs in rank order, so each part of a token lives from its own
        rank to that of the merge that takes it up.  Going back in time along
        the right edge of ``a`` and the left edge of ``b``, every two parts
        that live together must not have a merge due before either is taken up.
        """
        good = np.ones(len(a), bool)
        at = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        x_end, y_end = np.full(len(a), _NEVER - 1), np.full(len(a), _NEVER - 1)
        while len(at):
            rank = self.rank_of(x, y)
            bad = (rank < x_end) & (rank <= y_end)
            good[at[bad]] = False
            xb, yb = self.birth[x], self.birth[y]
            go = ~bad & ((xb != _BASE) | (yb != _BASE))
            at, x, y, x_end, y_end, xb, yb = (v[go] for v in (at, x, y, x_end, y_end, xb, yb))
            down = xb > yb
            x_end, y_end = np.where(down, xb, x_end), np.where(down, y_end, yb)
            x, y = np.where(down, self.right[x], x), np.where(down, y, self.left[y])
        return good

    def propose(self, word: str) -> list[int] | None:
        """Greedy longest match over reachable tokens; None where there is none."""
        text = word + self.suffix
        size, end, i, out = len(text), len(word), 0, []
        get, reach = self.reachable.get, self.reach.get
        while i < end:
            furthest = i + reach(text[i : i + 2], 1)
            # the last symbol carries the suffix: a match ends before it or takes everything
            if furthest >= size and (found := get(text[i:])) is not None:
                out.append(found)
                return out
            for j in range(min(end - 1, furthest), i, -1):
                if (found := get(text[i:j])) is not None:
                    break
            else:
                return None
            out.append(found)
            i = j
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of byte-level words: propose, check all pairs at once, repair the rest."""
        guesses = [self.propose(w) if self.ordered else None for w in words]
        left, right, owner = [], [], []
        for k, g in enumerate(guesses):
            if g is not None and len(g) > 1:
                left += g[:-1]
                right += g[1:]
                owner += [k] * (len(g) - 1)
        if left:
            pairs, back = np.unique(
                np.array(left, np.int64) << 32 | np.array(right, np.int64), return_inverse=True
            )
            good = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]
            for k in set(np.array(owner)[~good].tolist()):
                guesses[k] = None
        return [g if g is not None else self.exact(self.symbols(w + self.suffix)) for w, g in zip(words, guesses)]


class Memory(dict):
    """Two generations: what is asked for again survives when the younger one is full."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def missing(self, keys: set) -> set:
        """Of these keys the unknown ones; known old ones become young."""
        absent = keys - self.keys()
        if len(self) + len(absent) > self.size:
            self.old = dict(self)
            self.clear()
            absent = keys
        again = absent & self.old.keys()
        old = self.old
        self.update((k, old[k]) for k in again)
        return absent - again


class Encoder:
    """Encodes texts in a task; remembers the ids of blank-separated pieces."""

    def __init__(self, vocabulary: Vocabulary, memory: int = MEMORY):
        self.vocabulary = vocabulary
        self.step = memory * STEP
        self.find = regex.compile(vocabulary.pattern).findall
        self.cut = regex.compile(
            "(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")"
        ) if vocabulary.special else None
        self.to_symbols = str.maketrans({chr(b): s for b, s in _byte_symbols().items()})
        self.pieces: dict[bytes, bytes] = Memory(memory)
        self.words: dict[str | int, bytes] = Memory(memory * 8 // 5)

    @staticmethod
    def _folded(text: str) -> str:
        """Composed and lower-cased character by character: no rule for the end of a word."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def _parts(self, text: str) -> list:
        """Words of a piece; a special token is its id."""
        tail = text[-1:]
        body = text[:-1] if tail in _TAILS else text
        if body.isalpha() and (word := self._folded(body)).isalpha():
            return [word, tail] if body is not text else [word]
        special, parts = self.vocabulary.special, []
        for seg in self.cut.split(text) if self.cut and "<" in text else (text,):
            if seg in special:
                parts.append(special[seg])
            else:
                parts += self.find(self._folded(seg))
        return parts

    def learn(self, pieces: set[bytes]) -> None:
        """Fill the memory for pieces not seen before."""
        words = self.words
        parsed = [(raw, self._parts(raw.decode("utf-8", "replace"))) for raw in pieces]
        new = list(words.missing({p for _, parts in parsed for p in parts}))
        ids = [p for p in new if isinstance(p, int)]
        words.update((p, np.array([p], "<u4").tobytes()) for p in ids)
        new = [p for p in new if isinstance(p, str)]
        symbols = [
            w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.to_symbols) for w in new
        ]
        words.update(zip(new, (array("I", x).tobytes() for x in self.vocabulary.encode_words(symbols))))
        known = self.pieces
        for raw, parts in parsed:
            known[raw] = words[parts[0]] if len(parts) == 1 else b"".join([words[p] for p in parts])

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]  # bytes split at blanks only
        known = self.pieces
        if fresh := known.missing(set().union(*split)):
            self.learn(fresh)
        return [b"".join([known[p] for p in words]) for words in split]


def _encoded(batch: pa.RecordBatch, encoder: Encoder) -> Iterator[pa.RecordBatch]:
    data, offsets = byte_view(batch.column("report"))
    ids = batch.column("report_id")
    for lo, hi in slices(offsets, encoder.step):
        texts = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(lo, hi)]
        yield pa.RecordBatch.from_arrays(
            [ids.slice(lo, hi - lo), pa.array(encoder.encode_many(texts), pa.binary())],
            ["report_id", "token_ids"],
        )


def _decoded(batch: pa.RecordBatch, tokens: pa.Array) -> Iterator[pa.RecordBatch]:
    binary = batch.column("token_ids").fill_null(b"").cast(pa.large_binary())
    ends = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
    flat = np.frombuffer(binary.buffers()[2] or b"", "<u4")
    for lo, hi in slices(ends, 1 << 21):
        ids = flat[ends[lo] // 4 : ends[hi] // 4]
        inside = ids < len(tokens)
        counts = np.concatenate([[0], np.cumsum(inside)])[(ends[lo : hi + 1] - ends[lo]) // 4]
        lists = pa.LargeListArray.from_arrays(pa.array(counts, pa.int64()), tokens.take(pa.array(ids[inside])))
        text = pc.binary_join(lists.cast(pa.list_(pa.string())), " ")
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("report_id").slice(lo, hi - lo),
                batch.column("token_ids").slice(lo, hi - lo),
                text,
            ],
            ["report_id", "token_ids", "decoded"],
        )


def token_texts(tokenizer_json: str) -> list[str | None]:
    """The text of every id; None for an id that is not used."""
    spec = json.loads(tokenizer_json)
    names = {i: t for t, i in spec["model"]["vocab"].items()} | {
        t["id"]: t["content"] for t in spec["added_tokens"]
    }
    return [names.get(i) for i in range(max(names) + 1)]


_DECODED = "report_id bigint, token_ids binary, decoded string"


@any_key("report_id")
def encode_reports(reports: DataFrame, tokenizer_json: str) -> DataFrame:
    """Token ids of reports ``(report_id, report)`` under a word-level BPE vocabulary.

    Returns ``report_id, token_ids``: little-endian unsigned 32-bit ids.  A null
    or empty text has no tokens; special tokens written in a text are
    recognised; rows are independent, so repeated rows give equal results.
    ``tokenizer_json`` is the content of the vocabulary file, which bounds what
    is broadcast.
    """
    shared = reports.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer_json))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            yield from _encoded(batch, encoder)

    return reports.select("report_id", "report").mapInArrow(encode, "report_id bigint, token_ids binary")


def decode_tokens(encoded: DataFrame, tokenizer_json: str) -> DataFrame:
    """Text of ``(report_id, token_ids)``: the tokens, special ones too, joined by blanks.

    This is what a vocabulary without a decoder gives.  Returns ``report_id,
    token_ids, decoded``; no tokens (or null) give an empty text, ids outside
    the vocabulary are left out.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(token_texts(tokenizer_json))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(shared.value, pa.string())
        for batch in batches:
            yield from _decoded(batch, tokens)

    return encoded.select("report_id", "token_ids").mapInArrow(decode, _DECODED)


@any_key("report_id")
def round_trip(reports: DataFrame, tokenizer_json: str, memory: int = MEMORY) -> DataFrame:
    """``encode_reports`` and ``decode_tokens`` of the ids, in one Python pass.

    Two passes in a row keep two Python workers for each task.  ``memory`` trades
    time for the size of a worker, which matters among other stages.
    """
    shared = reports.sparkSession.sparkContext.broadcast(
        (Vocabulary(tokenizer_json), pa.array(token_texts(tokenizer_json), pa.string()))
    )

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, tokens = shared.value
        encoder = Encoder(vocabulary, memory)
        for batch in batches:
            for part in _encoded(batch, encoder):
                yield from _decoded(part, tokens)
        # the worker lives on beside those of the next task
        encoder = batch = part = None
        release_memory()

    return reports.select("report_id", "report").mapInArrow(both, _DECODED)
