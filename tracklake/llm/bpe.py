"""BPE encoding by backtracking over Aho-Corasick longest matches; decoding by an offset table.

A word is a sequence of byte symbols whose last symbol carries the end-of-word mark. The longest token that starts at
each position comes from one Aho-Corasick pass. A token may follow another only if merging could not have joined across
their border; that pair test walks the two tokens' merge trees and is remembered in a pair-compatibility table.
A position from which no completion exists is marked dead, so each is left at most once and time is linear in the word.

Edge cases: a null or empty text gives no tokens, the hash of no bytes and an empty decoded text; rows are mapped one
by one, so repeated rows stay repeated; other columns of the input are not read. Very long words are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import claim, mapped

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Entries of a worker's word cache and of its pair table. Beyond them, words are encoded anew: slower, not different.
CACHE_WORDS = 400_000
CACHE_PAIRS = 1_000_000


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


class WordBpe:
    """Tables of one vocabulary file of the tokenizers library: BPE with an optional end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()

        def inner(token: str) -> str:
            ends = bool(self.suffix) and token.endswith(self.suffix)
            raw = [symbols[c] for c in (token[: -len(self.suffix)] if ends else token)]
            return "".join(map(chr, raw[:-1])) + chr(raw[-1] + (0x100 if ends else 0))

        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = {a + b: (a, b) for a, b in reversed(merges)}
        base = [t for t in vocab if t not in made]
        # Own numbers in order of merging: single symbols first, then each merge's result.
        order = {t: i for i, t in enumerate(base)}
        for a, b in merges:
            order.setdefault(a + b, len(order))
        self.ids = [0] * len(order)
        self.length = [0] * len(order)
        self.split = [(i, i) for i in range(len(order))]
        self.joined: dict[tuple[int, int], int] = {}
        texts = {}
        self.automaton = ahocorasick.Automaton()
        for t, n in order.items():
            self.ids[n] = vocab[t]
            texts[key := inner(t)] = n
            self.length[n] = len(key)
            self.automaton.add_word(key, (n, len(key)))
            if t in made:
                self.split[n] = (order[made[t][0]], order[made[t][1]])
        self.automaton.make_automaton()
        for a, b in merges:
            self.joined.setdefault((order[a], order[b]), order[a + b])
        self.shorter: list[int] = [-1] * len(order)
        for key, n in texts.items():
            self.shorter[n] = next((m for end in range(len(key) - 1, 0, -1) if (m := texts.get(key[:end])) is not None), -1)
        self.compatible: dict[tuple[int, int], bool] = {}
        # Offset table for decoding: token i is blob[offset[i]:offset[i + 1]].
        strings = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.offset, blob = [0], bytearray()
        for i in range(max(strings) + 1):
            blob += strings.get(i, "").encode()
            self.offset.append(len(blob))
        self.blob = bytes(blob)
        self.token_bytes = [self.blob[a:b] for a, b in zip(self.offset, self.offset[1:])]
        self.cache: dict[str, bytes] = {}
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' bytes together would still give exactly these two tokens."""
        known = self.compatible.get((left, right))
        if known is not None:
            return known
        first, second, limit, answer = left, right, 1 << 62, None
        while answer is None:
            joined = self.joined.get((first, second))
            if joined is not None and joined < limit:
                answer = False
                break
            if first > second:
                limit, first = first, self.split[first][1]
                if first == limit:
                    limit, second = second + 1, self.split[second][0]
                    if second + 1 == limit:
                        answer = True
            else:
                limit, second = second + 1, self.split[second][0]
                if second + 1 == limit:
                    limit, first = first, self.split[first][1]
                    if first == limit:
                        answer = True
        if len(self.compatible) < CACHE_PAIRS:
            self.compatible[left, right] = answer
        return answer

    def encode_symbols(self, s: str) -> list[int]:
        n, length, shorter = len(s), self.length, self.shorter
        longest = [-1] * (n + 1)
        for end, (token, size) in self.automaton.iter(s):
            longest[end - size + 1] = token
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while True:
                if token < 0:
                    if not out:
                        raise ValueError("a symbol of the text is not in the vocabulary")
                    alive[at] = 0
                    out.pop()
                    at -= length[last]
                    token = last
                    break
                end = at + length[token]
                if alive[end] and (last < 0 or self.may_follow(last, token)):
                    out.append(token)
                    at, token = end, longest[end]
                    break
                token = shorter[token]
        return out

    def encode_word(self, word: str) -> bytes:
        """Vocabulary ids of a word, as little-endian unsigned 32-bit integers."""
        known = self.cache.get(word)
        if known is None:
            s = word.encode("utf-8").decode("latin-1")
            if self.suffix:
                s = s[:-1] + chr(ord(s[-1]) + 0x100)
            ids = self.ids
            known = array("I", [ids[t] for t in self.encode_symbols(s)]).tobytes()
            if len(self.cache) < CACHE_WORDS and len(word) < 64:
                self.cache[word] = known
        return known

    def plain(self, text: str) -> str:
        """Composed form in lower case, character by character."""
        text = unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text else "".join(map(str.lower, text))

    def encode(self, text: str) -> bytes:
        parts = self.special_split.split(text) if "<|" in text and self.special_split else (text,)
        out = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                out.extend(map(self.encode_word, self.words.findall(self.plain(part))))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the tokens' strings, joined by spaces as that library does without a decoder."""
        return b" ".join(map(self.token_bytes.__getitem__, memoryview(ids).cast("I")))


_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    claim("bpe", _LOADED.clear)
    return _LOADED[path]


def round_trips(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: number of tokens, hash of the ids and hash of the decoded text. A map without shuffle."""

    def run(batches):
        bpe = load(vocabulary)
        for batch in batches:
            sizes, hashes, decoded = [], [], []
            for t in batch.column(1).to_pylist():
                ids = bpe.encode(t or "")
                sizes.append(len(ids) // 4)
                hashes.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return mapped(docs.select(docs[key].alias("doc_id"), docs[text].alias("text")), run, SCHEMA, "bpe")


def encoded(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: its token ids and the text that decoding them gives."""

    def run(batches):
        bpe = load(vocabulary)
        for batch in batches:
            rows = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([memoryview(r).cast("I").tolist() for r in rows], pa.list_(pa.int32())), pa.array([bpe.decode(r).decode("utf-8") for r in rows], pa.string())], ["doc_id", "ids", "decoded"])

    return mapped(docs.select(docs[key].alias("doc_id"), docs[text].alias("text")), run, "doc_id long, ids array<int>, decoded string", "bpe")
