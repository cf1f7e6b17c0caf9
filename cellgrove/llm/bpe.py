"""BPE encoding and decoding: a priority queue of merge ranks over a linked symbol list.

The vocabulary file of the ``tokenizers`` library gives the merges, the
vocabulary and the special tokens; the encoder here is our own.  A word's
symbols form a doubly linked list; every adjacent pair that has a rank enters a
heap; popped entries that no longer match the list are stale and skipped.
Decoding (``decode``) looks the ids up and joins their vocabulary strings.
Runs without blanks and the pieces of runs are remembered per worker in two
generations: what was not asked for while one filled up is forgotten, so junk
leaves and memory is bounded.

A file that declares a normaliser, split, model option or decoder other than
those written here is refused.

Defined cases: a null or empty text, or a null list of ids, has no tokens and
decodes to the empty text; repeated rows each give a row; a null id stays null;
other columns are ignored; an empty table gives an empty result; a text of any
length is encoded whole; an id outside the vocabulary raises.
"""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from cellgrove.llm.common import give_back, plain, slices

#: Entries of one generation of a worker's memory (two are held); longer runs are not remembered.
GENERATION, LONGEST = 150_000, 64


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class Memory(dict):
    """``make(key)`` of the keys asked for, in two generations; a key of the older one that is asked for moves up."""

    def __init__(self, make, most: int):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


def checked(spec: dict) -> dict:
    """``spec`` if its parts are those that the encoder knows; else an error that names the part."""
    model, parts = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    added = spec["added_tokens"]
    known = {
        "normalizer": [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " ",
        "pre_tokenizer": [p["type"] for p in parts] == ["Split", "ByteLevel"] and parts[0]["behavior"] == "Removed" and parts[0]["invert"]
        and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"],
        "model": model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")),
        "decoder": spec.get("decoder") is None,
        "added_tokens": not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")),
    }
    for part, fine in known.items():
        if not fine:
            raise ValueError(f"the vocabulary file's {part} is not one that this encoder knows")
    return spec


class Encoder:
    """Encoder of a word-level BPE file: special tokens, NFC, lower case, split, merges."""

    #: White space as the vocabulary's split pattern sees it (fixed value).
    SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

    def __init__(self, path: str):
        import json
        import re

        import regex

        with open(path, encoding="utf-8") as f:
            spec = checked(json.load(f))
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = {i: s for s, i in (self.vocab | self.special).items()}
        self.strings = [strings.get(i) for i in range(max(strings, default=-1) + 1)]
        self.symbols = byte_symbols()
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern.replace(r"\s", self.SPACE)).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.odd = re.compile("[\x1c-\x1f]").search
        self.pieces = Memory(self.piece, GENERATION)
        self.words = Memory(self.word, GENERATION)

    def merge(self, symbols: list[str]) -> list[str]:
        """Symbols after all merges, lowest rank first, leftmost first among equals."""
        from heapq import heapify, heappop, heappush

        rank, n = self.ranks.get, len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := rank((a, b))) is not None]
        heapify(heap)
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # stale
            symbols[i] = ab = a + b
            symbols[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank((ab, symbols[k]))) is not None:
                    heappush(heap, (r, i, ab, symbols[k]))
            h = before[i]
            if h >= 0 and (r := rank((symbols[h], ab))) is not None:
                heappush(heap, (r, h, symbols[h], ab))
        return [s for s in symbols if s]

    def piece(self, piece: str) -> bytes:
        """Ids of a piece of the split pattern, as little-endian 32-bit numbers."""
        symbols = list(piece) if piece.isascii() and piece.isprintable() else [self.symbols[b] for b in piece.encode()]
        symbols[-1] += self.suffix
        vocab = self.vocab
        return b"".join([vocab[s].to_bytes(4, "little") for s in self.merge(symbols) if s in vocab])

    def word(self, word: str) -> bytes:
        """Ids of a run without blanks."""
        if word.isascii() and word.isalpha():
            return self.piece(word)
        pieces = self.pieces
        return b"".join([pieces[p] for p in self.split(word)])

    @staticmethod
    def normal(text: str) -> str:
        import unicodedata

        text = unicodedata.normalize("NFC", text)
        # character by character: no final form of sigma
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian 32-bit numbers."""
        out, words = [], self.words
        for k, part in enumerate(self.cut(text) if self.cut else [text]):
            if k % 2:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                part = self.normal(part)
                out += [words[w] for w in (self.split(part) if self.odd(part) else part.split())]
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings of ids, as the library joins them where a file declares no decoder."""
        strings = self.strings
        return " ".join([strings[i] for i in ids])


def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    import sys
    import types

    kept = sys.modules.setdefault("_bpe_of_worker", types.ModuleType("_bpe_of_worker")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def _map(df: DataFrame, path: str, id_col: str, text_col: str, fields: list[tuple[str, str, pa.DataType]], row) -> DataFrame:
    """(id, fields) of each row; ``row(encoder, ids as bytes)`` gives the fields."""
    names, kinds = [f[0] for f in fields], [f[2] for f in fields]

    def run(batches):
        give_back()
        own = None
        for b in batches:
            own = own or encoder(path)
            texts, ids = plain(b.column(1)), b.column(0)
            for at, m in slices(texts):
                columns = list(zip(*(row(own, own.encode(x)) for x in texts.slice(at, m).to_pylist())))
                yield pa.RecordBatch.from_arrays([ids.slice(at, m), *(pa.array(c, k) for c, k in zip(columns, kinds))], [id_col, *names])

    return df.select(id_col, text_col).mapInArrow(run, ", ".join([f"{id_col} {df.schema[id_col].dataType.simpleString()}", *(f"{n} {k}" for n, k, _ in fields)]))


def numbers(raw: bytes):
    import numpy as np

    return np.frombuffer(raw, "<i4")


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of each text."""
    return _map(df, path, id_col, text_col, [("ids", "array<int>", pa.list_(pa.int32()))], lambda own, raw: (numbers(raw),))


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text that each list of token ids stands for."""
    def run(batches):
        own = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], [id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, text string")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): token ids, and the text that is decoded from them."""
    def row(own, raw):
        ids = numbers(raw)
        return ids, own.decode(ids.tolist())

    return _map(df, path, id_col, text_col, [("ids", "array<int>", pa.list_(pa.int32())), ("decoded", "string", pa.string())], row)


def encode_digest(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of ``round_trip``, made where the tokens are."""
    def row(own, raw):
        ids = numbers(raw).tolist()
        return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()

    return _map(df, path, id_col, text_col, [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())], row)


def encode_all(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, decoded, ids_sha256, decoded_sha256): ``round_trip`` with the digests of both."""
    def row(own, raw):
        ids = numbers(raw)
        decoded = own.decode(ids.tolist())
        return len(ids), ids, decoded, hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    text = pa.string()
    return _map(df, path, id_col, text_col, [("n_tokens", "long", pa.int64()), ("ids", "array<int>", pa.list_(pa.int32())), ("decoded", "string", text), ("ids_sha256", "string", text), ("decoded_sha256", "string", text)], row)
