"""Byte-level BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a piece of text there is exactly one token that ends its encoding. The matches of all
vocabulary entries that end at a position come from a suffix automaton of the vocabulary (Aho-Corasick:
its trie with suffix links); among them the last token of the prefix is the one whose predecessor, the last token of the
prefix before it, is *compatible* with it: their concatenation would not be merged differently. Following the
last tokens back from the end gives the ids, the same ones that applying the merges in order gives, in time
linear in the text however long it is.
"""

from __future__ import annotations

import gc
import hashlib
import json
import math
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm.common import text_or_empty

# The byte-level pre-tokenizer's pattern; \s there is the Unicode property White_Space.
PIECES = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
          r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes are
    themselves, the others take the characters from U+0100 on in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(spare)) for b in range(256)]


def _latin_pieces() -> str:
    """The same pattern for texts of characters below U+0100, with the properties spelt out as characters: the
    standard library's matcher, which lacks properties, is three times as fast."""
    letters, numbers, spaces = ("".join(re.escape(c) for c in map(chr, range(256)) if regex.fullmatch(p, c))
                                for p in (r"\p{L}", r"\p{N}", r"\p{White_Space}"))
    return (rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+"
            rf"|[{spaces}]+(?![^{spaces}])|[{spaces}]+")


class ByteBpe:
    """A byte-level BPE tokenizer read from the JSON text of a tokenizer file.

    ``keep`` bounds the memory of the piece and pair tables (entries; a full table is emptied, results don't
    depend on it).
    """

    def __init__(self, definition: str, keep: int = 250_000):
        spec = json.loads(definition)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or not pre or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only plain byte-level BPE files are supported")
        vocab: dict[str, int] = model["vocab"]
        self.keep = keep
        self._merge: dict[tuple[int, int], int] = {}
        self._made: dict[int, tuple[int, int, int]] = {}  # token -> rank of its merge, left part, right part
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b, whole = vocab[a], vocab[b], vocab[a + b]
            self._merge[a, b] = rank
            self._made.setdefault(whole, (rank, a, b))
        alphabet = byte_alphabet()
        self._to_chars = dict(enumerate(alphabet))
        back = {c: b for b, c in enumerate(alphabet)}
        self._bytes = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self._fits: dict[tuple[int, int], bool] = {}
        # entries longer than a character that no merge makes never occur in an encoding
        self._automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            if len(t) == 1 or i in self._made:
                self._automaton.add_word(t, (i, len(t)))
        self._automaton.make_automaton()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._bytes |= {i: t.encode() for t, i in self.added.items()}
        self._split = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self._find_any = regex.compile(PIECES).findall
        self._find_latin = re.compile(_latin_pieces()).findall
        self._beyond_latin = re.compile("[^\x00-\xff]").search
        self._pieces: dict[str, tuple[str, bytes]] = {}

    def forget(self) -> None:
        """Empty the piece and pair tables."""
        self._pieces, self._fits = {}, {}

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the encodings ``[.., a]`` and ``[b, ..]`` stay apart. Going back in time from the finished
        tokens, undo the later merge of the two that touch the boundary; a pair of parts that once met there
        would have been merged across it if its rank came before the merges that used up its parts."""
        x, y, x_until, y_until = a, b, math.inf, math.inf
        while True:
            rank = self._merge.get((x, y))
            if rank is not None and rank < x_until and rank <= y_until:  # of equal ranks the left one goes first
                return False
            x_made, y_made = self._made.get(x), self._made.get(y)
            if x_made and (not y_made or x_made[0] > y_made[0]):
                x_until, x = x_made[0], x_made[2]
            elif y_made:
                y_until, y = y_made[0], y_made[1]
            else:
                return True

    def piece_ids(self, piece: str) -> list[int]:
        """Token ids of one pre-token by the prefix table."""
        chars = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self._to_chars)
        n = len(chars)
        last = [-1] * (n + 1)  # per prefix length: its last token, and where that starts
        start_of = [-1] * (n + 1)
        fits, compatible = self._fits, self._compatible
        if len(fits) > self.keep:
            fits.clear()
        done = -1
        for end, (token, length) in self._automaton.iter(chars):
            if end == done:
                continue  # the prefix has its one last token
            start = end + 1 - length
            if start:
                before = last[start]
                if before < 0:
                    continue
                pair = before, token
                ok = fits.get(pair)
                if ok is None:
                    ok = fits[pair] = compatible(before, token)
                if not ok:
                    continue
            done = end
            last[end + 1], start_of[end + 1] = token, start
        ids = []
        at = n
        while at:
            if last[at] < 0:
                raise ValueError("the vocabulary lacks a byte of the text")
            ids.append(last[at])
            at = start_of[at]
        return ids[::-1]

    def _piece(self, piece: str) -> tuple[str, bytes]:
        got = self._pieces.get(piece)
        if got is None:
            ids = self.piece_ids(piece)
            got = ",".join(map(str, ids)), self.decode_bytes(ids)
            if len(piece) <= 64:
                if len(self._pieces) >= self.keep:
                    self._pieces.clear()
                self._pieces[piece] = got
        return got

    def _parts(self, text: str) -> list[tuple[str, bytes]]:
        """(ids as text, decoded bytes) of every piece of a text, added tokens included."""
        out, at = [], 0
        for m in self._split.finditer(text) if self._split else ():
            i = self.added[m[0]]
            out += [*self._plain(text[at:m.start()]), (str(i), self._bytes[i])]
            at = m.end()
        return out + self._plain(text[at:]) if at else self._plain(text)

    def _plain(self, text: str) -> list[tuple[str, bytes]]:
        pieces = (self._find_any if self._beyond_latin(text) else self._find_latin)(text)
        known = list(map(self._pieces.get, pieces))
        return [k or self._piece(p) for k, p in zip(known, pieces)]

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self._parts(text) for i in ids.split(",")]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def round_trip(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids joined by commas, and the text that they decode to."""
        parts = self._parts(text)
        if not parts:
            return 0, "", ""
        ids, raw = zip(*parts)
        joined = ",".join(ids)
        return joined.count(",") + 1, joined, b"".join(raw).decode("utf-8", "replace")


_LOADED: dict[str, ByteBpe] = {}


def _tokenizer(definition: str) -> ByteBpe:
    """One tokenizer per definition and worker process."""
    name = hashlib.sha256(definition.encode()).hexdigest()
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = ByteBpe(definition)
        gc.freeze()  # its tables hold no cycles: spare the collector from walking them again and again
    return _LOADED[name]


def read_definition(path: str) -> str:
    """A tokenizer file's text; it is a vocabulary of a few MB, which the driver sends to the executors."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _shared(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(read_definition(path))


def encode(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` plus ``out``, the array of token ids of the whole text (null: no ids)."""
    shared = _shared(docs.sparkSession, path)

    @F.pandas_udf("array<int>")
    def ids(t: pd.Series) -> pd.Series:
        tok = _tokenizer(shared.value)
        return pd.Series([tok.encode(x) for x in t])

    return docs.withColumn(out, ids(text_or_empty(F.col(text_col))))


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` plus ``out``, the text of the array of ids (null: null)."""
    shared = _shared(df.sparkSession, path)

    @F.pandas_udf("string")
    def text(a: pd.Series) -> pd.Series:
        tok = _tokenizer(shared.value)
        return pd.Series([None if x is None else tok.decode(list(x)) for x in a], dtype=object)

    return df.withColumn(out, text(F.col(ids_col)))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_tokens, ids_sha256, decoded_sha256)`` of every row: digests of the ids and of the text that
    they decode to. Null and empty texts have no ids; repeated rows give repeated rows; strings of the
    vocabulary's added tokens are those tokens. No shuffle: one pass, memory of one batch."""
    shared = _shared(docs.sparkSession, path)
    src = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = _tokenizer(shared.value)
        for b in batches:
            rows = []
            for t in b["t"]:
                n, ids, text = tok.round_trip(t)
                rows.append((n, hashlib.sha256(ids.encode()).hexdigest(),
                             hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()))
            out = pd.DataFrame(rows, columns=["n", "ids", "decoded"])
            out.insert(0, "id", b["id"])
            yield out
        tok.forget()  # the worker lives on for other stages

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInPandas(run, f"id {kind}, n long, ids string, decoded string").select(
        F.col("id").alias(id_col), F.col("n").alias("n_tokens"), F.col("ids").alias("ids_sha256"),
        F.col("decoded").alias("decoded_sha256"))
