"""Byte pair encoding and decoding with the merges of a given tokenizer file.

The symbols of a word form a doubly linked list; a priority queue holds its
neighbours that can merge, lowest rank first, leftmost first among equals.  A
merge joins two links and queues the two new neighbours.  Entries whose symbols
have changed since are stale and are skipped when they come up.  A word of n
symbols takes n log n steps, so text without a space is no trap.  Decoding puts
the vocabulary's strings together.

Files are those of the ``tokenizers`` library with a BPE model that marks word
ends and spells bytes as characters.  Text is cut at white space, then by the
file's own pattern; what a piece of text between white space becomes is kept for
the next time it comes up.  Beyond printable ASCII the file's normaliser and
pattern are asked themselves, since their Unicode tables are the library's.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from folioflow.llm.common import table

# Pieces kept by a worker, and the longest of them: at most about 200 MB.
KEPT, KEPT_CHARS = 1 << 19, 64
ROWS = 256
# The pattern of the file for printable ASCII, and what else `\s` is not.
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
NO_SPACE = re.compile("[\x1c-\x1f]")
SPACE = re.compile(r"[^\S\x1c-\x1f]+")


def merged(symbols: list[int], pairs: dict[int, tuple[int, int]]) -> list[int]:
    """``symbols`` after all merges; ``pairs`` maps ``left << 32 | right`` to (rank, result)."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = [(rule[0], i) for i in range(n - 1) if (rule := pairs.get(symbols[i] << 32 | symbols[i + 1]))]
    heapify(queue)
    while queue:
        rank, i = heappop(queue)
        j = after[i]
        if symbols[i] < 0 or j >= n:
            continue
        rule = pairs.get(symbols[i] << 32 | symbols[j])
        if rule is None or rule[0] != rank:
            continue
        symbols[i], symbols[j] = rule[1], -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if new := pairs.get(rule[1] << 32 | symbols[k]):
                heappush(queue, (new[0], i))
        h = before[i]
        if h >= 0 and (new := pairs.get(symbols[h] << 32 | rule[1])):
            heappush(queue, (new[0], h))
    return [s for s in symbols if s >= 0]


class WordBpe:
    """A tokenizer file: text to ids, ids to text."""

    def __init__(self, spec: str):
        file = json.loads(spec)
        model = file["model"]
        end = model["end_of_word_suffix"] or ""
        plain = model["type"] == "BPE" and not (model["unk_token"] or model["continuing_subword_prefix"] or model["byte_fallback"] or model["ignore_merges"])
        if not plain or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"]):
            raise ValueError("only word-end BPE files with plain added tokens are read")
        vocab = model["vocab"]
        self.strings = {i: token for token, i in vocab.items()} | {t["id"]: t["content"] for t in file["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.inner = {token: i for token, i in vocab.items() if len(token) == 1}
        self.last = {token[: len(token) - len(end)]: i for token, i in vocab.items() if token.endswith(end) and len(token) == len(end) + 1}
        self.pairs = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.setdefault(vocab[left] << 32 | vocab[right], (rank, vocab[left + right]))
        rules = Tokenizer.from_str(spec)
        self.normalise, self.cut = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str
        self.kept: dict[str, bytes] = {}
        self.words: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        """Ids of one word, whose bytes are spelled as characters."""
        found = self.words.get(word)
        if found is None:
            symbols = [self.inner.get(c, -1) for c in word[:-1]] + [self.last.get(word[-1], -1)]
            found = merged([s for s in symbols if s >= 0], self.pairs)
            if len(word) <= KEPT_CHARS:
                if len(self.words) >= KEPT:
                    self.words.clear()
                self.words[word] = found
        return found

    def piece(self, piece: str) -> bytes:
        """Ids of a text without white space and special tokens, packed."""
        if piece.isascii() and piece.isprintable():
            words = ASCII_WORDS.findall(piece.lower())
        else:
            words = [w for w, _ in self.cut(self.normalise(piece))]
        ids = np.array([i for w in words for i in self.word(w)], "<u4").tobytes()
        if len(piece) <= KEPT_CHARS:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out, kept = [], self.kept
        parts = self.special_pattern.split(text) if self.special_pattern else [text]
        for i, part in enumerate(parts):
            if i % 2:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            for piece in SPACE.split(part) if NO_SPACE.search(part) else part.split():
                ids = kept.get(piece)
                out.append(self.piece(piece) if ids is None else ids)
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        """The strings of all known ids, special tokens too; files without a decoder put spaces between."""
        strings = self.strings
        return " ".join([strings[i] for i in np.frombuffer(packed, "<u4").tolist() if i in strings])


LOADED: dict[int, WordBpe] = {}


def loaded(spec: str) -> WordBpe:
    """One copy for each worker process and file."""
    key = hash(spec)
    if key not in LOADED:
        LOADED.clear()
        LOADED[key] = WordBpe(spec)
    return LOADED[key]


def spec_of(path: str) -> str:
    """The tokenizer file as text, read by the driver; a few MB."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def with_column(df: DataFrame, read: str, name: str, kind: T.DataType, convert: str, path: str) -> DataFrame:
    """``df`` and a column ``name`` made by ``WordBpe.<convert>`` from column ``read``."""
    df = df.drop(name)
    fields = [*df.schema.fields, T.StructField(name, kind)]
    spec = df.sparkSession.sparkContext.broadcast(spec_of(path))
    arrow = pa.binary() if isinstance(kind, T.BinaryType) else pa.string()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change, empty = getattr(loaded(spec.value), convert), "" if convert == "encode" else b""
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                values = [change(empty if v is None else v) for v in part.column(read).to_pylist()]
                yield pa.record_batch([*part.columns, pa.array(values, arrow)], [*part.schema.names, name])

    return df.mapInArrow(apply, T.StructType(fields))


def encoded(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` (packed little-endian unsigned 32-bit integers) and ``n_tokens``.

    The ids are those of the ``tokenizers`` library for the file at ``path``
    without added special tokens; special tokens spelled in a text are encoded as
    such.  ``path`` is read by the driver alone.  Null and empty texts have no
    tokens, repeated rows are encoded each, columns named like the results are
    replaced, empty tables stay empty.  A text is one value, whatever its length.
    """
    ids = with_column(docs.drop("n_tokens"), text_col, "token_ids", T.BinaryType(), "encode", path)
    return ids.withColumn("n_tokens", (F.octet_length("token_ids") / 4).cast("long"))


def decoded(tokens: DataFrame, path: str, ids_col: str = "token_ids") -> DataFrame:
    """``tokens`` with ``decoded``: the text that packed ids stand for.

    Unknown ids are skipped, as the library does; null and empty ids give the
    empty text.  A column ``decoded`` is replaced.
    """
    return with_column(tokens, ids_col, "decoded", T.StringType(), "decode", path)


def op13_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    tokens = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    return decoded(tokens, path).select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
