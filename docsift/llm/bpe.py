"""BPE encoding and decoding, with tree concatenation for long unsplit text.

A text is cut at added tokens, normalised, and split into words as the vocabulary file says. Words are encoded
once and remembered (a bounded table for each worker). A word of more than `LEAF` symbols is cut into leaves,
which are encoded together as one batch, on as many threads as the library is given; then halves are joined
pairwise, up the tree: a window of tokens around each join is encoded again, and grows until its first token is
the left side's and its last token is the right side's. All neighbouring tokens are then neighbours in an exact
encoding of some stretch, which is what makes a token sequence the encoding of its whole.

Only vocabularies of this shape are handled: byte-level BPE with a suffix for word ends, NFC + lower case.

Defined results: a null text counts as empty and has no tokens; an empty table gives an empty one; repeated rows are
encoded alike; extra columns pass through. A vocabulary of another shape is refused.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE

from docsift.llm.common import ddl, passing, ship, slices

LEAF = 256
WINDOW = 4
#: Words that a worker remembers; at that many it starts afresh.
REMEMBERED = 300_000
#: Fixed value: how the vocabulary file splits a text into words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = "ɐ"  # below it, Python and the library agree on case, composition and classes


def _byte_letters() -> list[str]:
    """The usual byte-level alphabet: printable bytes stand for themselves, the others for U+0100 onwards."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        if b in own:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


_LETTERS = _byte_letters()


def _plain_pattern() -> re.Pattern:
    below = [chr(c) for c in range(ord(_PLAIN))]
    kind = lambda k: "".join(re.escape(c) for c in below if unicodedata.category(c)[0] == k)
    space = "\t-\r \x85\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{kind('L')}]+|[{kind('N')}]|[^{space}{kind('L')}{kind('N')}]+")


def check_shape(spec: dict) -> None:
    """Raise for a vocabulary file that this codec would encode otherwise than its library."""
    kinds = lambda part: [x["type"] for x in part.get("normalizers") or part.get("pretokenizers") or [part]] if part else []
    model = spec["model"]
    wrong = [
        model.get("type") != "BPE" and "model",
        model.get("continuing_subword_prefix") and "prefix",
        model.get("dropout") and "dropout",
        (not model.get("end_of_word_suffix")) and "suffix",
        not {"NFC", "Lowercase"} <= set(kinds(spec.get("normalizer"))) and "normalizer",
        "ByteLevel" not in kinds(spec.get("pre_tokenizer")) and "pre_tokenizer",
        [x["pattern"].get("Regex") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"] != [SPLIT] and "split",
        spec.get("decoder") and "decoder",
    ]
    if any(wrong):
        raise ValueError(f"not a byte-level BPE with a suffix for word ends, NFC and lower case: {[w for w in wrong if w]}")


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW):
        self.leaf, self.window = leaf, window
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_shape(spec)
        self.whole = Tokenizer.from_file(path)
        self.end_model = self.whole.model
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in spec["model"]["merges"]]
        vocab = spec["model"]["vocab"]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.inner_model = BPE(vocab=vocab, merges=merges)
        self.leaves = Tokenizer(self.inner_model)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.suffix = suffix
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pattern = _plain_pattern()
        self.known: dict[str, tuple[bytes, str]] = {}

    # Words

    def _short(self, symbols: str, last: bool) -> list[int]:
        return [t.id for t in (self.end_model if last else self.inner_model).tokenize(symbols)]

    def _symbols(self, ids: list[int]) -> str:
        return "".join(self.token[i] for i in ids).removesuffix(self.suffix)

    def _joined(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """The encoding of the text of both; last: right ends the word."""
        k = self.window
        while True:
            a, b = left[-k:], right[:k]
            at_start, at_end = len(a) == len(left), len(b) == len(right)
            body = self._symbols(a) + (self._symbols(b) if last and at_end else "".join(self.token[i] for i in b))
            new = self._short(body, last and at_end)
            if (at_start or new[0] == a[0]) and (at_end or new[-1] == b[-1]):
                return left[: len(left) - len(a)] + new + right[len(b) :]
            k *= 2

    def encode_symbols(self, symbols: str) -> list[int]:
        """One word, as byte letters."""
        if len(symbols) <= self.leaf:
            return self._short(symbols, True)
        cuts = [symbols[i : i + self.leaf] for i in range(0, len(symbols), self.leaf)]
        level = [e.ids for e in self.leaves.encode_batch(cuts[:-1], add_special_tokens=False)] + [self._short(cuts[-1], True)]
        while len(level) > 1:
            level = [
                self._joined(level[i], level[i + 1], i + 2 >= len(level)) if i + 1 < len(level) else level[i]
                for i in range(0, len(level), 2)
            ]
        return level[0]

    def _word(self, word: str) -> tuple[bytes, str]:
        ids = self.encode_symbols("".join([_LETTERS[b] for b in word.encode("utf-8")]))
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        token = self.token
        entry = (struct.pack(f"<{len(ids)}I", *ids), " ".join([token[i] for i in ids]))
        if len(word) <= 64:
            self.known[word] = entry
        return entry

    # Texts

    def words(self, text: str) -> list[str]:
        """Normalised and split, without added tokens."""
        if text.isascii():
            return self.pattern.findall(text.lower())
        if max(text) < _PLAIN:
            return self.pattern.findall(unicodedata.normalize("NFC", text).lower())
        normal = self.whole.normalizer.normalize_str(text)
        back = {c: b for b, c in enumerate(_LETTERS)}
        pieces = self.whole.pre_tokenizer.pre_tokenize_str(normal)
        return [bytes(back[c] for c in p).decode("utf-8") for p, _ in pieces]

    def _entries(self, text: str | None) -> list[tuple[bytes, str]]:
        if not text:
            return []
        out: list[tuple[bytes, str]] = []
        parts = self.cut.split(text) if self.cut and any(t in text for t in self.special) else [text]
        for p in parts:
            if p in self.special:
                out.append((struct.pack("<I", self.special[p]), p))
                continue
            known = self.known
            for w in self.words(p):
                e = known.get(w)
                out.append(e if e is not None else self._word(w))
        return out

    def encode(self, text: str | None) -> list[int]:
        data = b"".join(e[0] for e in self._entries(text))
        return list(struct.unpack(f"<{len(data) // 4}I", data))

    def encode_bytes(self, text: str | None) -> tuple[bytes, str]:
        """The ids as little-endian unsigned 32-bit integers, and the text that they decode to."""
        entries = self._entries(text)
        return b"".join([e[0] for e in entries]), " ".join([e[1] for e in entries])

    def decode(self, data: bytes) -> str:
        return " ".join([self.token[i] for (i,) in struct.iter_unpack("<I", data)])


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each process and file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_texts(docs: DataFrame, text: str = "text", path: str | None = None, keep_text: bool = False) -> DataFrame:
    """Add n_tokens and token_ids (binary: little-endian unsigned 32-bit integers). path: the vocabulary file, or
    None for the installed default, which each worker then finds for itself."""
    ship(docs.sparkSession)
    df = docs.withColumn("_text", F.col(text).cast("string"))
    fields = passing(docs, text, keep_text, "n_tokens", "token_ids")
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or vocabulary_path())
        for batch in slices(batches):
            ids = [c.encode_bytes(t)[0] for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {n: batch.column(n) for n in names} | {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "token_ids": pa.array(ids, pa.binary())}
            )

    return df.mapInArrow(run, ddl(fields, "n_tokens long", "token_ids binary"))


def decode_ids(df: DataFrame, ids: str = "token_ids", path: str | None = None, out: str = "decoded") -> DataFrame:
    """Add the text that the ids decode to, special tokens kept."""
    ship(df.sparkSession)
    fields = passing(df, "", True, out)
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or vocabulary_path())
        for batch in slices(batches):
            texts = [c.decode(x) if x else "" for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in names} | {out: pa.array(texts, pa.string())})

    return df.mapInArrow(run, ddl(fields, f"`{out}` string"))


def op6_bpe(documents: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: the number of tokens, the digest of the ids, and that of their decoding."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or vocabulary_path())
        sha = hashlib.sha256
        for batch in slices(batches):
            n, a, b = [], [], []
            for t in batch.column("text").to_pylist():
                ids, _ = c.encode_bytes(t)
                n.append(len(ids) // 4)
                a.append(sha(ids).hexdigest())
                b.append(sha(c.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": a, "decoded_sha256": b})

    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
