"""BPE encoding and decoding with forced boundaries.

A pair of neighbouring bytes that occurs inside no vocabulary token can never be merged over, so a
word may be cut there for certain. The fragments between such cuts are encoded on their own, each
distinct one once, and their ids concatenated.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer, models, pre_tokenizers

from .shared import documents, map_texts

#: White space as the tokenizer's normaliser sees it; everything else is letter, number or other.
SPACE = r"\t-\r \x85\xa0  -     　"
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
#: The same for lower-cased texts of ASCII alone.
ASCII_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
#: Words whose encodings a task remembers; then it forgets all of them.
REMEMBER = 150_000


def _byte_signs() -> list[str]:
    """The sign that stands for each byte in byte-level vocabularies: printable bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def _settled() -> str:
    """A class, for a regular expression, of the code points whose kind no Unicode version since 3.2 has changed."""
    old, runs = unicodedata.ucd_3_2_0, []
    for c in range(0x10000):
        if old.category(chr(c)) == unicodedata.category(chr(c)) != "Cn":
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)


class WordBpe:
    """Encoder and decoder for a tokenizer file of the word_bpe kind (byte-level BPE with a sign for word ends)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        vocab = model["vocab"]
        merges = [tuple(m) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.token_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        signs = _byte_signs()
        self.signs, self.byte_of = str.maketrans({chr(b): s for b, s in enumerate(signs)}), {s: b for b, s in enumerate(signs)}
        #: by first and second byte: the pair occurs inside a token; it ends one that ends a word
        self.inner, self.final = np.zeros(65536, bool), np.zeros(65536, bool)
        for token in vocab:
            ends = token.endswith(self.end) and token != self.end
            body = [self.byte_of[s] for s in (token[: -len(self.end)] if ends else token)]
            pairs = [x << 8 | y for x, y in zip(body, body[1:])]
            self.inner[pairs[: len(pairs) - ends]] = True
            if ends:
                self.final[pairs[-1:]] = True
        closed = Tokenizer(models.BPE(vocab=vocab, merges=merges, end_of_word_suffix=self.end))
        opened = Tokenizer(models.BPE(vocab=vocab, merges=merges))
        for t in (closed, opened):
            t.pre_tokenizer = pre_tokenizers.Split("\n", "removed")  # fragments hold no line feed
        self.models = {False: opened, True: closed}
        self.whole = Tokenizer.from_file(path)
        self.unsettled = regex.compile(f"[^{_settled()}]")
        self.fragments: dict[tuple[str, bool], tuple[bytes, bytes, int]] = {}
        self.words: dict[str, tuple[bytes, bytes, int]] = {}
        self.specials = {t: (np.array([i], "<u4").tobytes(), t.encode(), 1) for t, i in self.special.items()}

    def cuts(self, words: list[bytes]) -> list[list[bytes]]:
        """Each word's fragments: it is cut between all bytes that no token holds side by side."""
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int32)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        pair = data[:-1] << 8 | data[1:]
        cut = ~self.inner[pair]
        last = ends - 2  # the pair of a word's last two bytes
        last = last[np.diff(ends, prepend=0) >= 2]
        cut[last] = ~self.final[pair[last]]
        cut[ends[:-1] - 1] = False  # between words
        out = [[w] for w in words]
        at = np.flatnonzero(cut) + 1
        of = np.searchsorted(ends, at, side="right")
        starts = ends - np.fromiter(map(len, words), np.int64, len(words))
        held, first = np.unique(of, return_index=True)
        own = (at - starts[of]).tolist()
        for i, a, b in zip(held.tolist(), first.tolist(), [*first[1:].tolist(), len(own)]):
            w = words[i]
            out[i] = [w[x:y] for x, y in zip([0, *own[a:b]], [*own[a:b], len(w)])]
        return out

    def _encode_fragments(self, fragments: list[bytes], final: bool) -> list[tuple[bytes, bytes, int]]:
        """Ids, decoded text and number of ids of each fragment; nothing merges over the line feeds between them."""
        out: list[tuple[bytes, bytes, int]] = []
        token_of = self.token_of
        for at in range(0, len(fragments), 4096):
            part = fragments[at : at + 4096]
            e = self.models[final].encode("\n".join([f.decode("latin-1").translate(self.signs) for f in part]), add_special_tokens=False)
            ids = e.ids
            raw = np.array(ids, "<u4").tobytes()
            bounds = np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(part) + 1)).tolist()
            tokens = [token_of[i] for i in ids]
            out.extend((raw[4 * a : 4 * b], " ".join(tokens[a:b]).encode(), b - a) for a, b in zip(bounds, bounds[1:]))
        return out

    def forget(self) -> None:
        self.words.clear()
        self.fragments.clear()

    def _learn(self, missing: list[str]) -> None:
        """Encode words that are not remembered."""
        if len(self.words) > REMEMBER:
            self.forget()
        cuts = self.cuts([w.encode("utf-8", "surrogatepass") for w in missing])
        plain = [i for i, c in enumerate(cuts) if len(c) == 1]
        for i, found in zip(plain, self._encode_fragments([cuts[i][0] for i in plain], True)):
            self.words[missing[i]] = found
        rest = [i for i, c in enumerate(cuts) if len(c) > 1]
        new = {(f, k == len(cuts[i]) - 1) for i in rest for k, f in enumerate(cuts[i])}.difference(self.fragments)
        for final in (False, True):
            part = [f for f in new if f[1] == final]
            self.fragments.update(zip(part, self._encode_fragments([f[0] for f in part], final)))
        for i in rest:
            found = [self.fragments[f, k == len(cuts[i]) - 1] for k, f in enumerate(cuts[i])]
            self.words[missing[i]] = (b"".join([f[0] for f in found]), b" ".join([f[1] for f in found]), sum([f[2] for f in found]))

    def _split(self, text: str) -> list[str]:
        """The words of a text, and its special tokens."""
        out: list[str] = []
        for piece in self.at_special.split(text) if "<|" in text else [text]:
            if piece in self.special:
                out.append(piece)
            elif piece.isascii():
                out.extend(ASCII_SPLIT.findall(piece.lower()))
            elif not self.unsettled.search(piece):
                out.extend(SPLIT.findall(unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()))  # no final form of sigma
            else:  # code points that Unicode versions see differently: as the library's own version does
                found = self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(piece))
                out.extend(bytes([self.byte_of[s] for s in w]).decode("utf-8") for w, _ in found)
        return out

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, bytes, int]]:
        """For each text: ids as little-endian 32-bit integers, the decoded text in UTF-8, the number of ids."""
        out = []
        split = [self._split(t) for t in texts]
        missing = set().union(*split).difference(self.words, self.special)
        if len(self.words) > REMEMBER:  # _learn will forget all: learn whatever these texts need
            missing = set().union(*split).difference(self.special)
        if missing:
            self._learn(list(missing))
        known = self.words | self.specials if any("<|" in t for t in texts) else self.words
        for ws in split:
            found = [known[w] for w in ws]
            out.append((b"".join([f[0] for f in found]), b" ".join([f[1] for f in found]), sum([f[2] for f in found])))
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordBpe:
    return WordBpe(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens long, ids array<int>, ids_sha256, decoded_sha256): the ids of every whole
    text without added special tokens, strings of special tokens inside a text taken as those
    tokens, and digests of the ids (little-endian, 32 bits) and of the text decoded from them
    (tokens joined by a space, special ones kept). Null: empty. Empty: no ids, empty decoded text."""

    def make():
        enc = _encoder(path)

        def work(texts: list[str]) -> list[pa.Array]:
            rows = enc.encode_batch(texts)
            ids = np.frombuffer(b"".join([r[0] for r in rows]), "<i4")
            offsets = np.concatenate(([0], np.cumsum([r[2] for r in rows]))).astype(np.int32)
            return [
                pa.array([r[2] for r in rows], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)),
                pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows]),
                pa.array([hashlib.sha256(r[1]).hexdigest() for r in rows]),
            ]

        work.close = enc.forget
        return work

    return map_texts(docs, make, "n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded string) from (doc_id, ids array<int>): tokens joined by a space. Null ids: empty."""
    import pandas as pd

    def run(parts):
        token_of = _encoder(path).token_of
        for p in parts:
            yield pd.DataFrame({"doc_id": p["doc_id"], "decoded": [" ".join([token_of[i] for i in ids]) if ids is not None else "" for ids in p["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, decoded string")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
