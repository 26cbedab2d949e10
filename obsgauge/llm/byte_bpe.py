"""Byte-level BPE with the tokenizers library over Arrow batches.

Every byte of the UTF-8 text is mapped to one printable character, the library
merges those characters, and decoding walks the byte table backwards.  A token
may hold part of a character; decoding therefore joins bytes first and only
then reads them as UTF-8.

The vocabulary is a rank file (base64 token, rank).  The library takes merges as
pairs, so every cut of a token into two tokens becomes a merge of that token's
rank; this gives the ids of a rank-driven encoder.  Text is cut by the pattern
beforehand and equal pieces are encoded once a task (the memory of pieces is
emptied when full), since the library spends most time on repeated words.
Texts with code points on whose class the two pattern engines may disagree go
to the library whole.

Defined cases: a NULL text encodes like the empty one (no ids, empty bytes);
NULL and repeated ids are kept row by row; the empty table gives no rows; other
columns of the input are not looked at.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsgauge.llm.common import map_rows

#: Pieces remembered by a task, about 200 bytes each: ids are kept as packed 32-bit numbers.
MEMORY = 200_000


def byte_table() -> dict[int, str]:
    """Printable stand-ins: visible Latin-1 characters for themselves, the rest from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {**{b: chr(b) for b in visible}, **{b: chr(0x100 + k) for k, b in enumerate(hidden)}}


def read_ranks(vocabulary: str) -> dict[bytes, int]:
    with open(vocabulary, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def build_tokenizer(ranks: dict[bytes, int], pattern: str):
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    shown = byte_table()
    as_text = {token: "".join(shown[b] for b in token) for token in ranks}
    merges = [(as_text[token[:k]], as_text[token[k:]]) for token in sorted(ranks, key=ranks.get)
              for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks]
    made = Tokenizer(models.BPE({as_text[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made


#: Code points whose class has been the same in every Unicode version for long (Latin, punctuation, currency).
SETTLED = ((0x0, 0x24F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20AC))


def _members(test) -> str:
    """The settled code points that pass the test, as the inside of a character class."""
    return "".join(re.escape(chr(c)) for first, last in SETTLED for c in range(first, last + 1) if test(chr(c)))


def settled_pattern(pattern: str) -> re.Pattern | None:
    """The pattern for texts of settled code points, with classes written out; None if it uses others."""
    letters, digits = (_members(lambda c, k=k: unicodedata.category(c)[0] == k) for k in "LN")
    spaces = _members(lambda c: c in "\t\n\x0b\x0c\r \x85\xa0")
    parts = re.split(r"(\[\^?[^\]]*\])", pattern)  # inside brackets a class is listed bare
    for k, part in enumerate(parts):
        bare = part.startswith("[")
        for name, inside in ((r"\p{L}", letters), (r"\p{N}", digits), (r"\s", spaces)):
            part = part.replace(name, inside if bare else f"[{inside}]")
        parts[k] = part if bare else part.replace(r"\S", f"[^{spaces}]")
    written = "".join(parts)
    return None if re.search(r"\\[pPwWdDbB]", written) else re.compile(written)


class Encoder:
    """Text to ids, by remembered pieces."""

    def __init__(self, vocabulary: str, pattern: str):
        self.tokenizer = build_tokenizer(read_ranks(vocabulary), pattern)
        self.shown = byte_table()
        settled = settled_pattern(pattern)
        self.pieces = settled and settled.findall
        self.unsettled = re.compile(f"[^{_members(lambda c: True)}]").search
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("i", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def merged(self, piece: str) -> bytes:
        stand_ins = piece.encode().decode("latin-1").translate(self.shown)
        return array("i", [token.id for token in self.tokenizer.model.tokenize(stand_ins)]).tobytes()

    def __call__(self, text: str | None):
        """The ids as an array of 32-bit numbers."""
        import numpy as np

        if not text:
            return np.zeros(0, "int32")
        if self.pieces is None or self.unsettled(text):
            return np.frombuffer(self.whole(text), "int32")
        known, out = self.known, bytearray()
        for piece in self.pieces(text):
            ids = known.get(piece)
            if ids is None:
                if len(known) >= MEMORY:
                    known.clear()
                ids = self.merged(piece)
                if len(piece) < 64:
                    known[piece] = ids
            out += ids
        return np.frombuffer(bytes(out), "int32")


class Decoder:
    """Ids to bytes: the vocabulary's stand-in characters read backwards through the byte table."""

    def __init__(self, vocabulary: str):
        import numpy as np

        shown = byte_table()
        back = {c: b for b, c in shown.items()}
        by_rank = {rank: bytes(back[c] for c in "".join(shown[b] for b in token)) for token, rank in read_ranks(vocabulary).items()}
        self.tokens = [by_rank.get(k, b"") for k in range(max(by_rank) + 1)]
        self.lengths = np.array([len(t) for t in self.tokens], "int64")

    def __call__(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, ends): token ids and the byte offset in the UTF-8 text at which each token ends."""
    kind = docs.schema[id_col].dataType.simpleString()

    def start():
        encoder, lengths = Encoder(vocabulary, pattern), Decoder(vocabulary).lengths

        def row(key, text):
            ids = encoder(text)
            return key, ids, lengths[ids].cumsum()

        return row

    return map_rows(docs.select(id_col, text_col), f"`{id_col}` {kind}, ids array<int>, ends array<bigint>", start)


def decode(tokens: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded): the bytes that the ids stand for; ``decoded_text`` reads them."""
    kind = tokens.schema[id_col].dataType.simpleString()

    def start():
        decoder = Decoder(vocabulary)
        return lambda key, ids: (key, ids, decoder(ids or ()))

    return map_rows(tokens.select(id_col, ids_col), f"`{id_col}` {kind}, ids array<int>, decoded binary", start)


def decoded_text(decoded):
    """Bytes as text; what is no UTF-8 (a cut character) becomes U+FFFD."""
    return F.make_valid_utf8(decoded.cast("string"))


def digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the joined ids and of the decoded bytes.

    Both directions run in one task, so ids and bytes of the whole corpus never go through the JVM.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def start():
        from hashlib import sha256

        encoder, decoder = Encoder(vocabulary, pattern), Decoder(vocabulary)

        def row(key, text):
            ids = encoder(text).tolist()
            return key, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(decoder(ids)).hexdigest()

        return row

    return map_rows(docs.select("doc_id", "text"), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", start)
