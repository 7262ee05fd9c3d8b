"""Token counts of a byte-level BPE vocabulary by the whole-token shortcut.

Offline, every string of the vocabulary is encoded alone; those that give exactly one token are proven
whole tokens. A pre-token that equals one of them counts as that token without any merging. Only the
other pre-tokens are merged, each distinct one once per batch, by the library itself.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

# The white space of the split pattern, and the contractions that it takes first.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"

#: Characters below are of classes that all Unicode versions agree on, so the split is done here; a
#: chunk that holds others is split by the library. A run of white space always ends a pre-token, but
#: for one blank that goes with what follows.
PLAIN = "\u0250"
_CHUNKS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_PLAIN = re.compile(f"[\x00-{chr(ord(PLAIN) - 1)}]*")


def _kind(first: str) -> str:
    """The plain characters of a general category, for use inside a class."""
    return "".join(c for c in map(chr, range(ord(PLAIN))) if unicodedata.category(c)[0] == first)


_PRE_TOKENS = re.compile(
    f"{CONTRACTIONS}| ?[{_kind('L')}]+| ?[{_kind('N')}]+| ?[^{SPACE}{_kind('L')}{_kind('N')}]+"
    f"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: Longer pieces are not remembered; the memory holds so many pieces at most, then starts anew.
LONGEST, REMEMBERED = 64, 400_000


def default_vocabulary() -> str:
    """The path of the vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteVocabulary:
    """A byte-level BPE vocabulary of the tokenizers library, with its proven whole tokens."""

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        split = whole.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", False)
        if (whole.get("model") or {}).get("type") != "BPE" or whole.get("normalizer") or not plain:
            raise ValueError(f"{path} is no byte-level BPE without a normaliser, whose splits this operator knows")
        added = whole["added_tokens"]
        self.special = {token["content"]: token["id"] for token in added}
        self._special = re.compile("|".join(map(re.escape, self.special)) or "(?!)")
        # The byte alphabet by its rule: printable bytes stand for themselves, the rest follow 255.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        self.alphabet = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.whole = self._prove()
        self.known: dict[str, bytes] = {}

    def _prove(self) -> dict[str, bytes]:
        """Strings of the vocabulary that encode alone as one token, with that token as 4 bytes."""
        byte = {character: b for b, character in self.alphabet.items()}
        texts = []
        for token in self.library.get_vocab(with_added_tokens=False):
            try:
                texts.append(bytes(byte[c] for c in token).decode())
            except (KeyError, UnicodeDecodeError):
                continue
        coded = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return {
            text: code.ids[0].to_bytes(4, "little")
            for text, code in zip(texts, coded, strict=True)
            if len(code.ids) == 1 and text not in self.special
        }

    def _merge(self, piece: str) -> bytes:
        """The ids that the library's merges make of a pre-token, 4 bytes each."""
        mapped = piece.encode().decode("latin-1").translate(self.alphabet)
        return b"".join([t.id.to_bytes(4, "little") for t in self.library.model.tokenize(mapped)])

    def _split_and_merge(self, chunk: str) -> bytes:
        """The ids of a chunk whose characters the library has to split."""
        code = self.library.encode(chunk, add_special_tokens=False)
        return b"".join([i.to_bytes(4, "little") for i in code.ids])

    def _coded(self, part: str) -> bytes:
        """Ids of a stretch without special strings: whole tokens are looked up, the rest merged."""
        plain = _PLAIN.fullmatch(part)
        found = (_PRE_TOKENS if plain else _CHUNKS).findall(part)
        coded = [*map(self.known.get, found)]
        if None in coded:
            for at, piece in enumerate(found):
                if coded[at] is None:
                    ids = self.whole.get(piece) or self.known.get(piece)
                    if ids is None:
                        ids = (self._merge if plain else self._split_and_merge)(piece)
                    if len(piece) <= LONGEST:
                        self.known[piece] = ids
                    coded[at] = ids
        return b"".join(coded)

    def _parts(self, text: str) -> Iterator[tuple[str, bytes]]:
        """Plain stretches of a text, each with the id of the special string after it."""
        at = 0
        for match in self._special.finditer(text):
            yield text[at : match.start()], self.special[match[0]].to_bytes(4, "little")
            at = match.end()
        yield text[at:], b""

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text, 4 little-endian bytes each; null is empty."""
        for text in texts:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            coded = []
            for part, after in self._parts(text or ""):
                coded += self._coded(part), after
            yield b"".join(coded)


@lru_cache(maxsize=2)
def vocabulary(path: str | None = None) -> ByteVocabulary:
    """The vocabulary of this worker, read and proven once."""
    return ByteVocabulary(path or default_vocabulary())


def token_counts(
    docs: DataFrame, limit: int = 512, path: str | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` of every whole text, without begin or end tokens.

    Special strings inside a text are special tokens, as the library takes them by default. A null text
    counts as empty: 0 bytes, 0 tokens. Rows that repeat are counted each; null keys stay; further
    columns are ignored; an empty table gives no rows. No row moves: the plan is a scan and a map.
    """

    def count(batches):
        words = vocabulary(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tokens = [len(ids) // 4 for ids in words.encode(texts)]
            size = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0)
            yield pa.record_batch(
                [
                    batch.column(0),
                    size.cast(pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                names=[key, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        count, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
